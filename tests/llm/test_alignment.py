"""Groups, links and counts against both public libraries and a plain byte-by-byte alignment."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tilewright.llm import alignment as A
from tilewright.llm import words as W

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


@pytest.fixture(scope="module")
def tokens():
    return A.ByteTokens(PATHS[0]), A.PieceTokens(PATHS[1])


def spelt(token):
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = [b for b in range(256) if b not in printable]
    return bytes(ord(c) if ord(c) in printable else spare[ord(c) - 256] for c in token)


def piece(p):
    return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()


def plain(text, libraries):
    """Ids, the groups as text, and the links of a text."""
    if not text:
        return 0, 0, 0, "", []
    a, b = libraries
    enc = a.encode(" " + text, add_special_tokens=False)
    ia, ta = enc.ids, [spelt(t) for t in enc.tokens]
    ib = b.encode(text)
    tb = [piece(p) for p in b.id_to_piece(ib)]
    if b"".join(ta) != (" " + text).encode() or b"".join(tb) != (" " + text).encode():
        return 0, 0, 0, "", []
    owner_a = [k for k, t in enumerate(ta) for _ in t]
    owner_b = [k for k, t in enumerate(tb) for _ in t]
    links = sorted(set(zip(owner_a, owner_b, strict=True)))
    ends_a, ends_b = set(np.cumsum([len(t) for t in ta]).tolist()), set(np.cumsum([len(t) for t in tb]).tolist())
    groups, last = [], 0
    for end in sorted(ends_a & ends_b):
        groups.append(",".join(str(ia[k]) for k in sorted(set(owner_a[last:end]))) + "|" + ",".join(str(ib[k]) for k in sorted(set(owner_b[last:end]))))
        last = end
    return len(ia), len(ib), len(groups), ";".join(groups), [(ia[x], ib[y]) for x, y in links]


AWKWARD = [None, "", " ", "   ", "a", "<|endoftext|>", "<s> </s> <unk> <0x41>", "x▁y", "a\x00b", "\n", " \n ", "a \n b  \t c", "é   x è y", "é\xa0 x　 y  z\x85 w", "日本語テキスト 한국어", "😀👍🏽 ok", "z" * 3000, "'s 's don't we'll", "ﬁ ǅ ſ", "tail  ", "it’s “quoted” … text", "q\x1c r\x7f s", "a" * 40_000 + " b"]


def texts(n=1500):
    rng = random.Random(11)
    pool = "aAbZ'sretlvdm  \n\t.,!?0123éÉßΣ中ñ 　😀-_|<> \xa0"
    return AWKWARD + ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_groups_equal_a_plain_alignment(libraries, tokens):
    rows = texts()
    numbers, got, (codes, cut, at, times) = A.align_slice(*W.flat(pa.array(rows)), *tokens)
    for k, text in enumerate(rows):
        n_a, n_b, n_groups, groups, links = plain(text, libraries)
        assert got[k].decode() == groups, text
        assert tuple(int(numbers[name][k]) for name in A.NUMBERS) == (n_a, n_b, n_groups, len(links))
        own = {(int(codes[i]) // A.BELOW, int(codes[i]) % A.BELOW): int(t) for i, t in zip(at[cut[k] : cut[k + 1]], times[cut[k] : cut[k + 1]], strict=True)}
        assert own == dict(Counter(links))


def test_rows_as_units_give_the_same(tokens):
    rows = texts(300)
    whole = A.align_slice(*W.flat(pa.array(rows)), *tokens)
    tokens[1].whole = False
    try:
        other = A.align_slice(*W.flat(pa.array(rows)), *tokens)
    finally:
        tokens[1].whole = True
    assert whole[1] == other[1] and all((whole[0][k] == other[0][k]).all() for k in whole[0])


def test_union_finds_components():
    rng = random.Random(4)
    for n in (1, 2, 30, 400):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)] + [(i, i + 1) for i in range(n // 3)]
        got = A.union(n, *(np.array(x, np.int64) for x in zip(*edges, strict=True))) if edges else A.union(n, *[np.zeros(0, np.int64)] * 2)
        label = list(range(n))
        while any(label[a] != label[b] for a, b in edges):
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        assert got.tolist() == label


def want(rows, libraries):
    each = [plain(t, libraries) for _, t in rows]
    counts = Counter(link for e in each for link in e[4])
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted(
        (str(i), e[0], e[1], e[2], len(e[4]), hashlib.sha256(e[3].encode()).hexdigest() if e[0] else "", sum(counts[x] == most[x[1]] for x in e[4]), sum(counts[x] for x in e[4]))
        for (i, _), e in zip(rows, each, strict=True)
    )


def check(docs, libraries):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = A.weigh(A.align(docs, *PATHS)).select("doc_id", *A.NUMBERS, "groups_sha256", "n_best", "count_sum").collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == want(rows, libraries)


def test_table(spark, sf_dir, libraries):
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"), libraries)


def test_chunks_repeats_and_clashing_names(spark, libraries, monkeypatch):
    rows = [(k % 70, t, "x", 1) for k, t in enumerate(texts(60))] * 2 + [(None, "a b", "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a string, pair int")
    check(docs, libraries)
    assert A.align(docs.limit(0), *PATHS).count() == 0 and A.weigh(A.align(docs.limit(0), *PATHS)).count() == 0
    check(docs.where("text IS NULL OR text = ''"), libraries)


def test_groups_as_text(spark, libraries):
    docs = spark.createDataFrame([(1, "Tokenizers disagree."), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.groups for r in A.align(docs, *PATHS, groups=True).where("_pairs IS NULL").collect()}
    assert got == {1: plain("Tokenizers disagree.", libraries)[3], 2: ""}
