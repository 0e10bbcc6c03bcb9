"""Token ids and counts against the public libraries, over real rows and awkward strings."""

import base64
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tilewright.llm import bpe
from tilewright.llm import words as W

def balanced(n: int) -> tuple[str, str]:
    """Two words of n letters, alike under many polynomial hashes: the Thue-Morse word and its opposite."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


AWKWARD = ["", " ", "   ", "a", "'s", "''s", " 's", "x's y'll 'S don't we'RE it'd'd", "\n\n a", "a \n b  \t", "<|endoftext|>a<|startoftext|>", "İΣας ΟΔΟΣ", "é   x", "123 4five ½²", "日本語テキスト 한국어", "😀😀👍🏽 ok", "a" * 3000, "\x00\x01\x1c\x1f \x85z", "Å", "''''s 'd'", "'lll 'vex 'r", "<|endoftext", "ﬁ ǅ ſ K", *balanced(1024), *balanced(4096), "y" * 70_000]


def texts() -> list[str]:
    rng = random.Random(5)
    pool = "aAbZ'sretlvdm  \n\t.,!?0123éÉßΣ中ñ 　😀-_|<>"
    return AWKWARD + ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(4000)]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library_and_round_trip(library):
    encoder, rows = bpe.RankEncoder(P.path("byte_bpe_50k.tiktoken")), texts()
    data, offsets = W.flat(pa.array(rows))
    ids, cut = encoder.encode(data, offsets)
    for k, text in enumerate(rows):
        assert ids[cut[k] : cut[k + 1]].tolist() == library.encode_ordinary(text), text
    assert bpe.RankDecoder(P.path("byte_bpe_50k.tiktoken")).decode(ids)[0].tobytes() == data.tobytes()


def test_equal_hashes_do_not_make_equal_pieces(library, monkeypatch):
    monkeypatch.setattr(W, "span_hashes", lambda data, starts, ends, seed=0: np.asarray(ends - starts, np.uint64))
    words = ["ab", "cd", "ab", "xyz", "cd", "xyy"]
    data, ends = np.frombuffer("".join(words).encode(), np.uint8), np.cumsum([len(w) for w in words])
    begins = ends - np.array([len(w) for w in words])
    first, which, _ = bpe.distinct(data, begins, ends)
    assert [words[first[k]] for k in which] == words
    monkeypatch.setattr(W, "CHUNK", 3)
    assert [words[bpe.distinct(data, begins, ends)[0][k]] for k in bpe.distinct(data, begins, ends)[1]] == words


def test_every_code_point(library):
    encoder = bpe.RankEncoder(P.path("byte_bpe_50k.tiktoken"))
    rows = [f"a{chr(c)}b {chr(c)}1" for c in [*range(0xD800), *range(0xE000, 0x30000, 7)]]
    ids, cut = encoder.encode(*W.flat(pa.array(rows)))
    bad = [hex(ord(t[1])) for k, t in enumerate(rows) if ids[cut[k] : cut[k + 1]].tolist() != library.encode_ordinary(t)]
    assert not bad


def test_perfect_hash_is_minimal():
    table = bpe.RankEncoder(P.path("byte_bpe_50k.tiktoken")).hash
    assert sorted(table.key) == list(range(len(table.key)))
    h1, h2 = (W.span_hashes(table.flat, table.begins, table.ends, s) for s in (0, 1))
    assert (table.find(h1, h2) == np.arange(len(table.key))).all()


def test_counts_equal_the_library():
    library, counter, rows = Tokenizer.from_file(P.path("word_bpe_49k.json")), bpe.MergeCounter(P.path("word_bpe_49k.json")), texts()
    want = [len(e.ids) for e in library.encode_batch(rows, add_special_tokens=False)]
    got = counter.count([t.encode() for t in rows])
    assert [(t, w, g) for t, w, g in zip(rows, want, got, strict=True) if w != g] == []


def test_tables(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(None, None), (7, ""), (7, "x")], "doc_id long, text string"))
    path = P.path("byte_bpe_50k.tiktoken")
    for row in bpe.decode(bpe.encode(docs, path, ("doc_id", "text")), path).collect():
        assert np.frombuffer(row.ids, "<u4").tolist() == library.encode_ordinary(row.text or "") and bytes(row.decoded) == (row.text or "").encode()
    tokens = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for row in bpe.count(docs, P.path("word_bpe_49k.json"), ("doc_id", "text")).collect():
        assert (row.n_tokens, row.n_bytes) == (len(tokens.encode(row.text or "", add_special_tokens=False).ids), len((row.text or "").encode()))
    assert bpe.encode(docs.limit(0), path).count() == 0


def test_clashing_column_names(spark, library):
    docs = spark.createDataFrame([(1, "a b", "x", 3, b"y"), (None, None, "x", 3, b"y")], "doc_id long, text string, ids string, n_tokens int, decoded binary")
    path = P.path("byte_bpe_50k.tiktoken")
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    assert np.frombuffer(got[1].ids, "<u4").tolist() == library.encode_ordinary("a b") and bytes(got[1].decoded) == b"a b" and bytes(got[None].ids) == b""
    counted = {r.doc_id: r.n_tokens for r in bpe.count(docs.withColumn("_text", F.lit("z")), P.path("word_bpe_49k.json")).collect()}
    assert counted == {1: 2, None: 0}
