"""Each stage on what the one before it kept, against plain versions."""

import hashlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest

from tests.llm.test_bpe import library  # noqa: F401
from tests.llm.test_mixing import brute_targets
from tests.llm.test_neardup import brute
from tests.llm.test_pii import brute as personal


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet").cache(), []
    for name, stage in corpus_pipeline.STAGES:
        new = stage(spark, docs, sf_dir).cache()
        out.append((name, docs, new))
        docs = new
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _, _ in stages] == ["quality", "near_duplicates", "personal_data", "mixing", "tokens"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_keeps_good_documents(spark, sf_dir, stages):
    _, before, after = stages[0]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    right = [(r.doc_id in kept) == bool(r.quality) for r in labels.collect()]
    assert sum(right) > 0.9 * len(right) and len(kept) < before.count()


def test_one_document_of_each_group(stages):
    _, before, after = stages[1]
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, _, c in brute(before.collect())})


def test_mix_and_tokens(stages, library):  # noqa: F811
    _, before, after = stages[3]
    words = lambda t: len((t or "").encode().split())
    sizes, taken, most = Counter(), Counter(), Counter()
    for r in before.collect():
        sizes[r.source] += words(r.text)
        most[r.source] = max(most[r.source], words(r.text))
    rows = after.collect()
    for r in rows:
        taken[r.source] += words(r.text)
    assert max(Counter(r.doc_id for r in rows).values()) <= 2
    for s, want in brute_targets(sizes).items():
        assert abs(taken[s] - want) <= most[s]
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in stages[4][2].collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(texts[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_personal_data_goes(stages):
    _, before, after = stages[2]
    new = {r.doc_id: r for r in after.collect()}
    assert len(new) == before.count()
    for r in before.collect():
        spans = sorted(s for found in personal(r.text or "").values() for s in found)
        if not spans and "[" not in (new[r.doc_id].text or ""):
            assert new[r.doc_id] == r
        for a, b in spans:
            assert r.text[a:b] not in new[r.doc_id].text
        assert not any(personal(new[r.doc_id].text or "")[k] for k in ("email", "ip"))


ODD = "doc_id long, text string, lang string, source string, n_chars int, `a.b` int, score string, payload int, _row string, bucket int, r int, cls int"


def odd_rows():
    long = " ".join(f"word{i % 997}." for i in range(60_000))
    texts = [None, "", " \t\n", "a b", "a b", "one two three four five six", "one two three four five six", "mail a@b.co now", long, "x" * 100_000, "é 日本語 " * 3, "10.0.0.1 " * 600]
    rows = [(i if i % 5 else None, t, "en", ("s", None, "t")[i % 3], len(t or ""), i, "s", i, "r", i, i, i) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[7], rows[7]]


@pytest.mark.parametrize("n", range(5))
def test_odd_rows_through_each_stage(spark, sf_dir, n):
    name, stage = corpus_pipeline.STAGES[n]
    docs, rows = spark.createDataFrame(odd_rows(), ODD), odd_rows()
    got = stage(spark, docs, sf_dir)
    out = got.collect()
    assert stage(spark, docs.limit(0), sf_dir).count() == 0
    if name != "tokens":
        assert got.columns == docs.columns
    plain = [tuple(r) for r in out]
    if name == "quality":
        kept = Counter(plain)
        assert all(kept[r] in (0, c) for r, c in Counter(rows).items()) and set(kept) <= set(rows)
        assert len({r in kept for r in rows if not (r[1] or "").split()}) == 1
    elif name == "near_duplicates":
        assert len(out) == len(set(plain)) and set(plain) <= set(rows)
        assert {(r[0], r[1]) for r in rows if not (r[1] or "").split()} == {(r[0], r[1]) for r in plain if not (r[1] or "").split()}
    elif name == "personal_data":
        assert Counter((r[0], r[5]) for r in plain) == Counter((r[0], r[5]) for r in rows)
        texts = {r.r: r.text for r in out}
        assert texts[0] is None and texts[7] == "mail [EMAIL] now" and texts[11] == "[IP] " * 600 and texts[8] == rows[8][1]
    elif name == "mixing":
        count = Counter((r[0], r[5]) for r in plain)
        assert all(count[r[0], r[5]] == Counter(rows)[r] for r in rows if not (r[1] or "").split())
        assert all(c <= 2 * Counter((r[0], r[5]) for r in rows)[k] for k, c in count.items())
    else:
        assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows) and sum(r.n_tokens == 0 for r in out) == 2


def test_run(spark, sf_dir, stages):
    rows = corpus_pipeline.run(spark, sf_dir)
    key = lambda df: sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in df.collect())
    assert key(rows) == key(stages[4][2]) and P.path("x")


def test_near_copies_that_share_an_id_with_another_text(spark):
    """What stays is found by id and text: an id that is kept for one text does not keep another."""
    words = [f"w{i}" for i in range(60)]
    p, q, r = " ".join(words[:40]), " ".join(words[20:] + words[:5][::-1]), " ".join(words[::-1])
    rows = [(3, p), (5, q), (5, p + " more"), (7, r), (7, r + " more"), (None, q + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    kept = [(x.doc_id, x.text) for x in corpus_pipeline.STAGES[1][1](spark, docs, "").collect()]
    assert len(kept) == 3 and {(3, p), (5, q)} <= set(kept) and len([1 for i, _ in kept if i == 7]) == 1


def test_ties_in_the_mix_go_by_id_and_text(spark):
    rows = [(i, t, "en", s, 1) for s in ("a", "b", "c") for i, t in ((2, "x"), (1, "y"), (1, "x"), (None, "z"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    first = [tuple(r) for r in corpus_pipeline.STAGES[3][1](spark, docs, "").collect()]
    again = [tuple(r) for r in corpus_pipeline.STAGES[3][1](spark, docs.repartition(3), "").collect()]
    assert [r[:2] for r in first] == [r[:2] for r in again] and len(first) > 6
