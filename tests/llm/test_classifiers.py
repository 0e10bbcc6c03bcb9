"""Held-out accuracy on made-up labelled texts, scores against plain sums, and odd rows."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilewright.llm import quality, toxicity
from tilewright.llm import words as W
from tilewright.llm.ftrl import Ftrl, fit, start_state


def made(seed: int = 1, n: int = 500):
    rng = random.Random(seed)
    base = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter", "so") for b in ("na", "pu", "rel", "sto")]
    docs, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choice(base) for _ in range(rng.randrange(4, 12))) + "." for _ in range(rng.randrange(2, 12))]
        toxic, good = rng.random() < 0.3, rng.random() < 0.7
        if toxic:
            k = rng.randrange(len(sentences))
            sentences[k] = "vile " + sentences[k]
        text = " ".join(sentences)
        docs.append((i, text if good else " ".join(w + rng.choice(("###", "%%%")) for w in text.split()), "src", 1))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = made()
    return spark.createDataFrame(docs, "doc_id long, text string, source string, score int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_generalises(tables):
    docs, labels = tables
    rows = quality.classify(docs, labels).join(labels, "doc_id").collect()
    assert len(rows) == 500 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    right = [r.predicted == r.quality for r in rows if r.held_out]
    assert sum(right) >= 0.97 * len(right)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_generalises_and_finds_the_sentence(tables):
    docs, labels = tables
    rows = toxicity.detect(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    right = [r.predicted == r.toxic for r in rows if r.held_out]
    assert sum(right) >= 0.95 * len(right)
    hits = [(r, s) for r in rows if r.toxic and r.predicted for s in r.offending]
    assert sum("vile" in r.text.encode()[s.start : s.end].decode() for r, s in hits) >= 0.95 * len(hits) > 0
    assert all(r.n_offending == len(r.offending) for r in rows)


@pytest.mark.parametrize("operator", [quality.classify, toxicity.detect])
def test_odd_rows(spark, tables, operator):
    docs, labels = tables
    odd = spark.createDataFrame([(None, "x y"), (900, None), (901, ""), (902, "a b"), (902, "a b"), (903, "w " * 60_000), (904, " \t\n")], "doc_id long, text string")
    rows = {(r.doc_id, i): r for i, r in enumerate(operator(docs.select("doc_id", "text").union(odd), labels.union(spark.createDataFrame([(None, 1, 1), (900, None, None)], labels.schema))).collect())}
    assert len(rows) == 507
    of = lambda k: [r for (i, _), r in rows.items() if i == k]
    assert of(None)[0].held_out is False and of(902)[0].score == of(902)[1].score
    assert of(900)[0].score == of(901)[0].score == of(904)[0].score
    assert operator(docs.limit(0), labels).count() == 0
    assert {r.held_out for r in operator(docs, labels.limit(0)).collect()} == {True, False}


def test_score_is_the_sparse_dot_product():
    texts, rng = ["", "one", "two two words", "Some LONGER text, with 3 kinds!! of it"], np.random.default_rng(1)
    weights = rng.normal(size=(1 << 10) + 1)
    got = quality.score_texts(pa.array(texts), weights, 10)
    for text, s in zip(texts, got, strict=True):
        groups = quality.features(*W.flat(pa.array([text])), 10)
        every = np.concatenate([f for f, _ in groups])
        logit = weights[-1] + quality.SCALE * weights[every].sum() / max(1, len(every))
        assert s == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-8)


def test_ftrl_matches_the_formula():
    f, z, n, w = Ftrl(bits=2, alpha=0.5, beta=1.0, l1=0.1, l2=0.2), np.zeros(5), np.zeros(5), np.zeros(5)
    for g in (0.7, -0.2, 0.4):
        f.update(z, n, np.array([3]), w[3:4], np.array([g]))
        w = f.weights(z, n)
    z1 = 0.7
    w1 = -(z1 - 0.1) / ((1 + 0.7) / 0.5 + 0.2)
    n2 = 0.49 + 0.04
    z2 = z1 - 0.2 - (n2**0.5 - 0.7) / 0.5 * w1
    w2 = -(z2 - 0.1) / ((1 + n2**0.5) / 0.5 + 0.2)
    n3 = n2 + 0.16
    z3 = z2 + 0.4 - (n3**0.5 - n2**0.5) / 0.5 * w2
    assert w[3] == pytest.approx(-(z3 - 0.1) / ((1 + n3**0.5) / 0.5 + 0.2)) and w[:3].tolist() == [0, 0, 0]


def test_score_is_the_noisy_or_of_sentences():
    """Against plain sums over a regular expression's words; a feature counts once in a sentence."""
    rng = np.random.default_rng(2)
    weights = np.where(rng.random((1 << 10) + 1) < 0.6, 0, rng.normal(size=(1 << 10) + 1))
    weights[-1] = -2.0
    texts = ["", " .!", "One.", "one two One! Three-four, élan? word\nNext words.. x", "a" * 40 + " " + "bbbbbbbbb " * 3, None]
    got = toxicity._score(pa.array(texts), weights, 0.75, 10)
    for k, text in enumerate(texts):
        none, spans = 1.0, []
        for m in re.finditer(rb"[^.!?\n]+", (text or "").encode()):
            words = list(re.finditer(rb"[0-9A-Za-z\x80-\xff]+", m.group()))
            at = set()
            for w in words:
                low = w.group().lower()
                for n in (0, *toxicity.PREFIXES):
                    if len(low) > n:
                        data = np.frombuffer(low[:n] if n else low, np.uint8)
                        at.add(int(W.span_hashes(data, np.array([0]), np.array([len(data)]), n)[0] >> np.uint64(54)))
            if words:
                logit = weights[-1] + sum(weights[i] for i in at)
                none *= 1 - 1 / (1 + np.exp(-logit))
                if logit >= 0.75:
                    spans.append((m.start() + words[0].start(), m.start() + words[-1].end()))
        assert got["score"][k].as_py() == pytest.approx((1 - none) / (1 - none + none * np.exp(0.75)), abs=1e-8)
        assert [(s["start"], s["end"]) for s in got["offending"][k].as_py()] == spans and got["n_offending"][k].as_py() == len(spans)


def test_cut_is_in_the_middle_of_the_best():
    counts = np.zeros((2 * toxicity.REACH * toxicity.STEP, 2))
    assert toxicity.best_cut(counts) == 0.0
    counts[100, 0], counts[140, 1] = 5, 3
    assert toxicity.best_cut(counts) == pytest.approx((101 + 140) / 2 / toxicity.STEP - toxicity.REACH, abs=0.5 / toxicity.STEP + 1e-9)


def test_blocks_of_states_average(spark):
    rows = spark.createDataFrame([(i, s, 1, "x") for s in range(3) for i in range(2)], "doc_id long, shard int, y int, text string")
    def learn(z, n, t):
        z[5], n[5] = t.column("shard")[0].as_py(), 4.0
    f = Ftrl(bits=14, l1=0.0)
    z, n = start_state(f, -1.0)
    z[5], n[5] = 1.0, 4.0
    assert np.allclose(fit(rows, f, learn, -1.0, rounds=1), f.weights(z.astype(float), n.astype(float)), atol=1e-6)


@pytest.mark.parametrize(("operator", "label"), [(quality.classify, "quality"), (toxicity.detect, "toxic")])
def test_labels_other_than_0_and_1_teach_nothing(spark, tables, operator, label):
    docs, labels = tables
    odd = labels.withColumn(label, F.when(F.col("doc_id") % 10 == 3, F.lit(2)).when(F.col("doc_id") % 10 == 4, F.lit(-1)).otherwise(F.col(label)))
    without = labels.where("doc_id % 10 not in (3, 4)")
    scores = lambda y: [tuple(r)[:4] for r in operator(docs, y).orderBy("doc_id").collect()]
    assert scores(odd) == scores(without)
    assert len(scores(labels.withColumn(label, F.lit(5)))) == docs.count()


@pytest.mark.parametrize(("operator", "label"), [(quality.classify, "quality"), (toxicity.detect, "toxic")])
def test_clashing_column_names(tables, operator, label):
    """Columns of documents that are named like those of labels, features or results are not looked at."""
    docs, labels = tables
    other = docs.select("doc_id", "text").withColumns({c: F.lit(1) for c in ("y", "shard", "score", "held_out", "predicted", "quality", "toxic", "block", "z", "n", "_text", "offending")})
    rows = lambda df: sorted(tuple(r)[:4] for r in df.collect())
    assert rows(operator(other, labels.withColumn("text", F.lit("x")))) == rows(operator(docs, labels))
