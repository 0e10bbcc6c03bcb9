"""Targets by resharing round after round, and the mix's invariants."""

import re

import pytest
from pyspark.sql import functions as F

from tilewright.llm import mixing


def brute_targets(sizes: dict) -> dict:
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, left, free = {}, 1.5 * sum(sizes.values()), set(order)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            free.discard(s)
        left = 1.5 * sum(sizes.values()) - sum(out.values())
    return out


def check(rows, docs):
    sizes = {}
    for d in docs:
        sizes[d.source] = sizes.get(d.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
    want, source, taken = brute_targets(sizes), {d.doc_id: d.source for d in docs}, {}
    assert len(rows) == len(docs)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], abs=1e-6)
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(p.words for p in r.passes)
        assert (r.position is None) == (r.size > 0 == r.taken) and all(0 <= p.position <= 1 for p in r.passes)
        taken[s] = taken.get(s, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    found = [r.position for r in rows if r.position is not None]
    assert found == sorted(found) and all(r.position is None for r in rows[len(found) :])


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix(docs).collect()
    check(rows, docs.collect())
    assert rows == mixing.mix(docs.repartition(3)).collect()


def test_edges(spark):
    schema = "doc_id long, text string, source string, size int"
    docs = spark.createDataFrame([(1, "a b c", None, 1), (2, None, "é", 1), (3, "", "b", 2), (4, "x " * 500, "b", 3), (5, "a\x0bb\xa0c", "B", 1), (6, "q", "z", 0), (7, "w w", "z", 0)], schema)
    check(mixing.mix(docs).collect(), docs.collect())
    same = docs.union(docs)
    assert mixing.mix(same).count() == 14
    assert mixing.mix(docs.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(docs.where("text is null")).collect()} == {0}


@pytest.mark.parametrize("sizes", [(3000, 3000, 3000), (6000, 6000, 300)])
def test_words_taken_follow_the_schedule(spark, sizes):
    """Words taken in each tenth of training against the integral of the schedule, for targets below and above the size."""
    rows = [(i, "a b c d e", f"s{k}") for k, n in enumerate(sizes) for i in range(k * 10_000, k * 10_000 + n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").select("source", "source_size", "target", F.explode("passes").alias("p")).select("source", "source_size", "target", "p.*").toPandas()
    integral = lambda u, tilt: u + tilt * (u * u - u)
    below = set()
    for k, tilt in enumerate(mixing.TILTS):
        own = mixed[mixed["source"] == f"s{k}"]
        target = own["target"].iloc[0]
        below.add(bool(target < own["source_size"].iloc[0]))
        for tenth in range(10):
            got = own[(own["position"] >= tenth / 10) & ((own["position"] < (tenth + 1) / 10) | (tenth == 9))]["words"].sum()
            assert got == pytest.approx(target * (integral((tenth + 1) / 10, tilt) - integral(tenth / 10, tilt)), abs=10)
    assert below == {True, False}


def test_passes_stand_apart(spark):
    docs = spark.createDataFrame([(i, "a b c", "x") for i in range(200)], "doc_id long, text string, source string")
    twice = [r for r in mixing.mix(docs).collect() if len(r.passes) == 2]
    assert len(twice) == 100 and all(r.passes[1].position - r.passes[0].position > 0.3 for r in twice)
    order = [r.doc_id for r in mixing.apply_mix(docs).collect()]
    assert len(order) == 300 and order[:100] == order[200:]


def test_rows_with_one_id_are_dealt_apart(spark):
    docs = spark.createDataFrame([(None, f"w{i} w", "s", 1) for i in range(400)], "doc_id long, text string, source string, size int")
    rows = mixing.mix(docs).collect()
    assert len({r.position for r in rows}) == 400 and sum(r.taken for r in rows) == 1200


def test_wordless_texts_stay_once(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n", None), (4, "", "only"), (4, "", "only"), (5, "a b c", "a")]
    mixed = mixing.apply_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(r.doc_id for r in mixed if r.doc_id < 5) == [1, 2, 3, 4, 4]
    assert {r.doc_id for r in mixed} == {1, 2, 3, 4, 5}
