"""Connected components of an edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.plans.storage import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect each node's larger neighbours to the smallest node of its neighbourhood."""
    both = edges.select("hi", "lo").unionAll(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy("hi").agg(F.least("hi", F.min("lo")).alias("root"))
    linked = both.join(least, "hi").where("lo > hi and lo <> root")
    return linked.select(F.col("lo").alias("hi"), F.col("root").alias("lo")).unionAll(least.where("root < hi").select("hi", F.col("root").alias("lo"))).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect each node's smaller neighbours, and itself, to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("root"))
    linked = edges.join(least, "hi").where("lo <> root")
    return linked.select(F.col("lo").alias("hi"), F.col("root").alias("lo")).unionAll(least.select("hi", F.col("root").alias("lo"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether all are stars: every larger end has one edge and is no edge's smaller end."""
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionAll(edges.select("lo", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def _contracted(edges: DataFrame, near: list[str], whole: bool = False) -> DataFrame:
    """Edges that connect the same nodes, with each batch's own components as stars.

    Edges are sorted by ``near`` (by id, if nothing is given) into batches, so components that lie together there are
    stars at once. With ``whole``, the smallest node of a star comes too, as its own end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            nodes, at = np.unique(ends, return_inverse=True)
            a, b = at.reshape(2, -1)
            label = np.arange(len(nodes))
            while True:
                least = np.minimum(label[a], label[b])
                new = label.copy()
                for side in (label[a], label[b], a, b):
                    np.minimum.at(new, side, least)
                while not np.array_equal(new, new[new]):
                    new = new[new]
                if np.array_equal(new, label):
                    break
                label = new
            some = np.arange(len(nodes)) if whole else np.flatnonzero(label != np.arange(len(nodes)))
            yield pa.RecordBatch.from_pydict({"hi": nodes[some], "lo": nodes[label[some]]})

    order = near or ["lo"]
    return edges.repartitionByRange(*order).sortWithinPartitions(*order).select("hi", "lo").mapInArrow(run, "hi long, lo long")


def _joined(given: DataFrame, near: list[str], max_rounds: int) -> DataFrame:
    """Components of edges (hi, lo) that lie together by ``near``: rounds see only the stars that share a node with a star of
    another batch, by their smallest nodes, however many edges there are."""
    stars = materialize(_contracted(given, near, whole=True))
    least = materialize(stars.groupBy("hi").agg(F.min("lo").alias("least"), F.max("lo").alias("most")))
    shared = least.where("least <> most").select("hi", "least")
    across = materialize(stars.join(shared, "hi").where("lo <> least").select("lo", "least").distinct())
    discard(stars)
    found = connected_components(across, max_rounds)
    discard(across)
    return least.join(found.withColumnRenamed("node", "least"), "least", "left").select(F.col("hi").alias("node"), F.coalesce("component", "least").alias("component"))


def connected_components(edges: DataFrame, max_rounds: int = 60, near: list[str] | None = None) -> DataFrame:
    """(node, component) of each node that an edge touches; component is the smallest node reachable.

    ``edges``: two columns of comparable ids, in any direction, and the columns ``near``, if any, by which the edges of a
    component lie together; loops and rows with a null are ignored, repeated edges count once. Every round is written to shared storage, so lineage stays short. A node that has very many neighbours
    is only ever joined to one row, its minimum, and that join's large side can be split. Components end as stars, so
    the number of rounds is logarithmic. Whole-number ids are first joined within batches; where they lie together by ``near``,
    rounds are left to what crosses batches. No edges: no rows."""
    near = near or []
    a, b = (c for c in edges.columns if c not in near)
    now = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"), *near).where(f"`{a}` is not null and `{b}` is not null").where("hi <> lo")
    whole = {k: v for k, v in now.dtypes if k in ("hi", "lo")} == {"hi": "bigint", "lo": "bigint"}
    given = materialize(now)  # range sorting reads it twice
    if near and whole:
        joined = _joined(given, near, max_rounds)
        discard(given)
        return joined
    now = materialize((_contracted(given, near) if whole else given.select("hi", "lo")).distinct())
    discard(given)
    for _ in range(max_rounds):
        if _settled(now):
            break
        given, now = now, materialize(_small_star(_large_star(now)))
        discard(given)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
