"""Near-duplicate vectors by cover-tree dual traversal.

Vectors are compared within a label, by cosine in double precision; two are linked from ``THRESHOLD`` on. On unit
vectors that is a distance of at most ``REACH``. Equal vectors of a label form one class and are counted, not
compared.

The top of the tree is shared: a bounded sample of vectors (``CENTRES`` in expectation) are its nodes, each vector
belongs to the nearest node of its label, and a node's covering radius is its farthest member's distance. Pairs of nodes
that are farther apart than both radii and REACH are pruned. Nodes with many members are dealt into blocks of about
``BLOCK``, and each pair of blocks that is left becomes one group, a task's work. In it both blocks are arranged in
cover trees, whose levels halve the radius, and the trees are traversed together: node pairs out of reach are pruned,
node pairs wholly within reach are linked without looking at their members, and the others are split down to single
vectors. A group sends on each vector's number of links and its component within the group, not the pairs.

Edge cases: vectors that are null, zero, empty or hold null or non-finite components, and those without a label, link
with nothing; vectors of different lengths are never compared; rows with the same vec_id are vectors of their own;
a null id names a component only if all of its vectors have null ids; an empty table gives no rows; other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators.components import connected_components
from tilewright.plans.storage import discard, materialize

THRESHOLD = 0.98
#: Shared nodes (in expectation), vectors in a block (about), and members of a node that is not split further.
CENTRES, BLOCK, LEAF = 1024, 1000, 16
#: Slack for rounding in distance bounds: the distance of vectors close to one another, sqrt(2 - 2 cosine), is only
#: right to about 2e-8, and a bound adds up two covering radii and a distance.
SLACK = 1e-7


def reach(threshold: float) -> float:
    """The distance of unit vectors whose cosine is ``threshold``."""
    return float(np.sqrt(max(0.0, 2 - 2 * threshold)))


class CoverTree:
    """Nodes with a centre, a covering radius (of all members), their members, and children at half the scale."""

    def __init__(self, points: np.ndarray, members: np.ndarray, centre: int, radius: float, scale: float = 1.0):
        self.centre, self.radius, self.members, self.children = centre, radius, members, []
        if len(members) <= 1 or radius == 0:
            return
        while scale >= radius:
            scale /= 2
        rest = members
        at = centre
        while len(rest):
            distance = np.sqrt(np.maximum(0.0, 2 - 2 * (points[rest] @ points[at])))
            distance[rest == at] = 0.0
            near = distance <= scale
            if len(members) <= LEAF:
                near = rest == at  # single vectors
            self.children.append(CoverTree(points, rest[near], at, float(distance[near].max()), scale / 2))
            rest = rest[~near]
            at = rest[0] if len(rest) else at

    @staticmethod
    def of(points: np.ndarray, members: np.ndarray) -> CoverTree:
        distance = np.sqrt(np.maximum(0.0, 2 - 2 * (points[members] @ points[members[0]])))
        return CoverTree(points, members, members[0], float(distance.max()))


def dual_links(points: np.ndarray, a: CoverTree, b: CoverTree, threshold: float) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """Linked single pairs (as arrays of two rows) and pairs of member arrays that are linked throughout."""
    limit, singles, wholes = reach(threshold), [], []
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        xs, ys = x.children or [x], y.children or [y]
        cx, cy = np.array([n.centre for n in xs]), np.array([n.centre for n in ys])
        rx, ry = np.array([n.radius for n in xs]), np.array([n.radius for n in ys])
        cosine = points[cx] @ points[cy].T
        distance = np.sqrt(np.maximum(0.0, 2 - 2 * cosine))
        around = rx[:, None] + ry
        lone = np.array([len(n.members) == 1 for n in xs])[:, None] & np.array([len(n.members) == 1 for n in ys])
        i, j = np.nonzero(lone & (cosine >= threshold))
        singles.append(np.stack([cx[i], cy[j]]))
        inside = ~lone & (distance + around <= limit - SLACK)
        for i, j in zip(*np.nonzero(inside), strict=True):
            wholes.append((xs[i].members, ys[j].members))
        for i, j in zip(*np.nonzero(~lone & ~inside & (distance <= around + limit + SLACK)), strict=True):
            if not xs[i].children and not ys[j].children:  # equal members on either side
                near = points[xs[i].members] @ points[ys[j].members].T >= threshold
                k, m = np.nonzero(near)
                singles.append(np.stack([xs[i].members[k], ys[j].members[m]]))
            else:
                stack.append((xs[i], ys[j]))
    return singles, wholes


def group_links(points: np.ndarray, copies: np.ndarray, side_a: np.ndarray, side_b: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For the points of two blocks (or of one, if ``side_b`` is None): the copies each is linked with, itself not
    counted, and the smallest index in its component."""
    a = CoverTree.of(points, side_a)
    b = a if side_b is None else CoverTree.of(points, side_b)
    singles, wholes = dual_links(points, a, b, threshold)
    links = np.zeros(len(points), np.int64)
    i, j = np.concatenate(singles, axis=1) if singles else np.zeros((2, 0), np.int64)
    np.add.at(links, i, copies[j])
    if side_b is not None:
        np.add.at(links, j, copies[i])
    for x, y in wholes:
        links[x] += copies[y].sum()
        if side_b is not None:
            links[y] += copies[x].sum()
    if side_b is None:  # the traversal of a tree with itself meets every pair both ways, and each point with itself
        own = np.zeros(len(points), bool)
        own[i[i == j]] = True
        for x, y in wholes:
            own[np.intersect1d(x, y)] = True
        links -= np.where(own, copies, 0)
    label = np.arange(len(points))
    while True:
        old = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        for x, y in wholes:
            label[x] = label[y] = min(label[x].min(), label[y].min())
        label = label[label]
        if np.array_equal(old, label):
            return links, label


def _units(column: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for vectors that cannot be compared."""
    out: list[np.ndarray | None] = []
    for v in column:
        x = None
        if v.is_valid and len(v.values) and v.values.null_count == 0:
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            top = np.abs(x).max()
            x = x / top if np.isfinite(top) and top > 0 else None
            x = None if x is None else x / np.sqrt(x @ x)
        out.append(x)
    return out


def _scan(vectors: DataFrame) -> DataFrame:
    """vec_id, cls (null if it links with nothing), label, dim and unit (doubles as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, dims, units = [], [], []
            for label, x in zip(batch.column(1).to_pylist(), _units(batch.column(2)), strict=True):
                good = label is not None and x is not None
                raw = x.tobytes() if good else None
                cls.append(hashlib.blake2b(f"{label}:".encode() + raw, digest_size=16).digest() if good else None)
                dims.append(len(x) if good else None)
                units.append(raw)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "label": batch.column(1), "cls": pa.array(cls, pa.binary()), "dim": pa.array(dims, pa.int32()), "unit": pa.array(units, pa.binary())})

    plain = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    return plain.mapInArrow(run, "vec_id long, label long, cls binary, dim int, unit binary")


def _placed(classes: DataFrame, centres: list) -> DataFrame:
    """Add cell (the nearest centre of the label; -1 if it has none) and the distance to it."""
    by: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for k, r in enumerate(centres):
        by.setdefault((r.label, r.dim), ([], []))
        by[r.label, r.dim][0].append(k)
        by[r.label, r.dim][1].append(np.frombuffer(r.unit))
    held = classes.sparkSession.sparkContext.broadcast({k: (np.array(n), np.array(m)) for k, (n, m) in by.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            keys: dict[tuple[int, int], list[int]] = {}
            for i, key in enumerate(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True)):
                if key in held.value:
                    keys.setdefault(key, []).append(i)
            for key, at in keys.items():
                numbers, matrix = held.value[key]
                points = np.frombuffer(b"".join(batch.column("unit").take(pa.array(at)).to_pylist())).reshape(len(at), -1)
                for s in range(0, len(at), 4096):
                    cosine = points[s : s + 4096] @ matrix.T
                    best = cosine.argmax(1)
                    cell[at[s : s + 4096]] = numbers[best]
                    far[at[s : s + 4096]] = np.sqrt(np.maximum(0.0, 2 - 2 * cosine[np.arange(len(best)), best]))
            yield pa.RecordBatch.from_pydict({"c": batch.column("c"), "label": batch.column("label"), "dim": batch.column("dim"), "copies": batch.column("copies"), "unit": batch.column("unit"), "cell": cell, "far": far})

    return classes.select("c", "label", "dim", "copies", "unit").mapInArrow(run, "c long, label long, dim int, copies long, unit binary, cell int, far double")


def _group(table: pa.Table, threshold: float) -> pa.Table:
    table = table.sort_by("c")
    points = np.frombuffer(b"".join(table.column("unit").to_pylist())).reshape(table.num_rows, -1)
    side = table.column("side").to_numpy()
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    c, copies = table.column("c").to_numpy(), table.column("copies").to_numpy()
    if not len(a) or (not len(b) and not table.column("alone")[0].as_py()):
        return pa.table({"c": c[:0], "links": copies[:0], "root": c[:0]})
    links, label = group_links(points, copies, a, b if len(b) else None, threshold)
    some = np.flatnonzero(links)
    return pa.table({"c": c[some], "links": links[some], "root": c[label[some]]})


def components(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of each vector."""
    spark = vectors.sparkSession
    rows = materialize(_scan(vectors))
    first = F.min(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id")).alias("m")
    classes = rows.where("cls is not null").groupBy("cls").agg(first, F.count("*").alias("copies"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("unit").alias("unit"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("c"), "cls", F.col("m.vec_id").alias("vec_id"), "copies", "label", "dim", "unit"))
    share = min(CENTRES / max(1, classes.count()), 1 / BLOCK)
    chosen = F.pmod(F.xxhash64("cls"), F.lit(1 << 30)) < int(share * (1 << 30))
    centres = sorted(classes.where(chosen).select("label", "dim", "unit").collect(), key=lambda r: (r.label, r.dim, bytes(r.unit)))
    placed = materialize(_placed(classes, centres))

    cells = placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.max("far").alias("radius"))
    radius = {r.cell: r.radius for r in cells.where("cell >= 0").select("cell", "radius").collect()}  # CENTRES at most
    points = [np.frombuffer(r.unit) for r in centres]
    pairs = [(-1, -1)]
    for x in radius:
        for y in radius:
            if x == y or ((centres[x].label, centres[x].dim) == (centres[y].label, centres[y].dim) and np.linalg.norm(points[x] - points[y]) <= radius[x] + radius[y] + reach(threshold) + SLACK):
                pairs.append((x, y))
    near = spark.createDataFrame(pairs, "cell int, other int")
    partners = near.join(cells.select("label", "dim", F.col("cell").alias("other"), F.col("blocks").alias("other_blocks")), "other")
    own = placed.join(cells.select("label", "dim", "cell", "blocks"), ["label", "dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    spread = own.join(partners, ["label", "dim", "cell"]).withColumn("other_block", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)))
    me, you = F.struct("cell", "block"), F.struct(F.col("other").alias("cell"), F.col("other_block").alias("block"))
    keyed = spread.select("label", "dim", F.least(me, you).alias("p"), F.greatest(me, you).alias("q"), F.when(me <= you, 0).otherwise(1).alias("side"), (me == you).alias("alone"), "c", "copies", "unit")
    group_key = ["label", "dim", "p.cell", "p.block", "q.cell", "q.block"]
    keyed = keyed.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(group_key)], "side", "alone", "c", "copies", "unit")
    found = materialize(keyed.groupBy(*[f"k{i}" for i in range(6)]).applyInArrow(lambda t: _group(t, threshold), "c long, links long, root long"))

    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    labels = connected_components(found.select("c", "root"))
    discard(placed)
    named = classes.select("c", "cls", "vec_id", "copies").join(links, "c", "left").join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    names = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    by_class = named.join(names, "component").select("cls", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("vec_id", "cls").join(by_class, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
