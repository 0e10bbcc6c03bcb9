"""Rectangle joins over a grid of cells, and removal of detections that tiles share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.geometry import intersects, iou_eps, iou_plain
from tilewright.operators.components import connected_components
from tilewright.operators.regions import z_order

BOX = ("x1", "y1", "x2", "y2")
#: Side of a cell: boxes of up to half of it lie in two cells on average, and a cell holds few.
CELL = 128.0


def _cells(df: DataFrame, cell: float) -> DataFrame:
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    return df.withColumn("gx", F.explode(span("x1", "x2"))).withColumn("gy", F.explode(span("y1", "y2")))


def spatial_join(left: DataFrame, right: DataFrame, by: list[str], cell: float, extra: Column | None = None) -> DataFrame:
    """Pairs of intersecting boxes (x1, y1, x2, y2) with equal ``by``; columns come back as structs ``a`` and ``b``.

    Boxes are dealt to the cells they touch and joined on (by, cell), which AQE may split where a cell is crowded. A
    pair is kept only in the cell of its intersection's corner, so no distinct follows. Choose a cell near the largest
    common side: a box then touches four cells at most. ``extra`` may refer to a.* and b.*."""
    held = lambda df: [c for c in df.columns if c not in by]
    a = _cells(left, cell).select(*by, "gx", "gy", F.struct(*held(left)).alias("a"))  # without ``by``, so that the sides of a join with itself are one shuffle
    b = _cells(right, cell).select(*by, "gx", "gy", F.struct(*held(right)).alias("b"))
    ca, cb = [F.col(f"a.{c}") for c in BOX], [F.col(f"b.{c}") for c in BOX]
    home = (F.floor(F.greatest(ca[0], cb[0]) / cell) == F.col("gx")) & (F.floor(F.greatest(ca[1], cb[1]) / cell) == F.col("gy"))
    whole = lambda df, n: F.struct(*[F.col(c) if c in by else F.col(f"{n}.{c}").alias(c) for c in df.columns]).alias(n)
    pairs = a.join(b, [*by, "gx", "gy"]).where(intersects(ca, cb) & home).select(whole(left, "a"), whole(right, "b"))
    return pairs if extra is None else pairs.where(extra)


def iou_matrix(left: DataFrame, right: DataFrame, by: list[str], key: str, cell: float = CELL) -> DataFrame:
    """``by``, a and b (the keys), plain and eps (the overlap without and with a small addend): the entries of the matrix of
    all pairs with equal ``by`` that are not 0, which only boxes that intersect have. No pair that lies apart is formed."""
    pairs = spatial_join(left.select(*by, key, *BOX), right.select(*by, key, *BOX), by, cell)
    a, b = ([F.col(f"{t}.{c}") for c in BOX] for t in "ab")
    return pairs.select(*[F.col(f"a.{c}").alias(c) for c in by], F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), iou_plain(a, b).alias("plain"), iou_eps(a, b).alias("eps"))


def dedup_edges(detections: DataFrame, iou: float, slide: str = "slide", tile: str = "tile", key: str = "det_id", cell: float = CELL, place: bool = False) -> DataFrame:
    """Pairs (a, b) of detections in different tiles of a slide that overlap by more than ``iou``.

    ``place`` adds columns by which pairs that lie near one another sort together (``PLACE``)."""
    extra = (F.col(f"a.{tile}") != F.col(f"b.{tile}")) & (F.col(f"a.{key}") < F.col(f"b.{key}"))
    slim = detections.select(slide, tile, key, *BOX)
    pairs = spatial_join(slim, slim, [slide], cell, extra)
    value = iou_eps([F.col(f"a.{c}") for c in BOX], [F.col(f"b.{c}") for c in BOX])
    along = [F.floor(F.col(f"a.{c}") / (2 * cell)).cast("int") for c in ("x1", "y1")]
    where = [F.col(f"a.{slide}").alias(PLACE[0]), z_order(*along).alias(PLACE[1])] if place else []
    return pairs.where(value > iou).select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), *where)


#: Where a pair lies: its slide, and its cell along a Z-order curve.
PLACE = ("_slide", "_cell")


def component_labels(detections: DataFrame, iou: float, **names) -> DataFrame:
    """node and component (the smallest key reachable) of the detections that overlap others; they lie together, so pairs
    are joined by place first, whatever the keys are like."""
    return connected_components(dedup_edges(detections, iou, place=True, **names), near=list(PLACE))


def with_components(detections: DataFrame, labels: DataFrame, key: str = "det_id") -> DataFrame:
    """Detections with ``component``, their own key if they overlap none."""
    return detections.join(labels.withColumnRenamed("node", key), key, "left").withColumn("component", F.coalesce("component", key))


def deduplicate(detections: DataFrame, iou: float = 0.5, key: str = "det_id", score: str = "score", **names) -> DataFrame:
    """The best detection of each component, the earlier key on equal scores.

    Only keys and scores of those in a component meet there; what gives way to a better one is then taken out of the
    detections. Their keys are unique."""
    labels = component_labels(detections, iou, key=key, **names)
    scored = detections.select(F.col(key).alias("node"), F.col(score).alias("_score")).join(labels, "node")
    best = scored.groupBy("component").agg(F.max_by("node", F.struct("_score", -F.col("node"))).alias("best"))
    gone = scored.join(best, "component").where("node <> best").select(F.col("node").alias(key))
    return detections.join(gone, key, "left_anti")
