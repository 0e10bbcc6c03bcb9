"""Views that stand in for slides, tiles, detections and planes, made from the driver's tables with whole numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.geometry import clip_to, to_global
from tilewright.operators.grid import slide_tiles
from tilewright.operators.spatial import BOX, spatial_join
from tilewright.plans.storage import table


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_orderkey div 500 as slide", "(o_orderkey * 7919) % 2000 as x", "(o_custkey * 10473 + o_orderkey * 131) % 2000 as y",
        "24 + o_orderkey % 41 as w", "24 + o_custkey % 41 as h", "o_orderpriority as label",
    )
    return o.selectExpr("*", "x as x1", "y as y1", "x + w as x2", "y + h as y2")


def tiles(spark: SparkSession) -> DataFrame:
    grid = slide_tiles(spark.sql("select 2048 as width, 2048 as height"), 512, 0.25, [])
    return grid.selectExpr("*", "iy * 10 + ix as tile", "x as x1", "y as y1", "x + w as x2", "y + h as y2")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each object is seen, a little moved and clipped, in every tile that it meets."""
    o = objects(spark, sf_dir)
    pairs = spatial_join(o.withColumn("k", F.lit(1)), tiles(spark).withColumn("k", F.lit(1)), ["k"], 512.0)
    flat = pairs.selectExpr("a.*", "b.tile", "b.ix", "b.iy", "b.x as tx", "b.y as ty")
    flat = flat.selectExpr("*", "((o_orderkey * 31 + ix * 17 + iy * 13) % 5) - 2 as dx", "((o_orderkey * 29 + ix * 11 + iy * 19) % 5) - 2 as dy")
    box = clip_to(F.expr("x1 + dx - tx"), F.expr("y1 + dy - ty"), F.expr("x2 + dx - tx"), F.expr("y2 + dy - ty"), F.lit(512), F.lit(512))
    flat = flat.select("slide", "tile", "o_orderkey", "ix", "iy", "tx", "ty", *[b.alias(n) for b, n in zip(box, ("c1", "c2", "c3", "c4"), strict=True)]).where("c3 > c1 and c4 > c2")
    placed = [c.cast("double").alias(n) for c, n in zip(to_global("c1", "c2", "c3", "c4", "tx", "ty"), BOX, strict=True)]
    key, score = "slide * 1000000000 + o_orderkey * 100 + iy * 10 + ix as det_id", "((o_orderkey * 7919 + ix * 911 + iy * 3571) % 10007) / 10007D as score"
    return flat.select("slide", "tile", F.expr(key), *placed, F.expr(score))


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacks of five 8 x 8 planes: tile, z, px (64 values of 0 to 255, row by row)."""
    e = table(spark, sf_dir, "embeddings")
    return e.selectExpr("vec_id div 5 as tile", "vec_id % 5 as z", "transform(embedding, v -> cast(floor((cast(v as double) + 1) * 127.5D) as int)) as px")
