"""Tile grids as generators: no shuffle, one row in, its tiles out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from tilewright.functions.geometry import col


def _shifted(start, length, size: int, step: int) -> Column:
    """Origins from start on in steps; a tile that would pass the end is moved back to end there."""
    s, n = col(start), col(length)
    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / step).cast("int") - 1))
    return F.when(n > 0, F.transform(steps, lambda k: F.least(s + k * step + size, s + n) - size)).otherwise(F.array().cast("array<bigint>"))


def dataset_tiles(regions: DataFrame, tile_size: int, overlap: float, keep: list[str]) -> DataFrame:
    """``keep``, x, y: tiles over each region (columns x, y, w, h). Repeated tiles stay; stores drop them."""
    step = max(1, int(tile_size * (1 - overlap)))
    rows = regions.select(*keep, F.explode(_shifted("y", "h", tile_size, step)).alias("ty"), _shifted("x", "w", tile_size, step).alias("xs"))
    return rows.select(*keep, F.explode("xs").alias("x"), F.col("ty").alias("y"))


def axis_positions(length, tile_size: int, stride: int) -> Column:
    """Origins 0, stride, ... that fit, and the last one that touches the end; [0] for a short axis."""
    n = col(length).cast("long")
    last = F.greatest(n - tile_size, F.lit(0))
    return F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), last, F.lit(stride).cast("long")), F.array(last)))


def stride_of(tile_size: int, overlap: float) -> int:
    return max(1, round(tile_size * (1.0 - overlap)))


def slide_tiles(slides: DataFrame, tile_size: int, overlap: float, keep: list[str]) -> DataFrame:
    """``keep``, x, y, w, h, ix, iy over whole slides (columns width, height)."""
    stride = stride_of(tile_size, overlap)
    rows = slides.select(*keep, F.posexplode(axis_positions("height", tile_size, stride)).alias("iy", "y"), axis_positions("width", tile_size, stride).alias("xs"))
    size = F.lit(tile_size)
    return rows.select(*keep, "iy", "y", F.posexplode("xs").alias("ix", "x")).select(*keep, "x", "y", size.alias("w"), size.alias("h"), "ix", "iy")


def roi_tiles(rois: DataFrame, tile_size: int, overlap: float, slide: str, order: str) -> DataFrame:
    """``slide``, ``order``, x, y, w, h, ix, iy over regions (x, y, w, h in pixels; width, height of the slide).

    A region is clamped to the slide (its origin is moved to 0 without shrinking it first), empty ones are skipped,
    and each region's rows of tiles start one past the rows of the regions before it."""
    stride = stride_of(tile_size, overlap)
    zero = F.lit(0)
    r = rois.withColumns({"rx": F.greatest(zero, F.col("x")), "ry": F.greatest(zero, F.col("y"))})
    r = r.withColumns({"rw": F.least("w", F.col("width") - F.col("rx")), "rh": F.least("h", F.col("height") - F.col("ry"))}).where("rw > 0 and rh > 0")
    r = r.withColumns({"xs": axis_positions("rw", tile_size, stride), "ys": axis_positions("rh", tile_size, stride)})
    before = Wd.partitionBy(slide).orderBy(order).rowsBetween(Wd.unboundedPreceding, -1)
    r = r.withColumn("iy0", F.coalesce(F.sum(F.size("ys") + 1).over(before), F.lit(0)))
    r = r.select(slide, order, "rx", "ry", "iy0", "xs", F.posexplode("ys").alias("iy", "dy"))
    r = r.select(slide, order, "rx", "ry", "iy0", "iy", "dy", F.posexplode("xs").alias("ix", "dx"))
    size = F.lit(tile_size)
    return r.select(slide, order, (F.col("rx") + F.col("dx")).alias("x"), (F.col("ry") + F.col("dy")).alias("y"), size.alias("w"), size.alias("h"), "ix", (F.col("iy0") + F.col("iy")).alias("iy"))
