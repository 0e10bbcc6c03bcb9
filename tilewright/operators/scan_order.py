"""Tiles in reading order: which later tiles overlap one, and bands of neighbours that can be read at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators.ordered import numbered, running_sums
from tilewright.operators.spatial import BOX, spatial_join


def reading_order(tiles: DataFrame, slide: str = "slide") -> DataFrame:
    """``tiles`` with ``nth`` from 0 by (iy, ix) within each slide."""
    return numbered(tiles, [slide], [F.col("iy"), F.col("ix")], "nth")


def overlapping_tiles(ordered: DataFrame, cell: float, slide: str = "slide", strict_scan: bool = False) -> DataFrame:
    """``slide``, a and b: numbers of tiles that overlap, a before b in reading order.

    ``strict_scan`` looks at later tiles only up to the first one that starts at or below a tile's lower edge, which
    hides overlaps of regions that lie beside one another."""
    slim = ordered.select(slide, "nth", *BOX)
    pairs = spatial_join(slim, slim, [slide], cell, F.col("a.nth") < F.col("b.nth")).select(F.col(f"a.{slide}").alias(slide), F.col("a.nth").alias("a"), F.col("b.nth").alias("b"), F.col("a.y2").alias("edge"))
    if not strict_scan:
        return pairs.select(slide, "a", "b")
    tops = ordered.groupBy(slide, F.col("y1").alias("top")).agg(F.sort_array(F.collect_list("nth")).alias("at"))  # a row of tiles each
    bounds = pairs.select(slide, "a", "edge").distinct().join(tops, slide).where("top >= edge")
    later = F.array_min(F.filter("at", lambda n: n > F.col("a")))
    stops = bounds.groupBy(slide, "a").agg(F.min(later).alias("stop"))
    return pairs.join(stops, [slide, "a"], "left").where("stop is null or b < stop").select(slide, "a", "b")


def bands(ordered: DataFrame, most: int, slide: str = "slide") -> DataFrame:
    """``slide``, band (from 0), x, y, w, h and the tiles' numbers: runs of consecutive tiles with equal y and height that
    end within ``most`` of the first one's x; the first tile itself may be wider. x is the first tile's.

    Each tile is joined to the one before it to see where y or height change; running counts of the changes go through
    ranges of the order. A run is a row of tiles of one slide, so the fold that starts bands anew sees a row at a time."""
    before = ordered.select(slide, (F.col("nth") + 1).alias("nth"), F.col("y").alias("_y"), F.col("h").alias("_h"))
    linked = ordered.join(before, [slide, "nth"], "left")
    fresh = F.when((F.col("_y") == F.col("y")) & (F.col("_h") == F.col("h")), 0).otherwise(1)
    rows = running_sums(linked.select(slide, "nth", "x", "y", "w", "h", fresh.alias("_fresh")), [slide], [F.col("nth")], {"run": F.col("_fresh")})
    runs = rows.groupBy(slide, "run", "y", "h").agg(F.sort_array(F.collect_list(F.struct("nth", "x", "w"))).alias("tiles"))
    kind = "array<struct<x:bigint,x2:bigint,tiles:array<bigint>>>"

    def step(acc: Column, t: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        x, end = t["x"].cast("long"), (t["x"] + t["w"]).cast("long")
        joined = F.struct(last["x"].alias("x"), F.greatest(last["x2"], end).alias("x2"), F.concat(last["tiles"], F.array(t["nth"].cast("long"))).alias("tiles"))
        alone = F.struct(x.alias("x"), end.alias("x2"), F.array(t["nth"].cast("long")).alias("tiles"))
        return F.when(last.isNotNull() & (end - last["x"] <= most), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(alone)))

    cut = runs.select(slide, "y", "h", F.explode(F.aggregate("tiles", F.array().cast(kind), step)).alias("b"))
    out = cut.select(slide, F.col("b.x").alias("x"), "y", (F.col("b.x2") - F.col("b.x")).alias("w"), "h", F.col("b.tiles").alias("tiles"))
    return numbered(out, [slide], [F.get("tiles", F.lit(0))], "band").select(slide, "band", "x", "y", "w", "h", "tiles")
