"""Slides, their pages, tiles and products: lookups, sizes, samples and read-outs of tile stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from tilewright.functions.geometry import col
from tilewright.operators.ordered import numbered

#: Magnifications count as equal up to this much.
TOLERANCE = 1e-6


def page_index(requests: DataFrame, pages: DataFrame, strict: bool = False) -> DataFrame:
    """``requests`` (slide, magnification, z, ...) with ``page``: the first page of exactly that magnification and z.

    Without such a page it is null; ``strict`` raises instead. Pages: slide, magnification, z, page."""
    first = pages.groupBy("slide", "magnification", "z").agg(F.min("page").alias("page"))
    out = requests.join(first, ["slide", "magnification", "z"], "left")
    if strict and (lost := out.where("page is null").select("slide", "magnification", "z").first()):
        raise ValueError(f"slide {lost[0]} has no page at magnification {lost[1]}, z {lost[2]}")
    return out


def available_magnifications(pages: DataFrame) -> DataFrame:
    """slide and its magnifications, in order."""
    return pages.groupBy("slide").agg(F.sort_array(F.collect_set("magnification")).alias("magnifications"))


def image_size(slides: DataFrame, pages: DataFrame, magnification: float, strict: bool = False) -> DataFrame:
    """slide, width and height in pixels at a magnification (half to even), null where the slide has none such.

    ``strict`` raises with the list of those that there are. Slides: slide, full_width, full_height, objective_power."""
    there = F.exists("magnifications", lambda m: F.abs(m - magnification) < TOLERANCE)
    at = lambda full: F.when(there, F.bround(col(full) * magnification / F.col("objective_power")).cast("int"))
    out = slides.join(available_magnifications(pages), "slide", "left").withColumns({"width": at("full_width"), "height": at("full_height")})
    if strict and (lost := out.where("width is null").select("slide", "magnifications").first()):
        raise ValueError(f"slide {lost[0]} has no magnification {magnification}; it has {lost[1] or []}")
    return out.select("slide", "width", "height")


def tile_planes(tiles: DataFrame, planes: DataFrame, by: list[str]) -> DataFrame:
    """A row for each tile and focal plane of its slide: ``tiles`` with z and page, ``nth`` counting z upwards from 0."""
    nth = F.row_number().over(Wd.partitionBy(*by).orderBy("z")) - 1
    return tiles.join(planes.select(*by, "z", "page").withColumn("nth", nth), by)


def read_planes(requests: DataFrame, planes: DataFrame, by: list[str]) -> DataFrame:
    """``by``, zs and stack of each tile asked for: its planes' pixels by rising z."""
    lists = planes.join(requests.select(*by).distinct(), by, "left_semi").groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("z", "px"))).alias("all"))
    return lists.select(*by, F.transform("all", lambda x: x["z"]).alias("zs"), F.transform("all", lambda x: x["px"]).alias("stack"))


def tile_jobs(tiles: DataFrame, prefix: str = "tile_") -> DataFrame:
    """path, stem and group of the tile groups of a store, once each, in order; other groups are left out."""
    return tiles.where(F.col("group").startswith(prefix)).select("path", "stem", "group").distinct().orderBy("path", "group")


def tile_at(tiles: DataFrame, name: str) -> DataFrame:
    """The tile ``stem/group``; no row if there is none. On a store partitioned by stem only that part is read."""
    stem, _, group = name.rpartition("/")
    return tiles.where((F.col("stem") == stem) & (F.col("group") == group))


def with_product(tiles: DataFrame, products: DataFrame, by: list[str]) -> DataFrame:
    """``tiles`` with what has been made of them; null where nothing has."""
    return tiles.join(products, by, "left")


def tile_counts(tiles: DataFrame, boxes: DataFrame, by: list[str], slide: str) -> tuple[DataFrame, DataFrame]:
    """Tiles with num_annotations (0 if none), and slides with num_tiles."""
    found = boxes.groupBy(*by).agg(F.count("*").alias("num_annotations"))
    return tiles.join(found, by, "left").na.fill(0, ["num_annotations"]), tiles.groupBy(slide).agg(F.count("*").alias("num_tiles"))


def max_planes(planes: DataFrame, by: list[str]) -> DataFrame:
    """The highest number of planes that any tile has (0 without tiles)."""
    return planes.groupBy(*by).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("max_planes"))


def seeded_order(key, seed: int) -> Column:
    """A hashed order that is the same on every run."""
    return F.md5(F.concat(col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in the hashed order of their key."""
    return rows.orderBy(seeded_order(key, seed), key).limit(n)


def pick_tile(tiles: DataFrame, key: str, seed: int, more_than: int = 2) -> DataFrame:
    """One tile with more than so many annotations, by hashed order."""
    return sample(tiles.where(F.col("num_annotations") > more_than), key, 1, seed)


def centre_crop(width, height, size: int) -> list[Column]:
    """x, y, w, h of the middle part of an image, at most ``size`` wide and high."""
    w, h = F.least(col(width), F.lit(size)), F.least(col(height), F.lit(size))
    return [F.floor((col(width) - w) / 2), F.floor((col(height) - h) / 2), w, h]


def head_and_tail(rows: DataFrame, order: list[Column], n: int = 50) -> DataFrame:
    """The first and the last n / 2 rows in order, all if there are no more than n; with their number from 1."""
    placed = numbered(rows, [], order, "nth", 1)
    total = rows.agg(F.count("*").alias("_n"))  # one row
    return placed.crossJoin(F.broadcast(total)).where((F.col("_n") <= n) | (F.col("nth") <= n // 2) | (F.col("nth") > F.col("_n") - n // 2)).drop("_n")


def physical_sizes(slides: DataFrame, key: str = "slide") -> DataFrame:
    """key, width_um and height_um, each axis by its own resolution; rows without positive resolutions are left out."""
    good = slides.where("mpp_x > 0 and mpp_y > 0")
    return good.select(key, (F.col("width") * F.col("mpp_x")).alias("width_um"), (F.col("height") * F.col("mpp_y")).alias("height_um"))


def dimensions(sizes: DataFrame, key: str = "slide") -> DataFrame:
    """key, dimension and value: widths and heights one under the other."""
    return sizes.unpivot([key], ["width_um", "height_um"], "dimension", "value").withColumn("dimension", F.initcap(F.regexp_replace("dimension", "_um$", "")))


def stain_group(status) -> Column:
    """``stained``, or ``not stained`` for its two spellings and whatever else is there; null stays null."""
    text = F.lower(F.trim(col(status)))
    return F.when(text == "stained", "stained").when(text.isNotNull(), "not stained")


def overlay(base: Column, override: Column) -> Column:
    """Entries of both maps; where both have a key, the second one's."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(override, k))
    return F.map_concat(kept, override)


def unused(candidates: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Candidates that have not been used; all of them once none are left."""
    left = candidates.join(used.select(key), key, "left_anti")
    some = left.limit(1).agg(F.count("*").alias("_some"))  # one row
    flagged = candidates.join(used.select(key).distinct().withColumn("_used", F.lit(True)), key, "left").crossJoin(F.broadcast(some))
    return flagged.where("_some = 0 or _used is null").select(*candidates.columns)
