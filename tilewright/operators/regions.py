"""Region reads from planes that are cut into chunks and stored along a Z-order curve.

A store is three Parquet tables: ``chunks`` (a row for each chunk of a plane, sorted by slide, magnification, code and
z over ranges), ``files`` (which codes of which slide each of its files holds) and ``pages`` (the planes' sizes). The
code of a chunk interleaves the bits of its column and row, so chunks that lie together share files. To read regions,
the chunks under them are looked up in ``files``, and only files that hold some are opened, where row group statistics
of the codes prune further. All planes of a place lie next to one another, as tiles are read through all z.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, StructType

from tilewright.plans.storage import BATCH_BYTES

#: Most rows of an Arrow batch of regions.
BATCH_ROWS = 10_000

_STEPS = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def z_order(column: Column, row: Column) -> Column:
    """The bits of both numbers (below 2^31) in turn, the column's lowest first."""

    def apart(c: Column) -> Column:
        out = c.cast("long")
        for shift, mask in _STEPS:
            out = (out.bitwiseOR(F.shiftleft(out, shift))).bitwiseAND(F.lit(mask))
        return out

    return apart(column).bitwiseOR(F.shiftleft(apart(row), 1))


def cut_planes(planes: DataFrame, cell: int) -> DataFrame:
    """Chunks of planes that are given whole (slide, magnification, z_nm, height, width, channels, data)."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                image = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["channels"])
                places = [(y, x) for y in range(0, r["height"], cell) for x in range(0, r["width"], cell)]
                cuts = [image[y : y + cell, x : x + cell] for y, x in places]
                same = {k: pa.array([r[k]] * len(cuts), batch.schema.field(k).type) for k in ("slide", "magnification", "z_nm")}
                size = {k: pa.array([v] * len(cuts), pa.int32()) for k, v in (("page_height", r["height"]), ("page_width", r["width"]), ("cell_height", cell), ("cell_width", cell))}
                own = {"cy": [y // cell for y, _ in places], "cx": [x // cell for _, x in places], "height": [len(c) for c in cuts], "width": [c.shape[1] for c in cuts], "channels": [r["channels"]] * len(cuts)}
                yield pa.RecordBatch.from_pydict(same | size | {k: pa.array(v, pa.int32()) for k, v in own.items()} | {"data": pa.array([c.tobytes() for c in cuts], pa.binary())})

    schema = planes.select("slide", "magnification", "z_nm").schema
    for name in ("page_height", "page_width", "cell_height", "cell_width", "cy", "cx", "height", "width", "channels"):
        schema = schema.add(name, "integer")
    return planes.select("slide", "magnification", "z_nm", "height", "width", "channels", "data").mapInArrow(run, schema.add("data", "binary"))


def write_store(chunks: DataFrame, path: str, partitions: int | None = None) -> None:
    """Store chunks as ``cut_planes`` or the ``chunks`` table of slides gives them; in so many files, or as Spark sizes
    partitions."""
    spark = chunks.sparkSession
    coded = chunks.withColumn("code", z_order(F.col("cx"), F.col("cy")))
    order = ["slide", "magnification", "code", "z_nm"]
    coded.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order).write.option("compression", "zstd").parquet(f"{path}/chunks")
    stored = spark.read.schema(coded.schema).parquet(f"{path}/chunks")
    held = stored.groupBy(F.col("_metadata.file_path").alias("file"), "slide", "magnification").agg(F.min("code").alias("first"), F.max("code").alias("last"), F.count("*").alias("chunks"))
    held.write.parquet(f"{path}/files")
    pages = stored.groupBy("slide", "magnification", "z_nm").agg(*[F.max(c).alias(c) for c in ("page_height", "page_width", "cell_height", "cell_width", "channels")])
    pages.write.parquet(f"{path}/pages")


def wanted_chunks(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """``regions`` (id, slide, magnification, x, y, w, h) for each plane of their slide and magnification, with the clamped
    corners x0, y0, x1, y1, and a row for each chunk (cy, cx, code) under them; one without where there is none."""
    r = regions.select("id", "slide", "magnification", *[F.col(c).cast("long").alias(c) for c in "xywh"])
    each = r.join(pages, ["slide", "magnification"])
    clamped = each.withColumns({"x0": F.greatest(F.lit(0), "x"), "y0": F.greatest(F.lit(0), "y"), "x1": F.least("page_width", F.col("x") + F.col("w")), "y1": F.least("page_height", F.col("y") + F.col("h"))})
    span = lambda a, b, cell: F.sequence(F.floor(F.col(a) / F.col(cell)).cast("int"), F.floor((F.col(b) - 1) / F.col(cell)).cast("int"))
    inside = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    rows = clamped.withColumn("cy", F.explode_outer(F.when(inside, span("y0", "y1", "cell_height"))))
    cells = rows.withColumn("cx", F.explode_outer(F.when(inside, span("x0", "x1", "cell_width"))))
    return cells.withColumn("code", z_order(F.col("cx"), F.col("cy")))


def touched_files(wanted: DataFrame, files: DataFrame) -> list[str]:
    """The files of a store that hold any of the wanted chunks; at most as many as the store has."""
    asked = wanted.where("code is not null").select("slide", "magnification", "code").distinct().alias("a")
    on = (F.col("a.slide") == F.col("f.slide")) & (F.col("a.magnification") == F.col("f.magnification")) & F.col("a.code").between(F.col("f.first"), F.col("f.last"))
    return sorted(r.file for r in files.alias("f").join(asked, on, "left_semi").select("file").distinct().collect())


#: What the pieces of a region's plane carry besides id and z_nm: the size of the whole, where the piece lies in it, and the
#: rows of a chunk with the first of its columns that is wanted.
_PIECE = ("full_height", "full_width", "top", "left", "rows", "cols", "skip", "width", "channels", "data")


def _pieces(spark: SparkSession, path: str, regions: DataFrame, pad: bool) -> DataFrame:
    """id, z_nm and ``_PIECE`` of the chunks under each region on each plane, cut to the rows that are wanted."""
    pages = spark.read.parquet(f"{path}/pages")
    shapes = pages.drop("z_nm").distinct()  # files hold all planes of a place
    files = touched_files(wanted_chunks(regions, shapes), spark.read.parquet(f"{path}/files"))
    keys = ["slide", "magnification", "z_nm", "code"]
    stored = spark.read.parquet(*files) if files else spark.read.parquet(f"{path}/chunks").limit(0)
    parts = wanted_chunks(regions, pages).join(stored.select(*keys, "height", "width", "data"), keys, "left")
    cut = F.lit(False) if pad else (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    origin = {c: F.when(cut, F.col(f"{c}0")).otherwise(F.col(c)) for c in "xy"}
    at = {c: F.col(f"c{c}") * F.col(f"cell_{side}") for c, side in (("x", "width"), ("y", "height"))}
    low = {c: F.greatest(f"{c}0", at[c]) for c in "xy"}
    long = {c: F.least(F.col(f"{c}1"), at[c] + F.col(side)) - low[c] for c, side in (("x", "width"), ("y", "height"))}
    line = F.col("width") * F.col("channels")
    places = {
        "full_height": F.when(cut, F.col("y1") - F.col("y0")).otherwise(F.col("h")), "full_width": F.when(cut, F.col("x1") - F.col("x0")).otherwise(F.col("w")),
        "top": low["y"] - origin["y"], "left": low["x"] - origin["x"], "rows": long["y"], "cols": long["x"], "skip": low["x"] - at["x"], "width": F.col("width"), "channels": F.col("channels"),
    }
    data = F.substr("data", ((low["y"] - at["y"]) * line + 1).cast("int"), (long["y"] * line).cast("int"))
    return parts.select("id", "z_nm", *[e.cast("int").alias(n) for n, e in places.items()], data.alias("data"))


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """id, z_nm and the image of each plane of each region from pieces that are sorted by both."""
    key = image = None
    for batch in batches:
        for n, z, height, width, top, left, rows, cols, skip, line, channels, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if image is None or key != (n, z):
                if image is not None:
                    yield *key, image
                key, image = (n, z), np.zeros((height, width, 3), np.uint8)
            if data is not None:
                image[top : top + rows, left : left + cols] = np.frombuffer(data, np.uint8).reshape(rows, line, channels)[:, skip : skip + cols]
    if image is not None:
        yield *key, image


def _assembled(pieces: DataFrame, by: list[str], schema: StructType, rows: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """``rows`` of the planes that are put together in each task. Pieces meet by ``by``, in the order of id and z_nm, so a task
    holds a batch of them and not a group at a time: regions are many and small."""
    made = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in rows(_put_together(batches)):
            held.append(row[1:])
            size += row[0]
            if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), made, strict=True)], schema=made)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), made, strict=True)], schema=made)

    return pieces.repartition(*by).sortWithinPartitions("id", "z_nm").select("id", "z_nm", *_PIECE).mapInArrow(run, schema)


def read_regions(spark: SparkSession, path: str, regions: DataFrame, pad: bool = False) -> DataFrame:
    """id, z_nm, height, width and data (RGB, one channel is repeated) of each region (id, slide, magnification, x, y, w,
    h) on each focal plane.

    A region is cut at the plane's borders; one that lies outside altogether, or any with ``pad``, has its full size, black
    where there is no plane. Chunks that the store lacks are black. Regions of unknown slides or magnifications have no
    rows. A region is put together in one task, so it should be a tile, not a slide."""
    pieces = _pieces(spark, path, regions, pad)
    schema = pieces.select("id", "z_nm").schema.add("height", "integer").add("width", "integer").add("data", "binary")
    return _assembled(pieces, ["id", "z_nm"], schema, lambda planes: ((i.nbytes, n, z, *i.shape[:2], i.tobytes()) for n, z, i in planes))


def read_stacks(spark: SparkSession, path: str, regions: DataFrame) -> DataFrame:
    """id, height, width, zs and planes (RGB, by rising z) of each region, padded to its full size."""
    pieces = _pieces(spark, path, regions, pad=True)
    schema = pieces.select("id").schema.add("height", "integer").add("width", "integer").add("zs", ArrayType(pieces.schema["z_nm"].dataType)).add("planes", ArrayType(BinaryType()))

    def stacks(planes: Iterator[tuple]) -> Iterator[tuple]:
        for n, own in groupby(planes, lambda p: p[0]):
            zs, images = zip(*[p[1:] for p in own], strict=True)
            yield sum(i.nbytes for i in images), n, *images[0].shape[:2], list(zs), [i.tobytes() for i in images]

    return _assembled(pieces, ["id"], schema, stacks)
