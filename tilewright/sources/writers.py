"""Writers: tile store, dataset documents, label files, detections as CSV and XML."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from tilewright.functions.geometry import box_to_circle, rounded_corners, to_normalised
from tilewright.operators.ordered import numbered
from tilewright.plans.storage import release


def tile_store(tiles: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tiles by slide; a rewrite replaces only the slides that it holds. Tiles at the same place are stored once.

    Ranges of slides and places are dealt to tasks, so a slide is a file, or a few if it is large, however many tasks write."""
    place = ["slide", "x", "y", *(["z"] if "z" in tiles.columns else [])]
    unique = tiles.repartitionByRange(*place).dropDuplicates(place)  # no further shuffle
    unique.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("slide").parquet(path)


def select_boxes(boxes: DataFrame, single_class: bool, label_base: int = 1) -> DataFrame:
    """category_id from label: 0 for a single class, else less its base."""
    return boxes.withColumn("category_id", F.lit(0) if single_class else F.col("label") - label_base)


def image_name(stem, group, z, ext: str = "jpg") -> Column:
    return F.concat(F.format_string("%s_%s_z%02d", stem, group, z), F.lit(f".{ext}"))


def coco_images(records: DataFrame) -> DataFrame:
    """id (dense from 0 in the order of names), file_name, width, height."""
    return numbered(records.select("file_name", "width", "height").distinct(), [], [F.col("file_name")], "id").select("id", "file_name", "width", "height")


def coco_annotations(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """id (dense from 0), image_id, category_id, x, y, w, h, area and iscrowd."""
    joined = boxes.join(images.select(F.col("id").alias("image_id"), "file_name"), "file_name")
    ids = numbered(joined, [], [F.col("file_name"), F.col("ann_idx")], "id")
    return ids.select("id", "image_id", "category_id", "x", "y", "w", "h", (F.col("w") * F.col("h")).alias("area"), F.lit(0).alias("iscrowd"))


def coco_document(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str) -> None:
    """One JSON object, in part files of ``path`` that make the document when they are read one after another.

    Each list is written as lines, dealt to ranges of ids, so neither a row nor a task holds a whole list; a line has one
    element and the comma before it, and the brackets are lines of their own. ``readers.coco`` reads such folders, and
    ``join_document`` makes one file of the parts."""
    packed = annotations.select("id", "image_id", "category_id", F.array("x", "y", "w", "h").cast("array<double>").alias("bbox"), "area", "iscrowd")
    lines = None
    for k, (name, rows) in enumerate((("images", images), ("annotations", packed), ("categories", categories))):
        first = F.col("id") == rows.agg(F.min("id").alias("m")).first().m
        element = F.concat(F.when(first, F.lit("")).otherwise(F.lit(",")), F.to_json(F.struct(*rows.columns)))
        own = rows.select(F.lit(2 * k + 1).alias("part"), F.col("id").cast("long").alias("id"), element.alias("value"))
        edge = rows.sparkSession.range(1).select(F.lit(2 * k).alias("part"), F.lit(0).cast("long").alias("id"), F.lit(("{" if k == 0 else "],") + f'"{name}":[').alias("value"))
        lines = edge.unionByName(own) if lines is None else lines.unionByName(edge).unionByName(own)
    end = images.sparkSession.range(1).select(F.lit(6).alias("part"), F.lit(0).cast("long").alias("id"), F.lit("]}").alias("value"))
    lines.unionByName(end).repartitionByRange("part", "id").sortWithinPartitions("part", "id").select("value").write.mode("overwrite").text(path)


def join_document(spark: SparkSession, parts: str, path: str) -> None:
    """One file from the part files of a folder, in order, under a temporary name that is changed at the end.

    The driver copies streams; it holds no part."""
    jvm, conf = spark.sparkContext._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    source, target = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(path)
    files, out_files = source.getFileSystem(conf), target.getFileSystem(conf)
    held = jvm.org.apache.hadoop.fs.Path(f"{path}._tmp")
    out = out_files.create(held, True)
    try:
        for name in sorted(s.getPath().toString() for s in files.listStatus(source) if s.getPath().getName().startswith("part-")):
            into = files.open(jvm.org.apache.hadoop.fs.Path(name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(into, out, 1 << 16, False)
            finally:
                into.close()
    finally:
        out.close()
    out_files.delete(target, False)
    out_files.rename(held, target)


def label_lines(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """file_name and its label text: a line ``cls cx cy w h`` for each box, empty for images without boxes."""
    ranks = annotations.select("category_id").distinct().withColumn("cls", F.dense_rank().over(Wd.orderBy("category_id")) - 1)
    sized = annotations.join(ranks, "category_id").join(images.select(F.col("id").alias("image_id"), "width", "height"), "image_id")
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "cls", *to_normalised("x", "y", "w", "h", "width", "height"))
    texts = sized.select("image_id", "id", line.alias("line")).groupBy("image_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "line"))), lambda s: s["line"]), "\n").alias("text"))
    return images.join(texts, images["id"] == texts["image_id"], "left").select("file_name", F.coalesce("text", F.lit("")).alias("text"))


def detections_csv(detections: DataFrame, path: str, cls: str) -> None:
    columns = ["x_nm", "y_nm", "width_nm", "height_nm", "x1_px", "y1_px", "x2_px", "y2_px"]
    detections.select(F.lit(cls).alias("class"), F.col("score").alias("confidence"), *columns).write.mode("overwrite").csv(path, header=True)


def details_text(source, confidence) -> Column:
    return F.format_string("source=%s; confidence=%.6f", source, confidence)


#: What a view is made from.
_BOX = ("x", "y", "w", "h", "label", "details")


def annotation_xml(boxes: DataFrame, path: str, circles: bool, existing: DataFrame | None = None, colour: str = "#000000", lens: float = 1.0, by: str | None = None, compression: str = "none") -> None:
    """Views for x, y, w, h (nm), label and details as rectangles or circles, numbered from 1 on or, with ``existing``
    (a document as ``annotation_views`` reads it), from one past its highest id on; its views are written too.

    With ``by`` there is a document for each of its values, in a folder named after it, with numbers of its own, and each
    is written by one task, which also numbers it; without, there is one document. Documents are plain text, or packed
    where ``compression`` names a codec (gzip makes them about 15 times smaller, and the readers take them as they are)."""
    at = "_box." if by else ""
    x, y, w, h, label, details = [f"{at}{c}" for c in _BOX]
    cx, cy, radius = box_to_circle(x, y, w, h)
    x1, y1, x2, y2 = rounded_corners(x, y, w, h)
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    points = F.struct(F.array(corner(x1, y1), corner(x1, y2), corner(x2, y2), corner(x2, y1)).alias("point"))
    none = lambda kind: F.lit(None).cast(kind)
    named = ("circle", "AnnotateCircle", 0) if circles else ("freehand", "AnnotateRectangle", 2)
    common = [F.lit(colour).alias("_color"), F.lit(named[1]).alias("_displayname"), F.lit(named[0]).alias("_type"), F.lit(named[2]).alias("measuretype")]
    if circles:
        parts = [cx.alias("x"), cy.alias("y"), radius.alias("radius"), none("int").alias("closed"), none("string").alias("specialtype"), none("struct<point:array<struct<x:bigint,y:bigint>>>").alias("pointlist")]
    else:
        parts = [none("bigint").alias("x"), none("bigint").alias("y"), none("bigint").alias("radius"), F.lit(1).alias("closed"), F.lit("rectangle").alias("specialtype"), points.alias("pointlist")]
    view = {
        "title": F.col(label), "details": F.col(details), "coordformat": F.lit("nanometers"), "lens": F.format_string("%.6f", F.lit(float(lens))), "x": cx, "y": cy, "z": F.lit(0),
        "showtitle": F.lit(0), "showhistogram": F.lit(0), "showlineprofile": F.lit(0), "annotation": F.struct(*common, *parts),
    }
    if by:
        dealt = _documents(boxes, existing, by, view)
    else:
        rows = numbered(boxes, [], [F.col(c) for c in _BOX[:5]], "_nth", 1)
        new = rows.select((F.col("_nth") + F.lit(next_id(existing) - 1 if existing is not None else 0)).alias("_id"), *[v.alias(c) for c, v in view.items()])
        dealt = (new if existing is None else existing.unionByName(new, allowMissingColumns=True)).coalesce(1)
    writer = dealt.write.mode("overwrite").format("xml").option("rootTag", "annotations").option("rowTag", "ndpviewstate").option("indent", "\t").option("compression", compression)
    (writer.partitionBy(by) if by else writer).save(path)
    release(boxes.sparkSession)


def _documents(boxes: DataFrame, existing: DataFrame | None, by: str, view: dict[str, Column]) -> DataFrame:
    """The views of every document in the order of their ids, a document in one task; ``view`` makes one from ``_box``.

    Only boxes and existing views are shuffled, once: new views are numbered and made where their document is written."""
    rows = boxes.select(by, F.struct(*_BOX).alias("_box"))
    tasks = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # adaptive plans would leave a few large tasks
    order = [F.col(f"_box.{c}") for c in _BOX[:5]]
    if existing is None:
        made = rows.repartition(tasks, by).withColumn("_id", F.row_number().over(Wd.partitionBy(by).orderBy(*order)).cast("long"))
        return made.select(by, "_id", *[v.alias(c) for c, v in view.items()])
    old = [c for c in existing.columns if c != by]
    both = existing.select(by, F.struct(*old).alias("_view")).unionByName(rows, allowMissingColumns=True)
    so_far = Wd.partitionBy(by).orderBy(F.col("_box").isNotNull(), "_view._id", *order).rowsBetween(Wd.unboundedPreceding, Wd.currentRow)  # existing views come first
    nth, last = F.row_number().over(so_far) - F.count("_view").over(so_far), F.greatest(F.lit(0), F.max("_view._id").over(so_far))
    made = {"_id": F.col("_nth") + F.col("_last"), **view}
    either = lambda c: F.when(F.col("_box").isNotNull(), made.get(c)).otherwise(F.col("_view")[c] if c in old else None)
    return both.repartition(tasks, by).withColumns({"_nth": nth, "_last": last}).select(by, *[either(c).alias(c) for c in (*old, *(c for c in made if c not in old))])


def next_id(views: DataFrame) -> int:
    """One past the highest id; 1 for a document without views."""
    return int(views.agg(F.coalesce(F.max("_id"), F.lit(0)).alias("m")).first().m) + 1


def crops(detections: DataFrame, tiles: DataFrame, key: str = "det_id") -> DataFrame:
    """name, height, width, channels and data of each detection's cut (x1..y2 within its tile), one pixel at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            out = {"name": [], "height": [], "width": [], "channels": [], "data": []}
            for r in batch.to_pylist():
                image = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["channels"])
                x, y = max(0, int(np.floor(r["x1"]))), max(0, int(np.floor(r["y1"])))
                cut = image[y : max(y + 1, int(np.ceil(r["y2"]))), x : max(x + 1, int(np.ceil(r["x2"])))]
                for k, v in zip(out, (r["name"], *cut.shape, cut.tobytes()), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)})

    named = numbered(detections, [], [F.col(key)], "_nth", 1).withColumn("name", F.format_string("%05d", F.col("_nth")))
    joined = named.join(tiles.select("slide", "tile", "height", "width", "channels", "data"), ["slide", "tile"])
    return joined.select("name", "x1", "y1", "x2", "y2", "height", "width", "channels", "data").mapInArrow(run, "name string, height int, width int, channels int, data binary")
