"""Queries through files: what is written as XML, JSON, CSV, image files or a stream is read back and compared.

Each run writes under a new name in the shared folder."""

from __future__ import annotations

import struct
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import detectors
from tilewright.operators import labels
from tilewright.operators.ordered import numbered
from tilewright.plans import views
from tilewright.plans.queries import BEST, OBJECTS, PLANES, _r6, query
from tilewright.plans.storage import materialize, remove, shared_dir, table
from tilewright.sources import documents, files, readers, writers
from tilewright.streaming import checkpoint


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tilewright-files-{uuid.uuid4().hex}"


def _boxes(spark, d) -> DataFrame:
    """Boxes with quarters, so that corners and centres are halves now and then."""
    o = views.objects(spark, d).selectExpr("slide", "o_orderkey", "x + (o_orderkey % 4) / 4D as x", "y + (o_orderkey % 3) / 4D as y", "w + (o_orderkey % 5) / 4D as w", "h + (o_orderkey % 7) / 4D as h", "label")
    return o.select("slide", "o_orderkey", "x", "y", "w", "h", F.concat("label", F.lit("/"), "o_orderkey").alias("label"), writers.details_text(F.lit("m"), F.col("w") / 100.0).alias("details"))


def _bytes(px: str):
    """Whole numbers of 0 to 255 as bytes."""
    return F.unhex(F.array_join(F.transform(px, lambda v: F.lpad(F.hex(v), 2, "0")), ""))


_ROUND = "round_even({0}, 0)::BIGINT"
MARKED = f"""boxes AS (SELECT slide, o_orderkey, x + o_orderkey % 4 / 4.0::DOUBLE AS x, y + o_orderkey % 3 / 4.0::DOUBLE AS y, w + o_orderkey % 5 / 4.0::DOUBLE AS w, h + o_orderkey % 7 / 4.0::DOUBLE AS h, label || '/' || o_orderkey AS label FROM objects),
corners AS (SELECT *, {_ROUND.format("x")} AS x1, {_ROUND.format("y")} AS y1, {_ROUND.format("(x + w)")} AS x2, {_ROUND.format("(y + h)")} AS y2, greatest(1, {_ROUND.format("(least(w, h) / 2)")}) AS r, printf('source=m; confidence=%.6f', w / 100) AS details FROM boxes),
marked AS (SELECT *, {_ROUND.format("((x1 + x2) / 2.0::DOUBLE)")} AS cx, {_ROUND.format("((y1 + y2) / 2.0::DOUBLE)")} AS cy FROM corners)"""


@query(f"WITH {OBJECTS}, {MARKED} SELECT slide, row_number() OVER (PARTITION BY slide ORDER BY x, y, w, h, label) AS ann_id, 'annotation' AS kind, label, cx - r AS x, cy - r AS y, 2 * r AS w, 2 * r AS h, round(w / 100, 6) AS confidence FROM marked")
def annotation_circles(spark, d):
    """A document for each slide."""
    path = _folder(spark)
    writers.annotation_xml(_boxes(spark, d), path, circles=True, by="slide", compression="gzip")
    read = readers.annotation_xml(spark, path)
    return read.select(F.col("slide").cast("long").alias("slide"), "ann_id", "kind", "label", "x", "y", "w", "h", labels.parse_confidence("details").alias("confidence"))


_FIRST = "marked WHERE o_orderkey % 3 > 0"


@query(f"""WITH {OBJECTS}, {MARKED}, n AS (SELECT slide, count(*) AS n FROM {_FIRST} GROUP BY slide),
views AS (SELECT slide, row_number() OVER (PARTITION BY slide ORDER BY x, y, w, h, label) AS id, true AS circle, * EXCLUDE (slide) FROM {_FIRST}
  UNION ALL SELECT slide, row_number() OVER (PARTITION BY slide ORDER BY x, y, w, h, label) + n, false, m.* EXCLUDE (slide) FROM marked m JOIN n USING (slide) WHERE o_orderkey % 3 = 0)
SELECT slide, id, label AS title, details, 'nanometers' AS coordformat, '20.000000' AS lens, cx AS x, cy AS y, 0::BIGINT AS z, 0 AS shown, CASE WHEN circle THEN '#ff0000' ELSE '#000000' END AS colour, CASE WHEN circle THEN 'AnnotateCircle' ELSE 'AnnotateRectangle' END AS displayname,
CASE WHEN circle THEN 'circle' ELSE 'freehand' END AS type, CASE WHEN circle THEN 0 ELSE 2 END AS measuretype, CASE WHEN circle THEN cx END AS circle_x, CASE WHEN circle THEN cy END AS circle_y, CASE WHEN circle THEN r END AS radius, CASE WHEN NOT circle THEN 1 END AS closed,
CASE WHEN NOT circle THEN 'rectangle' END AS specialtype, CASE WHEN NOT circle THEN concat_ws(' ', x1, y1, x1, y2, x2, y2, x2, y1) END AS points FROM views""")
def annotation_append(spark, d):
    """Circles, and rectangles appended to them; all fields of the documents are compared."""
    first, second, boxes = _folder(spark), _folder(spark), _boxes(spark, d)
    writers.annotation_xml(boxes.where("o_orderkey % 3 > 0"), first, circles=True, colour="#ff0000", lens=20.0, by="slide", compression="gzip")
    writers.annotation_xml(boxes.where("o_orderkey % 3 = 0"), second, circles=False, existing=readers.annotation_views(spark, first), lens=20.0, by="slide", compression="gzip")
    remove(spark, first)
    a = F.col("annotation")
    points = F.array_join(F.transform(a["pointlist"]["point"], lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), " ")
    return readers.annotation_views(spark, second).select(
        F.col("slide").cast("long").alias("slide"), F.col("_id").alias("id"), "title", "details", "coordformat", "lens", "x", "y", "z", (F.col("showtitle") + F.col("showhistogram") + F.col("showlineprofile")).alias("shown"), a["_color"].alias("colour"), a["_displayname"].alias("displayname"),
        a["_type"].alias("type"), a["measuretype"].alias("measuretype"), a["x"].alias("circle_x"), a["y"].alias("circle_y"), a["radius"].alias("radius"), a["closed"].alias("closed"), a["specialtype"].alias("specialtype"), points.alias("points"),
    )


@query(f"WITH {OBJECTS} SELECT 's' || slide AS file_name, count(*) AS n, round(sum(x + w), 6) AS far, sum(o_orderkey % 3)::BIGINT AS classes FROM objects GROUP BY slide")
def dataset_document(spark, d):
    o = views.objects(spark, d).withColumn("file_name", F.concat(F.lit("s"), "slide"))
    images = writers.coco_images(o.selectExpr("file_name", "2100 as width", "2100 as height"))
    boxes = writers.coco_annotations(images, writers.select_boxes(o.selectExpr("file_name", "o_orderkey as ann_idx", "cast(o_orderkey % 3 + 1 as int) as label", "x", "y", "w", "h"), False))
    path = _folder(spark)
    writers.coco_document(images, boxes, spark.sql("SELECT explode(sequence(0L, 2L)) AS id").selectExpr("id", "concat('c', id) as name", "'' as supercategory"), path)
    back_images, back_boxes, _ = readers.coco_lines(spark, path)
    flat = readers.coco_ground_truth(back_images, back_boxes).select("file_name", F.explode("boxes").alias("b"))
    return flat.groupBy("file_name").agg(F.count("*").alias("n"), F.round(F.sum("b.x2"), 6).alias("far"), F.sum("b.cls").alias("classes"))


@query(f"""WITH {OBJECTS} SELECT 'cell' AS class, round(w / 100.0::DOUBLE, 6) AS confidence, x::DOUBLE AS x_nm, y::DOUBLE AS y_nm, w::DOUBLE AS width_nm, h::DOUBLE AS height_nm, x AS x1_px, y AS y1_px, x + w AS x2_px, y + h AS y2_px FROM objects""")
def detections_csv(spark, d):
    o = views.objects(spark, d).selectExpr("w / 100D as score", "cast(x as double) as x_nm", "cast(y as double) as y_nm", "cast(w as double) as width_nm", "cast(h as double) as height_nm", "x1 as x1_px", "y1 as y1_px", "x2 as x2_px", "y2 as y2_px")
    path = _folder(spark)
    writers.detections_csv(o, path, "cell")
    return spark.read.csv(path, header=True, schema="class string, confidence double, x_nm double, y_nm double, width_nm double, height_nm double, x1_px long, y1_px long, x2_px long, y2_px long").withColumns(_r6("confidence"))


@query(f"""WITH {OBJECTS}, k AS (SELECT slide, row_number() OVER (ORDER BY md5(slide || ':67'), slide) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT slide FROM objects))
SELECT slide::VARCHAR AS stem, CASE WHEN k <= n - 2 * floor(n * 0.15::DOUBLE) THEN 'train' WHEN k <= n - floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM k""")
def split_file(spark, d):
    path = _folder(spark)
    documents.split_document(labels.assign_splits(views.objects(spark, d), "slide").select(F.col("slide").cast("string").alias("stem"), "split"), path)
    return readers.split_map(spark, path)


@query("SELECT p_type AS name, row_number() OVER (ORDER BY p_type)::INT AS id FROM (SELECT DISTINCT p_type FROM part)")
def label_map_file(spark, d):
    mapped = labels.label_map(table(spark, d, "part"), "p_partkey", "p_type", "p_partkey")
    path = _folder(spark)
    documents.metadata_document(mapped.select("category", F.col("label").cast("int").alias("label")), {"tile_size": 1024, "overlap": 0.25}, path)
    return documents.label_map(spark, path).select("name", "id")


@query("SELECT o_orderpriority AS class, o_orderstatus AS slide, count(*)::DOUBLE AS count FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY ALL")
def wide_counts_file(spark, d):
    o, path = table(spark, d, "orders"), _folder(spark)
    o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().write.csv(path, header=True)
    names = [r[0] for r in o.select("o_orderpriority").distinct().collect() if r[0] != "5-LOW"]  # the classes asked for
    return readers.category_matrix(spark, path, names).where("count is not null")


@query("SELECT n_name AS file_name, CASE n_nationkey % 3 WHEN 0 THEN 'stained' WHEN 1 THEN 'no stained' ELSE 'x' END AS stain_status FROM nation")
def stain_file(spark, d):
    path = _folder(spark)
    table(spark, d, "nation").selectExpr("n_name as name", "CASE n_nationkey % 3 WHEN 0 THEN ' Stained ' WHEN 1 THEN 'NO stained' ELSE 'x' END as status").write.csv(path, header=True)
    return readers.stain_table(spark, path)


@query("SELECT lower(n_name) AS name, r_name AS category, (SELECT count(DISTINCT r2.r_name) FROM region r2 WHERE r2.r_name < r.r_name)::INT AS label FROM nation JOIN region r ON n_regionkey = r_regionkey")
def specimen_file(spark, d):
    path = _folder(spark)
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))
    n.selectExpr("n_name as Specimen_name", "r_name as Category").write.csv(path, header=True)
    return labels.label_map(readers.specimen_categories(spark, path), "Specimen_name", "Category", "row_no").withColumn("label", F.col("label").cast("int"))


@query("SELECT c_custkey::INT AS epoch, (c_custkey % 97)::DOUBLE AS ap50 FROM customer ORDER BY c_custkey % 97 DESC, c_custkey LIMIT 1")
def training_csv_best(spark, d):
    path = _folder(spark)
    names = {"epoch": "c_custkey", "metrics/mAP50(B)": "c_custkey % 97", **{n: "0.5" for n in ("metrics/mAP50-95(B)", "metrics/precision(B)", "metrics/recall(B)", "train/box_loss", "train/cls_loss", "val/box_loss", "val/cls_loss")}}
    table(spark, d, "customer").select(*[F.expr(e).alias(n) for n, e in names.items()]).write.csv(path, header=True)
    return readers.best_epoch(readers.training_csv(spark, path), "ap50")


@query("SELECT c_custkey::INT AS epoch, (c_custkey % 89)::DOUBLE AS ap50 FROM customer ORDER BY c_custkey % 89 DESC, c_custkey LIMIT 1")
def training_jsonl_best(spark, d):
    path = _folder(spark)
    table(spark, d, "customer").selectExpr("c_custkey as epoch", "0.1 as train_loss", "array(0.5, cast(c_custkey % 89 as double)) as ema_test_coco_eval_bbox").write.json(path)
    return readers.best_epoch(readers.training_jsonl(spark, path), "ap50")


@query("SELECT CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey / 8.0::DOUBLE END AS score FROM nation")
def trial_files(spark, d):
    path = _folder(spark)
    rows = table(spark, d, "nation").repartition(25, "n_nationkey").withColumn("value", F.expr("CASE WHEN n_nationkey % 4 = 0 THEN '{bad' ELSE to_json(named_struct('map', n_nationkey / 8D)) END"))
    rows.select("value", F.col("n_nationkey").alias("trial")).write.partitionBy("trial").text(path)
    return readers.trial_scores(spark, f"{path}/*").select("score")


@query("SELECT 'img' || n_nationkey || '.png' AS name, (n_nationkey + 1)::BIGINT AS length FROM nation WHERE n_nationkey < 10 ORDER BY name LIMIT 6")
def image_listing(spark, d):
    folder = _folder(spark)
    images = table(spark, d, "nation").selectExpr("concat('img', n_nationkey, CASE WHEN n_nationkey < 10 THEN '.png' ELSE '.txt' END) as name", "cast(repeat('x', cast(n_nationkey + 1 as int)) as binary) as data")
    files.write_files(images, folder)
    found = readers.image_files(spark, folder, ("png",), 6)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


@query(f"""WITH {OBJECTS} SELECT slide, count(DISTINCT x * 10000 + y) AS n FROM objects GROUP BY slide""")
def tile_store_rewrite(spark, d):
    """A third of the slides are written again, another is new; positions that repeat are stored once."""
    path, o = _folder(spark), views.objects(spark, d).selectExpr("slide", "x", "y", "w")
    old = o.where("slide % 3 < 2")
    writers.tile_store(old.unionAll(old), path)
    writers.tile_store(o.where("slide % 3 > 0"), path)
    return spark.read.parquet(path).groupBy("slide").agg(F.count("*").alias("n")).select(F.col("slide").cast("long").alias("slide"), "n")


@query(f"""WITH {PLANES}, b AS (SELECT tile, z, px, unnest(range(4)) AS k FROM planes),
m AS (SELECT tile, z, k, list_sum([px[(k // 2 * 4 + i // 4) * 8 + (k % 2) * 4 + i % 4 + 1] FOR i IN range(16)]) / 16.0::DOUBLE AS mean FROM b)
SELECT tile, z, (k % 2 * 4)::DOUBLE AS x1, (k // 2 * 4)::DOUBLE AS y1, (k % 2 * 4 + 4)::DOUBLE AS x2, (k // 2 * 4 + 4)::DOUBLE AS y2, round(mean / 255, 6) AS score FROM m WHERE mean >= 130""")
def detector_boxes(spark, d):
    p = views.planes(spark, d)
    tiles = p.select("tile", "z", F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), _bytes("px").alias("data"))
    found = detectors.detect(tiles, "bright_blocks", ["tile", "z"], threshold=0.0, size=4, level=130.0)
    return found.select("tile", "z", "x1", "y1", "x2", "y2", F.round("score", 6).alias("score"))


@query(f"WITH {PLANES} SELECT printf('%05d', row_number() OVER (ORDER BY tile * 5 + z)) AS name, 3 AS height, 2 AS width, (px[10] + px[11] + px[18] + px[19] + px[26] + px[27])::BIGINT AS total FROM planes")
def detection_crops(spark, d):
    cut = _crops(spark, d)
    byte = lambda i: F.conv(F.substring(F.hex("data"), 2 * i + 1, 2), 16, 10).cast("long")
    return cut.select("name", "height", "width", sum((byte(i) for i in range(6)), F.lit(0)).alias("total"))


def _crops(spark, d) -> DataFrame:
    """The planes are the tiles of a slide for each z."""
    p = views.planes(spark, d)
    tiles = p.select(F.col("z").alias("slide"), "tile", F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), _bytes("px").alias("data"))
    boxes = p.selectExpr("z as slide", "tile", "tile * 5 + z as det_id", "1.5D as x1", "1.2D as y1", "2.5D as x2", "3.1D as y2")
    return writers.crops(boxes, tiles)


_LABELS = "anns AS (SELECT 's' || slide AS stem, o_orderkey, printf('%d %.6f %.6f %.6f %.6f', o_orderkey % 3, (x + w / 2) / 2100, (y + h / 2) / 2100, w / 2100, h / 2100) AS line FROM objects)"


@query(f"WITH {OBJECTS}, {_LABELS} SELECT 'labels/' || stem || '.txt' AS name, string_agg(line, chr(10) ORDER BY o_orderkey) AS text, 1::BIGINT AS written FROM anns GROUP BY stem")
def label_files(spark, d):
    """A file for each image; half of them are written first, and what is there is not written again."""
    path, o = _folder(spark), views.objects(spark, d)
    boxes = o.selectExpr("concat('s', slide, '.jpg') as file_name", "o_orderkey as ann_idx", "cast(o_orderkey % 3 + 1 as int) as label", "x", "y", "w", "h")
    images = writers.coco_images(boxes.selectExpr("file_name", "2100 as width", "2100 as height"))
    rows = files.label_files(writers.label_lines(images, writers.coco_annotations(images, writers.select_boxes(boxes, False))))
    files.write_files(rows.where("crc32(cast(name as binary)) % 2 = 0"), path)
    files.write_files(rows, path)
    read = spark.read.text(f"{path}/labels", wholetext=True).select(F.concat(F.lit("labels/"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).alias("name"), F.col("value").alias("text"))
    listed = files.manifest(spark, path).groupBy("name").agg(F.count("*").alias("written"))
    return read.join(listed, "name").select("name", "text", "written")


@query(f"WITH {PLANES} SELECT printf('crops/%05d.png', row_number() OVER (ORDER BY tile * 5 + z)) AS name, 3 AS height, 2 AS width, (px[10] + px[11] + px[18] + px[19] + px[26] + px[27])::BIGINT AS total FROM planes")
def crop_files(spark, d):
    """Crops as PNG files, read back."""
    import numpy as np
    import pyarrow as pa

    path = _folder(spark)
    cut = _crops(spark, d)
    files.write_files(files.as_png(cut, F.concat(F.lit("crops/"), "name", F.lit(".png"))), path)

    def run(batches):
        for batch in batches:
            rows = []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                width, height = struct.unpack(">II", raw[16:24])
                size = struct.unpack(">I", raw[33:37])[0]
                pixels = np.frombuffer(zlib.decompress(raw[41 : 41 + size]), np.uint8).reshape(height, width + 1)
                rows.append({"name": name, "height": height, "width": width, "total": int(pixels[:, 1:].sum())})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("name", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("total", pa.int64())]))

    read = spark.read.format("binaryFile").load(f"{path}/crops").select(F.concat(F.lit("crops/"), F.element_at(F.split("path", "/"), -1)).alias("name"), "content")
    return read.mapInArrow(run, "name string, height int, width int, total long")


@query(f"WITH RECURSIVE {BEST} SELECT det_id, round(score, 6) AS score FROM kept")
def streamed_detections(spark, d):
    """Detections arrive as a stream, are appended batch by batch, and are replaced by the best ones at the end."""
    raw = materialize(views.detections(spark, d))
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 2).parquet(raw._tilewright_path)
    appended, state, final = _folder(spark), _folder(spark), _folder(spark)
    checkpoint.append_detections(stream, lambda batch: batch, appended, state).awaitTermination()
    checkpoint.finish(spark.read.parquet(appended), final)
    return spark.read.parquet(final).select("det_id", F.round("score", 6).alias("score"))


@query("SELECT 'c' || c_custkey AS stem, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'paired' ELSE 'skipped' END AS state FROM customer")
def file_pairs(spark, d):
    """Slides with an annotation file of the same stem, and those without."""
    slides = table(spark, d, "customer").selectExpr("concat('c', c_custkey) as stem")
    pairs, skipped = readers.pair_by_stem(slides, table(spark, d, "orders").selectExpr("concat('c', o_custkey) as stem").distinct())
    return pairs.select("stem", F.lit("paired").alias("state")).unionByName(skipped.select("stem", F.lit("skipped").alias("state")))


@query(f"WITH {OBJECTS} SELECT count(*) AS boxes, count(DISTINCT slide) AS slides, sum(w * h)::BIGINT AS area FROM objects")
def metrics_file(spark, d):
    path = _folder(spark)
    documents.metrics_document(views.objects(spark, d).agg(F.count("*").alias("boxes"), F.countDistinct("slide").alias("slides"), F.sum(F.col("w") * F.col("h")).alias("area")), path)
    return spark.read.schema("boxes bigint, slides bigint, area bigint").json(path)


@query("SELECT c_custkey AS trial, c_acctbal::DOUBLE AS score, 'p' || c_custkey AS p, c_custkey = (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1) AS best FROM customer")
def trial_log(spark, d):
    """Trials as lines, and the parameters of the best one in a document of their own."""
    path = _folder(spark)
    trials = table(spark, d, "customer").select(F.col("c_custkey").alias("trial"), F.col("c_acctbal").cast("double").alias("score"), F.create_map(F.lit("p"), F.concat(F.lit("p"), "c_custkey")).alias("params"))
    documents.trial_documents(trials, path)
    best = spark.read.schema("p string").json(f"{path}/best").select(F.col("p").alias("best_p"))  # one row
    read = spark.read.schema("trial bigint, score double, params map<string,string>").json(f"{path}/trials").select("trial", "score", F.col("params")["p"].alias("p"))
    return read.crossJoin(F.broadcast(best)).select("trial", "score", "p", (F.col("p") == F.col("best_p")).alias("best"))


@query("SELECT row_number() OVER (ORDER BY p_type) - 1 AS id, p_type AS name FROM (SELECT DISTINCT p_type FROM part)")
def class_names_file(spark, d):
    """Names of the categories from the first dataset document that is there, written as one file."""
    path = _folder(spark)
    types = numbered(table(spark, d, "part").selectExpr("p_type as name").distinct(), [], [F.col("name")], "id").select("id", "name", F.lit("").alias("supercategory"))
    o = views.objects(spark, d).selectExpr("concat('s', slide) as file_name", "o_orderkey as ann_idx", "1 as label", "x", "y", "w", "h")
    images = writers.coco_images(o.selectExpr("file_name", "2100 as width", "2100 as height"))
    writers.coco_document(images, writers.coco_annotations(images, writers.select_boxes(o, True)), types, f"{path}/parts")
    writers.join_document(spark, f"{path}/parts", f"{path}/valid.json")
    names = documents.class_names(spark, [f"{path}/train.json", f"{path}/valid.json"])
    return spark.createDataFrame(list(enumerate(names)), "id bigint, name string")
