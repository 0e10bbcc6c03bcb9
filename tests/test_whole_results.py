"""Results stay whole where groups are empty, and where they are larger than one task goes through."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tilewright.operators import labels, matching, ordered, spatial, turns
from tilewright.plans import file_queries
from tilewright.plans.queries import QUERIES
from tilewright.sources import documents, readers, writers


def orders(spark, folder, rows):
    """A table of orders from (o_orderkey, o_custkey)."""
    spark.createDataFrame([(k, c, "1-URGENT") for k, c in rows], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


@pytest.mark.parametrize("keys", [[(0, 0)], [(0, 0), (500, 3)]])
def test_slides_without_misses_are_counted(spark, tmp_path, keys):
    got = QUERIES["match_fp_fn"](spark, orders(spark, tmp_path, keys)).collect()
    assert sorted((r.slide, r.fp, r.fn, r.tp) for r in got) == [(k // 500, 0, 0, 1) for k, _ in keys]


@pytest.mark.parametrize("finish", [7, 40])
def test_large_groups_are_settled_in_turn(spark, monkeypatch, finish):
    """Groups above the bound, groups below it, and a chooser that alone has more options than it."""
    monkeypatch.setattr(turns, "FINISH", finish)
    rng = random.Random(finish)
    options = [(g, c, 100 * g - c, i, rng.random()) for g, n in ((0, 30), (1, 3), (2, 12)) for c in range(n) for i in rng.sample(range(12), 12 if c == n - 1 else rng.randrange(1, 6))]
    used, want = set(), set()
    for g, c in sorted({(g, c) for g, c, *_ in options}, key=lambda k: (k[0], -k[1])):
        free = [(-liking, i) for h, k, _, i, liking in options if (h, k) == (g, c) and (g, i) not in used]
        if free:
            used.add((g, min(free)[1]))
            want.add((g, c, min(free)[1]))
    frame = spark.createDataFrame(options, "g long, c long, t long, i long, liking double")
    got = turns.settle(frame, ["g"], "c", "t", "i", [F.desc("liking")]).collect()
    assert {(r.g, r.c, r.i) for r in got} == want and len(got) == len(want)


def test_names_beyond_the_first_bound(spark, monkeypatch):
    """Equal names ask more often than they have candidates, and most pairs are formed after the first turns."""
    monkeypatch.setattr(turns, "FINISH", 5)
    formed = []
    real = turns.settle
    monkeypatch.setattr(turns, "settle", lambda options, *a: formed.append(options.count()) or real(options, *a))
    names = [(i, ("red oak", "red oak b", "elm x", "old red oak")[i % 4]) for i in range(40)]
    pool = [("red oak 1",), ("red oak 2",), ("elm x",), ("old oak red",), ("fir y",)]
    got = {r.o: r.match for r in labels.match_in_order(spark.createDataFrame(names, "o long, n string"), spark.createDataFrame(pool, "c string"), "n", "c", "o").collect()}
    assert [got[i] for i in range(6)] == ["red oak 1", "old oak red", "elm x", "red oak 2", None, None] and not any(got[i] for i in range(6, 40))
    assert sum(formed) <= 20  # of 100


def test_a_stored_slide_is_one_file(spark, tmp_path):
    tiles = spark.range(4000).selectExpr("id % 50 as slide", "id as x", "id % 9 as y").repartition(4)
    writers.tile_store(tiles.unionAll(tiles), str(tmp_path))
    found = spark.read.parquet(str(tmp_path)).groupBy("slide").agg(F.count("*").alias("n"), F.countDistinct(F.col("_metadata.file_path")).alias("files")).collect()
    assert len(found) == 50 and all(r.n == 80 for r in found)
    assert sum(r.files for r in found) <= 50 + 4  # a slide more where a range ends


def test_class_names_are_read_in_splits(spark, tmp_path, monkeypatch):
    categories = spark.createDataFrame([(1, "b", ""), (0, "a", "")], "id long, name string, supercategory string")
    images = spark.createDataFrame([(0, "i.jpg", 5, 5)], "id long, file_name string, width int, height int")
    boxes = spark.createDataFrame([(0, 0, 1, 1, 1, 2, 2, 4, 0)], "id long, image_id long, category_id int, x int, y int, w int, h int, area int, iscrowd int")
    writers.coco_document(images, boxes, categories, f"{tmp_path}/parts")
    writers.join_document(spark, f"{tmp_path}/parts", f"{tmp_path}/all.json")
    (tmp_path / "other.json").write_text('{"images": [],\n "categories": [{"id": 4,\n "name": "z"}]}')
    assert documents.class_names(spark, [f"{tmp_path}/other.json"]) == ["z"]
    monkeypatch.setattr("pyspark.sql.DataFrameReader.json", None)  # which reads a document in one task
    assert documents.class_names(spark, [f"{tmp_path}/all.json"]) == ["a", "b"]


def test_recalls_at_the_ticks(spark):
    """Every k / 100 and the numbers beside it reach as many recalls as a comparison with each says."""
    recalls = [r for k in range(101) for r in (math.nextafter(k / 100, -1), k / 100, math.nextafter(k / 100, 2))]
    frame = spark.createDataFrame([(i, r, 1.0) for i, r in enumerate(recalls)], "slide long, recall double, precision double")
    got = {r.slide: r.ap for r in matching.ap_101(frame).collect()}
    assert [round(got[i] * 101) for i in range(len(recalls))] == [sum(k / 100.0 <= r for k in range(101)) for r in recalls]


def test_sides_of_a_self_join_are_one_shuffle(spark, tmp_path):
    boxes = spark.range(200).selectExpr("id % 3 as slide", "id % 4 as tile", "id as det_id", "double(id % 50) as x1", "double(id % 40) as y1", "double(id % 50 + 20) as x2", "double(id % 40 + 20) as y2")
    boxes.write.parquet(f"{tmp_path}/b")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spatial.dedup_edges(spark.read.parquet(f"{tmp_path}/b"), 0.5)
        edges.collect()
        assert "ReusedExchange" in edges._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_running_sums_join_nothing(spark):
    rows = spark.range(300).selectExpr("if(id % 3 = 0, null, id % 3) as g", "id")
    sums = ordered.running_sums(rows, ["g"], [F.col("id")], {"s": F.col("id")})
    assert "Join" not in sums._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id: r.s for r in sums.collect()} == {i: sum(range(i % 3, i + 1, 3)) for i in range(300)}


def test_appended_documents_take_little_disk(spark, tmp_path, monkeypatch):
    """Of both sets of documents only the whole one stays, packed, and no step writes its rows beside them."""
    folders = []
    monkeypatch.setattr(file_queries, "_folder", lambda _: folders.append(tmp_path / f"f{len(folders)}") or str(folders[-1]))
    monkeypatch.setattr(ordered, "materialize", None)
    got = QUERIES["annotation_append"](spark, orders(spark, tmp_path, [(k, 7 * k) for k in range(1500)]))
    assert got.count() == 1500 and len(folders) == 2 and not folders[0].exists()
    files = list(folders[1].glob("slide=*/part-*"))
    assert len(files) == 3 and sum(f.stat().st_size for f in files) < 60 * 1500


@pytest.mark.parametrize("codec", ["none", "gzip"])
def test_appended_documents_are_whole(spark, tmp_path, codec):
    """Documents without new boxes, new documents, a view without an id, fields that the writer does not know."""
    old = [(1, 9, "t", "kept"), (1, None, "u", None), (2, 4, "v", None)]
    existing = spark.createDataFrame(old, "slide int, _id long, title string, remark string")
    existing = existing.withColumn("annotation", F.lit(None).cast(spark.createDataFrame([], readers.VIEW_SCHEMA).schema["annotation"].dataType))
    boxes = spark.createDataFrame([(s, float(x), 1.0, 4.0, 4.0, f"n{x}", "d") for s in (1, 3) for x in (20, 3, 100)], "slide long, x double, y double, w double, h double, label string, details string")
    writers.annotation_xml(boxes, f"{tmp_path}/a", True, existing, by="slide", compression=codec)
    views = spark.read.format("xml").option("rowTag", "ndpviewstate").schema(f"{readers.VIEW_SCHEMA}, remark string").load(f"{tmp_path}/a").withColumn("file", F.col("_metadata.file_path")).collect()
    found = {s: [(v["_id"], v.title, v.remark) for v in views if v.slide == s] for s in (1, 2, 3)}
    assert found == {1: [(None, "u", None), (9, "t", "kept"), (10, "n3", None), (11, "n20", None), (12, "n100", None)], 2: [(4, "v", None)], 3: [(1, "n3", None), (2, "n20", None), (3, "n100", None)]}
    assert len({v.file for v in views}) == 3 and all(v.file.endswith(".gz") == (codec == "gzip") for v in views)
    writers.annotation_xml(boxes, f"{tmp_path}/one", True, compression=codec)
    assert {r.slide.endswith((".xml", ".gz")) for r in readers.annotation_xml(spark, f"{tmp_path}/one").collect()} == {False}
