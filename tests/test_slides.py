"""Slide files of every layout, pushed filters, and region reads against numpy slices."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import regions as R
from tilewright.sources import slides as S


def container(pages, layout="classic", order="<", tiled=False, compress=False):
    """Bytes of a file with strips of 4 rows or tiles of 16 pixels; directories after their pixels."""
    big, wide = layout == "big", layout == "variant"
    head = {"<": b"II", ">": b"MM"}[order]
    out = bytearray(head + (struct.pack(order + "HHH", 43, 8, 0) + bytes(8) if big else struct.pack(order + "H", 42) + bytes(8 if wide else 4)))
    link = 8 if big else 4
    for image, magnification, z in pages:
        h, w, c = image.shape
        if tiled:
            padded = np.zeros((-(-h // 16) * 16, -(-w // 16) * 16, c), np.uint8)
            padded[:h, :w] = image
            cells = [padded[y : y + 16, x : x + 16].tobytes() for y in range(0, h, 16) for x in range(0, w, 16)]
        else:
            cells = [image[y : y + 4].tobytes() for y in range(0, h, 4)]
        at = []
        for cell in cells:
            at.append(len(out))
            out += zlib.compress(cell) if compress else cell
        sizes = [b - a for a, b in zip(at, [*at[1:], len(out)], strict=True)]
        tags = {256: ("I", 4, [w]), 257: ("I", 4, [h]), 259: ("H", 3, [8 if compress else 1]), 277: ("H", 3, [c])}
        tags |= {322: ("I", 4, [16]), 323: ("I", 4, [16]), 324: ("I", 4, at), 325: ("I", 4, sizes)} if tiled else {273: ("I", 4, at), 278: ("I", 4, [4]), 279: ("I", 4, sizes)}
        tags |= {282: ("I", 5, [20000, 1]), 296: ("H", 3, [3])}
        tags |= {65420: ("I", 4, [1])} if wide else {}
        tags |= {65421: ("f", 11, [magnification])} if magnification is not None else {}
        tags |= {65424: ("i", 9, [z])} if z is not None else {}
        entries, high = b"", b""
        for tag in sorted(tags):
            code, kind, values = tags[tag]
            raw = struct.pack(f"{order}{len(values)}{code}", *values)
            count = 1 if kind == 5 else len(values)
            field = 8 if big else 4
            if len(raw) > field:
                place = len(out)
                out += raw
                raw = struct.pack(order + ("Q" if big else "I"), place)
            entries += struct.pack(order + "HH" + ("Q" if big else "I"), tag, kind, count) + raw.ljust(field, b"\0")
            high += bytes(4)
        place = len(out)
        out[link : link + (8 if big or wide else 4)] = struct.pack(order + ("Q" if big or wide else "I"), place)
        out += struct.pack(order + ("Q" if big else "H"), len(tags)) + entries
        link = len(out)
        out += bytes(8 if big or wide else 4) + (high if wide else b"")
    return bytes(out), link


def images(seed=1):
    rng = np.random.default_rng(seed)
    return [(rng.integers(0, 256, (h, w, c), np.uint8), m, z) for h, w, c, m, z in ((37, 50, 3, 40.0, -500), (37, 50, 3, 40.0, 500), (18, 25, 1, 20.0, -500), (5, 6, 3, -1.0, 0), (5, 6, 3, 20.0, None), (5, 6, 3, None, 3))]


def rebuilt(rows, page):
    own = [r for r in rows if r.page == page]
    out = np.zeros((own[0].page_height, own[0].page_width, own[0].channels), np.uint8)
    for r in own:
        y, x = r.cy * r.cell_height, r.cx * r.cell_width
        out[y : y + r.height, x : x + r.width] = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
    return out


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("layout", ["classic", "big", "variant"])
@pytest.mark.parametrize(("tiled", "compress"), [(False, False), (True, True)])
def test_layouts(spark, tmp_path, layout, order, tiled, compress):
    raw, _ = container(images(), layout, order, tiled, compress)
    (tmp_path / "one.ndpi").write_bytes(raw)
    planes = S.slide_table(spark, str(tmp_path)).orderBy("page").collect()
    assert [(r.slide, r.page, r.magnification, r.z_nm, r.height, r.width, r.channels) for r in planes] == [("one", k, m, z, *i.shape) for k, (i, m, z) in enumerate(images()[:3])]
    head = S.slide_table(spark, f"file://{tmp_path}", "slides").first()
    assert (head.mpp_x, head.mpp_y, head.objective_power, head.x_offset_nm, head.full_width, head.full_height) == (0.5, 0.0, 40.0, 0, 50, 37)
    rows = S.slide_table(spark, str(tmp_path), "chunks").collect()
    for k, (image, _, _) in enumerate(images()[:3]):
        assert (rebuilt(rows, k) == image).all()


def test_pushed_filters(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.tif").write_bytes(container(images())[0])
    (tmp_path / "notes.txt").write_text("no slide")
    planes = S.slide_table(spark, str(tmp_path), glob="*.tif")
    few = planes.where("slide = 'b' and magnification >= 30 and z_nm in (500, 7) and width > 3")
    assert [(r.slide, r.page) for r in few.collect()] == [("b", 1)]
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "magnification" not in plan.split("BatchScan")[0].replace("magnification#", "") and "Filter" in plan  # width alone is left to Spark
    reader = S.SlideReader({"path": str(tmp_path), "pathglob": "*.tif"}, "planes")
    assert [type(f).__name__ for f in reader.pushFilters([S.EqualTo(("slide",), "b"), S.GreaterThan(("width",), 3)])] == ["GreaterThan"]
    assert [p.slide for p in reader.partitions()] == ["b"]


def test_large_files_are_dealt_to_tasks(spark, tmp_path, monkeypatch):
    (tmp_path / "a.tif").write_bytes(container(images())[0])
    monkeypatch.setattr(S, "SHARE", 3000)
    reader = S.SlideReader({"path": str(tmp_path)}, "chunks")
    parts = reader.partitions()
    rows = [r for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
    assert len(parts) > 2 and len(rows) == len({(r["page"], r["cy"], r["cx"]) for r in rows}) == 10 + 10 + 5
    assert all(any(True for _ in reader.read(p)) for p in parts)


def flipped(raw, height, width, channels):
    return bytes(255 - b for b in zlib.decompress(raw))


def test_odd_files(spark, tmp_path):
    with pytest.raises(ValueError, match="no TIFF"):
        list(S.directories(lambda at, n: b"plain text that is long"[at : at + n], 23, S.HEAD_TAGS))
    raw, link = container(images()[:2])
    looped = bytearray(raw)
    looped[link : link + 4] = looped[4:8]  # the last directory names the first as its next
    pages = list(S.directories(lambda at, n: bytes(looped[at : at + n]), len(looped), S.HEAD_TAGS))
    assert len(pages) == 2
    (tmp_path / "z.tif").write_bytes(container(images()[:1], compress=True)[0])
    rows = S.slide_table(spark, str(tmp_path), "chunks", decoder="tests.test_slides:flipped").collect()
    assert (rebuilt(rows, 0) == 255 - images()[0][0]).all()
    assert S._per_pixel({}, S.X_RESOLUTION) == 0.0
    reader = S.SlideReader({}, "chunks")
    with pytest.raises(ValueError, match="decoder"):
        reader._decoded(b"", 7, 1, 1, 1)


def test_written_slides_come_back(spark, tmp_path):
    rows = [("s", k, m, z, *i.shape, i.tobytes()) for k, (i, m, z) in enumerate(images())] + [("t", 0, 5.0, 9, 1, 1, 1, b"\x07")]
    pages = spark.createDataFrame(rows, "slide string, page int, magnification double, z_nm bigint, height int, width int, channels int, data binary")
    S.write_slides(pages, str(tmp_path), cell=16)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["s.tif", "t.tif"]
    chunks = S.slide_table(spark, str(tmp_path), "chunks").where("slide = 's'").collect()
    for k, (image, _, _) in enumerate(images()[:3]):
        assert (rebuilt(chunks, k) == image).all()
    assert S.slide_table(spark, str(tmp_path)).count() == 4
    S.write_slides(pages.where("slide = 't'"), str(tmp_path), cell=32)  # written again, the other stays
    assert S.slide_table(spark, str(tmp_path)).count() == 4


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    rng = np.random.default_rng(2)
    planes = {("s", 20.0, z): rng.integers(0, 256, (70, 90, 3), np.uint8) for z in (-1, 0, 4)} | {("s", 5.0, 0): rng.integers(0, 256, (9, 11, 1), np.uint8), ("t", 20.0, 0): rng.integers(0, 256, (16, 16, 3), np.uint8)}
    rows = [(*k, *v.shape, v.tobytes()) for k, v in planes.items()]
    frame = spark.createDataFrame(rows, "slide string, magnification double, z_nm bigint, height int, width int, channels int, data binary")
    R.write_store(R.cut_planes(frame, 16), path, 6)
    return path, planes


def test_regions(spark, store):
    path, planes = store
    rng = random.Random(6)
    asked = [(i, rng.choice("st"), rng.choice([20.0, 5.0]), rng.randrange(-40, 100), rng.randrange(-40, 90), rng.randrange(1, 60), rng.randrange(1, 60)) for i in range(60)]
    asked += [(100, "s", 20.0, 0, 0, 90, 70), (101, "s", 20.0, 90, 0, 3, 2), (102, "s", 20.0, -3, -2, 3, 2), (103, "none", 20.0, 0, 0, 3, 3), (104, "s", 20.0, 89, 69, 9, 9), (105, "s", 20.0, 16, 16, 16, 16)]
    regions = spark.createDataFrame(asked, "id long, slide string, magnification double, x int, y int, w int, h int")
    for pad in (False, True):
        got = {(r.id, r.z_nm): np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3) for r in R.read_regions(spark, path, regions, pad).collect()}
        want = {}
        for i, slide, m, x, y, w, h in asked:
            for (s, pm, z), image in planes.items():
                if (s, pm) == (slide, m):
                    full = np.zeros((h, w, 3), np.uint8)
                    cut = image[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)]
                    full[max(0, -y) : max(0, -y) + len(cut), max(0, -x) : max(0, -x) + cut.shape[1]] = cut
                    want[i, z] = full if pad or not cut.size else np.broadcast_to(cut, (*cut.shape[:2], 3))
        assert got.keys() == want.keys() and all((got[k] == want[k]).all() for k in want)
    stacks = {r.id: r for r in R.read_stacks(spark, path, regions).collect()}
    assert stacks[105].zs == [-1, 0, 4] and all(bytes(p) == planes["s", 20.0, z][16:32, 16:32].tobytes() for z, p in zip(stacks[105].zs, stacks[105].planes, strict=True))


def test_regions_are_put_together_in_batches(spark, store, monkeypatch):
    """Not a group at a time, whose planes go through a shuffle once; batches cut regions and stacks anywhere."""
    path, planes = store
    regions = spark.createDataFrame([(i, "s", 20.0, i % 70, i % 50, 1 + i % 19, 1 + i % 20) for i in range(200)], "id long, slide string, magnification double, x int, y int, w int, h int")
    monkeypatch.setattr(R, "BATCH_ROWS", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        each, stacks = R.read_regions(spark, path, regions), R.read_stacks(spark, path, regions)
        got = {(r.id, r.z_nm): bytes(r.data) for r in each.collect()}
        piled = {(r.id, z): bytes(p) for r in stacks.collect() for z, p in zip(r.zs, r.planes, strict=True)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(i, z): planes["s", 20.0, z][i % 50 : i % 50 + 1 + i % 20, i % 70 : i % 70 + 1 + i % 19].tobytes() for i in range(200) for z in (-1, 0, 4)}
    assert got == want == piled
    for frame in (each, stacks):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroupsInArrow" not in plan and plan.count("RepartitionByExpression") == 1


def test_a_small_region_opens_few_files(spark, store):
    path, _ = store
    files = spark.read.parquet(f"{path}/files")
    one = spark.createDataFrame([(1, "s", 20.0, 3, 3, 10, 10)], "id long, slide string, magnification double, x int, y int, w int, h int")
    wanted = R.wanted_chunks(one, spark.read.parquet(f"{path}/pages"))
    touched = R.touched_files(wanted, files)
    assert 1 <= len(touched) < files.select("file").distinct().count()
    assert R.touched_files(R.wanted_chunks(one.selectExpr("id", "slide", "magnification", "x + 500 as x", "y", "w", "h"), spark.read.parquet(f"{path}/pages")), files) == []


def test_codes(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(1 << k), rng.randrange(1 << k)) for k in range(1, 31) for _ in range(5)]
    rows = spark.createDataFrame(pairs, "x int, y int")
    for r in rows.select("x", "y", R.z_order(F.col("x"), F.col("y")).alias("c")).collect():
        assert r.c == sum(((r.x >> b) & 1) << (2 * b) | ((r.y >> b) & 1) << (2 * b + 1) for b in range(31))
