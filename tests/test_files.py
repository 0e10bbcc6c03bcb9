"""File sinks: what is written, what a repeated or broken write leaves, and PNG against a plain reader."""

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilewright.sources import files as S


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): (open(os.path.join(d, f), "rb").read(), os.stat(os.path.join(d, f)).st_mtime_ns) for d, _, names in os.walk(root) for f in names if not f.startswith(".") and S.MANIFEST not in d}


def rows(spark, n, prefix=""):
    return spark.range(n).select(F.format_string(prefix + "d%d/f%03d.txt", F.col("id") % 3, "id").alias("name"), F.when(F.col("id") != 5, F.concat(F.lit("text "), "id").cast("binary")).alias("data"))


def test_written_once(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    S.write_files(rows(spark, 20), path)
    first = tree(f"{tmp_path}/out")
    assert len(first) == 20 and first["d1/f004.txt"][0] == b"text 4" and first["d2/f005.txt"][0] == b""
    S.write_files(rows(spark, 30), path)
    second = tree(f"{tmp_path}/out")
    assert len(second) == 30 and all(second[k] == v for k, v in first.items())
    assert S.missing(rows(spark, 31), path).count() == 1
    listed = {r.name: r for r in S.manifest(spark, path).collect()}
    assert listed.keys() == second.keys() and all((r.bytes, r.crc32) == (len(second[n][0]), zlib.crc32(second[n][0])) for n, r in listed.items())
    assert spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).count() == 29  # without the manifest; Spark passes over the empty file
    S.write_files(rows(spark, 0), path)
    assert S.manifest(spark, f"{tmp_path}/nothing").count() == 0


def test_a_broken_write_is_repeated(spark, tmp_path):
    path = str(tmp_path)
    broken = rows(spark, 20).repartition(4, "name").withColumn("data", F.when(F.col("name") == "d1/f013.txt", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="lost"):
        S.write_files(broken, path)
    assert S.manifest(spark, path).count() == 0
    S.write_files(rows(spark, 20), path)
    assert {k: v[0] for k, v in tree(path).items()} == {r.name: bytes(r.data or b"") for r in rows(spark, 20).collect()}
    assert not [f for d, _, names in os.walk(path) for f in names if f.startswith("_")]


def test_a_task_that_outlives_its_job_leaves_no_part(tmp_path):
    writer = S.FileWriter({"path": f"file://{tmp_path}"})
    writer.abort([])
    part = writer.write(iter([pa.RecordBatch.from_pydict({"name": ["a/b.txt"], "data": [b"text"]})]))
    assert part == S.Part(None, None) and (tmp_path / "a/b.txt").read_bytes() == b"text"
    assert not [f for f in os.listdir(tmp_path / S.MANIFEST) if not f.startswith(".")]


def read_png(raw):
    assert raw[:8] == b"\x89PNG\r\n\x1a\n"
    at, parts = 8, {}
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        assert struct.unpack(">I", raw[at + 8 + size : at + 12 + size])[0] == zlib.crc32(kind + body)
        parts[kind] = body
        at += 12 + size
    width, height, depth, colour = struct.unpack(">IIBB", parts[b"IHDR"][:10])
    channels = {0: 1, 2: 3}[colour]
    flat = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(height, 1 + width * channels)
    assert depth == 8 and not flat[:, 0].any() and list(parts) == [b"IHDR", b"IDAT", b"IEND"]
    return flat[:, 1:].reshape(height, width, channels)


def test_png(spark):
    rng = np.random.default_rng(1)
    images = [rng.integers(0, 256, s, np.uint8) for s in ((1, 1, 1), (7, 5, 3), (40, 3, 1))]
    assert all((read_png(S.png(i)) == i).all() for i in images)
    df = spark.createDataFrame([(f"n{k}", *i.shape, i.tobytes()) for k, i in enumerate(images)], "key string, height int, width int, channels int, data binary")
    got = {r.name: bytes(r.data) for r in S.as_png(df, F.concat("key", F.lit(".png"))).collect()}
    assert all((read_png(got[f"n{k}.png"]) == i).all() for k, i in enumerate(images))


def test_label_names(spark):
    lines = spark.createDataFrame([("a.b.jpg", "0 1"), ("c", "")], "file_name string, text string")
    assert {r.name: bytes(r.data) for r in S.label_files(lines, "labels/train").collect()} == {"labels/train/a.b.txt": b"0 1", "labels/train/c.txt": b""}
