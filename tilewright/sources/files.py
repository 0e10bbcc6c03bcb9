"""Rows as files: a sink with a manifest, so that a write which was cut short or is repeated only writes what is missing.

``write_files`` takes rows of a name (with folders) and bytes. A task writes each file under another name and moves it,
so no half a file is ever seen, and lists what it has written in a part of the manifest; the job's commit makes those
parts visible. Names in the manifest are left alone later on; files of a job that was killed are not in it and are
written again. Only one path for each task goes through the driver. Paths are URIs that pyarrow's file systems know.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "_manifest"
LISTED = "name string, bytes bigint, crc32 bigint"


@dataclass
class Part(WriterCommitMessage):
    """A part of the manifest under its hidden and its final name; none if the task had no rows."""

    hidden: str | None
    final: str | None


def _remove(files: fs.FileSystem, path: str) -> None:
    try:
        files.delete_file(path)
    except FileNotFoundError:  # a task and its job may both clear a part
        pass


class FileWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.root, self.run = options["path"].rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        files, root = fs.FileSystem.from_uri(self.root)
        task, made, listed = uuid.uuid4().hex, set(), []
        for batch in iterator:
            for name, data in zip(batch.column("name").to_pylist(), batch.column("data").to_pylist(), strict=True):
                target, data = f"{root}/{name}", data or b""
                folder = target.rpartition("/")[0]
                if folder not in made:
                    files.create_dir(folder, recursive=True)
                    made.add(folder)
                hidden = f"{folder}/_{task}"
                with files.open_output_stream(hidden) as out:
                    out.write(data)
                files.move(hidden, target)
                listed.append({"name": name, "bytes": len(data), "crc32": zlib.crc32(data)})
        if not listed:
            return Part(None, None)
        files.create_dir(f"{root}/{MANIFEST}", recursive=True)
        hidden, final = f"{root}/{MANIFEST}/_{self.run}-{task}", f"{root}/{MANIFEST}/{self.run}-{task}.parquet"
        schema = pa.schema([("name", pa.string()), ("bytes", pa.int64()), ("crc32", pa.int64())])
        with files.open_output_stream(hidden) as out:
            pq.write_table(pa.Table.from_pylist(listed, schema), out)
        if files.get_file_info(self._broken(root)).type != fs.FileType.NotFound:  # looked up after the part is there, as ``abort`` lists parts after its mark is
            _remove(files, hidden)
            return Part(None, None)
        return Part(hidden, final)

    def _broken(self, root: str) -> str:
        """The mark of a job that was given up: tasks that still run then leave no part behind."""
        return f"{root}/{MANIFEST}/.{self.run}"

    def commit(self, messages: list[Part | None]) -> None:
        files, _ = fs.FileSystem.from_uri(self.root)
        for m in messages:
            if m and m.hidden:
                files.move(m.hidden, m.final)

    def abort(self, messages: list[Part | None]) -> None:
        files, root = fs.FileSystem.from_uri(self.root)
        files.create_dir(f"{root}/{MANIFEST}", recursive=True)
        files.open_output_stream(self._broken(root)).close()
        for i in files.get_file_info(fs.FileSelector(f"{root}/{MANIFEST}")):
            if i.base_name.startswith(f"_{self.run}"):
                _remove(files, i.path)


class FileSink(DataSource):
    """The data source ``named_files``: rows of name and data; the option is path."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, data binary"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes and crc32 of the files that have been written to a folder; a name that was written twice is there twice."""
    files, root = fs.FileSystem.from_uri(path)
    if not any(i.base_name.endswith(".parquet") for i in files.get_file_info(fs.FileSelector(f"{root}/{MANIFEST}", allow_not_found=True))):
        return spark.createDataFrame([], LISTED)
    return spark.read.schema(LISTED).parquet(f"{path.rstrip('/')}/{MANIFEST}")


def missing(rows: DataFrame, path: str) -> DataFrame:
    """The rows whose name is not in the folder's manifest."""
    return rows.join(manifest(rows.sparkSession, path).select("name"), "name", "left_anti")


def write_files(rows: DataFrame, path: str) -> None:
    """Write the rows (name, data) whose files are not there yet; a name should occur once."""
    rows.sparkSession.dataSource.register(FileSink)
    missing(rows.select("name", "data"), path).select("name", "data").write.format("named_files").mode("append").save(path)


def png(image: np.ndarray) -> bytes:
    """An 8-bit PNG of one (gray) or three channels; rows are not filtered."""
    height, width, channels = image.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, -1)], axis=1)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


def as_png(images: DataFrame, name) -> DataFrame:
    """name and data (a PNG) of images given as height, width, channels and data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [png(np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["channels"])) for r in batch.select(["height", "width", "channels", "data"]).to_pylist()]
            yield pa.RecordBatch.from_pydict({"name": batch.column("name"), "data": pa.array(made, pa.binary())})

    return images.select(name.alias("name"), "height", "width", "channels", "data").mapInArrow(run, "name string, data binary")


def label_files(lines: DataFrame, folder: str = "labels") -> DataFrame:
    """name and data of the label file of each image (file_name, text), in place of its extension ``.txt``."""
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    return lines.select(F.concat(F.lit(f"{folder}/"), stem, F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("data"))
