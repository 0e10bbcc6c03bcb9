"""Slides: TIFF containers with a page for each magnification and focal plane, as a Spark data source.

``slide_table`` reads one of three tables from a folder of slides (``slide_*.tif``, ``*.ndpi``, ...):

* ``slides``: a row for each file, from its first page: resolution, objective, offsets and size;
* ``planes``: a row for each page that has both a magnification above 0 and a focal offset;
* ``chunks``: the pixels of those pages, a row for each stored tile or strip.

Each file is read by tasks of its own: only the header and the directories' tags, and for ``chunks`` the stretches of
the file where the wanted pages' tiles lie. A large file is dealt to several tasks, which take every n-th chunk. Filters
on slide, page, magnification and z_nm are pushed to the reader, so pages that are not asked for are not read.
Directories may be those of TIFF, BigTIFF or of the 64-bit variant that tag 65420 announces.

Pixels may be stored as they are or deflated; other compressions need ``decoder`` ("module:function", called with the
stored bytes, height, width and channels), as their libraries are not part of this package. Paths are URIs that
pyarrow's file systems know, or absolute paths.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from importlib import import_module

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import Row, StructType

#: The tags that are read, and the sizes and codes of the types of their values.
WIDTH, HEIGHT, COMPRESSION, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES, X_RESOLUTION, Y_RESOLUTION, UNIT, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES = 256, 257, 259, 273, 277, 278, 279, 282, 283, 296, 322, 323, 324, 325
VARIANT, MAGNIFICATION, X_OFFSET, Y_OFFSET, Z_OFFSET = 65420, 65421, 65422, 65423, 65424
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
HEAD_TAGS = {WIDTH, HEIGHT, COMPRESSION, SAMPLES, STRIP_ROWS, X_RESOLUTION, Y_RESOLUTION, UNIT, TILE_WIDTH, TILE_HEIGHT, VARIANT, MAGNIFICATION, X_OFFSET, Y_OFFSET, Z_OFFSET}
PIXEL_TAGS = HEAD_TAGS | {STRIP_AT, STRIP_BYTES, TILE_AT, TILE_BYTES}
#: Micrometres in the units of a resolution.
UNITS = {2: 25_400.0, 3: 10_000.0}

SCHEMAS = {
    "slides": "path string, slide string, mpp_x double, mpp_y double, objective_power double, x_offset_nm bigint, y_offset_nm bigint, full_width int, full_height int",
    "planes": "path string, slide string, page int, magnification double, z_nm bigint, height int, width int, channels int",
    "chunks": "slide string, page int, magnification double, z_nm bigint, page_height int, page_width int, cell_height int, cell_width int, cy int, cx int, height int, width int, channels int, data binary",
}
ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
#: Bytes of a file that a task reads (about), and of pixels that are handed to Spark together.
SHARE, BATCH = 256 << 20, 4 << 20

Read = Callable[[int, int], bytes]


def directories(read: Read, size: int, wanted: set[int]) -> Iterator[dict[int, tuple]]:
    """The wanted tags' values of each page, in order. A chain that comes back to itself ends there."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
    if magic not in (42, 43):
        raise ValueError("no TIFF file")
    number = lambda code, raw: struct.unpack(order + code, raw)[0]
    big = magic == 43
    at = number("Q", head[8:16]) if big else number("I", head[4:8])
    wide = False
    if not big and (far := number("Q", head[4:12])) < size:  # the variant has 64-bit offsets in an otherwise small layout
        count = number("H", read(far, 2)) if far + 2 <= size else 0
        tags = read(far + 2, 12 * count)
        wide = any(number("H", tags[i : i + 2]) == VARIANT for i in range(0, len(tags) - 11, 12))
        at = far if wide else at
    entry, counts, field = (20, "Q", 8) if big else (12, "I", 4)
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        lead = 8 if big else 2
        count = number("Q" if big else "H", read(at, lead))
        after = 8 if big or wide else 4
        raw = read(at + lead, entry * count + after + (4 * count if wide else 0))
        page: dict[int, tuple] = {}
        for k in range(count):
            e = raw[entry * k : entry * (k + 1)]
            tag, kind = struct.unpack(f"{order}HH", e[:4])
            if tag not in wanted or kind not in TYPES:
                continue
            each, code = TYPES[kind]
            n = number(counts, e[4 : 4 + field])
            value = e[4 + field :]
            if each * n > field:
                where = number("Q" if big else "I", value)
                if wide:
                    where += number("I", raw[entry * count + 8 + 4 * k :][:4]) << 32
                value = read(where, each * n)
            elif wide and kind == 4 and n == 1 and tag in (STRIP_AT, TILE_AT):
                page[tag] = (number("I", value) + (number("I", raw[entry * count + 8 + 4 * k :][:4]) << 32),)
                continue
            page[tag] = struct.unpack(f"{order}{n}s" if code == "s" else order + code * n, value[: each * n])
        yield page
        at = number("Q" if after == 8 else "I", raw[entry * count : entry * count + after])


def _first(page: dict[int, tuple], tag: int, default=None):
    return page[tag][0] if tag in page else default


def _per_pixel(page: dict[int, tuple], tag: int) -> float:
    """Micrometres of a pixel; 0 where the page does not say."""
    top, bottom = page.get(tag, (0, 1))
    return UNITS.get(_first(page, UNIT, 2), 0.0) * bottom / top if top else 0.0


@dataclass
class Part(InputPartition):
    """The ``nth`` of ``of`` shares of a file."""

    path: str
    nth: int
    of: int

    @property
    def slide(self) -> str:
        return self.path.rpartition("/")[2].rpartition(".")[0]


def _passes(filters: list[tuple[str, type, object]], row: dict) -> bool:
    tests = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}
    return all(tests[kind](row[name], value) for name, kind, value in filters if name in row)


class SlideReader(DataSourceReader):
    """Reads one table of a folder."""

    def __init__(self, options: dict[str, str], table: str):
        self.options, self.table, self.filters = dict(options), table, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Comparisons of slide, page, magnification and z_nm with values are this reader's; others stay with Spark."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else ""
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual | In) and name in ("slide", "page", "magnification", "z_nm") and f.value is not None:
                self.filters.append((name, type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Part]:
        files, root = fs.FileSystem.from_uri(self.options["path"])
        pattern = self.options.get("pathglob", "*")
        found = [i for i in files.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File and fnmatch(i.base_name, pattern) and not i.base_name.startswith(("_", "."))]
        out = []
        for i in sorted(found, key=lambda i: i.path):
            shares = max(1, -(-i.size // SHARE)) if self.table == "chunks" else 1
            parts = [Part(i.path, k, shares) for k in range(shares)]
            out += [p for p in parts if _passes(self.filters, {"slide": p.slide})]
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(self.options["path"])
        schema = pa.schema([(name, ARROW[kind]) for name, kind in map(str.split, SCHEMAS[self.table].split(", "))])
        with files.open_input_file(partition.path) as f:
            rows = getattr(self, f"_{self.table}")(partition, lambda at, n: f.read_at(n, at), f.size())
            held, size = [], 0
            for row in rows:
                held.append(row)
                size += len(row.get("data", b"")) + 100
                if size > BATCH:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)

    def _slides(self, part: Part, read: Read, size: int) -> Iterator[dict]:
        page = next(directories(read, size, HEAD_TAGS), {})
        yield {
            "path": part.path, "slide": part.slide, "mpp_x": _per_pixel(page, X_RESOLUTION), "mpp_y": _per_pixel(page, Y_RESOLUTION), "objective_power": float(_first(page, MAGNIFICATION, 40.0)),
            "x_offset_nm": int(_first(page, X_OFFSET, 0)), "y_offset_nm": int(_first(page, Y_OFFSET, 0)), "full_width": _first(page, WIDTH, 0), "full_height": _first(page, HEIGHT, 0),
        }

    def _pages(self, part: Part, read: Read, size: int, wanted: set[int]) -> Iterator[tuple[dict, dict[int, tuple]]]:
        """Pages that have both tags, a positive magnification, and pass the filters."""
        for k, page in enumerate(directories(read, size, wanted)):
            magnification, z = _first(page, MAGNIFICATION), _first(page, Z_OFFSET)
            if magnification is not None and z is not None and magnification > 0:
                row = {"slide": part.slide, "page": k, "magnification": float(magnification), "z_nm": int(z)}
                if _passes(self.filters, row):
                    yield row, page

    def _planes(self, part: Part, read: Read, size: int) -> Iterator[dict]:
        for row, page in self._pages(part, read, size, HEAD_TAGS):
            yield row | {"path": part.path, "height": _first(page, HEIGHT), "width": _first(page, WIDTH), "channels": _first(page, SAMPLES, 1)}

    def _chunks(self, part: Part, read: Read, size: int) -> Iterator[dict]:
        nth = 0
        for row, page in self._pages(part, read, size, PIXEL_TAGS):
            height, width, channels = _first(page, HEIGHT), _first(page, WIDTH), _first(page, SAMPLES, 1)
            tiled = TILE_AT in page
            cell_height = _first(page, TILE_HEIGHT) if tiled else min(height, _first(page, STRIP_ROWS, height))
            cell_width = _first(page, TILE_WIDTH) if tiled else width
            across = -(-width // cell_width)
            for k, (at, n) in enumerate(zip(*((page[TILE_AT], page[TILE_BYTES]) if tiled else (page[STRIP_AT], page[STRIP_BYTES])), strict=True)):
                nth += 1
                if nth % part.of != part.nth:
                    continue
                cy, cx = divmod(k, across)
                h, w = min(cell_height, height - cy * cell_height), min(cell_width, width - cx * cell_width)
                stored = (cell_height if tiled else h, cell_width, channels)
                pixels = np.frombuffer(self._decoded(read(at, n), _first(page, COMPRESSION, 1), *stored), np.uint8).reshape(stored)[:h, :w]
                yield row | {"page_height": height, "page_width": width, "cell_height": cell_height, "cell_width": cell_width, "cy": cy, "cx": cx, "height": h, "width": w, "channels": channels, "data": pixels.tobytes()}

    def _decoded(self, raw: bytes, compression: int, height: int, width: int, channels: int) -> bytes:
        if "decoder" in self.options:
            module, _, name = self.options["decoder"].partition(":")
            return getattr(import_module(module), name)(raw, height, width, channels)
        if compression in (8, 32946):
            return zlib.decompress(raw)
        if compression != 1:
            raise ValueError(f"compression {compression} needs a decoder")
        return raw


@dataclass
class Written(WriterCommitMessage):
    """Files under their temporary and their final names."""

    files: list[tuple[str, str]]


class SlideWriter(DataSourceWriter):
    """Writes planes, slide by slide, as deflated BigTIFF files under temporary names, which the commit changes.

    Rows of a slide must come one after another, in the order of pages. A page's directory lies before its tiles, so
    files are written from front to end, with one page ahead in memory."""

    def __init__(self, options: dict[str, str]):
        self.root, self.cell, self.run = options["path"].rstrip("/"), int(options.get("cell", 256)), uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = fs.FileSystem.from_uri(self.root)
        files.create_dir(root, recursive=True)
        out, slide, held, stream = [], None, None, None

        def close() -> None:
            if stream is not None:
                self._page(stream, held, last=True)
                stream.close()

        for row in iterator:
            if row.slide != slide:
                close()
                slide, held = row.slide, None
                names = f"{root}/_{self.run}-{uuid.uuid4().hex}", f"{root}/{slide}.tif"
                out.append(names)
                stream = files.open_output_stream(names[0])
                stream.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16))
            if held is not None:
                self._page(stream, held, last=False)
            held = row
        close()
        return Written(out)

    def _page(self, stream, row: Row, last: bool) -> None:
        image = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)
        cell = self.cell
        high, wide = -(-row.height // cell) * cell, -(-row.width // cell) * cell
        padded = np.zeros((high, wide, row.channels), np.uint8)
        padded[: row.height, : row.width] = image
        tiles = [zlib.compress(padded[y : y + cell, x : x + cell].tobytes(), 6) for y in range(0, high, cell) for x in range(0, wide, cell)]
        extra = {name: getattr(row, name, None) for name in ("mpp_x", "mpp_y", "x_offset_nm", "y_offset_nm")}
        n = len(tiles)
        tags = [(WIDTH, 4, "I", [row.width]), (HEIGHT, 4, "I", [row.height]), (258, 3, "H", [8] * row.channels), (COMPRESSION, 3, "H", [8]), (262, 3, "H", [2 if row.channels == 3 else 1]), (SAMPLES, 3, "H", [row.channels])]
        tags += [(tag, 5, "I", [round(10_000_000 / extra[name]), 1000]) for tag, name in ((X_RESOLUTION, "mpp_x"), (Y_RESOLUTION, "mpp_y")) if extra[name]]
        tags += [(284, 3, "H", [1]), (UNIT, 3, "H", [3]), (TILE_WIDTH, 4, "I", [cell]), (TILE_HEIGHT, 4, "I", [cell]), (TILE_AT, 16, "Q", [0] * n), (TILE_BYTES, 16, "Q", [len(t) for t in tiles])]
        tags += [(tag, kind, code, [value]) for tag, kind, code, value in ((MAGNIFICATION, 11, "f", row.magnification), (X_OFFSET, 9, "i", extra["x_offset_nm"]), (Y_OFFSET, 9, "i", extra["y_offset_nm"]), (Z_OFFSET, 9, "i", row.z_nm)) if value is not None]
        start = stream.tell()
        loose = start + 8 + 20 * len(tags) + 8
        sizes = {tag: struct.calcsize(code) * len(values) for tag, _, code, values in tags}
        pixels = loose + sum(s for s in sizes.values() if s > 8)
        places = (np.cumsum([0, *map(len, tiles)])[:-1] + pixels).tolist()
        entries, values = b"", b""
        for tag, kind, code, given in tags:
            raw = struct.pack(f"<{len(given)}{code}", *(places if tag == TILE_AT else given))
            count = len(given) // 2 if kind == 5 else len(given)
            if len(raw) > 8:
                entries += struct.pack("<HHQQ", tag, kind, count, loose + len(values))
                values += raw
            else:
                entries += struct.pack("<HHQ8s", tag, kind, count, raw)
        end = pixels + sum(map(len, tiles))
        stream.write(struct.pack("<Q", len(tags)) + entries + struct.pack("<Q", 0 if last else end) + values + b"".join(tiles))

    def commit(self, messages: list[Written | None]) -> None:
        files, _ = fs.FileSystem.from_uri(self.root)
        for m in messages:
            for old, new in m.files if m else []:
                files.move(old, new)

    def abort(self, messages: list[Written | None]) -> None:
        files, root = fs.FileSystem.from_uri(self.root)
        for i in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if i.base_name.startswith(f"_{self.run}"):
                files.delete_file(i.path)


class SlideSource(DataSource):
    """The data source ``slides``; options: path, table, pathGlob and decoder to read, path and cell to write."""

    @classmethod
    def name(cls) -> str:
        return "slides"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "planes")]

    def reader(self, schema: StructType) -> SlideReader:
        return SlideReader(self.options, self.options.get("table", "planes"))

    def writer(self, schema: StructType, overwrite: bool) -> SlideWriter:
        return SlideWriter(self.options)


def _registered(spark: SparkSession) -> None:
    spark.dataSource.register(SlideSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # a reader that takes filters needs it


def slide_table(spark: SparkSession, path: str, table: str = "planes", glob: str = "*", decoder: str | None = None) -> DataFrame:
    """One of the tables ``slides``, ``planes`` and ``chunks`` of the slides in a folder."""
    _registered(spark)
    reader = spark.read.format("slides").option("table", table).option("pathGlob", glob)
    return (reader.option("decoder", decoder) if decoder else reader).load(path)


def write_slides(pages: DataFrame, path: str, cell: int = 256) -> None:
    """A file ``<slide>.tif`` for each slide, a page for each row (slide, page, magnification, z_nm, height, width, channels
    and data; optionally mpp_x, mpp_y, x_offset_nm, y_offset_nm), tiled in cells of a multiple of 16 pixels."""
    _registered(pages.sparkSession)
    ordered = pages.repartition("slide").sortWithinPartitions("slide", "page")
    ordered.write.format("slides").option("cell", cell).mode("append").save(path)
