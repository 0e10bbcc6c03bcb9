"""Media columns: Netpbm and BMP images decoded to numpy arrays, area-resized and written as NPY tiles.

``decode`` reads P1 to P6 with samples of up to 8 bits and uncompressed BMP of 8 or 24 bits, whatever the row order.
``resize`` averages areas exactly by an integral image with interpolated borders. ``features`` of an image are a
thumbnail tile (NPY bytes) and a 64-bit difference hash of its brightness.

``encode_payload`` stores bytes losslessly: rows of 64 RGB pixels (192 bytes), as a P6 Netpbm file or a 24-bit BMP, as
asked for. Reading such a file gives the payload back.

Edge cases: a null text is empty, and an empty text is padded to one row of blanks; rows that repeat give equal
values; null ids are kept; an empty table gives no rows; other columns are dropped. Bytes that are no image raise
ValueError in ``decode``. A text of any length is one image and takes memory in proportion.
"""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.plans.storage import bound_batches

ROW = 192
TILE = 16
#: Rows that are summed across at a time.
BAND = 256

_HEADER = re.compile(rb"P([1-6])" + rb"(?:\s|#[^\n]*\n)+([0-9]+)" * 2)


def decode(media: bytes) -> np.ndarray:
    """An image as uint8 of shape (height, width, channels)."""
    if media[:2] == b"BM":
        return _decode_bmp(media)
    if m := _HEADER.match(media):
        return _decode_netpbm(media, m)
    raise ValueError("neither Netpbm nor BMP")


def _decode_netpbm(media: bytes, m: re.Match) -> np.ndarray:
    kind, width, height, at = int(m[1]), int(m[2]), int(m[3]), m.end()
    channels, most = (3 if kind in (3, 6) else 1), 1
    if kind not in (1, 4):
        top = re.compile(rb"(?:\s|#[^\n]*\n)+([0-9]+)").match(media, at)
        most, at = int(top[1]), top.end()
    if not 1 <= most <= 255:
        raise ValueError("samples of more than 8 bits")
    n = width * height * channels
    if kind == 4:
        stride = -(-width // 8)
        bits = np.unpackbits(np.frombuffer(media, np.uint8, stride * height, at + 1).reshape(height, stride), axis=1)
        out = (1 - bits[:, :width]) * 255
    elif kind >= 5:
        out = np.frombuffer(media, np.uint8, n, at + 1)
    else:
        body = re.sub(rb"#[^\n]*", b"", media[at:])
        found = re.findall(rb"[01]" if kind == 1 else rb"[0-9]+", body)[:n]
        out = np.array([int(x) for x in found], np.uint16)
        out = (1 - out) * 255 if kind == 1 else out
    if kind not in (1, 4) and most != 255:
        out = (out.astype(np.uint32) * 255 + most // 2) // most
    return out.astype(np.uint8).reshape(height, width, channels)


def _decode_bmp(media: bytes) -> np.ndarray:
    start, header, width, height, _, bits, packed = struct.unpack_from("<10xIIiiHHI", media)
    if packed or bits not in (8, 24):
        raise ValueError("only uncompressed BMP of 8 or 24 bits")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(media, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * bits // 8]
    rows = rows if height < 0 else rows[::-1]
    if bits == 24:
        return np.ascontiguousarray(rows.reshape(abs(height), width, 3)[:, :, ::-1])
    used = struct.unpack_from("<I", media, 46)[0] or 256
    palette = np.frombuffer(media, np.uint8, 4 * used, 14 + header).reshape(used, 4)[:, 2::-1]
    return palette[rows]


def encode_netpbm(image: np.ndarray) -> bytes:
    """P6 for three channels, P5 for one."""
    height, width, channels = image.shape
    return b"P%d\n%d %d\n255\n" % (6 if channels == 3 else 5, width, height) + image.tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """24-bit BMP, rows from the bottom up."""
    height, width, _ = image.shape
    rows = np.zeros((height, (width * 3 + 3) // 4 * 4), np.uint8)
    rows[:, : width * 3] = image[::-1, :, ::-1].reshape(height, -1)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def _areas(values: np.ndarray, out: int) -> np.ndarray:
    """Sums over ``out`` equal stretches of the first axis, from its running sums, read between places where need be."""
    n = len(values)
    integral = np.zeros((n + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, dtype=np.float64, out=integral[1:])
    at = np.arange(out + 1) * (n / out)
    low = np.minimum(at.astype(np.int64), n - 1)
    part = (at - low).reshape(-1, *[1] * (values.ndim - 1))
    return np.diff(integral[low] * (1 - part) + integral[low + 1] * part, axis=0)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the area that each output pixel covers, as float64; ``BAND`` rows at a time are summed across."""
    h, w, _ = image.shape
    across = [_areas(image[i : i + BAND].transpose(1, 0, 2), width).transpose(1, 0, 2) for i in range(0, h, BAND)]
    return _areas(np.concatenate(across), height) / (h / height * w / width)


def difference_hash(image: np.ndarray) -> str:
    """16 hex digits: for each of 8 x 8 cells, whether it is darker than its right neighbour."""
    gray = resize(image, 8, 9).mean(axis=2)
    return np.packbits(np.round(gray[:, 1:], 6) > np.round(gray[:, :-1], 6)).tobytes().hex()


def npy(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, image, allow_pickle=False)
    return out.getvalue()


def encode_payload(payload: bytes, form: str = "netpbm") -> bytes:
    """An image of ``payload`` in rows of ROW bytes, three to a pixel."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, ROW // 3, 3)
    return FORMS[form](image)


#: The stored forms.
FORMS = {"netpbm": encode_netpbm, "bmp": encode_bmp}


def store(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), form: str = "netpbm") -> DataFrame:
    """``keep``, ``n_bytes`` and ``media``: each text as an image file of the form ``netpbm`` or ``bmp``."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(batch.num_columns - 1).cast(pa.binary())]
            media = [encode_payload(t + b" " * (-len(t) % ROW or ROW * (not t)), form) for t in texts]
            yield pa.RecordBatch.from_pydict({k: batch.column(i) for i, k in enumerate(keep)} | {"n_bytes": pa.array(map(len, texts), pa.int64()), "media": pa.array(media, pa.binary())})

    plain = docs.select(*keep, F.col("text").alias("_text"))
    return plain.mapInArrow(run, plain.drop("_text").schema.add("n_bytes", "long").add("media", "binary"))


def features(stored: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Decode ``media`` and add ``payload`` (the samples), ``tail_crc32`` (of the last 16), ``tile`` (NPY) and
    ``feature`` (the difference hash)."""
    bound_batches(stored.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = [decode(x.as_buffer().to_pybytes()) for x in batch.column(batch.num_columns - 1)]
            payloads = [i.tobytes() for i in images]
            yield pa.RecordBatch.from_pydict(
                {k: batch.column(i) for i, k in enumerate([*keep, "media"])}
                | {
                    "payload": pa.array(payloads, pa.binary()),
                    "tail_crc32": pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()),
                    "tile": pa.array([npy(np.round(resize(i, TILE, TILE)).astype(np.uint8)) for i in images], pa.binary()),
                    "feature": pa.array([difference_hash(i) for i in images]),
                }
            )

    plain = stored.select(*keep, "media")
    return plain.mapInArrow(run, stored.select(*keep, "media").schema.add("payload", "binary").add("tail_crc32", "long").add("tile", "binary").add("feature", "string"))
