"""Focus scores, stacks and projections of planes of any size, in blocks with halos.

Planes come as chunks (``regions.cut_planes`` or the ``chunks`` table of slides). Each block hands the borders that its
neighbours need, ``HALO`` pixels wide, to them; the blocks of all focal planes at one place then meet in one group, whose
size does not depend on the plane's. There the kernels run over the block with its halo (mirrored where the plane ends),
the stack and the projection are folded over z with a running best, and of the scores only sums and histograms of whole
numbers leave the group. Sums and histograms add up over blocks, so percentiles are exact: the two order statistics that
a percentile lies between are read from the running counts of a plane's distinct values, which are bounded by the kernels'
range, whatever the plane's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.operators import focus
from tilewright.plans.storage import materialize

#: Reach of the widest kernel, a blur and a Laplacian of aperture 5, one after the other.
HALO = 4
PART = 0.75
_SIDES = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
_SHAPE = ("page_height", "page_width", "cell_height", "cell_width")


def with_halos(chunks: DataFrame, keys: tuple[str, ...] = ("slide", "magnification")) -> DataFrame:
    """``keys``, z_nm, the page's and cells' sizes, the block (cy, cx) that a piece goes to, where it lies on the plane (top,
    left, height, width, channels) and its pixels: every chunk, and the borders of its neighbours."""
    kept = [*keys, "z_nm", *_SHAPE]

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i, r in enumerate(batch.select([*_SHAPE, "cy", "cx", "height", "width", "channels", "data"]).to_pylist()):
                if min(r["cell_height"], r["cell_width"]) < HALO:
                    raise ValueError(f"cells must have {HALO} pixels each way at least")
                image = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["channels"])
                h, w = image.shape[:2]
                top, left = r["cy"] * r["cell_height"], r["cx"] * r["cell_width"]
                for dy, dx in _SIDES:
                    cy, cx = r["cy"] + dy, r["cx"] + dx
                    if cy < 0 or cx < 0 or cy * r["cell_height"] >= r["page_height"] or cx * r["cell_width"] >= r["page_width"]:
                        continue
                    ys = slice(0, min(h, HALO)) if dy < 0 else slice(max(0, h - HALO), h) if dy > 0 else slice(0, h)
                    xs = slice(0, min(w, HALO)) if dx < 0 else slice(max(0, w - HALO), w) if dx > 0 else slice(0, w)
                    cut = image[ys, xs]
                    at.append(i)
                    rows.append((cy, cx, top + ys.start, left + xs.start, *cut.shape, cut.tobytes()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int32()] * 7 + [pa.binary()]
            names = ["cy", "cx", "top", "left", "height", "width", "channels", "data"]
            yield pa.RecordBatch.from_pydict({k: batch.column(k).take(pa.array(at, pa.int64())) for k in kept} | {n: pa.array(c, t) for n, c, t in zip(names, columns, kinds, strict=True)})

    schema = chunks.select(*kept).schema
    for name in ("cy", "cx", "top", "left", "height", "width", "channels"):
        schema = schema.add(name, T.IntegerType())
    return chunks.select(*kept, "cy", "cx", "height", "width", "channels", "data").mapInArrow(run, schema.add("data", T.BinaryType()))


def _assembled(pieces: list[dict], cy: int, cx: int) -> tuple[np.ndarray, np.ndarray]:
    """The block's own pixels, and with a halo that is mirrored beyond the plane; what is missing is black."""
    r = pieces[0]
    height, width = r["page_height"], r["page_width"]
    y0, x0 = cy * r["cell_height"], cx * r["cell_width"]
    y1, x1 = min(height, y0 + r["cell_height"]), min(width, x0 + r["cell_width"])
    wide = np.zeros((y1 - y0 + 2 * HALO, x1 - x0 + 2 * HALO, r["channels"]), np.uint8)
    for p in pieces:
        image = np.frombuffer(p["data"], np.uint8).reshape(p["height"], p["width"], p["channels"])
        y, x = p["top"] - y0 + HALO, p["left"] - x0 + HALO
        wide[y : y + p["height"], x : x + p["width"]] = image
    mirror = lambda a, b, n: focus.mirror(np.arange(a - HALO, b + HALO), n) - a + HALO
    return wide[HALO:-HALO, HALO:-HALO], wide[mirror(y0, y1, height)[:, None], mirror(x0, x1, width)]


def _counted(values: np.ndarray) -> tuple[list[int], list[int]]:
    found, n = np.unique(values, return_counts=True)
    return found.tolist(), n.tolist()


def _one_block(key: tuple, table: pa.Table, names: tuple[str, ...], kinds: list) -> pa.Table:
    """A row for each z with the parts of its scores, and one, with z null, with the block's stack and projection."""
    cy, cx = key[-2].as_py(), key[-1].as_py()
    by_z: dict[int, list[dict]] = {}
    for piece in table.to_pylist():
        by_z.setdefault(piece["z_nm"], []).append(piece)
    best = stacked = most = None
    out = []
    for z in sorted(by_z):
        own, wide = _assembled(by_z[z], cy, cx)
        gray = focus.to_gray(wide).astype(np.int64)[None]
        near = gray[:, HALO - 1 : -(HALO - 1), HALO - 1 : -(HALO - 1)]
        lap, grad, log = focus.valid_laplace(near)[0], focus.valid_gradient(near, 3)[0], np.abs(focus.valid_log(gray, 5)[0])
        (lv, lc), (gv, gc) = _counted(np.abs(lap)), _counted(grad)
        out.append({"z_nm": z, "n": lap.size, "lap": int(lap.sum()), "lap2": int((lap * lap).sum()), "grad": int(grad.sum()), "log": int(log.sum()), "lap_values": lv, "lap_counts": lc, "grad_values": gv, "grad_counts": gc})
        if best is None:
            best, stacked, most = log, own.copy(), own.copy()
        else:
            better = log > best
            best, stacked, most = np.where(better, log, best), np.where(better[..., None], own, stacked), np.maximum(most, own)
    out.append({"height": stacked.shape[0], "width": stacked.shape[1], "channels": stacked.shape[2], "stacked": stacked.tobytes(), "mip": most.tobytes()})
    r = table.slice(0, 1)
    same = {k: r.column(k)[0].as_py() for k in [*names, *_SHAPE]} | {"cy": cy, "cx": cx}
    return pa.Table.from_pylist([same | row for row in out], pa.schema(kinds))


def block_products(chunks: DataFrame, keys: tuple[str, ...] = ("slide", "magnification")) -> DataFrame:
    """The parts of all scores, and stacks and projections, of each block; a written table for the functions below."""
    pieces = with_halos(chunks, keys)
    whole, many, raw = T.LongType(), T.ArrayType(T.LongType()), T.BinaryType()
    schema = T.StructType([f for f in pieces.schema if f.name in (*keys, *_SHAPE)])
    for name in ("cy", "cx"):
        schema = schema.add(name, T.IntegerType())
    for name, kind in {"z_nm": whole, "n": whole, "lap": whole, "lap2": whole, "grad": whole, "log": whole, "lap_values": many, "lap_counts": many, "grad_values": many, "grad_counts": many, "height": T.IntegerType(), "width": T.IntegerType(), "channels": T.IntegerType(), "stacked": raw, "mip": raw}.items():
        schema = schema.add(name, kind)
    arrow = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    kinds = [(f.name, arrow[f.dataType.simpleString()]) for f in schema]
    return materialize(pieces.groupBy(*keys, "cy", "cx").applyInArrow(lambda key, table: _one_block(key, table, keys, kinds), schema))


def counted_percentile(counts: DataFrame, by: list[str], part: float = PART) -> DataFrame:
    """``by`` and percentile (linear between order statistics) of the values in ``counts`` (by, value, n)."""
    order = Wd.partitionBy(*by).orderBy("value")
    ranked = counts.withColumns({"upto": F.sum("n").over(order), "all": F.sum("n").over(Wd.partitionBy(*by))})
    at = (F.col("all") - 1) * F.lit(part)
    low = F.floor(at)
    holds = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("value")))
    a, b = holds(low), holds(F.least(low + 1, F.col("all") - 1))
    return ranked.groupBy(*by).agg((a + (b - a) * F.first(at - low)).alias("percentile"))


def block_scores(products: DataFrame, keys: tuple[str, ...] = ("slide", "magnification")) -> DataFrame:
    """``keys``, z_nm, vol, tenengrad, pvol, ptenengrad and log of each plane."""
    by = [*keys, "z_nm"]
    parts = products.where("z_nm is not null")
    mean = lambda c: F.sum(c) / F.sum("n")
    sums = parts.groupBy(*by).agg((mean("lap2") - mean("lap") * mean("lap")).alias("vol"), mean("grad").alias("tenengrad"), mean("log").alias("log"))

    def percentile(kind: str, name: str) -> DataFrame:
        pairs = parts.select(*by, F.explode(F.arrays_zip(F.col(f"{kind}_values").alias("value"), F.col(f"{kind}_counts").alias("n"))).alias("x"))
        counts = pairs.groupBy(*by, F.col("x.value").alias("value")).agg(F.sum("x.n").alias("n"))
        return counted_percentile(counts, by).withColumnRenamed("percentile", name)

    out = sums.join(percentile("lap", "pvol"), by).join(percentile("grad", "ptenengrad"), by)
    return out.select(*by, "vol", "tenengrad", "pvol", "ptenengrad", "log")


def block_images(products: DataFrame, image: str | Column, keys: tuple[str, ...] = ("slide", "magnification")) -> DataFrame:
    """The stacks (``stacked``) or projections (``mip``) as chunks of one plane, with z_nm 0, as a store takes them."""
    rows = products.where("z_nm is null").withColumns({"z_nm": F.lit(0).cast("long"), "data": F.col(image) if isinstance(image, str) else image})
    return rows.select(*keys, "z_nm", *_SHAPE, "cy", "cx", "height", "width", "channels", "data")
