"""Queries over slides: the planes of ``embeddings`` are laid out as pages, written as slide files, scanned and read by region."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators import blocks, focus, regions
from tilewright.plans import views
from tilewright.plans.file_queries import _folder
from tilewright.plans.queries import PLANES, _r6, query
from tilewright.plans.storage import table
from tilewright.sources import slides

#: Tiles of a slide lie in a square of so many; page sizes by magnification.
SIDE = 8
PIX = f"""{PLANES}, pix AS (SELECT tile // 64 AS nth, 's' || (tile // 64) AS slide, z, (tile % 64 % 8) * 8 + i % 8 AS px_x, (tile % 64 // 8) * 8 + i // 8 AS px_y, px[i + 1] AS v FROM planes, range(64) r(i)),
points AS (SELECT slide, 20.0::DOUBLE AS magnification, z, px_x, px_y, v AS r, 255 - v AS g, v // 2 AS b FROM pix UNION ALL SELECT slide, 10.0::DOUBLE, z, px_x // 2, px_y // 2, v, v, v FROM pix WHERE px_x % 2 = 0 AND px_y % 2 = 0)"""
ASKED = """asked AS (SELECT c_custkey AS id, 's' || (c_custkey % 3) AS slide, CASE WHEN c_custkey % 4 < 3 THEN 20.0::DOUBLE ELSE 10.0::DOUBLE END AS magnification, CASE WHEN c_custkey % 4 < 3 THEN 64 ELSE 32 END AS side,
  (c_custkey * 37) % 110 - 30 AS x, (c_custkey * 53) % 110 - 30 AS y, 1 + c_custkey % 23 AS w, 1 + (c_custkey * 7) % 19 AS h FROM customer),
box AS (SELECT a.*, p.z, greatest(0, x) AS x0, greatest(0, y) AS y0, least(side, x + w) AS x1, least(side, y + h) AS y1 FROM asked a JOIN (SELECT DISTINCT slide, z FROM pix) p USING (slide))"""


def _pages(spark, d) -> DataFrame:
    """Pages as ``write_slides`` takes them: RGB at 20, every second pixel in one channel at 10, and a last one without
    focal offset, which no table of planes has."""
    p = views.planes(spark, d).selectExpr("tile div 64 as nth", "cast(tile % 64 as int) as place", "z", "px")

    def one(t: pa.Table) -> pa.Table:
        value, there = np.zeros((2, SIDE * 8, SIDE * 8), np.int64)
        for r in t.to_pylist():
            y, x = divmod(r["place"], SIDE)
            value[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8] = np.array(r["px"]).reshape(8, 8)
            there[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8] = 1
        rgb = (np.stack([value, 255 - value, value // 2], 2) * there[:, :, None]).astype(np.uint8)
        gray = value[::2, ::2].astype(np.uint8)
        z, nth = t.column("z")[0].as_py(), t.column("nth")[0].as_py()
        rows = [(z * 2, 20.0, (z - 2) * 1000, rgb), (z * 2 + 1, 10.0, (z - 2) * 1000, gray[:, :, None])] + ([(10, -1.0, None, gray[:8, :8, None])] if z == 4 else [])
        return pa.Table.from_pylist([{"nth": nth, "page": k, "magnification": m, "z_nm": zn, "height": i.shape[0], "width": i.shape[1], "channels": i.shape[2], "data": i.tobytes()} for k, m, zn, i in rows], pa.schema([("nth", pa.int64()), ("page", pa.int32()), ("magnification", pa.float64()), ("z_nm", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())]))

    laid = p.groupBy("nth", "z").applyInArrow(one, "nth bigint, page int, magnification double, z_nm bigint, height int, width int, channels int, data binary")
    facts = {"slide": "concat('s', nth)", "mpp_x": "CASE WHEN nth % 2 = 0 THEN 0.25D ELSE 0.5D END", "mpp_y": "0.2D", "x_offset_nm": "nth * 1000 - 500", "y_offset_nm": "-nth"}
    return laid.withColumns({k: F.expr(e) for k, e in facts.items()})


def _written(spark, d) -> str:
    path = _folder(spark)
    slides.write_slides(_pages(spark, d), path, cell=16)
    return path


@query(f"WITH {PIX} SELECT slide, CASE WHEN nth % 2 = 0 THEN 0.25 ELSE 0.5 END::DOUBLE AS mpp_x, 0.2::DOUBLE AS mpp_y, 20.0::DOUBLE AS objective_power, nth * 1000 - 500 AS x_offset_nm, -nth AS y_offset_nm, 64 AS full_width, 64 AS full_height FROM (SELECT DISTINCT nth, slide FROM pix)")
def slide_headers(spark, d):
    return slides.slide_table(spark, _written(spark, d), "slides", "*.tif").drop("path")


@query(f"WITH {PIX} SELECT DISTINCT slide, (z * 2 + k)::INT AS page, (20 - 10 * k)::DOUBLE AS magnification, (z - 2) * 1000 AS z_nm, (64 - 32 * k)::INT AS height, (64 - 32 * k)::INT AS width, (3 - 2 * k)::INT AS channels FROM pix, range(2) t(k)")
def slide_planes(spark, d):
    return slides.slide_table(spark, _written(spark, d)).drop("path")


@query(f"WITH {PIX} SELECT DISTINCT slide, (z * 2)::INT AS page, (z - 2) * 1000 AS z_nm FROM pix WHERE z >= 2")
def slide_planes_pushed(spark, d):
    """The filters reach the reader."""
    return slides.slide_table(spark, _written(spark, d)).where("magnification = 20 and z_nm >= 0").select("slide", "page", "z_nm")


def _asked(spark, d) -> DataFrame:
    return table(spark, d, "customer").selectExpr(
        "c_custkey as id", "concat('s', c_custkey % 3) as slide", "CASE WHEN c_custkey % 4 < 3 THEN 20D ELSE 10D END as magnification", "(c_custkey * 37) % 110 - 30 as x", "(c_custkey * 53) % 110 - 30 as y", "1 + c_custkey % 23 as w", "1 + (c_custkey * 7) % 19 as h"
    )


def _marks(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``keep``, the sum of red, and one of all bytes weighed by channel and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = np.empty(0, np.int64)
        for batch in batches:
            total, mark = [], []
            for data in batch.column("data").to_pylist():
                image = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int64)
                if len(image) > len(weigh):
                    weigh = 1 + np.arange(2 * len(image)) % 97
                total.append(int(image[:, 0].sum()))
                mark.append(int(weigh[: len(image)] @ image @ (1, 2, 3)))
            yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in keep} | {"total": pa.array(total, pa.int64()), "mark": pa.array(mark, pa.int64())})

    return rows.select(*keep, "data").mapInArrow(run, rows.select(*keep).schema.add("total", "long").add("mark", "long"))


_INSIDE = "x1 > x0 AND y1 > y0"
_FOUND = f"box LEFT JOIN points ON {_INSIDE} AND points.slide = box.slide AND points.magnification = box.magnification AND points.z = box.z AND px_x >= x0 AND px_x < x1 AND px_y >= y0 AND px_y < y1"


@query(f"""WITH {PIX}, {ASKED} SELECT id, (box.z - 2) * 1000 AS z_nm, (CASE WHEN {_INSIDE} THEN y1 - y0 ELSE h END)::INT AS height, (CASE WHEN {_INSIDE} THEN x1 - x0 ELSE w END)::INT AS width,
coalesce(sum(r), 0)::BIGINT AS total, coalesce(sum((r + 2 * g + 3 * b) * (1 + ((px_y - y0) * (x1 - x0) + px_x - x0) % 97)), 0)::BIGINT AS mark FROM {_FOUND} GROUP BY ALL""")
def region_read(spark, d):
    """Slide files to chunks, to a store, to regions that lie within, across or outside the planes' borders."""
    path = _folder(spark)
    regions.write_store(slides.slide_table(spark, _written(spark, d), "chunks"), path)
    return _marks(regions.read_regions(spark, path, _asked(spark, d)), ("id", "z_nm", "height", "width"))


@query(f"""WITH {PIX}, {ASKED}, planes_of AS (SELECT id, w, h, box.z, coalesce(sum(r), 0) AS total, coalesce(sum((r + 2 * g + 3 * b) * (1 + ((px_y - y) * w + px_x - x) % 97)), 0) AS mark FROM {_FOUND} GROUP BY ALL)
SELECT id, h::INT AS height, w::INT AS width, z::INT AS nth, ((z - 2) * 1000)::BIGINT AS z_nm, total::BIGINT AS total, mark::BIGINT AS mark FROM planes_of""")
def region_stacks(spark, d):
    """Planes cut and stored without files; stacks padded to the regions' size."""
    path = _folder(spark)
    regions.write_store(regions.cut_planes(_pages(spark, d).where("z_nm is not null"), 24), path)
    stacks = regions.read_stacks(spark, path, _asked(spark, d))
    each = stacks.select("id", "height", "width", F.posexplode(F.arrays_zip("zs", "planes")).alias("nth", "p")).select("id", "height", "width", "nth", F.col("p.zs").alias("z_nm"), F.col("p.planes").alias("data"))
    return _marks(each, ("id", "height", "width", "nth", "z_nm"))


def _mirror_taps(kernel, name: str, side: int) -> str:
    """A kernel's sum around place i of a square, row by row, in SQL."""
    reach, top = len(kernel) // 2, side - 1
    at = lambda e: f"({top} - abs({top} - abs({e})))"
    taps = [f"({k}) * {name}[({at(f'i // {side} + ({r - reach})')} * {side} + {at(f'i % {side} + ({c - reach})')} + 1)::INT]" for r, row in enumerate(kernel) for c, k in enumerate(row) if k]
    return " + ".join(taps)


_T = lambda kernel, name: f"[{_mirror_taps(kernel, name, 32)} FOR i IN range(1024)]"
#: Pages at 10 as lists of 32 x 32, black where there is no tile.
GRAY = f"""{PIX}, spots AS (SELECT slide, z, i FROM (SELECT DISTINCT slide, z FROM pix), range(1024) r(i)),
gray AS MATERIALIZED (SELECT s.slide, s.z, list(coalesce(r, 0) ORDER BY s.i) AS px FROM spots s LEFT JOIN points p ON p.slide = s.slide AND p.magnification = 10 AND p.z = s.z AND p.px_y * 32 + p.px_x = s.i GROUP BY ALL),
blurred AS (SELECT *, [({_mirror_taps(focus.BLUR, "px", 32)} + 128) // 256 FOR i IN range(1024)] AS bl FROM gray),
kernels AS MATERIALIZED (SELECT slide, z, px, {_T(focus.LAPLACE, "px")} AS lap, {_T(focus.SOBEL_X, "px")} AS gx, {_T(focus.SOBEL_Y, "px")} AS gy, {_T(focus.LAPLACE_5, "bl")} AS lg FROM blurred)"""


def _made(spark, d) -> DataFrame:
    return blocks.block_products(regions.cut_planes(_pages(spark, d).where("magnification = 10"), 12))


@query(f"""WITH {GRAY}, v AS (SELECT slide, z, unnest(lap) AS l, unnest(gx) AS x, unnest(gy) AS y, unnest(lg) AS g FROM kernels)
SELECT slide, 10.0::DOUBLE AS magnification, (z - 2) * 1000 AS z_nm, round(avg(l * l) - avg(l) * avg(l), 6) AS vol, round(avg(x * x + y * y), 6) AS tenengrad, round(quantile_cont(abs(l)::DOUBLE, 0.75), 6) AS pvol,
round(quantile_cont((x * x + y * y)::DOUBLE, 0.75), 6) AS ptenengrad, round(avg(abs(g)), 6) AS log FROM v GROUP BY slide, z""")
def block_scores(spark, d):
    """Pages cut into blocks smaller than they are."""
    return blocks.block_scores(_made(spark, d)).withColumns(_r6(*focus.METRICS))


@query(f"""WITH {GRAY}, v AS (SELECT slide, z, unnest(px) AS px, unnest(lg) AS g, unnest(range(1024)) AS i FROM kernels)
SELECT slide, (i // 32)::INT AS y, sum(s * (i % 32 + 1))::BIGINT AS stacked, sum(m * (i % 32 + 1))::BIGINT AS mip FROM (SELECT slide, i, arg_max(px, (abs(g), -z)) AS s, max(px) AS m FROM v GROUP BY slide, i) GROUP BY slide, y""")
def block_stacks(spark, d):
    """Sums of the rows of stacks and projections, weighed by column."""
    both = F.concat("stacked", "mip")
    rows = blocks.block_images(_made(spark, d), both).select("slide", "cy", "cx", "height", "width", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                images = np.frombuffer(r["data"], np.uint8).reshape(2, r["height"], r["width"]).astype(np.int64)
                sums = (images * (r["cx"] * 12 + np.arange(r["width"]) + 1)).sum(2)
                out += [{"slide": r["slide"], "y": r["cy"] * 12 + y, "stacked": int(s), "mip": int(m)} for y, (s, m) in enumerate(sums.T)]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("slide", pa.string()), ("y", pa.int32()), ("stacked", pa.int64()), ("mip", pa.int64())]))

    parts = rows.mapInArrow(run, "slide string, y int, stacked long, mip long")
    return parts.groupBy("slide", "y").agg(F.sum("stacked").alias("stacked"), F.sum("mip").alias("mip"))


@query(f"WITH {PIX} SELECT slide, (z - 2) * 1000 AS z_nm, sum(((r * 4899 + g * 9617 + b * 1868 + 8192) >> 14) * (1 + (px_y * 64 + px_x) % 97))::BIGINT AS mark FROM points WHERE magnification = 20 GROUP BY slide, z")
def gray_planes(spark, d):
    """Brightness of the RGB pages, weighed by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = []
            for r in batch.select(["height", "width", "channels", "data"]).to_pylist():
                gray = focus.to_gray(np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["channels"])).astype(np.int64)
                marks.append(int((gray.ravel() * (1 + np.arange(gray.size) % 97)).sum()))
            yield pa.RecordBatch.from_pydict({"slide": batch.column("slide"), "z_nm": batch.column("z_nm"), "mark": pa.array(marks, pa.int64())})

    pages = _pages(spark, d).where("magnification = 20")
    return pages.select("slide", "z_nm", "height", "width", "channels", "data").mapInArrow(run, "slide string, z_nm bigint, mark bigint")
