"""What is made of a tile's planes: strategies that leave one image, and the products kept beside the tiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators import focus

#: planes (tile columns, z, px), width, height, tile columns -> tile columns and px
Compression = Callable[[DataFrame, int, int, list[str]], DataFrame]

RANKINGS = {"rank_log": "log", "rank_vol": "vol", "rank_tenengrad": "tenengrad"}


def stack_planes(planes: DataFrame, width: int, height: int, by: list[str]) -> DataFrame:
    return focus.focus_stack(planes, width, height, by)


def sharpest_plane(planes: DataFrame, width: int, height: int, by: list[str]) -> DataFrame:
    """The plane of the highest mean response, whole; the higher z on ties."""
    scored = focus.score_planes(planes.withColumn("_px", F.col("px")), width, height)
    return scored.groupBy(*by).agg(F.max_by("_px", F.struct("log", "z")).alias("px"))


def project_planes(planes: DataFrame, width: int, height: int, by: list[str]) -> DataFrame:
    return focus.max_projection(planes, by)


COMPRESSIONS: dict[str, Compression] = {"focus_stack": stack_planes, "best_plane": sharpest_plane, "max_projection": project_planes}


def compression(name: str) -> Compression:
    """The strategy of that name; others may be added to ``COMPRESSIONS``."""
    if name not in COMPRESSIONS:
        raise ValueError(f"unknown compression {name}; there are {', '.join(sorted(COMPRESSIONS))}")
    return COMPRESSIONS[name]


def make_products(planes: DataFrame, width: int, height: int, by: list[str], stacked: bool = True, rankings: bool = True, mip: bool = True) -> DataFrame:
    """``by`` and what is asked for: the stacked image, the planes' z by each ranking (best first), the projection.

    The parts are separate aggregations over one scan; a tile is in all or none of them."""
    parts = []
    if stacked:
        parts.append(focus.focus_stack(planes, width, height, by).withColumnRenamed("px", "stacked"))
    if rankings:
        scores = focus.score_planes(planes, width, height)
        order = lambda m: F.transform(F.sort_array(F.collect_list(F.struct(m, "z")), asc=False), lambda x: x["z"])
        parts.append(scores.groupBy(*by).agg(*[order(m).alias(n) for n, m in RANKINGS.items()]))
    if mip:
        parts.append(focus.max_projection(planes, by).withColumnRenamed("px", "mip"))
    if not parts:
        raise ValueError("ask for one product at least")
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, by)
    return out
