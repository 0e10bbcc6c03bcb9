"""Which planes of a tile go into a dataset, and the images and boxes that follow."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.geometry import is_valid_box
from tilewright.operators.focus import rank_planes
from tilewright.sources.writers import image_name, select_boxes

KINDS = ("best_plane", "plane", "planes", "all_planes", "top_k_planes")


@dataclass(frozen=True)
class PlaneChoice:
    """``planes`` for plane and planes, ``top_k`` for top_k_planes, ``metric`` (a score column) for ranked kinds."""

    kind: str
    planes: tuple[int, ...] = field(default=())
    top_k: int = 5
    metric: str = "log"

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {', '.join(KINDS)}")
        if self.kind in ("plane", "planes") and not self.planes:
            raise ValueError("name the planes")

    @classmethod
    def parse(cls, kind: str, planes: str | None = None, top_k: int | None = None, metric: str = "log") -> PlaneChoice:
        """``planes`` as numbers between commas."""
        return cls(kind, tuple(int(p) for p in planes.split(",")) if planes else (), top_k or 5, metric)


def choose_planes(scores: DataFrame, choice: PlaneChoice, by: list[str]) -> DataFrame:
    """``by`` and z of the planes that are chosen; planes a stack does not have are left out."""
    if choice.kind in ("plane", "planes"):
        return scores.where(F.col("z").isin(list(choice.planes))).select(*by, "z")
    if choice.kind == "all_planes":
        return scores.select(*by, "z")
    most = 1 if choice.kind == "best_plane" else choice.top_k
    return rank_planes(scores, choice.metric, by).where(F.col("rank") <= most).select(*by, "z")


def dataset_records(scores: DataFrame, boxes: DataFrame, splits: DataFrame, choice: PlaneChoice, single_class: bool = False, label_base: int = 1) -> tuple[DataFrame, DataFrame]:
    """Images (split, stem, tile, z, file_name) and boxes (file_name, ann_idx, category_id, x, y, w, h).

    ``scores``: stem, tile, z and metrics; ``boxes``: stem, tile, ann_idx, label, x, y, w, h (cropped) and full_w,
    full_h; ``splits``: stem and split. Stems without a split are left out; boxes too small or mostly hidden go."""
    images = choose_planes(scores, choice, ["stem", "tile"]).join(splits, "stem")
    images = images.withColumn("file_name", image_name("stem", F.concat(F.lit("tile_"), F.col("tile").cast("string")), "z"))
    good = select_boxes(boxes.where(is_valid_box("w", "h", "full_w", "full_h")), single_class, label_base)
    joined = images.join(good, ["stem", "tile"]).select("file_name", "ann_idx", "category_id", "x", "y", "w", "h")
    return images.select("split", "stem", "tile", "z", "file_name"), joined


def skipped_tiles(tiles: DataFrame, scores: DataFrame, splits: DataFrame, choice: PlaneChoice) -> DataFrame:
    """stem, tile and skip_reason of the tiles that give no image: no split, no planes, none of the planes asked for."""
    chosen = choose_planes(scores, choice, ["stem", "tile"]).select("stem", "tile").distinct().withColumn("_chosen", F.lit(True))
    planes = scores.select("stem", "tile").distinct().withColumn("_planes", F.lit(True))
    out = tiles.select("stem", "tile").join(splits.select("stem", "split"), "stem", "left").join(planes, ["stem", "tile"], "left").join(chosen, ["stem", "tile"], "left")
    reason = F.when(F.col("split").isNull(), "no split").when(F.col("_planes").isNull(), "no planes").when(F.col("_chosen").isNull(), "no such plane")
    return out.select("stem", "tile", reason.alias("skip_reason")).where("skip_reason is not null")
