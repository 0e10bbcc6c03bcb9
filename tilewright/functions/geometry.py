"""Boxes and coordinates as column expressions. Boxes are given by four columns; touching edges do not intersect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def intersects(a: list[Column], b: list[Column]) -> Column:
    """Open-interval overlap of two (x1, y1, x2, y2)."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def _overlap(a: list[Column], b: list[Column]) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def _area(a: list[Column]) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, a[2] - a[0]) * F.greatest(zero, a[3] - a[1])


def iou_plain(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union; 0 where the boxes do not meet."""
    inter = _overlap(a, b)
    return F.when(inter == 0, F.lit(0.0)).otherwise(F.try_divide(inter, _area(a) + _area(b) - inter))


def iou_eps(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union with 1e-7 added to the union."""
    inter = _overlap(a, b)
    return inter / (_area(a) + _area(b) - inter + F.lit(1e-7))


def clip_to(x1, y1, x2, y2, width, height) -> list[Column]:
    """A box clipped to (0, 0, width, height)."""
    zero = F.lit(0)
    hold = lambda v, most: F.least(F.greatest(col(v), zero), col(most))
    return [hold(x1, width), hold(y1, height), hold(x2, width), hold(y2, height)]


def crop(tile: list[Column], box: list[Column]) -> tuple[list[Column], list[Column]]:
    """(cropped, uncropped) xywh of a box relative to a tile; both given as xywh."""
    x, y = box[0] - tile[0], box[1] - tile[1]
    left, top = F.greatest(x, F.lit(0)), F.greatest(y, F.lit(0))
    right, bottom = F.least(x + box[2], tile[2]), F.least(y + box[3], tile[3])
    return [left, top, right - left, bottom - top], [x, y, box[2], box[3]]


def is_valid_box(crop_w, crop_h, full_w, full_h, min_area: int = 16, min_visible: float = 0.25) -> Column:
    """Enough area, and strictly more than the visible part asked for."""
    area = col(crop_w) * col(crop_h)
    return (area >= min_area) & F.coalesce(F.try_divide(area, col(full_w) * col(full_h)) > min_visible, F.lit(False))


def touches_edge(x, y, w, h, width, height) -> Column:
    return (col(x) <= 0) | (col(y) <= 0) | (col(x) + col(w) >= col(width)) | (col(y) + col(h) >= col(height))


def _scale(meta, magnification) -> tuple[Column, Column, Column]:
    base = col(meta["mpp_x"]) * 1000
    step = base * col(meta["objective_power"]) / magnification
    return step, col(meta["x_offset_nm"]) - col(meta["full_width"]) / 2 * base, col(meta["y_offset_nm"]) - col(meta["full_height"]) / 2 * base


META = {k: k for k in ("mpp_x", "objective_power", "x_offset_nm", "y_offset_nm", "full_width", "full_height")}


def bounds_to_pixels(x, y, w, h, magnification: float, meta: dict = META) -> list[Column]:
    """Nanometre xywh to whole pixels, half to even. The x resolution serves both axes."""
    step, ox, oy = _scale(meta, magnification)
    return [F.bround(v).cast("int") for v in ((col(x) - ox) / step, (col(y) - oy) / step, col(w) / step, col(h) / step)]


def pixels_to_nm(x1, y1, x2, y2, magnification: float, meta: dict = META) -> list[Column]:
    """Pixel corners to nanometre xywh, unrounded; sizes are at least 0."""
    step, ox, oy = _scale(meta, magnification)
    zero = F.lit(0.0)
    return [ox + col(x1) * step, oy + col(y1) * step, F.greatest(zero, (col(x2) - col(x1)) * step), F.greatest(zero, (col(y2) - col(y1)) * step)]


def circle_to_box(cx, cy, radius) -> list[Column]:
    return [col(cx) - col(radius), col(cy) - col(radius), col(radius) * 2, col(radius) * 2]


def rounded_corners(x, y, w, h) -> list[Column]:
    """Both corners of a box in whole numbers, half to even; the far one is rounded as a sum."""
    return [F.bround(c).cast("long") for c in (col(x), col(y), col(x) + col(w), col(y) + col(h))]


def rounded_centre(x, y, w, h) -> list[Column]:
    """The middle of the rounded corners, half to even."""
    x1, y1, x2, y2 = rounded_corners(x, y, w, h)
    return [F.bround((x1 + x2) / 2).cast("long"), F.bround((y1 + y2) / 2).cast("long")]


def box_to_circle(x, y, w, h) -> list[Column]:
    """Centre (of the rounded corners) and radius of the circle written for a box; the radius comes from the short side
    and is at least 1."""
    radius = F.greatest(F.lit(1), F.bround(F.least(F.abs(col(w)), F.abs(col(h))) / 2))
    return [*rounded_centre(x, y, w, h), radius.cast("long")]


def to_normalised(x, y, w, h, width, height) -> list[Column]:
    """xywh to centre and size as parts of the image."""
    return [(col(x) + col(w) / 2) / col(width), (col(y) + col(h) / 2) / col(height), col(w) / col(width), col(h) / col(height)]


def corners(x, y, w, h) -> list[Column]:
    """xywh to x1, y1, x2, y2."""
    return [col(x), col(y), col(x) + col(w), col(y) + col(h)]


def sides(x1, y1, x2, y2) -> list[Column]:
    """x1, y1, x2, y2 to xywh."""
    return [col(x1), col(y1), col(x2) - col(x1), col(y2) - col(y1)]


def to_global(x1, y1, x2, y2, tile_x, tile_y) -> list[Column]:
    """A box within a tile, in the coordinates that the tile's origin is given in."""
    return [col(x1) + col(tile_x), col(y1) + col(tile_y), col(x2) + col(tile_x), col(y2) + col(tile_y)]


def is_empty_crop(w, h) -> Column:
    """Whether a cut has no pixels."""
    return (col(w) <= 0) | (col(h) <= 0)


def in_range(value, low: float | None, high: float | None) -> Column:
    """Within both bounds; true for all unless both are given."""
    return F.lit(True) if low is None or high is None else col(value).between(low, high)


def diameter_px(w_nm, h_nm, mpp_x, mpp_y) -> Column:
    """Mean of the two axes, each with its own resolution; null where a resolution is not positive."""
    return F.when((col(mpp_x) > 0) & (col(mpp_y) > 0), (col(w_nm) / 1000 / col(mpp_x) + col(h_nm) / 1000 / col(mpp_y)) / 2)


def to_uint8(v) -> Column:
    return F.least(F.greatest(col(v), F.lit(0)), F.lit(255)).cast("int")
