"""Focus scores, plane ranking and stacking.

The kernels run in numpy over stacks of planes that Arrow batches bring, whether pixels come as arrays (row by row) or as
bytes; planes too large for a row go through ``blocks``. The same kernels exist as column expressions, for use within a
larger expression over small crops. Borders are mirrored without repeating the edge pixel.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions.geometry import col

LAPLACE = ((0, 1, 0), (1, -4, 1), (0, 1, 0))
#: Whole-number Gaussian weights by aperture.
GAUSS = {3: (1, 2, 1), 5: (1, 4, 6, 4, 1), 7: (2, 7, 14, 18, 14, 7, 2)}


def _binomial(n: int) -> list[int]:
    return [math.comb(n, k) for k in range(n + 1)]


def _spread(a, b) -> tuple[int, ...]:
    """The product of two polynomials."""
    return tuple(int(v) for v in np.convolve(a, b))


def _outer(column, row) -> tuple[tuple[int, ...], ...]:
    return tuple(tuple(a * b for b in row) for a in column)


def sobel(k: int) -> tuple[tuple, tuple]:
    """Kernels of the x and y gradient for the apertures 1, 3, 5 and 7: binomial smoothing across the difference."""
    if k not in (1, 3, 5, 7):
        raise ValueError("the aperture is 1, 3, 5 or 7")
    smooth, slope = ((0, 1, 0), (-1, 0, 1)) if k == 1 else (_binomial(k - 1), _spread(_binomial(k - 2), (-1, 1)))
    return _outer(smooth, slope), _outer(slope, smooth)


def laplace(k: int) -> tuple[tuple[int, ...], ...]:
    """Second differences of both axes, each smoothed across, for the apertures 1 (unsmoothed), 3, 5 and 7."""
    if k == 1:
        return LAPLACE
    smooth, second = _binomial(k - 1), _spread(_binomial(k - 3), (1, -2, 1))
    return tuple(tuple(p + q for p, q in zip(x, y, strict=True)) for x, y in zip(_outer(smooth, second), _outer(second, smooth), strict=True))


def blur(k: int) -> tuple[tuple[int, ...], ...]:
    if k not in GAUSS:
        raise ValueError("the aperture is 3, 5 or 7")
    return _outer(GAUSS[k], GAUSS[k])


SOBEL_X, SOBEL_Y = sobel(3)
BLUR, LAPLACE_5 = blur(5), laplace(5)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def convolve(px, kernel, width: int, height: int) -> Column:
    """Sums of the kernel's taps around each pixel."""
    return _let(col(px), lambda pixels: _taps(pixels, kernel, width, height))


def _taps(pixels: Column, kernel, width: int, height: int) -> Column:
    reach = len(kernel) // 2
    mirror = lambda i, n: F.lit(n - 1) - F.abs(F.lit(n - 1) - F.abs(i))

    def at(i: Column) -> Column:
        y, x = F.floor(i / width), i % width
        taps = [
            F.get(pixels, (mirror(y + (r - reach), height) * width + mirror(x + (c - reach), width)).cast("int")) * k
            for r, row in enumerate(kernel) for c, k in enumerate(row) if k
        ]
        total = taps[0]
        for t in taps[1:]:
            total = total + t
        return total

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), at)


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v) / F.size(values)


def variance_of_laplacian(px, width: int, height: int) -> Column:
    return _let(convolve(px, LAPLACE, width, height), lambda v: _mean(F.transform(v, lambda x: x * x)) - _mean(v) * _mean(v))


def gradient_energy(px, width: int, height: int, k: int = 3) -> Column:
    """Squared Sobel gradient of each pixel."""
    x, y = sobel(k)
    return F.zip_with(convolve(px, x, width, height), convolve(px, y, width, height), lambda a, b: a * a + b * b)


def tenengrad(px, width: int, height: int, k: int = 3) -> Column:
    return _mean(gradient_energy(px, width, height, k))


def percentile(values: Column, part: float) -> Column:
    """Linear interpolation between order statistics."""

    def of(s: Column) -> Column:
        at = (F.size(s) - 1) * F.lit(part)
        low = F.floor(at).cast("int")
        a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
        return a + (b - a) * (at - low)

    return _let(F.sort_array(values), of)


def laplacian_percentile(px, width: int, height: int, part: float = 0.75) -> Column:
    return percentile(F.transform(convolve(px, LAPLACE, width, height), F.abs), part)


def gradient_percentile(px, width: int, height: int, part: float = 0.75) -> Column:
    return percentile(gradient_energy(px, width, height), part)


def laplacian_of_gaussian(px, width: int, height: int, k: int = 5) -> Column:
    """Blur to whole numbers, then the Laplacian, both of aperture k."""
    half, whole = sum(GAUSS[k]) ** 2 // 2, sum(GAUSS[k]) ** 2
    blurred = F.transform(convolve(px, blur(k), width, height), lambda v: F.floor((v + half) / whole).cast("int"))
    return convolve(blurred, laplace(k), width, height)


def mean_log(px, width: int, height: int, k: int = 5) -> Column:
    """Mean absolute response."""
    return _mean(F.transform(laplacian_of_gaussian(px, width, height, k), F.abs))


def score_planes(planes: DataFrame, width: int, height: int) -> DataFrame:
    """All columns but px, and vol, tenengrad, pvol, ptenengrad and log (mean absolute response)."""
    return _map_pixels(planes, width, height, lambda stack: {k: pa.array(v) for k, v in stack_scores(stack).items()}, dict.fromkeys(METRICS, "double"))


def rank_planes(scores: DataFrame, metric: str, by: list[str], z: str = "z") -> DataFrame:
    """With ``rank`` from 1 by falling score; the higher z first on ties."""
    return scores.withColumn("rank", F.row_number().over(Wd.partitionBy(*by).orderBy(F.desc(metric), F.desc(z))))


def best_plane(scores: DataFrame, metric: str, by: list[str], z: str = "z") -> DataFrame:
    """``by`` and best_z; the lowest z on ties."""
    return scores.groupBy(*by).agg(F.max_by(z, F.struct(metric, -F.col(z))).alias("best_z"))


def max_projection(planes: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and px: the highest value of each pixel over the planes (lists of planes are folded, not exploded)."""
    lists = planes.groupBy(*by).agg(F.collect_list("px").alias("all"))
    fold = F.aggregate(F.slice("all", 2, F.size("all")), F.get("all", F.lit(0)), lambda acc, p: F.zip_with(acc, p, lambda a, b: F.greatest(a, b)))
    return lists.select(*by, fold.alias("px"))


def focus_stack(planes: DataFrame, width: int, height: int, by: list[str], z: str = "z") -> DataFrame:
    """``by`` and px: each pixel from the plane with the strongest response there, the lowest z on ties."""

    def one(table: pa.Table) -> pa.Table:
        stack = _pixels(table.sort_by(z).column("px"), width, height)
        best = np.abs(valid_log(_mirrored(stack, 4), 5)).argmax(0)  # the first plane on ties
        px = np.take_along_axis(stack, best[None], 0)[0].ravel()
        return pa.table({k: table.column(k).slice(0, 1) for k in by} | {"px": pa.array([px.tolist()], pa.list_(pa.int32()))})

    return planes.select(*by, z, "px").groupBy(*by).applyInArrow(one, planes.select(*by).schema.add("px", T.ArrayType(T.IntegerType())))


def aperture_scores(planes: DataFrame, width: int, height: int, gradients: tuple[int, ...], logs: tuple[int, ...]) -> DataFrame:
    """All columns but px, and t<k> (mean squared gradient) and l<k> (mean absolute response) for the apertures asked for."""

    def scores(stack: np.ndarray) -> dict[str, pa.Array]:
        sharp = {f"t{k}": valid_gradient(_mirrored(stack, max(1, k // 2)), k) for k in gradients}
        return {n: pa.array(v.mean((1, 2))) for n, v in (sharp | {f"l{k}": np.abs(valid_log(_mirrored(stack, k - 1), k)) for k in logs}).items()}

    return _map_pixels(planes, width, height, scores, dict.fromkeys([*[f"t{k}" for k in gradients], *[f"l{k}" for k in logs]], "double"))


# numpy kernels, over stacks (n, height, width) of whole numbers; ``valid`` ones give what the margins leave


def _weigh(stack: np.ndarray, weights, axis: int) -> np.ndarray:
    """Weighed sums of neighbours along an axis; as many places fewer as there are weights, less one."""
    n = stack.shape[axis] - len(weights) + 1
    out = None
    for i, w in enumerate(weights):
        if w:
            part = np.take(stack, range(i, i + n), axis) * w if axis else stack[i : i + n] * w
            out = part if out is None else out + part
    return out


def _both(stack: np.ndarray, column, row) -> np.ndarray:
    return _weigh(_weigh(stack, column, 1), row, 2)


def mirror(at: np.ndarray, n: int) -> np.ndarray:
    """Places on a line of n, mirrored at both ends without repeating the edge; a single place is repeated."""
    return (n - 1) - np.abs((n - 1) - at % max(1, 2 * n - 2))


def _mirrored(stack: np.ndarray, reach: int) -> np.ndarray:
    index = lambda n: mirror(np.arange(-reach, n + reach), n)
    return stack[:, index(stack.shape[1])[:, None], index(stack.shape[2])]


def valid_laplace(stack: np.ndarray) -> np.ndarray:
    """Unsmoothed Laplacian; a margin of 1."""
    return stack[:, :-2, 1:-1] + stack[:, 2:, 1:-1] + stack[:, 1:-1, :-2] + stack[:, 1:-1, 2:] - 4 * stack[:, 1:-1, 1:-1]


def valid_gradient(stack: np.ndarray, k: int) -> np.ndarray:
    """Squared Sobel gradient of aperture k; a margin of half of it, 1 for the aperture 1."""
    smooth, slope = ((0, 1, 0), (-1, 0, 1)) if k == 1 else (_binomial(k - 1), _spread(_binomial(k - 2), (-1, 1)))
    return _both(stack, smooth, slope) ** 2 + _both(stack, slope, smooth) ** 2


def valid_log(stack: np.ndarray, k: int) -> np.ndarray:
    """A blur to whole numbers, then the Laplacian, both of aperture k (3, 5 or 7); a margin of k - 1."""
    whole = sum(GAUSS[k]) ** 2
    blurred = (_both(stack, GAUSS[k], GAUSS[k]) + whole // 2) // whole
    smooth, second = _binomial(k - 1), _spread(_binomial(k - 3), (1, -2, 1))
    return _both(blurred, smooth, second) + _both(blurred, second, smooth)


METRICS = ("vol", "tenengrad", "pvol", "ptenengrad", "log")


def stack_scores(stack: np.ndarray) -> dict[str, np.ndarray]:
    """The five scores of each plane of a stack."""
    lap, grad, log = valid_laplace(_mirrored(stack, 1)), valid_gradient(_mirrored(stack, 1), 3), np.abs(valid_log(_mirrored(stack, 4), 5))
    flat = lambda x: x.reshape(len(x), -1)
    mean = flat(lap).mean(1)
    return {"vol": (flat(lap) ** 2).mean(1) - mean * mean, "tenengrad": flat(grad).mean(1), "pvol": np.percentile(np.abs(flat(lap)), 75, axis=1), "ptenengrad": np.percentile(flat(grad), 75, axis=1), "log": flat(log).mean(1)}


def _pixels(column: pa.Array, width: int, height: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, height, width)


def _map_pixels(planes: DataFrame, width: int, height: int, scores: Callable[[np.ndarray], dict[str, pa.Array]], made: dict[str, str]) -> DataFrame:
    """All columns but px, and what ``scores`` makes of each batch's stack; planes are rows, nothing is shuffled."""
    kept = [c for c in planes.columns if c != "px"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in kept} | scores(_pixels(batch.column("px"), width, height)))

    schema = planes.select(*kept).schema
    for name in made:
        schema = schema.add(name, T.DoubleType())
    return planes.select(*kept, "px").mapInArrow(run, schema)


# numpy kernels for tiles of production size


def to_gray(image: np.ndarray) -> np.ndarray:
    """Brightness of an (h, w, 3) image with weights .299, .587, .114; (h, w) and (h, w, 1) pass."""
    if image.ndim == 2 or image.shape[2] == 1:
        return image.reshape(image.shape[:2])
    return ((image.astype(np.int64) @ np.array([4899, 9617, 1868]) + (1 << 13)) >> 14).astype(np.uint8)


def numpy_log(gray: np.ndarray, k: int = 5) -> np.ndarray:
    return valid_log(_mirrored(gray.astype(np.int64)[None], k - 1), k)[0]


def numpy_scores(gray: np.ndarray) -> dict[str, float]:
    return {k: float(v[0]) for k, v in stack_scores(gray.astype(np.int64)[None]).items()}


def _image(row: dict) -> np.ndarray:
    return np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["channels"])


def score_binary_planes(planes: DataFrame, keep: list[str]) -> DataFrame:
    """Scores of planes given as height, width, channels and data (uint8 bytes): one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [numpy_scores(to_gray(_image(r))) for r in batch.select(["height", "width", "channels", "data"]).to_pylist()]
            yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in keep} | {m: pa.array([s[m] for s in scores], pa.float64()) for m in ("vol", "tenengrad", "pvol", "ptenengrad", "log")})

    schema = planes.select(*keep).schema
    for m in ("vol", "tenengrad", "pvol", "ptenengrad", "log"):
        schema = schema.add(m, "double")
    return planes.select(*keep, "height", "width", "channels", "data").mapInArrow(run, schema)


def stack_binary_planes(planes: DataFrame, by: list[str]) -> DataFrame:
    """``by``, stacked and mip (uint8 bytes): folds over a tile's planes by z with running bests."""

    def one(table: pa.Table) -> pa.Table:
        best = stacked = mip = None
        for row in table.sort_by("z").to_pylist():
            image = _image(row)
            response = np.abs(numpy_log(to_gray(image)))
            if best is None:
                best, stacked, mip = response, image.copy(), image.copy()
                continue
            better = response > best
            best, stacked, mip = np.where(better, response, best), np.where(better[..., None], image, stacked), np.maximum(mip, image)
        return pa.table({k: table.column(k).slice(0, 1) for k in by} | {"stacked": pa.array([stacked.tobytes()], pa.binary()), "mip": pa.array([mip.tobytes()], pa.binary())})

    schema = planes.select(*by).schema.add("stacked", "binary").add("mip", "binary")
    return planes.select(*by, "z", "height", "width", "channels", "data").groupBy(*by).applyInArrow(one, schema)
