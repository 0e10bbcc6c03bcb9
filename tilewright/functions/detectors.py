"""Detectors as functions from an image to boxes, run over tiles by Arrow batches with one model for each worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: image (h, w, c) -> boxes (n, 4) and scores (n)
Detector = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
_factories: dict[str, Callable[..., Detector]] = {}
_loaded: dict[tuple, Detector] = {}


def register(name: str, factory: Callable[..., Detector]) -> None:
    _factories[name] = factory


def bright_blocks(size: int = 8, level: float = 160.0) -> Detector:
    """A deterministic stand-in: blocks whose mean is at the level or above, scored by the mean."""

    def predict(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, w = (d // size * size for d in image.shape[:2])
        means = image[:h, :w].mean(2).reshape(h // size, size, w // size, size).mean((1, 3))
        y, x = np.nonzero(means >= level)
        return np.stack([x, y, x + 1, y + 1], axis=1) * float(size), means[y, x] / 255

    return predict


register("bright_blocks", bright_blocks)


def sanitize(boxes: np.ndarray, scores: np.ndarray, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Boxes clipped to the tile, without empty ones; missing scores cut the boxes to as many."""
    n = min(len(boxes), len(scores))
    boxes = np.clip(np.asarray(boxes, float).reshape(-1, 4)[:n], 0, [width, height, width, height])
    keep = (boxes[:, 2] > boxes[:, 0]) & (boxes[:, 3] > boxes[:, 1])
    return boxes[keep], np.asarray(scores, float)[:n][keep]


def detect(tiles: DataFrame, name: str, keep: list[str], threshold: float = 0.5, **options) -> DataFrame:
    """``keep``, nth, x1, y1, x2, y2, score: the boxes found in tiles (height, width, channels, data)."""
    key = (name, *sorted(options.items()))
    factory = _factories[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded.setdefault(key, factory(**options)) if key not in _loaded else _loaded[key]
        for batch in batches:
            at, found = [], []
            for i, r in enumerate(batch.select(["height", "width", "channels", "data"]).to_pylist()):
                image = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["channels"])
                boxes, scores = sanitize(*model(image), r["width"], r["height"])
                for k, (b, s) in enumerate(zip(boxes.tolist(), scores.tolist(), strict=True)):
                    if s >= threshold:
                        at.append(i)
                        found.append((k, *b, s))
            columns = list(zip(*found, strict=True)) if found else [()] * 6
            types = [pa.int32()] + [pa.float64()] * 5
            yield pa.RecordBatch.from_pydict({k: batch.column(k).take(pa.array(at, pa.int64())) for k in keep} | {n: pa.array(c, t) for n, c, t in zip(("nth", "x1", "y1", "x2", "y2", "score"), columns, types, strict=True)})

    schema = tiles.select(*keep).schema.add("nth", T.IntegerType())
    for n in ("x1", "y1", "x2", "y2", "score"):
        schema = schema.add(n, T.DoubleType())
    return tiles.select(*keep, "height", "width", "channels", "data").mapInArrow(run, schema)
