"""Detections as a stream: raw rows are appended while tiles arrive, and a batch job replaces them by the best ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tilewright.operators.spatial import deduplicate


def append_detections(tiles: DataFrame, detect: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Run ``detect`` on each micro-batch of a tile stream and add its rows to ``path``, once for every batch."""

    def write(batch: DataFrame, number: int) -> None:
        detect(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")  # a batch that is tried again replaces itself

    return tiles.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finish(raw: DataFrame, path: str, iou: float = 0.5) -> None:
    """The deduplicated detections of what the stream has appended."""
    deduplicate(raw.drop("batch"), iou).write.mode("overwrite").parquet(path)
