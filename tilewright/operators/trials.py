"""Random search: a table of trials with sampled parameters, run by tasks, resumed by what is already there."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def search_space(value: str) -> dict[str, list]:
    """{name: [kind, low, high]} or {name: ["categorical", choices]}, from JSON text or a path to it."""
    text = value if value.lstrip().startswith("{") else Path(value).read_text()
    space = json.loads(text)
    for name, (kind, *rest) in space.items():
        if kind not in ("float", "log_float", "int", "categorical"):
            raise ValueError(f"{name}: unknown kind {kind}")
        if kind != "categorical" and not rest[0] <= rest[1]:
            raise ValueError(f"{name}: empty range")
    return space


def _sampled(name: str, spec: list, seed: int) -> Column:
    u = F.pmod(F.xxhash64("trial", F.lit(name), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    kind, *rest = spec
    if kind == "categorical":
        choices = F.array(*[F.lit(str(c)) for c in rest[0]])
        return F.get(choices, F.floor(u * len(rest[0])).cast("int"))
    low, high = rest
    if kind == "int":
        return (F.floor(u * (high - low + 1)) + low).cast("string")
    if kind == "log_float":
        return F.exp(u * (math.log(high) - math.log(low)) + math.log(low)).cast("string")
    return (u * (high - low) + low).cast("string")


def sample_trials(spark: SparkSession, space: dict[str, list], iterations: int, seed: int, done: DataFrame | None = None) -> DataFrame:
    """trial and params of the trials that are still to be run: iterations less those in ``done``."""
    trials = spark.range(iterations).withColumnRenamed("id", "trial")
    if done is not None:
        trials = trials.join(done.select("trial"), "trial", "left_anti")
    pairs = [c for name, spec in space.items() for c in (F.lit(name), _sampled(name, spec, seed))]
    return trials.select("trial", F.create_map(*pairs).alias("params"))


def run_trials(trials: DataFrame, objective: Callable[[dict[str, str]], float | None]) -> DataFrame:
    """trial, score and params; a trial that fails scores 0, one without a result is null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores = []
            for params in frame["params"]:
                try:
                    scores.append(objective(dict(params)))
                except Exception:
                    scores.append(0.0)
            yield frame.assign(score=pd.Series(scores, index=frame.index, dtype="float64"))[["trial", "score", "params"]]

    return trials.mapInPandas(run, "trial long, score double, params map<string,string>")
