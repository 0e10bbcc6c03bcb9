"""Dataset statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F


def distribution(rows: DataFrame, by: str, value: Column) -> DataFrame:
    """total of each group and its percentage of all, largest first."""
    out = rows.groupBy(by).agg(F.sum(value).alias("total"))
    share = F.coalesce(F.try_divide(F.col("total") * 100.0, F.sum("total").over(Wd.partitionBy(F.lit(0)))), F.lit(0.0))
    return out.withColumn("percent", share).orderBy(F.desc("total"), by)


def annotation_density(regions: DataFrame, annotations: DataFrame, slide: str, tile: int = 1024) -> DataFrame:
    """Annotations by tile of each slide's regions (w, h); NaN where there is no tile."""
    area = regions.groupBy(slide).agg(F.sum(F.ceil(F.col("w") / tile) * F.ceil(F.col("h") / tile)).alias("n_tiles"))
    count = annotations.groupBy(slide).agg(F.count("*").alias("n_annotations"))
    both = area.join(count, slide, "left").na.fill(0, ["n_annotations"])
    return both.withColumn("density", F.when(F.col("n_tiles") > 0, F.col("n_annotations") / F.col("n_tiles")).otherwise(F.lit(float("nan"))))


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """bin, low and n of equal-width bins over the value's range; the last one is closed."""
    ends = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    placed = rows.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends))  # one row
    return placed.select(at.cast("int").alias("bin"), (F.col("lo") + at * width).alias("low")).groupBy("bin").agg(F.min("low").alias("low"), F.count("*").alias("n"))


def split_summary(rows: DataFrame, split: str, cls: str, classes: list[str], flag: Column, size: str) -> DataFrame:
    """By split: rows, each class's count (0 if none), flagged rows and their percentage, median and mean size."""
    counts = [F.count_if(F.col(cls) == c).alias(f"n_{c}") for c in classes]
    percent = F.coalesce(F.try_divide(F.count_if(flag) * 100.0, F.count("*")), F.lit(0.0))
    return rows.groupBy(split).agg(F.count("*").alias("n"), *counts, F.count_if(flag).alias("n_flagged"), percent.alias("percent_flagged"), F.median(size).alias("median_size"), F.avg(size).alias("mean_size"))


def score_by_z(scores: DataFrame, metric: str, z: str = "z") -> DataFrame:
    """Mean and population deviation by z."""
    return scores.groupBy(z).agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"), F.count("*").alias("n"))


def metric_agreement(best: DataFrame, a: str, b: str) -> DataFrame:
    """How many rows agree, and the percentage of all (of one, if there are none)."""
    return best.agg(F.count_if(F.col(a) == F.col(b)).alias("agree"), F.count("*").alias("n")).withColumn("percent", F.col("agree") * 100.0 / F.greatest(F.col("n"), F.lit(1)))


def score_matrix(scores: DataFrame, key: str, metric: str, zs: list[int], z: str = "z") -> DataFrame:
    """key by z; missing cells are 0."""
    return scores.groupBy(key).pivot(z, zs).agg(F.first(metric)).select(key, *[F.coalesce(F.col(str(k)), F.lit(0.0)).alias(f"z{k}") for k in zs])


def best_worst(scores: DataFrame, by: list[str], metric: str, z: str = "z") -> DataFrame:
    """Best and worst plane (the lowest z on ties) and how far their scores are apart."""
    return scores.groupBy(*by).agg(
        F.max_by(z, F.struct(metric, -F.col(z))).alias("best_z"), F.min_by(z, F.struct(metric, z)).alias("worst_z"), (F.max(metric) - F.min(metric)).alias("spread")
    )


def widest(spreads: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of largest spread."""
    return spreads.orderBy(F.desc("spread"), key).limit(n)


def proportions(counts: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each column's percentage of its row's sum; 0 where the sum is 0 or a count is missing."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in columns])
    return counts.select(key, *[F.coalesce(F.try_divide(F.col(c) * 100.0, total), F.lit(0.0)).alias(c) for c in columns])


def folded_counts(rows: DataFrame, by: str, value: Column, spellings: dict[str, list[str]]) -> DataFrame:
    """``by`` and how many rows have each of the values, whichever of its spellings they use."""
    return rows.groupBy(by).agg(*[F.count_if(value.isin(s)).alias(n) for n, s in spellings.items()])


def percent_labels(value: str, total: Column | None) -> Column:
    """The text over a bar: count and percentage of the total, the count alone where the total is 0 or null."""
    count = F.format_string("%d", F.col(value).cast("long"))
    if total is None:
        return count
    return F.when(F.coalesce(total, F.lit(0)) > 0, F.concat(count, F.format_string(" (%.1f%%)", F.col(value) * 100.0 / total))).otherwise(count)


def before_and_after(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """``by``, how many rows there were, are left and went."""
    count = lambda df, n: df.groupBy(*by).agg(F.count("*").alias(n))
    both = count(before, "n_before").join(count(after, "n_after"), by, "left").na.fill(0, ["n_after"])
    return both.withColumn("n_removed", F.col("n_before") - F.col("n_after"))
