"""Numbers and running sums along an order, without bringing a whole order to one task.

Rows are dealt to ranges of the order and written to shared storage, so that the ranges stay what they are; each range's
totals are few enough for one window, and what comes before a range is where the sums within it start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from tilewright.plans.storage import materialize


def running_sums(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with inclusive running sums along ``order`` within each ``by``; the order should have no ties.

    A group that holds most of the rows lies in many ranges. Nulls in ``by`` are a group of their own."""
    keys = [F.col(c) for c in by]
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = rows.withColumns({f"_v_{n}": v for n, v in sums.items()})
    dealt = materialize(values.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy(*by, "_range").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    earlier = Wd.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Wd.unboundedPreceding, -1)  # a row for each range
    before = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_v_{n}") for n in sums], F.lit(0).alias("_own"))
    every = dealt.withColumn("_own", F.lit(1)).unionByName(before, allowMissingColumns=True)  # what comes before a range is its first row, so nothing is joined
    within = Wd.partitionBy(*keys, "_range").orderBy("_own", *order).rowsBetween(Wd.unboundedPreceding, Wd.currentRow)
    summed = every.withColumns({f"_w_{n}": F.sum(f"_v_{n}").over(within) for n in sums}).where("_own = 1")
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in sums]
    return summed.select(*kept, *[F.col(f"_w_{n}").alias(n) for n in sums])


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str = "n", first: int = 0) -> DataFrame:
    """``rows`` with dense numbers along ``order`` within each ``by``, from ``first`` on."""
    counted = running_sums(rows, by, order, {name: F.lit(1).cast("long")})
    return counted.withColumn(name, F.col(name) + F.lit(first - 1))
