"""Choices in turn: each chooser takes the item it likes best of those that no earlier one has taken."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from tilewright.operators.ordered import running_sums
from tilewright.plans.storage import discard, materialize

#: Options of a group that one task goes through at most.
FINISH = 1 << 20


def settle(options: DataFrame, by: list[str], chooser: str, turn: str, item: str, prefer: list[Column]) -> DataFrame:
    """``by``, chooser, turn and item of what is taken in each ``by``, of options that each have a turn (one for each chooser).

    Groups (``by``) of ``FINISH`` options at most are gone through in turn, whole groups dealt to tasks. While there is a
    larger one, two steps alternate. In the first, the earliest choosers of each group, with ``FINISH`` options together at
    most, are gone through in turn, since no later one can change what they take; their items leave. In the second, all
    options take part in a round: an option is settled if the item is the chooser's best of those left and no waiting
    chooser of an earlier turn could take it; settled choosers and items leave with all their options. The earliest chooser
    always is settled, so this ends: soon by the first step where many want the same items, by the second where few do."""
    left, settled, early = materialize(options), [], False
    by_chooser, by_item = [*by, chooser], [*by, item]
    columns = [*by, chooser, turn, item]
    while True:
        size = left.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n").alias("largest"), F.sum("n").alias("all")).first()  # one row
        if (size.largest or 0) <= FINISH:
            return reduce(DataFrame.unionAll, [*settled, _finish(left, by, columns, prefer, size.all or 0)])
        early = not early and FINISH > 0
        if early:
            sizes = left.groupBy(*by_chooser, turn).agg(F.count("*").alias("_options"))
            upto = running_sums(sizes, by, [F.col(turn).asc_nulls_last(), F.col(chooser)], {"_upto": F.col("_options")})
            first = materialize(upto.where(F.col("_upto") <= FINISH).select(*by_chooser))
            taken = materialize(_finish(left.join(first, by_chooser, "left_semi"), by, columns, prefer, size.all))
            given, left = left, materialize(left.join(first, by_chooser, "left_anti").join(taken.select(*by_item), by_item, "left_anti"))
            settled.append(taken)
            discard(given, first)
            continue
        best = F.row_number().over(Wd.partitionBy(*by_chooser).orderBy(*prefer)) == 1
        marked = left.withColumn("_best", best).withColumn("_now", (F.min(turn).over(Wd.partitionBy(*by_item)) == F.col(turn)) & F.col("_best"))
        gone = marked.withColumn("_gone", F.max("_now").over(Wd.partitionBy(*by_item)))
        gone = materialize(gone.withColumn("_out", F.col("_gone") | F.max("_now").over(Wd.partitionBy(*by_chooser))).drop("_gone", "_best"))
        settled.append(gone.where("_now").select(*columns))
        discard(left)
        left = gone.where("not _out").drop("_now", "_out")


def _finish(options: DataFrame, by: list[str], columns: list[str], prefer: list[Column], n: int) -> DataFrame:
    """What is taken when choosers come one after another, of ``n`` options at most; groups have ``FINISH`` of them at most,
    and small ones share a task."""
    deal = F.pmod(F.xxhash64(*by), F.lit(1 + 4 * n // max(FINISH, 1))) if by else F.lit(0)
    liking = F.row_number().over(Wd.partitionBy("_deal", *columns[:-2]).orderBy(*prefer))  # one shuffle serves both
    liked = options.withColumn("_deal", deal).repartition("_deal").select(*columns, "_deal", liking.alias("_liking"))
    return liked.groupBy("_deal").applyInArrow(lambda t: _in_turn(t, columns), options.select(*columns).schema)


def _in_turn(table: pa.Table, columns: list[str]) -> pa.Table:
    """The options that are taken when choosers come one after another; ``columns``: by, chooser, turn and item."""
    ordered = table.sort_by([(k, "ascending") for k in [*columns[:-3], columns[-2], columns[-3], "_liking"]]).select(columns)
    numbers = [pc.dictionary_encode(ordered.column(c).combine_chunks()).indices.to_numpy().astype(np.int64) for c in columns]
    group = np.zeros(ordered.num_rows, np.int64)
    for n in numbers[:-3]:
        group = np.unique(group * (n.max(initial=0) + 1) + n, return_inverse=True)[1]
    pair = lambda n: (group * (n.max(initial=0) + 1) + n).tolist()
    served, used, taken = set(), set(), []
    for i, (chooser, item) in enumerate(zip(pair(numbers[-3]), pair(numbers[-1]), strict=True)):
        if chooser not in served and item not in used:
            served.add(chooser)
            used.add(item)
            taken.append(i)
    return ordered.take(pa.array(taken, pa.int64()))
