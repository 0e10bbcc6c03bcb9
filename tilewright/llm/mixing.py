"""Mixing sources to target weights along a time-varying curriculum.

Sources in code-point order (null last) weigh 5, 2, 1, 5, 2, 1, ...; together they share ``SHARE`` of all words, none
more than ``CAP`` times its own size, and what the cap cuts off is shared again by weight. A source's share over
training time u in [0, 1] follows the linear schedule w(u) = 1 + tilt * (2u - 1), whose integral D(u) = u + tilt *
(u^2 - u) is the part of the source's demand, its target, that has been met by u. Documents stand in a hashed order
within their source, and that order is gone through again and again until the demand is met: each pass through a
document takes its words as the next ones of the demand, and gets the position where D reaches the middle of them, found
by inverting the quadratic. Documents are then sorted by position over ranges. So over any stretch of training a source
gives the words that its schedule asks for there, to within a document, whether its target is below its size or above.

A source that wants ``target`` words takes every document floor(target / size) times over and the next documents in
order once more, the last of them in part, so the words taken meet the target to within one word.

Cumulative sums never bring a whole source to one task: a source's documents are dealt into about sqrt(rows) buckets
by the leading bits of their hash, which covers id and text; bucket sums are accumulated per source, and rows within a
bucket.

Edge cases: null or empty texts have size 0, take 0 words and stand where their neighbours of the first pass stand (at
the end, if the demand ends before); other documents that the mix leaves out have no position and come last; a null
source is a source of its own; rows with the same doc_id are documents of their own, tied rows in an arbitrary but equal-valued
order; null ids are kept; an empty table gives no rows. Other columns are dropped.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

#: The weights that repeat over the sources, the share of all words that is taken, and the cap on repeats.
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0
#: How a source's weight leans to the start (negative) or the end of training, by its place in the order.
TILTS = (-0.6, 0.0, 0.6)
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target and tilt of each source, from (source, size, ...) rows.

    A source is capped if the level at which words are shared by weight would exceed its cap. Sorted by cap / weight,
    the capped ones are a prefix. The level left for the others once a prefix is capped rises along that prefix and
    falls after it, so it is the highest one; this takes two running sums over the sources, not over documents."""
    order = Wd.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    nth = F.row_number().over(order) - 1
    pick = lambda values: reduce(lambda acc, kv: F.when(F.col("nth") % len(values) == kv[0], F.lit(kv[1])).otherwise(acc), enumerate(values), F.lit(values[0]))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("nth", nth)
    s = s.withColumns({"weight": pick(WEIGHTS).cast("double"), "tilt": pick(TILTS), "cap": F.col("source_size") * F.lit(CAP)})
    ranked = Wd.orderBy(F.col("cap") / F.col("weight"), "nth").rowsBetween(Wd.unboundedPreceding, Wd.currentRow)
    whole = Wd.partitionBy(F.lit(0)).rowsBetween(Wd.unboundedPreceding, Wd.unboundedFollowing)
    s = s.withColumns({"cap_before": F.sum("cap").over(ranked) - F.col("cap"), "weight_before": F.sum("weight").over(ranked) - F.col("weight")})
    s = s.withColumns({"wanted": F.sum("source_size").over(whole) * F.lit(SHARE), "weights": F.sum("weight").over(whole)})
    level = (F.col("wanted") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before"))
    s = s.withColumn("level", F.max(level).over(whole))
    target = F.round(F.least("cap", F.col("level") * F.col("weight")), 6)
    return s.select("source", "source_size", target.alias("target"), "tilt")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, position (of the first pass) and passes (position and words of each)
    of each document, sorted by position."""
    return _positions(docs).orderBy(F.asc_nulls_last("position"), "doc_id", "size")


def _positions(docs: DataFrame, payload: Column | None = None) -> DataFrame:
    """As ``mix``, in no order, with ``payload`` carried along as ``payload``.

    Rows are dealt once: the window and the join that follows it have the same keys, which are never null."""
    extra = [] if payload is None else ["payload"]
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))).cast("binary"))
    place = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))
    sized = docs.select("doc_id", "source", place.alias("place"), size_of(F.col("text")).alias("size"), key.alias("key"), *([] if payload is None else [payload.alias("payload")]))
    buckets = max(1, math.isqrt(docs.count()))
    sized = sized.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("int"))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Wd.partitionBy("source").orderBy("bucket").rowsBetween(Wd.unboundedPreceding, -1)
    sums = sums.withColumn("bucket_before", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    wants = targets(sums.select("source", F.col("bucket_size").alias("size")))
    starts = _join_source(sums, wants).select(place.alias("place"), "bucket", "bucket_before", "source_size", "target", "tilt")
    rows = Wd.partitionBy("place", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Wd.unboundedPreceding, -1)
    placed = sized.withColumn("row_before", F.coalesce(F.sum("size").over(rows), F.lit(0)))
    placed = placed.join(starts, ["place", "bucket"]).select(*extra, "doc_id", "size", "source_size", "target", "tilt", (F.col("bucket_before") + F.col("row_before")).alias("done"))
    placed = placed.withColumn("goal", F.round("target").cast("long"))
    placed = placed.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("goal") - F.col("whole") * F.col("source_size") - F.col("done"))).cast("long")
    placed = placed.withColumn("last", last)
    words = lambda nth: F.when(nth < F.col("whole"), F.col("size")).otherwise(F.col("last"))
    middle = lambda nth: nth * F.col("source_size") + F.col("done") + words(nth) / 2
    one = lambda nth: F.struct(_position(middle(nth)).alias("position"), words(nth).alias("words"))
    every = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("whole")), lambda nth: words(nth) > 0), one)
    still = F.array(F.struct(_position(F.col("done")).alias("position"), F.lit(0).cast("long").alias("words")))
    out = placed.withColumn("passes", F.when(F.col("size") > 0, every).otherwise(still))
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda acc, x: acc + x["words"])
    first = F.get("passes", F.lit(0))["position"]
    return out.select(*extra, "doc_id", "size", "source_size", "target", taken.alias("taken"), first.alias("position"), "passes")


def _position(words: Column) -> Column:
    """The training time at which ``words`` of the demand have been met."""
    part = F.when(F.col("goal") > 0, F.least(F.lit(1.0), words / F.col("goal"))).otherwise(F.lit(0.5))
    lean = F.lit(1.0) - F.col("tilt")
    inverse = F.when(F.col("tilt") == 0, part).otherwise((F.sqrt(lean * lean + 4 * F.col("tilt") * part) - lean) / (2 * F.col("tilt")))
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), inverse)), 9)


def apply_mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all columns, each pass at its own position in the order.

    Documents stay whole: the one of each source that is taken in part stands there from one half on. Null and wordless
    texts take no words of the mix and stay once each. Ties in the order go by id (null first), then by a hash of the
    text. No rows: no rows."""
    mixed = _positions(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    kept = mixed.select("payload", "doc_id", "size", F.explode("passes").alias("pass")).where("2 * pass.words >= size")
    return kept.orderBy("pass.position", "doc_id", F.xxhash64("payload.text")).select("payload.*")


def _join_source(left: DataFrame, right: DataFrame) -> DataFrame:
    """Equi-join on ``source`` that keeps nulls."""
    a, b = left.alias("l"), right.alias("r")
    return a.join(b, F.col("l.source").eqNullSafe(F.col("r.source"))).select("l.*", *[f"r.{c}" for c in right.columns if c != "source"])
