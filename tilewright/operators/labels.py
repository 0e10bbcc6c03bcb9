"""Names, labels and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from tilewright.functions.geometry import col
from tilewright.operators import turns as in_turn
from tilewright.operators.ordered import numbered, running_sums
from tilewright.plans.storage import materialize


def normalize_name(name) -> Column:
    """Lower case, slide suffixes taken out, runs of other characters than letters and digits as one underscore."""
    text = F.lower(col(name))
    for suffix in (".ndpi.ndpa", ".ndpa", ".ndpi"):
        text = F.replace(text, F.lit(suffix), F.lit(""))
    return F.btrim(F.regexp_replace(text, "[^a-z0-9]+", "_"), F.lit("_"))


def score_match(a, b) -> Column:
    """(tier, overlap, less): 4 equal, 3 prefix, 2 contained, 1 common tokens; structs compare in this order."""
    a, b = normalize_name(a), normalize_name(b)
    return _score(a, b, _words(a), _words(b))


def _words(norm: Column) -> Column:
    return F.array_distinct(F.split(norm, "_"))


def _score(a: Column, b: Column, ta: Column, tb: Column) -> Column:
    """``score_match`` of normal names and their distinct tokens."""
    shorter, less = F.least(F.length(a), F.length(b)), -F.abs(F.length(a) - F.length(b))
    make = lambda t, o, d: F.struct(F.lit(t).alias("tier"), o.cast("int").alias("overlap"), d.cast("int").alias("less"))
    return (
        F.when(a == b, make(4, F.lit(9999), F.lit(0)))
        .when(a.startswith(b) | b.startswith(a), make(3, shorter, less))
        .when(a.contains(b) | b.contains(a), make(2, shorter, less))
        .otherwise(make(1, F.size(F.array_intersect(ta, tb)), -F.abs(F.size(ta) - F.size(tb))))
    )


def _scored(met: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs (a, b) with s, their score, from frames (a, norm) and (b, norm): a name is made normal once, not for each pair."""
    side = lambda df, n: df.select(n, F.struct("norm", _words(F.col("norm")).alias("words")).alias(f"_{n}"))
    both = met.join(side(a, "a"), "a").join(side(b, "b"), "b")
    return both.select("a", "b", _score(F.col("_a.norm"), F.col("_b.norm"), F.col("_a.words"), F.col("_b.words")).alias("s"))


def best_match(names: DataFrame, candidates: DataFrame, name: str, candidate: str, min_overlap: int = 2) -> DataFrame:
    """name and its best candidate, null if none is good enough; the first in order on equal scores.

    Only pairs that share a token or lie in one another can be good. Names and candidates that share a token or one of
    whose texts starts with the other meet by token or by prefix; a name holds another in its middle only if it holds a
    run of ``GRAM`` characters of it. Names that meet nothing are compared with the one candidate that suits best among
    the unlike ones: that of the nearest number of tokens, the first in order."""
    key = lambda df, c, n: df.select(F.col(c).alias(n)).distinct().withColumn(f"{n}_norm", normalize_name(F.col(n)))
    a, b = key(names, name, "a"), key(candidates, candidate, "b")
    block = lambda df, n, *kinds: df.select(n, F.explode(_blocks(F.col(f"{n}_norm"), *kinds)).alias("block"))
    met = block(a, "a", "x", "y").join(block(b, "b", "y", "x"), "block").select("a", "b").distinct()
    met = _scored(met, a.withColumnRenamed("a_norm", "norm"), b.withColumnRenamed("b_norm", "norm")).where("s.tier > 1 or s.overlap > 0")
    top = met.groupBy("a").agg(F.min_by(F.struct("b", "s"), F.struct((-F.col("s.tier")).alias("t"), (-F.col("s.overlap")).alias("o"), (-F.col("s.less")).alias("l"), "b")).alias("m"))
    found = top.select("a", "m.b", "m.s.tier", "m.s.overlap")
    tokens = lambda c: F.size(F.array_distinct(F.split(c, "_")))
    firsts = b.groupBy(tokens(F.col("b_norm")).alias("tb")).agg(F.min("b").alias("b"))  # a row for each number of tokens
    alone = a.join(found, "a", "left_anti").withColumn("ta", tokens(F.col("a_norm")))
    counts = alone.select("ta").distinct().join(firsts, F.lit(True)).groupBy("ta").agg(F.min_by("b", F.struct(F.abs(F.col("ta") - F.col("tb")), "b")).alias("b"))
    rest = alone.join(counts, "ta").select("a", "b", F.lit(1).alias("tier"), F.lit(0).alias("overlap"))
    good = (F.col("tier") >= 2) | (F.col("overlap") >= min_overlap)
    return found.unionByName(rest).select(F.col("a").alias(name), F.when(good, F.col("b")).alias("match"), "tier", "overlap")


#: Characters of the pieces by which names meet that lie in one another.
GRAM = 4


def _blocks(norm: Column, own: str, held: str) -> Column:
    """Tokens, the pieces of GRAM characters and, since a name shorter than that may lie in any other, the name itself
    under ``own`` and all short pieces under ``held``; the other side has the two the other way round."""
    tokens = F.transform(F.split(norm, "_"), lambda t: F.concat(F.lit("t"), t))
    pieces = lambda n, kind: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(norm) - n + 1)), lambda i: F.concat(F.lit(kind), F.substr(norm, i, F.lit(n))))
    short = F.flatten(F.array(*[pieces(n, held) for n in range(1, GRAM)]))
    whole = F.when(F.length(norm) < GRAM, F.array(F.concat(F.lit(own), norm))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(tokens, pieces(GRAM, "g"), short, whole))


def _good_pairs(names: DataFrame, candidates: DataFrame, min_overlap: int) -> DataFrame:
    """a, b and s (the score) of the pairs that are good enough; a and b are distinct columns of their frames.

    Names with common tokens meet by pairs of tokens (by single ones if one is enough). A name that lies in another has all
    its pieces of ``GRAM`` characters there, so it is enough to look where its rarest piece occurs."""
    if min_overlap < 1:
        raise ValueError("min_overlap is 1 at least")
    a, b = names.select("a", normalize_name(F.col("a")).alias("norm")), candidates.select("b", normalize_name(F.col("b")).alias("norm"))
    tokens = F.array_sort(F.array_distinct(F.split("norm", "_")))
    both = F.flatten(F.transform(tokens, lambda t: F.transform(F.filter(tokens, lambda u: u > t), lambda u: F.concat(t, F.lit("_"), u))))
    shared = lambda df, n: df.select(n, F.explode(tokens if min_overlap == 1 else both).alias("block"))
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("norm") - n + 1)), lambda i: F.substr("norm", i, F.lit(n)))
    held = lambda df, n: df.select(n, F.explode(F.array_distinct(F.flatten(F.array(*[cut(k) for k in range(1, GRAM + 1)])))).alias("block"))
    often = held(a, "a").select("block").unionAll(held(b, "b").select("block")).groupBy("block").agg(F.count("*").alias("n"))
    # a name shorter than GRAM is its own piece, as pieces do not reach past the end
    rarest = lambda df, n: df.select(n, F.explode(F.array_distinct(cut(GRAM))).alias("block")).join(often, "block").groupBy(n).agg(F.min_by("block", F.struct("n", "block")).alias("block"))
    met = shared(a, "a").join(shared(b, "b"), "block").select("a", "b")
    met = met.unionAll(rarest(a, "a").join(held(b, "b"), "block").select("a", "b")).unionAll(held(a, "a").join(rarest(b, "b"), "block").select("a", "b"))
    return _scored(met.distinct(), a, b).where((F.col("s.tier") > 1) | (F.col("s.overlap") >= min_overlap))


def _best_of(pairs: DataFrame) -> DataFrame:
    """a and the b of the best of its pairs, the first in order on equal scores."""
    worse = F.struct((-F.col("s.tier")).alias("t"), (-F.col("s.overlap")).alias("o"), (-F.col("s.less")).alias("l"), "b")
    return pairs.groupBy("a").agg(F.min_by("b", worse).alias("b"))


def match_in_order(names: DataFrame, candidates: DataFrame, name: str, candidate: str, order: str, min_overlap: int = 2) -> DataFrame:
    """order, name and match: as ``best_match``, but names take turns by ``order`` (unique) and a candidate that is taken is
    gone, until all are; from then on every name sees all of them again. Null where none that is left is good enough.

    A name takes one of its good candidates each time, so it is asked as often as it has some, and its later turns find none
    left. The first turns, with ``turns.FINISH`` pairs together at most, are settled before the others' pairs are formed
    (``turns.settle``): what they take is gone from those. Once the last candidate has been taken, no later name can have
    been settled, so those get the best of all."""
    turns = names.select(F.col(order).alias("o"), F.col(name).alias("a"))
    pool = candidates.select(F.col(candidate).alias("b")).where("b is not null").distinct()
    pairs = materialize(_good_pairs(turns.select("a").where("a is not null").distinct(), pool, min_overlap))
    liked, by_turn = [F.desc("s.tier"), F.desc("s.overlap"), F.desc("s.less"), F.col("b")], F.col("o").asc_nulls_last()
    asked = numbered(turns.join(pairs.groupBy("a").agg(F.count("*").alias("most")), "a"), ["a"], [by_turn], "nth", 1).where("nth <= most")
    asked = materialize(running_sums(asked, [], [by_turn], {"upto": F.col("most")}))
    options = lambda some, left: in_turn.settle(some.join(left, "a").select("o", F.col("o").alias("turn"), "b", "s"), [], "o", "turn", "b", liked)
    first = materialize(options(asked.where(F.col("upto") <= in_turn.FINISH), pairs))
    left = pairs.join(first.select("b"), "b", "left_anti")
    taken = materialize(first.unionAll(options(asked.where(F.col("upto") > in_turn.FINISH), left)))
    last = taken.agg(F.count("*").alias("n"), F.max("turn").alias("last")).crossJoin(pool.agg(F.count("*").alias("all"))).first()  # one row
    top = _best_of(pairs).withColumnRenamed("b", "top")
    out = turns.join(taken.select("o", "b"), "o", "left")
    if last.n == last.all and last.n:
        late = out.where(F.col("o") > last.last).drop("b").join(top.withColumnRenamed("top", "b"), "a", "left").select("o", "a", "b")
        out = out.where((F.col("o") <= last.last) | F.col("o").isNull()).select("o", "a", "b").unionByName(late)
    return out.select(F.col("o").alias(order), F.col("a").alias(name), F.col("b").alias("match"))


def attach_metadata(samples: DataFrame, name: str, sources: dict[str, tuple[DataFrame, str]], min_overlap: int = 2, order: str | None = None, once: tuple[str, ...] = ()) -> DataFrame:
    """``samples`` with a struct for each source: the row whose key suits the name best, null if none is good enough.

    Of the sources in ``once`` a key is taken by one sample only, in turns by ``order`` (unique). Elsewhere samples that
    suit the same key take its rows in turn, by ``order`` or else by their names; those past the last row get the first."""
    out = samples.withColumns({"_name": F.col(name), "_order": F.col(order) if order else F.col(name)})
    for label, (rows, key) in sources.items():
        if label in once:
            found = match_in_order(out, rows, "_name", key, "_order", min_overlap).select("_order", F.col("match").alias("_match"))
            asked = out.join(found, "_order", "left").withColumn("_turn", F.lit(1))
        else:
            some = lambda df, c, n: df.select(F.col(c).alias(n)).where(F.col(n).isNotNull()).distinct()
            found = _best_of(_good_pairs(some(samples, name, "a"), some(rows, key, "b"), min_overlap)).select(F.col("a").alias("_name"), F.col("b").alias("_match"))
            sizes = rows.groupBy(F.col(key).alias("_match")).agg(F.count("*").alias("_rows"))
            turns = F.row_number().over(Wd.partitionBy("_match").orderBy("_order"))
            asked = out.join(found, "_name", "left").withColumn("_turn", turns).join(sizes, "_match", "left")
            asked = asked.withColumn("_turn", F.when(F.col("_turn") > F.col("_rows"), 1).otherwise(F.col("_turn"))).drop("_rows")
        whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
        held = rows.select(F.col(key).alias("_match"), F.row_number().over(Wd.partitionBy(key).orderBy(*rows.columns)).alias("_turn"), whole.alias(label))
        out = asked.join(held, ["_match", "_turn"], "left").drop("_match", "_turn")
    return out.drop("_name", "_order")


def parse_confidence(details) -> Column:
    """The first entry ``confidence=<number>`` of a text with ``;`` between entries; 0 if there is none."""
    entries = F.transform(F.split(F.coalesce(col(details), F.lit("")), ";"), lambda p: F.trim(p))
    mine = F.filter(entries, lambda p: p.startswith("confidence="))
    values = F.filter(F.transform(mine, lambda p: F.substring_index(p, "=", -1).try_cast("double")), lambda v: v.isNotNull())
    return F.coalesce(F.get(values, F.lit(0)), F.lit(0.0))


def label_map(rows: DataFrame, name: str, category: str, order: str) -> DataFrame:
    """name (lower case), category and its index from 0; a repeated name takes its last row."""
    last = rows.groupBy(F.lower(name).alias("name")).agg(F.max_by(category, order).alias("category"))
    indexes = rows.select(F.col(category).alias("category")).distinct().withColumn("label", F.dense_rank().over(Wd.orderBy("category")) - 1)
    return last.join(indexes, "category").select("name", "category", "label")


def map_label(label, labels: dict[str, int]) -> Column:
    """The lower-cased label's number, -1 if unknown."""
    pairs = [x for k, v in labels.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(col(label))), F.lit(-1)) if pairs else F.lit(-1)


def assign_splits(stems: DataFrame, stem: str, seed: int = 67, val: float = 0.15, test: float = 0.15) -> DataFrame:
    """stem and split by a hashed order: int(n * part) stems for val and test, the rest for train.

    The order is that of the stem's MD5 with the seed, the same on every run."""
    s = stems.select(stem).distinct()
    n = s.count()
    placed = numbered(s, [], [F.md5(F.concat(F.col(stem).cast("string"), F.lit(f":{seed}")).cast("binary")), F.col(stem)], "k", 1)
    n_val, n_test = int(n * val), int(n * test)
    n_train = n - n_val - n_test
    return placed.select(stem, F.when(F.col("k") <= n_train, "train").when(F.col("k") <= n_train + n_val, "val").otherwise("test").alias("split"))
