"""Near-duplicate documents by bottom-k sketches of one hash function.

A document is its set of distinct word 5-shingles, hashed to 63 bits. Documents with equal sets form one class; all
further work is on classes, so exact copies cost nothing. Two classes are linked if their Jaccard similarity is at
least 3/4.

1. The k smallest hashes of a set are its bottom-k sketch.
2. Inverted lists of retained values generate overlaps. If the union sketch (the k smallest of both sketches
   together) is shared to a part of TAU or more, the sketches share at least that part of either. So it is enough to
   list a class under its rarest values, as many as leave out fewer than that part: two such classes meet in the list
   of their rarest common value. Very common values, of passages that many texts hold, are listed only where hardly
   anything else is retained.
3. Pairs that meet are filtered by the similarity that the union sketch estimates.
4. Exact Jaccard on the full sets verifies.

TAU = 28/64 lets a pair through that is linked exactly at 3/4 with all but a 1e-6 chance, and sets of up to 48
shingles are compared by their exact bound.

Pairs are not formed all at once. First each list is dealt into small groups whose members are compared with the
group's leader and with the list's: the class whose values are the most common, which among near copies is the least
edited. The components found so far then say which lists still have members that differ. Those members are listed
anew, by their full sets and the exact bound: under the rarest quarter of their shingles, which leaves out texts that
differ in more than a quarter. They are compared with a few leaders of these lists, and last with the members that are
still in other components. A group of near copies of any size so takes about as many comparisons as it has members.
Lists with the same members count once.

Edge cases: null, empty and wordless texts have no shingles and are linked with nothing; a text of one to four words
is one shingle; rows with the same doc_id are documents of their own that name the same id; a null id never names a
component unless all of its documents have null ids; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm import words as W
from tilewright.operators.components import connected_components
from tilewright.plans.storage import bound_batches, discard, materialize

#: Words in a shingle, size of a sketch, least shared part of a union sketch, members of a group in a long list, and
#: leaders of a list that is looked at again.
SHINGLE, K, TAU, GROUP, LEADERS = 5, 64, 28 / 64, 64, 8


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct 63-bit shingle hashes of each row."""
    starts, ends, counts = W.words(data, offsets)
    hashes = W.span_hashes(W.LOWER[data], starts, ends)
    grams, each = W.ngrams(hashes, counts, n)
    grams = (grams >> np.uint64(1)).astype(np.int64)
    gram_end, word_end = np.cumsum(each), np.cumsum(counts)
    out = []
    for row, (g, w) in enumerate(zip(each.tolist(), counts.tolist(), strict=True)):
        if g:
            out.append(np.unique(grams[gram_end[row] - g : gram_end[row]]))
        elif w:
            whole, _ = W.ngrams(hashes[word_end[row] - w : word_end[row]], np.array([w]), w)
            out.append((W.mix(whole + np.uint64(w)) >> np.uint64(1)).astype(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.astype("<i8").tobytes(), digest_size=16).digest()


def _list_array(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)])))


def sketches(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_shingles, cls (digest of the set), th (hash of the text) and sketch of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in W.slices(batch.column(2)):
                sets = shingle_sets(data, offsets)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0)[i:j], "th": batch.column(1)[i:j], "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "cls": pa.array([_digest(s) for s in sets], pa.binary()), "sketch": _list_array([s[:k] for s in sets]),
                    }
                )

    bound_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), F.col("text").alias("_text"))
    return plain.mapInArrow(W.giving_back(run), "doc_id long, th long, n_shingles long, cls binary, sketch array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """c and the full set of the classes in ``wanted`` (c, doc_id, th, cls), from a document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in W.slices(batch.column(2)):
                sets = shingle_sets(data, offsets)
                same = [r for r, (s, c) in enumerate(zip(sets, batch.column(1)[i:j].to_pylist(), strict=True)) if _digest(s) == c]
                yield pa.RecordBatch.from_pydict({"c": batch.column(0)[i:j].take(pa.array(same, pa.int64())), "full": _list_array([sets[r] for r in same])})

    bound_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), F.col("text").alias("_text")).alias("d")
    w = wanted.alias("w")
    found = texts.join(w, (F.col("d.th") == F.col("w.th")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))).select("w.c", "w.cls", "d._text")
    return found.mapInArrow(W.giving_back(run), "c long, full array<long>").dropDuplicates(["c"])


def _estimate(a: Column, b: Column, k: int) -> Column:
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union)


def _alike(pairs: DataFrame, sketch: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """The pairs (a, b) that are linked, from distinct candidates; a written table."""
    one = sketch.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = sketch.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    near = pairs.join(one, "a").join(two, "b").where("4 * na >= 3 * nb and 4 * nb >= 3 * na").where(F.size(F.array_intersect("sa", "sb")) >= TAU * F.greatest(F.size("sa"), F.size("sb"))).where(_estimate(F.col("sa"), F.col("sb"), k) >= TAU)
    near = materialize(near.select("a", "b", "na", "nb"))  # the full sets are joined to what is left only
    linked = near.join(sets.withColumnsRenamed({"c": "a", "full": "fa"}), "a").join(sets.withColumnsRenamed({"c": "b", "full": "fb"}), "b")
    shared = F.size(F.array_intersect("fa", "fb"))
    linked = materialize(linked.where(100 * shared >= 75 * (F.col("na") + F.col("nb") - shared)).select("a", "b"))
    discard(near)
    return linked


def _listed(held: DataFrame, part: Column) -> DataFrame:
    """c, v, df, s, after, central: classes listed under the rarest of their values, for (c, held) with arrays of
    distinct values. ``s`` is the array's size and ``after`` how many of its values are not rarer than v.

    Two classes that share at least ``part`` of the values of either meet in a list: that of their rarest common one.
    ``central`` says how common a class's values are; among near copies, the least edited one has the most."""
    postings = held.select("c", F.explode("held").alias("v"))
    sizes = postings.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    shared = postings.join(sizes, "v").groupBy("c").agg(F.collect_list(F.struct("df", "v")).alias("vs"))
    sized = shared.join(held.select("c", F.size("held").alias("s")), "c")
    room = F.col("s") - F.ceil(part * F.col("s")) + 1 - (F.col("s") - F.size("vs"))  # unshared values come first
    rarest = F.slice(F.sort_array("vs"), 1, F.greatest(F.lit(0), room).cast("int"))
    central = F.aggregate("vs", F.lit(0).cast("long"), lambda acc, x: acc + x["df"])
    after = F.size("vs").alias("after")
    return _distinct_lists(sized.select("c", "s", after, central.alias("central"), F.posexplode(rarest).alias("i", "x")).select("c", "s", "central", (F.col("after") - F.col("i")).alias("after"), "x.v", "x.df"))


def _distinct_lists(lists: DataFrame) -> DataFrame:
    """One of the lists with the same members, that of their rarest value; lists of one go.

    ``_cross`` relies on the order: the rarest common value of a pair must not give way to a later one."""
    same = [F.min("df").alias("df"), F.count("*").alias("size"), F.min("c").alias("c0"), F.max("c").alias("c1"), *[F.bit_xor(F.xxhash64("c", F.lit(s))).alias(f"x{s}") for s in (1, 2)]]
    signed = lists.groupBy("v").agg(*same).where("size > 1")
    one = signed.groupBy("size", "c0", "c1", "x1", "x2").agg(F.min(F.struct("df", "v")).alias("m")).select("m.v")
    return lists.join(one, "v", "left_semi")


def _leaders(lists: DataFrame, by: list) -> DataFrame:
    """``by`` and the most central class (``lead``) there."""
    return lists.groupBy(*by).agg(F.max_by("c", F.struct("central", -F.col("c"))).alias("lead"), F.max("central").alias("central"))


def _within(lists: DataFrame) -> DataFrame:
    """Lists with members in more than one component."""
    open_ = lists.groupBy("v").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("v")
    return lists.join(open_, "v")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs of different classes, smaller one first."""
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _cross(lists: DataFrame) -> DataFrame:
    """Distinct pairs that share a list of full sets, are in different components, and may be linked.

    In the list of their rarest common value, all that they share comes after; linked sets share 3/7 of their sizes'
    sum or more, so both must have that many values left there."""
    a, b = lists.alias("x"), lists.alias("y")
    need = 3 * (F.col("x.s") + F.col("y.s"))
    on = [F.col("x.v") == F.col("y.v"), F.col("x.c") < F.col("y.c"), F.col("x.label") != F.col("y.label"), 7 * F.col("x.after") >= need, 7 * F.col("y.after") >= need]
    return a.join(b, on).select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct()


def _label(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """``lists`` with the component that each class is in so far."""
    renamed = labels.select(F.col("node").alias("c"), F.col("component").alias("found"))
    return lists.drop("label").join(renamed, "c", "left").withColumn("label", F.coalesce("found", "c")).drop("found")


def _merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) of ``labels`` with more edges, which are seen as edges between the components so far; written."""
    so_far = labels.select(F.col("node").alias("n"), F.col("component").alias("l"))
    lifted = edges
    for end in ("a", "b"):
        lifted = lifted.join(so_far, lifted[end] == F.col("n"), "left").withColumn(end, F.coalesce("l", end)).drop("n", "l")
    up = connected_components(lifted).select(F.col("node").alias("n"), F.col("component").alias("l"))
    moved = labels.join(up, labels["component"] == F.col("n"), "left").select("node", F.coalesce("l", "component").alias("component"))
    new = up.join(labels, F.col("n") == labels["node"], "left_anti").select(F.col("n").alias("node"), F.col("l").alias("component"))
    return materialize(moved.unionAll(new))


def components(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document."""
    out = _members(docs, k).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def _members(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component_id and leads of each document.

    ``leads``: whether it has the smallest (doc_id, th) of its component; a document without shingles always does."""
    rows = materialize(sketches(docs, k))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("m")
    classes = rows.where("n_shingles > 0").groupBy("cls").agg(first, F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("c"), "cls", F.col("m.doc_id").alias("doc_id"), F.col("m.th").alias("th"), "copies", "n", "sketch"))
    bound = F.when(F.col("s") <= int(k * 0.75), F.lit(0.75)).otherwise(F.lit(TAU))
    lists = materialize(_listed(classes.select("c", F.col("sketch").alias("held")), bound))
    sets = materialize(_sets(docs, classes.join(lists.select("c").distinct(), "c", "left_semi")))

    deals = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("df") / GROUP)))).cast("long")  # the same groups for lists of like length
    dealt = lists.withColumn("g", F.pmod(F.xxhash64("c"), deals))
    led = _leaders(dealt, ["v", "g"])
    stars = dealt.join(led.select("v", "g", "lead"), ["v", "g"]).select(F.col("lead").alias("a"), F.col("c").alias("b"))
    top = led.groupBy("v").agg(F.max_by("lead", F.struct("central", -F.col("lead"))).alias("top"))
    heads = lists.join(top, "v").select(F.col("top").alias("a"), F.col("c").alias("b"))
    edges = _alike(_ordered(stars.unionAll(heads)), classes, sets, k)
    labels = materialize(connected_components(edges))

    left = _within(_label(lists, labels)).select("c").distinct()
    again = _listed(sets.join(left, "c", "left_semi").select("c", F.col("full").alias("held")), F.lit(0.75))
    again = materialize(_within(_label(again, labels)))
    best = _leaders(again.withColumn("g", F.pmod(F.xxhash64("c", F.lit(1)), F.lit(LEADERS))), ["v", "g"]).join(again.select(F.col("c").alias("lead"), F.col("label").alias("lead_label")).distinct(), "lead")
    tried = again.join(best, "v").where("label <> lead_label").select(F.col("lead").alias("a"), F.col("c").alias("b"))
    second = _alike(_ordered(tried), classes, sets, k)
    first_labels, labels = labels, _merged(labels, second)

    rest = materialize(_distinct_lists(_within(_label(again, labels))))
    third = _alike(_cross(rest), classes, sets, k)
    second_labels, labels = labels, _merged(labels, third)
    discard(lists, sets, again, rest, edges, second, third, first_labels, second_labels)

    named = classes.join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("lead")
    names = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), lead)
    by_class = named.join(names, "component").select("cls", "component_id", "lead")
    out = rows.join(by_class, "cls", "left")
    some = F.col("n_shingles") > 0
    leads = ~some | (F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("th") == F.col("lead.th")))
    return out.select("doc_id", "th", "n_shingles", F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), leads.alias("leads"))


def keep_one(docs: DataFrame, k: int = K) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates, with all columns: the one with the smallest doc_id.

    Rows with equal doc_id and text are one document; of different texts with one id, at most one of each group stays,
    that of the smallest hash. Texts without words all stay."""
    found = _members(docs.select("doc_id", "text"), k).where("leads").select(F.col("doc_id").alias("_kept"), F.col("th").alias("_text")).distinct()
    columns = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_th"))
    chosen = keyed.join(found, F.col("_id").eqNullSafe(F.col("_kept")) & (F.col("_th") == F.col("_text")), "left_semi")
    return chosen.dropDuplicates(["_id", "_th"]).select("_row.*")
