"""Repeated passages across and within documents, found by recompression.

Words are symbols, named by a hash. First every maximal run of equal words is named as one symbol; then each round
splits the symbols into left and right ones by a bit of their name and names each adjacent left-right pair as one
symbol. A name depends on what it stands for alone, so it is the same in all documents without a dictionary, and
equal passages get the same symbols but at their borders. Each symbol carries the range of words that its making
looked at: within an equal passage that holds this range, the same symbol stands at the same place.

Two Spark rounds count names over all documents, and what they leave is verified on the words:

1. The symbols after ``ROUNDS`` rounds are counted. A window of ``WINDOW`` words that holds the range of a symbol which
   occurs once cannot repeat. All other windows are candidates; names that collide only add some.
2. Candidates are cut into units by the symbols after ``TOP`` rounds: the windows that begin in one symbol and end in
   one other. A unit is known by a digest of the bytes of its words, and units are counted. All windows of a unit that
   occurs more than once repeat, however often that is, and need no further look.
3. One occurrence of each unit gives its windows, with the weight of two where the unit is shared. They are counted by
   96-bit hashes of their words, and those of the other units that are counted more than once repeat as well.
4. Words covered by a repeated window go.

So the copies of a passage, from two to very many, send their windows once, and their units as one row each.

Documents with equal word sequences form one class, known by the digest of the sequence (the symbol at the top); all
windows of a class with several documents repeat, and only one of its documents takes part in steps 2 and 3, with the
weight of two.

Edge cases: nulls have no words; a document of fewer than WINDOW words keeps all of them; rows with the same doc_id are
documents of their own; null ids are kept; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm import words as W
from tilewright.plans.storage import bound_batches, discard, materialize

WINDOW, ROUNDS, TOP = 35, 6, 10
#: Windows that a task sends on in one batch.
BATCH = 200_000


def recompress(name: np.ndarray, wall: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names of the symbols after the rounds, the position where each starts, and the first and last (exclusive)
    position that its making looked at. ``wall`` marks positions between documents, which never join; there is one at
    either end."""
    low, high = np.arange(len(name)), np.arange(1, len(name) + 1)
    # runs
    head = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | wall[1:] | wall[:-1]))
    size = np.diff(np.append(head, len(name)))
    tail = head + size - 1
    low, high = low[np.maximum(head - 1, 0)], high[np.minimum(tail + 1, len(name) - 1)]
    name = np.where(size > 1, W.mix(name[head] + W.mix(size.astype(np.uint64) + np.uint64(17))), name[head])
    wall = wall[head]
    for level in range(rounds):  # pairs
        bit = (W.mix(name + np.uint64(level + 1)) >> np.uint64(63)) == 0
        left, right = bit & ~wall, ~bit & ~wall
        first = np.append(left[:-1] & right[1:], False)
        second = np.append(False, first[:-1])
        at = np.flatnonzero(~second)
        mate = np.minimum(at + 1, len(name) - 1)
        joined = first[at]
        named = np.where(joined, W.mix(name[at] * np.uint64(0x9E3779B97F4A7C15) + W.mix(name[mate] + np.uint64(level + 101))), name[at])
        high_new = np.where(left[at], np.maximum(high[at], high[mate]), high[at])
        low_new = np.where(right[at], np.minimum(low[at], low[np.maximum(at - 1, 0)]), low[at])
        low_new = np.where(joined, np.minimum(low[at], low[mate]), low_new)
        name, low, high, wall, head = named, low_new, high_new, wall[at], head[at]
    return name, head, low, high


def _named(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' names with a wall at either end of each row, which positions are walls, and the words' positions."""
    place = np.arange(len(starts)) + np.repeat(np.arange(1, len(counts) + 1), counts)
    n = len(starts) + len(counts) + 1
    name, wall = np.zeros(n, np.uint64), np.ones(n, bool)
    name[place], wall[place] = W.span_hashes(data, starts, ends), False
    return name, wall, place


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all rows whose range is within their row and no longer than a window: name, first and last
    (exclusive) word of the range in the row, and how many each row has."""
    starts, ends, counts = W.words(data, offsets)
    name, wall, _ = _named(data, starts, ends, counts)
    walls = np.flatnonzero(wall)
    name, _, low, high = recompress(name, wall)
    row = np.searchsorted(walls, low, "right") - 1
    keep = ~np.isin(low, walls, assume_unique=False) & (row < len(counts))
    keep[keep] = high[keep] <= walls[row[keep] + 1]
    keep &= high - low <= WINDOW
    name, low, high, row = name[keep], low[keep], high[keep], row[keep]
    base = walls[row] + 1
    return name, low - base, high - base, np.bincount(row, minlength=len(counts))


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def _scan(docs: DataFrame) -> DataFrame:
    """doc_id, th, n_words, cls (digest of the words), whole (sha256 of the words joined by spaces), and the names and
    ranges of its symbols, of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in W.slices(batch.column(2)):
                raw = data.tobytes()
                n, cls, whole = [], [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    words = raw[a:b].split()
                    text = b" ".join(words)
                    n.append(len(words))
                    cls.append(hashlib.blake2b(text, digest_size=16).digest())
                    whole.append(hashlib.sha256(text).digest())
                name, low, high, counts = symbols(data, offsets)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0)[i:j], "th": batch.column(1)[i:j], "n_words": pa.array(n, pa.int64()), "cls": pa.array(cls, pa.binary()), "whole": pa.array(whole, pa.binary()),
                        "names": _lists(name.view(np.int64), counts), "lows": _lists(low.astype(np.int32), counts), "highs": _lists(high.astype(np.int32), counts),
                    }
                )

    bound_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), F.col("text").alias("_text"))
    return plain.mapInArrow(run, "doc_id long, th long, n_words long, cls binary, whole binary, names array<long>, lows array<int>, highs array<int>")


def candidate_ranges(n: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Starts of the windows of a text of n words that hold none of the ranges [low, high), as rows (first, last)."""
    hit = np.zeros(n - WINDOW + 2, np.int64)
    first, last = np.maximum(high - WINDOW, 0), np.minimum(low, n - WINDOW)  # it starts at low or before and reaches high
    good = first <= last
    np.add.at(hit, first[good], 1)
    np.add.at(hit, last[good] + 1, -1)
    free = np.concatenate([[0], (np.cumsum(hit)[:-1] == 0).astype(np.int8), [0]])
    step = np.diff(free)
    return np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1], axis=1)


def _ranges(rows: DataFrame) -> DataFrame:
    """r and the candidate ranges (froms, tos), from r, n_words, lows, highs and hits (numbers of repeated symbols)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rs, froms, tos = [], [], []
            r, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in range(batch.num_rows):
                low, high, hits = (batch.column(c)[k].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3, 4))
                once = np.ones(len(low), bool)
                once[hits] = False
                found = candidate_ranges(n[k], low[once], high[once])
                if len(found):
                    rs.append(r[k])
                    froms.append(found[:, 0])
                    tos.append(found[:, 1])
            sizes = np.array([len(x) for x in froms], np.int64)
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_pydict({"r": pa.array(rs, pa.int64()), "froms": _lists(np.concatenate(froms or none).astype(np.int32), sizes), "tos": _lists(np.concatenate(tos or none).astype(np.int32), sizes)})

    return rows.select("r", "n_words", "lows", "highs", "hits").mapInArrow(run, "r long, froms array<int>, tos array<int>")


def _expanded(froms: pa.Array, tos: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows of the rows' ranges: within their row, among all words, and the number of their range."""
    ranges = froms.value_lengths().to_numpy(zero_copy_only=False)
    base = np.repeat(np.cumsum(counts) - counts, ranges)  # a row's first word
    first, last = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (froms, tos))
    sizes = last - first + 1
    at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return at, at + np.repeat(base, sizes), np.repeat(np.arange(len(sizes)), sizes)


def _units(texts: DataFrame) -> DataFrame:
    """r, weight, the first and last window (froms, tos) and the digest of each unit, from r, weight, froms, tos and
    text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, weight = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j, data, offsets in W.slices(batch.column(4)):
                starts, ends, counts = W.words(data, offsets)
                name, wall, place = _named(data, starts, ends, counts)
                head = np.zeros(len(name), np.int64)
                head[recompress(name, wall, TOP)[1]] = 1
                symbol = np.cumsum(head)[place]
                froms, tos = batch.column(2).slice(i, j - i), batch.column(3).slice(i, j - i)
                at, word, part = _expanded(froms, tos, counts)
                new = np.ones(len(at), bool)
                new[1:] = (part[1:] != part[:-1]) | (symbol[word[1:]] != symbol[word[:-1]]) | (symbol[word[1:] + WINDOW - 1] != symbol[word[:-1] + WINDOW - 1])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(at))[: len(first)] - 1
                row = np.repeat(np.arange(i, j), froms.value_lengths().to_numpy(zero_copy_only=False))[part[first]]
                raw = data.tobytes()
                key = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts[word[first]].tolist(), ends[word[last] + WINDOW - 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"r": r[row], "weight": weight[row], "s0": at[first].astype(np.int32), "s1": at[last].astype(np.int32), "key": pa.array(key, pa.binary())})

    return texts.select("r", "weight", "froms", "tos", "text").mapInArrow(run, "r long, weight int, s0 int, s1 int, key binary")


def _windows(texts: DataFrame) -> DataFrame:
    """r, weight, at and the two hashes of each window, from r, weights, froms, tos and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = batch.column(0).to_numpy()
            for i, j, data, offsets in W.slices(batch.column(4)):
                starts, ends, counts = W.words(data, offsets)
                weights, froms, tos = (batch.column(c).slice(i, j - i) for c in (1, 2, 3))
                at, word, part = _expanded(froms, tos, counts)
                row = np.repeat(np.arange(i, j), froms.value_lengths().to_numpy(zero_copy_only=False))[part]
                weight = weights.flatten().to_numpy(zero_copy_only=False)[part]
                hashes = [W.window_hashes(W.span_hashes(data, starts, ends, seed), WINDOW)[word].view(np.int64) for seed in (0, 5)]
                for e in (slice(k, k + BATCH) for k in range(0, len(at), BATCH)):
                    yield pa.RecordBatch.from_pydict({"r": r[row[e]], "weight": weight[e], "at": at[e].astype(np.int32), "h1": hashes[0][e], "h2": (hashes[1][e] >> 32).astype(np.int32)})

    return texts.select("r", "weights", "froms", "tos", "text").mapInArrow(run, "r long, weight int, at int, h1 long, h2 int")


def _kept(texts: DataFrame) -> DataFrame:
    """cls, n_removed and kept (the kept words joined by spaces), from cls, starts of repeated windows, ranges of such
    starts, and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for k in range(batch.num_rows):
                words = batch.column(4)[k].as_buffer().to_pybytes().split()
                at, froms, tos = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (1, 2, 3))
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, np.concatenate([at, froms]), 1)
                np.add.at(cover, np.concatenate([at, tos]) + WINDOW, -1)
                stay = np.flatnonzero(np.cumsum(cover)[:-1] == 0)
                removed.append(len(words) - len(stay))
                kept.append(b" ".join([words[i] for i in stay]))
            yield pa.RecordBatch.from_pydict({"cls": batch.column(0), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary())})

    return texts.select("cls", "starts", "froms", "tos", "text").mapInArrow(run, "cls binary, n_removed long, kept binary")


def _with_text(docs: DataFrame, some: DataFrame) -> DataFrame:
    """``some``, which names documents by doc_id and th, with their texts."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text")).alias("d")
    s = some.alias("s")
    return texts.join(s, (F.col("d.th") == F.col("s.th")) & F.col("d.doc_id").eqNullSafe(F.col("s.doc_id"))).select("s.*", "d.text")


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by spaces) of each document."""
    rows = materialize(_scan(docs).withColumn("r", F.monotonically_increasing_id()))
    long = rows.where(F.col("n_words") >= WINDOW)
    classes = long.groupBy("cls").agg(F.min(F.struct("r", "doc_id", "th", "n_words")).alias("m"), F.count("*").alias("copies"))
    classes = materialize(classes.select("cls", "m.*", F.least(F.col("copies"), F.lit(2)).cast("int").alias("weight")))

    placed = long.select("r", F.posexplode("names").alias("k", "name"))
    # written, so that the count's shuffle files go before the join, and so that AQE may split the join at common names
    repeated = materialize(placed.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"))
    hits = placed.join(repeated, "name", "left_semi").groupBy("r").agg(F.collect_list("k").alias("hits"))
    # symbols may be missing altogether, as in a long run, so documents without hits are looked at too
    marked = long.select("r", "n_words", "lows", "highs").join(hits, "r", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<int>")))
    ranges = materialize(_ranges(marked).join(classes.select("r", "doc_id", "th", "weight"), "r"))
    whole_rows = materialize(rows.select("doc_id", "n_words", "cls", "whole"))
    discard(rows, repeated)
    units = materialize(_units(_with_text(docs, ranges)))
    discard(ranges)
    counted = units.groupBy("key").agg(F.sum("weight").alias("w"), F.min(F.struct("r", "s0", "s1")).alias("m"))
    counted = materialize(counted.select("key", F.least("w", F.lit(2)).cast("int").alias("weight"), "m.*"))
    first = counted.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("s0", "s1", "weight"))).alias("u"))
    first = first.select("r", F.col("u.weight").alias("weights"), F.col("u.s0").alias("froms"), F.col("u.s1").alias("tos"))
    windows = materialize(_windows(_with_text(docs, first.join(classes.select("r", "doc_id", "th"), "r"))))
    twice = materialize(windows.groupBy("h1", "h2").agg(F.sum("weight").alias("w")).where("w > 1").select("h1", "h2"))
    starts = windows.where("weight = 1").join(twice, ["h1", "h2"], "left_semi").groupBy("r").agg(F.collect_list("at").alias("starts"))
    shared = units.join(counted.where("weight > 1").select("key"), "key", "left_semi").groupBy("r").agg(F.collect_list("s0").alias("froms"), F.collect_list("s1").alias("tos"))
    none = F.array().cast("array<int>")
    found = starts.join(shared, "r", "full").select("r", *[F.coalesce(c, none).alias(c) for c in ("starts", "froms", "tos")])
    part = _kept(_with_text(docs, found.join(classes.where("weight = 1").select("r", "cls", "doc_id", "th"), "r"))).dropDuplicates(["cls"])
    part = materialize(part.select("cls", "n_removed", "kept", F.sha2("kept", 256).alias("kept_sha256")))
    discard(units, counted, windows, twice)

    whole = classes.where("weight > 1").select("cls", F.col("n_words").alias("n_removed"), F.lit(None).cast("binary").alias("kept"), F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256"))
    cut = part.unionByName(whole)
    out = whole_rows.join(cut, "cls", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", F.lower(F.hex("whole"))).alias("kept_sha256"))
