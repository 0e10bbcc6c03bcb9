"""Source divergence audit: how far the words of each source lie from those of the other sources of its language.

Terms are runs of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]``, A-Z lower-cased. A numpy table over a slice's concatenated UTF-8
bytes finds where they begin and end; xxhash groups equal slices, whose bytes are compared. Each task sums its counts
by (language, source, term) before anything is shuffled. A language keeps the terms that ``least`` of its documents hold.

A language's sources and terms are a sparse matrix of counts, dealt by term to blocks of bounded size. Within a block
its rows are compressed (CSR), and ``np.add.reduceat`` over them gives the part of every pair's divergence that the
block's terms make, so no task holds a language, whatever share of the rows it has. Only sums of parts and each block's
first ``top`` terms of a source are shuffled after that.

All arithmetic is on integers: shares are ``1 + floor(scale * (count + smooth) / (N + smooth * V))`` by long division.

Edge cases: null texts, languages and sources are ''; a group (language, source) that occurs but has no terms takes
part with counts of 0; a language that keeps no terms has divergences of 0 and no term rows; a language with one source
has no pairs; rows that repeat count as often as they are there; ties rank by the item's UTF-8 bytes; an empty table
gives no rows; other columns are not looked at; texts of any length are read whole, in slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from tilewright.llm import bpe
from tilewright.llm import words as W
from tilewright.plans.storage import bound_batches, materialize

LEAST, SMOOTH, SCALE, TOP = 30, 5, 10**9, 50
#: Counts that a task holds before it hands them on, and entries of a block at least.
HELD, BLOCK = 600_000, 1 << 14
#: Bytes of text after which a task hands its counts on in any case. Documents are counted in units of ROWS beside the
#: occurrences, of which so many bytes hold fewer.
SEEN, ROWS = 1 << 30, 1 << 32
#: Copies of the languages' totals that a join by language is dealt to.
SALT = 16

TERM = np.ones(256, bool)
TERM[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False


def group_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first of each distinct slice, and the number of each slice's distinct one.

    Slices with one xxhash are compared byte by byte with the first of them."""
    raw = data.tobytes()
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    if len(starts) and not bpe._same_bytes(data, starts, ends, first[which]):
        seen: dict[bytes, int] = {}
        which = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(starts, ends, strict=True)], np.int64)
        first = np.unique(which, return_index=True)[1]
    return first, which


def count_slice(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> Iterator[tuple[int, bytes, int, int]]:
    """(group, term, occurrences, rows that hold it) over the rows of a slice; ``group``: of each row."""
    data = W.LOWER[data]
    starts, ends, counts = W.words(data, offsets, TERM)
    if not len(starts):
        return
    first, which = group_slices(data, starts, ends)
    width = len(first)
    cell, times = np.unique(np.repeat(np.arange(len(counts)), counts) * width + which, return_counts=True)  # (row, term)
    key = group[cell // width] * width + cell % width
    order = np.argsort(key, kind="stable")
    key, at = np.unique(key[order], return_index=True)
    n, rows = np.add.reduceat(times[order], at), np.diff(np.append(at, len(order)))
    raw = data.tobytes()
    terms = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    for k, x, d in zip(key.tolist(), n.tolist(), rows.tolist(), strict=True):
        yield k // width, terms[k % width], x, d


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term (binary), n (occurrences) and d (documents): partial counts of tasks, to be summed.

    Every group that occurs also has a row with an empty term and counts of 0."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        held: list[dict[bytes, int]] = []  # of each group: occurrences, and documents in units of ROWS
        seen = 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in zip(groups, held, strict=True):
                size = len(terms) + 1
                values = np.fromiter(chain(terms.values(), [0]), np.int64, size)
                term = pa.array(chain(terms, [b""]), pa.binary(), size=size)
                terms.clear()
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, size), pa.repeat(source, size), term, pa.array(values % ROWS), pa.array(values // ROWS)], ["lang", "source", "term", "n", "d"])

        for batch in batches:
            names = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            group = np.array([groups.setdefault(g, len(groups)) for g in names], np.int64)
            held += [{} for _ in range(len(groups) - len(held))]
            for i, j, data, offsets in W.slices(batch.column(2), bpe.SLICE):
                for g, term, n, d in count_slice(data, offsets, group[i:j]):
                    own = held[g]
                    own[term] = own.get(term, 0) + n + d * ROWS
                seen += len(data)
                if sum(map(len, held)) > HELD or seen > SEEN:
                    yield from hand_on()
                    seen = 0
        yield from hand_on()

    texts = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], F.col("text").alias("_text"))
    return texts.mapInArrow(run, "lang string, source string, term binary, n long, d long")


def tally(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, term, n, total (of the language) and first (one row for each term of a language) of the terms that
    ``least`` documents of the language hold; and a row with an empty term for each group."""
    summed = term_counts(docs).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    term = Wd.partitionBy("lang", "term")  # a row for each source
    totals = summed.select("*", F.sum("n").over(term).alias("total"), F.sum("d").over(term).alias("rows"), (F.row_number().over(term.orderBy("source")) == 1).alias("first"))
    return totals.where((F.col("rows") >= least) | (F.length("term") == 0)).drop("rows", "d")


def shares(count: np.ndarray, whole: np.ndarray | int, smooth: int = SMOOTH, scale: int = SCALE) -> np.ndarray:
    """``1 + floor(scale * (count + smooth) / whole)``, three digits of ``scale`` at a time so that nothing overflows."""
    left = np.asarray(count, np.int64) + smooth
    whole = np.broadcast_to(np.asarray(whole, np.int64), left.shape)
    out, left = left // whole, left % whole
    while scale > 1:
        step = min(scale, 1000)
        out = out * step + left * step // whole
        left = left * step % whole
        scale //= step
    return out + 1


class Block:
    """The rows of one block of a language: a CSR matrix of shares over (source, term)."""

    def __init__(self, source: np.ndarray, term: np.ndarray, count: np.ndarray, wholes: np.ndarray, terms: int):
        """``source``, ``term``, ``count``: the entries; ``wholes``: N + smooth * V of each source; ``terms``: how many."""
        order = np.lexsort((term, source))
        self.source, self.term, self.terms = source[order], term[order], terms
        self.share = shares(count[order], wholes[self.source])
        self.size = np.bincount(self.source, minlength=len(wholes))
        self.begin = np.cumsum(self.size) - self.size
        self.some = np.flatnonzero(self.size)
        self.zero = shares(np.zeros(len(wholes), np.int64), wholes)

    def divergences(self, a: int) -> np.ndarray:
        """The sum over the block's terms of the distance of source ``a``'s share from each source's."""
        own = np.full(self.terms, self.zero[a])
        mine = slice(self.begin[a], self.begin[a] + self.size[a])
        own[self.term[mine]] = self.share[mine]
        # as if no other source had a term of the block: a sum over sorted shares; then what its entries change
        line = np.sort(own)
        before = np.concatenate([[0], np.cumsum(line)])
        k = np.searchsorted(line, self.zero)
        out = self.zero * k - before[k] + (before[-1] - before[k]) - self.zero * (self.terms - k)
        if len(self.some):
            there = own[self.term]
            change = np.abs(there - self.share) - np.abs(there - self.zero[self.source])
            out[self.some] += np.add.reduceat(change, self.begin[self.some])
        return out

    def leading(self, language: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries, and by how much the source's share lies above the language's (of each term): ``top`` for each source.

        Terms are numbered in the order of their bytes, by which ties go."""
        gap = self.share - language[self.term]
        at = np.flatnonzero(gap > 0)
        at = at[np.lexsort((self.term[at], -gap[at], self.source[at]))]
        n = np.bincount(self.source[at], minlength=len(self.size))
        rank = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        at = at[rank < top]
        return at, gap[at]


def _compare(entries: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """Parts of divergences and leading terms of one block. ``groups``: of (the language), named, whole and language_whole."""
    names = groups.column("named").to_pylist()
    position = {name: k for k, name in enumerate(names)}
    raw = entries.column("term").to_pylist()
    ordered = sorted(set(raw))
    number = {t: k for k, t in enumerate(ordered)}
    source = np.array([position[s] for s in entries.column("source").to_pylist()], np.int64)
    term = np.array([number[t] for t in raw], np.int64)
    rows: dict[str, list] = {"source": [], "part": [], "item": [], "value": []}
    column = lambda table, name: table.column(name).to_numpy().astype(np.int64)
    block = None
    if len(ordered):
        block = Block(source, term, column(entries, "n"), column(groups, "whole"), len(ordered))
        total = np.zeros(len(ordered), np.int64)
        total[term] = column(entries, "total")
        language = shares(total, int(groups.column("language_whole")[0].as_py()))
        at, gap = block.leading(language, top)
        rows["source"] += [names[k] for k in block.source[at].tolist()]
        rows["part"] += ["term"] * len(at)
        rows["item"] += [ordered[k] for k in block.term[at].tolist()]
        rows["value"] += gap.tolist()
    items = [name.encode() for name in names]
    for a, name in enumerate(names):
        values = block.divergences(a).tolist() if block else [0] * len(names)
        rows["source"] += [name] * (len(names) - 1)
        rows["part"] += ["pair"] * (len(names) - 1)
        rows["item"] += items[:a] + items[a + 1 :]
        rows["value"] += values[:a] + values[a + 1 :]
    return pa.table({"lang": pa.array([groups.column("of")[0].as_py()] * len(rows["value"]), pa.string()), "source": pa.array(rows["source"], pa.string()), "part": pa.array(rows["part"], pa.string()), "item": pa.array(rows["item"], pa.binary()), "value": pa.array(rows["value"], pa.int64())})


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language by divergence (part ``pair``), and the
    ``top`` terms whose share in the source lies furthest above that in the language (part ``term``)."""
    kept = materialize(tally(docs, least))
    is_term = F.length("term") > 0
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("all"), count(is_term & F.col("first")).alias("v"), count(is_term).alias("entries"), count(~is_term).alias("sources"))
    # a block gives sources ^ 2 parts, so it takes as many entries at least
    blocks = F.greatest(F.lit(1), F.ceil(F.col("entries") / F.greatest(F.lit(BLOCK), F.col("sources") * F.col("sources")))).cast("int")
    langs = langs.withColumn("blocks", blocks)
    salted = langs.select("lang", "blocks", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    hashed = F.xxhash64("term")
    entries = kept.where(is_term).withColumn("salt", F.pmod(hashed, F.lit(SALT)).cast("int")).join(salted, ["lang", "salt"])
    entries = entries.select("lang", F.pmod(F.shiftright(hashed, 8), F.col("blocks")).cast("int").alias("block"), "source", "term", "n", "total")
    wholes = groups.join(langs, "lang").select(
        F.col("lang").alias("of"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("in"), F.col("source").alias("named"), (F.col("n") + F.lit(SMOOTH) * F.col("v")).alias("whole"), (F.col("all") + F.lit(SMOOTH) * F.col("v")).alias("language_whole")
    )
    parts = entries.groupBy("lang", "block").cogroup(wholes.groupBy("of", "in")).applyInArrow(lambda a, b: _compare(a, b, top), "lang string, source string, part string, item binary, value long")
    summed = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))  # terms lie in one block
    named = summed.withColumn("item", F.col("item").cast("string"))
    order = Wd.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = named.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
