"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text, and how often pairs meet.

A text with a space before it is cut into units where a space follows a character that is no white space. Neither
tokenizer joins bytes across such a place, so a slice's distinct units are encoded once. Over the units' bytes, tokens
of A and B that overlap are joined in a bipartite graph; union-find gives its connected components, which are exactly
the groups between places where both tokenizers end a token. The members of each component are then expanded to links,
all pairs of an A and a B token with common bytes.

Links are counted over the corpus by their ids: each chunk of documents (about ``CHUNK`` bytes) hands on its distinct
pairs with their counts, Spark sums them, the sums go back to the chunks that hold the pair, and each document's links
are weighed with them. What a chunk keeps of a document are its distinct pairs, as positions in the chunk's list.

Edge cases: null and empty texts have no tokens, no groups, and ''; the same goes for texts which A's or B's tokens do
not spell byte by byte (B reads U+2581 as a space); rows that repeat are documents of their own, so their links count
as often; ties for a B id's highest count all count; null ids are kept; an empty table gives no rows; columns that are
not asked for are dropped, whatever their names; a text of any length is read whole, as a chunk by itself if need be.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm import bpe
from tilewright.llm import words as W
from tilewright.plans.storage import bound_batches, materialize

#: Bytes of text whose distinct units are encoded together, and of a chunk.
SLICE, CHUNK = 4 << 20, 8 << 20
#: A pair's code is the A id times this and the B id, which is below it.
BELOW = 1 << 16

#: Each id below BELOW in decimal digits, and how many it has.
DIGITS = np.array([b"%d" % i for i in range(BELOW)], "S6").view(np.uint8).reshape(BELOW, 6)
N_DIGITS = (DIGITS != 0).sum(1)


class ByteTokens(bpe.RankEncoder):
    """A, from a byte-level tokenizer file whose ids are in the order of its merges; no special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        byte = {chr(b) if b in printable else chr(next(spare)): b for b in range(256)}
        special = {t["content"] for t in spec["added_tokens"]}
        vocabulary = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        tokens = list(vocabulary)
        self.ids = np.array(list(vocabulary.values()), np.uint32)
        self.hash = bpe.PerfectHash(tokens)
        self.vocabulary = self.hash.flat.tobytes()
        self.ranks = vocabulary
        self.known = {}
        self.size = np.zeros(int(self.ids.max()) + 1, np.int64)
        self.size[self.ids] = [len(t) for t in tokens]
        self.begin = np.zeros(len(self.size), np.int64)
        self.begin[self.ids] = self.hash.begins


class PieceTokens:
    """B, from a model file of pieces; the model puts a space before each text."""

    def __init__(self, path: str):
        self.path = path
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(model.id_to_piece(list(range(len(model)))))]
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.whole = not any(b" " in p.lstrip(b" ") for p in pieces)  # no piece joins what a unit ends in to a space
        self.space = model.piece_to_id("▁")
        self._model = model

    def __getstate__(self):
        return self.__dict__ | {"_model": None}

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text with the model's space before it; of an empty one, which the model skips, that of the space."""
        if self._model is None:
            self._model = sentencepiece.SentencePieceProcessor(model_file=self.path)
        return [ids or [self.space] for ids in self._model.encode(texts, num_threads=1)]


def cut_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows that are not empty with a space before each: bytes, the units' starts and ends, and how many each row has."""
    some = np.flatnonzero(np.diff(offsets))
    data = np.insert(data, offsets[some], 32)
    begins = offsets[some] + np.arange(len(some))
    one, two, three = (np.concatenate([np.zeros(k, np.uint8), data[:-k]]) if len(data) >= k else np.zeros(len(data), np.uint8) for k in (1, 2, 3))
    low = one & 0x3F
    blank = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))  # white space beyond ASCII ends in these
    blank |= (three >= 0xE1) & (three <= 0xE3) & ((two == 0x80) | (two == 0x81) | (two == 0x9A)) & ((low <= 10) | np.isin(one, [0xA8, 0xA9, 0xAF, 0x9F]))
    cut = (data == 32) & (one > 32) & (one != 127) & ~blank
    cut[begins] = True
    starts = np.flatnonzero(cut)
    counts = np.zeros(len(offsets) - 1, np.int64)
    counts[some] = np.diff(np.append(np.searchsorted(starts, begins), len(starts)))
    return data, starts, np.append(starts[1:], len(data)), counts


def union(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, by union-find: roots of all edges at once are hung below the smaller
    one of their edge, and paths are halved until every node points to its root."""
    parent = np.arange(n)
    while len(left):
        a, b = parent[left], parent[right]
        live = a != b
        left, right, a, b = left[live], right[live], a[live], b[live]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(parent, above := parent[parent]):
            parent = above
    return parent


class Units:
    """The alignment of distinct units, which lie one after another."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: ByteTokens, second: PieceTokens):
        size = ends - starts
        raw = data.tobytes()
        spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
        flat = np.frombuffer(b"".join(raw[a:b] for a, b in spans), np.uint8)
        cut = np.concatenate([[0], np.cumsum(size)])
        a_ids, a_cut = first.encode(flat, cut)
        lists = second.encode([raw[a + 1 : b].decode("utf-8", "replace") for a, b in spans])
        b_cut = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        b_ids = np.fromiter((i for x in lists for i in x), np.int64, int(b_cut[-1]))
        self.good = self._spelt(flat, cut, a_ids, a_cut, first, first.hash.flat) & self._spelt(flat, cut, b_ids, b_cut, second, second.flat)
        kept_a, kept_b = np.repeat(self.good, np.diff(a_cut)), np.repeat(self.good, np.diff(b_cut))
        self.n_a, self.n_b = np.where(self.good, np.diff(a_cut), 0), np.where(self.good, np.diff(b_cut), 0)
        self._align(a_ids[kept_a].astype(np.int64), b_ids[kept_b], first, second)

    @staticmethod
    def _spelt(flat: np.ndarray, cut: np.ndarray, ids: np.ndarray, id_cut: np.ndarray, tokens, token_bytes: np.ndarray) -> np.ndarray:
        """Whether the tokens of each unit, none of them empty, spell its bytes."""
        size = np.diff(cut)
        sums = lambda x, c: np.diff(np.concatenate([[0], np.cumsum(x)])[c])
        each = tokens.size[ids]
        good = (sums(each, id_cut) == size) & (sums(each == 0, id_cut) == 0)
        kept = np.repeat(good, np.diff(id_cut))
        spelt = bpe._gather(token_bytes, tokens.begin, tokens.size, ids[kept])
        wrong = spelt != flat[np.repeat(good, size)]
        good[good] = sums(wrong, np.concatenate([[0], np.cumsum(size[good])])) == 0
        return good

    def _align(self, a_ids: np.ndarray, b_ids: np.ndarray, first: ByteTokens, second: PieceTokens) -> None:
        n = len(a_ids)
        a_end, b_end = np.cumsum(first.size[a_ids]), np.cumsum(second.size[b_ids])
        a_from, b_from = a_end - first.size[a_ids], b_end - second.size[b_ids]
        # a token and the other side's token at its first byte overlap; such edges join all that overlap
        from_b, to_b = np.searchsorted(b_end, a_from, "right"), np.searchsorted(b_end, a_end, "left")
        from_a = np.searchsorted(a_end, b_from, "right")
        root = union(n + len(b_ids), np.concatenate([np.arange(n), from_a]), np.concatenate([n + from_b, n + np.arange(len(b_ids))]))
        a_unit, b_unit = np.repeat(np.arange(len(self.n_a)), self.n_a), np.repeat(np.arange(len(self.n_b)), self.n_b)
        count = lambda of: np.bincount(of, minlength=len(self.n_a)).astype(np.int64)
        self.n_groups = count(a_unit[root[:n] == np.arange(n)])
        # members to links, unit by unit
        each = to_b - from_b + 1
        b = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each - from_b, each)
        self.pairs = np.repeat(a_ids, each) * BELOW + b_ids[b]
        self.n_links = count(np.repeat(a_unit, each))
        # a1,a2|b1; for each group: ids of A and then of B in order, each with the mark that follows it
        key = np.concatenate([2 * root[:n], 2 * root[n:] + 1])
        order = np.argsort(key, kind="stable")
        key = key[order]
        ids = np.concatenate([a_ids, b_ids])[order]
        last = np.append(key[1:] != key[:-1], True) if len(key) else np.zeros(0, bool)
        text, size = DIGITS[ids], N_DIGITS[ids]
        text[np.arange(len(ids)), size] = np.where(last, np.where(key & 1, ord(";"), ord("|")), ord(","))
        text = text[np.arange(6) <= size[:, None]].tobytes()
        at = np.concatenate([[0], np.cumsum(size + 1)])
        unit = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])
        cut = at[unit].tolist()
        self.texts = [text[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]


def _rows(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[cut])


def align_slice(data: np.ndarray, offsets: np.ndarray, first: ByteTokens, second: PieceTokens) -> tuple[dict[str, np.ndarray], list[bytes], tuple[np.ndarray, ...]]:
    """Of each row n_a, n_b, n_groups and n_links, the groups as text, and the pairs: distinct codes, the offsets of the
    rows' distinct pairs, their positions among the codes, and how often each occurs in the row."""
    data, starts, ends, counts = cut_units(data, offsets)
    if second.whole:
        one, which, _ = bpe.distinct(data, starts, ends)
    else:  # pieces that hold a space within: rows are units
        cut = np.concatenate([[0], np.cumsum(counts)])
        some = counts > 0
        starts, ends, counts = starts[cut[:-1][some]], ends[cut[1:][some] - 1], some.astype(np.int64)
        one = which = np.arange(len(starts))
    units = Units(data, starts[one], ends[one], first, second)
    cut = np.concatenate([[0], np.cumsum(counts)])
    whole = _rows(~units.good[which], cut) == 0
    which, counts = which[np.repeat(whole, counts)], np.where(whole, counts, 0)
    cut = np.concatenate([[0], np.cumsum(counts)])
    numbers = {name: _rows(getattr(units, name)[which], cut) for name in ("n_a", "n_b", "n_groups", "n_links")}
    listed = which.tolist()
    texts = [b"".join([units.texts[w] for w in listed[i:j]])[:-1] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    codes, of_link = np.unique(units.pairs, return_inverse=True)
    cell, times = np.unique(np.repeat(np.arange(len(counts)), counts) * len(units.n_a) + which, return_counts=True)  # (row, unit)
    row, unit = np.divmod(cell, max(1, len(units.n_a)))
    each = units.n_links[unit]
    link = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each - (np.cumsum(units.n_links) - units.n_links)[unit], each)
    key = np.repeat(row, each) * max(1, len(codes)) + of_link[link]
    order = np.argsort(key, kind="stable")
    key, at = np.unique(key[order], return_index=True)
    n = np.add.reduceat(np.repeat(times, each)[order], at) if len(at) else np.zeros(0, np.int64)
    row_cut = np.searchsorted(key, np.arange(len(counts) + 1) * max(1, len(codes)))
    return numbers, texts, (codes, row_cut, key % max(1, len(codes)), n)


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def align(docs: DataFrame, path_a: str, path_b: str, keep: tuple[str, ...] = ("doc_id",), groups: bool = False) -> DataFrame:
    """``keep``, n_a, n_b, n_groups, n_links and groups_sha256 of each text, with ``groups`` also the groups as text.

    For ``weigh`` also _chunk, _at and _times (a document's distinct pairs), and one row for each chunk with _pairs and
    _counts instead of a document."""
    bound_batches(docs.sparkSession)
    first = docs.sparkSession.sparkContext.broadcast(ByteTokens(path_a))
    second = docs.sparkSession.sparkContext.broadcast(PieceTokens(path_b))
    names = [*keep, *NUMBERS, "groups_sha256", *["groups"] * groups, "_chunk", "_at", "_times", "_pairs", "_counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, chunk = 0, (TaskContext.get().partitionId() << 32) - 1

        def hand_on() -> Iterator[pa.RecordBatch]:
            codes = np.unique(np.concatenate([h[3][0] for h in held]))
            counts = np.zeros(len(codes), np.int64)
            for kept, numbers, texts, (own, cut, at, n) in held:
                place = np.searchsorted(codes, own)[at].astype("<u4")
                np.add.at(counts, place, n)
                n = n.astype("<u4")
                spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
                digest = [hashlib.sha256(t).hexdigest() if k else "" for t, k in zip(texts, numbers["n_a"].tolist(), strict=True)]
                columns = [*kept, *(numbers[name] for name in NUMBERS), pa.array(digest, pa.string()), *[pa.array([t.decode() for t in texts], pa.string())] * groups, pa.array([chunk] * len(spans), pa.int64())]
                columns += [pa.array([place[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([n[a:b].tobytes() for a, b in spans], pa.binary()), *[pa.nulls(len(spans), pa.list_(pa.int64()))] * 2]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names)
            last = [pa.nulls(1, c.type) for c in held[0][0]] + [pa.nulls(1, pa.int64())] * 4 + [pa.nulls(1, pa.string())] * (1 + groups)
            last += [pa.array([chunk], pa.int64()), *[pa.nulls(1, pa.binary())] * 2, pa.array([codes.tolist()], pa.list_(pa.int64())), pa.array([counts.tolist()], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(last, names)
            held.clear()

        for batch in batches:
            for i, j, data, offsets in W.slices(batch.column(batch.num_columns - 1), SLICE):
                held.append(([batch.column(k).slice(i, j - i) for k in range(len(keep))], *align_slice(data, offsets, first.value, second.value)))
                size += len(data)
                if size >= CHUNK:
                    chunk, size = chunk + 1, 0
                    yield from hand_on()
        if held:
            chunk += 1
            yield from hand_on()

    plain = docs.select(*keep, F.col("text").alias("_text"))
    schema = plain.drop("_text").schema
    for name in NUMBERS:
        schema = schema.add(name, "long")
    schema = schema.add("groups_sha256", "string")
    if groups:
        schema = schema.add("groups", "string")
    return plain.mapInArrow(run, schema.add("_chunk", "long").add("_at", "binary").add("_times", "binary").add("_pairs", T.ArrayType(T.LongType())).add("_counts", T.ArrayType(T.LongType())))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair (a code), n (links of the corpus that hold it) and best (no other pair of its B id has more)."""
    each = aligned.where("_pairs IS NOT NULL").select(F.explode(F.arrays_zip("_pairs", "_counts")).alias("x"))
    counts = materialize(each.groupBy(F.col("x._pairs").alias("pair")).agg(F.sum("x._counts").alias("n")))
    second = F.pmod("pair", F.lit(BELOW))
    most = counts.groupBy(second.alias("b")).agg(F.max("n").alias("most"))  # one row for each id of B: fewer than BELOW
    return counts.join(F.broadcast(most), second == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _weigh(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """count_sum and n_best of a chunk's documents. ``pairs``: of (chunk), position, n and best of its pairs."""
    n, best = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, np.int64)
    at = pairs.column("position").to_numpy()
    n[at], best[at] = pairs.column("n").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
    sums, bests = [], []
    for place, times in zip(docs.column("_at"), docs.column("_times"), strict=True):
        place, times = (np.frombuffer(x.as_buffer(), "<u4").astype(np.int64) for x in (place, times))
        sums.append(int(n[place] @ times))
        bests.append(int(best[place] @ times))
    return docs.drop_columns(["_chunk", "_at", "_times"]).append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))


def weigh(aligned: DataFrame) -> DataFrame:
    """``align``'s documents with n_best and count_sum: their links' counts over the corpus. ``aligned`` is written once."""
    written = materialize(aligned)
    pairs = written.where("_pairs IS NOT NULL").select(F.col("_chunk").alias("of"), F.posexplode("_pairs").alias("position", "pair"))
    found = pairs.join(pair_counts(written), "pair").select("of", "position", "n", "best")
    docs = written.where("_pairs IS NULL").drop("_pairs", "_counts")
    schema = docs.drop("_chunk", "_at", "_times").schema.add("n_best", "long").add("count_sum", "long")
    return docs.groupBy("_chunk").cogroup(found.groupBy("of")).applyInArrow(_weigh, schema)
