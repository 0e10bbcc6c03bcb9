"""Byte-pair encoding, decoding and counting with the vocabularies of public tokenizers.

Texts are cut into pre-tokens by array operations on code points, following the tokenizer's split pattern; the
distinct pre-tokens of a slice are found by hash and only those are encoded.

* ``encode``: two tiers. A minimal perfect hash resolves whole pre-tokens that are in the vocabulary; the others are
  merged by ``merge_bytes``, a heap over linked bytes. ``decode`` joins the bytes of ids.
* ``count``: ``merged_length`` pops the lowest-ranked adjacent pair from a heap over a linked list; the count is the
  number of initial symbols less the merges, and no identifiers are made.

Edge cases: nulls count as empty texts, which have no tokens; rows that repeat get equal results; null ids are kept;
an empty table gives no rows; other columns are not looked at. A pre-token may be as long as a whole text: merging
takes n log n steps. Bytes that are not UTF-8 are read as U+FFFD.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm import words as W
from tilewright.plans.storage import bound_batches

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Pre-tokens whose result a worker remembers at most; beyond that it starts anew.
CACHE = 300_000
#: Bytes of text whose distinct pre-tokens are looked up together: more than elsewhere, as each costs a look-up.
SLICE = 1 << 20
#: The code points with Unicode's White_Space property.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of every code point."""
    global _classes
    if _classes is None:
        table = np.zeros(0x110000, np.uint8)
        everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        shift = lambda i: i if i < 0xD800 else i + 0x800
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, everything):
                table[shift(m.start()) : shift(m.end() - 1) + 1] = kind
        table[WHITE_SPACE] = SPACE
        _classes = table
    return _classes


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points, the byte each starts at (and the end), the rows' offsets in code points, and the bytes."""
    try:
        text = data.tobytes().decode()
    except UnicodeDecodeError:
        rows = [data[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
        data = np.frombuffer(b"".join(rows), np.uint8)
        text = data.tobytes().decode()
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    return points, at, np.searchsorted(at, offsets), data


def _contractions(points: np.ndarray, kind: np.ndarray, start: np.ndarray, edge: np.ndarray) -> None:
    """Where a token starts with an apostrophe that stands alone before s, t, re, ve, m, ll or d, they are one token."""
    n = len(points)
    at = np.flatnonzero((points == 39) & start[:n])
    at = at[at + 1 < n]
    at = at[(kind[at + 1] == LETTER) & ~edge[at + 1]]
    one = points[at + 1]
    two = points[np.minimum(at + 2, n - 1)]
    long = (at + 2 < n) & ~edge[np.minimum(at + 2, n)]
    size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
    for pair in ("re", "ve", "ll"):
        size[long & (one == ord(pair[0])) & (two == ord(pair[1]))] = 3
    at, size = at[size > 0], size[size > 0]
    start[at + 1] = False
    after = at + size
    start[after[after <= n]] = True


def pretokens(points: np.ndarray, rows: np.ndarray, joined: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens.

    ``joined``: a space goes with the run that follows it and other white space is kept (the pattern of the rank
    files). Otherwise white space is dropped and each number character stands alone (the pattern of word_bpe)."""
    n = len(points)
    kind = classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[rows] = True
    edge[n] = True
    start = edge.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    if joined:
        space = kind == SPACE
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:n]) if n > 1 else np.zeros(0, np.int64)
        start[last] = True
        start[last[points[last] == 32] + 1] = False
    else:
        start[:n] |= kind == NUMBER
    _contractions(points, kind, start, edge)
    cuts = np.flatnonzero(start)
    begins, ends = cuts[:-1], cuts[1:]
    if not joined:
        keep = kind[begins] != SPACE
        begins, ends = begins[keep], ends[keep]
    return begins, ends


def distinct(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the first of each distinct byte span, the number of each span's distinct one, and the first ones' hashes.

    Spans with equal hashes are compared byte by byte with the first of them."""
    h = W.span_hashes(data, begins, ends)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    if not _same_bytes(data, begins, ends, first[which]):
        seen: dict[bytes, int] = {}
        which = np.array([seen.setdefault(data[a:b].tobytes(), len(seen)) for a, b in zip(begins, ends, strict=True)], np.int64)
        first = np.unique(which, return_index=True)[1]
    return first, which, h[first]


def _same_bytes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, other: np.ndarray) -> bool:
    """Whether each span has the bytes of the span numbered ``other``; a slice of spans at a time."""
    size = ends - begins
    if not np.array_equal(size, size[other]):
        return False
    total = np.cumsum(size)
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(total, total[a] - size[a] + W.CHUNK, "right")))
        step = np.arange(total[b - 1] - total[a] + size[a]) - np.repeat(total[a:b] - size[a:b] - total[a] + size[a], size[a:b])
        if not np.array_equal(data[np.repeat(begins[a:b], size[a:b]) + step], data[np.repeat(begins[other[a:b]], size[a:b]) + step]):
            return False
        a = b
    return True


class PerfectHash:
    """A minimal perfect hash over byte strings, by hash and displace: a bucket's displacement sends its keys to free
    slots of a table as large as the key set; buckets with one key name their slot directly."""

    def __init__(self, keys: list[bytes]):
        self.ends = np.cumsum([len(k) for k in keys])
        self.flat = np.frombuffer(b"".join(keys), np.uint8)
        self.begins = self.ends - np.array([len(k) for k in keys])
        h1, h2 = W.span_hashes(self.flat, self.begins, self.ends), W.span_hashes(self.flat, self.begins, self.ends, 1)
        n = len(keys)
        self.buckets = max(1, n // 4)
        self.shift, self.key = np.zeros(self.buckets, np.int64), np.zeros(n, np.int64)
        self.mark = h2
        order = np.argsort(h1 % np.uint64(self.buckets), kind="stable")
        sizes = np.bincount((h1 % np.uint64(self.buckets)).astype(np.int64), minlength=self.buckets)
        cut = np.concatenate([[0], np.cumsum(sizes)])
        free = np.ones(n, bool)
        tries = np.arange(1, 257, dtype=np.uint64)[:, None]
        for b in np.argsort(-sizes, kind="stable"):
            own = order[cut[b] : cut[b + 1]]
            if len(own) < 2:
                break
            base = 0
            while True:
                slots = ((h2[own] + (tries + np.uint64(base)) * (h1[own] | np.uint64(1))) % np.uint64(n)).astype(np.int64)
                good = free[slots].all(1)
                for k in np.flatnonzero(good):
                    if len(set(slots[k])) == len(own):
                        free[slots[k]] = False
                        self.key[slots[k]] = own
                        self.shift[b] = base + k + 1
                        break
                else:
                    base += 256
                    continue
                break
        left = iter(np.flatnonzero(free))
        for b in np.flatnonzero(sizes == 1):
            slot = next(left)
            self.key[slot], self.shift[b] = order[cut[b]], -slot - 1

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The key that the hashes belong to if they belong to any, else -1. The caller compares the bytes."""
        d = self.shift[(h1 % np.uint64(self.buckets)).astype(np.int64)]
        slot = ((h2 + d.astype(np.uint64) * (h1 | np.uint64(1))) % np.uint64(len(self.key))).astype(np.int64)
        key = self.key[np.where(d < 0, -d - 1, slot)]
        return np.where(self.mark[key] == h2, key, -1)


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: a heap of adjacent pairs over linked bytes; the lowest rank, leftmost first, is merged."""
    n = len(piece)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        if (r := ranks.get(piece[i : i + 2])) is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if j == 0 or j >= n or end[j] != stop:
            continue  # one of the two has been merged since
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def merged_length(symbols: list[str], merges: dict[tuple[str, str], int]) -> int:
    """How many symbols are left when the lowest-ranked adjacent pair, leftmost first, is merged again and again."""
    n = len(symbols)
    after, before, stamp = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n
    heap = [(r, i, 0, 0) for i in range(n - 1) if (r := merges.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, own, other = heapq.heappop(heap)
        j = after[i]
        if stamp[i] != own or j >= n or stamp[j] != other:
            continue
        symbols[i] += symbols[j]
        stamp[i], stamp[j] = stamp[i] + 1, -1
        after[i] = after[j]
        left -= 1
        if (k := after[i]) < n:
            before[k] = i
            if (r := merges.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i, stamp[i], stamp[k]))
        if (h := before[i]) >= 0 and (r := merges.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h, stamp[h], stamp[i]))
    return left


def read_ranks(path: str) -> tuple[list[bytes], np.ndarray]:
    """Tokens and ids of a rank file: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f.read().splitlines() if line.strip()]
    return [base64.b64decode(t) for t, _ in pairs], np.array([int(r) for _, r in pairs], np.uint32)


class RankEncoder:
    """Texts to ids by the ranks of a file."""

    def __init__(self, path: str):
        tokens, self.ids = read_ranks(path)
        self.hash = PerfectHash(tokens)
        self.vocabulary = self.hash.flat.tobytes()
        self.ranks = dict(zip(tokens, self.ids.tolist(), strict=True))
        self.known: dict[bytes, list[int]] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows one after another, and the rows' offsets in them."""
        points, at, rows, data = code_points(data, offsets)
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        begins, ends = pretokens(points, rows, joined=True)
        bytes_from, bytes_to = at[begins], at[ends]
        first, which, h1 = distinct(data, bytes_from, bytes_to)
        h2 = W.span_hashes(data, bytes_from[first], bytes_to[first], 1)
        raw = data.tobytes()
        pieces: list[list[int]] = []
        table = self.hash
        if len(self.known) > CACHE:
            self.known.clear()
        for a, b, k in zip(bytes_from[first].tolist(), bytes_to[first].tolist(), table.find(h1, h2).tolist(), strict=True):
            piece = raw[a:b]
            if k >= 0 and self.vocabulary[table.begins[k] : table.ends[k]] == piece:
                pieces.append([int(self.ids[k])])
            elif (found := self.known.get(piece)) is not None:
                pieces.append(found)
            else:
                found = merge_bytes(piece, self.ranks)
                if len(piece) <= 256:
                    self.known[piece] = found
                pieces.append(found)
        sizes = np.array([len(p) for p in pieces], np.int64)
        flat = np.fromiter((i for p in pieces for i in p), np.uint32, int(sizes.sum()))
        ids = _gather(flat, np.cumsum(sizes) - sizes, sizes, which)
        total = np.concatenate([[0], np.cumsum(sizes[which])])
        return ids, total[np.searchsorted(begins, rows)]


class RankDecoder:
    """Ids to bytes: the tokens one after another, and where each id's token lies."""

    def __init__(self, path: str):
        tokens, ids = read_ranks(path)
        own = np.array([len(t) for t in tokens], np.int64)
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.begins, self.sizes = np.zeros(int(ids.max()) + 1, np.int64), np.zeros(int(ids.max()) + 1, np.int64)
        self.begins[ids], self.sizes[ids] = np.cumsum(own) - own, own

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids one after another, and how many each has."""
        return _gather(self.flat, self.begins, self.sizes, ids), self.sizes[ids]


def _gather(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """``flat[begins[w] : begins[w] + sizes[w]]`` for each w of ``which``, one after another."""
    each = sizes[which]
    ends = np.cumsum(each)
    return flat[np.repeat(begins[which] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``ids``: the tokens of ``text`` as little-endian unsigned 32-bit integers."""
    bound_batches(docs.sparkSession)
    encoder = docs.sparkSession.sparkContext.broadcast(RankEncoder(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for _, _, data, offsets in W.slices(batch.column(batch.num_columns - 1), SLICE):
                ids, cut = encoder.value.encode(data, offsets)
                raw = ids.astype("<u4").tobytes()
                out += [raw[4 * a : 4 * b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({k: batch.column(i) for i, k in enumerate(keep)} | {"ids": _binary(out)})
        encoder.value.known.clear()

    plain = docs.select(*keep, F.col("text").alias("_text"))
    return plain.mapInArrow(W.giving_back(run), plain.drop("_text").schema.add("ids", "binary"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The same columns and ``decoded``: the bytes that ``ids`` stand for (null: none)."""
    bound_batches(encoded.sparkSession)
    decoder = encoded.sparkSession.sparkContext.broadcast(RankDecoder(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for _, _, data, offsets in W.slices(batch.column(batch.schema.get_field_index("ids")), SLICE):
                raw, sizes = decoder.value.decode(np.frombuffer(data.tobytes(), "<u4"))
                total = np.concatenate([[0], np.cumsum(sizes)])[offsets // 4].tolist()
                raw = raw.tobytes()
                out += [raw[a:b] for a, b in zip(total[:-1], total[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, _binary(out)], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(W.giving_back(run), T.StructType([*encoded.schema, T.StructField("decoded", T.BinaryType())]))


class MergeCounter:
    """A tokenizer file with word-end merges, whose texts are NFC-normalised and lower-cased first."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.merges = {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in reversed(list(enumerate(model["merges"])))}
        self.specials = re.compile("|".join(re.escape(t["content"]) for t in sorted(spec["added_tokens"], key=lambda t: -len(t["content"]))))
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        self.symbols = [chr(b) if b in printable else chr(next(spare)) for b in range(256)]
        self.known: dict[bytes, int] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def piece(self, piece: bytes) -> int:
        if (found := self.known.get(piece)) is None:
            symbols = [self.symbols[b] for b in piece]
            symbols[-1] += self.suffix
            found = merged_length(symbols, self.merges)
            if len(piece) <= 256:
                self.known[piece] = found
        return found

    def count(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text; a special token's string in a text is one token."""
        out = np.zeros(len(texts), np.int64)
        parts: list[bytes] = []
        of: list[int] = []
        for k, raw in enumerate(texts):
            text = raw.decode("utf-8", "replace")
            cut = self.specials.split(text) if "<|" in text else [text]
            out[k] = len(cut) - 1
            for part in cut:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                parts.append(part.lower().encode())
                of.append(k)
        data = np.frombuffer(b"".join(parts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        points, at, rows, data = code_points(data, offsets)
        if not len(points):
            return out
        begins, ends = pretokens(points, rows, joined=False)
        if not len(begins):
            return out
        if len(self.known) > CACHE:
            self.known.clear()
        first, which, _ = distinct(data, at[begins], at[ends])
        raw = data.tobytes()
        sizes = np.array([self.piece(raw[a:b]) for a, b in zip(at[begins[first]].tolist(), at[ends[first]].tolist(), strict=True)], np.int64)
        total = np.concatenate([[0], np.cumsum(sizes[which])])[np.searchsorted(begins, rows)]
        np.add.at(out, np.array(of), np.diff(total))
        return out


def count(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``n_bytes`` and ``n_tokens`` of ``text``."""
    bound_batches(docs.sparkSession)
    counter = docs.sparkSession.sparkContext.broadcast(MergeCounter(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_tokens = [], []
            for _, _, data, offsets in W.slices(batch.column(batch.num_columns - 1), SLICE):
                n_bytes.append(np.diff(offsets))
                raw = data.tobytes()
                n_tokens.append(counter.value.count([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]))
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_pydict({k: batch.column(i) for i, k in enumerate(keep)} | {"n_bytes": np.concatenate(n_bytes or none), "n_tokens": np.concatenate(n_tokens or none)})

    plain = docs.select(*keep, F.col("text").alias("_text"))
    return plain.mapInArrow(run, plain.drop("_text").schema.add("n_bytes", "long").add("n_tokens", "long"))
