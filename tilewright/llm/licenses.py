"""Licence scans: identifier tags and notice phrases by Aho-Corasick, and/or/with expressions by a shunting yard.

A text is lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; one automaton finds every phrase
in the words of a slice. There are three kinds of places:

* base phrases (``BASE``), wherever their words stand consecutively, overlapping ones included;
* notices (``NOTICES``), the leftmost longest ones; neighbours with nothing but filler words and one of and, or, with
  between them form an expression ("under the MIT License or the Apache License, Version 2.0");
* tags (``SPDX-License-Identifier``), whose expression is the rest of the line, with parentheses.

Expressions are brought to postfix order by a shunting yard (with binds before and, and before or) and evaluated to a
burden from 0 to 100: or leaves the choice (the least), and adds up (the most), with takes an exception into account.
All expressions and base phrases of a text hold together, so its burden is the largest of them.

Edge cases: a null text is empty, and an empty or wordless text has no places and burden 0; a malformed expression
counts as far as it can be read, that is up to the first token that does not fit, without a dangling operator, and with
open parentheses closed; unknown identifiers have the burden ``UNKNOWN``; rows that repeat give equal results; null ids
are kept; an empty table gives no rows; columns that are not asked for are dropped, whatever their names; texts of any
length are scanned whole, and a text takes memory in proportion.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm import words as W
from tilewright.plans.storage import bound_batches

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: The words of a tag, and how its expression is read from the raw text.
TAG = "spdx license identifier"
TOKEN = re.compile(rb"[ \t:]*(?:([()])|([A-Za-z0-9.+-]+))")
#: Notices in words, and the identifiers they stand for.
NOTICES = {
    "mit license": "mit", "isc license": "isc", "bsd license": "bsd", "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause", "zlib license": "zlib", "boost software license": "bsl-1.0",
    "apache license": "apache", "apache license version 2 0": "apache-2.0", "apache 2 0": "apache-2.0", "mozilla public license": "mpl", "mozilla public license version 2 0": "mpl-2.0", "eclipse public license": "epl",
    "general public license": "gpl", "gnu general public license version 2": "gpl-2.0", "gnu general public license version 3": "gpl-3.0", "lesser general public license": "lgpl", "gnu lesser general public license version 3": "lgpl-3.0",
    "affero general public license": "agpl", "gnu affero general public license version 3": "agpl-3.0", "classpath exception": "classpath-exception", "linking exception": "linking-exception",
    "cc by": "cc-by", "cc by 4 0": "cc-by-4.0", "cc by sa": "cc-by-sa", "cc by sa 4 0": "cc-by-sa-4.0", "cc by nc": "cc-by-nc", "cc by nc 4 0": "cc-by-nc-4.0", "cc by nd": "cc-by-nd", "cc by nd 4 0": "cc-by-nd-4.0", "cc0": "cc0",
    "creative commons attribution": "cc-by", "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution sharealike": "cc-by-sa", "public domain": "public-domain", "unlicense": "unlicense", "all rights reserved": "reserved",
}
#: Burdens of families of identifiers; an identifier belongs to the longest name that starts it.
BURDENS = {
    "public-domain": 5, "cc0": 5, "unlicense": 5, "mit": 20, "isc": 20, "bsd": 20, "bsl": 20, "zlib": 20, "apache": 20, "cc-by": 20, "mpl": 50, "epl": 50, "lgpl": 50, "cc-by-sa": 50,
    "gpl": 75, "agpl": 85, "cc-by-nc": 90, "cc-by-nd": 90, "reserved": 100, "classpath-exception": 5, "linking-exception": 5,
}
UNKNOWN = 60
#: What an exception takes off a burden, and the least that is left.
EXCEPTION, LEAST = 25, 5
BINDS = {"or": 1, "and": 2, "with": 3}
FILLERS = {"the", "a", "an", "either", "license", "licence", "version", "gnu", "at", "your", "option", "later", "only", "under", "any"}

INSIDE = np.zeros(256, bool)
INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Bytes of normalised text: word bytes in lower case, everything else a blank.
PLAIN = np.where(INSIDE, W.LOWER, 32).astype(np.uint8)

PLACE = T.StructType([T.StructField("label", T.StringType()), T.StructField("word", T.LongType()), T.StructField("base", T.BooleanType())])
EXPRESSION = T.StructType([T.StructField("word", T.LongType()), T.StructField("postfix", T.StringType()), T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("burden", T.IntegerType())])

_automaton: ahocorasick.Automaton | None = None


def automaton() -> ahocorasick.Automaton:
    """All phrases, each with its words; made once in each worker."""
    global _automaton
    if _automaton is None:
        found = ahocorasick.Automaton()
        for phrase in {*BASE, *NOTICES, TAG}:
            found.add_word(phrase, phrase)
        found.make_automaton()
        _automaton = found
    return _automaton


def identifier(token: str) -> str:
    """An identifier without case and without the suffixes for a version or any later one."""
    return re.sub(r"(?:-only|-or-later|\+)$", "", token.lower())


def burden(name: str) -> int:
    """The burden of an identifier's family."""
    family = max((f for f in BURDENS if name == f or name.startswith(f + "-")), key=len, default="")
    return BURDENS.get(family, UNKNOWN)


def postfix(tokens: list[str]) -> list[str]:
    """The tokens of an infix expression in postfix order, by a shunting yard; reading ends where a token does not fit."""
    out: list[str] = []
    held: list[str] = []
    operand = True
    for token in tokens:
        low = token.lower()
        if operand and token == "(":
            held.append(token)
        elif operand and low not in BINDS and token != ")":
            out.append(identifier(token))
            operand = False
        elif not operand and low in BINDS:
            while held and held[-1] != "(" and BINDS[held[-1]] >= BINDS[low]:
                out.append(held.pop())
            held.append(low)
            operand = True
        elif not operand and token == ")" and "(" in held:
            while (top := held.pop()) != "(":
                out.append(top)
        else:
            break
    while operand and held:  # operators and parentheses that nothing follows
        if held.pop() in BINDS:
            break
    return out + [t for t in reversed(held) if t != "("]


def evaluate(ordered: list[str]) -> tuple[list[str], int]:
    """The identifiers of a postfix expression, exceptions included, and its burden."""
    stack: list[int] = []
    names: set[str] = set()
    for token in ordered:
        if token in BINDS:
            right, left = stack.pop(), stack.pop()
            stack.append(min(left, right) if token == "or" else max(left, right) if token == "and" else max(LEAST, left - EXCEPTION))
        else:
            names.add(token)
            stack.append(burden(token))
    return sorted(names), stack[-1] if stack else 0


def _read(line: bytes) -> tuple[list[str], int]:
    """The tokens up to what is no token, and where the last ends."""
    tokens, at = [], 0
    while m := TOKEN.match(line, at):
        tokens.append((m[1] or m[2]).decode())
        at = m.end()
    return tokens, at


def _within(word: int, spans: list[tuple[int, int]]) -> bool:
    """Whether the last span that begins at or before ``word`` reaches past it; spans lie in order."""
    k = bisect.bisect_right(spans, (word, 1 << 62)) - 1
    return k >= 0 and word < spans[k][1]


def _notices(found: list[tuple[int, int, str]], word: Callable[[int], str]) -> list[tuple[int, list[str]]]:
    """(first word, tokens) of the expressions that leftmost longest notices form with the operators between them.

    ``found``: (first word, end word, name), ``word``: the text of a word."""
    chosen: list[tuple[int, int, str]] = []
    for begin, end, name in sorted(found, key=lambda f: (f[0], -f[1])):
        if not chosen or begin >= chosen[-1][1]:
            chosen.append((begin, end, name))
    out: list[tuple[int, list[str]]] = []
    last = 0
    for begin, end, name in chosen:
        between = [word(i) for i in range(last, begin)] if out and begin - last <= 8 else None
        joins = [b for b in between if b in BINDS] if between is not None else []
        if len(joins) == 1 and all(b in FILLERS or b in BINDS for b in between):
            out[-1][1].extend([joins[0], name])
        else:
            out.append((begin, [name]))
        last = end
    return out


def scan_slice(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[tuple]], list[list[tuple]]]:
    """Of each row: the number of words, its places (label, word, base) and its expressions (word, postfix, labels, burden)."""
    n = len(offsets) - 1
    starts, ends, counts = W.words(data, offsets, INSIDE)
    first = np.cumsum(counts) - counts  # of each row, in words
    # one blank before each word, one line feed before each row
    size = ends - starts
    row = np.repeat(np.arange(n), counts)
    begin = np.cumsum(size + 1) - size + row + 1
    total = int(size.sum()) + len(size) + n
    text = np.full(total + 1, 32, np.uint8)
    text[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = PLAIN[data[INSIDE[data]]]
    text[np.concatenate([[0], np.cumsum(np.bincount(row, size + 1, n).astype(np.int64) + 1)])] = 10
    plain = text.tobytes().decode("latin-1")
    places: list[list[tuple]] = [[] for _ in range(n)]
    found: dict[int, list[tuple[int, int, str]]] = {}
    tags: dict[int, list[tuple[int, list[str]]]] = {}
    spans: dict[int, list[tuple[int, int]]] = {}  # words that tags and their expressions take
    raw = None
    hits = [(end - len(phrase) + 1, phrase) for end, phrase in automaton().iter(plain) if plain[end + 1] in " \n" and plain[end - len(phrase)] in " \n"]
    at = np.searchsorted(begin, [h for h, _ in hits])
    for w, (_, phrase) in zip(at.tolist(), hits, strict=True):
        r = int(row[w])
        own = w - int(first[r])
        if phrase in BASE:
            places[r].append((BASE[phrase], own, True))
        if phrase in NOTICES:
            found.setdefault(r, []).append((own, own + phrase.count(" ") + 1, NOTICES[phrase]))
        if phrase == TAG:
            raw = raw or data.tobytes()
            stop = raw.find(b"\n", int(ends[w + 2]), int(offsets[r + 1]))
            tokens, length = _read(raw[int(ends[w + 2]) : stop if stop >= 0 else int(offsets[r + 1])])
            tags.setdefault(r, []).append((own, tokens))
            spans.setdefault(r, []).append((own, int(np.searchsorted(starts, ends[w + 2] + length)) - int(first[r])))
    expressions: list[list[tuple]] = [[] for _ in range(n)]
    for r in {*found, *tags}:
        word = lambda i, a=int(first[r]): plain[begin[a + i] : begin[a + i] + size[a + i]]
        free = [f for f in found.get(r, []) if r not in spans or not _within(f[0], spans[r])]
        for own, tokens in sorted(_notices(free, word) + tags.get(r, [])):
            if ordered := postfix(tokens):
                labels, weight = evaluate(ordered)
                expressions[r].append((own, " ".join(ordered), labels, weight))
                places[r] += [(label, own, False) for label in labels]
    return counts, places, expressions


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``n_words``, ``places`` (label, word, base) and ``expressions`` (word, postfix, labels, burden) of ``text``."""
    bound_batches(docs.sparkSession)
    names = lambda kind: [f.name for f in kind.fields]
    as_rows = lambda rows, kind: [[dict(zip(names(kind), x, strict=True)) for x in row] for row in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("base", pa.bool_())]))
        expression = pa.list_(pa.struct([("word", pa.int64()), ("postfix", pa.string()), ("labels", pa.list_(pa.string())), ("burden", pa.int32())]))
        for batch in batches:
            n_words, places, expressions = [np.zeros(0, np.int64)], [], []
            for _, _, data, offsets in W.slices(batch.column(batch.num_columns - 1)):
                counts, p, e = scan_slice(data, offsets)
                n_words.append(counts)
                places += as_rows(p, PLACE)
                expressions += as_rows(e, EXPRESSION)
            yield pa.RecordBatch.from_pydict({k: batch.column(i) for i, k in enumerate(keep)} | {"n_words": pa.array(np.concatenate(n_words), pa.int64()), "places": pa.array(places, place), "expressions": pa.array(expressions, expression)})

    plain = docs.select(*keep, F.col("text").alias("_text"))
    schema = T.StructType([*plain.drop("_text").schema, T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(PLACE)), T.StructField("expressions", T.ArrayType(EXPRESSION))])
    return plain.mapInArrow(run, schema)


def digests(scanned: DataFrame) -> DataFrame:
    """Counts and labels of ``scan``'s result; ``score`` is the burden of all that holds for a text, over 100."""
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["word"])
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    burdens = F.transform("expressions", lambda e: e["burden"])
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"), (F.coalesce(F.array_max(burdens), F.lit(0)) / 100.0).alias("score"), F.size("expressions").cast("long").alias("n_expressions"),
    )
