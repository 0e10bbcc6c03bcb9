"""Divergences and leading terms against plain Python over whole tables."""

import random
import re
from collections import Counter
from fractions import Fraction
from math import floor

import numpy as np
import pytest

from tilewright.llm import divergence as D
from tilewright.llm import words as W


def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, least, top=50):
    """docs: (lang, source, text)."""
    docs = [(a or "", b or "", terms(c)) for a, b, c in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for _, _, w in own for t in set(w))
        kept = sorted(t for t, n in held.items() if n >= least)
        counts = {s: Counter() for s in {d[1] for d in own}}
        for _, s, w in own:
            counts[s].update(w)

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + floor(Fraction(10**9 * (c[t] + 5), n + 5 * len(kept))) for t in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s]
            led = [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, rows, most in (("pair", pairs, None), ("term", led, top)):
                rows.sort(key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(rows[:most])]
    return sorted(out)


def check(spark, rows, least=30, top=50):
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    got = D.audit(docs, least, top).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == brute(rows, least, top)
    return got


def rows(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Béta", "中文", "e", "é", "ee", "\xa0x", "z"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    return [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s10", "", None, "é"]), " ".join(rng.choices(vocabulary, range(len(vocabulary), 0, -1), k=rng.randrange(25))) + rng.choice(["", "-x1y", "\x00Q"])) for _ in range(n)]


def test_groups(spark):
    assert len(check(spark, rows(300) + [("fr", "only", "seldom"), ("fr", "two", None), ("en", "bare", "123 ..."), ("it", "lone", "x")], 20, 7)) > 100


def test_blocks_make_no_difference(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 1)
    monkeypatch.setattr(D, "HELD", 20)
    check(spark, rows(200, 2), 5, 3)


def test_edges(spark):
    assert D.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0
    check(spark, [(None, None, None)])
    check(spark, [("a", "x", "same Same SAME")] * 40 + [("a", "y", "other")] * 29)
    check(spark, [("a", "x", "word " * 200_000), ("a", "y", "word"), ("a", "z", "tie eit"), ("a", "y", "tie eit")], 1)
    extra = spark.createDataFrame([("a", "x", "b", 1, "t"), ("a", "y", "b", 2, "t")], "lang string, source string, text string, n int, term string")
    assert D.audit(extra, 1).count() == 2


def test_shares_are_exact():
    for whole in (1, 7, 10**9 + 7, 9 * 10**14):
        for n in (0, 1, whole // 3, max(0, whole - 6)):
            assert D.shares(np.array([n]), whole)[0] == 1 + 10**9 * (n + 5) // whole


def test_equal_hashes_do_not_make_equal_terms(monkeypatch):
    monkeypatch.setattr(D.xxhash, "xxh3_64_intdigest", len)
    text = b"ab cd ab xyz cd xyy"
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = W.words(data, np.array([0, len(text)]), D.TERM)
    first, which = D.group_slices(data, starts, ends)
    assert [text[starts[first[k]] : ends[first[k]]] for k in which] == text.split()


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_slices(size):
    texts = [r[2] for r in rows(60)] + ["", "A b a"]
    import pyarrow as pa

    got: Counter = Counter()
    for i, j, data, offsets in W.slices(pa.array(texts), size):
        for g, t, n, d in D.count_slice(data, offsets, np.arange(i, j) % 3):
            got[g, t.decode(), "n"] += n
            got[g, t.decode(), "d"] += d
    want: Counter = Counter()
    for k, text in enumerate(texts):
        for t, n in Counter(terms(text)).items():
            want[k % 3, t, "n"] += n
            want[k % 3, t, "d"] += 1
    assert got == want


def test_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text").collect()
    check(spark, [tuple(r) for r in table])
