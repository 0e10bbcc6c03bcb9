"""Removed words against a dictionary of all windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np

from tilewright.llm import substrings
from tilewright.llm import words as W


def brute(rows):
    split = [re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    out = []
    for r, w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(r.doc_id), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def check(docs):
    got = substrings.deduplicate(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(docs.collect())


def test_table(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_planted_passages_runs_and_borders(spark):
    rng, rows = random.Random(4), []
    words = [f"w{i}" for i in range(400)] + ["é", "W1"]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passages = [text(n) for n in (34, 35, 36, 70, 200)]
    for i in range(60):
        body = text(rng.randrange(120))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            at = rng.randrange(len(body) + 1)
            body[at:at] = p[rng.randrange(2) :]
        rows.append((i, " ".join(body)))
    rows += [(100, "a " * 34), (101, "a " * 36 + "b " * 34), (102, "b " * 35), (103, "x y " * 40), (104, " ".join(passages[4] * 2)), (105, None), (106, ""), (107, "\t \x0b"), (None, " ".join(passages[2])), (None, " ".join(text(50))), (108, "c " * 20000 + "d")]
    rows += [rows[3], rows[3], (3, "another text")]
    check(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as r", "text as cls"))
    assert substrings.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_near_copies_and_shared_parts(spark):
    """Copies with an edit each, parts of them inside other texts, and texts that repeat themselves."""
    rng, rows = random.Random(7), []
    base = [f"w{rng.randrange(500)}" for _ in range(600)]
    for i in range(80):
        copy = list(base)
        for _ in range(i % 4):
            copy[rng.randrange(600)] = f"e{i}"
        rows.append((i, " ".join(copy)))
    for i in range(80, 140):
        a = rng.randrange(560)
        rows.append((i, " ".join([f"u{i}{k}" for k in range(rng.randrange(30))] + base[a : a + rng.randrange(30, 90)] + [f"v{i}"] * rng.randrange(3))))
    rows += [(200, " ".join(f"t{k % 40}" for k in range(300))), (201, " ".join(base[:300] + base[100:180])), (202, "\n".join(base))]
    bits = [bin(k).count("1") % 2 for k in range(64)]
    rows += [(300, " ".join("ab"[b] for b in bits)), (301, " ".join("ba"[b] for b in bits)), (302, " ".join("".join("ab"[b ^ f] for b in [bin(k).count("1") % 2 for k in range(1024)]) for f in (0, 1) for _ in range(20)))]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_symbols_are_the_same_in_equal_passages():
    rng = random.Random(1)
    passage = " ".join(f"w{rng.randrange(50)}" for _ in range(200))
    rows = [f"p q {passage} r", f"{passage} s t", "z " * 5]
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    name, low, high, counts = substrings.symbols(data, np.concatenate([[0], np.cumsum([len(r) for r in rows])]))
    first = {(a - 2, b - 2): n for n, a, b in zip(name[: counts[0]], low[: counts[0]], high[: counts[0]], strict=True) if a >= 2 and b <= 202}
    second = {(a, b): n for n, a, b in zip(name[counts[0] :], low[counts[0] :], high[counts[0] :], strict=True) if b <= 200}
    assert len(first) > 20 and {k: v for k, v in first.items() if k in second} == {k: v for k, v in second.items() if k in first} and len(set(first) & set(second)) > 15
    assert W.words(data, np.array([0, len(data)]))[2].sum() > 0
