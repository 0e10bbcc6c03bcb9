"""Licence places against plain Python, expressions against cases by hand."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tilewright.llm import licenses as L
from tilewright.llm import words as W


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    """(label, word) of each base place, by looking at every word."""
    w = words(text)
    return sorted((label, i) for phrase, label in L.BASE.items() for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p)


AWKWARD = [None, "", " ", "...", "cc by", "CC-BY", "cc by cc by", "acc by", "cc bye", "cc\nby", "ccé by", "CC BY-NC 4.0", "all rights reserved" * 2, "All rights\x00reserved", "general public license general public license", "é cc by é", "cc", "by cc", "cc " * 500 + "by", "x" * 300_000 + " cc by"]


def rows(n=400):
    rng = random.Random(3)
    pool = ["cc", "by", "nc", "general", "public", "license", "all", "rights", "reserved", "or", "and", "the", "MIT", "4", "0", "x", "é"]
    return AWKWARD + ["".join(rng.choice(pool) + rng.choice([" ", "-", "\n", ". ", ""]) for _ in range(rng.randrange(30))) for _ in range(n)]


def scanned(texts):
    out = []
    for _, _, data, offsets in W.slices(pa.array(texts, pa.string())):
        out += zip(*L.scan_slice(data, offsets), strict=True)
    return out


def test_base_places():
    for text, (n, places, _) in zip(rows(), scanned(rows()), strict=True):
        assert n == len(words(text))
        assert sorted((label, w) for label, w, own in places if own) == base(text), text


@pytest.mark.parametrize(
    ("expression", "ordered", "labels", "burden"),
    [
        ("MIT", "mit", "mit", 20),
        ("MIT OR GPL-3.0-only", "mit gpl-3.0 or", "gpl-3.0,mit", 20),
        ("MIT AND GPL-3.0-or-later", "mit gpl-3.0 and", "gpl-3.0,mit", 75),
        ("GPL-2.0+ WITH Classpath-exception-2.0", "gpl-2.0 classpath-exception-2.0 with", "classpath-exception-2.0,gpl-2.0", 50),
        ("MIT OR Apache-2.0 AND AGPL-3.0", "mit apache-2.0 agpl-3.0 and or", "agpl-3.0,apache-2.0,mit", 20),
        ("(MIT OR Apache-2.0) AND AGPL-3.0", "mit apache-2.0 or agpl-3.0 and", "agpl-3.0,apache-2.0,mit", 85),
        ("((MIT) or (BSD-3-Clause and (ISC)))", "mit bsd-3-clause isc and or", "bsd-3-clause,isc,mit", 20),
        ("MIT OR", "mit", "mit", 20),
        ("MIT AND (", "mit", "mit", 20),
        ("(MIT AND (GPL-3.0", "mit gpl-3.0 and", "gpl-3.0,mit", 75),
        ("MIT ) OR GPL-3.0", "mit", "mit", 20),
        ("OR MIT", "", "", 0),
        ("", "", "", 0),
        ("MIT MIT", "mit", "mit", 20),
        ("Something-Else", "something-else", "something-else", L.UNKNOWN),
        ("CC-BY-NC-4.0 OR CC-BY-SA-4.0", "cc-by-nc-4.0 cc-by-sa-4.0 or", "cc-by-nc-4.0,cc-by-sa-4.0", 50),
        ("CC0-1.0 WITH x", "cc0-1.0 x with", "cc0-1.0,x", 5),
    ],
)
def test_expressions(expression, ordered, labels, burden):
    got = L.postfix(re.findall(r"[()]|[A-Za-z0-9.+-]+", expression))
    assert " ".join(got) == ordered
    names, weight = L.evaluate(got)
    assert (",".join(names), weight) == (labels, burden)


def plain_value(tokens):
    """Value by recursive descent."""

    def level(k):
        left = level(k + 1) if k < 3 else atom()
        while tokens and tokens[0] == {1: "or", 2: "and", 3: "with"}[k]:
            tokens.pop(0)
            right = level(k + 1) if k < 3 else atom()
            left = {1: min(left, right), 2: max(left, right), 3: max(L.LEAST, left - L.EXCEPTION)}[k]
        return left

    def atom():
        token = tokens.pop(0)
        if token == "(":
            inner = level(1)
            tokens.pop(0)
            return inner
        return L.burden(token)

    return level(1)


def test_random_expressions():
    rng = random.Random(9)

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            return [rng.choice(["mit", "gpl-3.0", "agpl-3.0", "mpl-2.0", "other", "cc0"])]
        inner = make(depth - 1) + [rng.choice(["or", "and", "with"])] + make(depth - 1)
        return ["(", *inner, ")"] if rng.random() < 0.5 else inner

    for _ in range(500):
        tokens = make(4)
        assert L.evaluate(L.postfix(tokens))[1] == plain_value(list(tokens)), tokens


def test_tags_and_notices():
    texts = [
        "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\n# all rights reserved",
        "Licensed under the MIT License or the Apache License, Version 2.0.",
        "Licensed under the MIT License. It works and the Apache License, Version 2.0 does too.",
        "GNU General Public License, version 3, with classpath exception",
        "spdx license identifier",
        "SPDX-License-Identifier: MIT */ or GPL-3.0",
        "This is the permit license of mitigation",
    ]
    got = [[(e[1], e[3]) for e in row[2]] for row in scanned(texts)]
    assert got == [
        [("mit apache-2.0 or gpl-2.0 classpath-exception-2.0 with and", 50), ("reserved", 100)],
        [("mit apache-2.0 or", 20)],
        [("mit", 20), ("apache-2.0", 20)],
        [("gpl-3.0 classpath-exception with", 50)],
        [],
        [("mit", 20)],
        [],
    ]
    assert "public-domain" in {p[0] for p in scanned(["In the Public Domain"])[0][1]}


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([*enumerate(AWKWARD), (None, "cc by")], "doc_id long, text string"))
    for row in L.digests(L.scan(docs, ("doc_id", "text")).withColumn("doc_id", F_struct())).collect():
        found = base(row.doc_id.text)
        assert (row.n_words, row.n_base) == (len(words(row.doc_id.text)), len(found))
        assert (row.first_word, row.last_word) == ((min(w for _, w in found), max(w for _, w in found)) if found else (None, None))
        assert row.base_labels == ",".join(sorted({label for label, _ in found}))
        assert {*row.base_labels.split(",")} <= {*row.labels.split(","), ""} and 0 <= row.score <= 1
    assert L.scan(docs.limit(0)).count() == 0


def F_struct():
    from pyspark.sql import functions as F

    return F.struct("doc_id", "text")


def test_extra_columns_and_repeats(spark):
    docs = spark.createDataFrame([(1, "cc by", "w", 2.0), (1, "cc by", "w", 2.0)], "doc_id long, text string, places string, n_words double")
    got = L.digests(L.scan(docs)).collect()
    assert len(got) == 2 and got[0] == got[1] and (got[0].n_words, got[0].n_base, got[0].labels) == (2, 1, "cc-by")


def test_slices_do_not_matter(monkeypatch):
    whole = scanned(rows(50))
    monkeypatch.setattr(W, "slices", lambda column, size=20, f=W.slices: f(column, 20))
    assert [(int(a), b, c) for a, b, c in scanned(rows(50))] == [(int(a), b, c) for a, b, c in whole] and np.sum([a for a, _, _ in whole]) > 0
