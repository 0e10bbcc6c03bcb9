"""Components against all pairs of sets."""

import random
import re

from pyspark.sql import functions as F

from tilewright.llm import neardup


def shingles(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(r.text) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n and 100 * n >= 75 * (len(a) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(root(i), []).append(rows[i].doc_id)
    return sorted((rows[i].doc_id, len(sets[i]), min(out[root(i)])) for i in range(len(rows)))


def check(docs):
    got = neardup.components(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(docs.collect())
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_table(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_near_copies_at_the_threshold(spark):
    rng, rows = random.Random(8), []
    vocabulary = [f"w{i}" for i in range(300)]
    for base in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 12, 40, 60, 90, 400]))]
        for _ in range(25):
            copy = list(words)
            for _ in range(rng.randrange(1 + len(words) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy), base))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows += [(1000 + i, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(8, 90))), 0) for i in range(150)]
    check(spark.createDataFrame(rows, "doc_id long, text string, c int"))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \x0b "), (4, "a"), (5, "A"), (6, "a b"), (7, "a\xa0b"), (9, "a b c d e"), (8, "a b c d e"), (8, "other words that are here now"), (10, "x " * 5000)], "doc_id long, text string")
    check(docs)
    assert neardup.components(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "p q r s t u"), (3, "p q r s t u"), (None, "lone text")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in neardup.components(nulls).collect()) == [("3", "3"), ("None", "3"), ("None", "None")]


def test_lists_of_equal_members_with_values_of_different_df(spark):
    """Classes 0 and 1 are alike only to each other; 2 to 31 list the same values. Quotes (from 32 on, with too much of
    their own to be listed) make the passage's values differ in df, so that rarer ones have larger hashes."""
    own = lambda c, n: [10_000 * (c + 1) + i for i in range(n)]
    passage = list(range(80))
    held = [(c, passage + own(c, 12)) for c in range(2)] + [(c, passage + own(99, 20)) for c in range(2, 32)]
    held += [(32 + i, passage[: 80 - i % 24] + own(32 + i, 70)) for i in range(60)]
    held += [(100 + i, own(99, 20) + own(100 + i, 40)) for i in range(80)]
    lists = neardup._listed(spark.createDataFrame(held, "c long, held array<long>"), F.lit(0.75)).withColumn("label", F.col("c"))
    kept = lists.where("c = 0").select("v").collect()
    assert [r.v for r in kept] == [79]  # the rarest value of all lists with these members
    assert neardup._cross(lists).where("a = 0 and b = 1").count() == 1
    assert neardup._cross(neardup._distinct_lists(lists)).where("a = 0 and b = 1").count() == 1


def test_balanced_words_are_not_alike(spark):
    rows = []
    for n in (1024, 4096):
        for flip in (0, 1):
            rows.append((len(rows), "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))))
    check(spark.createDataFrame([*rows, (9, rows[0][1])], "doc_id long, text string"))
