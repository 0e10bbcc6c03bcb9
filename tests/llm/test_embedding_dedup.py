"""Links and components against all pairs."""

import numpy as np
import pytest

from tilewright.llm import embedding_dedup as E


def brute(rows):
    good = [i for i, r in enumerate(rows) if r.label is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    links, parent = {i: 0 for i in range(len(rows))}, list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    unit = {i: np.array(rows[i].embedding, float) / np.linalg.norm(np.array(rows[i].embedding, float)) for i in good}
    for n, i in enumerate(good):
        for j in good[:n]:
            if rows[i].label == rows[j].label and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r.vec_id), r.vec_id)
    return sorted((r.vec_id, links[i], least[root(i)]) for i, r in enumerate(rows))


def check(df):
    got = E.components(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(df.collect())
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_table(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def test_clusters_copies_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 40)
    rng, rows = np.random.default_rng(3), []
    for k in range(12):
        centre = rng.normal(size=16)
        for _ in range(25):
            v = centre + rng.normal(size=16) * rng.choice([0, 0.03, 0.1, 0.2])
            rows.append((len(rows), [float(x) for x in v], k % 3))
    rows += [(len(rows) + i, [float(x) for x in rng.normal(size=16)], 0) for i in range(60)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 16, 0), (n + 3, [float("nan")] + [1.0] * 15, 0), (n + 4, [None] + [1.0] * 15, 0), (n + 5, rows[0][1], None), (n + 6, rows[0][1][:8], 0), (n + 7, [2 * x for x in rows[0][1]], 0), (n + 8, [float("inf")] * 16, 0), (n + 8, rows[0][1], 0), (n + 8, rows[30][1], 1)]
    check(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as c", "label as cell"))


def test_empty(spark):
    assert E.components(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("spread", [0.0, 0.02, 0.5])
def test_traversal_is_exact(spread):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(6, 8)).repeat(40, 0) + spread * rng.normal(size=(240, 8))
    points /= np.linalg.norm(points, axis=1)[:, None]
    a, b = np.arange(0, 240, 2), np.arange(1, 240, 2)
    links, _ = E.group_links(points, np.ones(240, np.int64), a, b, 0.98)
    near = points @ points.T >= 0.98
    assert links[a].tolist() == near[np.ix_(a, b)].sum(1).tolist() and links[b].tolist() == near[np.ix_(b, a)].sum(1).tolist()
    own, _ = E.group_links(points, np.ones(240, np.int64), np.arange(240), None, 0.98)
    assert own.tolist() == (near.sum(1) - 1).tolist()


def test_pairs_close_to_the_threshold_and_to_one_another():
    """Points within about 1e-9 of a few centres, whose cosines with one another's lie within about 2e-9 of 0.98."""
    rng = np.random.default_rng(8)
    for _ in range(40):
        a = rng.normal(size=8)
        a /= np.linalg.norm(a)
        side = rng.normal(size=8)
        side -= side @ a * a
        side /= np.linalg.norm(side)
        b = 0.98 * a + np.sqrt(1 - 0.98**2) * side
        points = np.concatenate([c + rng.normal(size=(30, 8)) * rng.choice([1e-10, 1e-9, 3e-9]) for c in (a, b)])
        points /= np.linalg.norm(points, axis=1)[:, None]
        x, y = np.arange(30), np.arange(30, 60)
        near = points @ points.T >= 0.98
        links, _ = E.group_links(points, np.ones(60, np.int64), x, y, 0.98)
        assert links[x].tolist() == near[np.ix_(x, y)].sum(1).tolist() and links[y].tolist() == near[np.ix_(y, x)].sum(1).tolist()
        own, _ = E.group_links(points, np.ones(60, np.int64), np.arange(60), None, 0.98)
        assert own.tolist() == (near.sum(1) - 1).tolist()
