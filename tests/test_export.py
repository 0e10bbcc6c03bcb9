"""Plane choices, dataset records, and random search."""

import pytest

from tilewright.operators import trials
from tilewright.plans.export import PlaneChoice, choose_planes, dataset_records
from tilewright.sources import readers


def test_choices(spark):
    scores = spark.createDataFrame([("s", 0, z, float(v)) for z, v in enumerate((1, 4, 4, 2))], "stem string, tile int, z int, log double")
    pick = lambda c: sorted(r.z for r in choose_planes(scores, c, ["stem", "tile"]).collect())
    assert pick(PlaneChoice("best_plane")) == [2] and pick(PlaneChoice("top_k_planes", top_k=9)) == [0, 1, 2, 3]
    assert pick(PlaneChoice.parse("planes", "0, 3,7")) == [0, 3] and pick(PlaneChoice("all_planes")) == [0, 1, 2, 3]
    for bad in (lambda: PlaneChoice("x"), lambda: PlaneChoice.parse("plane")):
        with pytest.raises(ValueError):
            bad()
    boxes = spark.createDataFrame([("s", 0, 0, 3, 1.0, 1.0, 4.0, 4.0, 4.0, 4.0), ("s", 0, 1, 1, 1.0, 1.0, 3.0, 5.0, 3.0, 5.0)], "stem string, tile int, ann_idx int, label int, x double, y double, w double, h double, full_w double, full_h double")
    splits = spark.createDataFrame([("s", "train")], "stem string, split string")
    images, kept = dataset_records(scores, boxes, splits, PlaneChoice("best_plane"))
    assert [(r.split, r.file_name) for r in images.collect()] == [("train", "s_tile_0_z02.jpg")]
    assert [(r.file_name, r.ann_idx, r.category_id) for r in kept.collect()] == [("s_tile_0_z02.jpg", 0, 2)]


def test_random_search(spark):
    space = trials.search_space('{"lr": ["log_float", 1e-4, 1e-1], "n": ["int", 2, 4], "opt": ["categorical", ["a", "b"]], "d": ["float", 0, 1]}')
    table = trials.sample_trials(spark, space, 20, 3)
    for r in table.collect():
        assert 1e-4 <= float(r.params["lr"]) <= 1e-1 and int(r.params["n"]) in (2, 3, 4) and r.params["opt"] in "ab" and 0 <= float(r.params["d"]) < 1
    assert table.collect() == trials.sample_trials(spark, space, 20, 3).collect()
    done = trials.run_trials(table.where("trial < 5"), lambda p: 1 / 0 if p["n"] == "2" else float(p["d"]))
    rows = done.collect()
    assert len(rows) == 5 and all(r.score == (0.0 if r.params["n"] == "2" else float(r.params["d"])) for r in rows)
    assert trials.sample_trials(spark, space, 20, 3, done).count() == 15
    assert readers.best_trial(done).first().score == max(r.score for r in rows)
    with pytest.raises(ValueError):
        trials.search_space('{"x": ["normal", 0, 1]}')
