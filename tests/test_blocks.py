"""Scores, stacks and projections by blocks against the same kernels over whole planes."""

import numpy as np
import pytest

from tilewright.operators import blocks as B
from tilewright.operators import focus
from tilewright.operators import regions as R


def planes(seed, size, channels=1, zs=(-5, 0, 3), ties=False):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 256, (*size, channels), np.uint8)
    return {z: base if ties else rng.integers(0, 256, (*size, channels), np.uint8) for z in zs}


def frame(spark, stacks):
    rows = [(slide, 20.0, z, *i.shape, i.tobytes()) for slide, stack in stacks.items() for z, i in stack.items()]
    return spark.createDataFrame(rows, "slide string, magnification double, z_nm bigint, height int, width int, channels int, data binary")


STACKS = {"a": planes(1, (37, 50)), "b": planes(2, (16, 33), 3), "c": planes(3, (4, 5)), "d": planes(4, (20, 20), ties=True), "e": planes(5, (1, 9)), "f": {7: np.zeros((33, 17, 1), np.uint8)}}


@pytest.mark.parametrize("cell", [4, 12, 16, 64])
def test_blocks_equal_whole_planes(spark, cell):
    made = B.block_products(R.cut_planes(frame(spark, STACKS), cell))
    scores = {(r.slide, r.z_nm): r for r in B.block_scores(made).collect()}
    assert len(scores) == sum(map(len, STACKS.values()))
    for slide, stack in STACKS.items():
        for z, image in stack.items():
            want = focus.numpy_scores(focus.to_gray(image))
            assert all(scores[slide, z][m] == pytest.approx(want[m], abs=1e-6) for m in focus.METRICS), (slide, z)
    for kind in ("stacked", "mip"):
        rows = B.block_images(made, kind).collect()
        for slide, stack in STACKS.items():
            whole = np.zeros(next(iter(stack.values())).shape, np.uint8)
            for r in rows:
                if r.slide == slide:
                    whole[r.cy * cell : r.cy * cell + r.height, r.cx * cell : r.cx * cell + r.width] = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
            images = [stack[z] for z in sorted(stack)]
            if kind == "mip":
                want = np.maximum.reduce(images)
            else:
                response = np.stack([np.abs(focus.numpy_log(focus.to_gray(i))) for i in images])
                want = np.take_along_axis(np.stack(images), response.argmax(0)[None, :, :, None], 0)[0]
            assert (whole == want).all(), (slide, kind)


def test_results_go_into_a_store(spark, tmp_path):
    made = B.block_products(R.cut_planes(frame(spark, {"a": STACKS["a"]}), 16))
    R.write_store(B.block_images(made, "mip"), str(tmp_path))
    one = spark.createDataFrame([(1, "a", 20.0, 10, 10, 20, 20)], "id long, slide string, magnification double, x int, y int, w int, h int")
    got = R.read_regions(spark, str(tmp_path), one).first()
    want = np.maximum.reduce(list(STACKS["a"].values()))[10:30, 10:30]
    assert (np.frombuffer(got.data, np.uint8).reshape(20, 20, 3) == want).all()


def test_percentiles_of_counts(spark):
    rng = np.random.default_rng(3)
    values = {g: rng.integers(0, 9, n) for g, n in (("one", 1), ("two", 2), ("many", 1000), ("odd", 77))}
    rows = [(g, int(v), int(c)) for g, own in values.items() for v, c in zip(*np.unique(own, return_counts=True), strict=True)]
    for part in (0.0, 0.25, 0.75, 0.999, 1.0):
        got = {r.g: r.percentile for r in B.counted_percentile(spark.createDataFrame(rows, "g string, value long, n long"), ["g"], part).collect()}
        assert all(got[g] == pytest.approx(np.percentile(own, 100 * part)) for g, own in values.items())


def test_a_group_holds_one_place(spark):
    """No group grows with the plane: a block and its halo, for each z."""
    pieces = B.with_halos(R.cut_planes(frame(spark, {"a": STACKS["a"]}), 16))
    sizes = [sum(len(r.data) for r in rows) for rows in ([p for p in pieces.collect() if (p.cy, p.cx) == at] for at in {(p.cy, p.cx) for p in pieces.collect()})]
    assert max(sizes) <= 3 * (16 + 2 * B.HALO) ** 2


def test_expressions_equal_numpy(spark):
    """The column form of each kernel, for use within larger expressions."""
    image = STACKS["c"][0][:, :, 0].astype(np.int64)
    df = spark.createDataFrame([([int(v) for v in image.ravel()],)], "px array<int>")
    want = focus.numpy_scores(image)
    forms = {"vol": focus.variance_of_laplacian("px", 5, 4), "tenengrad": focus.tenengrad("px", 5, 4), "pvol": focus.laplacian_percentile("px", 5, 4), "ptenengrad": focus.gradient_percentile("px", 5, 4)}
    row = df.select(*[c.alias(n) for n, c in forms.items()]).first()
    assert all(row[n] == pytest.approx(want[n]) for n in forms)
    with pytest.raises(ValueError, match="aperture"):
        focus.sobel(4)
