"""Distances and components of masks against pixels, with masks of one pixel, masks at the border and masks that cross batches."""

import random

import pytest
from pyspark.sql import functions as F

from skyledger.operators import canvas as cv
from skyledger.operators import masks as mk

W, H = 90, 70


def pixels(rows):
    return {(k, y, x) for k, y, a, b in rows for x in range(a, b)}


@pytest.fixture(scope="module")
def runs():
    rng = random.Random(1)
    rows = [(1, 0, 0, 1), (2, H - 1, W - 1, W), (3, 0, 0, W), (3, H - 1, 0, W)]
    for k in range(4, 40):
        rows += [(k, rng.randrange(H), a, min(W, a + rng.randint(1, 9))) for a in (rng.randrange(W) for _ in range(rng.randint(1, 60)))]
    return rows


@pytest.fixture(scope="module")
def merged(spark, runs):
    return mk.merge_runs(spark.createDataFrame(runs, "k long, y int, x0 int, x1 int"), ["k"]).cache()


@pytest.mark.parametrize("radius", [0, 1, 5, 48])
def test_dilate(merged, runs, radius, monkeypatch):
    want = set()
    for k, y, x in pixels(runs):
        for dy in range(-radius, radius + 1):
            half = int((radius * radius - dy * dy) ** 0.5)
            if 0 <= y + dy < H:
                want |= {(k, y + dy, v) for v in range(max(0, x - half), min(W, x + half + 1))}
    # A struct among the keys, as components are.
    keyed = merged.withColumn("part", F.struct("k", F.lit(0).alias("y")))
    got = cv.dilate(keyed, ["k", "part"], radius, W, H).collect()
    assert pixels([(r.k, r.y, r.x0, r.x1) for r in got]) == want and all(r.part.k == r.k for r in got)
    # Runs come out merged: no two of a row touch.
    ends = {(r.k, r.y, r.x1) for r in got}
    assert not [r for r in got if (r.k, r.y, r.x0) in ends]


@pytest.mark.parametrize("minimum", [0, 6])
def test_components_agree_with_the_distributed_ones(merged, minimum):
    shape = lambda df: sorted((r.k, r.y, r.x0, r.x1, tuple(r.component)) for r in df.collect())
    want = mk.label_components(merged, ["k"]) if not minimum else mk.retain_components(merged, ["k"], minimum)
    assert shape(cv.label(merged, ["k"], minimum)) == shape(want)


def test_masks_that_cross_batches_stay_whole(spark):
    """One mask of 3,000 runs, a comb whose teeth meet in the last row, in Arrow batches of 100 rows."""
    rows = [(1, y, x, x + 1) for y in range(30) for x in range(0, 200, 2)] + [(1, 30, 0, 200)] + [(2, 0, 0, 1), (2, 2, 0, 1)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = cv.label(spark.createDataFrame(rows, "k long, y long, x0 long, x1 long"), ["k"]).groupBy("k").agg(F.countDistinct("component").alias("n"), F.count(F.lit(1)).alias("runs"))
        assert {(r.k, r.n, r.runs) for r in got.collect()} == {(1, 1, 3001), (2, 2, 2)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_no_masks(spark):
    none = spark.createDataFrame([], "k long, y long, x0 long, x1 long")
    assert cv.dilate(none, ["k"], 3, W, H).collect() == [] and cv.label(none, ["k"], 2).collect() == []


def test_small_masks_share_a_canvas(runs, monkeypatch):
    """Masks reach no further when they lie on one canvas, and many small ones are one call (one a mask before)."""
    calls, plain = [], cv._reach
    monkeypatch.setattr(cv, "_reach", lambda *a: calls.append(a) or plain(*a))
    monkeypatch.setattr(cv, "per_mask", lambda merged, keys, work, added="": work)
    rng = random.Random(4)
    rows = [(k, y, x, x + rng.randint(1, 6)) for k in range(400) for y, x in [(rng.randint(-3, H + 2), rng.randint(-3, W + 2))]]
    first = cv.np.arange(len(rows) + 1)
    y, x0, x1 = (cv.np.array(c) for c in list(zip(*rows))[1:])
    got = set()
    for k, ys, a, b in cv.dilate(None, [], 3, W, H)(first, y, x0, x1):
        got |= pixels(zip(k.tolist(), ys.tolist(), a.tolist(), b.tolist()))
    disc = [(dy, dx) for dy in range(-3, 4) for dx in range(-3, 4) if dy * dy + dx * dx <= 9]
    real = {(k, v, x) for k, v, x in pixels(rows) if 0 <= v < H and 0 <= x < W}
    assert got == {(k, v + dy, x + dx) for k, v, x in real for dy, dx in disc if 0 <= v + dy < H and 0 <= x + dx < W}
    assert len(calls) < 10


@pytest.mark.parametrize("keep", ["n_a > 0 AND n_b > 0", "n_a > 0 AND n_b = 0", "n_a + n_b > 1"])
def test_merged_runs_are_shuffled_once(spark, keep):
    """coverage of merged runs: the same pixels as the general form, the rows brought together in one shuffle (two before)."""
    rng = random.Random(6)
    rows = [(k, y, layer, x, x + rng.randint(1, 7)) for k in (None, 1, 2) for y in range(6) for layer in "ab" for x in range(rng.randint(0, 5), 60, 11)]
    stack = spark.createDataFrame(rows, "k long, y int, layer string, x0 int, x1 int")
    either = [mk.combine(stack, ["k"], "layer", ["a", "b"], F.expr(keep), merged=m) for m in (True, False)]
    one, two = (sorted((r.k or 0, r.y, r.x0, r.x1) for r in df.collect()) for df in either)
    assert one == two and one
    shuffles = lambda df: df.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert (shuffles(either[0]), shuffles(either[1])) == (1, 2)
