import random

import pytest
from pyspark.sql import functions as F

from skyledger.operators import agreement as ag
from skyledger.operators.components import components
from skyledger.operators.overlap import overlap_pairs
from skyledger.operators.resolve import match_one_to_one, merge_groups, suppress

BOX = "image int, id int, prompt string, x1 double, y1 double, x2 double, y2 double, confidence double"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0, w) * max(0, h)
    return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)


def some_boxes(n, seed, images=2, span=60):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        x, y, w, h = rnd.randint(0, span), rnd.randint(0, span), rnd.choice([5, 9, 20, 80]), rnd.choice([5, 9, 20, 80])
        rows.append((i % images, i, rnd.choice("abc"), float(x), float(y), float(x + w), float(y + h), rnd.choice([0.2, 0.5, 0.5, 0.9])))
    return rows


@pytest.mark.parametrize("limit", [0.05, 0.3, 0.65, 1.0])
def test_pairs_of_very_different_sizes_match_brute_force(spark, limit):
    rows = some_boxes(120, 3)
    want = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and a[0] == b[0] and iou(a[3:7], b[3:7]) >= limit}
    df = spark.createDataFrame(rows, BOX)
    got = overlap_pairs(df, None, group=["image"], id_col="id", min_iou=limit).collect()
    assert len(got) == len(want) and {(r.a_id, r.b_id) for r in got} == want
    left, right = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    cross = overlap_pairs(left, right, group=["image"], id_col="id", min_iou=limit).collect()
    pairs = {tuple(sorted((r.a_id, r.b_id))) for r in cross}
    assert len(cross) == len(pairs) and pairs == {p for p in want if p[0] % 2 != p[1] % 2}


def test_groups_by_threshold_do_not_depend_on_order(spark):
    rows = [(1, 1, "a", 0.0, 0.0, 10.0, 10.0, 1.0), (1, 2, "b", 1.0, 0.0, 11.0, 10.0, 1.0), (1, 3, "b", 50.0, 50.0, 60.0, 60.0, 1.0), (1, 4, "b", 53.0, 50.0, 63.0, 60.0, 1.0)]
    for order in (rows, rows[::-1]):
        p = ag.overlap_profile(spark.createDataFrame(order, BOX), image="image", id_col="id", prompt="prompt", thresholds=(0.5, 0.8))
        got = {r.threshold: r.asDict() for r in p.collect()}
        assert got[0.5]["groups"] == 2 and got[0.5]["cross_prompt_groups"] == 1
        assert got[0.8]["groups"] == 3


def test_many_copies_of_one_box_are_counted_without_pairing_them(spark):
    n = 3000
    df = spark.range(n).select(
        F.lit(1).alias("image"), F.col("id").cast("int").alias("id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("prompt"),
        *[F.lit(v).cast("double").alias(c) for c, v in (("x1", 0), ("y1", 0), ("x2", 10), ("y2", 10))], F.lit(0.5).alias("confidence"),
    )
    r = ag.overlap_profile(df, image="image", id_col="id", prompt="prompt", thresholds=(0.5,)).first()
    assert r.groups == 1 and r.pair_matches == n * (n - 1) // 2 and r.cross_prompt_pairs == 1000 * 2000
    kept = suppress(df, group=["image"], id_col="id", confidence="confidence", max_iou=0.5).collect()
    assert [k.id for k in kept] == [0]


def greedy_groups(rows, limit):
    groups, out = [], {}
    for r in rows:
        for g in groups:
            if iou(r[3:7], g["rep"][3:7]) >= limit:
                if r[7] > g["rep"][7]:
                    g["rep"] = r
                break
        else:
            g = {"rep": r, "founder": r[1]}
            groups.append(g)
        out[r[1]] = g["founder"]
    return out


@pytest.mark.parametrize("local_limit", [0, 20_000])
def test_ordered_merge_equals_the_sequential_walk(spark, local_limit):
    rows = some_boxes(90, 8, images=1, span=30)
    df = spark.createDataFrame(rows, BOX)
    got = merge_groups(df, group=["image"], id_col="id", order="id", confidence="confidence", min_iou=0.4, local_limit=local_limit)
    assert {r.id: r.founder for r in got.collect()} == greedy_groups(rows, 0.4)


def test_merge_depends_on_order(spark):
    first, bridge, last = (0.0, 0.0, 10.0, 10.0), (2.0, 0.0, 12.0, 10.0), (4.0, 0.0, 14.0, 10.0)
    make = lambda boxes: spark.createDataFrame([(1, i, "a", *b, 0.5) for i, b in enumerate(boxes)], BOX)
    count = lambda boxes: merge_groups(make(boxes), group=["image"], id_col="id", order="id", confidence="confidence", min_iou=0.65).select("founder").distinct().count()
    assert count([first, bridge, last]) == 2
    assert count([bridge, first, last]) == 1


def test_suppression_equals_greedy(spark):
    rows = some_boxes(100, 5, images=3, span=25)
    want = set()
    for image in range(3):
        kept = []
        for r in sorted((r for r in rows if r[0] == image), key=lambda r: (-r[7], r[3:7], r[1])):
            if all(iou(r[3:7], k[3:7]) <= 0.3 for k in kept):
                kept.append(r)
        want |= {k[1] for k in kept}
    got = suppress(spark.createDataFrame(rows, BOX), group=["image"], id_col="id", confidence="confidence", max_iou=0.3)
    assert {r.id for r in got.collect()} == want


@pytest.mark.parametrize("ties", ["largest", "smallest"])
def test_matching_equals_greedy_with_ties(spark, ties):
    rnd = random.Random(1)
    pairs = [(a, b, rnd.choice([0.3, 0.5, 0.5, 0.8])) for a in range(12) for b in range(12) if rnd.random() < 0.5]
    key = (lambda p: (-p[2], -p[0], -p[1])) if ties == "largest" else (lambda p: (-p[2], p[0], p[1]))
    used_a, used_b, want = set(), set(), set()
    for a, b, s in sorted(pairs, key=key):
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b), want.add((a, b))
    got = match_one_to_one(spark.createDataFrame(pairs, "a_id int, b_id int, iou double"), ties=ties)
    assert {(r.a_id, r.b_id) for r in got.collect()} == want


@pytest.mark.parametrize("near", [[], ["k"]])
def test_components_of_a_long_chain_and_a_hub(spark, near):
    chain = [(i, i + 1, 0) for i in range(0, 400)]
    hub = [(1000, 1000 + i, i % 7) for i in range(1, 300)]
    e = spark.createDataFrame(chain + hub, "a int, b int, k int").repartition(6)
    got = {r.node: r.component for r in components(e, "a", "b", near=near).collect()}
    assert len(got) == 401 + 300
    assert {got[i] for i in range(401)} == {0} and {got[1000 + i] for i in range(300)} == {1000}


def test_line_evidence(spark):
    rows = [(1, 1, 0.0, 0.0, 10.0, 10.0, True), (1, 2, 15.0, 0.0, 25.0, 10.0, False), (1, 3, 90.0, 90.0, 99.0, 99.0, None), (2, 4, 0.0, 0.0, 9.0, 9.0, False)]
    df = spark.createDataFrame(rows, "image int, id int, x1 double, y1 double, x2 double, y2 double, lines boolean")
    out = ag.line_evidence(df, image="image", id_col="id", has_lines="lines", cell=16.0)
    assert {r.id: r.evidence for r in out.collect()} == {1: "direct_has_lines", 2: "adjacent_to_lines", 3: "no_line_evidence", 4: "no_line_evidence"}
