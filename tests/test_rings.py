"""Predicates on rings against plain loops over all edges, with rings of many corners, repeated edges, holes, and points on edges and corners."""

import math
import random

from pyspark.sql import functions as F

from skyledger.operators import geo
from skyledger.operators import rings as rg

SHAPE = "object_id string, geometry array<array<array<struct<x:double,y:double>>>>"


def turn(a, b, c):
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def meet(e, f):
    sign = lambda v: (v > 0) - (v < 0)
    o = [turn(*e, f[0]), turn(*e, f[1]), turn(*f, e[0]), turn(*f, e[1])]
    within = lambda s, p: min(s[0][0], s[1][0]) <= p[0] <= max(s[0][0], s[1][0]) and min(s[0][1], s[1][1]) <= p[1] <= max(s[0][1], s[1][1])
    if sign(o[0]) * sign(o[1]) < 0 and sign(o[2]) * sign(o[3]) < 0:
        return True
    return any(v == 0 and within(s, p) for v, s, p in ((o[0], e, f[0]), (o[1], e, f[1]), (o[2], f, e[0]), (o[3], f, e[1])))


def crosses_itself(ring):
    edges = list(zip(ring, ring[1:]))
    n = len(edges)
    return any(meet(edges[i], edges[j]) for i in range(n) for j in range(i + 2, n) if (i, j) != (0, n - 1))


def side(ring, p):
    """1 on the ring, 0 inside, -1 outside."""
    odd = False
    for a, b in zip(ring, ring[1:]):
        if abs(turn(a, b, p)) <= 1e-12 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1]):
            return 1
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            odd = not odd
    return 0 if odd else -1


def rings_of_all_kinds():
    rng = random.Random(3)
    out = [
        [(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)], [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(0, 0), (1, 0), (0, 1), (0, 0)], [(0, 0), (4, 0), (4, 1), (2, 0), (0, 1), (0, 0)],
        [(0, 0), (4, 0), (2, 0), (2, 3), (0, 0)], [(0, 0), (1, 0)] * 3 + [(0, 0)], [(0, 0), (1, 1), (2, 2), (0, 0)], [(5, 5)] * 5, [(0, 0), (0, 0), (4, 0), (4, 4), (0, 0)],
        [(0, 0), (10, 0), (10, 1e-3), (5, 1e-3), (5, 2e-3), (10, 2e-3), (10, 1), (0, 1), (0, 0)],
        # A pentagram turns one way at every corner, but goes round twice.
        [(math.cos(4 * math.pi * i / 5), math.sin(4 * math.pi * i / 5)) for i in range(5)] + [(1.0, 0.0)],
    ]
    for _ in range(60):
        n = rng.randint(3, 12)
        pts = [(rng.randint(0, 6), rng.randint(0, 6)) for _ in range(n)]
        out.append(pts + pts[:1])
    for _ in range(30):
        spots = sorted(rng.random() * 2 * math.pi for _ in range(rng.randint(3, 30)))
        pts = [(math.cos(a) * 7, math.sin(a) * (1 if rng.random() < 0.5 else 3)) for a in spots]
        out.append(pts + pts[:1])
    return [[(float(x), float(y)) for x, y in r] for r in out]


def frame(spark, rows):
    return spark.createDataFrame([(k, [[[{"x": x, "y": y} for x, y in r] for r in rings] for rings in polygons]) for k, polygons in rows], SHAPE)


def test_self_intersections(spark):
    rings = rings_of_all_kinds()
    shapes = frame(spark, [(str(i), [[r]]) for i, r in enumerate(rings)])
    got = {r.object_id for r in rg.self_intersections(rg.ring_edges(rg.gridded(shapes), "object_id"), ["object_id", "polygon", "ring"]).collect()}
    want = {str(i) for i, r in enumerate(rings) if crosses_itself(r)}
    assert got == want and 20 < len(want) < len(rings) - 20
    # What is proven convex never meets itself.
    proven = {r.object_id for r in shapes.where(rg.convex(F.get(F.get("geometry", F.lit(0)), F.lit(0)))).collect()}
    assert "1" in proven and not proven & want


def test_points_inside(spark):
    rng = random.Random(8)
    rings = rings_of_all_kinds()
    parents = [(str(i), [[r]]) for i, r in enumerate(rings)]
    parents.append(("hole", [[rings[1], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]]]))
    parents.append(("two", [[rings[1]], [[(x + 3, y + 3) for x, y in rings[1]]]]))
    points = [(k, f"{k}-{j}", x, y) for k, _ in parents for j, (x, y) in enumerate([(rng.randint(-1, 8) / 1.0, rng.randint(-1, 8) / 1.0) for _ in range(30)] + [(1.5, 1.5), (1.0, 1.5), (4.0, 2.0), (-9.0, 99.0)])]
    want = set()
    for k, name, x, y in points:
        for outer, *holes in dict(parents)[k]:
            if side(outer, (x, y)) >= 0 and not any(side(h, (x, y)) >= 0 for h in holes):
                want.add(name)
    asked = spark.createDataFrame(points, "object_id string, point string, x double, y double")
    got = [r.point for r in rg.points_inside(asked, rg.gridded(frame(spark, parents)), "object_id", "point").collect()]
    assert set(got) == want and len(got) == len(want)


def test_ring_of_a_hundred_thousand_corners(spark):
    """A jagged circle as parent, a small square in it and one across its rim; then two corners are swapped."""
    n = 100_000
    pts = [((1 + (i % 2) * 1e-5) * math.cos(2 * math.pi * i / n), (1 + (i % 2) * 1e-5) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    bad = pts[:500] + [pts[50_000], *pts[501:]]
    square = lambda x, y: [(x, y), (x + 0.1, y), (x + 0.1, y + 0.1), (x, y + 0.1), (x, y)]
    shapes = frame(spark, [("big", [[pts + pts[:1]]]), ("bad", [[bad + bad[:1]]]), ("in", [[square(0.0, 0.0)]]), ("out", [[square(0.95, 0.0)]])])
    kind = F.when(F.col("object_id").isin("in", "out"), "big")
    features = shapes.select("object_id", "geometry", F.lit("Polygon").alias("geometry_type"), F.lit("parking_zone").alias("object_type"), kind.alias("parent_id"), F.when(kind.isNotNull(), "parking_zone").alias("parent_type"), F.lit(1).alias("pos"))
    got = {(r.issue, r.object_id) for r in geo.topology_issues(features, ["pos"]).collect()}
    assert got == {("self_intersection", "bad"), ("child_outside_parent", "out")}
