"""Predicates on polygon rings as joins of their edges.

Every ring brings its own grid, whose cells are as wide and high as its edges are on average, and an edge is put into the cells that it crosses: about three
rows an edge, however uneven the edges are. Two edges can only meet in a cell that both cross; a point is compared with the edges of its row of cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import polygons as pg
from skyledger.session import cut

EDGE = ("ax", "ay", "bx", "by")
GRID = ("gx", "gy", "cw", "ch")


def convex(ring: Column) -> Column:
    """A closed ring that turns one way at every corner and goes round once: x and y each change their direction twice. Its edges meet at corners only.

    One pass over the points and once more over the first step, so that the last corner is seen too.
    """
    zero = F.lit(0.0)
    names = ("x", "y", "dx", "dy", "sx", "sy", "cx", "cy", "left", "right")
    first = F.get(ring, F.lit(0))
    start = F.struct(first["x"].alias("x"), first["y"].alias("y"), *[zero.alias(c) for c in names[2:]])

    def step(s, p):
        dx, dy = p["x"] - s["x"], p["y"] - s["y"]
        bend = s["dx"] * dy - s["dy"] * dx
        moved = (s["dx"] != 0) | (s["dy"] != 0)
        # The last direction that was not flat, and how often it changed.
        kept = lambda d, old: F.when(d == 0, old).otherwise(F.signum(d))
        change = lambda d, old: F.when(d * old < 0, 1.0).otherwise(0.0)
        now = (p["x"], p["y"], dx, dy, kept(dx, s["sx"]), kept(dy, s["sy"]), s["cx"] + change(dx, s["sx"]), s["cy"] + change(dy, s["sy"]),
               s["left"] + F.when(moved & (bend >= 0), 1.0).otherwise(0.0), s["right"] + F.when(moved & (bend <= 0), 1.0).otherwise(0.0))
        return F.struct(*[v.alias(c) for v, c in zip(now, names)])

    # After the last point, the second and third once more: the closing corner, and the direction changes of the way round.
    walk = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 2, 2))
    return F.aggregate(walk, start, step, lambda s: ((s["left"] == 0) != (s["right"] == 0)) & (s["cx"] <= 3) & (s["cy"] <= 3))


def gridded(polygons: DataFrame, geometry: str = "geometry") -> DataFrame:
    """polygons with origin and cell size of their grid: the mean width and height of their edges, but no more than a few cells a side for each edge."""
    points = F.flatten(F.transform(geometry, lambda rings: F.flatten(F.coalesce(rings, F.array()))))
    rows = polygons.withColumn("_at", points).where(F.size("_at") > 1)
    n = F.size("_at") - 1

    def side(axis):
        values = F.transform("_at", lambda p: p[axis])
        steps = F.zip_with(F.slice(values, 1, n), F.slice(values, 2, n), lambda p, q: F.abs(q - p))
        return F.array_min(values), F.greatest(F.aggregate(steps, F.lit(0.0), lambda s, v: s + v) / n, (F.array_max(values) - F.array_min(values)) / (4 * n), F.lit(1e-300))

    (gx, cw), (gy, ch) = side("x"), side("y")
    return rows.withColumns({"gx": gx, "gy": gy, "cw": cw, "ch": ch}).drop("_at")


def ring_edges(polygons: DataFrame, key: str, geometry: str = "geometry") -> DataFrame:
    """key, polygon, ring, i (1-based), n (edges of the ring), ax, ay, bx, by of every edge of gridded polygons, and their grid; a ring of fewer than two
    points has no edges."""
    rings = polygons.select(key, *GRID, F.posexplode(geometry).alias("polygon", "_rings")).select(key, *GRID, "polygon", F.posexplode("_rings").alias("ring", "_points"))
    rings = rings.where(F.size("_points") > 1)
    pairs = F.arrays_zip(F.slice("_points", 1, F.size("_points") - 1).alias("a"), F.slice("_points", 2, F.size("_points") - 1).alias("b"))
    spread = rings.select(key, *GRID, "polygon", "ring", (F.size("_points") - 1).alias("n"), F.posexplode(pairs).alias("_i", "_e"))
    end = lambda p, c: F.col(f"_e.{p}.{c}").alias(f"{p}{c}")
    return spread.select(key, *GRID, "polygon", "ring", (F.col("_i") + 1).alias("i"), "n", end("a", "x"), end("a", "y"), end("b", "x"), end("b", "y"))


def _line(y: Column) -> Column:
    return F.floor((y - F.col("gy")) / F.col("ch"))


def _in_lines(edges: DataFrame) -> DataFrame:
    """Edges once per row of cells that they reach."""
    lines = F.sequence(_line(F.least("ay", "by")), _line(F.greatest("ay", "by")))
    return edges.withColumn("line", F.explode(lines))


def _in_cells(edges: DataFrame) -> DataFrame:
    """Edges once per cell that they cross; a hair more on both sides, so that rounding leaves out no cell."""
    rows = _in_lines(edges)
    flat = F.col("by") == F.col("ay")
    at = lambda y: F.col("ax") + (F.col("bx") - F.col("ax")) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y - F.col("ay")) / (F.col("by") - F.col("ay"))))
    low = F.col("gy") + F.col("line") * F.col("ch")
    first, last = F.when(flat, F.col("ax")).otherwise(at(low)), F.when(flat, F.col("bx")).otherwise(at(low + F.col("ch")))
    column = lambda x, slack: F.floor((x - F.col("gx")) / F.col("cw") + slack)
    cells = F.sequence(column(F.least(first, last), -1e-6), column(F.greatest(first, last), 1e-6))
    return rows.withColumn("cell", F.explode(cells))


def self_intersections(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of rings two of whose edges meet without being neighbours. Rings count as closed: the last edge is next to the first."""
    edges = cut(edges, "edges")
    # Equal edges meet, so of a ring with two that are no neighbours nothing more is asked; what is left has no crowds of equal edges.
    ends = [F.struct(F.col(f"{p}x").alias("x"), F.col(f"{p}y").alias("y")) for p in "ab"]
    repeats = edges.groupBy(*keys, F.least(*ends).alias("_p"), F.greatest(*ends).alias("_q")).agg(F.min("i").alias("_lo"), F.max("i").alias("_hi"), F.first("n").alias("_n"))
    certain = repeats.where((F.col("_hi") > F.col("_lo") + 1) & ~((F.col("_lo") == 1) & (F.col("_hi") == F.col("_n")))).select(*keys).distinct()
    rest = edges.join(certain, keys, "left_anti")
    placed = _in_cells(rest)
    side = lambda p: placed.select(*[F.col(k).alias(f"{p}{k}") for k in keys], *[F.col(c).alias(p + c) for c in ("line", "cell", "i", *EDGE)], *([F.col("n").alias("e_n")] if p == "e_" else []))
    on = [F.col(f"e_{k}") == F.col(f"f_{k}") for k in (*keys, "line", "cell")]
    of = lambda p: {c: F.col(p + c) for c in EDGE}
    apart = (F.col("f_i") > F.col("e_i") + 1) & ~((F.col("e_i") == 1) & (F.col("f_i") == F.col("e_n")))
    met = side("e_").join(side("f_"), [*on, apart]).where(pg.segments_meet(of("e_"), of("f_")))
    return certain.unionByName(met.select(*[F.col(f"e_{k}").alias(k) for k in keys]).distinct())


def points_inside(points: DataFrame, polygons: DataFrame, key: str, point: str) -> DataFrame:
    """The points (key, point, x, y) that lie in a polygon of the gridded polygons of their key: inside or on its outer ring (ring 0), and neither inside nor
    on a hole.

    A ray to the right crosses an odd number of a ring's edges from inside. Only edges in the point's row of cells can be crossed or touched; a row of
    cells is as high as an edge on average.
    """
    rows = _in_lines(ring_edges(polygons, key)).select(key, "line", "polygon", "ring", *EDGE)
    asked = points.join(polygons.select(key, "gy", "ch"), key).withColumn("line", _line(F.col("y"))).select(key, point, "x", "y", "line")
    both = asked.join(rows, [key, "line"])
    x, y, ax, ay, bx, by = (F.col(c) for c in ("x", "y", *EDGE))
    crosses = ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    on = (F.abs(pg.turn(ax, ay, bx, by, x, y)) <= 1e-12) & x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))
    per_ring = both.groupBy(key, point, "polygon", "ring").agg(F.bool_or(on).alias("_on"), F.count_if(crosses).alias("_c"))
    within = F.col("_on") | (F.col("_c") % 2 == 1)
    per_polygon = per_ring.groupBy(key, point, "polygon").agg(F.bool_or((F.col("ring") == 0) & within).alias("_in"), F.bool_or((F.col("ring") > 0) & within).alias("_hole"))
    return per_polygon.where(F.col("_in") & ~F.col("_hole")).select(key, point).distinct()
