"""Column expressions on polygons: a ring is ARRAY<STRUCT<x, y>>, a polygon is an array of rings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def points(coords: Column) -> Column:
    """Flat [x1, y1, x2, y2, ...] as an array of points."""
    return F.transform(
        F.sequence(F.lit(0), (F.size(coords) / 2).cast("int") - 1),
        lambda i: F.struct(F.get(coords, i * 2).alias("x"), F.get(coords, i * 2 + 1).alias("y")),
    )


def box_ring(b) -> Column:
    """Four corners of a box, clockwise from the top left."""
    x1, y1, x2, y2 = b
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(p(x1, y1), p(x2, y1), p(x2, y2), p(x1, y2))


def _next(ring: Column) -> Column:
    """The ring moved on by one point."""
    return F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))


def signed_area(ring: Column) -> Column:
    """Shoelace sum over two; positive when x turns towards y."""
    cross = F.zip_with(ring, _next(ring), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def oriented(ring: Column, positive: bool = True) -> Column:
    """The ring reversed if its signed area has the wrong sign."""
    turn = signed_area(ring)
    return F.when((turn < 0) if positive else (turn > 0), F.reverse(ring)).otherwise(ring)


def bounds(ring: Column):
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def aspect_ratio(ring: Column) -> Column:
    """Longest over shortest edge of a four-point ring, otherwise long over short side of the bounds.
    Infinity when the shorter is at most 1e-9."""
    edges = F.zip_with(
        ring, _next(ring),
        lambda p, q: F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"])),
    )
    x1, y1, x2, y2 = bounds(ring)
    four = F.size(ring) == 4
    short = F.when(four, F.array_min(edges)).otherwise(F.least(x2 - x1, y2 - y1))
    long = F.when(four, F.array_max(edges)).otherwise(F.greatest(x2 - x1, y2 - y1))
    return F.when(short <= 1e-9, F.lit(float("inf"))).otherwise(long / short)


def corner_order(ring: Column) -> Column:
    """Four points as top-left, top-right, bottom-right, bottom-left, by least and greatest x + y
    and y - x."""
    by = lambda key: F.array_sort(
        F.transform(ring, lambda p: F.struct(key(p).alias("k"), p["x"].alias("x"), p["y"].alias("y")))
    )
    total, slope = by(lambda p: p["x"] + p["y"]), by(lambda p: p["y"] - p["x"])
    pick = lambda arr, i: F.struct(F.element_at(arr, i)["x"].alias("x"), F.element_at(arr, i)["y"].alias("y"))
    return F.array(pick(total, 1), pick(slope, 1), pick(total, -1), pick(slope, -1))


def is_closed(ring: Column) -> Column:
    first, last = F.element_at(ring, 1), F.element_at(ring, -1)
    return (first["x"] == last["x"]) & (first["y"] == last["y"])


def turn(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segments_meet(e, f) -> Column:
    """Two segments meet: a proper crossing or an end point on the other segment."""
    o1 = turn(e["ax"], e["ay"], e["bx"], e["by"], f["ax"], f["ay"])
    o2 = turn(e["ax"], e["ay"], e["bx"], e["by"], f["bx"], f["by"])
    o3 = turn(f["ax"], f["ay"], f["bx"], f["by"], e["ax"], e["ay"])
    o4 = turn(f["ax"], f["ay"], f["bx"], f["by"], e["bx"], e["by"])
    sign = F.signum
    proper = (sign(o1) * sign(o2) < 0) & (sign(o3) * sign(o4) < 0)

    def on(o, s, px, py):
        inside_x = (px >= F.least(s["ax"], s["bx"])) & (px <= F.greatest(s["ax"], s["bx"]))
        inside_y = (py >= F.least(s["ay"], s["by"])) & (py <= F.greatest(s["ay"], s["by"]))
        return (o == 0) & inside_x & inside_y

    touch = (
        on(o1, e, f["ax"], f["ay"]) | on(o2, e, f["bx"], f["by"]) | on(o3, f, e["ax"], e["ay"]) | on(o4, f, e["bx"], e["by"])
    )
    return proper | touch


def ring_ok(ring: Column) -> Column:
    """A closed ring of at least four points."""
    return (F.size(ring) >= 4) & is_closed(ring)


def polygon_issues(kind: Column, polygons: Column) -> Column:
    """Distinct structural issues of a Polygon or MultiPolygon given as polygons > rings > points; whether edges meet takes a join (operators.rings)."""
    found = F.flatten(
        F.transform(
            polygons,
            lambda rings: F.when(F.size(rings) == 0, F.array(F.lit("empty_polygon"))).otherwise(
                F.transform(rings, lambda ring: F.when(~ring_ok(ring), "unclosed_or_short_ring"))
            ),
        )
    )
    return (
        F.when(~kind.isin("Polygon", "MultiPolygon"), F.array(F.lit("unsupported_geometry_type")))
        .when(F.coalesce(F.size(polygons), F.lit(0)) <= 0, F.array(F.lit("empty_geometry")))
        .otherwise(F.array_distinct(F.array_compact(found)))
    )


def quad(coords: Column):
    """The eight numbers of a four-point label as scalars; these stay inside generated code."""
    return [F.get(coords, F.lit(i)) for i in range(8)]


def quad_area(c) -> Column:
    total = F.lit(0.0)
    for i in range(4):
        j = (i + 1) % 4
        total = total + (c[2 * i] * c[2 * j + 1] - c[2 * j] * c[2 * i + 1])
    return F.abs(total / 2)


def quad_aspect(c) -> Column:
    edge = []
    for i in range(4):
        j = (i + 1) % 4
        dx, dy = c[2 * j] - c[2 * i], c[2 * j + 1] - c[2 * i + 1]
        edge.append(F.sqrt(dx * dx + dy * dy))
    short, long = F.least(*edge), F.greatest(*edge)
    return F.when(short <= 1e-9, F.lit(float("inf"))).otherwise(long / short)
