"""Screening of road elements and their pixel segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions import tiles as tl

# Drawn width in pixels per road class, and tag values that rule a way out.
ROAD_WIDTH_PIXELS = {
    "motorway": 36, "motorway_link": 24, "trunk": 32, "trunk_link": 22, "primary": 28, "primary_link": 20, "secondary": 24,
    "secondary_link": 18, "tertiary": 20, "tertiary_link": 16, "residential": 16, "unclassified": 16, "living_street": 14, "service": 10,
}
NON_PUBLIC_ACCESS = ("private", "no")
NON_PUBLIC_SERVICE = ("parking_aisle", "driveway", "drive-through")
TUNNELS = ("yes", "building_passage")


def screen_ways(elements: DataFrame) -> DataFrame:
    """The first failing rule of each element as `reason` (null when usable), and the drawn width."""
    tag = lambda name: F.coalesce(F.try_element_at(F.col("tags"), F.lit(name)), F.lit(""))
    highway = tag("highway")
    width = F.lit(None).cast("int")
    for name, pixels in ROAD_WIDTH_PIXELS.items():
        width = F.when(highway == name, pixels).otherwise(width)
    bad_point = lambda p: (
        p["lon"].isNull() | p["lat"].isNull() | F.isnan(p["lon"]) | F.isnan(p["lat"]) | ~p["lon"].between(-180, 180) | ~p["lat"].between(-90, 90)
    )
    reason = (
        F.when(~F.col("type").eqNullSafe("way"), "not_way")
        .when(~highway.isin(list(ROAD_WIDTH_PIXELS)), "unsupported_highway")
        .when(tag("access").isin(list(NON_PUBLIC_ACCESS)), "non_public_access")
        .when((highway == "service") & tag("service").isin(list(NON_PUBLIC_SERVICE)), "internal_service_road")
        .when(tag("tunnel").isin(list(TUNNELS)), "tunnel")
        .when(tag("bridge") == "yes", "bridge")
        .when(F.coalesce(F.size("geometry"), F.lit(0)) < 2, "insufficient_geometry")
        .when(F.exists("geometry", bad_point), "invalid_coordinate")
    )
    return elements.withColumn("reason", reason).withColumn("width", F.when(F.col("reason").isNull(), width))


def block_segments(usable: DataFrame, zoom: int, block: int = 1024, margin: float = 0.0, id_col: str = "id") -> DataFrame:
    """Usable ways as pixel segments of every block that they reach: id, segment, block_row, block_col, ax, ay, bx, by (rounded, in the block's own pixels,
    ends beyond its border included) and thickness (drawn width and margin).

    Blocks are squares of `block` pixels on the pixel grid of a zoom. A segment is walked by rows of blocks: within a row only the part that lies at
    most half the thickness outside it counts, and it names the columns; so a segment has as many rows as blocks near it.
    """
    corner = F.lit(0)
    places = F.transform("geometry", lambda p: F.struct(*[F.rint(v).alias(c) for v, c in zip(tl.lonlat_to_pixel(F.lit(zoom), corner, corner, p["lon"], p["lat"]), "xy")]))
    ways = usable.select(F.col(id_col).alias("id"), (F.col("width") + F.lit(margin)).cast("double").alias("thickness"), places.alias("p")).where(F.size("p") > 1)
    pairs = F.arrays_zip(F.slice("p", 1, F.size("p") - 1).alias("a"), F.slice("p", 2, F.size("p") - 1).alias("b"))
    segments = ways.select("id", "thickness", F.posexplode(pairs).alias("segment", "s")).select("id", "segment", "thickness", *[F.col(f"s.{e}.{c}").alias(f"{e}{c}") for e in "ab" for c in "xy"])
    ax, ay, bx, by, r = F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), F.col("thickness") / 2
    side = F.lit(block)
    rows = segments.withColumn("block_row", F.explode(F.sequence(F.floor((F.least(ay, by) - r) / side), F.floor((F.greatest(ay, by) + r) / side))))
    share = lambda y: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y - ay) / (by - ay)))
    at = lambda y, end: F.when(ay == by, end).otherwise(ax + (bx - ax) * share(y))
    top = F.col("block_row") * side
    near = rows.withColumns({"_p": at(top - r, ax), "_q": at(top + side + r, bx)})
    columns = F.sequence(F.floor((F.least("_p", "_q") - r) / side), F.floor((F.greatest("_p", "_q") + r) / side))
    placed = near.withColumn("block_col", F.explode(columns))
    left = F.col("block_col") * side
    return placed.select("id", "segment", "block_row", "block_col", (ax - left).alias("ax"), (ay - top).alias("ay"), (bx - left).alias("bx"), (by - top).alias("by"), "thickness")


def road_runs(elements: DataFrame, zoom: int, block: int = 1024, margin: float = 0.0) -> DataFrame:
    """Merged runs of all usable ways by block, from road elements."""
    from skyledger.operators.masks import way_runs

    usable = screen_ways(elements).where(F.col("reason").isNull())
    return way_runs(block_segments(usable, zoom, block, margin), ["block_row", "block_col"], block, block)
