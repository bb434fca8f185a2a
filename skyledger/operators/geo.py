"""Map features and blocks: window queries, point lookups, contracts and the topology gate."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import polygons as pg
from skyledger.functions import tiles as tl
from skyledger.operators import rings as rg
from skyledger.operators.ordered import keep_last
from skyledger.operators.sampling import limited
from skyledger.session import cut

# Map object types, the parents each may have, support levels.
PARENT_TYPES = {
    "parking_zone": ("parking_facility",),
    "parking_band": ("parking_zone",),
    "parking_space": ("parking_band",),
    "internal_aisle": ("parking_facility", "parking_zone"),
    "entrance_exit": ("parking_facility",),
    "exclusion": ("parking_facility", "parking_zone"),
    "unknown_region": ("parking_facility", "parking_zone"),
}
POLYGON_TYPES = (
    "parking_facility", "parking_zone", "parking_band", "parking_space", "internal_aisle", "exclusion", "unknown_region",
)
SUPPORT_LEVELS = ("segformer_only", "vehicle_detected", "vehicle_row_supported")


def check_window(west: float, south: float, east: float, north: float) -> None:
    if not all(math.isfinite(v) for v in (west, south, east, north)):
        raise ValueError("window bounds must be finite")
    if west > east or south > north:
        raise ValueError("window bounds must be ordered")


def window_query(
    features: DataFrame, bounds: tuple[float, float, float, float] | None = None, *,
    support: Sequence[str] | None = None, limit: int = 2000, id_col: str = "aoi_id", max_limit: int = 2000,
) -> DataFrame:
    """Features that meet a window (touching counts), by id. On a table with bound columns the four
    comparisons reach the scan and row groups outside the window are skipped."""
    limited(limit, 1, max_limit)
    if support is not None:
        features = features.where(F.col("support_level").isin(list(support)))
    if bounds is not None:
        check_window(*bounds)
        west, south, east, north = bounds
        features = features.where(
            (F.col("east") >= west) & (F.col("west") <= east) & (F.col("north") >= south) & (F.col("south") <= north)
        )
    return features.orderBy(id_col).limit(limit)


def windows_join(items: DataFrame, windows: DataFrame, *, id_col: str, window_id: str, cell: float) -> DataFrame:
    """All (window, item) pairs whose bounds meet, for many windows at once: both sides are put on a
    grid of degrees and joined by cell."""
    from skyledger.operators.overlap import touching_pairs

    box = lambda df, key: df.select(
        F.lit(0).alias("_g"), key, F.col("west").alias("x1"), F.col("south").alias("y1"), F.col("east").alias("x2"), F.col("north").alias("y2")
    )
    pairs = touching_pairs(
        box(windows, window_id), box(items, id_col), group=["_g"], id_col=window_id, right_id=id_col, cell=cell, strict=False
    )
    return pairs.select(F.col("a_id").alias(window_id), F.col("b_id").alias(id_col))


def block_catalog(names: DataFrame, name: str = "name") -> DataFrame:
    """Blocks and their bounds from file names; names of another form are left out."""
    b = F.col("b")
    rows = names.where(tl.is_block(F.col(name))).withColumn("b", tl.block_fields(F.col(name)))
    west, south, east, north = tl.block_bounds(b)
    return rows.select(
        *names.columns, *[b[f].alias(f) for f in ("zoom", "block_row", "block_col", "tile_row", "tile_col")],
        west.alias("west"), south.alias("south"), east.alias("east"), north.alias("north"),
    )


def grid_overview(blocks: DataFrame, thumbnail: int) -> DataFrame:
    """Count, grid range, outer bounds and canvas size of blocks of one zoom; several zooms are an error."""
    g = blocks.agg(
        F.count(F.lit(1)).alias("image_count"), F.min("zoom").alias("zoom"), F.max("zoom").alias("_zoom"),
        *[f(c).alias(f"{n}_{c}") for c in ("block_row", "block_col") for n, f in (("min", F.min), ("max", F.max))],
        F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"),
    )
    size = lambda c: ((F.col(f"max_{c}") - F.col(f"min_{c}") + 1) * thumbnail)
    one_zoom = F.when(F.col("zoom") != F.col("_zoom"), F.raise_error(F.lit("one zoom level is required"))).otherwise(F.col("zoom"))
    return g.select(
        "image_count", one_zoom.alias("zoom"), "min_block_row", "max_block_row", "min_block_col", "max_block_col",
        "west", "south", "east", "north", size("block_col").alias("width"), size("block_row").alias("height"),
    )


def point_lookup(features: DataFrame, ids: DataFrame, images: DataFrame, masks: DataFrame, id_col: str = "aoi_id") -> DataFrame:
    """Wanted ids with whether they are known and whether their image and mask exist."""
    flag = lambda df, name: df.select(id_col).distinct().withColumn(name, F.lit(True))
    out = ids
    for df, name in ((features, "known"), (images, "image_available"), (masks, "mask_available")):
        out = out.join(flag(df, name), id_col, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def repeated_ids(df: DataFrame, key: str) -> DataFrame:
    """Ids that occur more than once: must be empty where ids have to be unique."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def summary_contract(features: DataFrame) -> DataFrame:
    """Counts per support level and whether they are valid and add up to the total."""
    known = F.col("support_level").isin(list(SUPPORT_LEVELS))
    counts = features.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("support_level") == s).alias(s) for s in SUPPORT_LEVELS],
        F.count_if(~F.coalesce(known, F.lit(False))).alias("unknown_level"), F.count_if(F.coalesce("aoi_id", F.lit("")) == "").alias("missing_id"),
    )
    parts = sum((F.col(s) for s in SUPPORT_LEVELS), F.lit(0))
    return counts.withColumn("valid", (parts == F.col("total")) & (F.col("unknown_level") == 0) & (F.col("missing_id") == 0))


def schema_issues(features: DataFrame) -> DataFrame:
    """Type rules per feature: a polygon type needs a polygon, an object with parent rules needs a
    parent of an allowed type, a facility has none."""
    kind = F.col("object_type")
    allowed = F.lit(False)
    for child, parents in PARENT_TYPES.items():
        allowed = allowed | ((kind == child) & F.col("parent_type").isin(list(parents)))
    has_rule = kind.isin(list(PARENT_TYPES))
    checks = F.array_compact(F.array(
        F.when(~kind.isin([*POLYGON_TYPES, "entrance_exit"]), "unknown_object_type"),
        F.when(kind.isin(list(POLYGON_TYPES)) & ~F.col("geometry_type").isin("Polygon", "MultiPolygon"), "geometry_type_not_allowed"),
        F.when(has_rule & F.col("parent_id").isNull(), "parent_required"),
        F.when(has_rule & F.col("parent_id").isNotNull() & ~F.coalesce(allowed, F.lit(False)), "parent_type_not_allowed"),
        F.when(~has_rule & F.col("parent_id").isNotNull(), "parent_not_allowed"),
    ))
    return features.select("object_id", F.explode(checks).alias("issue"))


def topology_issues(features: DataFrame, order: Sequence[str]) -> DataFrame:
    """Distinct (issue, object_id): repeated ids, geometry issues, missing parents, wrong parent types
    and children with a vertex outside the parent.

    Needs object_id, object_type, parent_id, parent_type, geometry_type and geometry (polygons >
    rings > points). The last feature of a repeated id is the parent that counts.
    """
    repeated = repeated_ids(features, "object_id").select(F.lit("duplicate_object_id").alias("issue"), "object_id")
    shape = features.select(
        F.explode(pg.polygon_issues(F.col("geometry_type"), F.col("geometry"))).alias("issue"), "object_id"
    )
    # Features that share an id keep their rings apart.
    open_rings = lambda rings: F.filter(rings, lambda r: pg.ring_ok(r) & ~rg.convex(r))
    own = features.where(F.col("geometry_type").isin("Polygon", "MultiPolygon")).select(
        F.struct("object_id", F.xxhash64("object_id", "geometry").alias("shape")).alias("id"),
        F.filter(F.transform("geometry", open_rings), lambda rings: F.size(rings) > 0).alias("geometry"),
    )
    own = own.where(F.size("geometry") > 0)
    crossed = rg.self_intersections(rg.ring_edges(rg.gridded(own), "id"), ["id", "polygon", "ring"]).select(F.lit("self_intersection").alias("issue"), F.col("id.object_id").alias("object_id"))

    children = features.where(F.col("parent_id").isNotNull()).select("object_id", "parent_id", "parent_type", "geometry")
    asked = children.select(F.col("parent_id").alias("object_id")).distinct()
    parents = cut(
        keep_last(features.join(asked, "object_id", "left_semi").select("object_id", "object_type", "geometry", *order), ["object_id"], order)
        .select(F.col("object_id").alias("parent_id"), F.col("object_type").alias("p_type"), "geometry"), "parents",
    )
    family = children.select("object_id", "parent_id", "parent_type").join(parents.select("parent_id", "p_type"), "parent_id", "left")
    found = F.col("p_type").isNotNull()
    checks = F.array_compact(F.array(F.when(~found, "missing_parent"), F.when(found & ~F.col("parent_type").eqNullSafe(F.col("p_type")), "parent_type_mismatch")))
    links = family.select(F.explode(checks).alias("issue"), "object_id")
    # Corners once a child and parent; the last point of a ring repeats its first.
    corners = F.flatten(F.transform("geometry", lambda rings: F.flatten(F.transform(rings, lambda r: F.slice(r, 1, F.size(r) - 1)))))
    points = children.select("object_id", "parent_id", F.explode(F.array_distinct(corners)).alias("p")).join(parents.select("parent_id"), "parent_id", "left_semi")
    points = cut(points.select("parent_id", F.struct("object_id", "p.x", "p.y").alias("point"), "p.x", "p.y"), "corners")
    inside = rg.points_inside(points, rg.gridded(parents), "parent_id", "point")
    outside = points.join(inside, ["parent_id", "point"], "left_anti").select(F.lit("child_outside_parent").alias("issue"), F.col("point.object_id").alias("object_id"))
    return reduce(DataFrame.unionByName, [repeated, shape, crossed, links, outside]).distinct()


def topology_decision(issues: DataFrame) -> DataFrame:
    return issues.agg(F.count(F.lit(1)).alias("issues")).withColumn(
        "decision", F.when(F.col("issues") > 0, "auto_reject").otherwise("auto_accept")
    )


def support_level(features: DataFrame, with_rows: DataFrame, with_vehicles: DataFrame, id_col: str = "aoi_id") -> DataFrame:
    """Row support beats vehicle detections beats model-only."""
    rows = with_rows.select(id_col).distinct().withColumn("_rows", F.lit(True))
    vehicles = with_vehicles.select(id_col).distinct().withColumn("_cars", F.lit(True))
    level = F.when(F.col("_rows"), "vehicle_row_supported").when(F.col("_cars"), "vehicle_detected").otherwise("segformer_only")
    return features.join(rows, id_col, "left").join(vehicles, id_col, "left").withColumn("support_level", level).drop("_rows", "_cars")


def layer_counts(features: DataFrame, order_layers: dict[str, str]) -> DataFrame:
    """Features per layer; a facility is supported when its AOI has any parking band."""
    bands = features.where(F.col("object_type") == "parking_band").select("aoi_id").distinct().withColumn("_band", F.lit(True))
    layer = F.when(
        F.col("object_type") == "parking_facility",
        F.when(F.col("_band"), "supported_facility").otherwise("candidate_facility"),
    )
    for kind, name in order_layers.items():
        layer = layer.when(F.col("object_type") == kind, name)
    return features.join(bands, "aoi_id", "left").withColumn("layer", layer).where(F.col("layer").isNotNull()).drop("_band")
