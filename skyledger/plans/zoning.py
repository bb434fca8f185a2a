"""Functional zoning jobs over run tables: surfaces, bands, aisles, entrances and exclusions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.operators import canvas as cv
from skyledger.operators import masks as mk
from skyledger.session import cut

# Least confidence per exclusion prompt, and rules of the zoning jobs.
EXCLUSION_CONFIDENCE = {"building": 0.70, "public road": 0.65}
BETWEEN_BANDS_PX = 48
ENTRANCE_PX = 12
MIN_COMPONENT_PX = 100
MARKING_ONLY_LIMIT = 0.8


def screen_exclusions(candidates: DataFrame, runs: DataFrame, *, image: str, mask: str, width: int, height: int, minimum: int = MIN_COMPONENT_PX) -> DataFrame:
    """First failing reason of each exclusion candidate (null when it passes): mask present, area,
    confidence of its prompt, and a public road must touch the border."""
    shape = mk.measure(mk.merge_runs(runs, [image, mask]), [image, mask], width, height)
    least = F.lit(None).cast("double")
    for prompt, value in EXCLUSION_CONFIDENCE.items():
        least = F.when(F.col("prompt") == prompt, value).otherwise(least)
    reason = (
        F.when(least.isNull(), "unsupported_prompt")
        .when(F.col("area").isNull(), "missing_or_mismatched_mask")
        .when(F.col("area") < minimum, "area_below_minimum")
        .when(F.coalesce("confidence", F.lit(0.0)) < least, "confidence_below_threshold")
        .when((F.col("prompt") == "public road") & ~F.col("touches_border"), "public_road_does_not_touch_border")
    )
    return candidates.join(shape.select(image, mask, "area", "touches_border"), [image, mask], "left").withColumn("reason", reason)


def apply_exclusions(candidates: DataFrame, exclusions: DataFrame, *, image: str, mask: str):
    """Candidate runs minus the image's exclusions, and per candidate area, remaining area, removed
    fraction and component counts before and after. Exclusions are merged per image first and then
    cut to the rows each candidate has, so a candidate never meets other images' runs."""
    merged = cut(mk.merge_runs(candidates, [image, mask]), "candidates")
    union = mk.merge_runs(exclusions, [image]).withColumnRenamed("x0", "e0").withColumnRenamed("x1", "e1")
    local = merged.join(union, [image, "y"]).where((F.col("e0") < F.col("x1")) & (F.col("x0") < F.col("e1"))).select(
        image, mask, "y", F.greatest("x0", "e0").alias("x0"), F.least("x1", "e1").alias("x1")
    )
    remaining = cut(mk.subtract(merged, local, [image, mask]), "remaining")
    return merged, remaining


def exclusion_records(merged: DataFrame, remaining: DataFrame, *, image: str, mask: str) -> DataFrame:
    keys = [image, mask]
    length = F.sum(F.col("x1") - F.col("x0"))
    before = merged.groupBy(*keys).agg(length.alias("area"))
    after = remaining.groupBy(*keys).agg(length.alias("remaining"))
    parts = lambda runs, name: mk.label_components(runs, keys).groupBy(*keys).agg(F.countDistinct("component").alias(name))
    joined = before.join(after, keys, "left").join(parts(merged, "source_components"), keys, "left").join(parts(remaining, "component_count"), keys, "left")
    left = F.coalesce("remaining", F.lit(0))
    return joined.select(
        *keys, "area", left.alias("remaining"), ((F.col("area") - left) / F.col("area")).alias("removed_fraction"),
        "source_components", F.coalesce("component_count", F.lit(0)).alias("component_count"), (left == 0).alias("fully_excluded"),
    )


def exclusion_effects(records: DataFrame) -> DataFrame:
    """How many candidates were already split, are newly split, or lost any, 1% or 10% of their area."""
    gone = F.col("removed_fraction")
    return records.agg(
        F.count_if(F.col("source_components") > 1).alias("source_already_multicomponent"),
        F.count_if(F.col("component_count") > F.col("source_components")).alias("newly_split_after_exclusion"),
        F.count_if(gone > 1e-9).alias("candidates_with_any_removed_area"),
        F.count_if(gone >= 0.01).alias("candidates_with_at_least_1pct_removed"),
        F.count_if(gone >= 0.1).alias("candidates_with_at_least_10pct_removed"),
    )


def anchored_surfaces(candidates: DataFrame, runs: DataFrame, anchors: DataFrame, exclusions: DataFrame, *, image: str, mask: str,
                      min_confidence: float = 0.4, min_area: int = 500, min_anchor: int = 100):
    """Surfaces kept by confidence, area after exclusion and overlap with anchors; then the components
    of their union are checked again. Returns (candidate reasons, kept component runs, component reasons)."""
    keys = [image, mask]
    _, remaining = apply_exclusions(runs, exclusions, image=image, mask=mask)
    anchor = cut(mk.merge_runs(anchors, [image]), "anchors")
    area = remaining.groupBy(*keys).agg(F.sum(F.col("x1") - F.col("x0")).alias("area"))
    hit = mk.pair_overlaps(remaining, anchor.withColumn("_anchor", F.lit(1)), [image], mask, "_anchor").select(*keys, "common")
    present = runs.select(*keys).distinct().withColumn("_present", F.lit(True))
    facts = candidates.join(present, keys, "left").join(area, keys, "left").join(hit, keys, "left")
    reason = (
        F.when(F.col("_present").isNull(), "missing_or_mismatched_mask")
        .when(F.coalesce("confidence", F.lit(0.0)) < min_confidence, "confidence_below_threshold")
        .when(F.coalesce("area", F.lit(0)) < min_area, "area_below_minimum_after_exclusion")
        .when(F.coalesce("common", F.lit(0)) < min_anchor, "anchor_overlap_below_minimum")
    )
    judged = cut(facts.select(*keys, reason.alias("reason")), "surfaces")
    union = mk.merge_runs(remaining.join(judged.where(F.col("reason").isNull()), keys, "left_semi"), [image])
    parts = mk.label_components(union, [image])
    stats = mk.component_stats(parts, [image])
    touched = mk.pair_overlaps(parts, anchor.withColumn("_anchor", F.lit(1)), [image], "component", "_anchor").select("component", "common")
    part_reason = F.when(F.col("area") < min_area, "component_area_below_minimum").when(
        F.coalesce("common", F.lit(0)) < min_anchor, "component_anchor_overlap_below_minimum"
    )
    judged_parts = stats.join(touched, "component", "left").select(image, "component", part_reason.alias("reason"))
    kept = parts.join(judged_parts.where(F.col("reason").isNull()), "component", "left_semi")
    return judged, kept, judged_parts


def revalidate_bands(bands: DataFrame, runs: DataFrame, facility: DataFrame, vehicles: DataFrame, *, image: str, mask: str,
                     min_marking: float = 0.6, min_vehicles: int = 2, min_area: int = MIN_COMPONENT_PX,
                     limit: float = MARKING_ONLY_LIMIT) -> DataFrame:
    """Band seeds after clipping to the facility: area, vehicles whose centre is inside, acceptance and
    reasons. When all accepted bands of an image rest on markings only and together cover more than
    `limit` of the facility, none of them is accepted. `bands` carries marking_strength."""
    keys = [image, mask]
    ground = cut(mk.merge_runs(facility, [image]), "facility")
    merged = mk.merge_runs(runs, keys)
    g = ground.withColumnRenamed("x0", "g0").withColumnRenamed("x1", "g1")
    clipped = cut(
        merged.join(g, [image, "y"]).where((F.col("g0") < F.col("x1")) & (F.col("x0") < F.col("g1")))
        .select(*keys, "y", F.greatest("x0", "g0").alias("x0"), F.least("x1", "g1").alias("x1")), "bands",
    )
    area = clipped.groupBy(*keys).agg(F.sum(F.col("x1") - F.col("x0")).alias("clipped_area"))
    centre = lambda a, b: F.rint((F.col(a) + F.col(b)) / 2).cast("bigint")
    # Vehicles are counted per pixel first, so the join carries one row per occupied pixel.
    spots = vehicles.groupBy(image, centre("y1", "y2").alias("y"), centre("x1", "x2").alias("px")).agg(F.count(F.lit(1)).alias("n"))
    cars = spots.join(clipped, [image, "y"]).where((F.col("px") >= F.col("x0")) & (F.col("px") < F.col("x1"))).groupBy(*keys).agg(F.sum("n").alias("vehicles"))
    facts = bands.join(area, keys, "left").join(cars, keys, "left")
    size, count = F.coalesce("clipped_area", F.lit(0)), F.coalesce("vehicles", F.lit(0))
    marking, cars_ok = F.coalesce(F.col("marking_strength") >= min_marking, F.lit(False)), count >= min_vehicles
    judged = cut(facts.select(
        *keys, size.alias("clipped_area"), count.alias("vehicles"), marking.alias("by_marking"), cars_ok.alias("by_vehicles"),
        ((size >= min_area) & (marking | cars_ok)).alias("accepted"),
    ), "bands")
    accepted = judged.where("accepted")
    union = mk.merge_runs(clipped.join(accepted, keys, "left_semi"), [image]).groupBy(image).agg(F.sum(F.col("x1") - F.col("x0")).alias("union_area"))
    whole = ground.groupBy(image).agg(F.sum(F.col("x1") - F.col("x0")).alias("facility_area"))
    only = accepted.groupBy(image).agg(F.bool_and(~F.col("by_vehicles")).alias("marking_only"))
    too_large = only.join(union, image).join(whole, image).where(
        F.col("marking_only") & (F.col("union_area") / F.col("facility_area") > limit)
    ).select(image, F.lit(True).alias("_large"))
    large = F.coalesce("_large", F.lit(False)) & F.col("accepted")
    reasons = F.array_compact(F.array(
        F.when(F.col("clipped_area") < min_area, "area_below_minimum_after_clipping"),
        F.when(~F.col("by_marking") & ~F.col("by_vehicles"), "insufficient_support_after_clipping"),
        F.when(large, "marking_only_union_too_large"),
    ))
    return judged.join(too_large, image, "left").select(
        *keys, "clipped_area", "vehicles", "by_marking", "by_vehicles", (F.col("accepted") & ~large).alias("accepted"), reasons.alias("rejection_reasons")
    )


def functional_zones(facility: DataFrame, band_seeds: DataFrame, roads: DataFrame, *, image: str, width: int, height: int,
                     between: int = BETWEEN_BANDS_PX, near: int = ENTRANCE_PX, minimum: int = MIN_COMPONENT_PX) -> dict[str, DataFrame]:
    """Labelled runs of parking_band, internal_aisle and entrance_exit, and runs of unknown_region.

    An aisle is facility ground that is no band and within `between` pixels of two band components;
    an entrance is aisle within `near` pixels of a public road; what is left is unknown. Distances
    are exact Euclidean.
    """
    keys = [image]
    ground = cut(mk.merge_runs(facility, keys), "facility")
    bands = cv.retain(mk.intersect(band_seeds, ground, keys), keys, minimum)
    reach = cv.dilate(bands, [image, "component"], between, width, height)
    layers = ["facility", "band", "near"]
    named = lambda df, name: df.select(image, "y", "x0", "x1", F.lit(name).alias("layer"))
    stack = reduce(DataFrame.unionByName, [named(ground, "facility"), named(bands, "band"), named(reach, "near")])
    between_bands = (F.col("n_facility") > 0) & (F.col("n_band") == 0) & (F.col("n_near") >= 2)
    aisles = cv.retain(mk.combine(stack, keys, "layer", layers, between_bands, merged=True), keys, minimum)
    road_side = cv.dilate(mk.merge_runs(roads, keys), keys, near, width, height)
    entrances = cv.retain(mk.intersect(aisles, road_side, keys, merged=True), keys, minimum)
    inner = cv.retain(mk.subtract(aisles, entrances, keys, merged=True), keys, minimum)
    taken = reduce(DataFrame.unionByName, [df.select(image, "y", "x0", "x1") for df in (bands, inner, entrances)])
    unknown = mk.subtract(ground, taken, keys, merged=True)
    return {"parking_band": bands, "internal_aisle": inner, "entrance_exit": entrances, "unknown_region": unknown, "facility": ground}


def zone_features(zone: DataFrame, facility: DataFrame, roads: DataFrame, bands: DataFrame, *, image: str, width: int, height: int, near: int = ENTRANCE_PX) -> DataFrame:
    """Per image: area, share of the facility, components, extent, compactness (pixel outline),
    neighbouring band components, share near a road, border touch. `bands` is labelled."""
    keys = [image]
    runs = cut(mk.merge_runs(zone, keys), "zone")
    shape = mk.measure(runs, keys, width, height).select(image, "area", "touches_border")
    parts = mk.component_stats(cv.label(runs, keys), keys).groupBy(image).agg(
        F.count(F.lit(1)).alias("components"),
        F.sum((F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top"))).alias("_boxes"),
    )
    outline = mk.perimeter(runs, keys).select(image, "compactness")
    ground = mk.merge_runs(facility, keys).groupBy(image).agg(F.sum(F.col("x1") - F.col("x0")).alias("_facility"))
    beside = cv.dilate(mk.merge_runs(roads, keys), keys, near, width, height)
    close = mk.overlap_areas(runs, beside, keys).select(image, "common")
    around = cv.dilate(bands, [image, "component"], near, width, height)
    neighbours = mk.pair_overlaps(runs.withColumn("_z", F.lit(1)), around, keys, "_z", "component").groupBy(image).agg(
        F.countDistinct("component").alias("adjacent_bands")
    )
    j = shape
    for side in (parts, outline, ground, close, neighbours):
        j = j.join(side, image, "left")
    return j.select(
        image, "area", (F.col("area") / F.col("_facility")).alias("facility_fraction"), "components", (F.col("area") / F.col("_boxes")).alias("extent"),
        "compactness", F.coalesce("adjacent_bands", F.lit(0)).alias("adjacent_bands"), (F.coalesce("common", F.lit(0)) / F.col("area")).alias("road_fraction"), "touches_border",
    )


def functional_map(zones: dict[str, DataFrame], *, image: str) -> DataFrame:
    """Map rows (object_id, type, parent, area): one facility and one zone per image with any ground,
    one row per band, aisle and entrance component and one for the unknown ground."""
    area = F.sum(F.col("x1") - F.col("x0")).alias("area")
    aoi = F.col(image).cast("string")
    row = lambda df, kind, oid, parent, ptype: df.select(
        image, oid.alias("object_id"), F.lit(kind).alias("object_type"), parent.alias("parent_id"), F.lit(ptype).alias("parent_type"), "area"
    )
    ground = zones["facility"].groupBy(image).agg(area)
    fid, zid = F.concat(aoi, F.lit(":facility")), F.concat(aoi, F.lit(":zone"))
    rows = [row(ground, "parking_facility", fid, F.lit(None).cast("string"), None), row(ground, "parking_zone", zid, fid, "parking_facility")]
    for kind, parent, ptype in (("parking_band", zid, "parking_zone"), ("internal_aisle", zid, "parking_zone"), ("entrance_exit", fid, "parking_facility")):
        parts = zones[kind].groupBy(image, "component").agg(area)
        oid = F.concat(aoi, F.lit(f":{kind}:"), F.col("component.y").cast("string"), F.lit("-"), F.col("component.x0").cast("string"))
        rows.append(row(parts, kind, oid, parent, ptype))
    rest = zones["unknown_region"].groupBy(image).agg(area)
    rows.append(row(rest, "unknown_region", F.concat(aoi, F.lit(":unknown")), zid, "parking_zone"))
    return reduce(DataFrame.unionByName, rows).withColumn("review_state", F.lit("abstain"))


def zoning_totals(rows: DataFrame, image: str) -> DataFrame:
    """AOIs with bands, aisles, entrances and unknown ground."""
    per = rows.groupBy(image).agg(*[F.count_if(F.col("object_type") == k).alias(k) for k in ("parking_band", "internal_aisle", "entrance_exit", "unknown_region")])
    return per.agg(F.count(F.lit(1)).alias("aois"), *[F.count_if(F.col(k) > 0).alias(f"with_{k}") for k in ("parking_band", "internal_aisle", "entrance_exit", "unknown_region")])


def candidate_packages(masks: DataFrame, blocks: DataFrame, *, minimum: int = MIN_COMPONENT_PX) -> DataFrame:
    """One row per block whose mask has components of the least size, with origin, grid, cell and counts."""
    from skyledger.functions.tiles import geo_cell

    kept = mk.retain_components(mk.merge_runs(masks, ["image"]), ["image"], minimum)
    stats = kept.groupBy("image").agg(F.countDistinct("component").alias("components"), F.sum(F.col("x1") - F.col("x0")).alias("area"))
    return blocks.join(stats, "image").withColumn("geo_cell", geo_cell(F.col("block_row"), F.col("block_col")))


def secondary_evidence(instances: DataFrame, candidate: DataFrame, *, image: str, kind: str) -> DataFrame:
    """Instance masks clipped to the candidate, merged per evidence kind: targets and area."""
    ground = mk.merge_runs(candidate, [image]).withColumnRenamed("x0", "g0").withColumnRenamed("x1", "g1")
    clipped = instances.join(ground, [image, "y"]).where((F.col("g0") < F.col("x1")) & (F.col("x0") < F.col("g1"))).select(
        image, kind, "target_id", "y", F.greatest("x0", "g0").alias("x0"), F.least("x1", "g1").alias("x1")
    )
    targets = clipped.select(image, kind, "target_id").distinct().groupBy(image, kind).agg(F.count(F.lit(1)).alias("targets"))
    area = mk.merge_runs(clipped, [image, kind]).groupBy(image, kind).agg(F.sum(F.col("x1") - F.col("x0")).alias("area"))
    return targets.join(area, [image, kind])
