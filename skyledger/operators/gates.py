"""Accept, reject or abstain: evidence gates over aggregated signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import boxes as bx

# Evidence kinds that can support a candidate and their least strengths.
SUPPORT_THRESHOLDS = {
    "parking_marking": 0.6,
    "vehicle_arrangement": 0.6,
    "entrance_connectivity": 0.6,
    "external_parking_map": 0.7,
    "surface_compatibility": 0.7,
}
DIRECT_KINDS = ("parking_marking", "vehicle_arrangement", "entrance_connectivity", "external_parking_map")
VEHICLE_PROMPTS = ("parked car", "parked vehicle", "vehicle in parking lot", "car in parking spot")


def fold_signals(signals: DataFrame, key: str = "candidate_id") -> DataFrame:
    """One row per candidate: strongest conflict and coverage, qualified kinds and the number of
    independence groups behind them. Signals are first reduced to one row per (candidate, kind,
    group), so a candidate with very many signals stays small."""
    slim = signals.groupBy(key, "kind", "independence_group").agg(F.max("strength").alias("strength"))
    qualified = F.lit(False)
    for kind, least in SUPPORT_THRESHOLDS.items():
        qualified = qualified | ((F.col("kind") == kind) & (F.col("strength") >= least))
    strongest = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("strength")))
    return slim.groupBy(key).agg(
        strongest("non_parking_conflict").alias("conflict"),
        strongest("exclusion_coverage").alias("coverage"),
        F.array_sort(F.collect_set(F.when(qualified, F.col("kind")))).alias("qualified_support"),
        F.countDistinct(F.when(qualified, F.col("independence_group"))).alias("support_groups"),
    )


def decide_candidates(candidates: DataFrame, folded: DataFrame, key: str = "candidate_id") -> DataFrame:
    """decision, reasons and qualified_support per candidate.

    Uses geometry_issues ARRAY<STRING> and, where present, fully_excluded and
    exclusions_authoritative BOOLEAN of the candidates.
    """
    rows = candidates.join(folded, key, "left")
    support = F.coalesce("qualified_support", F.array().cast("array<string>"))
    bad = F.coalesce(F.size("geometry_issues"), F.lit(0)) > 0
    conflict = F.coalesce(F.col("conflict") >= 0.9, F.lit(False))
    covered = F.coalesce(F.col("coverage") >= 0.8, F.lit(False))
    enough, apart = F.size(support) >= 2, F.coalesce(F.col("support_groups") >= 2, F.lit(False))
    direct = F.arrays_overlap(support, F.array(*[F.lit(k) for k in DIRECT_KINDS]))
    accept = covered & enough & apart & direct
    gaps = F.array_compact(F.array(
        F.when(~covered, "missing_exclusion_coverage"),
        F.when(~enough, "insufficient_independent_support").when(~apart, "support_not_independent"),
        F.when(~direct, "missing_structural_or_relational_support"),
    ))
    excluded = F.coalesce(F.col("fully_excluded"), F.lit(False)) if "fully_excluded" in candidates.columns else F.lit(False)
    firm = F.coalesce(F.col("exclusions_authoritative"), F.lit(True)) if "exclusions_authoritative" in candidates.columns else F.lit(True)
    none = F.array().cast("array<string>")
    decision = (
        F.when(excluded & firm, "auto_reject").when(excluded, "abstain").when(bad | conflict, "auto_reject")
        .when(accept, "auto_accept").otherwise("abstain")
    )
    reasons = (
        F.when(excluded & firm, F.array(F.lit("fully_excluded")))
        .when(excluded, F.array(F.lit("provisionally_fully_excluded")))
        .when(bad, F.transform("geometry_issues", lambda i: F.concat(F.lit("invalid_geometry:"), i)))
        .when(conflict, F.array(F.lit("strong_non_parking_conflict")))
        .when(accept, none)
        .otherwise(gaps)
    )
    return rows.select(
        *candidates.columns, decision.alias("decision"), reasons.alias("reasons"),
        F.when(excluded | bad | conflict, none).otherwise(support).alias("qualified_support"),
    )


def decision_counts(decisions: DataFrame, *keys: str) -> DataFrame:
    """Decisions per key (for example AOI) as one column per state."""
    states = ("auto_accept", "auto_reject", "abstain")
    return decisions.groupBy(*keys).agg(*[F.count_if(F.col("decision") == s).alias(s) for s in states])


def reason_counts(decisions: DataFrame) -> DataFrame:
    return decisions.select("decision", F.explode("reasons").alias("reason")).groupBy("decision", "reason").agg(
        F.count(F.lit(1)).alias("n")
    )


def vehicle_gate(rows: DataFrame, prompts: Sequence[str] = VEHICLE_PROMPTS) -> DataFrame:
    """Conservative three-way gate for vehicle labels.

    Needs the box columns, source_prompts, confidence, prompt_hits, edge, empty_mask, has_geometry,
    material_components, largest_component_fraction, mask_bbox_iou, first_iou and second_iou; missing
    numbers count as 0.
    """
    number = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    valid = bx.is_valid(bx.box())
    known = F.array(*[F.lit(p) for p in prompts])
    used = F.coalesce("source_prompts", F.array().cast("array<string>"))
    rejects = F.array_compact(F.array(
        F.when(~valid, "invalid_bbox"),
        F.when(F.coalesce("empty_mask", F.lit(False)), "empty_mask"),
        F.when(F.size(F.array_except(used, known)) > 0, "mixed_non_vehicle_prompt"),
    ))
    gaps = F.array_compact(F.array(
        F.when(~F.coalesce("has_geometry", F.lit(False)), "missing_mask_geometry"),
        F.when(number("material_components") != 1, "fragmented_or_merged_mask"),
        F.when(number("largest_component_fraction") < 0.95, "weak_component_dominance"),
        F.when(number("mask_bbox_iou") < 0.3, "mask_bbox_export_instability"),
        F.when(number("confidence") < 0.7, "sam_confidence_below_0_7"),
        F.when(number("prompt_hits") < 2, "single_prompt_only"),
        F.when(F.coalesce("edge", F.lit(False)), "image_edge"),
        F.when(valid & (bx.short_side(bx.box()) < 8), "below_8px_short_side"),
        F.when((number("first_iou") < 0.5) | (number("second_iou") < 0.5), "independent_model_disagreement"),
    ))
    decided = rows.withColumn("_r", rejects).withColumn("_g", gaps)
    return decided.select(
        *rows.columns,
        F.when(F.size("_r") > 0, "auto_reject").when(F.size("_g") > 0, "abstain").otherwise("auto_accept").alias("decision"),
        F.when(F.size("_r") > 0, F.col("_r")).when(F.size("_g") > 0, F.col("_g"))
        .otherwise(F.array(F.lit("all_high_purity_rules_passed"))).alias("reasons"),
    )


def gate_strata(decisions: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Decision counts per dimension=value, all dimensions in one pass."""
    from skyledger.operators.profiles import strata_counts

    states = ("auto_accept", "auto_reject", "abstain")
    return strata_counts(decisions, {d: d for d in dimensions}, **{s: F.count_if(F.col("decision") == s) for s in states})


def overlap_gate(rows: DataFrame, limit: float = 0.90) -> DataFrame:
    """Row-supported candidates are accepted, those mostly covered by exclusions rejected, others
    unknown. overlap_ratio is null unless both exclusion layers exist."""
    accepted = F.col("support_level") == "vehicle_row_supported"
    rejected = F.coalesce(F.col("overlap_ratio") >= limit, F.lit(False))
    return rows.withColumns({
        "gate_status": F.when(accepted, "accepted").when(rejected, "rejected").otherwise("unknown"),
        "gate_reason": F.when(accepted, "vehicle_row_supported").when(rejected, "building_or_vegetation_overlap").otherwise("insufficient_evidence"),
        "exclusion_overlap": F.round("overlap_ratio", 4),
    })


def direct_candidates(features: DataFrame) -> DataFrame:
    """Map candidates ready for export: abstaining, tagged as predictions; one without geometry is an error."""
    checked = F.when(F.col("geometry").isNull(), F.raise_error(F.lit("candidate geometry is missing"))).otherwise(F.col("geometry"))
    return features.withColumn("geometry", checked).withColumns({
        "object_type": F.lit("parking_facility_candidate"), "review_state": F.lit("abstain"),
        "truth_status": F.lit("model_prediction_not_ground_truth"),
    })


def anchors(rows: DataFrame, image_area: Column | float) -> DataFrame:
    """Anchor candidates: at most 5% of the image, and strong markings or two agreed vehicles."""
    area = F.col("area")
    return rows.where(
        (area > 0) & (area <= 0.05 * image_area)
        & ((F.coalesce("marking_strength", F.lit(0.0)) >= 0.6) | (F.coalesce("agreed_vehicles", F.lit(0)) >= 2))
    )


def issue_rows(summary: DataFrame, rules: Sequence[tuple[str, Column]], *keep: str) -> DataFrame:
    """The codes of failed rules of a small table of facts."""
    checks = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), code) for code, bad in rules]))
    return summary.select(*keep, F.explode(checks).alias("code"))
