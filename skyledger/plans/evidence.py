"""Evidence jobs: image evidence to signals, signals to decisions, AOI candidates from an index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions import boxes as bx
from skyledger.functions import tiles as tl
from skyledger.operators.arrangement import vehicle_arrangement
from skyledger.operators.masks import merge_runs
from skyledger.operators.sampling import aoi_strata


def image_evidence(agreed: DataFrame, candidates: DataFrame, *, image: str, mask: str, id_col: str) -> DataFrame:
    """Per candidate mask: agreed vehicles whose centre lies on it and the strength of their
    arrangement. Candidates without vehicles count 0."""
    runs = merge_runs(candidates, [image, mask])
    centre = lambda a, b: F.rint((F.col(a) + F.col(b)) / 2).cast("bigint")
    spots = agreed.withColumns({"y": centre("y1", "y2"), "_px": centre("x1", "x2")})
    inside = spots.join(runs.withColumnRenamed("x0", "r0").withColumnRenamed("x1", "r1"), [image, "y"]).where(
        (F.col("_px") >= F.col("r0")) & (F.col("_px") < F.col("r1"))
    )
    boxes = inside.select(F.struct(image, mask).alias("candidate"), id_col, *bx.BOX)
    scored = vehicle_arrangement(boxes, "candidate", id_col).select(
        F.col(f"candidate.{image}").alias(image), F.col(f"candidate.{mask}").alias(mask), "vehicle_count", "strength"
    )
    every = candidates.select(image, mask).distinct()
    return every.join(scored, [image, mask], "left").na.fill(0, ["vehicle_count"]).na.fill(0.0, ["strength"])


def evidence_signals(evidence: DataFrame, *, candidate: str) -> DataFrame:
    """Signal rows for the candidate gate: marking and vehicle arrangement strengths, each with its
    source and independence group. `evidence` may carry marking_strength."""
    marking = F.coalesce("marking_strength", F.lit(0.0)) if "marking_strength" in evidence.columns else F.lit(0.0)
    signal = lambda kind, source, group, strength: F.struct(
        F.lit(kind).alias("kind"), F.lit(source).alias("source_id"), F.lit(group).alias("independence_group"), strength.alias("strength")
    )
    both = F.array(
        signal("parking_marking", "parallel_lines", "classical_image_geometry", marking),
        signal("vehicle_arrangement", "two_detectors", "vehicle_detectors", F.col("strength")),
    )
    return evidence.select(F.col(candidate).alias("candidate_id"), F.explode(both).alias("s")).select("candidate_id", "s.*")


def aoi_candidates(index: DataFrame, state: DataFrame, metrics: DataFrame, negative: Sequence[str], size: int = 1024) -> DataFrame:
    """One row per block image of a target index: origin, grid, geo cell, distinct strata and the
    number of targets. Images with other names are left out."""
    rows = index.where(tl.is_block(F.col("image"))).withColumn("block", tl.block_fields(F.col("image")))
    facts = rows.join(state.select("target_id", "label"), "target_id", "left").join(
        metrics.select("target_id", "valid_components", "global_obb_area_ratio"), "target_id", "left"
    )
    strata = aoi_strata(
        F.col("valid_components"), F.col("global_obb_area_ratio"), F.coalesce("label", F.lit("unreviewed")), bx.box(), negative, size=size
    )
    # Strata are few; they are reduced to distinct ones per image before they are collected.
    flat = facts.select("image", "block", F.explode(strata).alias("stratum"))
    small = flat.groupBy("image", "block", "stratum").agg(F.count(F.lit(1)).alias("n"))
    return small.groupBy("image", "block").agg(
        F.array_sort(F.collect_set("stratum")).alias("strata"), F.max(F.when(F.col("stratum") == "geo_spread", F.col("n"))).alias("targets")
    ).select(
        F.regexp_replace("image", r"\.[^.]+$", "").alias("aoi_id"), "image", "strata", "targets",
        tl.geo_cell(F.col("block.block_row"), F.col("block.block_col")).alias("geo_cell"),
        F.struct("block.zoom", "block.tile_row", "block.tile_col").alias("tile_origin"),
    )


def evidence_package(selected: DataFrame, targets: DataFrame, key: str = "aoi_id") -> DataFrame:
    """One JSON text per (AOI, target) of a selection, ready for the JSON-lines sink; targets stay one
    per line, so an AOI with very many targets is no single row."""
    rows = selected.join(targets, key)
    return rows.select(key, F.to_json(F.struct(*rows.columns)).alias("value"))
