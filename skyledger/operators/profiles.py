"""Counting profiles: histograms, strata, inventories and model comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import boxes as bx


def keep_confident(df: DataFrame, min_confidence: float, confidence: str = "confidence") -> DataFrame:
    """Rows at or above the minimum; a missing confidence passes."""
    return df.where(F.col(confidence).isNull() | (F.col(confidence) >= min_confidence))


def class_histogram(df: DataFrame, *, min_confidence: float, only: Sequence[str] = (), confidence: str = "confidence") -> DataFrame:
    """Raw and kept counts per class, most frequent first."""
    if only:
        df = df.where(F.col("class_name").isin(list(only)))
    kept = F.col(confidence).isNull() | (F.col(confidence) >= min_confidence)
    return (
        df.groupBy("class_name").agg(F.count(F.lit(1)).alias("raw"), F.count_if(kept).alias("kept"))
        .orderBy(F.desc("kept"), "class_name")
    )


def prompt_profile(df: DataFrame, *, width: float, height: float) -> DataFrame:
    """Per prompt: images, targets, invalid and edge-touching boxes and short-side buckets."""
    b = bx.box()
    valid, side = bx.is_valid(b), bx.short_side(b)
    count = lambda cond: F.count_if(valid & cond)
    return df.groupBy("prompt").agg(
        F.countDistinct("image_id").alias("images_with_targets"),
        F.count(F.lit(1)).alias("targets"),
        count(bx.touches_edge(b, width, height)).alias("edge_touching"),
        F.count_if(~valid).alias("invalid_bbox"),
        F.count("confidence").alias("with_confidence"),
        count(side < 16).alias("size_lt_16"),
        count((side >= 16) & (side < 32)).alias("size_16_32"),
        count((side >= 32) & (side < 64)).alias("size_32_64"),
        count(side >= 64).alias("size_ge_64"),
    )


def strata_counts(df: DataFrame, dimensions: Mapping[str, str], **aggs: Column) -> DataFrame:
    """One pass over several single dimensions: (dimension, value) with the given aggregates."""
    pairs = F.array(*[
        F.struct(F.lit(name).alias("dimension"), F.col(c).cast("string").alias("value")) for name, c in dimensions.items()
    ])
    rows = df.withColumn("_d", F.explode(pairs))
    return rows.groupBy("_d.dimension", "_d.value").agg(*[a.alias(n) for n, a in aggs.items()])


def filter_reproduction(evidence: DataFrame, state: DataFrame, *, id_col: str) -> DataFrame:
    """How often the recorded label agrees with what the line filter would decide."""
    kept = F.col("evidence") != "no_line_evidence"
    yes, no = F.col("label") == "accept", F.col("label") == "reject"
    return (
        evidence.join(state.withColumnRenamed("target_id", id_col), id_col, "left")
        .groupBy("evidence")
        .agg(
            F.count(F.lit(1)).alias("targets"), F.count("label").alias("labelled"),
            F.count_if((yes & kept) | (no & ~kept)).alias("reproduced"),
            F.count_if((yes & ~kept) | (no & kept)).alias("mismatched"),
        )
    )


def inventory(merged: DataFrame, state: DataFrame, prompts: Sequence[str]) -> DataFrame:
    """Merged targets by whether they come from the given prompts only, partly or not at all, with
    the review state of the related ones."""
    wanted = F.array(*[F.lit(p) for p in prompts])
    related = F.arrays_overlap("source_prompts", wanted)
    only = related & (F.size(F.array_except("source_prompts", wanted)) == 0)
    rows = merged.join(state.select("target_id", "label", "source", "is_auto"), "target_id", "left")
    count = lambda cond: F.count_if(related & cond)
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(related).alias("vehicle_related"), F.count_if(only).alias("vehicle_only"),
        count(~only).alias("mixed"), count(F.col("prompt_hits") == 1).alias("one_prompt"),
        count(F.col("prompt_hits") > 1).alias("many_prompts"), count(F.col("label") == "accept").alias("labelled_accept"),
        count(F.col("is_auto")).alias("auto"), count(F.col("source") == "human").alias("by_human"),
        count(F.col("label").isNull()).alias("missing_state"),
    )


def model_box_stats(df: DataFrame, *, image_area: float, large_share: float = 0.03) -> DataFrame:
    """Per model and class: detections, boxes above a share of the image, mean confidence."""
    return df.groupBy("model", "class_name").agg(
        F.count(F.lit(1)).alias("detections"),
        F.count_if(bx.area(bx.box()) / image_area > large_share).alias("large_boxes"),
        F.round(F.avg("confidence"), 4).alias("mean_confidence"),
    )


def side_by_side(*frames: DataFrame) -> DataFrame:
    """One-row tables as one wide row, without a cross join."""
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])
