"""Overlap profiles, best-overlap joins and detector agreement over box tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import boxes as bx
from skyledger.operators.components import components
from skyledger.operators.overlap import distinct_boxes, overlap_pairs, overlapping_any, touching_pairs
from skyledger.operators.resolve import match_one_to_one
from skyledger.session import cut


def _pairs_within(count: Column) -> Column:
    return (count * (count - 1) / 2).cast("bigint")


def overlap_profile(df: DataFrame, *, image: str, id_col: str, prompt: str, thresholds: Sequence[float]) -> DataFrame:
    """Per image and threshold: transitive overlap groups, groups with several members, groups and
    pairs that cross prompts, and matching pairs. Independent of input order.

    Exact copies of a box are collapsed first and counted by multiplicity, so a block of copies
    costs one row, not all its pairs.
    """
    per_prompt = df.groupBy(image, *bx.BOX, prompt).agg(F.min(id_col).alias("i"), F.count(F.lit(1)).alias("m"))
    nodes = cut(
        per_prompt.groupBy(image, *bx.BOX).agg(
            F.min("i").alias("id"),
            F.sum("m").alias("copies"),
            F.sum(_pairs_within(F.col("m"))).alias("same_prompt"),
            F.map_from_entries(F.collect_list(F.struct(prompt, "m"))).alias("by_prompt"),  # few prompts
        ),
        "nodes",
    )
    solid = bx.is_valid(bx.box())
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    pairs = cut(
        overlap_pairs(nodes, None, group=[image], id_col="id", min_iou=min(thresholds))
        .withColumn("threshold", F.explode(F.filter(levels, lambda t: F.col("iou") >= t)))
        .select("threshold", image, "a_id", "b_id"),
        "pairs",
    )
    # Pair counts: between different boxes, and among copies of one box.
    lean = nodes.select("id", "copies", "by_prompt")
    shared = F.aggregate(
        F.map_keys("a.by_prompt"), F.lit(0).cast("bigint"),
        lambda acc, p: acc + F.element_at("a.by_prompt", p) * F.coalesce(F.try_element_at(F.col("b.by_prompt"), p), F.lit(0)),
    )
    between = (
        pairs.join(lean.alias("a"), F.col("a_id") == F.col("a.id"))
        .join(lean.alias("b"), F.col("b_id") == F.col("b.id"))
        .select("threshold", image, (F.col("a.copies") * F.col("b.copies")).alias("pairs"), shared.alias("same"))
    )
    spread = nodes.where(solid).withColumn("threshold", F.explode(levels))
    among = spread.where(F.col("copies") > 1).select(
        "threshold", image, _pairs_within(F.col("copies")).alias("pairs"), F.col("same_prompt").alias("same")
    )
    matches = between.unionByName(among).groupBy("threshold", image).agg(
        F.sum("pairs").alias("pair_matches"), F.sum(F.col("pairs") - F.col("same")).alias("cross_prompt_pairs")
    )
    # Groups: components over (threshold, box).
    node = lambda c: F.struct("threshold", F.col(c).alias("id"))
    linked = components(pairs.select(image, node("a_id").alias("a"), node("b_id").alias("b")), "a", "b", near=[image])
    grouped = (
        spread.withColumn("node", node("id"))
        .join(linked, "node", "left")
        .select("threshold", image, F.coalesce(F.col("component.id"), F.col("id")).alias("g"), "copies", "by_prompt")
    )
    prompts = (
        grouped.select("threshold", image, "g", F.explode(F.map_keys("by_prompt")).alias("p")).distinct()
        .groupBy("threshold", image, "g").agg(F.count(F.lit(1)).alias("prompts"))
    )
    groups = (
        grouped.groupBy("threshold", image, "g").agg(F.sum("copies").alias("n"))
        .join(prompts, ["threshold", image, "g"])
        .groupBy("threshold", image)
        .agg(
            F.count(F.lit(1)).alias("solid_groups"),
            F.count_if(F.col("n") > 1).alias("multi_candidate_groups"),
            F.count_if(F.col("prompts") > 1).alias("cross_prompt_groups"),
        )
    )
    flat = (
        nodes.withColumn("threshold", F.explode(levels)).groupBy("threshold", image)
        .agg(F.sum("copies").alias("candidates"), F.sum(F.when(~solid, F.col("copies")).otherwise(0)).alias("flat_groups"))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return (
        flat.join(groups, ["threshold", image], "left").join(matches, ["threshold", image], "left")
        .select(
            "threshold", image, "candidates",
            (F.coalesce("solid_groups", F.lit(0)) + F.col("flat_groups")).cast("bigint").alias("groups"),
            zero("multi_candidate_groups"), zero("cross_prompt_groups"), zero("pair_matches"), zero("cross_prompt_pairs"),
        )
    )


PROFILE_COUNTS = (
    "candidates", "groups", "multi_candidate_groups", "cross_prompt_groups", "pair_matches", "cross_prompt_pairs",
)


def profile_totals(profile: DataFrame) -> DataFrame:
    """Dataset totals per threshold with the number and share of candidates the grouping removes."""
    totals = profile.groupBy("threshold").agg(*[F.sum(c).alias(c) for c in PROFILE_COUNTS])
    return totals.withColumn("collapsed_candidates", F.col("candidates") - F.col("groups")).withColumn(
        "collapsed_fraction", F.col("collapsed_candidates") / F.col("candidates")
    )


def best_overlaps(targets: DataFrame, detections: DataFrame, *, image: str, id_col: str, cell: float):
    """Best IoU of every distinct target and detection box, 0 when it meets none, with copy counts
    and, for detections, the number of targets at IoU >= 0.5."""
    t = cut(distinct_boxes(targets, [image], id_col), "targets")
    d = cut(distinct_boxes(detections, [image], id_col), "detections")
    pairs = cut(touching_pairs(t, d, group=[image], id_col=id_col, cell=cell), "overlaps")
    best_t = pairs.groupBy(F.col("a_id").alias(id_col)).agg(F.max("iou").alias("best_iou"))
    weights = t.select(F.col(id_col).alias("a_id"), F.col("copies").alias("w"))
    best_d = (
        pairs.join(weights, "a_id").groupBy(F.col("b_id").alias(id_col))
        .agg(F.max("iou").alias("best_iou"), F.sum(F.when(F.col("iou") >= 0.5, F.col("w")).otherwise(0)).alias("hits"))
    )
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    target_best = t.join(best_t, id_col, "left").select(image, id_col, *bx.BOX, "copies", zero("best_iou", 0.0))
    detection_best = d.join(best_d, id_col, "left").select(image, id_col, "copies", zero("best_iou", 0.0), zero("hits", 0))
    return target_best, detection_best


def agreement_counts(target_best: DataFrame, detection_best: DataFrame, *, image: str) -> DataFrame:
    """Per image: matched targets at 0.3 and 0.5, unmatched detections, detections on several targets."""
    count = lambda cond: F.sum(F.when(cond, F.col("copies")).otherwise(0))
    t = target_best.groupBy(image).agg(
        F.sum("copies").alias("targets"),
        count(F.col("best_iou") >= 0.3).alias("targets_matched_at_0_3"),
        count(F.col("best_iou") >= 0.5).alias("targets_matched_at_0_5"),
    )
    d = detection_best.groupBy(image).agg(
        F.sum("copies").alias("detections"),
        count(F.col("best_iou") < 0.3).alias("detections_unmatched_at_0_3"),
        count(F.col("hits") > 1).alias("detections_with_multiple_targets_at_0_5"),
    )
    joined = t.join(d, image, "full")
    return joined.select(image, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in joined.columns if c != image])


def agreed_detections(first: DataFrame, second: DataFrame, *, image: str, id_col: str, confidence: str,
                      min_iou: float = 0.3, ties: str = "largest") -> DataFrame:
    """One-to-one matches of two detectors with the averaged box and both confidences."""
    pairs = overlap_pairs(first, second, group=[image], id_col=id_col, min_iou=min_iou)
    matched = match_one_to_one(pairs, ties=ties)
    sides = []
    for df, key, p in ((first, "a_id", "f_"), (second, "b_id", "s_")):
        sides.append(df.select(F.col(id_col).alias(key), *[F.col(c).alias(p + c) for c in (*bx.BOX, confidence)]))
    return (
        matched.join(sides[0], "a_id").join(sides[1], "b_id")
        .select(
            image, F.col("a_id").alias("first_id"), F.col("b_id").alias("second_id"),
            *[((F.col("f_" + c) + F.col("s_" + c)) / 2).alias(c) for c in bx.BOX],
            F.col("iou").alias("agreement_iou"),
            F.col("f_" + confidence).alias("first_confidence"), F.col("s_" + confidence).alias("second_confidence"),
        )
    )


def line_evidence(targets: DataFrame, *, image: str, id_col: str, has_lines: str, cell: float, ratio: float = 0.5) -> DataFrame:
    """direct_has_lines, adjacent_to_lines (the grown box strictly overlaps the grown box of a target
    with lines in the same image) or no_line_evidence, and the label it leads to."""
    grown = targets.select(
        image, id_col, has_lines, *[c.alias(n) for c, n in zip(bx.expand(bx.box(), ratio), bx.BOX)]
    )
    lines = grown.where(F.col(has_lines))
    near = overlapping_any(grown.where(~F.coalesce(F.col(has_lines), F.lit(False))), lines, group=[image], id_col=id_col, cell=cell)
    evidence = F.when(F.col(has_lines), "direct_has_lines").when(
        F.col("near"), "adjacent_to_lines"
    ).otherwise("no_line_evidence")
    return targets.join(near.select(id_col, F.lit(True).alias("near")), id_col, "left").select(
        *targets.columns, evidence.alias("evidence"),
        F.when(evidence == "no_line_evidence", "reject").otherwise("accept").alias("line_label"),
    )


def assign_spaces(spaces: DataFrame, detections: DataFrame, *, image: str, space_id: str, det_id: str,
                  state: Column, confidence: str, cell: float, min_iou: float = 0.30, min_score: float = 0.65) -> DataFrame:
    """The state of each fixed space from its best detection by (IoU, score); unknown when the best
    is below either limit. A space that meets no detection shows the image's best score."""
    pairs = touching_pairs(spaces, detections, group=[image], id_col=space_id, right_id=det_id, cell=cell)
    scored = detections.select(F.col(det_id).alias("b_id"), F.col(confidence).alias("score"), state.alias("state"))
    best = (
        pairs.join(scored, "b_id")
        .groupBy(F.col("a_id").alias(space_id))
        .agg(F.max_by(F.struct("iou", "score", "state"), F.struct("iou", "score", "b_id")).alias("m"))
    )
    fallback = detections.groupBy(image).agg(F.max(confidence).alias("top"))
    sure = (F.col("m.iou") >= min_iou) & (F.col("m.score") >= min_score)
    return (
        spaces.join(best, space_id, "left").join(fallback, image, "left")
        .select(
            *spaces.columns,
            F.when(sure, F.col("m.state")).otherwise("unknown").alias("state"),
            F.coalesce(F.col("m.score"), F.col("top"), F.lit(0.0)).alias("score"),
            F.coalesce(F.col("m.iou"), F.lit(0.0)).alias("iou"),
        )
    )


def one_of(column: str, values: Sequence[str]) -> Column:
    return F.col(column).isin(list(values))
