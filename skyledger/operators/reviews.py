"""Review logs and states: last write wins, filters, overviews and export eligibility."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.operators.ordered import keep_last, ordered_scan


def latest_state(log: DataFrame, *, key: str, order: Sequence[str]) -> DataFrame:
    """The last record per key of an append-only log. Records without a key are ignored."""
    return keep_last(log.where(F.col(key).isNotNull()), [key], order)


# Review labels by what they mean for export.
POSITIVE_LABELS = ("accept", "hard_positive")
NEGATIVE_LABELS = ("hard_negative", "empty_ok")
SKIP_LABELS = ("reject", "bad_mask", "needs_review")


def target_index(results: DataFrame, images: DataFrame | None = None, masks: DataFrame | None = None) -> DataFrame:
    """Explode per-image results into one row per target.

    The id is the target's own source_target_id or image::position, the overlay name is md5(id).jpg,
    a single source_prompt becomes a one-element list, prompt_hits defaults to the number of
    prompts. Images without targets, or not in `images`, are dropped; mask_missing marks mask files
    that are not in `masks`.
    """
    rows = results.where(F.col("image").isNotNull() & (F.size("targets") > 0))
    if images is not None:
        rows = rows.join(images, "image", "left_semi")
    rows = rows.select("image", "prompt_mode", F.posexplode("targets").alias("target_index", "t"))
    single = F.when(F.coalesce("t.source_prompt", F.lit("")) != "", F.array("t.source_prompt"))
    listed = F.when(F.size("t.source_prompts") > 0, F.col("t.source_prompts"))
    prompts = F.coalesce(listed, single)
    tid = F.coalesce(
        F.when(F.col("t.source_target_id") != "", F.col("t.source_target_id")),
        F.concat_ws("::", "image", F.col("target_index").cast("string")),
    )
    index = rows.select(
        tid.alias("target_id"), "image", "target_index", "t.class_name", "t.confidence", "t.bbox", "t.mask_file",
        F.concat(F.md5(tid), F.lit(".jpg")).alias("overlay_file"), prompts.alias("source_prompts"),
        F.when(listed.isNotNull(), F.coalesce("t.prompt_hits", F.size(listed))).when(single.isNotNull(), 1).alias("prompt_hits"),
        F.when(F.coalesce("prompt_mode", F.lit("joined")) != "joined", F.col("prompt_mode")).alias("prompt_mode"),
    )
    if masks is None:
        return index.withColumn("mask_missing", F.lit(False))
    found = masks.select("mask_file").distinct().withColumn("_found", F.lit(True))
    return index.join(found, "mask_file", "left").withColumn(
        "mask_missing", F.col("mask_file").isNotNull() & F.col("_found").isNull()
    ).drop("_found")


def with_state(index: DataFrame, state: DataFrame, columns: Sequence[str] = ("label", "source", "is_auto")) -> DataFrame:
    """Index rows with their current review, label '' when there is none."""
    joined = index.join(state.select("target_id", *columns), "target_id", "left")
    return joined.withColumn("label", F.coalesce("label", F.lit("")))


def filter_targets(
    reviewed: DataFrame,
    mode: str = "all",
    *,
    object_type: str | None = None,
    issue_type: str | None = None,
    verifiable: bool | None = None,
    min_prompt_hits: int = 0,
    min_confidence: float = 0.0,
) -> DataFrame:
    """Review list for a mode (all, unreviewed or a label) and optional equality and minimum filters."""
    keep: list[Column] = []
    if mode == "unreviewed":
        keep.append(F.col("label") == "")
    elif mode != "all":
        keep.append(F.col("label") == mode)
    if object_type:
        keep.append(F.coalesce("object_type", F.lit("")) == object_type)
    if issue_type:
        keep.append(F.coalesce("issue_type", F.lit("")) == issue_type)
    if verifiable is not None:
        keep.append(F.coalesce("verifiable", F.lit(False)) == F.lit(verifiable))
    if min_prompt_hits:
        keep.append(F.coalesce("prompt_hits", F.lit(0)) >= min_prompt_hits)
    if min_confidence:
        keep.append(F.coalesce("confidence", F.lit(0.0)) >= min_confidence)
    for condition in keep:
        reviewed = reviewed.where(condition)
    return reviewed


def list_positions(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """0-based position of every row in a filtered list, without sorting it in one task."""
    return ordered_scan(rows, [], order, rank="position").withColumn("position", F.col("position") - 1)


def prefetch(positions: DataFrame, cursor: int, radius: int) -> DataFrame:
    """Items within radius of the cursor, the cursor itself left out."""
    at = F.col("position")
    return positions.where(at.between(cursor - radius, cursor + radius) & (at != cursor))


def sibling_jumps(positions: DataFrame, index: DataFrame, current: DataFrame) -> DataFrame:
    """For each current target, the targets of the same image and their place in the filtered list
    (null when the filter hides them)."""
    here = current.select(F.col("target_id").alias("current_id"), "image")
    jumps = positions.select("target_id", F.col("position").alias("jump"))
    return here.join(index.select("target_id", "image"), "image").join(jumps, "target_id", "left")


def warm_up_order(positions: DataFrame, *, cursor: int, window: int, direction: int = 1, predicted: Sequence[str] = ()) -> DataFrame:
    """Preparation order: predicted items, then the window ahead, the window behind, the rest; items
    without a review first, then the nearest to the cursor. Adds tier and distance to sort by."""
    step = (F.col("position") - cursor) * (direction or 1)
    tier = F.when(step.between(0, window), 1).when((step >= -window) & (step < 0), 2).otherwise(3)
    if predicted:
        tier = F.when(F.col("target_id").isin(list(predicted)), 0).otherwise(tier)
    return positions.withColumns({
        "tier": tier, "reviewed": F.when(F.col("label") == "", 0).otherwise(1), "distance": F.abs(F.col("position") - cursor),
    })


def eligible_for_auto(reviewed: DataFrame, *, min_confidence: float, min_hits: int) -> DataFrame:
    """Targets without a label that clear both minimums; a missing confidence is 0, missing hits are 1."""
    return reviewed.where(
        (F.col("label") == "")
        & (F.coalesce("confidence", F.lit(0.0)) >= min_confidence)
        & (F.coalesce("prompt_hits", F.lit(1)) >= min_hits)
    )


def value_domain(state: DataFrame, column: str) -> DataFrame:
    """Distinct values that are not empty, for a filter list."""
    return state.where(F.coalesce(column, F.lit("")) != "").select(F.col(column).alias("value")).distinct()


def overview(reviewed: DataFrame, *, min_confidence: float, min_hits: int, machine_sources: Sequence[str]) -> DataFrame:
    """Totals of a run in one pass."""
    labelled = F.col("label") != ""
    machine = labelled & (F.coalesce(F.col("source").isin(list(machine_sources)), F.lit(False)) | F.coalesce("is_auto", F.lit(False)))
    eligible = F.col("confidence").isNotNull() & (F.col("confidence") >= min_confidence - 1e-9) & (
        F.coalesce("prompt_hits", F.lit(1)) >= min_hits
    )
    return reviewed.agg(
        F.count(F.lit(1)).alias("target_count"), F.count_if(labelled).alias("reviewed_count"),
        F.count_if(eligible).alias("eligible"), F.count_if(~eligible).alias("filtered_out"),
        F.count_if(machine).alias("machine_reviewed"), F.count_if(labelled & ~machine).alias("human_reviewed"),
    )


def image_eligibility(reviewed: DataFrame) -> DataFrame:
    """Per image whether it may be exported: nothing unreviewed or skipped, and a positive target
    with a mask or a negative label."""
    label = F.col("label")
    positive = label.isin(list(POSITIVE_LABELS)) & F.col("mask_file").isNotNull()
    return reviewed.groupBy("image").agg(
        F.count(F.lit(1)).alias("targets"),
        F.count_if(positive).alias("positives"),
        (
            ~F.bool_or((label == "") | label.isin(list(SKIP_LABELS)))
            & F.bool_or(positive | label.isin(list(NEGATIVE_LABELS)))
        ).alias("exportable"),
    )


def export_targets(reviewed: DataFrame, classes: DataFrame, *, require: dict[str, object] | None = None,
                   exclude: Sequence[str] = (), class_column: str = "class_name") -> DataFrame:
    """Positive targets with masks of exportable images, with class ids. The class is class_column
    (for example a semantic field), else class_name; require holds equality conditions. A class that
    is not registered is an error."""
    images = image_eligibility(reviewed).where("exportable").select("image")
    rows = reviewed.where(F.col("label").isin(list(POSITIVE_LABELS)) & F.col("mask_file").isNotNull())
    for name, value in (require or {}).items():
        rows = rows.where(F.col(name).eqNullSafe(F.lit(value)))
    chosen = F.coalesce(F.when(F.col(class_column) != "", F.col(class_column)), F.col("class_name"))
    rows = rows.withColumn("export_class", chosen).where(F.col("export_class").isNotNull())
    if exclude:
        rows = rows.where(~F.col("export_class").isin(list(exclude)))
    rows = rows.join(images, "image", "left_semi")
    known = classes.select(F.col("class_name").alias("export_class"), "class_id")
    rows = rows.join(known, "export_class", "left")
    checked = F.when(
        F.col("class_id").isNull(), F.raise_error(F.concat(F.lit("class is not registered: "), F.col("export_class")))
    ).otherwise(F.col("class_id"))
    return rows.withColumn("class_id", checked)


def discover_classes(reviewed: DataFrame, *, exclude: Sequence[str] = (), column: str = "class_name") -> DataFrame:
    """Sorted distinct classes of positive targets with ids from 0."""
    rows = reviewed.where(F.col("label").isin(list(POSITIVE_LABELS)) & (F.coalesce(column, F.lit("")) != ""))
    if exclude:
        rows = rows.where(~F.col(column).isin(list(exclude)))
    names = rows.select(F.col(column).alias("class_name")).distinct()
    # The list of classes is small by nature: it becomes the model's class list.
    ordered = names.agg(F.array_sort(F.collect_set("class_name")).alias("names"))
    return ordered.select(F.posexplode("names").alias("class_id", "class_name"))


def without_auto(log: DataFrame) -> DataFrame:
    """The log after a reset: machine records removed."""
    return log.where(~F.coalesce("is_auto", F.lit(False)))


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs whose key has no finished output yet."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def progress(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Total, finished and remaining inputs in one pass over a left join."""
    flag = done.select(key).distinct().withColumn("_done", F.lit(True))
    return inputs.join(flag, key, "left").agg(
        F.count(F.lit(1)).alias("total"), F.count("_done").alias("done"), F.count_if(F.col("_done").isNull()).alias("remaining")
    )


def import_candidates(candidates: DataFrame, state: DataFrame) -> DataFrame:
    """Labels of imported candidates. Existing labels are kept; accepted status or vehicle-row support
    is an accept, rejected status a reject, everything else stays open; missing_inputs marks
    candidates whose image or mask is absent."""
    present = F.col("has_image") & F.col("has_mask")
    gate = F.when(
        (F.col("gate_status") == "accepted") | (F.col("support_level") == "vehicle_row_supported"), "accept"
    ).when(F.col("gate_status") == "rejected", "reject")
    joined = candidates.join(state.select("target_id", F.col("label").alias("existing")), "target_id", "left")
    return joined.select(
        *candidates.columns, (~present).alias("missing_inputs"), F.col("existing").isNotNull().alias("kept_existing"),
        F.when(present, F.coalesce("existing", gate)).alias("label"),
    )


def attach_results(assets: DataFrame, results: DataFrame, *, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Assets with the latest result of each, null where there is none."""
    from skyledger.operators.ordered import keep_last

    return assets.join(keep_last(results, list(key), order), list(key), "left")
