"""Review log, index and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators import reviews as rv
from skyledger.workloads.bindings import cte
from skyledger.workloads.registry import workload

SEM = ("label", "source", "is_auto", "object_type", "issue_type", "verifiable")
ST = (
    f"WITH {cte('index', 'log')}, st AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY noted DESC, rec_id DESC) = 1), "
    "rev AS (SELECT i.*, coalesce(st.label, '') AS label, st.source, st.is_auto, st.object_type, st.issue_type, st.verifiable FROM index i LEFT JOIN st USING (target_id)) "
).replace("index AS (", '"index" AS (').replace("FROM index i", 'FROM "index" i')


def _state(t):
    return rv.latest_state(t.log, key="target_id", order=["noted", "rec_id"])


def _reviewed(t):
    return rv.with_state(t.index, _state(t), SEM)


@workload("latest_reviews", "W1 D5", f"{ST} SELECT target_id, rec_id, label, source, is_auto FROM st")
def _(t):
    return _state(t).select("target_id", "rec_id", "label", "source", "is_auto")


@workload(
    "filtered_targets", "F2 J9",
    f"{ST} SELECT target_id, image, label FROM rev WHERE label = 'accept' AND object_type = 'car' AND coalesce(prompt_hits, 0) >= 1 AND coalesce(confidence, 0) >= 0.2",
)
def _(t):
    rows = rv.filter_targets(_reviewed(t), "accept", object_type="car", min_prompt_hits=1, min_confidence=0.2)
    return rows.select("target_id", "image", "label").orderBy("target_id")


@workload(
    "filtered_unverifiable", "F2",
    f"{ST} SELECT target_id, issue_type FROM rev WHERE issue_type = 'blurred' AND coalesce(verifiable, false) = false",
)
def _(t):
    return rv.filter_targets(_reviewed(t), issue_type="blurred", verifiable=False).select("target_id", "issue_type")


@workload("auto_review_pending", "F8", f"{ST} SELECT target_id FROM rev WHERE label = '' AND coalesce(confidence, 0) >= 0.3 AND coalesce(prompt_hits, 1) >= 2")
def _(t):
    return rv.eligible_for_auto(_reviewed(t), min_confidence=0.3, min_hits=2).select("target_id")


@workload(
    "semantic_values", "F9",
    f"{ST} SELECT 'object_type' AS field, object_type AS value FROM st WHERE object_type <> '' GROUP BY ALL UNION ALL SELECT 'issue_type', issue_type FROM st WHERE issue_type <> '' GROUP BY ALL",
)
def _(t):
    state = _state(t)
    parts = [rv.value_domain(state, c).select(F.lit(c).alias("field"), "value") for c in ("object_type", "issue_type")]
    return parts[0].unionByName(parts[1]).orderBy("field", "value")


@workload(
    "review_overview", "A14",
    f"{ST} SELECT count(*) AS target_count, count(*) FILTER (label <> '') AS reviewed_count, count(*) FILTER (confidence >= 0.3 - 1e-9 AND coalesce(prompt_hits, 1) >= 2) AS eligible, "
    "count(*) - count(*) FILTER (confidence >= 0.3 - 1e-9 AND coalesce(prompt_hits, 1) >= 2) AS filtered_out, "
    "count(*) FILTER (label <> '' AND (source = 'machine' OR is_auto)) AS machine_reviewed, count(*) FILTER (label <> '' AND NOT (source = 'machine' OR is_auto)) AS human_reviewed FROM rev",
)
def _(t):
    return rv.overview(_reviewed(t), min_confidence=0.3, min_hits=2, machine_sources=["machine"])


@workload("label_counts", "A14", f"{ST} SELECT label, count(*) AS n FROM rev WHERE label <> '' GROUP BY label")
def _(t):
    return _reviewed(t).where(F.col("label") != "").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


ELIG = (
    ST + ", el AS (SELECT image, count(*) AS targets, count(*) FILTER (label IN ('accept', 'hard_positive') AND mask_file IS NOT NULL) AS positives, "
    "NOT bool_or(label IN ('', 'reject', 'bad_mask', 'needs_review')) AND bool_or(label IN ('accept', 'hard_positive') AND mask_file IS NOT NULL OR label IN ('hard_negative', 'empty_ok')) AS exportable FROM rev GROUP BY image) "
)


@workload("exportable_images", "A37", ELIG + "SELECT * FROM el")
def _(t):
    return rv.image_eligibility(_reviewed(t))


CLS = ", cls AS (SELECT row_number() OVER (ORDER BY class_name) - 1 AS class_id, class_name FROM (SELECT DISTINCT class_name FROM rev WHERE label IN ('accept', 'hard_positive') AND class_name <> 'van')) "


@workload("export_classes", "F11", ST + CLS + "SELECT class_id::INTEGER AS class_id, class_name FROM cls")
def _(t):
    return rv.discover_classes(_reviewed(t), exclude=["van"])


EXPORT = (
    ELIG + CLS + ", ex AS (SELECT rev.target_id, image, class_name, class_id::INTEGER AS class_id, source, is_auto FROM rev JOIN cls USING (class_name) WHERE label IN ('accept', 'hard_positive') "
    "AND mask_file IS NOT NULL AND image IN (SELECT image FROM el WHERE exportable) AND class_name <> 'van' AND verifiable IS NOT DISTINCT FROM true) "
)


def _exported(t):
    reviewed = _reviewed(t)
    return rv.export_targets(reviewed, rv.discover_classes(reviewed, exclude=["van"]), require={"verifiable": True}, exclude=["van"])


@workload("export_targets", "F10 A37 J9", EXPORT + "SELECT target_id, image, class_name, class_id FROM ex")
def _(t):
    return _exported(t).select("target_id", "image", "class_name", "class_id")


_SPLIT = "CASE WHEN ('0x' || substr(md5(image), 1, 8))::BIGINT / 4294967295.0::DOUBLE < 0.8 THEN 'train' WHEN ('0x' || substr(md5(image), 1, 8))::BIGINT / 4294967295.0::DOUBLE < 0.9 THEN 'val' ELSE 'test' END"


@workload(
    "export_statistics", "A36 P12",
    EXPORT + f"SELECT {_SPLIT} AS split, count(DISTINCT image) AS images, count(*) AS objects, count(*) FILTER (is_auto) AS auto, count(*) FILTER (NOT is_auto) AS human FROM ex GROUP BY ALL",
)
def _(t):
    from skyledger.functions.keys import stable_split

    return _exported(t).groupBy(stable_split(F.col("image")).alias("split")).agg(
        F.countDistinct("image").alias("images"), F.count(F.lit(1)).alias("objects"),
        F.count_if("is_auto").alias("auto"), F.count_if(~F.col("is_auto")).alias("human"),
    )


@workload(
    "missing_fixed_tests", "A36 J15",
    EXPORT + ", fixed AS (SELECT concat('img_', CAST(c_custkey AS VARCHAR), '.jpg') AS image FROM customer WHERE c_mktsegment = 'MACHINERY') SELECT image FROM fixed WHERE image NOT IN (SELECT image FROM ex)",
)
def _(t):
    fixed = t.customer.where("c_mktsegment = 'MACHINERY'").selectExpr("concat('img_', CAST(c_custkey AS STRING), '.jpg') AS image")
    return rv.pending(fixed, _exported(t), "image")


@workload(
    "reset_reviews", "U6 W1",
    f"WITH {cte('log')} SELECT target_id, rec_id, label FROM log WHERE NOT is_auto QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY noted DESC, rec_id DESC) = 1",
)
def _(t):
    return rv.latest_state(rv.without_auto(t.log), key="target_id", order=["noted", "rec_id"]).select("target_id", "rec_id", "label")


LIST = ST + ", pos AS (SELECT *, row_number() OVER (ORDER BY target_id) - 1 AS position FROM rev WHERE label = 'accept') "


def _positions(t):
    return rv.list_positions(rv.filter_targets(_reviewed(t), "accept"), ["target_id"])


@workload("review_positions", "W3", LIST + "SELECT target_id, position FROM pos")
def _(t):
    return _positions(t).select("target_id", "position")


@workload("review_prefetch", "W2", LIST + "SELECT position, md5(CAST(target_id AS VARCHAR)) || '.jpg' AS overlay_file FROM pos WHERE position BETWEEN 40 AND 60 AND position <> 50")
def _(t):
    near = rv.prefetch(_positions(t), cursor=50, radius=10)
    return near.select("position", F.concat(F.md5(F.col("target_id").cast("string")), F.lit(".jpg")).alias("overlay_file"))


@workload(
    "sibling_jumps", "W3",
    LIST + "SELECT c.target_id AS current_id, s.target_id, p.position AS jump FROM rev c JOIN \"index\" s USING (image) LEFT JOIN pos p ON p.target_id = s.target_id WHERE c.label = 'hard_positive'",
)
def _(t):
    current = rv.filter_targets(_reviewed(t), "hard_positive")
    return rv.sibling_jumps(_positions(t), t.index, current).select("current_id", "target_id", "jump")


@workload(
    "warm_up_order", "W7",
    ST + ", pos AS (SELECT *, row_number() OVER (ORDER BY target_id) - 1 AS position FROM rev) SELECT target_id, CASE WHEN target_id IN (7, 900) THEN 0 WHEN position - 300 BETWEEN 0 AND 100 THEN 1 "
    "WHEN position - 300 BETWEEN -100 AND -1 THEN 2 ELSE 3 END AS tier, CASE WHEN label = '' THEN 0 ELSE 1 END AS reviewed, abs(position - 300) AS distance FROM pos",
)
def _(t):
    rows = rv.warm_up_order(rv.list_positions(_reviewed(t), ["target_id"]), cursor=300, window=100, predicted=["7", "900"])
    return rows.select("target_id", "tier", "reviewed", "distance").orderBy("tier", "reviewed", "distance")


@workload("pending_inputs", "S20 R3", f"{ST} SELECT target_id FROM \"index\" WHERE target_id NOT IN (SELECT target_id FROM log)")
def _(t):
    return rv.pending(t.index, t.log, "target_id").select("target_id")


@workload(
    "stage_progress", "A45",
    f"{ST} SELECT count(*) AS total, count(*) FILTER (target_id IN (SELECT target_id FROM log)) AS done, count(*) FILTER (target_id NOT IN (SELECT target_id FROM log)) AS remaining FROM \"index\"",
)
def _(t):
    return rv.progress(t.index, t.log, "target_id")


@workload(
    "imported_candidates", "A41",
    f"{ST}, c AS (SELECT target_id, image, mask_file IS NOT NULL AS has_mask, confidence IS NOT NULL AS has_image, CASE prompt_hits WHEN 1 THEN 'accepted' WHEN 2 THEN 'rejected' END AS gate_status, "
    "CASE class_name WHEN 'van' THEN 'vehicle_row_supported' ELSE 'model_only' END AS support_level FROM \"index\"), "
    "j AS (SELECT c.*, h.label AS existing, has_image AND has_mask AS present FROM c LEFT JOIN (SELECT * FROM st WHERE source = 'human') h USING (target_id)), "
    "o AS (SELECT *, CASE WHEN present THEN coalesce(existing, CASE WHEN gate_status = 'accepted' OR support_level = 'vehicle_row_supported' THEN 'accept' WHEN gate_status = 'rejected' THEN 'reject' END) END AS label FROM j) "
    "SELECT count(*) FILTER (label = 'accept') AS accepted, count(*) FILTER (label = 'reject') AS rejected, count(*) FILTER (NOT present) AS missing, "
    "count(*) FILTER (present AND label IS NULL) AS unreviewed, count(*) FILTER (existing IS NOT NULL) AS kept_existing FROM o",
)
def _(t):
    c = t.index.selectExpr(
        "target_id", "image", "mask_file IS NOT NULL AS has_mask", "confidence IS NOT NULL AS has_image",
        "CASE prompt_hits WHEN 1 THEN 'accepted' WHEN 2 THEN 'rejected' END AS gate_status",
        "CASE class_name WHEN 'van' THEN 'vehicle_row_supported' ELSE 'model_only' END AS support_level",
    )
    out = rv.import_candidates(c, _state(t).where("source = 'human'"))
    return out.agg(
        F.count_if(F.col("label") == "accept").alias("accepted"), F.count_if(F.col("label") == "reject").alias("rejected"),
        F.count_if("missing_inputs").alias("missing"), F.count_if(~F.col("missing_inputs") & F.col("label").isNull()).alias("unreviewed"),
        F.count_if("kept_existing").alias("kept_existing"),
    )


@workload(
    "target_index", "F1 D3",
    f"WITH {cte('detections')}, n AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY det_id) - 1 AS i FROM detections), "
    "x AS (SELECT CASE WHEN det_id % 4 = 0 THEN concat('src', det_id::VARCHAR) ELSE concat('img', image_id::VARCHAR, '::', i::VARCHAR) END AS target_id, concat('img', image_id::VARCHAR) AS image, "
    "i::INTEGER AS target_index, class_name, CASE WHEN det_id % 3 = 0 THEN prompt || '|extra' ELSE prompt END AS source_prompts, CASE WHEN det_id % 3 = 0 THEN 2 ELSE 1 END AS prompt_hits, "
    "det_id % 5 = 0 AS mask_missing FROM n) SELECT *, md5(target_id) || '.jpg' AS overlay_file FROM x",
)
def _(t):
    d = t.detections
    target = F.struct(
        "det_id", "class_name", "confidence", F.array("x1", "y1", "x2", "y2").alias("bbox"),
        F.when(F.col("det_id") % 5 == 0, "absent.png").otherwise("there.png").alias("mask_file"),
        F.when(F.col("det_id") % 3 != 0, F.col("prompt")).alias("source_prompt"),
        F.when(F.col("det_id") % 3 == 0, F.array("prompt", F.lit("extra"))).alias("source_prompts"),
        F.lit(None).cast("int").alias("prompt_hits"),
        F.when(F.col("det_id") % 4 == 0, F.concat(F.lit("src"), F.col("det_id").cast("string"))).alias("source_target_id"),
    )
    # The input form is one result record per image, as a detector writes it.
    results = d.groupBy(F.concat(F.lit("img"), F.col("image_id").cast("string")).alias("image")).agg(
        F.array_sort(F.collect_list(target)).alias("targets")
    ).withColumn("prompt_mode", F.lit("batch"))
    masks = d.select(F.lit("there.png").alias("mask_file"))
    out = rv.target_index(results, masks=masks)
    return out.select(
        "target_id", "image", "target_index", "class_name", F.array_join("source_prompts", "|").alias("source_prompts"),
        "prompt_hits", "mask_missing", "overlay_file",
    )
