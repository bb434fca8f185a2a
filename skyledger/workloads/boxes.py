"""Detections: overlap joins, groups, suppression, matching, merging and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.functions import boxes as bx
from skyledger.operators import agreement as ag
from skyledger.operators import profiles as pf
from skyledger.operators.ordered import nearest_rank
from skyledger.operators.overlap import overlap_pairs
from skyledger.operators.resolve import merge_groups, merged_targets, suppress
from skyledger.workloads.bindings import IOU_SQL, cte
from skyledger.workloads.registry import workload

THRESHOLDS = (0.3, 0.65, 0.9)
FIRST = ("view", "click")  # prompts of the first detector; the others belong to the second
CELL = 48.0
D = f"WITH RECURSIVE {cte('detections')}"
SPLIT = "f AS (SELECT * FROM detections WHERE prompt IN ('view', 'click')), s AS (SELECT * FROM detections WHERE prompt NOT IN ('view', 'click'))"
SELF_PAIRS = (
    f"pairs AS (SELECT a.image_id, a.det_id AS a_id, b.det_id AS b_id, a.prompt <> b.prompt AS crossing, {IOU_SQL} AS iou "
    "FROM detections a JOIN detections b ON a.image_id = b.image_id AND a.det_id < b.det_id)"
)
CROSS_PAIRS = f"pairs AS (SELECT a.image_id, a.det_id AS a_id, b.det_id AS b_id, {IOU_SQL} AS iou FROM f a JOIN s b ON a.image_id = b.image_id)"
LEVELS = "levels AS (SELECT unnest([0.3e0, 0.65e0, 0.9e0]) AS threshold)"
REACH = (
    "hits AS (SELECT threshold, a_id, b_id FROM pairs, levels WHERE iou >= threshold), "
    "sym AS (SELECT threshold, a_id AS u, b_id AS v FROM hits UNION ALL SELECT threshold, b_id, a_id FROM hits), "
    "reach(threshold, node, other) AS (SELECT threshold, det_id, det_id FROM detections, levels UNION "
    "SELECT r.threshold, r.node, sym.v FROM reach r JOIN sym ON sym.threshold = r.threshold AND sym.u = r.other), "
    "member AS (SELECT r.threshold, d.image_id, r.node, d.prompt, min(r.other) AS g FROM reach r JOIN detections d ON d.det_id = r.node GROUP BY ALL), "
    "grp AS (SELECT threshold, image_id, g, count(*) AS n, count(DISTINCT prompt) AS prompts FROM member GROUP BY ALL), "
    "per_image AS (SELECT threshold, image_id, sum(n)::BIGINT AS candidates, count(*) AS groups, "
    "count(*) FILTER (n > 1) AS multi_candidate_groups, count(*) FILTER (prompts > 1) AS cross_prompt_groups FROM grp GROUP BY ALL), "
    "matches AS (SELECT threshold, image_id, count(*) AS pair_matches, count(*) FILTER (crossing) AS cross_prompt_pairs "
    "FROM pairs, levels WHERE iou >= threshold GROUP BY ALL), "
    "profile AS (SELECT p.*, coalesce(pair_matches, 0) AS pair_matches, coalesce(cross_prompt_pairs, 0) AS cross_prompt_pairs "
    "FROM per_image p LEFT JOIN matches USING (threshold, image_id))"
)


def _first(t):
    return t.detections.where(F.col("prompt").isin(*FIRST))


def _second(t):
    return t.detections.where(~F.col("prompt").isin(*FIRST))


@workload("overlap_pairs", "J1 P1 F4", f"{D}, {SELF_PAIRS} SELECT image_id, a_id, b_id, round(iou, 6) AS iou FROM pairs WHERE iou >= 0.3")
def _(t):
    pairs = overlap_pairs(t.detections, None, group=["image_id"], id_col="det_id", min_iou=0.3)
    return pairs.withColumn("iou", F.round("iou", 6))


def _profile(t):
    return ag.overlap_profile(t.detections, image="image_id", id_col="det_id", prompt="prompt", thresholds=THRESHOLDS)


@workload("overlap_groups_per_image", "A5", f"{D}, {SELF_PAIRS}, {LEVELS}, {REACH} SELECT * FROM profile")
def _(t):
    return _profile(t)


@workload(
    "overlap_groups_by_threshold", "A5 A6 J1",
    f"{D}, {SELF_PAIRS}, {LEVELS}, {REACH} SELECT threshold, sum(candidates)::BIGINT AS candidates, sum(groups)::BIGINT AS groups, "
    "sum(multi_candidate_groups)::BIGINT AS multi_candidate_groups, sum(cross_prompt_groups)::BIGINT AS cross_prompt_groups, "
    "sum(pair_matches)::BIGINT AS pair_matches, sum(cross_prompt_pairs)::BIGINT AS cross_prompt_pairs, "
    "(sum(candidates) - sum(groups))::BIGINT AS collapsed_candidates, "
    "round((sum(candidates) - sum(groups)) / sum(candidates), 6) AS collapsed_fraction FROM profile GROUP BY threshold",
)
def _(t):
    totals = ag.profile_totals(_profile(t))
    return totals.withColumn("collapsed_fraction", F.round("collapsed_fraction", 6))


# One ordered pass per image: groups are structs {founder, rep box, rep confidence}.
_NEW = "{'founder': x.det_id, 'x1': x.x1, 'y1': x.y1, 'x2': x.x2, 'y2': x.y2, 'conf': x.confidence, 'det_id': x.det_id}"
_IOU_L = (
    "(greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))) / "
    "(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - "
    "(greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))))"
)


def _fold(order: str) -> str:
    iou = _IOU_L.format(a="g", b="x[1]")
    hit = f"list_position(list_transform(acc, lambda g: {iou} >= 0.65), true)"
    one = (
        "{'founder': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'conf': confidence, 'members': [det_id]}"
    )
    swap = (
        "list_transform(acc, lambda g, i: CASE WHEN i = " + hit + " THEN "
        "{'founder': g.founder, 'x1': CASE WHEN x[1].conf > g.conf THEN x[1].x1 ELSE g.x1 END, "
        "'y1': CASE WHEN x[1].conf > g.conf THEN x[1].y1 ELSE g.y1 END, "
        "'x2': CASE WHEN x[1].conf > g.conf THEN x[1].x2 ELSE g.x2 END, "
        "'y2': CASE WHEN x[1].conf > g.conf THEN x[1].y2 ELSE g.y2 END, "
        "'conf': greatest(g.conf, x[1].conf), 'members': list_concat(g.members, x[1].members)} ELSE g END)"
    )
    return (
        f"SELECT image_id, list_reduce(list([{one}] ORDER BY {order}), lambda acc, x: "
        f"CASE WHEN {hit} IS NULL THEN list_concat(acc, x) ELSE {swap} END) AS groups FROM detections GROUP BY image_id"
    )


MERGED_SQL = (
    f"{D}, folded AS ({_fold('prompt, det_id')}), flat AS (SELECT image_id, unnest(groups) AS g FROM folded), "
    "member AS (SELECT image_id, g.founder AS founder, unnest(g.members) AS det_id FROM flat), "
    "r AS (SELECT m.founder, d.* FROM member m JOIN detections d USING (det_id)), "
    "best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY founder ORDER BY confidence DESC, prompt, det_id) = 1), "
    "used AS (SELECT founder, string_agg(prompt, '|' ORDER BY first) AS source_prompts, count(*) AS hits, sum(n)::BIGINT AS members FROM "
    "(SELECT founder, prompt, min((prompt, det_id)) AS first, count(*) AS n FROM r GROUP BY ALL) GROUP BY founder) "
    "SELECT image_id, founder, det_id AS best_id, x1, y1, x2, y2, round(confidence, 6) AS confidence, class_name, source_prompts, "
    "hits::INTEGER AS prompt_hits, members FROM best JOIN used USING (founder)"
)


@workload("merged_targets", "A7 U5 D2", MERGED_SQL)
def _(t):
    d = t.detections.withColumn("pos", F.struct("prompt", "det_id"))
    founders = merge_groups(d, group=["image_id"], id_col="det_id", order="pos", confidence="confidence")
    merged = merged_targets(d, founders, group=["image_id"], id_col="det_id", order="pos", confidence="confidence", prompt="prompt")
    return merged.withColumn("source_prompts", F.array_join("source_prompts", "|")).withColumn(
        "confidence", F.round("confidence", 6)
    )


@workload(
    "merge_order_sensitivity", "A6 A7",
    f"{D}, fw AS ({_fold('prompt, det_id')}), bw AS ({_fold('prompt DESC, det_id DESC')}), "
    "n AS (SELECT image_id, len(fw.groups) AS f, len(bw.groups) AS r FROM fw JOIN bw USING (image_id)) "
    "SELECT sum(f)::BIGINT AS forward_groups, sum(r)::BIGINT AS reverse_groups, count(*) FILTER (f <> r) AS order_sensitive_images, "
    "sum(abs(f - r))::BIGINT AS absolute_group_delta FROM n",
)
def _(t):
    d = t.detections
    forward = merge_groups(d.withColumn("pos", F.struct("prompt", "det_id")), group=["image_id"], id_col="det_id",
                           order="pos", confidence="confidence")
    # Reverse order: letters of the prompt are complemented so that ascending order is descending.
    flipped = F.transform(F.split("prompt", ""), lambda c: -F.ascii(c))
    backward = merge_groups(d.withColumn("pos", F.struct(F.concat(flipped, F.array(F.lit(1))).alias("p"), (-F.col("det_id")).alias("i"))),
                            group=["image_id"], id_col="det_id", order="pos", confidence="confidence")
    n = lambda f, name: d.select("image_id", "det_id").join(f, "det_id").where(F.col("founder") == F.col("det_id")).groupBy("image_id").agg(F.count(F.lit(1)).alias(name))
    both = n(forward, "f").join(n(backward, "r"), "image_id")
    return both.agg(
        F.sum("f").alias("forward_groups"), F.sum("r").alias("reverse_groups"),
        F.count_if(F.col("f") != F.col("r")).alias("order_sensitive_images"),
        F.sum(F.abs(F.col("f") - F.col("r"))).alias("absolute_group_delta"),
    )


def _nms_sql(group: str, limit: str) -> str:
    iou = _IOU_L.format(a="k", b="x[1]")
    one = "{'id': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}"
    return (
        f"{D}, folded AS (SELECT {group}, list_reduce(list([{one}] ORDER BY confidence DESC, x1, y1, x2, y2, det_id), lambda acc, x: "
        f"CASE WHEN len(list_filter(acc, lambda k: {iou} > {limit})) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept "
        f"FROM detections GROUP BY {group}), ids AS (SELECT unnest(kept).id AS det_id FROM folded) "
        "SELECT image_id, det_id, class_name, round(confidence, 6) AS confidence FROM detections JOIN ids USING (det_id)"
    )


@workload("suppressed_detections", "A8", _nms_sql("image_id", "0.45"))
def _(t):
    kept = suppress(t.detections, group=["image_id"], id_col="det_id", confidence="confidence", max_iou=0.45)
    return kept.select("image_id", "det_id", "class_name", F.round("confidence", 6).alias("confidence"))


@workload("suppressed_same_class", "A8", _nms_sql("image_id, class_name", "0.45"))
def _(t):
    kept = suppress(t.detections, group=["image_id", "class_name"], id_col="det_id", confidence="confidence", max_iou=0.45)
    return kept.select("image_id", "det_id", "class_name", F.round("confidence", 6).alias("confidence"))


@workload("two_detector_pairs", "J2", f"{D}, {SPLIT}, {CROSS_PAIRS} SELECT image_id, a_id, b_id, round(iou, 6) AS iou FROM pairs WHERE iou >= 0.3")
def _(t):
    pairs = overlap_pairs(_first(t), _second(t), group=["image_id"], id_col="det_id", min_iou=0.3)
    return pairs.withColumn("iou", F.round("iou", 6))


MATCH_SQL = (
    "matched AS (SELECT unnest(list_reduce(list([{'a': a_id, 'b': b_id, 'iou': iou}] ORDER BY iou DESC, a_id DESC, b_id DESC), lambda acc, x: "
    "CASE WHEN len(list_filter(acc, lambda k: k.a = x[1].a OR k.b = x[1].b)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS m "
    "FROM pairs WHERE iou >= 0.3 GROUP BY image_id)"
)


@workload(
    "agreed_detections", "A9 J2",
    f"{D}, {SPLIT}, {CROSS_PAIRS}, {MATCH_SQL} SELECT f.image_id, f.det_id AS first_id, s.det_id AS second_id, (f.x1 + s.x1) / 2 AS x1, "
    "(f.y1 + s.y1) / 2 AS y1, (f.x2 + s.x2) / 2 AS x2, (f.y2 + s.y2) / 2 AS y2, round(m.iou, 6) AS agreement_iou, "
    "round(f.confidence, 6) AS first_confidence, round(s.confidence, 6) AS second_confidence "
    "FROM matched JOIN f ON f.det_id = m.a JOIN s ON s.det_id = m.b",
)
def _(t):
    out = ag.agreed_detections(_first(t), _second(t), image="image_id", id_col="det_id", confidence="confidence")
    for c in ("agreement_iou", "first_confidence", "second_confidence"):
        out = out.withColumn(c, F.round(c, 6))
    return out


BEST_SQL = (
    f"{D}, {SPLIT}, {CROSS_PAIRS}, tb AS (SELECT f.image_id, f.det_id, coalesce(max(iou), 0) AS best FROM f LEFT JOIN pairs ON pairs.a_id = f.det_id GROUP BY ALL), "
    "sb AS (SELECT s.image_id, s.det_id, coalesce(max(iou), 0) AS best, count(*) FILTER (iou >= 0.5) AS hits FROM s LEFT JOIN pairs ON pairs.b_id = s.det_id GROUP BY ALL), "
    "ta AS (SELECT image_id, count(*) AS targets, count(*) FILTER (best >= 0.3) AS m3, count(*) FILTER (best >= 0.5) AS m5 FROM tb GROUP BY image_id), "
    "sa AS (SELECT image_id, count(*) AS detections, count(*) FILTER (best < 0.3) AS u3, count(*) FILTER (hits > 1) AS many FROM sb GROUP BY image_id) "
)


@workload(
    "teacher_agreement_per_image", "J3",
    BEST_SQL + "SELECT image_id, coalesce(targets, 0) AS targets, coalesce(m3, 0) AS targets_matched_at_0_3, coalesce(m5, 0) AS targets_matched_at_0_5, "
    "coalesce(detections, 0) AS detections, coalesce(u3, 0) AS detections_unmatched_at_0_3, coalesce(many, 0) AS detections_with_multiple_targets_at_0_5 "
    "FROM ta FULL JOIN sa USING (image_id)",
)
def _(t):
    best = ag.best_overlaps(_first(t), _second(t), image="image_id", id_col="det_id", cell=CELL)
    return ag.agreement_counts(*best, image="image_id")


@workload(
    "teacher_agreement_strata", "A29 J3",
    BEST_SQL + ", dims AS (SELECT tb.*, f.class_name, CASE WHEN confidence < 0.3 THEN 'low' WHEN confidence < 0.7 THEN 'mid' ELSE 'high' END AS band FROM tb JOIN f USING (det_id)) "
    "SELECT CASE WHEN class_name IS NULL THEN 'confidence' ELSE 'class' END AS dimension, coalesce(class_name, band) AS value, count(*) AS targets, "
    "count(*) FILTER (best >= 0.3) AS matched_0_3, count(*) FILTER (best >= 0.5) AS matched_0_5 FROM dims GROUP BY GROUPING SETS ((class_name), (band))",
)
def _(t):
    f = _first(t)
    best, _ = ag.best_overlaps(f, _second(t), image="image_id", id_col="det_id", cell=CELL)
    band = F.when(F.col("confidence") < 0.3, "low").when(F.col("confidence") < 0.7, "mid").otherwise("high")
    rows = f.join(best.select("image_id", *bx.BOX, "best_iou"), ["image_id", *bx.BOX]).withColumn("band", band)
    return pf.strata_counts(
        rows, {"class": "class_name", "confidence": "band"},
        targets=F.count(F.lit(1)), matched_0_3=F.count_if(F.col("best_iou") >= 0.3), matched_0_5=F.count_if(F.col("best_iou") >= 0.5),
    )


LINES = "CASE WHEN det_id % 9 = 0 THEN true WHEN det_id % 9 = 1 THEN NULL ELSE false END"
LINES_SQL = (
    f"{D}, t AS (SELECT *, {LINES} AS has_lines FROM detections), e AS (SELECT *, x1 - (x2 - x1) * 0.5 AS ex1, y1 - (y2 - y1) * 0.5 AS ey1, "
    "x2 + (x2 - x1) * 0.5 AS ex2, y2 + (y2 - y1) * 0.5 AS ey2 FROM t), l AS (SELECT * FROM e WHERE has_lines), "
    "ev AS (SELECT e.*, CASE WHEN has_lines THEN 'direct_has_lines' WHEN EXISTS (SELECT 1 FROM l WHERE l.image_id = e.image_id AND l.ex1 < e.ex2 "
    "AND e.ex1 < l.ex2 AND l.ey1 < e.ey2 AND e.ey1 < l.ey2) THEN 'adjacent_to_lines' ELSE 'no_line_evidence' END AS evidence FROM e) "
)


def _line_evidence(t):
    targets = t.detections.withColumn("has_lines", F.expr(LINES))
    return ag.line_evidence(targets, image="image_id", id_col="det_id", has_lines="has_lines", cell=2 * CELL)


@workload(
    "line_evidence", "J4 P2",
    LINES_SQL + "SELECT image_id, det_id, evidence, CASE WHEN evidence = 'no_line_evidence' THEN 'reject' ELSE 'accept' END AS line_label FROM ev",
)
def _(t):
    return _line_evidence(t).select("image_id", "det_id", "evidence", "line_label")


@workload(
    "line_filter_audit", "A27 J4",
    LINES_SQL + f", {cte('log')}, last AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY noted DESC, rec_id DESC) = 1) "
    "SELECT evidence, count(*) AS targets, count(last.label) AS labelled, count(*) FILTER (last.label = 'accept' AND evidence <> 'no_line_evidence' "
    "OR last.label = 'reject' AND evidence = 'no_line_evidence') AS reproduced, count(*) FILTER (last.label = 'accept' AND evidence = 'no_line_evidence' "
    "OR last.label = 'reject' AND evidence <> 'no_line_evidence') AS mismatched FROM ev LEFT JOIN last ON last.target_id = ev.det_id GROUP BY evidence",
)
def _(t):
    from skyledger.operators.reviews import latest_state

    state = latest_state(t.log, key="target_id", order=["noted", "rec_id"]).select("target_id", "label")
    return pf.filter_reproduction(_line_evidence(t), state, id_col="det_id")


@workload(
    "space_states", "J14",
    f"{D}, {SPLIT}, {CROSS_PAIRS}, c AS (SELECT p.*, s.confidence AS score, s.class_name FROM pairs p JOIN s ON s.det_id = p.b_id WHERE iou > 0), "
    "b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY iou DESC, score DESC, b_id DESC) = 1), "
    "top AS (SELECT image_id, max(confidence) AS top FROM s GROUP BY image_id) "
    "SELECT f.image_id, f.det_id, CASE WHEN b.iou >= 0.3 AND b.score >= 0.65 THEN CASE WHEN b.class_name = 'car' THEN 'occupied' ELSE 'empty' END ELSE 'unknown' END AS state, "
    "round(coalesce(b.score, top, 0), 6) AS score, round(coalesce(b.iou, 0), 6) AS iou FROM f LEFT JOIN b ON b.a_id = f.det_id LEFT JOIN top ON top.image_id = f.image_id",
)
def _(t):
    state = F.when(F.col("class_name") == "car", "occupied").otherwise("empty")
    spaces = _first(t).select("image_id", "det_id", *bx.BOX)
    out = ag.assign_spaces(spaces, _second(t), image="image_id", space_id="det_id", det_id="det_id", state=state,
                           confidence="confidence", cell=CELL)
    return out.select("image_id", "det_id", "state", F.round("score", 6).alias("score"), F.round("iou", 6).alias("iou"))


# ---- profiles -------------------------------------------------------------------------------

_CONF = "CASE WHEN det_id % 50 = 7 THEN NULL ELSE confidence END"


@workload(
    "class_histogram", "A1 F3",
    f"{D} SELECT class_name, count(*) AS raw, count(*) FILTER (c IS NULL OR c >= 0.2) AS kept FROM (SELECT *, {_CONF} AS c FROM detections) "
    "WHERE class_name IN ('car', 'bus') GROUP BY class_name",
)
def _(t):
    d = t.detections.withColumn("confidence", F.expr(_CONF))
    return pf.class_histogram(d, min_confidence=0.2, only=("car", "bus"))


BUCKET = "CASE WHEN short < 26 THEN '<26' WHEN short < 32 THEN '26-32' ELSE '>=32' END"


@workload(
    "prompt_profile", "A2 S3",
    f"{D}, b AS (SELECT *, {_CONF} AS c, least(x2 - x1, y2 - y1) AS short FROM detections) SELECT prompt, count(DISTINCT image_id) AS images_with_targets, "
    "count(*) AS targets, count(*) FILTER (x1 <= 0 OR y1 <= 0 OR x2 >= 640 OR y2 >= 640) AS edge_touching, count(*) FILTER (NOT (x2 > x1 AND y2 > y1)) AS invalid_bbox, "
    "count(c) AS with_confidence, count(*) FILTER (short < 16) AS size_lt_16, count(*) FILTER (short >= 16 AND short < 32) AS size_16_32, "
    "count(*) FILTER (short >= 32 AND short < 64) AS size_32_64, count(*) FILTER (short >= 64) AS size_ge_64 FROM b GROUP BY prompt",
)
def _(t):
    return pf.prompt_profile(t.detections.withColumn("confidence", F.expr(_CONF)), width=640, height=640)


@workload(
    "prompt_class_counts", "A2",
    f"{D} SELECT prompt, class_name, count(*) AS n FROM detections GROUP BY ALL",
)
def _(t):
    return t.detections.groupBy("prompt", "class_name").agg(F.count(F.lit(1)).alias("n"))


def _rank_sql(value: str, marks: dict[str, float], group: str, src: str) -> str:
    picks = ", ".join(
        f"max(CASE WHEN rn = round_even((n - 1) * {f}::DOUBLE, 0) THEN v END) AS {name}" for name, f in marks.items()
    )
    return (
        f"SELECT {group}, metric, max(n) AS n, {picks} FROM (SELECT {group}, metric, v, row_number() OVER w - 1 AS rn, "
        f"count(*) OVER (PARTITION BY {group}, metric) AS n FROM ({src}) WHERE v IS NOT NULL WINDOW w AS (PARTITION BY {group}, metric ORDER BY v)) GROUP BY {group}, metric"
    )


MARKS = {"p01": 0.01, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99}


@workload(
    "prompt_quantiles", "A3 A2",
    f"{D}, m AS (SELECT prompt, 'confidence' AS metric, round({_CONF}, 6) AS v FROM detections UNION ALL SELECT prompt, 'short_side', least(x2 - x1, y2 - y1) FROM detections "
    "UNION ALL SELECT prompt, 'area_ratio', round((x2 - x1) * (y2 - y1) / 409600, 6) FROM detections) "
    + _rank_sql("v", MARKS, "prompt", "SELECT * FROM m"),
)
def _(t):
    d = t.detections.select(
        "prompt", F.round(F.expr(_CONF), 6).alias("confidence"), bx.short_side(bx.box()).alias("short_side"),
        F.round(bx.area(bx.box()) / 409600, 6).alias("area_ratio"),
    )
    long = d.unpivot(["prompt"], ["confidence", "short_side", "area_ratio"], "metric", "v")
    return nearest_rank(long, ["prompt", "metric"], "v", MARKS)


INVENTORY_SETS = ("view", "click", "purchase")


@workload(
    "target_inventory", "A4 U2",
    MERGED_SQL.split("SELECT image_id, founder, det_id AS best_id")[0]
    + f", {cte('log')}, st AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY noted DESC, rec_id DESC) = 1), "
    "x AS (SELECT b.det_id, hits, string_split(source_prompts, '|') AS p FROM best b JOIN used USING (founder)), "
    "v AS (SELECT x.*, list_has_any(p, ['view', 'click', 'purchase']) AS related, list_has_all(['view', 'click', 'purchase'], p) AS sole FROM x) "
    "SELECT count(*) AS total, count(*) FILTER (related) AS vehicle_related, count(*) FILTER (sole) AS vehicle_only, "
    "count(*) FILTER (related AND NOT sole) AS mixed, count(*) FILTER (related AND hits = 1) AS one_prompt, count(*) FILTER (related AND hits > 1) AS many_prompts, "
    "count(*) FILTER (related AND label = 'accept') AS labelled_accept, count(*) FILTER (related AND is_auto) AS auto, count(*) FILTER (related AND source = 'human') AS by_human, "
    "count(*) FILTER (related AND label IS NULL) AS missing_state FROM v LEFT JOIN st ON st.target_id = v.det_id",
)
def _(t):
    from skyledger.operators.reviews import latest_state

    d = t.detections.withColumn("pos", F.struct("prompt", "det_id"))
    founders = merge_groups(d, group=["image_id"], id_col="det_id", order="pos", confidence="confidence")
    merged = merged_targets(d, founders, group=["image_id"], id_col="det_id", order="pos", confidence="confidence", prompt="prompt")
    state = latest_state(t.log, key="target_id", order=["noted", "rec_id"])
    return pf.inventory(merged.withColumnRenamed("best_id", "target_id"), state, INVENTORY_SETS)


@workload(
    "shadow_comparison", "A35 P3",
    f"{D}, {SPLIT}, m AS (SELECT 'first' AS model, * FROM f UNION ALL SELECT 'second', * FROM s) SELECT model, class_name, count(*) AS detections, "
    "count(*) FILTER ((x2 - x1) * (y2 - y1) / 409600 > 0.0025) AS large_boxes, round(avg(confidence), 4) AS mean_confidence FROM m GROUP BY ALL",
)
def _(t):
    both = _first(t).withColumn("model", F.lit("first")).unionByName(_second(t).withColumn("model", F.lit("second")))
    return pf.model_box_stats(both, image_area=409600.0, large_share=0.0025)
