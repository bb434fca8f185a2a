"""Time joins, trajectories, subtitles, replies and metric logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.functions import keys as k
from skyledger.functions import text as tx
from skyledger.functions import tiles as tl
from skyledger.operators import replies as rp
from skyledger.operators import tracks as tk
from skyledger.workloads.bindings import cte
from skyledger.workloads.registry import workload

FR = cte("frames")


@workload(
    "nearest_position", "J7 E17",
    f"WITH {FR}, q AS (SELECT * FROM frames WHERE kind = 'purchase'), p AS (SELECT * FROM frames WHERE kind = 'view'), "
    "c AS (SELECT q.track_id, q.frame_id, p.frame_id AS position_id, abs(p.t - q.t) AS delta FROM q JOIN p ON p.track_id = q.track_id AND p.t BETWEEN q.t - 5.1 AND q.t + 5.1), "
    "b AS (SELECT * FROM c WHERE delta <= 5 QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY delta, position_id) = 1) "
    "SELECT q.track_id, q.frame_id, CASE WHEN delta <= 1 THEN 'srt_frame' WHEN delta <= 5 THEN 'srt_interpolated' ELSE 'none' END AS match, round(delta, 6) AS delta, position_id FROM q LEFT JOIN b USING (frame_id)",
)
def _(t):
    f = t.frames
    positions = f.where("kind = 'view'").withColumn("position_id", F.col("frame_id"))
    out = tk.nearest_in_time(
        f.where("kind = 'purchase'").select("track_id", "frame_id", "t"), positions, key=["track_id"], frame_id="frame_id",
        time="t", order="frame_id", payload=["position_id"],
    )
    return out.select("track_id", "frame_id", "match", F.round("delta", 6).alias("delta"), "position_id")


_SEC = {"spark": "CAST(floor(t * 3600 + 0.0005) AS BIGINT)"}
DAYS = (
    f"{FR}, s AS (SELECT *, CAST(floor(t * 3600 + 0.0005) AS BIGINT) AS sec FROM frames), n AS (SELECT frame_id, kind, sec // 86400 AS day, sec % 86400 AS second, concat('label', lpad(frame_id::VARCHAR, 8, '0'), '.txt') AS name FROM s)"
)


def _named(t):
    s = t.frames.withColumn("sec", F.expr(_SEC["spark"]))
    return s.selectExpr("frame_id", "kind", "sec div 86400 AS day", "sec % 86400 AS second", "concat('label', lpad(CAST(frame_id AS STRING), 8, '0'), '.txt') AS name")


@workload(
    "same_day_reference", "J8 P15",
    f"WITH {DAYS}, q AS (SELECT * FROM n WHERE kind = 'click'), r AS (SELECT * FROM n WHERE kind = 'signup') "
    "SELECT q.frame_id, r.name AS reference, round(abs(r.second - q.second) / 60, 6) AS reference_minutes FROM q LEFT JOIN r ON r.day = q.day "
    "QUALIFY row_number() OVER (PARTITION BY q.frame_id ORDER BY abs(r.second - q.second), r.name) = 1",
)
def _(t):
    n = _named(t)
    out = tk.same_day_reference(n.where("kind = 'click'"), n.where("kind = 'signup'"), day="day", second="second", name="name")
    return out.select("frame_id", "reference", F.round("reference_minutes", 6).alias("reference_minutes"))


_PT = f"{FR}, p AS (SELECT track_id, t, value AS x, value * 0.5 + t AS y, value / 100 AS speed FROM frames)"


def _points(t):
    return t.frames.selectExpr("track_id", "t", "value AS x", "value * 0.5e0 + t AS y", "value / 100 AS speed")


@workload(
    "trajectory_features", "A31 D18",
    f"WITH {_PT}, l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM p WINDOW w AS (PARTITION BY track_id ORDER BY t)), "
    "g AS (SELECT track_id, count(*) AS points, max(t) - min(t) AS duration, sqrt(pow(arg_max(x, t) - arg_min(x, t), 2) + pow(arg_max(y, t) - arg_min(y, t), 2)) AS displacement, "
    "coalesce(sum(sqrt((x - px) * (x - px) + (y - py) * (y - py))), 0) AS path_length, count(*) FILTER (speed <= 0.2) / count(*) AS stop_fraction, arg_min(speed, t) <= 0.2 AS starts_stopped, "
    "arg_max(speed, t) <= 0.2 AS ends_stopped, quantile_cont(speed, 0.5) AS median_speed, quantile_cont(speed, 0.95) AS speed_p95 FROM l GROUP BY track_id) "
    "SELECT track_id, points, round(duration, 5) AS duration, round(displacement, 5) AS displacement, round(path_length, 4) AS path_length, round(stop_fraction, 6) AS stop_fraction, starts_stopped, ends_stopped, "
    "round(median_speed, 6) AS median_speed, round(speed_p95, 6) AS speed_p95 FROM g",
)
def _(t):
    f = tk.trajectory_features(_points(t), agent="track_id")
    digits = {"duration": 5, "displacement": 5, "path_length": 4, "stop_fraction": 6, "median_speed": 6, "speed_p95": 6}
    return f.withColumns({c: F.round(c, d) for c, d in digits.items()})


@workload(
    "trajectory_ingest", "E16 A31",
    f"WITH {FR}, a AS (SELECT track_id, count(*) AS points, max(t) - min(t) AS duration FROM frames GROUP BY track_id) SELECT CASE WHEN ('0x' || substr(md5(track_id::VARCHAR), 1, 8))::BIGINT / 4294967295.0::DOUBLE < 0.8 THEN 'train' "
    "WHEN ('0x' || substr(md5(track_id::VARCHAR), 1, 8))::BIGINT / 4294967295.0::DOUBLE < 0.9 THEN 'val' ELSE 'test' END AS split, count(*) AS agents, sum(points)::BIGINT AS points, count(*) FILTER (points >= 2) AS moving FROM a GROUP BY ALL",
)
def _(t):
    f = tk.trajectory_features(_points(t), agent="track_id")
    return f.groupBy(k.stable_split(F.col("track_id").cast("string")).alias("split")).agg(
        F.count(F.lit(1)).alias("agents"), F.sum("points").alias("points"), F.count_if(F.col("points") >= 2).alias("moving")
    )


@workload(
    "time_order_issues", "W6",
    f"WITH {FR}, l AS (SELECT track_id, t, lag(t) OVER (PARTITION BY track_id ORDER BY value, frame_id) AS b FROM frames) SELECT track_id, count(*) AS points, count(*) FILTER (t <= b) AS time_errors FROM l GROUP BY track_id",
)
def _(t):
    return tk.time_issues(t.frames.select("track_id", "t", "value", "frame_id"), ["track_id"], "t", ["value", "frame_id"])


@workload(
    "gap_groups", "W4",
    f"WITH {FR}, l AS (SELECT *, CASE WHEN t - lag(t) OVER w > 6 THEN 1 ELSE 0 END AS n FROM frames WINDOW w AS (PARTITION BY track_id ORDER BY t, frame_id)), "
    "g AS (SELECT *, sum(n) OVER (PARTITION BY track_id ORDER BY t, frame_id) AS gap_group FROM l) SELECT track_id, gap_group::BIGINT AS gap_group, count(*) AS size, round(max(t) - min(t), 5) AS span FROM g GROUP BY ALL HAVING count(*) >= 3",
)
def _(t):
    g = tk.gap_groups(t.frames.select("track_id", "frame_id", "t"), ["track_id"], "t", ["t", "frame_id"], max_gap=6.0)
    return g.groupBy("track_id", "gap_group").agg(F.count(F.lit(1)).alias("size"), F.round(F.max("t") - F.min("t"), 5).alias("span"))


INST = (
    f"{FR}, o AS (SELECT track_id, frame_id, t, lag(frame_id) OVER w AS pv, lead(frame_id) OVER w AS nx FROM frames WINDOW w AS (PARTITION BY track_id ORDER BY t, frame_id)), "
    "i AS (SELECT concat('t', frame_id::VARCHAR) AS token, CASE WHEN pv IS NULL THEN '' WHEN frame_id % 97 = 0 THEN 'lost' ELSE concat('t', pv::VARCHAR) END AS prev, "
    "CASE WHEN nx IS NULL THEN '' WHEN frame_id % 89 = 0 THEN 'lost' ELSE concat('t', nx::VARCHAR) END AS next, track_id, frame_id FROM o)"
)


def _instances(t):
    from skyledger.operators.ordered import ordered_scan

    f = t.frames.select("track_id", "frame_id", "t")
    back = ordered_scan(f, ["track_id"], ["t", "frame_id"], lag={"pv": "frame_id"})
    links = back.where(F.col("pv").isNotNull()).select(F.col("pv").alias("frame_id"), F.col("frame_id").alias("nx"))
    return back.join(links, "frame_id", "left").selectExpr(
        "concat('t', CAST(frame_id AS STRING)) AS token",
        "CASE WHEN pv IS NULL THEN '' WHEN frame_id % 97 = 0 THEN 'lost' ELSE concat('t', CAST(pv AS STRING)) END AS prev",
        "CASE WHEN nx IS NULL THEN '' WHEN frame_id % 89 = 0 THEN 'lost' ELSE concat('t', CAST(nx AS STRING)) END AS next",
        "track_id", "frame_id",
    )


@workload(
    "chain_breaks", "J17",
    f"WITH {INST} SELECT a.token, 'next' AS side FROM i a LEFT JOIN i b ON a.next = b.token WHERE a.next <> '' AND b.prev IS DISTINCT FROM a.token "
    "UNION ALL SELECT a.token, 'prev' FROM i a LEFT JOIN i b ON a.prev = b.token WHERE a.prev <> '' AND b.next IS DISTINCT FROM a.token",
)
def _(t):
    return tk.chain_breaks(_instances(t))


@workload(
    "agent_points", "J17",
    f"WITH {FR} SELECT f.track_id % 7 AS scene, n_name AS agent_type, count(*) AS points, round(min(f.t), 4) AS first_time FROM frames f JOIN nation ON n_nationkey = f.track_id % 25 GROUP BY ALL",
)
def _(t):
    f = t.frames
    frames = f.selectExpr("frame_id AS frame_token", "track_id % 7 AS scene", "t AS timestamp")
    instances = f.selectExpr("frame_id AS frame_token", "track_id % 7 AS scene", "track_id % 25 AS agent_token")
    agents = t.nation.selectExpr("CAST(n_nationkey AS BIGINT) AS agent_token", "n_name AS agent_type")
    return tk.agent_points(frames, instances, agents).groupBy("scene", "agent_type").agg(
        F.count(F.lit(1)).alias("points"), F.round(F.min("timestamp"), 4).alias("first_time")
    )


# ---- subtitles, camera metadata --------------------------------------------------------------------

_SRT = (
    "concat(CAST(event_id AS VARCHAR(20)), chr(10), CASE WHEN event_id % 11 = 0 THEN 'no clock' ELSE concat('00:0', CAST(event_id % 10 AS VARCHAR(20)), ':1', CAST(event_id % 7 AS VARCHAR(20)), ',', lpad(CAST(event_id % 1000 AS VARCHAR(20)), 3, '0'), ' --> 00:59:59,000') END, chr(10), "
    "CASE event_id % 4 WHEN 0 THEN concat('F/2.8, GPS (30.', lpad(CAST(event_id % 9973 AS VARCHAR(20)), 6, '0'), ', 120.5, 15.25), D 3.2m') WHEN 1 THEN concat('lat: 31.', CAST(event_id % 97 AS VARCHAR(20)), ', lon: -0.25 H 2.5m') "
    "WHEN 2 THEN 'ISO 100, ALT 44.0m' ELSE 'nothing' END, chr(10), chr(10), 'trailer', chr(10), ' ', chr(10), 'gps(1.5,2.5)')"
)


@workload(
    "subtitle_positions", "S10 D17",
    f"WITH x AS (SELECT event_id, unnest(string_split_regex({_SRT}, '\\n\\s*\\n')) AS b, generate_subscripts(string_split_regex({_SRT}, '\\n\\s*\\n'), 1) - 1 AS block FROM events), "
    "y AS (SELECT event_id, block::INTEGER AS block, b, regexp_extract(b, '(\\d{2}):(\\d{2}):(\\d{2})[,.](\\d{3})', ['h', 'm', 's', 'z']) AS c, "
    "regexp_extract(b, '(?i)GPS\\s*\\(\\s*(-?\\d+\\.\\d+)\\s*,\\s*(-?\\d+\\.\\d+)(?:\\s*,\\s*(-?\\d+(?:\\.\\d+)?))?\\s*\\)', ['la', 'lo', 'al']) AS g, "
    "regexp_extract(b, '(?i)lat\\s*[:=]?\\s*(-?\\d+\\.\\d+)\\s*[,;]\\s*(?:lon|lng)\\s*[:=]?\\s*(-?\\d+\\.\\d+)', ['la', 'lo']) AS l, regexp_extract(b, '(?i)(?:ALT|H)\\s*(-?\\d+(?:\\.\\d+)?)\\s*m', 1) AS a FROM x) "
    "SELECT event_id, block, CASE WHEN c.h <> '' THEN TRY_CAST(c.h AS DOUBLE) * 3600 + TRY_CAST(c.m AS DOUBLE) * 60 + TRY_CAST(c.s AS DOUBLE) + TRY_CAST(c.z AS DOUBLE) / 1000 END AS time_seconds, "
    "CASE WHEN g.la <> '' THEN TRY_CAST(g.la AS DOUBLE) WHEN l.la <> '' THEN TRY_CAST(l.la AS DOUBLE) END AS latitude, CASE WHEN g.lo <> '' THEN TRY_CAST(g.lo AS DOUBLE) WHEN l.lo <> '' THEN TRY_CAST(l.lo AS DOUBLE) END AS longitude, "
    "round_even(coalesce(CASE WHEN g.al <> '' THEN TRY_CAST(g.al AS DOUBLE) END, CASE WHEN a <> '' THEN TRY_CAST(a AS DOUBLE) END), 1) AS altitude_m FROM y WHERE c.h <> '' OR g.la <> '' OR l.la <> ''",
)
def _(t):
    texts = t.events.select("event_id", F.expr(_SRT.replace("VARCHAR(20)", "STRING")).alias("text"))
    return rp.subtitle_positions(texts, text="text", keep=["event_id"])


@workload(
    "camera_metadata", "P20 P21 P33 D16",
    "SELECT p_partkey, round(p_size + (p_partkey % 60) / 60.0::DOUBLE + (p_partkey % 3600) / 3600.0::DOUBLE, 7) * CASE WHEN p_brand < 'Brand#15' THEN -1 ELSE 1 END AS latitude, "
    "CASE WHEN p_partkey % 3 = 1 THEN -p_retailprice ELSE p_retailprice END AS altitude, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat('2024-', lpad((1 + p_partkey % 12)::VARCHAR, 2, '0'), '-0', (1 + p_partkey % 9)::VARCHAR, 'T1', (p_partkey % 10)::VARCHAR, ':00:30') END AS captured_at, "
    "CASE WHEN p_partkey % 5 = 0 THEN 'independent_scene' ELSE 'georeferenced' END AS spatial_state FROM part",
)
def _(t):
    c = F.col
    raw = t.part.withColumn(
        "taken",
        F.expr("CASE WHEN p_partkey % 4 = 0 THEN '2024:01' ELSE concat('2024:', lpad(CAST(1 + p_partkey % 12 AS STRING), 2, '0'), ':0', CAST(1 + p_partkey % 9 AS STRING), ' 1', CAST(p_partkey % 10 AS STRING), ':00:30') END"),
    )
    lat = tl.dms_to_degrees(c("p_size").cast("double"), (c("p_partkey") % 60).cast("double"), (c("p_partkey") % 3600).cast("double"), F.when(c("p_brand") < "Brand#15", "S").otherwise("N"))
    place = F.when(c("p_partkey") % 5 != 0, c("p_retailprice"))
    return raw.select(
        "p_partkey", lat.alias("latitude"), tl.signed_altitude(c("p_retailprice"), (c("p_partkey") % 3 == 1).cast("int")).alias("altitude"),
        tl.exif_time(c("taken")).alias("captured_at"), tl.spatial_state(place, place).alias("spatial_state"),
    )


@workload(
    "ground_scale", "P22",
    "SELECT l_returnflag, round(sum(l_quantity * 0.13), 4) AS metres_x, round(sum(l_quantity * 0.15), 4) AS metres_y, round(sum(l_quantity * 100 * 0.13 * 0.15), 2) AS square_metres FROM lineitem GROUP BY l_returnflag",
)
def _(t):
    gx, gy, status = F.lit(0.13), F.lit(0.15), F.lit("derived")
    x, y = tl.pixels_to_metres(F.col("l_quantity"), F.col("l_quantity"), gx, gy, status)
    area = tl.pixel_area_to_m2(F.col("l_quantity") * 100, gx, gy, status)
    return t.lineitem.groupBy("l_returnflag").agg(
        F.round(F.sum(x), 4).alias("metres_x"), F.round(F.sum(y), 4).alias("metres_y"), F.round(F.sum(area), 2).alias("square_metres")
    )


@workload(
    "timestamp_checks", "P19",
    "WITH s AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '2024-02-30T10:00:00' WHEN 1 THEN '2024-02-28T10:00:00Z' WHEN 2 THEN '2024-03-05' WHEN 3 THEN 'soon' ELSE '2024-03-05T10:00:00+08:00' END AS x FROM orders) "
    "SELECT x, x IN ('2024-02-28T10:00:00Z', '2024-03-05', '2024-03-05T10:00:00+08:00') AS valid, count(*) AS n FROM s GROUP BY ALL",
)
def _(t):
    s = t.orders.selectExpr("CASE o_orderkey % 5 WHEN 0 THEN '2024-02-30T10:00:00' WHEN 1 THEN '2024-02-28T10:00:00Z' WHEN 2 THEN '2024-03-05' WHEN 3 THEN 'soon' ELSE '2024-03-05T10:00:00+08:00' END AS x")
    return s.groupBy("x", k.is_timestamp(F.col("x")).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


# ---- replies ---------------------------------------------------------------------------------------

ALLOWED = ("accept", "reject", "hard_positive", "needs_review")
_REPLY = (
    "CASE (conv_id + turn) % 7 WHEN 0 THEN concat(text, chr(10), '```json', chr(10), '{\"label\": \"accept\", \"confidence\": 0.9, \"verdict\": \"PASS\"}', chr(10), '```') "
    "WHEN 1 THEN concat(text, ' {\"label\": \"reject\", \"confidence\": 1.7, \"verdict\": \"fail\", \"estimated_problem_count\": ', CAST(turn AS VARCHAR(20)), ',} ') "
    "WHEN 2 THEN concat('{label: \"hard_positive\", verdict: \"needs_review\", \"confidence\": -2, \"semantic\": {\"object_type\": \"car\"}}', '') "
    "WHEN 3 THEN concat(text, chr(10), 'Needs_Review') WHEN 4 THEN concat('I would reject or hard_positive this: ', text) WHEN 5 THEN concat(text, ' {\"label\": \"other\", \"verdict\": \"odd\"} accept.') ELSE text END"
)
_WORD = " ".join(
    f"WHEN regexp_matches(lower(trim(reply)), '(^|[^a-z0-9_]){w}($|[^a-z0-9_])') THEN '{w}'" for w in sorted(ALLOWED, key=len, reverse=True)
)
REPLY = (
    f"r AS (SELECT conv_id, turn, {_REPLY} AS reply FROM conversations), c AS (SELECT *, CASE WHEN contains(reply, '```') AND regexp_extract(reply, '(?s)```(?:json)?\\s*(.*?)\\s*```', 1) <> '' THEN regexp_extract(reply, '(?s)```(?:json)?\\s*(.*?)\\s*```', 1) "
    "ELSE nullif(regexp_extract(reply, '(?s)\\{.*\\}', 0), '') END AS cand FROM r), "
    "e AS (SELECT *, CASE WHEN json_valid(cand) THEN cand ELSE regexp_replace(regexp_replace(cand, ',\\s*([}\\]])', '\\1', 'g'), '([{,\\s])([a-zA-Z_][a-zA-Z0-9_]*)\\s*:', '\\1\"\\2\":', 'g') END AS fixed FROM c), "
    "p AS (SELECT *, CASE WHEN json_valid(fixed) THEN fixed END AS parsed, lower(trim(regexp_extract(trim(reply), '([^\\n]*)$', 1))) AS last FROM e), "
    "l AS (SELECT *, coalesce(json_extract_string(parsed, '$.label') IN ('accept', 'reject', 'hard_positive', 'needs_review'), false) AS structured, "
    f"CASE WHEN last IN ('accept', 'reject', 'hard_positive', 'needs_review') THEN last {_WORD} END AS plain FROM p)"
)


def _replies(t):
    return t.conversations.select("conv_id", "turn", F.expr(_REPLY.replace("VARCHAR(20)", "STRING")).alias("reply"))


@workload(
    "reply_labels", "P23 P24 P36",
    f"WITH {REPLY} SELECT conv_id, turn, parsed IS NOT NULL AS has_json, structured, CASE WHEN structured THEN json_extract_string(parsed, '$.label') ELSE plain END AS label FROM l",
)
def _(t):
    out = rp.parsed_replies(_replies(t), "reply", ALLOWED)
    return out.select("conv_id", "turn", F.col("parsed").isNotNull().alias("has_json"), "structured", "label")


@workload(
    "reply_verdicts", "P25 P27",
    f"WITH {REPLY}, v AS (SELECT *, lower(coalesce(json_extract_string(parsed, '$.verdict'), '')) AS v FROM l) SELECT conv_id, turn, v AS verdict, greatest(0, least(1, coalesce(json_extract_string(parsed, '$.confidence')::DOUBLE, 0))) AS confidence, "
    "greatest(0, coalesce(json_extract_string(parsed, '$.estimated_problem_count')::INTEGER, 0)) AS problems, coalesce(json_extract_string(parsed, '$.semantic.object_type'), 'unknown') AS object_type FROM v WHERE v IN ('pass', 'needs_review', 'fail')",
)
def _(t):
    parsed = _replies(t).withColumn("parsed", tx.extract_json(F.col("reply")))
    v = rp.verdicts(parsed, "parsed", "conv_id", "turn")
    return v.select("conv_id", "turn", "verdict", "confidence", "problems", tx.nested(F.col("parsed"), "semantic.object_type", "unknown").alias("object_type"))


_LINE = (
    "CASE l_linenumber WHEN 1 THEN concat('P: 0.', CAST(l_partkey % 90 AS VARCHAR(20)), ' R: 0.', CAST(l_partkey % 80 AS VARCHAR(20))) WHEN 2 THEN concat('mAP50: 0.', CAST(l_partkey % 70 AS VARCHAR(20))) "
    "WHEN 3 THEN concat('mAP50-95: 0.', CAST(l_partkey % 60 AS VARCHAR(20))) WHEN 4 THEN CASE WHEN l_partkey % 40 = 0 THEN concat('   all  206  900  0.5 0.25 0.75 0.', CAST(l_partkey % 50 AS VARCHAR(20))) ELSE 'epoch' END ELSE 'loading' END"
)


@workload(
    "metric_logs", "P26",
    f"WITH {cte('objects')}, o AS (SELECT obj_id FROM objects), ln AS (SELECT l_suppkey AS run, concat(lpad(l_orderkey::VARCHAR, 10, '0'), lpad(l_linenumber::VARCHAR, 2, '0'), lpad(l_partkey::VARCHAR, 10, '0'), lpad(l_extendedprice::VARCHAR, 14, '0')) AS pos, {_LINE} AS line FROM lineitem), "
    "m AS (SELECT run, pos, regexp_extract(line, '^\\s*all\\s+\\d+\\s+\\d+\\s+([\\d.]+)\\s+([\\d.]+)\\s+([\\d.]+)\\s+([\\d.]+)', ['a', 'b', 'c', 'd']) AS al, regexp_extract(line, 'P[:\\s]*([\\d.]+).*R[:\\s]*([\\d.]+)', ['p', 'r']) AS pr, "
    "regexp_extract(line, 'mAP50[:\\s]*([\\d.]+)', 1) AS m5, regexp_extract(line, 'mAP50-95[:\\s]*([\\d.]+)', 1) AS m9 FROM ln), "
    "n AS (SELECT run, pos, coalesce(nullif(al.a, ''), nullif(pr.p, ''))::DOUBLE AS precision, coalesce(nullif(al.b, ''), nullif(pr.r, ''))::DOUBLE AS recall, coalesce(nullif(al.c, ''), nullif(m5, ''))::DOUBLE AS map50, coalesce(nullif(al.d, ''), nullif(m9, ''))::DOUBLE AS map50_95 FROM m) "
    "SELECT run, arg_max(precision, pos) FILTER (precision IS NOT NULL) AS precision, arg_max(recall, pos) FILTER (recall IS NOT NULL) AS recall, arg_max(map50, pos) FILTER (map50 IS NOT NULL) AS map50, arg_max(map50_95, pos) FILTER (map50_95 IS NOT NULL) AS map50_95 FROM n GROUP BY run",
)
def _(t):
    lines = t.lineitem.select(
        F.col("l_suppkey").alias("run"),
        F.expr("concat(lpad(CAST(l_orderkey AS STRING), 10, '0'), lpad(CAST(l_linenumber AS STRING), 2, '0'), lpad(CAST(l_partkey AS STRING), 10, '0'), lpad(CAST(l_extendedprice AS STRING), 14, '0'))").alias("pos"),
        F.expr(_LINE.replace("VARCHAR(20)", "STRING")).alias("line"),
    )
    return rp.last_metrics(lines, run="run", order="pos", line="line")


@workload(
    "alias_resolution", "F14",
    "WITH a AS (SELECT DISTINCT p_name AS alias, CASE WHEN p_size < 25 THEN 'verified' ELSE 'curated' END AS source_kind, p_type AS leaf FROM part WHERE p_type <> 'MEDIUM'), "
    "b AS (SELECT alias, source_kind, min(leaf) AS leaf FROM a GROUP BY ALL), l AS (SELECT l_orderkey % 3 AS g, p_name AS label, CASE l_linenumber % 2 WHEN 0 THEN 'verified' ELSE 'legacy_prompt' END AS source_kind FROM lineitem JOIN part ON p_partkey = l_partkey) "
    "SELECT leaf, count(*) AS n FROM l LEFT JOIN b ON b.alias = l.label AND b.source_kind = l.source_kind GROUP BY leaf",
)
def _(t):
    a = t.part.where("p_type <> 'MEDIUM'").groupBy(F.col("p_name").alias("alias"), F.expr("CASE WHEN p_size < 25 THEN 'verified' ELSE 'curated' END").alias("source_kind")).agg(F.min("p_type").alias("leaf"))
    l = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).selectExpr("p_name AS label", "CASE l_linenumber % 2 WHEN 0 THEN 'verified' ELSE 'legacy_prompt' END AS source_kind")
    return rp.resolve_alias(l, a).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
