"""Streams, shape evidence, crops, windows and set checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.functions import boxes as bx
from skyledger.operators import arrangement as ar
from skyledger.operators import agreement as ag
from skyledger.operators import reviews as rv
from skyledger.operators.ordered import nearest_rank
from skyledger.plans import evidence as ev
from skyledger.session import scratch_path
from skyledger.streaming import jobs
from skyledger.workloads.bindings import cte
from skyledger.workloads.boxes import CROSS_PAIRS, D, MATCH_SQL, SPLIT, _first, _second
from skyledger.workloads.registry import WORKLOADS, workload

DET = cte("detections")


def _landed(t, df, label):
    """Data as it lands for a stream: files in one folder, as many as the table has tasks."""
    path = scratch_path(t.spark, label)
    df.write.parquet(path)
    return path


def _ck(t):
    return scratch_path(t.spark, "progress")


@workload(
    "stream_live_state", "R1 R2",
    f"WITH {cte('log')} SELECT target_id, rec_id, label, is_auto FROM log QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY CASE WHEN is_auto THEN 0 ELSE 1 END DESC, noted DESC, rec_id DESC) = 1",
)
def _(t):
    log = t.log.select("target_id", "rec_id", "noted", "label", "is_auto")
    # Landed in as many files as the session has shuffle partitions and played in four batches, each of which has rows of many targets.
    files = max(4, int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    out = jobs.live_state(
        t.spark, _landed(t, log.repartition(files), "journal"), log.schema, scratch_path(t.spark, "state"), _ck(t), key="target_id", order=["noted", "rec_id"],
        max_files=-(-files // 4), buckets=16, max_layers=2,
    )
    return out.select("target_id", "rec_id", "label", "is_auto")


@workload("stream_screening", "R3 S20", f"WITH {DET} SELECT det_id, round(confidence, 6) AS confidence FROM detections WHERE confidence >= 0.2")
def _(t):
    d = t.detections.select("det_id", "confidence")
    path = _landed(t, d.unionByName(d.where("confidence > 0.5")), "arrivals")
    out = jobs.incremental(t.spark, path, d.schema, scratch_path(t.spark, "screened"), _ck(t), key="det_id", screen=lambda s: s.where("confidence >= 0.2"))
    return out.select("det_id", F.round("confidence", 6).alias("confidence"))


@workload(
    "stream_activity", "R4",
    # A twentieth of the events of the first two thirds of the time arrives after all others; windows count them as late where the watermark had passed.
    "WITH e AS (SELECT ts, event_type, event_id % 20 = 7 AND ts < (SELECT min(ts) + (max(ts) - min(ts)) * 2 / 3 FROM events) AS slow FROM events), m AS (SELECT max(ts) FILTER (NOT slow) - INTERVAL 2 HOUR AS seen, max(ts) - INTERVAL 2 HOUR AS done FROM e), "
    "w AS (SELECT date_trunc('hour', ts) AS start, event_type, slow AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= seen AS late, done FROM e, m) "
    "SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) FILTER (NOT late) AS n, count(*) FILTER (late) AS late, CASE WHEN start + INTERVAL 1 HOUR <= done THEN 'final' ELSE 'provisional' END AS state FROM w GROUP BY start, event_type, done",
)
def _(t):
    e = t.events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id")
    first, last = e.agg(F.min("ts"), F.max("ts")).first()
    slow = (F.col("event_id") % 20 == 7) & (F.col("ts") < F.lit(first + (last - first) * 2 / 3))
    path, base, progress = scratch_path(t.spark, "activity"), scratch_path(t.spark, "windows"), _ck(t)
    for part in (e.where(~slow), e.where(slow)):
        part.select("ts", "event_type").write.mode("append").parquet(path)
        stream = jobs.read_stream(t.spark, path, e.drop("event_id").schema)
        out = jobs.activity_windows(stream, base, progress, time="ts", width="1 hour", lateness=7200, by=["event_type"], buckets=16)
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "late", "state")


@workload("stream_label_counters", "R5", f"WITH {cte('log')} SELECT label, count(*) AS n, count(*) FILTER (is_auto) AS auto FROM log GROUP BY label")
def _(t):
    log = t.log.select("label", "is_auto")
    stream = jobs.read_stream(t.spark, _landed(t, log, "labels"), log.schema)
    totals = stream.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_auto").alias("auto"))
    return jobs.running_totals(totals, scratch_path(t.spark, "totals"), _ck(t))


@workload(
    "stream_frame_positions", "R6 J7",
    f"WITH {cte('frames')}, q AS (SELECT * FROM frames WHERE kind = 'purchase'), p AS (SELECT * FROM frames WHERE kind = 'view'), c AS (SELECT q.frame_id, p.frame_id AS position_id, abs(p.t - q.t) AS delta FROM q JOIN p ON p.track_id = q.track_id AND abs(p.t - q.t) <= 5), "
    "b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY delta, position_id) = 1) SELECT q.frame_id, position_id, CASE WHEN delta <= 1 THEN 'srt_frame' WHEN delta <= 5 THEN 'srt_interpolated' ELSE 'none' END AS match FROM q LEFT JOIN b USING (frame_id)",
)
def _(t):
    f = t.frames
    asks = f.where("kind = 'purchase'").select("track_id", "frame_id", "t")
    stream = jobs.read_stream(t.spark, _landed(t, asks, "frames"), asks.schema, max_files=2)
    positions = f.where("kind = 'view'").withColumn("position_id", F.col("frame_id"))
    out = jobs.frame_positions(
        stream, positions, scratch_path(t.spark, "matched"), _ck(t), key=["track_id"], frame_id="frame_id", time="t", order="frame_id", payload=["position_id"]
    )
    return out.select("frame_id", "position_id", "match")


# ---- shape evidence ----------------------------------------------------------------------------------

ARR = (
    "ce AS (SELECT {k}, det_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM {src}), sv AS (SELECT {k}, count(*) AS n, var_samp(cx) AS a, covar_samp(cx, cy) AS b, var_samp(cy) AS c FROM ce GROUP BY {k}), "
    "eg AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS lg, (a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b) AS sm FROM sv), "
    "ax AS (SELECT *, CASE WHEN abs(b) < 1e-12 THEN CASE WHEN a >= c THEN 1 ELSE 0 END ELSE lg - c END AS ux, CASE WHEN abs(b) < 1e-12 THEN CASE WHEN a >= c THEN 0 ELSE 1 END ELSE b END AS uy FROM eg), "
    "pj AS (SELECT ce.{k}, (cx * ux + cy * uy) / sqrt(ux * ux + uy * uy) AS p FROM ce JOIN ax ON ax.{k} = ce.{k} WHERE n >= 3), gq AS (SELECT {k}, p - lag(p) OVER (PARTITION BY {k} ORDER BY p) AS gap FROM pj), "
    "gp AS (SELECT {k}, avg(gap) AS m, stddev_pop(gap) AS sd FROM gq WHERE gap IS NOT NULL GROUP BY {k}), "
    "ar AS (SELECT ax.{k}, n AS vehicle_count, CASE WHEN n < 3 THEN 0 ELSE lg / greatest(sm, 1e-6) END AS alignment_ratio, CASE WHEN n < 3 OR m <= 0 THEN 0 ELSE greatest(0, 1 - sd / m) END AS spacing_consistency FROM ax LEFT JOIN gp ON gp.{k} = ax.{k}), "
    "st AS (SELECT *, CASE WHEN vehicle_count < 3 THEN 0 ELSE greatest(0, least(1, 0.5 * least(1, vehicle_count / 4) + 0.3 * least(1, greatest(0, alignment_ratio - 1) / 4) + 0.2 * spacing_consistency)) END AS strength FROM ar)"
)


@workload(
    "vehicle_arrangement", "A25",
    f"WITH {DET}, {ARR.format(k='image_id', src='detections')} SELECT image_id, vehicle_count, round(alignment_ratio, 5) AS alignment_ratio, round(spacing_consistency, 5) AS spacing_consistency, round(strength, 5) AS strength FROM st",
)
def _(t):
    out = ar.vehicle_arrangement(t.detections, "image_id", "det_id")
    return out.withColumns({c: F.round(c, 5) for c in ("alignment_ratio", "spacing_consistency", "strength")})


@workload(
    "marking_consensus", "A26",
    f"WITH {DET}, s AS (SELECT image_id, x2 - x1 AS dx, (det_id % 3 - 1) * (y2 - y1) AS dy FROM detections), a AS (SELECT image_id, sqrt(dx * dx + dy * dy) AS len, CASE WHEN atan2(dy, dx) < 0 THEN atan2(dy, dx) + pi() ELSE atan2(dy, dx) END AS ang FROM s), "
    "b AS (SELECT image_id, least(17, floor(ang / (pi() / 18))) AS bin, count(*) AS m FROM a WHERE len BETWEEN 15 AND 120 GROUP BY ALL) SELECT image_id, sum(m)::BIGINT AS segments, round(max(m) / sum(m), 6) AS consensus, round(least(1, sum(m) / 6) * (max(m) / sum(m)), 6) AS strength FROM b GROUP BY image_id",
)
def _(t):
    s = t.detections.selectExpr("image_id", "x1", "y1", "x2", "y1 + (det_id % 3 - 1) * (y2 - y1) AS y2")
    return ar.orientation_consensus(s, "image_id").withColumns({c: F.round(c, 6) for c in ("consensus", "strength")})


@workload("vehicle_rows", "E8")
def _(t):
    boxes = t.detections.select("image_id", "det_id", *bx.BOX)
    rows = ar.vehicle_rows(boxes, "image_id", "det_id")
    return rows.select("image_id", "row_no", "det_id", F.round("angle", 4).alias("angle"))


@workload(
    "image_evidence", "A25 J12",
    f"{D}, {SPLIT}, {CROSS_PAIRS}, {MATCH_SQL}, {cte('layers')}, px AS (SELECT DISTINCT image, part, y, unnest(range(x0, x1)) AS x FROM layers WHERE layer = 'facility'), cd AS (SELECT DISTINCT image, part FROM px), "
    "ag AS (SELECT f.image_id AS image, f.det_id, (f.x1 + s.x1) / 2 / 10 AS x1, (f.x2 + s.x2) / 2 / 10 AS x2, (f.y1 + s.y1) / 2 / 20 AS y1, (f.y2 + s.y2) / 2 / 20 AS y2 FROM matched JOIN f ON f.det_id = m.a JOIN s ON s.det_id = m.b), "
    "ins AS (SELECT ag.*, px.part, ag.image * 10 + px.part AS k FROM ag JOIN px ON px.image = ag.image AND px.y = round_even((y1 + y2) / 2, 0) AND px.x = round_even((ag.x1 + ag.x2) / 2, 0)), "
    f"{ARR.format(k='k', src='ins')} SELECT cd.image, cd.part, coalesce(vehicle_count, 0) AS vehicle_count, round(coalesce(strength, 0), 5) AS strength FROM cd LEFT JOIN st ON st.k = cd.image * 10 + cd.part",
)
def _(t):
    return _evidence(t).withColumn("strength", F.round("strength", 5))


def _evidence(t):
    agreed = ag.agreed_detections(_first(t), _second(t), image="image_id", id_col="det_id", confidence="confidence")
    scaled = agreed.select(F.col("image_id").alias("image"), F.col("first_id").alias("det_id"), *[(F.col(c) / d).alias(c) for c, d in (("x1", 10), ("y1", 20), ("x2", 10), ("y2", 20))])
    candidates = t.layers.where("layer = 'facility'").select("image", "part", "y", "x0", "x1")
    return ev.image_evidence(scaled, candidates, image="image", mask="part", id_col="det_id")


@workload(
    "evidence_signals", "E19",
    f"WITH ie AS ({WORKLOADS['image_evidence'].sql}) SELECT image * 10 + part AS candidate_id, 'parking_marking' AS kind, 'parallel_lines' AS source_id, 'classical_image_geometry' AS independence_group, "
    "((image * 3 + part) % 10 / 10.0)::DOUBLE AS strength FROM ie UNION ALL SELECT image * 10 + part, 'vehicle_arrangement', 'two_detectors', 'vehicle_detectors', strength FROM ie",
)
def _(t):
    facts = _evidence(t).withColumns({"candidate": F.col("image") * 10 + F.col("part"), "marking_strength": ((F.col("image") * 3 + F.col("part")) % 10 / 10.0).cast("double")})
    return ev.evidence_signals(facts, candidate="candidate").withColumn("strength", F.round("strength", 5))


# ---- boxes and windows -------------------------------------------------------------------------------

@workload(
    "tile_windows", "P31",
    "WITH i AS (SELECT p_partkey, 300 + p_size * 17 AS w, 200 + p_size * 11 AS h FROM part), a AS (SELECT *, least(400, w) AS tw, least(400, h) AS th FROM i), "
    "x AS (SELECT p_partkey, w, h, tw, th, unnest(list_distinct(list_append(range(0, w - tw + 1, tw - least(100, tw - 1)), w - tw))) AS x1 FROM a), y AS (SELECT *, unnest(list_distinct(list_append(range(0, h - th + 1, th - least(100, th - 1)), h - th))) AS y1 FROM x) "
    "SELECT p_partkey, x1, y1, x1 + tw AS x2, y1 + th AS y2 FROM y",
)
def _(t):
    i = t.part.selectExpr("p_partkey", "300 + p_size * 17 AS w", "200 + p_size * 11 AS h")
    return ar.tile_windows(i, width="w", height="h", tile=400, overlap=100).select("p_partkey", "x1", "y1", "x2", "y2")


@workload(
    "crop_boxes", "P32",
    f"WITH {DET}, c AS (SELECT det_id, greatest(0, floor(x1 - (x2 - x1) * 0.15)) AS l, greatest(0, floor(y1 - (y2 - y1) * 0.15)) AS tp, least(640, ceil(x2 + (x2 - x1) * 0.15)) AS r, least(640, ceil(y2 + (y2 - y1) * 0.15)) AS b FROM detections) "
    "SELECT det_id, l::BIGINT AS \"left\", tp::BIGINT AS top, r::BIGINT AS \"right\", b::BIGINT AS bottom FROM c",
)
def _(t):
    names = ("left", "top", "right", "bottom")
    crop = bx.padded_crop(bx.box(), 0.15, 640, 640)
    return t.detections.select("det_id", *[c.cast("bigint").alias(n) for c, n in zip(crop, names)])


@workload(
    "centre_boxes", "P6 P35",
    "WITH b AS (SELECT l_suppkey, (l_partkey % 90 + 5) / 100.0::DOUBLE AS cx, (l_suppkey % 90 + 5) / 100.0::DOUBLE AS cy, l_discount / 2 + 0.01 AS w, l_tax / 2 + 0.01 AS h, l_linenumber AS c FROM lineitem) SELECT CASE c WHEN 2 THEN 0 ELSE 1 END AS class_id, count(*) AS boxes, round(sum((cx - w / 2) * 640), 2) AS lefts, "
    "count(*) FILTER (cx - w / 2 >= -1e-6 AND cx + w / 2 <= 1 + 1e-6 AND cy - h / 2 >= -1e-6 AND cy + h / 2 <= 1 + 1e-6) AS inside FROM b WHERE c IN (1, 2) GROUP BY ALL",
)
def _(t):
    c = F.col
    b = t.lineitem.where("l_linenumber IN (1, 2)").select(
        ((c("l_partkey") % 90 + 5) / 100.0).alias("cx"), ((c("l_suppkey") % 90 + 5) / 100.0).alias("cy"),
        (c("l_discount") / 2 + 0.01).alias("w"), (c("l_tax") / 2 + 0.01).alias("h"), F.when(c("l_linenumber") == 2, 0).otherwise(1).alias("class_id"),
    )
    x1, y1, x2, y2 = bx.center_to_corners(c("cx"), c("cy"), c("w"), c("h"))
    inside = (x1 >= -1e-6) & (y1 >= -1e-6) & (x2 <= 1 + 1e-6) & (y2 <= 1 + 1e-6)
    left = bx.center_to_corners(c("cx"), c("cy"), c("w"), c("h"), 640, 640)[0]
    return b.groupBy("class_id").agg(F.count(F.lit(1)).alias("boxes"), F.round(F.sum(left), 2).alias("lefts"), F.count_if(inside).alias("inside"))


# ---- totals, unions and set checks -------------------------------------------------------------------

@workload(
    "positive_metric_quantiles", "A43 A3",
    f"WITH {cte('index', 'log')}, ".replace("index AS (", '"index" AS (')
    + "st AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY noted DESC, rec_id DESC) = 1), p AS (SELECT i.* FROM \"index\" i JOIN st USING (target_id) WHERE label IN ('accept', 'hard_positive')), "
    "m AS (SELECT 'confidence' AS metric, confidence AS v FROM p UNION ALL SELECT 'prompt_hits', prompt_hits::DOUBLE FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY metric) AS n FROM m WHERE v IS NOT NULL) "
    "SELECT metric, max(n) AS n, max(CASE WHEN i = round_even((n - 1) * 0.1, 0) THEN v END) AS p10, max(CASE WHEN i = round_even((n - 1) * 0.5, 0) THEN v END) AS p50, max(CASE WHEN i = round_even((n - 1) * 0.9, 0) THEN v END) AS p90 FROM r GROUP BY metric",
)
def _(t):
    state = rv.latest_state(t.log, key="target_id", order=["noted", "rec_id"]).where(F.col("label").isin(list(rv.POSITIVE_LABELS)))
    p = t.index.join(state, "target_id", "left_semi").select("target_id", "confidence", F.col("prompt_hits").cast("double").alias("prompt_hits"))
    return nearest_rank(p.unpivot(["target_id"], ["confidence", "prompt_hits"], "metric", "v"), ["metric"], "v", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


@workload(
    "qualified_anchors", "A46",
    "WITH a AS (SELECT DISTINCT l_orderkey // 100 AS aoi, 'a' || (l_partkey % 50)::VARCHAR AS anchor FROM lineitem WHERE l_returnflag <> 'N') SELECT aoi, string_agg(anchor, ',' ORDER BY anchor) AS anchors FROM a GROUP BY aoi",
)
def _(t):
    f = t.lineitem.where("l_returnflag <> 'N'").selectExpr("l_orderkey div 100 AS aoi", "array(concat('a', CAST(l_partkey % 50 AS STRING))) AS anchors")
    # Distinct before collecting: the list holds each anchor once.
    flat = f.select("aoi", F.explode("anchors").alias("a")).distinct()
    return flat.groupBy("aoi").agg(F.array_join(F.array_sort(F.collect_list("a")), ",").alias("anchors"))


@workload(
    "map_registry", "A47",
    "SELECT p_brand, count(DISTINCT p_type) AS areas, count(DISTINCT p_name) AS waypoints, bool_and(p_size > 0) AS valid FROM part GROUP BY p_brand",
)
def _(t):
    # A registry file is a JSON object of named areas and waypoints with a size.
    named = lambda c: F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.col(c).alias("k"), F.lit(1).alias("v")))))
    text = t.part.groupBy("p_brand").agg(F.to_json(F.struct(named("p_type").alias("areas"), named("p_name").alias("waypoints"), F.min("p_size").alias("size"))).alias("body"))
    parsed = text.select("p_brand", F.from_json("body", "areas map<string,int>, waypoints map<string,int>, size int").alias("m"))
    count = lambda c: F.size(F.map_keys(f"m.{c}")).cast("bigint")
    return parsed.select("p_brand", count("areas").alias("areas"), count("waypoints").alias("waypoints"), (F.col("m.size") > 0).alias("valid"))


@workload(
    "unknown_ids", "U4 J16",
    "SELECT DISTINCT l_orderkey AS aoi_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_custkey FROM orders)",
)
def _(t):
    known = t.orders.select(F.col("o_custkey").alias("aoi_id"))
    return rv.pending(t.lineitem.select(F.col("l_orderkey").alias("aoi_id")).distinct(), known, "aoi_id")


@workload(
    "exclusion_layer_union", "U1 M2",
    f"WITH {cte('layers')}, px AS (SELECT DISTINCT image, y, unnest(range(x0, x1)) AS x FROM layers WHERE layer IN ('road', 'band')) SELECT image, count(*) AS area FROM px GROUP BY image",
)
def _(t):
    from skyledger.operators.masks import merge_runs

    buildings = t.layers.where("layer = 'band'").select("image", "y", "x0", "x1", F.lit(1).alias("height"))
    roads = t.layers.where("layer = 'road'").select("image", "y", "x0", "x1")
    both = buildings.unionByName(roads, allowMissingColumns=True)
    return merge_runs(both, ["image"]).groupBy("image").agg(F.sum(F.col("x1") - F.col("x0")).alias("area"))


@workload(
    "acceptance_sheet", "",
    "SELECT concat('img', doc_id::VARCHAR) AS image, concat('cmp', doc_id::VARCHAR) AS comparison, '' AS reviewer FROM documents ORDER BY sha256(doc_id::VARCHAR) LIMIT 30",
)
def _(t):
    from skyledger.functions.keys import stable_rank
    from skyledger.plans.packages import acceptance_sheet

    records = t.documents.selectExpr("doc_id", "concat('img', CAST(doc_id AS STRING)) AS image", "concat('cmp', CAST(doc_id AS STRING)) AS comparison")
    return acceptance_sheet(records, [stable_rank(F.col("doc_id").cast("string"))]).select("image", "comparison", "reviewer")


@workload(
    "aoi_candidates", "D10 P18",
    "WITH b AS (SELECT concat('block_z19_br', CAST(o_custkey // 10 AS VARCHAR), '_bc', CAST(o_custkey % 10 AS VARCHAR), '_r1_c2') AS aoi_id, (o_custkey // 10 // 32)::VARCHAR || ':' || (o_custkey % 10 // 32)::VARCHAR AS geo_cell, "
    "CASE WHEN o_orderkey % 5 >= 2 THEN 'multi_component' WHEN o_orderkey % 5 = 1 THEN 'single_component' END AS a, CASE WHEN o_orderpriority = '1-URGENT' THEN 'negative' END AS n, CASE WHEN o_orderkey % 40 <= 1 THEN 'edge' END AS e FROM orders), "
    "u AS (SELECT aoi_id, geo_cell, unnest([a, n, e, 'geo_spread']) AS s FROM b) SELECT aoi_id, geo_cell, string_agg(DISTINCT s, ',' ORDER BY s) AS strata, count(*) FILTER (s = 'geo_spread') AS targets FROM u WHERE s IS NOT NULL GROUP BY ALL",
)
def _(t):
    index = t.orders.selectExpr(
        "o_orderkey AS target_id", "concat('block_z19_br', CAST(o_custkey div 10 AS STRING), '_bc', CAST(o_custkey % 10 AS STRING), '_r1_c2.png') AS image",
        "CAST(o_orderkey % 40 + 31 AS DOUBLE) AS x1", "100e0 AS y1", "200e0 AS x2", "200e0 AS y2",
    )
    state = t.orders.selectExpr("o_orderkey AS target_id", "CASE WHEN o_orderpriority = '1-URGENT' THEN 'hard_negative' ELSE 'accept' END AS label")
    metrics = t.orders.selectExpr("o_orderkey AS target_id", "o_orderkey % 5 AS valid_components", "0e0 AS global_obb_area_ratio")
    out = ev.aoi_candidates(index, state, metrics, ["hard_negative"])
    return out.select("aoi_id", "geo_cell", F.array_join("strata", ",").alias("strata"), "targets")
