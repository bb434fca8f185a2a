"""Label objects: audits, gates, review queues, sanitizing, splits and class maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.functions.boxes import BOX
from skyledger.operators import labels as lb
from skyledger.operators.profiles import side_by_side
from skyledger.workloads.bindings import IOU_SQL, cte
from skyledger.workloads.registry import workload

POLICY = lb.QualityPolicy(max_objects_per_image=36)
NAMES = "CASE class_id WHEN 0 THEN 'occupied' WHEN 1 THEN 'empty' ELSE 'parking_area' END"
KEYS = ["split", "image_id"]


def _objects(t):
    c = F.col
    coords = F.array(c("x1"), c("y1"), c("x2"), c("y1"), c("x2"), c("y2"), c("x1"), c("y2"))
    return t.objects.select("obj_id", *KEYS, "class_id", F.expr(NAMES).alias("class_name"), coords.alias("coords"))


def _flagged(t):
    return lb.flag_objects(_objects(t), POLICY)


def _sanitized(t):
    flags = ("out_of_bounds", "degenerate", "oversized", "extreme_aspect")
    return lb.sanitize(_flagged(t).select("obj_id", *KEYS, "class_id", "coords_key", *BOX, *flags), KEYS, "obj_id", POLICY)


_EX, _EY = "sqrt((x2 - x1) * (x2 - x1))", "sqrt((y2 - y1) * (y2 - y1))"
FLAGGED = (
    f"WITH {cte('objects')}, named AS (SELECT *, {NAMES} AS class_name FROM objects), "
    "fl AS (SELECT *, (x2 - x1) * (y2 - y1) AS area, (x1 < 0 OR y1 < 0 OR x2 > 1 OR y2 > 1) AS out_of_bounds, (x2 - x1) * (y2 - y1) <= 1e-8 AS degenerate, "
    "class_name <> 'parking_area' AND (x2 - x1) * (y2 - y1) >= 0.08 AS oversized, "
    f"class_name <> 'parking_area' AND greatest({_EX}, {_EY}) / least({_EX}, {_EY}) >= 8 AS extreme_aspect, "
    "(least(x1, y1) <= 1e-6 OR greatest(x2, y2) >= 1 - 1e-6 OR least(x2, y2) <= 1e-6 OR greatest(x1, y1) >= 1 - 1e-6) AS border_touching FROM named), "
    "dup AS (SELECT split, image_id, sum(n - 1)::BIGINT AS duplicates FROM (SELECT split, image_id, class_id, round(x1, 6), round(y1, 6), round(x2, 6), round(y2, 6), count(*) AS n FROM fl GROUP BY ALL) GROUP BY ALL), "
    f"con AS (SELECT a.split, a.image_id, count(*) AS class_conflicts FROM fl a JOIN fl b ON a.image_id = b.image_id AND a.obj_id < b.obj_id AND a.class_id <> b.class_id AND {IOU_SQL} >= 0.9 GROUP BY ALL), "
    "files AS (SELECT split, image_id, count(*) AS objects, count(*) FILTER (out_of_bounds) AS out_of_bounds, count(*) FILTER (degenerate) AS degenerate, "
    "count(*) FILTER (oversized) AS oversized, count(*) FILTER (extreme_aspect) AS extreme_aspect, count(*) FILTER (border_touching) AS border_touching, "
    "any_value(duplicates) AS duplicates, coalesce(any_value(class_conflicts), 0) AS class_conflicts, (count(*) > 36)::BIGINT AS overcrowded_images "
    "FROM fl JOIN dup USING (split, image_id) LEFT JOIN con USING (split, image_id) GROUP BY split, image_id)"
)
SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in lb.COUNTERS)


@workload("label_audit_files", "A15 P3 P4", f"{FLAGGED} SELECT * FROM files")
def _(t):
    return lb.audit_files(_flagged(t), KEYS, POLICY)


@workload(
    "label_audit_by_split", "A15",
    f"{FLAGGED} SELECT coalesce(split, 'all') AS split, count(*) AS label_files, {SUMS} FROM files GROUP BY ROLLUP (split)",
)
def _(t):
    return lb.audit_by_split(lb.audit_files(_flagged(t), KEYS, POLICY))


@workload(
    "label_review_queue", "A17",
    f"{FLAGGED} SELECT split, image_id, array_to_string(list_sort(list_filter([CASE WHEN out_of_bounds > 0 THEN 'OUT_OF_BOUNDS' END, CASE WHEN degenerate > 0 THEN 'DEGENERATE' END, "
    "CASE WHEN oversized > 0 THEN 'OVERSIZED_OBJECT' END, CASE WHEN extreme_aspect > 0 THEN 'EXTREME_ASPECT' END, CASE WHEN duplicates > 0 THEN 'DUPLICATE_LABEL' END, "
    "CASE WHEN class_conflicts > 0 THEN 'CLASS_CONFLICT' END, CASE WHEN overcrowded_images > 0 THEN 'OVERCROWDED_IMAGE' END], lambda x: x IS NOT NULL)), ',') AS issues "
    "FROM files WHERE out_of_bounds + degenerate + oversized + extreme_aspect + duplicates + class_conflicts + overcrowded_images > 0",
)
def _(t):
    return lb.review_queue(lb.audit_files(_flagged(t), KEYS, POLICY), KEYS)


LEAK_SQL = (
    "leak AS (SELECT concat('img_', CAST(l_orderkey // 9 AS VARCHAR), '.jpg') AS image, CASE l_orderkey // 8 % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM lineitem), "
    "leaked AS (SELECT image, count(DISTINCT split) AS splits, min(split) AS first_split, max(split) AS last_split FROM leak GROUP BY image HAVING count(DISTINCT split) > 1)"
)


def _leaked(t):
    images = t.lineitem.selectExpr(
        "concat('IMG_', CAST(l_orderkey div 9 AS STRING), '.jpg') AS image",
        "CASE l_orderkey div 8 % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split",
    )
    return lb.split_leakage(images)


@workload("split_leakage", "J15", f"WITH {LEAK_SQL} SELECT * FROM leaked")
def _(t):
    return _leaked(t)


SUMMARY_SQL = (
    f"{FLAGGED}, {cte('log')}, {LEAK_SQL}, tot AS (SELECT {SUMS}, count(*) FILTER (split = 'test') AS test_images FROM files), "
    "st AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY noted DESC, rec_id DESC) = 1), "
    "prov AS (SELECT count(*) AS reviewed, count(*) FILTER (NOT is_auto) AS human FROM st WHERE label <> '') "
)


def _summary(t):
    from skyledger.operators.reviews import latest_state

    files = lb.audit_files(_flagged(t), KEYS, POLICY)
    totals = files.agg(*[F.sum(c).alias(c) for c in lb.COUNTERS], F.count_if(F.col("split") == "test").alias("test_images"))
    leaks = _leaked(t).agg(F.count(F.lit(1)).alias("leaked_images"))
    state = latest_state(t.log, key="target_id", order=["noted", "rec_id"]).where(F.col("label") != "")
    provenance = state.agg(F.count(F.lit(1)).alias("reviewed"), F.count_if(~F.col("is_auto")).alias("human"))
    return side_by_side(totals, leaks, provenance).withColumns({
        "malformed": F.lit(0), "split_mode": F.lit("stable_hash"), "golden_approved": F.lit(False),
        "conversion": F.lit("AABB to four-corner OBB"), "source_dataset": F.lit("survey export"),
    })


_R = "round({c} / objects, 6)"
ISSUES_SQL = (
    SUMMARY_SQL + ", rules AS (SELECT unnest(["
    "{'s': 'error', 'c': 'INVALID_GEOMETRY', 'f': out_of_bounds + degenerate > 0, 'a': (out_of_bounds + degenerate)::DOUBLE, 'l': 0::DOUBLE}, "
    "{'s': 'error', 'c': 'OVERSIZED_OBJECTS', 'f': oversized / objects > 0.005, 'a': round(oversized / objects, 6), 'l': 0.005}, "
    "{'s': 'error', 'c': 'EXTREME_ASPECT', 'f': extreme_aspect / objects > 0.01, 'a': round(extreme_aspect / objects, 6), 'l': 0.01}, "
    "{'s': 'error', 'c': 'DUPLICATE_LABELS', 'f': duplicates / objects > 0.005, 'a': round(duplicates / objects, 6), 'l': 0.005}, "
    "{'s': 'error', 'c': 'CLASS_CONFLICTS', 'f': class_conflicts / objects > 0.002, 'a': round(class_conflicts / objects, 6), 'l': 0.002}, "
    "{'s': 'error', 'c': 'SPLIT_LEAKAGE', 'f': (SELECT count(*) FROM leaked) > 0, 'a': (SELECT count(*) FROM leaked)::DOUBLE, 'l': 0}, "
    "{'s': 'error', 'c': 'TEST_SET_TOO_SMALL', 'f': test_images < 100, 'a': test_images::DOUBLE, 'l': 100}, "
    "{'s': 'error', 'c': 'AABB_TO_OBB_INVALID', 'f': true, 'a': NULL, 'l': NULL}, {'s': 'error', 'c': 'TEST_SET_NOT_FIXED', 'f': true, 'a': NULL, 'l': NULL}, "
    "{'s': 'error', 'c': 'GOLDEN_SET_NOT_APPROVED', 'f': true, 'a': NULL, 'l': NULL}, "
    "{'s': 'error', 'c': 'HUMAN_REVIEW_TOO_LOW', 'f': human / reviewed < 0.05, 'a': round(human / reviewed, 6), 'l': 0.05}, "
    "{'s': 'warning', 'c': 'MANY_BORDER_OBJECTS', 'f': border_touching / objects > 0.05, 'a': round(border_touching / objects, 6), 'l': 0.05}, "
    "{'s': 'warning', 'c': 'OVERCROWDED_IMAGES', 'f': overcrowded_images > 0, 'a': overcrowded_images::DOUBLE, 'l': 0}]) AS r FROM tot, prov), "
    "issues AS (SELECT r.s AS severity, r.c AS code, CAST(r.a AS DOUBLE) AS actual, CAST(r.l AS DOUBLE) AS \"limit\" FROM rules WHERE r.f) "
)


@workload("quality_issues", "A16", ISSUES_SQL + 'SELECT severity, code, actual, "limit" FROM issues')
def _(t):
    return lb.gate_issues(_summary(t), POLICY)


@workload(
    "quality_decision", "A16",
    ISSUES_SQL + "SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, "
    "CASE WHEN count(*) FILTER (severity = 'error') > 0 THEN 'failed' ELSE 'passed' END AS status, count(*) FILTER (severity = 'error') > 0 AS blocked FROM issues",
)
def _(t):
    return lb.gate_decision(lb.gate_issues(_summary(t), POLICY), POLICY.enforce)


@workload(
    "dataset_gates", "E21",
    "WITH a AS (SELECT c_custkey AS dataset, count(o_orderkey) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') AS errors FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey), "
    "m AS (SELECT c_custkey AS dataset, coalesce(c_custkey % 4 <> 0 AND c_custkey % 7 <> 0 AND c_nationkey <> c_custkey % 7 AND c_custkey % 5 <> 0, false) AS golden FROM customer WHERE c_custkey % 11 <> 0), "
    "g AS (SELECT dataset, coalesce(golden, false) AS golden, errors + CASE WHEN coalesce(golden, false) THEN 0 ELSE 1 END AS errors FROM a LEFT JOIN m USING (dataset)) "
    "SELECT dataset, golden, errors, CASE WHEN errors > 0 THEN 'failed' ELSE 'passed' END AS status, errors > 0 AS blocked FROM g",
)
def _(t):
    found = t.customer.select("c_custkey").join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    urgent = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")
    audits = found.groupBy(F.col("c_custkey").alias("dataset")).agg(F.count_if(urgent).alias("errors"))
    # Some are not approved, have no approver, one person for both, no date, or no manifest at all.
    manifests = t.customer.where("c_custkey % 11 <> 0").selectExpr(
        "c_custkey AS dataset", "c_custkey % 4 <> 0 AS approved", "concat('p', CAST(c_nationkey AS STRING)) AS reviewer",
        "CASE WHEN c_custkey % 7 = 0 THEN '' ELSE concat('p', CAST(c_custkey % 7 AS STRING)) END AS approver", "CASE WHEN c_custkey % 5 <> 0 THEN '2024-01-02' END AS approved_at",
    )
    return lb.dataset_gates(audits, manifests, "dataset")


@workload(
    "recovery_plan", "A19",
    f"{FLAGGED}, tot AS (SELECT {SUMS} FROM files) SELECT objects AS total_objects, degenerate + duplicates AS automatic_removals, "
    "oversized + extreme_aspect + class_conflicts AS quarantine_signals, objects - least(objects, degenerate + duplicates + oversized + extreme_aspect + class_conflicts) AS estimated_retained_objects, "
    "round((objects - least(objects, degenerate + duplicates + oversized + extreme_aspect + class_conflicts)) / objects, 4) AS estimated_retained_fraction FROM tot",
)
def _(t):
    files = lb.audit_files(_flagged(t), KEYS, POLICY)
    return lb.recovery_plan(files.agg(*[F.sum(c).alias(c) for c in lb.COUNTERS]))


_PAIR = (
    "(greatest(0, least(k.x2, x[1].x2) - greatest(k.x1, x[1].x1)) * greatest(0, least(k.y2, x[1].y2) - greatest(k.y1, x[1].y1))) / "
    "((k.x2 - k.x1) * (k.y2 - k.y1) + (x[1].x2 - x[1].x1) * (x[1].y2 - x[1].y1) - "
    "(greatest(0, least(k.x2, x[1].x2) - greatest(k.x1, x[1].x1)) * greatest(0, least(k.y2, x[1].y2) - greatest(k.y1, x[1].y1))))"
)
_RIVAL = f"(k.alive AND k.class_id <> x[1].class_id AND {_PAIR} >= 0.9)"
_PUT = "{{'id': k.id, 'class_id': k.class_id, 'x1': k.x1, 'y1': k.y1, 'x2': k.x2, 'y2': k.y2, 'alive': {a}, 'struck': {s}}}"
SANITIZE_SQL = (
    f"{FLAGGED}, ok AS (SELECT * FROM fl WHERE NOT (out_of_bounds OR degenerate OR oversized OR extreme_aspect)), "
    "firsts AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY image_id, class_id, round(x1, 6), round(y1, 6), round(x2, 6), round(y2, 6) ORDER BY obj_id) = 1), "
    "walk AS (SELECT image_id, list_reduce(list([{'id': obj_id, 'class_id': class_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'alive': true, 'struck': false}] ORDER BY obj_id), lambda acc, x: "
    f"CASE WHEN len(list_filter(acc, lambda k: {_RIVAL})) = 0 THEN list_concat(acc, x) ELSE "
    f"list_concat(list_transform(acc, lambda k: CASE WHEN {_RIVAL} THEN {_PUT.format(a='false', s='true')} ELSE k END), "
    f"list_transform(x, lambda k: {_PUT.format(a='false', s='false')})) END) AS r FROM firsts GROUP BY image_id), "
    "res AS (SELECT unnest(r) AS k FROM walk), "
    "outc AS (SELECT fl.obj_id, fl.split, fl.image_id, CASE WHEN out_of_bounds OR degenerate OR oversized OR extreme_aspect THEN 'invalid' WHEN k.id IS NULL THEN 'duplicate' "
    "WHEN k.alive THEN 'kept' ELSE 'conflict' END AS outcome, coalesce(k.struck, false) AS struck FROM fl LEFT JOIN res ON res.k.id = fl.obj_id)"
)


@workload("sanitized_objects", "A18 P37 W5", f"{SANITIZE_SQL} SELECT obj_id, image_id, outcome FROM outc")
def _(t):
    return _sanitized(t).select("obj_id", "image_id", "outcome")


@workload(
    "sanitize_stats", "A18",
    f"{SANITIZE_SQL} SELECT count(*) AS input_objects, count(*) FILTER (outcome = 'kept') AS kept_objects, count(*) FILTER (outcome = 'invalid') AS removed_invalid, "
    "count(*) FILTER (outcome = 'duplicate') AS removed_duplicate, 2 * count(*) FILTER (struck) AS removed_conflict FROM outc",
)
def _(t):
    return lb.sanitize_stats(_sanitized(t))


_LIMB = ", ".join(f"sum(('0x' || substr(d, {a}, 12))::BIGINT) AS s{i}" for i, a in enumerate([1, 13, 25, 37, 49]))


@workload(
    "dataset_fingerprint", "A20 P34",
    f"WITH dig AS (SELECT sha256(concat_ws(chr(31), CAST(doc_id AS VARCHAR), source, text)) AS d FROM documents), s AS (SELECT count(*) AS rows, {_LIMB} FROM dig) "
    "SELECT rows, sha256(concat_ws(':', rows::VARCHAR, s0::VARCHAR, s1::VARCHAR, s2::VARCHAR, s3::VARCHAR, s4::VARCHAR)) AS fingerprint FROM s",
)
def _(t):
    return lb.fingerprint(t.documents, "doc_id", "source", "text")


# Ten source classes to three.
MERGE = {
    "PROMO": "occupied", "STANDARD": "empty", "ECONOMY": "parking_area", "SMALL": "empty",
}


@workload(
    "merged_classes", "F12",
    "WITH m AS (SELECT *, CASE p_type WHEN 'PROMO' THEN 'occupied' WHEN 'STANDARD' THEN 'empty' WHEN 'ECONOMY' THEN 'parking_area' WHEN 'SMALL' THEN 'empty' END AS class_name FROM part) "
    "SELECT class_name, count(*) AS objects, sum(p_size)::BIGINT AS total_size FROM m WHERE class_name IS NOT NULL GROUP BY class_name",
)
def _(t):
    parts = t.part.select(F.col("p_type").alias("class_name"), "p_size")
    return lb.remap_classes(parts, MERGE).groupBy("class_name").agg(
        F.count(F.lit(1)).alias("objects"), F.sum("p_size").alias("total_size")
    )
