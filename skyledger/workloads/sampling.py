"""Splits, strata and repeatable samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.functions import keys as k
from skyledger.operators import sampling as sp
from skyledger.operators.profiles import strata_counts
from skyledger.workloads.bindings import cte
from skyledger.workloads.registry import workload

_NAME = "concat('2024-01-', lpad(CAST(1 + doc_id % 29 AS VARCHAR(20)), 2, '0'), '_doc', CAST(doc_id AS VARCHAR(20)), '.jpg')"
IMG = (
    f"img AS (SELECT doc_id, {_NAME} AS name, source, lang, n_chars, concat('2024-01-', lpad(CAST(1 + doc_id % 29 AS VARCHAR(20)), 2, '0')) AS day, "
    "CASE WHEN n_chars <= 500 THEN 'sparse' WHEN n_chars <= 1500 THEN 'medium' WHEN n_chars <= 4000 THEN 'dense' ELSE 'very_dense' END AS density FROM documents)"
)


def _images(t):
    size = F.col("n_chars")
    return t.documents.select(
        "doc_id", F.expr(_NAME).alias("name"), "source", "lang", "n_chars",
        F.when(size <= 500, "sparse").when(size <= 1500, "medium").when(size <= 4000, "dense").otherwise("very_dense").alias("density"),
    ).withColumn("day", k.day_of(F.col("name")))


_RATIO = "(('0x' || substr(md5(name), 1, 8))::BIGINT / 4294967295.0::DOUBLE)"


@workload(
    "hash_split", "P12",
    f"WITH {IMG}, r AS (SELECT *, {_RATIO} AS ratio FROM img) SELECT doc_id, round(ratio, 9) AS ratio, CASE WHEN ratio < 0.8 THEN 'train' WHEN ratio < 0.9 THEN 'val' ELSE 'test' END AS split, "
    "CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'test' WHEN ratio < 0.8 / (0.8 + 0.1) THEN 'train' ELSE 'val' END AS fixed_split FROM r",
)
def _(t):
    fixed = t.labels.where("quality = 1").select("doc_id").distinct().withColumn("listed", F.lit(True))
    rows = _images(t).join(fixed, "doc_id", "left")
    return rows.select(
        "doc_id", F.round(k.stable_ratio(F.col("name")), 9).alias("ratio"), k.stable_split(F.col("name")).alias("split"),
        k.stable_split(F.col("name"), fixed=F.col("listed")).alias("fixed_split"),
    )


@workload("stable_ranks", "P13", f"WITH {IMG} SELECT doc_id, sha256('golden-v1:' || name) AS rank FROM img")
def _(t):
    return _images(t).select("doc_id", k.stable_rank(F.col("name"), "golden-v1:").alias("rank"))


_CORE = "lower(trim(regexp_replace(trim(p), '[^\\p{L}\\p{N}_]+', '_', 'g'), '_'))"


@workload(
    "slugs", "P14",
    f"WITH s AS (SELECT item_id AS id, text AS p FROM benchmark UNION ALL SELECT p_partkey + 1000000, p_name FROM part), c AS (SELECT *, {_CORE} AS core FROM s) "
    "SELECT id, CASE WHEN length(core) > 60 THEN substr(core, 1, 50) || '_' || substr(md5(p), 1, 6) WHEN core = '' THEN 'default' ELSE core END AS slug FROM c",
)
def _(t):
    rows = t.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("p")).unionByName(
        t.part.select((F.col("p_partkey") + 1000000).alias("id"), F.col("p_name").alias("p"))
    )
    return rows.select("id", k.slug(F.col("p")).alias("slug"))


@workload(
    "batch_slugs", "P14 D21",
    "SELECT p_brand, concat('batch_', count(DISTINCT p_name)::VARCHAR, 'prompts_', substr(md5(string_agg(DISTINCT trim(p_name), '_' ORDER BY trim(p_name))), 1, 6)) AS slug FROM part GROUP BY p_brand",
)
def _(t):
    names = t.part.groupBy("p_brand").agg(F.array_sort(F.collect_set("p_name")).alias("prompts"))
    return names.select("p_brand", k.batch_slug(F.col("prompts")).alias("slug"))


RISK = "doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"


def _risky(t):
    toxic = t.labels.where("toxic = 1").select("doc_id").distinct().withColumn("risk", F.lit(True))
    rows = _images(t).join(toxic, "doc_id", "left").withColumn("risk", F.coalesce("risk", F.lit(False)))
    return rows.withColumn("stratum", F.concat_ws("|", "density", "lang"))


GOLDEN = (
    f"WITH {IMG}, r AS (SELECT *, {RISK} AS risk, density || '|' || lang AS stratum, sha256('golden-v1:' || name) AS h FROM img), "
    "w AS (SELECT *, CASE WHEN risk THEN 0 ELSE row_number() OVER (PARTITION BY risk, stratum ORDER BY h) END AS turn FROM r), "
    "g AS (SELECT * FROM w ORDER BY turn, CASE WHEN risk THEN h ELSE stratum END LIMIT 100) "
)


@workload("golden_sample", "T6 W8 P17", GOLDEN + "SELECT doc_id, stratum, risk, turn::INTEGER AS turn FROM g")
def _(t):
    return sp.risk_first(_risky(t), name="name", risk="risk", stratum="stratum", count=100).select("doc_id", "stratum", "risk", "turn")


@workload(
    "golden_manifest", "E22",
    GOLDEN + "SELECT count(*) AS images, count(*) FILTER (risk) AS risk_images, false AS approved, '' AS reviewer, '' AS approver, '' AS approved_at FROM g",
)
def _(t):
    from skyledger.plans.packages import unsigned_manifest

    return unsigned_manifest(sp.risk_first(_risky(t), name="name", risk="risk", stratum="stratum", count=100))


@workload(
    "golden_summary", "E22",
    GOLDEN + "SELECT 'images' AS kind, 'all' AS value, count(*) AS images FROM g UNION ALL SELECT 'images', 'risk', count(*) FROM g WHERE risk HAVING count(*) > 0 "
    "UNION ALL SELECT 'density', density, count(*) FROM g GROUP BY density UNION ALL SELECT 'signature', lang, count(*) FROM g GROUP BY lang",
)
def _(t):
    from skyledger.plans.packages import selection_summary

    return selection_summary(sp.risk_first(_risky(t), name="name", risk="risk", stratum="stratum", count=100), signature="lang")


@workload(
    "golden_package", "T6",
    GOLDEN + ", p AS (SELECT name AS image, 'pending' AS review_status, stratum, risk, density FROM g) SELECT density, count(*) AS images, count(*) FILTER (risk) AS risky, "
    "count(*) FILTER (review_status = 'pending') AS pending, min(image) AS first_image FROM p GROUP BY density",
)
def _(t):
    from skyledger.plans.packages import golden_review_rows

    chosen = sp.risk_first(_risky(t), name="name", risk="risk", stratum="stratum", count=100)
    return golden_review_rows(chosen).groupBy("density").agg(
        F.count(F.lit(1)).alias("images"), F.count_if("risk").alias("risky"),
        F.count_if(F.col("review_status") == "pending").alias("pending"), F.min("image").alias("first_image"),
    )


@workload(
    "shadow_sample", "W8 P15",
    f"WITH {IMG}, w AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY sha256('business-shadow-v1:' || name)) AS turn FROM img) "
    "SELECT doc_id, day, turn::INTEGER AS turn FROM w ORDER BY turn, sha256('business-shadow-v1:' || day) LIMIT 75",
)
def _(t):
    salt = "business-shadow-v1:"
    return sp.round_robin(
        _images(t), stratum="day", rank=k.stable_rank(F.col("name"), salt), count=75, walk=k.stable_rank(F.col("day"), salt)
    ).select("doc_id", "day", "turn")


@workload(
    "day_group_split", "W9",
    f"WITH {IMG}, d AS (SELECT day, count(*) AS images, sha256('official:' || day) AS rank FROM img GROUP BY day), "
    "a AS (SELECT *, coalesce(sum(images) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 200 AS test FROM d), "
    "b AS (SELECT *, coalesce(sum(CASE WHEN test THEN 0 ELSE images END) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a) "
    "SELECT day, images, CASE WHEN test THEN 'test' WHEN before < 150 THEN 'val' ELSE 'train' END AS split FROM b",
)
def _(t):
    return sp.day_splits(_images(t), day="day", test_count=200, val_count=150, salt="official:")


@workload(
    "e0_sample", "T5",
    "WITH r AS (SELECT doc_id, 1 + n_chars % 3 AS parts, n_chars % 7 / 2.0 AS inflation, sha256(doc_id::VARCHAR) AS h FROM documents), a AS (SELECT * FROM r WHERE parts >= 2 ORDER BY h LIMIT 100), "
    "b AS (SELECT * FROM r WHERE inflation >= 2 AND doc_id NOT IN (SELECT doc_id FROM a) ORDER BY h LIMIT 50), "
    "c AS (SELECT * FROM r WHERE parts = 1 AND doc_id NOT IN (SELECT doc_id FROM a) AND doc_id NOT IN (SELECT doc_id FROM b) ORDER BY h LIMIT 50) "
    "SELECT doc_id, 'multi_component' AS sample_group FROM a UNION ALL SELECT doc_id, 'global_obb_inflation_ge_2' FROM b UNION ALL SELECT doc_id, 'single_component' FROM c",
)
def _(t):
    rows = t.documents.selectExpr("doc_id", "1 + n_chars % 3 AS parts", "n_chars % 7 / 2.0 AS inflation")
    groups = [
        ("multi_component", F.col("parts") >= 2, 100), ("global_obb_inflation_ge_2", F.col("inflation") >= 2, 50),
        ("single_component", F.col("parts") == 1, 50),
    ]
    return sp.disjoint_groups(rows, key="doc_id", groups=groups).select("doc_id", "sample_group")


QUOTAS = {"multi_component": 12, "negative": 8, "edge": 10, "geo_spread": 14}
AOI = (
    "aoi AS (SELECT concat('aoi', o_orderkey::VARCHAR) AS aoi_id, CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE (o_custkey % 17)::VARCHAR || ':' || (o_orderkey % 3)::VARCHAR END AS geo_cell, "
    "o_orderpriority AS pr, o_orderstatus AS s FROM orders), st AS (SELECT *, sha256(aoi_id) AS h, unnest([CASE WHEN pr < '3' THEN 'multi_component' ELSE 'single_component' END, "
    "CASE WHEN s = 'F' THEN 'negative' END, CASE WHEN pr > '4' THEN 'edge' END, 'geo_spread']) AS stratum FROM aoi)"
)


@workload(
    "aoi_manifest", "T3",
    f"WITH {AOI}, q AS (SELECT unnest([{{'s': 'multi_component', 'o': 0, 'n': 12}}, {{'s': 'negative', 'o': 1, 'n': 8}}, {{'s': 'edge', 'o': 2, 'n': 10}}, {{'s': 'geo_spread', 'o': 3, 'n': 14}}]) AS q), "
    "it AS (SELECT aoi_id, geo_cell, h, stratum, q.q.o AS o, q.q.n AS n, unnest([1, 2]) AS pass FROM st JOIN q ON q.q.s = st.stratum), "
    "f AS (SELECT list_reduce(list([{'aoi': aoi_id, 'cell': geo_cell, 's': stratum, 'n': n, 'pass': pass}] ORDER BY o, pass, h), lambda acc, x: "
    "CASE WHEN len(list_filter(acc, lambda k: k.s = x[1].s)) >= x[1].n OR len(list_filter(acc, lambda k: k.aoi = x[1].aoi)) > 0 OR "
    "(x[1].pass = 1 AND (x[1].cell IS NULL OR len(list_filter(acc, lambda k: k.cell = x[1].cell)) > 0)) THEN acc ELSE list_concat(acc, x) END) AS r FROM it WHERE pass = 2 OR geo_cell IS NOT NULL) "
    "SELECT unnest(r).aoi AS aoi_id, unnest(r).s AS stratum, generate_subscripts(r, 1) AS pick FROM f",
)
def _(t):
    strata = F.array_compact(F.array(
        F.when(F.col("o_orderpriority") < "3", "multi_component").otherwise("single_component"),
        F.when(F.col("o_orderstatus") == "F", "negative"), F.when(F.col("o_orderpriority") > "4", "edge"), F.lit("geo_spread"),
    ))
    aois = t.orders.select(
        F.expr("concat('aoi', CAST(o_orderkey AS STRING))").alias("aoi_id"),
        F.expr("CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE concat(CAST(o_custkey % 17 AS STRING), ':', CAST(o_orderkey % 3 AS STRING)) END").alias("geo_cell"),
        strata.alias("strata"),
    )
    return sp.aoi_manifest(aois, QUOTAS)


DIMS = {"source": 2, "lang": 6, "density": 5, "quality": 4}
DIM_SQL = (
    f"{IMG}, dims AS (SELECT img.doc_id, source, lang, density, coalesce(l.quality::VARCHAR, 'missing') AS quality, sha256(img.doc_id::VARCHAR) AS h FROM img LEFT JOIN labels l ON l.doc_id = img.doc_id)"
)


def _dims(t):
    rows = _images(t).join(t.labels.select("doc_id", F.col("quality").cast("string").alias("quality")), "doc_id", "left")
    return rows.withColumn("quality", F.coalesce("quality", F.lit("missing")))


@workload(
    "coverage_sample", "T4 P16",
    f"WITH {DIM_SQL}, it AS (SELECT doc_id, h, 0 AS d, source AS v, 2 AS q FROM dims UNION ALL SELECT doc_id, h, 1, lang, 6 FROM dims UNION ALL SELECT doc_id, h, 2, density, 5 FROM dims "
    "UNION ALL SELECT doc_id, h, 3, quality, 4 FROM dims UNION ALL SELECT doc_id, h, 4, '', 90 FROM dims), "
    "f AS (SELECT list_reduce(list([{'id': doc_id, 'd': d, 'v': v, 'q': q}] ORDER BY d, v, h), lambda acc, x: CASE WHEN len(acc) >= 90 OR len(list_filter(acc, lambda k: k.id = x[1].id)) > 0 "
    "OR len(list_filter(acc, lambda k: k.d = x[1].d AND k.v = x[1].v)) >= x[1].q THEN acc ELSE list_concat(acc, x) END) AS r FROM it) "
    "SELECT (unnest(r).id)::VARCHAR AS doc_id, generate_subscripts(r, 1) AS pick FROM f",
)
def _(t):
    return sp.coverage_sample(_dims(t), key="doc_id", quotas=DIMS, max_samples=90)


@workload(
    "coverage_histogram", "A44 P16",
    f"WITH {DIM_SQL} SELECT 'source' AS dimension, source AS value, count(*) AS n FROM dims GROUP BY ALL UNION ALL SELECT 'lang', lang, count(*) FROM dims GROUP BY ALL "
    "UNION ALL SELECT 'density', density, count(*) FROM dims GROUP BY ALL UNION ALL SELECT 'quality', quality, count(*) FROM dims GROUP BY ALL",
)
def _(t):
    return strata_counts(_dims(t), {d: d for d in DIMS}, n=F.count(F.lit(1)))


@workload(
    "audit_strata", "P16 P15",
    f"WITH {cte('detections')} SELECT CASE WHEN least(x2 - x1, y2 - y1) < 16 THEN '<16' WHEN least(x2 - x1, y2 - y1) < 32 THEN '16-32' ELSE '>=32' END AS size, "
    "CASE WHEN confidence < 0.45 THEN 'low' WHEN confidence < 0.7 THEN 'medium' ELSE 'high' END AS confidence, "
    "CASE WHEN x1 <= 0 OR y1 <= 0 OR x2 >= 640 OR y2 >= 640 THEN 'edge' ELSE 'interior' END AS edge, count(*) AS n FROM detections GROUP BY ALL",
)
def _(t):
    from skyledger.functions import boxes as bx

    b = bx.box()
    return t.detections.groupBy(
        k.size_bucket(bx.short_side(b)).alias("size"), k.confidence_band(F.col("confidence")).alias("confidence"),
        F.when(bx.touches_edge(b, 640, 640), "edge").otherwise("interior").alias("edge"),
    ).agg(F.count(F.lit(1)).alias("n"))


@workload(
    "image_signatures", "P17",
    f"WITH {cte('detections')}, g AS (SELECT image_id, count(*) AS c, string_agg(DISTINCT class_name, '+' ORDER BY class_name) AS signature FROM detections WHERE confidence > 0.1 GROUP BY image_id) "
    "SELECT image_id, signature, CASE WHEN c <= 20 THEN 'sparse' WHEN c <= 60 THEN 'medium' WHEN c <= 100 THEN 'dense' ELSE 'very_dense' END AS density FROM g",
)
def _(t):
    per_class = t.detections.where("confidence > 0.1").groupBy("image_id", "class_name").agg(F.count(F.lit(1)).alias("n"))
    g = per_class.groupBy("image_id").agg(F.collect_set("class_name").alias("names"), F.sum("n").alias("c"))
    return g.select("image_id", k.signature(F.col("names")).alias("signature"), k.density_bucket(F.col("c")).alias("density"))


@workload(
    "aoi_strata", "P18",
    f"WITH {cte('detections')} SELECT det_id, array_to_string(list_sort(list_filter(['geo_spread', CASE WHEN det_id % 4 >= 2 THEN 'multi_component' WHEN det_id % 4 = 1 THEN 'single_component' END, "
    "CASE WHEN det_id % 6 / 2.0 >= 2 THEN 'inflated_obb' END, CASE WHEN prompt IN ('error', 'signup') THEN 'negative' END, CASE WHEN x1 <= 32 OR y1 <= 32 OR x2 >= 608 OR y2 >= 608 THEN 'edge' END], "
    "lambda s: s IS NOT NULL)), ',') AS strata FROM detections",
)
def _(t):
    from skyledger.functions import boxes as bx

    strata = sp.aoi_strata(F.col("det_id") % 4, F.expr("det_id % 6 / 2.0"), F.col("prompt"), bx.box(), ["error", "signup"], size=640)
    return t.detections.select("det_id", F.array_join(F.array_sort(strata), ",").alias("strata"))


@workload("random_unreviewed", "T7", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) ORDER BY md5('s7' || o_orderkey::VARCHAR) LIMIT 40")
def _(t):
    done = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return sp.shuffled_pick(t.orders.select("o_orderkey").join(done.distinct(), "o_orderkey", "left_anti"), "o_orderkey", "s7", 40)


@workload("image_page", "T2 T1", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30 OFFSET 60")
def _(t):
    return sp.page(t.documents.select("doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"], 60, sp.limited(30, 1, 200))


@workload(
    "evenly_spaced", "T9",
    "WITH n AS (SELECT count(*) AS n FROM customer), p AS (SELECT unnest(range(0, 37)) * (n - 1) // 36 AS p FROM n), c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS position FROM customer) "
    "SELECT c_custkey, position FROM c WHERE position - 1 IN (SELECT p FROM p)",
)
def _(t):
    return sp.evenly_spaced(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"], 37).select("c_custkey", "position")


@workload(
    "hard_negative_mix", "T10",
    "WITH neg AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i, count(*) OVER () AS n FROM customer WHERE c_acctbal < 0), "
    "m AS (SELECT c_custkey, unnest(range(1, CAST(greatest(0, floor((ceil(1500 * 0.4 / 0.6) - i) / n) + 1) AS BIGINT) + 1)) AS copy FROM neg) SELECT c_custkey, copy::INTEGER AS copy FROM m",
)
def _(t):
    negatives = t.customer.where("c_acctbal < 0").select("c_custkey")
    return sp.mix_negatives(negatives, ["c_custkey"], positives=1500, fraction=0.4)


@workload(
    "top_risks", "T8",
    "SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS critical, count(*) AS problems FROM lineitem GROUP BY l_suppkey ORDER BY critical DESC, problems DESC, l_suppkey LIMIT 20",
)
def _(t):
    g = t.lineitem.groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("critical"), F.count(F.lit(1)).alias("problems"))
    return g.orderBy(F.desc("critical"), F.desc("problems"), "l_suppkey").limit(20)


@workload(
    "baseline_list", "T11",
    "WITH b AS (SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name) SELECT p_name, p_partkey FROM b ORDER BY NOT contains(p_name, 'widget'), NOT contains(p_name, 'large'), p_name LIMIT 10",
)
def _(t):
    from skyledger.operators.ordered import keep_first

    b = keep_first(t.part.select("p_name", "p_partkey"), ["p_name"], ["p_partkey"])
    prefer = [~F.col("p_name").contains("widget"), ~F.col("p_name").contains("large"), "p_name"]
    return b.orderBy(*prefer).limit(10)


@workload(
    "frames_per_split", "T12",
    f"WITH {IMG} SELECT doc_id, lang FROM img QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('space:' || name)) <= 25",
)
def _(t):
    from skyledger.operators.ordered import top_per_group

    return top_per_group(_images(t), ["lang"], [k.stable_rank(F.col("name"), "space:")], 25).select("doc_id", "lang")


@workload(
    "video_frames", "W10",
    f"WITH {cte('frames')}, f AS (SELECT track_id, frame_id, row_number() OVER (PARTITION BY track_id ORDER BY t, frame_id) - 1 AS i FROM frames) SELECT track_id, frame_id, i AS frame_index FROM f WHERE i % 7 = 0 AND i < 7 * 5",
)
def _(t):
    from skyledger.operators.ordered import ordered_scan

    f = ordered_scan(t.frames.select("track_id", "frame_id", "t"), ["track_id"], ["t", "frame_id"], rank="frame_index")
    f = f.withColumn("frame_index", F.col("frame_index") - 1)
    return sp.every_kth(f, group="track_id", index="frame_index", stride=7, cap=5).select("track_id", "frame_id", "frame_index")
