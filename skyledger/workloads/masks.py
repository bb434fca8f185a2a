"""Run-table masks: measures, components, set algebra, zoning and exclusions."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.functions import boxes as bx
from skyledger.operators import masks as mk
from skyledger.plans import zoning as zn
from skyledger.workloads.bindings import cte
from skyledger.workloads.registry import workload

W, H = 64, 40


def _len():
    return F.sum(F.col("x1") - F.col("x0"))



def _layer(t, name):
    return t.layers.where(F.col("layer") == name).select("image", "y", "x0", "x1")


# The SQL twins work on single pixels, independently of runs.
PIX = f"{cte('layers')}, px AS (SELECT DISTINCT image, layer, y, unnest(range(x0, x1)) AS x FROM layers)"
BASE = f"WITH RECURSIVE {PIX}"


def _components(name: str, source: str, group: str = "image") -> str:
    """CTEs that give every pixel of `source` (group, y, x) its 8-neighbour component as (cy, cx)."""
    near = ", ".join(f"({dy}, {dx})" for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0))
    return (
        f"{name}_n AS MATERIALIZED (SELECT {group}, y, x, row_number() OVER (ORDER BY {group}, y, x) AS id FROM {source}), "
        f"{name}_e AS MATERIALIZED (SELECT a.id AS u, b.id AS v FROM {name}_n a, (VALUES {near}) o(dy, dx), {name}_n b WHERE b.{group} = a.{group} AND b.y = a.y + o.dy AND b.x = a.x + o.dx), "
        f"{name}_c(id, comp) USING KEY (id) AS (SELECT id, id FROM {name}_n UNION (SELECT e.v, min(c.comp) FROM {name}_c c JOIN {name}_e e ON e.u = c.id JOIN recurring.{name}_c r ON r.id = e.v WHERE c.comp < r.comp GROUP BY e.v)), "
        f"{name} AS MATERIALIZED (SELECT n.{group}, n.y, n.x, f.y AS cy, f.x AS cx, c.comp FROM {name}_n n JOIN {name}_c c USING (id) JOIN {name}_n f ON f.id = c.comp)"
    )


def _retained(name: str, source: str, least: int, group: str = "image") -> str:
    return (
        _components(f"{name}_all", source, group)
        + f", {name} AS MATERIALIZED (SELECT * FROM {name}_all WHERE comp IN (SELECT comp FROM {name}_all GROUP BY comp HAVING count(*) >= {least}))"
    )


MASK_PX = f"WITH RECURSIVE {cte('runs')}, px AS (SELECT DISTINCT mask_id, y, unnest(range(x0, x1)) AS x FROM runs)"


@workload(
    "mask_measures", "M1 M2 D14",
    f"{MASK_PX} SELECT mask_id, count(*) AS area, min(x) AS \"left\", min(y) AS top, max(x) + 1 AS \"right\", max(y) + 1 AS bottom, bool_or(y = 0 OR y = 39 OR x = 0 OR x >= 69) AS touches_border FROM px GROUP BY mask_id",
)
def _(t):
    return mk.measure(mk.merge_runs(t.runs, ["mask_id"]), ["mask_id"], 70, H)


@workload("mask_unions", "M2", f"{MASK_PX}, g AS (SELECT *, x - row_number() OVER (PARTITION BY mask_id, y ORDER BY x) AS k FROM px) SELECT mask_id, y, min(x) AS x0, max(x) + 1 AS x1 FROM g GROUP BY mask_id, y, k")
def _(t):
    return mk.merge_runs(t.runs, ["mask_id"])


@workload(
    "mask_components", "M3 M8",
    f"{MASK_PX}, {_components('cc', 'px', 'mask_id')} SELECT mask_id, cy AS first_y, cx AS first_x, count(*) AS area, min(x) AS \"left\", min(y) AS top, max(x) + 1 AS \"right\", max(y) + 1 AS bottom FROM cc GROUP BY ALL",
)
def _(t):
    stats = mk.component_stats(mk.label_components(mk.merge_runs(t.runs, ["mask_id"]), ["mask_id"]), ["mask_id"])
    return stats.select("mask_id", F.col("component.y").alias("first_y"), F.col("component.x0").alias("first_x"), "area", "left", "top", "right", "bottom")


@workload(
    "mask_profiles", "M4",
    f"{MASK_PX}, {_components('cc', 'px', 'mask_id')}, s AS (SELECT mask_id, comp, count(*) AS a FROM cc GROUP BY ALL), m AS (SELECT mask_id, sum(a)::BIGINT AS mask_area, count(*) AS components, max(a) AS largest FROM s GROUP BY mask_id) "
    "SELECT m.mask_id, mask_area, components, count(*) FILTER (a >= greatest(4, ceil(mask_area * 0.02))) AS material_components, round(any_value(largest) / mask_area, 6) AS largest_component_fraction FROM m JOIN s USING (mask_id) GROUP BY m.mask_id, mask_area, components",
)
def _(t):
    out = mk.mask_profile(mk.label_components(mk.merge_runs(t.runs, ["mask_id"]), ["mask_id"]), ["mask_id"])
    return out.withColumn("largest_component_fraction", F.round("largest_component_fraction", 6))


@workload(
    "layer_overlaps", "M5 M6 M7 E3",
    f"{BASE}, i AS (SELECT image, y, x, bool_or(layer = 'facility') AS a, bool_or(layer = 'road') AS b FROM px WHERE layer <> 'band' GROUP BY ALL) SELECT image, count(*) FILTER (a) AS area_a, count(*) FILTER (b) AS area_b, count(*) FILTER (a AND b) AS common, "
    "round(count(*) FILTER (a AND b) / count(*), 6) AS mask_iou, round(CASE WHEN count(*) FILTER (a) > 0 THEN count(*) FILTER (a AND b) / count(*) FILTER (a) ELSE 0 END, 6) AS covered FROM i GROUP BY image",
)
def _(t):
    out = mk.overlap_areas(_layer(t, "facility"), _layer(t, "road"), ["image"])
    return out.withColumns({c: F.round(c, 6) for c in ("mask_iou", "covered")})


PARTS = f"{PIX.replace('SELECT DISTINCT image, layer', 'SELECT DISTINCT image, part, layer')}"


@workload(
    "mask_pair_overlaps", "M7 M5",
    f"WITH {PARTS} SELECT a.image, a.part AS a_part, b.part AS b_part, count(*) AS common FROM px a JOIN px b USING (image, y, x) WHERE a.layer = 'facility' AND b.layer = 'band' GROUP BY ALL",
)
def _(t):
    side = lambda name, part: mk.merge_runs(t.layers.where(F.col("layer") == name).select("image", F.col("part").alias(part), "y", "x0", "x1"), ["image", part])
    return mk.pair_overlaps(side("facility", "a_part"), side("band", "b_part"), ["image"], "a_part", "b_part")


@workload(
    "mask_outlines", "M9 M12",
    f"{MASK_PX}, q AS (SELECT mask_id, y, x, unnest([y - 1, y + 1, y, y]) AS ny, unnest([x, x, x - 1, x + 1]) AS nx FROM px), e AS (SELECT q.mask_id, count(*) AS perimeter FROM q ANTI JOIN px p ON p.mask_id = q.mask_id AND p.y = q.ny AND p.x = q.nx GROUP BY q.mask_id) "
    "SELECT mask_id, count(*) AS area, any_value(perimeter) AS perimeter, round(4 * pi() * count(*) / pow(any_value(perimeter), 2), 6) AS compactness FROM px JOIN e USING (mask_id) GROUP BY mask_id",
)
def _(t):
    out = mk.perimeter(mk.merge_runs(t.runs, ["mask_id"]), ["mask_id"])
    return out.withColumn("compactness", F.round("compactness", 6))


AUDIT_SQL = (
    f"{MASK_PX}, {_components('cc', 'px', 'mask_id')}, s AS (SELECT mask_id, comp, count(*) AS a FROM cc GROUP BY ALL), m AS (SELECT mask_id, sum(a)::BIGINT AS mask_area, count(*) AS components, max(a) AS largest FROM s GROUP BY mask_id), "
    "mc AS (SELECT mask_id, count(*) FILTER (a >= greatest(4, ceil(mask_area * 0.02))) AS material_components FROM m JOIN s USING (mask_id) GROUP BY mask_id), "
    "q AS (SELECT mask_id, y, x, unnest([y - 1, y + 1, y, y]) AS ny, unnest([x, x, x - 1, x + 1]) AS nx FROM px), e AS (SELECT q.mask_id, count(*) AS perimeter FROM q ANTI JOIN px p ON p.mask_id = q.mask_id AND p.y = q.ny AND p.x = q.nx GROUP BY q.mask_id), "
    "fr AS (SELECT mask_id, min(x) AS m1, min(y) AS n1, max(x) + 1 AS m2, max(y) + 1 AS n2 FROM px GROUP BY mask_id), ids AS (SELECT DISTINCT mask_id FROM runs UNION ALL SELECT DISTINCT mask_id + 1000000 FROM runs WHERE mask_id % 9 = 0), "
    "dc AS (SELECT mask_id, mask_id % 5 AS x1, mask_id % 4 AS y1, 69 - mask_id % 7 * 3 AS x2, 40 AS y2 FROM ids), "
    "ov AS (SELECT *, greatest(0, least(m2, x2) - greatest(m1, x1)) * greatest(0, least(n2, y2) - greatest(n1, y1)) AS common, (m2 - m1) * (n2 - n1) AS box FROM dc LEFT JOIN fr USING (mask_id)), "
    "ge AS (SELECT mask_id, mask_area, components, material_components, largest / mask_area AS largest_component_fraction, common / (box + (x2 - x1) * (y2 - y1) - common) AS mask_bbox_iou, box AS aabb_area, "
    "1 - mask_area / box AS aabb_background_fraction, 4 * pi() * mask_area / pow(perimeter, 2) AS compactness FROM ov LEFT JOIN m USING (mask_id) LEFT JOIN mc USING (mask_id) LEFT JOIN e USING (mask_id))"
)


def _audited(t):
    ids = t.runs.select("mask_id").distinct()
    ids = ids.unionByName(ids.where("mask_id % 9 = 0").select((F.col("mask_id") + 1000000).alias("mask_id")))
    boxes = ids.selectExpr("mask_id", "CAST(mask_id % 5 AS DOUBLE) AS x1", "CAST(mask_id % 4 AS DOUBLE) AS y1", "CAST(69 - mask_id % 7 * 3 AS DOUBLE) AS x2", "40e0 AS y2")
    return mk.mask_geometry(mk.merge_runs(t.runs, ["mask_id"]), boxes, ["mask_id"])


@workload(
    "mask_audit_totals", "A30",
    AUDIT_SQL + " SELECT count(*) AS analyzed, count(*) FILTER (mask_area IS NULL) AS empty_masks, count(*) FILTER (material_components > 1) AS multiple_material_components, "
    "count(*) FILTER (largest_component_fraction < 0.9) AS largest_component_below_90_percent, count(*) FILTER (mask_area IS NOT NULL AND mask_bbox_iou < 0.8) AS mask_bbox_iou_below_80_percent FROM ge",
)
def _(t):
    return mk.mask_audit_totals(_audited(t))


_RANKS = ", ".join(f"max(CASE WHEN i = round_even((n - 1) * {f}, 0) THEN v END) AS p{p}" for f, p in ((0.1, 10), (0.5, 50), (0.9, 90), (0.99, 99)))


@workload(
    "mask_audit_quantiles", "A30 A3",
    AUDIT_SQL + f", lg AS (SELECT unnest([{', '.join(repr(c) for c in mk.AUDIT_METRICS)}]) AS metric, unnest([{', '.join(f'round({c}::DOUBLE, 6)' for c in mk.AUDIT_METRICS)}]) AS v FROM ge WHERE mask_area IS NOT NULL), "
    f"rk AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY metric) AS n FROM lg) SELECT metric, max(n) AS n, {_RANKS} FROM rk GROUP BY metric",
)
def _(t):
    out = mk.mask_audit_quantiles(_audited(t), ["mask_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("p10", "p50", "p90", "p99")})


@workload("mask_oriented_boxes", "M9")
def _(t):
    out = mk.oriented_boxes(mk.merge_runs(t.runs, ["mask_id"]), ["mask_id"])
    return out.select("mask_id", F.round("obb_area", 4).alias("obb_area"))


BANDS = "ix AS (SELECT DISTINCT image, part, y, x FROM px WHERE layer = 'band'), ex AS (SELECT DISTINCT image, y, x FROM px WHERE layer = 'road')"


def _candidates(t):
    return t.layers.where("layer = 'band'").select("image", "part", "y", "x0", "x1")


@workload(
    "exclusion_records", "E4 E15 A40",
    f"WITH RECURSIVE {PARTS}, {BANDS}, k AS (SELECT image * 10 + part AS g, y, x FROM ix), r AS (SELECT image * 10 + part AS g, y, x FROM ix ANTI JOIN ex USING (image, y, x)), {_components('ca', 'k', 'g')}, {_components('cb', 'r', 'g')}, "
    "a AS (SELECT g, count(*) AS area, count(DISTINCT comp) AS source_components FROM ca GROUP BY g), b AS (SELECT g, count(*) AS remaining, count(DISTINCT comp) AS component_count FROM cb GROUP BY g) "
    "SELECT g // 10 AS image, (g % 10)::INTEGER AS part, area, coalesce(remaining, 0) AS remaining, round((area - coalesce(remaining, 0)) / area, 6) AS removed_fraction, source_components, coalesce(component_count, 0) AS component_count, remaining IS NULL AS fully_excluded FROM a LEFT JOIN b USING (g)",
)
def _(t):
    merged, remaining = zn.apply_exclusions(_candidates(t), _layer(t, "road"), image="image", mask="part")
    out = zn.exclusion_records(merged, remaining, image="image", mask="part")
    return out.withColumn("removed_fraction", F.round("removed_fraction", 6))


@workload(
    "exclusion_effects", "A21 E15",
    f"WITH RECURSIVE {PARTS}, {BANDS}, k AS (SELECT image * 10 + part AS g, y, x FROM ix), r AS (SELECT image * 10 + part AS g, y, x FROM ix ANTI JOIN ex USING (image, y, x)), {_components('ca', 'k', 'g')}, {_components('cb', 'r', 'g')}, "
    "a AS (SELECT g, count(*) AS area, count(DISTINCT comp) AS s FROM ca GROUP BY g), b AS (SELECT g, count(*) AS remaining, count(DISTINCT comp) AS c FROM cb GROUP BY g), "
    "j AS (SELECT s, coalesce(c, 0) AS c, (area - coalesce(remaining, 0)) / area AS gone FROM a LEFT JOIN b USING (g)) SELECT count(*) FILTER (s > 1) AS source_already_multicomponent, count(*) FILTER (c > s) AS newly_split_after_exclusion, "
    "count(*) FILTER (gone > 1e-9) AS candidates_with_any_removed_area, count(*) FILTER (gone >= 0.01) AS candidates_with_at_least_1pct_removed, count(*) FILTER (gone >= 0.1) AS candidates_with_at_least_10pct_removed FROM j",
)
def _(t):
    merged, remaining = zn.apply_exclusions(_candidates(t), _layer(t, "road"), image="image", mask="part")
    return zn.exclusion_effects(zn.exclusion_records(merged, remaining, image="image", mask="part"))


@workload(
    "removed_fraction_quantiles", "E15 A3",
    f"WITH {PARTS}, {BANDS}, s AS (SELECT image, part, round(count(*) FILTER (ex.x IS NOT NULL) / count(*), 6) AS v FROM ix LEFT JOIN ex USING (image, y, x) GROUP BY ALL), "
    "n AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM s) SELECT max(n) AS n, max(CASE WHEN i = round_even((n - 1) * 0.5, 0) THEN v END) AS p50, max(CASE WHEN i = round_even((n - 1) * 0.9, 0) THEN v END) AS p90 FROM n",
)
def _(t):
    from skyledger.operators.ordered import nearest_rank

    merged, remaining = zn.apply_exclusions(_candidates(t), _layer(t, "road"), image="image", mask="part")
    keys = ["image", "part"]
    r = merged.groupBy(*keys).agg(_len().alias("a")).join(remaining.groupBy(*keys).agg(_len().alias("b")), keys, "left")
    v = r.select(F.round((F.col("a") - F.coalesce("b", F.lit(0))) / F.col("a"), 6).alias("v"))
    return nearest_rank(v, [], "v", {"p50": 0.5, "p90": 0.9})


CAND = (
    "cd AS (SELECT DISTINCT l_orderkey // 50 AS image, l_linenumber AS part FROM lineitem), cf AS (SELECT *, CASE WHEN part % 2 = 0 THEN 'building' ELSE 'public road' END AS prompt, (image * 13 + part * 7) % 100 / 100.0 AS confidence FROM cd)"
)


def _cand(t):
    c = t.layers.select("image", "part").distinct()
    return c.withColumn("prompt", F.when(F.col("part") % 2 == 0, "building").otherwise("public road")).withColumn(
        "confidence", ((F.col("image") * 13 + F.col("part") * 7) % 100 / 100.0).cast("double")
    )


@workload(
    "screened_exclusions", "F6",
    f"WITH {PARTS}, {CAND}, m AS (SELECT image, part, count(*) AS area, bool_or(y = 0 OR y = 39 OR x = 0 OR x >= 63) AS edge FROM (SELECT DISTINCT image, part, y, x FROM px WHERE layer = 'facility') GROUP BY ALL) "
    "SELECT image, part, CASE WHEN area IS NULL THEN 'missing_or_mismatched_mask' WHEN area < 60 THEN 'area_below_minimum' WHEN confidence < CASE prompt WHEN 'building' THEN 0.7 ELSE 0.65 END THEN 'confidence_below_threshold' "
    "WHEN prompt = 'public road' AND NOT edge THEN 'public_road_does_not_touch_border' END AS reason FROM cf LEFT JOIN m USING (image, part)",
)
def _(t):
    runs = t.layers.where("layer = 'facility'").select("image", "part", "y", "x0", "x1")
    return zn.screen_exclusions(_cand(t), runs, image="image", mask="part", width=W, height=H, minimum=60).select("image", "part", "reason")


SURF = (
    f"WITH RECURSIVE {PARTS}, {CAND}, fx AS (SELECT DISTINCT image, part, y, x FROM px WHERE layer = 'facility'), an AS (SELECT DISTINCT image, y, x FROM px WHERE layer = 'band'), ex AS (SELECT DISTINCT image, y, x FROM px WHERE layer = 'road'), "
    "rem AS (SELECT * FROM fx ANTI JOIN ex USING (image, y, x)), ra AS (SELECT image, part, count(*) AS area, count(an.x) AS hit FROM rem LEFT JOIN an USING (image, y, x) GROUP BY ALL), pr AS (SELECT DISTINCT image, part FROM fx), "
    "jd AS (SELECT cf.image, cf.part, CASE WHEN pr.image IS NULL THEN 'missing_or_mismatched_mask' WHEN confidence < 0.4 THEN 'confidence_below_threshold' WHEN coalesce(area, 0) < 80 THEN 'area_below_minimum_after_exclusion' "
    "WHEN coalesce(hit, 0) < 10 THEN 'anchor_overlap_below_minimum' END AS reason FROM cf LEFT JOIN pr USING (image, part) LEFT JOIN ra USING (image, part))"
)


def _surfaces(t):
    runs = t.layers.where("layer = 'facility'").select("image", "part", "y", "x0", "x1")
    return zn.anchored_surfaces(_cand(t), runs, _layer(t, "band"), _layer(t, "road"), image="image", mask="part", min_area=80, min_anchor=10)


@workload("surface_reasons", "E6", f"{SURF} SELECT image, part, reason FROM jd")
def _(t):
    return _surfaces(t)[0]


@workload(
    "anchored_surfaces", "E6",
    f"{SURF}, un AS (SELECT DISTINCT image, y, x FROM rem JOIN jd USING (image, part) WHERE reason IS NULL), {_components('cc', 'un')}, "
    "st AS (SELECT image, cy, cx, count(*) AS area, count(an.x) AS hit FROM cc LEFT JOIN an USING (image, y, x) GROUP BY ALL) "
    "SELECT image, cy AS first_y, cx AS first_x, area FROM st WHERE area >= 80 AND hit >= 10",
)
def _(t):
    kept = _surfaces(t)[1]
    return kept.groupBy("image", F.col("component.y").alias("first_y"), F.col("component.x0").alias("first_x")).agg(_len().alias("area"))


ANCHORS = (
    "vh AS (SELECT image_id AS image, CAST(round_even((x1 + x2) / 20, 0) AS BIGINT) AS x, CAST(round_even((y1 + y2) / 40, 0) AS BIGINT) AS y FROM detections), ab AS (SELECT DISTINCT image, part, y, x FROM px WHERE layer = 'band'), "
    "aa AS (SELECT image, part, count(*) AS area FROM ab GROUP BY ALL), av AS (SELECT image, part, count(*) AS v FROM ab JOIN vh USING (image, y, x) GROUP BY ALL), "
    f"ak AS (SELECT image, part FROM aa LEFT JOIN av USING (image, part) WHERE area <= {W * H} * 0.05 AND ((image * 3 + part) % 10 / 10.0 >= 0.6 OR coalesce(v, 0) >= 2)), an AS (SELECT DISTINCT image, y, x FROM ab SEMI JOIN ak USING (image, part))"
)


@workload(
    "evidence_anchored_surfaces", "F7 E6",
    SURF.replace("an AS (SELECT DISTINCT image, y, x FROM px WHERE layer = 'band')", f"{cte('detections')}, {ANCHORS}") + " SELECT image, part, reason FROM jd",
)
def _(t):
    from skyledger.operators.gates import anchors
    from skyledger.plans.evidence import image_evidence

    runs = _candidates(t)
    vehicles = t.detections.select(F.col("image_id").alias("image"), "det_id", *[(F.col(c) / d).alias(c) for c, d in (("x1", 10), ("y1", 20), ("x2", 10), ("y2", 20))])
    area = mk.merge_runs(runs, ["image", "part"]).groupBy("image", "part").agg(_len().alias("area"))
    facts = image_evidence(vehicles, runs, image="image", mask="part", id_col="det_id").withColumnRenamed("vehicle_count", "agreed_vehicles").join(area, ["image", "part"])
    chosen = anchors(facts.withColumn("marking_strength", ((F.col("image") * 3 + F.col("part")) % 10 / 10.0).cast("double")), W * H)
    anchor_runs = runs.join(chosen.select("image", "part"), ["image", "part"], "left_semi").select("image", "y", "x0", "x1")
    masks = t.layers.where("layer = 'facility'").select("image", "part", "y", "x0", "x1")
    return zn.anchored_surfaces(_cand(t), masks, anchor_runs, _layer(t, "road"), image="image", mask="part", min_area=80, min_anchor=10)[0]


BAND_SQL = (
    f"WITH {PARTS}, {cte('detections')}, fc AS (SELECT DISTINCT image, y, x FROM px WHERE layer = 'facility'), bd AS (SELECT DISTINCT image, part, y, x FROM px WHERE layer = 'band'), bl AS (SELECT DISTINCT image, part FROM bd), "
    "cl AS (SELECT * FROM bd SEMI JOIN fc USING (image, y, x)), vh AS (SELECT image_id AS image, CAST(round_even((x1 + x2) / 20, 0) AS BIGINT) AS x, CAST(round_even((y1 + y2) / 40, 0) AS BIGINT) AS y FROM detections), "
    "ar AS (SELECT image, part, count(*) AS a FROM cl GROUP BY ALL), vc AS (SELECT image, part, count(*) AS v FROM cl JOIN vh USING (image, y, x) GROUP BY ALL), "
    "ft AS (SELECT image, part, coalesce(a, 0) AS clipped_area, coalesce(v, 0) AS vehicles, (image * 3 + part) % 10 / 10.0 >= 0.6 AS bm FROM bl LEFT JOIN ar USING (image, part) LEFT JOIN vc USING (image, part)), "
    "ac AS (SELECT *, vehicles >= 2 AS bv, clipped_area >= 10 AND (bm OR vehicles >= 2) AS ok FROM ft), "
    "un AS (SELECT image, count(DISTINCT (y, x)) AS u FROM cl JOIN ac USING (image, part) WHERE ok GROUP BY image), fa AS (SELECT image, count(*) AS f FROM fc GROUP BY image), mo AS (SELECT image, bool_and(NOT bv) AS m FROM ac WHERE ok GROUP BY image), "
    "lg AS (SELECT image FROM mo JOIN un USING (image) JOIN fa USING (image) WHERE m AND u / f > 0.2) "
)


@workload(
    "revalidated_bands", "E7 J12",
    BAND_SQL + "SELECT image, part, clipped_area, vehicles, ok AND image NOT IN (SELECT image FROM lg) AS accepted, concat_ws(',', CASE WHEN clipped_area < 10 THEN 'area_below_minimum_after_clipping' END, "
    "CASE WHEN NOT bm AND NOT bv THEN 'insufficient_support_after_clipping' END, CASE WHEN ok AND image IN (SELECT image FROM lg) THEN 'marking_only_union_too_large' END) AS reasons FROM ac",
)
def _(t):
    runs = _candidates(t)
    bands = runs.select("image", "part").distinct().withColumn("marking_strength", ((F.col("image") * 3 + F.col("part")) % 10 / 10.0).cast("double"))
    vehicles = t.detections.select(F.col("image_id").alias("image"), *[(F.col(c) / d).alias(c) for c, d in (("x1", 10), ("y1", 20), ("x2", 10), ("y2", 20))])
    out = zn.revalidate_bands(bands, runs, _layer(t, "facility"), vehicles, image="image", mask="part", min_area=10, limit=0.2)
    return out.select("image", "part", "clipped_area", "vehicles", "accepted", F.array_join("rejection_reasons", ",").alias("reasons"))


@workload(
    "vehicles_in_masks", "J12 E18",
    f"WITH {PIX}, {cte('detections')}, vh AS (SELECT det_id, image_id AS image, CAST(round_even((x1 + x2) / 20, 0) AS BIGINT) AS x, CAST(round_even((y1 + y2) / 40, 0) AS BIGINT) AS y FROM detections) SELECT det_id, image FROM vh WHERE EXISTS (SELECT 1 FROM px WHERE layer = 'facility' AND px.image = vh.image AND px.y = vh.y AND px.x = vh.x)",
)
def _(t):
    boxes = t.detections.select("det_id", F.col("image_id").alias("image"), *[(F.col(c) / d).alias(c) for c, d in (("x1", 10), ("y1", 20), ("x2", 10), ("y2", 20))])
    return mk.centre_hits(boxes, mk.merge_runs(_layer(t, "facility"), ["image"]), ["image"]).select("det_id", "image")


def _disc(r: int) -> str:
    cells = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= r * r]
    return ", ".join(f"({a}, {b})" for a, b in cells)


ZONES = (
    f"{BASE}, fc AS (SELECT image, y, x FROM px WHERE layer = 'facility'), b0 AS (SELECT image, y, x FROM px SEMI JOIN fc USING (image, y, x) WHERE layer = 'band'), {_retained('bn', 'b0', 6)}, "
    f"nr AS MATERIALIZED (SELECT DISTINCT image, comp, y + dy AS y, x + dx AS x FROM bn, (VALUES {_disc(5)}) o(dy, dx)), nc AS (SELECT image, y, x, count(*) AS n FROM nr GROUP BY ALL), "
    f"a0 AS (SELECT image, y, x FROM fc JOIN nc USING (image, y, x) ANTI JOIN bn USING (image, y, x) WHERE n >= 2), {_retained('ai', 'a0', 6)}, "
    f"rd AS MATERIALIZED (SELECT DISTINCT image, y + dy AS y, x + dx AS x FROM px, (VALUES {_disc(2)}) o(dy, dx) WHERE layer = 'road'), e0 AS (SELECT image, y, x FROM ai SEMI JOIN rd USING (image, y, x)), {_retained('en', 'e0', 6)}, "
    f"i0 AS (SELECT image, y, x FROM ai ANTI JOIN en USING (image, y, x)), {_retained('inr', 'i0', 6)}, "
    "uk AS (SELECT image, y, x FROM fc ANTI JOIN bn USING (image, y, x) ANTI JOIN inr USING (image, y, x) ANTI JOIN en USING (image, y, x)), "
    "mp AS (SELECT image, 'parking_facility' AS object_type, image::VARCHAR || ':facility' AS object_id, count(*) AS area FROM fc GROUP BY image UNION ALL SELECT image, 'parking_zone', image::VARCHAR || ':zone', count(*) FROM fc GROUP BY image "
    "UNION ALL SELECT image, 'parking_band', image::VARCHAR || ':parking_band:' || cy || '-' || cx, count(*) FROM bn GROUP BY image, cy, cx UNION ALL SELECT image, 'internal_aisle', image::VARCHAR || ':internal_aisle:' || cy || '-' || cx, count(*) FROM inr GROUP BY image, cy, cx "
    "UNION ALL SELECT image, 'entrance_exit', image::VARCHAR || ':entrance_exit:' || cy || '-' || cx, count(*) FROM en GROUP BY image, cy, cx UNION ALL SELECT image, 'unknown_region', image::VARCHAR || ':unknown', count(*) FROM uk GROUP BY image)"
)


def _zones(t):
    return zn.functional_zones(_layer(t, "facility"), _layer(t, "band"), _layer(t, "road"), image="image", width=W, height=H, between=5, near=2, minimum=6)


@workload(
    "functional_map", "M10 M11 E9",
    f"{ZONES} SELECT image, object_type, object_id, area, CASE object_type WHEN 'parking_facility' THEN NULL WHEN 'parking_zone' THEN image::VARCHAR || ':facility' WHEN 'entrance_exit' THEN image::VARCHAR || ':facility' ELSE image::VARCHAR || ':zone' END AS parent_id, "
    "CASE object_type WHEN 'parking_facility' THEN NULL WHEN 'parking_zone' THEN 'parking_facility' WHEN 'entrance_exit' THEN 'parking_facility' ELSE 'parking_zone' END AS parent_type, 'abstain' AS review_state FROM mp",
)
def _(t):
    return zn.functional_map(_zones(t), image="image")


@workload(
    "zoning_totals", "A22 E9",
    f"{ZONES}, p AS (SELECT image, bool_or(object_type = 'parking_band') AS b, bool_or(object_type = 'internal_aisle') AS a, bool_or(object_type = 'entrance_exit') AS e, bool_or(object_type = 'unknown_region') AS u FROM mp GROUP BY image) "
    "SELECT count(*) AS aois, count(*) FILTER (b) AS with_parking_band, count(*) FILTER (a) AS with_internal_aisle, count(*) FILTER (e) AS with_entrance_exit, count(*) FILTER (u) AS with_unknown_region FROM p",
)
def _(t):
    return zn.zoning_totals(zn.functional_map(_zones(t), image="image"), "image")


@workload(
    "zone_features", "M12",
    f"{BASE}, fc AS (SELECT image, y, x FROM px WHERE layer = 'facility'), z AS (SELECT image, y, x FROM px WHERE layer = 'band'), f2 AS (SELECT image, y, x FROM fc), {_components('bn', 'f2')}, {_components('zc', 'z')}, "
    f"rd AS (SELECT DISTINCT image, y + dy AS y, x + dx AS x FROM px, (VALUES {_disc(2)}) o(dy, dx) WHERE layer = 'road'), nr AS (SELECT DISTINCT image, comp, y + dy AS y, x + dx AS x FROM bn, (VALUES {_disc(2)}) o(dy, dx)), "
    "bb AS (SELECT image, count(*) AS components, sum((mx - nx + 1) * (my - ny + 1)) AS boxes FROM (SELECT image, comp, max(x) AS mx, min(x) AS nx, max(y) AS my, min(y) AS ny FROM zc GROUP BY image, comp) GROUP BY image), "
    "ab AS (SELECT image, count(DISTINCT comp) AS adjacent_bands FROM z JOIN nr USING (image, y, x) GROUP BY image), rf AS (SELECT image, count(*) AS r FROM z SEMI JOIN rd USING (image, y, x) GROUP BY image), fa AS (SELECT image, count(*) AS f FROM fc GROUP BY image), "
    "za AS (SELECT image, count(*) AS area, bool_or(y = 0 OR y = 39 OR x = 0 OR x >= 63) AS touches_border FROM z GROUP BY image), "
    "zq AS (SELECT image, unnest([y - 1, y + 1, y, y]) AS ny, unnest([x, x, x - 1, x + 1]) AS nx FROM z), pe AS (SELECT zq.image, count(*) AS perimeter FROM zq ANTI JOIN z ON z.image = zq.image AND z.y = zq.ny AND z.x = zq.nx GROUP BY zq.image) "
    "SELECT image, area, round(area / f, 6) AS facility_fraction, components, round(area / boxes, 6) AS extent, round(4 * pi() * area / pow(perimeter, 2), 6) AS compactness, coalesce(adjacent_bands, 0) AS adjacent_bands, round(coalesce(r, 0) / area, 6) AS road_fraction, touches_border FROM za JOIN bb USING (image) JOIN pe USING (image) LEFT JOIN ab USING (image) LEFT JOIN rf USING (image) LEFT JOIN fa USING (image)",
)
def _(t):
    fac = mk.merge_runs(_layer(t, "facility"), ["image"])
    out = zn.zone_features(_layer(t, "band"), fac, _layer(t, "road"), mk.label_components(fac, ["image"]), image="image", width=W, height=H, near=2)
    return out.withColumns({c: F.round(c, 6) for c in ("facility_fraction", "extent", "compactness", "road_fraction")})


@workload(
    "hard_negative_runs", "M14",
    f"WITH {PIX}, cf AS (SELECT DISTINCT c_custkey AS image FROM customer WHERE c_mktsegment = 'BUILDING'), pd AS (SELECT image, y, x FROM px WHERE layer = 'facility'), ex AS (SELECT image, y, x FROM px WHERE layer = 'road') "
    "SELECT image, CASE WHEN image IN (SELECT image FROM cf) THEN 'confirmed_false_positive' ELSE 'building_or_public_road_overlap' END AS source, count(*) AS pixels FROM pd WHERE image IN (SELECT image FROM cf) OR EXISTS (SELECT 1 FROM ex WHERE ex.image = pd.image AND ex.y = pd.y AND ex.x = pd.x) GROUP BY ALL",
)
def _(t):
    confirmed = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("image"))
    out = mk.supervision(_layer(t, "facility"), _layer(t, "road"), confirmed, ["image"])
    return out.groupBy("image", "source").agg(_len().alias("pixels"))


@workload(
    "secondary_evidence", "M15",
    f"WITH {PARTS}, g AS (SELECT DISTINCT image, y, x FROM px WHERE layer = 'facility'), c AS (SELECT px.image, px.layer AS kind, px.part, px.y, px.x FROM px JOIN g USING (image, y, x) WHERE px.layer <> 'facility') SELECT image, kind, count(DISTINCT part) AS targets, count(DISTINCT (y, x)) AS area FROM c GROUP BY ALL",
)
def _(t):
    instances = t.layers.where("layer <> 'facility'").select("image", F.col("layer").alias("kind"), F.col("part").alias("target_id"), "y", "x0", "x1")
    return zn.secondary_evidence(instances, _layer(t, "facility"), image="image", kind="kind")


@workload(
    "candidate_packages", "E20",
    f"{BASE}, fc AS (SELECT image, y, x FROM px WHERE layer = 'facility'), {_retained('rt', 'fc', 40)} SELECT image, (image // 100 // 32)::VARCHAR || ':' || (image % 100 // 32)::VARCHAR AS geo_cell, count(DISTINCT comp) AS components, count(*) AS area FROM rt GROUP BY image",
)
def _(t):
    blocks = t.orders.selectExpr("o_orderkey div 50 AS image").distinct().selectExpr("image", "image div 100 AS block_row", "image % 100 AS block_col")
    return zn.candidate_packages(_layer(t, "facility"), blocks, minimum=40).select("image", "geo_cell", "components", "area")


SEG = (
    "sg AS (SELECT o_orderkey AS way, CAST(o_orderkey % 70 - 3 AS DOUBLE) AS ax, CAST(o_custkey % 50 - 5 AS DOUBLE) AS ay, CAST(o_orderkey * 7 % 70 - 3 AS DOUBLE) AS bx, CAST(o_custkey * 3 % 50 - 5 AS DOUBLE) AS \"by\", CASE o_orderstatus WHEN 'F' THEN 4.74 WHEN 'O' THEN 2.62 ELSE 6.86 END::DOUBLE AS thickness FROM orders)"
)


@workload(
    "way_runs", "F5",
    f"WITH {SEG}, d AS (SELECT *, (bx - ax) * (bx - ax) + (\"by\" - ay) * (\"by\" - ay) AS l2 FROM sg), g AS (SELECT y, x FROM (SELECT unnest(range(0, 40)) AS y), (SELECT unnest(range(0, 64)) AS x)), "
    "h AS (SELECT way, y, x, CASE WHEN l2 > 0 THEN greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (\"by\" - ay)) / l2)) ELSE 0 END AS s, ax, ay, bx, \"by\", thickness FROM d, g) "
    "SELECT way, count(*) AS pixels, min(x) AS min_x, max(y) AS max_y FROM h WHERE pow(x - ax - s * (bx - ax), 2) + pow(y - ay - s * (\"by\" - ay), 2) <= pow(thickness / 2, 2) GROUP BY way",
)
def _(t):
    sg = t.orders.selectExpr(
        "o_orderkey AS way", "CAST(o_orderkey % 70 - 3 AS DOUBLE) AS ax", "CAST(o_custkey % 50 - 5 AS DOUBLE) AS ay", "CAST(o_orderkey * 7 % 70 - 3 AS DOUBLE) AS bx",
        "CAST(o_custkey * 3 % 50 - 5 AS DOUBLE) AS by", "CAST(CASE o_orderstatus WHEN 'F' THEN 4.74 WHEN 'O' THEN 2.62 ELSE 6.86 END AS DOUBLE) AS thickness",
    )
    return mk.way_runs(sg, ["way"], W, H).groupBy("way").agg(_len().alias("pixels"), F.min("x0").alias("min_x"), F.max("y").alias("max_y"))


ROADS = (
    "w AS (SELECT o_orderkey AS id, CASE o_custkey % 4 WHEN 0 THEN 28 WHEN 1 THEN 10 WHEN 2 THEN 16 END AS width, 100 + o_orderkey % 1400 AS x, 100 + o_orderkey * 7 % 900 AS y, o_custkey % 41 - 20 AS dx, o_custkey % 31 - 15 AS dy, o_custkey % 19 = 0 AS bridge FROM orders), "
    "s AS (SELECT width, x AS ax, y AS ay, x + dx AS bx, y + dy AS \"by\" FROM w WHERE width IS NOT NULL AND NOT bridge UNION ALL SELECT width, x + dx, y + dy, x + dx + 17, y + dy - 9 FROM w WHERE width IS NOT NULL AND NOT bridge), "
    "g AS (SELECT s.*, unnest(range(least(ay, \"by\") - 15, greatest(ay, \"by\") + 16)) AS py FROM s), h AS (SELECT g.*, unnest(range(least(ax, bx) - 15, greatest(ax, bx) + 16)) AS px FROM g), "
    "l AS (SELECT *, (bx - ax) * (bx - ax) + (\"by\" - ay) * (\"by\" - ay) AS l2 FROM h), q AS (SELECT *, CASE WHEN l2 > 0 THEN greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (\"by\" - ay)) / l2)) ELSE 0 END AS f FROM l), "
    "p AS (SELECT DISTINCT px, py FROM q WHERE pow(px - ax - f * (bx - ax), 2) + pow(py - ay - f * (\"by\" - ay), 2) <= pow((width + 0.37) / 2, 2))"
)


@workload(
    "road_runs", "M13 F5 S6 P9",
    f"WITH {ROADS} SELECT py // 64 AS block_row, px // 64 AS block_col, count(*) AS pixels, min(px % 64) AS \"left\", max(py % 64) + 1 AS bottom FROM p GROUP BY ALL",
)
def _(t):
    from skyledger.operators.roads import road_runs
    from skyledger.session import scratch_path
    from skyledger.sources.files import read_road_elements

    # Road elements as they come: JSON with points in degrees; ways cross the borders of blocks of 64 pixels.
    path = scratch_path(t.spark, "ways")
    k = F.col("o_custkey")
    highway = F.expr("CASE o_custkey % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'service' WHEN 2 THEN 'residential' ELSE 'footway' END")
    tags = F.map_filter(F.create_map(F.lit("highway"), highway, F.lit("bridge"), F.when(k % 19 == 0, "yes")), lambda _, v: v.isNotNull())
    x, y = 100 + F.col("o_orderkey") % 1400, 100 + F.col("o_orderkey") * 7 % 900
    dx, dy = k % 41 - 20, k % 31 - 15
    point = lambda px, py: F.struct(((px + 0.25) / 16384 * 360 - 180).alias("lon"), (90 - (py + 0.25) / 8192 * 180).alias("lat"))
    element = F.struct(F.lit("way").alias("type"), F.col("o_orderkey").alias("id"), tags.alias("tags"), F.array(point(x, y), point(x + dx, y + dy), point(x + dx + 17, y + dy - 9)).alias("geometry"))
    t.orders.select(F.to_json(F.struct(F.array(element).alias("elements"))).alias("value")).write.text(path)
    runs = road_runs(read_road_elements(t.spark, path), zoom=5, block=64, margin=0.37)
    return runs.groupBy(F.col("block_row").cast("bigint").alias("block_row"), F.col("block_col").cast("bigint").alias("block_col")).agg(
        _len().alias("pixels"), F.min("x0").alias("left"), (F.max("y") + 1).alias("bottom")
    )
