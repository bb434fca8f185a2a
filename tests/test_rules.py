"""Gates, geometry, text, samples and files on hand-made cases."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.functions import keys as k
from skyledger.functions import polygons as pg
from skyledger.functions import text as tx
from skyledger.functions import tiles as tl
from skyledger.operators import gates, geo, labels, masks, rings, sampling
from skyledger.operators.arrangement import vehicle_rows
from skyledger.plans import evidence, packages
from skyledger.session import scratch_path
from skyledger.sources import files, sinks


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_candidate_gate(spark):
    rows = []
    add = lambda c, *signals: rows.extend((c, kind, group, strength) for kind, group, strength in signals)
    cover = ("exclusion_coverage", "x", 0.9)
    add(2, cover, ("parking_marking", "a", 0.7), ("vehicle_arrangement", "b", 0.7))
    add(3, cover, ("parking_marking", "a", 0.7), ("vehicle_arrangement", "a", 0.7))
    add(4, ("non_parking_conflict", "a", 0.95), cover)
    c = spark.createDataFrame([(i, []) for i in (1, 2, 3, 4)] + [(5, ["empty_geometry"])], "candidate_id int, geometry_issues array<string>")
    s = spark.createDataFrame(rows, "candidate_id int, kind string, independence_group string, strength double")
    got = {r.candidate_id: (r.decision, r.reasons) for r in gates.decide_candidates(c, gates.fold_signals(s)).collect()}
    assert got[1][0] == "abstain" and "missing_exclusion_coverage" in got[1][1]
    assert got[2] == ("auto_accept", [])
    assert got[3] == ("abstain", ["support_not_independent"])
    assert got[4] == ("auto_reject", ["strong_non_parking_conflict"])
    assert got[5] == ("auto_reject", ["invalid_geometry:empty_geometry"])


def test_exclusion_before_gate_keeps_provisional_candidates(spark):
    c = spark.createDataFrame([(1, [], True, True), (2, [], True, False)], "candidate_id int, geometry_issues array<string>, fully_excluded boolean, exclusions_authoritative boolean")
    s = spark.createDataFrame([(9, "parking_marking", "a", 0.1)], "candidate_id int, kind string, independence_group string, strength double")
    got = {r.candidate_id: (r.decision, r.reasons) for r in gates.decide_candidates(c, gates.fold_signals(s)).collect()}
    assert got == {1: ("auto_reject", ["fully_excluded"]), 2: ("abstain", ["provisionally_fully_excluded"])}


def ring(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def test_polygons(spark):
    bow = ring((0, 0), (2, 2), (2, 0), (0, 2), (0, 0))
    square = ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))
    hole = ring((1, 1), (2, 1), (2, 2), (1, 2), (1, 1))
    shape = lambda kind, *polygons: spark.range(1).select(
        F.lit("s").alias("object_id"), F.lit(kind).alias("geometry_type"), F.array(*polygons).alias("geometry"), F.lit("parking_zone").alias("object_type"),
        F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("string").alias("parent_type"), F.lit(1).alias("pos"),
    )
    issues = lambda *args: [r.issue for r in geo.topology_issues(shape(*args), ["pos"]).collect()]
    assert issues("Polygon", F.array(bow)) == ["self_intersection"] and issues("MultiPolygon", F.array(square), F.array(hole)) == []
    assert issues("Point", F.array(bow)) == ["unsupported_geometry_type"] and issues("Polygon", F.array(ring((0, 0), (1, 0), (1, 1), (0, 1)))) == ["unclosed_or_short_ring"]
    spots = {"edge": (4, 2), "inside": (3, 3), "outside": (5, 1), "in_hole": (1.5, 1.5), "on_hole": (1, 1.5)}
    asked = spark.createDataFrame([("s", k, float(x), float(y)) for k, (x, y) in spots.items()], "object_id string, point string, x double, y double")
    inside = rings.points_inside(asked, rings.gridded(shape("Polygon", F.array(square, hole))), "object_id", "point")
    assert {r.point for r in inside.collect()} == {"edge", "inside"} and one(spark, area=pg.area(square)).area == 16.0


def test_tiles_round_trip_and_names(spark):
    b = tl.parse_block(F.lit("block_z19_br0_bc20_r174475_c875337.png"))
    lon, lat = tl.pixel_to_lonlat(F.lit(19), F.lit(174475), F.lit(875337), F.lit(321.25), F.lit(654.75))
    x, y = tl.lonlat_to_pixel(F.lit(19), F.lit(174475), F.lit(875337), lon, lat)
    west, north = tl.pixel_to_lonlat(F.lit(0), F.lit(0), F.lit(0), F.lit(0.0), F.lit(0.0))
    r = one(spark, b=b, bad=tl.parse_block(F.lit("block_z19.png")), x=x, y=y, west=west, north=north)
    assert (r.b.zoom, r.b.block_col, r.b.tile_col) == (19, 20, 875337) and r.bad is None
    assert abs(r.x - 321.25) < 1e-5 and abs(r.y - 654.75) < 1e-5 and (r.west, r.north) == (-180.0, 90.0)


def test_ground_scale_errors(spark):
    good = tl.pixels_to_metres(F.lit(10.0), F.lit(20.0), F.lit(0.13), F.lit(0.15), F.lit("derived"))
    r = one(spark, x=good[0], y=good[1])
    assert (round(r.x, 6), round(r.y, 6)) == (1.3, 3.0)
    with pytest.raises(Exception, match="GSD is unknown"):
        one(spark, a=tl.pixel_area_to_m2(F.lit(1.0) + F.rand(), F.lit(0.1), F.lit(0.1), F.lit("unknown")))
    with pytest.raises(Exception, match="non-negative"):
        one(spark, a=tl.pixel_area_to_m2(-F.rand() - 1, F.lit(0.1), F.lit(0.1), F.lit("observed")))


def test_replies(spark):
    allowed = ["accept", "reject", "hard_positive"]
    r = one(
        spark, last=tx.parse_label(F.lit("I think\nReject"), allowed), word=tx.parse_label(F.lit("a hard_positive, not accepted"), allowed), none=tx.parse_label(F.lit("acceptable"), allowed),
        fenced=tx.extract_json(F.lit('x ```json\n{"a": 1}\n``` y')), fixed=tx.extract_json(F.lit('so {label: "accept", } ok')), bad=tx.extract_json(F.lit("{no")),
        listed=tx.extract_json(F.lit("```[1]```")), verdict=tx.verdict(F.lit('{"verdict": "FAIL", "confidence": 3, "estimated_problem_count": -2}')), odd=tx.verdict(F.lit('{"verdict": "maybe"}')),
    )
    assert (r.last, r.word, r.none) == ("reject", "hard_positive", None)
    assert r.fenced == '{"a": 1}' and '"label"' in r.fixed and r.bad is None and r.listed is None
    assert (r.verdict.verdict, r.verdict.confidence, r.verdict.problems) == ("fail", 1.0, 0) and r.odd is None


def test_slug_and_names(spark):
    r = one(spark, a=k.slug(F.lit(" Building, car ")), b=k.slug(F.lit("!!")), c=k.slug(F.lit("x y " * 40)), ok=k.safe_name(F.lit("a-b.1")), up=k.safe_name(F.lit("..")), bad=k.safe_name(F.lit("a/b")))
    assert r.a == "building_car" and r.b == "default" and len(r.c) == 57 and r.ok and not r.up and not r.bad


def test_manifest_takes_forty_eight_whatever_the_order(spark):
    strata = ["a", "b", "c", "d", "e", "f"]
    rows = [(f"{s}{i}", f"{i % 5}:{s}", [s]) for s in strata for i in range(12)]
    picks = []
    for r in (rows, rows[::-1]):
        df = spark.createDataFrame(r, "aoi_id string, geo_cell string, strata array<string>")
        picks.append({(p.aoi_id, p.pick) for p in sampling.aoi_manifest(df, dict.fromkeys(strata, 8)).collect()})
    assert picks[0] == picks[1] and len(picks[0]) == 48


def test_rare_stratum_survives(spark):
    rows = [(str(i), "common") for i in range(20)] + [("rare", "rare")]
    out = sampling.coverage_sample(spark.createDataFrame(rows, "id string, kind string"), key="id", quotas={"kind": 2}, max_samples=4)
    got = {r.id for r in out.collect()}
    assert "rare" in got and len(got) == 4


def walk(records):
    """The sequential removal, for comparison: (order, class, box) in order."""
    alive, struck = [], 0
    for r in records:
        rivals = [a for a in alive if a["live"] and a["c"] != r[1] and box_iou(a["b"], r[2]) >= 0.9]
        alive.append({"o": r[0], "c": r[1], "b": r[2], "live": not rivals})
        for a in rivals:
            a["live"] = False
            struck += 2
    return {a["o"] for a in alive if a["live"]}, struck


def box_iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0, w) * max(0, h)
    return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)


def test_conflict_chains_settle_in_few_rounds(spark, monkeypatch):
    """A chain of 3,000 boxes, a comb of short chains, and a star: outcomes as walked, in rounds that follow the logarithm."""
    edges = [(f"c{i:05d}", f"c{i + 1:05d}") for i in range(3000)]
    edges += [(f"t{i:03d}-{j}", f"t{i:03d}-{j + 1}" if j < i % 7 else "top") for i in range(60) for j in range(i % 7 + 1)]
    edges += [(f"s{i:03d}", "star") for i in range(50)]
    fell = {}
    children = {}
    for a, b in edges:
        children.setdefault(b, []).append(a)
    nodes = {x for e in edges for x in e}
    while len(fell) < len(nodes):
        for x in nodes - fell.keys():
            if all(c in fell for c in children.get(x, [])):
                fell[x] = any(not fell[c] for c in children.get(x, []))
    writes = []
    whole = labels.cut
    monkeypatch.setattr(labels, "cut", lambda df, name="cut": writes.append(1) or whole(df, name))
    got = {r.id: r.fell for r in labels._settle(spark.createDataFrame(edges, "child string, parent string")).collect()}
    assert got == fell and len(writes) <= 2 * 15 + 1


def test_sanitize_equals_the_walk(spark):
    rnd = np.random.default_rng(4)
    records = [(f"{i:03d}", int(rnd.integers(3)), (0.1 + 0.001 * int(rnd.integers(12)), 0.1, 0.2 + 0.001 * int(rnd.integers(3)), 0.3)) for i in range(60)]
    seen, unique = set(), []
    for r in records:
        key = (r[1], r[2])
        unique += [] if key in seen else [r]
        seen.add(key)
    kept, struck = walk(unique)
    rows = [("f", o, c, "car", [b[0], b[1], b[2], b[1], b[2], b[3], b[0], b[3]]) for o, c, b in records]
    df = spark.createDataFrame(rows, "file string, o string, class_id int, class_name string, coords array<double>")
    out = labels.sanitize(labels.flag_objects(df), ["file"], "o")
    assert {r.o for r in out.where("outcome = 'kept'").collect()} == kept
    assert labels.sanitize_stats(out).first().removed_conflict == struck


def test_label_lines_and_polygon_flags(spark):
    lines = spark.createDataFrame([("0 0.1 0.1 0.2 0.1 0.2 0.2",), ("0 1 2",), ("x 0.1 0.1 0.2 0.1 0.2 0.2",)], "value string")
    p = labels.parse_label_lines(lines, form="seg").collect()
    assert [r.malformed for r in p] == [False, True, True] and [r.token_error for r in p] == [False, True, False]
    seg = spark.createDataFrame([(0, "a", [0.1, 0.1, 0.9, 0.1, 0.9, 0.9, 0.5, 0.95, 0.1, 0.9])], "class_id int, class_name string, coords array<double>")
    f = labels.flag_objects(seg, form="seg").first()
    assert f.oversized and not f.extreme_aspect and not f.out_of_bounds


def pixels(runs):
    return {(r.y, x) for r in runs for x in range(r.x0, r.x1)}


def test_smallest_rectangle_against_all_angles():
    rnd = np.random.default_rng(0)
    for _ in range(20):
        pts = rnd.integers(0, 30, size=(25, 2)).astype(float)
        area, _ = masks.smallest_rectangle(pts)
        angles = np.radians(np.arange(0, 90, 0.05))
        u, v = np.stack([np.cos(angles), np.sin(angles)]), np.stack([-np.sin(angles), np.cos(angles)])
        brute = (np.ptp(pts @ u, axis=0) * np.ptp(pts @ v, axis=0)).min()
        assert area <= brute + 1e-9 and area >= brute * 0.99


def test_set_algebra_and_corner_neighbours(spark):
    a = spark.createDataFrame([(1, 0, 0, 3), (1, 0, 2, 5), (1, 1, 5, 7)], "m int, y int, x0 int, x1 int")
    b = spark.createDataFrame([(1, 0, 1, 2), (1, 1, 0, 6)], "m int, y int, x0 int, x1 int")
    assert pixels(masks.subtract(a, b, ["m"]).collect()) == pixels(a.collect()) - pixels(b.collect())
    assert pixels(masks.intersect(a, b, ["m"]).collect()) == pixels(a.collect()) & pixels(b.collect())
    labelled = masks.label_components(masks.merge_runs(a, ["m"]), ["m"])
    assert labelled.select("component").distinct().count() == 1  # the rows touch at a corner


def test_vehicle_rows_parallel_gap_and_order(spark):
    make = lambda pts: [(1, i, x - 4.0, y - 2.0, x + 4.0, y + 2.0) for i, (x, y) in enumerate(pts)]
    two = [(10.0 + 12 * i, 20.0) for i in range(4)] + [(10.0 + 12 * i, 60.0) for i in range(4)]
    schema = "aoi int, id int, x1 double, y1 double, x2 double, y2 double"
    got = {}
    for r in vehicle_rows(spark.createDataFrame(make(two)[::-1], schema), "aoi", "id").collect():
        got.setdefault(r.row_no, set()).add(r.id)
    assert got == {1: {0, 1, 2, 3}, 2: {4, 5, 6, 7}}
    split = [(10.0 + 12 * i, 20.0) for i in range(3)] + [(150.0 + 12 * i, 20.0) for i in range(3)]
    rows = vehicle_rows(spark.createDataFrame(make(split), schema), "aoi", "id").collect()
    assert {r.row_no for r in rows} == {1, 2} and len(rows) == 6


def test_signals_and_packages(spark):
    e = spark.createDataFrame([(7, 3, 0.8, 0.4)], "candidate int, vehicle_count int, strength double, marking_strength double")
    s = {r.kind: r.strength for r in evidence.evidence_signals(e, candidate="candidate").collect()}
    assert s == {"parking_marking": 0.4, "vehicle_arrangement": 0.8}
    chosen = spark.createDataFrame([("a.jpg", True, "dense", 0)], "name string, risk boolean, density string, turn int")
    m = packages.unsigned_manifest(packages.golden_review_rows(chosen)).first()
    assert (m.images, m.risk_images, m.approved) == (1, 1, False)
    lines = evidence.evidence_package(spark.createDataFrame([("a",)], "aoi_id string"), spark.createDataFrame([("a", 1), ("b", 2)], "aoi_id string, t int")).collect()
    assert len(lines) == 1 and '"t":1' in lines[0].value


def test_window_limits():
    with pytest.raises(ValueError):
        geo.check_window(2, 0, 1, 1)
    with pytest.raises(ValueError):
        geo.check_window(0, 0, float("nan"), 1)
    with pytest.raises(ValueError):
        sampling.limited(0, 1, 2000)


def test_evenly_spaced_like_the_formula(spark):
    for n, kk in itertools.product((5, 10, 37), (3, 7, 10)):
        rows = sampling.evenly_spaced(spark.range(n), ["id"], kk).collect()
        want = set(range(n)) if n <= kk else {i * (n - 1) // (kk - 1) for i in range(kk)}
        assert {r.id for r in rows} == want


def test_sheet_with_byte_order_mark_and_collections(spark, tmp_path):
    sheet = tmp_path / "review.csv"
    sheet.write_bytes("﻿image,label\na.png,accept\n".encode("utf-8"))
    rows = files.read_sheet(spark, str(sheet), ["image", "label"], required=["image"]).collect()
    assert [(r.image, r.label) for r in rows] == [("a.png", "accept")]
    with pytest.raises(ValueError, match="missing columns"):
        files.read_sheet(spark, str(sheet), ["image"], required=["reviewer"])
    doc = tmp_path / "c.geojson"
    doc.write_text('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]]]},"properties":{"aoi_id":"q"}}]}')
    f = files.read_features(spark, str(doc), "aoi_id: string", lines=False).first()
    assert f.aoi_id == "q" and f.coordinates[0][0][1] == [1.0, 0.0]
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "block_z1_br0_bc0_r0_c0.png").write_bytes(b"12345")
    listed = files.list_files(spark, str(tmp_path / "img")).first()
    assert (listed.name, listed.size) == ("block_z1_br0_bc0_r0_c0.png", 5)


def test_failed_publish_keeps_the_old_version(spark):
    base = scratch_path(spark, "publish-test")
    sinks.publish(spark.range(5), base)
    with pytest.raises(ValueError):
        sinks.publish(spark.range(0), base)
    with pytest.raises(Exception):
        sinks.publish(spark.range(5).select((F.lit(1) / F.when(F.col("id") < 9, F.raise_error(F.lit("broken")).cast("int"))).alias("id")), base)
    assert sinks.current(spark, base, "id bigint").count() == 5
