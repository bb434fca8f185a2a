"""Results and row counts that showed only on larger tables."""

import numpy as np
from pyspark.sql import functions as F

from skyledger.functions import tiles as tl
from skyledger.operators import masks as mk
from skyledger.operators import scoring as sc
from skyledger.operators.ordered import exact_avg


def test_thick_segments_are_united_in_tasks(spark):
    """Pixels equal a brute force over the picture, whatever the batches; a batch gives out united runs and not one run per segment and row."""
    g = np.random.default_rng(7)
    ends = g.integers(-12, 45, (300, 4)).astype(float)
    ends[:20, 2:] = ends[:20, :2]
    ends[20:40, 3] = ends[20:40, 1]
    thickness = g.choice([2.62, 5.37, 9.37], 300)
    part = np.arange(300) % 2
    rows = [(None if p else "a", *map(float, e), float(w)) for p, e, w in zip(part, ends, thickness)]
    made = spark.createDataFrame([*rows, ("b", None, 1.0, 2.0, 3.0, 4.0), ("b", 1.0, 1.0, float("nan"), 3.0, 4.0)], "k string, ax double, ay double, bx double, by double, thickness double")
    got = {(r.k, r.y, x) for r in mk.way_runs(made.repartition(3), ["k"], 40, 30).collect() for x in range(r.x0, r.x1)}
    y, x = np.mgrid[0:30, 0:40]
    want = set()
    for k, ax, ay, bx, by, w in rows:
        size = (bx - ax) ** 2 + (by - ay) ** 2
        s = np.clip(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / size, 0, 1) if size else 0
        hit = (x - ax - s * (bx - ax)) ** 2 + (y - ay - s * (by - ay)) ** 2 <= (w / 2) ** 2
        want |= {(k, int(a), int(b)) for a, b in zip(*np.nonzero(hit))}
    assert got == want

    first = np.zeros(500)
    drawn = list(mk._drawn(first, first, first + 30, first + 20, first + 4.2, first.astype(int), 40, 30))
    assert sum(len(start) for start, _ in drawn) == 25
    several = list(mk._drawn(first, first, first + 30, first + 20, first + 4.2, first.astype(int), 40, 30, rows=100))
    assert len(several) > 100 and all(np.array_equal(a, b) for one in several for a, b in zip(one, drawn[0]))


def test_curve_ties_do_not_follow_row_order(spark):
    """Three fractions whose sum as doubles follows their order, and equal means of different counts."""
    epochs = [(1, 0.1), (1, 0.2), (1, 0.3), (2, 0.2), (3, 0.3), (3, 0.2), (3, 0.1), (3, None)]
    for rows in (epochs, epochs[::-1]):
        curve = spark.createDataFrame(rows, "epoch int, v double").coalesce(1).groupBy("epoch").agg(exact_avg("v").alias("loss"))
        assert sc.curve_summary(curve, epoch="epoch", metrics=["loss"], losses=["loss"]).first().trend == "flat"
    many = spark.createDataFrame([(1, 0.048)] * 10 + [(2, 0.04), (2, 0.056)] + [(2, 0.048)] * 23, "epoch int, v double")
    assert [r.m for r in many.groupBy("epoch").agg(exact_avg("v").alias("m")).collect()] == [0.048, 0.048]


def test_curve_means_follow_the_rows(spark, tmp_path):
    """Means are added up in the order of the rows, as the SQL does, though the rows lie in several files: ties of rounding and trend are the SQL's."""
    import duckdb
    import pyarrow.parquet as pq

    from skyledger.workloads.registry import WORKLOADS

    table = pq.read_table("/root/testdata/sf0.01/lineitem.parquet")
    (tmp_path / "lineitem.parquet").mkdir()
    for i in range(4):
        pq.write_table(table.slice(i * 17000, 17000), tmp_path / "lineitem.parquet" / f"part-{i}.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    query = WORKLOADS["training_curves"]
    assert sorted(tuple(r) for r in query.run(spark, str(tmp_path)).collect()) == sorted(con.sql(query.sql).fetchall())


def test_pixels_of_blocks_past_the_last_row(spark):
    lon, lat = tl.pixel_to_lonlat(F.lit(19), F.lit(524300), F.lit(875300), F.lit(17.0), F.lit(3.25))
    row = spark.range(1).select(lon.alias("lon"), lat.alias("lat"))
    place = lambda bounded: tl.lonlat_to_pixel(F.lit(19), F.lit(524300), F.lit(875300), F.col("lon"), F.col("lat"), bounded)
    there = row.select(*[F.round(c, 3).alias(n) for c, n in zip([*place(False), *place(True)], "xyab")]).first()
    assert (there.x, there.y, there.a, there.b) == (17.0, 3.25, None, None)


def test_labels_across_chunks_and_tasks(spark):
    """Chunks of a few runs and several tasks give the components of the whole mask; null keys are a mask too."""
    g = np.random.default_rng(3)
    picture = g.random((3, 25, 30)) < 0.45
    picture[2] = False
    picture[2, :, 3] = True
    picture[2, ::4, 3:20] = True
    rows = [("a", "b", None)[i] for i in range(3)]
    runs = [(rows[i], int(y) - 2, int(x) - 2, int(x) - 1) for i, y, x in zip(*np.nonzero(picture))]
    merged = mk.merge_runs(spark.createDataFrame(runs, "k string, y bigint, x0 bigint, x1 bigint"), ["k"])
    got = {}
    for r in mk.label_components(merged, ["k"]).collect():
        got |= {(r.k, r.y, x): (r.component.y, r.component.x0) for x in range(r.x0, r.x1)}
    want = {}
    for k, y, x in sorted(((k or "", y, x) for k, y, x, _ in runs)):
        if (k, y, x) in want:
            continue
        todo = [(y, x)]
        want[k, y, x] = (y, x)
        while todo:
            cy, cx = todo.pop()
            for near in ((cy + j, cx + i) for j in (-1, 0, 1) for i in (-1, 0, 1)):
                if picture[rows.index(k or None), near[0] + 2, near[1] + 2] if 0 <= near[0] + 2 < 25 and 0 <= near[1] + 2 < 30 else False:
                    if (k, *near) not in want:
                        want[k, *near] = (y, x)
                        todo.append(near)
    assert {(k or "", y, x): c for (k, y, x), c in got.items()} == want

    table = merged.orderBy("k", "y", "x0").toArrow()
    parts = list(mk._labelled(table.to_batches(max_chunksize=3), ["k"], chunk=7))
    assert len(parts) > 20 and sum(p.num_rows for p in parts) == table.num_rows


def test_nearest_references_read_no_frame_to_its_end(spark, capsys):
    """A full day of references and as many questions: frames that end at the last row cost the square of a day."""
    from skyledger.operators.tracks import same_day_reference

    refs = spark.range(0, 86400, 2).selectExpr("1 AS day", "id AS second", "concat('r', id) AS name")
    asks = spark.range(86400).selectExpr("1 AS day", "id AS second")
    out = same_day_reference(asks, refs, day="day", second="second", name="name")
    out.explain()
    assert "unboundedfollowing" not in capsys.readouterr().out.lower()
    far = out.selectExpr("count(*) AS n", "max(reference_minutes) AS far", "count_if(reference = concat('r', second)) AS own").first()
    assert (far.n, far.own) == (86400, 43200) and abs(far.far - 1 / 60) < 1e-12


def test_many_small_files_are_written_by_many_tasks(spark, tmp_path):
    """Rows of one task become one file each, written by several tasks; the reader finds them from their folders."""
    from skyledger.sources.files import read_results
    from skyledger.sources.sinks import write_small_files

    rows = spark.range(40).coalesce(1).selectExpr("concat('{\"source_file\": \"i', id, '\", \"targets\": []}') AS value", "concat('found_', id % 3) AS folder")
    write_small_files(rows, str(tmp_path / "r"), "folder", per_file=1)
    files = list((tmp_path / "r").glob("folder=*/*.txt"))
    assert len(files) == 40 and len({f.name.split("-")[1] for f in files}) > 1
    back = read_results(spark, str(tmp_path / "r")).collect()
    assert {r.image for r in back} == {f"i{i}" for i in range(40)}
    assert not any(r.parse_error for r in back) and {r.prompt for r in back} == {f"folder=found {i}" for i in range(3)}


def test_result_records_share_files(spark, tmp_path, monkeypatch):
    """The files of a tree follow the tasks that write it and not its records; a broken line is marked and the others are kept."""
    from skyledger.sources.files import explode_targets, read_results
    from skyledger.workloads import files
    from skyledger.workloads.registry import WORKLOADS

    monkeypatch.setattr(files, "scratch_path", lambda spark, label: str(tmp_path / label))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        assert WORKLOADS["result_tree"].run(spark, "/root/testdata/sf0.001").agg({"targets": "sum"}).first()[0] == 1000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    written = [f for f in (tmp_path / "results").glob("*/*") if not f.name.startswith((".", "_"))]
    assert len({f.parent for f in written}) == 5 and len(written) <= 10

    (tmp_path / "tree" / "left_car").mkdir(parents=True)
    lines = ['{"source_file": "a", "text_prompt": "", "targets": [{"bbox": [1, 2, 3, 4]}, {}]}', "", '{"source_file": "b", "tar', '{"source_file": "c", "text_prompt": "bus"}']
    (tmp_path / "tree" / "left_car" / "r.json").write_text("\n".join(lines))
    back = read_results(spark, str(tmp_path / "tree"), lines=True)
    assert {(r.image, r.prompt) for r in back.where("NOT parse_error").collect()} == {("a", "left car"), ("c", "bus")}
    assert len(back.where("parse_error").collect()) == 1 and [r.x2 for r in explode_targets(back).orderBy("position").collect()] == [3.0, None]


def test_journal_lands_in_as_many_files_as_partitions(spark, monkeypatch):
    """A fixed number of files makes tasks that grow with the table."""
    from skyledger.workloads import extra

    made = []
    monkeypatch.setattr(extra, "_landed", lambda t, df, label, landed=extra._landed: made.append(landed(t, df, label)) or made[-1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert extra.WORKLOADS["stream_live_state"].run(spark, "/root/testdata/sf0.001").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(spark.read.parquet(made[0]).inputFiles()) == 9


def test_near_boxes_meet_in_the_cell_of_a_centre(spark):
    """From IoU 0.5 on, one side has one row and the other a row for the few cells its centre may be off; all pairs come, once, at the limit and across levels too."""
    from skyledger.operators import overlap as ov

    g = np.random.default_rng(11)
    lead = np.column_stack([g.uniform(-3, 3, 400), g.uniform(-3, 3, 400), g.uniform(0.01, 0.6, 400), g.uniform(0.01, 0.6, 400)])
    near = np.repeat(lead, 3, 0) * np.concatenate([np.ones((1200, 2)), g.uniform(0.85, 1.15, (1200, 2))], 1) + np.concatenate([g.uniform(-0.02, 0.02, (1200, 2)), np.zeros((1200, 2))], 1)
    exact = np.array([[0, 0, 0.0625, 0.5], [0, 0, 0.0625, 0.45], [0, 0, 0.125, 1], [0.0625, 0, 0.0625, 1], [1, 1, 1, 1], [1, 1, 0.9, 1], [1.1, 1, 0.9, 1]])
    b = np.concatenate([lead, near, exact])
    b[:, 2:] += b[:, :2]
    df = spark.createDataFrame([(0, i, *map(float, v)) for i, v in enumerate(b)], "image int, id int, x1 double, y1 double, x2 double, y2 double")
    side = lambda k: np.clip(np.minimum(b[:, None, k + 2], b[None, :, k + 2]) - np.maximum(b[:, None, k], b[None, :, k]), 0, None)
    inter, area = side(0) * side(1), (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
    iou = inter / (area[:, None] + area[None, :] - inter)
    for limit in (0.5, 0.65, 0.9, 1.0):
        got = sorted((r.a_id, r.b_id) for r in ov.overlap_pairs(df, None, group=["image"], id_col="id", min_iou=limit, base=0.0625).collect())
        assert got == [(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(iou >= limit))) if i < j]
        both = ov.overlap_pairs(df.where("id % 2 = 0"), df.where("id % 2 = 1"), group=["image"], id_col="id", min_iou=limit, base=0.0625).collect()
        assert sorted((r.a_id, r.b_id) for r in both) == [(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(iou >= limit))) if i % 2 == 0 and j % 2 == 1]
    sided = [ov._sided(df, ["image"], "id", p) for p in ("a_", "b_")]
    plan = ov._centre_pairs(*sided, ["image"], 0.9, 0.0625)
    assert plan.select("a_id", "b_id").distinct().count() == plan.count()


def test_flags_and_key_stay_within_compiled_methods(spark):
    """Flags and rounded key as one step, in methods the JVM compiles (up to 8,000 bytes), with F.round's own values."""
    import re

    from skyledger.operators import labels as lb

    values = [0.1234565, 2.5e-7, -0.0, 0.5 + 5e-7, 1e9 + 0.1234565, float("nan"), None, 0.61]
    rows = spark.createDataFrame([(1, "car", values), (1, "car", values[::-1]), (1, None, [0.1 * i for i in range(10)])], "class_id int, class_name string, coords array<double>")
    flagged = lb.flag_objects(rows)
    assert flagged.where(~F.col("coords_key").eqNullSafe(F.transform("coords", lambda v: F.round(v, 6)))).count() == 0
    text = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(flagged._jdf.queryExecution().executedPlan())
    assert all(int(n) < 8000 for n in re.findall(r"maxMethodCodeSize:(\d+)", text))


def test_class_conflicts_multiply_copies_and_skip_no_class(spark):
    from skyledger.operators import labels as lb

    box = (0.1, 0.1, 0.3, 0.3)
    rows = [("a", c, *box) for c in [1] * 40 + [2] * 30 + [None] * 5] + [("a", 3, 0.1, 0.1, 0.3, 0.301), ("b", 1, *box)]
    flagged = spark.createDataFrame(rows, "image string, class_id int, x1 double, y1 double, x2 double, y2 double")
    assert [(r.image, r.class_conflicts) for r in lb.class_conflicts(flagged, ["image"]).collect()] == [("a", 40 * 30 + 70)]


def test_small_sets_are_walked_in_one_pass(spark, monkeypatch):
    """Sets of few boxes take the walk without arrays, with the same founders; array walks are left to large sets and odd numbers."""
    import pandas as pd

    from skyledger.operators import resolve as rs

    g = np.random.default_rng(5)
    n = 3000
    at = g.integers(0, 6, (n, 2)) * 2.0
    box = np.concatenate([at, at + g.integers(8, 12, (n, 2))], 1)
    pdf = pd.DataFrame(box, columns=["x1", "y1", "x2", "y2"]).assign(comp=g.integers(0, 400, n), id=np.arange(n), pos=[(float(v),) for v in g.permutation(n)], conf=g.integers(0, 5, n) / 4)
    calls = []
    arrays = rs._walk_one
    monkeypatch.setattr(rs, "_walk_one", lambda *a: calls.append(1) or arrays(*a))
    few = rs._walker(0.6)(pdf).set_index("id")["founder"].sort_index()
    assert not calls
    monkeypatch.setattr(rs, "FEW", 0)
    assert (rs._walker(0.6)(pdf).set_index("id")["founder"].sort_index() == few).all() and len(calls) == pdf["comp"].nunique()
    assert few.nunique() < n


def test_vehicle_rows_of_many_clusters():
    """Clusters that are searched together, in batches cut anywhere, give the rows of the plain rule; a line is looked at once per size of a group, not
    once per row that is taken."""
    import pyarrow as pa

    from skyledger.operators import arrangement as ar

    def plain(at, tolerance, gap):
        reach, open_, left = max(2 * gap, (gap * gap + 4 * tolerance * tolerance) ** 0.5) + 2e-6, set(range(len(at))), []
        while open_:
            linked, edge = set(), [min(open_)]
            while edge:
                n = edge.pop()
                linked.add(n)
                edge += [m for m in open_ - linked - set(edge) if (np.abs(at[m] - at[n]) <= reach).all()]
            open_ -= linked
            left.append(sorted(linked))
        for free in left:
            while True:
                best = None
                for n, a in enumerate(free):
                    for b in free[n + 1:]:
                        step = at[b] - at[a]
                        if not 1e-6 <= np.hypot(*step) <= 2 * gap:
                            continue
                        axis = step / np.hypot(*step)
                        axis = -axis if axis[0] < 0 or (abs(axis[0]) < 1e-12 and axis[1] < 0) else axis
                        off = {m: abs(axis[0] * (at[m] - at[a])[1] - axis[1] * (at[m] - at[a])[0]) for m in free}
                        line = sorted((at[m] @ axis, m) for m in free if off[m] <= tolerance)
                        cuts = [0, *[i for i in range(1, len(line)) if line[i][0] - line[i - 1][0] > gap], len(line)]
                        for i, j in zip(cuts, cuts[1:]):
                            row = [m for _, m in line[i:j]]
                            key = (len(row), line[j - 1][0] - line[i][0], -np.mean([off[m] for m in row]), [-m for m in row])
                            if len(row) >= 3 and (best is None or key > best[0]):
                                best = (key, row)
                if best is None:
                    break
                yield frozenset(best[1])
                free = [m for m in free if m not in best[1]]

    g = np.random.default_rng(11)
    parts, want = [], set()
    for c in range(40):
        n = int(g.integers(1, 22))
        at = g.uniform(0, 100, (n, 2))
        at = at[np.lexsort((at[:, 1], at[:, 0]))]
        tolerance, gap = float(g.uniform(4, 9)), float(g.uniform(12, 25))
        parts.append({"component": [c] * n, "aoi": [c % 7] * n, "id": [f"v{c}-{i}" for i in range(n)], "cx": at[:, 0], "cy": at[:, 1], "tolerance": [tolerance] * n, "gap": [gap] * n})
        want |= {frozenset(f"v{c}-{i}" for i in row) for row in plain(at, tolerance, gap)}
    table = pa.concat_tables([pa.table(p) for p in parts])
    assert len(want) > 40 and max(map(len, want)) > 4
    for rows, size in ((4096, 1000), (60, 13), (1, 1)):
        cut = (b for k in range(0, len(table), size) for b in table.slice(k, size).combine_chunks().to_batches())
        got = [frozenset(r["ids"]) for b in ar._search_rows(cut, rows) for r in b.to_pylist()]
        assert len(got) == len(set(got)) and set(got) == want

    # A full car park of 20 rows: many rows of one size, but few sizes.
    at = np.array([(12.0 * i, 40.0 * j) for i in range(12) for j in range(20)])
    n = len(at)
    park = pa.table({"component": [0] * n, "aoi": [0] * n, "id": range(n), "cx": at[:, 0], "cy": at[:, 1], "tolerance": [4.0] * n, "gap": [14.0] * n})
    seen, groups = [], ar._groups
    try:
        ar._groups = lambda *a, **k: (seen.append(len(a[8])) or groups(*a, **k))
        out = [r for b in ar._search_rows(iter(park.to_batches())) for r in b.to_pylist()]
    finally:
        ar._groups = groups
    assert sorted(len(r["ids"]) for r in out) == [12] * 20 and sum(seen) <= 3 * seen[0]


def test_vehicle_rows_of_odd_input(spark):
    """Ids that are only unique in their area, areas and ids as text, boxes that are not finite, copies and lone vehicles."""
    from skyledger.operators.arrangement import vehicle_rows

    inf = float("inf")
    box = lambda area, name, x, y: (area, name, x - 4.0, y - 2.0, x + 4.0, y + 2.0)
    rows = [box(area, f"v{i}", 100.0 * k + 12 * i, 20.0) for k, area in enumerate("ab") for i in range(4)] + [box("c", "v0", 5.0, 5.0)]
    odd = [("a", "n1", 0.0, 0.0, inf, 4.0), ("a", "n2", 0.0, float("nan"), 4.0, 4.0), ("a", "n3", -inf, 0.0, inf, 4.0), ("b", "n4", None, 0.0, 4.0, 4.0), ("b", "n5", 4.0, 0.0, 4.0, 4.0)]
    schema = "place string, kind string, x1 double, y1 double, x2 double, y2 double"
    got = {tuple(r) for r in vehicle_rows(spark.createDataFrame(rows + odd, schema), "place", "kind").collect()}
    assert got == {(area, 1, f"v{i}", 0.0) for area in "ab" for i in range(4)}
    assert vehicle_rows(spark.createDataFrame([], schema), "place", "kind").count() == 0
