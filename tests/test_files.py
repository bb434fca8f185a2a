"""Readers on the forms that real files have, and publishing that survives failed reads and replays."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from skyledger.session import scratch_path
from skyledger.sources import files, sinks
from skyledger.sources.buckets import BucketStore
from skyledger.streaming import jobs


def test_sheet_columns_go_by_name(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("label,target_id\naccept,7\n", encoding="utf-8-sig")
    row = files.read_sheet(spark, str(path), ["target_id", "label", "note"], required=["target_id"]).first()
    assert (row.target_id, row.label, row.note) == ("7", "accept", None)
    with pytest.raises(ValueError, match="reviewer"):
        files.read_sheet(spark, str(path), ["target_id", "reviewer"], required=["reviewer"])


def test_label_files_of_a_split(spark, tmp_path):
    folder = tmp_path / "labels" / "train"
    folder.mkdir(parents=True)
    (folder / "img_1.txt").write_text("0 .1 .1\n\n1 .2 .2\n")
    (folder / "img_2.txt").write_text("2 .3 .3")
    got = {(r.split, r.image, r.value) for r in files.read_label_text(spark, str(tmp_path / "labels")).collect()}
    assert got == {("train", "img_1", "0 .1 .1"), ("train", "img_1", "1 .2 .2"), ("train", "img_2", "2 .3 .3")}
    lines = {(r.image, r.line, r.value) for r in files.read_label_text(spark, str(tmp_path / "labels"), numbered=True).collect()}
    assert lines == {("img_1", 1, "0 .1 .1"), ("img_1", 3, "1 .2 .2"), ("img_2", 1, "2 .3 .3")}


def test_features_of_every_geometry(spark, tmp_path):
    shapes = [
        ("Point", "[1.5,2]", [[[[1.5, 2.0]]]]), ("LineString", "[[1,2],[3,4]]", [[[[1.0, 2.0], [3.0, 4.0]]]]), ("Polygon", "[[[0,0],[1,0],[0,0]]]", [[[[0.0, 0.0], [1.0, 0.0], [0.0, 0.0]]]]),
        ("MultiPolygon", "[[[[0,0],[1,1],[0,0]]]]", [[[[0.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]]), ("MultiLineString", "[[[0,0],[1,1]]]", [[[[0.0, 0.0], [1.0, 1.0]]]]),
    ]
    lines = ['{"type":"Feature","geometry":{"type":"%s","coordinates":%s},"properties":{"id":%d}}' % (k, c, i) for i, (k, c, _) in enumerate(shapes)]
    path = tmp_path / "f.jsonl"
    path.write_text("\n".join([*lines, '{"type":"Feature","geometry":{', '{"type":"Feature","geometry":null,"properties":{"id":9}}']))
    got = {r.id: (r.geometry_type, r.coordinates) for r in files.read_features(spark, str(path), "id: int").collect()}
    assert got == {i: (k, c) for i, (k, _, c) in enumerate(shapes)} | {9: (None, None)}


def _review_log(spark, tmp_path, **sizes):
    """(write rows, fold the log with a checkpoint, the store)"""
    base, log = scratch_path(spark, "state"), str(tmp_path / "log")
    schema = "target_id bigint, noted double, is_auto boolean"
    kind = spark.createDataFrame([], schema).schema
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(log)
    live = lambda ck: jobs.live_state(spark, log, kind, base, str(tmp_path / ck), key="target_id", order=["noted"], **sizes)
    return write, live, jobs.review_store(spark, kind, base, key="target_id", order=["noted"], **sizes)


def test_state_fails_on_unreadable_layers_and_ignores_replays(spark, tmp_path):
    write, live, store = _review_log(spark, tmp_path, buckets=2, max_layers=1)
    write([(1, 1.0, False), (2, 1.0, True)])
    assert live("a").count() == 2
    first = store.version()
    # The same checkpoint has nothing new to play; a batch that it played is not folded again.
    live("a")
    (me,) = first.progress
    store.fold(store.state(), me, 0)
    assert store.version() == first
    write([(1, 2.0, False)])
    (layer,) = {f for folders in first.layers.values() for f in folders}
    gone = f"{store.base}/layers/{layer}".replace("file:", "")
    os.rename(gone, gone + "-away")
    with pytest.raises(Exception):
        live("a")
    assert store.version() == first
    os.rename(gone + "-away", gone)
    assert {(r.target_id, r.noted) for r in live("a").collect()} == {(1, 2.0), (2, 1.0)}


def test_new_checkpoint_keeps_rows_that_arrived_meanwhile(spark, tmp_path):
    write, live, store = _review_log(spark, tmp_path)
    write([(1, 1.0, False)])
    live("a")
    write([(2, 1.0, False), (1, 3.0, True)])
    for _ in range(2):
        assert {(r.target_id, r.noted) for r in live("b").collect()} == {(1, 1.0), (2, 1.0)}
    assert len(store.version().progress) == 2
    write([(3, 1.0, False)])
    assert live("a").count() == 3


def test_state_of_a_log_without_rows(spark, tmp_path):
    write, live, store = _review_log(spark, tmp_path)
    write([])
    assert live("a").collect() == [] and store.state().collect() == []
    write([(1, 1.0, True)])
    assert live("a").count() == 1


def test_batches_write_only_the_buckets_they_touch(spark):
    schema = spark.createDataFrame([], "k bigint, v bigint").schema
    latest = lambda rows: rows.groupBy("k").agg(F.max("v").alias("v"))
    store = BucketStore(spark, scratch_path(spark, "buckets"), schema, ["k"], latest, buckets=50, max_layers=3)
    store.fold(spark.range(1000).selectExpr("id AS k", "0L AS v"), "s", 0)
    first = store.version()
    assert len(first.layers) == 50
    for epoch in range(1, 7):
        before = store.version()
        store.fold(spark.range(1).selectExpr("7L AS k", f"{epoch}L AS v"), "s", epoch)
        after = store.version()
        changed = {b for b in after.layers if after.layers[b] != before.layers[b]}
        assert len(changed) == 1 and all(len(v) <= 3 for v in after.layers.values())
        assert store.state().where("k = 7").first().v == epoch and store.state().count() == 1000
    # An older version still reads as it was until its layers are cleared away.
    assert store.state(first).where("k = 7").first().v == 0
    assert store.vacuum() > 0 and store.unused() == [] and store.state().where("v > 0").count() == 1
    assert store.fold(spark.range(5).selectExpr("id AS k", "9L AS v"), "s", 6) == store.version()
    assert store.state().where("v = 9").count() == 0


def test_activity_windows(spark, tmp_path):
    base, path = scratch_path(spark, "windows"), str(tmp_path / "events")
    schema = "ts timestamp, kind string"
    at = lambda h, m, kind: (datetime.datetime(2024, 1, 1, h, m), kind)

    def land(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)

    def read(checkpoint, store=base):
        stream = jobs.read_stream(spark, path, spark.createDataFrame([], schema).schema)
        out = jobs.activity_windows(stream, store, str(tmp_path / checkpoint), time="ts", width="1 hour", lateness=3600, by=["kind"], buckets=4)
        return {(r.start.hour, r.kind): (r.n, r.late, r.state) for r in out.collect()}

    land([at(1, 0, "a"), at(1, 59, "a"), at(2, 30, "b"), (None, "a")])
    assert read("x") == {(1, "a"): (2, 0, "provisional"), (2, "b"): (1, 0, "provisional")}
    land([at(1, 5, "a"), at(5, 0, "a")])
    assert read("x") == {(1, "a"): (3, 0, "final"), (2, "b"): (1, 0, "final"), (5, "a"): (1, 0, "provisional")}
    land([at(2, 0, "b"), at(4, 0, "c"), at(0, 10, "a")])
    late = {(1, "a"): (3, 0, "final"), (2, "b"): (1, 1, "final"), (5, "a"): (1, 0, "provisional"), (4, "c"): (1, 0, "provisional"), (0, "a"): (0, 1, "final")}
    assert read("x") == late == read("x")
    # Another checkpoint counts from the start, here all in one batch, so nothing is late and nothing counts twice.
    assert {k: v[:2] for k, v in read("y").items()} == {(1, "a"): (3, 0), (2, "b"): (2, 0), (5, "a"): (1, 0), (4, "c"): (1, 0), (0, "a"): (1, 0)}


def test_pointers_are_created_once(spark):
    base = scratch_path(spark, "pointers")
    assert sinks.published(spark, base) is None
    sinks.publish(spark.range(3), base)
    sinks.publish(spark.range(4), base)
    assert sinks.published(spark, base)["number"] == 2 and sinks.current(spark, base, "id bigint").count() == 4


def test_large_images_are_written_by_tasks_of_their_own(spark, tmp_path):
    """Few large images are dealt by ranges, one to a task, each in one file with its lines in order."""
    rows = spark.range(20_000).select(
        F.format_string("%06d", F.col("id") * 7919 % 20_000).alias("obj"), F.when(F.col("id") % 10 < 5, "train").otherwise("val").alias("split"), (F.col("id") % 10).cast("string").alias("image"), F.lit(1).alias("class_id"),
        F.array(*[(F.col("id") * 7919 % 20_000 / 1e6)] * 8).alias("coords"),
    )
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "20")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        sinks.write_labels(rows, str(tmp_path / "l"), ["obj"])
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    files = sorted((tmp_path / "l").rglob("part-*"))
    assert (len(files), len({f.name.split("-")[1] for f in files})) == (10, 10)
    assert all(lines == sorted(lines) and len(lines) == 2000 for lines in (f.read_text().splitlines() for f in files))
