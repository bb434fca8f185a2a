import pytest
from pyspark.sql import functions as F

from skyledger.operators.ordered import keep_first, keep_last, linear_quantile, nearest_rank, ordered_scan, top_per_group
from skyledger.operators.tracks import nearest_in_time, trajectory_features


def test_scan_of_one_hot_group_over_many_chunks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(2000).select(F.when(F.col("id") < 1900, "hot").otherwise("cold").alias("g"), (F.col("id") * 7919 % 2003).alias("v"), F.lit(1).alias("one"))
        out = ordered_scan(df.repartition(8), ["g"], ["v"], rank="rn", lag={"before": "v"}, total={"cum": "one"}, size="n").toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for _, g in out.sort_values("v").groupby("g"):
        assert list(g.rn) == list(range(1, len(g) + 1)) == list(g.cum)
        assert list(g.before.iloc[1:]) == list(g.v.iloc[:-1]) and g.before.iloc[:1].isna().all()
        assert set(g.n) == {len(g)}


def test_nearest_rank_rounds_half_to_even_and_skips_nulls(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(6)] + [("a", None), ("b", 4.0)], "g string, v double")
    got = {r.g: (r.n, r.mid) for r in nearest_rank(df, ["g"], "v", {"mid": 0.5}).collect()}
    assert got == {"a": (6, 2.0), "b": (1, 4.0)}  # index 2.5 goes to 2
    assert nearest_rank(df, [], "v", {"mid": 0.5}).first().n == 7


def test_linear_quantile(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 1.0), (1, 0.0)], "k int, v double")
    r = linear_quantile(df, ["k"], "v", {"median": 0.5, "p95": 0.95}).first()
    assert r.median == 0.0 and abs(r.p95 - 0.9) < 1e-9


def test_keep_and_top(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (2, 2, "c")], "k int, o int, v string")
    assert {r.v for r in keep_last(df, ["k"], ["o"]).collect()} == {"b", "c"}
    assert {r.v for r in keep_first(df, ["k"], ["o"]).collect()} == {"a", "c"}
    many = spark.range(5000).withColumn("k", F.lit(1))
    assert top_per_group(many, ["k"], ["id"], 1500).agg(F.max("id")).first()[0] == 1499


def test_trajectory_features_and_repeated_time(spark):
    schema = "agent int, t double, x double, y double, speed double"
    r = trajectory_features(spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0), (1, 1.0, 1.0, 0.0, 1.0), (1, 2.0, 2.0, 0.0, 0.0)], schema), agent="agent").first()
    assert (r.duration, r.displacement, r.path_length, r.median_speed) == (2.0, 2.0, 2.0, 0.0)
    assert abs(r.speed_p95 - 0.9) < 1e-9 and abs(r.stop_fraction - 2 / 3) < 1e-9 and r.starts_stopped and r.ends_stopped
    with pytest.raises(Exception, match="strictly increase"):
        trajectory_features(spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0), (1, 0.0, 1.0, 0.0, 1.0)], schema), agent="agent").collect()


def test_nearest_position(spark):
    pos = spark.createDataFrame([(1, 0.0, 0, "a"), (1, 1.0, 1, "b"), (1, 2.0, 2, "c")], "k int, t double, o int, p string")
    ask = spark.createDataFrame([(1, 10, 1.05), (1, 11, 6.0), (1, 12, 60.0), (1, 13, 0.5), (1, 14, -4.9), (1, 15, 1.5)], "k int, f int, t double")
    out = nearest_in_time(ask, pos, key=["k"], frame_id="f", time="t", order="o", payload=["p"]).collect()
    got = {r.f: (r.match, r.p) for r in out}
    assert got[10] == ("srt_frame", "b") and got[11] == ("srt_interpolated", "c") and got[12] == ("none", None)
    assert got[13] == ("srt_frame", "a") and got[14] == ("srt_interpolated", "a") and got[15] == ("srt_frame", "b")
