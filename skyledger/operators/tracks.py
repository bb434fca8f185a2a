"""Time joins and trajectory features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from skyledger.operators.ordered import linear_quantile, ordered_scan


def _around(group: WindowSpec, order: str, value: str) -> tuple[Column, Column]:
    """The nearest value that is not null at or before, and at or after, each row. Both look back, one in falling order: a frame that ends
    at the last row is read to its end again for every row."""
    back = lambda o: F.last(value, ignorenulls=True).over(group.orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return back(F.col(order)), back(F.desc(order))


def nearest_in_time(
    frames: DataFrame, positions: DataFrame, *, key: Sequence[str], frame_id: str, time: str, order: str,
    payload: Sequence[str], near: float = 1.0, tolerance: float = 5.0,
) -> DataFrame:
    """Frames with the nearest positioned record of their track within the tolerance, either side.

    delta <= near is srt_frame, delta <= tolerance srt_interpolated, else none with a null payload;
    the record that comes first in `order` wins ties. Time is cut into buckets as wide as the
    tolerance and every record is also offered to the two neighbouring buckets, so the windows hold
    one bucket of one track and a long track is spread over its buckets. Records at the same moment
    are reduced to the first before the shuffle.
    """
    key = list(key)
    bucket = lambda c: F.floor(F.col(c) / tolerance).cast("bigint")
    record = F.struct(F.col(time).alias("rt"), F.col(order).alias("ro"), *[F.col(p).alias(p) for p in payload])
    firsts = positions.where(F.col(time).isNotNull()).groupBy(*key, F.col(time).alias("t")).agg(F.min_by(record, order).alias("r"))
    offered = firsts.select(*key, F.explode(F.array(*[bucket("t") + d for d in (-1, 0, 1)])).alias("b"), "t", "r")
    asked = frames.select(*key, F.col(time).alias("t")).distinct().select(*key, bucket("t").alias("b"), "t", F.lit(True).alias("asked"))
    both = offered.withColumn("asked", F.lit(False)).unionByName(
        asked.withColumn("r", F.lit(None).cast(offered.schema["r"].dataType))
    )
    before, after = _around(Window.partitionBy(*key, "b"), "t", "r")
    seen = both.select(*key, "t", "asked", before.alias("p"), after.alias("n")).where("asked")
    gap = lambda side: F.abs(F.col(f"{side}.rt") - F.col("t"))
    choice = lambda side: F.when(F.col(side).isNotNull(), F.struct(gap(side).alias("delta"), F.col(f"{side}.ro").alias("o"), F.col(side).alias("r")))
    best = seen.select(*key, F.col("t").alias(time), F.least(choice("p"), choice("n")).alias("m"))
    inside = F.col("m.delta") <= tolerance
    return frames.join(best, [*key, time], "left").select(
        *frames.columns,
        F.when(F.col("m.delta") <= near, "srt_frame").when(inside, "srt_interpolated").otherwise("none").alias("match"),
        F.when(inside, F.col("m.delta")).alias("delta"),
        *[F.when(inside, F.col(f"m.r.{p}")).alias(p) for p in payload],
    )


def same_day_reference(queries: DataFrame, references: DataFrame, *, day: str, second: str, name: str) -> DataFrame:
    """The nearest reference of the same day for each query (least name on ties), with the gap in
    minutes; no reference that day gives nulls.

    `second` is the whole second of the day, so after reducing both sides to distinct seconds a day
    has at most 86,400 rows however many files it holds.
    """
    refs = references.groupBy(day, F.col(second).alias("s")).agg(F.min(name).alias("ref"))
    refs = refs.select(day, "s", F.struct(F.col("s").alias("rs"), "ref").alias("r"), F.lit(False).alias("asked"))
    asks = queries.select(day, F.col(second).alias("s")).distinct().select(
        day, "s", F.lit(None).cast(refs.schema["r"].dataType).alias("r"), F.lit(True).alias("asked")
    )
    before, after = _around(Window.partitionBy(day), "s", "r")
    both = refs.unionByName(asks).select(day, "s", "asked", before.alias("p"), after.alias("n"))
    side = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.rs") - F.col("s")).alias("d"), F.col(f"{c}.ref").alias("ref")))
    found = both.where("asked").select(day, F.col("s").alias(second), F.least(side("p"), side("n")).alias("m"))
    return queries.join(found, [day, second]).select(
        *queries.columns, F.col("m.ref").alias("reference"), (F.col("m.d") / 60).alias("reference_minutes")
    )


def time_issues(points: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], *, strict: bool = True) -> DataFrame:
    """Per sequence, how many steps in `order` fail to increase (or decrease, when not strict)."""
    scanned = ordered_scan(points, keys, order, lag={"_before": time})
    step = F.col(time) - F.col("_before")
    bad = (step <= 0) if strict else (step < 0)
    return scanned.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), F.count_if(bad).alias("time_errors"))


def trajectory_features(points: DataFrame, *, agent: str, time: str = "t", x: str = "x", y: str = "y", speed: str = "speed",
                        stop_speed: float = 0.2) -> DataFrame:
    """Duration, displacement, path length, median and p95 speed (interpolated), stop share and
    whether it starts and ends stopped, per agent. Repeated times are an error.

    Points are scanned over range partitions and speeds ranked the same way, so one agent may hold
    most of the table.
    """
    scanned = ordered_scan(
        points.select(agent, time, x, y, speed), [agent], [time], lag={"_t": time, "_x": x, "_y": y}
    )
    dx, dy = F.col(x) - F.col("_x"), F.col(y) - F.col("_y")
    first, last = (lambda c: F.min_by(c, time)), (lambda c: F.max_by(c, time))
    basic = scanned.groupBy(agent).agg(
        F.count(F.lit(1)).alias("points"), F.count_if(F.col(time) <= F.col("_t")).alias("_bad"),
        (F.max(time) - F.min(time)).alias("duration"),
        F.sqrt((last(x) - first(x)) * (last(x) - first(x)) + (last(y) - first(y)) * (last(y) - first(y))).alias("displacement"),
        F.coalesce(F.sum(F.sqrt(dx * dx + dy * dy)), F.lit(0.0)).alias("path_length"),
        (F.count_if(F.col(speed) <= stop_speed) / F.count(F.lit(1))).alias("stop_fraction"),
        (first(speed) <= stop_speed).alias("starts_stopped"), (last(speed) <= stop_speed).alias("ends_stopped"),
    )
    ranks = linear_quantile(points, [agent], speed, {"median_speed": 0.5, "speed_p95": 0.95})
    checked = F.when(F.col("_bad") > 0, F.raise_error(F.lit("timestamps must strictly increase"))).otherwise(F.col("points"))
    return basic.join(ranks, agent, "left").withColumn("points", checked).drop("_bad")


def chain_breaks(instances: DataFrame, token: str = "token", prev: str = "prev", next_: str = "next") -> DataFrame:
    """Links that disagree: a's next must name an instance whose prev is a, and the reverse."""
    a, b = instances.alias("a"), instances.alias("b")
    forward = a.where(F.col(f"a.{next_}") != "").join(b, F.col(f"a.{next_}") == F.col(f"b.{token}"), "left")
    backward = a.where(F.col(f"a.{prev}") != "").join(b, F.col(f"a.{prev}") == F.col(f"b.{token}"), "left")
    bad_next = forward.where(~F.col(f"b.{prev}").eqNullSafe(F.col(f"a.{token}")))
    bad_prev = backward.where(~F.col(f"b.{next_}").eqNullSafe(F.col(f"a.{token}")))
    pick = lambda df, side: df.select(F.col(f"a.{token}").alias(token), F.lit(side).alias("side"))
    return pick(bad_next, "next").unionByName(pick(bad_prev, "prev"))


def agent_points(frames: DataFrame, instances: DataFrame, agents: DataFrame) -> DataFrame:
    """Instances with their frame time and agent; an instance of another scene than its frame is an error."""
    joined = instances.join(
        frames.select(F.col("frame_token"), F.col("scene").alias("frame_scene"), F.col("timestamp")), "frame_token"
    ).join(agents.select("agent_token", "agent_type"), "agent_token")
    scene = F.when(
        F.col("scene") != F.col("frame_scene"), F.raise_error(F.lit("instance belongs to another scene"))
    ).otherwise(F.col("scene"))
    return joined.withColumn("scene", scene).drop("frame_scene")


def gap_groups(points: DataFrame, keys: Sequence[str], position: str, order: Sequence[str], *, max_gap: float, min_size: int = 3) -> DataFrame:
    """Split ordered positions where the step is larger than max_gap; groups below min_size are left out."""
    stepped = ordered_scan(points, keys, order, lag={"_before": position}).withColumn(
        "_new", F.when(F.col(position) - F.col("_before") > max_gap, 1).otherwise(0)
    )
    numbered = ordered_scan(stepped.drop("_before"), keys, order, total={"gap_group": "_new"}).drop("_new")
    sizes = numbered.groupBy(*keys, "gap_group").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    return numbered.join(sizes, [*keys, "gap_group"])


def link_facts(frames: DataFrame, instances: DataFrame, agents: DataFrame) -> DataFrame:
    """Per scene: frames, instances and agents; instances without their frame or agent, instances whose frame is of another scene,
    broken links; and whether the scene is accepted (none of these) or blocked.

    frames (token, scene), instances (token, scene, frame_token, agent_token, prev, next), agents (token, scene).
    """
    f = frames.select(F.col("token").alias("frame_token"), F.col("scene").alias("_of_frame"), F.lit(True).alias("_frame"))
    a = agents.select(F.col("token").alias("agent_token"), F.lit(True).alias("_agent"))
    seen = instances.join(f, "frame_token", "left").join(a, "agent_token", "left")
    broken = chain_breaks(instances).join(instances.select("token", "scene"), "token").groupBy("scene").agg(F.count(F.lit(1)).alias("chain_breaks"))
    facts = seen.groupBy("scene").agg(
        F.count(F.lit(1)).alias("instances"), F.count_if(F.col("_frame").isNull()).alias("missing_frame"),
        F.count_if(F.col("_agent").isNull()).alias("missing_agent"), F.count_if(F.col("_of_frame") != F.col("scene")).alias("foreign_scene"),
    )
    count = lambda df, name: df.groupBy("scene").agg(F.count(F.lit(1)).alias(name))
    joined = facts.join(count(frames, "frames"), "scene", "full").join(count(agents, "agents"), "scene", "full").join(broken, "scene", "left")
    faults = ["missing_frame", "missing_agent", "foreign_scene", "chain_breaks"]
    filled = joined.select("scene", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("frames", "instances", "agents", *faults)])
    total = sum((F.col(c) for c in faults), F.lit(0))
    return filled.withColumn("status", F.when(total == 0, "accepted").otherwise("blocked"))
