"""Structured Streaming forms of the append-only journals: live review state, incremental screening,
progress windows, running label counters and frame positions."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from skyledger.operators.reviews import latest_state
from skyledger.operators.tracks import nearest_in_time
from skyledger.session import cut, drop, path_exists
from skyledger.sources.buckets import BucketStore
from skyledger.sources.sinks import current, publish


def read_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """Files as they arrive. A cap on files in a batch bounds its size, but with watermarks it also decides what is late, so there is none by default."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def _drain(writer) -> StreamingQuery:
    """Process everything that has arrived, then stop; the checkpoint remembers what was read."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a checkpoint gives to its query; another checkpoint counts its batches anew under another id."""
    (text,) = spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()
    return json.loads(text)["id"]


def merge_state(rows: DataFrame, *, key: str, order: Sequence[str]) -> DataFrame:
    """Current state of all rows of a key: the last write wins, and an automatic record never replaces a human one, whichever came first.
    Merging merged rows again changes nothing."""
    human = F.when(F.coalesce("is_auto", F.lit(False)), 0).otherwise(1)
    return latest_state(rows.withColumn("_human", human), key=key, order=["_human", *order]).drop("_human")


def review_store(spark: SparkSession, schema, base: str, *, key: str, order: Sequence[str], **sizes: int) -> BucketStore:
    """The live review state, one row a key, in buckets."""
    return BucketStore(spark, base, schema, [key], lambda rows: merge_state(rows, key=key, order=order), **sizes)


def live_state(spark: SparkSession, log_path: str, schema, base: str, checkpoint: str, *, key: str, order: Sequence[str],
               max_files: int | None = None, **sizes: int) -> DataFrame:
    """Fold a growing review log into a state table in buckets and return the current state.

    A batch writes the buckets of the keys that it holds and no others. Progress is kept per checkpoint beside the data: a batch that is played again
    changes nothing, and a new checkpoint, which plays the log from its start, folds it again with the same result, rows included that arrived
    between the two. A log without rows is an empty state.
    """
    store = review_store(spark, schema, base, key=key, order=order, **sizes)
    stream = read_stream(spark, log_path, schema, max_files)
    _drain(stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, epoch: store.fold(batch, stream_id(spark, checkpoint), epoch)))
    return store.state()


def incremental(spark: SparkSession, path: str, schema, out: str, checkpoint: str, *, key: str, screen: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Screen only what is new: files already read are skipped through the checkpoint, repeated keys through a table of the
    keys of earlier batches, so no state grows in the executors."""
    seen = f"{out}-seen"

    def fold(batch: DataFrame, epoch: int) -> None:
        fresh = batch.dropDuplicates([key])
        if path_exists(spark, seen):
            before = spark.read.schema(f"batch bigint, {kind}").parquet(seen).where(F.col("batch") < epoch)
            fresh = fresh.join(before.select(key), key, "left_anti").select(*batch.columns)
        # A batch that is played again replaces its own folders.
        fresh.select(key).write.mode("overwrite").parquet(f"{seen}/batch={epoch}")
        screen(fresh).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    stream = read_stream(spark, path, schema)
    kind = f"`{key}` {stream.schema[key].dataType.simpleString()}"
    _drain(stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(fold))
    result = screen(spark.createDataFrame([], stream.schema)).schema
    return spark.read.schema(result).parquet(out)


def activity(events: DataFrame, *, time: str, width: str, lateness: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts per tumbling window; works on a stream (with a watermark) and on a table."""
    if events.isStreaming:
        events = events.withWatermark(time, lateness)
    counted = events.groupBy(F.window(time, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), *by, "n")


def activity_windows(stream: DataFrame, base: str, checkpoint: str, *, time: str, width: str, lateness: float, by: Sequence[str] = (), **sizes: int) -> DataFrame:
    """Counts per tumbling window as they are now: start, by, n, late, state.

    Every batch adds its counts to the windows that it touches. A window is provisional until the watermark (the greatest time of earlier batches less
    `lateness` seconds) has passed its end, then final; rows that come later are counted as late and not in n, so nothing that was reported as
    final changes and nothing is lost. Counts and progress become visible together, so a batch counts once; a new checkpoint counts from the start.
    Rows without a time are in no window.
    """
    spark = stream.sparkSession
    kinds = dict(stream.dtypes)
    schema = StructType.fromDDL(", ".join(["start timestamp", "end timestamp", *[f"`{c}` {kinds[c]}" for c in by], "n bigint", "late bigint"]))
    add = lambda rows: rows.groupBy("start", "end", *by).agg(F.sum("n").alias("n"), F.sum("late").alias("late"))
    store = BucketStore(spark, base, schema, ["start", *by], add, **sizes)
    seconds = lambda c: F.col(c).cast("double")

    def fold(batch: DataFrame, epoch: int) -> None:
        me, now = stream_id(spark, checkpoint), store.version()
        if now.progress.get(me, -1) >= epoch:
            return
        mine = me in now.progress
        mark = now.marks.get("time") if mine else None
        windowed = batch.where(F.col(time).isNotNull()).groupBy(F.window(time, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("m"), F.max(time).alias("top"))
        counted = cut(windowed.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "m", seconds("top").alias("top")), "windows")
        late = F.lit(False) if mark is None else seconds("end") <= F.lit(mark - lateness)
        rows = counted.select("start", "end", *by, F.when(late, 0).otherwise(F.col("m")).cast("bigint").alias("n"), F.when(late, F.col("m")).otherwise(0).cast("bigint").alias("late"))
        top = counted.agg(F.max("top")).first()[0]
        marks = [v for v in (mark, top) if v is not None]
        store.fold(rows, me, epoch, {"time": max(marks)} if marks else None, fresh=not mine)
        drop(counted)

    _drain(stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(fold))
    newest = store.version()
    passed = F.lit(False) if "time" not in newest.marks else seconds("end") <= F.lit(newest.marks["time"] - lateness)
    return store.state(newest).select("start", *by, "n", "late", F.when(passed, "final").otherwise("provisional").alias("state"))


def drain_to_table(df: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Append the finished windows of a stream to a table."""
    _drain(df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append"))
    return df.sparkSession.read.schema(df.schema).parquet(out)


def running_totals(stream: DataFrame, base: str, checkpoint: str) -> DataFrame:
    """Publish the complete result of an aggregating stream after each batch."""
    schema = stream.schema

    def keep(batch: DataFrame, epoch: int) -> None:
        if batch.limit(1).count():
            publish(batch, base)

    _drain(stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(keep))
    return current(stream.sparkSession, base, schema)


def frame_positions(frames: DataFrame, positions: DataFrame, out: str, checkpoint: str, **join) -> DataFrame:
    """Match arriving frames to a static track, batch by batch, with the nearest-in-time join."""
    spark = frames.sparkSession

    def match(batch: DataFrame, epoch: int) -> None:
        # One folder per batch: a replayed batch replaces its own folder.
        nearest_in_time(batch, positions, **join).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    _drain(frames.writeStream.option("checkpointLocation", checkpoint).foreachBatch(match))
    return spark.read.parquet(out)
