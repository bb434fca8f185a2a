"""Writing results: JSON lines, GeoJSON features, sheets, label text, layers and published versions."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.session import path_exists


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def feature_json(geometry: Column, properties: Sequence[str], truth: str) -> Column:
    """One GeoJSON feature as text, its truth status among the properties."""
    body = F.struct(*properties, F.lit(truth).alias("truth_status"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), body.alias("properties")))


def write_features(df: DataFrame, path: str, *, geometry: Column, properties: Sequence[str], truth: str) -> None:
    """Features one per line, so readers and writers split the file."""
    df.select(feature_json(geometry, properties, truth).alias("value")).write.text(path)


def write_sheet(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """A sheet sorted by id; nested values become JSON text."""
    nested = ("struct", "array", "map")
    flat = [F.to_json(F.col(c)).alias(c) if t.startswith(nested) else F.col(c) for c, t in df.dtypes]
    df.orderBy(*order).select(*flat).write.option("header", "true").csv(path)


def label_line(class_id: Column, coords: Column) -> Column:
    """Class id and coordinates with six decimals."""
    return F.concat_ws(" ", class_id.cast("string"), F.array_join(F.transform(coords, lambda v: F.format_string("%.6f", v)), " "))


def write_labels(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Label text per split and image. Each image is written by one task, its lines in order. Images are dealt by ranges: by hash, a few
    large ones would meet in one task and be sorted together."""
    # Named as Spark names the folder of a null. Folder columns that may be null are sorted once more by the writer, and the planner then leaves out the sort of the lines.
    folder = lambda c: F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c).cast("string")), F.lit("__HIVE_DEFAULT_PARTITION__")).alias(c)
    rows = df.select(folder("split"), folder("image"), *order, "class_id", "coords")
    (
        rows.repartitionByRange("split", "image").sortWithinPartitions("split", "image", *order)
        .select("split", "image", label_line(F.col("class_id"), F.col("coords")).alias("value")).write.partitionBy("split", "image").text(path)
    )


def write_small_files(df: DataFrame, path: str, folder: str, per_file: int = 0) -> None:
    """Text rows into very many files below one folder per value (per_file: at most so many rows each). The rows are few bytes but many files, so they are dealt to a
    given number of tasks, and each task moves its own files into place; by default the driver would move them one after the other."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(tasks) if per_file else df.repartition(tasks, folder)
    dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").option("maxRecordsPerFile", per_file).partitionBy(folder).text(path)


def write_layers(df: DataFrame, path: str, layer: str = "layer") -> None:
    """One folder per layer in one pass."""
    df.write.partitionBy(layer).json(path)


def publish(df: DataFrame, base: str, batch: int | None = None) -> str:
    """Write a new version next to the old ones, check it, then point to it.

    Nothing is overwritten: a version that fails or is empty is never pointed to and readers keep the previous one. Pointers are
    files numbered upwards that are created once, so of two writers of one number the second fails, whatever their clocks say.
    """
    spark = df.sparkSession
    number = (published(spark, base) or {"number": 0})["number"] + 1
    version = f"{base}/versions/{number:012d}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(version)
    written = spark.read.schema(df.schema).parquet(version)
    if not written.limit(1).count():
        raise ValueError("an empty version is not published")
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/pointer/{number:012d}.json")
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, False)
    try:
        out.write(bytearray(json.dumps({"number": number, "version": version, "batch": batch}).encode()))
    finally:
        out.close()
    return version


def published(spark: SparkSession, base: str) -> dict | None:
    """Number, folder and batch of the newest version; None if nothing was published. Errors of the store are errors here too."""
    if not path_exists(spark, f"{base}/pointer"):
        return None
    pointers = spark.read.schema("number bigint, version string, batch bigint").json(f"{base}/pointer").where("number IS NOT NULL")
    row = pointers.agg(F.max(F.struct("number", "version", "batch")).alias("p")).first()["p"]
    return row.asDict() if row else None


def current(spark: SparkSession, base: str, schema) -> DataFrame:
    """The published version."""
    newest = published(spark, base)
    if newest is None:
        raise ValueError(f"nothing is published in {base}")
    return spark.read.schema(schema).parquet(newest["version"])
