"""Reading the file forms of the data: JSON lines, result trees, label text, GeoJSON, road elements,
review sheets, curves, block images and registered files. All readers take declared schemas, so no
file is read just to infer one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET = (
    "struct<bbox: array<double>, confidence: double, class_name: string, mask_file: string, source_prompt: string, "
    "source_prompts: array<string>, prompt_hits: int, source_target_id: string, source_target_ids: array<string>>"
)
RESULT = f"source_file string, text_prompt string, prompt_mode string, targets array<{TARGET}>"
POINTS = "array<array<array<array<double>>>>"

# File kinds by suffix.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff")
VIDEO_SUFFIXES = (".mp4", ".mov", ".avi", ".mkv")
SIDECAR_SUFFIXES = (".srt",)


def _raw_json(spark: SparkSession, path: str, schema: str, lines: bool, below: bool = False) -> DataFrame:
    reader = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE")
    if not lines:
        reader = reader.option("multiLine", "true")
    return (reader.option("recursiveFileLookup", "true") if below else reader).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Good lines of a JSON-lines file or folder; blank and broken lines are skipped."""
    return _raw_json(spark, path, schema, True).where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def count_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Good and broken lines."""
    raw = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"}).alias("r"))
    bad = F.col("r._corrupt_record").isNotNull()
    return raw.agg(F.count_if(~bad).alias("records"), F.count_if(bad).alias("parse_errors"))


def read_results(spark: SparkSession, root: str, lines: bool = False) -> DataFrame:
    """Result records under one folder per prompt: files of one JSON object each, or of one object a line, which split. The prompt falls back to the
    folder name with spaces for underscores. parse_error marks unreadable files or lines. Folders are listed, not one path for each file."""
    raw = _raw_json(spark, f"{root}/*", RESULT, lines, below=True)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    named = F.coalesce(F.when(F.col("text_prompt") != "", F.col("text_prompt")), F.regexp_replace(folder, "_", " "))
    return raw.select(
        F.col("source_file").alias("image"), named.alias("prompt"), "prompt_mode", "targets", folder.alias("folder"),
        F.col("_corrupt_record").isNotNull().alias("parse_error"),
    )


def explode_targets(results: DataFrame) -> DataFrame:
    """One row per target, keeping images without targets out, with the position in its file."""
    rows = results.where(~F.col("parse_error")).select("image", "prompt", "folder", F.posexplode("targets").alias("position", "t"))
    box = [F.get("t.bbox", F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]
    return rows.select("image", "prompt", "folder", "position", *box, "t.confidence", "t.class_name", "t.mask_file")


def read_label_text(spark: SparkSession, root: str, numbered: bool = False) -> DataFrame:
    """Label lines below split folders: split, image and line, from labels/<split>/<image>.txt (the image is the file's stem) or
    from folders split=<split>/image=<image>. With numbered, each file (one image) is read whole and its lines
    carry their number from 1, blank lines counted."""
    path = F.col("_metadata.file_path")
    folder = F.regexp_extract(path, r"/image=([^/]+)/", 1)
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")
    raw = spark.read.text(root, wholetext=numbered, recursiveFileLookup=True).select(
        F.regexp_extract(path, r".*/(?:split=)?(train|val|test)/", 1).alias("split"), F.when(folder != "", folder).otherwise(stem).alias("image"), "value"
    )
    if not numbered:
        return raw.where(F.trim("value") != "")
    lines = raw.select("split", "image", F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("line", "value"))
    return lines.where(F.trim("value") != "").select("split", "image", (F.col("line") + 1).alias("line"), "value")


def _positions(geometry: Column) -> Column:
    """Coordinates of any plain geometry as polygons of rings of positions: a point is one ring of one position, a line one ring."""
    read = lambda kind: F.from_json(geometry, f"coordinates {kind}")["coordinates"]
    kind = F.get_json_object(geometry, "$.type")
    ring, rings = "array<array<double>>", "array<array<array<double>>>"
    return (
        F.when(kind == "MultiPolygon", read(POINTS)).when(kind.isin("Polygon", "MultiLineString"), F.array(read(rings)))
        .when(kind.isin("LineString", "MultiPoint"), F.array(F.array(read(ring)))).when(kind == "Point", F.array(F.array(F.array(read("array<double>")))))
    )


def read_features(spark: SparkSession, path: str, properties: str, lines: bool = True) -> DataFrame:
    """Features of GeoJSON: one feature per line, or whole FeatureCollection files. Coordinates of every geometry type come in
    the nesting of a MultiPolygon; broken lines and files are left out, a feature without geometry has null coordinates."""
    fields = f"type: string, geometry: string, properties: struct<{properties}>"
    if lines:
        flat = _raw_json(spark, path, ", ".join(_top_level(fields)), True).where(F.col("_corrupt_record").isNull())
    else:
        docs = _raw_json(spark, path, f"type string, features array<struct<{fields}>>", False).where(F.col("_corrupt_record").isNull())
        flat = docs.select(F.explode("features").alias("f")).select("f.*")
    return flat.select(F.get_json_object("geometry", "$.type").alias("geometry_type"), _positions(F.col("geometry")).alias("coordinates"), "properties.*")


def _top_level(inner: str) -> list[str]:
    """Split a struct body at its outer commas and write each field as a column definition."""
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(inner + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = inner[start:i].strip().split(":", 1)
            parts.append(f"{name.strip()} {kind.strip()}")
            start = i + 1
    return parts


WAY = "type string, id bigint, tags map<string,string>, geometry array<struct<lon: double, lat: double>>"


def read_road_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of road documents ({elements: [...]})."""
    element = "struct<type: string, id: bigint, tags: map<string,string>, geometry: array<struct<lon: double, lat: double>>>"
    return _raw_json(spark, path, f"elements array<{element}>", True).select(F.explode("elements").alias("e")).select("e.*")


def read_sheet(spark: SparkSession, path: str, columns: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """A review sheet as text columns, taken by the names in its header whatever their order; a byte-order mark is ignored,
    a missing required column is an error, any other missing column is null."""
    sheet = spark.read.option("header", "true").option("encoding", "UTF-8").csv(path)
    sheet = sheet.toDF(*[c.lstrip("\ufeff").strip() for c in sheet.columns])
    missing = sorted(set(required) - set(sheet.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return sheet.select(*[F.col(f"`{c}`") if c in sheet.columns else F.lit(None).cast("string").alias(c) for c in columns])


def read_curve(spark: SparkSession, path: str) -> DataFrame:
    """A training curve: spaces around headers and values are dropped and numbers are numbers."""
    df = spark.read.option("header", "true").option("inferSchema", "true").option("ignoreLeadingWhiteSpace", "true").option(
        "ignoreTrailingWhiteSpace", "true"
    ).csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def list_files(spark: SparkSession, path: str, name_pattern: str = r"([^/]+)$") -> DataFrame:
    """Names and sizes of files below a folder; their content is not read. name_pattern takes the name out of a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", name_pattern, 1).alias("name"), F.col("length").alias("size"))


def list_blocks(spark: SparkSession, path: str, name_pattern: str = r"([^/]+)$") -> DataFrame:
    """Block images below a folder with their fields and bounds; a folder without any is an error, other files are left out."""
    from skyledger.functions import tiles as tl

    found = list_files(spark, path, name_pattern).where(tl.is_block(F.col("name"))).withColumn("block", tl.parse_block(F.col("name")))
    if found.isEmpty():
        raise ValueError(f"no block images in {path}")
    bounds = [c.alias(n) for c, n in zip(tl.block_bounds(F.col("block")), ("west", "south", "east", "north"))]
    return found.select("name", "size", "block.zoom", "block.block_row", "block.block_col", *bounds)


def file_kind(name: Column) -> Column:
    """image, video, sidecar or other by suffix."""
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    return (
        F.when(suffix.isin(list(IMAGE_SUFFIXES)), "image").when(suffix.isin(list(VIDEO_SUFFIXES)), "video")
        .when(suffix.isin(list(SIDECAR_SUFFIXES)), "sidecar").otherwise("other")
    )


def verify_files(spark: SparkSession, path: str, manifest: DataFrame, budget: int, name_pattern: str = r"([^/]+)$") -> DataFrame:
    """Registered files (name, size, sha256) against what is on disk: ok, missing, size, checksum or
    unsafe_name, and whether the registered total is within the byte budget. name_pattern takes the
    registered name out of a path."""
    from skyledger.functions.keys import safe_name

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        F.regexp_extract("path", name_pattern, 1).alias("name"), F.col("length").alias("found_size"), F.sha2("content", 256).alias("found_sha")
    )
    total = manifest.agg(F.sum("size").alias("total")).select((F.col("total") <= budget).alias("within_budget"))
    status = (
        F.when(~safe_name(F.col("name")), "unsafe_name").when(F.col("found_size").isNull(), "missing")
        .when(F.col("found_size") != F.col("size"), "size").when(F.col("found_sha") != F.col("sha256"), "checksum").otherwise("ok")
    )
    return manifest.join(found, "name", "left").withColumn("status", status).join(F.broadcast(total))  # one row


def check_revision(rows: DataFrame, url: str, pinned: str) -> DataFrame:
    """Rows whose address names another revision than the pinned one: must be empty."""
    revision = F.regexp_extract(url, r"/--/([^/]+)/--/", 1)
    return rows.where(revision != pinned).withColumn("revision", revision)


def run_listing(assets: DataFrame) -> DataFrame:
    """Runs with asset, located and failed counts and the latest status."""
    return assets.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("assets"), F.count("latitude").alias("georeferenced"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.max_by("status", "updated").alias("last_status"),
    )
