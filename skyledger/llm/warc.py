"""Content-addressed web archive: payload bytes once by digest, exact record headers apart, records rebuilt by joins.

An archive is a folder with two tables. `payloads` holds (sha256, payload) for every different payload; `headers` holds
one row for each record: its id, type, the exact header block, and the digest of the payload block it carries (null for
a revisit, which carries none). Digests are verified when the archive is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.session import scratch_path

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def write_archive(pages: DataFrame, path: str, min_revisit: int = 1000, date: str = "2020-01-01T00:00:00Z") -> None:
    """Write one record for each row of pages (page_id, url, html) to the archive folder `path`.

    Of records with equal payloads of at least min_revisit bytes the one with the largest page_id is the response and
    the others revisit it; smaller payloads always go with responses. A null html is an empty payload, a null url an
    empty target, line breaks in a url are escaped. A row without page_id can neither be referred to nor refer: it is a
    response. Repeated rows of the response's page are responses as well. Payloads move once (to meet their digest's
    owner); everything else moves as digests and ids.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    named = rows.withColumn("payload_sha256", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    light = named.select("page_id", "url", "payload_sha256", F.sha1(F.col("payload").cast("binary")).alias("sha1"), "n_bytes")
    # One row for each digest: the owner's id, whatever the number of copies (combined before the shuffle).
    owners = light.groupBy("payload_sha256").agg(F.max("page_id").alias("owner"))
    # Both the join and the removal of repeated rows work on (digest, id), so payloads are shuffled once, and only one row of each digest passes.
    key = lambda c: F.coalesce(F.col(c), F.lit(-(1 << 63))).alias("key")
    bodies = (
        named.select("payload_sha256", key("page_id"), "payload")
        .join(owners.select("payload_sha256", key("owner")), ["payload_sha256", "key"], "left_semi")
        .dropDuplicates(["payload_sha256", "key"])
        .select(F.col("payload_sha256").alias("sha256"), F.col("payload").cast("binary").alias("payload"))
    )
    bodies.write.option("compression", "zstd").parquet(f"{path}/payloads")

    joined = light.join(owners, "payload_sha256")
    revisit = (F.col("n_bytes") >= min_revisit) & F.coalesce(F.col("page_id") != F.col("owner"), F.lit(False))
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _uri(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", url),
        F.when(revisit, _line("WARC-Refers-To", _uri(F.col("owner")))).otherwise(""),
        F.when(revisit, _line("WARC-Profile", F.lit(PROFILE))).otherwise(""),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("X-Payload-Length", F.col("n_bytes").cast("string")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string"))),
        F.lit(CRLF),
    )
    joined.select(
        "page_id", header.alias("header"), F.when(~revisit, F.col("payload_sha256")).alias("block_sha256")
    ).write.option("compression", "zstd").parquet(f"{path}/headers")


def _field(name: str) -> Column:
    found = F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The records' headers, parsed: page_id, record_type, refers_to, target, digest, length, and the exact block."""
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    long = lambda c: F.when(c != "", c.cast("long"))
    return spark.read.parquet(f"{path}/headers").select(
        long(number(_field("WARC-Record-ID"))).alias("page_id"),
        _field("WARC-Type").alias("record_type"),
        long(number(_field("WARC-Refers-To"))).alias("refers_to"),
        F.coalesce(_field("WARC-Target-URI"), F.lit("")).alias("target"),
        F.regexp_extract(_field("WARC-Payload-Digest"), "^sha1:([0-9a-f]{40})$", 1).alias("stated_sha1"),
        _field("X-Payload-Length").cast("long").alias("stated_bytes"),
        "block_sha256",
        "header",
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Stored payloads with their size and SHA-1, recomputed from the bytes; a payload that does not have the digest it is filed under fails the job."""
    stored = spark.read.parquet(f"{path}/payloads")
    verified = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("sha256")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("sha256"))).cast("string")
    )
    return stored.select(verified.alias("block_sha256"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "payload")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Original records: header block, payload and the two closing line breaks, as `record` bytes."""
    joined = read_headers(spark, path).join(read_payloads(spark, path).select("block_sha256", "payload"), "block_sha256", "left")
    end = F.lit(CRLF * 2).cast("binary")
    return joined.select(
        "page_id", "record_type", "refers_to",
        F.concat(F.col("header").cast("binary"), F.coalesce("payload", F.lit(b"")), end).alias("record"),
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: a response's from its own payload, a revisit's
    from the payload of the response it refers to. Payloads are digested where they lie, so the joins move digests."""
    heads = read_headers(spark, path)
    bodies = read_payloads(spark, path).drop("payload")
    blocks = heads.where(F.col("record_type") == "response").select("page_id", "record_type", "refers_to", "block_sha256").join(bodies, "block_sha256")
    responses = blocks.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    owners = responses.where(F.col("page_id").isNotNull()).groupBy(F.col("page_id").alias("refers_to")).agg(
        F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest")
    )
    revisits = heads.where(F.col("record_type") == "revisit").select("page_id", "record_type", "refers_to", "stated_sha1").join(owners, "refers_to")
    checked = F.when(F.col("payload_digest") == F.col("stated_sha1"), F.col("payload_digest")).otherwise(
        F.raise_error(F.lit("a revisit's digest differs from its response's")).cast("string")
    )
    return responses.unionByName(
        revisits.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to an archive in the shared folder and read it back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archive(pages, path)
    return read_pages(spark, path)
