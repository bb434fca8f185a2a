"""The corpus pipeline: toxicity, near-duplicates, benchmark leaks, personal data, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before has kept; rows without doc_id are kept by
all stages that can only judge rows by id. Extra columns of docs are carried up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import bpe, decontam, minmax, pii, toxicity
from skyledger.llm.common import cut, small_batches, table
from skyledger.llm.queries import tokenizer_path

#: Tokenizing cannot be said in SQL; tests compare the whole with a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.7."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the least doc_id) of each group linked by a similarity of 0.8 on five-word shingles; one row of a repeated doc_id."""
    found = minmax.near_duplicates(docs, k=5, percent=80)
    acts = found.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(
        F.max(~F.col("kept")).alias("_gone"), (F.count(F.lit(1)) > 1).alias("_again")
    ).where("_gone OR _again")
    acts = cut(acts, "acts")
    once = docs.join(acts, docs["doc_id"] == acts["_id"], "left_anti")
    again = docs.join(acts.where("NOT _gone"), docs["doc_id"] == acts["_id"], "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(again)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage within a tenth of its length in edits of a benchmark item."""
    ids = decontam.leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(ids, docs["doc_id"] == ids["_id"], "left_anti")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows."""
    spans = pii.find(docs).where(F.size("found") > 0).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("found").alias("_spans")).dropDuplicates(["_id", "_key"])
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    # The row travels as one value, so its column names cannot clash with those of the spans.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc"), key.alias("_of"))
    both = rows.join(spans, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_key")), "left")
    text = F.when(F.col("_spans").isNotNull(), pii.redact(F.col("_row.text"), F.col("_spans"))).otherwise(F.col("_row.text"))
    shown = {"text": text}
    if "n_chars" in docs.columns:
        shown["n_chars"] = F.when(F.col("_spans").isNotNull(), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return both.select(*[shown.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and the text that the ids decode to."""
    path = tokenizer_path()
    # Written between the two: a task that encodes and decodes keeps two Python workers with a tokenizer each.
    coded = cut(bpe.encode(docs.select("doc_id", "lang", "source", "text"), path).drop("text"), "coded")
    return bpe.decode(coded, path).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("personal data", redact_personal_data),
    ("tokens", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    with small_batches(spark):
        for name, stage in STAGES:
            docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
