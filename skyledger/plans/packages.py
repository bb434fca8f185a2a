"""Review packages as tables: golden review rows, fixed test lists and acceptance sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def golden_review_rows(chosen: DataFrame, name: str = "name") -> DataFrame:
    """One pending row per chosen image for the human reviewer."""
    extra = [c for c in chosen.columns if c not in (name, "turn", "_walk")]
    empty = F.lit("")
    return chosen.select(
        F.col(name).alias("image"), F.lit("pending").alias("review_status"), empty.alias("reviewer"),
        empty.alias("reviewed_at"), empty.alias("notes"), *extra,
    )


def unsigned_manifest(rows: DataFrame) -> DataFrame:
    """Counts for the manifest that two people still have to sign."""
    return rows.agg(
        F.count(F.lit(1)).alias("images"), F.count_if("risk").alias("risk_images"), F.lit(False).alias("approved"),
        *[F.lit("").alias(c) for c in ("reviewer", "approver", "approved_at")],
    )


def selection_summary(rows: DataFrame, density: str = "density", signature: str = "signature") -> DataFrame:
    """Counts of a selection as rows (kind, value, images): all, the risky ones, and each density and signature."""
    fact = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    facts = F.array_compact(F.array(
        fact("images", F.lit("all")), F.when(F.col("risk"), fact("images", F.lit("risk"))), fact("density", F.col(density)), fact("signature", F.col(signature)),
    ))
    return rows.select(F.explode(facts).alias("f")).groupBy("f.kind", "f.value").agg(F.count(F.lit(1)).alias("images"))


def acceptance_sheet(records: DataFrame, order: list, n: int = 30) -> DataFrame:
    """The first n shadow records with empty count cells for the reviewer to fill in."""
    cells = ["occupied_tp", "occupied_fp", "occupied_fn", "empty_tp", "empty_fp", "empty_fn", "critical_fp", "reviewer", "reviewed_at", "notes"]
    return records.orderBy(*order).limit(n).select("image", "comparison", *[F.lit("").alias(c) for c in cells])
