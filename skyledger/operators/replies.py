"""Tables of model replies, metric logs and subtitle texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions import text as tx


def parsed_replies(replies: DataFrame, text: str, allowed: Sequence[str]) -> DataFrame:
    """Replies with the extracted JSON, the chosen label and whether it came from the structure."""
    parsed = replies.withColumn("parsed", tx.extract_json(F.col(text)))
    structured = F.get_json_object("parsed", "$.label")
    inside = F.coalesce(structured.isin(list(allowed)), F.lit(False))
    return parsed.withColumns({
        "structured": inside,
        "label": F.when(inside, structured).otherwise(tx.parse_label(F.col(text), allowed)),
    })


def last_metrics(lines: DataFrame, *, run: str, order: str, line: str) -> DataFrame:
    """The last value of each metric in the log of each run."""
    found = lines.select(run, order, tx.line_metrics(F.col(line)).alias("m"))
    last = lambda c: F.max_by(F.col(f"m.{c}"), F.when(F.col(f"m.{c}").isNotNull(), F.col(order)))
    return found.groupBy(run).agg(*[last(c).alias(c) for c in ("precision", "recall", "map50", "map50_95")])


def subtitle_positions(texts: DataFrame, *, text: str, keep: Sequence[str]) -> DataFrame:
    """Position records of subtitle texts: one row per block that has a time or a position."""
    blocks = texts.select(*keep, F.posexplode(F.split(F.col(text), r"\n\s*\n")).alias("block", "_b"))
    return _present(blocks, tx.subtitle_record(F.col("_b")), *keep, "block").select(
        *keep, "block", "r.time_seconds", "r.latitude", "r.longitude", "r.altitude_m"
    )


def _present(df: DataFrame, value, *keep: str) -> DataFrame:
    """Rows where value is not null, as column r. Exploding a one-element list evaluates a long
    expression once, where a filter on it would be pushed down and evaluate it twice."""
    return df.select(*keep, F.explode(F.array_compact(F.array(value))).alias("r"))


def verdicts(parsed: DataFrame, json_text: str, *keep: str) -> DataFrame:
    """Normalised verdicts of replies that hold a valid one."""
    return _present(parsed, tx.verdict(F.col(json_text)), *keep, json_text).select(
        *keep, json_text, "r.verdict", "r.confidence", "r.problems", "r.evidence"
    )


def resolve_alias(labels: DataFrame, aliases: DataFrame, label: str = "label", source: str = "source_kind") -> DataFrame:
    """Leaf class of each label for its source kind; vague or unknown labels stay null."""
    table = aliases.select(F.col("alias").alias(label), F.col("source_kind").alias(source), "leaf")
    return labels.join(table, [label, source], "left")
