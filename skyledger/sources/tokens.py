"""Reading JSON objects whose keys are data: one object with any number of entries, split over tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.session import cut, drop

ENTRY = r'(?s)^"((?:[^"\\]++|\\.)*+)"\s*:\s*(\{.*\})$'


def _count(text: Column, *marks: str) -> Column:
    bare = text
    for m in marks:
        bare = F.replace(bare, F.lit(m), F.lit(""))
    return F.length(text) - F.length(bare)


PLACED = "file string, start bigint, size bigint, bytes bigint, value string, parity int, plain bigint, quoted bigint, nth bigint"
JOINED = "file string, start bigint, nth bigint, led boolean, ended boolean, body string"


def _runs(batch) -> list[int]:
    """Where rows of another split begin, and the end."""
    start = batch["start"].to_numpy()
    other = start[1:] != start[:-1]
    if batch.num_rows > 1:
        other |= pc.not_equal(batch["file"].slice(1), batch["file"].slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(other) + 1).tolist(), batch.num_rows]


def _placed(batches):
    """Running sums within each split, whose pieces a task reads in order: parity of the quotes, depth if the split begins outside of
    a string and if it begins inside of one, number of the piece. Every piece counts as closed by its brace."""
    at, sums = None, (0, 0, 0, 0)
    for batch in batches:
        if not batch.num_rows:
            continue
        quotes, open_, quoted = (batch[c].to_numpy() for c in ("quotes", "open", "quoted"))
        parity, plain, inner, nth = (np.empty(batch.num_rows, dtype=np.int64) for _ in range(4))
        cuts = _runs(batch)
        for lo, hi in zip(cuts, cuts[1:]):
            here = (batch["file"][lo].as_py(), batch["start"][lo].as_py())
            if here != at:
                at, sums = here, (0, 0, 0, 0)
            s = slice(lo, hi)
            after = (sums[0] + np.cumsum(quotes[s])) % 2
            before = (after + quotes[s]) % 2
            parity[s] = after
            plain[s] = sums[1] + np.cumsum(np.where(before == 1, quoted[s], open_[s]) - (after == 0))
            inner[s] = sums[2] + np.cumsum(np.where(before == 0, quoted[s], open_[s]) - (after == 1))
            nth[s] = sums[3] + np.arange(1, hi - lo + 1)
            sums = tuple(int(v[hi - 1]) for v in (parity, plain, inner, nth))
        yield pa.record_batch({
            **{c: batch[c] for c in ("file", "start", "size", "bytes", "value")},
            "parity": parity.astype(np.int32), "plain": plain, "quoted": inner, "nth": nth,
        })


def _joined(batches):
    """Text from one end of an entry to the next, within rows that follow each other. led: it may begin before these rows; not ended: it may go on behind them."""
    at, first, parts, led = None, 0, [], True
    for batch in batches:
        out = []
        for file, start, nth, end, text in zip(*(batch[c].to_pylist() for c in ("file", "start", "nth", "end", "text"))):
            if at != (file, start, nth - 1):
                if parts:
                    out.append((at[0], at[1], first, led, False, "".join(parts)))
                parts, led = [], True
            if not parts:
                first = nth
            parts.append(text)
            at = (file, start, nth)
            if end:
                out.append((file, start, first, led, True, "".join(parts)))
                parts, led = [], False
        if out:
            yield _entries(out)
    if parts:
        yield _entries([(at[0], at[1], first, led, False, "".join(parts))])


def _entries(rows) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
    names = ("file", "start", "nth", "led", "ended", "body")
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_token_map(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows (file, token, value) of JSON maps from token to object; value has the given schema.

    A file is cut at its closing braces, so Spark's splits may part one object between tasks. Whether a piece starts inside a string
    is the parity of the quotes before it, its depth a running sum, and an entry ends where the depth is back at the map's own. The
    task that reads a split sums up for both ways in which the split may begin; one row a split is chained over each file and sent to all tasks, which then join
    pieces to entries where they lie. Only the text at both ends of a split is brought together. Several maps in one file are read one after the other,
    an empty file or map has no rows, a token that occurs twice has two rows. Files are not compressed. A file that is no map of objects, or has no end, fails the job.
    """
    # A piece ends at a brace, so no escape reaches into the next one.
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    shown = lambda text: F.regexp_replace(text, r'(?s)"[^"]*(?:"|$)', "")
    rise = lambda text: _count(shown(text), "{", "[") - _count(shown(text), "]")
    read = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), "value"
    )
    marks = read.select(
        "*", (F.octet_length("value") + 1).cast("bigint").alias("bytes"), _count(bare, '"').cast("bigint").alias("quotes"), rise(bare).cast("bigint").alias("open"),
        rise(F.concat(F.lit('"'), bare)).cast("bigint").alias("quoted"),
    )
    pieces = cut(marks.mapInArrow(_placed, PLACED), "pieces")
    failed = F.raise_error(F.concat(F.lit("no map of objects: "), F.col("file")))

    splits = pieces.groupBy("file", "start").agg(F.max("size").alias("size"), F.sum("bytes").alias("bytes"), F.max("nth").alias("last"), F.max_by(F.struct("parity", "plain", "quoted"), "nth").alias("sums"))
    chain, whole = Window.partitionBy("file").orderBy("start"), Window.partitionBy("file")
    before = lambda c: F.coalesce(F.sum(c).over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = splits.withColumn("inside", before("sums.parity") % 2 == 1).withColumn("step", F.when(F.col("inside"), F.col("sums.quoted")).otherwise(F.col("sums.plain")))
    # What follows the last brace of a file is a piece without one.
    loose = F.lead("start").over(chain).isNull() & (F.sum("bytes").over(whole) > F.col("size"))
    chained = begun.select("*", before("step").alias("depth"), F.sum("step").over(whole).alias("rest"), loose.alias("loose"))
    even = ((F.col("sums.parity") + F.col("inside").cast("int")) % 2 == 0) & F.col("loose")
    open_ = F.lead("start").over(chain).isNull() & (F.col("rest") + even.cast("int") != 0)
    known = cut(chained.select("file", "start", "inside", F.when(open_, failed.cast("bigint")).otherwise(F.col("depth")).alias("depth"), F.when(F.col("loose"), F.col("last")).alias("loose")), "splits")

    # One row a split of the input: no more than the driver lists to read it. A shuffle would lose the order of the pieces.
    seen = pieces.join(F.broadcast(known), ["file", "start"])
    outside = (F.col("parity") + F.col("inside").cast("int")) % 2 == 0
    closed = ~F.coalesce(F.col("loose") == F.col("nth"), F.lit(False))
    depth = F.col("depth") + F.when(F.col("inside"), F.col("quoted")).otherwise(F.col("plain")) + (outside & ~closed).cast("int")
    ends = seen.select("file", "start", "nth", (outside & (depth <= 1)).alias("end"), F.when(closed, F.concat("value", F.lit("}"))).otherwise(F.col("value")).alias("text"))
    joined = cut(ends.mapInArrow(_joined, JOINED), "entries")
    ended_before = F.sum(F.col("ended").cast("int")).over(Window.partitionBy("file").orderBy("start", "nth").rowsBetween(Window.unboundedPreceding, -1))
    parts = joined.where("led OR NOT ended").withColumn("entry", F.coalesce(ended_before, F.lit(0))).groupBy("file", "entry").agg(F.array_sort(F.collect_list(F.struct("start", "nth", "body"))).alias("parts"))
    met = parts.select("file", F.array_join(F.transform("parts", lambda p: p["body"]), "").alias("body"))
    body = F.regexp_replace("body", r"^[\s,]*\{?\s*", "")
    parts = joined.where("ended AND NOT led").select("file", "body").unionByName(met).select("file", body.alias("body"))
    # What is left of an outer end, or of blanks behind it, is no entry.
    entries = parts.where(~F.col("body").rlike(r"^\s*\}?$"))
    checked = entries.select("file", F.when(F.col("body").rlike(ENTRY), F.col("body")).otherwise(failed).alias("body"))
    token = F.from_json(F.concat(F.lit('["'), F.regexp_extract("body", ENTRY, 1), F.lit('"]')), "array<string>")[0]
    value = F.from_json(F.regexp_extract("body", ENTRY, 2), schema, {"mode": "FAILFAST"})
    out = cut(checked.select("file", token.alias("token"), value.alias("value")), "tokens")
    drop(pieces, joined)
    return out


def write_token_map(df: DataFrame, path: str, *, file: str, token: str, value: Column) -> None:
    """One map per value of `file`, in a folder of its own, entries in the order of their tokens; a file should hold what one task can."""
    name = F.to_json(F.array(token))
    entry = F.concat(F.substr(name, F.lit(2), F.length(name) - 2), F.lit(": "), F.to_json(value))
    rows = df.select(file, F.struct(F.col(token).alias("t"), entry.alias("e")).alias("r")).groupBy(file).agg(F.array_sort(F.collect_list("r")).alias("r"))
    body = F.concat(F.lit("{"), F.array_join(F.transform("r", lambda r: r["e"]), ", "), F.lit("}"))
    rows.select(file, body.alias("value")).write.partitionBy(file).text(path)
