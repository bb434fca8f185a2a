"""Helpers shared by the training-data operators: grouped Arrow work and pairs of blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.session import cut, drop

__all__ = ["cut", "drop", "grouped", "block_pairs", "remainder", "small_batches", "table", "tasks"]


@contextmanager
def small_batches(spark, rows: int = 1000):
    """Texts travel to Python in batches of this many rows: a batch lies in memory several times on both sides, and a job of many stages keeps what it took."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def remainder(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the id written as text, modulo mod; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(mod)


def tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Rows of each key, which arrive side by side, as one table."""
    held: list[pa.RecordBatch] = []

    def same(a, i, b, j):
        return all(a.column(k)[i].as_py() == b.column(k)[j].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        if held and not same(held[-1], held[-1].num_rows - 1, batch, 0):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def grouped(df: DataFrame, keys: Sequence[str], fn: Callable[[pa.Table], dict | None], schema: str, rows: int = 1 << 16) -> DataFrame:
    """fn over the rows of every key (keys: whole numbers without nulls); fn returns columns, or None for no rows.

    One Python call a batch, not one a key. Callers see to it that a key has a bounded number of rows.
    """

    def run(batches):
        names = [c.strip().split(" ")[0] for c in schema.split(",")]
        out, n = [], 0
        for group in _groups(batches, keys):
            got = fn(group)
            if got is not None and len(got[names[0]]):
                out.append(pa.record_batch({k: pa.array(got[k]) for k in names}))
                n += out[-1].num_rows
            if n >= rows:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out, n = [], 0
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return df.repartition(tasks(df), *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def block_pairs(members: DataFrame, bucket: str, id_col: str, size: int) -> DataFrame:
    """Deal the members of every bucket into blocks of about `size` by a hash of the id, and give each pair of blocks
    (p <= q) its own rows: columns p, q, first (in block p), second (in block q) are added.

    A bucket of n members makes (n / size)^2 / 2 groups of bounded size, spread over all tasks.
    """
    sizes = members.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    blocks = F.ceil(F.col("_n") / F.lit(size)).cast("int")
    placed = members.join(sizes, bucket).withColumn("_k", blocks).withColumn(
        "_i", F.pmod(F.xxhash64(F.lit("block"), F.col(id_col)), F.col("_k").cast("long")).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_j")
    return (
        placed.select("*", other)
        .withColumn("p", F.least("_i", "_j"))
        .withColumn("q", F.greatest("_i", "_j"))
        .withColumn("first", F.col("_i") == F.col("p"))
        .withColumn("second", F.col("_i") == F.col("q"))
        .drop("_i", "_j", "_k", "_n")
    )
