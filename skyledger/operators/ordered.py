"""Ordered operators that stay exact when one group holds a large share of all rows.

A plain window puts a whole group in one task. Here rows are range-partitioned by (keys, order)
first, so a large group is spread over many chunks; each chunk is ranked on its own and the few
per-chunk summaries are chained by a window over chunks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.session import cut


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    rank: str | None = None,
    lag: Mapping[str, str] | None = None,
    total: Mapping[str, str] | None = None,
    size: str | None = None,
) -> DataFrame:
    """Rank, lag and running total within keys, in ascending order of the `order` columns.

    rank   name of a 1-based rank column
    lag    {new column: source column} value of the row before in the group
    total  {new column: source column} running sum up to and including the row
    size   name of a column with the group's row count
    The order must be total within a group for repeatable results.
    """
    lag, total = dict(lag or {}), dict(total or {})
    keys, order = list(keys), list(order)
    # The chunk number must be the same wherever it is read, so it is written once.
    chunked = cut(
        df.repartitionByRange(*_cols(keys + order)).withColumn("_chunk", F.spark_partition_id()),
        "chunks",
    )
    aggs = [F.count(F.lit(1)).alias("_n")]
    if lag:
        tail = F.struct(*[F.col(src).alias(f"_t{i}") for i, src in enumerate(lag.values())])
        aggs.append(F.max_by(tail, F.struct(*_cols(order))).alias("_tail"))
    aggs += [F.sum(src).alias(f"_s{i}") for i, src in enumerate(total.values())]
    summary = chunked.groupBy(*keys, "_chunk").agg(*aggs)

    # One row per (group, chunk): at most groups + chunks rows in total.
    chain = Window.partitionBy(*keys).orderBy("_chunk")
    before = chain.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")]
    if size:
        carried.append(F.sum("_n").over(Window.partitionBy(*keys)).alias("_size"))
    if lag:
        carried.append(F.lag("_tail").over(chain).alias("_prev"))
    carried += [
        F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_c{i}")
        for i in range(len(total))
    ]
    links = summary.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_kc"), *carried
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    on = reduce(lambda a, b: a & b, same, F.col("_chunk") == F.col("_kc"))
    joined = chunked.join(links, on)

    inside = Window.partitionBy(*keys, "_chunk").orderBy(*_cols(order))
    local = F.row_number().over(inside)
    out = [F.col(c) for c in df.columns]
    if rank:
        out.append((local + F.col("_before")).alias(rank))
    for i, (name, src) in enumerate(lag.items()):
        out.append(
            F.when(local == 1, F.col(f"_prev._t{i}")).otherwise(F.lag(src).over(inside)).alias(name)
        )
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for i, (name, src) in enumerate(total.items()):
        out.append((F.sum(src).over(upto) + F.col(f"_c{i}")).alias(name))
    if size:
        out.append(F.col("_size").alias(size))
    return joined.select(*out)


def nearest_rank(
    df: DataFrame, keys: Sequence[str], value: str, fractions: Mapping[str, float]
) -> DataFrame:
    """Nearest-rank quantiles: the item at index rint((n - 1) * fraction), half to even.

    Equal values are counted first, so the ordered pass sees each distinct value once. Nulls are
    left out.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_m"))
    ranked = ordered_scan(counted, keys, [value], total={"_hi": "_m"})
    totals = counted.groupBy(*keys).agg(F.sum("_m").alias("_all"))
    if keys:
        totals = totals.select(*[F.col(k).alias(f"_g_{k}") for k in keys], "_all")
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys])
        ranked = ranked.join(totals, on)
    else:
        ranked = ranked.join(F.broadcast(totals))  # one row

    def at(fraction: float) -> Column:
        index = F.rint((F.col("_all") - 1) * F.lit(float(fraction)))
        inside = (index < F.col("_hi")) & (index >= F.col("_hi") - F.col("_m"))
        return F.max(F.when(inside, F.col(value)))

    return ranked.groupBy(*keys).agg(
        F.max("_all").alias("n"), *[at(f).alias(name) for name, f in fractions.items()]
    )


def linear_quantile(df: DataFrame, keys: Sequence[str], value: str, fractions: Mapping[str, float]) -> DataFrame:
    """Quantiles with linear interpolation between the two nearest order statistics."""
    marks = {}
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_m"))
    ranked = ordered_scan(counted, keys, [value], total={"_hi": "_m"})
    totals = counted.groupBy(*keys).agg(F.sum("_m").alias("_all")).select(
        *[F.col(k).alias(f"_g_{k}") for k in keys], "_all"
    )
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys], F.lit(True))
    ranked = ranked.join(totals, on)
    for name, fraction in fractions.items():
        spot = (F.col("_all") - 1) * F.lit(float(fraction))
        marks[name] = (F.floor(spot), F.ceil(spot), spot - F.floor(spot))

    def item(index: Column) -> Column:
        return F.max(F.when((index < F.col("_hi")) & (index >= F.col("_hi") - F.col("_m")), F.col(value)))

    picked = ranked.groupBy(*keys).agg(
        *[item(lo).alias(f"_lo_{n}") for n, (lo, _, _) in marks.items()],
        *[item(hi).alias(f"_up_{n}") for n, (_, hi, _) in marks.items()],
        *[F.max(w).alias(f"_w_{n}") for n, (_, _, w) in marks.items()],
    )
    return picked.select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_up_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
            for n in fractions
        ],
    )


def exact_avg(column: str) -> Column:
    """Mean of decimal fractions that are held as doubles (at most 18 places, sums below 1e20), the same however the rows are dealt: a sum of
    doubles follows their order in its last digit, which turns ties of rounding and of comparison."""
    return (F.sum(F.col(column).cast("decimal(38,18)")) / F.count(column)).cast("double")


def serial_avg(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str], order: Sequence[str]) -> DataFrame:
    """Means of doubles per key, {new column: source column}, added up one after the other in the given order, which must be total: the same
    digits as one scan of the rows in that order gives, however the rows are dealt. Nulls are left out. A key's rows are sorted and read by
    one task, as such a sum cannot be put together from parts; they spill and are never held together."""
    upto = Window.partitionBy(*keys).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {f"_s{i}": F.sum(c).over(upto) for i, c in enumerate(columns.values())}
    running = df.withColumns({**sums, "_n": F.count(F.lit(1)).over(upto)})
    return running.groupBy(*keys).agg(*[(F.max_by(f"_s{i}", "_n") / F.count(c)).alias(name) for i, (name, c) in enumerate(columns.items())])


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key as an aggregate: partial results are combined before the shuffle."""
    return _keep(df, keys, order, F.max_by)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _keep(df, keys, order, F.min_by)


def _keep(df, keys, order, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*_cols(order))).alias("_r"))
    return kept.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, rank: str = "rn") -> DataFrame:
    """The first n rows per group. Spark cuts each group to n rows per task before the shuffle (a window group limit)
    as long as n is within spark.sql.optimizer.windowGroupLimitThreshold."""
    order = _cols(order)
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)
