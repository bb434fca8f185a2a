"""Repeatable samples and splits. Quotas bound what the last step sees; everything before it is a
distributed top-k."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions import keys as k
from skyledger.operators.ordered import ordered_scan, top_per_group


def round_robin(df: DataFrame, *, stratum: str, rank: Column, count: int, walk: Column | None = None) -> DataFrame:
    """Take the best of every stratum in turn until count rows are chosen. Strata are walked by name
    or by the given expression."""
    best = top_per_group(df.withColumn("_rank", rank), [stratum], ["_rank"], count, rank="turn")
    walk = F.col(stratum) if walk is None else walk
    return best.withColumn("_walk", walk).orderBy("turn", "_walk").limit(count).drop("_rank", "_walk")


def risk_first(df: DataFrame, *, name: str, risk: str, stratum: str, count: int, salt: str = "golden-v1:") -> DataFrame:
    """Risky rows first in rank order, then round robin over the strata of the others."""
    ranked = df.withColumn("_rank", k.stable_rank(F.col(name), salt))
    risky = ranked.where(F.col(risk)).orderBy("_rank").limit(count).select(*df.columns, F.lit(0).alias("turn"), F.col("_rank").alias("_walk"))
    others = top_per_group(ranked.where(~F.col(risk)), [stratum], ["_rank"], count, rank="turn")
    others = others.select(*df.columns, "turn", F.col(stratum).alias("_walk"))
    return risky.unionByName(others).orderBy("turn", "_walk").limit(count)


def disjoint_groups(df: DataFrame, *, key: str, groups: Sequence[tuple[str, Column, int]]) -> DataFrame:
    """Groups in turn, each takes its first rows by hash that no earlier group took."""
    chosen = None
    for name, condition, limit in groups:
        rows = df.where(condition)
        if chosen is not None:
            rows = rows.join(chosen.select(key), key, "left_anti")
        rows = rows.orderBy(k.stable_rank(F.col(key).cast("string"))).limit(limit).withColumn("sample_group", F.lit(name))
        chosen = rows if chosen is None else chosen.unionByName(rows)
    return chosen


def aoi_manifest(candidates: DataFrame, quotas: Mapping[str, int]) -> DataFrame:
    """Stratified AOI choice: strata in quota order, AOIs in SHA-256 order, unseen geo cells first, an
    AOI once. Returns aoi_id, stratum and pick, the order of choice.

    At most Q = sum(quotas) AOIs and cells are ever taken, so per stratum only the Q lowest hashes
    and the Q lowest first-of-cell hashes can matter. Those few rows are resolved in order.
    """
    if not quotas or any(limit <= 0 for limit in quotas.values()):
        raise ValueError("positive quotas are required")
    total = sum(quotas.values())
    rows = (
        candidates.where(F.coalesce("aoi_id", F.lit("")) != "")
        .select("aoi_id", "geo_cell", k.stable_rank(F.col("aoi_id")).alias("h"), F.explode("strata").alias("stratum"))
        .where(F.col("stratum").isin(list(quotas)))
    )
    lowest = top_per_group(rows, ["stratum"], ["h"], total).drop("rn")
    per_cell = rows.where(F.col("geo_cell").isNotNull()).groupBy("stratum", "geo_cell").agg(
        F.min(F.struct("h", "aoi_id")).alias("f")
    ).select("f.aoi_id", "geo_cell", "f.h", "stratum")
    spread = top_per_group(per_cell, ["stratum"], ["h"], total).drop("rn")
    few = lowest.unionByName(spread.select(lowest.columns)).distinct()
    limits = dict(quotas)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "aoi_id"])
        taken, cells, out = set(), set(), []
        for stratum, limit in limits.items():
            pool = list(pdf.loc[pdf["stratum"] == stratum, ["aoi_id", "geo_cell"]].itertuples(index=False, name=None))
            left = limit
            for fresh_only in (True, False):
                for aoi, cell in pool:
                    if left == 0:
                        break
                    if aoi in taken or (fresh_only and (cell is None or cell in cells)):
                        continue
                    taken.add(aoi)
                    if cell is not None:
                        cells.add(cell)
                    out.append((aoi, stratum, len(out) + 1))
                    left -= 1
        return pd.DataFrame(out, columns=["aoi_id", "stratum", "pick"])

    return few.groupBy().applyInPandas(choose, "aoi_id string, stratum string, pick long")


def coverage_sample(targets: DataFrame, *, key: str, quotas: Mapping[str, int], max_samples: int) -> DataFrame:
    """Multi-dimension coverage: for every dimension and value (sorted), its first rows by hash up to
    the quota, then the lowest hashes overall up to max_samples. Returns key and pick.

    `targets` holds one string column per dimension named in quotas. No group can use more than its
    first quota + max_samples rows, so only those are resolved in order.
    """
    rows = targets.withColumn("h", k.stable_rank(F.col(key).cast("string")))
    few = None
    for position, (dimension, quota) in enumerate(quotas.items()):
        group = rows.select(F.lit(position).alias("d"), F.col(dimension).alias("value"), F.col(key).cast("string").alias("key"), "h")
        best = top_per_group(group, ["d", "value"], ["h"], quota + max_samples).drop("rn")
        few = best if few is None else few.unionByName(best)
    overall = rows.orderBy("h").limit(max_samples).select(
        F.lit(len(quotas)).alias("d"), F.lit("").alias("value"), F.col(key).cast("string").alias("key"), "h"
    )
    few = few.unionByName(overall)
    limits = [*quotas.values(), max_samples]

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: dict[str, int] = {}
        for (d, _), group in pdf.sort_values(["d", "value", "h"]).groupby(["d", "value"], sort=True):
            left = limits[d]
            for item in group["key"]:
                if left == 0 or len(taken) >= max_samples:
                    break
                if item not in taken:
                    taken[item] = len(taken) + 1
                    left -= 1
        return pd.DataFrame({"key": list(taken), "pick": list(taken.values())})

    return few.groupBy().applyInPandas(choose, "key string, pick long").withColumnRenamed("key", key)


def day_splits(images: DataFrame, *, day: str, test_count: int, val_count: int, salt: str = "") -> DataFrame:
    """Whole days by hash rank go to test until its count is reached, then to val, the rest to train.
    Returns one row per day; days are few, so their running total is a plain window."""
    days = images.groupBy(day).agg(F.count(F.lit(1)).alias("images")).withColumn("rank", k.stable_rank(F.col(day), salt))
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    first = days.withColumn("test", F.coalesce(F.sum("images").over(before), F.lit(0)) < test_count)
    rest = F.coalesce(F.sum(F.when(~F.col("test"), F.col("images")).otherwise(0)).over(before), F.lit(0))
    return first.withColumn(
        "split", F.when(F.col("test"), "test").when(rest < val_count, "val").otherwise("train")
    ).select(day, "images", "split")


def every_kth(frames: DataFrame, *, group: str, index: str, stride: int, cap: int) -> DataFrame:
    """Frames 0, k, 2k, ... of each video up to a cap."""
    return frames.where((F.col(index) % stride == 0) & (F.col(index) < stride * cap))


def evenly_spaced(df: DataFrame, order: Sequence[str], k_rows: int) -> DataFrame:
    """k rows at positions i * (n - 1) div (k - 1) for i = 0 .. k - 1; all rows when n <= k."""
    ranked = ordered_scan(df, [], order, rank="position", size="_n")
    at, gaps, steps = F.col("position") - 1, F.col("_n") - 1, F.lit(k_rows - 1)
    # The only candidate for a position is the least i whose spot reaches it.
    i = F.ceil(at * steps / F.greatest(gaps, F.lit(1)))
    hit = F.floor(i * gaps / steps) == at
    return ranked.where((F.col("_n") <= k_rows) | hit).drop("_n")


def mix_negatives(negatives: DataFrame, order: Sequence[str], *, positives: int, fraction: float) -> DataFrame:
    """Repeat the negatives in order until they make up `fraction` of the mix: row i of n appears once
    for every full or started pass that reaches it."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must be between 0 and 1")
    target = math.ceil(positives * fraction / (1.0 - fraction))
    ranked = ordered_scan(negatives, [], order, rank="_i", size="_n")
    copies = F.floor((F.lit(target) - F.col("_i")) / F.col("_n")) + 1
    return ranked.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).drop("_i", "_n")


def shuffled_pick(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """n rows in a repeatable random order."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def page(df: DataFrame, order: Sequence[Column | str], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def limited(n: int, low: int, high: int) -> int:
    """A limit inside its allowed range."""
    if not low <= n <= high:
        raise ValueError(f"limit must be between {low} and {high}")
    return n


def aoi_strata(components: Column, inflation: Column, label: Column, b, negative: Sequence[str], size: int = 1024, margin: int = 32) -> Column:
    """Strata of one target: geometry class, negative label, edge of the block; always geo_spread."""
    x1, y1, x2, y2 = b
    edge = (x1 <= margin) | (y1 <= margin) | (x2 >= size - margin) | (y2 >= size - margin)
    return F.array_compact(F.array(
        F.lit("geo_spread"),
        F.when(components >= 2, "multi_component").when(components == 1, "single_component"),
        F.when(inflation >= 2, "inflated_obb"),
        F.when(label.isin(list(negative)), "negative"),
        F.when(edge, "edge"),
    ))
