"""Box overlap joins on a multi-resolution grid.

A box lives on the grid level whose cell is at least as long as its longer side, so it covers at
most four cells there. Two boxes with IoU >= t have side ratios >= t, so their levels differ by at
most log2(1/t): each box is also looked up on that many coarser levels. A pair is produced only in
the cell that holds the top-left corner of the intersection, so no distinct is needed. The join is
an equi-join on (group, level, cell): an image with very many boxes is spread over its cells.

From IoU 0.5 on, centres are so near that one side is one row, in the cell of its centre, and the other
side is looked up in the few cells that such a centre may lie in.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import boxes as bx

BASE_CELL = 16.0  # side of a level-0 cell, in the unit of the boxes


def _level(b, base: float) -> Column:
    side = F.greatest(b[2] - b[0], b[3] - b[1])
    return F.when(side <= base, F.lit(0)).otherwise(F.ceil(F.log2(side / base))).cast("int")


def _cells(df: DataFrame, b, levels: Column, base: float) -> DataFrame:
    """One row per (level, cell) the box covers."""
    df = df.withColumn("_lv", F.explode(levels)).withColumn("_cs", F.lit(base) * F.pow(F.lit(2.0), F.col("_lv")))
    span = lambda lo, hi: F.sequence(F.floor(lo / F.col("_cs")), F.floor(hi / F.col("_cs")))
    return df.withColumn("_cx", F.explode(span(b[0], b[2]))).withColumn("_cy", F.explode(span(b[1], b[3])))


def _owner(a, b) -> Column:
    left, top = F.greatest(a[0], b[0]), F.greatest(a[1], b[1])
    return (F.floor(left / F.col("_cs")) == F.col("_cx")) & (F.floor(top / F.col("_cs")) == F.col("_cy"))


def _centre(b) -> list[Column]:
    return [(b[0] + b[2]) / 2, (b[1] + b[3]) / 2]


def _centre_pairs(a: DataFrame, b: DataFrame, on: Sequence[str], min_iou: float, base: float) -> DataFrame:
    """Candidates for an IoU of at least min_iou, each pair of rows once.

    Sides of two such boxes have ratios of at least min_iou on both axes, and centres lie at most (1 / min_iou - 1) / 2 sides
    apart. Both bounds are widened by far more than arithmetic can round.
    """
    ab, bb = bx.box("a_"), bx.box("b_")
    hosts = a.withColumn("_lv", _level(ab, base)).withColumn("_cs", F.lit(base) * F.pow(F.lit(2.0), F.col("_lv")))
    hosts = hosts.select("*", *[F.floor(m / F.col("_cs")).alias(c) for m, c in zip(_centre(ab), ("_cx", "_cy"))]).drop("_cs")
    least, most = [_level([v * by for v in bb], base) for by in (min_iou * (1 - 1e-6), (1 + 1e-6) / min_iou)]
    guests = b.withColumn("_lv", F.explode(F.sequence(least, most))).withColumn("_cs", F.lit(base) * F.pow(F.lit(2.0), F.col("_lv")))
    for m, lo, hi, c in zip(_centre(bb), bb[:2], bb[2:], ("_cx", "_cy")):
        reach = (hi - lo) * ((1 / min_iou - 1) / 2 + 1e-6) + F.abs(m) * 1e-12
        guests = guests.withColumn(c, F.explode(F.sequence(F.floor((m - reach) / F.col("_cs")), F.floor((m + reach) / F.col("_cs")))))
    return hosts.join(guests.drop("_cs"), [*on, "_lv", "_cx", "_cy"])


def _sided(df: DataFrame, group: Sequence[str], id_col: str, prefix: str) -> DataFrame:
    return df.select(
        *group, F.col(id_col).alias(prefix + "id"), *[F.col(c).cast("double").alias(prefix + c) for c in bx.BOX]
    ).where(bx.is_valid(bx.box(prefix)))


def overlap_pairs(
    left: DataFrame,
    right: DataFrame | None,
    *,
    group: Sequence[str],
    id_col: str,
    min_iou: float,
    right_id: str | None = None,
    base: float = BASE_CELL,
    strict: bool = False,
) -> DataFrame:
    """Pairs with IoU >= min_iou (> when strict) inside each group: group, a_id, b_id, iou.

    With right=None it is a self-join giving each pair once with a_id < b_id. Boxes without a
    positive extent overlap nothing and are left out.
    """
    if not 0 < min_iou <= 1:
        raise ValueError("min_iou must be above 0 and at most 1")
    group = list(group)
    deeper = math.floor(math.log2(1 / min_iou)) + 1
    self_join = right is None
    a = _sided(left, group, id_col, "a_")
    b = _sided(left if self_join else right, group, id_col if self_join else (right_id or id_col), "b_")
    ab, bb = bx.box("a_"), bx.box("b_")

    def hosts(df, box):
        return _cells(df.withColumn("_own", _level(box, base)), box, F.array("_own"), base).drop("_own")

    def guests(df, box, first: int):
        df = df.withColumn("_own", _level(box, base))
        return _cells(df, box, F.sequence(F.col("_own") + first, F.col("_own") + deeper), base).drop("_own")

    on = group + ["_lv", "_cx", "_cy"]
    score = bx.iou(ab, bb)
    hit = (score > min_iou) if strict else (score >= min_iou)
    out = [*group, "a_id", "b_id", score.alias("iou")]
    if min_iou >= 0.5:
        once = F.col("a_id") < F.col("b_id") if self_join else F.lit(True)
        return _centre_pairs(a, b, group, min_iou, base).where(hit & once).select(*out)
    if self_join:
        # Guests of the same level or finer than the host; one order only within a level.
        found = hosts(a, ab).join(guests(b, bb, 0).drop("_cs"), on)
        same_level = _level(ab, base) == _level(bb, base)
        found = found.where(
            _owner(ab, bb) & hit & F.when(same_level, F.col("a_id") < F.col("b_id")).otherwise(True)
        )
        return found.select(
            *group,
            F.least("a_id", "b_id").alias("a_id"),
            F.greatest("a_id", "b_id").alias("b_id"),
            score.alias("iou"),
        )
    fine_right = hosts(a, ab).join(guests(b, bb, 0).drop("_cs"), on).where(_owner(ab, bb) & hit).select(*out)
    fine_left = guests(a, ab, 1).join(hosts(b, bb).drop("_cs"), on).where(_owner(ab, bb) & hit).select(*out)
    return fine_right.unionByName(fine_left)


def touching_pairs(
    left: DataFrame,
    right: DataFrame,
    *,
    group: Sequence[str],
    id_col: str,
    cell: float,
    right_id: str | None = None,
    strict: bool = True,
) -> DataFrame:
    """Pairs of boxes of any sizes that overlap (strictly unless told otherwise), on one grid:
    group, a_id, b_id, iou. The cell should be near the usual box side."""
    group = list(group)
    a = _sided(left, group, id_col, "a_")
    b = _sided(right, group, right_id or id_col, "b_")
    ab, bb = bx.box("a_"), bx.box("b_")
    one = F.array(F.lit(0))
    joined = _cells(a, ab, one, cell).join(_cells(b, bb, one, cell).drop("_cs"), group + ["_lv", "_cx", "_cy"])
    hit = bx.overlaps(ab, bb) if strict else bx.meets(ab, bb)
    return joined.where(_owner(ab, bb) & hit).select(*group, "a_id", "b_id", bx.iou(ab, bb).alias("iou"))


def distinct_boxes(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Collapse exact copies: one row per (keys, box) with the least id and the number of copies.

    Thousands of copies of one box would otherwise make all pairs among themselves.
    """
    return df.groupBy(*keys, *bx.BOX).agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("copies"))


def overlapping_any(
    left: DataFrame, right: DataFrame, *, group: Sequence[str], id_col: str, cell: float
) -> DataFrame:
    """Ids of left boxes that strictly overlap at least one right box of the group (a semi-join)."""
    group = list(group)
    a = _sided(left, group, id_col, "a_")
    b = distinct_boxes(right, group, id_col)
    b = _sided(b, group, id_col, "b_").drop("b_id")
    one = F.array(F.lit(0))
    keys = group + ["_cx", "_cy"]
    lines = _cells(b, bx.box("b_"), one, cell).drop("_lv", "_cs")
    aliased = lines.select(*[F.col(k).alias(f"_r{k}") for k in keys], *[f"b_{c}" for c in bx.BOX])
    on = [F.col(k) == F.col(f"_r{k}") for k in keys]
    on.append(bx.overlaps(bx.box("a_"), bx.box("b_")))
    return (
        _cells(a, bx.box("a_"), one, cell)
        .join(aliased, on, "left_semi")
        .select(*group, F.col("a_id").alias(id_col))
        .distinct()
    )
