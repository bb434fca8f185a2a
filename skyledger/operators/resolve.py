"""Choosing among overlapping boxes: suppression, one-to-one matching and ordered merging.

The greedy definitions are sequential. Suppression and matching have the same result when every
box (pair) that beats all its undecided rivals is decided at once, so they run as rounds of joins
over a whole table. Ordered merging keeps its order; boxes that are not linked by a chain of
overlaps cannot affect each other, so each linked set is merged on its own.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.functions import boxes as bx
from skyledger.operators.components import components
from skyledger.operators.overlap import overlap_pairs
from skyledger.session import cut, spread


def suppress(df: DataFrame, *, group: Sequence[str], id_col: str, confidence: str, max_iou: float) -> DataFrame:
    """Non-maximum suppression: by falling confidence, then box, drop a box whose IoU with a kept
    box of its group is above max_iou. Add the class to `group` for the same-class variant."""
    group = list(group)
    bad = df.where(~bx.is_valid(bx.box())).limit(1).count()
    if bad:
        raise ValueError("suppression needs boxes with a positive extent")
    if max_iou < 1:
        # Of exact copies only the first in priority order can be kept, whatever happens to it.
        best = F.min_by(F.struct(*[c for c in df.columns if c not in (*group, *bx.BOX)]),
                        F.struct(-F.col(confidence), F.col(id_col)))
        kept = df.groupBy(*group, *bx.BOX).agg(best.alias("_r"))
        df = kept.select(*[F.col(c) if c in (*group, *bx.BOX) else F.col(f"_r.{c}").alias(c) for c in df.columns])
    ranked = df.withColumn("_p", F.struct((-F.col(confidence)).alias("c"), *bx.BOX, F.col(id_col).alias("i")))
    pairs = cut(
        overlap_pairs(ranked, None, group=group, id_col="_p", min_iou=max_iou, strict=True)
        .select(F.col("a_id").alias("hi"), F.col("b_id").alias("lo")),
        "nms",
    )
    dropped: list[DataFrame] = []
    while pairs.limit(1).count():
        kept = pairs.select("hi").distinct().join(pairs.select(F.col("lo").alias("hi")), "hi", "left_anti")
        out = cut(pairs.join(kept, "hi", "left_semi").select(F.col("lo").alias("_p")).distinct(), "nms")
        dropped.append(out)
        # A pair stays only while both ends are undecided; pairs of kept boxes are settled too.
        gone_lo, gone_hi = out.select(F.col("_p").alias("lo")), out.select(F.col("_p").alias("hi"))
        pairs = cut(pairs.join(gone_lo, "lo", "left_anti").join(gone_hi, "hi", "left_anti"), "nms")
    for out in dropped:
        ranked = ranked.join(out, "_p", "left_anti")
    return ranked.drop("_p")


def match_one_to_one(pairs: DataFrame, *, score: str = "iou", ties: str = "largest") -> DataFrame:
    """Greedy matching over scored pairs (a_id, b_id): take the best pair, remove both ends, repeat.

    A pair that is the best of both its ends is taken at once. Ties go to the larger (a_id, b_id),
    or to the smaller with ties="smallest".
    """
    if ties == "largest":
        rank, pick = F.struct(F.col(score).alias("s"), "a_id", "b_id"), F.max
    elif ties == "smallest":
        rank, pick = F.struct((-F.col(score)).alias("s"), "a_id", "b_id"), F.min
    else:
        raise ValueError("ties must be largest or smallest")
    columns = pairs.columns
    rest = cut(pairs.withColumn("_r", rank), "match")
    taken: list[DataFrame] = []
    while rest.limit(1).count():
        best_a = rest.groupBy("a_id").agg(pick("_r").alias("_r")).select("_r")
        best_b = rest.groupBy("b_id").agg(pick("_r").alias("_r")).select("_r")
        now = cut(rest.join(best_a, "_r", "left_semi").join(best_b, "_r", "left_semi"), "match")
        taken.append(now)
        rest = cut(
            rest.join(now.select("a_id"), "a_id", "left_anti").join(now.select("b_id"), "b_id", "left_anti"), "match"
        )
    out = rest.select(columns)
    for now in taken:
        out = out.unionByName(now.select(columns))
    return out


def merge_groups(
    df: DataFrame,
    *,
    group: Sequence[str],
    id_col: str,
    order: str,
    confidence: str,
    min_iou: float = 0.65,
    local_limit: int = 20_000,
) -> DataFrame:
    """Ordered representative merge: id -> founder (the id of the first member of its group).

    In `order`, a box joins the first group whose current representative has IoU >= min_iou and
    becomes the representative if strictly more confident; otherwise it founds a group. Linked sets
    of up to local_limit boxes are walked in one task each; larger ones advance by rounds over the
    whole table, so no task ever holds an unbounded set.
    """
    group = list(group)
    items = cut(
        df.select(*group, F.col(id_col).alias("id"), F.col(order).alias("pos"), *bx.BOX,
                  F.coalesce(F.col(confidence), F.lit(0.0)).cast("double").alias("conf")),
        "merge",
    )
    links = overlap_pairs(items, None, group=group, id_col="id", min_iou=min_iou)
    linked = components(links, "a_id", "b_id", near=group).select(F.col("node").alias("id"), F.col("component").alias("comp"))
    linked = cut(items.join(linked, "id", "left"), "merge")
    alone = linked.where(F.col("comp").isNull()).select("id", F.col("id").alias("founder"))
    sizes = linked.where(F.col("comp").isNotNull()).groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    small = linked.join(sizes.where(F.col("n") <= local_limit), "comp", "left_semi")
    large = linked.join(sizes.where(F.col("n") > local_limit), "comp", "left_semi")
    id_type = items.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("founder", id_type)])
    walk = _walker(min_iou)
    buckets = small.select(bucketed(small, "comp").alias("bucket"), "comp", "id", F.struct("pos").alias("pos"), *bx.BOX, "conf")
    walked = spread(buckets, "bucket").groupBy("bucket").applyInPandas(walk, schema)
    # Written once, because the merged rows are built from it in several passes.
    return cut(alone.unionByName(walked).unionByName(_merge_rounds(large, group, min_iou)).select(
        F.col("id").alias(id_col), "founder"
    ), "founders")


def bucketed(df: DataFrame, key: str, rows: int = 5_000):
    """A bucket number that keeps equal keys together and about `rows` rows per bucket, so that many
    small groups share one Python call. The number of buckets grows with the table."""
    return F.pmod(F.xxhash64(key), F.lit(df.count() // rows + 1))


def _walker(min_iou: float):
    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        comp = pdf["comp"].map(str) if isinstance(pdf["comp"].iloc[0], dict) else pdf["comp"]
        keys = [_flat(p) for p in pdf["pos"]]
        sets: dict = {}
        comps = comp.tolist()
        for i in sorted(range(len(pdf)), key=keys.__getitem__):
            sets.setdefault(comps[i], []).append(i)
        box, conf = pdf[list(bx.BOX)].to_numpy(float), pdf["conf"].to_numpy(float)
        plain = bool(np.isfinite(box).all())
        boxes, confs, ids = box.tolist(), conf.tolist(), pdf["id"].tolist()
        found = [None] * len(pdf)
        for rows in sets.values():
            if plain and len(rows) <= FEW:
                places = _walk_few([boxes[i] for i in rows], [confs[i] for i in rows], min_iou)
            else:
                places = _walk_one(box[rows], conf[rows], min_iou)
            for i, place in zip(rows, places):
                found[i] = ids[rows[place]]
        return pd.DataFrame({"id": ids, "founder": found})

    return walk


#: Sets up to this size are walked number by number: array calls cost more than their few boxes.
FEW = 24


def _walk_few(boxes: list, conf: list, min_iou: float) -> list[int]:
    """_walk_one() for few boxes with finite numbers."""
    founders, reps, top, out = [], [], [], []
    for i, b in enumerate(boxes):
        x1, y1, x2, y2 = b
        area, g = (x2 - x1) * (y2 - y1), -1
        for k, (u1, v1, u2, v2) in enumerate(reps):
            inter = max(min(u2, x2) - max(u1, x1), 0.0) * max(min(v2, y2) - max(v1, y1), 0.0)
            union = (u2 - u1) * (v2 - v1) + area - inter
            if union > 0 and inter / union >= min_iou:
                g = k
                break
        if g < 0:
            g = len(founders)
            founders.append(i)
            reps.append(b)
            top.append(conf[i])
        elif conf[i] > top[g]:
            reps[g], top[g] = b, conf[i]
        out.append(founders[g])
    return out


def _walk_one(box: np.ndarray, conf: np.ndarray, min_iou: float) -> list[int]:
    """The ordered walk over one linked set, rows already in order: the place of each row's founder."""
    reps, top = np.empty((len(box), 4)), np.empty(len(box))
    founders: list = []
    out = []
    for i, b in enumerate(box):
        n = len(founders)
        r = reps[:n]
        w = np.clip(np.minimum(r[:, 2], b[2]) - np.maximum(r[:, 0], b[0]), 0, None)
        h = np.clip(np.minimum(r[:, 3], b[3]) - np.maximum(r[:, 1], b[1]), 0, None)
        inter = w * h
        union = (r[:, 2] - r[:, 0]) * (r[:, 3] - r[:, 1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
        hits = np.flatnonzero((union > 0) & (inter / np.where(union > 0, union, 1) >= min_iou))
        g = int(hits[0]) if len(hits) else n
        if g == n:
            founders.append(i)
        if g == n or conf[i] > top[g]:
            reps[g], top[g] = b, conf[i]
        out.append(founders[g])
    return out


def _flat(value):
    """Nested order values as plain tuples."""
    if isinstance(value, dict):
        return tuple(_flat(v) for v in value.values())
    if isinstance(value, np.ndarray):
        value = value.tolist()
    if isinstance(value, (tuple, list)):
        return tuple(_flat(v) for v in value)
    return value


def _merge_rounds(items: DataFrame, group: list[str], min_iou: float) -> DataFrame:
    """The same walk for large linked sets: between two changes of a representative every box has a
    fixed first group, so each round settles all boxes up to the next change of its set."""
    rest = cut(items, "merge")
    empty = rest.limit(0)
    done = empty.select("id", F.col("id").alias("founder"))
    reps = cut(
        empty.select(*group, "comp", "id", *bx.BOX, "conf", F.col("id").alias("founder"), F.col("pos").alias("since")),
        "merge",
    )
    parts = []
    while rest.limit(1).count():
        hits = overlap_pairs(rest, reps, group=group, id_col="id", min_iou=min_iou).select("a_id", "b_id")
        held = reps.select(
            F.col("id").alias("b_id"), F.struct("founder", F.col("conf").alias("top"), "since").alias("g")
        )
        first = hits.join(held, "b_id").groupBy("a_id").agg(F.min_by("g", F.col("g.since")).alias("g"))
        seen = cut(
            rest.join(first, rest["id"] == first["a_id"], "left")
            .drop("a_id")
            .withColumn("change", F.col("g").isNull() | (F.col("conf") > F.col("g.top"))),
            "merge",
        )
        turns = cut(seen.where("change").groupBy("comp").agg(F.min("pos").alias("turn")), "merge")
        marked = cut(seen.join(turns, "comp", "left"), "merge")
        now = marked.where(F.col("turn").isNull() | (F.col("pos") <= F.col("turn")))
        parts.append(now.select("id", F.coalesce(F.col("g.founder"), F.col("id")).alias("founder")))
        changed = marked.where(F.col("pos") == F.col("turn")).select(
            *group, "comp", "id", *bx.BOX, "conf",
            F.coalesce(F.col("g.founder"), F.col("id")).alias("founder"),
            F.coalesce(F.col("g.since"), F.col("pos")).alias("since"),
        )
        reps = cut(reps.join(changed.select("founder"), "founder", "left_anti").unionByName(changed), "merge")
        rest = cut(marked.where(F.col("pos") > F.col("turn")).select(rest.columns), "merge")
    for part in parts:
        done = done.unionByName(part)
    return done


def merged_targets(df: DataFrame, founders: DataFrame, *, group: Sequence[str], id_col: str, order: str,
                   confidence: str, prompt: str, representative: str = "confidence") -> DataFrame:
    """One row per merged group: the chosen box, its class and confidence, the distinct prompts in
    order of first use, prompt_hits and the number of members. The member list itself is the
    founders table, so that no row grows with a group."""
    group = list(group)
    rows = df.join(founders, id_col)
    if representative == "area":
        best = bx.area(bx.box())
    elif representative == "confidence":
        best = F.coalesce(F.col(confidence), F.lit(0.0))
    else:
        raise ValueError("representative must be confidence or area")
    # Prompts are few: reduce to one row per (group, prompt) before collecting them.
    used = rows.where(F.coalesce(F.col(prompt), F.lit("")) != "").groupBy("founder", prompt).agg(
        F.min(order).alias("_first")
    )
    used = used.groupBy("founder").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_first", F.col(prompt).alias("p")))), lambda s: s["p"]).alias(
            "source_prompts"
        )
    )
    # The first member wins ties: the largest score at the smallest order.
    pick = rows.groupBy("founder").agg(
        F.count(F.lit(1)).alias("members"),
        F.min_by(
            F.struct(*group, F.col(id_col).alias("best_id"), *bx.BOX, confidence, "class_name"), F.struct((-best).alias("b"), F.col(order).alias("o"))
        ).alias("r"),
    )
    return pick.join(used, "founder", "left").select(
        *[F.col(f"r.{g}").alias(g) for g in group],
        "founder", "r.best_id", *[F.col(f"r.{c}").alias(c) for c in bx.BOX],
        F.col(f"r.{confidence}").alias(confidence), "r.class_name",
        F.coalesce("source_prompts", F.array().cast("array<string>")).alias("source_prompts"),
        F.coalesce(F.size("source_prompts"), F.lit(0)).alias("prompt_hits"),
        "members",
    )
