"""Masks as row runs: a table (keys..., y, x0, x1) with half-open x intervals, one row per run.

Set algebra is a sweep along each image row. Runs are reduced per start or end position before any
window, so a window holds at most one image row and never more entries than the image is wide,
however many masks or copies are stacked on it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions import boxes as bx
from skyledger.operators.components import components, least_labels
from skyledger.operators.ordered import nearest_rank
from skyledger.session import cut, spread


def merge_runs(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union: overlapping and touching runs of a row become one."""
    return _joined(runs.where(F.col("x1") > F.col("x0")).groupBy(*keys, "y", "x0").agg(F.max("x1").alias("x1")), keys)


def _joined(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """merge_runs() for runs of which no two of a row begin alike."""
    row = Window.partitionBy(*keys, "y").orderBy("x0")
    reach = F.max("x1").over(row.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("_new", F.when(reach.isNull() | (F.col("x0") > reach), 1).otherwise(0))
    numbered = marked.withColumn("_part", F.sum("_new").over(row.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "y", "_part").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_part")


def coverage(runs: DataFrame, keys: Sequence[str], layer: str, layers: Sequence[str], merged: bool = False) -> DataFrame:
    """Segments of each row with how many runs of each layer cover them, as columns n_<layer>.

    merged: the runs of each layer (or of each of its components) are merged, so a row has no more than its pixels allow; the runs of a row
    are then brought together once. Others are summed up per position before they are.
    """
    runs = runs.where(F.col("x1") > F.col("x0")).select(*keys, "y", "x0", "x1", layer)
    edges = (runs.repartition(*keys, "y") if merged else runs).select(
        *keys, "y", layer, F.explode(F.array(
            F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("d"))
        )).alias("e"),
    )
    steps = edges.groupBy(*keys, "y", F.col("e.x").alias("x0")).agg(
        *[F.sum(F.when(F.col(layer) == name, F.col("e.d")).otherwise(0)).alias(f"d_{name}") for name in layers]
    )
    row = Window.partitionBy(*keys, "y").orderBy("x0")
    upto = row.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.select(
        *keys, "y", "x0", F.lead("x0").over(row).alias("x1"), *[F.sum(f"d_{n}").over(upto).alias(f"n_{n}") for n in layers]
    ).where(F.col("x1").isNotNull())


def combine(runs: DataFrame, keys: Sequence[str], layer: str, layers: Sequence[str], keep: Column, merged: bool = False) -> DataFrame:
    """Runs where a condition on the coverage columns holds, merged. `merged` is told of the input, as in coverage()."""
    segments = coverage(runs, keys, layer, layers, merged).where(keep)
    return _joined(segments.select(*keys, "y", "x0", "x1"), keys)


def _layered(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    take = lambda df, name: df.select(*keys, "y", "x0", "x1", F.lit(name).alias("layer"))
    return take(first, "a").unionByName(take(second, "b"))


def intersect(first: DataFrame, second: DataFrame, keys: Sequence[str], merged: bool = False) -> DataFrame:
    return combine(_layered(first, second, keys), keys, "layer", ["a", "b"], (F.col("n_a") > 0) & (F.col("n_b") > 0), merged)


def subtract(first: DataFrame, second: DataFrame, keys: Sequence[str], merged: bool = False) -> DataFrame:
    return combine(_layered(first, second, keys), keys, "layer", ["a", "b"], (F.col("n_a") > 0) & (F.col("n_b") == 0), merged)


def overlap_areas(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: area of each side, common area, IoU and the share of the first that is covered."""
    length = F.col("x1") - F.col("x0")
    area = lambda cond: F.sum(F.when(cond, length).otherwise(0))
    a, b = F.col("n_a") > 0, F.col("n_b") > 0
    g = coverage(_layered(first, second, keys), keys, "layer", ["a", "b"]).groupBy(*keys).agg(
        area(a).alias("area_a"), area(b).alias("area_b"), area(a & b).alias("common")
    )
    union = F.col("area_a") + F.col("area_b") - F.col("common")
    share = lambda top, bottom: F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))
    return g.withColumns({"mask_iou": share(F.col("common"), union), "covered": share(F.col("common"), F.col("area_a"))})


def measure(merged: DataFrame, keys: Sequence[str], width: int, height: int) -> DataFrame:
    """Area, bounding box and border touch of merged runs."""
    edge = (F.col("y") <= 0) | (F.col("y") >= height - 1) | (F.col("x0") <= 0) | (F.col("x1") >= width)
    return merged.groupBy(*keys).agg(
        F.sum(F.col("x1") - F.col("x0")).alias("area"), F.min("x0").alias("left"), F.min("y").alias("top"),
        F.max("x1").alias("right"), (F.max("y") + 1).alias("bottom"), F.bool_or(edge).alias("touches_border"),
    )


def _neighbours(merged: DataFrame, keys: Sequence[str], reach: int) -> DataFrame:
    """Pairs of runs on neighbouring rows that meet: reach 1 for eight neighbours, 0 for common columns."""
    a = merged.select(*keys, (F.col("y") + 1).alias("_ny"), F.col("y").alias("ay"), F.col("x0").alias("a0"), F.col("x1").alias("a1"))
    b = merged.select(*keys, F.col("y").alias("_ny"), F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    return a.join(b, [*keys, "_ny"]).where((F.col("a0") < F.col("b1") + reach) & (F.col("b0") < F.col("a1") + reach))


def _labelled(batches, keys: Sequence[str], chunk: int = 1 << 18):
    """Sorted merged runs with the first run of their component inside a chunk of a task (_cy, _cx), and whether a component may go on beyond the chunk at this
    run (_rim): it lies on the first row of the chunk's first mask or on the last row of its last one. A chunk ends between two rows."""
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= chunk:
            table = pa.Table.from_batches(held).combine_chunks()
            new = np.flatnonzero(_changes(table, [*keys, "y"]))
            if len(new) > 1:
                yield from _label_chunk(table.slice(0, new[-1]), keys).to_batches()
                table = table.slice(new[-1])
            # An unfinished row waits for the next batches.
            held, rows = table.to_batches(), 0 if len(new) > 1 else rows
    if held:
        yield from _label_chunk(pa.Table.from_batches(held).combine_chunks(), keys).to_batches()


def _changes(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Whether a row differs from the row before in these columns; nulls are equal."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for name in names:
        codes = pd.factorize(table[name].to_pandas())[0]
        new[1:] |= codes[1:] != codes[:-1]
    return new


def _label_chunk(table: pa.Table, keys: Sequence[str]) -> pa.Table:
    y, x0, x1 = (table[c].to_numpy().astype(np.int64) for c in ("y", "x0", "x1"))
    mask = np.cumsum(_changes(table, keys))
    # Rows lie behind each other on one axis; between rows that are no neighbours one place stays empty.
    step = np.r_[0, np.where((mask[1:] == mask[:-1]) & (y[1:] - y[:-1] <= 1), y[1:] - y[:-1], 2)]
    line, width = np.cumsum(step), int(x1.max() - x0.min()) + 2
    start, end = line * width + x0 - x0.min(), line * width + x1 - x0.min()
    low = np.searchsorted(end, start + width, "left")
    count = np.maximum(0, np.searchsorted(start, end + width, "right") - low)
    above = np.repeat(np.arange(len(y)), count)
    below = np.arange(len(above)) - np.repeat(np.cumsum(count) - count, count) + low[above]
    first = least_labels(above, below, len(y))
    rim = (mask == mask[0]) & (y == y[0]) | (mask == mask[-1]) & (y == y[-1])
    return pa.table([*table.columns, pa.array(y[first]), pa.array(x0[first]), pa.array(rim)], names=[*table.column_names, "_cy", "_cx", "_rim"])


def label_components(merged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merged runs with the component (8 neighbours) they belong to, named by its first run.

    Runs are range-partitioned by mask and row, and every task labels its own in bounded chunks. Only the runs on the border rows of chunks are
    joined over the table, so a mask of any size is spread and small ones are done where they lie.
    """
    keys = list(keys)
    merged = merged if hasattr(merged, "_scratch") else cut(merged, "runs")
    plain = merged.select(*keys, "y", "x0", "x1")
    sorted_runs = plain.repartitionByRange(*keys, "y").sortWithinPartitions(*keys, "y", "x0")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields) + ", _cy bigint, _cx bigint, _rim boolean"
    local = cut(sorted_runs.mapInArrow(lambda batches: _labelled(batches, keys), schema), "labelled")
    kinds = dict(plain.dtypes)
    named = F.struct(*keys, F.col("_cy").cast(kinds["y"]).alias("y"), F.col("_cx").cast(kinds["x0"]).alias("x0"))
    rim = local.where("_rim").select(*keys, "y", "x0", "x1", named.alias("c"))
    under = rim.select(*[F.col(k).alias(f"_b{k}") for k in keys], (F.col("y") - 1).alias("_by"), F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("c").alias("d"))
    on = [F.col(k).eqNullSafe(F.col(f"_b{k}")) for k in keys] + [F.col("y") == F.col("_by"), F.col("x0") <= F.col("b1"), F.col("b0") <= F.col("x1")]
    found = cut(components(rim.join(under, on).where("c <> d").select("c", "d"), "c", "d"), "joined")
    labelled = local.select(*keys, "y", "x0", "x1", named.alias("node")).join(found, "node", "left")
    return labelled.select(*keys, "y", "x0", "x1", F.coalesce("component", "node").alias("component"))


def component_stats(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per component: area and box; these are also the targets of imported masks."""
    return labelled.groupBy(*keys, "component").agg(
        F.sum(F.col("x1") - F.col("x0")).alias("area"), F.min("x0").alias("left"), F.min("y").alias("top"),
        F.max("x1").alias("right"), (F.max("y") + 1).alias("bottom"),
    )


def retain_components(merged: DataFrame, keys: Sequence[str], minimum: int) -> DataFrame:
    """Labelled runs of components with at least `minimum` pixels."""
    labelled = label_components(merged, keys)
    large = component_stats(labelled, keys).where(F.col("area") >= minimum).select("component")
    return labelled.join(large, "component", "left_semi").select(labelled.columns)


def mask_profile(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Components, material components (at least max(4, 2% of the area)) and the largest share."""
    parts = component_stats(labelled, keys)
    total = parts.groupBy(*keys).agg(F.sum("area").alias("mask_area"), F.count(F.lit(1)).alias("components"), F.max("area").alias("largest"))
    least = F.greatest(F.lit(4), F.ceil(F.col("mask_area") * 0.02))
    material = parts.join(total, list(keys)).groupBy(*keys).agg(F.count_if(F.col("area") >= least).alias("material_components"))
    return total.join(material, list(keys)).select(
        *keys, "mask_area", "components", "material_components", (F.col("largest") / F.col("mask_area")).alias("largest_component_fraction")
    )


def perimeter(merged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Length of the pixel outline: two ends per run plus row lengths not shared with the next row.
    This counts pixel edges, so it is longer than a smoothed contour length."""
    shared = _neighbours(merged, keys, 0).groupBy(*keys).agg(
        F.sum(F.least("a1", "b1") - F.greatest("a0", "b0")).alias("shared")
    )
    own = merged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x1") - F.col("x0")).alias("area"))
    length = 2 * F.col("n") + 2 * F.col("area") - 2 * F.coalesce("shared", F.lit(0))
    return own.join(shared, list(keys), "left").select(
        *keys, "area", length.alias("perimeter"), (4 * math.pi * F.col("area") / (length * length)).alias("compactness")
    )


#: Numbers of a mask that an audit ranks.
AUDIT_METRICS = (
    "mask_area", "components", "material_components", "largest_component_fraction", "mask_bbox_iou", "aabb_area", "aabb_background_fraction", "compactness",
)


def mask_geometry(merged: DataFrame, declared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The audited numbers of every declared mask (keys, x1, y1, x2, y2); those without a pixel have nulls and empty = true."""
    merged = cut(merged, "merged")
    parts = mask_profile(label_components(merged, keys), keys)
    frame = merged.groupBy(*keys).agg(
        F.min("x0").alias("m1"), F.min("y").alias("n1"), F.max("x1").alias("m2"), (F.max("y") + 1).alias("n2")
    )
    line = perimeter(merged, keys).select(*keys, "compactness")
    own = tuple(F.col(c).cast("double") for c in ("m1", "n1", "m2", "n2"))
    area = bx.area(own)
    facts = parts.join(frame, list(keys)).join(line, list(keys))
    found = declared.join(facts, list(keys), "left")
    return found.select(
        *keys, F.col("mask_area").isNull().alias("empty"), "mask_area", "components", "material_components", "largest_component_fraction",
        F.when(F.col("mask_area").isNotNull(), bx.iou(own, bx.box())).alias("mask_bbox_iou"),
        F.when(F.col("mask_area").isNotNull(), area).alias("aabb_area"),
        (1 - F.col("mask_area") / area).alias("aabb_background_fraction"), "compactness",
    )


def mask_audit_totals(geometry: DataFrame) -> DataFrame:
    """How many masks were looked at, are empty, have several material parts, a largest part below 90 % or a box below 0.8 IoU."""
    return geometry.agg(
        F.count(F.lit(1)).alias("analyzed"), F.count_if("empty").alias("empty_masks"), F.count_if(F.col("material_components") > 1).alias("multiple_material_components"),
        F.count_if(F.col("largest_component_fraction") < 0.9).alias("largest_component_below_90_percent"), F.count_if(F.col("mask_bbox_iou") < 0.8).alias("mask_bbox_iou_below_80_percent"),
    )


def mask_audit_quantiles(geometry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nearest-rank quantiles of every metric in one ordered pass over (metric, value); empty masks have none."""
    numbers = geometry.select(*keys, *[F.col(c).cast("double").alias(c) for c in AUDIT_METRICS])
    long = numbers.unpivot(list(keys), list(AUDIT_METRICS), "metric", "value")
    return nearest_rank(long, ["metric"], "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99})


def centre_hits(boxes: DataFrame, merged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Boxes whose rounded centre lies on the mask; rounding is half to even."""
    centre = lambda a, b: F.rint((F.col(a) + F.col(b)) / 2).cast("bigint")
    points = boxes.withColumns({"_py": centre("y1", "y2"), "_px": centre("x1", "x2")})
    rows = merged.select(*[F.col(k).alias(f"_m{k}") for k in keys], F.col("y").alias("_my"), F.col("x0").alias("_m0"), F.col("x1").alias("_m1"))
    on = [F.col(k) == F.col(f"_m{k}") for k in keys]
    on += [F.col("_py") == F.col("_my"), F.col("_px") >= F.col("_m0"), F.col("_px") < F.col("_m1")]
    return points.join(rows, on, "left_semi").drop("_py", "_px")


def pair_overlaps(first: DataFrame, second: DataFrame, image: Sequence[str], a_id: str, b_id: str) -> DataFrame:
    """Common area of every overlapping pair of masks of two sets in the same image."""
    a = first.select(*image, "y", a_id, F.col("x0").alias("a0"), F.col("x1").alias("a1"))
    b = second.select(*image, "y", b_id, F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    hits = a.join(b, [*image, "y"]).where((F.col("a0") < F.col("b1")) & (F.col("b0") < F.col("a1")))
    return hits.groupBy(*image, a_id, b_id).agg(F.sum(F.least("a1", "b1") - F.greatest("a0", "b0")).alias("common"))


def oriented_boxes(merged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area and angle of the smallest rectangle around the pixel centres of each mask. Only the first
    and last pixel of each row can be on the hull, so a mask sends at most two points per row."""
    ends = merged.groupBy(*keys, "y").agg(F.min("x0").alias("lo"), (F.max("x1") - 1).alias("hi"))
    types = {f.name: f.dataType.simpleString() for f in merged.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", obb_area double, obb_angle double"

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf["y"].to_numpy(float)
        points = np.concatenate([np.column_stack([pdf["lo"].to_numpy(float), y]), np.column_stack([pdf["hi"].to_numpy(float), y])])
        area, angle = smallest_rectangle(points)
        return pd.DataFrame([(*key, area, angle)], columns=[*keys, "obb_area", "obb_angle"])

    return spread(ends, *keys).groupBy(*keys).applyInPandas(fit, schema)


def smallest_rectangle(points: np.ndarray) -> tuple[float, float]:
    """Least area over the directions of the hull edges, and that direction in degrees."""
    hull = _hull(np.unique(points, axis=0))
    if len(hull) < 3:
        return 0.0, 0.0
    edge = np.roll(hull, -1, axis=0) - hull
    axis = edge / np.linalg.norm(edge, axis=1, keepdims=True)
    normal = np.column_stack([-axis[:, 1], axis[:, 0]])
    along, across = hull @ axis.T, hull @ normal.T
    areas = np.ptp(along, axis=0) * np.ptp(across, axis=0)
    best = int(np.argmin(areas))
    return float(areas[best]), float(np.degrees(np.arctan2(axis[best, 1], axis[best, 0])) % 90)


def _turn(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _hull(points: np.ndarray) -> np.ndarray:
    """Convex hull of sorted distinct points, counter-clockwise."""
    if len(points) < 3:
        return points

    def chain(rows):
        out: list = []
        for p in rows:
            while len(out) > 1 and _turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out

    lower, upper = chain(points), chain(points[::-1])
    return np.array(lower[:-1] + upper[:-1])


def supervision(predicted: DataFrame, excluded: DataFrame, confirmed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Background runs for training: predicted pixels that are excluded, or all predicted pixels of a
    confirmed negative, with the source."""
    keys = list(keys)
    known = confirmed.select(*keys).distinct()
    whole = merge_runs(predicted.join(known, keys, "left_semi"), keys).withColumn("source", F.lit("confirmed_false_positive"))
    partial = intersect(predicted.join(known, keys, "left_anti"), excluded, keys)
    return whole.unionByName(partial.withColumn("source", F.lit("building_or_public_road_overlap")))


def _drawn(ax, ay, bx, by, r, line, width: int, height: int, rows: int = 1 << 19):
    """Chunks (line, start, end) of the intervals of thick segments, as united places on one axis: row y of picture `line` starts at (line * height + y) *
    (width + 1), so rows never touch."""
    top = np.maximum(0, np.ceil(np.minimum(ay, by) - r)).astype(np.int64)
    bottom = np.minimum(height - 1, np.floor(np.maximum(ay, by) + r)).astype(np.int64)
    tall = np.maximum(0, bottom - top + 1)
    length = np.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))
    safe = np.where(length > 0, length, 1.0)
    nx, ny = -(by - ay) / safe * r, np.where(length > 0, (bx - ax) / safe * r, 0.0)
    upto = np.cumsum(tall)
    first = 0
    while first < len(tall):
        last = max(first + 1, int(np.searchsorted(upto, upto[first] - tall[first] + rows, "right")))
        n = tall[first:last]
        at = np.repeat(np.arange(first, last), n)
        row = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + top[at]
        y, low, high = row.astype(float), np.full(len(at), np.inf), np.full(len(at), -np.inf)
        # The ends of the segment are discs; between them lie the two long sides.
        for cx, cy in ((ax[at], ay[at]), (bx[at], by[at])):
            left = r[at] * r[at] - (y - cy) * (y - cy)
            hit, reach = np.abs(y - cy) <= r[at], np.sqrt(np.maximum(left, 0.0))
            low, high = np.where(hit, np.minimum(low, cx - reach), low), np.where(hit, np.maximum(high, cx + reach), high)
        for side in (1, -1):
            px, py, qx, qy = ax[at] + side * nx[at], ay[at] + side * ny[at], bx[at] + side * nx[at], by[at] + side * ny[at]
            hit = (np.minimum(py, qy) <= y) & (np.maximum(py, qy) >= y) & (py != qy)
            x = px + (qx - px) * (y - py) / np.where(hit, qy - py, 1.0)
            low, high = np.where(hit, np.minimum(low, x), low), np.where(hit, np.maximum(high, x), high)
        seen = np.isfinite(low)
        x0 = np.maximum(0.0, np.ceil(low[seen])).astype(np.int64)
        x1 = np.minimum(float(width), np.floor(high[seen]) + 1).astype(np.int64)
        base = (line[at[seen]] * height + row[seen]) * (width + 1)
        some = x1 > x0
        yield _united((base + x0)[some], (base + x1)[some])
        first = last


def _united(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open intervals of one axis; touching ones become one."""
    order = np.argsort(start)
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]][: len(start)])
    return start[new], reach[np.r_[new[1:] - 1, len(start) - 1][: len(new)]]


def way_runs(segments: DataFrame, keys: Sequence[str], width: int, height: int) -> DataFrame:
    """Runs covered by thick segments (ax, ay, bx, by, thickness): all pixels within half the thickness
    of the segment, clipped to the image. Each segment makes one interval per row it reaches; a task unites
    those of a batch before they are shuffled. Segments with a null or non-finite number cover nothing."""
    keys = list(keys)
    numbers = ["ax", "ay", "bx", "by", "thickness"]
    plain = segments.select(*keys, *[F.col(c).cast("double").alias(c) for c in numbers])
    kinds = {f.name: f.dataType.simpleString() for f in plain.schema.fields}
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "y bigint, x0 bigint, x1 bigint"])

    def draw(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            values = np.column_stack([table[c].to_numpy().astype(float) for c in numbers])
            good = np.flatnonzero(np.isfinite(values).all(axis=1))
            if not len(good):
                continue
            ax, ay, bx, by, thickness = values[good].T
            # Pictures are numbered in the order of their first row.
            line = pd.DataFrame({k: table[k].take(pa.array(good)).to_pandas() for k in keys}).groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            picture = good[np.unique(line, return_index=True)[1]]
            for start, end in _drawn(ax, ay, bx, by, thickness / 2, line, width, height):
                row, x0 = np.divmod(start, width + 1)
                own = table.select(keys).take(pa.array(picture[row // height]))
                out = [*own.columns, pa.array(row % height), pa.array(x0), pa.array(x0 + end - start)]
                yield from pa.table(out, names=[*keys, "y", "x0", "x1"]).to_batches()

    return merge_runs(plain.mapInArrow(draw, schema), keys)
