"""Distances and components of masks, worked out where a mask's runs lie.

A mask lies in one image, so its merged runs are bounded by the image's pixels. Spark brings the runs of a mask together and in order, many masks a task;
numpy then works on the rows that the mask reaches, whatever the radius: no run is copied per distance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.session import cut, spread

#: Runs that are worked on in one call, if no single mask has more.
ROWS = 1 << 16
#: Pixels of a canvas that several masks share.
CELLS = 1 << 18


def _whole_masks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole masks, whose rows arrive side by side, and the first row of each mask with one more at the end."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def ready(last: bool):
        nonlocal held, rows
        table = pa.Table.from_batches(held).combine_chunks()
        mask = table.column("_mask").to_numpy()
        first = np.concatenate([[0], np.flatnonzero(mask[1:] != mask[:-1]) + 1, [len(mask)]])
        if not last:
            # The last mask may go on in the next batch.
            rest = table.slice(first[-2])
            table, first = table.slice(0, first[-2]), first[:-1]
            held, rows = rest.to_batches(), rest.num_rows
        return table, first

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= ROWS:
            table, first = ready(False)
            if table.num_rows:
                yield table, first
    if rows:
        yield ready(True)


def per_mask(runs: DataFrame, keys: Sequence[str], work: Callable[..., Iterator[tuple]], added: str = "") -> DataFrame:
    """work(first, y, x0, x1) over whole masks in order of (y, x0) gives (mask, y, x0, x1, *added) arrays; keys come back by mask."""
    keys = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in runs.schema.fields}
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "y bigint", "x0 bigint", "x1 bigint", *([added] if added else [])])
    names = ["y", "x0", "x1", *[c.strip().split(" ")[0] for c in added.split(",") if c]]

    def run(batches):
        for table, first in _whole_masks(batches):
            column = lambda c: table.column(c).to_numpy()
            for mask, *cols in work(first, column("y"), column("x0"), column("x1")):
                if len(mask):
                    owner = table.select(keys).take(pa.array(first[mask])).combine_chunks()
                    yield from pa.table([*owner.columns, *[pa.array(c) for c in cols]], names=[*keys, *names]).to_batches(max_chunksize=1 << 16)

    whole = runs.select(*keys, *[F.col(c).cast("bigint").alias(c) for c in ("y", "x0", "x1")], F.xxhash64(*keys).alias("_mask"))
    return spread(whole, *keys).sortWithinPartitions("_mask", *keys, "y", "x0").mapInArrow(run, schema)


def _reach(mask: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, half: np.ndarray, width: int, height: int):
    """(mask, y, x0, x1): runs of the pixels within the radius of each mask; half[d] is the reach along a row whose mask pixel lies d rows off, -1 beyond the radius.

    Masks (their runs in order) are laid below each other, each with the radius around it, so none reaches into another. Down every column the distance to the
    nearest mask row is found by two scans. A row's reached pixels are then the union of one interval a column: the part of the lower envelope of the columns'
    parabolas that lies within the radius.
    """
    radius = len(half) - 2
    first = np.flatnonzero(np.append(True, mask[1:] != mask[:-1]))
    top, left = np.minimum.reduceat(y, first) - radius, np.minimum.reduceat(x0, first) - radius
    tall, w = np.maximum.reduceat(y, first) + radius + 1 - top, int((np.maximum.reduceat(x1, first) + radius - left).max())
    begin = np.cumsum(tall) - tall
    h, own = int(tall.sum()), np.repeat(np.arange(len(first)), np.diff(np.append(first, len(mask))))
    line, size = begin[own] + y - top[own], h * (w + 1)
    ends = np.bincount(line * (w + 1) + x0 - left[own], minlength=size) - np.bincount(line * (w + 1) + x1 - left[own], minlength=size)
    filled = np.cumsum(ends.reshape(h, w + 1), axis=1)[:, :w] > 0
    row = np.arange(h, dtype=np.int32)[:, None]
    far = np.int32(4 * (h + radius + 1))
    above = row - np.maximum.accumulate(np.where(filled, row, -far), axis=0)
    below = np.minimum.accumulate(np.where(filled, row, far)[::-1], axis=0)[::-1] - row
    reach = half[np.minimum(np.minimum(above, below), radius + 1)]
    r, c = np.nonzero(reach >= 0)
    reach = reach[r, c]
    steps = np.bincount(r * (w + 1) + c - reach, minlength=size) - np.bincount(r * (w + 1) + c + reach + 1, minlength=size)
    inside = np.cumsum(steps.reshape(h, w + 1), axis=1) > 0
    change = np.diff(np.concatenate([np.zeros((h, 1), np.int8), inside.astype(np.int8)], axis=1), axis=1)
    r, starts = np.nonzero(change == 1)
    stops = np.nonzero(change == -1)[1]
    k = np.searchsorted(begin, r, "right") - 1
    # The radius around a mask may lie outside the image.
    ys, starts, stops = r - begin[k] + top[k], np.maximum(starts + left[k], 0), np.minimum(stops + left[k], width)
    seen = (ys >= 0) & (ys < height) & (starts < stops)
    return mask[first][k[seen]], ys[seen], starts[seen], stops[seen]


def dilate(merged: DataFrame, keys: Sequence[str], radius: int, width: int, height: int) -> DataFrame:
    """Grow by a disc: merged runs of every pixel whose centre is within `radius` of a mask pixel's centre, inside the image."""
    half = np.array([int((radius * radius - d * d) ** 0.5 + 1e-9) for d in range(radius + 1)] + [-1], np.int64)

    def work(first, y, x0, x1):
        mask = np.repeat(np.arange(len(first) - 1), np.diff(first))
        x0, x1 = np.clip(x0, 0, width), np.clip(x1, 0, width)
        real = (y >= 0) & (y < height) & (x0 < x1)
        mask, y, x0, x1 = mask[real], y[real], x0[real], x1[real]
        if not len(mask):
            return
        # Masks of like width share a canvas of bounded size, a large one has its own.
        start = np.flatnonzero(np.append(True, mask[1:] != mask[:-1]))
        many = np.diff(np.append(start, len(mask)))
        wide = np.maximum.reduceat(x1, start) - np.minimum.reduceat(x0, start) + 2 * radius + 1
        tall = np.maximum.reduceat(y, start) - np.minimum.reduceat(y, start) + 2 * radius + 1
        order = np.argsort(wide, kind="stable")
        i = 0
        while i < len(order):
            cells = np.cumsum(tall[order[i : i + CELLS]]) * wide[order[i : i + CELLS]]
            j = i + max(1, int(np.searchsorted(cells, CELLS, "right")))
            some = order[i:j]
            at = np.repeat(start[some] - np.cumsum(many[some]) + many[some], many[some]) + np.arange(many[some].sum())
            yield _reach(mask[at], y[at], x0[at], x1[at], half, width, height)
            i = j

    return per_mask(merged, keys, work)


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each node's component, by hooking to smaller roots and halving paths."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        open_ = a != b
        if not open_.any():
            break
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _components(first, y, x0, x1, minimum: int = 0):
    """(mask, y, x0, x1, y and x0 of the first run of its component) of all masks at once."""
    mask = np.repeat(np.arange(len(first) - 1), np.diff(first))
    low, high = int(y.min()), int(y.max())
    left, right = int(x0.min()), int(x1.max())
    line = mask * (high - low + 2) + (y - low)
    span = right - left + 2
    starts, stops = line * span + (x0 - left), line * span + (x1 - left)
    # Runs of the next row that meet this one, corners included: they end at or after its start and start at or before its end.
    a = np.searchsorted(stops, starts + span, "left")
    b = np.searchsorted(starts, stops + span, "right")
    n = np.maximum(b - a, 0)
    u = np.repeat(np.arange(len(y)), n)
    v = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
    root = _roots(len(y), u, v)
    if minimum > 1:
        large = np.bincount(root, weights=x1 - x0, minlength=len(y))[root] >= minimum
    else:
        large = slice(None)
    yield mask[large], y[large], x0[large], x1[large], y[root][large], x0[root][large]


def label(merged: DataFrame, keys: Sequence[str], minimum: int = 0) -> DataFrame:
    """Merged runs with their component (8 neighbours): a struct of the keys and y and x0 of its first run. Components below `minimum` pixels are left out."""
    keys = list(keys)
    found = per_mask(merged, keys, lambda *runs: _components(*runs, minimum=minimum), "_cy bigint, _cx bigint")
    return found.select(*keys, "y", "x0", "x1", F.struct(*keys, F.col("_cy").alias("y"), F.col("_cx").alias("x0")).alias("component"))


def retain(merged: DataFrame, keys: Sequence[str], minimum: int) -> DataFrame:
    """Labelled runs of components with at least `minimum` pixels, written once."""
    return cut(label(merged, keys, minimum), "components")
