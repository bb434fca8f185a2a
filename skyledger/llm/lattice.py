"""Near-duplicate vectors by lattice hashing.

Each table projects unit vectors to eight dimensions at random and decodes them to the nearest point of the E8 lattice,
the vector's cell; neighbouring cells (the lattice points next in distance) are probed as well. Vectors that meet in a
cell are verified by cosine in double precision, and the links found join them to components. Links are then counted
exactly inside each component, in pairs of bounded blocks, so links count that no table has found on its own.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import block_pairs, cut, grouped
from skyledger.llm.words import mix
from skyledger.operators.components import id_components


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1) % 2)
    if len(odd):
        gap = x[odd] - r[odd]
        worst = np.abs(gap).argmax(axis=1)
        r[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, which is D8 and D8 shifted by a half in each coordinate."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(nearer[:, None], half, whole)


def short_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(out)


class Tables:
    """`tables` random projections from `dim` dimensions, and the cells of vectors under each."""

    def __init__(self, dim: int, tables: int, scale: float, probes: int, seed: int = 3):
        rng = np.random.default_rng([seed, dim])
        self.maps = rng.normal(0, scale, (tables, dim, 8))
        self.shift = rng.uniform(0, 2, (tables, 8))
        self.near = short_vectors()
        self.probes = probes

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """Cell numbers, one row a vector: for each table the own cell, then `probes` neighbours, nearest first."""
        out = []
        for t, (m, s) in enumerate(zip(self.maps, self.shift)):
            x = unit @ m + s
            own = nearest_e8(x)
            gain = (x - own) @ self.near.T
            best = np.argsort(-gain, axis=1, kind="stable")[:, : self.probes]
            points = np.concatenate([own[:, None, :], own[:, None, :] + self.near[best]], axis=1)
            code = np.full(points.shape[:2], t + 1, dtype=np.uint64)
            with np.errstate(over="ignore"):
                for c in range(8):
                    code = mix(code * np.uint64(0x9E3779B97F4A7C15) + np.rint(2 * points[:, :, c]).astype(np.int64).view(np.uint64))
            out.append(code.view(np.int64))
        return np.concatenate(out, axis=1)


def unit_rows(raw: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision from vectors of one length, kept as bytes of their own precision."""
    x = np.frombuffer(b"".join(raw), dtype=kind).astype(float).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _prepared(vectors: DataFrame, id_col: str, vec_col: str, kind: str) -> DataFrame:
    """id and vector (bytes), without the rows that link with nothing."""

    def run(batches):
        for batch in batches:
            rows, raw = [], []
            for i, v in enumerate(batch.column("vec")):
                own = v.values
                if own is None or own.null_count or not len(own):
                    continue
                x = own.to_numpy(zero_copy_only=False).astype(kind)
                top = np.abs(x).max()
                if top > 0 and np.isfinite(top):
                    rows.append(i)
                    raw.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), pa.array(raw, pa.binary())], ["id", "unit"])

    vec = F.col(vec_col) if kind == "<f4" else F.col(vec_col).cast("array<double>")
    return vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where("id IS NOT NULL").mapInArrow(run, "id long, unit binary")


def _entries(units: DataFrame, kind: str, tables: int, scale: float, probes: int) -> DataFrame:
    """(bucket, id, unit): a row for each cell that a vector lies in or probes."""

    def run(batches):
        for batch in batches:
            raw = batch.column("unit").to_pylist()
            by_size: dict[int, list[int]] = {}
            for i, u in enumerate(raw):
                by_size.setdefault(len(u) // int(kind[2]), []).append(i)
            for dim, rows in by_size.items():
                plan = Tables(dim, tables, scale, probes)
                for a in range(0, len(rows), 1024):
                    part = rows[a : a + 1024]
                    cells = plan.cells(unit_rows([raw[i] for i in part], kind))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(pa.array(np.repeat(part, cells.shape[1]))), pa.array(cells.ravel() + dim), pa.array(np.tile(np.arange(cells.shape[1]) % (probes + 1) == 0, len(part)))],
                        ["id", "bucket", "own"],
                    )

    return units.mapInArrow(run, "id long, bucket long, own boolean")


def _matrix(group: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    unit = unit_rows(group["unit"].to_pylist(), kind)
    first, second = (np.flatnonzero(group[c].to_numpy(zero_copy_only=False)) for c in ("first", "second"))
    return group["id"].to_numpy(), unit, first, second


def _stars(group: pa.Table, kind: str, least: float) -> dict | None:
    """Verified links of two blocks of a cell, thinned to one link for each vector and set that they connect."""
    ids, unit, first, second = _matrix(group, kind)
    us, vs = [], []
    label = np.arange(len(ids))
    # A vector that probes a cell is compared with those that lie in it, not with the others that probe it.
    own = group["own"].to_numpy(zero_copy_only=False)
    for a in range(0, len(first), 512):
        rows = first[a : a + 512]
        hit = (unit[rows] @ unit[second].T >= least) & (own[rows][:, None] | own[second][None, :])
        for r, line in zip(rows, hit):
            to = second[line]
            to = to[label[to] != label[r]]
            if len(to):
                old, at = np.unique(label[to], return_index=True)
                label[np.isin(label, old)] = label[r]
                us.append(np.full(len(at), ids[r]))
                vs.append(ids[to[at]])
    if not us:
        return None
    return {"u": np.concatenate(us), "v": np.concatenate(vs)}


def _counts(group: pa.Table, kind: str, least: float) -> dict:
    """Links of each vector of two blocks with the vectors of the other, copies counted by weight; in one block, with its own."""
    ids, unit, first, second = _matrix(group, kind)
    weight = group["n"].to_numpy().astype(float)
    one = np.zeros(len(ids))
    for a in range(0, len(first), 512):
        rows = first[a : a + 512]
        hit = unit[rows] @ unit[second].T >= least
        one[rows] += hit @ weight[second]
        if not (group["p"][0].as_py() == group["q"][0].as_py()):
            one[second] += weight[rows] @ hit
    return {"id": ids, "links": np.rint(one).astype(np.int64)}


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95, tables: int = 16, scale: float = 1.25, probes: int = 4, block: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors with a cosine of at least `least` are linked; vectors that are null, zero, or hold null or non-finite
    components, and rows without id, link with nothing. Equal vectors are hashed once and counted as often as they are
    there. Vectors of different lengths are never compared. Rows that repeat an id are separate vectors that share it.
    """
    kind = "<f4" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"
    units = cut(_prepared(vectors, id_col, vec_col, kind), "units")
    classes = cut(units.groupBy("unit").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.xxhash64("unit").alias("h")).select("id", "n", "unit", F.xxhash64("id", "h").alias("key")), "classes")
    byte = classes.select(F.col("key").alias("id"), "unit")
    entries = _entries(byte, kind, tables, scale, probes)
    useful = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.max("own").alias("any")).where("m > 1 AND any").select("bucket")
    members = cut(entries.join(useful, "bucket"), "cells").join(byte, "id")
    edges = cut(grouped(block_pairs(members, "bucket", "id", block), ["bucket", "p", "q"], lambda g: _stars(g, kind, least), "u long, v long").distinct(), "links")
    joined = cut(id_components(edges), "components")

    inside = joined.join(byte, joined["node"] == byte["id"]).join(classes.select(F.col("key").alias("node"), "n"), "node").select(F.col("component").alias("bucket"), F.col("node").alias("id"), "unit", "n")
    part = grouped(block_pairs(inside, "bucket", "id", block), ["bucket", "p", "q"], lambda g: _counts(g, kind, least), "id long, links long")
    links = part.groupBy("id").agg(F.sum("links").alias("links"))

    least_id = joined.join(classes, joined["node"] == classes["key"]).groupBy("component").agg(F.min("id").alias("component_id"))
    named = joined.join(least_id, "component").select(F.col("node").alias("key"), "component_id")
    about = classes.join(named, "key", "left").join(links.withColumnRenamed("id", "key"), "key", "left").select(
        "unit", F.coalesce("component_id", "id").alias("component_id"), (F.coalesce("links", "n") - 1).alias("n_links")
    )
    found = units.join(about, "unit").groupBy("id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    out = rows.join(found, rows["vec_id"] == found["id"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
