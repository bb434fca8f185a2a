"""Connected components of an edge table in a logarithmic number of rounds.

Alternates the "large star" and "small star" steps of Kiveris et al., "Connected Components in
MapReduce and Beyond" (2014). Every step is one aggregate (combined before the shuffle) and one
equi-join against a single row per node, so a node with very many neighbours only makes that join
skewed on its row side, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.session import cut, drop


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"),
    ).first()
    return row["n"], row["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.where(F.col("v") > F.col("u"))
        .join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least place that each of n places is linked with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _chunks(batches, rows: int):
    """Batches gathered to tables of about so many rows: any subset of edges may be contracted on its own."""
    parts, held = [], 0
    for batch in batches:
        if batch.num_rows:
            parts.append(batch)
            held += batch.num_rows
        if held >= rows:
            yield pa.Table.from_batches(parts)
            parts, held = [], 0
    if parts:
        yield pa.Table.from_batches(parts)


def _contract(batches, chunk: int = 1 << 18):
    """Replace the edges of every chunk of a partition by a star per linked set of the chunk."""
    for table in _chunks(batches, chunk):
        names = pa.chunked_array(table["su"].chunks + table["sv"].chunks)
        nodes = pa.chunked_array(table["u"].chunks + table["v"].chunks).combine_chunks()
        codes, uniques = pd.factorize(names.to_pandas())
        n = table.num_rows
        label = least_labels(codes[:n], codes[n:], len(uniques))
        first = np.zeros(len(uniques), dtype=np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        leaf = np.flatnonzero(label != np.arange(len(label)))
        out = pa.table({"u": nodes.take(pa.array(first[leaf])), "v": nodes.take(pa.array(first[label[leaf]]))})
        yield from out.to_batches()


def _rounds(edges: DataFrame) -> DataFrame:
    """Large and small stars until nothing changes: (u, v) with one centre v per linked set."""
    current, seen = edges, _fingerprint(edges)
    while seen[0]:
        last, current = current, cut(_small_star(_large_star(current)), "edges")
        drop(last)
        now = _fingerprint(current)
        if now == seen:
            break
        seen = now
    return current


def _contract_ids(batches, chunk: int = 1 << 20):
    """_contract() for plain ids."""
    for table in _chunks(batches, chunk):
        ids, codes = np.unique(np.concatenate([table["u"].to_numpy(), table["v"].to_numpy()]), return_inverse=True)
        label = least_labels(codes[: table.num_rows], codes[table.num_rows :], len(ids))
        leaf = np.flatnonzero(label != np.arange(len(label)))
        yield pa.record_batch({"u": ids[leaf], "v": ids[label[leaf]]})


def id_components(edges: DataFrame) -> DataFrame:
    """(u, v) long -> (node, component): the least id reachable, for every id that has an edge.

    Any subset of edges may be contracted on its own, so every task shrinks its edges in bounded chunks
    first; the distributed rounds then work on stars.
    """
    plain = edges.where(F.col("u") != F.col("v")).select(F.col("u").cast("long"), F.col("v").cast("long"))
    stars = _rounds(cut(plain.mapInArrow(_contract_ids, "u long, v long"), "edges"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def components(edges: DataFrame, src: str, dst: str, near: Sequence[str] = ()) -> DataFrame:
    """node -> component (its least node) for every node that has an edge.

    Nodes may be any orderable type, structs included. Nodes without edges are not listed; callers
    coalesce to the node itself. Edges are range-partitioned by the `near` columns and the node, so that most
    linked sets lie in one partition, and every task first shrinks its edges to stars in bounded chunks. Sets
    that span partitions, however large, are joined by rounds over the star centres alone.
    """
    plain = edges.where(F.col(src) != F.col(dst))
    if near:
        # The node splits what one value of `near` would send to a single task.
        plain = plain.repartitionByRange(*near, src)
    kind = plain.schema[src].dataType.simpleString()
    text = lambda c: F.to_json(F.struct(F.col(c).alias("n")))
    tagged = plain.select(F.col(src).alias("u"), F.col(dst).alias("v"), text(src).alias("su"), text(dst).alias("sv"))
    stars = cut(tagged.mapInArrow(_contract, f"u {kind}, v {kind}"), "edges")

    leaves = stars.groupBy("u").agg(F.min("v").alias("c"), F.max("v").alias("far"))
    centres = stars.select(F.col("v").alias("u")).distinct()
    shared = stars.join(leaves.where(F.col("c") != F.col("far")), "u").where(F.col("v") != F.col("c"))
    bridges = shared.select(F.col("v").alias("a"), F.col("c").alias("b")).unionByName(
        stars.join(centres, "u", "left_semi").select(F.col("u").alias("a"), F.col("v").alias("b"))
    )
    links = bridges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v"))
    joined = _rounds(cut(links.distinct(), "edges")).select(F.col("u").alias("c"), F.col("v").alias("root"))

    member = leaves.select(F.col("u").alias("node"), "c").unionByName(centres.select(F.col("u").alias("node"), F.col("u").alias("c")))
    rooted = member.join(joined, "c", "left").select("node", F.coalesce("root", "c").alias("root"))
    least = rooted.groupBy("root").agg(F.min("node").alias("component"))
    return rooted.join(least, "root").select("node", "component").distinct()
