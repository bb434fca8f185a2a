"""Near-duplicate documents by min-max hashing.

Every permutation of the shingle hashes gives two signature values, its least and its greatest element, so `perms`
hash evaluations give 2 * perms values, each of which agrees between two sets with the chance of their Jaccard
similarity. Four values (two permutations) make a band. With 40 permutations a pair at similarity 0.85 shares none of the
20 bands with a chance of 4e-7, at 0.8 of 3e-5.

Links are confirmed on full sets. No group of copies is expanded into pairs: equal sets are one class; in every band
bucket each class is compared with the bucket's least class; after the links so found are joined to components, only
buckets that still hold several components are looked at again, in pairs of blocks of bounded size, where documents of
different components that share a band are compared on full sets and only links that join something are given out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import block_pairs, cut, drop, grouped
from skyledger.llm.words import mix, pieces, shingle_set, word_hashes
from skyledger.operators.components import id_components

RUN = 8192


class Permutations:
    def __init__(self, perms: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 1 << 63, perms, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.b = rng.integers(0, 1 << 63, perms, dtype=np.uint64)

    def min_max(self, sets: np.ndarray) -> np.ndarray:
        """Least and greatest element under each permutation, side by side: 2 * perms values."""
        low = np.full(len(self.a), np.iinfo(np.uint64).max, dtype=np.uint64)
        high = np.zeros(len(self.a), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(0, len(sets), RUN):
                image = self.a[:, None] * sets[None, i : i + RUN] + self.b[:, None]
                np.minimum(low, image.min(axis=1), out=low)
                np.maximum(high, image.max(axis=1), out=high)
        return np.column_stack([low, high]).ravel()


def bands(values: np.ndarray, rows: int = 4) -> np.ndarray:
    """One number for each run of `rows` signature values; the band's place is part of it."""
    with np.errstate(over="ignore"):
        total = np.arange(len(values) // rows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for v in values.reshape(-1, rows).T:
            total = mix(total * np.uint64(0xD6E8FEB86659FD93) + v)
    return total.view(np.int64)


def signatures(docs: DataFrame, k: int, perms: int) -> DataFrame:
    """doc_id, n_shingles, two numbers that name the set and its bands (null for an empty set)."""

    def run(batches):
        family = Permutations(perms)
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, buf, offs in pieces(batch.column("text")):
                words, first = word_hashes(buf, offs)
                size, k1, k2, band = [], [], [], []
                for i in range(b - a):
                    own = shingle_set(words[first[i] : first[i + 1]], k)
                    size.append(len(own))
                    if not len(own):
                        k1.append(0), k2.append(0), band.append(None)
                        continue
                    values = family.min_max(own)
                    with np.errstate(over="ignore"):
                        k1.append(int(own.sum().view(np.int64)))
                        k2.append(int(mix(own * np.uint64(0x9E3779B97F4A7C15)).sum().view(np.int64)))
                    band.append(bands(values))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(size, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(band, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "k1", "k2", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"
    )


def _confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) of documents with 100 * intersection >= percent * union on full shingle sets."""
    left = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("tu"))
    right = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("tv"))
    both = pairs.join(right, "v").join(left, "u")

    def run(batches):
        kept = {}

        def sets(ids, column, remember):
            """Shingle sets by row; equal neighbours (pairs come sorted by their first document) are made once."""
            out = [None] * len(ids)
            fresh = [i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]]
            if remember and len(ids) and ids[0] in kept:
                fresh = fresh[1:]
                out[0] = kept[ids[0]]
            for a, b, buf, offs in pieces(column.take(pa.array(fresh, pa.int64()))):
                words, first = word_hashes(buf, offs)
                for i in range(b - a):
                    out[fresh[a + i]] = shingle_set(words[first[i] : first[i + 1]], k)
            for i in range(1, len(ids)):
                if out[i] is None:
                    out[i] = out[i - 1]
            if remember and len(ids):
                kept.clear()
                kept[ids[-1]] = out[-1]
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                us, vs = part.column("u").to_pylist(), part.column("v").to_pylist()
                su, sv = sets(us, part.column("tu"), True), sets(vs, part.column("tv"), False)
                good = []
                for x, y in zip(su, sv):
                    least, most = sorted((len(x), len(y)))
                    if 100 * least < percent * most:
                        good.append(False)
                        continue
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * shared >= percent * (least + most - shared))
                hit = pa.array(np.flatnonzero(good), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("u").take(hit), part.column("v").take(hit)], ["u", "v"])

    return both.select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long")


def _across(group: pa.Table, k: int, percent: int) -> dict | None:
    """Confirmed links between two blocks, of documents that share a band and are not linked yet; one link for each set that it joins."""
    ids, comp = group["rep"].to_numpy(), group["component"].to_numpy()
    _, label = np.unique(comp, return_inverse=True)
    if (label == label[0]).all():
        return None
    band = group["bands"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    sets = []
    for a, b, buf, offs in pieces(group["text"]):
        words, first = word_hashes(buf, offs)
        sets += [shingle_set(words[first[i] : first[i + 1]], k) for i in range(b - a)]
    size = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(size)])
    # Shingles as small numbers: a set is then counted against many others by looking up marks.
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(codes.max() + 1, dtype=bool)
    one, two = (np.flatnonzero(group[c].to_numpy(zero_copy_only=False)) for c in ("first", "second"))
    us, vs = [], []
    for i in one:
        other = two[label[two] != label[i]]
        other = other[(band[other] == band[i]).any(axis=1)]
        other = other[100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i])]
        if not len(other):
            continue
        own = codes[starts[i] : starts[i + 1]]
        mark[own] = True
        shared = np.array([np.count_nonzero(mark[codes[starts[j] : starts[j + 1]]]) for j in other])
        mark[own] = False
        hit = other[100 * shared >= percent * (size[other] + size[i] - shared)]
        if len(hit):
            old, at = np.unique(label[hit], return_index=True)
            us.append(np.full(len(at), ids[i]))
            vs.append(ids[hit[at]])
            label[np.isin(label, old)] = label[i]
    if not us:
        return None
    return {"u": np.concatenate(us), "v": np.concatenate(vs)}


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, perms: int = 40, block: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text, ...).

    Sets are distinct k-word shingles of lower-cased (A-Z) words, the whole sequence for fewer words. Documents are linked
    when 100 * intersection >= percent * union; component_id is the least doc_id reachable. Documents without words, null
    texts among them, and rows without doc_id are linked with nothing (component_id is the doc_id, null for a null one, which
    is never kept). Rows that repeat a doc_id are one document for linking, and each is returned.
    """
    rows = cut(signatures(docs, k, perms), "minmax")
    sets = rows.where(F.col("bands").isNotNull() & F.col("doc_id").isNotNull())
    classes = cut(sets.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    same = sets.select("doc_id", "k1", "k2").join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).where("doc_id != rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))

    entries = classes.select("rep", F.explode("bands").alias("bucket"))
    # Written first: a join of two plain tables is split where a bucket is hot, one above its own aggregate is not.
    spans = cut(entries.groupBy("bucket").agg(F.min("rep").alias("lead"), F.max("rep").alias("far")).where("lead < far"), "spans")
    shared = cut(entries.join(spans.select("bucket", "lead"), "bucket"), "buckets")
    tried = shared.where("lead < rep").select(F.col("lead").alias("u"), F.col("rep").alias("v")).distinct()
    wanted = shared.select(F.col("rep").alias("doc_id")).distinct()
    texts = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(wanted, "doc_id", "left_semi"), "texts")
    links = cut(_confirm(tried, texts, k, percent), "links")

    found = cut(id_components(links), "components")
    label = F.coalesce("component", "rep").alias("component")
    placed = cut(shared.join(found, shared["rep"] == found["node"], "left").select("bucket", "rep", "lead", label), "placed")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    meets = cut(placed.join(mixed, "bucket").select("rep", "lead", "component").distinct(), "mixed")
    # Buckets that share documents are one group, so that a document is sent once and not for each of its bands.
    crowd = cut(id_components(meets.select(F.col("rep").alias("u"), F.col("lead").alias("v"))), "groups")
    members = (
        meets.select("rep", "component").distinct()
        .join(crowd.select(F.col("node").alias("rep"), F.col("component").alias("group")), "rep")
        .join(classes.groupBy("rep").agg(F.first("bands").alias("bands")), "rep")
        .join(texts.select(F.col("doc_id").alias("rep"), "text").dropDuplicates(["rep"]), "rep")
        .select("group", "rep", "component", "bands", "text")
    )
    more = cut(grouped(block_pairs(members, "group", "rep", block), ["group", "p", "q"], lambda g: _across(g, k, percent), "u long, v long"), "links")

    # A class with copies of one document under several ids, and the links between classes, are joined once more.
    nodes = cut(id_components(same.unionByName(links).unionByName(more)), "components")
    out = rows.select("doc_id", "n_shingles").join(nodes, rows["doc_id"] == nodes["node"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )
    drop(spans, shared, texts, placed, found, meets, crowd, classes)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
