"""Exact removal of repeated byte strings by induced sorting of suffixes.

Every string of `width` bytes is owned by one anchor, the place inside it whose `gram` bytes have the least hash; equal
strings have equal anchors at equal offsets, so only suffixes at anchors (about one in width / 2 bytes) are collected and
sorted by Spark's external sorter, and only strings whose anchors occur twice are looked at. Neighbouring strings with one
anchor are a segment. Segments that occur twice as a whole need no more. For the others the suffixes at equal anchors are
put in order together with their longest common prefixes, and from them the order and common prefixes of the suffixes
one byte to the left are induced, then of those two bytes to the left, until every string of the segments has its
place: a string occurs again if it shares `width` bytes with a neighbour.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import _groups, cut, drop, tasks
from skyledger.llm.words import mix, pieces, powers

_RNG = np.random.default_rng(50)
_CODES = _RNG.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BACKS = tuple(pow(s, -1, 1 << 64) for s in _STEPS)
_LOW = np.uint64((1 << 24) - 1)


class Sums:
    """Running sums over a buffer that give 128-bit hashes of any stretch of it."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.sums, self.backs = [], []
        with np.errstate(over="ignore"):
            for code, step, back in zip(_CODES, _STEPS, _BACKS):
                s = np.zeros(n + 1, dtype=np.uint64)
                np.cumsum(code[buf] * powers(step, n), out=s[1:])
                self.sums.append(s)
                self.backs.append(powers(back, n + 1))

    def hashes(self, lo: np.ndarray, hi: np.ndarray, which: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            s = self.sums[which]
            return mix((s[hi] - s[lo]) * self.backs[which][lo] + (hi - lo).astype(np.uint64))


def segments(buf: np.ndarray, offs: np.ndarray, width: int, gram: int):
    """(document, start, strings, anchor - start, hash of the anchor, two hashes of the content) of each segment of a batch."""
    n = len(buf)
    span = width - gram + 1
    if n < width:
        return None
    sums = Sums(buf)
    at = np.arange(n - gram + 1)
    grams = sums.hashes(at, at + gram, 0)
    key = (grams & ~_LOW) | at.astype(np.uint64)
    padded = np.full(-(-len(key) // span) * span, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(key)] = key
    grid = padded.reshape(-1, span)
    rising = np.minimum.accumulate(grid, axis=1).ravel()
    falling = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    owner = (np.minimum(falling[:count], rising[span - 1 : span - 1 + count]) & _LOW).astype(np.int64)
    # Strings that would reach into the next document do not count.
    edge = np.zeros(n + 2, dtype=np.int64)
    last = np.maximum(offs[:-1], offs[1:] - width + 1)
    np.add.at(edge, last, 1)
    np.add.at(edge, offs[1:], -1)
    valid = np.cumsum(edge)[:count] == 0
    new = np.ones(count, dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], count)
    lo, hi = lo[valid[lo]], hi[valid[lo]]
    if not len(lo):
        return None
    doc = np.searchsorted(offs, lo, "right") - 1
    anchor = owner[lo]
    stop = hi - 1 + width
    return doc, lo - offs[doc], hi - lo, anchor - lo, grams[anchor].view(np.int64), sums.hashes(lo, stop, 0).view(np.int64), sums.hashes(lo, stop, 1).view(np.int64)


def _windows(buf: np.ndarray, offs: np.ndarray, width: int, part: int = 1 << 22):
    """segments(), with texts longer than `part` bytes taken in parts that overlap by width - 1 bytes."""
    if len(offs) > 2 or len(buf) <= part + width:
        got = segments(buf, offs, width, min(64, width))
        if got:
            yield got
        return
    for a in range(0, len(buf) - width + 1, part):
        own = buf[a : a + part + width - 1]
        got = segments(own, np.array([0, len(own)]), width, min(64, width))
        if got:
            yield (got[0], got[1] + a, *got[2:])


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo..hi], both ends included, for many ranges."""
    out = values[hi].copy()
    level, table, size = 0, values, 1
    power = np.frexp((hi - lo + 1).astype(float))[1] - 1
    while True:
        own = power == level
        if level and own.any():
            out[own] = np.minimum(table[lo[own]], table[hi[own] - size + 1])
        if level >= power.max(initial=0):
            return out
        table = np.minimum(table[:-size], table[size:])
        level, size = level + 1, size * 2


def induce(group: np.ndarray, before: np.ndarray, content: list[bytes], width: int) -> np.ndarray:
    """For contexts of anchors (group: equal for equal anchors; before: bytes of content before the anchor): whether the string that
    starts a bytes before the anchor occurs in two contexts of its group; a row a context, a column an a.

    The suffixes at the anchors are sorted, with common prefixes; each step to the left sorts the last order by the new
    byte (stably, so the old order decides among equals) and takes a common prefix as one more than the least between the two.
    """
    m, deep = len(content), int(before.max()) + 1
    size = np.array([len(c) for c in content])
    frame = np.zeros((m, deep + width), dtype=np.uint8)
    for i, c in enumerate(content):
        a = deep - before[i]
        frame[i, a : a + len(c)] = np.frombuffer(c, dtype=np.uint8)[: deep + width - a]
    ahead = np.minimum(size - before, width)
    forward = np.ascontiguousarray(frame[:, deep:])
    order = np.argsort(ahead, kind="stable")
    order = order[np.argsort(forward[order].view(f"V{width}").ravel(), kind="stable")]
    order = order[np.argsort(group[order], kind="stable")]
    same = group[order[1:]] == group[order[:-1]]
    prefix = np.zeros(m, dtype=np.int64)
    for a in range(0, m - 1, 4096):
        x, y = order[a : a + 4097][:-1], order[a : a + 4097][1:]
        differ = forward[x] != forward[y]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        prefix[a + 1 : a + 1 + len(x)] = np.minimum(first, np.minimum(ahead[x], ahead[y]))
    prefix[1:][~same] = 0
    again = np.zeros((m, deep), dtype=bool)
    for a in range(deep):
        if a:
            place = np.flatnonzero(before[order] >= a)
            if not len(place):
                break
            key = group[order[place]] * 256 + frame[order[place], deep - a]
            turn = np.argsort(key, kind="stable")
            place, key = place[turn], key[turn]
            longer = np.zeros(len(place), dtype=np.int64)
            tied = np.flatnonzero(key[1:] == key[:-1]) + 1
            if len(tied):
                longer[tied] = 1 + _range_min(prefix, place[tied - 1] + 1, place[tied])
            order, prefix = order[place], longer
        hit = np.flatnonzero(prefix >= width)
        again[order[hit], a] = True
        again[order[hit - 1], a] = True
    return again


def _fetch(requests: DataFrame, docs: DataFrame, width: int, schema: str, make) -> DataFrame:
    """make(request, content) over the segments that `requests` lists for each document."""
    wanted = requests.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("anchor", "start", "strings", "ahead", "n")).alias("want"))
    both = wanted.join(docs, wanted["doc_id"].eqNullSafe(docs["doc_id"]) & (wanted["mark"] == docs["mark"])).select(docs["doc_id"], docs["mark"], "want", "text")

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                body = one.column("text")[0].as_py().encode()
                doc, mark = one.column("doc_id")[0].as_py(), one.column("mark")[0].as_py()
                rows = [make(doc, mark, w, body[w["start"] : w["start"] + w["strings"] - 1 + width]) for w in one.column("want")[0].as_py()]
                yield from pa.Table.from_pylist([x for y in rows for x in y], schema=_schema(schema)).to_batches()

    return both.mapInArrow(run, schema)


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (c.strip().split(" ") for c in text.split(","))])


def repeats(docs: DataFrame, width: int = 400, batch: int = 16384, crowd: int = 8192) -> DataFrame:
    """(doc_id, mark, start, stop): byte ranges that cover every string of `width` bytes of docs (doc_id, mark, text) which
    starts anywhere else too. Ranges may touch and overlap.

    An anchor with more than `crowd` different segments is not brought together in one task: its strings are
    counted by hash, each for itself, with the same result.
    """

    def collect(batches):
        for b in batches:
            for x, y, buf, offs in pieces(b.column("text")):
                for doc, start, strings, ahead, anchor, g1, g2 in _windows(buf, offs, width):
                    at = pa.array(doc + x)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").take(at), b.column("mark").take(at), pa.array(start.astype(np.int32)), pa.array(strings.astype(np.int32)), pa.array(ahead.astype(np.int32)), pa.array(anchor), pa.array(g1), pa.array(g2)],
                        ["doc_id", "mark", "start", "strings", "ahead", "anchor", "g1", "g2"],
                    )

    found = cut(docs.select("doc_id", "mark", "text").mapInArrow(collect, "doc_id long, mark long, start int, strings int, ahead int, anchor long, g1 long, g2 long"), "anchors")
    # Anchors met once have no part in any repeat
    # (written first: a join of two plain tables is split where an anchor is hot, one above its own aggregate is not).
    twice = cut(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor"), "twice")
    near = cut(found.join(twice, "anchor"), "anchors")
    drop(found, twice)
    kinds = cut(
        near.groupBy("anchor", "ahead", "strings", "g1", "g2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "mark", "start")).alias("rep")),
        "segments",
    )
    whole = kinds.where("n > 1").select("g1", "g2", "anchor", "ahead", "strings")
    sure = near.join(whole, ["g1", "g2", "anchor", "ahead", "strings"], "left_semi").select("doc_id", "mark", "start", (F.col("start") + F.col("strings") + (width - 1)).alias("stop"))

    # Segments of one anchor that differ may still share strings; those that occur once ask, all others bear witness.
    mixed = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("m > 1 AND least = 1").select("anchor", "m")
    asked = kinds.join(mixed, "anchor").select("anchor", "rep.*", "strings", "ahead", "n", "m")
    few, many = asked.where(F.col("m") <= crowd), asked.where(F.col("m") > crowd)

    context = "anchor long, doc_id long, mark long, start int, ahead int, once boolean, content binary"
    sent = _fetch(few, docs, width, context, lambda d, k, w, body: [{"anchor": w["anchor"], "doc_id": d, "mark": k, "start": w["start"], "ahead": w["ahead"], "once": w["n"] == 1, "content": body}])

    def settle(batches):
        held, rows = [], 0
        for group in _groups(batches, ["anchor"]):
            held.append(group)
            rows += group.num_rows
            if rows >= batch:
                yield from shared(held)
                held, rows = [], 0
        if held:
            yield from shared(held)

    def shared(held):
        t = pa.concat_tables(held)
        group = np.repeat(np.arange(len(held)), [g.num_rows for g in held])
        before = t["ahead"].to_numpy().astype(np.int64)
        again = induce(group, before, t["content"].to_pylist(), width)
        again[~t["once"].to_numpy(zero_copy_only=False)] = False
        side = np.zeros((len(again), 1), dtype=bool)
        wide = np.concatenate([side, again, side], axis=1)
        row, first = np.nonzero(wide[:, 1:-1] & ~wide[:, :-2])
        _, last = np.nonzero(wide[:, 1:-1] & ~wide[:, 2:])
        anchor = (t["start"].to_numpy().astype(np.int64) + before)[row]
        at = pa.array(row)
        yield from pa.table(
            {"doc_id": t["doc_id"].take(at), "mark": t["mark"].take(at), "start": pa.array((anchor - last).astype(np.int32)), "stop": pa.array((anchor - first + width).astype(np.int32))}
        ).combine_chunks().to_batches()

    spans = "doc_id long, mark long, start int, stop int"
    induced = sent.repartition(tasks(docs), "anchor").sortWithinPartitions("anchor").mapInArrow(settle, spans)

    def strings(d, k, w, body):
        sums = Sums(np.frombuffer(body, dtype=np.uint8))
        at = np.arange(w["strings"])
        h1, h2 = (sums.hashes(at, at + width, s).view(np.int64).tolist() for s in (0, 1))
        return [{"doc_id": d, "mark": k, "start": w["start"] + int(i), "once": w["n"] == 1, "h1": x, "h2": y} for i, x, y in zip(at, h1, h2)]

    single = _fetch(many, docs, width, "doc_id long, mark long, start int, once boolean, h1 long, h2 long", strings)
    common = single.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h1", "h2")
    counted = single.where("once").join(common, ["h1", "h2"], "left_semi").select("doc_id", "mark", "start", (F.col("start") + width).cast("int").alias("stop"))
    return sure.unionByName(induced).unionByName(counted)


def remove_repeats(docs: DataFrame, width: int = 400, kept_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with kept_bytes the bytes kept, for every row of docs (doc_id, text, ...).

    Each byte covered by a string of `width` bytes that also starts anywhere else, in the same document or another, is removed;
    strings are judged on the input. A null text is empty; texts under `width` bytes lose nothing. Rows that repeat a doc_id
    are separate documents, so both copies lose what they share.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("mark"), body.alias("text"))
    ranges = repeats(rows, width).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    both = rows.join(ranges, rows["doc_id"].eqNullSafe(ranges["doc_id"]) & (rows["mark"] == ranges["mark"]), "left").select(rows["doc_id"], "text", "ranges")

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text"), batch.column("ranges")):
                raw = np.frombuffer(text.as_py().encode(), dtype=np.uint8)
                edge = np.zeros(len(raw) + 1, dtype=np.int64)
                if spans.is_valid:
                    pair = spans.values.flatten()
                    np.add.at(edge, pair[0].to_numpy(), 1)
                    np.add.at(edge, pair[1].to_numpy(), -1)
                gone = np.cumsum(edge)[:-1] > 0
                kept = raw[~gone].tobytes()
                runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[:1].sum())
                out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept if kept_bytes else None))
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if kept_bytes else out.drop("kept")
