"""Benchmark decontamination: passages of documents within a small edit distance of benchmark items.

Texts are compared with A-Z lower-cased and white space as single spaces. Distances up to `rate` of an item's length
count. A text of n bytes holds floor(n / 8) aligned pieces of eight bytes, of which d edits leave floor(n / 8) - d whole, on
diagonals that lie at most d apart; windows without that many are out of reach and are not embedded. The item-sized
windows on the diagonals that remain are embedded by CGK random walks, which turn edit distance into Hamming distance,
and hashed by repeated samples of embedded places; a window that meets its item in any of them is verified by exact edit
distance. Every repetition belongs to one of several independent walks, since a walk that an edit throws off may stay off;
how many repetitions a walk needs for the recall asked for is measured on edited copies of the items themselves. Items too
short for pieces are compared whole, on word borders. A piece that a text repeats counts once, as the item holds it once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.words import LOWER, SPACE, mix, pieces, span_hashes, word_spans

PIECE = 8
_BITS = 22
#: A walk moves on in every second step, so it reads n bytes in about 2n steps: places up to here are written while it still reads.
READ = 1.8
#: Items whose edited copies tell how far walks part.
MEASURED = 64


def normal(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normal form of a batch: bytes, offsets, and which of the original bytes stay."""
    space = SPACE[buf]
    before = np.ones(len(buf), dtype=bool)
    before[1:] = space[:-1]
    starts = offs[:-1][offs[:-1] < len(buf)]
    before[starts] = True
    keep = ~(space & before)
    low = np.where(space, np.uint8(32), LOWER[buf])[keep]
    return low, np.concatenate([[0], np.cumsum(keep)])[offs], keep


def edit_place(item: bytes, text: bytes, most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the substring of text nearest to item, if within `most`: columns of the edit table, one number a row."""
    m = len(item)
    if not m:
        return None
    one = np.arange(m + 1)
    cost, origin = one.copy(), np.zeros(m + 1, dtype=np.int64)
    want = np.frombuffer(item, dtype=np.uint8)
    best = None
    for j, c in enumerate(text):
        diagonal = cost[:-1] + (want != c)
        above = cost[1:] + 1
        step = np.minimum(diagonal, above)
        begin = np.where(diagonal <= above, origin[:-1], origin[1:])
        # Along the item a row costs one more each: least of (step[i] - i) so far, plus i.
        line = np.concatenate([[0], step]) - one
        low = np.minimum.accumulate(line)
        last = np.maximum.accumulate(np.where(line == low, one, 0))
        start = np.concatenate([[j + 1], begin])
        cost, origin = low + one, start[last]
        if cost[m] <= most and (best is None or cost[m] < best[0]):
            best = (int(cost[m]), int(origin[m]), j + 1)
    return best


def within(item: bytes, text: bytes, most: int) -> bool:
    """Whether a substring of text has at most `most` edits from item: a column of the edit table as the bits of two numbers."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[int, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    up, down, score = full, 0, m
    for c in text:
        equal = where.get(c, 0)
        vertical = equal | down
        level = (((equal & up) + up) ^ up) | equal
        plus = down | (full & ~(level | up))
        minus = up & level
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        if score <= most:
            return True
        plus, minus = plus << 1 & full, minus << 1 & full
        up = minus | (full & ~(vertical | plus))
        down = plus & vertical
    return False


class Items:
    """A block of benchmark items: their pieces, embeddings' samples, and limits."""

    def __init__(self, rows: list[tuple[int, bytes]], rate: float, sampled: int, walks: int, per_walk: int, least_bytes: int):
        self.rows = rows
        self.limit = [int(rate * len(t)) for _, t in rows]
        self.need = np.array([max(1, len(t) // PIECE - d) for (_, t), d in zip(rows, self.limit)])
        keys, owner, place = [], [], []
        for k, (_, t) in enumerate(rows):
            if len(t) >= least_bytes:
                for at in range(0, len(t) - PIECE + 1, PIECE):
                    keys.append(t[at : at + PIECE])
                    owner.append(k)
                    place.append(at)
        keys = np.frombuffer(b"".join(keys), dtype="<u8")
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner, self.place = keys[order], np.array(owner, dtype=np.int64)[order], np.array(place, dtype=np.int64)[order]
        self.seen = np.zeros(1 << _BITS, dtype=bool)
        self.seen[self.spot(self.keys)] = True
        self.sampled, self.walks, self.per_walk, self.seed = sampled, walks, per_walk, 11
        self.signs: dict[int, np.ndarray] = {}
        self.coins: list[list[np.ndarray]] = [[] for _ in range(self.walks)]
        # Short items by their number of words: hashes in order, and whose they are.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_words: dict[int, list[int]] = {}
        for k, (_, t) in enumerate(rows):
            if 0 < len(t) < least_bytes:
                by_words.setdefault(t.count(b" ") + 1, []).append(k)
        for n, own in by_words.items():
            ends = np.cumsum([len(rows[k][1]) for k in own])
            hashes = span_hashes(np.frombuffer(b"".join(rows[k][1] for k in own), dtype=np.uint8), np.append(0, ends[:-1]), ends)
            by_hash = np.argsort(hashes, kind="stable")
            self.short[n] = hashes[by_hash], np.array(own)[by_hash]
        self.short_most = least_bytes - 1

    def sign(self, wanted: list[int]) -> np.ndarray:
        """The samples of items, made when windows near them turn up."""
        new = sorted({k for k in wanted if k not in self.signs})
        if new:
            for k, line in zip(new, self.samples([np.frombuffer(self.rows[k][1], dtype=np.uint8) for k in new])):
                self.signs[k] = line
        return np.stack([self.signs[k] for k in wanted])

    @staticmethod
    def spot(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)

    @staticmethod
    def laid(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The texts as rows of one array that ends in zeros, and their lengths."""
        n = np.array([len(t) for t in texts])
        padded = np.zeros((len(texts), n.max() + 1), dtype=np.uint8)
        for r, t in enumerate(texts):
            padded[r, : len(t)] = t
        return padded, n

    def walked(self, padded: np.ndarray, n: np.ndarray, w: int) -> np.ndarray:
        """The texts' CGK embeddings by walk w, a column a text.

        Step j writes the current byte and moves on by a random bit that depends on j and the byte; past the end it writes 0.
        """
        row = np.arange(len(n))
        written = np.zeros((int(READ * int(n.max())) + 1, len(n)), dtype=np.uint8)
        at = np.zeros(len(n), dtype=np.int64)
        for j in range(len(written)):
            if len(self.coins[w]) <= j:
                with np.errstate(over="ignore"):
                    step = mix(np.array([self.seed * 65_537 + w], dtype=np.uint64)) + np.uint64(256 * j) + np.arange(256, dtype=np.uint64)
                    self.coins[w].append((mix(step) & np.uint64(1)).astype(np.int64))
            c = padded[row, at]
            written[j] = c
            at = np.minimum(at + self.coins[w][j][c], n)
        return written

    def sample(self, padded: np.ndarray, n: np.ndarray, w: int) -> np.ndarray:
        """Sampled places of the embeddings by walk w, hashed: a row a text, a column a repetition of `sampled` places."""
        share = np.random.default_rng([self.seed, w]).random((self.per_walk, self.sampled))
        places = (share[None] * (READ * n)[:, None, None]).astype(np.int64)
        written = self.walked(padded, n, w)
        total = np.full((len(n), self.per_walk), w + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.sampled):
                total = mix(total * np.uint64(0xD6E8FEB86659FD93) + written[places[:, :, k], np.arange(len(n))[:, None]].astype(np.uint64))
        return total

    def samples(self, texts: list[np.ndarray]) -> np.ndarray:
        """The samples of all walks, side by side."""
        padded, n = self.laid(texts)
        return np.concatenate([self.sample(padded, n, w) for w in range(self.walks)], axis=1)

    def meet(self, windows: list[np.ndarray], owners: list[int]) -> np.ndarray:
        """Which windows share a sample with their item. A window that has met it takes no further walk."""
        padded, n = self.laid(windows)
        wanted = self.sign(owners)
        left = np.arange(len(windows))
        for w in range(self.walks):
            if not len(left):
                break
            own = wanted[left, w * self.per_walk : (w + 1) * self.per_walk]
            left = left[~(self.sample(padded[left], n[left], w) == own).any(axis=1)]
        hit = np.ones(len(windows), dtype=bool)
        hit[left] = False
        return hit

    def agreement(self, ones: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
        """Share of the read places where the embeddings of two texts of one length agree: a row a walk, a column a pair."""
        out = np.zeros((self.walks, len(ones)))
        for w in range(self.walks):
            same = self.walked(*self.laid(ones), w) == self.walked(*self.laid(others), w)
            out[w] = [same[: max(1, int(READ * len(t))), i].mean() for i, t in enumerate(ones)]
        return out

    def whole(self, low: np.ndarray, offs: np.ndarray):
        """(document, item, start, end, 0) of short items: their first place as whole words in each document."""
        if not self.short:
            return
        s, e, first = word_spans(low, offs)
        last = np.repeat(first[1:], np.diff(first))
        for n, (hashes, owner) in self.short.items():
            i = np.arange(max(0, len(s) - n + 1))
            i = i[i + n <= last[: len(i)]]
            i = i[e[i + n - 1] - s[i] <= self.short_most]
            got = span_hashes(low, s[i], e[i + n - 1]) if len(i) else np.zeros(0, dtype=np.uint64)
            at = np.minimum(np.searchsorted(hashes, got), len(hashes) - 1)
            met: set[tuple[int, int]] = set()
            for j in np.flatnonzero(hashes[at] == got):
                a, b, k = int(s[i[j]]), int(e[i[j] + n - 1]), int(owner[at[j]])
                d = int(np.searchsorted(offs, a, "right")) - 1
                if (d, k) not in met and low[a:b].tobytes() == self.rows[k][1]:
                    met.add((d, k))
                    yield d, k, a - int(offs[d]), b - int(offs[d]), 0

    def hits(self, low: np.ndarray, offs: np.ndarray):
        """(document, item, diagonal, place in the item) of every piece found in the batch, sorted."""
        n = len(low) - PIECE + 1
        if n <= 0 or not len(self.keys):
            return None
        value = np.empty(n, dtype="<u8")
        for o in range(PIECE):
            k = (len(low) - o) // PIECE
            value[o : o + PIECE * k : PIECE][:k] = low[o : o + PIECE * k].view("<u8")[: len(value[o::PIECE])]
        at = np.flatnonzero(self.seen[self.spot(value)])
        got = value[at]
        a, b = np.searchsorted(self.keys, got, "left"), np.searchsorted(self.keys, got, "right")
        at, a, b = at[b > a], a[b > a], b[b > a]
        doc = np.searchsorted(offs, at, "right") - 1
        inside = at + PIECE <= offs[doc + 1]
        at, a, b, doc = at[inside], a[inside], b[inside], doc[inside]
        count = b - a
        entry = np.repeat(a, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        doc, at = np.repeat(doc, count), np.repeat(at, count)
        item, place = self.owner[entry], self.place[entry]
        diagonal = at - place
        order = np.lexsort((place, diagonal, item, doc))
        return doc[order], item[order], diagonal[order], place[order]

    def reached(self, doc: np.ndarray, item: np.ndarray, diagonal: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which of the sorted hits lie in a run of diagonals, as wide as the item's limit, that holds enough different pieces of the item."""
        n = len(doc)
        limit = np.array(self.limit)[item]
        group = np.cumsum(np.append(False, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])))
        # Groups lie so far apart on one line that no run reaches from one into the next.
        line = diagonal - diagonal.min() + group * (int(np.ptp(diagonal)) + int(limit.max()) + 1)
        begin, end = np.searchsorted(line, line - limit, "left"), np.searchsorted(line, line + limit, "right")
        # A hit counts for the runs that start behind the hit of the same piece before it.
        order = np.lexsort((place, group))
        again = 1 + np.flatnonzero((place[order[1:]] == place[order[:-1]]) & (group[order[1:]] == group[order[:-1]]))
        behind = np.zeros(n, dtype=np.int64)
        behind[order[again]] = order[again - 1] + 1
        first = np.maximum(begin, behind)
        change = np.bincount(first, minlength=n + 1) - np.bincount(np.arange(1, n + 1), minlength=n + 1)
        ok = np.cumsum(change)[:n] >= self.need[item]
        cover = np.bincount(np.flatnonzero(ok), minlength=n + 1) - np.bincount(end[ok], minlength=n + 1)
        return np.cumsum(cover)[:n] > 0

    def matches(self, low: np.ndarray, offs: np.ndarray):
        """(document, item, start, end, distance) in the normal form: the nearest passage of each document and item."""
        yield from self.whole(low, offs)
        found = self.hits(low, offs)
        if found is None or not len(found[0]):
            return
        starts: dict[tuple[int, int], set] = {}
        near = self.reached(*found)
        for d, k, s in zip(*(column[near].tolist() for column in found[:3])):
            starts.setdefault((d, k), set()).add(s)
        doubtful = []
        for (d, k), own in starts.items():
            text, a, b = self.rows[k][1], int(offs[d]), int(offs[d + 1])
            # Equal strings have equal embeddings and distance 0: nothing is left to hash or verify.
            same = next((s for s in sorted(own) if a <= s and s + len(text) <= b and low[s : s + len(text)].tobytes() == text), None)
            if same is not None:
                yield d, k, same - a, same - a + len(text), 0
            else:
                doubtful += [(d, k, s) for s in sorted(own)]
        met: dict[tuple[int, int], list[int]] = {}
        for i in range(0, len(doubtful), 4096):
            part = doubtful[i : i + 4096]
            windows = []
            for d, k, s in part:
                text, a, b = self.rows[k][1], int(offs[d]), int(offs[d + 1])
                window = np.zeros(len(text), dtype=np.uint8)
                x, y = max(a, s), min(b, s + len(text))
                window[x - s : y - s] = low[x:y]
                windows.append(window)
            hit = self.meet(windows, [k for _, k, _ in part])
            for (d, k, s), h in zip(part, hit):
                if h:
                    met.setdefault((d, k), []).append(s)
        for (d, k), own in met.items():
            text, most, a, b = self.rows[k][1], self.limit[k], int(offs[d]), int(offs[d + 1])
            best = None
            i = 0
            while i < len(own):
                j = i
                while j + 1 < len(own) and own[j + 1] - own[j] <= most:
                    j += 1
                x, y = max(a, own[i] - most), min(b, own[j] + len(text) + most)
                stretch = low[x:y].tobytes()
                got = edit_place(text, stretch, most) if within(text, stretch, most) else None
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], got[1] + x, got[2] + x)
                i = j + 1
            if best:
                yield d, k, best[1] - a, best[2] - a, best[0]


def edited(text: bytes, edits: int, rng: np.random.Generator) -> bytes:
    """text after random edits, each the loss, change or repetition of a byte; changed bytes are the text's own."""
    body = bytearray(text)
    for at, how, other in zip(rng.random(edits), rng.integers(0, 3, edits), rng.integers(0, max(1, len(text)), edits)):
        at = int(at * len(body))
        body[at : at + 1] = [b"", text[other : other + 1], bytes(body[at : at + 1]) * 2][how]
    return bytes(body)


def repetitions(texts: list[bytes], rate: float, recall: float, sampled: int, walks: int) -> int:
    """Repetitions a walk that let an item and the window that begins with its copy after rate * length edits meet with the chance
    `recall`, measured on at most MEASURED of the texts; each is followed by another text where edits have shortened it."""
    some = [t for t in texts if int(rate * len(t))]
    some = some[:: max(1, -(-len(some) // MEASURED))]
    if not some:
        return 1
    rng = np.random.default_rng(5)
    copies = [(edited(t, int(rate * len(t)), rng) + u[::-1] + t)[: len(t)] for t, u in zip(some, some[1:] + some[:1])]
    as_bytes = lambda ts: [np.frombuffer(t, dtype=np.uint8) for t in ts]
    same = Items([], rate, sampled, walks, 1, 0).agreement(as_bytes(some), as_bytes(copies))
    parted = np.log1p(-np.minimum(same, 1 - 1e-9) ** sampled).sum(axis=0)
    for times in range(1, 65):
        if 1 - np.exp(times * parted).mean() >= recall:
            return times
    return 64


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, recall: float = 0.999, walks: int = 32, sampled: int = 6, least_bytes: int = 32, block: int = 10_000) -> DataFrame:
    """(doc_id, item_id, start, end, distance) of every document that holds a passage within rate * length edits of a
    benchmark item: its nearest passage for each item, as byte positions in the normal form.

    Items are the query set: they are taken in blocks of about `block` items (sent to the tasks, bounded by that number),
    each against all documents. Null and empty texts and rows without id match nothing; items under least_bytes in normal form
    match where they stand unchanged as whole words (an edit would make many of them another word). Equal items match alike;
    repeated rows give repeated results once.
    """
    spark = docs.sparkSession
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    blocks = max(1, math.ceil(items.count() / block))
    wanted = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = []
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k) if blocks > 1 else items
        rows: dict[bytes, list[int]] = {}
        for r in own.toLocalIterator():
            form = b" ".join(r["text"].encode().lower().split())
            if form:
                rows.setdefault(form, []).append(r["item_id"])
        texts = sorted(rows)
        ids = [sorted(set(rows[t])) for t in texts]
        times = repetitions([t for t in texts if len(t) >= least_bytes], rate, recall, sampled, walks)
        sent = spark.sparkContext.broadcast((texts, ids))
        parts.append(_search(wanted, sent, (rate, sampled, walks, times, least_bytes)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def _search(docs: DataFrame, sent, limits) -> DataFrame:
    def run(batches):
        texts, ids = sent.value
        items = Items(list(enumerate(texts)), *limits) if texts else None
        for batch in batches:
            if items is None:
                continue
            doc_ids = batch.column("doc_id")
            for a, b, buf, offs in pieces(batch.column("text"), 1 << 23):
                low, at, _ = normal(buf, offs)
                got = [(a + d, i, s, e, x) for d, k, s, e, x in items.matches(low, at) for i in ids[k]]
                if got:
                    d, i, s, e, x = (pa.array(c, pa.int64()) for c in zip(*got))
                    yield pa.RecordBatch.from_arrays([doc_ids.take(d), i, s, e, x], ["doc_id", "item_id", "start", "end", "distance"])

    return docs.mapInArrow(run, "doc_id long, item_id long, `start` long, `end` long, distance long")
