"""Language-model scoring by logistic context mixing.

A text is a sequence of lower-cased words and one end. A word is coded bit by bit: its bytes and a closing blank under a
Huffman code of the corpus, the end as one symbol of its own. Each bit is predicted from contexts inside the word (one, two,
three and five bytes, the whole prefix, the whole prefix with what the word before ended in); their log-odds are mixed by weights
that a gate picks (how much the two longest contexts know), and the outcome is refined by an adaptive map from log-odds to
observed frequencies. Frequent words have a probability as wholes beside that of their spelling. Weights are learned online, word by word, on counts without the word's own occurrence. Inside a document
the mixture adapts to what the document has said already: words seen before share a weight that follows the rate of repeats so far.

The corpus is gathered as a table of words with counts, sorted and kept in chunks of pairs (word, kind of the word before). A context with
the symbol that follows it is an arc, told apart by 56 bits of a hash and the symbol. Arcs of all chunks are counted exactly by a shuffle,
summed per chunk before it, and every chunk gets back the bit counts of its own arcs; contexts that only one chunk can have never move. Inside a chunk, bytes of
different words that agree in all before them are worked on once.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import _groups, cut, drop, remainder, tasks
from skyledger.llm.words import LOWER, mix, pieces, span_hashes, word_spans

END = b"\n"
ORDERS = (1, 2, 3, 5)
CONTEXTS = len(ORDERS) + 2
CLASSES = 4
GATES = 9
STEPS = 33
_A = 0.4
_SALT = np.random.default_rng(9).integers(1, 1 << 62, CONTEXTS, dtype=np.uint64)
#: Counts are kept as eighths of a binary logarithm: small ones exactly, all in a byte.
_COUNT = np.rint(2.0 ** (np.arange(256) / 8) - 1)
_LOG = np.log(_COUNT + _A).astype(np.float32)
_LOG_LESS = np.log(np.maximum(_COUNT - 1, 0) + _A).astype(np.float32)
_END_HASH = span_hashes(np.frombuffer(END, dtype=np.uint8), np.array([0]), np.array([1]))[0]


def last_class(last: np.ndarray) -> np.ndarray:
    """What a word ended in: 1 end of sentence, 2 other mark, 3 anything else (0 stands for the start of a text)."""
    stop = np.isin(last, np.frombuffer(b".!?", dtype=np.uint8))
    letter = ((last >= 97) & (last <= 122)) | (last >= 128) | ((last >= 48) & (last <= 57))
    return np.where(stop, 1, np.where(letter, 3, 2))


def tokens(buf: np.ndarray, offs: np.ndarray):
    """Hashes, starts, ends, class of the word before, and the index of each document's first token (one more at the end). A document's last token is its end."""
    s, e, first = word_spans(buf, offs)
    low = LOWER[buf]
    n, docs = len(s), len(offs) - 1
    at = np.arange(n) + np.repeat(np.arange(docs), np.diff(first))
    total = n + docs
    h = np.full(total, _END_HASH, dtype=np.uint64)
    start, end = np.full(total, -1, dtype=np.int64), np.full(total, -1, dtype=np.int64)
    h[at], start[at], end[at] = span_hashes(low, s, e), s, e
    begin = first + np.arange(docs + 1)
    kind = np.zeros(total, dtype=np.int64)
    after = at + 1
    kind[after] = last_class(low[e - 1]) if n else 0
    return low, h, start, end, kind, begin


class Code:
    """A Huffman code of the 256 byte values: for each symbol the tree nodes passed and the bits taken."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(c) + 1, i, (i,)) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        steps: list[list[tuple[int, int]]] = [[] for _ in range(256)]
        node = 256
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            for bit, side in ((0, x), (1, y)):
                for symbol in side:
                    steps[symbol].append((node - 256, bit))
            heapq.heappush(heap, (a + b, node, x + y))
            node += 1
        self.size = np.array([len(s) for s in steps])
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.node = np.array([n for s in steps for n, _ in reversed(s)], dtype=np.uint64)
        self.bit = np.array([b for s in steps for _, b in reversed(s)], dtype=np.int64)

    def expand(self, symbols: np.ndarray):
        """For every bit of the symbols: its symbol's index, its entry in the code, its place within the symbol."""
        count = self.size[symbols]
        at = np.repeat(np.arange(len(symbols)), count)
        inner = np.arange(len(at)) - (np.cumsum(count) - count)[at]
        return at, self.start[symbols][at] + inner, inner


def contexts(words: list[bytes], kinds: np.ndarray):
    """Bytes of the words with their closing blanks, hashed contexts of every byte (a row a context), and the word of every byte."""
    body = b"".join([w if w == END else w + b" " for w in words])
    size = np.array([1 if w == END else len(w) + 1 for w in words], dtype=np.int64)
    text = np.frombuffer(body, dtype=np.uint8)
    n = len(text)
    begin = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    inside = np.arange(n) - begin[word]
    hashed = np.empty((CONTEXTS, n), dtype=np.uint64)
    with np.errstate(over="ignore"):
        recent = np.zeros(n, dtype=np.uint64)
        for k in range(1, 6):
            past = np.zeros(n, dtype=np.uint64)
            past[k:] = text[:-k]
            recent |= np.where(inside >= k, past + np.uint64(1), np.uint64(0)) << np.uint64(9 * (k - 1))
            if k in ORDERS:
                hashed[ORDERS.index(k)] = mix(recent + _SALT[ORDERS.index(k)])
        # A word's prefix: running sums from its start, in parts so that powers stay few. Factors start at mix(1), as mix(0) is 0.
        step = 1 << 20
        sums = np.zeros(n + 1, dtype=np.uint64)
        for a in range(0, n, step):
            part = np.cumsum((text[a : a + step].astype(np.uint64) + np.uint64(1)) * mix(inside[a : a + step].astype(np.uint64) + np.uint64(1)))
            sums[a + 1 : a + 1 + len(part)] = part + sums[a]
        prefix = sums[:-1] - sums[begin[word]]
        hashed[-2] = mix(prefix + _SALT[-2])
        hashed[-1] = mix(prefix * np.uint64(0xD6E8FEB86659FD93) + _SALT[-1] + kinds[word].astype(np.uint64))
    return text, hashed, word


def events(code: Code, words: list[bytes], kinds: np.ndarray, bits: int):
    """Places in hashed tables of 2^bits (a row a context), bits, and the word of every bit of the words."""
    text, hashed, word = contexts(words, kinds)
    at, entry, _ = code.expand(text)
    with np.errstate(over="ignore"):
        node = code.node[entry] * np.uint64(0x9E3779B97F4A7C15)
        place = np.empty((CONTEXTS, len(at)), dtype=np.int64)
        for c in range(CONTEXTS):
            place[c] = ((hashed[c][at] ^ node) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).view(np.int64)
    return place, code.bit[entry], word[at]


def log_odds(zero: np.ndarray, one: np.ndarray, bit: np.ndarray | None) -> np.ndarray:
    """Of a one, from levels; with `bit`, without one own occurrence."""
    if bit is None:
        return _LOG[one] - _LOG[zero]
    return np.where(bit == 1, _LOG_LESS[one], _LOG[one]) - np.where(bit == 0, _LOG_LESS[zero], _LOG[zero])


def gated(known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of the contexts with the constant beside them, and the gate."""
    odds = np.ones((len(known), CONTEXTS + 1), dtype=np.float32)
    odds[:, :-1] = known
    level = lambda x: (np.abs(x) > 0.3).astype(np.int64) + (np.abs(x) > 2.5)
    return odds, 3 * level(known[:, CONTEXTS - 2]) + level(known[:, 3])


class Mixer:
    def __init__(self, code: Code, bits: int, tables: np.ndarray):
        self.code, self.bits, self.tables = code, bits, tables
        self.weights = np.full((GATES, CONTEXTS + 1), 0.3, dtype=np.float32)
        self.weights[:, -1] = 0
        self.refined = None

    def inputs(self, place: np.ndarray, bit: np.ndarray | None):
        """Log-odds of each context, and the gate; with `bit`, without one own occurrence."""
        odds = np.stack([log_odds(*self.tables[c][:, place[c]], bit) for c in range(CONTEXTS)], axis=1)
        return gated(odds)

    def logit(self, odds: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("ij,ij->i", odds, self.weights[gate]), -12, 12)

    def learn(self, odds, gate, bit, weight, rate: float) -> None:
        order = np.argsort(gate.astype(np.uint8), kind="stable")
        odds, bit, weight = odds[order], bit[order], weight[order]
        cuts = np.searchsorted(gate[order], np.arange(GATES + 1))
        for own, a, b in zip(self.weights, cuts[:-1], cuts[1:]):
            total = weight[a:b].sum()
            if total > 0:
                error = (bit[a:b] - 1 / (1 + np.exp(-np.clip(odds[a:b] @ own, -12, 12)))) * weight[a:b]
                own += rate * (error @ odds[a:b]) / total

    def refine(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Probability of a one: the mixture's, and with three times its weight the frequency observed at such log-odds."""
        p = 1 / (1 + np.exp(-x))
        if self.refined is None:
            return p
        at = np.clip((x + 8) * 2, 0, STEPS - 1.001)
        low = at.astype(np.int64)
        part = at - low
        seen = self.refined[gate, low] * (1 - part) + self.refined[gate, low + 1] * part
        return np.clip(0.25 * p + 0.75 * seen, 1e-6, 1 - 1e-6)


def _runs(words: list[bytes], room: int, most: int = 1 << 18):
    """Stretches of at most `room` words and about `most` bytes."""
    a, held = 0, 0
    for i, w in enumerate(words):
        if i > a and (i - a >= room or held + len(w) > most):
            yield a, i
            a, held = i, 0
        held += len(w)
    if words:
        yield a, len(words)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (bytes; the end is a line break), n0..n3: how often it follows each kind of word in rows marked `train`, m0..m3: in all rows. A null text has only its end."""
    names = [f"{a}{k}" for a in "nm" for k in range(CLASSES)]

    def run(batches):
        for batch in batches:
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            for x, y, buf, offs in pieces(batch.column("text"), 1 << 22):
                low, h, s, e, kind, begin = tokens(buf, offs)
                keys, first, at = np.unique(h, return_index=True, return_inverse=True)
                taken = np.repeat(train[x:y], np.diff(begin))
                m = np.bincount(at * CLASSES + kind, minlength=len(keys) * CLASSES).reshape(-1, CLASSES)
                n = np.bincount((at * CLASSES + kind)[taken], minlength=len(keys) * CLASSES).reshape(-1, CLASSES)
                raw = low.tobytes()
                words = [raw[a:b] if a >= 0 else END for a, b in zip(s[first].tolist(), e[first].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *(pa.array(t[:, k]) for t in (n, m) for k in range(CLASSES))], ["word", *names])

    found = docs.select(F.col("text").cast("string"), "train").mapInArrow(run, "word binary, " + ", ".join(f"{n} long" for n in names))
    return found.groupBy("word").agg(*[F.sum(n).alias(n) for n in names])


_CHUNK = "chunk long, words binary, kinds binary, n binary, c binary, m binary, v long"


def chunked(words: DataFrame, room: int) -> DataFrame:
    """The sorted word table as rows of at most `room` pairs: words joined by blanks, kinds, n and m (the pair's counts), c (the word's training count); v: training words that begin here."""

    def run(batches):
        held: list[bytes] = []
        parts: list[np.ndarray] = []
        given = 0

        def row(words, kind, n, c, m, lead):
            nonlocal given
            given += 1
            cells = [(TaskContext.get().partitionId() << 32) + given, b" ".join(words), kind.astype(np.uint8).tobytes(), n.tobytes(), c.tobytes(), m.tobytes(), int((lead & (c > 0)).sum())]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in cells], [f.split()[0] for f in _CHUNK.split(", ")])

        for batch in batches:
            n, m = (np.stack([batch.column(f"{a}{k}").to_numpy() for k in range(CLASSES)], axis=1) for a in "nm")
            at, kind = np.nonzero(m)
            names = batch.column("word").to_pylist()
            held += [names[i] for i in at]
            parts.append(np.stack([kind, n[at, kind], n.sum(axis=1)[at], m[at, kind], np.diff(at, prepend=-1) > 0]))
            whole = np.concatenate(parts, axis=1)
            last = 0
            for a, b in _runs(held, room):
                if b < len(held):
                    yield row(held[a:b], *whole[:, a:b])
                    last = b
            held, parts = held[last:], [whole[:, last:]]
        if held:
            yield row(held, *np.concatenate(parts, axis=1))

    return words.repartitionByRange(tasks(words), "word").sortWithinPartitions("word").mapInArrow(run, _CHUNK)


class Chunk:
    """The pairs of a row of `chunked`, the sorted arcs that they go through and, for every byte, which of them.

    Pairs that begin alike after the same kind go through the same arcs as far as they agree: such bytes are one node, which is worked on once.
    """

    def __init__(self, row: dict):
        self.words = row["words"].split(b" ")
        self.kinds = np.frombuffer(row["kinds"], dtype=np.uint8).astype(np.int64)
        self.n, self.c, self.m = (np.frombuffer(row[k], dtype=np.int64) for k in "ncm")
        self.text, hashed, self.word = contexts(self.words, self.kinds)
        self.node, self.first = _nodes(self.text, self.word, self.kinds)
        self.symbol = self.text[self.first]
        hashed = hashed[:, self.first]
        self.prefix = hashed[-2]
        arcs, at = np.unique(((hashed & ~np.uint64(255)) | self.symbol).view(np.int64), return_inverse=True)
        self.arcs, self.at = arcs, at.reshape(CONTEXTS, -1)
        self.levels = self._starts = None

    def weights(self) -> np.ndarray:
        """Training words that go through each node."""
        return np.bincount(self.node, self.n[self.word].astype(float), minlength=len(self.first))

    def counts(self) -> np.ndarray:
        """How often the chunk's training words go through each arc."""
        return np.bincount(self.at.ravel(), np.tile(self.weights(), CONTEXTS), minlength=len(self.arcs))

    def open(self) -> np.ndarray:
        """Arcs that other chunks may have too: all but those of prefixes that lie wholly inside the sorted chunk, which the prefixes of its first and last word alone leave."""
        edge = np.isin(self.prefix, self.prefix[self.node[(self.word == 0) | (self.word == len(self.words) - 1)]])
        out = np.zeros(len(self.arcs), dtype=bool)
        out[self.at[:-2].ravel()] = True
        out[self.at[-2:, edge].ravel()] = True
        return out

    def put(self, code: Code, arcs: np.ndarray, levels: np.ndarray) -> None:
        """The bit counts of all arcs: of some those of all chunks, which are given, of the rest the chunk's own."""
        given = np.searchsorted(self.arcs, arcs)
        own = np.ones(len(self.arcs), dtype=bool)
        own[given] = False
        size = code.size[self.arcs & 255]
        start = np.cumsum(size) - size
        self.levels = np.empty((2, int(size.sum())), dtype=np.uint8)
        for some, those in ((given, levels), (np.flatnonzero(own), _levels(code, self.arcs[own], self.counts()[own]))):
            at, _, inner = code.expand(self.arcs[some] & 255)
            self.levels[:, start[some][at] + inner] = those.T

    def bits(self, code: Code, some: np.ndarray):
        """Places in the levels (a row a context), bits, and the pair of every bit of some bytes."""
        place, bit, at = self.node_bits(code, self.node[some])
        return place.T, bit, self.word[some][at]

    def node_bits(self, code: Code, some: np.ndarray):
        """Places in the levels (a column a context), bits, and the place in `some` of every bit of some nodes."""
        at, entry, inner = code.expand(self.symbol[some])
        return self.starts(code)[some][at] + inner[:, None], code.bit[entry], at

    def starts(self, code: Code) -> np.ndarray:
        """The first place of a node's arcs in the levels, a column a context."""
        if self._starts is None:
            size = code.size[self.arcs & 255]
            self._starts = np.ascontiguousarray((np.cumsum(size) - size)[self.at].T)
        return self._starts

    def odds(self, code: Code, less: bool) -> np.ndarray:
        """Log-odds at every place in the levels; with `less`, without one occurrence of the arc itself."""
        return log_odds(*self.levels, code.bit[code.expand(self.arcs & 255)[1]] if less else None)


def _nodes(text: np.ndarray, word: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The node of every byte, and the first byte of every node. Pairs are sorted by word, so those that begin alike follow each other among those of their kind."""
    begin = np.flatnonzero(np.diff(word, prepend=-1))
    size = np.diff(begin, append=len(text))
    before = np.full(len(kinds), -1, dtype=np.int64)
    for k in range(CLASSES):
        own = np.flatnonzero(kinds == k)
        before[own[1:]] = own[:-1]
    inside = np.arange(len(text)) - begin[word]
    past = before[word]
    alike = (past >= 0) & (inside < size[past])
    alike &= text[np.where(alike, begin[past] + inside, 0)] == text
    unlike = np.cumsum(~alike)
    alike &= unlike == (unlike - ~alike)[begin][word]
    rank = inside * CLASSES + kinds[word]
    order = np.argsort(rank.astype(np.uint16) if rank.max(initial=0) < 1 << 16 else rank, kind="stable")
    new = ~alike[order]
    node = np.empty(len(text), dtype=np.int64)
    node[order] = np.cumsum(new) - 1
    return node, order[new]


def _levels(code: Code, arcs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of zeros and ones, as levels, at every bit of sorted different arcs; all arcs of a context are given."""
    new = np.append(np.diff(arcs >> 8) != 0, True)
    alone = new & np.append(True, new[:-1])
    at, entry, _ = code.expand(arcs & 255)
    bit = code.bit[entry]
    out = np.zeros((len(at), 2), dtype=np.uint8)
    out[np.arange(len(at)), bit] = _level(counts)[at]
    # Where a context has several arcs, their bits meet at the nodes of the code.
    many = np.flatnonzero(~alone[at])
    at, bit = at[many], bit[many]
    context = np.cumsum(new) - new
    _, node = np.unique((context[at] << 8) | code.node[entry[many]].view(np.int64), return_inverse=True)
    sums = np.bincount(2 * node + bit, counts[at], minlength=2 * (node.max(initial=-1) + 1))
    out[many] = _level(sums).reshape(-1, 2)[node]
    return out


def _level(counts: np.ndarray) -> np.ndarray:
    return np.rint(8 * np.log2(counts + 1)).clip(0, 255).astype(np.uint8)


def _histogram(chunks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the training words by byte value, and training tokens by kind."""

    def run(batches):
        total, kinds = np.zeros(256), np.zeros(CLASSES)
        for batch in batches:
            for row in batch.to_pylist():
                n = np.frombuffer(row["n"], dtype=np.int64).astype(float)
                raw = [w if w == END else w + b" " for w in row["words"].split(b" ")]
                total += np.bincount(np.frombuffer(b"".join(raw), dtype=np.uint8), np.repeat(n, [len(w) for w in raw]), minlength=256)
                kinds += np.bincount(np.frombuffer(row["kinds"], dtype=np.uint8), n, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(range(256 + CLASSES), pa.int32()), pa.array(np.concatenate([total, kinds]))], ["b", "n"])

    out = np.zeros(256 + CLASSES)
    for r in chunks.select("words", "kinds", "n").mapInArrow(run, "b int, n double").groupBy("b").agg(F.sum("n").alias("n")).collect():
        out[r["b"]] = r["n"]
    return out[:256], out[256:]


def _replies(chunks: DataFrame, code: Code, most: int = 1 << 19) -> DataFrame:
    """chunk, arcs, levels: the bit counts, over all chunks, of a chunk's arcs whose context other chunks have too."""

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = Chunk(row)
                sent = own.open()
                arcs = own.arcs[sent]
                yield pa.RecordBatch.from_arrays([pa.array(arcs), pa.array(np.full(len(arcs), row["chunk"])), pa.array(own.counts()[sent].astype(np.int64))], ["arc", "chunk", "n"])

    def give(arc, chunk, n):
        key = arc >> 8
        first = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        shared = np.minimum.reduceat(chunk, first) != np.maximum.reduceat(chunk, first)
        kept = np.repeat(shared, np.diff(np.append(first, len(key))))
        if not kept.any():
            return
        arc, chunk, n = arc[kept], chunk[kept], n[kept]
        arcs, at = np.unique(arc, return_inverse=True)
        levels = _levels(code, arcs, np.bincount(at, n.astype(float)))
        size = code.size[arcs & 255]
        start = np.cumsum(size) - size
        order = np.argsort(chunk, kind="stable")
        cuts = np.flatnonzero(np.diff(chunk[order], prepend=chunk[order[0]] - 1, append=chunk[order[-1]] + 1))
        out = {"chunk": [], "arcs": [], "levels": []}
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = order[a:b]
            bit, _, inner = code.expand(arc[own] & 255)
            out["chunk"].append(int(chunk[own[0]]))
            out["arcs"].append(arc[own].tobytes())
            out["levels"].append(levels[start[at[own]][bit] + inner].tobytes())
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("chunk", pa.int64()), ("arcs", pa.binary()), ("levels", pa.binary())]))

    def total(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy() for k in ("arc", "chunk", "n")]))
            rows += batch.num_rows
            if rows >= most:
                whole = np.concatenate(held, axis=1)
                last = int(np.searchsorted(whole[0] >> 8, whole[0, -1] >> 8))
                if last:
                    yield from give(*whole[:, :last])
                held, rows = [whole[:, last:]], whole.shape[1] - last
        if rows:
            yield from give(*np.concatenate(held, axis=1))

    asked = chunks.mapInArrow(ask, "arc long, chunk long, n long")
    return asked.repartition(tasks(chunks), F.shiftright("arc", 8)).sortWithinPartitions("arc").mapInArrow(total, "chunk long, arcs binary, levels binary")


def learn(chunks: DataFrame, code: Code, rate: float = 0.3, block: int = 1 << 14) -> tuple[DataFrame, Mixer]:
    """The chunks with the bit counts of their arcs, and the mixer: weights by online steps (each task over its chunks; averaged by weight over chunks), then the refining map."""
    spark = chunks.sparkSession

    def online(batches):
        own = Mixer(code, 0, None)
        sums, seen = np.zeros(own.weights.shape), 0.0
        for group in _groups(batches, ["chunk"]):
            listed = group.to_pylist()
            row = next(r for r in listed if r["words"] is not None)
            chunk = Chunk(row)
            given = [r for r in listed if r["arcs"] is not None]
            arcs, levels = (b"".join(r[k] for r in given) for k in ("arcs", "levels"))
            chunk.put(code, np.frombuffer(arcs, dtype=np.int64), np.frombuffer(levels, dtype=np.uint8).reshape(-1, 2))
            known = chunk.odds(code, less=True)
            # Words are sorted: steps take their bytes in a mixed order.
            some = np.random.default_rng(row["chunk"] & 0xFFFFFFFF).permutation(np.flatnonzero(chunk.n[chunk.word] > 0))
            new = 0.0
            for i in range(0, len(some), block):
                place, bit, at = chunk.node_bits(code, chunk.node[some[i : i + block]])
                odds, gate = gated(known[place])
                # Frequent words would drown the rest; the square root keeps them apart and in proportion to their noise.
                w = np.sqrt(chunk.n[chunk.word[some[i : i + block]]])[at]
                for j in range(0, len(bit), 8192):
                    own.learn(odds[j : j + 8192], gate[j : j + 8192], bit[j : j + 8192], w[j : j + 8192], rate)
                new += w.sum()
            sums, seen = sums + new * own.weights, seen + new
            yield pa.RecordBatch.from_pylist([{**{k: row[k] for k in fields[:-3]}, "levels": chunk.levels.tobytes()}], schema=shape)
        yield pa.RecordBatch.from_pylist([{"w": sums.tobytes(), "seen": seen}], schema=shape)

    schema = _CHUNK.replace(", v long", "") + ", levels binary, w binary, seen double"
    fields = [f.split()[0] for f in schema.split(", ")]
    shape = pa.schema([(f.split()[0], {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}[f.split()[1]]) for f in schema.split(", ")])
    asked = _replies(chunks, code)
    none = F.lit(None).cast("binary")
    both = chunks.drop("v").withColumns({"arcs": none, "levels": none}).unionByName(asked, allowMissingColumns=True)
    counted = cut(both.repartition(tasks(chunks), "chunk").sortWithinPartitions("chunk").mapInArrow(online, schema), "counted")
    mixer = Mixer(code, 0, None)
    got = counted.where(F.col("chunk").isNull()).select("w", "seen").collect()
    total = sum(r["seen"] for r in got)
    if total > 0:
        mixer.weights = (sum(np.frombuffer(r["w"]) for r in got) / total).reshape(GATES, -1).astype(np.float32)
    sent = spark.sparkContext.broadcast(mixer)

    def observe(batches):
        own = sent.value
        counts = np.zeros((2, GATES, STEPS))
        for batch in batches:
            for chunk in counted_chunks(batch):
                weights, known = chunk.weights(), chunk.odds(code, less=True)
                some = np.flatnonzero(weights > 0)
                for i in range(0, len(some), block):
                    place, bit, at = chunk.node_bits(code, some[i : i + block])
                    w = weights[some[i : i + block]][at]
                    odds, gate = gated(known[place])
                    x = np.clip((own.logit(odds, gate) + 8) * 2, 0, STEPS - 1.001)
                    low = x.astype(np.int64)
                    for step, share in ((low, 1 - (x - low)), (low + 1, x - low)):
                        counts += np.bincount((bit * GATES + gate) * STEPS + step, w * share, minlength=counts.size).reshape(counts.shape)
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], ["c"])

    table = counted.where(F.col("chunk").isNotNull()).drop("w", "seen")
    counts = sum((np.frombuffer(r["c"]) for r in table.mapInArrow(observe, "c binary").collect()), np.zeros(2 * GATES * STEPS)).reshape(2, GATES, STEPS)
    middle = 1 / (1 + np.exp(-(np.arange(STEPS) / 2 - 8)))
    mixer.refined = (counts[1] + 2 * middle) / (counts.sum(axis=0) + 2)
    sent.unpersist()
    table._scratch = counted._scratch
    return table, mixer


def counted_chunks(batch):
    for i in range(batch.num_rows):
        row = batch.slice(i, 1).to_pylist()[0]
        chunk = Chunk(row)
        chunk.levels = np.frombuffer(row["levels"], dtype=np.uint8).reshape(2, -1)
        yield chunk


def spelled(chunks: DataFrame, mixer: Mixer, block: int = 1 << 14) -> DataFrame:
    """pair (hash), kind, n, c, m, and log10 of the probability of the spelling: `spelling`, and `less` without the pair's own occurrence."""
    names = ["pair", "kind", "n", "c", "m", "spelling", "less"]

    def run(batches):
        for batch in batches:
            for chunk in counted_chunks(batch):
                known = [chunk.odds(mixer.code, less) for less in (False, True)]
                nodes = np.zeros((2, len(chunk.first)))
                for i in range(0, len(chunk.first), block):
                    place, bit, at = chunk.node_bits(mixer.code, np.arange(i, min(i + block, len(chunk.first))))
                    for out, own in zip(nodes, known):
                        odds, gate = gated(own[place])
                        p = mixer.refine(mixer.logit(odds, gate), gate)
                        out[i : i + block] = np.bincount(at, np.log10(np.where(bit == 1, p, 1 - p)))
                logs = [np.bincount(chunk.word, x[chunk.node], minlength=len(chunk.words)) for x in nodes]
                size = np.array([len(w) for w in chunk.words], dtype=np.int64)
                stop = np.cumsum(size)
                h = span_hashes(np.frombuffer(b"".join(chunk.words), dtype=np.uint8), stop - size, stop)
                cells = [_pair(h, chunk.kinds), chunk.kinds, chunk.n, chunk.c, chunk.m, *logs]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cells], names)

    return chunks.mapInArrow(run, "pair long, kind long, n long, c long, m long, spelling double, less double")


def _pair(h: np.ndarray, kind: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h + kind.astype(np.uint64)).view(np.int64)


def whole_words(pairs: DataFrame, totals: np.ndarray, back: float = 2000.0, points: int = 32, rounds: int = 4) -> tuple[float, DataFrame]:
    """Words as wholes beside their spelling: the share of whole words, and pairs with `log`, log10 of the two together.

    A word's own probability is its frequency after its kind, drawn towards its frequency at large. The share makes the
    training tokens likeliest, each without its own occurrence: the slope of their log-likelihood falls with the share, and its
    zero is closed in on by `rounds` passes, each with sums at `points` shares.
    """
    n = float(totals.sum())
    if not n:
        return 0.0, pairs.withColumn("log", F.col("spelling"))
    kinds = F.element_at(F.array(*[F.lit(float(t)) for t in totals]), (F.col("kind") + 1).cast("int"))
    whole = lambda less: (F.greatest(F.col("n") - less, F.lit(0)) + back * F.greatest(F.col("c") - less, F.lit(0)) / n) / (kinds + back)
    spelling = lambda name: F.pow(F.lit(10.0), F.greatest(F.col(name), F.lit(-300.0)))
    fit = pairs.where("n > 0").select("n", whole(1).alias("w"), spelling("less").alias("s"))
    low, high = 0.0, 0.999
    for _ in range(rounds):
        shares = np.linspace(low, high, points + 1)
        slopes = fit.agg(*[F.sum(F.col("n") * (F.col("w") - F.col("s")) / (x * F.col("w") + (1 - x) * F.col("s"))).alias(f"x{i}") for i, x in enumerate(shares.tolist())]).first()
        up = sum(v > 0 for v in slopes)
        low, high = shares[max(up - 1, 0)], shares[min(up, points)]
    share = float(low + high) / 2
    both = share * whole(0)
    return share, pairs.withColumn("log", F.when(both > 0, F.log10(both + (1 - share) * F.pow(F.lit(10.0), F.col("spelling")))).otherwise(F.col("spelling") + math.log10(1 - share)))


def _said(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the document has said before each token: the weight left to the model, and the cache's part over that weight.

    A word said k times in t tokens has the cache probability k / t; the cache's weight is the rate of repeated words so far. The end is said once, so the cache never gives it.
    """
    left, part = np.empty(len(h)), np.empty(len(h))
    for a, b in zip(begin[:-1], begin[1:]):
        n = b - a
        own = h[a:b]
        order = np.argsort(own, kind="stable")
        ranked = own[order]
        new = np.append(True, ranked[1:] != ranked[:-1])
        place = np.arange(n)
        before = np.empty(n)
        before[order] = place - np.maximum.accumulate(np.where(new, place, 0))
        repeats = np.cumsum(before > 0) - (before > 0)
        share = (repeats + 0.2) / (place + 4.0)
        share[0] = 0
        left[a:b] = 1 - share
        part[a:b] = share * before / np.maximum(place, 1) / (1 - share)
    return left, part


def score(docs: DataFrame, folds: int = 7, held: int = 2, frequent: int = 100_000, room: int = 16384) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Learned from all rows outside the held-out fold; rows without doc_id are scored, not learned from, and not held out. A null
    text is empty: one token, the end. Pairs of a word and the kind before it that are met most often, at most `frequent`, go to every task;
    the rest meet their probabilities by a join, with the same result. `room` pairs are worked on at a time.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string").alias("text")
    train = F.coalesce(remainder("doc_id", folds) != held, F.lit(False)).alias("train")
    chunks = cut(chunked(word_counts(docs.select(text, train)), room), "chunks")
    symbols, totals = _histogram(chunks)
    total, kinds = int(totals.sum()), chunks.agg(F.sum("v")).first()[0] or 0
    counted, mixer = learn(chunks, Code(symbols))
    pairs = cut(spelled(counted, mixer), "pairs")
    drop(chunks, counted)
    share, pairs = whole_words(pairs, totals)

    # The least count whose pairs are few enough, from the number of pairs by binary logarithm of their counts.
    bins = {r["k"]: r["m"] for r in pairs.groupBy(F.floor(F.log2("m")).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("m")).collect()}
    least, held_rows = 1 << 62, 0
    for k in sorted(bins, reverse=True):
        if held_rows + bins[k] > frequent:
            break
        held_rows += bins[k]
        least = 1 << k
    top = pairs.where(F.col("m") >= least).select("pair", "c", "log").toArrow()
    keys = top["pair"].to_numpy()
    order = np.argsort(keys)
    sent = spark.sparkContext.broadcast((keys[order], top["c"].to_numpy()[order], top["log"].to_numpy()[order]))

    def run(batches):
        keys, counts, logs = sent.value
        for batch in batches:
            for x, y, buf, offs in pieces(batch.column("text"), 1 << 21):
                _, h, _, _, kind, begin = tokens(buf, offs)
                pair = _pair(h, kind)
                at = np.searchsorted(keys, pair)
                at[at == len(keys)] = 0
                here = keys[at] == pair if len(keys) else np.zeros(len(h), dtype=bool)
                left, part = _said(h, begin)
                value, base, known = np.log10(left), np.zeros(len(h)), np.zeros(len(h), dtype=np.int64)
                own = at[here]
                with np.errstate(divide="ignore"):
                    value[here] += np.logaddexp(logs[own] * math.log(10), np.log(part[here])) / math.log(10)
                base[here], known[here] = np.log10(counts[own] + 1.0), counts[own] > 0
                per = lambda v: pa.array(np.add.reduceat(v, begin[:-1]))
                rest = np.flatnonzero(~here)
                offsets = pa.array(np.searchsorted(rest, begin).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").slice(x, y - x), batch.column("doc_id").slice(x, y - x), pa.array(np.diff(begin)), per(known), per(base), per(value),
                        pa.ListArray.from_arrays(offsets, pa.array(pair[rest])), pa.ListArray.from_arrays(offsets, pa.array(part[rest])),
                    ],
                    ["row", "doc_id", "n_tokens", "n_top", "base_top", "score_top", "rare", "part"],
                )

    # Row numbers hold because the table is written before it is used.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text)
    scored = cut(rows.mapInArrow(run, "row long, doc_id long, n_tokens long, n_top long, base_top double, score_top double, rare array<long>, part array<double>"), "scored")

    light = pairs.where(F.col("m") < least).select("pair", "c", "log")
    asked = scored.select("row", F.explode(F.arrays_zip("rare", "part")).alias("w")).select("row", F.col("w.rare").alias("pair"), F.col("w.part").alias("part"))
    value = F.when(F.col("part") > 0, F.log10(F.col("part") + F.pow(F.lit(10.0), F.col("log")))).otherwise(F.col("log"))
    met = asked.join(light, "pair").groupBy("row").agg(F.sum((F.col("c") > 0).cast("long")).alias("n_rare"), F.sum(F.log10(F.col("c") + 1.0)).alias("base_rare"), F.sum(value).alias("score_rare"))
    out = scored.drop("rare", "part").join(met, "row", "left")
    return out.select(
        "doc_id", F.coalesce(remainder("doc_id", folds) == held, F.lit(False)).alias("held_out"), "n_tokens", (F.col("n_top") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_top") + F.coalesce("base_rare", F.lit(0.0)) - F.col("n_tokens") * math.log10(total + kinds + 1)).alias("base_score"), (F.col("score_top") + F.coalesce("score_rare", F.lit(0.0))).alias("score"),
    )
