"""Toxicity by class-conditional Kneser-Ney models.

A bigram model of toxic and one of ordinary texts back off to the class's own words, those to the class's own word
beginnings, and those to distributions that both classes share (in how many different contexts a word was seen, pooled),
so an expression that is rare in both says no more than how it begins. A document's features are log-likelihood ratios divided by length: of the whole text, and of its few most
toxic words and its most toxic stretch, since an insult may stand in a long clean text. A logistic curve, fitted on texts that
the models have not seen (two folds, each scored by the other's model), turns them into a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import cut, remainder
from skyledger.llm.words import LOWER, mix, pieces, span_hashes, word_spans

START = np.uint64(0x51AB7)
#: Bytes of a word's beginning.
STEM = 6
#: A document is also judged by the mean over its most toxic words, so many of them.
MOST = (3, 6)
#: And by its most toxic stretch of so many words.
STRETCHES = (32,)
DISCOUNT = 0.75
#: Taken off the counts of one class: a word met once or twice in a single text says nothing about the class.
CLASS_DISCOUNT = 2.5
#: Pairs that a class must have seen behind a word before they weigh as much as the pairs of both classes.
TRUST = 30_000.0
#: Copies are told by the least hash of so many words, under each of these seeds.
SHINGLE = 5
SEEDS = np.random.default_rng(31).integers(1, 1 << 62, 6, dtype=np.uint64)


def _words(buf: np.ndarray, offs: np.ndarray):
    """Hashes of the words and of their beginnings, and the index of each document's first word (one more at the end)."""
    s, e, first = word_spans(buf, offs)
    low = LOWER[buf]
    return span_hashes(low, s, e), span_hashes(low, s, np.minimum(e, s + STEM)), first


def _pairs(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The word before each word, START at the beginning of a document."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[first[:-1][first[:-1] < len(words)]] = START
    return before


def _pair_key(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(before * np.uint64(0x9E3779B97F4A7C15) + words)


class Pair:
    """Log-likelihood ratios of toxic against ordinary, from rows (before, word, stem, toxic, n)."""

    def __init__(self, before, word, stem, toxic, n):
        key = _pair_key(before, word)
        self.keys, at = np.unique(key, return_inverse=True)
        pair = np.zeros((2, len(self.keys)))
        np.add.at(pair, (toxic, at), n)
        one = np.zeros(len(self.keys), dtype=np.uint64)
        two = np.zeros(len(self.keys), dtype=np.uint64)
        one[at], two[at] = before, word
        self.words, wi = np.unique(two, return_inverse=True)
        self.starts, bi = np.unique(one, return_inverse=True)
        contexts = np.bincount(wi, minlength=len(self.words)).astype(float)
        kinds = len(self.words)
        total = max(contexts.sum(), 1.0)
        shared = (np.maximum(contexts - DISCOUNT, 0) + DISCOUNT * kinds / (kinds + 1)) / total
        unseen = DISCOUNT * kinds / (kinds + 1) / total if kinds else 1.0
        # Beginnings: the shared mass of the words that begin so, parted by class as far as the class has evidence.
        self.stems, si = np.unique(stem, return_inverse=True)
        of_word = np.zeros(kinds, dtype=np.int64)
        of_word[wi[at]] = si
        mass = np.append(np.bincount(of_word, shared, minlength=len(self.stems)), 1.0)
        begun = []
        for c in (0, 1):
            count = np.bincount(of_word, np.bincount(wi, pair[c], minlength=kinds), minlength=len(self.stems))
            own = np.maximum(count - CLASS_DISCOUNT, 0)
            left = min(1.0, CLASS_DISCOUNT * len(self.stems) / max(pair.sum(), 1.0))
            begun.append(np.append(own * (1 - left) / max(own.sum(), 1e-12) + left * mass[:-1], left * unseen))
        # Both classes leave the same mass to what they back off to, so words that neither has seen speak for neither, however many texts each has.
        pooled, both = pair.sum(axis=0), np.bincount(wi, pair.sum(axis=0), minlength=kinds)
        rest = min(1.0, DISCOUNT * kinds / max(both.sum(), 1.0))
        seen = np.bincount(bi, pooled, minlength=len(self.starts))
        back = DISCOUNT * np.bincount(bi, minlength=len(self.starts)) / np.maximum(seen, 1)
        more = np.maximum(pair - CLASS_DISCOUNT, 0)
        held = [np.bincount(bi, more[c], minlength=len(self.starts)) for c in (0, 1)]
        # Pairs weigh as far as both classes have seen what follows a word; the rest of the mass goes to the class's words.
        least = np.minimum(held[0], held[1])
        firm = (1 - back) * least / (least + TRUST)
        word_level, pair_extra, down = [], [], []
        for c in (0, 1):
            count = np.bincount(wi, pair[c], minlength=kinds)
            own = np.maximum(count - CLASS_DISCOUNT, 0)
            word_level.append(np.append(own * (1 - rest) / max(own.sum(), 1e-12), 0.0))
            down.append(rest * begun[c] / mass)
            pair_extra.append(np.append(firm[bi] * more[c] / np.maximum(held[c][bi], 1e-12), 0.0))
        # Pairs and starts that add nothing answer like those never seen, so only the others are sent to the tasks.
        speaks, known = (pair_extra[0][:-1] > 0) | (pair_extra[1][:-1] > 0), firm > 0
        self.keys, self.starts = self.keys[speaks], self.starts[known]
        self.word_level, self.start_weight = word_level, np.append(1 - firm[known], 1.0)
        self.pair_extra = [np.append(x[:-1][speaks], 0.0) for x in pair_extra]
        self.down, self.shared = down, np.append(shared, unseen)

    @staticmethod
    def _find(keys, wanted):
        """Places in keys; the last place (one past the keys) for what is not there."""
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        return np.where(keys[at] == wanted, at, len(keys)) if len(keys) else np.zeros(len(wanted), dtype=np.int64)

    def ratios(self, before: np.ndarray, words: np.ndarray, stems: np.ndarray) -> np.ndarray:
        wi, bi, pi, si = self._find(self.words, words), self._find(self.starts, before), self._find(self.keys, _pair_key(before, words)), self._find(self.stems, stems)
        p = [self.pair_extra[c][pi] + self.start_weight[bi] * (self.word_level[c][wi] + self.down[c][si] * self.shared[wi]) for c in (0, 1)]
        return np.log(p[1]) - np.log(p[0])

    def features(self, words: np.ndarray, stems: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Length-normalised ratios of each document: of the whole, of its most toxic words, of its most toxic stretch (of all its words when it has fewer)."""
        r = self.ratios(_pairs(words, first), words, stems)
        sums = np.concatenate([[0.0], np.cumsum(r)])
        out = np.zeros((len(first) - 1, 1 + len(MOST) + len(STRETCHES)))
        for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
            if b > a:
                n = min(max(MOST), b - a)
                top = np.sort(np.partition(r[a:b], b - a - n)[b - a - n :])[::-1]
                row = [(sums[b] - sums[a]) / (b - a), *(top[:k].mean() for k in MOST)]
                for k in STRETCHES:
                    k = min(k, b - a)
                    row.append(((sums[a + k : b + 1] - sums[a : b + 1 - k]) / k).max())
                out[i] = row
        return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of a logistic curve over standardised features (Newton steps), with centre and scale. A higher ratio never makes a text less toxic: features that would weigh negatively go."""
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    used = np.ones(x.shape[1], dtype=bool)
    while True:
        a = np.column_stack([(x - centre) / scale * used, np.ones(len(x))])
        w = np.zeros(a.shape[1])
        penalty = ridge * len(x) / 100 * np.eye(len(w))
        penalty[-1, -1] = 1e-9
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (weight * p * (1 - p) + 1e-9)[:, None]).T @ a + penalty, a.T @ (weight * (y - p)) - penalty @ w)
            w = w + np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-6:
                break
        if (w[:-1] >= -1e-9).all():
            return w, centre, scale
        used &= w[:-1] >= -1e-9


def _least_shingles(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The least hash of each document's runs of SHINGLE words under each seed (of all its words when it has fewer; 0 without words)."""
    out = np.zeros((len(SEEDS), len(first) - 1), dtype=np.uint64)
    size = np.diff(first)
    for n in range(1, SHINGLE + 1):
        docs = np.flatnonzero(size >= SHINGLE if n == SHINGLE else size == n)
        if not len(docs):
            continue
        many = size[docs] - n + 1
        begin = np.cumsum(many) - many
        at = np.repeat(first[:-1][docs] - begin, many) + np.arange(many.sum())
        with np.errstate(over="ignore"):
            run = np.zeros(len(at), dtype=np.uint64)
            for k in range(n):
                run = mix(run * np.uint64(0x9E3779B97F4A7C15) + words[at + k])
            for r, seed in enumerate(SEEDS):
                out[r, docs] = np.minimum.reduceat(mix(run + seed), begin)
    return out


def _chosen(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """At most per_class labelled ids of each class, by a hash of the id, of each group of copies about one.

    Of rows of a class with equal least shingles one goes on, under each seed in turn; a near copy is left over only if it differs
    under all of them. The passes carry ids and hashes, and are combined before they are shuffled.
    """
    clean = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    one = clean.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("toxic"))
    names = [f"h{r}" for r in range(len(SEEDS))]

    def run(batches):
        for batch in batches:
            for a, b, buf, offs in pieces(batch.column("text")):
                words, _, first = _words(buf, offs)
                least = _least_shingles(words, first).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *(pa.array(h) for h in least)], ["doc_id", *names])

    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    left = texts.mapInArrow(run, "doc_id long, " + ", ".join(f"{h} long" for h in names)).join(one, "doc_id")
    for h in names:
        rest = [n for n in names if n != h]
        held = F.min(F.struct(F.xxhash64("doc_id").alias("rank"), "doc_id", *rest)).alias("row")
        left = left.groupBy("toxic", h).agg(held).select("toxic", h, "row.doc_id", *(f"row.{n}" for n in rest))
    left = cut(left.select("doc_id", "toxic"), "sample")
    pick = lambda c: left.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    return pick(0).unionByName(pick(1))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 1200):
    """The pair of models and the logistic curve, learned from at most per_class documents of each class, copies left out; None without both classes."""
    spark = docs.sparkSession
    ids = _chosen(docs, labels, label, per_class)
    # At most 2 * per_class ids: their number bounds the broadcast.
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    fold = (F.crc32(F.concat(F.lit("fold"), F.col("doc_id").cast("string")).cast("binary")) % 2).cast("int")
    train = train.select("text", "toxic", fold.alias("fold"))

    def count(batches):
        for batch in batches:
            toxic, half = batch.column("toxic").to_numpy(), batch.column("fold").to_numpy()
            for a, b, buf, offs in pieces(batch.column("text")):
                words, stems, first = _words(buf, offs)
                before = _pairs(words, first)
                mark = np.repeat(toxic[a:b] + 2 * half[a:b], np.diff(first))
                doc = np.repeat(np.arange(b - a), np.diff(first))
                # Once a document: a line that one text repeats is one piece of evidence.
                rows = np.unique(np.column_stack([doc.astype(np.uint64), before, words, stems, mark.astype(np.uint64)]), axis=0)[:, 1:]
                if len(rows):
                    rows = rows[np.lexsort(rows.T)]
                    new = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1)))
                    n = np.diff(np.append(new, len(rows)))
                    rows = rows[new]
                    yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0].view(np.int64)), pa.array(rows[:, 1].view(np.int64)), pa.array(rows[:, 2].view(np.int64)), pa.array(rows[:, 3].astype(np.int32)), pa.array(n)], ["before", "word", "stem", "mark", "n"])

    got = train.mapInArrow(count, "before long, word long, stem long, mark int, n long").groupBy("before", "word", "stem", "mark").agg(F.sum("n").alias("n")).toArrow()
    before, word, stem = (np.ascontiguousarray(got[c].to_numpy()).view(np.uint64) for c in ("before", "word", "stem"))
    mark, n = got["mark"].to_numpy(), got["n"].to_numpy().astype(float)
    toxic, half = mark % 2, mark // 2
    if not (toxic == 1).any() or not (toxic == 0).any():
        return None
    halves = [Pair(before[half == k], word[half == k], stem[half == k], toxic[half == k], n[half == k]) for k in (0, 1)]
    sent = spark.sparkContext.broadcast(halves)

    def cross(batches):
        for batch in batches:
            toxic, half = batch.column("toxic").to_numpy(), batch.column("fold").to_numpy()
            for a, b, buf, offs in pieces(batch.column("text")):
                words, stems, first = _words(buf, offs)
                x = [sent.value[1 - k].features(words, stems, first) for k in (0, 1)]
                x = np.where((half[a:b] == 0)[:, None], x[0], x[1])
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(toxic[a:b])], ["x", "toxic"])

    seen = train.mapInArrow(cross, "x array<double>, toxic int").toArrow()
    x, y = np.array(seen["x"].to_pylist()), seen["toxic"].to_numpy().astype(float)
    sent.unpersist()
    size = labels.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()
    share = {int(r[label]): r["count"] for r in size}
    # Classes are drawn alike; the curve is fitted with the weights they have among all labelled rows.
    weight = np.where(y == 1, share.get(1, 1) / max(1, (y == 1).sum()), share.get(0, 1) / max(1, (y == 0).sum()))
    curve = logistic(x, y, weight / weight.mean())
    return Pair(before, word, stem, toxic, n), curve


def _probability(model, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    if model is None:
        return np.zeros(len(offs) - 1)
    pair, (w, centre, scale) = model
    words, stems, first = _words(buf, offs)
    x = (pair.features(words, stems, first) - centre) / scale
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 3, held: int = 1, per_class: int = 1200) -> DataFrame:
    """The rows of docs, all columns as they are, that score below the threshold; texts stay where they are read."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels.where(remainder("doc_id", folds) != held), per_class=per_class))

    def run(batches):
        for batch in batches:
            for a, b, buf, offs in pieces(batch.column("text")):
                clean = np.flatnonzero(_probability(sent.value, buf, offs) < threshold)
                yield batch.take(pa.array(clean + a))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 3, held: int = 1, per_class: int = 1200) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; learned from labelled rows outside the held-out fold.

    A null text is an empty one: its features are 0. Rows without doc_id are scored and never learned from. Without labelled
    rows of both classes every score is 0.
    """
    model = fit(docs, labels.where(remainder("doc_id", folds) != held), per_class=per_class)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for a, b, buf, offs in pieces(batch.column("text")):
                p = _probability(sent.value, buf, offs)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(remainder("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score", "predicted")
