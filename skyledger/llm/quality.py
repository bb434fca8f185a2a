"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics are taken from whole texts in one pass. A Gaussian kernel over them is approximated by random cosines; every
task sums its share of the normal equations, the driver adds the sums (their size depends on the number of features
alone) and solves them. Scores are calibrated by isotonic regression over a histogram of scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import cut, remainder
from skyledger.llm.words import LOWER, pieces, span_hashes, word_spans

_B = np.arange(256)
_CLASSES = {
    "upper": (_B >= 65) & (_B <= 90),
    "digit": (_B >= 48) & (_B <= 57),
    "wide": _B >= 128,
    "stop": np.isin(_B, [46, 44]),
    "mark": ((_B >= 33) & (_B <= 47) & ~np.isin(_B, [46, 44])) | ((_B >= 58) & (_B <= 64)) | ((_B >= 91) & (_B <= 96)) | ((_B >= 123) & (_B <= 126)),
    "line": _B == 10,
    "vowel": np.isin(_B | 32, [97, 101, 105, 111, 117]) & (_B >= 65) & (_B < 128),
}
STATS = ("log_words", "log_bytes", "word_length", "word_spread", "distinct", "repeats", "top_word", "pair_repeats", "ends_marked", "capital_words", "entropy", "short_words", "line_length", *(f"share_{k}" for k in _CLASSES))


def statistics(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of STATS for each document of a batch; an empty text has zeros."""
    n = len(offs) - 1
    out = np.zeros((n, len(STATS)))
    s, e, first = word_spans(buf, offs)
    h = span_hashes(LOWER[buf], s, e)
    length = (e - s).astype(float)
    begin, last = buf[s], buf[e - 1] if len(e) else buf[:0]
    capital, marked = _CLASSES["upper"][begin], ~((last | 32) >= 97) & (last < 128)
    total = np.diff(offs)
    shares = {k: np.diff(np.concatenate([[0], np.cumsum(m[buf])])[offs]) for k, m in _CLASSES.items()}
    for i in range(n):
        a, b = first[i], first[i + 1]
        w, size = b - a, total[i]
        if not size:
            continue
        row = [np.log1p(w), np.log1p(size)]
        if w:
            own, ln = h[a:b], length[a:b]
            _, counts = np.unique(own, return_counts=True)
            share = counts / w
            row += [ln.mean(), ln.std(), len(counts) / w, (own[1:] == own[:-1]).mean() if w > 1 else 0.0, share.max()]
            pairs = own[1:] * np.uint64(31) + own[:-1]
            row += [1 - len(np.unique(pairs)) / len(pairs) if w > 1 else 0.0, marked[a:b].mean(), capital[a:b].mean(), -(share * np.log(share)).sum(), (ln <= 3).mean()]
        else:
            row += [0.0] * 10
        row.append(np.log1p(size / (shares["line"][i] + 1)))
        out[i] = [*row, *(shares[k][i] / size for k in _CLASSES)]
    return out


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and `stats` (array<double>, STATS in order) of every whole text; a null text is empty."""

    def run(batches):
        for batch in batches:
            for a, b, buf, offs in pieces(batch.column("text")):
                got = statistics(buf, offs)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.FixedSizeListArray.from_arrays(pa.array(got.ravel()), len(STATS)).cast(pa.list_(pa.float64()))], ["doc_id", "stats"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, stats array<double>")


class Model:
    """Centre and scale of the statistics, cosine features, ridge weights, calibration."""

    def __init__(self, mean, scale, features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.freq = rng.normal(0, 1 / width, (len(mean), features))
        self.phase = rng.uniform(0, 2 * np.pi, features)
        self.weights, self.edges, self.values = None, None, None

    def design(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.freq + self.phase), z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.design(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.edges, self.values), 0.0, 1.0)


def isotonic(weight: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to value in weighted squares (pooling neighbours that violate the order)."""
    blocks: list[list[float]] = []
    for w, v in zip(weight, value):
        blocks.append([w, v, 1])
        while len(blocks) > 1 and blocks[-2][1] > blocks[-1][1]:
            w2, v2, n2 = blocks.pop()
            w1, v1, n1 = blocks.pop()
            blocks.append([w1 + w2, (w1 * v1 + w2 * v2) / (w1 + w2), n1 + n2])
    return np.repeat([b[1] for b in blocks], [b[2] for b in blocks])


def _summed(df: DataFrame, fn, n: int) -> np.ndarray:
    """The sum over all rows of fn(stats, y), a vector of fixed length n: one vector a task, added in 16 groups, then on the driver."""

    def run(batches):
        total = np.zeros(n)
        for batch in batches:
            if batch.num_rows:
                stats = batch.column("stats").flatten().to_numpy().reshape(batch.num_rows, -1)
                total += fn(stats, batch.column("y").to_numpy().astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    def add(group):
        return pa.table({"part": [sum((np.frombuffer(p, dtype=float) for p in group.column("part").to_pylist()), np.zeros(n)).tobytes()]})

    parts = df.mapInArrow(run, "part binary").groupBy(F.spark_partition_id() % 16).applyInArrow(add, "part binary")
    return sum((np.frombuffer(r["part"], dtype=float) for r in parts.collect()), np.zeros(n))


def fit(stats: DataFrame, labels: DataFrame, label: str, features: int = 256, width: float = 4.0, ridge: float = 1e-3, bins: int = 512, seed: int = 7) -> Model:
    """Fit on all labelled rows. stats: (doc_id, stats); labels: (doc_id, label) with 0 or 1; other labels and rows without id are left out."""
    d = len(STATS)
    y = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("double").alias("y"))
    rows = cut(stats.join(y, "doc_id").select("stats", "y"), "quality")
    first = _summed(rows, lambda x, t: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 1 + 2 * d)
    n = max(first[0], 1.0)
    mean = first[1 : 1 + d] / n
    scale = np.sqrt(np.maximum(first[1 + d :] / n - mean**2, 1e-12))
    model = Model(mean, np.where(scale > 1e-5, scale, 1.0), features, width, seed)
    k = features + d + 1

    def equations(x, t):
        a = model.design(x)
        return np.concatenate([(a.T @ a).ravel(), a.T @ t])

    got = _summed(rows, equations, k * k + k)
    model.weights = np.linalg.solve(got[: k * k].reshape(k, k) + ridge * n * np.eye(k) / k + 1e-9 * np.eye(k), got[k * k :])
    edges = np.linspace(-0.5, 1.5, bins)

    def histogram(x, t):
        at = np.clip(np.searchsorted(edges, model.raw(x)), 0, bins - 1)
        return np.concatenate([np.bincount(at, minlength=bins), np.bincount(at, t, minlength=bins)])

    counts = _summed(rows, histogram, 2 * bins)
    seen = np.flatnonzero(counts[:bins])
    if len(seen):
        model.edges, model.values = edges[seen], isotonic(counts[seen], counts[bins + seen] / counts[seen])
    else:
        model.edges, model.values = edges[:1], np.array([0.5])
    return model


def score(stats: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score >= threshold)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            got = model.score(batch.column("stats").flatten().to_numpy().reshape(batch.num_rows, -1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got), pa.array((got >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return stats.mapInArrow(run, "doc_id long, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """Fit on labelled rows outside the held-out fold and score every document: doc_id, held_out, score, predicted.

    A null text is an empty one. A null doc_id is never learned from; held_out is false for it. Without labelled rows every score is 0.5.
    """
    stats = cut(document_statistics(docs), "stats")
    model = fit(stats, labels.where(remainder("doc_id", folds) != held), "quality")
    return score(stats, model).select("doc_id", F.coalesce(remainder("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score", "predicted")
