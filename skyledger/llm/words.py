"""Words of whole texts as arrays: positions and 64-bit hashes, for a batch of documents at a time.

A word is a maximal run of bytes other than space and 0x09 to 0x0D, with A-Z lower-cased. Words are told apart by a
64-bit hash of their bytes; at a billion different words two of them share one with a chance below 3 %.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BYTE = np.arange(256, dtype=np.uint8)
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
SPACE = (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))
_CODE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            have = np.multiply.accumulate(step)
        if size <= 1 << 21:
            _POWERS[base] = have
    return have[:n]


def pieces(column: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) over runs of rows of about `limit` bytes; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.fill_null("").cast(pa.large_string()) if not pa.types.is_null(column.type) else pa.array([""] * len(column), pa.large_string())
    n = len(flat)
    if not n:
        return
    offs = np.frombuffer(flat.buffers()[1], dtype=np.int64)[flat.offset : flat.offset + n + 1]
    data = flat.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, whole[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, and the index of the first word of each document (one more at the end)."""
    solid = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offs] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offs)


def span_hashes(low: np.ndarray, s: np.ndarray, e: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of the byte spans [s, e), which lie in order; worked in blocks, so memory does not follow a text's length."""
    out = np.empty(len(s), dtype=np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(s):
            j = max(i + 1, int(np.searchsorted(e, s[i] + block, "right")))
            a, b = int(s[i]), int(e[j - 1])
            sums = np.zeros(b - a + 1, dtype=np.uint64)
            np.cumsum(_CODE[low[a:b]] * powers(_STEP, b - a), out=sums[1:])
            h = (sums[e[i:j] - a] - sums[s[i:j] - a]) * powers(_BACK, b - a)[s[i:j] - a]
            out[i:j] = mix(h ^ ((e[i:j] - s[i:j]).astype(np.uint64) << np.uint64(40)))
            i = j
    return out


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in order, and the index of the first word of each document (one more at the end)."""
    s, e, first = word_spans(buf, offs)
    return span_hashes(LOWER[buf], s, e), first


def sequence_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k neighbouring words."""
    n = max(0, len(h) - k + 1)
    with np.errstate(over="ignore"):
        total = np.full(n, k, dtype=np.uint64)
        for i in range(k):
            total = mix(total * np.uint64(0xD6E8FEB86659FD93) + h[i : i + n])
    return total


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of a document's k-word shingles; the whole sequence when it has fewer words, empty without words."""
    if not len(h):
        return h
    return np.unique(sequence_hash(h, min(k, len(h))))
