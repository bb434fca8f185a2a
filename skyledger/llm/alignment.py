"""Alignment of two tokenizers' tokens over the same bytes, by an associative monoid of fragments.

Both tokenizers part a text wherever a single blank stands between two characters that are no blanks: the byte-level one starts a pre-token there and no
piece of the other reaches over a blank. A stretch between such places is closed on both sides: its tokens, groups and links are its own, and its
first blank is the prefix that both give to a text. Any range of a text is therefore a fragment

    open prefix (up to the first such place), closed groups, open suffix (from the last such place on)

and two neighbouring fragments are joined by parting suffix + prefix anew. Joining is associative, so the ranges of a very long document are worked on
by different tasks and joined by a tree; a short document is one range.

Overlaps of tokens need no search: every byte interval between neighbouring token ends, of either side, lies in exactly one token of each, and every
overlapping pair shares exactly one such interval.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import cut, drop, tasks

PLACE = re.compile(r"(?<=\S) (?=\S)")
#: Ids of a pair in one number; ids of the second tokenizer lie below 2^SHIFT.
SHIFT = 20


def byte_values() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printable Latin-1 characters stand for themselves, other bytes for the characters from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, with the stretches met so far; kept once a Python worker."""

    _loaded: dict[tuple[str, str], "Aligner"] = {}

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        value = byte_values()
        size = self.a.get_vocab_size(with_added_tokens=True)
        names = [self.a.id_to_token(i) or "" for i in range(size)]
        self.bytes_a = [bytes(value[ch] for ch in t) if all(ch in value for ch in t) else t.encode() for t in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if len(pieces) >= 1 << SHIFT:
            raise ValueError("too many pieces for packed pairs")
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces that reach over a blank cannot be parted at blanks")
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # Ids as text with the mark that follows them: more of the same side, the other side, the next group, the end.
        self.shown_a = [[f"{i}{mark}" for i in range(size)] for mark in (",", "|", "", "")]
        self.shown_b = [[f"{i}{mark}" for i in range(len(pieces))] for mark in (",", "", ";", "")]
        self.room = 300_000
        self.forget()

    @classmethod
    def load(cls, path_a: str, path_b: str) -> "Aligner":
        if (path_a, path_b) not in cls._loaded:
            cls._loaded[path_a, path_b] = cls(path_a, path_b)
        return cls._loaded[path_a, path_b]

    def forget(self) -> None:
        """Empty the table of stretches: number by text, groups as text, (A tokens, B tokens, groups, links, first link, good) and all links."""
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.facts = np.zeros((6, 1024), np.int64)
        self.links = np.zeros(8192, np.int64)
        self.used = 0

    def prepare(self, parted: list[list[str]]) -> None:
        """Learn the stretches of several texts in one call; what was learned before is forgotten once there is too much of it."""
        if len(self.known) > self.room:
            self.forget()
        self.learn(set(chain.from_iterable(parted)))

    def learn(self, stretches) -> None:
        new = [s for s in stretches if s not in self.known]
        if not new:
            return
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + s for s in new], add_special_tokens=False)]
        ids_b = self.b.encode(new, num_threads=1)
        good = [
            b"".join([self.bytes_a[i] for i in a]) == data == b"".join([self.bytes_b[i] for i in b])
            for a, b, data in zip(ids_a, ids_b, [(" " + s).encode() for s in new])
        ]
        none: list[int] = []
        first = len(self.known)
        for k, s in enumerate(new):
            self.known[s] = first + k
            if not good[k]:
                ids_a[k] = ids_b[k] = none
        groups, counts, links = self.align(ids_a, ids_b)
        self.groups += groups
        while self.facts.shape[1] < first + len(new):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)], axis=1)
        here = slice(first, first + len(new))
        self.facts[:4, here] = counts
        self.facts[4, here] = self.used + np.cumsum(counts[3]) - counts[3]
        self.facts[5, here] = good
        while len(self.links) < self.used + len(links):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        self.links[self.used : self.used + len(links)] = links
        self.used += len(links)

    def align(self, ids_a: list[list[int]], ids_b: list[list[int]]):
        """Groups as text, (A tokens, B tokens, groups, links) and all links, for the tokens of several stretches with equal bytes on both sides."""
        n_a, n_b = np.array([len(x) for x in ids_a], np.int64), np.array([len(x) for x in ids_b], np.int64)
        a, b = np.fromiter(chain.from_iterable(ids_a), np.int64, n_a.sum()), np.fromiter(chain.from_iterable(ids_b), np.int64, n_b.sum())
        # The stretches lie one after another on one axis of bytes.
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.union1d(end_a, end_b)
        links = a[np.searchsorted(end_a, ends)] << SHIFT | b[np.searchsorted(end_b, ends)]
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        owner_a, owner_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
        count = lambda e: np.bincount(owner_a[np.searchsorted(end_a, e)], minlength=len(n_a))
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        # All tokens in the order in which they are shown: by group, A before B.
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        side = (order >= len(a)).astype(np.int64)
        group = np.concatenate([group_a, group_b])[order]
        owner = np.concatenate([owner_a, owner_b])[order]
        mark = np.full(len(order), 3)
        if len(order):
            same = group[1:] == group[:-1]
            mark[:-1] = np.where(same, np.where(side[1:] == side[:-1], 0, 1), np.where(owner[1:] == owner[:-1], 2, 3))
        tables = (self.shown_a, self.shown_b)
        shown = [tables[s][m][i] for s, m, i in zip(side.tolist(), mark.tolist(), np.concatenate([a, b])[order].tolist())]
        stops = np.cumsum(n_a + n_b).tolist()
        groups = ["".join(shown[x:y]) for x, y in zip([0, *stops], stops)]
        return groups, np.array([n_a, n_b, count(both), count(ends)]), links


class Fragment:
    """A range of a text: cuts (whether it holds a place to part at), open prefix and suffix, and what is closed between them.

    Without such a place the whole range is the prefix. `keys` and `times` list links, a link as often as it was met or with its number;
    `bad` tells that a closed stretch does not decode to its bytes.
    """

    __slots__ = ("cuts", "prefix", "suffix", "groups", "n_a", "n_b", "n_groups", "keys", "times", "bad")

    def __init__(self, cuts=False, prefix="", suffix="", bad=False):
        self.cuts, self.prefix, self.suffix, self.bad = cuts, prefix, suffix, bad
        self.n_a = self.n_b = self.n_groups = 0
        self.groups: list[str] = []
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def close(self, aligner: Aligner, stretches: list[str]) -> "Fragment":
        if not stretches:
            return self
        known = aligner.known
        try:
            at = [known[s] for s in stretches]
        except KeyError:
            aligner.learn(set(stretches))
            at = [known[s] for s in stretches]
        self.groups += [aligner.groups[i] for i in at]
        n_a, n_b, n_groups, n, start, good = aligner.facts[:, at]
        self.n_a += int(n_a.sum())
        self.n_b += int(n_b.sum())
        self.n_groups += int(n_groups.sum())
        self.bad |= not good.all()
        total = int(n.sum())
        if total:
            self.keys.append(aligner.links[np.repeat(start - np.cumsum(n) + n, n) + np.arange(total)])
            self.times.append(np.ones(total, np.int64))
        return self

    def follow(self, other: "Fragment") -> "Fragment":
        """Take over what the other has closed."""
        self.groups += other.groups
        self.keys += other.keys
        self.times += other.times
        self.n_a += other.n_a
        self.n_b += other.n_b
        self.n_groups += other.n_groups
        self.bad |= other.bad
        return self

    @classmethod
    def of(cls, aligner: Aligner, parts: list[str]) -> "Fragment":
        """The fragment of a range from its stretches, PLACE.split(range). A blank at the edge of the range may be a place or not; it stays in an open
        part, as look-around finds nothing beyond the edge."""
        if len(parts) == 1:
            return cls(prefix=parts[0])
        return cls(True, parts[0], parts[-1]).close(aligner, parts[1:-1])

    def joined(self, other: "Fragment", aligner: Aligner) -> "Fragment":
        """This range followed by the other."""
        middle = (self.suffix if self.cuts else self.prefix) + other.prefix
        parts = PLACE.split(middle)
        out = Fragment(self.cuts or other.cuts or len(parts) > 1)
        if not out.cuts:
            out.prefix = middle
            return out
        out.prefix = self.prefix if self.cuts else parts.pop(0)
        out.suffix = other.suffix if other.cuts else parts.pop()
        return out.follow(self).close(aligner, parts).follow(other)

    def whole(self, aligner: Aligner) -> "Fragment":
        """The fragment of a whole text: both open ends are closed by the ends of the text."""
        out = Fragment().close(aligner, [self.prefix]).follow(self)
        return out.close(aligner, [self.suffix]) if self.cuts else out

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Each pair once, with its number."""
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, place = np.unique(np.concatenate(self.keys), return_inverse=True)
        return keys, np.bincount(place, weights=np.concatenate(self.times), minlength=len(keys)).astype(np.int64)

    def row(self) -> tuple:
        return self.cuts, self.prefix, self.suffix, ";".join(self.groups), self.n_a, self.n_b, self.n_groups, *self.pairs(), self.bad

    @classmethod
    def back(cls, r: dict) -> "Fragment":
        out = cls(r["cuts"], r["prefix"], r["suffix"], r["bad"])
        out.n_a, out.n_b, out.n_groups = r["n_a"], r["n_b"], r["n_groups"]
        if r["groups"]:
            out.groups = [r["groups"]]
            out.keys, out.times = [np.array(r["pairs"], np.int64)], [np.array(r["times"], np.int64)]
        return out


_FRAGMENT = (
    "h string, part long, cuts boolean, prefix string, suffix string, groups string, n_a long, n_b long, n_groups long, pairs array<long>, times array<long>, bad boolean"
)
_ALIGNED = (
    "block string, doc_id long, h string, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, "
    "place array<int>, times array<int>, pairs array<long>, held array<long>"
)
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_KINDS = {
    "string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(),
    "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, _KINDS[k]) for v, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])


class _Block:
    """Aligned texts whose distinct pairs are listed once; texts refer to them by place."""

    def __init__(self, name: str, groups: bool):
        self.name, self.groups, self.rows, self.keys, self.times, self.owner, self.size = name, groups, [], [], [], [], 0

    def add(self, doc_id, h, got: Fragment | None) -> None:
        if got is None or got.bad:
            self.rows.append((doc_id, h, 0, 0, 0, 0, "" if self.groups else None, ""))
        else:
            shown = ";".join(got.groups)
            links = sum(int(t.sum()) for t in got.times)
            self.owner += [len(self.rows)] * len(got.keys)
            self.rows.append((doc_id, h, got.n_a, got.n_b, got.n_groups, links, shown if self.groups else None, hashlib.sha256(shown.encode()).hexdigest()))
            self.keys += got.keys
            self.times += got.times
            self.size += sum(map(len, got.keys))
        self.size += 8

    def batches(self, held: int = 1):
        """The texts, then one row that lists the pairs and how many texts of the block hold each (held: rows that each text stands for)."""
        if not self.rows:
            return
        join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
        pairs, place = np.unique(join(self.keys), return_inverse=True)
        owner = np.repeat(np.array(self.owner, np.int64), [len(k) for k in self.keys])
        both, at = np.unique(owner * max(1, len(pairs)) + place, return_inverse=True)
        times = np.bincount(at, weights=join(self.times), minlength=len(both)).astype(np.int32)
        owner, place = np.divmod(both, max(1, len(pairs)))
        counts = np.bincount(place, minlength=len(pairs)) * held
        ends = np.searchsorted(owner, np.arange(1, len(self.rows)))
        places, times = np.split(place.astype(np.int32), ends), np.split(times, ends)
        for a in range(0, len(self.rows), 512):
            z = slice(a, a + 512)
            rows = [(self.name, d, h, *r, p, t, None, None) for (d, h, *r), p, t in zip(self.rows[z], places[z], times[z])]
            yield _batch(rows, _ALIGNED)
        yield _batch([(self.name, None, None, 0, 0, 0, 0, None, None, None, None, pairs, counts)], _ALIGNED)


def _long_texts(docs: DataFrame, path_a: str, path_b: str, split: int, fan: int, groups: bool, scratch: list) -> DataFrame:
    """Aligned long texts, each distinct text once: ranges are fragments of their own, joined by a tree of `fan` branches, a level a round."""
    n = tasks(docs)
    texts = docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.max("text").alias("text"), F.count(F.lit(1)).alias("copies"))

    def ranges(batches):
        for batch in batches:
            for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist()):
                for a in range(0, len(text), 64 * split):
                    spots = range(a, min(len(text), a + 64 * split), split)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([h] * len(spots)), pa.array([s // split for s in spots], pa.int64()), pa.array([text[s : s + split] for s in spots])], ["h", "part", "text"]
                    )

    def fragments(batches):
        aligner = Aligner.load(path_a, path_b)
        for batch in batches:
            for h, part, text in zip(*[batch.column(c).to_pylist() for c in ("h", "part", "text")]):
                parts = PLACE.split(text)
                aligner.prepare([parts])
                yield _batch([(h, part, *Fragment.of(aligner, parts).row())], _FRAGMENT)

    def level(batches):
        aligner = Aligner.load(path_a, path_b)
        now, made = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if (r["h"], r["part"] // fan) != now:
                    if now is not None:
                        yield _batch([(*now, *made.row())], _FRAGMENT)
                    now, made = (r["h"], r["part"] // fan), Fragment.back(r)
                else:
                    made = made.joined(Fragment.back(r), aligner)
        if now is not None:
            yield _batch([(*now, *made.row())], _FRAGMENT)

    parts = texts.select("h", "text").mapInArrow(ranges, "h string, part long, text string").repartition(n, "h", "part")
    held = cut(parts.mapInArrow(fragments, _FRAGMENT), "fragments")
    scratch.append(held)
    last = held.agg(F.max("part")).first()[0] or 0
    while last:
        held = cut(held.repartition(n, "h", F.expr(f"part div {fan}")).sortWithinPartitions("h", "part").mapInArrow(level, _FRAGMENT), "fragments")
        scratch.append(held)
        last //= fan

    def finish(batches):
        aligner = Aligner.load(path_a, path_b)
        for batch in batches:
            for r in batch.to_pylist():
                block = _Block(r["h"], groups)
                block.add(None, r["h"], Fragment.back(r).whole(aligner))
                yield from block.batches(r["copies"])

    return held.join(texts.select("h", "copies"), "h").mapInArrow(finish, _ALIGNED)


def align(docs: DataFrame, path_a: str, path_b: str, split: int = 1 << 16, fan: int = 16, groups: bool = False, text: str = "text") -> DataFrame:
    """One row per document: n_a and n_b tokens, n_groups, n_links, n_best (links whose pair's count is the highest of its A id), count_sum (counts of the
    pairs of all links), groups_sha256, and the groups themselves if asked for. A pair's count is the number of documents that hold it.

    A null or empty text, and one whose tokens do not spell it (a tokenizer that changes bytes), has zeros and an empty groups_sha256. Every row counts as
    a document, with a repeated or null doc_id too; equal links tie and all count as best. Other columns are left out. A text longer than `split` code points
    is worked on in ranges by several tasks; only a stretch without a single blank between other characters is never parted.
    """
    scratch: list[DataFrame] = []
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text"))
    long = F.length("text") > split

    def short(batches):
        aligner = Aligner.load(path_a, path_b)
        task = TaskContext.get().partitionId()
        number, block = 0, _Block(f"{task}-0", groups)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = part.column("text").to_pylist()
                parted = [PLACE.split(t) for t in texts]
                aligner.prepare(parted)
                for d, t, parts in zip(part.column("doc_id").to_pylist(), texts, parted):
                    block.add(d, None, Fragment.of(aligner, parts).whole(aligner) if t else None)
                    if block.size > 1_000_000:
                        yield from block.batches()
                        number += 1
                        block = _Block(f"{task}-{number}", groups)
        yield from block.batches()

    near = rows.where(~long).mapInArrow(short, _ALIGNED)
    far = cut(_long_texts(rows.where(long), path_a, path_b, split, fan, groups, scratch), "long")
    whose = rows.where(long).select(F.col("doc_id").alias("_id"), F.sha2("text", 256).alias("_h"))
    owned = whose.join(far.where("pairs IS NULL"), F.col("_h") == F.col("h")).withColumn("doc_id", F.col("_id")).select(*near.columns)
    aligned = cut(near.unionByName(owned).unionByName(far.where("pairs IS NOT NULL")), "aligned")
    scratch += [far, aligned]

    listed = aligned.where("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "p")).select("block", "place", "p.pairs", "p.held")
    counts = cut(listed.groupBy("pairs").agg(F.sum("held").alias("n")), "counts")
    highest = counts.groupBy(F.shiftright("pairs", SHIFT).alias("a")).agg(F.max("n").alias("high"))
    judged = cut(counts.join(highest, F.shiftright("pairs", SHIFT) == F.col("a")).select("pairs", "n", (F.col("n") == F.col("high")).alias("best")), "judged")
    scratch += [counts, judged]
    answers = listed.select(F.col("block").alias("of"), "place", "pairs").join(judged, "pairs").select("of", "place", "n", "best")
    shown = _OUT + (", groups string" if groups else "")

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        order = right.column("place").to_numpy()
        n = np.zeros(len(order), np.int64)
        best = np.zeros(len(order), np.int64)
        n[order] = right.column("n").to_numpy()
        best[order] = right.column("best").to_numpy(zero_copy_only=False)
        place = left.column("place").combine_chunks()
        flat, times = place.flatten().to_numpy(), left.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(left.num_rows), place.value_lengths().to_numpy())
        add = lambda w: np.bincount(owner, weights=w, minlength=left.num_rows) if len(owner) else np.zeros(left.num_rows)
        sums = np.zeros(left.num_rows, np.int64)
        np.add.at(sums, owner, n[flat] * times)
        out = {c: left.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        out |= {"n_best": pa.array(add(best[flat] * times).astype(np.int64)), "count_sum": pa.array(sums), "groups_sha256": left.column("groups_sha256")}
        return pa.table(out | ({"groups": left.column("groups")} if groups else {}))

    texts = aligned.where("pairs IS NULL").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256", "place", "times")
    # Grouped work weighs more than its bytes show, so the number of partitions is given.
    n = tasks(docs)
    out = cut(texts.repartition(n, "block").groupBy("block").cogroup(answers.repartition(n, "of").groupBy("of")).applyInArrow(settle, shown), "alignment")
    drop(*scratch)
    return out
