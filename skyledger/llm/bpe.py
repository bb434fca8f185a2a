"""BPE encoding by tree concatenation, and decoding.

A long text is cut into leaves; the halves of every cut are encoded apart (for very long documents by different tasks)
and joined: a window around the join is encoded again and grown until its tokens agree with the left half's tokens on
its left side and with the right half's on its right side. A BPE encoding is the one sequence of tokens whose neighbours
are all valid together, so a sequence whose left part, window and right part overlap in equal tokens on equal spans is
the encoding of the whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import tasks

_LOADED: dict[str, "Codec"] = {}


class Codec:
    """A tokenizer file, with encoding of leaves and joins."""

    def __init__(self, path: str, leaf: int):
        # A task has one core; the library's own threads would take those of other tasks.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        self.tok, self.leaf = tok, leaf
        self.known: dict[str, list[int]] = {}
        self.shown: dict[str, tuple[int, str, str]] = {}
        self.room = 500_000
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.plain_decoder = spec.get("decoder") is None
        size = tok.get_vocab_size(with_added_tokens=True)
        self.words = [tok.id_to_token(i) or "" for i in range(size)]
        self.numbers = [str(i) for i in range(size)]

    @classmethod
    def load(cls, path: str, leaf: int) -> "Codec":
        key = f"{leaf}:{path}"
        if key not in _LOADED:
            _LOADED[key] = cls(path, leaf)
        return _LOADED[key]

    def piece(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        got = self.tok.encode(text, add_special_tokens=False)
        return got.ids, got.offsets

    def digest(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """_digests of each text's ids, put together from what its stretches show, without listing the ids."""
        parted, met, long = self._learn(texts)
        shown, out = self.shown, []
        for w in met:
            if w in shown:
                continue
            ids = self.known.get(w)
            ids = long[w] if ids is None else ids
            shown[w] = (len(ids), " ".join([self.numbers[i] for i in ids]), " ".join([self.words[i] for i in ids]) if self.plain_decoder else "")
        for text, words in zip(texts, parted):
            parts = [shown[w] for w in words]
            if self.plain_decoder:
                decoded = " ".join([p[2] for p in parts if p[0]])
            else:
                decoded = self.tok.decode(self._flat(words, long), skip_special_tokens=False)
            numbers = " ".join([p[1] for p in parts if p[0]])
            out.append((sum([p[0] for p in parts]), hashlib.sha256(numbers.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        # Stretches that are too long to keep were shown for these texts only.
        for w in long:
            del shown[w]
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """ids of each text. Blanks and line breaks always part tokens, so a text's ids are those of the stretches between them, which are
        kept for as long as there is room; only stretches longer than a leaf need the tree."""
        parted, _, long = self._learn(texts)
        return [self._flat(words, long) for words in parted]

    def _flat(self, words: list[str], long: dict[str, list[int]]) -> list[int]:
        ids: list[int] = []
        for w in words:
            got = self.known.get(w)
            ids += long[w] if got is None else got
        return ids

    def _learn(self, texts: list[str]) -> tuple[list[list[str]], set[str], dict[str, list[int]]]:
        """The stretches of each text, all of them once, and the ids of those that are too long to keep."""
        parted = [t.replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        if len(self.known) > self.room:
            self.known.clear()
            self.shown.clear()
        met = set().union(*parted)
        new = [w for w in met if w not in self.known]
        short = [w for w in new if len(w) <= self.leaf]
        known = self.known
        known.update(zip(short, (e.ids for e in self.tok.encode_batch_fast(short, add_special_tokens=False))))
        long = {w: self.tree(w)[0] for w in new if len(w) > self.leaf}
        return parted, met, long

    def tree(self, text: str, base: int = 0):
        """ids and spans (from `base` on) of text, by halves."""
        if len(text) <= self.leaf:
            ids, spans = self.piece(text)
            return ids, [(a + base, b + base) for a, b in spans]
        cut = safe_cut(text, len(text) // 2)
        left = self.tree(text[:cut], base)
        right = self.tree(text[cut:], base + cut)
        return self.join(text, base, left, right, base + cut)

    def join(self, text: str, base: int, left, right, at: int, start: int = 64):
        """Tokens of `text` (which begins at `base`) from those of its halves, which meet at `at`."""
        width = start
        end = base + len(text)
        while True:
            a, b = max(base, at - width), min(end, at + width)
            ids, spans = self.piece(text[a - base : b - base])
            spans = [(x + a, y + a) for x, y in spans]
            p = (0, 0) if a == base else _shared(left, (ids, spans), a, at, False)
            q = (len(ids), len(right[0])) if b == end else _shared(right, (ids, spans), at, b, True)
            if p is not None and q is not None and p[-1] <= q[0]:
                keep = p[0]
                return left[0][:keep] + ids[p[1] : q[0]] + right[0][q[1] :], left[1][:keep] + spans[p[1] : q[0]] + right[1][q[1] :]
            if a == base and b == end:
                return ids, spans
            width *= 2


def safe_cut(text: str, near: int) -> int:
    """The cut at or just after `near` that splits no composed character."""
    while near < len(text) and unicodedata.combining(text[near]):
        near += 1
    return near


def _shared(half, window, lo: int, hi: int, right: bool):
    """The first token of the window that the half has too (right: the last), on the same span well inside [lo, hi): its places in
    half and window (right: window and half). None if there is none.

    A pre-token's end depends on the next two characters at most, hence the margin; tokens of a pre-token that the window's
    edge cuts through cannot agree by chance with both id and span and a neighbour, so two in a row are asked for.
    """
    ids, spans = half
    wids, wspans = window
    place = {}
    order = range(len(ids)) if right else range(len(ids) - 1, -1, -1)
    for i in order:
        x, y = spans[i]
        if (x >= hi) if right else (y <= lo):
            break
        place[(x, y, ids[i])] = i
    margin = 8
    found = None
    for k in range(len(wids) - 1):
        x, y = wspans[k]
        if x < lo + (0 if right else margin) or wspans[k + 1][1] > hi - (margin if right else 0):
            continue
        i = place.get((x, y, wids[k]))
        if i is None or place.get((*wspans[k + 1], wids[k + 1])) != i + 1 or spans[i] == spans[i + 1]:
            continue
        if not right:
            return i + 1, k + 1
        found = (k + 1, i + 1)
    return found


def _digests(codec: Codec, ids: list[int]) -> tuple[int, str, str]:
    joined = " ".join([codec.numbers[i] for i in ids])
    if codec.plain_decoder:
        text = " ".join([codec.words[i] for i in ids])
    else:
        text = codec.tok.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def _batched(fn):
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                yield fn(batch.slice(a, 256))

    return run


def encode(docs: DataFrame, path: str, leaf: int = 4096, split: int = 1 << 17, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of token ids (array<int>); a null text is empty.

    Texts up to `split` code points are encoded where they lie, by trees of leaves. Longer ones are cut into parts of `split`
    code points that are encoded by separate tasks; their joins are then made where the parts of a document meet.
    Any other columns are carried along; a column that is called like the ids gives way to them.
    """
    docs = docs.drop(ids)
    clean = F.coalesce(F.col(text), F.lit(""))
    long = F.length(clean) > split
    keep = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def short(batch):
        codec = Codec.load(path, leaf)
        texts = batch.column(text).fill_null("").to_pylist() if batch.num_rows else []
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(codec.encode(texts), pa.list_(pa.int32()))], [*batch.schema.names, ids])

    near = docs.where(~long).mapInArrow(_batched(short), f"{kinds}, `{ids}` array<int>")
    # Repeated texts are encoded once.
    whole = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_whole")
    tagged = docs.where(long).select(whole, F.sha2(text, 256).alias("_row"), F.col(text).alias("_text"))
    cut = F.sequence(F.lit(0), F.floor((F.length("_text") - 1) / F.lit(split)).cast("int"))
    parts = tagged.select("_row", "_text").dropDuplicates(["_row"]).select("_row", F.posexplode(cut).alias("_part", "_p"), "_text")
    part = parts.select("_row", "_part", F.expr(f"substring(_text, _part * {split} + 1, {split})").alias("_text")).repartition(tasks(docs), "_row", "_part")

    def one(batch):
        codec = Codec.load(path, leaf)
        got = [codec.tree(t) for t in batch.column("_text").to_pylist()]
        flat = lambda k: pa.array([[s[k] for s in g[1]] for g in got], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays(
            [batch.column("_row"), batch.column("_part"), batch.column("_text"), pa.array([g[0] for g in got], pa.list_(pa.int32())), flat(0), flat(1)],
            ["_row", "_part", "_text", "_ids", "_a", "_b"],
        )

    coded = part.mapInArrow(_batched(one), "_row string, _part int, _text string, _ids array<int>, _a array<int>, _b array<int>")

    def meet(key, group):
        codec = Codec.load(path, leaf)
        rows = sorted(group.to_pylist(), key=lambda r: r["_part"])
        nodes, at = [], 0
        for r in rows:
            nodes.append((at, r["_text"], (r["_ids"], [(a + at, b + at) for a, b in zip(r["_a"], r["_b"])])))
            at += len(r["_text"])
        while len(nodes) > 1:
            paired = []
            for x, y in zip(nodes[::2], nodes[1::2]):
                whole = x[1] + y[1]
                paired.append((x[0], whole, codec.join(whole, x[0], x[2], y[2], y[0])))
            nodes = paired + nodes[len(nodes) - len(nodes) % 2 :]
        return pa.table({"_row": [key[0].as_py()], ids: pa.array([nodes[0][2][0]], pa.list_(pa.int32()))})

    met = coded.groupBy("_row").applyInArrow(meet, f"_row string, `{ids}` array<int>")
    return near.unionByName(tagged.join(met, "_row").select(*[F.col("_whole").getField(c).alias(c) for c in keep], F.col(f"`{ids}`")))


def digests(coded: DataFrame, path: str, leaf: int = 4096, ids: str = "ids") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded documents."""

    def run(batch):
        codec = Codec.load(path, leaf)
        got = [_digests(codec, r) for r in batch.column(ids).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return coded.select("doc_id", ids).mapInArrow(_batched(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded_digests(docs: DataFrame, path: str, leaf: int = 4096, split: int = 1 << 17) -> DataFrame:
    """digests(encode(docs)) in one pass over the texts up to `split` code points: their ids are never listed. Other columns are left out."""
    docs = docs.select("doc_id", "text")
    long = F.length(F.coalesce(F.col("text"), F.lit(""))) > split

    def short(batch):
        codec = Codec.load(path, leaf)
        got = codec.digest(batch.column("text").fill_null("").to_pylist()) if batch.num_rows else []
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    near = docs.where(~long).mapInArrow(_batched(short), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return near.unionByName(digests(encode(docs.where(long), path, leaf, split), path, leaf))


def decode(coded: DataFrame, path: str, leaf: int = 4096, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Encoded documents with the text that their ids stand for, special tokens included; a column that is called like it gives way."""
    coded = coded.drop(out)

    def run(batch):
        codec = Codec.load(path, leaf)
        back = [codec.tok.decode(r, skip_special_tokens=False) for r in batch.column(ids).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.string())], [*batch.schema.names, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields)
    return coded.mapInArrow(_batched(run), f"{kinds}, `{out}` string")
