"""The training-data operators on small tables against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skyledger.llm import bpe, decontam, lattice, minmax, mixing, pii, quality, suffixes, toxicity, warc
from skyledger.llm.queries import QUERIES, tokenizer_path
from skyledger.session import scratch_path

WORDS = [a + b + c for a in ("th", "on", "er", "ea", "in") for b in ("st", "nd", "re", "ou") for c in ("", "ing", "ed", "tion")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, u long, bucket string, ids string, row string, row_key int, n string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def texts(seed=1):
    """Texts with exact and near copies, passages met twice, empty, short, very long, and null ones."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    words = base.split()
    near = [" ".join(w if i != 50 + k else "zzz" for i, w in enumerate(words)) for k in range(3)]
    far = " ".join(words[:60]) + " " + prose(rng, 60)
    passage = prose(rng, 90)
    out = [base, base, *near, far, None, "", " \n\t ", "one", "One two", "one two", "one  two\n"]
    out += [prose(rng, rng.randint(3, 200)) for _ in range(12)]
    out += [prose(rng, 20) + " " + passage + " " + prose(rng, 10), passage.upper() + " x", "y " + passage, prose(rng, 4000), "a" * 3000, "é̀ " * 300]
    return out


def docs_frame(spark, rows):
    full = [(i, t, "en", "s", len(t or ""), 1, "b", "i", "r", 2, "n") for i, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


@pytest.fixture(scope="module")
def rows():
    listed = list(enumerate(texts()))
    return [(100 - i, t) for i, t in listed] + [(None, "one two"), (7, "seven eight"), (7, "seven eight")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return docs_frame(spark, rows).cache()


def words_of(text):
    return (text or "").encode().lower().split()


def shingles(text, k):
    w = words_of(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def linked(rows, k, percent):
    """doc_id -> least reachable doc_id, by comparing all pairs."""
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i in root}


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, k, percent):
    want = linked(rows, k, percent)
    got = minmax.near_duplicates(docs, k=k, percent=percent).collect()
    assert len(got) == len(rows)
    size = {(i, len(shingles(t, k))) for i, t in rows}
    assert {(r.doc_id, r.n_shingles) for r in got} == size
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id is not None and r.component_id == r.doc_id)


def test_near_duplicates_across_components(spark):
    """A family around a text that is not the least id, and copies far from it: links beyond the bucket's first document."""
    rng = random.Random(5)
    base = [rng.choice(WORDS) + str(i % 7) for i in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 6, 9])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    want = linked(rows, 3, 85)
    got = {r.doc_id: r.component_id for r in minmax.near_duplicates(docs_frame(spark, rows), k=3, percent=85, block=8).collect()}
    assert len(set(want.values())) > 3 and got == want


def test_min_max_estimates_similarity():
    family = minmax.Permutations(256)
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    x, y = a[:800], a[100:]
    same = (family.min_max(x) == family.min_max(y)).mean()
    assert abs(same - 700 / 900) < 0.08


def test_mixing(docs, rows):
    got = mixing.score(docs).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter()
    for i, t in rows:
        if i is not None and not held(i):
            count.update([*words_of(t), b"\n"])
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, t in rows:
        tokens = [*words_of(t), b"\n"]
        want[i, held(i), len(tokens), sum(count[w] > 0 for w in tokens), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_mixing_is_a_distribution_of_words():
    """Bits of a word under the code: the probabilities of all continuations of a prefix sum to one."""
    code = mixing.Code(np.bincount(np.frombuffer(b"abcabca ab \n", dtype=np.uint8), minlength=256))
    rng = np.random.default_rng(1)
    mixer = mixing.Mixer(code, 10, rng.integers(0, 60, (mixing.CONTEXTS, 2, 1 << 10)).astype(np.uint8))
    place, bit, word = mixing.events(code, [bytes([b]) + b"q" for b in range(256)], np.zeros(256, dtype=np.int64), 10)
    odds, gate = mixer.inputs(place, None)
    p = mixer.refine(mixer.logit(odds, gate), gate)
    chance = np.where(bit == 1, p, 1 - p)
    total = 0.0
    for b in range(256):
        total += chance[word == b][: code.size[b]].prod()
    assert abs(total - 1) < 1e-5


def test_mixing_beats_bytes_on_held_out_words(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 200)) for i in range(60)]
    got = mixing.score(docs_frame(spark, rows)).collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.score > r.base_score - 0.2 * r.n_tokens for r in held)


def test_mixing_counts_every_context_exactly(spark):
    """Bit counts of every context, spread over many small chunks, against counts by the contexts' own bytes."""
    rng = random.Random(8)
    rows = [(i, prose(rng, 30) + rng.choice(["", " th. the! ", " then x"])) for i in range(20)]
    frame = docs_frame(spark, rows).withColumn("train", F.col("doc_id") % 4 != 1)
    chunks = mixing.cut(mixing.chunked(mixing.word_counts(frame), 7), "chunks")
    code = mixing.Code(mixing._histogram(chunks)[0])
    counted, _ = mixing.learn(chunks, code)
    listed = [c for b in counted.toArrow().to_batches() for c in mixing.counted_chunks(b)]
    assert len(listed) > 8 and {k for c in listed for k in c.n} > {0}

    def walk(chunk):
        for w, kind, n in zip(chunk.words, chunk.kinds, chunk.n):
            body = w if w == b"\n" else w + b" "
            for i in range(len(body)):
                seen = [(k, body[max(0, i - k) : i]) for k in mixing.ORDERS] + [("whole", body[:i]), ("kind", body[:i], int(kind))]
                start = code.start[body[i]]
                for entry in range(start, start + code.size[body[i]]):
                    yield seen, int(code.node[entry]), int(code.bit[entry]), int(n)

    want = Counter()
    for chunk in listed:
        for seen, node, bit, n in walk(chunk):
            for context in seen:
                want[context, node, bit] += n
    for chunk in listed:
        place, bit, _ = chunk.bits(code, np.arange(len(chunk.text)))
        for i, (seen, node, b, _) in enumerate(walk(chunk)):
            assert b == bit[i]
            for c, context in enumerate(seen):
                exact = [round(8 * math.log2(want[context, node, x] + 1)) for x in (0, 1)]
                assert chunk.levels[:, place[c, i]].tolist() == exact


def test_mixing_works_once_on_what_words_share():
    """Bytes that agree in all before them and in the kind before their word are one node, however many words go through it."""
    rng = random.Random(4)
    words = sorted({b"\n", b"a", b"ab", b"ab\x01", b"abc", "\u00e9t\u00e9".encode(), b"b" * 17000, b"b" * 17000 + b"c", *prose(rng, 300).encode().split()})
    pairs = [(w, k) for w in words for k in range(mixing.CLASSES) if rng.random() < 0.7]
    n = np.array([rng.randint(0, 5) for _ in pairs], dtype=np.int64)
    chunk = mixing.Chunk({"words": b" ".join(w for w, _ in pairs), "kinds": bytes(k for _, k in pairs), "n": n.tobytes(), "c": n.tobytes(), "m": n.tobytes()})
    seen, want = [], Counter()
    for (w, k), count in zip(pairs, n.tolist()):
        so_far = hashlib.sha256(bytes([k]))
        for b in w if w == b"\n" else w + b" ":
            so_far.update(bytes([b]))
            seen.append(so_far.digest())
            want[seen[-1]] += count
    assert len(chunk.text) == len(seen) > 1.5 * len(want) and len(chunk.first) == len(want)
    assert len(set(zip(chunk.node.tolist(), seen))) == len(want)
    assert [want[seen[i]] for i in chunk.first] == chunk.weights().tolist()
    _, hashed, _ = mixing.contexts(chunk.words, chunk.kinds)
    assert (chunk.arcs[chunk.at[:, chunk.node]] == ((hashed & ~np.uint64(255)) | chunk.text).view(np.int64)).all()


def test_mixing_gives_every_training_word_its_whole(spark, docs):
    """Rare words count as wholes too: which words are sent to every task does not change a score."""
    def scores(frequent):
        return sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in mixing.score(docs, frequent=frequent).collect())

    assert scores(0) == scores(8) == scores(100_000)


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def test_toxicity(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        w = prose(rng, rng.randint(20, 150)).split()
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vile", "scum of", "trash"]))
        rows.append((i, " ".join(w)))
        if i % 5:
            labels.append((i, 1, int(bad), "clash"))
    rows += [(None, None), (500, ""), (500, ""), (501, None)]
    labels += [(None, 1, 1, None), (3, None, None, None), (500, 1, 0, "")]
    got = {r.doc_id: r for r in toxicity.toxicity(docs_frame(spark, rows), labelled(spark, labels)).collect()}
    assert len(got) == 243 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(240)) and got[None].held_out is False
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in range(240)]) > 0.97
    assert got[500].predicted == 0
    kept = toxicity.without_toxic(docs_frame(spark, rows), labelled(spark, labels))
    assert kept.columns == docs_frame(spark, rows).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in rows if not got[i].predicted)


def test_quality(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        rows.append((i, ". ".join(prose(rng, 9).capitalize() for _ in range(rng.randint(2, 12))) if good else " ".join(f"{rng.choice(WORDS)}{rng.choice(['%%', '|', '&&'])}" for _ in range(60))))
        labels.append((i, int(good), 0, "clash"))
    rows += [(None, None), (900, ""), (900, ""), (901, None)]
    labels += [(None, 1, 1, None), (2, None, 0, None)]
    got = {r.doc_id: r for r in quality.quality(docs_frame(spark, rows), labelled(spark, labels)).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values()) and got[None].held_out is False
    held = [i for i in range(300) if got[i].held_out]
    assert len(held) > 60 and np.mean([got[i].predicted == (i % 3 > 0) for i in held]) > 0.97


def test_isotonic():
    got = quality.isotonic(np.array([1.0, 1, 2, 1]), np.array([0.0, 0.6, 0.3, 0.9]))
    assert np.allclose(got, [0, 0.4, 0.4, 0.9])


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), k, kind, m.end()))
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


PERSONAL = [
    None, "", "a@b.c_d@e.f x@@y.z ..%a@b-c.d.e", "+1 (632) 555-4827. +12+345678901 ++1234567890)", "1.2.3.4.5.6.7.8 256.1.1.1 00001.2.3.004 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 12345678901234567890123 4111  1111", "é日本😀 x é@x.y日本a@b.co", "1 " * 500, "9" * 2000, "a" * 3000 + " a@" + "b." * 500 + "c",
    "(card 4310082329322593) \"10.0.0.1\", +44 20 7946 0958;",
]


def test_personal_data(spark):
    rows = list(enumerate(PERSONAL)) + [(None, "x a@b.cd"), (3, PERSONAL[3])]
    got = pii.find(docs_frame(spark, rows)).collect()
    want = Counter()
    for i, t in rows:
        spans = base_spans(t)
        kinds = Counter(s.split(":")[0] for s in spans)
        want[i, kinds["email"], kinds["ip"], kinds["card"], kinds["phone"], hashlib.sha256(",".join(spans).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    for r in got:
        text = dict(rows)[r.doc_id]
        assert [s for s in r.spans.split(",") if s] == base_spans(text)


def test_personal_data_learns_patterns(spark):
    """Values that no base pattern knows are found behind words that base matches teach; words that also lead to other numbers teach nothing."""
    rows = [(i, f"the mail contact is user{i}@mail.example.com and room number is {i} here") for i in range(60)]
    rows += [(100 + i, f"so mail contact is jane{i}(at)corp{i} and 7{i} rest, number is user{i}@a.bc") for i in range(3)]
    got = {r.doc_id: r for r in pii.find(docs_frame(spark, rows)).collect()}
    for i in range(3):
        text = rows[60 + i][1]
        at = text.index("jane")
        first = got[100 + i].spans.split(",")[0]
        assert got[100 + i].n_learned == 1 and first == f"email:{at}:{at + len(f'jane{i}(at)corp{i}')}"
    assert all(got[i].n_learned == 0 for i in range(60))


@pytest.mark.parametrize("crowd", [8192, 1])
def test_repeats(spark, docs, rows, crowd, monkeypatch):
    whole = suffixes.repeats
    monkeypatch.setattr(suffixes, "repeats", lambda d, w: whole(d, w, 64, crowd))
    extra = [(300, "x" * 399), (301, "x" * 900), (302, "ab" * 450), (303, "\x00" * 500)]
    frame = docs.unionByName(docs_frame(spark, extra))
    bodies = [(i, (t or "").encode()) for i, t in [*rows, *extra]]
    seen = Counter(b[k : k + 400] for _, b in bodies for k in range(len(b) - 399))
    want = Counter()
    for i, b in bodies:
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        kept = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        want[i, len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    got = suffixes.remove_repeats(frame).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_induced_order_finds_every_repeat():
    rng = random.Random(6)
    width = 20
    for _ in range(60):
        alphabet = rng.choice([b"ab", b"abcd", b"\x00\x01", b"a"])
        source = bytes(rng.choice(alphabet) for _ in range(200))
        bodies = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) + source[a : a + rng.randint(0, 90)] for a in (rng.randrange(150) for _ in range(5))]
        buf = np.frombuffer(b"".join(bodies), dtype=np.uint8)
        offs = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
        got = suffixes.segments(buf, offs, width, 6)
        if got is None:
            continue
        doc, start, strings, ahead, anchor = (x.tolist() for x in got[:5])
        content = [bodies[d][s : s + n - 1 + width] for d, s, n in zip(doc, start, strings)]
        order = np.argsort(anchor, kind="stable")
        again = suffixes.induce(np.array(anchor)[order] % (1 << 40), np.array(ahead)[order], [content[i] for i in order], width)
        seen = Counter(b[k : k + width] for b in bodies for k in range(len(b) - width + 1))
        for i, line in zip(order, again):
            for k in range(strings[i]):
                assert line[ahead[i] - k] == (seen[content[i][k : k + width]] > 1)


def test_tokens(spark, docs, rows):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    tok = Tokenizer.from_file(path)
    want = Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    for leaf, split in ((4096, 1 << 17), (64, 500)):
        coded = bpe.encode(docs, path, leaf=leaf, split=split)
        got = bpe.digests(coded, path, leaf=leaf).collect()
        assert sorted(map(str, got)) == sorted(map(str, bpe.encoded_digests(docs, path, leaf=leaf, split=split).collect()))
        assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    again = bpe.decode(coded, path).select("ids", "decoded").collect()
    assert all(r.decoded == tok.decode(r.ids, skip_special_tokens=False) for r in again)


def test_tree_concatenation_is_exact():
    codec = bpe.Codec(tokenizer_path(), 48)
    rng = random.Random(5)
    parts = ["a", "b", "th", "tion", " ", "\n", "'", "'s", "'re", "é", "́", "İ", "Σ", "1", "42", "!", "<|endoftext|>", "日本", "😀", "👍🏽", "‍", "QU"]
    for n in range(300):
        some = rng.sample(parts, rng.choice([2, 5, len(parts)]))
        text = "".join(rng.choice(some) for _ in range(rng.randint(1, 500)))
        want = codec.tok.encode(text, add_special_tokens=False).ids
        assert codec.tree(text)[0] == want and codec.encode([text])[0] == want
    for text in ("a" * 3000, "ab" * 2000, "'" * 1500, "é" * 1500):
        assert codec.encode([text])[0] == codec.tok.encode(text, add_special_tokens=False).ids


def test_vectors(spark):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(12):
        centre = rng.normal(size=24)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((len(rows) + 10, [float(x) for x in centre + rng.normal(size=24) * rng.choice([0.05, 0.2, 0.3])], c))
    rows += [(3, rows[0][1], 1), (4, [2 * x for x in rows[0][1]], 1), (5, None, 1), (6, [0.0] * 24, 1), (7, [1.0, None] + [0.0] * 22, 1), (8, [float("nan")] * 24, 1), (9, [float("inf")] + [1.0] * 23, 1), (None, rows[0][1], 1), (2, [], 1), (1, [1.0, 2.0], 1)]
    ok = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: [j for j in ok if j != i and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= 0.95] for i in ok}
    least = {i: i for i, _, _ in rows}
    for _ in rows:
        for i, near in links.items():
            least[i] = min([least[i], *(least[j] for j in near)])
    frame = spark.createDataFrame([(*r, "b", 1) for r in rows], "vec_id long, embedding array<double>, label int, bucket string, id int")
    got = lattice.near_vectors(frame, block=4).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (len(links.get(r.vec_id, [])), least[r.vec_id], r.vec_id is not None and least[r.vec_id] == r.vec_id)


def test_nearest_lattice_points():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)) * 2
    got = lattice.nearest_e8(x)
    near = lattice.short_vectors()
    assert len(near) == 240 and np.allclose((near**2).sum(axis=1), 2)
    gap = ((x - got) ** 2).sum(axis=1)
    assert (gap[:, None] <= ((x[:, None] - got[:, None] - near[None]) ** 2).sum(axis=2) + 1e-9).all() and (gap <= 1 + 1e-9).all()


def edits(a, b):
    """Least edits between a and any substring of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randint(12, 40))) for i in range(12)] + [(50, None), (51, ""), (52, "short"), (None, prose(rng, 20))]
    items += [(60, items[0][1]), (61, items[1][1].upper())]
    rows = []
    for i in range(60):
        text = prose(rng, 40)
        if i % 3 == 0:
            k = rng.randrange(12)
            body = bytearray(items[k][1].encode())
            for _ in range(rng.choice([0, 1, int(0.05 * len(body)), int(0.2 * len(body))])):
                at = rng.randrange(len(body))
                body[at : at + 1] = rng.choice([b"", b"q", b"vv"])
            text = text[:100] + "\n " + body.decode() + "  " + text[100:]
        rows.append((i, text))
    rows += [(None, items[0][1]), (90, None), (91, ""), (92, items[2][1]), (92, items[2][1]), (93, items[3][1][:-40])]
    items += [(70, "Two  words"), (71, "two words"), (72, "x"), (73, "words two words")]
    rows += [(94, "Two\nwords"), (95, "these two words two words"), (96, "twotwo wordss"), (97, "two"), (98, "words x two"), (99, "short short")]
    got = decontam.leaks(docs_frame(spark, rows), spark.createDataFrame([(*r, "c") for r in items], "item_id long, text string, doc_id string")).collect()
    form = lambda t: b" ".join((t or "").encode().lower().split())
    want = set()
    for i, t in rows:
        for k, x in items:
            a, b = form(x), form(t)
            if i is not None and k is not None and len(a) >= 32:
                d = edits(a, b)
                if d <= len(a) // 10:
                    want.add((i, k, d))
            elif i is not None and k is not None and a and b" " + a + b" " in b" " + b + b" ":
                want.add((i, k, 0))
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == want and len(got) == len(want) and len(want) > 15
    text = {i: form(t) for i, t in rows if i is not None}
    item = {k: form(t) for k, t in items if k is not None}
    assert all(edits(item[r.item_id], text[r.doc_id][r.start : r.end]) <= r.distance for r in got)


def test_embedding_parts_near_from_far():
    """Windows of edited items meet them in at least 0.98 of cases, unrelated windows are refused in at least 0.95."""
    rng, dice = random.Random(19), np.random.default_rng(19)
    texts = [prose(rng, rng.randint(18, 60)).lower().encode() for _ in range(120)]
    times = decontam.repetitions(texts, 0.1, 0.999, 6, 32)
    items = decontam.Items(list(enumerate(texts)), 0.1, 6, 32, times, 32)
    as_bytes = lambda ts: [np.frombuffer(t, dtype=np.uint8) for t in ts]
    own = items.samples(as_bytes(texts))
    near = [(decontam.edited(t, len(t) // 10, dice) + b" and some more of it")[: len(t)].ljust(len(t), b"-") for t in texts]
    far = [(texts[i - 1] * 9)[: len(t)] for i, t in enumerate(texts)]
    assert (items.samples(as_bytes(near)) == own).any(axis=1).mean() >= 0.98
    assert (items.samples(as_bytes(far)) == own).any(axis=1).mean() <= 0.05


def test_repeated_pieces_count_once(monkeypatch):
    """Runs of diagonals need different pieces, as brute force says; texts that repeat one piece of an item embed no window."""
    rng = random.Random(23)
    texts = [prose(rng, 40).lower().encode()[: rng.randint(80, 240)] for _ in range(6)] + [b"the the " * 3 + prose(rng, 30).lower().encode()]
    items = decontam.Items(list(enumerate(texts)), 0.1, 6, 4, 1, 32)
    pick = lambda t: t[8 * (at := rng.randrange(len(t) // 8 - 3)) : 8 * at + 8 * rng.randint(1, 12)] + b"." * rng.randint(0, 3)
    docs = [b"".join(pick(rng.choice(texts[:2])) for _ in range(20)) for _ in range(6)] + [b"the " * 500, *texts]
    buf, offs = np.frombuffer(b"".join(docs), dtype=np.uint8), np.cumsum([0, *map(len, docs)])
    found = items.hits(buf, offs)
    hits = list(zip(*(c.tolist() for c in found)))
    want = set()
    for d, k, s, _ in hits:
        run = [h for h in hits if h[:2] == (d, k) and s <= h[2] <= s + items.limit[k]]
        if len({h[3] for h in run}) >= items.need[k]:
            want.update(run)
    assert 0 < len(want) < len(hits)
    assert {h for h, near in zip(hits, items.reached(*found)) if near} == want

    embedded = []
    monkeypatch.setattr(items, "meet", lambda windows, owners: embedded.extend(owners) or np.zeros(len(windows), dtype=bool))
    spam = np.frombuffer(b"the " * 500, dtype=np.uint8)
    assert len(items.hits(spam, np.array([0, len(spam)]))[0]) and not list(items.matches(spam, np.array([0, len(spam)]))) and not embedded


def test_bit_parallel_distance():
    rng = random.Random(9)
    for _ in range(200):
        a, b = (bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40))) for _ in "ab")
        for most in (0, 2, 5):
            assert decontam.within(a, b, most) == (edits(a, b) <= most)
            got = decontam.edit_place(a, b, most)
            assert (got is not None) == (edits(a, b) <= most) and (got is None or got[0] == edits(a, b))


def test_archive(spark):
    long = "x" * 1000
    rows = [(1, "http://a", long), (2, "u\r\nWARC-Type: x", long), (3, None, long), (4, "v", "short"), (5, "v", "short"), (6, None, None), (7, "w", ""), (8, "é", "é" * 600), (9, "z", "é" * 600), (None, "q", long), (9, "z", "é" * 600), (10, "r", "a\r\n\r\nWARC/1.1\r\n" * 90)]
    frame = spark.createDataFrame([(*r, "c", "d") for r in rows], "page_id long, url string, html string, owner string, key string")
    path = scratch_path(spark, "warc")
    warc.write_archive(frame, path)
    got = warc.read_pages(spark, path).collect()
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        owner = max((j for j, _, x in rows if x == h and j is not None), default=None)
        again = len(b) >= 1000 and i is not None and i != owner
        want[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", owner if again else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in rows})
    body = dict((i, (h or "").encode()) for i, _, h in rows)
    for r in warc.read_records(spark, path).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and rest[size:] == b"\r\n\r\n"
        assert rest[:size] == (b"" if r.record_type == "revisit" else body[r.page_id] if r.page_id is not None else long.encode())


def test_archive_rejects_damaged_payloads(spark):
    path = scratch_path(spark, "warc")
    warc.write_archive(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"), path)
    rows = spark.read.parquet(f"{path}/payloads").selectExpr("sha256", "binary('abd') AS payload").collect()
    spark.createDataFrame(rows, "sha256 string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_pages(spark, path).collect()


def test_empty_tables(spark):
    docs = docs_frame(spark, [])
    labels = labelled(spark, [])
    assert minmax.near_duplicates(docs).count() == 0
    assert mixing.score(docs).count() == 0
    assert toxicity.toxicity(docs, labels).count() == 0
    assert quality.quality(docs, labels).count() == 0
    assert pii.find(docs).count() == 0
    assert suffixes.remove_repeats(docs).count() == 0
    assert bpe.encode(docs, tokenizer_path()).count() == 0 and bpe.encoded_digests(docs, tokenizer_path()).count() == 0
    assert lattice.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert decontam.leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_without_labels(spark):
    docs = docs_frame(spark, [(1, "one"), (2, None)])
    assert [r.score for r in toxicity.toxicity(docs, labelled(spark, [])).collect()] == [0.0, 0.0]
    assert [r.score for r in quality.quality(docs, labelled(spark, [])).collect()] == [0.5, 0.5]


def test_clashing_columns(spark):
    rows = [(1, "write to ann@example.org " + "word " * 60, 7, 8, "s"), (2, None, None, None, None), (2, "", 1, 1, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row int, _part int, _spans string")
    got = bpe.encode(df, tokenizer_path(), leaf=64, split=100)
    plain = {r.doc_id: r.ids for r in bpe.encode(df.select("doc_id", "text"), tokenizer_path()).where("doc_id = 1").collect()}
    assert sorted((r.doc_id, r._row or 0, r._part or 0, r._spans or "") for r in got.collect()) == [(1, 7, 8, "s"), (2, 0, 0, ""), (2, 1, 1, "t")]
    assert got.where("doc_id = 1").first().ids == plain[1]
    kept = corpus_pipeline.redact_personal_data(spark, df, "")
    assert kept.columns == df.columns
    assert sorted((r.doc_id, (r.text or "")[:16], r._row or 0, r._spans or "") for r in kept.collect()) == [(1, "write to [email]", 7, "s"), (2, "", 0, ""), (2, "", 1, "t")]


def test_toxicity_learns_from_one_of_each_group_of_copies(spark):
    """A group of ordinary and one of toxic near copies fill neither class's sample; short and empty texts are told apart by all they hold."""
    rng = random.Random(41)
    base = prose(rng, 200).split()
    rows = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(200)] = "other"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, prose(rng, 50)) for i in range(8)] + [(200, "a"), (201, "a"), (202, "b"), (203, ""), (204, None), (None, "c")]
    marks = [(i, 1, int(i % 2 == 0 and i < 100), "") for i, _ in rows if i is not None]
    ids = [r.doc_id for r in toxicity._chosen(docs_frame(spark, rows), labelled(spark, marks), "toxic", 1000).collect()]
    assert sum(i < 60 for i in ids) <= 4 and {100 + i for i in range(8)} <= set(ids)
    assert len(set(ids) & {200, 201}) == 1 and 202 in ids and len(set(ids) & {203, 204}) == 1 and None not in ids


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(11)
    rows, labels = [], []
    for i in range(120):
        w = prose(rng, rng.randint(30, 90)).split()
        if i % 10 == 0:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), "vilescum")
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 10 == 0), None))
    item = prose(rng, 30)
    rows += [(200, rows[1][1]), (201, rows[2][1] + " more"), (202, "q " + item + " r"), (203, "write to jo@ex.org or 10.1.2.3 now"), (204, None), (205, ""), (None, "nobody here"), (203, "write to jo@ex.org or 10.1.2.3 now")]
    docs_frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labelled(spark, labels).drop("text").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    toxic = {r.doc_id for r in toxicity.toxicity(docs_frame(spark, rows), labelled(spark, labels)).collect() if r.predicted}
    assert toxic == {i for i in range(120) if i % 10 == 0}
    left = [(i, t) for i, t in rows if i not in toxic]
    least = linked(left, 5, 80)
    left = list(dict.fromkeys((i, t) for i, t in left if i is None or least[i] == i))
    left = [(i, t) for i, t in left if i != 202]
    masked = dict(left) | {203: "write to [email] or [ip] now"}
    tok = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, _ in left:
        want[i, tuple(tok.encode(masked[i] or "", add_special_tokens=False).ids)] += 1
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert all(r.n_tokens == len(r.ids) and r.decoded == tok.decode(r.ids, skip_special_tokens=False) for r in got)


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(QUERIES) < names and "pipeline" in names and {re.match(r"op(\d+)_", q)[1] for q in QUERIES} == {str(n) for n in range(1, 14)}
