"""Repair of conversations by generalised LR parsing with weighted edits.

The role grammar (an optional system turn, then pairs of user and assistant) becomes an LR automaton. Turns are read in order by a
graph-structured stack whose nodes are LR states linked to the nodes below them; every turn may be kept, given another role or deleted, and empty
turns may be inserted before it. Equal stack tops are merged by the least (cost, audit).

Turns of one conversation need not meet in one task. All turns are range-partitioned by (conversation, turn, role, text), a chunk is parsed from
every stack top it may be entered with, and the few numbers a chunk leaves are chained per conversation; only then are turns edited, each chunk
from the one top it is entered with to the one top it is left with.

Two edit strings of the same turns, both of which end in the letter of a turn, are equal or differ within the shorter one. So hypotheses are kept as
(cost, rank among the living, link to what was before) and never as growing strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import cut, drop, tasks

#: The role grammar: role initials are its terminals, capital letters its other symbols.
RULES = (("S", ""), ("S", "T"), ("S", "sT"), ("T", "ua"), ("T", "Tua"))
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5


class Automaton:
    """The LR(0) automaton of the rules. A stack is a linked list (state, rest); reductions that do not end the text are done at once."""

    def __init__(self, rules=RULES, start="S"):
        self.rules, self.start = rules, start
        first = self._close({(i, 0) for i, (left, _) in enumerate(rules) if left == start})
        self.states, self.goto = [first], {}
        for at, items in enumerate(self.states):
            for symbol in sorted({rules[i][1][d] for i, d in items if d < len(rules[i][1])}):
                moved = self._close({(i, d + 1) for i, d in items if d < len(rules[i][1]) and rules[i][1][d] == symbol})
                if moved not in self.states:
                    self.states.append(moved)
                self.goto[at, symbol] = self.states.index(moved)
        #: One stack for every top that a read prefix can leave; what may follow depends on the top alone in this grammar.
        self.stacks = {0: (0, None)}
        self.after: dict[tuple[int, str], int] = {}
        todo = [0]
        while todo:
            top = todo.pop()
            for role in "asu":
                moved = self._shift(self.stacks[top], role)
                if moved is not None:
                    self.after[top, role] = moved[0]
                    if moved[0] not in self.stacks:
                        self.stacks[moved[0]] = moved
                        todo.append(moved[0])
        self.tops = sorted(self.stacks)
        self.endings = {t: self._ending(t) for t in self.tops}

    def _close(self, items):
        items = set(items)
        while True:
            more = {(j, 0) for i, d in items if d < len(self.rules[i][1]) for j, (left, _) in enumerate(self.rules) if left == self.rules[i][1][d]}
            if more <= items:
                return frozenset(items)
            items |= more

    def _shift(self, stack, role):
        state = self.goto.get((stack[0], role))
        return None if state is None else self._reduce((state, stack))

    def _reduce(self, stack):
        while True:
            done = [i for i, d in self.states[stack[0]] if d == len(self.rules[i][1]) and d and self.rules[i][0] != self.start]
            if not done:
                return stack
            left, right = self.rules[done[0]]
            for _ in right:
                stack = stack[1]
            stack = (self.goto[stack[0], left], stack)

    def accepts(self, top: int) -> bool:
        return any(d == len(self.rules[i][1]) and self.rules[i][0] == self.start for i, d in self.states[top])

    def _ending(self, top: int) -> str:
        """The roles of the fewest insertions that end the text after this top."""
        front = [(top, "")]
        while True:
            ready = [roles for t, roles in front if self.accepts(t)]
            if ready:
                return ready[0]
            front = [(self.after[t, r], roles + r) for t, roles in front for r in ROLES if (t, r) in self.after]

    def inserted(self, top: int, most: int = 2):
        """(top, roles) for every run of up to `most` insertions."""
        runs = front = [(top, "")]
        for _ in range(most):
            front = [(self.after[t, r], roles + r) for t, roles in front for r in ROLES if (t, r) in self.after]
            runs = runs + front
        return runs


AUTOMATON = Automaton()


def _moves(initial: str) -> dict[int, list[tuple[int, int, str, str]]]:
    """For every top: (top afterwards, cost, audit, roles) of reading one turn with this initial that is not deleted."""
    got = {}
    for top in AUTOMATON.tops:
        got[top] = []
        for t, roles in AUTOMATON.inserted(top):
            for r, letter, cost in [(initial, "K", KEEP), *[(r, "R", REROLE) for r in ROLES if r != initial]]:
                if (t, r) in AUTOMATON.after:
                    got[top].append((AUTOMATON.after[t, r], cost + INSERT * len(roles), "I" * len(roles) + letter, roles + r))
    return got


MOVES = {r: _moves(r) for r in ("s", "u", "a", "")}


class Parse:
    """The frontier of the graph-structured stack after some turns: top -> (cost, rank, link).

    A link is (link before, audit of the step, roles of the step, repeats). Turns that must go do not part hypotheses: an insertion before a deletion is
    worse than the same insertion after it, so they cost the same for all and are told by their number.
    """

    def __init__(self, top: int):
        self.front = {top: (0, 0, None)}

    def delete(self, times: int) -> None:
        if times:
            self.front = {t: (c + DELETE * times, rank, (link, "D", "", times)) for t, (c, rank, link) in self.front.items()}

    def read(self, initial: str, truncated: bool) -> None:
        moves = MOVES[initial if initial in MOVES else ""]
        more = TRUNCATED if truncated else 0
        best: dict[int, tuple] = {}
        for top, (cost, rank, link) in self.front.items():
            options = [(top, DELETE, "D", "")] + [(t, c + more, audit, roles) for t, c, audit, roles in moves[top]]
            for t, c, audit, roles in options:
                key = (cost + c, rank, audit)
                if t not in best or key < best[t][:3]:
                    best[t] = (*key, link, roles)
        order = {t: i for i, t in enumerate(sorted(best, key=lambda t: best[t][1:3]))}
        self.front = {t: (c, order[t], (link, audit, roles, 1)) for t, (c, _, audit, link, roles) in best.items()}

    def steps(self, top: int) -> list[tuple[str, str, int]]:
        """(audit, roles, repeats) of the steps that lead to this top."""
        out, link = [], self.front[top][2]
        while link is not None:
            out.append(link[1:])
            link = link[0]
        return out[::-1]


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows after damage by crc32('conv_id:turn') % 20; null roles and texts are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (
        rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("_d")).where("_d <> 0")
        .select("conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
        .drop("_copy")
    )


class Chunks:
    """Turns in order, with their faults, written in range partitions (chunks).

    Columns: c (the conversation, '' for null), chunk, pos (rising within a chunk), turn, role, text, initial, blank, again (the same role and text at an
    earlier turn), truncated, times (equal rows of one turn; all but the first repeat it).
    """

    def __init__(self, rows: DataFrame):
        bare = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
        c = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
        text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
        role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
        runs = cut(
            rows.select(c.alias("c"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
            .groupBy("c", "turn", "role", "text").agg(F.count(F.lit(1)).alias("times"))
            .withColumn("key", F.sha2(F.concat_ws("\0", "role", "text"), 256)),
            "turns",
        )
        # Only what is said at several turns needs a look at the first of them; nulls come first.
        low = F.coalesce(F.col("turn"), F.lit(-(1 << 63)))
        seen = cut(
            runs.groupBy("c", "key").agg(F.min(low).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("c", "key", "first"), "seen"
        )
        tail = F.substring(bare, -1, 1)
        marked = runs.join(seen, ["c", "key"], "left").select(
            "c", "turn", "role", "text", "times", F.substring("role", 1, 1).alias("initial"), (F.length(bare) == 0).alias("blank"),
            F.coalesce(F.col("first") < low, F.lit(False)).alias("again"), (~tail.isin(".", "!", "?")).alias("truncated"),
        )
        order = ["c", F.col("turn").asc_nulls_first(), "role", "text"]
        number = F.monotonically_increasing_id()
        self.rows = cut(
            marked.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", number).withColumn("chunk", F.shiftright("pos", 33)), "ordered"
        )
        self.written = [runs, seen, self.rows]


_PART = ("c string, chunk long, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
         "turns long, low long, high long, entry int, exit int, cost long, rank int")


def _faults(blank: bool, again: bool, truncated: bool) -> str:
    return "blank" if blank else "duplicate" if again else "truncated" if truncated else ""


class _Facts:
    """Counts of a conversation's turns within a chunk."""

    def __init__(self):
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn, initial, fault, times):
        if self.n == 0:
            self.first = initial
        elif self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.illegal += times - 1
        self.last = initial
        self.n += times
        self.blank += times if fault == "blank" else 0
        self.duplicate += (times if fault == "duplicate" else times - 1) if fault != "blank" else 0
        self.truncated += fault == "truncated"
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn


def _chunk_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What every chunk tells about every conversation in it; all tops are tried for the chunk's first conversation only, as others begin there."""
    out, now, facts, parses, chunk = [], None, None, {}, None

    def close():
        if now is None:
            return
        head = (now[1], now[0], facts.n, facts.blank, facts.duplicate, facts.truncated, facts.illegal, facts.first, facts.last, facts.turns, facts.low, facts.high)
        for entry, parse in parses.items():
            for top, (cost, rank, _) in parse.front.items():
                out.append((*head, entry, top, cost, rank))

    for batch in batches:
        for k, c, turn, initial, blank, again, truncated, times in zip(*[batch.column(n).to_pylist() for n in ("chunk", "c", "turn", "initial", "blank", "again", "truncated", "times")]):
            if (k, c) != now:
                close()
                parses = {t: Parse(t) for t in (AUTOMATON.tops if k != chunk else [0])}
                now, facts, chunk = (k, c), _Facts(), k
            fault = _faults(blank, again, truncated)
            facts.add(turn, initial, fault, times)
            gone = fault in ("blank", "duplicate")
            for parse in parses.values():
                if not gone:
                    parse.read(initial, fault == "truncated")
                parse.delete(times if gone else times - 1)
        if len(out) > 20_000:
            yield _batch(out, _PART)
            out.clear()
    close()
    if out:
        yield _batch(out, _PART)


_PLAN = ("c string, chunk long, chunks int, place int, entry int, exit int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")


def _chain(rows: list[dict]) -> list[tuple]:
    """The chunks of one conversation chained: which top each is entered and left with, and the conversation's figures.

    A conversation has as many rows here as chunks times pairs of tops, however many turns it has.
    """
    chunks: dict[int, tuple[dict, dict]] = {}
    for r in rows:
        _, paths = chunks.setdefault(r["chunk"], (r, {}))
        paths.setdefault(r["entry"], []).append((r["exit"], r["cost"], r["rank"]))
    order = sorted(chunks)
    front, links = {0: (0, 0)}, []
    figures = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    turns, low, high, last = 0, None, None, None
    for k in order:
        facts, paths = chunks[k]
        for name in figures:
            figures[name] += facts[name]
        figures["illegal"] += last is not None and last + facts["first"] not in ("su", "ua", "au")
        last = facts["last"]
        if facts["low"] is not None:
            turns += facts["turns"] - (facts["low"] == high)
            low, high = facts["low"] if low is None else low, facts["high"]
        best: dict[int, tuple] = {}
        for top, (cost, rank) in front.items():
            for leave, c, r in paths[top]:
                key = (cost + c, rank, r)
                if leave not in best or key < best[leave][:3]:
                    best[leave] = (*key, top)
        links.append({t: b[3] for t, b in best.items()})
        ranked = {t: i for i, t in enumerate(sorted(best, key=lambda t: best[t][1:3]))}
        front = {t: (best[t][0], ranked[t]) for t in best}
    total, _, top = min((c + INSERT * len(AUTOMATON.endings[t]), rank, t) for t, (c, rank) in front.items())
    path = [top]
    for link in reversed(links):
        path.append(link[path[-1]])
    path.reverse()
    gaps = 0 if low is None else high - low + 1 - turns
    return [(rows[0]["c"], k, len(order), i, path[i], path[i + 1], gaps, *figures.values(), total) for i, k in enumerate(order)]


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_chain for each conversation, whose rows arrive side by side."""
    held: list[dict] = []
    out: list[tuple] = []
    for batch in batches:
        for r in batch.to_pylist():
            if held and held[0]["c"] != r["c"]:
                out += _chain(held)
                held = []
            held.append(r)
        if len(out) > 20_000:
            yield _batch(out, _PLAN)
            out = []
    if held:
        out += _chain(held)
    if out:
        yield _batch(out, _PLAN)


_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(v, _KINDS[k]) for v, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])


_EDIT = "c string, place int, step long, edit string, turn long, role string, text string"


class Repair:
    """Parsed conversations, ready to be edited: `turns` with the plan of their chunk, in order."""

    def __init__(self, rows: DataFrame):
        """rows: conv_id, turn, role, text; other columns are left out. Null roles and texts count as one space."""
        chunks = Chunks(rows)
        n = tasks(rows)
        light = chunks.rows.select("chunk", "pos", "c", "turn", "initial", "blank", "again", "truncated", "times")
        parts = light.repartition(n, "chunk").sortWithinPartitions("pos").mapInArrow(_chunk_parts, _PART)
        self.plan = cut(parts.repartition(n, "c").sortWithinPartitions("c", "chunk").mapInArrow(_chained, _PLAN), "plan")
        self.turns = (
            chunks.rows.join(self.plan.select("c", "chunk", "chunks", "place", "entry", "exit"), ["c", "chunk"])
            .repartition(n, "c", "chunk").sortWithinPartitions("c", "chunk", "pos")
        )
        self.written = [*chunks.written, self.plan]

    def edits(self) -> DataFrame:
        """The edits of every conversation: c, place (of the chunk), step, edit (K, R, D or I), turn, role, text (of the turn as it is now)."""
        def run(batches):
            for head, steps in _edited(batches):
                rows = [(head["c"], head["place"], i, *s) for i, s in enumerate(steps)]
                for a in range(0, len(rows), 4096):
                    yield _batch(rows[a : a + 4096], _EDIT)

        return self.turns.mapInArrow(run, _EDIT)

    def digests(self) -> DataFrame:
        """c, audit, repaired_sha256. A conversation within one chunk is digested where it is edited; the pieces of one that spans several are streamed
        in order through one digest, as a digest of a concatenation cannot be taken apart."""
        pieces = cut(self.turns.mapInArrow(_pieces, _PIECE), "pieces")
        self.written.append(pieces)
        done = pieces.where("digest IS NOT NULL").select("c", "audit", F.col("digest").alias("repaired_sha256"))
        spread = pieces.where("digest IS NULL").repartition(tasks(pieces), "c").sortWithinPartitions("c", "place", "piece")
        return done.unionByName(spread.mapInArrow(_streamed, _DIGEST))


def _edited(batches: Iterator[pa.RecordBatch]):
    """(head row, [(edit, turn, role, text)]) of each (conversation, chunk), whose turns arrive side by side in order."""
    held: list[dict] = []

    def finish():
        head = held[0]
        parse = Parse(head["entry"])
        for r in held:
            fault = _faults(r["blank"], r["again"], r["truncated"])
            gone = fault in ("blank", "duplicate")
            if not gone:
                parse.read(r["initial"], fault == "truncated")
            parse.delete(r["times"] if gone else r["times"] - 1)
        # A step belongs to one stored turn, but for the deletions of its repeats, which follow it.
        steps, out = iter(parse.steps(head["exit"])), []
        for r in held:
            fault = _faults(r["blank"], r["again"], r["truncated"])
            left = r["times"]
            if fault not in ("blank", "duplicate"):
                audit, roles, _ = next(steps)
                out += [("I", None, ROLES[x], "") for x in roles[: audit.count("I")]]
                letter = audit[-1]
                out.append((letter, r["turn"], ROLES[roles[-1]] if letter == "R" else r["role"], r["text"]))
                left -= 1
            if left:
                next(steps)
                out += [("D", r["turn"], r["role"], r["text"])] * left
        if head["place"] == head["chunks"] - 1:
            out += [("I", None, ROLES[x], "") for x in AUTOMATON.endings[head["exit"]]]
        return head, out

    for batch in batches:
        for r in batch.to_pylist():
            if held and (r["c"], r["chunk"]) != (held[0]["c"], held[0]["chunk"]):
                yield finish()
                held = []
            held.append(r)
    if held:
        yield finish()


_DIGEST = "c string, audit string, repaired_sha256 string"
_PIECE = "c string, place int, piece int, audit string, body string, kept boolean, digest string"


def _pieces(batches):
    rows: list[tuple] = []
    size = 0

    for head, steps in _edited(batches):
        lines = [f"{role}:{text}" for edit, _, role, text in steps if edit != "D"]
        audit = "".join(s[0] for s in steps)
        if head["chunks"] == 1:
            rows.append((head["c"], 0, 0, audit, None, None, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
            size += len(audit)
        else:
            # Pieces of a few hundred lines, so that no value grows with a chunk.
            for k, a in enumerate(range(0, max(1, len(steps)), 512)):
                part = steps[a : a + 512]
                lines = [f"{role}:{text}" for edit, _, role, text in part if edit != "D"]
                body = "\n".join(lines)
                rows.append((head["c"], head["place"], k, "".join(s[0] for s in part), body, bool(lines), None))
                size += len(body) + len(part)
                if size > 1 << 22:
                    yield _batch(rows, _PIECE)
                    rows, size = [], 0
        if size > 1 << 22 or len(rows) > 8192:
            yield _batch(rows, _PIECE)
            rows, size = [], 0
    if rows:
        yield _batch(rows, _PIECE)


def _streamed(batches):
    now, digest, audit, some = None, None, [], False

    def finish():
        return _batch([(now, "".join(audit), digest.hexdigest())], _DIGEST)

    for batch in batches:
        for c, letters, body, kept in zip(*[batch.column(n).to_pylist() for n in ("c", "audit", "body", "kept")]):
            if c != now:
                if now is not None:
                    yield finish()
                now, digest, audit, some = c, hashlib.sha256(), [], False
            audit.append(letters)
            if kept:
                digest.update((("\n" if some else "") + body).encode())
                some = True
    if now is not None:
        yield finish()


def repair(rows: DataFrame) -> DataFrame:
    """The repaired turns of every conversation: conv_id, place, edit, turn, role, text, in the order of (conv_id, place, step).

    rows: conv_id, turn, role, text. Null roles and texts are one space, null turns come first and count as no gap, rows of one turn are ordered by role
    and text, equal rows repeat one another, rows with a null conv_id are one conversation; other columns are left out.
    """
    ids = rows.select("conv_id").distinct().withColumn("c", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    return Repair(rows).edits().where("edit <> 'D'").join(ids, "c").select("conv_id", "place", "step", "edit", "turn", "role", "text")


def audit(rows: DataFrame, original: DataFrame) -> DataFrame:
    """One row per conv_id of `original` about the turns in `rows`: gaps, faults, cost, audit and the digest of the repaired text.

    A conversation without rows has zeros, an empty audit and the digest of nothing. See repair() for nulls and ties.
    """
    made = Repair(rows)
    figures = made.plan.where("place = 0").select("c", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    ids = original.select("conv_id").distinct().withColumn("c", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    numbers = [F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    out = cut(
        ids.join(figures, "c", "left").join(made.digests(), "c", "left").select(
            "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
        ),
        "repaired",
    )
    drop(*made.written)
    return out
