"""Personal data: patterns for e-mail, IP address, card and phone, extended by bootstrapped contextual extraction.

The base matches are seeds. Words left of a seed make a lexical pattern; patterns and the values that they were seen
with form a graph, over which scores are passed for a few rounds: a pattern is as good as the share of known values
among all identifier-like values behind it, a value as likely as its patterns make it. Patterns of high confidence then
mark values that the base patterns do not know. DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.common import cut

KINDS = ("email", "ip", "card", "phone")
# Equal in their matches to the patterns named in the README. A start inside a run of its first class cannot match unless the run's
# own start does, so only run starts and ends of matches are tried; what cannot be given back is taken possessively, so long
# runs take neither quadratic time nor deep recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A word with a digit or an at sign: what may be an identifier.
CANDIDATE = r"(?<!\S)(?=[^\s0-9@]*+[0-9@])\S++"


def _kept(kind: str, m: Column) -> Column:
    """Whether a match counts."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(
            F.split(m, r"\."), lambda p: F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(0)) <= 255
        )
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def located(text: Column, kind: int, pattern: str, must: str | None = None, cue: bool = False) -> Column:
    """(kind, i, skip, m, cue) for every match in order: skip is the length of the text between it and the match before.

    The pieces between matches and the matches themselves, laid end to end, are the text, so running sums of lengths give the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if must:
        found = F.when(F.contains(text, F.lit(must)), found).otherwise(F.array().cast("array<string>"))
    between = F.split(text, pattern, -1)

    def one(m, i):
        before = F.element_at(between, (i + 1).cast("int"))
        # Sixty-four code points hold any two words worth a pattern; longer words are cut alike everywhere.
        words = F.regexp_replace(F.lower(F.trim(F.regexp_extract(F.right(before, F.lit(64)), r"(\S+\s+)?\S+\s+$", 0))), r"\s+", " ")
        return F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), F.length(before).alias("skip"), m.alias("m"), (words if cue else F.lit("")).alias("cue"))

    return F.transform(found, one)


WORD = len(KINDS)


def _places(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id, text_key) and the matches in them (row, kind, start, stop, m, cue), words included as kind WORD."""
    must = {"email": "@", "ip": ".", "phone": "+"}
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    lists = [located(F.col("text"), k, PATTERNS[name], must.get(name)) for k, name in enumerate(KINDS)]
    lists.append(located(F.col("text"), WORD, CANDIDATE, None, True))
    # The row numbers hold because the table is written before it is used.
    marked = cut(raw.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_key"), F.concat(*lists).alias("found")), "pii")
    each = marked.select("row", F.explode("found").alias("f")).select("row", "f.*")
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("skip") + F.length("m")).over(before)
    placed = each.withColumn("stop", stop.cast("int")).withColumn("start", (F.col("stop") - F.length("m")).cast("int"))
    return marked.select("row", "doc_id", "text_key"), placed.select("row", "kind", "start", "stop", "m", "cue")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _candidates(placed: DataFrame) -> DataFrame:
    """Identifier-like words without the punctuation around them: (row, start, stop, cue, value)."""
    lead = F.length(F.regexp_extract("m", r"^[(\[<\"']*", 0))
    value = F.regexp_replace(F.regexp_replace("m", r"^[(\[<\"']+", ""), r"[.,;:!?)\]>\"']+$", "")
    words = placed.where(F.col("kind") == WORD).select("row", (F.col("start") + lead).alias("start"), "cue", value.alias("value"))
    return words.where("value <> ''").select("row", "start", (F.col("start") + F.length("value")).alias("stop"), "cue", F.lower("value").alias("value"))


def _seeds(words: DataFrame, base: DataFrame) -> DataFrame:
    """Words with the kind of the base match that begins in them (null: no base match touches them); later words of a match are left out.

    One pass over the spans of a row in order of their starts, and one in the other direction.
    """
    both = words.withColumn("kind", F.lit(WORD)).unionByName(base.select("row", "start", "stop", F.lit("").alias("cue"), F.lit("").alias("value"), "kind"))
    is_base = F.col("kind") < WORD
    past = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("left", F.max(F.when(is_base, F.struct("stop", "start", "kind"))).over(past)).withColumn(
        "right", F.min(F.when(is_base, F.struct("start", "kind"))).over(ahead)
    ).where(~is_base)
    inside = F.col("left.stop") > F.col("start")
    reaches = F.col("right.start") < F.col("stop")
    kind = F.when(inside, F.col("left.kind")).when(reaches, F.col("right.kind"))
    usable = ~F.coalesce(inside & (F.col("left.start") < F.col("start")), F.lit(False))
    return seen.where(usable & (F.col("cue") != "")).select("row", "start", "stop", "cue", "value", kind.alias("kind"))


def _learn(seen: DataFrame, rounds: int, prior: float, least_values: int) -> DataFrame:
    """cue -> score of each kind, from occurrences (cue, value, kind of the seed or null)."""
    grouped = seen.groupBy("cue", "value").agg(F.count(F.lit(1)).alias("n"), *[F.max(F.when(F.col("kind") == k, 1.0).otherwise(0.0)).alias(f"s{k}") for k in range(len(KINDS))])
    edges = cut(grouped, "edges")
    ks = range(len(KINDS))
    values = edges.groupBy("value").agg(*[F.max(f"s{k}").alias(f"v{k}") for k in ks])
    seeds = cut(values, "values")
    current, cues = seeds, None
    light = edges.select("cue", "value", "n")
    for r in range(rounds):
        cues = light.join(current, "value").groupBy("cue").agg(
            *[
                F.when(F.sum((F.col(f"v{k}") > 0.5).cast("int")) >= least_values, F.sum(F.col("n") * F.col(f"v{k}")) / (F.sum("n") + prior)).otherwise(0.0).alias(f"p{k}")
                for k in ks
            ]
        ).where(F.greatest(*[F.col(f"p{k}") for k in ks]) > 0)
        cues = cut(cues, "cues")
        if r + 1 < rounds:
            spread = light.join(cues, "cue").groupBy("value").agg(*[(1 - F.exp(F.sum(F.log(1 - F.least(f"p{k}", F.lit(0.999999)))))).alias(f"w{k}") for k in ks])
            current = cut(seeds.join(spread, "value", "left").select("value", *[F.greatest(f"v{k}", F.coalesce(f"w{k}", F.lit(0.0))).alias(f"v{k}") for k in ks]), "values")
    return cues


def find(docs: DataFrame, rounds: int = 3, confidence: float = 0.9, prior: float = 3.0, least_values: int = 3) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans (all, written), n_learned, and the spans themselves
    (`found`: start, kind number, end; code points), for every row of docs, with a hash of the text (`text_key`).

    A null or empty text has no spans. Learned spans lie outside all base spans and carry the kind of their pattern, the
    first listed when two are as likely. A pattern needs `least_values` different values and a share of known ones of
    `confidence` over (all + prior). Rows that repeat a text get the same spans; a null doc_id is kept.
    """
    rows, placed = _places(docs)
    good = F.lit(False)
    for k, name in enumerate(KINDS):
        good = F.when(F.col("kind") == k, _kept(name, F.col("m"))).otherwise(good)
    base = placed.where(F.col("kind") < WORD).where(F.coalesce(good, F.lit(False))).select("row", "kind", "start", "stop")
    seen = cut(_seeds(_candidates(placed), base), "seeds")
    cues = _learn(seen.select("cue", "value", "kind"), rounds, prior, least_values)
    best = F.greatest(*[F.col(f"p{k}") for k in range(len(KINDS))])
    kind = F.coalesce(*[F.when(F.col(f"p{k}") == best, F.lit(k)) for k in range(len(KINDS))])
    sure = cues.where(best >= confidence).select("cue", kind.alias("kind"))
    learned = seen.where("kind IS NULL").drop("kind").join(sure, "cue").select("row", "kind", "start", "stop")
    span = F.struct("start", "kind", "stop")
    every = base.withColumn("own", F.lit(True)).unionByName(learned.withColumn("own", F.lit(False))).groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(F.col("own"), span))).alias("base"), F.array_sort(F.collect_list(span)).alias("found"), F.count(F.when(~F.col("own"), 1)).alias("n_learned")
    )
    none = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    out = rows.join(every, "row", "left").select(
        "doc_id", "text_key", F.coalesce("base", none).alias("base"), F.coalesce("found", none).alias("found"), F.coalesce("n_learned", F.lit(0).cast("long")).alias("n_learned")
    )
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id", *[number(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"), "n_learned", "found", "text_key",
    )


def redact(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in brackets; of spans that overlap, what the first leaves of the next goes with it."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    got = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["kind"] + 1))).otherwise(acc["out"]).alias("out"),
        ),
    )
    rest = F.substring(text, got["at"] + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(got["out"], rest)).otherwise(text)
