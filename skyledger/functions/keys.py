"""Stable hashes, ranks, slugs and name predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_ratio(name: Column) -> Column:
    """A repeatable number in [0, 1]: the first eight hex digits of the MD5 over 0xFFFFFFFF."""
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / 4294967295.0


def stable_split(name: Column, train: float = 0.8, val: float = 0.1, test: float = 0.1, fixed: Column | None = None) -> Column:
    """train, val or test by stable ratio. With `fixed` (is the name on the fixed test list), listed
    names are test and the rest is divided between train and val only."""
    total = max(1e-9, train + val + test)
    train, val = train / total, val / total
    ratio = stable_ratio(name)
    if fixed is not None:
        share = train / max(1e-9, train + val)
        return F.when(F.coalesce(fixed, F.lit(False)), "test").when(ratio < share, "train").otherwise("val")
    return F.when(ratio < train, "train").when(ratio < train + val, "val").otherwise("test")


def stable_rank(name: Column, salt: str = "") -> Column:
    """SHA-256 of salt + name as hex; sorting by it is a repeatable shuffle."""
    return F.sha2(F.concat(F.lit(salt), name), 256)


def slug(text: Column) -> Column:
    """Lower-case name with runs of other characters as one underscore; over 60 characters it is cut
    to 50 and a short hash of the text is added; empty becomes 'default'."""
    text = F.coalesce(text, F.lit(""))
    core = F.lower(F.btrim(F.regexp_replace(F.trim(text), r"[^\p{L}\p{N}_]+", "_"), F.lit("_")))
    long = F.concat(F.substring(core, 1, 50), F.lit("_"), F.substring(F.md5(text), 1, 6))
    return F.when(F.length(core) > 60, long).when(core == "", "default").otherwise(core)


def batch_slug(prompts: Column) -> Column:
    """Folder name of a batch of prompts: their number and a short hash of the joined list."""
    cleaned = F.filter(F.transform(prompts, lambda p: F.trim(p)), lambda p: p != "")
    digest = F.substring(F.md5(F.array_join(cleaned, "_")), 1, 6)
    return F.concat(F.lit("batch_"), F.greatest(F.size(prompts), F.lit(1)).cast("string"), F.lit("prompts_"), digest)


def safe_name(name: Column) -> Column:
    """Letters, digits, underscore, dot and hyphen only, and not a folder reference."""
    return name.rlike(r"^[A-Za-z0-9_.-]+$") & ~name.isin(".", "..")


def day_of(name: Column) -> Column:
    """The leading YYYY-MM-DD of a file name, or null."""
    day = F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.when(day != "", day)


def moment_of(name: Column) -> Column:
    """Seconds of the day from a YYYY-MM-DD_HH_MM_SS name, or null."""
    part = lambda i: F.regexp_extract(name, r"^\d{4}-\d{2}-\d{2}_(\d{2})_(\d{2})_(\d{2})", i).try_cast("int")
    return part(1) * 3600 + part(2) * 60 + part(3)


def is_timestamp(text: Column) -> Column:
    """A parseable ISO timestamp; a trailing Z counts as UTC."""
    clean = F.regexp_replace(F.trim(text), r"[zZ]$", "+00:00")
    shaped = clean.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?([+-]\d{2}:\d{2})?)?$")
    return F.coalesce(shaped & F.try_to_timestamp(clean).isNotNull(), F.lit(False))


def density_bucket(count: Column) -> Column:
    return F.when(count <= 20, "sparse").when(count <= 60, "medium").when(count <= 100, "dense").otherwise("very_dense")


def size_bucket(short_side: Column) -> Column:
    return F.when(short_side < 16, "<16").when(short_side < 32, "16-32").otherwise(">=32")


def confidence_band(confidence: Column) -> Column:
    value = F.coalesce(confidence, F.lit(0.0))
    return F.when(value < 0.45, "low").when(value < 0.7, "medium").otherwise("high")


def signature(names: Column) -> Column:
    """Sorted distinct class names joined by +, 'background' when there are none."""
    joined = F.array_join(F.array_sort(F.array_distinct(names)), "+")
    return F.when(F.coalesce(joined, F.lit("")) == "", "background").otherwise(joined)
