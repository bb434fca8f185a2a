"""Label data quality: object flags, dataset audits, gates, review queues and sanitizing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import boxes as bx
from skyledger.functions import polygons as pg
from skyledger.operators.overlap import overlap_pairs
from skyledger.session import cut, drop

CELL = 0.0625  # grid cell for normalised coordinates


@dataclass(frozen=True)
class QualityPolicy:
    # Default limits of the quality gate.
    enforce: bool = True
    require_fixed_test: bool = True
    require_golden_manifest: bool = True
    require_review_provenance: bool = True
    min_human_review_fraction: float = 0.05
    min_test_images: int = 100
    max_object_area_ratio: float = 0.08
    max_oversized_fraction: float = 0.005
    max_aspect_ratio: float = 8.0
    max_extreme_aspect_fraction: float = 0.01
    max_duplicate_fraction: float = 0.005
    max_class_conflict_fraction: float = 0.002
    max_objects_per_image: int = 120
    geometry_exempt_classes: tuple[str, ...] = ("parking_area",)
    min_conflict_iou: float = 0.90
    min_area: float = 1e-8


def parse_label_lines(lines: DataFrame, *, value: str = "value", form: str = "obb") -> DataFrame:
    """Split label text into class_id and coords. token_error marks a wrong token count, malformed
    marks any line that cannot be used."""
    tokens = F.split(F.trim(F.col(value)), r"\s+")
    n = F.size(tokens) - 1
    fits = (n == 8) if form == "obb" else ((n >= 6) & (n % 2 == 0))
    numbers = F.transform(F.slice(tokens, 2, F.size(tokens)), lambda t: t.try_cast("double"))
    class_id = F.element_at(tokens, 1).try_cast("int")
    bad = ~fits | class_id.isNull() | F.exists(numbers, lambda v: v.isNull())
    return lines.select(
        *lines.columns,
        (~fits).alias("token_error"),
        bad.alias("malformed"),
        F.when(~bad, class_id).alias("class_id"),
        F.when(~bad, numbers).alias("coords"),
    )


def _rounded(v: Column) -> Column:
    """F.round(v, 6) without its decimal numbers, unless v is large or so near a tie that arithmetic could turn it."""
    k = F.rint(v * 1e6)
    plain = (F.abs(v) < 1e6) & (F.abs(v * 1e6 - k) < 0.499)
    return F.when(plain, k / 1e6 + 0.0).otherwise(F.round(v, 6))


def flag_objects(objects: DataFrame, policy: QualityPolicy = QualityPolicy(), *, class_name: str = "class_name",
                 form: str = "obb") -> DataFrame:
    """Add area, bounds, geometry flags and a rounded key to label objects that carry coords
    ARRAY<DOUBLE>. Four-point labels use scalar arithmetic, polygons array functions."""
    checked = ~F.coalesce(F.col(class_name).isin(list(policy.geometry_exempt_classes)), F.lit(False))
    if form == "obb":
        c = pg.quad(F.col("coords"))
        area, aspect = pg.quad_area(c), pg.quad_aspect(c)
        low, high = F.least(*c), F.greatest(*c)
        bounds = (F.least(*c[::2]), F.least(*c[1::2]), F.greatest(*c[::2]), F.greatest(*c[1::2]))
    else:
        ring = pg.points(F.col("coords"))
        area, aspect, bounds = pg.area(ring), pg.aspect_ratio(ring), pg.bounds(ring)
        low, high = F.array_min("coords"), F.array_max("coords")
    # Scalars where there are four points. The array function beside them keeps the step out of whole-stage code, which flags and
    # key would carry past the size up to which the JVM compiles a method.
    four = F.array(*[_rounded(v) for v in pg.quad(F.col("coords"))])
    rounded = F.when(F.size("coords") == 8, four).otherwise(F.transform("coords", _rounded))
    border = (low <= 1e-6) | (high >= 1 - 1e-6)
    return objects.select(
        *objects.columns,
        area.alias("area"),
        *[v.alias(n) for v, n in zip(bounds, bx.BOX)],
        ((low < 0) | (high > 1)).alias("out_of_bounds"),
        (area <= policy.min_area).alias("degenerate"),
        (checked & (area >= policy.max_object_area_ratio)).alias("oversized"),
        (checked & (aspect >= policy.max_aspect_ratio)).alias("extreme_aspect"),
        border.alias("border_touching"),
        rounded.alias("coords_key"),
    )


def duplicate_counts(objects: DataFrame, keys: list[str]) -> DataFrame:
    """Exact copies beyond the first per (keys, class, coords), as a combinable aggregate."""
    groups = objects.groupBy(*keys, "class_id", F.col("coords_key").alias("_c")).agg(F.count(F.lit(1)).alias("n"))
    return groups.groupBy(*keys).agg(F.sum(F.col("n") - 1).alias("duplicates"))


def class_conflicts(flagged: DataFrame, keys: list[str], policy: QualityPolicy = QualityPolicy()) -> DataFrame:
    """Pairs of objects of different classes whose bounds have IoU >= 0.90, counted per file.

    Equal bounds of one class are collapsed to one row with a count, so copies are multiplied, not
    paired. An object without a class is in no conflict.
    """
    per_class = flagged.where(F.col("class_id").isNotNull() & bx.is_valid(bx.box())).groupBy(*keys, *bx.BOX, "class_id").agg(F.count(F.lit(1)).alias("m"))
    nodes = cut(per_class, "conflicts").withColumn("node", F.struct("class_id", "m"))
    # Each pair comes once, with the lesser class first.
    pairs = overlap_pairs(nodes, None, group=keys, id_col="node", min_iou=policy.min_conflict_iou, base=CELL)
    return pairs.where(F.col("a_id.class_id") != F.col("b_id.class_id")).groupBy(*keys).agg(F.sum(F.col("a_id.m") * F.col("b_id.m")).alias("class_conflicts"))


FLAGS = ("out_of_bounds", "degenerate", "oversized", "extreme_aspect", "border_touching")
COUNTERS = ("objects", *FLAGS, "duplicates", "class_conflicts", "overcrowded_images")


def audit_files(flagged: DataFrame, keys: list[str], policy: QualityPolicy = QualityPolicy()) -> DataFrame:
    """One row of counters per label file; everything later is a roll-up of this. The flags are
    written once: filters on them would otherwise be pushed into the arithmetic and repeat it."""
    flagged = cut(flagged.select(*keys, "class_id", "coords_key", *bx.BOX, *FLAGS), "flags")
    counts = flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("objects"), *[F.count_if(F.col(f)).alias(f) for f in FLAGS]
    )
    joined = counts.join(duplicate_counts(flagged, keys), keys, "left").join(class_conflicts(flagged, keys, policy), keys, "left")
    return joined.select(
        *keys, "objects", *FLAGS,
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("duplicates", "class_conflicts")],
        (F.col("objects") > policy.max_objects_per_image).cast("bigint").alias("overcrowded_images"),
    )


def audit_by_split(files: DataFrame, split: str = "split") -> DataFrame:
    """Counters per split and for the whole set (split null becomes 'all')."""
    return files.rollup(split).agg(F.count(F.lit(1)).alias("label_files"), *[F.sum(c).alias(c) for c in COUNTERS]).withColumn(
        split, F.coalesce(split, F.lit("all"))
    )


def review_queue(files: DataFrame, keys: list[str]) -> DataFrame:
    """The sorted issue codes of every file that has any."""
    # Issue codes.
    codes = {
        "out_of_bounds": "OUT_OF_BOUNDS", "degenerate": "DEGENERATE", "oversized": "OVERSIZED_OBJECT",
        "extreme_aspect": "EXTREME_ASPECT", "duplicates": "DUPLICATE_LABEL", "class_conflicts": "CLASS_CONFLICT",
        "overcrowded_images": "OVERCROWDED_IMAGE",
    }
    found = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(code)) for c, code in codes.items()]))
    return files.select(*keys, F.array_join(F.array_sort(found), ",").alias("issues")).where(F.col("issues") != "")


def _ratio(name: str) -> Column:
    return F.col(name) / F.greatest(F.col("objects"), F.lit(1))


def gate_issues(summary: DataFrame, policy: QualityPolicy = QualityPolicy()) -> DataFrame:
    """Failed rules of a one-row summary as (severity, code, actual, limit) rows.

    Needs the audit counters and malformed, leaked_images, test_images, split_mode, golden_approved,
    reviewed, human, conversion and source_dataset.
    """
    conversion = F.lower(F.coalesce("conversion", F.lit("")))
    dataset = F.lower(F.coalesce("source_dataset", F.lit("")))
    human = F.col("human") / F.greatest(F.col("reviewed"), F.lit(1))
    none = F.lit(None).cast("double")
    # severity, code, failed, actual, limit
    rules = [
        ("error", "MALFORMED_LABEL", F.col("malformed") > 0, F.col("malformed"), 0),
        ("error", "INVALID_GEOMETRY", F.col("out_of_bounds") + F.col("degenerate") > 0, F.col("out_of_bounds") + F.col("degenerate"), 0),
        ("error", "OVERSIZED_OBJECTS", _ratio("oversized") > policy.max_oversized_fraction, F.round(_ratio("oversized"), 6), policy.max_oversized_fraction),
        ("error", "EXTREME_ASPECT", _ratio("extreme_aspect") > policy.max_extreme_aspect_fraction, F.round(_ratio("extreme_aspect"), 6), policy.max_extreme_aspect_fraction),
        ("error", "DUPLICATE_LABELS", _ratio("duplicates") > policy.max_duplicate_fraction, F.round(_ratio("duplicates"), 6), policy.max_duplicate_fraction),
        ("error", "CLASS_CONFLICTS", _ratio("class_conflicts") > policy.max_class_conflict_fraction, F.round(_ratio("class_conflicts"), 6), policy.max_class_conflict_fraction),
        ("error", "SPLIT_LEAKAGE", F.col("leaked_images") > 0, F.col("leaked_images"), 0),
        ("error", "TEST_SET_TOO_SMALL", F.col("test_images") < policy.min_test_images, F.col("test_images"), policy.min_test_images),
        ("error", "AABB_TO_OBB_INVALID", conversion.contains("aabb to four-corner obb"), none, None),
        ("error", "SOURCE_DATA_NOT_GOLDEN", dataset.contains("roboflow") & conversion.contains("aabb"), none, None),
        ("error", "TEST_SET_NOT_FIXED", F.lit(policy.require_fixed_test) & ~F.col("split_mode").eqNullSafe("fixed_test_list"), none, None),
        ("error", "GOLDEN_SET_NOT_APPROVED", F.lit(policy.require_golden_manifest) & ~F.coalesce("golden_approved", F.lit(False)), none, None),
        ("error", "REVIEW_PROVENANCE_MISSING", F.lit(policy.require_review_provenance) & F.col("reviewed").isNull(), none, None),
        ("error", "HUMAN_REVIEW_TOO_LOW", F.col("reviewed").isNotNull() & (human < policy.min_human_review_fraction), F.round(human, 6), policy.min_human_review_fraction),
        ("warning", "MANY_BORDER_OBJECTS", _ratio("border_touching") > 0.05, F.round(_ratio("border_touching"), 6), 0.05),
        ("warning", "OVERCROWDED_IMAGES", F.col("overcrowded_images") > 0, F.col("overcrowded_images"), 0),
    ]
    checks = F.array(*[
        F.struct(
            F.lit(s).alias("severity"), F.lit(c).alias("code"), F.coalesce(bad, F.lit(False)).alias("failed"),
            actual.cast("double").alias("actual"), F.lit(limit).cast("double").alias("limit"),
        )
        for s, c, bad, actual, limit in rules
    ])
    return summary.select(F.explode(F.filter(checks, lambda r: r["failed"])).alias("r")).select(
        "r.severity", "r.code", "r.actual", "r.limit"
    )


def gate_decision(issues: DataFrame, enforce: bool = True) -> DataFrame:
    """passed or failed, and whether training is blocked."""
    errors = F.count_if(F.col("severity") == "error")
    return issues.agg(errors.alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")).select(
        "errors", "warnings",
        F.when(F.col("errors") > 0, "failed").otherwise("passed").alias("status"),
        ((F.col("errors") > 0) & F.lit(enforce)).alias("blocked"),
    )


def golden_manifest_ok(approved: Column, reviewer: Column, approver: Column, approved_at: Column) -> Column:
    """Counts only when approved, with two different people named and a date."""
    named = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.coalesce(approved, F.lit(False)) & named(reviewer) & named(approver) & named(approved_at)
        & ~reviewer.eqNullSafe(approver)
    )


def dataset_gates(audits: DataFrame, manifests: DataFrame, key: str, *, golden_required: bool = True, enforce: bool = True) -> DataFrame:
    """Per dataset of `audits` (key, errors): whether its golden manifest counts, its errors with the missing manifest as one more, and
    whether it is passed, failed, or failed and blocked. Of several manifests one that counts is enough."""
    counts = golden_manifest_ok(F.col("approved"), F.col("reviewer"), F.col("approver"), F.col("approved_at"))
    golden = manifests.groupBy(key).agg(F.bool_or(counts).alias("golden"))
    seen = audits.join(golden, key, "left").withColumn("golden", F.coalesce("golden", F.lit(False)))
    errors = F.col("errors") + F.when(F.lit(golden_required) & ~F.col("golden"), 1).otherwise(0)
    status = F.when(errors > 0, "failed").otherwise("passed")
    return seen.select(key, "golden", errors.alias("errors"), status.alias("status"), ((errors > 0) & F.lit(enforce)).alias("blocked"))


def recovery_plan(summary: DataFrame) -> DataFrame:
    total = F.greatest(F.col("objects"), F.lit(1))
    removals = F.col("degenerate") + F.col("duplicates")
    signals = F.col("oversized") + F.col("extreme_aspect") + F.col("class_conflicts")
    kept = total - F.least(total, removals + signals)
    return summary.select(
        total.alias("total_objects"), removals.alias("automatic_removals"), signals.alias("quarantine_signals"),
        kept.alias("estimated_retained_objects"), F.round(kept / total, 4).alias("estimated_retained_fraction"),
    )


def split_leakage(images: DataFrame, name: str = "image", split: str = "split") -> DataFrame:
    """Image names, ignoring case, that occur in more than one split."""
    key = F.lower(F.col(name))
    return (
        images.select(key.alias(name), split).distinct().groupBy(name)
        .agg(F.count(F.lit(1)).alias("splits"), F.min(split).alias("first_split"), F.max(split).alias("last_split"))
        .where(F.col("splits") > 1)
    )


def fingerprint(df: DataFrame, *parts: str) -> DataFrame:
    """One digest of a table that does not depend on row order and combines before the shuffle: the
    sums of five 48-bit slices of each row's SHA-256, and the row count, hashed together."""
    digest = F.sha2(F.concat_ws("\x1f", *[F.col(p).cast("string") for p in parts]), 256)
    cut_at = [1, 13, 25, 37, 49]
    limbs = [
        F.sum(F.conv(F.substring("_d", at, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i, at in enumerate(cut_at)
    ]
    sums = df.select(digest.alias("_d")).agg(F.count(F.lit(1)).alias("rows"), *limbs)
    return sums.select(
        "rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(5)]), 256).alias("fingerprint")
    )


def _settle(tree: DataFrame) -> DataFrame:
    """(id, fell) for a forest of (child, parent): a box falls in its own turn if a box pointing to it did not.

    Boxes whose pointers are all settled settle; a box that waits for a single one, with no strike so far, is the opposite of
    that one, and such runs of opposites are shortened by half in each round. So rounds grow with the logarithm of the
    forest, whatever the length of its chains.
    """
    ids = tree.select(F.col("child").alias("id")).unionByName(tree.select(F.col("parent").alias("id"))).distinct()
    state = cut(
        ids.join(tree.select(F.col("child").alias("id"), "parent"), "id", "left").select(
            "id", "parent", F.lit(None).cast("boolean").alias("fell"), F.lit(None).cast("string").alias("on"), F.lit(None).cast("boolean").alias("opposite")
        ),
        "sanitize",
    )
    while True:
        votes = state.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(
            F.count_if(F.col("fell").isNull()).alias("waiting"), F.count_if(~F.col("fell")).alias("strikes"), F.max(F.when(F.col("fell").isNull(), F.col("id"))).alias("last")
        )
        fell = F.coalesce("fell", F.when(F.col("strikes") > 0, True).when(F.coalesce("waiting", F.lit(0)) == 0, False))
        judged = cut(
            state.join(votes, "id", "left").select("id", "parent", fell.alias("fell"), "on", "opposite", "waiting", "last").select(
                "id", "parent", "fell",
                F.when(F.col("fell").isNull() & (F.col("waiting") == 1), F.coalesce("on", "last")).alias("on"),
                F.coalesce("opposite", F.lit(True)).alias("opposite"),
            ),
            "sanitize",
        )
        target = judged.select(F.col("id").alias("on"), F.col("fell").alias("t_fell"), F.col("on").alias("t_on"), F.col("opposite").alias("t_opposite"))
        after = cut(
            judged.join(target, "on", "left").select(
                "id", "parent", F.coalesce("fell", F.col("t_fell") != F.col("opposite")).alias("fell"), F.coalesce("t_on", "on").alias("on"),
                F.when(F.col("t_on").isNotNull(), F.col("opposite") != F.col("t_opposite")).otherwise(F.when(F.col("on").isNotNull(), F.col("opposite"))).alias("opposite"),
            ),
            "sanitize",
        )
        drop(state, judged)
        state = after
        if not state.where(F.col("fell").isNull()).limit(1).count():
            return state.select("id", "fell")


def sanitize(flagged: DataFrame, keys: list[str], order: str, policy: QualityPolicy = QualityPolicy()) -> DataFrame:
    """Every object with its outcome: kept, invalid, duplicate or conflict, and `strikes`, how often
    it took part in a conflict removal as the earlier box.

    Walking a file in order, an object with a live earlier rival (other class, IoU >= 0.90) removes
    itself and all such rivals. A box that is not removed in its own turn always falls to its first
    later rival, so each box points to one later box and the walk is a game on a forest: a box falls
    in its own turn when some box pointing to it survived its own. `order` is a string column that is
    unique over the whole table.
    """
    flagged = cut(flagged, "flags")
    bad = F.col("out_of_bounds") | F.col("degenerate") | F.col("oversized") | F.col("extreme_aspect")
    valid = flagged.where(~bad)
    # The order is unique, so the least value with its box is one struct and the order travels once.
    first = valid.groupBy(*keys, "class_id", "coords_key").agg(F.min(F.struct(order, *bx.BOX)).alias("_r"))
    first = cut(first.select(*keys, "class_id", "_r.*"), "sanitize")
    nodes = first.withColumn("_n", F.struct(F.col(order).alias("o"), F.col("class_id").alias("c")))
    pairs = overlap_pairs(nodes, None, group=keys, id_col="_n", min_iou=policy.min_conflict_iou, base=CELL).where(
        F.col("a_id.c") != F.col("b_id.c")
    )
    tree = cut(
        pairs.groupBy(*keys, F.col("a_id.o").alias("child")).agg(F.min("b_id.o").alias("parent")), "sanitize"
    )
    known = _settle(tree.select("child", "parent"))
    links = tree.select(F.col("child").alias("id"), "parent")
    fate = known.join(links, "id", "left").select(
        F.col("id").alias(order), "fell", (F.col("parent").isNotNull() & ~F.col("fell")).alias("struck")
    )
    marked = flagged.join(first.select(order, F.lit(True).alias("_first")), order, "left").join(fate, order, "left")
    outcome = (
        F.when(bad, "invalid")
        .when(F.col("_first").isNull(), "duplicate")
        .when(F.coalesce(F.col("fell") | F.col("struck"), F.lit(False)), "conflict")
        .otherwise("kept")
    )
    return marked.select(
        *flagged.columns, outcome.alias("outcome"),
        F.coalesce(F.col("struck") & (outcome != "invalid"), F.lit(False)).alias("struck"),
    )


def sanitize_stats(result: DataFrame) -> DataFrame:
    """Totals; removed_conflict counts two per removal event, so it may exceed the objects removed."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    return result.agg(
        F.count(F.lit(1)).alias("input_objects"), n("kept").alias("kept_objects"), n("invalid").alias("removed_invalid"),
        n("duplicate").alias("removed_duplicate"), (F.count_if("struck") * 2).alias("removed_conflict"),
    )


def remap_classes(objects: DataFrame, mapping: dict[str, str], class_name: str = "class_name") -> DataFrame:
    """Rename classes by a small fixed map; classes that are not in it are dropped."""
    table = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])
    return objects.withColumn(class_name, F.try_element_at(table, F.col(class_name))).where(F.col(class_name).isNotNull())
