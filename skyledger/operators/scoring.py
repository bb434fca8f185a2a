"""Model against truth: threshold tables, confusion, acceptance sheets, comparisons and gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.keys import is_timestamp
from skyledger.operators.overlap import overlap_pairs
from skyledger.operators.resolve import match_one_to_one


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def add_scores(counts: DataFrame) -> DataFrame:
    """precision, recall and F1 from tp, fp and fn; 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({
        "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn),
    })


def threshold_table(preds: DataFrame, truth: DataFrame, *, image: str, id_col: str, klass: str, confidence: str,
                    thresholds: Sequence[float], min_iou: float = 0.30) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 per confidence threshold, over all classes ('any') and per
    class. Matching is one to one by IoU within an image; ties go to the smaller ids."""
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    passing = F.filter(levels, lambda t: F.col(confidence) >= t)
    pairs = overlap_pairs(preds, truth, group=[image], id_col=id_col, min_iou=min_iou)
    a = preds.select(F.col(id_col).alias("a_id"), F.col(klass).alias("a_class"), passing.alias("levels"))
    b = truth.select(F.col(id_col).alias("b_id"), F.col(klass).alias("b_class"))
    scoped = (
        pairs.join(a, "a_id").join(b, "b_id")
        .withColumn("threshold", F.explode("levels"))
        .withColumn("scope", F.explode(F.array_compact(F.array(F.lit("any"), F.when(F.col("a_class") == F.col("b_class"), F.col("a_class"))))))
    )
    node = lambda c: F.struct("threshold", "scope", F.col(c).alias("id"))
    matched = match_one_to_one(scoped.select(node("a_id").alias("a_id"), node("b_id").alias("b_id"), "iou"), ties="smallest")
    keys = ["threshold", "scope"]
    tp = matched.groupBy(F.col("a_id.threshold").alias("threshold"), F.col("a_id.scope").alias("scope")).agg(F.count(F.lit(1)).alias("tp"))
    scopes = F.explode(F.array(F.lit("any"), F.col(klass))).alias("scope")
    n_pred = (
        preds.select(scopes, passing.alias("levels")).withColumn("threshold", F.explode("levels"))
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("preds"))
    )
    n_truth = (
        truth.select(scopes).groupBy("scope").agg(F.count(F.lit(1)).alias("truth")).withColumn("threshold", F.explode(levels))
    )
    counts = n_truth.join(n_pred, keys, "full").join(tp, keys, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return add_scores(counts.select(
        *keys, zero("tp").alias("tp"), (zero("preds") - zero("tp")).alias("fp"), (zero("truth") - zero("tp")).alias("fn")
    ))


def best_threshold(table: DataFrame) -> DataFrame:
    """The threshold with the highest overall F1; the lowest one on ties."""
    return table.where(F.col("scope") == "any").orderBy(F.desc("f1"), "threshold").limit(1)


def calibrated_profile(table: DataFrame, required: Mapping[str, tuple[float, float]]) -> DataFrame:
    """shadow-only when every required class reaches its precision and recall at the best threshold."""
    best = best_threshold(table).select("threshold")
    at_best = table.join(best, "threshold", "left_semi")
    ok = [
        F.coalesce(F.max(F.when(F.col("scope") == c, (F.col("precision") >= p) & (F.col("recall") >= r))), F.lit(False))
        for c, (p, r) in required.items()
    ]
    passed = ok[0]
    for condition in ok[1:]:
        passed = passed & condition
    return at_best.agg(
        F.max("threshold").alias("confidence"), F.when(passed, "candidate_shadow_only").otherwise("rejected").alias("status")
    )


def abstention_table(rows: DataFrame, *, truth: str, pred: str, confidence: str, classes: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """Per threshold: decided, unknown rate, accuracy on the decided, and per class precision and
    recall on the decided. Rows are first reduced to (truth, pred, thresholds passed)."""
    passed = F.size(F.filter(F.array(*[F.lit(float(t)) for t in sorted(thresholds)]), lambda t: F.col(confidence) >= t))
    cells = rows.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p"), passed.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    steps = F.posexplode(F.array(*[F.lit(float(t)) for t in sorted(thresholds)])).alias("i", "threshold")
    decided = F.col("k") > F.col("i")
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    t, p = F.col("t"), F.col("p")
    aggs = [count(decided).alias("decided"), count(~decided).alias("unknown"), count(decided & (t == p)).alias("correct")]
    for c in classes:
        aggs += [
            count(decided & (t == c) & (p == c)).alias(f"{c}_tp"), count(decided & (t != c) & (p == c)).alias(f"{c}_fp"),
            count(decided & (t == c) & (p != c)).alias(f"{c}_fn"),
        ]
    table = cells.select("*", steps).groupBy("threshold").agg(*aggs)
    out = [
        "threshold", "decided", "unknown", (F.col("unknown") / (F.col("decided") + F.col("unknown"))).alias("unknown_rate"),
        _ratio(F.col("correct"), F.col("decided")).alias("accuracy_on_decided"),
    ]
    for c in classes:
        tp, fp, fn = F.col(f"{c}_tp"), F.col(f"{c}_fp"), F.col(f"{c}_fn")
        out += [_ratio(tp, tp + fp).alias(f"{c}_precision"), _ratio(tp, tp + fn).alias(f"{c}_recall")]
    return table.select(*out)


def recommended_threshold(table: DataFrame, classes: Sequence[str], *, precision: float = 0.98, default: float = 0.85) -> DataFrame:
    """The least unknown rate among thresholds where every class reaches the precision, else the default."""
    ok = F.lit(True)
    for c in classes:
        ok = ok & (F.col(f"{c}_precision") >= precision)
    return table.agg(
        F.coalesce(F.min_by(F.when(ok, F.col("threshold")), F.when(ok, F.struct("unknown_rate", "threshold"))), F.lit(default)).alias("recommended_threshold")
    )


def confusion(rows: DataFrame, *, truth: str, pred: str, classes: Sequence[str]) -> DataFrame:
    """One row per true class, one count column per predicted class."""
    return rows.groupBy(F.col(truth).alias("truth")).pivot(pred, list(classes)).agg(F.count(F.lit(1))).na.fill(0)


def class_scores(rows: DataFrame, *, truth: str, pred: str, min_precision: float = 0.90, min_recall: float = 0.85) -> DataFrame:
    """Precision, recall and pass mark per class; both sides are counted in one pass."""
    sides = F.array(
        F.struct(F.col(truth).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(truth) == F.col(pred)).alias("hit")),
        F.struct(F.col(pred).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(False).alias("hit")),
    )
    g = rows.select(F.explode(sides).alias("s")).groupBy(F.col("s.c").alias("class_name")).agg(
        F.sum("s.t").alias("t"), F.sum("s.p").alias("p"), F.count_if("s.hit").alias("tp")
    )
    counts = g.select("class_name", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("t") - F.col("tp")).alias("fn"))
    scored = add_scores(counts)
    return scored.withColumn("passed", (F.col("precision") >= min_precision) & (F.col("recall") >= min_recall))


def sample_errors(rows: DataFrame, *, truth: str, pred: str, order: Sequence, n: int = 100) -> DataFrame:
    return rows.where(F.col(truth) != F.col(pred)).orderBy(*order).limit(n)


ACCEPTANCE_CELLS = ("occupied_tp", "occupied_fp", "occupied_fn", "empty_tp", "empty_fp", "empty_fn", "critical_fp")


def acceptance_score(sheet: DataFrame, *, rows_required: int = 30) -> DataFrame:
    """Totals, per-class scores, completeness and pass or fail of a human acceptance sheet of text
    cells. Cells that are not whole numbers are left out of the sums and make the row incomplete."""
    digits = lambda c: F.col(c).rlike(r"^[0-9]+$")
    cell = lambda c: F.sum(F.when(digits(c), F.col(c).try_cast("bigint")).otherwise(0))
    whole = F.lit(True)
    for c in ACCEPTANCE_CELLS:
        whole = whole & F.coalesce(digits(c), F.lit(False))
    signed = (F.trim(F.coalesce("reviewer", F.lit(""))) != "") & (F.trim(F.coalesce("reviewed_at", F.lit(""))) != "")
    t = sheet.agg(F.count(F.lit(1)).alias("rows"), F.count_if(whole & signed).alias("reviewed"), *[cell(c).alias(c) for c in ACCEPTANCE_CELLS])
    p = lambda c: _ratio(F.col(f"{c}_tp"), F.col(f"{c}_tp") + F.col(f"{c}_fp"))
    r = lambda c: _ratio(F.col(f"{c}_tp"), F.col(f"{c}_tp") + F.col(f"{c}_fn"))
    rate = _ratio(F.col("critical_fp"), F.col("rows"))
    weak = (p("occupied") < 0.90) | (r("occupied") < 0.85) | (p("empty") < 0.90) | (r("empty") < 0.85)
    errors = F.array_compact(F.array(
        F.when(F.col("reviewed") < F.col("rows"), "rows_incomplete"), F.when(F.col("rows") != rows_required, "row_count"),
        F.when(weak, "class_thresholds"), F.when(rate > 0.02, "critical_rate"),
    ))
    return t.select(
        "rows", "reviewed", (F.col("rows") - F.col("reviewed")).alias("remaining"),
        p("occupied").alias("occupied_precision"), r("occupied").alias("occupied_recall"),
        p("empty").alias("empty_precision"), r("empty").alias("empty_recall"), rate.alias("critical_rate"),
        errors.alias("errors"), F.when(F.size(errors) > 0, "failed").otherwise("passed").alias("status"),
    )


# Least metrics and largest loss when comparing models.
MIN_METRICS = {"precision": 0.75, "recall": 0.75, "mAP50-95": 0.60}
MAX_REGRESSION = 0.02


def compare_models(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Per metric (metric, value): rounded delta, and the checks it fails."""
    b = baseline.select("metric", F.col("value").alias("baseline"))
    c = candidate.select("metric", F.col("value").alias("candidate"))
    delta = F.round(F.col("candidate") - F.col("baseline"), 4)
    low = F.lit(False)
    for metric, least in MIN_METRICS.items():
        low = low | ((F.col("metric") == metric) & F.coalesce(F.col("candidate") < least, F.lit(True)))
    failed = F.array_compact(F.array(
        F.when(low, F.col("metric")), F.when(delta < -MAX_REGRESSION, F.concat(F.lit("regression:"), F.col("metric")))
    ))
    return b.join(c, "metric", "full").select("metric", "baseline", "candidate", delta.alias("delta"), failed.alias("failed_checks"))


def same_classes(a: DataFrame, b: DataFrame, *, order: str = "class_id", name: str = "class_name") -> DataFrame:
    """Positions where two ordered class lists differ; comparable only when there is none."""
    left, right = a.select(order, F.col(name).alias("left")), b.select(order, F.col(name).alias("right"))
    return left.join(right, order, "full").where(~F.col("left").eqNullSafe(F.col("right")))


def curve_summary(curve: DataFrame, *, epoch: str, metrics: Sequence[str], losses: Sequence[str], run: Sequence[str] = ()) -> DataFrame:
    """First and last value and trend per metric, and whether a loss ends more than 10% above its
    value in the middle epoch."""
    span = curve.groupBy(*run).agg(F.count(F.lit(1)).alias("_n"), F.min(epoch).alias("_first"), F.max(epoch).alias("_last"))
    span = span.withColumn("_mid", F.col("_first") + F.floor(F.col("_n") / 2))
    rows = curve.join(span, list(run)) if run else curve.join(F.broadcast(span))  # one row
    long = rows.unpivot([*run, epoch, "_first", "_last", "_mid"], list(metrics), "metric", "v")
    at = lambda c: F.max(F.when(F.col(epoch) == F.col(c), F.col("v")))
    g = long.groupBy(*run, "metric").agg(at("_first").alias("first"), at("_last").alias("last"), at("_mid").alias("mid"))
    trend = F.when(F.col("last") > F.col("first"), "up").when(F.col("last") < F.col("first"), "down").otherwise("flat")
    over = F.col("metric").isin(list(losses)) & (F.col("last") > F.col("mid") * 1.1)
    return g.select(*run, "metric", "first", "last", trend.alias("trend"), F.coalesce(over, F.lit(False)).alias("overfit"))


def machine_rollup(latest: DataFrame) -> DataFrame:
    """Counts over the latest machine review per image."""
    done = F.col("status") == "completed"
    return latest.agg(
        F.count(F.lit(1)).alias("attempted_images"), F.count_if(done).alias("completed_images"),
        F.count_if(F.col("status") == "failed").alias("failed_images"),
        *[F.count_if(done & (F.col("verdict") == v)).alias(f"verdict_{v}") for v in ("pass", "needs_review", "fail")],
        F.count_if(F.col("verdict").isin("fail", "needs_review")).alias("priority_review_count"),
    )


def review_priority(latest: DataFrame) -> DataFrame:
    """fail, needs_review, pass, others; then falling confidence; then name."""
    order = F.when(F.col("verdict") == "fail", 0).when(F.col("verdict") == "needs_review", 1).when(F.col("verdict") == "pass", 2).otherwise(3)
    return latest.withColumn("priority", order).orderBy("priority", F.desc("confidence"), "image")


def in_sheet_order(sheet: DataFrame, latest: DataFrame) -> DataFrame:
    """The latest completed review per sheet image, 'missing' where there is none."""
    done = latest.where(F.col("status") == "completed").select("image", "verdict", "confidence")
    return sheet.join(done, "image", "left").withColumn("verdict", F.coalesce("verdict", F.lit("missing")))


def page_reviews(pages: DataFrame) -> DataFrame:
    """Ids outside a page's range are dropped; totals of wrong and uncertain ids."""
    inside = lambda c: F.filter(c, lambda x: x.between(F.col("first_id"), F.col("last_id")))
    return pages.select(
        "page", F.size(inside("wrong_ids")).alias("wrong"), F.size(inside("uncertain_ids")).alias("uncertain")
    )


# Final states of a golden review row.
FINAL_STATUSES = ("approved", "corrected")


def golden_review_facts(rows: DataFrame) -> DataFrame:
    """Row-level facts of a golden review sheet: pending, invalid and repeated rows."""
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    status = F.lower(clean("review_status"))
    final = status.isin(list(FINAL_STATUSES))
    invalid = ~final | (clean("reviewer") == "") | ~is_timestamp(clean("reviewed_at")) | ((status == "corrected") & (clean("notes") == ""))
    names = rows.groupBy(clean("image").alias("image")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~final).alias("pending"), F.count_if(invalid).alias("invalid")
    )
    return names.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("sample_count"), F.coalesce(F.sum("pending"), F.lit(0)).alias("pending_count"),
        F.coalesce(F.sum("invalid"), F.lit(0)).alias("invalid_count"), F.count_if(F.col("n") > 1).alias("repeated_images"),
    )


def list_mismatch(a: DataFrame, b: DataFrame, *, position: str, name: str) -> DataFrame:
    """How many positions of two ordered lists differ."""
    left, right = a.select(position, F.col(name).alias("l")), b.select(position, F.col(name).alias("r"))
    return left.join(right, position, "full").agg(F.count_if(~F.col("l").eqNullSafe(F.col("r"))).alias("mismatches"))
