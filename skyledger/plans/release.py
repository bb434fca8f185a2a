"""Sign-off jobs: golden package validation and the release gate. The signed documents are small
dicts; everything they are checked against is computed from tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.keys import is_timestamp
from skyledger.operators import scoring as sc
from skyledger.operators.gates import issue_rows
from skyledger.operators.profiles import side_by_side


def _text(value) -> Column:
    return F.lit(str(value or "").strip())


def golden_issues(rows: DataFrame, fixed: DataFrame, assets: DataFrame, manifest: Mapping[str, object]) -> DataFrame:
    """Issue codes of a golden package: rows (with pos), the fixed list (with pos), the existing
    assets and the manifest's signature."""
    facts = sc.golden_review_facts(rows)
    lists = sc.list_mismatch(rows, fixed, position="pos", name="image")
    missing = rows.join(assets.select("image").distinct(), "image", "left_anti").agg(F.count(F.lit(1)).alias("missing_assets"))
    named = rows.agg(
        F.count_if(F.trim("reviewer") == _text(manifest.get("reviewer"))).alias("manifest_reviewer_rows"),
        F.count_if(F.trim("reviewer") != "").alias("named_rows"),
    )
    reviewer, approver = _text(manifest.get("reviewer")), _text(manifest.get("approver"))
    signed = (reviewer != "") & (approver != "") & is_timestamp(_text(manifest.get("approved_at")))
    return issue_rows(side_by_side(facts, lists, missing, named), [
        ("REVIEW_EMPTY", F.col("sample_count") == 0),
        ("REVIEW_DUPLICATES", F.col("repeated_images") > 0),
        ("GOLDEN_LIST_MISMATCH", (F.col("sample_count") > 0) & (F.col("mismatches") > 0)),
        ("REVIEW_INCOMPLETE", F.col("invalid_count") > 0),
        ("GOLDEN_ASSETS_MISSING", F.col("missing_assets") > 0),
        ("MANIFEST_NOT_APPROVED", F.lit(manifest.get("approved") is not True)),
        ("MANIFEST_SIGNATURE_MISSING", ~signed),
        ("FOUR_EYES_VIOLATION", signed & (reviewer == approver)),
        ("REVIEWER_MISMATCH", (F.col("named_rows") > 0) & (reviewer != "") & (F.col("manifest_reviewer_rows") == 0)),
    ])


def approval_errors(digests: DataFrame, sheet: DataFrame, approval: Mapping[str, object]) -> DataFrame:
    """Why an independent approval does not hold: decision, approver, time and the three digests."""
    approver = _text(approval.get("approver"))
    same = sheet.agg(F.count_if(F.trim("reviewer") == approver).alias("as_reviewer"))
    stale = [
        (name, ~F.col(name).eqNullSafe(_text(approval.get(name))))
        for name in ("candidate_sha256", "dataset_fingerprint", "acceptance_sha256")
    ]
    return issue_rows(side_by_side(digests, same), [
        ("decision", F.lit(approval.get("decision") != "approved")),
        ("approver_missing", approver == ""),
        ("approver_not_independent", (approver != "") & (F.col("as_reviewer") > 0)),
        ("approved_at", ~is_timestamp(_text(approval.get("approved_at")))),
        *stale,
    ])


def attestation_errors(digests: DataFrame, golden: Mapping[str, object]) -> DataFrame:
    reviewer, approver = _text(golden.get("reviewer")), _text(golden.get("approver"))
    return issue_rows(digests, [
        ("not_approved", F.lit(golden.get("approved") is not True)),
        ("two_people", (reviewer == "") | (approver == "") | (reviewer == approver)),
        ("approved_at", ~is_timestamp(_text(golden.get("approved_at")))),
        ("dataset_fingerprint", ~F.col("dataset_fingerprint").eqNullSafe(_text(golden.get("dataset_fingerprint")))),
        ("fixed_list", F.lit(not golden.get("fixed_list_matches"))),
    ])


def blockers(acceptance: DataFrame, digests: DataFrame, sheet: DataFrame, approval: Mapping[str, object], golden: Mapping[str, object]) -> DataFrame:
    """What keeps a candidate from being released; no rows means it may be promoted."""
    facts = side_by_side(
        acceptance.select((F.col("status") != "passed").alias("acceptance_bad")),
        approval_errors(digests, sheet, approval).agg(F.count(F.lit(1)).alias("approval_bad")),
        attestation_errors(digests, golden).agg(F.count(F.lit(1)).alias("golden_bad")),
    )
    return issue_rows(facts, [
        ("acceptance_not_passed", F.col("acceptance_bad")),
        ("approval_invalid", F.col("approval_bad") > 0),
        ("golden_attestation_invalid", F.col("golden_bad") > 0),
    ]).withColumn("release_status", F.lit("blocked"))
