"""Gates with golden manifests, selection counts, block folders and mask audits on hand-made cases."""

import pytest

from skyledger.operators import labels as lb
from skyledger.operators import masks as mk
from skyledger.plans.packages import selection_summary, unsigned_manifest
from skyledger.sources import files as fs

MANIFEST = "d int, approved boolean, reviewer string, approver string, approved_at string"


def test_a_manifest_counts_only_when_two_people_signed_it(spark):
    audits = spark.createDataFrame([(i, 0) for i in range(1, 9)] + [(9, 2)], "d int, errors long")
    manifests = spark.createDataFrame([
        (1, True, "a", "b", "day"), (2, False, "a", "b", "day"), (3, True, "a", "a", "day"), (4, True, None, "b", "day"), (5, True, "a", "", "day"),
        (6, True, "a", "b", None), (7, None, "a", "b", "day"), (7, True, "a", "c", "day"), (9, True, "a", "b", "day"),
    ], MANIFEST)
    got = {r["d"]: (r["golden"], r["errors"], r["status"], r["blocked"]) for r in lb.dataset_gates(audits, manifests, "d").collect()}
    assert got[1] == got[7] == (True, 0, "passed", False)
    assert all(got[i] == (False, 1, "failed", True) for i in (2, 3, 4, 5, 6, 8))
    assert got[9] == (True, 2, "failed", True)
    free = {r["d"]: (r["status"], r["blocked"]) for r in lb.dataset_gates(audits, manifests, "d", golden_required=False, enforce=False).collect()}
    assert free[2] == ("passed", False) and free[9] == ("failed", False)


def test_an_unsigned_manifest_never_counts(spark):
    rows = spark.createDataFrame([(True, "sparse", "car"), (False, "sparse", "bus"), (False, None, "bus")], "risk boolean, density string, signature string")
    made = unsigned_manifest(rows)
    ok = lb.golden_manifest_ok(*[made[c] for c in ("approved", "reviewer", "approver", "approved_at")])
    assert made.select("images", "risk_images", ok).collect() == [(3, 1, False)]
    got = {(r["kind"], r["value"]): r["images"] for r in selection_summary(rows).collect()}
    assert got == {("images", "all"): 3, ("images", "risk"): 1, ("density", "sparse"): 2, ("density", None): 1, ("signature", "car"): 1, ("signature", "bus"): 2}


def test_folders_without_blocks_are_refused(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("x")
    with pytest.raises(ValueError, match="no block images"):
        fs.list_blocks(spark, str(tmp_path))
    (tmp_path / "block_z19_br1_bc2_r8_c12.png").write_text("1234")
    got = fs.list_blocks(spark, str(tmp_path)).collect()
    assert [(r["size"], r["zoom"], r["block_row"], r["block_col"]) for r in got] == [(4, 19, 1, 2)] and got[0]["west"] < got[0]["east"]


def test_masks_are_audited_against_declared_boxes(spark):
    runs = spark.createDataFrame([(1, y, 0, 10) for y in range(10)] + [(2, 0, 0, 5), (2, 1, 0, 5), (2, 8, 7, 12)], "m int, y int, x0 int, x1 int")
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (2, 0.0, 0.0, 5.0, 2.0), (3, 0.0, 0.0, 4.0, 4.0)], "m int, x1 double, y1 double, x2 double, y2 double")
    facts = mk.mask_geometry(mk.merge_runs(runs, ["m"]), boxes, ["m"])
    got = {r["m"]: r for r in facts.collect()}
    assert (got[1]["mask_bbox_iou"], got[1]["aabb_background_fraction"], got[1]["components"]) == (1.0, 0.0, 1)
    assert got[2]["components"] == 2 and got[2]["mask_bbox_iou"] == pytest.approx(10 / 108) and got[2]["aabb_area"] == 108
    assert got[3]["empty"] and got[3]["aabb_area"] is None and got[3]["mask_bbox_iou"] is None
    assert mk.mask_audit_totals(facts).collect() == [(3, 1, 1, 1, 1)]
    ranks = {r["metric"]: (r["n"], r["p10"], r["p90"]) for r in mk.mask_audit_quantiles(facts, ["m"]).collect()}
    assert ranks["mask_area"] == (2, 15.0, 100.0) and set(ranks) == set(mk.AUDIT_METRICS)
