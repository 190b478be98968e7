"""Decision rules at their thresholds, by tables made by hand."""

import pytest
from pyspark.sql import functions as F

from cadenza.functions import decisions as de
from cadenza.operators import evaluation


def judged(spark, rows, schema, rule):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in df.orderBy("i").select(rule(lambda c: F.col(c)).alias("out"), "i").collect()]


def test_dialogue_paths(spark):
    schema = "ok boolean, sec double, p double, s double, cp double, cs double, t boolean, co double, d double"
    rows = [
        (True, 1.0, 0.08, -0.02, 0.09, 0.14, False, 0.0, None), (True, 1.0, 0.0799, -0.02, 0.09, 0.14, True, 0.0, None), (True, 1.0, 0.05, -0.02, 0.08, 0.10, True, 0.0, None),
        (True, 1.85, 0.04, 0.02, None, None, False, 0.08, None), (True, 1.84, 0.04, 0.02, None, None, False, 0.08, None), (True, 1.0, 0.08, -0.045, 0.10, 0.25, True, 0.0, None),
        (True, 1.0, 0.08, -0.045, 0.20, 0.25, None, 0.0, None), (True, 1.05, 0.03, -0.04, 0.08, 0.15, False, 0.0, 20.0), (True, 3.01, 0.03, -0.04, 0.08, 0.15, False, 0.0, 20.0),
        (True, 1.05, 0.03, -0.04, 0.08, 0.15, False, 0.0, None), (False, 1.0, 0.5, 0.5, 0.5, 0.5, True, 1.0, 1.0), (None, 1.0, 0.5, 0.5, 0.5, 0.5, True, 1.0, 1.0),
    ]
    want = ["A_dual_cohort", "B_three_channel", "B_three_channel", "C_stable_dialogue", None, "D_cohort_dominant", "D_cohort_dominant", "E_scene_dialogue", None, None, None, None]
    assert judged(spark, rows, schema, lambda c: de.dialogue_path(*map(c, ("ok", "sec", "p", "s", "cp", "cs", "t", "co", "d")))) == want


def test_rescue_tiers(spark):
    schema = "obs double, acc boolean, veto boolean, conf boolean, strong boolean, resc boolean, w double, s double"
    rows = [
        (0.1, True, True, True, False, True, 0.1, 0.0), (0.1, False, False, False, True, False, 0.9, 0.9), (0.0, True, True, False, True, False, 0.9, 0.9), (None, None, False, True, True, False, 0.9, 0.9),
        (0.0, None, False, None, True, True, 0.1, 0.0), (0.0, None, None, None, None, False, 0.56, None), (0.0, None, None, None, None, False, 0.5599, None), (0.0, None, None, None, None, False, 0.0, None),
        (0.0, None, None, None, None, True, 0.62, 0.54), (0.0, None, None, None, None, True, 0.6199, 0.9), (0.0, None, None, None, None, True, 0.9, 0.5399), (0.0, None, None, None, None, True, None, None),
    ]
    rule = lambda c: de.rescue_tier(*map(c, ("obs", "acc", "veto", "conf", "strong", "resc", "w", "s")), F.lit(0.5))
    assert judged(spark, rows, schema, rule) == ["A", "B", "B", "B", "A", "A", "B", "A", "A", "B", "B", "A"]


def test_four_views(spark):
    view = lambda *m: [("a", "stem", m[0], m[4]), ("b", "stem", m[1], m[5]), ("a", "raw", m[2], m[6]), ("b", "raw", m[3], m[7])]
    rows = [
        (view(0.1, -1.0, 0.1, -1.0, 1, 1, 1, 1),), (view(-0.1, -0.1, 0.1, 0.1, 1, 1, 1, 1),), (view(-0.1, -0.1, -0.1, 0.1, 1, 1, 1, 2),), (view(-0.1, -0.1, -0.1, 0.1, 1, 2, 1, 1),),
        (view(-0.1, -0.1, -0.1, 0.1, 1, 1, 2, 1),), (view(0.1, 0.1, None, 0.1, 1, 1, 1, 1),), (view(-0.1, 0.0, -0.1, -0.1, 1, 1, 1, 1),), (view(-0.1, -0.1, -0.1, -0.1, None, None, 1, 1),),
    ]
    schema = "v array<struct<variant:string,channel:string,margin:double,role:long>>"
    want = ["target_supported", "unresolved", "other_supported", "unresolved", "unresolved", "unresolved", "unresolved", "unresolved"]
    assert judged(spark, rows, schema, lambda c: de.four_view_state(c("v"))) == want


def test_consensus(spark):
    rows = [([0.1, 0.1], [1.0, 1.0]), ([0.1, -0.1], [1.0, 1.0]), ([0.2, 0.2, 0.0], [1.0, 0.9, 0.5]), ([0.2, 0.2, 0.0], [1.0, 0.5, 0.5]), ([0.9, -0.1, -0.1], [1.0, 0.1, 0.1]), ([None, 0.05], [1.0, None]), ([], []), ([0.1, 0.1], [0.0, 0.0])]
    got = judged(spark, rows, "g array<double>, w array<double>", lambda c: de.consensus(c("g"), c("w"), 0.05))
    assert [r.accepted for r in got] == [True, False, True, False, False, True, False, False]
    assert [r.conflict for r in got] == [False, False, False, False, True, False, False, False]
    assert got[2].discounted and not got[3].discounted and got[1].margin == pytest.approx(0.0) and got[7].margin == 0.0


def test_vetoes_witnesses_and_cores(spark):
    rows = [(2, 2, 9, False, False), (1, 3, 4, True, True), (1, 3, 5, True, True), (1, 3, 3, False, True), (1, 3, 3, True, False), (0, 2, 2, True, True), (None, None, None, None, None)]
    assert judged(spark, rows, "n long, near long, r long, rej boolean, allow boolean", lambda c: de.classifier_veto(*map(c, ("n", "near", "r", "rej", "allow")))) == [True, True, False, False, False, False, False]
    rows = [(-1.0, -1.0, -0.1, None), (-1.0, -1.0, 0.0, True), (-1.0, -1.0, 0.0, False), (-1.0, None, -0.1, True), (-1.0, 0.0, -0.1, True), (-1.0, -1.0, None, True)]
    got = judged(spark, rows, "a double, b double, p double, r boolean", lambda c: de.local_witness([c("a"), c("b")], c("p"), c("r")))
    assert got == ["domain_all_four_and_production_primary_negative", "domain_all_four_and_production_exclusion_rejected", None, None, None, "domain_all_four_and_production_exclusion_rejected"]
    rows = [(0.56, 0.53, 0.6, 0.6, 0.08, 0.08, None), (0.55, 0.51, 0.6, 0.6, 0.5, 0.5, None), (0.65, 0.49, 0.5, 0.5, 0.12, 0.20, True), (0.65, 0.49, 0.5, 0.5, 0.12, 0.20, False), (0.51, 0.51, 0.55, 0.55, 0.15, 0.25, False), (0.9, 0.9, 0.9, 0.9, None, 0.9, True)]
    rule = lambda c: de.clean_core(*map(c, ("a", "b", "ma", "mb", "ca", "cb", "t")), 0.51, 0.51)
    assert judged(spark, rows, "a double, b double, ma double, mb double, ca double, cb double, t boolean", rule) == [True, True, True, False, True, False]


def test_span_states(spark):
    names = ("hard", "dirty", "covered", "seen", "doubt", "pure", "whole")
    rows = [(False, False, True, True, False, True, True), (True, False, False, False, True, False, False), (False, True, True, True, False, True, True), (None, None, None, None, None, None, None), (False, False, True, True, True, True, False)]
    got = judged(spark, rows, ", ".join(f"{n} boolean" for n in names), lambda c: F.struct(*de.span_state(*map(c, names))))
    said = [(r[0], r[1]) for r in got]
    assert said[0] == ("accepted", ["acoustically_verified"]) and said[1] == said[2] == ("rejected", ["local_contamination"])
    assert said[3] == ("unresolved", ["missing_temporal_coverage", "no_observable_identity", "span_purity_unresolved", "acoustic_boundary_incomplete"])
    assert said[4] == ("unresolved", ["local_identity_unresolved", "acoustic_boundary_incomplete"])


def test_non_regression(spark):
    same = {"loss": 0.5, "auc": 0.8, "f1": 0.7, "balanced": 0.6, "protected_positives": 3.0, "protected_negatives": 4.0, "lost_positives": 0.0, "new_false_positives": 0.0}
    cases = [({}, True), ({"loss": 0.51}, False), ({"loss": 0.4, "auc": 0.79}, False), ({"f1": 0.69}, False), ({"balanced": 0.59}, False), ({"lost_positives": 1.0}, False), ({"new_false_positives": 1.0}, False), ({"protected_positives": 2.0}, False), ({"auc": None}, False)]
    lit = lambda d: {k: F.lit(v).cast("double") for k, v in d.items()}
    for change, want in cases:
        assert spark.range(1).select(de.non_regressing(lit(same), lit(same | change))).first()[0] is want


@pytest.mark.parametrize("band", [0.0, 1.0])
def test_rank_audit(spark, band):
    import random

    rng = random.Random(2)
    rows = [(float(rng.randrange(12)), float(rng.randrange(12)), rng.randrange(2)) for _ in range(120)]
    pairs = [(p, q) for p in rows if p[2] for q in rows if not q[2] and q[1] < p[1] - band]
    inverted = sum(any(not q[2] and q[1] < p[1] - band and p[0] <= q[0] for q in rows) for p in rows if p[2])
    got = evaluation.rank_audit(spark.createDataFrame(rows, "x double, old double, y int"), "x", "old", "y", band).first()
    assert tuple(got) == (len(pairs), inverted, inverted == 0)
