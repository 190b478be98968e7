"""Folds over groups that come in several Arrow batches, and their bisections, against plain walks."""

import random

import pytest

from cadenza.operators import assembly, folds, tiers

SCHEMA = "segment_id long, source_id long, start_ms long, end_ms long"


def some(n, seed, span=400, longest=60, first=0):
    rng = random.Random(seed)
    return [(first + i, rng.randrange(3), s, s + rng.randrange(1, longest)) for i, s in ((i, rng.randrange(span)) for i in range(n))]


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_spans_and_apart():
    rng = random.Random(1)
    for _ in range(300):
        rows = sorted((a, a + rng.randrange(1, 9)) for a in (rng.randrange(40) for _ in range(rng.randrange(7))))
        spans = folds.Spans([r[0] for r in rows], [r[1] for r in rows])
        a = rng.randrange(40)
        b = a + rng.randrange(12)
        assert spans.meet(a, b) == any(min(b, y) > max(a, x) for x, y in rows)
        assert spans.hold(a, b) == any(x <= a and b <= y for x, y in rows)
        assert spans.inside(a, b) == any(a <= x and y <= b for x, y in rows)
        apart, kept, least = folds.Apart(2), [], 2
        for i, (x, y) in enumerate(rows):
            hit = [k for k in kept if min(k[1], y) - max(k[0], x) > least]
            assert apart.hits(x, y) == sorted(hit)[:2]
            if not hit:
                kept.append((x, y, i))
                apart.add(x, y, i)


def test_replacements_in_many_batches(spark, small_batches):
    rows = [(*r, random.Random(r[0]).randrange(9) * 1.0) for r in some(120, 5)]
    want = set()
    for s in range(3):
        kept = []
        for r in sorted((r for r in rows if r[1] == s), key=lambda r: (-r[4], r[0])):
            hit = [k for k in kept if min(k[3], r[3]) - max(k[2], r[2]) > 4]
            if not hit:
                kept.append(r)
            elif len(hit) == 1 and r[2] <= hit[0][2] and r[3] >= hit[0][3] and r[4] >= 0.8 * hit[0][4]:
                kept[kept.index(hit[0])] = r
        want |= {r[0] for r in kept}
    assert {r.segment_id for r in folds.replace_overlaps(spark.createDataFrame(rows, SCHEMA + ", value double"), 4).collect()} == want


def test_evidence_comes_once_to_a_group(spark, small_batches):
    """Rows of one run that all reach the same evidence: it is dealt to the run, not to each row."""
    spans = [(i, 0, 10 * i, 10 * i + 4) for i in range(40)]
    units = [(0, 0, 400, 0, True)] + [(0, 10 * i, 10 * i + 9, i + 1, False) for i in range(40)]
    got = assembly.join_owned(
        spark.createDataFrame(spans, SCHEMA),
        spark.createDataFrame(units, "source_id long, start_ms long, end_ms long, unit_id long, accepted boolean"),
        spark.createDataFrame([(1, 0, 104, 110)], SCHEMA), 1, 8,
    )
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "FlatMapGroupsInPandas" not in plan
    assert {(r.start_ms, r.n) for r in got.collect()} == {(10 * i, 1) for i in range(40)}  # their own short unit owns each
    wide = spark.createDataFrame(units[:1], "source_id long, start_ms long, end_ms long, unit_id long, accepted boolean")
    barrier = spark.createDataFrame([(1, 0, 104, 110)], SCHEMA)
    got = assembly.join_owned(spark.createDataFrame(spans, SCHEMA), wide, barrier, 1, 8)
    assert sorted((r.start_ms, r.end_ms, r.n) for r in got.collect()) == [(0, 104, 11), (110, 394, 29)]


def test_no_group_is_a_frame(spark):
    rows = spark.createDataFrame([(*r, 1.0, "x", "speech", "", False, True, 0.5, 0.1) for r in some(5, 1)], SCHEMA + ", value double, text string, kind string, actor string, rescued boolean, certified boolean, score double, window_min double")
    made = [folds.absorb_short(rows, 5, 5), folds.schedule(rows), folds.fold_cues(rows, 5), folds.merge_with_cap(rows, 2, 20), assembly.distinct_timed_texts(rows), assembly.fold_parallel_captions(rows), tiers.accepted_outcomes(rows, 2)]
    assert not [df for df in made if "FlatMapGroupsInPandas" in df._jdf.queryExecution().executedPlan().toString()]
