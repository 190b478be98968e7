"""Tiers of overlapping rows, against walks in order of rank."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import tiers

ROW = "source_id long, segment_id long, start_ms long, end_ms long"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3, F.rand(1))


def covered(a, b, spans):
    got, cursor = 0, a
    for x, y in sorted(spans):
        if y > cursor and x < b:
            got += max(0, min(b, y) - max(cursor, x))
            cursor = max(cursor, y)
    return got


def span(rnd):
    a = rnd.randrange(0, 4000, 10)
    return a, a + rnd.choice([50, 200, 400, 900])


@pytest.mark.parametrize("seed", [0, 1])
def test_borderline(spark, seed):
    rnd = random.Random(seed)
    rows = [(s, 1000 * s + k, *span(rnd), rnd.choice([None, 0.1, 0.5, 0.5, 0.9, float("nan")])) for s in range(3) for k in range(120)]
    accepted = [(s, *span(rnd)) for s in range(2) for _ in range(6)]
    want = {}
    for s in range(3):
        kept = []
        mine = [(-(r[4] if r[4] == r[4] and r[4] else 0.0), *r[2:4], r[1]) for r in rows if r[0] == s]
        for _, a, b, name in sorted(mine, key=lambda r: (r[0], r[1], r[3])):
            if covered(a, b, [x[1:] for x in accepted if x[0] == s]) >= b - a:
                want[name] = "covered_by_tier_a"
            elif any(x <= a and b <= y for x, y in kept):
                want[name] = "tier_b_nms_suppressed"
            else:
                want[name] = "borderline"
                kept.append((a, b))
    broken = [(None, 9001, 0, 5, 1.0), (1, 9002, 5, 5, 1.0), (1, 9003, None, 5, 1.0)]
    got = tiers.borderline_tiers(frame(spark, [(*r, "x") for r in rows + broken], ROW + ", rank double, note string"), frame(spark, accepted, "source_id long, start_ms long, end_ms long"))
    assert got.columns == ["segment_id", "source_id", "start_ms", "end_ms", "rank", "note", "tier"]
    assert {r.segment_id: r.tier for r in got.collect()} == want and len(set(want.values())) == 3


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_accepted(spark, seed):
    rnd = random.Random(seed)
    bit = lambda: rnd.choice([None, False, True])
    rows = [(s, 1000 * s + k, *span(rnd), bit(), bit(), rnd.choice([None, 0.3, 0.7]), rnd.choice([None, 0.2, 0.5, 0.9])) for s in range(4) for k in range(60)]
    want = {r[1]: "dropped" for r in rows}
    for s in range(4):
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: (bool(r[4]), r[2] - r[3], -(r[6] or 0), r[2], r[1]))
        kept = []
        for c in mine:
            hits = [e for e in kept if min(c[3], e[3]) - max(c[2], e[2]) > 150]
            if not hits:
                kept.append(c)
                continue
            e, n = hits[0], c[3] - c[2]
            if len(hits) > 1 or (e[5] and e[2] <= c[2] and c[3] <= e[3]):
                continue
            shared = min(c[3], e[3]) - max(c[2], e[2])
            if (c[5] and c[2] <= e[2] and e[3] <= c[3]) or (n < e[3] - e[2] and (c[7] or 0) >= (e[7] or 0) + 0.06 and shared >= 0.8 * n):
                kept[kept.index(e)] = c
                want[e[1]] = "replaced"
        want |= {r[1]: "kept" for r in kept}
    got = tiers.accepted_outcomes(frame(spark, rows, ROW + ", rescued boolean, certified boolean, score double, window_min double"), 150)
    assert {r.segment_id: r.outcome for r in got.collect()} == want and len(set(want.values())) == 3


def test_empty(spark):
    nothing = spark.createDataFrame([], ROW + ", rank double, rescued boolean, certified boolean, score double, window_min double")
    assert tiers.borderline_tiers(nothing, nothing).count() == 0 and tiers.accepted_outcomes(nothing, 150).count() == 0
