"""Violations of rows to deliver, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators.delivery import output_violations, refused_with_violations, speech_gaps

PARTS = "array<struct<start_ms:long,end_ms:long>>"
ITEM = f"source_id long, key string, start_ms long, end_ms long, state string, start_complete boolean, end_complete boolean, speech {PARTS}, _island string, violations string"
SPAN = "source_id long, start_ms long, end_ms long"


def brute(rows, blocked, hard):
    out = []
    for i, (source, key, a, b, state, first, last, speech, *_) in enumerate(rows):
        whole = a is not None and b is not None and a < b
        parts = sorted(speech or [])
        gaps = [y[0] - x[1] for x, y in zip(parts, parts[1:])]
        meets = lambda o: o[0] == source and o[1] < b and a < o[2] and o[1] < o[2]
        shares = whole and source is not None
        usable = [(r[0], r[2], r[3]) for j, r in enumerate(rows) if j != i and r[2] is not None and r[3] is not None]
        said = [
            (state != "accepted", "not_accepted"),
            (not (first and last), "incomplete_endpoints"),
            (any(g < 0 for g in gaps), "speech_overlaps"),
            (any(g > hard for g in gaps), "hard_split"),
            (shares and any(map(meets, blocked)), "blocked_event"),
            (not whole, "empty_span"),
            (key is not None and sum(r[1] == key for r in rows) > 1, "duplicate_key"),
            (shares and any(map(meets, usable)), "overlap"),
        ]
        out.append((source, key, a, b, tuple(name for holds, name in said if holds)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_against_all_pairs(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(260):
        a = rnd.randrange(0, 90_000, 10)
        b = a + rnd.choice([0, 10, 50, 200, 900])
        speech = rnd.choice([None, [], [(a, b)], [(a + 60, b), (a, a + 10)], [(a, a + 30), (a + 20, b)], [(a, a + 10), (a + 61, a + 70)]])
        row = (rnd.choice([0, 0, 0, 1, 2, None]), rnd.choice([None, f"k{rnd.randrange(400)}"]), rnd.choice([a, a, a, None]), b)
        rows.append((*row, rnd.choice(["accepted", "accepted", "rejected", None]), rnd.choice([True, True, True, None]), rnd.choice([True, True, False]), speech, "x", "old"))
    rows += rows[:6]
    rows += [(1, f"t{i}", 200_000 + 10 * i, 200_010 + 10 * i, "accepted", True, True, None, "x", "old") for i in range(4)]  # touching is not sharing
    blocked = [(rnd.choice([0, 1, None]), a, a + rnd.choice([0, 20, 300])) for a in (rnd.randrange(0, 90_000, 10) for _ in range(120))]
    items = spark.createDataFrame(rows, ITEM).repartition(5)
    found = output_violations(items, spark.createDataFrame(blocked, SPAN), 50)
    assert found.columns == ITEM.replace(" array<struct<start_ms:long,end_ms:long>>", " x").replace(",", "").split()[::2]
    got = sorted([(r.source_id, r.key, r.start_ms, r.end_ms, tuple(r.violations)) for r in found.collect()], key=repr)
    assert got == brute(rows, blocked, 50)
    assert {v for r in got for v in r[4]} == {"not_accepted", "incomplete_endpoints", "speech_overlaps", "hard_split", "blocked_event", "empty_span", "duplicate_key", "overlap"}


def test_gaps(spark):
    df = spark.createDataFrame([(None,), ([],), ([(5, 9)],), ([(20, 30), (5, 9), (28, 40)],)], f"speech {PARTS}")
    assert [r.g for r in df.select(speech_gaps(F.col("speech")).alias("g")).collect()] == [None, [], [], [11, -2]]


def test_refusal(spark):
    good = (1, "a", 0, 10, "accepted", True, True, None, "x", "old")
    none = spark.createDataFrame([], SPAN)
    fine = spark.createDataFrame([good, (1, "b", 10, 20, *good[4:])], ITEM)
    assert refused_with_violations(output_violations(fine, none, 50)).count() == 2
    bad = spark.createDataFrame([good, (1, "b", 9, 20, *good[4:])], ITEM)
    with pytest.raises(Exception, match="violates overlap"):
        refused_with_violations(output_violations(bad, none, 50)).collect()
    assert output_violations(fine.limit(0), none, 50).count() == 0
