"""Rules of rescued rows at their thresholds, and promotion by a source's voice against a loop."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cadenza.functions import rescue
from cadenza.operators.recovery import promote_by_cluster

MODEL = "struct<score:double,best:double,median:double,p20:double,votes:double,windows:array<double>>"
MATCH = f"struct<accepted:boolean,tier:string,paired:double,primary:{MODEL},secondary:{MODEL}>"
NAN = float("nan")


def model(score, best=None, median=None, p20=None, votes=1.0, windows=None):
    other = lambda x: score if x is None else x
    return (score, other(best), other(median), other(p20), votes, windows)


def match(p, s, accepted=False, tier="recall", paired=0.6):
    return (accepted, tier, paired, p, s)


def ask(spark, rows, schema, rule):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, " + schema)
    return [r.out for r in df.select("i", rule.alias("out")).orderBy("i").collect()]


STEM = match(model(0.50, 0.55), model(0.62, 0.62), paired=0.5)
RAW = match(model(0.70), model(0.66), True, "strong", 0.6)
GOOD = (STEM, RAW, 2.0, True, 0.0, (1, 0.5, 0.5), (1, 0.6))


def changed(row, **at):
    row = list(row)
    for name, value in at.items():
        row["stem raw seconds clean difference four diagonal".split().index(name)] = value
    return tuple(row)


CASES = [
    (GOOD, "accepted"),
    (changed(GOOD, clean=None), "clean_gate_disabled"),
    (changed(GOOD, difference=0.2501), "channel_duration_mismatch"),
    (changed(GOOD, difference=0.25), "accepted"),
    (changed(GOOD, difference=None), "accepted"),
    (changed(GOOD, seconds=0.349), "duration_too_short"),
    (changed(GOOD, seconds=0.35), "accepted"),
    (changed(GOOD, seconds=NAN), "duration_too_short"),
    (changed(GOOD, raw=match(model(0.7), None, True, "strong")), "missing_secondary_decision"),
    (changed(GOOD, stem=match(model(0.5, 0.55, windows=[0.3] * 2 + [0.5] * 3), model(0.62, windows=[0.3] * 5))), "uvr_discontinuous"),
    (changed(GOOD, stem=match(model(0.5, 0.55, windows=[0.3] + [0.5] * 4), model(0.62, windows=[0.3] * 5), paired=0.5)), "accepted"),
    (changed(GOOD, seconds=1.79, stem=match(model(0.5, 0.55, windows=[0.3] * 5), model(0.62, windows=[0.3] * 5), paired=0.5)), "accepted"),
    (changed(GOOD, stem=match(model(0.45, 0.55), model(0.62), paired=0.5)), "uvr_insufficient_evidence"),
    (changed(GOOD, stem=match(model(NAN, 0.55), model(0.62), paired=0.5)), "uvr_insufficient_evidence"),
    (changed(GOOD, stem=match(model(0.5, 0.55, p20=0.1), model(0.62, p20=0.35), paired=0.5)), "accepted"),
    (changed(GOOD, stem=match(model(0.5, 0.55, p20=NAN), model(0.62, p20=0.33), paired=0.5)), "uvr_insufficient_evidence"),
    (changed(GOOD, raw=match(model(0.70), model(0.66), True, "recall", 0.6)), "accepted_diagonal"),
    (changed(GOOD, raw=match(model(0.70), model(0.66), False, "strong", 0.6), diagonal=(0, 0.9)), "raw_and_diagonal_evidence_below_floor"),
    (changed(GOOD, raw=match(model(0.70), model(0.66), False, "strong", 0.6), diagonal=(1, 0.49)), "raw_and_diagonal_evidence_below_floor"),
    (changed(GOOD, raw=match(model(0.54, 0.6), model(0.66), True, "strong", 0.6)), "raw_and_diagonal_evidence_below_floor"),
    (changed(GOOD, four=(0, 0.9, 0.9)), "cross_channel_reference_mismatch"),
    (changed(GOOD, four=(2, 0.45, 0.9)), "cross_channel_reference_mismatch"),
    (changed(GOOD, stem=match(model(0.69, 0.7), model(0.65, 0.7), paired=0.58)), "raw_gain_insufficient"),
    (changed(GOOD, stem=match(model(0.69, 0.7), model(0.65, 0.7), paired=0.5)), "accepted"),
]


def test_second_channel(spark):
    schema = f"stem {MATCH}, raw {MATCH}, seconds double, clean boolean, difference double, four struct<count:int,primary:double,secondary:double>, diagonal struct<count:int,pair:double>"
    c = F.col
    rule = lambda **k: rescue.second_channel_rescue(c("stem"), c("raw"), 0.70, c("seconds"), c("clean"), c("difference"), 0.25, c("four"), c("diagonal"), **k)
    got = ask(spark, [r for r, _ in CASES], schema, rule())
    assert [(i, g) for i, g in enumerate(got)] == [(i, w) for i, (_, w) in enumerate(CASES)]
    assert set(ask(spark, [GOOD], schema, rule(enabled=False))) == {"disabled"}
    plain = rescue.second_channel_rescue(c("stem"), c("raw"), 0.70, c("seconds"), c("clean"), c("difference"), 0.25)
    rows = [changed(GOOD, four=None), changed(GOOD, raw=match(model(0.70), model(0.66), False, "strong", 0.6))]
    assert ask(spark, rows, schema, plain) == ["accepted", "raw_and_diagonal_evidence_below_floor"]


def test_floors_stop_at_their_least():
    low = rescue.lowered(rescue.RAW_FLOORS, 0.2)
    assert low == {k: least for k, (least, _) in rescue.RAW_FLOORS.items()}
    high = rescue.lowered(rescue.RAW_FLOORS, 0.9)
    assert all(math.isclose(high[k], 0.9 - below) for k, (_, below) in rescue.RAW_FLOORS.items())


def test_support_by_references(spark):
    schema = "a array<double>, b array<double>, c array<double>, d array<double>"
    rows = [
        ([0.5, 0.9, None], [0.4, 0.2, 0.9], [0.6, 0.3, 0.9], [0.1, 0.8, 0.9]),
        ([0.5], [0.4, 0.9], [0.6, 0.9], [0.3, 0.9]),
        ([], [], [], []),
        (None, [0.5], [0.5], [0.5]),
        ([NAN], [0.5], [0.5], [0.5]),
    ]
    c = [F.col(x) for x in "abcd"]
    got = [tuple(r) for r in ask(spark, rows, schema, rescue.four_way_support(*c))]
    assert got == [(2, 0.5, 0.2), (1, 0.5, 0.3), (0, 0.0, 0.0), (0, 0.0, 0.0), (0, 0.0, 0.0)]
    assert ask(spark, rows, schema, rescue.shared_references(*c)) == [2, 1, 0, 0, 0]


def diagonal(r, s, high=(0.70 - 0.14, 0.70 - 0.12)):
    r = [x if x == x else None for x in r or []]
    s = [x if x == x else None for x in s or []]
    both = [(x, y) for x, y in zip(r, s) if x is not None and y is not None]
    strong = [min(p) for p in both if p[0] >= high[0] and p[1] >= high[1]]
    if strong:
        return len(strong), max(strong)
    weak = [p for p in both if p[0] >= max(0.42, high[0] - 0.10) and p[1] >= max(0.46, high[1] - 0.10)]
    return (len(weak), min(max(x for x in r if x is not None), max(x for x in s if x is not None))) if weak else (0, 0.0)


def test_diagonal_support(spark):
    rnd = random.Random(5)
    draw = lambda: rnd.choice([None, []] + [[rnd.choice([None, NAN, 0.42, 0.47, 0.5, 0.56, 0.58, 0.7]) for _ in range(rnd.randrange(5))] for _ in range(9)])
    rows = [(draw(), draw()) for _ in range(200)]
    got = ask(spark, rows, "r array<double>, s array<double>", rescue.diagonal_support(F.col("r"), F.col("s"), 0.70))
    assert [tuple(g) for g in got] == [diagonal(r, s) for r, s in rows]


THIRD = model(0.6, 0.6, p20=0.55)


def test_whole_turn_and_fragment(spark):
    m = match(model(0.48, 0.43), model(0.53, 0.48))
    rows = [
        (m, THIRD, 2.2, True, True),
        (m, THIRD, 15.0, True, False),
        (m, THIRD, 8.0, True, True),
        (m, THIRD, 2.19, False, True),
        (m, THIRD, 0.74, False, False),
        (m, THIRD, NAN, False, False),
        (m, THIRD, None, False, False),
        ((True, *m[1:]), THIRD, 3.0, False, False),
        ((None, *m[1:]), THIRD, 3.0, True, True),
        ((False, "balanced", *m[2:]), THIRD, 3.0, False, True),
        ((False, None, *m[2:]), THIRD, 3.0, False, True),
        (match(model(0.51, 0.43), model(0.53, 0.48)), THIRD, 3.0, False, True),
        (match(model(0.40, 0.38), model(0.53, 0.48)), THIRD, 3.0, True, False),
        (match(model(0.48, 0.43), None), THIRD, 3.0, False, False),
        (m, model(0.6, 0.6, p20=0.53), 3.0, True, False),
        (m, model(0.6, 0.6, p20=0.519), 3.0, False, False),
        (m, model(0.6, 0.599), 3.0, False, False),
        (m, None, 3.0, False, False),
    ]
    c = (F.col("m"), F.col("t"), F.lit(0.6), F.col("s"))
    schema = f"m {MATCH}, t {MODEL}, s double, w boolean, f boolean"
    assert ask(spark, rows, schema, rescue.whole_turn_promoted(*c)) == [r[3] for r in rows]
    assert ask(spark, rows, schema, rescue.fragment_promoted(*c)) == [r[4] for r in rows]


def test_edge(spark):
    core, rest = match(model(0.6), model(0.55)), match(model(0.4), model(0.35))
    far = model(0.3)
    rows = [
        (core, rest, model(0.7), far, 0.5, True),
        (core, rest, model(0.7), far, 0.24, False),
        (core, rest, model(0.7), far, 0.91, False),
        (core, (True, *rest[1:]), model(0.7), far, 0.5, False),
        (core, match(model(0.4, 0.43), model(0.35)), model(0.7), far, 0.5, False),
        (core, match(model(0.46, 0.4), model(0.35)), model(0.7), far, 0.5, False),
        (core, match(model(0.4), None), model(0.7), far, 0.5, False),
        (core, rest, model(0.7), model(0.46), 0.5, False),
        (core, rest, model(0.7), model(0.3, 0.46), 0.5, False),
        (core, rest, model(0.62), model(0.40), 0.5, False),
        (core, rest, model(0.7), None, 0.5, False),
        (core, None, model(0.7), far, 0.5, False),
        (match(model(0.47, 0.6), model(0.55)), match(model(0.2), model(0.2)), model(0.7), far, 0.5, False),
    ]
    c = F.col
    rule = rescue.edge_promoted(c("a"), c("b"), c("x"), c("y"), F.lit(0.6), F.lit(2.0), c("s"))
    assert ask(spark, rows, f"a {MATCH}, b {MATCH}, x {MODEL}, y {MODEL}, s double, w boolean", rule) == [r[5] for r in rows]


def test_third_windows(spark):
    got = ask(spark, [(0.5,), (1.0,), (5.0,), (None,), (NAN,)], "s double", rescue.third_windows(F.col("s"), 0.8, 1.2, 0.25, 0.45))
    assert [tuple(g) for g in got] == [(0.8, 0.25), (1.0, 0.45), (1.2, 0.45), (None, None), (None, None)]


def test_confirmed_recall(spark):
    good = match(model(0.58, median=0.50, p20=0.50, votes=0.75), model(0.50, median=0.44, p20=0.46, votes=0.75), paired=0.49)
    worse = lambda **k: match(model(**({"score": 0.58, "median": 0.50, "p20": 0.50, "votes": 0.75} | k)), good[4], paired=0.49)
    rows = [
        (good, 0.9, True, True),
        (good, 0.899, True, False),
        (good, NAN, True, False),
        (good, 1.0, False, False),
        (good, 1.0, None, False),
        ((False, "rejected", *good[2:]), 1.0, True, False),
        (worse(votes=0.74), 1.0, True, False),
        (worse(p20=0.49), 1.0, True, False),
        (worse(median=0.49), 1.0, True, False),
        (worse(score=None, median=0.6, p20=0.6), 1.0, True, False),
        ((*good[:2], 0.48, *good[3:]), 1.0, True, False),
        (None, 1.0, True, False),
    ]
    rule = rescue.confirmed_recall(F.col("m"), F.col("c"), F.col("r"))
    assert ask(spark, rows, f"m {MATCH}, c double, r boolean, w boolean", rule) == [r[3] for r in rows]


CLUSTER = f"source string, turn long, seed boolean, refused boolean, match {MATCH}, coverage double, primary array<double>, secondary array<double>, cluster_promoted string, _seed_centre long, seeds long"


def unit(v):
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


@pytest.mark.parametrize("seed", [1, 2])
def test_promotion_by_cluster(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(240):
        near = lambda: unit([1.0] + [rnd.uniform(-0.45, 0.45) for _ in range(3)])
        p, s = near(), near()
        if rnd.random() < 0.1:
            p = rnd.choice([None, [], [0.5, None, 0.1, 0.2], [0.5, NAN, 0.1, 0.2], [1.0, 0.0]])
        level = rnd.choice([0.5, 0.6, 0.6, 0.7, None])
        m = match(model(level), model(0.6), tier=rnd.choice(["recall", "recall", "strong", None]))
        # source "a" holds a third of the rows, "few" has too few seeds
        source = rnd.choice(["a", "a", "b", "c", "few", None])
        rows.append((source, i, source != "few" and rnd.random() < 0.3, rnd.choice([True, True, False, None]), m, rnd.choice([0.84, 0.85, 1.0, None]), p, s, "old", 7, 8))
    rows += rows[:20]  # repeated rows count as rows
    whole = lambda v: v is not None and len(v) == 4 and all(x is not None and x == x for x in v)
    want = {}
    for r in rows:
        seeds = [x for x in rows if x[0] == r[0] and r[0] is not None and x[2] and whole(x[6]) and whole(x[7])]
        scores = [None, None]
        if len(seeds) >= 3:
            for k in (6, 7):
                if whole(r[k]):
                    centre = unit([sum(x[k][j] for x in seeds) for j in range(4)])
                    scores[k - 6] = sum(a * b for a, b in zip(centre, r[k]))
        ok = r[3] is True and r[4][1] == "recall" and (r[5] or 0) >= 0.85 and (r[4][3][0] or 0) >= 0.58 and None not in scores and scores[0] >= 0.78 and scores[1] >= 0.72
        want[r[1]] = (scores, ok)
    df = spark.createDataFrame(rows, CLUSTER).repartition(5)
    got = promote_by_cluster(df, ["source"], F.col("seed"), F.col("refused"), width=4)
    assert sorted(got.columns) == sorted([c for c in df.columns if c != "cluster_promoted"] + ["cluster_primary", "cluster_secondary", "cluster_promoted"])
    found = got.collect()
    assert len(found) == len(rows) and {r.seeds for r in found} == {8} and {r._seed_centre for r in found} == {7}
    for r in found:
        scores, ok = want[r.turn]
        assert r.cluster_promoted is ok
        for a, b in zip((r.cluster_primary, r.cluster_secondary), scores):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)
    assert 0 < sum(ok for _, ok in want.values()) < len(want)


def test_promotion_in_an_empty_table(spark):
    df = spark.createDataFrame([], CLUSTER)
    assert promote_by_cluster(df, ["source"], F.col("seed"), F.col("refused"), width=4).count() == 0
