"""Rounds of growing references against a loop on one machine; anchors and adapted profiles by hand."""

import numpy as np
import pytest

from cadenza.operators import bootstrap as bs
from cadenza.operators import turn_clusters as tc

TURNS = "source_id long, turn long, start_ms long, end_ms long, seconds double, primary array<double>, secondary array<double>, usable boolean, clean_ms long, raw_rescued boolean"
SPAN = "source_id long, start_ms long, end_ms long"


def unit(v):
    return np.array(v, float) / np.linalg.norm(v)


def world(seed, sources=3, n=40, d=6):
    rng = np.random.default_rng(seed)
    p, s, op, os = (unit(rng.normal(size=d)) for _ in range(4))
    drift = [unit(rng.normal(size=d)) for _ in range(2)]
    turns, at = [], 0
    for source in range(sources):
        at = 0
        for k in range(n):
            start = at + int(rng.integers(-300, 400))
            at = start + int(rng.integers(800, 3000))
            far = rng.uniform(0, 1.5)
            own = rng.random() < 0.8
            a, b = ((c + far * e if own else o) + 0.35 * unit(rng.normal(size=d)) for c, e, o in ((p, drift[0], op), (s, drift[1], os)))
            clean = [None, at - start, at - start - 5][int(rng.choice(3, p=[0.7, 0.2, 0.1]))]
            turns.append((source, 1000 * source + k, max(0, start), at, float(rng.uniform(0.5, (at - start) / 1000)), a.tolist(), b.tolist(), bool(rng.random() < 0.95), clean, bool(rng.random() < 0.05)))
    profile = tc.TargetProfile(p.tolist(), s.tolist(), 0.78, 0.76)
    return turns, profile, [("other", op.tolist(), os.tolist())]


def loop(turns, profile, roles, core, sure, blocked, rounds):
    """{turn: round}, {(source, round): (used, new, total)} with arrays of supports and no tables."""
    by = {t[1]: t for t in turns}
    overlaps = lambda a, b: a[0] == b[0] and min(a[3], b[3]) > max(a[2], b[2])
    accepted, report, rests = dict.fromkeys(core, 0), {}, {}
    for source in {t[0] for t in turns}:
        mine = [t for t in turns if t[0] == source]

        def bank(mine=mine, source=source):
            rows = [t for t in mine if t[1] in accepted and t[7] and source in sure and t[8] in (None, t[3] - t[2]) and not t[9] and not any(b[0] == source and min(t[3], b[2]) > max(t[2], b[1]) for b in blocked)]
            kept = []
            for t in sorted(rows, key=lambda t: (-t[4], t[2], t[3], t[1])):
                if not any(unit(t[5]) @ unit(k[5]) >= 0.95 and unit(t[6]) @ unit(k[6]) >= 0.95 for k in kept):
                    kept.append(t)
            return kept

        refs = bank()
        for number in range(1, rounds + 1):
            if not refs:
                break
            new = {}
            for t in mine:
                if t[1] in accepted or not t[7]:
                    continue
                free = [r for r in refs if not any(overlaps(t, by[x]) for x in {r[1], *rests.get(r[1], ())})]
                ok = True
                for c, user, floor, other in ((5, profile.primary, profile.primary_floor, roles[0][1]), (6, profile.secondary, profile.secondary_floor, roles[0][2])):
                    centre = unit(user)
                    if free:
                        centre = 0.5 * centre + 0.5 * unit(sum(r[4] * unit(r[c]) for r in free))
                    score = unit(t[c]) @ unit(centre)
                    ok = ok and score >= floor and score - unit(t[c]) @ unit(other) >= bs.MARGIN
                if ok:
                    new[t[1]] = {x for r in free for x in {r[1], *rests.get(r[1], ())}}
            for t, on in new.items():
                accepted[t], rests[t] = number, on
            report[source, number] = (len(refs), len(new), sum(1 for t in mine if t[1] in accepted))
            refs = bank()
    return accepted, report


@pytest.mark.parametrize("seed", [0, 1])
def test_rounds(spark, seed):
    turns, profile, roles = world(seed)
    near = lambda t: unit(t[5]) @ unit(profile.primary) >= 0.9 and unit(t[6]) @ unit(profile.secondary) >= 0.9
    core = [t[1] for t in turns if t[7] and near(t)]
    blocked = [(s, 5000, 9000) for s in range(3)]
    sure = {0, 1}
    judged = [(s, 7, s != 2, True, 0.9 if s in sure else 0.7, 0.8, 0.4) for s in range(3)] + [(0, 8, True, False, 0.9, 0.9, 0.9)]
    judged = spark.createDataFrame(judged, "source_id long, cluster long, target boolean, best boolean, primary_score double, secondary_score double, least_margin double")
    of = {t[1]: t[0] for t in turns}
    accepted, report = bs.bootstrap_rounds(
        spark.createDataFrame(turns, TURNS).repartition(3), judged, spark.createDataFrame([(of[t], t, 7) for t in core], "source_id long, turn long, cluster long"),
        spark.createDataFrame(blocked, SPAN), profile, roles, rounds=4,
    )
    got = {r.turn: r["round"] for r in accepted.collect()}
    want, told = loop(turns, profile, roles, core, sure, blocked, 4)
    assert got == want and max(got.values()) >= 2
    rows = {(r.source_id, r["round"]): (r.used_refs, r.new_turns, r.accepted_turns) for r in report.collect()}
    assert rows == {k: v for k, v in told.items() if k in rows}
    assert all(v[1] == 0 for k, v in told.items() if k not in rows)


@pytest.mark.parametrize("rounds", [0, 11])
def test_number_of_rounds_is_bounded(spark, rounds):
    with pytest.raises(ValueError):
        bs.bootstrap_rounds(None, None, None, None, None, [], rounds=rounds)


def test_without_evidence_no_round_grows(spark):
    turns, profile, roles = world(3, sources=1)
    judged = spark.createDataFrame([], "source_id long, cluster long, target boolean, best boolean, primary_score double, secondary_score double, least_margin double")
    core = spark.createDataFrame([(0, turns[0][1], 7)], "source_id long, turn long, cluster long")
    accepted, report = bs.bootstrap_rounds(spark.createDataFrame(turns, TURNS), judged, core, spark.createDataFrame([], SPAN), profile, roles)
    assert accepted.count() == 1 and report.count() == 0


def test_bank_keeps_the_best_of_repeats(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, 1, 0, 9, 1.0, v, v, 0.8), (1, 2, 10, 19, 2.0, v, v, 0.8), (1, 3, 20, 29, 0.5, v, w, 0.8), (1, 4, 30, 39, 9.0, w, w, 0.7), (2, 5, 0, 9, 1.0, v, v, 0.8)]
    df = spark.createDataFrame(rows, "source_id long, turn long, start_ms long, end_ms long, seconds double, primary array<double>, secondary array<double>, confidence double")
    assert sorted(r.turn for r in bs.bank_of(df).collect()) == [2, 3, 4, 5]
    assert sorted(r.turn for r in bs.bank_of(df, most=1).collect()) == [2, 5]


def test_strict_anchors_at_their_limits(spark):
    schema = "i int, seconds double, silence_merged boolean, tier string, coverage double, speech_ratio double, recall_edges int"
    rows = [
        (2.2, None, "strong", 0.9, None, None), (2.19, None, "strong", 0.9, None, None), (4.5, None, "balanced", 0.95, 0.8, 0), (4.51, None, "strong", 0.95, 0.8, 0),
        (15.0, True, "short_strong", 0.9, 0.8, 0), (15.1, True, "strong", 0.9, 0.8, 0), (3.0, None, "weak", 0.9, 0.8, 0), (3.0, None, "strong", 0.89, 0.8, 0),
        (3.0, None, "strong", None, 0.8, 0), (3.0, None, "strong", 0.9, 0.79, 0), (3.0, None, "strong", 0.9, 0.8, 1), (None, None, "strong", 0.9, 0.8, 0),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
    assert sorted(r.i for r in bs.strict_anchors(df).collect()) == [0, 2, 4]
