"""Promotions, anchors, seed lines and diverse picks against plain loops."""

import math
import random
from statistics import median, pstdev

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import promotion as pr
from cadenza.operators import seeds as sd
from cadenza.operators import turn_clusters as tc
from tests.test_turn_clusters import SCHEMA, profile_score, turns, unit


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3, F.rand(1))


@pytest.mark.parametrize("seed, noise", [(4, 0.6), (9, 1.1)])
def test_promotions(spark, seed, noise):
    rows, p, s = turns(seed, sources=4, n=40, noise=noise, d=6)
    rng = np.random.default_rng(seed)
    t = unit(rng.normal(size=6))
    other = unit(rng.normal(size=6))
    pick = lambda v: None if rng.random() < 0.25 else v.tolist()
    more = {r[1]: (pick(t + 0.5 * unit(rng.normal(size=6)) if rng.random() < 0.6 else other + 0.6 * unit(rng.normal(size=6))), pick(np.array(r[3]) + 0.4 * p[0]), pick(np.array(r[4]) + 0.4 * s[0]), float(rng.uniform(0, 1)), None if rng.random() < 0.3 else float(rng.uniform(0, 1))) for r in rows}
    df = spark.createDataFrame(rows, SCHEMA)
    prof = tc.TargetProfile(p[0].tolist(), s[0].tolist(), 0.55, 0.5)
    roles = [("r1", p[1].tolist(), s[1].tolist())]
    third = pr.ThirdChannel(t.tolist(), 0.6, [other.tolist()], (0.6, 0.7))
    judged, verdicts = tc.assign_target(df, tc.cluster_turns(df, 0.4), prof, roles, require_dominant=False)
    spot = {r[1]: (r[0], (r[1] % 100) * 100, (r[1] % 100) * 100 + 80) for r in rows}
    blocked = [(0, 500, 900), (2, 1000, 1001), (3, 50, 120)]
    full = [(*spot[r[1]][:1], r[1], *spot[r[1]][1:], r[3], r[4], *more[r[1]]) for r in rows]
    arr = "array<double>"
    schema = f"source_id long, turn long, start_ms long, end_ms long, primary {arr}, secondary {arr}, third {arr}, raw_primary {arr}, raw_secondary {arr}, char_score double, va_score double"
    got = {r.turn: (r.verdict, r.promoted_by) for r in pr.promoted(frame(spark, full, schema), judged, verdicts, frame(spark, blocked, "source_id long, start_ms long, end_ms long"), prof, roles, third).collect()}

    first, held = {r.turn: r.verdict for r in verdicts.collect()}, judged.collect()
    want = {}
    for row in full:
        source, turn, a, b, vp, vs, vt, rp, rs, ch, va = row
        if turn not in first:
            continue
        mine = [c for c in held if c.source_id == source]
        able = lambda x: not any(q[0] == x[0] and min(x[3], q[2]) > max(x[2], q[1]) for q in blocked)
        rivals = [c for c in mine if not c.target and (c.n >= 2 and c.seconds >= 2.5 or c.known_rival)]

        def wins(x, y, rivals=rivals, turn=turn):
            own = profile_score(x, prof.primary, []), profile_score(y, prof.secondary, [])
            them = [(roles[0][1], roles[0][2])] + [(c.primary_centroid, c.secondary_centroid) for c in rivals if turn not in c.members]
            return any(unit(np.array(x)) @ unit(u) >= max(0.55, own[0] - 0.02) and unit(np.array(y)) @ unit(w) >= max(0.5, own[1] - 0.02) for u, w in them)

        verdict, by = first[turn], None
        if able(row) and verdict != "core" and vt is not None:
            score = unit(vt) @ t
            beaten = score - unit(vt) @ other < 0.02 or wins(vp, vs)
            for c in rivals:
                vs3 = [unit(x[6]) for x in full if x[1] in c.members and x[6] is not None and able(x)]
                if turn not in c.members and vs3 and score - unit(vt) @ unit(np.mean(vs3, axis=0)) < 0.02:
                    beaten = True
            if score >= 0.62 and not beaten and (verdict in ("borderline", "near_miss") or ch >= 0.64 or va is not None and va >= 0.74):
                verdict, by = "core", "third"
        if able(row) and verdict != "core" and rp is not None and rs is not None and profile_score(rp, prof.primary, []) >= 0.59 and profile_score(rs, prof.secondary, []) >= 0.52 and not wins(rp, rs):
            verdict, by = "core", "raw"
        want[turn] = (verdict, by)
    assert got == want
    assert {"third", "raw"} <= {w[1] for w in want.values()}


def test_anchors(spark):
    rnd = random.Random(3)
    windows = []
    for i in range(400):
        a = rnd.randrange(0, 20000, 50)
        flags = [rnd.random() < 0.04 or None for _ in range(6)]
        num = lambda: rnd.choice([None, float("nan"), -0.1]) if rnd.random() < 0.05 else round(rnd.uniform(0.01, 1), 2)
        windows.append((i, i % 3, i % 7, a, a + rnd.choice([300, 600]), rnd.random() < 0.9, *flags, num(), num(), num(), num(), rnd.random() < 0.9))
    clean = [(s, t, a, a + 9000) for s in range(3) for t in range(7) for a in (0, 10000)]
    blocked = [(s, a, a + 100) for s in range(3) for a in (4000, 15000)]
    good = []
    for w in windows:
        i, s, t, a, b, acc, *flags, cp, cs, zp, zs, strict = w
        ok = acc and strict and not any(flags) and all(x is not None and x == x and x > 0 for x in (cp, cs, zp, zs))
        ok = ok and any(c[0] == s and c[1] == t and c[2] <= a and c[3] >= b for c in clean) and not any(c[0] == s and min(b, c[2]) > max(a, c[1]) for c in blocked)
        if ok:
            good.append((i, s, a, b, 1 / (1 + math.exp(-min(zp, zs, cp / 0.2, cs / 0.3)))))
    want = set()
    for s in range(3):
        mine, kept = [g for g in good if g[1] == s], []
        m = np.median([g[4] for g in mine])
        for g in sorted(mine, key=lambda g: (-g[4], g[2], g[3], g[0])):
            if g[4] >= m and not any(min(g[3], k[3]) > max(g[2], k[2]) for k in kept):
                kept.append(g)
        want |= {g[0] for g in kept}
    schema = "window_id long, source_id long, turn long, start_ms long, end_ms long, accepted boolean, smoothed boolean, reference boolean, raw_audit boolean, micro boolean, scene_supported boolean, compensated boolean, cm_p double, cm_s double, z_p double, z_s double, strict boolean"
    got = sd.prototype_anchors(frame(spark, windows, schema), frame(spark, clean, "source_id long, turn long, start_ms long, end_ms long"), frame(spark, blocked, "source_id long, start_ms long, end_ms long"), 0.2, 0.3)
    assert {r.window_id for r in got.collect()} == want and len(want) > 30


def lines_of(members, cues, windows):
    out = []
    clip = lambda x: max(0.0, min(1.0, x))
    for s, c, t, a, b, outlier, margin, mp, ms in members:
        if outlier or b <= a or margin is not None and not margin >= 0:
            continue
        met = [q for q in cues if q[0] == s and min(q[2], b) - max(q[1], a) > 50]
        spans = [(q[1], q[2], q[3], len(met) == 1) for q in met if q[1] >= a and q[2] <= b and not any(o is not q and min(q[2], o[2]) - max(q[1], o[1]) > 60 for o in met)] if met else [(a, b, "", False)]
        for x, y, text, single in spans:
            if not 1800 <= y - x <= 6000:
                continue
            rows = [w for w in windows if w[0] == s and w[1] == t and min(w[3], y) - max(w[2], x) >= 450]
            if not all(w[4] and not w[5] and w[6] is not None for w in rows):
                continue
            cover = len({m for w in rows for m in range(max(x, w[2]), min(y, w[3]))}) / (y - x)
            ps, ss = [w[6] for w in rows], [w[7] for w in rows if w[7] is not None]
            low = min(ps) if ps else mp if mp is not None else 0.5
            low2 = min(ss) if ss else ms if ms is not None else low
            var = max(pstdev(ps) if ps else 0.0, pstdev(ss) if ss else 0.0)
            margins = [min(w[8], w[9]) for w in rows if w[8] is not None and w[9] is not None]
            ex = min(margins) if margins else margin
            if var > 0.12 or ex is not None and ex < 0:
                continue
            d = (y - x) / 1000
            full = bool(rows) and cover >= 0.98
            q = 0.15 * (1.0 if 2 <= d <= 5.5 else 0.65) + 0.35 * clip(min(low, low2) - 2 * var) + 0.2 * (clip(0.5 + 2 * ex) if ex is not None else 0.35)
            q += (0.15 if single else 0.06 if text else 0) + (0.15 if full else 0.03 if margin is not None else 0)
            out.append((s, c, t, x, y, text, single, full, round(q, 5)))
    return sorted(out)


def test_seed_lines(spark):
    rnd = random.Random(5)
    members = [(i % 2, i % 5, i, a, a + rnd.choice([1500, 2500, 5000, 9000]), rnd.random() < 0.1 or None, rnd.choice([None, 0.0, 0.3, -0.1, float("nan")]), rnd.choice([None, 0.6]), rnd.choice([None, 0.7])) for i, a in enumerate(rnd.randrange(0, 60000, 10) for _ in range(120))]
    cues = sorted({(rnd.randrange(2), a, a + rnd.choice([1900, 2500, 4000]), rnd.choice(["one", "two", ""])) for a in (rnd.randrange(0, 60000, 10) for _ in range(16))})
    windows = []
    for s, _, t, a, b, *_ in members:
        if rnd.random() < 0.8:
            base = rnd.uniform(0.4, 0.9)
            for x in range(a, b, 500):
                windows.append((s, t, x, x + 1000, rnd.random() < 0.97, rnd.random() < 0.02 or None, base + rnd.uniform(-0.1, 0.1), rnd.choice([None, base]), rnd.choice([None, 0.2, rnd.uniform(-0.02, 0.3)]), 0.1))
    got = sd.seed_candidates(
        frame(spark, members, "source_id long, cluster long, turn long, start_ms long, end_ms long, outlier boolean, margin double, primary_score double, secondary_score double"),
        frame(spark, cues, "source_id long, start_ms long, end_ms long, text string"),
        frame(spark, windows, "source_id long, turn long, start_ms long, end_ms long, accepted boolean, smoothed boolean, primary double, secondary double, cm_p double, cm_s double"),
    ).collect()
    want = lines_of(members, cues, windows)
    assert sorted((r.source_id, r.cluster, r.turn, r.start_ms, r.end_ms, r.text, r.single_cue, r.windows_verified, r.quality) for r in got) == want
    assert len(want) > 15 and any(w[6] for w in want) and any(w[7] for w in want)


def test_diverse_picks(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(90):
        a = int(rng.integers(0, 40000))
        vec = lambda: None if rng.random() < 0.1 else rng.normal(size=4).tolist()
        rows.append((i % 2, i % 3, int(rng.integers(30)), a, a + int(rng.integers(1800, 6000)), round(float(rng.uniform(0.2, 0.9)), 5), vec(), vec()))
    want = []
    for key in {r[:2] for r in rows}:
        left = [r for r in rows if r[:2] == key]
        centres = sorted({(r[3] + r[4]) / 2 for r in left})
        typical = median([b - a for a, b in zip(centres, centres[1:], strict=False)])

        def distance(x, y, typical=typical):
            gap = abs(x[3] + x[4] - y[3] - y[4]) / 2
            t = gap / (gap + typical)
            both = [math.acos(max(-1, min(1, unit(np.array(x[k])) @ unit(np.array(y[k]))))) / math.pi for k in (6, 7) if x[k] is not None and y[k] is not None]
            return (t + sum(both) / len(both)) / 2 if both else t

        picked = []
        while left and len(picked) < 4:
            score = lambda r, picked=picked: r[5] * (1 + min((distance(r, q) for q in picked), default=0.0))
            best = max(left, key=lambda r: (score(r), r[5], -r[3], -r[2], -r[4]))
            want.append((*key, best[2], best[3], best[4], round(score(best), 5), len(picked) + 1))
            picked.append(best)
            left = [r for r in left if r[2] != best[2] and min(r[4], best[4]) <= max(r[3], best[3])]
    got = sd.diverse_seeds(frame(spark, rows, "source_id long, cluster long, turn long, start_ms long, end_ms long, quality double, primary array<double>, secondary array<double>"), 4)
    assert sorted(tuple(r) for r in got.select("source_id", "cluster", "turn", "start_ms", "end_ms", "selection_score", "place").collect()) == sorted(want)
