"""Voices of turns: linkage one pair at a time, the graph's rounds, and the target's family, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import turn_clusters as tc

SCHEMA = "source_id long, turn long, seconds double, primary array<double>, secondary array<double>, role string, usable boolean"


def unit(v):
    return v / np.linalg.norm(v)


def turns(seed, sources=4, n=30, voices=4, noise=0.7, d=8):
    rng = np.random.default_rng(seed)
    p, s = ([unit(rng.normal(size=d)) for _ in range(voices)] for _ in "ps")
    out = []
    for source in range(sources):
        for t in range(n):
            k = int(rng.integers(voices))
            role = [None, None, None, "target" if k == 0 else f"other{k}"][int(rng.integers(4))]
            vec = lambda c: (unit(c[k] + noise * unit(rng.normal(size=d))) * rng.uniform(0.5, 2)).tolist()
            out.append((source, 100 * source + t, float(rng.integers(1, 5)), vec(p), vec(s), role, bool(rng.random() > 0.05)))
    return out, p, s


def one_by_one(rows, link, veto):
    """Clusters of one source by merging the best pair again and again, all sums afresh."""
    live = {r[1]: [r] for r in rows}
    sim = lambda a, b, c: float(unit(np.array(a[c])) @ unit(np.array(b[c])))

    def mean(a, b):
        roles = {r[5] for r in a} - {None}, {r[5] for r in b} - {None}
        if roles[0] and roles[1] and roles[0] != roles[1] or min(sim(x, y, 4) for x in a for y in b) < veto:
            return -9
        return np.mean([sim(x, y, 3) for x in a for y in b])

    while True:
        pairs = [(-mean(live[a], live[b]), a, b) for a in live for b in live if a < b]
        if not pairs or -min(pairs)[0] < link:
            return {r[1]: c for c, m in live.items() for r in m}
        _, a, b = min(pairs)
        live[a] += live.pop(b)


@pytest.mark.parametrize("seed, link, veto", [(0, 0.5, 0.05), (1, 0.3, -0.2), (2, 0.6, 0.4)])
def test_linkage(spark, seed, link, veto):
    rows, *_ = turns(seed, sources=2, n=18)
    df = spark.createDataFrame(rows, SCHEMA)
    usable = [r for r in rows if r[6]]
    want = {t: c for s in range(2) for t, c in one_by_one([r for r in usable if r[0] == s], link, veto).items()}
    assert len(set(want.values())) < len(want)
    graph = tc.link_graph(df.where("usable"), tc.neighbour_edges(df.where("usable"), 50, 7), link, veto)
    assert {r.turn: r.cluster for r in graph.collect()} == want
    labels = spark.createDataFrame(list(want.items()), "turn long, cluster long")
    sets = lambda d: {(r.source_id, frozenset(r.members)) for r in d.collect()}
    expected = sets(tc.tightened(df.where("usable"), df.select("source_id", "turn").join(labels, "turn")))
    assert sets(tc.cluster_turns(df, link, veto)) == expected
    assert sets(tc.cluster_turns(df, link, veto, dense=5, neighbours=50)) == expected


def test_farthest_members_leave(spark):
    rng = np.random.default_rng(3)
    base = unit(rng.normal(size=8))
    rows = [(1, i, 1.0, (base + 0.1 * rng.normal(size=8)).tolist(), base.tolist(), None, True) for i in range(12)]
    rows += [(1, 50, 1.0, (-base).tolist(), base.tolist(), None, True), (1, 51, 1.0, (-base + 0.3).tolist(), base.tolist(), None, True)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = df.select("source_id", "turn", F.lit(0).cast("long").alias("cluster"))
    (c,) = tc.tightened(df, labels).collect()
    assert c.members == list(range(12)) and c.cohesion >= 0.3 and c.seconds == 12


def profile_score(v, c, refs):
    v = unit(np.array(v, float))
    score = float(v @ unit(np.array(c)))
    near = sorted(float(v @ unit(np.array(r))) for r in refs)
    return max(score, sum(near[-2:]) / 2 - 0.02) if len(refs) > 1 else score


def by_loop(rows, clusters, prof, roles, margin, dominant):
    """{turn: verdict} of one source, in plain Python."""
    cl = sorted(clusters, key=lambda c: (-c.seconds, c.cluster))
    P = {c.cluster: round(profile_score(c.primary_centroid, prof.primary, prof.primary_references), 6) for c in cl}
    S = {c.cluster: round(profile_score(c.secondary_centroid, prof.secondary, prof.secondary_references), 6) for c in cl}
    dot = lambda a, b: float(np.array(a) @ np.array(b))
    gaps = {c.cluster: [(P[c.cluster] - dot(c.primary_centroid, p), S[c.cluster] - dot(c.secondary_centroid, s)) for _, p, s in roles] for c in cl}
    clear = lambda g, m: g[0] >= m or (g[0] >= m - 0.02 and g[1] >= m + 0.02)
    ok = [c for c in cl if P[c.cluster] >= prof.primary_floor and S[c.cluster] >= prof.secondary_floor and all(clear(g, margin) for g in gaps[c.cluster])]
    ids = {r[1]: c for c in cl for r in rows if r[1] in c.members}
    if not ok:
        return {r[1]: "none" for r in rows}
    low = lambda c: min(P[c.cluster], S[c.cluster])
    best = max(ok, key=low)
    aff = lambda a, b: (dot(a.primary_centroid, b.primary_centroid), dot(a.secondary_centroid, b.secondary_centroid))
    rivals = [c for c in ok if c is not best and low(c) >= low(best) - 0.015 and (aff(c, best)[0] < 0.68 or aff(c, best)[1] < 0.65)]
    best = max([best, *rivals], key=lambda c: P[c.cluster] + S[c.cluster])

    def family(c):
        a, b = aff(c, best)
        near = min(gaps[c.cluster], default=(9, 9))  # the nearest role: largest similarity, so least gap
        wide = clear(tuple(round(x, 6) for x in near), margin + 0.04)
        p, s = P[c.cluster], S[c.cluster]
        return a >= 0.72 and b >= 0.70 or p >= 0.66 and s >= 0.60 and wide or a >= 0.55 and b >= 0.50 and p >= prof.primary_floor + 0.1 and s >= prof.secondary_floor + 0.1 and wide

    fam = [c for c in ok if c is best or family(c)]
    if dominant and max(ok, key=lambda c: c.seconds) not in fam:
        return {r[1]: "none" for r in rows}
    strong = [c for c in cl if P[c.cluster] >= 0.66 and S[c.cluster] >= 0.60]
    cohort = [c for c in cl if c not in ok and c not in strong and (len(c.members) >= 2 and c.seconds >= 2.5 or any(r[5] not in (None, "target") for r in rows if r[1] in c.members))]
    out = {}
    for r in rows:
        c = ids.get(r[1])
        p, s = unit(np.array(r[3])), unit(np.array(r[4]))
        pp, sp = profile_score(p, prof.primary, prof.primary_references), profile_score(s, prof.secondary, prof.secondary_references)
        if c not in fam:
            out[r[1]] = "near_miss" if c is not None and pp >= prof.primary_floor + 0.03 and sp >= prof.secondary_floor - 0.2 else "none"
            continue
        mine = [x for x in rows if x[1] in c.members]
        pm, sm = (np.median([unit(np.array(x[k])) @ np.array(v) for x in mine]) for k, v in ((3, c.primary_centroid), (4, c.secondary_centroid)))
        pf, sf = max(pm - 0.18, prof.primary_floor - 0.03), max(sm - 0.2, prof.secondary_floor - 0.03)
        pe, se = max(pp, p @ np.array(c.primary_centroid)), max(sp, s @ np.array(c.secondary_centroid))
        po, so = (max((float(v @ np.array(getattr(x, k))) for x in cohort), default=-1.0) for v, k in ((p, "primary_centroid"), (s, "secondary_centroid")))
        beaten = po > pe + 0.01 and so > se - 0.02
        near = pe >= pf - 0.1 and se >= sf - 0.12
        out[r[1]] = "core" if pe >= pf and se >= sf and not beaten else "borderline" if near and (beaten or pe >= po) else "dropped"
    return out


@pytest.mark.parametrize("seed, noise, dominant", [(4, 0.5, False), (5, 0.9, False), (6, 1.2, True), (7, 1.0, False)])
def test_target_family(spark, seed, noise, dominant):
    rows, p, s = turns(seed, sources=5, n=40, noise=noise, d=6)
    df = spark.createDataFrame(rows, SCHEMA)
    rng = np.random.default_rng(seed)
    refs = [[unit(v[0] + 0.5 * unit(rng.normal(size=6))).tolist() for _ in range(3)] for v in (p, s)]
    prof = tc.TargetProfile(p[0].tolist(), s[0].tolist(), 0.55, 0.5, *refs)
    roles = [(f"r{k}", p[k].tolist(), s[k].tolist()) for k in (1, 2)]
    clusters = tc.cluster_turns(df, 0.4)
    judged, verdicts = tc.assign_target(df, clusters, prof, roles, require_dominant=dominant)
    got = {r.turn: r.verdict for r in verdicts.collect()}
    held = clusters.collect()
    want = {}
    for source in range(5):
        mine = [r for r in rows if r[0] == source and r[6]]
        want |= by_loop(mine, [c for c in held if c.source_id == source], prof, roles, tc.MARGIN, dominant)
    assert got == want and "core" in got.values()
    assert judged.count() == len(held)


def test_empty_and_single_turns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tc.cluster_turns(empty).count() == 0
    one = spark.createDataFrame([(1, 7, 2.0, [1.0, 0.0], [0.0, 1.0], None, True), (1, 8, 2.0, None, [0.0, 1.0], None, True), (2, 9, 1.0, [1.0, 0.0], [1.0, 0.0], None, False)], SCHEMA)
    (c,) = tc.cluster_turns(one).collect()
    assert (c.source_id, c.cluster, c.members) == (1, 7, [7])
