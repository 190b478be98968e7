"""The evidence field and assessments against a field made cell by cell in plain Python."""

import math
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from cadenza.operators import trajectory as tr

OBS = "source_id long, start_ms long, end_ms long, kind string, value double"
SPAN = "source_id long, segment_id long, start_ms long, end_ms long"


def density(x, active, resolution):
    fam = {}
    for s, e, kind, value in active:
        if kind in ("boundary", "coarse_boundary"):
            continue
        w = max(2.220446049250313e-16, 1 - abs(x - (s + e) / 2) / ((e - s) / 2))
        v = value * resolution / ((e - s) / 1000) if kind == "source" else value
        t = fam.setdefault(kind, [0, 0, 0])
        t[0] += v * w
        t[1] += w
        t[2] += (e - s) / 1000 * w
    m = {k: t[0] / t[1] for k, t in fam.items()}
    wide = {k: t[2] / t[1] for k, t in fam.items()}
    positive = [o[3] for o in active if o[2] == "coarse" and o[3] > 0]
    b = max(positive) if positive else m.get("coarse", 0.0)
    if "micro" in m:
        b = b / (1 + abs(min(0, m["micro"]))) + max(0, m["micro"]) if b > 0 else m["micro"]
    b += m.get("source", 0)
    if "local" in m:
        v = m["local"] / (1 + b * b) if m["local"] < 0 and "consensus" in m and b > 0 else m["local"]
        b += v * max(1, resolution / wide["local"])
    if "island" in m:
        b += m["island"] / (1 + abs(b))
    if "fine" in m and ("coarse" in m or "island" in m):
        v = m["fine"] if b > 0 else min(0, m["fine"])
        if -math.asinh(1) < v < 0 and b > 0:
            v /= 1 + b * b
        p = resolution / wide["fine"]
        b += v * (p if v <= -math.asinh(1) else math.sqrt(p))
    elif "fine" in m:
        b = min(0, m["fine"])
    return b


def field(obs, blocked):
    """(a, b, left, right, observed, identity, blocked) of one source, times in milliseconds."""
    obs = sorted(set(obs))
    width = lambda k: [(o[1] - o[0]) / 1000 for o in obs if k in (None, o[2])]
    resolution = median(width("coarse") or width("micro") or width(None))
    micro = [o for o in obs if o[2] == "micro"]
    regions = []
    for o in (o for o in obs if o[2] == "coarse" and o[3] > 0):
        if regions and o[0] <= regions[-1][1]:
            regions[-1][1] = max(regions[-1][1], o[1])
        else:
            regions.append([o[0], o[1]])
    bars = set()
    for i, o in enumerate(micro):
        beside = any(p[3] < 0 and p[0] != o[0] and max(p[0], o[0]) <= min(p[1], o[1]) + 20 for p in micro[max(0, i - 1) : i] + micro[i + 1 : i + 2])
        if o[3] < 0 and (beside or not any(r[0] + 20 < o[0] and o[1] < r[1] - 20 for r in regions)):
            bars.add(o)
    points = sorted({x for o in obs for x in (o[0], (o[0] + o[1]) / 2, o[1])} | {x for b in blocked for x in b})
    cells = []
    for a, b in zip(points, points[1:], strict=False):
        act = [o for o in obs if o[0] < b and o[1] > a]
        m = [o for o in act if o[2] == "micro"]
        barrier = any(x < b and y > a for x, y in blocked) or any(o[2] == "boundary" for o in act)
        identity = any(o[2] not in ("fine", "boundary", "coarse_boundary") and o[3] > 0 for o in act)
        local = median((o[1] - o[0]) / 1000 for o in m) if m else resolution
        if m:
            identity = density((a + b) / 2, m, local) > 0 or any(o[2] == "coarse" and o[3] > 0 for o in act) or any(o[2] == "island_identity" for o in act)
            barrier = barrier or any(o in bars for o in m)
        elif any(o[2] == "coarse_boundary" for o in act):
            barrier = True
        left, right = (0.0, 0.0) if barrier else (density(a, act, local), density(b, act, local))
        cells.append((a, b, left, right, bool(act), identity, barrier))
    return cells, resolution


def assess(cells, s, e, steps=400):
    """By summing small pieces, each cut where the field crosses zero."""
    out = dict.fromkeys(("integral", "positive", "observed", "identity", "blocked", "negative"), 0.0)
    for a, b, left, right, seen, identity, barrier in cells:
        x, y = max(a, s), min(b, e)
        if x >= y:
            continue
        at = lambda t, a=a, b=b, left=left, right=right: left + (right - left) * (t - a) / (b - a)
        d = (y - x) / 1000
        out["integral"] += sum(at(x + (y - x) * (k + 0.5) / steps) for k in range(steps)) * d / steps
        u, v = at(x), at(y)
        if u * v < 0:
            z = abs(u) / (abs(u) + abs(v))
            out["positive"] += d * (z if u > 0 else 1 - z)
            out["negative"] += d * (-u * z if u < 0 else -v * (1 - z)) / 2
        else:
            out["positive"] += d * ((u + v) > 0)
            out["negative"] += max(0, -(u + v) / 2 * d)
        out["observed"] += d * seen
        out["identity"] += d * identity
        out["blocked"] += d * barrier
    return out


def world(seed, families):
    rnd = random.Random(seed)
    obs = []
    for s in range(3):
        for k, n, wide in families:
            for _ in range(n):
                a = rnd.randrange(0, 9000, 5)
                value = -math.inf if k == "boundary" else 0.0 if k in ("consensus", "island_identity", "coarse_boundary") else round(rnd.uniform(-1.5, 2.5), 3)
                obs.append((s, a, a + wide + rnd.randrange(0, 3) * wide // 4, k, value))
    obs += obs[:5]
    blocked = [(s, a, a + 150) for s in range(3) for a in (rnd.randrange(9000) for _ in range(2))]
    spans = [(i % 4, i, a, a + rnd.randrange(20, 4000)) for i, a in enumerate(rnd.randrange(-300, 9500) for _ in range(80))]
    return obs, blocked, spans


ALL = [("coarse", 14, 1500), ("micro", 10, 300), ("source", 2, 2000), ("local", 6, 500), ("island", 5, 700), ("fine", 20, 200), ("consensus", 5, 900), ("island_identity", 2, 600), ("boundary", 1, 100), ("coarse_boundary", 2, 200)]


@pytest.mark.parametrize("seed, families", [(0, ALL), (1, [("coarse", 20, 1200), ("fine", 15, 150)]), (2, [("fine", 30, 200), ("local", 4, 400)]), (3, [("micro", 40, 200), ("coarse", 6, 1000)])])
def test_field_and_assessments(spark, seed, families):
    obs, blocked, spans = world(seed, families)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3, F.rand(2))
    o = frame(obs, OBS)
    cells, scales = tr.build_field(o, frame(blocked, "source_id long, start_ms long, end_ms long"))
    got = sorted((r.source_id, r.start_ms / 2, r.end_ms / 2, round(r.left, 8), round(r.right, 8), r.is_observed, r.is_identity, r.is_blocked) for r in cells.collect())
    want, held = [], {}
    for s in range(3):
        held[s], resolution = field([x[1:] for x in obs if x[0] == s], [b[1:] for b in blocked if b[0] == s])
        want += [(s, a, b, round(left, 8), round(right, 8), *flags) for a, b, left, right, *flags in held[s]]
        assert abs({r.source_id: r.resolution for r in scales.collect()}[s] - resolution) < 1e-12
    assert got == sorted(want)
    rows = {r.segment_id: r for r in tr.assess_spans(frame(spans, SPAN), cells, scales, o).collect()}
    assert len(rows) == len(spans)
    for s, i, a, b in spans:
        w, r, d = assess(held.get(s, []), a, b), rows[i], (b - a) / 1000
        assert math.isclose(r.integral, w["integral"], abs_tol=1e-6) and math.isclose(r.negative_integral, w["negative"], abs_tol=1e-6)
        for k in ("positive", "observed", "identity", "blocked"):
            assert math.isclose(r[f"{k}_fraction"], w[k] / d, abs_tol=1e-6), (k, i)
        if r.supported:
            assert w["blocked"] == 0 and math.isclose(w["observed"], d) and w["integral"] > 0


def test_fine_evidence_of_a_span(spark):
    obs = [(1, 0, 1000, "coarse", 1.0), (1, 0, 200, "fine", 1.0), (1, 100, 300, "fine", -1.0), (1, 900, 1100, "fine", 2.0), (1, 950, 1050, "local", -0.5)]
    o = spark.createDataFrame(obs, OBS)
    cells, scales = tr.build_field(o, spark.createDataFrame([], "source_id long, start_ms long, end_ms long"))
    spans = spark.createDataFrame([(1, 1, 0, 1000), (1, 2, 300, 900), (1, 3, 2000, 3000), (9, 4, 0, 10)], SPAN)
    got = {r.segment_id: r for r in tr.assess_spans(spans, cells, scales, o).collect()}
    mean = (0.2 * 1 - 0.2 + 0.1 * 2) / 0.5
    var = (0.2 * (1 - mean) ** 2 + 0.2 * (-1 - mean) ** 2 + 0.1 * (2 - mean) ** 2) / 0.5
    assert math.isclose(got[1].fine_mean, mean) and math.isclose(got[1].fine_error, math.sqrt(var / 5)) and math.isclose(got[1].fine_covered_fraction, 0.4)
    assert got[1].edge_conflict and not got[2].edge_conflict and got[2].supported
    assert got[3].observed_fraction == 0 and not got[3].supported and got[4].integral == 0
