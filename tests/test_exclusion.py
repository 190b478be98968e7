"""Exclusion audits against loops over rows and voices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import exclusion as ex

A = "array<double>"
ROWS = f"id long, primary {A}, secondary {A}, raw_primary {A}, raw_secondary {A}, third {A}, tier string"
REFS = f"voice string, primary {A}, secondary {A}, raw_primary {A}, raw_secondary {A}, third {A}"
CH = ["primary", "secondary", "raw_primary", "raw_secondary", "third"]


def unit(v):
    return np.array(v, float) / np.linalg.norm(v)


def world(seed):
    rng = np.random.default_rng(seed)
    voices = ["", "b", "a", "c"]
    base = {v: [rng.normal(size=4) for _ in CH] for v in voices}
    refs = [(v, *[None if (v, k) in (("c", 2),) else (base[v][k] + 0.3 * rng.normal(size=4)).tolist() for k in range(5)]) for v in voices for _ in range(4)]
    rows = []
    for i in range(150):
        w = rng.dirichlet([1.5, 1, 1, 1]) if i % 4 else np.array([0.94, 0.02, 0.02, 0.02])
        mix = lambda k, w=w: sum(x * base[v][k] for x, v in zip(w, voices, strict=True)) + 0.2 * rng.normal(size=4)
        rows.append((i, *[None if rng.random() < 0.08 else mix(k).tolist() for k in range(5)], ["tertiary", "raw_rescue", None][int(rng.integers(3))]))
    return rows, refs


def margins(row, refs, voice, k):
    own, other = ([unit(r[1 + k]) for r in refs if r[0] == v and r[1 + k] is not None] for v in ("", voice))
    if row[1 + k] is None or not own or not other:
        return None
    v = unit(row[1 + k])
    return v @ unit(sum(own)) - v @ unit(sum(other)), max(v @ r for r in own) - max(v @ r for r in other)


@pytest.mark.parametrize("seed, block", [(0, 4096), (1, 3)])
def test_audits(spark, seed, block):
    rows, refs = world(seed)
    order = [("b", 1), ("a", 2), ("c", 3)]
    df = spark.createDataFrame(rows, ROWS).repartition(3, F.rand(1))
    rf, of = spark.createDataFrame(refs, REFS), spark.createDataFrame(order, "voice string, place int")
    plain, multi = {}, {}
    against = lambda m: bool(m is not None and m[0] <= 0.02 and m[1] <= 0.02)
    for row in rows:
        found, votes = [], []
        for voice, place in order:
            p, s, rp, rs, t = (margins(row, refs, voice, k) for k in range(5))
            if p is None or s is None:
                continue
            vp, vs = against(p), against(s)
            raw = rp is not None and rs is not None
            conflict = row[6] == "tertiary" and (vp and min(s) < 0.15 or vs and min(p) < 0.15)
            rejected = vp and vs or conflict or raw and against(rp) and against(rs) or row[6] == "raw_rescue" and raw and against(rp) and vs
            found.append((not rejected, place if rejected else p[0] + s[0], place, voice))
            if t is not None:
                n = vp + vs + against(t)
                votes.append((n < 2, place if n >= 2 else p[0] + s[0] + t[0], place, voice, n, min(*p, *s, *t) >= 0.02))
        if found:
            b = min(found)
            plain[row[0]] = (b[3], not b[0])
        if votes:
            b = min(votes)
            multi[row[0]] = (b[3], not b[0], b[4], b[5] if not b[0] else all(v[5] for v in votes))
    got = {r.id: (r.voice, r.rejected) for r in ex.exclusion_audit(df, rf, of, block).collect()}
    assert got == plain and {True, False} <= {v[1] for v in plain.values()}
    got = {r.id: (r.voice, r.rejected, r.votes, r.all_clear) for r in ex.multimodel_audit(df, rf, of, block).collect()}
    assert got == multi and {True, False} <= {v[3] for v in multi.values()}


def test_without_voices(spark):
    rows, refs = world(2)
    df, of = spark.createDataFrame(rows, ROWS), spark.createDataFrame([], "voice string, place int")
    assert ex.exclusion_audit(df, spark.createDataFrame([r for r in refs if r[0] == ""], REFS), of).count() == 0
    assert ex.exclusion_audit(df, spark.createDataFrame([], REFS), of).count() == 0
