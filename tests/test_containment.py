"""Contained sequences against a walk over all longer kept ones and all offsets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import containment as ct


def correlation(a, b):
    a, b = a - a.mean(), b - b.mean()
    d = np.sqrt((a @ a) * (b @ b))
    return (a @ b) / d if d > 0 else 0.0


def walk(clips, width, shortest):
    """{id: (kept, part_of)} by comparing with every kept clip at every offset."""
    kept, out = [], {}
    for i, v in sorted(clips.items(), key=lambda c: (-len(c[1]) if c[1] is not None else 0, c[0])):
        out[i] = (True, None)
        ok = v is not None and len(v) >= max(shortest, width) and all(x is not None and np.isfinite(x) for x in v)
        if ok and np.var(v) >= 1e-12:
            q = np.array(v)
            for k, x in kept:
                if len(x) < len(q):
                    continue
                scores = [correlation(q, x[at : at + len(q)]) if np.var(x[at : at + len(q)]) >= 1e-12 else 0.0 for at in range(len(x) - len(q) + 1)]
                at = int(np.argmax(np.round(scores, 9)))
                part, fine = x[at : at + len(q)], scores[at] >= 0.98
                for s in [*range(0, max(1, len(q) - width + 1), max(1, width // 2)), len(q) - width]:
                    a, b = q[s : s + width], part[s : s + width]
                    if max(a.std(), b.std()) >= 1e-6 and correlation(a, b) < 0.98:
                        fine = False
                if fine:
                    out[i] = (False, k)
                    break
        if out[i][0] and ok:
            kept.append((i, np.array(v)))
    return out


def clips(seed, n=60):
    rng = np.random.default_rng(seed)
    out = {}
    for i in range(n):
        kind = rng.integers(8) if i > 15 else 0
        src = out[int(rng.integers(min(i, 16)))] if i else None
        if kind == 0 or src is None:
            v = np.cumsum(rng.normal(size=int(rng.integers(30, 120))))
        else:
            a = int(rng.integers(0, len(src) - 24))
            v = src[a : a + int(rng.integers(24, len(src) - a + 1))] * rng.uniform(0.1, 5) + rng.normal() * 10
            if kind == 2:
                v = v + rng.normal(size=len(v)) * v.std() * 0.02  # near copies
            if kind == 3:
                v = v + rng.normal(size=len(v)) * v.std() * 0.2  # at the limit or beyond
            if kind == 4:
                v[-6:] = rng.normal(size=6)  # an ending of its own
            if kind == 5:
                v = -v
            if kind == 6:
                v = src.copy()
            if kind == 7:
                v[: len(v) // 2] = v[0]  # half silent
        out[i] = v
    return out


def as_frame(spark, found):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], "x") for i, v in found.items()]
    return spark.createDataFrame(rows, "id long, values array<double>, n string").repartition(4, F.rand(1))


@pytest.mark.parametrize("seed", range(4))
def test_against_a_walk(spark, seed):
    found = clips(seed)
    got = {r.id: r for r in ct.deduplicate_sequences(as_frame(spark, found), 8, 24).collect()}
    want = walk(found, 8, 24)
    assert {i: r.kept for i, r in got.items()} == {i: w[0] for i, w in want.items()}
    assert sum(not w[0] for w in want.values()) > 10
    for i, r in got.items():
        if not r.kept and r.copy_of is None:
            assert r.part_of == want[i][1]
            assert correlation(found[i], found[r.part_of][r.at : r.at + len(found[i])]) >= 0.98


def test_odd_sequences(spark):
    base = np.sin(np.arange(80) * 0.7) + np.arange(80) * 0.01
    found = {
        1: base, 2: base[10:50], 3: base[10:50], 4: None, 5: [], 6: [1.0] * 60, 7: [*base[:40], float("nan")], 8: [None, *base[:40]],
        9: base[:10], 10: base * 3 + 1, 11: [1.0] * 60, 12: [float("inf")] * 40,
    }
    got = {r.id: r.kept for r in ct.deduplicate_sequences(as_frame(spark, found), 8, 24).collect()}
    assert got == {i: i not in (2, 3, 10) for i in found}


def test_many_copies_cost_one_lookup(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=50)
    found = {i: v for i in range(400)} | {1000: np.concatenate((rng.normal(size=9), v, rng.normal(size=5)))}
    got = ct.deduplicate_sequences(as_frame(spark, found), 8, 24).collect()
    assert [r.id for r in got if r.kept] == [1000]
    assert all(r.part_of == 1000 and r.at == 9 for r in got if r.id != 1000)


def test_empty(spark):
    assert ct.deduplicate_sequences(as_frame(spark, {}), 8, 24).count() == 0


def test_windows_that_correlate_enough_share_a_cell():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = rng.normal(size=16)
        b = a + rng.normal(size=16) * rng.uniform(0, 0.25) * a.std()
        if correlation(a, b) >= 0.98:
            (_, keys), = ct.probes(a, 16)
            at, _ = ct.window_coordinates(b, np.array([0]), 16)
            assert ct._key(ct._cells(at))[0] in keys
