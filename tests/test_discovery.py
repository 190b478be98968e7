"""Purity and order of voices, against plain loops."""

import math
import random
from statistics import mean, median

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import discovery as di

MEMBER = "source_id long, cluster_id long, member_id long, seconds double, score double, margin double, outlier boolean"
WINDOW = "cluster_id long, own boolean, accepted boolean, demoted boolean, cm_p double, cm_s double"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3, F.rand(1))


def number(x):
    return x is not None and math.isfinite(x)


def walk(members, windows):
    out = {}
    for cluster in {m[1] for m in members if m[1] is not None}:
        mine = [m for m in members if m[1] == cluster]
        scores, margins = ([m[k] for m in mine if number(m[k])] for k in (4, 5))
        cohesion, center = (f(scores) if scores else 0.0 for f in (mean, median))
        outliers = sum(bool(m[6]) for m in mine) / len(mine)
        distinct = median(margins) if margins else 0.0
        failures = []
        for _, own, accepted, demoted, p, s in (w for w in windows if w[0] == cluster):
            if own:
                failures.append(not accepted)
            elif number(p) and number(s):
                failures.append(not accepted and (p < -0.02 or s < -0.05))
            elif not demoted:
                failures.append(not accepted)
        ratio = mean(failures) if failures else 0.0
        signs = (cohesion < 0.4, outliers > 0.25, bool(margins) and distinct < -0.02, ratio > 0.45)
        flags = [n for n, sign in zip(di.FLAGS, signs, strict=True) if sign]
        purity = min(1.0, max(0.0, (cohesion + center) / 2 * (1 - min(0.8, outliers)) * (1 - 0.4 * ratio))) * (0.65 if flags else 1)
        out[cluster] = (len(mine), sum(m[3] for m in mine if number(m[3])), cohesion, center, outliers, distinct, ratio, flags, bool(flags), purity)
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_purity_and_order(spark, seed):
    rnd = random.Random(seed)
    odd = [None, math.nan, math.inf]
    members, windows = [], []
    for cluster in range(40):
        level = rnd.choice([0.2, 0.5, 0.8])
        for k in range(600 if cluster == 5 else rnd.choice([1, 2, 3, 8, 20])):  # a hot one
            score = rnd.choice(odd) if rnd.random() < 0.05 else level + rnd.choice([-0.2, 0, 0.1])
            margin = None if cluster % 9 == 0 else rnd.choice([*odd, -0.1, 0.2, level - 0.4])
            members.append((cluster % 4, cluster, 1000 * cluster + k, rnd.choice([None, 0.5, 2.5, 4.0]), score, margin, rnd.choice([None, False, False, False, True])))
            bits = lambda: rnd.choice([None, False, True, True])
            if cluster % 7:
                windows += [(cluster, bits(), bits(), bits(), rnd.choice([*odd, -0.03, -0.02, 0.1]), rnd.choice([None, -0.06, -0.05, 0.1, 0.1])) for _ in range(3)]
    members += [members[3], (1, None, 9, 1.0, 1.0, 1.0, False)]  # a repeated row, and one without a voice
    windows.append((None, True, False, None, None, None))
    got = di.cluster_purity(frame(spark, [(*m, "x") for m in members], MEMBER + ", flags string"), frame(spark, windows, WINDOW))
    names = "n_members seconds cohesion center outlier_ratio distinctiveness failure_ratio flags mixed purity".split()
    rows, want = {r.cluster_id: r for r in got.collect()}, walk(members, windows)
    assert rows.keys() == want.keys()
    for c, w in want.items():
        for name, x in zip(names, w, strict=True):
            assert rows[c][name] == (pytest.approx(x, abs=1e-9) if isinstance(x, float) else x), (c, name)
    assert {f for w in want.values() for f in w[7]} == set(di.FLAGS) and any(not w[8] for w in want.values())
    places = {(r.source_id, r.place): r.cluster_id for r in di.discovered_voices(got).collect()}
    for source in range(4):
        shown = [c for c in want if c % 4 == source and want[c][0] >= 3 and want[c][1] >= 8]
        shown.sort(key=lambda c: (rows[c].mixed, -rows[c].purity, -rows[c].distinctiveness, -rows[c].seconds, c))
        assert [places[source, k + 1] for k in range(len(shown))] == shown
    assert len(places) < len(want)


@pytest.mark.parametrize(
    "own, accepted, demoted, cm_p, cm_s, want",
    [
        (True, False, True, 0.5, 0.5, True), (True, True, False, -1.0, -1.0, False), (False, False, True, -0.02, -0.05, False),
        (False, False, True, -0.021, 0.0, True), (False, False, True, 0.0, -0.051, True), (False, True, False, -1.0, -1.0, False),
        (False, False, True, None, 0.0, None), (False, False, False, 0.0, None, True), (False, True, False, None, None, False),
    ],
)
def test_window_failed(spark, own, accepted, demoted, cm_p, cm_s, want):
    df = spark.createDataFrame([(1, own, accepted, demoted, cm_p, cm_s)], WINDOW)
    assert df.select(di.window_failed(*[F.col(c) for c in ("own", "accepted", "demoted", "cm_p", "cm_s")])).first()[0] == want


def test_margins_to_other_centres(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(120):
        v = rng.normal(size=4) + 2 * np.eye(4)[k % 3]
        rows.append((0 if k % 3 else k % 2, None if k == 7 else 10 * (0 if k % 3 else k % 2) + k % 3, k, (v / np.linalg.norm(v)).tolist()))
    got = di.centre_margins(frame(spark, rows, "source_id long, cluster_id long, member_id long, v array<double>"), 4)
    known = [r for r in rows if r[1] is not None]
    centres = {}
    for key in {r[:2] for r in known}:
        c = np.mean([r[3] for r in known if r[:2] == key], axis=0)
        centres[key] = c / np.linalg.norm(c)
    found = {r.member_id: r for r in got.collect()}
    assert found.keys() == {r[2] for r in known}
    for source, cluster, k, v in known:
        other = [float(np.dot(v, c)) for (s, x), c in centres.items() if s == source and x != cluster]
        assert found[k].primary_own == pytest.approx(float(np.dot(v, centres[source, cluster])))
        assert found[k].primary_other == (pytest.approx(max(other)) if other else None)
        assert found[k].primary_margin == (pytest.approx(found[k].primary_own - max(other)) if other else None)


def test_empty(spark):
    empty = di.cluster_purity(spark.createDataFrame([], MEMBER), spark.createDataFrame([], WINDOW))
    assert empty.count() == 0 and di.discovered_voices(empty).count() == 0
