import math
import random

import numpy as np
import pytest

from cadenza.operators import clusters, folds, learning

SEG = "segment_id long, source_id long, start_ms long, end_ms long"


def test_temperature_is_the_minimum(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 2, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(1.7 * x - 0.6)))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y, strict=True)], "score double, y int")
    a, b = learning.fit_temperature(df)
    loss = lambda a, b: float(np.mean(np.logaddexp(0, a * x + b) - y * (a * x + b)))
    assert all(loss(a, b) <= loss(a + da, b + db) + 1e-9 for da, db in [(0.01, 0), (-0.01, 0), (0, 0.01), (0, -0.01)])
    assert learning.fit_temperature(df.limit(0)) == (1.0, 0.0)


def test_propagation_is_the_iteration(spark):
    rng = random.Random(6)
    edges = sorted({(min(a, b), max(a, b)) for a, b in ((rng.randrange(12), rng.randrange(12)) for _ in range(25)) if a != b})
    edges = [(a, b, rng.random() + 0.1) for a, b in edges]
    labels = {0: 1.0, 5: 0.0, 30: 1.0}
    w = np.zeros((31, 31))
    for a, b, x in edges:
        w[a, b] = w[b, a] = x
    p = np.full(31, 0.5)
    for i, y in labels.items():
        p[i] = y
    for _ in range(25):
        t = w.sum(1)
        new = np.where(t > 0, 0.95 * (w @ p) / np.where(t > 0, t, 1) + 0.025, 0.5)
        for i, y in labels.items():
            new[i] = y
        p = new
    got = learning.propagate_labels(
        spark.createDataFrame(edges, "a long, b long, w double"), spark.createDataFrame([(i, int(y)) for i, y in labels.items()], "node long, y int"), rounds=25, tolerance=0.0
    ).collect()
    assert all(r.p == pytest.approx(p[r.node], abs=1e-9) for r in got) and {30} <= {r.node for r in got}


def test_chains_follow_to_the_last_parent(spark):
    links = [(i, i + 1) for i in range(1, 20)] + [(50, 20), (60, 61), (61, 60)]
    got = {r.id: (r.root, r.steps) for r in learning.chain_to_roots(spark.createDataFrame(links, "id long, parent long")).collect()}
    assert got == {i: (20, 20 - i) for i in range(1, 20)} | {50: (20, 1)}


def test_agglomeration_vetoes_and_merges(spark):
    unit = lambda t: [math.cos(t), math.sin(t)]
    rows = [(1, 1, unit(0.0), unit(0.0)), (1, 2, unit(0.1), unit(0.0)), (1, 3, unit(0.2), unit(3.1)), (1, 4, unit(2.0), unit(0.0)), (2, 5, unit(0.0), unit(0.0))]
    df = spark.createDataFrame(rows, "source_id long, vec_id long, primary array<double>, secondary array<double>")
    got = {r.vec_id: r.cluster for r in clusters.agglomerate(df, 0.9, 0.0).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5} or got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_determinant_order_is_greedy(spark):
    rng = np.random.default_rng(2)
    v, q = rng.normal(0, 1, (10, 3)), 1 + rng.random(10)
    k = np.outer(q, q) * np.exp(-((v[:, None] - v[None]) ** 2).sum(2) / 2)
    want: list = []
    for _ in range(5):
        want.append(max((i for i in range(10) if i not in want), key=lambda i: np.linalg.det(k[np.ix_([*want, i], [*want, i])])))
    df = spark.createDataFrame([(1, i, v[i].tolist(), float(q[i])) for i in range(10)], "source_id long, vec_id long, primary array<double>, quality double")
    assert [r.vec_id for r in clusters.determinant_order(df, 5).orderBy("place").collect()] == want
    far = [r.vec_id for r in clusters.farthest_points(df, 4).orderBy("place").collect()]
    assert far[0] == int(np.argmax(q)) and len(set(far)) == 4


def test_folds_by_hand(spark):
    cues = spark.createDataFrame([(1, 1, 0, 100, "a"), (2, 1, 2, 103, "b"), (3, 1, 3, 99, "a"), (4, 1, 50, 160, "c")], SEG + ", text string")
    assert sorted((r.start_ms, r.end_ms, r.text) for r in folds.fold_cues(cues, 5).collect()) == [(0, 100, "a / b"), (50, 160, "c")]
    rows = spark.createDataFrame([(1, 1, 10, 20, 5.0), (2, 1, 0, 40, 4.5), (3, 1, 30, 50, 1.0), (4, 1, 60, 70, 1.0)], SEG + ", value double")
    assert {r.segment_id for r in folds.replace_overlaps(rows, 2).collect()} == {2, 4}
    assert {r.segment_id for r in folds.space_out(rows, 15).collect()} == {1, 3, 4}
    words = spark.createDataFrame([(1, 1, 0, 100, [(0, 20), (25, 60), (70, 100)]), (2, 1, 0, 100, [(0, 100)])], SEG + ", words array<struct<start_ms:long,end_ms:long>>")
    got = sorted((r.segment_id, r.start_ms, r.end_ms, r.too_long) for r in folds.split_long(words, 50, 10).collect())
    assert got == [(1, 0, 22, False), (1, 22, 65, False), (1, 65, 100, False), (2, 0, 100, True)]
