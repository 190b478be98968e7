import zlib

import numpy as np

from cadenza.llm import classifier as cl


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in cl.op7_nb_svm(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").count()
    assert len(got) == docs
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    test = [r for r in labels if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[r.doc_id].held_out for r in test) and 0 < sum(r.held_out for r in got.values()) < docs
    right = [got[r.doc_id].predicted == r.quality for r in test]
    assert sum(right) / len(right) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())


def test_features_are_a_set_of_the_whole_text():
    assert len(cl.features(None)) == len(cl.features("")) == 0
    assert (2 << 20) in cl.features("a b b c") and (2 << 20) not in cl.features("a b a b")
    assert (2 << 20) + 1 in cl.features("x y\nz\nx y") and (2 << 20) + 1 not in cl.features("x y\nz")
    a, b = cl.features("one two three"), cl.features("one two three " * 50 + "four")
    assert set(a[a >= 1 << 20]) <= set(b)
    assert len(cl.features(" \n\t ")) <= 1


def test_descent_separates_and_dual_is_right():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.choice(np.arange(0, 40) if k % 2 else np.arange(30, 70), 8)) for k in range(200)]
    labels = np.array([k % 2 for k in range(200)])
    m = cl.fit(rows, labels)
    assert np.mean([(m.margin(r) > 0) == (y == 1) for r, y in zip(rows, labels, strict=True)]) > 0.97
    assert cl.fit(rows, np.ones(200)) == 1.0 and cl.fit([], np.zeros(0)) == 0.5


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "", 5), (2, "x " * 100_000, 5), (2, "x", 5)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = cl.score_documents(docs, cl.train(docs, none))
    assert out.columns == ["doc_id", "text", "score", "_score", "predicted"] and out.count() == 4
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (2, None)], "doc_id long, quality int")
    assert all(0 <= r._score <= 1 for r in cl.score_documents(docs, cl.train(docs, labels)).collect())
    assert cl.score_documents(docs.limit(0), cl.train(docs, labels)).count() == 0


def brute_fit(sets, labels, cost=1.0):
    """NB-SVM by the definitions, dense: log-count ratios, unit rows, and the dual of the hinge
    loss solved by projected gradient, a method of its own."""
    names = sorted(set().union(*sets))
    x = np.array([[n in s for n in names] for s in sets], float)
    y = np.where(labels == 1, 1.0, -1.0)
    good, bad = 1 + x[y > 0].sum(0), 1 + x[y < 0].sum(0)
    ratio = np.log((good / good.sum()) / (bad / bad.sum()))
    x = x * ratio
    x /= np.sqrt((x**2).sum(1) + 1e-12)[:, None]
    x = np.hstack((x, np.ones((len(x), 1))))
    upper = cost * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    q = (x * y[:, None]) @ (x * y[:, None]).T
    step, alpha, at, t = 1 / np.linalg.eigvalsh(q)[-1], np.zeros(len(y)), np.zeros(len(y)), 1.0
    for _ in range(30_000):
        new = np.clip(at - step * (q @ at - 1), 0, upper)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        alpha, at, t = new, new + (t - 1) / s * (new - alpha), s
    w = (alpha * y) @ x
    loss = 0.5 * w @ w + (upper * np.maximum(0, 1 - y * (x @ w))).sum()
    return x @ w, loss, alpha.sum() - 0.5 * alpha @ q @ alpha


def test_model_is_the_optimum_of_a_reference_solver():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.choice(np.arange(0, 45) if k % 3 else np.arange(25, 70), rng.integers(3, 12))) for k in range(150)]
    labels = np.array([k % 3 > 0 for k in range(150)]).astype(int)
    labels[:10] = 1 - labels[:10]
    want, primal, dual = brute_fit([set(r.tolist()) for r in rows], labels)
    assert abs(primal - dual) < 1e-4 * primal  # the reference has solved it
    m = cl.fit(rows, labels, epochs=3000)
    got = np.array([m.margin(r) for r in rows])
    assert np.abs(got - want).max() < 2e-2
    few = cl.fit(rows, labels)  # as many rounds as in production
    assert np.abs(np.array([few.margin(r) for r in rows]) - want).max() < 0.25


def test_sample_of_long_texts_is_bounded(spark, monkeypatch):
    words = lambda i: " ".join(f"{'good' if i % 2 else 'bad'}{i}x{k}" for k in range(300))
    docs = spark.createDataFrame([(i, words(i)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    seen = []
    fit = cl.fit_packed
    monkeypatch.setattr(cl, "fit_packed", lambda flat, *a: seen.append(len(flat)) or fit(flat, *a))
    cl.train(docs, labels, grams_at_most=40_000)
    cl.train(docs, labels)
    assert 0 < seen[0] < 60_000 < seen[1]
