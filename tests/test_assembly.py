"""Assembled sentences, installations and selections against plain walks over small tables."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import text as tf
from cadenza.operators import assembly, selection
from cadenza.sources import files

SCHEMA = "segment_id long, source_id long, start_ms long, end_ms long"


def some(n, seed, sources=2, span=600, longest=60, first=0):
    rng = random.Random(seed)
    return [(first + i, rng.randrange(sources), s, s + rng.randrange(1, longest)) for i, s in ((i, rng.randrange(span)) for i in range(n))]


def table(spark, rows, more=""):
    return spark.createDataFrame(rows, SCHEMA + more)


def by_source(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


def meets(rows, s, a, b):
    return any(r[1] == s and min(b, r[3]) > max(a, r[2]) for r in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_tracks(spark, seed):
    first, second, blocked, vetoes = (some(25, seed * 10 + k, first=100 * k, longest=40 if k < 2 else 9) for k in range(4))
    blocked, vetoes = blocked[:4], vetoes[:4]
    changes, certified = [(0, 0, 130, 0), (0, 1, 300, 0)], [(0, 0, 0, 320), (0, 1, 100, 500)]
    gap, cap, out = 12, 90, []
    for s, rows in by_source([(*r, 1) for r in first] + [(*r, 2) for r in second]).items():
        def conflict(a, b, s=s):
            return meets(blocked, s, a, b) or any(c[1] == s and a < c[2] < b for c in changes) or any(v[1] == s and a <= v[2] and v[3] <= b for v in vetoes)

        kept = []
        for _, _, a, b, track in sorted(rows, key=lambda r: (r[2], -r[3], r[0])):
            if conflict(a, b):
                continue
            if kept and kept[-1][0] <= a and kept[-1][1] >= b:
                kept[-1][2].add(track)
                continue
            if kept:
                low, high = kept[-1][0], max(kept[-1][1], b)
                if a - kept[-1][1] <= gap and high - low <= cap and any(c[1] == s and c[2] <= low and high <= c[3] for c in certified) and not conflict(low, high):
                    kept[-1][1] = high
                    kept[-1][2].add(track)
                    continue
                if a < kept[-1][1]:
                    if b - a > kept[-1][1] - low:
                        kept[-1] = [a, b, {track}]
                    continue
            kept.append([a, b, {track}])
        out += [(s, a, b, sorted(t)) for a, b, t in kept]
    points = spark.createDataFrame([(s, c) for _, s, c, _ in changes], "source_id long, cut_ms long")
    got = assembly.merge_tracks(table(spark, first), table(spark, second), table(spark, blocked), points, table(spark, vetoes), table(spark, certified), gap, cap)
    assert sorted((r.source_id, r.start_ms, r.end_ms, r.tracks) for r in got.collect()) == sorted(out)


def test_join_same_voice(spark):
    rng = random.Random(4)
    rows, at = [], 0
    for i in range(80):
        length, space = rng.randrange(20, 60), rng.choice((0, 3, 8, 15))
        angle = rng.choice((0.0, 0.3, 1.2))
        v = [float(np.cos(angle)), float(np.sin(angle))]
        rows.append((i, i % 2, at, at + length, rng.random() < 0.3, v, v))
        at += length + space if i % 2 else 0
    bars = [(900 + i, s, a, b) for i, (_, s, a, b) in enumerate(some(12, 9, span=at, longest=12))]
    out = []
    for s, mine in by_source(rows).items():
        kept = [[mine[0][2], mine[0][3], 1]]
        for p, r in zip(mine, mine[1:], strict=False):
            space = max(0, r[2] - p[3])
            barred = space > 0 and any(b[1] == s and min(r[2], b[3]) - max(p[3], b[2]) > 1 and not (b[2] <= p[2] + 2 and b[3] >= r[3] - 2) for b in bars)
            same = (p[4] and r[4]) or all(np.dot(p[k], r[k]) >= f for k, f in ((5, 0.9), (6, 0.9)))
            if space <= 8 and r[3] - kept[-1][0] <= 150 and not barred and same:
                kept[-1][1:] = [r[3], kept[-1][2] + 1]
            else:
                kept.append([r[2], r[3], 1])
        out += [(s, *k) for k in kept]
    got = assembly.join_same_voice(table(spark, rows, ", strict boolean, p array<double>, q array<double>"), table(spark, bars), 8, 150, (("p", 0.9), ("q", 0.9)), 2, 1)
    assert sorted(map(tuple, got.select("source_id", "start_ms", "end_ms", "n").collect())) == sorted(out)
    assert max(n for *_, n in out) > 2


def test_join_owned(spark):
    spans, bars = some(40, 5, longest=25), some(6, 6, longest=8)
    units = [(*r, r[0] % 3 > 0) for r in some(20, 7, longest=120)]
    least, bridge, out = 15, 20, []

    def owner(s, a, b):
        held = [u for u in units if u[1] == s and 2 * u[2] <= a + b <= 2 * u[3]]
        return min(held, key=lambda u: (u[3] - u[2], not u[4], -max(0, min(b, u[3]) - max(a, u[2])), u[0]), default=None)

    for s, mine in by_source(spans).items():
        kept = []
        for _, _, a, b in mine:
            if kept:
                low, high, n = kept[-1]
                x, y = owner(s, low, high), owner(s, a, b)
                fit = min(high - low, b - a) < least or (x and x[4] and y and x[0] == y[0])
                if a <= high or (a - high <= bridge and not meets(bars, s, high, a) and fit):
                    kept[-1] = [low, max(high, b), n + 1]
                    continue
            kept.append([a, b, 1])
        out += [(s, *k) for k in kept]
    u = spark.createDataFrame([(s, a, b, i, ok) for i, s, a, b, ok in units], "source_id long, start_ms long, end_ms long, unit_id long, accepted boolean")
    got = assembly.join_owned(table(spark, spans), u, table(spark, bars), least, bridge)
    assert sorted(map(tuple, got.collect())) == sorted(out)


def test_absorb_remainders(spark):
    rows, blocked = some(16, 11, longest=30), some(5, 12, longest=8)
    spans = [(500 + i, s, max(0, a - 9 * (i % 4)), b + 7 * (i % 5)) for i, (_, s, a, b) in enumerate(rows)]
    out, least = [], 20
    for s, mine in by_source(rows).items():
        now = [[i, a, b] for i, _, a, b in mine]
        for r in now:
            for _, _, low, high in sorted((x for x in spans if x[1] == s), key=lambda x: x[2:]):
                if not low <= r[1] < r[2] <= high:
                    continue
                a, b = low if 0 < r[1] - low < least else r[1], high if 0 < high - r[2] < least else r[2]
                others = [(0, s, *o[1:]) for o in now if o is not r]
                if (a, b) != (r[1], r[2]) and not meets(others, s, a, b) and not meets(blocked, s, a, b):
                    r[1:] = [a, b]
        out += [(s, *r) for r in now]
    got = assembly.absorb_remainders(table(spark, rows), table(spark, spans), table(spark, blocked), least)
    assert sorted((r.source_id, r.segment_id, r.start_ms, r.end_ms) for r in got.collect()) == sorted(out)
    assert got.where("joined").count()


def test_install(spark):
    proposals, accepted = some(30, 13, longest=70), some(25, 14, first=100)
    states = [(*r, ("target", "other", "unresolved")[r[0] % 3]) for r in some(18, 15, longest=20)]

    def state(s, a, b):
        worst = "uncontested"
        for _, t, x, y, kind in states:
            low, high = max(a, x), min(b, y)
            if t != s or low >= high or kind == "target":
                continue
            if kind == "other":
                return "other"
            inside = {p for _, u, v, w, k in states if u == s and k == "target" and x <= v and w <= y for p in range(v, w)}
            worst = "unresolved" if not set(range(low, high)) <= inside else worst
        return worst

    out = {}
    for s, mine in by_source(proposals).items():
        kept = [(a, b) for _, t, a, b in accepted if t == s]
        for i, _, a, b in mine:
            hit = [k for k in kept if min(k[1], b) > max(k[0], a)]
            ok = state(s, a, b) == "uncontested" and all(a <= x and b >= y for x, y in hit)
            kept = [k for k in kept if k not in hit] + [(a, b)] if ok else kept
            out[i] = ok
    e = table(spark, states, ", state string")
    got = {r.segment_id: r.installed for r in assembly.install(table(spark, proposals), table(spark, accepted), e).collect()}
    assert got == out and any(out.values()) and not all(out.values())
    assert {r.segment_id: r.state for r in assembly.local_conflicts(table(spark, proposals), e).collect()} == {i: state(s, a, b) for i, s, a, b in proposals}


def test_distinct_timed_texts(spark):
    rng = random.Random(16)
    rows = [(i, rng.randrange(2), a, a + rng.randrange(-5, 1500), rng.choice(("a b", "ab", "c", " ", "d　e", "de"))) for i, a in ((i, rng.randrange(20_000)) for i in range(150))]
    out = []
    for s in (0, 1):
        kept = []
        for i, _, a, b, t in sorted((r for r in rows if r[1] == s), key=lambda r: (r[2], r[3], r[0])):
            key = "".join(t.split())
            if not key or b <= a:
                continue
            for k in reversed(kept):
                if a - k[1] > 1000:
                    kept.append([i, a, b, key])
                    break
                if k[3] == key and (min(b, k[2]) > max(a, k[1]) or abs(a - k[1]) <= 350 and abs(b - k[2]) <= 750):
                    if b - a > k[2] - k[1]:
                        k[:3] = [i, a, b]
                    break
            else:
                kept.append([i, a, b, key])
        out += [k[:3] for k in kept]
    got = assembly.distinct_timed_texts(table(spark, rows, ", text string"))
    assert sorted((r.segment_id, r.start_ms, r.end_ms) for r in got.collect()) == sorted(map(tuple, out)) and len(out) < 110


def test_parallel_captions(spark):
    cues = [
        (1, 1, 0, 1000, "こんにちは", "speech", ""), (2, 1, 50, 1100, "你好", "speech", ""), (3, 1, 3000, 4000, "你好", "speech", ""), (4, 1, 3100, 4100, "こんにちは", "speech", ""),
        (5, 1, 6000, 7000, "a b", "speech", "x"), (6, 1, 6000, 7000, "ab", "speech", "y"), (7, 1, 6010, 7010, "a  b", "speech", "y"), (8, 1, 9000, 9500, "la", "lyrics", ""), (9, 1, 9000, 9500, "la", "speech", ""),
        (10, 1, 12000, 13000, "hello", "speech", ""), (11, 1, 12000, 13000, "こんにちは", "speech", ""), (12, 2, 0, 1000, "こんにちは", "speech", ""), (13, 2, 150, 1150, "こん にちは", "speech", None), (14, 2, 151, 1151, "こんにちは", "speech", ""),
    ]
    got = assembly.fold_parallel_captions(table(spark, cues, ", text string, kind string, actor string"))
    want = [(1, "こんにちは"), (3, "こんにちは"), (5, "a b"), (6, "ab"), (8, "la"), (9, "la"), (10, "hello"), (11, "こんにちは"), (12, "こんにちは"), (14, "こんにちは")]
    assert sorted((r.segment_id, r.text) for r in got.collect()) == want


def greedy(rows, core, extended):
    f = np.array([r[2] for r in rows], float)
    for c in range(f.shape[1]):
        ok = np.isfinite(f[:, c])
        f[~ok, c] = np.median(f[ok, c])
        f[:, c] = np.clip((f[:, c] - np.median(f[:, c])) / max(f[:, c].std(), 1.0), -4, 4)
    n = len(rows)
    marks = f[np.linspace(0, n - 1, min(n, 256)).astype(int)]
    like = np.exp(-((f[:, None] - marks[None]) ** 2).sum(-1) / 5)
    counts = {}
    for r in rows:
        for t in set(r[1]):
            counts[t] = counts.get(t, 0) + 1
    covered, seen, order = set(), np.zeros(len(marks)), []
    while len(order) < min(n, extended):
        gain = lambda i: sum(counts[t] ** -0.5 for t in set(rows[i][1]) - covered) + 3 * np.maximum(0, like[i] - seen).mean() + 0.05 * rows[i][3]  # noqa: B023, E731
        best = max((i for i in range(n) if i not in order), key=lambda i: (round(gain(i), 9), -rows[i][0]))
        order.append(best)
        covered |= set(rows[best][1])
        seen = np.maximum(seen, like[best])
    return {rows[i][0]: (k, "core" if k < core else "extended") for k, i in enumerate(order)}


@pytest.mark.parametrize("pool", [1024, 7])
def test_subsets(spark, pool):
    rng = random.Random(17)
    rows = [(i, [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(4)) for _ in range(rng.randrange(9))], [rng.gauss(0, 3) if rng.random() < 0.9 else float("nan") for _ in range(3)], rng.random()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, features array<double>, quality double")
    got = {r.id: (r.place, r.subset) for r in selection.select_subsets(df, 10, 30, 3, pool).collect()}
    want = greedy(rows, 10, 30)
    assert {i: p for i, p in got.items() if p[0] is not None} == want and len(got) == 60
    assert {p for i, p in got.items() if i not in want} == {(None, "redundant")}
    assert selection.select_subsets(df.limit(0)).count() == 0


def test_plane(spark):
    x = np.random.default_rng(18).normal(size=(200, 6)) * [5, 3, 1, 0.5, 0.2, 0.1] @ np.linalg.qr(np.random.default_rng(19).normal(size=(6, 6)))[0] + 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, primary array<double>")
    got = np.array([(r.x, r.y) for r in selection.plane(df).orderBy("vec_id").collect()])
    axes = np.linalg.svd(x - x.mean(0))[2][:2].T
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), [0, 1]])
    want = (x - x.mean(0)) @ axes
    assert np.allclose(got, want / np.abs(want).max(0)) and np.abs(got).max() <= 1 + 1e-9
    assert selection.plane(df.limit(0)).count() == 0


def test_text_functions(spark):
    rows = [("これ", "en", "ja"), ("你好", "auto", "zh"), ("你好", "Japanese", "ja"), ("hi", "Mandarin", "zh"), ("hi", "", "auto"), ("hi", None, "auto"), (None, "EN", "en")]
    df = spark.createDataFrame(rows, "t string, r string, w string")
    assert [r.got for r in df.select(tf.infer_language(F.col("t"), F.col("r")).alias("got")).collect()] == [w for *_, w in rows]
    cases = [("ab cd.  ef", ["ab", "cd.", "ef"], [0, 3, 8, 10]), ("ab", ["a", "c"], None), ("ab", ["ab", ""], None), ("a b", ["a b"], [0, 3]), (" a b", ["a", "b"], [0, 3, 4]), ("", [], None)]
    df = spark.createDataFrame([c[:2] for c in cases], "t string, f array<string>")
    assert [r.got for r in df.select(tf.text_cuts(F.col("t"), F.col("f")).alias("got")).collect()] == [c[2] for c in cases]


def test_reviews_reports_and_clips(spark, tmp_path):
    (tmp_path / "b" / "x").mkdir(parents=True)
    (tmp_path / "b" / "review_v2.json").write_text(json.dumps({"reviews": {"1": {"label": "correct", "ordinal": 1, "bad": 2, "partial_texts": [{"start": 0, "end": 1, "text": "t"}]}, "2": "no", "3": None}, "other": 1}, indent=1))
    got = files.read_reviews(spark, str(tmp_path)).collect()
    assert [(r.key, r.label, r.ordinal, r.partial_texts[0].text) for r in got] == [("1", "correct", 1, "t")] and "bad" not in got[0].asDict()
    for folder, what in ((".", {"clusters": [{"id": 1}, {"id": 2}]}), ("x", {"clusters": [{"id": 3}]}), ("x/y", {"clusters": "no"})):
        (tmp_path / "b" / folder).mkdir(exist_ok=True)
        (tmp_path / "b" / folder / "cluster_report.json").write_text(json.dumps(what))
    reports = files.read_cluster_reports(spark, str(tmp_path / "b")).collect()
    assert sorted((r.folder, json.loads(r.cluster)["id"]) for r in reports) == [(".", 1), (".", 2), ("x", 3)]
    spans = spark.createDataFrame([(1, 100, 5000), (1, 5300, 9000), (1, 20_000, 20_500), (2, 0, 300)], "source_id long, start_ms long, end_ms long")
    lengths = spark.createDataFrame([(1, 60_000), (2, 4000), (3, 900)], "source_id long, length_ms long")
    clips = sorted(map(tuple, files.reference_clips(spans, lengths).collect()))
    assert clips == [(1, 1, 50, 8050), (1, 2, 8050, 9050), (2, 1, 0, 4000), (3, 1, 0, 900)]


def test_bank_and_change_points(spark, sf_dir):
    from cadenza.plans.catalogue import queries
    from cadenza.plans.vector_queries import vectors

    v = sorted(vectors(spark, sf_dir).collect(), key=lambda r: (-round(float(np.dot(r.primary, r.secondary)), 6), r.role, r.vec_id))
    kept = []
    for r in v:
        if not any(k.source_id == r.source_id and np.dot(k.primary, r.primary) >= 0.25 and np.dot(k.secondary, r.secondary) >= 0.1 for k in kept):
            kept.append(r)
    assert {r.vec_id for r in queries()["D3_bank_dedupe"](spark, sf_dir).collect()} == {r.vec_id for r in kept[:500]} and len(kept) < len(v)
    points, taken = [], []
    ordered = sorted(v, key=lambda r: (r.source_id, r.start_ms, r.vec_id))
    for p, r in zip(ordered, ordered[1:], strict=False):
        if p.source_id == r.source_id and 1 - np.dot(p.primary, r.primary) > 0.9:
            points.append((1 - float(np.dot(p.primary, r.primary)), (p.start_ms + r.start_ms) // 2, r))
    for _, at, r in sorted(points, key=lambda x: (-x[0], x[1])):
        if all(s != r.source_id or abs(at - t) >= 3000 for s, t, _ in taken):
            taken.append((r.source_id, at, r.vec_id))
    got = {r.segment_id for r in queries()["W9_change_points"](spark, sf_dir).collect()}
    assert got == {i for *_, i in taken} and 1 < len(got) < len(points)


def test_holdout_without_a_split(spark):
    from cadenza.operators.evaluation import holdout_sources

    for rows in ([("a", 1), ("b", 0)], [("a", 1), ("b", 1), ("c", 1)], [("a", 0), ("b", 1), ("c", 1)], []):
        got = holdout_sources(spark.createDataFrame(rows, "source string, label int"))
        assert not got.where("held").count() and got.count() == len(rows)
    got = holdout_sources(spark.createDataFrame([(s, y) for s in "abcdef" for y in (0, 1)], "source string, label int"))
    assert got.where("held").count() == 1


def test_quantiles_of_groups(spark):
    from cadenza.operators.evaluation import group_quantiles, grouped_sums, quantile

    rng = random.Random(20)
    rows = [(rng.choice("ab"), rng.choice((float(rng.randrange(9)), None, float("nan"), rng.random()))) for _ in range(200)] + [("c", 5.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    finite = {g: [v for h, v in rows if h == g and v is not None and v == v] for g in "abc"}
    for q in (0.0, 0.3, 0.5, 0.95, 1.0):
        got = {r.g: r.q for r in group_quantiles(df, "g", "v", q, "q").collect()}
        assert got == {g: pytest.approx(float(np.quantile(v, q))) for g, v in finite.items()}
        assert quantile(df, "v", q) == pytest.approx(float(np.quantile(sum(finite.values(), []), q)))
    assert quantile(df.limit(0), "v", 0.5) is None
    sums = grouped_sums(spark.createDataFrame([("a", 1, 2), ("a", 3, 4), ("b", 1, 8)], "g string, o int, n long"), "g", "o", ["n"])
    assert sorted(map(tuple, sums.select("g", "o", "sum_n", "total_n").collect())) == [("a", 1, 2, 6), ("a", 3, 6, 6), ("b", 1, 8, 8)]


def test_propagation_query(spark, sf_dir):
    from cadenza.plans.catalogue import queries
    from cadenza.plans.decision_queries import affinities
    from cadenza.plans.vector_queries import vectors

    v = {r.vec_id: r.role for r in vectors(spark, sf_dir).collect()}
    y = {i: float(r == 3) for i, r in v.items() if r in (3, 5)}
    p = {i: y.get(i, 0.5) for i in v}
    edges = {}
    for a, b, w in affinities(spark, sf_dir).collect():
        edges.setdefault(a, []).append((b, w))
    for _ in range(80 if len(y) >= 10 else 0):
        new = {i: y[i] if i in y else 0.95 * sum(w * p[b] for b, w in edges[i]) / sum(w for _, w in edges[i]) + 0.025 if i in edges else 0.5 for i in v}
        moved = max(abs(new[i] - p[i]) for i in v)
        p = new
        if moved < 1e-6:
            break
    got = {r.node: r.p for r in queries()["V13_propagation"](spark, sf_dir).collect()}
    assert all(abs(x - p[i]) < 1e-5 for i, x in got.items()) and set(y) <= set(got)
