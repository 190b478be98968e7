"""Properties of the interval algebra, and brute-force versions of what SQL can't express."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza import streaming
from cadenza.operators import folds, greedy
from cadenza.operators import intervals as iv
from cadenza.operators.neighbours import nearest_vectors
from cadenza.plans.text_queries import lcs_ratio

SCHEMA = "segment_id long, source_id long, start_ms long, end_ms long"


def some(n, seed, sources=3, span=1000, longest=120):
    rng = random.Random(seed)
    return [(i, rng.randrange(sources), s, s + rng.randrange(1, longest)) for i, s in ((i, rng.randrange(span)) for i in range(n))]


def points(rows):
    out = {}
    for _, s, a, b in rows:
        out.setdefault(s, set()).update(range(a, b))
    return out


@pytest.mark.parametrize("bucket", [7, 100, 10**9])
def test_overlap_join_is_bucket_free(spark, bucket):
    a, b = some(60, 1), some(60, 2)
    got = iv.overlap_join(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), bucket_ms=bucket).select("segment_id", "b_segment_id").collect()
    want = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and min(x[3], y[3]) > max(x[2], y[2])}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_subtract_and_cover_partition_the_length(spark):
    a, b = some(40, 3), some(30, 4)
    x, y = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    blocked = points(b)
    left = iv.subtract(x, y).collect()
    for i, s, start, end in a:
        inside = {p for r in left if r.segment_id == i for p in range(r.start_ms, r.end_ms)}
        assert inside == set(range(start, end)) - blocked.get(s, set())
    covered = {r.segment_id: r.covered_ms for r in iv.covered_length(x, y).collect()}
    assert all(covered[i] == len(set(range(p, q)) & blocked.get(s, set())) for i, s, p, q in a)


def test_merge_is_idempotent_and_gap_is_exact(spark):
    rows = [(1, 1, 0, 10), (2, 1, 10, 20), (3, 1, 25, 30), (4, 1, 36, 40), (5, 1, 12, 13), (6, 2, 0, 5)]
    m = iv.merge(spark.createDataFrame(rows, SCHEMA), gap=5)
    assert sorted(tuple(r) for r in m.collect()) == [(1, 0, 30), (1, 36, 40), (2, 0, 5)]
    assert sorted(tuple(r) for r in iv.merge(m, gap=5).collect()) == sorted(tuple(r) for r in m.collect())


def test_remainder_gives_nothing_twice(spark):
    a, b, c = some(40, 5), some(10, 6), some(10, 7)
    out = iv.remainder(*(spark.createDataFrame(t, SCHEMA) for t in (a, b, c))).collect()
    seen = [(r.source_id, p) for r in out for p in range(r.start_ms, r.end_ms)]
    taken = {s: points(b).get(s, set()) | points(c).get(s, set()) for s in range(3)}
    assert len(seen) == len(set(seen))
    assert set(seen) == {(s, p) for s, ps in points(a).items() for p in ps - taken[s]}


def test_empty_and_null_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, 1, 0, 10), (2, None, 0, 10), (3, 1, None, 10)], SCHEMA)
    assert iv.merge(none).count() == 0 and iv.overlap_join(one, none).count() == 0
    assert [r.segment_id for r in iv.subtract(one.where("segment_id = 1"), none).collect()] == [1]
    assert iv.overlap_join(one, one).count() == 1


def test_greedy_suppression_is_the_walk(spark):
    rng = random.Random(11)
    edges = sorted({(a, b) for a, b in ((rng.randrange(80), rng.randrange(80)) for _ in range(220)) if a < b})
    kept = set()
    for i in range(80):
        if not any(b == i and a in kept for a, b in edges):
            kept.add(i)
    lost = {r.id for r in greedy.suppress(spark.createDataFrame(edges, "better long, worse long")).collect()}
    assert lost == set(range(80)) - kept
    assert greedy.suppress(spark.createDataFrame([], "better long, worse long")).count() == 0


def test_schedule_is_best(spark):
    from itertools import combinations

    rows = some(11, 13, sources=2, span=60, longest=25)
    got = folds.schedule(spark.createDataFrame(rows, SCHEMA)).collect()
    for s in range(2):
        mine = [r for r in rows if r[1] == s]
        ok = lambda c: all(x[3] <= y[2] or y[3] <= x[2] for x, y in combinations(c, 2))
        best = max(((sum(x[3] - x[2] for x in c), -len(c)) for k in range(len(mine) + 1) for c in combinations(mine, k) if ok(c)), default=(0, 0))
        chosen = [r for r in mine if r[0] in {g.segment_id for g in got}]
        assert ok(chosen) and (sum(x[3] - x[2] for x in chosen), -len(chosen)) == best


def test_merge_with_cap_and_absorb(spark):
    rows = [(1, 1, 0, 10, 5.0), (2, 1, 11, 20, 4.0), (3, 1, 21, 30, 6.0), (4, 1, 50, 52, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA + ", value double")
    got = sorted((r.start_ms, r.end_ms, r.n, r.score) for r in folds.merge_with_cap(df, 2, 20).collect())
    assert got == [(0, 20, 2, 4.0), (21, 30, 1, 6.0), (50, 52, 1, 1.0)]
    got = sorted((r.start_ms, r.end_ms, r.n) for r in folds.absorb_short(df, 5, 25).collect())
    assert got == [(0, 10, 1), (11, 20, 1), (21, 52, 2)]


def test_segmentation_is_best(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(0, 1, 9)
    df = spark.createDataFrame([(1, i + 1, float(x)) for i, x in enumerate(v)], "clip_id long, frame_idx long, level double")
    got = [(r.first, r.last) for r in folds.best_segmentation(df, 0.3, 2).collect()]

    def best(i):
        if i >= len(v):
            return 0.0
        return max([best(i + 1)] + [v[i:j].sum() - 0.3 + best(j) for j in range(i + 2, len(v) + 1)])

    assert sum(v[a - 1 : b].sum() - 0.3 for a, b in got) == pytest.approx(best(0))
    assert all(b - a >= 1 for a, b in got)


def test_nearest_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(0, 1, (60, 5))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>").repartition(4)
    got = {(r.vec_id, r.other) for r in nearest_vectors(df.where("vec_id % 10 = 0"), df, 3, -100.0).collect()}
    want = {(q, int(o)) for q in range(0, 60, 10) for o in sorted((i for i in range(60) if i != q), key=lambda i: (-v[q] @ v[i], i))[:3]}
    assert got == want


def test_lcs_ratio():
    assert lcs_ratio("abc", "abc") == 1.0 and lcs_ratio("", "a") == 0.0
    assert lcs_ratio("a-b c!", "ABXC") == pytest.approx(2 * 3 / 7)


def test_streams_give_the_rows_of_batch(spark, sf_dir, tmp_path):
    source = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts").coalesce(1)
    source.write.parquet(str(tmp_path / "in"))
    stream = streaming.read_events(spark, str(tmp_path / "in"), source.schema)

    def run(df, mode):
        q = df.writeStream.format("memory").queryName("out").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table("out").collect()

    funnel = run(streaming.running_funnel(stream), "complete")
    want = source.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour"), "event_type").count()
    assert sorted((r.start, r.event_type, r.n) for r in funnel) == sorted((r.window.start, r.event_type, r["count"]) for r in want.collect())
    kinds = run(streaming.distinct_content(stream, ["user_id", "event_type"], "1000 days"), "append")
    assert len(kinds) == source.select("user_id", "event_type").distinct().count()
    votes = run(streaming.sliding_votes(stream), "complete")
    assert sum(r.n for r in votes) == 2 * source.count()
    assert run(streaming.sessions(stream), "complete")
