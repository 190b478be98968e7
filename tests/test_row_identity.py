"""Repeated rows, and rows with nulls in other columns, are rows like any in the interval algebra."""

import random

import pytest

from cadenza.operators import intervals as iv

SCHEMA = "segment_id long, source_id long, start_ms long, end_ms long, note string, extra array<int>"


def rows_of(seed, n=40):
    rng = random.Random(seed)
    rows = [(rng.choice((None, 1, 2)), rng.randrange(3), s, s + rng.randrange(1, 90), rng.choice((None, "a")), rng.choice((None, [1]))) for s in (rng.randrange(400) for _ in range(n))]
    return rows + rows[:10]  # ten rows twice


@pytest.fixture(scope="module")
def tables(spark):
    a, b = rows_of(1), rows_of(2, 15)
    a += [(9, None, 0, 50, "no key", None), (9, 1, None, 50, "no start", None), (9, 1, 50, 50, "empty", None)]
    return a, b, spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)


def valid(r):
    return r[1] is not None and r[2] is not None and r[2] < r[3]


def points(b, s):
    return {p for y in b if y[1] == s for p in range(y[2], y[3])}


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("bucket", [11, 10**9])
def test_joins(tables, bucket):
    a, b, x, y = tables
    meet = lambda p, q: valid(p) and p[1] == q[1] and min(p[3], q[3]) > max(p[2], q[2])
    pairs = [(p, q) for p in a for q in b if meet(p, q)]
    flat = lambda p, q: (*p, *(q[:1] + q[2:] if q else (None,) * 5))
    join = lambda how: iv.overlap_join(x, y, how=how, bucket_ms=bucket)
    columns = [*x.columns, *(f"b_{c}" for c in y.columns if c != "source_id")]
    same(join("inner").select(columns).collect(), [flat(p, q) for p, q in pairs])
    lone = [p for p in a if not any(meet(p, q) for q in b)]
    same(join("left").select(columns).collect(), [flat(p, q) for p, q in pairs] + [flat(p, None) for p in lone])
    same(join("left_semi").select(x.columns).collect(), [p for p in a if p not in lone])
    same(join("left_anti").select(x.columns).collect(), lone)


def test_lengths_pieces_and_parts(spark, tables):
    a, b, x, y = tables
    cover = lambda p: len(set(range(p[2], p[3])) & points(b, p[1])) if valid(p) else 0
    same(iv.covered_length(x, y).select(*x.columns, "covered_ms").collect(), [(*p, cover(p)) for p in a])
    total = lambda p: sum(max(0, min(p[3], q[3]) - max(p[2], q[2])) for q in b if q[1] == p[1]) if valid(p) else 0
    same(iv.overlap_sum(x, y).select(*x.columns, "overlap_ms").collect(), [(*p, total(p)) for p in a])
    left = iv.subtract(x.where("start_ms < end_ms and source_id is not null"), y).collect()
    want = {}
    for p in filter(valid, a):
        want[repr((p[0], p[1], p[4], p[5], p[2], p[3]))] = want.get(repr((p[0], p[1], p[4], p[5], p[2], p[3])), 0) + len(set(range(p[2], p[3])) - points(b, p[1]))
    assert sum(r.end_ms - r.start_ms for r in left) == sum(want.values())
    cuts = spark.createDataFrame([(s, c) for s in range(3) for c in (50, 120, 121, 300)], "source_id long, cut_ms long")
    parts = []
    for p in filter(valid, a):
        edges = [p[2], *(c for c in (50, 120, 121, 300) if p[2] < c < p[3]), p[3]]
        parts += [(p[0], p[1], p[4], p[5], k, s, e) for k, (s, e) in enumerate(zip(edges, edges[1:], strict=False))]
    got = iv.split_at(x.where("start_ms < end_ms and source_id is not null"), cuts)
    same(got.select("segment_id", "source_id", "note", "extra", "part", "start_ms", "end_ms").collect(), parts)


@pytest.mark.parametrize("bucket", [13, 10**9])
def test_islands_over_bucket_borders(tables, bucket):
    a, _, x, _ = tables
    for gap in (0, 5):
        found = {}
        for r in iv.islands(x.where("start_ms < end_ms"), ["source_id"], gap, bucket_ms=bucket).collect():
            found.setdefault((r.source_id, r.island), []).append((r.start_ms, r.end_ms))
        want = []
        for s in range(3):
            high = None
            for p in sorted((p for p in a if valid(p) and p[1] == s), key=lambda p: p[2:4]):
                if high is None or p[2] > high + gap:
                    want.append([])
                    high = p[3]
                want[-1].append(p[2:4])
                high = max(high, p[3])
        assert sorted(sorted(v) for v in found.values()) == sorted(sorted(w) for w in want)
