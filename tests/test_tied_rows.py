"""Many rows with equal bounds, dealt over partitions in changing order: islands, merges and folded runs are those of a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import intervals as iv


def tied_rows(seed, n=600):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        start = rnd.randrange(40) * 50
        rows.append((i, rnd.randrange(3), start, start + rnd.choice([10, 10, 30, 60])))
    return rows + [(n + i, *rnd.choice(rows)[1:]) for i in range(n)]


def loop(rows, gap):
    out = {}
    for source in {r[1] for r in rows}:
        end, island = None, None
        for i, _, s, e in sorted((r for r in rows if r[1] == source), key=lambda r: (r[2], r[3])):
            if end is None or s > end + gap:
                island = s
            end = e if end is None else max(end, e)
            out[i] = island
    return out


@pytest.mark.parametrize("gap", [0, 5, 20])
@pytest.mark.parametrize("bucket_ms", [70, 1000, 100_000])
def test_islands_of_tied_rows(spark, gap, bucket_ms):
    rows = tied_rows(gap + bucket_ms)
    df = spark.createDataFrame(rows, "segment_id long, source_id long, start_ms long, end_ms long").repartition(7, F.rand(3))
    got = {r.segment_id: r.island for r in iv.islands(df, ["source_id"], gap, bucket_ms=bucket_ms).collect()}
    assert got == loop(rows, gap)


def test_merge_of_tied_rows(spark):
    rows = tied_rows(99)
    df = spark.createDataFrame(rows, "segment_id long, source_id long, start_ms long, end_ms long").repartition(5, "segment_id")
    of = loop(rows, 5)
    want = {}
    for i, source, _, e in rows:
        a = want.setdefault((source, of[i]), [of[i], e, 0])
        a[1], a[2] = max(a[1], e), a[2] + 1
    got = {(r.source_id, r.start_ms): [r.start_ms, r.end_ms, r.n] for r in iv.merge(df, ("source_id",), 5, F.count("*").alias("n")).collect()}
    assert got == want
