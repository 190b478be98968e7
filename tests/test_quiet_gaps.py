"""The quartile of A23 as the engine of its SQL rounds it, where a level lies right on a quarter of it."""

import math
import os
import random

import duckdb

from cadenza.functions.scores import interpolated
from cadenza.plans import catalogue


def test_interpolated(spark):
    rng = random.Random(3)
    rows = [(*sorted((rng.randrange(1, 20000) / 50000, rng.randrange(1, 20000) / 50000)), d) for _ in range(2000) for d in range(4)]
    got = spark.createDataFrame(rows, "a double, b double, d int").select("a", "b", "d", interpolated("a", "b", "d").alias("q")).collect()
    assert all(r.q == (math.fma(r.a, 1 - r.d / 4, r.b * (r.d / 4)) if r.d else r.a) for r in got)


def test_levels_on_the_floor(spark, tmp_path):
    """Clips of four frames whose first level is a quarter of the fused quartile, but not of the one that is rounded twice."""
    rows, level = [], lambda cents: cents / 100 / 500
    for lo in range(400, 9000):
        hi = lo + 4 * (lo % 97) + (-3 * lo - lo) % 16
        q4 = (3 * lo + hi) // 4
        if (3 * lo + hi) % 16 == 0:
            a, b, x = level(lo), level(hi), level(q4 // 4)
            fused, plain = math.fma(a, 0.75, b * 0.25) / 4, (a * 0.75 + b * 0.25) / 4
            if (x <= fused) != (x <= plain) and fused < 0.05:
                rows += [(len(rows) + i, 1000 + lo, v / 100) for i, v in enumerate((q4 // 4, q4 // 4 + 1, lo, hi))]
    assert rows
    db = duckdb.connect()
    db.execute("CREATE TABLE events (event_id BIGINT, user_id BIGINT, value DOUBLE, ts TIMESTAMP DEFAULT TIMESTAMP '2024-01-01', event_type VARCHAR DEFAULT 'click', props VARCHAR DEFAULT '{}')")
    db.executemany("INSERT INTO events (event_id, user_id, value) VALUES (?, ?, ?)", rows[:400])
    db.execute(f"COPY events TO '{os.path.join(tmp_path, 'events.parquet')}'")
    want = set(db.execute(catalogue.oracle_sql()["A23_quiet_gap_ratio"]).fetchall())
    assert {tuple(r) for r in catalogue.queries()["A23_quiet_gap_ratio"](spark, str(tmp_path)).collect()} == want
