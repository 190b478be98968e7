import hashlib
import math
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, Label_2 string"


def brute(rows, rounds=6, entries=16):
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) if kept and len(kept[0][1]) % 8 == 0 else 0
    kept = [r for r in kept if len(r[1]) == width]
    d = width // 8
    ints = [[math.floor(Fraction(x) * 4096) for x in r[1]] for r in kept]
    parts = [[tuple(v[p * d : (p + 1) * d]) for v in ints] for p in range(8)]
    books = [list(parts[p][:entries]) for p in range(8)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(8):
            mine = [[] for _ in books[p]]
            for x in parts[p]:
                mine[nearest(x, books[p])[1]].append(x)
            books[p] = [tuple(sum(c) // len(m) for c in zip(*m, strict=True)) if m else e for m, e in zip(mine, books[p], strict=True)]
    out = []
    for i, r in enumerate(kept):
        found = [nearest(parts[p][i], books[p]) for p in range(8)]
        out.append((r[0], r[2], "".join(f"{k:02x}" for _, k in found), min(codes.LARGEST, sum(min(codes.LARGEST, e) for e, _ in found))))
    return sorted(out, key=str), hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def same(spark, rows, block=7):
    got, books = codes.encode(spark.createDataFrame(rows, SCHEMA).repartition(5, F.rand(2)), block=block)
    want, digest = brute(rows)
    assert sorted(map(tuple, got.select("vec_id", "label", "code", "error").collect()), key=str) == want
    assert codes.books_digest(books) == digest
    return want


def vectors(seed, n, width=16, scale=0.05):
    rnd = random.Random(seed)
    return [(i, [rnd.gauss(rnd.choice([-0.1, 0, 0.1]), scale) for _ in range(width)], rnd.choice([0, 1, None]), "") for i in range(n)]


@pytest.mark.parametrize("block", [1, 9, 256])
def test_against_brute_force(spark, block):
    same(spark, vectors(block, 150), block)


def test_odd_rows(spark):
    rows = vectors(1, 60)
    v = rows[30][1]
    rows += [(i, v, 3, "") for i in range(100, 140)]  # many equal vectors
    rows += [(5, v, 1, ""), (5, v, 1, ""), (None, v, None, ""), (None, rows[2][1], 2, "")]
    rows += [(-9, None, 1, ""), (-8, [], 1, ""), (-7, [float("nan"), *v[1:]], 1, ""), (-6, [None, *v[1:]], 1, ""), (-5, [float("inf"), *v[1:]], 1, "")]
    rows += [(200, v[:8], 1, ""), (201, [*v, *v], 1, "")]  # of other lengths
    assert len(same(spark, rows)) == 104


def test_ties_go_to_the_lower_entry(spark):
    rows = [(i, [(i % 4) / 4096] * 8, 0, "") for i in range(40)]
    same(spark, rows)


def test_numbers_of_any_size(spark):
    rows = vectors(3, 40, 8)
    rows += [(50 + i, [(-1.0) ** i * 10.0 ** (5 * i)] * 8, 0, "") for i in range(12)] + [(-3, [1e308, -1e308] * 4, 1, ""), (-2, [2.0**40] * 8, 1, "")]
    same(spark, rows)


@pytest.mark.parametrize("n", [1, 5, 17])
def test_few_rows(spark, n):
    same(spark, vectors(n, n, 8))


@pytest.mark.parametrize("rows", [[], [(1, None, 1, "")], [(1, [1.0] * 7, 1, "")]])
def test_nothing_kept(spark, rows):
    got, books = codes.encode(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["vec_id", "label", "code", "error"] and got.count() == 0 and books == [[]] * 8


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_steps_by_one(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = codes.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_shortlists_leave_out_far_entries_only():
    rng = np.random.default_rng(0)
    for _ in range(50):
        x, e = rng.integers(-40, 40, (20, 3)) + rng.integers(-60, 60, 3), rng.integers(-90, 90, (16, 3))
        can = codes.shortlist(x.min(0)[None], x.max(0)[None], e)[0]
        near = ((x[:, None] - e[None]) ** 2).sum(2)
        assert can[near.argmin(1)].all()
        assert set(np.flatnonzero((near == near.min(1, keepdims=True)).any(0))) <= set(np.flatnonzero(can))
    tight = codes.shortlist(np.array([[0, 0]]), np.array([[1, 1]]), np.array([[0, 0], [50, 50], [1, 1]]))
    assert tight.tolist() == [[True, False, True]]


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    cur = con.execute(codes.ORACLES["op11_hilbert_blocks"])
    names = [d[0] for d in cur.description]
    assert sorted(map(tuple, codes.op11_hilbert_blocks(spark, sf_dir).select(*names).collect())) == sorted(cur.fetchall())
