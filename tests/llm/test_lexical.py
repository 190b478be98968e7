import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import lexical

DOCS = "doc_id long, text string, Item_id string, score string"
ITEMS = "item_id long, text string, doc_id string"
PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in PATTERN.findall(text or "")]


def brute(docs, items, k=10):
    held = [(d[0], terms(d[1])) for d in docs]
    n_docs, total = sum(1 for _, w in held if w), sum(len(w) for _, w in held)
    asked = {}
    for i in items:
        asked.setdefault(i[0], set()).update(terms(i[1]))
    df = {t: sum(1 for _, w in held if t in set(w)) for ts in asked.values() for t in ts}
    out = []
    for item, ts in asked.items():
        found = []
        for doc, w in held:
            if w:
                m = 10 + (90 * len(w) * n_docs) // total
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * w.count(t)) // (1000 * w.count(t) + 8 * m)) for t in ts if t in w)
                if score > 0:
                    found.append((-score, doc is None, doc))
        out += [(item, r + 1, f[2], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k])]
    return sorted(out, key=str)


def same(spark, docs, items, **limits):
    got = lexical.rank_documents(spark.createDataFrame(docs, DOCS).repartition(4, F.rand(5)), spark.createDataFrame(items, ITEMS), **limits)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = brute(docs, items, limits.get("k", 10))
    assert sorted(map(tuple, got.collect()), key=str) == want
    return want


def texts(seed, n, words=40):
    rnd = random.Random(seed)
    names = [f"w{i}" for i in range(60)] + ["the", "The", "été", "日本", "don't", "a_b"]
    return [(i, " ".join(rnd.choice(names[: rnd.choice([5, 30, 66])]) for _ in range(rnd.randrange(1, words))), "x", "y") for i in range(n)]


@pytest.mark.parametrize("limits", [{}, {"k": 3, "coordinates": 8}, {"coordinates": 1, "group_terms": 5}, {"block_pairs": 20}])
def test_against_brute_force(spark, limits):
    docs = texts(1, 300)
    same(spark, docs, [(i, t, "") for i, t, *_ in texts(2, 12, 15)], **limits)


def test_odd_rows(spark):
    docs = texts(3, 40)
    docs += [(100 + i, "the w1 w2 equal texts", "", "") for i in range(30)]  # ties, more than fit
    docs += [(7, "w3 w3 w3 only", "", ""), (7, "w3 w3 w3 only", "", ""), (None, "w3 w3 w3 only", "", ""), (None, None, "", ""), (200, "", "", ""), (201, "... --- !", "", "")]
    docs += [(300, "w5 filler " * 30_000, "", ""), (301, "w5", "", "")]
    items = [(1, "THE w1", ""), (2, None, ""), (3, "?!", ""), (4, "w3 w3 only", ""), (4, "w5", ""), (None, "w2 texts", ""), (5, "absent words here", ""), (6, "w5", ""), (6, "w5", "")]
    want = same(spark, docs, items)
    assert {w[0] for w in want} == {1, 4, None, 6}


@pytest.mark.parametrize("docs, items", [([], [(1, "a", "")]), ([(1, "a", "", "")], []), ([], []), ([(1, None, "", "")], [(1, "a", "")])])
def test_empty_tables(spark, docs, items):
    assert same(spark, docs, items) == []


def test_bounds_hold_and_spare_work():
    rng = np.random.default_rng(1)
    best = lexical.Best(10)
    group = lexical.Group({i: sorted(rng.choice(500, 12, replace=False).tolist()) for i in range(20)}, 1024)
    total = np.zeros((4000, 20), np.int64)
    for at in range(0, 4000, 500):
        impacts = np.where(rng.random((500, len(group.terms))) < 0.05, rng.integers(1, 10**9, (500, len(group.terms))), 0)
        scores = np.stack([impacts[:, c].sum(1) for c in group.columns], 1)
        assert (group.bounds(impacts) >= scores).all()
        total[at : at + 500] = scores
        best.search(group, impacts, list(range(at, at + 500)))
    for q, item in enumerate(group.items):
        assert [r[0] for r in best.held[item]] == sorted(total[:, q].tolist(), reverse=True)[:10]
    assert best.rescored < 0.1 * total.size


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cur = con.execute(lexical.SQL)
    names = [d[0] for d in cur.description]
    assert sorted(map(tuple, lexical.op12_max_sketches(spark, sf_dir).select(*names).collect())) == sorted(cur.fetchall())
