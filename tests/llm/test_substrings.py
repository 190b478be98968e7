import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import substrings as ss


def brute(rows):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    out = []
    for (d, _), r in zip(rows, raws, strict=True):
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - 199):
            if seen[r[i : i + 200]] > 1:
                gone[i : i + 200] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(x for x, g in zip(r, gone, strict=False) if not g)
        out.append((d, len(r), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(docs):
    got = ss.remove_repeated(docs).withColumn("sha", F.sha2("kept", 256))
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in got.collect()), key=str)


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in ss.op9_bucket_pointers(spark, sf_dir).collect()), key=str)
    assert got == brute(rows)


def random_rows():
    rng = random.Random(8)
    text = lambda n, letters="abcdefghij é": "".join(rng.choice(letters) for _ in range(n))
    passage, other = text(260), text(199)
    rows = [(i, text(300) + passage + text(rng.randrange(300))) for i in range(30)]
    rows += [(100 + i, text(50) + other + text(50)) for i in range(5)]
    base = text(3000)
    for i in range(12):
        t = list(base)
        for _ in range(4):
            t[rng.randrange(3000)] = "#"
        rows.append((200 + i, "".join(t)))
    rows += [(300, "x" * 900), (301, "x" * 199), (302, "x" * 200), (303, "ab" * 120), (304, None), (305, ""), (306, base[100:299]), (307, base[100:300])]
    return rows + [(400, passage[:200]), (401, passage[30:230]), (402, passage[61:]), (403, "q" + passage)]


@pytest.mark.parametrize("group,chunk,segment", [(ss.GROUP, ss.CHUNK, ss.SEGMENT), (3, 40, 256)])
def test_against_brute_force(spark, monkeypatch, group, chunk, segment):
    monkeypatch.setattr(ss, "GROUP", group)
    monkeypatch.setattr(ss, "CHUNK", chunk)
    monkeypatch.setattr(ss, "SEGMENT", segment)
    rows = random_rows()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, doc int").repartition(6)
    assert result(docs) == brute(rows)


def test_repeated_and_null_ids(spark):
    a, b = "m" * 150 + "n" * 150, "".join(map(str, range(200)))
    rows = [(1, a), (1, a), (1, b), (None, b), (None, "z" + a[:250]), (2, "only " + "".join(map(str, range(900, 1000))))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(docs) == brute(rows)
    assert ss.remove_repeated(docs.limit(0)).count() == 0


def test_refinement_is_equality():
    rng = np.random.default_rng(3)
    codes = np.concatenate([rng.integers(97, 99, 700), np.tile(rng.integers(97, 120, 230), 3), np.full(500, 97)]).astype(np.uint8)
    bucket = ss.refine(codes)
    raw = codes.tobytes()
    of = {}
    for i, b in enumerate(bucket.tolist()):
        assert of.setdefault(raw[i : i + 200], b) == b
    assert len(set(of.values())) == len(of)
