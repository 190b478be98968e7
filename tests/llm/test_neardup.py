import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from cadenza.llm import neardup as nd


def lcs_windows(a, b):
    """Windows that the longest common subsequence could match, by brute force over all."""
    ca = Counter(tuple(a[i : i + 5]) for i in range(len(a) - 4))
    cb = Counter(tuple(b[i : i + 5]) for i in range(len(b) - 4))
    common = sum((ca & cb).values())
    return common / (max(0, len(a) - 4) + max(0, len(b) - 4) - common) if common else 0.0


def test_alignment_of_edited_copies():
    rng = random.Random(4)
    for _ in range(150):
        a = [rng.randrange(10**9) for _ in range(rng.randrange(5, 120))]
        b = list(a)
        for _ in range(rng.randrange(0, 4)):
            at, kind = rng.randrange(len(b)), rng.randrange(3)
            b[at : at + (kind != 1)] = [rng.randrange(10**9)] * (kind != 2)
            if len(b) < 5:
                b += a[:5]
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        got, want = nd.similarity(x, y), lcs_windows(a, b)
        if want >= 0.8:
            assert got == pytest.approx(want), (a, b)
            assert nd.similarity(y, x) == pytest.approx(want)
        else:
            assert got < 0.8


def test_runs_are_a_shortest_script():
    rng = random.Random(9)
    for _ in range(200):
        a = [rng.randrange(4) for _ in range(rng.randrange(0, 14))]
        b = [rng.randrange(4) for _ in range(rng.randrange(0, 14))]
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = max(best[i, j] + 1 if x == y else 0, best[i, j + 1], best[i + 1, j])
        runs = nd.matched_runs(a, b, len(a) + len(b))
        assert sum(z for *_, z in runs) == best[-1, -1]
        at = (0, 0)
        for x, y, z in runs:
            assert x >= at[0] and y >= at[1] and a[x : x + z] == b[y : y + z]
            at = (x + z, y + z)
        need = len(a) + len(b) - 2 * int(best[-1, -1])
        assert need == 0 or nd.matched_runs(a, b, need - 1) is None


def brute(rows):
    words = {i: nd.word_hashes(t) for i, t in rows}
    groups = defaultdict(list)
    for i, t in rows:
        groups[nd.content_id(t, words[i])].append(i)
    reps = [min(g) for g in groups.values()]
    of = {i: i for i, _ in rows}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    def join(a, b):
        a, b = root(a), root(b)
        of[max(a, b)] = min(a, b)

    for g in groups.values():
        for i in g:
            join(g[0], i)
    index = defaultdict(list)
    for i in reps:
        for k in set(nd.kmer_hashes(words[i]).tolist()):
            index[k].append(i)
    for a, b in {(a, b) for m in index.values() for a in m for b in m if a < b}:
        if nd.similarity(words[a], words[b]) >= nd.SIMILARITY:
            join(a, b)
    return {i: root(i) for i, _ in rows}


def test_whole_table_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in nd.op8_order_minhash(spark, d).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("block", [nd.BLOCK, 3])
def test_mixed_buckets_groups_and_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)  # small: groups of two blocks
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join(passage + [word() for _ in range(60)])) for i in range(40)]  # one passage, no copies
    base = [word() for _ in range(150)]
    for i in range(60):  # a group of near copies
        t = list(base)
        t[rng.randrange(150)] = word()
        rows.append((100 + i, " ".join(t)))
    rows += [(200, "Same Words, here!"), (201, "same words here"), (202, "same words there"), (300, ""), (301, None), (302, "..."), (303, "!!!"), (304, "...")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, class_id int")
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(docs).collect()}
    assert got == brute(rows) and got[301] == 300 and got[304] == 302 and got[303] == 303 and got[202] == 202
    kept = nd.keep_one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(got.values())
    odd = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (1, "other words"), (None, "alone")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in nd.near_duplicates(odd).collect()) == [(0, 0), (0, 1), (1, 1), (1, 1), (1, 1)]
    assert nd.near_duplicates(docs.limit(0)).count() == 0


def test_rows_are_told_apart_by_id_and_content(spark):
    rng = random.Random(7)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(80)]
    a, b, c, e = text(), text(), text(), text()
    near = lambda t: t[:40] + ["changed"] + t[41:]
    rows = [
        (1, a, "one"), (1, b, "another text of the same id"), (2, near(a), "near copy of the first"), (None, near(near(b)), "near copy without an id"),
        (None, c, "alone"), (None, near(c), "its near copy"), (None, e, "x"), (None, e, "x"), (5, a, "copy"), (3, e, "named"), (3, e, "named"), (7, b[:3], "short"),
    ]
    docs = spark.createDataFrame([(i, note, " ".join(t), 0) for i, t, note in rows], "doc_id long, note string, text string, content int")
    groups = {}
    for r in nd.near_duplicates(docs).collect():
        groups.setdefault(r.group, []).append((r.doc_id, r.class_id))
    want = [[(1, 1), (2, 1), (5, 1)], [(1, 1), (None, 1)], [(None, None), (None, None)], [(3, 3), (3, 3), (None, 3), (None, 3)], [(7, 7)]]
    assert sorted((sorted(g, key=repr) for g in groups.values()), key=repr) == sorted(want, key=repr)
    kept = nd.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.note) for r in kept.collect())[1:] == [(1, "another text of the same id"), (1, "one"), (3, "named"), (7, "short")]
    assert sum(r.doc_id is None for r in kept.collect()) == 1


def test_recall_of_planted_edits(spark):
    """Of planted near copies, by the share of words changed, all that alignment finds at 0.8 or
    more, which no filter comes before here, are in the class of their source."""
    rng = random.Random(3)
    rows, pairs = [], []
    for i in range(240):
        words = [f"{rng.randrange(10**7):x}" for _ in range(rng.choice((120, 600)))]
        edited, share = list(words), rng.choice((0.01, 0.02, 0.03, 0.05, 0.1, 0.2))
        for at in sorted(rng.sample(range(len(words)), max(1, int(share * len(words)))), reverse=True):
            edited[at : at + rng.randrange(2)] = [] if rng.random() < 0.3 else [f"{rng.randrange(10**7):x}"]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited))]
        pairs.append((2 * i, nd.similarity(*(nd.word_hashes(t) for _, t in rows[-2:])), share))
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    by_share = {}
    for i, s, share in pairs:
        assert (got[i + 1] == i) == (s >= nd.SIMILARITY)
        by_share.setdefault(share, []).append(s >= nd.SIMILARITY)
    assert all(by_share[0.01]) and not any(by_share[0.2])  # 1 % of the words is near, 20 % never
