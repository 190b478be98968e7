import re

import duckdb
import pytest

from cadenza.llm import decontaminate as dc


def brute(docs, items, window=13):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)})) if t else []

    wins = {}
    for i, t in items:
        w = words(t)
        for j in range(max(1, len(w) - window + 1)) if w else ():
            wins.setdefault(tuple(w[j : j + window]), set()).add(i)
    out = {}
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for win, ids in wins.items():
            for j in range(len(w) - len(win) + 1):
                if tuple(w[j : j + len(win)]) == win:
                    hit |= set(range(j, j + len(win)))
                    found |= ids
        out[d] = (len(w), len(hit), len(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


ODD = [
    "à la carte voilà à Å Ångström ÀÅ déjà vu là-bas où à",
    "хорошо их Рыба хлеб хвост храм х Р х их хор хата хмель холод хлам",
    "a\xa0b c\x85d e\u3000f g\u2003h",
    "日本語 の 文章 です 頠 兠 酠 中文 句子 一二三 四五 六七 八九 十 百",
    "Ä Ö ü ß ẞ É é ñ Ñ İ ı",
]
ITEMS = [
    (1, "The answer, is: forty-two."),
    (2, " ".join(f"w{i}" for i in range(20))),
    (3, None),
    (4, "..."),
    (10, "café au"),
    (5, "The answer is forty two"),
    (None, "nameless item"),
    *((20 + i, t) for i, t in enumerate(ODD)),
]
DOCS = [
    (1, "so THE ANSWER is forty two the answer is forty two"),
    (2, "x " + " ".join(f"w{i}" for i in range(3, 18)) + " y"),
    (3, " ".join(f"w{i}" for i in range(12))),
    (4, None),
    (5, ""),
    (6, "le Café-au lait " + "z " * 100),
    (7, "answer is forty two"),
    (8, "CAFÉ au"),
    (9, "a nameless\0item, nameless item"),
    *((20 + i, t) for i, t in enumerate(ODD)),
    *((40 + i, f"vor {t} nach") for i, t in enumerate(ODD)),
    *((60 + i, t.replace(" ", " ,\n").replace("à", "a")) for i, t in enumerate(ODD)),
    (70, ODD[2].replace("\xa0", " ").replace("\x85", " ")),
]


def found_in(spark, docs, **limits):
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, contamination int")
    return dc.find_contamination(docs, items, "c", **limits)


@pytest.mark.parametrize("limits", [{}, {"block_windows": 5}, {"block_bytes": 60}])
def test_against_brute_force(spark, limits):
    docs = spark.createDataFrame([(*d, 1, 2) for d in DOCS], "doc_id long, text string, contamination int, found int")
    found = found_in(spark, docs, **limits)
    assert found.columns == [*docs.columns, "c"]
    rows = found.select("doc_id", "c.n_words", dc.hit_words(dc.F.col("c.runs")).alias("h"), dc.F.size("c.items").alias("i"), "contamination", "found").collect()
    assert all((r.contamination, r.found) == (1, 2) for r in rows)
    assert {r.doc_id: tuple(r)[1:4] for r in rows} == {d: x[:3] for d, x in brute(DOCS, ITEMS).items()}


def test_report_is_the_same_in_blocks_and_matches_sql(spark):
    docs = spark.createDataFrame([*DOCS, DOCS[0], (None, DOCS[1][1])], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = [sorted(map(tuple, dc.contamination_report(docs, items, **x).collect()), key=repr) for x in ({}, {"block_windows": 3})]
    assert got[0] == got[1] and len(got[0]) == len(DOCS) + 2
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar); create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", DOCS)
    con.executemany("insert into benchmark values (?, ?)", ITEMS)
    cols = "doc_id, n_words, n_hit, n_items, items_sha256, contaminated"
    want = con.execute(f"select {cols} from ({dc.SQL})").fetchall()
    plain = dc.contamination_report(spark.createDataFrame(DOCS, "doc_id long, text string"), items).select(*cols.split(", "))
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted(want, key=repr)


def test_spans_map_to_the_text(spark):
    spans = {r.doc_id: r.c.spans for r in found_in(spark, spark.createDataFrame(DOCS, "doc_id long, text string")).collect()}
    text = dict(DOCS)
    assert [text[6][s["from"] : s["to"]] for s in spans[6]] == ["Café-au"]
    assert [text[1][s["from"] : s["to"]] for s in spans[1]] == ["THE ANSWER is forty two the answer is forty two"]
    for i, t in enumerate(ODD):
        assert [text[40 + i][s["from"] : s["to"]] for s in spans[40 + i]] == [t]


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert dc.contamination_report(docs.limit(0), items).count() == 0
    assert not any(r.contaminated for r in dc.contamination_report(docs, items.limit(0)).collect())


def test_against_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cols = "doc_id, n_words, n_hit, n_items, items_sha256, contaminated"
    want = con.execute(f"select {cols} from ({dc.SQL}) order by doc_id").fetchall()
    got = dc.op3_decontaminate(spark, sf_dir).select(*cols.split(", ")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want
