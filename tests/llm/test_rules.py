import re
from collections import Counter

from cadenza.llm import rules as ru

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    tri = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if tri[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    texts = dict(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect())
    rows = ru.op5_decision_list(spark, d).collect()
    assert len(rows) == len(texts)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    for r in rows:
        n, chars, symbols, dup, rep = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), r.doc_id
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and not (r.base_failed and r.kept)
    judged = [(r.kept, quality[r.doc_id]) for r in rows if r.doc_id in quality and not r.base_failed]
    assert sum(k == q for k, q in judged) / len(judged) > 0.97


def test_odd_texts(spark):
    texts = [None, "", " \n\t ", "a b c a b c", "a a a a a", "x\n\nx\n x\nx", "a\x0bb\x1cc\x85d\xa0e　f", "#*$%&|<> é ## ", "a b c d a b c x a b",
             "lorem " * 5000, " ".join(map(str, range(3000))) + " 1 2 3", "😀 é"]
    docs = spark.createDataFrame([(i, t, 1, "e") for i, t in enumerate(texts)], "doc_id long, text string, n int, lang string")
    got = ru.judge(docs, []).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        s = r.stats
        assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == brute(t), t
    assert ru.judge(docs.limit(0), []).count() == 0


def test_lists_are_ordered_and_learnt_from_labels(spark):
    rows = [(i, "good plain words here " + " ".join(f"w{i}{k}" for k in range(60))) for i in range(60)]
    rows += [(100 + i, " ".join(f"w{i}{k}###" for k in range(60))) for i in range(40)]
    rows += [(200 + i, " ".join(f"W{i}{k}Q".upper() for k in range(60))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows] + [(1, None), (None, 0)], "doc_id long, quality int")
    found = ru.learn(docs, labels)
    assert 1 <= len(found) <= ru.MAX_RULES
    assert {r.doc_id for r in ru.judge(docs, found).where("kept").collect()} == set(range(60))
    assert ru.learn(docs, labels.where("quality = 1")) == [] == ru.learn(docs, labels.limit(0))


def test_columns_of_our_names_stay(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text, 7, 8, 9, False, "r", "l")], "doc_id long, text string, _w int, stats int, base_failed int, kept boolean, rule string, _l string")
    out = ru.judge(docs, [])
    assert out.columns == [*docs.columns, "_stats", "_base_failed", "_rule", "_kept"]
    (r,) = out.collect()
    assert (r._w, r.stats, r.base_failed, r.kept, r.rule, r._l) == (7, 8, 9, False, "r", "l")
    assert r._stats.n_words == 60 and not r._base_failed and r._rule is None and r._kept


def brute_cover(rows, cuts, parts):
    """Sequential covering by the definition, over plain rows {name: value, "bad": ...}."""
    def covers(rule, r):
        return all((r[n] > t) if above else (r[n] <= t) for n, above, t in rule)

    def count(rule, some):
        hit = [r["bad"] for r in some if covers(rule, r)]
        return sum(hit), len(hit) - sum(hit)

    found = []
    while len(found) < ru.MAX_RULES:
        left = [r for r in rows if not any(covers(f, r) for f in found)]
        grow, prune = [r for r in left if parts[r["id"]] < ru.GROW_PARTS], [r for r in left if parts[r["id"]] >= ru.GROW_PARTS]
        rule = ()
        p0, n0 = count(rule, grow)
        while n0 and p0 and len(rule) < ru.MAX_CONDITIONS:
            best = (0.0, None)
            for name in sorted(cuts):
                for t in cuts[name]:
                    for above in (False, True):
                        p, n = count((*rule, (name, above, t)), grow)
                        gain = ru._gain(p0, n0, p, n)
                        if gain > best[0] + 1e-9 and p >= ru.LEAST_COVERED:
                            best = (gain, (name, above, t), p, n)
            if best[1] is None:
                break
            rule, p0, n0 = (*rule, best[1]), best[2], best[3]
        if not rule:
            break
        scored = []
        for k in range(1, len(rule) + 1):
            p, n = count(rule[:k], prune)
            scored.append(((p - n) / (p + n) if p + n else -2.0, p, k, n))
        _, p, k, n = max(scored)
        if p < 1 or p < ru.PRECISION * (p + n):
            break
        found.append(rule[:k])
    return found


def test_learned_list_against_brute_force_covering(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    found = ru.learn(docs, labels)
    stats = ru.statistics(docs.select("doc_id", "text").join(labels, "doc_id")).where(~ru.base_failed(ru.F.col("stats")))
    part = ru.F.pmod(ru.F.xxhash64("doc_id", ru.F.lit("part")), ru.F.lit(ru.PARTS)).alias("part")
    values = ru.ratios(ru.F.col("stats"))
    rows = [r.asDict() for r in stats.select("doc_id", part, (ru.F.col("quality") == 0).alias("bad"), *(v.alias(k) for k, v in values.items())).collect()]
    for r in rows:
        r["id"] = r["doc_id"]
    cuts = {}
    for name in values:  # the thresholds are quantiles of each class
        for bad in (True, False):
            own = sorted(r[name] for r in rows if r["bad"] == bad)
            at = [own[max(0, -(-len(own) * (k + 1) // (ru.BUCKETS + 1)) - 1)] for k in range(ru.BUCKETS)]
            cuts.setdefault(name, set()).update(at)
    want = brute_cover(rows, {n: sorted(c) for n, c in cuts.items()}, {r["id"]: r["part"] for r in rows})
    assert [[(c.name, c.above, c.threshold) for c in rule] for rule in found] == [list(rule) for rule in want]


def test_verdicts_of_rows_that_nothing_was_learnt_from(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    right = total = 0
    for fold in range(3):
        held = ru.F.pmod(ru.F.xxhash64("doc_id", ru.F.lit("fold")), ru.F.lit(3)) == fold
        found = ru.learn(docs, labels.where(~held))
        got = ru.judge(docs.select("doc_id", "text").join(labels.where(held), "doc_id"), found).where("not base_failed")
        right += got.where("kept = (quality = 1)").count()
        total += got.count()
    assert right / total > 0.9
