"""Quality rules: text statistics and a learned decision list, in DataFrame functions only.

Statistics of each text are built-in expressions over its words and lines; nothing leaves the
JVM.  Sequential covering learns an ordered list of rejecting rules from labelled statistics:
a rule grows by the threshold condition with the largest information gain, is pruned from its
end on rows that it was not grown on, and takes the rows it covers out; the list ends when no
rule is precise enough.  The list becomes one ordered chain of WHEN conditions.

Conditions are found from counts by (statistic, bucket), one aggregation for each step, so the
driver sees a few hundred counts and never a row.  The list is learnt from at most about
`SAMPLE` labelled rows; statistics and verdicts are of all documents, in one pass.

Defined cases: null and empty texts have no words, and fail the base rules; a null doc_id is
never labelled; several labels of a document each count; without labels of both classes the
list is empty and rejects none; an empty table gives none; extra columns stay as they are, and
in a clash of names ours get underscores in front.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import free_name, materialised, read_table

#: Labelled rows that the list is learnt from, about.
SAMPLE = 8_000
#: Share of them that rules are grown on; the others prune.
GROW_PARTS, PARTS = 2, 3
MAX_RULES, MAX_CONDITIONS = 10, 3
#: Thresholds tried for a statistic.
BUCKETS = 32
#: A rule stays if so large a part of what it rejects, on the rows that prune, is bad.
PRECISION = 0.9
LEAST_COVERED = 2

_BLANK = "[\\x20\\x09-\\x0D]+"
_SYMBOLS = "[^#*$%&|<>]+"


def _let(value: Column, body) -> Column:
    """body(value), where value is computed once a row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _BLANK), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more, the first included."""

    def of_hashes(h: Column) -> Column:
        # Windows by hash, then place; a window repeats if a neighbour has its hash.
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def of_placed(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            hit = F.filter(s, lambda x, k: F.when(k > 0, same(x, k - 1)).otherwise(F.lit(False)) | same(x, k + 1))
            at = F.sort_array(F.transform(hit, lambda x: x["i"]))

            def of_starts(p: Column) -> Column:
                width = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
                return F.aggregate(width, F.lit(0).cast("long"), lambda a, x: a + x)

            return _let(at, of_starts)

        repeated = F.size(F.array_distinct(h)) < F.size(h)
        return F.when(repeated, _let(placed, of_placed)).otherwise(F.lit(0).cast("long"))

    # Each element's hash is of three words and their borders.
    hashes = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )
    return _let(hashes, of_hashes)


def statistics(docs: DataFrame, text_col: str = "text", out: str = "stats") -> DataFrame:
    """The documents with a column `out`, a name that they don't have: struct of counts of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            _repeat_words(w).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    count = lambda found, other: F.when(text.rlike(found), F.char_length(F.regexp_replace(text, other, ""))).otherwise(0)
    w, l = free_name(docs, "_w"), free_name(docs, "_l")
    one = docs.withColumns({w: _let(_words(text), of_words), l: _let(lines, of_lines)})
    stats = F.struct(
        *(F.col(w)[c].alias(c) for c in ("n_words", "word_chars", "n_distinct", "n_repeat_words")),
        *(F.col(l)[c].alias(c) for c in ("n_lines", "n_dup_lines")),
        count("[#*$%&|<>]", _SYMBOLS).cast("long").alias("n_symbols"),
        count("\\p{Lu}", "[^\\p{Lu}]+").cast("long").alias("n_capitals"),
        count("[!?]", "[^!?]+").cast("long").alias("n_marks"),
    )
    return one.withColumn(out, stats).drop(w, l)


def ratios(s: Column) -> dict[str, Column]:
    """What conditions are about, from the column `stats`."""
    words, chars = F.greatest(s["n_words"], F.lit(1)), F.greatest(s["word_chars"], F.lit(1))
    return {
        "mean_word_chars": s["word_chars"] / words,
        "symbols_per_word": s["n_symbols"] / words,
        "dup_line_share": s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1)),
        "repeat_word_share": s["n_repeat_words"] / words,
        "distinct_word_share": s["n_distinct"] / words,
        "capital_share": s["n_capitals"] / chars,
        "marks_per_word": s["n_marks"] / words,
        "n_words": s["n_words"].cast("double"),
    }


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:.6g}"

    def on(self, values: dict[str, Column]) -> Column:
        v = values[self.name]
        return v > self.threshold if self.above else v <= self.threshold


Rule = tuple[Condition, ...]


def _all(rule: Rule, values: dict[str, Column]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.on(values)
    return out


def rejected(rules: list[Rule], values: dict[str, Column]) -> Column:
    """The ordered list as one expression: the number of the first rule that holds, else null."""
    out = None
    for i, rule in enumerate(rules):
        out = F.when(_all(rule, values), i) if out is None else out.when(_all(rule, values), i)
    return F.lit(None).cast("int") if out is None else out.otherwise(F.lit(None)).cast("int")


def _gain(p0: int, n0: int, p: int, n: int) -> float:
    if not p or not p0:
        return -1.0
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def _counts(rows: DataFrame) -> tuple[int, int]:
    r = rows.agg(F.count_if("bad"), F.count_if(~F.col("bad"))).first()
    return r[0], r[1]


def _grow(rows: DataFrame, cuts: dict[str, list[float]], values: dict[str, Column]) -> Rule:
    """The rule with the largest gain at each step, until it covers bad rows only."""
    rule: Rule = ()
    p0, n0 = _counts(rows)
    while n0 and p0 and len(rule) < MAX_CONDITIONS:
        # Bucket k of a statistic holds values above k of its thresholds.
        bucket = [
            F.struct(F.lit(name).alias("name"), sum((F.col(name) > t).cast("int") for t in cuts[name]).alias("bucket"))
            for name in values
            if cuts[name]
        ]
        found = (
            rows.where(_all(rule, values))
            .select("bad", F.explode(F.array(*bucket)).alias("b"))
            .groupBy("b.name", "b.bucket")
            .agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n"))
            .collect()
        )
        of = {(r["name"], r["bucket"]): (r["p"], r["n"]) for r in found}
        best = (0.0, "", None, 0, 0)
        for name in sorted(values):
            below_p = below_n = 0
            for k, t in enumerate(cuts[name]):
                p, n = of.get((name, k), (0, 0))
                below_p, below_n = below_p + p, below_n + n
                for above, q, m in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
                    gain = _gain(p0, n0, q, m)
                    if gain > best[0] + 1e-9 and q >= LEAST_COVERED:
                        best = (gain, name, Condition(name, above, t), q, m)
        if best[2] is None:
            break
        rule, p0, n0 = (*rule, best[2]), best[3], best[4]
    return rule


def _prune(rows: DataFrame, rule: Rule, values: dict[str, Column]) -> tuple[Rule, int, int]:
    """The start of the rule with the best (bad - good) / covered on rows it wasn't grown on."""
    starts = [rule[:k] for k in range(1, len(rule) + 1)]
    held = [F.count_if(_all(s, values) & (F.col("bad") == b)) for s in starts for b in (True, False)]
    counts = list(rows.agg(*held).first())
    scored = [((p - n) / (p + n) if p + n else -2.0, p, len(s), s, p, n) for s, p, n in zip(starts, counts[::2], counts[1::2], strict=True)]
    _, _, _, best, p, n = max(scored, key=lambda x: x[:3])
    return best, p, n


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> list[Rule]:
    """The ordered list of rejecting rules, for rows that pass the base rules."""
    known = labels.select("doc_id", (F.col(label) == 0).alias("bad")).where(F.col("bad").isNotNull() & F.col("doc_id").isNotNull())
    there = known.count()
    if there > sample:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * sample / there))
    chosen = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most about `sample` rows
    # Written first: else the filter on statistics goes below the join, to all documents.
    chosen = materialised(chosen, "labelled")
    with_stats = statistics(chosen).where(~base_failed(F.col("stats")))
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(PARTS))
    rows = materialised(
        with_stats.select(part.alias("part"), "bad", *(v.alias(k) for k, v in ratios(F.col("stats")).items())), "stats"
    )
    names = [c for c in rows.columns if c not in ("part", "bad")]
    values = {n: F.col(n) for n in names}
    p, n = _counts(rows)
    if not p or not n:
        return []
    at = [(k + 1) / (BUCKETS + 1) for k in range(BUCKETS)]
    edges = rows.groupBy("bad").agg(*(F.percentile_approx(c, at, 10_000).alias(c) for c in names)).collect()
    cuts = {c: sorted({float(x) for r in edges for x in r[c] or []}) for c in names}
    grow, prune = rows.where(F.col("part") < GROW_PARTS), rows.where(F.col("part") >= GROW_PARTS)
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        left = rejected(rules, values).isNull()
        rule = _grow(grow.where(left), cuts, values)
        if not rule:
            break
        rule, p, n = _prune(prune.where(left), rule, values)
        if p < 1 or p < PRECISION * (p + n):
            break
        rules.append(rule)
    return rules


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The documents with columns stats, base_failed, rule (the first that rejects) and kept, or
    these names as `free_name` gives them."""
    stats, failed, rule, kept = (free_name(docs, c) for c in ("stats", "base_failed", "rule", "kept"))
    s = F.col(stats)
    return (
        statistics(docs, text_col, stats)
        .withColumn(failed, base_failed(s))
        .withColumn(rule, rejected(rules, ratios(s)))
        .withColumn(kept, ~F.col(failed) & F.col(rule).isNull())
    )


def op5_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rules = learn(docs, read_table(spark, sf_dir, "labels"))
    s = F.col("stats")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judge(docs.select("doc_id", "text"), rules).select("doc_id", *(s[c].alias(c) for c in counts), "base_failed", "kept")


QUERIES = {"op5_decision_list": op5_decision_list}
ORACLES: dict[str, str] = {}
