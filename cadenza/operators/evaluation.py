"""Evaluation of scores against labels.

Ranks and curves need all scores in order.  Rows are first added up by distinct score, and
running sums over those go in two levels: within ranges of scores that Spark sorts in
parallel, and over one total for each range; no window puts all rows into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.storage import materialised


def _ranges(df: DataFrame, by: Column | str) -> DataFrame:
    """The rows dealt into ranges, with the number of each row's range as `_part`.  Written once, so
    that totals and rows are of the same ranges, whatever is sampled or coalesced later."""
    return materialised(df.repartitionByRange(by).withColumn("_part", F.spark_partition_id()), "ranges")


def running_sums(df: DataFrame, order: str, columns: list[str], descending: bool = False) -> DataFrame:
    """Adds sum_<c>: inclusive running sums of the columns in the order of distinct values."""
    by = F.desc(order) if descending else F.asc(order)
    dealt = _ranges(df, by)
    totals = dealt.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])  # one row a range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_part", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in columns])
    inside = Window.partitionBy("_part").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(bases), "_part")
    for c in columns:
        out = out.withColumn(f"sum_{c}", F.sum(c).over(inside) + F.col(f"_b_{c}"))
    return out.select(*df.columns, *[f"sum_{c}" for c in columns])


def by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    return df.groupBy(F.col(score).alias("score")).agg(F.sum(label).cast("long").alias("p"), F.sum(1 - F.col(label)).cast("long").alias("n"))


def roc_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """score, tp, fp: what lies at or above each distinct score."""
    out = running_sums(by_score(df, score, label), "score", ["p", "n"], descending=True)
    return out.select("score", F.col("sum_p").cast("long").alias("tp"), F.col("sum_n").cast("long").alias("fp"))


def classification_metrics(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    """One row: auc (ties count half), f1 and balanced accuracy at the threshold."""
    s = running_sums(by_score(df, score, label), "score", ["n"])
    # Of each positive: the negatives below, and half of those with the same score.
    wins = F.sum(F.col("p") * (F.col("sum_n") - F.col("n") / 2))
    up = F.col("score") >= threshold
    one = s.agg(
        wins.alias("wins"), F.sum("p").alias("P"), F.sum("n").alias("N"), F.sum(F.when(up, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(up, F.col("n")).otherwise(0)).alias("fp")
    )
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "P", "N"))
    return one.select(
        F.round(F.col("wins") / (pos * neg), 6).alias("auc"),
        F.round(2 * tp / (2 * tp + fp + (pos - tp)), 6).alias("f1"),
        F.round((tp / pos + (neg - fp) / neg) / 2, 6).alias("balanced"),
    )


def running_max(df: DataFrame, order: str, column: str, out: str) -> DataFrame:
    """Adds the largest value of the column among rows up to the row's place, equals included."""
    dealt = _ranges(df, order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tops = dealt.groupBy("_part").agg(F.max(column).alias("_top"))  # one row a range
    bases = tops.select("_part", F.max("_top").over(before).alias("_base"))
    inside = Window.partitionBy("_part").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    return dealt.join(F.broadcast(bases), "_part").withColumn(out, F.greatest(F.max(column).over(inside), "_base")).drop("_part", "_base")


def rank_audit(df: DataFrame, score: str, old: str, label: str, band: float) -> DataFrame:
    """One row: protected_pairs, the pairs of a positive and a negative that was lower by more than
    the band in the old scores; inverted, the positives whose score is at or below that of such a
    negative; passed, whether there is none."""
    y = F.col(label)
    at = F.struct(F.when(y == 1, F.col(old) - band).otherwise(F.col(old)).alias("at"), (1 - y).alias("negative"))  # positives ask before equals
    rows = df.select(F.col(score).alias("x"), y.alias("y"), at.alias("at"), F.when(y == 0, F.col(score)).alias("low"), (1 - y).cast("long").alias("n"))
    best = running_max(running_sums(rows, "at", ["n"]), "at", "low", "worst").where("y = 1")
    inverted = F.count_if(F.col("x") <= F.col("worst"))
    return best.agg(F.coalesce(F.sum("sum_n"), F.lit(0)).cast("long").alias("protected_pairs"), inverted.alias("inverted"), (inverted == 0).alias("passed"))


def holdout_sources(df: DataFrame, source: str = "source", label: str = "label", least: int = 3) -> DataFrame:
    """(source, held): a split by sources in which both sides have both labels.  Sources stand in
    the order of the SHA-256 of their names, as on a ring; tried are arcs of a fifth of them, then
    wider ones up to a half, each from every start; the first that fits is held out.  None is held
    where there are under `least` sources, one label only, or no such arc.

    Places and sums on the ring are running sums; each width is one equi join of both ends."""
    each = df.where(F.col(source).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(source).cast("string").alias("source")).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")
    )
    keyed = each.withColumns({"key": F.sha2(F.col("source").cast("binary"), 256), "one": F.lit(1).cast("long")})
    ring = materialised(running_sums(keyed, "key", ["one", "p", "n"]).withColumn("at", F.col("sum_one") - 1), "ring")
    total, p, n = ring.agg(F.count("*"), F.coalesce(F.sum("p"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    none = ring.select("source", F.lit(False).alias("held"))
    if total < least or not p or not n:
        return none
    size = max(1, total // 5)
    first = ring.select("at", (F.col("sum_p") - F.col("p")).alias("p0"), (F.col("sum_n") - F.col("n")).alias("n0"))  # before each place
    for width in range(size, max(size + 1, total // 2 + 1)):
        last = F.pmod(F.col("at") + width - 1, F.lit(total))
        ends = ring.select(F.col("at").alias("last"), F.col("sum_p").alias("p1"), F.col("sum_n").alias("n1"))
        wraps = F.col("at") + width > total
        arc = first.withColumn("last", last).join(ends, "last")
        held_p = F.col("p1") - F.col("p0") + F.when(wraps, p).otherwise(0)
        held_n = F.col("n1") - F.col("n0") + F.when(wraps, n).otherwise(0)
        start = arc.where((held_p > 0) & (held_p < p) & (held_n > 0) & (held_n < n)).agg(F.min("at")).first()[0]
        if start is not None:
            return ring.select("source", (F.pmod(F.col("at") - start, F.lit(total)) < width).alias("held"))
    return none


def grouped_sums(df: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """Adds sum_<c>, inclusive running sums within each group in the order of distinct values, and
    total_<c>.  Groups and values are sorted together, so a large group is many tasks."""
    summed = running_sums(df.withColumn("_order", F.struct(group, order)), "_order", columns).drop("_order")
    ends = summed.groupBy(group).agg(*[F.sum(c).alias(f"total_{c}") for c in columns], *[F.max(f"sum_{c}").alias(f"_end_{c}") for c in columns])  # one row a group
    out = summed.join(ends, group)
    for c in columns:
        out = out.withColumn(f"sum_{c}", F.col(f"sum_{c}") - F.col(f"_end_{c}") + F.col(f"total_{c}"))
    return out.drop(*[f"_end_{c}" for c in columns])


def group_quantiles(df: DataFrame, group: str, column: str, q: float, out: str) -> DataFrame:
    """(group, out): the quantile of each group's finite values, between neighbours in proportion."""
    v = F.col(column).cast("double")
    finite = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    counts = grouped_sums(finite.groupBy(group, v.alias("x")).agg(F.count("*").alias("n")), group, "x", ["n"])
    place = (F.col("total_n") - 1) * q
    at = lambda k: F.min(F.when(F.col("sum_n") >= k + 1, F.col("x")))
    ends = counts.withColumn("place", place).groupBy(group).agg(at(F.floor("place")).alias("low"), at(F.ceil("place")).alias("high"), F.max("place").alias("place"))
    return ends.select(group, (F.col("low") + (F.col("place") - F.floor("place")) * (F.col("high") - F.col("low"))).alias(out))


def quantile(df: DataFrame, column: str, q: float) -> float | None:
    """The quantile of a whole table's finite values, or null without any."""
    found = group_quantiles(df.select(F.lit(0).alias("_all"), F.col(column).alias("_value")), "_all", "_value", q, "q").first()
    return found["q"] if found else None
