"""Interval algebra over half-open integer intervals, by source.

All operators are DataFrame functions: gaps and islands by window functions, range joins by
equi joins on time buckets.  Inputs need the key columns and start_ms < end_ms; rows with a
null bound or key fall out (of `left`, `left_anti` and the operators that add a column they
don't).  Intervals that touch (end = start) merge at gap 0.

Rows are told apart by a key of their own, which each operator gives them, not by their values:
repeated rows and rows with nulls in other columns are rows like any.  Windows are taken within
time buckets, with what earlier buckets carry over, so a hot source is many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "start_ms", "end_ms"
#: Width of the time buckets of range joins; about the length of a usual interval.
BUCKET_MS = 50_000_000


def _free(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that df doesn't have yet."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def islands(df: DataFrame, keys: Sequence[str], gap: int | Column = 0, out: str = "island", bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Names the rows' islands, runs in which no row starts more than `gap` after all before, by
    the start of their first row.  Running maxima are taken within time buckets; of each bucket
    one row goes on to the next."""
    bucket, before, new, last = _free(df, "_bucket", "_before", "_new", "_last")
    within = Window.partitionBy(*keys, bucket).orderBy(START, END)
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)  # of one row a bucket
    # By value, not by row: of rows that are equal in start and end any may have come first, and the order may be
    # another one after a join.  Names of islands grow with the start, so the largest so far is the row's own.
    up_to_now = Window.partitionBy(*keys, bucket).orderBy(START).rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def carried(rows: DataFrame, what: Column, name: str) -> DataFrame:
        tops = rows.groupBy(*keys, bucket).agg(F.max(what).alias(name))
        return rows.join(tops.withColumn(name, F.max(name).over(earlier)), [*keys, bucket])

    rows = df.where(F.col(START).isNotNull() & F.col(END).isNotNull()).withColumn(bucket, F.floor(F.col(START) / bucket_ms))
    rows = carried(rows, F.col(END), before)
    inside = F.max(END).over(within.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn(new, F.when(F.col(START) <= F.greatest(before, inside) + gap, None).otherwise(F.col(START)))
    rows = carried(rows, F.col(new), last)
    named = rows.withColumn(out, F.coalesce(F.max(new).over(up_to_now), last))
    return named.select(*[F.col(c) for c in df.columns if c != out], out)


def merge(df: DataFrame, keys: Sequence[str] = ("source_id",), gap: int = 0, *aggs: Column) -> DataFrame:
    """Union of intervals; those at most `gap` apart merge.  More aggregates go along."""
    return (
        islands(df, keys, gap)
        .groupBy(*keys, "island")
        .agg(F.min(START).alias(START), F.max(END).alias(END), *aggs)
        .drop("island")
    )


def _dealt(a: DataFrame, b: DataFrame, keys: Sequence[str], least: int, bucket_ms: int, bucket: str) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides with their time buckets, b's columns with the prefix b_, and whether a pair that
    met in a bucket counts there: it shares enough, and the bucket is that of the later start."""
    span = lambda p: F.explode(F.sequence(F.floor(F.col(p + START) / bucket_ms), F.floor((F.col(p + END) - 1) / bucket_ms)))
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys])
    y = right.where(F.col(f"b_{START}") < F.col(f"b_{END}")).withColumn(bucket, span("b_"))
    owner = F.floor(F.greatest(START, f"b_{START}") / bucket_ms)
    # greatest and least pass over nulls, so a row without a pair has to be told from one.
    counts = F.col(f"b_{START}").isNotNull() & (F.least(END, f"b_{END}") - F.greatest(START, f"b_{START}") > least) & (F.col(bucket) == owner)
    return a.where(F.col(START) < F.col(END)).withColumn(bucket, span("")), y, counts


def overlap_join(
    a: DataFrame, b: DataFrame, keys: Sequence[str] = ("source_id",), how: str = "inner", least: int = 0, bucket_ms: int = BUCKET_MS
) -> DataFrame:
    """Pairs that share more than `least`.  b's columns get the prefix b_; keys appear once.

    Both sides are dealt into time buckets and joined by equality of keys and bucket; a pair is
    kept in the bucket of the later start alone, so nothing is counted twice.  how: inner,
    left, left_semi or left_anti."""
    (bucket,) = _free(a, "_bucket")
    x, y, counts = _dealt(a, b, keys, least, bucket_ms, bucket)
    if how == "inner":
        return x.join(y, [*keys, bucket]).where(counts).drop(bucket)
    (met,) = _free(a, "_met")
    if how in ("left_semi", "left_anti"):
        found = per_row(a, b, keys, lambda hit: [F.max(hit).alias(met)], least, bucket_ms)
        hit = F.coalesce(F.col(met), F.lit(False))
        return found.where(hit if how == "left_semi" else ~hit).drop(met)
    found = per_row(a, b, keys, lambda hit: [F.collect_list(F.when(hit, F.struct(*_b_columns(b, keys)))).alias(met)], least, bucket_ms)
    return found.select(*a.columns, F.explode_outer(met).alias(met)).select(*a.columns, f"{met}.*")


def _b_columns(b: DataFrame, keys: Sequence[str]) -> list[str]:
    return [f"b_{c}" for c in b.columns if c not in keys]


def per_row(
    a: DataFrame, b: DataFrame, keys: Sequence[str], aggs: Callable[[Column], list[Column]], least: int = 0, bucket_ms: int = BUCKET_MS
) -> DataFrame:
    """Each row of a with aggregates over the rows of b that it shares more than `least` with.
    aggs gets the column that says of a joined row whether it is such a pair; it is null or
    false for rows of a that met none.  A row's key is the hash of its values and a number, so it
    is the same row wherever its buckets went."""
    names = _free(a, "_bucket", "_hash", "_row", "_values")
    bucket, hashed, row, values = names
    plain = [c for c, t in a.dtypes if "map<" not in t]
    keyed = a.withColumns({hashed: F.xxhash64(*plain), row: F.monotonically_increasing_id()})
    x, y, counts = _dealt(keyed, b, keys, least, bucket_ms, bucket)
    lost = keyed.where(F.col(START).isNull() | F.col(END).isNull() | (F.col(START) >= F.col(END))).withColumn(bucket, F.lit(None).cast("long"))
    joined = x.unionByName(lost).join(y, [*keys, bucket], "left")
    grouped = joined.groupBy(hashed, row).agg(F.first(F.struct(*a.columns)).alias(values), *aggs(counts))
    return grouped.select(f"{values}.*", *[c for c in grouped.columns if c not in names])


def shared() -> Column:
    """Length that the two intervals of a joined row share."""
    return F.least(END, f"b_{END}") - F.greatest(START, f"b_{START}")


def subtract(df: DataFrame, blocked: DataFrame, keys: Sequence[str] = ("source_id",), least: int = 0) -> DataFrame:
    """What is left of each row's interval: one row a piece longer than `least`, with
    edge_start and edge_end (whether that edge is the row's own).  Other columns stay."""
    cuts, p = _free(df, "_cuts", "_p")
    b_start, b_end = f"b_{START}", f"b_{END}"
    found = per_row(df, merge(blocked, keys), keys, lambda hit: [F.sort_array(F.collect_list(F.when(hit, F.struct(b_start, b_end)))).alias(cuts)])
    starts = F.concat(F.array(F.col(START)), F.transform(cuts, lambda c: c[b_end]))
    ends = F.concat(F.transform(cuts, lambda c: c[b_start]), F.array(F.col(END)))
    pieces = F.filter(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda p: p["e"] - p["s"] > least)
    other = [c for c in df.columns if c not in (START, END)]
    return found.withColumn(p, F.explode(pieces)).select(
        *other,
        F.col(f"{p}.s").alias(START),
        F.col(f"{p}.e").alias(END),
        (F.col(f"{p}.s") == F.col(START)).alias("edge_start"),
        (F.col(f"{p}.e") == F.col(END)).alias("edge_end"),
    )


def intersect(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("source_id",), least: int = 0) -> DataFrame:
    """Pairwise intersections longer than `least`."""
    pairs = overlap_join(a, b, keys, least=least)
    return pairs.withColumns({START: F.greatest(START, f"b_{START}"), END: F.least(END, f"b_{END}")})


def _shared_sum(df: DataFrame, other: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    total = lambda hit: [F.coalesce(F.sum(F.when(hit, shared())), F.lit(0)).cast("long").alias(out)]
    return per_row(df, other, keys, total)


def covered_length(df: DataFrame, cover: DataFrame, keys: Sequence[str] = ("source_id",)) -> DataFrame:
    """Adds covered_ms: how much of each row the union of `cover` covers."""
    return _shared_sum(df, merge(cover, keys), keys, "covered_ms")


def overlap_sum(df: DataFrame, other: DataFrame, keys: Sequence[str] = ("source_id",)) -> DataFrame:
    """Adds overlap_ms: the sum of overlaps, in which overlapping covers count twice."""
    return _shared_sum(df, other, keys, "overlap_ms")


def carve(df: DataFrame, blocked: DataFrame, pad: int, least: int, keys: Sequence[str] = ("source_id",)) -> DataFrame:
    """Pieces of at least `least` that are clear of the blocked intervals and `pad` around them."""
    padded = blocked.withColumns({START: F.col(START) - pad, END: F.col(END) + pad})
    return subtract(df, padded, keys, least - 1)


def remainder(df: DataFrame, selected: DataFrame, blocked: DataFrame, keys: Sequence[str] = ("source_id",)) -> DataFrame:
    """Each row without what earlier rows of its source own, and without selected and blocked
    intervals; nothing is given twice."""
    order = Window.partitionBy(*keys).orderBy(START, END).rowsBetween(Window.unboundedPreceding, -1)
    own = df.withColumn(START, F.greatest(F.col(START), F.max(END).over(order))).where(f"{START} < {END}")
    cut = selected.select(*keys, START, END).unionByName(blocked.select(*keys, START, END))
    return subtract(own, cut, keys)


def gaps(df: DataFrame, keys: Sequence[str] = ("source_id",), least: int = 0) -> DataFrame:
    """Gaps between the merged intervals that are at least `least` long."""
    m = merge(df, keys)
    order = Window.partitionBy(*keys).orderBy(START)
    g = m.select(*keys, F.col(END).alias(START), F.lead(START).over(order).alias(END))
    return g.where(F.col(END) - F.col(START) >= least)


def split_at(df: DataFrame, cuts: DataFrame, keys: Sequence[str] = ("source_id",), at: str = "cut_ms") -> DataFrame:
    """Rows subdivided at the cut points strictly inside them, with part numbers from 0."""
    held, p = _free(df, "_cuts", "_p")
    points = cuts.select(*keys, F.col(at).alias(START), (F.col(at) + 1).alias(END))
    inside = lambda hit: F.when(hit & (F.col(f"b_{START}") > F.col(START)), F.col(f"b_{START}"))
    found = per_row(df, points, keys, lambda hit: [F.sort_array(F.collect_set(inside(hit))).alias(held)])
    edges = F.concat(F.array(START), held, F.array(END))
    parts = F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges)), lambda s, e: F.struct(s.alias("s"), e.alias("e")))
    other = [c for c in df.columns if c not in (START, END)]
    return found.select(*other, F.posexplode(parts).alias("part", p)).select(*other, "part", F.col(f"{p}.s").alias(START), F.col(f"{p}.e").alias(END))


def sliding_windows(df: DataFrame, width: int, hop: int) -> DataFrame:
    """Windows over each row: every `hop`, the last one aligned to the row's end; a row shorter
    than `width` is one window."""
    last = F.col(END) - width
    starts = F.when(last <= F.col(START), F.array(START)).otherwise(
        F.array_distinct(F.concat(F.sequence(F.col(START), last, F.lit(hop)), F.array(last)))
    )
    other = [c for c in df.columns if c not in (START, END)]
    return df.select(*other, START, END, F.explode(starts).alias("_s")).select(
        *other, F.col("_s").alias(START), F.least(F.col("_s") + width, F.col(END)).alias(END)
    )


def runs(df: DataFrame, keys: Sequence[str], order: str, flag: Column) -> DataFrame:
    """Numbers runs of consecutive rows with an equal flag (column `run`)."""
    w = Window.partitionBy(*keys).orderBy(order)
    f = df.withColumn("flag", flag)
    change = F.when(F.col("flag") == F.lag("flag").over(w), 0).otherwise(1)
    return f.withColumn("_c", change).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def rescale(start: Column, end: Column, num: int, den: int, delay: int) -> tuple[Column, Column]:
    """An interval in another view's clock: start floored, end ceiled, in integers alone."""
    low = (start * num - F.pmod(start * num, F.lit(den))) / den
    high = (end * num + F.pmod(-(end * num), F.lit(den))) / den
    return low.cast("long") + delay, high.cast("long") + delay
