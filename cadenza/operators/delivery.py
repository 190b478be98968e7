"""What rows have to keep before they are delivered, as violations by row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.decisions import yes
from cadenza.operators import intervals as iv

START, END = iv.START, iv.END


def speech_gaps(speech: Column) -> Column:
    """Lengths between neighbouring parts (structs of start_ms and end_ms) in order of time; negative
    where they overlap, empty for less than two parts."""
    s = F.sort_array(F.coalesce(speech, F.slice(speech, 1, 0)))
    some = F.greatest(F.array_size(s) - 1, F.lit(0))
    return F.zip_with(F.slice(s, F.lit(1), some), F.slice(s, F.lit(2), some), lambda a, b: b[START] - a[END])


def output_violations(items: DataFrame, blocked: DataFrame, hard_ms: int, keys: Sequence[str] = ("source_id",)) -> DataFrame:
    """`items` with `violations`, an array in this order:

    `not_accepted` (state), `incomplete_endpoints` (start_complete, end_complete), `speech_overlaps` and
    `hard_split` (parts in `speech` that overlap, or that are more than `hard_ms` apart), `blocked_event`
    (a shared length with a row of `blocked`), `empty_span` (no length, or a null), `duplicate_key` (of
    `key`, all rows that have it) and `overlap` (a shared length with another row of its source).

    Repeated rows violate each other.  Null flags and states are refusals; null keys are not equal to
    each other, and rows with a null source share nothing.  Overlaps are found by islands of rows that
    really share time: in such an island of several rows each row shares some with another, so no pair
    is looked at, and a hot source is as many groups as it has islands.
    """
    keys = list(keys)
    kept = items.drop("violations")
    met, island, others, same = iv._free(kept, "_met", "_island", "_others", "_same")
    held = iv.per_row(kept, iv.merge(blocked.select(*keys, START, END), keys), keys, lambda hit: [F.max(hit).alias(met)])
    usable = yes(F.col(START) < F.col(END))
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    named = iv.islands(held.where(usable), keys, gap=-1, out=island)
    crowds = named.groupBy(*keys, island).agg((F.count("*") - 1).alias(others))
    named = named.join(crowds, [*keys, island]).drop(island)
    rows = named.unionByName(held.where(~usable).withColumn(others, F.lit(0).cast("long")))
    rows = rows.join(rows.groupBy("key").agg(F.count("*").alias(same)), "key", "left")
    gaps = speech_gaps(F.col("speech"))
    violations = F.array_compact(
        F.array(
            F.when(~yes(F.col("state") == "accepted"), "not_accepted"),
            F.when(~(yes(F.col("start_complete")) & yes(F.col("end_complete"))), "incomplete_endpoints"),
            F.when(yes(F.exists(gaps, lambda g: g < 0)), "speech_overlaps"),
            F.when(yes(F.exists(gaps, lambda g: g > hard_ms)), "hard_split"),
            F.when(yes(F.col(met)), "blocked_event"),
            F.when(~yes(F.col(START) < F.col(END)), "empty_span"),
            F.when(yes(F.col(same) > 1), "duplicate_key"),
            F.when(yes(F.col(others) > 0), "overlap"),
        )
    )
    return rows.select(*kept.columns, violations.alias("violations"))


def refused_with_violations(audited: DataFrame) -> DataFrame:
    """The rows of `output_violations`, without that column; running it fails at the first violation."""
    said = F.concat(F.lit("delivery of "), F.coalesce(F.col("key").cast("string"), F.lit("null")), F.lit(" violates "), F.array_join("violations", ", "))
    return audited.where(F.when(F.array_size("violations") == 0, True).otherwise(F.raise_error(said).cast("boolean"))).drop("violations")
