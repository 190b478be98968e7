"""Queries of delivered rows; parts of speech are two of each row, errors are blocked."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators.delivery import output_violations
from cadenza.plans.catalogue import register
from cadenza.plans.sql import BUY, ERR
from cadenza.sources import fixtures as fx

HARD_MS = 4 * 3_600_000


def items(spark, d):
    """Purchases as rows to deliver, with keys of source and start."""
    length = F.expr("end_ms - start_ms")
    first = F.struct(F.col("start_ms"), (F.col("start_ms") + F.expr("(end_ms - start_ms) div 3")).alias("end_ms"))
    second = F.struct((F.col("start_ms") + F.expr("(end_ms - start_ms) div 2")).alias("start_ms"), F.col("end_ms"))
    return fx.segments(spark, d, "purchase").select(
        "source_id", "segment_id", "start_ms", "end_ms",
        F.concat_ws(":", F.col("source_id"), F.expr("start_ms div 86400000")).alias("key"),
        F.when(F.col("value") >= 20, "accepted").otherwise("unresolved").alias("state"),
        (F.col("k") % 7 != 0).alias("start_complete"), (length % 5000 != 0).alias("end_complete"),
        F.array(second, first).alias("speech"),
    )


@register(
    "I46_output_violations",
    f"""WITH i AS MATERIALIZED (SELECT *, concat_ws(':', source_id, start_ms // 86400000) AS key FROM {BUY}),
    b AS (SELECT DISTINCT x.segment_id FROM i x JOIN {ERR} y ON x.source_id = y.source_id AND x.start_ms < y.end_ms AND y.start_ms < x.end_ms),
    n AS (SELECT *, max(end_ms) OVER (PARTITION BY source_id ORDER BY start_ms, end_ms, segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
      lead(start_ms) OVER (PARTITION BY source_id ORDER BY start_ms, end_ms, segment_id) AS after, count(*) OVER (PARTITION BY key) AS same FROM i)
    SELECT segment_id, concat_ws(',', CASE WHEN value < 20 THEN 'not_accepted' END, CASE WHEN k % 7 = 0 OR (end_ms - start_ms) % 5000 = 0 THEN 'incomplete_endpoints' END,
      CASE WHEN (end_ms - start_ms) // 2 - (end_ms - start_ms) // 3 > {HARD_MS} THEN 'hard_split' END, CASE WHEN segment_id IN (SELECT segment_id FROM b) THEN 'blocked_event' END,
      CASE WHEN same > 1 THEN 'duplicate_key' END, CASE WHEN before > start_ms OR after < end_ms THEN 'overlap' END) AS violations FROM n""",
)
def violations(spark, d):
    """What keeps each purchase from being delivered."""
    found = output_violations(items(spark, d), fx.segments(spark, d, "error"), HARD_MS)
    return found.select("segment_id", F.array_join("violations", ",").alias("violations"))
