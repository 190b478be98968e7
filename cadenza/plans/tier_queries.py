"""Queries of export tiers; evidence comes from the events around each row."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import intervals as iv
from cadenza.operators import tiers
from cadenza.plans.catalogue import register
from cadenza.plans.sql import BUY, CLICK, SHARED, merged, pairs
from cadenza.sources import fixtures as fx

HOUR = 3_600_000
ROW = ["source_id", "segment_id", "start_ms", "end_ms"]


def accepted(spark, d):
    """Purchases: rescued if an error meets them, certified if one view or click holds them, with the least value of the views met."""
    b = fx.segments(spark, d, "purchase").select(*ROW, (F.col("value") / 500).alias("score"))
    others = fx.segments(spark, d).where("kind <> 'purchase'").select("source_id", "start_ms", "end_ms", "kind", "value")
    holds = (F.col("b_start_ms") <= F.col("start_ms")) & (F.col("b_end_ms") >= F.col("end_ms"))
    kind = F.col("b_kind")
    evidence = lambda hit: [
        F.max(hit & (kind == "error")).alias("rescued"),
        F.max(hit & (kind != "error") & holds).alias("certified"),
        F.min(F.when(hit & (kind == "view"), F.col("b_value") / 500)).alias("window_min"),
    ]
    return iv.per_row(b, others, ["source_id"], evidence)


@register("I42_accepted_outcomes")
def accepted_outcomes(spark, d):
    """Which of overlapping purchases are kept, replaced or dropped."""
    return tiers.accepted_outcomes(accepted(spark, d), HOUR // 2)


@register(
    "I41_borderline_tiers",
    f"""WITH c AS MATERIALIZED (SELECT segment_id, sum({SHARED}) AS covered FROM {pairs(CLICK, merged(BUY))} GROUP BY segment_id),
    b AS MATERIALIZED (SELECT x.source_id, x.segment_id, start_ms, end_ms, value / 500 AS rank, coalesce(covered, 0) >= end_ms - start_ms AS over FROM {CLICK} x LEFT JOIN c USING (segment_id))
    SELECT x.source_id, x.segment_id, x.start_ms, x.end_ms, x.rank, CASE WHEN x.over THEN 'covered_by_tier_a' WHEN EXISTS (SELECT 1 FROM b y WHERE y.source_id = x.source_id AND NOT y.over AND y.start_ms <= x.start_ms AND y.end_ms >= x.end_ms
      AND (y.rank > x.rank OR y.rank = x.rank AND (y.start_ms < x.start_ms OR y.start_ms = x.start_ms AND y.segment_id < x.segment_id))) THEN 'tier_b_nms_suppressed' ELSE 'borderline' END AS tier FROM b x""",
)
def borderline_tiers(spark, d):
    """Clicks beside the purchases: covered by them, held by a better click, or left for review."""
    b = fx.segments(spark, d, "click").select(*ROW, (F.col("value") / 500).alias("rank"))
    return tiers.borderline_tiers(b, fx.segments(spark, d, "purchase"))
