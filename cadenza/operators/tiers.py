"""Which of overlapping rows are exported: accepted ones among themselves, and borderline ones beside them.

Borderline rows: a walk in order of rank drops what a kept row holds whole.  What holds a dropped row's holder holds the row, too,
and is ahead of it, so being held by any row ahead is the same as by a kept one: one range join, without a walk.
Accepted rows: a later row may take a kept one's place, so the outcome depends on what was kept before; runs between
gaps are folded, which no row reaches over.

Rows need a unique segment_id, source_id and start_ms < end_ms; others fall out.  Equal ranks go by start_ms, then
segment_id; null scores are 0, null flags false; an empty table gives none.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators import intervals as iv
from cadenza.operators.folds import Apart, fold_runs

# By how much a shorter row's worst window has to be better, and how much of it has to be shared.
BETTER_WINDOW, SHARED = 0.06, 0.8

OUTCOME = "source_id long, segment_id long, outcome string"


def _rows(df: DataFrame) -> DataFrame:
    return df.where("source_id is not null and segment_id is not null and start_ms < end_ms")


def borderline_tiers(borderline: DataFrame, accepted: DataFrame) -> DataFrame:
    """borderline: also rank, a number.  Adds tier: covered_by_tier_a where accepted rows together cover all of it, else
    tier_b_nms_suppressed where a kept row ahead of it holds it whole, else borderline."""
    b = _rows(borderline).withColumn("rank", F.coalesce(F.nanvl(F.col("rank").cast("double"), F.lit(None)), F.lit(0.0)))
    narrow = b.select("source_id", "segment_id", "start_ms", "end_ms", "rank")
    seen = iv.covered_length(narrow, accepted.select("source_id", "start_ms", "end_ms"))
    covered = F.col("covered_ms") >= F.col("end_ms") - F.col("start_ms")
    left = seen.where(~covered).drop("covered_ms")
    ahead = F.struct(-F.col("b_rank"), F.col("b_start_ms"), F.col("b_segment_id")) < F.struct(-F.col("rank"), F.col("start_ms"), F.col("segment_id"))
    holds = (F.col("b_start_ms") <= F.col("start_ms")) & (F.col("b_end_ms") >= F.col("end_ms"))
    held = iv.per_row(left, left, ["source_id"], lambda hit: [F.max(hit & holds & ahead).alias("held")])
    lost = held.where("held").select("segment_id", F.lit("tier_b_nms_suppressed").alias("_lost"))
    over = seen.where(covered).select("segment_id", F.lit("covered_by_tier_a").alias("_over"))
    marked = b.join(over, "segment_id", "left").join(lost, "segment_id", "left")
    return marked.withColumn("tier", F.coalesce("_over", "_lost", F.lit("borderline"))).drop("_over", "_lost")


def accepted_outcomes(accepted: DataFrame, least: int) -> DataFrame:
    """accepted: also rescued, certified (flags), score and window_min.  (source_id, segment_id, outcome) of every row.

    Rows that weren't rescued go first, then longer ones, then those of higher score.  A row that shares more than `least` with
    no kept one is kept.  With exactly one it takes its place if it is certified and holds it, unless that one is certified and
    holds the row; or if it is shorter, shares most of itself, and its worst window is better.  Else it is dropped."""
    number = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0)).alias(c)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    rows = _rows(accepted).select("source_id", "segment_id", "start_ms", "end_ms", flag("rescued"), flag("certified"), number("score"), number("window_min"))

    def fold(rows: SimpleNamespace) -> list:
        outcome, apart = ["dropped"] * len(rows.start_ms), Apart(least)
        for r, (a, b, sure, worst) in enumerate(zip(rows.start_ms, rows.end_ms, rows.certified, rows.window_min, strict=True)):
            hit = apart.hits(a, b)
            if hit:
                x, y, k = hit[0]
                inside, around = x <= a and b <= y, a <= x and y <= b
                closer = b - a < y - x and worst >= rows.window_min[k] + BETTER_WINDOW and min(y, b) - max(x, a) >= SHARED * (b - a)
                if len(hit) > 1 or (rows.certified[k] and inside) or not ((sure and around) or closer):
                    continue
                apart.remove(hit[0])
                outcome[k] = "replaced"
            apart.add(a, b, r)
            outcome[r] = "kept"
        return list(zip(rows.source_id, rows.segment_id, outcome, strict=True))

    return fold_runs(rows.withColumn("length", F.col("end_ms") - F.col("start_ms")), 0, fold, OUTCOME, order=("rescued", "-length", "-score", "start_ms", "segment_id"))
