"""The gate over candidates: what stays accepted, what is promoted, cropped, put up for review or removed.

Each candidate is judged by what is known of it and by the evidence field over its span.  What depends on
earlier candidates is only whether a promotion meets something that is there already: kept rows and crops bar it
outright, and among promotions that meet, the earlier one wins; that is greedy suppression over overlapping
pairs.  Crops are candidates' shares of verified spans, assessed on their own, the longest first where they meet.
Regions of verified spans that nothing covers are accepted as rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import decisions as de
from cadenza.operators import intervals as iv
from cadenza.operators.greedy import suppress
from cadenza.operators.storage import materialised

START, END = iv.START, iv.END
# Fixed values of the rule.
PASS_RATIO, RESCUE_WINDOW = 0.5, 0.75
#: Reasons of rejected candidates that the gate looks at again.
WEAK, SHORT, MIXED, CLASSIFIER = "weak_voice", "short_turn", "mixed_voices", "classifier_conflict"

Assess = Callable[[DataFrame], DataFrame]


def judged_candidates(candidates: DataFrame, assessed: DataFrame, blocked: DataFrame, min_ms: int) -> DataFrame:
    """Candidates with is_hard, is_allowed, why, grade (A, B or null), action and promotable.

    action: keep; review (removed from the accepted, tier B); remove (rejected, or not accepted before and left so); crop
    (parts may be promoted); crop_strict; borderline.  `promotable` rows of action crop are promoted where nothing
    bars them.  candidates: segment_id, source_id, start_ms, end_ms, accepted, reject_reason, hard, allowed, reason, tier,
    whole, conflict, fine_conflict, contaminated, rescue, window_min, pass_ratio, borderline, family_overlap, strong_overlap."""
    bars = blocked.select("source_id", START, END)
    struck = iv.overlap_join(candidates.select("segment_id", "source_id", START, END), bars, how="left_semi").select("segment_id").distinct().withColumn("is_blocked", F.lit(True))
    hard_spans = candidates.where(de.yes(F.col("hard"))).select("source_id", START, END)
    near = iv.overlap_join(candidates.select("segment_id", "source_id", START, END), hard_spans, how="left_semi").select("segment_id").distinct().withColumn("near_hard", F.lit(True))
    rows = candidates.join(struck, "segment_id", "left").join(near, "segment_id", "left").join(assessed.drop("source_id"), "segment_id")
    c, yes = F.col, de.yes
    hard = yes(c("hard")) | yes(c("is_blocked"))
    whole = yes(c("whole")) & ~hard & ~yes(c("fine_conflict"))
    rows = rows.withColumns({
        "is_hard": hard,
        "is_whole": whole,
        "is_allowed": ~hard & (whole | (yes(c("allowed")) & ~yes(c("conflict")))),
        "grade": F.when(whole, F.lit("A")).when(~yes(c("conflict")), c("tier")),
        "why": F.when(whole, F.lit("homogeneous_whole_sentence")).when(yes(c("conflict")), F.lit("local_identity_conflict")).otherwise(c("reason")),
        "is_supported": whole | c("supported"),
    })
    review = de.keep_for_review((c(END) - c(START)) / 1000, 0.4, c("is_supported"), c("blocked_fraction"), c("fine_conflict"), c("contaminated"), c("fine_covered_fraction"), c("positive_fraction"), c("fine_mean"), c("fine_error"))
    review = review & ~c("is_hard") & ~c("is_allowed") & ~yes(c("near_hard"))
    rows = rows.withColumns({"grade": F.when(review, F.lit("B")).otherwise(c("grade")), "why": F.when(review, F.lit("fine_identity_disagreement")).otherwise(c("why"))})
    low = (c("observed_fraction") == 0) & yes(c("pass_ratio") < PASS_RATIO)
    good = c("is_allowed") & yes(c("grade") == "A")
    again = yes(c("reject_reason").isin(WEAK, SHORT, MIXED))
    action = (
        F.when(c("accepted") & good & ~low, "keep")
        .when(c("accepted") & (good | yes(c("grade") == "B") | yes(c("borderline")) | yes(c("family_overlap"))), "review")
        .when(c("accepted"), "remove")
        .when(yes(c("grade") == "B") & ~c("is_hard"), "borderline")
        .when(again & ~c("is_hard"), "crop")
        .when(yes(c("reject_reason") == CLASSIFIER) & yes(c("strong_overlap")) & ~c("is_hard"), "borderline")
        .otherwise("remove")
    )
    promotable = c("is_allowed") & (c(END) - c(START) >= min_ms) & yes(c("reject_reason").isin(WEAK, SHORT))
    promotable = promotable & (~yes(c("rescue")) | F.coalesce(c("window_min") >= RESCUE_WINDOW, F.lit(True))) & (c("is_whole") | F.coalesce(c("pass_ratio") >= PASS_RATIO, F.lit(True)))
    return rows.withColumns({
        "why": F.when(c("accepted") & good & low, F.lit("low_window_pass_ratio")).otherwise(c("why")),
        "action": action,
        "promotable": promotable & (action == "crop"),
        # A row removed for its pass ratio alone stays whole; the others' shares of verified spans are kept.
        "croppable": ~c("is_hard") & ~c("is_whole") & ((action == "crop") | (c("accepted") & ~good)),
    })


def _meets(a: DataFrame, b: DataFrame) -> DataFrame:
    """segment_id of a's rows that overlap a row of b."""
    return iv.overlap_join(a.select("segment_id", "source_id", START, END), b.select("source_id", START, END), how="left_semi").select("segment_id").distinct()


def apply_gate(candidates: DataFrame, verified: DataFrame, blocked: DataFrame, conflicts: DataFrame, assess: Assess, min_ms: int = 1200) -> DataFrame:
    """source_id, segment_id, start_ms, end_ms, verdict, why: kept, promoted, review, removed, crop, crop_review (a part that its own
    evidence doesn't support) and synthesized rows.  Parts have their parent's segment_id, synthesized rows none.

    Candidates: see `judged_candidates`; also place (whole numbers: the order of rejected ones) and hard etc. as there.
    verified: spans (source_id, start_ms, end_ms) that the field accepts as such, not overlapping.  conflicts: intervals in which
    another voice was proven, no crop may meet them.  assess: gives spans (source_id, segment_id, start_ms, end_ms) what
    `trajectory.assess_spans` gives them."""
    candidates, spans = materialised(candidates, "candidates"), materialised(verified.select("source_id", START, END), "verified")
    rows = materialised(judged_candidates(candidates, assess(candidates.select("source_id", "segment_id", START, END)), blocked, min_ms), "judged")
    # Shares of verified spans, each assessed as a span of its own.
    shares = iv.overlap_join(rows.where("croppable").select("source_id", "segment_id", "place", "accepted", "why", START, END), spans, least=min_ms - 1)
    shares = shares.select("source_id", F.col("segment_id").alias("parent"), "place", "accepted", "why", F.greatest(START, f"b_{START}").alias(START), F.least(END, f"b_{END}").alias(END))
    shares = shares.withColumn("segment_id", F.concat_ws(":", "parent", START, END))
    shares = materialised(iv.overlap_join(shares, conflicts.select("source_id", START, END), how="left_anti"), "shares")
    seen = assess(shares.select("source_id", "segment_id", START, END)).select("segment_id", "supported", "observed_fraction")
    parts = materialised(shares.join(seen, "segment_id").withColumn("fine", F.col("supported") | (F.col("observed_fraction") == 0)), "parts")

    kept = rows.where("action = 'keep'")
    early = parts.where("fine and accepted").select("source_id", START, END)
    asked = rows.where("promotable")
    barred = _meets(asked, kept).unionByName(_meets(asked, early))
    made = parts.where("fine and not accepted").select("source_id", F.col("place").alias("p"), START, END)
    earlier = iv.overlap_join(asked.select("segment_id", "source_id", "place", START, END), made).where("b_p < place").select("segment_id")
    free = materialised(asked.join(barred.unionByName(earlier).distinct(), "segment_id", "left_anti"), "free")
    spot = free.select("source_id", "segment_id", "place", START, END)
    met = iv.overlap_join(spot, spot).where("place < b_place").select(F.col("segment_id").alias("better"), F.col("b_segment_id").alias("worse"))
    promoted = materialised(free.join(suppress(met).select(F.col("id").alias("segment_id")), "segment_id", "left_anti"), "promoted")

    open_ = parts.join(promoted.select(F.col("segment_id").alias("parent")), "parent", "left_anti")
    standing = kept.select("source_id", START, END).unionByName(promoted.select("source_id", START, END))
    crops = open_.where("fine").dropDuplicates(["source_id", START, END])
    crops = materialised(iv.overlap_join(crops.drop("supported", "observed_fraction", "fine"), standing, how="left_anti"), "crops")
    rank = lambda p: F.struct((F.col(p + START) - F.col(p + END)).alias("d"), F.col(p + START).alias("s"), F.col(f"{p}segment_id").alias("i"))
    spot = crops.select("source_id", "segment_id", START, END)
    pairs = iv.overlap_join(spot, spot).where(rank("") < rank("b_")).select(F.col("segment_id").alias("better"), F.col("b_segment_id").alias("worse"))
    crops = materialised(crops.join(suppress(pairs).select(F.col("id").alias("segment_id")), "segment_id", "left_anti"), "crops")

    taken = standing.unionByName(crops.select("source_id", START, END))
    left = iv.subtract(spans, taken, least=min_ms - 1).select("source_id", START, END)
    left = left.withColumn("segment_id", F.concat_ws(":", "source_id", START, END))
    left = left.join(assess(left.select("source_id", "segment_id", START, END)).where("supported").select("segment_id"), "segment_id", "left_semi")

    has_crop = open_.where("fine").select(F.col("parent").alias("segment_id")).distinct().withColumn("has_crop", F.lit(True))
    rest = rows.join(promoted.select("segment_id"), "segment_id", "left_anti").join(has_crop, "segment_id", "left")
    waits = (F.col("promotable") & F.col("has_crop").isNull()) | de.yes(F.col("family_overlap"))
    verdict = F.when(F.col("action") == "keep", "kept").when(F.col("action").isin("review", "borderline") | ((F.col("action") == "crop") & waits), "review").otherwise("removed")
    columns = lambda df, v, name=F.col("segment_id").cast("string"): df.select("source_id", name.alias("segment_id"), START, END, v.alias("verdict"), "why")
    out = columns(rest, verdict).unionByName(columns(promoted, F.lit("promoted")))
    out = out.unionByName(columns(crops, F.lit("crop"), F.col("parent").cast("string")))
    out = out.unionByName(columns(open_.where("not fine").withColumn("why", F.lit("interval_identity_conflict")), F.lit("crop_review"), F.col("parent").cast("string")))
    return out.unionByName(columns(left.withColumn("why", F.lit("verified_span")), F.lit("synthesized"), F.lit(None).cast("string")))


def gate_report(gated: DataFrame) -> DataFrame:
    """Rows and seconds of each verdict and reason."""
    seconds: Column = F.sum((F.col(END) - F.col(START)) / 1000)
    return gated.groupBy("verdict", "why").agg(F.count("*").alias("n"), F.round(seconds, 3).alias("seconds"))
