"""Queries of decision rules: ordered CASE expressions over scored evidence and its joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions.scores import interpolated
from cadenza.operators import intervals as iv
from cadenza.plans.catalogue import register
from cadenza.plans.sql import BUY, CLICK, ERR, SEG, SHARED, VIEW, merged, pairs
from cadenza.sources import fixtures as fx

HOUR = 3_600_000
ID = ["segment_id", "source_id", "start_ms", "end_ms"]

#: Scored evidence: two channels and their references, from the value and the key.
SCORED = f"(SELECT segment_id, source_id, start_ms, end_ms, k, value, (end_ms - start_ms) / 36000000.0 AS seconds, value / 150 AS first, k / 100.0 AS second, (value / 150 + k / 100.0) / 2 AS paired FROM {SEG})"


def scored(spark, d):
    """seconds is the length in tenths of an hour; first, second and paired are scores."""
    s = fx.segments(spark, d)
    first, second = F.col("value") / 150, F.col("k") / 100.0
    return s.select(*ID, "k", "value", ((F.col("end_ms") - F.col("start_ms")) / 36000000.0).alias("seconds"), first.alias("first"), second.alias("second"), ((first + second) / 2).alias("paired"))


def case(rules, otherwise: str):
    """The name of the first rule that holds; rules are SQL conditions."""
    out = None
    for name, rule in rules:
        out = F.when(F.expr(rule), name) if out is None else out.when(F.expr(rule), name)
    return out.otherwise(otherwise)


def case_sql(rules, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {rule} THEN '{name}'" for name, rule in rules) + f" ELSE '{otherwise}' END"


MATCH = (
    ("short_strong", "seconds < 0.35 AND first >= 0.70 AND second >= 0.60"),
    ("strong", "first >= 0.60 AND paired >= 0.50"),
    ("balanced", "first >= 0.45 AND second >= 0.45 AND seconds >= 0.35"),
    ("recall", "paired >= 0.40 AND seconds >= 2.20"),
    ("weak", "first >= 0.30 OR second >= 0.80"),
)


@register("F10_match_tier", f"SELECT segment_id, {case_sql(MATCH, 'rejected')} AS tier FROM {SCORED}")
def match_tier(spark, d):
    """The first tier whose conditions hold."""
    return scored(spark, d).select("segment_id", case(MATCH, "rejected").alias("tier"))


PREFILTER = (("too_short", "seconds < 0.2"), ("low_first", "first < 0.15"), ("low_paired", "paired < 0.25"), ("too_long", "seconds > 8"))


@register("F31_prefilter_reason", f"SELECT segment_id, {case_sql(PREFILTER, 'pass')} AS reason FROM {SCORED}")
def prefilter_reason(spark, d):
    return scored(spark, d).select("segment_id", case(PREFILTER, "pass").alias("reason"))


RESCUE = (("A", "first >= 0.56 AND second >= 0.30 AND k % 7 <> 0"), ("B", "first >= 0.40 AND k % 7 <> 0 AND paired >= 0.35"))


@register("F24_rescue_tier", f"SELECT segment_id, {case_sql(RESCUE, 'none')} AS tier FROM {SCORED}")
def rescue_tier(spark, d):
    return scored(spark, d).select("segment_id", case(RESCUE, "none").alias("tier"))


@register("F6_high_confidence", f"SELECT segment_id FROM {SCORED} WHERE k % 3 = 1 AND k % 7 <> 0 AND (first >= 0.70 OR first + second >= 1.38)")
def high_confidence(spark, d):
    return scored(spark, d).where("k % 3 = 1 and k % 7 <> 0 and (first >= 0.70 or first + second >= 1.38)").select("segment_id")


@register(
    "F11_window_continuity",
    f"SELECT clip_id, count(*) < 4 OR count(*) FILTER (level < 0.03 AND nxt < 0.03) <= 0.2 * count(*) AS continuous FROM (SELECT *, lead(level) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS nxt FROM {fx.FRAMES_SQL}) GROUP BY clip_id",
)
def window_continuity(spark, d):
    """False if over a fifth of the windows is low in both channels; short clips pass."""
    w = Window.partitionBy("clip_id").orderBy("frame_idx")
    f = fx.frames(spark, d).withColumn("nxt", F.lead("level").over(w))
    low = F.count_if((F.col("level") < 0.03) & (F.col("nxt") < 0.03))
    return f.groupBy("clip_id").agg(((F.count("*") < 4) | (low <= 0.2 * F.count("*"))).alias("continuous"))


@register(
    "F13_span_verdict",
    f"""SELECT s.segment_id, CASE WHEN coalesce(e.hard, 0) > 0 THEN 'rejected' WHEN coalesce(e.n, 0) = 0 THEN 'unresolved:no_identity' WHEN e.mean < 20 THEN 'unresolved:weak' ELSE 'accepted' END AS verdict
    FROM {CLICK} s LEFT JOIN (SELECT x.segment_id, count(*) AS n, count(*) FILTER (y.k % 10 = 0) AS hard, avg(y.value) AS mean FROM {pairs(CLICK, VIEW)} GROUP BY x.segment_id) e USING (segment_id)""",
)
def span_verdict(spark, d):
    """Any hard evidence rejects, and is never diluted; then reasons in order."""
    s, v = fx.segments(spark, d, "click").select(*ID), fx.segments(spark, d, "view").select(*ID, "k", "value")
    e = iv.overlap_join(s, v).groupBy("segment_id").agg(F.count("*").alias("n"), F.count_if(F.col("b_k") % 10 == 0).alias("hard"), F.avg("b_value").alias("mean"))
    rules = (("rejected", "hard > 0"), ("unresolved:no_identity", "n is null"), ("unresolved:weak", "mean < 20"))
    return s.join(e, "segment_id", "left").select("segment_id", case(rules, "accepted").alias("verdict"))


@register(
    "F14_positive_conflict",
    f"""SELECT DISTINCT s.segment_id FROM {CLICK} s WHERE EXISTS (SELECT 1 FROM {BUY} b WHERE b.source_id = s.source_id AND b.start_ms > s.start_ms AND b.start_ms < s.end_ms)
      OR EXISTS (SELECT 1 FROM {ERR} e WHERE e.source_id = s.source_id AND e.start_ms >= s.start_ms AND e.end_ms <= s.end_ms)""",
)
def positive_conflict(spark, d):
    """A change strictly inside, or a wholly contained veto; crossing rows abstain."""
    s = fx.segments(spark, d, "click").select(*ID)
    points = fx.segments(spark, d, "purchase").select("source_id", "start_ms", (F.col("start_ms") + 1).alias("end_ms"))
    inside = iv.overlap_join(s, points).where("b_start_ms > start_ms").select("segment_id")
    veto = iv.overlap_join(s, fx.segments(spark, d, "error").select(*ID)).where("b_start_ms >= start_ms and b_end_ms <= end_ms").select("segment_id")
    return inside.unionByName(veto).distinct()


@register(
    "F18_confirmed_rival",
    f"SELECT source_id, count(*) FILTER (first >= 0.4 AND second >= 0.4) AS primary_rows, count(*) FILTER (first >= 0.4 AND second >= 0.4) >= 1 AND count(*) FILTER (paired >= 0.6) >= 2 AS confirmed FROM {SCORED} GROUP BY source_id",
)
def confirmed_rival(spark, d):
    both, extra = F.count_if((F.col("first") >= 0.4) & (F.col("second") >= 0.4)), F.count_if(F.col("paired") >= 0.6)
    return scored(spark, d).groupBy("source_id").agg(both.alias("primary_rows"), ((both >= 1) & (extra >= 2)).alias("confirmed"))


@register(
    "F22_four_view_verdict",
    f"""SELECT segment_id, CASE WHEN missing > 0 THEN 'unresolved' WHEN positive >= 2 THEN 'target' WHEN negative >= 3 THEN 'other' ELSE 'unresolved' END AS verdict FROM (
      SELECT segment_id, CAST(k % 13 = 0 AS INT) AS missing, CAST(first > 0.3 AS INT) + CAST(second > 0.5 AS INT) + CAST(paired > 0.4 AS INT) + CAST(value > 40 AS INT) AS positive,
        CAST(first < 0.1 AS INT) + CAST(second < 0.2 AS INT) + CAST(paired < 0.15 AS INT) + CAST(value < 10 AS INT) AS negative FROM {SCORED})""",
)
def four_view_verdict(spark, d):
    """From long-form views, so that more of them need no change."""
    s = scored(spark, d)
    view = lambda c, hi, lo: F.struct(F.when(F.col("k") % 13 != 0, F.col(c).cast("double")).alias("v"), F.lit(hi).alias("hi"), F.lit(lo).alias("lo"))
    views = s.select("segment_id", F.explode(F.array(view("first", 0.3, 0.1), view("second", 0.5, 0.2), view("paired", 0.4, 0.15), view("value", 40.0, 10.0))).alias("w"))
    g = views.groupBy("segment_id").agg(
        F.count_if(F.col("w.v").isNull()).alias("missing"), F.count_if(F.col("w.v") > F.col("w.hi")).alias("positive"), F.count_if(F.col("w.v") < F.col("w.lo")).alias("negative")
    )
    rules = (("unresolved", "missing > 0"), ("target", "positive >= 2"), ("other", "negative >= 3"))
    return g.select("segment_id", case(rules, "unresolved").alias("verdict"))


JOINS = (("contaminated", "n_k % 7 = 0 OR k % 7 = 0"), ("hard_gap", f"gap > {6 * HOUR}"), ("change", "abs(n_value - value) > 60"), ("unresolved", "value < 5 OR n_value < 5"))


@register(
    "F23_join_permission",
    f"""SELECT segment_id, {case_sql(JOINS, 'allowed')} AS permission FROM (SELECT *, lead(k) OVER w AS n_k, lead(value) OVER w AS n_value, lead(start_ms) OVER w - end_ms AS gap FROM {CLICK} WINDOW w AS (PARTITION BY source_id ORDER BY start_ms, segment_id)) WHERE n_k IS NOT NULL""",
)
def join_permission(spark, d):
    w = Window.partitionBy("source_id").orderBy("start_ms", "segment_id")
    s = fx.segments(spark, d, "click").withColumns({"n_k": F.lead("k").over(w), "n_value": F.lead("value").over(w), "gap": F.lead("start_ms").over(w) - F.col("end_ms")})
    return s.where("n_k is not null").select("segment_id", case(JOINS, "allowed").alias("permission"))


@register(
    "F25_classifier_veto",
    f"""SELECT x.segment_id FROM {pairs(CLICK, VIEW, HOUR - 1)} WHERE y.value <= 15 GROUP BY x.segment_id HAVING count(*) >= 2""",
)
def classifier_veto(spark, d):
    p = iv.overlap_join(fx.segments(spark, d, "click").select(*ID), fx.segments(spark, d, "view").select(*ID, "value"), least=HOUR - 1)
    return p.where("b_value <= 15").groupBy("segment_id").agg(F.count("*").alias("n")).where("n >= 2").select("segment_id")


@register(
    "F26_keep_for_review",
    f"""SELECT s.segment_id FROM {CLICK} s JOIN (SELECT x.segment_id, sum({SHARED}) AS c FROM {pairs(CLICK, merged(VIEW))} GROUP BY x.segment_id) c USING (segment_id)
    WHERE c >= 0.75 * (s.end_ms - s.start_ms) AND s.value > 10 AND s.segment_id NOT IN (SELECT x.segment_id FROM {pairs(CLICK, ERR)})""",
)
def keep_for_review(spark, d):
    s = fx.segments(spark, d, "click").select(*ID, "value")
    c = iv.covered_length(s, fx.segments(spark, d, "view").select(*ID)).where("covered_ms >= 0.75 * (end_ms - start_ms) and value > 10").drop("covered_ms")
    return iv.overlap_join(c, fx.segments(spark, d, "error").select(*ID), how="left_anti").select("segment_id")


@register(
    "F28_clean_core",
    f"""SELECT source_id, min(first) >= 0.02 AND avg(second) >= 0.3 OR max(paired) >= 0.8 AS certified FROM {SCORED} WHERE seconds >= 0.5 GROUP BY source_id""",
)
def clean_core(spark, d):
    g = scored(spark, d).where("seconds >= 0.5").groupBy("source_id")
    return g.agg((((F.min("first") >= 0.02) & (F.avg("second") >= 0.3)) | (F.max("paired") >= 0.8)).alias("certified"))


@register("F29_nonmember_gate", f"SELECT segment_id FROM {SCORED} WHERE k % 7 <> 0 AND (paired >= 0.6 OR (first >= 0.3 AND second >= 0.3))")
def nonmember_gate(spark, d):
    return scored(spark, d).where("k % 7 <> 0 and (paired >= 0.6 or (first >= 0.3 and second >= 0.3))").select("segment_id")


@register("F21_strong_island", f"SELECT segment_id FROM {SCORED} WHERE first > 0.25 AND second > 0.25 AND paired > 0.25 AND value > 25 AND k % 11 <> 0")
def strong_island(spark, d):
    return scored(spark, d).where("least(first, second, paired, value / 100) > 0.25 and k % 11 <> 0").select("segment_id")


@register("F17_local_witness", f"SELECT segment_id, first < 0.1 AND second < 0.3 AND paired < 0.2 AND value < 20 AS witness FROM {SCORED}")
def local_witness(spark, d):
    return scored(spark, d).select("segment_id", F.expr("first < 0.1 and second < 0.3 and paired < 0.2 and value < 20").alias("witness"))


@register(
    "F19_recall_promotion",
    f"SELECT segment_id, CASE WHEN k % 3 = 2 AND first >= 0.30 AND second >= 0.50 THEN 'promoted' ELSE 'kept' END AS state FROM {SCORED}",
)
def recall_promotion(spark, d):
    return scored(spark, d).select("segment_id", case((("promoted", "k % 3 = 2 and first >= 0.30 and second >= 0.50"),), "kept").alias("state"))


PATHS = (("A", "n >= 6 AND low >= 0.01"), ("B", "n >= 4 AND low >= 0.005"), ("C", "high >= 0.5"), ("D", "mean >= 0.1"))


@register("F20_certificate_path", f"SELECT clip_id, {case_sql(PATHS, 'none')} AS path FROM (SELECT clip_id, count(*) AS n, min(level) AS low, max(level) AS high, avg(level) AS mean FROM {fx.FRAMES_SQL} GROUP BY clip_id)")
def certificate_path(spark, d):
    g = fx.frames(spark, d).groupBy("clip_id").agg(F.count("*").alias("n"), F.min("level").alias("low"), F.max("level").alias("high"), F.avg("level").alias("mean"))
    return g.select("clip_id", case(PATHS, "none").alias("path"))


THIRD = (("whole_turn", "seconds BETWEEN 2.2 AND 15 AND first >= 0.40 AND second >= first + 0.03 AND paired >= 0.53"), ("fragment", "seconds BETWEEN 0.75 AND 8 AND first >= 0.44 AND second >= 0.48"))


@register("F33_third_channel", f"SELECT segment_id, {case_sql(THIRD, 'none')} AS promotion FROM {SCORED}")
def third_channel(spark, d):
    return scored(spark, d).select("segment_id", case(THIRD, "none").alias("promotion"))


@register(
    "A5_weighted_scores",
    f"SELECT x.segment_id, round(1 / (1 + exp(-(sum(y.value * {SHARED}) / sum({SHARED}) - 30) / 10)), 6) AS p FROM {pairs(CLICK, VIEW)} GROUP BY x.segment_id",
)
def weighted_scores(spark, d):
    p = iv.overlap_join(fx.segments(spark, d, "click").select(*ID), fx.segments(spark, d, "view").select(*ID, "value")).withColumn("w", iv.shared())
    mean = F.sum(F.col("b_value") * F.col("w")) / F.sum("w")
    return p.groupBy("segment_id").agg(F.round(1 / (1 + F.exp(-(mean - 30) / 10)), 6).alias("p"))


@register(
    "A21_rescore_difference",
    f"""SELECT count(*) AS evaluated, count(*) FILTER (first < 0.3 AND second >= 0.5) AS promoted, count(*) FILTER (first >= 0.3 AND second < 0.5) AS demoted FROM {SCORED} WHERE segment_id NOT IN (SELECT segment_id FROM {fx.REVIEWS_SQL})""",
)
def rescore_difference(spark, d):
    s = scored(spark, d).join(fx.reviews(spark, d).select("segment_id"), "segment_id", "left_anti")
    was, now = F.col("first") >= 0.3, F.col("second") >= 0.5
    return s.agg(F.count("*").alias("evaluated"), F.count_if(~was & now).alias("promoted"), F.count_if(was & ~now).alias("demoted"))


@register(
    "A22_lowest_pass_ratio",
    f"""SELECT segment_id, round(min(r), 6) AS ratio FROM (SELECT x.segment_id, y.kind, avg(CASE WHEN y.value >= 20 THEN 1.0 ELSE 0.0 END) AS r FROM {pairs(CLICK, f"(SELECT * FROM {SEG} WHERE kind <> 'click' AND k % 5 <> 0)")} GROUP BY x.segment_id, y.kind) GROUP BY segment_id""",
)
def lowest_pass_ratio(spark, d):
    other = fx.segments(spark, d).where("kind <> 'click' and k % 5 <> 0").select(*ID, "kind", "value")
    p = iv.overlap_join(fx.segments(spark, d, "click").select(*ID), other)
    r = p.groupBy("segment_id", "b_kind").agg(F.avg(F.when(F.col("b_value") >= 20, 1.0).otherwise(0.0)).alias("r"))
    return r.groupBy("segment_id").agg(F.round(F.min("r"), 6).alias("ratio"))


@register(
    "A23_quiet_gap_ratio",
    f"""SELECT clip_id, round(avg(CASE WHEN level <= floor_level THEN 1.0 ELSE 0.0 END), 6) AS quiet FROM {fx.FRAMES_SQL} JOIN (SELECT clip_id, least(0.05, quantile_cont(level, 0.75) / 4) AS floor_level FROM {fx.FRAMES_SQL} GROUP BY clip_id) USING (clip_id) GROUP BY clip_id""",
)
def quiet_gap_ratio(spark, d):
    """The quartile as the SQL's engine rounds it, as levels are compared with a quarter of it."""
    f = fx.frames(spark, d)
    heard = f.where("level is not null").withColumn("r", F.row_number().over(Window.partitionBy("clip_id").orderBy("level")))
    heard = heard.withColumn("at", 3 * (F.count("*").over(Window.partitionBy("clip_id")) - 1))  # of the quartile from 0, in quarters
    ranked = lambda up: F.max(F.when(F.col("r") == F.floor((F.col("at") + up) / 4) + 1, F.col("level")))
    ends = heard.groupBy("clip_id").agg(ranked(0).alias("low"), ranked(3).alias("high"), F.pmod(F.first("at"), F.lit(4)).alias("quarter"))
    q = ends.select("clip_id", F.least(F.lit(0.05), interpolated("low", "high", "quarter") / 4).alias("floor_level"))
    return f.join(q, "clip_id").groupBy("clip_id").agg(F.round(F.avg(F.when(F.col("level") <= F.col("floor_level"), 1.0).otherwise(0.0)), 6).alias("quiet"))


@register(
    "J10_versioned_overlay",
    f"""SELECT s.segment_id, coalesce(u.value, s.value) AS value, u.segment_id IS NOT NULL AS updated FROM {SEG} s LEFT JOIN (SELECT segment_id, value * 2 AS value, k FROM {SEG} WHERE k % 6 = 0 AND kind = 'click') u ON u.segment_id = s.segment_id AND u.k = s.k""",
)
def versioned_overlay(spark, d):
    s = fx.segments(spark, d)
    u = s.where("k % 6 = 0 and kind = 'click'").select("segment_id", "k", (F.col("value") * 2).alias("new"), F.lit(True).alias("hit"))
    return s.join(u, ["segment_id", "k"], "left").select("segment_id", F.coalesce("new", "value").alias("value"), F.coalesce("hit", F.lit(False)).alias("updated"))


@register("J11_segments_with_reviews", f"SELECT s.segment_id, s.kind, r.label, r.grade FROM {SEG} s LEFT JOIN {fx.REVIEWS_SQL} r USING (segment_id)")
def segments_with_reviews(spark, d):
    return fx.segments(spark, d).join(fx.reviews(spark, d), "segment_id", "left").select("segment_id", "kind", "label", "grade")


@register(
    "J13_paired_lower_median",
    f"""SELECT source_id, round(list_sort(list(m))[(count(*) + 1) // 2], 6) AS paired FROM (SELECT a.source_id, (a.value + b.value) / 2 AS m FROM {CLICK} a JOIN {VIEW} b ON a.source_id = b.source_id AND a.k = b.k) GROUP BY source_id""",
)
def paired_lower_median(spark, d):
    from cadenza.functions.vectors import lower_median

    a = fx.segments(spark, d, "click").select("source_id", "k", F.col("value").alias("x"))
    b = fx.segments(spark, d, "view").select("source_id", "k", F.col("value").alias("y"))
    m = a.join(b, ["source_id", "k"]).groupBy("source_id").agg(F.collect_list((F.col("x") + F.col("y")) / 2).alias("m"))
    return m.select("source_id", F.round(lower_median(F.col("m")), 6).alias("paired"))


@register(
    "J33_diagonal_support",
    f"""SELECT source_id, count(*) FILTER (x >= 20 AND y >= 20) AS support, round(max(CASE WHEN x >= 20 AND y >= 20 THEN least(x, y) END), 6) AS best FROM (SELECT a.source_id, a.value AS x, b.value AS y FROM {CLICK} a JOIN {VIEW} b ON a.source_id = b.source_id AND a.k = b.k) GROUP BY source_id""",
)
def diagonal_support(spark, d):
    a = fx.segments(spark, d, "click").select("source_id", "k", F.col("value").alias("x"))
    b = fx.segments(spark, d, "view").select("source_id", "k", F.col("value").alias("y"))
    ok = (F.col("x") >= 20) & (F.col("y") >= 20)
    return a.join(b, ["source_id", "k"]).groupBy("source_id").agg(F.count_if(ok).alias("support"), F.round(F.max(F.when(ok, F.least("x", "y"))), 6).alias("best"))


@register(
    "J20_local_offset",
    f"""SELECT segment_id, offset_ms FROM (SELECT x.segment_id, CAST(floor(median(y.start_ms - x.start_ms)) AS BIGINT) AS offset_ms, count(*) AS n FROM {BUY} x JOIN {VIEW} y ON x.source_id = y.source_id AND abs(y.start_ms - x.start_ms) <= {45 * HOUR} GROUP BY x.segment_id) WHERE n >= 2""",
)
def local_offset(spark, d):
    """Median offset of the anchors within 45 hours, of two at least, by a band join on buckets."""
    band = 45 * HOUR
    a = fx.segments(spark, d, "purchase").select("segment_id", "source_id", (F.col("start_ms") - band).alias("start_ms"), (F.col("start_ms") + band + 1).alias("end_ms"))
    b = fx.segments(spark, d, "view").select("source_id", "start_ms", (F.col("start_ms") + 1).alias("end_ms"))
    p = iv.overlap_join(a, b).withColumn("o", F.col("b_start_ms") - F.col("start_ms") - band)
    g = p.groupBy("segment_id").agg(F.floor(F.percentile("o", 0.5)).alias("offset_ms"), F.count("*").alias("n"))
    return g.where("n >= 2").select("segment_id", "offset_ms")


@register("T4_round_of_information", f"SELECT segment_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY abs(first - 0.3), segment_id) AS INTEGER) AS place FROM {SCORED} WHERE k % 2 = 1")
def round_of_information(spark, d):
    """Unlabelled rows of each source, the least certain first."""
    w = Window.partitionBy("source_id").orderBy(F.abs(F.col("first") - 0.3), "segment_id")
    return scored(spark, d).where("k % 2 = 1").select("segment_id", F.row_number().over(w).alias("place"))


@register(
    "E6_sticky_partition",
    f"""SELECT source_id, CASE WHEN trained > 0 THEN 'train' WHEN h < '4' THEN 'holdout' ELSE 'train' END AS part FROM (SELECT source_id, count(*) FILTER (k = 0) AS trained, substr(sha256(CAST(source_id AS VARCHAR)), 1, 1) AS h FROM {SEG} GROUP BY source_id)""",
)
def sticky_partition(spark, d):
    """A source that was trained on is never held out; the others by their hash."""
    g = fx.segments(spark, d).groupBy("source_id").agg(F.count_if(F.col("k") == 0).alias("trained"))
    h = F.substring(F.sha2(F.col("source_id").cast("string").cast("binary"), 256), 1, 1)
    part = F.when(F.col("trained") > 0, "train").when(h < "4", "holdout").otherwise("train")
    return g.select("source_id", part.alias("part"))


@register(
    "W12_decayed_transitions",
    f"""SELECT source_id, round(ln((sum(CASE WHEN kind = nxt THEN exp(-gap / {20.0 * HOUR}) ELSE 0 END) + 0.5) / (sum(CASE WHEN kind <> nxt THEN exp(-gap / {20.0 * HOUR}) ELSE 0 END) + 0.5)), 6) AS odds
    FROM (SELECT source_id, kind, lead(kind) OVER w AS nxt, lead(start_ms) OVER w - start_ms AS gap FROM {SEG} WINDOW w AS (PARTITION BY source_id ORDER BY start_ms, segment_id)) WHERE nxt IS NOT NULL GROUP BY source_id""",
)
def decayed_transitions(spark, d):
    w = Window.partitionBy("source_id").orderBy("start_ms", "segment_id")
    s = fx.segments(spark, d).withColumns({"nxt": F.lead("kind").over(w), "gap": F.lead("start_ms").over(w) - F.col("start_ms")}).where("nxt is not null")
    weight = F.exp(-F.col("gap") / (20.0 * HOUR))
    part = lambda same: F.sum(F.when((F.col("kind") == F.col("nxt")) == same, weight).otherwise(0.0)) + 0.5
    return s.groupBy("source_id").agg(F.round(F.log(part(F.lit(True)) / part(F.lit(False))), 6).alias("odds"))


@register(
    "W5_inversion_audit",
    f"""SELECT count(*) AS inversions FROM (SELECT score, y, max(CASE WHEN y = 0 THEN score END) OVER (ORDER BY old RANGE BETWEEN UNBOUNDED PRECEDING AND 20 PRECEDING) AS worst
      FROM (SELECT value AS score, value / 2 + k AS old, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS y FROM {SEG})) WHERE y = 1 AND worst > score""",
)
def inversion_audit(spark, d):
    """Positives that some clearly lower negative of the old order now outranks.  Prefix maxima
    are taken within ranges of the old score, and over one maximum for each range."""
    from cadenza.operators.evaluation import running_max

    s = fx.segments(spark, d).select(F.col("value").alias("score"), (F.col("value") / 2 + F.col("k")).alias("old"), F.when(F.col("k") % 3 == 0, 1).otherwise(0).alias("y"))
    # Positives ask 20 below their own old score; an equal negative counts.
    both = s.select("score", "y", F.when(F.col("y") == 1, F.col("old") - 20).otherwise(F.col("old")).alias("at"), F.when(F.col("y") == 0, F.col("score")).alias("negative"))
    out = running_max(both, "at", "negative", "worst")
    return out.where("y = 1 and worst > score").agg(F.count("*").alias("inversions"))
