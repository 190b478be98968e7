"""Queries of reports, aggregates, windows, ranks, set operations, deduplication and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions import scores as sc
from cadenza.plans.catalogue import register
from cadenza.plans.sql import SEG
from cadenza.sources import fixtures as fx

REV = fx.REVIEWS_SQL
RANK_SQL = "CASE grade WHEN 'Review' THEN 0 WHEN 'Silver' THEN 1 WHEN 'Gold' THEN 2 ELSE -1 END"
SECONDS = "((end_ms - start_ms) / 1000.0)"
BUCKET_SQL = f"CASE WHEN {SECONDS} < 10000 THEN 'short' WHEN {SECONDS} < 30000 THEN 'medium' ELSE 'long' END"


def reviewed(spark, d):
    s = fx.segments(spark, d).withColumn("seconds", (F.col("end_ms") - F.col("start_ms")) / 1000)
    return s.join(fx.reviews(spark, d), "segment_id", "left")


REVIEWED = f"(SELECT s.*, {SECONDS} AS seconds, r.label, r.grade FROM {SEG} s LEFT JOIN {REV} r USING (segment_id))"


@register(
    "flagship_corpus_report",
    f"""WITH kept AS (SELECT *, row_number() OVER (PARTITION BY kind, seconds, value ORDER BY segment_id) AS copy
      FROM {REVIEWED} WHERE label IN ('correct', 'partial') AND {RANK_SQL} >= 1)
    SELECT kind, count(*) AS clips, count(DISTINCT source_id) AS sources, CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms,
      round(min(seconds), 3) AS shortest, round(avg(seconds), 6) AS mean_seconds, round(max(seconds), 3) AS longest,
      round(avg(CASE WHEN grade = 'Gold' THEN 1.0 ELSE 0.0 END), 6) AS gold_share, round(avg(CASE WHEN label = 'partial' THEN 1.0 ELSE 0.0 END), 6) AS partial_share
    FROM kept WHERE copy = 1 GROUP BY kind""",
)
def corpus_report(spark, d):
    """Reviewed segments that are good enough, without copies, as a health report."""
    r = reviewed(spark, d).where(F.col("label").isin("correct", "partial") & (sc.grade_rank(F.col("grade")) >= 1))
    copy = Window.partitionBy("kind", "seconds", "value").orderBy("segment_id")
    kept = r.withColumn("copy", F.row_number().over(copy)).where("copy = 1")
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return kept.groupBy("kind").agg(
        F.count("*").alias("clips"),
        F.count_distinct("source_id").alias("sources"),
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"),
        F.round(F.min("seconds"), 3).alias("shortest"),
        F.round(F.avg("seconds"), 6).alias("mean_seconds"),
        F.round(F.max("seconds"), 3).alias("longest"),
        share(F.col("grade") == "Gold").alias("gold_share"),
        share(F.col("label") == "partial").alias("partial_share"),
    )


@register(
    "S1_ordinals_of_manifest",
    f"SELECT source_id, segment_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY start_ms, segment_id) AS BIGINT) AS ordinal FROM {SEG}",
)
def ordinals(spark, d):
    order = Window.partitionBy("source_id").orderBy("start_ms", "segment_id")
    return fx.segments(spark, d).select("source_id", "segment_id", F.row_number().over(order).cast("long").alias("ordinal"))


@register(
    "S4_srt_lines",
    f"""SELECT segment_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY start_ms, segment_id) AS BIGINT) AS n,
      lpad(CAST(start_ms // 3600000 AS VARCHAR), CAST(greatest(2, length(CAST(start_ms // 3600000 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(start_ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' ||
      lpad(CAST(start_ms // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST(start_ms % 1000 AS VARCHAR), 3, '0') || ' [' || source_id || '] ' || kind AS line FROM {SEG}""",
)
def srt_lines(spark, d):
    from cadenza.functions.text import srt_time

    order = Window.partitionBy("source_id").orderBy("start_ms", "segment_id")
    s = fx.segments(spark, d)
    line = F.concat(srt_time(F.col("start_ms") / 1000), F.lit(" ["), F.col("source_id").cast("string"), F.lit("] "), F.col("kind"))
    return s.select("segment_id", F.row_number().over(order).cast("long").alias("n"), line.alias("line"))


@register(
    "S5_batch_union",
    f"""SELECT target, count(*) AS n, CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms FROM (SELECT *, 'one' AS target FROM {SEG} WHERE kind = 'click'
      UNION ALL SELECT *, 'two' FROM {SEG} WHERE kind = 'view') GROUP BY target""",
)
def batch_union(spark, d):
    one, two = (fx.segments(spark, d, k).withColumn("target", F.lit(t)) for k, t in (("click", "one"), ("view", "two")))
    return one.unionByName(two).groupBy("target").agg(F.count("*").alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"))


@register(
    "S13_feature_store_upsert",
    f"""SELECT source_id, k, segment_id, value FROM (SELECT *, row_number() OVER (PARTITION BY source_id, k ORDER BY start_ms DESC, segment_id DESC) AS r FROM {SEG}) WHERE r = 1""",
)
def feature_store_upsert(spark, d):
    """The latest row of each key wins, as one aggregate with map-side combine."""
    s = fx.segments(spark, d)
    best = s.groupBy("source_id", "k").agg(F.max_by(F.struct("segment_id", "value"), F.struct("start_ms", "segment_id")).alias("b"))
    return best.select("source_id", "k", "b.segment_id", "b.value")


@register("F1_quarantine", f"SELECT event_id FROM events WHERE event_id NOT IN (SELECT segment_id FROM {SEG})")
def quarantine(spark, d):
    e = fx.table(spark, d, "events").select(F.col("event_id"))
    return e.join(fx.segments(spark, d).select(F.col("segment_id").alias("event_id")), "event_id", "left_anti")


@register(
    "F2_normalise_accepted",
    f"SELECT segment_id, label IN ('correct', 'partial') AND k % 7 <> 0 AS accepted, CASE WHEN label NOT IN ('correct', 'partial') THEN label WHEN k % 7 = 0 THEN 'excluded' END AS reason FROM {REVIEWED} WHERE label IS NOT NULL",
)
def normalise_accepted(spark, d):
    good = F.col("label").isin("correct", "partial")
    reason = F.when(~good, F.col("label")).when(F.col("k") % 7 == 0, "excluded")
    return reviewed(spark, d).where("label is not null").select("segment_id", (good & reason.isNull()).alias("accepted"), reason.alias("reason"))


@register("F3_reviewable", f"SELECT segment_id FROM {REVIEWED} WHERE value > 5 AND (label = 'correct' OR k % 3 = 0 OR kind = 'error')")
def reviewable(spark, d):
    return reviewed(spark, d).where("value > 5 and (label = 'correct' or k % 3 = 0 or kind = 'error')").select("segment_id")


@register(
    "F5_review_views",
    f"""SELECT v AS view, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN label IS NULL THEN 'unreviewed' ELSE 'done' END, CASE WHEN k % 3 = 0 THEN 'tierA' WHEN k % 3 = 1 THEN 'tierB' ELSE 'remaining' END,
      CASE WHEN label IN ('wrong', 'singing', 'overlap') THEN 'removed' END], lambda x: x IS NOT NULL)) AS v FROM {REVIEWED}) GROUP BY v""",
)
def review_views(spark, d):
    """Named predicates; a row is in each view whose predicate holds."""
    views = {
        "unreviewed": "label is null", "done": "label is not null", "tierA": "k % 3 = 0", "tierB": "k % 3 = 1",
        "remaining": "k % 3 not in (0, 1)", "removed": "label in ('wrong', 'singing', 'overlap')",
    }
    names = F.array_compact(F.array(*[F.when(F.expr(p), F.lit(n)) for n, p in views.items()]))
    return reviewed(spark, d).select(F.explode(names).alias("view")).groupBy("view").agg(F.count("*").alias("n"))


@register("F7_bulk_label", f"SELECT segment_id, 'correct' AS label FROM {SEG} WHERE k % 3 = 0 AND segment_id NOT IN (SELECT segment_id FROM {REV}) UNION ALL SELECT segment_id, label FROM {REV}")
def bulk_label(spark, d):
    marked = fx.reviews(spark, d).select("segment_id", "label")
    new = fx.segments(spark, d).where("k % 3 = 0").join(marked, "segment_id", "left_anti").select("segment_id", F.lit("correct").alias("label"))
    return new.unionByName(marked)


@register("F8_minimum_grade", f"SELECT segment_id, grade FROM {REV} WHERE {RANK_SQL} >= 1")
def minimum_grade(spark, d):
    return fx.reviews(spark, d).where(sc.grade_rank(F.col("grade")) >= 1).select("segment_id", "grade")


@register(
    "F12_route_label",
    f"SELECT segment_id, CASE WHEN k % 11 = 0 THEN 'rescued' WHEN k % 7 = 0 THEN 'cluster' WHEN k % 5 = 0 THEN 'local' ELSE 'direct' END AS route FROM {SEG}",
)
def route_label(spark, d):
    keys = (("rescued", 11), ("cluster", 7), ("local", 5))
    route = F.coalesce(*[F.when(F.col("k") % n == 0, name) for name, n in keys], F.lit("direct"))
    return fx.segments(spark, d).select("segment_id", route.alias("route"))


@register("A1_reject_reasons", f"SELECT coalesce(nullif(label, 'skip'), 'unknown') AS reason, count(*) AS n FROM {REV} WHERE label <> 'correct' GROUP BY 1")
def reject_reasons(spark, d):
    reason = F.coalesce(F.nullif(F.col("label"), F.lit("skip")), F.lit("unknown"))
    return fx.reviews(spark, d).where("label <> 'correct'").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@register(
    "A2_batch_summary",
    f"SELECT kind, count(*) AS total, count(CASE WHEN label = 'correct' THEN 1 END) AS accepted, count(label) AS labelled, count(DISTINCT source_id) AS targets FROM {REVIEWED} GROUP BY kind",
)
def batch_summary(spark, d):
    return reviewed(spark, d).groupBy("kind").agg(
        F.count("*").alias("total"), F.count_if(F.col("label") == "correct").alias("accepted"), F.count("label").alias("labelled"), F.count_distinct("source_id").alias("targets")
    )


@register(
    "A3_health_rollup",
    f"""SELECT kind, {BUCKET_SQL} AS bucket, count(*) AS n, round(avg(seconds), 6) AS mean_seconds, round(avg(CASE WHEN label IS NOT NULL THEN value END), 6) AS mean_measured
    FROM {REVIEWED} GROUP BY ROLLUP (kind, bucket)""",
)
def health_rollup(spark, d):
    bucket = F.when(F.col("seconds") < 10000, "short").when(F.col("seconds") < 30000, "medium").otherwise("long")
    r = reviewed(spark, d).withColumn("bucket", bucket)
    return r.rollup("kind", "bucket").agg(
        F.count("*").alias("n"), F.round(F.avg("seconds"), 6).alias("mean_seconds"), F.round(F.avg(F.when(F.col("label").isNotNull(), F.col("value"))), 6).alias("mean_measured")
    )


@register(
    "A4_window_stats",
    f"""SELECT clip_id, count(*) AS n, round(min(level), 6) AS least, round(quantile_cont(level, 0.2), 6) AS p20, round(avg(CASE WHEN level >= 0.05 THEN 1.0 ELSE 0.0 END), 6) AS votes,
      round(list_sort(list(level))[(count(*) + 1) // 2], 6) AS lower_median FROM {fx.FRAMES_SQL} GROUP BY clip_id""",
)
def window_stats(spark, d):
    n = F.count("*")
    mid = F.element_at(F.sort_array(F.collect_list("level")), F.floor((n + 1) / 2).cast("int"))
    return fx.frames(spark, d).groupBy("clip_id").agg(
        n.alias("n"),
        F.round(F.min("level"), 6).alias("least"),
        F.round(F.percentile("level", 0.2), 6).alias("p20"),
        F.round(F.avg(F.when(F.col("level") >= 0.05, 1.0).otherwise(0.0)), 6).alias("votes"),
        F.round(mid, 6).alias("lower_median"),
    )


@register(
    "A8_robust_scale",
    f"""SELECT clip_id, round(mid, 6) AS centre, round(CASE WHEN mad > 0 THEN mad / 0.6745 ELSE rms END, 6) AS scale FROM (
      SELECT clip_id, any_value(mid) AS mid, median(abs(level - mid)) AS mad, sqrt(avg((level - mid) ** 2)) AS rms FROM
      (SELECT *, median(level) OVER (PARTITION BY clip_id) AS mid FROM {fx.FRAMES_SQL}) GROUP BY clip_id)""",
)
def robust_scale(spark, d):
    f = fx.frames(spark, d)
    mid = f.groupBy("clip_id").agg(F.percentile("level", 0.5).alias("mid"))
    off = f.join(mid, "clip_id").withColumn("off", F.abs(F.col("level") - F.col("mid")))
    s = off.groupBy("clip_id").agg(F.first("mid").alias("mid"), F.percentile("off", 0.5).alias("mad"), F.sqrt(F.avg(F.col("off") * F.col("off"))).alias("rms"))
    scale = F.when(F.col("mad") > 0, F.col("mad") / 0.6745).otherwise(F.col("rms"))
    return s.select("clip_id", F.round("mid", 6).alias("centre"), F.round(scale, 6).alias("scale"))


STAGES = ("view", "click", "purchase", "error")


@register(
    "A10_stage_funnel",
    f"SELECT kind AS stage, list_position({list(STAGES)!r}, kind) AS place, count(*) AS n, CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms FROM {SEG} WHERE kind IN {STAGES!r} GROUP BY kind",
)
def stage_funnel(spark, d):
    order = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")).cast("int")
    s = fx.segments(spark, d).where(F.col("kind").isin(*STAGES)).groupBy(F.col("kind").alias("stage"))
    return s.agg(F.count("*").alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms")).withColumn("place", order)


@register(
    "A13_detector_decision",
    f"""SELECT clip_id, round(quantile_cont(level, 0.95), 6) AS p95, round(max(level), 6) AS peak, round(count(CASE WHEN level >= 0.2 THEN 1 END) / count(*), 6) AS active_share,
      quantile_cont(level, 0.95) >= 0.25 AND count(CASE WHEN level >= 0.2 THEN 1 END) >= 3 AS positive FROM {fx.FRAMES_SQL} WHERE level >= 0.01 GROUP BY clip_id""",
)
def detector_decision(spark, d):
    active = F.count_if(F.col("level") >= 0.2)
    return fx.frames(spark, d).where("level >= 0.01").groupBy("clip_id").agg(
        F.round(F.percentile("level", 0.95), 6).alias("p95"),
        F.round(F.max("level"), 6).alias("peak"),
        F.round(active / F.count("*"), 6).alias("active_share"),
        ((F.percentile("level", 0.95) >= 0.25) & (active >= 3)).alias("positive"),
    )


@register(
    "A14_clip_quality",
    f"""SELECT clip_id, round(20 * log10(sig / noise), 6) AS snr_db, CASE WHEN 20 * log10(sig / noise) >= 25 THEN 'Gold' WHEN 20 * log10(sig / noise) >= 15 THEN 'Silver' ELSE 'Review' END AS grade
    FROM (SELECT clip_id, greatest(0.001, quantile_cont(level, 0.85)) AS sig, greatest(0.001, quantile_cont(level, 0.1)) AS noise FROM {fx.FRAMES_SQL} GROUP BY clip_id)""",
)
def clip_quality(spark, d):
    q = lambda p: F.greatest(F.lit(0.001), F.percentile("level", p))
    snr = 20 * F.log10(F.col("s") / F.col("n"))
    out = fx.frames(spark, d).groupBy("clip_id").agg(q(0.85).alias("s"), q(0.1).alias("n"))
    return out.select("clip_id", F.round(snr, 6).alias("snr_db"), F.when(snr >= 25, "Gold").when(snr >= 15, "Silver").otherwise("Review").alias("grade"))


@register(
    "A16_modal_value",
    "SELECT source_id, kind FROM (SELECT source_id, kind, row_number() OVER (PARTITION BY source_id ORDER BY count(*) DESC, kind) AS r FROM " + SEG + " GROUP BY source_id, kind) WHERE r = 1",
)
def modal_value(spark, d):
    """The most frequent kind of each source; the first by name in a tie."""
    n = fx.segments(spark, d).groupBy("source_id", "kind").agg(F.count("*").alias("n"))
    return n.groupBy("source_id").agg(F.min_by("kind", F.struct(-F.col("n"), "kind")).alias("kind"))


@register("A17_label_sets", f"SELECT kind, count(CASE WHEN label = 'correct' THEN 1 END) AS positives, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM {REVIEWED} WHERE label IS NOT NULL GROUP BY kind")
def label_sets(spark, d):
    r = reviewed(spark, d).where("label is not null").groupBy("kind")
    return r.agg(F.count_if(F.col("label") == "correct").alias("positives"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))


@register(
    "A19_referential_checks",
    f"SELECT count(*) AS reviews, count(CASE WHEN s.segment_id IS NULL THEN 1 END) AS orphans FROM {REV} r LEFT JOIN (SELECT segment_id FROM {SEG} WHERE k % 4 <> 0) s USING (segment_id)",
)
def referential_checks(spark, d):
    known = fx.segments(spark, d).where("k % 4 <> 0").select("segment_id", F.lit(True).alias("known"))
    r = fx.reviews(spark, d).join(known, "segment_id", "left")
    return r.agg(F.count("*").alias("reviews"), F.count_if(F.col("known").isNull()).alias("orphans"))


@register(
    "A20_merge_report",
    f"""SELECT kind, count(*) AS n, count(*) - count(DISTINCT hash(seconds, value)) AS duplicates, round(min(value), 6) AS least, round(max(value), 6) AS most FROM {REVIEWED} GROUP BY kind""",
)
def merge_report(spark, d):
    r = reviewed(spark, d).groupBy("kind")
    return r.agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("seconds", "value")).alias("duplicates"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"))


@register(
    "W2_mid_rank_percentile",
    f"""SELECT segment_id, round((less + same / 2.0) / n, 6) AS percentile FROM (SELECT segment_id, rank() OVER (PARTITION BY kind ORDER BY value) - 1 AS less,
      count(*) OVER (PARTITION BY kind, value) AS same, count(*) OVER (PARTITION BY kind) AS n FROM {SEG})""",
)
def mid_rank_percentile(spark, d):
    """(less + equal / 2) / n within the kind, from counts of distinct values, summed up in ranges."""
    from cadenza.operators.evaluation import grouped_sums

    s = fx.segments(spark, d)
    p = grouped_sums(s.groupBy("kind", "value").agg(F.count("*").alias("same")), "kind", "value", ["same"])
    p = p.select("kind", "value", F.round((F.col("sum_same") - F.col("same") / 2) / F.col("total_same"), 6).alias("percentile"))
    return s.join(p, ["kind", "value"]).select("segment_id", "percentile")


@register(
    "W3_golden_top_three",
    f"""SELECT kind, segment_id, r FROM (SELECT kind, segment_id, CAST(row_number() OVER (PARTITION BY kind ORDER BY value DESC, segment_id) AS INTEGER) AS r
      FROM (SELECT s.*, q.q FROM {SEG} s JOIN (SELECT kind, quantile_cont(value, 0.95) AS q FROM {SEG} GROUP BY kind) q USING (kind)) WHERE value >= q) WHERE r <= 3""",
)
def golden_top_three(spark, d):
    from cadenza.operators.evaluation import group_quantiles

    s = fx.segments(spark, d)
    q = group_quantiles(s, "kind", "value", 0.95, "q")
    order = Window.partitionBy("kind").orderBy(F.desc("value"), "segment_id")
    return s.join(F.broadcast(q), "kind").where("value >= q").withColumn("r", F.row_number().over(order)).where("r <= 3").select("kind", "segment_id", "r")


@register(
    "W6_longest_pause",
    f"""SELECT clip_id, coalesce(max(CASE WHEN NOT flag THEN n END), 0) AS longest FROM (
      SELECT clip_id, run, any_value(flag) AS flag, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS run FROM (
        SELECT *, level >= 0.05 AS flag, CASE WHEN (level >= 0.05) = lag(level >= 0.05) OVER (PARTITION BY clip_id ORDER BY frame_idx) THEN 0 ELSE 1 END AS c,
        min(CASE WHEN level >= 0.05 THEN frame_idx END) OVER (PARTITION BY clip_id) AS a, max(CASE WHEN level >= 0.05 THEN frame_idx END) OVER (PARTITION BY clip_id) AS b FROM {fx.FRAMES_SQL})
        WHERE frame_idx BETWEEN a AND b) GROUP BY clip_id, run) GROUP BY clip_id""",
)
def longest_pause(spark, d):
    from cadenza.operators.intervals import runs

    f = fx.frames(spark, d)
    loud = f.where("level >= 0.05").groupBy("clip_id").agg(F.min("frame_idx").alias("a"), F.max("frame_idx").alias("b"))
    r = runs(f.join(loud, "clip_id").where("frame_idx between a and b"), ["clip_id"], "frame_idx", F.col("level") >= 0.05)
    n = r.groupBy("clip_id", "run").agg(F.first("flag").alias("flag"), F.count("*").alias("n"))
    return n.groupBy("clip_id").agg(F.coalesce(F.max(F.when(~F.col("flag"), F.col("n"))), F.lit(0)).alias("longest"))


@register(
    "W7_standardise",
    f"""SELECT segment_id, round(greatest(-4, least(4, (value - m) / greatest(1, s))), 6) AS z FROM {SEG}, (SELECT median(value) AS m, stddev_pop(value) AS s FROM {SEG})""",
)
def standardise(spark, d):
    from cadenza.operators.evaluation import quantile

    s = fx.segments(spark, d)
    middle = quantile(s, "value", 0.5)
    one = s.agg(F.stddev_pop("value").alias("s"))  # one row
    z = (F.col("value") - F.lit(middle)) / F.greatest(F.lit(1.0), F.col("s"))
    return s.join(F.broadcast(one)).select("segment_id", F.round(F.greatest(F.lit(-4.0), F.least(F.lit(4.0), z)), 6).alias("z"))


@register(
    "W8_adjacent_evidence",
    f"SELECT clip_id, round(min(greatest(level, nxt)), 6) AS evidence FROM (SELECT *, lead(level) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS nxt FROM {fx.FRAMES_SQL}) WHERE nxt IS NOT NULL GROUP BY clip_id",
)
def adjacent_evidence(spark, d):
    w = Window.partitionBy("clip_id").orderBy("frame_idx")
    f = fx.frames(spark, d).withColumn("nxt", F.lead("level").over(w)).where("nxt is not null")
    return f.groupBy("clip_id").agg(F.round(F.min(F.greatest("level", "nxt")), 6).alias("evidence"))


@register(
    "W11_prefix_pool",
    f"""SELECT clip_id, frame_idx, round((c - coalesce(lag(c, 8) OVER w, 0)) / least(8, frame_idx) + 1e-9, 4) AS mean FROM (SELECT *, sum(level) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS c FROM {fx.FRAMES_SQL})
    WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx)""",
)
def prefix_pool(spark, d):
    """Mean of the last eight frames from prefix sums: two lookups a span, whatever its length."""
    w = Window.partitionBy("clip_id").orderBy("frame_idx")
    f = fx.frames(spark, d).withColumn("c", F.sum("level").over(w))
    mean = (F.col("c") - F.coalesce(F.lag("c", 8).over(w), F.lit(0.0))) / F.least(F.lit(8), F.col("frame_idx"))
    return f.select("clip_id", "frame_idx", F.round(mean + 1e-9, 4).alias("mean"))


@register(
    "W13_neighbour_clamps",
    f"""SELECT segment_id, start_ms - max(end_ms) OVER (PARTITION BY source_id ORDER BY start_ms, segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_ms,
      min(start_ms) OVER (PARTITION BY source_id ORDER BY start_ms, segment_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - end_ms AS after_ms FROM {SEG}""",
)
def neighbour_clamps(spark, d):
    w = Window.partitionBy("source_id").orderBy("start_ms", "segment_id")
    before = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.lead("start_ms").over(w)  # starts ascend
    return fx.segments(spark, d).select("segment_id", (F.col("start_ms") - before).alias("before_ms"), (after - F.col("end_ms")).alias("after_ms"))


@register("T1_review_rank", f"SELECT segment_id, round(CASE WHEN k % 3 = 0 THEN value WHEN k % 5 <> 0 THEN value / 2 ELSE 0 END, 6) AS rank FROM {SEG}")
def review_rank(spark, d):
    a, b = F.when(F.col("k") % 3 == 0, F.col("value")).otherwise(F.lit(float("nan"))), F.when(F.col("k") % 5 != 0, F.col("value") / 2)
    return fx.segments(spark, d).select("segment_id", F.round(sc.first_finite(a, b, default=0.0), 6).alias("rank"))


@register("T2_information_rank", f"SELECT segment_id, round(CASE WHEN k % 2 = 0 THEN value / 100 ELSE -abs(value / 500 - 0.5) END, 6) AS information FROM {SEG}")
def information_rank(spark, d):
    info = F.coalesce(F.when(F.col("k") % 2 == 0, F.col("value") / 100), -F.abs(F.col("value") / 500 - 0.5))
    return fx.segments(spark, d).select("segment_id", F.round(info, 6).alias("information"))


@register(
    "T3_tier_b_rank",
    f"SELECT segment_id, round(0.65 * value / 500 + 0.15 * k / 100 + 0.05 * k / 50 + 0.15 * value / 1000 + CASE WHEN k % 5 = 0 THEN 0.05 ELSE 0 END - CASE WHEN k % 7 = 0 THEN 0.6 ELSE 0 END + 1e-9, 4) AS rank FROM {SEG}",
)
def tier_b_rank(spark, d):
    v, k = F.col("value"), F.col("k").cast("double")
    return fx.segments(spark, d).select("segment_id", F.round(sc.tier_b_rank(v / 500, k / 100, k / 50, v / 1000, F.col("k") % 5 == 0, F.col("k") % 7 == 0) + 1e-9, 4).alias("rank"))


@register(
    "T9_top_k_mean",
    f"SELECT source_id, round(avg(value), 6) AS top2 FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY value DESC) AS r FROM {SEG}) WHERE r <= 2 GROUP BY source_id",
)
def top_k_mean(spark, d):
    order = Window.partitionBy("source_id").orderBy(F.desc("value"))
    top = fx.segments(spark, d).withColumn("r", F.row_number().over(order)).where("r <= 2")
    return top.groupBy("source_id").agg(F.round(F.avg("value"), 6).alias("top2"))


@register("T10_newest_first", f"SELECT source_id, max(start_ms) AS newest, CAST(rank() OVER (ORDER BY max(start_ms) DESC, source_id) AS INTEGER) AS place FROM {SEG} GROUP BY source_id")
def newest_first(spark, d):
    from cadenza.operators.evaluation import running_sums

    s = fx.segments(spark, d).groupBy("source_id").agg(F.max("start_ms").alias("newest"))
    s = s.withColumns({"order": F.struct(-F.col("newest"), "source_id"), "one": F.lit(1)})
    return running_sums(s, "order", ["one"]).select("source_id", "newest", F.col("sum_one").cast("int").alias("place"))


@register(
    "T11_round_robin",
    f"""SELECT segment_id FROM (SELECT segment_id, kind, label, row_number() OVER (PARTITION BY kind, label ORDER BY segment_id) AS r FROM {REVIEWED} WHERE label IS NOT NULL)
    ORDER BY r, kind, label LIMIT 256""",
)
def round_robin(spark, d):
    """A bounded sample, taken in turn from each (kind, label): the limit is the feature."""
    order = Window.partitionBy("kind", "label").orderBy("segment_id")
    r = reviewed(spark, d).where("label is not null").withColumn("r", F.row_number().over(order)).where("r <= 256")
    return r.orderBy("r", "kind", "label").limit(256).select("segment_id")


@register("U1_union_dedupe", f"SELECT DISTINCT source_id, k FROM (SELECT source_id, k FROM {SEG} WHERE kind = 'click' UNION ALL SELECT source_id, k FROM {SEG} WHERE kind = 'view')")
def union_dedupe(spark, d):
    pick = lambda k: fx.segments(spark, d, k).select("source_id", "k")
    return pick("click").unionByName(pick("view")).dropDuplicates(["source_id", "k"])


@register("U3_except_keys", f"SELECT segment_id FROM {SEG} EXCEPT SELECT segment_id FROM {REV}")
def except_keys(spark, d):
    return fx.segments(spark, d).select("segment_id").join(fx.reviews(spark, d).select("segment_id"), "segment_id", "left_anti")


@register(
    "U4_token_coverage",
    f"""SELECT source_id, count(DISTINCT k) FILTER (kind = 'click' AND k NOT IN (SELECT k FROM {SEG} v WHERE v.kind = 'view' AND v.source_id = s.source_id)) AS only_click FROM {SEG} s GROUP BY source_id""",
)
def token_coverage(spark, d):
    sets = fx.segments(spark, d).groupBy("source_id").agg(
        F.collect_set(F.when(F.col("kind") == "click", F.col("k"))).alias("a"), F.collect_set(F.when(F.col("kind") == "view", F.col("k"))).alias("b")
    )
    return sets.select("source_id", F.size(F.array_except("a", "b")).cast("long").alias("only_click"))


@register(
    "D1_exact_content",
    """SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS first_id FROM documents) WHERE doc_id <> first_id""",
)
def exact_content(spark, d):
    """Copies with the document they repeat.  Winners come from an aggregate with map-side
    combine, so a hot text costs a row a task; the join back splits hot keys at run time."""
    docs = fx.table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return docs.join(first, "h").where("doc_id <> first_id").select("doc_id", "first_id")


@register(
    "D5_gain_invariant_print",
    """SELECT print, count(*) AS n FROM (SELECT vec_id, sha256(array_to_string(list_transform(embedding, lambda x: CAST(round_even(greatest(-8, least(8, x / r)) * 8, 0) AS BIGINT)), ',')) AS print
    FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) / 64) AS r FROM embeddings)) GROUP BY print""",
)
def gain_invariant_print(spark, d):
    from cadenza.functions.vectors import doubles, let, norm

    v = doubles("embedding")
    rms = norm("embedding") / F.sqrt(F.size("embedding"))
    ticks = let(rms, lambda r: F.transform(v, lambda x: F.bround(F.greatest(F.lit(-8.0), F.least(F.lit(8.0), x / r)) * 8).cast("long").cast("string")))
    e = fx.table(spark, d, "embeddings").select(F.sha2(F.array_join(ticks, ",").cast("binary"), 256).alias("print"))
    return e.groupBy("print").agg(F.count("*").alias("n"))


@register(
    "D6_role_conflicts",
    f"SELECT source_id, k, count(DISTINCT kind) AS roles, count(DISTINCT kind) > 1 AS conflict FROM {SEG} GROUP BY source_id, k HAVING count(*) > 1",
)
def role_conflicts(spark, d):
    g = fx.segments(spark, d).groupBy("source_id", "k").agg(F.count_distinct("kind").alias("roles"), F.count("*").alias("n"))
    return g.where("n > 1").select("source_id", "k", "roles", (F.col("roles") > 1).alias("conflict"))


@register("D8_compute_once", "SELECT e.event_id, round(ln(1 + e.value), 6) AS feature FROM events e")
def compute_once(spark, d):
    """The costly function runs on distinct inputs only and fans out again."""
    e = fx.table(spark, d, "events").select("event_id", "value")
    once = e.select("value").distinct().withColumn("feature", F.round(F.log1p("value"), 6))
    return e.join(once, "value").select("event_id", "feature")


@register(
    "X23_sample_weights",
    f"SELECT segment_id, CASE WHEN label = 'partial' AND k % 4 = 0 THEN 2.0 WHEN label = 'partial' THEN 1.5 ELSE 1.0 END AS weight FROM {REVIEWED} WHERE label IS NOT NULL",
)
def sample_weights(spark, d):
    y = F.when(F.col("k") % 4 == 0, 0).otherwise(1)
    return reviewed(spark, d).where("label is not null").select("segment_id", sc.sample_weight(y, F.col("label") == "partial").alias("weight"))


@register("X19_cohort_probability", f"SELECT segment_id, round(CASE WHEN k % 9 = 0 THEN 0.5 ELSE 1 / (1 + exp(-(value / 50 - 1.5) * 1.2)) END, 6) AS p FROM {SEG}")
def cohort_probability(spark, d):
    z = F.when(F.col("k") % 9 != 0, F.col("value") / 50)
    return fx.segments(spark, d).select("segment_id", F.round(sc.cohort_probability(z), 6).alias("p"))


EVAL = f"(SELECT segment_id, source_id, value AS score, value / 2 + k AS old, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS y FROM {SEG})"


def evaluation(spark, d):
    s = fx.segments(spark, d)
    return s.select("segment_id", "source_id", F.col("value").alias("score"), (F.col("value") / 2 + F.col("k")).alias("old"), F.when(F.col("k") % 3 == 0, 1).otherwise(0).alias("y"))


@register(
    "E1_rank_auc",
    f"""SELECT round((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - p * (p + 1) / 2.0) / (p * n), 6) AS auc, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp / p + (n - fp) / n) / 2, 6) AS balanced
    FROM (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM {EVAL}),
    (SELECT sum(y) AS p, sum(1 - y) AS n, sum(CASE WHEN score >= 30 THEN y ELSE 0 END) AS tp, sum(CASE WHEN score >= 30 THEN 1 - y ELSE 0 END) AS fp, sum(CASE WHEN score < 30 THEN y ELSE 0 END) AS fn FROM {EVAL})
    GROUP BY p, n, tp, fp, fn""",
)
def rank_auc(spark, d):
    from cadenza.operators.evaluation import classification_metrics

    return classification_metrics(evaluation(spark, d), "score", "y", 30.0)


@register(
    "E2_paired_audit",
    f"""SELECT count(CASE WHEN y = 1 AND old >= 60 AND score < 30 THEN 1 END) AS lost, count(CASE WHEN y = 0 AND old < 60 AND score >= 30 THEN 1 END) AS new_errors,
      count(CASE WHEN y = 1 AND old < 60 AND score >= 30 THEN 1 END) AS recovered, count(CASE WHEN y = 0 AND old >= 60 AND score < 30 THEN 1 END) AS removed FROM {EVAL}""",
)
def paired_audit(spark, d):
    e, now, was = evaluation(spark, d), F.col("score") >= 30, F.col("old") >= 60
    y = F.col("y") == 1
    return e.agg(
        F.count_if(y & was & ~now).alias("lost"), F.count_if(~y & ~was & now).alias("new_errors"), F.count_if(y & ~was & now).alias("recovered"), F.count_if(~y & was & ~now).alias("removed")
    )


@register(
    "E4_holdout_order",
    f"SELECT source_id, CAST(row_number() OVER (ORDER BY h) AS INTEGER) AS place, positives, n FROM (SELECT source_id, sha256(CAST(source_id AS VARCHAR)) AS h, sum(y)::BIGINT AS positives, count(*) AS n FROM {EVAL} GROUP BY source_id)",
)
def holdout_order(spark, d):
    from cadenza.operators.evaluation import running_sums

    g = evaluation(spark, d).groupBy("source_id").agg(F.sum("y").cast("long").alias("positives"), F.count("*").alias("n"))
    g = g.withColumns({"h": F.sha2(F.col("source_id").cast("string").cast("binary"), 256), "one": F.lit(1)})
    return running_sums(g, "h", ["one"]).select("source_id", F.col("sum_one").cast("int").alias("place"), "positives", "n")


@register(
    "E8_weighted_log_loss",
    f"SELECT round(sum(w * -(y * ln(p) + (1 - y) * ln(1 - p))) / sum(w), 6) AS loss FROM (SELECT y, CASE WHEN y = 1 THEN 1.5 ELSE 1.0 END AS w, greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-(score - 30) / 20)))) AS p FROM {EVAL})",
)
def weighted_log_loss(spark, d):
    e = evaluation(spark, d)
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), 1 / (1 + F.exp(-(F.col("score") - 30) / 20))))
    e = e.select("y", F.when(F.col("y") == 1, 1.5).otherwise(1.0).alias("w"), p.alias("p"))
    loss = -(F.col("y") * F.log("p") + (1 - F.col("y")) * F.log(1 - F.col("p")))
    return e.agg(F.round(F.sum(F.col("w") * loss) / F.sum("w"), 6).alias("loss"))


@register(
    "W4_roc_points",
    f"""SELECT score, CAST(sum(p) OVER (ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(n) OVER (ORDER BY score DESC) AS BIGINT) AS fp FROM (SELECT score, sum(y) AS p, sum(1 - y) AS n FROM {EVAL} GROUP BY score)""",
)
def roc_points(spark, d):
    from cadenza.operators.evaluation import roc_curve

    return roc_curve(evaluation(spark, d), "score", "y")
