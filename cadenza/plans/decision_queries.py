"""Queries of decision rules over evidence that range joins bring to each row.

Windows are views, frames are merged views, rows to judge are clicks; their scores are functions of
the events' values and keys.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions import decisions as de
from cadenza.functions import vectors as vf
from cadenza.operators import intervals as iv
from cadenza.plans.catalogue import register
from cadenza.plans.sql import BUY, CLICK, ERR, SHARED, VIEW, merged, pairs
from cadenza.plans.vector_queries import VEC, vectors
from cadenza.sources import fixtures as fx

HOUR = 3_600_000
ID = ["segment_id", "source_id", "start_ms", "end_ms"]
#: Scores of windows: two channels, cohort margins, a classifier's score.
SCORES = {"p": "value / 150", "s": "k / CAST(100 AS DOUBLE)", "cm_p": "(value - 15) / 300", "cm_s": "(k - 20) / CAST(200 AS DOUBLE)", "accepted": "value >= 8", "smoothed": "k < 3", "voiced": "k >= 5", "score": "value / 40 - 5"}
WINDOWS = f"(SELECT segment_id, source_id, start_ms, end_ms, {', '.join(f'{x} AS {n}' for n, x in SCORES.items())} FROM {VIEW})"
LEAST = HOUR


def rows(spark, d, kind="click"):
    return fx.segments(spark, d, kind).select(*ID, "k", "value")


def windows(spark, d):
    return rows(spark, d, "view").select(*ID, *[F.expr(x).alias(n) for n, x in SCORES.items()])


def over_windows(spark, d, **aggs):
    """Each click with aggregates over the windows that it shares over an hour with."""
    return iv.per_row(rows(spark, d), windows(spark, d), ("source_id",), lambda hit: [a(hit).alias(n) for n, a in aggs.items()], LEAST)


def when(agg, column):
    """An aggregate over the windows that count."""
    return lambda hit: agg(F.when(hit, F.col(f"b_{column}") if isinstance(column, str) else column))


count = lambda cond: (lambda hit: F.count_if(hit & cond))
seconds = lambda: (F.col("end_ms") - F.col("start_ms")) / 36_000_000.0
WIN = f"(SELECT x.segment_id, count(*) AS n, count(*) FILTER (accepted AND NOT smoothed) AS good, min(p) AS min_p, min(s) AS min_s, avg(p) AS mean_p, avg(s) AS mean_s, min(cm_p) AS cm_p, min(cm_s) AS cm_s, avg(cm_p) AS cohort FROM {pairs(CLICK, WINDOWS, LEAST)} GROUP BY x.segment_id)"
SECS = "(end_ms - start_ms) / CAST(36000000 AS DOUBLE)"


@register(
    "F20_dialogue_path",
    f"""SELECT segment_id, CASE WHEN n IS NULL OR good < n THEN NULL WHEN ps >= 0.08 - 1e-9 AND ss >= -0.02 - 1e-9 AND cm_p >= 0.09 AND cm_s >= 0.14 THEN 'A_dual_cohort'
      WHEN strong AND ps >= 0.05 - 1e-9 AND ss >= -0.02 - 1e-9 AND cm_p >= 0.08 AND cm_s >= 0.10 THEN 'B_three_channel'
      WHEN sec >= 1.85 AND ps >= 0.04 - 1e-9 AND ss >= 0.02 - 1e-9 AND cohort >= 0.08 THEN 'C_stable_dialogue'
      WHEN ps >= 0.08 - 1e-9 AND ss >= -0.045 - 1e-9 AND (strong AND cm_p >= 0.10 AND cm_s >= 0.25 OR cm_p >= 0.20 AND cm_s >= 0.25) THEN 'D_cohort_dominant'
      WHEN sec BETWEEN 1.05 AND 3.0 AND dist <= 20 AND ps >= 0.03 - 1e-9 AND ss >= -0.04 - 1e-9 AND cm_p >= 0.08 AND cm_s >= 0.15 THEN 'E_scene_dialogue' END AS path
    FROM (SELECT c.segment_id, w.*, {SECS} AS sec, value / 150 - 0.1 AS ps, k / CAST(100 AS DOUBLE) - 0.1 AS ss, value >= 40 AS strong,
      (start_ms - lag(end_ms) OVER (PARTITION BY source_id ORDER BY start_ms, c.segment_id)) / CAST({HOUR} AS DOUBLE) AS dist FROM {CLICK} c LEFT JOIN {WIN} w USING (segment_id))""",
)
def dialogue_path(spark, d):
    """The certificate that all windows of a row earn it; a scene is near if it ended in 20 hours."""
    g = over_windows(spark, d, n=count(F.lit(True)), good=count(F.col("b_accepted") & ~F.col("b_smoothed")), cm_p=when(F.min, "cm_p"), cm_s=when(F.min, "cm_s"), cohort=when(F.avg, "cm_p"))
    before = F.lag("end_ms").over(Window.partitionBy("source_id").orderBy("start_ms", "segment_id"))
    g = g.withColumn("dist", (F.col("start_ms") - before) / float(HOUR))
    passed = (F.col("n") > 0) & (F.col("good") == F.col("n"))
    path = de.dialogue_path(passed, seconds(), F.col("value") / 150 - 0.1, F.col("k") / 100.0 - 0.1, F.col("cm_p"), F.col("cm_s"), F.col("value") >= 40, F.col("cohort"), F.col("dist"))
    return g.select("segment_id", path.alias("path"))


@register(
    "F28_clean_core_certificate",
    f"""SELECT segment_id, min_p >= 0.06 + 0.05 AND min_s >= 0.05 + 0.02 AND cm_p >= 0.08 AND cm_s >= 0.08 OR min_p >= 0.06 + 0.14 AND min_s >= 0.05 - 0.02 AND cm_p >= 0.12 AND cm_s >= 0.20 AND value >= 40
      OR min_p >= 0.06 AND min_s >= 0.05 AND mean_p >= 0.06 + 0.04 AND mean_s >= 0.05 + 0.04 AND cm_p >= 0.15 AND cm_s >= 0.25 AS certified FROM {CLICK} JOIN {WIN} USING (segment_id) WHERE good > 0""",
)
def clean_core_certificate(spark, d):
    g = over_windows(
        spark, d, good=count(F.col("b_accepted") & ~F.col("b_smoothed")), min_p=when(F.min, "p"), min_s=when(F.min, "s"), mean_p=when(F.avg, "p"), mean_s=when(F.avg, "s"), cm_p=when(F.min, "cm_p"), cm_s=when(F.min, "cm_s")
    ).where("good > 0")
    c = de.clean_core(*[F.col(x) for x in ("min_p", "min_s", "mean_p", "mean_s", "cm_p", "cm_s")], F.col("value") >= 40, 0.06, 0.05)
    return g.select("segment_id", c.alias("certified"))


VETO = f"(SELECT x.segment_id, count(*) FILTER (voiced) AS relevant, count(*) FILTER (voiced AND score <= -4.24) AS neg, count(*) FILTER (voiced AND score <= -4.24 + 1) AS near FROM {pairs(CLICK, WINDOWS, LEAST - 1)} GROUP BY x.segment_id)"
VETOED = "coalesce(neg, 0) >= 2 OR (sec <= 3 AND value < 30 AND coalesce(near, 0) >= 3 AND near >= 0.75 * relevant)"


def vetoes(spark, d):
    """Clicks with counts of voiced windows that share an hour or more, those that reject, and those near it."""
    low = lambda t: F.col("b_voiced") & (F.col("b_score") <= t)
    aggs = lambda hit: [F.count_if(hit & F.col("b_voiced")).alias("relevant"), F.count_if(hit & low(-4.24)).alias("neg"), F.count_if(hit & low(-4.24 + 1)).alias("near")]
    g = iv.per_row(rows(spark, d), windows(spark, d), ("source_id",), aggs, LEAST - 1)
    return g.withColumn("veto", de.classifier_veto(F.col("neg"), F.col("near"), F.col("relevant"), F.col("value") < 30, seconds() <= 3))


@register("F25_classifier_audit_veto", f"SELECT segment_id, {VETOED} AS veto FROM (SELECT *, {SECS} AS sec FROM {CLICK} LEFT JOIN {VETO} USING (segment_id))")
def classifier_audit_veto(spark, d):
    """Rows of low value are those that the audit rejected; near windows count in short rows."""
    return vetoes(spark, d).select("segment_id", "veto")


CERT = merged(BUY)


@register(
    "F6_confident_borderline",
    f"""SELECT s.segment_id FROM (SELECT *, {SECS} AS sec FROM {CLICK} LEFT JOIN {VETO} USING (segment_id)) s WHERE value < 80 AND NOT ({VETOED}) AND s.segment_id NOT IN (SELECT x.segment_id FROM {pairs(CLICK, ERR)})
    AND (value / 60 >= 1.38 OR k / CAST(100 AS DOUBLE) >= 0.70 OR EXISTS (SELECT 1 FROM {CERT} c WHERE c.source_id = s.source_id AND c.start_ms <= s.start_ms AND c.end_ms >= s.end_ms))""",
)
def confident_borderline(spark, d):
    """Rows of tier B (value under 80) that no window, conflict or error speaks against, and that a
    certificate covers whole, or that rank high."""
    within = lambda hit: [F.max(hit & (F.col("b_start_ms") <= F.col("start_ms")) & (F.col("b_end_ms") >= F.col("end_ms"))).alias("covered")]
    g = iv.per_row(vetoes(spark, d), iv.merge(rows(spark, d, "purchase")), ("source_id",), within)
    g = iv.per_row(g, rows(spark, d, "error"), ("source_id",), lambda hit: [F.max(hit).alias("conflict")])
    tier = F.when(F.col("value") < 80, "B").otherwise("A")
    keep = de.confident_borderline(tier, F.col("veto") | de.yes(F.col("conflict")), F.lit(False), F.col("covered"), F.col("value") / 60, F.col("k") / 100.0)
    return g.where(keep).select("segment_id")


@register(
    "F24_rescue_tiers",
    f"""SELECT segment_id, CASE WHEN coalesce(n, 0) > 0 AND k >= 50 THEN CASE WHEN good = n THEN 'A' ELSE 'B' END WHEN ({VETOED}) OR segment_id IN (SELECT x.segment_id FROM {pairs(CLICK, ERR)}) THEN 'B'
      WHEN coalesce(n, 0) > 0 AND good = n AND min_p >= 0.15 AND min_s >= 0.3 THEN 'A' WHEN value < 20 THEN CASE WHEN lowest > 0 AND lowest < 0.56 THEN 'B' ELSE 'A' END
      WHEN k / CAST(100 AS DOUBLE) < 0.1 + 0.04 OR (lowest > 0 AND lowest < 0.62) THEN 'B' ELSE 'A' END AS tier
    FROM (SELECT *, {SECS} AS sec, min_p * 3 AS lowest FROM {CLICK} LEFT JOIN {VETO} USING (segment_id) LEFT JOIN {WIN} USING (segment_id))""",
)
def rescue_tiers(spark, d):
    """Windows are interval evidence for rows with k from 50 on; for the others they are scores."""
    g = iv.per_row(
        vetoes(spark, d), windows(spark, d), ("source_id",),
        lambda hit: [F.count_if(hit).alias("n"), F.count_if(hit & F.col("b_accepted") & ~F.col("b_smoothed")).alias("good"), F.min(F.when(hit, F.col("b_p"))).alias("min_p"), F.min(F.when(hit, F.col("b_s"))).alias("min_s")], LEAST,
    )
    g = iv.per_row(g, rows(spark, d, "error"), ("source_id",), lambda hit: [F.max(hit).alias("conflict")])
    clean = F.col("good") == F.col("n")
    strong = (F.col("n") > 0) & clean & (F.col("min_p") >= 0.15) & (F.col("min_s") >= 0.3)
    observed = F.when(F.col("k") >= 50, F.col("n")).otherwise(0)
    tier = de.rescue_tier(observed, clean, F.col("veto"), F.col("conflict"), strong, F.col("value") >= 20, F.col("min_p") * 3, F.col("k") / 100.0, F.lit(0.1))
    return g.select("segment_id", tier.alias("tier"))


COVER = f"(SELECT x.segment_id, sum({SHARED}) AS c FROM {pairs(CLICK, merged(VIEW))} GROUP BY x.segment_id)"


@register(
    "F26_positive_fine_review",
    f"""SELECT segment_id FROM {CLICK} JOIN {COVER} USING (segment_id) JOIN (SELECT x.segment_id, avg(CASE WHEN y.score > -4.8 THEN 1.0 ELSE 0.0 END) AS pos, avg(y.score + 5) AS mean, stddev_pop(y.score) / sqrt(count(*)) AS err, max(y.score) > -2.4 AS dirty, bool_or(NOT y.voiced) AS conflict
      FROM {pairs(CLICK, WINDOWS)} GROUP BY x.segment_id) USING (segment_id) WHERE {SECS} >= 0.5 - 1e-9 AND value < 45 AND segment_id NOT IN (SELECT x.segment_id FROM {pairs(CLICK, ERR)}) AND NOT conflict AND NOT dirty
      AND c / CAST(end_ms - start_ms AS DOUBLE) >= 0.75 AND pos >= 0.75 AND mean > 2 * err""",
)
def positive_fine_review(spark, d):
    g = iv.covered_length(rows(spark, d), windows(spark, d))
    aggs = lambda hit: [
        F.avg(F.when(hit, F.when(F.col("b_score") > -4.8, 1.0).otherwise(0.0))).alias("pos"), F.avg(F.when(hit, F.col("b_score") + 5)).alias("mean"),
        (F.stddev_pop(F.when(hit, F.col("b_score"))) / F.sqrt(F.count_if(hit))).alias("err"), (F.max(F.when(hit, F.col("b_score"))) > -2.4).alias("dirty"), (F.count_if(hit & ~F.col("b_voiced")) > 0).alias("conflict"),
    ]
    g = iv.per_row(g, windows(spark, d), ("source_id",), aggs)
    g = iv.overlap_sum(g, rows(spark, d, "error"))
    length = F.col("end_ms") - F.col("start_ms")
    keep = de.keep_for_review(seconds(), 0.5, F.col("value") >= 45, F.col("overlap_ms") / length, F.col("conflict"), F.col("dirty"), F.col("covered_ms") / length, F.col("pos"), F.col("mean"), F.col("err"))
    return g.where(keep).select("segment_id")


FRAMES = merged(VIEW, 0, ", max(value) AS top, avg(value) AS mean, count(*) AS n")
INSIDE = f"(SELECT x.segment_id, max(y.top) >= 95 AS dirty, sum({SHARED}) AS c, count(*) FILTER (y.n > 1) AS seen, count(*) FILTER (y.n > 1 AND y.mean < 12) AS weak, count(*) FILTER (y.n = 1 AND y.top < 3) AS unsure FROM {pairs(CLICK, FRAMES)} GROUP BY x.segment_id)"


@register(
    "F13_span_assessment",
    f"""SELECT segment_id, CASE WHEN hard OR dirty THEN 'rejected' WHEN said <> '' THEN 'unresolved' ELSE 'accepted' END AS state, CASE WHEN hard OR dirty THEN 'local_contamination' WHEN said <> '' THEN said ELSE 'acoustically_verified' END AS reasons FROM (
      SELECT c.segment_id, coalesce(dirty, false) AS dirty, c.segment_id IN (SELECT x.segment_id FROM {pairs(CLICK, ERR)} AND y.k >= 30) AS hard, concat_ws(',', CASE WHEN coalesce(c, 0) <> end_ms - start_ms THEN 'missing_temporal_coverage' END,
        CASE WHEN coalesce(seen, 0) = 0 THEN 'no_observable_identity' END, CASE WHEN coalesce(weak, 0) > 0 OR coalesce(unsure, 0) > 0 OR c.segment_id IN (SELECT x.segment_id FROM {pairs(CLICK, ERR)} AND y.k < 30) THEN 'local_identity_unresolved' END,
        CASE WHEN value < 5 THEN 'span_purity_unresolved' END, CASE WHEN k < 2 OR k > 97 THEN 'acoustic_boundary_incomplete' END) AS said FROM {CLICK} c LEFT JOIN {INSIDE} i USING (segment_id))""",
)
def span_assessment(spark, d):
    """Frames are merged views; errors with k from 30 on are hard evidence, the others uncertain."""
    frames = iv.merge(rows(spark, d, "view"), ("source_id",), 0, F.max("value").alias("top"), F.avg("value").alias("mean"), F.count("*").alias("n"))
    seen = F.col("b_n") > 1
    aggs = lambda hit: [
        F.max(F.when(hit, F.col("b_top") >= 95)).alias("dirty"), F.coalesce(F.sum(F.when(hit, iv.shared())), F.lit(0)).alias("covered"),
        F.count_if(hit & seen).alias("seen"), F.count_if(hit & seen & (F.col("b_mean") < 12)).alias("weak"), F.count_if(hit & ~seen & (F.col("b_top") < 3)).alias("unsure"),
    ]
    g = iv.per_row(rows(spark, d), frames, ("source_id",), aggs)
    kind = F.col("b_k") >= 30
    g = iv.per_row(g, rows(spark, d, "error"), ("source_id",), lambda hit: [F.max(hit & kind).alias("hard"), F.max(hit & ~kind).alias("doubt")])
    unresolved = (F.col("weak") > 0) | (F.col("unsure") > 0) | de.yes(F.col("doubt"))
    state, reasons = de.span_state(F.col("hard"), F.col("dirty"), F.col("covered") == F.col("end_ms") - F.col("start_ms"), F.col("seen") > 0, unresolved, F.col("value") >= 5, F.col("k").between(2, 97))
    return g.select("segment_id", state.alias("state"), F.array_join(reasons, ",").alias("reasons"))


@register(
    "A22_least_pass_ratio",
    f"""SELECT segment_id, round(min(r), 6) AS ratio FROM (SELECT x.segment_id, y.turn, avg(CASE WHEN y.accepted THEN 1.0 ELSE 0.0 END) AS r FROM {CLICK} x JOIN (SELECT t.source_id, t.start_ms, t.end_ms, t.segment_id AS turn, w.accepted FROM {BUY} t JOIN {WINDOWS} w
      ON w.source_id = t.source_id AND w.start_ms < t.end_ms AND w.end_ms > t.start_ms AND NOT w.smoothed) y ON y.source_id = x.source_id AND y.start_ms < x.end_ms AND y.end_ms > x.start_ms GROUP BY x.segment_id, y.turn) GROUP BY segment_id""",
)
def least_pass_ratio(spark, d):
    """Of the turns (purchases) that a row overlaps, the least share of accepted windows; uncertain
    windows don't count, and turns without any neither."""
    sure = lambda hit: hit & ~F.col("b_smoothed")
    turns = iv.per_row(rows(spark, d, "purchase"), windows(spark, d), ("source_id",), lambda hit: [F.count_if(sure(hit)).alias("n"), F.count_if(sure(hit) & F.col("b_accepted")).alias("ok")]).where("n > 0")
    turns = turns.select(*ID, (F.col("ok") / F.col("n")).alias("r"))
    p = iv.overlap_join(rows(spark, d), turns)
    return p.groupBy("segment_id").agg(F.round(F.min("b_r"), 6).alias("ratio"))


@register(
    "J7_independent_rows",
    f"""SELECT q.segment_id, (SELECT count(*) FROM {CLICK}) - count(DISTINCT b.segment_id) AS independent FROM {BUY} q LEFT JOIN (SELECT segment_id, source_id, start_ms, end_ms FROM {CLICK}
      UNION ALL SELECT x.segment_id, y.source_id, y.start_ms, y.end_ms FROM {pairs(CLICK, VIEW)}) b ON b.source_id = q.source_id AND b.start_ms < q.end_ms AND b.end_ms > q.start_ms GROUP BY q.segment_id""",
)
def independent_rows(spark, d):
    """For each purchase, the rows of the bank (clicks) whose own interval and whose supports, the
    views that they overlap, all leave it alone."""
    bank = rows(spark, d)
    supports = iv.overlap_join(bank.select(*ID), rows(spark, d, "view").select(*ID)).select("segment_id", "source_id", F.col("b_start_ms").alias("start_ms"), F.col("b_end_ms").alias("end_ms"))
    spans = bank.select(*ID).unionByName(supports).withColumnRenamed("segment_id", "bank_id")
    met = iv.overlap_join(rows(spark, d, "purchase").select(*ID), spans).select("segment_id", "b_bank_id").distinct()
    n = met.groupBy("segment_id").agg(F.count("*").alias("n"))
    total = bank.agg(F.count("*").alias("total"))  # one row
    joined = rows(spark, d, "purchase").select("segment_id").join(n, "segment_id", "left").crossJoin(F.broadcast(total))
    return joined.select("segment_id", (F.col("total") - F.coalesce("n", F.lit(0))).alias("independent"))


BOTH = f"(SELECT a.source_id, a.k, max(a.value) AS x, max(b.value) AS y FROM {CLICK} a JOIN {VIEW} b ON a.source_id = b.source_id AND a.k = b.k GROUP BY a.source_id, a.k)"


@register(
    "J33_diagonal_reference",
    f"""SELECT t.source_id, CASE WHEN strong > 0 THEN strong ELSE weak END AS support, round(CASE WHEN strong > 0 THEN best WHEN weak > 0 THEN least(mx, my) ELSE 0 END, 6) AS best FROM (
      SELECT source_id, count(*) FILTER (x >= 60 AND y >= 60) AS strong, max(CASE WHEN x >= 60 AND y >= 60 THEN least(x, y) END) AS best, count(*) FILTER (x >= 45 AND y >= 45) AS weak FROM {BOTH} GROUP BY source_id) t
    JOIN (SELECT source_id, max(value) AS mx FROM {CLICK} GROUP BY source_id) USING (source_id) JOIN (SELECT source_id, max(value) AS my FROM {VIEW} GROUP BY source_id) USING (source_id)""",
)
def diagonal_reference(spark, d):
    """References at both floors, else at floors lowered by 15 with the least of both maxima."""
    side = lambda kind, name: rows(spark, d, kind).groupBy("source_id", "k").agg(F.max("value").alias(name))
    a, b = side("click", "x"), side("view", "y")
    both = a.join(b, ["source_id", "k"], "full")
    at = lambda f: (F.col("x") >= f) & (F.col("y") >= f)
    g = both.groupBy("source_id").agg(
        F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("common"), F.count_if(at(60)).alias("strong"), F.max(F.when(at(60), F.least("x", "y"))).alias("best"), F.count_if(at(45)).alias("weak"), F.max("x").alias("mx"), F.max("y").alias("my")
    ).where("common > 0")
    best = F.when(F.col("strong") > 0, F.col("best")).when(F.col("weak") > 0, F.least("mx", "my")).otherwise(0.0)
    return g.select("source_id", F.when(F.col("strong") > 0, F.col("strong")).otherwise(F.col("weak")).alias("support"), F.round(best, 6).alias("best"))


def _centre(part: str, parity: int) -> str:
    return f"(SELECT role, [{', '.join(f'avg({part}[{i}])' for i in range(1, 33))}] AS c FROM {VEC} WHERE vec_id % 2 = {parity} GROUP BY role)"


def _view(variant: str, channel: str) -> str:
    part = f'v."{variant}"'
    c = _centre(f'"{variant}"', 0 if channel == "stem" else 1)
    score = f"round(list_cosine_similarity({part}, c.c), 9)"
    return f"""SELECT o.vec_id, '{variant}' AS variant, '{channel}' AS channel, o.s - n.s AS margin, n.role FROM (SELECT vec_id, {score} AS s FROM {VEC} v JOIN {c} c USING (role)) o
      JOIN (SELECT vec_id, max(s) AS s, CAST(arg_max(role, s) AS BIGINT) AS role FROM (SELECT v.vec_id, c.role, {score} AS s FROM {VEC} v JOIN {c} c ON c.role <> v.role) GROUP BY vec_id) n USING (vec_id)"""


VIEWS = "(" + " UNION ALL ".join(_view(v, c) for v in ("primary", "secondary") for c in ("stem", "raw")) + ")"
STATES = f"""(SELECT vec_id, CASE WHEN count(*) FILTER (margin > 0) >= 2 AND count(*) FILTER (margin > 0 AND channel = 'stem') > 0 THEN 'target_supported'
  WHEN count(*) FILTER (channel = 'stem' AND margin < 0) = 2 AND min(CASE WHEN channel = 'stem' THEN role END) = max(CASE WHEN channel = 'stem' THEN role END)
    AND count(*) FILTER (channel = 'raw' AND margin < 0 AND role = st) > 0 THEN 'other_supported' ELSE 'unresolved' END AS state, min(margin) AS low, max(margin) AS high
  FROM (SELECT *, min(CASE WHEN channel = 'stem' THEN role END) OVER (PARTITION BY vec_id) AS st FROM {VIEWS}) GROUP BY vec_id)"""


def views(spark, d):
    """Each vector's margin to the best other role and that role, in two variants against the
    centroids of even (stem) and odd (raw) vectors, which are one row a role."""
    v = vectors(spark, d)
    out = None
    for variant in ("primary", "secondary"):
        for channel, parity in (("stem", 0), ("raw", 1)):
            c = F.broadcast(v.where(F.col("vec_id") % 2 == parity).groupBy("role").agg(vf.mean_vector(variant, 32).alias("c")).withColumnRenamed("role", "other"))
            s = v.crossJoin(c).select("vec_id", "role", "other", F.round(vf.cosine(variant, "c"), 9).alias("s"))
            rival = F.when(F.col("other") != F.col("role"), F.struct("s", (-F.col("other")).alias("o")))
            one = s.groupBy("vec_id").agg(F.max(F.when(F.col("other") == F.col("role"), F.col("s"))).alias("own"), F.max(rival).alias("n"))
            one = one.select("vec_id", F.lit(variant).alias("variant"), F.lit(channel).alias("channel"), (F.col("own") - F.col("n.s")).alias("margin"), (-F.col("n.o")).cast("long").alias("role"))
            out = one if out is None else out.unionByName(one)
    return out.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("variant", "channel", "margin", "role"))).alias("views"))


@register("F22_four_view_state", f"SELECT vec_id, state FROM {STATES}")
def four_view_state(spark, d):
    return views(spark, d).select("vec_id", de.four_view_state(F.col("views")).alias("state"))


@register("F21_strong_islands", f"SELECT vec_id FROM {STATES} WHERE state = 'target_supported' AND low > -0.02 AND vec_id NOT IN (SELECT v.vec_id FROM {VEC} v WHERE list_dot_product(v.\"primary\", v.secondary) < -0.2)")
def strong_islands(spark, d):
    """Vectors no more than 0.02 behind in any of four views whose halves don't point apart, which is the
    exclusion here."""
    apart = vectors(spark, d).select("vec_id", (vf.dot("primary", "secondary") < -0.2).alias("rejected"))
    g = views(spark, d).join(apart, "vec_id").withColumn("state", de.four_view_state(F.col("views")))
    margins = [F.get("views", i)["margin"] for i in range(4)]
    return g.where(de.strong_island(F.col("state"), F.col("rejected"), F.lit(False), margins, -0.02)).select("vec_id")


@register(
    "F17_local_witnesses",
    f"""SELECT vec_id, CASE WHEN high < 0 AND d < 0 THEN 'domain_all_four_and_production_primary_negative' WHEN high < 0 AND d < 0.1 THEN 'domain_all_four_and_production_exclusion_rejected' END AS witness
    FROM {STATES} JOIN (SELECT vec_id, list_dot_product("primary", secondary) AS d FROM {VEC}) USING (vec_id)""",
)
def local_witnesses(spark, d):
    """The production margin is the dot product of the halves, which rejects under 0.1."""
    own = vectors(spark, d).select("vec_id", vf.dot("primary", "secondary").alias("d"))
    g = views(spark, d).join(own, "vec_id")
    return g.select("vec_id", de.local_witness([F.get("views", i)["margin"] for i in range(4)], F.col("d"), F.col("d") < 0.1).alias("witness"))


@register(
    "F23_join_verdicts",
    f"""SELECT vec_id, CASE WHEN role = 9 OR n_role = 9 THEN 'singing_or_overlap' WHEN gap > 15000 THEN 'hard_silence_boundary' WHEN sim < -0.25 THEN 'confirmed_speaker_change' WHEN sim < -0.1 THEN 'whole_span_not_verified'
      WHEN state <> 'target_supported' OR n_state <> 'target_supported' THEN 'local_identity_unresolved' ELSE 'independent_local_target_support' END AS verdict FROM (
      SELECT vec_id, role, state, lead(role) OVER w AS n_role, lead(state) OVER w AS n_state, lead(start_ms) OVER w - start_ms AS gap, list_dot_product("primary", lead("primary") OVER w) AS sim
      FROM {VEC} JOIN {STATES} USING (vec_id) WINDOW w AS (PARTITION BY source_id ORDER BY start_ms, vec_id)) WHERE n_role IS NOT NULL""",
)
def join_verdicts(spark, d):
    """Whether neighbours of a source may join: role 9 contaminates, and how alike they are says
    whether the voice changed and whether the whole is verified."""
    state = views(spark, d).select("vec_id", de.four_view_state(F.col("views")).alias("state"))
    w = Window.partitionBy("source_id").orderBy("start_ms", "vec_id")
    g = vectors(spark, d).join(state, "vec_id").withColumns({f"n_{c}": F.lead(c).over(w) for c in ("role", "state", "start_ms", "primary")}).where("n_role is not null")
    sim = vf.dot("primary", "n_primary")
    verdict = de.join_verdict((F.col("role") == 9) | (F.col("n_role") == 9), F.col("n_start_ms") - F.col("start_ms") <= 15000, sim < -0.25, sim >= -0.1, F.col("state"), F.col("n_state"))
    return g.select("vec_id", verdict.alias("verdict"))


GAPS = f"(SELECT vec_id, list(margin ORDER BY variant, channel) AS g, list(CASE WHEN channel = 'stem' THEN 1.0 ELSE 0.6 END ORDER BY variant, channel) AS w FROM {VIEWS} GROUP BY vec_id)"


@register(
    "V7_consensus",
    f"""SELECT vec_id, round(pooled, 6) AS margin, sup AS supporting, neg AS negative, neg <= 1 AND pooled >= 0.02 AND (opp = 0 OR sup >= 2 AND wmax < wmin) AS accepted FROM (
      SELECT vec_id, sum(m * w) / sum(w) AS pooled, CAST(count(*) FILTER (m >= 0.02) AS INTEGER) AS sup, CAST(count(*) FILTER (m < -0.02) AS INTEGER) AS neg, count(*) FILTER (m < 0.02) AS opp, max(CASE WHEN m < 0.02 THEN w END) AS wmax, min(CASE WHEN m >= 0.02 THEN w END) AS wmin
      FROM (SELECT vec_id, margin AS m, CASE WHEN channel = 'stem' THEN 1.0 ELSE 0.6 END AS w FROM {VIEWS}) GROUP BY vec_id)""",
)
def consensus(spark, d):
    """Margins of four views pooled, of which raw ones weigh 0.6."""
    g = views(spark, d)
    gaps, weights = F.transform("views", lambda v: v["margin"]), F.transform("views", lambda v: F.when(v["channel"] == "stem", 1.0).otherwise(0.6))
    g = g.select("vec_id", de.consensus(gaps, weights, 0.02).alias("c"))
    return g.select("vec_id", F.round("c.margin", 6).alias("margin"), "c.supporting", "c.negative", "c.accepted")


ALL = lambda part: f"(SELECT role, [{', '.join(f'avg({part}[{i}])' for i in range(1, 33))}] AS c FROM {VEC} GROUP BY role)"
ROLE = f"""(SELECT v.vec_id, v.role, p.role AS other, round(list_cosine_similarity(v."primary", p.c), 9) AS p, round(list_cosine_similarity(v.secondary, s.c), 9) AS s FROM {VEC} v, {ALL('"primary"')} p JOIN {ALL('secondary')} s USING (role))"""


def role_scores(spark, d):
    """(vec_id, role, other, p, s): each vector against all roles' centroids, one row a role."""
    v = vectors(spark, d)
    c = v.groupBy("role").agg(vf.mean_vector("primary", 32).alias("cp"), vf.mean_vector("secondary", 32).alias("cs")).withColumnRenamed("role", "other")
    return v.crossJoin(F.broadcast(c)).select("vec_id", "role", "other", F.round(vf.cosine("primary", "cp"), 9).alias("p"), F.round(vf.cosine("secondary", "cs"), 9).alias("s"))


@register(
    "V5_anchor_roles",
    f"""SELECT o.vec_id, CASE WHEN o.p >= 0.1 AND o.s >= 0.1 AND a.ahead THEN 'target' WHEN n.p >= 0.55 AND n.s >= 0.42 AND n.p - o.p >= 0.06 AND n.s - o.s >= 0.06 THEN CAST(n.role AS VARCHAR) END AS anchor
    FROM (SELECT vec_id, p, s FROM {ROLE} WHERE role = other) o JOIN (SELECT x.vec_id, bool_and(y.p - x.p >= 0.06 AND y.s - x.s >= 0.06) AS ahead FROM {ROLE} x JOIN {ROLE} y ON y.vec_id = x.vec_id AND y.role = y.other WHERE x.role <> x.other GROUP BY x.vec_id) a USING (vec_id)
    JOIN (SELECT vec_id, max(p) AS p, arg_max(s, p) AS s, arg_max(other, p) AS role FROM {ROLE} WHERE role <> other GROUP BY vec_id) n USING (vec_id)""",
)
def anchor_roles(spark, d):
    """Target where own scores are at the floors and ahead of all others' by 0.06 in both halves;
    else the nearest other role where that is strong."""
    s = role_scores(spark, d)
    own = s.where("role = other").select("vec_id", F.col("p").alias("op"), F.col("s").alias("os"))
    others = s.where("role <> other").join(own, "vec_id")
    ahead = (F.col("op") - F.col("p") >= 0.06) & (F.col("os") - F.col("s") >= 0.06)
    g = others.groupBy("vec_id").agg(F.first("op").alias("op"), F.first("os").alias("os"), F.min(ahead).alias("ahead"), F.max(F.struct("p", "s", "other")).alias("n"))
    return g.select("vec_id", de.anchor_role((F.col("op"), F.col("os")), (0.1, 0.1), F.col("ahead"), (F.col("n.other"), F.col("n.p"), F.col("n.s"))).alias("anchor"))


@register(
    "F18_confirmed_rivals",
    f"""SELECT vec_id, CAST(count(*) FILTER (cand) AS BIGINT) AS candidates, count(*) FILTER (cand AND (tp > 0.05 AND tp - ot > 0.02)) > 0 AS supported, count(*) FILTER (cand AND (tp > 0.05 AND tp - ot > 0.02)) = 1 AS resolved
    FROM (SELECT r.vec_id, r.p > 0.05 AND r.p - o.p > 0.02 AND r.s > 0.05 AND r.s - o.s > 0.02 AS cand, (r.p + r.s) / 2 AS tp, (o.p + o.s) / 2 AS ot FROM {ROLE} r JOIN {ROLE} o ON o.vec_id = r.vec_id AND o.role = o.other WHERE r.role <> r.other) GROUP BY vec_id""",
)
def confirmed_rivals(spark, d):
    """Other roles ahead of the own one in both halves, confirmed by the mean of both."""
    s = role_scores(spark, d)
    own = s.where("role = other").select("vec_id", F.col("p").alias("op"), F.col("s").alias("os"))
    r = s.where("role <> other").join(own, "vec_id")
    mean = lambda a, b: (F.col(a) + F.col(b)) / 2
    candidate, confirmed = de.rival_supported({"primary": (F.col("p"), F.col("op"), 0.05), "secondary": (F.col("s"), F.col("os"), 0.05), "tertiary": (mean("p", "s"), mean("op", "os"), 0.05)}, 0.02)
    n = F.count_if(confirmed)
    return r.groupBy("vec_id").agg(F.count_if(candidate).alias("candidates"), (n > 0).alias("supported"), (n == 1).alias("resolved"))


@register(
    "F29_nonmember_windows",
    f"""SELECT segment_id FROM {WINDOWS} w WHERE accepted AND segment_id NOT IN (SELECT x.segment_id FROM {pairs(VIEW, ERR)}) AND (p + s >= 0.9 OR p > 0.1 AND cm_p > 0 AND cm_s > 0 AND EXISTS (SELECT 1 FROM {BUY} b WHERE b.source_id = w.source_id AND b.start_ms < w.end_ms AND b.end_ms > w.start_ms AND b.value > 20))""",
)
def nonmember_windows(spark, d):
    """Windows with fused evidence, or positive channels and a purchase over 20 as cohort evidence;
    errors conflict."""
    w = iv.per_row(windows(spark, d), rows(spark, d, "error"), ("source_id",), lambda hit: [F.max(hit).alias("conflict")])
    w = iv.per_row(w, rows(spark, d, "purchase"), ("source_id",), lambda hit: [F.max(F.when(hit, F.col("b_value"))).alias("best")])
    keep = de.nonmember_passes(F.col("accepted"), F.col("conflict"), F.col("p") + F.col("s") >= 0.9, F.col("p") > 0.1, F.col("cm_p"), F.col("cm_s"), F.col("best") - 20)
    return w.where(keep).select("segment_id")


#: Scores before and after, in 0 to 1, and labels.
EVALUATED = "(SELECT segment_id, least(0.999, greatest(0.001, value / 100)) AS s0, least(0.999, greatest(0.001, (value + k) / CAST(200 AS DOUBLE))) AS s1, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS y FROM {src})"
AT = 0.4


def _metrics_sql(src: str, s: str) -> str:
    return f"""(SELECT round((sum(CASE WHEN y = 1 THEN r END) - any_value(p) * (any_value(p) + 1) / 2) / (any_value(p) * any_value(n)), 6) AS auc, round(2 * tp / (2 * tp + fp + any_value(p) - tp), 6) AS f1, round((tp / any_value(p) + (any_value(n) - fp) / any_value(n)) / 2, 6) AS balanced, round(loss, 6) AS loss FROM (
      SELECT y, rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2 AS r, sum(y) OVER () AS p, sum(1 - y) OVER () AS n FROM {src}) x, (SELECT count(*) FILTER (y = 1 AND {s} >= {AT}) AS tp, count(*) FILTER (y = 0 AND {s} >= {AT}) AS fp, avg(-(y * ln({s}) + (1 - y) * ln(1 - {s}))) AS loss FROM {src}) c GROUP BY tp, fp, loss)"""


EVAL = EVALUATED.format(src=CLICK)


@register(
    "E3_regression_guard",
    f"""SELECT b.loss AS loss0, a.loss AS loss1, b.auc AS auc0, a.auc AS auc1, b.f1 AS f0, a.f1 AS f1, b.balanced AS bal0, a.balanced AS bal1, lost, false_new, a.loss <= b.loss + 1e-6 AND a.auc >= b.auc - 1e-6 AND a.f1 >= b.f1 - 1e-6 AND a.balanced >= b.balanced - 1e-6 AND lost = 0 AND false_new = 0 AS passed
    FROM {_metrics_sql(EVAL, 's0')} b, {_metrics_sql(EVAL, 's1')} a, (SELECT count(*) FILTER (y = 1 AND s0 >= {AT} AND s1 < {AT}) AS lost, count(*) FILTER (y = 0 AND s0 < {AT} AND s1 >= {AT}) AS false_new FROM {EVAL}) g""",
)
def regression_guard(spark, d):
    """Whether new scores are no worse than old ones in loss, AUC, F1 and balanced accuracy, and
    lose no row that the old ones had right."""
    from cadenza.operators.evaluation import classification_metrics

    s = rows(spark, d).select(F.col("value"), F.col("k"), F.when(F.col("k") % 3 == 0, 1).otherwise(0).alias("y"))
    held = lambda c: F.least(F.lit(0.999), F.greatest(F.lit(0.001), c))
    s = s.select("y", held(F.col("value") / 100).alias("s0"), held((F.col("value") + F.col("k")) / 200.0).alias("s1"))
    loss = lambda c: F.round(F.avg(-(F.col("y") * F.log(c) + (1 - F.col("y")) * F.log(1 - F.col(c)))), 6)
    pos, was, now = F.col("y") == 1, F.col("s0") >= AT, F.col("s1") >= AT
    one = s.agg(loss("s0").alias("loss0"), loss("s1").alias("loss1"), F.count_if(pos & was & ~now).alias("lost"), F.count_if(~pos & ~was & now).alias("false_new"))
    for i, names in ((0, ("auc0", "f0", "bal0")), (1, ("auc1", "f1", "bal1"))):
        one = one.crossJoin(classification_metrics(s, f"s{i}", "y", AT).toDF(*names))  # of one row each
    old = {"loss": F.col("loss0"), "auc": F.col("auc0"), "f1": F.col("f0"), "balanced": F.col("bal0"), "protected_positives": F.lit(0), "protected_negatives": F.lit(0)}
    new = {"loss": F.col("loss1"), "auc": F.col("auc1"), "f1": F.col("f1"), "balanced": F.col("bal1"), "protected_positives": F.lit(0), "protected_negatives": F.lit(0), "lost_positives": F.col("lost"), "new_false_positives": F.col("false_new")}
    return one.withColumn("passed", de.non_regressing(old, new))


NEAR = f"""(SELECT a, b, w FROM (SELECT x.vec_id AS a, y.vec_id AS b, exp((list_dot_product(x."primary", y."primary") - 1) / 0.15) AS w, row_number() OVER (PARTITION BY x.vec_id ORDER BY round(list_dot_product(x."primary", y."primary"), 9) DESC, y.vec_id) AS r
  FROM {VEC} x JOIN {VEC} y ON x.source_id = y.source_id AND x.vec_id <> y.vec_id WHERE round(list_dot_product(x."primary", y."primary"), 9) > 0.15) WHERE r <= 12)"""
SYM = f"(SELECT a, b, max(w) AS w FROM (SELECT a, b, w FROM {NEAR} UNION ALL SELECT b, a, w FROM {NEAR}) GROUP BY a, b)"


def affinities(spark, d):
    """(a, b, w), both ways: the 12 nearest above 0.15 of each vector within its source."""
    v = vectors(spark, d).select("source_id", F.col("vec_id").alias("a"), F.col("primary").alias("p"))
    pairs_ = v.join(v.select("source_id", F.col("a").alias("b"), F.col("p").alias("q")), "source_id").where("a <> b").withColumn("s", vf.dot("p", "q"))
    near = pairs_.withColumn("r9", F.round("s", 9)).where("r9 > 0.15").select("a", "b", "r9", F.exp((F.col("s") - 1) / 0.15).alias("w"))
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("r9"), "b"))).where("r <= 12")
    both = best.select("a", "b", "w").unionByName(best.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return both.groupBy("a", "b").agg(F.max("w").alias("w"))


@register("V12_affinity_graph", f"SELECT a, b, round(w / sum(w) OVER (PARTITION BY a), 6) AS w FROM {SYM}")
def affinity_graph(spark, d):
    """Affinities made symmetric by the larger weight, and brought to a sum of one in each row."""
    e = affinities(spark, d)
    total = e.groupBy("a").agg(F.sum("w").alias("t"))
    return e.join(total, "a").select("a", "b", F.round(F.col("w") / F.col("t"), 6).alias("w"))


@register("V13_propagation")
def propagation(spark, d):
    """Labels 1 (role 3) and 0 (role 5) over the affinity graph, 80 rounds at the most; under ten
    labels nothing is propagated and each row keeps its label or 0.5."""
    from cadenza.operators import learning

    labels = vectors(spark, d).where("role in (3, 5)").select(F.col("vec_id").alias("node"), F.when(F.col("role") == 3, 1.0).otherwise(0.0).alias("y"))
    e = affinities(spark, d)
    if labels.limit(10).count() < 10:
        return vectors(spark, d).select(F.col("vec_id").alias("node")).join(labels, "node", "left").select("node", F.coalesce("y", F.lit(0.5)).alias("p"))
    return learning.propagate_labels(e, labels)


def _loo_sql(part: str) -> str:
    """Each vector's affinity to the mean of the others of its role."""
    total = f"[{', '.join(f'sum({part}[{i}])' for i in range(1, 33))}]"
    return f"""(SELECT vec_id, role, v, (d - 1) / sqrt(greatest(s2 - 2 * d + 1, 1e-12)) AS own, n FROM (SELECT x.vec_id, x.role, x.{part} AS v, list_dot_product(x.{part}, t.s) AS d, list_dot_product(t.s, t.s) AS s2, t.n
      FROM {VEC} x JOIN (SELECT role, {total} AS s, count(*) AS n FROM {VEC} GROUP BY role) t USING (role)))"""


def _reliability_sql(part: str) -> str:
    target = f"(SELECT v, own FROM {_loo_sql(part)} WHERE role = 3)"
    centre = f"(SELECT [{', '.join(f'sum(v[{i}])' for i in range(1, 33))}] AS s FROM {target})"
    return f"""SELECT role, round(coherence, 6) AS coherence, round(purity, 6) AS purity, round(coherence * purity, 6) AS weight FROM (
      SELECT role, greatest(0, least(1, avg(own) / greatest(any_value(rm), 2.220446049250313e-16))) AS coherence, avg(0.5 + 0.5 * tanh((own - crossed) / greatest(sqrt(ov + rv), 2.220446049250313e-16) / 2)) AS purity FROM (
        SELECT e.role, e.own, greatest(list_dot_product(e.v, c.s) / sqrt(list_dot_product(c.s, c.s)), near.m) AS crossed, var_pop(e.own) OVER (PARTITION BY e.role) AS ov, r.rv, r.rm FROM {_loo_sql(part)} e, {centre} c, (SELECT var_pop(own) AS rv, avg(own) AS rm FROM {target}) r,
          (SELECT vec_id, avg(s) AS m FROM (SELECT x.vec_id, list_dot_product(x.{part}, t.v) AS s, row_number() OVER (PARTITION BY x.vec_id ORDER BY list_dot_product(x.{part}, t.v) DESC) AS k FROM {VEC} x, {target} t WHERE x.role <> 3) WHERE k <= 2 GROUP BY vec_id) near
        WHERE near.vec_id = e.vec_id AND e.role <> 3) GROUP BY role)"""


@register("V6_view_reliability", _reliability_sql('"primary"'))
def view_reliability(spark, d):
    """How far each role but 3 is to be trusted against the target, role 3: how coherent it is by the
    leave-one-out affinities of its vectors, and how clearly these are above the target's pull
    (its centre, or its two nearest vectors).  Affinities come from sums by role alone."""
    from cadenza.operators.neighbours import nearest_scores

    v = vectors(spark, d).select("vec_id", "role", F.col("primary").alias("v"))
    width = range(32)
    sums = v.groupBy("role").agg(F.array(*[F.sum(F.get(vf.doubles("v"), i)) for i in width]).alias("s"))  # one row a role
    dotted = v.join(F.broadcast(sums), "role").withColumns({"d": vf.dot("v", "s"), "s2": vf.dot("s", "s")})
    own = dotted.withColumn("own", (F.col("d") - 1) / F.sqrt(F.greatest(F.col("s2") - 2 * F.col("d") + 1, F.lit(1e-12)))).select("vec_id", "role", "v", "own")
    target = own.where("role = 3").agg(F.var_pop("own").alias("rv"), F.avg("own").alias("rm"))
    centre = sums.where("role = 3").select(F.col("s").alias("c"))
    others = own.where("role <> 3")
    near = nearest_scores(others.select("vec_id", "v"), v.where("role = 3").select("vec_id", "v"), 2).select("vec_id", (vf.total("scores") / F.size("scores")).alias("near"))
    e = others.crossJoin(F.broadcast(target)).crossJoin(F.broadcast(centre)).join(near, "vec_id")  # of one row each
    e = e.withColumn("crossed", F.greatest(vf.dot("v", "c") / vf.norm("c"), "near"))
    spread = e.groupBy("role").agg(F.var_pop("own").alias("ov"))
    tiny = F.lit(2.220446049250313e-16)
    e = e.join(F.broadcast(spread), "role").withColumn("apart", (F.col("own") - F.col("crossed")) / F.greatest(F.sqrt(F.col("ov") + F.col("rv")), tiny))
    g = e.groupBy("role").agg(F.avg(0.5 + 0.5 * F.tanh(F.col("apart") / 2)).alias("p"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg("own") / F.greatest(F.first("rm"), tiny))).alias("c"))
    return g.select("role", F.round("c", 6).alias("coherence"), F.round("p", 6).alias("purity"), F.round(F.col("c") * F.col("p"), 6).alias("weight"))
