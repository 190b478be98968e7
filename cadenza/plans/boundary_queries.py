"""Queries over cuts, pauses, changes and candidates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.operators import boundaries as bo
from cadenza.operators import intervals as iv
from cadenza.plans.catalogue import register
from cadenza.plans.sql import BUY, CLICK, ERR, VIEW, merged, subtracted
from cadenza.sources import fixtures as fx

HOUR, MIN = 3_600_000, 60_000
SPAN = ["source_id", "start_ms", "end_ms"]


def spans(spark, d, kind, *more):
    return fx.segments(spark, d, kind).select(*SPAN, *more)


def within(rows, cover, at, out):
    """Adds whether the moment lies strictly inside an interval of the cover."""
    moments = rows.withColumns({"_s": F.col("start_ms"), "_e": F.col("end_ms"), "start_ms": F.col(at), "end_ms": F.col(at) + 1})
    found = iv.per_row(moments, cover, ["source_id"], lambda hit: [F.max(F.coalesce(hit & (F.col("b_start_ms") < F.col("start_ms")), F.lit(False))).alias(out)])
    return found.withColumns({"start_ms": F.col("_s"), "end_ms": F.col("_e")}).drop("_s", "_e")


def _inside(t: str, cover: str) -> str:
    return f"EXISTS (SELECT 1 FROM {cover} c WHERE c.source_id = x.source_id AND c.start_ms < {t} AND c.end_ms > {t})"


@register("I18_paired_cuts")
def paired_cuts(spark, d):
    """Starts of clicks and purchases within 45 minutes of each other as cuts of views."""
    cuts = lambda kind: spans(spark, d, kind, "value").select("source_id", F.col("start_ms").alias("at_ms"), F.col("value").alias("confidence"))
    islands = fx.segments(spark, d, "view").select("source_id", "segment_id", "start_ms", "end_ms")
    return bo.paired_cuts(islands, cuts("click"), cuts("purchase"), 45 * MIN, 10 * MIN, unmatched=True)


LEVELS = "(SELECT clip_id AS source_id, frame_idx * 10 AS at_ms, 60 * log10(greatest(level, 1e-6)) AS level_db FROM " + fx.FRAMES_SQL + ")"
BOUNDS = f"(SELECT source_id, source_id * 10 + k AS segment_id, 0 AS start_ms, last AS end_ms, 120 * k AS at_ms, CASE WHEN k % 2 = 0 THEN 'left' ELSE 'right' END AS side FROM (SELECT source_id, max(at_ms) + 10 AS last FROM {LEVELS} GROUP BY source_id), (SELECT unnest(generate_series(1, 5)) AS k) WHERE 120 * k < last)"


@register(
    "I58_pause_boundaries",
    f"""WITH f AS MATERIALIZED (SELECT b.segment_id, f.at_ms AS t, level_db FROM {BOUNDS} b JOIN {LEVELS} f ON f.source_id = b.source_id AND f.at_ms >= greatest(b.start_ms, b.at_ms - 500) AND f.at_ms + 20 <= least(b.end_ms, b.at_ms + 500)),
    q AS (SELECT segment_id, greatest(-55, least(-38, quantile_cont(level_db, 0.75) - 18)) AS floor_db FROM f GROUP BY segment_id),
    r AS (SELECT segment_id, min(t) AS a, max(t) + 20 AS b FROM (SELECT f.segment_id, t, t - 10 * row_number() OVER (PARTITION BY f.segment_id ORDER BY t) AS g FROM f JOIN q USING (segment_id) WHERE level_db <= floor_db) GROUP BY segment_id, g HAVING max(t) + 20 - min(t) >= 60),
    p AS (SELECT b.segment_id, count(*) AS n_runs, CASE WHEN any_value(side) = 'left' THEN arg_min(r.b, a) FILTER (a >= at_ms - 20) ELSE arg_max(r.b, a) FILTER (r.b <= at_ms + 20) END AS pause FROM {BOUNDS} b JOIN r USING (segment_id) GROUP BY b.segment_id)
    SELECT segment_id, CASE WHEN floor_db IS NULL THEN at_ms ELSE least(end_ms - 200, greatest(start_ms + 200, coalesce(pause, at_ms))) END AS refined_ms, round(floor_db, 6) AS floor_db, coalesce(n_runs, 0) AS n_runs FROM {BOUNDS} LEFT JOIN q USING (segment_id) LEFT JOIN p USING (segment_id)""",
)
def pause_boundaries(spark, d):
    """Five boundaries of each clip moved to an adjacent pause."""
    frames = fx.frames(spark, d).select(F.col("clip_id").alias("source_id"), (F.col("frame_idx") * 10).cast("long").alias("at_ms"), (60 * F.log10(F.greatest("level", F.lit(1e-6)))).alias("level_db"))
    clips = frames.groupBy("source_id").agg((F.max("at_ms") + 10).alias("end_ms"))
    rows = clips.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("at_ms", (120 * F.col("k")).cast("long")).where("at_ms < end_ms")
    side = F.when(F.col("k") % 2 == 0, "left").otherwise("right")
    bounds = rows.select("source_id", (F.col("source_id") * 10 + F.col("k")).alias("segment_id"), F.lit(0).cast("long").alias("start_ms"), "end_ms", "at_ms", side.alias("side"))
    return bo.snapped_to_quiet(bounds, frames).withColumn("floor_db", F.round("floor_db", 6))


NEXT = f"(SELECT source_id, source_id * 100000 + row_number() OVER (PARTITION BY source_id ORDER BY start_ms) AS pair_id, start_ms AS left_start, end_ms AS left_end, lead(start_ms) OVER (PARTITION BY source_id ORDER BY start_ms) AS right_start, lead(end_ms) OVER (PARTITION BY source_id ORDER BY start_ms) AS right_end FROM {merged(VIEW)})"
FLANK, LOWEST, HIGHEST, BELOW = 12 * HOUR, 0.01, 0.3, 0.5


@register(
    "I59_bridgeable_gaps",
    f"""WITH p AS MATERIALIZED (SELECT * FROM {NEXT} WHERE right_start IS NOT NULL), f AS MATERIALIZED (SELECT source_id, start_ms AS s, end_ms AS e, value / 500 AS level FROM {CLICK}),
    q AS (SELECT pair_id, greatest({LOWEST}, least({HIGHEST}, min(q) * {BELOW})) AS quiet FROM (
      SELECT pair_id, k, quantile_cont(level, 0.9) AS q FROM (SELECT pair_id, source_id, 'l' AS k, greatest(left_start, left_end - {FLANK}) AS a, left_end AS b FROM p UNION ALL SELECT pair_id, source_id, 'r', right_start, least(right_end, right_start + {FLANK}) FROM p) w
      JOIN f ON f.source_id = w.source_id AND f.s < w.b AND f.e > w.a GROUP BY pair_id, k) GROUP BY pair_id HAVING count(*) = 2),
    loud AS MATERIALIZED (SELECT p.source_id, pair_id, greatest(left_end, s) AS a, least(right_start, e) AS b FROM p JOIN q USING (pair_id) JOIN f ON f.source_id = p.source_id AND f.s < right_start AND f.e > left_end WHERE level > quiet),
    l AS (SELECT pair_id, count(*) AS loud, bool_or(NOT EXISTS (SELECT 1 FROM {merged(BUY, HOUR)} i WHERE i.source_id = loud.source_id AND i.start_ms <= a AND i.end_ms >= b)) AS alien FROM loud GROUP BY pair_id)
    SELECT pair_id, round(quiet, 6) AS quiet, coalesce(loud, 0) AS loud, quiet IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT source_id, start_ms, start_ms + {10 * MIN} AS end_ms FROM {ERR}) b WHERE b.source_id = p.source_id AND b.start_ms < right_start AND b.end_ms > left_end)
      AND (loud IS NULL OR NOT alien AND EXISTS (SELECT 1 FROM {merged(VIEW, 24 * HOUR)} g WHERE g.source_id = p.source_id AND g.start_ms <= left_start AND g.end_ms >= right_end)) AS verified
    FROM p LEFT JOIN q USING (pair_id) LEFT JOIN l USING (pair_id)""",
)
def bridgeable(spark, d):
    """Gaps between merged views: quiet, or explained by purchases within a region that holds both sides."""
    views = iv.merge(spans(spark, d, "view"))
    w = Window.partitionBy("source_id").orderBy("start_ms")
    lead = lambda c: F.lead(c).over(w)
    pairs = views.select("source_id", (F.col("source_id") * 100000 + F.row_number().over(w)).alias("pair_id"), F.col("start_ms").alias("left_start"), F.col("end_ms").alias("left_end"), lead("start_ms").alias("right_start"), lead("end_ms").alias("right_end")).where("right_start is not null")
    barriers = spans(spark, d, "error").withColumn("end_ms", F.col("start_ms") + 10 * MIN)
    frames = spans(spark, d, "click", "value").withColumn("level", F.col("value") / 500)
    found = bo.bridgeable_gaps(pairs, frames, iv.merge(spans(spark, d, "view"), gap=24 * HOUR), iv.merge(spans(spark, d, "purchase"), gap=HOUR), barriers, FLANK, LOWEST, HIGHEST, BELOW)
    return found.withColumn("quiet", F.round("quiet", 6))


@register("I61_multiscale_changes")
def multiscale_changes(spark, d):
    """Changes of voice that contexts of 4, 6 and 8 turns agree on, in spans of turns sorted by voice."""
    turns = fx.turns(spark, d).withColumn("span_id", F.expr("source_id div 4"))
    place = F.row_number().over(Window.partitionBy("span_id").orderBy(F.pmod(F.col("voice") * 7, F.lit(10)), "turn")) - 1
    places = turns.select("span_id", place.cast("long").alias("place"), "primary", "secondary")
    found = bo.multiscale_changes(places, [4, 6, 8], cluster=4)
    return found.select("span_id", "place", F.round("p", 6).alias("p"), F.round("s", 6).alias("s"), "confidence", "votes")


LOWER, UPPER, LONGEST = 30 * MIN, 6 * HOUR, 48 * HOUR
ISLANDS = f"(SELECT source_id, start_ms AS segment_id, start_ms, end_ms, NOT {_inside('x.start_ms', CLICK)} AS sc, NOT {_inside('x.end_ms', CLICK)} AS ec FROM {merged(VIEW)} x)"


@register(
    "I13_silence_proposals",
    f"""WITH i AS MATERIALIZED (SELECT *, sum(hard) OVER (PARTITION BY source_id ORDER BY start_ms ROWS UNBOUNDED PRECEDING) AS g, row_number() OVER (PARTITION BY source_id ORDER BY start_ms) AS n FROM (
      SELECT *, start_ms - lag(end_ms) OVER w AS before, lead(start_ms) OVER w - end_ms AS after, CASE WHEN start_ms - lag(end_ms) OVER w > {UPPER} THEN 1 ELSE 0 END AS hard FROM {ISLANDS} WINDOW w AS (PARTITION BY source_id ORDER BY start_ms)))
    SELECT a.source_id, a.segment_id AS first_id, z.segment_id AS last_id, CAST(z.n - a.n + 1 AS INTEGER) AS n_islands, a.start_ms, z.end_ms, a.sc AND coalesce(a.before >= {LOWER}, true) AS start_complete, z.ec AND coalesce(z.after >= {LOWER}, true) AS end_complete
    FROM i a JOIN i z ON z.source_id = a.source_id AND z.g = a.g AND z.n >= a.n AND (z.n = a.n OR z.end_ms - a.start_ms <= {LONGEST})
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT source_id, start_ms, start_ms + {10 * MIN} AS end_ms FROM {ERR}) b WHERE b.source_id = a.source_id AND b.start_ms < z.end_ms AND b.end_ms > a.start_ms)""",
)
def silence_proposals(spark, d):
    """Runs of merged views as candidates; an edge that a click covers is open."""
    clicks = spans(spark, d, "click")
    islands = iv.merge(spans(spark, d, "view")).withColumn("segment_id", F.col("start_ms"))
    islands = within(within(islands, clicks, "start_ms", "s_open"), clicks, "end_ms", "e_open")
    islands = islands.select("source_id", "segment_id", "start_ms", "end_ms", (~F.col("s_open")).alias("start_complete"), (~F.col("e_open")).alias("end_complete"))
    blocked = spans(spark, d, "error").withColumn("end_ms", F.col("start_ms") + 10 * MIN)
    return bo.silence_proposals(islands, blocked, LOWER, UPPER, LONGEST).withColumn("n_islands", F.col("n_islands").cast("int"))


TOLERANCE = 2 * HOUR
PARENTS = f"(SELECT x.segment_id, x.source_id, x.start_ms, x.end_ms, NOT {_inside('x.start_ms', ERR)} AS sc, NOT {_inside('x.end_ms', ERR)} AS ec FROM {VIEW} x)"
SURE = f"(SELECT source_id, start_ms, start_ms + {20 * MIN} AS end_ms FROM {CLICK} WHERE value >= 20 AND value < 200)"
PAUSES = f"(SELECT DISTINCT p.segment_id, p.segment_id AS source_id, g.start_ms, g.end_ms FROM {PARENTS} p JOIN {SURE} g ON g.source_id = p.source_id AND g.start_ms > p.start_ms AND g.end_ms < p.end_ms JOIN {ERR} c ON c.source_id = p.source_id AND c.start_ms < p.end_ms AND c.end_ms > p.start_ms AND c.start_ms - g.end_ms <= {TOLERANCE} AND g.start_ms - c.end_ms <= {TOLERANCE})"


@register(
    "I21_change_parts",
    f"""WITH pauses AS MATERIALIZED (SELECT * FROM {PAUSES}), parents AS MATERIALIZED (SELECT * FROM {PARENTS} WHERE segment_id IN (SELECT segment_id FROM pauses)), m AS MATERIALIZED (SELECT * FROM {merged('pauses')})
    SELECT s.segment_id, s.start_ms, s.end_ms, s.start_ms > p.start_ms OR sc AS start_complete, s.end_ms < p.end_ms OR ec AS end_complete FROM {subtracted('(SELECT segment_id, segment_id AS source_id, start_ms, end_ms FROM parents)', 'm')} s JOIN parents p USING (segment_id)
    WHERE EXISTS (SELECT 1 FROM {BUY} b WHERE b.source_id = p.source_id AND b.start_ms < s.end_ms AND b.end_ms > s.start_ms)""",
)
def change_parts(spark, d):
    """Children of views between clicks near an error, where purchases are heard."""
    errors = spans(spark, d, "error")
    parents = fx.segments(spark, d, "view").select("segment_id", *SPAN)
    parents = within(within(parents, errors, "start_ms", "s_open"), errors, "end_ms", "e_open")
    parents = parents.select("segment_id", *SPAN, (~F.col("s_open")).alias("start_complete"), (~F.col("e_open")).alias("end_complete"))
    gaps = spans(spark, d, "click", "value").withColumns({"end_ms": F.col("start_ms") + 20 * MIN, "verified": F.col("value") >= 20, "left_complete": F.col("value") < 200, "right_complete": F.lit(True)})
    return bo.change_parts(parents, spans(spark, d, "purchase"), errors, gaps, TOLERANCE)
