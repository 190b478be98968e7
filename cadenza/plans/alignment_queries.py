"""Queries over captions placed on speech.  An hour of the events stands for a second."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import alignment as al
from cadenza.plans.catalogue import register
from cadenza.plans.sql import SEG
from cadenza.sources import fixtures as fx

HOUR, MIN = 3_600_000, 60_000

#: How far speech lies from the caption of the same event: a shift of the source with some minutes of jitter; one source in
#: four has a cut after which the shift is another, one in seven isn't of these captions at all.
SHIFT = f"""CASE WHEN source_id % 7 = 6 THEN (segment_id * 101 % 97 - 48) * {30 * MIN}
  WHEN source_id % 4 = 3 AND start_ms > {500 * HOUR} THEN (source_id * 7 % 21 - 10) * {6 * MIN} + {24 * MIN}
  ELSE (source_id * 7 % 21 - 10) * {6 * MIN} END"""
HEARD_SQL = f"""(SELECT source_id, start_ms + shift + (segment_id * 37 % 13 - 6) * {MIN} AS start_ms, end_ms + shift + (segment_id * 53 % 13 - 6) * {MIN} AS end_ms
  FROM (SELECT *, {SHIFT} AS shift FROM {SEG}) WHERE segment_id % 6 <> 0 AND end_ms - start_ms > {20 * MIN})"""


def captions(spark, d):
    return fx.segments(spark, d).select("source_id", "segment_id", "start_ms", "end_ms")


def heard(spark, d):
    s = captions(spark, d).withColumn("shift", F.expr(SHIFT)).where(f"segment_id % 6 <> 0 AND end_ms - start_ms > {20 * MIN}")
    moved = lambda c, m: (F.col(c) + F.col("shift") + (F.col("segment_id") * m % 13 - 6) * MIN).alias(c)
    return s.select("source_id", moved("start_ms", 37), moved("end_ms", 53))


def placed(spark, d):
    cues = captions(spark, d)
    offsets, anchors = al.calibrate(cues, heard(spark, d), HOUR)
    return cues, offsets, al.aligned_cues(cues, offsets, anchors, HOUR)


_NEAR, _APART, _KEEP = 15 * MIN, 18 * MIN, 12 * MIN


def _edge(c: str) -> str:
    """The nearest edge of speech to each caption's at each shift, where it is near."""
    return f"""(SELECT segment_id, shift, control, min({{'d': abs(o - shift), 'o': o}}).o AS o FROM (
      SELECT DISTINCT f.segment_id, h.{c} - f.{c} AS o FROM fit f JOIN heard h ON h.source_id = f.source_id AND abs(h.{c} - f.{c}) <= {21 * HOUR})
      JOIN grid ON abs(o - shift) <= {_NEAR} GROUP BY segment_id, shift, control)"""


CALIBRATION = f"""cue AS MATERIALIZED (SELECT source_id, segment_id, start_ms, end_ms FROM {SEG}), heard AS MATERIALIZED {HEARD_SQL},
  fit AS MATERIALIZED (SELECT * FROM cue WHERE end_ms - start_ms BETWEEN {36 * MIN} AND {12 * HOUR}),
  grid AS (SELECT unnest(generate_series(-30, 30)) * {3 * MIN} AS shift, false AS control UNION ALL SELECT unnest([-20, -15, -10, -5, 5, 10, 15, 20]) * {HOUR}, true),
  trial AS MATERIALIZED (SELECT f.source_id, f.segment_id, f.start_ms + f.end_ms AS middle2, a.shift, a.control, a.o + b.o AS offset2 FROM {_edge("start_ms")} a JOIN {_edge("end_ms")} b USING (segment_id, shift) JOIN fit f USING (segment_id) WHERE abs(a.o - b.o) <= {_APART}),
  best AS (SELECT source_id, shift FROM (SELECT source_id, shift, row_number() OVER (PARTITION BY source_id ORDER BY count(*) DESC, abs(shift), shift) AS r FROM trial WHERE NOT control GROUP BY source_id, shift) WHERE r = 1),
  chance AS (SELECT source_id, median(n) AS chance FROM (SELECT s.source_id, g.shift, count(t.segment_id) AS n FROM (SELECT DISTINCT source_id FROM cue) s CROSS JOIN (SELECT shift FROM grid WHERE control) g LEFT JOIN trial t ON t.source_id = s.source_id AND t.shift = g.shift GROUP BY s.source_id, g.shift) GROUP BY source_id),
  middle AS (SELECT source_id, median(offset2) AS median2 FROM trial JOIN best USING (source_id, shift) GROUP BY source_id),
  close AS MATERIALIZED (SELECT t.source_id, t.segment_id, t.middle2, t.offset2, median2 FROM trial t JOIN best USING (source_id, shift) JOIN middle m ON m.source_id = t.source_id WHERE abs(offset2 - median2) <= {2 * _KEEP}),
  tally AS (SELECT source_id, n_fit >= 6 AND source_id IN (SELECT source_id FROM heard) AS enough, coalesce(n, 0) AS n_anchors, n_fit, chance, median2, coalesce(spread2, 0) AS spread2
    FROM (SELECT c.source_id, count(f.segment_id) AS n_fit FROM cue c LEFT JOIN fit f USING (segment_id) GROUP BY c.source_id) LEFT JOIN chance USING (source_id)
    LEFT JOIN (SELECT source_id, count(*) AS n, any_value(median2) AS median2, max(middle2) - min(middle2) AS spread2 FROM close GROUP BY source_id) USING (source_id)),
  offsets AS MATERIALIZED (SELECT *, enough AND n_anchors >= greatest(6, 2 * chance + 3) AND spread2 >= {20 * HOUR} AS aligned FROM tally),
  own AS MATERIALIZED (SELECT source_id, segment_id, local_ms, greatest(0, CAST(floor(start_ms + local_ms + 0.5) AS BIGINT)) AS start_ms, greatest(0, CAST(floor(end_ms + local_ms + 0.5) AS BIGINT)) AS end_ms
    FROM (SELECT c.source_id, c.segment_id, any_value(c.start_ms) AS start_ms, any_value(c.end_ms) AS end_ms, median(a.offset2) / 2 AS local_ms, any_value(o.median2) / 2 AS offset_ms
      FROM cue c JOIN offsets o ON o.source_id = c.source_id AND o.aligned JOIN close a ON a.source_id = c.source_id AND abs(a.middle2 - c.start_ms - c.end_ms) <= {90 * HOUR} GROUP BY c.source_id, c.segment_id HAVING count(*) >= 2)
    WHERE abs(local_ms - offset_ms) <= {_NEAR})"""


@register(
    "J19_timeline_calibration",
    f"""WITH {CALIBRATION} SELECT source_id, CASE WHEN NOT enough THEN 'insufficient_anchors' WHEN aligned THEN 'aligned' ELSE 'timeline_mismatch' END AS status,
    CASE WHEN aligned THEN median2 / 2 ELSE 0.0 END AS offset_ms, CASE WHEN enough THEN n_anchors END AS n_anchors, CASE WHEN enough THEN round(n_anchors / n_fit, 6) END AS anchor_share, CASE WHEN enough THEN chance END AS chance FROM offsets""",
)
def timeline_calibration(spark, d):
    """The offset of each source's captions, held against shifts that only chance supports."""
    offsets, _ = al.calibrate(captions(spark, d), heard(spark, d), HOUR)
    return offsets.drop("aligned").withColumn("anchor_share", F.round("anchor_share", 6))


@register("J20_placed_captions", f"WITH {CALIBRATION} SELECT source_id, segment_id, start_ms, end_ms, local_ms FROM own")
def placed_captions(spark, d):
    """Captions at the median of the anchors around them, where it agrees with the source's offset."""
    return placed(spark, d)[2]


@register("J23_capped_retries")
def capped_retries(spark, d):
    """Windows of at most 30 around captions that the longer events of their source cover too little."""
    cues, _, aligned = placed(spark, d)
    ends = cues.groupBy("source_id").agg((F.max("end_ms") - 24 * HOUR).alias("clip_ms"))
    return al.retry_windows(aligned, heard(spark, d).where(f"start_ms % 3 = 0 AND end_ms - start_ms < {6 * HOUR}"), ends, HOUR)


@register(
    "J24_cue_crossings",
    f"""WITH {CALIBRATION}, place AS MATERIALIZED (SELECT c.source_id, c.segment_id, coalesce(w.start_ms, greatest(0, CAST(floor(c.start_ms + m + 0.5) AS BIGINT))) AS s, coalesce(w.end_ms, greatest(0, CAST(floor(c.end_ms + m + 0.5) AS BIGINT))) AS e
      FROM (SELECT cue.*, CASE WHEN o.aligned THEN o.median2 / 2 ELSE 0.0 END AS m FROM cue JOIN offsets o USING (source_id)) c LEFT JOIN own w USING (segment_id)),
    part AS (SELECT source_id, start_ms, end_ms, row_number() OVER (PARTITION BY source_id ORDER BY start_ms, end_ms) AS r FROM (SELECT DISTINCT source_id, start_ms, end_ms FROM heard)),
    pair AS (SELECT a.source_id, a.r AS pair_id, a.start_ms AS ls, a.end_ms AS le, b.start_ms AS rs, b.end_ms AS re FROM part a JOIN part b ON b.source_id = a.source_id AND b.r = a.r + 1),
    met AS (SELECT p.source_id, pair_id, least(le, e) - greatest(ls, s) > {HOUR // 100} AS l, least(re, e) - greatest(rs, s) > {HOUR // 100} AS r FROM pair p JOIN place c ON c.source_id = p.source_id AND least(greatest(le, re), e) - greatest(least(ls, rs), s) > {HOUR // 100})
    SELECT p.source_id, p.pair_id, coalesce(bool_or(l <> r) OR count(*) FILTER (l OR r) > 1 OR bool_or(NOT l), false) AS crosses FROM pair p LEFT JOIN met m ON m.source_id = p.source_id AND m.pair_id = p.pair_id GROUP BY p.source_id, p.pair_id""",
)
def cue_crossings(spark, d):
    """Neighbouring stretches of speech, and whether a caption's edge lies between them."""
    from pyspark.sql import Window

    cues, offsets, aligned = placed(spark, d)
    order = Window.partitionBy("source_id").orderBy("start_ms", "end_ms")
    part = heard(spark, d).distinct().withColumns({"pair_id": F.row_number().over(order).cast("long"), "right_start": F.lead("start_ms").over(order), "right_end": F.lead("end_ms").over(order)})
    pairs = part.where("right_start IS NOT NULL").withColumnsRenamed({"start_ms": "left_start", "end_ms": "left_end"})
    return al.crossing_pairs(pairs, al.placed_cues(cues, offsets, aligned), HOUR).select("source_id", "pair_id", "crosses")
