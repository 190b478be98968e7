"""Queries of the interval algebra and of the join shapes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.operators import intervals as iv
from cadenza.plans.catalogue import register
from cadenza.plans.sql import BUY, CLICK, ERR, SEG, SHARED, VIEW, merged, pairs, subtracted
from cadenza.sources import fixtures as fx

HOUR, MIN = 3_600_000, 60_000
ID = ["segment_id", "source_id", "start_ms", "end_ms"]


def seg(spark, d, kind=None):
    return fx.segments(spark, d, kind).select(*ID)


def err(spark, d):
    return seg(spark, d, "error")


def four(kind_sql: str) -> str:
    return f"(SELECT {', '.join(ID)} FROM {kind_sql})"


@register("I1_merge_touching", f"SELECT * FROM {merged(SEG, 0, ', count(*) AS n')}")
def merge_touching(spark, d):
    return iv.merge(seg(spark, d), ("source_id",), 0, F.count("*").alias("n"))


@register("I1_merge_gap_hour", f"SELECT * FROM {merged(SEG, HOUR)}")
def merge_gap(spark, d):
    return iv.merge(seg(spark, d), gap=HOUR)


@register(
    "I2_union_of_tracks",
    f"""SELECT source_id, start_ms, end_ms, n_parts, array_to_string(list_sort(tracks), '+') AS tracks FROM
    {merged(f"(SELECT *, 'a' AS track FROM {four(CLICK)} UNION ALL SELECT *, 'b' AS track FROM {four(VIEW)})", 0, ", count(*) AS n_parts, list(DISTINCT track) AS tracks")}""",
)
def union_of_tracks(spark, d):
    both = seg(spark, d, "click").withColumn("track", F.lit("a")).unionByName(seg(spark, d, "view").withColumn("track", F.lit("b")))
    out = iv.merge(both, ("source_id",), 0, F.count("*").alias("n_parts"), F.array_sort(F.collect_set("track")).alias("tracks"))
    return out.withColumn("tracks", F.array_join("tracks", "+"))


@register("I3_subtract_blocked", f"SELECT segment_id, source_id, start_ms, end_ms FROM {subtracted(CLICK, merged(ERR))}")
def subtract_blocked(spark, d):
    return iv.subtract(seg(spark, d, "click"), err(spark, d)).select(*ID)


PADDED = f"(SELECT source_id, start_ms - {MIN} AS start_ms, end_ms + {MIN} AS end_ms FROM {ERR})"


@register("I4_carve_padded", f"SELECT segment_id, source_id, start_ms, end_ms FROM {subtracted(CLICK, merged(PADDED), 20 * MIN - 1)}")
def carve_padded(spark, d):
    return iv.carve(seg(spark, d, "click"), err(spark, d), MIN, 20 * MIN).select(*ID)


OWN = f"""(SELECT * FROM (SELECT segment_id, source_id, end_ms, greatest(start_ms, coalesce(max(end_ms) OVER (PARTITION BY source_id
  ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start_ms)) AS start_ms FROM {CLICK}) WHERE start_ms < end_ms)"""
TAKEN = f"(SELECT source_id, start_ms, end_ms FROM {VIEW} UNION ALL SELECT source_id, start_ms, end_ms FROM {ERR})"


@register("I5_remainder", f"SELECT segment_id, source_id, start_ms, end_ms FROM {subtracted(OWN, merged(TAKEN))}")
def remainder(spark, d):
    return iv.remainder(seg(spark, d, "click"), seg(spark, d, "view"), err(spark, d)).select(*ID)


@register(
    "I6_unmasked_islands",
    f"""SELECT segment_id, source_id, start_ms, end_ms, start_ms = row_start AS edge_start, end_ms = row_end AS edge_end
    FROM {subtracted(VIEW, merged(ERR))}""",
)
def unmasked_islands(spark, d):
    return iv.subtract(seg(spark, d, "view"), err(spark, d)).select(*ID, "edge_start", "edge_end")


COVERED = f"""(SELECT s.segment_id, s.source_id, s.start_ms, s.end_ms, CAST(coalesce(c.n, 0) AS BIGINT) AS covered_ms FROM {CLICK} s
  LEFT JOIN (SELECT segment_id, sum({SHARED}) AS n FROM {pairs(CLICK, merged(VIEW))} GROUP BY segment_id) c USING (segment_id))"""


@register("I7_union_coverage", f"SELECT *, round(covered_ms / (end_ms - start_ms), 6) AS ratio FROM {COVERED}")
def union_coverage(spark, d):
    out = iv.covered_length(seg(spark, d, "click"), seg(spark, d, "view"))
    return out.withColumn("ratio", F.round(F.col("covered_ms") / (F.col("end_ms") - F.col("start_ms")), 6))


@register(
    "I8_overlap_sum_ratio",
    f"""SELECT s.segment_id, round(least(1.0, coalesce(c.n, 0) / (s.end_ms - s.start_ms)), 6) AS ratio FROM {CLICK} s
    LEFT JOIN (SELECT x.segment_id, sum({SHARED}) AS n FROM {pairs(CLICK, VIEW)} GROUP BY x.segment_id) c USING (segment_id)""",
)
def overlap_sum_ratio(spark, d):
    out = iv.overlap_sum(seg(spark, d, "click"), seg(spark, d, "view"))
    return out.select("segment_id", F.round(F.least(F.lit(1.0), F.col("overlap_ms") / (F.col("end_ms") - F.col("start_ms"))), 6).alias("ratio"))


@register("I9_completely_covered", f"SELECT segment_id, source_id FROM {COVERED} WHERE covered_ms = end_ms - start_ms")
def completely_covered(spark, d):
    out = iv.covered_length(seg(spark, d, "click"), seg(spark, d, "view"))
    return out.where("covered_ms = end_ms - start_ms").select("segment_id", "source_id")


@register(
    "I10_recover_second_channel",
    f"""SELECT segment_id, source_id, start_ms, end_ms, 'first' AS channel FROM {CLICK} UNION ALL
    SELECT segment_id, source_id, start_ms, end_ms, 'second' FROM {subtracted(VIEW, merged(f"(SELECT source_id, start_ms, end_ms FROM {CLICK} UNION ALL SELECT source_id, start_ms, end_ms FROM {ERR})"), 10 * MIN - 1)}""",
)
def recover_second_channel(spark, d):
    first = seg(spark, d, "click")
    blocked = first.select("source_id", "start_ms", "end_ms").unionByName(err(spark, d).select("source_id", "start_ms", "end_ms"))
    more = iv.subtract(seg(spark, d, "view"), blocked, least=10 * MIN - 1).select(*ID)
    return first.withColumn("channel", F.lit("first")).unionByName(more.withColumn("channel", F.lit("second")))


LATTICE = 4


@register(
    "I12_island_lattice",
    f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start_ms) AS i,
      lag(end_ms) OVER (PARTITION BY source_id ORDER BY start_ms) AS before FROM {merged(CLICK)}),
    g AS (SELECT *, sum(CASE WHEN start_ms - before > {6 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY i) AS hard FROM m)
    SELECT x.source_id, x.i AS first, y.i AS last, x.start_ms, y.end_ms FROM g x JOIN g y ON x.source_id = y.source_id
    AND y.i BETWEEN x.i AND x.i + {LATTICE - 1} AND x.hard = y.hard WHERE x.i = y.i OR y.end_ms - x.start_ms <= {96 * HOUR}""",
)
def island_lattice(spark, d):
    """Runs of up to four neighbouring islands with no hard gap inside; the length cap is for runs only."""
    order = Window.partitionBy("source_id").orderBy("start_ms")
    m = iv.merge(seg(spark, d, "click")).withColumn("i", F.row_number().over(order).cast("long"))
    hard = F.when(F.col("start_ms") - F.lag("end_ms").over(order) > 6 * HOUR, 1).otherwise(0)
    m = m.withColumn("_h", hard).withColumn("hard", F.sum("_h").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    reach = m.withColumn("last", F.explode(F.sequence(F.col("i"), F.col("i") + LATTICE - 1)))
    end = m.select("source_id", F.col("i").alias("last"), F.col("end_ms").alias("to_ms"), F.col("hard").alias("to_hard"))
    out = reach.join(end, ["source_id", "last"]).where("hard = to_hard")
    out = out.where((F.col("i") == F.col("last")) | (F.col("to_ms") - F.col("start_ms") <= 96 * HOUR))
    return out.select("source_id", F.col("i").alias("first"), "last", "start_ms", F.col("to_ms").alias("end_ms"))


@register(
    "I14_gap_kinds",
    f"""SELECT source_id, start_ms, gap, CASE WHEN gap < {HOUR} THEN 'inside' WHEN gap <= {6 * HOUR} THEN 'identity_join' ELSE 'hard_split' END AS kind
    FROM (SELECT source_id, start_ms, start_ms - lag(end_ms) OVER (PARTITION BY source_id ORDER BY start_ms) AS gap FROM {merged(CLICK)}) WHERE gap IS NOT NULL""",
)
def gap_kinds(spark, d):
    order = Window.partitionBy("source_id").orderBy("start_ms")
    m = iv.merge(seg(spark, d, "click")).withColumn("gap", F.col("start_ms") - F.lag("end_ms").over(order)).where("gap is not null")
    kind = F.when(F.col("gap") < HOUR, "inside").when(F.col("gap") <= 6 * HOUR, "identity_join").otherwise("hard_split")
    return m.select("source_id", "start_ms", "gap", kind.alias("kind"))


@register(
    "I15_snap_to_units",
    f"""SELECT DISTINCT x.segment_id, x.source_id FROM {pairs(CLICK, BUY)}
    WHERE {SHARED} >= least({10 * HOUR}, 0.25 * (x.end_ms - x.start_ms))""",
)
def snap_to_units(spark, d):
    touched = iv.overlap_join(seg(spark, d, "click"), seg(spark, d, "purchase"))
    enough = iv.shared() >= F.least(F.lit(10 * HOUR).cast("double"), 0.25 * (F.col("end_ms") - F.col("start_ms")))
    return touched.where(enough).select("segment_id", "source_id").distinct()


@register(
    "I16_subdivide_at_cuts",
    f"""WITH s AS {four(CLICK)}, c AS (SELECT DISTINCT source_id, start_ms AS cut FROM {BUY}),
    p AS (SELECT segment_id, source_id, start_ms AS pt, end_ms FROM s UNION SELECT segment_id, s.source_id, cut, end_ms FROM s JOIN c
      ON s.source_id = c.source_id AND cut > start_ms AND cut < end_ms)
    SELECT segment_id, source_id, CAST(row_number() OVER w - 1 AS INTEGER) AS part, pt AS start_ms, lead(pt, 1, end_ms) OVER w AS end_ms
    FROM p WINDOW w AS (PARTITION BY segment_id ORDER BY pt)""",
)
def subdivide_at_cuts(spark, d):
    cuts = seg(spark, d, "purchase").select("source_id", F.col("start_ms").alias("cut_ms"))
    return iv.split_at(seg(spark, d, "click"), cuts)


@register(
    "I17_cue_hand_offs",
    f"""WITH c AS (SELECT *, lead(start_ms) OVER w AS n_start, lead(end_ms) OVER w AS n_end FROM {BUY} WINDOW w AS (PARTITION BY source_id ORDER BY start_ms, segment_id))
    SELECT source_id, (end_ms + n_start) // 2 AS cut_ms FROM c WHERE n_start >= end_ms
    UNION SELECT source_id, n_start FROM c WHERE n_start < end_ms AND NOT (n_start - start_ms <= {HOUR} AND abs(n_end - end_ms) <= {HOUR})
    UNION SELECT source_id, end_ms FROM c WHERE n_start < end_ms AND NOT (n_start - start_ms <= {HOUR} AND abs(n_end - end_ms) <= {HOUR})""",
)
def cue_hand_offs(spark, d):
    order = Window.partitionBy("source_id").orderBy("start_ms", "segment_id")
    c = seg(spark, d, "purchase").withColumns({"n_start": F.lead("start_ms").over(order), "n_end": F.lead("end_ms").over(order)})
    c = c.where("n_start is not null")
    parallel = (F.col("n_start") - F.col("start_ms") <= HOUR) & (F.abs(F.col("n_end") - F.col("end_ms")) <= HOUR)
    both = F.col("end_ms") + F.col("n_start")
    middle = ((both - F.pmod(both, F.lit(2))) / 2).cast("long")
    cuts = F.when(F.col("n_start") >= F.col("end_ms"), F.array(middle)).when(~parallel, F.array("n_start", "end_ms"))
    return c.select("source_id", F.explode(cuts).alias("cut_ms")).distinct()


@register(
    "I19_collapse_near_points",
    f"""WITH p AS (SELECT source_id, start_ms AS pt, value, sum(CASE WHEN start_ms - before <= {2 * HOUR} THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY start_ms) AS g
      FROM (SELECT *, lag(start_ms) OVER (PARTITION BY source_id ORDER BY start_ms) AS before FROM {CLICK}))
    SELECT source_id, pt AS at_ms, value AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY source_id, g ORDER BY value DESC, pt) AS r FROM p) WHERE r = 1""",
)
def collapse_near_points(spark, d):
    """Chains of points at most two hours apart; of each the most confident, the earliest in a tie."""
    order = Window.partitionBy("source_id").orderBy("start_ms")
    p = fx.segments(spark, d, "click").withColumn("_n", F.when(F.col("start_ms") - F.lag("start_ms").over(order) <= 2 * HOUR, 0).otherwise(1))
    p = p.withColumn("g", F.sum("_n").over(order))
    best = p.groupBy("source_id", "g").agg(F.max(F.struct(F.col("value").alias("c"), (-F.col("start_ms")).alias("t"))).alias("b"))
    return best.select("source_id", (-F.col("b.t")).alias("at_ms"), F.col("b.c").alias("confidence"))


@register(
    "I22_sides_of_bands",
    f"SELECT segment_id, source_id, start_ms, end_ms FROM {subtracted(VIEW, merged(f'(SELECT source_id, start_ms - {HOUR} AS start_ms, start_ms + {HOUR} AS end_ms FROM {BUY})'))}",
)
def sides_of_bands(spark, d):
    bands = seg(spark, d, "purchase").select("source_id", (F.col("start_ms") - HOUR).alias("start_ms"), (F.col("start_ms") + HOUR).alias("end_ms"))
    return iv.subtract(seg(spark, d, "view"), bands).select(*ID)


@register(
    "I24_pairwise_intersections",
    f"""SELECT DISTINCT x.source_id, greatest(x.start_ms, y.start_ms) AS start_ms, least(x.end_ms, y.end_ms) AS end_ms
    FROM {pairs(CLICK, VIEW, 10 * MIN)}""",
)
def pairwise_intersections(spark, d):
    return iv.intersect(seg(spark, d, "click"), seg(spark, d, "view"), least=10 * MIN).select("source_id", "start_ms", "end_ms").distinct()


@register(
    "I26_map_views",
    f"""SELECT segment_id, CAST(floor(start_ms * 1001 / 1000.0) AS BIGINT) + 40 AS start_ms, CAST(ceil(end_ms * 1001 / 1000.0) AS BIGINT) + 40 AS end_ms FROM {SEG}""",
)
def map_views(spark, d):
    low, high = iv.rescale(F.col("start_ms"), F.col("end_ms"), 1001, 1000, 40)
    return seg(spark, d).select("segment_id", low.alias("start_ms"), high.alias("end_ms"))


def gaps_sql(src: str, least: int) -> str:
    return f"""(SELECT * FROM (SELECT source_id, end_ms AS start_ms, lead(start_ms) OVER (PARTITION BY source_id ORDER BY start_ms) AS end_ms
      FROM {merged(src)}) WHERE end_ms - start_ms >= {least})"""


@register(
    "I27_common_gaps",
    f"""SELECT x.source_id, greatest(x.start_ms, y.start_ms) AS start_ms, least(x.end_ms, y.end_ms) AS end_ms
    FROM {pairs(gaps_sql(CLICK, HOUR), gaps_sql(VIEW, HOUR), HOUR - 1)}""",
)
def common_gaps(spark, d):
    a, b = iv.gaps(seg(spark, d, "click"), least=HOUR), iv.gaps(seg(spark, d, "view"), least=HOUR)
    return iv.intersect(a, b, least=HOUR - 1).select("source_id", "start_ms", "end_ms")


RANKED = f"(SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start_ms, segment_id) AS turn FROM {CLICK})"


@register(
    "I30_rejoin_in_pairs",
    f"""WITH e AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER w <= {2 * HOUR} THEN 0 ELSE 1 END AS fresh FROM {RANKED} WINDOW w AS (PARTITION BY source_id ORDER BY turn)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY source_id ORDER BY turn) AS island FROM e),
    p AS (SELECT *, (row_number() OVER (PARTITION BY source_id, island ORDER BY turn) - 1) // 2 AS pair FROM g)
    SELECT source_id, min(turn) AS turn, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM p GROUP BY source_id, island, pair""",
)
def rejoin_in_pairs(spark, d):
    """Neighbouring turns rejoin in pairs: a chain of three gives a pair and a single."""
    order = Window.partitionBy("source_id").orderBy("start_ms", "segment_id")
    t = seg(spark, d, "click").withColumn("turn", F.row_number().over(order).cast("long"))
    t = t.withColumn("_f", F.when(F.col("start_ms") - F.lag("end_ms").over(order) <= 2 * HOUR, 0).otherwise(1))
    t = t.withColumn("island", F.sum("_f").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("source_id", "island").orderBy("turn")
    t = t.withColumn("pair", F.floor((F.row_number().over(inside) - 1) / 2))
    return t.groupBy("source_id", "island", "pair").agg(
        F.min("turn").alias("turn"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n")
    ).drop("island", "pair")


def run_sql(flag: str) -> str:
    return f"""(SELECT *, sum(c) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS run FROM (SELECT *, {flag} AS flag,
      CASE WHEN ({flag}) = lag({flag}) OVER (PARTITION BY clip_id ORDER BY frame_idx) THEN 0 ELSE 1 END AS c FROM {fx.FRAMES_SQL}))"""


@register(
    "I35_threshold_runs",
    f"""SELECT clip_id, greatest(0, (min(frame_idx) - 1) * 100 - 60) AS start_ms, max(frame_idx) * 100 + 60 AS end_ms, count(*) AS n
    FROM {run_sql('level >= 0.1')} WHERE flag GROUP BY clip_id, run HAVING count(*) >= 2""",
)
def threshold_runs(spark, d):
    r = iv.runs(fx.frames(spark, d), ["clip_id"], "frame_idx", F.col("level") >= 0.1).where("flag")
    out = r.groupBy("clip_id", "run").agg(F.min("frame_idx").alias("a"), F.max("frame_idx").alias("b"), F.count("*").alias("n")).where("n >= 2")
    return out.select("clip_id", F.greatest(F.lit(0), (F.col("a") - 1) * 100 - 60).cast("long").alias("start_ms"), (F.col("b") * 100 + 60).cast("long").alias("end_ms"), "n")


SMOOTH = f"""(SELECT clip_id, frame_idx, CAST(level >= 0.1 AS INT) + coalesce(CAST(lag(level) OVER w >= 0.1 AS INT), 0) + coalesce(CAST(lead(level) OVER w >= 0.1 AS INT), 0) >= 2 AS state
  FROM {fx.FRAMES_SQL} WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx))"""


def smoothed(frames):
    w = Window.partitionBy("clip_id").orderBy("frame_idx")
    on = lambda c: F.coalesce((c >= 0.1).cast("int"), F.lit(0))
    return frames.select("clip_id", "frame_idx", (on(F.col("level")) + on(F.lag("level").over(w)) + on(F.lead("level").over(w)) >= 2).alias("state"))


@register("I37_majority_of_three", f"SELECT * FROM {SMOOTH}")
def majority_of_three(spark, d):
    """Each frame by the original states of itself and its neighbours."""
    return smoothed(fx.frames(spark, d))


@register(
    "I38_positive_window_spans",
    f"""SELECT source_id, start_ms, end_ms FROM {merged(f"(SELECT clip_id AS source_id, frame_idx * 1000 - 500 AS start_ms, frame_idx * 1000 + 500 AS end_ms FROM {SMOOTH} WHERE state)", 650)}
    WHERE end_ms - start_ms >= 2000""",
)
def positive_window_spans(spark, d):
    s = smoothed(fx.frames(spark, d)).where("state")
    at = (F.col("frame_idx") * 1000).cast("long")
    spans = s.select(F.col("clip_id").alias("source_id"), (at - 500).alias("start_ms"), (at + 500).alias("end_ms"))
    return iv.merge(spans, gap=650).where("end_ms - start_ms >= 2000")


@register(
    "I39_longest_run",
    f"""SELECT clip_id, first_frame, n FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY n DESC, first_frame) AS r FROM (
      SELECT clip_id, run, min(frame_idx) AS first_frame, count(*) AS n FROM {run_sql('level >= 0.05')} WHERE flag GROUP BY clip_id, run HAVING count(*) >= 2)) WHERE r = 1""",
)
def longest_run(spark, d):
    r = iv.runs(fx.frames(spark, d), ["clip_id"], "frame_idx", F.col("level") >= 0.05).where("flag")
    r = r.groupBy("clip_id", "run").agg(F.min("frame_idx").alias("a"), F.count("*").alias("n")).where("n >= 2")
    best = r.groupBy("clip_id").agg(F.max(F.struct("n", (-F.col("a")).alias("a"))).alias("b"))
    return best.select("clip_id", (-F.col("b.a")).cast("long").alias("first_frame"), F.col("b.n").alias("n"))


@register(
    "I43_sliding_windows",
    f"""SELECT segment_id, w AS start_ms, least(w + {30 * HOUR}, end_ms) AS end_ms FROM (
      SELECT segment_id, end_ms, unnest(CASE WHEN end_ms - {30 * HOUR} <= start_ms THEN [start_ms]
        ELSE list_distinct(list_append(generate_series(start_ms, end_ms - {30 * HOUR}, {10 * HOUR}), end_ms - {30 * HOUR})) END) AS w FROM {CLICK})""",
)
def sliding_windows(spark, d):
    return iv.sliding_windows(seg(spark, d, "click"), 30 * HOUR, 10 * HOUR).select("segment_id", "start_ms", "end_ms")


@register(
    "I46_output_contract",
    f"""SELECT source_id, count(*) AS n, count(*) - count(DISTINCT start_ms) AS repeated_keys, sum(CASE WHEN start_ms < before THEN 1 ELSE 0 END)::BIGINT AS overlaps
    FROM (SELECT *, max(end_ms) OVER (PARTITION BY source_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {SEG}) GROUP BY source_id""",
)
def output_contract(spark, d):
    order = Window.partitionBy("source_id").orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, -1)
    s = seg(spark, d).withColumn("before", F.max("end_ms").over(order))
    return s.groupBy("source_id").agg(
        F.count("*").alias("n"),
        (F.count("*") - F.count_distinct("start_ms")).alias("repeated_keys"),
        F.count_if(F.col("start_ms") < F.col("before")).alias("overlaps"),
    )


@register(
    "I47_extend_to_islands",
    f"""SELECT s.segment_id, CASE WHEN m.a IS NULL THEN s.start_ms ELSE greatest(0, least(s.start_ms, greatest(s.start_ms - {HOUR}, m.a - {10 * MIN}))) END AS start_ms,
      CASE WHEN m.b IS NULL THEN s.end_ms ELSE greatest(s.end_ms, least(s.end_ms + {HOUR}, m.b + {10 * MIN})) END AS end_ms FROM {CLICK} s
    LEFT JOIN (SELECT x.segment_id, min(y.start_ms) AS a, max(y.end_ms) AS b FROM {pairs(CLICK, merged(VIEW))} GROUP BY x.segment_id) m USING (segment_id)""",
)
def extend_to_islands(spark, d):
    s, pad = seg(spark, d, "click"), 10 * MIN
    m = iv.overlap_join(s, iv.merge(seg(spark, d, "view"))).groupBy("segment_id").agg(F.min("b_start_ms").alias("a"), F.max("b_end_ms").alias("b"))
    s = s.join(m, "segment_id", "left")
    low = F.least("start_ms", F.greatest(F.col("start_ms") - HOUR, F.col("a") - pad))
    high = F.greatest("end_ms", F.least(F.col("end_ms") + HOUR, F.col("b") + pad))
    return s.select(
        "segment_id",
        F.when(F.col("a").isNull(), F.col("start_ms")).otherwise(F.greatest(F.lit(0), low)).cast("long").alias("start_ms"),
        F.when(F.col("b").isNull(), F.col("end_ms")).otherwise(high).alias("end_ms"),
    )


@register(
    "I50_resample_evidence",
    f"""SELECT g.source_id, g.pt AS start_ms, round(avg(s.value), 6) AS value, count(s.value) AS n FROM (
      SELECT source_id, unnest(generate_series(lo, hi, {24 * HOUR})) AS pt FROM (SELECT source_id, min(start_ms) AS lo, max(end_ms) AS hi FROM {CLICK} GROUP BY source_id)) g
    LEFT JOIN {CLICK} s ON s.source_id = g.source_id AND s.start_ms <= g.pt AND g.pt < s.end_ms GROUP BY g.source_id, g.pt""",
)
def resample_evidence(spark, d):
    """Mean evidence at each step of a grid; null where there is none."""
    s = fx.segments(spark, d, "click").select(*ID, "value")
    bounds = s.groupBy("source_id").agg(F.min("start_ms").alias("lo"), F.max("end_ms").alias("hi"))
    grid = bounds.select("source_id", F.explode(F.sequence("lo", "hi", F.lit(24 * HOUR))).alias("start_ms"))
    hit = iv.overlap_join(grid.withColumn("end_ms", F.col("start_ms") + 1), s)
    mean = hit.groupBy("source_id", "start_ms").agg(F.round(F.avg("b_value"), 6).alias("value"), F.count("b_value").alias("n"))
    return grid.join(mean, ["source_id", "start_ms"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@register(
    "I54_regions_to_fill",
    f"""SELECT p.segment_id, p.source_id, p.start_ms, p.end_ms FROM {subtracted(VIEW, merged(CLICK), HOUR)} p JOIN {VIEW} s USING (segment_id) WHERE s.value >= 20""",
)
def regions_to_fill(spark, d):
    s = fx.segments(spark, d, "view").select(*ID, "value")
    return iv.subtract(s, seg(spark, d, "click"), least=HOUR).where("value >= 20").select(*ID)


@register(
    "J1_overlap_join",
    f"SELECT x.segment_id, y.segment_id AS b_segment_id, {SHARED} AS shared_ms FROM {pairs(CLICK, VIEW)}",
)
def overlap_join(spark, d):
    out = iv.overlap_join(seg(spark, d, "click"), seg(spark, d, "view"))
    return out.select("segment_id", "b_segment_id", iv.shared().alias("shared_ms"))


@register(
    "J2_containment_anti",
    f"""SELECT segment_id, source_id FROM {CLICK} s WHERE NOT EXISTS (SELECT 1 FROM {VIEW} v WHERE v.source_id = s.source_id AND v.start_ms <= s.start_ms AND v.end_ms >= s.end_ms)""",
)
def containment_anti(spark, d):
    a = seg(spark, d, "click")
    inside = iv.overlap_join(a, seg(spark, d, "view")).where("b_start_ms <= start_ms and b_end_ms >= end_ms").select("segment_id").distinct()
    return a.join(inside, "segment_id", "left_anti").select("segment_id", "source_id")


@register(
    "J3_overlap_ratio",
    f"""SELECT x.segment_id, y.segment_id AS b_segment_id FROM {pairs(CLICK, VIEW)}
    WHERE {SHARED} >= 0.75 * greatest(x.end_ms - x.start_ms, y.end_ms - y.start_ms)""",
)
def overlap_ratio(spark, d):
    out = iv.overlap_join(seg(spark, d, "click"), seg(spark, d, "view"))
    longest = F.greatest(F.col("end_ms") - F.col("start_ms"), F.col("b_end_ms") - F.col("b_start_ms"))
    return out.where(iv.shared() >= 0.75 * longest).select("segment_id", "b_segment_id")


@register(
    "J4_nearest",
    f"""SELECT segment_id, near FROM (SELECT s.segment_id, v.start_ms AS near, row_number() OVER (PARTITION BY s.segment_id ORDER BY abs(v.start_ms - s.start_ms), v.start_ms) AS r
    FROM {CLICK} s JOIN {VIEW} v USING (source_id)) WHERE r = 1""",
)
def nearest(spark, d):
    """The nearest start of the other track; the earlier one in a tie.  Two as-of lookups, no pairs."""
    a = seg(spark, d, "click").select("source_id", F.col("start_ms").alias("at"), "segment_id", F.lit(None).cast("long").alias("v"))
    b = seg(spark, d, "view").select("source_id", F.col("start_ms").alias("at"), F.lit(None).cast("long").alias("segment_id"), F.col("start_ms").alias("v"))
    order = Window.partitionBy("source_id").orderBy("at")
    back = F.last("v", True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.first("v", True).over(order.rangeBetween(0, Window.unboundedFollowing))
    u = a.unionByName(b).withColumns({"back": back, "ahead": ahead}).where("segment_id is not null")
    use_ahead = F.col("back").isNull() | (F.col("ahead") - F.col("at") < F.col("at") - F.col("back"))
    near = F.when(use_ahead & F.col("ahead").isNotNull(), F.col("ahead")).otherwise(F.col("back"))
    return u.select("segment_id", near.alias("near")).where("near is not null")


TOP2 = f"""(SELECT *, row_number() OVER (PARTITION BY x_id ORDER BY s DESC, y_id) AS r, lead(s) OVER (PARTITION BY x_id ORDER BY s DESC, y_id) AS next
  FROM (SELECT x.segment_id AS x_id, y.segment_id AS y_id, {SHARED} AS s FROM {pairs(CLICK, VIEW)} WHERE {SHARED} >= 0.5 * (x.end_ms - x.start_ms)))"""


@register("J5_best_match_unambiguous", f"SELECT x_id AS segment_id, y_id AS b_segment_id, s AS shared_ms FROM {TOP2} WHERE r = 1 AND (next IS NULL OR s - next >= {HOUR})")
def best_match(spark, d):
    """The best cover of at least half, unless a second one is nearly as good."""
    p = iv.overlap_join(seg(spark, d, "click"), seg(spark, d, "view")).withColumn("s", iv.shared()).where("s >= 0.5 * (end_ms - start_ms)")
    order = Window.partitionBy("segment_id").orderBy(F.desc("s"), "b_segment_id")
    p = p.withColumns({"r": F.row_number().over(order), "next": F.lead("s").over(order)})
    return p.where((F.col("r") == 1) & (F.col("next").isNull() | (F.col("s") - F.col("next") >= HOUR))).select("segment_id", "b_segment_id", F.col("s").alias("shared_ms"))


@register(
    "J6_unique_match",
    f"""SELECT segment_id, b_segment_id FROM (SELECT x.segment_id, count(*) AS n, any_value(y.segment_id) AS b_segment_id,
      any_value({SHARED} >= 0.7 * (x.end_ms - x.start_ms)) AS ok FROM {pairs(CLICK, VIEW)} GROUP BY x.segment_id) WHERE n = 1 AND ok""",
)
def unique_match(spark, d):
    p = iv.overlap_join(seg(spark, d, "click"), seg(spark, d, "view"))
    one = p.groupBy("segment_id").agg(F.count("*").alias("n"), F.first("b_segment_id").alias("b_segment_id"), F.first(iv.shared() >= 0.7 * (F.col("end_ms") - F.col("start_ms"))).alias("ok"))
    return one.where("n = 1 and ok").select("segment_id", "b_segment_id")


@register("J7_independent_evidence", f"SELECT segment_id, source_id FROM {CLICK} s WHERE segment_id NOT IN (SELECT x.segment_id FROM {pairs(CLICK, ERR)})")
def independent_evidence(spark, d):
    return iv.overlap_join(seg(spark, d, "click"), err(spark, d), how="left_anti").select("segment_id", "source_id")


@register(
    "J14_overlapping_pairs",
    f"""SELECT x.segment_id, y.segment_id AS b_segment_id, {SHARED} AS shared_ms FROM {pairs(BUY, BUY, MIN)} WHERE x.segment_id < y.segment_id
    AND NOT (abs(x.start_ms - y.start_ms) <= {10 * MIN} AND abs(x.end_ms - y.end_ms) <= {10 * MIN})""",
)
def overlapping_pairs(spark, d):
    s, near = seg(spark, d, "purchase"), 10 * MIN
    p = iv.overlap_join(s, s, least=MIN).where("segment_id < b_segment_id")
    parallel = (F.abs(F.col("start_ms") - F.col("b_start_ms")) <= near) & (F.abs(F.col("end_ms") - F.col("b_end_ms")) <= near)
    return p.where(~parallel).select("segment_id", "b_segment_id", iv.shared().alias("shared_ms"))


@register(
    "J15_parent_alive",
    f"""SELECT segment_id FROM {CLICK} s WHERE NOT EXISTS (SELECT 1 FROM {VIEW} v WHERE v.source_id = s.source_id AND v.start_ms <= s.start_ms + {HOUR} AND v.end_ms >= s.end_ms - {HOUR}
      AND least(v.end_ms, s.end_ms) > greatest(v.start_ms, s.start_ms))""",
)
def parent_alive(spark, d):
    a = seg(spark, d, "click")
    alive = iv.overlap_join(a, seg(spark, d, "view")).where(f"b_start_ms <= start_ms + {HOUR} and b_end_ms >= end_ms - {HOUR}").select("segment_id").distinct()
    return a.join(alive, "segment_id", "left_anti").select("segment_id")


@register(
    "J17_first_containing",
    f"""SELECT segment_id, first_id FROM (SELECT s.segment_id, v.segment_id AS first_id, row_number() OVER (PARTITION BY s.segment_id ORDER BY v.start_ms, v.segment_id) AS r
    FROM {CLICK} s JOIN {VIEW} v ON v.source_id = s.source_id AND v.start_ms <= s.start_ms AND v.end_ms >= s.end_ms) WHERE r = 1""",
)
def first_containing(spark, d):
    p = iv.overlap_join(seg(spark, d, "click"), seg(spark, d, "view")).where("b_start_ms <= start_ms and b_end_ms >= end_ms")
    return p.groupBy("segment_id").agg(F.min_by("b_segment_id", F.struct("b_start_ms", "b_segment_id")).alias("first_id"))


@register(
    "J21_review_status",
    f"""SELECT s.segment_id, r.label, round(covered_ms / (end_ms - start_ms), 6) AS coverage,
      CASE WHEN covered_ms >= 0.85 * (end_ms - start_ms) THEN 'retained' WHEN covered_ms > 0 THEN 'unresolved' ELSE 'rejected' END AS status
    FROM {COVERED} s JOIN {fx.REVIEWS_SQL} r USING (segment_id)""",
)
def review_status(spark, d):
    out = iv.covered_length(seg(spark, d, "click"), seg(spark, d, "view")).join(fx.reviews(spark, d), "segment_id")
    share = F.col("covered_ms") / (F.col("end_ms") - F.col("start_ms"))
    kept = F.col("covered_ms") >= 0.85 * (F.col("end_ms") - F.col("start_ms"))
    status = F.when(kept, "retained").when(F.col("covered_ms") > 0, "unresolved").otherwise("rejected")
    return out.select("segment_id", "label", F.round(share, 6).alias("coverage"), status.alias("status"))


@register(
    "J24_crosses_cues",
    f"""WITH t AS (SELECT *, lead(segment_id) OVER w AS nxt FROM {CLICK} WINDOW w AS (PARTITION BY source_id ORDER BY start_ms, segment_id)),
    c AS (SELECT x.segment_id, array_to_string(list_sort(list(DISTINCT y.segment_id)), ',') AS ids FROM {pairs(CLICK, BUY)} GROUP BY x.segment_id)
    SELECT t.segment_id, t.nxt AS next_id, coalesce(a.ids, '') <> coalesce(b.ids, '') AS crosses FROM t LEFT JOIN c a ON a.segment_id = t.segment_id LEFT JOIN c b ON b.segment_id = t.nxt WHERE t.nxt IS NOT NULL""",
)
def crosses_cues(spark, d):
    a = seg(spark, d, "click")
    order = Window.partitionBy("source_id").orderBy("start_ms", "segment_id")
    cues = iv.overlap_join(a, seg(spark, d, "purchase")).groupBy("segment_id").agg(F.array_sort(F.collect_set("b_segment_id")).alias("ids"))
    with_ids = a.join(cues, "segment_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<long>")))
    n = with_ids.withColumns({"next_id": F.lead("segment_id").over(order), "next_ids": F.lead("ids").over(order)})
    return n.where("next_id is not null").select("segment_id", "next_id", (F.col("ids") != F.col("next_ids")).alias("crosses"))


@register("J29_member_overlap", f"SELECT DISTINCT x.segment_id FROM {pairs(CLICK, ERR, HOUR)}")
def member_overlap(spark, d):
    return iv.overlap_join(seg(spark, d, "click"), err(spark, d), least=HOUR, how="left_semi").select("segment_id").distinct()



