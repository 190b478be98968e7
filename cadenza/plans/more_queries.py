"""Further interval, cue, cluster and graph queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions import vectors as vf
from cadenza.operators import intervals as iv
from cadenza.operators import learning
from cadenza.operators.storage import materialised
from cadenza.plans.catalogue import register
from cadenza.plans.interval_queries import COVERED, gaps_sql, run_sql
from cadenza.plans.policy_queries import SCORED, scored
from cadenza.plans.sql import BUY, CLICK, ERR, SEG, VIEW, merged, pairs, subtracted
from cadenza.plans.vector_queries import CENTROIDS, VEC, centroids, vectors
from cadenza.sources import fixtures as fx

HOUR, MIN = 3_600_000, 60_000
ID = ["segment_id", "source_id", "start_ms", "end_ms"]


def seg(spark, d, kind=None, *more):
    return fx.segments(spark, d, kind).select(*ID, *more)


@register("I11_keep_pieces", f"SELECT segment_id, source_id, start_ms, end_ms FROM {subtracted(VIEW, merged(f'(SELECT source_id, start_ms, start_ms + 20 * {MIN} AS end_ms FROM {ERR})'), 2 * MIN)}")
def keep_pieces(spark, d):
    """The complement of marked spots inside each clip; slivers of two minutes fall out."""
    marks = seg(spark, d, "error").withColumn("end_ms", F.col("start_ms") + 20 * MIN)
    return iv.subtract(seg(spark, d, "view"), marks, least=2 * MIN).select(*ID)


@register("I20_multiscale_vote", f"""SELECT source_id, min(start_ms) AS at_ms, count(DISTINCT kind) AS contexts FROM (SELECT *, sum(fresh) OVER (PARTITION BY source_id ORDER BY start_ms, segment_id ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT *, CASE WHEN start_ms - lag(start_ms) OVER (PARTITION BY source_id ORDER BY start_ms, segment_id) <= {3 * HOUR} THEN 0 ELSE 1 END AS fresh FROM {SEG})) GROUP BY source_id, g HAVING count(DISTINCT kind) >= 2""")
def multiscale_vote(spark, d):
    """Points within three hours of the one before are one group; it stays with two contexts."""
    w = Window.partitionBy("source_id").orderBy("start_ms", "segment_id")
    s = seg(spark, d, None, "kind").withColumn("_f", F.when(F.col("start_ms") - F.lag("start_ms").over(w) <= 3 * HOUR, 0).otherwise(1))
    s = s.withColumn("g", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = s.groupBy("source_id", "g").agg(F.min("start_ms").alias("at_ms"), F.count_distinct("kind").alias("contexts"))
    return g.where("contexts >= 2").drop("g")


@register("I23_sub_turns", f"""SELECT segment_id, start_ms, end_ms, n FROM (SELECT segment_id, g, min(a) AS start_ms, max(b) AS end_ms, count(*) AS n, count(*) OVER (PARTITION BY segment_id) AS groups FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY segment_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY segment_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {HOUR} THEN 0 ELSE 1 END AS fresh FROM (
      SELECT x.segment_id, greatest(x.start_ms, y.start_ms) AS a, least(x.end_ms, y.end_ms) AS b FROM {pairs(VIEW, CLICK)}))) GROUP BY segment_id, g) WHERE groups >= 2""")
def sub_turns(spark, d):
    """Second-channel spans clipped to a turn and grouped by gap; turns with two groups count."""
    p = iv.intersect(seg(spark, d, "view"), seg(spark, d, "click")).select("segment_id", "start_ms", "end_ms")
    g = iv.merge(p, ("segment_id",), HOUR, F.count("*").alias("n"))
    return g.withColumn("groups", F.count("*").over(Window.partitionBy("segment_id"))).where("groups >= 2").drop("groups")


@register("I34_target_runs", f"""SELECT source_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM (SELECT *, sum(brk) OVER (PARTITION BY source_id ORDER BY start_ms, segment_id ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT *, CASE WHEN value >= 20 AND lag(value) OVER w >= 20 AND start_ms - lag(end_ms) OVER w <= {6 * HOUR} THEN 0 ELSE 1 END AS brk FROM {CLICK} WINDOW w AS (PARTITION BY source_id ORDER BY start_ms, segment_id))) WHERE value >= 20 GROUP BY source_id, g""")
def target_runs(spark, d):
    """Runs of target rows, broken by other rows and by hard gaps."""
    w = Window.partitionBy("source_id").orderBy("start_ms", "segment_id")
    s = seg(spark, d, "click", "value")
    goes_on = (F.col("value") >= 20) & (F.lag("value").over(w) >= 20) & (F.col("start_ms") - F.lag("end_ms").over(w) <= 6 * HOUR)
    s = s.withColumn("_b", F.when(goes_on, 0).otherwise(1)).withColumn("g", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.where("value >= 20").groupBy("source_id", "g").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n")).drop("g")


@register("I36_two_level", f"""WITH f AS (SELECT c.segment_id AS coarse, v.source_id, v.start_ms, v.end_ms FROM {VIEW} c JOIN {CLICK} v ON v.source_id = c.source_id AND v.start_ms >= c.start_ms AND v.end_ms <= c.end_ms),
  u AS (SELECT source_id, start_ms, end_ms FROM f UNION ALL SELECT source_id, start_ms, end_ms FROM {VIEW} WHERE segment_id NOT IN (SELECT coarse FROM f))
  SELECT * FROM {merged('u')}""")
def two_level(spark, d):
    """Coarse regions, each replaced by the fine windows inside it where there are any."""
    coarse, fine = seg(spark, d, "view"), seg(spark, d, "click")
    inside = iv.overlap_join(coarse, fine).where("b_start_ms >= start_ms and b_end_ms <= end_ms")
    alone = coarse.join(inside.select("segment_id").distinct(), "segment_id", "left_anti").select("source_id", "start_ms", "end_ms")
    return iv.merge(inside.select("source_id", F.col("b_start_ms").alias("start_ms"), F.col("b_end_ms").alias("end_ms")).unionByName(alone))


@register("I40_longest_clean_run", f"""SELECT clip_id, first_frame, last_frame FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY last_frame - first_frame DESC, first_frame) AS r FROM (
  SELECT clip_id, run, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame FROM {run_sql('level < 0.2')} WHERE flag GROUP BY clip_id, run)) WHERE r = 1""")
def longest_clean_run(spark, d):
    r = iv.runs(fx.frames(spark, d), ["clip_id"], "frame_idx", F.col("level") < 0.2).where("flag").groupBy("clip_id", "run")
    r = r.agg(F.min("frame_idx").cast("long").alias("first_frame"), F.max("frame_idx").cast("long").alias("last_frame"))
    return r.groupBy("clip_id").agg(F.max_by(F.struct("first_frame", "last_frame"), F.struct(F.col("last_frame") - F.col("first_frame"), -F.col("first_frame"))).alias("b")).select("clip_id", "b.*")


@register("I44_user_exclusions", f"SELECT segment_id, source_id, start_ms, end_ms, segment_id AS parent FROM {subtracted(f'(SELECT * FROM {CLICK} c WHERE segment_id IN (SELECT x.segment_id FROM {pairs(CLICK, ERR)}))', merged(ERR), 30 * MIN)}")
def user_exclusions(spark, d):
    """Rows that a mark touches, replaced by their pieces outside the marks, with their parent."""
    marks = seg(spark, d, "error")
    touched = iv.overlap_join(seg(spark, d, "click"), marks, how="left_semi")
    return iv.subtract(touched, marks, least=30 * MIN).select(*ID, F.col("segment_id").alias("parent"))


@register("I56_pass_runs", f"""WITH s AS (SELECT clip_id, avg(CASE WHEN level >= 0.03 THEN 1.0 ELSE 0.0 END) AS share, first(level ORDER BY frame_idx) >= 0.03 AND last(level ORDER BY frame_idx) >= 0.03 AS edges, min(frame_idx) AS a, max(frame_idx) AS b FROM {fx.FRAMES_SQL} GROUP BY clip_id)
  SELECT clip_id, a AS first_frame, b AS last_frame, true AS whole FROM s WHERE share >= 0.8 AND edges
  UNION ALL SELECT r.clip_id, min(frame_idx), max(frame_idx), false FROM {run_sql('level >= 0.03')} r JOIN s ON s.clip_id = r.clip_id WHERE flag AND NOT (share >= 0.8 AND edges) GROUP BY r.clip_id, run HAVING count(*) >= 4""")
def pass_runs(spark, d):
    """The whole clip where four fifths and both edges pass, else its runs of at least four."""
    f = fx.frames(spark, d)
    ok = F.col("level") >= 0.03
    s = f.groupBy("clip_id").agg(
        F.avg(F.when(ok, 1.0).otherwise(0.0)).alias("share"), (F.min_by(ok, "frame_idx") & F.max_by(ok, "frame_idx")).alias("edges"), F.min("frame_idx").alias("a"), F.max("frame_idx").alias("b")
    )
    whole = s.where("share >= 0.8 and edges").select("clip_id", F.col("a").cast("long").alias("first_frame"), F.col("b").cast("long").alias("last_frame"), F.lit(True).alias("whole"))
    r = iv.runs(f, ["clip_id"], "frame_idx", ok).where("flag").join(whole.select("clip_id"), "clip_id", "left_anti").groupBy("clip_id", "run")
    r = r.agg(F.min("frame_idx").cast("long").alias("first_frame"), F.max("frame_idx").cast("long").alias("last_frame"), F.count("*").alias("n")).where("n >= 4")
    return whole.unionByName(r.select("clip_id", "first_frame", "last_frame", F.lit(False).alias("whole")))


@register("I48_evidence_field", f"""WITH e AS (SELECT source_id, start_ms, end_ms, value - 30 AS v FROM {CLICK}), p AS (SELECT source_id, start_ms AS t FROM e UNION SELECT source_id, end_ms FROM e UNION SELECT source_id, (start_ms + end_ms) // 2 FROM e),
  c AS (SELECT source_id, t AS a, lead(t) OVER (PARTITION BY source_id ORDER BY t) AS b FROM p)
  SELECT c.source_id, c.a AS start_ms, c.b AS end_ms, round(sum(v * w) / sum(w), 6) AS density FROM (SELECT c.*, e.v, 1.0 - abs((c.a + c.b) / 2.0 - (e.start_ms + e.end_ms) / 2.0) / (e.end_ms - e.start_ms) AS w
    FROM c JOIN e ON e.source_id = c.source_id AND e.start_ms <= c.a AND e.end_ms >= c.b WHERE c.b IS NOT NULL) c GROUP BY c.source_id, c.a, c.b""")
def evidence_field(spark, d):
    """Elementary intervals between all starts, centres and ends, each with the mean of the
    evidence over it, weighted by the distance from the centre."""
    e = seg(spark, d, "click").join(fx.segments(spark, d, "click").select("segment_id", (F.col("value") - 30).alias("v")), "segment_id")
    both = F.col("start_ms") + F.col("end_ms")
    ts = e.select("source_id", F.explode(F.array("start_ms", "end_ms", ((both - F.pmod(both, F.lit(2))) / 2).cast("long"))).alias("start_ms")).distinct()
    cells = ts.withColumn("end_ms", F.lead("start_ms").over(Window.partitionBy("source_id").orderBy("start_ms"))).where("end_ms is not null")
    p = iv.overlap_join(cells, e)
    off = F.abs((F.col("start_ms") + F.col("end_ms")) / 2 - (F.col("b_start_ms") + F.col("b_end_ms")) / 2)
    p = p.withColumn("w", 1.0 - off / (F.col("b_end_ms") - F.col("b_start_ms")))
    return p.groupBy("source_id", "start_ms", "end_ms").agg(F.round(F.sum(F.col("b_v") * F.col("w")) / F.sum("w"), 6).alias("density"))


@register("I60_turns_from_cuts", f"""WITH c AS (SELECT DISTINCT source_id, start_ms AS cut FROM {BUY}), p AS (SELECT segment_id, source_id, start_ms AS pt, end_ms FROM {CLICK} UNION SELECT s.segment_id, s.source_id, cut, end_ms FROM {CLICK} s JOIN c ON s.source_id = c.source_id AND cut > start_ms AND cut < end_ms),
  q AS (SELECT segment_id, source_id, pt AS a, lead(pt, 1, end_ms) OVER w AS b, row_number() OVER w AS i, count(*) OVER (PARTITION BY segment_id) AS n FROM p WINDOW w AS (PARTITION BY segment_id ORDER BY pt)),
  t AS (SELECT *, lead(b - a) OVER (PARTITION BY segment_id ORDER BY i) AS nxt, lead(b) OVER (PARTITION BY segment_id ORDER BY i) AS nb FROM q)
  SELECT segment_id, a AS start_ms, CASE WHEN i = n - 1 AND nxt < {2 * HOUR} THEN nb ELSE b END AS end_ms FROM t WHERE b - a >= {2 * HOUR}""")
def turns_from_cuts(spark, d):
    """Pieces between cuts; short ones drop, a short last one goes to the piece before it."""
    cuts = seg(spark, d, "purchase").select("source_id", F.col("start_ms").alias("cut_ms"))
    w, whole = Window.partitionBy("segment_id").orderBy("part"), Window.partitionBy("segment_id")
    t = iv.split_at(seg(spark, d, "click"), cuts).withColumns(
        {"n": F.count("*").over(whole), "nxt": F.lead(F.col("end_ms") - F.col("start_ms")).over(w), "nb": F.lead("end_ms").over(w)}
    )
    end = F.when((F.col("part") == F.col("n") - 2) & (F.col("nxt") < 2 * HOUR), F.col("nb")).otherwise(F.col("end_ms"))
    return t.where(F.col("end_ms") - F.col("start_ms") >= 2 * HOUR).select("segment_id", "start_ms", end.alias("end_ms"))


@register("J22_candidate_membership", f"""SELECT s.segment_id, CASE WHEN covered_ms >= 0.85 * (end_ms - start_ms) AND coalesce(r, 0) >= 0.8 THEN 'member' WHEN covered_ms > 0 THEN 'borderline' ELSE 'outside' END AS tier
  FROM {COVERED} s LEFT JOIN (SELECT x.segment_id, avg(CASE WHEN y.value >= 15 THEN 1.0 ELSE 0.0 END) AS r FROM {pairs(CLICK, VIEW)} GROUP BY x.segment_id) w USING (segment_id)""")
def candidate_membership(spark, d):
    s, v = seg(spark, d, "click"), seg(spark, d, "view", "value")
    c = iv.covered_length(s, v)
    r = iv.overlap_join(s, v).groupBy("segment_id").agg(F.avg(F.when(F.col("b_value") >= 15, 1.0).otherwise(0.0)).alias("r"))
    tier = F.when((F.col("covered_ms") >= 0.85 * (F.col("end_ms") - F.col("start_ms"))) & (F.coalesce("r", F.lit(0.0)) >= 0.8), "member")
    return c.join(r, "segment_id", "left").select("segment_id", tier.when(F.col("covered_ms") > 0, "borderline").otherwise("outside").alias("tier"))


@register("J23_retry_windows", f"""SELECT source_id, start_ms, end_ms FROM {merged(f"(SELECT source_id, start_ms - {HOUR} AS start_ms, end_ms + {HOUR} AS end_ms FROM {COVERED} WHERE covered_ms < least({5 * HOUR}, 0.5 * (end_ms - start_ms)))")}""")
def retry_windows(spark, d):
    """Padded and merged windows around rows with too little cover."""
    c = iv.covered_length(seg(spark, d, "click"), seg(spark, d, "view"))
    few = c.where(F.col("covered_ms") < F.least(F.lit(5.0 * HOUR), 0.5 * (F.col("end_ms") - F.col("start_ms"))))
    return iv.merge(few.select("source_id", (F.col("start_ms") - HOUR).alias("start_ms"), (F.col("end_ms") + HOUR).alias("end_ms")))


@register("J26_snap_to_quiet", f"""SELECT segment_id, mid AS cut_ms FROM (SELECT s.segment_id, (g.start_ms + g.end_ms) // 2 AS mid, row_number() OVER (PARTITION BY s.segment_id ORDER BY abs((g.start_ms + g.end_ms) // 2 - s.start_ms), g.end_ms - g.start_ms DESC, g.start_ms) AS r
  FROM {BUY} s JOIN {gaps_sql(CLICK, HOUR)} g ON g.source_id = s.source_id AND g.end_ms > s.start_ms - {20 * HOUR} AND g.start_ms < s.start_ms + {20 * HOUR}) WHERE r = 1""")
def snap_to_quiet(spark, d):
    """The middle of the nearest quiet run within twenty hours; of equally near ones the longer."""
    s = seg(spark, d, "purchase").select("segment_id", "source_id", (F.col("start_ms") - 20 * HOUR).alias("start_ms"), (F.col("start_ms") + 20 * HOUR).alias("end_ms"))
    p = iv.overlap_join(s, iv.gaps(seg(spark, d, "click"), least=HOUR))
    both = F.col("b_start_ms") + F.col("b_end_ms")
    p = p.withColumn("mid", ((both - F.pmod(both, F.lit(2))) / 2).cast("long")).withColumn("far", F.abs(F.col("mid") - (F.col("start_ms") + 20 * HOUR)))
    best = F.min_by("mid", F.struct("far", F.col("b_start_ms") - F.col("b_end_ms"), "b_start_ms"))
    return p.groupBy("segment_id").agg(best.alias("cut_ms"))


@register("J31_shared_block", f"""SELECT segment_id, block FROM (SELECT s.segment_id, m.start_ms AS block, row_number() OVER (PARTITION BY s.segment_id ORDER BY m.start_ms) AS r FROM
  (SELECT *, lead(end_ms) OVER (PARTITION BY source_id ORDER BY start_ms, segment_id) AS n_end FROM {CLICK}) s JOIN {merged(SEG)} m ON m.source_id = s.source_id AND m.start_ms <= s.start_ms AND m.end_ms >= greatest(s.end_ms, s.n_end) WHERE n_end IS NOT NULL) WHERE r = 1""")
def shared_block(spark, d):
    """The block that holds a row and its successor."""
    w = Window.partitionBy("source_id").orderBy("start_ms", "segment_id")
    s = seg(spark, d, "click").withColumn("n_end", F.lead("end_ms").over(w)).where("n_end is not null")
    both = s.select("segment_id", "source_id", "start_ms", F.greatest("end_ms", "n_end").alias("end_ms"))
    p = iv.overlap_join(both, iv.merge(seg(spark, d))).where("b_start_ms <= start_ms and b_end_ms >= end_ms")
    return p.groupBy("segment_id").agg(F.min("b_start_ms").alias("block"))


@register("J19_offset_calibration", f"""WITH n AS (SELECT b.segment_id, b.start_ms AS t, v.start_ms AS u FROM {BUY} b JOIN {VIEW} v USING (source_id) WHERE abs(v.start_ms - b.start_ms) <= {8 * HOUR}),
  g AS (SELECT unnest(generate_series({-6 * HOUR}, {6 * HOUR}, {HOUR})) AS shift)
  SELECT shift, count(DISTINCT segment_id) AS anchors FROM g JOIN n ON abs(u - t - shift) <= {HOUR // 2} GROUP BY shift""")
def offset_calibration(spark, d):
    """For each shift of a grid the cues with a near start; pairs come from one band join."""
    band = 8 * HOUR
    b = seg(spark, d, "purchase").select("segment_id", "source_id", (F.col("start_ms") - band).alias("start_ms"), (F.col("start_ms") + band + 1).alias("end_ms"))
    v = seg(spark, d, "view").select("source_id", "start_ms", (F.col("start_ms") + 1).alias("end_ms"))
    off = iv.overlap_join(b, v).select("segment_id", (F.col("b_start_ms") - F.col("start_ms") - band).alias("o"))
    shifts = F.filter(F.sequence(F.lit(-6 * HOUR), F.lit(6 * HOUR), F.lit(HOUR)), lambda s: F.abs(F.col("o") - s) <= HOUR // 2)
    near = off.select("segment_id", F.explode(shifts).alias("shift")).distinct()
    return near.groupBy("shift").agg(F.count("*").alias("anchors")).select(F.col("shift").cast("long").alias("shift"), "anchors")


@register("J8_cohort_without_own", f"""SELECT v.vec_id, round(max(list_cosine_similarity(v."primary", c.c)), 6) AS rival FROM {VEC} v JOIN {CENTROIDS} c ON c.role <> v.role GROUP BY v.vec_id""")
def cohort_without_own(spark, d):
    c = F.broadcast(centroids(spark, d).withColumnRenamed("role", "other"))  # one row a role
    p = vectors(spark, d).join(c, F.col("other") != F.col("role"))
    return p.groupBy("vec_id").agg(F.round(F.max(vf.cosine("primary", "c")), 6).alias("rival"))


@register("A6_trimmed_centroid", f"""WITH s AS (SELECT v.role, v."primary" AS p, list_cosine_similarity(v."primary", c.c) AS s FROM {VEC} v JOIN {CENTROIDS} c USING (role)), q AS (SELECT role, quantile_cont(s, 0.1) AS q FROM s GROUP BY role)
  SELECT role, count(*) AS kept, round(list_sum(list_transform([{", ".join(f"avg(p[{i + 1}])" for i in range(32))}], lambda x: x * x)), 6) AS energy FROM s JOIN q USING (role) WHERE s >= q GROUP BY role""")
def trimmed_centroid(spark, d):
    """The mean again without the tenth that lies furthest from it."""
    s = vectors(spark, d).join(F.broadcast(centroids(spark, d)), "role").select("role", "primary", vf.cosine("primary", "c").alias("s"))
    q = s.groupBy("role").agg(F.percentile("s", 0.1).alias("q"))
    kept = s.join(F.broadcast(q), "role").where("s >= q")
    m = kept.groupBy("role").agg(F.count("*").alias("kept"), vf.mean_vector("primary", 32).alias("c"))
    return m.select("role", "kept", F.round(vf.total(F.transform("c", lambda x: x * x)), 6).alias("energy"))


@register("A11_cluster_purity", f"""WITH s AS (SELECT v.role, list_cosine_similarity(v."primary", c.c) AS s FROM {VEC} v JOIN {CENTROIDS} c USING (role)), m AS (SELECT role, median(s) AS mid, avg(s) AS mean FROM s GROUP BY role)
  SELECT role, round((any_value(mean) + any_value(mid)) / 2 * (1 - avg(CASE WHEN s < mid - 0.18 THEN 1.0 ELSE 0.0 END)), 6) AS purity FROM s JOIN m USING (role) GROUP BY role""")
def cluster_purity(spark, d):
    s = vectors(spark, d).join(F.broadcast(centroids(spark, d)), "role").select("role", vf.cosine("primary", "c").alias("s"))
    m = s.groupBy("role").agg(F.percentile("s", 0.5).alias("mid"), F.avg("s").alias("mean"))
    out = s.join(F.broadcast(m), "role").groupBy("role")
    off = F.avg(F.when(F.col("s") < F.col("mid") - 0.18, 1.0).otherwise(0.0))
    return out.agg(F.round((F.first("mean") + F.first("mid")) / 2 * (1 - off), 6).alias("purity"))


@register("A12_discover_sources", f"SELECT source_id, count(*) AS n, CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms FROM {SEG} GROUP BY source_id HAVING count(*) >= 3 AND sum(end_ms - start_ms) >= {1000 * HOUR}")
def discover_sources(spark, d):
    g = seg(spark, d).groupBy("source_id").agg(F.count("*").alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"))
    return g.where(f"n >= 3 and total_ms >= {1000 * HOUR}")


@register("A7_reference_core", f"""WITH r AS (SELECT vec_id, role, "primary" AS p FROM {VEC} WHERE vec_id % 5 = 0), s AS (SELECT x.role, x.vec_id, median(list_dot_product(x.p, y.p)) AS m FROM r x JOIN r y ON x.role = y.role AND x.vec_id <> y.vec_id GROUP BY x.role, x.vec_id),
  q AS (SELECT role, median(m) AS mid FROM s GROUP BY role) SELECT role, vec_id FROM s JOIN q USING (role) WHERE m >= mid - 0.05""")
def reference_core(spark, d):
    """References near their peers: by the median similarity of each, against the role's median."""
    from cadenza.operators.neighbours import median_similarities

    r = vectors(spark, d).where("vec_id % 5 = 0").select("role", "vec_id", F.col("primary").alias("v"))
    s = materialised(median_similarities(r, "role"), "medians")
    mid = s.groupBy("role").agg(F.percentile("m", 0.5).alias("mid"))
    return s.join(F.broadcast(mid), "role").where("m >= mid - 0.05").select("role", "vec_id")


@register("V1_profile_floors", f"""SELECT role, round(quantile_cont(s, 0.1), 6) AS floor_score, round(greatest(quantile_cont(s, 0.1) - 0.02, 0.1), 6) AS threshold FROM (SELECT v.role, list_cosine_similarity(v."primary", c.c) AS s FROM {VEC} v JOIN {CENTROIDS} c USING (role)) GROUP BY role""")
def profile_floors(spark, d):
    s = vectors(spark, d).join(F.broadcast(centroids(spark, d)), "role").select("role", vf.cosine("primary", "c").alias("s"))
    q = F.percentile("s", 0.1)
    return s.groupBy("role").agg(F.round(q, 6).alias("floor_score"), F.round(F.greatest(q - 0.02, F.lit(0.1)), 6).alias("threshold"))


@register("V7_margin_consensus", f"""SELECT segment_id, round(0.5 * (first - 0.3) + 0.3 * (second - 0.5) + 0.2 * (paired - 0.4), 6) AS pooled, CAST(first < 0.3 AS INT) + CAST(second < 0.5 AS INT) + CAST(paired < 0.4 AS INT) >= 2 AS conflict FROM {SCORED}""")
def margin_consensus(spark, d):
    s = scored(spark, d)
    view = lambda c, at, w: F.struct((F.col(c).cast("double") - at).alias("m"), F.lit(w).alias("w"))
    views = s.select("segment_id", F.explode(F.array(view("first", 0.3, 0.5), view("second", 0.5, 0.3), view("paired", 0.4, 0.2))).alias("v"))
    return views.groupBy("segment_id").agg(F.round(F.sum(F.col("v.m") * F.col("v.w")), 6).alias("pooled"), (F.count_if(F.col("v.m") < 0) >= 2).alias("conflict"))


@register("V13_label_propagation")
def label_propagation(spark, d):
    """Over the affinities of neighbouring vectors of a source, from labels of roles 0 and 1."""
    v = vectors(spark, d).select("vec_id", "source_id", "role", "primary")
    w = v.select(F.col("vec_id").alias("b"), "source_id", F.col("primary").alias("q"))
    e = v.join(w, "source_id").where("vec_id < b").withColumn("s", vf.dot("primary", "q")).where("s > 0.15")
    edges = e.select(F.col("vec_id").alias("a"), "b", F.exp((F.col("s") - 1) / 0.15).alias("w"))
    labels = v.where("role in (0, 1)").select(F.col("vec_id").alias("node"), F.col("role").alias("y"))
    return learning.propagate_labels(edges, labels, rounds=12)


@register("V14_projection")
def projection(spark, d):
    """Shares of variance of the two main axes, as subspaces: signs of axes are free."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    v = vectors(spark, d).select("vec_id", array_to_vector("primary").alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(v)
    shares = [(i, float(x)) for i, x in enumerate(model.explainedVariance.toArray())]
    return spark.createDataFrame(shares, "axis int, share double")


@register("E7_temperature")
def temperature(spark, d):
    s = fx.segments(spark, d).select((F.col("value") / 50).alias("score"), F.when(F.col("k") + F.col("value") / 2 > 60, 1).otherwise(0).alias("y"))
    return spark.createDataFrame([learning.fit_temperature(s)], "scale double, bias double")


@register("J16_fallback_chain", f"""WITH RECURSIVE l AS (SELECT segment_id AS id, lag(segment_id) OVER (PARTITION BY source_id, k % 10 ORDER BY start_ms, segment_id) AS parent FROM {CLICK}), r AS (SELECT id, parent AS root, 1 AS steps FROM l WHERE parent IS NOT NULL
  UNION ALL SELECT r.id, l.parent, steps + 1 FROM r JOIN l ON l.id = r.root WHERE l.parent IS NOT NULL) SELECT id, arg_max(root, steps) AS root, CAST(max(steps) AS BIGINT) AS steps FROM r GROUP BY id""")
def fallback_chain(spark, d):
    """Each row's first ancestor, by doubling."""
    w = Window.partitionBy("source_id", F.col("k") % 10).orderBy("start_ms", "segment_id")
    links = fx.segments(spark, d, "click").select(F.col("segment_id").alias("id"), F.lag("segment_id").over(w).alias("parent")).where("parent is not null")
    return learning.chain_to_roots(links)


@register("F15_whole_sentence", f"SELECT segment_id FROM {CLICK} WHERE segment_id NOT IN (SELECT x.segment_id FROM {pairs(CLICK, ERR)}) AND (source_id, k) IN (SELECT source_id, k FROM {VIEW})")
def whole_sentence(spark, d):
    """No blocked overlap, and an accepted row for exactly this key."""
    free = iv.overlap_join(seg(spark, d, "click", "k"), seg(spark, d, "error"), how="left_anti")
    return free.join(fx.segments(spark, d, "view").select("source_id", "k").distinct(), ["source_id", "k"], "left_semi").select("segment_id")


@register("F4_validate_reviews", f"""SELECT r.segment_id, CASE WHEN s.segment_id IS NULL THEN 'no_row' WHEN r.label NOT IN ('correct', 'partial', 'wrong', 'singing') THEN 'bad_label' WHEN r.grade IS NULL THEN 'no_grade' END AS error
  FROM {fx.REVIEWS_SQL} r LEFT JOIN (SELECT segment_id FROM {SEG} WHERE value > 2) s USING (segment_id)""")
def validate_reviews(spark, d):
    rows = fx.segments(spark, d).where("value > 2").select("segment_id", F.lit(True).alias("there"))
    r = fx.reviews(spark, d).join(rows, "segment_id", "left")
    error = F.when(F.col("there").isNull(), "no_row").when(~F.col("label").isin("correct", "partial", "wrong", "singing"), "bad_label").when(F.col("grade").isNull(), "no_grade")
    return r.select("segment_id", error.alias("error"))


@register("E3_non_regression", f"""SELECT sum(CASE WHEN y = 1 AND old >= 60 AND score < 30 THEN 1 ELSE 0 END) = 0 AND avg(CASE WHEN (score >= 30) = (y = 1) THEN 1.0 ELSE 0.0 END) >= avg(CASE WHEN (old >= 60) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accepted
  FROM (SELECT value AS score, value / 2 + k AS old, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS y FROM {SEG})""")
def non_regression(spark, d):
    s = fx.segments(spark, d).select((F.col("value") >= 30).alias("now"), (F.col("value") / 2 + F.col("k") >= 60).alias("was"), (F.col("k") % 3 == 0).alias("y"))
    right = lambda c: F.avg(F.when(F.col(c) == F.col("y"), 1.0).otherwise(0.0))
    return s.agg(((F.count_if(F.col("y") & F.col("was") & ~F.col("now")) == 0) & (right("now") >= right("was"))).alias("accepted"))
