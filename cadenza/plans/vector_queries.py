"""Queries over embedding vectors, graphs, greedy selection and folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions import vectors as vf
from cadenza.operators import folds, greedy
from cadenza.operators import intervals as iv
from cadenza.operators.graph import connected_components
from cadenza.plans.catalogue import register
from cadenza.plans.sql import CLICK
from cadenza.sources import fixtures as fx

VEC = fx.VECTORS_SQL
HOUR = 3_600_000


def mean_sql(col: str, width: int = 32) -> str:
    return "[" + ", ".join(f"avg({col}[{i + 1}])" for i in range(width)) + "]"


CENTROIDS = f"""(SELECT role, {mean_sql('"primary"')} AS c FROM {VEC} GROUP BY role)"""


def vectors(spark, d):
    return fx.vectors(spark, d)


def centroids(spark, d):
    """One row a role: the number of roles is fixed."""
    return vectors(spark, d).groupBy("role").agg(vf.mean_vector("primary", 32).alias("c"))


@register("X22_cosine_of_halves", f"""SELECT vec_id, round(list_cosine_similarity("primary", secondary), 6) AS cosine, round(acos(greatest(-1, least(1, list_cosine_similarity("primary", secondary)))) / pi(), 6) AS angle FROM {VEC}""")
def cosine_of_halves(spark, d):
    return vectors(spark, d).select("vec_id", F.round(vf.cosine("primary", "secondary"), 6).alias("cosine"), F.round(vf.angle("primary", "secondary"), 6).alias("angle"))


@register("A18_weighted_centroid", f"SELECT role, round(list_sum(list_transform(c, lambda x: x * x)), 6) AS energy FROM (SELECT role, [" + ", ".join(f'sum("primary"[{i + 1}] * (1 + vec_id % 3)) / sum(1 + vec_id % 3)' for i in range(32)) + f"] AS c FROM {VEC} GROUP BY role)")
def weighted_centroid(spark, d):
    w = (1 + F.col("vec_id") % 3).cast("double")
    c = vectors(spark, d).groupBy("role").agg(vf.mean_vector("primary", 32, w).alias("c"))
    return c.select("role", F.round(vf.total(F.transform("c", lambda x: x * x)), 6).alias("energy"))


@register(
    "V2_profile_score",
    f"""WITH r AS (SELECT "primary" AS v FROM {VEC} WHERE role = 3 AND vec_id % 5 = 0), c AS (SELECT {mean_sql('v')} AS c FROM r),
    s AS (SELECT vec_id, list_cosine_similarity("primary", c) AS a, (SELECT avg(x) FROM (SELECT list_dot_product("primary", v) AS x FROM r ORDER BY x DESC LIMIT 2)) AS b FROM {VEC}, c)
    SELECT vec_id, round(greatest(a, b - 0.02), 6) AS score FROM s""",
)
def profile_score(spark, d):
    """Best of the centroid's cosine and the mean of the two nearest of all references, less 0.02."""
    from cadenza.operators.neighbours import nearest_scores

    v = vectors(spark, d)
    refs = v.where("role = 3 and vec_id % 5 = 0")
    centroid = refs.agg(vf.mean_vector("primary", 32).alias("c"))
    plain = lambda x: x.select("vec_id", F.col("primary").alias("v"))
    s = v.crossJoin(F.broadcast(centroid)).join(nearest_scores(plain(v), plain(refs), 2), "vec_id", "left")  # one row
    near = vf.total("scores") / F.size("scores")
    return s.select("vec_id", F.round(F.greatest(vf.cosine("primary", "c"), near - 0.02), 6).alias("score"))


@register(
    "V3_cohort_z",
    f"""SELECT vec_id, round((own - m) / greatest(s, 0.04), 6) AS z FROM (SELECT vec_id, any_value(own) AS own, avg(x) AS m, stddev_pop(x) AS s FROM (
      SELECT v.vec_id, list_cosine_similarity(v."primary", o.c) AS own, list_cosine_similarity(v."primary", c.c) AS x,
        row_number() OVER (PARTITION BY v.vec_id ORDER BY list_cosine_similarity(v."primary", c.c) DESC) AS r
      FROM {VEC} v JOIN {CENTROIDS} o ON o.role = v.role JOIN {CENTROIDS} c ON c.role <> v.role) WHERE r <= 5 GROUP BY vec_id)""",
)
def cohort_z(spark, d):
    v, c = vectors(spark, d), F.broadcast(centroids(spark, d))
    own = v.join(c, "role").select("vec_id", "role", "primary", vf.cosine("primary", "c").alias("own"))
    others = own.join(c.select(F.col("role").alias("other"), "c"), F.col("other") != F.col("role")).withColumn("x", vf.cosine("primary", "c"))
    s = others.groupBy("vec_id").agg(F.first("own").alias("own"), F.slice(F.sort_array(F.collect_list("x"), False), 1, 5).alias("top"))
    m = vf.total("top") / F.size("top")
    sd = vf.let(m, lambda a: F.sqrt(vf.total(F.transform("top", lambda x: (x - a) * (x - a))) / F.size("top")))
    return s.select("vec_id", F.round((F.col("own") - m) / F.greatest(sd, F.lit(0.04)), 6).alias("z"))


@register(
    "V5_anchor_role",
    f"""SELECT vec_id, role AS best FROM (SELECT v.vec_id, c.role, list_cosine_similarity(v."primary", c.c) AS s, row_number() OVER (PARTITION BY v.vec_id ORDER BY list_cosine_similarity(v."primary", c.c) DESC) AS r,
      lead(list_cosine_similarity(v."primary", c.c)) OVER (PARTITION BY v.vec_id ORDER BY list_cosine_similarity(v."primary", c.c) DESC) AS second FROM {VEC} v, {CENTROIDS} c) WHERE r = 1 AND s - second >= 0.06""",
)
def anchor_role(spark, d):
    """The nearest role, if no other is within the margin."""
    s = vectors(spark, d).crossJoin(F.broadcast(centroids(spark, d).withColumnRenamed("role", "best")))
    scores = s.select("vec_id", "best", vf.cosine("primary", "c").alias("s")).groupBy("vec_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("s", "best")), False), 1, 2).alias("t"))
    return scores.where(F.get("t", 0)["s"] - F.get("t", 1)["s"] >= 0.06).select("vec_id", F.get("t", 0)["best"].alias("best"))


@register(
    "V17_exclusion_votes",
    f"""SELECT v.vec_id, count(*) FILTER (list_cosine_similarity(v."primary", o.c) - list_cosine_similarity(v."primary", c.c) <= 0.02) AS against FROM {VEC} v JOIN {CENTROIDS} o ON o.role = v.role JOIN {CENTROIDS} c ON c.role <> v.role GROUP BY v.vec_id""",
)
def exclusion_votes(spark, d):
    v, c = vectors(spark, d), F.broadcast(centroids(spark, d))
    own = v.join(c, "role").select("vec_id", "role", "primary", vf.cosine("primary", "c").alias("own"))
    o = own.join(c.select(F.col("role").alias("other"), "c"), F.col("other") != F.col("role"))
    return o.groupBy("vec_id").agg(F.count_if(F.col("own") - vf.cosine("primary", "c") <= 0.02).alias("against"))


@register(
    "V16_posterior_weight",
    "SELECT role, round(6.0 / (6 + least(count(*) * 1.5, 3 * count(*))), 6) AS weight FROM (SELECT label AS role FROM embeddings) GROUP BY role",
)
def posterior_weight(spark, d):
    n = F.count("*")
    return fx.table(spark, d, "embeddings").groupBy(F.col("label").alias("role")).agg(F.round(6.0 / (6 + F.least(n * 1.5, n * 3.0)), 6).alias("weight"))


@register(
    "A9_cluster_report",
    f"""SELECT role, count(*) AS n, round(median(s), 6) AS mid, count(*) FILTER (s < m - 0.18) AS outliers FROM (SELECT v.role, list_cosine_similarity("primary", c) AS s,
      median(list_cosine_similarity("primary", c)) OVER (PARTITION BY v.role) AS m FROM {VEC} v JOIN {CENTROIDS} c ON c.role = v.role) GROUP BY role""",
)
def cluster_report(spark, d):
    s = vectors(spark, d).join(F.broadcast(centroids(spark, d)), "role").select("role", vf.cosine("primary", "c").alias("s"))
    mid = s.groupBy("role").agg(F.percentile("s", 0.5).alias("m"))  # one row a role
    out = s.join(F.broadcast(mid), "role").groupBy("role")
    return out.agg(F.count("*").alias("n"), F.round(F.first("m"), 6).alias("mid"), F.count_if(F.col("s") < F.col("m") - 0.18).alias("outliers"))


@register(
    "V15_member_angles",
    f"""SELECT x.role, round(avg(acos(greatest(-1, least(1, list_dot_product(x."primary", y."primary")))) / pi()), 6) AS mean_angle, count(*) AS pairs FROM {VEC} x JOIN {VEC} y ON x.role = y.role AND x.source_id = y.source_id AND x.vec_id < y.vec_id GROUP BY x.role""",
)
def member_angles(spark, d):
    """Of pairs within a role and source, by an equi join."""
    v = vectors(spark, d).select("vec_id", "role", "source_id", "primary")
    w = v.select(F.col("vec_id").alias("other"), "role", "source_id", F.col("primary").alias("b"))
    p = v.join(w, ["role", "source_id"]).where("vec_id < other")
    a = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), vf.dot("primary", "b")))) / F.lit(3.141592653589793)
    return p.groupBy("role").agg(F.round(F.avg(a), 6).alias("mean_angle"), F.count("*").alias("pairs"))


@register("V12_knn_affinity", f"""SELECT vec_id, other, round(exp((s - 1) / 0.15), 6) AS affinity FROM (SELECT x.vec_id, y.vec_id AS other, list_dot_product(x."primary", y."primary") AS s,
  row_number() OVER (PARTITION BY x.vec_id ORDER BY list_dot_product(x."primary", y."primary") DESC, y.vec_id) AS r FROM {VEC} x, {VEC} y WHERE x.vec_id % 100 = 0 AND x.vec_id <> y.vec_id) WHERE r <= 12 AND s > 0.15""")
def knn_affinity(spark, d):
    """Neighbours of every hundredth vector among all, by matrix products of blocks: each task
    holds a block of queries and streams over its vectors, keeping the best 12."""
    from cadenza.operators.neighbours import nearest_vectors

    v = vectors(spark, d).select("vec_id", F.col("primary").alias("v"))
    near = nearest_vectors(v.where("vec_id % 100 = 0"), v, 12, 0.15)
    return near.select("vec_id", "other", F.round(F.exp((F.col("s") - 1) / 0.15), 6).alias("affinity"))


@register("E5_source_groups", f"""WITH RECURSIVE e AS (SELECT DISTINCT source_id AS a, 1000000 + k // 5 * 10 + source_id // 30 AS b FROM {CLICK}), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  r AS (SELECT a AS node, a AS component FROM u UNION SELECT u.b, r.component FROM r JOIN u ON u.a = r.node)
  SELECT node AS source_id, min(component) AS component FROM r WHERE node < 1000000 GROUP BY node""")
def source_groups(spark, d):
    """Sources that share content, directly or by others."""
    s = fx.segments(spark, d, "click")
    e = s.select(F.col("source_id").alias("a"), (1_000_000 + F.floor(F.col("k") / 5) * 10 + F.floor(F.col("source_id") / 30)).alias("b")).distinct()
    return connected_components(e).where("node < 1000000").select(F.col("node").alias("source_id"), "component")


@register("I41_ranked_suppression")
def ranked_suppression(spark, d):
    """Of overlapping purchases the one of larger value is kept, and drops the others."""
    s = fx.segments(spark, d, "purchase").select("segment_id", "source_id", "start_ms", "end_ms", "value")
    p = iv.overlap_join(s, s).where("value > b_value or (value = b_value and segment_id < b_segment_id)")
    lost = greedy.suppress(p.select(F.col("segment_id").alias("better"), F.col("b_segment_id").alias("worse")))
    return s.select("segment_id").join(lost.select(F.col("id").alias("segment_id")), "segment_id", "left_anti")


@register("D3_greedy_vector_dedupe")
def greedy_vector_dedupe(spark, d):
    """By id within a source, a vector goes if an earlier kept one is near in both halves."""
    v = vectors(spark, d).select("vec_id", "source_id", "primary", "secondary")
    w = v.select(F.col("vec_id").alias("worse"), "source_id", F.col("primary").alias("p"), F.col("secondary").alias("q"))
    near = v.join(w, "source_id").where("vec_id < worse").where((vf.dot("primary", "p") >= 0.25) & (vf.dot("secondary", "q") >= 0.1))
    lost = greedy.suppress(near.select(F.col("vec_id").alias("better"), "worse"))
    return v.select("vec_id").join(lost.select(F.col("id").alias("vec_id")), "vec_id", "left_anti")


@register("I25_weighted_schedule")
def weighted_schedule(spark, d):
    return folds.schedule(fx.segments(spark, d).select("segment_id", "source_id", "start_ms", "end_ms"))


@register("I28_merge_with_cap")
def merge_with_cap(spark, d):
    return folds.merge_with_cap(fx.segments(spark, d).select("segment_id", "source_id", "start_ms", "end_ms", "value"), 2 * HOUR, 60 * HOUR)


@register("I32_absorb_short")
def absorb_short(spark, d):
    return folds.absorb_short(fx.segments(spark, d).select("segment_id", "source_id", "start_ms", "end_ms", "value"), 5 * HOUR, 6 * HOUR)


@register("I49_best_segmentation")
def best_segmentation(spark, d):
    return folds.best_segmentation(fx.frames(spark, d).select("clip_id", "frame_idx", (F.col("level") - 0.06).alias("level")), 0.1, 2)


@register("V11_online_clusters")
def online_clusters(spark, d):
    return folds.online_clusters(vectors(spark, d), 0.35)


@register("W10_similarity_drops", f"""SELECT vec_id, round(1 - s, 6) AS fall FROM (SELECT vec_id, list_dot_product("primary", lag("primary") OVER (PARTITION BY source_id ORDER BY start_ms)) AS s FROM {VEC}) WHERE s < 0""")
def similarity_drops(spark, d):
    w = Window.partitionBy("source_id").orderBy("start_ms")
    v = vectors(spark, d).withColumn("before", F.lag("primary").over(w)).where("before is not null").withColumn("s", vf.dot("primary", "before"))
    return v.where("s < 0").select("vec_id", F.round(1 - F.col("s"), 6).alias("fall"))



