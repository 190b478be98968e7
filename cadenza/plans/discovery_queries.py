"""Queries over the voices of sources: margins, purity and order."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import discovery as di
from cadenza.plans.catalogue import register
from cadenza.plans.vector_queries import VEC, mean_sql
from cadenza.sources import fixtures as fx

#: A vector is a member of the voice of its label in its source; windows of a member lie around its margins.
VOICE = "source_id * 1000 + role"


def margins(spark, d, channel):
    v = fx.vectors(spark, d).select("source_id", F.expr(VOICE).alias("cluster_id"), F.col("vec_id").alias("member_id"), F.col(channel).alias("v"))
    return di.centre_margins(v, 32, out=channel).drop("v")


def margins_sql(channel: str) -> str:
    return f"""(SELECT m.source_id, m.cluster_id, m.member_id, max(list_dot_product(m.v, c.c)) FILTER (c.cluster_id = m.cluster_id) AS own, max(list_dot_product(m.v, c.c)) FILTER (c.cluster_id <> m.cluster_id) AS other
      FROM (SELECT source_id, {VOICE} AS cluster_id, vec_id AS member_id, "{channel}" AS v FROM {VEC}) m
      JOIN (SELECT source_id, cluster_id, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM (SELECT source_id, {VOICE} AS cluster_id, {mean_sql(f'"{channel}"')} AS c FROM {VEC} GROUP BY source_id, role)) c USING (source_id)
      GROUP BY m.source_id, m.cluster_id, m.member_id)"""


@register(
    "A9_centre_margins",
    f"""SELECT p.member_id, p.cluster_id, round(p.own, 6) AS primary_own, round(p.other, 6) AS primary_other, round(s.own, 6) AS secondary_own, round(s.other, 6) AS secondary_other, round(least(p.own - p.other, s.own - s.other), 6) AS margin
    FROM {margins_sql("primary")} p JOIN {margins_sql("secondary")} s USING (member_id)""",
)
def centre_margins(spark, d):
    """Each member's own and nearest other voice in both channels, and the lesser margin."""
    both = margins(spark, d, "primary").join(margins(spark, d, "secondary").drop("source_id", "cluster_id"), "member_id")
    rounded = [F.round(c, 6).alias(c) for c in ("primary_own", "primary_other", "secondary_own", "secondary_other")]
    margin = F.when(F.col("primary_margin").isNotNull(), F.least("primary_margin", "secondary_margin"))
    return both.select("member_id", "cluster_id", *rounded, F.round(margin, 6).alias("margin"))


def members(spark, d):
    m = margins(spark, d, "primary")
    return m.select("source_id", "cluster_id", "member_id", (1.0 + 0.75 * (F.col("member_id") % 5)).alias("seconds"), F.col("primary_own").alias("score"), F.col("primary_margin").alias("margin"), (F.col("primary_own") < 0.3).alias("outlier"))


def windows(members):
    w = members.select("*", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("w"))
    known = F.col("member_id") % 7 != 0
    return w.select(
        "cluster_id",
        (F.col("member_id") % 3 == 0).alias("own"),
        (F.col("margin") >= 0.02 + 0.1 * F.col("w")).alias("accepted"),
        (F.col("member_id") % 5 == 0).alias("demoted"),
        F.when(known, F.col("margin") - 0.05 * F.col("w")).alias("cm_p"),
        F.when(known, F.col("margin") - 0.1 * F.col("w")).alias("cm_s"),
    )


PURITY = f"""m AS MATERIALIZED (SELECT source_id, cluster_id, member_id, 1.0 + 0.75 * (member_id % 5) AS seconds, own AS score, own - other AS margin, coalesce(own < 0.3, false) AS outlier FROM {margins_sql("primary")}),
  w AS (SELECT cluster_id, member_id % 3 = 0 AS own, coalesce(margin >= 0.02 + 0.1 * w, false) AS accepted, member_id % 5 = 0 AS demoted, CASE WHEN member_id % 7 <> 0 THEN margin - 0.05 * w END AS cm_p, CASE WHEN member_id % 7 <> 0 THEN margin - 0.1 * w END AS cm_s FROM m, (SELECT unnest([0, 1, 2]) AS w)),
  f AS (SELECT cluster_id, avg(CAST(failed AS INT)) AS failure FROM (SELECT cluster_id, CASE WHEN own THEN NOT accepted WHEN cm_p IS NOT NULL AND cm_s IS NOT NULL THEN NOT accepted AND (cm_p < -0.02 OR cm_s < -0.05) WHEN NOT demoted THEN NOT accepted END AS failed FROM w) GROUP BY cluster_id),
  a AS (SELECT source_id, cluster_id, count(*) AS n_members, CAST(sum(seconds) AS DOUBLE) AS seconds, avg(score) AS cohesion, median(score) AS center, avg(CAST(outlier AS INT)) AS outlier_ratio, median(margin) AS distinct_margin, coalesce(any_value(failure), 0) AS failure
    FROM m LEFT JOIN f USING (cluster_id) GROUP BY source_id, cluster_id),
  s AS (SELECT *, list_filter([CASE WHEN cohesion < 0.4 THEN 'low_cohesion' END, CASE WHEN outlier_ratio > 0.25 THEN 'many_outliers' END, CASE WHEN distinct_margin < -0.02 THEN 'competing_clusters' END, CASE WHEN failure > 0.45 THEN 'unstable_local_identity' END], lambda x: x IS NOT NULL) AS flags FROM a),
  p AS (SELECT *, least(1, greatest(0, (cohesion + center) / 2 * (1 - least(0.8, outlier_ratio)) * (1 - 0.4 * failure))) * CASE WHEN len(flags) > 0 THEN 0.65 ELSE 1 END AS purity FROM s)"""


def purity(spark, d):
    m = members(spark, d)
    return di.cluster_purity(m, windows(m))


@register("A11_voice_purity", f"""WITH {PURITY} SELECT cluster_id, n_members, round(cohesion, 6) AS cohesion, round(outlier_ratio, 6) AS outlier_ratio, round(coalesce(distinct_margin, 0), 6) AS distinctiveness, round(failure, 6) AS failure_ratio, array_to_string(flags, ',') AS flags, round(purity, 6) AS purity FROM p""")
def voice_purity(spark, d):
    """Purity of each voice of a source, with failed windows and the signs of a mixed one."""
    rounded = [F.round(c, 6).alias(c) for c in ("cohesion", "outlier_ratio", "distinctiveness", "failure_ratio", "purity")]
    return purity(spark, d).select("cluster_id", "n_members", F.array_join("flags", ",").alias("flags"), *rounded)


@register("A12_discovered_voices", f"""WITH {PURITY} SELECT source_id, cluster_id, n_members, seconds, CAST(row_number() OVER (PARTITION BY source_id ORDER BY len(flags) > 0, round(purity, 9) DESC, round(coalesce(distinct_margin, 0), 9) DESC, seconds DESC, cluster_id) AS INTEGER) AS place FROM p WHERE n_members >= 3 AND seconds >= 8""")
def discovered_voices(spark, d):
    """Voices of at least three members and eight seconds, the purest unmixed ones first."""
    p = purity(spark, d).withColumns({"purity": F.round("purity", 9), "distinctiveness": F.round("distinctiveness", 9)})
    return di.discovered_voices(p).select("source_id", "cluster_id", "n_members", "seconds", "place")
