"""How pure the voices of a source are, and in which order they are shown.

A member is held against the centres of all voices of its source; a voice's purity is its members' closeness to
their centre, less for outliers and for windows that failed, and it is mixed if any of four signs says so.  Medians are by
sorted ranges of all values, so a voice that holds a third of all members is many tasks; else there are sums and counts alone.

members: source_id, cluster_id (unique over sources), member_id, seconds, and score, margin, outlier, each of which may be null.
windows: cluster_id, own (whether the window is a certificate of the voice itself; else it was judged against the
target), accepted, demoted, cm_p, cm_s (margins to competitors).  Null flags are false, null seconds 0, and NaN is as null;
a member without a cluster falls out; a voice without windows has no failures; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import vectors as vf
from cadenza.operators.evaluation import group_quantiles

# Limits of the four signs, and what outliers, failures and a mixed voice take off.
LEAST_COHESION, MOST_OUTLIERS, LEAST_DISTINCT, MOST_FAILURES = 0.40, 0.25, -0.02, 0.45
OUTLIERS_CAP, FAILURE_WEIGHT, MIXED_FACTOR = 0.8, 0.4, 0.65
COMPETES_PRIMARY, COMPETES_SECONDARY = -0.02, -0.05
LEAST_MEMBERS, LEAST_SECONDS = 3, 8.0

FLAGS = ("low_cohesion", "many_outliers", "competing_clusters", "unstable_local_identity")


def _finite(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def centre_margins(turns: DataFrame, width: int, vector: str = "v", out: str = "primary") -> DataFrame:
    """turns: source_id, cluster_id, member_id and a unit vector.  Adds <out>_own, the cosine to the centre of its own voice,
    <out>_other, the largest to another voice of the source (null if there is none), and <out>_margin.  A source's centres
    come to its turns as one array, a row a voice, so a turn isn't joined with voices one by one."""
    known = turns.where("source_id is not null and cluster_id is not null")
    centres = known.groupBy("source_id", "cluster_id").agg(vf.unit(vf.mean_vector(vector, width)).alias("c"))
    each = centres.where("c is not null").groupBy("source_id").agg(F.collect_list(F.struct("cluster_id", "c")).alias("_centres"))
    sims = F.transform("_centres", lambda x: F.struct((x["cluster_id"] == F.col("cluster_id")).alias("own"), vf.dot(vector, x["c"]).alias("s")))
    seen = known.join(each, "source_id", "left").withColumn("_sims", sims)
    best = lambda own: F.array_max(F.transform(F.filter("_sims", lambda x: x["own"] == F.lit(own)), lambda x: x["s"]))
    found = seen.withColumns({f"{out}_own": best(True), f"{out}_other": best(False)})
    return found.withColumn(f"{out}_margin", F.col(f"{out}_own") - F.col(f"{out}_other")).drop("_centres", "_sims")


def window_failed(own: Column, accepted: Column, demoted: Column, cm_p: Column, cm_s: Column) -> Column:
    """Whether a window speaks against its voice; null where it says nothing.  Judged against the target, one that missed its
    floor counts only if a competitor is ahead, or, where competitors weren't measured, if it wasn't demoted."""
    missed = ~accepted
    ahead = missed & ((cm_p < COMPETES_PRIMARY) | (cm_s < COMPETES_SECONDARY))
    return F.when(own, missed).when(cm_p.isNotNull() & cm_s.isNotNull(), ahead).when(~demoted, missed)


def cluster_purity(members: DataFrame, windows: DataFrame) -> DataFrame:
    """source_id, cluster_id, n_members, seconds, cohesion and center (mean and median of the members' scores, 0 without any),
    outlier_ratio, distinctiveness (median margin, 0 without any), failure_ratio, flags (in the order of FLAGS), mixed, purity."""
    m = members.where("cluster_id is not null").withColumns({"_score": _finite("score"), "_margin": _finite("margin")})
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    sums = m.groupBy("source_id", "cluster_id").agg(
        F.count("*").alias("n_members"),
        F.coalesce(F.sum(_finite("seconds")), F.lit(0.0)).alias("seconds"),
        F.coalesce(F.avg("_score"), F.lit(0.0)).alias("cohesion"),
        F.avg(flag("outlier").cast("double")).alias("outlier_ratio"),
        (F.count("_margin") > 0).alias("_rivals"),
    )
    failed = window_failed(flag("own"), flag("accepted"), flag("demoted"), _finite("cm_p"), _finite("cm_s"))
    failures = windows.groupBy("cluster_id").agg(F.avg(failed.cast("double")).alias("failure_ratio"))
    out = sums.join(group_quantiles(m, "cluster_id", "_score", 0.5, "center"), "cluster_id", "left")
    out = out.join(group_quantiles(m, "cluster_id", "_margin", 0.5, "distinctiveness"), "cluster_id", "left").join(failures, "cluster_id", "left")
    out = out.fillna(0.0, ["center", "distinctiveness", "failure_ratio"])
    signs = (
        F.col("cohesion") < LEAST_COHESION,
        F.col("outlier_ratio") > MOST_OUTLIERS,
        F.col("_rivals") & (F.col("distinctiveness") < LEAST_DISTINCT),
        F.col("failure_ratio") > MOST_FAILURES,
    )
    out = out.withColumn("flags", F.array_compact(F.array(*[F.when(sign, name) for sign, name in zip(signs, FLAGS, strict=True)])))
    close = (F.col("cohesion") + F.col("center")) / 2
    pure = close * (1 - F.least(F.lit(OUTLIERS_CAP), "outlier_ratio")) * (1 - FAILURE_WEIGHT * F.col("failure_ratio"))
    mixed = F.size("flags") > 0
    purity = F.least(F.lit(1.0), F.greatest(F.lit(0.0), pure)) * F.when(mixed, MIXED_FACTOR).otherwise(1.0)
    return out.withColumns({"mixed": mixed, "purity": purity}).drop("_rivals")


def discovered_voices(purity: DataFrame, least_members: int = LEAST_MEMBERS, least_seconds: float = LEAST_SECONDS) -> DataFrame:
    """The voices with enough members and speech, with place, their rank in the source: unmixed first, then by purity,
    distinctiveness and seconds, the largest first, and by cluster_id.  One row a voice is ranked."""
    order = Window.partitionBy("source_id").orderBy("mixed", F.desc("purity"), F.desc("distinctiveness"), F.desc("seconds"), "cluster_id")
    enough = purity.where((F.col("n_members") >= least_members) & (F.col("seconds") >= least_seconds))
    return enough.withColumn("place", F.row_number().over(order))
