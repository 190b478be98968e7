"""Queries of order-dependent folds and of clusters and choices within a source."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import clusters, folds
from cadenza.plans.catalogue import register
from cadenza.plans.vector_queries import vectors
from cadenza.sources import fixtures as fx

HOUR, MIN = 3_600_000, 60_000
ID = ["segment_id", "source_id", "start_ms", "end_ms"]


def rows(spark, d, kind=None):
    return fx.segments(spark, d, kind).select(*ID, "value")


@register("D9_fold_cues")
def fold_cues(spark, d):
    s = fx.segments(spark, d).select(*ID, F.concat("kind", F.lit(" "), F.col("k").cast("string")).alias("text"))
    return folds.fold_cues(s, 2 * HOUR)


@register("I42_replace_overlaps")
def replace_overlaps(spark, d):
    return folds.replace_overlaps(rows(spark, d), HOUR)


@register("I51_spaced_splits")
def spaced_splits(spark, d):
    return folds.space_out(rows(spark, d, "purchase"), 20 * HOUR)


@register("I53_split_long")
def split_long(spark, d):
    """Rows over 30 hours, cut in the gaps between words of five hours with one between."""
    step = 6 * HOUR
    starts = F.sequence(F.col("start_ms"), F.greatest(F.col("start_ms"), F.col("end_ms") - step), F.lit(step))
    words = F.transform(starts, lambda s: F.struct(s.alias("start_ms"), (s + step - HOUR).alias("end_ms")))
    return folds.split_long(rows(spark, d, "view").withColumn("words", words), 30 * HOUR, 10 * HOUR)


@register("V8_agglomerate")
def agglomerate(spark, d):
    return clusters.agglomerate(vectors(spark, d), 0.2, -0.3)


@register("T5_farthest_points")
def farthest_points(spark, d):
    return clusters.farthest_points(vectors(spark, d).withColumn("quality", 1 + (F.col("vec_id") % 7) / 7), 8)


@register("T7_determinant_order")
def determinant_order(spark, d):
    return clusters.determinant_order(vectors(spark, d).withColumn("quality", 1 + (F.col("vec_id") % 7) / 7), 16)
