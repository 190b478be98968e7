"""Canonical tables of timed segments, derived from the star-schema test tables.

Each function reads its table whole.  `*_SQL` are the same tables as DuckDB expressions.
Times are integer milliseconds since 2024-01-01, so interval arithmetic is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """segment_id, source_id, start_ms, end_ms, kind, k, value; of one kind where asked for."""
    e = table(spark, sf_dir, "events")
    if kind:
        e = e.where(F.col("event_type") == kind)
    start = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    length = F.bround(F.col("value") * 100).cast("long") * 6000
    return e.select(
        F.col("event_id").alias("segment_id"),
        F.col("user_id").alias("source_id"),
        start.alias("start_ms"),
        (start + length).alias("end_ms"),
        F.col("event_type").alias("kind"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        "value",
    ).where("end_ms > start_ms")


SEGMENTS_SQL = """(SELECT event_id AS segment_id, user_id AS source_id, (epoch_us(ts) - 1704067200000000) // 1000 AS start_ms,
  (epoch_us(ts) - 1704067200000000) // 1000 + CAST(round_even(value * 100, 0) AS BIGINT) * 6000 AS end_ms, event_type AS kind,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, value FROM events
  WHERE CAST(round_even(value * 100, 0) AS BIGINT) > 0)"""


def segments_sql(kind: str | None = None) -> str:
    return f"(SELECT * FROM {SEGMENTS_SQL} WHERE kind = '{kind}')" if kind else SEGMENTS_SQL


#: Review labels, by k modulo 6.
LABELS = ("correct", "partial", "wrong", "singing", "overlap", "skip")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segment_id, label, grade: a deterministic review of every second segment."""
    s = segments(spark, sf_dir).where("k % 2 = 0")
    names = F.array(*[F.lit(x) for x in LABELS])
    return s.select(
        "segment_id",
        F.get(names, (F.col("k") % 6).cast("int")).alias("label"),
        F.when(F.col("k") % 5 == 0, "Gold").when(F.col("k") % 5 < 3, "Silver").when(F.col("k") % 5 == 3, "Review").alias("grade"),
    )


REVIEWS_SQL = f"""(SELECT segment_id, list_extract({list(LABELS)!r}, CAST(k % 6 AS INTEGER) + 1) AS label,
  CASE WHEN k % 5 = 0 THEN 'Gold' WHEN k % 5 < 3 THEN 'Silver' WHEN k % 5 = 3 THEN 'Review' END AS grade
  FROM {SEGMENTS_SQL} WHERE k % 2 = 0)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, frame_idx, level: events of a user in time order as frames of a clip."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("clip_id"), F.row_number().over(order).alias("frame_idx"), (F.col("value") / 500).alias("level")
    )


FRAMES_SQL = """(SELECT user_id AS clip_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_idx,
  value / 500 AS level FROM events)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, source_id, start_ms, role, primary and secondary: unit halves of the embedding."""
    from cadenza.functions.vectors import unit

    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id",
        F.expr("vec_id div 50").alias("source_id"),  # so that sources grow in number, not in size
        (F.col("vec_id") * 1000).alias("start_ms"),
        F.col("label").alias("role"),
        unit(F.slice("embedding", 1, 32)).alias("primary"),
        unit(F.slice("embedding", 33, 32)).alias("secondary"),
    )


def _unit_sql(a: int, b: int) -> str:
    part = f"list_transform(embedding[{a}:{b}], lambda x: CAST(x AS DOUBLE))"
    return f"list_transform({part}, lambda x: x / sqrt(list_sum(list_transform({part}, lambda y: y * y))))"


VECTORS_SQL = f"""(SELECT vec_id, vec_id // 50 AS source_id, vec_id * 1000 AS start_ms, label AS role,
  {_unit_sql(1, 32)} AS "primary", {_unit_sql(33, 64)} AS secondary FROM embeddings)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, turn, start_ms, end_ms, seconds, voice, primary, secondary, role, usable: each vector as a
    speaking turn, drawn towards the mean of its label, so that a source has voices; of some the
    role is known."""
    from cadenza.functions.vectors import mean_vector, unit

    v = vectors(spark, sf_dir)
    means = v.groupBy("role").agg(mean_vector("primary", 32).alias("p"), mean_vector("secondary", 32).alias("s"))  # one row a label
    near = v.join(means.select("role", unit("p").alias("p"), unit("s").alias("s")), "role")
    drawn = lambda mean, own: unit(F.zip_with(mean, own, lambda a, b: a + 0.8 * b))
    known = F.when(F.col("role") == 0, "target").when(F.col("role").isin(1, 2), F.concat(F.lit("guest"), "role"))
    return near.select(
        "source_id",
        F.col("vec_id").alias("turn"),
        F.col("start_ms"),
        (F.col("start_ms") + 400 + 50 * (F.col("vec_id") % 5)).alias("end_ms"),
        (1.0 + 0.75 * (F.col("vec_id") % 5)).alias("seconds"),
        F.col("role").alias("voice"),
        drawn("p", "primary").alias("primary"),
        drawn("s", "secondary").alias("secondary"),
        F.when(F.col("vec_id") % 4 == 0, known).alias("role"),
        (F.col("vec_id") % 23 != 0).alias("usable"),
    )
