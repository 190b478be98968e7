"""Queries of certificates, promotions and transcript checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions import text as tf
from cadenza.functions import vectors as vf
from cadenza.operators import intervals as iv
from cadenza.plans.catalogue import register
from cadenza.plans.policy_queries import SCORED, case, case_sql, scored
from cadenza.plans.sql import BUY, CLICK, ERR, SEG, VIEW, pairs
from cadenza.plans.text_queries import PARTS, parts, turns
from cadenza.plans.vector_queries import CENTROIDS, VEC, centroids, vectors
from cadenza.sources import fixtures as fx

HOUR = 3_600_000
ID = ["segment_id", "source_id", "start_ms", "end_ms"]


@register("X13_complete_timing", rf"""SELECT p.conv_id, p.turn, regexp_replace(string_agg(sentence, '' ORDER BY i), '\s', '', 'g') = regexp_replace(any_value(text), '\s', '', 'g') AS complete FROM {PARTS} p JOIN conversations c ON c.conv_id = p.conv_id AND c.turn = p.turn GROUP BY p.conv_id, p.turn""")
def complete_timing(spark, d):
    """Whether the timed pieces, in order, hold the whole text of the turn."""
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("i", "sentence"))), lambda x: x["sentence"])
    joined = parts(spark, d).groupBy("conv_id", "turn").agg(F.array_join(pieces, "").alias("joined"))
    squeeze = lambda c: F.regexp_replace(c, "\\s", "")
    return joined.join(turns(spark, d), ["conv_id", "turn"]).select("conv_id", "turn", (squeeze("joined") == squeeze("text")).alias("complete"))


@register("X14_slice_of_text", rf"""SELECT conv_id, turn, substr(regexp_replace(text, '\s', '', 'g'), 11, 20) AS piece FROM conversations""")
def slice_of_text(spark, d):
    return turns(spark, d).select("conv_id", "turn", F.substring(F.regexp_replace("text", "\\s", ""), 11, 20).alias("piece"))


@register("X17_real_words", f"SELECT source_id, count(*) AS n, string_agg(CAST(start_ms AS VARCHAR), ',' ORDER BY start_ms, segment_id) AS starts FROM {CLICK} WHERE k % 4 <> 0 GROUP BY source_id")
def real_words(spark, d):
    """Measured words of each source in order; estimated ones fall out."""
    s = fx.segments(spark, d, "click").where("k % 4 <> 0")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("start_ms", "segment_id"))), lambda x: x["start_ms"].cast("string"))
    return s.groupBy("source_id").agg(F.count("*").alias("n"), F.array_join(ordered, ",").alias("starts"))


@register("X20_quality_weights", f"SELECT segment_id, round(a / (a + b + c), 6) AS w1, round(b / (a + b + c), 6) AS w2 FROM (SELECT segment_id, ln(1 + exp(0.8 * first + 0.1)) AS a, ln(1 + exp(0.5 * second - 0.2)) AS b, ln(1 + exp(0.3 * paired)) AS c FROM {SCORED})")
def quality_weights(spark, d):
    """Softplus of a linear form for each channel, brought to a sum of one."""
    forms = (("first", 0.8, 0.1), ("second", 0.5, -0.2), ("paired", 0.3, 0.0))
    soft = F.array(*[F.log1p(F.exp(k * F.col(c).cast("double") + b)) for c, k, b in forms])
    s = scored(spark, d).select("segment_id", vf.let(soft, lambda a: F.transform(a, lambda x: x / vf.total(a))).alias("w"))
    return s.select("segment_id", F.round(F.get("w", 0), 6).alias("w1"), F.round(F.get("w", 1), 6).alias("w2"))


CERTIFICATES = (("union", "k % 6 = 0"), ("copied", "k % 6 = 1"), ("exact", "first >= 0.3"))


@register("F16_exact_certificate", f"SELECT segment_id, {case_sql(CERTIFICATES, 'none')} AS authority FROM {SCORED}")
def exact_certificate(spark, d):
    """Copied or united audits don't count, whatever their scores."""
    return scored(spark, d).select("segment_id", case(CERTIFICATES, "none").alias("authority"))


SECOND = (("not_clean", "k % 5 = 0"), ("duration", "seconds < 0.5"), ("floor", "second < least(0.5, first + 0.2)"), ("gain", "second - first < 0.05"))


@register("F32_second_channel", f"SELECT segment_id, {case_sql(SECOND, 'rescued')} AS outcome FROM {SCORED}")
def second_channel(spark, d):
    return scored(spark, d).select("segment_id", case(SECOND, "rescued").alias("outcome"))


@register("F30_short_tails", f"SELECT segment_id FROM {SCORED} s WHERE seconds BETWEEN 0.2 AND 1.2 AND first > 0.1 AND segment_id NOT IN (SELECT x.segment_id FROM {pairs(SEG, ERR)} AND x.segment_id <> y.segment_id) AND EXISTS (SELECT 1 FROM {VIEW} v WHERE v.source_id = s.source_id AND v.start_ms <= s.start_ms AND v.end_ms >= s.end_ms)")
def short_tails(spark, d):
    """Short rows inside a confirmed row, with no blocked overlap but themselves."""
    s = scored(spark, d).where("seconds between 0.2 and 1.2 and first > 0.1").select(*ID)
    blocked = iv.overlap_join(s, fx.segments(spark, d, "error").select(*ID)).where("segment_id <> b_segment_id").select("segment_id").distinct()
    inside = iv.overlap_join(s, fx.segments(spark, d, "view").select(*ID)).where("b_start_ms <= start_ms and b_end_ms >= end_ms").select("segment_id").distinct()
    return inside.join(blocked, "segment_id", "left_anti")


@register("J25_edge_candidates", f"""SELECT segment_id, prev_id, next_id FROM (SELECT a.segment_id, (SELECT b.segment_id FROM {BUY} b WHERE b.source_id = a.source_id AND b.start_ms < a.start_ms AND a.start_ms - b.start_ms <= {60 * HOUR} ORDER BY b.start_ms DESC, b.segment_id DESC LIMIT 1) AS prev_id,
  (SELECT b.segment_id FROM {BUY} b WHERE b.source_id = a.source_id AND b.start_ms > a.start_ms AND b.start_ms - a.start_ms <= {60 * HOUR} ORDER BY b.start_ms, b.segment_id LIMIT 1) AS next_id FROM {CLICK} a) WHERE prev_id IS NOT NULL OR next_id IS NOT NULL""")
def edge_candidates(spark, d):
    """The nearest row of the other track on each side within the limit, by two as-of lookups."""
    a = fx.segments(spark, d, "click").select("source_id", "start_ms", "segment_id", F.lit(None).cast("struct<t:bigint,id:bigint>").alias("b"))
    b = fx.segments(spark, d, "purchase").select("source_id", "start_ms", F.lit(None).cast("long").alias("segment_id"), F.struct(F.col("start_ms").alias("t"), F.col("segment_id").alias("id")).alias("b"))
    w = Window.partitionBy("source_id").orderBy("start_ms")
    before = F.last("b", True).over(w.rangeBetween(Window.unboundedPreceding, -1))
    after = F.first("b", True).over(w.rangeBetween(1, Window.unboundedFollowing))
    u = a.unionByName(b).withColumns({"p": before, "n": after}).where("segment_id is not null")
    limit = 60 * HOUR
    out = u.select("segment_id", F.when(F.col("start_ms") - F.col("p.t") <= limit, F.col("p.id")).alias("prev_id"), F.when(F.col("n.t") - F.col("start_ms") <= limit, F.col("n.id")).alias("next_id"))
    return out.where("prev_id is not null or next_id is not null")


@register("J27_attach_by_counter", f"""SELECT a.segment_id, b.segment_id AS clip_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start_ms, segment_id) AS n FROM {CLICK}) a JOIN (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start_ms, segment_id) AS n FROM {VIEW}) b
  ON a.source_id = b.source_id AND a.n = b.n AND abs(a.start_ms - b.start_ms) <= {40 * HOUR}""")
def attach_by_counter(spark, d):
    w = Window.partitionBy("source_id").orderBy("start_ms", "segment_id")
    numbered = lambda k: fx.segments(spark, d, k).withColumn("n", F.row_number().over(w))
    b = numbered("view").select("source_id", "n", F.col("start_ms").alias("t"), F.col("segment_id").alias("clip_id"))
    return numbered("click").join(b, ["source_id", "n"]).where(F.abs(F.col("start_ms") - F.col("t")) <= 40 * HOUR).select("segment_id", "clip_id")


@register("J28_manual_override", f"SELECT s.segment_id, CASE WHEN r.segment_id IS NOT NULL AND s.k % 4 = 0 THEN r.label ELSE s.kind END AS label FROM {SEG} s LEFT JOIN {fx.REVIEWS_SQL} r USING (segment_id)")
def manual_override(spark, d):
    """An override counts only while its digest (here: of k) is the row's."""
    s, r = fx.segments(spark, d), fx.reviews(spark, d).select("segment_id", "label", F.lit(0).cast("long").alias("digest"))
    s = s.withColumn("digest", F.col("k") % 4)
    return s.join(r, ["segment_id", "digest"], "left").select("segment_id", F.coalesce("label", "kind").alias("label"))


@register("J32_four_way_support", f"""SELECT a.source_id, count(*) AS common, round(max(least(a.v, b.v, c.v, e.v)), 6) AS best FROM (SELECT source_id, k, max(value) AS v FROM {CLICK} GROUP BY source_id, k) a JOIN (SELECT source_id, k, max(value) AS v FROM {VIEW} GROUP BY source_id, k) b USING (source_id, k)
  JOIN (SELECT source_id, k, max(value) AS v FROM {SEG} GROUP BY source_id, k) c USING (source_id, k) JOIN (SELECT source_id, k, min(value) AS v FROM {SEG} GROUP BY source_id, k) e USING (source_id, k) GROUP BY a.source_id""")
def four_way_support(spark, d):
    """Common references of four scores, by aggregates of one exchange each side."""
    s = fx.segments(spark, d)
    g = s.groupBy("source_id", "k").agg(
        F.max(F.when(F.col("kind") == "click", F.col("value"))).alias("a"), F.max(F.when(F.col("kind") == "view", F.col("value"))).alias("b"), F.max("value").alias("c"), F.min("value").alias("e")
    )
    both = g.where("a is not null and b is not null")
    return both.groupBy("source_id").agg(F.count("*").alias("common"), F.round(F.max(F.least("a", "b", "c", "e")), 6).alias("best"))


@register("V18_cluster_promotion", f"""SELECT role, count(*) FILTER (s >= 0.2) AS near, count(*) FILTER (s >= 0.2) >= 3 AND count(*) FILTER (s >= 0.2) >= 0.1 * count(*) AS promoted FROM (SELECT v.role, list_cosine_similarity(v.secondary, c.c) AS s FROM {VEC} v JOIN {CENTROIDS} c USING (role)) GROUP BY role""")
def cluster_promotion(spark, d):
    s = vectors(spark, d).join(F.broadcast(centroids(spark, d)), "role").select("role", vf.cosine("secondary", "c").alias("s"))
    near = F.count_if(F.col("s") >= 0.2)
    return s.groupBy("role").agg(near.alias("near"), ((near >= 3) & (near >= 0.1 * F.count("*"))).alias("promoted"))


@register("V25_three_model_exclusion", f"""SELECT vec_id, count(*) FILTER (votes >= 2) AS rejecting FROM (SELECT v.vec_id, c.role, CAST(list_cosine_similarity(v."primary", o.c) - list_cosine_similarity(v."primary", c.c) <= 0.02 AS INT) + CAST(list_cosine_similarity(v.secondary, o.c) - list_cosine_similarity(v.secondary, c.c) <= 0.02 AS INT)
  + CAST(list_dot_product(v."primary", o.c) - list_dot_product(v."primary", c.c) <= 0.02 AS INT) AS votes FROM {VEC} v JOIN {CENTROIDS} o ON o.role = v.role JOIN {CENTROIDS} c ON c.role <> v.role) GROUP BY vec_id""")
def three_model_exclusion(spark, d):
    """Roles against which two of three margins are missing."""
    v, c = vectors(spark, d), F.broadcast(centroids(spark, d))  # one row a role
    own = v.join(c.withColumnRenamed("c", "o"), "role")
    p = own.join(c.select(F.col("role").alias("other"), "c"), F.col("other") != F.col("role"))
    low = lambda x: (x <= 0.02).cast("int")
    votes = low(vf.cosine("primary", "o") - vf.cosine("primary", "c")) + low(vf.cosine("secondary", "o") - vf.cosine("secondary", "c")) + low(vf.dot("primary", "o") - vf.dot("primary", "c"))
    return p.groupBy("vec_id").agg(F.count_if(votes >= 2).alias("rejecting"))


@register("X7_clean_dialogue", r"""SELECT doc_id, CASE WHEN regexp_matches(t, '[♪♫♬]') THEN '' ELSE trim(regexp_replace(regexp_replace(t, '(?m)^\s*(\([^)]*\)|\[[^\]]*\]|[A-Z][0-9A-Za-z_ .]{0,20}:)\s*', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') END AS line
  FROM (SELECT doc_id, regexp_replace(substr(text, 1, 300), '\{[^}]*\}|<[^>]*>', '', 'g') AS t FROM documents WHERE NOT regexp_matches(substr(text, 1, 300), '(?m)^\s*[-–—]'))""")
def clean_dialogue(spark, d):
    docs = fx.table(spark, d, "documents").where(~F.substring("text", 1, 300).rlike("(?m)^\\s*[-–—]"))
    return docs.select("doc_id", tf.clean_dialogue(F.substring("text", 1, 300)).alias("line"))


@register("X7_clean_dialogue_whole")
def clean_dialogue_whole(spark, d):
    """Whole texts and every document; the SQL twin of X7_clean_dialogue states a prefix and
    leaves out dash-led texts."""
    return fx.table(spark, d, "documents").select("doc_id", tf.clean_dialogue(F.col("text")).alias("line"))
