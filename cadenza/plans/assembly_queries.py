"""Queries of assembled sentences, installations, replay and selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions import text as tf
from cadenza.operators import assembly, evaluation, selection
from cadenza.operators import intervals as iv
from cadenza.plans.catalogue import register
from cadenza.plans.sql import BUY, CLICK, ERR, SEG, VIEW, merged, pairs, subtracted
from cadenza.plans.text_queries import PARTS, lcs_ratio, parts, turns
from cadenza.plans.vector_queries import vectors
from cadenza.sources import fixtures as fx

HOUR = 3_600_000
ID = ["segment_id", "source_id", "start_ms", "end_ms"]


def seg(spark, d, kind=None, *more):
    return fx.segments(spark, d, kind).select(*ID, *more)


@register("W1_ordinals", f"SELECT segment_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY start_ms, segment_id) AS INTEGER) AS ordinal FROM {SEG}")
def ordinals(spark, d):
    """From 1, in the order of time within each source."""
    return seg(spark, d).select("segment_id", F.row_number().over(Window.partitionBy("source_id").orderBy("start_ms", "segment_id")).alias("ordinal"))


A, B = merged(CLICK), merged(VIEW)
NUMBERED = f"(SELECT row_number() OVER () AS segment_id, * FROM {A})"


@register(
    "U2_interval_sets",
    f"""SELECT 'union' AS op, source_id, start_ms, end_ms FROM {merged(f"(SELECT source_id, start_ms, end_ms FROM {CLICK} UNION ALL SELECT source_id, start_ms, end_ms FROM {VIEW})")}
    UNION ALL SELECT 'intersect', x.source_id, greatest(x.start_ms, y.start_ms), least(x.end_ms, y.end_ms) FROM {pairs(A, B)}
    UNION ALL SELECT 'except', source_id, start_ms, end_ms FROM {subtracted(NUMBERED, B)}""",
)
def interval_sets(spark, d):
    """Union, intersection and difference of two tracks, as sets of points."""
    a, b = seg(spark, d, "click").drop("segment_id"), seg(spark, d, "view").drop("segment_id")
    x, y = iv.merge(a), iv.merge(b)
    span = ["source_id", "start_ms", "end_ms"]
    of = lambda op, df: df.select(F.lit(op).alias("op"), *span)
    return of("union", iv.merge(a.unionByName(b))).unionByName(of("intersect", iv.intersect(x, y))).unionByName(of("except", iv.subtract(x, y)))


@register(
    "A15_physical_quality",
    f"""SELECT clip_id, count(*) AS n, round(any_value(snr), 6) AS snr_db, round(avg(CASE WHEN e > greatest(1e-8, high * 0.01) THEN 1.0 ELSE 0.0 END), 6) AS voiced FROM (
      SELECT clip_id, level * level AS e FROM {fx.FRAMES_SQL}) JOIN (SELECT clip_id, high, 10 * log10(greatest(high, 1e-12) / greatest(low, 1e-12)) AS snr FROM (
      SELECT clip_id, quantile_cont(level * level, 0.1) AS low, quantile_cont(level * level, 0.9) AS high FROM {fx.FRAMES_SQL} GROUP BY clip_id)) USING (clip_id) GROUP BY clip_id""",
)
def physical_quality(spark, d):
    """Signal to noise from the 0.9 and 0.1 quantiles of a clip's frame energies, and the share of
    frames above a hundredth of the loud ones."""
    f = fx.frames(spark, d).select("clip_id", (F.col("level") * F.col("level")).alias("e"))
    q = f.groupBy("clip_id").agg(F.percentile("e", 0.1).alias("low"), F.percentile("e", 0.9).alias("high"))
    floor = lambda c: F.greatest(F.col(c), F.lit(1e-12))
    q = q.withColumn("snr", 10 * F.log10(floor("high") / floor("low")))
    voiced = F.avg(F.when(F.col("e") > F.greatest(F.lit(1e-8), F.col("high") * 0.01), 1.0).otherwise(0.0))
    return f.join(q, "clip_id").groupBy("clip_id").agg(F.count("*").alias("n"), F.round(F.first("snr"), 6).alias("snr_db"), F.round(voiced, 6).alias("voiced"))


@register(
    "X3_infer_language",
    r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[\x{3040}-\x{30ff}]') THEN 'ja' WHEN r IN ('chinese', 'mandarin') THEN 'zh' WHEN r IN ('japanese', 'ja') THEN 'ja'
    WHEN regexp_matches(text, '[\x{4e00}-\x{9fff}]') THEN 'zh' ELSE r END AS language FROM (SELECT doc_id, coalesce(text, '') AS text, lower(coalesce(nullif(lang, ''), 'auto')) AS r FROM documents)""",
)
def infer_language(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", tf.infer_language(F.col("text"), F.col("lang")).alias("language"))


FRAGMENTS = f"(SELECT c.conv_id, c.turn, any_value(c.text) AS text, list(p.sentence ORDER BY p.i) AS f FROM conversations c JOIN {PARTS} p ON p.conv_id = c.conv_id AND p.turn = c.turn GROUP BY c.conv_id, c.turn)"


@register(
    "X15_text_cuts",
    rf"""SELECT conv_id, turn, CASE WHEN regexp_replace(array_to_string(f, ''), '[ \t\n\x0B\f\r]', '', 'g') = regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g') THEN array_to_string(list_concat(list_concat([0], [p[done[k] + 1] FOR k IN range(1, len(f))]), [length(text)]), ',') END AS cuts
    FROM (SELECT *, list_filter(range(length(text)), lambda i: NOT regexp_matches(text[i + 1], '[ \t\n\x0B\f\r]')) AS p, [list_sum([length(regexp_replace(x, '[ \t\n\x0B\f\r]', '', 'g')) FOR x IN f[1:k]])::BIGINT FOR k IN range(1, len(f) + 1)] AS done FROM {FRAGMENTS})""",
)
def text_cuts(spark, d):
    """Where each turn's sentences begin in its own text."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("i", "sentence"))), lambda x: x["sentence"])
    f = parts(spark, d).groupBy("conv_id", "turn").agg(ordered.alias("f"))
    cuts = tf.text_cuts(F.col("text"), F.col("f"))
    return turns(spark, d).join(f, ["conv_id", "turn"]).select("conv_id", "turn", F.array_join(cuts, ",").alias("cuts"))


AUDITS = merged(CLICK, 20 * HOUR)


@register(
    "X24_provenance",
    f"""SELECT s.segment_id, CASE WHEN a.source_id IS NOT NULL THEN 'exact_acoustic_identity_audit' WHEN n.source_id IS NOT NULL THEN 'exact_review_navigation' END AS method,
    CASE WHEN a.source_id IS NOT NULL THEN s.value WHEN n.source_id IS NOT NULL THEN CAST(n.n AS DOUBLE) END AS confidence
    FROM (SELECT segment_id, source_id, start_ms, end_ms, value FROM {CLICK}) s LEFT JOIN {AUDITS} a ON a.source_id = s.source_id AND a.start_ms = s.start_ms AND a.end_ms = s.end_ms
    LEFT JOIN {merged(CLICK, 0, ', count(*) AS n')} n ON n.source_id = s.source_id AND n.start_ms = s.start_ms AND n.end_ms = s.end_ms""",
)
def provenance(spark, d):
    """A crop has its parent's confidence only where audit or navigation had exactly its span:
    audited are rows merged over twenty hours, shown those that touch."""
    s = seg(spark, d, "click", "value")
    span = ["source_id", "start_ms", "end_ms"]
    audits = iv.merge(s.select(*span), gap=20 * HOUR).withColumn("passed", F.lit(True))
    shown = iv.merge(s.select(*span), ("source_id",), 0, F.count("*").cast("double").alias("reference"))
    both = s.join(audits, span, "left").join(shown, span, "left")
    method, score = tf.provenance(F.col("passed"), F.col("reference").isNotNull(), F.col("value"), F.col("reference"))
    return both.select("segment_id", method.alias("method"), score.alias("confidence"))


@register(
    "D7_replay_entries",
    """SELECT source, sha256(text) AS content, lang AS roles, min(doc_id) AS doc_id, count(*) AS n, count(DISTINCT quality) > 1 AS conflict FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL GROUP BY source, sha256(text), lang""",
)
def replay_entries(spark, d):
    """One entry for each source, content and set of roles; contradictory labels are a conflict."""
    rows = fx.table(spark, d, "documents").where("text is not null").join(fx.table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    key = ["source", F.sha2(F.col("text").cast("binary"), 256).alias("content"), F.col("lang").alias("roles")]
    low, high = F.min("quality"), F.max("quality")
    return rows.groupBy(*key).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.coalesce(low < high, F.lit(False)).alias("conflict"))


INSIDE = "t.source_id = x.source_id AND t.start_ms >= x.vs AND t.end_ms <= x.ve"
PIECES = f"(SELECT x.segment_id, x.source_id, greatest(x.start_ms, y.start_ms) AS a, least(x.end_ms, y.end_ms) AS b, y.start_ms AS vs, y.end_ms AS ve FROM {pairs(CLICK, VIEW)})"
EDGES = f"(SELECT x.*, a AS p FROM {PIECES} x UNION ALL SELECT x.*, t.end_ms FROM {PIECES} x JOIN {BUY} t ON {INSIDE} AND t.end_ms > a AND t.end_ms < b)"


def evidence(spark, d):
    """Other, unresolved and target evidence."""
    of = lambda kind, state: seg(spark, d, kind).drop("segment_id").withColumn("state", F.lit(state))
    return of("error", "other").unionByName(of("view", "unresolved")).unionByName(of("purchase", "target"))


@register(
    "I45_local_conflicts",
    f"""SELECT segment_id, CASE WHEN segment_id IN (SELECT x.segment_id FROM {pairs(CLICK, ERR)}) THEN 'other' WHEN segment_id IN (SELECT x.segment_id FROM {EDGES} x
      WHERE NOT EXISTS (SELECT 1 FROM {BUY} t WHERE {INSIDE} AND t.start_ms <= x.p AND t.end_ms > x.p)) THEN 'unresolved' ELSE 'uncontested' END AS state FROM {CLICK}""",
)
def local_conflicts(spark, d):
    return assembly.local_conflicts(seg(spark, d, "click"), evidence(spark, d))


@register("I45_install")
def install(spark, d):
    """Proposals in place of accepted rows, which are views, where other evidence allows it."""
    return assembly.install(seg(spark, d, "click"), seg(spark, d, "view"), evidence(spark, d).where("state <> 'unresolved'"))


WORDS, ALLOWED, MOST = merged(BUY), merged(VIEW, 20 * HOUR), 20 * HOUR
SAFE = "EXISTS (SELECT 1 FROM {al} y WHERE y.source_id = {t}.source_id AND y.start_ms <= {a} AND y.end_ms >= {b}) AND NOT EXISTS (SELECT 1 FROM {err} y WHERE y.source_id = {t}.source_id AND least(y.end_ms, {b}) > greatest(y.start_ms, {a}))"


@register(
    "I52_snap_to_words",
    f"""WITH w AS (SELECT * FROM {WORDS}), al AS (SELECT * FROM {ALLOWED}), er AS (SELECT * FROM {ERR}), s AS (
      SELECT c.segment_id, c.source_id, c.start_ms AS from_start, c.end_ms AS from_end, l.start_ms AS la, r.end_ms AS rb, l.start_ms IS NOT NULL AND c.start_ms - l.start_ms <= {MOST} AS near_l, r.end_ms IS NOT NULL AND r.end_ms - c.end_ms <= {MOST} AS near_r,
        l.start_ms = r.start_ms AS one FROM {CLICK} c LEFT JOIN w l ON l.source_id = c.source_id AND l.start_ms < c.start_ms AND l.end_ms > c.start_ms LEFT JOIN w r ON r.source_id = c.source_id AND r.start_ms < c.end_ms AND r.end_ms > c.end_ms),
    t AS (SELECT *, near_l AND {SAFE.format(al="al", err="er", t="s", a="s.la", b="s.from_end")} AS ok_l FROM s), u AS (SELECT *, CASE WHEN ok_l THEN la ELSE from_start END AS start_ms FROM t),
    v AS (SELECT *, near_r AND {SAFE.format(al="al", err="er", t="u", a="u.start_ms", b="u.rb")} AS ok_r FROM u)
    SELECT segment_id, start_ms, CASE WHEN ok_r THEN rb ELSE from_end END AS end_ms, CAST(CASE WHEN near_l AND NOT ok_l THEN 1 ELSE 0 END + CASE WHEN near_r AND NOT ok_r AND NOT (near_l AND NOT ok_l AND coalesce(one, false)) THEN 1 ELSE 0 END AS INTEGER) AS refused FROM v""",
)
def snap_to_words(spark, d):
    """Clicks whose edges lie in a merged purchase, within views merged over 20 hours."""
    words, allowed = iv.merge(seg(spark, d, "purchase")), iv.merge(seg(spark, d, "view"), gap=20 * HOUR)
    out = assembly.snap_to_words(seg(spark, d, "click"), words, allowed, seg(spark, d, "error"), MOST)
    return out.select("segment_id", "start_ms", "end_ms", F.size("blocked_words").alias("refused"))


@register("J9_text_evidence")
def text_evidence(spark, d):
    """For each fragment the cue that shares at least half of it and is most alike, from 0.55 on;
    its text is good enough to correct the fragment's from 0.70 on."""

    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([lcs_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)

    alike.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    text = F.format_string("line %d of part %d", F.col("k"), F.col("k") % 7).alias("text")
    p = iv.overlap_join(fx.segments(spark, d, "click").select(*ID, text), fx.segments(spark, d, "view").select(*ID, text))
    p = p.where(2 * iv.shared() >= F.col("end_ms") - F.col("start_ms")).withColumn("s", F.pandas_udf(alike, "double")("text", "b_text"))
    best = p.groupBy("segment_id").agg(F.max(F.struct("s", (-F.col("b_segment_id")).alias("c"))).alias("m")).where("m.s >= 0.55")
    return best.select("segment_id", (-F.col("m.c")).alias("cue_id"), F.round("m.s", 6).alias("similarity"), (F.col("m.s") >= 0.70).alias("corrects"))


@register("J18_parallel_captions")
def parallel_captions(spark, d):
    c = fx.segments(spark, d).select(*ID, F.concat("kind", F.lit(" "), (F.col("k") % 5).cast("string")).alias("text"), F.when(F.col("kind") == "error", "lyrics").otherwise("speech").alias("kind"), F.lit("").alias("actor"))
    return assembly.fold_parallel_captions(c, 2 * HOUR)


@register("D4_distinct_timed_texts")
def distinct_timed_texts(spark, d):
    s = fx.segments(spark, d).select(*ID, F.concat("kind", F.lit(" "), (F.col("k") % 5).cast("string")).alias("text"))
    return assembly.distinct_timed_texts(s, 5 * HOUR)


@register("I29_merge_tracks")
def merge_tracks(spark, d):
    """Clicks and views as two tracks; errors block, purchases change the voice where they begin."""
    changes = seg(spark, d, "purchase").select("source_id", F.col("start_ms").alias("cut_ms"))
    blocked = seg(spark, d, "error", "k").where("k < 30")
    vetoes = seg(spark, d, "error", "k").where("k >= 30")
    certified = iv.merge(seg(spark, d), gap=10 * HOUR)
    return assembly.merge_tracks(seg(spark, d, "click"), seg(spark, d, "view"), blocked, changes, vetoes, certified, 10 * HOUR, 200 * HOUR)


@register("I31_join_same_voice")
def join_same_voice(spark, d):
    """Vectors as spans of 950 ms, one a second; strict where both halves point
    the same way, and rows of role 9 as barriers around their start."""
    from cadenza.functions.vectors import dot

    v = vectors(spark, d)
    rows = v.select(F.col("vec_id").alias("segment_id"), "source_id", "start_ms", (F.col("start_ms") + 950).alias("end_ms"), "primary", "secondary", (dot("primary", "secondary") >= 0.15).alias("strict"))
    bars = v.where("role = 9").select("source_id", (F.col("start_ms") - 30).alias("start_ms"), (F.col("start_ms") + 10).alias("end_ms"))
    return assembly.join_same_voice(rows, bars, 85, 6_000, (("primary", 0.0), ("secondary", 0.0)))


@register("I33_join_owned")
def join_owned(spark, d):
    units = seg(spark, d, "view", "value").select("source_id", "start_ms", "end_ms", F.col("segment_id").alias("unit_id"), (F.col("value") > 20).alias("accepted"))
    return assembly.join_owned(seg(spark, d, "click"), units, seg(spark, d, "error"), 20 * HOUR, 15 * HOUR)


@register("I55_absorb_remainders")
def absorb_remainders(spark, d):
    spans = iv.merge(seg(spark, d).where("segment_id is not null"), gap=0)
    return assembly.absorb_remainders(seg(spark, d, "click"), spans, seg(spark, d, "error"), 20 * HOUR)


@register("T8_subsets")
def subsets(spark, d):
    """Documents by the words they bring, how they spread over five counts, and their quality."""
    docs = fx.table(spark, d, "documents").join(fx.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    text = F.coalesce("text", F.lit(""))
    words = docs.withColumns({"text": text, "words": F.array_remove(F.split(F.lower(text), "[\\s]+"), "")})  # split once, used twice
    count = lambda p: F.size(F.split("text", p)) - 1
    features = F.array(*[c.cast("double") for c in (F.char_length("text"), F.size("words"), count("[0-9]"), count("[.,;:!?]"), count("\n"))])
    tokens = F.transform(F.array_distinct("words"), lambda w: F.concat(F.coalesce("lang", F.lit("")), F.lit(":"), w))
    quality = F.when(F.col("quality") == 1, 1.0).when(F.col("quality") == 0, 0.35).otherwise(0.2)
    return selection.select_subsets(words.select(F.col("doc_id").alias("id"), tokens.alias("tokens"), features.alias("features"), quality.alias("quality")))


@register("V14_plane")
def plane(spark, d):
    """Coordinates of each vector on the two main axes."""
    return selection.plane(vectors(spark, d)).select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


RANKED = f"(SELECT segment_id, value AS x, value / 2 + k AS old, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS y FROM {SEG})"


@register(
    "W5_rank_audit",
    f"""SELECT CAST(sum(n) AS BIGINT) AS protected_pairs, count(*) FILTER (x <= worst) AS inverted, count(*) FILTER (x <= worst) = 0 AS passed FROM (SELECT x, y, count(*) FILTER (y = 0) OVER w AS n, max(CASE WHEN y = 0 THEN x END) OVER w AS worst
      FROM (SELECT x, y, CASE WHEN y = 1 THEN old - 20 ELSE old END AS asked FROM {RANKED}) WINDOW w AS (ORDER BY asked, y DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE y = 1""",
)
def rank_audit(spark, d):
    """Of all pairs in which a positive was ahead of a negative by more than the band under the old
    scores: how many there are, and how many positives some such negative has reached."""
    s = fx.segments(spark, d)
    r = s.select(F.col("value").alias("x"), (F.col("value") / 2 + F.col("k")).alias("old"), F.when(F.col("k") % 3 == 0, 1).otherwise(0).alias("y"))
    return evaluation.rank_audit(r, "x", "old", "y", 20.0)


LABELLED = f"(SELECT CAST(source_id AS VARCHAR) AS source, CASE WHEN value > 60 THEN 1 ELSE 0 END AS label FROM {CLICK} WHERE k < 40)"


@register(
    "E4_holdout",
    f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY sha256(source)) - 1 AS at_, count(*) OVER () AS total FROM (SELECT source, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM {LABELLED} GROUP BY source)),
    w AS (SELECT width FROM (SELECT any_value(total) AS total FROM s), LATERAL (SELECT unnest(generate_series(greatest(1, total // 5), greatest(greatest(1, total // 5), total // 2))) AS width)),
    arcs AS (SELECT w.width, a.at_ AS start, sum(b.p) AS hp, sum(b.n) AS hn FROM w, s a JOIN s b ON (b.at_ - a.at_ + a.total) % a.total < w.width GROUP BY w.width, a.at_),
    best AS (SELECT width, start FROM arcs, (SELECT sum(p) AS p, sum(n) AS n, count(*) AS total FROM s) t WHERE t.total >= 3 AND hp > 0 AND hp < t.p AND hn > 0 AND hn < t.n ORDER BY width, start LIMIT 1)
    SELECT s.source, coalesce((s.at_ - best.start + s.total) % s.total < best.width, false) AS held FROM s LEFT JOIN best ON true""",
)
def holdout(spark, d):
    """Sources of labelled rows, a fifth or more of them held out with both labels on both sides."""
    s = fx.segments(spark, d, "click").where("k < 40").select(F.col("source_id").cast("string").alias("source"), F.when(F.col("value") > 60, 1).otherwise(0).alias("label"))
    return evaluation.holdout_sources(s)


@register("D3_bank_dedupe")
def bank_dedupe(spark, d):
    """Vectors by confidence (how alike their halves are), then role, then id: one goes if a better
    kept one of its source is near in both halves; of the rest the best 500 stay."""
    from cadenza.functions.vectors import dot
    from cadenza.operators import greedy

    v = vectors(spark, d).select("vec_id", "source_id", "role", "primary", "secondary", F.round(dot("primary", "secondary"), 6).alias("confidence"))
    rank = lambda p: F.struct((-F.col(f"{p}confidence")).alias("c"), F.col(f"{p}role").alias("r"), F.col(f"{p}vec_id").alias("i"))
    w = v.select("source_id", *[F.col(c).alias(f"o_{c}") for c in v.columns if c != "source_id"])
    near = v.join(w, "source_id").where((rank("") < rank("o_")) & (dot("primary", "o_primary") >= 0.25) & (dot("secondary", "o_secondary") >= 0.1))
    lost = greedy.suppress(near.select(F.col("vec_id").alias("better"), F.col("o_vec_id").alias("worse")))
    kept = v.join(lost.select(F.col("id").alias("vec_id")), "vec_id", "left_anti")
    return kept.orderBy(rank("")).limit(500).select("vec_id", "confidence")  # the bank's size


@register("W9_change_points")
def change_points(spark, d):
    """Points between neighbouring vectors of a source where they differ by over 0.9, the strongest
    first, no two within three seconds."""
    from cadenza.functions.vectors import dot
    from cadenza.operators import folds

    w = Window.partitionBy("source_id").orderBy("start_ms", "vec_id")
    v = vectors(spark, d).withColumns({"before": F.lag("primary").over(w), "from": F.lag("start_ms").over(w)}).where("before is not null")
    drop = v.select(F.col("vec_id").alias("segment_id"), "source_id", F.floor((F.col("start_ms") + F.col("from")) / 2).alias("start_ms"), (1 - dot("primary", "before")).alias("value"))
    points = drop.where("value > 0.9").withColumn("end_ms", F.col("start_ms"))
    return folds.space_out(points, 3000)


@register("X7_spoken_lines")
def spoken_lines(spark, d):
    """What one speaker says in each whole text of the documents and the turns, '' where several do."""
    docs = fx.table(spark, d, "documents").select(F.lit("document").alias("what"), F.col("doc_id").cast("long").alias("id"), F.lit(0).cast("long").alias("turn"), "text")
    said = turns(spark, d).select(F.lit("turn").alias("what"), F.col("conv_id").cast("long").alias("id"), F.col("turn").cast("long").alias("turn"), "text")
    return docs.unionByName(said).select("what", "id", "turn", tf.spoken_line(F.col("text")).alias("line"))
