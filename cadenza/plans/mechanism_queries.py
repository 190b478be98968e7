"""Queries over operators with mechanisms of their own: containment, clusters, rounds, decoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import timed_text as tt
from cadenza.functions import vectors as vf
from cadenza.operators import bootstrap as bs
from cadenza.operators import calibration as ca
from cadenza.operators import containment
from cadenza.operators import exclusion as ex
from cadenza.operators import gate
from cadenza.operators import intervals as iv
from cadenza.operators import promotion as pr
from cadenza.operators import seeds as sd
from cadenza.operators import trajectory as tr
from cadenza.operators import turn_clusters as tc
from cadenza.plans.catalogue import register
from cadenza.plans.vector_queries import VEC
from cadenza.sources import fixtures as fx

HOUR, MIN = 3_600_000, 60_000

#: Values of a window, and of the shortest clip that may be contained in another.
WIDTH, SHORTEST = 8, 20


def level_clips(spark, d):
    """id, values: a clip for each user, and with every third one an excerpt of it at another gain and level."""
    frames = fx.frames(spark, d)
    clips = frames.groupBy("clip_id").agg(F.sort_array(F.collect_list(F.struct("frame_idx", "level"))).alias("f"))
    clips = clips.select(F.col("clip_id").alias("id"), F.transform("f", lambda x: x["level"]).alias("values"))
    part = F.slice("values", F.pmod("id", F.lit(7)).cast("int") + 1, F.floor(F.size("values") * 0.7).cast("int"))
    excerpts = clips.where("id % 3 = 0 and size(values) >= 40").select((-F.col("id") - 1).alias("id"), F.transform(part, lambda x: x * 0.5 + 0.125).alias("values"))
    return clips.unionByName(excerpts)


@register("D2_sequence_containment")
def sequence_containment(spark, d):
    """Clips that are wholly contained in a longer kept one."""
    return containment.deduplicate_sequences(level_clips(spark, d), WIDTH, SHORTEST)


def voice_profile(turns):
    """The target's profile and the excluded voices, from the first turns of their labels."""
    first = turns.where("voice <= 2 and usable").groupBy("voice").agg(F.slice(F.sort_array(F.collect_list(F.struct("turn", "primary", "secondary"))), 1, 6).alias("t"))
    held = {r.voice: r.t for r in first.collect()}  # six turns of three voices
    mean = lambda k, c: [sum(x) / len(x) for x in zip(*(t[c] for t in held[k]), strict=True)]
    profile = tc.TargetProfile(mean(0, "primary"), mean(0, "secondary"), 0.55, 0.5, [t.primary for t in held[0]], [t.secondary for t in held[0]])
    return profile, [(f"guest{k}", mean(k, "primary"), mean(k, "secondary")) for k in (1, 2) if k in held]


@register("V9_turn_clusters")
def turn_clusters(spark, d):
    """Voices of each source, without members that are far from their centroid."""
    c = tc.cluster_turns(fx.turns(spark, d))
    return c.select("source_id", "cluster", "n", "seconds", F.round("cohesion", 6).alias("cohesion"), F.round("primary_median", 6).alias("primary_median"))


@register("V10_target_family")
def target_family(spark, d):
    """Each turn's place in the target's family: core, borderline, dropped, near_miss or none."""
    turns = fx.turns(spark, d)
    profile, roles = voice_profile(turns)
    _, verdicts = tc.assign_target(turns, tc.cluster_turns(turns), profile, roles, require_dominant=False)
    return verdicts.select("source_id", "turn", "cluster", "verdict", F.round("cohort_margin", 6).alias("cohort_margin"))


def evidence_turns(spark, d):
    """Turns with what evidence collection asks about: the clean part of each, and whether raw audio rescued it."""
    clean = F.when(F.col("turn") % 11 == 0, F.col("end_ms") - F.col("start_ms") - 20)
    return fx.turns(spark, d).withColumns({"clean_ms": clean, "raw_rescued": F.col("turn") % 29 == 0})


def first_assignment(spark, d):
    turns = evidence_turns(spark, d)
    profile, roles = voice_profile(turns)
    judged, verdicts = tc.assign_target(turns, tc.cluster_turns(turns), profile, roles, require_dominant=False)
    blocked = fx.segments(spark, d, "error").select("source_id", (F.col("start_ms") / 50_000).cast("long").alias("start_ms"), (F.col("end_ms") / 50_000).cast("long").alias("end_ms")).where("end_ms > start_ms")
    return turns, judged, verdicts.where("verdict = 'core'"), blocked, profile, roles


@register("V21_collected_evidence")
def collected_evidence(spark, d):
    """Turns that may serve as references, with the confidence of their cluster."""
    turns, judged, core, blocked, *_ = first_assignment(spark, d)
    return bs.collect_evidence(turns, judged, core, blocked).select("source_id", "turn", F.round("confidence", 6).alias("confidence"))


@register("V20_bootstrap_rounds")
def bootstrap_rounds(spark, d):
    """What each round used and brought, a row a source and round."""
    turns, judged, core, blocked, profile, roles = first_assignment(spark, d)
    # Only sure turns start; the rounds have to find the rest of the target's.
    start = core.where("primary_effective >= 0.85 and secondary_effective >= 0.8")
    _, report = bs.bootstrap_rounds(turns, judged, start, blocked, profile, roles, rounds=10)
    return report


@register("V19_adapted_profiles")
def adapted_profiles(spark, d):
    """Gain floors of profiles adapted to each source's strict anchors."""
    turns = evidence_turns(spark, d)
    profile, _ = voice_profile(turns)
    score = lambda c, centre: vf.cosine(c, F.array(*[F.lit(float(x)) for x in centre]))
    rows = turns.where("usable").withColumns({"primary_score": score("primary", profile.primary), "secondary_score": score("secondary", profile.secondary)})
    tier = F.when(F.col("primary_score") >= 0.7, "strong").when(F.col("primary_score") >= 0.45, "balanced").otherwise("weak")
    rows = rows.withColumns({"tier": tier, "silence_merged": F.lit(False), "coverage": F.col("secondary_score") + 0.4, "speech_ratio": F.lit(None).cast("double"), "recall_edges": F.lit(0)})
    rows = rows.withColumn("source_id", F.expr("source_id div 4"))  # a few hundred turns each, so that many have three anchors
    found = bs.adapted_profiles(bs.strict_anchors(rows), profile)
    return found.select("source_id", "n_anchors", F.round("primary_gain_floor", 6).alias("primary_gain_floor"), F.round("secondary_gain_floor", 6).alias("secondary_gain_floor"))


@register("V22_whitened_scores")
def whitened_scores(spark, d):
    """Each turn's similarity to its voice's mean before and after whitening within voices."""
    turns = fx.turns(spark, d).select(F.col("turn").alias("vec_id"), F.col("primary").alias("v"), F.col("voice").cast("string").alias("group"))
    white = ca.fit_whitening(turns).apply(turns)
    means = white.groupBy("group").agg(vf.mean_vector("v", 32).alias("m"), vf.mean_vector("white", 32).alias("w"))  # one row a voice
    both = white.join(means, "group")
    return both.select("vec_id", F.round(vf.cosine("v", "m"), 6).alias("plain"), F.round(vf.cosine("white", "w"), 6).alias("whitened"))


def _ratio_sql() -> str:
    """The cohort ratio with all pairs, by windows."""
    scale, floor = 0.1, 0.2
    unit = "list_transform({0}, lambda x: x / sqrt(list_sum(list_transform({0}, lambda y: y * y))))"
    total = ", ".join(f"sum(v[{i}])" for i in range(1, 33))
    normal = lambda score, z, t: f"0.5 * (({score} - {z}.m) / {z}.s + ({score} - {t}.m) / {t}.s)"
    shrunk = lambda rows, prior: f"(SELECT (coalesce(sum(CASE WHEN n > 2 THEN greatest(lo, least(hi, z)) ELSE z END), 0) + 2 * ({prior})) / (count(*) + 2) FROM {rows}, (SELECT count(*) AS n, quantile_cont(z, 0.1) AS lo, quantile_cont(z, 0.9) AS hi FROM {rows}))"
    prior = lambda score: f"(SELECT ({score} - m) / s FROM side WHERE id = 'z')"
    return f"""
WITH r AS MATERIALIZED (SELECT vec_id, "primary" AS v FROM {VEC} WHERE role = 3 AND vec_id % 5 = 0), c AS MATERIALIZED (SELECT vec_id, "primary" AS v FROM {VEC} WHERE role <> 3 AND vec_id % 7 = 0),
t AS MATERIALIZED (SELECT [{total}] AS s FROM r), ctr AS MATERIALIZED (SELECT {unit.format('s')} AS v FROM t),
apart AS MATERIALIZED (SELECT vec_id, v, {unit.format('o')} AS c FROM (SELECT vec_id, v, list_transform(list_zip(s, v), lambda x: x[1] - x[2]) AS o FROM r, t)),
probes AS (
  SELECT 'z' AS id, v, NULL AS skip FROM ctr UNION ALL SELECT 'rt' || vec_id, v, NULL FROM apart UNION ALL SELECT 'rz' || vec_id, c, NULL FROM apart
  UNION ALL SELECT 'ct' || vec_id, v, vec_id FROM c UNION ALL SELECT 'cz' || c.vec_id, ctr.v, c.vec_id FROM c, ctr UNION ALL SELECT 'v' || vec_id, "primary", NULL FROM {VEC}
), side AS MATERIALIZED (
  SELECT id, avg(x) AS m, greatest(stddev_pop(x), {scale}) AS s FROM (
    SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY x DESC) AS k FROM (SELECT p.id, list_dot_product(p.v, c.v) AS x FROM probes p, c WHERE c.vec_id IS DISTINCT FROM p.skip))
  WHERE k <= 20 GROUP BY id
), pos AS MATERIALIZED (SELECT {normal('list_dot_product(a.v, a.c)', 'z', 't')} AS z FROM apart a JOIN side z ON z.id = 'rz' || a.vec_id JOIN side t ON t.id = 'rt' || a.vec_id),
neg AS MATERIALIZED (SELECT {normal('list_dot_product(c.v, ctr.v)', 'z', 't')} AS z FROM ctr, c JOIN side z ON z.id = 'cz' || c.vec_id JOIN side t ON t.id = 'ct' || c.vec_id),
fit AS MATERIALIZED (SELECT {shrunk('pos', prior(min(1.0, floor + scale)))} AS p, {shrunk('neg', prior(floor - scale))} AS n),
spread AS (SELECT p, n, ((SELECT sum((z - p) * (z - p)) FROM pos) + (SELECT sum((z - n) * (z - n)) FROM neg) + 2) / ((SELECT count(*) FROM pos) + (SELECT count(*) FROM neg) + 2) AS var FROM fit)
SELECT vec_id, round(z, 6) AS z, round(CASE WHEN p > n THEN greatest(-20, least(20, (p - n) * (z - (p + n) / 2) / var)) ELSE (score - {floor}) / {scale} END, 6) AS llr
FROM (SELECT vec_id, score, {normal('score', 'z', 't')} AS z FROM (SELECT vec_id, list_dot_product("primary", v) AS score FROM {VEC}, ctr) q JOIN side z ON z.id = 'z' JOIN side t ON t.id = 'v' || q.vec_id), spread
"""


@register("V4_cohort_ratio", _ratio_sql())
def cohort_ratio(spark, d):
    """Each vector's score against a reference centre, normalised by cohorts on both sides, and its log likelihood ratio."""
    v = fx.vectors(spark, d).select("vec_id", "role", F.col("primary").alias("v"))
    fit = ca.fit_cohort_ratio(v.where("role = 3 and vec_id % 5 = 0"), v.where("role <> 3 and vec_id % 7 = 0"), 0.2, 0.1)
    scored = v.withColumn("score", vf.dot("v", F.array(*[F.lit(x) for x in fit.centre])))
    return fit.apply(scored).select("vec_id", F.round("z", 6).alias("z"), F.round("llr", 6).alias("llr"))


def field_observations(spark, d):
    """Views as coarse windows, clicks as fine ones, purchases as local evidence, and long errors as islands; their
    signed values are by how much an event's value differs from the middle one."""
    s = fx.segments(spark, d).where("start_ms >= 0")
    kind = F.when(F.col("kind") == "view", "coarse").when(F.col("kind") == "click", "fine").when(F.col("kind") == "purchase", "local").otherwise("island")
    length = F.when(F.col("kind") == "click", F.least(F.col("end_ms") - F.col("start_ms"), F.lit(HOUR))).otherwise(F.col("end_ms") - F.col("start_ms"))
    return s.select("source_id", "start_ms", (F.col("start_ms") + length).alias("end_ms"), kind.alias("kind"), F.asinh((F.col("value") - 25) / 20).alias("value"))


def field_barriers(spark, d):
    e = fx.segments(spark, d, "error").where("value >= 100 and start_ms >= 0")
    return e.select("source_id", "start_ms", (F.col("start_ms") + 10 * MIN).alias("end_ms"))


@register("I48_trajectory_field")
def trajectory_field(spark, d):
    """Cells of each source's evidence field."""
    cells, _ = tr.build_field(field_observations(spark, d), field_barriers(spark, d))
    return cells.select("source_id", "start_ms", "end_ms", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"), "is_observed", "is_identity", "is_blocked")


@register("I48_trajectory_assessments")
def trajectory_assessments(spark, d):
    """Merged views assessed by the field."""
    observations = field_observations(spark, d)
    cells, scales = tr.build_field(observations, field_barriers(spark, d))
    spans = iv.merge(fx.segments(spark, d, "view").where("start_ms >= 0").select("source_id", "start_ms", "end_ms"))
    spans = spans.withColumn("segment_id", F.concat_ws(":", "source_id", "start_ms"))
    found = tr.assess_spans(spans, cells, scales, observations)
    return found.select("source_id", "segment_id", *[F.round(c, 6).alias(c) for c in ("integral", "positive_fraction", "observed_fraction", "blocked_fraction", "mean_evidence", "negative_integral", "penalty", "fine_mean", "fine_error", "fine_covered_fraction")], "edge_conflict", "supported")


def third_vectors(spark, d, turns):
    """turns with a third channel and raw audio's vectors: mixtures of both channels, of some turns only."""
    mix = lambda a, b, w: F.zip_with(a, b, lambda x, y: x + w * y)
    some = lambda n, c: F.when(F.col("turn") % n != 0, c)
    return turns.withColumns({
        "third": some(5, mix("primary", "secondary", 0.6)), "raw_primary": some(3, mix("primary", "secondary", 0.3)), "raw_secondary": some(3, mix("secondary", "primary", 0.3)),
        "char_score": F.get("primary", F.lit(0)) + 0.4, "va_score": F.get("secondary", F.lit(0)) + 0.3,
    })


@register("V24_promoted_turns")
def promoted_turns(spark, d):
    """Turns that the third channel or raw audio brings into the target's core."""
    turns, judged, _, blocked, profile, roles = first_assignment(spark, d)
    _, verdicts = tc.assign_target(turns, tc.cluster_turns(turns), profile, roles, require_dominant=False)
    add = lambda a, b: [x + 0.6 * y for x, y in zip(a, b, strict=True)]
    third = pr.ThirdChannel(add(profile.primary, profile.secondary), 0.55, [add(p, s) for _, p, s in roles])
    found = pr.promoted(third_vectors(spark, d, turns), judged, verdicts, blocked, profile, roles, third)
    return found.select("source_id", "turn", "verdict", F.round("third_score", 6).alias("third_score"), "promoted_by", "rival_wins")


@register("V23_rescue_rivals")
def rescue_rivals(spark, d):
    """Turns for which an excluded voice or another cluster would win a rescue."""
    return promoted_turns(spark, d).select("source_id", "turn", "rival_wins").where("rival_wins")


def identity_windows(spark, d):
    """Two windows a turn with scores against its voice's mean and the best other voice's."""
    turns = fx.turns(spark, d)
    means = turns.groupBy("voice").agg(vf.mean_vector("primary", 32).alias("mp"), vf.mean_vector("secondary", 32).alias("ms"))  # one row a voice
    own = turns.join(means, "voice")
    others = means.select(F.col("voice").alias("other"), F.col("mp").alias("op"), F.col("ms").alias("os"))
    best = own.join(F.broadcast(others), F.col("voice") != F.col("other")).groupBy("turn").agg(F.max(vf.cosine("primary", "op")).alias("bp"), F.max(vf.cosine("secondary", "os")).alias("bs"))
    rows = own.join(best, "turn").withColumns({"p": vf.cosine("primary", "mp"), "s": vf.cosine("secondary", "ms")}).withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    # Turns are a second apart at most in the fixture; windows need lengths of lines.
    start = F.col("start_ms") * 4 + F.col("half") * 900
    return rows.select(
        (F.col("turn") * 2 + F.col("half")).alias("window_id"), "source_id", "turn", "voice", start.alias("start_ms"), (start + 1200).alias("end_ms"),
        (F.col("p") >= 0.6).alias("accepted"), (F.col("turn") % 13 == 0).alias("smoothed"), (F.col("p") - 0.02 * F.col("half")).alias("primary"), F.col("s").alias("secondary"),
        (F.col("p") - F.col("bp")).alias("cm_p"), (F.col("s") - F.col("bs")).alias("cm_s"),
    )


@register("I57_prototype_anchors")
def prototype_anchors(spark, d):
    """Strictly clean windows that are surer than the middle one and overlap no surer one."""
    no = F.lit(False)
    w = identity_windows(spark, d).withColumns({"reference": F.col("turn") % 31 == 0, "raw_audit": no, "micro": no, "scene_supported": no, "compensated": no, "z_p": (F.col("primary") - 0.5) / 0.1, "z_s": (F.col("secondary") - 0.45) / 0.1, "strict": F.least("cm_p", "cm_s") >= 0.02})
    clean = fx.turns(spark, d).where("usable").select("source_id", "turn", (F.col("start_ms") * 4).alias("start_ms"), (F.col("start_ms") * 4 + 2100).alias("end_ms"))
    blocked = fx.segments(spark, d, "error").select("source_id", (F.col("start_ms") / 50_000).cast("long").alias("start_ms"), (F.col("end_ms") / 50_000).cast("long").alias("end_ms"))
    found = sd.prototype_anchors(w, clean, blocked.where("end_ms > start_ms"), 0.1, 0.1)
    return found.select("window_id", "source_id", "turn", "start_ms", "end_ms", F.round("confidence", 6).alias("confidence"))


def seed_rows(spark, d):
    w = identity_windows(spark, d)
    members = w.groupBy("source_id", F.col("voice").cast("long").alias("cluster"), "turn").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min(F.least("cm_p", "cm_s")).alias("margin"), F.min("primary").alias("primary_score"), F.min("secondary").alias("secondary_score"))
    members = members.withColumns({"outlier": F.col("primary_score") < 0.5, "margin": F.when(F.col("turn") % 9 != 0, F.col("margin"))})
    cues = members.where("turn % 2 = 0").select("source_id", (F.col("start_ms") + 50).alias("start_ms"), (F.col("end_ms") - 40).alias("end_ms"), F.concat(F.lit("line "), "turn").alias("text"))
    return sd.seed_candidates(members, cues, w)


@register("T6_seed_candidates")
def seed_candidates(spark, d):
    """Complete lines of each voice with a quality."""
    return seed_rows(spark, d).select("source_id", "cluster", "turn", "start_ms", "end_ms", "text", "single_cue", "windows_verified", F.round("variation", 6).alias("variation"), "quality")


@register("T5_diverse_seeds")
def diverse_seeds(spark, d):
    """Up to four seeds of each voice, good ones far from each other in time and sound."""
    vectors = fx.turns(spark, d).select("turn", "primary", "secondary")
    return sd.diverse_seeds(seed_rows(spark, d).withColumn("source_id", F.expr("source_id div 10")).join(vectors, "turn"), 4)


#: Excluded voices in the order in which they are tried; the target's label is 3.
VOICES = (1, 2, 7)
TIERS = ("tertiary", "raw_rescue", "strong")
_half = lambda at: f"list_transform(range(1, 33), lambda i: CAST(embedding[{at}] AS DOUBLE))"
_norm = lambda v: f"list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda y: y * y))))"
FIVE_SQL = f"(SELECT vec_id, label, {', '.join(f'{_norm(_half(at))} AS {name}' for name, at in (('p', 'i'), ('s', 'i + 32'), ('rp', '2 * i - 1'), ('rs', '2 * i'), ('t', 'i + 16')))} FROM embeddings)"


def five_views(spark, d):
    """id, label and five views of an embedding: its halves, its odd and even components, and its middle."""
    take = lambda at: vf.unit(F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.element_at("embedding", at(i)).cast("double")))
    views = {"primary": lambda i: i, "secondary": lambda i: i + 32, "raw_primary": lambda i: 2 * i - 1, "raw_secondary": lambda i: 2 * i, "third": lambda i: i + 16}
    tier = F.element_at(F.array(*[F.lit(t) for t in TIERS]), (F.col("vec_id") % 3 + 1).cast("int"))
    return fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", tier.alias("tier"), *[take(f).alias(k) for k, f in views.items()])


def audited_voices(spark, d):
    v = five_views(spark, d)
    refs = v.where("id % 5 = 0").where(F.col("label").isin(3, *VOICES)).withColumn("voice", F.when(F.col("label") == 3, "").otherwise(F.concat(F.lit("voice"), "label")))
    return v, refs, spark.createDataFrame([(f"voice{k}", i) for i, k in enumerate(VOICES)], "voice string, place int")


def _margins_sql(names: str) -> str:
    views = names.split()
    centroid = lambda n: "[" + ", ".join(f"avg({n}[{i}])" for i in range(1, 33)) + "]"
    scores = ", ".join(f"list_cosine_similarity(v.{n}, any_value(c.c{n})) AS c_{n}, max(list_dot_product(v.{n}, r.{n})) AS d_{n}" for n in views)
    diffs = ", ".join(f"o.c_{n} - x.c_{n} AS m_{n}, o.d_{n} - x.d_{n} AS b_{n}" for n in views)
    return f"""five AS MATERIALIZED {FIVE_SQL}, r AS (SELECT * FROM five WHERE vec_id % 5 = 0 AND label IN (3, {', '.join(map(str, VOICES))})), c AS (SELECT label, {', '.join(f'{centroid(n)} AS c{n}' for n in views)} FROM r GROUP BY label),
    sc AS MATERIALIZED (SELECT v.vec_id, r.label, {scores} FROM five v, r JOIN c USING (label) GROUP BY v.vec_id, r.label, {', '.join(f'v.{n}' for n in views)}),
    m AS (SELECT x.vec_id, x.label, list_position([{', '.join(map(str, VOICES))}], x.label) AS place, x.vec_id % 3 AS tier, {diffs} FROM sc x JOIN sc o ON o.vec_id = x.vec_id AND o.label = 3 WHERE x.label <> 3)"""


_VOTE = lambda n: f"(m_{n} <= 0.02 AND b_{n} <= 0.02)"


@register(
    "V17_exclusion_audits",
    f"""WITH {_margins_sql('p s rp rs')}, j AS (SELECT *, {_VOTE('p')} AS vp, {_VOTE('s')} AS vs, {_VOTE('rp')} AS vrp, {_VOTE('rs')} AS vrs FROM m),
    k AS (SELECT *, vp AND vs OR tier = 0 AND (vp AND (m_s < 0.15 OR b_s < 0.15) OR vs AND (m_p < 0.15 OR b_p < 0.15)) OR vrp AND vrs OR tier = 1 AND vrp AND vs AS rejected FROM j)
    SELECT vec_id AS id, 'voice' || label AS voice, rejected, vp AS primary_vote, vs AS secondary_vote FROM (
      SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY rejected DESC, CASE WHEN rejected THEN place ELSE m_p + m_s END, place) AS n FROM k) WHERE n = 1""",
)
def exclusion_audits(spark, d):
    """The excluded voice that rejects each vector first, or else comes nearest."""
    return ex.exclusion_audit(*audited_voices(spark, d)).select("id", "voice", "rejected", "primary_vote", "secondary_vote")


@register(
    "V25_multimodel_audits",
    f"""WITH {_margins_sql('p s t')}, j AS (SELECT *, {_VOTE('p')}::INTEGER + {_VOTE('s')}::INTEGER + {_VOTE('t')}::INTEGER AS votes, least(m_p, b_p, m_s, b_s, m_t, b_t) >= 0.02 AS clear FROM m)
    SELECT vec_id AS id, 'voice' || label AS voice, votes >= 2 AS rejected, votes, CASE WHEN votes >= 2 THEN clear ELSE every END AS all_clear FROM (
      SELECT *, bool_and(clear) OVER (PARTITION BY vec_id) AS every, row_number() OVER (PARTITION BY vec_id ORDER BY votes >= 2 DESC, CASE WHEN votes >= 2 THEN place ELSE m_p + m_s + m_t END, place) AS n FROM j) WHERE n = 1""",
)
def multimodel_audits(spark, d):
    """Votes of three models, each with vectors of its own, against excluded voices."""
    return ex.multimodel_audit(*audited_voices(spark, d))


def timed_turns(spark, d):
    """Turns of conversations with a unit for each word, of which one turn in nine has estimated ones; kept parts are
    the first and second half of the words."""
    t = fx.table(spark, d, "conversations").select("conv_id", "turn", tt.list_line(F.coalesce("text", F.lit(""))).alias("text"))
    words = F.filter(F.split("text", "(?U)\\s+"), lambda w: w != "")
    unit = lambda w, i: F.struct(w.alias("text"), (i * 200).cast("long").alias("start_ms"), (i * 200 + 150).cast("long").alias("end_ms"), F.coalesce((F.col("conv_id") + F.col("turn")) % 9 == 0, F.lit(False)).alias("estimated"))
    rows = t.withColumn("words", words).withColumn("units", F.transform("words", unit))
    middle = (F.floor(F.size("words") / 2) * 200).cast("long")
    end = F.greatest(F.size("words") * 200, F.lit(1)).cast("long")
    keep = lambda a, b: F.struct(a.alias("start_ms"), b.alias("end_ms"))
    return rows.withColumns({"end_ms": end, "keeps": F.array(keep(F.lit(0).cast("long"), middle), keep(middle, end))})


@register("X13_complete_units")
def complete_units(spark, d):
    """Whether a turn's measured units spell its whole text in order."""
    t = timed_turns(spark, d)
    units = tt.complete_units(F.col("text"), F.col("units"), F.lit(0), F.col("end_ms"))
    return t.select("conv_id", "turn", units.isNotNull().alias("complete"), F.size(F.coalesce(units, F.slice("units", 1, 0))).alias("n"))


@register("X14_timed_slice")
def timed_slice(spark, d):
    """The text of the second half of each completely timed turn."""
    t = timed_turns(spark, d).withColumn("ordered", tt.complete_units(F.col("text"), F.col("units"), F.lit(0), F.col("end_ms"))).where("ordered is not null")
    return t.select("conv_id", "turn", tt.timed_slice(F.col("text"), F.col("ordered"), F.col("keeps")[1]["start_ms"], F.col("keeps")[1]["end_ms"]).alias("piece"))


@register("X18_partial_text")
def partial_text(spark, d):
    """The text of both parts of each turn: given, shared, measured or none."""
    t = timed_turns(spark, d).withColumn("keep", F.explode("keeps"))
    given = F.when(F.col("conv_id") % 11 == 0, F.array(F.struct(F.lit(0).cast("long").alias("start_ms"), F.col("keeps")[0]["end_ms"].alias("end_ms"), F.lit("given text").alias("text"))))
    joined = F.when(F.col("conv_id") % 13 == 0, F.lit("first part;;second part"))
    text = tt.partial_text(F.col("text"), given, joined, F.col("keeps"), F.col("keep"), F.lit(0), F.col("end_ms"), F.col("units"))
    return t.select("conv_id", "turn", F.col("keep.start_ms").alias("start_ms"), text.alias("text"))


def gate_candidates(spark, d):
    """Views and purchases as candidates: a view of value 25 and more is accepted so far; clicks stand for member turns, long
    errors for proven conflicts."""
    s = fx.segments(spark, d).where("start_ms >= 0")
    rows = s.where("kind in ('view', 'purchase')").select("segment_id", "source_id", "start_ms", "end_ms", "value", (F.col("kind") == "view").alias("seen"))
    turns = iv.merge(s.where("kind = 'click'").select("source_id", "start_ms", "end_ms"))
    loud = iv.merge(s.where("kind = 'click' and value >= 60").select("source_id", "start_ms", "end_ms"))
    long_errors = s.where("kind = 'error' and value >= 60").select("source_id", "start_ms", "end_ms")
    rows = iv.covered_length(rows, turns)
    rows = iv.covered_length(rows.withColumnRenamed("covered_ms", "turn_ms"), loud).withColumnRenamed("covered_ms", "loud_ms")
    rows = iv.per_row(rows, long_errors, ["source_id"], lambda hit: [F.max(F.coalesce(hit, F.lit(False))).alias("conflict")])
    share, strong = F.col("turn_ms") / (F.col("end_ms") - F.col("start_ms")), F.col("loud_ms") / (F.col("end_ms") - F.col("start_ms"))
    accepted = F.col("seen") & (F.col("value") >= 25)
    reason = F.when(accepted, None).when(F.col("value") < 8, gate.SHORT).when(F.col("seen"), gate.WEAK).when(share > 0.8, gate.CLASSIFIER).otherwise(gate.MIXED)
    return rows.select(
        "segment_id", "source_id", "start_ms", "end_ms", F.col("segment_id").alias("place"), accepted.alias("accepted"), reason.alias("reject_reason"), F.lit(False).alias("hard"), (share >= 0.5).alias("allowed"),
        F.when(share >= 0.5, "member").otherwise("outside").alias("reason"), F.when(share >= 0.75, "A").when(share >= 0.3, "B").alias("tier"), (strong >= 0.999).alias("whole"), "conflict",
        F.lit(False).alias("fine_conflict"), F.lit(False).alias("contaminated"), (F.col("value") < 10).alias("rescue"), (F.lit(0.5) + strong / 2).alias("window_min"), share.alias("pass_ratio"),
        (share > 0).alias("borderline"), (strong > 0).alias("family_overlap"), (strong > 0.3).alias("strong_overlap"),
    )


@register("F27_gated_candidates")
def gated_candidates(spark, d):
    """What the gate makes of views and purchases."""
    observations, barriers = field_observations(spark, d), field_barriers(spark, d)
    cells, scales = tr.build_field(observations, barriers)
    assess = lambda spans: tr.assess_spans(spans, cells, scales, observations)
    clicks = iv.merge(fx.segments(spark, d, "click").where("start_ms >= 0").select("source_id", "start_ms", "end_ms"), gap=2 * HOUR)
    spans = clicks.withColumn("segment_id", F.concat_ws(":", "source_id", "start_ms"))
    verified = spans.join(assess(spans).where("integral > 0 and blocked_fraction = 0").select("segment_id"), "segment_id", "left_semi")
    errors = fx.segments(spark, d, "error").where("value >= 60").select("source_id", "start_ms", "end_ms")
    return gate.apply_gate(gate_candidates(spark, d), verified, barriers, errors, assess, 30 * MIN)
