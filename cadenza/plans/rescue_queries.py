"""Queries of rescued rows.  Five vectors in a row are the windows of a turn, parts of a vector its
channels and models; references are eight means of one label."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import rescue
from cadenza.functions import vectors as vf
from cadenza.functions.decisions import first_of
from cadenza.operators.recovery import promote_by_cluster
from cadenza.plans.catalogue import register
from cadenza.sources import fixtures as fx

WIDTH = 16
#: First component and pace of the noise of each model.
MODELS = {"sp": (1, 1), "ss": (17, 2), "rp": (33, 3), "rs": (49, 7), "third": (9, 4)}
PARTS = ("score", "best", "median", "p20", "votes")
THRESHOLD = 0.70
THIRD_FLOOR = 0.60
MOST_DIFFERENCE = 0.25
TURN = "vec_id div 5"


def _channels(spark, d):
    """vec_id, turn, label, model, pace, v: a row for each vector and model."""
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(a).alias("at"), F.lit(pace).alias("pace")) for m, (a, pace) in MODELS.items()])
    e = fx.table(spark, d, "embeddings").select("vec_id", F.expr(TURN).alias("turn"), "label", "embedding", F.inline(models))
    return e.select("vec_id", "turn", "label", "model", "pace", vf.unit(F.slice("embedding", F.col("at"), WIDTH)).alias("v"))


def _references(spark, d):
    """One row a model: eight reference vectors, the mean of the target and that of another voice."""
    g = _channels(spark, d).where("label in (0, 1)").groupBy("model", "label", F.expr("vec_id % 8").alias("r")).agg(vf.mean_vector("v", WIDTH).alias("v"))
    ordered = lambda label: F.transform(F.sort_array(F.collect_list(F.when(F.col("label") == label, F.struct("r", "v")))), lambda x: x["v"])
    mean = lambda vs: vf.unit(F.aggregate(vs, F.array_repeat(F.lit(0.0), WIDTH), lambda a, x: F.zip_with(a, x, lambda p, q: p + q)))
    g = g.groupBy("model").agg(ordered(0).alias("own"), ordered(1).alias("others")).select("model", "own", mean(F.col("own")).alias("target"), mean(F.col("others")).alias("other"))
    towards = lambda r: vf.unit(F.zip_with("target", vf.unit(r), lambda x, y: x + 0.6 * y))
    return g.select("model", "target", "other", F.transform("own", towards).alias("refs"))


def turns(spark, d):
    """turn, source_id, seconds, difference, clean, coverage, the matches `stem` and `raw`, the model
    `third`, the stem's unit vectors `sp` and `ss`, and scores against references by model."""
    e = _channels(spark, d).join(F.broadcast(_references(spark, d)), "model")  # five rows
    noise = 0.4 + 0.12 * ((F.col("turn") * F.col("pace")) % 13)
    base = F.when(F.col("turn") % 4 == 3, F.col("other")).otherwise(F.col("target"))
    w = e.withColumn("v", vf.unit(F.zip_with(base, "v", lambda x, y: x + noise * y)))
    windows = F.transform(F.sort_array(F.collect_list(F.struct("vec_id", F.round(vf.dot("v", "target"), 6).alias("s")))), lambda x: x["s"])
    g = w.groupBy("turn", "model").agg(F.first("refs").alias("refs"), F.first("target").alias("target"), windows.alias("windows"), vf.unit(vf.mean_vector("v", WIDTH)).alias("v"))  # equal in all rows
    g = g.select("turn", "model", "windows", "v", F.transform("refs", lambda r: F.round(vf.dot("v", r), 6)).alias("scores"), F.round(vf.dot("v", "target"), 6).alias("score"))
    votes = F.size(F.filter("windows", lambda x: x >= 0.5)) / F.size("windows")
    p20 = F.element_at(F.sort_array("windows"), F.floor((F.size("windows") - 1) / 5).cast("int") + 1)
    measures = (F.col("score"), F.array_max("scores"), vf.lower_median(F.col("scores")), p20, votes)
    model = F.struct(*[c.alias(n) for n, c in zip(PARTS, measures)], "windows", "scores", "v")
    g = g.select("turn", "model", model.alias("m")).groupBy("turn").agg(*[F.first(F.when(F.col("model") == m, F.col("m")), True).alias(m) for m in MODELS])

    def match(p, s):
        pairs = F.zip_with(f"{p}.scores", f"{s}.scores", lambda x, y: F.round((x + y) / 2, 6))
        at = lambda x, y: (F.col(f"{p}.score") >= x) & (F.col(f"{s}.score") >= y)
        tier = first_of(("strong", at(0.95, 0.93)), ("balanced", at(0.90, 0.86)), ("recall", at(0.55, 0.45)), otherwise="rejected")
        return F.struct(at(0.90, 0.86).alias("accepted"), tier.alias("tier"), vf.lower_median(pairs).alias("paired"), F.col(p).alias("primary"), F.col(s).alias("secondary"))

    seconds = F.when(F.col("turn") % 4 == 3, 0.25 + 0.125 * (F.col("turn") % 7)).otherwise(0.25 + 0.375 * (F.col("turn") % 11))
    coverage = F.round(F.size(F.filter("third.windows", lambda x: x >= 0.5)) / F.size("third.windows"), 6)
    return g.select(
        "turn", F.expr("turn div 10").alias("source_id"), seconds.alias("seconds"), (0.03 * (F.col("turn") % 10)).alias("difference"), (F.col("turn") % 9 != 0).alias("clean"),
        coverage.alias("coverage"), match("sp", "ss").alias("stem"), match("rp", "rs").alias("raw"), "third", F.col("sp.v").alias("sp"), F.col("ss.v").alias("ss"), *[F.col(f"{m}.scores").alias(f"{m}_scores") for m in MODELS],
    )


def _columns(names):
    return ", ".join(names)


def _unit(v: str) -> str:
    return f"list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda y: y * y))))"


def _part(a: int) -> str:
    return f"list_transform(embedding[{a}:{a + WIDTH - 1}], lambda x: CAST(x AS DOUBLE))"


def _mean(v: str) -> str:
    return f"[{_columns(f'avg({v}[{i}])' for i in range(1, WIDTH + 1))}]"


def _median(v: str) -> str:
    return f"list_sort({v})[(len({v}) + 1) // 2]"


def _twin() -> str:
    """The CTEs up to `t`, the turns in columns like sp_score, stem_tier and raw_paired."""
    ms = list(MODELS)
    units = _columns(f"{_unit(_part(a))} AS {m}" for m, (a, _) in MODELS.items())
    model = lambda m: f"list_max({m}_scores) AS {m}_best, {_median(f'{m}_scores')} AS {m}_median, list_sort({m}_windows)[1 + (len({m}_windows) - 1) // 5] AS {m}_p20, len(list_filter({m}_windows, lambda x: x >= 0.5)) / len({m}_windows) AS {m}_votes"
    pair = lambda p, s: _median(f"list_transform(list_zip({p}_scores, {s}_scores), lambda x: round((x[1] + x[2]) / 2, 6))")
    tier = lambda p, s: f"CASE WHEN {p}_score >= 0.95 AND {s}_score >= 0.93 THEN 'strong' WHEN {p}_score >= 0.90 AND {s}_score >= 0.86 THEN 'balanced' WHEN {p}_score >= 0.55 AND {s}_score >= 0.45 THEN 'recall' ELSE 'rejected' END"
    return f"""WITH e AS MATERIALIZED (SELECT vec_id, label, vec_id // 5 AS turn, {units} FROM embeddings),
    r8 AS (SELECT label, vec_id % 8 AS r, {_columns(f"{_mean(m)} AS {m}" for m in ms)} FROM e WHERE label IN (0, 1) GROUP BY ALL),
    m2 AS (SELECT label, {_columns(f"{_mean(m)} AS {m}" for m in ms)} FROM r8 GROUP BY label),
    mu AS (SELECT label, {_columns(f"{_unit(m)} AS {m}" for m in ms)} FROM m2),
    r0 AS (SELECT r, {_columns(f"{_unit(m)} AS {m}" for m in ms)} FROM r8 WHERE label = 0),
    rm AS (SELECT r, {_columns(f"list_transform(list_zip(mu.{m}, r0.{m}), lambda z: z[1] + 0.6 * z[2]) AS {m}" for m in ms)} FROM r0 JOIN mu ON mu.label = 0),
    ru AS (SELECT r, {_columns(f"{_unit(m)} AS {m}" for m in ms)} FROM rm),
    x AS (SELECT e.vec_id, e.turn, {_columns(f"list_transform(list_zip(b.{m}, e.{m}), lambda z: z[1] + (0.4 + 0.12 * ((e.turn * {k}) % 13)) * z[2]) AS {m}" for m, (_, k) in MODELS.items())} FROM e JOIN mu b ON b.label = CASE WHEN e.turn % 4 = 3 THEN 1 ELSE 0 END),
    w AS MATERIALIZED (SELECT vec_id, turn, {_columns(f"{_unit(m)} AS {m}" for m in ms)} FROM x),
    g AS (SELECT turn, {_columns(f"{_mean(f'w.{m}')} AS {m}, list(round(list_dot_product(w.{m}, mu.{m}), 6) ORDER BY vec_id) AS {m}_windows" for m in ms)} FROM w JOIN mu ON mu.label = 0 GROUP BY turn),
    u AS MATERIALIZED (SELECT turn, {_columns(f"{_unit(m)} AS {m}, {m}_windows" for m in ms)} FROM g),
    s AS (SELECT turn, {_columns(f"list(round(list_dot_product(u.{m}, ru.{m}), 6) ORDER BY r) AS {m}_scores" for m in ms)} FROM u JOIN ru ON true GROUP BY turn),
    a AS (SELECT u.*, {_columns(f"s.{m}_scores, round(list_dot_product(u.{m}, mu.{m}), 6) AS {m}_score" for m in ms)} FROM u JOIN s USING (turn) JOIN mu ON mu.label = 0),
    t AS MATERIALIZED (SELECT *, {_columns(model(m) for m in ms)}, {pair("sp", "ss")} AS stem_paired, {pair("rp", "rs")} AS raw_paired, {tier("sp", "ss")} AS stem_tier, {tier("rp", "rs")} AS raw_tier, turn // 10 AS source_id,
      CASE WHEN turn % 4 = 3 THEN CAST(0.25 + 0.125 * (turn % 7) AS DOUBLE) ELSE CAST(0.25 + 0.375 * (turn % 11) AS DOUBLE) END AS seconds, CAST(0.03 AS DOUBLE) * (turn % 10) AS difference, turn % 9 <> 0 AS clean, round(len(list_filter(third_windows, lambda x: x >= 0.5)) / len(third_windows), 6) AS coverage FROM a)"""


TWIN = _twin()

_LOW = "len(list_filter(list_zip(sp_windows, ss_windows), lambda x: x[1] < 0.35 AND x[2] < 0.32)) / len(sp_windows)"
_DIAGONAL = "list_transform(list_zip(rp_scores, ss_scores), lambda x: CASE WHEN x[1] >= {0} AND x[2] >= {1} THEN least(x[1], x[2]) END)"


def _at(names: dict[str, float]) -> str:
    return " AND ".join(f"{k} >= {v}" for k, v in names.items())


def _best(array: str) -> str:
    return f"list_max(list_filter({array}, lambda x: x IS NOT NULL))"


_SHARED = lambda a, b: f"list_max(list_transform(list_zip({a}_scores, {b}_scores), lambda x: least(x[1], x[2])))"
_STRONG = _best(_DIAGONAL.format(0.56, 0.58))
_WEAK = _best(_DIAGONAL.format(0.46, 0.48))


@register(
    "F32_rescue_verdicts",
    f"""{TWIN}, v AS (SELECT *, {_at({"sp_score": 0.46, "ss_score": 0.42, "sp_best": 0.42, "ss_best": 0.40, "stem_paired": 0.38, "greatest(sp_p20, ss_p20)": 0.34})} AS heard,
      raw_tier IN ('strong', 'balanced') AND {_at({"rp_score": 0.64, "rs_score": 0.62, "rp_best": 0.60, "rs_best": 0.58, "raw_paired": 0.56, "greatest(rp_p20, rs_p20)": 0.48})} AS strict,
      rp_score - sp_score >= 0.05 AND {_at({"rp_score": 0.56, "ss_score": 0.58, "sp_score": 0.46, "rs_score": 0.48, "rp_best": 0.57, "ss_best": 0.58, "rp_p20": 0.47, "ss_p20": 0.42, "greatest(raw_paired, stem_paired)": 0.50})}
        AND coalesce({_STRONG}, CASE WHEN {_WEAK} IS NOT NULL THEN least(rp_best, ss_best) ELSE 0 END) >= 0.50 AS crossed,
      {_SHARED("sp", "rp")} >= 0.46 AND {_SHARED("ss", "rs")} >= 0.42 AS shared, greatest(rp_score - sp_score, rs_score - ss_score, raw_paired - stem_paired) >= 0.03 AS gained, {_LOW} AS low FROM t)
    SELECT turn, CASE WHEN NOT clean THEN 'clean_gate_disabled' WHEN difference > 0.25 THEN 'channel_duration_mismatch' WHEN seconds < 0.35 THEN 'duration_too_short' WHEN seconds >= 1.8 AND low > 0.2 THEN 'uvr_discontinuous'
      WHEN NOT heard THEN 'uvr_insufficient_evidence' WHEN NOT strict AND NOT crossed THEN 'raw_and_diagonal_evidence_below_floor' WHEN strict AND NOT shared THEN 'cross_channel_reference_mismatch'
      WHEN strict AND NOT gained THEN 'raw_gain_insufficient' WHEN strict THEN 'accepted' ELSE 'accepted_diagonal' END AS outcome FROM v""",
)
def rescue_verdicts(spark, d):
    """Each turn's rescue by its other channel, or the first reason against it."""
    t = turns(spark, d)
    four = rescue.four_way_support(*[F.col(f"{m}_scores") for m in ("sp", "ss", "rp", "rs")])
    diagonal = rescue.diagonal_support(F.col("rp_scores"), F.col("ss_scores"), THRESHOLD)
    t = t.withColumns({"four": four, "diagonal": diagonal})
    outcome = rescue.second_channel_rescue(F.col("stem"), F.col("raw"), THRESHOLD, F.col("seconds"), F.col("clean"), F.col("difference"), MOST_DIFFERENCE, F.col("four"), F.col("diagonal"))
    return t.select("turn", outcome.alias("outcome"))


_REFUSED = "stem_tier IN ('recall', 'rejected')"


def _fragment(p: str = "") -> str:
    return f"{p}{_REFUSED} AND {p}seconds BETWEEN 0.75 AND 8 AND " + _at({f"{p}{k}": v for k, v in {"sp_score": 0.48, "ss_score": 0.44, "sp_best": 0.43, "ss_best": 0.40, "third_score": 0.60, "third_best": 0.60, "third_p20": 0.55}.items()})


@register(
    "F33_third_promotions",
    f"""{TWIN} SELECT c.turn, c.{_REFUSED} AND c.seconds BETWEEN 2.2 AND 15 AND {_at({"c.sp_score": 0.40, "c.ss_score": 0.53, "c.ss_score - c.sp_score": 0.03, "c.sp_best": 0.38, "c.ss_best": 0.48, "c.third_score": 0.60, "c.third_best": 0.60, "c.third_p20": 0.52})} AS whole,
      {_fragment("c.")} AS fragment, coalesce({_fragment("c.")} AND n.{_REFUSED} AND n.seconds BETWEEN 0.25 AND 0.90 AND n.sp_best <= 0.42 AND n.ss_best <= 0.35 AND {_at({f"c.{x} - n.{x}": 0.15 for x in ("sp_score", "sp_best", "ss_score", "ss_best")})}
        AND n.third_best <= 0.45 AND {_at({f"c.{x} - n.{x}": 0.25 for x in ("third_score", "third_best")})}, false) AS edge FROM t c LEFT JOIN t n ON n.source_id = c.source_id AND n.turn = c.turn + 1""",
)
def third_promotions(spark, d):
    """Which refused turns the third model promotes: whole, as a fragment, or against the turn that follows in the source."""
    t = turns(spark, d).select("turn", "source_id", "seconds", "stem", "third")
    after = t.select("source_id", (F.col("turn") - 1).alias("turn"), F.struct("seconds", "stem", "third").alias("n"))
    floor, n = F.lit(THIRD_FLOOR), F.col("n")
    return t.join(after, ["source_id", "turn"], "left").select(
        "turn",
        rescue.whole_turn_promoted(F.col("stem"), F.col("third"), floor, F.col("seconds")).alias("whole"),
        rescue.fragment_promoted(F.col("stem"), F.col("third"), floor, F.col("seconds")).alias("fragment"),
        rescue.edge_promoted(F.col("stem"), n["stem"], F.col("third"), n["third"], floor, F.col("seconds"), n["seconds"]).alias("edge"),
    )


@register(
    "F19_confirmed_recall",
    f"""{TWIN} SELECT turn, stem_tier = 'recall' AND clean AND {_at({"coverage": 0.90, "sp_votes": 0.75, "ss_votes": 0.75, "sp_p20": 0.50, "ss_p20": 0.46, "sp_score": 0.58, "ss_score": 0.50, "sp_median": 0.50, "ss_median": 0.44, "stem_paired": 0.49})} AS promoted FROM t""",
)
def confirmed_recall(spark, d):
    """Turns of middling scores that every window and the references confirm."""
    return turns(spark, d).select("turn", rescue.confirmed_recall(F.col("stem"), F.col("coverage"), F.col("clean")).alias("promoted"))


@register(
    "V18_global_cluster",
    f"""{TWIN}, c AS (SELECT source_id, {_mean("sp")} AS sp_seed, {_mean("ss")} AS ss_seed FROM t WHERE stem_tier IN ('strong', 'balanced') GROUP BY source_id HAVING count(*) >= 3),
    k AS (SELECT source_id, {_unit("sp_seed")} AS sp_seed, {_unit("ss_seed")} AS ss_seed FROM c)
    SELECT turn, round(list_dot_product(sp, sp_seed), 6) AS near_primary, round(list_dot_product(ss, ss_seed), 6) AS near_secondary, coalesce(stem_tier = 'recall' AND clean AND list_dot_product(sp, sp_seed) >= 0.78 AND list_dot_product(ss, ss_seed) >= 0.72
      AND {_at({"coverage": 0.85, "sp_score": 0.58, "ss_score": 0.47, "stem_paired": 0.47, "sp_best": 0.54, "ss_best": 0.44})}, false) AS promoted FROM t LEFT JOIN k USING (source_id)""",
)
def global_cluster(spark, d):
    """Turns near the voice of their source's accepted turns."""
    t = turns(spark, d).select("turn", "source_id", "stem", "coverage", "clean", "sp", "ss")
    seed = F.col("stem")["accepted"]
    out = promote_by_cluster(t, ["source_id"], seed, ~seed & F.col("clean"), "stem", "coverage", "sp", "ss", WIDTH)
    return out.select("turn", F.round("cluster_primary", 6).alias("near_primary"), F.round("cluster_secondary", 6).alias("near_secondary"), F.col("cluster_promoted").alias("promoted"))
