"""Turns beside the target's core that a third channel or raw audio brings in, unless a rival would win."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators import intervals as iv
from cadenza.operators.turn_clusters import COMPETITOR, SALT_TURNS, TargetProfile, profile_scores

# Fixed values of the rules.
RIVAL_SLACK = 0.02
THIRD_ABOVE, THIRD_AHEAD, VIEW_ABOVE = 0.02, 0.02, 0.04
RAW_ABOVE = (0.04, 0.02)


@dataclass
class ThirdChannel:
    """The target's centroid and floor in a third channel, excluded voices there, and floors of two more views."""

    centroid: list
    floor: float
    excluded: list = field(default_factory=list)
    view_floors: tuple[float, float] = (0.45, 0.35)


def _unit(v) -> np.ndarray:
    m = np.array(list(v), float)
    n = np.linalg.norm(m, axis=-1, keepdims=True)
    return m / np.where(n > 1e-12, n, 1)


def competitor_wins(p: np.ndarray, s: np.ndarray, scores: tuple[np.ndarray, np.ndarray], own: np.ndarray, clusters: pd.DataFrame, profile: TargetProfile, roles: list[tuple[str, list, list]]) -> np.ndarray:
    """Whether an excluded voice, or another cluster that speaks enough and isn't the target's or the row's
    own (by its place, or -1), is at both floors and within 0.02 of the row's scores or above."""
    out = np.zeros(len(p), bool)
    heard = (((clusters.n >= COMPETITOR[0]) & (clusters.seconds >= COMPETITOR[1])) | clusters.known_rival).to_numpy(bool)
    others = [(_unit(a), _unit(b), -2) for _, a, b in roles]
    others += [(_unit(clusters.primary_centroid.iloc[k]), _unit(clusters.secondary_centroid.iloc[k]), k) for k in np.flatnonzero(heard & ~clusters.target.to_numpy(bool))]
    for a, b, k in others:
        x, y = p @ a, s @ b
        out |= (own != k) & (x >= profile.primary_floor) & (y >= profile.secondary_floor) & (x >= scores[0] - RIVAL_SLACK) & (y >= scores[1] - RIVAL_SLACK)
    return out


_OUT = ["source_id", "turn", "verdict", "third_score", "promoted_by", "rival_wins"]


def promote_turns(t: pd.DataFrame, clusters: pd.DataFrame, profile: TargetProfile, roles: list[tuple[str, list, list]], third: ThirdChannel) -> pd.DataFrame:
    """Verdicts of one source's turns after both promotions."""
    place = {x: k for k, m in enumerate(clusters.members) for x in m}
    own = np.array([place.get(x, -1) for x in t.turn])
    scores = lambda p, s: (profile_scores(p, profile.primary, profile.primary_references), profile_scores(s, profile.secondary, profile.secondary_references))
    p, s = _unit(t.primary), _unit(t.secondary)
    beaten = competitor_wins(p, s, scores(p, s), own, clusters, profile, roles)
    verdict = t.verdict.to_numpy(object).copy()
    by = np.full(len(t), None, object)
    third_score = np.full(len(t), np.nan)
    able = t.able.to_numpy(bool)

    seen = np.flatnonzero(able & t.third.notna().to_numpy())
    if len(seen):
        v = _unit(t.third.iloc[seen])
        score = v @ _unit(third.centroid)
        third_score[seen] = score
        lost = beaten[seen].copy()
        for c in third.excluded:
            lost |= score - v @ _unit(c) < THIRD_AHEAD
        rival = ((clusters.n >= COMPETITOR[0]) & (clusters.seconds >= COMPETITOR[1])) | clusters.known_rival
        for k in np.flatnonzero(rival.to_numpy(bool) & ~clusters.target.to_numpy(bool) & clusters.third_centroid.notna().to_numpy()):
            lost |= (own[seen] != k) & (score - v @ _unit(clusters.third_centroid.iloc[k]) < THIRD_AHEAD)
        views = [pd.to_numeric(t[c].iloc[seen]).to_numpy(float) >= f + VIEW_ABOVE for c, f in zip(("char_score", "va_score"), third.view_floors, strict=True)]
        border = np.isin(verdict[seen], ("borderline", "near_miss"))
        good = (verdict[seen] != "core") & (score >= third.floor + THIRD_ABOVE) & ~lost & (border | views[0] | views[1])
        verdict[seen[good]], by[seen[good]] = "core", "third"

    raw = np.flatnonzero(able & (verdict != "core") & t.raw_primary.notna().to_numpy() & t.raw_secondary.notna().to_numpy())
    if len(raw):
        rp, rs = _unit(t.raw_primary.iloc[raw]), _unit(t.raw_secondary.iloc[raw])
        x, y = scores(rp, rs)
        good = (x >= profile.primary_floor + RAW_ABOVE[0]) & (y >= profile.secondary_floor + RAW_ABOVE[1]) & ~competitor_wins(rp, rs, (x, y), own[raw], clusters, profile, roles)
        verdict[raw[good]], by[raw[good]] = "core", "raw"
    return pd.DataFrame(dict(zip(_OUT, (t.source_id.to_numpy(), t.turn.to_numpy(), verdict, third_score, by, beaten), strict=True)))


def promoted(turns: DataFrame, judged: DataFrame, verdicts: DataFrame, blocked: DataFrame, profile: TargetProfile, roles: list[tuple[str, list, list]], third: ThirdChannel) -> DataFrame:
    """source_id, turn, verdict, third_score, promoted_by (third, raw or null), rival_wins.

    A usable turn that nothing blocks joins the core by the third channel: at its floor and 0.02, ahead of
    all others there by 0.02, and borderline or supported by a further view; else by raw audio whose
    scores are above both floors.  Neither where a rival wins.  turns: source_id, turn, start_ms, end_ms,
    primary, secondary, third, raw_primary, raw_secondary, char_score, va_score (all of these may be null
    but the first two vectors).  judged, verdicts: of `assign_target`.  A cluster's vector in the third
    channel is the mean of its members that may be promoted; turns go in bounded parts of their source."""
    free = iv.overlap_join(turns.select("source_id", "turn", "start_ms", "end_ms"), blocked.select("source_id", "start_ms", "end_ms"), how="left_anti").select("source_id", "turn", F.lit(True).alias("able"))
    rows = turns.select("source_id", "turn", "primary", "secondary", "third", "raw_primary", "raw_secondary", "char_score", "va_score").join(verdicts.select("source_id", "turn", "verdict"), ["source_id", "turn"])
    rows = rows.join(free, ["source_id", "turn"], "left").withColumn("able", F.coalesce("able", F.lit(False)))
    width = len(third.centroid)
    unit = F.transform("third", lambda x: x / F.greatest(F.sqrt(F.aggregate("third", F.lit(0.0), lambda a, y: a + y * y)), F.lit(1e-12)))
    members = judged.select("source_id", "cluster", F.explode("members").alias("turn"))
    seen = members.join(rows.where("able and third is not null").select("source_id", "turn", unit.alias("u")), ["source_id", "turn"])
    centres = seen.groupBy("source_id", "cluster").agg(F.array(*[F.avg(F.get("u", F.lit(i))) for i in range(width)]).alias("third_centroid"))
    known = judged.select("source_id", "cluster", "members", "n", "seconds", "primary_centroid", "secondary_centroid", "known_rival", "target").join(centres, ["source_id", "cluster"], "left")
    salts = lambda name: rows.groupBy("source_id").agg(F.ceil(F.count("*") / SALT_TURNS).cast("int").alias(name))
    dealt = rows.join(salts("parts"), "source_id").withColumn("salt", F.expr("cast(pmod(xxhash64(turn), parts) as int)"))
    copies = known.join(salts("copies"), "source_id").withColumn("salt", F.expr("explode(sequence(0, copies - 1))"))

    def decide(t: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(t) or not len(c):
            return pd.DataFrame(columns=_OUT)
        return promote_turns(t.reset_index(drop=True), c.sort_values("cluster").reset_index(drop=True), profile, roles, third)

    kind = dict(turns.dtypes)["source_id"]
    pairs = dealt.groupBy("source_id", "salt").cogroup(copies.groupBy("source_id", "salt"))
    return pairs.applyInPandas(decide, f"source_id {kind}, turn long, verdict string, third_score double, promoted_by string, rival_wins boolean")
