"""References that grow by rounds from a source's own accepted turns, and profiles adapted to strict anchors.

A round scores every turn that isn't accepted yet by the target's own profile and, with equal
weight, the mean of the bank's references by seconds; what it accepts may become references of
the next.  A turn is never judged by itself or by what it supported: references whose own
interval, or that of any turn they rest on, overlaps the turn are left out of its mean.  That mean
is the bank's sum less the sum of those few, which a range join finds, so no turn meets all
references.  Each source grows by itself; rounds are tables, and end when no source grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import vectors as vf
from cadenza.operators import intervals as iv
from cadenza.operators.storage import materialised
from cadenza.operators.turn_clusters import TargetProfile

# Fixed values of the rules.
MIN_SCORE, MIN_MARGIN = 0.75, 0.15
BANK, SAME = 500, 0.95
MARGIN = 0.06
PRIMARY_GAIN, SECONDARY_GAIN = (0.10, 0.14), (0.08, 0.11)

_VECTOR = ["source_id", "turn", "start_ms", "end_ms", "seconds", "primary", "secondary"]


def collect_evidence(turns: DataFrame, judged: DataFrame, accepted: DataFrame, blocked: DataFrame) -> DataFrame:
    """Turns whose vectors may serve as references: accepted members of a source's best target cluster,
    where that is at `MIN_SCORE` and `MIN_MARGIN` in both channels; not blocked anywhere, clean as a
    whole (`clean_ms` is null or the turn's length) and not rescued by raw audio (`raw_rescued`).
    accepted: source_id, turn, cluster.  Adds confidence, the cluster's lower score."""
    sure = judged.where("best").where((F.least("primary_score", "secondary_score") >= MIN_SCORE) & (F.col("least_margin") >= MIN_MARGIN))
    sure = sure.select("source_id", "cluster", F.least("primary_score", "secondary_score").alias("confidence"))
    mine = accepted.join(sure, ["source_id", "cluster"]).select("source_id", "turn", "confidence")
    whole = F.coalesce(F.col("clean_ms") == F.col("end_ms") - F.col("start_ms"), F.lit(True)) & ~F.coalesce("raw_rescued", F.lit(False))
    rows = turns.where("usable").where(whole).select(*_VECTOR).join(mine, ["source_id", "turn"])
    return iv.overlap_join(rows, blocked.select("source_id", "start_ms", "end_ms"), how="left_anti")


def bank_of(evidence: DataFrame, most: int = BANK, same: float = SAME) -> DataFrame:
    """The evidence without repeats: by confidence, seconds, start and end, a vector is left out if a kept
    one is at `same` to it in both channels; at most `most` a source.  Sources stream through their
    tasks in that order, and only what is kept is held."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, p, s = None, [], []
        for rows in batches:
            out = []
            for i, (name, a, b) in enumerate(zip(rows.source_id, rows.primary, rows.secondary, strict=True)):
                if name != source:
                    source, p, s = name, [], []
                a, b = (np.asarray(v, float) / max(float(np.linalg.norm(v)), 1e-12) for v in (a, b))
                if len(p) >= most or (p and bool(((np.array(p) @ a >= same) & (np.array(s) @ b >= same)).any())):
                    continue
                p.append(a)
                s.append(b)
                out.append(i)
            yield rows.iloc[out]

    ordered = evidence.repartition("source_id").sortWithinPartitions("source_id", F.desc("confidence"), F.desc("seconds"), "start_ms", "end_ms", "turn")
    return ordered.mapInPandas(keep, evidence.schema)


def _lit(v: list) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def _sums(df: DataFrame, by: list[str], widths: dict[str, int]) -> DataFrame:
    """Sums of unit vectors times seconds, and the number of them."""
    unit = df.select(*by, "seconds", *[vf.unit(c).alias(c) for c in widths])
    sums = [F.array(*[F.sum(F.get(c, F.lit(i)) * F.col("seconds")) for i in range(w)]).alias(f"{c}_sum") for c, w in widths.items()]
    return unit.groupBy(*by).agg(F.count("*").alias("n"), *sums)


def score_independently(turns: DataFrame, bank: DataFrame, spans: DataFrame, profile: TargetProfile, roles: list[tuple[str, list, list]], margin: float = MARGIN) -> DataFrame:
    """turns with n_refs (references that don't depend on the turn), primary_score, secondary_score and
    passed.  spans: source_id, turn (a reference), start_ms, end_ms: its own interval and all it rests on."""
    widths = {"primary": len(profile.primary), "secondary": len(profile.secondary)}
    total = _sums(bank, ["source_id"], widths)
    asked = turns.select("source_id", F.col("turn").alias("asked"), "start_ms", "end_ms")
    near = iv.overlap_join(asked, spans.select("source_id", F.col("turn").alias("ref"), "start_ms", "end_ms")).select("source_id", "asked", F.col("b_ref").alias("turn")).distinct()
    own = _sums(near.join(bank, ["source_id", "turn"]), ["source_id", "asked"], widths)
    less = own.select("source_id", F.col("asked").alias("turn"), F.col("n").alias("own_n"), *[F.col(f"{c}_sum").alias(f"own_{c}") for c in widths])
    rows = turns.join(total, "source_id", "left").join(less, ["source_id", "turn"], "left").withColumn("n_refs", F.coalesce(F.col("n") - F.coalesce("own_n", F.lit(0)), F.lit(0)).cast("int"))
    user = {"primary": profile.primary, "secondary": profile.secondary}
    passed = F.lit(True)
    for k, (c, floor) in enumerate((("primary", profile.primary_floor), ("secondary", profile.secondary_floor))):
        rest = F.when(F.col(f"own_{c}").isNull(), F.col(f"{c}_sum")).otherwise(F.zip_with(f"{c}_sum", f"own_{c}", lambda a, b: a - b))
        anchor = vf.unit(_lit(user[c]))
        mixed = F.when(F.col("n_refs") > 0, F.zip_with(anchor, vf.unit(rest), lambda a, b: 0.5 * a + 0.5 * b)).otherwise(anchor)
        rows = rows.withColumn(f"{c}_score", F.coalesce(vf.cosine(c, mixed), vf.cosine(c, anchor)))
        others = [vf.cosine(c, _lit(r[1 + k])) for r in roles]
        ahead = F.col(f"{c}_score") - (F.greatest(*others, F.lit(-1.0)) if others else F.lit(-1.0)) >= margin
        passed = passed & (F.col(f"{c}_score") >= floor) & ahead
    return rows.select(*turns.columns, "n_refs", "primary_score", "secondary_score", F.coalesce(passed, F.lit(False)).alias("passed"))


def bootstrap_rounds(turns: DataFrame, judged: DataFrame, core: DataFrame, blocked: DataFrame, profile: TargetProfile, roles: list[tuple[str, list, list]], margin: float = MARGIN, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """(accepted, report): source_id, turn, cluster, round (0: from the start); and for each source and
    round the references used, the turns it brought, and all accepted so far.

    turns: source_id, turn, start_ms, end_ms, seconds, primary, secondary, usable, clean_ms, raw_rescued.
    core: source_id, turn, cluster of the turns accepted at the start.  A turn that a round accepts counts
    to its source's best target cluster."""
    if not 1 <= rounds <= 10:
        raise ValueError("between 1 and 10 rounds")
    accepted = materialised(core.select("source_id", "turn", "cluster", F.lit(0).alias("round")), "accepted")
    bank = materialised(bank_of(collect_evidence(turns, judged, accepted, blocked)), "bank")
    rests = None  # (source_id, turn, on): what later references rest on
    best = judged.where("best").select("source_id", "cluster")
    report = None
    spots = turns.select("source_id", F.col("turn").alias("on"), "start_ms", "end_ms")
    for number in range(1, rounds + 1):
        refs = bank.select("source_id", "turn")
        own = refs.withColumn("on", F.col("turn"))
        on = own if rests is None else own.unionByName(rests.join(refs, ["source_id", "turn"], "left_semi")).distinct()
        on = materialised(on, "supports")
        spans = on.join(spots, ["source_id", "on"])
        open_ = turns.where("usable").select(*_VECTOR).join(accepted.select("source_id", "turn"), ["source_id", "turn"], "left_anti")
        open_ = open_.join(refs.select("source_id").distinct(), "source_id", "left_semi")
        new = score_independently(open_, bank, spans, profile, roles, margin).where("passed").select("source_id", "turn", "start_ms", "end_ms", "n_refs")
        new = materialised(new.join(best, "source_id"), "grown")
        used = refs.groupBy("source_id").agg(F.count("*").alias("used_refs"))
        grown = new.groupBy("source_id").agg(F.count("*").alias("new_turns"))
        accepted = materialised(accepted.unionByName(new.select("source_id", "turn", "cluster", F.lit(number).alias("round"))), "accepted")
        totals = accepted.groupBy("source_id").agg(F.count("*").alias("accepted_turns"))
        row = used.join(grown, "source_id", "left").join(totals, "source_id").select("source_id", F.lit(number).alias("round"), "used_refs", F.coalesce("new_turns", F.lit(0)).alias("new_turns"), "accepted_turns")
        report = row if report is None else report.unionByName(row)
        if new.isEmpty():
            break
        # A new turn rests on the references it was judged by, and on all those rest on.
        hit = iv.overlap_join(new.select("source_id", F.col("turn").alias("asked"), "start_ms", "end_ms"), spans.select("source_id", F.col("turn").alias("ref"), "start_ms", "end_ms"))
        apart = hit.select("source_id", F.col("asked").alias("turn"), F.col("b_ref").alias("ref")).distinct()
        judged_by = new.select("source_id", "turn").join(refs.select("source_id", F.col("turn").alias("ref")), "source_id").join(apart, ["source_id", "turn", "ref"], "left_anti")
        more = judged_by.join(on.withColumnRenamed("turn", "ref"), ["source_id", "ref"]).select("source_id", "turn", "on").distinct()
        rests = materialised(more if rests is None else rests.unionByName(more), "rests")
        bank = materialised(bank_of(collect_evidence(turns, judged, accepted, blocked)), "bank")
    return accepted, materialised(report, "rounds")


def strict_anchors(rows: DataFrame) -> DataFrame:
    """Accepted turns that may anchor an adapted profile: 2.2 to 15 seconds (over 4.5 only where the turn
    was merged over silence), of a strong tier, covered and voiced, with no edge from recall."""
    seconds = F.col("seconds")
    rule = seconds.between(2.20, 15.0) & ((seconds <= 4.50) | F.coalesce("silence_merged", F.lit(False))) & F.col("tier").isin("short_strong", "strong", "balanced")
    rule = rule & (F.coalesce("coverage", F.lit(0.0)) >= 0.90) & (F.coalesce("speech_ratio", F.lit(1.0)) >= 0.80) & (F.coalesce("recall_edges", F.lit(0)) == 0)
    return rows.where(F.coalesce(rule, F.lit(False)))


def adapted_profiles(anchors: DataFrame, profile: TargetProfile, least: int = 3) -> DataFrame:
    """One row a source with at least `least` anchors that have vectors: n_anchors, centroids of the
    references and anchors together, and gain floors: the tenth percentile of what anchors gain over
    their own scores, held within fixed bounds."""
    rows = anchors.where("primary is not null and secondary is not null and primary_score is not null and secondary_score is not null")
    refs = {"primary": profile.primary_references, "secondary": profile.secondary_references}
    rows = rows.select("source_id", "primary_score", "secondary_score", *[vf.unit(c).alias(c) for c in refs])
    sums = []
    for c, held in refs.items():
        units = [np.array(v, float) / np.linalg.norm(v) for v in held]
        base = np.sum(units, axis=0) if units else np.zeros(len(getattr(profile, c)))
        sums.append(F.array(*[F.sum(F.get(c, F.lit(i))) + F.lit(float(base[i])) for i in range(len(base))]).alias(f"{c}_mean"))
    centres = rows.groupBy("source_id").agg(F.count("*").alias("n_anchors"), *sums).where(F.col("n_anchors") >= least)
    centres = centres.select("source_id", "n_anchors", *[vf.unit(f"{c}_mean").alias(f"{c}_centroid") for c in refs])
    gains = rows.join(centres, "source_id")
    gain = lambda c: vf.dot(c, f"{c}_centroid") - F.col(f"{c}_score")
    held = lambda c, b: F.greatest(F.lit(b[0]), F.least(F.lit(b[1]), F.percentile(gain(c), F.lit(0.1)))).alias(f"{c}_gain_floor")
    floors = gains.groupBy("source_id").agg(held("primary", PRIMARY_GAIN), held("secondary", SECONDARY_GAIN))
    return centres.join(floors, "source_id")
