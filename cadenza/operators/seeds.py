"""Anchors and seeds: windows that are sure enough to learn from, and complete lines that stand for a voice.

Both are filters over range joins; what excludes what goes by greedy suppression or by rounds in which each
voice picks one row, so no voice's rows come together in one task.  Times are integer milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import vectors as vf
from cadenza.functions.scores import finite
from cadenza.operators import intervals as iv
from cadenza.operators.evaluation import group_quantiles
from cadenza.operators.greedy import suppress
from cadenza.operators.storage import materialised

START, END = iv.START, iv.END


def no(c: str) -> Column:
    return ~F.coalesce(F.col(c), F.lit(False))


def prototype_anchors(windows: DataFrame, clean: DataFrame, blocked: DataFrame, scale_p: float, scale_s: float) -> DataFrame:
    """window_id, source_id, turn, start_ms, end_ms, confidence: strictly clean windows at or above their source's
    median confidence that overlap no surer one (ties: earlier start, then end).

    windows: window_id, source_id, turn, start_ms, end_ms, accepted, smoothed, reference, raw_audit, micro,
    scene_supported, compensated, cm_p, cm_s (margins over the cohort), z_p, z_s (channel evidence), strict.  A window
    counts if it is accepted and strict, nothing marks it, it lies in a clean part of its turn and in no
    blocked interval, and all four numbers are above 0."""
    numbers = [finite(F.col(c)) > 0 for c in ("cm_p", "cm_s", "z_p", "z_s")]
    rule = F.col("accepted") & F.col("strict")
    for c in ("smoothed", "reference", "raw_audit", "micro", "scene_supported", "compensated"):
        rule = rule & no(c)
    for n in numbers:
        rule = rule & n
    rows = windows.where(F.coalesce(rule, F.lit(False)))
    rows = iv.overlap_join(rows, blocked.select("source_id", START, END), how="left_anti")
    within = iv.overlap_join(rows.select("window_id", "source_id", "turn", START, END), clean.select("source_id", "turn", START, END), ["source_id", "turn"])
    within = within.where(f"b_{START} <= {START} and b_{END} >= {END}").select("window_id").distinct()
    strength = F.least("z_p", "z_s", F.col("cm_p") / scale_p, F.col("cm_s") / scale_s)
    sure = rows.join(within, "window_id", "left_semi").select("window_id", "source_id", "turn", START, END, (1 / (1 + F.exp(-strength))).alias("confidence"))
    sure = materialised(sure, "sure")
    middle = group_quantiles(sure, "source_id", "confidence", 0.5, "middle")
    upper = materialised(sure.join(middle, "source_id").where("confidence >= middle").drop("middle"), "upper")
    met = iv.overlap_join(upper.select("source_id", "window_id", START, END, "confidence"), upper.select("source_id", "window_id", START, END, "confidence"))
    rank = lambda p: F.struct((-F.col(f"{p}confidence")).alias("c"), F.col(p + START).alias("s"), F.col(p + END).alias("e"), F.col(f"{p}window_id").alias("i"))
    conflicts = met.where(rank("") < rank("b_")).select(F.col("window_id").alias("better"), F.col("b_window_id").alias("worse"))
    return upper.join(suppress(conflicts).select(F.col("id").alias("window_id")), "window_id", "left_anti")


def _clip(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def seed_candidates(members: DataFrame, cues: DataFrame, windows: DataFrame) -> DataFrame:
    """source_id, cluster, turn, start_ms, end_ms, text, single_cue, windows_verified, coverage, minimum, second_minimum,
    variation, exclusion, quality: lines of 1.8 to 6 seconds that may stand for a cluster.

    A member that meets cues gives those it contains whole and that overlap no other one it meets by over
    60 ms; else it is a line itself.  Windows of the turn that share 450 ms with the line all have to be accepted,
    not smoothed, and hardly vary (0.12); nothing may be closer to another voice.

    members: source_id, cluster, turn, start_ms, end_ms, outlier, margin, primary_score, secondary_score.  cues:
    source_id, start_ms, end_ms, text.  windows: source_id, turn, start_ms, end_ms, accepted, smoothed, primary, secondary,
    cm_p, cm_s."""
    sound = F.col("margin").isNull() | F.coalesce(finite(F.col("margin")) >= 0, F.lit(False))
    kept = members.where((F.col(END) > F.col(START)) & no("outlier") & sound)
    kept = materialised(kept.select("source_id", "cluster", "turn", START, END, "margin", "primary_score", "secondary_score"), "members")
    own = ["source_id", "cluster", "turn"]
    met = iv.overlap_join(kept.select(*own, START, END), cues.where(F.col(END) > F.col(START)).select("source_id", START, END, "text"), least=50)
    met = met.select(*own, F.col(START).alias("m_start"), F.col(END).alias("m_end"), F.col(f"b_{START}").alias(START), F.col(f"b_{END}").alias(END), F.col("b_text").alias("text"))
    met = materialised(met.withColumn("cue", F.concat_ws(":", START, END, F.md5(F.coalesce("text", F.lit("")).cast("binary")))), "cues")
    counts = met.groupBy(*own).agg(F.count("*").alias("n"))
    inside = met.where(f"{START} >= m_start and {END} <= m_end")
    clash = iv.overlap_join(inside.select(*own, "cue", START, END), met.select(*own, "cue", START, END), own, least=60).where("cue <> b_cue").select(*own, "cue").distinct()
    alone = inside.join(clash, [*own, "cue"], "left_anti").join(counts, own).select(*own, START, END, F.coalesce("text", F.lit("")).alias("text"), (F.col("n") == 1).alias("single_cue"))
    bare = kept.join(counts, own, "left_anti").select(*own, START, END, F.lit("").alias("text"), F.lit(False).alias("single_cue"))
    lines = alone.unionByName(bare).where(F.col(END) - F.col(START) >= 1800).where(F.col(END) - F.col(START) <= 6000)
    lines = materialised(lines.withColumn("line", F.concat_ws(":", *own, START, END, F.md5(F.col("text").cast("binary")))), "lines")

    near = iv.overlap_join(lines.select("source_id", "turn", "line", START, END), windows.select("source_id", "turn", START, END, "accepted", "smoothed", "primary", "secondary", "cm_p", "cm_s"), ["source_id", "turn"], least=449)
    p, s, cp, cs = (F.col(f"b_{c}") for c in ("primary", "secondary", "cm_p", "cm_s"))
    good = F.coalesce(F.col("b_accepted"), F.lit(False)) & no("b_smoothed") & finite(p).isNotNull() & (s.isNull() | finite(s).isNotNull())
    stats = near.groupBy("line").agg(
        F.count("*").alias("n_windows"), F.min(good).alias("all_good"), F.min(finite(p)).alias("p_min"), F.min(finite(s)).alias("s_min"),
        F.greatest(F.stddev_pop(p), F.coalesce(F.stddev_pop(s), F.lit(0.0))).alias("variation"), F.min(F.when(finite(cp).isNotNull() & finite(cs).isNotNull(), F.least(cp, cs))).alias("row_margin"),
    )
    covers = near.select("line", F.col(f"b_{START}").alias(START), F.col(f"b_{END}").alias(END))
    covered = iv.covered_length(lines.select("line", START, END), covers, ["line"]).select("line", "covered_ms")
    duration = (F.col(END) - F.col(START)) / 1000
    rows = lines.join(kept.select(*own, "margin", "primary_score", "secondary_score"), own).join(stats, "line", "left").join(covered, "line")
    rows = rows.where(F.coalesce("all_good", F.lit(True))).withColumns({
        "coverage": F.when(F.col("n_windows") > 0, F.least(F.lit(1.0), F.col("covered_ms") / 1000 / duration)),
        "minimum": F.coalesce("p_min", finite(F.col("primary_score")), F.lit(0.5)),
        "variation": F.coalesce("variation", F.lit(0.0)),
        "exclusion": F.coalesce("row_margin", "margin"),
    })
    rows = rows.withColumns({"second_minimum": F.coalesce("s_min", finite(F.col("secondary_score")), "minimum"), "windows_verified": F.coalesce(F.col("coverage") >= 0.98, F.lit(False))})
    rows = rows.where("variation <= 0.12 and coalesce(exclusion, 0) >= 0")
    by_margin = F.when(F.col("exclusion").isNotNull(), _clip(0.5 + 2 * F.col("exclusion"))).otherwise(0.35)
    stable = _clip(F.least("minimum", "second_minimum") - 2 * F.col("variation"))
    cue = F.when(F.col("single_cue"), 0.15).when(F.col("text") != "", 0.06).otherwise(0.0)
    verified = F.when(F.col("windows_verified"), 0.15).when(F.col("margin").isNotNull(), 0.03).otherwise(0.0)
    quality = 0.15 * F.when(duration.between(2, 5.5), 1.0).otherwise(0.65) + 0.35 * stable + 0.2 * by_margin + cue + verified
    return rows.select(*own, START, END, "text", "single_cue", "windows_verified", "coverage", "minimum", "second_minimum", "variation", "exclusion", F.round(quality, 5).alias("quality"))


def diverse_seeds(seeds: DataFrame, picks: int) -> DataFrame:
    """The seeds with place (from 1) and selection_score, up to `picks` a cluster: in each round the one of largest quality times
    (1 + distance to the nearest pick); seeds of a picked turn, or that overlap a pick, leave.

    Distance is the mean of gap / (gap + typical gap) between centres, and of the angles in both channels as shares of
    a half turn, where the vectors are known.  A round is one aggregate and one join; what goes back is a row a cluster.
    seeds: source_id, cluster, turn, start_ms, end_ms, quality, primary, secondary."""
    own = ["source_id", "cluster"]
    centre = (F.col(START) + F.col(END)) / 2
    spots = seeds.select(*own, centre.alias("c")).distinct().withColumn("gap", F.lead("c").over(Window.partitionBy(*own).orderBy("c")) - F.col("c"))
    scales = spots.groupBy(*own).agg(F.coalesce(F.percentile("gap", F.lit(0.5)), F.lit(1000.0)).alias("typical"))
    left = materialised(seeds.join(scales, own).withColumn("near", F.lit(None).cast("double")), "seeds")
    score = F.col("quality") * (1 + F.coalesce("near", F.lit(0.0)))
    out = None
    for place in range(1, picks + 1):
        order = F.struct(score.alias("score"), F.col("quality").alias("q"), (-F.col(START)).alias("s"), (-F.col("turn")).alias("t"), (-F.col(END)).alias("e"))
        best = left.groupBy(*own).agg(F.max(order).alias("o"), F.max_by(F.struct("turn", START, END, "primary", "secondary"), order).alias("b"))
        best = materialised(best.select(*own, F.col("o.score").alias("selection_score"), *[F.col(f"b.{c}").alias(f"p_{c}") for c in ("turn", START, END, "primary", "secondary")]), "picks")
        if best.isEmpty():
            break
        row = best.select(*own, F.col("p_turn").alias("turn"), F.col(f"p_{START}").alias(START), F.col(f"p_{END}").alias(END), F.round("selection_score", 5).alias("selection_score"), F.lit(place).alias("place"))
        out = row if out is None else out.unionByName(row)
        joined = left.join(best, own).where(f"turn <> p_turn and least({END}, p_{END}) <= greatest({START}, p_{START})")
        gap = F.abs(centre - (F.col(f"p_{START}") + F.col(f"p_{END}")) / 2)
        temporal = gap / (gap + F.col("typical"))
        known = lambda c: F.when(vf.cosine(c, f"p_{c}").isNotNull(), vf.angle(c, f"p_{c}"))
        angles = F.array_compact(F.array(known("primary"), known("secondary")))
        acoustic = F.when(F.size(angles) > 0, vf.total(angles) / F.greatest(F.size(angles), F.lit(1)))
        distance = F.when(acoustic.isNull(), temporal).otherwise((temporal + acoustic) / 2)
        left = materialised(joined.withColumn("near", F.least(F.coalesce("near", distance), distance)).select(*left.columns), "seeds")
    if out is None:
        return seeds.select(*own, "turn", START, END).limit(0).withColumns({"selection_score": F.lit(0.0), "place": F.lit(0)})
    return out
