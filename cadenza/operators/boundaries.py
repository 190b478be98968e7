"""Where to cut and what to join: cut points of two channels, quiet gaps, changes at several scales, and
candidates that know whether their edges are complete.

Frames, cuts and silences meet intervals in range joins; no source's frames come together in a row.
Times are integer milliseconds, intervals half-open.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators import intervals as iv
from cadenza.operators.greedy import suppress
from cadenza.operators.storage import materialised

START, END = iv.START, iv.END


# Cut points of two channels ------------------------------------------------------------------------------


def strongest_cuts(cuts: DataFrame, apart: int) -> DataFrame:
    """source_id, at_ms, confidence: of cuts that follow each other within `apart` the most confident, the
    first of equals."""
    points = cuts.select("source_id", F.col("at_ms").alias(START), F.col("at_ms").alias(END), "confidence")
    chained = iv.islands(points, ["source_id"], apart)
    best = F.max(F.struct("confidence", (-F.col(START)).alias("t")))
    return chained.groupBy("source_id", "island").agg(best.alias("b")).select("source_id", (-F.col("b.t")).alias("at_ms"), F.col("b.confidence").alias("confidence"))


def paired_cuts(islands: DataFrame, first: DataFrame, second: DataFrame, tolerance: int, side: int, most: int = 4, unmatched: bool = False) -> DataFrame:
    """Cuts inside islands that both channels see within the tolerance, one to one, by largest summed
    confidence, then least distance, then earliest; up to `most` an island, by the first channel's
    confidence, the second's, and distance.

    islands: source_id, segment_id, start_ms, end_ms.  first, second: source_id, at_ms, confidence.  A pair is
    chosen unless a better one has an end of it: greedy suppression over pairs that share an end, of
    which there are few, since cuts of a channel are apart.  With `unmatched` cuts of the first
    channel alone fill the rest.  Result: segment_id, at_ms (double), first_ms, second_ms, distance,
    first_confidence, second_confidence."""
    a, b = (strongest_cuts(c, tolerance // 2) for c in (first, second))
    # Cuts have to leave `side` on both sides of them.
    room = islands.select("source_id", "segment_id", (F.col(START) + side).alias(START), (F.col(END) - side + 1).alias(END))
    inside = lambda c, p: iv.overlap_join(room, c.select("source_id", F.col("at_ms").alias(START), (F.col("at_ms") + 1).alias(END), "confidence")).select("source_id", "segment_id", F.col(f"b_{START}").alias(f"{p}_ms"), F.col("b_confidence").alias(f"{p}_confidence"))
    x, y = materialised(inside(a, "first"), "cuts"), inside(b, "second")
    left = x.select("segment_id", (F.col("first_ms") - tolerance).alias(START), (F.col("first_ms") + tolerance + 1).alias(END), "first_ms", "first_confidence")
    right = y.select("segment_id", F.col("second_ms").alias(START), (F.col("second_ms") + 1).alias(END), "second_ms", "second_confidence")
    met = iv.overlap_join(left, right, ["segment_id"]).withColumnsRenamed({"b_second_ms": "second_ms", "b_second_confidence": "second_confidence"})
    distance = F.abs(F.col("first_ms") - F.col("second_ms"))
    pairs = met.select("segment_id", "first_ms", "second_ms", "first_confidence", "second_confidence", distance.alias("distance"))
    pairs = materialised(pairs.withColumn("id", F.concat_ws(":", "segment_id", "first_ms", "second_ms")), "pairs")
    rank = F.struct((-(F.col("first_confidence") + F.col("second_confidence"))).alias("c"), "distance", "first_ms", "second_ms")
    ends = [pairs.select("segment_id", F.col(c).alias("end"), "id", rank.alias("rank")) for c in ("first_ms", "second_ms")]
    rivals = [e.join(e.withColumnsRenamed({"id": "id2", "rank": "rank2"}), ["segment_id", "end"]).where("rank < rank2").select(F.col("id").alias("better"), F.col("id2").alias("worse")) for e in ends]
    kept = pairs.join(suppress(rivals[0].unionByName(rivals[1])), "id", "left_anti")
    found = kept.select("segment_id", ((F.col("first_ms") + F.col("second_ms")) / 2).alias("at_ms"), "first_ms", "second_ms", "distance", "first_confidence", "second_confidence")
    if unmatched:
        alone = x.join(kept.select("segment_id", "first_ms"), ["segment_id", "first_ms"], "left_anti")
        none = lambda kind: F.lit(None).cast(kind)
        found = found.unionByName(alone.select("segment_id", F.col("first_ms").cast("double").alias("at_ms"), "first_ms", none("long").alias("second_ms"), none("long").alias("distance"), "first_confidence", none("double").alias("second_confidence")))
    order = Window.partitionBy("segment_id").orderBy(F.col("second_ms").isNull(), F.desc("first_confidence"), F.desc(F.coalesce("second_confidence", F.lit(0.0))), F.coalesce("distance", F.lit(0)), "first_ms")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")


# Quiet gaps ----------------------------------------------------------------------------------------------


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def snapped_to_quiet(bounds: DataFrame, frames: DataFrame, radius: int = 500, frame: int = 20, hop: int = 10, least: int = 60, keep: int = 200) -> DataFrame:
    """Boundaries moved to the end of an adjacent pause: segment_id, refined_ms, floor_db, n_runs.

    bounds: source_id, segment_id, start_ms, end_ms (the candidate), at_ms, side (left: the pause that
    begins at the boundary or after it; else the last one that has ended by then).  frames: source_id,
    at_ms, level_db, of `frame` length every `hop`.  Quiet is 18 dB under the upper quartile of the frames
    within the radius, held within -55 and -38; a pause is a run of `least`.  What stays of the candidate
    on both sides is at least `keep`.  Without frames the boundary stays as it is, unclamped."""
    search = bounds.select("source_id", "segment_id", "at_ms", F.greatest(F.col(START), F.col("at_ms") - radius).alias(START), F.least(F.col(END), F.col("at_ms") + radius).alias(END))
    spans = frames.select("source_id", F.col("at_ms").alias(START), (F.col("at_ms") + frame).alias(END), "level_db")
    met = iv.overlap_join(search, spans, least=frame - 1).select("segment_id", F.col(f"b_{START}").alias("t"), F.col("b_level_db").alias("level"))
    own = Window.partitionBy("segment_id")  # the frames within the radius
    quiet = met.withColumn("floor_db", clamp(F.percentile("level", F.lit(0.75)).over(own) - 18.0, -55.0, -38.0)).where(F.col("level") <= F.col("floor_db"))
    run = F.col("t") - hop * F.row_number().over(own.orderBy("t"))
    runs = quiet.withColumn("run", run).groupBy("segment_id", "run").agg(F.min("t").alias("from"), (F.max("t") + frame).alias("to")).where(F.col("to") - F.col("from") >= least)
    floors = met.groupBy("segment_id").agg(clamp(F.percentile("level", F.lit(0.75)) - 18.0, -55.0, -38.0).alias("floor_db"))
    asked = bounds.select("segment_id", F.col(START).alias("s"), F.col(END).alias("e"), "at_ms", "side")
    near = runs.join(asked, "segment_id")
    after = F.min(F.when((F.col("side") == "left") & (F.col("from") >= F.col("at_ms") - frame), F.struct("from", "to")))
    before = F.max(F.when((F.col("side") != "left") & (F.col("to") <= F.col("at_ms") + frame), F.struct("from", "to")))
    picked = near.groupBy("segment_id").agg(F.coalesce(after, before)["to"].alias("pause"), F.count("*").cast("long").alias("n_runs"))
    out = asked.join(floors, "segment_id", "left").join(picked, "segment_id", "left")
    refined = F.least(F.col("e") - keep, F.greatest(F.col("s") + keep, F.coalesce("pause", "at_ms")))
    return out.select("segment_id", F.when(F.col("floor_db").isNull(), F.col("at_ms")).otherwise(refined).alias("refined_ms"), "floor_db", F.coalesce("n_runs", F.lit(0)).alias("n_runs"))


def bridgeable_gaps(pairs: DataFrame, frames: DataFrame, regions: DataFrame, islands: DataFrame, barriers: DataFrame, flank: int = 1800, lowest: float = 10 ** (-65 / 20), highest: float = 10 ** (-32 / 20), below: float = 10 ** (-12 / 20)) -> DataFrame:
    """pair_id, quiet (the level a gap may have anyhow), loud (frames above it), verified.

    A gap between two parts may be bridged where nothing bars it, and each frame in it is quiet or lies
    in one confirmed island, the latter only where one region covers both parts.  Quiet is 12 dB below
    the lesser of the flanks' ninetieth percentiles, within bounds; a flank without frames verifies
    nothing, nor does an empty gap.

    pairs: source_id, pair_id, left_start, left_end, right_start, right_end.  frames: source_id, start_ms,
    end_ms, level.  regions, islands, barriers: source_id, start_ms, end_ms."""
    gap = pairs.where("right_start > left_end").withColumns({START: F.col("left_end"), END: F.col("right_start")})
    sides = [("l", F.greatest("left_start", F.col("left_end") - flank), F.col("left_end")), ("r", F.col("right_start"), F.least("right_end", F.col("right_start") + flank))]
    flanks = [gap.select("source_id", "pair_id", F.lit(k).alias("k"), a.alias(START), b.alias(END)) for k, a, b in sides]
    levels = frames.select("source_id", START, END, "level")
    heard = iv.overlap_join(flanks[0].unionByName(flanks[1]), levels).groupBy("pair_id", "k").agg(F.percentile("b_level", F.lit(0.9)).alias("q"))
    speech = heard.groupBy("pair_id").agg(F.min("q").alias("speech"), F.count("*").alias("n")).where("n = 2")
    quiet = gap.join(speech, "pair_id").select("source_id", "pair_id", START, END, clamp(F.col("speech") * below, lowest, highest).alias("quiet"))
    quiet = materialised(quiet, "gaps")
    met = iv.overlap_join(quiet, levels).where("b_level > quiet")
    loud = met.select("source_id", "pair_id", F.greatest(START, f"b_{START}").alias(START), F.least(END, f"b_{END}").alias(END))
    loud = materialised(loud, "loud")
    inside = iv.overlap_join(loud, islands.select("source_id", START, END)).where(f"b_{START} <= {START} and b_{END} >= {END}").select("pair_id", START, END).distinct()
    alien = loud.join(inside, ["pair_id", START, END], "left_anti").select("pair_id").distinct().withColumn("alien", F.lit(True))
    whole = gap.select("source_id", "pair_id", F.col("left_start").alias(START), F.col("right_end").alias(END))
    covered = iv.overlap_join(whole, regions.select("source_id", START, END)).where(f"b_{START} <= {START} and b_{END} >= {END}").select("pair_id").distinct().withColumn("covered", F.lit(True))
    barred = iv.overlap_join(gap.select("source_id", "pair_id", START, END), barriers.select("source_id", START, END), how="left_semi").select("pair_id").distinct().withColumn("barred", F.lit(True))
    out = pairs.select("pair_id").join(quiet.select("pair_id", "quiet"), "pair_id", "left").join(loud.groupBy("pair_id").agg(F.count("*").alias("loud")), "pair_id", "left")
    for more in (alien, covered, barred):
        out = out.join(more, "pair_id", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    fine = F.col("loud").isNull() | (no("covered") & ~no("alien"))
    return out.select("pair_id", "quiet", F.coalesce("loud", F.lit(0)).alias("loud"), (F.col("quiet").isNotNull() & ~no("barred") & fine).alias("verified"))


# Changes at several scales -------------------------------------------------------------------------------

# Fixed values of the rule: largest similarities across a change, and how far it falls under both sides' own.
CANDIDATE, PRIMARY, SECONDARY, DROP = 0.78, 0.68, 0.52, 0.06
#: Places of a span that one task looks at, besides the contexts on both sides.
STRETCH = 4096


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = np.sqrt((a * a).sum(1) * (b * b).sum(1))
    return (a * b).sum(1) / np.where(n > 0, n, 1)


def scale_changes(places: DataFrame, contexts: Sequence[int], hop: int = 1, candidate: float = CANDIDATE, primary: float = PRIMARY, secondary: float = SECONDARY, drop: float = DROP, stretch: int = STRETCH) -> DataFrame:
    """span_id, place, context, p, s, confidence: places where the means of `context` rows before and after
    differ in both channels, and more than the halves on each side do.

    places: span_id, place (0 to n - 1 without gaps), primary, secondary.  Every `hop`-th place from the
    first possible one is tried, and the last.  One exchange serves all scales: a stretch of places goes
    to its task with the longest context on both sides, and means are differences of running sums."""
    reach = max(contexts)
    sizes = places.groupBy("span_id").agg(F.count("*").alias("n"))
    own = F.floor(F.col("place") / stretch)
    near = F.sequence(F.floor(F.greatest(F.col("place") - reach, F.lit(0)) / stretch), F.floor((F.col("place") + reach) / stretch))
    dealt = places.join(sizes, "span_id").select("span_id", "place", "n", "primary", "secondary", F.explode(F.when(own.isNotNull(), near)).alias("part"))
    names = ["span_id", "place", "context", "p", "s", "confidence"]

    def look(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        part, n, first = int(rows.part.iloc[0]), int(rows.n.iloc[0]), int(rows.place.iloc[0])
        sums = [np.concatenate((np.zeros((1, v.shape[1])), np.cumsum(v, axis=0))) for v in (np.array(rows[c].tolist(), float) for c in ("primary", "secondary"))]
        out = []
        for c in sorted(set(contexts)):
            at = np.arange(part * stretch, min((part + 1) * stretch, n))
            at = at[(at >= c) & (at <= n - c)]
            at = at[((at - c) % hop == 0) | (at == n - c)]
            if not len(at):
                continue
            i, q = at - first, max(1, c // 2)
            cross, fall = [], []
            for total in sums:
                mean = lambda a, b, t=total: t[i + b] - t[i + a]  # noqa: E731  sums do for means, as only angles count
                x = _cosine(mean(-c, 0), mean(0, c))
                cross.append(x)
                fall.append(np.minimum(_cosine(mean(-c, -q), mean(-q, 0)), _cosine(mean(0, q), mean(q, c))) - x)
            both = ((fall[0] >= drop) & (fall[1] >= drop / 4)) | ((fall[1] >= drop) & (fall[0] >= drop / 4))
            hit = (cross[0] <= candidate) & (cross[0] <= primary) & (cross[1] <= secondary) & both
            strength = (np.clip((0.72 - cross[0]) / 0.42, 0, 1) + np.clip((0.60 - cross[1]) / 0.38, 0, 1)) / 2
            out.append(pd.DataFrame(dict(zip(names, (rows.span_id.iloc[0], at[hit], c, cross[0][hit], cross[1][hit], np.round(strength[hit], 5)), strict=True))))
        return pd.concat(out) if out else pd.DataFrame(columns=names)

    kind = dict(places.dtypes)["span_id"]
    return dealt.groupBy("span_id", "part").applyInPandas(look, f"span_id {kind}, place long, context int, p double, s double, confidence double")


def _representatives(found: DataFrame, keys: list[str], apart: int) -> DataFrame:
    """Of changes that follow each other within `apart` the one of least similarity; with the number of
    contexts and the largest confidence."""
    points = found.withColumns({START: F.col("place"), END: F.col("place")})
    chained = iv.islands(points, keys, apart)
    least = F.min(F.struct((F.col("p") + F.col("s")).alias("v"), (-F.col("confidence")).alias("c"), "place", "p", "s"))
    groups = chained.groupBy(*keys, "island").agg(least.alias("b"), F.count_distinct("context").alias("contexts"), F.max("confidence").alias("most"))
    return groups.select(*keys, "b.place", "b.p", "b.s", (-F.col("b.c")).alias("confidence"), "contexts", "most")


def multiscale_changes(places: DataFrame, contexts: Sequence[int], cluster: int, votes: int = 2, apart: int = 2, hop: int = 1, **limits) -> DataFrame:
    """span_id, place, p, s, confidence, votes: changes that several contexts see.  The middle context screens:
    spans in which it sees none have none.  Each context's changes are first thinned to one within
    `apart`, then those within `cluster` of each other vote."""
    ordered = sorted(set(contexts))
    found = materialised(scale_changes(places, ordered, hop, **limits), "changes")
    thin = _representatives(found.withColumn("scale", F.col("context")), ["span_id", "scale"], apart)
    thin = thin.select("span_id", F.col("scale").alias("context"), "place", "p", "s", "confidence")
    suspect = thin.where(F.col("context") == ordered[len(ordered) // 2]).select("span_id").distinct()
    voted = _representatives(thin.join(suspect, "span_id", "left_semi"), ["span_id"], cluster)
    return voted.where(F.col("contexts") >= votes).select("span_id", "place", "p", "s", F.col("most").alias("confidence"), F.col("contexts").cast("int").alias("votes"))


# Candidates with complete or open edges ------------------------------------------------------------------


def silence_proposals(islands: DataFrame, blocked: DataFrame, lower: int, upper: int, longest: int) -> DataFrame:
    """source_id, first_id, last_id, n_islands, start_ms, end_ms, start_complete, end_complete: every run of islands that
    no gap over `upper` splits, within `longest` unless it is one island, and clear of blocked intervals.

    An edge is complete if the island's own is, and the gap behind it isn't under `lower` (then the
    utterance goes on).  islands: source_id, segment_id, start_ms, end_ms, start_complete, end_complete, not
    overlapping within a source."""
    grouped = iv.islands(islands, ["source_id"], upper, out="stretch")
    w = Window.partitionBy("source_id", "stretch").orderBy(START, END, "segment_id")
    clear = lambda gap: F.coalesce(gap >= lower, F.lit(True))
    rows = grouped.withColumns({
        "place": F.row_number().over(w),
        "from_ok": F.col("start_complete") & clear(F.col(START) - F.lag(END).over(w)),
        "to_ok": F.col("end_complete") & clear(F.lead(START).over(w) - F.col(END)),
    })
    rows = materialised(rows, "islands")
    # How far a run from each island may go: to the next blocked interval, or `longest`, or its own end.
    window = rows.withColumns({"own_end": F.col(END), END: F.greatest(F.col(END), F.col(START) + longest)})
    until = iv.per_row(window, blocked.select("source_id", START, END), ["source_id"], lambda hit: [F.min(F.when(hit, F.col(f"b_{START}"))).alias("barred")])
    firsts = until.withColumn("limit", F.coalesce("barred", END))
    alone = firsts.where("own_end <= coalesce(barred, own_end)").select("source_id", "stretch", "place", F.col("segment_id").alias("first_id"), F.col("segment_id").alias("last_id"), F.lit(1).alias("n_islands"), START, F.col("own_end").alias(END), F.col("from_ok").alias("start_complete"), F.col("to_ok").alias("end_complete"))
    ahead = firsts.where(F.col("limit") > F.col(START)).select("source_id", "stretch", "place", "segment_id", "from_ok", START, F.col("limit").alias(END))
    lasts = rows.select("source_id", "stretch", "place", "segment_id", "to_ok", START, END)
    met = iv.overlap_join(ahead, lasts, ["source_id", "stretch"]).where(f"b_place > place and b_{END} <= {END} and b_{END} - {START} <= {longest}")
    runs = met.select("source_id", "stretch", "place", F.col("segment_id").alias("first_id"), F.col("b_segment_id").alias("last_id"), (F.col("b_place") - F.col("place") + 1).alias("n_islands"), START, F.col(f"b_{END}").alias(END), F.col("from_ok").alias("start_complete"), F.col("b_to_ok").alias("end_complete"))
    return alone.unionByName(runs).drop("stretch", "place")


def change_parts(parents: DataFrame, speech: DataFrame, changes: DataFrame, gaps: DataFrame, tolerance: int) -> DataFrame:
    """segment_id, start_ms, end_ms, start_complete, end_complete: children of each parent between pauses at a change.

    A pause cuts if it lies strictly inside the parent, is verified with both edges complete, and a change
    that meets the parent is within the tolerance of it.  Children without speech fall out; a parent
    without such a pause has none.  A child's edge at the parent's end is the parent's, at a pause it
    is complete.  parents: source_id, segment_id, start_ms, end_ms, start_complete, end_complete.  gaps also:
    verified, left_complete, right_complete."""
    sure = gaps.where("verified and left_complete and right_complete").select("source_id", START, END)
    inside = iv.overlap_join(parents, sure).where(f"b_{START} > {START} and b_{END} < {END}")
    inside = inside.select("source_id", "segment_id", F.col(START).alias("p_start"), F.col(END).alias("p_end"), F.col(f"b_{START}").alias("g_start"), F.col(f"b_{END}").alias("g_end"))
    wide = inside.withColumns({START: F.col("g_start") - tolerance - 1, END: F.col("g_end") + tolerance + 1})
    near = iv.overlap_join(wide, changes.select("source_id", START, END)).where(f"b_{START} < p_end and b_{END} > p_start")
    cuts = near.select("segment_id", F.col("g_start").alias(START), F.col("g_end").alias(END)).distinct()
    cuts = materialised(cuts, "pauses")
    split = parents.join(cuts.select("segment_id").distinct(), "segment_id", "left_semi")
    parts = iv.subtract(split.select("segment_id", START, END, "start_complete", "end_complete"), cuts, ["segment_id"])
    parts = parts.select("segment_id", START, END, (~F.col("edge_start") | F.col("start_complete")).alias("start_complete"), (~F.col("edge_end") | F.col("end_complete")).alias("end_complete"))
    heard = iv.overlap_join(parents.select("source_id", "segment_id", START, END), speech.select("source_id", START, END))
    heard = heard.select("segment_id", F.greatest(START, f"b_{START}").alias(START), F.least(END, f"b_{END}").alias(END))
    return iv.overlap_join(parts, heard, ["segment_id"], "left_semi")
