"""Captions on the clock of the speech that they belong to.

A source's offset is the shift of a grid at which most cues have a start and an end of speech near both of
their edges.  It holds if it finds more of them than shifts far off do by chance, and if they don't lie at one
place.  Cues then move by the median of the anchors around them, not by the source's offset; where
these differ, or where there are too few, a cue has no place.

Cues and speech meet once, in a range join of cues with the edges near any of the shifts; the shifts are tried within
the row, on the few edges it met, so the grid doesn't multiply what is shuffled.  Medians are of whole milliseconds within the
grid's bounds, so their buffers are bounded, however many cues a source has.

All lengths are multiples of `second`, in the unit of the tables.  cues: source_id, segment_id (unique), start_ms, end_ms;
speech: source_id, start_ms, end_ms.  Cues with a null key or bound, or of no length, have no place; repeated speech is
speech once, but in `retry_windows`, where covers add up; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators import intervals as iv
from cadenza.operators.folds import merge_with_cap
from cadenza.operators.storage import materialised

# Fixed values, in seconds: the grid of shifts, the shifts that only chance supports, and limits.
GRID_STEPS, GRID_STEP = 30, 0.05
CONTROLS = (-20, -15, -10, -5, 5, 10, 15, 20)
SHORTEST, LONGEST = 0.6, 12
EDGE, EDGES_APART, FROM_MEDIAN = 0.25, 0.30, 0.20
LEAST_ANCHORS, LEAST_SPREAD = 6, 10
LOCAL_REACH, LEAST_LOCAL, FROM_OFFSET = 45, 2, 0.25
TOUCH = 0.01
RETRY_COVER, RETRY_SHARE, RETRY_PAD, RETRY_LONGEST = 0.35, 0.5, 0.6, 30

CUE = ["source_id", "segment_id", "start_ms", "end_ms"]


def _ms(seconds: float, second: int) -> int:
    return round(seconds * second)


def _placed(cues: DataFrame) -> DataFrame:
    return cues.select(*CUE).where("source_id is not null and start_ms < end_ms")


def _fit_for_anchors(cues: DataFrame, second: int) -> DataFrame:
    return _placed(cues).where((F.col("end_ms") - F.col("start_ms")).between(_ms(SHORTEST, second), _ms(LONGEST, second)))


def anchor_trials(cues: DataFrame, speech: DataFrame, second: int = 1000) -> DataFrame:
    """source_id, segment_id, middle2 (twice the cue's middle), shift, offset2 (twice the anchor's offset): every
    cue at every shift, controls too, at which both its edges have speech edges near."""
    near = _ms(EDGE, second)
    grid = [_ms(k * GRID_STEP, second) for k in range(-GRID_STEPS, GRID_STEPS + 1)]
    controls = [_ms(c, second) for c in CONTROLS]
    reach = max(controls) + near
    spoken = speech.where("source_id is not null and start_ms < end_ms")
    edge = lambda c: spoken.select("source_id", F.lit(c).alias("edge"), F.col(c).alias("start_ms"), (F.col(c) + 1).alias("end_ms"))
    edges = edge("start_ms").unionByName(edge("end_ms")).distinct()
    around = _fit_for_anchors(cues, second).select(
        "source_id",
        "segment_id",
        F.col("start_ms").alias("first_ms"),
        F.col("end_ms").alias("last_ms"),
        (F.col("start_ms") - reach).alias("start_ms"),
        (F.col("end_ms") + reach + 1).alias("end_ms"),
    )

    def offsets(c: str, own: str):
        off = F.col("b_start_ms") - F.col(own)
        useful = off.between(grid[0] - near, grid[-1] + near)
        for x in controls:
            useful = useful | off.between(x - near, x + near)
        return lambda hit: F.collect_set(F.when(hit & (F.col("b_edge") == c) & useful, off))

    starts, ends = offsets("start_ms", "first_ms"), offsets("end_ms", "last_ms")
    met = iv.per_row(around, edges, ["source_id"], lambda hit: [starts(hit).alias("starts"), ends(hit).alias("ends")], bucket_ms=2 * reach)

    def nearest(offs: str, shift: Column) -> Column:
        """The offset next to the shift, the lower of two; null beyond the limit."""
        some = F.filter(offs, lambda o: F.abs(o - shift) <= near)
        return F.array_min(F.transform(some, lambda o: F.struct(F.abs(o - shift).alias("d"), o.alias("o"))))["o"]

    shifts = F.array(*[F.lit(s).cast("long") for s in sorted({*grid, *controls})])
    tried = F.transform(shifts, lambda s: F.struct(s.alias("shift"), nearest("starts", s).alias("a"), nearest("ends", s).alias("b")))
    middle = (F.col("first_ms") + F.col("last_ms")).alias("middle2")
    some = met.where("size(starts) > 0 and size(ends) > 0").select("source_id", "segment_id", middle, F.explode(tried).alias("t"))
    both = some.select("source_id", "segment_id", "middle2", "t.*").where(F.abs(F.col("a") - F.col("b")) <= _ms(EDGES_APART, second))
    return both.select("source_id", "segment_id", "middle2", "shift", (F.col("a") + F.col("b")).alias("offset2"))


def calibrate(cues: DataFrame, speech: DataFrame, second: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(offsets, anchors).  offsets: a row a source of the cues with status (aligned, timeline_mismatch or
    insufficient_anchors), aligned, offset_ms (0 unless aligned), n_anchors, anchor_share of the cues that could be
    anchors, and chance, the median number of anchors of the controls; the last three are null without a trial.
    anchors: source_id, segment_id, middle2, offset2 of aligned sources."""
    trials = materialised(anchor_trials(cues, speech, second), "trials")
    control = F.col("shift").isin([_ms(c, second) for c in CONTROLS])
    counts = trials.groupBy("source_id", "shift").agg(F.count("*").alias("n"))
    by_chance = F.collect_list(F.when(control, F.col("n")))
    filled = F.sort_array(F.concat(by_chance, F.array_repeat(F.lit(0).cast("long"), F.lit(len(CONTROLS)) - F.size(by_chance))))
    half = len(CONTROLS) // 2
    best = counts.groupBy("source_id").agg(
        F.max_by("shift", F.when(~control, F.struct("n", -F.abs("shift"), -F.col("shift")))).alias("shift"),
        ((F.get(filled, F.lit(half - 1)) + F.get(filled, F.lit(half))) / 2).alias("chance"),
    )
    at_best = trials.join(best.select("source_id", "shift"), ["source_id", "shift"])
    medians = at_best.groupBy("source_id").agg(F.percentile("offset2", 0.5).alias("median2"))
    close = at_best.join(medians, "source_id").where(F.abs(F.col("offset2") - F.col("median2")) <= 2 * _ms(FROM_MEDIAN, second))
    found = close.groupBy("source_id").agg(
        F.count("*").alias("n_anchors"), F.first("median2").alias("median2"), (F.max("middle2") - F.min("middle2")).alias("spread2")
    )
    fit = _fit_for_anchors(cues, second).groupBy("source_id").agg(F.count("*").alias("n_fit"))
    heard = speech.where("source_id is not null and start_ms < end_ms").select("source_id").distinct().withColumn("heard", F.lit(True))
    every = _placed(cues).select("source_id").distinct()
    joined = every.join(fit, "source_id", "left").join(heard, "source_id", "left").join(best, "source_id", "left").join(found, "source_id", "left")
    enough = F.coalesce(F.col("heard") & (F.col("n_fit") >= LEAST_ANCHORS), F.lit(False))
    n, chance = F.coalesce("n_anchors", F.lit(0)), F.coalesce("chance", F.lit(0.0))
    holds = enough & (n >= F.greatest(F.lit(LEAST_ANCHORS), 2 * chance + 3)) & (F.coalesce("spread2", F.lit(0)) >= 2 * _ms(LEAST_SPREAD, second))
    offsets = joined.withColumn("aligned", holds).select(
        "source_id",
        F.when(~enough, "insufficient_anchors").when(F.col("aligned"), "aligned").otherwise("timeline_mismatch").alias("status"),
        "aligned",
        F.when(F.col("aligned"), F.col("median2") / 2).otherwise(0.0).alias("offset_ms"),
        F.when(enough, n).alias("n_anchors"),
        F.when(enough, n / F.col("n_fit")).alias("anchor_share"),
        F.when(enough, chance).alias("chance"),
    )
    offsets = materialised(offsets, "offsets")
    anchors = close.join(offsets.where("aligned").select("source_id"), "source_id", "left_semi")
    return offsets, anchors.select("source_id", "segment_id", "middle2", "offset2")


def aligned_cues(cues: DataFrame, offsets: DataFrame, anchors: DataFrame, second: int = 1000) -> DataFrame:
    """The cues that have a place, with start_ms and end_ms there (whole ms, not below 0) and local_ms: by the median
    of at least two anchors around them, unless that is away from the source's offset."""
    reach = 2 * _ms(LOCAL_REACH, second)
    middle = F.col("start_ms") + F.col("end_ms")
    around = _placed(cues).join(offsets.where("aligned").select("source_id", "offset_ms"), "source_id")
    around = around.withColumns({"first_ms": F.col("start_ms"), "last_ms": F.col("end_ms"), "start_ms": middle - reach, "end_ms": middle + reach + 1})
    points = anchors.select("source_id", F.col("middle2").alias("start_ms"), (F.col("middle2") + 1).alias("end_ms"), "offset2")
    near = lambda hit: F.when(hit, F.col("b_offset2"))
    found = iv.per_row(around, points, ["source_id"], lambda hit: [F.count(near(hit)).alias("n"), (F.percentile(near(hit), 0.5) / 2).alias("local_ms")], bucket_ms=2 * reach)
    held = found.where((F.col("n") >= LEAST_LOCAL) & (F.abs(F.col("local_ms") - F.col("offset_ms")) <= _ms(FROM_OFFSET, second)))
    return _moved(held, F.col("local_ms")).select(*CUE, "local_ms")


def _moved(df: DataFrame, by: Column) -> DataFrame:
    """first_ms and last_ms moved to start_ms and end_ms."""
    place = lambda c: F.greatest(F.lit(0).cast("long"), F.floor(F.col(c) + by + 0.5))
    return df.withColumns({"start_ms": place("first_ms"), "end_ms": place("last_ms")})


def placed_cues(cues: DataFrame, offsets: DataFrame, aligned: DataFrame) -> DataFrame:
    """All cues: at their own place, else moved by their source's offset (0 where it isn't aligned)."""
    own = aligned.select("source_id", "segment_id", F.col("start_ms").alias("own_start"), F.col("end_ms").alias("own_end"))
    c = _placed(cues).withColumnsRenamed({"start_ms": "first_ms", "end_ms": "last_ms"}).join(offsets.select("source_id", "offset_ms"), "source_id", "left")
    moved = _moved(c, F.coalesce("offset_ms", F.lit(0.0))).join(own, ["source_id", "segment_id"], "left")
    return moved.select("source_id", "segment_id", F.coalesce("own_start", "start_ms").alias("start_ms"), F.coalesce("own_end", "end_ms").alias("end_ms"))


def crossing_pairs(pairs: DataFrame, placed: DataFrame, second: int = 1000) -> DataFrame:
    """pairs: source_id, pair_id, left_start, left_end, right_start, right_end.  Adds crosses: whether the two parts
    don't both lie in the same one cue, or in none, or a cue lies between them.  A cue belongs to a part if it shares more
    than a hundredth of a second with it.  Counts, not sets of cues, go through the exchange."""
    least = _ms(TOUCH, second)
    whole = pairs.withColumns({"start_ms": F.least("left_start", "right_start"), "end_ms": F.greatest("left_end", "right_end")})
    in_part = lambda p: F.least(f"{p}_end", "b_end_ms") - F.greatest(f"{p}_start", "b_start_ms") > least
    left, right = in_part("left"), in_part("right")
    cues = lambda hit, what: F.coalesce(F.count_if(hit & what), F.lit(0))
    crosses = lambda hit: (cues(hit, left != right) > 0) | (cues(hit, left | right) > 1) | (cues(hit, ~left) > 0)
    found = iv.per_row(whole, placed, ["source_id"], lambda hit: [crosses(hit).alias("crosses")], least, bucket_ms=60 * second)
    return found.drop("start_ms", "end_ms")


def retry_windows(aligned: DataFrame, speech: DataFrame, ends: DataFrame, second: int = 1000) -> DataFrame:
    """source_id, start_ms, end_ms, n (cues): padded windows around cues that speech covers too little of; windows that
    meet are one up to half a minute.  ends: source_id, clip_ms, the length of the source.  Covers add up."""
    short = aligned.where(F.col("end_ms") - F.col("start_ms") <= _ms(LONGEST, second)).join(ends.select("source_id", "clip_ms"), "source_id").where("start_ms < clip_ms")
    covered = iv.overlap_sum(short, speech.select("source_id", "start_ms", "end_ms"))
    few = covered.where(F.col("overlap_ms") < F.least(F.lit(RETRY_COVER * second), RETRY_SHARE * (F.col("end_ms") - F.col("start_ms"))))
    pad = _ms(RETRY_PAD, second)
    windows = few.select(
        "source_id",
        "segment_id",
        F.greatest(F.lit(0).cast("long"), F.col("start_ms") - pad).alias("start_ms"),
        F.least("clip_ms", F.col("end_ms") + pad).alias("end_ms"),
        F.col("overlap_ms").cast("double").alias("value"),
    )
    return merge_with_cap(windows, 0, _ms(RETRY_LONGEST, second)).select("source_id", "start_ms", "end_ms", "n")
