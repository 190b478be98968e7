"""A signed evidence field over time, of observations of several families, and spans assessed by it.

Between neighbouring starts, centres and ends of observations the field is linear; each such cell's
two values come from one range join of cells with the observations that meet it, as weighted means of
each family (triangular weights about the centre), so repeating a window can't add to its vote.
Barriers make a cell 0.  Running sums over cells let any span be assessed by looking up the cells of
its two ends: what lies between is a difference of sums.

Families: coarse windows set the level; micro windows, source and local evidence, islands and fine
windows change it at their own resolution; consensus and island_identity are marks without a value;
boundary and coarse_boundary bar the cells they meet.

Times are integer milliseconds, intervals half-open; durations and integrals are in seconds.  Equal
observations count once.  Rows with nulls, without length, or of a value that isn't a number (or infinite,
but for boundaries) are passed over.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators import intervals as iv
from cadenza.operators.storage import materialised

START, END = iv.START, iv.END
VALUED = ("coarse", "micro", "source", "local", "island", "fine")
MARKS = ("consensus", "island_identity", "boundary", "coarse_boundary")
#: Slack between neighbouring micro windows, and at the edges of positive regions.
SLACK_MS = 20
_EPS, _ASINH1 = 2.220446049250313e-16, math.asinh(1.0)
_NORMAL = 0.6744897501960817 * math.sqrt(2)
_SUMS = ("integral", "positive", "observed", "identity", "blocked", "negative")
#: Cells' bounds are in half milliseconds, so that centres are whole numbers.
_UNIT = 2000.0
BUCKET = "_bucket"


def _known(observations: DataFrame) -> DataFrame:
    v = F.col("value").cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = observations.select("source_id", START, END, "kind", F.when(F.col("kind").isin("boundary", "coarse_boundary"), 0.0).otherwise(v).alias("value"))
    return rows.where((F.col(END) > F.col(START)) & F.col("source_id").isNotNull() & F.col("kind").isin(*VALUED, *MARKS)).where(finite | F.col("kind").isin("boundary", "coarse_boundary")).distinct()


def source_scales(known: DataFrame) -> DataFrame:
    """source_id, resolution (median length of coarse, else micro, else all windows, in seconds) and noise
    (how much overlapping coarse windows of one sign differ)."""
    width = (F.col(END) - F.col(START)) / 1000
    of = lambda kind: F.percentile(F.when(F.col("kind") == kind, width), F.lit(0.5))
    widths = known.groupBy("source_id").agg(F.coalesce(of("coarse"), of("micro"), F.percentile(width, F.lit(0.5))).alias("resolution"))
    w = Window.partitionBy("source_id").orderBy(START, END, "value")
    before = lambda c: F.lag(c).over(w)
    near = (F.col(START) < before(END)) & (F.col(START) > before(START)) & (F.col("value") * before("value") > 0)
    steps = known.where("kind = 'coarse'").withColumn("step", F.when(near, F.abs(F.col("value") - before("value"))))
    noise = steps.groupBy("source_id").agg((F.percentile("step", F.lit(0.5)) / _NORMAL).alias("noise"))
    return widths.join(noise, "source_id", "left").select("source_id", "resolution", F.coalesce("noise", F.lit(0.0)).alias("noise"))


def micro_barriers(known: DataFrame) -> DataFrame:
    """The observations with `bars`: negative micro windows that another one next to them supports, or
    that don't lie inside a region of positive coarse windows."""
    w = Window.partitionBy("source_id").orderBy(START, END, "value")
    micro = known.where("kind = 'micro'")

    def negative(side) -> Column:
        s, e, v = (side(c).over(w) for c in (START, END, "value"))
        return F.coalesce((v < 0) & (s != F.col(START)) & (F.greatest(START, s) <= F.least(END, e) + SLACK_MS), F.lit(False))

    beside = micro.withColumn("beside", negative(F.lag) | negative(F.lead))
    regions = iv.merge(known.where("kind = 'coarse' and value > 0").select("source_id", START, END))
    deep = lambda hit: [F.max(F.coalesce(hit & (F.col(f"b_{START}") + SLACK_MS < F.col(START)) & (F.col(END) < F.col(f"b_{END}") - SLACK_MS), F.lit(False))).alias("interior")]
    judged = iv.per_row(beside, regions, ["source_id"], deep)
    bars = (F.col("value") < 0) & (F.col("beside") | ~F.col("interior"))
    rest = known.where("kind <> 'micro'").withColumn("bars", F.lit(False))
    return rest.unionByName(judged.select(*known.columns, bars.alias("bars")))


def _densities(cells: DataFrame, known: DataFrame, bars: DataFrame, bucket_ms: int = iv.BUCKET_MS) -> DataFrame:
    """Cells with each family's weighted sums at both ends, which marks meet them, and whether they are barred.
    No observation or bar begins or ends within a cell, so those that meet it are those at its start: cells lie in the time
    bucket of their start alone, and what follows needs no other exchange than that by source and bucket.  Pairs are added
    up by cell and family first, so that few sums run over them."""
    double = lambda df, *more: df.select("source_id", (2 * F.col(START)).alias(f"b_{START}"), (2 * F.col(END)).alias(f"b_{END}"), *more)
    bar = (F.lit("barred").alias("b_kind"), F.lit(None).cast("double").alias("b_value"), F.lit(False).alias("b_bars"))
    found = double(known, F.col("kind").alias("b_kind"), F.col("value").alias("b_value"), F.col("bars").alias("b_bars")).unionByName(double(bars, *bar))
    s, e = F.col(f"b_{START}"), F.col(f"b_{END}")
    found = found.withColumn(BUCKET, F.explode(F.sequence(F.floor(s / bucket_ms), F.floor((e - 1) / bucket_ms))))
    meets = [F.col(f"c.{k}") == F.col(f"o.{k}") for k in ("source_id", BUCKET)] + [F.col(f"o.b_{START}") <= F.col(f"c.{START}"), F.col(f"c.{START}") < F.col(f"o.b_{END}")]
    centre, half, width = (s + e) / 2, (e - s) / 2, (e - s) / _UNIT
    value = F.when(F.col("b_kind") == "source", F.col("b_value") / width).otherwise(F.col("b_value"))
    weight = lambda x: F.greatest(F.lit(_EPS), 1 - F.abs(x - centre) / half)
    places = {"l": F.col(START), "r": F.col(END), "m": (F.col(START) + F.col(END)) / 2}
    placed = cells.withColumn(BUCKET, F.floor(F.col(START) / bucket_ms))
    pairs = placed.alias("c").join(found.alias("o"), meets, "left").select("c.*", f"o.b_{START}", f"o.b_{END}", "o.b_kind", "o.b_value", "o.b_bars")
    keys = ["source_id", BUCKET, START, END, "resolution"]
    pairs = pairs.select(*keys, F.col("b_kind").alias("kind"), F.col("b_value").alias("raw"), F.col("b_bars").alias("bar"), value.alias("value"), width.alias("width"), *[weight(x).alias(f"w_{p}") for p, x in places.items()])
    sums = [f(F.col(f"w_{p}")).alias(f"{p}_{n}") for p in places for n, f in (("sum", lambda w: F.sum(F.col("value") * w)), ("mass", F.sum), ("width", lambda w: F.sum(F.col("width") * w)))]
    middle = F.percentile(F.when(F.col("kind") == "micro", F.col("width")), F.lit(0.5)).alias("micro_width")
    by_kind = pairs.groupBy(*keys, "kind").agg(*sums, F.max("raw").alias("top"), F.max("bar").alias("bar"), middle)
    pick = lambda k, c, name: F.max(F.when(F.col("kind") == k, F.col(c))).alias(name)
    aggs = []
    for p in places:
        for k in VALUED if p != "m" else ("micro",):
            aggs += [pick(k, f"{p}_sum", f"{p}_{k}"), pick(k, f"{p}_mass", f"{p}_{k}_mass"), pick(k, f"{p}_width", f"{p}_{k}_width")]
    seen = F.col("kind") != "barred"
    flags = {f"has_{k}": F.col("kind") == k for k in (*VALUED, *MARKS)} | {"has_positive": (F.col("kind") != "fine") & (F.col("top") > 0), "has_bar": F.col("bar"), "observed": seen, "barred": ~seen}
    aggs += [F.coalesce(F.max(rule), F.lit(False)).alias(name) for name, rule in flags.items()]
    aggs += [F.max(F.when((F.col("kind") == "coarse") & (F.col("top") > 0), F.col("top"))).alias("top_coarse"), F.max("micro_width").alias("micro_width")]
    return by_kind.groupBy(*keys).agg(*aggs)


def _with_density(df: DataFrame, p: str, out: str) -> DataFrame:
    """Adds the combined value at one end of the cells."""
    mean = lambda k: F.col(f"{p}_{k}") / F.col(f"{p}_{k}_mass")
    typical = lambda k: F.col(f"{p}_{k}_width") / F.col(f"{p}_{k}_mass")
    b, resolution = F.col(out), F.coalesce("micro_width", "resolution")
    df = df.withColumn(out, F.coalesce("top_coarse", mean("coarse"), F.lit(0.0)))
    micro = mean("micro")
    df = df.withColumn(out, F.when(micro.isNull(), b).when(b > 0, b / (1 + F.abs(F.least(F.lit(0.0), micro))) + F.greatest(F.lit(0.0), micro)).otherwise(micro))
    df = df.withColumn(out, b + F.coalesce(resolution * mean("source"), F.lit(0.0)))
    local = F.when((mean("local") < 0) & F.col("has_consensus") & (b > 0), mean("local") / (1 + b * b)).otherwise(mean("local"))
    df = df.withColumn(out, b + F.coalesce(local * F.greatest(F.lit(1.0), resolution / typical("local")), F.lit(0.0)))
    df = df.withColumn(out, b + F.coalesce(mean("island") / (1 + F.abs(b)), F.lit(0.0)))
    fine, precision = mean("fine"), resolution / typical("fine")
    detail = F.when(b > 0, fine).otherwise(F.least(F.lit(0.0), fine))
    detail = F.when((detail > -_ASINH1) & (detail < 0) & (b > 0), detail / (1 + b * b)).otherwise(detail)
    added = b + detail * F.when(detail <= -_ASINH1, precision).otherwise(F.sqrt(precision))
    return df.withColumn(out, F.when(fine.isNull(), b).when(F.col("has_coarse") | F.col("has_island"), added).otherwise(F.least(F.lit(0.0), fine)))


def _amounts(left: Column, right: Column, seconds: Column) -> dict[str, Column]:
    """Integral of a linear piece, of its negative part, and for how long it is above zero."""
    integral = (left + right) / 2 * seconds
    crosses = left * right < 0
    share = F.abs(left) / F.nullif(F.abs(left) + F.abs(right), F.lit(0.0))  # until it crosses
    above = F.when(crosses, F.when(left > 0, share).otherwise(1 - share) * seconds).otherwise(F.when(integral > 0, seconds).otherwise(F.lit(0.0)))
    below = F.when(crosses, F.when(left < 0, -left * share).otherwise(-right * (1 - share)) * seconds / 2).otherwise(F.greatest(F.lit(0.0), -integral))
    return {"integral": integral, "positive": above, "negative": below}


def _piece(prefix: str, a: Column, b: Column) -> dict[str, Column]:
    """The amounts of the part from a to b of a cell whose columns have the prefix."""
    c = lambda n: F.col(f"{prefix}{n}")
    slope = (c("right") - c("left")) / (c(END) - c(START))
    seconds = (b - a) / _UNIT
    out = _amounts(c("left") + (a - c(START)) * slope, c("left") + (b - c(START)) * slope, seconds)
    return out | {k: F.when(c(f"is_{k}"), seconds).otherwise(F.lit(0.0)) for k in ("observed", "identity", "blocked")}


def _of_cell(prefix: str = "") -> dict[str, Column]:
    """The amounts of a whole cell whose columns have the prefix."""
    c = lambda n: F.col(f"{prefix}{n}")
    seconds = (c(END) - c(START)) / _UNIT
    return _amounts(c("left"), c("right"), seconds) | {k: F.when(c(f"is_{k}"), seconds).otherwise(F.lit(0.0)) for k in ("observed", "identity", "blocked")}


def build_field(observations: DataFrame, blocked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, scales).  Cells: source_id, start_ms, end_ms in half milliseconds, left, right (values at the
    ends), is_observed, is_identity, is_blocked, and sum_<what> up to each cell's end.

    observations: source_id, start_ms, end_ms, kind, value.  blocked: source_id, start_ms, end_ms."""
    known = materialised(micro_barriers(materialised(_known(observations), "observations")), "observations")
    scales = materialised(source_scales(known), "scales")
    bars = blocked.select("source_id", START, END).where(F.col(END) > F.col(START))
    ends = lambda df, *xs: df.select("source_id", F.explode(F.array(*xs)).alias(START))
    s, e = F.col(START), F.col(END)
    points = ends(known, 2 * s, s + e, 2 * e).unionByName(ends(bars.join(scales.select("source_id"), "source_id"), 2 * s, 2 * e)).distinct()
    cells = points.withColumn(END, F.lead(START).over(Window.partitionBy("source_id").orderBy(START))).where(F.col(END).isNotNull())
    df = _densities(cells.join(scales.select("source_id", "resolution"), "source_id"), known, bars)
    micro = F.col("has_micro")
    barrier = F.col("barred") | F.col("has_boundary") | F.when(micro, F.col("has_bar")).otherwise(F.col("has_coarse_boundary"))
    identity = F.when(micro, (F.col("m_micro") / F.col("m_micro_mass") > 0) | F.col("top_coarse").isNotNull() | F.col("has_island_identity")).otherwise(F.col("has_positive"))
    df = _with_density(_with_density(df, "l", "left"), "r", "right")
    value = lambda c: F.when(barrier, 0.0).otherwise(F.col(c)).alias(c)
    held = df.select("source_id", BUCKET, START, END, value("left"), value("right"), F.col("observed").alias("is_observed"), identity.alias("is_identity"), barrier.alias("is_blocked"))
    # Running sums within buckets, and over one total for each bucket.
    inside = Window.partitionBy("source_id", BUCKET).orderBy(START).rowsBetween(Window.unboundedPreceding, 0)
    held = materialised(held.withColumns(_of_cell()).select(*held.columns, *[F.sum(k).over(inside).alias(f"sum_{k}") for k in _SUMS]), "cells")
    totals = held.groupBy("source_id", BUCKET).agg(*[F.max_by(f"sum_{k}", START).alias(f"_t_{k}") for k in _SUMS])
    before = Window.partitionBy("source_id").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)  # of one row a bucket
    bases = totals.select("source_id", BUCKET, *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0.0)).alias(f"_b_{k}") for k in _SUMS])
    summed = held.join(bases, ["source_id", BUCKET]).withColumns({f"sum_{k}": F.col(f"sum_{k}") + F.col(f"_b_{k}") for k in _SUMS})
    return materialised(summed.drop(BUCKET, *[f"_b_{k}" for k in _SUMS]), "field"), scales


def assess_spans(spans: DataFrame, cells: DataFrame, scales: DataFrame, observations: DataFrame) -> DataFrame:
    """Each span (source_id, segment_id, start_ms, end_ms) with integral, positive_fraction, observed_fraction,
    identity_fraction, blocked_fraction, mean_evidence, negative_integral, penalty (two half-log-sample terms for its
    onset and offset), fine_mean, fine_error, fine_covered_fraction, edge_conflict and supported.

    Supported: observed as a whole, with identity at both ends, nothing blocked and a positive integral; where
    negative local evidence crosses an edge, only if the field isn't negative at either end."""
    c = cells.select("source_id", START, END, "left", "right", "is_observed", "is_identity", "is_blocked", *[f"sum_{k}" for k in _SUMS])
    range_ = c.groupBy("source_id").agg(F.min(START).alias("lo"), F.max(END).alias("hi"))  # one row a source
    asked = materialised(spans.select("source_id", "segment_id", START, END).where(F.col(END) > F.col(START)), "spans")
    rows = asked.join(range_, "source_id").select("source_id", "segment_id", F.greatest(2 * F.col(START), F.col("lo")).alias("a"), F.least(2 * F.col(END), F.col("hi")).alias("b")).where("b > a")

    # Both ends in one lookup, in which a cell is exchanged once.
    at = F.explode(F.array(F.struct(F.lit("x").alias("end"), F.col("a").alias("at")), F.struct(F.lit("y").alias("end"), (F.col("b") - 1).alias("at")))).alias("p")
    points = rows.select("source_id", "segment_id", "a", "b", at).select("source_id", "segment_id", "a", "b", "p.end", F.col("p.at").alias(START), (F.col("p.at") + 1).alias(END))
    met = iv.overlap_join(points, c.join(rows.select("source_id").distinct(), "source_id", "left_semi"))
    cell = F.struct(*[F.col(f"b_{n}").alias(n) for n in c.columns if n != "source_id"])
    both = met.groupBy("source_id", "segment_id", "a", "b").agg(*[F.first(F.when(F.col("end") == p, cell), ignorenulls=True).alias(p) for p in "xy"]).where("x is not null and y is not null")
    both = both.select("segment_id", "a", "b", *[F.col(f"{p}.{n}").alias(f"{p}_{n}") for p in "xy" for n in c.columns if n != "source_id"])
    one = F.col(f"x_{START}") == F.col(f"y_{START}")
    whole, first, last = _piece("x_", F.col("a"), F.col("b")), _piece("x_", F.col("a"), F.col(f"x_{END}")), _piece("y_", F.col(f"y_{START}"), F.col("b"))
    of_last = _of_cell("y_")
    sums = {k: F.when(one, whole[k]).otherwise(first[k] + last[k] + (F.col(f"y_sum_{k}") - of_last[k]) - F.col(f"x_sum_{k}")) for k in _SUMS}
    slope = lambda p, at: F.col(f"{p}left") + (at - F.col(f"{p}{START}")) * (F.col(f"{p}right") - F.col(f"{p}left")) / (F.col(f"{p}{END}") - F.col(f"{p}{START}"))
    found = both.select("segment_id", *[v.alias(k) for k, v in sums.items()], (F.col("x_is_identity") & F.col("y_is_identity")).alias("ends"), slope("x_", F.col("a")).alias("at_start"), slope("y_", F.col("b")).alias("at_end"))

    known = materialised(_known(observations).where("kind in ('fine', 'local')"), "observations")
    # Fine windows by what they share with the span; their union gives how much is covered.
    fine = iv.overlap_join(asked, known.where("kind = 'fine'").select("source_id", START, END, "value"))
    shared = iv.shared() / 1000
    g = fine.groupBy("segment_id").agg(
        F.sum(shared).alias("mass"), F.sum(F.col("b_value") * shared).alias("v"), F.sum(F.col("b_value") * F.col("b_value") * shared).alias("v2"), F.percentile(F.col(f"b_{END}") - F.col(f"b_{START}"), F.lit(0.5)).alias("w")
    )
    covered = iv.covered_length(asked, known.where("kind = 'fine'").select("source_id", START, END)).select("segment_id", "covered_ms")
    crosses = lambda t: (F.col(f"b_{START}") < t) & (t < F.col(f"b_{END}"))
    at_edge = (F.col(f"b_{START}") <= F.col(START)) & (F.col(START) < F.col(f"b_{END}")) | crosses(F.col(END)) | (F.col(f"b_{END}") == F.col(END))
    local = iv.overlap_join(asked, known.where("kind = 'local' and value < 0").select("source_id", START, END)).where(at_edge).select("segment_id").distinct().withColumn("edge", F.lit(True))

    out = asked.join(found, "segment_id", "left").join(g, "segment_id", "left").join(covered, "segment_id", "left").join(local, "segment_id", "left").join(scales, "source_id", "left")
    seconds = (F.col(END) - F.col(START)) / 1000
    zero = lambda k: F.coalesce(F.col(k), F.lit(0.0))
    mean = F.col("v") / F.col("mass")
    spread = F.greatest(F.lit(0.0), F.col("v2") / F.col("mass") - mean * mean)
    error = F.sqrt(spread / F.greatest(F.lit(1.0), (F.col(END) - F.col(START)) / F.col("w")))
    edge = F.coalesce("edge", F.lit(False))
    good = F.coalesce(F.col("ends"), F.lit(False)) & (zero("identity") > 0) & (zero("blocked") == 0) & (F.abs(zero("observed") - seconds) <= 1e-9 * seconds) & (zero("integral") > 0)
    good = good & (~edge | (F.col("at_start") >= 0) & (F.col("at_end") >= 0))
    return out.select(
        "source_id",
        "segment_id",
        zero("integral").alias("integral"),
        *[(zero(k) / seconds).alias(f"{k}_fraction") for k in ("positive", "observed", "identity", "blocked")],
        F.when(zero("observed") > 0, zero("integral") / F.col("observed")).otherwise(F.lit(0.0)).alias("mean_evidence"),
        zero("negative").alias("negative_integral"),
        (zero("noise") * F.coalesce("resolution", F.lit(1.0)) * F.log1p(zero("observed") / F.coalesce("resolution", F.lit(1.0)))).alias("penalty"),
        F.coalesce(mean, F.lit(0.0)).alias("fine_mean"),
        F.coalesce(error, F.lit(0.0)).alias("fine_error"),
        (F.coalesce("covered_ms", F.lit(0)) / (F.col(END) - F.col(START))).alias("fine_covered_fraction"),
        edge.alias("edge_conflict"),
        F.coalesce(good, F.lit(False)).alias("supported"),
    )
