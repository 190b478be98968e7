"""Rules that give a row another chance on evidence of other channels and models, as columns.

A match is a struct of `accepted`, `tier`, `paired` (the paired median over references) and of the
two models `primary` and `secondary`; a model, the third one too, is a struct of `score`, `best` and
`median` (over references), `p20` and `votes` (over windows) and `windows` (their scores in order).
A rule reads the fields that its table names.  Null and NaN are missing evidence: no floor is met by
them, no ceiling, no margin and no gain.  No rule returns null unless its docstring says so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions.decisions import first_of, yes
from cadenza.functions.vectors import let

Floors = dict[str, float]

# Fixed values: (least floor, how far below the threshold a floor may lie), by model and measure.
STEM_FLOORS = {
    "primary.score": (0.38, 0.24),
    "secondary.score": (0.36, 0.28),
    "primary.best": (0.42, 0.28),
    "secondary.best": (0.38, 0.30),
    "paired": (0.36, 0.32),
    "p20": (0.28, 0.36),  # of the better model
}
RAW_FLOORS = {
    "primary.score": (0.64, 0.06),
    "secondary.score": (0.60, 0.08),
    "primary.best": (0.58, 0.10),
    "secondary.best": (0.54, 0.12),
    "paired": (0.52, 0.14),
    "p20": (0.40, 0.22),
}
DIAGONAL_FLOORS = {
    "raw.primary.score": (0.54, 0.14),
    "stem.secondary.score": (0.56, 0.12),
    "stem.primary.score": (0.44, 0.24),
    "raw.secondary.score": (0.46, 0.22),
    "raw.primary.best": (0.55, 0.13),
    "stem.secondary.best": (0.56, 0.12),
    "raw.primary.p20": (0.45, 0.23),
    "stem.secondary.p20": (0.40, 0.28),
}
DIAGONAL_PAIR = (0.48, 0.20)
WINDOW_FLOORS = {"primary": (0.32, 0.35), "secondary": (0.28, 0.38)}
RAW_TIERS = ("short_strong", "strong", "balanced")
DIAGONAL_GAIN = 0.05
RAW_GAIN = 0.03
SHORTEST = 0.35
CONTINUITY_FROM = 1.8
LOW_SHARE = 0.20

# Durations in seconds, floors by model and measure, slack of the third model's windows.
WHOLE_TURN = ((2.20, 15.0), {"primary.score": 0.40, "secondary.score": 0.53, "primary.best": 0.38, "secondary.best": 0.48}, 0.08)
WHOLE_TIERS = ("recall", "rejected")
WHOLE_LEAD = 0.03
FRAGMENT = ((0.75, 8.0), {"primary.score": 0.48, "secondary.score": 0.44, "primary.best": 0.43, "secondary.best": 0.40}, 0.05)
RESIDUAL_SECONDS = (0.25, 0.90)
RESIDUAL_CEILINGS = {"primary.best": 0.42, "secondary.best": 0.35}
EDGE_MARGIN = 0.15
EDGE_THIRD_BELOW = 0.15
EDGE_THIRD_MARGIN = 0.25

# Share of a turn that the locator covers, floors of models and windows.
CONFIRMED_COVERAGE = 0.90
CONFIRMED_FLOORS = {
    "primary.votes": 0.75,
    "secondary.votes": 0.75,
    "primary.p20": 0.50,
    "secondary.p20": 0.46,
    "primary.score": 0.58,
    "secondary.score": 0.50,
    "primary.median": 0.50,
    "secondary.median": 0.44,
    "paired": 0.49,
}


def known(c: Column) -> Column:
    """Null where it is NaN, too."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def field(record: Column, path: str) -> Column:
    return known(reduce(lambda c, name: c[name], path.split("."), record))


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, map(yes, conditions))


def meets(record: Column, floors: Floors) -> Column:
    return every([field(record, path) >= floor for path, floor in floors.items()])


def within(c: Column, ends: tuple[float, float]) -> Column:
    return yes(known(c).between(*ends))


def lowered(floors: dict[str, tuple[float, float]], threshold: float) -> Floors:
    """Floors relative to the threshold, but never under their least values, so that a low threshold
    doesn't open a single channel."""
    return {path: max(least, threshold - below) for path, (least, below) in floors.items()}


def continuous(match: Column, seconds: Column, threshold: float) -> Column:
    """Not more than a fifth of the windows that both models have is low in both; short turns pass.
    A missing window score isn't low."""
    floors = lowered(WINDOW_FLOORS, threshold)
    pairs = F.arrays_zip(match["primary"]["windows"].alias("p"), match["secondary"]["windows"].alias("s"))
    shared = F.least(F.array_size(match["primary"]["windows"]), F.array_size(match["secondary"]["windows"]))
    low = F.filter(pairs, lambda x: yes(known(x["p"]) < floors["primary"]) & yes(known(x["s"]) < floors["secondary"]))
    return ~yes((known(seconds) >= CONTINUITY_FROM) & (F.try_divide(F.array_size(low), shared) > LOW_SHARE))


def shared_references(*scores: Column) -> Column:
    """How many references every array of scores (by place) has, null being none."""
    zipped = F.arrays_zip(*[s.alias(f"s{i}") for i, s in enumerate(scores)])
    has = F.filter(zipped, lambda x: every([known(x[f"s{i}"]).isNotNull() for i in range(len(scores))]))
    return F.coalesce(F.array_size(has), F.lit(0))


def four_way_support(stem_p: Column, stem_s: Column, raw_p: Column, raw_s: Column) -> Column:
    """count, primary and secondary over the references that all four arrays have: the best score that
    both channels reach at one reference, for each model; zeros without such a reference."""
    zipped = F.arrays_zip(stem_p.alias("a"), stem_s.alias("b"), raw_p.alias("c"), raw_s.alias("d"))
    has = F.filter(zipped, lambda x: every([known(x[n]).isNotNull() for n in "abcd"]))
    best = lambda h, m, n: F.coalesce(F.array_max(F.transform(h, lambda x: F.least(x[m], x[n]))).cast("double"), F.lit(0.0))
    return let(F.coalesce(has, F.slice(zipped, 1, 0)), lambda h: F.struct(F.coalesce(F.array_size(h), F.lit(0)).alias("count"), best(h, "a", "c").alias("primary"), best(h, "b", "d").alias("secondary")))


def diagonal_support(raw_p: Column, stem_s: Column, threshold: float, weaker: float = 0.10, least: tuple[float, float] = (0.42, 0.46)) -> Column:
    """count and pair: references at both floors of raw primary and stem secondary with the best score
    that both reach; without any, references at floors lower by `weaker` (not under `least`) with the
    lesser of both arrays' best scores; zeros without these, too."""
    floors = lowered({k: DIAGONAL_FLOORS[k] for k in ("raw.primary.score", "stem.secondary.score")}, threshold)
    high = tuple(floors.values())
    low = tuple(max(m, f - weaker) for m, f in zip(least, high))
    zipped = F.arrays_zip(raw_p.alias("r"), stem_s.alias("s"))
    at = lambda ends: F.filter(zipped, lambda x: yes(known(x["r"]) >= ends[0]) & yes(known(x["s"]) >= ends[1]))
    top = lambda a: F.array_max(F.filter(F.transform(a, known), lambda x: x.isNotNull()))
    number = lambda a: F.coalesce(F.array_size(a), F.lit(0))
    strong = F.array_max(F.transform(at(high), lambda x: F.least(x["r"], x["s"]))).cast("double")
    count = F.when(number(at(high)) > 0, number(at(high))).otherwise(number(at(low)))
    pair = F.when(number(at(high)) > 0, strong).when(number(at(low)) > 0, F.least(top(raw_p), top(stem_s)))
    return F.struct(count.alias("count"), F.coalesce(pair, F.lit(0.0)).alias("pair"))


def _meets_match(match: Column, floors: Floors) -> Column:
    """Floors of a match, that of `p20` for the better model."""
    rest = {k: v for k, v in floors.items() if k != "p20"}
    better = F.greatest(field(match, "primary.p20"), field(match, "secondary.p20"))
    return meets(match, rest) & yes(better >= floors["p20"])


def second_channel_rescue(
    stem: Column,
    raw: Column,
    threshold: float,
    seconds: Column,
    clean: Column,
    difference: Column,
    most_difference: float,
    four_way: Column | None = None,
    diagonal: Column | None = None,
    enabled: bool = True,
) -> Column:
    """What becomes of a turn that the separated stem refused and the original channel may rescue.

    `accepted` needs a strict match of the original channel and a gain of it, `accepted_diagonal` the
    original's primary and the stem's secondary model at one reference; both need some evidence of the
    stem.  Everything else is the first reason against it.  `four_way` (of `four_way_support`) is only
    asked for where it is given; without `diagonal` (of `diagonal_support`) there is no diagonal rescue.
    An unknown difference of the channels' durations counts as none.
    """
    stem_floors, raw_floors = lowered(STEM_FLOORS, threshold), lowered(RAW_FLOORS, threshold)
    some = _meets_match(stem, stem_floors)
    strict = yes(raw["accepted"]) & yes(raw["tier"].isin(*RAW_TIERS)) & _meets_match(raw, raw_floors)
    gain = lambda path: field(raw, path) - field(stem, path)
    crossed = F.lit(False)
    if diagonal is not None:
        least = lowered({"pair": DIAGONAL_PAIR}, threshold)["pair"]
        both = F.struct(stem.alias("stem"), raw.alias("raw"))
        paired = F.greatest(field(raw, "paired"), field(stem, "paired"))
        crossed = every([gain("primary.score") >= DIAGONAL_GAIN, meets(both, lowered(DIAGONAL_FLOORS, threshold)), paired >= least, diagonal["count"] > 0, field(diagonal, "pair") >= least])
    mismatch = F.lit(False)
    if four_way is not None:
        at = lambda model: min(stem_floors[f"{model}.score"], raw_floors[f"{model}.score"])
        mismatch = strict & ~every([four_way["count"] > 0, *[field(four_way, m) >= at(m) for m in ("primary", "secondary")]])
    gained = yes(F.greatest(gain("primary.score"), gain("secondary.score"), gain("paired")) >= RAW_GAIN)
    return first_of(
        ("disabled", F.lit(not enabled)),
        ("clean_gate_disabled", ~yes(clean)),
        ("channel_duration_mismatch", known(difference) > most_difference),
        ("duration_too_short", ~yes(known(seconds) >= SHORTEST)),
        ("missing_secondary_decision", stem["secondary"].isNull() | raw["secondary"].isNull()),
        ("uvr_discontinuous", ~continuous(stem, seconds, threshold)),
        ("uvr_insufficient_evidence", ~some),
        ("raw_and_diagonal_evidence_below_floor", ~strict & ~crossed),
        ("cross_channel_reference_mismatch", mismatch),
        ("raw_gain_insufficient", strict & ~gained),
        ("accepted", strict),
        otherwise="accepted_diagonal",
    )


def _third_confirms(third: Column, floor: Column, slack: float) -> Column:
    return every([field(third, "score") >= floor, field(third, "best") >= floor, field(third, "p20") >= floor - slack])


def whole_turn_promoted(match: Column, third: Column, floor: Column, seconds: Column) -> Column:
    """A refused whole turn that the secondary model leads in and the third one confirms at its floor."""
    ends, floors, slack = WHOLE_TURN
    lead = field(match, "secondary.score") - field(match, "primary.score") >= WHOLE_LEAD
    asked = [~yes(match["accepted"]), match["tier"].isin(*WHOLE_TIERS), within(seconds, ends), lead]
    return every(asked) & meets(match, floors) & _third_confirms(third, floor, slack)


def fragment_promoted(match: Column, third: Column, floor: Column, seconds: Column) -> Column:
    """A refused fragment beside a boundary with some direct support of both models and the third's."""
    ends, floors, slack = FRAGMENT
    return ~yes(match["accepted"]) & within(seconds, ends) & meets(match, floors) & _third_confirms(third, floor, slack)


def edge_margins(core: Column, residual: Column) -> Column:
    """How far a core is ahead of its residual: scores and best references of both models."""
    ahead = lambda path: field(core, path) - field(residual, path)
    return F.struct(*[ahead(f"{m}.{x}").alias(f"{m}_{x}") for m in ("primary", "secondary") for x in ("score", "best")])


def edge_promoted(core: Column, residual: Column, core_third: Column, residual_third: Column, floor: Column, core_seconds: Column, residual_seconds: Column) -> Column:
    """A core that passes as a fragment, beside a short refused residual that is clearly another voice
    in all three models."""
    margins = edge_margins(core, residual)
    ahead = [margins[f"{m}_{x}"] >= EDGE_MARGIN for m in ("primary", "secondary") for x in ("score", "best")]
    third = [
        field(residual_third, "best") <= floor - EDGE_THIRD_BELOW,
        *[field(core_third, x) - field(residual_third, x) >= EDGE_THIRD_MARGIN for x in ("score", "best")],
    ]
    other = [~yes(residual["accepted"]), within(residual_seconds, RESIDUAL_SECONDS), *[field(residual, p) <= c for p, c in RESIDUAL_CEILINGS.items()]]
    return every(other + ahead + third) & fragment_promoted(core, core_third, floor, core_seconds)


def third_windows(seconds: Column, shortest: float, longest: float, least_hop: float, most_hop: float) -> Column:
    """Length and hop, in seconds, of the windows that the third model scores: fragments 0.8, 1.2, 0.25
    and 0.45, residuals 0.4, 0.8, 0.2 and 0.3.  Null without a duration."""
    s = known(seconds)
    clip = lambda c, a, b: F.when(s.isNotNull(), F.least(F.greatest(c, F.lit(a)), F.lit(b)))
    return F.struct(clip(s, shortest, longest).alias("window"), clip(s / 2, least_hop, most_hop).alias("hop"))


def confirmed_recall(match: Column, coverage: Column, refused_by_score: Column) -> Column:
    """A turn refused for its score alone that the locator covers and both models support in nearly
    every window and against the references."""
    return every([refused_by_score, match["tier"] == "recall", known(coverage) >= CONFIRMED_COVERAGE]) & meets(match, CONFIRMED_FLOORS)
