"""Decision rules over scored evidence, as columns of named inputs.

Thresholds are fixed values of the rules and parameters here.  A null input is missing evidence:
what each rule makes of it is said there.  A rule returns a column that is never null unless its
docstring says so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slack for comparisons of decimal fractions with floors.
EPS = 1e-9


def yes(c: Column) -> Column:
    """False where it is unknown."""
    return F.coalesce(c, F.lit(False))


def first_of(*rules: tuple[str, Column], otherwise: str | None = None) -> Column:
    """The name of the first rule that holds."""
    out = F.lit(otherwise).cast("string")
    for name, rule in reversed(rules):
        out = F.when(yes(rule), F.lit(name)).otherwise(out)
    return out


def span_state(hard: Column, contaminated: Column, covered: Column, observed: Column, unresolved: Column, pure: Column, complete: Column) -> tuple[Column, Column]:
    """State and reasons of a span.  Hard evidence or one contaminated frame rejects, however long
    the rest is; else every reason against it is listed in order; without any it is accepted."""
    reasons = F.array_compact(
        F.array(
            F.when(~yes(covered), "missing_temporal_coverage"),
            F.when(~yes(observed), "no_observable_identity"),
            F.when(yes(unresolved), "local_identity_unresolved"),
            F.when(~yes(pure), "span_purity_unresolved"),
            F.when(~yes(complete), "acoustic_boundary_incomplete"),
        )
    )
    rejected = yes(hard) | yes(contaminated)
    state = F.when(rejected, "rejected").when(F.size(reasons) > 0, "unresolved").otherwise("accepted")
    said = F.when(rejected, F.array(F.lit("local_contamination"))).when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("acoustically_verified")))
    return state, said


def local_witness(margins: list[Column], production: Column, rejected: Column) -> Column:
    """Why all four views prefer another, if the production margin or verdict does, too; else null."""
    negative = F.lit(True)
    for m in margins:
        negative = negative & yes(m < 0)
    return (
        F.when(negative & yes(production < 0), "domain_all_four_and_production_primary_negative")
        .when(negative & yes(rejected), "domain_all_four_and_production_exclusion_rejected")
        .cast("string")
    )


def rival_supported(scores: dict[str, tuple[Column, Column, float]], margin: float) -> tuple[Column, Column]:
    """Whether a rival is a candidate, and whether it is confirmed.  scores: by channel the
    rival's score, the target's and the floor.  A candidate is above the floor and ahead of the
    target in both main channels; a third one confirms it, or both character channels do."""
    ahead = {c: yes((s > floor) & (s - t > margin)) for c, (s, t, floor) in scores.items()}
    candidate = ahead["primary"] & ahead["secondary"]
    no = F.lit(False)
    independent = ahead.get("tertiary", no) | (ahead.get("character", no) & ahead.get("actor", no))
    return candidate, candidate & independent


def dialogue_path(
    passed: Column, duration: Column, p_slack: Column, s_slack: Column, cm_p: Column, cm_s: Column, t_strong: Column, cohort: Column, scene_distance: Column
) -> Column:
    """The first certificate that a short dialogue earns, else null.  passed: it has windows and
    all are accepted and unsmoothed; cm_p, cm_s: their least cohort margins, null if one is
    missing; slacks: how far its scores are above the floors."""
    margins = lambda p, s: yes((cm_p >= p) & (cm_s >= s))
    slack = lambda p, s: yes((p_slack >= p - EPS) & (s_slack >= s - EPS))
    strong = yes(t_strong)
    path = first_of(
        ("A_dual_cohort", slack(0.08, -0.02) & margins(0.09, 0.14)),
        ("B_three_channel", strong & slack(0.05, -0.02) & margins(0.08, 0.10)),
        ("C_stable_dialogue", (duration >= 1.85) & slack(0.04, 0.02) & (cohort >= 0.08)),
        ("D_cohort_dominant", slack(0.08, -0.045) & ((strong & margins(0.10, 0.25)) | margins(0.20, 0.25))),
        ("E_scene_dialogue", duration.between(1.05, 3.0) & (scene_distance <= 20.0) & slack(0.03, -0.04) & margins(0.08, 0.15)),
    )
    return F.when(yes(passed), path)


def clean_core(min_p: Column, min_s: Column, mean_p: Column, mean_s: Column, cm_p: Column, cm_s: Column, t_strong: Column, p_floor: float, s_floor: float) -> Column:
    """Accepted windows certify a core by both floors, or by the first alone with wide margins and a
    strong third channel, or by means above the floors with the widest margins."""
    margins = lambda p, s: yes((cm_p >= p) & (cm_s >= s))
    dual = (min_p >= p_floor + 0.05) & (min_s >= s_floor + 0.02) & margins(0.08, 0.08)
    mean = (min_p >= p_floor) & (min_s >= s_floor) & (mean_p >= p_floor + 0.04) & (mean_s >= s_floor + 0.04) & margins(0.15, 0.25)
    complementary = (min_p >= p_floor + 0.14) & (min_s >= s_floor - 0.02) & margins(0.12, 0.20) & yes(t_strong)
    return yes(dual) | yes(complementary) | yes(mean)


def strong_island(state: Column, rejected: Column, witnessed: Column, margins: list[Column], margin: float = 0.0) -> Column:
    """Supported, with no exclusion or witness against it, and ahead by the margin in all views."""
    out = yes(state == "target_supported") & ~yes(rejected) & ~yes(witnessed)
    for m in margins:
        out = out & yes((m > margin) & (m < float("inf")) & ~F.isnan(m))
    return out


def four_view_state(views: Column) -> Column:
    """views: array of struct variant, channel (stem or raw), margin, role.  A missing margin leaves
    it unresolved; two positive ones, one of them a stem's, support the target; the same role
    ahead in both stems and one raw view supports another."""
    stem, raw = F.filter(views, lambda v: v["channel"] == "stem"), F.filter(views, lambda v: v["channel"] == "raw")
    positive = F.filter(views, lambda v: v["margin"] > 0)
    role = F.get(stem, 0)["role"]
    one_role = role.isNotNull() & F.forall(stem, lambda v: yes((v["margin"] < 0) & (v["role"] == role)))
    other = one_role & F.exists(raw, lambda v: yes((v["margin"] < 0) & (v["role"] == role)))
    supported = (F.size(positive) >= 2) & F.exists(positive, lambda v: v["channel"] == "stem")
    missing = F.exists(views, lambda v: v["margin"].isNull())
    return F.when(missing, "unresolved").when(supported, "target_supported").when(yes(other), "other_supported").otherwise("unresolved")


def join_verdict(contaminated: Column, gap_allowed: Column, changed: Column, verified: Column, left: Column, right: Column) -> Column:
    """Why two neighbours may not join, or that they may."""
    return first_of(
        ("singing_or_overlap", contaminated),
        ("hard_silence_boundary", ~yes(gap_allowed)),
        ("confirmed_speaker_change", changed),
        ("whole_span_not_verified", ~yes(verified)),
        ("local_identity_unresolved", ~yes((left == "target_supported") & (right == "target_supported"))),
        otherwise="independent_local_target_support",
    )


def rescue_tier(
    observed: Column, accepted: Column, multi_veto: Column, conflict: Column, strong: Column, rescued: Column, window_min: Column, secondary: Column, secondary_floor: Column
) -> Column:
    """A or B.  Interval evidence decides where there is any; else vetoes make B and strong windows
    A; a row that no rescue brought in needs windows at 0.56, a rescued one at 0.62 and a
    secondary score 0.04 above its floor.  Missing scores count as good; so does a window score
    that isn't positive."""
    least = F.when(window_min > 0, window_min)
    weak_secondary = yes(secondary < secondary_floor + 0.04)
    return (
        F.when(yes(observed > 0), F.when(yes(accepted), "A").otherwise("B"))
        .when(yes(multi_veto) | yes(conflict), "B")
        .when(yes(strong), "A")
        .when(~yes(rescued), F.when(yes(least < 0.56), "B").otherwise("A"))
        .otherwise(F.when(weak_secondary | yes(least < 0.62), "B").otherwise("A"))
    )


def classifier_veto(negative: Column, near: Column, relevant: Column, rejected: Column, allow_near: Column) -> Column:
    """Two windows at or under the threshold; or, where near ones count and the audit rejected,
    three within 1 above it that are three quarters of the relevant windows."""
    by_near = yes(allow_near) & yes(rejected) & (near >= 3) & (near >= 0.75 * relevant)
    return yes(negative >= 2) | yes(by_near)


def keep_for_review(duration: Column, least: float, accepted: Column, blocked: Column, conflict: Column, contaminated: Column, covered: Column, positive: Column, mean: Column, error: Column) -> Column:
    """A well observed disagreement: fine evidence covers three quarters of it, is positive in three
    quarters, and its mean is above twice its error, with nothing blocked or contaminated."""
    seen = yes(covered >= 0.75) & yes(positive >= 0.75) & yes(mean > 2 * F.coalesce(error, F.lit(0.0)))
    return yes(duration >= least - EPS) & ~yes(accepted) & (F.coalesce(blocked, F.lit(0.0)) == 0) & ~yes(conflict) & ~yes(contaminated) & seen


def nonmember_passes(accepted: Column, conflict: Column, fused: Column, margins_passed: Column, primary: Column, secondary: Column, cohort: Column) -> Column:
    positive = yes(margins_passed) & yes(primary > 0) & yes(secondary > 0) & yes(cohort > 0)
    return yes(accepted) & ~yes(conflict) & (yes(fused) | positive)


def confident_borderline(tier: Column, vetoed: Column, certified: Column, covered: Column, rank: Column, fusion: Column) -> Column:
    """Tier B without a veto, and certified, covered whole by one certificate, or ranked high."""
    return yes(tier == "B") & ~yes(vetoed) & (yes(certified) | yes(covered) | yes(rank >= 1.38) | yes(fusion >= 0.70))


def anchor_role(target: tuple[Column, Column], floors: tuple[float, float], ahead: Column, nearest: tuple[Column, Column, Column]) -> Column:
    """target where both scores are at their floors and ahead of all others; else the nearest other
    role if that is strong and ahead of the target by 0.06 in both; else null.  nearest: the role
    and its two scores."""
    role, p, s = nearest
    own = (target[0] >= floors[0]) & (target[1] >= floors[1]) & yes(ahead)
    other = (p >= 0.55) & (s >= 0.42) & (p - target[0] >= 0.06) & (s - target[1] >= 0.06)
    return F.when(yes(own), "target").when(yes(other), role.cast("string"))


def consensus(gaps: Column, weights: Column, required: float) -> Column:
    """Struct of pooled margin, supporting, negative, conflict, discounted and accepted of aligned
    arrays of margins (null: none) and weights, which are held within 0 and 1.  Two negative
    views are a conflict; a view against it may be discounted where at least two support and
    all those against weigh less than each of these."""
    pairs = F.filter(F.arrays_zip(gaps.alias("g"), weights.alias("w")), lambda x: x["g"].isNotNull() & ~F.isnan(x["g"]))
    held = F.transform(pairs, lambda x: F.struct(x["g"].alias("g"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x["w"], F.lit(1.0)))).alias("w")))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)

    def of(v: Column) -> Column:
        total = add(F.transform(v, lambda x: x["w"]))
        pooled = F.when(total > 2.220446049250313e-16, add(F.transform(v, lambda x: x["w"] * x["g"])) / total).otherwise(F.lit(0.0))
        support, against = F.filter(v, lambda x: x["g"] >= required), F.filter(v, lambda x: x["g"] < required)
        negative = F.size(F.filter(v, lambda x: x["g"] < -max(0.0, required)))
        least = F.array_min(F.transform(support, lambda x: x["w"]))
        discounted = (F.size(against) > 0) & (F.size(support) > 0) & F.forall(against, lambda x: yes(x["w"] < least))
        accepted = (F.size(v) > 0) & (negative <= 1) & (pooled >= required) & ((F.size(against) == 0) | ((F.size(support) >= 2) & discounted))
        return F.struct(pooled.alias("margin"), F.size(support).alias("supporting"), negative.alias("negative"), (negative > 1).alias("conflict"), discounted.alias("discounted"), accepted.alias("accepted"))

    return F.element_at(F.transform(F.array(held), of), 1)


def non_regressing(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """No metric is worse: the loss may not rise by 1e-6, auc, f1 and balanced accuracy not fall by
    it; where counts of a sample guard are given, none may be lost and the protected ones stay.
    A missing metric is a regression."""
    out = yes(after["loss"] <= before["loss"] + 1e-6)
    for name in ("auc", "f1", "balanced"):
        out = out & yes(after[name] >= before[name] - 1e-6)
    if "protected_positives" in before:
        out = out & yes(after["protected_positives"] == before["protected_positives"]) & yes(after["protected_negatives"] == before["protected_negatives"])
        out = out & yes(after["lost_positives"] == 0) & yes(after["new_false_positives"] == 0)
    return out
