"""Scores and ranks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cohort_probability(z: Column) -> Column:
    """Logistic in the cohort score, 1.2 steep around 1.5; 0.5 where there is none."""
    return F.coalesce(1 / (1 + F.exp(-(z - 1.5) * 1.2)), F.lit(0.5))


def finite(c: Column) -> Column:
    """The number, or null where it is NaN or infinite."""
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(~bad, c)


def first_finite(*columns: Column, default: float = float("-inf")) -> Column:
    return F.coalesce(*[finite(c) for c in columns], F.lit(default))


def grade_rank(grade: Column) -> Column:
    """Review 0, Silver 1, Gold 2, all else -1."""
    return F.when(grade == "Review", 0).when(grade == "Silver", 1).when(grade == "Gold", 2).otherwise(-1)


def tier_b_rank(fusion: Column, score: Column, second: Column, least: Column, removed: Column, loses: Column) -> Column:
    """Weighted rank of borderline rows; a lost comparison costs 0.6."""
    number = lambda c: F.coalesce(finite(c), F.lit(0.0))
    return (
        0.65 * number(fusion) + 0.15 * number(score) + 0.05 * number(second) + 0.15 * number(least)
        + F.when(removed, 0.05).otherwise(0.0) - F.when(loses, 0.6).otherwise(0.0)
    )


def sample_weight(label: Column, partial: Column) -> Column:
    """2 for partial negatives, 1.5 for partial positives, else 1."""
    return F.when(partial & (label == 0), 2.0).when(partial & (label == 1), 1.5).otherwise(1.0)


def duration_bucket(seconds: Column) -> Column:
    return F.when(seconds < 1.2, "<1.2").when(seconds < 3, "<3").when(seconds < 6, "<6").when(seconds <= 10, "<=10").otherwise(">10")


def interpolated(low: str, high: str, quarter: str) -> Column:
    """Between two neighbours of which neither is below 0, `quarter` quarters (0 to 3) of the way, as a fused low * (1 - d) + high * d rounds
    it.  Only three quarters of low aren't a float: what their sum with high loses is added again."""
    x, y = F.col(low), F.col(high)
    three = 2 * x + x
    lost = x - (three - 2 * x)
    whole = y + three
    part = whole - y
    lost = lost + ((y - (whole - part)) + (three - part))
    d = F.col(quarter)
    return F.when(d == 0, x).when(d == 1, (whole + lost) / 4).when(d == 2, 0.5 * x + 0.5 * y).otherwise(0.25 * x + 0.75 * y)
