"""Whitening within groups, and cohort-normalised likelihood ratios.

Both fit on what Spark adds up: a matrix of the vectors' width, or a few numbers.  Only those come
to the driver; they don't grow with the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import vectors as vf
from cadenza.operators.evaluation import grouped_sums, quantile
from cadenza.operators.neighbours import nearest_scores
from cadenza.operators.storage import materialised

# Fixed values of the rules.
GROUPS, GROUP_ROWS, ALL_ROWS, LEAST_ROWS = 8, 16, 128, 8
GAINS = (0.5, 1.0)
TOP, LLR_LIMIT, LEAST_SCALE = 20, 20.0, 0.04


@dataclass
class Whitening:
    """x goes to the unit vector of `matrix` x."""

    matrix: np.ndarray
    fitted: bool

    def apply(self, df: DataFrame, vector: str = "v", out: str = "white") -> DataFrame:
        """Adds the whitened unit vector; null stays null."""
        held = df.sparkSession.sparkContext.broadcast(self.matrix)

        def white(column: pd.Series) -> pd.Series:
            known = np.flatnonzero(column.notna())
            out: list = [None] * len(column)
            if len(known):
                x = np.array(column.iloc[known].tolist(), float)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                y = x @ held.value
                for i, v in zip(known.tolist(), y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12), strict=True):
                    out[i] = v
            return pd.Series(out, dtype=object)

        white.__annotations__ = {"column": pd.Series, "return": pd.Series}
        return df.withColumn(out, F.pandas_udf(white, "array<double>")(F.col(vector)))


def spread_rows(df: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """Up to `most` rows of each group, evenly spaced in its order, ends included.  Places are running
    counts over ranges, so a large group is many tasks.  (group, order) tells rows apart."""
    placed = grouped_sums(df.withColumn("_one", F.lit(1).cast("long")), group, order, ["_one"])
    n = F.col("total__one")
    taken = F.least(n, F.lit(most))
    place, step = F.col("sum__one") - 1, F.greatest(n - 1, F.lit(1)) / F.greatest(taken - 1, F.lit(1))
    # The row is floor(k * step) for some k: the least k that reaches it is ceil(place / step).
    k = F.when(taken > 1, F.ceil(place / step - 1e-9)).otherwise(F.lit(0))
    hit = F.when(taken > 1, (k < taken) & (F.floor(k * step + 1e-9) == place)).otherwise(place == 0)
    return placed.where((n <= most) | hit).select(*df.columns)


def fit_whitening(df: DataFrame, group: str | None = "group", vector: str = "v", order: str = "vec_id", groups: int = GROUPS, rows: int | None = None) -> Whitening:
    """Directions in which members of a group differ are shrunk, up to half.

    With groups: of the first `groups` by name that have two rows, `rows` of each, each group with
    the same mass, about its median.  Without: of the whole table.  Identity with fewer than 8 rows,
    two such groups, or any spread.  Vectors are taken as unit vectors; the rest of each row is
    ignored.  Rows without a vector or group are passed over."""
    name = F.col(group).cast("string") if group else F.lit("")
    plain = df.select(name.alias("g"), vf.unit(F.col(vector)).alias("v"), F.col(order).alias("o")).where("g is not null and v is not null")
    first = plain.select(F.size("v").alias("n")).first()
    width = first.n if first else 0
    identity = Whitening(np.eye(width), False)
    if plain.count() < LEAST_ROWS:
        return identity
    if group:
        names = [r.g for r in plain.select("g").distinct().orderBy("g").limit(groups).collect()]
        plain = plain.where(F.col("g").isin(names))
    sample = materialised(spread_rows(plain, "g", "o", rows or (GROUP_ROWS if group else ALL_ROWS)), "spread")
    medians = sample.groupBy("g").agg(F.count("*").alias("n"), F.array(*[F.median(F.get("v", F.lit(i))) for i in range(width)]).alias("m"))
    medians = materialised(medians.where("n >= 2"), "medians")
    held = medians.count()
    if held < (2 if group else 1):
        return identity
    near = sample.join(medians, "g").select(F.zip_with("v", "m", lambda a, b: a - b).alias("r"), "n")

    def scatter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for b in batches:
            if len(b):
                r = np.array(b.r.tolist(), float)
                total += (r / (b.n.to_numpy(float) - 1)[:, None]).T @ r
        yield pd.DataFrame({"k": np.arange(width * width), "s": total.ravel()})

    cells = near.mapInPandas(scatter, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()  # width squared numbers
    matrix = np.zeros(width * width)
    for r in cells:
        matrix[r.k] = r.s
    matrix = matrix.reshape(width, width) / held
    total = float(np.trace(matrix))
    if total <= 1e-12:
        return identity
    variance, basis = np.linalg.eigh((matrix + matrix.T) / 2)
    prior = max(total / width, 1e-4)
    gains = np.clip(np.sqrt(prior / (0.5 * np.maximum(variance, 0) + 0.5 * prior)), *GAINS) - 1
    return Whitening(np.eye(width) + (basis * gains) @ basis.T, True)


def _stats(scores: Column, scale: float) -> Column:
    """Mean and deviation (at least the scale) of an array of scores."""
    mean = lambda s: vf.total(s) / F.size(s)
    spread = lambda s, m: F.sqrt(vf.total(F.transform(s, lambda x: (x - m) * (x - m))) / F.size(s))
    return vf.let(scores, lambda s: vf.let(mean(s), lambda m: F.struct(m.alias("m"), F.greatest(spread(s, m), F.lit(scale)).alias("s"))))


def _normal(score: Column, *sides: Column) -> Column:
    out = F.lit(0.0)
    for s in sides:
        out = out + 0.5 * (score - s["m"]) / s["s"]
    return out


@dataclass
class CohortRatio:
    """Log likelihood ratio of scores against a reference centre, normalised by a cohort on both sides."""

    centre: list
    floor: float
    scale: float
    cohorts: DataFrame
    n_cohorts: int
    centre_side: tuple[float, float] | None = None
    positive: float | None = None
    negative: float | None = None
    variance: float | None = None
    available: bool = False

    def apply(self, df: DataFrame) -> DataFrame:
        """Adds z and llr; df: vec_id, v, score.  Without a fit (or a vector) llr is the score above
        the floor, by the scale; z is that, too, where there is no cohort."""
        plain = (F.col("score") - self.floor) / self.scale
        if not self.n_cohorts or self.centre_side is None:
            return df.withColumns({"z": plain, "llr": plain})
        unit = df.select("vec_id", vf.unit("v").alias("v")).where("v is not null")
        near = nearest_scores(unit, self.cohorts, TOP).select("vec_id", _stats(F.col("scores"), self.scale).alias("_t"))
        side = F.struct(F.lit(self.centre_side[0]).alias("m"), F.lit(self.centre_side[1]).alias("s"))
        rows = df.join(near, "vec_id", "left").withColumn("z", F.when(F.col("_t").isNotNull(), _normal(F.col("score"), side, F.col("_t"))))
        if not self.available:
            return rows.withColumn("llr", plain).drop("_t")
        ratio = (self.positive - self.negative) * (F.col("z") - (self.positive + self.negative) / 2) / self.variance
        held = F.greatest(F.lit(-LLR_LIMIT), F.least(F.lit(LLR_LIMIT), ratio))
        return rows.withColumn("llr", F.when(F.col("z").isNotNull(), held).otherwise(plain)).drop("_t")


def _shrunk(values: DataFrame, prior: float) -> tuple[float, int]:
    """Mean of the values, held within their outer tenths where there are over two, with two priors."""
    n = values.count()
    z = F.col("z")
    if n > 2:
        low, high = quantile(values, "z", 0.1), quantile(values, "z", 0.9)
        z = F.greatest(F.lit(low), F.least(F.lit(high), z))
    return (float(values.agg(F.coalesce(F.sum(z), F.lit(0.0))).first()[0]) + 2 * prior) / (n + 2), n


def fit_cohort_ratio(references: DataFrame, cohorts: DataFrame, floor: float, scale: float) -> CohortRatio:
    """references, cohorts: vec_id, v.  Positives are references against the centre of the others; negatives
    are cohort members, normalised by the other ones.  Sums give the centres without one row, and the
    nearest cohort scores come by blocks; no pairs are held."""
    scale = max(LEAST_SCALE, float(scale))
    refs = materialised(references.select("vec_id", vf.unit("v").alias("v")).where("v is not null"), "references")
    cohort = materialised(cohorts.select("vec_id", vf.unit("v").alias("v")).where("v is not null"), "cohort")
    width = refs.select(F.size("v").alias("n")).first().n
    total = [float(x) for x in refs.agg(F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(width)]).alias("s")).first().s]
    length = math.sqrt(sum(x * x for x in total))
    n_refs, n_cohorts = refs.count(), cohort.count()
    out = CohortRatio([x / max(length, 1e-12) for x in total], float(floor), scale, cohort, n_cohorts)
    if n_cohorts < 2:
        return out
    centre = F.array(*[F.lit(x) for x in out.centre])
    scored = cohort.withColumn("score", vf.dot("v", centre))
    near = [r.score for r in scored.orderBy(F.desc("score")).select("score").limit(TOP + 1).collect()]  # 21 numbers

    def side(scores: list[float]) -> tuple[float, float]:
        return float(np.mean(scores)), max(float(np.std(scores)), scale)

    out.centre_side = side(near[:TOP])
    whole = F.struct(F.lit(out.centre_side[0]).alias("m"), F.lit(out.centre_side[1]).alias("s"))
    # Without one member: its own score leaves the largest ones if it is among them.
    sides = F.array(*[F.struct(*[F.lit(x).alias(k) for k, x in zip("ms", side([s for j, s in enumerate(near) if j != i][:TOP]), strict=True)]) for i in range(len(near))])
    known = F.array(*[F.lit(s) for s in near[:TOP]])
    place = F.array_position(known, F.col("score")).cast("int")
    without = F.when(place > 0, F.element_at(sides, F.greatest(place, F.lit(1)))).otherwise(whole)
    own = nearest_scores(cohort, cohort, TOP + 1).select("vec_id", _stats(F.slice("scores", 2, TOP), scale).alias("t"))  # the first is its own
    negatives = materialised(scored.join(own, "vec_id").select(_normal(F.col("score"), without, F.col("t")).alias("z")), "negatives")
    rest = F.zip_with(F.array(*[F.lit(x) for x in total]), F.col("v"), lambda a, b: a - b)
    apart = refs.select("vec_id", "v", vf.unit(rest).alias("c")).where("c is not null") if n_refs > 1 else refs.limit(0).withColumn("c", F.col("v"))
    t = nearest_scores(apart.select("vec_id", "v"), cohort, TOP).select("vec_id", _stats(F.col("scores"), scale).alias("t"))
    z = nearest_scores(apart.select("vec_id", F.col("c").alias("v")), cohort, TOP).select("vec_id", _stats(F.col("scores"), scale).alias("z"))
    positives = apart.join(t, "vec_id").join(z, "vec_id").select(_normal(vf.dot("v", "c"), F.col("z"), F.col("t")).alias("z"))
    positives = materialised(positives, "positives")
    prior = lambda score: (score - out.centre_side[0]) / out.centre_side[1]  # noqa: E731  the centre is on both sides
    out.positive, n_pos = _shrunk(positives, prior(min(1.0, out.floor + scale)))
    out.negative, n_neg = _shrunk(negatives, prior(out.floor - scale))
    if n_refs == 1:
        out.positive = max(out.positive, out.negative + 0.500001, 0.250001)
    squares = lambda df, m: float(df.agg(F.coalesce(F.sum((F.col("z") - m) * (F.col("z") - m)), F.lit(0.0))).first()[0])
    out.variance = (squares(positives, out.positive) + squares(negatives, out.negative) + 2) / (n_pos + n_neg + 2)
    out.available = out.positive > out.negative
    return out
