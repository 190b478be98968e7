"""Turns recovered by the voice that a source's accepted turns have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import vectors as vf
from cadenza.functions.decisions import yes
from cadenza.functions.rescue import Floors, every, known, meets

# Seeds of a source, coverage, similarity to the centroids, floors of direct evidence.
LEAST_SEEDS = 3
COVERAGE = 0.85
CLUSTER = {"primary": 0.78, "secondary": 0.72}
DIRECT: Floors = {"primary.score": 0.58, "secondary.score": 0.47, "paired": 0.47, "primary.best": 0.54, "secondary.best": 0.44}


def seed_centroids(turns: DataFrame, keys: list[str], is_seed: Column, primary: str, secondary: str, width: int) -> DataFrame:
    """keys, seeds and unit centroids `seed_primary` and `seed_secondary` of each scope.

    Seeds are rows of `is_seed` with both vectors of that width and without a null or NaN in them.
    Sums are combined in the tasks that read the rows, so a hot source costs a row for each task.
    """
    whole = lambda v: (F.array_size(v) == width) & F.forall(v, lambda x: known(x).isNotNull())
    seeds = turns.where(yes(is_seed) & yes(whole(F.col(primary))) & yes(whole(F.col(secondary))))
    mean = lambda v, name: vf.mean_vector(v, width).alias(name)
    found = seeds.groupBy(*keys).agg(F.count("*").alias("seeds"), mean(primary, "seed_primary"), mean(secondary, "seed_secondary"))
    return found.select(*keys, "seeds", vf.unit("seed_primary").alias("seed_primary"), vf.unit("seed_secondary").alias("seed_secondary"))


def promote_by_cluster(
    turns: DataFrame,
    keys: list[str],
    is_seed: Column,
    refused_by_score: Column,
    match: str = "match",
    coverage: str = "coverage",
    primary: str = "primary",
    secondary: str = "secondary",
    width: int = 32,
    least_seeds: int = LEAST_SEEDS,
) -> DataFrame:
    """`turns` with cluster_primary, cluster_secondary and cluster_promoted.

    A turn refused for its score alone, of tier `recall`, is promoted if both its vectors are near the
    centroid of its source's seeds, the locator covers it and the references support it directly.
    Sources with too few seeds promote nothing and have null scores; so have rows with null keys or
    without a vector.  Columns of these names in `turns` give way to new ones.
    """
    kept = turns.drop("cluster_primary", "cluster_secondary", "cluster_promoted")
    centre = "_seed_centre"
    while centre in kept.columns:
        centre += "_"
    found = seed_centroids(kept, keys, is_seed, primary, secondary, width).where(F.col("seeds") >= least_seeds)
    wide = kept.join(found.select(*keys, F.struct("seed_primary", "seed_secondary").alias(centre)), keys, "left")
    near = {m: vf.dot(v, F.col(centre)[f"seed_{m}"]) for m, v in (("primary", primary), ("secondary", secondary))}
    wide = wide.select(*kept.columns, *[known(c).alias(f"cluster_{m}") for m, c in near.items()])
    asked = [refused_by_score, F.col(match)["tier"] == "recall", known(F.col(coverage)) >= COVERAGE, *[F.col(f"cluster_{m}") >= floor for m, floor in CLUSTER.items()]]
    return wide.withColumn("cluster_promoted", every(asked) & meets(F.col(match), DIRECT))
