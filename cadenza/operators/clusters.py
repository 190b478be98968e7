"""Clusters and diverse choices within one source.

The choices look at a source's vectors again after each pick, so a source is one group.  `ROWS` guards it: a larger source has to be cut first (see `folds`), and fails
with a message instead of taking a worker down.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.turn_clusters import link_turns

ROWS = 20_000


def _guard(rows: pd.DataFrame) -> None:
    if len(rows) > ROWS:
        raise ValueError(f"a source has {len(rows)} rows; beyond {ROWS} cut it at hard gaps first")


def agglomerate(df: DataFrame, least: float, veto: float) -> DataFrame:
    """(source_id, vec_id, cluster): average linkage on `primary` while the best pair's mean is
    at least `least`; a pair of which any two members are below `veto` on `secondary` never
    merges.  Clusters are named by their least vec_id; ties go to the least names.  A source may have
    any number of rows; see `turn_clusters`."""
    turns = df.select("source_id", F.col("vec_id").alias("turn"), "primary", "secondary", F.lit(None).cast("string").alias("role"))
    return link_turns(turns, least, veto).withColumnRenamed("turn", "vec_id")


def farthest_points(df: DataFrame, picks: int) -> DataFrame:
    """(source_id, vec_id, place): the best by quality first, then the largest quality times
    (1 + distance to the nearest pick), up to `picks` of each source.  df: quality too."""

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        _guard(rows)
        rows = rows.sort_values("vec_id")
        v, quality = np.array(rows.primary.tolist(), float), rows.quality.to_numpy()
        near, free, out = np.full(len(rows), 0.0), np.ones(len(rows), bool), []
        for place in range(min(picks, len(rows))):
            gain = np.where(free, quality * (1 + near), -np.inf)
            k = int(np.argmax(gain))
            free[k] = False
            distance = np.arccos(np.clip(v @ v[k], -1, 1)) / np.pi
            near = distance if place == 0 else np.minimum(near, distance)
            out.append((rows.source_id.iloc[k], rows.vec_id.iloc[k], place + 1))
        return pd.DataFrame(out, columns=["source_id", "vec_id", "place"])

    return df.select("source_id", "vec_id", "primary", "quality").groupBy("source_id").applyInPandas(group, "source_id long, vec_id long, place long")


def determinant_order(df: DataFrame, picks: int, width: float = 1.0) -> DataFrame:
    """(source_id, vec_id, place): greedy order by the determinant of an RBF kernel weighted by
    quality, by incremental Cholesky; ties go to the least vec_id."""

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        _guard(rows)
        rows = rows.sort_values("vec_id")
        v, quality = np.array(rows.primary.tolist(), float), rows.quality.to_numpy()
        left, factors, out = quality**2, [], []
        for place in range(min(picks, len(rows))):
            k = int(np.argmax(left))
            if left[k] <= 1e-9:
                break
            kernel = quality * quality[k] * np.exp(-((v - v[k]) ** 2).sum(1) / (2 * width**2))
            part = (kernel - sum((f * f[k] for f in factors), np.zeros(len(rows)))) / np.sqrt(left[k])
            factors.append(part)
            left = np.maximum(left - part**2, 0)
            left[k] = -1
            out.append((rows.source_id.iloc[k], rows.vec_id.iloc[k], place + 1))
        return pd.DataFrame(out, columns=["source_id", "vec_id", "place"])

    return df.select("source_id", "vec_id", "primary", "quality").groupBy("source_id").applyInPandas(group, "source_id long, vec_id long, place long")
