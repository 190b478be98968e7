"""Iterative fits: the driver sees a few sums for each step, never a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.storage import materialised


def fit_temperature(df: DataFrame, score: str = "score", label: str = "y", rounds: int = 40) -> tuple[float, float]:
    """Scale and bias of a logistic curve over the scores, by Newton steps with halving; the scale
    stays within 0.01 and 200.  Each step is one aggregate of six sums."""
    a, b = 1.0, 0.0

    def sums(a: float, b: float):
        z = F.col(score) * a + b
        p = 1 / (1 + F.exp(-z))
        y, v = F.col(label).cast("double"), p * (1 - p)
        loss = F.greatest(z, F.lit(0.0)) - y * z + F.log1p(F.exp(-F.abs(z)))
        x = F.col(score)
        return df.agg(F.avg(loss), F.avg((p - y) * x), F.avg(p - y), F.avg(v * x * x), F.avg(v * x), F.avg(v)).first()

    now = sums(a, b)
    for _ in range(rounds):
        if now[0] is None:
            break
        loss, ga, gb, haa, hab, hbb = now
        haa, hbb = haa + 1e-9, hbb + 1e-9
        det = haa * hbb - hab * hab
        if det <= 0 or max(abs(ga), abs(gb)) < 1e-9:
            break
        da, db = (ga * hbb - gb * hab) / det, (gb * haa - ga * hab) / det
        step, better = 1.0, None
        while step > 1e-4:
            na, nb = min(200.0, max(0.01, a - step * da)), b - step * db
            trial = sums(na, nb)
            if trial[0] < loss - 1e-12:
                better = (na, nb, trial)
                break
            step /= 2
        if better is None:
            break
        a, b, now = better
    return a, b


def propagate_labels(edges: DataFrame, labels: DataFrame, rounds: int = 80, alpha: float = 0.95, tolerance: float = 1e-6) -> DataFrame:
    """(node, p): alpha * weighted mean of the neighbours + (1 - alpha) / 2, with known labels
    clamped; nodes without edges get 0.5.  edges: a, b, w (undirected, each pair once or both
    ways; the larger weight counts).  labels: node, y.  Stops when no p moves by `tolerance`."""
    both = edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    sym = both.where("a <> b").groupBy("a", "b").agg(F.max("w").alias("w"))
    total = sym.groupBy("a").agg(F.sum("w").alias("t"))
    weights = materialised(sym.join(total, "a").select("a", "b", (F.col("w") / F.col("t")).alias("w")), "weights")
    known = labels.select(F.col("node").alias("a"), F.col("y").cast("double").alias("y"))
    nodes = weights.select("a").distinct().unionByName(known.select("a")).distinct()
    p = materialised(nodes.join(known, "a", "left").select("a", "y", F.coalesce("y", F.lit(0.5)).alias("p")), "p")
    for _ in range(rounds):
        pulled = weights.join(p.select(F.col("a").alias("b"), "p"), "b").groupBy("a").agg(F.sum(F.col("w") * F.col("p")).alias("m"))
        new = alpha * F.col("m") + (1 - alpha) * 0.5
        after = p.join(pulled, "a", "left").select("a", "y", F.coalesce("y", new, F.lit(0.5)).alias("p"), F.abs(F.coalesce("y", new, F.lit(0.5)) - F.col("p")).alias("moved"))
        after = materialised(after, "p")
        moved = after.agg(F.max("moved")).first()[0]
        p = after.drop("moved")
        if moved is None or moved < tolerance:
            break
    return p.select(F.col("a").alias("node"), "p")


def chain_to_roots(links: DataFrame) -> DataFrame:
    """(id, root, steps) for links (id, parent): follows parents to the last one, doubling the
    reach each round until none goes further.  Ids on a cycle, or that lead into one, don't
    come back: their steps would grow without end, so they fall out once these exceed the
    number of links."""
    step = materialised(links.select("id", F.col("parent").alias("root"), F.lit(1).cast("long").alias("steps")), "chain")
    most = step.count()
    while True:
        far = step.select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("steps").alias("more"))
        joined = step.join(far, "root", "left")
        if joined.where("next is not null").isEmpty():
            return step
        moved = joined.select("id", F.coalesce("next", "root").alias("root"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        step = materialised(moved.where((F.col("id") != F.col("root")) & (F.col("steps") <= most)), "chain")
