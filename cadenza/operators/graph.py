"""Graphs as edge tables: connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.storage import materialised


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """(node, component): the least node that each node of an edge is connected to.

    Each round gives every label a fresh hash and hooks it to the label of least hash among its
    neighbours' and its own, then follows hooks once more (pointer jumping).  As the order is
    new each round, whatever the ids are, chains shrink geometrically: a label that is least
    among its neighbours takes them in.  Edges are relabelled each round and those inside a
    component drop out; the rounds end when none is left.  Only whether edges are left comes to
    the driver.  `max_rounds` guards against a loop without end and raises.  Null ends are
    ignored.
    """
    edges = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    nodes = edges.select(F.explode(F.array(a, b)).alias("node")).distinct()
    live = materialised(pairs.where("lo <> hi").distinct(), "edges")
    labels = materialised(nodes.withColumn("component", F.col("node")), "labels")
    done = 0
    while not live.isEmpty():
        if done == max_rounds:
            raise RuntimeError(f"edges between components are left after {max_rounds} rounds")
        done += 1
        rank = lambda c, k=done: F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("h"), F.col(c).alias("id"))
        # Every label hooks to the label of least rank it has an edge to, if that is below its own.
        ends = live.select(rank("lo").alias("x"), rank("hi").alias("y"))
        hooks = ends.groupBy(F.greatest("x", "y").alias("from")).agg(F.min(F.least("x", "y")).alias("to"))
        hooks = materialised(hooks.select(F.col("from.id").alias("from"), F.col("to.id").alias("to")), "hooks")
        jumps = hooks.alias("h").join(hooks.select(F.col("from").alias("to"), F.col("to").alias("far")), "to", "left")
        jumps = jumps.select("from", F.coalesce("far", "to").alias("to"))
        jumps = materialised(jumps, "jumps")
        hop = jumps.select(F.col("from").alias("component"), "to")
        labels = labels.join(hop, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = materialised(labels, "labels")
        for end in ("lo", "hi"):
            live = live.join(jumps.select(F.col("from").alias(end), "to"), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        live = live.select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"))
        live = materialised(live.where("lo <> hi").distinct(), "edges")
    if not done:
        return labels
    # A component's label is any of its nodes so far.
    least = labels.groupBy("component").agg(F.min("node").alias("least"))
    return labels.join(least, "component").select("node", F.col("least").alias("component"))
