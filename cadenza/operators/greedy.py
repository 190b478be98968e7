"""Greedy suppression at scale: the lexicographically first maximal independent set.

"Walk in rank order, keep a row unless it conflicts with a kept one" needs no walk: a row whose
better-ranked conflicting rows are all dropped is kept, a row with a kept better-ranked one is
dropped, until none is undecided.  Each round is two joins on conflict edges.  Long chains of
decisions take a round for every two rows; what is left of few edges is therefore walked by one
task after some rounds, and larger rests go on in rounds.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cadenza.operators.storage import materialised

#: After so many rounds, a rest of at most so many edges is walked by one task.
ROUNDS, WALK = 12, 200_000


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """What the walk drops, each id after all of its betters."""
    below: dict = {}
    waiting: Counter = Counter()
    for x, y in zip(rows.better, rows.worse, strict=True):
        below.setdefault(x, []).append(y)
        waiting[y] += 1
    ready, lost = [x for x in below if not waiting[x]], set()
    while ready:
        x = ready.pop()
        for y in below.get(x, ()):
            if x not in lost:
                lost.add(y)
            waiting[y] -= 1
            if not waiting[y]:
                ready.append(y)
    if any(waiting.values()):
        raise ValueError("conflicts form a cycle")
    return pd.DataFrame({"id": pd.Series(list(lost), dtype=rows.worse.dtype)})


def suppress(conflicts: DataFrame, rounds: int = ROUNDS, walk: int = WALK) -> DataFrame:
    """Ids that greedy suppression drops.  conflicts: (better, worse) ids, one row for each
    pair of which the better-ranked, if kept, drops the worse.  What is in no pair is kept.
    Null ends and pairs of an id with itself are ignored; a cycle is an error."""
    live = materialised(conflicts.select("better", "worse").where("better <> worse").distinct(), "conflicts")
    dropped, done = None, 0
    while not live.isEmpty():
        if done >= rounds and live.count() <= walk:
            kind = StructType([StructField("id", live.schema["worse"].dataType)])
            lost = materialised(live.groupBy().applyInPandas(_walk, kind), "dropped")
            return lost if dropped is None else dropped.unionByName(lost)
        done += 1
        # Kept: better in some pair, worse in none.
        kept = live.select(F.col("better").alias("id")).join(live.select(F.col("worse").alias("id")), "id", "left_anti").distinct()
        lost = materialised(live.join(kept.select(F.col("id").alias("better")), "better", "left_semi").select(F.col("worse").alias("id")).distinct(), "dropped")
        if lost.isEmpty():
            raise ValueError("conflicts form a cycle")
        dropped = lost if dropped is None else dropped.unionByName(lost)
        gone = kept.unionByName(lost)
        for end in ("better", "worse"):
            live = live.join(gone.select(F.col("id").alias(end)), end, "left_anti")
        live = materialised(live.select("better", "worse"), "conflicts")
    return dropped if dropped is not None else conflicts.select(F.col("better").alias("id")).limit(0)
