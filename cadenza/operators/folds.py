"""Ordered folds within a source, for rules whose outcome depends on earlier decisions.

A cap on the merged length, or a row that replaces a kept one, makes the groups depend on what
was decided before, so window functions can't express them.  Window functions first number the
runs between hard splits, gaps over which no fold reaches; runs that begin within `GROUP_MS` are
one group, so a long source is many groups.  Spark deals groups to tasks and sorts them there; a
task reads its rows as Arrow batches and folds group after group, as a frame for each group would
cost more than the fold.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from itertools import accumulate
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cadenza.operators.intervals import BUCKET_MS, END, START, islands, overlap_join


#: Runs of a source that begin in one such stretch of time are folded in one call.
GROUP_MS = 8 * BUCKET_MS
#: Rows of one batch of results.
OUT_ROWS = 10_000


def _ordered(df: DataFrame, name: str) -> F.Column:
    """Ascending, or with a minus before the name descending; nulls and NaN last."""
    plain = name.lstrip("-")
    column = F.col(f"_rows.{plain}")
    if dict(df.dtypes)[plain] in ("double", "float"):
        column = F.nanvl(column, F.lit(None))
    return column.desc_nulls_last() if name.startswith("-") else column.asc_nulls_last()


def fold_runs(
    df: DataFrame, hard_gap: int, fold: Callable[[SimpleNamespace], list[tuple]], schema: str, order: tuple[str, ...] = (START, "segment_id"),
    beside: dict[str, tuple[DataFrame, int]] | None = None,
) -> DataFrame:
    """Applies the fold to a source's rows, some runs at a time.  It gets a group's columns as lists, in the given
    order of rows (`-` before a column: descending), and gives tuples of the schema's columns.

    beside: more intervals, each with how far behind the group's last end they still matter.  Those that meet the
    group come with it once, as a namespace of that name with their columns as lists, in the order of start and end."""
    beside = beside or {}
    kinds = {"_rows": df.columns, **{k: e.columns for k, (e, _) in beside.items()}}
    numbered = islands(df, ["source_id"], F.lit(hard_gap), out="run")
    columns = ["run", *[c for c in df.columns if c != "run"]]
    numbered = numbered.withColumn("run", F.floor(F.col("run") / GROUP_MS))
    dealt = numbered.select("source_id", "run", F.lit(len(beside)).alias("_side"), F.struct(*columns).alias("_rows"))
    kinds["_rows"] = columns
    if beside:
        extents = numbered.groupBy("source_id", "run").agg(F.min(START).alias(START), F.max(END).alias("_end"))
        for side, (name, (evidence, after)) in enumerate(beside.items()):
            near = overlap_join(extents.withColumn(END, F.col("_end") + after), evidence)
            kinds[name] = evidence.columns
            one = F.struct(*[F.col(c if c == "source_id" else f"b_{c}").alias(c) for c in evidence.columns])
            dealt = dealt.unionByName(near.select("source_id", "run", F.lit(side).alias("_side"), one.alias(name)), allowMissingColumns=True)
    spans = [F.col(f"{k}.{c}") for k in beside for c in (START, END)]
    rows = dealt.repartition("source_id", "run").sortWithinPartitions("source_id", "run", "_side", *spans, *[_ordered(df, c) for c in order])
    names = [*beside, "_rows"]
    out_schema = to_arrow_schema(StructType.fromDDL(schema))

    def whole(group: dict[str, list[list]]) -> list[tuple]:
        if not group["_rows"]:
            return []
        held = SimpleNamespace(**dict(zip(kinds["_rows"], group["_rows"], strict=True)))
        for k in names[:-1]:
            setattr(held, k, SimpleNamespace(**dict(zip(kinds[k], group[k] or [[] for _ in kinds[k]], strict=True))))
        return fold(held)

    def made(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), out_schema, strict=True)], schema=out_schema)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, found = None, {k: [] for k in names}, []
        for batch in batches:
            if not batch.num_rows:
                continue
            source, run, side = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("source_id", "run", "_side"))
            new = (source[1:] != source[:-1]) | (run[1:] != run[:-1]) | (side[1:] != side[:-1])
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            columns = {k: [c.to_pylist() for c in batch.column(k).flatten()] for k in names}
            for a, b in zip(edges, edges[1:], strict=False):
                here = (source[a], run[a])
                if here != key:
                    if key is not None:
                        found += whole(group)
                    key, group = here, {k: [] for k in names}
                    if len(found) >= OUT_ROWS:
                        yield made(found)
                        found = []
                kind = names[side[a]]
                parts = [c[a:b] for c in columns[kind]]
                if group[kind]:
                    for held, more in zip(group[kind], parts, strict=True):
                        held += more
                else:
                    group[kind] = parts
        if key is not None:
            found += whole(group)
        if found:
            yield made(found)

    return rows.mapInArrow(folded, schema)


class Spans:
    """Intervals in the order of their starts, asked by bisection."""

    def __init__(self, starts: list[int], ends: list[int]):
        self.starts = starts
        self.most = list(accumulate(ends, max))  # the largest end up to here
        self.least = list(accumulate(reversed(ends), min))[::-1]  # the least end from here on

    def meet(self, a: int, b: int) -> bool:
        """Whether one shares a stretch with a to b."""
        i = bisect_left(self.starts, b)
        return a < b and i > 0 and self.most[i - 1] > a

    def hold(self, a: int, b: int) -> bool:
        """Whether one has all of a to b."""
        i = bisect_right(self.starts, a)
        return i > 0 and self.most[i - 1] >= b

    def inside(self, a: int, b: int) -> bool:
        """Whether one lies in a to b whole."""
        i = bisect_left(self.starts, a)
        return i < len(self.starts) and self.least[i] <= b


class Apart:
    """Kept intervals, none of which shares more than `least` with another one.  Those no longer than that meet
    none and needn't be held; of the others the order of starts is that of ends, so those a row meets are neighbours."""

    def __init__(self, least: int):
        self.least, self.kept = least, []

    def hits(self, start: int, end: int) -> list[tuple]:
        """The first two kept ones that share more than `least` with the interval."""
        if end - start <= self.least:
            return []
        at = bisect_right(self.kept, start + self.least, key=lambda k: k[1])
        return [k for k in self.kept[at : at + 2] if k[0] < end - self.least]

    def add(self, start: int, end: int, row: int) -> None:
        if end - start > self.least:
            insort(self.kept, (start, end, row))

    def remove(self, kept: tuple) -> None:
        del self.kept[bisect_left(self.kept, kept)]


MERGED = "source_id long, start_ms long, end_ms long, n long, score double"


def merge_with_cap(df: DataFrame, gap: int, cap: int) -> DataFrame:
    """Neighbours at most `gap` apart merge while the whole stays within `cap`; scores take the
    least.  df: segment_id, source_id, start_ms, end_ms, value."""

    def fold(rows: SimpleNamespace) -> list:
        out: list[list] = []
        for source, a, b, v in zip(rows.source_id, rows.start_ms, rows.end_ms, rows.value, strict=True):
            last = out[-1] if out else None
            if last and a - last[2] <= gap and max(b, last[2]) - last[1] <= cap:
                last[2], last[3], last[4] = max(b, last[2]), last[3] + 1, min(v, last[4])
            else:
                out.append([source, a, b, 1, v])
        return out

    return fold_runs(df, gap, fold, MERGED)


def absorb_short(df: DataFrame, least: int, gap: int) -> DataFrame:
    """Rows shorter than `least` go into the next row within `gap`, else the one before."""

    def fold(rows: SimpleNamespace) -> list:
        todo = [[s, a, b, 1, v] for s, a, b, v in zip(rows.source_id, rows.start_ms, rows.end_ms, rows.value, strict=True)]
        i = 0
        while i < len(todo):
            row = todo[i]
            if row[2] - row[1] < least:
                if i + 1 < len(todo) and todo[i + 1][1] - row[2] <= gap:
                    other, low = todo[i + 1], row
                elif i and row[1] - todo[i - 1][2] <= gap:
                    other, low = todo[i - 1], todo[i - 1]
                else:
                    i += 1
                    continue
                other[1], other[2] = min(low[1], other[1]), max(row[2], other[2])
                other[3], other[4] = other[3] + row[3], min(other[4], row[4])
                todo.pop(i)
                i = max(0, i - 1)
                continue
            i += 1
        return todo

    return fold_runs(df, gap, fold, MERGED)


CHOSEN = "source_id long, segment_id long"


def schedule(df: DataFrame) -> DataFrame:
    """Disjoint rows with the largest total length; of equals the fewest rows, then the earliest
    ends.  Rows that don't overlap can't affect each other, so each island is one group."""

    def fold(rows: SimpleNamespace) -> list:
        ends, starts = rows.end_ms, rows.start_ms
        before = [bisect_right(ends, a) for a in starts]
        best: list[tuple[int, int]] = [(0, 0)]
        take = []
        for i in range(len(ends)):
            total, n = best[before[i]]
            with_row = (total + ends[i] - starts[i], n - 1)
            take.append(with_row > best[-1])
            best.append(max(best[-1], with_row))
        out, i = [], len(ends)
        while i:
            if take[i - 1]:
                out.append((rows.source_id[i - 1], rows.segment_id[i - 1]))
                i = before[i - 1]
            else:
                i -= 1
        return out

    # Touching rows don't overlap: runs may be cut there, and the fold takes both.
    return fold_runs(df, -1, fold, CHOSEN, order=(END, START, "segment_id"))


def online_clusters(df: DataFrame, least: float, key: str = "source_id") -> DataFrame:
    """Spherical clusters in time order: a row joins the nearest centroid from `least` on, else
    it opens a cluster.  df: vec_id, start_ms, primary, and the key.  Order dependent: one group
    a source."""
    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["start_ms", "vec_id"], kind="stable")
        sums: list[np.ndarray] = []
        out = []
        for v in rows.primary:
            v = np.asarray(v, float)
            scores = [float(s @ v / (np.linalg.norm(s) or 1.0)) for s in sums]
            k = int(np.argmax(scores)) if scores else -1
            if k >= 0 and scores[k] >= least:
                sums[k] = sums[k] + v
            else:
                k = len(sums)
                sums.append(v)
            out.append(k)
        return pd.DataFrame({key: rows[key], "vec_id": rows.vec_id, "cluster": out})

    return df.select(key, "vec_id", "start_ms", "primary").groupBy(key).applyInPandas(fold, f"{key} long, vec_id long, cluster long")


def best_segmentation(df: DataFrame, penalty: float, least: int) -> DataFrame:
    """Maximises the sum of values minus a penalty for each retained interval of at least
    `least` steps.  df: clip_id, frame_idx, level.  Returns clip_id, first, last."""
    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame_idx")
        at, prefix = rows.frame_idx.to_numpy(), np.concatenate(([0.0], np.cumsum(rows.level.to_numpy())))
        n = len(at)
        best, since, opened = np.zeros(n + 1), [-1] * (n + 1), (-np.inf, 0)
        for i in range(1, n + 1):
            if i - least >= 0:  # an interval from j to i, with the best gain before it
                opened = max(opened, (best[i - least] - prefix[i - least], -(i - least)))
            gain = opened[0] + prefix[i] - penalty
            best[i], since[i] = (gain, -opened[1]) if gain > best[i - 1] + 1e-12 else (best[i - 1], -1)
        out, i = [], n
        while i > 0:
            if since[i] < 0:
                i -= 1
            else:
                out.append((rows.clip_id.iloc[0], int(at[since[i]]), int(at[i - 1])))
                i = since[i]
        return pd.DataFrame(out[::-1], columns=["clip_id", "first", "last"])

    return df.groupBy("clip_id").applyInPandas(fold, "clip_id long, first long, last long")


def fold_cues(df: DataFrame, tolerance: int) -> DataFrame:
    """Cues whose edges are within the tolerance of the folded row before become one, with the
    first one's edges and their distinct texts.  df: segment_id, source_id, start_ms, end_ms, text."""

    def fold(rows: SimpleNamespace) -> list:
        out: list[list] = []
        for source, a, b, t in zip(rows.source_id, rows.start_ms, rows.end_ms, rows.text, strict=True):
            last = out[-1] if out else None
            if last and abs(a - last[1]) <= tolerance and abs(b - last[2]) <= tolerance:
                last[3][t] = None
            else:
                out.append([source, a, b, {t: None}])
        return [(s, a, b, " / ".join(t)) for s, a, b, t in out]

    return fold_runs(df, tolerance, fold, "source_id long, start_ms long, end_ms long, text string")


def replace_overlaps(df: DataFrame, least: int) -> DataFrame:
    """Tier suppression with replacement: by value, a row that overlaps kept ones by more than
    `least` is dropped, unless it holds a shorter kept one whole and scores at least 0.8 of it;
    then it takes that one's place.  df: segment_id, source_id, start_ms, end_ms, value."""

    def fold(rows: SimpleNamespace) -> list:
        apart, kept = Apart(least), set()
        for r, (a, b, value) in enumerate(zip(rows.start_ms, rows.end_ms, rows.value, strict=True)):
            hit = apart.hits(a, b)
            if hit:
                held = hit[0]
                if len(hit) > 1 or a > held[0] or b < held[1] or value < 0.8 * rows.value[held[2]]:
                    continue
                apart.remove(held)
                kept.discard(held[2])
            apart.add(a, b, r)
            kept.add(r)
        return [(rows.source_id[r], rows.segment_id[r]) for r in sorted(kept)]

    return fold_runs(df, 0, fold, CHOSEN, order=("-value", "segment_id"))


def split_long(df: DataFrame, longest: int, least: int) -> DataFrame:
    """Rows longer than `longest` are cut at the gap between their words that is nearest the
    middle and leaves `least` on both sides, again and again; what can't be cut stays and says
    so.  df: segment_id, source_id, start_ms, end_ms, words (array of struct start_ms, end_ms)."""

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.itertuples(index=False):
            words = sorted(((w["start_ms"], w["end_ms"]) for w in r.words), key=lambda w: w[0])
            gaps = [(p[1] + q[0]) // 2 for p, q in zip(words, words[1:], strict=False) if q[0] >= p[1]]
            todo = [(r.start_ms, r.end_ms)]
            while todo:
                a, b = todo.pop()
                cuts = [g for g in gaps if g - a >= least and b - g >= least]
                if b - a <= longest or not cuts:
                    out.append((r.segment_id, r.source_id, a, b, b - a > longest))
                else:
                    g = min(cuts, key=lambda g: (abs(2 * g - a - b), g))
                    todo += [(a, g), (g, b)]
        return pd.DataFrame(out, columns=["segment_id", "source_id", "start_ms", "end_ms", "too_long"])

    schema = "segment_id long, source_id long, start_ms long, end_ms long, too_long boolean"
    return df.select("segment_id", "source_id", "start_ms", "end_ms", "words").mapInPandas(lambda it: map(group, it), schema)


def space_out(df: DataFrame, least: int) -> DataFrame:
    """Points by strength, each at least `least` away from all taken.  df: segment_id, source_id,
    start_ms, end_ms, value; runs farther apart than `least` can't affect each other."""

    def fold(rows: SimpleNamespace) -> list:
        taken: list[int] = []
        out = []
        for source, segment, at in zip(rows.source_id, rows.segment_id, rows.start_ms, strict=True):
            i = bisect_left(taken, at)
            if (i == len(taken) or taken[i] - at >= least) and (not i or at - taken[i - 1] >= least):
                taken.insert(i, at)
                out.append((source, segment))
        return out

    return fold_runs(df.withColumn("end_ms", F.col("start_ms")), least, fold, CHOSEN, order=("-value", START, "segment_id"))
