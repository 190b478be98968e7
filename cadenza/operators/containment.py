"""Sequences of numbers that are wholly contained in longer ones, whatever their gain and level.

A sequence is contained in another one if, at the offset of largest Pearson correlation, that is at
least `LEAST`, and so is the correlation of every window of `width` values (each half a width on,
the last one aligned to the end); windows that are silent in both are passed over.

Candidates come from an index, not from pairs.  Windows are normalised (mean 0, length 1) and
projected on cosines.  Two windows of correlation r lie sqrt(2 - 2 r) apart, so their coordinates lie
`REACH` apart at most: cells of twice that width in `DIMENSIONS` coordinates, and of a query those
cells of both sides that a ball of that radius meets, find every pair of windows that may
correlate enough.  All windows of a contained sequence have to, so its rarest one is enough to look
up.  Within a cell a task compares the coordinates of both windows, and of those `width` before and
after, so only what agrees in these leaves the task; it is then verified on the values.  A cell of
many windows is dealt into parts of `CELL_ROWS`, and probes stream past them.

Sequences of equal values stand for each other, so a group of copies costs one lookup.  Which
containments count is decided longest first: only a kept sequence drops another one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.greedy import suppress
from cadenza.operators.storage import materialised

LEAST = 0.98
#: Windows and sequences below these say nothing.
SILENT_RMS, SILENT_POWER = 1e-6, 1e-12
DIMENSIONS, COMPARED = 6, 8
REACH = float(np.sqrt(2 - 2 * LEAST)) + 1e-9
_CELLS = int(2 / (2 * REACH)) + 3  # of each coordinate, with one more on both sides
#: Windows of one cell that a task compares at once, and comparisons of one product.
CELL_ROWS, PRODUCT = 1 << 15, 1 << 21
#: What rounding coordinates to 32 bits may add to a squared distance.
SLACK = 1e-5


def basis(width: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Orthonormal cosines over a window, without the constant one."""
    k, at = np.arange(1, min(dimensions, width - 1) + 1)[:, None], np.arange(width)[None, :]
    return np.sqrt(2 / width) * np.cos(np.pi * k * (2 * at + 1) / (2 * width))


def _cells(coordinates: np.ndarray) -> np.ndarray:
    return np.floor((coordinates + 1) / (2 * REACH)).astype(np.int64) + 1


def _key(cells: np.ndarray) -> np.ndarray:
    return cells @ (_CELLS ** np.arange(cells.shape[1], dtype=np.int64))


def window_coordinates(values: np.ndarray, starts: np.ndarray, width: int, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Projections of the normalised windows, and their root mean squares."""
    w = np.lib.stride_tricks.sliding_window_view(values, width)[starts]
    w = w - w.mean(1, keepdims=True)
    norm = np.sqrt((w * w).sum(1))
    safe = np.where(norm > 0, norm, 1)
    return (w / safe[:, None]) @ basis(width, dimensions).T, norm / np.sqrt(width)


def window_starts(n: int, width: int) -> np.ndarray:
    """Where windows begin that all have to agree."""
    return np.unique([*range(0, max(1, n - width + 1), max(1, width // 2)), max(0, n - width)])


def _reached(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the cells on both sides of each window's coordinates, and whether they are within reach."""
    low, own = _cells(at - REACH), _cells(at)
    edge = (own - 1) * (2 * REACH) - 1
    apart = np.stack((np.where(own > low, at - edge, 0), np.where(own > low, 0, edge + 2 * REACH - at)))  # from the lower cell, from the upper one
    sides = np.array(list(product((0, 1), repeat=at.shape[1])))
    far = sum((apart[sides[:, k]][:, :, k] ** 2 for k in range(at.shape[1])), np.zeros((len(sides), len(at)))).T
    return _key(low)[:, None] + _key(sides)[None, :], far <= REACH * REACH + SLACK


def probes(values: np.ndarray, width: int) -> list[tuple[int, list[int]]]:
    """(start, keys of the cells within reach) of each window that says something."""
    starts = window_starts(len(values), width)
    at, rms = window_coordinates(values, starts, width)
    keys, near = _reached(at)
    return [(s, k[ok].tolist()) for s, r, k, ok in zip(starts.tolist(), rms, keys, near, strict=True) if r >= SILENT_RMS]


def _surroundings(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window: coordinates of it, the one `width` after and the one `width` before, side by side; its
    root mean square; whether one of both neighbours says something.  A neighbour is unknown (NaN) where there
    is none, or it is neither flat nor says something."""
    n = len(values) - width + 1
    at, rms = window_coordinates(values, np.arange(n), width, COMPARED)
    known = np.where(((rms >= SILENT_RMS) | (rms == 0))[:, None], at, np.nan)
    out = np.full((n, 3, at.shape[1]), np.nan, np.float32)
    out[:, 0] = at
    heard = np.zeros(n, bool)
    if n > width:
        out[:-width, 1], out[width:, 2] = known[width:], known[:-width]
        heard[:-width] |= rms[width:] >= SILENT_RMS
        heard[width:] |= rms[:-width] >= SILENT_RMS
    return out.reshape(n, -1), rms, heard


def best_offset(query: np.ndarray, longer: np.ndarray) -> tuple[float, int]:
    """Largest correlation of the query with any stretch of the longer sequence, and where."""
    q = query - query.mean()
    power = float(q @ q)
    if power / len(q) < SILENT_POWER:
        return 0.0, 0
    x = longer - longer.mean()
    size = 1 << (len(q) + len(x) - 2).bit_length()
    dots = np.fft.irfft(np.fft.rfft(q[::-1], size) * np.fft.rfft(x, size), size)[len(q) - 1 : len(x)]
    sums, squares = (np.concatenate(([0.0], np.cumsum(c))) for c in (x, x * x))
    s, p = sums[len(q) :] - sums[: -len(q)], squares[len(q) :] - squares[: -len(q)]
    there = np.maximum(p - s * s / len(q), 0)
    score = np.where(there / len(q) >= SILENT_POWER, dots / np.sqrt(np.maximum(power * there, 1e-300)), 0.0)
    at = int(score.argmax())
    return float(np.clip(score[at], -1, 1)), at


def windows_agree(query: np.ndarray, part: np.ndarray, width: int) -> bool:
    starts = window_starts(len(query), width)
    view = lambda v: np.lib.stride_tricks.sliding_window_view(v, min(width, len(v)))[starts]
    a, b = (w - w.mean(1, keepdims=True) for w in (view(query), view(part)))
    na, nb = (np.sqrt((w * w).sum(1)) for w in (a, b))
    heard = np.maximum(na, nb) / np.sqrt(a.shape[1]) >= SILENT_RMS
    product_ = na * nb
    alike = (product_ > 1e-12) & ((a * b).sum(1) >= LEAST * product_)
    return bool(alike[heard].all())


def is_contained(query: np.ndarray, longer: np.ndarray, width: int) -> tuple[bool, float, int]:
    score, at = best_offset(query, longer)
    return score >= LEAST and windows_agree(query, longer[at : at + len(query)], width), score, at


def _arrays(batch: pa.RecordBatch, column: str) -> Iterator[np.ndarray]:
    held = batch.column(column)
    flat, ends = held.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(pa.compute.list_value_length(held).to_numpy())))
    return (flat[a:b] for a, b in zip(ends, ends[1:], strict=False))


def contained_sequences(sequences: DataFrame, width: int, shortest: int) -> DataFrame:
    """(id, of, correlation, at): the containments between different sequences; `of` is longer, or of
    equal length and comes first.  sequences: id, values, each id once.  Queries have at least
    `shortest` values (and a window); sequences with nulls or values that aren't finite match nothing."""
    whole = F.forall("values", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = sequences.select("id", F.col("values").cast("array<double>").alias("values")).where(F.col("values").isNotNull() & (F.size("values") >= width) & whole)
    rows = materialised(rows.withColumn("n", F.size("values")), "sequences")
    id_type = dict(rows.dtypes)["id"]
    spark = rows.sparkSession

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.zeros(0, np.int64)]
            for values in _arrays(batch, "values"):
                at, rms = window_coordinates(values, np.arange(len(values) - width + 1), width)
                keys.append(_key(_cells(at[rms > 0])))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(np.concatenate(keys), return_counts=True)], names=["key", "n"])

    counts = rows.mapInArrow(tally, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").toArrow()  # a row a cell: at most _CELLS ** DIMENSIONS
    held = spark.sparkContext.broadcast(tuple(counts.column(c).to_numpy() for c in ("key", "n")))

    def count(keys: np.ndarray) -> np.ndarray:
        known, n = held.value
        if not len(known):
            return np.zeros(keys.shape, np.int64)
        place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[place] == keys, n[place], 0)

    def dealt(asks: bool, batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        i, n, place, key, part = (np.concatenate(c) for c in list(zip(*found, strict=True))[:5])
        near = np.concatenate([f[5] for f in found])
        wide = pa.FixedSizeBinaryArray.from_buffers(pa.binary(near.shape[1] * 4), len(near), [None, pa.py_buffer(np.ascontiguousarray(near))]).cast(pa.binary())
        columns = [pa.array(key), pa.array(part.astype(np.int32)), pa.array(np.full(len(i), asks)), batch.column("id").take(pa.array(i)), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32)), wide]
        return pa.RecordBatch.from_arrays(columns, names=["key", "part", "asks", "id", "n", "place", "near"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, size = [], 0
            for i, values in enumerate(_arrays(batch, "values")):
                near, rms, _ = _surroundings(values, width)
                at = np.flatnonzero(rms > 0)
                key = _key(_cells(window_coordinates(values, at, width)[0])) if len(at) else at
                found.append((np.full(len(at), i), np.full(len(at), len(values)), at, key, (at + i) % np.maximum(1, -(-count(key) // CELL_ROWS)), near[at]))
                size += len(at)
                if size > CELL_ROWS:
                    yield dealt(False, batch, found)
                    found, size = [], 0
            if found:
                yield dealt(False, batch, found)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, size = [], 0
            for i, values in enumerate(_arrays(batch, "values")):
                starts = window_starts(len(values), width)
                near, rms, heard = _surroundings(values, width)
                starts = starts[rms[starts] >= SILENT_RMS]
                if not len(starts):
                    continue
                keys, reached = _reached(window_coordinates(values, starts, width)[0])
                often = np.where(reached, count(keys), 0)
                # Both neighbours of a window have to agree, too, if halves of the width add up to it; not so those of the last one.
                aligned = (starts % max(1, width // 2) == 0) & (width % 2 == 0)
                best = min(range(len(starts)), key=lambda k: (not (aligned[k] and heard[starts[k]]), often[k].sum(), k))
                mine = near[starts[best]].copy()
                if not aligned[best]:
                    mine[len(mine) // 3 :] = np.nan
                parts = -(-often[best] // CELL_ROWS)
                key, part = np.repeat(keys[best], parts), np.concatenate([np.arange(p) for p in parts])
                m = len(key)
                found.append((np.full(m, i), np.full(m, len(values)), np.full(m, starts[best]), key, part, np.broadcast_to(mine, (m, len(mine)))))
                size += m
                if size > CELL_ROWS:
                    yield dealt(True, batch, found)
                    found, size = [], 0
            if found:
                yield dealt(True, batch, found)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, index = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, part, asks, n, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "part", "asks", "n", "place"))
            near = np.frombuffer(b"".join(batch.column("near").to_pylist()), np.float32).reshape(batch.num_rows, 3, -1)
            ids = batch.column("id")
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if (key[a], part[a]) != cell:
                    cell, index = (key[a], part[a]), []
                if not asks[a]:
                    index.append((ids.slice(a, b - a), n[a:b], place[a:b], near[a:b]))
                    continue
                if len(index) > 1:
                    index = [(pa.concat_arrays([x[0] for x in index]), *(np.concatenate([x[k] for x in index]) for k in (1, 2, 3)))]
                if not index:
                    continue
                of, of_n, spot, there = index[0]
                step = max(1, PRODUCT // len(of_n))
                for c in range(a, b, step):
                    q = near[c : min(c + step, b)]
                    square = lambda w: (w * w).sum(1)
                    far = square(q[:, 0])[:, None] + square(there[:, 0])[None, :] - 2 * (q[:, 0] @ there[:, 0].T)
                    i, j = np.nonzero(far <= REACH * REACH + SLACK)
                    offset = spot[j] - place[c + i]
                    fits = (offset >= 0) & (offset + n[c + i] <= of_n[j])
                    i, j = i[fits], j[fits]
                    for k in (1, 2):
                        far = square(q[i, k] - there[j, k])
                        alike = ~(far > REACH * REACH + SLACK)  # unknown ones may be
                        i, j = i[alike], j[alike]
                    if len(i):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(c + i)), of.take(pa.array(j)), pa.array(n[c + i]), pa.array(of_n[j])], names=["id", "of", "n", "of_n"])

    kind = f"key long, part int, asks boolean, id {id_type}, n int, place int, near binary"
    asked = rows.where(F.col("n") >= shortest).mapInArrow(rarest, kind).unionByName(rows.mapInArrow(windows, kind))
    found = asked.repartition("key", "part").sortWithinPartitions("key", "part", "asks").mapInArrow(met, f"id {id_type}, of {id_type}, n int, of_n int")
    pairs = found.where("of_n > n or of < id").select("id", "of").distinct()
    both = pairs.join(rows.select("id", "values"), "id").join(rows.select(F.col("id").alias("of"), F.col("values").alias("longer")), "of")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [is_contained(q, x, width) for q, x in zip(_arrays(batch, "values"), _arrays(batch, "longer"), strict=True)]
            keep = pa.array([i for i, f in enumerate(found) if f[0]], pa.int64())
            kept = [found[i] for i in keep.to_pylist()]
            columns = [batch.column("id").take(keep), batch.column("of").take(keep), pa.array([f[1] for f in kept], pa.float64()), pa.array([f[2] for f in kept], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "of", "correlation", "at"])

    return both.mapInArrow(verify, f"id {id_type}, of {id_type}, correlation double, at int")


def deduplicate_sequences(sequences: DataFrame, width: int, shortest: int) -> DataFrame:
    """id, n, kept, copy_of (the first of the sequences with the same values, for others of them),
    part_of and at (the kept longer sequence that comes first, and where the row lies in it).

    Rank: longest first, then the least id.  Sequences without `shortest` values, silent ones, and
    ones with nulls or values that aren't finite are kept, copies or not."""
    v = F.col("values").cast("array<double>")
    n = F.when(v.isNull(), 0).otherwise(F.size(v))
    # Values that say something: as such a sequence its copies are contained in it, too.
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
    power = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / n
    rows = sequences.select("id", v.alias("values"), n.alias("n")).withColumn("sound", F.coalesce(sound, F.lit(False)) & (F.col("n") >= max(shortest, width)))
    rows = rows.withColumn("mean", F.when(F.col("sound"), mean)).withColumn("sound", F.coalesce(F.col("sound") & (power >= SILENT_POWER), F.lit(False)))
    rows = materialised(rows.drop("mean").withColumn("same", F.when(F.col("sound"), F.xxhash64("values"))), "clips")
    first = rows.where("sound").groupBy("values").agg(F.min("id").alias("first"))
    keyed = rows.where("sound").join(first.withColumn("same", F.xxhash64("values")), ["same", "values"])
    heads = keyed.where("id = first").select("id", "values")
    links = materialised(contained_sequences(heads, width, shortest), "contained")
    dropped = suppress(links.select(F.col("of").alias("better"), F.col("id").alias("worse"))).select("id").withColumn("gone", F.lit(True))
    # The first kept one that holds a dropped sequence, in the order of the walk.
    sizes = rows.select(F.col("id").alias("of"), F.col("n").alias("of_n"))
    whole = links.join(dropped.select(F.col("id").alias("of")), "of", "left_anti").join(sizes, "of")
    order = Window.partitionBy("id").orderBy(F.desc("of_n"), "of")
    whole = whole.withColumn("r", F.row_number().over(order)).where("r = 1").select("id", F.col("of").alias("part_of"), "at")
    heads_of = keyed.select("id", "first")
    out = rows.select("id", "n").join(heads_of, "id", "left").withColumn("head", F.coalesce("first", "id"))
    out = out.join(dropped.select(F.col("id").alias("head"), "gone"), "head", "left").join(whole.withColumnRenamed("id", "head"), "head", "left")
    copy = F.when(F.col("first") != F.col("id"), F.col("first"))
    kept = F.coalesce(~F.col("gone"), F.lit(True)) & copy.isNull()
    part = F.when(~kept, F.coalesce("part_of", copy))
    return out.select("id", "n", kept.alias("kept"), copy.alias("copy_of"), part.alias("part_of"), F.when(~kept, F.coalesce("at", F.lit(0))).alias("at"))
