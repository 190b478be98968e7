"""Sharding by histogram sort: shards of nearly equal bytes, equal texts next to each other.

Rows are ordered by (hash of the text, doc_id).  Splitters between shards are found without
sorting: candidate boundaries are spread over what is left of each splitter's bracket, every
partition counts exactly the bytes and rows below them, the counts are added up, and brackets
shrink until a boundary is within tolerance of its target, or no key is left inside.  Then
all rows are exchanged once, in pieces of bounded size, so that a shard never is one task.

Copies have the same hash and stay together, unless a splitter falls into their group: then
the bracket goes on shrinking over doc_id, so that a group of any size is split evenly.

Law `bytes`: sizes (UTF-8 bytes of the text plus 1) of shards are as near to equal as keys
allow.  Defined cases: null text counts as empty; ids are any 64-bit integers; null doc_id comes first in its group
(it shares the key of the least id if that is -2^63);
fully repeated rows share a key and stay in one shard; an empty table gives none; extra
columns stay as they are and names of our own columns get underscores where they clash.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import empty_text, free_name, materialised, read_table

SHARDS = 8
#: Bytes of text in one piece of a shard, and so in one task after the exchange; more where there
#: would be more pieces than the driver is to find splitters for.
PIECE_BYTES, MOST_PIECES = 32 << 20, 16_384
#: New boundaries in each bracket and round.
PROBES = 48
#: A splitter between shards may be off by this part of a shard; one inside by this part of a piece.
TOLERANCE, INNER_TOLERANCE = 1e-4, 0.2

_H0 = 1 << 63


def _below(h: np.ndarray, low: np.ndarray, probes: list[tuple[int, int]]) -> np.ndarray:
    """For each key (h, low) the number of the ascending probes that are at most the key."""
    # A probe beyond all keys, which sorts last, is below none.
    ph = np.array([p[0] - _H0 for p in probes if p[0] < 2 * _H0], np.int64)
    rank = np.searchsorted(ph, h, "left")
    after = np.searchsorted(ph, h, "right")
    for value in np.unique(h[after > rank]):  # few: only keys whose hash is a probe's
        at = np.flatnonzero(h == value)
        a, b = rank[at[0]], after[at[0]]
        inner = np.array([p[1] for p in probes[a:b]], np.int64)
        rank[at] += np.searchsorted(inner, low[at], "right")
    return rank


def _counts(keys: DataFrame, probes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(bytes, rows) below each of the ascending probes, over all partitions."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for b in batches:
            at = _below(b.column("h").to_numpy(), b.column("low").to_numpy(), probes)
            np.add.at(size, at, b.column("size").to_numpy())
            rows += np.bincount(at, minlength=len(rows))
        got = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (got, size[got], rows[got])], names=["at", "size", "rows"])

    found = keys.mapInArrow(count, "at long, size long, rows long").groupBy("at").agg(F.sum("size"), F.sum("rows"))
    size, rows = [0] * (len(probes) + 1), [0] * (len(probes) + 1)
    for at, s, r in found.collect():
        size[at], rows[at] = s, r
    return list(zip(np.cumsum(size)[:-1].tolist(), np.cumsum(rows)[:-1].tolist(), strict=True))


def find_splitters(keys: DataFrame, targets: list[float], tolerance: list[float]) -> tuple[list[tuple[int, int, int, int]], int]:
    """For each target the splitter (h, low) with the bytes and rows below it, and the number
    of rounds.  keys: h, low, size; a key counts as a whole number of any length here, (h, low) in base `width`."""
    top = keys.agg(F.max("low"), F.sum("size"), F.count("*"), F.min("low")).first()
    least = top[3] or 0
    width = (top[0] or 0) - least + 1
    key = lambda n: (n // width, n % width + least)
    lo = {i: (0, 0, 0) for i in range(len(targets))}
    hi = {i: ((1 << 64) * width, top[1] or 0, top[2]) for i in range(len(targets))}
    done: dict[int, tuple[int, int, int]] = {}
    rounds = 0
    while len(done) < len(targets):
        ask: set[int] = set()
        for i in set(range(len(targets))) - done.keys():
            a, b = lo[i][0], hi[i][0]
            near = min(lo[i], hi[i], key=lambda x: abs(x[1] - targets[i]))
            if abs(near[1] - targets[i]) <= tolerance[i] or b - a <= 1 or hi[i][2] - lo[i][2] <= 1:
                done[i] = near
            else:
                n = min(PROBES, b - a - 1)
                ask.update(a + (b - a) * (k + 1) // (n + 1) for k in range(n))
        if not ask:
            break
        probes = sorted(ask)
        known = _counts(keys, [key(n) for n in probes])
        rounds += 1
        sizes = [s for s, _ in known]
        for i in set(range(len(targets))) - done.keys():
            k = bisect_left(sizes, targets[i])  # the first probe with at least the target below it
            if k < len(probes) and probes[k] < hi[i][0]:
                hi[i] = (probes[k], *known[k])
            if k and probes[k - 1] > lo[i][0]:
                lo[i] = (probes[k - 1], *known[k - 1])
    return [(*key(done[i][0]), done[i][1], done[i][2]) for i in range(len(targets))], rounds


def shard_by_bytes(
    docs: DataFrame, shards: int = SHARDS, piece_bytes: int = PIECE_BYTES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents with columns size, shard and slot (gapless from 0 within the shard)."""
    low = free_name(docs, "_low")
    h, size, piece, shard, slot = (free_name(docs, n) for n in ("_h", "size", "_piece", "shard", "slot"))
    least = docs.agg(F.min(id_col)).first()[0] or 0
    no_id = max(least - 1, -_H0)
    keyed = docs.withColumns(
        {
            h: F.xxhash64(empty_text(text_col)),
            low: F.coalesce(F.col(id_col).cast("long"), F.lit(no_id).cast("long")),
            size: F.octet_length(empty_text(text_col)).cast("long") + 1,
        }
    )
    # 24 bytes a document, read again in each round.
    keys = materialised(keyed.select(F.col(h).alias("h"), F.col(low).alias("low"), F.col(size).alias("size")), "keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    each = max(1, min(-(-total // (shards * piece_bytes)), MOST_PIECES // shards))
    pieces = shards * each
    targets = [total * k / pieces for k in range(1, pieces)]
    tolerance = [total / shards * TOLERANCE if k % each == 0 else total / pieces * INNER_TOLERANCE for k in range(1, pieces)]
    found, _ = find_splitters(keys, targets, tolerance)
    splitters = sorted((a, b) for a, b, _, _ in found)
    rows_below = [0, *sorted(r for *_, r in found)]

    starts = np.array([rows_below[p] - rows_below[p - p % each] for p in range(pieces)], np.int64)

    def piece_of(hs: pd.Series, lows: pd.Series) -> pd.DataFrame:
        at = _below(hs.to_numpy(), lows.to_numpy(), splitters)
        return pd.DataFrame({"piece": at.astype("int32"), "start": starts[at]})

    order = Window.partitionBy(piece).orderBy(h, low, F.col(id_col).asc_nulls_first())
    at = free_name(docs, "_at")
    return (
        keyed.withColumn(at, F.pandas_udf(piece_of, "piece int, start long")(h, low))
        .withColumns({piece: F.col(at)["piece"], slot: F.col(at)["start"]})
        .drop(at)
        .repartitionById(pieces, piece)  # the one exchange of the texts: a piece is a task
        .withColumn(slot, F.col(slot) + F.row_number().over(order) - 1)
        .withColumn(shard, F.floor(F.col(piece) / each).cast("int"))
        .drop(h, low, piece)
    )


def op6_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_by_bytes(docs).select(
        "doc_id",
        "size",
        F.crc32(empty_text("text").cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op6_histogram_shards": op6_histogram_shards}
ORACLES: dict[str, str] = {}
