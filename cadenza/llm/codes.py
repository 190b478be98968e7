"""Vector codes: product quantisation by exact integer rounds over Hilbert-sorted blocks.

A vector's components become integers floor(4096 * x) and are cut into 8 equal parts; each part
position has a codebook of up to 16 entries, refined in 6 rounds over all rows.

The parts of a position are sorted along a Hilbert curve and stored once as flat blocks of up to
`BLOCK` of them, with the box (least and largest of each component) and the sums of the block.
A round compares codebook entries with boxes first: an entry whose least distance to the box is
above another one's largest distance can't be nearest to any part in it.  What is left is the
block's shortlist.  If that is one entry, the stored sums are all that is needed; else a small
kernel of 64-bit integers finds the nearest entry of each part, ties to the lower index.

Sums leave the tasks as one row for each entry, component and 32-bit digit, and Spark adds them
up; only codebooks, whose size doesn't depend on the number of rows, come to the driver and go to
the tasks.  Rows are numbered by being written first, and the sort breaks ties by row number, so
equal vectors are dealt out like any others.

Blocks whose components aren't below 2**26 (and codebooks with such entries) are worked in
Python's integers, which are exact at any size; errors that don't fit are the largest long.

Defined cases: rows whose vector is null, empty, or holds nulls, NaN or infinities are dropped, and
so are rows whose vector isn't as long as that of the smallest vec_id, or can't be cut into 8;
equal vec_ids are rows of their own, in the order of their vectors; a null vec_id comes last;
with fewer than 16 rows codebooks are smaller; an empty table gives no rows; null labels are one
group; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import materialised, read_table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Parts of a block, and bytes of parts that one task sorts.
BLOCK, TASK_BYTES = 256, 64_000_000
#: Components below this are worked in 64-bit integers; a part may have up to 512 of them.
SMALL = 1 << 26
LARGEST = (1 << 63) - 1
BLOCKS = "position int, n int, rows binary, small binary, raw binary, low array<long>, high array<long>, sums array<long>"

Codebooks = list[list[tuple[int, ...]]]


def scaled(x: float) -> int:
    return int(Fraction(x) * SCALE // 1)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along a Hilbert curve of points with `bits` bits in each of their dimensions."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):  # turn each subcube so that the curve goes through it as through the whole
        q, p = 1 << b, (1 << b) - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            t = np.where(set_, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t = np.where((x[n - 1] & (1 << b)) != 0, t ^ ((1 << b) - 1), t)
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def kept_rows(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label, v, row: rows with whole vectors of the right length, numbered and written."""
    v = F.col(vector).cast("array<double>")
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select("vec_id", "label", v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & whole)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").select(F.size("v").alias("n")).first()
    width = first.n if first and first.n % PARTS == 0 else 0
    return materialised(rows.where(F.size("v") == width).withColumn("row", F.monotonically_increasing_id()), "kept-vectors")


def first_codebooks(kept: DataFrame) -> Codebooks:
    found = kept.orderBy(F.asc_nulls_last("vec_id"), "v", "row").select("v").limit(ENTRIES).collect()
    d = len(found[0].v) // PARTS
    return [[tuple(scaled(x) for x in r.v[p * d : (p + 1) * d]) for r in found] for p in range(PARTS)]


def sorted_blocks(kept: DataFrame, width: int, block: int = BLOCK) -> DataFrame:
    """The parts in blocks along a Hilbert curve for each position; see BLOCKS."""
    d = width // PARTS
    dims, bits = min(d, 62), max(1, min(30, 62 // d))
    # Cells are cut between the least and the largest component; where exactly they lie moves no result.
    n, low, high = kept.agg(F.count("*"), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v").flatten().to_numpy().reshape(-1, width)
            at = (v / 2 - low / 2) / max(high / 2 - low / 2, 1e-300)  # halves, as a difference may be beyond doubles
            cells = np.clip(at * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
            for p in range(PARTS):
                part = np.ascontiguousarray(v[:, p * d : (p + 1) * d], "<f8")
                keys = hilbert_keys(cells[:, p * d : p * d + dims], bits)
                held = pa.array([x.tobytes() for x in part], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), p, np.int32)), pa.array(keys), batch.column("row"), held], names=["position", "key", "row", "part"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        position, rows, parts = None, [], []
        for batch in batches:
            for p, row, part in zip(batch.column("position").to_pylist(), batch.column("row").to_pylist(), batch.column("part").to_pylist(), strict=True):
                if rows and (p != position or len(rows) == block):
                    yield _packed(position, rows, b"".join(parts), d)
                    rows, parts = [], []
                position = p
                rows.append(row)
                parts.append(part)
        if rows:
            yield _packed(position, rows, b"".join(parts), d)

    tasks = max(kept.sparkSession.sparkContext.defaultParallelism, -(-n * width * 8 // TASK_BYTES))
    dealt = kept.select("row", "v").mapInArrow(deal, "position int, key long, row long, part binary")
    ordered = dealt.repartitionByRange(tasks, "position", "key", "row").sortWithinPartitions("position", "key", "row")
    return materialised(ordered.mapInArrow(pack, BLOCKS), "vector-blocks")


def _packed(position: int, rows: list[int], raw: bytes, d: int) -> pa.RecordBatch:
    v = np.frombuffer(raw, "<f8").reshape(-1, d)
    small = bool((np.abs(v) < SMALL // SCALE - 1).all()) and d <= 512
    x = np.floor(v * SCALE).astype(np.int64) if small else None
    box = [x.min(0).tolist(), x.max(0).tolist(), x.sum(0).tolist()] if small else [None] * 3
    flat = [x.astype("<i4").tobytes() if small else None, None if small else raw]
    row = [position, len(rows), np.array(rows, "<i8").tobytes(), *flat, *box]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 3]
    return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, kinds, strict=True)], names=["position", "n", "rows", "small", "raw", "low", "high", "sums"])


def shortlist(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """For each box (rows of low and high) which entries can be nearest to a point in it."""
    lo, hi, e = low[:, None, :], high[:, None, :], book[None, :, :]
    least = (np.maximum(np.maximum(lo - e, e - hi), 0) ** 2).sum(2)
    most = (np.maximum(np.abs(e - lo), np.abs(e - hi)) ** 2).sum(2)
    return least <= most.min(1, keepdims=True)


class Kernel:
    """Nearest entries of blocks, by one set of codebooks."""

    def __init__(self, books: Codebooks, d: int):
        self.books, self.d = books, d
        self.small = [all(abs(c) < SMALL for e in b for c in e) for b in books]
        self.arrays = [np.array(b, np.int64 if s else object).reshape(len(b), d) for b, s in zip(books, self.small, strict=True)]

    def blocks(self, batch: pa.RecordBatch) -> Iterator[tuple[int, dict, list[int], bool]]:
        """(position, block, its shortlist, whether 64-bit integers will do)."""
        rows = batch.to_pylist()
        lists: dict[int, list[int]] = {}
        for p in {r["position"] for r in rows}:
            at = [i for i, r in enumerate(rows) if r["position"] == p and r["small"] is not None and self.small[p]]
            if at:
                box = [np.array([rows[i][c] for i in at], np.int64) for c in ("low", "high")]
                for i, can in zip(at, shortlist(*box, self.arrays[p]), strict=True):
                    lists[i] = np.flatnonzero(can).tolist()
        for i, r in enumerate(rows):
            yield r["position"], r, lists.get(i, list(range(len(self.books[r["position"]])))), i in lists

    def nearest(self, p: int, block: dict, among: list[int], small: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parts, index of the nearest entry, and squared distance of each part of the block."""
        if small:
            x = np.frombuffer(block["small"], "<i4").reshape(-1, self.d).astype(np.int64)
        elif block["small"] is not None:
            x = np.frombuffer(block["small"], "<i4").reshape(-1, self.d).astype(object)
        else:
            v = np.frombuffer(block["raw"], "<f8").tolist()
            x = np.array([scaled(c) for c in v], object).reshape(-1, self.d)
        e = self.arrays[p] if small else np.array(self.books[p], object).reshape(-1, self.d)
        far = np.stack([((x - e[k]) ** 2).sum(1) for k in among], 1)
        best = far.argmin(1)
        return x, np.array(among)[best], far[np.arange(len(x)), best]


def refined(blocks: DataFrame, books: Codebooks, d: int) -> Codebooks:
    """One round: every entry becomes the floored mean of the parts it is nearest to."""
    held = blocks.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel, total = Kernel(held.value, d), {}

        def add(p: int, k: int, n: int, by: list[int]) -> None:
            t = total.setdefault((p, k), [0] * (d + 1))
            for j, c in enumerate((n, *by)):
                t[j] += c

        for batch in batches:
            for p, block, among, small in kernel.blocks(batch):
                if len(among) == 1 and small:
                    add(p, among[0], block["n"], block["sums"])
                    continue
                x, best, _ = kernel.nearest(p, block, among, small)
                for k in np.unique(best).tolist():
                    mine = x[best == k]
                    add(p, k, len(mine), mine.sum(0).tolist())
        out = []
        for (p, k), t in total.items():
            for j, c in enumerate(t):
                digit = 0
                while not -(1 << 31) <= c < 1 << 31:
                    out.append((p, k, j, digit, c & 0xFFFFFFFF))
                    c, digit = c >> 32, digit + 1
                out.append((p, k, j, digit, c))
        if out:
            kinds = [pa.int32()] * 4 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["p", "k", "j", "digit", "value"])

    each = blocks.mapInArrow(sums, "p int, k int, j int, digit int, value long")
    found = each.groupBy("p", "k", "j", "digit").agg(F.sum("value").alias("value")).collect()  # a few numbers for each component of each entry
    held.destroy()
    total: dict = {}
    for r in found:
        total[r.p, r.k, r.j] = total.get((r.p, r.k, r.j), 0) + (r.value << (32 * r.digit))
    return [
        [tuple(total[p, k, j] // total[p, k, 0] for j in range(1, d + 1)) if (p, k, 0) in total else e for k, e in enumerate(book)]
        for p, book in enumerate(books)
    ]


def assigned(blocks: DataFrame, books: Codebooks, d: int) -> DataFrame:
    """row, position, entry, error: the nearest entry of each part."""
    held = blocks.sparkSession.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = Kernel(held.value, d)
        for batch in batches:
            for p, block, among, small in kernel.blocks(batch):
                _, best, error = kernel.nearest(p, block, among, small)
                rows = np.frombuffer(block["rows"], "<i8")
                errors = error if small else np.array([min(LARGEST, e) for e in error.tolist()], np.int64)
                columns = [rows, np.full(len(rows), p, np.int32), best.astype(np.int32), errors]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", "position", "entry", "error"])

    return blocks.mapInArrow(assign, "row long, position int, entry int, error long")


def _long(total: Column) -> Column:
    return F.least(total, F.lit(LARGEST).cast("decimal(38,0)")).cast("long")


def encode(embeddings: DataFrame, rounds: int = ROUNDS, block: int = BLOCK) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error) of all kept rows, and the codebooks."""
    kept = kept_rows(embeddings)
    if kept.isEmpty():
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), [[] for _ in range(PARTS)]
    books = first_codebooks(kept)
    d = len(books[0][0])
    blocks = sorted_blocks(kept, PARTS * d, block)
    for _ in range(rounds):
        books = refined(blocks, books, d)
    place = F.expr(f"shiftleft(cast(entry as long), 8 * ({PARTS} - 1 - position))")
    codes = assigned(blocks, books, d).groupBy("row").agg(F.bit_or(place).alias("bits"), _long(F.sum(F.col("error").cast("decimal(28,0)"))).alias("error"))
    code = F.lower(F.lpad(F.hex("bits"), 2 * PARTS, "0"))
    return kept.select("row", "vec_id", "label").join(codes.select("row", code.alias("code"), "error"), "row").drop("row"), books


def books_digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()


def op11_hilbert_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = encode(read_table(spark, sf_dir, "embeddings"))
    rows = materialised(rows, "codes")
    errors = rows.groupBy(F.col("label").alias("of")).agg(_long(F.sum(F.col("error").cast("decimal(28,0)"))).alias("label_error"))
    out = rows.join(errors, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


_DISTANCE = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _sql() -> str:
    assign = lambda r: f"""a{r} AS MATERIALIZED (
  SELECT i, p, arg_min(k, d * {2 * ENTRIES} + k) AS k, min(d) AS d, any_value(v) AS v
  FROM (SELECT i, p, k, v, {_DISTANCE} AS d FROM parts JOIN b{r} USING (p)) GROUP BY i, p)"""  # noqa: E731
    update = lambda r: f"""b{r + 1} AS MATERIALIZED (
  SELECT p, k, coalesce(m, c) AS c FROM b{r} LEFT JOIN (
    SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS m FROM (
      SELECT p, k, j, CAST(sum(v[j]) AS BIGINT) AS s, count(*) AS n FROM a{r}, (SELECT unnest(generate_series(1, (SELECT max(len(v)) FROM parts))) AS j) GROUP BY p, k, j)
    GROUP BY p, k) USING (p, k))"""  # noqa: E731
    steps = ", ".join(f"{assign(r)}, {update(r)}" for r in range(ROUNDS))
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), parts AS MATERIALIZED (
  SELECT i, p, v[p * len(v) // 8 + 1 : (p + 1) * len(v) // 8] AS v FROM kept, (SELECT unnest(generate_series(0, 7)) AS p)
), b0 AS MATERIALIZED (SELECT p, i - 1 AS k, v AS c FROM parts WHERE i <= {ENTRIES}), {steps}, {assign(ROUNDS)},
codes AS (SELECT i, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY i),
said AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN codes USING (i), said
"""


QUERIES = {"op11_hilbert_blocks": op11_hilbert_blocks}
ORACLES = {"op11_hilbert_blocks": _sql()}
