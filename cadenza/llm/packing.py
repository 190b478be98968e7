"""Packing documents into training sequences by harmonic classes.

A document's ids are cut into pieces whose lengths are reciprocals of the capacity: with
capacity C, class j takes pieces of C // j ids, and a bin of class j is full with exactly j of
them.  A document gives whole sequences first, then from what is left the largest class that
fits, until at most C // `TAIL_CLASS` ids remain; those go as they are to the class
C // length, whose bins also take a fixed number of pieces.  Each task fills its classes on
its own, without an exchange, and keeps only open bins in memory.

Pieces of bins that a task could not fill are few (less than one sequence for each class and
task).  They are dealt to tasks again, laid one after the other and cut wherever a sequence is
full; the last sequence of such a task is cut into powers of two, which need no padding.

Defined cases: null texts are empty and have the end id only; a null or repeated doc_id keeps
its own pieces (rows are never merged); an empty table gives no rows; documents longer than the
capacity are cut; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import read_table, shared_folder
from cadenza.llm.tokens import document_ids, public_path

CAPACITY = 2048
#: Remainders that fit so many times into a sequence aren't cut any more.
TAIL_CLASS = 16
#: Ids of unfilled bins that one task lays out again, at the most.
LEFT_IDS = 4_000_000
STEP = 256
#: Sequences of a task have the numbers from its own `1 << TASK_BITS` on; those of the second
#: round begin at SECOND.
TASK_BITS = 36
SECOND = 1 << 62

SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
)
_NAMES = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
_TYPES = [pa.int64()] * 6 + [pa.binary()]


def cuts(length: int, capacity: int = CAPACITY, tail: int = TAIL_CLASS) -> list[tuple[int, int]]:
    """(class, length) of each piece of a document, in order."""
    out = [(1, capacity)] * (length // capacity)
    left = length % capacity
    while left:
        j = capacity // left  # the class that holds it as it is
        if j < tail and left != capacity // j:
            j += 1
            out.append((j, capacity // j))
            left -= capacity // j
        else:
            out.append((j, left))
            left = 0
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES
    )


def _filler(tokenizer: str, capacity: int):
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = TaskContext.get().partitionId() << TASK_BITS
        bins: dict[int, list[tuple]] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                piece = batch.slice(i, STEP).to_pydict()
                rows: list[tuple] = []
                for doc, raw in zip(piece["doc_id"], document_ids(tokenizer, piece["text"]), strict=True):
                    total, at = len(raw) // 4, 0
                    for j, n in cuts(total, capacity):
                        held = bins.setdefault(j, [])
                        held.append((doc, at, n, total, raw[4 * at : 4 * (at + n)]))
                        at += n
                        if len(held) == j:
                            offset = 0
                            for d, a, m, t, ids in held:
                                rows.append((d, a, m, t, next_id, offset, ids))
                                offset += m
                            next_id += 1
                            held.clear()
                yield _batch(rows)
        yield _batch([(d, a, m, t, None, None, ids) for held in bins.values() for d, a, m, t, ids in held])

    return fill


def _layer(capacity: int):
    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces one after the other, cut where a sequence is full."""
        next_id, used, held = SECOND + (TaskContext.get().partitionId() << TASK_BITS), 0, []
        for batch in batches:
            rows: list[tuple] = []
            columns = [batch.column(n).to_pylist() for n in ("doc_id", "start", "length", "doc_tokens", "ids")]
            for doc, start, length, total, ids in zip(*columns, strict=True):
                at = 0
                while at < length:
                    n = min(length - at, capacity - used)
                    held.append((doc, start + at, n, total, next_id, used, ids[4 * at : 4 * (at + n)]))
                    at, used = at + n, used + n
                    if used == capacity:
                        rows += held
                        next_id, used, held = next_id + 1, 0, []
            yield _batch(rows)
        yield _batch(list(_powers_of_two(held, used, next_id)))

    return lay


def _powers_of_two(pieces: list[tuple], used: int, next_id: int) -> Iterator[tuple]:
    """The last, unfilled sequence as several whose lengths are powers of two."""
    for bit in reversed(range(used.bit_length())):
        room, offset = used & (1 << bit), 0
        while room:
            doc, start, n, total, _, _, ids = pieces.pop(0)
            m = min(n, room)
            yield doc, start, m, total, next_id, offset, ids[: 4 * m]
            if m < n:
                pieces.insert(0, (doc, start + m, n - m, total, 0, 0, ids[4 * m :]))
            room, offset = room - m, offset + m
        next_id += bool(offset)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of docs (doc_id, text): doc_id, start, length, doc_tokens, sequence_id, offset,
    and their ids as little-endian unsigned 32-bit integers.

    Both rounds are written to the shared folder, so texts are tokenised once and numbers of
    sequences stay the same whoever reads them."""
    spark = docs.sparkSession
    first, second = shared_folder(spark, "packed"), shared_folder(spark, "packed-left")
    filled = docs.select("doc_id", "text").mapInArrow(_filler(tokenizer, capacity), SCHEMA)
    filled.write.option("compression", "zstd").parquet(first)
    filled = spark.read.schema(SCHEMA).parquet(first)
    left = filled.where(F.col("sequence_id").isNull())
    tasks = -(-(left.agg(F.sum("length")).first()[0] or 0) // LEFT_IDS) or 1
    dealt = left.repartition(tasks, F.xxhash64("doc_id", "start", "ids")).sortWithinPartitions("doc_id", "start")
    dealt.mapInArrow(_layer(capacity), SCHEMA).write.option("compression", "zstd").parquet(second)
    return filled.where(F.col("sequence_id").isNotNull()).unionByName(spark.read.schema(SCHEMA).parquet(second))


def packed_digests(packed: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids in place of them."""
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op10_harmonic_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return packed_digests(pack(docs, public_path("byte_bpe_50k.json")))


QUERIES = {"op10_harmonic_pack": op10_harmonic_pack}
ORACLES: dict[str, str] = {}
