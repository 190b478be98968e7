"""Token ids as Re-Pair grammars: a file format with random access.

A block holds the ids of consecutive documents.  Frequent pairs of neighbouring ids are
replaced by nonterminals, again and again, until no pair is frequent; the block stores the
rules, the expansion length of each, the remaining sequence, and the documents' ids and
lengths.  Any range of ids can be decoded without the rest: cumulated expansion lengths say
which symbols cover it.

Pairs are replaced in rounds, where each is more frequent than the pairs it overlaps: in a round
go all pairs that no more frequent one overlaps anywhere, the most frequent first of all, and
others as long as their uses in the round are frequent by exact count.  Counts are kept, not
taken anew: a round takes off the pairs around its replacements and counts the new ones there.

Files are written by Spark in Parquet with one row a block (`part`, `block`, `part_start`,
`n_ids`, `n_docs`, `blob`), in ascending order of the documents; `part` ascends with doc_id.
The blob's layout, all little-endian: magic, then seven unsigned 64-bit counts, then arrays.

Defined cases: a null text is the empty text and has the end id only; a null doc_id comes
first; documents with the same id are neighbours, by text hash; an empty table gives no rows; a document longer than a block makes a block of its
own; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import empty_text, read_table, shared_folder
from cadenza.llm.tokens import document_ids, public_path

MAGIC = b"RPG1"
#: Ids after which a block is closed.
BLOCK_IDS = 1 << 20
#: A pair is frequent if it is found so many times in a block.
LEAST_COUNT = 64
#: Entries of the largest table by which pairs are looked up; larger sets are searched.
TABLE = 1 << 22
#: Documents tokenised at a time, at the most.
STEP = 2048


def _frequent(seq: np.ndarray, places: np.ndarray | None, least: int) -> tuple[np.ndarray, ...]:
    """Of the pairs that begin at the ascending places (null: all): those found `least` times or
    more with their counts, and the places that hold one, with its number."""
    left, right = (seq[:-1], seq[1:]) if places is None else (seq[places], seq[places + 1])
    none = np.zeros(0, np.int64)
    if not len(left):
        return none.astype(np.uint64), none, none, none
    small = max(int(left.max()), int(right.max())) < 1 << 16  # then keys of 32 bits sort quicker
    keys = left.astype(np.uint32) << np.uint32(16) | right if small else left.astype(np.uint64) << np.uint64(32) | right
    ordered = np.sort(keys)
    edges = np.flatnonzero(np.concatenate((np.ones(1, bool), ordered[1:] != ordered[:-1])))
    counts = np.diff(np.append(edges, len(keys)))
    often = counts >= least
    pairs, counts = ordered[edges[often]], counts[often]
    if small:
        pairs = (pairs >> np.uint32(16)).astype(np.uint64) << np.uint64(32) | (pairs & np.uint32(0xFFFF))
    if not len(pairs):
        return pairs, counts, none, none
    high, low = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # Symbols get numbers among the pairs' left and right ones; a table of both says which pair.
    row, column = np.zeros(int(left.max()) + 1, np.int32), np.zeros(int(right.max()) + 1, np.int32)
    lefts, rights = np.unique(high), np.unique(low)
    row[lefts], column[rights] = np.arange(1, len(lefts) + 1), np.arange(1, len(rights) + 1)
    maybe = np.flatnonzero((row[left] > 0) & (column[right] > 0))
    if len(lefts) * len(rights) <= TABLE:
        table = np.full((len(lefts) + 1, len(rights) + 1), -1, np.int32)
        table[row[high], column[low]] = np.arange(len(pairs))
        found = table[row[left[maybe]], column[right[maybe]]].astype(np.int64)
        hit = found >= 0
    else:
        asked = left[maybe].astype(np.uint64) << np.uint64(32) | right[maybe]
        found = np.searchsorted(pairs, asked)
        hit = pairs[np.minimum(found, len(pairs) - 1)] == asked
    at = maybe[hit]
    return pairs, counts, at if places is None else places[at], found[hit]


def compress(ids: np.ndarray, first_rule: int, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (pairs of symbols, the i-th made by symbol first_rule + i), their expansion
    lengths, and the remaining sequence, in which no pair is found `least` times."""
    seq, rules, lengths = ids.astype(np.uint16 if first_rule < 1 << 16 else np.uint32), [], [1] * first_rule
    pairs, counts, at, which = _frequent(seq, None, least)
    while True:
        live = counts[which] >= least
        at, which = at[live], which[live]
        if not len(at):
            break
        # Of overlapping places the more frequent pair's counts; ties go to the larger pair.
        rank = np.empty(len(pairs), np.int64)
        rank[np.lexsort((pairs, counts))] = np.arange(len(pairs))
        mine, near = rank[which], at[1:] == at[:-1] + 1
        before = np.concatenate(([-1], np.where(near, mine[:-1], -1)))
        after = np.concatenate((np.where(near, mine[1:], -1), [-1]))
        # A pair that overlaps itself is taken at every other place of a run.
        place = np.arange(len(at))
        run = np.maximum.accumulate(np.where(mine == before, 0, place))
        free = (mine >= before) & (mine >= after)
        take = free & ((place - run) % 2 == 0)
        uses = np.bincount(which[take], minlength=len(pairs))
        good = (uses >= least) | ((uses > 0) & (np.bincount(which[~free], minlength=len(pairs)) == 0))
        take &= good[which]
        gone = take.copy()
        gone[:-1] |= take[1:] & near
        gone[1:] |= take[:-1] & near
        counts -= np.bincount(which[gone], minlength=len(pairs))
        spot, number = at[take], (np.cumsum(good) - 1)[which[take]]
        if first_rule + len(rules) + int(good.sum()) > 1 << 16 and seq.itemsize < 4:
            seq = seq.astype(np.uint32)
        seq[spot] = first_rule + len(rules) + number
        keep = np.ones(len(seq), bool)
        keep[spot + 1] = False
        seq = seq[keep]
        for p in pairs[good].tolist():
            a, b = p >> 32, p & 0xFFFFFFFF
            rules.append((a, b))
            lengths.append(lengths[a] + lengths[b])
        # Every replacement before a place moves it by one.
        rest = at[~gone]
        rest = rest - (np.searchsorted(spot, rest) if len(rest) < len(keep) // 16 else np.cumsum(~keep)[rest])
        spot = spot - np.arange(len(spot))
        new = np.zeros(len(seq), bool)
        new[spot] = new[np.maximum(spot - 1, 0)] = True
        more, more_counts, new_at, new_which = _frequent(seq, np.flatnonzero(new[:-1]), least)
        at = np.concatenate((rest, new_at))
        which = np.concatenate((which[~gone], new_which + len(pairs)))
        order = np.argsort(at, kind="stable")
        at, which = at[order], which[order]
        pairs, counts = np.concatenate((pairs, more)), np.concatenate((counts, more_counts))
    kind = "<u4" if first_rule + len(rules) > 1 << 16 else "<u2"
    return np.array(rules, kind).reshape(-1, 2), np.array(lengths[first_rule:], "<u4"), seq.astype(kind)


def encode_block(doc_ids: list[int | None], docs: list[np.ndarray], vocabulary: int) -> bytes:
    """One block's blob.  Ids have to be below `vocabulary`."""
    ids = np.concatenate(docs)
    if len(ids) and int(ids.max()) >= vocabulary:
        raise ValueError(f"ids have to be below {vocabulary}")
    rules, lengths, seq = compress(ids, vocabulary)
    null = np.array([d is None for d in doc_ids], "u1")
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    sizes = np.array([len(d) for d in docs], "<u4")
    head = np.array([vocabulary, len(rules), len(seq), len(docs), len(ids), seq.itemsize, 0], "<u8")
    return b"".join([MAGIC, *(x.tobytes() for x in (head, names, sizes, null, rules, lengths, seq))])


class Block:
    """Reads a blob; nothing is expanded until it is asked for."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a block of ids")
        self.first_rule, n_rules, n_seq, n_docs, self.n_ids, width, _ = np.frombuffer(blob, "<u8", 7, 4).tolist()
        at = 4 + 7 * 8

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        names, self.sizes, null = take("<i8", n_docs), take("<u4", n_docs), take("u1", n_docs)
        self.doc_ids = [None if x else d for d, x in zip(names.tolist(), null.tolist(), strict=True)]
        self.rules, self.lengths = take(f"<u{width}", 2 * n_rules).reshape(-1, 2), take("<u4", n_rules)
        self.seq = take(f"<u{width}", n_seq)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes, dtype=np.int64)))
        self._all = np.concatenate((np.ones(self.first_rule, np.int64), self.lengths.astype(np.int64)))
        self._ends = self._flat = None

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        if self._flat is None:  # all symbols' expansions, one after the other
            known = list(np.arange(self.first_rule, dtype=np.uint32)[:, None])
            for a, b in self.rules.tolist():
                known.append(np.concatenate((known[a], known[b])))
            self._flat, self._from = np.concatenate(known), np.cumsum(self._all) - self._all
        size = self._all[seq]
        shift = np.repeat(self._from[seq] - (np.cumsum(size) - size), size)
        return self._flat[shift + np.arange(len(shift))]

    def range(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop; only symbols that cover them are expanded."""
        if self._ends is None:
            self._ends = np.cumsum(self._all[self.seq])
        start, stop = max(0, start), min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(self._ends, [start, stop - 1], side="right")
        before = int(self._ends[a - 1]) if a else 0
        return self._expand(self.seq[a : b + 1])[start - before : stop - before]

    def document(self, k: int) -> np.ndarray:
        return self.range(int(self.starts[k]), int(self.starts[k + 1]))

    def ids(self) -> np.ndarray:
        return self._expand(self.seq)


FILE_SCHEMA = "part long, block long, part_start long, n_ids long, n_docs long, blob binary"


def _packer(tokenizer: str, vocabulary: int, block_ids: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start = TaskContext.get().partitionId(), 0, 0
        names: list = []
        docs: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, start, held
            row = [part, block, start, held, len(docs), encode_block(names, docs, vocabulary)]
            block, start, held = block + 1, start + held, 0
            names.clear()
            docs.clear()
            kinds = [pa.int64()] * 5 + [pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array([x], k) for x, k in zip(row, kinds, strict=True)],
                names=["part", "block", "part_start", "n_ids", "n_docs", "blob"],
            )

        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                piece = batch.slice(i, STEP).to_pydict()
                for d, ids in zip(piece["doc_id"], document_ids(tokenizer, piece["text"]), strict=True):
                    names.append(d)
                    docs.append(np.frombuffer(ids, "<u4"))
                    held += len(docs[-1])
                    if held >= block_ids:
                        yield flush()
        if docs:
            yield flush()

    return pack


def write_ids(docs: DataFrame, path: str, tokenizer: str, block_ids: int = BLOCK_IDS) -> None:
    """Tokenises docs (doc_id, text) and writes their ids in ascending order of doc_id.

    The texts are exchanged once, by ranges of (doc_id, hash of the text), so that no key is
    too large for one task, and tokenised after it, so that it is done once."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size()
    tie = F.xxhash64(empty_text("text"))
    ordered = (
        docs.select("doc_id", "text", tie.alias("_tie"))
        .repartitionByRange("doc_id", "_tie")
        .sortWithinPartitions("doc_id", "_tie")
        .select("doc_id", "text")
    )
    ordered.mapInArrow(_packer(tokenizer, vocabulary, block_ids), FILE_SCHEMA).write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a written folder with `start`, the ids of all documents before the block.

    One number for each part is gathered, as many as there were tasks; not one for a document."""
    blocks = spark.read.schema(FILE_SCHEMA).parquet(path)
    parts = {r.part: r.n for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    base, rows = 0, []
    for part in sorted(parts):
        rows.append((part, base))
        base += parts[part]
    bases = spark.createDataFrame(rows, "part long, base long")
    return blocks.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("part_start"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, blob in zip(batch["start"].to_pylist(), batch["blob"], strict=True):
            b = Block(blob.as_buffer().to_pybytes())
            raw = b.ids().astype("<u4").tobytes()
            at = b.starts.tolist()
            crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(b.doc_ids, pa.int64()),
                    pa.array(b.starts[:-1] + start, pa.int64()),
                    pa.array(b.sizes, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, decoded from the files: doc_id, start, n_tokens, ids_crc32."""
    return read_blocks(spark, path).select("start", "blob").mapInArrow(
        _digests, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def op4_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "ids")
    write_ids(read_table(spark, sf_dir, "documents"), path, public_path("word_bpe_49k.json"))
    return read_digests(spark, path)


QUERIES = {"op4_repair_ids": op4_repair_ids}
ORACLES: dict[str, str] = {}
