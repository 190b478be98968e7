"""Ranked lexical search with hashed max-sketches.

Each item of a query set gets its documents of highest score, exactly.  The impact of a term in a
document is its weight times the saturated count; a document's score is the sum of its impacts
over the item's terms.

One scan of the texts writes a forward index: each document's number of terms, and its counts of
those terms that some item has.  Corpus statistics come from the whole index.  The search reads
it once: the impacts of a chunk of documents are folded by a hash of the term into `COORDINATES`
maxima a document, its sketch.  The sum of the sketch over an item's coordinates can't be below
the score, and a matrix product gives these bounds for all items and documents of the chunk.
Then each item takes documents in descending order of their bounds and computes exact scores,
until the next bound is below its k-th best score so far.  A task returns its k best for each
item, and Spark ranks those.

Items go in blocks of about `BLOCK_PAIRS` (item, term) pairs, each with a scan of its own; only a
block's pairs, whose number is counted first, come to the driver and go to the tasks.  Inside
a task a block's items are taken in groups of at most `GROUP_TERMS` terms, or one item.

Defined cases: null and termless documents have no score and count for nothing; repeated rows and
repeated doc_ids are documents of their own; a null doc_id comes after others of its score; items
without an id are one item, and rows of one item_id are one item with the terms of all; items
that no document matches have no row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import WORD_TABLE, materialised, read_table

BEST = 10
#: Coordinates of a sketch.
COORDINATES = 1024
#: Pairs of item and term in a block; terms of a group of items; impacts that a task holds at a time.
BLOCK_PAIRS, GROUP_TERMS, CHUNK = 250_000, 4096, 4_000_000
#: Documents of a chunk that an item rescores between looks at its threshold.
STEP = 32


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, A-Z folded, of UTF-8."""
    return text.translate(WORD_TABLE).split() if text else []


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(t))) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(at)), pa.array([t for f in found for t in f], pa.binary())], names=["item_id", "term"])

    return items.select("item_id", "text").mapInArrow(split, f"item_id {dict(items.dtypes)['item_id']}, term binary").distinct()


def forward_index(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n, terms, counts: number of terms, and which of the vocabulary occur how often (as
    little-endian unsigned 32-bit numbers, terms ascending)."""
    held = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = held.value
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                words = terms_of(text.as_py())
                found = Counter(words)
                known = sorted((number[t], found[t]) for t in (found.keys() & number.keys()))
                pairs = np.array(known, "<u4").reshape(-1, 2)
                sizes.append(len(words))
                terms.append(pairs[:, 0].tobytes())
                counts.append(pairs[:, 1].tobytes())
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "counts"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(index, f"doc_id {kind}, n long, terms binary, counts binary")


def document_frequencies(index: DataFrame, size: int) -> list[int]:
    """In how many documents each term of the vocabulary occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<u4"), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])

    out = [0] * size
    for r in index.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # one row a term of the block
        out[r.term] = r.df
    return out


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Group:
    """Some items, with their terms and the places where sketches hold them."""

    def __init__(self, items: dict[int, list[int]], coordinates: int):
        self.items = list(items)
        self.terms = np.array(sorted({t for ts in items.values() for t in ts}), np.int64)
        place = {t: i for i, t in enumerate(self.terms.tolist())}
        self.columns = [np.array([place[t] for t in ts]) for ts in items.values()]
        spread = (self.terms.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        at = (spread % np.uint64(coordinates)).astype(np.int64)
        self.order = np.argsort(at, kind="stable")
        held, self.cuts = np.unique(at[self.order], return_index=True)
        compact = np.searchsorted(held, at)  # coordinates that no term of the group has stay out
        self.lookups = np.zeros((len(held), len(self.items)))
        for q, columns in enumerate(self.columns):
            np.add.at(self.lookups[:, q], compact[columns], 1)

    def sketches(self, impacts: np.ndarray) -> np.ndarray:
        """Coordinatewise maxima of the impacts of each document (a row)."""
        return np.maximum.reduceat(impacts[:, self.order], self.cuts, axis=1)

    def bounds(self, impacts: np.ndarray) -> np.ndarray:
        """What the scores of documents (rows) for items (columns) can't exceed.  The product is one of
        whole numbers below 2**53, so doubles hold it exactly."""
        return self.sketches(impacts).astype(np.float64) @ self.lookups


def grouped(items: dict[int, list[int]], most: int, coordinates: int) -> list[Group]:
    out, now, terms = [], {}, set()
    for i, ts in items.items():
        if now and len(terms | set(ts)) > most:
            out.append(Group(now, coordinates))
            now, terms = {}, set()
        now[i] = ts
        terms |= set(ts)
    return [*out, Group(now, coordinates)] if now else out


class Best:
    """The k best documents of each item that a task has met."""

    def __init__(self, k: int):
        self.k, self.held, self.rescored = k, {}, 0

    def threshold(self, item: int) -> int:
        """A document of a lower score has no place."""
        held = self.held.get(item, ())
        return held[-1][0] if len(held) == self.k else 1

    def add(self, item: int, scores: list[int], docs: list) -> None:
        rows = [*self.held.get(item, ()), *zip(scores, docs, strict=True)]
        self.held[item] = sorted((r for r in rows if r[0] > 0), key=lambda r: (-r[0], r[1] is None, r[1] or 0))[: self.k]

    def search(self, group: Group, impacts: np.ndarray, docs: list) -> None:
        bounds = group.bounds(impacts)
        for q, item in enumerate(group.items):
            likely = np.flatnonzero(bounds[:, q] >= self.threshold(item))
            likely = likely[np.argsort(-bounds[likely, q], kind="stable")]
            for at in range(0, len(likely), STEP):
                if bounds[likely[at], q] < self.threshold(item):
                    break
                some = likely[at : at + STEP]
                scores = impacts[np.ix_(some, group.columns[q])].sum(1)
                self.rescored += len(some)
                hits = np.flatnonzero(scores >= self.threshold(item))
                if len(hits):
                    self.add(item, scores[hits].tolist(), [docs[i] for i in some[hits].tolist()])


def search_block(docs: DataFrame, pairs: list[tuple[int, bytes]], k: int, coordinates: int, group_terms: int) -> DataFrame:
    """(item, doc_id, score): at least the k best documents of each item of the block."""
    spark = docs.sparkSession
    vocabulary = sorted({t for _, t in pairs})
    index = materialised(forward_index(docs, vocabulary), "forward")
    n_docs, total = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.array([weight(n_docs, df) for df in document_frequencies(index, len(vocabulary))], np.int64)
    number, items = {t: i for i, t in enumerate(vocabulary)}, {}
    for item, t in sorted(pairs):
        items.setdefault(item, []).append(number[t])
    held = spark.sparkContext.broadcast((items, weights))
    kind = dict(docs.dtypes)["doc_id"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = held.value
        groups, best, id_type = grouped(items, group_terms, coordinates), Best(k), None
        place = [np.full(len(weights), -1, np.int64) for _ in groups]
        for g, p in zip(groups, place, strict=True):
            p[g.terms] = np.arange(len(g.terms))
        rows = max(1, CHUNK // max(len(g.terms) for g in groups))
        for batch in batches:
            id_type = batch.column("doc_id").type
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                docs = part.column("doc_id").to_pylist()
                raw = part.column("terms").to_pylist()
                row = np.repeat(np.arange(len(raw)), [len(b) // 4 for b in raw])
                terms = np.frombuffer(b"".join(raw), "<u4").astype(np.int64)
                tf = np.frombuffer(b"".join(part.column("counts").to_pylist()), "<u4").astype(np.int64)
                m = np.array([10 + 90 * n * n_docs // total if n else 1 for n in part.column("n").to_pylist()], np.int64)
                impact = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
                for g, p in zip(groups, place, strict=True):
                    column = p[terms]
                    mine = column >= 0
                    impacts = np.zeros((len(docs), len(g.terms)), np.int64)
                    impacts[row[mine], column[mine]] = impact[mine]
                    best.search(g, impacts, docs)
        found = [(item, doc, score) for item, rows in best.held.items() for score, doc in rows]
        if found:
            columns = [list(c) for c in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), id_type, pa.int64()), strict=True)], names=["item", "doc_id", "score"])

    return index.mapInArrow(search, f"item long, doc_id {kind}, score long")


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = BEST, coordinates: int = COORDINATES, block_pairs: int = BLOCK_PAIRS, group_terms: int = GROUP_TERMS
) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 for each item."""
    pairs = materialised(item_terms(items), "item-terms")
    blocks = max(1, -(-pairs.count() // block_pairs))
    out = None
    for b in range(blocks):
        some = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # about block_pairs, by the hash
        if not some:
            continue
        ids = list(dict.fromkeys(r.item_id for r in some))
        number = {i: n for n, i in enumerate(ids)}
        found = search_block(docs, [(number[r.item_id], bytes(r.term)) for r in some], k, coordinates, group_terms)
        names = docs.sparkSession.createDataFrame([(n, i) for i, n in number.items()], f"item long, item_id {dict(items.dtypes)['item_id']}")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ranked = ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        kinds = dict(docs.dtypes) | dict(items.dtypes)
        return docs.sparkSession.createDataFrame([], f"item_id {kinds['item_id']}, rank int, doc_id {kinds['doc_id']}, score long")
    return out


def op12_max_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
c AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
tf AS MATERIALIZED (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
df AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, c GROUP BY t, n_docs),
scores AS (
  SELECT item_id, r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(w) * n_docs) // total)))) AS BIGINT) AS score
  FROM q JOIN tf USING (t) JOIN df USING (t) JOIN d USING (r), c GROUP BY item_id, r
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scores JOIN d USING (r) WHERE score > 0)
WHERE rank <= {BEST}
"""

QUERIES = {"op12_max_sketches": op12_max_sketches}
ORACLES = {"op12_max_sketches": SQL}
