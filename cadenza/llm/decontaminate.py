"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark texts.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z
folded.  A window is 13 consecutive words of a benchmark text; a text of fewer words, but not
none, is one window.  Every document is scanned once, whole, for all windows at a time; hits
are mapped back to words, and to offsets of the original text.

The automaton reads words as numbers: each word of the benchmark has one, written in digits of
base 64, two of them up to 4,096 words.  A window takes few nodes, and no node has more than 64
successors, among which the automaton searches one by one.  Digits of each rank are characters of
their own, so a match can't begin within a word; all other words of a document are digits that
no key has.

Windows are found by Spark, counted, and broadcast as an automaton.  Beyond `BLOCK_WINDOWS`
windows (or `BLOCK_BYTES` of them) they are dealt into blocks by hash; the documents are
written with the hits of each block and read again for the next, row by row, so no two rows are
ever matched up, memory stays bounded, and no window is dropped.

Defined cases: null or wordless documents have no words and no hits; null or wordless items
have no windows; an item without an id counts as one item and has no name in the digest;
repeated items are told apart by item_id; repeated documents each get their row; extra columns
of either table stay or are ignored, and the caller names the new column.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import free_name, materialised, normalised_words, read_table

#: Words in a window.
WINDOW = 13
#: Windows in one automaton, and bytes of them, at the most: some 150 MB.
BLOCK_WINDOWS, BLOCK_BYTES = 80_000, 64_000_000
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Digits of a word's number, and the digit of all words that the benchmark doesn't have.
_BASE, _OTHER = 64, "\0"


def words_of(text: str | None) -> list[bytes]:
    """Normalised words; whatever is no ASCII blank, also beyond ASCII, stays in its word."""
    words = normalised_words(text)
    return words.split(b" ") if words else []


def windows_of(text: str | None, window: int = WINDOW) -> set[bytes]:
    words = words_of(text)
    return {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))} if words else set()


class Windows:
    """Finds windows in sequences of words.  The value of a window is (its words, its items)."""

    def __init__(self, found: list[tuple[object, bytes]]):
        import ahocorasick

        of: dict[bytes, set] = {}
        for item, w in found:
            of.setdefault(w, set()).add(item)
        words = sorted({x for w in of for x in w.split(b" ")})
        self.digits = next(d for d in range(1, 12) if _BASE**d >= len(words))
        self.number = {x: self._written(i) for i, x in enumerate(words)}
        self.automaton = ahocorasick.Automaton()
        for w, items in of.items():
            split = w.split(b" ")
            self.automaton.add_word("".join(map(self.number.get, split)), (len(split), tuple(sorted(items, key=str))))
        if of:
            self.automaton.make_automaton()

    def _written(self, i: int) -> str:
        return "".join(chr(1 + _BASE * rank + i // _BASE**rank % _BASE) for rank in range(self.digits))

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
        """Number of words, merged runs of hit words (from, to), and items found."""
        words = words_of(text)
        if not words or not len(self.automaton):
            return len(words), [], set()
        digits = self.digits
        hits = list(self.automaton.iter("".join(map(self.number.get, words, repeat(_OTHER * digits)))))
        runs: list[list[int]] = []
        for a, b in sorted(((end + 1) // digits - n, (end + 1) // digits) for end, (n, _) in hits):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        return len(words), [(a, b) for a, b in runs], {i for _, (_, items) in hits for i in items}


def offsets_of(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as offsets of the original text, end exclusive."""
    spans = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    return [(spans[a][0], spans[b - 1][1]) for a, b in runs]


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, window): the distinct windows of each item."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item_id"), batch.column("text").to_pylist(), strict=True):
                found = sorted(windows_of(text, window))
                items = pa.array([item.as_py()] * len(found), item.type)
                yield pa.RecordBatch.from_arrays([items, pa.array(found, pa.binary())], names=["item_id", "window"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.select("item_id", "text").mapInArrow(emit, f"item_id {kind}, window binary").distinct()


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    out: str,
    window: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
    block_bytes: int = BLOCK_BYTES,
    text_col: str = "text",
) -> DataFrame:
    """Adds to the documents a column `out`, a name that they don't have: struct of n_words,
    runs of hit words, their spans in the text, and items with a window in the document."""
    windows = materialised(benchmark_windows(benchmark, window), "windows")
    n, size = windows.agg(F.count("*"), F.sum(F.octet_length("window"))).first()
    blocks = max(1, -(-n // block_windows), -(-(size or 0) // block_bytes))
    item_type = windows.schema["item_id"].dataType.simpleString()
    columns = docs.columns
    parts = []
    for b in range(blocks):
        some = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("window", "item_id"), F.lit(blocks)) == b)
        found = Windows([(r.item_id, bytes(r.window)) for r in some.toLocalIterator()])
        held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(found))
        del found
        part = free_name(docs, out if blocks == 1 else f"{out}_{b}")
        docs = docs.withColumn(part, _scanner(held, item_type)(F.col(text_col)))
        parts.append(part)
        if blocks > 1:
            docs = materialised(docs, "hits")
            held.destroy()
    if blocks == 1:
        return docs
    each = [F.col(p) for p in parts]
    union = lambda field: F.array_sort(F.array_distinct(F.concat(*(c[field] for c in each))))
    merged = F.struct(each[0]["n_words"].alias("n_words"), *(union(f).alias(f) for f in ("runs", "spans", "items")))
    return docs.select(*columns, merged.alias(out))


_HELD: dict = {}


def _scanner(held, item_type: str):
    key = uuid.uuid4().hex  # of this automaton in the workers, which keep one

    def scan_texts(texts: pd.Series) -> pd.DataFrame:
        if key not in _HELD:
            _HELD.clear()
            _HELD[key] = pickle.loads(held.value)
        found, rows = _HELD[key], []
        for t in texts:
            n, runs, items = found.scan(t)
            spans = offsets_of(t, runs) if runs else []
            pair = lambda xs: [{"from": a, "to": b} for a, b in xs]
            rows.append((n, pair(runs), pair(spans), sorted(items, key=str)))
        return pd.DataFrame(rows, columns=["n_words", "runs", "spans", "items"])

    scan_texts.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    kind = f"n_words long, runs array<struct<from:long,to:long>>, spans array<struct<from:long,to:long>>, items array<{item_type}>"
    return F.pandas_udf(scan_texts, kind)


def hit_words(runs):
    """Number of words in the union of the runs, which are sorted by their start."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def step(acc, r):
        start = F.greatest(r["from"], acc["end"])
        return F.struct(
            (acc["n"] + F.greatest(r["to"] - start, F.lit(0))).cast("long").alias("n"),
            F.greatest(acc["end"], r["to"]).cast("long").alias("end"),
        )

    return F.aggregate(runs, zero, step)["n"]


def is_contaminated(n_hit, n_words, share: int = SHARE):
    return (n_hit > 0) & (n_hit * share >= n_words)


def contamination_report(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark, "found", **limits)
    c = F.col("found")
    names = F.array_sort(F.array_compact(F.transform(c["items"], lambda x: x.cast("string"))))
    return found.select(
        "doc_id",
        c["n_words"].alias("n_words"),
        hit_words(c["runs"]).alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", is_contaminated(F.col("n_hit"), F.col("n_words")))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + 12), ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)
), places AS (
  SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS s
  FROM (
    SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p
    FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
  )
), hits AS (
  SELECT doc_id, p, n, item_id FROM places JOIN windows USING (n, s)
), hit_words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hits)) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLES = {"op3_decontaminate": SQL}
