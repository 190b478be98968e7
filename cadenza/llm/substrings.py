"""Removing repeated passages: every byte covered by a 200-byte string that starts elsewhere too.

The strings of a corpus can't all be sorted or even exchanged.  Anchors stand for them: of the
`GRAM`-byte q-grams in a string the one of least hash, the leftmost in a tie.  Equal strings
have equal anchors at equal places, neighbouring strings mostly share one, so some one in
seventy positions is an anchor.  The strings that an anchor stands for are its context.

1. Tasks find anchors.  Those whose q-gram and context occur again in the task are repeated
   and done.  Of each q-gram one anchor is exchanged, so a q-gram has no more rows than there
   are tasks, however often it occurs; whatever shares q-gram and context is repeated, whatever
   shares the q-gram alone is open.
2. Contexts of open anchors, one for each kind, are fetched and compared within their q-gram's
   bucket by bucket-pointer refinement: positions start in buckets of their first 8 bytes and
   are refined by the bucket numbers of later offsets, to 24, 72 and 200 bytes, each time
   reusing the numbers of the step before; positions that still share a bucket are repeated.
   Q-grams with more than `GROUP` kinds of context aren't put in one task: there the open
   strings themselves are counted by their hash.
3. Spans come to their documents, once, and are removed.

Equality is of bytes in step 2.  In step 1 it is of two 64-bit hashes, of the q-gram and of the
whole context, which are different polynomials over powers of one factor; for the large buckets
it is of a 128-bit digest of the string.  Strings never cross documents.

Defined cases: null text is empty; texts under 200 bytes keep all; a text that occurs twice
is removed whole in all its copies; if doc_ids repeat or are null, rows are told apart by
id and text; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import empty_text, materialised, mixed, powers, read_table

LENGTH = 200
GRAM = 64
#: Anchors that a task compares among themselves at a time.
CHUNK = 2_000_000
#: Positions of a long text looked at in one go.
SEGMENT = 1 << 20
#: Kinds of context of one q-gram that are compared in one task, at the most.
GROUP = 2048
#: Bytes of contexts that are refined together.
REFINE_BYTES = 1 << 20

_W = LENGTH - GRAM + 1  # q-grams in a string
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)

LONE, COVERED, OPEN, WITNESS = 0, 1, 2, 3
ROWS = "gram long, context long, doc long, place long, kind int"
_ROW_NAMES = ["gram", "context", "doc", "place", "kind"]


def pack_place(low, high, anchor):
    """First and last start of the strings of an anchor, and the anchor, in 64 bits."""
    return low << 16 | (high - low) << 8 | (anchor - low)


def unpack_place(place):
    low = place >> 16
    return low, low + (place >> 8 & 0xFF), low + (place & 0xFF)


def anchors(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q-gram, context, place) of each anchor of the bytes."""
    out = [_segment(codes[s : s + SEGMENT + LENGTH - 1], s) for s in range(0, max(0, len(codes) - LENGTH + 1), SEGMENT)]
    if not out:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _segment(codes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(codes)
    p, back = powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * p[:n], out=sums[1:])
        gram = mixed((sums[GRAM:] - sums[:-GRAM]) * back[: n - GRAM + 1])
    count = len(gram)
    padded = np.full(-(-count // _W) * _W, np.uint64(2**64 - 1))
    padded[:count] = gram
    # Least q-gram of each string from two halves: to the end of its block, and from the start
    # of the next; the low byte says where, so that the leftmost wins a tie.
    keyed = (padded.reshape(-1, _W) & ~np.uint64(0xFF)) | np.arange(_W, dtype=np.uint64)
    right = np.minimum.accumulate(keyed[:, ::-1], axis=1)[:, ::-1].ravel()
    left = np.minimum.accumulate(keyed, axis=1).ravel()
    start = np.arange(count - _W + 1)
    end = start + _W - 1
    a, b = right[start], left[end]
    first = (a >> np.uint64(8)) <= (b >> np.uint64(8))
    where = np.where(first, start - start % _W + (a & np.uint64(0xFF)).astype(np.int64), end - end % _W + (b & np.uint64(0xFF)).astype(np.int64))
    edge = np.flatnonzero(where[1:] != where[:-1])
    low, high = np.append(0, edge + 1), np.append(edge, len(where) - 1)
    at = where[low]
    with np.errstate(over="ignore"):
        # Another hash of the whole context, from the bytes' squares.
        squares = np.zeros(n + 1, np.uint64)
        wide = codes.astype(np.uint64) + np.uint64(7)
        np.cumsum(wide * wide * wide * _OTHER * p[:n], out=squares[1:])
        context = mixed((squares[high + LENGTH] - squares[low]) * back[low] ^ mixed((at - low).astype(np.uint64) << np.uint64(32) | (high - low).astype(np.uint64)))
    return gram[at], context, pack_place(low + base, high + base, at + base)


def _batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=_ROW_NAMES)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new value of the sorted keys begins."""
    n = len(keys[0])
    out = np.zeros(n, bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _local(gram: np.ndarray, context: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """What one task knows: repeated anchors, open ones, and one anchor of each q-gram to ask for."""
    order = np.lexsort((context, gram))
    gram, context, doc, place = (x[order] for x in (gram, context, doc, place))
    new_gram, new_kind = _runs(gram), _runs(gram, context)
    kind_of = np.cumsum(new_kind) - 1
    repeated = np.bincount(kind_of)[kind_of] > 1
    gram_of = np.cumsum(new_gram) - 1
    several = np.bincount(gram_of[new_kind])[gram_of] > 1
    open_ = new_kind & several
    rows = np.concatenate((np.flatnonzero(new_gram), np.flatnonzero(repeated), np.flatnonzero(open_)))
    kind = np.concatenate(
        (
            # A lone row whose kind is OPEN << 4 says that its task has other contexts.
            np.where(several, OPEN << 4, LONE)[new_gram],
            np.full(repeated.sum(), COVERED),
            np.where(repeated, WITNESS, OPEN)[open_],
        )
    )
    return _batch([gram[rows].view(np.int64), context[rows].view(np.int64), doc[rows], place[rows], kind])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text"), strict=True):
            codes = np.frombuffer(text.as_buffer(), np.uint8) if len(text.as_py()) else np.zeros(0, np.uint8)
            if len(codes) < LENGTH:
                continue
            gram, context, place = anchors(codes)
            held.append((gram, context, np.full(len(gram), doc), place))
            size += len(gram)
            if size >= CHUNK:
                yield _local(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0
    if held:
        yield _local(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of the same q-gram from several tasks.  Rows come sorted by q-gram and context;
    what other tasks need not know passes through."""
    held: list[np.ndarray] | None = None

    def settle(c: list[np.ndarray]) -> pa.RecordBatch:
        gram, context, doc, place, kind = c
        new_gram, new_kind = _runs(gram), _runs(gram, context)
        gram_of, kind_of = np.cumsum(new_gram) - 1, np.cumsum(new_kind) - 1
        tasks = np.bincount(gram_of)[gram_of]
        same = np.bincount(kind_of)[kind_of] > 1
        differ = (np.bincount(gram_of[new_kind])[gram_of] > 1) | (np.bincount(gram_of, kind == OPEN << 4)[gram_of] > 0)
        # An open q-gram's anchors are compared by context; of equal ones each is covered.
        # A row of a task with other contexts is among that task's open ones already.
        open_ = differ & (tasks > 1) & (kind != OPEN << 4)
        cover = same
        rows = np.concatenate((np.flatnonzero(cover), np.flatnonzero(open_)))
        kinds = np.concatenate((np.full(cover.sum(), COVERED), np.where(same, WITNESS, OPEN)[open_]))
        return _batch([gram[rows], context[rows], doc[rows], place[rows], kinds])

    for batch in batches:
        c = [batch.column(n).to_numpy() for n in _ROW_NAMES]
        ask = (c[4] == LONE) | (c[4] == OPEN << 4)
        if not ask.all():
            yield _batch([x[~ask] for x in c])
            c = [x[ask] for x in c]
        if not len(c[0]):
            continue
        if held is not None:
            c = [np.concatenate(x) for x in zip(held, c, strict=True)]
        last = np.searchsorted(c[0], c[0][-1])  # the last q-gram may go on in the next batch
        held = [x[last:] for x in c]
        if last:
            yield settle([x[:last] for x in c])
    if held is not None:
        yield settle(held)


def refine(codes: np.ndarray) -> np.ndarray:
    """Numbers of the buckets of all 200-byte strings of the bytes, equal for equal strings."""
    n = len(codes) - LENGTH + 1
    first = np.lib.stride_tricks.sliding_window_view(codes, 8).copy().view("<u8").ravel()
    _, bucket = np.unique(first, return_inverse=True)
    for step, reach in ((8, 24), (24, 72), (64, LENGTH)):
        m = len(codes) - reach + 1
        key = bucket[:m].astype(np.uint64) << np.uint64(42) | bucket[step : step + m].astype(np.uint64) << np.uint64(21) | bucket[2 * step : 2 * step + m].astype(np.uint64)
        _, bucket = np.unique(key, return_inverse=True)
    return bucket[:n]


def _spans(starts: np.ndarray) -> list[tuple[int, int]]:
    """Ascending starts of repeated strings as spans of bytes, joined where starts follow each other."""
    cut = np.flatnonzero(np.diff(starts) > 1)
    low, high = np.append(starts[:1], starts[cut + 1]), np.append(starts[cut], starts[-1:])
    return list(zip(low.tolist(), (high + LENGTH).tolist(), strict=True))


_SPAN_SCHEMA = pa.schema([("doc", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of open anchors whose strings others of their q-gram have, too.  Rows come sorted
    by q-gram."""
    rows: list[tuple] = []
    size = 0

    def settle(some: list[tuple]) -> pa.RecordBatch:
        codes = np.frombuffer(b"".join(r[3] for r in some), np.uint8)
        bounds = np.cumsum([0] + [len(r[3]) for r in some])
        valid = np.concatenate([np.arange(a, b - LENGTH + 1) for a, b in zip(bounds, bounds[1:], strict=False)])
        bucket = refine(codes)[valid]
        again = np.bincount(bucket)[bucket] > 1
        out, at = [], 0
        for (gram, doc, place, context, kind), a, b in zip(some, bounds, bounds[1:], strict=False):
            k = b - a - LENGTH + 1
            hit = np.flatnonzero(again[at : at + k])
            at += k
            if kind == OPEN and len(hit):
                out += [(doc, x, y) for x, y in _spans(hit + (place >> 16))]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], schema=_SPAN_SCHEMA)

    for batch in batches:
        cols = [batch.column(n).to_pylist() for n in ("gram", "doc", "place", "bytes", "kind")]
        for r in zip(*cols, strict=True):
            if size >= REFINE_BYTES and r[0] != rows[-1][0]:
                yield settle(rows)
                rows, size = [], 0
            rows.append(r)
            size += len(r[3])
    if rows:
        yield settle(rows)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of open anchors' contexts, from their document."""
    names, kinds = ["gram", "doc", "place", "bytes", "kind", "large"], [pa.int64()] * 3 + [pa.binary(), pa.int32(), pa.bool_()]
    for batch in batches:
        for doc, text, opens in zip(batch.column("doc").to_pylist(), batch.column("text"), batch.column("opens").to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes()
            rows = []
            for o in opens:
                low, high, _ = unpack_place(o["place"])
                rows.append((o["gram"], doc, o["place"], raw[low : high + LENGTH], o["kind"], o["large"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each string of a context by two hashes, for q-grams with very many contexts."""
    for batch in batches:
        for doc, place, raw, kind in zip(*(batch.column(n).to_pylist() for n in ("doc", "place", "bytes", "kind")), strict=True):
            digests = [hashlib.blake2b(raw[i : i + LENGTH], digest_size=16).digest() for i in range(len(raw) - LENGTH + 1)]
            n = len(digests)
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), pa.array([doc] * n, pa.int64()), pa.array(range(place >> 16, (place >> 16) + n), pa.int64()), pa.array([kind] * n, pa.int32())],
                names=["string", "doc", "low", "kind"],
            )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, low, high): spans of bytes of docs (doc, text) that repeated strings cover; they
    may overlap or touch."""
    to = F.when(F.col("kind").isin(LONE, OPEN << 4), F.col("gram")).otherwise(F.xxhash64("doc", "place"))
    found = docs.mapInArrow(_find, ROWS).repartition(to).sortWithinPartitions("gram", "context")
    found = materialised(found.mapInArrow(_meet, ROWS), "anchors")
    low = F.shiftright("place", 16)
    covered = lambda df: df.select("doc", low.alias("low"), (low + F.shiftright("place", 8).bitwiseAND(0xFF) + LENGTH).alias("high"))
    spans = covered(found.where(F.col("kind") == COVERED))
    # One anchor of each kind of context; kinds that came from several tasks are repeated.
    open_ = found.where(F.col("kind") >= OPEN)
    kinds = open_.groupBy("gram", "context").agg(
        F.count("*").alias("n"), F.max("kind").alias("kind"), F.min(F.struct("doc", "place")).alias("first")
    )
    kinds = kinds.withColumn("kind", F.when(F.col("n") > 1, WITNESS).otherwise(F.col("kind")))
    kinds = materialised(kinds, "kinds")
    several = kinds.where("n > 1").select("gram", "context")
    spans = spans.unionByName(covered(open_.join(several, ["gram", "context"], "left_semi")))
    grams = kinds.groupBy("gram").agg(F.count("*").alias("size"), F.count_if(F.col("kind") == OPEN).alias("open"))
    asked = kinds.join(grams.where("size > 1 and open > 0"), "gram")
    asked = asked.select("first.doc", F.struct("gram", "first.place", "kind", (F.col("size") > GROUP).alias("large")).alias("o"))
    asked = asked.groupBy("doc").agg(F.collect_list("o").alias("opens"))  # no more than the document's anchors
    kept = "gram long, doc long, place long, bytes binary, kind int, large boolean"
    contexts = materialised(docs.join(asked, "doc").select("doc", "text", "opens").mapInArrow(_contexts, kept), "contexts")
    small = contexts.where("not large").repartition("gram").sortWithinPartitions("gram", "doc", "place")
    spans = spans.unionByName(small.select("gram", "doc", "place", "bytes", "kind").mapInArrow(_resolve, "doc long, low long, high long"))
    large = contexts.where("large")
    if not large.isEmpty():
        strings = large.select("doc", "place", "bytes", "kind").mapInArrow(_strings, "string binary, doc long, low long, kind int")
        again = strings.groupBy("string").agg(F.count("*").alias("n")).where("n > 1").select("string")
        hit = strings.where(F.col("kind") == OPEN).join(again, "string", "left_semi")
        spans = spans.unionByName(hit.select("doc", "low", (F.col("low") + LENGTH).alias("high")))
    return spans


REMOVED = "doc long, doc_id long, kept binary, n_bytes long, n_removed long, n_spans long"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["doc", "doc_id", "kept", "n_bytes", "n_removed", "n_spans"], [pa.int64(), pa.int64(), pa.binary()] + [pa.int64()] * 3
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            rows = []
            for doc, doc_id, text, spans in zip(*(part.column(n).to_pylist() for n in ("doc", "doc_id", "text", "spans")), strict=True):
                raw = text.encode("utf-8", "replace")
                out, last, cut, runs, open_until = [], 0, 0, 0, -1
                for s in sorted(spans or (), key=lambda s: (s["low"], s["high"])):
                    if s["low"] > open_until:
                        runs += 1
                        out.append(raw[last : s["low"]])
                        last = s["low"]
                        open_until = s["high"]
                    open_until = max(open_until, s["high"])
                    if open_until > last:
                        cut += open_until - last
                        last = open_until
                out.append(raw[last:])
                rows.append((doc, doc_id, b"".join(out), len(raw), cut, runs))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def remove_repeated(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, kept (the remaining bytes), n_bytes, n_removed, n_spans."""
    odd = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    key = F.col("doc_id") if odd.isEmpty() else F.xxhash64("doc_id", "text")
    keyed = docs.select(key.alias("doc"), "doc_id", empty_text("text").alias("text"))
    spans = repeated_spans(keyed.select("doc", "text"))
    spans = spans.groupBy("doc").agg(F.collect_set(F.struct("low", "high")).alias("spans"))  # of one document
    return keyed.join(spans, "doc", "left").select("doc", "doc_id", "text", "spans").mapInArrow(_remove, REMOVED).drop("doc")


def op9_bucket_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d WHERE len(h) >= 400)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM s) WHERE n > 1),
e AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g
  FROM (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 1 ELSE 0 END AS new FROM r)),
p AS (SELECT doc_id, g, min(i) AS low, max(i) + 200 AS high FROM e GROUP BY doc_id, g),
c AS (SELECT doc_id, sum(high - low) AS n_removed, count(*) AS n_spans, list({'low': low, 'high': high} ORDER BY low) AS spans FROM p GROUP BY doc_id),
k AS (SELECT d.doc_id, h, n_removed, n_spans,
  CASE WHEN spans IS NULL THEN h ELSE substr(h, 1, 2 * spans[1].low) || array_to_string([substr(h, 2 * spans[x].high + 1, 2 * (CASE WHEN x < len(spans) THEN spans[x + 1].low ELSE len(h) // 2 END - spans[x].high)) FOR x IN range(1, len(spans) + 1)], '') END AS kept
  FROM d LEFT JOIN c ON c.doc_id = d.doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM k
"""

QUERIES = {"op9_bucket_pointers": op9_bucket_pointers}
ORACLES = {"op9_bucket_pointers": SQL}
