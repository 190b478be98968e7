"""Near-duplicate documents by order MinHash, verified by banded alignment.

A document's k-mers are its runs of `SHINGLE` words, each with the number of its occurrence.
A sketch takes the `PICKS` k-mers that are least under one hash and keeps them in the order of
the text; two documents meet if any of `SKETCHES` sketches is the same.  Sketches thus agree
where the same words come in the same order, as edit distance asks for.

Similarity of two documents: words are aligned by the shortest edit script, found diagonal by
diagonal within the band that the threshold leaves; windows of `SHINGLE` words that the
alignment matches whole, over all windows of both.  It is at most the Jaccard similarity of
the occurrence-labelled k-mers, which is computed first and rejects most.

1. Documents with the same words are one class of copies; only classes go on.
2. Within a bucket every class is compared with one hub: a star, not all pairs.  The hub is the
   class that meets the most others over all its buckets, which is the one with the fewest
   edits of its own.  Links join classes into components; then each bucket's best class of
   another component is the hub, and so on for `ROUNDS` rounds.
3. Buckets that still hold several components are the exception: there all classes of
   different components are compared, in blocks of bounded size, on signatures.  Classes with a
   partner near the threshold come again with their texts, and their pairs are verified where
   they meet, each in the first bucket that it shares; what leaves a task are links that join
   components, never pairs.  So no link between different texts is lost to the stars, and no
   bucket is capped.
4. A document's class id is the least doc_id of its component.

Words are as in `normalised_words`.  Defined cases: documents without words are copies only if
their texts are equal, null being empty; documents of fewer than `SHINGLE` words have no k-mers
and are copies only if their words are the same; rows are told apart by doc_id and content, so
different texts of one doc_id are judged each on its own; a null doc_id counts as the largest,
and its class id is null if all of the class are; repeated rows are copies; an empty table
gives none; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cadenza.llm.common import free_name, materialised, mixed, normalised_words, read_table, slice_hashes
from cadenza.operators.graph import connected_components

SHINGLE, SIMILARITY = 5, 0.8
SKETCHES, PICKS = 16, 3
ROUNDS = 2
#: Bins of a signature, which estimates the share of common k-mers, and the least estimate of a
#: pair that is looked at: six standard deviations below the threshold, so that of pairs at the
#: threshold one in a billion is lost.  0 turns the filter off.
BINS, LIKELY = 256, 0.65
#: Classes of a bucket that one task compares with as many others.
BLOCK = 512

_SEEDS = mixed(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(text: str | None) -> np.ndarray:
    words = normalised_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(words, np.uint8)
    gaps = np.flatnonzero(codes == 32)
    return slice_hashes(codes, np.append(0, gaps + 1), np.append(gaps, len(codes)))


def kmer_hashes(words: np.ndarray) -> np.ndarray:
    """Of each run of SHINGLE words, or of all words where there are fewer."""
    k = min(SHINGLE, len(words))
    if not k:
        return words
    n = len(words) - k + 1
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out = out * np.uint64(0x100000001B3) + words[i : i + n]
    return mixed(out)


def labelled(kmers: np.ndarray) -> np.ndarray:
    """K-mers made distinct by the number of their occurrence, in the order of the text."""
    order = np.argsort(kmers, kind="stable")
    s = kmers[order]
    first = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.zeros(0, bool)
    if first.all():
        return kmers
    at = np.arange(len(s))
    count = at - np.maximum.accumulate(np.where(first, at, 0))
    out = np.empty_like(kmers)
    with np.errstate(over="ignore"):
        out[order] = mixed(s + count.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return out


def sketches(kmers: np.ndarray) -> np.ndarray:
    """Order MinHash sketches of labelled k-mers."""
    out = np.empty(SKETCHES, np.uint64)
    take = min(PICKS, len(kmers))
    with np.errstate(over="ignore"):
        for i, seed in enumerate(_SEEDS):
            h = mixed(kmers ^ seed)
            at = np.sort(np.argpartition(h, take - 1)[:take])
            acc = seed
            for x in h[at]:
                acc = acc * np.uint64(0x9E3779B97F4A7C15) + x
            out[i] = acc
    return mixed(out)


def signature(kmers: np.ndarray) -> np.ndarray:
    """The least k-mer of each bin, in 16 bits; 0 for an empty bin."""
    s = np.sort(kmers)
    bins = (s >> np.uint64(56)).astype(np.int64)
    found, first = np.unique(bins, return_index=True)
    out = np.zeros(BINS, "<u2")
    out[found] = (mixed(s[first]) & np.uint64(0xFFFF)).astype("<u2") | 1
    return out


def _counts(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two multisets."""
    if not len(a) or not len(b):
        return 0.0
    both = np.sort(np.concatenate((labelled(a), labelled(b))))
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(a) + len(b) - common)


def matched_runs(a: list[int], b: list[int], limit: int) -> list[tuple[int, int, int]] | None:
    """Runs (in a, in b, length) that the shortest edit script matches, or null beyond the
    limit of insertions and deletions, which is also the band of diagonals that is looked at."""
    n, m = len(a), len(b)
    far = [0] * (2 * limit + 3)
    steps: list[list[int]] = []
    for d in range(limit + 1):
        for k in range(-d, d + 1, 2):
            if k < -m or k > n:
                continue
            at = limit + 1 + k
            x = far[at + 1] if k == -d or (k != d and far[at - 1] < far[at + 1]) else far[at - 1] + 1
            y = x - k
            if y < 0 or x > n or y > m:
                far[at] = x if x <= n else n
                continue
            while x < n and y < m and a[x] == b[y]:
                x += 1
                y += 1
            far[at] = x
            if x == n and y == m:
                steps.append(far[limit + 1 - d : limit + 2 + d])
                return _backwards(a, b, steps)
        steps.append(far[limit + 1 - d : limit + 2 + d])
    return None


def _backwards(a: list[int], b: list[int], steps: list[list[int]]) -> list[tuple[int, int, int]]:
    runs, x, y = [], len(a), len(b)
    for d in range(len(steps) - 1, -1, -1):
        k = x - y
        if d == 0:
            x0, y0 = 0, 0
            start = (0, 0)
        else:
            before = steps[d - 1]
            get = lambda q: before[q + d - 1] if -(d - 1) <= q <= d - 1 else -1  # noqa: E731, B023
            down = k == -d or (k != d and get(k - 1) < get(k + 1))
            q = k + 1 if down else k - 1
            x0 = get(q)
            y0 = x0 - q
            start = (x0, y0 + 1) if down else (x0 + 1, y0)
        if x > start[0]:
            runs.append((start[0], start[1], x - start[0]))
        x, y = x0, y0
    return runs[::-1]


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Of two sequences of word hashes; what is sure to be below `least` gives 0."""
    if len(a) == len(b) and (a == b).all():
        return 1.0
    if min(len(a), len(b)) < SHINGLE:
        return 0.0
    na, nb = len(a) - SHINGLE + 1, len(b) - SHINGLE + 1
    if min(na, nb) < least * max(na, nb) or _counts(kmer_hashes(a), kmer_hashes(b)) < least:
        return 0.0
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = min(int(differ[0]) if len(differ) else n, n - head)
    # Each inserted or deleted word is in a window that isn't common.
    limit = int((1 - least) * (na + nb)) + 2 * SHINGLE
    inner = matched_runs(a[head : len(a) - tail].tolist(), b[head : len(b) - tail].tolist(), limit)
    if inner is None:
        return 0.0
    runs = [(0, 0, head), *((x + head, y + head, z) for x, y, z in inner), (len(a) - tail, len(b) - tail, tail)]
    common, at = 0, None
    for x, y, z in runs:
        if at and at[0] == x and at[1] == y:
            at = (x + z, y + z, at[2] + z)
        else:
            common += max(0, at[2] - SHINGLE + 1) if at else 0
            at = (x + z, y + z, z)
    common += max(0, at[2] - SHINGLE + 1)
    return common / (na + nb - common)


def content_id(text: str | None, words: np.ndarray) -> bytes:
    raw = words.tobytes() if len(words) else b"\0" + (text or "").encode("utf-8", "replace")
    return hashlib.blake2b(raw, digest_size=16).digest()


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part, c, sk, sig = batch.slice(i, 512), [], [], []
            for t in part.column("text").to_pylist():
                words = word_hashes(t)
                c.append(content_id(t, words))
                kmers = labelled(kmer_hashes(words)) if len(words) >= SHINGLE else None
                sk.append(None if kmers is None else sketches(kmers).view(np.int64).tolist())
                sig.append(None if kmers is None else signature(kmers).tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(c, pa.binary()), pa.array(sk, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                names=["doc_id", "c", "sketches", "sig"],
            )


def _with_content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        c = [content_id(t, word_hashes(t)) for t in texts.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()), texts], names=["c", "text"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("a"), batch.column("b")
        keep = []
        last, words = None, None
        for x, s, t in zip(a, batch.column("text_a"), batch.column("text_b"), strict=True):
            if x.as_py() != last:  # neighbours often share a side
                last, words = x.as_py(), word_hashes(s.as_py())
            keep.append(similarity(words, word_hashes(t.as_py())) >= SIMILARITY)
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures let them be similar."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(n).to_pylist()), "<u2").reshape(-1, BINS) for n in ("sig_a", "sig_b"))
        used = ((x != 0) | (y != 0)).sum(1)
        mask = pa.array(((x == y) & (x != 0)).sum(1) >= LIKELY * used, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(n).filter(mask) for n in ("a", "b")], names=["a", "b"])


def _links(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shared: bool) -> DataFrame:
    """Those of the pairs (a, b) of classes that are similar.  Signatures sort out most of the
    others; then texts are read again for the classes concerned only, one for each."""
    for end in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("c").alias(end), F.col("sig").alias(f"sig_{end}")), end)
    near = pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(_near, "a binary, b binary")
    pairs = materialised(near, "pairs")
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct(), docs, nodes, shared)
    both = pairs.join(texts.select(F.col("c").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.join(texts.select(F.col("c").alias("a"), F.col("text").alias("text_a")), "a")
    return materialised(both.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a binary, b binary"), "links")


def _texts(concerned: DataFrame, docs: DataFrame, nodes: DataFrame, shared: bool) -> DataFrame:
    """(c, text) of the classes concerned, one text for each.  shared: a doc_id may stand for
    several classes, or a class have none; then texts are found by their content."""
    who = nodes.join(concerned, "c", "left_semi").select("c", F.col("rep").alias("doc_id"))
    if not shared:
        return materialised(docs.select("doc_id", "text").join(who, "doc_id").select("c", "text"), "texts")
    named = docs.join(who.select("doc_id").distinct(), "doc_id", "left_semi").select("text")
    maybe = named.unionByName(docs.where("doc_id is null").select("text"))
    found = maybe.mapInArrow(_with_content, "c binary, text string").join(who.select("c"), "c", "left_semi")
    return materialised(found.groupBy("c").agg(F.min("text").alias("text")), "texts")


def _joined(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(c, label) of all classes with a link, after more links between components."""
    if labels is None:
        return connected_components(links).select(F.col("node").alias("c"), F.col("component").alias("label"))
    for end in ("a", "b"):
        links = links.join(labels.select(F.col("c").alias(end), "label"), end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
    more = connected_components(links).select(F.col("node").alias("label"), "component")
    moved = labels.join(more, "label", "left").select("c", F.coalesce("component", "label").alias("label"))
    # Classes that had no link so far are their own component's name.
    new = more.join(labels.select(F.col("c").alias("label")), "label", "left_anti").select(F.col("label").alias("c"), F.col("component").alias("label"))
    return materialised(moved.unionByName(new), "labels")


def _star(scored: DataFrame, labels: DataFrame | None, rank: int) -> DataFrame:
    """Each bucket's hub with its classes of other components.  The hub is the best class of
    the component that is the rank-th in the bucket."""
    if labels is None:
        hubs = scored.groupBy("bucket").agg(F.max_by("c", F.struct("score", "c")).alias("a"))
        return scored.join(hubs, "bucket").where("a <> c").select("a", F.col("c").alias("b")).distinct()
    of = _labelled(scored, labels)
    best = of.groupBy("bucket", "label").agg(F.max(F.struct("score", "c")).alias("s"))
    tops = best.groupBy("bucket").agg(F.count("*").alias("n"), F.max(F.struct("s", "label")).alias("first")).where("n > 1")
    second = best.join(tops.select("bucket", "first"), "bucket").where(F.col("label") != F.col("first.label"))
    for _ in range(rank - 2):  # further down, one component at a time
        again = second.groupBy("bucket").agg(F.max(F.struct("s", "label")).alias("next"))
        second = second.join(again, "bucket").where(F.col("label") != F.col("next.label")).drop("next")
    hubs = second.groupBy("bucket").agg(F.max(F.struct("s", "label")).alias("h"))
    hubs = hubs.select("bucket", F.col("h.s.c").alias("a"), F.col("h.label").alias("hub_label"))
    return of.join(hubs, "bucket").where("label <> hub_label").select("a", F.col("c").alias("b")).distinct()


def _labelled(scored: DataFrame, labels: DataFrame) -> DataFrame:
    return scored.join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))


def _shared_ids(described: DataFrame) -> bool:
    """Whether a doc_id may stand for several texts, or a text have none."""
    return not described.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple[int, int], list[tuple]]]:
    """The rows of each bucket and pair of blocks, two blocks at the most.  Rows come sorted."""
    rows: list[tuple] = []
    key = None
    for batch in batches:
        for r in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            new = (r[0], *r[1])
            if new != key:
                if len(rows) > 1:
                    yield key[1:], rows
                rows, key = [], new
            rows.append(r)
    if len(rows) > 1:
        yield key[1:], rows


_NAMES = ["bucket", "pair", "block", "c", "sig", "label"]


def _partners(pair: tuple[int, int], rows: list[tuple]) -> Iterator[tuple[int, np.ndarray]]:
    """(i, all j) of rows of different components whose signatures are near.  Within one block
    each pair comes once; of two blocks the first against the second."""
    sig = np.frombuffer(b"".join(r[4] for r in rows), "<u2").reshape(-1, BINS)
    block = np.array([r[2] for r in rows])
    _, label = np.unique([r[5] for r in rows], return_inverse=True)
    second = np.flatnonzero(block == pair[1])
    for i in range(len(rows)):
        if pair[0] == pair[1]:
            others = np.arange(i + 1, len(rows))
        elif block[i] == pair[0]:
            others = second
        else:
            continue
        others = others[label[others] != label[i]]
        if len(others):
            same = ((sig[others] == sig[i]) & (sig[i] != 0)).sum(1)
            used = ((sig[others] != 0) | (sig[i] != 0)).sum(1)
            yield i, others[same >= LIKELY * used]


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes with a near one of another component."""
    for pair, rows in _groups(batches, _NAMES):
        found = np.zeros(len(rows), bool)
        for i, others in _partners(pair, rows):
            found[others] = True
            found[i] |= len(others) > 0
        yield pa.RecordBatch.from_arrays([pa.array([rows[i][3] for i in np.flatnonzero(found)], pa.binary())], names=["c"])


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join components of a group, verified on the texts."""
    for pair, rows in _groups(batches, [*_NAMES, "slot", "sketches", "text"]):
        of: dict[bytes, bytes] = {r[5]: r[5] for r in rows}
        words: dict[int, np.ndarray] = {}
        sketch = np.array([r[7] for r in rows])
        links = []

        def root(x: bytes, of=of) -> bytes:
            while of[x] != x:
                of[x] = of[of[x]]
                x = of[x]
            return x

        for i, others in _partners(pair, rows):
            # Each pair in the first slot whose sketches agree; elsewhere it is another task's.
            first = (sketch[others] == sketch[i]).argmax(1) if len(others) else others
            for j in others[first == rows[i][6]].tolist():
                x, y = root(rows[i][5]), root(rows[j][5])
                if x != y:
                    for k in (i, j):
                        if k not in words:
                            words[k] = word_hashes(rows[k][8])
                    if similarity(words[i], words[j]) >= SIMILARITY:
                        of[x] = y
                        links.append((rows[i][3], rows[j][3]))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], names=["a", "b"])


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (bucket, c, ...) dealt into blocks of their bucket, each to all pairs of blocks that
    it is in; a bucket of up to BLOCK classes is one group."""
    n = rows.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(n, "bucket").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    each = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.array(F.least("block", o), F.greatest("block", o)))
    rows = rows.withColumn("pair", F.explode(F.array_distinct(each)))
    return rows.repartition("bucket", "pair").sortWithinPartitions("bucket", "pair", "c")


def _between_components(scored: DataFrame, labels: DataFrame, docs: DataFrame, nodes: DataFrame, shared: bool) -> DataFrame:
    """Links in the buckets that hold several components."""
    of = _labelled(scored.select("bucket", "slot", "c"), labels)
    several = of.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
    rows = of.join(several, "bucket").join(nodes.select("c", "sig", "sketches"), "c")
    flagged = _dealt(rows.select("bucket", "c", "sig", "label")).select(_NAMES).mapInArrow(_flag, "c binary")
    flagged = materialised(flagged.distinct(), "flagged")
    near = rows.join(_texts(flagged, docs, nodes, shared), "c")
    return materialised(_dealt(near).select(*_NAMES, "slot", "sketches", "text").mapInArrow(_link, "a binary, b binary"), "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, class_id, content (the class of copies), copies (in it), and
    group, a name of the class that no other has, be doc_ids null or repeated."""
    docs = docs.select("doc_id", "text")
    described = materialised(docs.mapInArrow(_describe, "doc_id long, c binary, sketches array<long>, sig binary"), "described")
    nodes = described.groupBy("c").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("sketches").alias("sketches"), F.min("sig").alias("sig")
    )
    nodes = materialised(nodes, "classes")
    shared_ids = _shared_ids(described)
    buckets = nodes.where("sketches is not null").select("c", F.posexplode("sketches").alias("slot", "bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialised(buckets.join(sizes, "bucket"), "buckets")  # only buckets of several classes
    score = shared.groupBy("c").agg(F.sum("n").alias("score"))
    scored = materialised(shared.select("bucket", "slot", "c").join(score, "c"), "scored")
    labels = None
    for rank in range(1, ROUNDS + 1):
        links = _links(_star(scored, labels, rank), docs, nodes, shared_ids)
        labels = _joined(links, labels)
    labels = _joined(_between_components(scored, labels, docs, nodes, shared_ids), labels)
    named = nodes.join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    least = named.groupBy("label").agg(F.min("rep").alias("class_id"))
    classes = named.join(least, "label").select("c", "class_id", "copies", "label")
    found = described.select("doc_id", "c").join(classes, "c")
    return found.select("doc_id", "class_id", F.hex("c").alias("content"), "copies", F.hex("label").alias("group"))


def _keyed(out: str):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            c = [content_id(t, word_hashes(t)).hex().upper() for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(c, pa.string())], names=[*batch.schema.names, out])

    return add


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with only one of each class, that of the least doc_id; all columns stay.
    Where a class has no doc_id, one of those with the least content stays; of rows with the
    same doc_id and words any one."""
    found = near_duplicates(docs)
    ids = docs.groupBy("doc_id").count()
    odd = materialised(ids.where("count > 1 or doc_id is null").select("doc_id"), "odd-ids")  # usually none
    if odd.isEmpty():
        return docs.join(found.where("doc_id = class_id").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    found = materialised(found, "classes")
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")).alias("first"))
    first = materialised(first.select("first.doc_id", "first.content"), "first")
    plain = docs.join(odd.where("doc_id is not null"), "doc_id", "left_anti").where(F.col("doc_id").isNotNull())
    plain = plain.join(first.select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    content, other = free_name(docs, "content"), free_name(docs, "other")
    several = docs.join(odd.where("doc_id is not null"), "doc_id", "left_semi").select(docs.columns).unionByName(docs.where("doc_id is null"))
    kind = StructType([*docs.schema.fields, StructField(content, StringType())])
    several = several.mapInArrow(_keyed(content), kind)
    keep = first.select(F.col("doc_id").alias(other), F.col("content").alias(content))
    one = several.join(keep, content).where(F.col("doc_id").eqNullSafe(F.col(other))).dropDuplicates(["doc_id", content])
    return plain.unionByName(one.select(docs.columns))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


QUERIES = {"op8_order_minhash": op8_order_minhash}
ORACLES: dict[str, str] = {}
