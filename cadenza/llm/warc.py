"""WARC archives: writing, and reading by verified boundary chains.

Writing is Spark's text writer: records are strings, joined with CRLF, and each file is one
gzip member, so archives go to any store with Spark's own commit protocol.  Of records with
equal payloads of at least `REVISIT_BYTES` bytes, the one with the largest page_id is a
response; the others revisit it, and keep the HTTP head that states the payload's length.
Only the digests of payloads that occur twice are joined, broadcast where they are few, so
pages aren't exchanged but in the case of very many copies.  Pages go to archives by classes of
size, each with so many records a file that no archive is much over `ARCHIVE_BYTES` unpacked.

Reading: every place where the magic stands is a candidate record if a header follows, and
its Content-Length says where its successor starts.  Each archive's task emits these links
first; pointer jumping from the start of the file (each step doubles the links) keeps what is
reachable; magic inside payloads is not.  Only reachable records are taken apart and hashed, so
payloads full of false headers cost no more than others.  A gzip file may have any number of members, as archives
of one member a record do; offsets are of the unpacked stream.  One that ends inside a member is an error that names the file.

Defined cases: null html is an empty payload; a null url is `urn:page:<id>`; a null page_id
is kept, and never the record that others refer to; rows that repeat page_id and html are all
responses if that id is the largest; CR and LF in urls are dropped; an empty table gives none;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import materialised, read_table, shared_folder

#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 1000
#: Records of an archive, and about how many bytes it may hold unpacked.
RECORDS_PER_FILE, ARCHIVE_BYTES = 5000, 256 << 20
#: Payloads are written by classes, up to so many bytes each; larger ones are alone in theirs.
SIZE_CLASSES = (32 << 10, 1 << 20, 32 << 20)
#: Digests of repeated payloads that are broadcast, at the most; 20 MB.
DIGESTS = 200_000
DATE = "2024-01-01T00:00:00Z"
_CRLF = "\r\n"


def _payloads(pages: DataFrame) -> DataFrame:
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return p.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "n": F.octet_length("html").cast("long")})


def repeated_payloads(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(digest, n, first) of payloads of at least so many bytes that occur twice or more; first is
    the largest page_id, null if none has one.  Counted within tasks before they are exchanged."""
    groups = _payloads(pages).where(F.col("n") >= revisit_bytes).groupBy("digest", "n")
    found = groups.agg(F.max("page_id").alias("first"), F.count("*").alias("copies"))
    return materialised(found.where("copies > 1 and first is not null").select("digest", "n", "first"), "payloads")


def records(pages: DataFrame, repeated: DataFrame, date: str = DATE) -> DataFrame:
    """One WARC record a page, in column `record`, without its last CRLF, and the payload's n."""
    few = repeated.count() <= DIGESTS
    p = _payloads(pages).join(F.broadcast(repeated) if few else repeated, ["digest", "n"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    url = F.coalesce(F.regexp_replace("url", "[\\r\\n]", ""), F.concat(F.lit("urn:page:"), name))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("n").cast("string"),
        F.lit(_CRLF * 2),
    )
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit(_CRLF))
    none = F.lit("")
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), name, F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(
            revisit,
            F.concat(
                line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))),
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ),
        ).otherwise(none),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line(
            "Content-Length",
            (F.octet_length(head) + F.when(revisit, F.lit(0)).otherwise(F.col("n"))).cast("string"),
        ),
        F.lit(_CRLF),
        head,
        F.when(revisit, none).otherwise(F.col("html")),
        F.lit(_CRLF),
    )
    return p.select(record.alias("record"))


def write_archives(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, archive_bytes: int = ARCHIVE_BYTES, classes: tuple[int, ...] = SIZE_CLASSES) -> None:
    repeated = repeated_payloads(pages)
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    largest = pages.agg(F.max(size)).first()[0] or 0
    low = -1
    for high in (*classes, None):
        if low >= 0 and largest <= low:
            break
        some = pages if high is None or largest <= high else pages.where(size <= high)
        some = some.where(size > low) if low >= 0 else some
        each = 1 if high is None else max(1, min(records_per_file, archive_bytes // high))
        writer = records(some, repeated).write.mode("append").option("lineSep", _CRLF).option("compression", "gzip")
        writer.option("maxRecordsPerFile", each).text(path)
        low = high


RECORDS = (
    "file string, offset long, successor long, file_bytes long, page_id long, record_type string, url string, "
    "payload_bytes long, payload_digest string, digest_found string, refers_to long"
)
_MAGIC = b"WARC/1."
_HEAD = re.compile(rb"WARC/1\.[0-9]\r\n((?:[!-9;-~]+:[^\r\n]*\r\n)+)\r\n")
_ID = re.compile(r"<urn:page:(-?\d+)>")
_BLOCK = re.compile(rb"(?i)\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*(?=\r\n)")
_LENGTH = re.compile(rb"(?i)\r\ncontent-length: *(\d+)")


def candidates(data: bytes | bytearray) -> Iterator[tuple[int, int, int]]:
    """(offset, start of the block, successor) of whatever in the bytes could be a record,
    whether reachable or not; the successor is -1 where no record can end.  Only heads are read."""
    at = data.find(_MAGIC)
    while at >= 0:
        m = _HEAD.match(data, at)
        stated = _BLOCK.findall(m[0]) if m else ()
        if stated:
            start = m.end()
            stop = start + int(stated[-1])  # of repeated fields the last counts, as in `fields`
            yield at, start, stop + 4 if data[stop : stop + 4] == b"\r\n\r\n" else -1
        at = data.find(_MAGIC, at + 1)


def record_at(data: bytes | bytearray, offset: int, start: int, successor: int) -> dict:
    """What one record says, and the digest of what it holds."""
    fields = {}
    for row in data[offset : start - 4].decode("utf-8", "replace").split(_CRLF)[1:]:
        k, _, v = row.partition(":")
        fields[k.lower()] = v.strip()
    block = data[start : successor - 4]
    head, _, payload = block.partition(b"\r\n\r\n")
    kind, stated = fields.get("warc-type", ""), _LENGTH.search(head)
    revisit = kind == "revisit"
    page, refers = (_ID.fullmatch(fields.get(k, "")) for k in ("warc-record-id", "warc-refers-to"))
    return {
        "offset": offset,
        "successor": successor,
        "file_bytes": len(data),
        "page_id": int(page[1]) if page else None,
        "record_type": kind,
        "url": fields.get("warc-target-uri"),
        "payload_bytes": int(stated[1]) if revisit and stated else len(payload),
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"),
        "digest_found": None if revisit else hashlib.sha1(payload).hexdigest(),
        "refers_to": int(refers[1]) if refers else None,
    }


def reachable(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Which of the ascending offsets are on the chain from 0, by pointer jumping."""
    n = len(offsets)
    place = np.searchsorted(offsets, successors)
    place[(place < n) & (offsets[np.minimum(place, n - 1)] != successors)] = n
    jump = np.append(place, n)  # n: no successor
    reached = np.zeros(n + 1, bool)
    reached[0] = n > 0 and offsets[0] == 0
    for _ in range(n.bit_length() + 1):
        reached[jump[reached]] = True
        jump = jump[jump]
    return reached[:n]


def chain(data: bytes | bytearray) -> Iterator[dict]:
    """The records on the chain of one archive: links of all candidates, then jumps, then bytes.
    A record without an end is none."""
    links = np.array(list(candidates(data)), np.int64).reshape(-1, 3)
    for offset, start, successor in links[reachable(links[:, 0], links[:, 2])].tolist():
        if successor >= 0:
            yield record_at(data, offset, start, successor)


#: Records that leave a task at a time.
_STEP = 1000
#: Bytes of a gzip file that are unpacked at a time, and so at most read again for the next member.
_FEED = 64 << 10


def unpacked(raw: memoryview | bytes) -> bytes | bytearray:
    """All members of a gzip file, one after the other; other bytes as they are.  Zeros after a member are padding."""
    if bytes(raw[:2]) != b"\x1f\x8b":
        return bytes(raw)
    out, at = bytearray(), 0
    while at < len(raw):
        if raw[at] == 0 and out:
            at += 1
            continue
        member = zlib.decompressobj(zlib.MAX_WBITS | 16)
        while not member.eof:
            some = raw[at : at + _FEED]
            if not len(some):
                raise EOFError("the file ends inside a gzip member")
            out += member.decompress(some)
            at += len(some) - len(member.unused_data)
    return out


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in RECORDS.split(", ")]
    schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in RECORDS.split(", ")])
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            try:
                data = unpacked(memoryview(content.as_buffer()))
            except (EOFError, zlib.error) as e:
                raise ValueError(f"{path}: {e}") from e
            rows = ({"file": path} | r for r in chain(data))
            while some := [{k: r.get(k) for k in names} for r in islice(rows, _STEP)]:
                yield pa.RecordBatch.from_pylist(some, schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records on the chains of all archives under the path."""
    found = spark.read.format("binaryFile").load(path).select("path", "content")
    return found.mapInArrow(_emit, RECORDS)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    write_archives(read_table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select(
        "page_id",
        "payload_bytes",
        F.coalesce("digest_found", "payload_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


SQL = """
SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN strlen(h) >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(h) >= 1000 AND page_id <> top THEN top END AS refers_to
FROM (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS top FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))
"""

QUERIES = {"op1_warc": op1_warc}
ORACLES = {"op1_warc": SQL}
