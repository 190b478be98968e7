import gzip
import hashlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

from cadenza.llm import warc


def test_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    cols = "page_id, payload_bytes, payload_digest, record_type, refers_to"
    want = con.execute(f"select {cols} from ({warc.SQL}) order by page_id").fetchall()
    got = warc.op1_warc(spark, sf_dir).select(*cols.split(", ")).orderBy("page_id").collect()
    assert [tuple(r) for r in got] == want


def test_magic_in_payloads_nulls_copies_and_ties(spark, tmp_path):
    fake = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    long = "é" * 600
    rows = [(1, "http://a", fake), (2, None, None), (3, "u\r\nWARC-Type: bad", ""), (4, "u", long), (7, "u", long), (5, "u", long),
            (7, "u", long), (None, "u", long), (8, "u", fake + long), (9, "u", "x" * 999), (10, "u", "x" * 999)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, record string")
    warc.write_archives(pages, str(tmp_path / "w"), records_per_file=3)
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(rows) and 999 not in {r.page_id for r in got}
    for r in got:
        html = dict((p, h or "") for p, _, h in rows)[r.page_id]
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == hashlib.sha1(html.encode()).hexdigest()
        assert r.digest_found in (None, r.payload_digest)
        revisit = html == long and r.page_id != 7
        assert (r.record_type, r.refers_to) == (("revisit", 7) if revisit else ("response", None))
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path / "w").glob("*.gz"))
    assert raw.count(b"WARC/1.1\r\n") == len(rows) + 2
    classes = str(tmp_path / "c")
    warc.write_archives(pages, classes, records_per_file=3, archive_bytes=1000, classes=(10, 999, 1200))
    assert sorted(map(repr, (r.asDict() | {"file": 0, "offset": 0, "successor": 0, "file_bytes": 0} for r in got))) == sorted(
        repr(r.asDict() | {"file": 0, "offset": 0, "successor": 0, "file_bytes": 0}) for r in warc.read_archives(spark, classes).collect()
    )
    empty = str(tmp_path / "e")
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_pointer_jumping_against_a_walk():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 1000):
        offsets = np.unique(np.append(0, rng.integers(0, 10 * n + 1, n))) if n else np.zeros(0, int)
        successors = rng.choice(np.append(offsets, [-1, 10**9]), len(offsets)) if n else np.zeros(0, int)
        if n > 3:
            successors[:-1] = np.where(rng.random(len(offsets) - 1) < 0.95, offsets[1:], successors[:-1])
        want, at, of = set(), 0, dict(zip(offsets.tolist(), successors.tolist(), strict=True))
        while at in of and at not in want:
            want.add(at)
            at = of[at]
        assert set(offsets[warc.reachable(offsets, successors)].tolist()) == want


def test_false_headers_are_not_hashed(monkeypatch):
    """A payload of heads that each claim all the rest is read once."""
    head = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n"
    payload = b"".join(head % (60 * k) for k in range(3000, 0, -1))
    body = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    data = head % len(body) + body + b"\r\n\r\n" + head % 3 + b"end" + b"\r\n\r\n" + head % 9 + b"cut"
    hashed = []
    sha1 = hashlib.sha1
    monkeypatch.setattr(warc.hashlib, "sha1", lambda b: hashed.append(len(b)) or sha1(b))
    assert [r["payload_bytes"] for r in warc.chain(data)] == [len(payload), 0] and sum(hashed) == len(payload)
    assert len(list(warc.candidates(data))) == 3003


def test_archives_of_many_members(spark, tmp_path):
    """A member a record, records over several members, padding, empty members, plain files and cut ones."""
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n"
    bodies = [f"HTTP/1.1 200 OK\r\n\r\n{'x' * (i * 977 % 90_000)}WARC/1.1\r\n" for i in range(300)]
    records = [(head % (i, len(b)) + b + "\r\n\r\n").encode() for i, b in enumerate(bodies)]
    whole = b"".join(records)
    files = {
        "each": b"".join(map(gzip.compress, records)),
        "across": b"".join(gzip.compress(whole[k : k + 10_007]) for k in range(0, len(whole), 10_007)),
        "padded": b"".join(gzip.compress(r, 0) + b"\0" * (i % 3 * 300) for i, r in enumerate(records)),
        "empty": gzip.compress(b"") + gzip.compress(whole) + gzip.compress(b""),
        "one": gzip.compress(whole),
        "plain": whole,
        "nothing": b"",
    }
    for name, data in files.items():
        assert bytes(warc.unpacked(data)) == (whole if data else b"")
        (tmp_path / f"{name}.warc").write_bytes(data)
    want, at = [], 0
    for i, (r, b) in enumerate(zip(records, bodies, strict=True)):
        want.append((at, at + len(r), i, len(b) - len("HTTP/1.1 200 OK\r\n\r\n")))
        at += len(r)
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert len(got) == 6 * len(records)
    for name in files.keys() - {"nothing"}:
        mine = sorted((r.offset, r.successor, r.page_id, r.payload_bytes) for r in got if r.file.endswith(f"/{name}.warc"))
        assert mine == want, name
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "cut.warc.gz").write_bytes(files["each"][:-5])
    with pytest.raises(Exception, match=r"cut\.warc\.gz: the file ends inside a gzip member"):
        warc.read_archives(spark, str(tmp_path / "cut")).collect()
