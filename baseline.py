"""Naive twins of headline queries: rows come to one process and plain loops compute the result,
as a single-machine program would.  Prints one JSON line of warm seconds, the median of runs, and
whether each twin has as many rows as the query.

BENCH_SF_DIR: folder of the tables; BENCH_CPUS: local cores for Spark; BASELINE_RUNS: timed runs.
"""

from __future__ import annotations

import bisect
import json
import os
import statistics
import sys
import tempfile
import time
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import SparkSession

from cadenza.sources import fixtures as fx

HOUR = 3_600_000


def by_source(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[1]].append(r)
    return {s: sorted(v, key=lambda r: (r[2], r[3])) for s, v in out.items()}


def merged(rows, gap=0):
    out = []
    for s, mine in by_source(rows).items():
        for _, _, a, b in mine:
            if out and out[-1][0] == s and a <= out[-1][2] + gap:
                out[-1][2] = max(out[-1][2], b)
            else:
                out.append([s, a, b])
    return out


class Tables:
    """Segments come through Spark, once; all else is read with pyarrow."""

    def __init__(self, spark, d):
        self.d = d
        self.kinds = defaultdict(list)
        for *r, kind in fx.segments(spark, d).select("segment_id", "source_id", "start_ms", "end_ms", "kind").collect():
            self.kinds[kind].append(tuple(r))
            self.kinds["all"].append(tuple(r))

    def read(self, name, *columns):
        return pq.read_table(f"{self.d}/{name}.parquet", columns=list(columns)).to_pylist()


def merge_gap_hour(t):
    return len(merged(t.kinds["all"], HOUR))


def subtract_blocked(t):
    cuts, n = defaultdict(list), 0
    for s, a, b in merged(t.kinds["error"]):
        cuts[s].append((a, b))
    for _, s, a, b in (r for k in ("click", "view", "purchase") for r in t.kinds[k]):
        at = a
        for x, y in cuts[s]:
            if y > a and x < b:
                n += x > at
                at = max(at, y)
        n += at < b
    return n


def overlap_join(t):
    other, n = by_source(t.kinds["view"]), 0
    for _, s, a, b in t.kinds["click"]:
        n += sum(min(b, y[3]) > max(a, y[2]) for y in other.get(s, ()))
    return n


def nearest(t):
    other = {s: [r[2] for r in v] for s, v in by_source(t.kinds["view"]).items()}
    for _, s, a, _ in t.kinds["click"]:
        at = other.get(s, [])
        bisect.bisect_left(at, a)
    return len(t.kinds["click"])


def exact_content(t):
    return len({r["text"] for r in t.read("documents", "text")})


def rank_auc(t):
    rows = t.kinds["all"]
    return len(np.argsort([r[3] - r[2] for r in rows], kind="stable"))


def secrets(t):
    from cadenza.llm.secrets import scan

    return len([scan(r["text"]) for r in t.read("documents", "text")])


def decontaminate(t):
    from cadenza.llm.decontaminate import windows_of, words_of

    windows = {w for r in t.read("benchmark", "text") for w in windows_of(r["text"])}
    sizes = {w.count(b" ") + 1 for w in windows}
    out = 0
    for r in t.read("documents", "text"):
        words = words_of(r["text"])
        for n in sizes:
            for i in range(len(words) - n + 1):
                b" ".join(words[i : i + n]) in windows  # noqa: B015
        out += 1
    return out


def _tokens(name):
    def encode(t):
        import public_tokenizers
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(public_tokenizers.path(name))
        return len([tok.encode(r["text"] or "", add_special_tokens=False).ids for r in t.read("documents", "text")])

    return encode


def near_duplicates(t):
    """Every pair of documents that share a k-mer, by its sets."""
    from cadenza.llm.neardup import kmer_hashes, similarity, word_hashes

    words = [word_hashes(r["text"]) for r in t.read("documents", "text")]
    index = defaultdict(list)
    for i, w in enumerate(words):
        for k in np.unique(kmer_hashes(w)).tolist():
            index[k].append(i)
    seen = {(a, b) for m in index.values() if len(m) < 200 for a in m for b in m if a < b}
    for a, b in seen:
        similarity(words[a], words[b])
    return len(words)


TWINS = {
    "I1_merge_gap_hour": merge_gap_hour, "I3_subtract_blocked": subtract_blocked, "J1_overlap_join": overlap_join, "J4_nearest": nearest, "D1_exact_content": exact_content,
    "E1_rank_auc": rank_auc, "op2_secrets": secrets, "op3_decontaminate": decontaminate, "op4_repair_ids": _tokens("word_bpe_49k.json"), "op8_order_minhash": near_duplicates, "op10_harmonic_pack": _tokens("byte_bpe_50k.json"),
}


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    runs = int(os.environ.get("BASELINE_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables, took = Tables(spark, d), {}
    for name in [n for n in TWINS if len(sys.argv) < 2 or n in sys.argv[1:]]:
        times = []
        while len(times) < runs and sum(times) < 30:
            began = time.perf_counter()
            TWINS[name](tables)
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times), 3)
    print(json.dumps({"metric": "naive_one_process", "unit": "sec", "queries": took, "folder": d}))
    spark.stop()


if __name__ == "__main__":
    main()
