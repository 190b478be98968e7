import zlib
from collections import defaultdict

import numpy as np
import pytest

from cadenza.llm import packing
from cadenza.llm.tokens import END_ID, public_path

BYTES = public_path("byte_bpe_50k.json")


def is_power(n):
    return n & (n - 1) == 0


def check(rows, texts, capacity):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BYTES)
    docs, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    assert set(docs) == set(texts)
    for d, pieces in docs.items():
        ids = np.array(plain.encode(texts[d] or "", add_special_tokens=False).ids + [END_ID], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padded = total = 0
    for pieces in bins.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
        total += at
        padded += 0 if is_power(at) else capacity - at
    return padded / total


def test_whole_table(spark, sf_dir):
    rows = packing.op10_harmonic_pack(spark, sf_dir).collect()
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    assert check(rows, texts, packing.CAPACITY) < 0.01


@pytest.mark.parametrize("capacity", [1, 7, 64])
def test_small_capacities_nulls_and_long_texts(spark, capacity):
    texts = {i: "word and some more " * i for i in range(40)} | {100: None, 101: "", None: "x y"}
    docs = spark.createDataFrame([(d, t, "en") for d, t in texts.items()], "doc_id long, text string, ids string")
    rows = packing.packed_digests(packing.pack(docs, BYTES, capacity)).collect()
    check(rows, texts, capacity)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, BYTES).count() == 0


def test_repeated_rows_keep_all_their_ids(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 5, "doc_id long, text string")
    rows = packing.pack(docs, BYTES).collect()
    assert sum(r.length for r in rows) == 5 * 4


@pytest.mark.parametrize("length", [0, 1, 5, 127, 128, 129, 683, 1500, 2047, 2048, 2049, 10_000])
def test_cuts_fill_their_class(length):
    got = packing.cuts(length)
    assert sum(n for _, n in got) == length
    assert all(0 < j * n <= packing.CAPACITY and packing.CAPACITY // n == j for j, n in got)
