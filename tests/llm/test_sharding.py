import zlib

import pytest

from cadenza.llm import sharding as sh


def law(rows, shards, largest):
    sizes, slots = [0] * shards, [[] for _ in range(shards)]
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(sizes) - min(sizes) <= 2 * largest
    return sizes


def test_whole_table(spark, sf_dir):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    rows = sh.op6_histogram_shards(spark, sf_dir).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {d: (len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts.items()}
    law(rows, 8, max(r.size for r in rows))
    groups = {}
    for r in rows:
        groups.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(s) > 1 for s in groups.values()) <= 7  # only a splitter cuts a group


@pytest.mark.parametrize("piece_bytes", [sh.PIECE_BYTES, 500])
def test_a_hot_group_is_split_evenly(spark, piece_bytes):
    rows = [(i, "same text") for i in range(600)] + [(600 + i, f"text {i}" * (i % 7)) for i in range(300)] + [(None, None), (None, ""), (5, "x"), (5, "x")]
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, shard string, _h int").repartition(5)
    out = sh.shard_by_bytes(docs, 8, piece_bytes)
    assert out.columns == ["doc_id", "text", "shard", "_h", "size", "slot", "_shard"]
    got = out.drop("shard").withColumnRenamed("_shard", "shard").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(rows, key=str)
    sizes = law(got, 8, 60)
    assert max(sizes) - min(sizes) <= 120


def test_empty_and_tiny(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert sh.shard_by_bytes(docs.limit(0)).count() == 0
    assert [r.slot for r in sh.shard_by_bytes(docs).collect()] == [0]


@pytest.mark.parametrize("piece_bytes", [sh.PIECE_BYTES, 500])
@pytest.mark.parametrize("ids", [[-(1 << 63), (1 << 63) - 1, None], [-(1 << 63) + 1, (1 << 63) - 1, None], [-5, -4, None]])
def test_ids_of_any_size(spark, ids, piece_bytes):
    """The least and the largest ids, negative ones and none, in one hot group and in groups of their own."""
    rnd = range(200)
    spread = [(k * 46_000_000_000_000_000 * (-1) ** k, "hot") for k in rnd] + [(k - 100, f"own {k}") for k in rnd]
    rows = [(i, t) for i in ids for t in ("hot", "", "last")] + spread
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sh.shard_by_bytes(docs, 8, piece_bytes).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(rows, key=str)
    sizes = law(got, 8, 9)
    assert max(sizes) - min(sizes) <= 27
    hot = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.text == "hot"]
    assert hot[0] is None and hot[1:] == sorted(hot[1:])  # in order, over the shards
