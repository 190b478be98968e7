import zlib

import numpy as np
import pytest
from pyspark.sql import Row

from cadenza.llm import repair
from cadenza.llm.tokens import END_ID, document_ids, encoder, public_path

WORDS = public_path("word_bpe_49k.json")
BYTES = public_path("byte_bpe_50k.json")
ODD = ["", " ", "  a  b\n\nc ", "don't 's 're", "É é İ Σσς ß", "a\x1cb\x1f c", "x　y z", "<|endoftext|> a<|startoftext|>", "ab" * 300, "😀 é combining", "1234 5,6;7"]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_ids_are_those_of_the_tokenizers_library(path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    rng = np.random.default_rng(3)
    bits = [*"ab c\n\t.,'sdé́ΣßİI\x1c　%", "<|endoftext|>", "'s ", " 're", " \n", "  ", "foo", " Bar,"]
    texts = ODD + ["".join(rng.choice(bits, rng.integers(0, 25))) for _ in range(3000)]
    for t, got in zip(texts, document_ids(path, texts), strict=True):
        want = plain.encode(t, add_special_tokens=False).ids + [END_ID]
        assert np.frombuffer(got, "<u4").tolist() == want, t
    assert encoder(path) is encoder(path)


@pytest.mark.parametrize("kind", ["random", "runs", "copies", "short"])
def test_grammar_round_trip_and_random_access(kind):
    rng = np.random.default_rng(5)
    ids = {
        "random": rng.integers(0, 50, 20_000),
        "runs": np.repeat(rng.integers(0, 3, 900), rng.integers(1, 40, 900)),
        "copies": np.tile(rng.integers(0, 49_000, 97), 200),
        "short": np.array([1]),
    }[kind].astype(np.uint32)
    docs = [x for x in np.array_split(ids, 7) if len(x)]
    blob = repair.encode_block(list(range(len(docs))), docs, 49_408)
    b = repair.Block(blob)
    assert (b.ids() == ids).all()
    assert (kind not in ("runs", "copies")) or len(blob) < 2 * len(ids)
    for a, z in [(0, 1), (0, len(ids)), (len(ids) // 3, len(ids) // 2), (len(ids) - 1, len(ids) + 5), (3, 3)]:
        assert (b.range(a, z) == ids[a:z]).all()
    assert all((b.document(k) == d).all() for k, d in enumerate(docs))
    assert (b.lengths >= 2).all() if len(b.lengths) else True


def test_against_brute_force(spark, sf_dir):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORDS)
    rows = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    start, want = 0, set()
    for d, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [END_ID]
        want.add((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = {tuple(r) for r in repair.op4_repair_ids(spark, sf_dir).collect()}
    assert got == want


def test_nulls_ties_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame(
        [Row(doc_id=3, text=None, part=1), Row(doc_id=1, text="a b", part=2), Row(doc_id=1, text="a b", part=2), Row(doc_id=None, text="c", part=3)],
        "doc_id long, text string, part int",
    )
    repair.write_ids(docs, f"{tmp_path}/a", WORDS, block_ids=2)
    got = sorted(repair.read_digests(spark, f"{tmp_path}/a").collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 2), (1, 2, 3), (1, 5, 3), (3, 8, 1)]
    repair.write_ids(docs.limit(0), f"{tmp_path}/b", WORDS)
    assert repair.read_digests(spark, f"{tmp_path}/b").count() == 0


def pair_counts(seq):
    counts = {}
    for a, b in zip(seq.tolist(), seq[1:].tolist(), strict=False):
        counts[a, b] = counts.get((a, b), 0) + 1
    return counts


@pytest.mark.parametrize("least", [2, 5, 64])
def test_replacement_goes_on_until_no_pair_is_frequent(least):
    rng = np.random.default_rng(11)
    for ids in (rng.integers(0, 30, 6000), rng.zipf(1.3, 6000) % 500, np.repeat(rng.integers(0, 3, 500), rng.integers(1, 30, 500)), np.zeros(777, np.int64)):
        rules, lengths, seq = repair.compress(ids.astype(np.uint32), 500, least)
        assert max(pair_counts(seq).values(), default=0) < least
        used = {x for x in [*seq.tolist(), *rules.ravel().tolist()] if x >= 500}
        assert used == set(range(500, 500 + len(rules)))  # no rule without a use
        full = {i: [i] for i in range(500)}
        for i, (a, b) in enumerate(rules.tolist()):
            full[500 + i] = full[a] + full[b]
            assert len(full[500 + i]) == lengths[i]
        assert [x for s in seq.tolist() for x in full[s]] == ids.tolist()


def test_more_symbols_than_16_bits():
    ids = np.tile(np.random.default_rng(2).integers(0, 70_000, 50), 300).astype(np.uint32)
    b = repair.Block(repair.encode_block([7], [ids], 70_000))
    assert len(b.rules) and (b.ids() == ids).all() and (b.range(100, 9000) == ids[100:9000]).all()


def test_ids_that_differ_from_the_library_are_an_error(monkeypatch):
    from cadenza.llm import tokens

    monkeypatch.setattr(tokens, "CHECKED", 1)
    document_ids(WORDS, ["some words"])
    enc = encoder(WORDS)
    monkeypatch.setattr(enc.pieces, "ids", enc.pieces.ids ^ 1)
    with pytest.raises(ValueError, match="differ"):
        document_ids(WORDS, ["some words"])


def test_ids_stay_the_same_when_pieces_are_dropped(monkeypatch):
    from cadenza.llm import tokens

    rng = np.random.default_rng(8)
    texts = [" ".join("".join(rng.choice([*"abcdeé.,*1'"], rng.integers(1, 40))) for _ in range(60)) for _ in range(60)]
    enc = tokens.WordEncoder(WORDS)
    want = [np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    monkeypatch.setattr(tokens, "KEPT_PIECES", 300)
    monkeypatch.setattr(tokens, "LONG_PIECES", 20)
    monkeypatch.setattr(tokens, "PLACES", 64)  # hashes clash all the time
    enc.pieces = tokens._Pieces()
    assert [x for i in range(0, 60, 7) for x in enc.encode(texts[i : i + 7])] == want
    assert len(enc.pieces.keys) <= 1000
