from collections import namedtuple

import numpy as np

import corpus_pipeline as cp
from cadenza.llm import classifier, decontaminate, secrets
from tests.llm import test_decontaminate, test_neardup, test_packing

Doc = namedtuple("Doc", "doc_id text lang source n_chars")


def by_hand(spark, d):
    """The stages but the last, one after the other, on plain rows."""
    docs = [Doc(*r) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    text = {r.doc_id: r.text for r in docs}
    import zlib

    known = [(r.doc_id, r.quality) for r in sorted(labels) if r.doc_id in text and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    model = classifier.fit([classifier.features(text[i]) for i, _ in known], np.array([y for _, y in known]))
    docs = [r for r in docs if model.score(r.text) >= classifier.THRESHOLD]
    classes = test_neardup.brute([(r.doc_id, r.text) for r in docs])
    docs = [r for r in docs if classes[r.doc_id] == r.doc_id]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    bad = test_decontaminate.brute([(r.doc_id, r.text) for r in docs], items)
    docs = [r for r in docs if not bad[r.doc_id][3]]
    out = []
    for r in docs:
        clean = secrets.redact(r.text, [s[1:3] for s in secrets.scan(r.text)[1]])
        out.append(r._replace(text=clean, n_chars=len(clean)))
    return out


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for _, stage in cp.STAGES[:-1]:
        docs = cp.materialised(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == columns
    want = by_hand(spark, sf_dir)
    assert sorted(tuple(r) for r in docs.collect()) == sorted(tuple(r) for r in want)
    rows = cp.run(spark, sf_dir).collect()
    assert test_packing.check(rows, {r.doc_id: r.text for r in want}, 2048) < 0.01


def test_empty_documents_and_extra_columns(spark, sf_dir):
    docs = spark.createDataFrame([(1, None, "en", "s", None, 7), (2, "", "en", "s", 0, 7)], "doc_id long, text string, lang string, source string, n_chars long, score int")
    for some in (docs, docs.limit(0)):
        for _, stage in cp.STAGES[:-1]:
            some = stage(spark, some, sf_dir)
            assert some.columns == docs.columns
        cp.pack(spark, some, sf_dir).count()


def test_columns_of_our_names_change_no_decision(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = ["predicted", "score", "contamination", "secrets", "content", "class_id", "group", "c", "label", "stats"]
    clashing = docs.select("*", *(cp.F.lit(1).alias(n) for n in names))
    for _, stage in cp.STAGES[:-1]:
        plain, more = (cp.materialised(stage(spark, x, sf_dir), "stage") for x in (docs, clashing))
        assert more.columns == clashing.columns and not more.where("predicted <> 1 or score <> 1 or contamination <> 1").count()
        assert sorted(more.select(docs.columns).collect()) == sorted(plain.collect())
        docs, clashing = plain, more


def test_contaminated_documents_in_other_scripts_go(spark, tmp_path):
    item = "хорошо их à Å х 日本語 b\xa0c " + " ".join(f"слово{i}" for i in range(9))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, f"vor {item} nach"), (2, item.replace("хорошо", "плохо").replace("слово4", "снова"))], "doc_id long, text string")
    assert [r.doc_id for r in cp.decontamination(spark, docs, str(tmp_path)).collect()] == [2]
