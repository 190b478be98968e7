"""The training-data pipeline: named stages, each reading what its predecessor kept.

All stages but the last return the columns of `documents`; the last returns packed pieces of
token ids.  `run` writes each stage's result to the shared folder and reads it again, so that a
lost executor never costs more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import classifier, decontaminate, neardup, packing, secrets
from cadenza.llm.common import free_name, materialised, read_table
from cadenza.llm.tokens import public_path

TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = classifier.train(docs, read_table(spark, sf_dir, "labels"))
    predicted = free_name(docs, "predicted")
    scored = classifier.score_documents(docs, model, predicted=predicted)
    return scored.where(F.col(predicted) == 1).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least doc_id, of each group of near duplicates."""
    return neardup.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with the benchmark."""
    out = free_name(docs, "contamination")
    found = decontaminate.find_contamination(docs, read_table(spark, sf_dir, "benchmark"), out)
    c = F.col(out)
    n_hit = decontaminate.hit_words(c["runs"])
    return found.where(~decontaminate.is_contaminated(n_hit, c["n_words"])).select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced; n_chars follows."""
    return secrets.redact_secrets(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences."""
    packed = packing.pack(docs, public_path(TOKENIZER))
    return packed.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("packing", pack),
]

#: SQL can't express these stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
