"""A training corpus from raw documents: quality, near duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. run() writes what a
stage returns as Parquet in the shared folder and gives it, read again, to the next one. What a stage wrote for itself is removed
when its result stands, and so is the result of the stage before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagebinder.llm import decontam, jaccard, packing, quality, secrets
from pagebinder.llm.common import remove, scratch, stored
from pagebinder.llm.queries import tokenizer_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on labels that aren't held out, accepts."""
    return quality.accepted(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates."""
    return jaccard.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.decontaminated(docs, _table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts: live-looking ones and widely copied examples by marks of their own."""
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.packed_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", classify_quality),
    ("n-gram Jaccard join", join_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack),
]

#: No SQL: the classifier and the tokenizer are beyond it. test_pipeline in tests/llm/test_models.py checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = _table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark) as made:
            result = stage(spark, docs, sf_dir)
            inner = len(made)
            docs = stored(result, f"stage{k}")
            path = made.pop(inner)
        if before:
            remove(spark, before)
        before = path
    return docs
