"""From raw documents to encoded training text: each stage is written as Parquet and read again by the next.

Stages take and return the columns of ``documents``; the last returns its encodings. Every stage
decides on what its predecessor kept. Null texts and repeated rows are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuscope.llm.bpe import encode_documents
from corpuscope.llm.decontamination import without_leaks
from corpuscope.llm.exact_dedup import exact_dedup
from corpuscope.llm.near_dedup import near_dedup
from corpuscope.llm.queries import fold, vocabulary
from corpuscope.llm.tables import materialize, read
from corpuscope.llm.toxicity import fit, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; the model learns from labelled documents outside the held-out fold."""
    return without_toxic(docs, fit(docs, read(spark, sf_dir, "labels").filter(fold(5) != 0)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of equal texts."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of each group linked by 0.8 of five-word shingles."""
    return near_dedup(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return without_leaks(docs, read(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests, ids and decoded text."""
    return encode_documents(docs, vocabulary())


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontamination),
    ("bpe", encoding),
]

#: near-duplicate components and trained models are beyond SQL; tests hold each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
