"""A training-corpus pipeline over the table documents. Each stage takes (spark, docs, sf_dir) and gives the next one's
docs; all but the last return the columns that they were given.

1. quality classifier: documents that it rejects go.
2. n-gram Jaccard join: of each class of copies and near copies the document with the least doc_id stays.
3. benchmark decontamination: documents that hold a benchmark item go.
4. PII: surrogates take the place of personal data and secrets.
5. byte-level BPE: ids of every document, and whether they decode to its text.

What a stage leaves is written to the shared folder, read by the next, and deleted once that one is written.

Defined results: a null or empty text is scored like any other, has no class, holds no item and no entity, and encodes to
no ids; a null doc_id is judged by its text and has no class; very long texts are read whole; of rows that are equal in
doc_id and text, and of copies under different doc_ids, one stays; other columns pass through the first four stages
unchanged, also where an operator has a column of that name (but n_chars, which follows the text); empty tables of any kind give no rows, or if only labels or benchmark
are empty, reject none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import bpe, classifier, decontaminate, jaccard, pii
from docloom.llm.common import forget, keep, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classifier.pipeline_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.pipeline_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.pipeline_decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pipeline_pii(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.pipeline_encode(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("byte-level BPE encoding and decoding", encoding),
]

#: Fitting, banding and merging by rank aren't matters of SQL; tests/llm checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage leaves is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = keep(docs, f"stage{k + 1}")
            forget(before)
    return docs
