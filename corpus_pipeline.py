"""A training corpus from raw documents: quality, near duplicates, benchmarks, mixture, token records.

Each stage works on all that its predecessor kept.  The stages before the last
return rows with the columns of `documents`; the last returns the index of the
written records.  Every stage is written as Parquet in the shared checkpoint folder
and read again; once the last is written, the folders of those before it go.

Null and empty texts, repeated rows, null ids, empty tables and columns beside those of
`documents` pass through every stage; what each does with them is said there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import decontaminate, jaccard_join, mixing, quality, token_records
from trackloom.llm.common import checkpoint_dir, remove_folder, table
from trackloom.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, fitted on `labels`, rejects.

    Each row is judged where it is; null texts as empty ones.  A row with a null id stays.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each class of near duplicates.

    Texts without words are no duplicates.  Rows that share an id stay or go together; a row with a null id stays.
    """
    return jaccard_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without contaminated documents; each row is judged where it is, and one with a null id stays."""
    return decontaminate.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it; longer ones are likelier.

    Texts without words are not taken.  Rows with null or shared ids are drawn like others, equal rows together.
    """
    return mixing.take(docs, weight=mixing.length_weight())


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The index of the records that are written, one for each row; null ids come first."""
    path = token_records.new_folder(spark)
    token_records.write(docs, path, tokenizer_path())
    return token_records.index(spark, path)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixture),
    ("token-ID / binary output", token_output),
]

#: A fitted classifier, MinHash and a tokenizer are not for SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    for k in range(len(STAGES) - 1):
        remove_folder(spark, f"{folder}/{k}")
    return docs
