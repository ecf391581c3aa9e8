"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, and further columns that docs may have.

Rows are told apart by a key of their own, not by doc_id, so ids may be null or occur several times. An empty table stays empty
through all stages. What the stages write stays in the shared folder, in one folder for each run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import bpe, decontaminate, exact_dedup, ngram_join, toxicity


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier calls toxic; it learns from the labels of four fifths of them.

    Null and empty texts have no words that speak against them and stay; repeated rows go or stay together. Without labels all rows stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5)) != 0)
    return toxicity.drop_toxic(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of each group of texts that are equal without white space: the longest, then the one with the smallest id.

    Null, empty and blank texts are one group. Of rows that tie in length and id (repeated rows) one stays; a null id is last.
    """
    return exact_dedup.drop_copies(docs)


def similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of each group of near copies (five words, 0.75): the one with the smallest id; a null id is last, and ties go to any one row.

    Null, empty and blank texts have no words and all stay, as many as there are.
    """
    return ngram_join.drop_similar(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that overlap a benchmark item; null and empty texts overlap nothing, nor do null items, and repeated rows go together."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode what is left and decode it again, a row for each row: (doc_id, n_tokens, ids_sha256, decoded_sha256); a null text counts as empty."""
    return bpe.round_trip_digests(docs, *bpe.default_paths())


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("ngram_jaccard_join", similar), ("decontamination", clean), ("bpe", tokens)]

#: The classifier's decisions cannot be had in SQL; tests compare the pipeline with its stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; what a stage returns goes through Parquet in the session's shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs


def shared_folder(spark: SparkSession) -> str:
    from codeloom.llm._spark import shared_folder

    return shared_folder(spark)
