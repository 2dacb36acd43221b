"""The corpus pipeline: documents through five stages, each of which works on all that the one before kept.

STAGES: (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes
as Parquet into the shared folder and reads again as the next stage's docs. All but the last return the
columns of documents, whatever others a table has. An empty table passes through every stage; a null text counts as
an empty one, stays null, and only the quality classifier may drop it; rows of a null id, and rows that repeat an id
or a text, are each treated by themselves, but where a stage says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import bpe, decontaminate, ngram_join, quality, secrets
from lexloom.llm.common import shared_dir, stash

def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier rejects go; it learns from the labels outside its held-out fold.

    Without labels, or with one kind of them, every row gets the labels' mean (0.5 without any) as its score.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the row with the smallest id stays, with rows that repeat this id.

    Texts without words link with nothing and stay, as do rows of a null id.
    """
    return ngram_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut from the texts; a row of which nothing is left goes, clean rows stay as they are."""
    return decontaminate.remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; clean rows stay as they are."""
    return secrets.redact_secrets(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text as token ids: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers)."""
    return bpe.encode_documents(docs).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("BPE encoding", encoding_stage),
]

#: Learned scores and token ids are not for SQL; tests/llm/test_methods.py holds every stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents."""
    folder = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stash(stage(spark, docs, sf_dir), folder, f"stage-{k}")
    return docs
