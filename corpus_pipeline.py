"""From raw documents to token files, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns the documents it keeps,
with the columns of ``docs``; the last returns what its files hold.  Between
stages the rows are written as Parquet in the shared folder.

A null text has no words and is rejected by the first stage; tables that are
empty give empty results; columns other than ``doc_id``, ``text`` and
``source`` are carried along and never looked at.  Rows without an id and rows
repeated whole pass the second stage, which tells documents apart by their id;
of linked ids the smallest stays.  A text is held whole in a task, at some 40
times its bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.decontamination import clean_documents
from tidecast.llm.mixing import mixture
from tidecast.llm.near_dedup import near_duplicates
from tidecast.llm.quality_rules import fit_rules, passing_documents
from tidecast.llm.queries import byte_bpe
from tidecast.llm.registry import table
from tidecast.llm.token_files import tokenized
from tidecast.storage import written_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fitted trees."""
    return passing_documents(docs, fit_rules(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more."""
    verdicts = near_duplicates(docs, percent=80)
    gone = written_table(verdicts.where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "duplicates")
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item inside."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"), percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources have equal shares of the bytes, in random order."""
    return mixture(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture, in its order; one row for each document in them."""
    return tokenized(docs, byte_bpe(), by_id=False)


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixing),
    ("token_files", token_files),
]

# Fitted trees decide the first stage, and the last counts tokens: not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written_table(stage(spark, docs, sf_dir), name)
    return docs
