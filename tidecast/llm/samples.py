"""Labelled documents, all of them or a bounded sample."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.storage import written_table

BLOCK_LABELS = 2_000_000  # ids that meet the documents at once
MOST_BLOCKS = 8           # passes over the documents; with more labels, texts are shuffled


def fold(doc_id: Column | str, folds: int) -> Column:
    """``crc32(doc_id as text) mod folds``; null ids have the fold of an empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def _labelled_ids(labels: DataFrame, label: str, where: Column | None) -> DataFrame:
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_label"))
    return ids if where is None else ids.where(where)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, where: Column | None = None) -> DataFrame:
    """``_id, _label, text`` of up to ``rows`` labelled documents, picked by a hash of their id.

    ``where`` is a condition on ``_id``.  An id labelled twice takes the larger label.
    """
    ids = _labelled_ids(labels, label, where)
    return _texts(docs).join(F.broadcast(ids.orderBy(F.xxhash64("_id"), "_id").limit(rows)), "_id")  # at most `rows` ids


def labelled_parts(docs: DataFrame, labels: DataFrame, label: str, where: Column | None = None) -> list[DataFrame]:
    """All labelled documents, as tables without common ids; texts stay in their tasks, ids are broadcast in blocks."""
    ids = written_table(_labelled_ids(labels, label, where), "labelled-ids")
    blocks = max(1, -(-ids.count() // BLOCK_LABELS))
    if blocks > MOST_BLOCKS:
        return [_texts(docs).join(ids, "_id")]
    block = F.pmod(F.xxhash64("_id", F.lit("block")), F.lit(blocks))
    return [_texts(docs).join(F.broadcast(ids.where(block == b)), "_id") for b in range(blocks)]


def labelled_documents(docs: DataFrame, labels: DataFrame, label: str, where: Column | None = None) -> DataFrame:
    """``_id, _label, text`` of all labelled documents, written; one block of ids is broadcast at a time."""
    return reduce(DataFrame.unionByName, [written_table(p, "labelled") for p in labelled_parts(docs, labels, label, where)])
