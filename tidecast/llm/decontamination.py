"""Benchmark items inside documents, by size-partitioned MinHash containment.

Items are the queries and documents the domain.  An item's sketch is the least
``k`` of its shingle hashes.  Items are partitioned by their number of
shingles, and ``k`` is set by the partition's largest size so that the sketch
is longer than what a containing document may lack: a document that holds the
asked share of an item therefore shows at least ``k - allowed`` of its sketch,
whatever the document's length.  Such pairs are candidates, and exact
containment of the full shingle sets decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.words import U64, mixed, shingle_sets, slices

BLOCK_SHINGLES = 2_000_000  # of items in one broadcast: 16 MB of hashes
_FILTER_BITS = 22


def allowed(n: int, percent: int) -> int:
    """How many of ``n`` shingles a containing document may lack."""
    return n * (100 - percent) // 100


def partition_top(n: int) -> int:
    """Largest size in the partition of size ``n``: 7, 15, 31, ..."""
    return (1 << max(3, int(n).bit_length())) - 1


class ItemIndex:
    """Sketches and full sets of one block of items."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        sketches = []
        self.need = np.zeros(len(sets), np.int64)
        for i, s in enumerate(sets):
            k = min(len(s), allowed(partition_top(len(s)), percent) + 1)
            self.need[i] = k - allowed(len(s), percent)
            sketches.append(s[np.argsort(mixed(s + U64(97)))[:k]])
        flat = np.concatenate(sketches) if sketches else np.zeros(0, U64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sketches])
        order = np.argsort(flat, kind="stable")
        self.keys, self.first = np.unique(flat[order], return_index=True)
        self.owners = owner[order]
        self.first = np.append(self.first, len(flat))
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[self.keys >> U64(64 - _FILTER_BITS)] = True

    def contained(self, doc: np.ndarray) -> list[tuple[int, int]]:
        """(item, shared shingles) of the items that the document's set holds."""
        probe = doc[self.maybe[doc >> U64(64 - _FILTER_BITS)]]
        if not len(probe):
            return []
        at = np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)
        at = at[self.keys[at] == probe]
        if not len(at):
            return []
        hits = np.concatenate([self.owners[self.first[k]: self.first[k + 1]] for k in at])
        items, seen = np.unique(hits, return_counts=True)
        found = []
        for i in items[seen >= self.need[items]].tolist():
            s = self.sets[i]
            shared = int((doc[np.minimum(np.searchsorted(doc, s), len(doc) - 1)] == s).sum())
            if 100 * shared >= self.percent * len(s):
                found.append((i, shared))
        return found


def _item_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets = list(shingle_sets(part.column("text")))
            yield pa.RecordBatch.from_arrays([
                part.column("_item"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([s.tobytes() for s in sets], pa.binary())], names=["_item", "_n", "_set"])


def _search(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, known = index.value
        for batch in batches:
            for part in slices(batch):
                docs = part.column("_doc").to_pylist()
                rows = [(d, items[i], len(known.sets[i]), n)
                        for d, s in zip(docs, shingle_sets(part.column("text"))) for i, n in known.contained(s)]
                cols = list(zip(*rows)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=_PAIR)
    return run


_PAIR = ["doc_id", "item_id", "item_shingles", "shared_shingles"]


def contained_items(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """``doc_id, item_id, item_shingles, shared_shingles`` of each item inside a document.

    An item is inside if the document holds ``percent`` of its distinct
    lower-cased 5-word shingles (fewer words: the whole sequence, which then
    only equals a document of just these words).  Items are taken in blocks of
    bounded size, each against all documents.

    Null and empty texts hold nothing and are in nothing.  Null ids stay null,
    repeated rows give repeated pairs, empty tables give an empty table, and
    other columns are ignored.

    A text is held whole in a task, at about 40 times its bytes; empty tables on
    either side give no row.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("text"))
    sets = items.select(F.col("item_id").cast("long").alias("_item"), F.col("text").cast("string").alias("text")).mapInArrow(
        _item_sets, "_item long, _n long, _set binary").where("_n > 0")
    total = sets.agg(F.sum("_n")).first()[0] or 0
    blocks = -(-total // BLOCK_SHINGLES)
    out = None
    for k in range(blocks):
        rows = sets.where(F.pmod(F.xxhash64("_set"), F.lit(blocks)) == k).orderBy("_item").collect()
        index = ItemIndex([np.frombuffer(r["_set"], U64) for r in rows], percent)
        shared = spark.sparkContext.broadcast(([r["_item"] for r in rows], index))
        found = source.mapInArrow(_search(shared), ", ".join(f"{c} long" for c in _PAIR))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], ", ".join(f"{c} long" for c in _PAIR))


def clean_documents(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that hold no item; rows without an id are kept."""
    from tidecast.storage import written_table

    found = written_table(contained_items(docs, items, percent).select(F.col("doc_id").alias("_hit")).distinct(), "leaks")
    return docs.join(found, docs["doc_id"] == found["_hit"], "left_anti")
