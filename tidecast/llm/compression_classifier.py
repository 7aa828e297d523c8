"""Quality by compression: zstandard dictionaries of good and of bad text.

Each text is compressed whole, block by block, with either dictionary.  The
difference of the two sizes, divided by the text's length, is the evidence; a
logistic curve of it, and of the size under the good dictionary (which falls
when a text repeats itself), turns it into a calibrated score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm import logistic
from tidecast.llm.samples import labelled_sample
from tidecast.storage import written_table

BLOCK = 4096
LEVEL = 3
DICTIONARY_BYTES = 112_640
DICTIONARY_DOCS, DICTIONARY_TEXT = 800, 16 << 20  # of either label: documents at most, and their bytes
CALIBRATION_DOCS = 8_000


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    curve: logistic.Logistic

    def sizes(self) -> Sizes:
        return Sizes(self.good, self.bad)


class Sizes:
    """Features of texts from their compressed sizes."""

    def __init__(self, good: bytes, bad: bytes):
        plain = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        self.good, self.bad = (zstandard.ZstdCompressor(
            dict_data=zstandard.ZstdCompressionDict(d), **plain) if d else zstandard.ZstdCompressor(**plain) for d in (good, bad))

    def __call__(self, text: str | None) -> tuple[float, ...]:
        data = (text or "").encode()
        cut = [data[i: i + BLOCK] for i in range(0, len(data), BLOCK)]
        good = sum(len(self.good.compress(b)) for b in cut)
        bad = sum(len(self.bad.compress(b)) for b in cut)
        n = max(len(data), 1)
        difference, size, short = (bad - good) / n, good / n, 1 / np.sqrt(n)
        return difference, size, short, difference * size, difference * short, size * size, size * short


_WIDTH = 7


def _dictionary(texts: list[str]) -> bytes:
    blocks = [b for t in texts for d in [t.encode()] for i in range(0, len(d), BLOCK) if len(b := d[i: i + BLOCK]) >= 8]
    size = min(DICTIONARY_BYTES, sum(map(len, blocks)) // 4)
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little text to train on: use it as it is
        return b"".join(blocks)[-DICTIONARY_BYTES:]


def _features(good: bytes, bad: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(good, bad)
        for batch in batches:
            rows = [sizes(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("_id"), batch.column("_label"), pa.array(rows, pa.list_(pa.float64()))],
                names=["_id", "_label", "_x"])
    return run


def fit_compression(docs: DataFrame, labels: DataFrame, label: str = "quality", where: Column | None = None) -> CompressionModel:
    """Dictionaries and curve from a bounded sample of labelled rows.

    At most ``DICTIONARY_DOCS`` documents and ``DICTIONARY_TEXT`` bytes of
    either label make the dictionaries; others, at most ``CALIBRATION_DOCS``,
    fit the curve.  ``where`` is a condition on ``_id``.
    """
    sample = written_table(labelled_sample(
        docs, labels, label, CALIBRATION_DOCS + 2 * DICTIONARY_DOCS, where), "labelled").where("text is not null")
    rank = Window.partitionBy("_label").orderBy(F.xxhash64("_id", F.lit("dictionary")), "_id")
    marked = sample.select("_id", "_label", F.octet_length("text").alias("_bytes")).select(
        "_id", "_label", F.row_number().over(rank).alias("_rank"), F.sum("_bytes").over(rank).alias("_sum"),
        F.count("*").over(Window.partitionBy("_label")).alias("_all"))
    # a label's smaller half at most, so that some of it is left for the curve
    chosen = marked.where((F.col("_rank") <= F.least(F.lit(DICTIONARY_DOCS), F.ceil(F.col("_all") / 2)))
                          & (F.col("_sum") <= DICTIONARY_TEXT)).select("_id")
    texts = sorted((r["_id"], r["_label"], r["text"]) for r in sample.join(F.broadcast(chosen), "_id").collect())
    good, bad = (_dictionary([t for _, y, t in texts if y == k]) for k in (1, 0))
    rows = sample.join(F.broadcast(chosen), "_id", "left_anti").mapInArrow(
        _features(good, bad), "_id long, _label int, _x array<double>").orderBy("_id").collect()
    x = np.array([r["_x"] for r in rows], float).reshape(-1, _WIDTH)
    return CompressionModel(good, bad, logistic.fit(x, np.array([r["_label"] for r in rows], float), ridge=0.1))


def _scores(model: CompressionModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = model.sizes()
        for batch in batches:
            x = np.array([sizes(t) for t in batch.column("text").to_pylist()], float).reshape(-1, _WIDTH)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(model.curve.probability(x))], names=["doc_id", "score"])
    return run


def quality_scores(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """``doc_id, score`` for each row, 0 to 1.

    Null and empty texts compress to nothing and get the curve's value there.
    Null ids stay null, repeated rows score alike, other columns are ignored.

    A text is held whole in a task, at about four times its bytes; rows repeated
    whole score alike, and an empty table gives no row.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _scores(model), "doc_id long, score double")
