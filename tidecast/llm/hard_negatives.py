"""Hard negatives of anchors by coordinate pruning in length buckets.

Rows are ordered by the length of their integer vectors, longest first, and
cut into buckets of ``BUCKET_ROWS``; anchors are cut into blocks.  A task gets
one bucket and one block.  It keeps the bucket's directions as one sorted list
per coordinate.  An anchor that asks for scores of at least t needs a cosine of
at least t / (its length * the bucket's largest length), so each of its largest
(focus) coordinates admits only one range of values in the matching list; the
rows in all ranges are scored exactly, whole buckets out of reach are skipped.

The thresholds come from the data: the first bucket is searched without any,
and what it yields bounds the search of the others.  They are lower bounds of
the true ones, so nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.operators.order import dense_index
from tidecast.storage import written_table

BUCKET_ROWS = 2048     # rows of a bucket, and anchors of a block
FOCUS = 4              # coordinates whose ranges are intersected
SLACK = 1e-9           # widens ranges by more than rounding can err
EXACT_FLOAT = 2.0**52  # sums of products below this are exact in doubles
LARGEST_NORM2 = 2.0**62


def integer_rows(df: DataFrame, label: Column) -> DataFrame:
    """``id, label, v, norm2`` of the rows that take part; ``v`` is floor(256 * x) of each component.

    Rows without an id, label or vector, and those with a null or non-finite
    component take no part, nor do vectors whose squared length is 2**62 or
    more, because scores would not fit 64 bits.  Rows that share an id count
    once, as the one with the smallest label and vector.
    """
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < 2.0**40))
    norm2 = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    kept = df.select(F.col("vec_id").cast("long").alias("id"), label.cast("int").alias("label"), "embedding").where(
        "id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(finite)
    rows = kept.select("id", "label", whole.alias("v")).withColumn("norm2", norm2).where(F.col("norm2") < LARGEST_NORM2)
    return rows.groupBy("id").agg(F.min(F.struct("label", "v", "norm2")).alias("r")).select("id", "r.*")


def vectors(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Integer vectors as a matrix; missing components count as 0."""
    lists = column.combine_chunks()
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width), np.int64)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], sizes)] = flat[offsets[0]: offsets[-1]]
    return out


class LengthBucket:
    """Rows of similar length with a sorted list of unit values for each coordinate."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.ids, self.labels, self.rows = ids, labels, rows
        real = rows.astype(float)
        self.lengths = np.sqrt((real**2).sum(1))
        self.longest, self.shortest = self.lengths.max(), self.lengths.min()
        self.unit = (real / np.where(self.lengths > 0, self.lengths, 1)[:, None]).T
        self.order = np.argsort(self.unit, axis=1, kind="stable")
        self.lists = np.take_along_axis(self.unit, self.order, 1)
        self.real = real

    def candidates(self, anchor: np.ndarray, length: float, least: float) -> np.ndarray:
        """Row numbers that may score ``least`` or more."""
        everyone = np.arange(len(self.ids))
        reach = length * (self.longest if least > 0 else self.shortest)
        if least > length * self.longest * (1 + SLACK):
            return everyone[:0]
        if reach <= 0 or not np.isfinite(least):
            return everyone
        cosine = least / reach - SLACK
        if cosine <= -1:
            return everyone
        unit = anchor / length
        focus = np.argsort(-np.abs(unit))[:FOCUS]
        angle, open_ = np.arccos(np.clip(unit[focus], -1, 1)), np.arccos(min(cosine, 1.0))
        low = np.cos(np.minimum(angle + open_, np.pi)) - SLACK
        high = np.cos(np.maximum(angle - open_, 0)) + SLACK
        begin = [np.searchsorted(self.lists[f], x) for f, x in zip(focus, low)]
        end = [np.searchsorted(self.lists[f], x, "right") for f, x in zip(focus, high)]
        ranges = sorted(range(len(focus)), key=lambda k: end[k] - begin[k])
        met = self.order[focus[ranges[0]], begin[ranges[0]]: end[ranges[0]]]
        for k in ranges[1:]:
            if end[k] - begin[k] < len(everyone):  # else the list holds all rows
                values = self.unit[focus[k], met]
                met = met[(values >= low[k]) & (values <= high[k])]
        return met

    def scores(self, anchor: np.ndarray, length: float, met: np.ndarray) -> np.ndarray:
        if length * self.longest < EXACT_FLOAT:
            return (self.real[met] @ anchor.astype(float)).astype(np.int64)
        return (self.rows[met] * anchor).sum(1)


def _searched(pick, columns: list[str]):
    """A cogroup function: ``pick(bucket, anchor row, its vector)`` yields (tag, row numbers, scores)."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in columns})
        width = max(pc.max(pc.list_value_length(t.column("v"))).as_py() for t in (left, right))
        bucket = LengthBucket(left.column("id").to_numpy(), left.column("label").to_numpy(), vectors(left.column("v"), width))
        anchors, asked = vectors(right.column("v"), width), right.drop_columns(["v"]).to_pylist()
        out: list[list[np.ndarray]] = [[] for _ in columns]
        for row, anchor in zip(asked, anchors):
            for tag, at, scores in pick(bucket, row, anchor):
                for held, x in zip(out, (np.full(len(at), row["id"]), np.full(len(at), tag), bucket.ids[at], scores)):
                    held.append(x)
        return pa.table({c: pa.array(np.concatenate(x) if x else [], pa.int64()) for c, x in zip(columns, out)})
    return run


def _best_first(bucket: LengthBucket, anchor: np.ndarray, length: float, least: float, same: int | None, other: int | None, itself: int):
    """Candidates of one label (or of all but one) with their scores, best first, ties by id."""
    met = bucket.candidates(anchor, length, least)
    labels = bucket.labels[met]
    met = met[(labels == same if same is not None else labels != other) & (bucket.ids[met] != itself)]
    scores = bucket.scores(anchor, length, met)
    order = np.lexsort((bucket.ids[met], -scores))
    return met[order], scores[order]


def _positives(count: int):
    def pick(bucket: LengthBucket, row: dict, anchor: np.ndarray) -> Iterator[tuple]:
        least = -np.inf if row["least"] is None else row["least"]
        at, scores = _best_first(bucket, anchor, row["norm2"] ** 0.5, least, row["label"], None, row["id"])
        yield 0, at[:count], scores[:count]
    return pick


def _negatives(count: int, low: int, high: int):
    def pick(bucket: LengthBucket, row: dict, anchor: np.ndarray) -> Iterator[tuple]:
        floors = [max(-(-low * p["score"] // 100), p["least"] if p["least"] is not None else -(1 << 62)) for p in row["positives"]]
        at, scores = _best_first(bucket, anchor, row["norm2"] ** 0.5, min(floors), None, row["label"], row["id"])
        for p, floor in zip(row["positives"], floors):
            begin = np.searchsorted(-scores, -(high * p["score"] // 100))
            end = min(begin + count, np.searchsorted(-scores, -floor, "right"))
            yield p["id"], at[begin:end], scores[begin:end]
    return pick


_FOUND = ["anchor", "positive", "id", "score"]


def _search(rows: DataFrame, anchors: DataFrame, pick, buckets: range, blocks: int) -> DataFrame:
    """All rows of ``buckets`` against all anchors, a bucket and a block at a time."""
    part = rows.where(F.col("_bucket").between(buckets.start, buckets.stop - 1)).select("id", "label", "v", "_bucket")
    left = part.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    right = anchors.withColumn("_bucket", F.explode(F.sequence(F.lit(buckets.start), F.lit(buckets.stop - 1)).cast("array<long>")))
    found = left.groupBy("_bucket", "_block").cogroup(right.groupBy("_bucket", "_block")).applyInArrow(
        _searched(pick, _FOUND), ", ".join(f"{c} long" for c in _FOUND))
    return found


def _top(found: DataFrame, keys: list[str], count: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def _both_rounds(rows: DataFrame, anchors: DataFrame, asked, pick, keys: list[str], count: int, buckets: int, blocks: int) -> DataFrame:
    """The first bucket without bounds, then the others with those it gave."""
    first = written_table(_top(_search(rows, asked(anchors, None), pick, range(0, 1), blocks), keys, count), "first-bucket")
    if buckets == 1:
        return first
    bounds = first.where(F.col("rank") == count).select(*keys, F.col("score").alias("_least"))
    rest = _search(rows, asked(anchors, bounds), pick, range(1, buckets), blocks)
    return written_table(_top(first.select(*_FOUND).unionByName(rest), keys, count), "all-buckets")


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``id, label, v, norm2`` rows.

    Scores are integer inner products, larger first, ties by smaller id.  An
    anchor's positives are the best ``positives`` other rows of its label; its
    negatives for each are the best rows of other labels whose score is
    ``low`` to ``high`` percent of the positive's.  Vectors of different widths
    are compared as if zeros followed.  Empty tables, anchors without positives
    and positives without negatives give no row.
    """
    indexed = dense_index(rows.withColumn("_short", -F.col("norm2")), ["_short", "id"], name="_at").drop("_short")
    rows = written_table(indexed.withColumn("_bucket", F.floor(F.col("_at") / BUCKET_ROWS)).drop("_at"), "length-buckets")
    anchors = written_table(dense_index(rows.where(is_anchor).drop("_bucket"), ["id"], name="_at").withColumn(
        "_block", F.floor(F.col("_at") / BUCKET_ROWS)).drop("_at"), "anchors")
    buckets, blocks = ((df.agg(F.max(c)).first()[0] or 0) + 1 for df, c in ((rows, "_bucket"), (anchors, "_block")))

    def asked_positives(anchors: DataFrame, bounds: DataFrame | None) -> DataFrame:
        if bounds is None:
            return anchors.withColumn("least", F.lit(None).cast("long"))
        return anchors.join(bounds.select(F.col("anchor").alias("id"), F.col("_least").alias("least")), "id", "left")

    best = _both_rounds(rows, anchors, asked_positives, _positives(positives), ["anchor"], positives, buckets, blocks)
    pairs = best.where("score >= 0").select("anchor", F.col("id").alias("positive"), F.col("score").alias("positive_score"))

    def asked_negatives(anchors: DataFrame, bounds: DataFrame | None) -> DataFrame:
        each = pairs.withColumn("_least", F.lit(None).cast("long")) if bounds is None else pairs.join(
            bounds, ["anchor", "positive"], "left")
        lists = each.groupBy(F.col("anchor").alias("id")).agg(F.collect_list(F.struct(
            F.col("positive").alias("id"), F.col("positive_score").alias("score"), F.col("_least").alias("least"))).alias("positives"))
        return anchors.join(lists, "id")

    keys = ["anchor", "positive"]
    mined = _both_rounds(rows, anchors, asked_negatives, _negatives(negatives, low, high), keys, negatives, buckets, blocks)
    return mined.join(pairs, keys).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
