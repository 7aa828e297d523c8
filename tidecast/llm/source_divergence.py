"""How far the sources of a language are apart, term by term and pair by pair.

Terms are counted per language and source; a language keeps the terms that
enough of its documents hold.  Kept terms are numbered in order, and a group
(language, source) becomes sorted arrays of term numbers and counts, one for
each stretch of ``BLOCK`` numbers, so no array grows with the vocabulary.

For every unordered pair of a language's groups and every stretch, the two
groups' arrays meet in a cogroup.  A galloping search finds the numbers both
hold; these, the numbers only one holds, and those neither holds (which need
only be counted) are priced, and the sum is the same both ways.

Shares are integers: 1 + floor(SCALE * (count + SMOOTH) / (all + SMOOTH * terms)),
by long division, so that no product leaves 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.words import LOWER, slices, text_bytes
from tidecast.operators.order import dense_index
from tidecast.storage import written_table

LEAST_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
BLOCK = 65_536
STEP = 64  # needles that gallop from one place

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _lettered(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of a batch, lower-cased, and the number of each one's document."""
    data, offsets = text_bytes(texts)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(LOWER[data[inside[1:-1]]]))
    return terms, np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, offsets)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of a language and source, a slice at a time."""
    for batch in batches:
        for part in slices(batch, max_bytes=4 << 20):
            terms, doc = _lettered(part.column("text"))
            coded = terms.dictionary_encode()
            width = max(1, len(coded.dictionary))
            pairs, times = np.unique(doc * width + coded.indices.to_numpy(), return_counts=True)
            langs, sources = part.column("lang").dictionary_encode(), part.column("source").dictionary_encode()
            group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            keys, place = np.unique(group[pairs // width] * width + pairs % width, return_inverse=True)
            group, term = keys // width, keys % width
            yield pa.RecordBatch.from_arrays([
                langs.dictionary.take(pa.array(group // len(sources.dictionary))),
                sources.dictionary.take(pa.array(group % len(sources.dictionary))),
                coded.dictionary.take(pa.array(term)).cast(pa.string()),
                pa.array(np.bincount(place, times, len(keys)).astype(np.int64)), pa.array(np.bincount(place, minlength=len(keys)))],
                names=["lang", "source", "term", "n", "docs"])


def share(count: Column, smoothed: Column) -> Column:
    top = (count + SMOOTH).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", top, smoothed.cast("decimal(19,0)")) + 1


def shares(counts: np.ndarray, smoothed: int) -> np.ndarray:
    """Like ``share``, by long division: exact while ``smoothed`` is below 9 * 10**15."""
    whole, rest = np.divmod(counts + SMOOTH, smoothed)
    for _ in range(3):  # SCALE is 1000 ** 3
        digits, rest = np.divmod(rest * 1000, smoothed)
        whole = whole * 1000 + digits
    return whole + 1


def galloping(needles: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """For each of the sorted needles the first place in ``sorted_`` that is not below it.

    Every ``STEP``-th needle is looked up; the ones after it start from there
    and double their stride until they have passed, then halve the last stride.
    """
    n = len(sorted_)
    if not n:
        return np.zeros(len(needles), np.int64)
    low = np.repeat(np.searchsorted(sorted_, needles[::STEP]), STEP)[: len(needles)]
    high, stride, active = low.copy(), 1, np.arange(len(needles))
    while len(active):
        at = high[active]
        active = active[(at < n) & (sorted_[np.minimum(at, n - 1)] < needles[active])]
        low[active] = high[active] + 1
        high[active] = np.minimum(high[active] + stride, n)
        stride *= 2
    active = np.flatnonzero(low < high)
    while len(active):
        middle = (low[active] + high[active]) // 2
        below = sorted_[middle] < needles[active]
        low[active[below]] = middle[below] + 1
        high[active[~below]] = middle[~below]
        active = active[low[active] < high[active]]
    return low


def priced(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int]) -> tuple[int, int]:
    """Summed differences over the terms that either group holds, and how many these are.

    A group is its sorted term numbers, their counts and its smoothed total.
    """
    (ids, counts, smoothed), (ids2, counts2, smoothed2) = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    p, q = shares(counts, smoothed), shares(counts2, smoothed2)
    none, none2 = (int(shares(np.zeros(1, np.int64), x)[0]) for x in (smoothed, smoothed2))
    if not len(ids):
        return int(np.abs(q - none).sum()), len(ids2)
    at = galloping(ids, ids2)
    both = at < len(ids2)
    both[both] = ids2[at[both]] == ids[both]
    alone = np.ones(len(ids2), bool)
    alone[at[both]] = False
    total = np.abs(p[both] - q[at[both]]).sum() + np.abs(p[~both] - none2).sum() + np.abs(q[alone] - none).sum()
    return int(total), len(ids) + int(alone.sum())


_SIDE = ("smoothed_a", "smoothed_b", "ids", "counts")
_PRICED = "lang string, a string, b string, value long, held long"


def _pair_task(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """One stretch of two groups; a side without terms there has no row."""
    left, right = (t.select([f"{c}_{k}" for c in _SIDE]).rename_columns(_SIDE) for k, t in enumerate((left, right)))
    sizes = (left if left.num_rows else right).select(["smoothed_a", "smoothed_b"]).to_pylist()[0]

    def side(table: pa.Table, smoothed: int) -> tuple[np.ndarray, np.ndarray, int]:
        ids, counts = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("ids", "counts"))
        return ids, counts, smoothed

    value, held = priced(side(left, sizes["smoothed_a"]), side(right, sizes["smoothed_b"]))
    return pa.table({"lang": [key[0]], "a": [key[1]], "b": [key[2]], "value": [value], "held": [held]},
                    schema=pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64()), ("held", pa.int64())]))


def term_counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``groups`` (lang, source, smoothed, lang_smoothed, terms) and ``entries`` (kept terms that occur, with their group's count).

    All rows count, repeated ones and rows without an id too.  Null text, lang
    and source are empty.
    """
    source = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = written_table(source.mapInArrow(_count, "lang string, source string, term string, n long, docs long").groupBy(
        "lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(
        F.col("docs") >= LEAST_DOCS).drop("docs")
    numbered = written_table(dense_index(kept, ["lang", "term"], name="id"), "kept-terms")
    entries = written_table(counts.drop("docs").join(numbered, ["lang", "term"]), "entries")
    langs = numbered.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_all"))
    sizes = entries.groupBy("lang", "source").agg(F.sum("n").alias("all"))
    known = lambda c: F.coalesce(c, F.lit(0))
    groups = source.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", known("terms").alias("terms"),
        (known("all") + SMOOTH * known("terms")).alias("smoothed"), (known("lang_all") + SMOOTH * known("terms")).alias("lang_smoothed"))
    return written_table(groups, "groups"), entries


def pair_differences(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """``lang, a, b, value`` of each unordered pair (``a < b``) of a language's sources."""
    arrays = entries.groupBy("lang", "source", F.floor(F.col("id") / BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("id", "n"))).alias("x")).select(
        "lang", "source", "block", F.col("x.id").alias("ids"), F.col("x.n").alias("counts"))
    arrays = written_table(arrays, "sparse-arrays")
    one = lambda name: groups.select("lang", F.col("source").alias(name), F.col("smoothed").alias(f"smoothed_{name}"), "terms")
    pairs = written_table(one("a").join(one("b").drop("terms"), "lang").where("a < b"), "pairs")
    tasks = pairs.drop("terms")
    key = ["lang", "a", "b", "block"]
    left, right = (arrays.withColumnRenamed("source", side).join(tasks, ["lang", side]).select(
        *[F.col(c).alias(f"{c}_{k}") for c in (*key, *_SIDE)]) for k, side in enumerate(("a", "b")))
    left, right = (df.groupBy(*[f"{c}_{k}" for c in key]) for k, df in enumerate((left, right)))
    found = left.cogroup(right).applyInArrow(_pair_task, _PRICED).groupBy("lang", "a", "b").agg(
        F.sum("value").alias("value"), F.sum("held").alias("held"))
    none = lambda side: share(F.lit(0).cast("long"), F.col(f"smoothed_{side}"))
    absent = (F.col("terms") - F.coalesce("held", F.lit(0))) * F.abs(none("a") - none("b"))
    return pairs.join(found, ["lang", "a", "b"], "left").select(
        "lang", "a", "b", F.when(F.col("terms") > 0, F.coalesce("value", F.lit(0)) + absent).otherwise(0).alias("value"))


def source_divergence(docs: DataFrame) -> DataFrame:
    """``lang, source, part, item, value, rank`` for rows with ``text, lang, source``; other columns are ignored.

    Part ``pair`` has every other source of the language with the summed
    difference of the two groups' shares over all kept terms; part ``term`` the
    ``TOP_TERMS`` terms that the group uses most beyond its language.  Larger
    values rank first, ties by the item's bytes.  Languages without kept terms
    have pairs of value 0; a language of one source has no pairs; an empty table
    gives no row.  A text is held whole in a task, at about 30 times its bytes.
    """
    groups, entries = term_counts(docs)
    pairs = pair_differences(groups, entries).select("lang", "value", F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x")).select(
        "lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    above = entries.join(groups, ["lang", "source"]).withColumns({
        "p": share(F.col("n"), F.col("smoothed")), "q": share(F.col("lang_n"), F.col("lang_smoothed"))}).where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return pairs.withColumn("rank", rank).unionByName(above.withColumn("rank", rank).where(F.col("rank") <= TOP_TERMS))
