"""Quality verdicts by boosted trees over document statistics.

One pass over the texts makes the statistics, applies the base rules and scores
the trees.  The trees are fitted on a bounded sample of labelled documents.
Scores cannot rise with symbols, repeated lines, repeated words, capitals or
exclamation marks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm import boosting
from tidecast.llm.samples import labelled_sample
from tidecast.llm.words import U64, find_words, mixed, prefix_sums, range_hashes, slices, window_hashes

FIT_ROWS = 8_000   # labelled documents that the trees see
LEAST_SCORE = 0.5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = {  # name: direction in which the score may move
    "word_length": 0, "symbols": -1, "dup_lines": -1, "repeat_words": -1, "capitals": -1,
    "exclamations": -1, "bars": 0, "digits": 0, "stops": 0, "line_words": 0, "short_words": 0,
}


def _class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_SYMBOL = _class(b"#*$%&|<>")
_KINDS = {"upper": _class(bytes(range(65, 91))), "lower": _class(bytes(range(97, 123))), "digit": _class(b"0123456789"),
          "bang": _class(b"!"), "bar": _class(b"|"), "stop": _class(b".,;:?")}


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The base counts and the features of each text."""
    words = find_words(texts, lower=False)
    data, offsets, n_docs = words.data, words.offsets, len(words.offsets) - 1
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    n_words = np.diff(words.first)
    doc_of = np.repeat(np.arange(n_docs), n_words)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    length = points[words.ends] - points[words.starts]
    per_doc = lambda weights: np.bincount(doc_of, weights, n_docs)

    sums = prefix_sums(data)
    hashes = range_hashes(sums, words.starts, words.ends)
    windows = window_hashes(hashes)
    inside = doc_of[: len(windows)] == doc_of[len(doc_of) - len(windows):]
    at = np.flatnonzero(inside)
    keys = mixed(windows[at] + doc_of[at].astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = at[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]] if len(at) else at
    edges = np.bincount(twice, minlength=len(doc_of) + 1) - np.bincount(twice + 5, minlength=len(doc_of) + 1)[: len(doc_of) + 1]
    repeated = per_doc(np.cumsum(edges)[: len(doc_of)] > 0)

    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_doc = np.searchsorted(offsets, line_starts, side="right") - 1
    line_ends = np.append(line_starts[1:], len(data))
    line_ends -= (data[line_ends - 1] == 10) if len(line_ends) else 0
    some = np.searchsorted(words.starts, line_ends) > np.searchsorted(words.starts, line_starts)
    line_doc, line_starts, line_ends = line_doc[some], line_starts[some], line_ends[some]
    line_keys = mixed(range_hashes(sums, line_starts, line_ends) + line_doc.astype(U64) * U64(0x9E3779B97F4A7C15))
    lines = np.bincount(line_doc, minlength=n_docs)
    first_lines = line_doc[np.unique(line_keys, return_index=True)[1]]
    dup_lines = lines - np.bincount(first_lines, minlength=n_docs)

    word_chars, symbols = per_doc(length), count(_SYMBOL[data])
    kinds = {k: count(m[data]) for k, m in _KINDS.items()}
    base = np.stack([n_words, word_chars, symbols, dup_lines, repeated], axis=1).astype(np.int64)
    n = np.maximum(n_words, 1)
    features = np.stack([
        word_chars / n, symbols / n, dup_lines / np.maximum(lines, 1), repeated / n,
        kinds["upper"] / np.maximum(kinds["upper"] + kinds["lower"], 1), kinds["bang"] / n, kinds["bar"] / n,
        kinds["digit"] / np.maximum(word_chars, 1), kinds["stop"] / n, n_words / np.maximum(lines, 1),
        per_doc(length <= 2) / n,
    ], axis=1)
    return base, features


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            _, features = statistics(part.column("text"))
            flat = pa.array(features.ravel(), pa.float64())
            ends = pa.array(np.arange(len(features) + 1) * len(FEATURES), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("_label"), pa.ListArray.from_arrays(ends, flat)], names=["label", "features"])


def fit_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> boosting.Trees | None:
    """Trees from at most ``fit_rows`` labelled documents; None without both labels."""
    sample = labelled_sample(docs, labels, "quality", fit_rows).mapInArrow(_feature_rows, "label int, features array<double>")
    rows = sorted((r["label"], r["features"]) for r in sample.collect())
    y = np.array([r[0] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return None
    return boosting.fit(np.array([r[1] for r in rows]), y, np.array(list(FEATURES.values())))


def _verdicts(trees: boosting.Trees | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                base, features = statistics(part.column("text"))
                score = trees.probability(features) if trees else np.ones(len(base))
                failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
                kept = ~failed & (score >= LEAST_SCORE)
                at = part.schema.get_field_index("text")
                rest = [part.column(i) for i in range(part.num_columns) if i != at]
                names = [n for i, n in enumerate(part.schema.names) if i != at]
                yield pa.RecordBatch.from_arrays(
                    rest + [pa.array(base[:, k]) for k in range(len(BASE))] + [pa.array(x) for x in (failed, kept, score)],
                    names=[*names, *BASE, "base_failed", "kept", "score"])
    return run


def quality_verdicts(docs: DataFrame, trees: boosting.Trees | None) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``kept`` and ``score`` of each row.

    ``base_failed``: fewer than 10 words, or more than 20 in 100 of them in
    5-word windows that the text repeats.  Null and empty texts have no words
    and fail.  Null ids stay null, repeated rows are judged alike, and without
    trees (no labels of both kinds) the base rules decide alone.

    A text is held whole in a task, at about 40 times its bytes; an empty table
    gives no row.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = ", ".join(f"{c} long" for c in BASE)
    return source.mapInArrow(_verdicts(trees), f"doc_id long, {counts}, base_failed boolean, kept boolean, score double")


def _passing(trees: boosting.Trees | None):
    judge = _verdicts(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                for told in judge(iter([part])):
                    yield part.filter(told.column(told.num_columns - 2))
    return run


def passing_documents(docs: DataFrame, trees: boosting.Trees | None) -> DataFrame:
    """The rows of ``docs`` whose verdict is to keep them, with all their columns."""
    return docs.mapInArrow(_passing(trees), docs.schema)
