"""A probabilistic suffix tree over the letters of texts, and a unigram base.

A text is its lower-cased words, joined by single spaces, and an end.  Contexts
of up to seven symbols become nodes of the tree if they occur ``LEAST_COUNT``
times and their next symbols diverge from those of the context one symbol
shorter; so do all suffixes of nodes.  A node's distribution is smoothed
towards that of the node one symbol shorter.

The tree grows over three passes.  The first counts all runs of four symbols.
A context can be frequent only if it is a frequent run and so are its parts:
the runs of four (then six) symbols seen often are handed to the workers, and
a pass counts next symbols only behind these.  Counts of frequent contexts are
complete, rarer ones never leave a worker in number.  Counts travel packed, many
keys to a row; all that concern a context meet in one part, which is added up
in arrays, and contexts that are not frequent end there.

For scoring, nodes and next symbols are tables of 64-bit keys.  A symbol is
looked up behind the seven before it, then behind fewer, until it is found; a
longer node that never saw it adds the weight of its parent.

Nothing is left out for being too much to hand out at once: more runs, or more
next symbols, than one table takes are dealt into blocks, and each block has a
pass of its own.  A symbol belongs to the block of its context, so each is
counted, and scored, in one pass only.

The unigram base needs the count of each word.  Words above a share of all
tokens are shipped (a bounded number); pairs of document and rarer word meet
their counts in a join, and rare words are no hot keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.words import LOWER, U64, WHITE, find_words, lists, mixed, slices, text_bytes
from tidecast.storage import written_table

DEPTH = 7
FIRST = 3                # contexts of up to so many symbols are counted without candidates
LEAST_COUNT = 2000       # occurrences of a context, at any size of corpus
CANDIDATES = 4_000_000   # runs handed to workers in a pass: 48 MB; more take more passes
ENTRIES = 6_000_000      # next symbols of nodes shipped for a pass of scoring: 110 MB; more take more passes
TAIL = 3                 # last symbols of a context that tell the block it is scored in
DIVERGENCE = 0.01        # nats between a context and the one a symbol shorter
TOWARDS_PARENT = 20.0    # observations that the parent's distribution counts for
SHIPPED_SHARE = 2.5e-7   # of all tokens: at most 4 million words are shipped
PAD, END, SPACE = 0x0B, 0x0A, 0x20  # white space, so never in a word


@dataclass
class Stream:
    symbols: np.ndarray   # per document DEPTH pads, its text, an end
    ends: np.ndarray      # of documents, in symbols that are no pads
    starts: np.ndarray


def streamed(texts: pa.Array) -> Stream:
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    white = np.concatenate([WHITE[data], [True]])
    # A text's bytes, and of the white space before a word one place, unless no word comes before it.
    kept = ~white[:-1] | ~white[1:]
    some = np.diff(offsets) > 0
    edges, after = offsets[:-1][some], offsets[1:][some]
    kept[after - 1] &= ~white[after - 1]
    for begin, end in zip(edges[white[edges]].tolist(), after[white[edges]].tolist()):  # before a text's first word
        inside = np.flatnonzero(~white[begin:end])
        kept[begin: begin + (inside[0] if len(inside) else end - begin)] = False
    body = data[kept]
    body[white[:-1][kept]] = SPACE
    sizes = np.ones(len(texts), np.int64)
    if len(edges):
        sizes[some] += np.add.reduceat(kept, edges, dtype=np.int64)
    ends = np.cumsum(sizes)
    symbols = np.full(ends[-1] + DEPTH * len(sizes) if len(sizes) else 0, PAD, np.uint8)
    starts = ends - sizes
    text = np.ones(len(symbols), bool)
    first = starts + DEPTH * np.arange(len(sizes))
    text[(first[:, None] + np.arange(DEPTH)).ravel()] = False
    at_end = first + DEPTH + sizes - 1
    text[at_end] = False
    symbols[text] = body
    symbols[at_end] = END
    return Stream(symbols, ends, starts)


def grams(stream: Stream) -> np.ndarray:
    """Each text symbol with the DEPTH ones before it, the oldest in the highest byte."""
    n = len(stream.symbols) - DEPTH
    if n <= 0:
        return np.zeros(0, U64)
    eight = np.ndarray((n,), ">u8", buffer=stream.symbols, strides=(1,)).astype(U64)
    real = np.ones(n, bool)  # the pads of all texts but the first
    pads = stream.ends[:-1, None] + DEPTH * np.arange(len(stream.ends) - 1)[:, None] + np.arange(DEPTH)
    real[pads.ravel()] = False
    return eight[real]


def low_bytes(n: int) -> U64:
    return U64((1 << 8 * n) - 1)


def _blocks(size: int, most: int) -> int:
    """Blocks for so many keys; with several, each is half full on average, so that uneven ones fit."""
    return 1 if size <= most else 2 * size // most + 1


def _block(key: Column, blocks: int) -> Column:
    folded = key.bitwiseXOR(F.shiftrightunsigned(key, 16)).bitwiseXOR(F.shiftrightunsigned(key, 32)).bitwiseAND(F.lit(0xFFFF))
    return F.shiftrightunsigned(folded.cast("long") * F.lit(40503), 4) % F.lit(blocks)


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    """The same for an array."""
    folded = (keys ^ keys >> U64(16) ^ keys >> U64(32)) & U64(0xFFFF)
    return (folded * U64(40503) >> U64(4)) % U64(blocks)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts[order], at)


PARTS = 1024  # that tallies are dealt into to be added up


class Tally:
    """Counts of 64-bit keys.  What is held is put out whenever it has grown large.

    A row holds many keys: those of one part, told by the last symbols of a run
    before its next one (all bits of other keys), in order, and their counts.
    """

    HELD = 1_000_000

    def __init__(self, kind: int, last: int | None = None):
        self.kind, self.last, self.parts, self.held = kind, last, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        if len(keys):
            self.parts.append(np.unique(keys, return_counts=True) if counts is None else summed(keys, counts))
            self.held += len(self.parts[-1][0])
            if self.held > 2 * self.HELD:
                self._merge()
                if self.held > self.HELD:
                    yield from self.flush()

    def _merge(self) -> None:
        self.parts = [summed(*map(np.concatenate, zip(*self.parts)))]
        self.held = len(self.parts[0][0])

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._merge()
            keys, counts = self.parts[0]
            self.parts, self.held = [], 0
            of = mixed(keys if self.last is None else keys >> U64(8) & low_bytes(self.last)) % U64(PARTS)
            order = np.argsort(of.astype(np.uint16), kind="stable")
            keys, counts, of = keys[order], counts[order].astype(np.int64), of[order]
            at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            ends = np.append(at, len(keys)) * 8
            for lo in range(0, len(at), 128):
                rows = slice(lo, lo + 128)
                cut = ends[lo: lo + 129]
                n = len(cut) - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(of[at[rows]].astype(np.int32)), pa.array(np.full(n, self.kind, np.int32)),
                    *(pa.Array.from_buffers(pa.binary(), n, [
                        None, pa.py_buffer((cut - cut[0]).astype(np.int32)), pa.py_buffer(x[cut[0] // 8: cut[-1] // 8])])
                      for x in (keys, counts))],
                    names=["part", "kind", "keys", "counts"])


def _added(batches: Iterator[pa.RecordBatch]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By kind, all keys of the tallies of a partition and the sums of their counts."""
    held: dict[int, list] = {}
    size: dict[int, int] = {}
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        for kind in np.unique(kinds).tolist():
            own = batch.filter(pa.array(kinds == kind))
            keys, counts = (np.frombuffer(b"".join(own.column(c).to_pylist()), t) for c, t in (("keys", U64), ("counts", np.int64)))
            held.setdefault(kind, []).append(summed(keys, counts))
            if sum(len(k) for k, _ in held[kind]) > max(2 * size.get(kind, 0), 1_000_000):
                held[kind] = [summed(*map(np.concatenate, zip(*held[kind])))]
                size[kind] = len(held[kind][0][0])
    return {kind: summed(*map(np.concatenate, zip(*parts))) for kind, parts in held.items()}


def _put_out(name: str, kind: int, column: str, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(keys), 50_000):
        k = keys[lo: lo + 50_000]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(counts[lo: lo + 50_000])],
            names=[name, column, "n"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``kind, key, n``."""
    for kind, (keys, counts) in _added(batches).items():
        yield from _put_out("kind", kind, "key", keys, counts)


def _frequent_runs(depth: int, least: int):
    """``d, gram, n`` of contexts of ``depth`` and one more symbol that occur ``least`` times.

    All runs of a context of either length are in one part, so its count is whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, U64), np.zeros(0, np.int64)
        found = _added(batches)
        shorter, longer = found.get(depth, none), found.get(depth + 1, none)
        keys = np.concatenate([shorter[0], longer[0] & low_bytes(depth + 1)])
        if not len(keys):
            return
        for d, (grams, n) in ((depth, summed(keys, np.concatenate([shorter[1], longer[1]]))), (depth + 1, longer)):
            if len(grams):
                context = grams >> U64(8)
                at = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
                often = np.repeat(np.add.reduceat(n, at) >= least, np.diff(np.append(at, len(grams))))
                yield from _put_out("d", d, "gram", grams[often], n[often])
    return run


_WORDS, _DOCS = -1, -2  # kinds of tallies; others are the length of the contexts counted


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, documents and short runs of symbols of training rows."""
    words, runs, docs = Tally(_WORDS), Tally(FIRST), Tally(_DOCS)
    for batch in batches:
        for part in slices(batch):
            yield from words.add(find_words(part.column("text"), lower=True).hashes())
            yield from runs.add(grams(streamed(part.column("text"))) & low_bytes(FIRST + 1))
            yield from docs.add(np.zeros(part.num_rows, U64))
    for tally in (words, runs, docs):
        yield from tally.flush()


def _extended(depth: int, shipped, block: int, blocks: int):
    """Count what follows contexts of ``depth`` and one more symbol that are made of candidates.

    A context is counted in the block of its last ``depth`` symbols; candidates of
    other blocks are not at hand, so what might be one counts as one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        candidates, shorter, longer = shipped.value, Tally(depth, depth), Tally(depth + 1, depth)
        for batch in batches:
            for part in slices(batch):
                keys, times = np.unique(grams(streamed(part.column("text"))), return_counts=True)
                known = candidates.find(keys >> U64(8) & low_bytes(depth)) >= 0
                keys, times = keys[known], times[known]
                # The context one longer holds a candidate's run at its other end too.
                other = keys >> U64(16) & low_bytes(depth)
                both = candidates.find(other) >= 0
                if blocks > 1:
                    both |= block_of(other, blocks) != U64(block)
                yield from longer.add(keys[both] & low_bytes(depth + 2), times[both])
                yield from shorter.add(keys[~both] & low_bytes(depth + 1), times[~both])
        for tally in (shorter, longer):
            yield from tally.flush()
    return run


class KeyTable:
    """Places of 64-bit keys, found by the first bits of their hashes."""

    def __init__(self, keys: np.ndarray):
        hashes = mixed(keys)
        self.order = np.argsort(hashes)  # places: keys[order]
        self.hashes = np.append(hashes[self.order], U64(0))  # one more, so that any place can be looked at
        bits = max(1, int(len(keys)).bit_length())
        self.shift = U64(64 - bits)
        self.first = np.searchsorted(self.hashes[:-1] >> self.shift, np.arange((1 << bits) + 1, dtype=U64)).astype(np.uint32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        hashes = mixed(keys)
        bucket = (hashes >> self.shift).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        met = (self.hashes[at] == hashes) & (at < end)
        out = np.where(met, at.astype(np.int32), np.int32(-1))
        active = np.flatnonzero(~met & (at + np.uint32(1) < end))
        at, end, hashes = at[active] + np.uint32(1), end[active], hashes[active]
        while len(active):
            met = self.hashes[at] == hashes
            out[active[met]] = at[met]
            rest = np.flatnonzero(~met & (at + np.uint32(1) < end))
            active, at, end, hashes = active[rest], at[rest] + np.uint32(1), end[rest], hashes[rest]
        return out


class BackoffTree:
    """Log10 probabilities of symbols behind the longest suffix kept."""

    def __init__(self, keys: list[np.ndarray], counts: list[np.ndarray]):
        """``keys[d]``: sorted runs of kept contexts of ``d`` symbols and their next symbol; ``counts[d]``: how often."""
        n = np.zeros(256)
        if len(keys[0]):
            n[keys[0].astype(np.int64)] = counts[0]
        self.single = np.log10((n + 0.5) / (n.sum() + 0.5 * 256))
        self.levels: list[tuple | None] = [None]
        for d in range(1, DEPTH + 1):
            if not len(keys[d]):
                self.levels.append(None)
                continue
            up = self.log10(keys[d], d - 1)
            context = keys[d] >> U64(8)
            at = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
            every = np.add.reduceat(counts[d], at)
            of = np.repeat(every, np.diff(np.append(at, len(context))))
            p = np.log10((counts[d] + TOWARDS_PARENT * 10**up) / (of + TOWARDS_PARENT))
            entries, nodes = KeyTable(keys[d]), KeyTable(context[at])
            weight = np.log10(TOWARDS_PARENT / (every + TOWARDS_PARENT))
            self.levels.append((entries, p[entries.order].astype(np.float32), nodes, weight[nodes.order].astype(np.float32)))
            del entries.order, nodes.order

    def log10(self, keys: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        """Of the lowest byte of each key behind at most ``depth`` bytes above it."""
        out, level, active = np.zeros(len(keys)), np.zeros(len(keys), np.int8), np.arange(len(keys))
        rest = keys
        for d in range(depth, 0, -1):
            if self.levels[d] is not None:
                entries, p, _, _ = self.levels[d]
                at = entries.find(rest & low_bytes(d + 1))
                met = np.flatnonzero(at >= 0)
                out[active[met]], level[active[met]] = p[at[met]], d
                missed = np.flatnonzero(at < 0)
                active, rest = active[missed], rest[missed]
        out[active] = self.single[(rest & U64(255)).astype(np.int64)]
        for d in range(1, depth + 1):  # a longer context may be a node that never saw the symbol
            if self.levels[d] is None:
                break
            _, _, nodes, weight = self.levels[d]
            rows = np.flatnonzero(level == d - 1)
            at = nodes.find(keys[rows] >> U64(8) & low_bytes(d))
            met = at >= 0
            out[rows[met]] += weight[at[met]]
            level[rows[met]] = d
        return out


@dataclass
class LanguageModel:
    counts: DataFrame        # key, n of each training word
    train_tokens: int        # ends included
    distinct: int
    train_docs: int
    shipped: object          # broadcast of sorted keys and counts of common words
    grown: DataFrame         # d, gram, n: next symbols of kept contexts of d symbols
    blocks: int              # that the kept contexts are shipped in


def _short_runs(counted: DataFrame) -> DataFrame:
    """``d, gram, n``: next symbols of contexts of up to ``FIRST`` symbols."""
    each = counted.where(F.col("kind") == FIRST).select(F.explode(F.sequence(F.lit(0), F.lit(FIRST))).alias("d"), "key", "n")
    gram = F.expr("key & shiftrightunsigned(-1L, 56 - 8 * d)")
    return written_table(each.groupBy("d", gram.alias("gram")).agg(F.sum("n").alias("n")), "runs")


def _candidates(often: DataFrame, depth: int, block: int, blocks: int) -> KeyTable:
    """Frequent runs of ``depth`` symbols, and the pads before a text; those of one block."""
    own = often if blocks == 1 else often.where(_block(F.col("gram"), blocks) == block)
    pads = np.array([int.from_bytes(bytes([PAD] * depth), "big")], U64)
    keys = own.select("gram").toArrow().column(0).to_numpy().view(U64)
    table = KeyTable(np.append(keys, pads[block_of(pads, blocks) == U64(block)]))
    del table.order
    return table


def _kept(runs: DataFrame, least: int) -> DataFrame:
    """``d, gram, n``: runs of kept contexts of ``d`` symbols and their next symbol with counts."""
    counted = runs.select("d", F.shiftrightunsigned("gram", 8).alias("ctx"), "gram", "n")
    frequent = written_table(counted.groupBy("d", "ctx").agg(F.sum("n").alias("all")).where(
        (F.col("all") >= least) | (F.col("d") == 0)), "frequent-contexts")
    child = written_table(counted.join(frequent, ["d", "ctx"]), "frequent")
    symbol = F.col("gram").bitwiseAND(F.lit(255))
    parent = child.select((F.col("d") + 1).alias("d"), F.col("ctx").alias("up"), symbol.alias("symbol"),
                          (F.col("n") / F.col("all")).alias("q"))
    shorter = F.when(F.col("d") == 1, F.lit(0).cast("long")).otherwise(F.expr("ctx & shiftrightunsigned(-1L, 72 - 8 * d)"))
    p = F.col("n") / F.col("all")
    apart = child.where("d > 0").withColumn("up", shorter).withColumn("symbol", symbol).join(
        parent, ["d", "up", "symbol"]).groupBy("d", "ctx").agg(F.sum(p * F.log(p / F.col("q"))).alias("divergence"))
    suffixes = apart.where(F.col("divergence") >= DIVERGENCE).select(F.explode(F.sequence(F.lit(1), "d")).alias("d"), "ctx").select(
        "d", F.expr("ctx & shiftrightunsigned(-1L, 64 - 8 * d)").alias("ctx")).distinct()
    return written_table(child.join(suffixes, ["d", "ctx"], "left_semi").select("d", "gram", "n").unionByName(
        child.where("d = 0").select("d", "gram", "n")), "grown")


def _tree(grown: DataFrame, block: int, blocks: int) -> BackoffTree:
    """Contexts shorter than ``TAIL``, and the longer ones of one block."""
    tail = F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit(int(low_bytes(TAIL))))
    own = grown if blocks == 1 else grown.where((F.col("d") < TAIL) | (_block(tail, blocks) == block))
    found = own.toArrow()
    d, gram, n = (found.column(c).to_numpy() for c in ("d", "gram", "n"))
    keys, counts = [], []
    for depth in range(DEPTH + 1):
        at = np.flatnonzero(d == depth)
        at = at[np.argsort(gram[at].view(U64))]
        keys.append(gram[at].view(U64))
        counts.append(n[at])
    return BackoffTree(keys, counts)


def fit_language_model(docs: DataFrame, where: Column, least_count: int | None = None) -> LanguageModel:
    """Count all rows of ``docs`` that meet ``where`` (null texts: empty) and grow the tree."""
    spark, least = docs.sparkSession, least_count or LEAST_COUNT
    training = docs.where(where).select(F.col("text").cast("string").alias("text"))

    def tallied(count, add, schema: str) -> DataFrame:
        dealt = training.mapInArrow(count, "part int, kind int, keys binary, counts binary").repartition("part")
        return written_table(dealt.mapInArrow(add, schema), "counts")

    counts = tallied(_count, _sums, "kind int, key long, n long")
    runs = _short_runs(counts)
    for depth in range(FIRST + 1, DEPTH, 2):
        often = runs.where((F.col("d") == depth - 1) & (F.col("n") >= least))
        blocks = _blocks(often.count(), CANDIDATES)
        for block in range(blocks):
            shipped = spark.sparkContext.broadcast(_candidates(often, depth, block, blocks))
            runs = runs.unionByName(tallied(
                _extended(depth, shipped, block, blocks), _frequent_runs(depth, least), "d int, gram long, n long"))
            shipped.unpersist()
    words = counts.where(F.col("kind") == _WORDS).select("key", "n")
    all_words = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    train_docs = counts.where(F.col("kind") == _DOCS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tokens = all_words[0] + train_docs
    often = words.where(F.col("n") >= max(1, SHIPPED_SHARE * tokens)).toArrow()
    keys, n = often.column(0).to_numpy().view(U64), often.column(1).to_numpy()
    order = np.argsort(keys)
    shipped = spark.sparkContext.broadcast((keys[order], n[order]))
    grown = _kept(runs, least)
    return LanguageModel(words, tokens, all_words[1] + (train_docs > 0), train_docs, shipped, grown, _blocks(grown.count(), ENTRIES))


def _text_scores(stream: Stream, tree: BackoffTree, block: int, blocks: int) -> np.ndarray:
    """Per text, the sum over the symbols of a block."""
    keys = grams(stream)
    if blocks == 1:
        return np.add.reduceat(tree.log10(keys), stream.starts)
    own = np.flatnonzero(block_of(keys >> U64(8) & low_bytes(TAIL), blocks) == U64(block))
    found = np.zeros(len(keys))
    found[own] = tree.log10(keys[own])
    return np.add.reduceat(found, stream.starts)


def _further(shipped_tree, block: int, blocks: int):
    """What the symbols of one more block add to the score of a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score = _text_scores(streamed(part.column("text")), shipped_tree.value, block, blocks)
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(score)], names=["_row", "score"])
    return run


def _score(shipped, shipped_tree, blocks: int, tokens: int, distinct: int, train_docs: int):
    """All about the words of rows, and the scores of their symbols of the first block."""
    base = np.log10(tokens + 0.5 * (distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, counts), tree = shipped.value, shipped_tree.value
        logs = np.log10(counts + 0.5)
        for batch in batches:
            for part in slices(batch):
                stream, found = streamed(part.column("text")), find_words(part.column("text"), lower=True)
                hashes = found.hashes()
                score = _text_scores(stream, tree, 0, blocks)
                n_docs, n_words = part.num_rows, np.diff(found.first)
                doc = np.repeat(np.arange(n_docs), n_words)
                at = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
                hit = keys[at] == hashes if len(keys) else np.zeros(len(doc), bool)
                known = np.bincount(doc[hit], minlength=n_docs)
                total = np.bincount(doc[hit], logs[at[hit]] if len(keys) else None, n_docs)
                rare, rare_n = [], []
                for d in range(n_docs):
                    lo, hi = found.first[d], found.first[d + 1]
                    k, n = np.unique(hashes[lo:hi][~hit[lo:hi]], return_counts=True)
                    rare.append(k.view(np.int64))
                    rare_n.append(n)
                n_tokens = n_words + 1
                total = total + np.log10(train_docs + 0.5) - n_tokens * base
                yield pa.RecordBatch.from_arrays([
                    part.column("_row"), part.column("doc_id"), part.column("held_out"), pa.array(n_tokens), pa.array(known + (train_docs > 0)),
                    pa.array(total), pa.array(score), lists(rare), lists(rare_n)],
                    names=["_row", "doc_id", "held_out", "n_tokens", "_known", "_base", "score", "_rare", "_times"])
    return run


def language_scores(docs: DataFrame, model: LanguageModel, held_out: Column) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row.

    Scores are log10 probabilities: ``base_score`` of the words and the end
    under smoothed unigram counts, ``score`` of the text under the tree.  Null
    and empty texts are their end alone.  Null ids stay null, repeated rows
    score alike, and without training texts all symbols are alike unlikely.
    """
    broadcast, blocks = docs.sparkSession.sparkContext.broadcast, model.blocks
    source = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"),
                         held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    if blocks > 1:  # rows that several passes name alike
        source = written_table(source, "numbered")
    tree = broadcast(_tree(model.grown, 0, blocks))
    scored = written_table(source.mapInArrow(
        _score(model.shipped, tree, blocks, model.train_tokens, model.distinct, model.train_docs),
        "_row long, doc_id long, held_out boolean, n_tokens long, _known long, _base double, score double, "
        "_rare array<long>, _times array<long>"), "scored")
    tree.unpersist()
    parts = []
    for block in range(1, blocks):
        tree = broadcast(_tree(model.grown, block, blocks))
        parts.append(written_table(source.select("_row", "text").mapInArrow(
            _further(tree, block, blocks), "_row long, score double"), "scored-block"))
        tree.unpersist()
    pairs = scored.select("_row", F.explode(F.arrays_zip("_rare", "_times")).alias("x")).select(
        "_row", F.col("x._rare").alias("key"), F.col("x._times").alias("times"))
    looked = pairs.join(model.counts, "key", "left").groupBy("_row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("_more"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("_rest"))
    whole = scored.drop("_rare", "_times").join(looked, "_row", "left")
    if parts:
        added = reduce(DataFrame.unionByName, parts).groupBy("_row").agg(F.sum("score").alias("_added"))
        whole = whole.join(added, "_row", "left").withColumn("score", F.col("score") + F.col("_added"))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("_known") + F.coalesce("_more", F.lit(0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_rest", F.lit(0.0))).alias("base_score"), "score")
