"""Repeated byte strings, by suffix arrays of shards.

A byte goes if some ``WINDOW`` bytes around it also start elsewhere.

1. Each window has an anchor: the least hashed run of ``GRAM`` bytes in it, the
   leftmost of equals.  Equal windows have equal anchors at equal places, so
   only anchors whose hash occurs twice can lie in a repeat.  There is about
   one anchor in 137 bytes.
2. An anchor's context is what the windows of that anchor cover, so each window
   is in one context.  Contexts met twice are repeats from end to end, found by
   counting digests.
3. The others, and one of each kind of context with the same anchor, are
   gathered in shards of bounded size.  A shard is sorted into a suffix array
   by Larsson-Sadakane refinement (only groups not yet sorted are refined, with
   doubled depth), and Kasai's common prefixes of neighbours show its repeats.
4. An anchor with more contexts than a shard may hold is dealt over several.
   Those shards also put out their distinct windows in order, cut into ranges
   by binary search, and each range's runs are merged by binary search.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.words import U64, prefix_sums, range_hashes, slices, text_bytes
from tidecast.storage import written_table

WINDOW = 400
GRAM = 128
REACH = WINDOW - GRAM          # an anchor is at most so far from its window's start
SHARD_CONTEXTS = 1_500         # about a megabyte
RANGE_WINDOWS = 400_000        # of a range that is merged in one task
_PACK = 7                      # symbols in a first key; 9 bits each
NO_ID = -(1 << 63)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per anchor: position, hash, document, and begin and end of what its windows cover."""
    n = len(data)
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes >= WINDOW)
    if not len(long):
        return tuple(np.zeros(0, k) for k in (np.int64, U64, np.int64, np.int64, np.int64))
    at = np.arange(n - GRAM + 1)
    hashes = range_hashes(prefix_sums(data), at, at + GRAM)
    least = hashes >> U64(32) << U64(32) | at.astype(U64)
    width = 1
    while 2 * width <= REACH + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = REACH + 1 - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    counts = sizes[long] - WINDOW + 1
    starts = np.arange(counts.sum()) + np.repeat(offsets[:-1][long] - np.cumsum(counts) + counts, counts)
    found = (least[starts] & U64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    last = np.append(first[1:], len(found)) - 1
    found = found[first]
    return found, hashes[found], np.searchsorted(offsets, found, side="right") - 1, starts[first], starts[last] + WINDOW


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, max_bytes=2 << 20):
            data, offsets = text_bytes(part.column("text"))
            at, hashes, doc, lo, hi = anchors(data, offsets)
            view = data.tobytes()
            digests = np.array([hashlib.blake2b(view[a:b], digest_size=16, salt=struct.pack("<q", p - a)).digest()
                                for p, a, b in zip(at.tolist(), lo.tolist(), hi.tolist())], "S16")
            pair = np.frombuffer(digests.tobytes(), np.int64).reshape(-1, 2)
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([
                part.column("_doc").take(take), part.column("_th").take(take), pa.array(lo - offsets[doc]),
                pa.array(hi - offsets[doc]), pa.array(hashes.view(np.int64)), pa.array(pair[:, 0]), pa.array(pair[:, 1])],
                names=["_doc", "_th", "begin", "end", "h", "c1", "c2"])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of the asked anchors of each document."""
    for batch in batches:
        for part in slices(batch, max_bytes=1 << 20):
            rows: list[tuple] = []
            for doc, th, text, asked in zip(*(part.column(c) for c in ("_doc", "_th", "text", "asked"))):
                data = text.as_py().encode()
                for x in asked.as_py():
                    rows.append((x["shard"], x["salt"], x["hot"], x["many"], doc.as_py(), th.as_py(), x["begin"],
                                 data[x["begin"]: x["end"]]))
            for at in range(0, len(rows), 10_000):
                cols = zip(*rows[at: at + 10_000])
                kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                 names=["shard", "salt", "hot", "many", "_doc", "_th", "begin", "bytes"])


class Shard:
    """Suffix array of several strings; equal suffixes are in the order of their places."""

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) for s in strings])
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        n = int(self.ends[-1])
        self.owner = np.repeat(np.arange(len(strings)), sizes)
        self.left = self.ends[self.owner] - np.arange(n)  # symbols from here to the string's end
        self.symbols = np.concatenate([np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1, np.zeros(_PACK, np.int64)])
        self.key = np.zeros(n + 1, np.int64)
        for k in range(_PACK):
            self.key[:n] = self.key[:n] << 9 | np.where(self.left > k, self.symbols[k: k + n], 0)
        self._sort(n)
        self._common(n, sizes)

    def _sort(self, n: int) -> None:
        """Larsson-Sadakane: double the sorted depth of groups that still hold several suffixes."""
        key = self.key[:n]
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        rank = np.empty(n, np.int64)
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        rank[order] = first[group] + 1
        depth = _PACK
        slots = np.flatnonzero(np.bincount(group)[group] > 1)
        longest = int(self.left.max())
        while depth < longest and len(slots):  # whole strings: common prefixes need the full order
            suffix = order[slots]
            after = np.where(self.left[suffix] > depth, rank[np.minimum(suffix + depth, n - 1)], 0)
            pair = rank[suffix] << 32 | after
            by = np.argsort(pair, kind="stable")
            suffix, pair = suffix[by], pair[by]
            order[slots] = suffix
            new = np.concatenate([[True], pair[1:] != pair[:-1]])
            group = np.cumsum(new) - 1
            rank[suffix] = slots[np.flatnonzero(new)][group] + 1
            slots = slots[np.bincount(group)[group] > 1]
            depth *= 2
        self.order, self.rank = order, rank

    def _common(self, n: int, sizes: np.ndarray) -> None:
        """Kasai's common prefixes with the neighbour before, along all strings at once.

        ``common[slot]`` is cut at ``WINDOW``.  A suffix shares at least one
        symbol less with its neighbour than the suffix a symbol longer did.
        """
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        before = np.where(place > 0, self.order[place - 1], -1)
        common = np.zeros(n, np.int64)
        length = np.zeros(len(sizes), np.int64)
        for j in range(int(sizes.max())):
            lanes = np.flatnonzero(sizes > j)
            here = self.starts[lanes] + j
            there = before[here]
            some = there >= 0
            l = np.maximum(length[lanes] - 1, 0)
            l[~some] = 0
            top = np.where(some, np.minimum(np.minimum(self.left[here], self.left[there]), WINDOW), 0)
            l = np.minimum(l, top)
            for step in (_PACK, 1):
                open_ = np.flatnonzero(l + step <= top)
                while len(open_):
                    a, b = here[open_] + l[open_], there[open_] + l[open_]
                    same = self.key[a] == self.key[b] if step > 1 else self.symbols[a] == self.symbols[b]
                    open_ = open_[same]
                    l[open_] += step
                    open_ = open_[l[open_] + step <= top[open_]]
            length[lanes] = l
            common[place[here]] = l
        self.common = common

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts of whole windows in suffix order, and where each group of equal ones begins among them."""
        slots = np.flatnonzero(self.left[self.order] >= WINDOW)
        joined = self.common[slots] >= WINDOW  # the neighbour before is then a whole window too
        return self.order[slots], np.flatnonzero(~joined)


_OUT = "kind int, _doc long, _th long, begin long, end long, range long, run binary"
_OUT_NAMES = ["kind", "_doc", "_th", "begin", "end", "range", "run"]
_OUT_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
_RUN = np.dtype([("digest", "S16"), ("doc", "<i8"), ("th", "<i8"), ("begin", "<i8"), ("twice", "?")])


def _spans(doc: np.ndarray, th: np.ndarray, begin: np.ndarray) -> list[tuple]:
    """Runs of window starts, as spans of bytes."""
    if not len(begin):
        return []
    order = np.lexsort((begin, th, doc))
    doc, th, begin = doc[order], th[order], begin[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (begin[1:] > begin[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(begin)) - 1
    return [(0, *x, None, None) for x in zip(
        doc[first].tolist(), th[first].tolist(), begin[first].tolist(), (begin[last] + WINDOW).tolist())]


def _table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [()] * len(_OUT_NAMES)
    return pa.table([pa.array(c, k) for c, k in zip(cols, _OUT_KINDS)], names=_OUT_NAMES)


def _sort_shard(ranges: int):
    def run(block: pa.Table) -> pa.Table:
        strings = [x.as_py() for x in block.column("bytes")]
        doc, th, begin = (block.column(c).to_numpy() for c in ("_doc", "_th", "begin"))
        many, hot = (block.column(c).to_numpy(zero_copy_only=False) for c in ("many", "hot"))
        shard = Shard(strings)
        at, groups = shard.windows()
        if not len(at):
            return _table([])
        owner = shard.owner[at]
        place = begin[owner] + at - shard.starts[owner]
        # A row that stands twice in the table is read twice; its own bytes are no repeat here.
        _, doc_no = np.unique(np.stack([doc, th]), axis=1, return_inverse=True)
        origin = doc_no.ravel()[owner] << 40 | place
        group = np.repeat(np.arange(len(groups)), np.diff(np.append(groups, len(at))))
        twice = (np.minimum.reduceat(origin, groups) != np.maximum.reduceat(origin, groups)) | np.logical_or.reduceat(many[owner], groups)
        hit = twice[group] & ~many[owner]
        rows = _spans(doc[owner[hit]], th[owner[hit]], place[hit])
        if hot.any():
            firsts = groups[np.logical_or.reduceat(hot[owner], groups)]
            out = np.zeros(len(firsts), _RUN)
            text = b"".join(strings)
            out["digest"] = [hashlib.blake2b(text[p: p + WINDOW], digest_size=16).digest() for p in at[firsts].tolist()]
            out["doc"], out["th"], out["begin"] = doc[owner[firsts]], th[owner[firsts]], place[firsts]
            out["twice"] = twice[group[firsts]]
            out = out[np.argsort(out["digest"])]
            cuts = np.array([(k * (1 << 64) // ranges).to_bytes(8, "big") + bytes(8) for k in range(1, ranges)], "S16")
            parts = np.split(out, np.searchsorted(out["digest"], cuts)) if ranges > 1 else [out]
            rows += [(1, None, None, None, None, k, p.tobytes()) for k, p in enumerate(parts) if len(p)]
        return _table(rows)
    return run


def _merge_runs(block: pa.Table) -> pa.Table:
    """Windows that several shards hold; those not known as repeats in their own shard come out."""
    merged, hit = np.zeros(0, _RUN), np.zeros(0, bool)
    out = []
    for raw in block.column("run"):
        run = np.frombuffer(raw.as_buffer(), _RUN)
        at = np.searchsorted(merged["digest"], run["digest"])
        met = np.zeros(len(run), bool)
        inside = np.flatnonzero(at < len(merged))
        met[inside] = merged["digest"][at[inside]] == run["digest"][inside]
        old, new = at[met], run[met]
        # a row that stands twice in the table may meet itself
        same = np.logical_and.reduce([merged[c][old] == new[c] for c in ("doc", "th", "begin")])
        other = ~same | merged["twice"][old] | new["twice"]
        hit[old[other]] = True
        out.append(new[other & ~new["twice"]])
        merged, hit = np.insert(merged, at[~met], run[~met]), np.insert(hit, at[~met], False)
    rows = np.concatenate([merged[hit & ~merged["twice"]], *out])
    return _table(_spans(rows["doc"], rows["th"], rows["begin"]))


def _source(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_doc"), F.xxhash64(text).alias("_th"),
                       text.alias("text"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``_doc, _th, begin, end``: spans of bytes that lie in repeated windows, several a document.

    ``_th`` is the text's hash, so that rows sharing an id keep apart.  Spans
    overlap.
    """
    source = _source(docs)
    found = written_table(source.where(F.octet_length("text") >= WINDOW).mapInArrow(
        _anchor_rows, "_doc long, _th long, begin long, end long, h long, c1 long, c2 long"), "anchors")
    often = written_table(found.groupBy("h").agg(F.count("*").alias("_n")).where("_n > 1").select("h"), "often")
    again = written_table(found.join(often, "h", "left_semi"), "repeated-anchors")
    kinds = written_table(again.groupBy("h", "c1", "c2").agg(
        F.count("*").alias("n"), F.min(F.struct("_doc", "_th", "begin", "end")).alias("first")), "contexts")
    full = again.join(kinds.where("n > 1").select("h", "c1", "c2"), ["h", "c1", "c2"], "left_semi").select(
        "_doc", "_th", "begin", "end")

    open_ = written_table(kinds.groupBy("h").agg(
        F.count("*").alias("_kinds"), F.sum((F.col("n") == 1).cast("long")).alias("_single")).where(
        "_kinds > 1 and _single > 0"), "open-anchors")
    hot = F.col("_kinds") > SHARD_CONTEXTS
    total, hot_total = open_.agg(F.coalesce(F.sum("_kinds"), F.lit(0)), F.coalesce(F.sum(F.when(hot, F.col("_kinds"))), F.lit(0))).first()
    shards, ranges = -(-total // SHARD_CONTEXTS) or 1, -(-hot_total * REACH // RANGE_WINDOWS) or 1
    salt = F.pmod(F.xxhash64("c1", "c2"), F.ceil(F.col("_kinds") / SHARD_CONTEXTS)) + 1
    asked = kinds.join(open_, "h").select("first._doc", "first._th", F.struct(
        "first.begin", "first.end", F.when(hot, F.col("h")).otherwise(F.pmod(F.xxhash64("h"), F.lit(shards))).alias("shard"),
        F.when(hot, salt).otherwise(F.lit(0).cast("long")).alias("salt"), hot.alias("hot"),
        (F.col("n") > 1).alias("many")).alias("_ask")).groupBy("_doc", "_th").agg(F.collect_list("_ask").alias("asked"))
    contexts = source.join(asked, ["_doc", "_th"]).mapInArrow(
        _fetch, "shard long, salt long, hot boolean, many boolean, _doc long, _th long, begin long, bytes binary")
    sorted_ = written_table(contexts.groupBy("shard", "salt").applyInArrow(_sort_shard(ranges), _OUT), "sorted-shards")
    merged = sorted_.where("kind = 1").select("range", "run").groupBy("range").applyInArrow(_merge_runs, _OUT)
    span = ["_doc", "_th", "begin", "end"]
    return full.unionByName(sorted_.where("kind = 0").select(*span)).unionByName(merged.select(*span))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            kept, removed, spans = [], [], []
            for text, raw in zip(part.column("text"), part.column("spans")):
                data = text.as_py().encode()
                rest, last, gone, n = [], 0, 0, 0
                for x in raw.as_py() or ():  # sorted by begin
                    begin, end = x["begin"], min(x["end"], len(data))
                    if end <= last:
                        continue
                    if n and begin <= last:
                        begin = last
                    else:
                        rest.append(data[last:begin])
                        n += 1
                    gone, last = gone + end - begin, end
                rest.append(data[last:])
                kept.append(b"".join(rest))
                removed.append(gone)
                spans.append(n)
            yield pa.RecordBatch.from_arrays(
                [part.column("_doc"), pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())],
                names=["_doc", "kept", "n_removed", "n_spans"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, kept, n_bytes, n_removed, n_spans`` of each row; ``kept`` are the bytes left, as binary.

    Every byte of a ``WINDOW``-byte string that also starts anywhere else goes,
    the first occurrence too; strings are judged on the input.  A row repeated
    whole repeats its strings.  Null texts are empty; null ids stay null; other
    columns are ignored.

    A text is held whole in a task, at about 40 times its bytes.  An empty
    table gives no row.
    """
    spans = repeated_spans(docs).groupBy("_doc", "_th").agg(
        F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"))
    cut = _source(docs).join(spans, ["_doc", "_th"], "left").select("_doc", "text", "spans").mapInArrow(
        _cut, "_doc long, kept binary, n_removed long, n_spans long")
    return cut.select(F.when(F.col("_doc") != NO_ID, F.col("_doc")).alias("doc_id"), "kept",
                      (F.octet_length("kept") + F.col("n_removed")).alias("n_bytes"), "n_removed", "n_spans")
