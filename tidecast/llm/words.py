"""Words and word shingles of whole texts, for a batch of documents at once.

A word is ``[^\\x20\\x09-\\x0D]+`` over the UTF-8 bytes; matches never cross
documents.  All steps are numpy passes over the batch's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SHINGLE_WORDS = 5
_rng = np.random.default_rng(20_240_229)
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) | U64(1)
_BASE = int(_rng.integers(1 << 61, 1 << 62)) * 4 + 3
_BASE_INV = pow(_BASE, -1, 1 << 64)
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32
_powers = {"n": -1}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n, and those of its inverse, modulo 2**64."""
    if _powers["n"] < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size + 1, U64(base))
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits, one to one."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running sums with which the hash of any byte range takes one subtraction."""
    up, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))


_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of many short byte ranges, eight bytes a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))  # at each byte, it and the seven after it
    left = ends - starts
    out = left.astype(U64) * U64(0x9E3779B97F4A7C15)
    out = mixed(out + (eight[starts] & _FIRST_BYTES[np.minimum(left, 8)]))
    rows = np.flatnonzero(left > 8)
    step = 8
    while len(rows):
        part = eight[starts[rows] + step] & _FIRST_BYTES[np.minimum(left[rows] - step, 8)]
        out[rows] = mixed(out[rows] * U64(0x9E3779B97F4A7C15) + part)
        step += 8
        rows = rows[left[rows] > step]
    return out


@dataclass
class Words:
    data: np.ndarray      # the batch's bytes
    offsets: np.ndarray   # of documents in data
    starts: np.ndarray    # of words in data
    ends: np.ndarray
    first: np.ndarray     # first[d]:first[d + 1] are the words of document d

    def hashes(self) -> np.ndarray:
        return range_hashes(prefix_sums(self.data), self.starts, self.ends)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and each document's offset; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer else np.zeros(0, np.uint8)
    lo, hi = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
    return data[lo:hi], offsets - lo


def find_words(texts: pa.Array, lower: bool) -> Words:
    data, offsets = text_bytes(texts)
    if lower:
        data = LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def window_hashes(words: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Hash of each run of ``size`` words, whatever document it ends in."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = words[:n].copy()
    for k in range(1, size):
        out = mixed(out * U64(0x9E3779B97F4A7C15) + words[k: k + n])
    return out


def short_hash(words: np.ndarray) -> np.ndarray:
    """Hash of a whole sequence of fewer words than a shingle has."""
    return mixed(window_hashes(words, len(words)) + U64(len(words)))


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each document the sorted distinct hashes of its lower-cased 5-word shingles.

    Fewer words make one shingle; a text without words has none.
    """
    words = find_words(texts, lower=True)
    hashes = words.hashes()
    windows = window_hashes(hashes)
    for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if hi - lo >= SHINGLE_WORDS:
            yield np.unique(windows[lo: hi - SHINGLE_WORDS + 1])
        elif hi > lo:
            yield short_hash(hashes[lo:hi])
        else:
            yield windows[:0]


def slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that one piece holds about ``max_bytes`` of text, or one document."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > lo and held + n > max_bytes:
            yield batch.slice(lo, i - lo)
            lo, held = i, 0
        held += n
    yield batch.slice(lo)


def lists(arrays: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.Array:
    """An Arrow list column from one numpy array per row."""
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))
