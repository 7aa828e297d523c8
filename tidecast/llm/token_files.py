"""Token ids in seekable zstandard files.

A file holds one zstandard frame per document (its ids as little-endian
unsigned 32-bit integers, the end id last), a skippable frame with the
documents' ids, and a skippable frame with the seek table: compressed size,
size and the low half of the XXH64 of each frame, as in the published seekable
format.  A reader takes table and directory from the file's end and
decompresses only the documents it wants.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.files import FILE_BYTES, attempt_name, one_a_task, opened
from tidecast.llm.words import U64, WHITE, Words, find_words, piece_hashes, slices
from tidecast.storage import scratch_path, written_table

END_ID = 2
LEVEL = 1
CACHED_PIECES = 2_000_000  # about 30 bytes each
NO_ID = -(1 << 63)  # in a directory: the row had no id
# Fixed values of the seekable format and of skippable frames.
SEEK_FRAME, DIRECTORY_FRAME, SEEK_END = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1


_MARK, _PLAIN = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".,")] = True
_PLAIN[[*range(65, 91), *range(97, 123)]] = True

# The alphabet of byte-level vocabularies: printable bytes are their own letter, the others follow from 256 on.
_OTHERS = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_BYTE_LETTERS = {b: chr(256 + i) for i, b in enumerate(_OTHERS)}
_SPACE = _BYTE_LETTERS[32]
_PLAIN_WHITE = np.zeros(256, bool)
_PLAIN_WHITE[list(b" \n")] = True
# White space beyond ASCII, in UTF-8.
_OTHER_WHITE = tuple(c.encode() for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                     "\u2028\u2029\u202f\u205f\u3000")
_WHITE_LEAD = np.zeros(256, bool)
_WHITE_LEAD[[c[0] for c in _OTHER_WHITE]] = True
_SELDOM = (b"\t", b"\v", b"\f", b"\r", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_WHITE_2, _WHITE_3 = ([int.from_bytes(c, "big") for c in _OTHER_WHITE if len(c) == n] for n in (2, 3))


class PieceEncoder:
    """Ids of whole texts, with a memory of pieces between spaces.

    The tokenizer never joins a character with white space that follows it, so
    a text may be cut before single spaces and line breaks without changing its
    ids.  All pieces of a batch are hashed together (64 bits), and each distinct
    one is looked up or encoded once.  Texts with other or repeated white space
    are given to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.line_break = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.marks = np.zeros(256, "<u4")
        for c in np.flatnonzero(_MARK).tolist():
            self.marks[c] = self.tokenizer.encode(chr(c), add_special_tokens=False).ids[0]
        self._forget()

    def _forget(self) -> None:
        """Known pieces: sorted hashes, and where each one's ids stand in one array."""
        self.keys, self.begin, self.length = np.zeros(0, U64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, "<u4"), 0

    def _remember(self, keys: np.ndarray, place: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Take in new pieces; ``place`` is where their keys go among the old ones."""
        need = self.used + len(ids)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(need - len(self.flat), len(self.flat)), "<u4")])
        self.flat[self.used: need] = ids
        begin = (self.used + np.cumsum(lengths) - lengths).astype(np.int32)
        self.keys = np.insert(self.keys, place, keys)
        self.begin, self.length = np.insert(self.begin, place, begin), np.insert(self.length, place, lengths)
        self.used = need

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each has.

        Plain words, with a space or line break before them, are one step of
        the tokenizer and go to its model alone.
        """
        flat: list[int] = []
        lengths: list[int] = []
        tokenize, table = self.model.tokenize, _BYTE_LETTERS
        for text in texts:
            head = text[:1]
            word = text[1:] if head == " " or head == "\n" else text
            if word.isalpha() and (word.isascii() or max(word) < "\u0250"):
                letters = word if word.isascii() else word.encode().decode("latin-1").translate(table)
                ids = [t.id for t in tokenize(_SPACE + letters if head == " " else letters)]
                if head == "\n":
                    ids = self.line_break + ids
            else:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            flat += ids
            lengths.append(len(ids))
        return np.array(flat, "<u4"), np.array(lengths, np.int32)

    def _whole(self, words: Words) -> np.ndarray:
        """Which documents have white space that is not single spaces and line breaks between words."""
        data, offsets = words.data, words.offsets
        n_words = np.diff(words.first)
        inside = np.concatenate([[0], np.cumsum(words.ends - words.starts)])
        white = np.diff(offsets) - (inside[words.first[1:]] - inside[words.first[:-1]])
        odd = white != np.maximum(n_words - 1, 0)
        text = data.tobytes()
        if any(map(text.__contains__, _SELDOM)):
            bad = WHITE[data] & ~_PLAIN_WHITE[data]
            high = np.flatnonzero(_WHITE_LEAD[data])
            two = data[high].astype(np.int64) << 8 | data[np.minimum(high + 1, len(data) - 1)]
            three = two << 8 | data[np.minimum(high + 2, len(data) - 1)]
            bad[high] |= np.isin(two, _WHITE_2) | np.isin(three, _WHITE_3)
            sums = np.concatenate([[0], np.cumsum(bad)])
            odd |= sums[offsets[1:]] > sums[offsets[:-1]]
        return odd

    def _looked_up(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the batch's pieces, and where each document's start."""
        starts = words.starts - 1
        starts[words.first[:-1][np.diff(words.first) > 0]] += 1  # a text's first piece has no space before it
        # A full stop or comma after a plain letter, at a piece's end, is always a token of its own.
        last = words.data[words.ends - 1]
        mark = _MARK[last] & _PLAIN[words.data[np.maximum(words.ends - 2, 0)]] & (words.ends - words.starts > 1)
        ends_at = words.ends - mark
        hashes = piece_hashes(words.data, starts, ends_at)
        piece, keys = pd.factorize(hashes)
        at = np.empty(len(keys), np.int64)
        at[piece[::-1]] = np.arange(len(piece))[::-1]
        if len(self.keys) > CACHED_PIECES:
            self._forget()
        place = np.searchsorted(self.keys, keys)
        fresh = np.ones(len(keys), bool)
        inside = np.flatnonzero(place < len(self.keys))
        fresh[inside] = self.keys[place[inside]] != keys[inside]
        new = np.flatnonzero(fresh)
        new = new[np.argsort(keys[new])]
        data = words.data.tobytes()
        spelt = [data[a:b].decode() for a, b in zip(starts[at[new]].tolist(), ends_at[at[new]].tolist())]
        if spelt:
            self._remember(keys[new], place[new], *self._ids(spelt))
        place += np.searchsorted(keys[new], keys)  # each new key before it moves a key by one
        begins, lengths = self.begin[place], self.length[place]
        each = lengths[piece] + mark
        ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(each, dtype=np.int32)])
        spots = np.repeat(begins[piece] - ends[:-1], each) + np.arange(ends[-1], dtype=np.int32)
        taken = self.flat[np.minimum(spots, len(self.flat) - 1)]
        taken[ends[1:][mark] - 1] = self.marks[last[mark]]
        return taken, ends[words.first]

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; a null text has none."""
        words = find_words(texts, lower=False)
        whole = self._whole(words)
        if whole.any():
            mask = pa.array(whole)
            words = find_words(pc.if_else(mask, pa.scalar("", texts.type), texts), lower=False)
            alone = iter(texts.filter(mask).to_pylist())
        taken, at = self._looked_up(words)
        for w, a, b in zip(whole.tolist(), at[:-1].tolist(), at[1:].tolist()):
            if w:
                ids = self.tokenizer.encode(next(alone), add_special_tokens=False).ids
                yield np.array(ids, "<u4").tobytes()
            else:
                yield taken[a:b].tobytes()


_encoders: dict[str, PieceEncoder] = {}


def _skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


class TokenFileWriter:
    def __init__(self, sink):
        self.sink, self.table, self.ids = sink, bytearray(), array("q")
        self.press = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.press.compress(ids)
        self.sink.write(frame)
        self.table += struct.pack("<III", len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF)
        self.ids.append(NO_ID if doc_id is None else doc_id)

    def finish(self) -> None:
        self.sink.write(_skippable(DIRECTORY_FRAME, self.ids.tobytes()))
        self.sink.write(_skippable(SEEK_FRAME, bytes(self.table) + struct.pack("<IBI", len(self.ids), 0x80, SEEK_END)))


class TokenFileReader:
    """Documents of one file by their place in it."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_END or not flags & 0x80:
            raise ValueError("no seek table with checksums at the file's end")
        source.seek(size - 9 - 12 * n)
        self.table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        source.seek(size - 9 - 12 * n - 8 - 8 * n)
        self.ids = np.frombuffer(source.read(8 * n), "<i8")
        self.at = np.cumsum(self.table[:, 0]) - self.table[:, 0]
        self.starts = (np.cumsum(self.table[:, 1]) - self.table[:, 1]) // 4
        self.press = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.table)

    def tokens(self, i: int) -> bytes:
        packed, size, check = self.table[i].tolist()
        self.source.seek(int(self.at[i]))
        ids = self.press.decompress(self.source.read(packed), max_output_size=size)
        if len(ids) != size or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return ids


def _write_tokens(folder: str, tokenizer: str, end_id: int, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, PieceEncoder(tokenizer))
        part = TaskContext.get().partitionId()
        files, path = opened(folder)
        files.create_dir(path, recursive=True)
        end, number, writer = struct.pack("<I", end_id), 0, None

        def finished() -> pa.RecordBatch:
            writer.finish()
            writer.sink.close()
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, number, name, len(writer.ids), held // 4)],
                                              names=["part", "number", "file", "n_docs", "n_tokens"])

        for batch in batches:
            for piece in slices(batch, max_bytes=2 << 20):
                for doc, tokens in zip(piece.column("_doc").to_pylist(), encoder.encode(piece.column("text"))):
                    if writer is None:
                        name, held = attempt_name(part, ".tokens.zst"), 0
                        writer = TokenFileWriter(files.open_output_stream(f"{path}/{name}", compression=None))
                    writer.add(doc, tokens + end)
                    held += len(tokens) + len(end)
                    if held >= file_bytes:
                        yield finished()
                        writer, number = None, number + 1
        if writer is not None:
            yield finished()
    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, by_id: bool = True,
                      file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ids; ``part, number, file, n_docs, n_tokens`` of each file, which follow each other by part and number.

    Documents go in ascending ``doc_id`` order, equal ids in the order of their
    texts' hashes, rows without an id first.  With ``by_id`` off they stay in
    the order they come in, as a mixture needs, and nothing is shuffled.  Null
    texts are empty and give the end id alone.  A file that holds ``file_bytes``
    of ids is followed by another.  A text is held whole in a task, at about 40
    times its bytes.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    dealt = source.repartitionByRange("_doc", tie).sortWithinPartitions(F.col("_doc"), tie, F.col("text")) if by_id else source
    return written_table(dealt.mapInArrow(
        _write_tokens(folder, tokenizer, end_id, file_bytes), "part long, number long, file string, n_docs long, n_tokens long"), "token-files")


def _read_tokens(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = opened(folder)
        for batch in batches:
            for name, base in zip(*(batch.column(c).to_pylist() for c in ("file", "_base"))):
                with files.open_input_file(f"{path}/{name}") as source:
                    reader = TokenFileReader(source)
                    for lo in range(0, len(reader), 5_000):
                        at = range(lo, min(lo + 5_000, len(reader)))
                        crc = [zlib.crc32(reader.tokens(i)) for i in at]
                        ids = reader.ids[lo: at.stop]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(ids, mask=ids == NO_ID), pa.array(reader.starts[lo: at.stop] + base),
                            pa.array(reader.table[lo: at.stop, 1] // 4), pa.array(crc, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return run


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the files themselves."""
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    based = files.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("_base"))
    return one_a_task(based).mapInArrow(
        _read_tokens(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = END_ID, by_id: bool = True) -> DataFrame:
    """Write the files to a new folder of the shared one and read them back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, tokenizer, end_id, by_id), folder)
