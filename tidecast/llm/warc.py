"""WARC archives: written as one gzip stream a file, normalised, and read by offset.

Writers compress a whole archive as a single gzip stream.  The normaliser
inflates that stream once, rewrites every record as a gzip member of its own
and writes a sidecar index of offsets, after which any record can be read
alone.  Records with equal payloads are stored once: the one with the largest
page id is the response, the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.files import FILE_BYTES, attempt_name, one_a_task, opened
from tidecast.storage import scratch_path, written_table

CHUNK = 1 << 20
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
# Fixed value of the WARC format.
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One response, or one revisit without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + END
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: <urn:x-page:{page_id}>")
    lines.append(f"WARC-Date: {DATE}")
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def headers(head: bytes) -> dict[str, str]:
    return {k.decode().lower(): v.decode() for k, _, v in (x.partition(b": ") for x in head.split(b"\r\n")[1:])}


def records(source) -> Iterator[bytes]:
    """The records of a gzip file, of one stream or of many, held one at a time."""
    inflate, held = zlib.decompressobj(31), bytearray()
    need = None
    while chunk := source.read(CHUNK):
        while chunk:
            held += inflate.decompress(chunk)
            chunk = inflate.unused_data
            if inflate.eof and chunk:
                inflate = zlib.decompressobj(31)
            at = 0
            while True:
                if need is None:
                    head = held.find(END, at)
                    if head < 0:
                        break
                    need = head + 8 + int(headers(bytes(held[at:head]))["content-length"]) - at
                if len(held) - at < need:
                    break
                yield bytes(held[at: at + need])
                at, need = at + need, None
            del held[:at]
    if held:
        raise ValueError(f"{len(held)} bytes after the last whole record")


def _write_archive(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = opened(folder)
        files.create_dir(path, recursive=True)
        part = TaskContext.get().partitionId()
        sink = None

        def finished() -> pa.RecordBatch:
            sink.write(pack.flush())
            sink.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], names=["file", "records"])

        for batch in batches:
            columns = (batch.column(c) for c in ("page_id", "url", "html", "refers_to"))
            for page, url, html, refers in zip(*columns):
                if sink is None:
                    name, n, size = attempt_name(part, ".warc.gz"), 0, 0
                    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    sink = files.open_output_stream(f"{path}/{name}", compression=None)
                whole = record(page.as_py(), url.as_py(), (html.as_py() or "").encode(), refers.as_py())
                sink.write(pack.compress(whole))
                n, size = n + 1, size + len(whole)
                if size >= file_bytes:
                    yield finished()
                    sink = None
        if sink is not None:
            yield finished()
    return run


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``page_id, url, html`` rows to archives of one gzip stream each; ``file, records``.

    A stream cannot be split, so an archive that holds ``file_bytes`` is
    followed by another one.

    Equal payloads are found by digest and length of the html (null: empty).
    Of rows that repeat the largest page id all are responses; rows without a
    page id are responses that nothing refers to.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                          F.col("html").cast("string").alias("html"))
    named = source.where("page_id is not null").select(
        "page_id", F.sha1(payload).alias("_digest"), F.octet_length(payload).alias("_bytes"))
    # A table of its own, so that Spark may split the join at a payload of very many pages.
    first = written_table(named.groupBy("_digest", "_bytes").agg(
        F.max("page_id").alias("_first"), F.min("page_id").alias("_least")).where("_first != _least"), "payloads")
    again = named.join(first, ["_digest", "_bytes"]).where("page_id != _first").select(
        F.col("page_id").alias("_page"), F.col("_digest").alias("_of"), F.col("_first").alias("refers_to")).distinct()
    same = (F.col("page_id") == F.col("_page")) & (F.sha1(payload) == F.col("_of"))
    ready = source.where("page_id is not null").join(again, same, "left").select("page_id", "url", "html", "refers_to")
    nameless = source.where("page_id is null").withColumn("refers_to", F.lit(None).cast("long"))
    return written_table(ready.unionByName(nameless).mapInArrow(
        _write_archive(folder, file_bytes), "file string, records long"), "archives")


def _normalise(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = opened(folder)
        for batch in batches:
            for old in batch.column("file").to_pylist():
                name = attempt_name(int(old.split("-")[1]), ".members.warc.gz")
                n, at = 0, 0
                with files.open_input_stream(f"{path}/{old}", compression=None) as source, \
                        files.open_output_stream(f"{path}/{name}", compression=None) as sink, \
                        files.open_output_stream(f"{path}/{name}.idx", compression=None) as index:
                    for whole in records(source):
                        pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = pack.compress(whole) + pack.flush()
                        sink.write(member)
                        index.write(f"{at} {len(member)}\n".encode())
                        n, at = n + 1, at + len(member)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], names=["file", "records"])
    return run


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive with a gzip member per record and an ``.idx`` file of ``offset length`` lines."""
    return written_table(one_a_task(archives).mapInArrow(_normalise(folder), "file string, records long"), "members")


def parsed(whole: bytes) -> tuple[int | None, int, str, str, int | None]:
    """Page id, payload size, digest, type and page referred to; a response's digest is checked."""
    head, _, rest = whole.partition(END)
    fields = headers(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(END)
    size, digest = int(headers(http)["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
    page = lambda name: int(fields[name].strip("<>").rpartition(":")[2]) if name in fields else None
    if fields["warc-type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"payload of {fields.get('warc-record-id')} is damaged")
    return page("warc-record-id"), size, digest, fields["warc-type"], page("warc-refers-to")


_FIELDS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def _read_members(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = opened(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with files.open_input_stream(f"{path}/{name}.idx", compression=None) as index:
                    entries = [tuple(map(int, x.split())) for x in index.read().splitlines()]
                with files.open_input_file(f"{path}/{name}") as source:
                    for lo in range(0, len(entries), 1000):
                        rows = []
                        for at, length in entries[lo: lo + 1000]:
                            source.seek(at)
                            rows.append(parsed(zlib.decompress(source.read(length), 31)))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=_FIELDS)
    return run


def read_members(members: DataFrame, folder: str) -> DataFrame:
    """Every record of normalised archives, each read alone at its indexed offset."""
    return one_a_task(members).mapInArrow(
        _read_members(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame) -> DataFrame:
    """Write, normalise and read back; empty tables give no archive and no rows.

    A record is held whole in a task, at about four times the bytes of its html.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    return read_members(normalise_archives(write_archives(pages, folder), folder), folder)
