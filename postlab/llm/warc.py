"""WARC archives as seekable Zstandard bundles, with an index from record to frame.

A bundle is a file of independent Zstandard frames, each of whole WARC records, and a seek table in a skippable
frame at its end (compressed and plain size and checksum of every frame). The index maps each record to its
bundle, its frame and its place in the frame, so a reader unpacks only the frames that it needs.

Tasks write bundles under names of their own; the index, which Spark commits, names the ones that count. What a
lost or repeated task leaves behind is never read. The folder must be one that all executors share.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlab.llm.common import document_batches, text_slices, tidy
from postlab.session import shared_folder, stored

# ---- fixed values: formats ----------------------------------------------------------------------------------
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
WITH_CHECKSUMS = 0x80
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_NAME = "urn:record:"
# ---- end of fixed values --------------------------------------------------------------------------------------
#: Plain bytes of a frame and packed bytes of a bundle after which the next one begins.
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 1 << 28
#: Plain bytes of records that one task reads.
TASK_BYTES = 1 << 27
INDEX = "bundle string, frame int, offset bigint, length bigint"


class Frame(NamedTuple):
    start: int
    packed: int
    plain: int
    checksum: int


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


# ---- bundles ----------------------------------------------------------------------------------------------------

class BundleWriter:
    """Appends records to one bundle; ``add`` tells the frame and the offset of the record in it."""

    def __init__(self, folder: str, frame_bytes: int = FRAME_BYTES):
        system, path = _open(folder)
        self.name, self.frame_bytes = f"{uuid.uuid4().hex}.warc.zst", frame_bytes
        self.file = system.open_output_stream(f"{path}/{self.name}", compression=None)
        self.frames: list[Frame] = []
        self.open_bytes, self.size = bytearray(), 0

    def add(self, record: bytes) -> tuple[int, int]:
        if len(self.open_bytes) >= self.frame_bytes:
            self._end_frame()
        place = len(self.frames), len(self.open_bytes)
        self.open_bytes += record
        return place

    def _end_frame(self) -> None:
        plain = bytes(self.open_bytes)
        packed = zstandard.ZstdCompressor(level=3).compress(plain)
        self.file.write(packed)
        self.frames.append(Frame(self.size, len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.size += len(packed)
        self.open_bytes = bytearray()

    def close(self) -> None:
        if self.open_bytes:
            self._end_frame()
        table = b"".join(struct.pack("<III", f.packed, f.plain, f.checksum) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), WITH_CHECKSUMS, SEEKABLE)
        self.file.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.file.close()


class BundleReader:
    """Unpacks single frames of a bundle by its seek table."""

    def __init__(self, folder: str, name: str):
        system, path = _open(folder)
        self.file = system.open_input_file(f"{path}/{name}")
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE or flags != WITH_CHECKSUMS:
            raise ValueError(f"{name} has no seek table")
        table = self.file.read_at(count * 12, size - 9 - count * 12)
        self.frames, start = [], 0
        for packed, plain, checksum in struct.iter_unpack("<III", table):
            self.frames.append(Frame(start, packed, plain, checksum))
            start += packed

    def frame(self, number: int) -> bytes:
        f = self.frames[number]
        plain = zstandard.ZstdDecompressor().decompress(self.file.read_at(f.packed, f.start), max_output_size=f.plain)
        if len(plain) != f.plain or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != f.checksum:
            raise ValueError(f"frame {number} is damaged")
        return plain


# ---- records ------------------------------------------------------------------------------------------------------

def payload_digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(identifier: str | None) -> str:
    return f"<{RECORD_NAME}{'-' if identifier is None else '=' + quote(identifier, safe='')}>"


def _identifier(name: str) -> str | None:
    mark = name.strip("<>").removeprefix(RECORD_NAME)
    return None if mark == "-" else unquote(mark[1:])


def build_record(identifier: str | None, url: str | None, payload: bytes, refers: bool, refers_to: str | None,
                 date: str) -> bytes:
    """A response record, or a revisit of an equal payload: the same without its body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {_name(identifier)}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
    ]
    if refers:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Record(NamedTuple):
    identifier: str | None
    record_type: str
    refers_to: str | None
    payload_bytes: int
    payload_digest: str
    payload: bytes | None


def _headers(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")[1:]
    return dict(line.split(": ", 1) for line in lines), body


def parse_record(record: bytes) -> Record:
    """Read a record; a response whose payload does not have the digest of its header is an error."""
    head, rest = _headers(record)
    http, payload = _headers(rest[:int(head["Content-Length"])])
    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
    identifier, size = _identifier(head["WARC-Record-ID"]), int(http["Content-Length"])
    if kind == "revisit":
        return Record(identifier, kind, _identifier(head["WARC-Refers-To"]), size, digest, None)
    if payload_digest(payload) != digest or len(payload) != size:
        raise ValueError(f"payload of {identifier} is damaged")
    return Record(identifier, kind, None, size, digest, payload)


# ---- tables ---------------------------------------------------------------------------------------------------------

def _with_first(pages: DataFrame, id_col: str, payload_col: str, url_col: str | None, least: int) -> DataFrame:
    """(id, url, payload, refers, refers_to): of equal payloads of ``least`` bytes or more the smallest id is the original."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).alias("id"), (F.col(url_col).cast("string") if url_col else F.lit("")).alias("url"),
        payload.alias("payload")
    ).select("*", F.sha1("payload").alias("digest"), F.xxhash64("payload").alias("second"),
             F.octet_length("payload").alias("size"))
    key = ["digest", "second", "size"]
    firsts = rows.where(F.col("size") >= least).groupBy(*key).agg(F.min("id").alias("first"))
    other = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    return rows.join(firsts, key, "left").select(
        F.col("id").cast("string").alias("id"), "url", "payload", other.alias("refers"),
        F.when(other, F.col("first")).cast("string").alias("refers_to"))


def write_archives(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url",
                   revisit_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES,
                   date: str = "1970-01-01T00:00:00Z") -> tuple[str, DataFrame]:
    """Write a record per row; return the folder and the index (id as text, bundle, frame, offset, length).

    Of records with equal payloads of ``revisit_bytes`` or more, the one of the smallest identifier is the response
    and the others revisit it; rows that share that identifier are all responses, and a null identifier
    is the original only of payloads that no other identifier has. A null payload is empty.
    """
    document_batches(pages.sparkSession)
    rows = _with_first(pages, id_col, payload_col, url_col, revisit_bytes)
    folder = shared_folder(pages.sparkSession, "warc")

    @tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in text_slices(batches, 2):
            ids, places = [], []
            for identifier, url, payload, refers, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if bundle is None or bundle.size >= bundle_bytes:
                    if bundle is not None:
                        bundle.close()
                    bundle = BundleWriter(folder, frame_bytes)
                record = build_record(identifier, url, payload, refers, refers_to, date)
                ids.append(identifier)
                places.append((bundle.name, *bundle.add(record), len(record)))
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), *(pa.array(list(v), k) for v, k in zip(zip(*places), kinds))],
                names=["id", "bundle", "frame", "offset", "length"])
        if bundle is not None:
            bundle.close()

    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    return folder, stored(rows.mapInArrow(write, f"id string, {INDEX}"), "warc-index")


def read_records(folder: str, index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of an index, or of a part of it: each frame that holds one is unpacked once.

    Columns: id (text), payload_bytes, payload_digest, record_type, refers_to (text), payload (null for revisits,
    and for all if ``with_payload`` is off).
    """
    # an index row is small, but stands for a record to unpack: the records set the number of tasks
    size = index.agg(F.sum("length")).head()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES)
    placed = index.select("bundle", "frame", "offset", "length").repartition(tasks, "bundle", "frame").sortWithinPartitions(
        "bundle", "frame", "offset")

    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, at, plain = None, None, b""
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                found = []
                for name, number, offset, length in zip(
                        *(c.to_pylist() for c in batch.slice(start, 512).columns)):
                    if bundle is None or bundle[0] != name:
                        bundle, at = (name, BundleReader(folder, name)), None
                    if at != number:
                        at, plain = number, bundle[1].frame(number)
                    record = parse_record(plain[offset:offset + length])
                    found.append(record if with_payload else record._replace(payload=None))
                yield pa.RecordBatch.from_pylist([r._asdict() for r in found], schema=schema)

    schema = pa.schema([
        ("identifier", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    return placed.mapInArrow(
        read, "identifier string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, payload binary"
    ).select(F.col("identifier").alias("id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
