"""WARC archives in Zstandard frames with a dictionary in a leading skippable frame.

A file starts, if it has a dictionary, with a skippable frame that holds it; then every record is one frame. So a
reader can decode a record by itself, and a damaged one does not harm the others.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path, stored

# Fixed values of the formats: magic number of the dictionary's skippable frame and of a Zstandard frame, version line.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DATE = "2024-01-01T00:00:00Z"  # capture date of records that have none
FILE_BYTES = 64 << 20  # uncompressed bytes after which a writer begins another file
DICTIONARY_BYTES = 16 << 10
TRAINING_BYTES = 1 << 20  # of a file's first records, about; the dictionary is trained on them
READ_BYTES = 1 << 20

LISTING = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
RECORD = pa.schema(
    [
        ("path", pa.string()),
        ("offset", pa.int64()),
        ("record_type", pa.string()),
        ("record_id", pa.string()),
        ("target_uri", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.string()),
        ("payload", pa.binary()),
        ("error", pa.string()),
    ]
)


class Invalid(ValueError):
    """A record or file that breaks the format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header value on one line: control characters and blanks are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(record_id: str, uri: str | None, payload: bytes, length: int, sha1: str, refers_to: str | None = None, date: str = DATE) -> bytes:
    """One record. A revisit has the headers of the response it refers to and no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_line(record_id)}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_line(uri)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_line(refers_to)}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += [
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes, what: str) -> tuple[str, dict[str, str], bytes]:
    """First line, headers by lower-case name, and what follows the empty line."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise Invalid(f"{what} headers do not end")
    first, *lines = head.decode("utf-8").split("\r\n")
    out = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise Invalid(f"bad {what} header {line[:80]!r}")
        out[name.lower()] = value.strip()
    return first, out, rest


def _length(headers: dict[str, str], what: str) -> int:
    value = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]+", value):
        raise Invalid(f"{what} has no valid Content-Length")
    return int(value)


def _id(value: str) -> str:
    if not re.fullmatch(r"<[^<>\s]*>", value):
        raise Invalid(f"bad identifier {value[:80]!r}")
    return value[1:-1]


def parse_record(data: bytes) -> dict:
    """Fields of one decoded record. Raises Invalid if a header is missing or a length or digest is wrong."""
    version, head, rest = _headers(data, "WARC")
    if version != VERSION:
        raise Invalid(f"version is {version[:40]!r}")
    for name in ("warc-type", "warc-record-id", "warc-date"):
        if not head.get(name):
            raise Invalid(f"no {name}")
    size = _length(head, "record")
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise Invalid(f"block has {len(rest) - 4} bytes, Content-Length says {size}")
    block = rest[:size]
    if (given := head.get("warc-block-digest")) and given != f"sha1:{digest(block)}":
        raise Invalid("block digest differs")
    kind = head["warc-type"]
    if kind not in ("response", "revisit"):
        raise Invalid(f"type {kind[:40]!r} is not read here")
    status, http, payload = _headers(block, "HTTP")
    if not status.startswith("HTTP/"):
        raise Invalid("no HTTP status line")
    length, sha1 = _length(http, "HTTP message"), head.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        if len(payload) != length:
            raise Invalid(f"payload has {len(payload)} bytes, Content-Length says {length}")
        if digest(payload) != sha1:
            raise Invalid("payload digest differs")
    elif payload or not head.get("warc-refers-to"):
        raise Invalid("revisit with a payload or without the record it refers to")
    return {
        "record_type": kind,
        "record_id": _id(head["warc-record-id"]),
        "target_uri": head.get("warc-target-uri"),
        "payload_bytes": length,
        "payload_digest": sha1,
        "refers_to": _id(head["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def _trained(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Dictionary of the samples; None if they are too few or too alike to train one."""
    if len(samples) < 8 or sum(map(len, samples)) < 8 * DICTIONARY_BYTES:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        return None


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class _Writer:
    """Writes records to a file, after a dictionary trained on the first of them."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.waiting: list[bytes] = []
        self.waiting_bytes = self.bytes = self.records = 0
        self.out = self.packer = None

    def add(self, record: bytes) -> None:
        self.records += 1
        self.bytes += len(record)
        if self.out is not None:
            self.out.write(self.packer.compress(record))
            return
        self.waiting.append(record)
        self.waiting_bytes += len(record)
        if self.waiting_bytes >= TRAINING_BYTES:
            self._open()

    def _open(self) -> None:
        trained = _trained(self.waiting)
        fs, path = _filesystem(self.uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(path, compression=None)
        if trained is not None:
            body = trained.as_bytes()
            self.out.write(DICTIONARY_MAGIC.to_bytes(4, "little") + len(body).to_bytes(4, "little") + body)
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True, write_content_size=True)
        for record in self.waiting:
            self.out.write(self.packer.compress(record))
        self.waiting = []

    def close(self) -> dict:
        if self.out is None:
            self._open()
        self.out.close()
        return {"path": self.uri, "records": self.records, "bytes": self.bytes}


def write_archives(rows: DataFrame, folder: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``record_id, uri, payload, payload_bytes, sha1_hex, refers_to`` as archives; returns their ``path, records, bytes``.

    A null ``refers_to`` makes a response, else a revisit, whose payload is not read. Every task writes files of its
    own below ``folder``, a folder of the shared storage. A repeated task writes new files; only those of the task
    that succeeded are listed, and the list itself is stored, so it does not change when an executor is lost.
    """
    folder = folder or scratch_path(rows.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in batches:
            for r in batch.to_pylist():
                payload = (r["payload"] or "").encode() if r["refers_to"] is None else b""
                sha1 = base64.b32encode(bytes.fromhex(r["sha1_hex"])).decode()
                writer = writer or _Writer(folder)
                writer.add(record_bytes(r["record_id"], r["uri"], payload, r["payload_bytes"], sha1, r["refers_to"]))
                if writer.bytes >= file_bytes:
                    done.append(writer.close())
                    writer = None
        if writer is not None:
            done.append(writer.close())
        yield pa.RecordBatch.from_pylist(done, LISTING)

    listed = rows.select("record_id", "uri", "payload", "payload_bytes", "sha1_hex", "refers_to").mapInArrow(write, "path string, records long, bytes long")
    return stored(listed, "warc_listing")


def frames(stream, read_bytes: int = READ_BYTES) -> Iterator[tuple[int, bytes]]:
    """``(offset, record)`` of a file: the dictionary is loaded from a leading skippable frame, then one frame at a time is decoded."""
    held, offset = stream.read(read_bytes), 0
    dictionary = None
    if len(held) >= 8 and int.from_bytes(held[:4], "little") == DICTIONARY_MAGIC:
        size = int.from_bytes(held[4:8], "little")
        while len(held) < 8 + size:
            if not (more := stream.read(read_bytes)):
                raise Invalid("the dictionary frame is cut off")
            held += more
        body = held[8 : 8 + size]
        if body[:4] == FRAME_MAGIC:  # a dictionary may be compressed itself
            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        dictionary, held, offset = zstandard.ZstdCompressionDict(body), held[8 + size :], 8 + size
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
    while held or (held := stream.read(read_bytes)):
        frame, parts, used = decoder.decompressobj(), [], 0
        while True:
            try:
                parts.append(frame.decompress(held))
            except zstandard.ZstdError as e:
                raise Invalid(f"frame at {offset}: {e}") from e
            used += len(held)
            if frame.eof:
                held = frame.unused_data
                used -= len(held)
                break
            if not (held := stream.read(read_bytes)):
                raise Invalid(f"frame at {offset} is cut off")
        yield offset, b"".join(parts)
        offset += used


def read_archives(listing: DataFrame, payloads: bool = True, strict: bool = True) -> DataFrame:
    """The records of the files in ``path``, one row each; files are spread over the tasks and read as streams.

    A task holds one record at a time. ``strict`` raises at the first record or file that breaks the format; else
    such a record is a row with an ``error``, and a file that cannot be decoded further ends with such a row. An
    empty file or list has no records. Without ``payloads`` the payload column is null.
    """

    def rows_of(uri: str) -> Iterator[dict]:
        fs, path = _filesystem(uri)
        offset = 0
        with fs.open_input_stream(path, compression=None) as stream:
            try:
                for offset, data in frames(stream):
                    try:
                        row = parse_record(data)
                    except (Invalid, UnicodeDecodeError) as e:
                        if strict:
                            raise Invalid(f"{uri} at {offset}: {e}") from e
                        row = {"error": str(e)}
                    if not payloads:
                        row["payload"] = None
                    yield {"path": uri, "offset": offset, **row}
            except Invalid as e:
                if strict:
                    raise
                yield {"path": uri, "offset": offset, "error": str(e)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                held, size = [], 0
                for row in rows_of(uri):
                    held.append(row)
                    size += 1000 + len(row.get("payload") or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, RECORD)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, RECORD)

    files = max(1, listing.count())
    schema = "path string, offset long, record_type string, record_id string, target_uri string, payload_bytes long, payload_digest string, refers_to string, payload binary, error string"
    return listing.select("path").repartition(files).mapInArrow(read, schema)


def deduplicated(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """The rows for ``write_archives``: of pages with equal payloads the smallest key is the response, others refer to it.

    Payloads below ``min_bytes`` are always responses. A null payload is empty. Null keys come after all others; if
    only null keys have a payload, each is a response, and so is every repeat of the smallest key. Payloads move in
    one shuffle by their digest, revisits without them; a payload with very many copies is split by the skewed join.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("__key"), F.col(url).cast("string").alias("uri"), body.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1(F.col("payload").cast("binary")).alias("sha1_hex"))
    copies = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy(F.col("sha1_hex").alias("__sha1")).agg(F.min("__key").alias("__first"), F.count("*").alias("__n"))
    joined = rows.join(copies.filter("__n > 1").drop("__n"), F.col("sha1_hex") == F.col("__sha1"), "left")
    revisit = F.col("__first").isNotNull() & (F.col("payload_bytes") >= min_bytes) & ~F.col("__key").eqNullSafe(F.col("__first"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return joined.select(
        name(F.col("__key")).alias("record_id"),
        "uri",
        F.when(~revisit, F.col("payload")).alias("payload"),
        "payload_bytes",
        "sha1_hex",
        F.when(revisit, name(F.col("__first"))).alias("refers_to"),
    )
