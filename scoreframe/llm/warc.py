"""Web archives: write pages as WARC records, read them back as chunk rows.

Oversized payloads are segmented the way the format has it: a response record
with the first chunk and continuation records with the others, none larger than
``chunk_bytes``. Writer and reader see one chunk at a time; digests are carried
from chunk to chunk. Reading gives a table of chunks (record, segment as
``chunk``, part of it, data): a segment longer than a part is several rows,
made while it is read. The rows of one record, which may lie in several files,
meet in order in one stream and never as one value.

Archives that others wrote are read as well: any record names (``page_id`` is
null, ``refers_to_id`` the name that a revisit gives), plain or compressed
files, digests in base 16 or 32, resources beside responses.

Archives are written by Spark's text writer, one volume per file and compressed,
and read by its binary reader, so they go through the same file systems and
commits as all other tables. A lost task writes its volumes again.

Of records with equal payloads of at least ``revisit_bytes`` the one with the
largest page id is a response and the others are revisits without payload.
Copies are found on (id, digest) rows; the pages move only where the list of
revisits is too long to be broadcast.

A null html is an empty payload; a null url has no target header. Pages without
an id are responses of their own. Rows that repeat id and payload are records
of the same name and type, one each. An empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.scale import fits
from .base import saved

CHUNK_BYTES = 1_000_000
VOLUME_BYTES = 16_000_000
REVISIT_BYTES = 1000
HEAD_BYTES = 1_000_000  # the longest header
DATE = "2026-01-01T00:00:00Z"

# Names of the format.
VERSION = b"WARC/1.1\r\n"
PAYLOADS = ("response", "resource", "continuation")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNKS = (
    "record_id string, page_id long, record_type string, refers_to long, refers_to_id string, "
    "target_uri string, payload_bytes long, payload_digest string, chunk int, part int, "
    "last boolean, data binary"
)


def mark_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Add payload (binary), payload_bytes, payload_digest and refers_to."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    known = pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")}
    )
    narrow = saved(
        known.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
        .select("page_id", "payload_digest"),
        "warc-digests",
    )
    heads = narrow.groupBy("payload_digest").agg(
        F.max("page_id").alias("refers_to"), F.min("page_id").alias("__low")
    ).where("__low < refers_to").drop("__low")
    revisits = saved(
        narrow.join(heads, "payload_digest").where("page_id <> refers_to").distinct(), "warc-revisits"
    )
    if fits(revisits):
        revisits = F.broadcast(revisits)
    return known.join(revisits, ["page_id", "payload_digest"], "left")


def _name(page_id: int | None, digest: str, segment: int = 1) -> str:
    tail = f":{segment}" if segment > 1 else ""
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}{tail}>"


def _record(fields: list[tuple[str, str]], block: list[bytes]) -> Iterator[bytes]:
    size, digest = 0, hashlib.sha1()
    for part in block:
        size += len(part)
        digest.update(part)
    lines = [*fields, ("WARC-Block-Digest", f"sha1:{digest.hexdigest()}"),
             ("Content-Length", str(size))]
    yield VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n"
    yield from block
    yield b"\r\n\r\n"


def _cuts(payload: bytes, chunk: int) -> list[int]:
    """Ends of the chunks, moved back to the start of a character."""
    ends, at = [], 0
    while len(payload) - at > chunk:
        end = at + chunk
        while end > at + 1 and payload[end] & 0xC0 == 0x80:
            end -= 1
        ends.append(end)
        at = end
    return [*ends, len(payload)]


def records(page: dict, chunk: int, date: str) -> Iterator[Iterator[bytes]]:
    """The records of one page, as byte parts."""
    payload, digest = page["payload"], page["payload_digest"]
    common = [("WARC-Date", date)]
    if page["url"] is not None:
        common.append(("WARC-Target-URI", quote(page["url"], safe=":/?#[]@!$&'()*+,;=%")))
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    first = [
        ("WARC-Record-ID", _name(page["page_id"], digest)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        *common,
    ]
    if page["refers_to"] is not None:
        yield _record(
            [("WARC-Type", "revisit"), *first, ("WARC-Profile", PROFILE),
             ("WARC-Refers-To", _name(page["refers_to"], digest))], [http]
        )
        return
    cuts = _cuts(payload, chunk)
    view = memoryview(payload)
    segmented = [("WARC-Segment-Number", "1")] if len(cuts) > 1 else []
    yield _record([("WARC-Type", "response"), *first, *segmented], [http, view[: cuts[0]]])
    for k, (a, b) in enumerate(zip(cuts, cuts[1:]), 2):
        total = [("WARC-Segment-Total-Length", str(len(http) + len(payload)))] if b == cuts[-1] else []
        yield _record(
            [("WARC-Type", "continuation"), ("WARC-Record-ID", _name(page["page_id"], digest, k)),
             ("WARC-Segment-Origin-ID", _name(page["page_id"], digest)),
             ("WARC-Segment-Number", str(k)), *common, *total], [view[a:b]]
        )


def write_archive(
    marked: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES,
    volume_bytes: int = VOLUME_BYTES, date: str = DATE, seekable: bool = False,
) -> None:
    """Write the records of ``mark_revisits`` as compressed volumes under ``path``.

    ``seekable`` compresses each record by itself, as tools that look up single
    records want it; Spark then names the files without an ending of their own.
    """
    ending = b"\0" if seekable else b"\n"
    info = b"software: scoreframe\r\nformat: WARC File Format 1.1\r\n"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def volume(parts):
            # The writer ends every file with the byte that is left out here: the line
            # feed of the last record, or the highest byte of its length.
            data = b"".join(parts)
            end = -1 if data.endswith(ending) else len(data)
            return pa.RecordBatch.from_arrays([pa.array([data[:end]], pa.binary())], ["volume"])

        def packed(record):
            return [gzip.compress(b"".join(record), mtime=0)] if seekable else record

        head = list(packed(_record([("WARC-Type", "warcinfo"), ("WARC-Date", date),
                             ("WARC-Record-ID", "<urn:x-volume>"),
                             ("Content-Type", "application/warc-fields")], [info])))
        parts, size, used = list(head), 0, False
        for batch in batches:
            names = batch.schema.names
            for k in range(batch.num_rows):
                page = {n: batch.column(n)[k].as_py() for n in names}
                # A revisit has no payload in the archive, but its length.
                for record in records(page, chunk_bytes, date):
                    for part in packed(record):
                        parts.append(part)
                        size += len(part)
                    used = True
                    if size >= volume_bytes:
                        yield volume(parts)
                        parts, size, used = list(head), 0, False
        if used:
            yield volume(parts)

    columns = ("page_id", "url", "payload", "payload_digest", "refers_to")
    volumes = marked.select(*columns).mapInArrow(run, "volume binary")
    (
        volumes.select(F.col("volume").cast("string").alias("value")).write
        .option("maxRecordsPerFile", 1).option("lineSep", ending.decode())
        .option("compression", "none" if seekable else "gzip").text(path)
    )


class _Stream:
    """Bytes of a volume, plain or compressed, inflated as they are asked for."""

    def __init__(self, data, step: int = 1 << 18):
        self.data, self.step, self.at = memoryview(data), step, 0
        plain = bytes(self.data[:2]) != b"\x1f\x8b"
        self.inflate, self.buffer, self.pos = None if plain else zlib.decompressobj(47), b"", 0

    def _more(self) -> bool:
        while self.at < len(self.data) or (self.inflate and self.inflate.unconsumed_tail):
            given = self.inflate.unconsumed_tail if self.inflate else b""
            if not given:
                given = self.data[self.at : self.at + self.step]
                self.at += len(given)
            if self.inflate is None:
                more = bytes(given)
            elif self.inflate.eof:  # the next member of the file, or the padding at its end
                padding = len(given) - len(bytes(given).lstrip(b"\0"))
                self.at -= len(given) - padding
                if padding < len(given):
                    self.inflate = zlib.decompressobj(47)
                continue
            else:
                more = self.inflate.decompress(given, 4 * self.step)
                self.at -= len(self.inflate.unused_data)
            if more:
                self.buffer = self.buffer[self.pos :] + more
                self.pos = 0
                return True
        return False

    def skip_blank(self) -> None:
        """Past line ends between records."""
        while self.pos < len(self.buffer) or self._more():
            if self.buffer[self.pos] not in b"\r\n":
                return
            self.pos += 1

    def until(self, mark: bytes, most: int = HEAD_BYTES) -> bytes | None:
        """Up to and with ``mark``; None at the end."""
        while (end := self.buffer.find(mark, self.pos)) < 0:
            if len(self.buffer) - self.pos > most:
                raise ValueError("not a record")
            if not self._more():
                if self.pos < len(self.buffer):
                    raise ValueError("the volume ends inside a record")
                return None
        out = self.buffer[self.pos : end + len(mark)]
        self.pos = end + len(mark)
        return out

    def take(self, size: int) -> bytes:
        parts, left = [], size
        while left:
            part = self.buffer[self.pos : self.pos + left]
            if not part and not self._more():
                raise ValueError("the volume ends inside a record")
            parts.append(part)
            self.pos += len(part)
            left -= len(part)
        return b"".join(parts)


def _fields(head: bytes) -> dict[str, str]:
    """Named fields; a line that starts with white space goes on with the one before."""
    lines = re.sub(r"\r?\n[ \t]+", " ", head.decode(errors="replace")).splitlines()
    pairs = (line.partition(":") for line in lines[1:] if line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _page_of(name: str) -> tuple[str, int | None]:
    """(record name of the first segment, page id if the name is one of ours)."""
    if not name.startswith("<urn:x-page:"):
        return name, None
    page, digest = name.strip("<>").split(":")[2:4]
    return f"<urn:x-page:{page}:{digest}>", int(page) if page else None


def _digest(value: str | None) -> tuple[str, str] | None:
    """(algorithm, hexadecimal digits) of a digest field, which may be in base 32."""
    kind, _, digits = (value or "").strip().partition(":")
    kind = kind.lower().replace("-", "")
    if kind not in ("md5", "sha1", "sha256", "sha512"):
        return None
    if len(digits) == 2 * hashlib.new(kind).digest_size:
        return kind, digits.lower()
    try:
        return kind, base64.b32decode(digits.upper() + "=" * (-len(digits) % 8)).hex()
    except ValueError:
        return None


def _number(value: str | None) -> int | None:
    return int(value) if value and value.isascii() and value.isdigit() else None


def parse_volume(data, part_bytes: int = CHUNK_BYTES, verify: bool = True) -> Iterator[tuple]:
    """Chunk rows of one volume, as in CHUNKS, made while a record is read.

    No more than ``part_bytes`` of a record and its header are held, whatever
    its length. ``verify`` raises where a block digest does not hold.
    """
    stream = _Stream(data)
    while True:
        stream.skip_blank()
        head = stream.until(b"\r\n\r\n")
        if head is None:
            return
        fields = _fields(head)
        left = _number(fields.get("content-length"))
        if not head.startswith(b"WARC/") or left is None or "warc-record-id" not in fields:
            raise ValueError("not a record")
        name, known = fields["warc-record-id"], _digest(fields.get("warc-block-digest"))
        running = hashlib.new(known[0]) if known and verify else None
        kind = fields.get("warc-type", "").lower()
        if kind == "continuation":
            name = fields.get("warc-segment-origin-id", name)
            last = "warc-segment-total-length" in fields
        else:
            last = "warc-segment-number" not in fields
        record, page = _page_of(name)
        chunk = _number(fields.get("warc-segment-number")) or 1
        size = refers = refers_id = None
        digest = _digest(fields.get("warc-payload-digest"))
        digest = digest[1] if digest and digest[0] == "sha1" else None

        held = stream.take(min(left, part_bytes))
        left -= len(held)
        if running:
            running.update(held)
        if kind in ("response", "revisit") and held.startswith(b"HTTP/"):
            while (end := held.find(b"\r\n\r\n")) < 0 and left and len(held) < HEAD_BYTES:
                more = stream.take(min(left, part_bytes))
                left -= len(more)
                held += more
                if running:
                    running.update(more)
            if end >= 0:
                size = _number(_fields(held[: end + 4]).get("content-length"))
                held = held[end + 4 :]
        if kind == "revisit":
            refers_id = fields.get("warc-refers-to")
            refers = _page_of(refers_id)[1] if refers_id else None
        own = (record, page, "response" if kind == "continuation" else kind, refers, refers_id,
               fields.get("warc-target-uri"), size, digest, chunk)
        part = 1
        while left:
            if kind in PAYLOADS:
                yield *own, part, False, held
                part += 1
            held = stream.take(min(left, part_bytes))
            left -= len(held)
            if running:
                running.update(held)
        if running and running.hexdigest() != known[1]:
            raise ValueError(f"damaged record {name}")
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError(f"record {name} is longer than it says")
        if kind in PAYLOADS:
            yield *own, part, last, held
        elif kind == "revisit":
            yield *own, 1, True, None


def read_archive(
    spark: SparkSession, path: str, part_bytes: int = CHUNK_BYTES, verify: bool = True
) -> DataFrame:
    """The chunk table of all volumes under ``path``, or matching it, whoever wrote them.

    Volumes are plain or compressed, whole or record by record; names don't
    matter. One volume is one value of Spark's binary reader (under 2 GB as
    stored); records are inflated and cut as they are read. Requests, metadata
    and the like give no rows. Payloads are the bytes after the HTTP header, as
    stored; records that are no HTTP message are payload as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(),
                 pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
        names = [field.split()[0] for field in CHUNKS.split(", ")]

        def table(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names
            )

        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for row in parse_volume(content.as_buffer(), part_bytes, verify):
                    rows.append(row)
                    size += len(row[-1] or b"") + 200
                    if size > 4 * CHUNK_BYTES:
                        yield table(rows)
                        rows, size = [], 0
                yield table(rows)

    volumes = spark.read.format("binaryFile").load(path)
    return volumes.select("content").mapInArrow(run, CHUNKS)


RECORDS = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
)


def summarise(chunks: DataFrame) -> DataFrame:
    """One row per record, with the length and digest of the payload that was read.

    Whole records are digested where they are; the chunks of segmented ones are
    brought together in order, and a running digest goes over them. Revisits
    have the length and digest of the record that they name.
    """
    single = "chunk = 1 and part = 1 and last"
    whole = chunks.where(single).select(
        "page_id",
        F.when(F.col("record_type") == "revisit", F.col("payload_bytes"))
        .otherwise(F.octet_length("data").cast("long")).alias("payload_bytes"),
        F.when(F.col("record_type") == "revisit", F.col("payload_digest"))
        .otherwise(F.sha1("data")).alias("payload_digest"),
        "record_type", "refers_to",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, copies, done, name, number, closed = None, 0, [], None, (0, 0), True

        def end():
            if state is not None:
                if not closed:
                    raise ValueError(f"{name} lacks a chunk")
                done.extend([(page, size, state.hexdigest(), kind, None)] * copies)

        for batch in batches:
            for row in range(batch.num_rows):
                here, chunk, part, last = (
                    batch.column(c)[row].as_py() for c in ("record_id", "chunk", "part", "last")
                )
                if here != name:
                    end()
                    name, state, copies, number, size = here, hashlib.sha1(), 0, (0, 0), 0
                    page, kind = (batch.column(c)[row].as_py() for c in ("page_id", "record_type"))
                if (chunk, part) == number:  # a row that repeats id and payload
                    copies += number == (1, 1)
                    continue
                if (chunk, part) not in ((number[0], number[1] + 1), (number[0] + 1, 1)):
                    raise ValueError(f"{name} lacks a chunk")
                copies, closed = copies + ((chunk, part) == (1, 1)), last
                data = batch.column("data")[row].as_buffer()
                state.update(data)
                size += data.size
                number = (chunk, part)
            if done:
                yield _table(done)
                done.clear()
        end()
        yield _table(done)

    parts = (
        chunks.where(f"not ({single})")
        .select("record_id", "page_id", "record_type", "chunk", "part", "last", "data")
        .repartition("record_id").sortWithinPartitions("record_id", "chunk", "part")
        .mapInArrow(run, RECORDS)
    )
    return whole.unionByName(parts)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = [field.split()[0] for field in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names
    )
