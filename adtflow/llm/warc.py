"""Operator 9: WARC archives of Zstandard frames with a dictionary in the leading skippable frame.

An archive is one binary value: a skippable frame with the dictionary, then a frame for each record. Archives are rows of a table,
so that any store that Spark reaches can hold them. Equal payloads of at least MIN_SHARED bytes are stored once.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtflow.llm.shared import stored, text_or_empty

#: Payloads below this many bytes are always stored in full.
MIN_SHARED = 1000
#: Magic number of the skippable frame that holds a dictionary (fixed by the format).
DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: Bytes of compressed records after which an archive is closed.
ARCHIVE_BYTES = 4 << 20
#: Records are gathered up to this many bytes to train an archive's dictionary.
SAMPLE_BYTES = 1 << 20
DICT_BYTES = 16 << 10
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


class ArchiveError(ValueError):
    """An archive that breaks the format: magic numbers, lengths, headers or digests."""


#: Groups of equal payloads are broadcast up to this many (of about 100 bytes each).
BROADCAST_ROWS = 200_000


def _header(text: str | None) -> str:
    """A header value on one line of printable ASCII; the rest percent-encoded."""
    return re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), text or "about:blank")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit of page refers_to: HTTP header alone, with the full payload's length."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_header(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def archives(records: Iterator[bytes]) -> Iterator[bytes]:
    """Archives of the records, in order; one archive and one sample are in memory at a time."""
    more = True
    while more:
        sample, size = [], 0
        for r in records:
            sample.append(r)
            size += len(r)
            if size >= SAMPLE_BYTES:
                break
        else:
            more = False
        if not sample:
            return
        raw = b""
        if len(sample) >= 16:  # fewer give no dictionary; the skippable frame is then empty
            try:
                raw = zstd.train_dictionary(DICT_BYTES, [r[:8192] for r in sample], k=256, d=8).as_bytes()
            except zstd.ZstdError:  # too little variety to train on
                raw = b""
        c = zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(raw) if raw else None, write_checksum=True, write_content_size=True)
        out = [struct.pack("<II", DICT_MAGIC, len(raw)) + raw, *map(c.compress, sample)]
        size = sum(map(len, out))
        sample = []
        while more and size < ARCHIVE_BYTES:
            r = next(records, None)
            if r is None:
                more = False
            else:
                out.append(c.compress(r))
                size += len(out[-1])
        yield b"".join(out)


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, a frame each; raises ArchiveError where the format is broken."""
    if len(data) < 8:
        raise ArchiveError("no leading frame")
    magic, size = struct.unpack_from("<II", data)
    if magic != DICT_MAGIC or 8 + size > len(data):
        raise ArchiveError("the leading frame holds no dictionary")
    raw = data[8 : 8 + size]
    if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # a dictionary may itself be compressed
        raw = zstd.ZstdDecompressor().decompress(raw)
    d = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw) if raw else None)
    view, pos = memoryview(data), 8 + size
    while pos < len(data):
        if data[pos : pos + 4] != struct.pack("<I", FRAME_MAGIC):
            raise ArchiveError(f"no frame at {pos}")
        frame = d.decompressobj()
        try:
            # a slice that is longer than most frames; the rest is handed in only if needed
            step, parts, end = 1 << 16, [], pos
            while not frame.eof:
                if end >= len(data):
                    raise ArchiveError(f"the frame at {pos} is cut off")
                parts.append(frame.decompress(view[end : end + step]))
                end += step
        except zstd.ZstdError as e:
            raise ArchiveError(f"the frame at {pos} is broken: {e}") from e
        pos = min(end, len(data)) - len(frame.unused_data)
        yield b"".join(parts)


def parse_record(r: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload length, payload digest (hex), type and the page referred to; raises ArchiveError where invalid."""
    head, sep, rest = r.partition(b"\r\n\r\n")
    lines = head.decode("ascii", "strict").split("\r\n")
    if not sep or lines[0] != "WARC/1.1":
        raise ArchiveError("no WARC header")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    try:
        length, kind, digest = int(fields["Content-Length"]), fields["WARC-Type"], fields["WARC-Payload-Digest"]
        page = fields["WARC-Record-ID"]
    except KeyError as e:
        raise ArchiveError(f"header {e} is missing") from e
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ArchiveError("the record's length is wrong")
    http, sep, payload = rest[:length].partition(b"\r\n\r\n")
    m = re.search(rb"\r\nContent-Length: (\d+)", http)
    if not sep or not m or not digest.startswith("sha1:"):
        raise ArchiveError("no HTTP header or digest")
    size, digest = int(m[1]), base64.b32decode(digest[5:]).hex()
    if kind == "response":
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ArchiveError("the payload differs from its length or digest")
    elif kind != "revisit" or payload or fields.get("WARC-Profile") != PROFILE:
        raise ArchiveError("not a valid revisit")
    number = lambda x: None if x == "<urn:page:none>" else int(x[10:-1])
    return number(page), size, digest, kind, number(fields["WARC-Refers-To"]) if kind == "revisit" else None


def write_archives(pages: DataFrame) -> DataFrame:
    """A table with one binary column, archive, of all pages; each task writes its own archives.

    The response to a group of equal payloads is found first, on digests alone, and sent to the pages where it is proven small, so that
    no html moves; beyond that the pages are joined by digest, a group of any size being many rows to one, whose skewed partitions
    Spark splits. Null html is an empty payload, a null URL about:blank, a null page_id the page none; repeated pages have a record
    each; an empty table gives no archives; other columns are not read.
    """
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
    marked = slim.withColumn("digest", F.sha1("html")).withColumn("size", F.octet_length("html"))
    shared = (
        marked.filter(F.col("size") >= MIN_SHARED)
        .groupBy("digest", "size")
        .agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .select("digest", "size", "response")
    )
    shared = stored(shared, "shared", compact=True)
    rows = marked.join(F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared, ["digest", "size"], "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response")).alias("refers_to"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (record(i, u, h.encode(), to) for b in batches for i, u, h, to in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for a in archives(records):
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.binary())], ["archive"])

    return rows.mapInArrow(each, "archive binary")


def read_archives(table: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record.

    A null archive holds no records; a damaged one is an ArchiveError. Repeated archives are read each time; an empty table gives no
    rows; other columns are not read.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in b.column(0).drop_null():
                rows = [parse_record(r) for r in read_archive(a.as_py())]
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return table.select("archive").mapInArrow(each, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """All pages written to archives in the shared folder and read back.

    Null html is an empty payload, a null URL about:blank. Rows that share the largest page_id of a group of equal payloads are
    all responses; a group without any page_id has only responses. An empty table gives no rows. Other columns are not read.
    """
    return read_archives(stored(write_archives(pages), "warc", "uncompressed"))
