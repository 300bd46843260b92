"""Operator 6: media columns whose types are sniffed from signatures.

An Aho-Corasick automaton finds every magic number in one pass; a validator for each format then confirms structure and
declared lengths, so that a stray magic number in other data is rejected. The first valid item at offset 0 corrects the declared
type; valid items further in are carved.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from adtflow.llm.shared import map_arrow, stored

#: The payload is padded with bytes 0 to a positive multiple of this.
BLOCK = 64


class Found(NamedTuple):
    kind: str
    start: int
    end: int
    body_start: int
    body_end: int


def _wav(b: bytes, at: int) -> Found | None:
    """RIFF/WAVE: the chunk lengths must add up to the RIFF length, with a format chunk before a data chunk."""
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    pos, known, body = at + 12, False, None
    while pos + 8 <= end:
        name, size = b[pos : pos + 4], struct.unpack_from("<I", b, pos + 4)[0]
        if pos + 8 + size > end:
            return None
        if name == b"fmt ":
            if size < 16:
                return None
            _, channels, _, _, align, bits = struct.unpack_from("<HHIIHH", b, pos + 8)
            known = channels > 0 and bits in (8, 16, 24, 32) and align == channels * bits // 8
        elif name == b"data":
            body = (pos + 8, pos + 8 + size)
        pos += 8 + size + size % 2
    return Found("audio/wav", at, end, *body) if known and body and pos == end else None


def _au(b: bytes, at: int) -> Found | None:
    if len(b) < at + 24:
        return None
    offset, size, encoding, rate, channels = struct.unpack_from(">5I", b, at + 4)
    if offset < 24 or not 1 <= encoding <= 27 or not 0 < rate <= 768_000 or not 0 < channels <= 64 or at + offset + size > len(b):
        return None
    return Found("audio/basic", at, at + offset + size, at + offset, at + offset + size)


def _bmp(b: bytes, at: int) -> Found | None:
    if len(b) < at + 54:
        return None
    size, zero, offset, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if zero or header != 40 or planes != 1 or bits not in (8, 24, 32) or width <= 0 or height == 0 or offset < 54:
        return None
    if size != offset + (width * bits // 8 + 3) // 4 * 4 * abs(height) or at + size > len(b):
        return None
    return Found("image/bmp", at, at + size, at + offset, at + size)


def _png(b: bytes, at: int) -> Found | None:
    """PNG: every chunk's length and CRC, IHDR first, IEND last."""
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        size = struct.unpack_from(">I", b, pos)[0]
        name, end = b[pos + 4 : pos + 8], pos + 12 + size
        if end > len(b) or first != (name == b"IHDR") or zlib.crc32(b[pos + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if name == b"IEND":
            return Found("image/png", at, end, at, end)
        pos, first = end, False
    return None


def _gif(b: bytes, at: int) -> Found | None:
    """GIF: walks the blocks to the trailer."""
    if len(b) < at + 13 or b[at + 3 : at + 6] not in (b"87a", b"89a"):
        return None
    pos = at + 13 + (3 * 2 ** ((b[at + 10] & 7) + 1) if b[at + 10] & 128 else 0)
    while pos < len(b):
        if b[pos] == 0x3B:
            return Found("image/gif", at, pos + 1, at, pos + 1)
        if b[pos] == 0x21:
            pos += 2
        elif b[pos] == 0x2C and pos + 10 <= len(b):
            pos += 11 + (3 * 2 ** ((b[pos + 9] & 7) + 1) if b[pos + 9] & 128 else 0)
        else:
            return None
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        pos += 1
    return None


def _jpeg(b: bytes, at: int) -> Found | None:
    """JPEG: marker segments with their lengths up to the scan, then the end marker."""
    pos = at + 2
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        marker, size = b[pos + 1], struct.unpack_from(">H", b, pos + 2)[0]
        if size < 2:
            return None
        pos += 2 + size
        if marker == 0xDA:
            end = b.find(b"\xff\xd9", pos)
            return Found("image/jpeg", at, end + 2, at, end + 2) if end >= 0 else None
    return None


def _gzip(b: bytes, at: int) -> Found | None:
    d = zlib.decompressobj(31)
    try:
        rest, size = b[at:], 0
        while rest and not d.eof:
            size += len(d.decompress(rest, 1 << 20))
            rest = d.unconsumed_tail
    except zlib.error:
        return None
    end = len(b) - len(d.unused_data)
    return Found("application/gzip", at, end, at, end) if d.eof else None


def _pdf(b: bytes, at: int) -> Found | None:
    if not b[at + 5 : at + 8].replace(b".", b"").isdigit():
        return None
    end = b.find(b"%%EOF", at)
    return Found("application/pdf", at, end + 5, at, end + 5) if end >= 0 and b.find(b"startxref", at, end) >= 0 else None


def _flac(b: bytes, at: int) -> Found | None:
    pos = at + 4
    if len(b) < pos + 38 or b[pos] & 127 or b[pos + 1 : pos + 4] != b"\x00\x00\x22":
        return None
    while pos + 4 <= len(b):
        last, size = b[pos] & 128, int.from_bytes(b[pos + 1 : pos + 4], "big")
        pos += 4 + size
        if pos > len(b):
            return None
        if last:
            return Found("audio/flac", at, len(b), at, len(b))
    return None


def _ogg(b: bytes, at: int) -> Found | None:
    """Ogg: pages by their segment tables, while they follow each other."""
    pos = at
    while pos + 27 <= len(b) and b[pos : pos + 4] == b"OggS" and b[pos + 4] == 0:
        n = b[pos + 26]
        if pos + 27 + n > len(b):
            break
        size = 27 + n + sum(b[pos + 27 : pos + 27 + n])
        if pos + size > len(b):
            break
        pos += size
    return Found("audio/ogg", at, pos, at, pos) if pos > at else None


#: Magic number and validator.
FORMATS: dict[bytes, Callable[[bytes, int], Found | None]] = {
    b"RIFF": _wav,
    b".snd": _au,
    b"BM": _bmp,
    b"\x89PNG\r\n\x1a\n": _png,
    b"GIF8": _gif,
    b"\xff\xd8\xff": _jpeg,
    b"\x1f\x8b\x08": _gzip,
    b"%PDF-": _pdf,
    b"fLaC": _flac,
    b"OggS": _ogg,
}


@lru_cache(1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic in FORMATS:
        a.add_word(magic.decode("latin-1"), magic)
    a.make_automaton()
    return a


def sniff(b: bytes) -> list[Found]:
    """The valid media items of b, outermost first: an item inside the one before it is embedded in it."""
    found = []
    for last, magic in _automaton().iter(b.decode("latin-1")):
        if item := FORMATS[magic](b, last - len(magic) + 1):
            found.append(item)
    return sorted(found, key=lambda x: (x.start, -x.end))


def carve(b: bytes, items: list[Found]) -> list[bytes]:
    """The bytes of each item."""
    return [b[x.start : x.end] for x in items]


def corrected_type(declared: str | None, items: list[Found]) -> str:
    """The type of the valid item at offset 0; else the declared type, or octet-stream for none."""
    return next((x.kind for x in items if x.start == 0), declared or "application/octet-stream")


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % BLOCK if data else BLOCK)


def to_wav(samples: bytes, rate: int = 8000) -> bytes:
    """8-bit mono PCM."""
    tail = b"\x00" * (len(samples) % 2)
    return (
        b"RIFF"
        + struct.pack("<I", 36 + len(samples) + len(tail))
        + b"WAVEfmt "
        + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
        + b"data"
        + struct.pack("<I", len(samples))
        + samples
        + tail
    )


def encode_media(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: str = "application/octet-stream") -> DataFrame:
    """doc_id, n_bytes, declared type and media: each whole text, padded, as 8-bit WAV samples.

    Null texts are empty ones, which have one block of zeros; null ids stay null; equal texts have equal media; repeated rows each
    have their own; an empty table gives no rows; other columns are not read. A text takes memory in proportion to its own length.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [(x or "").encode() for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array([declared] * len(raw)), pa.array([to_wav(pad(x)) for x in raw], pa.binary())],
            ["doc_id", "n_bytes", "declared", "media"],
        )

    slim = documents.select(documents[id_col].cast("long").alias("doc_id"), documents[text_col].cast("string").alias("text"))
    return map_arrow(slim, each, "doc_id long, n_bytes long, declared string, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """What each stored item holds: payload digests, corrected type and what is embedded in it.

    feature: type, whether it differs from the declared one, place of the samples, number and types of embedded items.
    Null media give null digests and the feature 'none'. Equal media give equal values.
    """

    def row(n: int | None, declared: str | None, b: bytes | None) -> tuple:
        if b is None:
            return (n, None, None, None, None, None, "none")
        items = sniff(b)
        outer = next((x for x in items if x.start == 0), None)
        payload = b[outer.body_start : outer.body_end] if outer else b
        inner = [x for x in items if x.start > 0]
        kind = corrected_type(declared, items)
        feature = f"type={kind};corrected={int(kind != declared)};body={outer.body_start if outer else 0};embedded={len(inner)}" + "".join(f";{x.kind}@{x.start}-{x.end}" for x in inner)
        return (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(b), hashlib.sha256(b).hexdigest(), feature)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(map(row, *(batch.column(i).to_pylist() for i in (1, 2, 3))))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", *NAMES])

    NAMES = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return map_arrow(media.select("doc_id", "n_bytes", "declared", "media"), each, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_round_trip(documents: DataFrame) -> DataFrame:
    """Every text stored as media in the shared folder, read back and described. Nulls, repeated rows and empty tables as above."""
    return read_media(stored(encode_media(documents), "media"))
