"""The pack file: header, compressed frames of records, table of contents, trailer.

A pack begins with magic, a length and a JSON header; then come zstd frames of records (tag, key, size, payload), of which
the last holds the catalog and the end record; then the table of contents (56 bytes for each payload) and a trailer of
64 bytes. Version 1 has one frame and no table of contents. A dialect names the magics and format names, so that packs of
the same layout under other names can be read and written by giving theirs.
"""

from __future__ import annotations

import codecs
import io
import json
import shutil
import struct
import tempfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import zstandard

from moraine.functions.scalar import BLOB_RECORD_OVERHEAD, TOC_ENTRY, TOC_OVERHEAD, TRAILER

#: Fixed values of the layout.
BLOB, CATALOG, END_RECORD = 1, 2, 3
FRAME_LIMIT = 4 << 20


@dataclass(frozen=True)
class Dialect:
    magic: bytes = b"MRNP"
    toc_magic: bytes = b"MRNPTOC2"
    trailer_magic: bytes = b"MRNPTLR1"
    format: str = "moraine-pack"
    catalog_format: str = "moraine-catalog"
    tool: str = "moraine"
    hash: str = "blake3"
    tags: tuple[int, int, int] = (BLOB, CATALOG, END_RECORD)


MORAINE = Dialect()


class PackError(ValueError):
    """The file isn't a sound pack."""


@dataclass
class Layout:
    header: dict
    header_total: int
    version: int
    payload_bytes: int
    catalog_length: int
    blob_count: int
    blob_bytes: int
    container_count: int
    toc_length: int


@dataclass
class Pieces:
    """A record that is written piece by piece and never held whole: its length, and the pieces that give it."""

    length: int
    parts: Iterable[bytes]


class Part:
    """The next `length` bytes of a file as a stream."""

    def __init__(self, f: BinaryIO, length: int):
        self.f, self.left = f, length

    def read(self, n: int = -1) -> bytes:
        data = self.f.read(self.left if n < 0 else min(n, self.left))
        self.left -= len(data)
        return data


def write_header(out: BinaryIO, dialect: Dialect, version: int, level: int, created: int, tool_version: str = "1") -> int:
    body = json.dumps({"format": dialect.format, "version": version, "hash": dialect.hash, "sha256": True, "mode": "content", "zstd_level": level, "created_unix": created, "tool": dialect.tool, "tool_version": tool_version}, separators=(",", ":")).encode()
    out.write(dialect.magic + bytes([version, 0, 0, 0]) + struct.pack("<I", len(body)) + body)
    return len(body)


def blob_record(dialect: Dialect, key: bytes, data: bytes) -> bytes:
    return bytes([dialect.tags[0]]) + key + struct.pack("<Q", len(data)) + data


def last_pieces(dialect: Dialect, catalog: bytes | Pieces, digest: bytes) -> Iterator[bytes]:
    """The catalog's record and the end record, piece by piece."""
    whole = Pieces(len(catalog), [catalog]) if isinstance(catalog, bytes) else catalog
    yield bytes([dialect.tags[1]]) + struct.pack("<Q", whole.length)
    done = 0
    for part in whole.parts:
        done += len(part)
        yield part
    if done != whole.length:
        raise PackError(f"the catalog has {done} bytes instead of {whole.length}")
    yield bytes([dialect.tags[2]]) + digest


def last_records(dialect: Dialect, catalog: bytes, digest: bytes) -> bytes:
    return b"".join(last_pieces(dialect, catalog, digest))


def compress(data: bytes, level: int) -> bytes:
    return zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False).compress(data)


def _take(stream: BinaryIO, n: int, what: str) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise PackError(f"cut {what}")
    return data


def _heads(stream: BinaryIO, dialect: Dialect) -> Iterator[tuple[int, bytes | None, int]]:
    """(tag, key, length) in order: payloads, then one catalog, then the end. Who asks for the next has read that length."""
    tag_blob, tag_catalog, tag_end = dialect.tags
    seen = False
    while tag := stream.read(1):
        if tag[0] == tag_blob:
            if seen:
                raise PackError("a payload behind the catalog")
            key = _take(stream, 32, "payload header")
            yield tag_blob, key, struct.unpack("<Q", _take(stream, 8, "payload header"))[0]
        elif tag[0] == tag_catalog:
            if seen:
                raise PackError("two catalogs")
            seen = True
            yield tag_catalog, None, struct.unpack("<Q", _take(stream, 8, "catalog header"))[0]
        elif tag[0] == tag_end:
            if not seen:
                raise PackError("no catalog")
            yield tag_end, None, 32
            return
        else:
            raise PackError(f"unknown record type {tag[0]}")
    raise PackError("no end record")


def records(stream: BinaryIO, dialect: Dialect) -> Iterator[tuple[int, bytes | None, bytes]]:
    """(tag, key, bytes) in order: payloads, then one catalog, then the end."""
    what = dict(zip(dialect.tags, ("payload", "catalog", "end record")))
    for tag, key, length in _heads(stream, dialect):
        yield tag, key, _take(stream, length, what[tag])


def toc_rows(f: BinaryIO, layout: Layout, dialect: Dialect = MORAINE, block: int = 1 << 14) -> Iterator[tuple[bytes, int, int, int]]:
    """(key, frame offset, frame length, record offset) of each payload, read block by block."""
    catalog_place(f, layout, dialect)
    f.seek(layout.header_total + layout.payload_bytes + 12)
    rest = Part(f, layout.toc_length - TOC_OVERHEAD)
    while data := rest.read(block * TOC_ENTRY):
        for at in range(0, len(data), TOC_ENTRY):
            yield (data[at : at + 32], *struct.unpack_from("<QQQ", data, at + 32))


def catalog_place(f: BinaryIO, layout: Layout, dialect: Dialect = MORAINE) -> tuple[int, int]:
    """Offset and length of the frame of the catalog, which the table of contents ends with."""
    if layout.toc_length < TOC_OVERHEAD or (layout.toc_length - TOC_OVERHEAD) % TOC_ENTRY:
        raise PackError("the table of contents has an impossible length")
    at = layout.header_total + layout.payload_bytes
    f.seek(at)
    head = f.read(12)
    if head[:8] != dialect.toc_magic:
        raise PackError("wrong magic of the table of contents")
    if struct.unpack("<I", head[8:])[0] != (layout.toc_length - TOC_OVERHEAD) // TOC_ENTRY:
        raise PackError("the table of contents has another count than its length says")
    f.seek(at + layout.toc_length - 16)
    return struct.unpack("<QQ", f.read(16))


def diagnosis(head: bytes, tail: bytes, dialect: Dialect) -> str:
    """Why a file without a trailer isn't a pack."""
    if head.startswith(b"#!"):
        return "a script or an executable container, not a pack"
    if head[:4] in (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08") or b"PK\x05\x06" in tail:
        return "a container, not a pack"
    if head.startswith(dialect.magic):
        return "a pack whose trailer is missing or cut"
    return f"not a pack: its trailer begins with {tail[:8].hex()}"


def open_layout(f: BinaryIO, dialect: Dialect = MORAINE) -> Layout:
    size = f.seek(0, io.SEEK_END)
    f.seek(max(0, size - TRAILER))
    tail = f.read(TRAILER)
    f.seek(0)
    head = f.read(12)
    if len(tail) < TRAILER or tail[:8] != dialect.trailer_magic:
        raise PackError(diagnosis(head, tail, dialect))
    payload, catalog, count, total, containers, header_length, version, toc = struct.unpack("<QQQQQIIQ", tail[8:])
    if head[:4] != dialect.magic or head[5:8] != b"\0\0\0":
        raise PackError("wrong magic of the header")
    if head[4] not in (1, 2):
        raise PackError(f"version {head[4]} is not known")
    body = f.read(struct.unpack("<I", head[8:12])[0])
    header = json.loads(body)
    if header.get("format") != dialect.format:
        raise PackError(f"the header's format is {header.get('format')!r}")
    if len(body) != header_length:
        raise PackError("the header is not as long as the trailer says")
    if not head[4] == header.get("version") == version:
        raise PackError("magic, header and trailer differ in version")
    if toc != size - TRAILER - 12 - header_length - payload:
        raise PackError("the table of contents is not as long as the trailer says")
    if (version == 1) != (toc == 0):
        raise PackError("a table of contents in version 1, or none in version 2")
    return Layout(header, 12 + header_length, version, payload, catalog, count, total, containers, toc)


def read_all(f: BinaryIO, dialect: Dialect = MORAINE) -> tuple[Layout, Iterator[tuple[int, bytes | None, bytes]]]:
    """Layout and all records, one after the other."""
    layout = open_layout(f, dialect)
    f.seek(layout.header_total)
    whole = Part(f, layout.payload_bytes)
    return layout, records(zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=layout.version == 2), dialect)


def _last_stream(f: BinaryIO, layout: Layout, dialect: Dialect) -> BinaryIO:
    """What holds the catalog and the end: of version 2 the last frame, of version 1 the only one, payloads and all."""
    offset, length = (0, layout.payload_bytes) if layout.version == 1 else catalog_place(f, layout, dialect)
    f.seek(layout.header_total + offset)
    return zstandard.ZstdDecompressor().stream_reader(Part(f, length))


def read_pieces(f: BinaryIO, dialect: Dialect = MORAINE, size: int = 1 << 20) -> Iterator[bytes]:
    """The catalog in pieces of up to `size` bytes, then the end digest. Payloads before it (version 1) are passed over; nothing longer than a piece is held."""
    stream = _last_stream(f, open_layout(f, dialect), dialect)
    for tag, _, length in _heads(stream, dialect):
        what = "payload" if tag == dialect.tags[0] else "catalog" if tag == dialect.tags[1] else "end record"
        while length:
            piece = _take(stream, min(size, length), what)
            length -= len(piece)
            if tag != dialect.tags[0]:
                yield piece


def values(pieces: Iterable[str]) -> Iterator[tuple[str, int | None, str]]:
    """(key, place, JSON text) of what a JSON object holds, from its text in pieces: of a list each element with its place, other values whole, without one.

    An empty list gives (key, None, "[]"). No more than one value is held, and the piece behind it.
    """
    decode, rest = json.JSONDecoder().raw_decode, iter(pieces)
    text, at, ended = "", 0, False

    def more() -> None:
        nonlocal text, at, ended
        kept, parts, n = text[at:], [], 0
        while not n or n < len(kept):  # twice as much each time, so that a long value isn't tried over and over
            part = next(rest, None)
            if part is None:
                ended = True
                break
            parts.append(part)
            n += len(part)
        text, at = kept + "".join(parts), 0

    def peek() -> str:
        nonlocal at
        while True:
            while at < len(text) and text[at] in " \t\n\r":
                at += 1
            if at < len(text):
                return text[at]
            if ended:
                raise PackError("the catalog's JSON is cut")
            more()

    def expect(marks: str) -> str:
        nonlocal at
        if (c := peek()) not in marks:
            raise PackError(f"the catalog's JSON has {c!r} where {marks!r} should be")
        at += 1
        return c

    def value() -> str:
        nonlocal at
        peek()
        while True:
            try:
                _, end = decode(text, at)
                if ended or end < len(text) and text[end] in " \t\n\r,:]}":  # else a number may go on
                    break
            except ValueError as e:
                if ended:
                    raise PackError(f"the catalog's JSON: {e}") from e
            more()
        found, at = text[at:end], end
        return found

    expect("{")
    seen: set[str] = set()
    while peek() != "}":
        if seen:
            expect(",")
        key = json.loads(value())
        if not isinstance(key, str) or key in seen:
            raise PackError(f"the catalog's JSON has the key {key!r} twice, or no text as a key")
        seen.add(key)
        expect(":")
        if peek() != "[":
            yield key, None, value()
            continue
        expect("[")
        place = 0
        if peek() == "]":
            yield key, None, "[]"
        while peek() != "]":
            if place:
                expect(",")
            yield key, place, value()
            place += 1
        expect("]")
    expect("}")
    if text[at:].strip(" \t\n\r") or any(part.strip(" \t\n\r") for part in rest):
        raise PackError("the catalog's JSON has something behind it")


def catalog_values(f: BinaryIO, dialect: Dialect = MORAINE) -> Iterator[tuple[str, int | None, str]]:
    """values() of a pack's catalog, then ("end", None, the end digest in hex as JSON)."""
    decoder, last = codecs.getincrementaldecoder("utf-8")(), b""

    def texts() -> Iterator[str]:
        nonlocal last
        for piece in read_pieces(f, dialect):
            before, last = last, piece
            if before:
                yield decoder.decode(before)

    for key, place, text in values(texts()):
        if key != "end":
            yield key, place, text
    yield "end", None, json.dumps(last.hex())


def read_last(f: BinaryIO, dialect: Dialect = MORAINE) -> tuple[Layout, bytes, bytes]:
    """Layout, catalog and end digest, of version 2 from the last frame alone. The catalog is held whole."""
    layout = open_layout(f, dialect)
    *pieces, end = read_pieces(f, dialect)
    return layout, b"".join(pieces), end


def read_catalog(f: BinaryIO, dialect: Dialect = MORAINE) -> tuple[Layout, dict]:
    layout, catalog, _ = read_last(f, dialect)
    return layout, json.loads(catalog)


def check_finished(path: str, layout: Layout, dialect: Dialect = MORAINE) -> None:
    """Whether a file that was just written is as long as its parts, and ends with a trailer."""
    expected = layout.header_total + layout.payload_bytes + layout.toc_length + TRAILER
    with open(path, "rb") as f:
        size = f.seek(0, io.SEEK_END)
        if size != expected:
            raise PackError(f"{size} bytes were written instead of {expected}")
        f.seek(size - TRAILER)
        if f.read(8) != dialect.trailer_magic:
            raise PackError("no trailer at the end of what was written")


def write_pack(out: BinaryIO, frames: Iterable[tuple[bytes, list[tuple[bytes, int, int]]]], catalog: Callable[[], bytes | Pieces], digest: bytes, containers: int, level: int = 6, created: int = 0, dialect: Dialect = MORAINE) -> Layout:
    """Write a pack of version 2 from compressed frames and, for each, (key, record offset, payload size) of its payloads.

    The table of contents, 56 bytes a payload, waits in a temporary file until the catalog is written.
    """
    header_length = write_header(out, dialect, 2, level, created)
    payload, count, total = 0, 0, 0
    with tempfile.TemporaryFile() as rows_behind:
        for data, rows in frames:
            out.write(data)
            rows_behind.write(b"".join(key + struct.pack("<QQQ", payload, len(data), place) for key, place, _ in rows))
            payload, count, total = payload + len(data), count + len(rows), total + sum(size for _, _, size in rows)
        body, start = catalog(), out.tell()
        with _compressed(out, level) as frame:
            for piece in last_pieces(dialect, body, digest):
                frame.write(piece)
        last = out.tell() - start
        out.write(dialect.toc_magic + struct.pack("<I", count))
        rows_behind.seek(0)
        shutil.copyfileobj(rows_behind, out, 1 << 20)
        out.write(struct.pack("<QQ", payload, last))
    payload, table, length = payload + last, TOC_OVERHEAD + TOC_ENTRY * count, _length(body)
    out.write(dialect.trailer_magic + struct.pack("<QQQQQIIQ", payload, length, count, total, containers, header_length, 2, table))
    return Layout({}, 12 + header_length, 2, payload, length, count, total, containers, table)


def _length(catalog: bytes | Pieces) -> int:
    return len(catalog) if isinstance(catalog, bytes) else catalog.length


def _compressed(out: BinaryIO, level: int):
    return zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False).stream_writer(out, closefd=False)


def write_pack_v1(out: BinaryIO, rows: Iterable[tuple[bytes, bytes]], catalog: bytes | Pieces, digest: bytes, containers: int, level: int = 6, created: int = 0, dialect: Dialect = MORAINE) -> Layout:
    """Write a pack of version 1: one frame, which takes the payloads (key, bytes) one by one, and no table of contents."""
    header_length = write_header(out, dialect, 1, level, created)
    start, count, total = out.tell(), 0, 0
    with _compressed(out, level) as frame:
        for key, data in rows:
            frame.write(blob_record(dialect, key, data))
            count, total = count + 1, total + len(data)
        for piece in last_pieces(dialect, catalog, digest):
            frame.write(piece)
    size = out.tell() - start
    out.write(dialect.trailer_magic + struct.pack("<QQQQQIIQ", size, _length(catalog), count, total, containers, header_length, 1, 0))
    return Layout({}, 12 + header_length, 1, size, _length(catalog), count, total, containers, 0)


def record_length(size: int) -> int:
    return size + BLOB_RECORD_OVERHEAD
