"""Putting containers together: byte for byte from slices, with slots encoded anew and a patched directory, or with a new directory.

A container comes as its catalog document (`jar`) and a lookup of payloads by key (`held`). Which writer applies is decided by
`operators.classify.backend`; each writer gives the container's bytes.

Offsets. A directory records where slots begin either from the start of the file or from behind a launcher prefix. The
difference between a slot's place in the file and its record is one number for a container, `offset_shift`: 0 in the first
case, the prefix's length in the second. Writers place slots in the file and record place - shift.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from moraine.functions import codecs

from .pack_format import PackError
from .zip_layout import CENTRAL, END64, LOCAL, LOCATOR64, directory_bounds, end_record

#: Fixed values of the format: the 32-bit value that says "see the 64-bit extra field", that field's id, a descriptor's signature, the descriptor flag.
WIDE, WIDE_FIELD, DESCRIPTOR, HAS_DESCRIPTOR = 0xFFFFFFFF, 1, b"PK\x07\x08", 8

Held = Mapping[str, bytes]


# Small parts.


def header_fields(header: bytes) -> tuple[int, bytes]:
    """Flags and name of a local header, which must be whole."""
    if len(header) < 30 or header[:4] != LOCAL:
        raise PackError("not a local header")
    flags, n, m = struct.unpack_from("<H", header, 6)[0], *struct.unpack_from("<HH", header, 26)
    if 30 + n + m != len(header):
        raise PackError("a local header of another length than it says")
    return flags, header[30 : 30 + n]


def wide_extra(uncompressed: int, compressed: int, offset: int) -> bytes:
    """The 64-bit extra field: only what doesn't fit 32 bits, in this order; nothing if all fit."""
    large = [v for v in (uncompressed, compressed, offset) if v >= WIDE]
    return struct.pack(f"<HH{len(large)}Q", WIDE_FIELD, 8 * len(large), *large) if large else b""


def unsafe(name: bytes | str) -> bool:
    parts = (name.encode() if isinstance(name, str) else name).replace(b"\\", b"/").split(b"/")
    return b".." in parts


def rebuilt_fields(e: dict) -> tuple[int, int, int]:
    """(method, crc32, uncompressed size) of a slot that is encoded anew.

    A directory that isn't an empty stored or an empty deflated one becomes an empty stored one; files of other methods are deflated.
    """
    method, size = e["method_code"], e["uncompressed_size"]
    if e["is_dir"]:
        plain = size == 0 and (method == 8 or method == 0 and e["compressed_size"] == 0)
        return (method, e["crc32"], size) if plain else (0, 0, 0)
    return (method if method in (0, 8) else 8), e["crc32"], size


def prefix_of(jar: dict, held: Held) -> bytes:
    """The launcher prefix; its key and size are recorded both or neither."""
    return _sized(jar, "prefix", held)


def _sized(jar: dict, part: str, held: Held) -> bytes:
    key, size = jar.get(f"{part}_blob"), jar.get(f"{part}_size")
    if (key is None) != (size is None):
        raise PackError(f"{jar.get('name')}: {part}_blob and {part}_size go together")
    if key is None:
        return b""
    data = payload(held, key)
    if len(data) != size:
        raise PackError(f"{jar.get('name')}: the {part} has {len(data)} bytes instead of {size}")
    return data


def payload(held: Held, key: str) -> bytes:
    try:
        return held[key]
    except KeyError:
        raise PackError(f"missing payload {key}") from None


def header_of(e: dict, held: Held) -> bytes:
    if e.get("local_header_hex"):
        return bytes.fromhex(e["local_header_hex"])
    if e.get("local_header_blob"):
        return payload(held, e["local_header_blob"])
    raise PackError(f"{e['name']}: no local header is recorded")


def descriptor_of(e: dict) -> bytes:
    return bytes.fromhex(e.get("data_descriptor_hex") or "")


def pad_of(e: dict, held: Held) -> bytes:
    return payload(held, e["pad_blob"]) if e.get("pad_blob") else bytes(e.get("pad_zeros") or 0)


def content_of(e: dict, held: Held, nested: list[dict]) -> bytes:
    """A slot's payload."""
    if e.get("blob") and e.get("zip_index") is not None:
        raise PackError(f"{e['name']}: both a payload and an expanded container")
    if e.get("zip_index") is not None:
        return child_bytes(nested[e["zip_index"]], held, e["uncompressed_size"])
    if not e.get("blob"):
        raise PackError(f"{e['name']}: no payload is recorded")
    return payload(held, e["blob"])


def data_of(e: dict, held: Held, nested: list[dict], anew: int | None = None) -> bytes:
    """A slot's compressed data: as recorded, else by its codec, else stored; with a level `anew`, else deflated at that level."""
    if e.get("blob") and e.get("zip_index") is not None:
        raise PackError(f"{e['name']}: both a payload and an expanded container")
    if e.get("zip_index") is not None:
        return content_of(e, held, nested)
    if e.get("cdata_blob"):
        return payload(held, e["cdata_blob"])
    if e.get("cdata_codec"):
        return codecs.encode(e["cdata_codec"], payload(held, e["blob"]) if e.get("blob") else b"")
    method, _, size = rebuilt_fields(e) if anew is not None else (e["method_code"], e["crc32"], e["uncompressed_size"])
    if e["is_dir"]:
        if anew is None and e["compressed_size"]:
            raise PackError(f"{e['name']}: a directory whose data isn't recorded")
        return codecs.deflate(b"", anew) if method == 8 and anew is not None else b""
    if method == 0:
        return content_of(e, held, nested)
    if anew is None:
        raise PackError(f"{e['name']}: nothing gives its compressed data")
    return codecs.deflate(content_of(e, held, nested), anew)


def offset_shift(jar: dict, held: Held) -> int:
    """How far a slot lies in the file behind what the directory records."""
    if not jar["entries"]:
        return 0
    first = min(e["local_header_offset"] for e in jar["entries"])
    return (jar.get("prefix_size") or 0) + len(_sized(jar, "leading_pad", held)) - first


# Patches. They write into a bytearray and never change its length.


def patch_fields(record: bytearray, extra: tuple[int, int], fields: list[tuple[int, int | None]]) -> None:
    """Set 32-bit fields (place, new value or None) of a record, given in the order of the 64-bit extra field.

    A field that holds WIDE has its value in the extra field (record[extra[0]:extra[1]]), at the next place there. No extra field is made:
    a value that needs one which isn't there is an error.
    """
    at, stop = extra
    slots = None
    while at + 4 <= stop:
        kind, size = struct.unpack_from("<HH", record, at)
        if kind == WIDE_FIELD:
            slots = (at + 4, min(at + 4 + size, stop))
            break
        at += 4 + size
    used = 0
    for place, value in fields:
        if struct.unpack_from("<I", record, place)[0] == WIDE:
            here = slots[0] + 8 * used if slots else 0
            used += 1
            if value is None:
                continue
            if slots is None or here + 8 > slots[1]:
                raise PackError("a 64-bit value without its extra field")
            struct.pack_into("<Q", record, here, value)
        elif value is not None:
            if value > WIDE:
                raise PackError(f"{value} needs a 64-bit extra field that isn't there")
            struct.pack_into("<I", record, place, value)


def patch_local(header: bytes, method: int, crc32: int, compressed: int, uncompressed: int) -> bytes:
    """A local header for new data: the method always, the rest unless it lies in a descriptor."""
    flags, name = header_fields(header)
    out = bytearray(header)
    struct.pack_into("<H", out, 8, method)
    if not flags & HAS_DESCRIPTOR:
        struct.pack_into("<I", out, 14, crc32)
        patch_fields(out, (30 + len(name), len(out)), [(22, uncompressed), (18, compressed)])
    return bytes(out)


def patch_descriptor(descriptor: bytes, crc32: int, compressed: int, uncompressed: int) -> bytes:
    """A descriptor of the same form (with or without signature, 32- or 64-bit sizes) for new data."""
    if not descriptor:
        return b""
    signature = DESCRIPTOR if descriptor[:4] == DESCRIPTOR and len(descriptor) in (16, 24) else b""
    form = {12: "<III", 20: "<IQQ"}.get(len(descriptor) - len(signature))
    if form is None:
        raise PackError(f"a descriptor of {len(descriptor)} bytes")
    try:
        return signature + struct.pack(form, crc32, compressed, uncompressed)
    except struct.error:
        raise PackError("a descriptor of 32 bits for a larger size") from None


@dataclass(frozen=True)
class Change:
    """A directory row's new values; None leaves one as it is."""

    offset: int | None
    method: int | None = None
    crc32: int | None = None
    compressed: int | None = None
    uncompressed: int | None = None


def patch_directory(tail: bytearray, changes: Callable[[int, int], Change | None], start: int = 0) -> int:
    """Patch the rows of a directory from start on; returns where it ends. changes(row number, recorded offset) gives a row's new values, None ends."""
    at, number = start, 0
    while tail[at : at + 4] == CENTRAL and at + 46 <= len(tail):
        n, m, k = struct.unpack_from("<HHH", tail, at + 28)
        stop = at + 46 + n + m + k
        if stop > len(tail):
            raise PackError(f"directory row {number} is cut")
        extra = (at + 46 + n, at + 46 + n + m)
        change = changes(number, _recorded(tail, at, extra))
        if change is None:
            break
        if change.method is not None:
            struct.pack_into("<H", tail, at + 10, change.method)
        if change.crc32 is not None:
            struct.pack_into("<I", tail, at + 16, change.crc32)
        patch_fields(tail, extra, [(at + 24, change.uncompressed), (at + 20, change.compressed), (at + 42, change.offset)])
        at, number = stop, number + 1
    return at


def _recorded(tail: bytes, at: int, extra: tuple[int, int]) -> int:
    """The offset that a directory row records."""
    compressed, uncompressed = struct.unpack_from("<II", tail, at + 20)
    offset = struct.unpack_from("<I", tail, at + 42)[0]
    if offset != WIDE:
        return offset
    place, stop = extra
    while place + 4 <= stop:
        kind, size = struct.unpack_from("<HH", tail, place)
        if kind == WIDE_FIELD:
            here = place + 4 + 8 * ((uncompressed == WIDE) + (compressed == WIDE))
            if here + 8 <= place + 4 + size <= stop:
                return struct.unpack_from("<Q", tail, here)[0]
        place += 4 + size
    return offset


def patch_end(tail: bytearray, size: int, start: int) -> None:
    """Record a new start of the directory (of size bytes) in the end record, and in the 64-bit one and its locator if there."""
    end = end_record(bytes(tail))
    if end < 0:
        raise PackError("no end-of-directory record")
    if struct.unpack_from("<I", tail, end + 16)[0] != WIDE:
        if start > WIDE:
            raise PackError("the directory begins beyond 32 bits")
        struct.pack_into("<I", tail, end + 16, start)
    locator = end - 20
    if locator >= 0 and tail[locator : locator + 4] == LOCATOR64:
        struct.pack_into("<Q", tail, locator + 8, start + size)
        at = tail.rfind(END64, 0, locator)
        while at >= 0 and at + 12 + struct.unpack_from("<Q", tail, at + 4)[0] != locator:
            at = tail.rfind(END64, 0, at)
        if at < 0:
            raise PackError("a 64-bit locator without its record")
        struct.pack_into("<Q", tail, at + 48, start)


def shifted(container: bytes, by: int) -> bytes:
    """A container whose directory records offsets `by` bytes larger; sizes, methods and local headers stay."""
    end = end_record(container)
    if end < 0:
        raise PackError("no end-of-directory record")
    start, recorded, size, _ = directory_bounds(container, end)
    tail = bytearray(container[start:])
    patch_directory(tail, lambda _, offset: Change(offset + by))
    patch_end(tail, size, recorded + by)
    return container[:start] + bytes(tail)


# A new directory.


@dataclass(frozen=True)
class Row:
    name: bytes
    flags: int
    method: int
    dos_time: int
    dos_date: int
    crc32: int
    compressed: int
    uncompressed: int
    offset: int
    unix_mode: int | None = None


def directory_row(r: Row) -> bytes:
    extra = wide_extra(r.uncompressed, r.compressed, r.offset)
    small = lambda v: min(v, WIDE)
    made, needed = (3 << 8 if r.unix_mode is not None else 0) | 45, 45 if extra else 20
    fixed = (made, needed, r.flags, r.method, r.dos_time, r.dos_date, r.crc32, small(r.compressed), small(r.uncompressed), len(r.name), len(extra), 0, 0, 0)
    return CENTRAL + struct.pack("<HHHHHHIIIHHHHH", *fixed) + struct.pack("<II", (r.unix_mode or 0) << 16 & WIDE, small(r.offset)) + r.name + extra


def synthetic_directory(rows: list[Row], start: int, comment: bytes) -> bytes:
    """Directory and end records for rows; 64-bit records come where a count, a size or a row needs them."""
    if len(comment) > 0xFFFF:
        raise PackError("a comment of more than 65535 bytes")
    if bad := next((r.name for r in rows if unsafe(r.name)), None):
        raise PackError(f"a name with ..: {bad!r}")
    body = b"".join(map(directory_row, rows))
    n, size = len(rows), len(body)
    wide = n > 0xFFFF or size >= WIDE or start >= WIDE or any(wide_extra(r.uncompressed, r.compressed, r.offset) for r in rows)
    if wide:
        body += END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start)
        body += LOCATOR64 + struct.pack("<IQI", 0, start + size, 1)
    count = 0xFFFF if wide else n
    return body + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, count, count, WIDE if wide else size, WIDE if wide else start, len(comment)) + comment


def row_name(e: dict) -> bytes:
    return bytes.fromhex(e["name_raw_hex"]) if e.get("name_raw_hex") else e["name"].encode()


def seek_offset(e: dict, prefix: int, shift: int) -> int:
    """What a new directory records for a slot that stays in its place: its place in the file behind a prefix, else as recorded."""
    return e["local_header_offset"] + shift if prefix else e["local_header_offset"]


def concat_offset(place: int, prefix: int) -> int:
    """The same for a slot that lies `place` bytes behind the prefix."""
    return prefix + place


# Writers.


def exact_bytes(jar: dict, held: Held) -> bytes:
    """A container from its slices, slots in the order of their offsets; or the whole file where that is recorded."""
    parts, nested = [prefix_of(jar, held), _sized(jar, "leading_pad", held)], jar.get("nestedindexes", [])
    if jar.get("raw_zip_blob"):
        return b"".join([*parts, _sized(jar, "raw_zip", held)])
    if not jar.get("tail_blob"):
        raise PackError(f"{jar.get('name')}: neither a directory nor the whole file is recorded")
    for e in sorted(jar["entries"], key=lambda e: e["local_header_offset"]):
        parts += [header_of(e, held), data_of(e, held, nested), descriptor_of(e), pad_of(e, held)]
    return b"".join([*parts, _sized(jar, "tail", held)])


def child_bytes(child: dict, held: Held, size: int) -> bytes:
    """An expanded container, which must have the recorded size."""
    out = exact_bytes(child, held)
    if len(out) != size:
        raise PackError(f"an expanded container of {len(out)} bytes instead of {size}")
    return out


def _anew(jar: dict, held: Held, level: int) -> tuple[bytes, list[Change], list[Row]]:
    """All slots side by side in directory order, without pads, and what a directory says of them; offsets from the first slot on."""
    parts, changes, rows, place = [], [], [], 0
    for e in jar["entries"]:
        method, crc32, uncompressed = rebuilt_fields(e)
        data = data_of(e, held, jar.get("nestedindexes", []), anew=level)
        header = patch_local(header_of(e, held), method, crc32, len(data), uncompressed)
        descriptor = patch_descriptor(descriptor_of(e), crc32, len(data), uncompressed)
        changes.append(Change(place, method, crc32, len(data), uncompressed))
        rows.append(Row(row_name(e), header_fields(header)[0], method, e["dos_time"], e["dos_date"], crc32, len(data), uncompressed, place, e.get("unix_mode")))
        parts += [header, data, descriptor]
        place += len(header) + len(data) + len(descriptor)
    return b"".join(parts), changes, rows


def rebuilt_bytes(jar: dict, held: Held, level: int = 6) -> bytes:
    """Slots encoded anew where nothing else gives their data, side by side, and the recorded directory patched to match."""
    prefix, tail = prefix_of(jar, held), bytearray(_sized(jar, "tail", held))
    if not tail:
        raise PackError(f"{jar['name']}: no directory is recorded")
    if not jar["entries"]:
        return prefix + bytes(tail)
    body, changes, _ = _anew(jar, held, level)
    # Offsets are counted from the file's start or from behind the prefix, as they were.
    behind = len(prefix) - offset_shift(jar, held)
    size = patch_directory(tail, lambda k, _: Change(changes[k].offset + behind, *(getattr(changes[k], c) for c in ("method", "crc32", "compressed", "uncompressed"))) if k < len(changes) else None)
    patch_end(tail, size, len(body) + behind)
    return prefix + body + bytes(tail)


def seek_bytes(jar: dict, held: Held) -> bytes:
    """Slots at their recorded places, and a new directory behind the last."""
    prefix, shift = prefix_of(jar, held), offset_shift(jar, held)
    out, rows = bytearray(prefix + _sized(jar, "leading_pad", held)), []
    for e in jar["entries"]:
        if unsafe(e["name"]):
            raise PackError(f"a name with ..: {e['name']}")
        header, data = header_of(e, held), data_of(e, held, jar.get("nestedindexes", []))
        if len(data) != e["compressed_size"]:
            raise PackError(f"{e['name']}: {len(data)} bytes of data instead of {e['compressed_size']}")
        slot = header + data + descriptor_of(e) + pad_of(e, held)
        at = e["local_header_offset"] + shift
        out.extend(bytes(max(0, at + len(slot) - len(out))))
        out[at : at + len(slot)] = slot
        offset = seek_offset(e, len(prefix), shift)
        rows.append(Row(row_name(e), header_fields(header)[0], e["method_code"], e["dos_time"], e["dos_date"], e["crc32"], len(data), e["uncompressed_size"], offset, e.get("unix_mode")))
    return bytes(out) + synthetic_directory(rows, len(out), jar["comment"].encode())


def concat_bytes(jar: dict, held: Held, level: int = 6) -> bytes:
    """Slots side by side, encoded anew where nothing else gives their data, and a new directory."""
    prefix = prefix_of(jar, held)
    body, _, rows = _anew(jar, held, level)
    rows = [Row(**(vars(r) | {"offset": concat_offset(r.offset, len(prefix))})) for r in rows]
    return prefix + body + synthetic_directory(rows, len(prefix) + len(body), jar["comment"].encode())


def plain_bytes(jar: dict, held: Held, level: int = 6, store_all: bool = False, warn: Callable[[str], None] = lambda text: None) -> bytes:
    """A new container with the slots' payloads, names, times and modes. Names with .. are left out with a warning; payloads are checked by crc32."""
    prefix, out = prefix_of(jar, held), io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = jar["comment"].encode()
        for e in jar["entries"]:
            if unsafe(e["name"]):
                warn(f"left out {jar['name']}!{e['name']}: a name with ..")
                continue
            d, t = e["dos_date"], e["dos_time"]
            when = ((d >> 9) + 1980, (d >> 5) & 15, d & 31, t >> 11, (t >> 5) & 63, (t & 31) * 2)
            good = 1 <= when[1] <= 12 and 1 <= when[2] <= 31 and when[3] < 24 and when[4] < 60 and when[5] < 60
            info = zipfile.ZipInfo(e["name"], when if good else (1980, 1, 1, 0, 0, 0))
            stored = e["is_dir"] or store_all or e["method_code"] == 0 or e.get("zip_index") is not None
            info.compress_type = zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED
            if e.get("unix_mode"):
                info.external_attr, info.create_system = e["unix_mode"] << 16, 3
            data = b"" if e["is_dir"] else content_of(e, held, jar.get("nestedindexes", []))
            if not e["is_dir"] and zlib.crc32(data) != e["crc32"]:
                raise PackError(f"{jar['name']}!{e['name']}: crc32 differs")
            z.writestr(info, data, compresslevel=level)
    made = out.getvalue()
    return prefix + shifted(made, len(prefix)) if prefix else made


def checked(jar: dict, data: bytes) -> bytes:
    """data, if it is the recorded container."""
    if len(data) != jar["source_size"] or hashlib.sha256(data).hexdigest() != jar["source_sha256"]:
        raise PackError(f"{jar['name']}: the restored bytes differ from the recorded hash")
    return data
