"""The structure of ZIP-family containers, read from their bytes.

Own parser, after the public format description: it decides where the container begins behind a launcher prefix, keeps
directory order, and slices every slot into header, data, descriptor and padding so that a file can be put together again.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from dataclasses import dataclass, field

from moraine.functions import codecs

LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
MAX_PREFIX, MAX_ENTRY, ENCRYPTED = 16 << 20, (1 << 31) - 1, 1


class ContainerError(ValueError):
    """The bytes are not a container that can be scanned."""


@dataclass
class Slot:
    name: str
    raw_name: bytes
    is_dir: bool
    flags: int
    method_code: int
    crc32: int
    compressed_size: int
    uncompressed_size: int
    dos_date: int
    dos_time: int
    unix_mode: int | None
    utf8_flag: bool
    utf8_name: bool
    local_offset: int
    header: bytes = b""
    data: bytes = b""
    descriptor: bytes = b""
    pad: bytes = b""
    payload: bytes | None = None
    codec: str | None = None
    fault: str | None = None
    """What is wrong with the slot, if it can be read all the same: a payload of another crc32."""


@dataclass
class Container:
    prefix: bytes
    leading_pad: bytes
    slots: list[Slot]
    tail: bytes
    comment: str
    whole: bool = True
    """Whether the slices cover the file without gap or overlap, so that they give it back byte for byte."""
    fault: str | None = field(default=None)


def end_record(data: bytes) -> int:
    """Where the end-of-directory record begins, whose comment must reach the end of the file; -1 if there is none."""
    low = max(0, len(data) - 22 - 65535)
    at = data.rfind(END, low)
    while at >= 0:
        if at + 22 <= len(data) and at + 22 + struct.unpack_from("<H", data, at + 20)[0] == len(data):
            return at
        at = data.rfind(END, low, at + 3) if at > low else -1
    return -1


def directory_bounds(data: bytes, end: int) -> tuple[int, int, int, int]:
    """(start in the file, start as recorded, size, count) of the directory; 64-bit records win where a locator is there."""
    count, size, offset = struct.unpack_from("<HII", data, end + 10)
    if end >= 20 and data[end - 20 : end - 16] == LOCATOR64:
        at = data.rfind(END64, max(0, end - 20 - (64 << 10)), end - 16)
        if at < 0:
            raise ContainerError("a 64-bit locator without its record")
        count, size, offset = struct.unpack_from("<QQQ", data, at + 32)
        return at - size, offset, size, count
    return end - size, offset, size, count


def extra_field(extra: bytes, wanted: int) -> bytes | None:
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == wanted:
            return extra[at + 4 : at + 4 + size]
        at += 4 + size
    return None


def read_directory(data: bytes, start: int, size: int) -> list[Slot]:
    """Rows in directory order. Other bytes behind at least one row are let be; a cut or encrypted row is an error."""
    out: list[Slot] = []
    at, stop = start, start + size
    while at + 46 <= stop and data[at : at + 4] == CENTRAL:
        made, _, flags, method, time, date, crc, csize, usize, n, m, k, disk, _, attributes, offset = struct.unpack_from("<HHHHHHIIIHHHHHII", data, at + 4)
        if at + 46 + n + m + k > stop:
            raise ContainerError("a cut directory row")
        if flags & ENCRYPTED:
            raise ContainerError("an encrypted slot")
        if disk not in (0, 0xFFFF):
            raise ContainerError("a container of several disks")
        raw, extra = data[at + 46 : at + 46 + n], data[at + 46 + n : at + 46 + n + m]
        wide = extra_field(extra, 1) or b""
        values, place = [usize, csize, offset], 0
        for j, v in enumerate(values):
            if v == 0xFFFFFFFF and place + 8 <= len(wide):
                values[j] = struct.unpack_from("<Q", wide, place)[0]
                place += 8
        usize, csize, offset = values
        try:
            name, good = raw.decode("utf-8"), True
        except UnicodeDecodeError:
            name, good = raw.decode("cp437"), False
        mode = attributes >> 16 if made >> 8 == 3 and attributes >> 16 else None
        out.append(Slot(name, raw, name.endswith("/"), flags, method, crc, csize, usize, date, time, mode, bool(flags & 0x800), good, offset))
        at += 46 + n + m + k
    if size and not out:
        raise ContainerError("no directory row where the directory should begin")
    return out


def layout(data: bytes) -> tuple[int, int, list[Slot], int]:
    """(prefix length, shift of recorded offsets, slots, directory start)."""
    end = end_record(data)
    if end < 0:
        raise ContainerError("not a container: no end-of-directory record")
    start, recorded, size, count = directory_bounds(data, end)
    if start < 0:
        raise ContainerError("the directory begins before the file")
    slots = read_directory(data, start, size)
    if len(slots) != count:
        raise ContainerError(f"the directory has {len(slots)} rows and says {count}")
    if not slots:
        return start, start - recorded, slots, start
    first = min(slots, key=lambda s: s.local_offset)
    for shift in dict.fromkeys((start - recorded, 0)):
        prefix = first.local_offset + shift
        if accepted(data, slots, shift, prefix):
            return (0 if data[:4] == LOCAL else prefix), shift, slots, start
    # Neither way of recording offsets holds: look for the first slot by its name.
    found = find_local(data, first.raw_name)
    if found is not None and accepted(data, slots, found - first.local_offset, found):
        return found, found - first.local_offset, slots, start
    raise ContainerError("the first slot isn't where the directory says")


def accepted(data: bytes, slots: list[Slot], shift: int, prefix: int) -> bool:
    """Whether offsets moved by shift lead to the slots' own local headers, the first of them right behind the prefix.

    Names are compared as well: the header of a slot in a stored container inside this one, which a wrong shift may meet, is refused.
    """
    if not 0 <= prefix <= MAX_PREFIX or data[prefix : prefix + 4] != LOCAL:
        return False
    return all(local_name(data, s.local_offset + shift) == s.raw_name for s in slots)


def local_name(data: bytes, at: int) -> bytes | None:
    """The name in the local header at a place; None if there is none."""
    if at < 0 or data[at : at + 4] != LOCAL or at + 30 > len(data):
        return None
    return data[at + 30 : at + 30 + struct.unpack_from("<H", data, at + 26)[0]]


def find_local(data: bytes, name: bytes, most: int = MAX_PREFIX) -> int | None:
    """The first place behind the beginning, and not beyond `most`, of a local header with this name."""
    at = data.find(LOCAL, 1, most + 4)
    while at >= 0:
        if local_name(data, at) == name:
            return at
        at = data.find(LOCAL, at + 1, most + 4)
    return None


def prefix_length(data: bytes) -> int:
    """The length of the launcher prefix; 0 if there is none, or the bytes are no container."""
    try:
        return layout(data)[0]
    except ContainerError:
        return 0


def split_descriptor(rest: bytes, slot: Slot) -> int:
    """How many of the bytes behind a slot's data are its descriptor; forms of 64 bits come first where the header has 64-bit sizes."""
    n, m = struct.unpack_from("<HH", slot.header, 26) if len(slot.header) >= 30 else (0, 0)
    wide = extra_field(slot.header[30 + n : 30 + n + m], 1) is not None
    for size in (24, 20, 16, 12) if wide else (16, 12, 24, 20):
        signed = size in (16, 24)
        if len(rest) < size or signed != (rest[:4] == b"PK\x07\x08"):
            continue
        if struct.unpack_from("<I", rest, 4 if signed else 0)[0] == slot.crc32:
            return size
    return 0


def scan(data: bytes, payloads: bool = True, max_entry: int = MAX_ENTRY, trials: bool = True) -> Container:
    """The slots of a container with their slices and, unless payloads is false, inflated bytes.

    Without payloads nothing is inflated. A slot that inflates to another size than it says is an error; one with another crc32 has a fault.
    """
    prefix, shift, slots, start = layout(data)
    offsets = sorted({s.local_offset + shift for s in slots})
    out = Container(data[:prefix], b"", slots, data[start:], "", True)
    end = end_record(data)
    out.comment = data[end + 22 :].decode("utf-8", "replace")
    if offsets:
        out.leading_pad = data[prefix : offsets[0]]
    out.whole = len(offsets) == len(slots)
    for s in slots:
        if s.uncompressed_size > max_entry:
            raise ContainerError(f"{s.name}: {s.uncompressed_size} bytes are more than the cap of {max_entry}")
        at = s.local_offset + shift
        k = bisect_right(offsets, at)
        stop = offsets[k] if k < len(offsets) else start
        if data[at : at + 4] != LOCAL:
            raise ContainerError(f"{s.name}: no local header at {at}")
        n, m = struct.unpack_from("<HH", data, at + 26)
        body = at + 30 + n + m
        if body + s.compressed_size > stop:
            out.whole = False
            stop = body + s.compressed_size
        s.header, s.data = data[at:body], data[body : body + s.compressed_size]
        rest = data[body + s.compressed_size : stop]
        size = split_descriptor(rest, s) if s.flags & 8 else 0
        s.descriptor, s.pad = rest[:size], rest[size:]
        if not payloads:
            continue
        if s.method_code == 0:
            s.payload = s.data
        elif s.method_code == 8:
            try:
                s.payload = codecs.inflate(s.data, max(s.uncompressed_size, 1))
            except (ValueError, zlib.error) as e:
                raise ContainerError(f"{s.name}: {e}") from e
            s.codec = codecs.match(s.payload, s.data, s.flags) if trials else None
        else:
            raise ContainerError(f"{s.name}: method {s.method_code} can't be read")
        if len(s.payload) != s.uncompressed_size:
            raise ContainerError(f"{s.name}: {len(s.payload)} bytes instead of {s.uncompressed_size}")
        if zlib.crc32(s.payload) != s.crc32:
            s.fault = f"{s.name}: crc32 {s.crc32:#x} is recorded, {zlib.crc32(s.payload):#x} computed"
    return out


def joined(c: Container) -> bytes:
    """The container's bytes from its slices; only right where c.whole is set."""
    body = b"".join(s.header + s.data + s.descriptor + s.pad for s in sorted(c.slots, key=lambda s: s.local_offset))
    return c.prefix + c.leading_pad + body + c.tail
