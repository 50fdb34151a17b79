"""Raw deflate: inflating with a cap, and finding the encoder settings that give the same bytes again."""

from __future__ import annotations

import zlib


def inflate(data: bytes, cap: int) -> bytes:
    """The inflated bytes; an error beyond cap, or if the stream isn't whole."""
    d = zlib.decompressobj(-15)
    out = d.decompress(data, cap + 1)
    if len(out) > cap:
        raise ValueError(f"inflates to more than {cap} bytes")
    if not d.eof:
        raise ValueError("the deflate stream ends early")
    return out


def stored_deflate(data: bytes) -> bytes:
    """Stored blocks of at most 65535 bytes, the last one flagged; no data is one empty block."""
    out, at = bytearray(), 0
    while True:
        part = data[at : at + 65535]
        at += len(part)
        out += bytes([at >= len(data)]) + len(part).to_bytes(2, "little") + (len(part) ^ 0xFFFF).to_bytes(2, "little") + part
        if at >= len(data):
            return bytes(out)


def deflate(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


def encode(codec: str, data: bytes) -> bytes:
    if codec == "deflate-raw:stored":
        return stored_deflate(data)
    family, _, level = codec.removeprefix("deflate-raw:").partition(":")
    if family != "zlib" or level not in ("1", "3", "6", "9"):
        raise ValueError(f"no encoder for codec {codec!r}")
    return deflate(data, int(level))


def hint(flags: int) -> int:
    return (6, 9, 3, 1)[(flags >> 1) & 3]


def trial_levels(flags: int) -> list[int]:
    return list(dict.fromkeys((hint(flags), 6, 9, 1)))


def match(data: bytes, target: bytes, flags: int = 0) -> str | None:
    """The first codec whose output for data equals target."""
    for level in trial_levels(flags):
        if deflate(data, level) == target:
            return f"deflate-raw:zlib:{level}"
    return "deflate-raw:stored" if stored_deflate(data) == target else None
