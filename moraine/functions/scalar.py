"""Scalar functions of the catalog, as Spark columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

#: Fixed values of the formats.
METHODS = {0: "stored", 8: "deflated"}
CODEC = "^deflate-raw:(flate2:[1369]|zlib:[1369]|stored)$"
ARCHIVE_EXTENSIONS = ("jar", "zip", "war", "ear")
BLOB_RECORD_OVERHEAD, TOC_OVERHEAD, TOC_ENTRY, TRAILER = 41, 28, 56, 64


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def content_key(payload: Column | str) -> Column:
    """The default content key: SHA-256 in lower-case hex."""
    return F.sha2(_c(payload).cast("binary"), 256)


def hex_lower(data: Column | str) -> Column:
    return F.lower(F.hex(_c(data)))


def parse_hex(text: Column | str) -> Column:
    """Bytes of a hex text of even length, in either case; null for anything else."""
    t = _c(text)
    return F.when(t.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(t))


def parse_hash_id(text: Column | str) -> Column:
    t = _c(text)
    return F.when(t.rlike("^[0-9A-Fa-f]{64}$"), F.unhex(t))


def short_id(text: Column | str) -> Column:
    return F.substring(_c(text), 1, 12)


def method_label(code: Column | str) -> Column:
    c = _c(code)
    out = reduce(lambda when, kv: when.when(c == kv[0], kv[1]), list(METHODS.items())[1:], F.when(c == 0, METHODS[0]))
    return out.otherwise("other")


def signature_marker(name: Column | str) -> Column:
    """Whether a slot's name is that of a signature file, directly in META-INF."""
    return F.lower(F.replace(_c(name), F.lit("\\"), F.lit("/"))).rlike(r"^meta-inf/[^/]*\.(sf|rsa|dsa|ec)$")


def formatted_bytes(n: Column | str) -> Column:
    x = _c(n)
    scaled = lambda unit, name: F.format_string(f"%.1f {name}", F.bround(x / unit, 1))
    return F.when(x >= 1 << 20, scaled(float(1 << 20), "MiB")).when(x >= 1 << 10, scaled(1024.0, "KiB")).otherwise(F.concat(x.cast("string"), F.lit(" B")))


def bytes_text(n: int) -> str:
    """The same of one number."""
    for unit, name in ((1 << 20, "MiB"), (1 << 10, "KiB")):
        if n >= unit:
            return f"{n / unit:.1f} {name}"
    return f"{n} B"


def dedup_ratio(unique_bytes: Column | str, total_bytes: Column | str) -> Column:
    """1 - unique / total; 0 without bytes. Negative where structural payloads outweigh what is shared."""
    u, t = _c(unique_bytes), _c(total_bytes)
    return F.when(t == 0, F.lit(0.0)).otherwise(1.0 - u.cast("double") / t.cast("double"))


def archive_ratio(archive_bytes: Column | str, container_bytes: Column | str) -> Column:
    a, c = _c(archive_bytes), _c(container_bytes)
    return F.when(c == 0, F.lit(0.0)).otherwise(a.cast("double") / c.cast("double"))


def blob_record_length(n: Column | str) -> Column:
    return _c(n) + F.lit(BLOB_RECORD_OVERHEAD)


def toc_length(entries: Column | str) -> Column:
    return _c(entries) * TOC_ENTRY + F.lit(TOC_OVERHEAD)


def deflate_hint(flags: Column | str) -> Column:
    """The level that bits 1 and 2 of a slot's flags hint at."""
    bits = F.shiftright(_c(flags), 1).bitwiseAND(3)
    return F.when(bits == 0, 6).when(bits == 1, 9).when(bits == 2, 3).otherwise(1)


def trial_levels(flags: Column | str) -> Column:
    return F.array_distinct(F.array(deflate_hint(flags), F.lit(6), F.lit(9), F.lit(1)))


def valid_codec(text: Column | str) -> Column:
    return _c(text).rlike(CODEC)


def slot_start(recorded: Column | str, prefix: Column | str, offset: Column | str) -> Column:
    """Where a slot begins in its file; an overflow is an error under ANSI mode."""
    return F.coalesce(_c(recorded), F.coalesce(_c(prefix), F.lit(0).cast("long")) + _c(offset))


def pad_length(zeros: Column | str, blob_size: Column | str) -> Column:
    z, b = _c(zeros), _c(blob_size)
    both = F.raise_error(F.lit("a slot has both a run of zeros and a pad payload"))
    return F.when(z.isNotNull() & b.isNotNull(), both.cast("long")).otherwise(F.coalesce(z, b, F.lit(0).cast("long")))


def slot_end(start: Column | str, header: Column | str, data: Column | str, descriptor: Column | str, pad: Column | str) -> Column:
    return _c(start) + _c(header) + _c(data) + _c(descriptor) + _c(pad)


def relative_offset(offset: Column | str, prefix: Column | str, shift: Column | str) -> Column:
    """A directory's offset relative to the container: less the prefix only where the view isn't shifted."""
    o, p = _c(offset), _c(prefix)
    return F.when((_c(shift) == 0) & (p > 0), o - p).otherwise(o)


def offset_mode(first: Column | str, relative: Column | str, absolute: Column | str) -> Column:
    """relative, absolute or an error, by which candidate the directory's first offset equals."""
    f = _c(first)
    neither = F.raise_error(F.lit("the directory's first offset fits neither mode"))
    return F.when(f == _c(relative), "relative").when(f == _c(absolute), "absolute").otherwise(neither.cast("string"))


def encoded_offset(mode: Column | str, offset: Column | str, prefix: Column | str) -> Column:
    return F.when(_c(mode) == "absolute", _c(offset) + _c(prefix)).otherwise(_c(offset))


def rebuilt_method(is_dir: Column | str, method: Column | str, size: Column | str) -> Column:
    """The method a slot is rewritten with: empty directories stored, unknown methods deflated."""
    m = _c(method)
    return F.when(_c(is_dir) & (_c(size) == 0), F.lit(0)).when(m.isin(0, 8), m).otherwise(F.lit(8))


def unsafe_container_name(name: Column | str) -> Column:
    n = _c(name)
    return (n == "") | n.isin(".", "..") | n.contains("/") | n.contains("\\") | n.contains("\x00")


def unsafe_slot_name(name: Column | str) -> Column:
    """Whether a component of the path is .. , with either separator."""
    return F.exists(F.split(_c(name), r"[/\\]"), lambda part: part == "..")


def directory_name(raw_hex: Column | str, name: Column | str) -> Column:
    """The bytes of a slot's name: the recorded raw ones, or its UTF-8."""
    return F.coalesce(parse_hex(raw_hex), F.encode(_c(name), "UTF-8"))


def dos_timestamp(date: Column | str, time: Column | str) -> Column:
    """A timestamp from a date and time pair; 1980-01-01 where the pair isn't valid."""
    d, t = _c(date), _c(time)
    part = lambda x, shift, mask: F.shiftright(x, shift).bitwiseAND(mask)
    made = F.try_make_timestamp_ntz(part(d, 9, 127) + 1980, part(d, 5, 15), part(d, 0, 31), part(t, 11, 31), part(t, 5, 63), (part(t, 0, 31) * 2).cast("decimal(16,6)"))
    return F.coalesce(made, F.lit("1980-01-01 00:00:00").cast("timestamp_ntz"))


def is_archive(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"[^/]\.([^./]+)$", 1)).isin(*ARCHIVE_EXTENSIONS)


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def glob_regex(glob: str) -> str:
    """A regular expression for a glob: * and ? stay within a path component, ** is *, [..] and [!..] are sets."""
    glob, out, k = glob.replace("**", "*"), "", 0
    while k < len(glob):
        c = glob[k]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = glob.find("]", k + 2 + (glob[k + 1 : k + 2] == "!"))
            if end < 0:
                raise ValueError(f"invalid glob {glob!r}: a set is not closed")
            inner = glob[k + 1 : end]
            negated, inner = inner.startswith("!"), inner.removeprefix("!")
            out += "(?!/)[" + ("^" if negated else "") + re.sub(r"([\\\[\]^])", r"\\\1", inner) + "]"
            k = end
        else:
            out += re.sub(r"([^0-9A-Za-z_/])", r"\\\1", c)
        k += 1
    return f"^{out}$"


def excluded(path: Column | str, globs: list[str]) -> Column:
    """Whether any glob fits the path or its last component."""
    patterns = [glob_regex(g) for g in globs]
    return reduce(lambda a, b: a | b, [x.rlike(p) for p in patterns for x in (_c(path), basename(path))], F.lit(False))


def wrong_file(head: Column | str, tail: Column | str, magic: bytes = b"MRNP", trailer_magic: bytes = b"MRNPTLR1") -> Column:
    """What a file without a pack's trailer seems to be, from its first 8 and last 64 bytes; null for a pack."""
    h, t = F.upper(F.hex(_c(head))), F.upper(F.hex(_c(tail)))
    zip_ = h.rlike("^504B(0304|0506|0708)") | t.rlike("^(..)*504B0506")
    return (
        F.when(t.startswith(trailer_magic.hex().upper()), F.lit(None).cast("string"))
        .when(h.startswith("2321"), "script")
        .when(zip_, "container")
        .when(h.startswith(magic.hex().upper()), "truncated")
        .otherwise("unknown")
    )
