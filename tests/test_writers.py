"""Restoring: writers and patchers of containers, attributes, the content folder, jobs."""

import hashlib
import io
import json
import os
import stat
import struct
import zipfile
import zlib

import pytest

from moraine import cli
from moraine.operators import classify
from moraine.plans import api, archives, job
from moraine.sources import cas, containers as C, zip_layout as Z, zip_writers as W
from moraine.sources.pack_format import PackError

PREFIX = b"#!/bin/sh\nexit 0\n"


def container(items, prefix=b"", stream=False, absolute=False, comment=b"note"):
    """items: (name, data, level or None for stored)."""
    out = io.BytesIO()

    class Stream:
        """A target that can't seek, so that slots get descriptors."""

        def write(self, data):
            return out.write(data)

        def flush(self):
            pass

    with zipfile.ZipFile(Stream() if stream else out, "w") as z:
        z.comment = comment
        for name, data, level in items:
            info = zipfile.ZipInfo(name, (2020, 1, 2, 3, 4, 6))
            info.external_attr = 0o100640 << 16
            z.writestr(info, data, zipfile.ZIP_STORED if level is None else zipfile.ZIP_DEFLATED, level)
    made = prefix + out.getvalue()
    return W.shifted(made, len(prefix)) if absolute else made


def parts(data, name="a.jar"):
    held, rows = {}, []
    for r in C.rows_of(data, f"/x/{name}", name, 0):
        r = {"nested_ord": None, "slot_ord": None, **r}
        if r["kind"] == "payload":
            h = hashlib.sha256(r["bytes"]).hexdigest()
            held[h] = r["bytes"]
            r |= {"h": h, "sha256": h, "size": len(r["bytes"])}
        rows.append(r)
    return C.document_of(rows), held


ITEMS = [("d/", b"", None), ("a.txt", b"alpha " * 300, 6), ("b.bin", bytes(range(256)) * 9, None), ("c.txt", b"gamma " * 999, 9), ("é.txt", b"x", 6)]


def contents(data):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None
        return [(i.filename, z.read(i), i.date_time, i.external_attr >> 16) for i in z.infolist()], z.comment


@pytest.mark.parametrize("stream", [False, True])
@pytest.mark.parametrize("prefix,absolute", [(b"", False), (PREFIX, False), (PREFIX, True)])
@pytest.mark.parametrize("backend", [classify.EXACT, classify.REBUILD, classify.SEEK, classify.CONCAT, classify.PLAIN])
def test_every_writer_keeps_slots(backend, prefix, absolute, stream):
    data = container(ITEMS, prefix, stream, absolute)
    jar, held = parts(data)
    changed = archives.without(jar, backend)
    out = api.container_bytes(changed, held, backend, level=1)
    assert contents(out) == contents(data) and out.startswith(prefix)
    scanned = Z.scan(out)
    assert [s.payload for s in scanned.slots] == [d for _, d, _ in ITEMS] and scanned.prefix == prefix and not any(s.fault for s in scanned.slots)
    if backend == classify.EXACT:
        assert out == data
    if backend in (classify.SEEK, classify.CONCAT, classify.PLAIN) and prefix:
        # New directories behind a launcher record places in the file.
        assert min(s.local_offset for s in scanned.slots) == len(prefix)
    if backend == classify.REBUILD:
        assert min(s.local_offset for s in scanned.slots) == min(s.local_offset for s in Z.scan(data).slots)
        # Extras and comments of the directory stay.
        assert len(scanned.tail) == len(Z.scan(data).tail)


def test_seek_keeps_places_and_pads():
    plain = container(ITEMS)
    at = plain.find(Z.LOCAL, 5)
    start = plain.find(Z.CENTRAL)
    assert Z.scan(plain).slots[1].local_offset == at
    # Seven zero bytes between the first and the second slot.
    tail = bytearray(plain[start:])
    size = W.patch_directory(tail, lambda k, offset: W.Change(offset + 7 * (k > 0)))
    W.patch_end(tail, size, start + 7)
    padded = plain[:at] + bytes(7) + plain[at:start] + bytes(tail)
    jar, held = parts(padded)
    assert jar["entries"][0]["pad_zeros"] == 7 and W.exact_bytes(jar, held) == padded
    seek = W.seek_bytes(archives.without(jar, classify.SEEK), held)
    assert seek[:start] == padded[:start] and contents(seek) == contents(padded)
    assert len(W.concat_bytes(archives.without(jar, classify.SEEK), held)) == len(seek) - 7


def test_rebuilt_fields():
    e = {"is_dir": True, "method_code": 8, "uncompressed_size": 0, "compressed_size": 2, "crc32": 5}
    assert W.rebuilt_fields(e) == (8, 5, 0)
    assert W.rebuilt_fields(e | {"method_code": 0}) == W.rebuilt_fields(e | {"uncompressed_size": 4}) == (0, 0, 0)
    assert W.rebuilt_fields(e | {"is_dir": False, "method_code": 12, "uncompressed_size": 9}) == (8, 5, 9)


def local(flags, csize, usize, extra=b"", name=b"n"):
    return Z.LOCAL + struct.pack("<HHHHHIIIHH", 20, flags, 0, 1, 2, 3, csize, usize, len(name), len(extra)) + name + extra


def test_local_patch():
    assert W.patch_local(local(0, 1, 2), 8, 7, 10, 11) == Z.LOCAL + struct.pack("<HHHHHIIIHH", 20, 0, 8, 1, 2, 7, 10, 11, 1, 0) + b"n"
    # With a descriptor only the method changes.
    assert W.patch_local(local(8, 0, 0), 8, 7, 10, 11) == Z.LOCAL + struct.pack("<HHHHHIIIHH", 20, 8, 8, 1, 2, 3, 0, 0, 1, 0) + b"n"
    wide = struct.pack("<HHH", 9, 2, 1) + struct.pack("<HHQQ", 1, 16, 5, 6)
    out = W.patch_local(local(0, W.WIDE, W.WIDE, wide), 0, 7, 1 << 40, 1 << 41)
    assert out.endswith(struct.pack("<QQ", 1 << 41, 1 << 40)) and out[18:26] == b"\xff" * 8
    for bad in (local(0, 1, 2)[:-1], b"x" * 40):
        with pytest.raises(PackError):
            W.patch_local(bad, 0, 0, 0, 0)
    with pytest.raises(PackError, match="64-bit"):
        W.patch_local(local(0, 1, 2), 0, 7, 1 << 33, 5)
    with pytest.raises(PackError, match="64-bit"):
        W.patch_local(local(0, W.WIDE, 2, struct.pack("<HH", 1, 0)), 0, 7, 5, 5)


@pytest.mark.parametrize("signature,form", [(b"", "<III"), (W.DESCRIPTOR, "<III"), (b"", "<IQQ"), (W.DESCRIPTOR, "<IQQ")])
def test_descriptor_patch(signature, form):
    assert W.patch_descriptor(signature + struct.pack(form, 1, 2, 3), 9, 8, 7) == signature + struct.pack(form, 9, 8, 7)
    assert W.patch_descriptor(b"", 1, 2, 3) == b""
    with pytest.raises(PackError):
        W.patch_descriptor(b"x" * 13, 1, 2, 3)
    if form == "<III":
        with pytest.raises(PackError):
            W.patch_descriptor(signature + struct.pack(form, 1, 2, 3), 9, 1 << 33, 7)


def test_synthetic_directories_of_64_bits():
    rows = [W.Row(b"big", 0, 0, 1, 2, 3, 1 << 33, 1 << 34, 1 << 35), W.Row(b"far", 0, 8, 1, 2, 3, 5, 6, 1 << 36, 0o100755), W.Row(b"small", 0, 8, 1, 2, 3, 5, 6, 7)]
    body = W.synthetic_directory(rows, 1 << 37, b"c")
    end = Z.end_record(body)
    found = Z.read_directory(body, 0, body.find(Z.END64))
    assert [(s.raw_name, s.compressed_size, s.uncompressed_size, s.local_offset) for s in found] == [(r.name, r.compressed, r.uncompressed, r.offset) for r in rows]
    assert found[1].unix_mode == 0o100755 and Z.directory_bounds(body, end)[1:] == (1 << 37, body.find(Z.END64), 3)
    assert W.wide_extra(1, 2, 3) == b"" and W.wide_extra(1, W.WIDE, 1 << 40) == struct.pack("<HHQQ", 1, 16, W.WIDE, 1 << 40)
    moved = bytearray(body)
    size = W.patch_directory(moved, lambda k, offset: W.Change(offset + 1))
    W.patch_end(moved, size, (1 << 37) + 1)
    assert [s.local_offset for s in Z.read_directory(bytes(moved), 0, size)] == [r.offset + 1 for r in rows]
    assert Z.directory_bounds(bytes(moved), Z.end_record(bytes(moved)))[1] == (1 << 37) + 1
    many = [W.Row(b"%d" % k, 0, 0, 0, 33, 0, 0, 0, k) for k in range(70_000)]
    body = W.synthetic_directory(many, 0, b"")
    assert Z.directory_bounds(body, Z.end_record(body))[3] == 70_000
    for bad in ([W.Row(b"a/../b", 0, 0, 0, 0, 0, 0, 0, 0)], [W.Row(b"..\\x", 0, 0, 0, 0, 0, 0, 0, 0)]):
        with pytest.raises(PackError):
            W.synthetic_directory(bad, 0, b"")
    with pytest.raises(PackError):
        W.synthetic_directory([], 0, b"x" * 65536)


def test_offsets_behind_a_launcher():
    e = {"local_header_offset": 30}
    assert (W.seek_offset(e, 0, 0), W.seek_offset(e, 10, 10), W.seek_offset(e, 10, 0)) == (30, 40, 30)
    assert (W.concat_offset(5, 0), W.concat_offset(5, 10)) == (5, 15)
    assert contents(W.shifted(container(ITEMS), 0)) == contents(container(ITEMS))


def test_recorded_parts_must_fit():
    jar, held = parts(container(ITEMS, PREFIX))
    for change in ({"prefix_size": 3}, {"prefix_blob": None}, {"tail_size": 1}, {"tail_blob": "00"}):
        with pytest.raises(PackError):
            W.exact_bytes(jar | change, held)
    both = jar | {"entries": [jar["entries"][1] | {"zip_index": 0}]}
    with pytest.raises(PackError, match="both"):
        W.exact_bytes(both, held)
    raw = {"name": "r", "raw_zip_blob": "k", "raw_zip_size": 4, "entries": [], "source_size": 4, "source_sha256": hashlib.sha256(b"data").hexdigest()}
    assert api.container_bytes(raw, {"k": b"data"}, classify.EXACT) == b"data"
    with pytest.raises(PackError, match="hash"):
        api.container_bytes(raw | {"source_size": 5}, {"k": b"data"}, classify.EXACT)


def test_plain_writer_warns_and_checks():
    jar, held = parts(container([("a/../b", b"1", None), ("ok", b"22", 6)]))
    said = []
    out = W.plain_bytes(jar, held, store_all=True, warn=said.append)
    assert [n for n, *_ in contents(out)[0]] == ["ok"] and len(said) == 1 and zipfile.ZipFile(io.BytesIO(out)).infolist()[0].compress_type == 0
    with pytest.raises(PackError, match="crc32"):
        W.plain_bytes(jar | {"entries": [jar["entries"][1] | {"crc32": 1}]}, held)
    with pytest.raises(PackError, match=r"\.\."):
        W.concat_bytes(jar, held)


def test_layout_is_found_by_name_and_not_in_nested_containers():
    inner = container([("x", b"1" * 50, None), ("y", b"2", None)])
    outer = container([("in.zip", inner, None), ("z", b"3", None)])
    # A launcher that ends like a local header, and a directory that knows nothing of it.
    odd = b"#!" + Z.LOCAL + bytes(40) + outer
    found = Z.scan(odd)
    assert found.prefix == odd[: -len(outer)] and [s.name for s in found.slots] == ["in.zip", "z"]
    assert Z.find_local(odd, b"z") == odd.rfind(Z.LOCAL) and Z.find_local(odd, b"none") is None
    assert Z.prefix_length(odd) == 46 and Z.prefix_length(outer) == 0 and Z.prefix_length(b"nothing") == 0
    slots = Z.layout(outer)[2]
    assert Z.accepted(outer, slots, 0, 0) and not Z.accepted(outer, slots, outer.find(Z.LOCAL, 4), outer.find(Z.LOCAL, 4))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("writers")
    (d / "in").mkdir()
    (d / "in" / "a.jar").write_bytes(container(ITEMS, PREFIX))
    odd = zlib.compressobj(4, zlib.DEFLATED, -15, 1)  # settings that aren't tried
    data = b"".join(b"%d," % (k * k % 977) for k in range(4000))
    deflated = odd.compress(data) + odd.flush()
    body = container([("odd.txt", data, 6), ("e.txt", b"e" * 50, 6)])
    jar, held = parts(body)
    jar["entries"][0] |= {"cdata_blob": "odd", "compressed_size": len(deflated)}
    jar["entries"][0].pop("cdata_codec")
    (d / "in" / "b.jar").write_bytes(W.concat_bytes(archives.without(jar, classify.SEEK), held | {"odd": deflated}))
    os.chmod(d / "in" / "b.jar", 0o604)
    api.pack(spark, api.PackOptions([str(d / "in")], str(d / "out.pack"), recursive=True, sort_inputs=True, restore_paths=True))
    return d


def test_a_stream_that_no_codec_gives_is_rebuilt(spark, made, tmp_path):
    want = contents((made / "in" / "b.jar").read_bytes())
    assert api.restore(spark, str(made / "out.pack"), str(tmp_path)) == [("a.jar", "exact"), ("b.jar", "rebuild")]
    assert (tmp_path / "a.jar").read_bytes() == (made / "in" / "a.jar").read_bytes() and contents((tmp_path / "b.jar").read_bytes()) == want
    # A container with a launcher can be run.
    assert stat.S_IMODE(os.stat(tmp_path / "a.jar").st_mode) == 0o755
    said = []
    with pytest.raises(FileExistsError):
        api.restore(spark, str(made / "out.pack"), str(tmp_path), only=["b.jar"])
    assert api.restore(spark, str(made / "out.pack"), str(tmp_path), only=["b.jar", "none"], clean=True, warn=said.append) == [("b.jar", "rebuild")]
    assert said == ["the pack has no container none"]


def test_paths_and_attributes_come_back(spark, made, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.jar").write_bytes((made / "in" / "b.jar").read_bytes())
    os.chmod(tmp_path / "in" / "b.jar", 0o640)
    api.pack(spark, api.PackOptions([str(tmp_path / "in" / "b.jar")], str(tmp_path / "p"), restore_paths=True))
    os.remove(tmp_path / "in" / "b.jar")
    os.rmdir(tmp_path / "in")
    old = os.umask(0o077)
    try:
        api.restore(spark, str(tmp_path / "p"), restore_paths=True)
    finally:
        os.umask(old)
    assert stat.S_IMODE(os.stat(tmp_path / "in").st_mode) == 0o755 and stat.S_IMODE(os.stat(tmp_path / "in" / "b.jar").st_mode) == 0o640
    api.pack(spark, api.PackOptions([str(tmp_path / "in" / "b.jar")], str(tmp_path / "q")))
    with pytest.raises(ValueError, match="where it came from"):
        api.restore(spark, str(tmp_path / "q"), restore_paths=True)


def test_wrong_crc_warns_or_is_an_error(spark, tmp_path):
    data = bytearray(container([("a", b"12345", None)]))
    data[data.find(b"12345")] ^= 1
    (tmp_path / "a.jar").write_bytes(bytes(data))
    summary = api.pack(spark, api.PackOptions([str(tmp_path / "a.jar")], str(tmp_path / "p")))
    assert len(summary.warnings) == 1 and "crc32" in summary.warnings[0]
    api.restore(spark, str(tmp_path / "p"), str(tmp_path / "back"))
    assert (tmp_path / "back" / "a.jar").read_bytes() == bytes(data)
    with pytest.raises(PackError, match="crc32"):
        api.pack(spark, api.PackOptions([str(tmp_path / "a.jar")], str(tmp_path / "q"), strict=True))


def test_a_payload_counts_once_in_an_expanded_container(spark, tmp_path):
    inner = container([("x", b"same", None), ("y", b"same", None)], comment=b"")
    (tmp_path / "a.jar").write_bytes(container([("in.jar", inner, None), ("z", b"same", None)]))
    api.pack(spark, api.PackOptions([str(tmp_path / "a.jar")], str(tmp_path / "p"), version=1))
    t = api.catalog(spark, str(tmp_path / "p"))
    assert t["blob"].where("size = 4").first()["ref_count"] == 2 and api.verify(spark, str(tmp_path / "p")).where("check != 'reference_count'").count() == 0
    assert api.restore(spark, str(tmp_path / "p"), str(tmp_path / "back")) == [("a.jar", "exact")]


def test_content_folder(spark, made, tmp_path):
    n = api.spill(spark, str(made / "out.pack"), str(tmp_path))
    assert n == api.catalog(spark, str(made / "out.pack"))["blob"].count() and api.spill(spark, str(made / "out.pack"), str(tmp_path)) == 0
    keys = api.catalog(spark, str(made / "out.pack"))["blob"].select("h").union(spark.createDataFrame([("0" * 64,)], "h string"))
    assert [r["n"] for r in cas.exists(keys, str(tmp_path)).groupBy("exists").count().withColumnRenamed("count", "n").orderBy("exists").collect()] == [1, n]
    assert cas.get(keys, str(tmp_path)).count() == n and cas.get(keys, str(tmp_path / "none")).count() == 0
    first = cas.get(keys, str(tmp_path)).first()
    assert os.path.getsize(cas.place(str(tmp_path), first["h"])) == first["size"] == len(first["bytes"])


def test_job_files_and_lists(spark, made, tmp_path, capsys):
    text = {"version": 1, "dehydrate": {"inputs": [str(made / "in")], "output": str(tmp_path / "p"), "recursive": True, "jobs": 0}, "rehydrate": {"input": str(tmp_path / "p"), "dir": str(tmp_path / "back"), "deflate_level": 3}}
    (tmp_path / "job.json").write_text(json.dumps(text))
    assert cli.main(["job", str(tmp_path / "job.json"), "--json-logs"], spark) == 0
    said = capsys.readouterr()
    assert sorted(os.listdir(tmp_path / "back")) == ["a.jar", "b.jar"] and {json.loads(x)["event"] for x in said.err.splitlines() if x.startswith("{")} == {"progress", "done"}
    assert cli.main(["list", str(tmp_path / "p")], spark) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[0].split() == ["name", "entries", "bytes", "signed", "backend", "misses"] and lines[-1].startswith("2 containers  7")
    assert cli.main(["spill", str(tmp_path / "p"), str(tmp_path / "cas")], spark) == 0
    with pytest.raises(ValueError):
        job.options({"version": 2})
    with pytest.raises(ValueError, match="unknown"):
        job.options({"version": 1, "pack": {"inputs": [], "output": "x", "what": 1}})
