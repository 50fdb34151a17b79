import io
import json
import struct
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from moraine import cli
from moraine.plans import api
from moraine.sources import containers, pack_format as P, zip_layout as Z

WHOLE = ("read_last", "read_catalog", "last_records", "read_all")


def container(items, method=zipfile.ZIP_DEFLATED, prefix=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in items:
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 2, 3, 4, 6)), data, zipfile.ZIP_STORED if name.endswith("/") else method)
    return prefix + out.getvalue()


@pytest.fixture(scope="module")
def packed(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("packs")
    hello = ("hello.txt", b"HELLO" * 50)
    (d / "a.jar").write_bytes(container([("META-INF/", b""), ("a.txt", b"AAA"), hello, ("META-INF/X.RSA", b"s")]))
    inner = container([("x.txt", b"x" * 70), hello], zipfile.ZIP_STORED)
    (d / "b.jar").write_bytes(container([("b.txt", b"BBB"), hello, ("in.jar", inner)], zipfile.ZIP_STORED))
    (d / "c.war").write_bytes(container([("c.txt", b"c" * 900)], prefix=b"#!/bin/sh\n"))
    summary = api.pack(spark, api.PackOptions([str(d)], str(d / "out.pack"), recursive=True, sort_inputs=True))
    return d, summary


def test_round_trip(spark, packed):
    d, summary = packed
    assert summary.stats["jar_count"] == 3 and summary.stats["file_entry_count"] == 7
    assert summary.warnings == ["signed container a.jar"]
    assert api.verify(spark, str(d / "out.pack")).count() == 0
    assert api.restore(spark, str(d / "out.pack"), str(d / "back")) == [(n, "exact") for n in ("a.jar", "b.jar", "c.war")]
    for n in ("a.jar", "b.jar", "c.war"):
        assert (d / "back" / n).read_bytes() == (d / n).read_bytes()


def test_shared_payloads_are_kept_once(spark, packed):
    d, _ = packed
    t = api.catalog(spark, str(d / "out.pack"))
    used = t["slot"].where("blob is not null").select("blob").distinct().count()
    assert used == 6  # a, hello, signature, b, x, c
    assert t["blob"].where("size = 250").first()["ref_count"] == 3


def test_catalog_is_the_same_twice(spark, packed):
    d, _ = packed
    api.pack(spark, api.PackOptions([str(d / n) for n in ("c.war", "b.jar", "a.jar")], str(d / "again.pack"), sort_inputs=True))
    assert (d / "again.pack").read_bytes() == (d / "out.pack").read_bytes()


def test_only_and_guards(spark, packed, tmp_path):
    d, _ = packed
    assert api.restore(spark, str(d / "out.pack"), str(tmp_path), only=["b.jar", "none"]) == [("b.jar", "exact")]
    with pytest.raises(FileExistsError):
        api.restore(spark, str(d / "out.pack"), str(tmp_path), only=["b.jar"])


def test_damage_is_reported(spark, packed, tmp_path):
    d, _ = packed
    with open(d / "out.pack", "rb") as f:
        layout, records = P.read_all(f)
        rows = list(records)
    blobs = [(k, data) for tag, k, data in rows if tag == P.BLOB]
    catalog = next(data for tag, _, data in rows if tag == P.CATALOG)
    end = rows[-1][2]
    broken = [(k, data if n else b"?" + data[1:]) for n, (k, data) in enumerate(blobs[1:])]
    with open(tmp_path / "x.pack", "wb") as out:
        frames = [(P.compress(P.blob_record(P.MORAINE, k, data), 3), [(k, 0, len(data))]) for k, data in broken]
        P.write_pack(out, frames, lambda: catalog, end[::-1], 3)
    found = {r["check"] for r in api.verify(spark, str(tmp_path / "x.pack")).collect()}
    assert {"payload_hash", "blob_missing", "reference_missing", "crc32", "sequence", "end_digest"} <= found
    assert cli.main(["verify", str(tmp_path / "x.pack")], spark) == 3
    assert cli.main(["verify", str(d / "a.jar")], spark) == 3
    assert cli.main(["verify", str(d / "none")], spark) == 1
    assert cli.main(["nonsense"], spark) == 2


def test_version_1(spark, packed, tmp_path):
    d, _ = packed
    with open(d / "out.pack", "rb") as f:
        rows = list(P.read_all(f)[1])
    with open(tmp_path / "v1.pack", "wb") as out:
        P.write_pack_v1(out, [(k, data) for tag, k, data in rows if tag == P.BLOB], rows[-2][2], rows[-1][2], 3)
    assert api.verify(spark, str(tmp_path / "v1.pack")).count() == 0


def test_another_dialect(spark, packed, tmp_path):
    d, _ = packed
    other = P.Dialect(b"OTHR", b"OTHRTOC2", b"OTHRTLR1", "other", "other-catalog")
    api.pack(spark, api.PackOptions([str(d / "a.jar")], str(tmp_path / "o.pack"), dialect=other))
    assert api.verify(spark, str(tmp_path / "o.pack"), other).count() == 0
    with pytest.raises(P.PackError):
        api.document(str(tmp_path / "o.pack"))


@pytest.mark.parametrize("cut", [1, 30, 64, 100])
def test_cut_packs(packed, tmp_path, cut):
    d, _ = packed
    data = (d / "out.pack").read_bytes()
    (tmp_path / "c").write_bytes(data[:-cut])
    with pytest.raises(P.PackError), open(tmp_path / "c", "rb") as f:
        list(P.read_all(f)[1])


def test_records_must_be_in_order():
    one = P.blob_record(P.MORAINE, b"k" * 32, b"data")
    last = P.last_records(P.MORAINE, b"{}", b"d" * 32)
    for bad in (one, last + b"", last[:11] + one, b"\x00", one[:20]):
        if bad == last:
            continue
        with pytest.raises(P.PackError):
            list(P.records(io.BytesIO(bad), P.MORAINE))


def test_scan_faults():
    data = container([("a", b"1"), ("b", b"2" * 99)])
    with pytest.raises(Z.ContainerError):
        Z.scan(b"no container at all")
    flagged = bytearray(data)
    at = data.find(Z.CENTRAL)
    struct.pack_into("<H", flagged, at + 8, 1)
    with pytest.raises(Z.ContainerError, match="encrypted"):
        Z.scan(bytes(flagged))
    with pytest.raises(Z.ContainerError, match="cap"):
        Z.scan(data, max_entry=50)
    rows = list(containers.rows_of(b"junk", "p", "n", 0))
    assert [r["kind"] for r in rows] == ["fault"]


def test_empty_and_prefixed_containers():
    assert Z.scan(container([])).slots == []
    c = Z.scan(container([("a", b"1")], prefix=b"#!/bin/sh\n"))
    assert c.prefix == b"#!/bin/sh\n" and [s.name for s in c.slots] == ["a"]
    assert Z.joined(c) == container([("a", b"1")], prefix=b"#!/bin/sh\n")


@settings(max_examples=32, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.tuples(st.text("abc/é漢", min_size=1, max_size=6), st.binary(max_size=64), st.booleans()), min_size=1, max_size=4, unique_by=lambda x: x[0]))
def test_slices_give_the_bytes_back(items):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data, deflated in items:
            z.writestr(zipfile.ZipInfo(name), b"" if name.endswith("/") else data, zipfile.ZIP_DEFLATED if deflated and not name.endswith("/") else zipfile.ZIP_STORED)
    c = Z.scan(out.getvalue())
    assert Z.joined(c) == out.getvalue()
    assert [s.name for s in c.slots] == [n for n, _, _ in items]


@pytest.fixture
def never_whole(monkeypatch):
    """What holds a catalog or a pack whole fails in this process."""

    def fail(*_, **__):
        raise AssertionError("the catalog is held whole")

    for name in WHOLE:
        monkeypatch.setattr(P, name, fail)
    monkeypatch.setattr(api, "document", fail)


def test_catalog_of_version_1_passes_through_the_driver_in_pieces(spark, packed, tmp_path, never_whole):  # F1
    d, _ = packed
    inputs = [str(d / n) for n in ("a.jar", "b.jar", "c.war")]
    api.pack(spark, api.PackOptions(inputs, str(tmp_path / "v1.pack"), version=1, key="sha256", sidecar=str(tmp_path / "side.json")))
    side = json.loads((tmp_path / "side.json").read_bytes())
    with open(tmp_path / "v1.pack", "rb") as f:
        *pieces, end = P.read_pieces(f, size=100)
    assert max(map(len, pieces)) <= 100 and json.loads(b"".join(pieces)) == side and len(end) == 32
    t = api.catalog(spark, str(tmp_path / "v1.pack"))
    assert [r["container"] for r in t["container"].orderBy("container_ord").collect()] == [j["name"] for j in side["jars"]] == ["a.jar", "b.jar", "c.war"]
    assert [(r["h"], r["size"], r["ref_count"]) for r in t["blob"].orderBy("first_seen_ord").collect()] == [(b["blake3"], b["size"], b["ref_count"]) for b in side["blobs"]]
    slots = [e | {"container": j["name"], "nested_ord": n} for j in side["jars"] for n, at in ((None, j), *enumerate(j.get("nestedindexes", []))) for e in at["entries"]]
    assert sorted((r["container"], r["nested_ord"] is None, r["name"], str(r["blob"]), r["uncompressed_size"]) for r in t["slot"].collect()) == sorted((s["container"], s["nested_ord"] is None, s["name"], str(s["blob"]), s["uncompressed_size"]) for s in slots)
    assert api.verify(spark, str(tmp_path / "v1.pack")).count() == 0


def test_listing_reads_no_whole_catalog(spark, packed, never_whole):  # F2
    d, _ = packed
    found = {r["container"]: (r["entries"], r["signed"], r["backend"]) for r in api.listing(spark, str(d / "out.pack")).collect()}
    assert found == {"a.jar": (4, True, "exact"), "b.jar": (3, False, "exact"), "c.war": (1, False, "exact")}


def test_restore_reads_no_whole_catalog(spark, packed, tmp_path, never_whole):  # F3
    d, _ = packed
    assert api.restore(spark, str(d / "out.pack"), str(tmp_path)) == [(n, "exact") for n in ("a.jar", "b.jar", "c.war")]
    for n in ("a.jar", "b.jar", "c.war"):
        assert (tmp_path / n).read_bytes() == (d / n).read_bytes()


def test_files_are_read_by_a_few_tasks(spark, tmp_path):  # F3
    names = [f"[{k}] 50%*.zip" for k in range(40)]
    for n in names:
        (tmp_path / n).write_bytes(container([(n, n.encode())]))
    files = containers.read_files(spark, [str(tmp_path / n) for n in names], names)
    assert files.rdd.getNumPartitions() == 1
    assert [(r["path"], bytes(r["content"]), r["container"]) for r in files.orderBy("container_ord").collect()] == [(f"file:{tmp_path / n}", (tmp_path / n).read_bytes(), n) for n in names]


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x)), st.lists(st.integers()), st.integers(1, 9), st.sampled_from([None, 1]))
def test_values_of_json_in_pieces(value, numbers, step, indent):
    whole = {"a": value, "jars": [{"x": value}, 12, "é\\\"]"], "n": numbers, "blobs": []}
    text = json.dumps(whole, indent=indent, ensure_ascii=bool(indent))
    out = {}
    for key, place, found in P.values(text[k : k + step] for k in range(0, len(text), step)):
        if place is None:
            out[key] = json.loads(found)
        else:
            out.setdefault(key, []).append(json.loads(found))
            assert len(out[key]) == place + 1
    assert out == whole
    for bad in (text[:-1], text + "x", text.replace('"n"', '"a"'), text.replace(":", ",", 1)):
        with pytest.raises(P.PackError):
            list(P.values(bad[k : k + step] for k in range(0, len(bad), step)))
