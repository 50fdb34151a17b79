import zlib

import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from moraine.functions import codecs, scalar
from moraine.functions.blake3 import digest, digests, hex_digests
from moraine.operators import folds, inputs, verify

# Published vectors: byte k of the input is k mod 251.
VECTORS = {
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
    1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
    1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
    3072: "b98cb0ff3623be03326b373de6b9095218513e64f1ee2edd2525c7ad1e5cffd2",
}


@pytest.mark.parametrize("n", VECTORS)
def test_blake3_vectors(n):
    assert digest(bytes(k % 251 for k in range(n))).hex() == VECTORS[n]


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=200_000))
def test_stored_deflate_is_deflate(data):
    assert zlib.decompress(codecs.stored_deflate(data), -15) == data


def test_codec_match_and_cap():
    data = b"some text " * 500
    for level in (1, 6, 9):
        assert codecs.encode(codecs.match(data, codecs.deflate(data, level)), data) == codecs.deflate(data, level)
    assert codecs.match(data, codecs.stored_deflate(data)) == "deflate-raw:stored"
    assert codecs.match(data, b"nothing") is None
    with pytest.raises(ValueError):
        codecs.inflate(codecs.deflate(data, 6), 10)


def test_unique_names():
    assert inputs.unique_names(["a.jar", "x/a__2.jar", "y/a.jar"]) == ["a.jar", "a__2.jar", "a__3.jar"]
    assert inputs.unique_names(["a.jar", "b/a.jar", "c/a__2.jar"]) == ["a.jar", "a__2.jar", "a__2__2.jar"]
    with pytest.raises(ValueError):
        inputs.unique_names(["a/.."])


@pytest.mark.parametrize(
    ("glob", "path", "fits"),
    [("*.jar", "a.jar", True), ("*.jar", "x/a.jar", True), ("x/*.jar", "x/y/a.jar", False), ("**/a.jar", "x/y/a.jar", False), ("[!a]?.zip", "bc.zip", True), ("[!a]?.zip", "ac.zip", False), ("A.jar", "a.jar", False)],
)
def test_globs(glob, path, fits):
    assert inputs.excluded_path(path, [glob]) is fits


def test_expand(tmp_path):
    for name in ("b.jar", "a.ZIP", "x.txt", "sub/c.war"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"")
    found = inputs.expand([str(tmp_path), str(tmp_path / "x.txt")], recursive=True, exclude=["c.*"], sort=True)
    assert [p.rsplit("/", 1)[1] for p in found] == ["a.ZIP", "b.jar", "x.txt"]
    said = []
    assert inputs.expand(["q.jar", "q.jar"], warn=said.append) == ["q.jar"] and said


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_scalars(spark):
    ratio = spark.createDataFrame([(0, 0), (10, 0), (25, 100), (100, 100), (0, 50)], "u long, t long")
    assert [r[0] for r in ratio.select(scalar.dedup_ratio("u", "t")).collect()] == [0.0, 0.0, 0.75, 0.0, 1.0]
    r = one(
        spark, a=scalar.parse_hash_id(F.lit("AB" * 32)), b=scalar.parse_hash_id(F.lit("ab")), c=scalar.parse_hex(F.lit("abc")), d=scalar.formatted_bytes(F.lit(2048)),
        e=scalar.trial_levels(F.lit(2)), f=scalar.slot_start(F.lit(None).cast("long"), F.lit(5).cast("long"), F.lit(7).cast("long")), g=scalar.dos_timestamp(F.lit(0), F.lit(0)).cast("string"),
        h=scalar.dos_timestamp(F.lit((40 << 9) | (2 << 5) | 29), F.lit((3 << 11) | (4 << 5) | 3)).cast("string"), i=scalar.is_archive(F.lit("x/a.JAR")), j=scalar.is_archive(F.lit("x.jar/a")),
        k=scalar.wrong_file(F.unhex(F.lit("504b0304")), F.unhex(F.lit("00"))), m=scalar.offset_mode(F.lit(7), F.lit(0), F.lit(7)), n=scalar.unsafe_container_name(F.lit("..")), o=scalar.directory_name(F.lit(None), F.lit("é")),
    )
    assert (len(r.a), r.b, r.c, r.d, r.e, r.f) == (32, None, None, "2.0 KiB", [9, 6, 1], 12)
    assert (r.g, r.h, r.i, r.j, r.k, r.m, r.n, bytes(r.o)) == ("1980-01-01 00:00:00", "2020-02-29 03:04:06", True, False, "container", "absolute", True, "é".encode())


def test_frames(spark):
    rows = spark.createDataFrame([(p, k, n) for p in ("x", "y") for k, n in enumerate([60, 40, 1, 500, 3])], "pack string, k int, n long")
    got = [(r.frame_id, r.rec_off) for r in folds.frames(rows, ["k"], "n", 100, ["pack"]).where("pack = 'y'").orderBy("k").collect()]
    assert got == [(0, 0), (0, 60), (1, 0), (2, 0), (3, 0)]


def test_identity_and_sequence(spark):
    a = spark.createDataFrame([("a", 1), ("b", 2), ("n", None)], "k string, v int")
    b = spark.createDataFrame([("a", 1), ("b", 3), ("c", 4), ("n", None)], "k string, v int")
    assert {(r.k, r.status) for r in verify.identity(a, b, "k", "v").collect()} == {("b", "changed"), ("c", "only_right")}
    s = spark.createDataFrame([(0, "x"), (1, "y")], "ord long, h string")
    assert verify.sequence_differences(s, s).count() == 0


def test_streaming_keeps_each_key_once(spark, tmp_path):
    from moraine.streaming import ingest

    folder = str(tmp_path / "in")
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "h string, size long").write.parquet(folder)
    stream = spark.readStream.schema("h string, size long").parquet(folder)
    for _ in range(2):
        ingest.append_to(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.h for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_blake3_of_many_values():
    sizes = [0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 3000, 5 * 1024 + 1, 8192, 9000]
    values = [bytes((k * n) % 251 for k in range(n)) for n in sizes]
    assert digests(values) == [digest(v) for v in values] and digests([]) == []
    assert list(hex_digests(pd.Series([None, *values, None]), limit=4000)) == [None, *(digest(v).hex() for v in values), None]
