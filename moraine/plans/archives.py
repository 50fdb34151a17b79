"""Queries over containers and packs: the driver's documents are written into containers, scanned, packed and restored again.

A container holds the documents of a run of PER_CONTAINER ids, so its size doesn't grow with the table, and containers are made, scanned and
written anew by executors, each by itself. Names, sizes and hashes of what comes back are those of the source rows.
"""

from __future__ import annotations

import hashlib
import io
import os
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from moraine.operators import classify, dedup, folds
from moraine.sources import cas, containers as C, pack_format as P, zip_writers as Z

from . import adapters as A, api
from .storage import shared_folder, written

PER_CONTAINER = 50
PREFIX = b"#!/bin/sh\nexec true\n"


def container_files(docs: DataFrame, stored: bool = False, nested: int = 0) -> DataFrame:
    """FILES from documents: slots in the order of ids, a directory first, a launcher before each fifth container.

    stored: no slot is deflated; else each third is. nested: so many containers are stored in one outer container.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("number", F.floor(F.col("doc_id") / PER_CONTAINER).cast("int"))
    group = F.floor(F.col("number") / max(1, nested)).cast("int")

    def archive(slots: list[tuple[str, bytes, bool]], prefix: bytes = b"") -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data, plain in slots:
                z.writestr(zipfile.ZipInfo(name, (2021, 3, 4, 5, 6, 8)), data, zipfile.ZIP_STORED if plain else zipfile.ZIP_DEFLATED, 6)
        return prefix + out.getvalue()

    def run(key: tuple, table: pa.Table) -> pa.Table:
        made: dict[int, list[tuple[str, bytes, bool]]] = {}
        for r in table.sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("text", "ascending")]).to_pylist():
            own = made.setdefault(r["number"], [("docs/", b"", True)])
            own.append((f"docs/{r['lang'] or 'none'}/{r['doc_id']}.txt", r["text"].encode(), bool(stored or nested or r["doc_id"] % 3)))
        k = key[0].as_py()
        if nested:
            content = archive([(f"in{n}.zip", archive(made[n]), True) for n in sorted(made)])
        else:
            content = archive(made[k], PREFIX if k % 5 == 0 else b"")
        return pa.table({"path": [f"c{k}.zip"], "content": pa.array([content], pa.binary()), "container": [f"c{k}.zip"], "container_ord": pa.array([k], pa.int32())})

    return rows.withColumn("group", group).groupBy("group").applyInArrow(run, C.FILES)


def slot_rows(files: DataFrame) -> DataFrame:
    """Slots of files with size and sha256 of their payloads."""
    rows = written(C.scan_files(files).drop("place").withColumn("sha256", F.sha2("bytes", 256)).drop("bytes"), "scan")
    slots = rows.where("kind = 'slot'").drop("sha256", "role", "bytes")
    payloads = rows.where("kind = 'payload' and role = 'blob'").select("container_ord", F.coalesce("nested_ord", F.lit(-1)).alias("_n"), "slot_ord", "sha256")
    return slots.withColumn("_n", F.coalesce("nested_ord", F.lit(-1))).join(payloads, ["container_ord", "_n", "slot_ord"], "left").drop("_n")


def without(jar: dict, backend: str) -> dict:
    """A container's document as a writer that records less would leave it, so that `backend` restores it."""
    entries = [dict(e) for e in jar["entries"]]
    out = {**jar, "entries": entries}
    for e in entries:
        if backend in (classify.REBUILD, classify.CONCAT, classify.PLAIN):
            e.pop("cdata_codec", None)
        if backend == classify.PLAIN:
            e.pop("local_header_hex", None)
    if backend in (classify.SEEK, classify.CONCAT, classify.PLAIN):
        out = {k: v for k, v in out.items() if not k.startswith("tail_")}
    return out


def rewritten(files: DataFrame, backend: str, level: int = 9) -> DataFrame:
    """FILES, each scanned into a document and payloads and put together again by a writer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                held, rows = {}, []
                for r in C.rows_of(f["content"], f["path"], f["container"], f["container_ord"]):
                    r = {"nested_ord": None, "slot_ord": None, **r}
                    if r["kind"] == "payload":
                        h = hashlib.sha256(r["bytes"]).hexdigest()
                        held[h] = r["bytes"]
                        r |= {"h": h, "sha256": h, "size": len(r["bytes"])}
                    rows.append(r)
                jar = without(C.document_of(rows), backend)
                content = api.container_bytes(jar, held, backend, level)
                yield pa.RecordBatch.from_pydict({"path": [f["path"]], "content": pa.array([content], pa.binary()), "container": [f["container"]], "container_ord": pa.array([f["container_ord"]], pa.int32())})

    return files.mapInArrow(run, C.FILES)


def written_files(files: DataFrame, folder: str) -> list[str]:
    """FILES written by executors into a shared folder; their paths, in order."""
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("container").to_pylist(), batch.column("content")):
                partial = os.path.join(folder, f".{name}.{os.getpid()}")
                with open(partial, "wb") as out:
                    out.write(content.as_buffer())
                os.replace(partial, os.path.join(folder, name))
            yield batch.select(["container", "container_ord"])

    rows = files.mapInArrow(run, "container string, container_ord int").collect()  # sorted here: a sort in Spark would have the files written twice
    return [os.path.join(folder, r["container"]) for r in sorted(rows, key=lambda r: r["container_ord"])]


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that the driver and all executors see as files."""
    folder = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if "://" in folder and not folder.startswith("file:"):
        raise ValueError("packs are files: spark.checkpoint.dir must be a folder of a file system that is mounted everywhere")
    return folder.removeprefix("file://").removeprefix("file:")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents")


def packed(spark: SparkSession, d: str, **options) -> str:
    """The path of a pack of the documents' containers."""
    folder = scratch(spark, "pack")
    paths = written_files(container_files(documents(spark, d)), os.path.join(folder, "in"))
    api.pack(spark, api.PackOptions(paths, os.path.join(folder, "out.pack"), key="sha256", sort_inputs=True, **options))
    return os.path.join(folder, "out.pack")


# Queries.

#: The slots that the containers should have, in SQL.
SLOTS = f"""d AS (SELECT doc_id, lang, coalesce(text, '') AS text, (doc_id // {PER_CONTAINER})::INT AS number FROM documents),
s AS (SELECT number, 'c' || number || '.zip' AS container, row_number() OVER (PARTITION BY number ORDER BY doc_id, lang, text)::INT AS slot_ord,
  'docs/' || coalesce(lang, 'none') || '/' || doc_id || '.txt' AS name, false AS is_dir, CASE WHEN doc_id % 3 = 0 THEN 8 ELSE 0 END AS method_code, strlen(text) AS size, sha256(text) AS sha256, text FROM d
  UNION ALL SELECT DISTINCT number, 'c' || number || '.zip', 0, 'docs/', true, 0, 0, NULL, NULL FROM d)"""
RESTORED = f"WITH {SLOTS} SELECT container, slot_ord, name, is_dir, method_code, size, sha256, '{{0}}' AS backend FROM s"
QUERIES, ORACLES = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def _size(rows: DataFrame) -> DataFrame:
    return rows.select("container", "slot_ord", "name", "is_dir", "method_code", F.col("uncompressed_size").alias("size"), "sha256")


@query(f"WITH {SLOTS} SELECT container, slot_ord, name, is_dir, method_code, size, sha256 FROM s")
def zip_scan(spark: SparkSession, d: str) -> DataFrame:
    return _size(slot_rows(container_files(documents(spark, d))))


@query(f"WITH {SLOTS} SELECT container, slot_ord, name, is_dir, method_code, size, CASE WHEN method_code = 0 THEN size ELSE -1 END AS stored_size, {(41 << 9) + (3 << 5) + 4} AS dos_date, {(5 << 11) + (6 << 5) + 4} AS dos_time FROM s")
def zip_metadata(spark: SparkSession, d: str) -> DataFrame:
    rows = C.scan_files(container_files(documents(spark, d)), payloads=False).where("kind = 'slot'")
    stored = F.when(F.col("method_code") == 0, F.col("compressed_size")).otherwise(-1).alias("stored_size")
    return rows.select("container", "slot_ord", "name", "is_dir", "method_code", F.col("uncompressed_size").alias("size"), stored, "dos_date", "dos_time")


@query(f"WITH {SLOTS} SELECT container, any_value(CASE WHEN number % 5 = 0 THEN {len(PREFIX)} ELSE 0 END)::BIGINT AS prefix_length FROM s GROUP BY container")
def zip_prefix(spark: SparkSession, d: str) -> DataFrame:
    return C.prefix_lengths(container_files(documents(spark, d)))


@query(
    f"""WITH {SLOTS} SELECT container, slot_ord, coalesce(sum(30 + strlen(name) + size) OVER w, 0)::BIGINT AS local_header_offset,
(coalesce(sum(30 + strlen(name) + size) OVER w, 0) + 30 + strlen(name) + size)::BIGINT AS slot_end FROM s WINDOW w AS (PARTITION BY container ORDER BY slot_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def zip_slot_extents(spark: SparkSession, d: str) -> DataFrame:
    from moraine.functions import scalar

    rows = C.scan_files(container_files(documents(spark, d), stored=True)).where("kind = 'slot'")
    zero = F.lit(0).cast("long")
    header = (F.length("local_header_hex") / 2).cast("long")
    end = scalar.slot_end("local_header_offset", header, "compressed_size", zero, F.coalesce("pad_zeros", zero))
    return rows.select("container", "slot_ord", "local_header_offset", end.cast("long").alias("slot_end"))


@query(
    f"""WITH {SLOTS} SELECT 'c' || (number // 4) || '.zip' AS container, (number % 4)::BIGINT AS nested_ord, slot_ord, name, size, sha256 FROM s"""
)
def zip_nested(spark: SparkSession, d: str) -> DataFrame:
    rows = slot_rows(container_files(documents(spark, d), nested=4)).where("nested_ord is not null")
    return rows.select("container", "nested_ord", "slot_ord", "name", F.col("uncompressed_size").alias("size"), "sha256")


@query(f"WITH {SLOTS} SELECT sha256, any_value(size) AS size, count(DISTINCT number) AS ref_count FROM s WHERE NOT is_dir GROUP BY sha256")
def child_references(spark: SparkSession, d: str) -> DataFrame:
    rows = C.scan_files(container_files(documents(spark, d), nested=4)).where("kind = 'payload' and role = 'blob' and not again")
    keyed = rows.select(F.sha2("bytes", 256).alias("h"), F.octet_length("bytes").cast("long").alias("size"), "container_ord")
    return dedup.blobs(keyed, ["container_ord"]).select(F.col("h").alias("sha256"), "size", "ref_count")


@query(f"WITH {SLOTS} SELECT container, count(*) AS slots, count(*) FILTER (method_code = 8) AS hits, 0::BIGINT AS misses FROM s GROUP BY container")
def codec_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = C.scan_files(container_files(documents(spark, d))).where("kind = 'slot'")
    return classify.codec_totals(rows)


@query(f"WITH {SLOTS} SELECT container, slot_ord, size, sha256, strlen(regexp_replace(text, '[^a-z]', '', 'g')) AS letters FROM s WHERE NOT is_dir")
def zip_callback(spark: SparkSession, d: str) -> DataFrame:
    def each(container: str, slot: dict, payload: bytes) -> Iterator[dict]:
        if not slot["is_dir"]:
            yield {"container": container, "slot_ord": slot["slot_ord"], "size": len(payload), "sha256": hashlib.sha256(payload).hexdigest(), "letters": sum(0x61 <= b <= 0x7A for b in payload)}

    return C.map_slots(container_files(documents(spark, d)), each, "container string, slot_ord int, size long, sha256 string, letters long")


@query(f"WITH {SLOTS} SELECT sha256, any_value(size) AS size, count(*) AS ref_count, any_value(size) AS read_size, sha256 AS read_sha256 FROM s WHERE NOT is_dir GROUP BY sha256")
def pack_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = packed(spark, d)
    t = api.catalog(spark, path)
    used = t["slot"].where("blob is not null").select(F.col("blob").alias("h")).distinct()
    read = api.payloads(spark, path).select("h", F.octet_length("bytes").cast("long").alias("read_size"), F.sha2("bytes", 256).alias("read_sha256"))
    return t["blob"].join(used, "h", "left_semi").join(read, "h").select("sha256", "size", "ref_count", "read_size", "read_sha256")


@query(f"WITH {SLOTS}, e AS (SELECT DISTINCT sha256, size FROM s WHERE NOT is_dir) SELECT count(*) AS content_blobs, sum(size)::BIGINT AS content_bytes FROM e")
def content_unique(spark: SparkSession, d: str) -> DataFrame:
    t = api.catalog(spark, packed(spark, d, version=1))
    return dedup.content_only(t["slot"], t["blob"])


@query(f"WITH {SLOTS} SELECT container, count(*) AS entries, false AS signed, 'exact' AS backend, 0::BIGINT AS misses FROM s GROUP BY container")
def pack_list(spark: SparkSession, d: str) -> DataFrame:
    return api.listing(spark, packed(spark, d)).select("container", "entries", "signed", "backend", "misses")


@query(
    f"""WITH {SLOTS}, b AS (SELECT sha256 AS h, any_value(size) AS size, count(*) AS n FROM s WHERE NOT is_dir GROUP BY sha256),
recorded AS (SELECT h, size + CASE WHEN size % 7 = 0 THEN 1 ELSE 0 END AS size, n + CASE WHEN size % 5 = 0 THEN 2 ELSE 0 END AS n FROM b WHERE size % 11 <> 0),
refs AS (SELECT container, name, sha256 AS h, size FROM s WHERE NOT is_dir),
v AS (SELECT 'missing' AS fault, container, name AS detail FROM refs WHERE h NOT IN (SELECT h FROM recorded)
  UNION ALL SELECT 'size', container, name FROM refs JOIN recorded r USING (h) WHERE r.size <> refs.size
  UNION ALL SELECT 'count', NULL, r.h FROM recorded r JOIN (SELECT h, count(*) AS n FROM refs GROUP BY h) c USING (h) WHERE r.n <> c.n)
SELECT fault, container, detail FROM v"""
)
def verify_damaged_pack(spark: SparkSession, d: str) -> DataFrame:
    from moraine.operators import verify as V

    t = api.catalog(spark, packed(spark, d))
    refs = t["slot"].where("blob is not null").select("container", "name", F.col("blob").alias("h"), F.col("uncompressed_size").alias("expected"))
    blobs = t["blob"].join(refs.select("h").distinct(), "h", "left_semi").where("size % 11 != 0")
    blobs = blobs.select("h", (F.col("size") + F.when(F.col("size") % 7 == 0, 1).otherwise(0)).alias("size"), (F.col("ref_count") + F.when(F.col("size") % 5 == 0, 2).otherwise(0)).alias("ref_count"))
    fault = lambda rows, what, container, detail: rows.select(F.lit(what).alias("fault"), container.alias("container"), F.col(detail).alias("detail"))
    out = fault(V.missing(refs, blobs), "missing", F.col("container"), "name").union(fault(V.wrong_sizes(refs, blobs), "size", F.col("container"), "name"))
    wrong = V.reference_counts(refs, blobs).join(blobs.select("h"), "h", "left_semi")
    return out.union(fault(wrong, "count", F.lit(None).cast("string"), "h"))


@query(f"WITH {SLOTS} SELECT DISTINCT sha256 AS h, size, true AS written, true AS \"exists\", sha256 AS read_sha256 FROM s WHERE NOT is_dir")
def cas_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d).select(F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes")).withColumn("h", F.sha2("bytes", 256))
    folder = scratch(spark, "cas")
    put = written(cas.put(rows, folder), "put")
    found = cas.get(put, folder).select("h", "size", F.sha2("bytes", 256).alias("read_sha256"))
    return cas.exists(put, folder).join(found, "h").select("h", "size", "written", "exists", "read_sha256")


@query(f"WITH {SLOTS} SELECT container, slot_ord, name, size, sha256, 'exact' AS backend FROM s")
def restore_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = packed(spark, d)
    folder = os.path.join(os.path.dirname(path), "back")
    done = api.restore(spark, path, folder)
    rows = slot_rows(C.read_files(spark, [os.path.join(folder, n) for n, _ in done], [n for n, _ in done]))
    backend = spark.createDataFrame(done, "container string, backend string")
    return rows.join(backend, "container").select("container", "slot_ord", "name", F.col("uncompressed_size").alias("size"), "sha256", "backend")


def _restored(spark: SparkSession, d: str, backend: str) -> DataFrame:
    return _size(slot_rows(rewritten(container_files(documents(spark, d)), backend))).withColumn("backend", F.lit(backend))


@query(RESTORED.format(classify.EXACT))
def restore_exact(spark: SparkSession, d: str) -> DataFrame:
    return _restored(spark, d, classify.EXACT)


@query(RESTORED.format(classify.REBUILD))
def restore_rebuild(spark: SparkSession, d: str) -> DataFrame:
    return _restored(spark, d, classify.REBUILD)


@query(RESTORED.format(classify.SEEK))
def restore_seek(spark: SparkSession, d: str) -> DataFrame:
    return _restored(spark, d, classify.SEEK)


@query(RESTORED.format(classify.CONCAT))
def restore_concat(spark: SparkSession, d: str) -> DataFrame:
    return _restored(spark, d, classify.CONCAT)


@query(RESTORED.format(classify.PLAIN))
def restore_plain(spark: SparkSession, d: str) -> DataFrame:
    return _restored(spark, d, classify.PLAIN)
