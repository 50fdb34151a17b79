"""The four verbs: pack, catalog, verify, restore."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from moraine.functions import scalar
from moraine.functions.blake3 import blake3, digest as blake3_digest
from moraine.operators import classify, dedup, folds, inputs as I, verify as V
from moraine.sources import cas, containers as C, pack_format as P, zip_writers as Z
from moraine.sources.containers import PARTS

from .storage import reader, streamed, written


@dataclass
class PackOptions:
    inputs: list[str]
    output: str
    level: int = 6
    recursive: bool = False
    exclude: list[str] = field(default_factory=list)
    sort_inputs: bool = False
    strict: bool = False
    fail_on_signed: bool = False
    sidecar: str | None = None
    dry_run: bool = False
    expand_nested: bool = True
    key: str = "blake3"
    frame_limit: int = P.FRAME_LIMIT
    restore_paths: bool = False
    version: int = 2
    progress: Callable[[str, int], None] | None = None
    """Called with the name of a phase that is done, and how many rows it has."""
    dialect: P.Dialect = P.MORAINE


@dataclass
class RestoreOptions:
    """restore_paths: write each container to where it was packed from, with its mode and owner; folder isn't used then.

    clean: an existing file is removed first; overwrite: it is replaced. store_all, level: for containers that are written anew.
    """

    folder: str = "."
    only: list[str] | None = None
    overwrite: bool = False
    clean: bool = False
    restore_paths: bool = False
    store_all: bool = False
    level: int = 6
    warn: Callable[[str], None] = lambda text: None
    dialect: P.Dialect = P.MORAINE


@dataclass
class PackSummary:
    stats: dict
    warnings: list[str]
    archive_bytes: int


def content_hash(column: str, key: str):
    return blake3(column) if key == "blake3" else F.sha2(F.col(column), 256)


def _end_of(blobs: DataFrame, count: int, key: str) -> bytes:
    """The end digest: the hash of all keys (first_seen_ord, h) in order. BLAKE3 takes them at once, 32 bytes each; SHA-256 one by one."""
    keys = (bytes.fromhex(r["h"]) for r in streamed(blobs.select("first_seen_ord", "h"), "first_seen_ord", count, 100 * count))
    if key == "blake3":
        return blake3_digest(b"".join(keys))
    chain = hashlib.sha256()
    for k in keys:
        chain.update(k)
    return chain.digest()


def pack(spark: SparkSession, options: PackOptions) -> PackSummary:
    """Scan the inputs, keep each payload once, and write a pack; the destination is replaced only when all is done."""
    if not 1 <= options.level <= 19:
        raise ValueError(f"the level is 1 to 19, not {options.level}")
    warnings: list[str] = []
    paths = I.expand(options.inputs, options.recursive, options.exclude, options.sort_inputs, strict=options.strict, warn=warnings.append)
    for p in paths:
        if not os.path.isfile(p):
            if options.strict:
                raise FileNotFoundError(p)
            warnings.append(f"skipped {p}")
    paths = [p for p in paths if os.path.isfile(p)]
    say = options.progress or (lambda phase, done: None)
    rows = written(C.scan_files(C.read_files(spark, paths, I.unique_names(paths)), expand=options.expand_nested), "scan")
    if fault := rows.where("kind = 'fault'").select("source_path", "fault").first():
        raise P.PackError(f"{fault[0]}: {fault[1]}")
    for r in rows.where("kind = 'warning'").select("source_path", "fault").orderBy("container_ord").toLocalIterator():
        if options.strict:
            raise P.PackError(f"{r[0]}: {r[1]}")
        warnings.append(f"{r[0]}: {r[1]}")
    say("scan", len(paths))

    payloads = rows.where("kind = 'payload'").select("container_ord", "nested_ord", "slot_ord", "role", "place", "bytes", "again", F.octet_length("bytes").cast("long").alias("size"))
    payloads = written(payloads.withColumn("h", content_hash("bytes", options.key)).withColumn("sha256", F.sha2("bytes", 256)), "payloads")
    order = ["container_ord", "place"]
    blobs = dedup.catalog(payloads.where("not again").select("h", "size", *order), order)
    first = payloads.select("h", "sha256", *order).join(blobs, ["h", *order])
    first = written(first.withColumn("length", scalar.blob_record_length("size")), "blobs")
    framed = written(folds.frames(first, ["first_seen_ord"], "length", options.frame_limit), "frames")
    say("dedup", blob_count := framed.count())

    jars = _jars(rows, payloads, options.restore_paths)
    stats = _stats(jars, framed)
    signed = [r["name"] for r in jars.where("signed").select("container_ord", "name").orderBy("container_ord").collect()]
    warnings += [f"signed container {n}" for n in signed]
    if signed and options.fail_on_signed:
        raise ValueError(f"signed container {signed[0]}")
    if options.dry_run:
        return PackSummary(stats, warnings, 0)
    body = _document(jars, framed, stats, options)

    tags, level = options.dialect, options.level

    def compressed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rec_off")
        data = b"".join(P.blob_record(tags, bytes.fromhex(h), b) for h, b in zip(frame["h"], frame["bytes"]))
        places = json.dumps([[h, int(o), int(s)] for h, o, s in zip(frame["h"], frame["rec_off"], frame["size"])])
        return pd.DataFrame({"frame_id": [frame["frame_id"].iloc[0]], "data": [P.compress(data, level)], "places": [places]})

    # A frame holds at most the frame limit, or one payload; frames are compressed side by side and come to the writer in order.
    data = framed.join(payloads.select("bytes", *order), order)
    partial, beside = options.output + ".tmp", f"{options.sidecar}.tmp"
    created = 0 if options.sort_inputs else int(time.time())
    frame_count = framed.agg(F.max("frame_id")).first()[0]
    frame_count = 0 if frame_count is None else frame_count + 1
    unique = stats["bytes_unique_blobs"]
    end = _end_of(framed, blob_count, options.key)
    with open(partial, "wb") as out, open(beside if options.sidecar else os.devnull, "wb") as copy:
        body = P.Pieces(body.length, _copied(body.parts, copy))
        if options.version == 1:
            rows = streamed(data.select("frame_id", "first_seen_ord", "h", "bytes"), "frame_id", frame_count, unique, order="first_seen_ord")
            made = ((bytes.fromhex(r["h"]), bytes(r["bytes"])) for r in rows)
            layout = P.write_pack_v1(out, made, body, end, stats["jar_count"], level, created, tags)
        else:
            frames = data.groupBy("frame_id").applyInPandas(compressed, "frame_id long, data binary, places string")
            made = ((bytes(r["data"]), [(bytes.fromhex(h), o, s) for h, o, s in json.loads(r["places"])]) for r in streamed(frames, "frame_id", frame_count, unique))
            layout = P.write_pack(out, made, lambda: body, end, stats["jar_count"], level, created, tags)
    P.check_finished(partial, layout, tags)
    say("write", blob_count)
    os.replace(partial, options.output)
    if options.sidecar:
        os.replace(beside, options.sidecar)
    return PackSummary(stats, warnings, os.path.getsize(options.output))


def _jars(rows: DataFrame, payloads: DataFrame, attributes: bool) -> DataFrame:
    """A row for each container, made by executors: container_ord, name, its catalog document as JSON, and what statistics need."""
    fields = [f.name for f in rows.schema.fields if f.name not in ("place", "bytes", "again", "fault")]
    named = payloads.select("container_ord", "nested_ord", "slot_ord", "role", "h", "sha256", "size", F.lit("payload").alias("kind"))
    every = rows.where("kind in ('slot', 'nested', 'container')").select(*fields).unionByName(named, allowMissingColumns=True)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        jar = C.document_of(group.to_pylist())
        if attributes:
            jar |= restore_attributes(jar["source_path"])
        files = [e for e in jar["entries"] if not e["is_dir"]]
        values = {"container_ord": key[0].as_py(), "name": jar["name"], "signed": jar["signed"], "entries": len(jar["entries"]), "files": len(files)}
        values |= {"bytes": sum(e["uncompressed_size"] for e in files), "source_size": jar["source_size"], "document": json.dumps(jar, separators=(",", ":"), ensure_ascii=False)}
        return pa.table({k: [v] for k, v in values.items()}, schema=schema)

    schema = pa.schema([("container_ord", pa.int32()), ("name", pa.string()), ("signed", pa.bool_()), *((c, pa.int64()) for c in ("entries", "files", "bytes", "source_size")), ("document", pa.string())])
    return written(every.groupBy("container_ord").applyInArrow(run, "container_ord int, name string, signed boolean, entries long, files long, bytes long, source_size long, document string"), "jars")


def _stats(jars: DataFrame, blobs: DataFrame) -> dict:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    a = jars.agg(F.count(F.lit(1)), total("entries"), total("files"), total("source_size"), total("bytes")).first()
    b = blobs.agg(F.count(F.lit(1)), total("size")).first()
    stats = {"jar_count": a[0], "entry_count": a[1], "file_entry_count": a[2], "unique_blob_count": b[0], "bytes_in_jars": a[3], "bytes_uncompressed_entries": a[4], "bytes_unique_blobs": b[1]}
    return stats | {"dedup_ratio": 1 - b[1] / a[4] if a[4] else 0.0}


def _document(jars: DataFrame, framed: DataFrame, stats: dict, options: PackOptions) -> P.Pieces:
    """The catalog document. It is one record of the pack, which the driver writes: executors make its parts, and they pass through the driver a few MB at a time."""
    blobs = framed.select("first_seen_ord", F.to_json(F.struct(F.col("h").alias("blake3"), "sha256", "size", "ref_count")).alias("document"))
    count = lambda rows: rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("document").cast("long")), F.lit(0))).first()
    (jar_count, jar_bytes), (blob_count, blob_bytes) = count(jars), count(blobs)
    top = jars.agg(F.max("container_ord")).first()[0]
    head = {"format": options.dialect.catalog_format, "version": 1, "hash_algo": options.key, "mode": "content"}
    text = lambda x: json.dumps(x, separators=(",", ":"))
    fixed = [x.encode() for x in (f'{text(head)[:-1]},"jars":[', '],"blobs":[', f'],"stats":{text(stats)}}}')]

    def parts() -> Iterator[bytes]:
        yield fixed[0]
        for rows, by, values, size, last in ((jars, "container_ord", (top or 0) + 1, jar_bytes, fixed[1]), (blobs, "first_seen_ord", blob_count, blob_bytes, fixed[2])):
            for n, r in enumerate(streamed(rows.select(by, "document"), by, values, size, part=8 << 20)):
                yield b"," * (n > 0) + r["document"].encode()
            yield last

    return P.Pieces(sum(map(len, fixed)) + jar_bytes + max(0, jar_count - 1) + blob_bytes + max(0, blob_count - 1), parts())


def _copied(parts: Iterable[bytes], out) -> Iterator[bytes]:
    for part in parts:
        out.write(part)
        yield part


def restore_attributes(path: str) -> dict:
    try:
        s = os.stat(path)
        return {"restore_path": os.path.realpath(path), "restore_mode": s.st_mode & 0o7777, "restore_uid": s.st_uid, "restore_gid": s.st_gid}
    except OSError:
        return {}


SLOT_SCHEMA = """container string, nested_ord long, slot_ord int, name string, is_dir boolean, blob string, sha256 string, crc32 long, method string,
method_code int, uncompressed_size long, compressed_size long, dos_date int, dos_time int, unix_mode long, utf8_flag boolean, name_raw_hex string,
cdata_blob string, cdata_codec string, local_header_offset long, local_header_hex string, local_header_blob string, data_descriptor_hex string,
pad_zeros long, pad_blob string, zip_index long"""
PARTS_SCHEMA = ", ".join(f"{k}_blob string, {k}_size long" for k in PARTS)
CONTAINER_SCHEMA = f"container string, container_ord int, source_path string, source_size long, source_sha256 string, comment string, signed boolean, restore_path string, restore_mode long, restore_uid long, restore_gid long, {PARTS_SCHEMA}"


NESTED_SCHEMA = f"container string, container_ord int, nested_ord long, {PARTS_SCHEMA}"
BLOB_SCHEMA = "first_seen_ord long, h string, sha256 string, size long, ref_count long"
#: How much of a catalog's text an executor's task takes.
CATALOG_PART = 8 << 20


def _fields(schema: str) -> dict[str, str]:
    return dict(f.split() for f in schema.replace("\n", " ").split(", "))


@dataclass
class Catalog:
    """A pack's catalog. head: its document without jars and blobs; end: the end digest; tables: container, nested, slot, blob, stats; jars: container, container_ord, document (JSON)."""

    head: dict
    end: bytes
    tables: dict[str, DataFrame]
    jars: DataFrame


def read(spark: SparkSession, path: str, dialect: P.Dialect = P.MORAINE) -> Catalog:
    """The catalog of a pack that executors see at this path; of a version 2 pack only the last frame is read.

    It is one compressed JSON text: one task takes it apart as it reads, container by container, and others parse them. The driver gets the head.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    with open(path, "rb") as f:
        layout = P.open_layout(f, dialect)
    kinds = {"container": _fields(CONTAINER_SCHEMA) | {"document": "string"}, "nested": _fields(NESTED_SCHEMA), "slot": _fields(SLOT_SCHEMA), "blob": _fields(BLOB_SCHEMA), "head": {"document": "string"}}
    ddl = ", ".join(f"{k} {v}" for k, v in ({"kind": "string"} | {k: v for names in kinds.values() for k, v in names.items()}).items())
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    lines = pa.schema([("kind", pa.string()), ("ord", pa.int64()), ("text", pa.string())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, blobs, count, head, lists = [], 0, [], 0, {}, {"jars", "blobs"}

        def group() -> dict:
            line = {"kind": "blobs", "ord": count - len(blobs), "text": f"[{','.join(blobs)}]"}
            blobs.clear()
            return line

        for _ in batches:  # one row
            with open(path, "rb") as f:
                for key, place, text in P.catalog_values(f, dialect):
                    size += len(text)
                    if key in ("jars", "blobs"):
                        lists.discard(key)
                    if key == "jars" and place is not None:
                        held.append({"kind": "jar", "ord": place, "text": text})
                    elif key == "blobs" and place is not None:
                        blobs.append(text)
                        count += 1
                        if len(blobs) == 4096:
                            held.append(group())
                    elif place is None:
                        head[key] = json.loads(text)
                    else:
                        head.setdefault(key, []).append(json.loads(text))
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, lines)
                        held, size = [], 0
            if lists or head.get("jars", []) != [] or head.get("blobs", []) != []:
                raise P.PackError("the catalog has no list of jars or of blobs")
            if blobs:
                held.append(group())
            held.append({"kind": "head", "ord": 0, "text": json.dumps(head)})
            yield pa.RecordBatch.from_pylist(held, lines)

    def rows_of(kind: str, place: int, text: str) -> Iterator[tuple[str, dict]]:
        if kind == "head":
            yield "head", {"document": text}
        elif kind == "blobs":
            for n, b in enumerate(json.loads(text)):
                yield "blob", {"first_seen_ord": place + n, "h": b["blake3"].lower(), "sha256": b["sha256"].lower(), "size": b["size"], "ref_count": b["ref_count"]}
        else:
            jar = json.loads(text)
            at = {"container": jar["name"], "container_ord": place}
            yield "container", jar | at | {"document": text}
            for n, e in enumerate(jar["entries"]):
                yield "slot", e | at | {"slot_ord": n}
            for i, child in enumerate(jar.get("nestedindexes", [])):
                yield "nested", child | at | {"nested_ord": i}
                for n, e in enumerate(child["entries"]):
                    yield "slot", e | at | {"nested_ord": i, "slot_ord": n}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for line in zip(*(batch.column(c).to_pylist() for c in ("kind", "ord", "text"))):
                for kind, values in rows_of(*line):
                    held.append({k: values.get(k) for k in kinds[kind]} | {"kind": kind})
                    if len(held) >= 4096:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    taken = spark.range(0, 1, 1, 1).mapInArrow(split, "kind string, ord long, text string")
    taken = taken.repartition(max(1, -(-layout.catalog_length // CATALOG_PART)), "kind", "ord")
    rows = reader(taken.mapInArrow(parse, ddl), "catalog")
    of = lambda kind: rows().where(F.col("kind") == kind).select(*(k for k in kinds[kind] if k != "document"))
    head = json.loads(rows().where("kind = 'head'").select("document").collect()[0][0])
    if head.get("format") != dialect.catalog_format:
        raise P.PackError(f"the catalog's format is {head.get('format')!r}")
    stats = head["stats"]
    tables = {k: of(k) for k in ("container", "nested", "slot", "blob")}
    tables["stats"] = spark.createDataFrame([tuple(stats.values())], ", ".join(f"{k} {'double' if k == 'dedup_ratio' else 'long'}" for k in stats))
    return Catalog(head, bytes.fromhex(head["end"]), tables, rows().where("kind = 'container'").select("container", "container_ord", "document"))


def document(path: str, dialect: P.Dialect = P.MORAINE) -> dict:
    """The whole catalog document, held by the caller."""
    with open(path, "rb") as f:
        found = P.read_catalog(f, dialect)[1]
    if found.get("format") != dialect.catalog_format:
        raise P.PackError(f"the catalog's format is {found.get('format')!r}")
    return found


def catalog(spark: SparkSession, path: str, dialect: P.Dialect = P.MORAINE) -> dict[str, DataFrame]:
    """The catalog's tables: container, nested, slot, blob, stats."""
    return read(spark, path, dialect).tables


def payloads(spark: SparkSession, path: str, dialect: P.Dialect = P.MORAINE) -> DataFrame:
    """ord, h, size, bytes of a pack's payloads, a partition for each run of frames; executors read the file by range.

    These are the rows of format("moraine_pack"), without the Python processes that Spark starts beside the driver to plan a data source.
    """
    from moraine.sources.pack_source import frames, payloads_of

    places, size = [], 0
    for offset, length, first in frames(path, dialect):
        places.append((offset, length, first, size // C.TASK_BYTES))
        size += P.FRAME_LIMIT  # about what a frame unpacks to
    schema = pa.schema([("ord", pa.int64()), ("h", pa.string()), ("size", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in zip(*(batch.column(c).to_pylist() for c in ("offset", "length", "first"))):
                held, size = [], 0
                for row in payloads_of(path, *place, dialect):
                    held.append(row)
                    size += row[2] + 100
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    dealt = spark.createDataFrame(places, "offset long, length long, first long, task int").repartitionById(places[-1][3] + 1 if places else 1, "task")
    return dealt.mapInArrow(run, "ord long, h string, size long, bytes binary")


def verify(spark: SparkSession, path: str, dialect: P.Dialect = P.MORAINE) -> DataFrame:
    """All violations of a pack, in the order of their severity column; empty for a sound pack."""
    found = read(spark, path, dialect)
    key, blobs = found.head["hash_algo"], found.tables["blob"]
    data = payloads(spark, path, dialect)
    data = data.select("ord", "h", "size", content_hash("bytes", key).alias("key"), F.sha2("bytes", 256).alias("sha256"), F.crc32("bytes").alias("crc32"))
    data = written(data, "verified")
    out = V.verify(found.tables, data)
    listed = blobs.select(F.col("first_seen_ord").alias("ord"), "h")
    differences = V.violation(V.sequence_differences(data, listed), 17, "sequence", None, None, F.concat_ws(" ", "side", F.col("ord").cast("string"), "h"))
    chain = _end_of(blobs, blobs.count(), key)
    ends = spark.createDataFrame([] if chain == found.end else [(chain.hex(),)], "d string")
    return out.unionByName(differences).unionByName(V.violation(ends, 18, "end_digest", None, None, F.col("d")))


def listing(spark: SparkSession, path: str, dialect: P.Dialect = P.MORAINE) -> DataFrame:
    t = catalog(spark, path, dialect)
    return classify.listing(t["container"], t["slot"], t["nested"])


def backends(t: dict[str, DataFrame]) -> dict[str, str]:
    """The writer that restores each container of a catalog's tables."""
    return {r["container"]: r["backend"] for r in classify.backend(t["container"], t["slot"], t["nested"]).select("container", "backend").collect()}


def container_bytes(jar: dict, held: dict[str, bytes], backend: str, level: int = 6, store_all: bool = False, warn: Callable[[str], None] = lambda text: None) -> bytes:
    """A container by one of the writers. An exact one is checked against its recorded hash."""
    if backend == classify.EXACT:
        return Z.checked(jar, Z.exact_bytes(jar, held))
    if backend == classify.REBUILD:
        return Z.rebuilt_bytes(jar, held, level)
    if backend == classify.SEEK:
        return Z.seek_bytes(jar, held)
    if backend == classify.CONCAT:
        return Z.concat_bytes(jar, held, level)
    return Z.plain_bytes(jar, held, level, store_all, warn)


def restore(spark: SparkSession, path: str, folder: str = ".", only: Iterable[str] | None = None, overwrite: bool = False, dialect: P.Dialect = P.MORAINE, level: int = 6, **more) -> list[tuple[str, str]]:
    """Write containers to folder, which executors share; returns (name, backend), in catalog order. More: see RestoreOptions.

    Containers whose slices are all known come back byte for byte and are checked against their recorded hash; others are put
    together again by the writer that loses least. Every payload is hashed again before it is used; payloads of other containers are
    not read. Names that the pack doesn't have give a warning.
    """
    o = RestoreOptions(folder, None if only is None else list(only), overwrite, level=level, dialect=dialect, **more)
    found = read(spark, path, dialect)
    # Of each container the driver gets its name and what says where it goes, as it gives a result for each.
    jars = found.tables["container"].select(F.col("container").alias("name"), "container_ord", "restore_path", "restore_mode", "restore_uid", "restore_gid", "prefix_size")
    jars = [r.asDict() for r in sorted(jars.collect(), key=lambda r: r["container_ord"])]
    known = {j["name"] for j in jars}
    for name in o.only or []:
        if name not in known:
            o.warn(f"the pack has no container {name}")
    wanted = known if o.only is None else set(o.only)
    chosen = [j for j in jars if j["name"] in wanted]
    targets = _targets(jars, chosen, o)
    writer = backends(found.tables)
    key, level, store_all = found.head["hash_algo"], o.level, o.store_all
    refs = V.blob_references(found.tables).join(spark.createDataFrame([(j["name"],) for j in chosen], "container string"), "container", "left_semi")
    # Each payload is hashed once, however many containers it goes to.
    data = payloads(spark, path, dialect).select("h", "bytes", (content_hash("bytes", key) == F.col("h")).alias("sound"))
    data = written(data.join(refs.select("h").distinct(), "h", "left_semi"), "restore").join(refs.select("container", "h").distinct(), "h")
    rows = [(j["container_ord"], writer[j["name"]], targets[j["name"]]) for j in chosen]
    named = found.jars.join(spark.createDataFrame(rows, "container_ord int, backend string, target string"), "container_ord")

    def write(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        said: list[str] = []
        for r in left.to_pylist():
            jar = json.loads(r["document"])
            if bad := [h for h, sound in zip(right.column("h").to_pylist(), right.column("sound").to_pylist()) if not sound]:
                raise P.PackError(f"{jar['name']}: payload {bad[0]} has another hash")
            held = dict(zip(right.column("h").to_pylist(), right.column("bytes").to_pylist()))
            content = container_bytes(jar, held, r["backend"], level, store_all, said.append)
            partial = f"{r['target']}.{os.getpid()}.tmp"
            with open(partial, "wb") as out:
                out.write(content)
            os.replace(partial, r["target"])
        return pa.table({"container": [key[0].as_py()], "said": pa.array([said], pa.list_(pa.string()))})

    done = named.groupBy("container").cogroup(data.groupBy("container")).applyInArrow(write, "container string, said array<string>").collect()
    for r in sorted(done, key=lambda r: r["container"]):  # a sort in Spark would have the containers written twice
        for text in r["said"]:
            o.warn(text)
    for jar in chosen:
        apply_attributes(jar, targets[jar["name"]], o)
    return [(j["name"], writer[j["name"]]) for j in chosen]


def _targets(jars: list[dict], chosen: list[dict], o: RestoreOptions) -> dict[str, str]:
    """Where each container goes; refuses unsafe names and files that are there, before anything is written."""
    out = {}
    if o.restore_paths:
        for jar in jars:
            if not jar.get("restore_path"):
                raise ValueError(f"{jar['name']}: the pack doesn't say where it came from")
    else:
        os.makedirs(o.folder, exist_ok=True)
    for jar in chosen:
        name = jar["name"]
        if o.restore_paths:
            target = jar["restore_path"]
            if "\0" in target or not os.path.isabs(target):
                raise ValueError(f"{name}: unsafe path {target!r}")
            if os.path.isdir(target) and not os.path.islink(target):
                raise ValueError(f"{target} is a folder")
        else:
            if name in ("", ".", "..") or any(c in name for c in "/\\\0"):
                raise ValueError(f"unsafe name {name!r}")
            target = os.path.join(o.folder, name)
            if os.path.lexists(target) and not (o.overwrite or o.clean):
                raise FileExistsError(target)
        out[name] = target
    for target in out.values():
        if o.restore_paths:
            make_parents(target)
        elif o.clean and os.path.lexists(target):
            os.remove(target)
    return out


def make_parents(path: str) -> None:
    """The folders above path that are missing, with mode 0755 whatever the umask is."""
    missing, above = [], os.path.dirname(path)
    while above and not os.path.lexists(above):
        missing.append(above)
        above = os.path.dirname(above)
    for folder in reversed(missing):
        os.mkdir(folder)
        os.chmod(folder, 0o755)


def apply_attributes(jar: dict, target: str, o: RestoreOptions) -> None:
    """Mode and owner as recorded, if paths are restored; else, and without a recorded mode, a container with a launcher is executable."""
    mode = jar.get("restore_mode") if o.restore_paths else None
    if mode is not None:
        os.chmod(target, mode)
    elif jar.get("prefix_size"):
        os.chmod(target, 0o755)
    if o.restore_paths and jar.get("restore_uid") is not None and jar.get("restore_gid") is not None:
        try:
            os.chown(target, jar["restore_uid"], jar["restore_gid"])
        except PermissionError as e:
            o.warn(f"the owner of {target} stays: {e}")


def spill(spark: SparkSession, path: str, folder: str, dialect: P.Dialect = P.MORAINE) -> int:
    """Put all payloads of a pack into a content-addressed folder; returns how many were new. A payload of another hash, or a wrong end record, is an error."""
    found = read(spark, path, dialect)
    blobs, key = found.tables["blob"], found.head["hash_algo"]
    if _end_of(blobs, blobs.count(), key) != found.end:
        raise P.PackError("the end record differs from the listed payloads")
    data = written(payloads(spark, path, dialect).select("h", "bytes", (content_hash("bytes", key) == F.col("h")).alias("sound")), "spill")
    if bad := data.where("not sound").select("h").first():
        raise P.PackError(f"payload {bad[0]} has another hash")
    return cas.put(data, folder).where("written").count()
