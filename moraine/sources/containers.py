"""Scanning containers into rows: one pass over binary files gives slots, containers, nested containers and payloads."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from moraine.functions.scalar import METHODS

from .zip_layout import Container, ContainerError, Slot, joined, prefix_length, scan

#: Local headers up to this length are kept as hex, longer ones as payloads.
HEADER_HEX, NESTED_CAP = 512, 65_535
SIGNATURE = re.compile(r"meta-inf/[^/]*\.(sf|rsa|dsa|ec)")
SLOT_FIELDS = """name string, is_dir boolean, crc32 long, method_code int, uncompressed_size long, compressed_size long, dos_date int,
dos_time int, unix_mode long, utf8_flag boolean, name_raw_hex string, local_header_offset long, local_header_hex string,
data_descriptor_hex string, pad_zeros long, cdata_codec string, zip_index long"""
#: kind: slot, container, nested, payload, warning or fault. A payload's role says which column of its row names it; place orders payloads;
#: again: the expanded container that it lies in held the same payload before, so it counts as no further reference.
SCHEMA = f"""kind string, container_ord int, container string, nested_ord long, slot_ord int, {SLOT_FIELDS},
source_path string, source_size long, source_sha256 string, comment string, whole boolean, role string, place array<long>, bytes binary, again boolean, fault string"""


def _slot_row(s: Slot, **more) -> dict:
    return {
        "kind": "slot", "name": s.name, "is_dir": s.is_dir, "crc32": s.crc32, "method_code": s.method_code, "uncompressed_size": s.uncompressed_size, "compressed_size": s.compressed_size,
        "dos_date": s.dos_date, "dos_time": s.dos_time, "unix_mode": s.unix_mode, "utf8_flag": s.utf8_flag, "name_raw_hex": None if s.utf8_name else s.raw_name.hex(), "local_header_offset": s.local_offset,
        "data_descriptor_hex": s.descriptor.hex() or None, "cdata_codec": s.codec if s.method_code == 8 else None, **more,
    }


def _reproducible(c: Container) -> bool:
    return c.whole and all(s.method_code == 0 or s.codec or (s.is_dir and not s.compressed_size) for s in c.slots)


def _expanded(s: Slot) -> Container | None:
    """The container in a stored slot, if its slices give back the payload byte for byte."""
    if s.method_code or s.is_dir or not s.payload or s.payload[:4] != b"PK\x03\x04":
        return None
    try:
        child = scan(s.payload)
    except ContainerError:
        return None
    if not child.slots or len(child.slots) > NESTED_CAP or any(t.fault for t in child.slots) or not _reproducible(child) or joined(child) != s.payload:
        return None
    return child


def rows_of(data: bytes, path: str, name: str, number: int, payloads: bool = True, expand: bool = True) -> Iterator[dict]:
    """All rows of one container. Payload places follow the order in which a writer would meet them."""
    base = {"container_ord": number, "container": name}
    try:
        c = scan(data, payloads=payloads)
    except ContainerError as e:
        yield {**base, "kind": "fault", "source_path": path, "fault": str(e)}
        return

    met: set[bytes] = set()

    def payload(role: str, data: bytes, place: list[int], **where) -> dict:
        again = False
        if "nested_ord" in where:
            digest = hashlib.sha256(data).digest()
            again = digest in met
            met.add(digest)
        return {**base, "kind": "payload", "role": role, "place": place, "bytes": data, "again": again, **where}

    def header_and_pad(s: Slot, row: dict, place: list[int], **where) -> Iterator[dict]:
        if len(s.header) <= HEADER_HEX:
            row["local_header_hex"] = s.header.hex()
        else:
            yield payload("local_header_blob", s.header, [*place, 1], **where)
        if s.pad and not any(s.pad):
            row["pad_zeros"] = len(s.pad)
        elif s.pad:
            yield payload("pad_blob", s.pad, [*place, 2], **where)

    nested = 0
    for k, s in enumerate(c.slots):
        where = {"slot_ord": k}
        row = _slot_row(s, **base, **where)
        child = _expanded(s) if payloads and expand else None
        if s.fault:
            yield {**base, "kind": "warning", "source_path": path, "fault": s.fault}
        if child is not None:
            met.clear()
            row["zip_index"] = nested
            for j, t in enumerate(child.slots):
                inner = {"slot_ord": j, "nested_ord": nested}
                line = _slot_row(t, **base, **inner)
                if not t.is_dir:
                    yield payload("blob", t.payload, [0, k, j, 0], **inner)
                yield from header_and_pad(t, line, [0, k, j], **inner)
                yield line
            for role, part, last in (("prefix_blob", child.prefix, 0), ("leading_pad_blob", child.leading_pad, 1), ("tail_blob", child.tail, 2)):
                if part:
                    yield payload(role, part, [0, k, len(child.slots), last], nested_ord=nested)
            yield {**base, "kind": "nested", "nested_ord": nested}
            nested += 1
        elif payloads and not s.is_dir:
            yield payload("blob", s.payload, [0, k, 0, 0], **where)
        if payloads and c.whole:
            yield from header_and_pad(s, row, [2, k, 0], **where)
        yield row
    if payloads and c.prefix:
        yield payload("prefix_blob", c.prefix, [1, 0, 0, 0])
    if payloads and c.whole:
        if c.leading_pad:
            yield payload("leading_pad_blob", c.leading_pad, [3, 0, 0, 0])
        yield payload("tail_blob", c.tail, [4, 0, 0, 0])
    yield {**base, "kind": "container", "source_path": path, "source_size": len(data), "source_sha256": hashlib.sha256(data).hexdigest(), "comment": c.comment, "whole": c.whole}


def scan_files(files: DataFrame, payloads: bool = True, expand: bool = True) -> DataFrame:
    """Rows of SCHEMA from files (path, content, container, container_ord). A file that can't be scanned gives a fault row."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                f = batch.slice(k, 1).to_pylist()[0]
                held, size = [], 0
                for row in rows_of(f["content"], f["path"], f["container"], f["container_ord"], payloads, expand):
                    held.append(row)
                    size += len(row.get("bytes") or b"") + 500
                    if size > 16 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return files.select("path", "content", "container", "container_ord").mapInArrow(run, SCHEMA)


def map_slots(files: DataFrame, each: Callable[[str, dict, bytes], Iterable[dict]], schema: str) -> DataFrame:
    """Rows of a schema that each(container, slot, payload) gives for every slot of files; directories have no bytes. Runs on executors."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                for k, s in enumerate(scan(f["content"], trials=False).slots):
                    rows = list(each(f["container"], _slot_row(s, container=f["container"], slot_ord=k), s.payload or b""))
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, target)

    return files.select("path", "content", "container", "container_ord").mapInArrow(run, schema)


#: Columns of a slot that name payloads, those of a catalog's slot, and those that it has even if null.
NAMED = ("blob", "cdata_blob", "local_header_blob", "pad_blob")
SLOT_COLUMNS = ["name", "is_dir", "blob", "sha256", "crc32", "method", "method_code", "uncompressed_size", "compressed_size", "dos_date", "dos_time", "unix_mode", "utf8_flag", "name_raw_hex", "cdata_blob", "cdata_codec", "local_header_offset", "local_header_hex", "local_header_blob", "data_descriptor_hex", "pad_zeros", "pad_blob", "zip_index"]
REQUIRED = {"blob", "sha256", "unix_mode"}
PARTS = ("prefix", "leading_pad", "tail", "raw_zip")


def document_of(rows: Iterable[dict]) -> dict:
    """The catalog document of one container from its rows; payload rows give h, sha256 and size in place of bytes."""
    names: dict[tuple, dict] = {}
    slots, nested, jar = [], 0, {}
    for r in rows:
        if r["kind"] == "payload":
            names.setdefault((r["nested_ord"], r["slot_ord"]), {})[r["role"]] = (r["h"], r["sha256"], r["size"])
        elif r["kind"] == "slot":
            slots.append(r)
        elif r["kind"] == "nested":
            nested += 1
        elif r["kind"] == "container":
            jar = {"name": r["container"], "source_path": r["source_path"].removeprefix("file:"), **{c: r[c] for c in ("source_size", "source_sha256", "comment")}, "signed": False}

    def parts(own: dict) -> dict:
        return {f"{k}_{what}": own[f"{k}_blob"][n] for k in PARTS if f"{k}_blob" in own for what, n in (("blob", 0), ("size", 2))}

    jar |= parts(names.get((None, None), {}))
    jar["nestedindexes"] = [parts(names.get((k, None), {})) | {"entries": []} for k in range(nested)]
    jar["entries"] = []
    for r in sorted(slots, key=lambda r: (r["nested_ord"] is not None, r["nested_ord"] or 0, r["slot_ord"])):
        own = names.get((r["nested_ord"], r["slot_ord"]), {})
        label = METHODS.get(r["method_code"], "other")
        values = r | {k: own[k][0] if k in own else None for k in NAMED} | {"method": label, "sha256": own["blob"][1] if "blob" in own else None}
        (jar if r["nested_ord"] is None else jar["nestedindexes"][r["nested_ord"]])["entries"].append({k: values[k] for k in SLOT_COLUMNS if values.get(k) is not None or k in REQUIRED})
        jar["signed"] |= r["nested_ord"] is None and SIGNATURE.fullmatch(r["name"].replace("\\", "/").lower()) is not None
    if not nested:
        del jar["nestedindexes"]
    return jar


FILES = "path string, content binary, container string, container_ord int"
#: So many bytes of files are one task's.
TASK_BYTES = 16 << 20


def read_files(spark: SparkSession, paths: list[str], names: list[str]) -> DataFrame:
    """path, content, container, container_ord of the files.

    Paths without a scheme are files that executors see, too; they open them themselves, some MB of files a task. Others are read by Spark, which lists
    each by a task of its own and reads only a few a task.
    """
    if not paths:
        return spark.createDataFrame([], FILES)
    if any("://" in p for p in paths):
        uri = lambda p: p if "://" in p else "file:" + p
        known = spark.createDataFrame([(uri(p), n, k) for k, (p, n) in enumerate(zip(paths, names))], "path string, container string, container_ord int")
        files = spark.read.format("binaryFile").load([uri(p) for p in dict.fromkeys(paths)]).select("path", "content")
        return files.join(F.broadcast(known), "path")  # a row for each input path, which the driver lists anyway
    rows, size = [], 0
    for k, (p, n) in enumerate(zip(paths, names)):
        rows.append((os.path.abspath(p), n, k, size // TASK_BYTES))
        size += os.path.getsize(p) + 4096
    listed = spark.createDataFrame(rows, "path string, container string, container_ord int, task int").repartitionById(rows[-1][3] + 1, "task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, n, k in zip(*(batch.column(c).to_pylist() for c in ("path", "container", "container_ord"))):
                with open(p, "rb") as f:
                    content = f.read()
                yield pa.RecordBatch.from_pydict({"path": ["file:" + p], "content": pa.array([content], pa.binary()), "container": [n], "container_ord": pa.array([k], pa.int32())})

    return listed.mapInArrow(run, FILES)


def list_slots(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Slot metadata without payloads; nothing is inflated."""
    from moraine.operators.inputs import unique_names

    rows = scan_files(read_files(spark, paths, unique_names(paths)), payloads=False).where("kind = 'slot'")
    return rows.select("container", "slot_ord", *(f.split()[0] for f in SLOT_FIELDS.replace("\n", " ").split(", ")[:11]))


def prefix_lengths(files: DataFrame) -> DataFrame:
    """container, prefix_length of files: how long the launcher before a container is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [prefix_length(x.as_py()) for x in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("container"), pa.array(found, pa.int64())], names=["container", "prefix_length"])

    return files.select("container", "content").mapInArrow(run, "container string, prefix_length long")
