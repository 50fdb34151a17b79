"""Packs as a Spark data source: format("moraine_pack"), a partition for each frame, the bytes only if they are asked for."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import pack_format as P


def frames(path: str, dialect: P.Dialect) -> Iterator[tuple[int, int, int]]:
    """Offset, length and the first payload's number of each frame of payloads; a version 1 pack is one."""
    with open(path, "rb") as f:
        layout = P.open_layout(f, dialect)
        if layout.version == 1:
            yield layout.header_total, layout.payload_bytes, 0
            return
        at = None
        for n, (_, offset, length, _) in enumerate(P.toc_rows(f, layout, dialect)):
            if offset != at:
                yield layout.header_total + offset, length, n
                at = offset


def payloads_of(path: str, offset: int, length: int, first: int, dialect: P.Dialect) -> Iterator[tuple[int, str, int, bytes]]:
    """ord, h, size, bytes of a frame's payloads."""
    import zstandard

    if not length:
        return
    with open(path, "rb") as f:
        f.seek(offset)
        stream = zstandard.ZstdDecompressor().stream_reader(P.Part(f, length))
        n = first
        while (head := stream.read(41)) and head[0] == dialect.tags[0] and len(head) == 41:
            size = int.from_bytes(head[33:], "little")
            data = stream.read(size)
            if len(data) != size:
                raise P.PackError("cut payload")
            yield n, head[1:33].hex(), size, data
            n += 1


class FramePartition(InputPartition):
    def __init__(self, offset: int, length: int, first: int):
        self.offset, self.length, self.first = offset, length, first


class PackReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        d = P.MORAINE
        get = lambda name: bytes.fromhex(options.get(name, getattr(d, name).hex()))
        self.dialect = P.Dialect(magic=get("magic"), toc_magic=get("toc_magic"), trailer_magic=get("trailer_magic"), format=options.get("pack_format", d.format))

    def partitions(self) -> list[InputPartition]:
        return [FramePartition(*place) for place in frames(self.path, self.dialect)] or [FramePartition(0, 0, 0)]

    def read(self, partition: FramePartition) -> Iterator[tuple]:
        return payloads_of(self.path, partition.offset, partition.length, partition.first, self.dialect)


class PackSource(DataSource):
    """Options: path; magic, toc_magic, trailer_magic (hex) and pack_format for another dialect."""

    @classmethod
    def name(cls) -> str:
        return "moraine_pack"

    def schema(self) -> str:
        return "ord long, h string, size long, bytes binary"

    def reader(self, schema) -> DataSourceReader:
        return PackReader(dict(self.options))
