"""Packing documents into token sequences along a space-filling curve.

A document's vector counts its hashed byte pairs (A-Z lower-cased); fixed random directions project it to three
dimensions, whose ranks under the normal curve are cut into 2**10 cells; the cell's place on the Hilbert curve is the
document's key. Documents are range-sorted by (key, hash of the id), so that equal texts, which share a key, still deal
out evenly; each partition is cut into sequences in that order, so neighbours along the curve fill the same sequences.

A document's ids are those of the tokenizer (special tokens not added) and then the end id. Documents are cut wherever
a sequence is full; only the rest of a partition is not a whole sequence, and it is split into sequences whose lengths are
powers of two, which need no padding. Every id lies in exactly one piece.

Null texts are empty and hold only the end id. Rows with null or repeated ids are packed like others, ties in the order
of their texts; rows that are equal in both lie side by side. A very long text is tokenized whole: some 20 bytes of memory for each of its bytes.
An empty table gives an empty result. Columns of the input other than doc_id and text are not carried.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import partitions, widened
from .words import BASE, LOWER, U, Texts, chunks

DIMENSIONS, CELL_BITS, PAIRS = 3, 10, 1 << 12
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Letters that the fast pattern knows: ASCII and Latin-1. Texts with other characters go the general way.
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
LATIN_ONLY = re.compile(f"[\x00-\x1b -\x7e{LATIN}]*")
LATIN_PIECES = re.compile(rf" ?[{LATIN}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+")


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with integer coordinates (rows of cells), by Skilling's transform."""
    x = [cells[:, k].astype(np.int64) for k in range(cells.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for k in range(n):
            swap = (x[0] ^ x[k]) & (q - 1)
            high = (x[k] & q) != 0
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ swap)
            if k:
                x[k] = np.where(high, x[k], x[k] ^ swap)
        q >>= 1
    for k in range(1, n):
        x[k] = x[k] ^ x[k - 1]
    last, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        last = np.where((x[n - 1] & q) != 0, last ^ (q - 1), last)
        q >>= 1
    x = [v ^ last for v in x]
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for k in range(n):
            place = (place << 1) | ((x[k] >> b) & 1)
    return place


def curve_keys(texts: Texts, directions: np.ndarray) -> np.ndarray:
    folded = LOWER[texts.data].astype(np.uint16)
    pair = np.zeros(len(folded), np.int64)
    if len(folded) > 1:
        pair[1:] = ((folded[:-1].astype(U) * U(257) + folded[1:]) * U(BASE)) >> U(64 - 12)
    projected = np.zeros((texts.n, DIMENSIONS))
    for k in range(texts.n):
        if (n := texts.at[k + 1] - texts.at[k]) > 1:
            count = np.bincount(pair[texts.at[k] + 1 : texts.at[k + 1]], minlength=PAIRS)
            projected[k] = directions @ (count / np.sqrt((count * count).sum()))
    top = (1 << CELL_BITS) - 1
    return hilbert(np.clip(((1 / (1 + np.exp(-1.7 * projected))) * (top + 1)).astype(np.int64), 0, top), CELL_BITS)


def with_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text and curve_key."""
    docs = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = np.random.default_rng(11).standard_normal((DIMENSIONS, PAIRS))
        for batch in chunks(batches):
            key = curve_keys(Texts(batch.column("text")), directions)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key, pa.int64())], names=["doc_id", "text", "curve_key"])

    return docs.mapInArrow(run, widened(docs, "curve_key long"))


def json_encoder(path: str) -> Callable[[str], bytes]:
    """Little-endian 32-bit ids of a text, by a tokenizers JSON file."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    return lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def rank_encoder(path: str, pattern: str, special: str, other: Callable[[str], bytes], room: int = 400_000) -> Callable[[str], bytes]:
    """The same ids from the vocabulary's rank file: pre-tokens of Latin texts are looked up in a table of at most room entries.

    Texts with the special token's string, or with characters beyond Latin-1, go through other().
    """
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    class Known(dict):
        def __missing__(self, piece: str) -> bytes:
            ids = encode(piece.encode())
            out = struct.pack(f"<{len(ids)}I", *ids)
            if len(self) >= room:
                self.clear()
            self[piece] = out
            return out

    look_up = Known().__getitem__
    find = LATIN_PIECES.findall

    def run(text: str) -> bytes:
        if LATIN_ONLY.fullmatch(text) is None or special in text:
            return other(text)
        return b"".join(map(look_up, find(text)))

    return run


def default_encoder() -> Callable[[str], bytes]:
    import public_tokenizers

    other = json_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    return rank_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "<|endoftext|>", other)


def cut(documents: Iterator[tuple[int | None, bytes]], size: int, partition: int) -> Iterator[tuple]:
    """Pieces of (doc_id, ids) in order; the last, partial sequence is split by powers of two."""
    sequence, offset = partition << 36, 0
    waiting: list[tuple] = []  # the pieces of the open sequence: (doc_id, start, ids, doc_tokens)
    for doc, ids in documents:
        total, start = len(ids) // 4, 0
        while start < total:
            take = min(total - start, size - offset)
            waiting.append((doc, start, ids[4 * start : 4 * (start + take)], total))
            offset, start = offset + take, start + take
            if offset == size:
                place = 0
                for d, s, part, n in waiting:
                    yield d, s, len(part) // 4, zlib.crc32(part), n, sequence, place
                    place += len(part) // 4
                waiting, offset, sequence = [], 0, sequence + 1
    room, place = 1 << max(0, offset.bit_length() - 1), 0
    left = offset
    for d, s, part, n in waiting:
        while part:
            take = min(len(part) // 4, room - place)
            yield d, s, take, zlib.crc32(part[: 4 * take]), n, sequence, place
            s, part, place, left = s + take, part[4 * take :], place + take, left - take
            if place == room:
                sequence, place, room = sequence + 1, 0, 1 << max(0, left.bit_length() - 1)


def pack(docs: DataFrame, size: int = 2048, end_id: int = 1, encoder: Callable[[], Callable[[str], bytes]] = default_encoder) -> DataFrame:
    """Pieces of sequences of at most size ids. encoder() is called once in each task."""
    keyed = with_keys(docs).withColumn("tie", F.xxhash64(F.lit("curve"), "doc_id"))
    n = partitions(docs.sparkSession)
    ordered = keyed.repartitionByRange(n, "curve_key", "tie").sortWithinPartitions("curve_key", "tie", "doc_id", "text")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder()

        def documents() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                    yield doc, encode(text.as_py() or "") + end

        rows: list[tuple] = []
        names = [x.split()[0] for x in PIECES.split(", ")]

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=names)

        for row in cut(documents(), size, TaskContext.get().partitionId()):
            rows.append(row)
            if len(rows) == 5000:
                yield table()
                rows = []
        if rows:
            yield table()

    return ordered.select("doc_id", "text").mapInArrow(run, PIECES)
