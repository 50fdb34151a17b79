"""Language-model scores by Katz backoff: n-grams of `order` words, then shorter ones, then one unknown word.

Tokens are the words of a text (A-Z lower-cased) and one end for each text; before a text lie starts. Counts r up to 5 are
discounted by Good-Turing for each order, d_r = (r* / r - A) / (1 - A) with r* = (r + 1) n_{r+1} / n_r and A = 6 n_6 / n_1;
where that leaves (0, 1), by an absolute discount n_1 / (n_1 + 2 n_2). Larger counts lose as much as a count of 5 does,
so no history is left without mass. An n-gram is in the model if its count is least[n - 1] or more: the usual cut-off, one occurrence for orders from 3 on,
gives all mass of n-grams seen once to shorter ones. P(w | h) is d c(h,w) / c(h) if (h,w) is in the model, else alpha(h) P(w | shorter h), where alpha(h)
makes the sum over all words and the unknown word exactly one (1, if no (h,w) is in the model); P(w) is d c(w) / N, and the unknown word gets what all
discounts leave. `Scorer.value` is this definition, order by order.

How it is spread out: a chunk of texts is a row with its distinct words (sorted 64-bit hashes) and its tokens as places
among them (table `chunks`, bucketed by chunk). For each order, every chunk counts its n-grams and sends sorted keys, compressed,
to buckets by key range; a bucket adds up and answers each chunk with the totals of its keys, and says which chunk is to
account for an n-gram. An n-gram is only sent if both its shorter parts are frequent enough for it to be in the model; what isn't sent was seen once
and is counted as such. Then chunks send what the n-grams that they account for take from their histories' mass, and ask for the backoff weights of
histories that they back off from; buckets by history key add up and answer. With all answers a chunk scores its texts. A frequent word or n-gram is one key in a
chunk, however often it occurs, and a frequent history's n-grams lie in all buckets; all counts cover all training texts; only counts of counts come to the
driver. There are as many buckets as keep KEYS keys in each, so a task's memory (about 100 MB) doesn't grow with the data.

Tables. What buckets add up are the model's tables, a row for each order and bucket (key range): n-grams with their counts, and histories with the mass that
their n-grams take. With `tables` they are kept in a folder, partitioned by order, and `scores_from` scores other texts from them by the same exchange.

Null text is empty and holds only the end. Null and repeated ids are rows like others (a null id is in training: its
remainder is that of the empty text, 0). Without training rows all words are unknown with probability 1, and scores are 0. An empty table gives an
empty result. A very long text is one chunk of its own: about 150 bytes of memory a word. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import discard, free_shuffles, partitions, stored
from .words import U, Texts, chunks, mix

CHUNK_BYTES, CHUNK_ROWS = 8_000_000, 1 << 19
ORDER, LEAST, TOP = 3, (1, 1, 2), 5
#: Keys of a bucket, about; and the fewest for which a bucket is made.
KEYS, FEW_KEYS = 2_000_000, 50_000
END, START = (U(x) for x in mix(np.array([11, 12], U)))
CHUNKS = "chunk long, size long, vocabulary binary, tokens binary, doc_ids array<long>, lengths array<int>, training array<boolean>"
#: What chunks send: keys with counts, or keys of histories with what is taken and covered; a request for weights has keys alone.
SENT = "kind int, bucket int, chunk long, keys binary, a binary, b binary"
#: Answers to chunks; rows of a null chunk are the tables, with counts of counts, keys in the model and the sum of all counts.
ANSWERS = "chunk long, kind int, bucket int, keys binary, a binary, b binary, counted array<long>"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def squeeze(x: np.ndarray) -> bytes:
    """Numbers as compressed bytes: all first bytes, then all second bytes, and so on."""
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, len(raw) // width).T).view(kind).ravel()


def press(x: np.ndarray) -> bytes:
    """Doubles, many of which are equal, as compressed bytes."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x, np.float64).tobytes())


def unpress(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.float64)


def squeeze_sorted(x: np.ndarray) -> bytes:
    return squeeze(np.diff(x, prepend=U(0)))


def unsqueeze_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data, U), dtype=U)


def in_training(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 != 2


def as_chunks(docs: DataFrame, trains: bool = True) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size, rows = TaskContext.get().partitionId() << 40, [], 0, 0

        def row() -> pa.RecordBatch:
            words = np.concatenate([w for w, _, _ in held])
            vocabulary, tokens = np.unique(words, return_inverse=True)
            lengths = np.concatenate([n for _, n, _ in held])
            ids = [x for _, _, d in held for x in d]
            training = [trains and in_training(x) for x in ids]
            values = [[number], [len(words)], [squeeze_sorted(vocabulary)], [squeeze(tokens.astype(np.uint32))], pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), [training]]
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in values], names=[x.split()[0] for x in CHUNKS.split(", ")])

        for batch in chunks(batches):
            texts = Texts(batch.column("text"))
            stop = np.cumsum(texts.per_doc)
            words = np.insert(texts.word_hashes(lower=True), stop, END)
            held.append((words, texts.per_doc + 1, batch.column("doc_id").to_pylist()))
            size, rows = size + len(texts.data), rows + texts.n
            if size >= CHUNK_BYTES or rows >= CHUNK_ROWS:
                yield row()
                number, held, size, rows = number + 1, [], 0, 0
        if held:
            yield row()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, CHUNKS)


def discounts(n: list[int]) -> np.ndarray:
    """d_0 (unused) to d_5, from the numbers n of keys seen once, twice, ... six times."""
    r = np.arange(1, TOP + 1)
    n = np.array(n[: TOP + 1], float)
    if (n > 0).all():
        a = (TOP + 1) * n[TOP] / n[0]
        d = ((r + 1) * n[1:] / (r * n[:-1]) - a) / (1 - a) if a < 1 else np.zeros(TOP)
        if ((d > 0) & (d < 1)).all():
            return np.r_[0.0, d]
    amount = min(0.9, max(0.1, n[0] / (n[0] + 2 * n[1]))) if n[0] else 0.5
    return np.r_[0.0, 1 - amount / r]


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d_c * c for every count."""
    small = np.minimum(counts, TOP).astype(np.int64)
    return np.where(counts <= TOP, d[small] * counts, counts - TOP * (1 - d[TOP]))


def edges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where the 2**bits equal ranges of keys begin and end in sorted keys."""
    starts = np.arange(1 << bits, dtype=U) << U(64 - bits) if bits else np.zeros(1, U)
    return np.r_[np.searchsorted(keys, starts), len(keys)]


def sent(kind: int, chunk: int, keys: np.ndarray, a: np.ndarray | None, b: np.ndarray | None, bits: int) -> Iterator[pa.RecordBatch]:
    """SENT for sorted keys and their values, by bucket."""
    at = edges(keys, bits)
    some = np.flatnonzero(np.diff(at))
    if not len(some):
        return
    cut = lambda x, pack: pa.array([None if x is None else pack(x[at[k] : at[k + 1]]) for k in some], pa.binary())
    pack = lambda x: squeeze if x is not None and x.dtype == np.uint32 else press
    n = len(some)
    yield pa.RecordBatch.from_arrays(
        [pa.array([kind] * n, pa.int32()), pa.array(some, pa.int32()), pa.array([chunk] * n, pa.int64()), cut(keys, squeeze_sorted), cut(a, pack(a)), cut(b, pack(b))], names=[x.split()[0] for x in SENT.split(", ")]
    )


class Chunk:
    """A row of `chunks`, unpacked, and the answers that it has so far.

    For every order n: keys[n], sorted, of its n-grams that were sent; place[n], where each token's is among them (-1: not sent); total[n], their counts;
    owned[n], whether this chunk accounts for them; shared[n], whether other chunks have them too.
    """

    def __init__(self, row: dict, answers: list[dict], facts: "Facts", done: int):
        """done: the highest order whose answers are there."""
        self.number, self.facts = row["chunk"], facts
        self.vocabulary = unsqueeze_sorted(row["vocabulary"])
        self.tokens = unsqueeze(row["tokens"], np.uint32).astype(np.int64)
        self.doc_ids, self.training, lengths = row["doc_ids"], np.array(row["training"], bool), np.array(row["lengths"], np.int64)
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        self.at = np.r_[0, np.cumsum(lengths)]
        self.in_training = self.training[self.doc]
        self.keys, self.place, self.total, self.owned, self.shared = {1: self.vocabulary}, {1: self.tokens}, {}, {}, {}
        #: The n-gram that ends at each token, whether or not it was sent.
        self.gram = {1: self.vocabulary[self.tokens]}
        self.answers = sorted(answers, key=lambda r: (r["kind"], r["bucket"]))
        for n in range(1, facts.order + 1):
            if n == 2 or n > 2 and n - 1 in self.total:
                self._grams(n)
            if n > done or n not in self.keys:
                continue
            own = [r for r in self.answers if r["kind"] == n]
            totals = [unsqueeze(r["a"], np.uint32).astype(np.int64) for r in own]
            self.total[n] = np.concatenate([np.zeros(0, np.int64), *totals])
            bits = [np.unpackbits(np.frombuffer(r["b"], np.uint8)).reshape(2, -1)[:, : len(x)] for r, x in zip(own, totals)]
            self.owned[n], self.shared[n] = np.concatenate([np.zeros((2, 0), np.uint8), *bits], axis=1).astype(bool)

    def behind(self, values: np.ndarray, first) -> np.ndarray:
        """The value of the token before; first at the beginning of a text."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.at[:-1]] = first
        return out

    def _grams(self, n: int) -> None:
        self.gram[n] = mix(mix(self.history(n)) + self.gram[1])
        if n not in self.facts.pruned:
            self.keys[n], self.place[n] = np.unique(self.gram[n], return_inverse=True)
            return
        # An n-gram is no more frequent than its first and its last n - 1 words.
        least = self.facts.least[n - 1]
        may = (self.counts(n - 1) >= least) & (self.history_counts(n) >= least)
        self.place[n] = np.full(len(self.tokens), -1)
        self.keys[n], self.place[n][may] = np.unique(self.gram[n][may], return_inverse=True)

    def counts(self, n: int) -> np.ndarray:
        """How often each token's n-gram is in training texts, as far as it was sent."""
        place = self.place[n]
        if not len(self.total[n]):
            return np.zeros(len(place), np.int64)
        return np.where(place >= 0, self.total[n][place], 0)

    def history_counts(self, n: int) -> np.ndarray:
        return self.behind(self.counts(n - 1), self.facts.starts)

    def history(self, n: int) -> np.ndarray:
        """The key of each token's n - 1 words before."""
        start = np.array([START])
        for _ in range(n - 2):
            start = mix(mix(start) + START)
        return self.behind(self.gram[n - 1], start[0])

    def own_counts(self, n: int) -> np.ndarray:
        """Of the keys that are sent, how often each is in this chunk's training texts."""
        held = self.place[n] >= 0
        return np.bincount(self.place[n][held], self.in_training[held].astype(float), len(self.keys[n])).astype(np.uint32)

    def unsent(self, n: int) -> int:
        """N-grams of training texts that weren't sent: each was seen once."""
        return int(((self.place[n] < 0) & self.in_training).sum())


class Facts:
    """What every task knows of the model: a few numbers for each order."""

    def __init__(self, order: int, least: tuple[int, ...], bits: int, starts: int):
        self.order, self.least, self.bits, self.starts = order, tuple(least), bits, starts
        #: Orders whose n-grams are sent only if they can be frequent enough.
        self.pruned = {n for n in range(3, order + 1) if self.least[n - 1] > 1}
        self.counted: dict[int, list[int]] = {}
        self.ready()

    def ready(self) -> None:
        self.discount = {n: discounts(c) for n, c in self.counted.items()}
        words = self.counted.get(1) or [0] * (TOP + 3)
        self.known, self.tokens = words[TOP + 1], words[TOP + 2]
        d = self.discount.get(1, discounts([0] * (TOP + 1)))
        # What the unigrams' discounts leave: for counts over TOP, TOP * (1 - d_TOP) each.
        left = sum(words[r - 1] * r * (1 - d[r]) for r in range(1, TOP + 1)) + (self.known - sum(words[:TOP])) * TOP * (1 - d[TOP])
        self.unknown = left / self.tokens if self.tokens else 1.0


class Scorer:
    """The model's definition for all tokens of a chunk at once."""

    def __init__(self, chunk: Chunk):
        self.c, self.f = chunk, chunk.facts

    def in_model(self, n: int) -> np.ndarray:
        return self.c.counts(n) >= (self.f.least[n - 1] if n > 1 else 1)

    def seen(self, n: int) -> np.ndarray:
        """P(w | n - 1 words before) where the n-gram is in the model, else 0; for n = 1 with the unknown word."""
        counts, inside = self.c.counts(n), self.in_model(n)
        if n == 1:
            return np.where(inside, discounted(counts, self.f.discount[1]) / max(1, self.f.tokens), self.f.unknown)
        return np.where(inside, discounted(counts, self.f.discount[n]) / np.maximum(1, self.c.history_counts(n)), 0.0)

    def backs_off(self, n: int) -> np.ndarray:
        """Whether a token needs the backoff weight of its n - 1 words before."""
        out = ~self.in_model(n) & (self.c.history_counts(n) >= self.f.least[n - 1])
        return out & ~self.in_model(n + 1) if n < self.f.order else out

    @cached_property
    def weights(self) -> dict[int, np.ndarray]:
        """log10 of the backoff weight for each token that backs off, by order."""
        out = {}
        for n in range(2, self.f.order + 1):
            out[n] = np.zeros(len(self.c.tokens))
            some = self.backs_off(n)
            own = [unpress(r["a"]) for r in self.c.answers if r["kind"] == self.f.order + n]
            if some.any() and own:
                _, place = np.unique(self.c.history(n)[some], return_inverse=True)
                out[n][some] = np.concatenate(own)[place]
        return out

    def value(self, n: int) -> np.ndarray:
        """log10 P(w | n - 1 words before) of every token."""
        with np.errstate(divide="ignore"):
            inside = np.log10(self.seen(n))
        if n == 1:
            return inside
        return np.where(self.in_model(n), inside, self.weights[n] + self.value(n - 1))

    def asks(self, n: int) -> np.ndarray:
        """Sorted histories whose backoff weights the chunk needs."""
        return np.unique(self.c.history(n)[self.backs_off(n)])

    def masses(self, n: int, every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted histories of the n-grams that this chunk accounts for, what those take of their mass, and what they cover of the shorter history's.

        Unless every is set, without those that only this chunk has and doesn't ask for.
        """
        c = self.c
        first = np.full(len(c.keys[n]), -1)
        held = np.flatnonzero(c.place[n] >= 0)
        first[c.place[n][held[::-1]]] = held[::-1]
        mine = first[c.owned[n] & (c.total[n] >= self.f.least[n - 1])]
        if not every:
            held = c.place[n - 1] >= 0
            among = np.zeros(len(held), bool)
            among[held] = c.shared[n - 1][c.place[n - 1][held]]
            needed = c.behind(among, True)[mine]
            alone = np.flatnonzero(~needed)
            needed[alone] = np.isin(c.history(n)[mine[alone]], self.asks(n))
            mine = mine[needed]
        histories, place = np.unique(c.history(n)[mine], return_inverse=True)
        add = lambda x: np.bincount(place, x[mine], len(histories))
        return histories, add(self.seen(n)), add(self.seen(n - 1))


def as_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def by_bucket(rows: Iterator[dict]) -> Iterator[list[dict]]:
    held: list[dict] = []
    for r in rows:
        if held and (r["kind"], r["bucket"]) != (held[0]["kind"], held[0]["bucket"]):
            yield held
            held = []
        held.append(r)
    if held:
        yield held


def answered(held: list[dict], parts: list[tuple[int | None, bytes | None, bytes | None, bytes | None, list[int] | None]]) -> pa.RecordBatch:
    chunk, keys, a, b, counted = zip(*parts)
    n = len(parts)
    arrays = [pa.array(chunk, pa.int64()), pa.array([held[0]["kind"]] * n, pa.int32()), pa.array([held[0]["bucket"]] * n, pa.int32()), *(pa.array(x, pa.binary()) for x in (keys, a, b)), pa.array(counted, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in ANSWERS.split(", ")])


def add_counts(least: tuple[int, ...], keep: bool):
    """Answers of buckets of counts. A row of a null chunk is a table's: its counts count, and get no answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_bucket(as_rows(batches)):
            keys = [unsqueeze_sorted(r["keys"]) for r in held]
            counts = np.concatenate([unsqueeze(r["a"], np.uint32) for r in held]).astype(np.int64)
            flat = np.concatenate(keys)
            distinct, place = np.unique(flat, return_inverse=True)
            sums = np.bincount(place, counts, len(distinct)).astype(np.int64)
            # The first blob with the key in training accounts for it.
            owner = np.full(len(distinct), len(flat))
            own = np.flatnonzero(counts > 0)
            np.minimum.at(owner, place[own], own)
            owned = np.zeros(len(flat), bool)
            owned[owner[owner < len(flat)]] = True
            shared = np.bincount(place, minlength=len(distinct))[place] > 1
            seen = sums[sums > 0]
            stats = [*(int((seen == r).sum()) for r in range(1, TOP + 2)), len(seen), int(seen.sum())]
            at = np.r_[0, np.cumsum([len(k) for k in keys])]
            inside = sums >= least[held[0]["kind"] - 1]
            table = (None, squeeze_sorted(distinct[inside]), squeeze(sums[inside].astype(np.uint32)), None, stats) if keep else (None, None, None, None, stats)
            answers = sums[place].astype(np.uint32)
            yield answered(held, [*((r["chunk"], None, squeeze(answers[x:y]), np.packbits([owned[x:y], shared[x:y]], axis=1).tobytes(), None) for r, x, y in zip(held, at, at[1:]) if r["chunk"] is not None), table])

    return run


def add_masses(keep: bool):
    """Answers of buckets of histories: log10 of backoff weights, 0 where no n-gram of the history is in the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_bucket(as_rows(batches)):
            given = [r for r in held if r["a"] is not None]
            flat = np.concatenate([np.zeros(0, U), *(unsqueeze_sorted(r["keys"]) for r in given)])
            histories, place = np.unique(flat, return_inverse=True)
            add = lambda c: np.bincount(place, np.concatenate([np.zeros(0), *(unpress(r[c]) for r in given)]), len(histories))
            taken, covered = add("a"), add("b")
            tiny = 1e-300
            weight = np.log10(np.maximum(1 - taken, tiny) / np.maximum(1 - covered, tiny))
            parts = []
            for r in held:
                if r["a"] is None:
                    keys = unsqueeze_sorted(r["keys"])
                    at = np.minimum(np.searchsorted(histories, keys), max(0, len(histories) - 1))
                    found = histories[at] == keys if len(histories) else np.zeros(len(keys), bool)
                    parts.append((r["chunk"], None, press(np.where(found, weight[at] if len(histories) else 0.0, 0.0)), None, None))
            if keep and len(histories):
                parts.append((None, squeeze_sorted(histories), press(taken), press(covered), None))
            if parts:
                yield answered(held, parts)

    return run


class Exchange:
    """Chunks of texts, and the answers that they have so far."""

    def __init__(self, docs: DataFrame, facts: Facts | None, order: int, least: tuple[int, ...], known: DataFrame | None = None, keep: bool = False):
        """known: rows of tables (kind, bucket, keys, a, b) that take part in every exchange."""
        self.spark, self.known, self.keep = docs.sparkSession, known, keep
        self.n = partitions(self.spark)
        self.name = f"moraine_chunks_{uuid.uuid4().hex}"
        as_chunks(docs, facts is None).write.bucketBy(self.n, "chunk").saveAsTable(self.name)
        self.table = self.spark.table(self.name)
        if facts is None:
            trained = F.size(F.filter("training", lambda x: x)).cast("long")
            size, starts = self.table.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(trained), F.lit(0))).first()
            facts = Facts(order, least, max(0, int(np.ceil(np.log2(max(1, size / KEYS, min(2 * self.n, size / FEW_KEYS)))))), starts)
        self.facts, self.answers, self.done = facts, [], 0

    def _ask(self, kinds: list[int], send, answer, label: str) -> DataFrame:
        """send(chunk): what it sends, by kind; with the tables' rows, answered by bucket."""
        facts, done = self.facts, self.done

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            parts = [SENT_ROWS.empty_table()]
            if left.num_rows:
                parts += [pa.Table.from_batches([b]).cast(SENT_ROWS) for b in send(Chunk(left.to_pylist()[0], right.to_pylist(), facts, done))]
            return pa.concat_tables(parts)

        blobs = self.table.groupBy("chunk").cogroup(self._held().groupBy("chunk")).applyInArrow(run, SENT)
        if self.known is not None:
            blobs = blobs.unionByName(self.known.where(F.col("kind").isin(kinds)).withColumn("chunk", F.lit(None).cast("long")))
        dealt = blobs.repartition(self.n, "kind", "bucket").sortWithinPartitions("kind", "bucket", F.asc_nulls_first("chunk"))
        out = stored(dealt.mapInArrow(answer, ANSWERS), label)
        self.answers.append(out)
        del blobs, dealt
        free_shuffles(self.spark)
        return out

    def _held(self) -> DataFrame:
        if not self.answers:
            return self.spark.createDataFrame([], ANSWERS)
        out = self.answers[0]
        for a in self.answers[1:]:
            out = out.union(a)
        return out.where("chunk is not null")

    def count(self, kinds: list[int], learn: bool) -> None:
        """Totals of the n-grams of these orders."""
        bits, facts = self.facts.bits, self.facts

        def send(c: Chunk) -> Iterator[pa.RecordBatch]:
            for n in kinds:
                yield from sent(n, c.number, c.keys[n], c.own_counts(n), None, bits)
                if learn and (once := c.unsent(n)):
                    yield pa.RecordBatch.from_pydict({"kind": [-n], "bucket": [0], "chunk": [c.number], "keys": [squeeze_sorted(np.zeros(1, U))], "a": [squeeze(np.array([once], np.uint64))], "b": [None]})

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            once: dict[int, int] = {}

            def others() -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for r in as_rows([batch.filter(pc.less(batch.column("kind"), 0))]):
                        once[r["kind"]] = once.get(r["kind"], 0) + int(unsqueeze(r["a"], np.uint64)[0])
                    yield batch.filter(pc.greater(batch.column("kind"), 0))

            yield from add_counts(facts.least, self_keep)(others())
            for kind, n in once.items():
                yield answered([{"kind": -kind, "bucket": -1}], [(None, None, None, None, [n, *([0] * TOP), n, n])])

        self_keep = self.keep
        out = self._ask(kinds, send, answer, f"counts-{max(kinds)}")
        self.done = max(kinds)
        if learn:
            found = out.where("chunk is null").groupBy("kind").agg(F.array(*(F.sum(F.col("counted")[k]) for k in range(TOP + 3))).alias("s")).collect()
            facts.counted |= {n: [0] * (TOP + 3) for n in kinds} | {r["kind"]: [int(x) for x in r["s"]] for r in found}
            facts.ready()

    def weigh(self, learn: bool) -> None:
        """Backoff weights of the histories that chunks back off from. Kinds are order + n."""
        facts, every = self.facts, self.keep

        def send(c: Chunk) -> Iterator[pa.RecordBatch]:
            s = Scorer(c)
            for n in range(2, facts.order + 1):
                if learn:
                    yield from sent(facts.order + n, c.number, *s.masses(n, every), facts.bits)
                yield from sent(facts.order + n, c.number, s.asks(n), None, None, facts.bits)

        self._ask(list(range(facts.order + 2, 2 * facts.order + 1)), send, add_masses(self.keep), "weights")

    def score(self) -> DataFrame:
        facts = self.facts

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return SCORE_ROWS.empty_table()
            c = Chunk(left.to_pylist()[0], right.to_pylist(), facts, facts.order)
            counts = c.counts(1)
            sums = lambda x: np.add.reduceat(x, c.at[:-1])
            base = np.log10((counts + 1) / (facts.tokens + facts.known + 1))
            n = len(c.doc_ids)
            columns = [pa.array(c.doc_ids, pa.int64()), pa.array([not in_training(x) for x in c.doc_ids]), np.diff(c.at), sums((counts > 0).astype(np.int64)), np.full(n, facts.tokens), sums(base), sums(Scorer(c).value(facts.order))]
            return pa.table([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], schema=SCORE_ROWS)

        return self.table.groupBy("chunk").cogroup(self._held().groupBy("chunk")).applyInArrow(run, SCORES)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        discard(*self.answers)


def _arrow(ddl: str) -> pa.Schema:
    """A schema text of the simple types above as Arrow's."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


SENT_ROWS, SCORE_ROWS = _arrow(SENT), _arrow(SCORES)


def _steps(order: int) -> list[list[int]]:
    """Orders that are counted in one exchange: nothing is known yet that would spare words or pairs."""
    return [[1, 2][:order], *([n] for n in range(3, order + 1))]


def scores(docs: DataFrame, order: int = ORDER, least: tuple[int, ...] = LEAST, tables: str | None = None) -> DataFrame:
    """SCORES, a row for each row of docs. least: the counts from which n-grams of each order are in the model, never falling. tables: a folder in which the model's tables are kept."""
    least = tuple(least)[:order]
    if len(least) < order or list(least) != sorted(least) or least[0] != 1:
        raise ValueError("least is a count for each order, 1 for words, and never falls")
    x = Exchange(docs, None, order, least, keep=tables is not None)
    for kinds in _steps(order):
        x.count(kinds, learn=True)
    x.weigh(learn=True)
    out = stored(x.score(), "scores")
    if tables is not None:
        every = x.answers[0]
        for a in x.answers[1:]:
            every = every.union(a)
        every.where("chunk is null and keys is not null").select("kind", "bucket", "keys", "a", "b").write.partitionBy("kind").mode("overwrite").parquet(f"{tables}/ngrams")
        facts = {"order": order, "least": least, "bits": x.facts.bits, "starts": x.facts.starts, "counted": {str(n): c for n, c in x.facts.counted.items()}}
        x.spark.createDataFrame([(json.dumps(facts),)], "facts string").coalesce(1).write.mode("overwrite").parquet(f"{tables}/facts")
    x.close()
    return out


def scores_from(docs: DataFrame, tables: str) -> DataFrame:
    """SCORES of docs by the model in a folder of tables; nothing is learned from docs."""
    spark: SparkSession = docs.sparkSession
    told = json.loads(spark.read.parquet(f"{tables}/facts").first()["facts"])
    facts = Facts(told["order"], tuple(told["least"]), told["bits"], told["starts"])
    facts.counted = {int(n): c for n, c in told["counted"].items()}
    facts.ready()
    known = spark.read.schema("bucket int, keys binary, a binary, b binary, kind int").parquet(f"{tables}/ngrams")
    x = Exchange(docs, facts, facts.order, facts.least, known)
    for kinds in _steps(facts.order):
        x.count(kinds, learn=False)
    x.weigh(learn=False)
    out = stored(x.score(), "scores")
    x.close()
    return out
