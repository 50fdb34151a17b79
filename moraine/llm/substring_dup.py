"""Substring dedup: windows of words and paragraphs by MinHash, verified exactly.

Windows. Every run of `least_run` words that occurs at two places is found, wherever it lies and however its lines are
broken; what lies side by side at both places is one stretch, so a stretch ends where the words differ. Windows
aren't compared all with all: a window's anchor is the MinHash (the smallest hash) of the ANCHOR-word shingles in it, a band of
one row, so equal windows always collide. About an eighth of all places are anchors; each stands for the few windows in a row of which it is the
least, and its context is a digest of all their words. Anchors that occur once go at once. Equal contexts are a class, however
many places have them (a passage in a third of all documents is a few classes), whose first place is the keeper of the others; only classes
that share an anchor and differ in context are compared window by window, by one member each, where the first of equal windows is the keeper. So of
equal windows the first place is kept, and a keeper is an equal place before. Words are compared with A-Z lower-cased.

Paragraphs (lines of 8 words or more) of equal content are found by a 128-bit digest. Paragraphs of unequal content become
candidates by MinHash: each of `bands` keys is made of ROWS smallest permuted 5-word shingle hashes; 7 bands of 2 rows
find a pair of similarity 0.8 with a probability of 0.999. Candidates are confirmed by exact Jaccard similarity of their
shingles, and linked paragraphs are clustered by connected components. Of the paragraphs of a cluster the first (smallest
doc_id, then place) is kept, the others are removed.

Only passages count: repeated units (stretches and paragraphs) of a document that follow each other, with at most five words
between two, make a run, and runs of fewer than `least_run` words (a heading, a common line) are left alone: the one
least length of a passage, for stretches at their true ends.

Null and empty texts have no units; an empty table gives an empty result. Rows with a null id are not compared and stay as
they are. Rows with equal ids are one document; a unit is only removed from the text that it was found in. Repeats inside one
document count too; where a stretch overlaps its own first place (a word over and over), the first `least_run` words stay. Of
equal places by doc_id the smaller word place comes first. A very long text is one batch: about 100 bytes of
memory for each of its words. Columns other than doc_id, text and n_chars are carried, never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import discard, stored
from .linking import connect, semi_join
from .words import U, Texts, chunks, distinct, mix, powers, shingles, signed

SHINGLE, LEAST_WORDS, LEAST_RUN = 5, 8, 24
#: Words that may lie between two units of a run.
BETWEEN = 5
#: MinHash values that are compared before sets are.
SIGNATURE = 128
UNITS = "doc_id long, whole long, start int, n int, h1 long, h2 long"
#: Words of the shingles whose least hash is a window's anchor.
ANCHOR = 8
#: Windows of a row at most.
MOST_WINDOWS = 256
#: Classes of an anchor up to which they are compared in one stream; those of more are compared by shuffling windows.
IN_ONE_STREAM = 100_000
LINES = f"{UNITS}, size long, keys array<long>"
PLACES = "anchor long, context long, doc_id long, whole long, start int, m int, over boolean"
ANCHORS = "doc_id long, whole long, start int, anchor long, context long, lead boolean, runs array<long>"
STRETCHES = "doc_id long, whole long, start int, m int, keeper_doc_id long, keeper_start int, kept boolean, lead boolean"


def tuned_bands(similarity: float, recall: float, rows: int = 1) -> int:
    """The least number of bands of so many rows that finds a pair of this similarity with this probability."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows) - 1e-9))


ROWS = 2
BANDS = tuned_bands(0.8, 0.998, ROWS)


class Cut:
    """The paragraphs of a run of texts. first and last: word places within the run; whole: a hash of each text's words."""

    def __init__(self, column: pa.Array):
        self.texts = texts = Texts(column)
        self.words = words = texts.word_hashes(lower=True)
        n = len(words)
        self.begin = np.cumsum(texts.per_doc) - texts.per_doc
        self.whole = run_hashes(words, self.begin, self.begin + texts.per_doc, 3)
        # A line begins with a document or behind a newline.
        breaks = np.zeros(len(texts.data) + 1, np.int64)
        np.cumsum(texts.data == 10, out=breaks[1:])
        line_start = np.ones(n, bool)
        line_start[1:] = (breaks[texts.start[1:]] != breaks[texts.start[:-1]]) | (texts.doc[1:] != texts.doc[:-1])
        lines = np.flatnonzero(line_start)
        self.line = np.cumsum(line_start) - 1
        self.lines = np.r_[lines, n]
        wide = np.diff(self.lines) >= LEAST_WORDS
        self.first, self.last = lines[wide], self.lines[1:][wide]
        self.doc = texts.doc[self.first]
        self.h1, self.h2 = (run_hashes(words, self.first, self.last, seed) for seed in (1, 2))


def run_hashes(words: np.ndarray, first: np.ndarray, last: np.ndarray, seed: int) -> np.ndarray:
    """A hash of words[first:last] for every run."""
    up, down = powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, U)
    np.cumsum(mix(words + U(seed)) * up[: len(words)], out=sums[1:])
    return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(U))


def lines(docs: DataFrame, bands: int) -> DataFrame:
    """The paragraphs, with the number of their shingles and their band keys: LINES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            c = Cut(batch.column("text"))
            n = len(c.first)
            if not n:
                continue
            values, at, _ = _paragraph_sets(c)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(signed(np.stack(band_keys(values, at, bands, ROWS), axis=1).ravel())))
            ids = batch.column("doc_id").take(pa.array(c.doc, pa.int64()))
            whole, h1, h2 = (pa.array(signed(x)) for x in (c.whole[c.doc], c.h1, c.h2))
            start, length = pa.array(c.first - c.begin[c.doc], pa.int32()), pa.array(c.last - c.first, pa.int32())
            yield pa.RecordBatch.from_arrays([ids, whole, start, length, h1, h2, pa.array(np.diff(at), pa.int64()), keys], names=[x.split()[0] for x in LINES.split(", ")])

    return docs.mapInArrow(run, LINES)


class Anchored:
    """The anchors of a run of texts.

    group: places of the first windows; m: how many windows in a row an anchor stands for; of: their anchors, as hashes;
    over: whether the anchor lies at several places there, so that windows may be equal; context: a digest of all words of the windows; windows: the windows' digests, m of them for each anchor.
    """

    def __init__(self, column: pa.Array, least: int):
        self.texts = texts = Texts(column)
        self.words = words = texts.word_hashes(lower=True)
        self.least, short = least, min(ANCHOR, least)
        n = max(0, len(words) - least + 1)
        self.begin = np.cumsum(texts.per_doc) - texts.per_doc
        self.whole = run_hashes(words, self.begin, self.begin + texts.per_doc, 3)
        at = np.arange(max(0, len(words) - short + 1))
        hashes = run_hashes(words, at, at + short, 1)
        smallest, place = hashes[:n].copy(), at[:n].copy()
        for k in range(1, least - short + 1):
            smaller = hashes[k : k + n] < smallest
            np.copyto(smallest, hashes[k : k + n], where=smaller)
            np.copyto(place, at[k : k + n], where=smaller)
        self.windows = first = np.flatnonzero(texts.doc[:n] == texts.doc[least - 1 :]) if n else at[:0]
        # Windows in a row with one anchor are one row, also where words come over and over and the anchor lies at one place after the other.
        new, moved = np.ones(len(first), bool), np.zeros(len(first), bool)
        new[1:] = (smallest[first[1:]] != smallest[first[:-1]]) | (first[1:] != first[:-1] + 1)
        moved[1:] = (place[first[1:]] != place[first[:-1]]) & ~new[1:]
        since = np.arange(len(first)) - np.maximum.accumulate(np.where(new, np.arange(len(first)), 0))
        self.at = np.flatnonzero(since % MOST_WINDOWS == 0)
        self.over = np.add.reduceat(moved, self.at) > 0 if len(self.at) else np.zeros(0, bool)
        self.m = np.diff(np.r_[self.at, len(first)])
        self.group = first[self.at]
        self.of = smallest[self.group]
        self.context = run_hashes(words, self.group, self.group + self.m + least - 1, 7)
        self.doc = texts.doc[self.group]

    def columns(self, batch: pa.RecordBatch, some: np.ndarray) -> dict[str, pa.Array]:
        doc = self.doc[some]
        out = {"anchor": pa.array(signed(self.of[some])), "context": pa.array(signed(self.context[some])), "doc_id": batch.column("doc_id").take(pa.array(doc, pa.int64()))}
        return out | {"whole": pa.array(signed(self.whole[doc])), "start": pa.array(self.group[some] - self.begin[doc], pa.int32()), "m": pa.array(self.m[some], pa.int32()), "over": pa.array(self.over[some])}


def places(docs: DataFrame, least: int) -> DataFrame:
    """Where the anchors of all windows of least words are: PLACES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            a = Anchored(batch.column("text"), least)
            if len(a.group):
                yield pa.RecordBatch.from_pydict(a.columns(batch, np.arange(len(a.group))))

    return docs.mapInArrow(run, PLACES)


def anchors(docs: DataFrame, least: int) -> DataFrame:
    """Every window of least words, by anchor: ANCHORS, with runs, the digests of the windows at start, start + 1 ...

    If docs has a column `asked`, only anchors of the contexts in it are given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            a = Anchored(batch.column("text"), least)
            some = np.arange(len(a.group))
            if "asked" in batch.schema.names:
                some = np.flatnonzero(np.isin(signed(a.context), batch.column("asked").flatten().to_numpy()))
            if not len(some):
                continue
            windows = run_hashes(a.words, a.windows, a.windows + least, 2)
            m = a.m[some]
            stop = np.cumsum(m)
            inner = np.arange(stop[-1]) - np.repeat(stop - m, m)
            columns = a.columns(batch, some) | {"lead": pa.array(np.ones(len(some), bool))}
            columns["runs"] = pa.ListArray.from_arrays(pa.array(np.r_[0, stop], pa.int32()), pa.array(signed(windows[np.repeat(a.at[some], m) + inner])))
            names = [x.split()[0] for x in ANCHORS.split(", ")]
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return docs.mapInArrow(run, ANCHORS)


def repeated_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """STRETCHES, m runs long each, from batches of ANCHORS in the order of anchor, doc_id, start, whole.

    Of an anchor that goes on in the next batch, only the first places of its runs are held.
    """
    columns = ("anchor", "doc_id", "whole", "start", "lead")
    held, held_run, held_told, before = [np.zeros(0, np.int64)] * 5, np.zeros(0, np.int64), np.zeros(0, bool), None
    for batch in batches:
        if not batch.num_rows:
            continue
        row = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
        anchor, lists = row[0], batch.column("runs")
        # Rows that occur twice.
        keep = np.ones(len(anchor), bool)
        keep[1:] = np.any([x[1:] != x[:-1] for x in row], axis=0)
        keep[0] = before != tuple(x[0] for x in row)
        before = tuple(x[-1] for x in row)
        picked = np.flatnonzero(keep)
        lists = lists.take(pa.array(picked))
        length = lists.value_lengths().to_numpy().astype(np.int64)
        owner = np.repeat(picked, length)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
        row = [np.r_[h, x[owner]] for h, x in zip(held, row)]
        row[3][len(held_run) :] += inner
        anchors_, doc, whole, start, lead = row
        run = np.r_[held_run, lists.flatten().to_numpy()]
        told = np.r_[held_told, np.zeros(len(owner), bool)]
        if not len(run):
            continue
        _, index, group = np.unique(run, return_index=True, return_inverse=True)
        keeper = index[group]
        kept = (doc == doc[keeper]) & (start == start[keeper])
        repeats = np.zeros(len(index), bool)
        repeats[group[~kept]] = True
        repeats[group[told]] = True
        out = np.flatnonzero(repeats[group] & ~told)
        told |= repeats[group]
        goes_on = kept & (anchors_ == anchor[-1])
        held, held_run, held_told = [x[goes_on] for x in row], run[goes_on], told[goes_on]
        if not len(out):
            continue
        ends = [doc[out], whole[out], start[out], doc[keeper[out]], start[keeper[out]], kept[out], lead[out]]
        new = np.ones(len(out), bool)
        new[1:] = np.any([np.diff(x.astype(np.int64)) != step for x, step in zip(ends, (0, 0, 1, 0, 1, 0, 0))], axis=0)
        begin = np.flatnonzero(new)
        d, w, s, kd, ks, k, of_lead = (x[begin] for x in ends)
        m = np.diff(np.r_[begin, len(out)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(d), pa.array(w), pa.array(s, pa.int32()), pa.array(m, pa.int32()), pa.array(kd), pa.array(ks, pa.int32()), pa.array(k), pa.array(of_lead > 0)],
            names=[x.split()[0] for x in STRETCHES.split(", ")],
        )


def windows_by_shuffle(rows: DataFrame) -> DataFrame:
    """What repeated_runs gives, for anchors with more classes than one stream should take: one row a window, pre-aggregated by window."""
    each = rows.select("doc_id", "whole", F.col("start").alias("_at"), "lead", F.posexplode("runs").alias("_j", "run")).withColumn("start", F.col("_at") + F.col("_j"))
    place = F.struct("doc_id", "start", "whole")
    ends = each.groupBy("run").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last")
    kept = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("start") == F.col("first.start"))
    out = each.join(ends, "run").withColumns({"m": F.lit(1), "keeper_doc_id": F.col("first.doc_id"), "keeper_start": F.col("first.start"), "kept": kept})
    return out.select(*(x.split()[0] for x in STRETCHES.split(", ")))


def repeated_windows(docs: DataFrame, least: int, in_one_stream: int = IN_ONE_STREAM) -> DataFrame:
    """Windows that occur at two places, m in a row: doc_id, whole, start, m, keeper_doc_id, keeper_start, kept."""
    every = stored(places(docs, least), "places")
    again = stored(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("over").alias("over")).where("n > 1 or over").select("anchor"), "anchors")
    members = stored(every.join(again, "anchor"), "anchored")
    discard(every, again)
    place = F.struct("doc_id", "start", "whole")
    classes = members.groupBy("anchor", "context", "m").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.max("over").alias("over"))
    classes = stored(classes, "classes")
    several = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("classes"))
    classes_n = stored(classes.join(several, "anchor").where("classes > 1 or over or first != last"), "classes")
    discard(classes)
    # All places of a context repeat the first.
    alone, mixed = classes_n.where("classes = 1 and not over"), classes_n.where("classes > 1 or over")
    keeper = {"keeper_doc_id": F.col("first.doc_id"), "keeper_start": F.col("first.start")}
    result = ["doc_id", "whole", "start", "m", "keeper_doc_id", "keeper_start", "kept"]
    others = members.drop("over").join(classes_n.where("first != last").select("anchor", "context", "first"), ["anchor", "context"]).where(place != F.col("first"))
    others = others.withColumns(keeper | {"kept": F.lit(False)}).select(*result)
    leads = alone.withColumns(keeper | {"doc_id": F.col("first.doc_id"), "whole": F.col("first.whole"), "start": F.col("first.start"), "kept": F.lit(True)}).select(*result)
    # Several contexts: the windows of their first places are compared; the last place says that there is another one.
    asked = stored(mixed.groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_set("context").alias("asked")), "asked")
    lists = semi_join(docs, asked.select("doc_id"), "doc_id").join(asked, "doc_id")
    lists = anchors(lists, least).select("anchor", "context", "runs").dropDuplicates(["anchor", "context"])
    ends = F.explode(F.array_distinct(F.array("first", "last"))).alias("_place")
    rows = mixed.select("anchor", "context", "classes", "first", ends).withColumn("lead", F.col("_place") == F.col("first")).join(lists, ["anchor", "context"])
    rows = stored(rows.select("_place.*", "anchor", "context", "classes", "lead", "runs"), "windows")
    stream = rows.where(F.col("classes") <= in_one_stream).repartition("anchor").sortWithinPartitions("anchor", "doc_id", "start", "whole")
    found = stream.mapInArrow(repeated_runs, STRETCHES)
    if rows.where(F.col("classes") > in_one_stream).limit(1).count():
        found = found.union(windows_by_shuffle(rows.where(F.col("classes") > in_one_stream)))
    found = stored(found, "windows")
    discard(rows, asked)
    out = stored(others.union(leads).union(found.where("lead").select(*result)), "repeated")
    discard(members, classes_n, found)
    return out


def stretches(docs: DataFrame, least: int, in_one_stream: int = IN_ONE_STREAM) -> DataFrame:
    """Every stretch of least words or more that occurs before, and (kept) every first one: doc_id, whole, start, n, keeper_doc_id, keeper_start, kept."""
    parts = repeated_windows(docs, least, in_one_stream)
    order = Window.partitionBy("doc_id", "whole").orderBy("start")
    # Rows that occur twice give each place twice.
    parts = parts.withColumn("_twice", F.lag("start").over(order).eqNullSafe(F.col("start"))).where("not _twice").drop("_twice")
    before = F.lag(F.struct(F.col("start") + F.col("m"), "keeper_doc_id", F.col("keeper_start") + F.col("m"), "kept")).over(order)
    same = before == F.struct("start", "keeper_doc_id", "keeper_start", "kept")
    parts = parts.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
    whole = parts.groupBy("doc_id", "whole", "_run", "keeper_doc_id", "kept").agg(F.min("start").alias("start"), F.sum("m").alias("m"), F.min("keeper_start").alias("keeper_start"))
    # What overlaps its keeper begins behind the keeper's first run.
    skip = F.when(~F.col("kept") & (F.col("doc_id") == F.col("keeper_doc_id")), F.greatest(F.lit(0), F.col("keeper_start") + least - F.col("start"))).otherwise(0)
    whole = whole.withColumn("_skip", skip)
    return whole.select(
        "doc_id", "whole", (F.col("start") + F.col("_skip")).cast("int").alias("start"), (F.col("m") + least - 1 - F.col("_skip")).cast("int").alias("n"),
        "keeper_doc_id", (F.col("keeper_start") + F.col("_skip")).cast("int").alias("keeper_start"), "kept",
    )


def _paragraph_sets(c: Cut) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of the run's paragraphs, where each one's begin, and the paragraphs' content hashes."""
    per_line = np.diff(c.lines)
    hashes, line = shingles(c.words, c.line, per_line, SHINGLE)
    wide = per_line >= LEAST_WORDS
    number = np.cumsum(wide) - 1
    keep = wide[line]
    values, at = distinct(hashes[keep], number[line[keep]], len(c.first))
    return values, at, c.h1


def band_keys(values: np.ndarray, at: np.ndarray, bands: int, rows: int = 1) -> list[np.ndarray]:
    """For every band, the keys of sets that lie one after the other, from the smallest of their permuted elements, rows of them.

    The elements are hashes, so an odd multiplier modulo 2**64 permutes them well enough.
    """
    out, odd = [], mix(np.arange(1, bands * rows + 1, dtype=U)) | U(1)
    for b in range(bands):
        key = np.full(len(at) - 1, U(b))
        for r in range(b * rows, (b + 1) * rows):
            key = mix(key * U(3) + np.minimum.reduceat(values * odd[r], at[:-1]))
        out.append(key)
    return out


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    side = lambda s: sets.select(F.col("id").alias(s), F.col("hashes").alias(f"{s}_hashes"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("a_hashes", "b_hashes"))
    return both.where(common * 100 >= (F.size("a_hashes") + F.size("b_hashes") - common) * percent).select("a", "b")


def in_long_runs(members: DataFrame, least: int) -> DataFrame:
    """The rows (doc_id, whole, start, n) that lie in runs of least words or more."""
    order = Window.partitionBy("doc_id", "whole").orderBy("start", F.desc("n"))
    before = F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = members.withColumn("_new", F.when(F.col("start") <= before + BETWEEN, 0).otherwise(1))
    marked = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("doc_id", "whole", "_run")
    length = F.max(F.col("start") + F.col("n")).over(run) - F.min("start").over(run)
    return marked.withColumn("_length", length).where(F.col("_length") >= least).drop("_new", "_run", "_length")


def clusters(docs: DataFrame, percent: int = 80, bands: int = BANDS, least_run: int = LEAST_RUN) -> DataFrame:
    """Every unit that repeats: doc_id, start (word place), n (words), paragraph, whole (a hash of its text), keeper_doc_id, keeper_start, kept."""
    docs = docs.select(F.col("doc_id").cast("long"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    every = stored(lines(docs, bands), "lines")
    keys = every.select(F.explode("keys").alias("key"), F.col("h1").alias("id"), "size")
    shared = stored(keys.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x != y").select("key"), "shared-keys")
    buckets = stored(keys.join(shared, "key").distinct(), "buckets")

    made: list[DataFrame] = []  # tables that are read until the components are there

    def sets(wanted: DataFrame) -> DataFrame:
        where = stored(semi_join(every.select(F.col("h1").alias("id"), "doc_id"), wanted, "id").groupBy("id").agg(F.min("doc_id").alias("doc_id")), "contents")
        ids = stored(where.select("doc_id").distinct(), "ids")
        made.extend((where, ids))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches):
                values, at, ids = _paragraph_sets(Cut(batch.column("text")))
                if len(ids):
                    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(signed(values), pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(signed(ids)), lists], names=["id", "hashes"])

        found = semi_join(docs, ids, "doc_id").mapInArrow(run, "id long, hashes array<long>")
        return semi_join(found, where.select("id"), "id").dropDuplicates(["id"])

    def signed_sets(wanted: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    column = batch.column("hashes")
                    values, at = column.flatten().to_numpy().view(U), np.r_[0, np.cumsum(column.value_lengths().to_numpy())]
                    keys = np.stack([k.astype(np.uint16) for k in band_keys(values, at, SIGNATURE)], axis=1).view(np.int16)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(keys), pa.list_(pa.int16()))], names=["id", "hashes", "keys"])

        return sets(wanted).mapInArrow(run, "id long, hashes array<long>, keys array<short>")

    def verify(pairs: DataFrame) -> DataFrame:
        made.append(stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "contents"))
        return confirm(pairs, sets(made[-1]), percent)

    # Six standard deviations of the signatures' share under the threshold.
    share = percent / 100 - 6 * np.sqrt(percent / 100 * (1 - percent / 100) / SIGNATURE)
    near = connect(buckets, verify, signed_sets, percent, by_region=False, share=share)
    place = F.struct("doc_id", "start", "n")
    ends = [F.min(place).alias("keeper"), F.max(place).alias("other")]
    repeated = every.groupBy("h1").agg(*ends).where("keeper != other").select("h1")
    named = repeated.join(near.withColumnRenamed("id", "h1"), "h1", "full").select("h1", "component")
    named = stored(named.select("h1", F.coalesce("component", "h1").alias("cluster"), F.col("component").isNotNull().alias("near")), "contents")
    discard(shared, buckets, near, *made)
    members = every.join(named, "h1").withColumn("cluster2", F.when(F.col("near"), F.lit(0)).otherwise(F.col("h2")))
    members = stored(members.select("doc_id", "whole", "start", "n", "cluster", "cluster2", "near"), "repeats")
    discard(every, named)
    # What is at one place only, as in rows with equal ids, must not lengthen a run.
    single = members.where("near").groupBy("cluster").agg(*ends).where("keeper = other").select("cluster", F.lit(True).alias("near"))
    members = members.join(single, ["cluster", "near"], "left_anti")
    found = stretches(docs, least_run).withColumn("paragraph", F.lit(False))
    members = members.select("doc_id", "whole", "start", "n", "cluster", "cluster2", F.lit(True).alias("paragraph"))
    members = stored(in_long_runs(members.unionByName(found, allowMissingColumns=True), least_run), "members")
    paragraphs = members.where("paragraph").drop("keeper_doc_id", "keeper_start", "kept")
    first = paragraphs.groupBy("cluster", "cluster2").agg(*ends).where("keeper != other")
    out = paragraphs.join(first, ["cluster", "cluster2"])
    out = out.withColumns({"keeper_doc_id": F.col("keeper.doc_id"), "keeper_start": F.col("keeper.start"), "kept": place == F.col("keeper")})
    columns = ["doc_id", "start", "n", "paragraph", "whole", "keeper_doc_id", "keeper_start", "kept"]
    return out.select(*columns).union(members.where("not paragraph").select(*columns))


def without_repeats(docs: DataFrame, **how) -> DataFrame:
    """docs with the removed units cut from text and n_chars (if there is one) brought up to date.

    A document of which nothing but white space is left, but which had words, is dropped.
    """
    gone = clusters(docs, **how).where("not kept").groupBy(F.col("doc_id").alias("_moraine_id")).agg(F.collect_list(F.struct("start", "n", "whole")).alias("_moraine_gone"))
    gone = stored(gone, "removals")
    rows = docs.join(gone, F.col("doc_id").cast("long") == F.col("_moraine_id"), "left").drop("_moraine_id")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts, keep = batch.column("text").to_pylist(), np.ones(batch.num_rows, bool)
            for k, spans in enumerate(batch.column("_moraine_gone").to_pylist()):
                if spans and texts[k]:
                    texts[k] = cut_out(texts[k], spans)
                    keep[k] = bool(texts[k].split())
            columns = {c: batch.column(c) for c in names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                changed = pa.array([bool(x) for x in batch.column("_moraine_gone").to_pylist()], pa.bool_())
                counted = pa.array([None if t is None else len(t) for t in texts], columns["n_chars"].type)
                columns["n_chars"] = pc.if_else(changed, counted, columns["n_chars"])
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names).filter(pa.array(keep))

    return rows.mapInArrow(run, docs.schema)


def cut_out(text: str, spans: list[dict]) -> str:
    c = Cut(pa.array([text], pa.string()))
    whole = int(signed(c.whole)[0])
    first = np.array([s["start"] for s in spans if s["whole"] == whole], np.int64)
    last = first + np.array([s["n"] for s in spans if s["whole"] == whole], np.int64)
    drop = np.zeros(len(c.words) + 1, np.int64)
    np.add.at(drop, first, 1)
    np.add.at(drop, last, -1)
    drop = np.cumsum(drop)[:-1] > 0
    # A few words between two removed units belong to the passage.
    edges = np.flatnonzero(np.diff(np.r_[False, drop, False].astype(np.int8)))
    for a, b in zip(edges[1:-1:2], edges[2::2]):
        drop[a:b] |= b - a <= BETWEEN
    gone = np.zeros(len(c.texts.data), bool)
    edges = np.flatnonzero(np.diff(np.r_[False, drop, False].astype(np.int8)))
    for a, b in zip(edges[::2], edges[1::2]):
        gone[c.texts.start[a] : c.texts.stop[b - 1]] = True
    return c.texts.data[~gone].tobytes().decode()
