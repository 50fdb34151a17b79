"""Queries by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from moraine.functions import scalar
from moraine.functions.blake3 import blake3
from moraine.operators import classify, dedup, folds, inputs, verify

from . import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Slots of the documents, in SQL.
DOCS = "docs AS (SELECT source AS container, doc_id, lang, sha256(text) AS h, strlen(text) AS size, text FROM documents)"
CHATS = "chats AS (SELECT conv_id, turn, role, sha256(text) AS h, strlen(text) AS size FROM conversations)"
BLOBS = "blobs AS (SELECT h, max(size) AS size, count(*) AS ref_count, min(doc_id) AS first_id FROM docs WHERE h IS NOT NULL GROUP BY h)"
SEEN = "seen AS (SELECT *, row_number() OVER (ORDER BY first_id) - 1 AS ord FROM blobs)"
STATS = """count(DISTINCT container) AS jar_count, count(*) AS entry_count, count(h) AS file_entry_count,
       count(DISTINCT h) AS unique_blob_count, coalesce(sum(size), 0)::BIGINT AS bytes_uncompressed_entries,
       {unique}::BIGINT AS bytes_unique_blobs,
       CASE WHEN coalesce(sum(size), 0) = 0 THEN 0.0 ELSE 1.0::DOUBLE - {unique}::DOUBLE / sum(size)::DOUBLE END AS dedup_ratio"""
FRAME_LIMIT = 262_144


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(f"WITH {DOCS}, u AS (SELECT coalesce(sum(size), 0) AS s FROM (SELECT h, max(size) AS size FROM docs GROUP BY h)) SELECT {STATS.format(unique='(SELECT s FROM u)')} FROM docs")
def pack_stats(spark: SparkSession, d: str) -> DataFrame:
    return dedup.statistics(A.docs(spark, d))


@query(
    f"WITH {DOCS}, u AS (SELECT lang, sum(size) AS s FROM (SELECT lang, h, max(size) AS size FROM docs GROUP BY lang, h) GROUP BY lang) "
    f"SELECT docs.lang, {STATS.format(unique='any_value(u.s)')} FROM docs JOIN u USING (lang) GROUP BY docs.lang"
)
def pack_stats_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return dedup.statistics(A.docs(spark, d, "lang").where("lang is not null"), by=["lang"])


@query(f"WITH {DOCS}, {BLOBS}, {SEEN} SELECT ord AS first_seen_ord, h, size, ref_count FROM seen")
def blob_catalog(spark: SparkSession, d: str) -> DataFrame:
    return dedup.catalog(A.docs(spark, d), ["slot_ord"]).select("first_seen_ord", "h", "size", "ref_count")


@query("SELECT sha256(props) AS h, max(strlen(props)) AS size, count(*) AS ref_count, min(event_id) AS first_event_id FROM events WHERE props IS NOT NULL GROUP BY 1")
def blob_catalog_events(spark: SparkSession, d: str) -> DataFrame:
    return dedup.blobs(A.events(spark, d), ["slot_ord"]).select("h", "size", "ref_count", F.col("first.slot_ord").alias("first_event_id"))


@query(f"WITH {DOCS}, {BLOBS} SELECT sha256(string_agg(h, '' ORDER BY first_id)) AS digest FROM blobs")
def order_digest(spark: SparkSession, d: str) -> DataFrame:
    return dedup.order_digest(dedup.blobs(A.docs(spark, d), ["slot_ord"]).select("h", "first.slot_ord"), ["slot_ord"], [])


@query(f"WITH {CHATS} SELECT conv_id, sha256(string_agg(coalesce(h, ''), '' ORDER BY turn)) AS digest FROM chats GROUP BY conv_id")
def order_digest_by_container(spark: SparkSession, d: str) -> DataFrame:
    return dedup.order_digest(A.chats(spark, d).withColumnRenamed("container", "conv_id"), ["slot_ord"], ["conv_id"])


FRAMES = f"""WITH RECURSIVE {DOCS}, {BLOBS}, {SEEN}, rec AS (SELECT ord, h, size + 41 AS len FROM seen),
fold(ord, h, frame_id, rec_off, used) AS (
  SELECT ord, h, 0::BIGINT, 0::BIGINT, len FROM rec WHERE ord = 0
  UNION ALL
  SELECT r.ord, r.h, CASE WHEN f.used + r.len > {FRAME_LIMIT} THEN f.frame_id + 1 ELSE f.frame_id END,
         CASE WHEN f.used + r.len > {FRAME_LIMIT} THEN 0 ELSE f.used END,
         CASE WHEN f.used + r.len > {FRAME_LIMIT} THEN r.len ELSE f.used + r.len END
  FROM fold f JOIN rec r ON r.ord = f.ord + 1)"""


def _framed(spark: SparkSession, d: str) -> DataFrame:
    records = dedup.blobs(A.docs(spark, d), ["slot_ord"]).select("h", F.col("first.slot_ord").alias("first_id"), scalar.blob_record_length("size").alias("len"))
    return folds.frames(records, ["first_id"], "len", FRAME_LIMIT)


@query(f"{FRAMES} SELECT h, frame_id, rec_off FROM fold")
def frame_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _framed(spark, d).select("h", "frame_id", "rec_off")


@query(f"{FRAMES} SELECT frame_id, count(*) AS blob_count, sum(rec.len)::BIGINT AS record_bytes FROM fold JOIN rec USING (ord) GROUP BY frame_id")
def frame_summary(spark: SparkSession, d: str) -> DataFrame:
    return folds.frame_summary(_framed(spark, d), "len").drop("frame_off")


@query(f"{FRAMES} SELECT frame_id, coalesce(sum(sum(rec.len)) OVER (ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS frame_off FROM fold JOIN rec USING (ord) GROUP BY frame_id")
def frame_offsets(spark: SparkSession, d: str) -> DataFrame:
    return folds.frame_summary(_framed(spark, d), "len").select("frame_id", "frame_off")


@query(f"WITH {CHATS} SELECT conv_id, turn, coalesce(sum(size) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM chats")
def slot_offsets(spark: SparkSession, d: str) -> DataFrame:
    rows = A.chats(spark, d)
    return rows.select(F.col("container").alias("conv_id"), F.col("slot_ord").alias("turn"), folds.running_offset("size", ["container"], ["slot_ord"]).alias("offset"))


@query("""SELECT source, doc_id, coalesce((SELECT min(b.n_chars) FROM documents b WHERE b.source = a.source AND b.n_chars > a.n_chars), 1000000000)::BIGINT AS next_off
FROM documents a""")
def next_distinct_offset(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "documents")
    return rows.select("source", "doc_id", folds.next_distinct("n_chars", ["source"], F.lit(1_000_000_000).cast("long")).alias("next_off"))


@query(f"WITH {CHATS}, o AS (SELECT conv_id, size, sum(size) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM chats) SELECT conv_id, greatest(max(e), 64)::BIGINT AS cd_start FROM o GROUP BY conv_id")
def container_extent(spark: SparkSession, d: str) -> DataFrame:
    rows = A.chats(spark, d).withColumn("start", folds.running_offset("size", ["container"], ["slot_ord"]))
    zero = F.lit(0).cast("long")
    end = scalar.slot_end("start", zero, "size", zero, zero)
    return folds.extent(rows, ["container"], end, F.lit(64).cast("long")).withColumnRenamed("container", "conv_id")


#: Flags of documents as slots, by arithmetic on doc_id, for the classification queries.
def _flagged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = A.docs(spark, d, "doc_id")
    n = F.col("doc_id")
    text = F.lit(None).cast("string")
    slots = rows.select(
        "container", F.lit(None).cast("long").alias("nested_ord"), (n % 50 == 0).alias("is_dir"), F.when(n % 3 == 0, 8).otherwise(0).alias("method_code"),
        F.when(n % 50 != 0, F.col("h")).alias("blob"), F.lit(None).cast("long").alias("zip_index"), text.alias("cdata_blob"),
        F.when((n % 3 == 0) & (n % 7 != 0), F.lit("deflate-raw:zlib:6")).alias("cdata_codec"),
        F.when(n % 50 == 0, 0).otherwise(F.col("size")).alias("uncompressed_size"), F.when(n % 50 == 0, 0).otherwise(F.col("size") - F.when(n % 3 == 0, 1).otherwise(0)).alias("compressed_size"),
        F.when(n % 400 != 11, F.lit("504b0304")).alias("local_header_hex"), text.alias("local_header_blob"),
    )
    place = F.expr("try_cast(substring(container, 4, 9) as int)")
    containers = rows.select("container").where("container is not null").distinct()
    containers = containers.select("container", F.when(place % 3 != 1, F.lit("t")).alias("tail_blob"), F.when(place % 5 == 4, F.lit("r")).alias("raw_zip_blob"), (place % 4 == 0).alias("signed"), F.lit(0).cast("long").alias("source_size"))
    nested = containers.select("container", F.lit(0).cast("long").alias("nested_ord"), "tail_blob").where("1 = 0")
    return containers, slots, nested


FLAGGED = """f AS (SELECT source AS container, doc_id % 50 = 0 AS is_dir, doc_id % 3 = 0 AS deflated, doc_id % 3 = 0 AND doc_id % 7 <> 0 AS codec, doc_id % 400 <> 11 AS header,
  (doc_id % 3 = 0 AND doc_id % 7 <> 0) OR doc_id % 50 = 0 OR doc_id % 3 <> 0 AS ok FROM documents),
c AS (SELECT container, count(*) AS entries, bool_and(ok) AS exact, bool_and(header) AS headers, count(*) FILTER (NOT is_dir AND deflated AND NOT codec) AS misses,
  try_cast(substr(container, 4) AS INT) % 3 <> 1 AS tail, try_cast(substr(container, 4) AS INT) % 5 = 4 AS raw FROM f GROUP BY container)"""


@query(
    f"""WITH {FLAGGED} SELECT container AS source, CASE WHEN raw OR (tail AND exact) THEN 'exact' WHEN tail THEN 'rebuild' WHEN NOT headers THEN 'skip_exact_zipwriter'
WHEN exact THEN 'skip_exact_seek_synthetic_cd' ELSE 'skip_exact_concat_synthetic_cd' END AS backend FROM c"""
)
def restore_backend(spark: SparkSession, d: str) -> DataFrame:
    return classify.backend(*_flagged(spark, d)).select(F.col("container").alias("source"), "backend")


@query(f"WITH {FLAGGED}, b AS (SELECT source AS container, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY source) SELECT container AS source, entries, bytes, misses FROM c JOIN b USING (container)")
def container_list(spark: SparkSession, d: str) -> DataFrame:
    size = A.docs(spark, d).groupBy("container").agg(F.sum("size").alias("bytes"))
    out = classify.listing(*_flagged(spark, d)).join(size, "container")
    return out.select(F.col("container").alias("source"), "entries", "bytes", "misses")


@query(f"WITH {DOCS} SELECT h, count(DISTINCT container) AS containers, count(*) AS refs FROM docs GROUP BY h HAVING count(DISTINCT container) >= 2")
def cross_container_sharing(spark: SparkSession, d: str) -> DataFrame:
    return dedup.shared(A.docs(spark, d))


@query(f"WITH {DOCS}, {BLOBS}, {SEEN} SELECT doc_id, h FROM docs WHERE h IN (SELECT h FROM seen WHERE ord % 10 = 0)")
def verify_missing_blob(spark: SparkSession, d: str) -> DataFrame:
    rows = A.docs(spark, d, "doc_id")
    kept = dedup.catalog(rows, ["slot_ord"]).where("first_seen_ord % 10 != 0")
    return verify.missing(rows, kept).select("doc_id", "h")


@query(
    f"""WITH {DOCS}, {BLOBS}, refs AS (SELECT doc_id, h, size + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS expected FROM docs)
SELECT doc_id, expected, b.size AS actual FROM refs JOIN blobs b USING (h) WHERE expected <> b.size"""
)
def verify_size_mismatch(spark: SparkSession, d: str) -> DataFrame:
    rows = A.docs(spark, d, "doc_id").withColumn("expected", F.col("size") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0))
    return verify.wrong_sizes(rows, dedup.blobs(rows, ["slot_ord"])).select("doc_id", "expected", "actual")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def verify_label_refs(spark: SparkSession, d: str) -> DataFrame:
    return verify.missing(A.table(spark, d, "documents").select("doc_id"), A.table(spark, d, "labels"), "doc_id")


@query(
    f"""WITH {DOCS}, {BLOBS}, recorded AS (SELECT h, ref_count + CASE WHEN first_id % 9 = 0 THEN 1 ELSE 0 END AS n FROM blobs),
refs AS (SELECT h, count(*) AS n FROM docs WHERE h IS NOT NULL GROUP BY h)
SELECT h, coalesce(r.n, 0) AS recorded, coalesce(c.n, 0) AS recomputed FROM recorded r FULL JOIN refs c USING (h) WHERE coalesce(r.n, 0) <> coalesce(c.n, 0)"""
)
def verify_refcount(spark: SparkSession, d: str) -> DataFrame:
    rows = A.docs(spark, d)
    recorded = dedup.blobs(rows, ["slot_ord"]).withColumn("ref_count", F.col("ref_count") + F.when(F.col("first.slot_ord") % 9 == 0, 1).otherwise(0))
    return verify.reference_counts(rows, recorded)


@query(f"WITH {DOCS}, {BLOBS}, {SEEN} SELECT ord, h, 'left' AS side FROM seen WHERE ord % 100 = 99 UNION ALL SELECT ord + 1000000 AS ord, h, 'right' AS side FROM seen WHERE ord % 100 = 99")
def verify_sequence(spark: SparkSession, d: str) -> DataFrame:
    left = dedup.catalog(A.docs(spark, d), ["slot_ord"]).select(F.col("first_seen_ord").alias("ord"), "h")
    moved = left.withColumn("ord", F.col("ord") + F.when(F.col("ord") % 100 == 99, 1_000_000).otherwise(0))
    return verify.sequence_differences(left, moved)


@query("SELECT source, doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def select_only(spark: SparkSession, d: str) -> DataFrame:
    names = A.table(spark, d, "labels").where("quality = 1")
    return inputs.select_only(A.table(spark, d, "documents").select("source", "doc_id"), names, "doc_id")


@query("SELECT name FROM (VALUES ('src0'), ('src7'), ('src999'), ('none')) t(name) WHERE name NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)")
def unknown_only(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([("src0",), ("src7",), ("src999",), ("none",)], "name string")
    return inputs.unknown_only(names, A.table(spark, d, "documents").select(F.col("source").alias("name")), "name")


@query("SELECT page_id, url FROM pages WHERE NOT (regexp_matches(url, '^https?://[^/]*\\.example\\.com/[^/]*$') OR regexp_matches(regexp_extract(url, '([^/]*)$', 1), '^[a-c][^/]*$'))")
def exclude_globs(spark: SparkSession, d: str) -> DataFrame:
    globs = ["http://*.example.com/*", "https://*.example.com/*", "[a-c]*"]
    return A.table(spark, d, "pages").where(~scalar.excluded("url", globs)).select("page_id", "url")


@query(
    """SELECT page_id, regexp_matches(name, '(^|[/\\\\])\\.\\.([/\\\\]|$)') AS unsafe
FROM (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '/../x' WHEN 1 THEN '\\..\\y' WHEN 2 THEN '/..z' ELSE '' END AS name FROM pages)"""
)
def unsafe_names(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id") % 4
    name = F.concat("url", F.when(n == 0, "/../x").when(n == 1, "\\..\\y").when(n == 2, "/..z").otherwise(""))
    return A.table(spark, d, "pages").select("page_id", scalar.unsafe_slot_name(name).alias("unsafe"))


@query(
    """SELECT page_id, regexp_matches(lower(replace(name, '\\', '/')), '^meta-inf/[^/]*\\.(sf|rsa|dsa|ec)$') AS signed
FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'META-INF/A' || page_id || '.SF' WHEN 1 THEN 'meta-inf\\b.rsa' WHEN 2 THEN 'META-INF/x/c.dsa' WHEN 3 THEN 'META-INF/MANIFEST.MF' ELSE 'com/App.EC' END AS name FROM pages)"""
)
def signed_markers(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id") % 5
    name = F.when(n == 0, F.concat(F.lit("META-INF/A"), "page_id", F.lit(".SF"))).when(n == 1, "meta-inf\\b.rsa").when(n == 2, "META-INF/x/c.dsa").when(n == 3, "META-INF/MANIFEST.MF").otherwise("com/App.EC")
    return A.table(spark, d, "pages").select("page_id", scalar.signature_marker(name).alias("signed"))


@query("SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY user_id, event_type")
def input_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return dedup.input_dedupe(A.table(spark, d, "events"), ["user_id", "event_type"], "event_id", "first_id")


@query("SELECT conv_id, turn, CASE (conv_id + turn) % 10 WHEN 0 THEN 'stored' WHEN 8 THEN 'deflated' ELSE 'other' END AS method FROM conversations")
def method_labels(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "conversations").select("conv_id", "turn", scalar.method_label((F.col("conv_id") + F.col("turn")) % 10).alias("method"))


@query("SELECT event_id, CASE (event_id >> 1) & 3 WHEN 0 THEN 6 WHEN 1 THEN 9 WHEN 2 THEN 3 ELSE 1 END AS hint FROM events")
def deflate_hint(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "events").select("event_id", scalar.deflate_hint("event_id").alias("hint"))


@query("SELECT doc_id, CASE WHEN doc_id % 13 = 1 THEN 'only_left' WHEN doc_id % 11 = 0 THEN 'changed' END AS status FROM documents WHERE doc_id % 13 = 1 OR doc_id % 11 = 0")
def identity_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = A.docs(spark, d, "doc_id")
    other = rows.where("doc_id % 13 != 1").withColumn("h", F.when(F.col("doc_id") % 11 == 0, F.reverse("h")).otherwise(F.col("h")))
    return verify.identity(rows, other, "doc_id", "h")


@query(
    f"""WITH {DOCS}, m AS (SELECT count(*) AS entries, count(DISTINCT h) AS blobs, sum(size)::BIGINT AS bytes FROM docs),
v AS (SELECT 'entries' AS metric, entries AS value, 1000 AS lim FROM m UNION ALL SELECT 'blobs', blobs, 10 FROM m UNION ALL SELECT 'bytes', bytes, 1000000000 FROM m)
SELECT metric, value::DOUBLE AS value, lim::DOUBLE AS "limit", value > lim AS over FROM v"""
)
def budget_gate(spark: SparkSession, d: str) -> DataFrame:
    s = dedup.statistics(A.docs(spark, d))
    metrics = s.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, ("entries", "blobs", "bytes"))), F.array(*(F.col(c).cast("double") for c in ("entry_count", "unique_blob_count", "bytes_uncompressed_entries"))))).alias("metric", "value"))
    budgets = spark.createDataFrame([("entries", 1000.0), ("blobs", 10.0), ("bytes", 1e9)], "metric string, limit double")
    return inputs.over_budget(metrics, budgets)


@query("SELECT event_id, CASE WHEN o >= 0 AND event_id % 3 = 0 THEN o - 100 ELSE o END AS rel, CASE WHEN event_id % 2 = 0 THEN o + 100 ELSE o END AS enc FROM (SELECT event_id, event_id * 37 AS o FROM events)")
def directory_offsets(spark: SparkSession, d: str) -> DataFrame:
    n, prefix = F.col("event_id"), F.lit(100).cast("long")
    offset = n * 37
    mode = F.when(n % 2 == 0, "absolute").otherwise("relative")
    shift = F.when(n % 3 == 0, 0).otherwise(100)
    return A.table(spark, d, "events").select("event_id", scalar.relative_offset(offset, prefix, shift).alias("rel"), scalar.encoded_offset(mode, offset, prefix).alias("enc"))


@query(
    """SELECT conv_id, turn, CASE WHEN turn % 7 = 0 AND (conv_id % 2 = 0) THEN 0 WHEN turn % 12 IN (0, 8) THEN (turn % 12)::INT ELSE 8 END AS method_code, 28 + 56 * turn AS toc_len
FROM conversations"""
)
def rebuilt_methods(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turn")
    method = (t % 12).cast("int")
    size = F.when(F.col("conv_id") % 2 == 0, 0).otherwise(1)
    return A.table(spark, d, "conversations").select("conv_id", "turn", scalar.rebuilt_method(t % 7 == 0, method, size).alias("method_code"), scalar.toc_length("turn").alias("toc_len"))


@query(
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'deflate-raw:zlib:6' WHEN event_id % 4 = 1 THEN 'deflate-raw:stored' WHEN event_id % 4 = 2 THEN 'deflate-raw:zlib:7' ELSE 'raw' END AS codec,
event_id % 4 < 2 AS valid FROM events"""
)
def codec_labels(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id") % 4
    codec = F.when(n == 0, "deflate-raw:zlib:6").when(n == 1, "deflate-raw:stored").when(n == 2, "deflate-raw:zlib:7").otherwise("raw")
    return A.table(spark, d, "events").select("event_id", codec.alias("codec"), scalar.valid_codec(codec).alias("valid"))


@query(
    """WITH RECURSIVE t(i, k, v) AS (SELECT i, 0, i::UBIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384::UBIGINT, v >> 1) ELSE v >> 1 END FROM t WHERE k < 8),
l AS (SELECT list(v ORDER BY i) AS v FROM t WHERE k = 8),
b AS (SELECT event_id, hex(encode(props)) AS h FROM events WHERE props IS NOT NULL)
SELECT event_id, xor(4294967295::UBIGINT, list_reduce(list_transform(range(0, len(h) // 2), lambda k: ('0x' || substr(h, (2 * k + 1)::INT, 2))::UBIGINT),
  lambda c, x: xor(list_extract(l.v, (xor(c, x) & 255)::BIGINT + 1), c >> 8), 4294967295::UBIGINT))::BIGINT AS crc32 FROM b, l"""
)
def crc_column(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "events").where("props is not null").select("event_id", F.crc32(F.col("props").cast("binary")).alias("crc32"))


@query()
def blake3_column(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", blake3("text").alias("blake3"))


from . import archives  # noqa: E402  (which registers its queries in its own tables)

QUERIES |= archives.QUERIES
ORACLES |= archives.ORACLES
