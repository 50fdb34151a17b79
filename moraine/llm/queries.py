"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import fingerprints, html_text, katz, langid, mixing, near_dup, packing, quality, substring_dup, topk
from .common import id_remainder, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_substring_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dup.clusters(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "n", "paragraph", "keeper_doc_id", "keeper_start", "kept")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scores(table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), length=4, percent=80)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.predict(docs.select("doc_id", "text"), langid.train(docs))
    return out.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.classify(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mixing, op2_substring_dup, op3_fingerprints, op4_katz, op6_topk, op9_near_dup, op5_language_id, op7_quality, op8_html_text, op10_packing)}
#: The other operators learn, sketch, hash or tokenize in ways that SQL doesn't have.
ORACLES: dict[str, str] = {
    "op6_topk": """WITH r AS (SELECT vec_id, embedding, row_number() OVER () AS n FROM embeddings),
v AS (
  SELECT vec_id, n, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM r
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, v.vec_id, CASE WHEN len(q.x) = 0 THEN 0 ELSE list_dot_product(q.x, v.x) END::BIGINT AS score
  FROM v q JOIN v ON len(q.x) = len(v.x) AND q.n <> v.n WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id NULLS LAST))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 5""",
    "op9_near_dup": r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM w),
u AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS n, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, seen) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.b, r.seen FROM r JOIN e ON e.a = r.id)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, min(r.seen) AS component_id, s.doc_id = min(r.seen) AS kept FROM s JOIN r ON r.id = s.doc_id GROUP BY s.doc_id, s.g""",
}
