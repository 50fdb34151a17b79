"""The queries of the operators: those with SQL give DuckDB's rows, all run over their whole tables."""

import duckdb
import pytest

from moraine.llm import queries

ROWS = {"op6_topk": 50, "op8_html_text": 50, "op2_substring_dup": None, "op10_packing": None}


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(map(str, frame.astype(object).where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert canonical(queries.QUERIES[name](spark, sf).toPandas()) == canonical(c.execute(queries.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_returns_all_rows(spark, sf, name):
    got = queries.QUERIES[name](spark, sf)
    expected = ROWS.get(name, spark.read.parquet(f"{sf}/documents.parquet").count())
    assert got.count() > 0 if expected is None else got.count() == expected


def test_each_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))
