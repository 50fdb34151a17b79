"""Every query with SQL gives DuckDB's rows."""

import duckdb
import pytest

from moraine.plans import registry

TABLES = "documents embeddings pages benchmark labels conversations events orders customer".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(map(str, frame.astype(object).where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    ours = registry.QUERIES[name](spark, sf).toPandas()
    assert canonical(ours) == canonical(duck.execute(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["pack_stats", "blob_catalog", "frame_assignment", "order_digest"])
def test_result_does_not_depend_on_partitions(spark, sf, name):
    first = canonical(registry.QUERIES[name](spark, sf).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert canonical(registry.QUERIES[name](spark, sf).toPandas()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 1
