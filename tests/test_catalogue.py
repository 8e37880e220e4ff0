"""Every query with SQL against DuckDB, and every query for rows and a stable schema."""

import duckdb
import pytest

from certlake.plans.registry import ORACLES, QUERIES, load
from tests.conftest import TINY

load()

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    return con


def plain(rows):
    cell = lambda v: "null" if v is None or v != v else repr(round(float(v), 9)) if isinstance(v, (int, float)) else str(v)
    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df, sql = QUERIES[name](spark, TINY), duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    places = [sql.columns.index(c) for c in columns]
    assert plain(tuple(r) for r in df.select(columns).collect()) == plain(tuple(r[i] for i in places) for r in sql.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, TINY).count() > 0


def test_the_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["family", "outcome", "n"]


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["manifest_join"](spark, TINY)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1]
