"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import os

import duckdb
import pytest

import __spark_entry__
from logloom import queries as engine
from logloom import surface
from logloom.plans import rewrites

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def _plain(rows, columns):
    def value(v):
        return round(v, 6) if isinstance(v, float) else v

    order = sorted(columns)
    return sorted((tuple(repr(value(r[columns.index(c)])) for c in order) for r in rows)), order


@pytest.mark.parametrize("name", [*engine.QUERIES, *surface.QUERIES])
def test_query(spark, duck, name):
    out = __spark_entry__.queries()[name](spark, SF)
    rows = [tuple(r) for r in out.collect()]
    if name in __spark_entry__.oracle_sql():
        found = duck.sql(__spark_entry__.oracle_sql()[name])
        assert _plain(rows, out.columns) == _plain(found.fetchall(), found.columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 2
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_plans_push_down(spark):
    """Two columns of events: only they are read, and the filter reaches the scan."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    plan = events.where("user_id = 3").groupBy("event_type").count()._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,3)]" in plan and "props" not in plan.split("ReadSchema")[1]


def test_csv_ingest_beyond_an_integer_of_bytes(spark, tmp_path):
    """Lines whose offsets pass 2^31 beside the CSV files."""
    for t in ("customer", "nation"):
        os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    duckdb.sql(f"COPY (SELECT * REPLACE (event_id + 5000000000 AS event_id) FROM '{SF}/events.parquet' WHERE event_id < 20) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    out = engine.QUERIES["csv_ingest"](spark, str(tmp_path))
    found = duckdb.sql(engine.ORACLE["csv_ingest"].replace("FROM customer", f"FROM '{SF}/customer.parquet'"))
    assert _plain([tuple(r) for r in out.collect()], out.columns) == _plain(found.fetchall(), found.columns)


def test_approximate_counts_stay_near(spark, tmp_path):
    """A million values, whose distinct count Spark's default accuracy misses by more than 10 percent."""
    spark.range(1_200_000).selectExpr("'A' AS l_returnflag", "id AS l_partkey", "1000.0D + id % 1000 AS l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in surface.QUERIES["sql_approximate"](spark, str(tmp_path)).collect()] == [("A", True, True)]


def test_finer():
    e = rewrites.DISTINCT_ERROR
    sql = "SELECT Approx_Count_Distinct /* ( */ (coalesce(a, 'b)(,')), approx_count_distinct(a, 0.1), 'approx_count_distinct(a)', (approx_count_distinct(f(a, b))) FROM t"
    assert rewrites.finer(sql) == sql.replace("'b)(,'))", f"'b)(,'), {e})").replace("f(a, b))", f"f(a, b), {e})")
    assert rewrites.finer("SELECT approx_count_distinct(a) FROM t) x") == f"SELECT approx_count_distinct(a, {e}) FROM t) x"
