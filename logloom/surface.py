"""The relational surface: SELECT over the tables in Spark SQL, and the same for DuckDB where the dialects differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.plans import rewrites

_MONEY = "CAST(sum(CAST({} AS DECIMAL(18, 2))) AS DOUBLE)"


def _sum(c: str) -> str:
    return _MONEY.format(c)


# name: (tables, SQL for both) or (tables, Spark's SQL, DuckDB's SQL)
STATEMENTS: dict[str, tuple] = {
    "sql_project_filter": (["orders"], "SELECT o_orderkey, o_totalprice * 2 AS doubled, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'known' ELSE 'other' END AS status, o_orderpriority LIKE '%HIGH%' AS is_high FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000 AND o_orderstatus <> 'P'"),
    "sql_group_by": (["lineitem"], f"SELECT l_returnflag, l_linestatus, {_sum('l_quantity')} AS qty, {_sum('l_extendedprice')} AS price, count(*) AS n, max(l_discount) AS top FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "sql_group_by_all": (["lineitem"], "SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL"),
    "sql_having": (["lineitem"], f"SELECT l_suppkey, {_sum('l_quantity')} AS qty FROM lineitem GROUP BY l_suppkey HAVING count(*) > 20"),
    "sql_filter_agg": (["orders"], "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS filled, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderpriority"),
    "sql_rollup": (["orders"], "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus) AS g1, grouping(o_orderpriority) AS g2 FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus)::TINYINT AS g1, grouping(o_orderpriority)::TINYINT AS g2 FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    "sql_cube": (["orders"], "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "sql_grouping_sets": (["orders"], "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"),
    "sql_join_inner": (["orders", "customer", "nation"], f"SELECT n_name, {_sum('o_totalprice')} AS total, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"),
    "sql_join_left": (["orders", "customer"], "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey"),
    "sql_join_right": (["orders", "customer"], "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_totalprice > 300000"),
    "sql_join_full": (["supplier", "customer"], "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 2"),
    "sql_join_semi": (["orders", "customer"], "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)"),
    "sql_join_anti": (["orders", "customer"], "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "sql_join_cross": (["region", "nation"], "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE r_regionkey <> n_regionkey"),
    "sql_join_theta": (["nation", "region"], "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey AND n_nationkey % 2 = 0"),
    "sql_self_join": (["events"], "SELECT a.event_type AS event_type, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id + 1 = b.event_id GROUP BY a.event_type"),
    "sql_window_rank": (["orders"], "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr, ntile(3) OVER w AS tile FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr, ntile(3) OVER w AS tile FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)"),
    "sql_window_lag": (["events"], "SELECT event_id, lag(event_id) OVER w AS prev, lead(event_type, 2, 'none') OVER w AS later, first_value(event_id) OVER w AS head FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"),
    "sql_window_frame": (["events"], "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS near, sum(user_id) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS running, max(user_id) OVER (PARTITION BY event_type ORDER BY event_id RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS recent FROM events", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS near, (sum(user_id) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS running, max(user_id) OVER (PARTITION BY event_type ORDER BY event_id RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS recent FROM events"),
    "sql_set_union": (["customer", "supplier"], "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "sql_set_union_all": (["customer", "supplier"], "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k"),
    "sql_set_intersect": (["customer", "supplier"], "SELECT c_custkey % 50 AS k FROM customer INTERSECT SELECT s_suppkey % 70 FROM supplier"),
    "sql_set_except": (["customer", "supplier"], "SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey FROM supplier"),
    "sql_set_except_all": (["customer", "supplier"], "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier"),
    "sql_distinct": (["events"], "SELECT DISTINCT event_type, user_id % 10 AS bucket FROM events"),
    "sql_topk": (["orders"], "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5"),
    "sql_subquery": (["orders", "lineitem"], "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders WHERE o_totalprice > (SELECT avg(CAST(o_totalprice AS DECIMAL(18, 2))) FROM orders)"),
    "sql_lateral": (["customer", "orders"], "SELECT c_custkey, t.n FROM customer, LATERAL (SELECT count(*) AS n FROM orders WHERE o_custkey = c_custkey) t"),
    "sql_cte_in_subquery": (["events"], "SELECT event_type, n FROM (WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) SELECT * FROM c WHERE n > 1) q"),
    "sql_json": (["events"], "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events"),
    "sql_string": (["customer"], "SELECT c_custkey, upper(c_name) AS u, substr(c_name, 1, 4) AS s, length(c_name) AS n, replace(c_mktsegment, 'I', '1') AS r, concat(c_name, '-', c_mktsegment) AS c, lpad(CAST(c_nationkey AS STRING), 4, '0') AS p, trim(concat('  ', c_name, ' ')) AS t, reverse(c_name) AS rev, instr(c_name, '#') AS i FROM customer", "SELECT c_custkey, upper(c_name) AS u, substr(c_name, 1, 4) AS s, length(c_name)::INT AS n, replace(c_mktsegment, 'I', '1') AS r, concat(c_name, '-', c_mktsegment) AS c, lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS p, trim(concat('  ', c_name, ' ')) AS t, reverse(c_name) AS rev, instr(c_name, '#')::INT AS i FROM customer"),
    "sql_regex": (["customer"], "SELECT c_custkey, regexp_extract(c_name, '([0-9]+)', 1) AS digits, c_name RLIKE '0{3}' AS zeros, regexp_replace(c_name, '[0-9]', 'x') AS hidden FROM customer", "SELECT c_custkey, regexp_extract(c_name, '([0-9]+)', 1) AS digits, regexp_matches(c_name, '0{3}') AS zeros, regexp_replace(c_name, '[0-9]', 'x', 'g') AS hidden FROM customer"),
    "sql_date": (["orders"], "SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, date_format(o_orderdate, 'yyyy-MM') AS ym, datediff(DATE'2000-01-01', CAST(o_orderdate AS DATE)) AS d, date_format(date_trunc('month', o_orderdate), 'yyyy-MM-dd') AS m, dayofweek(o_orderdate) - 1 AS w FROM orders", "SELECT o_orderkey, year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, strftime(o_orderdate, '%Y-%m') AS ym, datediff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01')::INT AS d, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS m, dayofweek(o_orderdate)::INT AS w FROM orders"),
    "sql_time_bucket": (["events"], "SELECT date_format(window(ts, '15 minutes').start, 'yyyy-MM-dd HH:mm') AS bucket, count(*) AS n FROM events GROUP BY 1", "SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M') AS bucket, count(*) AS n FROM events GROUP BY 1"),
    "sql_math_hash": (["part"], "SELECT p_partkey, abs(p_size - 25) AS a, round(p_retailprice, 0) AS r, p_size % 7 AS m, greatest(p_size, 10) AS g, sign(p_size - 25) AS s, md5(p_name) AS h, sha2(p_name, 256) AS s2, p_size & 6 AS b FROM part", "SELECT p_partkey, abs(p_size - 25) AS a, round(p_retailprice, 0) AS r, p_size % 7 AS m, greatest(p_size, 10) AS g, sign(p_size - 25)::DOUBLE AS s, md5(p_name) AS h, sha256(p_name) AS s2, p_size & 6 AS b FROM part"),
    "sql_null_functions": (["orders"], "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s, coalesce(nullif(o_orderstatus, 'F'), 'was F') AS c, nullif(o_orderstatus, 'F') IS NULL AS n FROM orders"),
    "sql_unnest": (["customer"], "SELECT c_custkey, pos, word FROM customer LATERAL VIEW posexplode(split(c_name, '#')) t AS pos, word", "SELECT c_custkey, (i - 1)::INT AS pos, w[i] AS word FROM (SELECT c_custkey, string_split(c_name, '#') AS w, unnest(range(1, len(string_split(c_name, '#')) + 1)) AS i FROM customer)"),
    "sql_lists": (["events"], "SELECT user_id, array_join(array_sort(collect_set(event_type)), ',') AS kinds, size(collect_list(event_id)) AS n, array_max(collect_list(event_id)) AS top FROM events GROUP BY user_id", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds, len(list(event_id))::INT AS n, list_max(list(event_id)) AS top FROM events GROUP BY user_id"),
    "sql_struct_map": (["nation"], "SELECT n_nationkey, named_struct('name', n_name, 'region', n_regionkey).region + 1 AS r, map('a', n_name, 'b', 'x')['a'] AS m FROM nation", "SELECT n_nationkey, {'name': n_name, 'region': n_regionkey}.region + 1 AS r, map {'a': n_name, 'b': 'x'}['a'] AS m FROM nation"),
    "sql_pivot": (["orders"], "SELECT * FROM (SELECT o_orderpriority, o_orderstatus FROM orders) PIVOT (count(*) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT o_orderpriority, nullif(count_if(o_orderstatus = 'F'), 0) AS f, nullif(count_if(o_orderstatus = 'O'), 0) AS o, nullif(count_if(o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY 1"),
    "sql_unpivot": (["part"], "SELECT p_partkey, measure, v FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part) UNPIVOT (v FOR measure IN (size, price))", "SELECT p_partkey, measure, v FROM (UNPIVOT (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part) ON size, price INTO NAME measure VALUE v)"),
    "sql_stats": (["lineitem"], "SELECT l_returnflag, min(l_shipdate) AS first_ship, CAST(percentile(l_quantity, 0.5) AS DOUBLE) AS median, mode(l_linenumber, true) AS common, bool_or(l_tax > 0.07) AS taxed, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, min(l_shipdate) AS first_ship, quantile_cont(l_quantity, 0.5) AS median, (SELECT l_linenumber FROM lineitem i WHERE i.l_returnflag = o.l_returnflag GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS common, bool_or(l_tax > 0.07) AS taxed, count(DISTINCT l_suppkey) AS suppliers FROM lineitem o GROUP BY l_returnflag"),
    # approximations and samples differ by engine: how far they are from the exact values is what is alike
    "sql_approximate": (["lineitem"], "SELECT l_returnflag, abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey)) <= 0.1 * count(DISTINCT l_partkey) AS distinct_near, abs(percentile_approx(l_extendedprice, 0.5, 1000) - percentile(l_extendedprice, 0.5)) <= 0.02 * percentile(l_extendedprice, 0.5) AS median_near FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey)) <= 0.2 * count(DISTINCT l_partkey) AS distinct_near, abs(approx_quantile(l_extendedprice, 0.5) - quantile_cont(l_extendedprice, 0.5)) <= 0.05 * quantile_cont(l_extendedprice, 0.5) AS median_near FROM lineitem GROUP BY l_returnflag"),
    "sql_sample": (["lineitem"], "SELECT count(*) BETWEEN 0.2 * max(n) AND 0.3 * max(n) AS a_quarter, bool_and(l_quantity > 0) AS rows_of_the_table FROM (SELECT * FROM lineitem TABLESAMPLE (25 PERCENT) REPEATABLE (7)), (SELECT count(*) AS n FROM lineitem)", "SELECT count(*) BETWEEN 0.2 * max(n) AND 0.3 * max(n) AS a_quarter, bool_and(l_quantity > 0) AS rows_of_the_table FROM (SELECT * FROM lineitem TABLESAMPLE bernoulli(25 PERCENT) REPEATABLE (7)), (SELECT count(*) AS n FROM lineitem)"),
    "sql_order_by_all": (["nation"], "SELECT n_regionkey, n_name FROM nation ORDER BY ALL LIMIT 9"),
    "sql_set_intersect_all": (["lineitem", "orders"], "SELECT l_orderkey % 100 AS k FROM lineitem INTERSECT ALL SELECT o_orderkey % 100 FROM orders"),
    "sql_set_except_all": (["lineitem", "orders"], "SELECT l_orderkey % 100 AS k FROM lineitem EXCEPT ALL SELECT o_orderkey % 100 FROM orders"),
}


def statement(name: str):
    tables, sql, *_ = STATEMENTS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in tables:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(rewrites.finer(sql))

    run.__name__ = name
    return run


def sql_qualify(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return rewrites.qualify(orders, F.row_number().over(w), "_w <= 2").select("o_custkey", "o_orderkey")


_QUALIFY = "SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS r FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) <= 3) WHERE o_totalprice > 1000 QUALIFY r = 1 OR o_orderkey % 50 = 0"


def sql_qualify_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    return spark.sql(rewrites.qualified(_QUALIFY))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Some rows of both have no key or no time, and some of the right stand at one key and time."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "CASE WHEN event_id % 17 < 2 THEN NULL ELSE user_id END AS user_id", "CASE WHEN event_id % 19 < 2 THEN NULL ELSE date_trunc('hour', ts) END AS ts")
    return events.where("event_id % 2 = 1"), events.where("event_id % 2 = 0")


def sql_join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    return rewrites.asof_join(left, right, "user_id", "ts", "ts", ["event_id"]).select("event_id", "right_event_id")


def sql_join_asof_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    return rewrites.asof_join(left, right, "user_id", "ts", "ts", ["event_id"], slice_seconds=86_400).select("event_id", "right_event_id")


def sql_join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_retailprice")
    bands = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", (F.col("n_nationkey") * 70.0 + 800).alias("low"), (F.col("n_nationkey") * 70.0 + 1000).alias("high"))
    return rewrites.range_join(parts, bands, "p_retailprice", "low", "high", 100.0).select("p_partkey", "n_nationkey")


QUERIES = {n: statement(n) for n in STATEMENTS} | {f.__name__: f for f in (sql_qualify, sql_qualify_text, sql_join_asof, sql_join_asof_sliced, sql_join_range)}

_SIDES = "SELECT event_id, CASE WHEN event_id % 17 < 2 THEN NULL ELSE user_id END AS user_id, CASE WHEN event_id % 19 < 2 THEN NULL ELSE date_trunc('hour', ts) END AS ts FROM events WHERE event_id % 2 ="
_ASOF = f"SELECT l.event_id AS event_id, r.event_id AS right_event_id FROM ({_SIDES} 1) l ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM ({_SIDES} 0) WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY user_id, ts) r ON l.user_id = r.user_id AND l.ts >= r.ts"

ORACLE = {n: s[-1] for n, s in STATEMENTS.items()} | {
    "sql_qualify": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2",
    "sql_qualify_text": _QUALIFY,
    "sql_join_asof": _ASOF,
    "sql_join_asof_sliced": _ASOF,
    "sql_join_range": "SELECT p_partkey, n_nationkey FROM part JOIN nation ON p_retailprice >= n_nationkey * 70.0 + 800 AND p_retailprice < n_nationkey * 70.0 + 1000",
}
