"""General SQL through the engine: what the declared tables answer beyond single-table scans and global aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalog.functions import columnar
from stratalog.queries.loaded import ask
from stratalog.session import new_path, table
from stratalog.sources import columnar_file

#: Statements that Spark and the comparison read alike.
STATEMENTS = {
    "sql_left_join": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'",
    "sql_full_join": "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey",
    "sql_semi_join": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "sql_anti_join": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "sql_multi_join": "SELECT r_name, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, o_orderpriority",
    "sql_having": "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "sql_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "sql_grouping_sets": "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())",
    "sql_top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "sql_offset": "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 10 OFFSET 30",
    "sql_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "sql_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier",
    "sql_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier",
    "sql_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier",
    "sql_cte": "WITH spent AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT c_mktsegment, sum(n) / 1 AS orders FROM customer JOIN spent ON c_custkey = o_custkey GROUP BY c_mktsegment".replace("sum(n) / 1", "CAST(sum(n) AS BIGINT)"),
    "sql_scalar_subquery": "SELECT p_partkey, p_size FROM part WHERE p_size = (SELECT max(p_size) FROM part)",
    "sql_in_subquery": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "sql_window_rank": "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place FROM orders",
    "sql_window_frame": "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS high FROM orders",
    "sql_window_lag": "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after FROM orders",
    "sql_case_functions": "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS kind, upper(p_brand) AS brand, substring(p_name, 1, 4) AS start, coalesce(nullif(p_size, 3), -1) AS size FROM part",
    "sql_conditional_aggregate": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS open FROM orders GROUP BY o_orderpriority",
}


def _written(spark: SparkSession, d: str) -> str:
    path = new_path(spark, "columns")
    columnar_file.write(table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag").repartitionByRange(4, "l_orderkey"), path, rows_per_group=5000)
    return path


def footer_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Count, nulls and extremes of a column from file footers alone."""
    return columnar_file.aggregate(spark, _written(spark, d), "l_quantity")


def columnar_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return columnar.column_stats(columnar_file.read_column(spark, _written(spark, d), "l_orderkey"), "l_orderkey")


QUERIES = {name: (lambda spark, d, text=text: ask(spark, d, text)) for name, text in STATEMENTS.items()} | {"footer_aggregate": footer_aggregate, "columnar_roundtrip": columnar_roundtrip}
SQL = STATEMENTS | {
    "footer_aggregate": "SELECT count(*) AS total, count(*) - count(l_quantity) AS nulls, CAST(min(l_quantity) AS DOUBLE) AS min_value, CAST(max(l_quantity) AS DOUBLE) AS max_value, CAST(sum(l_quantity) AS DOUBLE) AS sum_value, avg(l_quantity) AS avg_value FROM lineitem",
    "columnar_roundtrip": "SELECT count(*) AS total, count(*) - count(l_orderkey) AS nulls, count(DISTINCT l_orderkey) AS distinct_values, min(l_orderkey) AS min_value, max(l_orderkey) AS max_value FROM lineitem",
}
