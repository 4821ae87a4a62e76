"""Expressions, joins, aggregates, windows, sorts, set operations and subqueries: one query for each form that is supported."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.udf import register_vectorised
from brindle.plans.sqlquery import Catalogue, run_sql
from brindle.session import register, stage, table
from brindle.sources.io import in_order

C = Catalogue()
QUERIES, SQL = C.queries, C.sql

# --- expressions and filters ---
C.both("expr_literals", "SELECT e.event_id, CAST(NULL AS INT) AS n, 'it''s' AS s, DATE '2020-02-29' AS d, TIMESTAMP '2020-01-01 00:00:00' AS t, TRUE AS b, CAST(1.50 AS DECIMAL(5,2)) AS m, CAST(7 AS BIGINT) AS i FROM events e")
C.both("expr_cast", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, CAST(l_extendedprice AS DECIMAL(15,2)) AS p, CAST(l_shipdate AS DATE) AS d, CAST(l_suppkey AS VARCHAR(20)) AS s FROM lineitem")
C.both("expr_null_tests", "SELECT row_id, depdelay IS NULL AS missing, tailnum IS NOT NULL AS has_tail FROM ontime")
C.both("expr_arithmetic", "SELECT l_orderkey, l_linenumber, -l_quantity AS neg, ABS(l_quantity - 25) AS dist, l_quantity + l_tax AS a, l_quantity - l_tax AS s, l_quantity * 2 AS m, l_quantity / 4 AS d, l_partkey % 7 AS r FROM lineitem")
C.both("expr_mod_zero", "SELECT event_id, try_mod(user_id, event_id % 3) AS r FROM events", "SELECT event_id, user_id % NULLIF(event_id % 3, 0) AS r FROM events")
C.both("expr_compare", "SELECT o_orderkey, o_totalprice > 50000 AS gt, o_totalprice >= 50000 AS ge, o_custkey < 100 AS lt, o_custkey <= 100 AS le, o_orderstatus = 'F' AS eq, o_orderstatus <> 'F' AS ne FROM orders")
C.both("expr_null_safe", "SELECT row_id FROM ontime WHERE uniquecarrier <=> carrier", "SELECT row_id FROM ontime WHERE uniquecarrier IS NOT DISTINCT FROM carrier")
C.both("expr_distinct_from", "SELECT row_id FROM ontime WHERE uniquecarrier IS DISTINCT FROM carrier")
C.both("expr_logic", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity < 5 AND l_discount > 0.05) OR NOT (l_returnflag = 'N' OR l_linestatus = 'O')")
C.both("expr_in", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IN (1, 2, 3, o_orderkey)")
C.both("expr_case", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' END AS band FROM customer")
C.both("expr_ifnull_coalesce", "SELECT row_id, IFNULL(depdelay, 0) AS a, COALESCE(arrdelay, depdelay, -1) AS b FROM ontime")
C.both("expr_trim", "SELECT row_id, TRIM(origin) AS a, LTRIM(origin) AS b, RTRIM(origin) AS c, TRIM(BOTH 'N' FROM tailnum) AS d FROM ontime", "SELECT row_id, TRIM(origin, ' ') AS a, LTRIM(origin, ' ') AS b, RTRIM(origin, ' ') AS c, TRIM(tailnum, 'N') AS d FROM ontime")
C.both("expr_pad", "SELECT n_nationkey, LPAD(n_name, 12, '*') AS l, RPAD(n_name, 12, 'äx') AS r, LPAD(n_name, 3, '-') AS cut FROM nation")
C.both("expr_between", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 10000 AND 20000 AND o_orderdate NOT BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1997-01-01 00:00:00'")
C.both("expr_like", "SELECT p_partkey FROM part WHERE p_name LIKE '%old%' AND p_brand LIKE 'Brand#1_' AND p_type NOT LIKE 'PROMO%'")
C.both("expr_decimal_overflow", "SELECT l_orderkey, l_linenumber, TRY_MULTIPLY(CAST('60000000000000000000000000000000000000' AS DECIMAL(38,0)), CAST(l_linenumber AS DECIMAL(10,0))) AS p, CAST(CAST(l_discount AS DECIMAL(5,2)) * CAST(l_tax AS DECIMAL(5,2)) AS DECIMAL(11,4)) AS q FROM lineitem",
       "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN CAST('60000000000000000000000000000000000000' AS DECIMAL(38,0)) END AS p, CAST(CAST(l_discount AS DECIMAL(5,2)) * CAST(l_tax AS DECIMAL(5,2)) AS DECIMAL(11,4)) AS q FROM lineitem")
C.both("expr_rlike", "SELECT row_id FROM ontime WHERE tailnum RLIKE '^N[0-9]+[A-Z]'", "SELECT row_id FROM ontime WHERE regexp_matches(tailnum, '^N[0-9]+[A-Z]')")
C.both("expr_bits", "SELECT event_id, user_id & 6 AS a, user_id | 9 AS o, user_id ^ 5 AS x, ~user_id AS n, user_id DIV 3 AS d FROM events", "SELECT event_id, user_id & 6 AS a, user_id | 9 AS o, xor(user_id, 5) AS x, ~user_id AS n, user_id // 3 AS d FROM events")
C.both("expr_concat", "SELECT c_custkey, c_name || '/' || c_mktsegment AS label FROM customer")
C.both("expr_row_values", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('A', 'F'), ('R', 'O'))")
C.both("expr_nested", "SELECT event_id, element_at(m, 'k') AS v, size(a) AS n, s.x AS x FROM (SELECT event_id, map('k', user_id) AS m, array(user_id, event_id) AS a, named_struct('x', value) AS s FROM events) t", "SELECT event_id, user_id AS v, CAST(2 AS INT) AS n, value AS x FROM events")
C.both("expr_interval", "SELECT o_orderkey, o_orderdate + INTERVAL 3 MONTH AS later, o_orderdate - INTERVAL 36 HOUR AS before FROM orders")
C.both("expr_empty_projection", "SELECT COUNT(*) AS n FROM lineitem")
C.both("expr_residual_filter", "SELECT l_orderkey FROM lineitem WHERE l_quantity > 45 AND UPPER(l_returnflag) = 'R' AND l_orderkey % 2 = 1")

# --- joins ---
C.both("join_inner", "SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey")
C.both("join_star_self_alias", "SELECT n1.n_name AS sn, n2.n_name AS cn, COUNT(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey GROUP BY n1.n_name, n2.n_name")
C.both("join_left_theta_on", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 190000 AND o_orderstatus <> 'P'")
C.both("join_right", "SELECT o_orderkey, c_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 150000) o RIGHT JOIN customer ON o_custkey = c_custkey")
C.both("join_full", "SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) s FULL JOIN (SELECT * FROM customer WHERE c_acctbal < 0) c ON s_nationkey = c_nationkey")
C.both("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
C.both("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 195000)")
C.both("join_semi_in", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
C.both("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
C.both("join_not_in_nulls", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(c_nationkey, 3) FROM customer WHERE c_nationkey < 5)")
C.both("join_not_in_values", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 2000)")
C.both("join_theta", "SELECT s.s_suppkey, n.n_nationkey FROM supplier s JOIN nation n ON s.s_nationkey < n.n_nationkey AND n.n_regionkey <> 2")
C.both("join_outer_equi_theta", "SELECT n_nationkey, s_suppkey FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > n_regionkey * 2000")
C.both("join_mixed_types", "SELECT COUNT(*) AS n FROM lineitem JOIN lineitem_rowstore r ON lineitem.l_quantity = CAST(r.l_quantity AS DOUBLE) AND lineitem.l_orderkey = r.l_orderkey AND CAST(lineitem.l_linenumber AS BIGINT) = r.l_linenumber")
C.both("join_decimal_key", "SELECT COUNT(*) AS n FROM lineitem_rowstore a JOIN lineitem_rowstore b ON a.l_extendedprice = b.l_extendedprice AND a.l_orderkey = b.l_orderkey")
C.both("join_varchar_key", "SELECT a.airport, COUNT(*) AS n FROM ontime JOIN airports a ON origin = a.airport GROUP BY a.airport")
C.both("join_datetime_key", "SELECT COUNT(*) AS n FROM orders JOIN lineitem ON o_orderdate = l_shipdate AND o_orderkey = l_orderkey")
C.both("join_bushy", "SELECT COUNT(*) AS n FROM (orders JOIN customer ON o_custkey = c_custkey) JOIN (lineitem JOIN (supplier JOIN nation ON s_nationkey = n_nationkey) ON l_suppkey = s_suppkey) ON o_orderkey = l_orderkey WHERE c_nationkey = n_nationkey")
C.both("join_using", "SELECT o_orderkey, li.n FROM orders o JOIN (SELECT l_orderkey AS o_orderkey, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey) li USING (o_orderkey)")
C.both("join_natural", "SELECT n_nationkey, c FROM nation NATURAL JOIN (SELECT s_nationkey AS n_nationkey, COUNT(*) AS c FROM supplier GROUP BY s_nationkey) s")


def not_in(rows: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows whose ``column`` is NOT IN the only column of ``values``: nulls count as in SQL, and values may be many.

    For NOT IN, Spark broadcasts every value, repeated ones too, by way of the driver. Here the distinct ones are staged
    and anti-joined, so Spark broadcasts them only where it knows that they are few, and else moves both sides by value.
    """
    found = stage(values.toDF("not_in_value").distinct(), "not_in")
    key, value = rows[column], found["not_in_value"]
    with_null = found.select(F.max(value.isNull())).scalar()  # null where there is no value at all: then each row is in
    asked = rows.filter(F.when(with_null.isNull(), True).otherwise(~with_null & key.isNotNull()))
    return asked.join(found.filter(value.isNotNull()), key == value, "left_anti")


@C.frame("join_not_in_null_left", "SELECT row_id FROM ontime WHERE depdelay NOT IN (SELECT arrdelay FROM ontime WHERE arrdelay IS NOT NULL)")
def join_not_in_null_left(spark: SparkSession, sf: str) -> DataFrame:
    ontime = table(spark, sf, "ontime")
    return not_in(ontime, "depdelay", ontime.select("arrdelay").filter("arrdelay IS NOT NULL")).select("row_id")


@C.frame("join_any", "SELECT o_orderkey, m.s AS segment FROM orders JOIN (SELECT c_custkey, MIN(c_mktsegment) AS s FROM customer GROUP BY c_custkey) m ON o_custkey = m.c_custkey")
def join_any(spark: SparkSession, sf: str) -> DataFrame:
    """At most one match for each left row: the right side is thinned to one row a key before the join."""
    one = table(spark, sf, "customer").groupBy("c_custkey").agg(F.min("c_mktsegment").alias("segment"))
    orders = table(spark, sf, "orders")
    return orders.join(one, orders.o_custkey == one.c_custkey).select("o_orderkey", "segment")


C.both("join_hinted", "SELECT /*+ BROADCAST(region) */ n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
C.both("join_two_stores", "SELECT r.l_orderkey, r.l_linenumber, r.l_quantity AS q, c.internal_version AS v FROM lineitem_rowstore r JOIN lineitem_colstore c ON r.l_orderkey = c.l_orderkey AND r.l_linenumber = c.l_linenumber")
C.both("join_disjunctive", "SELECT COUNT(*) AS n FROM lineitem, part WHERE (p_partkey = l_partkey AND p_size < 5 AND l_quantity < 10) OR (p_partkey = l_partkey AND p_size > 45 AND l_quantity > 40)")

# --- aggregates ---
C.both("agg_basic", "SELECT l_returnflag, COUNT(*) AS n, COUNT(l_quantity) AS nq, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi, ROUND(SUM(l_quantity), 2) AS s, ROUND(AVG(l_quantity), 6) AS a FROM lineitem GROUP BY l_returnflag")
C.both("agg_decimal_sum", "SELECT l_suppkey, CAST(SUM(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS s FROM lineitem GROUP BY l_suppkey")
C.both("agg_count_two", "SELECT COUNT(depdelay, arrdelay) AS n FROM ontime", "SELECT COUNT(*) FILTER (depdelay IS NOT NULL AND arrdelay IS NOT NULL) AS n FROM ontime")
C.both("agg_distinct", "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS n, COUNT(DISTINCT o_orderpriority) AS p FROM orders GROUP BY o_orderstatus")
C.both("agg_distinct_two", "SELECT COUNT(DISTINCT l_returnflag, l_linestatus) AS n FROM lineitem", "SELECT COUNT(DISTINCT (l_returnflag, l_linestatus)) AS n FROM lineitem")
C.both("agg_distinct_kinds", "SELECT l_returnflag, CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS s, ROUND(AVG(DISTINCT l_linenumber), 6) AS a, MIN(DISTINCT l_linenumber) AS lo, MAX(DISTINCT l_linenumber) AS hi FROM lineitem GROUP BY l_returnflag")
C.both("agg_bits", "SELECT event_type, BIT_AND(user_id) AS a, BIT_OR(user_id) AS o, BIT_XOR(user_id) AS x FROM events GROUP BY event_type")
C.both("agg_group_concat", "SELECT n_regionkey, LISTAGG(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names, LISTAGG(DISTINCT CAST(n_regionkey AS STRING), ',') AS k FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, STRING_AGG(n_name, ',' ORDER BY n_name) AS names, STRING_AGG(DISTINCT CAST(n_regionkey AS VARCHAR), ',') AS k FROM nation GROUP BY n_regionkey")
C.both("agg_by_expression", "SELECT CAST(YEAR(o_orderdate) AS INT) AS y, CAST(YEAR(o_orderdate) + 1 AS INT) AS next, COUNT(*) AS n FROM orders GROUP BY YEAR(o_orderdate)")
C.both("agg_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")
C.both("agg_having_subquery", "SELECT o_custkey, MAX(o_totalprice) AS m FROM orders GROUP BY o_custkey HAVING MAX(o_totalprice) > (SELECT AVG(o_totalprice) * 1.9 FROM orders)")
C.both("agg_of_agg", "SELECT MAX(n) AS most, MIN(n) AS least, ROUND(AVG(n), 6) AS mean FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) t")
C.both("agg_select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
_EVERY_TYPE = "CAST(l_linenumber AS TINYINT) AS t1, CAST(l_linenumber AS SMALLINT) AS t2, CAST(l_linenumber AS INT) AS t3, CAST(l_suppkey AS BIGINT) AS t4, CAST(l_linenumber * 0.5 AS FLOAT) AS t5, CAST(l_discount AS DOUBLE) AS t6, CAST(l_tax AS DECIMAL(5,2)) AS t7, CAST(l_discount AS DECIMAL(38,4)) AS t8, CAST('2020-01-01' AS DATE) AS t9, l_linenumber > 3 AS t12, l_returnflag AS t13, CAST(NULL AS INT) AS t15"
C.both("agg_select_distinct_types", f"SELECT t1, t2, t3, t4, t5, t6, t7, t8, t9, t10, t11, t12, t13, HEX(t14) AS t14, t15, t16.a AS t16, t17[0] AS t17 FROM (SELECT DISTINCT {_EVERY_TYPE}, CAST('2020-01-01 01:02:03' AS TIMESTAMP_NTZ) AS t10, TIMESTAMP_SECONDS(l_linenumber) AS t11, CAST(l_linestatus AS BINARY) AS t14, NAMED_STRUCT('a', l_linenumber) AS t16, ARRAY(l_returnflag) AS t17 FROM lineitem) d",
       f"SELECT DISTINCT {_EVERY_TYPE}, TIMESTAMP '2020-01-01 01:02:03' AS t10, TIMESTAMP '1970-01-01 00:00:00' + to_seconds(l_linenumber) AS t11, HEX(l_linestatus) AS t14, l_linenumber AS t16, l_returnflag AS t17 FROM lineitem")
C.both("agg_rollup", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
C.both("agg_cube", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, MAX(l_quantity) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
C.both("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
C.both("agg_conditional", "SELECT carrier, CAST(SUM(CASE WHEN depdelay > 10 THEN 1 ELSE 0 END) AS BIGINT) AS late, CAST(SUM(CAST(arrdelay > 30 AS INT)) AS BIGINT) AS very_late FROM ontime GROUP BY carrier")
C.both("agg_over_join", "SELECT n_name, COUNT(*) AS n, MIN(c_acctbal) AS lo, MAX(c_acctbal) AS hi FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
C.both("agg_empty_input", "SELECT COUNT(*) AS n, MAX(o_totalprice) AS m, SUM(o_totalprice) AS s FROM orders WHERE o_orderkey < 0")
C.both("agg_first_any", "SELECT o_custkey, FIRST(c_name) AS f, ANY_VALUE(c_acctbal) AS a FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey")
C.both("agg_statistics", "SELECT l_returnflag, ROUND(STDDEV_SAMP(l_quantity), 6) AS sd, ROUND(VAR_POP(l_quantity), 6) AS vp, ROUND(PERCENTILE(l_quantity, 0.5), 6) AS med FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, ROUND(STDDEV_SAMP(l_quantity), 6) AS sd, ROUND(VAR_POP(l_quantity), 6) AS vp, ROUND(QUANTILE_CONT(l_quantity, 0.5), 6) AS med FROM lineitem GROUP BY l_returnflag")

# --- windows ---
_BY = "PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey"
C.both("window_ranking", f"SELECT o_orderkey, CAST(ROW_NUMBER() OVER w AS BIGINT) AS rn, CAST(RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS r, CAST(DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS dr, CAST(NTILE(4) OVER w AS INT) AS nt, ROUND(PERCENT_RANK() OVER w, 9) AS pr, ROUND(CUME_DIST() OVER w, 9) AS cd FROM orders WINDOW w AS ({_BY})")
C.both("window_offsets", f"SELECT o_orderkey, LAG(o_totalprice, 1) OVER w AS prev, LEAD(o_totalprice, 2, -1.0) OVER w AS next2, FIRST_VALUE(o_orderkey) OVER w AS f, LAST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, NTH_VALUE(o_orderkey, 2) OVER w AS second FROM orders WINDOW w AS ({_BY})")
C.both("window_rows_frame", f"SELECT o_orderkey, COUNT(*) OVER ({_BY} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n, MAX(o_totalprice) OVER ({_BY} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m FROM orders")
C.both("window_range_frame", "SELECT row_id, COUNT(*) OVER (PARTITION BY origin ORDER BY distance NULLS FIRST RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS near FROM ontime WHERE distance IS NOT NULL")
C.both("window_named", "SELECT c_custkey, CAST(RANK() OVER seg AS BIGINT) AS r, COUNT(*) OVER seg AS n FROM customer WINDOW seg AS (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey)")


@C.frame("window_dedup", "SELECT l_orderkey, l_linenumber, MAX(internal_version) AS version FROM lineitem_colstore GROUP BY l_orderkey, l_linenumber")
def window_dedup(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(F.col("internal_version").desc())
    return table(spark, sf, "lineitem_colstore").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("l_orderkey", "l_linenumber", F.col("internal_version").alias("version"))


# --- sorts and limits ---
C.both("sort_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
C.both("sort_limit_of_filter", "SELECT COUNT(*) AS n FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' LIMIT 100) t")
C.both("sort_full", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey")
C.both("sort_nulls", "SELECT row_id, depdelay FROM ontime ORDER BY depdelay ASC NULLS LAST, row_id DESC LIMIT 50")
C.both("sort_nulls_first", "SELECT row_id, depdelay FROM ontime ORDER BY depdelay DESC NULLS FIRST, row_id LIMIT 50")
C.both("sort_tuple", "SELECT n_nationkey FROM nation ORDER BY struct(n_regionkey, n_name) DESC LIMIT 5", "SELECT n_nationkey FROM nation ORDER BY n_regionkey DESC, n_name DESC LIMIT 5")
C.both("sort_offset", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10 OFFSET 20")


@C.frame("sort_within_partitions", "SELECT COUNT(*) AS n, CAST(0 AS BIGINT) AS inversions FROM orders")
def sort_within_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """Distribute by a key and sort inside each partition: the order in which rows come is what is checked."""
    register(spark, sf, "orders")
    return in_order(spark.sql("SELECT o_custkey, o_totalprice FROM orders DISTRIBUTE BY o_custkey SORT BY o_custkey, o_totalprice"), ["o_custkey", "o_totalprice"])


@C.frame("sort_cluster_by", "SELECT COUNT(*) AS n, CAST(0 AS BIGINT) AS inversions FROM lineitem")
def sort_cluster_by(spark: SparkSession, sf: str) -> DataFrame:
    register(spark, sf, "lineitem")
    return in_order(spark.sql("SELECT l_suppkey FROM lineitem CLUSTER BY l_suppkey"), ["l_suppkey"])


# --- set operations ---
C.both("set_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
C.both("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
C.both("set_intersect", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 40 INTERSECT SELECT p_partkey FROM part WHERE p_size < 10")
C.both("set_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
C.both("set_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000")
C.both("set_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")

# --- subqueries ---
C.both("sub_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.9 FROM orders)")
C.both("sub_correlated_scalar", "SELECT o.o_orderkey FROM orders o WHERE o.o_totalprice = (SELECT MAX(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
C.both("sub_row_in", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_linenumber) IN (SELECT o_orderstatus, 1 FROM orders UNION SELECT 'R', 2 FROM region)")
C.both("sub_row_not_in", "SELECT n_nationkey FROM nation WHERE (n_nationkey, n_regionkey) NOT IN (SELECT s_nationkey, 1 FROM supplier)")
C.both("sub_exists_nested", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity = 50))")
C.both("sub_in_union", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 500 UNION SELECT c_nationkey FROM customer WHERE c_acctbal < -900)")
C.both("sub_in_select_list", "SELECT r_name, (SELECT COUNT(*) FROM nation WHERE n_regionkey = r_regionkey) AS n FROM region")
C.both("sub_cte_twice", "WITH spent AS (SELECT o_custkey, SUM(CAST(o_totalprice AS DECIMAL(15,2))) AS s FROM orders GROUP BY o_custkey) SELECT a.o_custkey FROM spent a WHERE a.s > (SELECT AVG(b.s) * 2 FROM spent b)")
C.both("sub_from_first", "FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) t SELECT n, COUNT(*) AS customers GROUP BY n", "SELECT n, COUNT(*) AS customers FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) t GROUP BY n")
C.both("sub_lateral_view", "SELECT n_nationkey, word FROM nation LATERAL VIEW explode(split(n_name, '_')) w AS word", "SELECT n_nationkey, unnest(string_split(n_name, '_')) AS word FROM nation")
C.both("sub_lateral_outer", "SELECT n_nationkey, x FROM nation LATERAL VIEW OUTER explode(CASE WHEN n_regionkey = 1 THEN array(n_regionkey) END) w AS x", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN n_regionkey END AS x FROM nation")


@C.frame("sub_view", "SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey")
def sub_view(spark: SparkSession, sf: str) -> DataFrame:
    """A view used as a common table expression."""
    table(spark, sf, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n")).createOrReplaceTempView("nations_by_region")
    return spark.sql("SELECT n_regionkey, n FROM nations_by_region")


# --- sources that need no table, samples ---
C.both("source_values", "SELECT * FROM VALUES (1, 'a'), (2, 'b'), (3, NULL) AS t(k, v)", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(k, v)")
C.both("source_range", "SELECT id FROM range(0, 1000, 7)", "SELECT range AS id FROM range(0, 1000, 7)")
C.both("source_table_statement", "TABLE region")


@C.frame("source_sample")
def source_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A sampling operator: half of the rows, by a seeded hash of each row, so that it is the same rows each time."""
    return table(spark, sf, "nation").filter(F.pmod(F.xxhash64("n_nationkey", F.lit(7)), F.lit(2)) == 0).select("n_nationkey")


C.both("source_tablesample_rows", "SELECT COUNT(*) AS n FROM (SELECT * FROM orders TABLESAMPLE (120 ROWS)) t", "SELECT CAST(120 AS BIGINT) AS n")
C.both("source_tablesample_whole", "SELECT o_orderkey FROM orders TABLESAMPLE (100 PERCENT)", "SELECT o_orderkey FROM orders")


@C.frame("source_tablesample_bounds", "SELECT TRUE AS fifth, TRUE AS bucket, TRUE AS same, TRUE AS own")
def source_tablesample_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Samples can't be fixed rows: their sizes lie near what is asked for (a bucket of x out of y is x / y of the rows), one seed gives the same rows, and all are rows of the table."""
    register(spark, sf, "orders")
    take = lambda how: f"(SELECT o_orderkey FROM orders TABLESAMPLE ({how}) REPEATABLE (7))"
    n, fifth, bucket = "(SELECT COUNT(*) FROM orders)", f"(SELECT COUNT(*) FROM {take('20 PERCENT')} a)", f"(SELECT COUNT(*) FROM {take('BUCKET 3 OUT OF 8')} b)"
    near = lambda x, part: f"{x} BETWEEN {n} * {part} * 0.7 AND {n} * {part} * 1.3"
    same = f"(SELECT COUNT(*) FROM {take('20 PERCENT')} a JOIN {take('20 PERCENT')} b USING (o_orderkey)) = {fifth}"
    own = f"(SELECT COUNT(*) FROM {take('20 PERCENT')} a JOIN orders USING (o_orderkey)) = {fifth}"
    return spark.sql(f"SELECT {near(fifth, 0.2)} AS fifth, {near(bucket, 0.375)} AS bucket, {same} AS same, {own} AS own")


C.queries["source_tablesample"] = run_sql("SELECT c_custkey FROM customer TABLESAMPLE (20 PERCENT) REPEATABLE (7)")
C.both("source_transform", "SELECT TRANSFORM(n_nationkey, n_name) USING 'cat' AS (k STRING, v STRING) FROM nation", "SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS v FROM nation")


@C.frame("source_pandas_function", "SELECT s_suppkey, s_acctbal * 2 AS twice FROM supplier")
def source_pandas_function(spark: SparkSession, sf: str) -> DataFrame:
    """A vectorised user function, called from SQL."""
    register_vectorised(spark, "brindle_twice", lambda s: s * 2, "double")
    return run_sql("SELECT s_suppkey, brindle_twice(s_acctbal) AS twice FROM supplier")(spark, sf)


C.both("events_tumbling", "SELECT window.start AS start, event_type, COUNT(*) AS n FROM events GROUP BY window(ts, '1 hour'), event_type", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, COUNT(*) AS n FROM events GROUP BY ALL")
