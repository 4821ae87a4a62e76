"""The 22 decision-support queries, on the tables at hand.

Substitutions, where a column is not there: partsupp is the distinct (part, supplier) of lineitem with
quantity and cost by a rule; commit and receipt dates, ship modes and comments come from
lineitem_rowstore; a customer's country code is its nation. Dates lie in 1995 to 2001.
Money is summed as decimals, so that results don't depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.plans.sqlquery import Catalogue, run_sql
from brindle.session import stage

C = Catalogue()
QUERIES, SQL = C.queries, C.sql

_PRICE, _DISC, _TAX, _QTY = (f"CAST(l_{c} AS DECIMAL(15,2))" for c in ("extendedprice", "discount", "tax", "quantity"))
_REV = f"{_PRICE} * (1 - {_DISC})"
_PS = "ps AS (SELECT ps_partkey, ps_suppkey, (ps_partkey * 7 + ps_suppkey * 3) % 1000 AS ps_availqty, CAST(((ps_partkey * 13 + ps_suppkey * 17) % 10000) AS DECIMAL(15,2)) / 100 AS ps_supplycost FROM (SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey FROM lineitem) d)"


def _money(x: str) -> str:
    return f"CAST(ROUND({x}, 2) AS DOUBLE)"


C.both("tpch_q1", f"""SELECT l_returnflag, l_linestatus, {_money(f"SUM({_QTY})")} AS sum_qty, {_money(f"SUM({_PRICE})")} AS sum_base_price, {_money(f"SUM({_REV})")} AS sum_disc_price,
  {_money(f"SUM(CAST({_REV} AS DECIMAL(18,4)) * (1 + {_TAX}))")} AS sum_charge, ROUND(CAST(SUM({_QTY}) AS DOUBLE) / COUNT(*), 4) AS avg_qty, ROUND(CAST(SUM({_PRICE}) AS DOUBLE) / COUNT(*), 4) AS avg_price,
  ROUND(CAST(SUM({_DISC}) AS DOUBLE) / COUNT(*), 6) AS avg_disc, COUNT(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""")  # fmt: skip
C.both("tpch_q2", f"""WITH {_PS}, asia AS (SELECT ps_partkey, ps_suppkey, ps_supplycost, s_name, s_acctbal, n_name FROM ps JOIN supplier ON s_suppkey = ps_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')
SELECT s_acctbal, s_name, n_name, p_partkey, CAST(ps_supplycost AS DOUBLE) AS ps_supplycost FROM part JOIN asia a ON p_partkey = ps_partkey
WHERE p_size = 30 AND p_type LIKE '%O%' AND ps_supplycost = (SELECT MIN(b.ps_supplycost) FROM asia b WHERE b.ps_partkey = p_partkey) ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""")  # fmt: skip
C.both("tpch_q3", f"""SELECT l_orderkey, {_money(f"SUM({_REV})")} AS revenue, o_orderdate FROM customer, orders, lineitem
WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""")
C.both("tpch_q4", """SELECT o_orderpriority, COUNT(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1996-07-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-10-01 00:00:00'
  AND EXISTS (SELECT 1 FROM lineitem_rowstore WHERE l_orderkey = o_orderkey AND l_commitdate < l_receiptdate) GROUP BY o_orderpriority ORDER BY o_orderpriority""")
C.both("tpch_q5", f"""SELECT n_name, {_money(f"SUM({_REV})")} AS revenue FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'
  AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' GROUP BY n_name ORDER BY revenue DESC""")
C.both("tpch_q6", f"""SELECT {_money(f"SUM({_PRICE} * {_DISC})")} AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00' AND {_DISC} BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
C.both("tpch_q7", f"""SELECT supp_nation, cust_nation, l_year, {_money("SUM(volume)")} AS revenue FROM (
  SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(YEAR(l_shipdate) AS INT) AS l_year, {_REV} AS volume FROM supplier, lineitem, orders, customer, nation n1, nation n2
  WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
    AND ((n1.n_name = 'NATION_3' AND n2.n_name = 'NATION_7') OR (n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_3')) AND l_shipdate BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1997-12-31 00:00:00') AS shipping
GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""")
C.both("tpch_q8", f"""SELECT o_year, ROUND(CAST(SUM(CASE WHEN nation = 'NATION_8' THEN volume ELSE 0 END) AS DOUBLE) / CAST(SUM(volume) AS DOUBLE), 6) AS mkt_share FROM (
  SELECT CAST(YEAR(o_orderdate) AS INT) AS o_year, {_REV} AS volume, n2.n_name AS nation FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
  WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND r_name = 'ASIA'
    AND s_nationkey = n2.n_nationkey AND o_orderdate BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1997-12-31 00:00:00' AND p_type = 'SMALL') AS all_nations GROUP BY o_year ORDER BY o_year""")
C.both("tpch_q9", f"""WITH {_PS} SELECT nation, o_year, {_money("SUM(amount)")} AS sum_profit FROM (
  SELECT n_name AS nation, CAST(YEAR(o_orderdate) AS INT) AS o_year, {_REV} - CAST(ps_supplycost AS DECIMAL(15,4)) * {_QTY} AS amount FROM part, supplier, lineitem, ps, orders, nation
  WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%old%') AS profit
GROUP BY nation, o_year ORDER BY nation, o_year DESC""")
C.both("tpch_q10", f"""SELECT c_custkey, c_name, {_money(f"SUM({_REV})")} AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= TIMESTAMP '1996-10-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' AND l_returnflag = 'R' AND c_nationkey = n_nationkey
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
C.both("tpch_q11", f"""WITH {_PS}, own AS (SELECT ps_partkey, SUM(CAST(ps_supplycost AS DECIMAL(15,4)) * ps_availqty) AS value FROM ps, supplier, nation WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_5' GROUP BY ps_partkey)
SELECT ps_partkey, {_money("value")} AS value FROM own WHERE value > (SELECT SUM(value) * 0.0001 FROM own) ORDER BY value DESC, ps_partkey""")
C.both("tpch_q12", """SELECT rtrim(l_shipmode) AS l_shipmode, CAST(SUM(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
  CAST(SUM(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count FROM orders, lineitem_rowstore
WHERE o_orderkey = l_orderkey AND rtrim(l_shipmode) IN ('MAIL', 'SHIP') AND l_commitdate < l_receiptdate AND l_shipdate < l_commitdate AND l_receiptdate >= DATE '1996-01-01' AND l_receiptdate < DATE '1997-01-01' GROUP BY rtrim(l_shipmode) ORDER BY l_shipmode""")
C.both("tpch_q13", """SELECT c_count, COUNT(*) AS custdist FROM (SELECT c_custkey, COUNT(o_orderkey) AS c_count FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) c_orders
GROUP BY c_count ORDER BY custdist DESC, c_count DESC""")
C.both("tpch_q14", f"""SELECT ROUND(100.00 * CAST(SUM(CASE WHEN p_type LIKE 'PROMO%' THEN {_REV} ELSE 0 END) AS DOUBLE) / CAST(SUM({_REV}) AS DOUBLE), 6) AS promo_revenue FROM lineitem, part
WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1996-09-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-10-01 00:00:00'""")
C.both("tpch_q15", f"""WITH revenue0 AS (SELECT l_suppkey AS supplier_no, SUM({_REV}) AS total_revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-07-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-10-01 00:00:00' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, {_money("total_revenue")} AS total_revenue FROM supplier, revenue0 WHERE s_suppkey = supplier_no AND total_revenue = (SELECT MAX(total_revenue) FROM revenue0) ORDER BY s_suppkey""")
C.both("tpch_q16", f"""WITH {_PS} SELECT p_brand, p_type, p_size, COUNT(DISTINCT ps_suppkey) AS supplier_cnt FROM ps, part WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#13' AND p_type NOT LIKE 'LARGE%' AND p_size IN (48, 19, 12, 4, 41, 7, 21, 39)
  AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""")
C.both("tpch_q17", f"""SELECT ROUND(CAST(SUM({_PRICE}) AS DOUBLE) / 7.0, 4) AS avg_yearly FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity < (SELECT 0.2 * AVG(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)""")
C.both("tpch_q18", f"""SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, {_money(f"SUM({_QTY})")} AS sum_qty FROM customer, orders, lineitem
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM({_QTY}) > 300) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""")
C.both("tpch_q19", f"""SELECT {_money(f"SUM({_REV})")} AS revenue FROM lineitem, part WHERE (p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15)
  OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 20) OR (p_partkey = l_partkey AND p_brand = 'Brand#5' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 30)""")
C.both("tpch_q20", f"""WITH {_PS}, sold AS (SELECT l_partkey, l_suppkey, SUM({_QTY}) AS qty FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00' GROUP BY l_partkey, l_suppkey)
SELECT s_name, s_acctbal FROM supplier, nation WHERE s_suppkey IN (SELECT ps_suppkey FROM ps JOIN sold ON l_partkey = ps_partkey AND l_suppkey = ps_suppkey WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'cold%') AND ps_availqty > 0.5 * qty)
  AND s_nationkey = n_nationkey AND n_name IN ('NATION_3', 'NATION_4', 'NATION_5', 'NATION_6') ORDER BY s_name""")
C.both("tpch_q21", """SELECT s_name, COUNT(*) AS numwait FROM supplier, lineitem_rowstore l1, orders, nation WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_receiptdate > l1.l_commitdate
  AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM lineitem_rowstore l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_receiptdate > l3.l_commitdate)
  AND s_nationkey = n_nationkey AND n_name IN ('NATION_1', 'NATION_2', 'NATION_3') GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""")
C.both("tpch_q22", f"""SELECT cntrycode, COUNT(*) AS numcust, {_money("SUM(c_acctbal)")} AS totacctbal FROM (SELECT c_nationkey AS cntrycode, CAST(c_acctbal AS DECIMAL(15,2)) AS c_acctbal FROM customer WHERE c_nationkey IN (2, 3, 9, 13, 17, 18, 23)
  AND c_acctbal > (SELECT AVG(c_acctbal) FROM customer WHERE c_acctbal > 0.00 AND c_nationkey IN (2, 3, 9, 13, 17, 18, 23)) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1999-01-01 00:00:00')) AS custsale
GROUP BY cntrycode ORDER BY cntrycode""")


_STAGED: dict[tuple[str, str], DataFrame] = {}


def partsupp(spark: SparkSession, sf: str) -> DataFrame:
    """The stand-in for partsupp as a table: made from the line items once for each session and folder, as a loaded table would be."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STAGED:
        _STAGED[key] = stage(run_sql(_PS.removeprefix("ps AS (").removesuffix(")"))(spark, sf), "partsupp")
    return _STAGED[key]


def _over_partsupp(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query whose first common table expression is the stand-in, over the staged table."""
    rest = text.replace(f"WITH {_PS}, ", "WITH ", 1).replace(f"WITH {_PS} ", "", 1)

    def query(spark: SparkSession, sf: str) -> DataFrame:
        partsupp(spark, sf).createOrReplaceTempView("ps")
        return run_sql(rest)(spark, sf)

    return query


for _name, _text in SQL.items():
    if _PS in _text:
        QUERIES[_name] = _over_partsupp(_text)
