"""Function families and statements of the row store's dialect over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.functions.dialect import kinds_of, to_spark
from brindle.plans.sqlquery import Catalogue, run_sql, tables_of
from brindle.session import table

C = Catalogue()
QUERIES, SQL = C.queries, C.sql


def dialect(name: str, text: str, other: str) -> None:
    """A query in the dialect, rewritten when it runs; ``other`` has the same meaning in standard SQL."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        kinds = kinds_of(*[table(spark, sf, n).schema for n in tables_of(text)])
        return run_sql(to_spark(text, kinds=kinds))(spark, sf)

    C.queries[name], C.sql[name] = query, other


dialect("fn_arith", "SELECT event_id, value / (user_id % 3) AS d, value % 7 AS m, user_id DIV (event_id % 4) AS q, MOD(user_id, 5) AS r FROM events",
        "SELECT event_id, value / NULLIF(user_id % 3, 0) AS d, value % 7 AS m, user_id // NULLIF(event_id % 4, 0) AS q, user_id % 5 AS r FROM events")
dialect("fn_math", "SELECT event_id, ABS(value - 100) AS a, CEILING(value) AS c, FLOOR(value) AS f, ROUND(SQRT(value - 50), 9) AS s, ROUND(LN(value + 1), 9) AS l, ROUND(LOG10(value + 1), 9) AS l10, ROUND(LOG2(value + 1), 9) AS l2, SIGN(value - 100) AS g, ROUND(POW(user_id, 2), 3) AS p, ROUND(ACOS(user_id - 5), 9) AS ac, ROUND(ATAN2(value, 3), 9) AS at, ROUND(DEGREES(1) + RADIANS(90), 9) AS dr, ROUND(SIN(value) + COS(value) + TAN(1) + COT(1), 9) AS trig, ROUND(EXP(1) + PI(), 9) AS e FROM events",
        "SELECT event_id, abs(value - 100) AS a, CAST(ceil(value) AS BIGINT) AS c, CAST(floor(value) AS BIGINT) AS f, CASE WHEN value >= 50 THEN round(sqrt(value - 50), 9) END AS s, round(ln(value + 1), 9) AS l, round(log10(value + 1), 9) AS l10, round(log2(value + 1), 9) AS l2, CAST(sign(value - 100) AS DOUBLE) AS g, round(pow(user_id, 2), 3) AS p, CASE WHEN abs(user_id - 5) <= 1 THEN round(acos(user_id - 5), 9) END AS ac, round(atan2(value, 3), 9) AS at, round(degrees(1) + radians(90), 9) AS dr, round(sin(value) + cos(value) + tan(1) + cot(1), 9) AS trig, round(exp(1) + pi(), 9) AS e FROM events")
dialect("fn_bits", "SELECT event_id, user_id & 12 AS a, user_id << 2 AS l, user_id >> 1 AS r, event_id << 64 AS z, user_id ^ 3 AS x, ~user_id AS n FROM events",
        "SELECT event_id, user_id & 12 AS a, user_id << 2 AS l, user_id >> 1 AS r, CAST(0 AS BIGINT) AS z, xor(user_id, 3) AS x, CAST(18446744073709551615 - user_id AS DECIMAL(20,0)) AS n FROM events")
dialect("fn_logic", "SELECT row_id FROM ontime WHERE depdelay > 10 XOR arrdelay > 10 && !(cancelled = 1)",
        "SELECT row_id FROM ontime WHERE (depdelay > 10) <> (arrdelay > 10 AND NOT (cancelled = 1))")
dialect("fn_compare", "SELECT row_id, GREATEST(depdelay, arrdelay, 0) AS g, LEAST(depdelay, arrdelay) AS l, INTERVAL(depdelay, 0, 10, 30) AS i, depdelay <=> arrdelay AS same, ISNULL(depdelay) AS n, STRCMP(origin, dest) AS c FROM ontime",
        "SELECT row_id, CASE WHEN depdelay IS NULL OR arrdelay IS NULL THEN NULL ELSE greatest(depdelay, arrdelay, 0) END AS g, CASE WHEN depdelay IS NULL OR arrdelay IS NULL THEN NULL ELSE least(depdelay, arrdelay) END AS l, CAST(CASE WHEN depdelay IS NULL THEN -1 WHEN depdelay < 0 THEN 0 WHEN depdelay < 10 THEN 1 WHEN depdelay < 30 THEN 2 ELSE 3 END AS INT) AS i, depdelay IS NOT DISTINCT FROM arrdelay AS same, depdelay IS NULL AS n, CAST(CASE WHEN origin = dest THEN 0 WHEN origin < dest THEN -1 WHEN origin > dest THEN 1 END AS INT) AS c FROM ontime")
dialect("fn_string", "SELECT c_custkey, CONCAT(c_name, '-', c_mktsegment) AS c, CONCAT_WS('/', c_name, NULL, 'x') AS w, LENGTH(c_name) AS n, UPPER(c_name) AS u, LCASE(c_mktsegment) AS l, LEFT(c_name, 4) AS lf, RIGHT(c_name, 4) AS rt, SUBSTRING(c_name, 0, 3) AS s0, MID(c_name, 3, 4) AS m, LPAD(c_custkey, 8, '0') AS lp, REPLACE(c_name, 'Cust', 'K') AS rp, REVERSE(c_mktsegment) AS rv, INSTR(c_name, '#') AS i, LOCATE('0', c_name, 12) AS lc, SUBSTRING_INDEX(c_name, '#', 1) AS si, REPEAT('ab', 2) AS re, ELT(c_nationkey, 'a', 'b') AS e, FIELD(c_mktsegment, 'BUILDING', 'MACHINERY') AS f, INSERT(c_name, 3, 100, 'Z') AS ins, TRIM(LEADING 'Cu' FROM c_name) AS t, FIND_IN_SET('b', 'a,b,c') AS fs, ASCII(c_name) AS a, HEX(c_custkey) AS h FROM customer",
        "SELECT c_custkey, c_name || '-' || c_mktsegment AS c, c_name || '/x' AS w, CAST(strlen(c_name) AS INT) AS n, upper(c_name) AS u, lower(c_mktsegment) AS l, left(c_name, 4) AS lf, right(c_name, 4) AS rt, '' AS s0, substr(c_name, 3, 4) AS m, CASE WHEN length(CAST(c_custkey AS VARCHAR)) > 8 THEN left(CAST(c_custkey AS VARCHAR), 8) ELSE lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS lp, replace(c_name, 'Cust', 'K') AS rp, reverse(c_mktsegment) AS rv, CAST(instr(c_name, '#') AS INT) AS i, CAST(CASE WHEN instr(substr(c_name, 12), '0') > 0 THEN instr(substr(c_name, 12), '0') + 11 ELSE 0 END AS INT) AS lc, split_part(c_name, '#', 1) AS si, 'abab' AS re, CASE c_nationkey WHEN 1 THEN 'a' WHEN 2 THEN 'b' END AS e, CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS INT) AS f, left(c_name, 2) || 'Z' AS ins, regexp_replace(c_name, '^(Cu)+', '') AS t, CAST(2 AS INT) AS fs, CAST(ascii(c_name) AS INT) AS a, upper(hex(c_custkey)) AS h FROM customer")
dialect("fn_date", "SELECT o_orderkey, YEAR(o_orderdate) AS y, QUARTER(o_orderdate) AS q, MONTH(o_orderdate) AS m, DAYOFMONTH(o_orderdate) AS d, DAYOFWEEK(o_orderdate) AS dw, WEEKDAY(o_orderdate) AS wd, DAYOFYEAR(o_orderdate) AS dy, WEEKOFYEAR(o_orderdate) AS w, DAYNAME(o_orderdate) AS dn, MONTHNAME(o_orderdate) AS mn, LAST_DAY(o_orderdate) AS ld, DATEDIFF(o_orderdate, '1996-01-01') AS dd, TO_DAYS(o_orderdate) AS td, DATE_FORMAT(o_orderdate, '%Y/%m/%d') AS df, DATE_ADD(o_orderdate, INTERVAL 1 MONTH) AS da, DATE_SUB(o_orderdate, INTERVAL '1:30' HOUR_MINUTE) AS ds, TIMESTAMPDIFF(DAY, '1995-01-01', o_orderdate) AS ts, EXTRACT(YEAR_MONTH FROM o_orderdate) AS ym, MAKEDATE(YEAR(o_orderdate), 60) AS mk, YEARWEEK(o_orderdate, 3) AS yw FROM orders",
        "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(dayofweek(o_orderdate) + 1 AS INT) AS dw, CAST(isodow(o_orderdate) - 1 AS INT) AS wd, CAST(dayofyear(o_orderdate) AS INT) AS dy, CAST(weekofyear(o_orderdate) AS INT) AS w, dayname(o_orderdate) AS dn, monthname(o_orderdate) AS mn, last_day(o_orderdate) AS ld, CAST(date_diff('day', DATE '1996-01-01', o_orderdate) AS INT) AS dd, CAST(date_diff('day', DATE '1970-01-01', o_orderdate) + 719528 AS INT) AS td, strftime(o_orderdate, '%Y/%m/%d') AS df, o_orderdate + INTERVAL 1 MONTH AS da, o_orderdate - INTERVAL 90 MINUTE AS ds, date_diff('day', DATE '1995-01-01', o_orderdate) AS ts, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT) AS ym, make_date(year(o_orderdate), 1, 1) + 59 AS mk, CAST(isoyear(o_orderdate) * 100 + weekofyear(o_orderdate) AS INT) AS yw FROM orders")
dialect("fn_cast", "SELECT row_id, CAST(tailnum AS SIGNED) AS n, CAST(flightnum AS UNSIGNED) AS u, CAST(flightnum AS DECIMAL(10,2)) AS d, CAST(origincityname AS CHAR(5)) AS c, CONVERT(flightnum, SIGNED) AS s FROM ontime",
        "SELECT row_id, CASE WHEN tailnum IS NOT NULL THEN coalesce(try_cast(nullif(regexp_extract(tailnum, '^\\s*([+-]?[0-9]*[.]?[0-9]+)', 1), '') AS BIGINT), 0) END AS n, CASE WHEN flightnum IS NOT NULL THEN CAST(coalesce(try_cast(nullif(regexp_extract(flightnum, '^\\s*([+-]?[0-9]*[.]?[0-9]+)', 1), '') AS BIGINT), 0) AS DECIMAL(20,0)) END AS u, CASE WHEN flightnum IS NOT NULL THEN CAST(coalesce(try_cast(nullif(regexp_extract(flightnum, '^\\s*([+-]?[0-9]*[.]?[0-9]+)', 1), '') AS DECIMAL(10,2)), 0) AS DECIMAL(10,2)) END AS d, left(origincityname, 5) AS c, CASE WHEN flightnum IS NOT NULL THEN coalesce(try_cast(nullif(regexp_extract(flightnum, '^\\s*([+-]?[0-9]*[.]?[0-9]+)', 1), '') AS BIGINT), 0) END AS s FROM ontime")
dialect("fn_json", "SELECT event_id, JSON_EXTRACT(props, '$.k') AS k, props->'$.k' AS k2, JSON_UNQUOTE(JSON_EXTRACT(props, '$.none')) AS n FROM events WHERE JSON_EXTRACT(props, '$.k') > 50",
        "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k') AS k2, CAST(NULL AS VARCHAR) AS n FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
dialect("dialect_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20, 10", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10 OFFSET 20")
dialect("dialect_all_any", "SELECT o_orderkey FROM orders WHERE o_totalprice >= ALL (SELECT o_totalprice FROM orders WHERE o_orderstatus = 'P') OR o_custkey = ANY (SELECT c_custkey FROM customer WHERE c_acctbal < -990)",
        "SELECT o_orderkey FROM orders WHERE o_totalprice >= ALL (SELECT o_totalprice FROM orders WHERE o_orderstatus = 'P') OR o_custkey = ANY (SELECT c_custkey FROM customer WHERE c_acctbal < -990)")
dialect("dialect_straight_join", "SELECT /*+ read_from_storage(columns[o, c]) */ STRAIGHT_JOIN c_custkey, o_orderkey FROM customer c STRAIGHT_JOIN orders o ON c_custkey = o_custkey WHERE o_totalprice > 190000", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 190000")
dialect("dialect_any_join", "SELECT o_custkey, n FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) a ANY INNER JOIN (SELECT c_custkey AS o_custkey FROM customer) b USING (o_custkey)", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey")
dialect("dialect_group_concat", "SELECT n_regionkey, GROUP_CONCAT(n_name, n_nationkey ORDER BY n_name SEPARATOR ';') AS g FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name || n_nationkey, ';' ORDER BY n_name) AS g FROM nation GROUP BY n_regionkey")
dialect("dialect_sum_bool", "SELECT carrier, SUM(arrdelayminutes > 30) AS late, COUNT(*) AS n FROM ontime GROUP BY carrier", "SELECT carrier, CAST(sum(CAST(arrdelayminutes > 30 AS INT)) AS BIGINT) AS late, count(*) AS n FROM ontime GROUP BY carrier")
dialect("dialect_bit_aggregates", "SELECT event_type, BIT_OR(user_id) AS o, BIT_XOR(user_id) AS x, BIT_AND(user_id) AS a FROM events GROUP BY event_type", "SELECT event_type, bit_or(user_id) AS o, bit_xor(user_id) AS x, CAST(bit_and(user_id) AS DECIMAL(20,0)) AS a FROM events GROUP BY event_type")
