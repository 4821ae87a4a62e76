"""More functions of the dialect over whole tables, their values as documented, and the largest rows of each family."""

from __future__ import annotations

from brindle.plans.scalar import QUERIES, SQL, dialect

__all__ = ["QUERIES", "SQL"]  # with those of ``scalar``

# --- values that the dialect's manual gives: expression, text of the value ---
_MATH = [
    ("ROUND(ASIN(0.2), 9)", "0.201357921"), ("ASIN('foo')", "0.0"), ("ROUND(ATAN(2), 9)", "1.107148718"), ("CEIL(-1.23)", "-1"), ("CONV('6E', 18, 8)", "172"), ("CRC32('MySQL')", "3259397556"), ("CRC32('mysql')", "2501908538"), ("LOG(10, 100)", "2.0"), ("POWER(2, -2)", "0.25"), ("TRUNCATE(1.223, 1)", "1.2"),
    ("TRUNCATE(1.999, 0)", "1"), ("TRUNCATE(-1.999, 1)", "-1.9"), ("TRUNCATE(122, -2)", "100"), ("TRUNCATE(10.28 * 100, 0)", "1028"), ("TRUNCATE(0.29, 2)", "0.29"), ("MOD(34.5, 3)", "1.5"), ("GREATEST(2, 0)", "2"), ("LEAST(34.0, 3.0, 5.0)", "3.0"), ("INTERVAL(23, 1, 15, 17, 30, 44, 200)", "3"),
]
_STRING = [
    ("BIN(12)", "1100"), ("BIT_LENGTH('text')", "32"), ("CHARACTER_LENGTH('text')", "4"), ("CHAR_LENGTH('text')", "4"), ("EXPORT_SET(5, 'Y', 'N', ',', 4)", "Y,N,Y,N"), ("EXPORT_SET(6, '1', '0', ',', 10)", "0,1,1,0,0,0,0,0,0,0"), ("FORMAT(12332.123456, 4)", "12,332.1235"), ("FORMAT(12332.1, 4)", "12,332.1000"),
    ("FORMAT(12332.2, 0)", "12,332"), ("FORMAT(2.5, 0)", "3"), ("LOWER('QUADRATICALLY')", "quadratically"), ("MAKE_SET(1, 'a', 'b', 'c')", "a"), ("MAKE_SET(1 | 4, 'hello', 'nice', 'world')", "hello,world"), ("MAKE_SET(1 | 4, 'hello', 'nice', NULL, 'world')", "hello"), ("OCT(12)", "14"), ("OCTET_LENGTH('text')", "4"),
    ("ORD('2')", "50"), ("POSITION('bar' IN 'foobarbar')", "4"), ("QUOTE(NULL)", "NULL"), ("CONCAT('[', SPACE(6), ']')", "[      ]"), ("SUBSTR('Quadratically', 5, 6)", "ratica"), ("SUBSTR('Sakila', -3)", "ila"), ("UCASE('Hej')", "HEJ"), ("HEX(UNHEX('4D7953514C'))", "4D7953514C"), ("'Monty!' REGEXP '.*'", "true"), ("HEX(BINARY 'a')", "61"),
]
_DATE = [
    ("ADDDATE('2008-01-02', INTERVAL 31 DAY)", "2008-02-02"), ("ADDDATE('2008-01-02', 31)", "2008-02-02"), ("ADDTIME('2007-12-31 23:59:59', '1:1:1')", "2008-01-01 01:01:00"), ("CONVERT_TZ('2004-01-01 12:00:00', '+00:00', '+10:00')", "2004-01-01 22:00:00"), ("DATE('2003-12-31 01:02:03')", "2003-12-31"), ("DAY('2007-02-03')", "3"),
    ("FROM_DAYS(730669)", "2000-07-03"), ("FROM_UNIXTIME(1447430881)", "2015-11-13 16:08:01"), ("GET_FORMAT(DATE, 'EUR')", "%d.%m.%Y"), ("HOUR('10:05:03')", "10"), ("HOUR('272:59:59')", "272"), ("TIME_FORMAT(MAKETIME(12, 15, 30), '%T')", "12:15:30"), ("MICROSECOND('2019-12-31 23:59:59.000010')", "10"), ("MINUTE('2008-02-03 10:05:03')", "5"),
    ("SECOND('10:05:03')", "3"), ("TIME_FORMAT(SEC_TO_TIME(2378), '%T')", "00:39:38"), ("STR_TO_DATE('01,5,2013', '%d,%m,%Y')", "2013-05-01"), ("TIME_FORMAT(STR_TO_DATE('a09:30:17', 'a%H:%i:%s'), '%T')", "09:30:17"), ("SUBDATE('2008-01-02', INTERVAL 31 DAY)", "2007-12-02"), ("SUBTIME('2007-12-31 23:59:59', '1:1:1')", "2007-12-31 22:58:58"),
    ("TIME_FORMAT(TIME('2003-12-31 01:02:03'), '%T')", "01:02:03"), ("TIME_TO_SEC(TIMEDIFF('2000-01-01 00:00:00', '2000-01-01 00:00:30'))", "-30"), ("TIMESTAMP('2003-12-31')", "2003-12-31 00:00:00"), ("TIMESTAMP('2003-12-31 12:00:00', '12:00:00')", "2004-01-01 00:00:00"), ("TIMESTAMPADD(MINUTE, 1, '2003-01-02')", "2003-01-02 00:01:00"),
    ("TIME_FORMAT('100:00:00', '%H %k %h %I %l')", "100 100 04 04 4"), ("TIME_TO_SEC('22:23:00')", "80580"), ("TO_SECONDS('2009-11-29')", "63426672000"), ("UNIX_TIMESTAMP('2015-11-13 10:20:19')", "1447410019"), ("WEEK('2008-02-20', 1)", "8"), ("WEEK('2008-12-31', 1)", "53"),
]
_TYPING = [
    ("'12abc' + 1", "13"), ("1 = '1x'", "true"), ("'a' || 'b'", "false"), ("'1a' || 'b'", "true"), ("GREATEST(1, '2')", "2"), ("'x' = 0", "true"), ("- '3 x'", "-3"), ("NOT 'a'", "true"), ("'7 up' DIV 2", "3"), ("DATE '2024-03-05' + 0", "20240305"), ("(1 = 1) + 1", "2"), ("NULL IS UNKNOWN", "true"), ("1 IS TRUE", "true"), ("0 IS TRUE", "false"),
    ("JSON_EXTRACT('{\"a\": \"x\"}', '$.a')", '"x"'), ("JSON_UNQUOTE(JSON_EXTRACT('{\"a\": \"x\"}', '$.a'))", "x"), ("JSON_EXTRACT('[10, 20, [30, 40]]', '$[2][1]')", "40"), ("JSON_EXTRACT('{\"a\": \"k_2\"}', '$.a') = 'k_2'", "true"), ("JSON_EXTRACT('{\"b\": {\"key\": 7}}', '$.b.key') = 7", "true"),
]


def _documented(name: str, cases: list[tuple[str, str | None]]) -> None:
    want = ", ".join(f"{'CAST(NULL AS VARCHAR)' if v is None else chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39)} AS v{i}" for i, (_, v) in enumerate(cases))
    dialect(name, f"SELECT {', '.join(f'CAST({e} AS CHAR) AS v{i}' for i, (e, _) in enumerate(cases))}", f"SELECT {want}")


for _name, _cases in {"fn_manual_math": _MATH, "fn_manual_string": _STRING, "fn_manual_date": _DATE, "fn_manual_typing": _TYPING}.items():
    _documented(_name, _cases)

# --- over whole tables, dirty columns among them ---
dialect("fn_math_more", "SELECT event_id, ROUND(ASIN(user_id - 5), 9) AS asi, ROUND(ATAN(value), 9) AS ata, CEIL(value) AS cei, CONV(user_id, 10, 2) AS con, ROUND(LOG(2, value + 1), 9) AS lg, ROUND(LOG(value + 1), 9) AS l, POWER(user_id, 2) AS po, TRUNCATE(value, 1) AS tr, TRUNCATE(user_id, -1) AS ti FROM events",
        "SELECT event_id, CASE WHEN abs(user_id - 5) <= 1 THEN round(asin(user_id - 5), 9) END AS asi, round(atan(value), 9) AS ata, CAST(ceil(value) AS BIGINT) AS cei, bin(user_id) AS con, round(log2(value + 1), 9) AS lg, round(ln(value + 1), 9) AS l, CAST(user_id * user_id AS DOUBLE) AS po, CAST(trunc(CAST(CAST(value AS VARCHAR) AS DECIMAL(30,15)) * 10) / 10 AS DOUBLE) AS tr, user_id // 10 * 10 AS ti FROM events")
dialect("fn_string_more", "SELECT row_id, BIN(row_id) AS bi, BIT_LENGTH(tailnum) AS bl, CHARACTER_LENGTH(origincityname) AS ch, CHAR_LENGTH(destcityname) AS cl, OCTET_LENGTH(origincityname) AS ol, LOWER(tailnum) AS lo, UCASE(origin) AS uc, OCT(row_id) AS oc, ORD(NULLIF(tailnum, '')) AS o, POSITION('1' IN tailnum) AS po, QUOTE(tailnum) AS qu, tailnum REGEXP '^N[0-9]+[A-Z]' AS re, SUBSTR(tailnum, 2, 3) AS su, HEX(UNHEX(HEX(tailnum))) AS un, CONCAT('[', SPACE(cancelled + 1), ']') AS sp, MAKE_SET(row_id, 'a', 'b', 'c') AS ms, EXPORT_SET(row_id, 'Y', 'N', ',', 3) AS es, FORMAT(distance * 10.5, 1) AS fo, HEX(BINARY flightnum) AS by FROM ontime",
        "SELECT row_id, bin(row_id) AS bi, CAST(8 * strlen(tailnum) AS INT) AS bl, CAST(length(origincityname) AS INT) AS ch, CAST(length(destcityname) AS INT) AS cl, CAST(strlen(origincityname) AS INT) AS ol, lower(tailnum) AS lo, upper(origin) AS uc, format('{:o}', row_id) AS oc, CAST('0x' || hex(left(nullif(tailnum, ''), 1)) AS BIGINT) AS o, CAST(instr(tailnum, '1') AS INT) AS po, CASE WHEN tailnum IS NULL THEN 'NULL' ELSE '''' || replace(replace(tailnum, '\\', '\\\\'), '''', '\\''') || '''' END AS qu, regexp_matches(tailnum, '^N[0-9]+[A-Z]') AS re, substr(tailnum, 2, 3) AS su, hex(tailnum) AS un, '[' || repeat(' ', cancelled + 1) || ']' AS sp, array_to_string(list_filter([CASE WHEN row_id & 1 > 0 THEN 'a' END, CASE WHEN row_id & 2 > 0 THEN 'b' END, CASE WHEN row_id & 4 > 0 THEN 'c' END], lambda x: x IS NOT NULL), ',') AS ms, concat(CASE WHEN row_id & 1 > 0 THEN 'Y' ELSE 'N' END, ',', CASE WHEN row_id & 2 > 0 THEN 'Y' ELSE 'N' END, ',', CASE WHEN row_id & 4 > 0 THEN 'Y' ELSE 'N' END) AS es, format('{:,.1f}', distance * 10.5::DOUBLE) AS fo, hex(flightnum) AS by FROM ontime")
dialect("fn_truth", "SELECT row_id, depdelay IS TRUE AS a, depdelay IS FALSE AS b, depdelay IS UNKNOWN AS c, depdelay IS NOT TRUE AS d, flightnum IS TRUE AS e, depdelay AND cancelled AS f, NOT arrdelay AS g FROM ontime",
        "SELECT row_id, coalesce(depdelay <> 0, FALSE) AS a, coalesce(depdelay = 0, FALSE) AS b, depdelay IS NULL AS c, coalesce(depdelay = 0, TRUE) AS d, coalesce(coalesce(try_cast(regexp_extract(flightnum, '^\\s*([0-9]+)', 1) AS INT), 0) <> 0 AND flightnum IS NOT NULL, FALSE) AS e, (depdelay <> 0) AND (cancelled <> 0) AS f, arrdelay = 0 AS g FROM ontime")
_N = "CASE WHEN {c} IS NOT NULL THEN coalesce(try_cast(nullif(regexp_extract({c}, '^\\s*([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)', 1), '') AS DOUBLE), 0) END"
dialect("fn_implicit_numbers", "SELECT row_id, tailnum + 1 AS a, flightnum * 2 AS b, tailnum > 0 AS c, flightnum = distance AS d, flightdate + 0 AS e, flightdate > 20030101 AS f, GREATEST(flightnum, 500) AS g, SQRT(flightnum) AS h, flightnum % 7 AS i, flightnum DIV 10 AS j FROM ontime",
        f"SELECT row_id, {_N.format(c='tailnum')} + 1 AS a, {_N.format(c='flightnum')} * 2 AS b, {_N.format(c='tailnum')} > 0 AS c, {_N.format(c='flightnum')} = distance AS d, CAST(strftime(flightdate, '%Y%m%d') AS BIGINT) AS e, flightdate > DATE '2003-01-01' AS f, CASE WHEN flightnum IS NOT NULL THEN greatest({_N.format(c='flightnum')}, 500) END AS g, sqrt({_N.format(c='flightnum')}) AS h, {_N.format(c='flightnum')} % 7 AS i, CAST(trunc({_N.format(c='flightnum')} / 10) AS BIGINT) AS j FROM ontime")
dialect("fn_date_more", "SELECT o_orderkey, ADDDATE(o_orderdate, 5) AS ad, ADDTIME(o_orderdate, '1:30:00') AS atm, SUBTIME(o_orderdate, '0:00:01') AS st, CONVERT_TZ(o_orderdate, '+00:00', '+05:30') AS tz, DATE(o_orderdate) AS d, DAY(o_orderdate) AS dy, FROM_DAYS(TO_DAYS(o_orderdate) + 1) AS fd, UNIX_TIMESTAMP(o_orderdate) AS un, UNIX_TIMESTAMP(FROM_UNIXTIME(o_orderkey)) AS fu, STR_TO_DATE(DATE_FORMAT(o_orderdate, '%d.%m.%Y'), '%d.%m.%Y') AS sd, SUBDATE(o_orderdate, INTERVAL 1 WEEK) AS sb, TIMESTAMP(DATE(o_orderdate)) AS ts, TIMESTAMP(DATE(o_orderdate), '12:00:00') AS t2, TIMESTAMPADD(MINUTE, 5, o_orderdate) AS ta, TO_SECONDS(o_orderdate) AS sec, WEEK(o_orderdate, 3) AS w, DATE_FORMAT(o_orderdate, GET_FORMAT(DATE, 'USA')) AS gf FROM orders",
        "SELECT o_orderkey, o_orderdate + INTERVAL 5 DAY AS ad, o_orderdate + INTERVAL 90 MINUTE AS atm, o_orderdate - INTERVAL 1 SECOND AS st, o_orderdate + INTERVAL 330 MINUTE AS tz, CAST(o_orderdate AS DATE) AS d, CAST(day(o_orderdate) AS INT) AS dy, CAST(o_orderdate AS DATE) + 1 AS fd, CAST(epoch(o_orderdate) AS BIGINT) AS un, o_orderkey AS fu, CAST(o_orderdate AS DATE) AS sd, o_orderdate - INTERVAL 7 DAY AS sb, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, date_trunc('day', o_orderdate)::TIMESTAMP + INTERVAL 12 HOUR AS t2, o_orderdate + INTERVAL 5 MINUTE AS ta, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 719528 AS BIGINT) * 86400 + CAST(epoch(o_orderdate) AS BIGINT) % 86400 AS sec, CAST(weekofyear(o_orderdate) AS INT) AS w, strftime(o_orderdate, '%m.%d.%Y') AS gf FROM orders")
dialect("fn_time", "SELECT event_id, HOUR(ts) AS h, MINUTE(ts) AS m, SECOND(ts) AS s, MICROSECOND(ts) AS mi, TIME_TO_SEC(TIME(ts)) AS ti, TIME_TO_SEC(MAKETIME(HOUR(ts), MINUTE(ts), 7)) AS mk, TIME_TO_SEC(SEC_TO_TIME(user_id * 100)) AS st, TIME_FORMAT(SEC_TO_TIME(user_id * 3600), '%H:%i:%s') AS tf, TIME_TO_SEC(TIMEDIFF(ts, '2024-01-01 00:00:00')) AS td FROM events",
        "SELECT event_id, CAST(hour(ts) AS INT) AS h, CAST(minute(ts) AS INT) AS m, CAST(second(ts) AS INT) AS s, CAST(microsecond(ts) % 1000000 AS INT) AS mi, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INT) AS ti, CAST(hour(ts) * 3600 + minute(ts) * 60 + 7 AS INT) AS mk, CAST(user_id * 100 AS INT) AS st, format('{:02d}:00:00', user_id) AS tf, CAST(trunc(epoch(ts) - epoch(TIMESTAMP '2024-01-01 00:00:00')) AS INT) AS td FROM events")
dialect("fn_json_text", "SELECT event_id, JSON_EXTRACT(CONCAT('{\"a\": \"', event_type, '\", \"n\": ', user_id, '}'), '$.a') AS q, JSON_UNQUOTE(JSON_EXTRACT(CONCAT('{\"a\": \"', event_type, '\"}'), '$.a')) AS u, JSON_EXTRACT(props, '$.k') + 1 AS n, JSON_EXTRACT(CONCAT('{\"a\": \"', event_type, '\"}'), '$.a') = 'click' AS c, CONCAT('[', user_id, ', [\"x\"]]')->>'$[1][0]' AS x FROM events",
        "SELECT event_id, '\"' || event_type || '\"' AS q, event_type AS u, CAST(json_extract(props, '$.k') AS DOUBLE) + 1 AS n, event_type = 'click' AS c, 'x' AS x FROM events")
dialect("fn_any_value", "SELECT o_custkey, ANYVALUE(c_name) AS a, FIRST(c_mktsegment) AS f FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey", "SELECT o_custkey, MIN(c_name) AS a, MAX(c_mktsegment) AS f FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey")
dialect("dialect_any_join_repeated", "SELECT o_orderkey, l_linenumber, l_quantity FROM orders ANY INNER JOIN (SELECT l_orderkey AS o_orderkey, l_linenumber, l_quantity FROM lineitem) l USING (o_orderkey)",
        "SELECT o_orderkey, m.l_linenumber, m.l_quantity FROM orders JOIN (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) = 1) m ON l_orderkey = o_orderkey")
dialect("dialect_any_left_join", "SELECT c_custkey, o.o_orderkey FROM customer c ANY LEFT JOIN (SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 100000) o ON c.c_custkey = o.o_custkey",
        "SELECT c_custkey, (SELECT MIN(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) AS o_orderkey FROM customer")

# --- the first rows by an expression of each family ---
dialect("topn_arith", "SELECT event_id, value / (user_id % 3) AS field1 FROM events WHERE user_id MOD 4 ORDER BY field1 DESC, event_id LIMIT 20", "SELECT event_id, value / NULLIF(user_id % 3, 0) AS field1 FROM events WHERE user_id % 4 <> 0 ORDER BY field1 DESC NULLS LAST, event_id LIMIT 20")
dialect("topn_logical", "SELECT row_id, depdelay > 10 XOR arrdelay > 10 AS field1 FROM ontime WHERE cancelled || diverted ORDER BY field1, row_id LIMIT 15", "SELECT row_id, (depdelay > 10) <> (arrdelay > 10) AS field1 FROM ontime WHERE cancelled <> 0 OR diverted <> 0 ORDER BY field1 NULLS FIRST, row_id LIMIT 15")
dialect("topn_compare", "SELECT row_id, GREATEST(depdelay, arrdelay) AS field1 FROM ontime WHERE depdelay <=> arrdelay OR origin BETWEEN 'A' AND 'M' ORDER BY field1, row_id DESC LIMIT 12", "SELECT row_id, CASE WHEN depdelay IS NOT NULL AND arrdelay IS NOT NULL THEN greatest(depdelay, arrdelay) END AS field1 FROM ontime WHERE depdelay IS NOT DISTINCT FROM arrdelay OR origin BETWEEN 'A' AND 'M' ORDER BY field1 NULLS FIRST, row_id DESC LIMIT 12")
dialect("topn_cast", "SELECT row_id, CAST(flightnum AS SIGNED) AS field1 FROM ontime ORDER BY field1 DESC, row_id LIMIT 9", f"SELECT row_id, CAST({_N.format(c='flightnum')} AS BIGINT) AS field1 FROM ontime ORDER BY field1 DESC NULLS LAST, row_id LIMIT 9")
dialect("topn_math", "SELECT event_id, ROUND(SQRT(value), 6) AS field1 FROM events WHERE TRUNCATE(value, -1) MOD 20 ORDER BY field1 DESC, event_id LIMIT 5, 10", "SELECT event_id, round(sqrt(value), 6) AS field1 FROM events WHERE CAST(floor(value / 10) AS BIGINT) % 2 <> 0 ORDER BY field1 DESC, event_id LIMIT 10 OFFSET 5")
dialect("topn_date", "SELECT o_orderkey, YEARWEEK(o_orderdate, 3) AS field1, DATE_ADD(o_orderdate, INTERVAL 1 QUARTER) AS field2 FROM orders ORDER BY field1 DESC, field2, o_orderkey LIMIT 25", "SELECT o_orderkey, CAST(isoyear(o_orderdate) * 100 + weekofyear(o_orderdate) AS INT) AS field1, o_orderdate + INTERVAL 3 MONTH AS field2 FROM orders ORDER BY field1 DESC, field2, o_orderkey LIMIT 25")
dialect("topn_string", "SELECT row_id, SUBSTRING_INDEX(origincityname, ',', 1) AS field1, REVERSE(tailnum) AS field2 FROM ontime WHERE origincityname LIKE '%o%' ORDER BY field1, field2 DESC, row_id LIMIT 30", "SELECT row_id, split_part(origincityname, ',', 1) AS field1, reverse(tailnum) AS field2 FROM ontime WHERE origincityname LIKE '%o%' ORDER BY field1 NULLS FIRST, field2 DESC NULLS LAST, row_id LIMIT 30")
dialect("topn_string_length", "SELECT c_custkey, CHAR_LENGTH(c_name) AS field1, LPAD(c_mktsegment, 12, '.') AS field2 FROM customer ORDER BY field1 DESC, field2, c_custkey LIMIT 11", "SELECT c_custkey, CAST(length(c_name) AS INT) AS field1, lpad(c_mktsegment, 12, '.') AS field2 FROM customer ORDER BY field1 DESC, field2, c_custkey LIMIT 11")
