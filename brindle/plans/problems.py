"""The queries of problems 1, 2, 4 and 5 over the flight and lineitem tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.copydiff import Copy, compare_copies
from brindle.operators.hotkeys import clean_code, dominant, key_totals
from brindle.operators.profile import ColumnRule, Profile, bad_cells, load_findings, profile_loads
from brindle.operators.rawlines import LineField, parse_lines, read_records
from brindle.session import shared_path, table

# The forms that the test data's description states.
TAIL = "N[1-9](?:[0-9]{0,4}|[0-9]{0,3}[A-HJ-NP-Z]|[0-9]{0,2}[A-HJ-NP-Z]{2})"
SIX_DIGITS = "[0-9]{1,6}"
CITY = r""" *[\p{L}.'\-/"][\p{L} .'\-/"]*, [A-Z]{2}"""
FLIGHT_LINE = [
    LineField("flightdate", "[0-9]{4}-[0-9]{2}-[0-9]{2}", "date", (1987, 2029)),
    LineField("uniquecarrier", r"[A-Z0-9]{2}(?: \([1-9]\))?"),
    LineField("airlineid", SIX_DIGITS, "int"),
    LineField("tailnum", f"(?:{TAIL})?"),
    LineField("flightnum", SIX_DIGITS, "int"),
    LineField("origin", "[A-Z]{3}"),
    LineField("origincityname", CITY),
    LineField("dest", "[A-Z]{3}"),
    LineField("destcityname", CITY),
    LineField("depdelay", f"(?:-?{SIX_DIGITS})?", "int"),
    LineField("cancelled", "[01]", "int"),
    LineField("distance", SIX_DIGITS, "int"),
]
ROW_FIELDS = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "l_commitdate", "l_receiptdate", "l_shipinstruct", "l_shipmode", "l_comment"]


def _rules(spark: SparkSession, sf: str) -> list[ColumnRule]:
    return [
        ColumnRule("tailnum", pattern=TAIL),
        ColumnRule("originstatefips", allowed=table(spark, sf, "airports").select("state_fips")),
        ColumnRule("airlineid", allowed=table(spark, sf, "carriers").select("airlineid"), numeric=True),
    ]


def _profile(spark: SparkSession, sf: str) -> Profile:
    return profile_loads(table(spark, sf, "ontime"), table(spark, sf, "ontime_loads"), _rules(spark, sf))


def p1_profile(spark: SparkSession, sf: str) -> DataFrame:
    p = _profile(spark, sf).loads
    pairs = ((F.col("n_rows") - F.col("n_missing")) * (F.col("prev_rows") - F.col("prev_missing"))).cast("double")
    q = [F.col("quantiles")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))]
    return p.select(
        "column_name", F.col("load").alias("load_id"), "n_rows", "n_missing", "n_distinct", "top_count", "min_value", "max_value", *q,
        F.round(F.col("l1").cast("double") / pairs, 9).alias("l1_distance"), F.round(F.col("ks").cast("double") / pairs, 9).alias("ks_distance"),
    )


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    profile = _profile(spark, sf)
    on_loads = load_findings(profile, shift_columns=("originstatefips", "airlineid"), stuck_columns=("tailnum",))
    cells = bad_cells(table(spark, sf, "ontime"), profile, _rules(spark, sf), "load_id", "row_id").select("column_name", F.lit("bad_value").alias("finding"), F.col("load").alias("load_id"), F.col("row").alias("row_id"))
    return cells.union(on_loads.select("column_name", "finding", F.col("load").alias("load_id"), F.lit(-1).cast("long").alias("row_id")))


def p1_bad_values(spark: SparkSession, sf: str) -> DataFrame:
    return _profile(spark, sf).bad_values


def p1_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Loads whose cumulative curve is half or more away from that of the load before."""
    return load_findings(_profile(spark, sf), drift=(1, 2)).filter("finding = 'drift'").select("column_name", F.col("load").alias("load_id"))


def _flight_keys(spark: SparkSession, sf: str) -> DataFrame:
    return key_totals(
        table(spark, sf, "ontime"),
        {k: clean_code(F.col(k)) for k in ("origin", "uniquecarrier")},
        {"cancelled": F.col("cancelled"), "depdelay": F.col("depdelay")},
    )


def p2_keys(spark: SparkSession, sf: str) -> DataFrame:
    t = _flight_keys(spark, sf).filter("key_value is not null")
    return t.select("key_field", "key_value", F.col("n_rows").alias("flights"), F.coalesce("cancelled_sum", F.lit(0)).alias("cancellations"), F.round(F.col("depdelay_sum") / F.col("depdelay_count"), 6).alias("mean_depdelay"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return dominant(_flight_keys(spark, sf), table(spark, sf, "ontime").count(), (5, 100))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return parse_lines(table(spark, sf, "ontime_raw"), "raw_line", FLIGHT_LINE, ["raw_id", "load_id", "line_no"])


def p4_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).filter("reason is null").drop("reason")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).filter("reason is not null").select("raw_id", "reason")


_CITIES = [LineField("row_id", "[0-9]+", "long"), LineField("cities", "(?s:.*)"), LineField("tailnum", "(?s:.*)")]


def p4_records(spark: SparkSession, sf: str) -> DataFrame:
    """All flights written to files with line breaks and quotes inside a quoted field, and read back."""
    quoted = lambda *parts: F.concat(F.lit('"'), F.replace(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", F.col("row_id").cast("string"), quoted(F.col("origincityname"), F.col("destcityname")), quoted(F.col("tailnum")))
    path = shared_path(spark, "flights")
    table(spark, sf, "ontime").select(line.alias("value")).write.text(path)
    return parse_lines(read_records(spark, path), "record", _CITIES, []).filter("reason is null").drop("reason")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    rows, columns = table(spark, sf, "lineitem_rowstore"), table(spark, sf, "lineitem_colstore")
    return compare_copies(
        Copy(rows), Copy(columns, "internal_version", "internal_delmark"), ["l_orderkey", "l_linenumber"], ROW_FIELDS, names=("rowstore", "colstore")
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_profile, p1_bad_values, p1_drift, p2_found, p2_keys, p4_found, p4_rows, p4_records, p5_found)}

_TAIL_SQL = "N[1-9]([0-9]{0,4}|[0-9]{0,3}[A-HJ-NP-Z]|[0-9]{0,2}[A-HJ-NP-Z]{2})"
_CELLS = """
cells AS (
  SELECT load_id, row_id, 'tailnum' AS column_name, CASE WHEN trim(tailnum, ' ') <> '' THEN tailnum END AS v FROM ontime
  UNION ALL SELECT load_id, row_id, 'originstatefips', CASE WHEN trim(originstatefips, ' ') <> '' THEN originstatefips END FROM ontime
  UNION ALL SELECT load_id, row_id, 'airlineid', CAST(airlineid AS VARCHAR) FROM ontime),
t AS (SELECT column_name, load_id, count(*) AS n, count(*) - count(v) AS miss, count(v) AS pres FROM cells GROUP BY ALL),
h AS (SELECT column_name, load_id, v, count(*) AS c FROM cells WHERE v IS NOT NULL GROUP BY ALL),
pairs AS (SELECT t.column_name, t.load_id, t.n, t.miss, t.pres, p.load_id AS prev, p.n AS pn, p.miss AS pmiss, p.pres AS ppres
  FROM t LEFT JOIN ontime_loads l ON l.load_id = t.load_id LEFT JOIN t p ON p.load_id = l.prev_load_id AND p.column_name = t.column_name),
ev AS (SELECT column_name, load_id, v, sum(a) AS a, sum(b) AS b FROM (
    SELECT column_name, load_id, v, c AS a, 0 AS b FROM h
    UNION ALL SELECT q.column_name, q.load_id, h.v, 0, h.c FROM pairs q JOIN h ON h.column_name = q.column_name AND h.load_id = q.prev) GROUP BY ALL),
l1 AS (SELECT ev.column_name, ev.load_id, sum(abs(CAST(a AS HUGEINT) * ppres - CAST(b AS HUGEINT) * pres)) AS l1, max(a) AS top, count(*) FILTER (a > 0) AS nd
  FROM ev JOIN pairs q ON q.column_name = ev.column_name AND q.load_id = ev.load_id GROUP BY ALL)"""

_RAW_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_SPLIT = "^" + ",".join(['("(?:[^"]|"")*"|[^",]*)'] * 12) + "$"
_NAMES = [f.name for f in FLIGHT_LINE]
_PATTERNS = {
    "uniquecarrier": r"[A-Z0-9]{2}( \([1-9]\))?", "airlineid": SIX_DIGITS, "tailnum": f"({_TAIL_SQL})?", "flightnum": SIX_DIGITS, "origin": "[A-Z]{3}", "origincityname": CITY.replace("'", "''"),
    "dest": "[A-Z]{3}", "destcityname": CITY.replace("'", "''"), "depdelay": f"(-?{SIX_DIGITS})?", "cancelled": "[01]", "distance": SIX_DIGITS,
}
_PARSED = f"""
ln AS (SELECT raw_id, load_id, line_no, regexp_replace(coalesce(raw_line, ''), '\\r$', '') AS s FROM ontime_raw),
q AS (SELECT *, regexp_full_match(s, '{_RAW_FIELD}(,{_RAW_FIELD})*', 's') AS quoted,
  length(regexp_replace(s, '"([^"]|"")*"', '', 'gs')) - length(replace(regexp_replace(s, '"([^"]|"")*"', '', 'gs'), ',', '')) AS commas FROM ln),
f AS (SELECT *, regexp_extract(s, '{_SPLIT}', {_NAMES}, 's') AS x FROM q WHERE quoted AND commas = 11),
u AS (SELECT raw_id, load_id, line_no, {", ".join(f"CASE WHEN x.{n} LIKE '\"%' THEN replace(substr(x.{n}, 2, length(x.{n}) - 2), '\"\"', '\"') ELSE x.{n} END AS {n}" for n in _NAMES)} FROM f),
ok AS (SELECT * FROM u WHERE regexp_full_match(flightdate, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast(flightdate AS DATE) BETWEEN DATE '1987-01-01' AND DATE '2029-12-31'
  AND {" AND ".join(f"regexp_full_match({n}, '{p}', 's')" for n, p in _PATTERNS.items())})"""
_KEYS = """
k AS (SELECT 'origin' AS key_field, upper(trim(origin, ' ')) AS key_value, cancelled, depdelay FROM ontime
  UNION ALL SELECT 'uniquecarrier', upper(trim(uniquecarrier, ' ')), cancelled, depdelay FROM ontime)"""


def _p5_sql() -> str:
    def norm(source: str) -> str:
        out = []
        for f in ROW_FIELDS:
            if f in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"):
                out.append(f"CAST({f} AS DECIMAL(15,2)) AS {f}")
            elif f in ("l_shipdate", "l_commitdate", "l_receiptdate"):
                out.append(f"CAST({f} AS DATE) AS {f}")
            else:
                out.append(f"rtrim({f}, ' ') AS {f}" if f in ("l_returnflag", "l_linestatus", "l_shipinstruct", "l_shipmode", "l_comment") else f)
        return f"SELECT DISTINCT l_orderkey, l_linenumber, {', '.join(out)} FROM {source}"

    latest = "(SELECT * FROM lineitem_colstore QUALIFY rank() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY internal_version DESC) = 1) WHERE internal_delmark = 0"
    on = "r.l_orderkey = c.l_orderkey AND r.l_linenumber = c.l_linenumber"
    diffs = " UNION ALL ".join(f"SELECT r.l_orderkey, r.l_linenumber, '{f}' AS diff_field FROM r JOIN c ON {on} WHERE r.{f} IS DISTINCT FROM c.{f}" for f in ROW_FIELDS)
    return f"""WITH r AS ({norm("lineitem_rowstore")}), c AS ({norm(latest)})
SELECT l_orderkey, l_linenumber, 'missing_in_colstore' AS diff_field FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE {on})
UNION ALL SELECT l_orderkey, l_linenumber, 'missing_in_rowstore' FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE {on})
UNION ALL {diffs}"""


SQL = {
    "p1_found": f"""WITH {_CELLS}
SELECT column_name, 'bad_value' AS finding, load_id, row_id FROM cells WHERE v IS NOT NULL AND NOT CASE column_name
  WHEN 'tailnum' THEN regexp_full_match(v, '{_TAIL_SQL}', 's') WHEN 'originstatefips' THEN v IN (SELECT state_fips FROM airports) ELSE v IN (SELECT CAST(airlineid AS VARCHAR) FROM carriers) END
UNION ALL SELECT column_name, 'missing_jump', load_id, -1 FROM pairs WHERE (miss * pn - pmiss * n) * 100 >= n * pn * 15
UNION ALL SELECT q.column_name, 'shift', q.load_id, -1 FROM pairs q JOIN l1 USING (column_name, load_id) WHERE q.column_name <> 'tailnum' AND pres > 0 AND ppres > 0 AND l1 * 10 >= pres * ppres * 7
UNION ALL SELECT q.column_name, 'stuck', q.load_id, -1 FROM pairs q JOIN l1 USING (column_name, load_id) WHERE q.column_name = 'tailnum' AND pres > 0 AND top * 10 >= pres""",
    "p1_bad_values": f"""WITH {_CELLS} SELECT DISTINCT column_name, v AS value FROM cells WHERE v IS NOT NULL AND NOT CASE column_name
  WHEN 'tailnum' THEN regexp_full_match(v, '{_TAIL_SQL}', 's') WHEN 'originstatefips' THEN v IN (SELECT state_fips FROM airports) ELSE v IN (SELECT CAST(airlineid AS VARCHAR) FROM carriers) END""",
    "p1_drift": f"""WITH {_CELLS},
cum AS (SELECT ev.column_name, ev.load_id, pres, ppres, sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM ev JOIN pairs q USING (column_name, load_id)
  WINDOW w AS (PARTITION BY ev.column_name, ev.load_id ORDER BY CASE WHEN ev.column_name = 'airlineid' THEN CAST(v AS DOUBLE) END, v ROWS UNBOUNDED PRECEDING))
SELECT column_name, load_id FROM cum WHERE pres > 0 AND ppres > 0 GROUP BY ALL HAVING max(abs(ca * ppres - cb * pres)) * 2 >= any_value(pres) * any_value(ppres)""",
    "p1_profile": f"""WITH {_CELLS},
ord AS (SELECT ev.*, pres, ppres, CASE WHEN ev.column_name = 'airlineid' THEN CAST(v AS DOUBLE) END AS num FROM ev JOIN pairs q USING (column_name, load_id)),
cum AS (SELECT *, sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM ord WINDOW w AS (PARTITION BY column_name, load_id ORDER BY num, v ROWS UNBOUNDED PRECEDING)),
st AS (SELECT column_name, load_id, max(abs(ca * ppres - cb * pres)) AS ks,
  arg_min(v, ca) FILTER (a > 0) AS min_value, arg_max(v, ca) FILTER (a > 0) AS max_value,
  arg_min(v, ca) FILTER (a > 0 AND ca >= ceil(0.25 * pres)) AS q25, arg_min(v, ca) FILTER (a > 0 AND ca >= ceil(0.5 * pres)) AS q50, arg_min(v, ca) FILTER (a > 0 AND ca >= ceil(0.75 * pres)) AS q75 FROM cum GROUP BY ALL)
SELECT q.column_name, q.load_id, q.n AS n_rows, q.miss AS n_missing, coalesce(nd, 0) AS n_distinct, CAST(coalesce(top, 0) AS BIGINT) AS top_count, min_value, max_value, q25, q50, q75,
  CASE WHEN pres > 0 AND ppres > 0 THEN round(CAST(l1 AS DOUBLE) / CAST(pres * ppres AS DOUBLE), 9) END AS l1_distance,
  CASE WHEN pres > 0 AND ppres > 0 THEN round(CAST(ks AS DOUBLE) / CAST(pres * ppres AS DOUBLE), 9) END AS ks_distance
FROM pairs q LEFT JOIN l1 USING (column_name, load_id) LEFT JOIN st USING (column_name, load_id)""",
    "p2_found": f"WITH {_KEYS} SELECT key_field, key_value FROM k WHERE key_value <> '' GROUP BY ALL HAVING count(*) * 20 >= (SELECT count(*) FROM ontime)",
    "p2_keys": f"WITH {_KEYS} SELECT key_field, key_value, count(*) AS flights, CAST(coalesce(sum(cancelled), 0) AS BIGINT) AS cancellations, round(avg(depdelay), 6) AS mean_depdelay FROM k WHERE key_value <> '' GROUP BY ALL",
    "p4_found": f"""WITH {_PARSED} SELECT raw_id, CASE WHEN NOT quoted THEN 'quoting' WHEN commas <> 11 THEN 'column_count' ELSE 'value' END AS reason FROM q WHERE raw_id NOT IN (SELECT raw_id FROM ok)""",
    "p4_rows": f"""WITH {_PARSED} SELECT raw_id, load_id, line_no, CAST(flightdate AS DATE) AS flightdate, uniquecarrier, CAST(airlineid AS INTEGER) AS airlineid, nullif(tailnum, '') AS tailnum, CAST(flightnum AS INTEGER) AS flightnum,
  origin, origincityname, dest, destcityname, CAST(nullif(depdelay, '') AS INTEGER) AS depdelay, CAST(cancelled AS INTEGER) AS cancelled, CAST(distance AS INTEGER) AS distance FROM ok""",
    "p4_records": "SELECT row_id, coalesce(origincityname, '') || chr(10) || coalesce(destcityname, '') AS cities, nullif(tailnum, '') AS tailnum FROM ontime",
    "p5_found": _p5_sql(),
}
