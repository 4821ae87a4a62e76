"""Scalar functions of the row-store SQL dialect as Spark SQL expressions.

Every function maps the SQL texts of its arguments to the text of one built-in Spark expression, so it
stays inside Catalyst and code generation. Guards give what the dialect gives where Spark raises an error
or counts differently: null for a division by zero, for a bad date or an argument out of range.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

Args = list[str]
FUNCTIONS: dict[str, Callable[[Args], str]] = {}

# The dialect's format codes as Spark datetime patterns.
DATE_CODES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "k": "H", "h": "hh", "I": "hh", "l": "h", "i": "mm", "s": "ss", "S": "ss", "f": "SSSSSS", "p": "a", "W": "EEEE", "a": "EEE", "M": "MMMM", "b": "MMM", "j": "DDD", "T": "HH:mm:ss", "r": "hh:mm:ss a",
}
# Named formats.
GET_FORMATS = {
    ("DATE", "USA"): "%m.%d.%Y", ("DATE", "JIS"): "%Y-%m-%d", ("DATE", "ISO"): "%Y-%m-%d", ("DATE", "EUR"): "%d.%m.%Y", ("DATE", "INTERNAL"): "%Y%m%d", ("DATETIME", "USA"): "%Y-%m-%d %H.%i.%s", ("DATETIME", "JIS"): "%Y-%m-%d %H:%i:%s",
    ("DATETIME", "ISO"): "%Y-%m-%d %H:%i:%s", ("DATETIME", "EUR"): "%Y-%m-%d %H.%i.%s", ("DATETIME", "INTERNAL"): "%Y%m%d%H%i%s", ("TIME", "USA"): "%h:%i:%s %p", ("TIME", "JIS"): "%H:%i:%s", ("TIME", "ISO"): "%H:%i:%s", ("TIME", "EUR"): "%H.%i.%s", ("TIME", "INTERNAL"): "%H%i%s",
}
# Which simple units make up a composite one, first to last.
COMPOSITE = {
    "SECOND_MICROSECOND": ("SECOND", "MICROSECOND"), "MINUTE_MICROSECOND": ("MINUTE", "SECOND", "MICROSECOND"), "MINUTE_SECOND": ("MINUTE", "SECOND"), "HOUR_MICROSECOND": ("HOUR", "MINUTE", "SECOND", "MICROSECOND"), "HOUR_SECOND": ("HOUR", "MINUTE", "SECOND"),
    "HOUR_MINUTE": ("HOUR", "MINUTE"), "DAY_MICROSECOND": ("DAY", "HOUR", "MINUTE", "SECOND", "MICROSECOND"), "DAY_SECOND": ("DAY", "HOUR", "MINUTE", "SECOND"), "DAY_MINUTE": ("DAY", "HOUR", "MINUTE"), "DAY_HOUR": ("DAY", "HOUR"), "YEAR_MONTH": ("YEAR", "MONTH"),
}
_WIDTH = {"MICROSECOND": 10**6, "SECOND": 100, "MINUTE": 100, "HOUR": 100, "DAY": 100, "MONTH": 100}


def _simple(**templates: str) -> None:
    """Functions of a fixed number of arguments: a template with {0}, {1} ..."""
    for name, t in templates.items():
        FUNCTIONS[name] = lambda a, t=t: t.format(*a)


def _same(*names: str) -> None:
    for name in names:
        FUNCTIONS[name] = lambda a, n=name: f"{n}({', '.join(a)})"


def define(*names: str) -> Callable:
    def keep(f: Callable[[Args], str]) -> Callable[[Args], str]:
        for n in names:
            FUNCTIONS[n] = f
        return f

    return keep


def literal(text: str) -> str | None:
    """The value of a SQL string literal, or None for anything else."""
    m = re.fullmatch(r"\s*'((?:[^']|'')*)'\s*", text)
    return m[1].replace("''", "'") if m else None


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# --- arithmetic, math ---
_same("ABS", "ATAN2", "CEIL", "CEILING", "COS", "COT", "DEGREES", "EXP", "FLOOR", "LN", "LOG10", "LOG2", "PI", "POW", "POWER", "RADIANS", "SIGN", "SIN", "TAN", "RAND")
_simple(
    ACOS="IF(ABS({0}) > 1, NULL, ACOS({0}))",
    ASIN="IF(ABS({0}) > 1, NULL, ASIN({0}))",
    SQRT="IF({0} < 0, NULL, SQRT({0}))",
    MOD="try_mod({0}, {1})",
    CRC32="CRC32(CAST(CAST({0} AS STRING) AS BINARY))",
    CONV="CONV(CAST({0} AS STRING), {1}, {2})",
)


@define("TRUNCATE")
def _truncate(a: Args) -> str:
    """Towards zero. With a number of digits that is written out the value keeps its type, and decimals stay exact: it is rounded, and where that went away from zero one last digit is taken off."""
    x, n = a
    digits = re.fullmatch(r"\(?- ?(\d+)\)?|(\d+)", n.strip())
    if not digits:
        return f"(SIGN({x}) * FLOOR(ABS({x}) * POW(10, {n})) / POW(10, {n}))"
    d = -int(digits[1]) if digits[1] else int(digits[2])
    d = max(-18, min(d, 30))
    unit, r = f"{Decimal(1).scaleb(-d):f}", f"ROUND({x}, {d})"
    return f"CASE WHEN {x} > 0 AND {r} > {x} THEN ROUND({r} - {unit}, {d}) WHEN {x} < 0 AND {r} < {x} THEN ROUND({r} + {unit}, {d}) ELSE {r} END"


@define("ATAN")
def _atan(a: Args) -> str:
    return f"ATAN2({a[0]}, {a[1]})" if len(a) == 2 else f"ATAN({a[0]})"


@define("LOG")
def _log(a: Args) -> str:
    return f"IF({a[0]} <= 1 AND ({a[0]} = 1 OR {a[0]} <= 0) OR {a[1]} <= 0, NULL, LOG({a[0]}, {a[1]}))" if len(a) == 2 else f"LN({a[0]})"


@define("ROUND")
def _round(a: Args) -> str:
    return f"ROUND({', '.join(a)})"


# --- comparison and control ---
_same("COALESCE", "IFNULL", "NULLIF", "ISNULL", "IF")


def _any_null(a: Args) -> str:
    return " OR ".join(f"{x} IS NULL" for x in a)


@define("GREATEST")
def _greatest(a: Args) -> str:
    return f"IF({_any_null(a)}, NULL, GREATEST({', '.join(a)}))"


@define("LEAST")
def _least(a: Args) -> str:
    return f"IF({_any_null(a)}, NULL, LEAST({', '.join(a)}))"


@define("INTERVAL")
def _interval(a: Args) -> str:
    return f"IF({a[0]} IS NULL, -1, SIZE(FILTER(ARRAY({', '.join(a[1:])}), e -> e <= {a[0]})))"


@define("STRCMP")
def _strcmp(a: Args) -> str:
    return f"CASE WHEN {a[0]} = {a[1]} THEN 0 WHEN {a[0]} < {a[1]} THEN -1 WHEN {a[0]} > {a[1]} THEN 1 END"


# --- strings ---
_same("ASCII", "BIN", "BIT_LENGTH", "CHARACTER_LENGTH", "CHAR_LENGTH", "CONCAT", "CONCAT_WS", "FIND_IN_SET", "INSTR", "LCASE", "LEFT", "LOCATE", "LOWER", "OCTET_LENGTH", "POSITION", "REPLACE", "REVERSE", "RIGHT", "SPACE", "SUBSTRING_INDEX", "UCASE", "UNHEX", "UPPER", "REPEAT", "LTRIM", "RTRIM", "SOUNDEX", "MD5", "SHA1", "SHA2", "LEVENSHTEIN")
_simple(
    LENGTH="OCTET_LENGTH({0})",
    HEX="HEX({0})",
    OCT="CONV(CAST({0} AS STRING), 10, 8)",
    ORD="CAST(CONV(HEX(LEFT({0}, 1)), 16, 10) AS BIGINT)",
    LPAD="IF({1} < 0, NULL, LPAD({0}, {1}, {2}))",
    RPAD="IF({1} < 0, NULL, RPAD({0}, {1}, {2}))",
    INSERT="CASE WHEN {0} IS NULL OR {1} IS NULL OR {2} IS NULL OR {3} IS NULL THEN NULL WHEN {1} < 1 OR {1} > CHAR_LENGTH({0}) THEN {0} WHEN {2} < 0 OR {1} + {2} > CHAR_LENGTH({0}) THEN CONCAT(LEFT({0}, {1} - 1), {3}) ELSE OVERLAY({0} PLACING {3} FROM {1} FOR {2}) END",
    QUOTE="IF({0} IS NULL, 'NULL', CONCAT('\\'', REPLACE(REPLACE({0}, '\\\\', '\\\\\\\\'), '\\'', '\\\\\\''), '\\''))",
    REGEXP_LIKE="REGEXP_LIKE({0}, {1})",
)


@define("FORMAT")
def _format(a: Args) -> str:
    """Grouped by thousands, with so many decimals, half rounded up. A number of decimals below 0 is 0."""
    if m := re.fullmatch(r"\(?(- ?)?(\d+)\)?", a[1].strip()):
        n = 0 if m[1] else int(m[2])
        return f"FORMAT_NUMBER(ROUND({a[0]}, {n}), {n})"
    return f"FORMAT_NUMBER({a[0]}, GREATEST(CAST({a[1]} AS INT), 0))"


@define("SUBSTR", "SUBSTRING", "MID")
def _substr(a: Args) -> str:
    return f"IF({a[1]} = 0, '', SUBSTR({', '.join(a)}))"


@define("CHAR")
def _char(a: Args) -> str:
    hexes = f"TRANSFORM(FILTER(ARRAY({', '.join(f'CAST({x} AS BIGINT)' for x in a)}), x -> x IS NOT NULL), x -> LPAD(HEX(x), 2 * CAST(CEIL(LENGTH(HEX(x)) / 2) AS INT), '0'))"
    return f"DECODE(UNHEX(ARRAY_JOIN({hexes}, '')), 'UTF-8')"


@define("ELT")
def _elt(a: Args) -> str:
    return f"IF({a[0]} < 1, NULL, TRY_ELEMENT_AT(ARRAY({', '.join(a[1:])}), CAST({a[0]} AS INT)))"


@define("FIELD")
def _field(a: Args) -> str:
    return f"COALESCE(CAST(ARRAY_POSITION(ARRAY({', '.join(a[1:])}), {a[0]}) AS INT), 0)"


@define("MAKE_SET")
def _make_set(a: Args) -> str:
    return f"IF({a[0]} IS NULL, NULL, ARRAY_JOIN(FILTER(ARRAY({', '.join(a[1:])}), (v, i) -> v IS NOT NULL AND (SHIFTRIGHT(CAST({a[0]} AS BIGINT), i) & 1) = 1), ','))"


@define("EXPORT_SET")
def _export_set(a: Args) -> str:
    sep = a[3] if len(a) > 3 else "','"
    n = f"LEAST(GREATEST(CAST({a[4]} AS INT), 0), 64)" if len(a) > 4 else "64"
    return f"CASE WHEN {n} = 0 THEN '' ELSE ARRAY_JOIN(TRANSFORM(SEQUENCE(0, {n} - 1), i -> IF((SHIFTRIGHT(CAST({a[0]} AS BIGINT), i) & 1) = 1, {a[1]}, {a[2]})), {sep}) END"


@define("TRIM")
def _trim(a: Args) -> str:
    """One argument: blanks. Three (side, what, from): whole occurrences of a string, not a set of characters."""
    if len(a) == 1:
        return f"TRIM({a[0]})"
    side, what, text = a
    word = f"CONCAT('(?:', REGEXP_REPLACE({what}, '([^A-Za-z0-9])', '\\\\\\\\$1'), ')+')"
    patterns = {"LEADING": f"CONCAT('^', {word})", "TRAILING": f"CONCAT({word}, '$')", "BOTH": f"CONCAT('^', {word}, '|', {word}, '$')"}
    return f"IF({what} = '', {text}, REGEXP_REPLACE({text}, {patterns[side.upper()]}, ''))"


# --- casts ---
@define("CAST", "CONVERT")
def _cast(a: Args) -> str:
    """Value and type; a string's leading number is its numeric value, and what can't be cast is null."""
    value, kind = a[0], a[1].strip().upper()
    number = f"REGEXP_EXTRACT(CAST({value} AS STRING), '^\\\\s*([+-]?[0-9]*[.]?[0-9]+)', 1)"
    if kind.startswith(("SIGNED", "UNSIGNED")):
        whole = f"CAST(ROUND(TRY_CAST(COALESCE(NULLIF({number}, ''), '0') AS DECIMAL(38,10))) AS DECIMAL(20,0))"
        guard = f"IF({value} IS NULL, NULL, {whole})"
        return f"TRY_CAST({guard} AS BIGINT)" if kind.startswith("SIGNED") else f"CAST(IF({guard} < 0, {guard} + CAST('18446744073709551616' AS DECIMAL(20,0)), {guard}) AS DECIMAL(20,0))"
    if kind.startswith("DECIMAL"):
        kind = kind if "(" in kind else "DECIMAL(10,0)"
        return f"IF({value} IS NULL, NULL, TRY_CAST(COALESCE(NULLIF({number}, ''), '0') AS {kind}))"
    if kind.startswith("CHAR"):
        m = re.search(r"\((\d+)\)", kind)
        return f"LEFT(CAST({value} AS STRING), {m[1]})" if m else f"CAST({value} AS STRING)"
    if kind.startswith("BINARY"):
        m = re.search(r"\((\d+)\)", kind)
        return f"CAST(LEFT(CAST({value} AS STRING), {m[1]}) AS BINARY)" if m else f"CAST(CAST({value} AS STRING) AS BINARY)"
    kinds = {"DATE": "DATE", "DATETIME": "TIMESTAMP", "TIMESTAMP": "TIMESTAMP", "JSON": "STRING", "DOUBLE": "DOUBLE", "FLOAT": "FLOAT", "YEAR": "SMALLINT"}
    if kind.startswith("TIME") and not kind.startswith("TIMESTAMP"):
        return _time([value])
    base = re.sub(r"\(.*", "", kind)
    return f"TRY_CAST({value} AS {kinds.get(base, kind)})"


# --- dates ---
def _date(x: str) -> str:
    return f"TRY_CAST({x} AS DATE)"


def _ts(x: str) -> str:
    return f"TRY_CAST({x} AS TIMESTAMP)"


_simple(
    DATE="TRY_CAST({0} AS DATE)",
    DATEDIFF="DATEDIFF(TRY_CAST({0} AS DATE), TRY_CAST({1} AS DATE))",
    DAYNAME="DATE_FORMAT(TRY_CAST({0} AS DATE), 'EEEE')",
    MONTHNAME="DATE_FORMAT(TRY_CAST({0} AS DATE), 'MMMM')",
    WEEKOFYEAR="WEEKOFYEAR(TRY_CAST({0} AS DATE))",
    LAST_DAY="LAST_DAY(TRY_CAST({0} AS DATE))",
    FROM_DAYS="DATE_ADD(DATE'1970-01-01', CAST({0} AS INT) - 719528)",
    TO_DAYS="(DATEDIFF(TRY_CAST({0} AS DATE), DATE'1970-01-01') + 719528)",
    TO_SECONDS="((DATEDIFF(TRY_CAST({0} AS DATE), DATE'1970-01-01') + 719528) * 86400L + HOUR(TRY_CAST({0} AS TIMESTAMP)) * 3600 + MINUTE(TRY_CAST({0} AS TIMESTAMP)) * 60 + SECOND(TRY_CAST({0} AS TIMESTAMP)))",
    MAKEDATE="IF({1} < 1, NULL, DATE_ADD(MAKE_DATE({0}, 1, 1), {1} - 1))",
    MAKETIME="IF({1} NOT BETWEEN 0 AND 59 OR {2} < 0 OR {2} >= 60, NULL, MAKE_DT_INTERVAL(0, {0}, {1}, {2}))",
    SEC_TO_TIME="MAKE_DT_INTERVAL(0, 0, 0, {0})",
    MICROSECOND="CAST(DATE_FORMAT(TRY_CAST({0} AS TIMESTAMP), 'SSSSSS') AS INT)",
    CONVERT_TZ="CONVERT_TIMEZONE({1}, {2}, TRY_CAST({0} AS TIMESTAMP_NTZ))",
    TIMEDIFF="(TRY_CAST({0} AS TIMESTAMP) - TRY_CAST({1} AS TIMESTAMP))",
    ADDTIME="(TRY_CAST({0} AS TIMESTAMP) + TRY_CAST({1} AS INTERVAL HOUR TO SECOND))",
    SUBTIME="(TRY_CAST({0} AS TIMESTAMP) - TRY_CAST({1} AS INTERVAL HOUR TO SECOND))",
)
for _n, _f in {"DAY": "DAY", "DAYOFMONTH": "DAYOFMONTH", "DAYOFWEEK": "DAYOFWEEK", "DAYOFYEAR": "DAYOFYEAR", "MONTH": "MONTH", "QUARTER": "QUARTER", "WEEKDAY": "WEEKDAY", "YEAR": "YEAR"}.items():
    FUNCTIONS[_n] = lambda a, f=_f: f"{f}({_date(a[0])})"
for _i, _n in enumerate(("HOUR", "MINUTE", "SECOND")):
    FUNCTIONS[_n] = lambda a, i=_i: f"CAST({_parts_of_time(a[0])[i]} AS INT)"
_same("NOW", "CURDATE", "CURRENT_DATE", "CURRENT_TIMESTAMP")


def _clock(x: str) -> tuple[str, str, str] | None:
    """Hours, minutes and seconds of a time that is written out, which may have more than 24 hours; None for anything else."""
    text = literal(x)
    m = re.fullmatch(r"\s*(-?)(\d{1,3}):([0-5]?\d)(?::([0-5]?\d(?:\.\d{1,6})?))?\s*", text) if text is not None else None
    return tuple(f"{m[1] if float(v) else ''}{v}" for v in (m[2].lstrip("0") or "0", m[3].lstrip("0") or "0", (m[4] or "0").lstrip("0") or "0")) if m else None


_INTERVAL = re.compile(r"(?:IF\(.* NOT BETWEEN 0 AND 59 .* NULL, )?MAKE_DT_INTERVAL\(|CAST\('[^']*' AS INTERVAL|\(TRY_(?:CAST|TO_TIMESTAMP)\(.*\) - (?:DATE_TRUNC|TRY_CAST)\(", re.S)


def _parts_of_time(x: str) -> tuple[str, str, str]:
    """Hours (24 and more where they are), minutes and seconds of a time, or of a date with one."""
    if found := _clock(x):
        return found
    if _INTERVAL.match(x):
        return f"(EXTRACT(DAY FROM {x}) * 24 + EXTRACT(HOUR FROM {x}))", f"EXTRACT(MINUTE FROM {x})", f"EXTRACT(SECOND FROM {x})"
    return tuple(f"{u}({_ts(x)})" for u in ("HOUR", "MINUTE", "SECOND"))


@define("TIMESTAMP")
def _timestamp(a: Args) -> str:
    return _ts(a[0]) if len(a) == 1 else FUNCTIONS["ADDTIME"](a)


@define("TIME")
def _time(a: Args) -> str:
    """The time of day, as an interval since midnight."""
    if found := _clock(a[0]):
        return f"MAKE_DT_INTERVAL(0, {found[0]}, {found[1]}, {found[2]})"
    return f"({_ts(a[0])} - DATE_TRUNC('DAY', {_ts(a[0])}))"


@define("TIME_TO_SEC")
def _time_to_sec(a: Args) -> str:
    h, m, s = _parts_of_time(a[0])
    return f"CAST({h} * 3600 + {m} * 60 + CAST({s} AS INT) AS INT)"


@define("UNIX_TIMESTAMP")
def _unix(a: Args) -> str:
    return f"UNIX_TIMESTAMP({_ts(a[0])})" if a else "UNIX_TIMESTAMP()"


@define("FROM_UNIXTIME")
def _from_unix(a: Args) -> str:
    return f"TIMESTAMP_SECONDS({a[0]})" if len(a) == 1 else _date_format([f"TIMESTAMP_SECONDS({a[0]})", a[1]])


def interval(amount: str, unit: str) -> str:
    """An interval of a number of units, or of a composite unit's text like '1:30'."""
    unit = unit.upper()
    if unit in COMPOSITE:
        parts = COMPOSITE[unit]
        digits = f"REGEXP_EXTRACT_ALL(CAST({amount} AS STRING), '([0-9]+)', 1)"
        # fewer numbers than units stand for the last ones
        at = [f"CAST(COALESCE(TRY_ELEMENT_AT({digits}, {i - len(parts)}), '0') AS INT)" for i in range(len(parts))]
        sign = f"IF(CAST({amount} AS STRING) LIKE '-%', -1, 1)"
        return _units({p: f"{sign} * {x}" for p, x in zip(parts, at, strict=True)})
    if unit == "QUARTER":
        return _units({"MONTH": f"3 * ({amount})"})
    return _units({unit: amount})


def _units(values: dict[str, str]) -> str:
    months = [f"12 * CAST({v} AS INT)" if u == "YEAR" else f"CAST({v} AS INT)" for u, v in values.items() if u in ("YEAR", "MONTH")]
    if months:
        return f"MAKE_YM_INTERVAL(0, {' + '.join(months)})"
    day = " + ".join([f"CAST({v} AS INT) * {7 if u == 'WEEK' else 1}" for u, v in values.items() if u in ("DAY", "WEEK")] or ["0"])
    hour, minute = (values.get(u, "0") for u in ("HOUR", "MINUTE"))
    second = f"CAST({values.get('SECOND', '0')} AS DECIMAL(18,6)) + CAST({values.get('MICROSECOND', '0')} AS DECIMAL(18,6)) / 1000000"
    return f"MAKE_DT_INTERVAL({day}, CAST({hour} AS INT), CAST({minute} AS INT), CAST({second} AS DECIMAL(18,6)))"


def _moved(a: Args, sign: str) -> str:
    """A date or time and an interval ``INTERVAL n unit``, or a number of days."""
    m = re.fullmatch(r"\s*INTERVAL\s+(.*)\s+(\w+)\s*", a[1], re.S | re.I)
    amount, unit = (m[1], m[2].upper()) if m else (a[1], "DAY")
    whole_days = unit in ("DAY", "WEEK", "MONTH", "QUARTER", "YEAR", "YEAR_MONTH")
    text = literal(a[0])
    is_date = text is not None and re.fullmatch(r"\d{4}-\d\d?-\d\d?", text) or re.match(r"\s*(DATE\s*'|CAST\(.* AS DATE\)|TRY_CAST\(.* AS DATE\)$)", a[0], re.I)
    if whole_days and is_date:
        return f"CAST({_date(a[0])} {sign} {interval(amount, unit)} AS DATE)"
    return f"({_ts(a[0])} {sign} {interval(amount, unit)})"


FUNCTIONS["DATE_ADD"] = FUNCTIONS["ADDDATE"] = lambda a: _moved(a, "+")
FUNCTIONS["DATE_SUB"] = FUNCTIONS["SUBDATE"] = lambda a: _moved(a, "-")
FUNCTIONS["TIMESTAMPADD"] = lambda a: f"({_ts(a[2])} + {interval(a[1], a[0].strip())})"
FUNCTIONS["TIMESTAMPDIFF"] = lambda a: f"TIMESTAMPDIFF({a[0].strip().upper()}, {_ts(a[1])}, {_ts(a[2])})"


@define("EXTRACT")
def _extract(a: Args) -> str:
    """Unit and value; a composite unit's numbers stand one after another."""
    unit, t = a[0].strip().upper(), _ts(a[1])
    one = {"MICROSECOND": f"CAST(DATE_FORMAT({t}, 'SSSSSS') AS BIGINT)", "SECOND": f"SECOND({t})", "WEEK": _week([a[1]])}
    get = lambda u: one.get(u, f"{u}({t})")
    if unit not in COMPOSITE:
        return get(unit)
    text = "0"
    for u in COMPOSITE[unit]:
        text = f"({text} * {_WIDTH.get(u, 1)} + {get(u)})"
    return text


def _week_one(year: str, mode: int) -> str:
    """The first day of a year's week 1: weeks start on Monday in odd modes, on Sunday in even ones."""
    first = f"MAKE_DATE({year}, 1, 1)"
    off = f"WEEKDAY({first})" if mode % 2 else f"(DAYOFWEEK({first}) - 1)"
    if mode in (1, 3, 4, 6):  # week 1 has four days or more in the year
        return f"DATE_ADD({first}, IF({off} <= 3, -{off}, 7 - {off}))"
    return f"DATE_ADD({first}, IF({off} = 0, 0, 7 - {off}))"


def _week_parts(d: str, mode: int) -> tuple[str, str]:
    """Year and week, of a mode that counts from 1."""
    y = f"YEAR({d})"
    this, after = _week_one(y, mode), _week_one(f"{y} + 1", mode)
    year = f"CASE WHEN {d} < {this} THEN {y} - 1 WHEN {d} >= {after} THEN {y} + 1 ELSE {y} END"
    start = f"CASE WHEN {d} < {this} THEN {_week_one(f'{y} - 1', mode)} WHEN {d} >= {after} THEN {after} ELSE {this} END"
    return year, f"CAST(FLOOR(DATEDIFF({d}, {start}) / 7) + 1 AS INT)"


@define("WEEK")
def _week(a: Args) -> str:
    mode, d = int(a[1]) % 8 if len(a) > 1 else 0, _date(a[0])
    if mode in (2, 3, 6, 7):
        return _week_parts(d, mode)[1]
    return f"CAST(FLOOR(DATEDIFF({d}, {_week_one(f'YEAR({d})', mode)}) / 7) + 1 AS INT)"


@define("YEARWEEK")
def _yearweek(a: Args) -> str:
    # the modes that count from 0 have a partner of the same weeks that counts from 1
    mode = {0: 2, 1: 3, 4: 6, 5: 7}.get(m := int(a[1]) % 8 if len(a) > 1 else 0, m)
    year, week = _week_parts(_date(a[0]), mode)
    return f"({year}) * 100 + {week}"


@define("DATE_FORMAT")
def _date_format(a: Args) -> str:
    fmt = literal(a[1])
    if fmt is None:
        raise ValueError("a date format must be a string literal")
    t, out = _ts(a[0]), []
    for m in re.finditer(r"%(.)|([^%]+)", fmt, re.S):
        code = m[1]
        if code is None:
            out.append(quoted(m[2]))
        elif code in DATE_CODES:
            out.append(f"DATE_FORMAT({t}, '{DATE_CODES[code]}')")
        elif code == "w":
            out.append(f"CAST(DAYOFWEEK({t}) - 1 AS STRING)")
        elif code == "D":
            out.append(f"CONCAT(DAY({t}), CASE WHEN DAY({t}) IN (11, 12, 13) THEN 'th' WHEN DAY({t}) % 10 = 1 THEN 'st' WHEN DAY({t}) % 10 = 2 THEN 'nd' WHEN DAY({t}) % 10 = 3 THEN 'rd' ELSE 'th' END)")
        elif code in "UuVv":
            out.append(f"LPAD({_week([a[0], str({'U': 0, 'u': 1, 'V': 2, 'v': 3}[code])])}, 2, '0')")
        elif code in "Xx":
            out.append(f"CAST({_week_parts(_date(a[0]), 2 if code == 'X' else 3)[0]} AS STRING)")
        else:
            out.append(quoted(code))
    return f"CONCAT({', '.join(out)})" if out else "''"


@define("TIME_FORMAT")
def _time_format(a: Args) -> str:
    """Like DATE_FORMAT for times, whose hours may be 24 and more: %H and %k give them all."""
    h, m, s = _parts_of_time(a[0])
    fmt, out = literal(a[1]), []
    if fmt is None:
        raise ValueError("a time format must be a string literal")
    whole, two = f"CAST({h} AS INT)", lambda x: f"IF(CAST({x} AS INT) < 100, LPAD(CAST(CAST({x} AS INT) AS STRING), 2, '0'), CAST(CAST({x} AS INT) AS STRING))"
    half = f"IF({whole} % 12 = 0, 12, {whole} % 12)"
    noon = f"IF({whole} % 24 < 12, 'AM', 'PM')"
    micro = f"LPAD(CAST(CAST(({s} - FLOOR({s})) * 1000000 AS INT) AS STRING), 6, '0')"
    codes = {
        "H": [two(h)], "k": [f"CAST({whole} AS STRING)"], "h": [two(half)], "I": [two(half)], "l": [f"CAST({half} AS STRING)"], "i": [two(m)], "s": [two(s)], "S": [two(s)], "f": [micro], "p": [noon],
        "T": [two(h), "':'", two(m), "':'", two(s)], "r": [two(half), "':'", two(m), "':'", two(s), "' '", noon],
    }
    for part in re.finditer(r"%(.)|([^%]+)", fmt, re.S):
        out += codes.get(part[1], [quoted(part[1])]) if part[1] else [quoted(part[2])]
    return f"CONCAT({', '.join(out)})" if out else "''"


@define("STR_TO_DATE")
def _str_to_date(a: Args) -> str:
    fmt = literal(a[1])
    if fmt is None:
        raise ValueError("a date format must be a string literal")
    wide = {**DATE_CODES, "m": "M", "d": "d", "H": "H", "i": "m", "s": "s", "S": "s"}
    pattern = "".join(wide.get(m[1], "'" + m[1] + "'") if m[1] else re.sub(r"([A-Za-z]+)", r"''\1''", m[2]) for m in re.finditer(r"%(.)|([^%]+)", fmt, re.S))
    has_time = any(f"%{c}" in fmt for c in "HkhIlisSfTr")
    if has_time and not any(f"%{c}" in fmt for c in "YymcdejbMUuVvXxaWw"):
        t = f"TRY_TO_TIMESTAMP({a[0]}, '{pattern}')"
        return f"({t} - DATE_TRUNC('DAY', {t}))"
    return f"CAST(TRY_TO_TIMESTAMP({a[0]}, '{pattern}') AS {'TIMESTAMP' if has_time else 'DATE'})"


@define("GET_FORMAT")
def _get_format(a: Args) -> str:
    found = GET_FORMATS.get((a[0].strip().upper(), (literal(a[1]) or "").upper()))
    return quoted(found) if found else "CAST(NULL AS STRING)"


# --- JSON ---
@define("JSON_EXTRACT")
def _json_extract(a: Args) -> str:
    """A value as JSON text: strings stay quoted, the null of JSON is 'null', what isn't there is null. Paths with wildcards give an array's text."""
    if len(a) > 2 or "*" in a[1]:
        parts = [f"GET_JSON_OBJECT({a[0]}, {p})" for p in a[1:]]
        return parts[0] if len(parts) == 1 else f"CONCAT('[', ARRAY_JOIN(ARRAY({', '.join(_json_extract([a[0], p]) for p in a[1:])}), ', '), ']')"
    return f"TO_JSON(TRY_VARIANT_GET(TRY_PARSE_JSON({a[0]}), {a[1]}, 'variant'))"


@define("JSON_UNQUOTE")
def _json_unquote(a: Args) -> str:
    return f"IF({a[0]} LIKE '\"%\"', TRY_VARIANT_GET(TRY_PARSE_JSON({a[0]}), '$', 'string'), {a[0]})"


# --- implicit conversions ---
_PREFIX = r"^\\s*([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)"
#: Operators whose operands count as numbers, and those that compare.
ARITHMETIC = {"+", "-", "*", "/", "%", "MOD", "DIV", "<<", ">>", "&", "|", "^"}
COMPARISONS = {"=", "<=>", "<>", "!=", "<", "<=", ">", ">="}
#: Functions whose arguments count as numbers.
NUMERIC = set("ABS ACOS ASIN ATAN ATAN2 CEIL CEILING COS COT DEGREES EXP FLOOR LN LOG LOG2 LOG10 MOD POW POWER RADIANS ROUND SIGN SIN SQRT TAN TRUNCATE FORMAT OCT BIN SPACE CHAR MAKEDATE MAKETIME SEC_TO_TIME FROM_DAYS".split())
_RESULTS = {
    "number": "ABS ACOS ASIN ATAN ATAN2 CEIL CEILING COS COT DEGREES EXP FLOOR LN LOG LOG2 LOG10 MOD PI POW POWER RADIANS RAND ROUND SIGN SIN SQRT TAN TRUNCATE CRC32 ASCII BIT_LENGTH CHARACTER_LENGTH CHAR_LENGTH LENGTH OCTET_LENGTH ORD FIELD FIND_IN_SET INSTR LOCATE POSITION STRCMP INTERVAL DATEDIFF DAY DAYOFMONTH DAYOFWEEK DAYOFYEAR "
    "HOUR MINUTE SECOND MICROSECOND MONTH QUARTER YEAR WEEK WEEKDAY WEEKOFYEAR YEARWEEK TO_DAYS TO_SECONDS TIME_TO_SEC UNIX_TIMESTAMP TIMESTAMPDIFF EXTRACT COUNT SUM AVG BIT_AND BIT_OR BIT_XOR",
    "string": "BIN CONCAT CONCAT_WS CONV ELT EXPORT_SET FORMAT HEX INSERT LCASE LEFT LOWER LPAD LTRIM MAKE_SET MID OCT QUOTE REPEAT REPLACE REVERSE RIGHT RPAD RTRIM SPACE SUBSTR SUBSTRING SUBSTRING_INDEX TRIM UCASE UPPER CHAR DATE_FORMAT DAYNAME MONTHNAME TIME_FORMAT GET_FORMAT JSON_UNQUOTE MD5 SHA1 SHA2 SOUNDEX GROUP_CONCAT",
    "json": "JSON_EXTRACT", "date": "DATE LAST_DAY FROM_DAYS MAKEDATE CURDATE CURRENT_DATE", "time": "TIMESTAMP NOW CURRENT_TIMESTAMP TIMESTAMPADD", "bool": "ISNULL REGEXP_LIKE EXISTS",
}
#: What functions give.
RESULTS = {name: kind for kind, names in _RESULTS.items() for name in names.split()}


def number(x: str, kind: str | None) -> str:
    """A value of a kind as a number: the number that a text begins with or 0, the digits of a date or time, 1 or 0 for truth values."""
    if kind in ("string", "json"):
        text = literal(x) if kind == "string" else None
        if text is not None:
            m = re.match(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", text)
            return f"({m[1]}{'D' if 'e' not in m[1].lower() and len(m[1]) > 30 else ''})" if m else "0"
        value = x if kind == "string" else _json_unquote([x])
        return f"IF({x} IS NULL, NULL, COALESCE(TRY_CAST(NULLIF(REGEXP_EXTRACT({value}, '{_PREFIX}', 1), '') AS DOUBLE), 0D))"
    if kind == "date":
        return f"CAST(DATE_FORMAT({x}, 'yyyyMMdd') AS BIGINT)"
    if kind == "time":
        return f"CAST(DATE_FORMAT({x}, 'yyyyMMddHHmmss') AS BIGINT)"
    return f"CAST({x} AS INT)" if kind == "bool" else x


def moment(x: str, kind: str) -> str:
    """A text that is compared with a date or time; null where it is none."""
    text = literal(x)
    plain = text is not None and re.fullmatch(r"\s*\d{4}-\d\d?-\d\d?\s*", text)
    return f"TRY_CAST({x} AS {'DATE' if kind == 'date' and plain else 'TIMESTAMP'})"


# --- operators with other rules than Spark's ---
OPERATORS: dict[str, Callable[[str, str], str]] = {
    "/": lambda x, y: f"TRY_DIVIDE({x}, {y})",
    "%": lambda x, y: f"TRY_MOD({x}, {y})",
    "MOD": lambda x, y: f"TRY_MOD({x}, {y})",
    # as decimals, since either may be a double, which DIV doesn't take
    "DIV": lambda x, y: f"IF({y} = 0, NULL, TRY_CAST({x} AS DECIMAL(38,10)) DIV TRY_CAST({y} AS DECIMAL(38,10)))",
    "<<": lambda x, y: f"IF({y} >= 64 OR {y} < 0, 0, SHIFTLEFT(CAST({x} AS BIGINT), CAST({y} AS INT)))",
    ">>": lambda x, y: f"IF({y} >= 64 OR {y} < 0, 0, SHIFTRIGHTUNSIGNED(CAST({x} AS BIGINT), CAST({y} AS INT)))",
    "XOR": lambda x, y: f"(CAST({x} AS BOOLEAN) <> CAST({y} AS BOOLEAN))",
    "&&": lambda x, y: f"({truth(x)} AND {truth(y)})",
    "||": lambda x, y: f"({truth(x)} OR {truth(y)})",
    "TEXT DIV": lambda x, y: f"TRY_CAST(TRY_DIVIDE({x}, {y}) AS BIGINT)",
    "->": lambda x, y: _json_extract([x, y]),
    "->>": lambda x, y: _json_unquote([_json_extract([x, y])]),
    "REGEXP": lambda x, y: f"({x} RLIKE {y})",
    "&": lambda x, y: f"({_signed(x)} & {_signed(y)})",
    "|": lambda x, y: f"({_signed(x)} | {_signed(y)})",
    "^": lambda x, y: f"({_signed(x)} ^ {_signed(y)})",
}


def truth(x: str) -> str:
    """An operand of AND, OR and NOT: a bare number or column counts as true unless it is 0."""
    return f"CAST({x} AS BOOLEAN)" if re.fullmatch(r"[\w.`]+", x) and x.upper() not in ("NULL", "TRUE", "FALSE") else x


def _signed(x: str) -> str:
    """An operand of a bit operation: a complement as the signed number of the same bits."""
    m = re.match(r"CAST\(CAST\((~CAST\(.* AS BIGINT\)) AS DECIMAL\(20,0\)\) \+ IF\(", x)
    return f"({m[1]})" if m else x


def bit_not(x: str) -> str:
    """The complement as an unsigned 64-bit number."""
    return f"CAST(CAST(~CAST({x} AS BIGINT) AS DECIMAL(20,0)) + IF(~CAST({x} AS BIGINT) < 0, CAST('18446744073709551616' AS DECIMAL(20,0)), CAST(0 AS DECIMAL(20,0))) AS DECIMAL(20,0))"


# --- aggregates ---
AGGREGATES: dict[str, Callable[[Args], str]] = {
    "BIT_AND": lambda a: f"COALESCE(CAST(BIT_AND(CAST({a[0]} AS BIGINT)) AS DECIMAL(20,0)), CAST('18446744073709551615' AS DECIMAL(20,0)))",
    "BIT_OR": lambda a: f"COALESCE(BIT_OR(CAST({a[0]} AS BIGINT)), 0)",
    "BIT_XOR": lambda a: f"COALESCE(BIT_XOR(CAST({a[0]} AS BIGINT)), 0)",
    "ANYVALUE": lambda a: f"ANY_VALUE({a[0]})",
}


def call(name: str, *args: str) -> Column:
    """A function of the dialect as a Column; arguments are SQL texts: ``call("LPAD", "c_name", "12", "'*'")``."""
    return F.expr(FUNCTIONS[name.upper()](list(args)))
