"""Pivot reports over tagged measurements, and JSON extraction."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class PivotSpec:
    """``new = old | a.x = b.y; rows: a, b | limit(3) | notag; cols: c | notitle; cell: limit(10)|avg|~|cnt|duration``.

    Mappings come first: a tag under another name, or with a dot a value of a tag under another name, in
    both tags. Then what stands in rows, in columns, and in cells. ``limit``: only the last so many rows or
    columns, in the order of their names, and none that this leaves empty. ``notag``: names are values only, else 'tag:value'. ``notitle``:
    no column with the rows' names, or columns that are only numbered.
    """

    rows: list[str]
    cols: list[str]
    cell: list[str] = field(default_factory=lambda: ["avg"])
    row_options: list[str] = field(default_factory=list)
    col_options: list[str] = field(default_factory=list)
    mappings: list[tuple[str, str]] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> PivotSpec:
        parts: dict[str, str] = {}
        mappings: list[tuple[str, str]] = []
        for p in (x.strip() for x in text.split(";") if x.strip()):
            if m := re.match(r"(rows|cols|cell)\s*:\s*(.*)", p, re.S):
                if m[1] in parts:
                    raise ValueError(f"{m[1]} is given twice")
                parts[m[1]] = m[2]
                continue
            for op in (x.strip() for x in p.split("|") if x.strip()):
                sides = [x.strip() for x in op.split("=")]
                if len(sides) != 2 or sides[0].count(".") != sides[1].count(".") or sides[0].count(".") > 1:
                    raise ValueError(f"cannot read the mapping {op!r}")
                mappings.append((sides[0], sides[1]))
        if not {"rows", "cols"} <= parts.keys():
            raise ValueError("a report needs rows and cols")

        def axis(k: str) -> tuple[list[str], list[str]]:
            tags, *options = [x.strip() for x in parts[k].split("|")]
            options = [o for o in options if o]
            if unknown := [o for o in options if o not in ("notag", "notitle") and not re.fullmatch(r"limit\(\s*\d+\s*\)", o)]:
                raise ValueError(f"{k} can't have {unknown}")
            return [t.strip() for t in tags.split(",") if t.strip()], options

        (rows, row_options), (cols, col_options) = axis("rows"), axis("cols")
        return cls(rows, cols, [x.strip() for x in parts.get("cell", "avg").split("|") if x.strip()], row_options, col_options, mappings)


def _limit(options: list[str]) -> int | None:
    return next((int(m[1]) for o in options if (m := re.fullmatch(r"limit\(\s*(\d+)\s*\)", o))), None)


def map_tags(df: DataFrame, mappings: list[tuple[str, str]]) -> DataFrame:
    """Tags under other names (``new``, ``old``), and values of tags under other names (``new.x``, ``old.y``): where the old tag is y it becomes x, in both tags."""
    for new, old in mappings:
        (tag, _, value), (was, _, had) = new.partition("."), old.partition(".")
        df = df.withColumn(tag, F.coalesce(F.col(was), F.col(tag)) if tag in df.columns else F.col(was))
        if value:
            for c in dict.fromkeys((was, tag)):
                df = df.withColumn(c, F.when(F.trim(F.col(c).cast("string")) == had, F.lit(value)).otherwise(F.col(c).cast("string")))
    return df


def report_table(df: DataFrame, value: str, spec: PivotSpec | str, order: str | None = None) -> DataFrame:
    """The report as one would print it: a column ``row`` with the rows' names, then one column for each name of the column tags, all as text, '' where a cell has no values.

    Rows without one of the tags are left out. Names of columns are collected, so there may be some
    thousands at most; rows are not.
    """
    spec = PivotSpec.parse(spec) if isinstance(spec, str) else spec
    d = map_tags(df, spec.mappings)
    d = d.filter(F.lit(True) if not (spec.rows + spec.cols) else " AND ".join(f"`{t}` IS NOT NULL" for t in spec.rows + spec.cols))
    name = lambda tags, options: F.concat_ws(", ", *[F.col(t).cast("string") if "notag" in options else F.concat(F.lit(f"{t}:"), F.col(t).cast("string")) for t in tags])
    d = d.withColumn("row", name(spec.rows, spec.row_options)).withColumn("__col", name(spec.cols, spec.col_options))
    names = sorted(r[0] for r in d.select("__col").distinct().collect())
    if (n := _limit(spec.col_options)) is not None:
        names = names[max(0, len(names) - n) :]
        d = d.filter(F.col("__col").isin(names))
    if (n := _limit(spec.row_options)) is not None:
        last = d.select("row").distinct().orderBy(F.desc("row")).limit(n)
        d = d.join(F.broadcast(last), "row", "left_semi")  # at most n rows
        left = {r[0] for r in d.select("__col").distinct().collect()}
        names = [c for c in names if c in left]
    if not names:
        return d.select("row").limit(0)
    cells = pivot_report(d, value, PivotSpec(["row"], ["__col"], spec.cell), order, names)
    out = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"c{i}" if "notitle" in spec.col_options else c) for i, c in enumerate(names)]
    return cells.select(*([] if "notitle" in spec.row_options else ["row"]), *out)


def duration_text(seconds: Column) -> Column:
    """Seconds as '1h 2m 3.5s'."""
    h, m = F.floor(seconds / 3600), F.floor((seconds % 3600) / 60)
    rest = F.concat(F.format_number(seconds % 60, 1), F.lit("s"))
    return F.when(seconds >= 3600, F.concat(h, F.lit("h "), m, F.lit("m "), rest)).when(seconds >= 60, F.concat(m, F.lit("m "), rest)).otherwise(rest)


def bytes_text(size: Column) -> Column:
    """Bytes with a binary unit."""
    out = F.concat(F.format_number(size, 0), F.lit("B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(size >= 1024**k, F.concat(F.format_number(size / 1024**k, 2), F.lit(unit))).otherwise(out)
    return out


def pivot_report(df: DataFrame, value: str, spec: PivotSpec | str, order: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Averages of a value with row and column tags.

    Cell parts: avg; ``~``, the largest deviation from the average in percent of it; cnt; limit(n), only each
    cell's last n values by ``order``; duration or bytes, the form of the average. One number if the cell is
    just avg or cnt, else text. ``columns``: the values of the column tags, which saves a pass to find them.
    """
    spec = PivotSpec.parse(spec) if isinstance(spec, str) else spec
    limit = next((int(m[1]) for c in spec.cell if (m := re.fullmatch(r"limit\((\d+)\)", c))), None)
    tag = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in spec.cols]).alias("__tag")
    d = df.select(*spec.rows, tag, F.col(value).cast("double").alias("__v"), *([F.col(order).alias("__o")] if order else []))
    if limit:
        if not order:
            raise ValueError("limit needs an order")
        from pyspark.sql import Window

        w = Window.partitionBy(*spec.rows, "__tag").orderBy(F.col("__o").desc(), F.col("__v").desc())
        d = d.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= limit)
    avg, cnt = F.avg("__v"), F.count("__v")
    shape = duration_text if "duration" in spec.cell else bytes_text if "bytes" in spec.cell else (lambda c: F.format_number(c, 2))
    parts = [c for c in spec.cell if c in ("avg", "~", "cnt")] or ["avg"]
    if parts == ["cnt"]:
        cell: Column = cnt
    elif parts == ["avg"] and not {"duration", "bytes"} & {*spec.cell}:
        cell = avg
    else:
        off = F.greatest(F.max("__v") - avg, avg - F.min("__v")) * 100 / F.abs(avg)
        text = {"avg": shape(avg), "~": F.concat(F.lit("~"), F.format_number(off, 1), F.lit("%")), "cnt": F.concat(F.lit("/"), cnt)}
        cell = F.concat_ws(" ", *[text[p] for p in parts])
    grouped = d.groupBy(*spec.rows)
    return (grouped.pivot("__tag", columns) if columns else grouped.pivot("__tag")).agg(cell.alias("cell"))


def json_value(json: Column | str, path: str) -> Column:
    """A scalar, or an object or list as JSON text, at a path such as ``$.a.b[0]``; null where nothing is."""
    return F.get_json_object(json, path)


def differing_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows, with repetition, that one side has more of than the other: all columns, side ('left' or 'right') and times."""
    cols = left.columns
    tagged = left.select(*cols, F.lit(1).alias("__n")).unionByName(right.select(*cols, F.lit(-1).alias("__n")))
    return tagged.groupBy(*cols).agg(F.sum("__n").alias("__n")).filter("__n <> 0").select(*cols, F.when(F.col("__n") > 0, "left").otherwise("right").alias("side"), F.abs("__n").alias("times"))
