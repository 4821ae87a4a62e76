"""Delimited lines into typed rows, and rejects with their reason, by structural indexing.

A batch of lines is one byte buffer. A mask of its double quotes and the parity of the quotes before each
byte within its line tell which commas separate fields and which lie inside quotes; what stands beside a
quote tells whether quoting is sound. Field positions then become columns without visiting single lines.

Files whose quoted fields hold line breaks are read as records first: the same parity, carried from split
to split, tells which line breaks end a record.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.session import map_batches

QUOTE, COMMA, CR = 0x22, 0x2C, 0x0D


@dataclass(frozen=True)
class LineField:
    """One field: its RE2 pattern for the whole value, its type, and whether values must be real dates of some years."""

    name: str
    pattern: str
    kind: str = "string"
    years: tuple[int, int] | None = None


def _bytes_of(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lines' byte buffer, with each one's first byte and end, without one closing carriage return. A null line is empty."""
    lines = pc.fill_null(lines, "").cast(pa.large_string())
    offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
    data = np.frombuffer(lines.buffers()[2], np.uint8) if lines.buffers()[2] and lines.buffers()[2].size else np.zeros(0, np.uint8)
    base = offsets[0]
    data = data[base : offsets[-1]]
    begin, end = offsets[:-1] - base, (offsets[1:] - base).copy()
    full = end > begin
    full[full] = data[end[full] - 1] == CR
    end[full] -= 1
    return data, begin, end


def index_lines(lines: pa.Array, fields: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per line a code (0 sound, 1 quoting, 2 column count), and of the sound lines the numbers, the data, and [line, field] first and end positions."""
    data, begin, end = _bytes_of(lines)
    n = len(begin)
    code = np.zeros(n, np.int8)
    line_of = lambda pos: np.searchsorted(begin, pos, "right") - 1
    # empty lines share their start with the next one; the last of equal starts is the one with bytes
    inside = lambda pos, ln: pos < end[ln]
    quotes = np.flatnonzero(data == QUOTE)
    q_line = line_of(quotes)
    keep = inside(quotes, q_line)
    quotes, q_line = quotes[keep], q_line[keep]
    if len(quotes):
        first = np.concatenate([[True], q_line[1:] != q_line[:-1]])
        rank = np.arange(len(quotes)) - np.maximum.accumulate(np.where(first, np.arange(len(quotes)), 0))
        opens = rank % 2 == 0
        prev = np.where(quotes > begin[q_line], data[np.maximum(quotes - 1, 0)], COMMA)
        after = np.where(quotes + 1 < end[q_line], data[np.minimum(quotes + 1, len(data) - 1)], COMMA)
        # a quote opens at a field's start or as the second of a doubled one; it closes before a comma, the end or the second of a doubled one
        doubled = np.concatenate([[False], (quotes[1:] == quotes[:-1] + 1) & ~first[1:]])
        wrong = np.where(opens, (prev != COMMA) & ~doubled, (after != COMMA) & (after != QUOTE))
        code[q_line[wrong]] = 1
        last = np.concatenate([first[1:], [True]])
        code[q_line[last & opens]] = 1
    commas = np.flatnonzero(data == COMMA)
    c_line = line_of(commas)
    keep = inside(commas, c_line)
    commas, c_line = commas[keep], c_line[keep]
    before = np.searchsorted(quotes, commas)
    line_start = np.searchsorted(quotes, begin[c_line])
    apart = (before - line_start) % 2 == 0
    commas, c_line = commas[apart], c_line[apart]
    counts = np.bincount(c_line, minlength=n)
    code[(code == 0) & (counts != fields - 1)] = 2
    sound = np.flatnonzero(code == 0)
    cuts = commas[code[c_line] == 0].reshape(len(sound), fields - 1)
    starts = np.concatenate([begin[sound, None], cuts + 1], axis=1)
    ends = np.concatenate([cuts, end[sound, None]], axis=1)
    return code, sound, data, starts, ends


def _column(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The values between positions, without their quotes."""
    safe = np.minimum(start, max(len(data) - 1, 0))
    quoted = (end > start) & (data[safe] == QUOTE) if len(data) else np.zeros(len(start), bool)
    start, end = start + quoted, end - quoted
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    take = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    values = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data[take].tobytes()))
    if quoted.any():
        values = pc.if_else(pa.array(quoted), pc.replace_substring(values, '""', '"'), values)
    return values


def _real_date(values: pa.Array, ok: np.ndarray, years: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Of the values of form yyyy-mm-dd, which are days of those years; and days since 1970."""
    days = np.zeros(len(values), np.int32)
    good = ok.copy()
    idx = np.flatnonzero(ok)
    if len(idx):
        raw = np.frombuffer("".join(values.take(pa.array(idx)).to_pylist()).encode(), np.uint8).reshape(-1, 10).astype(np.int32) - 48
        y, m, d = raw[:, 0] * 1000 + raw[:, 1] * 100 + raw[:, 2] * 10 + raw[:, 3], raw[:, 5] * 10 + raw[:, 6], raw[:, 8] * 10 + raw[:, 9]
        fine = (y >= years[0]) & (y <= years[1]) & (m >= 1) & (m <= 12) & (d >= 1)
        month = ((np.where(fine, y, 2000) - 1970) * 12 + np.where(fine, m, 1) - 1).astype("datetime64[M]")
        length = ((month + 1).astype("datetime64[D]") - month.astype("datetime64[D]")).astype(np.int32)
        fine &= d <= length
        good[idx] = fine
        days[idx] = month.astype("datetime64[D]").astype(np.int64) + d - 1
    return good, days


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "date": T.DateType()}
_NUMBERS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}


def _numbers(values: pa.Array, ok: np.ndarray, kind: str) -> tuple[pa.Array, np.ndarray]:
    """Values as numbers, empty ones as null, and which are numbers of the type: what its pattern lets through may still be too large or none."""
    given = pc.if_else(pa.array(ok & ~pc.equal(values, "").to_numpy(zero_copy_only=False)), values, None)
    try:
        return given.cast(_NUMBERS[kind]), ok
    except pa.ArrowInvalid:
        pass
    out, good = [], ok.copy()
    for i, text in enumerate(given.to_pylist()):
        try:
            out.append(None if text is None else pa.scalar(text).cast(_NUMBERS[kind]).as_py())
        except pa.ArrowInvalid:
            out.append(None)
            good[i] = False
    return pa.array(out, _NUMBERS[kind]), good


def _parser(fields: list[LineField], carried: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            code, sound, data, starts, ends = index_lines(b.column(carried), len(fields))
            valid = np.ones(len(sound), bool)
            parsed: list[pa.Array] = []
            for i, f in enumerate(fields):
                v = _column(data, starts[:, i], ends[:, i])
                ok = pc.match_substring_regex(v, rf"\A(?:{f.pattern})\z").to_numpy(zero_copy_only=False)
                if f.years:
                    ok, days = _real_date(v, ok, f.years)
                    v = pa.array(days, pa.int32(), mask=~ok).cast(pa.date32())
                elif f.kind in _NUMBERS:
                    v, ok = _numbers(v, ok, f.kind)
                valid &= ok
                parsed.append(v)
            code[sound[~valid]] = 3
            row = np.full(b.num_rows, -1, np.int64)
            row[sound[valid]] = np.flatnonzero(valid)
            at = pa.array(row, mask=row < 0)
            columns = [b.column(i) for i in range(carried)]
            columns.append(pa.array(["quoting", "column_count", "value"]).take(pa.array(code - 1, pa.int8(), mask=code == 0)))
            for f, v in zip(fields, parsed, strict=True):
                v = v.take(at)
                if f.kind == "string":
                    v = pc.if_else(pc.equal(v, ""), None, v).cast(pa.string())
                columns.append(v)
            yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    return run


def parse_lines(df: DataFrame, line: str, fields: list[LineField], keep: list[str]) -> DataFrame:
    """Each line as typed fields, or with the first reason that applies: quoting, column_count, value.

    Result: the ``keep`` columns, reason (null for a sound line) and the fields, which are all null for a
    reject. One carriage return at a line's end is no part of it. An empty field that its pattern allows
    becomes null. Null and empty lines are 'column_count'. Each input row gives one result row, repeated
    or not, however long; an empty table gives none. ``keep`` names may not clash with field names: a
    ValueError says so. Other columns don't matter.
    """
    clash = ({*keep} | {"reason"}) & {f.name for f in fields} or {*keep} & {"reason"}
    if clash:
        raise ValueError(f"columns to keep clash with fields: {sorted(clash)}")
    carried = df.select(*keep).schema
    out = T.StructType([*carried.fields, T.StructField("reason", T.StringType()), *[T.StructField(f.name, _TYPES[f.kind]) for f in fields]])
    from pyspark.sql.pandas.types import to_arrow_schema

    return map_batches(df.select(*keep, df[line].cast("string").alias("__line")), _parser(fields, len(keep), to_arrow_schema(out)), out)

def _odd_splits(lines: DataFrame) -> set[tuple[str, int]]:
    """The splits that begin inside quotes: those before them in their file hold an odd number of quotes. One bit a split, of which the driver has the list anyway."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    per = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = per.select("file", "block", (F.sum("odd").over(earlier) % 2).alias("inside")).filter("inside = 1")
    return {(r.file, r.block) for r in begins.collect()}


#: What a row of ``_records`` is: a whole record, one that the split's end leaves open, or lines of one that began before the split.
_WHOLE, _OPEN, _REST = 0, 1, 2


def _records(odd: set[tuple[str, int]], borders: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines of splits, in order, into records: a line ends one where the quotes up to its end are even. ``borders``: give what splits cut, else the whole records."""

    def rows(at: tuple[str, int], first: int, records: pa.Array, kind: int) -> pa.RecordBatch:
        n = len(records)
        return pa.RecordBatch.from_arrays([pa.array([at[0]] * n, pa.string()), pa.array(np.full(n, at[1], np.int64)), pa.array(np.arange(first, first + n)), pa.array(np.full(n, kind, np.int8)), records.cast(pa.string())], names=["file", "block", "number", "kind", "record"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[str, int] | None = None
        number, inside, before, held = 0, False, False, []

        def rest() -> Iterator[pa.RecordBatch]:
            # of a split that never leaves the quotes all is the rest of an earlier record, and it goes on
            if held and borders:
                yield rows(now, number, pa.array(["\n".join(held)]), _REST if before else _OPEN)

        for b in batches:
            file, block = b.column(1), b.column(2).to_numpy(zero_copy_only=False)
            new = np.concatenate([[True], (block[1:] != block[:-1]) | _unequal(file)]) if b.num_rows else np.zeros(0, bool)
            cuts = np.flatnonzero(new)
            for lo, hi in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
                at = (file[int(lo)].as_py(), int(block[lo]))
                if at != now:
                    if now:
                        yield from rest()
                    now, number, held = at, 0, []
                    inside = before = at in odd
                lines = b.column(0).slice(lo, hi - lo)
                parity = (np.cumsum(pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)) + inside) % 2
                inside = bool(parity[-1])
                ends = np.flatnonzero(parity == 0)
                if not len(ends):
                    held += lines.to_pylist()
                    continue
                done = lines.slice(0, int(ends[-1]) + 1)
                starts = np.concatenate([[0], ends + 1]).astype(np.int32)
                records = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts), done), "\n")
                if held:
                    records = pa.concat_arrays([pa.array(["\n".join([*held, records[0].as_py()])], records.type), records[1:]])
                held = lines.slice(int(ends[-1]) + 1).to_pylist()
                if before:
                    if borders:
                        yield rows(now, number, records[:1], _REST)
                    records, before, number = records[1:], False, number + 1
                if len(records) and not borders:
                    yield rows(now, number, records, _WHOLE)
                number += len(records)
        if now:
            yield from rest()

    return run


def _unequal(names: pa.Array) -> np.ndarray:
    return pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of delimited files whose quoted fields may hold line breaks: file, block, number, record.

    Files are split as any text; quotes are counted by split, and their parity before a split tells whether it
    begins inside a quoted field. A record ends with the first line break behind an even number of quotes.
    What a split's borders cut is put together by file. ``block`` and ``number`` order the records of a
    file. A line break inside a field stays in it; a carriage return stays where it is. An empty line is an
    empty record; an empty file has none. A stray quote shifts what is inside and outside until the next one:
    ``parse_lines`` gives these records as rejects. Quotes still open at a file's end leave one last record.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    odd = _odd_splits(lines)
    schema = "file string, block long, number long, kind tinyint, record string"
    whole = map_batches(lines, _records(odd, False), schema).select("file", "block", "number", "record")
    cut = map_batches(lines, _records(odd, True), schema)
    # a record that is left open begins a run of pieces, one from each split that it goes through
    run = F.sum((F.col("kind") == _OPEN).cast("long")).over(Window.partitionBy("file").orderBy("block", "number"))
    pieces = F.array_sort(F.collect_list(F.struct("block", "number", "record")))
    joined = cut.withColumn("run", run).groupBy("file", "run").agg(pieces.alias("p"))
    joined = joined.select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["number"].alias("number"), F.array_join(F.col("p")["record"], "\n").alias("record"))
    return whole.union(joined)
