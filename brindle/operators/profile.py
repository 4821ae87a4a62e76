"""Exact column profiles of loads, how each load differs from the one before it, and cells of wrong form.

Cells are unpivoted and counted once per (column, load, value): all else comes from these counts. They are
range-sorted by (column, load pair, value), a pair being a load with its predecessor. Inside one range
partition prefix sums over the two count columns are the two cumulative curves merged by value, and each
distinct value is judged by its column's rule. What a partition holds completely is finished there; a pair
that a partition boundary cuts leaves its rows with their local prefix counts, to which the counts of the
partitions before are added afterwards. So a load of any size is spread over as many tasks as its values
fill, and quantiles, distinct counts and distances are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import map_batches, stage

QUANTILES = (0.25, 0.5, 0.75)
#: Rows of a partition that are in memory at once.
CHUNK = 1 << 19
_STATS = "n_distinct long, top_count long, min_value string, max_value string, quantiles array<string>, l1 decimal(38,0), ks decimal(38,0)"
_RAW = "seg long, value string, num double, new long, old long, cum_new long, cum_old long, doubt boolean"
_SCHEMA = f"col tinyint, pair long, n_new long, n_old long, {_STATS}, {_RAW}"


@dataclass(frozen=True)
class ColumnRule:
    """What a column's present cells must look like.

    ``pattern``: an RE2 regular expression for the whole cell. ``allowed``: a one-column table of valid
    values. ``numeric``: order values as numbers rather than as strings.
    """

    name: str
    pattern: str | None = None
    allowed: DataFrame | None = field(default=None, compare=False)
    numeric: bool = False


def present(c: Column, numeric: bool = False) -> Column:
    """The cell as stored, as a string; null when missing: null, empty or only blanks."""
    s = c.cast("string")
    return s if numeric else F.when(F.trim(s) != "", s)


def _cells(df: DataFrame, rules: list[ColumnRule], load: str, *more: str) -> DataFrame:
    """One row per cell: load, [more], col, value, which is null where the cell is missing."""
    rows = F.array(*[F.struct(F.lit(i).cast("tinyint").alias("col"), present(F.col(f"`{r.name}`"), r.numeric).alias("value")) for i, r in enumerate(rules)])
    return df.select(F.col(f"`{load}`").cast("long").alias("load"), *[F.col(m) for m in more], F.inline(rows))


def _name(rules: list[ColumnRule]) -> Column:
    return F.element_at(F.array(*[F.lit(r.name) for r in rules]), F.col("col").cast("int") + 1)


def load_totals(hist: DataFrame, chain: DataFrame) -> DataFrame:
    """Rows and present cells of each (column, load) and of the load before, from the counts of values: col, pair, rows_new, n_new, rows_old, n_old."""
    n = F.sum(F.when(F.col("value").isNotNull(), F.col("n")))
    counts = hist.groupBy("col", F.col("load").alias("pair")).agg(F.sum("n").alias("rows_new"), F.coalesce(n, F.lit(0)).alias("n_new"))
    old = counts.select(F.col("col"), F.col("pair").alias("src"), F.col("rows_new").alias("rows_old"), F.col("n_new").alias("n_old"))
    before = chain.join(old, "src").select("col", "pair", "rows_old", "n_old")
    return counts.join(before, ["col", "pair"], "left").fillna(0, ["rows_old", "n_old"]).select("col", "pair", "rows_new", "n_new", "rows_old", "n_old")


def _differs(a: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it; null equals null."""
    x, y = a[1:], a[:-1]
    ne = pc.fill_null(pc.not_equal(x, y), False).to_numpy(zero_copy_only=False)
    return ne | (pc.is_null(x).to_numpy(zero_copy_only=False) != pc.is_null(y).to_numpy(zero_copy_only=False))


def _curves(doubts: dict[int, str | None], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range partition, sorted by (col, pair, hdr, num, value), header rows (hdr 0) first within their pair.

    It is taken in chunks of some hundred thousand rows, cut between values; what a chunk doesn't hold whole counts as cut by a partition boundary.
    ``doubts``: of each column whose values are judged the pattern, or None where a table of valid values decides later.
    """
    from pyspark import TaskContext

    seg, held, size = TaskContext.get().partitionId() << 32, [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size >= CHUNK:
            t = pa.Table.from_batches(held).combine_chunks()
            last = t.num_rows - 1
            # a value has two rows at most: the last one stays with what follows if it is the same value
            while last > 0 and all(t.column(n)[last].as_py() == t.column(n)[last - 1].as_py() for n in ("col", "pair", "hdr", "value")):
                last -= 1
            if last:
                yield from _chunk(t.slice(0, last), seg, doubts)
                seg += 1
            held = t.slice(last).combine_chunks().to_batches()
            size = sum(x.num_rows for x in held)
    if held:
        yield from _chunk(pa.Table.from_batches(held).combine_chunks(), seg, doubts)


def _doubtful(doubts: dict[int, str | None], col: np.ndarray, value: pa.Array, own: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The values among a chunk's distinct ones that break a pattern or are still to be looked up; each once."""
    for c, pattern in doubts.items():
        at = np.flatnonzero((col == c) & own)
        if not len(at):
            continue
        v = pc.unique(value.take(pa.array(at)))
        if pattern is not None:
            v = v.filter(pc.invert(pc.match_substring_regex(v, rf"\A(?:{pattern})\z")))
        if len(v):
            known = {"col": pa.array(np.full(len(v), c, np.int8)), "value": v, "doubt": pa.array([True] * len(v))}
            yield pa.RecordBatch.from_arrays([known.get(f.name, pa.nulls(len(v), f.type)) for f in _ARROW], schema=_ARROW)


def _chunk(t: pa.Table, seg: int, doubts: dict[int, str | None]) -> Iterator[pa.RecordBatch]:
    """Finished pairs of a chunk, the rows of those that its ends cut, with their prefix counts in it, and doubtful values."""
    one = {n: (c.chunk(0) if isinstance(c := t.column(n), pa.ChunkedArray) else c) for n in t.column_names}
    new, old, hdr = (one[n].to_numpy(zero_copy_only=False) for n in ("new", "old", "hdr"))
    cut = np.concatenate([[True], _differs(one["col"]) | _differs(one["pair"])])  # a pair begins
    diff = np.concatenate([[True], cut[1:] | (hdr[1:] != hdr[:-1]) | _differs(one["value"])])
    at = np.flatnonzero(diff)
    new, old = np.add.reduceat(new, at), np.add.reduceat(old, at)
    is_cell = hdr[at] == 1
    pair_at = np.flatnonzero(cut[at])
    ends = np.append(pair_at[1:], len(at))
    pos = pa.array(at)
    value, num = one["value"].take(pos), one["num"].take(pos)
    yield from _doubtful(doubts, one["col"].take(pos).to_numpy(zero_copy_only=False), value, is_cell & (new > 0))
    col, pair = one["col"].take(pos.take(pa.array(pair_at))), one["pair"].take(pos.take(pa.array(pair_at)))
    done: list[dict] = []
    raw: list[pa.RecordBatch] = []
    cell_new, cell_old = np.where(is_cell, new, 0), np.where(is_cell, old, 0)
    for k, (lo, hi) in enumerate(zip(pair_at, ends, strict=True)):
        head = not is_cell[lo]
        n_new, n_old = (int(new[lo]), int(old[lo])) if head else (0, 0)
        a, b = cell_new[lo + head : hi], cell_old[lo + head : hi]
        cum_a, cum_b = np.cumsum(a), np.cumsum(b)
        whole = head and (int(cum_a[-1]) if len(a) else 0) == n_new and (int(cum_b[-1]) if len(b) else 0) == n_old
        row = {"col": col[k].as_py(), "pair": pair[k].as_py()}
        if not whole:
            m = hi - lo - head
            if m:
                raw.append(_raw_rows(row, seg, value.slice(lo + head, m), num.slice(lo + head, m), a, b, cum_a, cum_b))
            continue
        own = np.flatnonzero(a)
        v = value.slice(lo + head, hi - lo - head)
        picks = [v[int(np.searchsorted(cum_a, max(1, int(np.ceil(q * n_new)))))].as_py() for q in QUANTILES] if n_new else None
        both = n_new > 0 and n_old > 0
        # Python integers where products could pass 63 bits
        wide = both and 2 * n_new * n_old >= 2**62
        A, B, CA, CB = (x.astype(object) for x in (a, b, cum_a, cum_b)) if wide else (a, b, cum_a, cum_b)
        done.append(row | {
            "n_new": n_new, "n_old": n_old, "n_distinct": len(own), "top_count": int(a.max()) if len(a) else 0,
            "min_value": v[int(own[0])].as_py() if len(own) else None, "max_value": v[int(own[-1])].as_py() if len(own) else None, "quantiles": picks,
            "l1": _dec(np.abs(A * n_old - B * n_new).sum()) if both else None, "ks": _dec(np.abs(CA * n_old - CB * n_new).max()) if both else None,
        })
        if len(done) >= 4096:
            yield _done_rows(done)
            done = []
    if done:
        yield _done_rows(done)
    yield from raw


def _dec(x: object):
    from decimal import Decimal

    return Decimal(int(x))


_ARROW = pa.schema([
    ("col", pa.int8()), ("pair", pa.int64()), ("n_new", pa.int64()), ("n_old", pa.int64()), ("n_distinct", pa.int64()), ("top_count", pa.int64()), ("min_value", pa.string()), ("max_value", pa.string()),
    ("quantiles", pa.list_(pa.string())), ("l1", pa.decimal128(38, 0)), ("ks", pa.decimal128(38, 0)), ("seg", pa.int64()), ("value", pa.string()), ("num", pa.float64()), ("new", pa.int64()), ("old", pa.int64()),
    ("cum_new", pa.int64()), ("cum_old", pa.int64()), ("doubt", pa.bool_()),
])


def _done_rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _ARROW], schema=_ARROW)


def _raw_rows(row: dict, seg: int, value: pa.Array, num: pa.Array, *counts: np.ndarray) -> pa.RecordBatch:
    m = len(value)
    known = {"col": pa.array(np.full(m, row["col"], np.int8)), "pair": pa.array([row["pair"]] * m, pa.int64()), "seg": pa.array(np.full(m, seg, np.int64)), "value": value, "num": num}
    known |= {n: pa.array(c.astype(np.int64)) for n, c in zip(("new", "old", "cum_new", "cum_old"), counts, strict=True)}
    return pa.RecordBatch.from_arrays([known[f.name].cast(f.type) if f.name in known else pa.nulls(m, f.type) for f in _ARROW], schema=_ARROW)


@dataclass(frozen=True)
class Profile:
    """What ``profile_loads`` gives: ``loads``, one row per column and load, and ``bad_values``, one per column and distinct value that breaks its rule."""

    loads: DataFrame
    bad_values: DataFrame


def profile_loads(
    df: DataFrame, loads: DataFrame, rules: list[ColumnRule], *, load: str = "load_id", prev: str = "prev_load_id", loads_key: str | None = None
) -> Profile:
    """Profile each column of each load, against the load before it.

    ``loads`` of the result, one row per (column_name, load) with rows: n_rows, n_missing, n_distinct, top_count, min_value,
    max_value, quantiles (at 25, 50 and 75 %, the least value whose cumulative share reaches it), then of
    the load before prev_rows, prev_missing, and as exact numerators over n_present * prev_present: l1 (the absolute
    differences of value shares, summed) and ks (the Kolmogorov-Smirnov distance). ``bad_values``:
    column_name, value; ``bad_cells`` finds their cells.

    A cell is missing when null, empty or only blanks. Rows whose load is null form a load of their own,
    without predecessor. A load without present cells has n_distinct 0 and null values; l1 and ks are null
    unless both loads have present cells. Loads that no row names have no result row. Repeated rows count
    each time; an empty table gives an empty result. Other columns of ``df`` don't matter, whatever their names.
    """
    key = loads_key or load
    hist = stage(_cells(df, rules, load).groupBy("col", "load", "value").agg(F.count(F.lit(1)).alias("n")), "values")
    chain = loads.select(F.col(key).cast("long").alias("pair"), F.col(prev).cast("long").alias("src")).filter("src is not null").dropDuplicates(["pair"])
    totals = stage(load_totals(hist, chain), "totals")
    number = F.lit(None).cast("double")
    for i, r in enumerate(rules):
        if r.numeric:
            number = F.when(F.col("col") == i, F.expr("try_cast(value as double)")).otherwise(number)
    # each load's counts go to its own pair, and to the pairs of the loads that follow it, where these have rows
    there = totals.select("pair").distinct()
    links = there.select(F.col("pair").alias("src"), "pair", F.lit(True).alias("own")).union(chain.join(there, "pair", "left_semi").select("src", "pair", F.lit(False)))
    counts = hist.filter("value is not null").join(links, F.col("load").eqNullSafe(F.col("src")))
    zero, n = F.lit(0).cast("long"), F.col("n")
    cells = counts.select("col", "pair", F.lit(1).cast("tinyint").alias("hdr"), number.alias("num"), "value", F.when(F.col("own"), n).otherwise(zero).alias("new"), F.when(F.col("own"), zero).otherwise(n).alias("old"))
    heads = totals.select("col", "pair", F.lit(0).cast("tinyint").alias("hdr"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("string").alias("value"), F.col("n_new").alias("new"), F.col("n_old").alias("old"))
    order = ["col", "pair", "hdr", "num", "value"]
    ranged = cells.union(heads).repartitionByRange(*order).sortWithinPartitions(*order)
    doubts = {i: r.pattern for i, r in enumerate(rules) if r.pattern is not None or r.allowed is not None}
    curves = stage(map_batches(ranged, partial(_curves, doubts), _SCHEMA), "curves")
    stats = ["n_distinct", "top_count", "min_value", "max_value", "quantiles", "l1", "ks"]
    whole = curves.filter("n_new is not null").select("col", "pair", *stats)
    found = whole.union(_joined_up(curves.filter("seg is not null"), totals).select("col", "pair", *stats))
    same = [F.col("t.col").eqNullSafe(F.col("s.col")), F.col("t.pair").eqNullSafe(F.col("s.pair"))]
    profile = (
        totals.alias("t")
        .join(found.alias("s"), same[0] & same[1], "left")
        .select(
            F.element_at(F.array(*[F.lit(r.name) for r in rules]), F.col("t.col").cast("int") + 1).alias("column_name"), F.col("t.pair").alias("load"), F.col("rows_new").alias("n_rows"),
            (F.col("rows_new") - F.col("n_new")).alias("n_missing"), *[F.coalesce(F.col(f"s.{c}"), F.lit(0)).alias(c) if c in ("n_distinct", "top_count") else F.col(f"s.{c}") for c in stats],
            F.col("rows_old").alias("prev_rows"), (F.col("rows_old") - F.col("n_old")).alias("prev_missing"),
        )
    )
    doubtful = curves.filter("doubt").select("col", "value")
    valid = [r.allowed.select(F.lit(i).cast("tinyint").alias("col"), F.col(f"`{r.allowed.columns[0]}`").cast("string").alias("value")) for i, r in enumerate(rules) if r.pattern is None and r.allowed is not None]
    if valid:
        doubtful = doubtful.join(reduce(DataFrame.union, valid), ["col", "value"], "left_anti")
    return Profile(profile, doubtful.distinct().select(_name(rules).alias("column_name"), "value"))


def bad_cells(df: DataFrame, profile: Profile, rules: list[ColumnRule], load: str, row: str) -> DataFrame:
    """The cells that have one of the profile's bad values: column_name, load, row, value. The table is read once more, and the bad values, staged so that Spark knows their size, are matched to it."""
    number = F.array_position(F.array(*[F.lit(r.name) for r in rules]), F.col("column_name")) - 1
    bad = stage(profile.bad_values.select(number.cast("tinyint").alias("col"), "value"), "bad")
    cells = _cells(df.withColumn("__row", F.col(f"`{row}`")), rules, load, "__row").filter(F.col("value").isNotNull())
    return cells.join(bad, ["col", "value"], "left_semi").select(_name(rules).alias("column_name"), "load", F.col("__row").alias("row"), "value")


def _joined_up(raw: DataFrame, totals: DataFrame) -> DataFrame:
    """Statistics of the pairs that partition boundaries cut, from their rows and the prefix counts of the partitions before."""
    segs = raw.groupBy("col", "pair", "seg").agg(F.max("cum_new").alias("t_new"), F.max("cum_old").alias("t_old"))
    earlier = Window.partitionBy("col", "pair").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    segs = segs.select("col", "pair", "seg", F.coalesce(F.sum("t_new").over(earlier), F.lit(0)).alias("off_new"), F.coalesce(F.sum("t_old").over(earlier), F.lit(0)).alias("off_old"))
    segs = segs.alias("g").join(totals.alias("t"), F.col("g.col").eqNullSafe(F.col("t.col")) & F.col("g.pair").eqNullSafe(F.col("t.pair")))
    segs = segs.select(F.col("g.col").alias("col"), F.col("g.pair").alias("pair"), "seg", "off_new", "off_old", "n_new", "n_old")
    on = F.col("r.col").eqNullSafe(F.col("g.col")) & F.col("r.pair").eqNullSafe(F.col("g.pair")) & (F.col("r.seg") == F.col("g.seg"))
    rows = raw.select("col", "pair", "seg", "value", "num", "new", "old", "cum_new", "cum_old").alias("r").join(segs.alias("g"), on)
    d = lambda c: F.col(c).cast("decimal(19,0)")
    up, prior = F.col("off_new") + F.col("cum_new"), F.col("off_old") + F.col("cum_old")
    both = (F.col("n_new") > 0) & (F.col("n_old") > 0)
    place = F.struct("num", "value")
    reach = [F.min(F.when((F.col("new") > 0) & (up >= F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n_new")))), place))["value"] for q in QUANTILES]
    return rows.groupBy(F.col("r.col").alias("col"), F.col("r.pair").alias("pair")).agg(
        F.sum((F.col("new") > 0).cast("long")).alias("n_distinct"),
        F.max("new").alias("top_count"),
        F.min(F.when(F.col("new") > 0, place))["value"].alias("min_value"),
        F.max(F.when(F.col("new") > 0, place))["value"].alias("max_value"),
        F.when(F.max("n_new") > 0, F.array(*reach)).alias("quantiles"),
        F.sum(F.when(both, F.abs(d("new") * d("n_old") - d("old") * d("n_new")))).cast("decimal(38,0)").alias("l1"),
        F.max(F.when(both, F.abs(up.cast("decimal(19,0)") * d("n_old") - prior.cast("decimal(19,0)") * d("n_new")))).cast("decimal(38,0)").alias("ks"),
    )


def load_findings(profile: Profile, *, drift: tuple[int, int] | None = None, jump: tuple[int, int] = (15, 100), shift: tuple[int, int] = (70, 100), stuck: tuple[int, int] = (1, 10), shift_columns: tuple[str, ...] = (), stuck_columns: tuple[str, ...] = ()) -> DataFrame:
    """Findings on whole loads of ``profile_loads``: column_name, finding, load. Thresholds are fractions, compared without rounding.

    ``drift``: from which Kolmogorov-Smirnov distance to the load before a load is a 'drift', by default none is.
    """
    d = lambda c: F.col(c).cast("decimal(19,0)")
    filled, before = d("n_rows") - d("n_missing"), d("prev_rows") - d("prev_missing")
    rules = {
        "missing_jump": (F.col("prev_rows") > 0) & ((d("n_missing") * d("prev_rows") - d("prev_missing") * d("n_rows")) * jump[1] >= d("n_rows") * d("prev_rows") * jump[0]),
        "shift": F.col("column_name").isin(*shift_columns) & (F.col("l1") * shift[1] >= filled * before * shift[0]),
        "stuck": F.col("column_name").isin(*stuck_columns) & (filled > 0) & (d("top_count") * stuck[1] >= filled * stuck[0]),
    }
    if drift:
        rules["drift"] = F.col("ks") * drift[1] >= filled * before * drift[0]
    hits = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    return profile.loads.select("column_name", F.explode(hits).alias("finding"), "load")
