"""Differences between two copies of a table, field by field.

Both copies' rows meet in one shuffle by key. Within a partition sorted by key, equal keys get one shared
ordinal; each side's current rows set bits in a compressed presence bitmap over the ordinals. AND-NOT of
the bitmaps gives the keys missing on a side; the ordinals in their intersection align both sides' columns
for comparison as whole arrays. Versions of a key are thinned out before the shuffle, so that a key with
very many versions stays small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation, localcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.session import map_batches

#: Ordinals of one bitmap container, and rows that are aligned at once.
CONTAINER, CHUNK = 1 << 16, 1 << 18


class PresenceBitmap:
    """A set of ordinals below ``size`` in containers of 65,536: nothing, everything, a short list, or bits; whichever is smallest."""

    def __init__(self, size: int, parts: list[np.ndarray | bool]):
        self.size, self.parts = size, parts

    @classmethod
    def of(cls, mask: np.ndarray) -> PresenceBitmap:
        return cls(len(mask), [cls._pack(mask[lo : lo + CONTAINER]) for lo in range(0, len(mask), CONTAINER)])

    @staticmethod
    def _pack(mask: np.ndarray) -> np.ndarray | bool:
        n = int(np.count_nonzero(mask))
        if n in (0, len(mask)):
            return n > 0
        return np.flatnonzero(mask).astype(np.uint16) if n * 16 < len(mask) else np.packbits(mask)

    def _mask(self, k: int) -> np.ndarray:
        m, part = min(CONTAINER, self.size - k * CONTAINER), self.parts[k]
        if isinstance(part, bool):
            return np.full(m, part)
        if part.dtype == np.uint8:
            return np.unpackbits(part, count=m).view(bool)
        mask = np.zeros(m, bool)
        mask[part] = True
        return mask

    def _with(self, other: PresenceBitmap, op: Callable) -> PresenceBitmap:
        parts: list[np.ndarray | bool] = []
        for k, (a, b) in enumerate(zip(self.parts, other.parts, strict=True)):
            parts.append(bool(op(np.bool_(a), np.bool_(b))) if isinstance(a, bool) and isinstance(b, bool) else self._pack(op(self._mask(k), other._mask(k))))
        return PresenceBitmap(self.size, parts)

    def __and__(self, other: PresenceBitmap) -> PresenceBitmap:
        return self._with(other, np.logical_and)

    def and_not(self, other: PresenceBitmap) -> PresenceBitmap:
        return self._with(other, lambda a, b: np.logical_and(a, np.logical_not(b)))

    def ordinals(self) -> np.ndarray:
        found = [np.flatnonzero(self._mask(k)) + k * CONTAINER for k in range(len(self.parts)) if self.parts[k] is not False]
        return np.concatenate(found) if found else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Copy:
    """One side: its table, and if it is versioned the columns of version and delete mark (1: the key is deleted)."""

    df: DataFrame
    version: str | None = None
    delete_mark: str | None = None


def _differs(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Elementwise; null equals null only."""
    ne = pc.fill_null(pc.not_equal(x, y), False).to_numpy(zero_copy_only=False)
    return ne | (pc.is_null(x).to_numpy(zero_copy_only=False) != pc.is_null(y).to_numpy(zero_copy_only=False))


def _new_key(b: pa.RecordBatch, more: tuple[str, ...] = ()) -> np.ndarray:
    """Whether each row's key (its columns from k0 on) is another than the row's before."""
    out = np.zeros(b.num_rows, bool)
    out[:1] = True
    for name in [n for n in b.schema.names if n.startswith("k")] + list(more):
        out[1:] |= _differs(b.column(name)[1:], b.column(name)[:-1])
    return out


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every some hundred thousand rows, those that may be current: of each key its highest version, and of repeated rows one."""
    held: list[pa.RecordBatch] = []

    def best() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        keys = [n for n in t.column_names if n.startswith("k")]
        b = _sorted(t, [*keys, "version", "mark"])
        fresh = _new_key(b)
        last = np.append(np.flatnonzero(fresh)[1:], b.num_rows) - 1
        group = np.cumsum(fresh) - 1
        version, mark = (b.column(n).to_numpy(zero_copy_only=False) for n in ("version", "mark"))
        top = np.flatnonzero((version == version[last[group]]) & (mark == mark[last[group]]))
        size = np.bincount(group[top], minlength=len(last))
        lone = size[group[top]] == 1
        if lone.all():
            return b.take(pa.array(top))
        by = [n for n in t.column_names if n.startswith("v") and n != "version"]
        ties = _sorted(pa.Table.from_batches([b.take(pa.array(top[~lone]))]), [*keys, *by])
        ties = ties.filter(pa.array(np.append(_new_key(ties)[1:], True)))
        return pa.Table.from_batches([b.take(pa.array(top[lone])), ties]).combine_chunks().to_batches()[0]

    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= CHUNK:
            yield best()
            held = []
    if held:
        yield best()


def _sorted(t: pa.Table, by: list[str]) -> pa.RecordBatch:
    order = pc.sort_indices(t, sort_keys=[(n, "ascending") for n in by], null_placement="at_start")
    return t.take(order).combine_chunks().to_batches()[0]


def _hundredths(texts: list[str | None], which: int) -> pa.Array:
    """Of the joined texts of numbers, one field's with two decimals; what is no finite number stays as it is."""
    out: list[str | None] = []
    with localcontext() as context:
        context.prec = 400
        for t in texts:
            v = t.split("|")[which] if t else ""
            try:
                out.append(f"{Decimal(v).quantize(Decimal('0.01'), ROUND_HALF_UP):f}" if v else None)
            except InvalidOperation:
                out.append(v)
    return pa.array(out, pa.string())


def _compare(fields: list[str], wide: list[str], keys: int, missing: tuple[str, str], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def aligned(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """``b``: all rows of some keys, sorted by key, side, version, mark and values."""
        side, mark = b.column("side").to_numpy(zero_copy_only=False), b.column("mark").to_numpy(zero_copy_only=False)
        fresh = _new_key(b)
        ordinal = np.cumsum(fresh) - 1
        n = int(ordinal[-1]) + 1
        first = np.flatnonzero(fresh)
        # of each key and side the last row holds: the highest version
        last = np.append(fresh[1:] | (side[1:] != side[:-1]), True)
        at, bits = [], []
        for s in (0, 1):
            rows = np.flatnonzero(last & (side == s))
            own = np.full(n, -1, np.int64)
            own[ordinal[rows]] = rows
            own[ordinal[rows[mark[rows] == 1]]] = -1
            at.append(own)
            bits.append(PresenceBitmap.of(own >= 0))
        for s in (0, 1):
            lone = bits[s].and_not(bits[1 - s]).ordinals()
            if len(lone):
                yield out(b, first[lone], missing[1 - s])
        both = (bits[0] & bits[1]).ordinals()
        if len(both):
            left, right = pa.array(at[0][both]), pa.array(at[1][both])
            for i, f in enumerate(fields):
                c = b.column(f"v{i}")
                differs = _differs(c.take(left), c.take(right))
                if f in wide and b.column("vwide").null_count < b.num_rows:
                    w = _hundredths(b.column("vwide").to_pylist(), wide.index(f))
                    differs |= _differs(w.take(left), w.take(right))
                wrong = np.flatnonzero(differs)
                if len(wrong):
                    yield out(b, first[both[wrong]], f)

    def out(b: pa.RecordBatch, rows: np.ndarray, what: str) -> pa.RecordBatch:
        idx = pa.array(rows)
        cols = [b.column(f"k{i}").take(idx) for i in range(keys)] + [pa.array([what] * len(rows), pa.string())]
        return pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows
            if size < CHUNK:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            cut = int(np.flatnonzero(_new_key(whole))[-1])  # the last key may go on
            if cut:
                yield from aligned(whole.slice(0, cut))
            tail = whole.slice(cut)
            # of a key that goes on and on, only each side's last row can matter
            ends = np.append(_new_key(tail, ("side",))[1:], True)
            held = [tail.filter(pa.array(ends))]
            size = held[0].num_rows
        if held:
            yield from aligned(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


_FRACTIONS, _WHOLE = (T.DecimalType, T.DoubleType, T.FloatType), (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: How a field's values are compared: numbers at two decimals, calendar dates, strings without trailing blanks, or as they are.
RULES = ("number", "date", "text", "exact")


def rule_for(left: T.DataType, right: T.DataType) -> str:
    """The rule of a field whose copies have these types, unless another is given."""
    if isinstance(left, _FRACTIONS) or isinstance(right, _FRACTIONS):
        return "number"
    if isinstance(left, T.DateType) or isinstance(right, T.DateType):
        return "date"
    return "text" if isinstance(left, T.StringType) and isinstance(right, T.StringType) else "exact"


def comparable(field: str, rule: str, own: T.DataType, shared: T.DataType) -> tuple[Column, Column | None]:
    """A value in the form that both copies have it in: numbers in hundredths, dates as days since 1970, strings without trailing blanks.

    Numbers from 10^16 on don't fit in hundredths: they are null there, and stand as text in the second
    column, which is none where the type has no such numbers.
    """
    c = f"`{field.replace('`', '``')}`"
    if rule == "number":
        small, text = F.expr(f"cast(try_cast({c} as decimal(18,2)) * 100 as bigint)"), F.expr(f"cast({c} as string)")
        if isinstance(own, (T.DoubleType, T.FloatType)):
            return small, F.when(~(F.abs(F.col(c)) < 1e16), text)
        if isinstance(own, T.DecimalType) and own.precision - own.scale < 16:
            return small, None
        return small, F.when(small.isNull(), text)
    if rule == "date":
        return F.unix_date(F.col(c).cast("date")), None
    if rule == "text":
        return F.rtrim(F.col(c).cast("string")), None
    return F.col(c).cast("long" if isinstance(shared, _WHOLE) else shared), None


def compare_copies(left: Copy, right: Copy, keys: list[str], fields: list[str] | None = None, *, names: tuple[str, str] = ("left", "right"), rules: dict[str, str] | None = None, partitions: int | None = None) -> DataFrame:
    """One row for each key that only one copy has, and for each field in which a key's current rows differ.

    Result: the keys, diff_field ('missing_in_<name>', or the field). ``fields``: by default the left copy's
    columns but the keys. In a versioned copy the row with the key's highest version is current, and none
    is if its delete mark is 1. Of several current rows of a key (repeated rows) that differ after
    normalising, the greatest by the fields in turn stands for all; a deletion beats another row of the same version.
    ``rules``: for a field one of RULES; without, fractions compare as numbers at two decimals, whatever
    their size, dates as calendar dates, strings without trailing blanks, all else as it is. Null equals
    null only, in keys as well. Extra columns on either side are left out. An empty copy makes each of the
    other's keys missing.
    """
    fields = fields or [c for c in left.df.columns if c not in keys]
    types = {f.name: f.dataType for f in left.df.schema.fields}
    others = {f.name: f.dataType for f in right.df.schema.fields}
    rule = {f: (rules or {}).get(f) or rule_for(types[f], others[f]) for f in fields}
    if unknown := {*rule.values()} - {*RULES}:
        raise ValueError(f"rules {sorted(unknown)} are none of {RULES}")

    def normal(c: Copy, side: int) -> DataFrame:
        cols = [F.col(f"`{k}`").cast(types[k]).alias(f"k{i}") for i, k in enumerate(keys)]
        version = F.col(f"`{c.version}`").cast("long") if c.version else F.lit(0).cast("long")
        mark = F.col(f"`{c.delete_mark}`").cast("int") if c.delete_mark else F.lit(0)
        cols += [F.lit(side).alias("side"), F.coalesce(version, F.lit(-(2**63))).alias("version"), F.coalesce(mark, F.lit(0)).alias("mark")]
        own = {f.name: f.dataType for f in c.df.schema.fields}
        forms = [comparable(f, rule[f], own[f], types[f]) for f in fields]
        cols += [v.alias(f"v{i}") for i, (v, _) in enumerate(forms)]
        # one column for the numbers beyond hundredths of all fields, null in nearly every row
        wide = {f: w for f, (_, w) in zip(fields, forms, strict=True) if w is not None}
        every = [F.coalesce(wide.get(f, F.lit("")), F.lit("")) for f in fields if rule[f] == "number"]
        some = F.coalesce(*wide.values()).isNotNull() if wide else F.lit(False)
        cols.append((F.when(some, F.concat_ws("|", *every)) if wide else F.lit(None).cast("string")).alias("vwide"))
        df = c.df.select(*cols)
        return map_batches(df, _thin, df.schema)

    rows = normal(left, 0).unionByName(normal(right, 1))
    key = [f"k{i}" for i in range(len(keys))]
    spread = rows.repartition(partitions, *key) if partitions else rows.repartition(*key)
    ordered = spread.sortWithinPartitions(*key, "side", "version", "mark", *[f"v{i}" for i in range(len(fields))], "vwide")
    out = T.StructType([*[T.StructField(k, types[k]) for k in keys], T.StructField("diff_field", T.StringType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    missing = (f"missing_in_{names[0]}", f"missing_in_{names[1]}")
    wide = [f for f in fields if rule[f] == "number"]
    return map_batches(ordered, _compare(fields, wide, len(keys), missing, to_arrow_schema(out)), out)
