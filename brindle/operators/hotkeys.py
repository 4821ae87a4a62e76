"""Per-key counts and sums that a few dominant keys cannot hold up.

Rows stay where the file splits put them: every equal-sized split dictionary-encodes its keys and adds
to dense accumulator arrays with ``bincount``. Only the arrays move, in blocks: a key's block is fixed by
its hash, so the blocks of all splits with one number belong together. Where they meet they get one
dictionary, whole arrays are aligned to it and added. A key with most of the rows contributes one entry
per split, like any other key, and no block gets more arrays than there are splits.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.session import map_batches

#: Blocks of a field's dictionary, and entries at which a split sends its arrays and starts again.
BLOCKS, FULL = 4096, 1 << 18


def clean_code(c: Column) -> Column:
    """A code without surrounding blanks (U+0020) and in upper case; null when null or empty."""
    s = F.upper(F.trim(c.cast("string")))
    return F.when(s != "", s)


class _Dense:
    """A dictionary and its accumulator arrays: the rows, then sum and count of each measure."""

    def __init__(self, arrays: int):
        self.codes: dict[str | None, int] = {}
        self.sums = np.zeros((arrays, 64), np.int64)

    def encode(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Small codes of the keys, and for each small code the one in this dictionary, which grows as needed."""
        coded = keys.dictionary_encode(null_encoding="encode")
        known = [self.codes.setdefault(k, len(self.codes)) for k in coded.dictionary.to_pylist()]
        if len(self.codes) > self.sums.shape[1]:
            wider = np.zeros((len(self.sums), 2 * len(self.codes)), np.int64)
            wider[:, : self.sums.shape[1]] = self.sums
            self.sums = wider
        return coded.indices.to_numpy(zero_copy_only=False), np.asarray(known, np.int64)

    def add(self, keys: pa.Array, measures: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Rows with their measures' values and which of these are present."""
        small, at = self.encode(keys)
        m = len(at)
        self.sums[0, at] += np.bincount(small, minlength=m)
        for i, (v, ok) in enumerate(measures):
            # two halves, so that float weights hold integer sums exactly whatever the values
            low = np.bincount(small, weights=(v & 0xFFFFFFFF).astype(np.float64), minlength=m).astype(np.int64)
            high = np.bincount(small, weights=(v >> 32).astype(np.float64), minlength=m).astype(np.int64)
            self.sums[1 + 2 * i, at] += (high << 32) + low
            self.sums[2 + 2 * i, at] += np.bincount(small[ok], minlength=m)

    def add_block(self, keys: pa.Array, arrays: list[np.ndarray]) -> None:
        """Other splits' arrays, aligned to this dictionary."""
        small, at = self.encode(keys)
        for total, values in zip(self.sums, arrays, strict=True):
            aligned = np.zeros(len(at), np.int64)
            np.add.at(aligned, small, values)
            total[at] += aligned

    def blocks(self, field: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The arrays cut into blocks, and nothing left."""
        keys = list(self.codes)
        if keys:
            block = np.array([zlib.crc32(k.encode("utf-8", "surrogatepass")) % BLOCKS if k is not None else 0 for k in keys], np.int32)
            order = np.argsort(block, kind="stable")
            numbers, first = np.unique(block[order], return_index=True)
            offsets = pa.array(np.append(first, len(keys)).astype(np.int32))
            arrays = [pa.array(np.full(len(numbers), field, np.int32)), pa.array(numbers), pa.ListArray.from_arrays(offsets, pa.array(keys, pa.string()).take(pa.array(order)))]
            arrays += [pa.ListArray.from_arrays(offsets, pa.array(row[order])) for row in self.sums]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)
        self.__init__(len(self.sums))


def _accumulate(fields: int, measures: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("field", pa.int32()), ("block", pa.int32()), ("keys", pa.list_(pa.string())), *[(f"a{i}", pa.list_(pa.int64())) for i in range(1 + 2 * measures)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = [_Dense(1 + 2 * measures) for _ in range(fields)]
        for b in batches:
            if not b.num_rows:
                continue
            values = []
            for i in range(measures):
                c = b.column(fields + i)
                values.append((c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), c.is_valid().to_numpy(zero_copy_only=False)))
            for i, d in enumerate(dense):
                d.add(b.column(i), values)
                if len(d.codes) > FULL:
                    yield from d.blocks(i, schema)
        for i, d in enumerate(dense):
            yield from d.blocks(i, schema)

    return run


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by field and number: those with the same are added up, one at a time."""
    held: _Dense | None = None
    now: tuple[int, int] | None = None

    def done() -> pa.RecordBatch:
        n = len(held.codes)
        columns = [pa.array(np.full(n, now[0], np.int32)), pa.array(list(held.codes), pa.string()), *[pa.array(row[:n].copy()) for row in held.sums]]
        return pa.RecordBatch.from_arrays(columns, names=["field", "key", *[f"a{i}" for i in range(len(held.sums))]])

    for b in batches:
        field, block = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        cuts = np.flatnonzero(np.concatenate([[True], (field[1:] != field[:-1]) | (block[1:] != block[:-1])])) if b.num_rows else []
        for lo, hi in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
            name = int(field[lo]), int(block[lo])
            if name != now:
                if held:
                    yield done()
                held, now = _Dense(b.num_columns - 3), name
            part = b.slice(lo, hi - lo)
            held.add_block(part.column(2).flatten(), [part.column(i).flatten().to_numpy(zero_copy_only=False) for i in range(3, b.num_columns)])
    if held:
        yield done()


def key_totals(df: DataFrame, keys: dict[str, Column], measures: dict[str, Column]) -> DataFrame:
    """Rows, and sum and count of each integer measure, of every value of each key field.

    Result: key_field, key_value (null for rows without a key, so that the rows of a field add up to the
    table's), n_rows, and for each measure <name>_sum (null where no value is present) and <name>_count.
    Nulls in a measure are left out. Repeated rows count each time. An empty table gives an empty result.
    Sums must fit in 63 bits. Columns of ``df`` that no expression names aren't read.
    """
    names = list(keys)
    cols = [c.cast("string").alias(f"k{i}") for i, c in enumerate(keys.values())] + [c.cast("long").alias(f"m{i}") for i, c in enumerate(measures.values())]
    arrays = [f"a{i}" for i in range(1 + 2 * len(measures))]
    schema = T.StructType([T.StructField("field", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("keys", T.ArrayType(T.StringType())), *[T.StructField(a, T.ArrayType(T.LongType())) for a in arrays]])
    blocks = map_batches(df.select(*cols), _accumulate(len(names), len(measures)), schema)
    together = blocks.repartition("field", "block").sortWithinPartitions("field", "block")
    total = map_batches(together, _reduce, f"field int, key string, {', '.join(f'{a} long' for a in arrays)}")
    out = [F.element_at(F.array(*[F.lit(n) for n in names]), F.col("field") + 1).alias("key_field"), F.col("key").alias("key_value"), F.col("a0").alias("n_rows")]
    for i, m in enumerate(measures):
        out += [F.when(F.col(f"a{2 + 2 * i}") > 0, F.col(f"a{1 + 2 * i}")).alias(f"{m}_sum"), F.col(f"a{2 + 2 * i}").alias(f"{m}_count")]
    return total.select(*out)


def dominant(totals: DataFrame, all_rows: int, share: tuple[int, int] = (5, 100)) -> DataFrame:
    """The keys of ``key_totals`` that at least this share of ``all_rows`` rows have: key_field, key_value."""
    hit = F.col("n_rows").cast("decimal(20,0)") * share[1] >= F.lit(all_rows).cast("decimal(20,0)") * share[0]
    return totals.filter(F.col("key_value").isNotNull() & hit).select("key_field", "key_value")
