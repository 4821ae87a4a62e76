"""How often every distinct term occurs, and in how many records: recursive radix spilling.

Each input split first adds up its own terms, so that a term in a third of all rows travels once per
batch. A shuffle then partitions the sums by hash, the first radix level. Each task partitions what it
gets by four further hash bits into Parquet pieces in the shared folder, spills pieces above its budget
again by the next bits, and has DuckDB aggregate every piece out-of-core under a memory limit. That is the
only way, whatever the size: any number of distinct terms fits, whatever the task's memory.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.session import map_batches, plain_path, shared_path

SCHEMA = "vocabulary string, term string, n_occurrences long, n_records long"
_ARROW = pa.schema([("vocabulary", pa.string()), ("term", pa.string()), ("n_occurrences", pa.int64()), ("n_records", pa.int64())])
#: Bytes from which a piece is spilled again, hash bits of a level, and levels at most: then one term's rows are left, or too few bits.
BUDGET, BITS, LEVELS = 64 << 20, 4, 12
#: Bytes of a row beside its strings, and of DuckDB's memory at least.
ROW, MEMORY = 32, 256 << 20
_TOTAL = "SELECT vocabulary, term, sum(n_occurrences)::BIGINT AS n_occurrences, sum(n_records)::BIGINT AS n_records FROM {} GROUP BY ALL"


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up equal terms of some batches; the arrays held stay below about 16 MB."""
    held: list[pa.RecordBatch] = []
    size = 0

    def add() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).group_by(["vocabulary", "term"]).aggregate([("n_occurrences", "sum"), ("n_records", "sum")])
        return t.select(["vocabulary", "term", "n_occurrences_sum", "n_records_sum"]).rename_columns(_ARROW.names).cast(_ARROW).combine_chunks()

    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size > 16 << 20:
            yield from add().to_batches()
            held, size = [], 0
    if held:
        yield from add().to_batches()


def _radix(folder: str, budget: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        from pyspark import TaskContext

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        task = TaskContext.get()
        own = f"{folder}/{task.partitionId()}-{task.taskAttemptId()}"
        os.makedirs(own, exist_ok=True)
        con = duckdb.connect(config={"threads": 1, "memory_limit": f"{max(MEMORY, 4 * budget) >> 20}MB", "temp_directory": f"{own}/tmp"})
        try:
            con.execute("SET preserve_insertion_order = false").fetchall()
            con.register("source", pa.RecordBatchReader.from_batches(_ARROW, _chain(first, batches)))
            _spill(con, "source", f"{own}/0", 0)
            con.unregister("source")
            todo = [(f"{own}/0", 1)]
            while todo:
                at, level = todo.pop()
                for piece in sorted(os.scandir(at), key=lambda e: e.name):
                    files = f"read_parquet('{piece.path}/*.parquet', hive_partitioning = false)"
                    if level < LEVELS and _bytes_in(con, f"{piece.path}/*.parquet") > budget:
                        _spill(con, files, f"{at}-{piece.name}", level)
                        todo.append((f"{at}-{piece.name}", level + 1))
                    else:
                        for b in con.sql(_TOTAL.format(files)).to_arrow_reader(65536):
                            yield b.cast(_ARROW)
                    shutil.rmtree(piece.path, ignore_errors=True)
        finally:
            con.close()
            shutil.rmtree(own, ignore_errors=True)

    return run


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first.cast(_ARROW)
    for b in rest:
        yield b.cast(_ARROW)


def _bytes_in(con, files: str) -> int:
    """About what a piece takes in memory, from its files' footers."""
    rows = con.execute(f"SELECT coalesce(sum(num_rows), 0) FROM parquet_file_metadata('{files}')").fetchall()[0][0]
    strings = con.execute(f"SELECT coalesce(sum(total_uncompressed_size), 0) FROM parquet_metadata('{files}') WHERE path_in_schema = 'term'").fetchall()[0][0]
    return ROW * int(rows) + int(strings)


def _spill(con, source: str, to: str, level: int) -> None:
    """Partition by the level's hash bits into folders; the hash is of the term, so a folder holds all rows of its terms."""
    os.makedirs(to, exist_ok=True)
    digit = f"((hash(vocabulary, term) >> {60 - BITS * level}) & {2**BITS - 1})::INTEGER AS digit"
    con.execute(f"COPY (SELECT *, {digit} FROM {source}) TO '{to}' (FORMAT parquet, PARTITION_BY (digit), OVERWRITE_OR_IGNORE, COMPRESSION zstd)").fetchall()


def _terms_of(name: str, cols: list[Column]) -> list[Column]:
    """For each column of a vocabulary a term with its occurrences in the record; the term is null where an earlier column has the same."""
    values, one = [c.cast("string") for c in cols], F.lit(1).cast("long")
    out = []
    for i, v in enumerate(values):
        term, times = v, one
        for k, other in enumerate(values):
            if k < i:
                term = F.when(~v.eqNullSafe(other), term)
            elif k > i:
                times = times + v.eqNullSafe(other).cast("long")
        out.append(F.struct(F.lit(name).alias("vocabulary"), term.alias("term"), times.alias("n_occurrences"), one.alias("n_records")))
    return out


def term_counts(df: DataFrame, vocabularies: dict[str, list[Column]], *, partitions: int | None = None, budget: int = BUDGET) -> DataFrame:
    """Occurrences of every term, and the records that hold it.

    ``vocabularies``: the columns whose values make up each vocabulary. Nulls are no terms (let the
    expression turn empty values into null). A record that holds a term in several columns of a
    vocabulary counts once in n_records and each time in n_occurrences. Every row is a record, repeated
    rows too. Result: vocabulary, term, n_occurrences, n_records; empty for an empty table. Terms of any
    length are kept whole. The shared folder must be mounted, as DuckDB spills there: a ValueError otherwise.
    """
    spark = df.sparkSession
    folder = plain_path(shared_path(spark, "radix"))
    if folder is None:
        raise ValueError("terms are spilled to the shared folder: spark.checkpoint.dir must be one that is mounted")
    terms = df.select(F.inline(F.array(*[t for name, cols in vocabularies.items() for t in _terms_of(name, cols)]))).filter(F.col("term").isNotNull())
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    digit = F.pmod(F.xxhash64("vocabulary", "term"), F.lit(n)).cast("int")
    spread = map_batches(terms, _combine, SCHEMA).withColumn("digit", digit).repartitionById(n, F.col("digit")).drop("digit")
    return map_batches(spread, _radix(folder, budget), SCHEMA)


def mark_terms(counts: DataFrame, total: int, *, rare_below: int = 3, common_above: tuple[int, int] = (2, 100)) -> DataFrame:
    """Adds ``mark``: 'rare' below so many records, 'common' above this share of ``total`` records, else null; rare goes first."""
    common = F.col("n_records").cast("decimal(20,0)") * common_above[1] > F.lit(total).cast("decimal(20,0)") * common_above[0]
    return counts.withColumn("mark", F.when(F.col("n_records") < rare_below, "rare").when(common, "common"))
