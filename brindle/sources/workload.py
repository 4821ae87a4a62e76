"""Patterns of reads and writes over an integer key, for trying table layouts."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.sources.tables import KeyedTable


@dataclass(frozen=True)
class Op:
    """write or read of a key, scan_range of [key, end), or scan_all."""

    kind: str
    key: int = 0
    end: int = 0


def append(start: int = 0) -> Iterator[Op]:
    while True:
        yield Op("write", start)
        start += 1


def rand(kind: str, low: int, high: int, seed: int = 0) -> Iterator[Op]:
    pick = random.Random(seed)
    while True:
        yield Op(kind, pick.randrange(low, high))


def rand_scan_range(low: int, high: int, width: int, seed: int = 0) -> Iterator[Op]:
    pick = random.Random(seed)
    while True:
        a = pick.randrange(low, max(low + 1, high - width))
        yield Op("scan_range", a, a + width)


def scan_all() -> Iterator[Op]:
    while True:
        yield Op("scan_all")


def round_robin(*patterns: Iterator[Op]) -> Iterator[Op]:
    while True:
        for p in patterns:
            yield next(p)


def times(n: int, pattern: Iterator[Op]) -> Iterator[Op]:
    """The first n operations of a pattern."""
    return itertools.islice(pattern, n)


def key_range(ops: list[Op]) -> tuple[int, int] | None:
    """The least and greatest key that some operations touch; None where they touch none or all."""
    keys = [k for o in ops if o.kind != "scan_all" for k in (o.key, o.end - 1 if o.kind == "scan_range" else o.key)]
    return (min(keys), max(keys)) if keys else None


def run(table: KeyedTable, ops: Iterable[Op], row: Callable[[int], tuple]) -> dict[str, int]:
    """Operations on a keyed table, in their order: how many of each kind, and rows written and read. Neighbouring writes are one append of ``row(key)``."""
    done = {"write": 0, "read": 0, "scan_range": 0, "scan_all": 0, "rows_written": 0, "rows_read": 0}
    for writes, group in itertools.groupby(ops, lambda o: o.kind == "write"):
        if writes:
            keys = [o.key for o in group]
            table.append(table.spark.createDataFrame([row(k) for k in keys], table.schema), version=table.next_version())
            done["write"] += len(keys)
            done["rows_written"] += len(keys)
            continue
        for o in group:
            done["rows_read"] += read(table.read(), table.info.key[0], o).count()
            done[o.kind] += 1
    return done


def chance(weighted: list[tuple[float, Iterator[Op]]], seed: int = 0) -> Iterator[Op]:
    pick = random.Random(seed)
    weights = [w for w, _ in weighted]
    while True:
        yield next(pick.choices([p for _, p in weighted], weights)[0])


def read(df: DataFrame, key: str, op: Op) -> DataFrame:
    """The rows that a read or scan sees."""
    if op.kind == "read":
        return df.filter(F.col(key) == op.key)
    if op.kind == "scan_range":
        return df.filter((F.col(key) >= op.key) & (F.col(key) < op.end))
    if op.kind == "scan_all":
        return df
    raise ValueError(f"{op.kind} reads nothing")
