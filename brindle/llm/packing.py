"""Items into containers of fixed capacity, with as little unused space as can be.

Only sizes matter for packing, and there are at most ``capacity`` of them: so the packing is planned on
the histogram of sizes, as container patterns with repetitions. A container takes the largest sizes left
until its gap can be filled exactly; then hashed sums of one, two or three available sizes are looked up
for the gap's exact complement. Where none exists the largest size that fits goes in, and the search goes
on with the smaller gap. Each item then finds its container from its rank among the items of its size, by
a prefix count over the parts of the table: no item moves for packing.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.bpe import encoder
from brindle.llm.encode import _length, parts, ship, vocabulary
from brindle.session import map_batches, stage_bucketed

_ITEMS = "item long, piece int, start long, size int, part int, seat long"


class SumIndex:
    """Which sizes, pairs and triples of sizes fill a gap exactly, under the numbers still available."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.capacity = len(counts) - 1
        self.pairs = np.zeros(len(counts), np.int32)
        self.sizes = np.flatnonzero(counts)
        for s in self.sizes:
            self._count_pairs(int(s), self.sizes[self.sizes <= s], 1)

    def _count_pairs(self, s: int, partners: np.ndarray, by: int) -> None:
        sums = partners + s
        np.add.at(self.pairs, sums[sums <= self.capacity], by)

    def drop(self, gone: np.ndarray) -> None:
        """Sizes that are used up leave the index of pairs."""
        for s in gone:
            self._count_pairs(int(s), self.sizes, -1)
            self.sizes = self.sizes[self.sizes != s]

    def single(self, gap: int, left: Counter) -> tuple[int, ...] | None:
        return (gap,) if gap <= self.capacity and self.counts[gap] - left[gap] > 0 else None

    def pair(self, gap: int, left: Counter) -> tuple[int, ...] | None:
        """The pair with the largest larger part."""
        if not 1 < gap <= self.capacity or self.pairs[gap] <= 0:
            return None
        large = self.sizes[(self.sizes < gap) & (2 * self.sizes >= gap)]
        for a in large[self.counts[gap - large] > 0][::-1]:
            b = gap - int(a)
            if self.counts[a] - left[int(a)] > (a == b) and self.counts[b] - left[b] > 0:
                return int(a), b
        return None

    def triple(self, gap: int, left: Counter) -> tuple[int, ...] | None:
        """The triple with the largest largest part."""
        if not 2 < gap <= self.capacity:
            return None
        large = self.sizes[(self.sizes < gap) & (3 * self.sizes >= gap)]
        for a in large[self.pairs[gap - large] > 0][::-1]:
            a = int(a)
            if self.counts[a] - left[a] <= 0:
                continue
            rest = self.pair(gap - a, left + Counter([a]))
            if rest:
                return a, *rest
        return None

    def complement(self, gap: int, left: Counter) -> tuple[int, ...] | None:
        return self.single(gap, left) or self.pair(gap, left) or self.triple(gap, left)


@dataclass(frozen=True)
class Pattern:
    """``times`` containers that each hold ``holds[size]`` items of a size."""

    times: int
    holds: dict[int, int]


def plan(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that hold each item of the histogram once. Sizes are from 1 to ``capacity``."""
    counts = np.zeros(capacity + 1, np.int64)
    for s, n in histogram.items():
        if not 1 <= s <= capacity:
            raise ValueError(f"size {s} is not from 1 to {capacity}")
        counts[s] = n
    index = SumIndex(counts)
    patterns: list[Pattern] = []
    while len(index.sizes):
        holds: Counter = Counter()
        gap, largest = capacity, int(index.sizes[-1])
        while gap:
            found = index.complement(gap, holds) if gap <= 3 * largest else None
            if found:
                holds.update(found)
                break
            fits = index.sizes[index.sizes <= gap]
            best = next((int(s) for s in fits[::-1] if counts[s] > holds[int(s)]), None)
            if best is None:
                break
            # far from the end take as many as leave room for an exact end
            take = min(int(counts[best]) - holds[best], max(1, (gap - 3 * largest) // best))
            holds[best] += take
            gap -= best * take
        times = min(int(counts[s]) // n for s, n in holds.items())
        patterns.append(Pattern(times, dict(holds)))
        for s, n in holds.items():
            counts[s] -= times * n
        index.drop(np.array([s for s in holds if counts[s] == 0], np.int64))
    return patterns


def _seats(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each size: the first seat of each of its ranges, how many seats a container has there, and the first container."""
    seats: dict[int, list[tuple[int, int, int]]] = {}
    taken: Counter = Counter()
    container = 0
    for p in patterns:
        for s, n in p.holds.items():
            seats.setdefault(s, []).append((taken[s], n, container))
            taken[s] += n * p.times
        container += p.times
    return {s: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for s, v in seats.items()}


def _sizes(path: str, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Columns item and text into pieces, with the number of earlier pieces of the same size in the same part as seat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = encoder(path).encode
        seen = np.zeros(capacity + 1, np.int64)
        for b, texts in parts(batches, _length):
            row, piece, start, size, seat = array("q"), array("i"), array("q"), array("i"), array("q")
            for i, t in enumerate(texts):
                n = len(encode(t))
                for k, at in enumerate(range(0, n, capacity)):
                    s = min(capacity, n - at)
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    size.append(s)
                    seat.append(seen[s])
                    seen[s] += 1
            items = b.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [items.cast(pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int32()), pa.array(np.full(len(row), part, np.int32)), pa.array(seat, pa.int64())],
                names=["item", "piece", "start", "size", "part", "seat"],
            )

    return run


def _place(seats: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, seat = (b.column(n).to_numpy(zero_copy_only=False) for n in ("size", "seat"))
            container = np.zeros(b.num_rows, np.int64)
            for s in np.unique(size):
                at = size == s
                first, per, base = seats.value[int(s)]
                k = np.searchsorted(first, seat[at], "right") - 1
                container[at] = base[k] + (seat[at] - first[k]) // per[k]
            yield pa.RecordBatch.from_arrays([pa.array(container), *[b.column(n) for n in ("item", "piece", "start", "size")]], names=["container_id", "item", "piece", "start", "size"])

    return run


def fill_containers(df: DataFrame, item: str, text: str, *, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """Assign texts, sized in tokens, to containers: container_id, item, piece, start_token, n_tokens.

    A text longer than the capacity is cut into pieces of the capacity and a rest; no other text is divided.
    Null and empty texts are left out. Each row is an item of its own, repeated rows and null items too.
    Container numbers are 0, 1, 2 ... without holes. An empty table gives an empty result. The driver sees
    the histogram of sizes, of at most ``capacity`` rows, and the plan made from it; the item column must be
    an integer, other columns don't matter.
    """
    spark = df.sparkSession
    rows = df.select(df[item].cast("long").alias("item"), df[text].cast("string").alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    items = stage_bucketed(map_batches(rows, _sizes(ship(spark, path or vocabulary()), capacity), _ITEMS), "sizes", "part", n)
    counts = items.groupBy("size", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    seats = spark.sparkContext.broadcast(_seats(plan(histogram, capacity)))
    # a size's parts are as many as the table has input splits, however many items it has
    earlier = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("size", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # one row a part, of at most ``capacity`` sizes: beyond a size that can be broadcast it goes to the items' buckets, which stay where they are
    offsets = before.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("size", "before"))).alias("before"))
    ranked = items.join(offsets, "part").select("item", "piece", "start", "size", (F.col("seat") + F.element_at("before", F.col("size"))).alias("seat"))
    placed = map_batches(ranked, _place(seats), "container_id long, item long, piece int, start long, size int")
    return placed.select("container_id", F.col("item").alias(item), "piece", F.col("start").alias("start_token"), F.col("size").alias("n_tokens"))
