"""Reading and writing keyed tables from the command line, to try layouts and measure.

``python -m brindle.sources.cli read ROOT "SELECT ... FROM db.t WHERE ..." [--threads 4] [--partitions]`` runs
one query, or with ``--partitions`` the same query once for each partition of its table, several at a time.
``... write ROOT db.t ROWS [--threads 4] [--seed 1]`` appends random rows in as many batches. Both print one JSON line.
"""

from __future__ import annotations

import argparse
import json
import re
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

from brindle.session import local_session
from brindle.sources import io
from brindle.sources.catalog import Catalog
from brindle.sources.tables import Partitioning


def split_query(text: str, partitions: list[str]) -> list[str]:
    """The query over one partition each; it must have one table and at most one WHERE."""
    m = re.fullmatch(r"(?is)(\s*SELECT\b.*?\bFROM\s+[\w.`]+)(\s+.*|\s*)", text.rstrip(";"))
    if not m or len(re.findall(r"(?i)\bWHERE\b", text)) > 1 or re.search(r"(?i)\bJOIN\b", text):
        raise ValueError("a query by partitions needs one table and at most one WHERE")
    return [f"{m[1]} PARTITION ({p}){m[2]}" for p in partitions]


def read(c: Catalog, text: str, threads: int = 1, by_partition: bool = False) -> dict[str, float]:
    """Rows of a query and the seconds that it took; by partition as jobs of their own, ``threads`` at a time."""
    queries = [text]
    if by_partition:
        info = c.table(re.search(r"(?i)\bFROM\s+([\w.`]+)", text)[1]).info
        if not info.partitioning:
            raise ValueError("the table has no partitions")
        queries = split_query(text, Partitioning(**info.partitioning).names())
    # planned one after another, as a query's tables become views of the session; run side by side
    frames = [c.sql(q) for q in queries]
    started = time.perf_counter()
    with ThreadPoolExecutor(threads) as pool:
        rows = sum(pool.map(lambda d: d.count(), frames))
    return {"queries": len(queries), "rows": rows, "seconds": round(time.perf_counter() - started, 3)}


def write(c: Catalog, table: str, rows: int, threads: int = 1, seed: int = 0) -> dict[str, float]:
    """Appends seeded random rows in ``threads`` batches at a time, each a version of its own."""
    t = c.table(table)
    started = time.perf_counter()

    def batch(i: int) -> int:
        n = rows // threads + (i < rows % threads)
        fields = io.random_rows(c.spark, t.schema, n, seed=seed + 1000 * i)
        t.append(fields, version=t.next_version())
        return n

    with ThreadPoolExecutor(threads) as pool:
        done = sum(pool.map(batch, range(threads)))
    return {"rows": done, "seconds": round(time.perf_counter() - started, 3)}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, float]:
    p = argparse.ArgumentParser(prog="brindle.sources.cli")
    sub = p.add_subparsers(dest="what", required=True)
    r, w = sub.add_parser("read"), sub.add_parser("write")
    for s in (r, w):
        s.add_argument("root")
        s.add_argument("query" if s is r else "table")
        s.add_argument("--threads", type=int, default=1)
    r.add_argument("--partitions", action="store_true")
    w.add_argument("rows", type=int)
    w.add_argument("--seed", type=int, default=0)
    a = p.parse_args(args)
    c = Catalog(spark or SparkSession.getActiveSession() or local_session(), a.root, "keyedfirst")
    out = read(c, a.query, a.threads, a.partitions) if a.what == "read" else write(c, a.table, a.rows, a.threads, a.seed)
    print(json.dumps(out))
    return out


if __name__ == "__main__":
    main()
