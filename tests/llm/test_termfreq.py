from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from brindle.llm import termfreq
from brindle.llm.termfreq import mark_terms, term_counts
from brindle.session import plain_path, shared_dir


@pytest.mark.parametrize("budget", [1, 2000, 64 << 20])
def test_term_counts(spark, budget):
    """Every budget, so that pieces are aggregated after one spill, and after many, must give the same."""
    rows = [("a", "a"), ("a", "b"), (None, "b"), ("", None), ("w" * 3000, "é")] * 30 + [(f"t{i}", f"t{i + 1}") for i in range(150)]
    df = spark.createDataFrame(rows, "o string, d string").repartition(3).withColumn("term", F.lit(1))
    got = {(r.vocabulary, r.term): (r.n_occurrences, r.n_records) for r in term_counts(df, {"v": [F.nullif("o", F.lit("")), F.col("d")], "one": [F.nullif("o", F.lit(""))]}, partitions=2, budget=budget).collect()}
    occ, rec, one = Counter(), Counter(), Counter()
    for o, d in rows:
        both = [x for x in (o or None, d) if x is not None]
        occ.update(both)
        rec.update(set(both))
        one.update([o] if o else [])
    assert got == {("v", t): (occ[t], rec[t]) for t in occ} | {("one", t): (n, n) for t, n in one.items()}


def test_spilling(spark, tmp_path, monkeypatch):
    """Everything is on disk by hash bits before it is aggregated, oversized pieces several levels deep, and nothing is left behind."""
    import pyarrow as pa

    class Task:
        partitionId = taskAttemptId = staticmethod(lambda: 0)

    monkeypatch.setattr("pyspark.TaskContext.get", lambda: Task)
    deepest, whole = [], termfreq._spill
    monkeypatch.setattr(termfreq, "_spill", lambda con, source, to, level: (deepest.append(level), whole(con, source, to, level))[1])
    batch = pa.RecordBatch.from_pydict({"vocabulary": ["v"] * 3000, "term": [f"t{i}" for i in range(3000)], "n_occurrences": [1] * 3000, "n_records": [1] * 3000}, schema=termfreq._ARROW)
    for budget, levels in ((64 << 20, 1), (300, 3)):
        deepest.clear()
        rows = [r for b in termfreq._radix(str(tmp_path), budget)(iter([batch, batch])) for r in b.to_pylist()]
        assert len(rows) == 3000 and all(r["n_records"] == 2 for r in rows)
        assert {*range(levels)} <= {*deepest} and (budget == 300 or {*deepest} == {0})
    assert list(tmp_path.iterdir()) == []


def test_one_hot_term_beyond_the_budget(spark):
    df = spark.createDataFrame([("hot",)] * 3000, "t string").repartition(40)
    assert [tuple(r) for r in term_counts(df, {"v": [F.col("t")]}, partitions=1, budget=1).collect()] == [("v", "hot", 3000, 3000)]
    left = [p for p in Path(plain_path(shared_dir(spark))).glob("radix-*/*")]
    assert left == []


def test_term_counts_empty(spark):
    df = spark.createDataFrame([], "t string")
    assert term_counts(df, {"v": [F.col("t")]}).collect() == []
    assert term_counts(spark.createDataFrame([(None,)], "t string"), {"v": [F.col("t")]}).collect() == []


def test_a_folder_that_is_not_mounted(spark, monkeypatch):
    monkeypatch.setattr(termfreq, "shared_path", lambda spark, what: f"hdfs://cluster/{what}")
    with pytest.raises(ValueError, match="mounted"):
        term_counts(spark.createDataFrame([("a",)], "t string"), {"v": [F.col("t")]})


def test_marks(spark):
    c = spark.createDataFrame([("v", "a", 2, 2), ("v", "b", 3, 3), ("v", "c", 30, 20), ("v", "d", 30, 21)], termfreq.SCHEMA)
    assert [r.mark for r in mark_terms(c, 1000).orderBy("term").collect()] == ["rare", None, None, "common"]
    assert [r.mark for r in mark_terms(c, 10).orderBy("term").collect()] == ["rare", "common", "common", "common"]


def test_plan(spark):
    """One shuffle, after equal terms are added up, and three of the flights' columns read."""
    import re

    import __spark_entry__ as entry

    plan = entry.queries()["p3_terms"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange\b", plan)) == 1
    assert {c for m in re.findall(r"ReadSchema: struct<([^>]*)>", plan) for c in re.findall(r"(\w+):", m)} == {"origin", "dest", "tailnum"}
