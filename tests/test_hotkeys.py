from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from brindle.operators.hotkeys import _Dense, _reduce, clean_code, dominant, key_totals

ROWS = [(" ab", 1, 5), ("AB ", 0, None), ("ab", None, -7), ("", 1, 3), (None, 1, 2), ("   ", 0, 1), ("x" * 5000, 1, 2**40), ("cd", 0, -(2**40)), ("cd", 0, -(2**40))]


def test_key_totals(spark):
    df = spark.createDataFrame(ROWS * 40, "k string, c int, d long").withColumn("key_field", F.lit("clash"))
    got = {r.key_value: (r.n_rows, r.c_sum, r.c_count, r.d_sum, r.d_count) for r in key_totals(df, {"k": clean_code(F.col("k"))}, {"c": F.col("c"), "d": F.col("d")}).collect()}
    assert got == {"AB": (120, 40, 80, -80, 80), None: (120, 80, 120, 240, 120), "X" * 5000: (40, 40, 40, 40 * 2**40, 40), "CD": (80, 0, 80, -80 * 2**40, 80)}


def test_key_totals_empty_and_all_null(spark):
    empty = spark.createDataFrame([], "k string, c int, d long")
    assert key_totals(empty, {"k": F.col("k")}, {"d": F.col("d")}).collect() == []
    nulls = spark.createDataFrame([(None, None, None)] * 3, "k string, c int, d long")
    assert [tuple(r) for r in key_totals(nulls, {"k": F.col("k")}, {"d": F.col("d")}).collect()] == [("k", None, 3, None, 0)]


def test_dominant_counts_all_rows(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 4 + [(None,)] * 91, "k string")
    assert [tuple(r) for r in dominant(key_totals(df, {"k": F.col("k")}, {}), 100).collect()] == [("k", "a")]


def test_blocks_flush_and_grow():
    schema = pa.schema([("field", pa.int32()), ("block", pa.int32()), ("keys", pa.list_(pa.string())), ("a0", pa.list_(pa.int64()))])
    d = _Dense(1)
    for lo in range(0, 9000, 3000):
        d.add(pa.array([f"k{i}" for i in range(lo, lo + 3000)] + ["k0", None]), [])
    (sent,) = d.blocks(0, schema)
    assert d.codes == {} and sent.num_rows > 3000
    other = _Dense(1)
    other.add(pa.array(["k1", "new", None]), [])
    (more,) = other.blocks(0, schema)
    both = pa.Table.from_batches([sent, more]).sort_by([("field", "ascending"), ("block", "ascending")])
    total = Counter()
    for b in _reduce(iter(both.to_batches(max_chunksize=7))):
        assert len({*b.column(1).to_pylist()}) == b.num_rows
        total.update(dict(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)))
    assert len(total) == 9002 and total["k0"] == 4 and total["k1"] == 2 and total["new"] == 1 and total[None] == 4


def test_many_splits_and_flushes(spark, monkeypatch):
    df = spark.range(20_000).selectExpr("IF(id % 3 = 0, 'hot', CONCAT('k', id % 5000)) AS k", "id AS v").repartition(9)
    want = {r.k: (r.n, r.s) for r in df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()}
    assert {r.key_value: (r.n_rows, r.v_sum) for r in key_totals(df, {"k": F.col("k")}, {"v": F.col("v")}).collect()} == want
