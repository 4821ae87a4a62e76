"""Shapes of physical plans: what reaches the scan, where data moves, and what stays compiled."""

import re

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def plan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    df = entry.queries()[name](spark, DATA)
    return df._jdf.queryExecution().executedPlan().toString()


def scans(text):
    return [line for line in text.splitlines() if "FileScan" in line]


def test_filters_and_columns_reach_the_scan(spark):
    scan = scans(plan(spark, "tpch_q6"))[0]
    assert "l_shipdate" in re.search(r"PushedFilters: \[([^\]]*)", scan)[1] and "LessThan(l_quantity" in scan
    assert re.search(r"ReadSchema: struct<([^>]*)", scan)[1].count(":") == 4


def test_top_n_is_taken_per_partition(spark):
    assert "TakeOrderedAndProject" in plan(spark, "sort_top_n")


@pytest.mark.parametrize("name", ["tpch_q1", "ontime_q10", "agg_basic"])
def test_partial_aggregates(spark, name):
    text = plan(spark, name)
    assert text.count("HashAggregate") >= 2 and "partial_" in text


@pytest.mark.parametrize("name", ["fn_math", "fn_string", "fn_date", "fn_bits", "fn_compare", "expr_arithmetic"])
def test_dialect_functions_need_no_python(spark, name):
    text = plan(spark, name)
    assert not re.search("Python|Pandas|Arrow", text) and "Exchange" not in text


def test_semi_anti_and_null_aware_joins(spark):
    assert "LeftSemi" in plan(spark, "join_semi")
    assert "LeftAnti" in plan(spark, "join_anti")
    assert re.search("LeftAnti.*true", plan(spark, "join_not_in_nulls"))


@pytest.mark.parametrize(("name", "exchanges"), [("p2_keys", 1), ("p4_found", 0), ("p4_rows", 0), ("p5_found", 1)])
def test_operators_move_data_once_at_most(spark, name, exchanges):
    text = plan(spark, name)
    assert len(re.findall(r"Exchange (?:hash|range|RoundRobin|Shuffle|pass|direct)\w*", text)) <= exchanges, text
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_operators_read_only_their_columns(spark):
    read = {"p2_keys": 4, "p4_found": 4}
    for name, n in read.items():
        for scan in scans(plan(spark, name)):
            assert re.search(r"ReadSchema: struct<([^>]*)", scan)[1].count(":") <= n, scan


def test_no_registered_query_is_a_cartesian_product_of_large_tables(spark):
    small = {"join_cross", "join_theta", "sub_row_not_in", "join_not_in_values", "join_not_in_nulls"}
    for name in [n for n in entry.queries() if n.startswith(("tpch_", "ontime_", "join_")) and n not in small]:
        assert "CartesianProduct" not in plan(spark, name), name


def test_staging_in_buckets(spark):
    """A join on the bucketed column moves the other side only, and the name in the catalog is gone."""
    from brindle.session import stage_bucketed

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = stage_bucketed(spark.range(1000).selectExpr("CAST(id % 7 AS INT) AS part", "id"), "buckets", "part", 4)
        other = spark.range(7).selectExpr("CAST(id AS INT) AS part", "id * 10 AS extra")
        joined = rows.join(other, "part")
        assert joined.count() == 1000
        text = joined._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 1, text
        assert not [t for t in spark.catalog.listTables() if t.name.startswith("brindle_")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_quantified_subqueries_are_one(spark):
    """``x >= ALL (query)`` asks the query for several aggregates: Spark runs it once."""
    d = entry.queries()["dialect_all_any"](spark, DATA)
    d.collect()  # which of them are one shows once they have run
    text = d._jdf.queryExecution().executedPlan().toString()
    assert text.count("ReusedSubquery") >= 2


def test_newest_rows_are_limited_before_the_shuffle(spark):
    """Of each key one row a task moves, however many versions it has, and the files' footers aren't needed to plan."""
    text = plan(spark, "table_current_rows")
    assert re.search(r"WindowGroupLimit .*Partial", text) and len(re.findall(r"Exchange hashpartitioning", text)) == 1


def test_not_in_sends_no_repeated_values(spark):
    """Spark's own join for NOT IN broadcasts all values whatever their size; this one has distinct values and can sort instead."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(spark, "join_not_in_null_left")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in text and "Broadcast" not in text, text
    assert re.search(r"SortMergeJoin.*LeftAnti", text), text


@pytest.mark.parametrize("values", [[], [None], [1, 1, 3], [1, None, 3]])
def test_not_in_nulls_and_repeats(spark, values):
    from brindle.plans.relational import not_in

    rows = spark.createDataFrame([(i, k) for i, k in enumerate([1, 2, 2, None, 3, 4])], "id int, k int")
    right = spark.createDataFrame([(v,) for v in values], "k int")
    rows.createOrReplaceTempView("not_in_rows")
    right.createOrReplaceTempView("not_in_values")
    sql = spark.sql("SELECT * FROM not_in_rows WHERE k NOT IN (SELECT k FROM not_in_values)")
    assert sorted(not_in(rows, "k", right).collect()) == sorted(sql.collect())
