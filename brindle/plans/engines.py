"""Keyed tables, partitions, snapshots, reports and sources over the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.jsonpath import json_paths
from brindle.operators.report import PivotSpec, differing_rows, json_value, pivot_report, report_table
from brindle.plans.sqlquery import Catalogue
from brindle.session import shared_path, table
from brindle.sources.catalog import partition_filter
from brindle.sources.io import read_delimited, spread_by_key, write_delimited
from brindle.sources.tables import KeyedTable, Partitioning, latest

C = Catalogue()
QUERIES, SQL = C.queries, C.sql

_KEY = ["l_orderkey", "l_linenumber"]
_NEWEST = "SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, internal_version, internal_delmark FROM lineitem_colstore {}) t GROUP BY l_orderkey, l_linenumber HAVING arg_max(internal_delmark, internal_version) = 0"
_RANGE = Partitioning("range", "o_custkey", [("p0", 500), ("p1", 1000), ("p2", None)])
_HASH = Partitioning("hash", "o_custkey", count=4)


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem_colstore").select(*_KEY, "internal_version", "internal_delmark")


@C.frame("table_current_rows", _NEWEST.format(""))
def table_current_rows(spark: SparkSession, sf: str) -> DataFrame:
    return latest(_versions(spark, sf), _KEY, "internal_version", "internal_delmark")


@C.frame("table_snapshot", _NEWEST.format("WHERE internal_version <= 40000"))
def table_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return latest(_versions(spark, sf).filter("internal_version <= 40000"), _KEY, "internal_version", "internal_delmark")


@C.frame("table_raw_rows", "SELECT internal_delmark, COUNT(*) AS n FROM lineitem_colstore GROUP BY internal_delmark")
def table_raw_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem_colstore").groupBy("internal_delmark").agg(F.count(F.lit(1)).alias("n"))


@C.frame("table_upsert_delete", "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_nationkey <> 7")
def table_upsert_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Insert, update and delete as versions, then a read of the current rows."""
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    t = KeyedTable.create(spark, shared_path(spark, "customer"), customer.schema, key=["c_custkey"])
    t.append(customer, version=1)
    t.update_where("c_nationkey = 3", {"c_acctbal": "c_acctbal + 1"}, version=2)
    t.delete_where("c_nationkey = 7", version=3)
    return t.read().select("c_custkey", "c_acctbal")


@C.frame("table_time_travel", "SELECT c_custkey, c_acctbal FROM customer")
def table_time_travel(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    t = KeyedTable.create(spark, shared_path(spark, "customer"), customer.schema, key=["c_custkey"])
    t.append(customer, version=10)
    t.delete_where("c_acctbal < 0", version=20)
    return t.read(as_of=15)


@C.frame("table_range_partition", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey >= 500 AND o_custkey < 1000")
def table_range_partition(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    t = KeyedTable.create(spark, shared_path(spark, "orders"), orders.schema, engine="log", partitioning=_RANGE)
    t.append(orders)
    return t.read(partitions=["p1"])


@C.frame("table_hash_partition", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 4 IN (1, 3)")
def table_hash_partition(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    t = KeyedTable.create(spark, shared_path(spark, "orders"), orders.schema, engine="log", partitioning=_HASH)
    t.append(orders)
    return t.read(partitions=["p1", "p3"])


@C.frame("table_partition_filter", "SELECT COUNT(*) AS n FROM orders WHERE o_custkey < 500 OR o_custkey >= 1000")
def table_partition_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").filter(partition_filter(_RANGE, ["p0", "p2"])).agg(F.count(F.lit(1)).alias("n"))


@C.frame("table_evolution", "SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal, CASE WHEN s_suppkey < 50 THEN 'old' END AS note, s_suppkey * 2 AS twice FROM supplier")
def table_evolution(spark: SparkSession, sf: str) -> DataFrame:
    """Columns are added, dropped, widened and generated; files from before stay."""
    supplier = table(spark, sf, "supplier")
    t = KeyedTable.create(spark, shared_path(spark, "supplier"), supplier.schema, key=["s_suppkey"])
    t.append(supplier, version=1)
    t.drop_column("s_name")
    t.add_column("note", "string")
    t.modify_column("s_nationkey", "bigint")
    t.add_column("twice", "bigint", generated="s_suppkey * 2")
    t.append(supplier.filter("s_suppkey < 50").withColumn("note", F.lit("old")), version=2)
    return t.read()


@C.frame("source_csv", "SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority FROM orders")
def source_csv(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    path = shared_path(spark, "orders-csv")
    write_delimited(orders, path, separator="|", header=True)
    return read_delimited(spark, path, orders.schema, separator="|", header=True)


@C.frame("source_generator_files", "SELECT c_custkey, c_name, CAST(c_nationkey AS INT) AS c_nationkey FROM customer")
def source_generator_files(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that end with a separator, as the benchmark's generator writes them."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey"))
    path = shared_path(spark, "customer-tbl")
    rows.select(F.concat(*[F.concat(F.col(c).cast("string"), F.lit("|")) for c in rows.columns]).alias("value")).write.text(path)
    return read_delimited(spark, path, rows.schema, separator="|", trim_last=True)


@C.frame("source_spread_by_key", "SELECT c_custkey % 6 AS node, COUNT(*) AS n FROM customer GROUP BY c_custkey % 6")
def source_spread_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """Each node's rows, counted where they are."""
    d = spread_by_key(table(spark, sf, "customer"), "c_custkey", 6)
    return d.withColumn("node", F.spark_partition_id().cast("long")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))


@C.frame("json_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", json_value("props", "$.k").alias("k"))


@C.frame("json_paths", "SELECT event_id, json_extract(props, '$.k')::VARCHAR AS plain, '\"' || event_type || '\"|' || user_id AS wild, user_id::VARCHAR AS deep, (user_id + 1) || '|' || (user_id + 2) AS slice, CASE WHEN user_id > 500 THEN '\"' || event_type || '\"' ELSE '' END AS chosen FROM events")
def json_paths_query(spark: SparkSession, sf: str) -> DataFrame:
    """Members, wildcards, recursion, slices and filters over documents made of each event."""
    made = F.expr("concat('{\"k\": ', get_json_object(props, '$.k'), ', \"a\": {\"t\": \"', event_type, '\", \"u\": ', user_id, '}, \"l\": [', user_id, ',', user_id + 1, ',', user_id + 2, '], \"m\": [{\"n\": ', user_id, ', \"t\": \"', event_type, '\"}]}')")
    d = table(spark, sf, "events").select("event_id", made.alias("doc"))
    paths = {"plain": "$.k", "wild": "$.a.*", "deep": "$..u", "slice": "$.l[1:]", "chosen": "$.m[?(@.n > 500 && @.t)].t"}
    return json_paths(d, "doc", paths, ["event_id"]).select("event_id", *[F.array_join(n, "|").alias(n) for n in paths])


_TYPES = ["click", "error", "purchase", "signup", "view"]
_PIVOT = ", ".join(f"ROUND(AVG(value) FILTER (event_type = '{t}'), 6) AS {t}" for t in _TYPES)


@C.frame("report_pivot", f"SELECT CAST(user_id % 10 AS BIGINT) AS bucket, {_PIVOT} FROM events GROUP BY ALL")
def report_pivot(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn("bucket", F.col("user_id") % 10)
    d = pivot_report(events, "value", PivotSpec(["bucket"], ["event_type"], ["avg"]), columns=_TYPES)
    return d.select("bucket", *[F.round(t, 6).alias(t) for t in _TYPES])


@C.frame("report_table", "SELECT 'bucket:' || bucket AS row, " + ", ".join(f"coalesce(MAX(n) FILTER (kind = '{t}'), '') AS \"{t}\"" for t in ("signup", "view")) + " FROM (SELECT user_id % 10 AS bucket, CASE event_type WHEN 'click' THEN 'view' ELSE event_type END AS kind, CAST(COUNT(*) AS VARCHAR) AS n FROM events GROUP BY ALL) WHERE bucket >= 7 GROUP BY bucket")
def report_table_query(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks counted as views; only the last columns and rows."""
    events = table(spark, sf, "events").withColumn("bucket", F.col("user_id") % 10)
    return report_table(events, "value", "kind.view = event_type.click; rows: bucket | limit(3); cols: kind | notag | limit(2); cell: cnt")


@C.frame("report_difference", "(SELECT s_nationkey AS k, 'left' AS side FROM supplier EXCEPT SELECT c_nationkey, 'left' FROM customer WHERE c_nationkey < 20) UNION ALL (SELECT c_nationkey, 'right' FROM customer WHERE c_nationkey < 20 EXCEPT SELECT s_nationkey, 'right' FROM supplier)")
def report_difference(spark: SparkSession, sf: str) -> DataFrame:
    left = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    right = table(spark, sf, "customer").filter("c_nationkey < 20").select(F.col("c_nationkey").alias("k")).distinct()
    return differing_rows(left, right).select("k", "side")


@C.frame("stream_apply_changes", "SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey % 5 <> 0")
def stream_apply_changes(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of changes applied to a keyed table: all nations arrive, then every fifth one is deleted."""
    from brindle.streaming.cdc import change_schema, follow

    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    t = KeyedTable.create(spark, shared_path(spark, "nation"), nation.schema, key=["n_nationkey"])
    changes = shared_path(spark, "changes")
    nation.withColumns({"version": F.lit(1).cast("long"), "kind": F.lit("I")}).write.parquet(changes)
    nation.filter("n_nationkey % 5 = 0").withColumns({"version": F.lit(2).cast("long"), "kind": F.lit("D")}).write.mode("append").parquet(changes)
    follow(spark.readStream.schema(change_schema(t)).parquet(changes), t, shared_path(spark, "offsets"), once=True).awaitTermination()
    return t.read()
