"""Keyed tables, the two catalogs, sources and change apply."""

import datetime
import os
import random
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators.report import PivotSpec, differing_rows, pivot_report
from brindle.sources import io
from brindle.sources.catalog import Catalog, spark_type
from brindle.sources.tables import KeyedTable, Partitioning
from brindle.streaming.cdc import apply_changes, change_schema, follow

SCHEMA = T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("v", T.StringType())])


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_changes_against_a_dictionary(spark, tmp_path):
    """Random inserts, updates and deletes, some under a version that was there before, against a dictionary of versions."""
    pick = random.Random(1)
    t = KeyedTable.create(spark, f"{tmp_path}/t", SCHEMA, key=["id"])
    history, state = {}, {}
    for v in range(1, 9):
        keys = pick.sample(range(6), 2)
        if pick.random() < 0.3:
            t.delete(spark.createDataFrame([(k,) for k in keys], "id int"), version=v)
            state = {k: x for k, x in state.items() if k not in keys}
        else:
            t.append(spark.createDataFrame([(k, f"{k}@{v}") for k in keys] * 2, SCHEMA), version=v)
            state = state | {k: f"{k}@{v}" for k in keys}
        history[v] = dict(state)
    assert rows(t.read()) == sorted(state.items(), key=str)
    for v in history:
        assert rows(t.read(as_of=v)) == sorted(history[v].items(), key=str)
    assert t.read(as_of=0).collect() == []
    t.compact(keep_from=5)
    for v in (5, 6, 8):
        assert rows(t.read(as_of=v)) == sorted(history[v].items(), key=str)
    t.compact()
    assert rows(t.raw().select("id", "v")) == sorted(state.items(), key=str)


def test_evolution(spark, tmp_path):
    t = KeyedTable.create(spark, f"{tmp_path}/t", SCHEMA, key=["id"])
    assert t.read().collect() == []
    t.append(spark.createDataFrame([(1, "7"), (2, None)], SCHEMA), version=1)
    t.modify_column("v", "bigint")
    t.add_column("w", "decimal(5,2)")
    t.add_column("twice", "bigint", generated="v * 2")
    t.append(spark.createDataFrame([(3, 2**40, "1.5")], "id int, v bigint, w string"), version=2)
    assert rows(t.read()) == [(1, 7, None, 14), (2, None, None, None), (3, 2**40, T.decimal.Decimal("1.50"), 2**41)]
    t.drop_column("w")
    t.add_column("w", "string")
    assert {r.w for r in t.read().collect()} == {None}
    t.update_where("id = 1", {"w": "'new'"}, version=3)
    assert t.read().filter("id = 1").first().w == "new"
    t.alter_key(["id", "v"])
    like = t.create_like(f"{tmp_path}/u")
    assert like.read().columns == t.read().columns and like.read().count() == 0
    with pytest.raises(ValueError):
        t.drop_column("id")
    with pytest.raises(ValueError):
        t.update_where("id = 1", {"id": "5"}, version=9)
    with pytest.raises(ValueError):
        t.append(spark.createDataFrame([(3,)], "id int"))


def test_partitions(spark, tmp_path):
    """The employees of the range-partition case: ranges below 5, 10, 15 and the rest."""
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("store_id", T.IntegerType())])
    t = KeyedTable.create(spark, f"{tmp_path}/t", schema, key=["id"], partitioning=Partitioning("range", "id", [("p0", 5), ("p1", 10), ("p2", 15)]))
    t.append(spark.createDataFrame([(i, i % 6) for i in range(1, 15)], schema), version=1)
    assert [r[0] for r in rows(t.read(partitions=["p1"]))] == sorted(range(5, 10), key=str)
    t.add_partition("p3", None)
    t.append(spark.createDataFrame([(i, 1) for i in range(15, 19)], schema), version=2)
    assert t.read(partitions=["p3", "p0"]).count() == 8
    t.drop_partition("p0")
    assert t.read().count() == 14
    t.append(spark.createDataFrame([(2, 9)], schema), version=3)
    assert [r[0] for r in rows(t.read(partitions=["p1"]))] == sorted([2, *range(5, 10)], key=str)
    for bad in (lambda: t.add_partition("p9", 99), lambda: t.read(partitions=["p0"]), lambda: t.drop_partition("nope")):
        with pytest.raises(ValueError):
            bad()
    assert "_part" in t.read(partitions=["p1"])._jdf.queryExecution().executedPlan().toString()
    h = KeyedTable.create(spark, f"{tmp_path}/h", schema, engine="log", partitioning=Partitioning("hash", "store_id", count=4))
    h.append(spark.createDataFrame([(1, None), (2, -1), (3, 7), (4, 4)], schema))
    assert rows(h.read(partitions=["p3"])) == [(2, -1), (3, 7)] and h.read().count() == 4


def test_truncate_and_recover(spark, tmp_path):
    t = KeyedTable.create(spark, f"{tmp_path}/t", SCHEMA, engine="sorted", key=["id"])
    t.append(spark.createDataFrame([(2, "b"), (1, "a"), (2, "b")], SCHEMA))
    assert rows(t.read()) == [(1, "a"), (2, "b"), (2, "b")]
    t.truncate()
    assert t.read().count() == 0
    t.recover()
    assert t.read().count() == 3
    with pytest.raises(ValueError):
        t.recover()


@pytest.mark.parametrize("policy", ["sparkfirst", "keyedfirst"])
def test_catalog(spark, tmp_path, policy):
    c = Catalog(spark, f"file://{tmp_path}/root", policy)
    c.sql("CREATE DATABASE IF NOT EXISTS plain_db")
    c.sql("CREATE KEYED DATABASE kdb")
    c.sql("CREATE KEYED DATABASE IF NOT EXISTS kdb")
    c.sql("CREATE TABLE kdb.t (a INT PRIMARY KEY NOT NULL, b Nullable(String), c Decimal(65, 30), d INT AS (a * 2) VIRTUAL) USING MMT(4, 128)")
    assert c.last_layout == {"partitions": 4, "buckets": 128}
    t = c.table("kdb.t")
    t.append(spark.createDataFrame([(1, "x", "1.5"), (2, "y", None)], "a int, b string, c string"), version=1)
    c.use("kdb")
    assert rows(c.sql("SELECT a, d FROM t WHERE a > 1")) == [(2, 4)]
    t.append(spark.createDataFrame([(2, "z", None)], "a int, b string, c string"), version=2)
    assert rows(c.sql("SELECT u.b FROM kdb.t u JOIN t ON u.a = t.a AND u.a = (SELECT MAX(a) FROM t)")) == [("z",)]
    assert rows(c.sql("SELECT b FROM t WHERE a = 2", as_of=1)) == [("y",)]
    assert c.sql("SELRAW * FROM t").count() == 3 and "_version" in c.sql("SELRAW * FROM t").columns
    c.sql("CREATE TABLE kdb.u USING log AS SELECT a, b FROM t")
    c.sql("INSERT INTO u SELECT 9, 'n'")
    assert rows(c.sql("SELECT * FROM u")) == [(1, "x"), (2, "z"), (9, "n")]
    c.sql("CREATE TABLE kdb.w LIKE kdb.t")
    assert rows(c.sql("SHOW TABLES IN kdb")) == [("kdb", "t"), ("kdb", "u"), ("kdb", "w")]
    assert {("kdb",)} <= {*rows(c.sql("SHOW DATABASES"))}
    assert ("PK", "a", "") in rows(c.sql("DESC EXTENDED t")) and "PRIMARY KEY" in c.sql("SHOW CREATE TABLE t").first()[0]
    c.sql("TRUNCATE TABLE u")
    assert c.sql("SELECT * FROM u").count() == 0
    spark.range(1).createOrReplaceTempView("t")  # temporary views go first
    assert c.sql("SELECT * FROM t").columns == ["id"]
    spark.catalog.dropTempView("t")
    for bad in ("CREATE TABLE plain_db.x (a INT PRIMARY KEY) USING mmt", "CREATE TABLE kdb.x (a INT) USING mmt", "CREATE TABLE kdb.x (a INT PRIMARY KEY) USING log AS SELECT 1", "DROP DATABASE kdb", "SELECT * FROM t PARTITION (p0)", "DROP TABLE kdb.none"):
        with pytest.raises(ValueError):
            c.sql(bad)
    c.sql("DROP TABLE kdb.u")
    c.sql("DROP DATABASE kdb CASCADE")
    c.current = "default"
    # a name that both have: the policy decides
    c.sql("CREATE KEYED DATABASE plain_db")
    assert c.is_keyed("plain_db") == (policy == "keyedfirst")


def test_statements_on_keyed_tables(spark, tmp_path):
    source = spark.createDataFrame([(1, "one"), (2, "two")], "id int, v string")
    c = Catalog(spark, f"file://{tmp_path}/root", sources={"Other": lambda name: source})
    c.sql("CREATE KEYED DATABASE d")
    c.use("d")
    c.sql("CREATE TABLE FROM other d.t USING tmt(3, 64)")
    assert rows(c.sql("SELECT * FROM t")) == [(1, "one"), (2, "two")]
    c.sql("UPDATE t SET v = CONCAT(v, '!') WHERE id DIV 2 = 1")
    c.sql("DELETE FROM t WHERE id = 1")
    assert rows(c.sql("SELECT * FROM t")) == [(2, "two!")] and rows(c.sql("SELECT * FROM t", as_of=1)) == [(1, "one"), (2, "two")]
    c.sql("LOAD DATA FROM other INTO TABLE t")
    assert rows(c.sql("SELECT * FROM t")) == [(1, "one"), (2, "two")]
    c.sql("ALTER TABLE t ADD COLUMN n DECIMAL(5,2)")
    c.sql("ALTER TABLE t ADD COLUMN twice INT AS (id * 2) VIRTUAL")
    c.sql("INSERT INTO t SELECT 3, 'x', 1.5, 0")
    assert rows(c.sql("SELECT twice, n FROM t WHERE id = 3")) == [(6, T.decimal.Decimal("1.50"))]
    c.sql("ALTER TABLE t MODIFY COLUMN n BIGINT")
    c.sql("ALTER TABLE t DROP COLUMN v")
    assert c.sql("SELECT * FROM t").columns == ["id", "n", "twice"]
    c.sql("CREATE OR REPLACE VIEW big AS SELECT id FROM t WHERE id > 1")
    assert rows(c.sql("SELECT * FROM big")) == [(2,), (3,)]
    c.sql("CACHE TABLE t")
    c.sql("UNCACHE TABLE t")
    assert "FileScan parquet" in c.sql("EXPLAIN SELECT id FROM t").first()[0]
    assert c.statistics("t")["rows"] >= 6 and c.statistics("t")["bytes"] > 0
    c.sql("LOAD DATA FROM other OVERWRITE INTO TABLE t")
    assert c.sql("SELECT * FROM t").count() == 2
    c.sql("DELETE FROM t")
    assert c.sql("SELECT * FROM t").count() == 0
    with pytest.raises(ValueError):
        c.sql("LOAD DATA FROM nowhere INTO TABLE t")


def test_types():
    pairs = {"UInt64": "decimal(20,0)", "Nullable(Int8)": "tinyint", "FixedString(3)": "string", "Decimal(65,30)": "decimal(38,3)", "Decimal(65,0)": "decimal(38,0)", "MyDateTime(6)": "timestamp_ntz", "bigint unsigned": "decimal(20,0)", "varchar(25)": "string", "int": "int", "bigint(20)": "bigint", "Decimal(15,2)": "decimal(15,2)"}
    assert {k: spark_type(k) for k in pairs} == pairs
    with pytest.raises(ValueError):
        spark_type("geometry")


def test_delimited_and_distribution(spark, tmp_path):
    (tmp_path / "t.tbl").write_text("1|a, b|2020-01-01|\n2|\\N|1999-12-31|\n")
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("s", T.StringType()), T.StructField("d", T.DateType())])
    d = io.read_delimited(spark, f"{tmp_path}/t.tbl", schema, separator="|", null="\\N", trim_last=True)
    assert d.columns == ["k", "s", "d"] and [r.s for r in d.orderBy("k").collect()] == ["a, b", None]
    for bad in ("bad|y|2020-01-01|\n", "1|y|2020-01-01|z|\n", "1|y|2020-01-01|z\n", "1|y\n"):
        (tmp_path / "bad.tbl").write_text("1|a|2020-01-01|\n" + bad)
        with pytest.raises(Exception, match="(?i)malformed|more fields"):
            io.read_delimited(spark, f"{tmp_path}/bad.tbl", schema, separator="|", trim_last=True).select("k").collect()
    df = io.spread_by_key(spark.range(-5, 20).withColumn("x", F.lit(1)), "id", 3)
    assert all(r.p == r.id % 3 for r in df.withColumn("p", F.spark_partition_id()).collect())
    assert io.spread_evenly(spark.range(90), 3).groupBy(F.spark_partition_id()).count().filter("count < 15").count() == 0
    io.discard(df)
    big = T.StructType([T.StructField(n, T._parse_datatype_string(k)) for n, k in {"a": "tinyint", "b": "bigint", "c": "string", "d": "double", "e": "timestamp", "f": "date", "g": "boolean"}.items()])
    assert io.random_rows(spark, big, 50, seed=4, partitions=2).collect() == io.random_rows(spark, big, 50, seed=4, partitions=2).collect()
    edge = io.boundary_rows(spark, T.StructType([T.StructField("a", T.ByteType()), T.StructField("b", T.LongType()), T.StructField("c", T.StringType())]))
    assert {None, -128, 127} <= {r.a for r in edge.collect()} and {-(2**63), 2**63 - 1} <= {r.b for r in edge.collect()}


def test_database_update(spark, tmp_path):
    import sqlite3

    path = f"{tmp_path}/x.db"
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE t (a INT, b TEXT)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(i, "old") for i in range(5)])
    con.commit()
    io.update_rows(spark.createDataFrame([(1, "n"), (3, None), (9, "x"), (None, "y")], "a int, b string").coalesce(1), "t", ["a"], lambda: sqlite3.connect(path), batch=2)
    assert con.execute("SELECT * FROM t ORDER BY a").fetchall() == [(0, "old"), (1, "n"), (2, "old"), (3, None), (4, "old")]
    assert io.update_statement("t", ["a", "b"], ["c"]) == "UPDATE t SET `c` = ? WHERE `a` = ? AND `b` = ?"


def test_database_of_one_process(spark, tmp_path):
    """Types, nulls and names reach the database; a failed write leaves no rows; tasks read its archive in ranges."""
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    schema = "k long, `a b` string, x double, d date, t timestamp, m decimal(20,3), f boolean, n int, s short, y binary"
    moment = datetime.datetime(2020, 2, 29, 1, 2, 3, 456000)
    given = [(i, f"it's {i}", i / 8, datetime.date(2020, 1, 1), moment, Decimal("12345678901234567.125"), i % 2 == 0, i, i, b"\x00\xff") for i in range(7)]
    given += [(None,) * 10, (9, "", *[None] * 8)]
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    df = spark.createDataFrame(given, schema).repartition(3)
    io.write_embedded(df, url, "t", batch=2)
    io.write_embedded(df.limit(0), url, "no_rows")
    with pytest.raises(Exception, match="(?i)already exists"):
        io.write_embedded(df, url, "t")
    with pytest.raises(Exception, match="(?i)divi"):
        io.write_embedded(spark.range(0, 20, 1, 2).selectExpr("1 DIV (id - 19) AS q"), url, "broken", batch=3)
    archive = io.archive_derby(spark, f"{tmp_path}/db")
    assert not (tmp_path / "db").exists()
    found = io.read_jdbc(spark, archive, "t", column="k", bounds=(0, 9), splits=3)
    assert found.rdd.getNumPartitions() == 3 and sorted(map(str, found.collect())) == sorted(map(str, df.collect()))
    assert [io.read_jdbc(spark, archive, t).count() for t in ("no_rows", "broken")] == [0, 0]


@pytest.mark.parametrize("keys", [[], [0], [None], [None, -3, 0, 5]])
def test_database_ranges_of_odd_keys(spark, tmp_path, keys):
    import __spark_entry__ as entry

    given = [(k, f"Customer {k}", 1.5) for k in keys]
    spark.createDataFrame(given, "c_custkey long, c_name string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    assert rows(entry.queries()["source_jdbc"](spark, str(tmp_path))) == sorted(given, key=str)


def test_database_written_by_tasks(spark):
    """Tasks that share the database's process write it themselves."""
    url = "jdbc:derby:memory:tasks;create=true"
    io.write_jdbc(spark.range(0, 100, 1, 4), url, "t", batch=7)
    assert sorted(r.id for r in io.read_jdbc(spark, url, "t", column="id", bounds=(0, 100), splits=3).collect()) == list(range(100))


def test_database_with_executors_elsewhere(tmp_path, sf):
    """Executors in processes of their own, which see nothing of the driver's memory."""
    script = f"""
import __spark_entry__ as entry
from pyspark.sql import SparkSession
conf = {{"spark.executor.memory": "512m", "spark.driver.memory": "512m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": "file://{tmp_path}/shared", "spark.sql.warehouse.dir": "{tmp_path}/warehouse"}}
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config(map=conf).getOrCreate()
found = entry.queries()["source_jdbc"](spark, "{sf}")
given = spark.read.parquet("{sf}/customer.parquet").select(found.columns)
print("rows", found.count(), found.exceptAll(given).count(), given.exceptAll(found).count())
spark.stop()
"""
    root = str(Path(__file__).resolve().parents[1])
    env = os.environ | {"PYTHONPATH": root + os.pathsep + os.environ.get("PYTHONPATH", "")}
    env = {k: v for k, v in env.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET", "PYSPARK_SUBMIT_ARGS")}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 150 0 0" in done.stdout, done.stderr[-3000:]


def test_stream_of_changes(spark, tmp_path):
    t = KeyedTable.create(spark, f"{tmp_path}/t", SCHEMA, key=["id"])
    batch = [(1, "a", 1, "I"), (2, "b", 1, "I"), (1, "c", 3, "U"), (2, None, 2, "D"), (1, "late", 2, "U")]
    df = spark.createDataFrame(batch, change_schema(t))
    apply_changes(t, df)
    apply_changes(t, df)  # at least once
    assert rows(t.read()) == [(1, "c")]
    df.write.parquet(f"{tmp_path}/in")
    u = KeyedTable.create(spark, f"{tmp_path}/u", SCHEMA, key=["id"])
    follow(spark.readStream.schema(change_schema(u)).parquet(f"{tmp_path}/in"), u, f"{tmp_path}/ck", once=True).awaitTermination()
    assert rows(u.read()) == [(1, "c")]


def test_changes_keep_versions_between(spark, tmp_path):
    t = KeyedTable.create(spark, f"{tmp_path}/t", SCHEMA, key=["id"])
    apply_changes(t, spark.createDataFrame([(1, "a", 1, "I"), (1, "a", 1, "I"), (1, "c", 3, "U"), (2, "b", 1, "I"), (2, None, 2, "D")], change_schema(t)))
    assert rows(t.read(as_of=1)) == [(1, "a"), (2, "b")]
    assert rows(t.read(as_of=2)) == [(1, "a")] and rows(t.read()) == [(1, "c")]
    assert t.raw().count() == 4


def test_reports(spark):
    df = spark.createDataFrame([("a", "x", 1.0, 1), ("a", "x", 3.0, 2), ("a", "y", 90.0, 3), ("b", "y", None, 4), (None, "x", 5.0, 5)], "r string, c string, v double, o int")
    got = {r.r: (r.x, r.y) for r in pivot_report(df, "v", "rows: r; cols: c; cell: avg").collect()}
    assert got == {"a": (2.0, 90.0), "b": (None, None), None: (5.0, None)}
    got = {r.r: r.x for r in pivot_report(df, "v", "rows: r; cols: c; cell: avg|~|cnt", columns=["x"]).collect()}
    assert got["a"] == "2.00 ~50.0% /2"
    last = pivot_report(df, "v", PivotSpec(["r"], ["c"], ["limit(1)", "avg"]), order="o", columns=["x"])
    assert {r.r: r.x for r in last.collect()}["a"] == 3.0
    assert {r.r: r.y for r in pivot_report(df, "v", "rows: r; cols: c; cell: duration|avg", columns=["y"]).collect()}["a"] == "1m 30.0s"
    with pytest.raises(ValueError):
        PivotSpec.parse("rows: a")
    a, b = spark.createDataFrame([(1,), (1,), (None,)], "x int"), spark.createDataFrame([(1,), (2,)], "x int")
    assert rows(differing_rows(a, b)) == sorted([(1, "left", 1), (None, "left", 1), (2, "right", 1)], key=str)


def test_workload_patterns(spark):
    from itertools import islice

    from brindle.sources import workload as w

    take = lambda it, n: list(islice(it, n))
    assert [o.key for o in take(w.append(5), 3)] == [5, 6, 7]
    assert take(w.rand("read", 0, 9, 1), 5) == take(w.rand("read", 0, 9, 1), 5)
    assert all(o.end - o.key == 4 and 0 <= o.key and o.end <= 50 for o in take(w.rand_scan_range(0, 50, 4), 40))
    assert [o.kind for o in take(w.round_robin(w.append(), w.scan_all()), 4)] == ["write", "scan_all"] * 2
    kinds = [o.kind for o in take(w.chance([(0.9, w.append()), (0.1, w.scan_all())], 3), 200)]
    assert 5 < kinds.count("scan_all") < 50
    df = spark.range(20)
    assert w.read(df, "id", w.Op("scan_range", 3, 6)).count() == 3 and w.read(df, "id", w.Op("read", 3)).count() == 1 and w.read(df, "id", w.Op("scan_all")).count() == 20


def test_user_functions(spark):
    from brindle.functions import udf

    udf.register_vectorised(spark, "plus_one", lambda s: s + 1, "long")
    assert spark.sql("SELECT SUM(plus_one(id)) AS s FROM range(4)").first().s == 10

    class Repeat:
        def eval(self, n: int):
            for i in range(n):
                yield (i,)

    udf.register_table_function(spark, "upto", Repeat, "x int")
    assert spark.sql("SELECT COUNT(*) AS n FROM range(4), LATERAL upto(CAST(id AS INT))").first().n == 6
    assert rows(udf.transform_script(spark.range(3), "cat", "k STRING")) == [("0",), ("1",), ("2",)]


def test_no_row_is_lost(spark, tmp_path):
    """Keys that aren't unique, rows made from the table they replace, nulls where none may be."""
    several = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    c = Catalog(spark, f"file://{tmp_path}/root", sources={"other": lambda name: several})
    c.sql("CREATE KEYED DATABASE d")
    c.use("d")
    several.createOrReplaceTempView("several")
    for bad in ("CREATE TABLE x USING mmt AS SELECT k, v FROM several", "CREATE TABLE FROM other d.x USING mmt", "CREATE TABLE x PRIMARY KEY (nope) USING mmt AS SELECT k, v FROM several"):
        with pytest.raises(ValueError):
            c.sql(bad)
        assert c.tables("d") == []
    c.sql("CREATE TABLE x PRIMARY KEY (k, v) USING mmt AS SELECT k, v FROM several")
    c.sql("CREATE TABLE FROM other d.y PRIMARY KEY (v) USING mmt")
    assert rows(c.sql("SELECT k, v FROM x")) == rows(c.sql("SELECT k, v FROM y")) == [(1, "a"), (1, "b"), (2, "c")]
    c.sql("INSERT OVERWRITE x SELECT k + 10, v FROM x WHERE v <> 'c'")
    assert rows(c.sql("SELECT * FROM x")) == [(11, "a"), (11, "b")]
    with pytest.raises(Exception, match="boom"):
        c.sql("INSERT OVERWRITE x SELECT CAST(raise_error('boom') AS INT), v FROM x")
    assert rows(c.sql("SELECT * FROM x")) == [(11, "a"), (11, "b")]
    c.sql("CREATE TABLE n (a INT PRIMARY KEY, b STRING NOT NULL, c INT) USING mmt")
    for bad in ("INSERT INTO n VALUES (1, NULL, 1)", "INSERT INTO n VALUES (NULL, 'x', 1)", "INSERT INTO n (a, c) VALUES (1, 1)"):
        with pytest.raises(Exception, match="must not be null"):
            c.sql(bad)
    c.sql("INSERT INTO n (b, a) VALUES ('x', 1)")
    c.sql("FROM several INSERT INTO n (a, b) SELECT k + 100, MAX(v) GROUP BY k INSERT INTO x SELECT k, v WHERE v = 'c'")
    assert rows(c.sql("SELECT * FROM n")) == sorted([(1, "x", None), (101, "b", None), (102, "c", None)], key=str)
    assert rows(c.sql("SELECT * FROM x")) == [(11, "a"), (11, "b"), (2, "c")]
    with pytest.raises(ValueError):
        c.sql("INSERT INTO n (a, a) VALUES (1, 2)")
    assert rows(c.sql("SELECT 'rows FROM x here' AS s, x.k FROM x WHERE v = 'c'")) == [("rows FROM x here", 2)]
    # a column named like a table, and FROM in a function, are left alone
    c.sql("CREATE TABLE v PRIMARY KEY (k) USING mmt AS SELECT k, MAX(v) AS v FROM several GROUP BY k")
    assert rows(c.sql("SELECT k, v FROM v")) == [(1, "b"), (2, "c")]
    assert rows(c.sql("SELECT k, TRIM(LEADING 'c' FROM v) AS t FROM (v) WHERE k = 2")) == [(2, "")]


def test_recover_and_flashback(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/root")
    c.sql("CREATE KEYED DATABASE d")
    c.use("d")
    c.sql("CREATE TABLE t PRIMARY KEY (c1) USING mmt AS SELECT 1 AS c1, 'abc' AS c2")
    c.sql("DROP TABLE t")
    assert c.tables("d") == []
    c.sql("RECOVER TABLE d.t")
    assert rows(c.sql("SELECT * FROM t")) == [(1, "abc")]
    c.sql("DROP TABLE t")
    c.sql("FLASHBACK TABLE d.t TO t2")
    assert c.tables("d") == ["t2"] and rows(c.sql("SELECT * FROM t2")) == [(1, "abc")]
    c.sql("TRUNCATE TABLE t2")
    c.sql("FLASHBACK TABLE t2 TO t3")
    assert rows(c.sql("SELECT * FROM t3")) == [(1, "abc")] and c.sql("SELECT * FROM t2").count() == 0
    c.sql("DROP TABLE t3")
    c.purge("d")
    for bad in ("RECOVER TABLE t3", "FLASHBACK TABLE t TO t2", "RECOVER TABLE t2"):
        with pytest.raises(ValueError):
            c.sql(bad)


def test_versions_of_several_writers(spark, tmp_path):
    t = KeyedTable.create(spark, f"{tmp_path}/t", SCHEMA, key=["id"])
    same = KeyedTable(spark, f"{tmp_path}/t")
    assert [t.next_version(), same.next_version(), t.next_version()] == [1, 2, 3]
    t.append(spark.createDataFrame([(1, "a")], SCHEMA), version=90)
    assert same.next_version() == 91
    for _ in range(80):
        t.next_version()
    assert same.next_version() == 172


def test_command_line(spark, tmp_path):
    from brindle.sources import cli

    root = f"file://{tmp_path}/root"
    c = Catalog(spark, root, "keyedfirst")
    c.sql("CREATE KEYED DATABASE d")
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
    c.create_table("d.t", schema, "mmt", ["k"], Partitioning("hash", "k", count=3))
    assert cli.main(["write", root, "d.t", "100", "--threads", "3", "--seed", "5"], spark)["rows"] == 100
    whole = cli.main(["read", root, "SELECT * FROM d.t"], spark)
    parts = cli.main(["read", root, "SELECT * FROM d.t WHERE k IS NOT NULL", "--threads", "2", "--partitions"], spark)
    assert whole["rows"] == parts["rows"] == 100 and parts["queries"] == 3
    for bad in ("SELECT * FROM d.t WHERE k = 1 AND v IN (SELECT v FROM d.t WHERE k = 2)", "SELECT * FROM d.t JOIN d.u ON TRUE"):
        with pytest.raises(ValueError):
            cli.split_query(bad, ["p0"])


def test_workload_runs(spark, tmp_path):
    from brindle.sources import workload as w

    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
    t = KeyedTable.create(spark, f"{tmp_path}/t", schema, key=["k"])
    ops = [*w.times(5, w.append(3)), w.Op("read", 4), w.Op("scan_range", 3, 6), *w.times(1, w.append(3)), w.Op("scan_all")]
    assert w.run(t, ops, lambda k: (k, "x")) == {"write": 6, "read": 1, "scan_range": 1, "scan_all": 1, "rows_written": 6, "rows_read": 1 + 3 + 5}
    assert w.key_range(ops) == (3, 7) and w.key_range([w.Op("scan_all")]) is None


def test_several_writers_at_once(spark, tmp_path):
    """Appends from several threads all arrive, each under its own version."""
    from concurrent.futures import ThreadPoolExecutor

    t = KeyedTable.create(spark, f"{tmp_path}/t", SCHEMA, key=["id"], partitioning=Partitioning("hash", "id", count=2))
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda i: t.append(spark.createDataFrame([(i * 10 + k, f"w{i}") for k in range(10)], SCHEMA), version=t.next_version()), range(12)))
    assert t.read().count() == 120 and t.raw().select("_version").distinct().count() == 12
    assert t.read(partitions=["p1"]).count() == 60
