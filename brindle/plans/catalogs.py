"""Both catalogs, DDL and DML on keyed tables, and sources and sinks beside files, over the tables at hand."""

from __future__ import annotations

import contextlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.plans.sqlquery import Catalogue
from brindle.session import plain_path, register, shared_path, table
from brindle.sources import io, workload
from brindle.sources.catalog import Catalog
from brindle.sources.tables import KeyedTable

C = Catalogue()
QUERIES, SQL = C.queries, C.sql


def _catalog(spark: SparkSession, sf: str, *names: str, **more) -> Catalog:
    """A catalog with one database of keyed tables, ``kdb``, in use; Parquet tables are temporary views."""
    register(spark, sf, *names)
    c = Catalog(spark, shared_path(spark, "catalog"), "keyedfirst", **more)
    c.sql("CREATE KEYED DATABASE kdb")
    c.use("kdb")
    return c


def _each(c: Catalog, *statements: str) -> DataFrame:
    """Runs statements in turn; the last one's rows."""
    for s in statements[:-1]:
        c.sql(s)
    return c.sql(statements[-1])


# --- databases and tables ---
@C.frame("ddl_create_table", "SELECT c_custkey AS id, c_name AS name, CAST(c_acctbal AS DECIMAL(15,2)) AS bal, c_custkey * 2 AS twice FROM customer")
def ddl_create_table(spark: SparkSession, sf: str) -> DataFrame:
    c = _catalog(spark, sf, "customer")
    return _each(c, "CREATE TABLE t (id BIGINT PRIMARY KEY NOT NULL, name Nullable(String), bal Decimal(15, 2), twice BIGINT AS (id * 2) VIRTUAL) USING MMT(4, 128)", "INSERT INTO t (id, name, bal) SELECT c_custkey, c_name, c_acctbal FROM customer", "SELECT * FROM t")


@C.frame("ddl_create_as_select", "SELECT l_orderkey, l_linenumber, MAX(l_quantity) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber")
def ddl_create_as_select(spark: SparkSession, sf: str) -> DataFrame:
    """The first column repeats: only the declared key keeps all rows."""
    c = _catalog(spark, sf, "lineitem")
    return _each(c, "CREATE TABLE t PRIMARY KEY (l_orderkey, l_linenumber) USING mmt AS SELECT l_orderkey, l_linenumber, MAX(l_quantity) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber", "SELECT * FROM t")


@C.frame("ddl_create_as_select_refused", "SELECT 'ValueError' AS error, CAST(0 AS BIGINT) AS tables")
def ddl_create_as_select_refused(spark: SparkSession, sf: str) -> DataFrame:
    """A key that isn't unique would lose rows."""
    c = _catalog(spark, sf, "lineitem")
    try:
        c.sql("CREATE TABLE t USING mmt AS SELECT l_orderkey, l_linenumber FROM lineitem")
        error = "none"
    except ValueError as e:
        error = type(e).__name__
    return spark.createDataFrame([(error, len(c.tables("kdb")))], "error string, tables long")


@C.frame("ddl_create_log", "SELECT l_suppkey, l_returnflag FROM lineitem")
def ddl_create_log(spark: SparkSession, sf: str) -> DataFrame:
    c = _catalog(spark, sf, "lineitem")
    return _each(c, "CREATE TABLE t USING log AS SELECT l_suppkey, l_returnflag FROM lineitem", "SELECT * FROM t")


@C.frame("ddl_create_from_source", "SELECT o_orderkey, o_custkey FROM orders")
def ddl_create_from_source(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    c = _catalog(spark, sf, sources={"rowstore": lambda name: rows})
    return _each(c, "CREATE TABLE FROM rowstore kdb.orders PRIMARY KEY (o_orderkey) USING tmt(4, 64)", "SELECT o_orderkey, o_custkey FROM kdb.orders")


@C.frame("ddl_create_from_frame", "SELECT p_partkey, p_size FROM part")
def ddl_create_from_frame(spark: SparkSession, sf: str) -> DataFrame:
    c = _catalog(spark, sf)
    c.create_from("parts", table(spark, sf, "part").select("p_partkey", "p_size"), ["p_partkey"])
    return c.sql("SELECT * FROM parts")


@C.frame("ddl_create_like", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey < 10")
def ddl_create_like(spark: SparkSession, sf: str) -> DataFrame:
    c = _catalog(spark, sf, "supplier")
    return _each(c, "CREATE TABLE t PRIMARY KEY (s_suppkey) USING mmt AS SELECT s_suppkey, s_name FROM supplier", "CREATE TABLE u LIKE t", "INSERT INTO u SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey < 10", "SELECT * FROM u")


_TWO = ("CREATE TABLE a (id INT PRIMARY KEY, v STRING) USING mmt", "CREATE TABLE b (id INT PRIMARY KEY) USING mmt")


@C.frame("ddl_show_tables", "SELECT * FROM (VALUES ('kdb', 'a'), ('kdb', 'b')) AS t(namespace, tableName)")
def ddl_show_tables(spark: SparkSession, sf: str) -> DataFrame:
    return _each(_catalog(spark, sf), *_TWO, "SHOW TABLES IN kdb")


@C.frame("ddl_show_databases", "SELECT * FROM (VALUES ('kdb'), ('other')) AS t(namespace)")
def ddl_show_databases(spark: SparkSession, sf: str) -> DataFrame:
    c = _catalog(spark, sf)
    c.sql("CREATE KEYED DATABASE IF NOT EXISTS other")
    return c.sql("SHOW DATABASES").filter("namespace IN ('kdb', 'other')")


@C.frame("ddl_describe", "SELECT * FROM (VALUES ('id', 'int', 'primary key'), ('v', 'string', ''), ('Engine', 'mutable', ''), ('PK', 'id', '')) AS t(col_name, data_type, comment)")
def ddl_describe(spark: SparkSession, sf: str) -> DataFrame:
    return _each(_catalog(spark, sf), *_TWO, "DESC EXTENDED kdb.a")


@C.frame("ddl_show_create", "SELECT 'CREATE TABLE kdb.a (`id` int PRIMARY KEY NOT NULL, `v` string) USING mutable' AS createtab_stmt")
def ddl_show_create(spark: SparkSession, sf: str) -> DataFrame:
    return _each(_catalog(spark, sf), *_TWO, "SHOW CREATE TABLE a")


@C.frame("ddl_use", "SELECT n_nationkey, n_regionkey FROM nation")
def ddl_use(spark: SparkSession, sf: str) -> DataFrame:
    c = _catalog(spark, sf, "nation")
    return _each(c, "CREATE KEYED DATABASE second", "USE second", "CREATE TABLE t PRIMARY KEY (n_nationkey) USING mmt AS SELECT n_nationkey, n_regionkey FROM nation", "USE kdb", "SELECT * FROM second.t")


@C.frame("ddl_drop", "SELECT * FROM (VALUES ('kdb', 'b')) AS t(namespace, tableName)")
def ddl_drop(spark: SparkSession, sf: str) -> DataFrame:
    return _each(_catalog(spark, sf), *_TWO, "DROP TABLE a", "DROP TABLE IF EXISTS kdb.none", "CREATE KEYED DATABASE gone", "CREATE TABLE gone.x (id INT PRIMARY KEY) USING mmt", "DROP DATABASE gone CASCADE", "SHOW TABLES")


@C.frame("ddl_truncate", "SELECT CAST(0 AS BIGINT) AS n")
def ddl_truncate(spark: SparkSession, sf: str) -> DataFrame:
    c = _catalog(spark, sf, "part")
    return _each(c, "CREATE TABLE t PRIMARY KEY (p_partkey) USING mmt AS SELECT p_partkey, p_size FROM part", "TRUNCATE TABLE t", "SELECT COUNT(*) AS n FROM t")


@C.frame("ddl_recover", "SELECT p_partkey, p_size FROM part")
def ddl_recover(spark: SparkSession, sf: str) -> DataFrame:
    c = _catalog(spark, sf, "part")
    return _each(c, "CREATE TABLE t PRIMARY KEY (p_partkey) USING mmt AS SELECT p_partkey, p_size FROM part", "DROP TABLE t", "RECOVER TABLE kdb.t", "SELECT * FROM t")


@C.frame("ddl_flashback", "SELECT p_partkey, p_size FROM part UNION ALL SELECT -p_partkey, p_size FROM part")
def ddl_flashback(spark: SparkSession, sf: str) -> DataFrame:
    """What was dropped and what was truncated, under other names."""
    c = _catalog(spark, sf, "part")
    make = "CREATE TABLE t PRIMARY KEY (k) USING mmt AS SELECT {} AS k, p_size AS p_size FROM part"
    return _each(
        c, make.format("p_partkey"), "DROP TABLE t", "FLASHBACK TABLE t TO t2", make.format("-p_partkey"), "TRUNCATE TABLE t", "FLASHBACK TABLE t TO t3",
        "SELECT k AS p_partkey, p_size FROM t2 UNION ALL SELECT k, p_size FROM t3 UNION ALL SELECT k, p_size FROM t",
    )


@C.frame("ddl_view_cache_explain", "SELECT COUNT(*) AS n, TRUE AS scans FROM customer WHERE c_acctbal > 0")
def ddl_view_cache_explain(spark: SparkSession, sf: str) -> DataFrame:
    c = _catalog(spark, sf, "customer")
    _each(c, "CREATE TABLE t PRIMARY KEY (c_custkey) USING mmt AS SELECT c_custkey, c_acctbal FROM customer", "CREATE OR REPLACE VIEW rich AS SELECT c_custkey FROM t WHERE c_acctbal > 0", "CACHE TABLE t", "UNCACHE TABLE t")
    scans = "FileScan parquet" in c.sql("EXPLAIN SELECT c_custkey FROM t").first()[0]
    return c.sql("SELECT COUNT(*) AS n FROM rich").withColumn("scans", F.lit(scans))


@C.frame("ddl_two_catalogs", "SELECT n_name, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def ddl_two_catalogs(spark: SparkSession, sf: str) -> DataFrame:
    """A table of Spark's own catalog joined with a keyed one; the policy decides whose a shared database name is."""
    c = _catalog(spark, sf, "nation", "customer")
    own = f"plain_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {own} LOCATION '{shared_path(spark, own)}'")
    spark.sql(f"CREATE TABLE {own}.nations USING parquet AS SELECT n_nationkey, n_name FROM nation")
    c.sql("CREATE TABLE customers PRIMARY KEY (c_custkey) USING mmt AS SELECT c_custkey, c_nationkey FROM customer")
    out = c.sql(f"SELECT n_name, COUNT(*) AS n FROM customers JOIN {own}.nations ON c_nationkey = n_nationkey GROUP BY n_name")
    spark.sql("USE default")
    return out


@C.frame("ddl_policy", "SELECT * FROM (VALUES ('keyedfirst', TRUE), ('sparkfirst', FALSE)) AS t(policy, keyed)")
def ddl_policy(spark: SparkSession, sf: str) -> DataFrame:
    root, name = shared_path(spark, "catalog"), f"both_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{shared_path(spark, name)}'")
    rows = []
    for policy in ("keyedfirst", "sparkfirst"):
        c = Catalog(spark, root, policy)
        c.create_database(name, keyed=True, if_not_exists=True)
        rows.append((policy, c.is_keyed(name)))
    spark.sql(f"DROP DATABASE {name}")
    return spark.createDataFrame(rows, "policy string, keyed boolean")


_REFUSED = ("CREATE TABLE default.x (a INT PRIMARY KEY) USING mmt", "CREATE TABLE x (a INT) USING mmt", "CREATE TABLE x (a INT PRIMARY KEY) USING log AS SELECT 1", "DROP TABLE none", "ALTER TABLE a DROP COLUMN id", "DROP DATABASE kdb", "INSERT INTO a (id, nope) VALUES (1, 2)")


@C.frame("ddl_guards", f"SELECT {len(_REFUSED)}::BIGINT AS refused, 0::BIGINT AS done")
def ddl_guards(spark: SparkSession, sf: str) -> DataFrame:
    """Statements that the wrong kind of database, a missing key or a missing table rules out."""
    c = _catalog(spark, sf)
    _each(c, *_TWO)
    refused = 0
    for s in _REFUSED:
        with contextlib.suppress(ValueError):
            c.sql(s)
            continue
        refused += 1
    return spark.createDataFrame([(refused, len(_REFUSED) - refused)], "refused long, done long")


@C.frame("ddl_alter", "SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS s_nationkey, CAST(CASE WHEN s_suppkey < 50 THEN 1.5 END AS DECIMAL(5,2)) AS extra, s_suppkey + 1 AS following FROM supplier")
def ddl_alter(spark: SparkSession, sf: str) -> DataFrame:
    c = _catalog(spark, sf, "supplier")
    return _each(
        c, "CREATE TABLE t PRIMARY KEY (s_suppkey) USING mmt AS SELECT s_suppkey, s_name, CAST(s_nationkey AS INT) AS s_nationkey FROM supplier", "ALTER TABLE t ADD COLUMN extra DECIMAL(5,2)", "ALTER TABLE t DROP COLUMN s_name", "ALTER TABLE t MODIFY COLUMN s_nationkey BIGINT",
        "ALTER TABLE t ADD COLUMN following BIGINT AS (s_suppkey + 1) VIRTUAL", "UPDATE t SET extra = 1.5 WHERE s_suppkey < 50", "SELECT * FROM t",
    )


@C.frame("ddl_alter_key", "SELECT COUNT(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem_rowstore)")
def ddl_alter_key(spark: SparkSession, sf: str) -> DataFrame:
    c = _catalog(spark, sf, "lineitem_rowstore")
    return _each(c, "CREATE TABLE t (l_orderkey BIGINT PRIMARY KEY, l_linenumber INT NOT NULL) USING mmt", "ALTER TABLE t DROP PRIMARY KEY, ADD PRIMARY KEY (l_orderkey, l_linenumber)", "INSERT INTO t SELECT l_orderkey, l_linenumber FROM lineitem_rowstore", "SELECT COUNT(*) AS n FROM t")


@C.frame("ddl_passed_on", "SELECT CAST(n_nationkey AS BIGINT) AS k, 'x' AS v FROM nation")
def ddl_passed_on(spark: SparkSession, sf: str) -> DataFrame:
    """Statements on Spark's own tables go to Spark as they are."""
    c, name = _catalog(spark, sf, "nation"), f"plain_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{shared_path(spark, name)}'")
    _each(c, f"CREATE TABLE {name}.t (k BIGINT) USING parquet", f"INSERT INTO {name}.t SELECT n_nationkey FROM nation", f"ALTER TABLE {name}.t ADD COLUMNS (v STRING)", f"ANALYZE TABLE {name}.t COMPUTE STATISTICS", "SET spark.sql.ansi.enabled")
    found = spark.table(f"{name}.t").select("k", F.lit("x").alias("v"))
    rows = spark.createDataFrame(found.collect(), found.schema)  # 25 rows, kept as the database goes
    c.sql(f"DROP DATABASE {name} CASCADE")
    return rows


@C.frame("ddl_statistics", "SELECT CAST(COUNT(*) + SUM(CASE WHEN p_size < 10 THEN 1 ELSE 0 END) AS BIGINT) AS n, TRUE AS sized FROM part")
def ddl_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Stored rows, versions included, and bytes."""
    c = _catalog(spark, sf, "part")
    _each(c, "CREATE TABLE t PRIMARY KEY (p_partkey) USING mmt AS SELECT p_partkey, p_size FROM part", "UPDATE t SET p_size = 0 WHERE p_size < 10")
    s = c.statistics("t")
    return spark.createDataFrame([(s["rows"], s["bytes"] > 0)], "n long, sized boolean")


@C.frame("ddl_admin", "SELECT * FROM (VALUES (TRUE, 'a,b', 'a')) AS t(there, before, after)")
def ddl_admin(spark: SparkSession, sf: str) -> DataFrame:
    """The same by methods in place of statements."""
    c = _catalog(spark, sf)
    c.create_database("adm", keyed=True)
    for t in ("a", "b"):
        c.create_table(f"adm.{t}", T.StructType([T.StructField("id", T.IntegerType())]), "mmt", ["id"])
    there, before = "adm" in c.databases(), ",".join(c.tables("adm"))
    c.drop_table("adm.b")
    after = ",".join(c.tables("adm"))
    c.drop_database("adm", cascade=True)
    return spark.createDataFrame([(there and "adm" not in c.databases(), before, after)], "there boolean, before string, after string")


# --- changes ---
@C.frame("dml_insert_overwrite_itself", "SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_acctbal > 0")
def dml_insert_overwrite_itself(spark: SparkSession, sf: str) -> DataFrame:
    c = _catalog(spark, sf, "customer")
    return _each(c, "CREATE TABLE t PRIMARY KEY (c_custkey) USING mmt AS SELECT c_custkey, c_acctbal FROM customer", "INSERT OVERWRITE t SELECT c_custkey, c_acctbal + 1 FROM t WHERE c_acctbal > 0", "SELECT * FROM t")


@C.frame("dml_insert_columns", "SELECT s_suppkey AS id, CAST(NULL AS STRING) AS note, s_acctbal AS bal FROM supplier")
def dml_insert_columns(spark: SparkSession, sf: str) -> DataFrame:
    c = _catalog(spark, sf, "supplier")
    return _each(c, "CREATE TABLE t (id BIGINT PRIMARY KEY, note STRING, bal DOUBLE) USING mmt", "INSERT INTO t (bal, id) SELECT s_acctbal, s_suppkey FROM supplier", "SELECT * FROM t")


@C.frame("dml_insert_several", "SELECT o_orderkey AS k, 'open' AS kind FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_custkey, 'customer' FROM orders GROUP BY o_custkey")
def dml_insert_several(spark: SparkSession, sf: str) -> DataFrame:
    c = _catalog(spark, sf, "orders")
    return _each(
        c, "CREATE TABLE open_orders (k BIGINT PRIMARY KEY) USING mmt", "CREATE TABLE customers (k BIGINT PRIMARY KEY, n BIGINT) USING mmt",
        "FROM orders INSERT INTO open_orders SELECT o_orderkey WHERE o_orderstatus = 'O' INSERT OVERWRITE TABLE customers SELECT o_custkey, COUNT(*) GROUP BY o_custkey", "SELECT k, 'open' AS kind FROM open_orders UNION ALL SELECT k, 'customer' FROM customers",
    )


@C.frame("dml_update_delete", "SELECT o_orderkey, CASE WHEN o_custkey % 5 = 1 THEN o_totalprice + 10 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderstatus <> 'P'")
def dml_update_delete(spark: SparkSession, sf: str) -> DataFrame:
    c = _catalog(spark, sf, "orders")
    return _each(
        c, "CREATE TABLE t PRIMARY KEY (o_orderkey) USING mmt AS SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders", "UPDATE t SET o_totalprice = o_totalprice + 10 WHERE o_custkey MOD 5 = 1", "DELETE FROM t WHERE o_orderstatus = 'P'",
        "SELECT o_orderkey, o_totalprice FROM t",
    )


@C.frame("dml_load_data", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(n_regionkey + 1 AS BIGINT) AS n_regionkey FROM nation WHERE n_nationkey > 4")
def dml_load_data(spark: SparkSession, sf: str) -> DataFrame:
    """Loaded twice, the second time in place of what was there."""
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    loads = iter([nation, nation.filter("n_nationkey > 4").withColumn("n_regionkey", F.col("n_regionkey") + 1)])
    c = _catalog(spark, sf, sources={"rowstore": lambda name: next(loads)})
    return _each(c, "CREATE TABLE nation_copy (n_nationkey BIGINT PRIMARY KEY, n_regionkey BIGINT) USING mmt", "LOAD DATA FROM rowstore INTO TABLE nation_copy", "LOAD DATA FROM rowstore OVERWRITE INTO TABLE nation_copy", "SELECT * FROM nation_copy")


@C.frame("dml_one_snapshot", "SELECT COUNT(*) AS n, MAX(c_acctbal) AS m FROM customer")
def dml_one_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Every reference to a table in a statement, in subqueries too, is as of the one version."""
    c = _catalog(spark, sf, "customer")
    _each(c, "CREATE TABLE t PRIMARY KEY (c_custkey) USING mmt AS SELECT c_custkey, c_acctbal FROM customer", "DELETE FROM t WHERE c_custkey MOD 2 = 0", "UPDATE t SET c_acctbal = 0")
    return c.sql("SELECT COUNT(*) AS n, MAX(t.c_acctbal) AS m FROM t JOIN t u ON t.c_custkey = u.c_custkey WHERE (SELECT COUNT(*) FROM t) = (SELECT COUNT(DISTINCT c_custkey) FROM t v) AND u.c_acctbal <= (SELECT MAX(c_acctbal) FROM t)", as_of=1)


@C.frame("dml_wide_table", "SELECT COUNT(*) AS n, CAST(SUM(c_custkey + 999) AS BIGINT) AS last, CAST(1000 AS BIGINT) AS columns FROM customer")
def dml_wide_table(spark: SparkSession, sf: str) -> DataFrame:
    """A thousand columns."""
    wide = table(spark, sf, "customer").select("c_custkey", *[(F.col("c_custkey") + i).alias(f"c{i}") for i in range(1, 1000)])
    c = _catalog(spark, sf)
    t = c.create_from("wide", wide, ["c_custkey"])
    return c.sql(f"SELECT COUNT(*) AS n, SUM(c999) AS last, CAST({len(t.schema)} AS BIGINT) AS columns FROM wide")


_KINDS = ["tinyint", "smallint", "int", "bigint", "float", "double", "decimal(20,5)", "date", "timestamp_ntz", "string"]


@C.frame("dml_sequences", f"SELECT {len(_KINDS)}::BIGINT AS key_types, {len(_KINDS) * 7}::BIGINT AS combinations, 0::BIGINT AS wrong")
def dml_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Insert, update, delete and insert again, at the boundary values of every key type with several value types."""
    wrong = done = 0
    for key in _KINDS:
        values = [k for k in _KINDS if k != key][:7]
        schema = T.StructType([T.StructField(n, T._parse_datatype_string(k)) for n, k in [("k", key), *((f"v{i}", v) for i, v in enumerate(values))]])
        rows = io.boundary_rows(spark, schema).filter("k IS NOT NULL").dropDuplicates(["k"])
        t = KeyedTable.create(spark, shared_path(spark, "sequence"), schema, key=["k"])
        t.append(rows, version=1)
        n = t.read(as_of=1).count()
        t.append(rows.withColumns({f"v{i}": F.lit(None).cast(v) for i, v in enumerate(values)}), version=2)
        updated = t.read(as_of=2).filter(" AND ".join(f"v{i} IS NULL" for i in range(len(values)))).count()
        t.delete(rows.select("k"), version=3)
        deleted = t.read().count()
        t.append(rows, version=4)
        given, again = (sorted(str(r) for r in d.collect()) for d in (rows, t.read()))  # some ten rows
        wrong += (n != len(given)) + (updated != n) + deleted + (given != again)
        done += len(values)
    return spark.createDataFrame([(len(_KINDS), done, wrong)], "key_types long, combinations long, wrong long")


# --- sources and sinks ---
@C.frame("source_jdbc", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def source_jdbc(spark: SparkSession, sf: str) -> DataFrame:
    """Written to a database in batches, and read back in ranges of its key. Spark brings an embedded database only: the driver's process writes it, all executors read its archive."""
    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    folder = plain_path(shared_path(spark, "jdbc"))
    if not folder:
        raise ValueError("source_jdbc needs a shared folder (spark.checkpoint.dir) that is mounted")
    os.makedirs(folder)
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    io.write_embedded(rows, f"jdbc:derby:{folder}/db;create=true", "customers")
    url = io.archive_derby(spark, f"{folder}/db")
    least, most = rows.agg(F.min("c_custkey"), F.max("c_custkey")).first()
    return io.read_jdbc(spark, url, "customers", column="c_custkey", bounds=None if most is None else (least, most), splits=4).select(*[F.col(c).alias(c.lower()) for c in ("c_custkey", "c_name", "c_acctbal")])


@C.frame("source_random_insert", "SELECT COUNT(*) AS n, TRUE AS even FROM orders")
def source_random_insert(spark: SparkSession, sf: str) -> DataFrame:
    """Rows spread over nodes whatever their keys: none gets more than a fifth above its part."""
    parts = io.spread_evenly(table(spark, sf, "orders"), 6).groupBy(F.spark_partition_id().alias("node")).agg(F.count(F.lit(1)).alias("c"))
    return parts.agg(F.sum("c").alias("n"), (F.max("c") * 5 <= F.sum("c") / 6 * 6 + 30).alias("even"))


@C.frame("source_insert_batches", "SELECT COUNT(*) AS n, CAST(CEIL(COUNT(*) / 50.0) AS BIGINT) AS files FROM customer")
def source_insert_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Files of at most 50 rows."""
    name = f"batches_{uuid.uuid4().hex}"
    path = shared_path(spark, name)
    spark.sql(f"CREATE TABLE {name} (c_custkey BIGINT) USING parquet LOCATION '{path}'")
    io.insert(table(spark, sf, "customer").select("c_custkey").coalesce(1), name, rows_per_file=50)
    out = spark.read.schema("c_custkey long").parquet(path).withColumn("f", F.col("_metadata.file_path")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("f").alias("files"))
    spark.sql(f"DROP TABLE {name}")
    return out


@C.frame("source_null_and_plain", "SELECT COUNT(*) AS n FROM lineitem")
def source_null_and_plain(spark: SparkSession, sf: str) -> DataFrame:
    """A sink that keeps nothing, and a plain one."""
    rows = table(spark, sf, "lineitem").select("l_orderkey")
    io.discard(rows)
    path = shared_path(spark, "plain")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path).agg(F.count(F.lit(1)).alias("n"))


_RANDOM = T.StructType([T.StructField(f"c{i}", k()) for i, k in enumerate((T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DoubleType, T.StringType, T.DateType, T.TimestampType))])


@C.frame("source_random_rows", "SELECT 5000::BIGINT AS n, TRUE AS same, TRUE AS spread")
def source_random_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Generated rows are the same for a seed, and differ among themselves."""
    a, b = (io.random_rows(spark, _RANDOM, 5000, seed=4, partitions=4) for _ in range(2))
    same = a.exceptAll(b).limit(1).count() == 0
    return a.agg(F.count(F.lit(1)).alias("n"), F.lit(same).alias("same"), (F.countDistinct("c3") > 4900).alias("spread"))


@C.frame("source_sorted_blocks", "SELECT COUNT(*) AS n, CAST(0 AS BIGINT) AS inversions FROM orders")
def source_sorted_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Every file of a sorted table has its rows in the order of the key, which is read off in the order of the file."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    t = KeyedTable.create(spark, shared_path(spark, "sorted"), orders.schema, engine="sorted", key=["o_custkey", "o_orderkey"])
    t.append(orders.orderBy(F.desc("o_orderkey")))
    return io.in_order(t.raw(), ["o_custkey", "o_orderkey"])


@C.frame("source_workload", "SELECT * FROM (VALUES ('read', 6::BIGINT), ('rows_read', 6::BIGINT + 3 * 21), ('rows_written', 60::BIGINT), ('scan_all', 0::BIGINT), ('scan_range', 3::BIGINT), ('write', 60::BIGINT)) AS t(what, n)")
def source_workload(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns of writes, reads and scans run on a keyed table."""
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
    t = KeyedTable.create(spark, shared_path(spark, "workload"), schema, key=["k"])
    ops = [*workload.times(60, workload.append()), *workload.times(9, workload.round_robin(workload.rand("read", 0, 60, 3), workload.rand("read", 0, 60, 4), workload.rand_scan_range(0, 60, 21)))]
    done = workload.run(t, ops, lambda k: (k, f"value {k}"))
    return spark.createDataFrame(list(done.items()), "what string, n long")


@C.frame("source_update_rows", "SELECT COUNT(*) AS n, SUM(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS changed FROM customer")
def source_update_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of another database updated by key in batches. The database is a file that all tasks open, one at a time."""
    import sqlite3

    path = plain_path(shared_path(spark, "update")) + ".db"
    rows = table(spark, sf, "customer").select("c_custkey")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE customers (c_custkey INTEGER PRIMARY KEY, note TEXT)")
    con.executemany("INSERT INTO customers VALUES (?, 'old')", ((r.c_custkey,) for r in rows.toLocalIterator()))
    con.commit()
    io.update_rows(rows.filter("c_custkey % 2 = 0").withColumn("note", F.lit("new")).coalesce(1), "customers", ["c_custkey"], lambda: sqlite3.connect(path), batch=500)
    n, changed = con.execute("SELECT COUNT(*), SUM(note = 'new') FROM customers").fetchone()
    con.close()
    return spark.createDataFrame([(n, changed)], "n long, changed long")


@C.frame("ddl_narrow_column", "SELECT p_partkey, CAST(p_size AS SMALLINT) AS p_size FROM part UNION ALL SELECT -1, CAST(7 AS SMALLINT)")
def ddl_narrow_column(spark: SparkSession, sf: str) -> DataFrame:
    """Values from before are cast where they are read."""
    c = _catalog(spark, sf, "part")
    return _each(c, "CREATE TABLE t PRIMARY KEY (p_partkey) USING mmt AS SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part", "ALTER TABLE t MODIFY COLUMN p_size SMALLINT", "INSERT INTO t VALUES (-1, 7)", "SELECT * FROM t")


@C.frame("dialect_random_queries", "SELECT 30::BIGINT AS queries, 0::BIGINT AS failed")
def dialect_random_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Queries made at random from the dialect's functions, each of which must be read and run over the whole table."""
    from brindle.functions.dialect import kinds_of, to_spark
    from brindle.sources.randomsql import Corpus

    register(spark, sf, "ontime")
    kinds = kinds_of(table(spark, sf, "ontime").schema)
    failed = 0
    for q in Corpus("ontime", "row_id", kinds, seed=11).queries(30):
        try:
            spark.sql(to_spark(q, kinds=kinds)).collect()  # ten rows at most
        except Exception:  # noqa: BLE001
            failed += 1
    return spark.createDataFrame([(30, failed)], "queries long, failed long")


@C.frame("source_change_stream", "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 5 <> 0")
def source_change_stream(spark: SparkSession, sf: str) -> DataFrame:
    """All customers arrive in a stream of changes, each twice, then every fifth one is deleted."""
    from brindle.streaming.cdc import change_schema, follow

    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    t = KeyedTable.create(spark, shared_path(spark, "customer"), customer.schema, key=["c_custkey"])
    changes = shared_path(spark, "changes")
    new = customer.withColumns({"version": F.lit(1).cast("long"), "kind": F.lit("I")})
    new.union(new).write.parquet(changes)
    customer.filter("c_custkey % 5 = 0").withColumns({"version": F.lit(2).cast("long"), "kind": F.lit("D")}).write.mode("append").parquet(changes)
    follow(spark.readStream.schema(change_schema(t)).parquet(changes), t, shared_path(spark, "offsets"), once=True).awaitTermination()
    return t.read()
