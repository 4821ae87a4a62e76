"""Sessions, tables of a data directory, and the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Settings that every session made here gets; a cluster's own session is used as it is.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = 8, memory: str = "12g", partitions: int = 8, **conf: str) -> SparkSession:
    """A single-process session, for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("brindle")
    for key, value in {**DEFAULTS, "spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(partitions), **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Make tables of a data directory visible to ``spark.sql`` under their own names."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where that is unset (tests, a local run) is one made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stage(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut, and losing an executor loses nothing."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_bucketed(df: DataFrame, what: str, column: str, buckets: int) -> DataFrame:
    """``stage`` with the rows of each of a column's values in one bucket, so that a join on it moves the other side only.

    Writing shuffles nothing: each task writes one file for each bucket that it has rows of. The name in the
    catalog is dropped at once; the files stay until the session's JVM ends.
    """
    spark, name = df.sparkSession, f"brindle_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).option("path", shared_path(spark, what)).format("parquet").saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


_SHIPPED: set[str] = set()


def map_batches(df: DataFrame, f: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow``, with this package sent to the executors once for each application, so that none must have it installed."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        folder = plain_path(shared_dir(df.sparkSession))
        # read by the driver only, Spark hands it out: where the shared folder isn't mounted, a folder of the driver does
        packed = Path(folder or tempfile.mkdtemp()) / f"brindle-{context.applicationId}.zip"
        packed.parent.mkdir(parents=True, exist_ok=True)
        with zipfile.ZipFile(packed, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(str(packed))
        _SHIPPED.add(context.applicationId)
    return df.mapInArrow(f, schema)


def plain_path(uri: str) -> str | None:
    """The mounted path behind a file URI, or None where the folder is on another kind of file system."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def cpus() -> int:
    return int(os.environ.get("BENCH_CPUS", "8"))
