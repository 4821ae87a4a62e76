"""User functions: registration for SQL. Vectorised ones only; a row at a time is the slow path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def register_vectorised(spark: SparkSession, name: str, f: Callable, returns: str) -> None:
    """Make a function of pandas Series callable from SQL by a name."""
    spark.udf.register(name, F.pandas_udf(f, returns))


def register_table_function(spark: SparkSession, name: str, handler: type, returns: str) -> None:
    """Make a class with an ``eval`` generator a table-valued function of SQL."""
    spark.udtf.register(name, F.udtf(handler, returnType=returns))


def register_java(spark: SparkSession, name: str, class_name: str, returns: str | None = None) -> None:
    """A function from a class on the classpath."""
    spark.udf.registerJavaFunction(name, class_name, returns)


def transform_script(df: DataFrame, command: str, schema: str, view: str = "__script_input") -> DataFrame:
    """Rows through a script's standard input and output, tab-separated."""
    df.createOrReplaceTempView(view)
    return df.sparkSession.sql(f"SELECT TRANSFORM(*) USING '{command}' AS ({schema}) FROM {view}")
