"""Applying a stream of changes to a keyed table: at least once is enough, since a version applied twice changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from brindle.sources.tables import MARK, VERSION, KeyedTable, newest

#: Columns of a change besides the table's own: its version and kind (I, U or D).
CHANGE = "version", "kind"


def apply_changes(table: KeyedTable, changes: DataFrame) -> None:
    """Append a batch of changes, each with its own version. Every version is written, so that what a snapshot shows doesn't depend on the batches; repeats (key, version, deleted or not) only once, as ``newest`` picks them."""
    info = table.info
    if info.engine != "mutable":
        raise ValueError("changes need a mutable table")
    fields = [f for f in table.schema.fields if f.name not in info.generated]
    rows = changes.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields], F.col("version").cast("long").alias(VERSION), (F.col("kind") == "D").cast("tinyint").alias(MARK))
    rows = newest(rows, [*info.key, VERSION, MARK], VERSION, MARK)
    seen = Observation()
    table._write(rows.observe(seen, F.max(VERSION).alias("top")), info.folder)
    if seen.get["top"] is not None:
        table._claim(seen.get["top"])


def follow(changes: DataFrame, table: KeyedTable, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Apply a stream of changes, batch by batch. ``once``: what is there now, then end."""
    w = changes.writeStream.foreachBatch(lambda df, _: apply_changes(table, df)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def change_schema(table: KeyedTable) -> T.StructType:
    return T.StructType([*table.schema.fields, T.StructField("version", T.LongType()), T.StructField("kind", T.StringType())])
