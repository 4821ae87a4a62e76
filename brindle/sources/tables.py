"""Keyed tables over Parquet: append-only, sorted, and versioned with upsert, delete and snapshot reads.

A table is a folder of Parquet files with a sidecar ``_table.json``: engine, key, schema, partitioning.
A versioned table is only ever appended to: a change is a row with a higher version, a deletion one with
its delete mark set. Reading keeps the highest version of each key; a snapshot keeps versions up to a
time. Compaction rewrites a table without what no read can see.

Each append is a folder of its own in it, so that several writers don't disturb each other's commits.
The sidecar names the folder that holds the rows. What replaces rows (overwriting, truncating, compacting)
writes another folder first and then the sidecar, in one atomic rename: a crash leaves the table as it was.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.session import plain_path

VERSION, MARK, PART, BATCH = "_version", "_delmark", "_part", "_batch"
#: Engines: rows as they come; sorted by key in each file; upsert by key with versions.
ENGINES = ("log", "sorted", "mutable")
#: Defaults of partitions and buckets of a keyed table.
PARTITIONS, BUCKETS = 128, 8192


@dataclass
class Partitioning:
    """Range: named partitions with their upper bounds (None: no bound) of a column. Hash: so many partitions of an integer column."""

    kind: str
    column: str
    bounds: list[tuple[str, int | None]] = field(default_factory=list)
    count: int = 0

    def name_of(self) -> Column:
        c = F.col(self.column)
        if self.kind == "hash":
            return F.concat(F.lit("p"), F.pmod(c, F.lit(self.count)).cast("string"))
        out = F.lit(None).cast("string")
        for name, bound in reversed(self.bounds):
            out = F.lit(name) if bound is None else F.when(c < bound, F.lit(name)).otherwise(out)
        # a null sorts below every bound
        return F.when(c.isNull(), F.lit(self.bounds[0][0])).otherwise(out)

    def names(self) -> list[str]:
        return [f"p{i}" for i in range(self.count)] if self.kind == "hash" else [n for n, _ in self.bounds]


@dataclass
class TableInfo:
    """What the sidecar holds. ``generated``: column name to SQL expression, computed on read.

    ``stored``: under which names in the files, and of which types, a column's values are. A changed type
    gets a new name, so that no file has to be rewritten and no name has two types.
    """

    engine: str
    key: list[str]
    schema: str
    partitioning: dict | None = None
    generated: dict[str, str] = field(default_factory=dict)
    stored: dict[str, list[list[str]]] = field(default_factory=dict)
    used: list[str] = field(default_factory=list)
    not_null: list[str] = field(default_factory=list)
    folder: str = "data"
    trash: str | None = None

    def store(self, name: str, kind: str) -> None:
        """A new place in the files for a column."""
        at = name if name not in self.used else f"{name}@{sum(u.split('@')[0] == name for u in self.used)}"
        self.used.append(at)
        self.stored.setdefault(name, []).append([at, kind])


class KeyedTable:
    """A table at a path. All reads are lazy DataFrames; all changes are appends but compaction and dropping partitions."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- sidecar --
    def _file(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    @property
    def info(self) -> TableInfo:
        p, fs = self._file(f"{self.path}/_table.json")
        stream = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return TableInfo(**json.loads(text))

    def _save(self, info: TableInfo) -> None:
        new, fs = self._file(f"{self.path}/_table-{uuid.uuid4().hex}.json")
        out = fs.create(new, True)
        try:
            out.write(bytearray(json.dumps(asdict(info)).encode()))
        finally:
            out.close()
        old, _ = self._file(f"{self.path}/_table.json")
        context, hadoop = self.spark.sparkContext, self.spark.sparkContext._jvm.org.apache.hadoop.fs
        rename = getattr(hadoop, "Options$Rename")
        how = context._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        hadoop.FileContext.getFileContext(fs.getUri(), context._jsc.hadoopConfiguration()).rename(fs.makeQualified(new), fs.makeQualified(old), how)

    @property
    def data(self) -> str:
        """Where the rows are now."""
        return f"{self.path}/{self.info.folder}"

    def _claim(self, version: int) -> bool:
        """Whether this is the first to take a version: a file is made that must not be there, which is atomic."""
        name = f"{self.path}/_versions/{version:020d}"
        local = plain_path(name)
        if local is not None:
            os.makedirs(os.path.dirname(local), exist_ok=True)
            try:
                os.close(os.open(local, os.O_CREAT | os.O_EXCL))
                return True
            except FileExistsError:
                return False
        at, fs = self._file(name)
        try:
            return fs.createNewFile(at)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise

    def next_version(self) -> int | None:
        """A version above all that were written or claimed; of several writers at once each gets its own. None where rows have none."""
        if self.info.engine != "mutable":
            return None
        at, fs = self._file(f"{self.path}/_versions")
        taken = sorted(int(f.getPath().getName()) for f in fs.listStatus(at)) if fs.exists(at) else []
        version = (taken[-1] if taken else 0) + 1
        while not self._claim(version):
            version += 1
        for old in taken[:-64]:  # the highest one is enough to go on from
            fs.delete(self._file(f"{self.path}/_versions/{old:020d}")[0], False)
        return version

    def exists(self) -> bool:
        p, fs = self._file(f"{self.path}/_table.json")
        return fs.exists(p)

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, *, engine: str = "mutable", key: list[str] | None = None, partitioning: Partitioning | None = None, generated: dict[str, str] | None = None) -> KeyedTable:
        """A new empty table. A keyed engine needs a key, whose columns are then not null."""
        key = key or []
        if engine not in ENGINES:
            raise ValueError(f"engine {engine!r} is none of {ENGINES}")
        if engine == "mutable" and not key:
            raise ValueError("a mutable table needs a primary key")
        names = schema.fieldNames()
        if unknown := [k for k in key if k not in names]:
            raise ValueError(f"key columns {unknown} are not in the schema")
        t = cls(spark, path)
        if t.exists():
            raise ValueError(f"there is a table at {path}")
        needed = list(dict.fromkeys([*key, *(f.name for f in schema.fields if not f.nullable and f.name not in (generated or {}))]))
        info = TableInfo(engine, key, schema.json(), asdict(partitioning) if partitioning else None, generated or {}, not_null=needed)
        for f in schema.fields:
            if f.name not in info.generated:
                info.store(f.name, f.dataType.simpleString())
        t._save(info)
        return t

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.info.schema))

    # -- writing --
    def _rows(self, df: DataFrame, version: int | None, deleted: bool) -> DataFrame:
        """Rows as they are stored: columns cast, null where none is given, and a null in a column that must have values is an error when they are written."""
        info = self.info
        needed = info.key if deleted else info.not_null
        for c in needed:
            if c not in df.columns:
                raise ValueError(f"column {c} must not be null")
        rows = []
        for f in self.schema.fields:
            if f.name in info.generated:
                continue
            c = (F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType)
            if f.name in needed:
                c = F.when(c.isNull(), F.raise_error(F.lit(f"column {f.name} must not be null")).cast(f.dataType)).otherwise(c)
            rows.append(c.alias(f.name))
        out = df.select(*rows)
        if info.engine == "mutable":
            if version is None:
                raise ValueError("a change to a mutable table needs a version")
            self._claim(version)
            out = out.withColumn(VERSION, F.lit(version).cast("long")).withColumn(MARK, F.lit(1 if deleted else 0).cast("tinyint"))
        return out.sortWithinPartitions(*info.key) if info.engine == "sorted" else out

    def _write(self, rows: DataFrame, folder: str) -> None:
        info = self.info
        part = Partitioning(**info.partitioning) if info.partitioning else None
        w = rows.withColumn(PART, part.name_of()) if part else rows
        w = w.withColumnsRenamed({n: at[-1][0] for n, at in info.stored.items()})
        (w.write.partitionBy(PART) if part else w.write).parquet(f"{self.path}/{folder}/{BATCH}={uuid.uuid4().hex}")

    def append(self, df: DataFrame, version: int | None = None, deleted: bool = False) -> None:
        """Rows under the table's column names. A mutable table's rows all get ``version``, which must be above those before for the change to hold."""
        self._write(self._rows(df, version, deleted), self.info.folder)

    def overwrite(self, df: DataFrame, version: int | None = None) -> None:
        """Other rows in place of all there are, which the new ones may be made from; ``recover`` brings the old ones back."""
        folder = f"data-{uuid.uuid4().hex}"
        self._write(self._rows(df, version, False), folder)
        self._swap(folder)

    def _swap(self, folder: str, keep: bool = True) -> None:
        """Another folder's rows become the table's; what was before goes, or is kept for ``recover`` until the next time."""
        info = self.info
        gone = [info.trash] if keep else [info.folder]
        if keep:
            info.trash = info.folder
        info.folder = folder
        self._save(info)
        for g in gone:
            if g:
                at, fs = self._file(f"{self.path}/{g}")
                fs.delete(at, True)

    upsert = append

    def delete(self, keys: DataFrame, version: int) -> None:
        """Delete rows by key: ``keys`` has the key columns (and the partition column, where that isn't in the key)."""
        self.append(keys, version, deleted=True)

    def delete_where(self, condition: str, version: int) -> None:
        self.append(self.read().filter(condition), version, deleted=True)

    def update_where(self, condition: str, changes: dict[str, str], version: int) -> None:
        """Set columns by SQL expressions in the current rows that meet a condition; key columns stay."""
        if kept := set(changes) & set(self.info.key):
            raise ValueError(f"key columns {sorted(kept)} can't be set")
        rows = self.read().filter(condition)
        self.append(rows.select(*[(F.expr(changes[c]) if c in changes else F.col(c)).alias(c) for c in rows.columns]), version)

    # -- reading --
    def raw(self, partitions: list[str] | None = None) -> DataFrame:
        """All row versions, with the hidden columns of a mutable table; only the named partitions' files are read.

        The sidecar has the schema of all files, so none is opened to plan a query.
        """
        info = self.info
        hidden = [T.StructField(VERSION, T.LongType()), T.StructField(MARK, T.ByteType())] if info.engine == "mutable" else []
        part = [T.StructField(PART, T.StringType())] if info.partitioning else []
        batch = [T.StructField(BATCH, T.StringType())]
        fields = [f for f in self.schema.fields if f.name not in info.generated]
        p, fs = self._file(self.data)
        if not fs.exists(p):
            return self.spark.createDataFrame([], T.StructType([T.StructField(f.name, f.dataType) for f in fields] + hidden))
        places = [T.StructField(at, T._parse_datatype_string(kind)) for f in fields for at, kind in info.stored[f.name]]
        df = self.spark.read.schema(T.StructType([*places, *hidden, *batch, *part])).parquet(self.data)
        if partitions is not None:
            if not part:
                raise ValueError("the table has no partitions")
            if unknown := set(partitions) - set(Partitioning(**info.partitioning).names()):
                raise ValueError(f"no partitions {sorted(unknown)}")
            df = df.filter(F.col(PART).isin(*partitions))
        cols = []
        for f in fields:
            # a row has its value in one of the column's places: the newest that isn't null; a column with one place stays open to pushed filters
            there = [F.col(f"`{at}`") if kind == f.dataType.simpleString() else F.col(f"`{at}`").cast(f.dataType) for at, kind in reversed(info.stored[f.name])]
            cols.append((F.coalesce(*there) if len(there) > 1 else there[0]).alias(f.name))
        return df.select(*cols, *[F.col(h.name) for h in hidden])

    def read(self, as_of: int | None = None, partitions: list[str] | None = None) -> DataFrame:
        """Current rows, or those as of a version; generated columns are computed."""
        info, rows = self.info, self.raw(partitions)
        if info.engine == "mutable":
            if as_of is not None:
                rows = rows.filter(F.col(VERSION) <= as_of)
            rows = latest(rows, info.key, VERSION, MARK)
        elif as_of is not None:
            raise ValueError("only mutable tables have snapshots")
        for c, e in info.generated.items():
            rows = rows.withColumn(c, F.expr(e).cast(self.schema[c].dataType))
        return rows.select(*[f.name for f in self.schema.fields])

    # -- evolution: the sidecar changes, files stay --
    def _evolve(self, info: TableInfo, fields: list[T.StructField]) -> None:
        info.schema = T.StructType(fields).json()
        self._save(info)

    def add_column(self, name: str, kind: str, generated: str | None = None) -> None:
        """Rows from before have null there, also where a column of this name was dropped."""
        info = self.info
        if name in self.schema.fieldNames():
            raise ValueError(f"column {name} is there")
        if generated:
            info.generated[name] = generated
        else:
            info.store(name, kind)
        self._evolve(info, [*self.schema.fields, T.StructField(name, T._parse_datatype_string(kind))])

    def drop_column(self, name: str) -> None:
        info = self.info
        if name in info.key or name not in self.schema.fieldNames():
            raise ValueError(f"column {name} can't be dropped")
        info.generated.pop(name, None)
        info.stored.pop(name, None)
        self._evolve(info, [f for f in self.schema.fields if f.name != name])

    def modify_column(self, name: str, kind: str) -> None:
        """Values from before are cast on reading; one that doesn't fit is an error then, as ANSI casts are."""
        info = self.info
        info.store(name, kind)
        self._evolve(info, [T.StructField(f.name, T._parse_datatype_string(kind), f.nullable) if f.name == name else f for f in self.schema.fields])

    def alter_key(self, key: list[str]) -> None:
        info = self.info
        if unknown := [k for k in key if k not in self.schema.fieldNames()]:
            raise ValueError(f"no columns {unknown}")
        info.key, info.not_null = key, list(key)
        self._save(info)

    def add_partition(self, name: str, bound: int | None) -> None:
        """At the end of a range partitioning that has no unbounded last partition."""
        info = self.info
        p = Partitioning(**info.partitioning)
        last = p.bounds[-1][1]
        if p.kind != "range" or last is None or (bound is not None and bound <= last):
            raise ValueError("a partition can be added only above the last bound of a range")
        info.partitioning["bounds"].append([name, bound])
        self._save(info)

    def drop_partition(self, name: str) -> None:
        """Its rows are gone; later rows of its range fall into the next one."""
        info = self.info
        p = Partitioning(**info.partitioning)
        if name not in p.names() or p.kind != "range" or len(p.bounds) == 1:
            raise ValueError(f"partition {name} can't be dropped")
        data, fs = self._file(self.data)
        for batch in fs.listStatus(data) if fs.exists(data) else []:
            fs.delete(self._file(f"{batch.getPath()}/{PART}={name}")[0], True)
        info.partitioning["bounds"] = [b for b in info.partitioning["bounds"] if b[0] != name]
        self._save(info)

    def truncate(self) -> None:
        """No rows; ``recover`` brings the old ones back until rows are replaced again."""
        self._swap(f"data-{uuid.uuid4().hex}")

    def recover(self) -> None:
        """The rows from before a truncation, as long as no new ones are there."""
        info = self.info
        now, fs = self._file(self.data)
        if not info.trash or fs.exists(now):
            raise ValueError("there is nothing to recover, or new rows are there")
        info.folder, info.trash = info.trash, None
        self._save(info)

    def flashback(self, path: str) -> KeyedTable:
        """The rows from before a truncation as a table of their own."""
        info = self.info
        if not info.trash:
            raise ValueError("there is nothing to bring back")
        new = self.create_like(path)
        old, fs = self._file(f"{self.path}/{info.trash}")
        to, _ = self._file(new.data)
        if fs.exists(old):
            fs.rename(old, to)
        info.trash = None
        self._save(info)
        return new

    def create_like(self, path: str) -> KeyedTable:
        new = KeyedTable(self.spark, path)
        if new.exists():
            raise ValueError(f"there is a table at {path}")
        info = self.info
        info.folder, info.trash = "data", None
        new._save(info)
        return new

    def compact(self, keep_from: int | None = None) -> None:
        """Rewrite a mutable table with the rows that reads as of ``keep_from`` (by default now) and later can see."""
        info, rows = self.info, self.raw()
        if info.engine != "mutable":
            raise ValueError("only mutable tables are compacted")
        old = rows if keep_from is None else rows.filter(F.col(VERSION) <= keep_from)
        kept = newest(old, info.key, VERSION, MARK)
        # a deletion that is the oldest thing to see needs no row
        kept = kept.filter(F.col(MARK) == 0)
        if keep_from is not None:
            kept = kept.unionByName(rows.filter(F.col(VERSION) > keep_from))
        folder = f"data-{uuid.uuid4().hex}"
        self._write(kept, folder)
        self._swap(folder, keep=False)


def newest(rows: DataFrame, key: list[str], version: str, mark: str) -> DataFrame:
    """Of each key the row with the highest version; a deletion wins among equal versions, then the row with the greatest hash, which is always the same one.

    Only the first row of each key is asked for, so Spark limits every key before the shuffle: a key with
    very many versions moves few rows, and of the other columns only a hash is compared.
    """
    q = lambda c: F.col(f"`{c}`")
    rest = [c for c in rows.columns if c not in (*key, version, mark)]
    order = [q(version).desc(), q(mark).desc(), *([F.xxhash64(*[q(c) for c in rest]).desc()] if rest else [])]
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*[q(k) for k in key]).orderBy(*order)))
    return ranked.filter(F.col("__rank") == 1).drop("__rank")


def latest(rows: DataFrame, key: list[str], version: str, mark: str) -> DataFrame:
    """``newest`` without the deleted keys and the hidden columns."""
    return newest(rows, key, version, mark).filter(F.col(mark) == 0).drop(version, mark)
