"""Encoding a corpus with a public tokenizer, and decoding it."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from brindle.llm.bpe import StreamDecoder, encoder, tokenizer_dir
from brindle.session import map_batches

#: Characters of text that are encoded before their ids are sent on, so that long texts don't pile up.
PART = 1 << 22


def vocabulary(name: str = "byte_bpe_50k") -> str:
    return f"{tokenizer_dir()}/{name}.json"


_SENT: set[tuple[str, str]] = set()


def ship(spark: SparkSession, path: str) -> str:
    """Sends a vocabulary file to the executors, once for each application, so that none must have it; returns the name that ``encoder`` finds it by."""
    context = spark.sparkContext
    if (context.applicationId, path) not in _SENT:
        context.addFile(path)
        _SENT.add((context.applicationId, path))
    return path.rstrip("/").split("/")[-1]


def parts(batches: Iterator[pa.RecordBatch], size: Callable[[object], int], last: int = -1) -> Iterator[tuple[pa.RecordBatch, list]]:
    """The batches, cut where the last column's values reach ``PART``, with these values as Python objects."""
    for b in batches:
        lo, room, held = 0, PART, []
        column = b.column(b.num_columns - 1)
        for i in range(b.num_rows):
            v = column[i].as_py()
            held.append(v)
            room -= size(v)
            if room <= 0:
                yield b.slice(lo, i + 1 - lo), held
                lo, room, held = i + 1, PART, []
        if held:
            yield b.slice(lo), held


def _length(v: object) -> int:
    return len(v) if v is not None else 0


def _encode(path: str, keep: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for b, texts in parts(batches, _length):
            flat, offsets = array("i"), array("i", [0])
            for t in texts:
                flat.extend(encode(t))
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.frombuffer(offsets, np.int32)), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32()))
            cols = [b.column(i) for i in range(keep)] + [ids]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def encode_texts(df: DataFrame, text: str, keep: list[str], *, ids: str = "ids", path: str | None = None) -> DataFrame:
    """The ``keep`` columns and the token ids of each row's text, one row for each row, repeated or not.

    Null and empty texts both give an empty list. No special tokens are added, and text that looks like one
    is plain text. Texts of any length are encoded whole. An empty table gives an empty result. A kept
    column named as the ids is a ValueError; other columns don't matter.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if ids in keep:
        raise ValueError(f"a kept column is named {ids}")
    out = T.StructType([*df.select(*keep).schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return map_batches(df.select(*keep, df[text].cast("string").alias("__text")), _encode(ship(df.sparkSession, path or vocabulary()), len(keep), to_arrow_schema(out)), out)


def _decode(path: str, keep: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path).merges.tokens
        for b, lists in parts(batches, _length):
            texts = []
            for v in lists:
                d = StreamDecoder(tokens)
                v = v or []
                texts.append("".join([d.feed(v[i : i + 4096]) for i in range(0, len(v), 4096)]) + d.close())
            cols = [b.column(i) for i in range(keep)] + [pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def decode_ids(df: DataFrame, ids: str, keep: list[str], *, text: str = "text", path: str | None = None) -> DataFrame:
    """The ``keep`` columns and each row's text. Null and empty lists give ''. An id that isn't of the vocabulary, a special token's among them, or null gives U+FFFD."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if text in keep:
        raise ValueError(f"a kept column is named {text}")
    out = T.StructType([*df.select(*keep).schema.fields, T.StructField(text, T.StringType())])
    return map_batches(df.select(*keep, df[ids].alias("__ids")), _decode(ship(df.sparkSession, path or vocabulary()), len(keep), to_arrow_schema(out)), out)
