"""JSONPath over JSON text: members, indexes, wildcards, slices, unions, recursive descent and filters.

Paths that ``get_json_object`` understands stay inside Spark; the others run over Arrow batches, one text
parsed once whatever the path. Filters are read by a small grammar of their own; nothing is evaluated as code.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.session import map_batches

Step = Callable[[Any], Iterator[Any]]
_NAME = re.compile(r"[\w$-]+")
_STRING = re.compile(r"'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"")
_SLICE = re.compile(r"\s*(-?\d*)\s*:\s*(-?\d*)\s*(?::\s*(-?\d*))?\s*")
_OPERATORS: dict[str, Callable[[Any, Any], bool]] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, ">": lambda a, b: a > b}


class _Missing:
    pass


_NOTHING = _Missing()


def _children(v: Any) -> Iterator[Any]:
    yield from v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()


def _member(name: str) -> Step:
    return lambda v: iter([v[name]] if isinstance(v, dict) and name in v else [])


def _index(i: int) -> Step:
    return lambda v: iter([v[i]] if isinstance(v, list) and -len(v) <= i < len(v) else [])


def _slice(a: int | None, b: int | None, c: int | None) -> Step:
    return lambda v: iter(v[a:b:c] if isinstance(v, list) else [])


def _deep(v: Any) -> Iterator[Any]:
    todo = [v]
    while todo:
        x = todo.pop()
        yield x
        todo.extend(reversed(list(_children(x))))


class _Reader:
    def __init__(self, text: str):
        self.text, self.i = text, 0

    def fail(self) -> None:
        raise ValueError(f"cannot read the path {self.text!r} at {self.i}")

    def see(self, what: str) -> bool:
        while self.i < len(self.text) and self.text[self.i] == " ":
            self.i += 1
        return self.text.startswith(what, self.i)

    def take(self, what: str) -> bool:
        if self.see(what):
            self.i += len(what)
            return True
        return False

    def match(self, pattern: re.Pattern) -> re.Match | None:
        m = pattern.match(self.text, self.i)
        if m:
            self.i = m.end()
        return m

    # -- paths --
    def steps(self) -> list[Step]:
        """What follows ``$`` or ``@``."""
        out: list[Step] = []
        while self.i < len(self.text):
            if self.text.startswith("..", self.i):
                self.i += 2
                out.append(_deep)
                if not self.text.startswith("[", self.i):
                    out.append(self.name())
            elif self.text.startswith(".", self.i):
                self.i += 1
                out.append(self.name())
            elif self.text.startswith("[", self.i):
                self.i += 1
                out.append(self.bracket())
            else:
                break
        return out

    def name(self) -> Step:
        if self.take("*"):
            return _children
        m = self.match(_NAME)
        if not m:
            self.fail()
        return _member(m[0])

    def bracket(self) -> Step:
        if self.take("?("):
            test = self.either()
            if not self.take(")") or not self.take("]"):
                self.fail()
            return lambda v: (x for x in _children(v) if test(x))
        if m := re.compile(r"\(\s*@\.length\s*-\s*(\d+)\s*\)\]").match(self.text, self.i):
            self.i = m.end()
            return _index(-int(m[1]))
        parts: list[Step] = []
        while True:
            if self.take("*"):
                parts.append(_children)
            elif self.see("'") or self.see('"'):
                m = self.match(_STRING)
                if not m:
                    self.fail()
                parts.append(_member(re.sub(r"\\(.)", r"\1", m[1] if m[1] is not None else m[2])))
            elif m := self.match(_SLICE):
                parts.append(_slice(*[int(x) if x else None for x in m.groups()]))
            elif m := self.match(re.compile(r"\s*(-?\d+)\s*")):
                parts.append(_index(int(m[1])))
            elif m := self.match(_NAME):
                parts.append(_member(m[0]))
            else:
                self.fail()
            if self.take("]"):
                return parts[0] if len(parts) == 1 else lambda v: (x for p in parts for x in p(v))
            if not self.take(","):
                self.fail()

    # -- filters --
    def either(self) -> Callable[[Any], bool]:
        tests = [self.both()]
        while self.take("||"):
            tests.append(self.both())
        return lambda v: any(t(v) for t in tests)

    def both(self) -> Callable[[Any], bool]:
        tests = [self.test()]
        while self.take("&&"):
            tests.append(self.test())
        return lambda v: all(t(v) for t in tests)

    def test(self) -> Callable[[Any], bool]:
        if self.take("!"):
            inner = self.test()
            return lambda v: not inner(v)
        if self.take("("):
            inner = self.either()
            if not self.take(")"):
                self.fail()
            return inner
        left, is_path = self.value()
        for name, f in _OPERATORS.items():
            if self.take(name):
                right, _ = self.value()
                return lambda v: _compare(f, left(v), right(v))
        if not is_path:
            self.fail()
        return lambda v: left(v) is not _NOTHING

    def value(self) -> tuple[Callable[[Any], Any], bool]:
        if self.take("@"):
            steps = self.steps()
            return lambda v: next(_walk([v], steps), _NOTHING), True
        if m := self.match(_STRING):
            text = re.sub(r"\\(.)", r"\1", m[1] if m[1] is not None else m[2])
            return lambda v: text, False
        if m := self.match(re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")):
            constant = json.loads(m[0])
            return lambda v: constant, False
        self.fail()


def _compare(f: Callable[[Any, Any], bool], a: Any, b: Any) -> bool:
    """Values of different kinds, or that aren't there, only differ."""
    try:
        return a is not _NOTHING and b is not _NOTHING and bool(f(a, b))
    except TypeError:
        return False


def _walk(values: list[Any], steps: list[Step]) -> Iterator[Any]:
    if not steps:
        yield from values
        return
    for v in values:
        for x in steps[0](v):
            yield from _walk([x], steps[1:])


def compile_path(path: str) -> Callable[[Any], list[Any]]:
    """What a path finds in a parsed document, in document order; a ValueError for a path that can't be read."""
    r = _Reader(path.strip())
    if not r.take("$"):
        r.fail()
    steps = r.steps()
    if r.i < len(r.text):
        r.fail()
    return lambda document: list(_walk([document], steps))


_PLAIN = re.compile(r"\$(?:\.\w+|\[\d+\]|\['[^'\]*.]+'\])*")


def json_paths(df: DataFrame, column: str, paths: dict[str, str], keep: list[str]) -> DataFrame:
    """The ``keep`` columns, and for each path a column with the JSON texts of all that it finds, in order: an array.

    Where it finds nothing the array is empty; where the text is null or no JSON it is null. Strings keep
    their quotes. Result names that clash are a ValueError; other columns don't matter.
    """
    if clash := {*paths} & {*keep}:
        raise ValueError(f"kept columns are named like results: {sorted(clash)}")
    for p in paths.values():
        compile_path(p)  # a path that can't be read is an error now
    if all(_PLAIN.fullmatch(p) for p in paths.values()):
        parsed = F.expr(f"try_parse_json(`{column}`)")
        found = {n: F.expr(f"to_json(try_variant_get(try_parse_json(`{column}`), '{p.replace(chr(39), chr(92) + chr(39))}', 'variant'))") for n, p in paths.items()}
        return df.select(*keep, *[F.when(parsed.isNotNull(), F.filter(F.array(c), lambda x: x.isNotNull())).alias(n) for n, c in found.items()])
    schema = T.StructType([*df.select(*keep).schema.fields, *[T.StructField(n, T.ArrayType(T.StringType())) for n in paths]])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = {n: compile_path(p) for n, p in paths.items()}
        for b in parts:
            found: dict[str, list[list[str] | None]] = {n: [] for n in chosen}
            for text in b.column(len(keep)).to_pylist():
                try:
                    document = json.loads(text) if text is not None else None
                except ValueError:
                    text = None
                for n, f in chosen.items():
                    found[n].append(None if text is None else [json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in f(document)])
            columns = [b.column(i) for i in range(len(keep))] + [pa.array(v, pa.list_(pa.string())) for v in found.values()]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return map_batches(df.select(*keep, F.col(f"`{column}`").cast("string").alias("__json")), batches, schema)
