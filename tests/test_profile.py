from collections import Counter, defaultdict
from fractions import Fraction
from functools import partial

import pytest
from pyspark.sql import types as T

from brindle.operators.profile import ColumnRule, bad_cells, load_findings, profile_loads

SCHEMA = "row_id long, load_id long, t string, n int, load string, pair long"
LOADS = "load_id long, prev_load_id long"


def brute(rows, loads, column, numeric):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r[column])
    prev = dict(loads)
    out = {}
    for load, cells in by.items():
        have = sorted((c for c in cells if c is not None and (numeric or c.strip(" "))), key=lambda c: c)
        old = sorted(c for c in by.get(prev.get(load), []) if c is not None and (numeric or c.strip(" "))) if load is not None and prev.get(load) is not None else []
        a, b = Counter(have), Counter(old)
        l1 = ks = None
        if have and old:
            l1 = sum(abs(Fraction(a[v], len(have)) - Fraction(b[v], len(old))) for v in a | b)
            ks = max(abs(Fraction(sum(x <= v for x in have), len(have)) - Fraction(sum(x <= v for x in old), len(old))) for v in a | b)
        q = [str(have[max(1, -(-len(have) * k // 4)) - 1]) for k in (1, 2, 3)] if have else None
        out[load] = (len(cells), len(cells) - len(have), len(a), max(a.values(), default=0), str(have[0]) if have else None, str(have[-1]) if have else None, q, l1, ks)
    return out


def _small_chunks(curves, batches, chunk):
    from brindle.operators import profile

    before, profile.CHUNK = profile.CHUNK, chunk
    try:
        for b in batches:
            yield from curves(iter([b.slice(i, 1) for i in range(b.num_rows)])) if chunk < 100 else curves(iter([b]))
    finally:
        profile.CHUNK = before


@pytest.mark.parametrize(("partitions", "chunk"), [(1, 1 << 19), (7, 1 << 19), (2, 5)])
def test_profile_matches_brute_force(spark, monkeypatch, partitions, chunk):
    import random

    import sys

    from pyspark import cloudpickle

    from brindle.operators import profile

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    # workers import the module themselves: the chunk has to be in the function that is sent
    original = profile._curves
    monkeypatch.setattr(profile, "_curves", lambda doubts, batches: _small_chunks(partial(original, doubts), batches, chunk))

    pick = random.Random(3)
    loads = [(1, None), (2, 1), (3, 2), (4, 3), (5, 9), (6, 4)]
    rows = []
    for i in range(900):
        # load 3 holds two thirds of the rows, load 4 has no present cell, load 5's predecessor has no rows, null loads stand alone
        load = pick.choice([1, 2, 3, 3, 3, 3, 3, 3, 4, 5, None])
        t = None if load == 4 else pick.choice([None, "", "  ", " x", *"abcdefgh", "ä" * 300, "zz"])
        rows.append((i, load, t, pick.choice([None, -5, 3, 20, 100]), "clash", 7))
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = profile_loads(df, spark.createDataFrame(loads, LOADS), [ColumnRule("t", pattern="[a-d]"), ColumnRule("n", numeric=True)])
        bad = profile.bad_cells(df, got, [ColumnRule("t", pattern="[a-d]"), ColumnRule("n", numeric=True)], "load_id", "row_id").collect()
        got = got.loads.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(r.row for r in bad) == [r[0] for r in rows if r[2] is not None and r[2].strip(" ") and r[2] not in "abcd"]
    for column, at, numeric in (("t", 2, False), ("n", 3, True)):
        want = brute(rows, loads, at, numeric)
        seen = {r.load: r for r in got if r.column_name == column}
        assert seen.keys() == want.keys()
        for load, w in want.items():
            r = seen[load]
            n = (r.n_rows - r.n_missing) * ((r.prev_rows or 0) - (r.prev_missing or 0))
            l1, ks = (Fraction(int(x), n) if x is not None else None for x in (r.l1, r.ks))
            assert (r.n_rows, r.n_missing, r.n_distinct, r.top_count, r.min_value, r.max_value, r.quantiles, l1, ks) == w, (column, load)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert profile_loads(df, spark.createDataFrame([], LOADS), [ColumnRule("t")]).loads.collect() == []
    assert profile_loads(df, spark.createDataFrame([], LOADS), [ColumnRule("t", pattern="x")]).bad_values.collect() == []


def test_findings_and_bad_cells(spark):
    rows = [(i, 1, "N1", 1, "", 0) for i in range(20)] + [(100 + i, 2, None if i < 3 else f"N{i}", 2, "", 0) for i in range(20)] + [(300, 2, " ", None, "", 0), (301, 2, "x\n", 5, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    loads = spark.createDataFrame([(1, None), (2, 1)], LOADS)
    rules = [ColumnRule("t", pattern="N[0-9]+"), ColumnRule("n", allowed=spark.createDataFrame([(1,), (2,)], "v int"), numeric=True)]
    found = {tuple(r) for r in load_findings(profile_loads(df, loads, rules), shift_columns=("n",), stuck_columns=("t",)).collect()}
    assert found == {("t", "missing_jump", 2), ("n", "shift", 2), ("t", "stuck", 1)}
    bad = {tuple(r) for r in bad_cells(df, profile_loads(df, loads, rules), rules, "load_id", "row_id").collect()}
    assert bad == {("t", 2, 301, "x\n"), ("n", 2, 301, "5")}


def test_threshold_is_met_exactly(spark):
    rows = [(i, 1, None if i < 5 else f"v{i}", 1, "", 0) for i in range(20)] + [(50 + i, 2, None if i < 8 else f"v{i}", 1, "", 0) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = load_findings(profile_loads(df, spark.createDataFrame([(1, None), (2, 1)], LOADS), [ColumnRule("t")]))
    assert [tuple(r) for r in found.collect()] == [("t", "missing_jump", 2)]  # 0.40 - 0.25 is 0.15
    assert isinstance(found.schema["load"].dataType, T.LongType)


def test_drift(spark):
    rows = [(i, 1, f"v{i}", 1, "", 0) for i in range(10)] + [(50 + i, 2, f"v{i + 5}", 1, "", 0) for i in range(5)]
    profile = profile_loads(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, None), (2, 1)], LOADS), [ColumnRule("t")])
    for limit, found in (((1, 2), [2]), ((51, 100), [])):
        assert [r.load for r in load_findings(profile, drift=limit).filter("finding = 'drift'").collect()] == found
