import datetime
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.operators import copydiff
from brindle.operators.copydiff import Copy, PresenceBitmap, compare_copies

LEFT = "a long, b int, num decimal(15,2), day date, s string, side string"
RIGHT = "a long, b int, num double, day timestamp_ntz, s string, k0 int, version long, gone int"


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(0, 140_000), max_size=400), st.lists(st.integers(0, 140_000), max_size=400), st.booleans())
def test_bitmaps(a, b, invert):
    size = 140_001
    x, y = np.zeros(size, bool), np.zeros(size, bool)
    x[a], y[b] = True, True
    if invert:
        x = ~x
    p, q = PresenceBitmap.of(x), PresenceBitmap.of(y)
    assert (p & q).ordinals().tolist() == np.flatnonzero(x & y).tolist()
    assert p.and_not(q).ordinals().tolist() == np.flatnonzero(x & ~y).tolist()


def copies(spark, left, right):
    return Copy(spark.createDataFrame(left, LEFT)), Copy(spark.createDataFrame(right, RIGHT), "version", "gone")


def diff(spark, left, right, **more):
    return sorted(map(tuple, compare_copies(*copies(spark, left, right), ["a", "b"], ["num", "day", "s"], names=("l", "r"), **more).collect()), key=str)


def row(a, b, num="1.00", day=datetime.date(2020, 1, 2), s="x"):
    return (a, b, Decimal(num) if num else None, day, s, "clash")


def version(a, b, v, gone=0, num=1.0, day=datetime.datetime(2020, 1, 2, 13, 5), s="x  "):
    return (a, b, num, day, s, 1, v, gone)


@pytest.mark.parametrize("chunk", [3, 1 << 18])
def test_all_kinds(spark, monkeypatch, chunk):
    monkeypatch.setattr(copydiff, "CHUNK", chunk)
    left = [row(1, 1), row(1, 1), row(1, 2, num="1.01"), row(2, 1, s=None), row(3, 1), row(5, 1, num=None, day=None, s=None), row(6, 1, s=" x"), row(None, 1), row(8, 1)]
    right = [
        version(1, 1, 5, num=9.0), version(1, 1, 6), version(1, 1, 6), version(1, 1, 2, 1), version(1, 2, 1, num=1.0149), version(2, 1, 1, s=""), version(3, 1, 1), version(3, 1, 2, 1), version(4, 1, 7, 1), version(4, 1, 8),
        version(5, 1, 1, num=None, day=None, s=None), version(6, 1, 1), version(None, 1, 1), version(None, None, 1), version(8, 1, 3, num=1.0000001, day=datetime.datetime(2020, 1, 3)),
    ]
    want = [(2, 1, "s"), (3, 1, "missing_in_r"), (4, 1, "missing_in_l"), (6, 1, "s"), (None, None, "missing_in_l"), (8, 1, "day")]
    assert diff(spark, left, right) == sorted(want, key=str)


def test_empty_sides(spark):
    assert diff(spark, [], []) == []
    assert diff(spark, [row(1, 1)], []) == [(1, 1, "missing_in_r")]
    assert diff(spark, [], [version(1, 1, 1), version(2, 1, 1, 1)]) == [(1, 1, "missing_in_l")]


def test_hot_key_and_long_values(spark, monkeypatch):
    monkeypatch.setattr(copydiff, "CHUNK", 50)
    long = "y" * 20_000
    right = [version(1, 1, v, v % 2, s=str(v)) for v in range(700)] + [version(1, 1, 1000, s=long)] + [version(2, b, 1) for b in range(60)]
    left = [row(1, 1, s=long + "!")] + [row(1, 1, s=long + "!")] * 200 + [row(2, b) for b in range(60)]
    assert diff(spark, left, right, partitions=2) == [(1, 1, "s")]


def test_repeated_rows_that_differ_by_padding_only(spark):
    assert diff(spark, [row(1, 1, s="x "), row(1, 1, s="x")], [version(1, 1, 1)]) == []


def test_numbers_of_any_size(spark):
    """Beyond 10^16 hundredths don't fit in 64 bits; the difference must still be seen."""
    kinds = "a long, b int, num decimal(38,2)"
    left = [(1, i, Decimal(v)) for i, v in enumerate(["1e17", "1e17", "123456789012345678.25", "1e30", "5.00", "99999999999999999999"])]
    right = [(1, i, v) for i, v in enumerate([2e17, 1e17, 123456789012345680.0, 1e30, 1e20, None])]
    for chunk in ({}, {"partitions": 3}):
        got = compare_copies(Copy(spark.createDataFrame(left, kinds)), Copy(spark.createDataFrame(right, "a long, b int, num double")), ["a", "b"], ["num"], **chunk)
        assert sorted((r.b, r.diff_field) for r in got.collect()) == [(0, "num"), (2, "num"), (4, "num"), (5, "num")]
    doubles = spark.createDataFrame([(1, 1, float("nan")), (1, 2, 1e300), (1, 3, float("inf"))], "a long, b int, num double")
    others = spark.createDataFrame([(1, 1, float("nan")), (1, 2, 1e301), (1, 3, float("inf"))], "a long, b int, num double")
    assert [(r.b, r.diff_field) for r in compare_copies(Copy(doubles), Copy(others), ["a", "b"]).collect()] == [(2, "num")]


def test_ties_among_very_large_numbers(spark):
    a = spark.createDataFrame([(1, 1, Decimal("1e17")), (1, 1, Decimal("3e17"))] * 3, "a long, b int, num decimal(38,2)")
    assert compare_copies(Copy(a), Copy(a), ["a", "b"]).collect() == []


def test_rules(spark):
    left = spark.createDataFrame([(1, "x ", 5, datetime.datetime(2020, 1, 1, 3))], "k int, s string, n int, t timestamp_ntz")
    right = spark.createDataFrame([(1, "x", 5 + 2**32, datetime.datetime(2020, 1, 1, 9))], "k int, s string, n long, t timestamp_ntz")
    found = lambda **more: sorted(r.diff_field for r in compare_copies(Copy(left), Copy(right), ["k"], **more).collect())
    assert found() == ["n", "t"]
    assert found(rules={"s": "exact", "t": "date"}) == ["n", "s"]
    with pytest.raises(ValueError):
        found(rules={"s": "nearly"})
