import pytest

from brindle.functions.jsonpath import compile_path, json_paths

STORE = {"store": {"book": [{"title": "A", "price": 8, "tags": ["x", "y"]}, {"title": "B", "price": 12.5}, {"title": "C", "price": 9, "isbn": "1"}, {"title": "D"}], "bike": {"price": 20}}, "a b": {"it's": 1}, "n": None}
CASES = {
    "$": [STORE], "$.store.bike.price": [20], "$.store.book[0].title": ["A"], "$['store']['bike']": [{"price": 20}], "$['a b']['it\\'s']": [1], "$.store.book[*].title": ["A", "B", "C", "D"], "$.store.*": [STORE["store"]["book"], {"price": 20}], "$..price": [8, 12.5, 9, 20], "$..book[2].title": ["C"],
    "$.store.book[-1].title": ["D"], "$.store.book[(@.length-1)].title": ["D"], "$.store.book[0,2].title": ["A", "C"], "$.store.book[1:3].title": ["B", "C"], "$.store.book[:2].title": ["A", "B"], "$.store.book[-2:].title": ["C", "D"], "$.store.book[::2].title": ["A", "C"], "$.store.book[0]['title','price']": ["A", 8],
    "$.store.book[?(@.price < 10)].title": ["A", "C"], "$.store.book[?(@.isbn)].title": ["C"], "$.store.book[?(!@.price)].title": ["D"], "$.store.book[?(@.price > 8 && @.title != 'C')].title": ["B"], "$.store.book[?(@.title == \"A\" || @.title == 'D')].title": ["A", "D"], "$.store.book[?(@.tags[1] == 'y')].title": ["A"],
    "$..[?(@.price == 20)]": [{"price": 20}], "$.n": [None], "$.none": [], "$.store.book[9]": [], "$.n.x": [], "$.store.book[?(@.price > 'x')].title": [],
}


@pytest.mark.parametrize("path", CASES)
def test_paths(path):
    assert compile_path(path)(STORE) == CASES[path]


@pytest.mark.parametrize("path", ["", "a.b", "$.", "$[", "$.a[", "$['x", "$[?(@.a]", "$[?(1)]", "$.a b", "$[?(__import__('os'))]"])
def test_unreadable_paths(path):
    with pytest.raises(ValueError):
        compile_path(path)


def test_over_a_table(spark):
    df = spark.createDataFrame([(1, '{"a": [1, "x"], "b": null}'), (2, "no json"), (3, None), (4, "[]"), (5, "")], "i int, doc string")
    for paths in ({"a": "$.a", "b": "$.b"}, {"a": "$.a", "b": "$.b", "w": "$.a[*]"}):
        got = {r.i: r for r in json_paths(df, "doc", paths, ["i"]).collect()}
        assert got[1].a == ['[1,"x"]'] and got[1].b == ["null"] and got[2].a is None and got[3].a is None and got[4].a == [] and got[5].a is None
    assert got[1].w == ["1", '"x"']
    with pytest.raises(ValueError):
        json_paths(df, "doc", {"i": "$.a"}, ["i"])
    assert json_paths(df.limit(0), "doc", {"w": "$..*"}, ["i"]).collect() == []


def test_report_table(spark):
    from brindle.operators.report import PivotSpec, report_table

    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "y", 5.0), ("b", "old", 7.0), ("c", None, 9.0), (None, "x", 2.0)], "r string, c string, v double")
    ask = lambda spec: [tuple(r) for r in report_table(df, "v", spec).orderBy(1).collect()]
    d = report_table(df, "v", "rows: r; cols: c; cell: avg")
    assert d.columns == ["row", "c:old", "c:x", "c:y"] and ask("rows: r; cols: c; cell: avg") == [("r:a", "", "1.0", "3.0"), ("r:b", "7.0", "", "5.0")]
    assert ask("c.x = c.old; rows: r | notag; cols: c | notag; cell: cnt") == [("a", "1", "1"), ("b", "1", "1")]
    d = report_table(df, "v", "kind = c | kind.z = kind.y; rows: r | limit(1) | notag; cols: kind | notag | limit(2); cell: avg")
    assert d.columns == ["row", "z"] and d.collect()[0] == ("b", "5.0")
    d = report_table(df, "v", "rows: r | notitle; cols: c | notitle; cell: cnt")
    assert d.columns == ["c0", "c1", "c2"] and d.count() == 2
    for bad in ("rows: r", "rows: r; rows: r; cols: c", "rows: r | top(3); cols: c", "a = b = c; rows: r; cols: c", "a.b = c; rows: r; cols: c"):
        with pytest.raises(ValueError):
            PivotSpec.parse(bad)
