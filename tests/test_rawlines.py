import datetime
import random

import pyarrow as pa
import pytest

from brindle.operators.rawlines import LineField, index_lines, parse_lines, read_records
from brindle.plans.problems import FLIGHT_LINE

GOOD = '2003-07-02,AF,20763,N82YD,3661,MGW,"Quinoby, ZT",XTV,"Tamen ""X""/Mareby, YH",-8,0,864'


def split(line):
    """One line by the rules, character by character: its fields, or 'quoting'."""
    fields, i = [], 0
    while True:
        if i < len(line) and line[i] == '"':
            value, i = "", i + 1
            while True:
                if i >= len(line):
                    return "quoting"
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        value, i = value + '"', i + 2
                        continue
                    i += 1
                    break
                value, i = value + line[i], i + 1
            if i < len(line) and line[i] != ",":
                return "quoting"
            fields.append(value)
        else:
            end = line.find(",", i)
            end = len(line) if end < 0 else end
            if '"' in line[i:end]:
                return "quoting"
            fields.append(line[i:end])
            i = end
        if i >= len(line):
            return fields
        i += 1


def test_structure_matches_the_rules():
    pick = random.Random(5)
    lines = [None, "", "\r", ",", '"', '""', '"""', '""""', ",\r", "\r\r"] + ["".join(pick.choice('ab",",""\ré') for _ in range(pick.randint(0, 14))) for _ in range(6000)]
    code, sound, data, starts, ends = index_lines(pa.array(lines), 3)
    row = dict(zip(sound.tolist(), range(len(sound)), strict=True))
    for k, line in enumerate(lines):
        text = line or ""
        text = text[:-1] if text.endswith("\r") else text
        want = split(text)
        if want == "quoting":
            assert code[k] == 1, line
        elif len(want) != 3:
            assert code[k] == 2, line
        else:
            assert code[k] == 0, line
            got = [bytes(data[a:b]).decode() for a, b in zip(starts[row[k]], ends[row[k]], strict=True)]
            assert [g[1:-1].replace('""', '"') if g.startswith('"') else g for g in got] == want, line


def test_sliced_batches():
    lines = pa.array(["x", "a,b,c", None, 'a,"b,",c'])
    code, sound, *_ = index_lines(lines.slice(1), 3)
    assert code.tolist() == [0, 2, 0] and sound.tolist() == [0, 2]


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        (lambda s: s, None), (lambda s: s + "\r", None), (lambda s: s + "\r\r", "value"), (lambda s: s.replace("N82YD", ""), None), (lambda s: s.replace("N82YD", "N82YI"), "value"), (lambda s: s.replace("N82YD", "N123456"), "value"),
        (lambda s: s.replace("N82YD", "N1234A"), None), (lambda s: s.replace("2003-07-02", "2003-02-29"), "value"), (lambda s: s.replace("2003-07-02", "2004-02-29"), None), (lambda s: s.replace("2003", "1986"), "value"), (lambda s: s.replace("2003", "2029"), None),
        (lambda s: s.replace("AF", "AF (1)"), None), (lambda s: s.replace("AF", "AF (0)"), "value"), (lambda s: s.replace("-8", ""), None), (lambda s: s.replace("-8", "--8"), "value"), (lambda s: s.replace("Quinoby", "Quinöbyß"), None), (lambda s: s.replace("Quinoby", "  "), "value"),
        (lambda s: s.replace("Quinoby", " Q "), None), (lambda s: s.replace("Quinoby", "Quin3by"), "value"), (lambda s: s + ",", "column_count"), (lambda s: s.replace('"Quin', 'x"Quin'), "quoting"), (lambda s: s.replace('ZT"', "ZT"), "quoting"), (lambda s: "", "column_count"), (lambda s: None, "column_count"),
        (lambda s: s.replace(",0,864", ",2,864"), "value"), (lambda s: s.replace("864", "1234567"), "value"), (lambda s: s + "\n", "value"), (lambda s: "９" + s[1:], "value"), (lambda s: s + "x" * 200_000, "value"),
    ],
)
def test_flight_lines(spark, change, reason):
    df = spark.createDataFrame([(1, change(GOOD))], "raw_id long, raw_line string")
    assert parse_lines(df, "raw_line", FLIGHT_LINE, ["raw_id"]).first().reason == reason


def test_typed_row_and_clashes(spark):
    df = spark.createDataFrame([(1, GOOD, "x"), (1, GOOD, "x"), (2, None, None)], "raw_id long, raw_line string, origin string")
    rows = parse_lines(df, "raw_line", FLIGHT_LINE, ["raw_id"]).collect()
    assert len(rows) == 3 and rows[0] == rows[1]
    r = rows[0]
    assert (r.flightdate, r.airlineid, r.tailnum, r.destcityname, r.depdelay) == (datetime.date(2003, 7, 2), 20763, "N82YD", 'Tamen "X"/Mareby, YH', -8)
    assert all(rows[2][f.name] is None for f in FLIGHT_LINE)
    with pytest.raises(ValueError, match="origin"):
        parse_lines(df, "raw_line", FLIGHT_LINE, ["origin"])
    assert parse_lines(df.limit(0), "raw_line", FLIGHT_LINE, ["raw_id"]).collect() == []


def test_empty_field_of_a_number_is_null(spark):
    df = spark.createDataFrame([("1,",)], "s string")
    r = parse_lines(df, "s", [LineField("a", "[0-9]+", "int"), LineField("b", "[0-9]*", "int")], []).first()
    assert (r.reason, r.a, r.b) == (None, 1, None)


def test_values_too_large_are_rejects(spark):
    fields = [LineField("a", "-?[0-9]+", "int"), LineField("b", "[0-9.]*", "double"), LineField("c", "[0-9]*", "long")]
    lines = ["1,2.5,3", "2147483648,1,1", "-2147483648,,9223372036854775807", "1,1.2.3,1", "1,1,9223372036854775808"]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    got = {r.i: (r.reason, r.a, r.b, r.c) for r in parse_lines(df, "line", fields, ["i"]).collect()}
    assert got == {0: (None, 1, 2.5, 3), 1: ("value", None, None, None), 2: (None, -(2**31), None, 2**63 - 1), 3: ("value", None, None, None), 4: ("value", None, None, None)}


@pytest.mark.parametrize("split", [7, 64, 1 << 20])
def test_records_across_splits(spark, tmp_path, split):
    """Line breaks inside quotes, whatever the splits cut: single breaks, long fields over many splits, doubled quotes, empty lines."""
    want = ["1,a,b", '2,"two\nlines",c', "", '3,"' + "long line\n" * 30 + '""x""",d\r', "4,plain,", '"5\n\n\n",,"\n"', "6,z,z"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes(("\n".join(want * 3) + "\n").encode())
    (tmp_path / "in" / "b.csv").write_bytes("\n".join(want).encode())
    (tmp_path / "in" / "empty.csv").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = read_records(spark, f"file://{tmp_path}/in").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, n in (("a.csv", 3), ("b.csv", 1)):
        own = sorted((r.block, r.number, r.record) for r in got if r.file.endswith(name))
        assert [r[2] for r in own] == want * n
    assert {r.file[-5:] for r in got} == {"a.csv", "b.csv"}


def test_records_with_a_stray_quote(spark, tmp_path):
    (tmp_path / "x.csv").write_text('1,a\n2,"b\n3,c"d"\n4,e\n')
    got = parse_lines(read_records(spark, f"file://{tmp_path}/x.csv"), "record", [LineField("k", "[0-9]+", "int"), LineField("v", "(?s:.*)")], ["number"])
    assert {r.reason for r in got.collect()} == {None, "quoting"} and sum(len(r.record.split("\n")) for r in read_records(spark, f"file://{tmp_path}/x.csv").collect()) == 4
