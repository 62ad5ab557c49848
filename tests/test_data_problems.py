import datetime as dt

import pyarrow as pa
import pytest

from wakloom.operators.diff import table_diff
from wakloom.operators.rejects import load_review, split_records

D = "k int, a string, b array<string>, extra int"


def diff(spark, left, right):
    rows = table_diff(spark.createDataFrame(left, D), spark.createDataFrame(right, D), ["k"], ["a", "b"]).collect()
    return sorted((r.k is not None, r.k or 0, r.kind, r.field) for r in rows)


def test_diff_cases(spark):
    left = [(1, "x", ["p"], 1), (2, None, [], 1), (3, "y", None, 1), (3, "y", None, 1), (4, "z", ["p", None], 1), (None, "n", None, 1)]
    right = [(1, "x", ["p"], 9), (2, "", None, 1), (3, "y", None, 1), (5, "", [], 1), (4, "z", ["p", "null"], 1), (None, "m", None, 1)]
    assert diff(spark, left, right) == sorted([(True, 2, "differs", "a"), (True, 2, "differs", "b"), (True, 5, "only_right", ""), (True, 4, "differs", "b"), (False, 0, "differs", "a")])


def test_diff_empty_and_repeated(spark):
    assert diff(spark, [], []) == []
    assert diff(spark, [(1, "a", None, 1)] * 3, []) == [(True, 1, "only_left", "")]
    assert diff(spark, [(1, "a", None, 1), (1, "b", None, 1)], [(1, "a", None, 1)]) == [(True, 1, "differs", "a")]


@pytest.mark.parametrize(
    "line, fault, fields",
    [
        ('a,"b,c"', 0, ["a", "b,c"]), ('"a""b"', 0, ['a"b']), ('"""a"""', 0, ['"a"']), ("", 0, [""]), ('""', 0, [""]), ('"', 1, None), ('a"b', 1, None), ('"a"b,c', 1, None), ('"a"" ,b', 1, None),
        ('﻿"a",b\r', 0, ["a", "b"]), ('"a\nb",c\r\n', 0, ["a\nb", "c"]), (",,", 0, ["", "", ""]), (None, 0, []), ('"' + '""' * 50_000 + '"', 0, ['"' * 50_000]),
    ],
)
def test_records(line, fault, fields):
    got, lists = split_records(pa.array(["x", line, '"y"'], pa.string()))
    assert got.tolist() == [0, fault, 0]
    if fields is not None:
        assert lists[1].as_py() == fields
    assert lists[0].as_py() == ["x"] and lists[2].as_py() == ["y"]


def reference(line):
    """One character at a time."""
    fields, cur, state = [], "", "start"
    for ch in line:
        if state == "in":
            state = "closed" if ch == '"' else state
            cur += "" if ch == '"' else ch
        elif state == "closed":
            if ch == '"':
                cur, state = cur + '"', "in"
            elif ch == ",":
                fields, cur, state = [*fields, cur], "", "start"
            else:
                return None
        elif ch == ",":
            fields, cur, state = [*fields, cur], "", "start"
        elif ch == '"':
            if state != "start":
                return None
            state = "in"
        else:
            cur, state = cur + ch, "plain"
    return None if state == "in" else [*fields, cur]


def test_records_like_one_at_a_time():
    import itertools

    lines = ["".join(p) for n in range(7) for p in itertools.product('a",', repeat=n)]
    fault, lists = split_records(pa.array(lines))
    for line, f, got in zip(lines, fault, lists.to_pylist(), strict=True):
        want = reference(line)
        assert (f == 1) == (want is None), line
        assert want is None or want == got, line


def test_load_review(spark):
    lines = [
        ("กข,8,f,g,,,", None), ("กข,8,f,g,ก,ข", "column_count"), ('กข,8,"f,g,,,', "quoting"), ("ab,8,f,g,,,", "value"), ("ก�,8,f,g,,,", "value"), ("กข,21,f,g,,,", "value"), ("กข,๘,f,g,,,", "value"), ("กข,,f,g,,,", "value"),
        ("กขค,08,f,g,ก,ข , ค", None), ("กข,8,f,g,x,,", None), ("กข,8,f,g,X, ,", None), ("กข,8,f,g,x,y,", "value"), ("กขค,8,f,g,ก,ข,ฆ", "value"), ("กขค,8,f,g,ก,ข,", "value"), (None, "column_count"), ("", "column_count"), ("﻿กข,8,f,g,,,\r", None),
    ]
    df = spark.createDataFrame([(i, x, dt.datetime(2020, 1, 1)) for i, (x, _) in enumerate(lines)], "raw_id long, line string, wak timestamp")
    good, bad = load_review(df)
    assert {r.raw_id: r.reason for r in bad.collect()} == {i: w for i, (_, w) in enumerate(lines) if w}
    rows = {r.raw_id: r for r in good.collect()}
    assert set(rows) == {i for i, (_, w) in enumerate(lines) if not w}
    assert (rows[8].wak, rows[8].syllables, rows[8].b) == ("กขค", 8, "ข ")
    none, nothing = load_review(df.where("raw_id < 0"))
    assert none.count() == 0 and nothing.count() == 0
