"""Packed values and instants: defined results for nulls, ties, repeats, empty tables and clashing columns."""

import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from shoalwork.operators.instants import instants
from shoalwork.operators.joins import small_side_join
from shoalwork.operators.packed import _edges, split_packed

RELAYS = [("ny", "America/New_York", "mdy"), ("be", "Europe/Berlin", "dmy"), ("odd", "Nowhere/Land", "dmy"), ("ny", "America/New_York", "mdy"), (None, "UTC", "mdy")]
NAMES = [("EST", -300), ("Z", 0), ("IST", 330), (None, 5)]


def micros(*a, tz=dt.timezone.utc):
    return round((dt.datetime(*a, tzinfo=tz) - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) / dt.timedelta(microseconds=1))


def run_instants(spark, rows):
    source = spark.createDataFrame(rows, "email_index long, date string, relay string").withColumn("tz", F.lit("clash")).withColumn("_local", F.lit(1))
    got = instants(source, spark.createDataFrame(RELAYS, "relay string, tz string, date_order string"), spark.createDataFrame(NAMES, "abbrev string, offset_minutes int"))
    return sorted(tuple(r) for r in got.collect())


def test_instants(spark):
    ny = ZoneInfo("America/New_York")
    cases = [
        ("Tue, 10 Apr 2007 12:00:00 -0400", None, micros(2007, 4, 10, 16)),
        ("10 Apr 07 12:00 EST", "be", micros(2007, 4, 10, 17)),
        ("2007-04-10 12:00:00 -0500 (IST)", "be", micros(2007, 4, 10, 17)),
        ("2007-04-26T20:59:01,38-05:00", None, micros(2007, 4, 27, 1, 59, 1, 380000)),
        ("11/04/2007 01:30:00", "ny", micros(2007, 11, 4, 1, 30, tz=ny)),  # twice: the first
        ("03/11/2007 02:30:00", "ny", None),  # skipped
        ("03/11/2007 02:30", "be", micros(2007, 11, 3, 1, 30)),
        ("12/31/2007 11:59:59 pm", "ny", micros(2008, 1, 1, 4, 59, 59)),
        ("20070410T120000Z", None, micros(2007, 4, 10, 12)),
        ("Mon Jun  4 15:38:18 EST 2007", None, micros(2007, 6, 4, 20, 38, 18)),
        ("1193759435.409", None, 1193759435409000),
        ("1187624866492", None, 1187624866492000),
        ("1187624866492123456", None, 1187624866492123),
        ("2007-04-10", "be", None), ("2007-02-30 10:00:00", "be", None), ("10 Apr 2007 25:61:00 +0200", "be", None),
        ("10 Apr 2007 10:00:00 XQX", "be", None), ("2007-04-10 10:00:00", None, None), ("2007-04-10 10:00:00", "odd", None),
        ("", "be", None), (None, "be", None), ("x" * 100_000 + "1", "be", None), ("99", "be", None),
    ]
    rows = [(i, d, r) for i, (d, r, _) in enumerate(cases)]
    assert run_instants(spark, [*rows, rows[0]]) == sorted([(i, u) for i, (_, _, u) in enumerate(cases) if u is not None] + [(0, cases[0][2])])


def test_instants_empty(spark):
    assert run_instants(spark, []) == []


def packed(spark, rows):
    source = spark.createDataFrame(rows, "campaign_label string, email_ids string").withColumn("_v", F.lit("clash")).withColumn("pos", F.lit(9))
    return sorted(tuple(r) for r in split_packed(source).collect())


def test_packed(spark):
    fields = {
        "a": """1806, '1,839' ; "1840" | 1841.0\n#1842 and id:1843 + email_1844 / 000001845""",
        "b": "194,203,260,email_225,206", "c": None, "d": " ", "e": "nan", "f": "['1515'\t'1,518']", "g": "n/a | 7 | ? | 7",
        "h": "1827 + 925 & 981", "i": ",;'x',\"\"", "j": "99999999999999999999999, 5",
    }
    got = packed(spark, list(fields.items()))
    by = {k: [v for kk, _, v in got if kk == k] for k in fields}
    assert by["a"] == [1806, 1839, 1840, 1841, 1842, 1843, 1844, 1845]
    assert by["b"] == [194, 203, 260, 225, 206]
    assert by["f"] == [1515, 1518] and by["g"] == [7, 7] and by["h"] == [1827, 925, 981] and by["j"] == [5]
    assert not by["c"] and not by["d"] and not by["e"] and not by["i"]
    assert [p for k, p, _ in got if k == "a"] == list(range(1, 9))


def test_packed_learns_values(spark):
    """A value that the column holds often is kept whole where its parts are unknown."""
    rows = [(f"c{i}", ";".join(['"12,345"', "12345", str(50_000 + i), str(60_001 + i)])) for i in range(60)] + [("x", "12,345")]
    got = packed(spark, rows)
    assert [v for k, _, v in got if k == "x"] == [12345]
    assert _edges("1,234,567")[0] == (0, 1, 1)


def test_packed_empty_and_repeats(spark):
    assert packed(spark, []) == []
    assert packed(spark, [("a", "1;2"), ("a", "1;2")]) == [("a", 1, 1), ("a", 1, 1), ("a", 2, 2), ("a", 2, 2)]


def test_small_side_join_agrees_beyond_its_bound(spark):
    left = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    for how in ("inner", "left"):
        assert sorted(map(tuple, small_side_join(left, right, ["k"], how).collect()), key=str) == sorted(map(tuple, small_side_join(left, right, ["k"], how, max_rows=1).collect()), key=str)
    with pytest.raises(ValueError):
        small_side_join(left, right, ["k"], "outer")
