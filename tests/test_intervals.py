"""The index of intervals against every pair, and its size."""

import random

from pyspark.sql import functions as F

from factledger.operators import intervals

DAY = 86_400_000
W = "k string, from_ms long, until_ms long, n int"


def test_windows_of_any_length(spark):
    r = random.Random(4)
    spans = [0, 1, 65_535, 65_536, 3_600_000, DAY, 3650 * DAY]
    windows = [(r.choice("ab"), f := r.choice([r.randrange(-DAY, DAY), r.randrange(0, 10**12)]), f + r.choice(spans) - 1, i) for i in range(300)]
    windows += [("a", -(2**63), 2**63 - 1, 900), ("a", 5, 4, 901), ("c", 0, 0, 902), ("a", 2**50, 2**60, 903), ("a", None, 5, 904), ("b", -(2**43), 2**43, 905)]
    points = [(r.choice("abd"), w[1] + r.choice([-1, 0, 1, 65_536]), i) for i, w in enumerate(windows[:300])] + [("a", 2**55, 900), ("a", -(2**62), 901), ("a", None, 902), ("a", 4, 903)]
    p = spark.createDataFrame(points, "k string, at long, id int")
    got = intervals.stab(p, spark.createDataFrame(windows, W), ["k"], "at")
    want = sorted((i, n) for k, at, i in points for g, lo, hi, n in windows if k == g and at is not None and lo is not None and lo <= at <= hi)
    assert sorted((x["id"], x["n"]) for x in got.collect()) == want and want


def test_a_window_of_ten_years_is_few_rows(spark):
    rows = spark.createDataFrame([("hour", 1_000_000_007, 1_000_000_007 + 3_600_000), ("year", 77, 365 * DAY), ("ten", 123_456_789, 123_456_789 + 3650 * DAY)], "name string, lo long, hi long")
    n = {r["name"]: r["n"] for r in rows.select("name", F.size(intervals.cover(F.col("lo"), F.col("hi"))).alias("n")).collect()}
    assert n["hour"] <= 12 and n["year"] <= 40 and n["ten"] <= 2 * intervals.LEVELS
    assert rows.select(F.size(intervals.ancestors(F.col("lo"))).alias("n")).first()["n"] == intervals.LEVELS + 1


def test_overlaps_are_counted(spark):
    r = random.Random(9)
    windows = [(r.choice("ab"), f := r.randrange(100), f + r.choice([0, 1, 5, 50]), i) for i in range(60)] + [("a", 9, 3, 99)]
    rows = [(r.choice("abc"), b := r.randrange(100), r.choice([None, b, b + 1, b + 20]), i) for i in range(80)]
    got = intervals.overlaps(spark.createDataFrame(rows, "k string, boundary long, valid_to long, id int"), spark.createDataFrame(windows, W), ["k"], "boundary", "valid_to", "n")
    assert got.columns == ["k", "boundary", "valid_to", "id", "n"]
    want = {i: sum(k == g and lo <= hi and hi >= b and (e is None or lo < e) for g, lo, hi, _ in windows) for k, b, e, i in rows}
    assert {x["id"]: x["n"] for x in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
