"""Runs of equal intervals do not depend on the order of rows."""

from tramline.operators import bikes


def test_equal_times_go_by_value(spark):
    rows = [("a", False, 0), ("a", True, 0), ("a", True, 5), ("a", False, 5)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([(t, v, x, x) for t, v, x in order], "terminal string, value boolean, begin long, end long").coalesce(1)
        got = sorted((r.value, r.begin, r.end) for r in bikes.runs(df, ["terminal"], 60).collect())
        assert got == [(False, 0, 0), (False, 5, 5), (True, 0, 0), (True, 5, 5)]
