"""Walks through hubs against the same walks as pairs."""

import pytest
from pyspark.sql import functions as F

from tramline import catalog
from tramline.operators import pareto, query, search
from tramline.plans.timetable import conn_between

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_as_many_rows_as_stations_and_the_same_walks(spark):
    w, pairs = catalog.walks(spark, SF), catalog.footpaths(spark, SF)
    n = w.pairs.count()
    assert w.enter.count() == n and w.leave.count() == n
    at = pairs.select(F.col("a").alias("station")).distinct()
    want = rows(pairs.filter("a <> b").select("a", "b", F.col("dur").cast("long")))
    assert want and rows(search.walks_from(at, w).select("a", "b", "dur")) == want
    assert rows(search.walks_from(at, search.turned(search.turned(w))).select("a", "b", "dur")) == want
    assert rows(search.walks_from(at, search.turned(w)).select("b", "a", "dur")) == want
    asked = at.crossJoin(at.withColumnRenamed("station", "other"))
    for loops in (True, False):
        got, known = (search.walk_between(asked, f, "station", "other", "dur", loops) for f in (w, pairs))
        assert rows(got.fillna(-1)) == rows(known.fillna(-1))


@pytest.mark.parametrize("turn", [False, True])
def test_the_same_labels(spark, turn):
    conn = conn_between(spark, SF, 480, 1920)
    starts = spark.createDataFrame([(1, 480), (3, 700)], "start long, t0 long")
    feet = catalog.walks(spark, SF), catalog.footpaths(spark, SF)
    if turn:
        conn, feet, starts = search.mirrored(conn), [search.turned(f) for f in feet], starts.withColumn("t0", -F.col("t0") - 900)
    one, two = (search.run_rounds(conn, f, starts, 3, start_walks=True) for f in feet)
    assert len(one.labels) == len(two.labels)
    for a, b in zip(one.labels, two.labels, strict=True):
        assert a.count() and rows(a.select(sorted(a.columns))) == rows(b.select(sorted(b.columns)))


@pytest.mark.parametrize("kind", ["price", "wage_price"])
def test_the_same_prices(spark, kind):
    conn = conn_between(spark, SF, 480, 1920).withColumn("fare", F.col("trip_id") % 97 + F.col("seq") * 10)
    for goal in (5,):
        q = query.Query(1, goal, 480, kind_of_search=kind, rounds=2)
        one, two = (query.labels(query.Timetable(conn, f), q) for f in (catalog.walks(spark, SF), catalog.footpaths(spark, SF)))
        assert rows(one) == rows(two)
    starts = spark.createDataFrame([(1, 480)], "start long, t0 long")
    one, two = (pareto.pareto_search(conn, f, starts, pareto.SEARCHES[kind], 2) for f in (catalog.walks(spark, SF), catalog.footpaths(spark, SF)))
    assert rows(one) and rows(one) == rows(two)
