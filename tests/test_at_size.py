"""Steps that are linear in their input, against plain forms on odd rows."""

import datetime

from pyspark.sql import functions as F

from tramline import calls, catalog
from tramline.operators import boards, relational, timetable
from tramline.sources import gtfs

SF = "/root/testdata/sf0.01"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_attribute_ranges_hold_no_groups(spark):
    rows = [(1, 0, 7), (1, 1, 7), (1, 1, 7), (1, 3, 7), (1, 4, 8), (1, 5, 7), (2, 0, None), (2, 1, None)]
    df = spark.createDataFrame(rows, "trip_id long, seq long, k long")
    out = timetable.attribute_ranges(df, "k")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, 7, 0, 1), (1, 7, 3, 3), (1, 8, 4, 4), (1, 7, 5, 5), (2, None, 0, 1)], key=repr)
    assert "HashAggregate" not in _plan(out)


def test_service_days_travel_as_arrays(spark):
    cal = spark.createDataFrame([("s", *[1] * 5, 0, 0, "20240101", "20240108"), ("s", *[1] * 7, "20240106", "20240106"), (None, *[1] * 7, "20240101", "20240101")], "service_id string, " + ", ".join(f"{d} int" for d in gtfs.WEEKDAYS) + ", start_date string, end_date string")
    ex = spark.createDataFrame([("s", "20240102", 2), ("s", "20240107", 1), ("n", "20240105", 1), ("n", "20240106", 1), ("n", "20240106", 2), (None, "20240101", 2)], "service_id string, date string, exception_type int")
    out = gtfs.service_days(cal, ex)
    d = lambda k: datetime.date(2024, 1, k)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([("s", d(k)) for k in (1, 3, 4, 5, 6, 7, 8)] + [("n", d(5)), (None, d(1))], key=repr)
    assert "Join" not in _plan(out)


def test_members_of_a_group_are_dealt(spark):
    s = spark.range(50).select(F.col("id").alias("station_id"), F.lit(1).alias("meta_id"))
    out = timetable.equivalents(s)
    assert sorted(map(tuple, out.collect())) == [(a, b) for a in range(50) for b in range(50)]
    assert "_block" in _plan(out)


def test_walked_sections_and_edges(spark):
    s = spark.createDataFrame([(k, k % 2) for k in range(1, 7)], "station_id long, meta_id long")
    g = spark.createDataFrame([(1, 0, 1, 3, 0, 30), (1, 1, 3, 4, 40, 45), (2, 0, 1, 3, 0, 5), (2, 1, 2, 6, 10, 40)], "trip_id long, seq long, from_station long, to_station long, dep_min long, arr_min long")
    pairs = {(a, b): 12 for a in range(1, 7) for b in range(1, 7) if a != b and a % 2 == b % 2}
    assert sorted(map(tuple, calls.footpath_lookup(g, s).collect())) == [(1, 0, 10), (2, 0, 10), (2, 1, 10)]
    out = calls.extra_edge_union(g, s)
    assert {(r.from_station, r.to_station): r.minutes for r in out.collect()} == pairs | {(1, 3): 5, (3, 4): 5}
    assert out.count() == len(pairs) + 1


def test_points_of_a_cell_are_dealt(spark):
    p = spark.range(40).select("id", (50 + F.col("id") / 100).alias("lat"), F.lit(9.0).alias("lng"))
    q = p.select(F.col("id").alias("other"), F.col("lat").alias("plat"), F.col("lng").alias("plng"))
    out = relational.radius_join(p, q, 20.0)
    want = p.crossJoin(q).filter(relational.haversine_km(F.col("lat"), F.col("lng"), F.col("plat"), F.col("plng")) <= 20)
    assert out.count() == want.count() > 40 and "_b" in _plan(out)


def test_names_compared_once(spark):
    s = spark.createDataFrame([(1, "Ulm"), (2, "Ulm"), (3, "Ulms"), (4, "Bonn")], "station_id long, name string")
    q = spark.createDataFrame([(1, "Ulm"), (2, "Ulm"), (3, "Bon")], "query_id long, guess string")
    got = sorted(map(tuple, boards.names_within(s, q).collect()))
    assert got == [(a, b, int(b == 3)) for a in (1, 2) for b in (1, 2, 3)] + [(3, 4, 1)]


def test_closure_by_hubs_equals_closure_by_pairs(spark):
    edges = catalog._closure_edges(spark, SF)
    assert sorted(map(tuple, catalog.footpath_closure(spark, SF).collect())) == sorted(map(tuple, relational.closure(edges).collect()))
    assert catalog.walks(spark, SF).edges().count() < edges.count() * 5
