"""Small helpers on hand-made rows, and the dispatch of search types."""

import pytest
from pyspark.sql import functions as F

from tramline.functions import scalars
from tramline.operators import query, timetable

CONN = "day long, trip_id long, seq long, from_station long, to_station long, dep long, arr long, in_allowed boolean, out_allowed boolean, clasz int, fare long, regional long"


def values(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_rounding_and_station_numbers(spark):
    n = lambda x: F.lit(x).cast("long")
    got = values(spark, scalars.floor_to(n(29), 15), scalars.floor_to(n(-1), 15), scalars.floor_to(n(30), 15), scalars.ceil_to(n(31), 15), scalars.padded_eva(n(80)), scalars.padded_eva(n(8000105)))
    assert tuple(got) == (15, -15, 30, 45, "0000080", "8000105")


def test_day_sets(spark):
    days = lambda *d: F.array(*(F.lit(x).cast("long") for x in d)).cast("array<bigint>")
    got = values(spark, scalars.bits_of(days(0, 2, 3)), scalars.bits_of(days()), scalars.shifted_days(days(0, 1, 5), F.lit(-1)), scalars.shifted_days(days(0, 1), F.lit(2)))
    assert tuple(got) == ("1011", "0", [0, 4], [2, 3])


def test_days_stations_and_dimensions(spark):
    conn = spark.createDataFrame([(d, 1) for d in range(5)], "day long, trip_id long")
    assert {r.day for r in timetable.loaded_between(conn, 1, 3).collect()} == {1, 2}
    stations = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, "C")], "station_id long, name string")
    counts = spark.createDataFrame([(1, 0), (2, 4), (2, 0), (3, 1)], "station_id long, n long")
    assert {tuple(r) for r in timetable.active(stations, counts).collect()} == {("A", 2), ("B", 3)}
    segments = spark.createDataFrame([(1, 0), (1, 1)], "trip_id long, seq long")
    info = spark.createDataFrame([(1, 0, 5, 7)], "trip_id long, seq long, category_id long, provider_id long")
    rows = timetable.with_dimensions(segments, info, spark.createDataFrame([(5, "RE")], "category_id long, category string"), spark.createDataFrame([(7, "P")], "provider_id long, provider string"))
    assert {(r.seq, r.category, r.provider) for r in rows.collect()} == {(0, "RE", "P"), (1, None, None)}


def test_search_types(spark):
    rows = [(0, 1, 0, 1, 2, 500, 540, True, True, 1, 900, 0), (0, 2, 0, 1, 2, 505, 580, True, True, 5, 200, 100), (0, 3, 0, 1, 2, 1390, 1400, True, True, 5, 100, 0)]
    t = query.Timetable(spark.createDataFrame(rows, CONN), spark.createDataFrame([(1, 1, 2), (2, 2, 2)], "a long, b long, dur long"))
    ask = lambda name, **more: query.call("/search/types", t, query.Query(1, 2, 490, kind_of_search=name, rounds=1, **more)).collect()
    assert {(r.arr, r.price) for r in ask("price")} == {(540, 900), (580, 200), (1400, 100)}
    assert {(r.arr, r.price) for r in ask("no_intercity_price")} == {(580, 200), (1400, 100)}
    assert {(r.arr, r.wage_price) for r in ask("wage_price")} == {(540, 1300), (580, 920)}
    assert {(r.arr, r.regional_price) for r in ask("regional_price")} == {(540, 1300), (580, 1020)}
    assert {(r.arr, r.price, r.night) for r in ask("late_connections")} == {(540, 900, 0), (580, 200, 0), (1400, 100, 20)}
    both = ask("price", kind="pretrip", until=600)
    assert {(r.t0, r.arr) for r in both} == {(500, 540), (500, 580), (500, 1400), (505, 580), (505, 1400)}
    for bad in (query.Query(1, 2, 490, kind_of_search="other"), query.Query(1, 2, 490, kind_of_search="price", backward=True)):
        with pytest.raises(ValueError):
            query.labels(t, bad)
    with pytest.raises(ValueError):
        query.labels(query.Timetable(t.conn.drop("fare"), t.footpaths), query.Query(1, 2, 490, kind_of_search="price"))
