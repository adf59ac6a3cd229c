"""Searches in real time: cancelled sections and updated times against enumeration."""

import random

import pytest
from pyspark.sql import functions as F

from test_search import CONN, LINE, brute, random_timetable
from tramline.operators import pareto, query, realtime, search


def at(spark, conn, foot):
    return query.Timetable(spark.createDataFrame(conn, CONN), spark.createDataFrame(foot, "a long, b long, dur long"))


@pytest.mark.parametrize("seed", range(3))
def test_cancelled_sections_by_enumeration(spark, seed):
    rnd = random.Random(seed)
    conn, foot = random_timetable(rnd)
    gone = {(c[1], c[2]) for c in conn if rnd.random() < 0.25}
    left, piece = [], {}
    for c in sorted(conn):
        piece[c[1]] = piece.get(c[1], 0) + ((c[1], c[2]) in gone)
        if (c[1], c[2]) not in gone:
            left.append((c[0], (c[1], piece[c[1]]), *c[2:]))
    want = {s: min(v.values()) for s, v in brute(left, foot, 0, 480, 4).items()}
    t = at(spark, conn, foot).running(spark.createDataFrame(sorted(gone), "trip_id long, seq long"))
    found = search.run_rounds(t.conn, t.footpaths, spark.createDataFrame([(0, 480)], "start long, t0 long"), 4)
    assert {r.station: r.arr for r in found.arrivals().collect()} == want
    # the multi-criteria search takes the same table
    many = pareto.pareto_search(t.conn, t.footpaths, spark.createDataFrame([(0, 480)], "start long, t0 long"), pareto.SEARCHES["default"], 4)
    got = {}
    for r in many.collect():
        got[r.station] = min(r.arr, got.get(r.station, 1 << 40))
    assert {s: got[s] for s in want} == want


def test_nobody_rides_across_a_cancellation(spark):
    foot = [(i, i, 3) for i in range(1, 9)]
    links = spark.createDataFrame([(4, 0, 5)], "trip_id long, day long, next_trip long")
    table = query.Timetable(spark.createDataFrame(LINE + [(0, 1, 2, 3, 9, 565, 570, True, True, 3)], CONN), spark.createDataFrame(foot, "a long, b long, dur long"), links=links)
    stations = lambda t, start, time: {r.station for r in search.run_rounds(t.conn, t.footpaths, spark.createDataFrame([(start, time)], "start long, t0 long"), 1, links=t.links).arrivals().collect()}
    gone = lambda *rows: spark.createDataFrame(list(rows), "trip_id long, day long, seq long")
    assert stations(table, 1, 480) == {2, 3, 9}
    cut = table.running(gone((1, 0, 1)))
    assert stations(cut, 1, 480) == {2} and stations(cut, 3, 560) == {7, 8, 9}
    assert stations(table.running(gone((1, 1, 1), (None, 0, 1))), 1, 480) == {2, 3, 9}  # another day, no trip
    assert stations(table.running(gone((5, 0, 0))), 3, 560) == {7, 9} and stations(table.running(gone((4, 0, 0))), 3, 560) == {9}
    legs = query.answer(cut, query.Query(3, 9, 500)).withColumn("trip", F.transform("rides", lambda x: realtime.trip_of(x["trip_id"])))
    assert [r.trip for r in legs.collect()] == [[1]]
    back = query.answer(cut, query.Query(1, 9, 700, "pretrip", 700, backward=True, start_walks=False))
    assert back.count() == 0
    many = table.running(gone(*[(1, 0, k) for k in range(3)]))
    assert stations(many, 1, 480) == set()


def test_updated_times(spark):
    table = at(spark, LINE, [(i, i, 3) for i in range(1, 9)])
    updates = spark.createDataFrame([(1, 0, 0, "ARR", 535), (2, 0, 0, "DEP", 539), (2, 0, 0, "ARR", 537), (3, 0, 0, "DEP", None)], "trip_id long, day long, seq long, ev_type string, real long")
    none = spark.createDataFrame([], "trip_id long, seq long")
    t = table.running(none, updates)
    times = {(realtime_trip, r.seq): (r.dep, r.arr) for r in t.conn.withColumn("trip", realtime.trip_of(F.col("trip_id"))).collect() for realtime_trip in [r.trip]}
    assert times[1, 0] == (500, 535) and times[2, 0] == (539, 539) and times[3, 0] == (540, 600)
    arrivals = lambda t: {r.station: r.arr for r in search.run_rounds(t.conn, t.footpaths, spark.createDataFrame([(1, 480)], "start long, t0 long"), 2).arrivals().collect()}
    assert arrivals(table)[4] == 540 and arrivals(t)[4] == 539
    late = table.running(none, spark.createDataFrame([(1, 0, 0, "ARR", 535)], "trip_id long, day long, seq long, ev_type string, real long"))
    assert 4 not in arrivals(late)  # the change at 2 is missed
