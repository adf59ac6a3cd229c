"""Day sets, changes, and events by messages on hand-made rows."""

import datetime

from tramline.operators import realtime, services, timetable


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_day_sets(spark):
    schema = "service_id long, day long"
    a = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (2, 5), (None, 3)], schema)
    b = spark.createDataFrame([(1, 1), (2, 6), (None, 3)], schema)
    both = services.days_in_both(a, b).collect()
    assert {tuple(r) for r in both} == {(1, 1), (None, 3)} and len(both) == 2
    assert rows(services.days_only_in(a, b)) == [(1, 0), (2, 5)]
    assert rows(services.days_in_one(a, b)) == [(1, 0, 1), (2, 5, 1), (2, 6, 2)]
    assert rows(services.days_in_one(a.limit(0), b.filter("day = 6"))) == [(2, 6, 2)]
    runs = spark.createDataFrame([("x", 0), ("x", 2), ("x", 2), ("y", 62)], "t string, day long")
    assert rows(services.day_groups(runs, ["t"])) == [("x", 5), ("y", 1 << 62)]


def test_continuations(spark):
    schema = "trip_id long, station_id long, at long, days long"
    ends = spark.createDataFrame([(1, 7, 100, 3), (2, 7, 109, 4), (3, None, 100, 3)], schema)
    begins = spark.createDataFrame([(1, 7, 105, 3), (4, 7, 105, 2), (5, 7, 110, 3), (6, 8, 105, 3), (7, 7, 109, 12), (8, None, 105, 3)], schema)
    assert rows(services.continuations(ends, begins)) == [(1, 4, 2), (2, 7, 4)]


def test_changes(spark):
    stops = spark.createDataFrame([(1, 0, 5, 10, 11, True, True), (2, 0, 5, 12, 13, True, True), (3, 0, 5, 12, 11, False, True), (4, 0, 6, 0, 13, True, True), (5, 0, 5, 10, 30, True, False)], "trip_id long, seq long, station_id long, arr_min long, dep_min long, in_allowed boolean, out_allowed boolean")
    stations = spark.createDataFrame([(5, 2), (6, 2)], "station_id long, transfer_min long")
    assert rows(timetable.changes(stops, stations, [1, 3])) == [(1, 0, 2, 0, True), (3, 0, 2, 0, False)]


def test_resolve(spark):
    events = spark.createDataFrame([(1, 0, 5, "DEP", 10), (1, 1, 6, "ARR", 20), (1, 1, 6, "DEP", 21), (1, 2, 5, "ARR", 30), (1, 3, 6, "ARR", 40), (2, 0, 5, "DEP", 10)], "trip_id long, seq long, station_id long, ev_type string, sched long")
    asked = spark.createDataFrame(
        [(1, 1, 5, "DEP", 99), (2, 1, 6, "ARR", 40), (3, 1, 6, "ARR", 41), (4, 1, 9, "DEP", 10), (5, None, 5, "DEP", 10), (6, 1, 5, "ARR", None), (7, 1, 6, "ARR", None), (2, 1, 6, "ARR", 40)], "msg_id long, trip_id long, station_id long, ev_type string, sched long"
    )
    assert rows(realtime.resolve(asked, events)) == [(1, 1, 0), (2, 1, 3), (2, 1, 3), (6, 1, 2)]
    assert realtime.resolve(asked, events.limit(0)).count() == 0


def test_outcomes_and_days(spark):
    messages = spark.createDataFrame([(1, 0, "is", 16), (1, 0, "is", 15), (1, 9, "is", 99), (None, 0, "cancel", 3)], "trip_id long, seq long, kind string, delay long")
    stops = spark.createDataFrame([(1, 0), (1, 0), (2, 0)], "trip_id long, seq long")
    assert rows(realtime.outcomes(messages, stops)) == [("cancel", "unresolved", 1), ("is", "late", 1), ("is", "small", 1), ("is", "unresolved", 1)]
    day = lambda d: datetime.date(2024, 1, d)
    at = lambda d, h: datetime.datetime(2024, 1, d, h)
    spans = spark.createDataFrame([(at(1, 9), day(1), day(1)), (at(1, 22), day(1), day(3)), (at(3, 5), day(3), day(3)), (at(4, 1), None, None)], "ts timestamp_ntz, first_day date, last_day date")
    assert rows(realtime.day_spans(spans)) == [(day(1), at(1, 9), at(1, 22)), (day(2), at(1, 22), at(1, 22)), (day(3), at(1, 22), at(3, 5))]


def test_connected_shrinks_chains_and_stars(spark):
    import random

    from tramline.operators import relational

    rnd, n = random.Random(3), 3000
    names = list(range(n))
    rnd.shuffle(names)
    edges = [(1, k, k + 1) for k in range(n)] + [(2, names[k], names[k + 1]) for k in range(n - 1)] + [(3, 7, k) for k in range(8, 900)] + [(4, 5, 5)]
    edges += [(5, *rnd.sample(range(400), 2)) for _ in range(180)]
    top = {(d, x): x for d, a, b in edges for x in (a, b)}
    moved = True
    while moved:
        moved = False
        for d, a, b in [*edges, *reversed(edges)]:
            low = min(top[d, a], top[d, b])
            moved |= top[d, a] != low or top[d, b] != low
            top[d, a] = top[d, b] = low
    got = relational.connected(spark.createDataFrame(edges, "day int, a long, b long"), ["day"])
    assert {(r.day, r.node): r.component for r in got.collect()} == top and got.count() == len(top)
    text = relational.connected(spark.createDataFrame([("x", "y"), ("z", "y"), ("q", "q")], "a string, b string"))
    assert {r.node: r.component for r in text.collect()} == {"x": "x", "y": "x", "z": "x", "q": "q"}
