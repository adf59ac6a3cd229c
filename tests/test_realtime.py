"""Real-time operators on hand-made trips and against brute force."""

import random

from pyspark.sql import functions as F

from tramline.operators import realtime as rt

EV = "trip_id long, place long, seq long, ev_type string, sched long, is_t long, forecast_t long"


def test_repair(spark):
    rnd = random.Random(4)
    rows = [(t, p, p // 2, "DEP" if p % 2 else "ARR", 10 * p, 10 * p + rnd.randint(-20, 20) if rnd.random() < 0.4 else None, None) for t in range(20) for p in range(1, 9)]
    got = {(r.trip_id, r.place): r.repaired for r in rt.repair(spark.createDataFrame(rows, EV).withColumn("resolved", F.coalesce("is_t", "sched"))).collect()}
    for t in range(20):
        mine = [r for r in rows if r[0] == t]
        for r in mine:
            now = r[5] if r[5] is not None else r[4]
            high = min([x[5] for x in mine if x[1] >= r[1] and x[5] is not None], default=1 << 40)
            low = max([x[5] for x in mine if x[1] <= r[1] and x[5] is not None], default=-(1 << 40))
            now = min(now, high)
            now = max(now, low)
            assert got[t, r[1]] == now


def test_flush(spark):
    rows = [(1, 1, 0, "DEP", 0, 10, None), (1, 2, 1, "ARR", 20, None, None), (1, 3, 1, "DEP", 25, None, None), (1, 4, 2, "ARR", 40, None, 43)]
    rows += [(2, 1, 0, "DEP", 0, 30, None), (2, 2, 1, "ARR", 20, 25, None), (3, 1, 0, "DEP", 5, None, None), (3, 2, 1, "ARR", 9, None, None)]
    stops = spark.createDataFrame([(t, s, 100 * t + s) for t in (1, 2, 3) for s in range(3)], "trip_id long, seq long, station_id long")
    got = {(r.trip_id, r.station_id, r.ev_type): (r.updated, r.reason, r.canceled) for r in rt.flush(spark.createDataFrame(rows, EV), stops).collect()}
    # trip 2 arrived before it is said to have departed: the bound from before wins, so it arrives when it departs
    assert got == {
        (1, 100, "DEP"): (10, "IS", False), (1, 101, "ARR"): (30, "PROPAGATION", False), (1, 101, "DEP"): (32, "PROPAGATION", False), (1, 102, "ARR"): (47, "PROPAGATION", False),
        (2, 200, "DEP"): (30, "IS", False), (2, 201, "ARR"): (30, "REPAIR", False),
    }


def test_conflicts_on_edges(spark):
    rows = [(1, 1, 0, 5, "r"), (2, 1, 10, 4, "r"), (3, 1, 20, 20, "r"), (4, 1, 5, 50, "q")]
    got = {r.trip_id: (r.fits_trip, r.fits_edge) for r in rt.conflicts(spark.createDataFrame(rows, "trip_id long, place long, sched long, resolved long, route string"), "route").collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (True, True), 4: (True, True)}


def test_updates_are_published(spark, tmp_path):
    seg = spark.createDataFrame([(1, 0, 7, 8, 10, 20)], "trip_id long, seq long, from_station long, to_station long, dep_min long, arr_min long")
    gone = rt.canceled_updates(rt.cancel(seg, spark.createDataFrame([(1, 1)], "trip_id long, seq long")))
    assert sorted((r.station_id, r.ev_type, r.sched, r.reason, r.canceled) for r in gone.collect()) == [(7, "DEP", 10, "CANCEL", True), (8, "ARR", 20, "CANCEL", True)]
    for _ in range(2):
        rt.publish(gone, str(tmp_path / "u"), 3)
    assert spark.read.json(str(tmp_path / "u")).count() == 2


ADDED = "trip_id long, place long, ev_type string, station_id long, time long"


def test_inserted_trips(spark):
    stops = spark.createDataFrame([(1, 0, 5, 0, 0, True, True)], "trip_id long, seq long, station_id long, arr_min long, dep_min long, in_allowed boolean, out_allowed boolean")
    added = [(10, 1, "DEP", 1, 100), (10, 2, "ARR", 2, 110), (10, 3, "DEP", 2, 112), (10, 4, "ARR", 3, 120)]
    added += [(11, 1, "DEP", 1, 100), (12, 1, "DEP", 1, 100), (12, 2, "DEP", 2, 110), (13, 1, "DEP", 1, 100), (13, 2, "ARR", 2, 90), (14, 1, "DEP", 1, 5), (14, 2, "ARR", 2, 6), (14, 3, "DEP", 9, 7), (14, 4, "ARR", 3, 8), (1, 1, "DEP", 1, 5), (1, 2, "ARR", 2, 6)]
    out, status = rt.insert_trips(stops, spark.createDataFrame(added, ADDED))
    assert {r.trip_id: r.status for r in status.collect()} == {10: "OK", 11: "EVENT_COUNT_MISMATCH", 12: "EVENT_ORDER_MISMATCH", 13: "DECREASING_TIME", 14: "STATION_MISMATCH", 1: "DUPLICATE"}
    assert [(r.seq, r.station_id, r.arr_min, r.dep_min) for r in out.filter("trip_id = 10").orderBy("seq").collect()] == [(0, 1, 100, 100), (1, 2, 110, 112), (2, 3, 120, 120)] and out.count() == 4


def test_reroutes_keep_delays(spark):
    E = "trip_id long, station_id long, ev_type string, sched long, delay long"
    K = "trip_id long, station_id long, ev_type string, sched long"
    chain = lambda t: [(t, 1, "DEP", 10, None), (t, 2, "ARR", 20, 4), (t, 2, "DEP", 22, 4), (t, 3, "ARR", 30, None)]
    events = spark.createDataFrame([*chain(1), *chain(2), *chain(3)], E)
    gone = spark.createDataFrame([(1, 2, "ARR", 20), (1, 2, "DEP", 22), (2, 2, "ARR", 20), (3, 2, "ARR", 20), (3, 2, "DEP", 22)], K)
    none = spark.createDataFrame([], E)
    after, status, stored = rt.reroute_events(events, gone, none, none, spark.createDataFrame([(3,)], "trip_id long"))
    assert {r.trip_id: r.status for r in status.collect()} == {1: "OK", 2: "EVENT_COUNT_MISMATCH", 3: "RULE_SERVICE_REROUTE_NOT_SUPPORTED"}
    assert after.filter("trip_id = 1").count() == 2 and after.filter("trip_id > 1").count() == 8
    assert {(r.station_id, r.ev_type, r.delay) for r in stored.collect()} == {(2, "ARR", 4), (2, "DEP", 4)}
    back = spark.createDataFrame([(1, 2, "ARR", 20, None), (1, 2, "DEP", 22, None)], E)
    again, status, _ = rt.reroute_events(after, none.select(*[c for c in none.columns if c != "delay"]), back, stored)
    assert status.first().status == "OK" and {(r.ev_type, r.delay) for r in again.filter("trip_id = 1 AND station_id = 2").collect()} == {("ARR", 4), ("DEP", 4)}
    moved = spark.createDataFrame([(1, 9, "ARR", 20, None), (1, 8, "DEP", 22, None)], E)
    assert rt.reroute_events(after, none.select(*[c for c in none.columns if c != "delay"]), moved, stored)[1].first().status == "STATION_MISMATCH"


def test_counters(spark):
    m = spark.createDataFrame([(1, "is"), (2, "is"), (3, "cancel")], "msg_id long, kind string")
    done = spark.createDataFrame([(1,), (1,)], "msg_id long")
    u = spark.createDataFrame([("IS",), ("REPAIR",), ("IS",)], "reason string")
    assert {r.counter: r.n for r in rt.counters(m, done, u).collect()} == {"messages_is": 2, "messages_cancel": 1, "unresolved": 2, "updates_is": 2, "updates_repair": 1}


def test_reroutes_over_sections_without_minutes(spark):
    """From 2 to 4 in no time, and a stop of no time at 5."""
    kind = "trip_id long, station_id long, ev_type string, sched long, delay long"
    events = spark.createDataFrame([(1, 9, "DEP", 100, 3), (1, 2, "ARR", 110, 3), (1, 2, "DEP", 112, 3), (1, 3, "ARR", 120, None)], kind)
    deleted = spark.createDataFrame([(1, 3, "ARR", 120)], "trip_id long, station_id long, ev_type string, sched long")
    added = spark.createDataFrame([(1, 4, "ARR", 112, None), (1, 4, "DEP", 115, None), (1, 5, "ARR", 115, None), (1, 5, "DEP", 115, None), (1, 6, "ARR", 130, None)], kind)
    none = spark.createDataFrame([], kind)
    after, status, _ = rt.reroute_events(events, deleted, added, none)
    assert [tuple(r) for r in status.collect()] == [(1, "OK")]
    assert {(r.station_id, r.ev_type, r.sched) for r in after.collect()} == {(9, "DEP", 100), (2, "ARR", 110), (2, "DEP", 112), (4, "ARR", 112), (4, "DEP", 115), (5, "ARR", 115), (5, "DEP", 115), (6, "ARR", 130)}
    broken = added.filter("station_id <> 4 OR ev_type <> 'DEP'")
    assert rt.reroute_events(events, deleted, broken, none)[1].first().status != "OK"
