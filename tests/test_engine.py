"""Engine operators against hand-made cases and DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401
from tramline import catalog
from tramline.functions import scalars
from tramline.operators import realtime, relational, search
from tramline.sources import gtfs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - {"earliest_arrival_k7"}))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "customer supplier part orders lineitem events".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    want = con.sql(catalog.ORACLE[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)

    def norm(rows, names):
        at = [names.index(c) for c in cols]
        return sorted(repr([round(float(r[i]), 6) if isinstance(r[i], float) else r[i] for i in at]) for r in rows)

    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(want.fetchall(), want.columns)


#: Queries that look at every row of a table: the rows of their keys.
EVERY_ROW = {"next_departure_asof": "trip_stop", "prev_arrival_asof": "trip_stop", "repetition_expansion": "trip_stop"}


@pytest.mark.parametrize("name", sorted(EVERY_ROW))
def test_all_rows(spark, name):
    key = ["trip_id", "seq"]
    assert catalog.QUERIES[name](spark, SF).select(*key).distinct().count() == catalog.view(spark, SF, EVERY_ROW[name]).select(*key).distinct().count()


def test_queries_have_rows(spark):
    for name in ("calendar_difference", "calendar_symmetric_difference", "alpha_dominance", "trip_conflicts", "rule_service_components"):
        assert not catalog.QUERIES[name](spark, SF).isEmpty(), name


def test_closure_to_the_fixpoint(spark):
    chain = spark.createDataFrame([(i, i + 1, 3) for i in range(20)] + [(0, 9, 5), (30, 31, 1), (31, 30, 1)], "a long, b long, dur long")
    got = {(r.a, r.b): r.dur for r in relational.closure(chain).collect()}
    assert got[0, 20] == 5 + 11 * 3 and got[1, 20] == 19 * 3 and len(got) == 20 * 21 // 2 + 2
    by_joins = {(r.a, r.b): r.dur for r in relational.closure(chain, in_one_task=3).collect()}
    assert by_joins == got
    sf, best = "/root/testdata/sf0.01", {}
    for r in catalog._closure_edges(spark, sf).collect():
        best[r.a, r.b] = min(r.dur, best.get((r.a, r.b), r.dur))
    at = sorted({x for e in best for x in e})
    for m in at:
        for a in at:
            for b in at:
                if a != b and (a, m) in best and (m, b) in best:
                    best[a, b] = min(best[a, m] + best[m, b], best.get((a, b), 10**9))
    assert {(r.a, r.b): r.dur for r in catalog.QUERIES["footpath_closure"](spark, sf).collect()} == best


def test_profile_skyline(spark):
    import random

    rnd = random.Random(1)
    rows = [(rnd.randrange(3), rnd.randrange(12), rnd.randrange(5), rnd.randrange(8)) for _ in range(300)]
    df = spark.createDataFrame(rows, "k long, arr long, legs int, t0 long")
    want = sorted(r for r in rows if not any(o[0] == r[0] and o[1] <= r[1] and o[2] <= r[2] and o[3] >= r[3] and o != r for o in rows))
    assert sorted(map(tuple, relational.profile_skyline(df, ["k"], "arr", "legs", "t0", 4).collect())) == want
    assert sorted(map(tuple, relational.skyline(df, ["k"], ["arr", "legs"], ["t0"]).collect())) == want


def test_connected(spark):
    edges = spark.createDataFrame([(d, i, i + 1) for d in (1, 2) for i in range(20) if i != 10 * d - 3] + [(3, 5, 5)], "day long, a long, b long")
    got = {(r.day, r.node): r.component for r in relational.connected(edges, ["day"]).collect()}
    assert got == {(d, i): 0 if i <= 10 * d - 3 else 10 * d - 2 for d in (1, 2) for i in range(21)} | {(3, 5): 5}


def test_seven_legs(spark, monkeypatch):
    hops = [(0, k, 0, k, k + 1, 480 + 20 * k, 490 + 20 * k, True, True, 5) for k in range(1, 8)]
    conn = spark.createDataFrame(hops, "day long, trip_id long, seq long, from_station long, to_station long, dep long, arr long, in_allowed boolean, out_allowed boolean, clasz int")
    foot = spark.createDataFrame([(i, i, 3) for i in range(1, 9)], "a long, b long, dur long")
    monkeypatch.setattr(catalog, "conn_between", lambda *_: conn)
    monkeypatch.setattr(catalog, "footpaths", lambda *_: foot)
    rows = {n: {r.station: r for r in catalog.QUERIES[n](spark, SF).collect()} for n in ("no_intercity", "pareto_profile", "single_criterion_weighted")}
    assert rows["no_intercity"][8].arr == 630 and rows["single_criterion_weighted"][8].cost == 150 + 140
    assert (rows["pareto_profile"][8].legs, rows["pareto_profile"][8].arr) == (7, 630)
    back = conn.withColumn("from_station", 9 - F.col("from_station")).withColumn("to_station", 9 - F.col("to_station"))
    turned = back.select("day", "trip_id", "seq", F.col("to_station").alias("from_station"), F.col("from_station").alias("to_station"), (1880 - F.col("arr")).alias("dep"), (1880 - F.col("dep")).alias("arr"), "in_allowed", "out_allowed", "clasz")
    turned = turned.withColumn("from_station", 9 - F.col("from_station")).withColumn("to_station", 9 - F.col("to_station"))
    monkeypatch.setattr(catalog, "conn_between", lambda *_: turned)
    assert {r.station: r.dep for r in catalog.QUERIES["latest_departure_bwd"](spark, SF).collect()}[8] == 1880 - 630


def test_night_minutes(spark):
    cases = [(0, 59, 0), (0, 61, 1), (60, 360, 300), (59, 361, 300), (361, 1501, 1), (0, 1441, 300), (0, 2881, 600), (0, 2941, 601)]
    df = spark.createDataFrame(cases, "a long, b long, want long")
    assert df.filter(scalars.overlap_per_day(F.col("a"), F.col("b"), 60, 360) != F.col("want")).count() == 0


def test_periodic_wait_and_hotel(spark):
    cases = [(100, 200, 0, 100), (100, 200, 150, 0), (100, 200, 300, 1240), (1340, 40, 140, 1200), (1340, 40, 1339, 1)]
    df = spark.createDataFrame(cases, "b long, e long, t long, want long")
    assert df.filter(scalars.periodic_wait(F.col("b"), F.col("e"), F.col("t")) != F.col("want")).count() == 0
    stays = spark.createDataFrame([(1439, 421), (1490, 370), (1510, 360), (420, 1440)], "t long, want long")
    assert stays.filter(scalars.hotel_stay(F.col("t")) != F.col("want")).count() == 0


def test_asof_and_islands(spark):
    left = spark.createDataFrame([("a", 5), ("a", 100), ("b", 3), ("c", 1)], "k string, t long")
    right = spark.createDataFrame([("a", 5), ("a", 70), ("a", 2000), ("b", 1)], "k string, v long")
    got = {(r.k, r.t): r.v_asof for r in relational.asof(left, right, ["k"], "t", "v", bucket=10).collect()}
    assert got == {("a", 5): 5, ("a", 100): 2000, ("b", 3): None, ("c", 1): None}
    back = {(r.k, r.t): r.v_asof for r in relational.asof(left, right, ["k"], "t", "v", backward=True, bucket=10).collect()}
    assert back == {("a", 5): 5, ("a", 100): 70, ("b", 3): 1, ("c", 1): None}
    runs = relational.islands(spark.createDataFrame([("x", i) for i in (1, 2, 3, 7, 9, 10)], "k string, i long"), ["k"], "i")
    assert sorted((r.first, r.last) for r in runs.collect()) == [(1, 3), (7, 7), (9, 10)]


def test_search_by_hand(spark):
    conn = spark.createDataFrame(
        [(0, 1, 0, 1, 2, 500, 520, True, True, 3), (0, 1, 1, 2, 3, 525, 560, True, True, 3), (0, 2, 0, 2, 4, 530, 540, True, True, 3), (0, 3, 0, 2, 4, 521, 530, True, True, 3)],
        "day long, trip_id long, seq long, from_station long, to_station long, dep long, arr long, in_allowed boolean, out_allowed boolean, clasz int",
    )
    foot = spark.createDataFrame([(i, i, 3) for i in (1, 2, 3, 4)], "a long, b long, dur long")
    got = search.earliest_arrival(conn, foot, spark.createDataFrame([(1, 480)], "start long, t0 long"), 2)
    assert {r.station: r.arr for r in got.collect()} == {2: 520, 3: 560, 4: 540}


def test_propagation_keeps_run_time_and_dwell(spark):
    ev = spark.createDataFrame(
        [(1, 1, "DEP", 0, 10, None), (1, 2, "ARR", 20, None, None), (1, 3, "DEP", 25, None, None), (1, 4, "ARR", 40, None, 43)],
        "trip_id long, place long, ev_type string, sched long, is_t long, forecast_t long",
    )
    assert [r.resolved for r in realtime.propagate(ev).orderBy("place").collect()] == [10, 30, 32, 47]


def test_gtfs(spark, tmp_path):
    files = {
        "agency": "agency_id,agency_name,agency_timezone\nA,Line,Europe/Berlin\n",
        "stops": "stop_id,stop_name,stop_lat,stop_lon\nS1,One,1.5,2.5\nS2,Two,1.6,2.6\n",
        "routes": "route_id,agency_id,route_short_name,route_long_name,route_type\nR,A,1,Long,3\n",
        "trips": "route_id,service_id,trip_id,trip_headsign\nR,WE,T,Two\n",
        "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence,pickup_type,drop_off_type\nT,0:06:10,0:06:10,S1,1,0,0\nT,,,S2,2,0,1\n",
        "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nWE,0,0,0,0,0,1,1,20060701,20060731\nWD,1,1,1,1,1,0,0,20060701,20060731\n",
        "calendar_dates": "service_id,date,exception_type\nWD,20060703,2\nWE,20060703,1\n",
        "transfers": "from_stop_id,to_stop_id,transfer_type,min_transfer_time\nS1,S2,2,300\nS2,S1,3,\n",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.txt").write_text(text)
    feed = gtfs.load(spark, str(tmp_path))
    assert [tuple(r) for r in feed["footpath"].collect()] == [("S1", "S2", 5)]
    stops = feed["trip_stop"].orderBy("seq").collect()
    assert (stops[0].arr_min, stops[1].arr_min, stops[1].out_allowed) == (6, None, False)
    days = {(r.service_id, str(r.day)) for r in feed["service_day"].collect()}
    assert ("WE", "2006-07-03") in days and ("WD", "2006-07-03") not in days and ("WE", "2006-07-01") in days and ("WD", "2006-07-31") in days


def test_replay_stream(spark, tmp_path):
    from tramline.streaming.replay import hourly_batches, read_messages, replay

    src = spark.read.parquet(f"{SF}/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    seen = []
    replay(hourly_batches(read_messages(spark, str(tmp_path / "in"), src.schema)), lambda df, _: seen.extend(df.collect()), str(tmp_path / "cp"))
    assert sum(r.n for r in seen) > 0
