"""Connection graphs on a timetable small enough to follow by hand."""

import pytest
from pyspark.sql import functions as F

from tramline.operators import connection_graph as cg
from tramline.operators import query

CONN = "trip_id long, day long, seq long, from_station long, to_station long, dep long, arr long, in_allowed boolean, out_allowed boolean, clasz long, fare long"
#: Gained minutes by trip; other trips are on time.
GAINED = {10: {0: 0.5, 3: 0.3, 15: 0.15, 50: 0.05}, 30: {0: 0.5, 6: 0.5}}
TRIPS = [(10, 1, 2, 100, 120), (20, 2, 3, 125, 150), (21, 2, 3, 135, 160), (30, 2, 4, 155, 165), (40, 4, 3, 172, 185), (41, 4, 3, 190, 200)]


@pytest.fixture(scope="module")
def table(spark):
    conn = spark.createDataFrame([(t, 0, 0, a, b, d, r, True, True, 5, 100) for t, a, b, d, r in TRIPS], CONN)
    feet = spark.createDataFrame([(1, 1, 5), (2, 2, 5), (3, 3, 5), (4, 4, 4), (2, 3, 70)], "a long, b long, dur long")
    return query.Timetable(conn, feet)


@pytest.fixture(scope="module")
def delays(spark):
    gained = spark.createDataFrame([(t, m, p) for t, d in GAINED.items() for m, p in d.items()], "trip_id long, minute long, p double")

    def travel(rides):
        return rides.join(gained, "trip_id").select("key", F.lit(0).cast("long").alias("delay"), "minute", "p")

    return cg.Delays(lambda rides: rides.select("key", F.lit(0).cast("long").alias("minute"), F.lit(1.0).alias("p")), travel)


ASK = query.Query(1, 3, 100, rounds=2)


def arrivals(graphs):
    return {(r.graph, r.minute): pytest.approx(r.p) for r in graphs.arrivals().collect()}


def test_reliable_search(table, delays):
    g = cg.route("reliable_search", table, ASK, delays)
    walk, train = "1/100/3/0", "1/100/3/1"
    assert arrivals(g) == {(train, 150): 0.5, (train, 160): 0.3, (train, 185): 0.075, (train, 200): 0.075, (train, 240): 0.05} | {(walk, 190 + m): p for m, p in GAINED[10].items()}
    parts = {(r.stop, r.alternative): (r.trip_id, r.next_stop, r.leaves) for r in g.parts.filter(F.col("graph") == train).collect()}
    stop, inner = "departure/1.1", "departure/1.1/3.1"
    assert parts == {
        ("departure", 1): (10, stop, 100), (stop, 1): (20, "arrival", 125), (stop, 2): (21, "arrival", 135), (stop, 3): (30, inner, 155),
        (inner, 1): (40, "arrival", 172), (inner, 2): (41, "arrival", 190), (stop, 4): (None, "arrival", 156),
    }
    assert g.searched == g.asked == 4
    assert [r.uncovered for r in g.stops.collect()] == [[], []]
    rides = cg.elements(g.parts, table.conn).filter(F.col("graph") == train)
    assert sorted(r.trip_id for r in rides.collect()) == [10, 20, 21, 30, 40, 41]


def test_tree_and_repeated_questions(table, delays):
    g = cg.route("connection_tree", table, ASK, delays, alternatives=3)
    train = g.parts.filter("graph = '1/100/3/1'")
    assert {r.stop: r.n for r in train.groupBy("stop").agg(F.count(F.lit(1)).alias("n")).collect()} == {"departure": 1, "departure/1.1": 3, "departure/1.1/3.1": 2}
    closed = {r.stop: r.closed for r in g.stops.collect()}
    assert closed == {"departure/1.1": False, "departure/1.1/3.1": True}  # no third train from there
    twice = cg.graphs_of(query.answer(table, ASK)).filter("transfers = 1")
    twice = twice.unionByName(twice.withColumn("graph", F.lit("again")))
    both = cg.connection_graphs(table, twice, delays, cg.tree(2), rounds=2)
    assert both.asked == 2 * both.searched  # answers are kept
    assert {k[1]: v for k, v in arrivals(both).items() if k[0] == "again"} == {k[1]: v for k, v in arrivals(both).items() if k[0] != "again"}


def test_trains_that_wait(spark, table, delays):
    def waiting(pairs):
        return pairs.select("key", F.when((F.col("feeder_trip") == 10) & (F.col("trip_id") == 20), 3).otherwise(0).alias("wait"))

    g = cg.route("reliable_search", table, ASK, cg.Delays(delays.start, delays.travel, waiting))
    got = {k[1]: v for k, v in arrivals(g).items() if k[0].endswith("/1")}
    # the next train, at 135, takes nobody: who is 15 minutes late misses it
    assert got == {150: 0.5, 153: 0.3, 185: 0.075, 200: 0.075, 240: 0.05}


def test_rating_and_dispatch(spark, table, delays):
    got = {r.graph: (r.rating, r.arrives) for r in cg.route("rating", table, ASK, delays).collect()}
    assert got == {"1/100/3/0": (pytest.approx(0.995), pytest.approx(1.0)), "1/100/3/1": (pytest.approx(0.995**2 * 0.5), pytest.approx(0.5))}
    late = cg.route("late_connection", table, ASK, fares=table.conn).collect()
    assert {(r.arr, r.price) for r in late} == {(150, 200), (190, 100)}
    with pytest.raises(ValueError):
        cg.route("other", table, ASK, delays)
    with pytest.raises(ValueError):
        cg.connection_graphs(table, cg.graphs_of(query.answer(table, ASK)), delays, later=0)
    assert query.OPERATIONS["/reliability/route"] is cg.route


def test_no_journeys(table, delays):
    g = cg.connection_graphs(table, cg.graphs_of(query.answer(table, query.Query(3, 1, 100, rounds=2))), delays)
    assert g.parts.count() == g.stops.count() == g.arrivals().count() == 0
