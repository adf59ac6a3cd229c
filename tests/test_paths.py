"""Paths, bikes and address guesses on hand-made places and against brute force."""

import json
import math
import random

from pyspark.sql import functions as F

from tramline.operators import bikes, boards, paths, services


def km(a, b, r=6371.0):
    x = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * r * math.asin(math.sqrt(x))


STATIONS = [(1, 50.0, 8.0), (2, 50.1, 8.0), (3, 50.1, 8.2), (4, 50.0, 8.2)]
LINE = [(50.0, 8.0), (50.05, 8.0001), (50.1, 8.0), (50.1, 8.1), (50.1, 8.2)]


def points(rows):
    return [{"lat": a, "lng": b} for a, b in rows]


def stations(spark):
    return spark.createDataFrame(STATIONS, "station_id long, lat double, lng double")


def test_lines(spark):
    df = spark.createDataFrame([(1, points(LINE)), (2, points(LINE[:1])), (3, [])], f"line_id long, points {paths.POINTS}")
    got = {r.line_id: r.x for r in df.select("line_id", paths.line_km(F.col("points")).alias("x")).collect()}
    assert abs(got[1] - sum(km(a, b) for a, b in zip(LINE, LINE[1:], strict=False))) < 1e-9 and got[2] == got[3] == 0.0
    cut = df.filter("line_id = 1").select(paths.part_of(F.col("points"), F.lit(3), F.lit(1)).alias("x")).first().x
    assert [(p.lat, p.lng) for p in cut] == LINE[3:0:-1]
    short = {r.line_id: [(p.lat, p.lng) for p in r.points] for r in paths.simplify(df, 5).collect()}
    assert short[1] == [LINE[0], LINE[2], LINE[4]] or short[1] == [LINE[0], LINE[4]]
    assert len(next(r for r in paths.simplify(df, 18).collect() if r.line_id == 1).points) == 4
    north = spark.range(1).select(paths.bearing(F.lit(50.0), F.lit(8.0), F.lit(51.0), F.lit(8.0)).alias("a"), paths.bearing(F.lit(0.0), F.lit(8.0), F.lit(0.0), F.lit(7.0)).alias("b")).first()
    assert abs(north.a) < 1e-9 and abs(north.b - 270) < 1e-9
    feature = json.loads(paths.geojson(df.filter("line_id = 1"), ["line_id"]).first().feature)
    assert feature["geometry"]["coordinates"][0] == [8.0, 50.0] and feature["properties"] == {"line_id": 1}


def test_lookup_and_statistics(spark):
    stored = spark.createDataFrame([([1, 2, 3], 4, 0, points(LINE[:3]))], f"stations array<long>, clasz int, segment int, points {paths.POINTS}")
    trips = spark.createDataFrame([(7, [1, 2, 3], 4), (8, [1, 2], 4), (9, [1], 4)], "trip_id long, stations array<long>, clasz int")
    got = {(r.trip_id, r.segment): [(p.lat, p.lng) for p in r.points] for r in paths.trip_paths(trips, stored, stations(spark)).collect()}
    assert got == {(7, 0): LINE[:3], (7, 1): [(50.1, 8.0), (50.1, 8.2)], (8, 0): [(50.0, 8.0), (50.1, 8.0)]}
    box = paths.boxes(stored).first()
    assert (box.a, box.b, box.min_lat, box.max_lng) == (1, 2, 50.0, 8.0001)
    s = paths.statistics(stored, stations(spark)).first()
    assert (s.n_sequences, s.n_segments, s.n_points, s.stubs, s.detours) == (1, 1, 3, 0.0, 0.0)
    assert paths.differences(stored, stored).count() == 0 and paths.differences(stored, stored.limit(0)).first().side == 1
    sequences = spark.createDataFrame([([1, 2, 3], [4, 5]), ([1, 4], [5])], "stations array<long>, classes array<int>")
    ids = lambda **o: sorted(tuple(r.stations) for r in paths.filter_sequences(sequences, **o).collect())
    assert ids(station=4) == [(1, 4)] and ids(exact=[1, 2, 3]) == [(1, 2, 3)] and ids(drop_classes=[5]) == [(1, 2, 3)] and ids(limit=1) == [(1, 2, 3)]
    assert ids(polygon=[(49.9, 7.9), (50.05, 7.9), (50.05, 8.3), (49.9, 8.3)], stations=stations(spark)) == [(1, 4)]


def test_routing(spark):
    lines = spark.createDataFrame([(1, points(LINE))], f"line_id long, points {paths.POINTS}")
    near = paths.near_lines(stations(spark), lines)
    assert {(r.station_id, r.point) for r in near.collect()} == {(1, 0), (2, 2), (3, 4)}
    edges = {(r.from_station, r.to_station): r for r in paths.relation_edges(near, lines).collect()}
    assert len(edges) == 6 and abs(edges[3, 1].cost - 0.1 * sum(km(a, b) for a, b in zip(LINE, LINE[1:], strict=False))) < 1e-9
    stub = paths.stub_edges(spark.createDataFrame([(1, 4)], "from_station long, to_station long"), stations(spark)).first()
    assert abs(stub.cost - 5 * km((50.0, 8.0), (50.0, 8.2))) < 1e-9


def test_prepare_by_enumeration(spark):
    import itertools

    rnd = random.Random(7)
    nodes = {s: [10 * s + k for k in range(3)] for s in range(4)}
    cost = {n: rnd.randint(0, 5) for ns in nodes.values() for n in ns}
    edge = {(a, b): rnd.randint(1, 20) for s, t in itertools.permutations(nodes, 2) for a in nodes[s] for b in nodes[t]}
    seqs = {1: [0, 1, 2, 3], 2: [3, 1], 3: [2, 0, 1]}
    rows = [(q, k, a, b) for q, s in seqs.items() for k, (a, b) in enumerate(zip(s, s[1:], strict=False))]
    got = {}
    out = paths.prepare(
        spark.createDataFrame(rows, "sequence_id long, segment int, from_station long, to_station long"),
        spark.createDataFrame([(s, n, float(cost[n])) for s, ns in nodes.items() for n in ns], "station_id long, node long, cost double"),
        spark.createDataFrame([(a, b, float(c)) for (a, b), c in edge.items()], "from_node long, to_node long, cost double"),
    )
    for r in out.collect():
        got.setdefault(r.sequence_id, {})[r.segment] = (r.from_node, r.to_node)
    for q, s in seqs.items():
        price = lambda way: sum(cost[n] for n in way) + sum(edge[x] for x in zip(way, way[1:], strict=False))
        best = min(price(w) for w in itertools.product(*[nodes[x] for x in s]))
        way = [got[q][0][0]] + [got[q][k][1] for k in range(len(s) - 1)]
        assert price(way) == best and all(got[q][k][1] == got[q][k + 1][0] for k in range(len(s) - 2))


def test_ways_and_places(spark):
    ways = spark.createDataFrame([(1, [10, 11, 12, 13]), (2, [12, 20, 21]), (3, [30, 31])], "way_id long, nodes array<long>")
    assert sorted(tuple(r.nodes) for r in paths.contract_ways(ways).collect()) == [(10, 11, 12), (12, 13), (12, 20, 21), (30, 31)]
    stops = spark.createDataFrame([(50.0003, 8.0), (50.1, 8.2)], "lat double, lng double")
    near = paths.bus_stops(stops, stations(spark).unionByName(spark.createDataFrame([(8000001, 50.1, 8.2)], "station_id long, lat double, lng double")).filter("station_id <> 3"))
    assert [(r.station_id, r.lat) for r in near.collect()] == [(1, 50.0003)]
    region = spark.createDataFrame([(1, "Land", 4), (1, "Town", 8), (2, "Land", 4)], "place_id long, name string, admin_level int")
    assert {r.place_id: r.regions for r in paths.regions(region).collect()} == {1: ["Town", "Land"], 2: ["Land"]}
    places = spark.createDataFrame([(1, "Main Street", 5), (2, "Mainz", 9), (3, "Ma", 1), (4, "Other", 7)], "place_id long, name string, weight int")
    typed = spark.createDataFrame([(1, "ma"), (2, "MAIN"), (3, "mainz"), (4, "x")], "query_id long, text string")
    got = {}
    for r in paths.address_guesses(places, typed, 2).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.place_id)
    assert got == {1: [2, 1], 2: [2, 1], 3: [2]}


def test_boards(spark):
    rows = spark.createDataFrame([(1, "DEP", t, t, 0, 0) for t in (90, 95, 100, 104, 120)], "station_id long, ev_type string, time long, trip_id long, day long, seq long")
    times = lambda **o: [r.time for r in boards.board(rows, 100, 2, **o).orderBy("place").collect()]
    assert times() == [100, 104] and times(direction=boards.LATER) == [104, 120] and times(direction=boards.EARLIER) == [95, 90]
    late = boards.with_delays(rows, spark.createDataFrame([(90, 0, 0, "DEP", 101)], "trip_id long, day long, seq long, ev_type string, real long"))
    assert sorted((r.scheduled, r.time) for r in late.collect())[0] == (90, 101)
    conn = spark.createDataFrame([(0, 1, 0, 1, 2, 100, 120, 5), (0, 2, 0, 3, 4, 100, 140, 2)], "day long, trip_id long, seq long, from_station long, to_station long, dep long, arr long, clasz int")
    box = boards.trains_in_box(conn, stations(spark), 49.9, 50.2, 7.9, 8.3, 90, 130, limit=1)
    assert [r.trip_id for r in box.collect()] == [2] and boards.trains_in_box(conn, stations(spark), 49.9, 50.2, 8.1, 8.3, 90, 130, most_class=2).count() == 1
    at = boards.positions(boards.trains_in_box(conn, stations(spark), 49.9, 50.2, 7.9, 7.99 + 0.02, 90, 130), 110).first()
    assert abs(at.lat - 50.05) < 1e-9
    names = stations(spark).select("station_id", F.concat(F.lit("Station "), "station_id").alias("name"))
    edits = boards.names_within(names, spark.createDataFrame([(1, "Station 1"), (2, "Staton 2"), (3, "Station x"), (4, "tation"), (5, "Station 22")], "query_id long, guess string"))
    got = {(r.query_id, r.station_id): r.distance for r in edits.collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 1, (1, 4): 1, (2, 2): 1, (3, 1): 1, (3, 2): 1, (3, 3): 1, (3, 4): 1, (5, 2): 1}


def test_bikes(spark, tmp_path):
    snaps = [("a", f"2024-07-07 {h:02d}:10:00", n, 50.0, 8.0, "A") for h, n in ((21, 3), (22, 7), (22, 5), (23, 1))] + [("b", "2024-01-07 22:30:00", 9, 50.01, 8.0, "B"), ("a", "2024-07-08 03:00:00", 4, 50.0, 8.0, "A2")]
    s = spark.createDataFrame(snaps, "terminal string, ts string, bikes int, lat double, lng double, name string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {(r.terminal, r.bucket): r for r in bikes.hourly_availability(s).collect()}
    # 22:10 UTC on a Sunday in July is ten past midnight on Monday in Berlin; in January it is 23 o'clock on Sunday
    assert set(got) == {("a", 23), ("a", 24), ("a", 25), ("b", 23), ("a", 29)}
    assert (got["a", 24].average, got["a", 24].median, got["a", 24].minimum, got["a", 24].percent_reliable) == (6.0, 5, 5, 1.0)
    bikes.store(s, str(tmp_path / "b"))
    terminals, hours = bikes.load(spark, str(tmp_path / "b"))
    assert {r.terminal: r.name for r in terminals.collect()} == {"a": "A2", "b": "B"} and hours.count() == 5
    near = {r.terminal: r.value for r in bikes.near(terminals, hours, 50.0, 8.0, 2000.0, 24, "median").collect()}
    assert near == {"a": 5.0, "b": 0.0}
    places = spark.createDataFrame([(1, 50.0105, 8.0), (2, 50.0005, 8.0)], "station_id long, lat double, lng double")
    point = spark.createDataFrame([("home", 50.0002, 8.0)], "point string, lat double, lng double")
    begin = 1720389600 + 120  # 22:02 UTC on 7 July 2024
    offers = bikes.search(terminals, places, hours, point, begin, begin + 3600)
    one = sorted((r.station_id, r.from_terminal, r.to_terminal, r.begin, r.value) for r in offers.collect())
    assert one == [(1, "a", "b", 1720389600, 6.0), (1, "a", "b", 1720393200, 1.0)]
    back = bikes.search(terminals, places, hours, point, begin, begin + 3600, arrivals=True)
    assert {(r.from_terminal, r.to_terminal) for r in back.collect()} == {("b", "a")} and back.count() == 26
    kept = bikes.reliable(offers).collect()
    assert [(r.value, r.begin, r.end) for r in kept] == [(6, 1720389600, 1720393200)]
    runs = spark.createDataFrame([("t", 1, 0, 10), ("t", 1, 60, 80), ("t", 1, 141, 150), ("t", 2, 150, 160)], "k string, value int, begin long, end long")
    assert sorted(tuple(r)[1:] for r in bikes.runs(runs, ["k"]).collect()) == [(1, 0, 80), (1, 141, 150), (2, 150, 160)]
    edges = bikes.extra_edges(bikes.reliable(offers)).first()
    assert (edges.a, edges.b, edges.open_from, edges.open_to) == ("home", 1, 22 * 60, 23 * 60 - 1)


def test_rule_services(spark):
    stops = spark.createDataFrame(
        [(1, 0, 10, 5, "A", False, 0, 0), (1, 1, 11, 5, "A", True, 9, 9), (2, 0, 11, 6, "B", False, 10, 10), (2, 1, 12, 6, "B", True, 20, 20), (3, 0, 12, 7, "C", False, 30, 30), (3, 1, 13, 7, "C", True, 40, 40)],
        "service long, seq long, eva long, train_nr long, admin string, last boolean, arr_min long, dep_min long",
    )
    days = spark.createDataFrame([(1, d) for d in (0, 1, 2)] + [(2, d) for d in (1, 2, 3)] + [(3, 2)], "service long, day long")
    rules = spark.createDataFrame([(1, 11, 5, "A", 6, "B", d) for d in range(4)] + [(2, 12, 6, "B", 7, "C", d) for d in range(4)], "rule long, eva long, number_1 long, admin_1 string, number_2 long, admin_2 string, day long")
    pairs = services.through_pairs(stops, days, rules)
    assert {(r.service_1, r.service_2, r.day) for r in pairs.collect()} == {(1, 2, 1), (1, 2, 2), (2, 3, 2)}
    groups, left = services.rule_services(pairs, days)
    assert sorted((r.services, r.rules, r.days) for r in groups.collect()) == [([1, 2], [1], [1]), ([1, 2, 3], [1, 2], [2])]
    assert {(r.service, r.day) for r in left.collect()} == {(1, 0), (2, 3)}
    links = services.trip_links(pairs, spark.createDataFrame([(s, 100 + s) for s in (1, 2, 3)], "service long, trip_id long"))
    assert {tuple(r) for r in links.collect()} == {(101, 1, 102), (101, 2, 102), (102, 2, 103)}
    joint = stops.unionByName(stops.filter("service = 1").withColumn("service", F.lit(9).cast("long")).withColumn("train_nr", F.lit(8).cast("long")))
    split = spark.createDataFrame([(5, 10, 11, 5, "A", 8, "A", 1)], "rule long, eva_begin long, eva_end long, number_1 long, admin_1 string, number_2 long, admin_2 string, day long")
    found = services.merge_split_pairs(joint, days.unionByName(spark.createDataFrame([(9, 1)], "service long, day long")), split)
    assert [(r.service_1, r.service_2, r.day) for r in found.collect()] == [(1, 9, 1)]


def test_section_ranges(spark):
    stops = spark.createDataFrame([(1, 0, 10, None, 0), (1, 1, 11, 5, 6), (1, 2, 10, 9, 10), (1, 3, 12, 20, None)], "service long, seq long, eva long, arr_min long, dep_min long")
    asked = spark.createDataFrame(
        [(1, "all", None, None, None, None, None, None), (1, "eva", 10, None, None, 12, None, None), (1, "nth", 10, 2, None, 12, None, None), (1, "time", 10, None, 10, 12, None, 20), (1, "index", None, 1, None, None, 3, None), (1, "none", 99, None, None, 12, None, None)],
        "service long, key string, from_eva long, from_index long, from_time long, to_eva long, to_index long, to_time long",
    )
    assert {r.key: (r.first, r.last) for r in services.ranges(stops, asked).collect()} == {"all": (0, 3), "eva": (0, 3), "nth": (2, 3), "time": (2, 3), "index": (1, 3)}
