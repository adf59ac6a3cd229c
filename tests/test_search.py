"""Journeys, queries, multi-criteria search and intermodal search against hand-made timetables and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tramline.functions import scalars
from tramline.operators import pareto, query, relational, search, timetable

CONN = "day long, trip_id long, seq long, from_station long, to_station long, dep long, arr long, in_allowed boolean, out_allowed boolean, clasz int"
#: Times of a day in minutes; trip 1: 1-2-3, trip 2: 2-4, trip 3: 5-6 (5 is a walk from 2), trip 4: 3-7 goes on as trip 5: 7-8.
LINE = [
    (0, 1, 0, 1, 2, 500, 520, True, True, 3), (0, 1, 1, 2, 3, 525, 560, True, True, 3), (0, 2, 0, 2, 4, 530, 540, True, True, 3),
    (0, 3, 0, 5, 6, 540, 600, True, True, 5), (0, 4, 0, 3, 7, 563, 580, True, True, 5), (0, 5, 0, 7, 8, 580, 590, True, True, 5),
]


@pytest.fixture(scope="module")
def line(spark):
    foot = [(i, i, 3) for i in range(1, 9)] + [(2, 5, 10), (5, 2, 10), (4, 6, 30)]
    return spark.createDataFrame(LINE, CONN), spark.createDataFrame(foot, "a long, b long, dur long")


def starts(spark, *rows):
    return spark.createDataFrame(list(rows), "start long, t0 long")


def goals(spark, *rows):
    return spark.createDataFrame([(g,) for g in rows], "goal long")


def brute(conn, foot, start, t0, rounds):
    """{station: {trips: earliest arrival}} by enumeration of all rides."""
    ready, out = {start: t0}, {}
    for k in range(1, rounds + 1):
        arrived = {}
        for s, at in ready.items():
            for c in conn:
                if c[3] == s and c[7] and at <= c[5] <= t0 + 1440:
                    for d in conn:
                        if d[:2] == c[:2] and d[2] >= c[2] and d[8] and d[6] <= t0 + 1440:
                            arrived[d[4]] = min(d[6], arrived.get(d[4], 1 << 40))
        for s, at in arrived.items():
            for a, b, dur in foot:
                if a == s:
                    ready[b] = min(at + dur, ready.get(b, 1 << 40))
                    come = at if a == b else at + dur
                    out.setdefault(b, {})[k] = min(come, out.get(b, {}).get(k, 1 << 40))
    return out


def test_arrivals_on_foot_and_journeys(spark, line):
    conn, foot = line
    found = search.run_rounds(conn, foot, starts(spark, (1, 480)), 7)
    assert {r.station: r.arr for r in found.arrivals().collect()} == {2: 520, 3: 560, 4: 540, 5: 530, 6: 570, 7: 580}
    legs = search.journey_legs(found, goals(spark, 6, 4, 3))
    by = {(r.goal, r.legs, r.leg): r for r in legs.collect()}
    one = by[4, 2, 2]
    assert (one.trip_id, one.enter_station, one.exit_station, one.dep, one.arr) == (2, 2, 4, 530, 540)
    assert (by[4, 2, 1].trip_id, by[4, 2, 1].enter, by[4, 2, 1].exit) == (1, 0, 0)
    assert (by[6, 2, 2].exit_station, by[6, 2, 2].walk_to, by[6, 2, 2].walk_arr) == (4, 6, 570)  # on foot from 4, sooner than by train
    made = search.journeys(legs)
    j = {r.goal: r for r in made.collect()}
    assert (j[3].departure, j[3].arrival, j[3].transfers, j[3].duration) == (500, 560, 0, 60)
    assert sorted(map(tuple, search.legs_of(made).collect())) == sorted(map(tuple, legs.select(*search.legs_of(made).columns).collect()))
    assert search.sane(made).count() == made.count()
    assert all(r.valid for r in search.check_interchanges(legs, foot).collect())
    late = legs.withColumn("dep", F.when((F.col("goal") == 4) & (F.col("leg") == 2), 521).otherwise(F.col("dep")))
    assert {r.goal for r in search.check_interchanges(late, foot).collect() if not r.valid} == {4}
    stops = search.journey_stops(legs.filter("goal = 3"), conn).orderBy("seq").collect()
    assert [(s.station, s.arr, s.dep) for s in stops] == [(1, None, 500), (2, 520, 525), (3, 560, None)]
    parts = search.split_at(made.filter("goal = 4"), F.lit(1)).first()
    assert len(parts.before) == 1 and parts.after[0].trip_id == 2


def test_through_trips_and_trains(spark, line):
    conn, foot = line
    links = spark.createDataFrame([(4, 0, 5)], "trip_id long, day long, next_trip long")
    plain = search.run_rounds(conn, foot, starts(spark, (3, 550)), 7).arrivals()
    seated = search.run_rounds(conn, foot, starts(spark, (3, 550)), 7, links=links).arrivals()
    assert {r.station: r.arr for r in plain.collect()} == {7: 580} and {r.station: r.arr for r in seated.collect()} == {7: 580, 8: 590}
    t = query.Timetable(conn, foot)
    on = query.answer(t, query.Query(None, 4, 505, "ontrip_train", train=(1, 0, 0))).collect()
    assert [(r.arrival, r.transfers) for r in on] == [(540, 1)]
    assert {(r.trip_id, r.reached) for r in timetable.reached_trips(links, spark.createDataFrame([(4,), (5,)], "trip_id long"), "forward").collect()} == {(4, 4), (4, 5), (5, 5)}


def test_queries(spark, line):
    conn, foot = line
    t = query.Timetable(conn, foot, spark.createDataFrame([(4, 4), (4, 6)], "station_id long, equivalent long"))
    ask = lambda **o: query.answer(t, query.Query(**{"start": 1, "goal": 4, "time": 480} | o)).collect()
    assert [(r.departure, r.arrival, r.transfers) for r in ask()] == [(500, 540, 1)]
    assert [(r.departure, r.arrival) for r in ask(kind="pretrip", until=510)] == [(500, 540)]
    assert ask(kind="pretrip", time=501, until=510) == []
    assert [(r.departure, r.arrival) for r in ask(kind="pretrip", time=520, until=521, least=1, earlier=True)] == [(500, 540)]
    back = ask(backward=True, time=545)
    assert [(r.departure, r.arrival, r.transfers, [x.trip_id for x in r.rides]) for r in back] == [(500, 540, 1, [1, 2])]
    assert ask(backward=True, time=539) == []
    assert {r.goal for r in ask(goal_metas=True)} == {4}
    via = query.answer_via(t, query.Query(1, 4, 480), 2, 2).collect()
    assert [(r.first.arrival, r.second.arrival) for r in via] == [(520, 540)]
    for bad in ({"kind": "walk"}, {"kind": "pretrip"}, {"kind_of_search": "x"}):
        with pytest.raises(ValueError):
            query.answer(t, query.Query(**{"start": 1, "goal": 4, "time": 480} | bad))
    fast = query.answer(query.Timetable(conn.withColumn("clasz", F.when(F.col("trip_id") == 2, 1).otherwise(5)), foot), query.Query(1, 4, 480, kind_of_search="no_intercity"))
    assert fast.count() == 0
    counted = query.statistics(query.answer(t, query.Query(1, 4, 480)), conn, search.run_rounds(conn, foot, starts(spark, (1, 480)), 2)).first()
    assert (counted.n_journeys, counted.n_rides, counted.n_connections) == (1, 2, 6) and counted.n_labels >= 4


def random_timetable(rnd, n=9, trips=25):
    conn = []
    for trip in range(trips):
        at, station = rnd.randint(480, 900), rnd.randrange(n)
        for seq in range(rnd.randint(1, 5)):
            to = rnd.choice([s for s in range(n) if s != station])
            arr = at + rnd.randint(5, 40)
            conn.append((0, trip, seq, station, to, at, arr, rnd.random() < 0.9, rnd.random() < 0.9, rnd.randint(0, 9)))
            at, station = arr + rnd.randint(0, 5), to
    foot = [(i, i, rnd.randint(1, 6)) for i in range(n)] + [(a, b, rnd.randint(5, 20)) for a, b in ((0, 1), (1, 0), (3, 4), (4, 3))]
    return conn, foot


def test_search_by_enumeration(spark):
    rnd = random.Random(3)
    for _ in range(4):
        conn, foot = random_timetable(rnd)
        rows = spark.createDataFrame(conn, CONN)
        walks = spark.createDataFrame(foot, "a long, b long, dur long")
        for rounds in (1, 4):
            want = brute(conn, foot, 0, 480, rounds)
            found = search.run_rounds(rows, walks, starts(spark, (0, 480)), rounds)
            best = {s: min(v.values()) for s, v in want.items()}
            assert {r.station: r.arr for r in found.arrivals().collect()} == best
            legs = {}
            for r in found.arrivals(True).collect():
                legs.setdefault(r.station, {})[r.legs] = r.arr
            for s, v in want.items():  # labels are kept where another trip makes them earlier
                low, keep = 1 << 40, {}
                for k in sorted(v):
                    if v[k] < low:
                        low = keep[k] = v[k]
                assert legs[s] == keep
            made = search.journeys(search.journey_legs(found, rows.select(F.col("to_station").alias("goal")).distinct()))
            for r in made.collect():
                assert legs[r.goal][r.transfers + 1] == r.arrival
                at = 480
                for x in r.rides:  # each ride exists and is reached in time
                    ride = [c for c in conn if c[1] == x.trip_id and x.enter <= c[2] <= x.exit]
                    assert ride[0][3] == x.enter_station and ride[0][5] == x.dep >= at and ride[-1][4] == x.exit_station and ride[-1][6] == x.arr
                    dur = {(a, b): d for a, b, d in foot}
                    at = x.arr + dur[x.exit_station, x.walk_to] if x.exit_station != x.walk_to else x.arr + dur[x.exit_station, x.exit_station]


def brute_pareto(conn, foot, start, t0, rounds, fare):
    """Pareto labels (station, arr, trips, price) by enumeration."""
    labels, out = {(start, t0, 0)}, set()
    for k in range(1, rounds + 1):
        new = set()
        for s, at, price in labels:
            for c in conn:
                if c[3] == s and c[7] and at <= c[5] <= t0 + 1440:
                    first = min(x[2] for x in conn if x[1] == c[1] and x[3] == s and x[7] and x[5] >= at)
                    if c[2] != first:
                        continue
                    cost = price
                    for d in sorted(x for x in conn if x[1] == c[1] and x[2] >= c[2]):
                        cost += fare(d)
                        if d[8] and d[6] <= t0 + 1440:
                            for a, b, dur in foot:
                                if a == d[4]:
                                    out.add((b, d[6] if a == b else d[6] + dur, k, cost))
                                    new.add((b, d[6] + dur, cost))
        labels = {x for x in new if not any(y[0] == x[0] and y[1] <= x[1] and y[2] <= x[2] and y != x for y in new)}
    return {x for x in out if not any(y[0] == x[0] and all(p <= q for p, q in zip(y[1:], x[1:], strict=True)) and y != x for y in out)}


def test_pareto_search_by_enumeration(spark):
    rnd = random.Random(5)
    for _ in range(2):
        conn, foot = random_timetable(rnd, 7, 16)
        fare = lambda c: (c[1] * 7 + c[2] * 5) % 23
        rows = spark.createDataFrame(conn, CONN).withColumn("fare", (F.col("trip_id") * 7 + F.col("seq") * 5) % 23)
        walks = spark.createDataFrame(foot, "a long, b long, dur long")
        got = pareto.pareto_search(rows, walks, starts(spark, (0, 480)), (pareto.PRICE,), 3).collect()
        assert {(r.station, r.arr, r.legs, r.price) for r in got} == brute_pareto(conn, foot, 0, 480, 3, fare)


def every_label(conn, foot, start, t0, rounds):
    """(station, arr, trips, fares, regional, other fares) of all journeys, none left out."""
    labels, out = {(start, t0, 0, 0)}, set()
    for k in range(1, rounds + 1):
        new = set()
        for s, at, fares, regional in labels:
            for trip, first in [(c[1], c[2]) for c in conn if c[3] == s and c[7] and at <= c[5] <= t0 + 1440]:
                other, local = fares, regional
                for d in sorted(x for x in conn if x[1] == trip and x[2] >= first):
                    other, local = other + d[10], local + d[11]
                    if d[8] and d[6] <= t0 + 1440:
                        for a, b, dur in foot:
                            if a == d[4]:
                                out.add((b, d[6] if a == b else d[6] + dur, k, other, local))
                                new.add((b, d[6] + dur, other, local))
        labels = new
    return out


def pareto_of(rows):
    return {x for x in rows if not any(y[0] == x[0] and all(p <= q for p, q in zip(y[1:], x[1:], strict=True)) and y != x for y in rows)}


def tied_timetable(rnd, n=6, trips=12):
    """Few distinct times and fares, so that labels tie in all ways; regional fares that pass their cap."""
    conn = []
    for trip in range(trips):
        at, station = 480 + 20 * rnd.randint(0, 6), rnd.randrange(n)
        for seq in range(rnd.randint(1, 4)):
            to = rnd.choice([s for s in range(n) if s != station])
            conn.append((0, trip, seq, station, to, at, at + 20, True, True, 5, rnd.choice([0, 100, 900]), rnd.choice([0, 0, 1500, 3000])))
            at, station = at + 20, to
    return conn, [(i, i, 0) for i in range(n)] + [(0, 1, 20), (1, 0, 20)]


@pytest.mark.parametrize("seed", [1, 2])
def test_prices_with_ties(spark, seed):
    conn, foot = tied_timetable(random.Random(seed))
    rows, walks = spark.createDataFrame(conn, CONN + ", fare long, regional long"), spark.createDataFrame(foot, "a long, b long, dur long")
    truth = every_label(conn, foot, 0, 480, 3)
    prices = {
        "price": lambda t, f, r: f,
        "wage_price": lambda t, f, r: f + 8 * (t - 480),
        "regional_price": lambda t, f, r: f + min(r, 4200) + 8 * (t - 480),
    }
    for kind, price in prices.items():
        got = pareto.pareto_search(rows, walks, starts(spark, (0, 480)), pareto.SEARCHES[kind], 3).collect()
        assert {(r.station, r.arr, r.legs, r[kind]) for r in got} == pareto_of({(s, t, k, price(t, f, r)) for s, t, k, f, r in truth}), kind


def test_equal_labels_of_two_stations(spark):
    """One trip reaches two stops at the same price and ready time; the later stop is the cheaper place to board."""
    conn = spark.createDataFrame([(0, 1, 0, 1, 2, 480, 490, True, True, 5, 10), (0, 4, 0, 1, 3, 480, 490, True, True, 5, 10), (0, 2, 0, 2, 3, 500, 510, True, True, 5, 100), (0, 2, 1, 3, 4, 510, 520, True, True, 5, 5)], CONN + ", fare long")
    walks = spark.createDataFrame([(i, i, 5) for i in range(1, 5)], "a long, b long, dur long")
    got = pareto.pareto_search(conn, walks, starts(spark, (1, 480)), (pareto.PRICE,), 2).collect()
    assert {(r.arr, r.price) for r in got if r.station == 4} == {(520, 15)}


@pytest.mark.parametrize("kind", ["price", "regional_price", "weighted"])
def test_goals_prune(spark, kind):
    conn, foot = tied_timetable(random.Random(7), 7, 25)
    rows, walks = spark.createDataFrame(conn, CONN + ", fare long, regional long"), spark.createDataFrame(foot, "a long, b long, dur long")
    logs, name = ([], []), {"weighted": "weight"}.get(kind, kind)
    whole = pareto.pareto_search(rows, walks, starts(spark, (0, 480)), pareto.SEARCHES[kind], 4, log=logs[0]).collect()
    goal = {r.station for r in whole} - {0, 1}
    goal = min(goal, key=lambda s: min(r.arr for r in whole if r.station == s))
    got = pareto.pareto_search(rows, walks, starts(spark, (0, 480)), pareto.SEARCHES[kind], 4, goals=goals(spark, goal), log=logs[1]).collect()
    assert {(r.arr, r.legs, r[name]) for r in got} == {(r.arr, r.legs, r[name]) for r in whole if r.station == goal} and got
    assert sum(n for _, n in logs[1]) < sum(n for _, n in logs[0])


def test_absurd_walks_break_ties(spark):
    a = pareto.ABSURDITY
    rows = spark.createDataFrame([(4, 5, 0), (2, 5, 0), (3, 5, 1), (3, 0, 1)], "walks long, dur long, absurdity long")
    assert [r.x for r in rows.select(a.walk(F.col("absurdity"), F.col).alias("x")).collect()] == [1, 0, 2, 1]
    got = pareto.pareto_search(spark.createDataFrame([(0, 1, 0, 1, 2, 480, 490, True, True, 5)], CONN), spark.createDataFrame([(2, 2, 0), (2, 3, 4)], "a long, b long, dur long"), starts(spark, (1, 480)), pareto.SEARCHES["absurdity"], 2).collect()
    assert {(r.station, r.arr, r.walks, r.absurdity) for r in got} == {(2, 490, 0, 0), (3, 494, 1, 0)}


def test_skyline_by_pairs(spark):
    rnd = random.Random(3)
    data = [(rnd.choice([None, 1, 2]), *(rnd.choice([None, *range(6)]) if rnd.random() < 0.1 else rnd.randint(0, 40) for _ in range(3))) for _ in range(900)]
    data += data[:50]
    df = spark.createDataFrame(data, "k long, x long, y long, z long").repartition(6)

    def beats(a, b):
        return a[0] == b[0] and None not in (*a[1:], *b[1:]) and a[1] <= b[1] and a[2] <= b[2] and a[3] >= b[3] and a[1:] != b[1:]

    for by, rows in ((["k"], data), ([], [(0, *d[1:]) for d in data])):
        want = sorted((r[1:] for r in rows if not any(beats(o, r) for o in rows)), key=str)
        got = relational.skyline(df, by, ["x", "y"], ["z"]).collect()
        assert sorted((tuple(r)[1:] for r in got), key=str) == want


def test_night_over_midnight(spark):
    cases = [(0, 240, 240), (0, 241, 240), (240, 1380, 0), (240, 1381, 1), (1379, 1381, 1), (1380, 1380, 0), (1380, 1500, 120), (1381, 1500, 119), (1380, 1680, 300), (1379, 1681, 300), (0, 1441, 301), (0, 2881, 601), (0, 3121, 840)]
    df = spark.createDataFrame(cases, "a long, b long, want long")
    assert df.filter(scalars.overlap_per_day(F.col("a"), F.col("b"), *pareto.NIGHT) != F.col("want")).count() == 0


def test_late_connections(spark, line):
    conn, foot = line
    conn = conn.withColumn("fare", F.lit(100).cast("long"))
    stay = spark.createDataFrame([(2, 2, 400, 5000, True)], "a long, b long, dur long, price_of_edge long, is_hotel boolean")
    taxi = spark.createDataFrame([(2, 9, 20, 3000, True)], "a long, b long, dur long, price_of_edge long, taxi boolean")
    edges = pareto.extra_edges(stay, taxi)
    got = pareto.pareto_search(conn, foot, starts(spark, (1, 480)), pareto.SEARCHES["late_connections"], 2, edges).collect()
    assert {(r.arr, r.price, r.hotel) for r in got if r.station == 9} == {(540, 3100, 0)}
    night = spark.createDataFrame([(2, 9, 20, 0, 600, 700)], "a long, b long, dur long, price_of_edge long, open_from long, open_to long")
    by_day = pareto.pareto_search(conn, foot, starts(spark, (1, 480)), (pareto.PRICE,), 1, pareto.extra_edges(night)).collect()
    assert {r.arr for r in by_day if r.station == 9} == {620}
    rows = spark.createDataFrame([(1, 500, 600, 1000), (2, 500, 600, 1900), (3, 500, 600, 2100)], "id long, departure long, arrival long, price long")
    rule = pareto.dominates(["price"], relaxed={"price": pareto.PRICE_RELAXATION})
    assert {r.id for r in pareto.undominated(rows, [], rule).collect()} == {1, 2}
    apart = pareto.comparable_in_time(pareto.dominates(["price"]))
    later = rows.withColumn("departure", F.when(F.col("id") == 3, 510).otherwise(F.col("departure")))
    assert {r.id for r in pareto.undominated(later, [], apart).collect()} == {1, 3}


def test_lower_bounds_and_fares(spark):
    edges = spark.createDataFrame([(1, 2, 10), (2, 3, 5), (1, 3, 20), (3, 1, 1)], "from_station long, to_station long, minutes long")
    got = {r.station: r.minutes for r in pareto.lower_bounds(edges, goals(spark, 3)).collect()}
    assert got == {3: 0, 2: 5, 1: 15}
    rows = spark.createDataFrame([(0, 10.0), (2, 10.0), (5, 10.5), (9, 10.0), (12, 3.0)], "c int, km double")
    assert [r.x for r in rows.select(pareto.cents(F.col("c"), F.col("km")).alias("x")).collect()] == [220, 180, 157, 0, 0]


def test_intermodal(spark, line):
    conn, foot = line
    stations = spark.createDataFrame([(1, 50.0, 8.0), (2, 50.2, 8.0), (4, 50.4, 8.0)], "station_id long, lat double, lng double")
    walk, bike = query.Mode("walk", 1.5, 15), query.Mode("bike", 3.5, 30, 5)
    first = query.mode_edges(spark, stations, 50.003, 8.0, [walk, bike], True)
    last = query.mode_edges(spark, stations, 50.401, 8.0, [walk, bike], False)
    assert [(r.a, r.b, r["mode"]) for r in first.collect()] == [(query.START, 1, "bike")]
    got = query.intermodal(query.Timetable(conn, foot), first, last, 480).collect()
    assert [(r.first_mode, r.last_mode, r.transfers) for r in got] == [("bike", "bike", 1)] and got[0].arrival == 540 + last.first().dur
    assert query.without_overlap(first, spark.createDataFrame([(1,)], "a long")).count() == 0


def test_batch_and_operations(spark, line, tmp_path):
    conn, foot = line
    (tmp_path / "in.json").write_text('{"id": 7, "start": 1, "goal": 4, "time": 480}\n{"id": 8, "start": 1, "goal": 8, "time": 480}\n{"id": 9, "start": 2, "goal": 4, "time": 500}\n')
    out = {r.id: r.journeys for r in query.batch(spark, str(tmp_path / "in.json"), str(tmp_path / "out"), query.Timetable(conn, foot)).collect()}
    assert out[7][0].arrival == 540 and not out[8] and out[9][0].departure == 530
    assert query.call("/search", query.Timetable(conn, foot), query.Query(1, 4, 480)).count() == 1
    with pytest.raises(ValueError):
        query.operation("/search")(len)
    with pytest.raises(KeyError):
        query.call("/none")


def test_trip_ids(spark):
    stops = spark.createDataFrame([(1, 0, 10, 5, 6, 100), (1, 1, 11, 15, 16, 100), (1, 2, 12, 25, 26, 101), (1, 3, 13, 35, 36, 101)], "trip_id long, seq long, station_id long, arr_min long, dep_min long, nr long")
    ids = timetable.trip_ids(stops, F.col("nr"), F.lit("L"))
    assert sorted((r.station_id, r.train_nr, r.time, r.alias) for r in ids.collect()) == [(10, 100, 6, False), (12, 101, 26, True)]
    asked = ids.select("station_id", "train_nr", "time", "target_id", "target_time").withColumn("line", F.lit(None).cast("string"))
    assert timetable.find_trips(asked, ids).count() == 2
    assert timetable.find_trips(asked.withColumn("line", F.lit("M")), ids).count() == 0
    fuzzy = timetable.find_trips_fuzzy(spark.createDataFrame([(10, 100, 6), (10, 5, 6)], "station_id long, train_nr long, time long"), ids.unionByName(ids.limit(1).withColumn("train_nr", F.lit(0).cast("long")).withColumn("station_id", F.lit(10).cast("long")).withColumn("time", F.lit(6).cast("long"))))
    assert sorted((r.train_nr, r.trip_id, r.exact) for r in fuzzy.collect()) == [(5, 1, False), (100, 1, True)]
    dim = spark.createDataFrame([(1, "a")], "k long, v string")
    assert timetable.get(spark.createDataFrame([(1,)], "k long"), "k", dim).first().v == "a"
    with pytest.raises(Exception, match="not found: 2"):
        timetable.get(spark.createDataFrame([(2,)], "k long"), "k", dim).collect()
    info = spark.createDataFrame([(100, 900)], "first_dep long, last_arr long")
    assert timetable.check_times(info, F.lit(200), F.lit(300)).first().in_schedule and timetable.check_times(info, F.lit(0), F.lit(300), False).first().in_schedule
    with pytest.raises(Exception, match="not in schedule"):
        timetable.check_times(info, F.lit(0), F.lit(300)).collect()
