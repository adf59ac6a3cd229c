"""Delay distributions against direct calculation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tramline.operators import reliability as rel
from tramline.sources import distributions

D = "array<struct<minute:bigint,p:double>>"


def dist(*pairs):
    return [{"minute": m, "p": p} for m, p in pairs]


def departure_by_hand(own, feeding, wait, change=None, latest=None):
    """Straight from the rules: own, feeding [(latest, {minute: p})], change {minute: p}."""
    le = lambda d, t: sum(p for m, p in d.items() if m <= t)
    free = lambda t: 1.0 if not feeding else math.prod(1.0 if t >= lf else 1.0 - (le(d, lf) - le(d, t)) for lf, d in feeding)
    out = {}
    for t in range(max([*own, wait, 0]) + 1):
        comes, there, was = own.get(t, 0.0), le(own, t), le(own, t - 1)
        waited = free(t) - free(t - 1) if feeding else 0.0
        if change is None:
            out[t] = there * free(0) if t == 0 else comes * free(t) + was * waited if t <= wait else comes
        else:
            ready, gets = le(change, t), change.get(t, 0.0)
            leaves = waited * ready + (gets * (free(t) - waited) if t <= latest else 0.0)
            out[t] = ready * there * free(0) if t == 0 else comes * free(t) * ready + was * leaves if t <= wait else ready * comes
    return out


def test_departures(spark):
    rnd = random.Random(2)

    def random_dist(lo, hi):
        m = rnd.sample(range(lo, hi), 4)
        w = [rnd.random() for _ in m]
        return {k: x / sum(w) for k, x in zip(m, w, strict=True)}

    trains, feeders, want = [], [], {}
    for key in range(12):
        own, change = random_dist(-3, 9), random_dist(-4, 8)
        feeding = [(lf := rnd.randint(1, 5), random_dist(-5, 8)) for _ in range(key % 4)]
        trains.append((key, dist(*sorted(own.items())), dist(*sorted(change.items())), 2))
        feeders += [(key, k, lf, lf, dist(*sorted(d.items()))) for k, (lf, d) in enumerate(feeding)]
        wait = max((lf for lf, _ in feeding), default=0)
        want[key] = departure_by_hand(own, feeding, wait), departure_by_hand(own, feeding, wait, change, 2)
    t = spark.createDataFrame(trains, f"key long, own {D}, change {D}, change_latest int")
    f = spark.createDataFrame(feeders, f"key long, feeder long, latest long, wait long, dist {D}")
    for k, rows in enumerate((rel.departures(t.select("key", "own"), f), rel.departures(t, f))):
        got = {(r.key, r.minute): r.p for r in rows.collect()}
        assert got == pytest.approx({(key, m): p for key, w in want.items() for m, p in w[k].items()})
    measured = rel.departures(t.select("key", "own").withColumn("is_delay", F.lit(4)), f).filter("key = 0").collect()
    assert [(r.minute, pytest.approx(1.0)) for r in measured] == [(4, 1.0)]
    sums = rel.departures(t.select("key", "own"), f).groupBy("key").agg(F.sum("p").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in sums)


def test_arrivals(spark):
    dep = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.3), (1, 2, 0.2), (2, 3, 1.0)], "key long, minute long, p double")
    travel = spark.createDataFrame([(1, 0, -1, 0.25), (1, 0, 0, 0.75), (1, 1, 0, 0.9), (1, 1, 2, 0.0999)], "key long, delay long, minute long, p double")
    got = {(r.key, r.minute): r.p for r in rel.arrival(dep, travel).collect()}
    # delay 2 uses the distribution of delay 1; what is lost goes to the likeliest minute
    want = {(1, -1): 0.125, (1, 0): 0.375, (1, 1): 0.27, (1, 2): 0.18, (1, 3): 0.3 * 0.0999, (1, 4): 0.2 * 0.0999, (2, 3): 1.0}
    want[1, 0] += 1.0 - sum(p for (k, _), p in want.items() if k == 1)
    assert got == pytest.approx(want)
    fixed = rel.corrected(spark.createDataFrame([(1, k, p) for k, p in enumerate((0.09999, 0.50001, 0.25, 0.1499))], "key long, minute long, p double"), spark.createDataFrame([(1, 1.0)], "key long, want double"))
    assert fixed.filter("minute = 1").first().p == pytest.approx(0.50001 + 1.0 - 0.9999)
    cut = rel.trim(spark.createDataFrame([(1, 0, 1e-6), (1, 1, 0.6), (1, 2, 0.4), (1, 3, 1e-7)], "key long, minute long, p double"))
    assert {(r.minute, round(r.p, 9)) for r in cut.collect()} == {(1, round(0.6 + 1e-6 + 1e-7, 9)), (2, 0.4)}


def test_lookups(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Zuggattung;Zuggattungsklasse\nICE;FV\nRB;RV\n")
    (tmp_path / "m.csv").write_text("KLASSEN_ID;ZUGGATTUNGSKLASSE;VORSCHAUZEITKLASSE_VON;VORSCHAUZEITKLASSE_BIS;AKTUELLEVERSPAETUNGSLAGE_VON;AKTUELLEVERSPAETUNGSLAGE_BIS\n1;FV;-1;10;-5;3\n2;FV;-1;10;3;Inf\n3;FV;10;Inf;-5;Inf\n4;FV;x;9;0;1\n5;FV;3;9;0;0\n")
    (tmp_path / "s.csv").write_text("Zuggattungsklasse;Startverspaetung;p_startverspaetung\nRV;-1;0.1\nRV;0;0.8\nRV;1;0.1\n")
    (tmp_path / "d.csv").write_text("KLASSEN_ID;verspaetungsDelta;p_Verspaetungsdelta\n0;-5;.1\n0;0;.9\n")
    (tmp_path / "h.csv").write_text("station_eva,hotel_name,hotel_rating\n8000105,Inn,4\n8000105,Lodge,3\n")
    classes, mapping = distributions.classes(spark, str(tmp_path / "c.csv")), distributions.mapping(spark, str(tmp_path / "m.csv"), 100, 20)
    assert sorted(tuple(r) for r in mapping.collect()) == [("FV", 0, 10, 0, 2, 1), ("FV", 0, 10, 3, 20, 2), ("FV", 11, 100, 0, 20, 3)]
    asked = spark.createDataFrame([("ice", 10, 2), ("ICE", 10, 3), ("ICE", 11, 50), ("Ice", 4000, 0), ("Bus", 5, 0)], "category string, travel long, delay long")
    assert [r.dist_id for r in rel.travel_distributions(asked, classes, mapping).orderBy("travel", "delay").collect()] == [None, 1, 2, 3, 3]
    assert {(r.minute, round(r.p, 9)) for r in distributions.start_distributions(spark, str(tmp_path / "s.csv")).collect()} == {(0, 0.9), (1, 0.1)}
    assert distributions.distributions(spark, str(tmp_path / "d.csv")).count() == 2 and distributions.hotels(spark, str(tmp_path / "h.csv")).count() == 1
    pairs = spark.createDataFrame([("ICE", "RB"), ("RB", "ICE"), ("X", "RB")], "category string, feeder_category string")
    groups = spark.createDataFrame([("ICE", 1), ("RB", 2)], "category string, group int")
    matrix = spark.createDataFrame([(1, 2, 5), (0, 2, 1)], "connecting int, feeder int, wait int")
    assert {(r.category, r.wait) for r in rel.waiting_times(pairs, groups, matrix).collect()} == {("ICE", 5), ("RB", 0), ("X", 1)}


def test_feeders(spark):
    rnd = random.Random(1)
    dep = [(k, rnd.randrange(3), rnd.randint(0, 200), rnd.randint(0, 5), k % 4) for k in range(60)]
    arr = [(k, rnd.randrange(3), rnd.randint(0, 200), k % 4) for k in range(60)]
    got = rel.feeders(spark.createDataFrame(dep, "key long, station_id long, at long, transfer long, route long"), spark.createDataFrame(arr, "feeder long, station_id long, came long, route long"))
    want = {(d[0], a[0]) for d in dep for a in arr if d[1] == a[1] and d[2] - 30 <= a[2] <= d[2] - max(1, d[3]) and a[3] != d[4]}
    assert {(r.key, r.feeder) for r in got.collect()} == want and got.count() == len(want)


def test_timetable_distributions(spark):
    # two trips: b waits up to three minutes for a at their common station
    conn = spark.createDataFrame([(1, 10, 0, 0, 0, 20), (2, 10, 0, 1, 22, 40), (3, 20, 0, 0, 26, 50)], "key long, trip_id long, day long, seq long, dep long, arr long")
    start = spark.createDataFrame([(1, 0, 0.6), (1, 5, 0.4), (3, 0, 1.0)], "key long, minute long, p double")
    travel = spark.createDataFrame([(k, 0, m, p) for k in (1, 2, 3) for m, p in ((0, 0.5), (1, 0.5))], "key long, delay long, minute long, p double")
    feeding = spark.createDataFrame([(3, 1, 3, 4)], "key long, feeder long, wait long, transfer long")
    deps, arrs = rel.timetable_distributions(conn, start, travel, feeding)
    first = {0: 0.6 * 0.5, 1: 0.6 * 0.5, 5: 0.4 * 0.5, 6: 0.4 * 0.5}
    at = lambda df, k: {r.minute: r.p for r in df.filter(F.col("key") == k).collect() if r.p}
    assert at(arrs, 1) == pytest.approx(first)
    assert at(deps, 2) == pytest.approx({m: p for m, p in departure_by_hand(first, [], 0).items() if p})
    ready = {m + 20 + 4 - 26: p for m, p in first.items()}
    assert at(deps, 3) == pytest.approx({m: p for m, p in departure_by_hand({0: 1.0}, [(3, ready)], 3).items() if p})
    needs = spark.createDataFrame([(2, 1), (3, 1), (4, 3)], "key long, on long")
    assert {r.key for r in rel.affected(spark.createDataFrame([(1,)], "key long"), needs).collect()} == {1, 2, 3, 4}
    assert {r.key for r in rel.significant(arrs, arrs.withColumn("p", F.when(F.col("key") == 2, F.col("p") + 0.01).otherwise(F.col("p")))).collect()} == {2}


def test_ratings(spark):
    pairs = spark.createDataFrame([(1, 7, 3), (2, 7, 0), (3, 8, -1), (4, 8, 0)], "j long, dist_id long, slack long")
    travel = spark.createDataFrame([(7, 0, 0.7), (7, 2, 0.2), (7, 9, 0.1)], "dist_id long, minute long, p double")
    rated = rel.interchange_rating(pairs, travel)
    assert {r.j: round(r.rating, 9) for r in rated.collect()} == {1: 0.9, 2: 0.7, 3: 0.0, 4: 1.0}
    rides = spark.createDataFrame([(1,), (1,), (2,)], "j long")
    got = {r.j: r.rating for r in rel.simple_rating(rides, rated.filter("j = 1"), ["j"]).collect()}
    assert got == pytest.approx({1: 0.995**2 * 0.9, 2: 0.995})
    legs = spark.createDataFrame([(1, 1, 0, 20), (1, 2, 25, 40)], "journey long, leg long, dep long, arr long")
    start = spark.createDataFrame([("1/1", 0, 0.8), ("1/1", 4, 0.2), ("1/2", 0, 1.0)], "key string, minute long, p double")
    none = spark.createDataFrame([], "key string, delay long, minute long, p double")
    changes = spark.createDataFrame([(1, 2, 3)], "journey long, leg long, transfer long")
    full = {r.minute: r.p for r in rel.journey_rating(legs, start, none, changes).collect() if r.p}
    assert full == pytest.approx({0: 0.8})  # with four minutes of delay the change is missed
    parts = spark.createDataFrame([(1, 100, 0.8, 0, 1.0), (1, 100, 0.2, 5, 0.5), (1, 130, 0.2, -25, 0.5)], "graph long, at long, weight double, minute long, p double")
    assert {r.minute: r.p for r in rel.graph_arrival(parts).collect()} == pytest.approx({100: 0.8, 105: 0.2})
    came = spark.createDataFrame([(1, 10, 0.5), (1, 20, 0.3), (1, 31, 0.2)], "stop long, minute long, p double")
    ways = spark.createDataFrame([(1, 12, 60), (1, 25, 50), (1, 30, 90)], "stop long, leaves long, arrives long")
    assert [r.minute for r in rel.uncovered(came, ways).collect()] == [31]
    assert {r.leaves: r.weight for r in rel.choose_alternatives(came, ways).collect()} == pytest.approx({25: 0.8})


def random_sections(seed):
    """Trips of sections on a line of minutes; departures wait for arrivals of other trips shortly before."""
    rnd = random.Random(seed)
    conn, feeding, key = [], [], 0
    for trip in range(6):
        at = rnd.randint(0, 30)
        for seq in range(rnd.randint(1, 4)):
            came = at + rnd.randint(5, 20)
            conn.append((key, trip, 0, seq, at, came))
            key, at = key + 1, came + rnd.randint(1, 5)
    for d in conn:
        for a in conn:
            if a[1] != d[1] and d[4] - 15 <= a[5] <= d[4] - 2 and rnd.random() < 0.5:
                feeding.append((d[0], a[0], rnd.randint(1, 4), 2))
    start = [(d[0], m, p) for d in conn if d[3] == 0 for m, p in ((0, 0.7), (rnd.randint(1, 9), 0.3))]
    travel = [(d[0], 0, m, p) for d in conn for m, p in ((0, 0.6), (rnd.randint(1, 3), 0.4))]
    return conn, start, travel, feeding


def as_tables(spark, conn, start, travel, feeding):
    return (
        spark.createDataFrame(conn, "key long, trip_id long, day long, seq long, dep long, arr long"),
        spark.createDataFrame(start, "key long, minute long, p double"),
        spark.createDataFrame(travel, "key long, delay long, minute long, p double"),
        spark.createDataFrame(feeding, "key long, feeder long, wait long, transfer long"),
    )


def by_hand(conn, start, travel, feeding, measured):
    """Departures and arrivals of all sections, one by one in order of departure."""
    deps, arrs, at = {}, {}, {c[0]: c for c in conn}
    before = {(c[1], c[3]): c[0] for c in conn}
    for key, trip, _, seq, dep, _arr in sorted(conn, key=lambda c: c[4]):
        if seq == 0:
            own = {m: p for k, m, p in start if k == key}
        else:
            prev = at[before[trip, seq - 1]]
            shift = prev[5] + min(2, dep - prev[5]) - dep
            own = {}
            for m, p in arrs[prev[0]].items():
                own[m + shift] = own.get(m + shift, 0.0) + p
        fed = [(w, {m + at[f][5] + t - dep: p for m, p in arrs[f].items()}) for k, f, w, t in feeding if k == key]
        got = departure_by_hand(own, fed, max([w for w, _ in fed], default=0))
        deps[key] = {max(measured[key], 0): sum(own.values())} if key in measured else got
        out = {}
        for m, p in deps[key].items():
            for k, _, d, q in travel:
                if k == key:
                    out[m + d] = out.get(m + d, 0.0) + p * q
        arrs[key] = out
    return deps, arrs


def mass(df):
    out = {}
    for r in df.collect():
        if r.p:
            assert r.minute not in out.setdefault(r.key, {})
            out[r.key][r.minute] = r.p
    return out


def same(got, want):
    assert set(got) == {k for k, v in want.items() if any(v.values())}
    for k, d in got.items():
        assert d == pytest.approx({m: p for m, p in want[k].items() if p}, abs=1e-9)


def test_update_is_a_recomputation(spark):
    data = random_sections(5)
    conn, start, travel, feeding = as_tables(spark, *data)
    deps, arrs = rel.timetable_distributions(conn, start, travel, feeding)
    hand = by_hand(*data, {})
    same(mass(deps), hand[0])
    same(mass(arrs), hand[1])
    fed = {f for _, f, _, _ in data[3]}
    key = next(c[0] for c in data[0] if c[3] == 0 and c[0] in fed)
    measured = spark.createDataFrame([(key, 7)], "key long, is_delay long")
    new = rel.update_distributions(conn, start, travel, feeding, deps, arrs, measured, measured, least=0.0)
    hand = by_hand(*data, {key: 7})
    same(mass(new[0]), hand[0])
    same(mass(new[1]), hand[1])
    needs = conn.sparkSession.createDataFrame([(k, f) for k, f, _, _ in data[3]] + [(b[0], a[0]) for a in data[0] for b in data[0] if a[1] == b[1] and b[3] == a[3] + 1], "key long, on long")
    reached = {r.key for r in rel.affected(measured, needs).collect()}
    assert {key} < {r.key for r in new[2].collect()} <= reached < {c[0] for c in data[0]} or reached == {c[0] for c in data[0]}
    # with a coarse limit the change goes no further than the first section; nothing changed computes nothing
    far = rel.update_distributions(conn, start, travel, feeding, deps, arrs, measured, measured, least=2.1)
    assert [(r.key, r.moved) for r in far[2].collect()] == [(key, False)]
    none = rel.update_distributions(conn, start, travel, feeding, deps, arrs, measured.limit(0), None)
    assert none[2].count() == 0 and mass(none[1]) == mass(arrs)


def test_circles_and_empty_timetables(spark):
    conn, start, travel, feeding = as_tables(spark, [(1, 1, 0, 0, 0, 10), (2, 2, 0, 0, 0, 10)], [], [], [(1, 2, 1, 1), (2, 1, 1, 1)])
    with pytest.raises(ValueError):
        rel.timetable_distributions(conn, start, travel, feeding)
    deps, arrs = rel.timetable_distributions(conn.limit(0), start, travel, feeding)
    assert deps.count() == arrs.count() == 0


def test_updates_as_a_stream(spark, tmp_path):
    from tramline.streaming import distributions as follow

    data = random_sections(6)
    conn, start, travel, feeding = as_tables(spark, *data)
    root, src = str(tmp_path / "state"), str(tmp_path / "in")
    first = [c[0] for c in data[0] if c[3] == 0]
    follow.begin(spark, root, conn, start, travel, feeding)
    said = lambda rows: spark.createDataFrame(rows, "key long, is_delay long").coalesce(1).write.mode("append").parquet(src)
    run = lambda: follow.follow(spark.readStream.schema("key long, is_delay long").parquet(src), root, str(tmp_path / "cp"), conn, start, travel, feeding, least=0.0)
    said([(first[0], 3), (first[0], 4)])
    run()
    said([(first[1], 5)])
    run()
    deps, arrs, measured = follow.state(spark, root)
    hand = by_hand(*data, {first[0]: 4, first[1]: 5})
    same(mass(deps), hand[0])
    same(mass(arrs), hand[1])
    assert {(r.key, r.is_delay) for r in measured.collect()} == {(first[0], 4), (first[1], 5)}
