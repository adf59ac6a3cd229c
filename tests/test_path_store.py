"""Path store: round trips, lookups and map views against brute force, and what a view's scan may skip."""

import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from tramline.operators import paths
from tramline.sources import path_store

SCHEMA = f"stations array<long>, classes array<int>, segment int, points {paths.POINTS}"


def sequences(rnd, n):
    """(stations, classes) to lines: stations lie on a grid, lines bend."""
    at = {k: (45 + k // 40 * 0.1, 5 + k % 40 * 0.1) for k in range(1600)}
    out = {}
    while len(out) < n:
        k, stops = rnd.randrange(1600), []
        for _ in range(rnd.randint(2, 6)):
            stops.append(k)
            k = min(1599, max(0, k + rnd.choice([-40, -1, 1, 40, 41])))
        lines = [[at[a], (at[a][0] + rnd.uniform(-0.05, 0.05), at[a][1]), at[b]] for a, b in zip(stops, stops[1:], strict=False)]
        out.setdefault(tuple(stops), (sorted(rnd.sample(range(9), 2)), lines))
    return out


def rows(found):
    return [(list(s), c, i, [{"lat": a, "lng": b} for a, b in p]) for s, (c, lines) in found.items() for i, p in enumerate(lines)]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    found = sequences(random.Random(5), 800)
    folder = str(tmp_path_factory.mktemp("store") / "s")
    df = spark.createDataFrame(rows(found), SCHEMA)
    path_store.write(df.unionByName(df.limit(20)), folder, files=16)
    return folder, found


def test_lookups(spark, store):
    folder, found = store
    flat = lambda p: [(x.lat, x.lng) for x in p]
    for stops, (classes, lines) in list(found.items())[:4]:
        got = path_store.lookup(spark, folder, list(stops), classes[1]).orderBy("segment").collect()
        assert [flat(r.points) for r in got] == lines
        missing = next(c for c in range(9) if c not in classes)
        assert path_store.lookup(spark, folder, list(stops), missing).count() == 0
    asked = [(k, list(s), c[0]) for k, (s, (c, _)) in enumerate(found.items())] + [(-1, [7, 9999], 1), (-2, [], 1), (-3, None, 1), (-4, *[list(next(iter(found)))], 77)]
    got = path_store.lookup_all(spark.createDataFrame(asked, "id int, stations array<long>, clasz int"), folder).collect()
    assert {r.id: (r.segment, r.points) for r in got if r.id < 0} == {k: (None, None) for k in (-1, -2, -3, -4)}
    lines = {k: v[1] for k, v in enumerate(found.values())}
    assert {(r.id, r.segment): flat(r.points) for r in got if r.id >= 0} == {(k, i): p for k, v in lines.items() for i, p in enumerate(v)}
    assert len(got) == 4 + sum(map(len, lines.values()))


def boxes_by_hand(found):
    out = {}
    for stops, (_, lines) in found.items():
        for a, b, p in zip(stops, stops[1:], lines, strict=False):
            out.setdefault((min(a, b), max(a, b)), []).extend(p)
    return {k: (min(x[0] for x in p), max(x[0] for x in p), min(x[1] for x in p), max(x[1] for x in p)) for k, p in out.items()}


@pytest.mark.parametrize("view", [(46.0, 46.4, 6.0, 6.3), (40.0, 60.0, 0.0, 20.0), (46.0, 46.0, 6.0, 6.0), (10.0, 11.0, 6.0, 7.0), (46.0, 46.4, 8.8, 5.1)])
def test_views(spark, store, view):
    folder, found = store
    south, north, west, east = view
    meets = lambda b: b[1] >= south and b[0] <= north and ((b[3] >= west and b[2] <= east) if west <= east else (b[3] >= west or b[2] <= east))
    want = {k: b for k, b in boxes_by_hand(found).items() if meets(b)}
    got = path_store.boxes_in(spark, folder, *view)
    assert {(r.a, r.b): (r.min_lat, r.max_lat, r.min_lng, r.max_lng) for r in got.collect()} == want and got.columns == ["a", "b", "min_lat", "max_lat", "min_lng", "max_lng"]
    passes = {s for s in found if any((min(p), max(p)) in want for p in zip(s, s[1:], strict=False))}
    assert {tuple(r.stations) for r in path_store.sequences_in(spark, folder, *view).collect()} == passes


def test_small_views_skip_files(spark, store, tmp_path):
    folder, _ = store

    def met(path, south, north, west, east):
        n = hit = 0
        for file in path.glob("*.parquet"):
            meta = pq.ParquetFile(file).metadata
            for g in range(meta.num_row_groups):
                s = {(c := meta.row_group(g).column(i)).path_in_schema: c.statistics for i in range(meta.num_columns)}
                hit += s["max_lat"].max >= south and s["min_lat"].min <= north and s["max_lng"].max >= west and s["min_lng"].min <= east
                n += 1
        return n, hit

    n, hit = met(Path(folder) / "boxes", 46.0, 46.2, 6.0, 6.2)
    assert n >= 12 and hit <= n / 3
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = path_store.boxes_in(spark, folder, 46.0, 46.2, 6.0, 6.2)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert all(x in plan for x in ("GreaterThanOrEqual(max_lat,46.0)", "LessThanOrEqual(min_lng,6.2)"))
    path_store.read(spark, folder, "boxes").repartition(16, "a").write.parquet(str(tmp_path / "dealt"))
    n, hit = met(tmp_path / "dealt", 46.0, 46.2, 6.0, 6.2)
    assert hit > n / 2


def test_curve(spark):
    from pyspark.sql import functions as F

    def by_hand(lat, lng):
        cell = lambda x, low, width: min(max(int((x - low) // (width / 2**20)), 0), 2**20 - 1)
        y, x = cell(lat, -90, 180), cell(lng, -180, 360)
        return sum(((y >> k & 1) << 2 * k + 1) | ((x >> k & 1) << 2 * k) for k in range(20))

    rnd = random.Random(2)
    places = [(rnd.uniform(-89, 89), rnd.uniform(-179, 179)) for _ in range(200)] + [(-90.0, -180.0), (90.0, 180.0), (95.0, -200.0)]
    df = spark.createDataFrame(places, "lat double, lng double").withColumn("z", path_store.curve(F.col("lat"), F.col("lng")))
    assert [r.z for r in df.collect()] == [by_hand(*p) for p in places]


def test_edge_rows(spark, tmp_path):
    p = lambda *xs: [{"lat": a, "lng": b} for a, b in xs]
    given = [([1, 2], [3, 3], 0, p((1.0, 1.0), (2.0, 2.0))), ([1, 2], [3], 0, p((1.0, 1.0), (1.5, 2.0))), ([4, 5], [1], 0, None), ([6, 7], [1], 0, []), (None, [1], 0, p((1.0, 1.0))), ([8, 9], None, 0, None), ([8, 9], [1], None, None)]
    df = spark.createDataFrame([(*g, "x") for g in given], f"{SCHEMA}, place string")
    path_store.write(df, str(tmp_path / "s"))
    assert [(r.segment, len(r.points)) for r in path_store.lookup(spark, str(tmp_path / "s"), [1, 2], 3).collect()] == [(0, 2)]
    assert path_store.lookup(spark, str(tmp_path / "s"), [1, 2], 3).first().points[1].lat == 1.5
    assert [(r.segment, r.points) for r in path_store.lookup(spark, str(tmp_path / "s"), [4, 5], 1).collect()] == [(0, None)]
    assert [(r.a, r.b) for r in path_store.read(spark, str(tmp_path / "s"), "boxes").collect()] == [(1, 2)]
    path_store.write(df.limit(0), str(tmp_path / "none"))
    assert path_store.boxes_in(spark, str(tmp_path / "none"), -90, 90, -180, 180).count() == 0 and path_store.lookup(spark, str(tmp_path / "none"), [1, 2], 3).count() == 0
    with pytest.raises(Exception, match="(?i)exists"):
        path_store.write(df, str(tmp_path / "s"))


def test_straight_lines_where_nothing_is_stored(spark, store):
    folder, found = store
    first = next(iter(found))
    stations = spark.createDataFrame([(k, 1.0 * k, 2.0 * k) for k in range(1600)], "station_id long, lat double, lng double")
    trips = spark.createDataFrame([(1, list(first), found[first][0][0]), (2, [3, 5], 1)], "trip_id long, stations array<long>, clasz int")
    stored = path_store.lookup_all(trips.drop("trip_id"), folder).filter("segment IS NOT NULL")
    got = {(r.trip_id, r.segment): len(r.points) for r in paths.trip_paths(trips, stored, stations).collect()}
    assert got == {(1, i): 3 for i in range(len(first) - 1)} | {(2, 0): 2}


def test_lookup_reads_a_sequence_once(spark, tmp_path):
    p = lambda *xs: [{"lat": a, "lng": b} for a, b in xs]
    given = [([1, 2, 3], [3, 4], k, p((1.0 * k, 1.0), (2.0, 2.0))) for k in (0, 1)] + [([4, 5, 6], [1], 1, p((7.0, 7.0)))]
    folder = str(tmp_path / "s")
    path_store.write(spark.createDataFrame(given, SCHEMA), folder)
    heads = path_store.read(spark, folder, "sequences").filter("head").collect()
    assert sorted((list(r.stations), r.segment) for r in heads) == [([1, 2, 3], 0), ([4, 5, 6], 1)]
    assert path_store.read(spark, folder, "index").count() == 3
    asked = spark.createDataFrame([(1, [1, 2, 3], 4), (2, [1, 2, 3], 4), (3, [4, 5, 6], 1), (4, [4, 5, 6], 2), (5, None, 1), (6, [1, 2], None)], "id int, stations array<int>, clasz int")
    found = path_store.lookup_all(asked, folder)
    assert sorted((r.id, -1 if r.segment is None else r.segment) for r in found.collect()) == [(1, 0), (1, 1), (2, 0), (2, 1), (3, 1), (4, -1), (5, -1), (6, -1)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
