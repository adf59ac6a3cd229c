"""Chains, relation lines, rail graphs and bounded ways on hand cases and against brute force."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from tramline.operators import paths, rails

POINT = "array<struct<node:long,lat:double,lng:double>>"
DEGREE = 1 / 111195.0  # a metre along a meridian


def chain_by_hand(n, link):
    """Chains as lists of (item, flipped) by walking, and rings."""
    left, out = set(range(n)), []
    starts = [(e & 1, e) for e in range(2 * n) if e not in link]
    for _, start in sorted(starts):
        if start >> 1 not in left:
            continue
        way, s = [], start
        while s is not None:
            way.append((s >> 1, bool(s & 1)))
            left.discard(s >> 1)
            s = link.get(s ^ 1)
        out.append((False, way))
    while left:
        s = first = 2 * min(left)
        way = []
        while True:
            way.append((s >> 1, bool(s & 1)))
            left.discard(s >> 1)
            s = link[s ^ 1]
            if s == first:
                break
        out.append((True, way))
    return sorted(out)


def chain_rows(df):
    got = {}
    for r in df.collect():
        got.setdefault((r.chain, r.ring), []).append((r.place, r.item, r.flipped))
    for rows in got.values():
        assert sorted(p for p, _, _ in rows) == list(range(len(rows)))
    return sorted((ring, [(i, f) for _, i, f in sorted(rows)]) for (_, ring), rows in got.items())


@pytest.mark.parametrize("seed,n,share", [(1, 40, 1.0), (2, 60, 0.9), (3, 25, 0.5), (4, 1, 1.0), (5, 33, 0.97)])
def test_chains_by_walking(spark, seed, n, share):
    rnd = random.Random(seed)
    ends = list(range(2 * n))
    rnd.shuffle(ends)
    link = {}
    for a, b in zip(ends[::2], ends[1::2], strict=True):
        if rnd.random() < share:
            link[a], link[b] = b, a
    items = spark.createDataFrame([(i,) for i in range(n)], "item long")
    links = spark.createDataFrame(list(link.items()), "a long, b long")
    assert chain_rows(rails.chains(items, links)) == chain_by_hand(n, link)


def test_no_chains(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert rails.chains(spark.createDataFrame([], "item long"), none).count() == 0
    assert chain_rows(rails.chains(spark.createDataFrame([(3,)], "item long"), none)) == [(False, [(3, False)])]


def way(*rows):
    return [{"node": n, "lat": 50.0 + y * DEGREE, "lng": 8.0 + x * DEGREE} for n, y, x in rows]


def lines(spark, ways):
    rows = spark.createDataFrame(ways, f"relation_id long, place long, points {POINT}")
    return {r.line_id: [(round((p.lat - 50) / DEGREE), round((p.lng - 8) / DEGREE)) for p in r.points] for r in rails.relation_lines(rows).collect()}


def test_relation_lines(spark):
    ways = [
        # 1: three ways in a row, the middle one drawn backwards
        (1, 0, way((1, 0, 0), (2, 100, 0))),
        (1, 1, way((3, 200, 0), (2, 100, 0))),
        (1, 2, way((3, 200, 0), (4, 300, 0))),
        # 2: 8 metres apart, straight on; 3: the same with 12 metres; 4: 8 metres, but it turns back
        (2, 0, way((1, 0, 0), (2, 100, 0))),
        (2, 1, way((3, 108, 0), (4, 200, 0))),
        (3, 0, way((1, 0, 0), (2, 100, 0))),
        (3, 1, way((3, 112, 0), (4, 200, 0))),
        (4, 0, way((1, 0, 0), (2, 100, 0))),
        (4, 1, way((3, 108, 0), (4, 0, 20))),
        # 5: three ways at one node join nothing; 6: a ring gives no line; 7: a single way gives none
        (5, 0, way((1, 0, 0), (2, 100, 0))),
        (5, 1, way((2, 100, 0), (3, 200, 0))),
        (5, 2, way((2, 100, 0), (4, 200, 100))),
        (6, 0, way((1, 0, 0), (2, 100, 0))),
        (6, 1, way((2, 100, 0), (3, 100, 100), (1, 0, 0))),
        (7, 0, way((1, 0, 0), (2, 100, 0))),
        # 8: two nodes in reach of an end: no join; 9: both outer ends are backs
        (8, 0, way((1, 0, 0), (2, 100, 0))),
        (8, 1, way((3, 106, 0), (4, 200, 0))),
        (8, 2, way((5, 104, 4), (6, 104, 100))),
        (9, 0, way((2, 100, 0), (1, 0, 0))),
        (9, 1, way((2, 100, 0), (3, 200, 0))),
        # 10: a common node goes before a near one; too short and null ways are left out
        (10, 0, way((1, 0, 0), (2, 100, 0))),
        (10, 1, way((2, 100, 0), (3, 200, 0))),
        (10, 2, way((4, 300, 0), (5, 205, 0))),
        (10, 3, way((9, 0, 0))),
        (10, 4, None),
    ]
    assert lines(spark, ways) == {
        "1/0": [(0, 0), (100, 0), (200, 0), (300, 0)],
        "2/0": [(0, 0), (100, 0), (108, 0), (200, 0)],
        "9/0": [(0, 0), (100, 0), (200, 0)],
        "10/0": [(0, 0), (100, 0), (200, 0), (205, 0), (300, 0)],
    }
    assert lines(spark, []) == {}


def test_tags(spark):
    tags = [(1, {"railway": "rail"}), (2, {"railway": "rail", "usage": "military"}), (3, {"railway": "rail", "service": "yard"}), (4, {"railway": "subway", "service": "yard"}), (5, {"railway": "rail", "railway:preserved": "yes"}), (6, None), (7, {"railway": "rail", "service": "siding"}), (8, {"railway": "light_rail", "usage": "test"})]
    ways = spark.createDataFrame(tags, "way_id long, tags map<string,string>")
    assert {r.way_id for r in rails.rail_ways(ways).collect()} == {1, 7} and {r.way_id for r in rails.rail_ways(ways, city=True).collect()} == {4}


def contracted(edges):
    """Joined edges by hand: sets of original edges, and end nodes, of chains through nodes of two ends."""
    at = {}
    for k, (a, b) in enumerate(edges):
        at.setdefault(a, []).append(2 * k)
        at.setdefault(b, []).append(2 * k + 1)
    link = {}
    for ends in at.values():
        if len(ends) == 2:
            link[ends[0]], link[ends[1]] = ends[1], ends[0]
    out = []
    for ring, w in chain_by_hand(len(edges), link):
        nodes = [edges[i][::-1] if f else edges[i] for i, f in w]
        out.append((nodes[0][0], nodes[-1][1], [nodes[0][0]] + [b for _, b in nodes], len(w), ring))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_contract_by_walking(spark, seed):
    rnd = random.Random(seed)
    edges = [tuple(rnd.sample(range(26), 2)) for _ in range(22)] + [(100, 101), (101, 102), (102, 100), (200, 200)]
    edges += [(300 + k, 301 + k) if rnd.random() < 0.5 else (301 + k, 300 + k) for k in range(30)]
    rows = [(f"{k:04d}", a, b, [{"node": x, "lat": float(x), "lng": 0.0} for x in (a, b)]) for k, (a, b) in enumerate(edges)]
    df = rails.contract(spark.createDataFrame(rows, f"edge_id string, from_node long, to_node long, points {POINT}"))
    got = sorted((r.from_node, r.to_node, [p.node for p in r.points], r.n_edges, r.ring) for r in df.collect())
    want = [(a, b, [x for i, x in enumerate(w) if not i or x != w[i - 1]], n, ring) for a, b, w, n, ring in contracted(edges)]
    assert got == want and sum(r[-1] for r in got) >= 2


def nearest(graph, source, limit):
    best, queue = {}, [(0.0, source)]
    while queue:
        d, x = heapq.heappop(queue)
        if x in best:
            continue
        best[x] = d
        for y, w in graph.get(x, []):
            if d + w < limit:
                heapq.heappush(queue, (d + w, y))
    return best


@pytest.mark.parametrize("seed", range(2))
def test_bounded_ways_by_dijkstra(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(30), rnd.randrange(30), float(rnd.randint(0, 9))) for _ in range(55)]
    graph = {}
    for a, b, w in edges:
        graph.setdefault(a, []).append((b, w))
        graph.setdefault(b, []).append((a, w))
    pairs = [(s, rnd.randrange(30), float(rnd.choice([5, 12, 40]))) for s in range(12) for _ in range(3)]
    got = rails.bounded_ways(spark.createDataFrame(edges, "from_node long, to_node long, km double"), spark.createDataFrame(pairs, "source long, goal long, limit double")).collect()
    want = {}
    for s, g, limit in pairs:
        d = nearest(graph, s, limit).get(g)
        if d is not None:
            want[s, g] = d
    assert {(r.source, r.goal): r.km for r in got} == want
    for r in got:
        assert r.nodes[0] == r.source and r.nodes[-1] == r.goal
        assert sum(min(w for y, w in graph[a] if y == b) for a, b in zip(r.nodes, r.nodes[1:], strict=False)) == r.km


def test_rail_strategy(spark):
    # a line of ways past three stations; the third lies at an inner point, a fourth is out of reach
    places = {1: (0, 0), 2: (1000, 0), 3: (2000, 300), 4: (3000, 300), 5: (4000, 0), 6: (4000, 5000)}
    nodes = spark.createDataFrame([(n, 50 + y * DEGREE, 8 + x * DEGREE) for n, (y, x) in places.items()], "node long, lat double, lng double")
    ways = spark.createDataFrame([(1, [1, 2, 3], {"railway": "rail"}), (2, [5, 4, 3], {"railway": "rail"}), (3, [1, 5], {"railway": "tram"}), (4, [5, 6, 77], {"railway": "rail"})], "way_id long, nodes array<long>, tags map<string,string>")
    stations = spark.createDataFrame([(10, 50.0, 8 + 100 * DEGREE), (20, 50 + 3000 * DEGREE, 8 + 350 * DEGREE), (30, 50 + 4000 * DEGREE, 8.0), (40, 51.0, 8.0)], "station_id long, lat double, lng double")
    edges, at = rails.rail_graph(ways, nodes, stations)
    assert {(r.station_id, r.node) for r in at.collect()} == {(10, 1), (20, 4), (30, 5)}
    # one chain from 1 to 6 (node 77 has no position, so the way ends at 6), cut at nodes 4 and 5
    assert {tuple(sorted((r.from_node, r.to_node))) for r in edges.collect()} >= {(1, 4), (4, 5)}
    pairs = spark.createDataFrame([(10, 20), (30, 20), (10, 40)], "from_station long, to_station long")
    ways_ = rails.rail_edges(pairs, edges, at)
    got = {(r.from_station, r.to_station): (r.cost, [(round((p.lat - 50) / DEGREE), round((p.lng - 8) / DEGREE)) for p in r.points]) for r in ways_.collect()}
    assert set(got) == {(10, 20), (30, 20)}
    assert got[10, 20][1] == [(0, 0), (1000, 0), (2000, 300), (3000, 300)] and got[30, 20][1] == [(4000, 0), (3000, 300)]
    asked = pairs.crossJoin(spark.createDataFrame([("railway",), ("ship",), ("bus",)], "category string"))
    offered = {"rail": ways_, "relation": ways_.filter("from_station = 30").withColumn("cost", F.col("cost") * 0.1)}
    chosen = {(r.from_station, r.to_station, r.category): r.strategy for r in rails.routes(asked, stations, offered).collect()}
    assert chosen == {(10, 20, "railway"): "rail", (30, 20, "railway"): "relation", (10, 40, "railway"): "stub", (10, 20, "bus"): "stub", (30, 20, "bus"): "relation", (10, 40, "bus"): "stub", (10, 20, "ship"): "stub", (30, 20, "ship"): "stub", (10, 40, "ship"): "stub"}
    # the nodes also go into the layered choice of a sequence
    seq = spark.createDataFrame([(1, 0, 10, 20), (1, 1, 20, 30)], "sequence_id long, segment int, from_station long, to_station long")
    both = ways_.select("from_node", "to_node", "cost").unionByName(ways_.select(F.col("to_node").alias("from_node"), F.col("from_node").alias("to_node"), "cost"))
    assert {(r.segment, r.from_node, r.to_node) for r in paths.prepare(seq, at, both).collect()} == {(0, 1, 4), (1, 4, 5)}
