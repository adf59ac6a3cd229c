"""Lines and rail graphs from map data: chains of ways, contracted graphs, bounded shortest ways, strategies by category.

A located point is a struct (node, lat, lng).  An edge has (edge_id, from_node, to_node, points of located points).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paths import NEAR_METERS, bearing, contract_ways, line_km, stub_edges
from .relational import cut, haversine_km, radius_join

#: Reach (metres) and least turn (degrees) where two ways of a relation may be joined without a common node.
JOIN_METERS, LEAST_TURN = 10.0, 45.0
#: Fixed value: a way on rails may be this often as long as the longest straight line to a goal.
DETOUR_LIMIT = 10.0
#: Map tags of railways and of city rails, and those that are left out.
RAIL, CITY_RAIL = ("rail",), ("light_rail", "subway")
NO_USAGE, NO_SERVICE = ("industrial", "military", "test", "tourism"), ("yard", "spur")
#: Strategies that a category of a sequence may use; all may use straight lines.
STRATEGIES = {"railway": ("relation", "rail", "stub"), "bus": ("relation", "road", "stub"), "subway": ("relation", "subway", "stub")}


def _flip(state: Column) -> Column:
    return state.bitwiseXOR(F.lit(1))


def _runs(states: DataFrame) -> DataFrame:
    """(s, to, hops, open, low): the last state of each list, found by jumps that double; states of rings stay open,
    ``low`` is then the smallest one of their ring."""
    now, seen = states, None
    while True:
        todo, done = now.filter("open"), now.filter("NOT open")
        total = todo.agg(F.count(F.lit(1)), F.sum(F.xxhash64("low").cast("decimal(38,0)"))).first()
        if not total[0] or total == seen:
            return now
        far = now.select(F.col("s").alias("to"), F.col("to").alias("_to"), F.col("hops").alias("_h"), F.col("open").alias("_o"), F.col("low").alias("_l"))
        step = todo.join(far, "to").select("s", F.col("_to").alias("to"), (F.col("hops") + F.col("_h")).alias("hops"), F.col("_o").alias("open"), F.least("low", "_l").alias("low"))
        now, seen = cut(done.unionByName(step)), total


def chains(items: DataFrame, links: DataFrame) -> DataFrame:
    """(item, chain, place, flipped, ring): items with two ends in the order in which their ends are linked.

    ``items`` (item) are distinct numbers from 0; the ends of item i are 2i (front) and 2i + 1 (back).  ``links`` (a, b)
    holds both directions, each end at most once as ``a`` and never with itself.  A chain is named after its first item: it
    begins at an open front if it has one, of the smallest item; rings begin at the front of their smallest item.  Chains
    of any length take as many joins as their length has binary digits; no task sees a whole chain.
    """
    walk = items.select(F.explode(F.array(F.col("item") * 2, F.col("item") * 2 + 1)).alias("s")).withColumn("a", _flip(F.col("s")))
    walk = walk.join(links.select("a", F.col("b").alias("_n")), "a", "left")
    first = walk.select("s", F.coalesce("_n", "s").alias("to"), F.col("_n").isNotNull().cast("long").alias("hops"), F.col("_n").isNotNull().alias("open"), F.col("s").alias("low"))
    runs = _runs(cut(first))
    lists = runs.filter("NOT open")
    mirror = lists.select(_flip(F.col("s")).alias("s"), _flip(F.col("to")).alias("first"), F.col("hops").alias("place"))
    rows = lists.join(mirror, "s")
    key = lambda c: F.struct(c.bitwiseAND(F.lit(1)), c)
    rows = rows.filter(key(F.col("first")) < key(_flip(F.col("to"))))
    half = lambda c: F.shiftright(c, 1)
    out = rows.select(half(F.col("s")).alias("item"), half(F.col("first")).alias("chain"), "place", (F.col("s") % 2 == 1).alias("flipped"), F.lit(False).alias("ring"))
    open_ = runs.filter("open")
    if open_.isEmpty():
        return out
    starts = open_.filter("low % 2 = 0").select(F.col("low").alias("a")).distinct()
    gone = links.join(starts, "a", "left_semi")
    gone = cut(gone.select("a").unionByName(gone.select(F.col("b").alias("a"))).distinct())
    in_rings = cut(open_.select(half(F.col("s")).alias("item")).distinct())
    return out.unionByName(chains(in_rings, links.join(gone, "a", "left_anti")).withColumn("ring", F.lit(True)))


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with ``item``, numbers that rise with ``order`` (a key of the rows); written, so that they stay as they are."""
    return cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("item", F.monotonically_increasing_id()))


def _strung(rows: DataFrame, *by: str) -> DataFrame:
    """(by, points): point arrays of the rows (place, flipped, points) in order, repeated neighbours once."""
    turned = rows.withColumn("points", F.when(F.col("flipped"), F.reverse("points")).otherwise(F.col("points")))
    rows = turned.groupBy(*by).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "points"))), lambda x: x["points"])).alias("points"))
    here = lambda x, i: (i == 0) | (F.struct(x["lat"], x["lng"]) != F.struct(F.get(F.col("points"), i - 1)["lat"], F.get(F.col("points"), i - 1)["lng"]))
    return rows.withColumn("points", F.filter("points", here))


def way_links(ends: DataFrame, meters: float = JOIN_METERS, turn: float = LEAST_TURN) -> DataFrame:
    """(a, b), both directions: ends of ways that follow one another in their relation.

    ``ends`` (relation_id, item, end, node, lat, lng, bearing to the next point inside).  An end goes on in the only end of
    another way at its node; where no other way has the node, in the only one nearer than ``meters``, unless the way would
    turn back (less than ``turn`` degrees between both).  Several candidates join nothing, and both ends must choose
    each other.  Ends are counted and summed by node, so no pairs are made at one; pairs are of different nodes within reach.
    """
    key = ["relation_id", "node"]
    amount = lambda n, t: (F.count(F.lit(1)).alias(n), F.sum(F.col("end").cast("decimal(38,0)")).alias(t))
    at = cut(ends.groupBy(*key).agg(*amount("n", "total"), F.first("lat").alias("plat"), F.first("lng").alias("plng")))
    own = cut(ends.groupBy(*key, "item").agg(*amount("own_n", "own_total")))
    met = ends.join(own, [*key, "item"]).join(at, key).withColumn("others", F.col("n") - F.col("own_n"))
    same = met.filter("others = 1").select("end", (F.col("total") - F.col("own_total")).cast("long").alias("next"))
    lone = met.filter("others = 0").select("relation_id", "item", "end", F.col("node").alias("_node"), "bearing", "lat", "lng")
    near = radius_join(lone, at.select(*key, "n", "total", "plat", "plng"), meters / 1000, by=["relation_id"]).filter((F.col("node") != F.col("_node")) & (F.col("km") * 1000 < meters))
    near = near.join(own, [*key, "item"], "left").withColumn("n", F.col("n") - F.coalesce("own_n", F.lit(0))).withColumn("total", F.col("total") - F.coalesce("own_total", F.lit(0)))
    one = near.groupBy("end", "bearing").agg(F.sum("n").alias("n"), F.sum("total").alias("next")).filter("n = 1").withColumn("next", F.col("next").cast("long"))
    one = one.join(ends.select(F.col("end").alias("next"), F.col("bearing").alias("_b")), "next")
    apart = F.abs(F.col("bearing") - F.col("_b"))
    chosen = cut(same.unionByName(one.filter(F.least(apart, 360.0 - apart) >= turn).select("end", "next")))
    back = chosen.select(F.col("next").alias("end"), F.col("end").alias("next"))
    return chosen.join(back, ["end", "next"], "left_semi").select(F.col("end").alias("a"), F.col("next").alias("b"))


def relation_lines(ways: DataFrame, meters: float = JOIN_METERS, turn: float = LEAST_TURN) -> DataFrame:
    """(line_id, relation_id, n_ways, points): the lines that the ways of each relation form.

    ``ways`` (relation_id, place, points of located points), a way of a relation at each place; ways of fewer than two points, or
    null ones, are left out.  A line joins two ways and more; single ways and rings give none.  Lines run from the open
    front of their first way by place, or from its back where no end of the line is a front.
    """
    rows = _numbered(ways.filter(F.size("points") >= 2).select("relation_id", "place", "points"), "relation_id", "place")

    def end(side: int, outer: Column, inner: Column) -> DataFrame:
        return rows.select("relation_id", "item", (F.col("item") * 2 + side).alias("end"), outer["node"].alias("node"), outer["lat"].alias("lat"), outer["lng"].alias("lng"), bearing(outer["lat"], outer["lng"], inner["lat"], inner["lng"]).alias("bearing"))

    at = lambda i: F.element_at("points", i)
    ends = cut(end(0, at(1), at(2)).unionByName(end(1, at(-1), at(-2))))
    order = cut(chains(rows.select("item"), way_links(ends, meters, turn)).filter("NOT ring"))
    many = order.groupBy("chain").agg(F.count(F.lit(1)).alias("n_ways")).filter("n_ways > 1")
    parts = order.join(many, "chain").join(rows.select("item", "points"), "item")
    lines = _strung(parts, "chain", "n_ways").join(rows.select(F.col("item").alias("chain"), "relation_id", "place"), "chain")
    return lines.select(F.concat_ws("/", "relation_id", "place").alias("line_id"), "relation_id", "n_ways", F.transform("points", lambda p: F.struct(p["lat"].alias("lat"), p["lng"].alias("lng"))).alias("points"))


def rail_ways(ways: DataFrame, city: bool = False) -> DataFrame:
    """Ways (tags map) of railways in public use, or of city rails; null tags count as none."""
    tag = lambda k: F.coalesce(F.col("tags")[k], F.lit(""))
    rows = ways.filter(tag("railway").isin(*(CITY_RAIL if city else RAIL)) & ~tag("usage").isin(*NO_USAGE))
    return rows if city else rows.filter(~tag("service").isin(*NO_SERVICE) & (tag("railway:preserved") != "yes"))


def located(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (edge_id, from_node, to_node, nodes array) with ``points``; nodes without a position (node, lat, lng) are left
    out of the line, and an edge without two of them goes."""
    rows = edges.select("edge_id", "from_node", "to_node", F.posexplode("nodes").alias("i", "node")).join(nodes.select("node", "lat", "lng"), "node")
    rows = rows.groupBy("edge_id", "from_node", "to_node").agg(F.array_sort(F.collect_list(F.struct("i", "node", "lat", "lng"))).alias("p"))
    return rows.filter("size(p) > 1").select("edge_id", "from_node", "to_node", F.transform("p", lambda x: F.struct(x["node"].alias("node"), x["lat"].alias("lat"), x["lng"].alias("lng"))).alias("points"))


def contract(edges: DataFrame) -> DataFrame:
    """Edges joined across nodes where exactly two edge ends meet, with ``n_edges`` and ``ring``.

    A ring without a junction stays one edge from a node to itself, with ``ring`` true: the report of cycles.
    """
    rows = _numbered(edges.select("edge_id", "from_node", "to_node", "points"), "edge_id")
    ends = rows.select((F.col("item") * 2).alias("a"), F.col("from_node").alias("node")).unionByName(rows.select((F.col("item") * 2 + 1).alias("a"), F.col("to_node").alias("node")))
    two = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("a").cast("decimal(38,0)")).alias("t")).filter("n = 2")
    links = cut(ends.join(two, "node").select("a", (F.col("t") - F.col("a")).cast("long").alias("b")))
    order = cut(chains(rows.select("item"), links))
    parts = order.join(rows.select("item", "points", "from_node", "to_node"), "item")
    left, right = F.when(F.col("flipped"), F.col("to_node")).otherwise(F.col("from_node")), F.when(F.col("flipped"), F.col("from_node")).otherwise(F.col("to_node"))
    ends_of = parts.groupBy("chain").agg(F.min_by(left, "place").alias("from_node"), F.max_by(right, "place").alias("to_node"), F.count(F.lit(1)).alias("n_edges"), F.max("ring").alias("ring"))
    lines = _strung(parts.select("chain", "place", "flipped", "points"), "chain").join(ends_of, "chain")
    return lines.join(rows.select(F.col("item").alias("chain"), "edge_id"), "chain").select("edge_id", "from_node", "to_node", "points", "n_edges", "ring")


def snap(edges: DataFrame, stations: DataFrame, meters: float = NEAR_METERS) -> tuple[DataFrame, DataFrame]:
    """(edges split at the nearest point to each station in reach, candidates (station_id, node, cost in km))."""
    pts = edges.select("edge_id", F.size("points").alias("n"), F.posexplode("points").alias("i", "p")).select("edge_id", "n", "i", "p.node", F.col("p.lat").alias("plat"), F.col("p.lng").alias("plng"))
    near = radius_join(stations.select("station_id", "lat", "lng"), pts, meters / 1000)
    best = cut(near.groupBy("edge_id", "station_id").agg(F.min(F.struct("km", "i", "node", "n")).alias("b")))
    candidates = best.groupBy("station_id", F.col("b.node").alias("node")).agg(F.min("b.km").alias("cost"))
    inner = best.filter("b.i > 0 AND b.i < b.n - 1").groupBy("edge_id").agg(F.collect_set("b.i").alias("cuts"))
    rows = edges.select("edge_id", "points").join(inner, "edge_id", "left")
    rows = rows.withColumn("cuts", F.array_sort(F.array_union(F.coalesce("cuts", F.array().cast("array<int>")), F.array(F.lit(0), F.size("points") - 1))))
    rows = rows.select("edge_id", "points", "cuts", F.posexplode(F.slice("cuts", F.lit(1), F.size("cuts") - 1)).alias("k", "first"))
    rows = rows.withColumn("points", F.slice("points", F.col("first") + 1, F.col("cuts")[F.col("k") + 1] - F.col("first") + 1))
    return rows.select(F.concat_ws("+", "edge_id", "k").alias("edge_id"), F.col("points")[0]["node"].alias("from_node"), F.element_at("points", -1)["node"].alias("to_node"), "points"), candidates


def rail_graph(ways: DataFrame, nodes: DataFrame, stations: DataFrame, city: bool = False, meters: float = NEAR_METERS) -> tuple[DataFrame, DataFrame]:
    """(edges, candidates) of map ways (way_id, nodes array, tags map): filtered, split, contracted, met by stations."""
    edges, at = snap(contract(located(contract_ways(rail_ways(ways, city)), nodes)), stations, meters)
    return cut(edges), cut(at)


def bounded_ways(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source, goal, km, nodes): shortest ways shorter than each pair's ``limit`` km, in either direction of the edges.

    ``edges`` (from_node, to_node, km not negative), ``pairs`` (source, goal, limit).  All sources grow at once, one edge per
    round, and only labels that improved go on.  A source's labels end at its largest limit and, once it has reached all
    its goals, at the farthest of them.
    """
    pairs = cut(pairs.groupBy("source", "goal").agg(F.max("limit").alias("limit")))
    both = edges.select(F.col("from_node").alias("a"), F.col("to_node").alias("b"), "km").unionByName(edges.select(F.col("to_node").alias("a"), F.col("from_node").alias("b"), "km"))
    near = cut(both.filter("a <> b").groupBy("a", "b").agg(F.min("km").alias("km")))
    ends = pairs.groupBy("source").agg(F.max("limit").alias("limit"))
    delta = known = cut(pairs.select("source", F.col("source").alias("node"), F.lit(0.0).alias("km"), F.array("source").alias("nodes")).distinct())
    while not delta.isEmpty():
        got = pairs.join(known.select("source", F.col("node").alias("goal"), F.col("km").alias("_d")), ["source", "goal"], "left")
        far = got.groupBy("source").agg(F.max(F.col("_d").isNull()).alias("_open"), F.max("_d").alias("_far")).join(ends, "source")
        bound = far.select("source", F.when(F.col("_open"), F.col("limit")).otherwise(F.least("limit", "_far")).alias("_bound"))
        step = delta.join(near.withColumnRenamed("km", "_e"), F.col("node") == F.col("a")).join(bound, "source").withColumn("km", F.col("km") + F.col("_e")).filter("km < _bound")
        step = step.groupBy("source", F.col("b").alias("node")).agg(F.min(F.struct("km", F.concat("nodes", F.array("b")).alias("nodes"))).alias("m")).select("source", "node", "m.km", "m.nodes")
        delta = cut(step.join(known.select("source", "node", F.col("km").alias("_old")), ["source", "node"], "left").filter("_old IS NULL OR km < _old").drop("_old"))
        known = cut(known.join(delta.select("source", "node"), ["source", "node"], "left_anti").unionByName(delta))
    return pairs.join(known.withColumnRenamed("node", "goal"), ["source", "goal"]).filter("km < limit OR source = goal").select("source", "goal", "km", "nodes")


def _line_of(ways: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, points): the line along the nodes of each way, over the shortest edge between each two."""
    step = lambda a, b, turn: edges.select(F.col(a).alias("_a"), F.col(b).alias("_b"), F.struct("km", F.col("edge_id").alias("e"), F.lit(turn).alias("t"), F.col("points").alias("p")).alias("x"))
    best = step("from_node", "to_node", False).unionByName(step("to_node", "from_node", True)).groupBy("_a", "_b").agg(F.min("x").alias("x"))
    rows = ways.filter("size(nodes) > 1").select(*by, "nodes", F.posexplode(F.slice("nodes", F.lit(1), F.size("nodes") - 1)).alias("place", "_a"))
    rows = rows.withColumn("_b", F.col("nodes")[F.col("place") + 1]).join(best, ["_a", "_b"]).select(*by, "place", F.col("x.t").alias("flipped"), F.col("x.p").alias("points"))
    return _strung(rows, *by).withColumn("points", F.transform("points", lambda p: F.struct(p["lat"].alias("lat"), p["lng"].alias("lng"))))


def rail_edges(pairs: DataFrame, edges: DataFrame, candidates: DataFrame, strategy: str = "rail", limit: float = DETOUR_LIMIT) -> DataFrame:
    """(from_station, to_station, from_node, to_node, strategy, cost, points): ways on rails between all candidates of station pairs.

    ``pairs`` (from_station, to_station); the limit of a candidate's search is ``limit`` times the longest straight line to a goal.
    """
    edges = cut(edges.withColumn("km", line_km(F.col("points"))))
    at = edges.select(F.explode(F.array(F.col("points")[0], F.element_at("points", -1))).alias("p")).select("p.node", "p.lat", "p.lng").dropDuplicates(["node"])
    near = candidates.join(at, "node")
    side = lambda s, n, p: near.select(F.col("station_id").alias(s), F.col("node").alias(n), F.col("lat").alias(f"{p}lat"), F.col("lng").alias(f"{p}lng"))
    asked = pairs.select("from_station", "to_station").distinct().join(side("from_station", "source", "a"), "from_station").join(side("to_station", "goal", "b"), "to_station")
    asked = cut(asked.withColumn("straight", haversine_km(F.col("alat"), F.col("alng"), F.col("blat"), F.col("blng"))))
    longest = asked.groupBy("source").agg((F.max("straight") * limit).alias("limit"))
    found = bounded_ways(edges.select("from_node", "to_node", "km"), asked.select("source", "goal").distinct().join(longest, "source"))
    lines = found.join(_line_of(found, edges, ["source", "goal"]), ["source", "goal"])
    rows = asked.join(lines, ["source", "goal"])
    return rows.select("from_station", "to_station", F.col("source").alias("from_node"), F.col("goal").alias("to_node"), F.lit(strategy).alias("strategy"), F.col("km").alias("cost"), "points")


def routes(pairs: DataFrame, stations: DataFrame, offered: dict[str, DataFrame]) -> DataFrame:
    """(from_station, to_station, category, strategy, cost, points): the cheapest line of each pair among its category's strategies.

    ``pairs`` (from_station, to_station, category); ``offered`` has edges (from_station, to_station, cost, points) by name of
    strategy.  Every known pair gets a straight line if nothing is cheaper; categories beside the three have only that.
    """
    asked = cut(pairs.select("from_station", "to_station", "category").distinct())
    every = stub_edges(asked.select("from_station", "to_station").distinct(), stations).withColumn("order", F.lit(9))
    names = sorted({n for ns in STRATEGIES.values() for n in ns} & set(offered) - {"stub"})
    for k, name in enumerate(names):
        every = every.unionByName(offered[name].select("from_station", "to_station", F.lit(name).alias("strategy"), "cost", "points", F.lit(k).alias("order")))
    allowed = F.col("strategy") == "stub"
    for category, ways in STRATEGIES.items():
        allowed = allowed | ((F.col("category") == category) & F.col("strategy").isin(*ways))
    rows = asked.join(every, ["from_station", "to_station"]).filter(allowed)
    best = rows.groupBy("from_station", "to_station", "category").agg(F.min_by(F.struct("strategy", "cost", "points"), F.struct("cost", "order")).alias("b"))
    return best.select("from_station", "to_station", "category", "b.*")
