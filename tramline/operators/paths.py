"""Path geometry: lookups by station sequence, layered shortest paths, simplification, statistics.

A polyline is an array of (lat, lng) structs; a stored path has (stations array, clasz, segment,
points).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import haversine_km, radius_join

POINTS = "array<struct<lat:double,lng:double>>"
#: Cost factors of the routing strategies, and reach of a relation's line in metres.
RELATION_FACTOR, STUB_FACTOR, NEAR_METERS = 0.1, 5.0, 200.0


def line_km(points: Column) -> Column:
    """Length of a polyline."""
    n = F.size(points)
    step = lambda i: haversine_km(points[i - 1]["lat"], points[i - 1]["lng"], points[i]["lat"], points[i]["lng"])
    return F.when(n > 1, F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0.0), lambda s, i: s + step(i))).otherwise(0.0)


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Initial bearing in degrees from north, 0 to 360."""
    y = F.sin(F.radians(lng2 - lng1)) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lng2 - lng1))
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def part_of(points: Column, first: Column, last: Column) -> Column:
    """Points ``first`` to ``last`` (from 0, ends included), reversed where last < first."""
    cut = F.slice(points, F.least(first, last) + 1, F.abs(last - first) + 1)
    return F.when(last >= first, cut).otherwise(F.reverse(cut))


def simplify(lines: DataFrame, zoom: int, points: str = "points") -> DataFrame:
    """Douglas-Peucker by zoom level: points nearer to the line of their neighbours than a pixel are left out."""
    tolerance = 360.0 / (256 * 2**zoom)

    def keep(line: list) -> list:
        if line is None or len(line) < 3:
            return line
        kept, todo = {0, len(line) - 1}, [(0, len(line) - 1)]
        while todo:
            a, b = todo.pop()
            (ay, ax), (by, bx) = (line[a]["lat"], line[a]["lng"]), (line[b]["lat"], line[b]["lng"])
            norm, far, at = math.hypot(bx - ax, by - ay), tolerance, None
            for i in range(a + 1, b):
                y, x = line[i]["lat"], line[i]["lng"]
                d = abs((bx - ax) * (ay - y) - (ax - x) * (by - ay)) / norm if norm else math.hypot(x - ax, y - ay)
                if d > far:
                    far, at = d, i
            if at is not None:
                kept.add(at)
                todo += [(a, at), (at, b)]
        return [line[i] for i in sorted(kept)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f[points] = [keep(x) for x in f[points]]
            yield f

    return lines.mapInPandas(run, lines.schema)


def segment_paths(segments: DataFrame, paths: DataFrame, stations: DataFrame) -> DataFrame:
    """Segments (stations, clasz, segment, from_station, to_station) with ``points``: the stored path of the station
    sequence and class, else the straight line."""
    at = lambda c, x: stations.select(F.col("station_id").alias(c), F.struct("lat", "lng").alias(x))
    rows = segments.join(paths.select("stations", "clasz", "segment", F.col("points").alias("_p")), ["stations", "clasz", "segment"], "left")
    rows = rows.join(at("from_station", "_a"), "from_station").join(at("to_station", "_b"), "to_station")
    return rows.withColumn("points", F.coalesce("_p", F.array("_a", "_b"))).drop("_p", "_a", "_b")


def trip_paths(trips: DataFrame, paths: DataFrame, stations: DataFrame) -> DataFrame:
    """(trip_id, segment, points) of trips (trip_id, stations array, clasz)."""
    rows = trips.select("trip_id", "stations", "clasz", F.posexplode(F.slice("stations", F.lit(1), F.greatest(F.size("stations") - 1, F.lit(0)))).alias("segment", "from_station"))
    rows = rows.withColumn("to_station", F.col("stations")[F.col("segment") + 1])
    return segment_paths(rows, paths, stations).select("trip_id", "segment", "points")


def near_lines(places: DataFrame, lines: DataFrame, meters: float = NEAR_METERS) -> DataFrame:
    """(station_id, line_id, point, meters): the nearest point of each polyline within reach of a station."""
    pts = lines.select("line_id", F.posexplode("points").alias("point", "_x")).select("line_id", "point", F.col("_x.lat").alias("plat"), F.col("_x.lng").alias("plng"))
    rows = radius_join(places.select("station_id", "lat", "lng"), pts, meters / 1000).withColumn("meters", F.col("km") * 1000)
    best = rows.groupBy("station_id", "line_id").agg(F.min(F.struct("meters", "point")).alias("b"))
    return best.select("station_id", "line_id", "b.point", "b.meters")


def relation_edges(near: DataFrame, lines: DataFrame) -> DataFrame:
    """Directed edges between stations on one line: the length along it, times the relation factor."""
    a = near.select("line_id", F.col("station_id").alias("from_station"), F.col("point").alias("first"))
    b = near.select("line_id", F.col("station_id").alias("to_station"), F.col("point").alias("last"))
    rows = a.join(b, "line_id").filter("from_station <> to_station").join(lines.select("line_id", "points"), "line_id")
    rows = rows.withColumn("points", part_of(F.col("points"), F.col("first"), F.col("last")))
    return rows.select("from_station", "to_station", F.lit("relation").alias("strategy"), (line_km(F.col("points")) * RELATION_FACTOR).alias("cost"), "points")


def stub_edges(pairs: DataFrame, stations: DataFrame) -> DataFrame:
    """Straight lines between station pairs, dear enough that any other strategy is preferred."""
    at = lambda c, x: stations.select(F.col("station_id").alias(c), F.struct("lat", "lng").alias(x))
    rows = pairs.join(at("from_station", "_a"), "from_station").join(at("to_station", "_b"), "to_station")
    points = F.array("_a", "_b")
    return rows.select("from_station", "to_station", F.lit("stub").alias("strategy"), (line_km(points) * STUB_FACTOR).alias("cost"), points.alias("points"))


def prepare(sequences: DataFrame, candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """(sequence_id, segment, from_node, to_node, cost): the cheapest way through each sequence's candidate nodes.

    ``sequences`` (sequence_id, segment, from_station, to_station), ``candidates`` (station_id, node,
    entry cost), ``edges`` (from_node, to_node, cost).  Layers are segments: one step forward per
    segment keeps each node's best cost and predecessor, one step back reads the way.
    """
    from .relational import cut

    n = sequences.agg(F.max("segment")).first()[0]
    if n is None:
        return sequences.select("sequence_id", "segment", F.lit(None).cast("long").alias("from_node"), F.lit(None).cast("long").alias("to_node"), F.lit(None).cast("double").alias("cost"))
    into = lambda c, x: candidates.select(F.col("station_id").alias(c), F.col("node").alias(x), F.col("cost").alias(f"{x}_cost"))
    layers, best = [], None
    for k in range(n + 1):
        now = sequences.filter(F.col("segment") == k).join(into("from_station", "from_node"), "from_station").join(into("to_station", "to_node"), "to_station")
        now = now.join(edges.select("from_node", "to_node", F.col("cost").alias("_e")), ["from_node", "to_node"])
        if best is None:
            now = now.withColumn("_c", F.col("from_node_cost") + F.col("_e") + F.col("to_node_cost"))
        else:
            now = now.join(best, ["sequence_id", "from_node"]).withColumn("_c", F.col("_before") + F.col("_e") + F.col("to_node_cost"))
        now = cut(now.groupBy("sequence_id", "segment", "to_node").agg(F.min(F.struct(F.col("_c").alias("c"), "from_node", F.col("_e").alias("e"))).alias("b")))
        layers.append(now)
        best = now.select("sequence_id", F.col("to_node").alias("from_node"), F.col("b.c").alias("_before"))
    ends = sequences.groupBy("sequence_id").agg(F.max("segment").alias("segment"))
    out, at = None, None
    for k in range(n, -1, -1):
        last = layers[k].join(ends.filter(F.col("segment") == k), ["sequence_id", "segment"]).groupBy("sequence_id").agg(F.min_by("to_node", F.struct(F.col("b.c"), "to_node")).alias("to_node"))
        at = last if at is None else at.unionByName(last)
        step = layers[k].join(at, ["sequence_id", "to_node"]).select("sequence_id", "segment", F.col("b.from_node").alias("from_node"), "to_node", F.col("b.e").alias("cost"))
        out = step if out is None else out.unionByName(step)
        at = step.select("sequence_id", F.col("from_node").alias("to_node"))
    return out


def filter_sequences(sequences: DataFrame, station: int | None = None, exact: list[int] | None = None, polygon: list[tuple[float, float]] | None = None, stations: DataFrame | None = None, drop_classes: list[int] | None = None, limit: int | None = None) -> DataFrame:
    """Sequences (stations, classes) through a station, equal to a sequence, wholly inside a polygon, without classes."""
    rows = sequences
    if station is not None:
        rows = rows.filter(F.array_contains("stations", station))
    if exact is not None:
        rows = rows.filter(F.col("stations") == F.array(*map(F.lit, exact)))
    if polygon is not None:
        outside = stations.filter(~in_polygon(F.col("lat"), F.col("lng"), polygon)).select("station_id")
        bad = rows.select("stations", F.explode("stations").alias("station_id")).join(outside, "station_id", "left_semi").select("stations").distinct()
        rows = rows.join(bad, "stations", "left_anti")
    if drop_classes is not None:
        rows = rows.withColumn("classes", F.array_except("classes", F.array(*[F.lit(c) for c in drop_classes]))).filter(F.size("classes") > 0)
    return rows if limit is None else rows.orderBy("stations").limit(limit)


def in_polygon(lat: Column, lng: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a polygon of (lat, lng) corners: an odd number of edges is crossed to the east."""
    crossed = F.lit(0)
    for (y1, x1), (y2, x2) in zip(corners, [*corners[1:], corners[0]], strict=True):
        if y1 == y2:
            continue
        at = F.lit(x1) + (lat - y1) * ((x2 - x1) / (y2 - y1))
        crossed = crossed + F.when(((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lng < at), 1).otherwise(0)
    return crossed % 2 == 1


def boxes(paths: DataFrame) -> DataFrame:
    """Bounding box of the stored paths of each unordered station pair (stations, segment, points)."""
    a, b = F.col("stations")[F.col("segment")], F.col("stations")[F.col("segment") + 1]
    rows = paths.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.explode("points").alias("p"))
    return rows.groupBy("a", "b").agg(F.min("p.lat").alias("min_lat"), F.max("p.lat").alias("max_lat"), F.min("p.lng").alias("min_lng"), F.max("p.lng").alias("max_lng"))


def statistics(paths: DataFrame, stations: DataFrame) -> DataFrame:
    """Per class: sequences, segments, points, mean length, and the share of straight lines and of detours (twice the
    straight distance and more)."""
    at = lambda x: stations.select(F.col("station_id").alias(x), F.col("lat").alias(f"{x}_lat"), F.col("lng").alias(f"{x}_lng"))
    rows = paths.withColumn("a", F.col("stations")[F.col("segment")]).withColumn("b", F.col("stations")[F.col("segment") + 1])
    rows = rows.join(at("a"), "a").join(at("b"), "b").withColumn("km", line_km(F.col("points")))
    rows = rows.withColumn("straight", haversine_km(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng")))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return rows.groupBy("clasz").agg(F.countDistinct("stations").alias("n_sequences"), F.count(F.lit(1)).alias("n_segments"), F.sum(F.size("points")).alias("n_points"), F.avg("km").alias("mean_km"), share(F.size("points") == 2).alias("stubs"), share(F.col("km") >= 2 * F.col("straight")).alias("detours"))


def differences(one: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of either path table that the other lacks, with ``side`` 1 or 2: none where they are equal."""
    a, b = one.select(*sorted(one.columns)), other.select(*sorted(one.columns))
    return a.exceptAll(b).withColumn("side", F.lit(1)).unionByName(b.exceptAll(a).withColumn("side", F.lit(2)))


def geojson(lines: DataFrame, properties: list[str], points: str = "points") -> DataFrame:
    """(feature): each polyline as a GeoJSON feature."""
    coordinates = F.transform(points, lambda p: F.array(p["lng"], p["lat"]))
    shape = F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates"))
    return lines.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), shape.alias("geometry"))).alias("feature"))


def contract_ways(ways: DataFrame) -> DataFrame:
    """(edge_id, from_node, to_node, nodes): ways (way_id, nodes array) split at nodes that several share or that end one.

    Node uses are counted over all ways; between two such nodes a way's inner nodes belong to one edge.
    """
    uses = ways.select("way_id", F.posexplode("nodes").alias("i", "node"), F.size("nodes").alias("n"))
    ends = (F.col("i") == 0) | (F.col("i") == F.col("n") - 1)
    joint = uses.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.max(ends).alias("e")).filter("c > 1 OR e").select("node")
    cuts = uses.join(joint, "node").groupBy("way_id").agg(F.array_sort(F.collect_list("i")).alias("cuts"))
    rows = ways.join(cuts, "way_id").select("way_id", "nodes", "cuts", F.posexplode(F.slice("cuts", F.lit(1), F.size("cuts") - 1)).alias("k", "first"))
    last = F.col("cuts")[F.col("k") + 1]
    rows = rows.withColumn("part", F.slice("nodes", F.col("first") + 1, last - F.col("first") + 1))
    return rows.select(F.concat_ws("/", "way_id", "k").alias("edge_id"), F.col("part")[0].alias("from_node"), F.element_at("part", -1).alias("to_node"), F.col("part").alias("nodes"))


def bus_stops(stops: DataFrame, stations: DataFrame, meters: float = 100.0) -> DataFrame:
    """(station_id, lat, lng): mapped bus stops within reach of stations other than railway ones (80...)."""
    s = stations.filter(~F.col("station_id").cast("string").startswith("80")).select("station_id", F.col("lat").alias("plat"), F.col("lng").alias("plng"))
    return radius_join(stops.select("lat", "lng"), s.select(F.col("station_id").alias("place"), "plat", "plng"), meters / 1000).select(F.col("place").alias("station_id"), "lat", "lng")


def regions(rows: DataFrame) -> DataFrame:
    """(place_id, regions): names of the regions of a place (place_id, name, admin_level), the smallest first."""
    return rows.groupBy("place_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("admin_level")).alias("l"), "name"))), lambda x: x["name"]).alias("regions"))


def address_guesses(places: DataFrame, typed: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, place_id, place): per query (query_id, text) the ``k`` heaviest places with a name that begins so.

    Names are entered under their prefixes of up to three letters, so a query meets those of its own.
    """
    first = lambda t: F.substring(F.lower(t), 1, 3)
    p = places.withColumn("_k", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.substring(F.lower(F.col("name")), F.lit(1), n)))))
    rows = typed.withColumn("_k", first(F.col("text"))).join(p, "_k").filter(F.lower("name").startswith(F.lower("text")))
    w = Window.partitionBy("query_id").orderBy(F.desc("weight"), "place_id")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("query_id", "place_id", "place")
