"""Connection graphs: a journey with alternatives at every change, until its arrival is covered.

A graph is rows: its stops (where a traveller changes) and its parts (a ride, with the walk before it, from a
stop to the next).  All graphs of a batch grow together: in an iteration every stop that is still open asks for
an alternative, all distinct questions (goal, station, time) are one search, answers are kept for later
iterations, and new parts are rated leg by leg.  Distributions are arrays of (minute, p), bounded by the minutes
that a train may be late; the mass of a part is the probability that a traveller takes it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import query, search
from .relational import cut
from .reliability import DIST, EPS, arrival, as_array, departures, graph_arrival, one_point, simple_rating

#: Ends of every graph.
DEPARTURE, ARRIVAL = "departure", "arrival"
#: Minutes after the latest alternative from which the next one is looked for; alternatives at each stop of a tree.
LATER, IN_TREE = 1, 2

_RIDE = ["trip_id", "day", "enter", "exit", "enter_station", "exit_station", "dep", "arr"]
PART = ["graph", "stop", "alternative", "next_stop", "goal", "from_station", "leaves", *_RIDE, "reaches", "comes"]


@dataclass(frozen=True)
class Delays:
    """Where distributions come from; rides have (key, trip_id, day, enter, exit, dep, arr).

    ``start(rides)``: (key, minute, p), when a train would leave by itself; ``travel(rides)``: (key, delay,
    minute, p) of the delay gained until ``exit`` by departure delay; ``waiting(pairs)``: (key, wait), the
    minutes that a ride waits for the traveller's train, pairs having the ride's columns and feeder_trip;
    none waits without it.
    """

    start: Callable[[DataFrame], DataFrame]
    travel: Callable[[DataFrame], DataFrame]
    waiting: Callable[[DataFrame], DataFrame] | None = None


def elements(parts: DataFrame, conn: DataFrame) -> DataFrame:
    """(graph, stop, alternative, trip_id, day, seq, from_station, to_station, dep, arr): the sections that each part rides, in order of seq."""
    rides = parts.filter("trip_id IS NOT NULL").select("graph", "stop", "alternative", "trip_id", "day", "enter", "exit")
    c = conn.select("trip_id", "day", "seq", "from_station", "to_station", "dep", "arr")
    return rides.join(c, ["trip_id", "day"]).filter(F.col("seq").between(F.col("enter"), F.col("exit"))).drop("enter", "exit")


def graphs_of(journeys: DataFrame) -> DataFrame:
    """Journeys with the name of their graph: start, time, goal and changes."""
    return journeys.withColumn("graph", F.concat_ws("/", "start", "t0", "goal", "transfers"))


def split(journeys: DataFrame, footpaths: DataFrame | search.Walks) -> DataFrame:
    """Parts with their place ``leg`` from journeys (graph, stop, alternative, goal, station, rides).

    A journey is cut where it changes; the walk to the next train belongs to the part behind the stop and
    is done just before that train leaves.  Stops are named after the stop and alternative they follow.
    A journey without rides is a walk from the stop to the goal.
    """
    n, k = F.size("rides"), F.col("leg")
    rows = journeys.withColumn("_n", n).select("*", F.posexplode_outer("rides").alias("_k", "ride")).withColumn("leg", F.coalesce(F.col("_k") + 1, F.lit(1)))
    inner = lambda at: F.concat("stop", F.lit("/"), "alternative", F.lit("."), at)
    came_at = F.when(k == 1, F.col("station")).otherwise(F.get("rides", k - 2)["exit_station"])
    rows = rows.withColumn("_next", F.when(k >= F.col("_n"), F.lit(ARRIVAL)).otherwise(inner(k))).withColumn("from_station", came_at)
    rows = rows.withColumn("stop", F.when(k == 1, F.col("stop")).otherwise(inner(k - 1))).withColumn("alternative", F.when(k == 1, F.col("alternative")).otherwise(1))
    target = F.coalesce("ride.enter_station", "goal")
    rows = search.walk_between(rows.withColumn("_to", target), footpaths, "from_station", "_to", "_walk", loops=False)
    walk = F.coalesce("_walk", F.lit(0))
    on_foot = F.col("ride").isNull()
    last = k >= F.col("_n")
    return rows.select(
        "graph", "stop", F.col("alternative").cast("int").alias("alternative"), F.col("_next").alias("next_stop"), "goal", "from_station",
        F.when(on_foot, F.col("asked")).otherwise(F.col("ride.dep") - walk).alias("leaves"), *[F.col(f"ride.{c}").alias(c) for c in _RIDE],
        F.when(on_foot, F.col("goal")).when(last, F.col("ride.walk_to")).otherwise(F.col("ride.exit_station")).alias("reaches"),
        F.when(on_foot, F.col("asked") + walk).when(last, F.col("ride.walk_arr")).otherwise(F.col("ride.arr")).alias("comes"), "leg",
    )




def _filtered(dist: Column, upto: Column, late: bool = False) -> Column:
    return F.filter(dist, lambda x: (x["minute"] > upto) if late else (x["minute"] <= upto))


def rate(parts: DataFrame, at: DataFrame | None, footpaths: DataFrame | search.Walks, delays: Delays) -> DataFrame:
    """``parts`` with ``departing``, ``arriving`` and ``uncovered``: what the stop's arrivals leave to later alternatives.

    ``at`` (graph, stop, came, came_trip, uncovered) are the stops that the parts leave, None for first parts.
    Arrivals in time for the part (schedule and what it waits, less the change) are its own, the others stay.
    """
    rows = parts.withColumn("key", F.concat_ws("|", "graph", "stop", "alternative"))
    if at is None:
        rows = rows.withColumn("uncovered", F.array().cast(DIST)).withColumn("came", F.lit(None).cast("long"))
    else:
        rows = rows.join(at.select("graph", "stop", "came", F.col("came_trip").alias("feeder_trip"), "uncovered"), ["graph", "stop"])
        rows = search.walk_between(rows.withColumn("_to", F.coalesce("enter_station", "goal")), footpaths, "from_station", "_to", "transfer").drop("_to")
        rows = rows.withColumn("transfer", F.coalesce("transfer", F.lit(0)))
    if at is not None and delays.waiting is not None:
        rows = cut(rows)
        rows = rows.join(delays.waiting(rows.filter("trip_id IS NOT NULL")).select("key", F.col("wait").cast("long").alias("wait")), "key", "left")
    else:
        rows = rows.withColumn("wait", F.lit(0).cast("long"))
    rows = cut(rows.withColumn("wait", F.coalesce("wait", F.lit(0))))
    rides = rows.filter("trip_id IS NOT NULL")
    trains = rides.join(as_array(delays.start(rides), "key", name="own"), "key", "left").withColumn("own", F.coalesce("own", one_point(F.lit(0), F.lit(1.0))))
    if at is not None:
        latest = F.col("dep") + F.col("wait") - F.col("transfer") - F.col("came")
        shift = F.col("came") + F.col("transfer") - F.col("dep")
        change = F.transform(_filtered(F.col("uncovered"), latest), lambda x: F.struct((x["minute"] + shift).alias("minute"), x["p"].alias("p")))
        trains = trains.select("key", "own", change.alias("change"), F.col("wait").alias("change_latest"), "wait")
    else:
        trains = trains.select("key", "own")
    out = cut(departures(trains).filter("p > 0"))
    came = as_array(arrival(out, delays.travel(rides)).filter("p > 0"), "key", name="arriving")
    rows = rows.join(as_array(out, "key", name="departing"), "key", "left").join(came, "key", "left")
    on_foot = F.col("trip_id").isNull()
    none = F.array().cast(DIST)
    rows = rows.withColumn("departing", F.when(on_foot, F.col("uncovered")).otherwise(F.coalesce("departing", none))).withColumn("arriving", F.when(on_foot, F.col("uncovered")).otherwise(F.coalesce("arriving", none)))
    if at is not None:
        # on foot one needn't be in time: what is left takes the walk
        rows = rows.withColumn("uncovered", F.when(on_foot, none).otherwise(F.filter(_filtered(F.col("uncovered"), latest, True), lambda x: x["p"] >= EPS)))
        # a walk that begins when the train has come arrives with its delay
        rows = rows.withColumn("comes", F.when(on_foot, F.col("came") + F.col("comes") - F.col("leaves")).otherwise(F.col("comes")))
    return rows.drop("key", "transfer", "feeder_trip")


_STOP = ["graph", "stop", "goal", "station", "came", "came_trip", "alternatives", "last", "uncovered", "closed"]


def _insert(parts: DataFrame, at: DataFrame | None, footpaths: DataFrame | search.Walks, delays: Delays) -> tuple[DataFrame, DataFrame]:
    """Rated parts, and the stops that they leave as they stand then; legs follow one another."""
    parts = cut(parts)
    last = parts.agg(F.max("leg")).first()[0] or 0
    rated = stops = None
    for leg in range(1, last + 1):
        now = cut(rate(parts.filter(F.col("leg") == leg), at, footpaths, delays))
        here = now.select("graph", "stop", "goal", F.col("from_station").alias("station"), "came", F.lit(1).alias("alternatives"), F.col("leaves").alias("last"), "uncovered", F.lit(False).alias("closed"))
        if at is None:
            here = here.withColumn("came_trip", F.lit(None).cast("long"))
        else:
            here = here.join(at.select("graph", "stop", "came_trip"), ["graph", "stop"])
        stops = here.select(_STOP) if stops is None else stops.unionByName(here.select(_STOP))
        rated = now if rated is None else rated.unionByName(now)
        at = now.filter(F.col("next_stop") != ARRIVAL).select("graph", F.col("next_stop").alias("stop"), F.col("arr").alias("came"), F.col("trip_id").alias("came_trip"), F.col("arriving").alias("uncovered"))
    return rated.select(*PART, "departing", "arriving"), cut(stops)


def reliable(stop: Callable[[str], Column]) -> Column:
    """A stop is complete when no arrival is uncovered."""
    return F.size(stop("uncovered")) == 0


def tree(n: int = IN_TREE) -> Callable[[Callable[[str], Column]], Column]:
    """A stop is complete when it has n alternatives."""
    return lambda stop: stop("alternatives") >= n


NO_RIDES = "array<struct<leg:int,trip_id:bigint,day:bigint,enter:bigint,exit:bigint,enter_station:bigint,exit_station:bigint,dep:bigint,arr:bigint,walk_to:bigint,walk_arr:bigint>>"


def _answers(t: query.Timetable, asked: DataFrame, rounds: int) -> DataFrame:
    """(goal, station, t0, rides): the journey that arrives first, on foot if nothing is sooner; null rides if there is none."""
    starts = asked.select(F.col("station").alias("start"), "t0").distinct()
    found = search.run_rounds(t.conn, t.footpaths, starts, rounds, links=t.links, start_walks=True)
    goals = asked.select(F.col("station").alias("start"), "t0", "goal")
    made = search.sane(search.journeys(search.journey_legs(found, goals))).select("start", "t0", "goal", "arrival", "transfers", F.col("rides").cast(NO_RIDES).alias("rides"))
    walks = search.walk_between(asked, t.footpaths, "station", "goal", "dur", loops=False).filter("dur IS NOT NULL").select(F.col("station").alias("start"), "t0", "goal", (F.col("t0") + F.col("dur")).alias("arrival"), F.lit(-1).cast("long").alias("transfers"), F.array().cast(NO_RIDES).alias("rides"))
    best = made.unionByName(walks).groupBy("start", "t0", "goal").agg(F.min_by("rides", F.struct("arrival", "transfers", -F.coalesce(F.get("rides", F.lit(0))["dep"], F.lit(0)))).alias("rides"))
    return asked.join(best.withColumnRenamed("start", "station"), ["goal", "station", "t0"], "left").select("goal", "station", "t0", "rides")


@dataclass(frozen=True)
class Graphs:
    """``parts`` (one row per ride or walk: graph, stop, alternative, next_stop, times, departing, arriving) and
    ``stops`` (graph, stop, station, alternatives, uncovered, closed: no further alternative exists); ``searched``
    distinct questions, ``asked`` in all."""

    parts: DataFrame
    stops: DataFrame
    searched: int
    asked: int

    def arrivals(self) -> DataFrame:
        """(graph, minute, p): clock minutes of arrival; what of the mass is missing never arrives in this graph."""
        ends = self.parts.filter(F.col("next_stop") == ARRIVAL)
        return graph_arrival(ends.select("graph", F.col("comes").alias("at"), F.lit(1.0).alias("weight"), F.explode("arriving").alias("_x")).select("graph", "at", "weight", "_x.minute", "_x.p"))


def connection_graphs(t: query.Timetable, journeys: DataFrame, delays: Delays, complete: Callable = reliable, later: int = LATER, rounds: int = search.MAX_LEGS) -> Graphs:
    """Grow a graph from each journey (graph, start, goal, rides) until all stops are complete or have no further alternative.

    ``later`` must be positive: every alternative of a stop leaves after those before, so growth ends with the timetable.
    """
    if later < 1:
        raise ValueError("an alternative must leave later than those before")
    base = journeys.select("graph", F.lit(DEPARTURE).alias("stop"), F.lit(1).alias("alternative"), "goal", F.col("start").alias("station"), F.lit(None).cast("long").alias("asked"), F.col("rides").cast(NO_RIDES).alias("rides")).filter(F.size("rides") > 0)
    base = split(base, t.footpaths)
    parts, stops = _insert(base, None, t.footpaths, delays) if not base.isEmpty() else (None, None)
    if parts is None:
        return Graphs(*_nothing(t), 0, 0)
    stops = stops.filter(F.col("stop") != DEPARTURE)
    cache, searched, asked_all = None, 0, 0
    while True:
        open_ = cut(stops.filter(~F.col("closed") & ~complete(F.col)).withColumn("t0", F.col("last") + later))
        asked_now = open_.count()
        if not asked_now:
            return Graphs(cut(parts), stops, searched, asked_all)
        asked_all += asked_now
        asked = open_.select("goal", "station", "t0").distinct()
        new = cut(asked if cache is None else asked.join(cache, ["goal", "station", "t0"], "left_anti"))
        n = new.count()
        if n:
            searched += n
            answers = cut(_answers(t, new, rounds))
            cache = answers if cache is None else cut(cache.unionByName(answers))
        got = cut(open_.join(cache, ["goal", "station", "t0"]))
        found = got.filter("rides IS NOT NULL")
        nothing = got.filter("rides IS NULL").select("graph", "stop", F.lit(True).alias("_closed"))
        grown = touched = None
        if not found.isEmpty():
            alternatives = found.select("graph", "stop", (F.col("alternatives") + 1).alias("alternative"), "goal", "station", F.col("t0").alias("asked"), "rides")
            grown, touched = _insert(split(alternatives, t.footpaths), found.select("graph", "stop", "came", "came_trip", "uncovered"), t.footpaths, delays)
            parts = parts.unionByName(grown)
            # stops that were there keep their number of alternatives, one more; the others are new
            old = stops.select("graph", "stop", F.col("alternatives").alias("_n"))
            touched = touched.join(old, ["graph", "stop"], "left").withColumn("alternatives", F.col("alternatives") + F.coalesce("_n", F.lit(0))).drop("_n")
            stops = stops.join(touched.select("graph", "stop"), ["graph", "stop"], "left_anti").unionByName(touched)
        stops = stops.join(nothing, ["graph", "stop"], "left").withColumn("closed", F.col("closed") | F.coalesce("_closed", F.lit(False))).select(_STOP)
        stops, parts = cut(stops), cut(parts)


def _nothing(t: query.Timetable) -> tuple[DataFrame, DataFrame]:
    spark = t.conn.sparkSession
    of = {"graph": "string", "stop": "string", "next_stop": "string", "alternative": "int", "alternatives": "int", "closed": "boolean", "departing": DIST, "arriving": DIST, "uncovered": DIST}
    schema = lambda names: ", ".join(f"`{c}` {of.get(c, 'long')}" for c in names)
    return spark.createDataFrame([], schema([*PART, "departing", "arriving"])), spark.createDataFrame([], schema(_STOP))


def rating(t: query.Timetable, journeys: DataFrame, delays: Delays) -> DataFrame:
    """(graph, rating, arrives): that all trains run and all changes are made, and the mass that arrives by this journey alone."""
    alone = connection_graphs(t, journeys, delays, tree(1)).parts.drop("goal")
    rides = alone.select("graph", "stop")
    last = alone.filter(F.col("next_stop") == ARRIVAL).select("graph", F.aggregate("arriving", F.lit(0.0), lambda s, x: s + x["p"]).alias("arrives"))
    got = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x["p"])
    before = alone.select("graph", F.col("next_stop").alias("stop"), got("arriving").alias("_before"))
    changes = alone.join(before, ["graph", "stop"]).select("graph", (got("departing") / F.col("_before")).alias("rating"))
    return simple_rating(rides, changes, ["graph"]).join(last, "graph")


def route(kind: str, t: query.Timetable, q: query.Query, delays: Delays | None = None, alternatives: int = IN_TREE, later: int = LATER, fares: DataFrame | None = None, extra_edges: DataFrame | None = None):
    """Answer a reliability request: ``rating``, ``reliable_search``, ``connection_tree`` (``Graphs``) or ``late_connection`` (labels at the goal)."""
    if kind == "late_connection":
        return query.labels(replace(t, conn=fares) if fares is not None else t, replace(q, kind_of_search="late_connections"), extra_edges)
    if kind not in ("rating", "reliable_search", "connection_tree"):
        raise ValueError(f"unknown request: {kind}")
    base = graphs_of(query.answer(t, q))
    if kind == "rating":
        return rating(t, base, delays)
    return connection_graphs(t, base, delays, reliable if kind == "reliable_search" else tree(alternatives), later, q.rounds)


query.operation("/reliability/route")(route)
