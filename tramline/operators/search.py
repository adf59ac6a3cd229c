"""Journey search in rounds, one per boarded trip; starts, days and walks are columns.

A round boards trips from the stations whose ready time fell in the round before, rides them and
walks on.  Only labels that improve go on (semi-naive evaluation), so later rounds shrink and the
search ends when nothing improves.  A label carries the ride and the walk that made it, so
journeys are read back by joins, without another search.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import bucketed, closure, cut

#: A journey's longest duration in minutes and most trips.
HORIZON, MAX_LEGS = 1440, 7
#: Rows up to which a side of known size is broadcast.
SMALL = 1_000_000
#: No ready time: later than any.
NEVER = 1 << 40

KEYS = ["start", "t0"]
CONN = ["day", "trip_id", "seq", "from_station", "to_station", "dep", "arr", "in_allowed", "out_allowed"]
_RIDE = "trip_id", "day", "enter", "exit", "enter_station", "dep"


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of ``rows`` rows, marked for broadcasting if that is few."""
    return F.broadcast(df) if rows <= SMALL else df


@dataclass(frozen=True)
class Walks:
    """Footpaths in two parts: ``pairs`` (a, b, dur), self loops of the transfer times among them, and walks between all
    stations of a group by way of its hubs: ``enter`` (a, hub), ``across`` (hub, door, dur), ``leave`` (door, b).

    A group of n stations has n rows where its pairs would be n * n.  Hubs and doors have ids that no station has.  A way
    back to the station itself is no walk; every station needs a self loop shorter than that.
    """

    pairs: DataFrame
    enter: DataFrame
    across: DataFrame
    leave: DataFrame

    def turned(self) -> Walks:
        enter = self.leave.select(F.col("b").alias("a"), F.col("door").alias("hub"))
        across = self.across.select(F.col("door").alias("hub"), F.col("hub").alias("door"), "dur")
        return Walks(turned(self.pairs), enter, across, self.enter.select(F.col("hub").alias("door"), F.col("a").alias("b")))

    def edges(self) -> DataFrame:
        """(a, b, dur): everything as edges, hubs and doors being nodes."""
        none = F.lit(0).cast("long").alias("dur")
        enter = self.enter.select("a", F.col("hub").alias("b"), none)
        return self.pairs.select("a", "b", F.col("dur").cast("long").alias("dur")).unionByName(enter).unionByName(self.across.select(F.col("hub").alias("a"), F.col("door").alias("b"), F.col("dur").cast("long").alias("dur"))).unionByName(self.leave.select(F.col("door").alias("a"), "b", none))


def walks_from(rows: DataFrame, footpaths: DataFrame | Walks, station: str = "station") -> DataFrame:
    """``rows`` with every walk (a, b, dur) to another station than ``station``, one row each."""
    pairs = footpaths.pairs if isinstance(footpaths, Walks) else footpaths
    out = rows.join(pairs.filter("a <> b").select("a", "b", F.col("dur").cast("long").alias("dur")), F.col(station) == F.col("a"))
    if not isinstance(footpaths, Walks):
        return out
    far = rows.join(footpaths.enter, F.col(station) == F.col("a")).join(footpaths.across, "hub").join(footpaths.leave, "door").filter("a <> b")
    return out.unionByName(far.select(*rows.columns, "a", "b", F.col("dur").cast("long").alias("dur")))


def walk_between(rows: DataFrame, footpaths: DataFrame | Walks, a: str, b: str, name: str, loops: bool = True) -> DataFrame:
    """``rows`` with the least walk between two of their stations, null without one; only walks that are asked for are made."""
    asked = rows.select(F.col(a).alias("_a"), F.col(b).alias("_b")).distinct()
    pairs = footpaths.pairs if isinstance(footpaths, Walks) else footpaths
    known = asked.join(pairs, (F.col("_a") == F.col("a")) & (F.col("_b") == F.col("b"))).select("_a", "_b", F.col("dur").cast("long").alias("dur"))
    if isinstance(footpaths, Walks):
        far = asked.filter("_a <> _b").join(footpaths.enter, F.col("_a") == F.col("a")).join(footpaths.across, "hub")
        far = far.join(footpaths.leave.select("door", F.col("b").alias("_b")), ["door", "_b"])
        known = known.unionByName(far.select("_a", "_b", F.col("dur").cast("long").alias("dur")))
    if not loops:
        known = known.filter("_a <> _b")
    known = known.groupBy("_a", "_b").agg(F.min("dur").alias(name))
    return rows.join(known, (F.col(a) == F.col("_a")) & (F.col(b) == F.col("_b")), "left").drop("_a", "_b")


@dataclass
class Rounds:
    """Per round the labels that improved: (start, t0, station, ready, by_ready, arr, by_arr, sooner, earlier).

    ``by_*`` hold the leg that led there: the station where the ride ended (``source``) and the ride.
    """

    labels: list[DataFrame] = field(default_factory=list)

    def arrivals(self, by_legs: bool = False) -> DataFrame:
        """(start, t0, station, arr[, legs]): earliest arrivals, or those that improve with another trip."""
        out = None
        for k, df in enumerate(self.labels, 1):
            rows = df.filter("earlier").select(*KEYS, "station", "arr", F.lit(k).alias("legs"))
            out = rows if out is None else out.unionByName(rows)
        return out if by_legs else out.groupBy(*KEYS, "station").agg(F.min("arr").alias("arr"))


def through(links: DataFrame) -> DataFrame:
    """(trip_id, day, next_trip): all trips on which a passenger of a trip may stay seated, over any number of links."""
    named = links.select(F.concat_ws("/", "trip_id", "day").alias("a"), F.concat_ws("/", "next_trip", "day").alias("b"), F.lit(0).cast("long").alias("dur"))
    part = lambda c, k: F.split(c, "/")[k].cast("long")
    return closure(named).select(part("a", 0).alias("trip_id"), part("a", 1).alias("day"), part("b", 0).alias("next_trip"))


def _walked(arrived: DataFrame, footpaths: DataFrame | Walks) -> DataFrame:
    """Best ready time and arrival per reached station, with what led there."""
    via = lambda source: F.struct(source.alias("source"), *[F.col(f"ride.{c}").alias(c) for c in _RIDE], F.col("ride.arr").alias("ride_arr"))
    here = arrived.select(*KEYS, "station", F.lit(NEVER).alias("ready"), F.col("ride.arr").alias("arr"), via(F.col("station")).alias("via"))
    pairs = footpaths.pairs if isinstance(footpaths, Walks) else footpaths
    walk = arrived.join(pairs.select("a", "b", "dur"), F.col("station") == F.col("a"))
    ready = F.col("ride.arr") + F.col("dur")
    walk = walk.select(*KEYS, F.col("b").alias("station"), ready.alias("ready"), F.when(F.col("a") == F.col("b"), F.col("ride.arr")).otherwise(ready).alias("arr"), via(F.col("a")).alias("via"))
    rows = here.unionByName(walk)
    if isinstance(footpaths, Walks):  # all that walk through a hub take equally long from there, so its first one stands for them
        least = lambda rows, at: rows.groupBy(*KEYS, at).agg(F.min(F.struct("ready", "via")).alias("_w")).select(*KEYS, at, "_w.*")
        hubs = least(arrived.join(footpaths.enter, F.col("station") == F.col("a")).select(*KEYS, "hub", F.col("ride.arr").alias("ready"), via(F.col("a")).alias("via")), "hub")
        doors = least(hubs.join(footpaths.across, "hub").select(*KEYS, "door", (F.col("ready") + F.col("dur")).alias("ready"), "via"), "door")
        far = doors.join(footpaths.leave, "door").filter(F.col("via.source") != F.col("b"))
        rows = rows.unionByName(far.select(*KEYS, F.col("b").alias("station"), "ready", F.col("ready").alias("arr"), "via"))
    rows = rows.groupBy(*KEYS, "station").agg(F.min(F.struct("ready", "via")).alias("r"), F.min(F.struct("arr", "via")).alias("c"))
    return rows.select(*KEYS, "station", "r.ready", F.col("r.via").alias("by_ready"), "c.arr", F.col("c.via").alias("by_arr"))


def run_rounds(conn: DataFrame, footpaths: DataFrame | Walks, starts: DataFrame, rounds: int = MAX_LEGS, boarded: DataFrame | None = None, links: DataFrame | None = None, start_walks: bool = False, horizon: int = HORIZON, profile: bool = False) -> Rounds:
    """Search from ``starts`` (start, t0[, station, ready]) with at most ``rounds`` trips within ``horizon`` minutes.

    A trip is boarded where ready <= departure, at its first such stop; every later stop that
    allows alighting is reached.  ``footpaths`` (a, b, dur) hold a self loop of the transfer time.
    ``boarded`` (start, t0, trip_id, day, enter) are trips that a traveller sits in already;
    ``links`` (trip_id, day, next_trip) are trips that go on as others; ``start_walks`` lets
    journeys begin with a walk.  With ``profile`` a label goes on only if no later start of the same
    station is there as soon: what a later start reaches anyway can't be in a profile's result.
    """
    conn = bucketed(conn.select(*CONN), ["trip_id", "day"])
    if "station" not in starts.columns:
        starts = starts.select(*KEYS, F.col("start").alias("station"), F.col("t0").alias("ready"))
    if start_walks:
        walk = walks_from(starts.select(*KEYS, "station", "ready"), footpaths).select(*KEYS, F.col("b").alias("station"), (F.col("ready") + F.col("dur")).alias("ready"))
        starts = starts.unionByName(walk).groupBy(*KEYS, "station").agg(F.min("ready").alias("ready"))
    links = None if links is None else cut(through(links))
    delta, best, found, n = cut(starts), None, Rounds(), 0
    n = delta.count()
    for k in range(1, rounds + 1):
        met = conn.filter("in_allowed").join(small(delta, n), F.col("from_station") == F.col("station")).filter((F.col("dep") >= F.col("ready")) & (F.col("dep") <= F.col("t0") + horizon))
        board = met.select(*KEYS, "trip_id", "day", F.struct(F.col("seq").alias("enter"), F.col("from_station").alias("enter_station"), "dep").alias("at"))
        if k == 1 and boarded is not None:
            none = F.lit(None).cast("long")
            board = board.unionByName(boarded.select(*KEYS, "trip_id", "day", F.struct(F.col("enter").cast("long").alias("enter"), none.alias("enter_station"), none.alias("dep")).alias("at")))
        board = board.groupBy("trip_id", "day", *KEYS).agg(F.min("at").alias("at"))  # in the order that the ride joins by
        board = board.withColumn("on", F.col("trip_id")).withColumn("from_seq", F.col("at.enter"))
        if links is not None:  # stay seated: the next trip is ridden from its first stop
            board = board.unionByName(board.join(links, ["trip_id", "day"]).withColumn("on", F.col("next_trip")).withColumn("from_seq", F.lit(0).cast("long")).drop("next_trip"))
        ride = board.select(*KEYS, F.col("on"), F.col("day").alias("on_day"), "from_seq", "at", F.col("trip_id").alias("first_trip"))
        ride = ride.join(conn.filter("out_allowed"), (F.col("on") == F.col("trip_id")) & (F.col("on_day") == F.col("day"))).filter((F.col("seq") >= F.col("from_seq")) & (F.col("arr") <= F.col("t0") + horizon))
        leg = F.struct("arr", F.col("first_trip").alias("trip_id"), "day", F.col("at.enter").alias("enter"), F.col("seq").alias("exit"), F.col("at.enter_station").alias("enter_station"), F.col("at.dep").alias("dep"))
        arrived = cut(ride.groupBy(*KEYS, F.col("to_station").alias("station")).agg(F.min(leg).alias("ride")))  # walks read it several times
        labels = _walked(arrived, footpaths)
        if best is None:
            labels = labels.withColumn("sooner", F.col("ready") < NEVER).withColumn("earlier", F.lit(True))
        else:
            labels = labels.join(best, [*KEYS, "station"], "left").withColumn("sooner", F.col("ready") < F.coalesce("_ready", F.lit(NEVER))).withColumn("earlier", F.col("arr") < F.coalesce("_arr", F.lit(NEVER)))
            labels = labels.filter("sooner OR earlier").drop("_ready", "_arr")
        labels = cut(labels)
        found.labels.append(labels)
        now = labels.select(*KEYS, "station", F.col("ready").alias("_ready"), F.col("arr").alias("_arr"))
        known = now if best is None else best.unionByName(now)
        if best is None:  # the start itself need not be reached again
            known = known.unionByName(starts.select(*KEYS, "station", F.col("ready").alias("_ready"), F.lit(NEVER).alias("_arr")))
        best = known.groupBy(*KEYS, "station").agg(F.min("_ready").alias("_ready"), F.min("_arr").alias("_arr"))
        if profile:
            best = cut(best)
            labels = cut(_not_later(labels, best))
            found.labels[-1] = labels
        delta = labels.filter("sooner").select(*KEYS, "station", "ready")
        n = delta.count()
        if not n:
            break
    return found


def _not_later(labels: DataFrame, best: DataFrame) -> DataFrame:
    """Labels that no later start equals: ``sooner`` and ``earlier`` hold against those of all later t0 as well."""
    later = Window.partitionBy("start", "station").orderBy(F.desc("t0")).rangeBetween(Window.unboundedPreceding, -1)
    bound = best.select(*KEYS, "station", F.min("_ready").over(later).alias("_r"), F.min("_arr").over(later).alias("_a"))
    rows = labels.join(bound, [*KEYS, "station"])
    rows = rows.withColumn("sooner", F.col("sooner") & (F.col("ready") < F.coalesce("_r", F.lit(NEVER)))).withColumn("earlier", F.col("earlier") & (F.col("arr") < F.coalesce("_a", F.lit(NEVER))))
    return rows.filter("sooner OR earlier").drop("_r", "_a")


def earliest_arrival(conn: DataFrame, footpaths: DataFrame | Walks, starts: DataFrame, rounds: int, by_legs: bool = False, **options) -> DataFrame:
    """(start, t0, [legs,] station, arr): earliest arrival, by ride or on foot after one, with at most ``rounds`` trips."""
    return run_rounds(conn, footpaths, starts, rounds, **options).arrivals(by_legs)


def latest_departure(conn: DataFrame, footpaths: DataFrame | Walks, goals: DataFrame, rounds: int) -> DataFrame:
    """(goal, t1, station, dep): latest departure that still arrives by t1; the mirror of ``earliest_arrival``."""
    out = earliest_arrival(mirrored(conn), turned(footpaths), goals.select(F.col("goal").alias("start"), (-F.col("t1")).alias("t0")), rounds)
    return out.select(F.col("start").alias("goal"), (-F.col("t0")).alias("t1"), "station", (-F.col("arr")).alias("dep"))


def mirrored(conn: DataFrame) -> DataFrame:
    """The timetable run backwards: times negated, ends and permissions swapped."""
    return conn.select("day", "trip_id", (-F.col("seq")).alias("seq"), F.col("to_station").alias("from_station"), F.col("from_station").alias("to_station"), (-F.col("arr")).alias("dep"), (-F.col("dep")).alias("arr"), F.col("out_allowed").alias("in_allowed"), F.col("in_allowed").alias("out_allowed"))


def turned(footpaths: DataFrame | Walks) -> DataFrame | Walks:
    if isinstance(footpaths, Walks):
        return footpaths.turned()
    return footpaths.select(F.col("b").alias("a"), F.col("a").alias("b"), "dur")


# --- journeys ---------------------------------------------------------------------------------


def journey_legs(found: Rounds, goals: DataFrame) -> DataFrame:
    """Legs of the journeys to ``goals`` ([start, t0,] goal) that improve with their number of trips.

    (start, t0, goal, legs, leg, trip_id, day, enter, exit, enter_station, exit_station, dep, arr,
    walk_to, walk_arr): a walk follows the ride where ``walk_to`` is another station.  Each round is
    joined once: a leg's label names the station it was boarded at, whose label is the round's before.
    """
    by = [c for c in KEYS if c in goals.columns]
    state = out = None
    ids = [*KEYS, "goal", "legs"]
    for k in range(len(found.labels), 0, -1):
        labels = found.labels[k - 1]
        ends = labels.filter("earlier").withColumn("goal", F.col("station")).join(goals.select(*by, "goal").distinct(), [*by, "goal"], "left_semi")
        rows = ends.select(*KEYS, "goal", F.lit(k).alias("legs"), F.col("by_arr").alias("via"), F.col("station").alias("walk_to"), F.col("arr").alias("walk_arr"))
        if state is not None:
            boarded = state.join(labels.select(*KEYS, F.col("station").alias("enter_station"), F.col("by_ready").alias("via"), "ready"), [*KEYS, "enter_station"])
            rows = rows.unionByName(boarded.select(*ids, "via", F.col("enter_station").alias("walk_to"), F.when(F.col("via.source") == F.col("enter_station"), F.col("via.ride_arr")).otherwise(F.col("ready")).alias("walk_arr")))
        rows = rows.select(*ids, F.lit(k).alias("leg"), "via.trip_id", "via.day", "via.enter", "via.exit", "via.enter_station", F.col("via.source").alias("exit_station"), "via.dep", F.col("via.ride_arr").alias("arr"), "walk_to", "walk_arr")
        state = rows.select(*ids, "enter_station")
        out = rows if out is None else out.unionByName(rows)
    return out


def journeys(legs: DataFrame) -> DataFrame:
    """One row per journey: departure, arrival, duration, transfers and its legs in order as an array of structs."""
    leg = F.struct("leg", "trip_id", "day", "enter", "exit", "enter_station", "exit_station", "dep", "arr", "walk_to", "walk_arr")
    rows = legs.groupBy(*KEYS, "goal", "legs").agg(F.array_sort(F.collect_list(leg)).alias("rides"))  # at most MAX_LEGS
    first, last = F.col("rides")[0], F.element_at("rides", -1)
    rows = rows.withColumn("departure", F.coalesce(first["dep"], F.col("t0"))).withColumn("arrival", last["walk_arr"])
    return rows.select(*KEYS, "goal", "departure", "arrival", (F.col("arrival") - F.col("departure")).alias("duration"), (F.col("legs") - 1).cast("long").alias("transfers"), "rides")


def legs_of(journeys: DataFrame) -> DataFrame:
    """Journeys back to legs: the inverse of ``journeys``."""
    rows = journeys.select(*KEYS, "goal", F.size("rides").alias("legs"), F.explode("rides").alias("ride"))
    return rows.select(*KEYS, "goal", "legs", "ride.*")


def journey_stops(legs: DataFrame, conn: DataFrame) -> DataFrame:
    """(..., leg, seq, station, arr, dep): each stop of each leg between entry and exit, ends included."""
    ids = [*KEYS, "goal", "legs", "leg"]
    rows = legs.select(*ids, "trip_id", "day", "enter", "exit").join(conn.select("trip_id", "day", "seq", "from_station", "to_station", "dep", "arr"), ["trip_id", "day"]).filter(F.col("seq").between(F.col("enter"), F.col("exit")))
    none = F.lit(None).cast("long")
    starts = rows.select(*ids, "seq", F.col("from_station").alias("station"), none.alias("arr"), "dep")
    ends = rows.select(*ids, (F.col("seq") + 1).alias("seq"), F.col("to_station").alias("station"), "arr", none.alias("dep"))
    return starts.unionByName(ends).groupBy(*ids, "seq", "station").agg(F.max("arr").alias("arr"), F.max("dep").alias("dep"))


def sane(journeys: DataFrame) -> DataFrame:
    """Journeys with a ride whose times never fall."""
    ok = F.forall("rides", lambda r: F.coalesce(r["arr"] >= r["dep"], F.lit(True)) & (r["walk_arr"] >= r["arr"]))
    ordered = F.forall(F.sequence(F.lit(1), F.size("rides")), lambda k: (k == F.size("rides")) | (F.col("rides")[k]["dep"] >= F.col("rides")[k - 1]["walk_arr"]))
    return journeys.filter((F.size("rides") > 0) & ok & ordered)


def check_interchanges(legs: DataFrame, footpaths: DataFrame | Walks) -> DataFrame:
    """(start, t0, goal, legs, valid): every change leaves the transfer time or the walk between its stations."""
    nxt = legs.select(*KEYS, "goal", "legs", (F.col("leg") - 1).alias("leg"), F.col("enter_station").alias("b"), F.col("dep").alias("leaves"))
    pairs = walk_between(legs.join(nxt, [*KEYS, "goal", "legs", "leg"], "left").withColumn("a", F.col("exit_station")), footpaths, "a", "b", "dur")
    good = F.col("leaves").isNull() | F.coalesce(F.col("leaves") - F.col("arr") >= F.col("dur"), F.lit(False))
    return pairs.groupBy(*KEYS, "goal", "legs").agg(F.min(good).alias("valid"))


def split_at(journeys: DataFrame, leg: Column) -> DataFrame:
    """``before`` and ``after``: a journey's rides split behind the given leg."""
    n = F.least(F.greatest(leg, F.lit(0)), F.size("rides"))
    return journeys.withColumn("before", F.slice("rides", F.lit(1), n)).withColumn("after", F.slice("rides", n + 1, F.greatest(F.size("rides") - n, F.lit(0))))


# --- the same search as SQL -----------------------------------------------------------------------


def search_sql(rounds: int, starts: str, by_legs: bool = False, extra: str = "") -> str:
    """The search as a chain of DuckDB common table expressions over conn, footpath and starts, every label kept."""
    parts = [f"starts AS ({starts})", "reach1 AS (SELECT start, t0, start AS station, t0 AS ready FROM starts)"]
    for k in range(1, rounds + 1):
        parts.append(f"board{k} AS (SELECT start, t0, trip_id, day, min(seq) AS enter FROM conn JOIN reach{k} ON from_station = station WHERE in_allowed AND dep >= ready AND dep <= t0 + {HORIZON} {extra} GROUP BY ALL)")
        parts.append(f"arrived{k} AS (SELECT start, t0, to_station AS station, min(arr) AS arr FROM board{k} JOIN conn USING (trip_id, day) WHERE out_allowed AND seq >= enter AND arr <= t0 + {HORIZON} GROUP BY ALL)")
        parts.append(f"came{k} AS (SELECT start, t0, station, min(arr) AS arr FROM (SELECT * FROM arrived{k} UNION ALL SELECT start, t0, b, arr + dur FROM arrived{k} JOIN footpath ON station = a AND a <> b) GROUP BY ALL)")
        if k < rounds:
            parts.append(f"reach{k + 1} AS (SELECT start, t0, station, min(ready) AS ready FROM (SELECT * FROM reach{k} UNION ALL SELECT start, t0, b, arr + dur FROM arrived{k} JOIN footpath ON station = a) GROUP BY ALL)")
    union = " UNION ALL ".join(f"SELECT *, {k} AS legs FROM came{k}" for k in range(1, rounds + 1))
    parts.append(f"found AS ({union})")
    return ", ".join(parts) if by_legs else ", ".join([*parts, "best AS (SELECT start, t0, station, min(arr) AS arr FROM found GROUP BY ALL)"])
