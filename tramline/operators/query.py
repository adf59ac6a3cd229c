"""Journey queries: start kinds, directions, equivalent stations, intervals that grow until there are enough journeys."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pareto, realtime, search
from .relational import cut, haversine_km, skyline

#: Fixed value: minutes by which an interval grows at either end.
STEP = 60
#: Stations of an intermodal query's start and goal; no station has such an id.
START, END = -1, -2


@dataclass(frozen=True)
class Timetable:
    """conn (times in minutes from day 0), footpaths (a, b, dur; self loops are transfer times; or ``Walks``), equivalents
    (station_id, equivalent), through links (trip_id, day, next_trip)."""

    conn: DataFrame
    footpaths: DataFrame | search.Walks
    equivalents: DataFrame | None = None
    links: DataFrame | None = None

    def running(self, canceled: DataFrame, updates: DataFrame | None = None) -> Timetable:
        """The timetable in real time: updated times, no cancelled sections; trips are pieces (``realtime.trip_of``)."""
        conn = self.conn if updates is None else realtime.retimed(self.conn, updates)
        conn, links = realtime.running(conn, canceled, self.links)
        return replace(self, conn=conn, links=links)


@dataclass(frozen=True)
class Query:
    """``kind``: ontrip_station (from ``time``), ontrip_train (in ``train`` = (trip, day, seq) from there on) or pretrip (departing,
    or backward arriving, in [``time``, ``until``])."""

    start: int | None
    goal: int
    time: int
    kind: str = "ontrip_station"
    until: int | None = None
    backward: bool = False
    train: tuple[int, int, int] | None = None
    kind_of_search: str = "default"
    rounds: int = search.MAX_LEGS
    start_metas: bool = False
    goal_metas: bool = False
    start_walks: bool = True
    least: int = 0
    earlier: bool = False
    later: bool = False


def _stations(t: Timetable, station: int, metas: bool) -> DataFrame:
    spark = t.conn.sparkSession
    one = spark.createDataFrame([(station,)], "station long")
    if not metas or t.equivalents is None:
        return one
    more = t.equivalents.filter(F.col("station_id") == station).select(F.col("equivalent").cast("long").alias("station"))
    return one.unionByName(more).distinct()


def start_times(t: Timetable, stations: DataFrame, begin: int, end: int, walks: bool) -> DataFrame:
    """(station, t0): minutes in [begin, end] at which leaving a start station meets a departure there or, after a walk, at
    a neighbour; and the minute after the interval, whose journeys show which others a later start makes needless."""
    near = stations.select("station", F.col("station").alias("at"), F.lit(0).cast("long").alias("off"))
    if walks:
        near = near.unionByName(search.walks_from(stations.select("station"), t.footpaths).select("station", F.col("b").alias("at"), F.col("dur").alias("off")))
    dep = t.conn.filter("in_allowed").filter(F.col("dep") >= begin).select(F.col("from_station").alias("at"), "dep")
    times = near.join(dep, "at").select("station", (F.col("dep") - F.col("off")).alias("t0")).filter(F.col("t0").between(begin, end)).distinct()
    return times.unionByName(stations.select("station", F.lit(end + 1).cast("long").alias("t0")))


def _search_type(t: Timetable, kind: str) -> Timetable:
    if kind in ("no_intercity", "single_criterion_no_intercity"):
        return replace(t, conn=t.conn.filter("clasz >= 3"))
    return t


def _mirror(t: Timetable, q: Query) -> tuple[Timetable, Query]:
    turned = Timetable(search.mirrored(t.conn), search.turned(t.footpaths), t.equivalents, None if t.links is None else t.links.select(F.col("next_trip").alias("trip_id"), "day", F.col("trip_id").alias("next_trip")))
    begin, end = (-q.until, -q.time) if q.until is not None else (-q.time, None)
    return turned, replace(q, start=q.goal, goal=q.start, time=begin, until=end, backward=False, start_metas=q.goal_metas, goal_metas=q.start_metas, earlier=q.later, later=q.earlier)


def _legs(t: Timetable, q: Query, starts: DataFrame) -> DataFrame:
    """Legs to the goal for starts (station, t0); the goal's equivalents count as the goal."""
    rows = starts.select(F.lit(q.start if q.start is not None else START).cast("long").alias("start"), F.col("t0").cast("long").alias("t0"), "station", F.col("t0").cast("long").alias("ready"))
    boarded = None
    if q.kind == "ontrip_train":
        trip, day, seq = q.train
        boarded = rows.sparkSession.createDataFrame([(START if q.start is None else q.start, q.time, trip, day, seq)], "start long, t0 long, trip_id long, day long, enter long")
        rows = rows.limit(0)
    found = search.run_rounds(t.conn, t.footpaths, rows, q.rounds, boarded=boarded, links=t.links, start_walks=q.start_walks and q.kind != "ontrip_train", profile=q.kind == "pretrip")
    goals = _stations(t, q.goal, q.goal_metas).select(F.col("station").alias("goal"))
    return search.journey_legs(found, goals)


def _in_interval(legs: DataFrame) -> DataFrame:
    """Journeys of the legs, none that another betters: it leaves no earlier, arrives no later and changes no more often."""
    rows = search.journeys(legs)
    first = F.col("rides")[0]
    # leaving as late as the first ride allows
    rows = rows.withColumn("departure", F.when(first["dep"].isNull(), F.col("t0")).otherwise(F.greatest("t0", "departure")))
    best = skyline(rows, [], ["arrival", "transfers"], ["departure"])
    return best.withColumn("_n", F.struct("t0", "goal")).groupBy("departure", "arrival", "transfers").agg(F.max_by(F.struct("start", "t0", "goal", "duration", "rides"), "_n").alias("j")).select("j.start", "j.t0", "j.goal", "departure", "arrival", (F.col("arrival") - F.col("departure")).alias("duration"), "transfers", "j.rides")


def answer(t: Timetable, q: Query) -> DataFrame:
    """Journeys of a query: (start, t0, goal, departure, arrival, duration, transfers, rides).

    A pretrip query searches its interval at once, start times being a column.  While it has fewer
    than ``least`` journeys, the interval grows by an hour at the ends that may (``earlier``,
    ``later``), up to the timetable's ends.  Backward queries run on the mirrored timetable; their
    result has negated times turned back and legs from the first to the last.
    """
    if q.kind not in ("ontrip_station", "ontrip_train", "pretrip"):
        raise ValueError(f"unknown start kind: {q.kind}")
    if q.kind == "pretrip" and q.until is None:
        raise ValueError("a pretrip query needs an interval")
    if q.kind_of_search not in ("default", "no_intercity"):
        raise ValueError(f"unknown search type: {q.kind_of_search}; see labels() for others")
    t = _search_type(t, q.kind_of_search)
    if q.backward:
        if q.kind == "ontrip_train":
            raise ValueError("a traveller in a train can't search backward")
        return turn_back(answer(*_mirror(t, q)))
    if q.kind != "pretrip":
        stations = _stations(t, q.start, q.start_metas) if q.start is not None else t.conn.sparkSession.createDataFrame([(START,)], "station long")
        return _in_interval(_legs(t, q, stations.withColumn("t0", F.lit(q.time))))
    stations = _stations(t, q.start, q.start_metas)
    ends = t.conn.agg(F.min("dep"), F.max("arr")).first()
    begin, end = q.time, q.until
    while True:
        legs = _legs(t, q, start_times(t, stations, begin, end, q.start_walks))
        out = cut(_in_interval(legs).filter(F.col("departure").between(begin, end)))
        if out.count() >= q.least:
            return out
        wider = max(begin - STEP, ends[0]) if q.earlier else begin, min(end + STEP, ends[1]) if q.later else end
        wider = min(wider[0], begin), max(wider[1], end)
        if wider == (begin, end):
            return out
        begin, end = wider


def labels(t: Timetable, q: Query, extra_edges: DataFrame | None = None) -> DataFrame:
    """(start, t0, station, arr, legs, criteria): what is best at the goal by a search type of ``pareto.SEARCHES``.

    ``no_intercity_`` before a type leaves out long-distance trains.  The connections must have the fares that the
    type sums.  Forward queries from a station, or from an interval's start times; equivalents of the goal count.
    """
    kind = q.kind_of_search.removeprefix("no_intercity_")
    if kind not in pareto.SEARCHES:
        raise ValueError(f"unknown search type: {q.kind_of_search}")
    if q.backward or q.kind == "ontrip_train":
        raise ValueError("search types with criteria run forward from a station")
    if kind != q.kind_of_search:
        t = _search_type(t, "no_intercity")
    missing = sorted({c for x in pareto.SEARCHES[kind] for c in x.sums} - set(t.conn.columns))
    if missing:
        raise ValueError(f"the timetable lacks {', '.join(missing)}")
    stations = _stations(t, q.start, q.start_metas)
    times = stations.withColumn("t0", F.lit(q.time)) if q.kind == "ontrip_station" else start_times(t, stations, q.time, q.until, False).filter(F.col("t0") <= q.until)
    starts = times.select(F.col("station").alias("start"), F.col("t0").cast("long").alias("t0")).distinct()
    goals = _stations(t, q.goal, q.goal_metas).select(F.col("station").alias("goal"))
    found = pareto.pareto_search(t.conn, t.footpaths, starts, pareto.SEARCHES[kind], q.rounds, extra_edges, goals)
    return pareto.relaxed(found) if kind == "late_connections" else found


def turn_back(journeys: DataFrame) -> DataFrame:
    """Journeys found on the mirrored timetable as forward ones."""
    ride = lambda r: F.struct(
        (F.size("rides") - r["leg"] + 1).alias("leg"), r["trip_id"].alias("trip_id"), r["day"].alias("day"), (-r["exit"]).alias("enter"), (-r["enter"]).alias("exit"),
        r["exit_station"].alias("enter_station"), r["enter_station"].alias("exit_station"), (-r["arr"]).alias("dep"), (-r["dep"]).alias("arr"), r["walk_to"].alias("walk_from"), (-r["walk_arr"]).alias("walk_dep"),
    )
    rides = F.reverse(F.transform("rides", ride))
    return journeys.select(F.col("goal").alias("start"), (-F.col("t0")).alias("t0"), F.col("start").alias("goal"), (-F.col("arrival")).alias("departure"), (-F.col("departure")).alias("arrival"), "duration", "transfers", rides.alias("rides"))


def answer_via(t: Timetable, q: Query, via: int, stay: int = 0) -> DataFrame:
    """(first, second): journeys to ``via`` and, ``stay`` minutes after each arrival, the earliest on from there."""
    first = cut(answer(t, replace(q, goal=via, kind="ontrip_station")))
    goals = first.sparkSession.createDataFrame([(q.goal,)], "goal long")
    starts = first.select(F.lit(via).cast("long").alias("start"), (F.col("arrival") + stay).alias("t0")).distinct()
    found = search.run_rounds(t.conn, t.footpaths, starts, q.rounds, links=t.links, start_walks=q.start_walks)
    second = search.journeys(search.journey_legs(found, goals))
    best = second.groupBy("start", "t0").agg(F.min_by(F.struct("departure", "arrival", "transfers", "rides"), F.struct("arrival", "transfers")).alias("second"))
    one = first.select((F.col("arrival") + stay).alias("t0"), F.struct("departure", "arrival", "transfers", "rides").alias("first"))
    return one.join(best, "t0").select("first", "second")


def statistics(journeys: DataFrame, conn: DataFrame, rounds: search.Rounds | None = None) -> DataFrame:
    """One row: journeys, rides and connections of an answer, and labels made by a search."""
    n = journeys.agg(F.count(F.lit(1)).alias("n_journeys"), F.coalesce(F.sum(F.size("rides")), F.lit(0)).alias("n_rides"))
    rows = n.crossJoin(conn.agg(F.count(F.lit(1)).alias("n_connections")))  # one row each
    if rounds is not None:
        labels = None
        for df in rounds.labels:
            labels = df.select("station") if labels is None else labels.unionByName(df.select("station"))
        rows = rows.crossJoin(labels.agg(F.count(F.lit(1)).alias("n_labels")))
    return rows


# --- intermodal ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Mode:
    """A way to or from a station: its speed (m/s, along streets), longest duration, and price per minute in cents."""

    name: str
    speed: float
    minutes: int
    cents: int = 0


def mode_edges(spark: SparkSession, stations: DataFrame, lat: float, lng: float, modes: list[Mode], to_station: bool, detour: float = 1.5) -> DataFrame:
    """(a, b, dur, mode, price_of_edge) between a point and the stations that a mode reaches in its longest duration."""
    end = START if to_station else END
    out = None
    for m in modes:
        reach = m.minutes * 60 * m.speed / detour / 1000
        box = reach / 111.0  # prefilter by latitude before the distance
        near = stations.filter(F.abs(F.col("lat") - lat) <= box * 1.01).withColumn("km", haversine_km(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"))).filter(F.col("km") <= reach)
        dur = F.ceil(F.col("km") * 1000 * detour / m.speed / 60).cast("long")
        ends = (F.lit(end), F.col("station_id")) if to_station else (F.col("station_id"), F.lit(end))
        rows = near.select(ends[0].cast("long").alias("a"), ends[1].cast("long").alias("b"), dur.alias("dur"), F.lit(m.name).alias("mode"), (dur * m.cents).alias("price_of_edge"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("a", "b").agg(F.min_by(F.struct("dur", "mode", "price_of_edge"), F.struct("dur", "mode")).alias("e")).select("a", "b", "e.*")


def without_overlap(starts: DataFrame, goals: DataFrame) -> DataFrame:
    """Start edges whose station is no goal's station at once: such a traveller needs no train."""
    return starts.join(goals.select(F.col("a").alias("b")), "b", "left_anti").select(*starts.columns)


def intermodal(t: Timetable, starts: DataFrame, goals: DataFrame, time: int, rounds: int = search.MAX_LEGS) -> DataFrame:
    """Journeys from a point to a point: (departure, arrival, transfers, first_mode, last_mode, rides).

    Start and goal edges become footpaths of the pseudo stations START and END; the search starts at the
    stations that the start edges reach.
    """
    starts = without_overlap(starts, goals)
    more = goals.select("a", "b", "dur")
    feet = replace(t.footpaths, pairs=t.footpaths.pairs.select("a", "b", "dur").unionByName(more)) if isinstance(t.footpaths, search.Walks) else t.footpaths.select("a", "b", "dur").unionByName(more)
    begin = starts.select(F.lit(START).cast("long").alias("start"), F.lit(time).cast("long").alias("t0"), F.col("b").alias("station"), (F.lit(time) + F.col("dur")).cast("long").alias("ready"))
    found = search.run_rounds(t.conn, feet, begin, rounds, links=t.links)
    out = search.journeys(search.journey_legs(found, t.conn.sparkSession.createDataFrame([(END,)], "goal long")))
    first, last = F.col("rides")[0]["enter_station"], F.element_at("rides", -1)["exit_station"]
    rows = out.withColumn("_b", first).withColumn("_a", last)
    rows = rows.join(starts.select(F.col("b").alias("_b"), F.col("mode").alias("first_mode"), F.col("dur").alias("_d")), "_b").join(goals.select(F.col("a").alias("_a"), F.col("mode").alias("last_mode")), "_a")
    return rows.select((F.col("rides")[0]["dep"] - F.col("_d")).alias("departure"), "arrival", "transfers", "first_mode", "last_mode", "rides")


# --- batches ------------------------------------------------------------------------------------

REQUEST = "id long, start long, goal long, time long"


def batch(spark: SparkSession, requests: str, responses: str, t: Timetable, rounds: int = search.MAX_LEGS) -> DataFrame:
    """Answer a file of requests, one JSON object per line, as one search; answers are JSON lines with the requests' ids."""
    asked = spark.read.schema(REQUEST).json(requests)
    starts = asked.select("start", F.col("time").alias("t0")).distinct()
    found = search.run_rounds(t.conn, t.footpaths, starts, rounds, links=t.links)
    goals = asked.select("start", F.col("time").alias("t0"), "goal").distinct()
    made = search.journeys(search.journey_legs(found, goals))
    made = made.groupBy("start", "t0", "goal").agg(F.array_sort(F.collect_list(F.struct("departure", "arrival", "transfers", "rides"))).alias("journeys"))  # at most one per number of trips
    out = asked.join(made.withColumnRenamed("t0", "time"), ["start", "time", "goal"], "left").select("id", "start", "goal", "time", F.coalesce("journeys", F.array().cast(made.schema["journeys"].dataType)).alias("journeys"))
    out.write.mode("overwrite").json(responses)
    return spark.read.schema(out.schema).json(responses)


def compare(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, outcome) of two answers' rows: equal, differ, only_1 or only_2; each has one row per key."""
    rest = [c for c in one.columns if c not in keys]
    a = one.select(*keys, F.struct(*rest).alias("_a"))
    b = other.select(*keys, F.struct(*rest).alias("_b"))
    outcome = F.when(F.col("_b").isNull(), "only_1").when(F.col("_a").isNull(), "only_2").when(F.col("_a").eqNullSafe(F.col("_b")), "equal").otherwise("differ")
    return a.join(b, keys, "full").select(*keys, outcome.alias("outcome"))


def quantiles(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and the 50, 80 and 90 % quantiles (a value that occurs) of a metric."""
    q = lambda p, name: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").cast("long").alias(name)
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), q(0.5, "q50"), q(0.8, "q80"), q(0.9, "q90"))


OPERATIONS: dict[str, object] = {}


def operation(name: str):
    """Register a function under a path; a name is taken once."""

    def add(f):
        if name in OPERATIONS:
            raise ValueError(f"operation exists already: {name}")
        OPERATIONS[name] = f
        return f

    return add


def call(name: str, *args, **options):
    """Run a registered operation."""
    if name not in OPERATIONS:
        raise KeyError(f"no such operation: {name}")
    return OPERATIONS[name](*args, **options)


operation("/search")(answer)
operation("/search/via")(answer_via)
operation("/search/types")(labels)
operation("/search/pareto")(pareto.pareto_search)
operation("/search/intermodal")(intermodal)
operation("/batch")(batch)
