"""Multi-criteria search: criteria are plug-ins that say how a label begins, changes and compares.

A label is a row; a round boards, rides and walks like ``search``, but a station may hold several
labels: those no other label of the station dominates in arrival, trips and all criteria.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import overlap_per_day
from .relational import bucketed, cut, skyline
from .search import CONN, HORIZON, KEYS, MAX_LEGS, Walks, small

#: Cents per kilometre by class (0 ICE, 1-3 long distance, 4-8 local), minutes a transfer weighs,
#: largest weight of a journey, cents a minute is worth, most cents of regional fares, relaxation of prices, night,
#: walks in a row that are not absurd.
CENTS_PER_KM = (22, 18, 18, 18, 15, 15, 15, 15, 15, 0)
TRANSFER_WEIGHT, MOST_WEIGHT, CENTS_PER_MINUTE, REGIONAL_CAP, PRICE_RELAXATION = 20, 1580, 8, 4200, 1000
NIGHT = (1380, 240)
SUCCESSIVE_WALKS = 3


def cents(clasz: Column, km: Column) -> Column:
    """Fare of a section by class and distance, in whole cents."""
    rate = F.get(F.array(*map(F.lit, CENTS_PER_KM)), clasz.cast("int"))
    return F.floor(F.coalesce(rate, F.lit(0)) * km).cast("long")


@dataclass(frozen=True)
class Criterion:
    """A column of a label that is to be small.

    ``start``: its first value.  ``ride(value, row)``: the value after a ride, where ``row(name)`` is a
    column of the ride (was: arrival before it, ready, dep, arr, legs, the sums of ``sums``) or a criterion before it;
    ``walk(value, row)``: after a walk (row: arr, ready, dur, criteria before it, end: when one is there).  ``sums``: columns of
    connections that are summed over a ride.  ``keep``: a filter of labels.  ``kind``: ``less``; ``equal``:
    labels of different values don't dominate each other; ``carried``: not compared; ``search``: compared in the
    search, not between answers; ``tie``: likewise, but decides between answers equal in all else.  ``order(row)`` is what labels are compared by
    instead of the value.  Values must not fall along a journey.
    """

    name: str
    start: Column | int
    ride: Callable[[Column, Callable[[str], Column]], Column]
    walk: Callable[[Column, Callable[[str], Column]], Column] = lambda v, row: v
    sums: tuple[str, ...] = ()
    keep: Callable[[Column], Column] | None = None
    kind: str = "less"
    order: Callable[[Callable[[str], Column]], Column] | None = None


TRAVEL_TIME = Criterion("travel_time", 0, lambda v, r: r("arr") - r("t0"), lambda v, r: r("ready") - r("t0"), keep=lambda v: v <= HORIZON)
PRICE = Criterion("price", 0, lambda v, r: v + r("fare"), sums=("fare",))
#: Fares so far, without regional ones where those are capped; and as much compared in a search.
FARES = Criterion("fares", 0, lambda v, r: v + r("fare"), sums=("fare",), kind="carried")
FARES_COUNT = replace(FARES, kind="search")
#: Price with what the time since the start is worth.  Of labels of a station the time until both go on costs the
#: same, so they are compared by time and fares.
WAGE_PRICE = Criterion("wage_price", 0, lambda v, r: r("fares") + r("fare") + CENTS_PER_MINUTE * (r("arr") - r("t0")), lambda v, r: r("fares") + CENTS_PER_MINUTE * (r("end") - r("t0")), sums=("fare",), order=lambda r: r("fares"))
#: Regional fares so far, up to their cap in total.
REGIONAL_USED = Criterion("regional_used", 0, lambda v, r: F.least(v + r("regional"), F.lit(REGIONAL_CAP)), sums=("regional",), kind="carried")
#: Price whose regional fares are capped.  A label betters another if it is no dearer now, and no dearer when both have
#: used up the cap, that is in its other fares: what it has left of the cap may still fall due.
REGIONAL_PRICE = Criterion(
    "regional_price", 0, lambda v, r: r("fares") + r("fare") + F.least(r("regional_used") + r("regional"), F.lit(REGIONAL_CAP)) + CENTS_PER_MINUTE * (r("arr") - r("t0")),
    lambda v, r: r("fares") + r("regional_used") + CENTS_PER_MINUTE * (r("end") - r("t0")), sums=("fare", "regional"), order=lambda r: r("fares") + r("regional_used"),
)
#: Minutes by night since the start, a hotel's left out; what a change adds counts where a label goes on.
NIGHT_PENALTY = Criterion("night", 0, lambda v, r: v + overlap_per_day(r("was"), r("arr"), *NIGHT), lambda v, r: v + overlap_per_day(r("arr"), r("end"), *NIGHT), order=lambda r: r("night") + overlap_per_day(r("arr"), r("ready"), *NIGHT))
#: Walks in a row, and those of them that are absurd; they break ties and exclude nothing.
WALKS = Criterion("walks", 0, lambda v, r: F.lit(0), lambda v, r: v + F.when(r("dur") > 0, 1).otherwise(0), kind="carried")
ABSURDITY = Criterion("absurdity", 0, lambda v, r: v, lambda v, r: v + F.when((r("dur") > 0) & (r("walks") >= SUCCESSIVE_WALKS), 1).otherwise(0), kind="tie")
#: 0 no hotel yet, 1 after one; set by extra edges.
HOTEL = Criterion("hotel", 0, lambda v, r: v, kind="equal")
WEIGHTED = Criterion("weight", 0, lambda v, r: r("arr") - r("t0") + TRANSFER_WEIGHT * r("legs"), keep=lambda v: v <= MOST_WEIGHT)

#: Search types: the criteria beside arrival and trips.
SEARCHES = {
    "default": (TRAVEL_TIME,),
    "price": (PRICE,),
    "wage_price": (FARES, WAGE_PRICE),
    "regional_price": (FARES_COUNT, REGIONAL_USED, REGIONAL_PRICE),
    "late_connections": (PRICE, NIGHT_PENALTY, HOTEL),
    "absurdity": (WALKS, ABSURDITY),
    "weighted": (WEIGHTED,),
}


def dominates(less: list[str], same: list[str] = (), relaxed: dict[str, int] | None = None) -> Callable[[Callable, Callable], Column]:
    """Predicate (a, b): a is no worse than b in ``less``, equal in ``same``, better somewhere; ``relaxed``: a must be
    better by so much to count."""
    slack = relaxed or {}

    def rule(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
        cond, better = F.lit(True), F.lit(False)
        for c in less:
            cond, better = cond & (a(c) + slack.get(c, 0) <= b(c)), better | (a(c) + slack.get(c, 0) < b(c))
        for c in same:
            cond = cond & (a(c) == b(c))
        return cond & better

    return rule


def undominated(rows: DataFrame, by: list[str], rule) -> DataFrame:
    """Rows that no other row of their group dominates by ``rule``; groups are a station's labels of one search."""
    other = rows.select([F.col(c).alias(f"_{c}") for c in rows.columns]).distinct()
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(other, same & rule(lambda c: F.col(f"_{c}"), F.col), "left_anti")


def comparable_in_time(rule, begin: str = "departure", end: str = "arrival"):
    """``rule`` only between journeys of which one lies in the other's time: it departs no earlier and arrives no later."""
    return lambda a, b: (a(begin) >= b(begin)) & (a(end) <= b(end)) & rule(a, b)


def alpha_dominance(rows: DataFrame, by: list[str], dep: str = "dep", arr: str = "arr", alpha: float = 0.5) -> DataFrame:
    """Journeys without those that are slow for how little they differ in time: a removes b where
    t(a) + alpha * t(a) / t(b) * min(|difference of departures|, |of arrivals|) < t(b)."""

    def rule(a, b):
        t, u = a(arr) - a(dep), b(arr) - b(dep)
        return t + alpha * t / u * F.least(F.abs(a(dep) - b(dep)), F.abs(a(arr) - b(arr))) < u

    return undominated(rows, by, rule)


def pareto_search(conn: DataFrame, footpaths: DataFrame | Walks, starts: DataFrame, criteria: tuple[Criterion, ...], rounds: int = MAX_LEGS, extra_edges: DataFrame | None = None, goals: DataFrame | None = None, log: list | None = None) -> DataFrame:
    """(start, t0, station, arr, legs, criteria): all Pareto-optimal labels, of the goals' stations if there are goals.

    ``conn`` has the columns that the criteria sum.  ``extra_edges`` (a, b, dur, open_from, open_to, price,
    hotel, taxi): further edges beside footpaths, for instance a taxi by day, a hotel stay, a rented
    bike; a null window is always open, otherwise the traveller waits for it.  A taxi after a hotel is filtered.
    With ``goals`` (goal) labels from which none is reached in time go, and those that a label at every goal they
    could still reach beats whatever follows: it is there before the least possible time, with no more trips and
    no worse criteria.  ``log`` gets (round, labels that go on).
    """
    if len(criteria) == 1 and criteria[0] is PRICE and extra_edges is None and goals is None:
        return _cheapest(conn, footpaths, starts, rounds, log)
    names, sums = [c.name for c in criteria], sorted({s for c in criteria for s in c.sums})
    label = [*KEYS, "station", "ready", "arr", "legs", *names]
    value = lambda c: c.start if isinstance(c.start, Column) else F.lit(c.start)
    total = Window.partitionBy("trip_id", "day").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    links = conn.select("from_station", "to_station", (F.col("arr") - F.col("dep")).alias("minutes")) if goals is not None else None
    conn = conn.select(*CONN, *[F.sum(s).over(total).alias(s) for s in sums], *[(F.sum(s).over(total) - F.col(s)).alias(f"{s}_before") for s in sums])
    conn = bucketed(conn, ["trip_id", "day"])
    at = starts.select(*KEYS, F.col("start").alias("station"), F.col("t0").cast("long").alias("ready"), F.col("t0").cast("long").alias("arr"), F.lit(0).alias("legs"), *[value(c).cast("long").alias(c.name) for c in criteria])
    bounds = None if goals is None else _bounds(links, footpaths, extra_edges, goals)
    delta, best, found = cut(at), None, None
    pairs = footpaths.pairs if isinstance(footpaths, Walks) else footpaths
    same = [c.name for c in criteria if c.kind == "equal"]
    compared = [c for c in criteria if c.kind in ("less", "search", "tie")]
    plain = [c.name for c in criteria if c.kind == "less"]

    orders = [c.order(F.col) if c.order else F.col(c.name) for c in compared]
    for k in range(1, rounds + 1):
        met = conn.filter("in_allowed").select("trip_id", "day", F.col("seq").alias("enter"), "from_station", F.col("dep").alias("_dep"), *[F.col(f"{s}_before").alias(f"_b_{s}") for s in sums])
        board = met.join(small(delta, delta.count()), F.col("from_station") == F.col("station")).filter((F.col("_dep") >= F.col("ready")) & (F.col("_dep") <= F.col("t0") + HORIZON)).drop("from_station", "legs")
        # wherever a trip can be boarded: one that comes twice to a station may be cheaper the second time
        board = board.select(*KEYS, "trip_id", "day", "ready", F.col("arr").alias("was"), *names, F.struct("enter", F.col("_dep").alias("dep"), *[f"_b_{s}" for s in sums]).alias("on"))
        rides = board.join(conn.filter("out_allowed").select("trip_id", "day", "seq", "to_station", F.col("arr").alias("_arr"), *[F.col(s).alias(f"_e_{s}") for s in sums]), ["trip_id", "day"])
        rides = rides.filter((F.col("seq") >= F.col("on.enter")) & (F.col("_arr") <= F.col("t0") + HORIZON))

        def row(c: str) -> Column:
            if c in sums:
                return F.col(f"_e_{c}") - F.col(f"on._b_{c}")
            return {"arr": F.col("_arr"), "dep": F.col("on.dep"), "legs": F.lit(k)}.get(c, F.col(c))

        come = rides.select(*KEYS, F.col("to_station").alias("station"), F.col("_arr").alias("arr"), F.lit(k).alias("legs"), *[c.ride(F.col(c.name), row).cast("long").alias(c.name) for c in criteria])
        for c in criteria:
            come = come.filter(c.keep(F.col(c.name))) if c.keep else come
        come = cut(skyline(come.distinct().withColumn("ready", F.col("arr")), [*KEYS, "station", *same], ["arr", *orders]).drop("ready"))
        end = F.when(F.col("a") == F.col("b"), F.col("arr")).otherwise(F.col("_ready"))
        step = lambda c: {"ready": F.col("_ready"), "end": end}.get(c, F.col(c))  # noqa: E731, B023
        walk = come.join(pairs.select("a", "b", "dur"), F.col("station") == F.col("a")).withColumn("_ready", F.col("arr") + F.col("dur")).withColumn("dur", F.when(F.col("a") == F.col("b"), 0).otherwise(F.col("dur")))
        new = walk.select(*KEYS, F.col("b").alias("station"), F.col("_ready").alias("ready"), end.alias("arr"), "legs", *[c.walk(F.col(c.name), step).cast("long").alias(c.name) for c in criteria])
        if isinstance(footpaths, Walks):
            new = new.unionByName(_through_hubs(come, footpaths, criteria, same, orders).select(*new.columns))
        if extra_edges is not None:
            new = new.unionByName(_extra(come, extra_edges, criteria, label))
        for c in criteria:
            new = new.filter(c.keep(F.col(c.name))) if c.keep else new
        new = cut(new.distinct())
        # by arrival for the answer, by ready time for what goes on: a walk may be ready sooner than a train that came earlier
        out = new.select(*KEYS, "station", "arr", "legs", *names)
        if goals is not None:
            out = out.join(goals.select(F.col("goal").alias("station")).distinct(), "station", "left_semi").select(*out.columns)
        found = cut(skyline((out if found is None else out.unionByName(found)).distinct(), [*KEYS, "station", *same], ["arr", "legs", *plain]))
        if bounds is not None:
            new = cut(_promising(new, bounds, found, [c.name for c in compared] if not same else None))
        every = new if best is None else new.unionByName(best)
        best = cut(skyline(every.distinct(), [*KEYS, "station", *same], ["ready", "legs", *orders]))
        delta = best.filter(F.col("legs") == k)
        if log is not None:
            log.append((k, delta.count()))
        if delta.isEmpty():
            break
    ties = [c.name for c in criteria if c.kind == "tie"]
    return skyline(found, [*KEYS, "station", *same, "arr", "legs", *plain], ties) if ties else found


#: Minutes of a slot of time by which labels and departures meet.
SLOT = 60


def _first(rows: DataFrame, by: list[str], at: str) -> DataFrame:
    """Rows (by, at, price, _old) that no other of their group reaches as soon and as cheaply; of equal ones an old one stays."""
    w = Window.partitionBy(*by).orderBy(at, "price", F.desc("_old")).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_least", F.min("price").over(w)).filter("_least IS NULL OR price < _least").drop("_least")


def _cheapest(conn: DataFrame, footpaths: DataFrame | Walks, starts: DataFrame, rounds: int, log: list | None) -> DataFrame:
    """``pareto_search`` by price alone, where running minima do what comparing labels does with more criteria.

    A departure is boarded once, by the cheapest label that is ready: labels hold until the next cheaper one is ready, and meet
    departures by station and slot of time.  An arrival is the cheapest ride to it.  Later rounds have more trips, so what is
    known of a station is its frontier: new labels are compared with that and each other, and none is looked at again.
    """
    total = Window.partitionBy("trip_id", "day").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    conn = bucketed(conn.select(*CONN, F.sum("fare").over(total).alias("upto"), (F.sum("fare").over(total) - F.col("fare")).alias("before")), ["trip_id", "day"])
    slot = lambda c: F.floor(c / F.lit(SLOT)).cast("long")
    departures = bucketed(conn.filter("in_allowed").select("from_station", slot(F.col("dep")).alias("slot"), "dep", "trip_id", "day", F.col("seq").alias("enter"), "before"), ["from_station"])
    arrivals = conn.filter("out_allowed").select("trip_id", "day", "seq", F.col("to_station").alias("station"), "arr", "upto")
    pairs = footpaths.pairs if isinstance(footpaths, Walks) else footpaths
    last = F.col("t0") + HORIZON
    new, old = F.lit(False).alias("_old"), F.lit(True).alias("_old")
    price = F.min("price").alias("price")
    at = starts.select(*KEYS, F.col("start").alias("station"), F.col("t0").cast("long").alias("ready"), F.lit(PRICE.start).cast("long").alias("price"), new).distinct()
    ready, parts, doors, came = cut(at), [], None, None
    until = F.coalesce(F.lead("ready").over(Window.partitionBy(*KEYS, "station").orderBy("ready")), last + 1)
    for k in range(1, rounds + 1):
        labels = ready.withColumn("until", F.least(until, last + 1)).filter("NOT _old").filter(F.col("ready") <= last)
        labels = cut(labels.select(*KEYS, "station", F.explode(F.sequence(slot(F.col("ready")), slot(F.col("until") - 1))).alias("slot"), "ready", "until", "price"))
        met = departures.join(small(labels.withColumnRenamed("station", "from_station"), labels.count()), ["from_station", "slot"]).filter("dep >= ready AND dep < until")
        board = met.select(*KEYS, "trip_id", "day", "enter", (F.col("price") - F.col("before")).alias("base"))
        rides = board.join(arrivals, ["trip_id", "day"]).filter((F.col("seq") >= F.col("enter")) & (F.col("arr") <= last))
        come = rides.groupBy(*KEYS, "station", "arr").agg(F.min(F.col("base") + F.col("upto")).cast("long").alias("price"))
        come = cut(_first(come.withColumn("_old", new), [*KEYS, "station"], "arr").drop("_old"))
        then = F.col("arr") + F.col("dur")
        walk = come.join(pairs.select("a", "b", "dur"), F.col("station") == F.col("a"))
        walk = walk.select(*KEYS, F.col("b").alias("station"), then.cast("long").alias("ready"), F.when(F.col("a") == F.col("b"), F.col("arr")).otherwise(then).cast("long").alias("arr"), "price")
        if isinstance(footpaths, Walks):  # what a door knows from fewer trips, its stations know as well
            hubs = come.join(footpaths.enter, F.col("station") == F.col("a")).groupBy(*KEYS, "hub", "arr").agg(price)
            far = hubs.join(footpaths.across, "hub").groupBy(*KEYS, "door", then.cast("long").alias("ready")).agg(price).withColumn("_old", new)
            doors = cut(_first(far if doors is None else far.unionByName(doors.withColumn("_old", old)), [*KEYS, "door"], "ready"))
            walk = walk.unionByName(doors.filter("NOT _old").join(footpaths.leave, "door").select(*KEYS, F.col("b").alias("station"), "ready", F.col("ready").alias("arr"), "price"))
        by_ready = walk.groupBy(*KEYS, "station", "ready").agg(price).withColumn("_old", new)
        ready = cut(_first(by_ready.unionByName(ready.withColumn("_old", old)), [*KEYS, "station"], "ready"))
        by_arrival = walk.groupBy(*KEYS, "station", "arr").agg(price).withColumn("_old", new)
        came = cut(_first(by_arrival if came is None else by_arrival.unionByName(came.withColumn("_old", old)), [*KEYS, "station"], "arr"))
        parts.append(came.filter("NOT _old").select(*KEYS, "station", "arr", F.lit(k).alias("legs"), "price"))
        if log is not None:
            log.append((k, ready.filter("NOT _old").count()))
        if ready.filter("NOT _old").isEmpty():
            break
    found = parts[0]
    for rows in parts[1:]:
        found = found.unionByName(rows)
    return found


def _through_hubs(come: DataFrame, walks: Walks, criteria: tuple[Criterion, ...], same: list[str], orders: list[Column]) -> DataFrame:
    """Labels after walks through hubs: a hub and a door hold labels that no other there dominates, as a station does, and all
    of them take equally long from there; those back at their own station are dominated by its transfer."""
    rest = ["legs", *[c.name for c in criteria]]
    hubs = come.join(walks.enter, F.col("station") == F.col("a")).select(*KEYS, "hub", F.col("arr").alias("ready"), "arr", *rest).distinct()
    hubs = skyline(hubs, [*KEYS, "hub", *same], ["ready", *orders])
    at = hubs.join(walks.across, "hub").withColumn("_ready", F.col("ready") + F.col("dur"))
    step = lambda c: F.col("_ready") if c in ("ready", "end") else F.col(c)
    doors = at.select(*KEYS, "door", F.col("_ready").alias("ready"), F.col("_ready").alias("arr"), "legs", *[c.walk(F.col(c.name), step).cast("long").alias(c.name) for c in criteria])
    doors = skyline(doors.distinct(), [*KEYS, "door", *same], ["ready", *orders])
    return doors.join(walks.leave, "door").withColumn("station", F.col("b"))


def _bounds(links: DataFrame, footpaths: DataFrame | Walks, extra_edges: DataFrame | None, goals: DataFrame) -> DataFrame:
    """(goal, station, minutes): no journey from the station reaches the goal sooner; stations without any are missing."""
    feet = (footpaths.edges() if isinstance(footpaths, Walks) else footpaths).filter("a <> b").select(F.col("a").alias("from_station"), F.col("b").alias("to_station"), F.col("dur").cast("long").alias("minutes"))
    edges = links.unionByName(feet)
    if extra_edges is not None:
        edges = edges.unionByName(extra_edges.filter("a <> b").select(F.col("a").alias("from_station"), F.col("b").alias("to_station"), F.col("dur").cast("long").alias("minutes")))
    least = edges.groupBy("from_station", "to_station").agg(F.min("minutes").alias("minutes"))
    return lower_bounds(least, goals.select(F.col("goal").cast("long").alias("goal")).distinct())


def _promising(new: DataFrame, bounds: DataFrame, found: DataFrame, plain: list[str] | None) -> DataFrame:
    """Labels that may still make an answer at some goal; ``plain``: criteria by which answers beat them, None if they can't."""
    rows = new.join(bounds, "station").withColumn("_least", F.col("ready") + F.when(F.col("minutes") == 0, F.col("arr") - F.col("ready")).otherwise(F.col("minutes")))
    rows = rows.filter(F.col("_least") <= F.col("t0") + HORIZON)
    if plain is not None:  # answers at a goal are few: its skyline
        done = found.select(*[F.col(c).alias(f"_g_{c}") for c in [*KEYS, "station", "arr", "legs", *plain]])
        beaten = (F.col("_g_arr") <= F.col("_least")) & (F.col("_g_legs") <= F.col("legs"))
        for c in plain:
            beaten = beaten & (F.col(f"_g_{c}") <= F.col(c))
        key = (F.col("_g_start") == F.col("start")) & (F.col("_g_t0") == F.col("t0")) & (F.col("_g_station") == F.col("goal"))
        rows = rows.join(small(done, done.count()), key & beaten, "left_anti")
    return rows.select(*new.columns).distinct()


def _extra(come: DataFrame, edges: DataFrame, criteria, label: list[str]) -> DataFrame:
    """Labels after an extra edge; the wait for its window counts."""
    from ..functions.scalars import periodic_wait

    rows = come.join(edges, F.col("station") == F.col("a"))
    wait = F.when(F.col("open_from").isNull(), F.lit(0)).otherwise(periodic_wait(F.col("open_from"), F.col("open_to"), F.col("arr")))
    rows = rows.withColumn("_ready", F.col("arr") + wait + F.col("dur"))
    names = {c.name for c in criteria}
    if "hotel" in names:
        rows = rows.filter(~((F.col("hotel") == 1) & F.coalesce("taxi", F.lit(False))))
    extra = dict.fromkeys(("price", "fares", "wage_price", "regional_price"), F.coalesce("price_of_edge", F.lit(0)))
    out = []
    step = lambda c: {"ready": F.col("_ready"), "end": F.col("_ready")}.get(c, F.col(c))
    for c in criteria:
        v = c.walk(F.col(c.name), step)
        if c.name in extra:
            v = v + extra[c.name]
        if c.name == "hotel":
            v = F.when(F.coalesce("is_hotel", F.lit(False)), F.lit(1)).otherwise(v)
        if c.name == "night":  # a stay in a hotel is no night on the way
            v = F.when(F.coalesce("is_hotel", F.lit(False)), F.col("night")).otherwise(v)
        out.append(v.cast("long").alias(c.name))
    return rows.select(*KEYS, F.col("b").alias("station"), F.col("_ready").alias("ready"), F.col("_ready").alias("arr"), "legs", *out)


def extra_edges(*kinds: DataFrame) -> DataFrame:
    """Union of edges of any kind with the columns of ``pareto_search``'s extra edges; absent ones are null."""
    columns = {"a": "long", "b": "long", "dur": "long", "open_from": "long", "open_to": "long", "price_of_edge": "long", "is_hotel": "boolean", "taxi": "boolean"}
    out = None
    for k in kinds:
        rows = k.select(*[(F.col(c) if c in k.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])
        out = rows if out is None else out.unionByName(rows)
    return out


def relaxed(found: DataFrame, less: int = PRICE_RELAXATION) -> DataFrame:
    """Late connections after a search: a journey must be cheaper by ``less`` to remove another of no less night."""
    return undominated(found, [*KEYS, "station"], dominates(["arr", "legs", "price", "night"], relaxed={"price": less}))


def lower_bounds(edges: DataFrame, goals: DataFrame) -> DataFrame:
    """(goal, station, minutes): least possible minutes from every station to each goal over (from_station, to_station,
    minutes), by relaxation until nothing improves."""
    best = cut(goals.select("goal", F.col("goal").alias("station"), F.lit(0).cast("long").alias("minutes")))
    new = best
    e = cut(edges.select(F.col("to_station").alias("station"), "from_station", F.col("minutes").alias("_m")))
    while True:
        step = new.join(e, "station").groupBy("goal", F.col("from_station").alias("station")).agg(F.min(F.col("minutes") + F.col("_m")).alias("minutes"))
        old = best.select("goal", "station", F.col("minutes").alias("_old"))
        new = cut(step.join(old, ["goal", "station"], "left").filter("_old IS NULL OR minutes < _old").drop("_old"))
        if new.isEmpty():
            return best
        best = cut(best.unionByName(new).groupBy("goal", "station").agg(F.min("minutes").alias("minutes")))
