"""Probabilistic delays.

A distribution is an array of (minute, p); lookups, products and differences of it are column
expressions on one row.  Where distributions of different rows meet (convolution, feeders) they are
exploded to (key, minute, p) and joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import Tables, cut

#: Share of trains that run; feeders arrive at most so long before; shortest stop.
TRAIN_RATING, FEEDER_MINUTES, STANDING = 0.995, 30, 2
#: Fixed value: probabilities below this are cut from both ends of a distribution.
EPS = 1e-5

DIST = "array<struct<minute:bigint,p:double>>"


# --- distributions as arrays ----------------------------------------------------------------


def total(dist: Column, where=None) -> Column:
    """Probability of the minutes for which ``where`` holds."""
    rows = dist if where is None else F.filter(dist, lambda x: where(x["minute"]))
    return F.aggregate(rows, F.lit(0.0), lambda s, x: s + x["p"])


def at_most(dist: Column, t: Column) -> Column:
    return total(dist, lambda m: m <= t)


def exactly(dist: Column, t: Column) -> Column:
    return total(dist, lambda m: m == t)


def before(dist: Column, t: Column) -> Column:
    return total(dist, lambda m: m < t)


def last_minute(dist: Column) -> Column:
    return F.array_max(F.transform(dist, lambda x: x["minute"]))


def one_point(minute: Column, p: Column) -> Column:
    return F.array(F.struct(minute.cast("long").alias("minute"), p.cast("double").alias("p")))


def as_rows(df: DataFrame, dist: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.explode(dist).alias("_x")).select(*keys, "_x.minute", "_x.p")


def as_array(df: DataFrame, *keys: str, name: str = "dist") -> DataFrame:
    """(keys, dist) from (keys, minute, p): a distribution's minutes are few."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("minute").cast("long").alias("minute"), F.col("p").cast("double").alias("p")))).alias(name))


def trim(dist: DataFrame, key: str = "key", eps: float = EPS) -> DataFrame:
    """Drop minutes below ``eps`` at both ends; the mass goes to the first minute that stays."""
    w = Window.partitionBy(key)
    big = F.when(F.col("p") >= eps, F.col("minute"))
    kept = dist.withColumn("lo", F.min(big).over(w)).withColumn("hi", F.max(big).over(w))
    lost = F.sum(F.when((F.col("minute") < F.col("lo")) | (F.col("minute") > F.col("hi")), F.col("p")).otherwise(0.0)).over(w)
    return kept.withColumn("p", F.when(F.col("minute") == F.col("lo"), F.col("p") + lost).otherwise(F.col("p"))).filter(F.col("minute").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


# --- lookups --------------------------------------------------------------------------------


def travel_distributions(asked: DataFrame, classes: DataFrame, mapping: DataFrame) -> DataFrame:
    """(..., dist_id) by class, travel time and departure delay.

    ``asked`` has category, travel, delay; ``classes`` (category, clasz), found in lower case;
    ``mapping`` (clasz, first_travel, last_travel, first_delay, last_delay, dist_id), both ends
    included.  Beyond the longest travel time, or the largest delay for it, the last one counts.
    """
    rows = asked.join(classes.select(F.lower("category").alias("_c"), F.col("clasz").alias("_class")), F.lower("category") == F.col("_c"), "left")
    most = mapping.groupBy("clasz").agg(F.max("last_travel").alias("_most"))
    rows = rows.join(most.withColumnRenamed("clasz", "_class"), "_class", "left").withColumn("_t", F.least("travel", "_most"))
    m = mapping.withColumn("_last", F.max("last_delay").over(Window.partitionBy("clasz", "first_travel", "last_travel")))
    fits = (F.col("_class") == F.col("clasz")) & F.col("_t").between(F.col("first_travel"), F.col("last_travel")) & F.least("delay", "_last").between(F.col("first_delay"), F.col("last_delay"))
    return rows.join(m, fits, "left").select(*asked.columns, "dist_id")


def waiting_times(pairs: DataFrame, groups: DataFrame, matrix: DataFrame, default: int = 0) -> DataFrame:
    """(..., wait): minutes that ``category`` waits for ``feeder_category``; unknown ones are of the default group."""
    g = lambda c, out: groups.select(F.col("category").alias(c), F.col("group").alias(out))
    rows = pairs.join(g("category", "_own"), "category", "left").join(g("feeder_category", "_feeder"), "feeder_category", "left")
    rows = rows.withColumn("_own", F.coalesce("_own", F.lit(default))).withColumn("_feeder", F.coalesce("_feeder", F.lit(default)))
    m = matrix.select(F.col("connecting").alias("_own"), F.col("feeder").alias("_feeder"), "wait")
    return rows.join(m, ["_own", "_feeder"], "left").select(*pairs.columns, F.coalesce("wait", F.lit(0)).alias("wait"))


def feeders(departures: DataFrame, arrivals: DataFrame, minutes: int = FEEDER_MINUTES) -> DataFrame:
    """Pairs of a departure (key, station_id, at, transfer, route) and an arrival (feeder, station_id, came, route)
    of another route, at least the transfer time (one minute) and at most ``minutes`` earlier.

    Both sides meet in buckets of ``minutes``: an arrival is looked for in a departure's bucket
    and the one before, so a station's day is not compared as a whole.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(minutes)).cast("long")
    d = departures.withColumn("_b", F.explode(F.array(bucket("at"), bucket("at") - 1)))
    a = arrivals.select(F.col("feeder"), "station_id", "came", F.col("route").alias("_route"), bucket("came").alias("_b"))
    rows = d.join(a, ["station_id", "_b"]).filter(F.col("came").between(F.col("at") - minutes, F.col("at") - F.greatest("transfer", F.lit(1))) & (F.col("_route") != F.col("route")))
    return rows.drop("_b", "_route")


# --- departures and arrivals ----------------------------------------------------------------


def convolve(departures: DataFrame, travel: DataFrame, key: str = "key") -> DataFrame:
    """Arrival distribution: the departure minute plus the travel time, probabilities multiplied."""
    t = travel.select(key, F.col("minute").alias("_m"), F.col("p").alias("_p"))
    return departures.join(t, key).groupBy(key, (F.col("minute") + F.col("_m")).alias("minute")).agg(F.sum(F.col("p") * F.col("_p")).alias("p"))


def arrival(departures: DataFrame, travel: DataFrame, key: str = "key") -> DataFrame:
    """Arrival delays (key, minute, p) from departure delays and travel-time deviations that depend on them.

    ``travel`` has (key, delay, minute, p); departure delays beyond the largest of a key use that
    one; a key without any arrives as late as it departs.  What rounding loses is added to the likeliest minute.
    """
    t = travel.select(key, F.col("delay").alias("_d"), F.col("minute").alias("_m"), F.col("p").alias("_p"))
    d = departures.join(t.groupBy(key).agg(F.max("_d").alias("_most")), key, "left")
    plain = d.filter("_most IS NULL").select(key, "minute", "p")
    rows = d.filter("_most IS NOT NULL").withColumn("_d", F.least("minute", "_most")).join(t, [key, "_d"])
    rows = rows.groupBy(key, (F.col("minute") + F.col("_m")).alias("minute")).agg(F.sum(F.col("p") * F.col("_p")).alias("p"))
    return corrected(rows, departures.groupBy(key).agg(F.sum("p").alias("want")), key).unionByName(plain)


def corrected(dist: DataFrame, want: DataFrame, key: str = "key") -> DataFrame:
    """``dist`` with the mass that it lacks of ``want`` added to its likeliest (first) minute."""
    have = dist.groupBy(key).agg(F.sum("p").alias("have"), F.max_by(F.col("minute"), F.struct("p", -F.col("minute"))).alias("mode"))
    rows = dist.join(have, key).join(want, key)
    return rows.select(key, "minute", F.when(F.col("minute") == F.col("mode"), F.col("p") + F.col("want") - F.col("have")).otherwise(F.col("p")).alias("p"))


def _independent(feeding: Column, t: Column) -> Column:
    """That no feeder makes the train wait past minute t: none comes later than t, but still in time to be waited for."""
    late = lambda f: total(f["dist"], lambda m: (m > t) & (m <= f["latest"]))
    return F.aggregate(feeding, F.lit(1.0), lambda s, f: s * F.when(t >= f["latest"], F.lit(1.0)).otherwise(1.0 - late(f)))


def departure_minutes(own: Column, feeding: Column, wait: Column, change: Column | None = None, change_latest: Column | None = None) -> Column:
    """Departure delays of one train as an array of (minute, p).

    ``own``: when the train itself could leave (minutes of delay); ``feeding``: array of (latest,
    dist), when a change from each feeder would be done and until when it is waited for; ``wait``:
    the longest waiting time.  At the schedule the train leaves if it is there and need not
    wait; up to ``wait`` it leaves when it comes or when the last awaited feeder does; then when it comes.
    With ``change`` (and ``change_latest``), the same given that the traveller's own change succeeds.
    """
    own, feeding = F.coalesce(own, F.array().cast(DIST)), feeding
    most = F.greatest(last_minute(own), wait, F.lit(0)).cast("long")

    def p(t: Column) -> Column:
        free, late_free = _independent(feeding, t), _independent(feeding, t - 1)
        waited = F.when(F.size(feeding) > 0, free - late_free).otherwise(F.lit(0.0))
        there, comes, was_there = at_most(own, t), exactly(own, t), before(own, t)
        if change is None:
            return F.when(t == 0, there * free).when(t <= wait, comes * free + was_there * waited).otherwise(comes)
        ready, gets = at_most(change, t), exactly(change, t)
        leaves = waited * ready + F.when(t <= change_latest, gets * (free - waited)).otherwise(F.lit(0.0))
        return F.when(t == 0, ready * there * free).when(t <= wait, comes * free * ready + was_there * leaves).otherwise(ready * comes)

    return F.transform(F.sequence(F.lit(0).cast("long"), most), lambda t: F.struct(t.alias("minute"), p(t).alias("p")))


def departures(trains: DataFrame, feeding: DataFrame | None = None) -> DataFrame:
    """(key, minute, p) of trains (key, own [, change, change_latest, wait, is_delay]) with feeders (key, feeder, latest, dist).

    A train whose departure was measured (``is_delay``) leaves at that minute for sure; ``wait`` is how long it
    waits whatever its feeders.
    """
    kind = "array<struct<latest:bigint,dist:array<struct<minute:bigint,p:double>>>>"
    rows = trains
    if feeding is not None:
        f = feeding.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("feeder", F.col("latest").cast("long").alias("latest"), "dist"))).alias("_f"), F.max("wait").alias("_wait"))  # feeders of half an hour
        rows = rows.join(f, "key", "left").withColumn("_f", F.transform("_f", lambda x: F.struct(x["latest"].alias("latest"), x["dist"].alias("dist"))))
    else:
        rows = rows.withColumn("_f", F.lit(None)).withColumn("_wait", F.lit(0))
    rows = rows.withColumn("_f", F.coalesce(F.col("_f").cast(kind), F.array().cast(kind))).withColumn("_wait", F.coalesce("_wait", F.lit(0)))
    if "wait" in trains.columns:
        rows = rows.withColumn("_wait", F.greatest("_wait", "wait"))
    change = (F.col("change"), F.col("change_latest")) if "change" in trains.columns else (None, None)
    out = departure_minutes(F.col("own"), F.col("_f"), F.col("_wait"), *change)
    if "is_delay" in trains.columns:
        out = F.when(F.col("is_delay").isNotNull(), one_point(F.greatest("is_delay", F.lit(0)), total(F.col("own")))).otherwise(out)
    return as_rows(rows.select("key", out.alias("_dist")), "_dist", "key")


def departure(own: DataFrame, feeders: DataFrame, key: str = "key") -> DataFrame:
    """Departure distribution of a train that waits for all feeders without limit: the product of the cumulative
    distributions, differenced."""
    minutes = own.select(key, "minute").unionByName(feeders.select(key, "minute")).distinct()
    o = own.select(key, F.col("minute").alias("m1"), F.col("p").alias("p1"))
    base = minutes.join(o, key).groupBy(key, "minute").agg(F.sum(F.when(F.col("m1") <= F.col("minute"), F.col("p1")).otherwise(0.0)).alias("c"))
    f = feeders.select(key, "feeder", F.col("minute").alias("m2"), F.col("p").alias("p2"))
    each = minutes.join(f, key).groupBy(key, "minute", "feeder").agg(F.sum(F.when(F.col("m2") <= F.col("minute"), F.col("p2")).otherwise(0.0)).alias("c"))
    wait = each.groupBy(key, "minute").agg(F.product("c").alias("w"))
    w = Window.partitionBy(key).orderBy("minute")
    both = base.join(wait, [key, "minute"], "left").withColumn("cum", F.col("c") * F.coalesce("w", F.lit(1.0)))
    return both.select(key, "minute", (F.col("cum") - F.coalesce(F.lag("cum").over(w), F.lit(0.0))).alias("p"))


def shifted(arrivals: DataFrame, by: Column) -> DataFrame:
    """(..., minute, p): delays at an arrival as delays of what follows ``by`` minutes later."""
    return arrivals.withColumn("minute", F.col("minute") + by)


# --- whole timetable --------------------------------------------------------------------------


LATE = "key {0}, on {0}, minute long, p double, moved boolean"


def _sections(conn: DataFrame, feeding: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(sections with their level, (key, on, level of key) of what they need, feeders with shifts, number of levels).

    A section's level is one more than those of its predecessors (the section before, its feeders), so all sections of
    a level are done in one step.
    """
    w = Window.partitionBy("trip_id", "day").orderBy("seq")
    rows = conn.withColumn("before", F.lag("key").over(w)).withColumn("came", F.lag("arr").over(w)).select("key", "before", "came", "dep", "arr")
    rows = cut(rows)
    needs = rows.filter("before IS NOT NULL").select("key", F.col("before").alias("on")).unionByName(feeding.select("key", F.col("feeder").alias("on"))).distinct()
    needs = cut(needs.join(rows.select(F.col("key").alias("on")), "on", "left_semi").join(rows.select("key"), "key", "left_semi"))
    levels, left, level = Tables(conn.sparkSession), rows.select("key"), 0
    while True:  # a level: all whose needs have levels
        open_ = needs.join(left.withColumnRenamed("key", "on"), "on", "left_semi").select("key").distinct()
        ready = left.join(open_, "key", "left_anti").withColumn("level", F.lit(level))
        if not levels.add(ready):
            if level and left.isEmpty():
                break
            if not left.isEmpty():
                raise ValueError("sections wait for each other in a circle")
            break
        level += 1
        needs_left = needs.join(open_, "key", "left_semi")
        left, needs = cut(left.join(open_, "key", "left_semi")), cut(needs_left)
    at = levels.read(left.withColumn("level", F.lit(0)).schema)
    rows = cut(rows.join(at, "key"))
    sched = rows.select(F.col("key").alias("feeder"), F.col("arr").alias("f_arr"))
    fed = feeding.join(sched, "feeder").join(rows.select("key", "level", F.col("dep").alias("_dep")), "key")
    fed = fed.select("key", "feeder", "wait", "level", (F.col("f_arr") + F.col("transfer") - F.col("_dep")).alias("shift"))
    on = rows.filter("before IS NOT NULL").select("key", F.col("before").alias("on"), "level").unionByName(fed.select("key", F.col("feeder").alias("on"), "level")).distinct()
    return rows, cut(on), cut(fed), level


def _level(now: DataFrame, inputs: DataFrame, start: DataFrame, travel: DataFrame, fed: DataFrame, measured: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(departures, arrivals) of the sections ``now`` of one level from ``inputs`` (key, on, minute, p), the arrivals they need."""
    first = now.filter("before IS NULL").join(as_array(start, "key", name="own"), "key").select("key", "own")
    own = now.join(inputs.withColumnRenamed("on", "before"), ["key", "before"]).withColumn("minute", F.col("minute") + F.col("came") + F.least(F.lit(STANDING), F.col("dep") - F.col("came")) - F.col("dep"))
    trains = first.unionByName(as_array(own.select("key", "minute", "p"), "key", name="own"))
    if measured is not None:
        trains = trains.join(measured.select("key", "is_delay"), "key", "left")
    f = fed.join(inputs.withColumnRenamed("on", "feeder"), ["key", "feeder"]).withColumn("minute", F.col("minute") + F.col("shift"))
    f = as_array(f.select("key", "feeder", "wait", "minute", "p"), "key", "feeder", "wait").withColumn("latest", F.col("wait"))
    out = cut(departures(trains, f))
    return out, cut(arrival(out, travel.join(now.select("key"), "key", "left_semi")))


def timetable_distributions(conn: DataFrame, start: DataFrame, travel: DataFrame, feeding: DataFrame, measured: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((key, minute, p) of departures, of arrivals) of every section of ``conn``.

    ``conn`` has (key, trip_id, day, seq, dep, arr); ``start`` (key, minute, p) for first sections;
    ``travel`` (key, delay, minute, p); ``feeding`` (key, feeder, wait, transfer): sections whose
    arrival a departure waits for; ``measured`` (key, is_delay): departures that took place.

    Each arrival is written once for every section that needs it, under that section's level, so a level
    reads its own inputs and nothing else: work is linear in sections and needs.
    """
    spark = conn.sparkSession
    rows, on, fed, levels = _sections(conn, feeding)
    late, deps, arrs = Tables(spark, "level"), Tables(spark), Tables(spark)
    kind = LATE.format(conn.schema["key"].dataType.simpleString())
    for k in range(levels):
        this = F.col("level") == k
        out, came = _level(rows.filter(this), late.read(kind, k), start, travel, fed.filter(this).drop("level"), measured)
        deps.add(out)
        arrs.add(came)
        if k + 1 < levels:
            late.add(on.join(came.withColumnRenamed("key", "on"), "on").select("key", "on", "minute", "p", F.lit(True).alias("moved"), "level"))
    plain = f"key {conn.schema['key'].dataType.simpleString()}, minute long, p double"
    return deps.read(plain), arrs.read(plain)


def update_distributions(conn: DataFrame, start: DataFrame, travel: DataFrame, feeding: DataFrame, deps: DataFrame, arrs: DataFrame, changed: DataFrame, measured: DataFrame | None = None, least: float = 0.001) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(departures, arrivals, (key, level, moved) of what was computed anew) once the inputs of the sections ``changed`` (key) are others.

    ``deps`` and ``arrs`` are results of before.  Level by level the changed sections and those that need an arrival
    which moved by more than ``least`` (``significant``) are computed anew; smaller moves are kept but wake nobody.
    With ``least`` 0 the result is that of ``timetable_distributions``; a level that nothing reaches costs no distribution.
    """
    spark = conn.sparkSession
    rows, on, fed, levels = _sections(conn, feeding)
    name = conn.schema["key"].dataType.simpleString()
    late, new_deps, new_arrs, log = Tables(spark, "level"), Tables(spark), Tables(spark), Tables(spark)
    changed = cut(rows.select("key", "level").join(changed.select("key").distinct(), "key", "left_semi"))
    for k in range(levels):
        this = F.col("level") == k
        come = late.read(LATE.format(name), k)
        keys = cut(changed.filter(this).select("key").unionByName(come.filter("moved").select("key")).distinct())
        if keys.isEmpty():
            continue
        now = cut(rows.filter(this).join(keys, "key", "left_semi"))
        need = on.filter(this).join(keys, "key", "left_semi").select("key", "on")
        fresh = come.join(keys, "key", "left_semi").select("key", "on", "minute", "p")
        stale = need.join(fresh.select("key", "on").distinct(), ["key", "on"], "left_anti").join(arrs.select(F.col("key").alias("on"), "minute", "p"), "on")
        out, came = _level(now, cut(fresh.unionByName(stale.select("key", "on", "minute", "p"))), start, travel, fed.filter(this).drop("level"), measured)
        new_deps.add(out)
        new_arrs.add(came)
        moved = cut(significant(arrs.join(keys, "key", "left_semi"), came, least).withColumn("moved", F.lit(True)))
        said = keys.join(moved, "key", "left").select("key", F.lit(k).alias("level"), F.coalesce("moved", F.lit(False)).alias("moved"))
        log.add(said)
        late.add(on.join(came.withColumnRenamed("key", "on"), "on").join(moved.withColumnRenamed("key", "on"), "on", "left").select("key", "on", "minute", "p", F.coalesce("moved", F.lit(False)).alias("moved"), "level"))
    plain = f"key {name}, minute long, p double"
    done = log.read(f"key {name}, level int, moved boolean")
    whole = lambda old, new: old.select("key", "minute", "p").join(done.select("key"), "key", "left_anti").unionByName(new.read(plain))
    return whole(deps, new_deps), whole(arrs, new_arrs), done


def affected(changed: DataFrame, needs: DataFrame) -> DataFrame:
    """(key): the changed sections and all that depend on them, directly or over others; what an update computes anew."""
    done = cut(changed.select("key").distinct())
    new = done
    while not new.isEmpty():
        new = cut(needs.join(new.withColumnRenamed("key", "on"), "on", "left_semi").select("key").distinct().join(done, "key", "left_anti"))
        done = cut(done.unionByName(new))
    return done


def significant(before_: DataFrame, after: DataFrame, least: float = 0.001) -> DataFrame:
    """Keys whose distribution changed by more than ``least``, its minutes' changes added up."""
    b, a = before_.withColumnRenamed("p", "_b"), after.withColumnRenamed("p", "_a")
    both = b.join(a, ["key", "minute"], "full").withColumn("_by", F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))))
    return both.groupBy("key").agg(F.sum("_by").alias("_by")).filter(F.col("_by") > least).select("key")


# --- ratings ------------------------------------------------------------------------------------


def interchange_rating(pairs: DataFrame, travel: DataFrame) -> DataFrame:
    """(..., rating): probability that a change is made: the feeder is at most ``slack`` minutes late.

    ``pairs`` has dist_id and slack (departure less transfer less scheduled arrival), ``travel``
    (dist_id, minute, p); without a distribution the feeder is on time.
    """
    t = as_array(travel, "dist_id", name="_t")
    rows = pairs.join(t, "dist_id", "left").withColumn("_t", F.coalesce("_t", one_point(F.lit(0), F.lit(1.0))))
    return rows.withColumn("rating", at_most(F.col("_t"), F.col("slack"))).drop("_t")


def simple_rating(rides: DataFrame, changes: DataFrame, by: list[str]) -> DataFrame:
    """(by, rating): that every train of a journey runs, times the ratings of its changes."""
    trains = rides.groupBy(*by).agg(F.pow(F.lit(TRAIN_RATING), F.count(F.lit(1))).alias("_trains"))
    made = changes.groupBy(*by).agg(F.product("rating").alias("_made"))
    return trains.join(made, by, "left").select(*by, (F.col("_trains") * F.coalesce("_made", F.lit(1.0))).alias("rating"))


def journey_rating(rides: DataFrame, start: DataFrame, travel: DataFrame, changes: DataFrame) -> DataFrame:
    """(journey, minute, p): delay of arrival of each journey, given that it is made as planned.

    ``rides`` has (journey, leg, dep, arr), ``start`` and ``travel`` are keyed by ``key`` = journey/leg,
    ``changes`` (journey, leg, transfer): minutes needed before leg.  Legs are chained one step each.
    """
    key = F.concat_ws("/", "journey", "leg")
    rows = cut(rides.withColumn("key", key).withColumn("_came", F.lag("arr").over(Window.partitionBy("journey").orderBy("leg"))).join(changes, ["journey", "leg"], "left"))
    last = rows.agg(F.max("leg")).first()[0]
    arrs = None
    for leg in range(1, (last or 0) + 1):
        now = rows.filter(F.col("leg") == leg)
        trains = now.join(as_array(start, "key", name="own"), "key").select("key", "journey", "dep", "_came", "transfer", "own")
        if arrs is not None and leg > 1:
            came = arrs.filter(F.col("leg") == leg - 1).select("journey", "minute", "p")
            change = trains.select("key", "journey", (F.col("_came") + F.col("transfer") - F.col("dep")).alias("_by")).join(came, "journey").withColumn("minute", F.col("minute") + F.col("_by"))
            trains = trains.join(as_array(change.select("key", "minute", "p"), "key", name="change"), "key").withColumn("change_latest", F.lit(0))
        out = departures(trains.select("key", "own", *(["change", "change_latest"] if leg > 1 else [])))
        came = arrival(out, travel).join(now.select("key", "journey", "leg"), "key").select("journey", "leg", "minute", "p")
        came = cut(came)
        arrs = came if arrs is None else arrs.unionByName(came)
    best = rides.groupBy("journey").agg(F.max("leg").alias("leg"))
    return arrs.join(best, ["journey", "leg"]).select("journey", "minute", "p")


def graph_arrival(parts: DataFrame, key: str = "graph") -> DataFrame:
    """(graph, minute, p): arrival of a connection graph: its journeys' arrivals (graph, at, weight, minute, p) laid
    onto clock minutes and summed, each weighted by the probability that it is taken."""
    return parts.groupBy(key, (F.col("at") + F.col("minute")).alias("minute")).agg(F.sum(F.col("weight") * F.col("p")).alias("p"))


def uncovered(arrivals: DataFrame, alternatives: DataFrame, key: str = "stop") -> DataFrame:
    """(stop, minute, p): minutes of an arrival distribution from which no alternative (stop, leaves) can be taken."""
    last = alternatives.groupBy(key).agg(F.max("leaves").alias("_last"))
    rows = arrivals.join(last, key, "left")
    return rows.filter(F.col("_last").isNull() | (F.col("minute") > F.col("_last"))).drop("_last")


def choose_alternatives(arrivals: DataFrame, alternatives: DataFrame, key: str = "stop") -> DataFrame:
    """(stop, leaves, weight): of the alternatives (stop, leaves, arrives) those a traveller takes, the earliest to
    arrive for each minute of coming, with the probability of coming then."""
    rows = arrivals.join(alternatives, key).filter(F.col("leaves") >= F.col("minute"))
    best = rows.groupBy(key, "minute", "p").agg(F.min_by("leaves", F.struct("arrives", "leaves")).alias("leaves"))
    return best.groupBy(key, "leaves").agg(F.sum("p").alias("weight"))
