"""Real-time operators: resolved times, propagation, repair, merges of cancels, reroutes and additions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trip_events(stops: DataFrame, day: int = 0) -> DataFrame:
    """(trip_id, place, seq, ev_type, sched): alternating arrivals and departures of each trip, in order."""
    dep = stops.select("trip_id", (F.col("seq") * 2 + 1).alias("place"), "seq", F.lit("DEP").alias("ev_type"), (F.col("dep_min") + day * 1440).alias("sched"))
    arr = stops.filter("seq > 0").select("trip_id", (F.col("seq") * 2).alias("place"), "seq", F.lit("ARR").alias("ev_type"), (F.col("arr_min") + day * 1440).alias("sched"))
    return arr.unionByName(dep)


def resolved_time(is_t, forecast, propagation, sched, repair=None):
    """The time that counts: repair, then a measured time, else the latest of forecast, propagation and schedule."""
    ranked = F.greatest(*[F.when(t.isNotNull(), F.struct(t.alias("time"), F.lit(r).alias("rank"))) for r, t in ((1, sched), (2, propagation), (3, forecast))])
    first = [F.struct(t.alias("time"), F.lit(r).alias("rank")) for t, r in ((repair, 5), (is_t, 4)) if t is not None]
    out = ranked
    for t, s in zip([x for x in (is_t, repair) if x is not None], reversed(first), strict=True):
        out = F.when(t.isNotNull(), s).otherwise(out)
    return out


def propagate(events: DataFrame) -> DataFrame:
    """Delay propagation along trips in one window pass.

    ``events`` has (trip_id, place, ev_type, sched, is_t, forecast_t).  A measured time stands; other
    events are at least their schedule, their forecast and the previous event plus a step: the
    scheduled run time before an arrival, at most 2 minutes of dwell before a departure.  With
    cumulative steps this is a running maximum that starts anew at each measured time.
    """
    w = Window.partitionBy("trip_id").orderBy("place")
    gap = F.coalesce(F.col("sched") - F.lag("sched").over(w), F.lit(0))
    rows = events.withColumn("step", F.when(F.col("ev_type") == "ARR", gap).otherwise(F.least(gap, F.lit(2))))
    rows = rows.withColumn("cum", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("cut", F.sum(F.when(F.col("is_t").isNotNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = F.coalesce("is_t", F.greatest("sched", "forecast_t"))
    upto = Window.partitionBy("trip_id", "cut").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("resolved", F.max(own - F.col("cum")).over(upto) + F.col("cum")).drop("step", "cum", "cut")


def repair(events: DataFrame) -> DataFrame:
    """Bring the times of a trip in line with its measured ones: ``low``, ``high`` and ``repaired``.

    An event is not after a later measured time (the least of them, its own included) and then not
    before an earlier one (the greatest), so the bound from before wins where they cross.
    """
    w = Window.partitionBy("trip_id").orderBy("place")
    low = F.max("is_t").over(w.rowsBetween(Window.unboundedPreceding, 0))
    high = F.min("is_t").over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = events.withColumn("low", low).withColumn("high", high)
    capped = F.least("resolved", "high")  # a null bound is none
    return rows.withColumn("repaired", F.greatest(capped, "low"))


def conflicts(events: DataFrame, route: str | None = None) -> DataFrame:
    """``events`` with ``fits_trip`` and ``fits_edge``.

    A time fits its trip if it is not before that of the event before nor after that of the next;
    it fits its edge if, among the trips of its ``route`` at the same place, the order of the schedule
    is kept strictly (no overtaking).
    """
    w = Window.partitionBy("trip_id").orderBy("place")
    ok = (F.coalesce(F.col("resolved") >= F.lag("resolved").over(w), F.lit(True))) & F.coalesce(F.col("resolved") <= F.lead("resolved").over(w), F.lit(True))
    rows = events.withColumn("fits_trip", ok)
    if route is None:
        return rows.withColumn("fits_edge", F.lit(True))
    e = Window.partitionBy(route, "place").orderBy("sched", "trip_id")
    kept = F.coalesce(F.col("resolved") > F.lag("resolved").over(e), F.lit(True)) & F.coalesce(F.col("resolved") < F.lead("resolved").over(e), F.lit(True))
    return rows.withColumn("fits_edge", kept)


UPDATE = ["trip_id", "station_id", "sched", "ev_type", "updated", "reason", "canceled"]


def flush(events: DataFrame, stations: DataFrame) -> DataFrame:
    """Rows of the update message: every event whose time differs from its schedule after propagation and, in trips
    with a conflict, repair.

    ``events`` has (trip_id, place, seq, ev_type, sched, is_t, forecast_t), ``stations`` (trip_id,
    seq, station_id).  The reason is that of the time that counts.
    """
    rows = conflicts(propagate(events))
    broken = rows.groupBy("trip_id").agg(F.min("fits_trip").alias("_whole"))
    rows = repair(rows).join(broken, "trip_id")
    updated = F.when(F.col("_whole"), F.col("resolved")).otherwise(F.col("repaired"))
    rows = rows.withColumn("updated", updated)
    reason = (
        F.when(~F.col("_whole") & (F.col("updated") != F.col("resolved")), "REPAIR")
        .when(F.col("is_t") == F.col("updated"), "IS")
        .when(F.col("forecast_t") == F.col("updated"), "FORECAST")
        .otherwise("PROPAGATION")
    )
    rows = rows.filter("updated <> sched").withColumn("reason", reason).withColumn("canceled", F.lit(False))
    return rows.join(stations, ["trip_id", "seq"]).select(*UPDATE)


def canceled_updates(segments: DataFrame) -> DataFrame:
    """Update rows of the two events of each cancelled segment (``cancel``)."""
    gone = segments.filter("canceled")
    row = lambda station, time, kind: gone.select("trip_id", F.col(station).alias("station_id"), F.col(time).alias("sched"), F.lit(kind).alias("ev_type"), F.col(time).alias("updated"), F.lit("CANCEL").alias("reason"), F.lit(True).alias("canceled"))
    return row("from_station", "dep_min", "DEP").unionByName(row("to_station", "arr_min", "ARR"))


def publish(updates: DataFrame, path: str, batch_id: int = 0) -> None:
    """Write a batch of update rows under its number; a repeated batch replaces itself."""
    updates.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").json(f"{path}/batch={batch_id}")


def cancel(segments: DataFrame, cancels: DataFrame) -> DataFrame:
    """Segments with ``canceled``: a cancelled stop removes the segments on both sides."""
    hit = cancels.select("trip_id", F.col("seq").alias("stop")).distinct()
    gone = hit.select("trip_id", F.col("stop").alias("seq")).unionByName(hit.select("trip_id", (F.col("stop") - 1).alias("seq"))).distinct().withColumn("canceled", F.lit(True))
    return segments.join(gone, ["trip_id", "seq"], "left").withColumn("canceled", F.coalesce("canceled", F.lit(False)))


#: A trip is cut into fewer pieces than this; the number of a running piece is trip_id * PIECES + piece.
PIECES = 1024


def running(conn: DataFrame, canceled: DataFrame, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(connections as they run, links between them): without cancelled sections, and nobody stays seated across one.

    ``canceled`` has (trip_id, seq[, day]) of sections; without a day, of all days.  What lies between two cancellations is
    a trip of its own, numbered ``trip_id * PIECES + piece`` (``trip_of`` gives the trip), so every search takes the
    result as it takes ``conn``.  ``links`` (trip_id, day, next_trip) lead from a trip's last piece to the next one's
    first, unless the sections that meet are cancelled.  A null in a key of ``canceled`` matches nothing.
    """
    key = [c for c in ("trip_id", "day", "seq") if c in canceled.columns]
    rows = conn.join(canceled.select(*key).distinct().withColumn("_gone", F.lit(True)), key, "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    w = Window.partitionBy("trip_id", "day").orderBy("seq")
    rows = rows.withColumn("_piece", F.sum(F.col("_gone").cast("long")).over(w))
    piece = lambda trip, n: F.col(trip) * PIECES + n
    out = rows.filter("NOT _gone").withColumn("trip_id", piece("trip_id", F.col("_piece"))).select(*conn.columns)
    if links is None:
        return out, None
    ends = rows.groupBy("trip_id", "day").agg(F.max("_piece").alias("_last"), F.max_by("_gone", "seq").alias("_ends"), F.min_by("_gone", "seq").alias("_begins"))
    joint = links.select("trip_id", "day", "next_trip").join(ends.filter("NOT _ends").select("trip_id", "day", "_last"), ["trip_id", "day"])
    joint = joint.join(ends.filter("NOT _begins").select(F.col("trip_id").alias("next_trip"), "day"), ["next_trip", "day"])
    return out, joint.select(piece("trip_id", F.col("_last")).alias("trip_id"), "day", piece("next_trip", F.lit(0)).alias("next_trip"))


def trip_of(trip_id: Column) -> Column:
    """The trip of a running piece."""
    return F.shiftright(trip_id, PIECES.bit_length() - 1)


def retimed(conn: DataFrame, updates: DataFrame) -> DataFrame:
    """Connections at their real times: ``updates`` has (trip_id, day, seq, ev_type, real) of a section's two events.

    Events without an update, or with a null time, stay as planned; no section arrives before it departs.
    """
    one = lambda kind, c: updates.filter(F.col("ev_type") == kind).groupBy("trip_id", "day", "seq").agg(F.max("real").alias(c))
    rows = conn.join(one("DEP", "_d"), ["trip_id", "day", "seq"], "left").join(one("ARR", "_a"), ["trip_id", "day", "seq"], "left")
    rows = rows.withColumn("dep", F.coalesce("_d", "dep")).withColumn("arr", F.greatest(F.coalesce("_a", "arr"), F.col("dep")))
    return rows.select(*conn.columns)


def reroute(stops: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """Re-threaded segments after stops were taken out (trip_id, seq) and put in (a stop row each)."""
    kept = stops.join(removed.select("trip_id", "seq").distinct(), ["trip_id", "seq"], "left_anti").unionByName(added)
    w = Window.partitionBy("trip_id").orderBy("dep_min", "seq", "station_id")
    rows = kept.withColumn("to_station", F.lead("station_id").over(w)).withColumn("to_arr", F.lead("arr_min").over(w)).withColumn("nth", F.row_number().over(w) - 1)
    return rows.filter("to_station IS NOT NULL").select("trip_id", F.col("nth").cast("long").alias("seq"), F.col("station_id").alias("from_station"), "to_station", "dep_min", F.col("to_arr").alias("arr_min"))


def validate_additions(events: DataFrame) -> DataFrame:
    """(trip_id, status) of added trips: events must alternate and times must not fall; with a ``station_id`` a
    departure must be where the trip arrived."""
    w = Window.partitionBy("trip_id").orderBy("place")
    rows = events.withColumn("falls", F.coalesce(F.col("time") < F.lag("time").over(w), F.lit(False))).withColumn("repeats", F.coalesce(F.col("ev_type") == F.lag("ev_type").over(w), F.lit(False)))
    moves = F.lit(False)
    if "station_id" in events.columns:
        moves = F.coalesce((F.col("ev_type") == "DEP") & (F.col("station_id") != F.lag("station_id").over(w)), F.lit(False))
    rows = rows.withColumn("moves", moves)
    out = rows.groupBy("trip_id").agg(F.max("falls").alias("falls"), F.max("repeats").alias("repeats"), F.max("moves").alias("moves"), F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("n") < 2, "EVENT_COUNT_MISMATCH").when(F.col("repeats"), "EVENT_ORDER_MISMATCH").when(F.col("moves"), "STATION_MISMATCH").when(F.col("falls"), "DECREASING_TIME").otherwise("OK")
    return out.select("trip_id", status.alias("status"))


def chain_status(events: DataFrame) -> DataFrame:
    """(trip_id, status) of re-threaded trips: an even number of events, departures and arrivals in turn from a
    departure on, each departure at the station of the arrival before."""
    w = Window.partitionBy("trip_id").orderBy("place")
    rows = events.withColumn("_n", F.row_number().over(w)).withColumn("_at", F.lag("station_id").over(w))
    wrong = F.col("ev_type") != F.when(F.col("_n") % 2 == 1, "DEP").otherwise("ARR")
    moved = (F.col("ev_type") == "DEP") & F.col("_at").isNotNull() & (F.col("_at") != F.col("station_id"))
    # the first event that breaks a rule decides
    rows = rows.withColumn("_bad", F.when(wrong, "EVENT_ORDER_MISMATCH").when(moved, "STATION_MISMATCH"))
    out = rows.groupBy("trip_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("_bad", F.when(F.col("_bad").isNotNull(), F.col("_n"))).alias("bad"))
    return out.select("trip_id", F.when(F.col("n") % 2 != 0, "EVENT_COUNT_MISMATCH").otherwise(F.coalesce("bad", F.lit("OK"))).alias("status"))


def insert_trips(stops: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stops with the valid added trips, (trip_id, status)): ``added`` events (trip_id, place, ev_type, station_id, time).

    A trip that exists already is rejected.
    """
    status = validate_additions(added)
    known = stops.select("trip_id").distinct().withColumn("_known", F.lit(True))
    status = status.join(known, "trip_id", "left").select("trip_id", F.when(F.col("_known"), "DUPLICATE").otherwise(F.col("status")).alias("status"))
    good = added.join(status.filter("status = 'OK'").select("trip_id"), "trip_id", "left_semi")
    w = Window.partitionBy("trip_id").orderBy("place")
    # an arrival begins a stop, and so does the first departure
    rows = good.withColumn("seq", F.sum(F.when((F.col("ev_type") == "ARR"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    new = rows.groupBy("trip_id", F.col("seq").cast("long").alias("seq")).agg(F.first("station_id").alias("station_id"), F.max(F.when(F.col("ev_type") == "ARR", F.col("time"))).alias("arr_min"), F.max(F.when(F.col("ev_type") == "DEP", F.col("time"))).alias("dep_min"))
    new = new.withColumn("arr_min", F.coalesce("arr_min", "dep_min")).withColumn("dep_min", F.coalesce("dep_min", "arr_min")).withColumn("in_allowed", F.lit(True)).withColumn("out_allowed", F.lit(True))
    return stops.unionByName(new, allowMissingColumns=True), status


def reroute_events(events: DataFrame, deleted: DataFrame, added: DataFrame, stored: DataFrame, ruled: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events after the reroutes, (trip_id, status), stored delays).

    ``events`` and ``added`` have (trip_id, station_id, ev_type, sched, delay); ``deleted`` (trip_id,
    station_id, ev_type, sched).  Delays of deleted events are stored and come back when an event
    returns.  A trip whose events don't chain, or that is in ``ruled`` (through and merged
    services), keeps its events.

    Events at the same minute are put as a trip can have them: a departure whose stop began earlier,
    stops that begin and end then, an arrival whose stop ends later; several such stops by ``place``
    where events and added ones have one.
    """
    key = ["trip_id", "station_id", "ev_type", "sched"]
    asked = deleted.select("trip_id").unionByName(added.select("trip_id")).distinct()
    placed = lambda df: df.withColumn("_place", F.col("place").cast("double") if "place" in df.columns else F.lit(None).cast("double"))
    kept = placed(events).join(asked, "trip_id", "left_semi").join(deleted.select(*key).distinct(), key, "left_anti")
    memory = stored.select(*key, F.col("delay").alias("_stored"))
    new = placed(added).join(memory, key, "left").withColumn("delay", F.coalesce("delay", "_stored")).drop("_stored")
    rows = kept.select(*key, "delay", "_place").unionByName(new.select(*key, "delay", "_place"))
    here = Window.partitionBy("trip_id", "sched", "station_id")
    both = F.min("ev_type").over(here) != F.max("ev_type").over(here)
    rows = rows.withColumn("_phase", F.when(both, 1).when(F.col("ev_type") == "DEP", 0).otherwise(2))
    order = Window.partitionBy("trip_id").orderBy("sched", "_phase", F.floor("_place"), "station_id", "ev_type")
    rows = rows.withColumn("place", F.row_number().over(order)).drop("_phase", "_place")
    status = asked.join(chain_status(rows), "trip_id", "left").select("trip_id", F.coalesce("status", F.lit("EVENT_COUNT_MISMATCH")).alias("status"))
    if ruled is not None:
        status = status.join(ruled.select("trip_id").distinct().withColumn("_r", F.lit(True)), "trip_id", "left").select("trip_id", F.when(F.col("_r"), "RULE_SERVICE_REROUTE_NOT_SUPPORTED").otherwise(F.col("status")).alias("status"))
    good = status.filter("status = 'OK'").select("trip_id")
    after = events.join(good, "trip_id", "left_anti").select(*key, "delay").unionByName(rows.join(good, "trip_id", "left_semi").select(*key, "delay"))
    put_by = events.join(deleted.select(*key).distinct(), key, "left_semi").join(good, "trip_id", "left_semi").filter("delay IS NOT NULL").select(*key, "delay")
    return after, status, stored.select(*key, "delay").unionByName(put_by).dropDuplicates(key)


def resolve(asked: DataFrame, events: DataFrame) -> DataFrame:
    """(msg_id, trip_id, seq): the events of a trip that messages, or a journey's stops, name by station, kind and schedule time.

    ``asked`` (msg_id, trip_id, station_id, ev_type, sched), ``events`` (trip_id, seq, station_id, ev_type, sched).  Where
    the trip has one such event at the station, its time is not asked for; what is not found has no row.
    """
    key = ["trip_id", "station_id", "ev_type"]
    known = events.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key))).withColumnRenamed("sched", "_sched")
    rows = asked.select("msg_id", *key, "sched").join(known, key)
    return rows.filter((F.col("_n") == 1) | (F.col("_sched") == F.col("sched"))).select("msg_id", "trip_id", "seq")


def outcomes(messages: DataFrame, stops: DataFrame, late: int = 15) -> DataFrame:
    """(kind, outcome, n): messages that name no stop of a trip, those of more than ``late`` minutes, and the others."""
    known = stops.select("trip_id", "seq").distinct().withColumn("_known", F.lit(True))
    outcome = F.when(F.col("_known").isNull(), "unresolved").when(F.col("delay") > late, "late").otherwise("small")
    return messages.join(known, ["trip_id", "seq"], "left").groupBy("kind", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def day_spans(messages: DataFrame) -> DataFrame:
    """(day, first_ts, last_ts): the earliest and latest message of each day that a message's events touch.

    ``messages`` (ts, first_day, last_day); days between are touched too.
    """
    days = messages.select("ts", F.explode(F.sequence("first_day", "last_day")).alias("day"))
    return days.groupBy("day").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def counters(messages: DataFrame, resolved: DataFrame, updates: DataFrame) -> DataFrame:
    """(counter, n): messages by kind, unresolved events, events beyond 24 hours, updates by reason."""
    kinds = messages.groupBy(F.concat(F.lit("messages_"), "kind").alias("counter")).agg(F.count(F.lit(1)).alias("n"))
    lost = messages.join(resolved.select("msg_id").distinct(), "msg_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unresolved").alias("counter"), "n")
    why = updates.groupBy(F.concat(F.lit("updates_"), F.lower("reason")).alias("counter")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.unionByName(lost).unionByName(why)


#: Schemas of messages that are read but change nothing: whether a train waits, and how a connection is assessed.
CONNECTION_DECISION = "base struct<trip_id:string,station_id:string,time:timestamp>, decisions array<struct<trip_id:string,station_id:string,time:timestamp,hold:boolean>>"
CONNECTION_ASSESSMENT = "base struct<trip_id:string,station_id:string,time:timestamp>, assessments array<struct<trip_id:string,station_id:string,time:timestamp,rating:int>>"
