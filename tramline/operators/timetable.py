"""Timetable views and lookups: segments, graphs, counts, calendars, ids, dimension joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: weight of a departure of class c is ten to the power (9 - c) / 3, rounded down.
def class_weight(clasz: Column) -> Column:
    return F.pow(F.lit(10), F.floor((F.lit(9) - clasz) / 3)).cast("long")


def in_trip(*order: str):
    return Window.partitionBy("trip_id").orderBy(*(order or ("seq",)))


def segments(stops: DataFrame) -> DataFrame:
    """Consecutive stops of each trip as segments; stays at one station are none."""
    w = in_trip()
    rows = stops.withColumn("to_station", F.lead("station_id").over(w)).withColumn("to_arr", F.lead("arr_min").over(w)).withColumn("to_out", F.lead("out_allowed").over(w))
    rows = rows.filter("to_station IS NOT NULL AND to_station <> station_id")
    return rows.select("trip_id", "seq", F.col("station_id").alias("from_station"), "to_station", "dep_min", F.col("to_arr").alias("arr_min"), "in_allowed", F.col("to_out").alias("out_allowed"), "clasz")


def schedule_info(conn: DataFrame) -> DataFrame:
    """First departure, last arrival, and numbers of connections and trips."""
    return conn.agg(F.min("dep").alias("first_dep"), F.max("arr").alias("last_arr"), F.count(F.lit(1)).alias("n_conn"), F.countDistinct("trip_id").alias("n_trips"))


def check_times(info: DataFrame, begin: Column, end: Column, strict: bool = True) -> DataFrame:
    """``info`` if [begin, end] lies in the schedule (or, not strict, meets it); an error says which bound does not."""
    inside = (begin >= F.col("first_dep")) & (end <= F.col("last_arr")) if strict else (end >= F.col("first_dep")) & (begin <= F.col("last_arr"))
    text = F.concat(F.lit("interval not in schedule: "), begin.cast("string"), F.lit(" to "), end.cast("string"))
    return info.withColumn("in_schedule", F.when(inside, F.lit(True)).otherwise(F.raise_error(text).cast("boolean")))


def loaded_between(conn: DataFrame, first_day: int, last_day: int) -> DataFrame:
    """Connections of trips that run on a day in [first_day, last_day)."""
    return conn.filter((F.col("day") >= first_day) & (F.col("day") < last_day))


def on_days(segments: DataFrame, service_days: DataFrame) -> DataFrame:
    """Connections: segments joined with (trip_id, day), times from day 0."""
    rows = segments.join(service_days.select("trip_id", "day"), "trip_id")
    at = lambda c: F.col("day") * 1440 + F.col(c)
    return rows.select("day", "trip_id", "seq", "from_station", "to_station", at("dep_min").alias("dep"), at("arr_min").alias("arr"), "in_allowed", "out_allowed", "clasz")


def fastest(edges: DataFrame, extra: Column | int = 0) -> DataFrame:
    """Least minutes per directed station pair (plus ``extra``)."""
    extra = extra if isinstance(extra, Column) else F.lit(extra)
    return edges.groupBy("from_station", "to_station").agg(F.min(F.col("arr_min") - F.col("dep_min") + extra).alias("minutes"))


def interchange_graph(stops: DataFrame) -> DataFrame:
    """Distinct (station, class, whether a change of trains is possible)."""
    return stops.select("station_id", "clasz", (F.col("in_allowed") & F.col("out_allowed")).alias("is_transfer")).distinct()


def event_counts(segments: DataFrame, arrivals: bool = False) -> DataFrame:
    """(station_id, clasz, n, n_usable): departures (or arrivals) per station and class, and those that may be used."""
    station, allowed = ("to_station", "out_allowed") if arrivals else ("from_station", "in_allowed")
    return segments.groupBy(F.col(station).alias("station_id"), "clasz").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(allowed), 1).otherwise(0)).alias("n_usable"))


def importance(counts: DataFrame) -> DataFrame:
    """(station_id, weight, importance): departures weighted by class, scaled to 1 .. 1.5 by the greatest.

    The greatest weight is one aggregated row.
    """
    rows = counts.groupBy("station_id").agg(F.sum(class_weight(F.col("clasz")) * F.col("n")).alias("weight"))
    top = rows.agg(F.max("weight").alias("top"))
    return rows.crossJoin(F.broadcast(top)).select("station_id", "weight", (F.lit(1) + F.lit(0.5) * F.col("weight") / F.col("top")).alias("importance"))


def active(stations: DataFrame, counts: DataFrame, names: str = "name") -> DataFrame:
    """Stations with an event, one per name (the smallest id)."""
    used = stations.join(counts.groupBy("station_id").agg(F.sum("n").alias("n")).filter("n > 0").select("station_id"), "station_id", "left_semi")
    return used.groupBy(names).agg(F.min("station_id").alias("station_id"))


def largest(segments: DataFrame, k: int = 1000) -> DataFrame:
    """The ``k`` stations with the most departures, ties by id."""
    return segments.groupBy(F.col("from_station").alias("station_id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "station_id").limit(k)


def trip_ends(stops: DataFrame) -> DataFrame:
    """(trip_id, first_station, last_station, n_stops, dep_min, arr_min)."""
    return stops.groupBy("trip_id").agg(F.min_by("station_id", "seq").alias("first_station"), F.max_by("station_id", "seq").alias("last_station"), F.count(F.lit(1)).alias("n_stops"), F.min("dep_min").alias("dep_min"), F.max("arr_min").alias("arr_min"))


def station_pair_boxes(segments: DataFrame, stations: DataFrame) -> DataFrame:
    """Bounding box of the two ends of each unordered station pair."""
    at = lambda x: stations.select(F.col("station_id").alias(x), F.col("lat").alias(f"{x}_lat"), F.col("lng").alias(f"{x}_lng"))
    pairs = segments.select(F.least("from_station", "to_station").alias("a"), F.greatest("from_station", "to_station").alias("b")).distinct()
    rows = pairs.join(at("a"), "a").join(at("b"), "b")
    return rows.select("a", "b", F.least("a_lat", "b_lat").alias("min_lat"), F.greatest("a_lat", "b_lat").alias("max_lat"), F.least("a_lng", "b_lng").alias("min_lng"), F.greatest("a_lng", "b_lng").alias("max_lng"))


#: Blocks that a meta station's members are dealt into, so that a large one is many tasks' work.
BLOCKS = 64


def equivalents(stations: DataFrame, *keep: str) -> DataFrame:
    """(station_id, equivalent) of stations with one meta id, itself included; and the station's columns ``keep``."""
    n = int(stations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mine = stations.select("station_id", "meta_id", *keep).withColumn("_block", F.pmod(F.xxhash64("station_id"), F.lit(BLOCKS)))
    others = stations.select(F.col("station_id").alias("equivalent"), "meta_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long"))).alias("_block"))
    key = ["meta_id", "_block"]
    rows = mine.repartition(n, *key).hint("merge").join(others.repartition(n, *key), key)
    return rows.select("station_id", "equivalent", *keep)


def get(rows: DataFrame, key: str, dim: DataFrame, what: str = "row") -> DataFrame:
    """Inner lookup that fails on a key that ``dim`` lacks; ``key`` is unique in ``dim``."""
    found = rows.join(dim.withColumn("_found", F.lit(True)), key, "left")
    ok = F.when(F.col("_found"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{what} not found: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean"))
    return found.filter(ok).drop("_found")


def used_stations(stations: DataFrame, conn: DataFrame, begin: int, end: int) -> DataFrame:
    """Stations with a departure in [begin, end]."""
    return stations.join(conn.filter(F.col("dep").between(begin, end)).select(F.col("from_station").alias("station_id")), "station_id", "left_semi")


def trip_ids(stops: DataFrame, number: Column, line: Column) -> DataFrame:
    """(trip_id, station_id, train_nr, time, target_id, target_time, line, alias): a trip's primary id and, where its
    train number changes on the way, one alias per further number, from the stop where it begins."""
    rows = stops.withColumn("train_nr", number).withColumn("line", line)
    ends = rows.groupBy("trip_id").agg(F.max_by("station_id", "seq").alias("target_id"), F.max("arr_min").alias("target_time"))
    w = in_trip()
    new = rows.withColumn("_before", F.lag("train_nr").over(w)).withColumn("_last", F.lead("seq").over(w).isNull())
    new = new.filter((F.col("_before").isNull() | (F.col("_before") != F.col("train_nr"))) & ((F.col("seq") == 0) | ~F.col("_last")))
    return new.join(ends, "trip_id").select("trip_id", "station_id", "train_nr", F.col("dep_min").alias("time"), "target_id", "target_time", "line", (F.col("seq") > 0).alias("alias"))


def find_trips(asked: DataFrame, ids: DataFrame) -> DataFrame:
    """Trips by full id: station, number, time, target, target time and line all equal; null line of a question: any."""
    key = ["station_id", "train_nr", "time", "target_id", "target_time"]
    rows = asked.withColumnRenamed("line", "_line").join(ids, key)
    return rows.filter(F.col("_line").isNull() | (F.col("_line") == F.col("line"))).drop("_line")


def find_trips_fuzzy(asked: DataFrame, ids: DataFrame) -> DataFrame:
    """(..., trip_id, exact): by (station, number, time), else by station and time under train number 0."""
    key = ["station_id", "train_nr", "time"]
    by = lambda rows, cols, name: rows.groupBy(*cols).agg(F.min("trip_id").alias(name))
    rows = asked.join(by(ids, key, "_exact"), key, "left").join(by(ids.filter("train_nr = 0"), ["station_id", "time"], "_any"), ["station_id", "time"], "left")
    return rows.withColumn("trip_id", F.coalesce("_exact", "_any")).withColumn("exact", F.col("_exact").isNotNull()).drop("_exact", "_any")


def shape(segments: DataFrame) -> DataFrame:
    """(trip_id, duration, n_segments, n_exits)."""
    return segments.groupBy("trip_id").agg((F.max("arr_min") - F.min("dep_min")).alias("duration"), F.count(F.lit(1)).alias("n_segments"), F.sum(F.when(F.col("out_allowed"), 1).otherwise(0)).alias("n_exits"))


def nth_stop(stops: DataFrame, n: int) -> DataFrame:
    """The ``n``-th stop of each trip at a station it calls at so often."""
    w = Window.partitionBy("trip_id", "station_id").orderBy("seq")
    return stops.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == n).drop("_n")


def carried(stops: DataFrame, value: Column) -> Column:
    """A value named at some stops, held until another is named."""
    return F.last(value, ignorenulls=True).over(in_trip().rowsBetween(Window.unboundedPreceding, 0))


def records(lines: DataFrame, by: str, order: str, begins: Column) -> DataFrame:
    """``lines`` with ``record``: how many lines that begin a record stand up to each."""
    return lines.withColumn("record", F.sum(F.when(begins, 1).otherwise(0)).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def days_later(segments: DataFrame) -> DataFrame:
    """Days between a trip's first departure and each arrival."""
    first = F.min("dep_min").over(Window.partitionBy("trip_id"))
    return segments.select("trip_id", "seq", (F.floor(F.col("arr_min") / 1440) - F.floor(first / 1440)).alias("days_later"))


def station_path(sep: str = "-") -> Column:
    """A trip's stations in order, for ``groupBy("trip_id").agg``."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "station_id"))), lambda x: x["station_id"].cast("string")), sep)


def sequences(stops: DataFrame) -> DataFrame:
    """Distinct station sequences: their trips, classes and first trip."""
    trips = stops.groupBy("trip_id").agg(F.min("clasz").alias("clasz"), station_path().alias("path"))
    return trips.groupBy("path").agg(F.count(F.lit(1)).alias("n_trips"), F.countDistinct("clasz").alias("n_classes"), F.min("trip_id").alias("first_trip"))


def representatives(segments: DataFrame, same: list[Column]) -> DataFrame:
    """(trip_id, seq, representative): the smallest trip and stop of the segments alike in ``same``."""
    names = [f"_k{i}" for i in range(len(same))]
    rows = segments.select("trip_id", "seq", *[c.alias(n) for c, n in zip(same, names, strict=True)])
    first = rows.groupBy(*names).agg(F.min(F.col("trip_id") * 100 + F.col("seq")).alias("representative"))
    return rows.join(first, names).select("trip_id", "seq", "representative")


def attribute_ranges(sections: DataFrame, key: str) -> DataFrame:
    """(trip_id, key, first, last): runs of consecutive sections that have an attribute, category or provider."""
    w = Window.partitionBy("trip_id", key).orderBy("seq")
    # a run's first and last rows, next to each other once those between are gone: one sort, no groups held in memory
    before, after = F.lag("seq").over(w), F.lead("seq").over(w)
    rows = sections.select("trip_id", key, "seq", (before.isNull() | (before < F.col("seq") - 1)).alias("_first"), (after.isNull() | (after > F.col("seq") + 1)).alias("_last"))
    ends = rows.filter("_first OR _last").withColumn("_next", F.lead("seq").over(w)).filter("_first")
    return ends.select("trip_id", key, F.col("seq").alias("first"), F.when(F.col("_last"), F.col("seq")).otherwise(F.col("_next")).alias("last"))


def with_dimensions(segments: DataFrame, info: DataFrame, category: DataFrame, provider: DataFrame) -> DataFrame:
    """Segments with line, train number, category name and provider: ``info`` is keyed by (trip_id, seq)."""
    rows = segments.join(info, ["trip_id", "seq"], "left").join(category, "category_id", "left")
    return rows.join(provider, "provider_id", "left")


def reached_trips(links: DataFrame, trips: DataFrame, direction: str = "both") -> DataFrame:
    """(trip_id, reached): trips connected over through links, forward, backward or both ways, each itself included."""
    from .relational import closure

    edges = links.select(F.col("trip_id").alias("a"), F.col("next_trip").alias("b"))
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    edges = {"forward": edges, "backward": back}.get(direction, edges.unionByName(back)).withColumn("dur", F.lit(0).cast("long"))
    far = closure(edges).select(F.col("a").alias("trip_id"), F.col("b").alias("reached"))
    own = trips.select("trip_id", F.col("trip_id").alias("reached"))
    return own.unionByName(far.join(trips.select("trip_id"), "trip_id", "left_semi")).distinct()


def violations(conn: DataFrame) -> DataFrame:
    """(trip_id, day, seq, problem) of connections that break a timetable rule: arrival before departure, or
    departure before the arrival of the section before."""
    w = Window.partitionBy("trip_id", "day").orderBy("seq")
    rows = conn.withColumn("_before", F.lag("arr").over(w))
    problem = F.when(F.col("arr") < F.col("dep"), "arrives before it departs").when(F.col("dep") < F.col("_before"), "departs before it arrives")
    return rows.withColumn("problem", problem).filter("problem IS NOT NULL").select("trip_id", "day", "seq", "problem")


def changes(stops: DataFrame, stations: DataFrame, waits: list[int]) -> DataFrame:
    """(trip_id, seq, next_trip, next_seq, valid): changes that wait exactly as many minutes as one of ``waits``, and
    whether the station's change time allows them."""
    left = stops.filter("out_allowed").select("trip_id", "seq", "station_id", "arr_min", F.explode(F.array(*map(F.lit, waits))).alias("wait"))
    left = left.join(stations.select("station_id", "transfer_min"), "station_id").withColumn("dep_min", F.col("arr_min") + F.col("wait"))
    taken = stops.filter("in_allowed").select("station_id", "dep_min", F.col("trip_id").alias("next_trip"), F.col("seq").alias("next_seq"))
    rows = left.join(taken, ["station_id", "dep_min"]).filter("trip_id <> next_trip")
    return rows.select("trip_id", "seq", "next_trip", "next_seq", (F.col("wait") >= F.col("transfer_min")).alias("valid"))
