"""GTFS feeds: explicit schemas, calendars with exceptions, timetable assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import hms_to_minutes
from ..operators.timetable import on_days, segments
from .files import exists

REQUIRED = ("agency", "stops", "routes", "trips", "stop_times", "transfers")
#: One of these is enough.
CALENDARS = ("calendar", "calendar_dates")
#: Fixed value: days of a timetable, counted from its first.
MOST_DAYS = 512
#: Category and class (0 best) by hundreds of the extended route types, and of the basic types.
ROUTE_KINDS = {
    1: ("Rail", 4), 2: ("Coach", 8), 3: ("Suburban", 5), 4: ("Urban", 6), 5: ("Metro", 6), 6: ("Underground", 6), 7: ("Bus", 8), 8: ("Trolleybus", 8),
    9: ("Tram", 7), 10: ("Water", 9), 11: ("Air", 9), 12: ("Ferry", 9), 13: ("Aerial", 9), 14: ("Funicular", 9), 15: ("Taxi", 9), 17: ("Other", 9),
}
#: Names of single route types that differ from their hundred's.
ROUTE_NAMES = {
    0: "Tram", 1: "Subway", 2: "Rail", 3: "Bus", 4: "Ferry", 5: "Cable Car", 6: "Gondola", 7: "Funicular", 11: "Trolleybus", 12: "Monorail",
    101: "High Speed Rail", 102: "Long Distance", 103: "Inter Regional", 105: "Sleeper", 106: "Regional", 109: "Suburban", 116: "Rack Railway", 200: "Coach", 204: "Regional Coach",
    401: "Metro", 402: "Underground", 405: "Monorail", 700: "Bus", 701: "Regional Bus", 702: "Express Bus", 704: "Local Bus", 705: "Night Bus", 714: "Rail Replacement", 715: "Demand Bus",
    900: "Tram", 1000: "Water", 1100: "Air", 1200: "Ferry", 1300: "Aerial", 1400: "Funicular", 1500: "Taxi", 1501: "Shared Taxi",
}
BASIC_CLASS = {0: 7, 1: 6, 2: 4, 3: 8, 4: 9, 5: 7, 6: 9, 7: 9, 11: 8, 12: 6}
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
COLUMNS = {
    "agency": "agency_id string, agency_name string, agency_timezone string",
    "stops": "stop_id string, stop_name string, stop_lat double, stop_lon double",
    "routes": "route_id string, agency_id string, route_short_name string, route_long_name string, route_type int",
    "trips": "route_id string, service_id string, trip_id string, trip_headsign string",
    "stop_times": "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence int, pickup_type int, drop_off_type int",
    "calendar": "service_id string, " + ", ".join(f"{d} int" for d in WEEKDAYS) + ", start_date string, end_date string",
    "calendar_dates": "service_id string, date string, exception_type int",
    "transfers": "from_stop_id string, to_stop_id string, transfer_type int, min_transfer_time int",
}


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One feed file: columns by header name, in any order; absent ones are null, others are ignored."""
    raw = spark.read.option("header", True).csv(f"{path}/{name}.txt")
    have = {c.strip().lstrip("﻿").strip('"'): c for c in raw.columns}
    fields = [f.strip().split(" ") for f in COLUMNS[name].split(",")]
    return raw.select(*[(F.trim(F.col(f"`{have[c]}`")) if c in have else F.lit(None)).cast(t).alias(c) for c, t in fields])


def missing_files(spark: SparkSession, path: str) -> list[str]:
    """Files that a feed lacks: required ones, and both calendars where neither is there."""
    there = {n: exists(spark, f"{path}/{n}.txt") for n in (*REQUIRED, *CALENDARS)}
    out = [f"{n}.txt" for n in REQUIRED if not there[n]]
    return out if any(there[n] for n in CALENDARS) else out + [f"{n}.txt" for n in CALENDARS]


def applicable(spark: SparkSession, path: str) -> bool:
    return not missing_files(spark, path)


def service_days(calendar: DataFrame, exceptions: DataFrame, first_day=None) -> DataFrame:
    """(service_id, day): weekday patterns inside their own dates, plus added and minus removed days.

    With ``first_day`` (a date) days outside the ``MOST_DAYS`` that begin there are dropped.
    """
    flags = F.array(*[F.col(d) for d in WEEKDAYS])
    day = lambda c: F.to_date(F.col(c), "yyyyMMdd")
    none = F.array().cast("array<date>")
    # a service's days travel as one array
    runs = F.filter(F.sequence(day("start_date"), day("end_date")), lambda d: F.element_at(flags, F.weekday(d) + 1) == 1)
    base = calendar.select("service_id", runs.alias("on"), none.alias("off"))
    change = exceptions.select("service_id", day("date").alias("day"), "exception_type").distinct()
    gone = (F.col("exception_type") != 1) & F.col("day").isNotNull() & F.col("service_id").isNotNull()
    change = change.select("service_id", F.when(F.col("exception_type") == 1, F.array("day")).otherwise(none).alias("on"), F.when(gone, F.array("day")).otherwise(none).alias("off"))
    days = base.union(change).groupBy("service_id").agg(F.flatten(F.collect_list("on")).alias("on"), F.flatten(F.collect_list("off")).alias("off"))
    out = days.select("service_id", F.explode(F.array_except("on", "off")).alias("day"))
    if first_day is None:
        return out
    return out.filter(F.datediff("day", F.lit(first_day).cast("date")).between(0, MOST_DAYS - 1))


def route_category(route_type) -> F.Column:
    """Category name of a basic or extended route type."""
    named = F.create_map(*[x for k, v in ROUTE_NAMES.items() for x in (F.lit(k), F.lit(v))])
    kinds = F.create_map(*[x for k, v in ROUTE_KINDS.items() for x in (F.lit(k), F.lit(v[0]))])
    return F.coalesce(F.try_element_at(named, route_type), F.try_element_at(kinds, F.floor(route_type / 100).cast("int")), F.lit("Other"))


def route_class(route_type) -> F.Column:
    """Class of a route type: 0 for high-speed rail to 9 for other means."""
    basic = F.create_map(*[x for k, v in BASIC_CLASS.items() for x in (F.lit(k), F.lit(v))])
    kinds = F.create_map(*[x for k, v in ROUTE_KINDS.items() for x in (F.lit(k), F.lit(v[1]))])
    rail = F.when(route_type == 101, 0).when(route_type.isin(102, 105), 1).when(route_type == 103, 3).when(route_type == 109, 5)
    return F.coalesce(rail, F.try_element_at(basic, route_type), F.try_element_at(kinds, F.floor(route_type / 100).cast("int")), F.lit(9)).cast("int")


def missing_keys(rows: DataFrame, key: str, of: DataFrame) -> DataFrame:
    """Keys of ``rows`` that ``of`` lacks; a loader rejects a feed with any."""
    return rows.select(key).distinct().join(of.select(key).distinct(), key, "left_anti")


def check_keys(t: dict[str, DataFrame], days: DataFrame) -> None:
    """Fail on trips of unknown routes or services and on stop times of unknown trips or stops; an example is named."""
    for rows, key, of in (("trips", "route_id", t["routes"]), ("trips", "service_id", days), ("stop_times", "trip_id", t["trips"]), ("stop_times", "stop_id", t["stops"])):
        bad = missing_keys(t[rows].filter(F.col(key).isNotNull()), key, of).limit(1).collect()
        if bad:
            raise ValueError(f"{rows}.txt: no such {key}: {bad[0][0]}")


def stop_rows(stop_times: DataFrame) -> DataFrame:
    """Stops of trips in order, numbered from 0; pickup and drop-off type 0 (or none) allow boarding and alighting."""
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    once = stop_times.dropDuplicates(["trip_id", "stop_sequence"])
    return once.select(
        "trip_id",
        (F.row_number().over(w) - 1).cast("long").alias("seq"),
        F.col("stop_id").alias("station_id"),
        hms_to_minutes(F.col("arrival_time")).alias("arr_min"),
        hms_to_minutes(F.col("departure_time")).alias("dep_min"),
        (F.coalesce("pickup_type", F.lit(0)) == 0).alias("in_allowed"),
        (F.coalesce("drop_off_type", F.lit(0)) == 0).alias("out_allowed"),
    )


def transfers(rows: DataFrame) -> DataFrame:
    """(from_stop_id, to_stop_id, minutes, transfer_type), one per pair: the first by its line in the file.

    Lines are numbered by their position in the scan of the file, which Spark reads in order.
    """
    numbered = rows.withColumn("_line", F.monotonically_increasing_id())
    best = numbered.groupBy("from_stop_id", "to_stop_id").agg(F.min_by(F.struct(F.floor(F.coalesce("min_transfer_time", F.lit(0)) / 60).cast("long").alias("minutes"), "transfer_type"), "_line").alias("x"))
    return best.select("from_stop_id", "to_stop_id", "x.*")


def footpaths(rows: DataFrame, kinds: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(a, b, dur minutes) of the accepted transfer types; the first of repeated rows counts."""
    kept = transfers(rows).filter(F.col("transfer_type").isin(*kinds))
    return kept.select(F.col("from_stop_id").alias("a"), F.col("to_stop_id").alias("b"), F.col("minutes").alias("dur"))


def load(spark: SparkSession, path: str, strict: bool = False) -> dict[str, DataFrame]:
    """All staging tables of a feed: station, trip, trip_stop, service_day, footpath.

    Files that are not there are empty tables; ``strict`` refuses an incomplete feed and unknown keys.
    """
    if strict and (gone := missing_files(spark, path)):
        raise FileNotFoundError(f"{path}: missing {', '.join(gone)}")
    t = {n: read(spark, path, n) if exists(spark, f"{path}/{n}.txt") else spark.createDataFrame([], COLUMNS[n]) for n in COLUMNS}
    days = service_days(t["calendar"], t["calendar_dates"])
    if strict:
        check_keys(t, days)
    agency = t["agency"].select("agency_id", "agency_name", "agency_timezone")
    trip = t["trips"].join(t["routes"], "route_id").join(agency, "agency_id", "left")
    trip = trip.withColumn("category", route_category(F.col("route_type"))).withColumn("clasz", route_class(F.col("route_type")))
    return {
        "station": t["stops"].select(F.col("stop_id").alias("station_id"), F.col("stop_name").alias("name"), F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lng"), F.lit(5).alias("transfer_min")),
        "trip": trip,
        "trip_stop": stop_rows(t["stop_times"]),
        "service_day": days,
        "footpath": footpaths(t["transfers"]),
    }


def timetable(feed: dict[str, DataFrame], first_day: str, last_day: str) -> dict[str, DataFrame]:
    """station (numbered), conn and footpath of a feed for the dates first_day .. last_day: what journey search takes.

    Stations and trips get numbers by their ids in code-point order; footpaths get the stations'
    transfer times as self loops.  Untimed stops take no part.
    """
    def numbered(rows: DataFrame, key: str, out: str) -> DataFrame:
        # a range sort numbers whole partitions at once: no window over all rows in one task
        ids = rows.select(F.col(key).cast("string").alias(key)).distinct().orderBy(key)
        pairs = ids.rdd.map(lambda r: r[0]).zipWithIndex()
        return rows.sparkSession.createDataFrame(pairs, f"{key} string, {out} long")

    station = feed["station"].join(numbered(feed["station"], "station_id", "number"), "station_id")
    trips = feed["trip"].join(numbered(feed["trip"], "trip_id", "trip_number"), "trip_id")
    stops = feed["trip_stop"].filter("arr_min IS NOT NULL AND dep_min IS NOT NULL").join(trips.select("trip_id", "trip_number", "clasz"), "trip_id")
    stops = stops.withColumnRenamed("station_id", "_s").join(station.select(F.col("station_id").alias("_s"), F.col("number").alias("station_id")), "_s")
    legs = segments(stops.select(F.col("trip_number").alias("trip_id"), "seq", "station_id", "arr_min", "dep_min", "in_allowed", "out_allowed", "clasz"))
    days = trips.join(feed["service_day"].filter(F.col("day").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))), "service_id")
    days = days.select(F.col("trip_number").alias("trip_id"), F.datediff("day", F.lit(first_day).cast("date")).cast("long").alias("day")).distinct()
    at = lambda c: station.select(F.col("station_id").alias(c), F.col("number").alias(f"{c}_n"))
    walks = feed["footpath"].join(at("a"), "a").join(at("b"), "b").select(F.col("a_n").alias("a"), F.col("b_n").alias("b"), "dur")
    loops = station.select(F.col("number").alias("a"), F.col("number").alias("b"), F.col("transfer_min").cast("long").alias("dur")).join(walks.filter("a = b"), ["a", "b"], "left_anti")
    return {"station": station, "trip": trips, "conn": on_days(legs, days), "footpath": walks.unionByName(loops)}
