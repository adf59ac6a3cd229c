"""Boards, events, guesses and map views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOTH, LATER, EARLIER = "BOTH", "LATER", "EARLIER"


def events(conn: DataFrame, kind: str = BOTH) -> DataFrame:
    """(station_id, ev_type, time, trip_id, day, seq) of departures (DEP), arrivals (ARR) or both."""
    dep = conn.select(F.col("from_station").alias("station_id"), F.lit("DEP").alias("ev_type"), F.col("dep").alias("time"), "trip_id", "day", "seq")
    arr = conn.select(F.col("to_station").alias("station_id"), F.lit("ARR").alias("ev_type"), F.col("arr").alias("time"), "trip_id", "day", "seq")
    return {"DEP": dep, "ARR": arr}.get(kind, dep.unionByName(arr))


def station_events(conn: DataFrame, begin: int, end: int, kind: str = BOTH, stations: list[int] | None = None) -> DataFrame:
    """Events in [begin, end], of all or some stations; the interval reaches the scan of each side."""
    rows = events(conn, kind).filter(F.col("time").between(begin, end))
    return rows if stations is None else rows.filter(F.col("station_id").isin(stations))


def board(rows: DataFrame, at: int, k: int, direction: str = BOTH, by_direction: bool = False) -> DataFrame:
    """(station_id, time, trip_id, direction, place): each station's ``k`` events nearest to ``at``.

    LATER keeps events after, EARLIER before ``at``; ``by_direction`` counts both apart.  Ties go by
    time, trip and stop.  ``time`` may be the schedule's or the real one.
    """
    side = F.when(F.col("time") > at, LATER).otherwise(EARLIER)
    rows = rows.withColumn("direction", side)
    if direction != BOTH or by_direction:
        rows = rows.filter(F.col("time") != at)
    if direction != BOTH:
        rows = rows.filter(F.col("direction") == direction)
    keys = ["station_id", "direction"] if by_direction else ["station_id"]
    w = Window.partitionBy(*keys).orderBy(F.abs(F.col("time") - at), "time", "trip_id", "seq")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def with_delays(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """Events with the times of ``resolved`` (trip_id, day, seq, ev_type, real) where it has one."""
    keys = ["trip_id", "day", "seq", "ev_type"]
    return rows.join(resolved.select(*keys, "real"), keys, "left").withColumn("scheduled", F.col("time")).withColumn("time", F.coalesce("real", "time")).drop("real")


def trip_guesses(ends: DataFrame, at: int, k: int, where: Column | None = None) -> DataFrame:
    """The ``k`` trips (of those ``where`` holds) that depart nearest to ``at``."""
    rows = ends if where is None else ends.filter(where)
    return rows.orderBy(F.abs(F.col("dep_min") - at), "trip_id").limit(k)


def running(conn: DataFrame, begin: int, end: int) -> DataFrame:
    """(trip_id, day, dep, arr) of trips under way between ``begin`` and ``end``."""
    rows = conn.filter((F.col("arr") >= begin) & (F.col("dep") <= end))
    return rows.groupBy("trip_id", "day").agg(F.min("dep").alias("dep"), F.max("arr").alias("arr"))


def trains_in_box(conn: DataFrame, stations: DataFrame, south: float, north: float, west: float, east: float, begin: int, end: int, most_class: int | None = None, limit: int | None = None) -> DataFrame:
    """Connections under way in an interval whose bounding box meets a viewport, of classes up to ``most_class``.

    With ``limit`` the best classes come first, then trips in order: a map shows so many trains.
    """
    rows = conn.filter((F.col("arr") >= begin) & (F.col("dep") <= end))
    rows = rows if most_class is None else rows.filter(F.col("clasz") <= most_class)
    at = lambda x, c: stations.select(F.col("station_id").alias(c), F.col("lat").alias(f"{x}_lat"), F.col("lng").alias(f"{x}_lng"))
    rows = rows.join(at("a", "from_station"), "from_station").join(at("b", "to_station"), "to_station")
    rows = rows.filter((F.least("a_lat", "b_lat") <= north) & (F.greatest("a_lat", "b_lat") >= south) & (F.least("a_lng", "b_lng") <= east) & (F.greatest("a_lng", "b_lng") >= west))
    return rows if limit is None else rows.orderBy("clasz", "trip_id", "day", "seq").limit(limit)


def positions(rows: DataFrame, at: int) -> DataFrame:
    """(..., lat, lng): where trains of ``trains_in_box`` are at a minute, on the straight line between stations."""
    share = F.least(F.greatest((F.lit(at) - F.col("dep")) / F.greatest(F.col("arr") - F.col("dep"), F.lit(1)), F.lit(0.0)), F.lit(1.0))
    on = lambda c: F.col(f"a_{c}") + share * (F.col(f"b_{c}") - F.col(f"a_{c}"))
    return rows.withColumn("lat", on("lat")).withColumn("lng", on("lng"))


# --- station guesses ------------------------------------------------------------------------


def trigrams(text: Column) -> Column:
    """Distinct trigrams of a lower-case text with a blank around it."""
    t = F.concat(F.lit(" "), F.lower(F.trim(text)), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3))))


def station_guesses(stations: DataFrame, queries: DataFrame, k: int = 8, least: float = 0.5) -> DataFrame:
    """(query_id, station_id, score, place): per query (query_id, guess) the ``k`` best names.

    The score is the Jaccard similarity of trigrams times the station's importance; names below
    ``least`` similarity are none.  Candidates share one of their rarest trigrams: of n, as many as
    may be missing at that similarity, plus one (prefix filter), so frequent trigrams join nothing.
    """
    s = stations.select("station_id", "importance", trigrams(F.col("name")).alias("of"))
    q = queries.select("query_id", trigrams(F.col("guess")).alias("of"))
    rank = s.select(F.explode("of").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))

    def rare(rows: DataFrame, key: str) -> DataFrame:
        grams = rows.select(key, "of", F.explode("of").alias("gram")).join(rank, "gram", "left")
        w = Window.partitionBy(key).orderBy(F.coalesce("n", F.lit(0)), "gram")
        kept = F.size("of") - F.ceil(F.size("of") * F.lit(least)) + 1
        return grams.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= kept).select(key, "gram")

    pairs = rare(q, "query_id").join(rare(s, "station_id"), "gram").select("query_id", "station_id").distinct()
    rows = pairs.join(q.withColumnRenamed("of", "x"), "query_id").join(s.withColumnRenamed("of", "y"), "station_id")
    both = F.size(F.array_intersect("x", "y"))
    rows = rows.withColumn("similarity", both / (F.size("x") + F.size("y") - both)).filter(F.col("similarity") >= least)
    rows = rows.withColumn("score", F.col("similarity") * F.col("importance"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "station_id")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("query_id", "station_id", "score", "place")


def names_within(stations: DataFrame, queries: DataFrame, edits: int = 1) -> DataFrame:
    """(query_id, station_id, distance) of names at most one edit from a guess.

    Names at most one edit apart share a deletion variant (the name itself or with one character
    less), so candidates come from an equi-join on variants.
    """
    if edits != 1:
        raise ValueError("variants are made for one edit")
    cut_one = lambda t: F.array_distinct(F.array_append(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(t), F.lit(1))), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.char_length(t)))), t))
    # compared once per pair of different texts, however many stations and queries have them
    s = stations.select("name").distinct().withColumn("_v", F.explode(cut_one(F.col("name"))))
    q = queries.select("guess").distinct().withColumn("_v", F.explode(cut_one(F.col("guess"))))
    pairs = q.join(s, "_v").select("guess", "name").distinct().withColumn("distance", F.levenshtein("name", "guess")).filter(F.col("distance") <= edits)
    asked = queries.select("query_id", "guess").distinct().join(pairs, "guess")
    return asked.join(stations.select("station_id", "name").distinct(), "name").select("query_id", "station_id", "distance")
