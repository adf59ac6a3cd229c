"""Bike sharing: hourly availability, terminals, walks and rides between them, reliable offers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import BIKE_SPEED, DETOUR, WALK_SPEED
from .pareto import undominated
from .relational import EARTH_KM, KM_PER_DEGREE, radius_join

#: Walk to a terminal in metres, shortest and longest ride, hours of a week, bikes that are reliable.
WALK_METERS, LEAST_RIDE, MOST_RIDE, HOURS, RELIABLE = 900.0, 500.0, 7500.0, 168, 5
ZONE = "Europe/Berlin"
#: Blocks of starts: degrees that one lies within, degrees of the stripes that it is cut by, most starts; goals handled at once.
BLOCK_DEGREES, STRIPE_DEGREES, BLOCK_STARTS, GOALS_AT_ONCE = 1.0, 0.25, 512, 1024
AGGREGATORS = {"average": "average", "median": "median", "minimum": "minimum", "q90": "q90", "percent_reliable": "percent_reliable"}


def bucket(ts: Column, zone: str = ZONE) -> Column:
    """Hour of the week in local time, 0 for midnight to one on Sunday; ``ts`` is a timestamp of a UTC session."""
    local = F.from_utc_timestamp(ts, zone)
    return ((F.dayofweek(local) - 1) * 24 + F.hour(local)).cast("long")


def hourly_availability(snapshots: DataFrame, zone: str = ZONE) -> DataFrame:
    """(terminal, bucket, average, median, minimum, q90, percent_reliable): ``q90`` bikes are there in 90 % of snapshots.

    Counts per number of bikes are made first, so what is collected per hour is a short histogram,
    however many snapshots there are.
    """
    counts = snapshots.select("terminal", bucket(F.col("ts"), zone).alias("bucket"), "bikes").groupBy("terminal", "bucket", "bikes").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("terminal", "bucket")
    rows = counts.withColumn("upto", F.sum("n").over(w.orderBy("bikes").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor((F.col("all") - 1) * F.lit(q)), F.col("bikes")))
    return rows.groupBy("terminal", "bucket").agg(
        (F.sum(F.col("bikes") * F.col("n")) / F.sum("n")).alias("average"), at(0.5).alias("median"), F.min("bikes").alias("minimum"), at(0.1).alias("q90"),
        (F.sum(F.when(F.col("bikes") >= RELIABLE, F.col("n")).otherwise(0)) / F.sum("n")).alias("percent_reliable"),
    )


def store(snapshots: DataFrame, path: str, zone: str = ZONE) -> None:
    """Write terminals (their last place and name) and their hourly availability."""
    last = snapshots.groupBy("terminal").agg(F.max_by(F.struct("lat", "lng", "name"), "ts").alias("t")).select("terminal", "t.*")
    last.write.mode("overwrite").parquet(f"{path}/terminals")
    hourly_availability(snapshots, zone).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/availability")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/terminals"), spark.read.parquet(f"{path}/availability")


def _minutes(km: Column, speed: float) -> Column:
    return F.floor(km * 1000 * DETOUR / speed / 60).cast("long")


def attached(terminals: DataFrame, stations: DataFrame, meters: float = WALK_METERS) -> DataFrame:
    """(terminal, station_id, walk): stations in walking distance of each terminal."""
    places = stations.select("station_id", F.col("lat").alias("plat"), F.col("lng").alias("plng"))
    return radius_join(terminals.select("terminal", "lat", "lng"), places, meters / 1000).select("terminal", "station_id", _minutes(F.col("km"), WALK_SPEED).alias("walk"))


def reachable(terminals: DataFrame, least: float = LEAST_RIDE, most: float = MOST_RIDE) -> DataFrame:
    """(from_terminal, to_terminal, ride): pairs a bike is worth riding between, ``most`` excluded."""
    places = terminals.select(F.col("terminal").alias("to_terminal"), F.col("lat").alias("plat"), F.col("lng").alias("plng"))
    pairs = radius_join(terminals.select("terminal", "lat", "lng"), places, most / 1000, least / 1000).filter((F.col("terminal") != F.col("to_terminal")) & (F.col("km") < most / 1000))
    return pairs.select(F.col("terminal").alias("from_terminal"), "to_terminal", _minutes(F.col("km"), BIKE_SPEED).alias("ride"))


class _Places:
    """Points on the unit sphere as arrays ordered by latitude; distances are those of ``relational.haversine_km``, from straight lines."""

    def __init__(self, lat: np.ndarray, at: tuple[np.ndarray, ...]) -> None:
        self.lat, self.at = lat, at

    @staticmethod
    def of(lat: np.ndarray, lng: np.ndarray) -> _Places:
        y, x = np.radians(lat), np.radians(lng)
        return _Places(lat, (np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)))

    def __getitem__(self, rows: np.ndarray | slice) -> _Places:
        return _Places(self.lat[rows], tuple(x[rows] for x in self.at))

    def squares(self, of: _Places, k: int, low: int = 0, high: int | None = None) -> np.ndarray:
        """Squared lengths of the straight lines to the ``k``th place of another set."""
        (x, y, z), (a, b, c) = self.at, of.at
        x, y, z = x[low:high] - a[k], y[low:high] - b[k], z[low:high] - c[k]
        return x * x + y * y + z * z

    def within(self, of: _Places, k: int, km: float, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Rows from ``least`` to ``km`` away from the ``k``th place of another set, and their distances."""
        wide, lat = km / KM_PER_DEGREE, of.lat[k]  # no degree of latitude is shorter
        low, high = self.lat.searchsorted(lat - wide), self.lat.searchsorted(lat + wide, "right")
        squares = self.squares(of, k, low, high)
        rows = np.flatnonzero(squares <= (2 * np.sin(min(km / EARTH_KM, np.pi) / 2)) ** 2 + 1e-12)
        far = _arc(squares[rows])
        if rows.size and (far.max() > km or far.min() < least):
            fits = (far <= km) & (far >= least)
            rows, far = rows[fits], far[fits]
        return rows + low, far


def _arc(squares: np.ndarray) -> np.ndarray:
    return 2 * EARTH_KM * np.arcsin(np.minimum(np.sqrt(squares) / 2, 1.0))


def shortest(stations: DataFrame, walk: float, least: float, most: float) -> DataFrame:
    """(start, goal, minutes): the shortest way on foot to a terminal, by bike to another and on foot on; stations are the terminals.

    Walks are up to ``walk`` kilometres, rides from ``least`` to ``most``.  Pairs of stations are rows only in the answer, which is made
    where it stays: starts are dealt into blocks by place, and each block gets a copy of the stations that it could reach.  A task
    holds minutes from a block's starts to those, least over what lies before each: a ride after the first walk, a walk after the ride.

    Walks are slower than rides, and no way is shorter than the straight one.  So a way with a walk of x kilometres takes more than
    the ride straight to its end and x times what a kilometre on foot takes longer, less 3 minutes for three roundings:
    where a way is known already, longer walks are not looked at.
    """
    cell, reach = BLOCK_DEGREES, 2 * walk + most
    s = stations.select("station_id", "lat", "lng").dropna().distinct()
    of_cell = Window.partitionBy("row", "column")
    order, n = F.row_number().over(of_cell.orderBy(F.floor(F.col("lat") / STRIPE_DEGREES), "lng", "station_id", "lat")), F.count(F.lit(1)).over(of_cell)
    s = s.withColumn("row", F.floor(F.col("lat") / cell)).withColumn("column", F.floor(F.col("lng") / cell)).withColumn("part", F.floor((order - 1) * F.ceil(n / BLOCK_STARTS) / n))
    key = ["row", "column", "part"]
    middle = lambda c: ((F.col(c) + F.lit(0.5)) * cell)
    blocks = s.select(*key).distinct().withColumn("lat", middle("row")).withColumn("lng", middle("column"))
    places = s.select("station_id", F.col("lat").alias("plat"), F.col("lng").alias("plng"), F.struct(*key).alias("own"))
    # half a cell's diagonal, and a kilometre as a degree is a little more than KM_PER_DEGREE
    rows = radius_join(blocks, places, reach + cell * KM_PER_DEGREE / 2**0.5 + 1).select(*key, "station_id", "plat", "plng", (F.col("own") == F.struct(*key)).alias("start"))
    exact = lambda km, speed: km * 1000 * DETOUR / speed / 60
    minutes = lambda km, speed: np.floor(exact(km, speed))
    longest = 2 * minutes(walk, WALK_SPEED) + minutes(most, BIKE_SPEED)
    kind, never = (np.int16, 10_000) if longest < 10_000 else (np.int64, 1 << 40)  # three of them fit the kind
    slower = exact(1, WALK_SPEED) - exact(1, BIKE_SPEED)

    def least_over(before: np.ndarray, frm: _Places, to: _Places, km: np.ndarray, low: float, speed: float) -> np.ndarray:
        """Least minutes from each start (column) to each of ``to`` by a further way from one of ``frm`` (row), at most ``km`` long."""
        out = np.full((len(to.lat), before.shape[1]), never, kind)
        for k in range(len(to.lat)):
            rows, far = frm.within(to, k, km[k], low)
            if len(rows):
                come = before.take(rows, 0)
                come += minutes(far, speed).astype(kind)[:, None]
                come.min(0, out=out[k])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lat, lng, start = (np.concatenate(x) for x in zip(*([b.column(c).to_numpy(zero_copy_only=False) for c in ("station_id", "plat", "plng", "start")] for b in batches), strict=True))
        north = np.argsort(lat, kind="stable")
        every, ids, own = _Places.of(lat[north], lng[north]), ids[north], np.flatnonzero(start[north])
        starts, starts_ids = every[own], ids[own]
        # how far each is from the first start; the others lie no further from that than ``wide``
        far = _arc(every.squares(starts, 0))
        wide = far[own].max() + 1e-6
        ids, every, far = ids[far <= wide + reach], every[far <= wide + reach], far[far <= wide + reach]
        first, reached = every[far <= wide + walk], np.flatnonzero(far <= wide + walk + most)
        second = every[reached]
        foot, close = np.full((len(first.lat), len(own)), never, kind), np.zeros(len(first.lat), bool)
        gaps = np.empty((len(second.lat), len(own)))
        for k in range(len(own)):
            rows, km = first.within(starts, k, walk)
            foot[rows, k] = minutes(km, WALK_SPEED)
            close[rows[km <= 3 / slower + 1e-6]] = True
            gaps[:, k] = _arc(second.squares(starts, k))
        straight = ((gaps >= least) & (gaps <= most)).all(1)  # all starts may ride there at once
        ridden = np.full((len(second.lat), len(own)), never, kind)
        for part, base, frm in ((straight, foot[close], first[close]), (~straight, foot, first)):
            ridden[part] = least_over(base, frm, second[part], np.full(part.sum(), most), least, BIKE_SPEED)
        walks = np.full(len(ids), walk)
        most_left = ((ridden - exact(gaps, BIKE_SPEED) + 3) / slower).max(1) + 1e-6
        walks[reached] = np.where((ridden < never).all(1), np.minimum(most_left, walk), walk)
        for k in range(0, len(ids), GOALS_AT_ONCE):
            part = slice(k, k + GOALS_AT_ONCE)
            found = least_over(ridden, second, every[part], walks[part], 0.0, WALK_SPEED)
            goal, begin = np.nonzero(found < never)
            yield pa.RecordBatch.from_arrays([pa.array(starts_ids[begin]), pa.array(ids[part][goal]), pa.array(found[goal, begin].astype(np.int64))], names=["start", "goal", "minutes"])

    # blocks are few rows and much work: a number of tasks is asked for, so that none are put together
    tasks = int(stations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *key).groupBy(*key).applyInArrow(run, "start long, goal long, minutes long")


def near(terminals: DataFrame, availability: DataFrame, lat: float, lng: float, meters: float, hour: int, aggregator: str = "average") -> DataFrame:
    """(terminal, km, value): terminals around a point and how many bikes they have in an hour of the week."""
    point = terminals.sparkSession.range(1).select(F.lit(lat).alias("lat"), F.lit(lng).alias("lng"))
    places = terminals.select("terminal", F.col("lat").alias("plat"), F.col("lng").alias("plng"))
    rows = radius_join(point, places, meters / 1000).select("terminal", "km")
    now = availability.filter(F.col("bucket") == hour).select("terminal", F.col(AGGREGATORS[aggregator]).cast("double").alias("value"))
    return rows.join(now, "terminal", "left").select("terminal", "km", F.coalesce("value", F.lit(0.0)).alias("value"))


def _hours(begin: int, end: int) -> Column:
    """Hours from the one that holds ``begin`` (seconds) up to ``end``."""
    first = begin - begin % 3600
    return F.transform(F.sequence(F.lit(0), F.lit(max(0, -(-(end - first) // 3600) - 1))), lambda k: F.lit(first) + k * 3600)


def search(terminals: DataFrame, stations: DataFrame, availability: DataFrame, points: DataFrame, begin: int, end: int, aggregator: str = "average", arrivals: bool = False, horizon: int = 86400, zone: str = ZONE) -> DataFrame:
    """(point, station_id, from_terminal, to_terminal, walk, ride, begin, value): walk to a terminal, ride, walk to a station.

    ``points`` has (point, lat, lng).  With ``arrivals`` the way goes from the station to the point and
    the interval ends a day later.  Each hour of the interval has the availability of the terminal
    where the bike is taken.
    """
    end += horizon if arrivals else 0
    places = terminals.select("terminal", F.col("lat").alias("plat"), F.col("lng").alias("plng"))
    here = radius_join(points.select("point", "lat", "lng"), places, WALK_METERS / 1000).select("point", "terminal", _minutes(F.col("km"), WALK_SPEED).alias("_w"))
    ends = attached(terminals, stations).select(F.col("terminal").alias("_far"), "station_id", F.col("walk").alias("_v"))
    rides = reachable(terminals)
    mine, other = ("to_terminal", "from_terminal") if arrivals else ("from_terminal", "to_terminal")
    rows = here.withColumnRenamed("terminal", mine).join(rides, mine).join(ends, F.col(other) == F.col("_far"))
    rows = rows.select("point", "station_id", "from_terminal", "to_terminal", (F.col("_w") + F.col("_v")).alias("walk"), "ride", F.explode(_hours(begin, end)).alias("begin"))
    rows = rows.withColumn("_b", bucket(F.col("begin").cast("timestamp"), zone))
    a = availability.select(F.col("terminal").alias("from_terminal"), F.col("bucket").alias("_b"), F.col(AGGREGATORS[aggregator]).cast("double").alias("value"))
    return rows.join(a, ["from_terminal", "_b"], "left").select("point", "station_id", "from_terminal", "to_terminal", "walk", "ride", "begin", F.coalesce("value", F.lit(0.0)).alias("value"))


def runs(intervals: DataFrame, by: list[str], seconds: int = 60) -> DataFrame:
    """(by, value, begin, end): intervals of one value, merged where at most ``seconds`` lie between neighbours; of equal
    intervals that with the smaller value comes first."""
    w = Window.partitionBy(*by).orderBy("begin", "end", "value")
    new = F.when((F.col("value") == F.lag("value").over(w)) & (F.col("begin") - F.lag("end").over(w) <= seconds), 0).otherwise(1)
    rows = intervals.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # a run ends where its last interval does
    return rows.groupBy(*by, "value", "_run").agg(F.min("begin").alias("begin"), F.max_by("end", F.struct("begin", "end")).alias("end")).drop("_run")


def reliable(offers: DataFrame, least: float = 4.0, most_minutes: int = 1440, pareto: bool = True) -> DataFrame:
    """(point, station_id, from_terminal, to_terminal, walk, ride, value, begin, end): offers whose first terminal has at least
    ``least`` bikes, hours merged; per station only those no other beats in duration and in the share of walking."""
    rows = offers.filter((F.col("value") >= least) & (F.col("walk") + F.col("ride") <= most_minutes)).withColumn("end", F.col("begin") + 3600)
    ids = ["point", "station_id", "from_terminal", "to_terminal", "walk", "ride"]
    out = runs(rows.withColumn("value", F.floor("value")), ids)
    if not pareto:
        return out
    total = lambda x: x("walk") + x("ride")

    def rule(a, b):  # ratios walk / ride compared by cross products
        lo, hi = a("walk") * b("ride"), b("walk") * a("ride")
        return (lo <= hi) & (total(a) <= total(b)) & ((lo < hi) | (total(a) < total(b)))

    best = undominated(out.select(*ids).distinct(), ["point", "station_id"], rule)
    return out.join(best, ids, "left_semi")


def extra_edges(offers: DataFrame) -> DataFrame:
    """Offers of ``reliable`` as edges (a, b, dur, open_from, open_to) from a point to a station, open by minutes of the day."""
    at = lambda c: F.pmod(F.floor(F.col(c) / 60), F.lit(1440)).cast("long")
    return offers.select(F.col("point").alias("a"), F.col("station_id").alias("b"), (F.col("walk") + F.col("ride")).alias("dur"), at("begin").alias("open_from"), (at("end") - 1).alias("open_to"))
