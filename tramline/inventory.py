"""Further registered queries: services, calendars, lookups, messages, dominance, reliability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import services
from .plans.timetable import view, with_views
from .registry import ORACLE, query, sql_query

# --- services and sequences -----------------------------------------------------------------

sql_query("journey_shape", "SELECT trip_id, max(arr_min) - min(dep_min) AS duration, count(*) AS n_segments, CAST(sum(CASE WHEN out_allowed THEN 1 ELSE 0 END) AS BIGINT) AS n_exits FROM {segment} GROUP BY trip_id", "segment")
sql_query("nth_occurrence", "SELECT trip_id, station_id, seq FROM (SELECT trip_id, station_id, seq, row_number() OVER (PARTITION BY trip_id, station_id ORDER BY seq) AS nth FROM {trip_stop}) x WHERE nth = 2", "trip_stop")
sql_query(
    "carry_forward",
    "SELECT trip_id, seq, last_value(CASE WHEN station_id % 5 = 0 THEN trip_id * 10 + seq END) IGNORE NULLS OVER (PARTITION BY trip_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS train_nr FROM {trip_stop}",
    "trip_stop",
    duck="SELECT trip_id, seq, last_value(CASE WHEN station_id % 5 = 0 THEN trip_id * 10 + seq END IGNORE NULLS) OVER (PARTITION BY trip_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS train_nr FROM trip_stop",
)
sql_query(
    "record_segmentation",
    "SELECT user_id, record, min(event_id) AS first_line, count(*) AS n_lines FROM (SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS record FROM {events}) x GROUP BY user_id, record",
    tables=("events",),
)
sql_query("day_offset", "SELECT trip_id, seq, CAST(floor(arr_min / 1440) - floor(min(dep_min) OVER (PARTITION BY trip_id) / 1440) AS BIGINT) AS days_later FROM {segment}", "segment")
sql_query(
    "trip_to_connection",
    "SELECT trip_id, array_join(transform(array_sort(collect_list(struct(seq, station_id, arr_min, dep_min))), x -> concat(x.station_id, '@', x.arr_min, '/', x.dep_min)), ' ') AS stops, min(dep_min) AS departure, max(arr_min) AS arrival FROM {trip_stop} GROUP BY trip_id",
    "trip_stop",
    duck="SELECT trip_id, string_agg(station_id || '@' || arr_min || '/' || dep_min, ' ' ORDER BY seq) AS stops, min(dep_min) AS departure, max(arr_min) AS arrival FROM trip_stop GROUP BY trip_id",
)
sql_query(
    "sequence_classes",
    "SELECT path, count(*) AS n_trips, count(DISTINCT clasz) AS n_classes, min(trip_id) AS first_trip FROM (SELECT trip_id, min(clasz) AS clasz, array_join(transform(array_sort(collect_list(struct(seq, station_id))), x -> x.station_id), '-') AS path FROM {trip_stop} GROUP BY trip_id) t GROUP BY path",
    "trip_stop",
    duck="SELECT path, count(*) AS n_trips, count(DISTINCT clasz) AS n_classes, min(trip_id) AS first_trip FROM (SELECT trip_id, min(clasz) AS clasz, string_agg(station_id, '-' ORDER BY seq) AS path FROM trip_stop GROUP BY trip_id) t GROUP BY path",
)
sql_query("dedup_representative", "SELECT g.trip_id, g.seq, r.representative FROM {segment} g JOIN (SELECT from_station, to_station, arr_min - dep_min AS run, clasz, min(trip_id * 100 + seq) AS representative FROM {segment} GROUP BY from_station, to_station, arr_min - dep_min, clasz) r ON g.from_station = r.from_station AND g.to_station = r.to_station AND g.arr_min - g.dep_min = r.run AND g.clasz = r.clasz", "segment")


@query("repetition_expansion", "SELECT trip_id, seq, run, arr_min + run * (10 + trip_id % 20) AS arr_min, dep_min + run * (10 + trip_id % 20) AS dep_min FROM (SELECT *, unnest(range(trip_id % 3 + 1)) AS run FROM trip_stop) x", "trip_stop")
def repetition_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.repeat(view(spark, sf_dir, "trip_stop").select("trip_id", "seq", "arr_min", "dep_min"), F.col("trip_id") % 3, 10 + F.col("trip_id") % 20)


@query("day_set_runs", "SELECT trip_id, days, min(seq) AS first, max(seq) AS last FROM (SELECT *, seq - row_number() OVER (PARTITION BY trip_id, days ORDER BY seq) AS run FROM (SELECT trip_id, seq, (trip_id + from_station) % 3 AS days FROM segment) y) x GROUP BY trip_id, days, run", "segment")
def day_set_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.day_set_runs(view(spark, sf_dir, "segment").select("trip_id", "seq", ((F.col("trip_id") + F.col("from_station")) % 3).alias("days")))


_METERS = "1000 * 2 * 6371e0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))) / 100"


@query(
    "footpath_adjustment",
    f"""WITH f AS (SELECT a.station_id AS from_station, b.station_id AS to_station, greatest(5, a.transfer_min, b.transfer_min) AS d, {_METERS} AS m FROM station a JOIN station b ON a.meta_id = b.meta_id AND a.station_id <> b.station_id),
    t AS (SELECT *, CASE WHEN m > d * 90e0 THEN CAST(round(m / 90e0) AS BIGINT) ELSE d END AS minutes FROM f WHERE m <= 180e0 * d)
    SELECT from_station, to_station, minutes FROM t WHERE minutes <= 15""",
    "station",
)
def footpath_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footpaths between equivalent stations, distances taken at a hundredth."""
    from .operators.relational import haversine_km

    a, b = (view(spark, sf_dir, "station").alias(x) for x in "ab")
    meters = haversine_km(F.col("a.lat"), F.col("a.lng"), F.col("b.lat"), F.col("b.lng")) * 10
    minutes = services.adjusted_footpath(F.lit(5).cast("long"), F.col("a.transfer_min"), F.col("b.transfer_min"), meters)
    rows = a.join(b, (F.col("a.meta_id") == F.col("b.meta_id")) & (F.col("a.station_id") != F.col("b.station_id")))
    return rows.select(F.col("a.station_id").alias("from_station"), F.col("b.station_id").alias("to_station"), minutes.alias("minutes")).filter("minutes IS NOT NULL")


# --- calendars ------------------------------------------------------------------------------

_DAYS = "SELECT DISTINCT trip_id AS service_id, (trip_id * 3 + seq * seq * 5) % 7 AS day FROM {trip_stop} WHERE seq %s 2"
_A, _B = _DAYS.replace("%s", "<"), _DAYS.replace("%s", ">=")
sql_query("calendar_intersection", f"{_A} INTERSECT {_B}", "trip_stop")
sql_query("calendar_difference", f"{_A} EXCEPT {_B}", "trip_stop")
sql_query("calendar_symmetric_difference", f"SELECT service_id, day, 1 AS side FROM ({_A} EXCEPT {_B}) x UNION ALL SELECT service_id, day, 2 AS side FROM ({_B} EXCEPT {_A}) y", "trip_stop")
sql_query("route_traffic_days", "SELECT first_station, last_station, bit_or(days) AS days FROM (SELECT trip_id, min_by(station_id, seq) AS first_station, max_by(station_id, seq) AS last_station, CAST(pow(2, trip_id % 30) AS BIGINT) AS days FROM {trip_stop} GROUP BY trip_id) t GROUP BY first_station, last_station", "trip_stop")
sql_query(
    "utc_day_groups",
    """SELECT trip_id, first_utc, last_utc, CAST(sum(CAST(pow(2, day) AS BIGINT)) AS BIGINT) AS days FROM
    (SELECT trip_id, day, min(dep - day * 1440 - CASE WHEN dep >= 3 * 1440 + 120 THEN 120 ELSE 60 END) AS first_utc, max(arr - day * 1440 - CASE WHEN arr >= 3 * 1440 + 120 THEN 120 ELSE 60 END) AS last_utc FROM {conn} GROUP BY trip_id, day) d
    GROUP BY trip_id, first_utc, last_utc""",
    "conn",
)
sql_query("timezone_nearest_lower", "SELECT s.station_id, max(z.eva) AS zone_key, max_by(z.utc_offset, z.eva) AS utc_offset FROM {station} s JOIN (SELECT 0 AS eva, 60 AS utc_offset UNION ALL SELECT 20, 120 UNION ALL SELECT 55, 0) z ON z.eva <= s.station_id GROUP BY s.station_id", "station")

# --- lookups and messages -------------------------------------------------------------------

ORACLE["fuzzy_trip_lookup"] = with_views(
    """WITH e AS (SELECT trip_id, min_by(station_id, seq) AS station_id, min_by(dep_min, seq) AS time, CASE WHEN trip_id % 3 = 0 THEN 0 ELSE trip_id END AS nr FROM trip_stop GROUP BY trip_id),
    q AS (SELECT m.msg_id, e.station_id, e.time, m.trip_id AS nr FROM message m JOIN e ON m.trip_id = e.trip_id)
    SELECT q.msg_id, coalesce((SELECT min(trip_id) FROM e WHERE e.station_id = q.station_id AND e.time = q.time AND e.nr = q.nr), (SELECT min(trip_id) FROM e WHERE e.station_id = q.station_id AND e.time = q.time AND e.nr = 0)) AS trip_id,
      EXISTS (SELECT 1 FROM e WHERE e.station_id = q.station_id AND e.time = q.time AND e.nr = q.nr) AS exact FROM q""",
    "message", "trip_stop",
)
sql_query(
    "event_resolution",
    """SELECT e.msg_id, t.trip_id, t.seq FROM (SELECT m.msg_id, m.trip_id, s.station_id, s.dep_min + m.delay % 2 AS sched FROM {message} m JOIN {trip_stop} s ON m.trip_id = s.trip_id AND m.seq = s.seq) e
    JOIN (SELECT trip_id, seq, station_id, dep_min, count(*) OVER (PARTITION BY trip_id, station_id) AS n FROM {trip_stop}) t ON e.trip_id = t.trip_id AND e.station_id = t.station_id AND (t.n = 1 OR t.dep_min = e.sched)""",
    "message", "trip_stop",
)
sql_query("message_outcomes", "SELECT m.kind, CASE WHEN s.trip_id IS NULL THEN 'unresolved' WHEN m.delay > 15 THEN 'late' ELSE 'small' END AS outcome, count(*) AS n FROM {message} m LEFT JOIN {trip_stop} s ON m.trip_id = s.trip_id AND m.seq = s.seq GROUP BY 1, 2", "message", "trip_stop")
sql_query(
    "station_board_both_ways",
    """SELECT station_id, time, trip_id, direction FROM (SELECT from_station AS station_id, dep AS time, trip_id, CASE WHEN dep > 2000 THEN 'LATER' ELSE 'EARLIER' END AS direction,
    row_number() OVER (PARTITION BY from_station, dep > 2000 ORDER BY abs(dep - 2000), trip_id, seq) AS place FROM {conn} WHERE dep BETWEEN 1700 AND 2300 AND dep <> 2000) x WHERE place <= 3""",
    "conn",
)
sql_query(
    "connection_check",
    """SELECT a.trip_id, a.seq, b.trip_id AS next_trip, b.seq AS next_seq, w.k >= s.transfer_min AS valid FROM {trip_stop} a CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 3 UNION ALL SELECT 5) w
    JOIN {trip_stop} b ON a.station_id = b.station_id AND a.arr_min + w.k = b.dep_min AND a.trip_id <> b.trip_id JOIN {station} s ON a.station_id = s.station_id WHERE a.out_allowed AND b.in_allowed""",
    "station", "trip_stop",
)
sql_query(
    "through_service_pairs",
    """SELECT a.trip_id, b.trip_id AS next_trip, a.days & b.days AS days FROM (SELECT trip_id, max_by(station_id, seq) AS station_id, max(arr_min) AS at, 31 - CAST(pow(2, trip_id % 5) AS BIGINT) AS days FROM {trip_stop} GROUP BY trip_id) a
    JOIN (SELECT trip_id, min_by(station_id, seq) AS station_id, min(dep_min) AS at, CAST(pow(2, trip_id % 5) AS BIGINT) AS days FROM {trip_stop} GROUP BY trip_id) b
    ON a.station_id = b.station_id AND floor(a.at / 10) = floor(b.at / 10) AND a.at <= b.at AND a.days & b.days <> 0 AND a.trip_id <> b.trip_id""",
    "trip_stop",
)

# --- search helpers -------------------------------------------------------------------------

sql_query("no_intercity_graph", "SELECT from_station, to_station, min(arr_min - dep_min) + 20 AS weight FROM {segment} WHERE clasz >= 3 GROUP BY from_station, to_station", "segment")
sql_query("extra_edge_union", "SELECT from_station, to_station, min(minutes) AS minutes FROM (SELECT from_station, to_station, arr_min - dep_min AS minutes FROM {segment} UNION ALL SELECT a.station_id, b.station_id, 12 FROM {station} a JOIN {station} b ON a.meta_id = b.meta_id AND a.station_id <> b.station_id) e GROUP BY from_station, to_station", "station", "segment")
_JOURNEYS = "SELECT DISTINCT from_station, to_station, dep_min AS dep, arr_min AS arr, arr_min - dep_min AS t FROM {segment} WHERE arr_min > dep_min"
sql_query(
    "alpha_dominance",
    f"SELECT b.from_station, b.to_station, b.dep, b.arr FROM ({_JOURNEYS}) b WHERE NOT EXISTS (SELECT 1 FROM ({_JOURNEYS}) a WHERE a.from_station = b.from_station AND a.to_station = b.to_station AND a.t + 0.5e0 * a.t / b.t * least(abs(a.dep - b.dep), abs(a.arr - b.arr)) < b.t)",
    "segment",
)

# --- reliability and bikes ------------------------------------------------------------------

sql_query(
    "distribution_lookup",
    """SELECT g.trip_id, g.seq, d.dist_id FROM (SELECT trip_id, seq, clasz, least(greatest(arr_min - dep_min, 0), 40) AS t FROM {segment}) g
    JOIN (SELECT c.clasz, r.lo, r.hi, c.clasz * 10 + r.k AS dist_id FROM (SELECT DISTINCT clasz FROM {segment}) c CROSS JOIN (SELECT 0 AS lo, 14 AS hi, 0 AS k UNION ALL SELECT 15, 24, 1 UNION ALL SELECT 25, 40, 2) r) d ON g.clasz = d.clasz AND g.t BETWEEN d.lo AND d.hi""",
    "segment",
)
sql_query("late_compensation", "SELECT msg_id, delay * 5 AS minutes, CASE WHEN delay * 5 >= 120 THEN CAST(floor(price / 2) AS BIGINT) WHEN delay * 5 >= 60 THEN CAST(floor(price / 4) AS BIGINT) ELSE 0 END AS cents FROM (SELECT msg_id, delay, 1000 + trip_id % 900 AS price FROM {message}) m", "message")
ORACLE["availability_runs"] = with_views(
    """WITH d AS (SELECT DISTINCT terminal, bikes >= 4 AS value, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM snapshot),
    n AS (SELECT *, CASE WHEN lag(value) OVER w = value AND t - lag(t) OVER w <= 86400 THEN 0 ELSE 1 END AS new FROM d WINDOW w AS (PARTITION BY terminal ORDER BY t, value)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY terminal ORDER BY t, value ROWS UNBOUNDED PRECEDING) AS run FROM n)
    SELECT terminal, value, min(t) AS "begin", max(t) AS "end" FROM r GROUP BY terminal, value, run""",
    "snapshot",
)
