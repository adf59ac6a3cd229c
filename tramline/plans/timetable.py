"""Timetable views over the driver's tables, and the same views as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: View definitions that read alike in Spark and DuckDB; an order is a trip, its items are stops.
VIEWS = {
    "station": """SELECT CAST(s_suppkey AS BIGINT) AS station_id, s_name AS name, CAST(s_nationkey AS BIGINT) AS meta_id,
        47 + (s_suppkey * 7919 % 8000) / 1e3 AS lat, 6 + (s_suppkey * 104729 % 9000) / 1e3 AS lng,
        CAST(2 + s_suppkey % 6 AS BIGINT) AS transfer_min FROM supplier""",
    "trip_stop": """SELECT trip_id, seq, station_id, base + 20 * seq + p % 7 - 2 - p % 3 AS arr_min, base + 20 * seq + p % 7 AS dep_min,
        p % 11 <> 3 AS in_allowed, p % 13 <> 5 AS out_allowed, CAST(trip_id % 10 AS INT) AS clasz
        FROM (SELECT l_orderkey AS trip_id, l_suppkey AS station_id, l_partkey AS p, l_orderkey * 37 % 1200 AS base,
              CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS BIGINT) AS seq
              FROM lineitem) x""",
    "segment": """SELECT trip_id, seq, station_id AS from_station, to_station, dep_min, arr_min, in_allowed, out_allowed, clasz
        FROM (SELECT trip_id, seq, station_id, dep_min, in_allowed, clasz, lead(station_id) OVER w AS to_station, lead(arr_min) OVER w AS arr_min, lead(out_allowed) OVER w AS out_allowed
              FROM trip_stop WINDOW w AS (PARTITION BY trip_id ORDER BY seq)) y WHERE to_station IS NOT NULL AND to_station <> station_id""",
    "conn": """SELECT day, trip_id, seq, from_station, to_station, day * 1440 + dep_min AS dep, day * 1440 + arr_min AS arr, in_allowed, out_allowed, clasz
        FROM segment CROSS JOIN (SELECT CAST(0 AS BIGINT) AS day UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) d
        WHERE (trip_id + day) % 7 < 5""",
    "message": """SELECT CAST(event_id AS BIGINT) AS msg_id, ts, event_type, CASE event_type WHEN 'purchase' THEN 'is' WHEN 'view' THEN 'forecast' WHEN 'error' THEN 'cancel' WHEN 'click' THEN 'reroute' ELSE 'addition' END AS kind,
        CAST(event_id AS BIGINT) AS trip_id, CAST(CAST(floor(value) AS BIGINT) % 4 AS BIGINT) AS seq, CAST(CAST(floor(value) AS BIGINT) % 30 AS BIGINT) AS delay FROM events""",
    "snapshot": "SELECT CAST(user_id AS BIGINT) AS terminal, ts, CAST(floor(value) AS BIGINT) % 12 AS bikes FROM events",
}
NEEDS = {"station": [], "trip_stop": [], "segment": ["trip_stop"], "conn": ["trip_stop", "segment"], "message": [], "snapshot": []}
#: Windows over windows of a trip need its rows together once: the input is dealt by the trip, under both of its names.
DEALT = {"trip_stop": "l_orderkey"}
TABLES = {"station": ["supplier"], "trip_stop": ["lineitem"], "segment": [], "conn": [], "message": ["events"], "snapshot": ["events"]}


def view(spark: SparkSession, sf_dir: str, name: str, dealt: bool = False) -> DataFrame:
    """One view as a DataFrame; its inputs are passed by value, no catalog entry is made."""
    inputs = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name]}
    if dealt:
        inputs = {t: df.repartition(DEALT[name]) for t, df in inputs.items()}
    inputs |= {v: view(spark, sf_dir, v, v in DEALT) for v in NEEDS[name][-1:]}
    text = VIEWS[name]
    for k in inputs:
        text = text.replace(f"FROM {k}", f"FROM {{{k}}}")
    return spark.sql(text, **inputs)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the named views, and those they need, in front."""
    order = [v for v in VIEWS if v in names or any(v in NEEDS[n] for n in names)]
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in order)
    sql = sql.strip()
    return f"WITH {head}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {head} {sql}"


def conn_between(spark: SparkSession, sf_dir: str, first: int, last: int) -> DataFrame:
    """Connections departing in [first, last]; the day filter comes before the day expansion's other work."""
    return view(spark, sf_dir, "conn").filter(F.col("dep").between(first, last) & F.col("day").between(first // 1440 - 1, last // 1440))
