"""Registered queries of searches, real time, services, paths and bikes, with SQL twins written apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _FOOT, _START, measured_events, walks
from .functions import scalars
from .operators import bikes, connection_graph, pareto, paths, query, realtime, relational, search, services, timetable
from .plans.timetable import conn_between, view
from .registry import QUERIES
from .registry import query as register
from .sources import path_store

_MORNING = 480


def _conn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conn_between(spark, sf_dir, _MORNING, _MORNING + 2 * search.HORIZON)


# --- journeys ---------------------------------------------------------------------------------


@register("journeys", f"WITH {_FOOT}, {search.search_sql(7, _START, by_legs=True)}, g AS (SELECT station AS goal, arr AS arrival, CAST(legs - 1 AS BIGINT) AS transfers FROM found) SELECT goal, arrival, transfers FROM g WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.goal = g.goal AND h.transfers < g.transfers AND h.arrival <= g.arrival)", "station", "conn")
def journeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journeys from station 1 at 8:00 to every station: arrival per number of transfers, read back from the search's labels."""
    conn = _conn(spark, sf_dir)
    found = search.run_rounds(conn, walks(spark, sf_dir), spark.createDataFrame([(1, _MORNING)], "start long, t0 long"))
    goals = view(spark, sf_dir, "station").select(F.col("station_id").alias("goal"))
    return search.journeys(search.journey_legs(found, goals)).select("goal", "arrival", "transfers")


@register(
    "earliest_arrival_running",
    f"""WITH {_FOOT}, c AS (SELECT DISTINCT trip_id, seq FROM message WHERE kind = 'cancel'),
    flagged AS (SELECT n.*, EXISTS (SELECT 1 FROM c WHERE c.trip_id = n.trip_id AND c.seq IN (n.seq, n.seq + 1)) AS gone FROM conn n),
    running AS (SELECT * REPLACE (trip_id || '/' || piece AS trip_id) FROM (SELECT *, count_if(gone) OVER (PARTITION BY trip_id, day ORDER BY seq) AS piece FROM flagged) WHERE NOT gone),
    {search.search_sql(7, _START).replace(" conn", " running")} SELECT station, arr FROM best""",
    "station", "conn", "message",
)
def earliest_arrival_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earliest arrivals from station 1 at 8:00 without the sections that messages cancel."""
    stops = view(spark, sf_dir, "message").filter("kind = 'cancel'")
    gone = realtime.cancel(view(spark, sf_dir, "segment"), stops).filter("canceled")
    t = query.Timetable(_conn(spark, sf_dir), walks(spark, sf_dir)).running(gone.select("trip_id", "seq"))
    return search.earliest_arrival(t.conn, t.footpaths, spark.createDataFrame([(1, _MORNING)], "start long, t0 long"), 7).select("station", "arr")


@register(
    "journey_interchanges",
    f"""WITH {_FOOT}, {search.search_sql(3, _START, by_legs=True)}, g AS (SELECT station AS goal, arr, legs FROM found WHERE legs <= 3)
    SELECT goal, CAST(legs AS BIGINT) AS legs, true AS valid FROM g WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.goal = g.goal AND h.legs < g.legs AND h.arr <= g.arr)""",
    "station", "conn",
)
def journey_interchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The connection check of found journeys: every change leaves the time for it."""
    foot = walks(spark, sf_dir)
    found = search.run_rounds(_conn(spark, sf_dir), foot, spark.createDataFrame([(1, _MORNING)], "start long, t0 long"), 3)
    goals = view(spark, sf_dir, "station").select(F.col("station_id").alias("goal"))
    legs = search.journey_legs(found, goals)
    return search.check_interchanges(legs, foot).select("goal", F.col("legs").cast("long").alias("legs"), "valid")


def _pretrip_sql(begin: int, end: int) -> str:
    profile = f"SELECT DISTINCT CAST(1 AS BIGINT) AS start, dep AS t0 FROM conn WHERE from_station = 1 AND in_allowed AND dep BETWEEN {begin} AND {end} UNION SELECT 1, {end + 1}"
    return f"""WITH {_FOOT}, {search.search_sql(4, profile, by_legs=True)}, g AS (SELECT t0, arr, legs FROM found WHERE station = 5)
    SELECT max(t0) AS departure, arr AS arrival, CAST(legs - 1 AS BIGINT) AS transfers FROM g f WHERE t0 <= {end} AND NOT EXISTS (SELECT 1 FROM g WHERE g.t0 >= f.t0 AND g.arr <= f.arr AND g.legs <= f.legs AND (g.t0 <> f.t0 OR g.arr <> f.arr OR g.legs <> f.legs)) GROUP BY arr, legs"""


@register("pretrip_journeys", _pretrip_sql(_MORNING, _MORNING + 60), "station", "conn")
def pretrip_journeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journeys from station 1 to station 5 that leave between 8:00 and 9:00, of at most four trips."""
    t = query.Timetable(_conn(spark, sf_dir), walks(spark, sf_dir))
    q = query.Query(1, 5, _MORNING, "pretrip", _MORNING + 60, start_walks=False, rounds=4)
    return query.answer(t, q).select("departure", "arrival", "transfers")


@register(
    "pareto_price",
    f"""WITH {_FOOT}, c AS (SELECT *, trip_id % 97 + seq * 10 AS fare FROM conn), k AS (SELECT *, sum(fare) OVER w AS upto, sum(fare) OVER w - fare AS before FROM c WINDOW w AS (PARTITION BY trip_id, day ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    b1 AS (SELECT trip_id, day, min(seq) AS enter FROM k WHERE from_station = 1 AND in_allowed AND dep BETWEEN {_MORNING} AND {_MORNING + 120} GROUP BY ALL),
    r1 AS (SELECT DISTINCT x.to_station AS station, x.arr, CAST(x.upto - e.before AS BIGINT) AS price FROM b1 JOIN k e ON e.trip_id = b1.trip_id AND e.day = b1.day AND e.seq = b1.enter JOIN k x ON x.trip_id = b1.trip_id AND x.day = b1.day AND x.seq >= b1.enter AND x.out_allowed AND x.arr <= {_MORNING + 1440}),
    w AS (SELECT DISTINCT station, arr, price FROM (SELECT * FROM r1 UNION ALL SELECT b, arr + dur, price FROM r1 JOIN footpath ON station = a AND a <> b) u)
    SELECT station, arr, price FROM w WHERE NOT EXISTS (SELECT 1 FROM w v WHERE v.station = w.station AND v.arr <= w.arr AND v.price <= w.price AND (v.arr < w.arr OR v.price < w.price))""",
    "station", "conn",
)
def pareto_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trip from station 1 within two hours of 8:00: all arrivals that no cheaper or earlier one beats."""
    conn = _conn(spark, sf_dir).filter((F.col("from_station") != 1) | (F.col("dep") <= _MORNING + 120)).withColumn("fare", F.col("trip_id") % 97 + F.col("seq") * 10)
    starts = spark.createDataFrame([(1, _MORNING)], "start long, t0 long")
    return pareto.pareto_search(conn, walks(spark, sf_dir), starts, (pareto.PRICE,), 1).select("station", "arr", "price")


def _fares_sql(answer: str) -> str:
    """Cheapest fare of every connection by number of trips: what boarding at each stop costs at least, carried along the trip."""
    parts = [
        f"c AS (SELECT *, trip_id % 97 + seq * 10 AS fare FROM conn WHERE dep BETWEEN {_MORNING} AND {_MORNING + search.HORIZON})",
        "k AS (SELECT *, sum(fare) OVER w AS upto, sum(fare) OVER w - fare AS before FROM c WINDOW w AS (PARTITION BY trip_id, day ORDER BY seq ROWS UNBOUNDED PRECEDING))",
        f"l0 AS (SELECT CAST(1 AS BIGINT) AS station, {_MORNING} AS ready, 0 AS price)",
    ]
    for n in range(1, search.MAX_LEGS + 1):
        parts += [
            f"b{n} AS (SELECT trip_id, day, seq, min(l.price - k.before) AS base FROM k JOIN l{n - 1} l ON from_station = station AND dep >= ready WHERE in_allowed GROUP BY ALL)",
            f"r{n} AS (SELECT to_station, arr, min(base) OVER (PARTITION BY trip_id, day ORDER BY seq ROWS UNBOUNDED PRECEDING) + upto AS price, out_allowed FROM k LEFT JOIN b{n} USING (trip_id, day, seq))",
            f"w{n} AS (SELECT b AS station, CASE WHEN a = b THEN arr ELSE arr + dur END AS arr, arr + dur AS ready, min(price) AS price FROM r{n} JOIN footpath ON to_station = a WHERE price IS NOT NULL AND out_allowed AND arr <= {_MORNING + search.HORIZON} GROUP BY ALL)",
            f"l{n} AS (SELECT station, ready, price FROM (SELECT *, min(price) OVER (PARTITION BY station ORDER BY ready, price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM w{n}) x WHERE m IS NULL OR price < m)",
        ]
    found = " UNION ALL ".join(f"SELECT station, arr, {n} AS legs, price FROM w{n}" for n in range(1, search.MAX_LEGS + 1))
    parts.append(f"f AS (SELECT station, arr, min(legs) AS legs, cost FROM (SELECT station, arr, legs, CAST({answer} AS BIGINT) AS cost FROM ({found}) u) v GROUP BY station, arr, cost)")
    # what fewer or as many trips reach as soon and as cheaply goes: running minima by number of trips
    parts.append("h AS (SELECT *, " + ", ".join(f"min(cost) FILTER (legs <= {n}) OVER s AS m{n}" for n in range(1, search.MAX_LEGS + 1)) + " FROM f WINDOW s AS (PARTITION BY station ORDER BY arr RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")
    beaten = " OR ".join(f"(legs = {n} AND m{n} <= cost)" for n in range(1, search.MAX_LEGS + 1))
    parts.append(f"g AS (SELECT * FROM h WHERE NOT coalesce({beaten}, false))")
    return f"WITH {_FOOT}, " + ", ".join(parts) + " SELECT station, arr, CAST(legs AS BIGINT) AS legs, cost AS price FROM g WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.station = g.station AND o.arr = g.arr AND o.legs <= g.legs AND o.cost <= g.cost AND (o.legs < g.legs OR o.cost < g.cost))"


def _fares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conn(spark, sf_dir).withColumn("fare", F.col("trip_id") % 97 + F.col("seq") * 10)


@register("pareto_price_full", _fares_sql("price"), "station", "conn")
def pareto_price_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journeys of up to seven trips from station 1 at 8:00 to every station that no sooner, cheaper and simpler one beats."""
    starts = spark.createDataFrame([(1, _MORNING)], "start long, t0 long")
    rides = _fares(spark, sf_dir).filter(F.col("dep") <= _MORNING + search.HORIZON)  # none later is boarded or alighted from
    found = pareto.pareto_search(rides, walks(spark, sf_dir), starts, pareto.SEARCHES["price"])
    return found.select("station", "arr", F.col("legs").cast("long").alias("legs"), "price")


@register("pareto_wage_price_goal", f"SELECT arr, legs, price FROM ({_fares_sql(f'price + {pareto.CENTS_PER_MINUTE} * (arr - {_MORNING})')}) q WHERE station = 5", "station", "conn")
def pareto_wage_price_goal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journeys from station 1 at 8:00 to station 5 by arrival, trips and price with what the time is worth; labels that can't help the goal go."""
    starts, goal = spark.createDataFrame([(1, _MORNING)], "start long, t0 long"), spark.createDataFrame([(5,)], "goal long")
    found = pareto.pareto_search(_fares(spark, sf_dir), walks(spark, sf_dir), starts, pareto.SEARCHES["wage_price"], goals=goal)
    return found.select("arr", F.col("legs").cast("long").alias("legs"), F.col("wage_price").alias("price"))


def _delays(spark: SparkSession) -> connection_graph.Delays:
    """Trains that start two minutes late in a fifth of cases; gained minutes by class, fewer by those that are late already."""
    def gained(rides: DataFrame) -> DataFrame:
        late = 1 + F.col("trip_id") % 10 % 3
        of = lambda delay, *pairs: F.struct(F.lit(delay).cast("long").alias("delay"), F.array(*(F.struct(F.coalesce(m).cast("long").alias("minute"), F.lit(p).alias("p")) for m, p in pairs)).alias("d"))
        rows = rides.withColumn("_g", F.explode(F.array(of(0, (F.lit(0), 0.6), (late, 0.3), (F.lit(12), 0.1)), of(2, (F.lit(-1), 0.5), (F.lit(0), 0.5)))))
        return rows.select("key", "_g.delay", F.explode("_g.d").alias("_x")).select("key", "delay", "_x.minute", "_x.p")

    start = F.explode(F.array(F.struct(F.lit(0).cast("long").alias("minute"), F.lit(0.8).alias("p")), F.struct(F.lit(2).cast("long").alias("minute"), F.lit(0.2).alias("p")))).alias("_x")
    return connection_graph.Delays(lambda rides: rides.select("key", start).select("key", "_x.minute", "_x.p"), gained)


def reliable_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection graphs from station 1 at 8:00 to station 7, grown until every arrival at a change is covered: the clock minutes of arrival."""
    t = query.Timetable(relational.cut(_conn(spark, sf_dir)), walks(spark, sf_dir))
    graphs = connection_graph.route("reliable_search", t, query.Query(1, 7, _MORNING), _delays(spark))
    return graphs.arrivals().select("graph", "minute", F.round("p", 9).alias("p"))


QUERIES["reliable_search"] = reliable_search  # grows by search after search: no SQL twin, tests follow it by hand


@register(
    "lower_bounds",
    """WITH RECURSIVE e AS (SELECT from_station, to_station, min(arr_min - dep_min) AS m FROM segment GROUP BY ALL),
    d AS (SELECT CAST(5 AS BIGINT) AS station, CAST(0 AS BIGINT) AS minutes, 0 AS n UNION ALL SELECT station, min(minutes), n FROM (SELECT e.from_station AS station, d.minutes + e.m AS minutes, d.n + 1 AS n FROM d JOIN e ON e.to_station = d.station WHERE d.n < 12) x GROUP BY station, n)
    SELECT station, min(minutes) AS minutes FROM d GROUP BY station""".replace("WITH RECURSIVE", "WITH"),
    "segment",
)
def lower_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least minutes from every station to station 5, waits left out."""
    edges = timetable.fastest(view(spark, sf_dir, "segment"))
    goal = spark.createDataFrame([(5,)], "goal long")
    return pareto.lower_bounds(edges, goal).select("station", "minutes")


# --- real time ----------------------------------------------------------------------------------

_EVENTS = """ev AS (SELECT trip_id, seq * 2 + 1 AS place, seq, 'DEP' AS ev_type, dep_min AS sched FROM trip_stop UNION ALL SELECT trip_id, seq * 2, seq, 'ARR', arr_min FROM trip_stop WHERE seq > 0),
mx AS (SELECT trip_id, seq, max(CASE WHEN kind = 'is' THEN delay END) AS d_is, max(CASE WHEN kind = 'forecast' THEN delay END) AS d_fc FROM message GROUP BY trip_id, seq),
me AS (SELECT ev.trip_id, place, ev.seq, ev_type, sched, sched + d_is AS is_t, sched + d_fc AS forecast_t FROM ev LEFT JOIN mx ON ev.trip_id = mx.trip_id AND ev.seq = mx.seq)"""


@register(
    "trip_repair",
    f"""WITH {_EVENTS}, b AS (SELECT trip_id, place, sched, (SELECT max(p.is_t) FROM me p WHERE p.trip_id = me.trip_id AND p.place <= me.place) AS low, (SELECT min(p.is_t) FROM me p WHERE p.trip_id = me.trip_id AND p.place >= me.place) AS high FROM me)
    SELECT trip_id, place, CASE WHEN low > CASE WHEN high < sched THEN high ELSE sched END THEN low WHEN high < sched THEN high ELSE sched END AS repaired FROM b""",
    "trip_stop", "message",
)
def trip_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times brought in line with the measured ones of each trip."""
    return realtime.repair(measured_events(spark, sf_dir).withColumn("resolved", F.col("sched"))).select("trip_id", "place", "repaired")


@register(
    "trip_conflicts",
    f"""WITH {_EVENTS}, t AS (SELECT trip_id, place, coalesce(is_t, greatest(sched, forecast_t)) AS t FROM me),
    n AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY place) AS i FROM t)
    SELECT a.trip_id, a.place FROM n a LEFT JOIN n b ON a.trip_id = b.trip_id AND b.i = a.i - 1 LEFT JOIN n c ON a.trip_id = c.trip_id AND c.i = a.i + 1 WHERE a.t < b.t OR a.t > c.t""",
    "trip_stop", "message",
)
def trip_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose measured or forecast time does not fit their trip."""
    rows = measured_events(spark, sf_dir).withColumn("resolved", F.coalesce("is_t", F.greatest("sched", "forecast_t")))
    return realtime.conflicts(rows).filter("NOT fits_trip").select("trip_id", "place")


@register("cancel_updates", "WITH c AS (SELECT DISTINCT trip_id, seq FROM message WHERE kind = 'cancel'), g AS (SELECT * FROM segment s WHERE EXISTS (SELECT 1 FROM c WHERE c.trip_id = s.trip_id AND c.seq IN (s.seq, s.seq + 1))) SELECT trip_id, from_station AS station_id, dep_min AS sched, 'DEP' AS ev_type FROM g UNION ALL SELECT trip_id, to_station, arr_min, 'ARR' FROM g", "segment", "message")
def cancel_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update rows of cancelled segments."""
    gone = realtime.cancel(view(spark, sf_dir, "segment"), view(spark, sf_dir, "message").filter("kind = 'cancel'"))
    return realtime.canceled_updates(gone).select("trip_id", "station_id", "sched", "ev_type")


@register(
    "reroute_status",
    """WITH m AS (SELECT DISTINCT trip_id, seq FROM message WHERE kind = 'reroute'),
    ev AS (SELECT trip_id, seq * 2 AS place, 'DEP' AS ev_type, from_station AS station_id, dep_min AS sched, seq AS s FROM segment UNION ALL SELECT trip_id, seq * 2 + 1, 'ARR', to_station, arr_min, seq + 1 FROM segment),
    k AS (SELECT ev.* FROM ev JOIN (SELECT DISTINCT trip_id FROM m) q ON ev.trip_id = q.trip_id WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.trip_id = ev.trip_id AND m.seq = ev.s)),
    r AS (SELECT *, row_number() OVER w AS n, lag(station_id) OVER w AS was FROM k WINDOW w AS (PARTITION BY trip_id ORDER BY place)),
    b AS (SELECT trip_id, n, CASE WHEN ev_type <> CASE WHEN n % 2 = 1 THEN 'DEP' ELSE 'ARR' END THEN 'EVENT_ORDER_MISMATCH' WHEN ev_type = 'DEP' AND was <> station_id THEN 'STATION_MISMATCH' END AS bad FROM r)
    SELECT trip_id, CASE WHEN count(*) % 2 <> 0 THEN 'EVENT_COUNT_MISMATCH' ELSE coalesce(arg_min(bad, n) FILTER (bad IS NOT NULL), 'OK') END AS status FROM b GROUP BY trip_id""",
    "segment", "message",
)
def reroute_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether trips still chain after the stops named by reroutes are taken out."""
    gone = view(spark, sf_dir, "message").filter("kind = 'reroute'").select("trip_id", F.col("seq").alias("s")).distinct()
    g = view(spark, sf_dir, "segment")
    row = lambda k, kind, station, time: g.select("trip_id", (F.col("seq") * 2 + k).alias("place"), F.lit(kind).alias("ev_type"), F.col(station).alias("station_id"), F.col(time).alias("sched"), (F.col("seq") + k).alias("s"))
    events = row(0, "DEP", "from_station", "dep_min").unionByName(row(1, "ARR", "to_station", "arr_min"))
    kept = events.join(gone.select("trip_id").distinct(), "trip_id", "left_semi").join(gone, ["trip_id", "s"], "left_anti")
    return realtime.chain_status(kept)


# --- services and ids -----------------------------------------------------------------------------

_PAIRS = """p AS (SELECT a.trip_id AS service_1, b.trip_id AS service_2, (a.trip_id + b.trip_id) % 5 AS day FROM (SELECT trip_id, max_by(station_id, seq) AS station_id, max(arr_min) AS at FROM trip_stop GROUP BY trip_id) a
    JOIN (SELECT trip_id, min_by(station_id, seq) AS station_id, min(dep_min) AS at FROM trip_stop GROUP BY trip_id) b ON a.station_id = b.station_id AND b.at BETWEEN a.at AND a.at + 2 AND a.trip_id <> b.trip_id)"""


@register(
    "rule_service_components",
    f"""WITH {_PAIRS}, e AS (SELECT DISTINCT day, a, b FROM (SELECT day, service_1 AS a, service_2 AS b FROM p UNION ALL SELECT day, service_2, service_1 FROM p) u),
    r AS (SELECT day, a AS node, a AS reached FROM e UNION SELECT r.day, r.node, e.b FROM r JOIN e ON e.day = r.day AND e.a = r.reached)
    SELECT day, node AS service, min(reached) AS component FROM r GROUP BY day, node""",
    "trip_stop",
)
def rule_service_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services that rules connect on a day, named by the smallest."""
    ends = relational.cut(timetable.trip_ends(view(spark, sf_dir, "trip_stop")).drop("n_stops"))
    a = ends.select(F.col("trip_id").alias("a"), F.col("last_station").alias("s"), F.col("arr_min").alias("at"))
    # departures within two minutes: joined by minute
    a = a.withColumn("dep", F.explode(F.sequence(F.col("at"), F.col("at") + 2)))
    b = ends.select(F.col("trip_id").alias("b"), F.col("first_station").alias("s"), F.col("dep_min").alias("dep"))
    pairs = a.join(b, ["s", "dep"]).filter("a <> b").select(((F.col("a") + F.col("b")) % 5).alias("day"), "a", "b")
    return relational.connected(pairs, ["day"]).withColumnRenamed("node", "service")


from .registry import ORACLE  # noqa: E402

for _name in ("rule_service_components", "lower_bounds"):
    ORACLE[_name] = ORACLE[_name].replace("WITH ", "WITH RECURSIVE ", 1)


@register("trip_aliases", "WITH n AS (SELECT trip_id, seq, station_id, dep_min, trip_id * 10 + seq // 3 AS nr, lag(trip_id * 10 + seq // 3) OVER w AS before, lead(seq) OVER w IS NULL AS last FROM trip_stop WINDOW w AS (PARTITION BY trip_id ORDER BY seq)) SELECT trip_id, station_id, nr AS train_nr, dep_min AS time, seq > 0 AS alias FROM n WHERE (before IS NULL OR before <> nr) AND (seq = 0 OR NOT last)", "trip_stop")
def trip_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary and alias ids of trips whose number changes every third stop."""
    stops = view(spark, sf_dir, "trip_stop")
    ids = timetable.trip_ids(stops, F.col("trip_id") * 10 + F.floor(F.col("seq") / 3), F.lit(None).cast("string"))
    return ids.select("trip_id", "station_id", "train_nr", "time", "alias")


@register("timetable_violations", "SELECT trip_id, day, seq, CASE WHEN arr < dep THEN 'arrives before it departs' ELSE 'departs before it arrives' END AS problem FROM (SELECT *, lag(arr) OVER (PARTITION BY trip_id, day ORDER BY seq) AS before FROM (SELECT * EXCLUDE (arr), arr + CASE WHEN trip_id % 40 = 0 THEN 30 WHEN trip_id % 40 = 1 THEN -60 ELSE 0 END AS arr FROM conn) c) x WHERE arr < dep OR dep < before", "conn")
def timetable_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules after some trips' arrivals were moved."""
    moved = F.when(F.col("trip_id") % 40 == 0, 30).when(F.col("trip_id") % 40 == 1, -60).otherwise(0)
    return timetable.violations(view(spark, sf_dir, "conn").withColumn("arr", F.col("arr") + moved))


@register("attribute_ranges", "SELECT trip_id, attribute, min(seq) AS first, max(seq) AS last FROM (SELECT *, seq - row_number() OVER (PARTITION BY trip_id, attribute ORDER BY seq) AS run FROM (SELECT trip_id, seq, from_station % 4 AS attribute FROM segment) a) x GROUP BY trip_id, attribute, run", "segment")
def attribute_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of sections with the same attribute."""
    return timetable.attribute_ranges(view(spark, sf_dir, "segment").withColumn("attribute", F.col("from_station") % 4), "attribute")


# --- fares, taxis, geometry, bikes ------------------------------------------------------------------

_KM = "2 * 6371e0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))"


@register("segment_fares", """SELECT g.trip_id, g.seq, CAST(floor(CASE WHEN clasz = 0 THEN 22 WHEN clasz <= 3 THEN 18 WHEN clasz <= 8 THEN 15 ELSE 0 END * round(2 * 6367e0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))), 3)) AS BIGINT) AS cents
    FROM segment g JOIN station a ON g.from_station = a.station_id JOIN station b ON g.to_station = b.station_id""", "station", "segment")
def segment_fares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .calls import segment_fares as fares

    return fares(view(spark, sf_dir, "segment"), view(spark, sf_dir, "station"))


@register("taxi_fares", f"WITH d AS (SELECT b.station_id, round({_KM}, 3) AS km FROM (SELECT 50e0 AS lat, 10e0 AS lng) a, station b) SELECT station_id, CAST(floor(10 + (least(km, 5e0) * 1.5e0 / 40 + greatest(km - 5e0, 0e0) * 1.5e0 / 100) * 60) AS BIGINT) AS minutes, CAST(floor(250 + km * 1.5e0 * 200) AS BIGINT) AS cents, CAST(least(floor(km * 1.2e0 * 30), 12300) AS BIGINT) AS train FROM d", "station")
def taxi_fares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taxi times and fares, and the estimated train fare, from a point to every station."""
    s = view(spark, sf_dir, "station")
    km = F.round(relational.haversine_km(F.lit(50.0), F.lit(10.0), F.col("lat"), F.col("lng")), 3)
    return s.select("station_id", scalars.taxi_minutes(km).alias("minutes"), scalars.taxi_cents(km).alias("cents"), scalars.train_cents(km, F.lit(3)).alias("train"))


_CORNERS = [(48.0, 7.0), (52.5, 8.5), (53.5, 13.0), (49.0, 14.0)]


@register("stations_in_polygon", "SELECT station_id FROM (SELECT station_id, lat, lng, " + " + ".join(f"CASE WHEN ({y1}e0 > lat) <> ({y2}e0 > lat) AND lng < {x1}e0 + (lat - {y1}e0) * ({x2}e0 - {x1}e0) / ({y2}e0 - {y1}e0) THEN 1 ELSE 0 END" for (y1, x1), (y2, x2) in zip(_CORNERS, [*_CORNERS[1:], _CORNERS[0]], strict=True)) + " AS n FROM station) x WHERE n % 2 = 1", "station")
def stations_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "station").filter(paths.in_polygon(F.col("lat"), F.col("lng"), _CORNERS)).select("station_id")


@register("bike_rides", f"SELECT a.station_id AS from_terminal, b.station_id AS to_terminal, CAST(floor(({_KM}) * 1000 * 1.5e0 / 3.5e0 / 60) AS BIGINT) AS ride FROM station a, station b WHERE a.station_id <> b.station_id AND {_KM} >= 0.5e0 AND {_KM} < 75e0", "station")
def bike_rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terminals (the stations) from half a kilometre to 75 kilometres apart, and the minutes between them."""
    terminals = view(spark, sf_dir, "station").select(F.col("station_id").alias("terminal"), "lat", "lng")
    return bikes.reachable(terminals, most=75_000.0)


@register("bike_availability_near", "WITH a AS (SELECT terminal, avg(bikes) AS value FROM snapshot GROUP BY terminal) SELECT terminal, round(coalesce(value, 0), 9) AS value FROM (SELECT DISTINCT terminal, 47 + (terminal * 7919 % 8000) / 1e3 AS lat, 6 + (terminal * 104729 % 9000) / 1e3 AS lng FROM snapshot) b JOIN a USING (terminal) WHERE 2 * 6371e0 * asin(sqrt(pow(sin(radians(b.lat - 50e0) / 2), 2) + cos(radians(50e0)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - 10e0) / 2), 2))) <= 80e0", "snapshot")
def bike_availability_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean number of bikes of the terminals within 80 kilometres of a point."""
    s = view(spark, sf_dir, "snapshot")
    places = s.select("terminal", (47 + (F.col("terminal") * 7919 % 8000) / 1e3).alias("lat"), (6 + (F.col("terminal") * 104729 % 9000) / 1e3).alias("lng")).distinct()
    mean = s.groupBy("terminal").agg(F.avg("bikes").alias("average")).withColumn("bucket", F.lit(0))
    return bikes.near(places, mean, 50.0, 10.0, 80_000.0, 0).select("terminal", F.round("value", 9).alias("value"))


@register(
    "station_guess_topk",
    """WITH q AS (SELECT guess, min(c_custkey) AS query_id FROM (SELECT c_custkey, 'Supplier#' || lpad(CAST(c_custkey * 7 % 100 AS VARCHAR), 9, '0') AS guess FROM customer) x GROUP BY guess),
    w AS (SELECT from_station AS station_id, sum(CASE WHEN clasz = 0 THEN 1000 WHEN clasz <= 3 THEN 100 WHEN clasz <= 6 THEN 10 ELSE 1 END) AS weight FROM segment GROUP BY from_station),
    s AS (SELECT station_id, ' ' || lower(trim(name)) || ' ' AS t, 1 + 0.5e0 * weight / (SELECT max(weight) FROM w) AS importance FROM station JOIN w USING (station_id)),
    a AS (SELECT station_id, importance, list_distinct(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))) AS g FROM s),
    b AS (SELECT query_id, list_distinct(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))) AS g FROM (SELECT query_id, ' ' || lower(trim(guess)) || ' ' AS t FROM q) y),
    p AS (SELECT query_id, station_id, importance, CAST(len(list_intersect(a.g, b.g)) AS DOUBLE) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) AS sim FROM a, b),
    r AS (SELECT query_id, station_id, sim * importance AS score, row_number() OVER (PARTITION BY query_id ORDER BY sim * importance DESC, station_id) AS place FROM p WHERE sim >= 0.5)
    SELECT query_id, station_id, round(score, 9) AS score, place FROM r WHERE place <= 8""",
    "station", "segment",
)
def station_guess_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .calls import station_guess_topk as guesses

    return guesses(spark, sf_dir)


@register("repeated_trip_runs", "SELECT trip_id, run, min(dep_min) + run * 30 AS dep_min, count(*) AS n FROM (SELECT *, unnest(range(trip_id % 4 + 1)) AS run FROM trip_stop) x GROUP BY trip_id, run", "trip_stop")
def repeated_trip_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First departure of every repetition of a trip, half an hour apart."""
    rows = services.repeat(view(spark, sf_dir, "trip_stop"), F.col("trip_id") % 4, F.lit(30))
    return rows.groupBy("trip_id", "run").agg(F.min("dep_min").alias("dep_min"), F.count(F.lit(1)).alias("n"))


# --- path store -------------------------------------------------------------------------------


def _trip_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = view(spark, sf_dir, "trip_stop")
    return stops.groupBy("trip_id", "clasz").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "station_id"))), lambda x: x["station_id"]).alias("stations")).filter(F.size("stations") > 1)


def _path_store(spark: SparkSession, sf_dir: str, trips: DataFrame) -> str:
    """A store of the lines of all trips (stations, clasz), straight between stops."""
    stations = view(spark, sf_dir, "station")
    stations = search.small(stations, stations.count())
    sequences = trips.groupBy("stations").agg(F.collect_set("clasz").alias("classes"))
    segments = sequences.select("stations", "classes", F.posexplode(F.slice("stations", F.lit(1), F.size("stations") - 1)).alias("segment", "from_station"))
    at = lambda x: stations.select(F.col("station_id").alias(x), F.struct("lat", "lng").alias(f"{x}_at"))
    lines = segments.withColumn("to_station", F.col("stations")[F.col("segment") + 1]).join(at("from_station"), "from_station").join(at("to_station"), "to_station")
    folder = relational.fresh(spark)
    path_store.write(lines.withColumn("points", F.array("from_station_at", "to_station_at")), folder)
    return folder


@register(
    "path_store_boxes",
    """WITH hop AS (SELECT t.trip_id, t.station_id AS x, lead(t.station_id) OVER w AS y, s.lat, s.lng, lead(s.lat) OVER w AS lat2, lead(s.lng) OVER w AS lng2
        FROM trip_stop t JOIN station s USING (station_id) WINDOW w AS (PARTITION BY t.trip_id ORDER BY t.seq))
    SELECT least(x, y) AS a, greatest(x, y) AS b, min(least(lat, lat2)) AS min_lat, max(greatest(lat, lat2)) AS max_lat, min(least(lng, lng2)) AS min_lng, max(greatest(lng, lng2)) AS max_lng
    FROM hop WHERE y IS NOT NULL GROUP BY 1, 2 HAVING max(greatest(lat, lat2)) >= 49 AND min(least(lat, lat2)) <= 50 AND max(greatest(lng, lng2)) >= 9 AND min(least(lng, lng2)) <= 10""",
    "station", "trip_stop",
)
def path_store_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station pairs whose stored lines meet a map view."""
    return path_store.boxes_in(spark, _path_store(spark, sf_dir, _trip_sequences(spark, sf_dir)), 49.0, 50.0, 9.0, 10.0)


@register(
    "path_store_lookup",
    """SELECT t.trip_id, count(*) - 1 AS n_segments, 2 * (count(*) - 1) AS n_points, min(s.lat) AS south, max(s.lat) AS north, min(s.lng) AS west, max(s.lng) AS east
    FROM trip_stop t JOIN station s USING (station_id) GROUP BY t.trip_id HAVING count(*) > 1""",
    "station", "trip_stop",
)
def path_store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trip's stored lines: segments, points and extent."""
    trips = relational.cut(_trip_sequences(spark, sf_dir))
    found = path_store.lookup_all(trips, _path_store(spark, sf_dir, trips))
    end = lambda f, e, c: f(F.transform("points", lambda p: p[c])).alias(e)
    ends = found.select("trip_id", "segment", F.size("points").alias("n"), end(F.array_min, "south", "lat"), end(F.array_max, "north", "lat"), end(F.array_min, "west", "lng"), end(F.array_max, "east", "lng"))
    return ends.groupBy("trip_id").agg(F.count("segment").alias("n_segments"), F.sum("n").alias("n_points"), F.min("south").alias("south"), F.max("north").alias("north"), F.min("west").alias("west"), F.max("east").alias("east"))
