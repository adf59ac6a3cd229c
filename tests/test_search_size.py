"""Searches over one large group of stations: rows in proportion to stations and connections, results as the SQL says."""

import duckdb
import pytest

from tramline import catalog, searches  # noqa: F401
from tramline.plans import timetable

STATIONS, TRIPS = 600, 400
NAMES = ["latest_departure_bwd", "earliest_arrival_k2", "earliest_arrival_k7", "single_criterion_weighted", "journey_interchanges", "journeys"]
ROUNDS = NAMES


@pytest.fixture(scope="module")
def one_group(tmp_path_factory):
    """Stations of one nation but for two without any; every tenth trip begins or ends at station 1."""
    path = tmp_path_factory.mktemp("group")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT s AS s_suppkey, 'Supplier#' || s AS s_name, CASE WHEN s % 299 <> 4 THEN 3 END::INT AS s_nationkey FROM range({STATIONS}) t(s)) TO '{path}/supplier.parquet'")
    stop = f"CASE WHEN n = 1 AND o % 10 = 0 OR n = 4 AND o % 10 = 5 THEN 1 ELSE (o * 7 + n * 131) % {STATIONS} END"
    con.execute(f"COPY (SELECT o AS l_orderkey, (o * 11 + n * 17) % 1000 AS l_partkey, {stop} AS l_suppkey, n::INT AS l_linenumber, DATE '2024-01-01' AS l_shipdate, 1.0::DOUBLE AS l_extendedprice FROM range({TRIPS}) t(o), range(1, 5) u(n)) TO '{path}/lineitem.parquet'")
    return str(path)


def _most_rows(spark, run) -> tuple[list, int]:
    """What ``run`` returns, and the most rows that one step of its jobs put out."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    done = store.executionsCount()
    out = run()
    bus.waitUntilEmpty()
    jobs, most = store.executionsList(done, 1000), 0
    for k in range(jobs.size()):
        steps, values = jobs.apply(k).metrics(), store.executionMetrics(jobs.apply(k).executionId())
        for m in map(steps.apply, range(steps.size())):
            value = values.get(m.accumulatorId())
            if m.name() == "number of output rows" and value.isDefined():
                most = max(most, int(value.get().replace(",", "")))
    return out, most


@pytest.mark.parametrize("name", NAMES)
def test_no_step_makes_pairs_of_stations(spark, one_group, name):
    con = duckdb.connect()
    for t in ("supplier", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{one_group}/{t}.parquet'")
    want = con.execute(catalog.ORACLE[name]).fetchall()
    got, most = _most_rows(spark, lambda: [tuple(r) for r in catalog.QUERIES[name](spark, one_group).collect()])
    assert len(want) > STATIONS / 2 and sorted(got) == sorted(want)
    assert STATIONS <= most < 10 * (STATIONS + TRIPS * 4)  # all pairs are 360,000


def _plans(spark, run) -> list[list[str]]:
    """The names of the plan nodes of each job that ``run`` makes, as they were run."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    done = store.executionsCount()
    run()
    bus.waitUntilEmpty()
    jobs = store.executionsList(done, 1000)
    graphs = [store.planGraph(jobs.apply(k).executionId()).allNodes() for k in range(jobs.size())]
    return [[g.apply(k).name().strip() for k in range(g.size())] for g in graphs]


def test_stops_are_dealt_once(spark, one_group):
    plan = timetable.conn_between(spark, one_group, 480, 1920)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 2 and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ROUNDS)
def test_a_round_reads_connections_twice(spark, one_group, name):
    plans = _plans(spark, lambda: catalog.QUERIES[name](spark, one_group).collect())
    reads = [n for n in (sum("tramline_" in node for node in p) for p in plans) if n]
    assert len(reads) >= 2 and set(reads) == {2}  # trips are boarded and ridden
