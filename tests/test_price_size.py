"""The search by price: a departure is boarded once however many labels wait for it."""

import executions

from tramline.operators import pareto
from tramline.operators.search import CONN

LABELS, TRAINS = 100, 200


def test_departures_are_boarded_once(spark):
    there = [(0, k, 0, 1, 2, 500 + k, 510 + k, True, True, 1000 - k) for k in range(LABELS)]  # later ones are cheaper
    on = [(0, LABELS + k, 0, 2, 3, 505 + k, 515 + k, True, True, 1) for k in range(TRAINS)]
    conn = spark.createDataFrame(there + on, ", ".join(f"{c} {'boolean' if c.endswith('allowed') else 'long'}" for c in [*CONN, "fare"]))
    foot = spark.createDataFrame([(k, k, 2) for k in (1, 2, 3)], "a long, b long, dur long")
    starts = spark.createDataFrame([(1, 480)], "start long, t0 long")
    run = lambda: [(r.station, r.arr, r.legs, r.price) for r in pareto.pareto_search(conn, foot, starts, pareto.SEARCHES["price"]).collect()]
    got, rows = executions.values(spark, "number of output rows", run)
    want, least = [(2, 510 + k, 1, 1000 - k) for k in range(LABELS)], 1 << 20
    for dep in range(505, 505 + TRAINS):
        ready = [1000 - k for k in range(LABELS) if 512 + k <= dep]
        if ready and 1 + min(ready) < least:
            least = 1 + min(ready)
            want.append((3, dep + 10, 2, least))
    assert sorted(got) == sorted(want)
    assert TRAINS <= max(rows) < 3 * (LABELS + TRAINS)  # labels that meet all later trains are 14,350 pairs
