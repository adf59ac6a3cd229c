"""Closure of a large component: pairs are made where they stay."""

import random

import executions

from tramline.operators import relational


def test_blocks_of_starts_equal_one_task(spark, monkeypatch):
    rnd = random.Random(1)
    rows = [(rnd.randrange(60), rnd.randrange(60), rnd.randrange(9)) for _ in range(90)] + [(100 + k, 101 + k, 2) for k in range(30)] + [(200, 200, 1)]
    edges = spark.createDataFrame(rows, "a long, b long, dur long").selectExpr("CAST(a AS string) AS a", "CAST(b AS string) AS b", "dur")
    want = sorted(map(tuple, relational.closure(edges).collect()))
    monkeypatch.setattr(relational, "STARTS", 7)
    monkeypatch.setattr(relational, "VALUES", 400)
    assert len(want) > 1000 and sorted(map(tuple, relational.closure(edges, 3).collect())) == want


def test_pairs_do_not_travel(spark):
    n = 150
    ring = spark.range(n).selectExpr("id AS a", f"(id + 1) % {n} AS b", "id % 3 AS dur").unionByName(spark.range(n).selectExpr("id AS a", f"id * 7 % {n} AS b", "5L AS dur"))
    found, sent = executions.values(spark, "shuffle records written", lambda: relational.closure(ring, 3).count())
    assert found == n * (n - 1) and n < max(sent) < 10 * n
