"""Mixing sources to target weights with a time-varying curriculum, in DataFrame expressions only.

Targets: each source's share of the budget by weight, at most ``repeat`` times its size, the
excess shared again by weight (water filling, solved by one ordered prefix sum).  Inside a
source documents stand in the order of a hash; a document's copy covers an interval of the
source's words and is taken if its middle lies below the target.  A source's weight schedule,
a multiplier per phase of training, is integrated to its cumulative demand; inverting that at
the copy's first word gives the training position, by which the mix is range-sorted: ``in_order``
for the plan's copies, which the query reads, ``mixed_documents`` for the documents themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, settle, table, words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEAT = 2
#: Weight multipliers per quarter of the training, by the source's base weight.
SCHEDULES = {5: (16, 12, 8, 4), 2: (10, 10, 10, 10), 1: (4, 8, 12, 16)}
SEED = "mix-1"


def _position(x: Column, weight: Column, schedules: dict[int, tuple[int, ...]]) -> Column:
    """Invert the cumulative demand: the training position (0 to 1) at which a share x of a source's target is used."""
    out = F.lit(None).cast("double")
    for w, phases in schedules.items():
        total, done, here = float(sum(phases)), 0, F.lit(None).cast("double")
        branches = []
        for k, m in enumerate(phases):
            lo, hi = done / total, (done + m) / total
            branches.append((hi, (F.lit(float(k)) + (x - F.lit(lo)) / F.lit(hi - lo)) / F.lit(float(len(phases)))))
            done += m
        here = branches[-1][1]
        for hi, value in reversed(branches[:-1]):
            here = F.when(x < F.lit(hi), value).otherwise(here)
        out = F.when(weight == w, here).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target).

    Windows run over one row per source; sources in code-point order, null last, take the weights in turn.
    """
    every = Window.partitionBy(F.lit(1))
    ranked = sizes.withColumn("nth", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.lit(weights[-1])
    for k, v in enumerate(weights[:-1]):
        weight = F.when(F.col("nth") % len(weights) == k, v).otherwise(weight)
    caps = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * repeat).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = every.orderBy("ratio", "nth")
    budget = F.sum("source_size").over(every) * F.lit(share)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    beyond = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = caps.withColumn("level", (budget - before) / beyond)
    level = level.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "nth", "level"))).over(every)["level"])
    return level.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", row_col: str | None = None, source_col: str = "source", text_col: str = "text", weights=WEIGHTS, share: float = SHARE, repeat: int = REPEAT, schedules=None, seed: str = SEED) -> DataFrame:
    """One row per document: row, id, size, source_size, target, taken, and the positions of its taken copies.

    A null text has size 0, a null source is a source of its own, null ids hash alike.  Running
    sums are split into 4096 hash ranges per source, so a source that holds a third of all rows
    is spread over as many tasks.  Only ids, sources and sizes move, never texts.
    """
    schedules = schedules or SCHEDULES
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = docs.select(F.col(row_col or id_col).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"), key.alias("key"))
    rows = settle(rows.withColumn("bucket", F.substring("key", 1, 3)), "mix-sizes")
    ranges = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, repeat)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranges.withColumn("shift", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    shifts = shifts.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select(F.col("r.source").alias("s"), F.col("bucket").alias("b"), "shift", "source_size", "weight", "target")
    here = Window.partitionBy("source", "bucket").orderBy("key", "id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(here), F.lit(0)))
    placed = placed.join(shifts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    start = lambda e: F.lit(e) * F.col("source_size") + F.col("shift") + F.col("inner")
    takes = lambda e: (F.col("size") > 0) & (start(e) * 2 + F.col("size") <= F.col("target") * 2)
    copies = [F.when(takes(e), _position(start(e) / F.col("target"), F.col("weight"), schedules)) for e in range(repeat)]
    taken = sum((F.when(takes(e), F.col("size")).otherwise(F.lit(0)) for e in range(1, repeat)), F.when(takes(0), F.col("size")).otherwise(F.lit(0)))
    return placed.select("row", "id", "size", "source_size", "target", taken.cast("long").alias("taken"), F.filter(F.array(*copies), lambda p: p.isNotNull()).alias("positions"))


def in_order(plan: DataFrame) -> DataFrame:
    """``mix``'s rows, one per taken copy, range-sorted by its training position, ties by id; ``copy`` counts from 0.

    Documents that are not taken stand behind, one row each without a position.
    """
    copies = plan.select("*", F.posexplode_outer("positions").alias("copy", "position")).drop("positions")
    last = F.col("position").asc_nulls_last()
    return copies.repartitionByRange(last, "id").sortWithinPartitions(last, "id", "copy")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: a row of ``docs`` per taken copy, range-sorted by training position.

    Columns may have any names.  Null texts and texts without words are never taken.  Where ids are null or
    repeat, rows get numbers of their own first (written once to the shared folder), so each
    row is taken as often as planned for it; ties of positions go by id.
    """
    number, position, many, key = fresh(docs, "row", "position", "positions", "key")
    ids = docs.select(F.col(id_col).alias("id"))
    loose = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR id IS NULL").limit(1).count()
    rows, by = docs, id_col
    if loose:
        rows, by = settle(docs.withColumn(number, F.monotonically_increasing_id()), "mix-rows"), number
    plan = mix(rows, id_col=id_col, row_col=by, **options).filter(F.size("positions") > 0).select(F.col("row").alias(key), F.col("positions").alias(many))
    rows = rows.join(plan, F.col(by) == F.col(key))
    return rows.withColumn(position, F.explode(many)).repartitionByRange(position, id_col).sortWithinPartitions(position, id_col).select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document and the training position of its first copy, in the order of the mix."""
    m = in_order(mix(table(spark, sf_dir, "documents"))).filter("coalesce(copy, 0) = 0")
    return m.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "position")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
w AS (SELECT *, CASE nth % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2 AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - coalesce(CAST(sum(cap) OVER (ORDER BY ratio, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
       / CAST(sum(weight) OVER (ORDER BY ratio, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM r),
f AS (SELECT level AS water FROM l WHERE ratio >= level ORDER BY ratio, nth LIMIT 1),
t AS (SELECT source, source_size, weight, least(CAST(cap AS DOUBLE), water * weight) AS target FROM l, f),
p AS (SELECT d.*, t.source_size, t.weight, t.target,
        CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, size > 0 AND start * 2 + size <= target * 2 AS one, size > 0 AND (source_size + start) * 2 + size <= target * 2 AS two,
        CASE WHEN target > 0 THEN start / target END AS x FROM p),
q AS (SELECT *, CASE weight
   WHEN 5 THEN CASE WHEN x < 16/4e1 THEN (0e0 + (x - 0e0) / (16/4e1 - 0e0)) / 4e0 WHEN x < 28/4e1 THEN (1e0 + (x - 16/4e1) / (28/4e1 - 16/4e1)) / 4e0
                    WHEN x < 36/4e1 THEN (2e0 + (x - 28/4e1) / (36/4e1 - 28/4e1)) / 4e0 ELSE (3e0 + (x - 36/4e1) / (1e0 - 36/4e1)) / 4e0 END
   WHEN 2 THEN CASE WHEN x < 1/4e0 THEN (0e0 + (x - 0e0) / (1/4e0)) / 4e0 WHEN x < 2/4e0 THEN (1e0 + (x - 1/4e0) / (1/4e0)) / 4e0
                    WHEN x < 3/4e0 THEN (2e0 + (x - 2/4e0) / (1/4e0)) / 4e0 ELSE (3e0 + (x - 3/4e0) / (1/4e0)) / 4e0 END
   ELSE CASE WHEN x < 4/4e1 THEN (0e0 + (x - 0e0) / (4/4e1 - 0e0)) / 4e0 WHEN x < 12/4e1 THEN (1e0 + (x - 4/4e1) / (12/4e1 - 4/4e1)) / 4e0
             WHEN x < 24/4e1 THEN (2e0 + (x - 12/4e1) / (24/4e1 - 12/4e1)) / 4e0 ELSE (3e0 + (x - 24/4e1) / (1e0 - 24/4e1)) / 4e0 END END AS place FROM c)
SELECT doc_id, size, source_size, target, CAST((CASE WHEN one THEN size ELSE 0 END) + (CASE WHEN two THEN size ELSE 0 END) AS BIGINT) AS taken,
       CASE WHEN one THEN place END AS position FROM q
"""
