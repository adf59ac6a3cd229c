"""Helpers Spark has no operator for: as-of and radius joins, skylines, islands, closure."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from operator import le

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Kilometres per degree of latitude.
KM_PER_DEGREE = 111.0
#: Blocks that the points of a grid cell are dealt into.
BLOCKS = 16


#: Tables that this session wrote lie in a folder of its own.
_SESSION = uuid.uuid4().hex


def _folder(spark: SparkSession) -> str:
    """This session's folder below spark.checkpoint.dir, which all executors share; a temporary one where none is set (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = tempfile.mkdtemp(prefix="tramline-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tramline-{_SESSION}"


def fresh(spark: SparkSession) -> str:
    """A new folder's name below the session's."""
    return f"{_folder(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back: lineage ends, sizes are known, later steps read the columns they need."""
    spark = df.sparkSession
    path = fresh(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` cut into files by a hash of ``by``: later joins and groups on those columns leave its rows where they lie."""
    spark = df.sparkSession
    name, n = f"tramline_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, *by).write.option("path", fresh(spark)).bucketBy(n, *by).saveAsTable(name)
    return spark.table(name).select(*df.columns)


class Tables:
    """A table that grows by parts, each written once; with ``by`` the parts are dealt into folders by a column's value."""

    def __init__(self, spark: SparkSession, by: str | None = None) -> None:
        self.spark, self.by, self.root, self.parts = spark, by, fresh(spark), 0

    def add(self, df: DataFrame) -> bool:
        """Write a part; whether it has rows."""
        path = f"{self.root}/part={self.parts}"
        self.parts += 1
        if self.by:
            df.write.partitionBy(self.by).parquet(path)
            return True
        df.write.parquet(path)
        return not self.spark.read.schema(df.schema).parquet(path).isEmpty()

    def read(self, schema, value: int | None = None) -> DataFrame:
        """All parts, or the rows of one value of ``by`` (without it); other folders are not opened."""
        names = [f"{self.root}/part={k}" + (f"/{self.by}={value}" if value is not None else "") for k in range(self.parts)]
        if value is not None:
            path = self.spark._jvm.org.apache.hadoop.fs.Path
            fs = path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            names = [n for n in names if fs.exists(path(n))]
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*names)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this session has cut, once no result that reads them is needed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def asof(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, backward: bool = False, limit: int | None = None, bucket: int = 1440) -> DataFrame:
    """For each left row the smallest right ``value`` >= ``at`` (or largest <=) within ``by``, at most ``limit`` away.

    Both sides are one union, ordered inside (by, bucket of the value), so a left row travels once
    and carries all its columns; a key's day is spread over its buckets.  Where a bucket has none, the
    extreme of the next (last) bucket that has one follows, found over one row per bucket.
    """
    b = lambda c: F.floor(F.col(c) / F.lit(bucket)).cast("long")
    row, v, k, hit, far = "_row", "_v", "_b", "_hit", "_far"
    mine = left.select(*by, b(at).alias(k), F.col(at).cast("long").alias(v), F.struct(*left.columns).alias(row))
    other = right.filter(F.col(value).isNotNull()).select(*by, b(value).alias(k), F.col(value).cast("long").alias(v))
    both = mine.unionByName(other, allowMissingColumns=True)
    seen = F.when(F.col(row).isNull(), F.col(v))
    # of equal values the right ones come first in the direction of the look
    order = [F.col(v).asc() if backward else F.col(v).desc(), F.col(row).isNull().desc()]
    w = Window.partitionBy(*by, k).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn(hit, F.last(seen, ignorenulls=True).over(w)).filter(F.col(row).isNotNull())
    pick = F.max if backward else F.min
    ends = other.groupBy(*by, k).agg(pick(v).alias(far))
    marks = ends.unionByName(mine.select(*by, k).distinct(), allowMissingColumns=True).groupBy(*by, k).agg(F.max(far).alias(far))
    near = Window.partitionBy(*by).orderBy(F.col(k).asc() if backward else F.col(k).desc()).rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.select(*by, k, F.last(far, ignorenulls=True).over(near).alias(far))
    out = rows.join(marks, [*by, k], "left").withColumn(v, F.coalesce(hit, far))
    if limit is not None:
        out = out.withColumn(v, F.when(F.abs(F.col(v) - F.col(f"{row}.{at}")) <= limit, F.col(v)))
    return out.select(f"{row}.*", F.col(v).alias(f"{value}_asof"))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = EARTH_KM) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(a))


def radius_join(points: DataFrame, places: DataFrame, km: float, min_km: float = 0.0, by: list[str] = ()) -> DataFrame:
    """Pairs of a point (lat, lng) and a place (plat, plng) from ``min_km`` to ``km`` apart with equal ``by``, by grid cells.

    A cell is as high as the radius; a place is entered in its own cell, a point looks in the
    neighbouring rows and in as many columns as the radius spans at its latitude.
    """
    cell = km / KM_PER_DEGREE
    row, col = lambda c: F.floor(F.col(c) / F.lit(cell)).cast("long"), lambda c: F.floor(F.col(c) / F.lit(cell)).cast("long")
    span = F.least(F.ceil(F.lit(1.05) / F.greatest(F.cos(F.radians("lat")), F.lit(0.02))).cast("long"), F.lit(60))
    # a cell's points are dealt into blocks, so that a full cell is many tasks' work; places go to each block
    n, key = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*by, "_r", "_c", "_b"]
    points = points.withColumn("_b", F.pmod(F.xxhash64("lat", "lng"), F.lit(BLOCKS)))
    places = places.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long"))))
    seen = points.withColumn("_r", F.explode(F.sequence(row("lat") - 1, row("lat") + 1))).withColumn("_c", F.explode(F.sequence(col("lng") - span, col("lng") + span)))
    near = seen.repartition(n, *key).hint("merge").join(places.withColumn("_r", row("plat")).withColumn("_c", col("plng")).repartition(n, *key), key).drop("_r", "_c", "_b")
    near = near.filter(F.abs(F.col("lat") - F.col("plat")) <= cell)  # no degree of latitude is shorter
    near = near.withColumn("km", haversine_km(F.col("lat"), F.col("lng"), F.col("plat"), F.col("plng")))
    return near.filter((F.col("km") <= km) & (F.col("km") >= min_km))


class _Kept:
    """Undominated values of one group so far, in the order they came; many are compared at once."""

    def __init__(self) -> None:
        self.few: list[tuple] = []
        self.many: np.ndarray | None = None

    def beats(self, v: tuple) -> bool:
        if any(all(map(le, a, v)) and a != v for a in self.few):
            return True
        if self.many is None:
            return False
        no_worse = self.many[(self.many <= np.array(v)).all(1)]
        return bool(len(no_worse)) and bool((no_worse != np.array(v)).any(1).any())

    def add(self, v: tuple) -> None:
        if v in self.few[-1:]:
            return
        self.few.append(v)
        if len(self.few) >= 64:
            block = np.array(self.few)
            self.many = block if self.many is None else np.concatenate((self.many, block))
            self.few = []


def skyline(rows: DataFrame, by: list[str], less: list[str | Column], more: list[str | Column] = ()) -> DataFrame:
    """Rows of each group that no other row dominates (no worse in every criterion, better in one); equal rows all stay.

    Criteria are numbers; rows with a null one stay and dominate none.  Rows are sorted by group and criteria, so
    only earlier ones can dominate; a task holds a group's undominated values and never the group, and rows are
    filtered where they lie before those left are dealt by group.
    """
    crit = [F.col(c) if isinstance(c, str) else c for c in less] + [-(F.col(c) if isinstance(c, str) else c) for c in more]
    names = [f"_c{k}" for k in range(len(crit))]
    wide = rows.withColumns(dict(zip(names, crit, strict=True)))
    keys = [wide.columns.index(c) for c in by]
    at = len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kept = None, _Kept()
        for b in batches:
            values = zip(*(b.column(at + k).to_pylist() for k in range(len(names))), strict=True)
            groups = zip(*(b.column(k).to_pylist() for k in keys), strict=True) if keys else ((),) * b.num_rows
            stays = []
            for g, v in zip(groups, values, strict=True):
                if g != group:
                    group, kept = g, _Kept()
                if None in v:
                    stays.append(True)
                elif kept.beats(v):
                    stays.append(False)
                else:
                    stays.append(True)
                    kept.add(v)
            yield b.filter(pa.array(stays, pa.bool_()))

    once = wide.sortWithinPartitions(*by, *names).mapInArrow(run, wide.schema)
    dealt = once.repartition(*by) if by else once.coalesce(1)
    return dealt.sortWithinPartitions(*by, *names).mapInArrow(run, wide.schema).select(*rows.columns)


def islands(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Maximal runs of consecutive ``order`` values per group: (by, first, last)."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.select(*by, order, (F.col(order) - F.row_number().over(w)).alias("_run")).groupBy(*by, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last")).drop("_run")


#: Nodes of a component whose closure is made in one task; in larger ones starts are dealt into blocks of about so many,
#: at most so many blocks a shuffle partition, and a task holds at most about so many values at once.
IN_ONE_TASK, STARTS, BLOCKS_A_TASK, VALUES = 2_000, 1_024, 2, 4_000_000


def closure(edges: DataFrame, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """Min-plus closure of (a, b, dur): least durations over any number of edges, between different nodes.

    Durations must not be negative.  Components are found first.  Those of at most ``in_one_task`` nodes, a matrix of
    known size, are closed by relaxation over each node in a task of their own.  In larger ones the pairs, which may be the
    square of the nodes, are made where they stay: a block of starts gets a copy of the component's edges and follows them, some
    starts at once, until nothing improves.
    """
    best = cut(edges.filter("a <> b").groupBy("a", "b").agg(F.min("dur").alias("dur")))
    label = cut(connected(best).select(F.col("node").alias("a"), "component"))
    big = cut(label.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > in_one_task).select("component"))
    rows = best.join(label, "a")
    few = rows.join(big, "component", "left_anti")
    kinds = best.schema

    def relax(pdf: pd.DataFrame) -> pd.DataFrame:
        names = pd.unique(pd.concat([pdf["a"], pdf["b"]], ignore_index=True))
        at = {x: k for k, x in enumerate(names)}
        d = np.full((len(names), len(names)), np.inf)
        d[pdf["a"].map(at).to_numpy(), pdf["b"].map(at).to_numpy()] = pdf["dur"].to_numpy()
        for k in range(len(names)):
            np.minimum(d, d[:, k, None] + d[k], out=d)
        np.fill_diagonal(d, np.inf)
        i, j = np.nonzero(np.isfinite(d))
        return pd.DataFrame({"a": names[i], "b": names[j], "dur": d[i, j].astype(pdf["dur"].dtype)})

    out = few.groupBy("component").applyInPandas(relax, kinds)
    if big.isEmpty():
        return out
    most = BLOCKS_A_TASK * int(best.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.least(F.ceil(F.col("n") / STARTS), F.lit(most)).alias("blocks")
    wide = cut(rows.join(label.groupBy("component").agg(F.count(F.lit(1)).alias("n")).join(big, "component").select("component", blocks), "component"))
    copies = wide.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("component", "block", "a", "b", "dur", F.lit(False).alias("start"))
    starts = wide.select("component", F.pmod(F.xxhash64("a"), F.col("blocks")).alias("block"), "a", F.col("a").alias("b"), F.lit(0).cast(kinds["dur"].dataType).alias("dur"), F.lit(True).alias("start")).distinct()
    return out.unionByName(copies.unionByName(starts).repartition(most, "component", "block").groupBy("component", "block").applyInArrow(_follow, kinds))


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, dur): least durations from the starts of a block; rows of its edges, and of its starts, come in."""
    a, b, dur, start = (np.concatenate(x) for x in zip(*([r.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "dur", "start")] for r in batches), strict=True))
    at, names = pd.factorize(np.concatenate((a, b)))
    a, b, nodes = at[: len(a)], at[len(a) :], len(names)
    own, kept = a[start], np.flatnonzero(~start)
    kept = kept[np.argsort(b[kept], kind="stable")]
    a, b, dur = a[kept], b[kept], dur[kept]
    names, kind = pa.array(names), dur.dtype
    if kind.kind == "i" and nodes * int(dur.max(initial=0)) < 1 << 29:
        dur = dur.astype(np.int32)
    never = np.inf if dur.dtype.kind == "f" else np.iinfo(dur.dtype).max // 2
    n = max(1, VALUES // (nodes + len(a)))
    for k in range(0, len(own), n):
        some = own[k : k + n]
        least = np.full((nodes, len(some)), never, dur.dtype)
        least[some, np.arange(len(some))] = 0
        fresh = np.zeros(nodes, bool)
        fresh[some] = True
        while len(rows := np.flatnonzero(fresh[a])):
            first = np.flatnonzero(np.diff(b[rows], prepend=-1))  # edges lie by their end
            come = least.take(a[rows], 0)
            come += dur[rows, None]
            come = np.minimum.reduceat(come, first, 0)
            to = b[rows[first]]
            before = least.take(to, 0)
            better = (come < before).any(1)
            least[to[better]] = np.minimum(come[better], before[better])
            fresh[:] = False
            fresh[to[better]] = True
        least[some, np.arange(len(some))] = never  # a node and itself are no pair
        rows, end = np.nonzero(least.T < never)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(some[rows])), names.take(pa.array(end)), pa.array(least[end, rows].astype(kind))], names=["a", "b", "dur"])


def profile_skyline(rows: DataFrame, by: list[str], low: str, few: str, high: str, most: int) -> DataFrame:
    """Rows that no other of their group beats: ``low`` and ``few`` no larger, ``high`` no smaller, one of them better.

    ``few`` has the values 0 to ``most``.  One sort per group by ``high``: running minima of ``low``, one per value of ``few``,
    say what earlier rows offer, so no rows are compared in pairs.
    """
    order = Window.partitionBy(*by).orderBy(F.desc(high))
    upto, above = order.rangeBetween(Window.unboundedPreceding, 0), order.rangeBetween(Window.unboundedPreceding, -1)
    least = lambda w, k: F.min(F.when(F.col(few) <= k, F.col(low))).over(w)
    pick = lambda cs, at: F.get(F.array(*cs), at)
    here, before = [least(upto, k) for k in range(most + 1)], [least(above, k) for k in range(most + 1)]
    n = F.col(few).cast("int")
    beaten = (pick(here, n) < F.col(low)) | (F.coalesce(pick(here, n - 1), F.col(low) + 1) <= F.col(low)) | (F.coalesce(pick(before, n), F.col(low) + 1) <= F.col(low))
    return rows.withColumn("_beaten", F.coalesce(beaten, F.lit(False))).filter("NOT _beaten").drop("_beaten")


def connected(edges: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, node, component): the smallest node reachable over (by, a, b) edges, both ways.

    Each round merges every node into that of the smallest hash among its neighbours and itself, so the links shrink by
    a factor and components that are done leave; hashes differ by round, so long chains shrink alike.  The
    least node goes with the merged ones, and a table per round leads every node to it at the end.
    """
    by = list(by)
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("_e")
    # dealt by one end, so that the round's groups are made where links lie
    deal = lambda rows: rows.repartition(*by, "a").distinct()
    links = cut(deal(edges.select(*by, ways).select(*by, "_e.*")))
    least, merges = None, []
    while not merges or not links.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(merges)), c).alias("hash"), F.col(c).alias("node"))
        to = links.groupBy(*by, "a").agg(F.min(rank("b")).alias("_m")).select(*by, "a", F.least("_m", rank("a"))["node"].alias("to"))
        to = cut(to.withColumn("least", F.col("a")) if least is None else to.join(least.withColumnRenamed("to", "a"), [*by, "a"]))
        merges.append(to)
        least = to.groupBy(*by, "to").agg(F.min("least").alias("least"))
        ends = to.select(*by, "a", "to")
        half = links.filter("a <> b").join(ends, [*by, "a"]).select(*by, F.col("b").alias("a"), F.col("to").alias("b"))
        links = cut(deal(half.join(ends, [*by, "a"]).filter("to <> b").select(*by, F.col("to").alias("a"), "b")))
    out = merges[-1].select(*by, F.col("a").alias("node"), "to").join(least, [*by, "to"]).select(*by, "node", F.col("least").alias("component"))
    for to in reversed(merges[:-1]):  # nodes without links in the next round are done: theirs is the least of those merged
        done = to.groupBy(*by, "to").agg(F.min("least").alias("least"))
        onto = done.join(out.withColumnRenamed("node", "to"), [*by, "to"], "left").select(*by, "to", F.coalesce("component", "least").alias("component"))
        out = to.select(*by, F.col("a").alias("node"), "to").join(onto, [*by, "to"]).select(*by, "node", "component")
    return cut(out)
