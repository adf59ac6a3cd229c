"""Delay distributions that follow a stream of measured departures: the state is a written version per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reliability import timetable_distributions, update_distributions

_PARTS = ("departures", "arrivals", "measured")


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions that are whole: the last part is written last."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(root)):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(path(root))]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(path(f"{root}/{n}/{_PARTS[-1]}/_SUCCESS")))


def _write(root: str, version: int, tables: tuple[DataFrame, ...]) -> None:
    for name, df in zip(_PARTS, tables, strict=True):
        df.write.mode("overwrite").parquet(f"{root}/v={version}/{name}")


def state(spark: SparkSession, root: str, below: int | None = None) -> tuple[DataFrame, ...]:
    """(departures, arrivals, measured) of the newest whole version, or of the newest below a number."""
    version = [v for v in _versions(spark, root) if below is None or v < below][-1]
    return tuple(spark.read.parquet(f"{root}/v={version}/{name}") for name in _PARTS)


def begin(spark: SparkSession, root: str, conn: DataFrame, start: DataFrame, travel: DataFrame, feeding: DataFrame) -> None:
    """The first version: the whole timetable without measurements."""
    deps, arrs = timetable_distributions(conn, start, travel, feeding)
    none = conn.limit(0).select("key", F.lit(0).cast("long").alias("is_delay"))
    _write(root, -1, (deps, arrs, none))


def follow(measured: DataFrame, root: str, checkpoint: str, conn: DataFrame, start: DataFrame, travel: DataFrame, feeding: DataFrame, least: float = 0.001) -> None:
    """Take all available measurements (key, is_delay) of a stream into the state, a version per batch.

    A batch reads the newest version below its number, so one that is repeated after a failure gives the same version again.  Of
    several measurements of a section in a batch the latest minute counts, of several batches the last.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        deps, arrs, known = state(spark, root, number)
        new = batch.groupBy("key").agg(F.max("is_delay").alias("is_delay"))
        every = known.join(new, "key", "left_anti").unionByName(new)
        out = update_distributions(conn, start, travel, feeding, deps, arrs, new, every, least)
        _write(root, number, (out[0], out[1], every))

    query = measured.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
