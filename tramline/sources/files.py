"""Files of any Hadoop file system, and the cache of a loaded schedule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system its path names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, path: str, parse: Callable[[], dict[str, DataFrame]], read: bool = True, write: bool = True) -> dict[str, DataFrame]:
    """Tables of a schedule: from ``path`` if they were written there (and ``read``), else parsed and, if asked, written.

    The list of tables is written last, so a broken write is not taken for a schedule.
    """
    listing = f"{path}/_tables"
    if read and exists(spark, listing):
        return {r["value"]: spark.read.parquet(f"{path}/{r['value']}") for r in spark.read.text(listing).collect()}
    tables = parse()
    if write:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        spark.createDataFrame([(n,) for n in tables], "value string").coalesce(1).write.mode("overwrite").text(listing)
        return {n: spark.read.parquet(f"{path}/{n}") for n in tables}
    return tables
