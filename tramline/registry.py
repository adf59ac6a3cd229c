"""The registry of queries and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans.timetable import view, with_views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str, *views: str):
    """Register a DataFrame query and its SQL twin over the named views."""

    def add(f):
        QUERIES[name] = f
        ORACLE[name] = with_views(sql, *views) if views else sql
        return f

    return add


def sql_query(name: str, text: str, *views: str, tables: tuple[str, ...] = (), duck: str | None = None) -> None:
    """Register a query whose Spark form is SQL as well; names in braces are inputs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        inputs = {v: view(spark, sf_dir, v) for v in views} | {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
        return spark.sql(text, **inputs)

    QUERIES[name] = run
    plain = (duck or text).replace("{", "").replace("}", "")
    ORACLE[name] = with_views(plain, *views) if views else plain
