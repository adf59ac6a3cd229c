"""Delay distributions: four files with semicolons, mapping ranges, and hotels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest expected travel time and departure delay, in minutes.
MOST_TRAVEL, MOST_DELAY = 1440, 120


def _read(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    return spark.read.option("header", True).option("sep", sep).csv(path)


def _number(c: str) -> Column:
    return F.when(F.col(c).rlike("^ *-?[0-9]+ *$"), F.trim(c).cast("long"))


def classes(spark: SparkSession, path: str) -> DataFrame:
    """(category, clasz) from Zuggattung and Zuggattungsklasse."""
    return _read(spark, path).select(F.trim("Zuggattung").alias("category"), F.trim("Zuggattungsklasse").alias("clasz"))


def distributions(spark: SparkSession, path: str) -> DataFrame:
    """(dist_id, minute, p): probability of each deviation from the travel time."""
    return _read(spark, path).select(_number("KLASSEN_ID").alias("dist_id"), _number("verspaetungsDelta").alias("minute"), F.col("p_Verspaetungsdelta").cast("double").alias("p"))


def mapping(spark: SparkSession, path: str, most_travel: int = MOST_TRAVEL, most_delay: int = MOST_DELAY) -> DataFrame:
    """(clasz, first_travel, last_travel, first_delay, last_delay, dist_id), both ends included.

    Travel times are left-open intervals, delays right-open ones; an end that is no number, or beyond
    the largest expected, is that one; intervals without a begin or that end before it are dropped.
    """
    low, high = _number("VORSCHAUZEITKLASSE_VON"), _number("VORSCHAUZEITKLASSE_BIS")
    d_low, d_high = _number("AKTUELLEVERSPAETUNGSLAGE_VON"), _number("AKTUELLEVERSPAETUNGSLAGE_BIS")
    rows = _read(spark, path).select(
        F.trim("ZUGGATTUNGSKLASSE").alias("clasz"), F.greatest(low + 1, F.lit(0)).alias("first_travel"), F.least(F.coalesce(high, F.lit(most_travel)), F.lit(most_travel)).alias("last_travel"),
        F.greatest(d_low, F.lit(0)).alias("first_delay"), F.when(d_high.isNull() | (d_high > most_delay), most_delay).otherwise(d_high - 1).alias("last_delay"), low.alias("_low"), d_low.alias("_d"), _number("KLASSEN_ID").alias("dist_id"),
    )
    return rows.filter("_low IS NOT NULL AND _d IS NOT NULL AND last_travel >= 0 AND last_delay >= 0 AND first_travel <= last_travel AND first_delay <= last_delay").drop("_low", "_d")


def start_distributions(spark: SparkSession, path: str) -> DataFrame:
    """(clasz, minute, p): delay of the first departure; trains that leave early count as on time."""
    rows = _read(spark, path).select(F.trim("Zuggattungsklasse").alias("clasz"), F.greatest(_number("Startverspaetung"), F.lit(0)).alias("minute"), F.col("p_startverspaetung").cast("double").alias("p"))
    return rows.groupBy("clasz", "minute").agg(F.sum("p").alias("p"))


def hotels(spark: SparkSession, path: str, cents: int = 5000, least: int = 360, checkout: int = 420) -> DataFrame:
    """Extra edges (a, b, dur, price_of_edge, is_hotel, checkout, least): a stay at each station that has a hotel."""
    rows = _read(spark, path, ",").select(_number("station_eva").alias("a")).filter("a IS NOT NULL").distinct()
    return rows.select("a", F.col("a").alias("b"), F.lit(least).cast("long").alias("dur"), F.lit(cents).cast("long").alias("price_of_edge"), F.lit(True).alias("is_hotel"), F.lit(checkout).alias("checkout"), F.lit(least).alias("least"))
