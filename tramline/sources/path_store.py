"""Path store: prepared lines of station sequences as Parquet, with an index of sequences and boxes of station pairs.

``sequences`` lies in ranges of a hash of the sequence, ``index`` in ranges of a hash of (stations, class), ``boxes`` along a
space-filling curve through the boxes' middles.  So the smallest and largest values that Parquet keeps of each file and row
group rule out nearly all of them for a sequence or a map view; the filters themselves are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.paths import boxes as pair_boxes

#: Bits of each coordinate in a place on the curve.
BITS = 20
_MASKS = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _spread(x: Column) -> Column:
    """The bits of ``x`` with a zero bit before each."""
    for shift, mask in _MASKS:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def curve(lat: Column, lng: Column) -> Column:
    """Place on the curve that takes the bits of both coordinates in turn; coordinates off the map count as its border."""
    cell = lambda x, low, width: F.least(F.greatest(F.floor((x - low) / width * 2**BITS), F.lit(0)), F.lit(2**BITS - 1)).cast("long")
    return F.shiftleft(_spread(cell(lat, -90.0, 180.0)), 1).bitwiseOR(_spread(cell(lng, -180.0, 360.0)))


def _dealt(rows: DataFrame, by: list[str], files: int | None) -> DataFrame:
    """``rows`` in ranges of ``by``: groups whose keys begin with it are made where the rows lie then."""
    return rows.repartitionByRange(files, *by) if files else rows.repartitionByRange(*by)


def _write(dealt: DataFrame, path: str, order: list[str], block: int) -> None:
    dealt.sortWithinPartitions(*order).write.option("parquet.block.size", block).parquet(path)


def write(paths: DataFrame, folder: str, files: int | None = None, block: int = 16 << 20) -> None:
    """Write ``paths`` (stations array, classes array, segment, points) below a new folder.

    A segment that comes more than once is kept once, with the smallest points.  Where two sequences have the same stations
    and share a class, the class belongs to the one with the smaller hash.  Segments without points are stored without; a
    station pair with no points at all has no box.  Null stations or classes are left out, other columns too.  An
    existing folder is an error, so readers never meet two stores in one.
    """
    rows = paths.filter(F.col("stations").isNotNull() & F.col("classes").isNotNull() & F.col("segment").isNotNull())
    rows = rows.withColumn("classes", F.array_sort(F.array_distinct("classes"))).withColumn("sequence", F.xxhash64("stations", "classes"))
    kept = _dealt(rows.select("sequence", "stations", "classes", "segment", "points"), ["sequence"], files)
    kept = kept.groupBy("sequence", "stations", "classes", "segment").agg(F.min("points").alias("points"))
    nth = F.row_number().over(Window.partitionBy("sequence", "stations", "classes").orderBy("segment"))
    _write(kept.withColumn("head", nth == 1), f"{folder}/sequences", ["sequence", "stations", "classes", "segment"], block)
    stored = read(paths.sparkSession, folder, "sequences")
    entries = stored.filter("head").select("sequence", "stations", F.explode("classes").alias("clasz")).withColumn("key", F.xxhash64("stations", "clasz"))
    entries = _dealt(entries, ["key"], files).groupBy("key", "stations", "clasz").agg(F.min("sequence").alias("sequence"))
    _write(entries, f"{folder}/index", ["key"], block)
    places = pair_boxes(stored.select("stations", "segment", "points")).filter(F.col("min_lat").isNotNull() & F.col("min_lng").isNotNull())
    middle = curve((F.col("min_lat") + F.col("max_lat")) / 2, (F.col("min_lng") + F.col("max_lng")) / 2)
    _write(_dealt(places.withColumn("place", middle), ["place", "a", "b"], files), f"{folder}/boxes", ["place", "a", "b"], block)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One of the store's tables: sequences (``head`` marks a sequence's first segment), index or boxes."""
    return spark.read.parquet(f"{folder}/{table}")


def lookup(spark: SparkSession, folder: str, stations: list, clasz: int) -> DataFrame:
    """(segment, points) of one station sequence and class; no rows where it is not stored.

    Both filters are plain values, so both scans skip by them.
    """
    index = read(spark, folder, "index")
    asked = spark.range(1).select(
        F.array(*map(F.lit, stations)).cast(index.schema["stations"].dataType).alias("s"), F.lit(clasz).cast(index.schema["clasz"].dataType).alias("c")
    )
    s, c, key = asked.select("s", "c", F.xxhash64("s", "c")).first()
    # an index of sequences has one row for it
    found = index.filter((F.col("key") == key) & (F.col("stations") == F.array(*map(F.lit, s))) & (F.col("clasz") == F.lit(c))).select("sequence").first()
    rows = read(spark, folder, "sequences")
    rows = rows.filter(F.col("sequence") == found[0]) if found else rows.filter(F.lit(False))
    return rows.filter(F.col("stations") == F.array(*map(F.lit, s))).select("segment", "points")


def lookup_all(asked: DataFrame, folder: str) -> DataFrame:
    """``asked`` (stations, clasz, other columns) with a row per stored ``segment`` and its ``points``.

    A sequence that is not stored keeps one row with both null.  Rows travel once by the hash of their sequence and class and
    once by their stored sequence; equal stations and classes decide, not hashes.
    """
    spark = asked.sparkSession
    index, others = read(spark, folder, "index"), [c for c in asked.columns if c not in ("stations", "clasz")]
    key = F.xxhash64(*[F.col(c).cast(index.schema[c].dataType) for c in ("stations", "clasz")])
    index = index.select(F.col("key").alias("_key"), F.col("stations").alias("_s"), F.col("clasz").alias("_c"), F.col("sequence").alias("_q"))
    lines = read(spark, folder, "sequences").select(F.col("sequence").alias("_q"), F.col("stations").alias("_s"), "segment", "points")
    mine = asked.withColumn("_k", key)
    found = mine.join(index, (F.col("_k") == F.col("_key")) & (F.col("stations") == F.col("_s")) & (F.col("clasz") == F.col("_c")), "left")
    found = found.select("stations", "clasz", *others, F.col("_q").alias("_found"))
    return found.join(lines, (F.col("_found") == F.col("_q")) & (F.col("stations") == F.col("_s")), "left").select("stations", "clasz", *others, "segment", "points")


def boxes_in(spark: SparkSession, folder: str, south: float, north: float, west: float, east: float) -> DataFrame:
    """(a, b, min_lat, max_lat, min_lng, max_lng) of the station pairs whose box meets a map view, borders included.

    A view with west > east lies across the 180th meridian.
    """
    rows = read(spark, folder, "boxes").filter((F.col("max_lat") >= south) & (F.col("min_lat") <= north))
    after, before = F.col("max_lng") >= west, F.col("min_lng") <= east
    return rows.filter(after & before if west <= east else after | before).drop("place")


def sequences_in(spark: SparkSession, folder: str, south: float, north: float, west: float, east: float) -> DataFrame:
    """(stations, classes) of the sequences with a segment between two stations whose box meets a map view."""
    pairs = boxes_in(spark, folder, south, north, west, east).select("a", "b")
    one, other = F.col("stations")[F.col("segment")], F.col("stations")[F.col("segment") + 1]
    rows = read(spark, folder, "sequences").select("stations", "classes", F.least(one, other).alias("a"), F.greatest(one, other).alias("b"))
    return rows.join(pairs, ["a", "b"], "left_semi").select("stations", "classes").distinct()
