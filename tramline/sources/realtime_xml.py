"""Real-time message packets and bike-sharing snapshots in XML, plain or in archives."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE = "Europe/Berlin"
_TRAINS = "STRUCT<Zug: ARRAY<STRUCT<_Nr: STRING, _Linie: STRING, _Gattung: STRING, ListZE: STRUCT<ZE: ARRAY<STRUCT<_Typ: STRING, Bf: STRUCT<_EvaNr: STRING>, Zeit: STRUCT<_Soll: STRING, _Ist: STRING, _Prog: STRING>, Gleis: STRUCT<_Soll: STRING>>>>>>>"
_SERVICE = f"STRUCT<Service: STRUCT<_IdBfEvaNr: STRING, _IdZNr: STRING, _IdZeit: STRING, _Zielzeit: STRING, _RegSta: STRING, ListZug: {_TRAINS}>>"
#: Fixed names: message elements and the kinds they stand for.
KINDS = {"Ist": "is", "IstProg": "forecast", "Ausfall": "cancel", "Zusatzzug": "addition", "Umleitung": "reroute"}
PACKET = f"_TOut STRING, ListNachricht STRUCT<Nachricht: ARRAY<STRUCT<{', '.join(f'{k}: {_SERVICE}' for k in KINDS)}>>>"


def _time(text: Column) -> Column:
    return F.to_utc_timestamp(F.try_to_timestamp(F.substring(text, 1, 14), F.lit("yyyyMMddHHmmss")), ZONE)


def _messages(packets: DataFrame, keep: list[str] = ()) -> DataFrame:
    """One row per message with its trip and an array of events; unknown event types are left out.

    Columns ``keep`` stay, with ``nth``, the message's place in its packet, behind them.
    """
    kept = [*keep, "nth"] if keep else []
    one = packets.select(*keep, _time(F.col("_TOut")).alias("msg_ts"), F.posexplode("ListNachricht.Nachricht").alias("nth", "m"))
    tagged = F.filter(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(f"m.{tag}.Service").alias("s")) for tag, kind in KINDS.items()]), lambda x: x["s"].isNotNull())
    one = one.select(*kept, "msg_ts", F.explode(tagged).alias("k")).select(*kept, "msg_ts", "k.kind", "k.s")
    ev_type = lambda e: F.when(e["_Typ"].isin("Start", "Ab"), "DEP").when(e["_Typ"].isin("An", "Ziel"), "ARR")

    def event(t: Column):
        return lambda e: F.struct(e["Bf"]["_EvaNr"].alias("station"), t["_Nr"].cast("long").alias("train_nr"), t["_Linie"].alias("line"), ev_type(e).alias("ev_type"), _time(e["Zeit"]["_Soll"]).alias("sched"), _time(F.when(F.col("kind") == "is", e["Zeit"]["_Ist"]).when(F.col("kind") == "forecast", e["Zeit"]["_Prog"])).alias("updated"), t["_Gattung"].alias("category"), e["Gleis"]["_Soll"].alias("track"))

    events = F.filter(F.flatten(F.transform("s.ListZug.Zug", lambda t: F.transform(t["ListZE"]["ZE"], event(t)))), lambda e: e["ev_type"].isNotNull())
    out = one.select(*kept, "msg_ts", "kind", F.struct(F.col("s._IdBfEvaNr").alias("station"), F.col("s._IdZNr").cast("long").alias("train_nr"), _time(F.col("s._IdZeit")).alias("time"), (F.coalesce(F.col("s._RegSta"), F.lit("Plan")).isin("", "Plan") == F.lit(False)).alias("additional")).alias("trip"), _time(F.col("s._Zielzeit")).alias("target_time"), events.alias("events"))
    scheds = F.filter(F.concat(F.transform("events", lambda e: e["sched"]), F.array("trip.time", "target_time")), lambda t: t.isNotNull())
    return out.withColumn("earliest", F.array_min(scheds)).withColumn("latest", F.array_max(scheds)).drop("target_time")


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """Messages of plain XML packets."""
    return _messages(spark.read.format("xml").option("rowTag", "Paket").schema(PACKET).load(path))


def _members(name: str, content: bytes) -> Iterator[bytes]:
    if name.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for n in sorted(z.namelist()):
                if n.endswith(".xml"):
                    yield z.read(n)
    elif name.endswith((".tar.zst", ".tar.zstd")):
        import zstandard

        with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content)) as s, tarfile.open(fileobj=s, mode="r|") as t:
            for m in t:
                if m.isfile() and m.name.endswith(".xml"):
                    yield t.extractfile(m).read()
    elif name.endswith(".xml"):
        yield content


def read_archives(spark: SparkSession, path: str | list[str], origin: bool = False) -> DataFrame:
    """Messages of packets in .zip, .tar.zst and .xml files below ``path``.

    With ``origin`` they have the file, its time and their places in it: (file, file_ts, part, nth).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (name, content) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                for part, xml in enumerate(_members(name, content)):
                    text = xml.decode("ISO-8859-1" if b"8859-1" in xml[:100] else "utf-8").split("?>", 1)[-1]
                    yield pa.RecordBatch.from_arrays([b.column(0)[k : k + 1], b.column(1)[k : k + 1], pa.array([part], pa.int64()), pa.array([text])], ["file", "file_ts", "part", "xml"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "content")
    packets = files.mapInArrow(run, "file string, file_ts timestamp, part long, xml string").select("file", "file_ts", "part", F.from_xml("xml", PACKET).alias("p")).select("file", "file_ts", "part", "p.*")
    return _messages(packets, ["file", "file_ts", "part"] if origin else [])


def message_events(messages: DataFrame) -> DataFrame:
    """One row per event of the messages."""
    return messages.select("msg_ts", "kind", "trip", F.explode("events").alias("e")).select("msg_ts", "kind", F.col("trip.station").alias("trip_station"), F.col("trip.train_nr").alias("trip_nr"), F.col("trip.time").alias("trip_time"), F.col("trip.additional").alias("additional"), "e.*")


def store(messages: DataFrame, path: str) -> None:
    """Append messages to the store, a folder per day of their timestamp."""
    messages.withColumn("msg_day", F.to_date("msg_ts")).repartition("msg_day", F.pmod(F.hash("msg_ts"), F.lit(16))).write.mode("append").partitionBy("msg_day").parquet(path)


def relevant(stored: DataFrame, first, last, schedule_begin, schedule_end) -> DataFrame:
    """Messages sent in [first, last] whose events touch the schedule; days outside are pruned."""
    at = lambda t: F.lit(t).cast("timestamp")
    return stored.filter(F.col("msg_day").between(F.to_date(at(first)), F.to_date(at(last))) & F.col("msg_ts").between(at(first), at(last)) & (F.col("latest") >= at(schedule_begin)) & (F.col("earliest") <= at(schedule_end)))


def purge(spark: SparkSession, path: str, until) -> DataFrame:
    """Rewrite the store without messages up to ``until``; returns what is left in ``path``-kept."""
    kept = spark.read.parquet(path).filter((F.col("msg_day") >= F.to_date(F.lit(until).cast("timestamp"))) & (F.col("msg_ts") > F.lit(until).cast("timestamp")))
    kept.write.mode("overwrite").partitionBy("msg_day").parquet(f"{path.rstrip('/')}-kept")
    return spark.read.schema(kept.schema).parquet(f"{path.rstrip('/')}-kept")


def bike_snapshots(spark: SparkSession, path: str, country: str = "DE") -> DataFrame:
    """(terminal, ts, name, lat, lng, bikes) of fixed terminals; the time is the number in the file name."""
    schema = "_country STRING, city ARRAY<STRUCT<place: ARRAY<STRUCT<_uid: STRING, _lat: DOUBLE, _lng: DOUBLE, _name: STRING, _spot: STRING, _bikes: STRING>>>>"
    rows = spark.read.format("xml").option("rowTag", "country").schema(schema).load(path).withColumn("file", F.input_file_name())
    ts = F.timestamp_seconds(F.regexp_extract("file", "-([0-9]+)\\.[^.]*$", 1).cast("long"))
    places = rows.filter(F.col("_country") == country).select(ts.alias("ts"), F.explode(F.flatten(F.transform("city", lambda c: F.coalesce(c["place"], F.array())))).alias("p")).filter("p._spot = '1'")
    bikes = F.regexp_extract(F.coalesce(F.col("p._bikes"), F.lit("")), "^[0-9]+", 0)
    return places.select(F.col("p._uid").alias("terminal"), "ts", F.col("p._name").alias("name"), F.col("p._lat").alias("lat"), F.col("p._lng").alias("lng"), F.when(bikes == "", 0).otherwise(bikes.cast("long")).cast("long").alias("bikes"))
