"""A store of real-time messages: known files, replay that resumes, purge in place.

Data lie in folders that are never changed; a numbered manifest names those that count, the ledgers of known files
and the clock of the replay.  A new manifest appears by one rename, so a reader sees the store before or after a step and
a step that dies leaves nothing behind that counts.  One writer at a time; readers any number.  Times are texts in the
session's time zone, which must stay the same (UTC).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import realtime_xml

#: Endings of files that are read, and seconds of messages that are handed on at once.
ENDINGS, BATCH_SECONDS = (".xml", ".zip", ".zst"), 3600
EMPTY = {"number": 0, "data": [], "ledgers": [], "clock": None}


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def manifest(spark: SparkSession, root: str) -> dict:
    """The newest manifest: its number, data as [day, folder], ledgers, clock."""
    fs, folder = _at(spark, f"{root}/manifest")
    numbers = [int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(folder) if f.getPath().getName().endswith(".json")] if fs.exists(folder) else []
    if not numbers:
        return dict(EMPTY)
    return json.loads(spark.read.text(f"{root}/manifest/{max(numbers)}.json", wholetext=True).first()[0])


def commit(spark: SparkSession, root: str, old: dict, **changes) -> dict:
    """The next manifest with ``changes``; an error if someone else has written it since ``old`` was read."""
    new = old | changes | {"number": old["number"] + 1}
    fs, target = _at(spark, f"{root}/manifest/{new['number']}.json")
    _, draft = _at(spark, f"{root}/manifest/_draft-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise RuntimeError(f"{root}: manifest {new['number']} was written by another")
    return new


def _write_days(spark: SparkSession, rows: DataFrame, root: str) -> list[list[str]]:
    """[day, folder] of rows written by the day of their ``msg_ts``."""
    folder = f"{root}/data/{uuid.uuid4().hex}"
    rows = rows.withColumn("msg_day", F.to_date("msg_ts"))
    rows.repartition("msg_day", F.pmod(F.hash("msg_ts"), F.lit(16))).write.partitionBy("msg_day").parquet(folder)
    fs, path = _at(spark, folder)
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    return [[n.split("=")[1], f"{folder}/{n}"] for n in names if n.startswith("msg_day=")]


def _schema(spark: SparkSession):
    none = spark.createDataFrame([], f"file string, file_ts timestamp, part long, {realtime_xml.PACKET}")
    return realtime_xml._messages(none, ["file", "file_ts", "part"]).schema


def read(spark: SparkSession, root: str, first: str | None = None, last: str | None = None, state: dict | None = None) -> DataFrame:
    """Messages of the store; with ``first`` and ``last`` (days) only those days' folders are opened."""
    data = (state or manifest(spark, root))["data"]
    folders = [folder for day, folder in data if (first is None or day >= first) and (last is None or day <= last)]
    if not folders:
        return spark.createDataFrame([], _schema(spark))
    return spark.read.schema(_schema(spark)).parquet(*folders)


def ingest(spark: SparkSession, root: str, source: str) -> int:
    """Number of files below ``source`` that were new: their messages are in the store, the files are known.

    Messages keep their file's time and name and their places in it, the order in which ``ordered`` hands them on.  The
    messages and the ledger count from the same manifest on, so a step that dies is simply repeated.
    """
    state = manifest(spark, root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source).select(F.col("path").alias("file"))
    ends = F.lit(False)
    for e in ENDINGS:
        ends = ends | F.col("file").endswith(e)
    files = files.filter(ends)
    if state["ledgers"]:
        files = files.join(spark.read.schema("file string").parquet(*state["ledgers"]), "file", "left_anti")
    names = sorted(r.file for r in files.toLocalIterator())
    if not names:
        return 0
    data = _write_days(spark, realtime_xml.read_archives(spark, names, origin=True).filter("msg_ts IS NOT NULL"), root)
    ledger = f"{root}/ledger/{uuid.uuid4().hex}"
    spark.createDataFrame([(n,) for n in names], "file string").write.parquet(ledger)
    commit(spark, root, state, data=state["data"] + data, ledgers=[*state["ledgers"], ledger])
    return len(names)


def ordered(messages: DataFrame) -> DataFrame:
    """Messages by their time; of one time by their files' times and names, then as they stand in them."""
    return messages.orderBy("msg_ts", "file_ts", "file", "part", "nth")


def forward(spark: SparkSession, root: str, to: str, schedule_begin: str, schedule_end: str, sink: Callable[[DataFrame, str], None]) -> int:
    """Hand messages sent up to ``to`` on to ``sink(messages, begin)``, an hour at once; the number of batches.

    Messages count whose events touch the schedule.  The first is sent after the clock, at which the replay last stopped; a batch
    begins at the first message that is left and takes all of the hour from there on.  The clock is written after
    each batch and is ``to`` at the end.  A replay that dies begins again with the batch that it did not finish, with
    the same ``begin`` and rows, so a sink that replaces by ``begin`` takes each message once.
    """
    state, n = manifest(spark, root), 0
    time = lambda t: F.lit(t).cast("timestamp")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    while True:
        clock = state["clock"]
        left = read(spark, root, clock and clock[:10], to[:10], state).filter((F.col("msg_ts") <= time(to)) & (F.col("latest") >= time(schedule_begin)) & (F.col("earliest") <= time(schedule_end)))
        if clock:
            left = left.filter(F.col("msg_ts") >= time(clock) + F.expr("INTERVAL 1 SECOND"))
        begin, end = left.agg(F.min("msg_ts").alias("b")).select(text(F.col("b")), text(F.least(F.col("b") + F.expr(f"INTERVAL {BATCH_SECONDS - 1} SECONDS"), time(to)))).first()
        if begin is None:
            if clock is None or to > clock:
                commit(spark, root, state, clock=to)
            return n
        sink(ordered(left.filter(F.col("msg_ts") <= time(end))), begin)
        state = commit(spark, root, state, clock=end)
        n += 1


def purge(spark: SparkSession, root: str, until: str) -> None:
    """Take out messages sent up to ``until``, in place: earlier days leave the manifest, the day itself is written anew.

    Later days stay as they are.  Readers that opened the store before keep their folders until ``vacuum``.
    """
    state, day = manifest(spark, root), until[:10]
    stay = [d for d in state["data"] if d[0] > day]
    edge = [folder for d, folder in state["data"] if d == day]
    if edge:
        rows = spark.read.schema(_schema(spark)).parquet(*edge).filter(F.col("msg_ts") > F.lit(until).cast("timestamp"))
        stay = stay + _write_days(spark, rows, root)
    commit(spark, root, state, data=stay)


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete folders and older manifests that the newest manifest does not name; the number of data folders deleted."""
    state, n = manifest(spark, root), 0
    used = {folder for _, folder in state["data"]}
    fs, data = _at(spark, f"{root}/data")
    for load in fs.listStatus(data) if fs.exists(data) else []:
        names = [f.getPath().getName() for f in fs.listStatus(load.getPath()) if f.isDirectory()]
        gone = [x for x in names if f"{root}/data/{load.getPath().getName()}/{x}" not in used]
        for x in gone:
            fs.delete(_at(spark, f"{root}/data/{load.getPath().getName()}/{x}")[1], True)
        n += len(gone)
        if len(gone) == len(names):
            fs.delete(load.getPath(), True)
    for f in fs.listStatus(_at(spark, f"{root}/manifest")[1]):
        if f.getPath().getName() != f"{state['number']}.json":
            fs.delete(f.getPath(), False)
    return n
