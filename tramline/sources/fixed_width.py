"""Fixed-width operator schedules: days, stations, footpaths, categories and service records.

All decoding is column expressions.  Lines are ISO-8859-1; a service record is one row, cut by
the line separator of the text source, so files stay splittable and line order is never needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENCODING = "ISO-8859-1"
#: Key of the day set that holds every day.
ALL_DAYS = 0


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) without comments, empty lines and line ends."""
    raw = spark.read.text(path).select(F.rtrim(F.decode(F.col("value").cast("binary"), ENCODING)).alias("line"))
    return raw.filter((F.length("line") > 0) & ~F.col("line").startswith("%"))


def _cut(line: Column, begin: int, width: int) -> Column:
    return F.trim(F.substring(line, begin + 1, width))


def _int(text: Column) -> Column:
    """A number; blank or other text is null."""
    return F.when(text.rlike("^[0-9]+$"), text.cast("long"))


def minutes(text: Column) -> Column:
    """hhmm (hours may pass 24) to minutes; blank is null."""
    x = _int(text)
    return F.floor(x / 100) * 60 + x % 100


def traffic_days(spark: SparkSession, path: str) -> DataFrame:
    """(bitfield, day) from ``index hex`` lines: day 0 follows the first ``11``, the last ``11`` ends the period."""
    rows = lines(spark, path).select(_int(_cut(F.col("line"), 0, 6)).alias("bitfield"), F.split(F.col("line"), "\\s+")[1].alias("hex"))
    bits = rows.withColumn("bits", F.array_join(F.transform(F.split("hex", "(?!^)"), lambda c: F.lpad(F.conv(c, 16, 2), 4, "0")), ""))
    first, last = F.instr("bits", "11"), F.length("bits") - F.instr(F.reverse("bits"), "11")
    period = bits.withColumn("period", F.when((first > 0) & (last - first > 2), F.expr("substring(bits, instr(bits, '11') + 2, length(bits) - instr(reverse(bits), '11') - instr(bits, '11') - 2)")).otherwise(F.raise_error(F.concat(F.lit("day set without period: "), "hex"))))
    return period.select("bitfield", F.posexplode(F.split("period", "(?!^)")).alias("day", "bit")).filter("bit = '1'").select("bitfield", F.col("day").cast("long").alias("day"))


def stations(spark: SparkSession, names: str, coordinates: str) -> DataFrame:
    """(eva, name, lng, lat): a full outer join, the name ends at ``$``."""
    line = F.col("line")
    n = lines(spark, names).select(_int(_cut(line, 0, 7)).alias("eva"), F.trim(F.split(F.substring(line, 13, 10_000), "\\$")[0]).alias("name"))
    c = lines(spark, coordinates).select(_int(_cut(line, 0, 7)).alias("eva"), _cut(line, 8, 10).cast("double").alias("lng"), _cut(line, 19, 10).cast("double").alias("lat"))
    return n.join(c, "eva", "full")


def meta_stations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((eva, equivalent), (from_eva, to_eva, duration)): a colon in column 7 marks equivalent stations."""
    rows = lines(spark, path).filter((F.length("line") >= 16) & ~F.col("line").startswith("*"))
    line, equal = F.col("line"), F.substring("line", 8, 1) == ":"
    meta = rows.filter(equal).select(_int(_cut(line, 0, 7)).alias("eva"), F.explode(F.split(F.trim(F.substring(line, 9, 10_000)), " +")).alias("e"))
    foot = rows.filter(~equal).select(_int(_cut(line, 0, 7)).alias("from_eva"), _int(_cut(line, 8, 7)).alias("to_eva"), _int(_cut(line, 16, 3)).alias("duration"))
    return meta.select("eva", _int(F.col("e")).alias("equivalent")).filter("equivalent <> 0").distinct(), foot.distinct()


def services(spark: SparkSession, path: str) -> DataFrame:
    """One row per service record: number, admin, repetitions, category, line, day sets and decoded stops.

    ``*T`` and ``*K`` records are skipped.  Train number and admin of a stop hold until a later
    stop names others.  Records without stops, category or day set are kept out.
    """
    raw = spark.read.option("lineSep", "\n*Z ").text(path)
    text = F.regexp_replace(F.decode(F.col("value").cast("binary"), ENCODING), "\r", "")
    body = F.split(F.regexp_replace(text, "(?s)^.*?\\*Z ", ""), "\n\\*(?:T|K(?!.Z))")[0]
    rows = raw.select(F.split(body, "\n").alias("rec"))
    of = lambda start: F.filter("rec", lambda x: x.startswith(start))
    head = F.col("rec")[0]
    rows = rows.select(
        _int(_cut(head, 0, 5)).alias("number"),
        _cut(head, 6, 6).alias("admin"),
        F.coalesce(_int(_cut(head, 19, 3)), F.lit(0)).alias("repetitions"),
        F.coalesce(_int(_cut(head, 23, 3)), F.lit(0)).alias("every"),
        _cut(F.get(F.filter("rec", lambda x: x.startswith("*G") & ~x.startswith("*GR")), F.lit(0)), 3, 3).alias("category"),
        _cut(F.get(of("*L"), F.lit(0)), 3, 5).alias("line"),
        F.transform(of("*A VE"), lambda x: F.struct(_int(_cut(x, 6, 7)).alias("from_eva"), _int(_cut(x, 14, 7)).alias("to_eva"), F.coalesce(_int(_cut(x, 22, 6)), F.lit(ALL_DAYS)).alias("bitfield"))).alias("days"),
        F.filter(F.slice("rec", F.lit(2), F.size("rec")), lambda x: x.rlike("^[0-9]")).alias("stop_lines"),
    ).filter(F.col("category").isNotNull() & (F.size("days") > 0) & (F.size("stop_lines") >= 2))
    numbers = F.transform("stop_lines", lambda x: _int(_cut(x, 43, 5)))
    admins = F.transform("stop_lines", lambda x: F.when(_cut(x, 49, 6).rlike("^[^%\\s]+$"), _cut(x, 49, 6)))
    rows = rows.withColumn("numbers", numbers).withColumn("admins", admins)
    upto = lambda col, i: F.try_element_at(F.filter(F.slice(F.col(col), F.lit(1), i + 1), lambda v: v.isNotNull()), F.lit(-1))
    stop = lambda x, i: F.struct(
        i.cast("long").alias("seq"),
        _int(_cut(x, 0, 7)).alias("eva"),
        minutes(_cut(x, 30, 5)).alias("arr_min"),
        minutes(_cut(x, 37, 5)).alias("dep_min"),
        (F.substring(x, 30, 1) != "-").alias("out_allowed"),
        (F.substring(x, 37, 1) != "-").alias("in_allowed"),
        F.coalesce(upto("numbers", i), F.col("number")).alias("train_nr"),
        F.coalesce(upto("admins", i), F.col("admin")).alias("admin"),
    )
    return rows.withColumn("stops", F.transform("stop_lines", stop)).drop("stop_lines", "numbers", "admins")


def expand(services: DataFrame) -> DataFrame:
    """Repeated services as rows of their own: run r starts r times ``every`` minutes later."""
    rows = services.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("repetitions"))))
    later = lambda s: s.withField("arr_min", s["arr_min"] + F.col("run") * F.col("every")).withField("dep_min", s["dep_min"] + F.col("run") * F.col("every"))
    return rows.withColumn("stops", F.transform("stops", later)).drop("repetitions", "every")


def categories(spark: SparkSession, path: str) -> DataFrame:
    """(code, output_rule, name); product texts, which are indented or follow their heading, are not categories."""
    rows = lines(spark, path).filter(F.col("line").rlike("^\\S.{19,}") & ~F.col("line").rlike("^[#<]"))
    line = F.col("line")
    return rows.select(_cut(line, 0, 3).alias("code"), _int(_cut(line, 9, 2)).alias("output_rule"), _cut(line, 12, 8).alias("name"))


def merge_split_rules(spark: SparkSession, path: str) -> DataFrame:
    """(eva_begin, eva_end, number_1, admin_1, number_2, admin_2, bitfield): two services share the part between the stations."""
    line = F.col("line")
    rows = lines(spark, path).filter(F.length("line") >= 53)
    return rows.select(
        _int(_cut(line, 0, 7)).alias("eva_begin"), _int(_cut(line, 9, 7)).alias("eva_end"), _int(_cut(line, 18, 5)).alias("number_1"), _cut(line, 25, 6).alias("admin_1"),
        _int(_cut(line, 33, 5)).alias("number_2"), _cut(line, 40, 6).alias("admin_2"), _int(_cut(line, 47, 6)).alias("bitfield"),
    )


def through_rules(spark: SparkSession, path: str) -> DataFrame:
    """(eva, number_1, admin_1, number_2, admin_2, bitfield): service 1 goes on as service 2 at a station."""
    line = F.col("line")
    rows = lines(spark, path).filter(F.length("line") >= 40)
    return rows.select(_int(_cut(line, 13, 7)).alias("eva"), _int(_cut(line, 0, 5)).alias("number_1"), _cut(line, 6, 6).alias("admin_1"), _int(_cut(line, 21, 5)).alias("number_2"), _cut(line, 27, 6).alias("admin_2"), _int(_cut(line, 34, 6)).alias("bitfield"))


def attributes(spark: SparkSession, path: str) -> DataFrame:
    """(code, text): after three blanks the text begins at column 21, else at 12; its last character is a mark."""
    line = F.col("line")
    rows = lines(spark, path).filter(~line.startswith("#"))
    text = F.when(F.trim(F.substring(line, 3, 3)) == "", F.substring(line, 22, 10_000)).otherwise(F.substring(line, 13, 10_000))
    return rows.withColumn("_t", text).select(_cut(line, 0, 2).alias("code"), F.expr("substring(_t, 1, length(_t) - 1)").alias("text"))


def directions(spark: SparkSession, path: str) -> DataFrame:
    """(code, text) of directions that are no station."""
    line = F.col("line")
    return lines(spark, path).select(_cut(line, 0, 7).alias("code"), F.substring(line, 9, 10_000).alias("text"))


def providers(spark: SparkSession, path: str) -> DataFrame:
    """(admin, short_name, long_name, full_name): names of a number (K line) hold for the admins of its ``:`` line."""
    line = F.col("line")
    rows = lines(spark, path).select(_int(_cut(line, 0, 5)).alias("provider"), F.substring(line, 7, 1).alias("kind"), "line")

    def name(mark: str) -> Column:  # quoted, or up to a blank
        quoted = F.regexp_extract(line, f" {mark} ([\"'])(.*?)\\1", 2)
        return F.when(line.rlike(f" {mark} [\"']"), quoted).otherwise(F.regexp_extract(line, f" {mark} ([^ ]+)", 1))

    names = rows.filter("kind = 'K'").select("provider", name("K").alias("short_name"), name("L").alias("long_name"), name("V").alias("full_name"))
    admins = rows.filter("kind = ':'").select("provider", F.explode(F.split(F.trim(F.substring(line, 9, 10_000)), " +")).alias("admin"))
    return admins.join(names, "provider").select("admin", "short_name", "long_name", "full_name")


def track_rules(spark: SparkSession, path: str) -> DataFrame:
    """(eva, train_nr, admin, track, time, bitfield): a null time holds all day, bitfield 0 on all days."""
    line = F.col("line")
    return lines(spark, path).filter(F.length("line") >= 22).select(
        _int(_cut(line, 0, 7)).alias("eva"), _int(_cut(line, 8, 5)).alias("train_nr"), _cut(line, 14, 6).alias("admin"), _cut(line, 21, 8).alias("track"),
        minutes(_cut(line, 30, 4)).alias("time"), F.coalesce(_int(_cut(line, 35, 6)), F.lit(ALL_DAYS)).alias("bitfield"),
    )


def tracks_of(stops: DataFrame, rules: DataFrame) -> DataFrame:
    """Stops (eva, train_nr, admin, at, ...) with ``track`` and ``track_days``: of the rules for station, train and admin
    those without a time, or with the stop's time of day."""
    r = rules.select("eva", "train_nr", "admin", "track", F.col("time").alias("_time"), F.col("bitfield").alias("track_days"))
    rows = stops.join(r, ["eva", "train_nr", "admin"], "left")
    fits = F.col("_time").isNull() | (F.col("_time") == F.pmod("at", F.lit(1440)))
    return rows.withColumn("track", F.when(fits, F.col("track"))).withColumn("track_days", F.when(fits, F.col("track_days"))).drop("_time").distinct()


def infotexts(spark: SparkSession, path: str) -> DataFrame:
    """(ds100, eva): station codes of a colon-separated file, the fourth and fifth columns, several codes with commas."""
    parts = F.split("line", ":")
    rows = lines(spark, path).filter(F.length("line") >= 38).select(_int(F.trim(parts[3])).alias("eva"), F.explode(F.split(parts[4], ",")).alias("ds100"))
    return rows.select(F.trim("ds100").alias("ds100"), "eva").filter("ds100 <> ''")


def basic_data(spark: SparkSession, path: str) -> tuple:
    """(first date, last date, name) of a schedule: three short lines, read by the driver."""
    head = [r["line"] for r in spark.read.text(path, wholetext=True).select(F.explode(F.split(F.decode(F.col("value").cast("binary"), ENCODING), "\r?\n")).alias("line")).limit(3).collect()]
    from datetime import datetime

    day = lambda text: datetime.strptime(text[:10], "%d.%m.%Y").date()
    return day(head[0]), day(head[1]), head[2].strip() if len(head) > 2 else ""


def timezones(spark: SparkSession, path: str, first_day: str) -> DataFrame:
    """(eva, utc_offset, season_offset, season_first, season_first_min, season_last, season_last_min), days from ``first_day``.

    A line holds an offset and, where columns 15 to 47 are not blank, a season; a line of two numbers names the
    station whose entry it shares.
    """
    line = F.col("line")
    rows = lines(spark, path).filter(line.rlike("^[0-9]"))
    day = lambda at: F.datediff(F.to_date(_cut(line, at, 8), "ddMMyyyy"), F.lit(first_day).cast("date")).cast("long")
    season = F.trim(F.substring(line, 15, 33)) != ""
    own = rows.filter(line.rlike("^[0-9]{7} [+-]")).select(
        _int(_cut(line, 0, 7)).alias("eva"), minutes(F.regexp_replace(_cut(line, 8, 5), "^[+-]", "")).alias("utc_offset"),
        F.when(season, minutes(F.regexp_replace(_cut(line, 14, 5), "^[+-]", ""))).alias("season_offset"), F.when(season, day(20)).alias("season_first"), F.when(season, minutes(_cut(line, 29, 4))).alias("season_first_min"),
        F.when(season, day(34)).alias("season_last"), F.when(season, minutes(_cut(line, 43, 4))).alias("season_last_min"),
    )
    alias = rows.filter(line.rlike("^[0-9]{7} [0-9]{7}$")).select(_int(_cut(line, 0, 7)).alias("_eva"), _int(_cut(line, 8, 7)).alias("eva"))
    return own.unionByName(alias.join(own, "eva").drop("eva").withColumnRenamed("_eva", "eva"))


def with_timezone(rows: DataFrame, zones: DataFrame, eva: str = "eva") -> DataFrame:
    """Rows with the zone of the largest station number not above theirs: the zones become intervals of numbers."""
    from pyspark.sql import Window

    z = zones.withColumn("_to", F.lead("eva").over(Window.partitionBy(F.lit(1)).orderBy("eva"))).withColumnRenamed("eva", "_from")  # a few dozen zones
    return rows.join(F.broadcast(z), (F.col(eva) >= F.col("_from")) & (F.col("_to").isNull() | (F.col(eva) < F.col("_to"))), "left").drop("_from", "_to")


def to_utc(day: Column, local: Column, adjust: bool = True) -> Column:
    """Minutes from day 0 in UTC of a local time of a day, by the columns of ``with_timezone``; null in the hour that a
    season skips, unless ``adjust`` takes it an hour later."""
    t = day * 1440 + local
    begin, end = F.col("season_first") * 1440 + F.col("season_first_min") - F.col("utc_offset"), F.col("season_last") * 1440 + F.col("season_last_min") - F.col("season_offset")
    shift = lambda x: F.when(F.coalesce((begin + F.col("utc_offset") <= x) & (x <= end + F.col("season_offset")), F.lit(False)), x - F.col("season_offset")).otherwise(x - F.col("utc_offset"))
    skipped = F.coalesce((begin + F.col("utc_offset") <= t) & (t < begin + F.col("utc_offset") + 60), F.lit(False))
    return F.when(skipped, shift(t + 60) if adjust else F.lit(None).cast("long")).otherwise(shift(t))


def to_local(utc: Column) -> Column:
    """The inverse of ``to_utc``."""
    begin, end = F.col("season_first") * 1440 + F.col("season_first_min") - F.col("utc_offset"), F.col("season_last") * 1440 + F.col("season_last_min") - F.col("season_offset")
    return utc + F.when(F.coalesce((begin <= utc) & (utc <= end), F.lit(False)), F.col("season_offset")).otherwise(F.col("utc_offset"))


#: Names of the two dialects' files, alternatives in order; the first names the dialect.
FILES = {
    "5.00.8": {"basic": ("eckdaten.101",), "attributes": ("attributd_int_int.101", "attributd_int.101"), "stations": ("bahnhof.101",), "coordinates": ("dbkoord_geo.101",), "bitfields": ("bitfield.101",), "tracks": ("gleise.101",), "infotext": ("infotext.101",), "categories": ("zugart_int.101",), "directions": ("richtung.101",), "providers": ("unternehmen_ris.101",), "through": ("durchbi.101",), "merge_split": ("vereinig_vt.101",), "timezones": ("zeitvs.101",), "footpaths": ("metabhf.101",)},
    "5.20.26": {"basic": ("eckdaten.txt",), "attributes": ("attributd.txt",), "stations": ("bahnhof.txt",), "coordinates": ("bfkoord.txt",), "bitfields": ("bitfield.txt",), "tracks": ("gleise.txt",), "infotext": ("infotext.txt",), "categories": ("zugart.txt",), "directions": ("richtung.txt",), "providers": ("betrieb.txt",), "through": ("durchbi.txt",), "merge_split": ("vereinig.txt",), "timezones": ("zeitvs.txt",), "footpaths": ("metabhf.txt",)},
}


def detect(spark: SparkSession, path: str) -> tuple[str | None, dict[str, str], list[str]]:
    """(dialect, file by role, missing names) of a schedule folder with ``stamm`` and ``fahrten``."""
    from .files import exists

    root = f"{path}/stamm"
    for dialect, files in FILES.items():
        if not exists(spark, f"{root}/{files['basic'][0]}"):
            continue
        found = {role: next((f"{root}/{n}" for n in names if exists(spark, f"{root}/{n}")), None) for role, names in files.items()}
        gone = [n for role, names in files.items() if found[role] is None for n in names]
        if not exists(spark, f"{path}/fahrten"):
            gone.append("fahrten")
        return dialect, {r: f for r, f in found.items() if f}, gone
    return None, {}, ["eckdaten.*"]


def service_days(services: DataFrame, days: DataFrame, last_day: int) -> DataFrame:
    """(service, section, day): days of each section by the day sets of its station ranges; set 0 is every day up to ``last_day``.

    ``services`` has ``service``, ``stops`` and ``days`` as decoded by ``services``; a range holds from its first station's first stop
    to its last station's stop after that.
    """
    rows = services.select("service", "stops", F.explode("days").alias("r"))
    first = F.array_position(F.transform("stops", lambda s: s["eva"]), F.col("r.from_eva")).cast("int") - 1
    rows = rows.withColumn("_first", F.when(F.col("r.from_eva").isNull(), 0).otherwise(first)).withColumn("_n", F.size("stops"))
    after = F.transform(F.slice("stops", F.col("_first") + 2, F.greatest(F.col("_n") - F.col("_first") - 1, F.lit(0))), lambda s: s["eva"])
    last = F.array_position(after, F.col("r.to_eva")).cast("int") + F.col("_first")
    rows = rows.withColumn("_last", F.when(F.col("r.to_eva").isNull(), F.col("_n") - 1).otherwise(last)).filter("_first >= 0 AND _last > _first")
    rows = rows.select("service", F.explode(F.sequence(F.col("_first").cast("long"), F.col("_last").cast("long") - 1)).alias("section"), F.col("r.bitfield").alias("bitfield"))
    every = services.sparkSession.range(last_day + 1).select(F.lit(ALL_DAYS).cast("long").alias("bitfield"), F.col("id").alias("day"))
    return rows.join(days.filter(F.col("bitfield") != ALL_DAYS).select("bitfield", "day").unionByName(every), "bitfield").select("service", "section", "day").distinct()


def utc_services(stops: DataFrame, days: DataFrame, zones: DataFrame) -> DataFrame:
    """(service, variant, day, seq, eva, arr, dep): stops (service, seq, eva, arr_min, dep_min) on their days in UTC.

    Days whose stops all shift alike form one ``variant`` of the service: its minutes of the day are equal.
    """
    rows = with_timezone(stops.join(days.select("service", "day").distinct(), "service"), zones)
    rows = rows.withColumn("arr", to_utc(F.col("day"), F.col("arr_min"))).withColumn("dep", to_utc(F.col("day"), F.col("dep_min")))
    shape = rows.groupBy("service", "day").agg(F.xxhash64(F.array_sort(F.collect_list(F.struct("seq", (F.col("arr") - F.col("day") * 1440).alias("a"), (F.col("dep") - F.col("day") * 1440).alias("d"))))).alias("variant"))
    return rows.join(shape, ["service", "day"]).select("service", "variant", "day", "seq", "eva", "arr", "dep")
