"""Fixed-width schedules, message packets, archives, bike snapshots and routes on hand-made input."""

import datetime as dt
import io
import tarfile
import zipfile

import pytest
import zstandard
from pyspark.sql import functions as F

from tramline.operators import services
from tramline.sources import fixed_width, realtime_xml

SERVICES = """% comment
*Z 00101 80____
*G IC  1000001 1000003
*A VE 1000001 1000003 000007
*L 9     1000001 1000003
1000001 Süd$Station                  00805
1000002 Mitte                 00815  00817 00102
1000003 Nord                  02530
*T 00500 80____
1000009 Skipped                      00101
*Z 00200 80____       002 030
*G RE  1000001 1000002
*A VE 1000001 1000002
1000001 A                            01000
1000002 B                    -01010
*Z 00300 80____
1000001 no category                  01000
1000002 B                     01010
"""


def test_services(spark, tmp_path):
    (tmp_path / "s.101").write_bytes(SERVICES.encode("latin-1"))
    rows = {r["number"]: r for r in fixed_width.services(spark, str(tmp_path / "s.101")).collect()}
    assert set(rows) == {101, 200}
    one = rows[101]
    assert (one["category"], one["line"], one["admin"], [tuple(d) for d in one["days"]]) == ("IC", "9", "80____", [(1000001, 1000003, 7)])
    assert [(s["eva"], s["arr_min"], s["dep_min"], s["train_nr"]) for s in one["stops"]] == [(1000001, None, 485, 101), (1000002, 495, 497, 102), (1000003, 1530, None, 102)]
    assert rows[200]["days"][0]["bitfield"] == fixed_width.ALL_DAYS
    assert rows[200]["stops"][1]["out_allowed"] is False
    runs = fixed_width.expand(fixed_width.services(spark, str(tmp_path / "s.101"))).filter("number = 200").orderBy("run").collect()
    assert [r["stops"][0]["dep_min"] for r in runs] == [600, 630, 660]


def test_traffic_days(spark, tmp_path):
    # 1100 | days 1,0,1,1,0 | 11 -> hex of 00 11 10110 11 00000
    (tmp_path / "b").write_text("000007 36C0\n")
    bits = bin(0x36C0)[2:].zfill(16)
    inner = bits[bits.index("11") + 2 : bits.rindex("11")]
    got = sorted(r["day"] for r in fixed_width.traffic_days(spark, str(tmp_path / "b")).collect())
    assert got == [k for k, c in enumerate(inner) if c == "1"]
    (tmp_path / "bad").write_text("000008 0100\n")
    with pytest.raises(Exception, match="period"):
        fixed_width.traffic_days(spark, str(tmp_path / "bad")).collect()


def test_stations_and_meta(spark, tmp_path):
    (tmp_path / "n").write_bytes("1000001     Süd$extra\n1000002     Nord\n".encode("latin-1"))
    (tmp_path / "c").write_text("1000001 8.500000   49.250000  Sued\n1000003 9.000000   50.000000  West\n")
    got = {r["eva"]: (r["name"], r["lng"], r["lat"]) for r in fixed_width.stations(spark, str(tmp_path / "n"), str(tmp_path / "c")).collect()}
    assert got == {1000001: ("Süd", 8.5, 49.25), 1000002: ("Nord", None, None), 1000003: (None, 9.0, 50.0)}
    (tmp_path / "m").write_text("1000001 1000002 004\n1000001: 1000002 1000003\n* note line is ignored\n")
    meta, foot = fixed_width.meta_stations(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, meta.collect())) == [(1000001, 1000002), (1000001, 1000003)]
    assert [tuple(r) for r in foot.collect()] == [(1000001, 1000002, 4)]
    (tmp_path / "k").write_text("IC   1 B 0  IC        2   Intercity\n<Produktwahltexte>\n  some text that is longer than twenty\n")
    assert [tuple(r) for r in fixed_width.categories(spark, str(tmp_path / "k")).collect()] == [("IC", 0, "IC")]


def packet(body: str) -> str:
    return f'<?xml version="1.0" encoding="utf-8"?>\n<Paket TOut="20151124110000000"><ListNachricht><Nachricht>{body}</Nachricht></ListNachricht></Paket>'


def message(tag: str, extra: str = "") -> str:
    ze = '<ZE Typ="Ab"><Bf EvaNr="1000001"/><Zeit Soll="20151124120000" Ist="20151124120300" Prog="20151124120400"/></ZE><ZE Typ="Durch"><Bf EvaNr="1"/></ZE><ZE Typ="Ziel"><Bf EvaNr="1000002"/><Zeit Soll="20151124123000"/></ZE>'
    return f'<{tag}><Service IdBfEvaNr="1000001" IdZeit="20151124115400" IdZNr="628" Zielzeit="20151124172600" {extra}><ListZug><Zug Nr="628"><ListZE>{ze}</ListZE></Zug></ListZug></Service></{tag}>'


def test_packets_archives_and_store(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.xml").write_text(packet(message("Ist")))
    plain = realtime_xml.read_packets(spark, str(src / "a.xml"))
    events = sorted(realtime_xml.message_events(plain).collect(), key=lambda r: r["station"])
    assert [(e["ev_type"], e["station"], e["sched"], e["updated"]) for e in events] == [("DEP", "1000001", dt.datetime(2015, 11, 24, 11), dt.datetime(2015, 11, 24, 11, 3)), ("ARR", "1000002", dt.datetime(2015, 11, 24, 11, 30), None)]
    first = plain.first()
    assert (first["earliest"], first["latest"], first["trip"]["additional"]) == (dt.datetime(2015, 11, 24, 10, 54), dt.datetime(2015, 11, 24, 16, 26), False)
    with zipfile.ZipFile(src / "b.zip", "w") as z:
        z.writestr("x.xml", packet(message("Ausfall")))
        z.writestr("readme.txt", "no packet")
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        data = packet(message("Zusatzzug", 'RegSta="Sonder"')).encode()
        info = tarfile.TarInfo("y.xml")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    (src / "c.tar.zst").write_bytes(zstandard.compress(out.getvalue()))
    every = realtime_xml.read_archives(spark, str(src))
    assert sorted((r["kind"], r["trip"]["additional"]) for r in every.collect()) == [("addition", True), ("cancel", False), ("is", False)]
    at = str(tmp_path / "store")
    realtime_xml.store(every, at)
    stored = spark.read.parquet(at)
    assert realtime_xml.relevant(stored, "2015-11-24 00:00:00", "2015-11-24 23:00:00", "2015-11-24 12:00:00", "2015-11-25 00:00:00").count() == 3
    assert realtime_xml.relevant(stored, "2015-11-24 00:00:00", "2015-11-24 23:00:00", "2015-11-25 00:00:00", "2015-11-26 00:00:00").count() == 0
    assert realtime_xml.purge(spark, at, "2015-11-24 09:59:59").count() == 3
    assert realtime_xml.purge(spark, at, "2015-11-24 10:00:00").count() == 0


def test_bike_snapshots(spark, tmp_path):
    place = lambda uid, bikes, spot: f'<place uid="{uid}" lat="49.5" lng="8.25" name="T{uid}" bikes="{bikes}" spot="{spot}"/>'
    (tmp_path / "bikes-1454603400.xml").write_text(f'<markers><country country="DE"><city>{place(1, "5+", 1)}{place(2, 3, 0)}</city><city>{place(3, "", 1)}</city></country><country country="AT"><city>{place(4, 2, 1)}</city></country></markers>')
    rows = sorted(map(tuple, realtime_xml.bike_snapshots(spark, str(tmp_path)).select("terminal", F.unix_timestamp("ts"), "lat", "bikes").collect()))
    assert rows == [("1", 1454603400, 49.5, 5), ("3", 1454603400, 49.5, 0)]


def test_routes_without_overtaking(spark):
    stop = lambda trip, times: [(trip, k, 10 + k, a, d) for k, (a, d) in enumerate(times)]
    rows = stop(1, [(0, 0), (20, 21)]) + stop(2, [(5, 5), (15, 16)]) + stop(3, [(8, 8), (30, 31)]) + stop(4, [(8, 8), (30, 31)]) + [(5, 0, 99, 0, 0), (5, 1, 11, 9, 9)]
    got = {r["trip_id"]: r["route"] for r in services.routes(spark.createDataFrame(rows, "trip_id long, seq long, station_id long, arr_min long, dep_min long")).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0}


def test_adjusted_footpath(spark):
    cases = [(5, 2, 3, 100.0, 5), (5, 2, 7, 100.0, 7), (5, 2, 3, 900.0, 10), (5, 2, 3, 901.0, None), (10, 2, 3, 1700.0, None), (16, 1, 1, 10.0, None)]
    df = spark.createDataFrame(cases, "d long, a long, b long, m double, want long")
    got = df.withColumn("got", services.adjusted_footpath(F.col("d"), F.col("a"), F.col("b"), F.col("m")))
    assert got.filter("NOT (got <=> want)").count() == 0


def feed(folder, **changes):
    """A small feed: two lines that meet, one extended route type, exceptions only for one service."""
    files = {
        "agency": "agency_id,agency_name,agency_timezone\nA,Line,Europe/Berlin\n",
        "stops": "stop_id,stop_name,stop_lat,stop_lon\nS1,One,50.0,8.0\nS2,Two,50.1,8.0\nS3,Three,50.2,8.0\nS4,Four,50.3,8.0\n",
        "routes": "route_id,agency_id,route_short_name,route_long_name,route_type\nR,A,1,Long,101\nQ,A,2,Bus,3\n",
        "trips": "route_id,service_id,trip_id,trip_headsign\nR,WD,T1,Two\nQ,X,T2,Four\n",
        "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence,pickup_type,drop_off_type\nT1,08:00:00,08:00:00,S1,1,0,0\nT1,08:20:00,08:21:00,S2,2,0,0\nT1,08:40:00,08:40:00,S3,3,0,0\nT2,08:50:00,08:50:00,S3,1,0,0\nT2,09:10:00,09:10:00,S4,2,0,0\n",
        "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nWD,1,1,1,1,1,0,0,20240101,20240131\n",
        "calendar_dates": "service_id,date,exception_type\nX,20240102,1\nX,20270102,1\nWD,20240103,2\n",
        "transfers": "from_stop_id,to_stop_id,transfer_type,min_transfer_time\nS2,S3,2,600\nS2,S3,2,60\nS3,S2,3,\n",
    } | changes
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        if text is not None:
            (folder / f"{name}.txt").write_text(text)
    return str(folder)


def test_feed_to_search(spark, tmp_path):
    from tramline.operators import query
    from tramline.sources import gtfs

    path = feed(tmp_path / "f")
    assert gtfs.applicable(spark, path)
    t = gtfs.timetable(gtfs.load(spark, path, strict=True), "2024-01-01", "2024-01-07")
    ids = {r.station_id: r.number for r in t["station"].collect()}
    days = {(r.trip_id, r.day) for r in t["conn"].select("trip_id", "day").distinct().collect()}
    trips = {r.trip_id: (r.trip_number, r.category, r.clasz) for r in t["trip"].collect()}
    assert {k: v[1:] for k, v in trips.items()} == {"T1": ("High Speed Rail", 0), "T2": ("Bus", 8)}
    assert days == {(trips["T1"][0], d) for d in (0, 1, 3, 4)} | {(trips["T2"][0], 1)}
    table = query.Timetable(t["conn"], t["footpath"])
    rows = query.answer(table, query.Query(ids["S1"], ids["S4"], 1440)).collect()
    assert [(r.departure, r.arrival, r.transfers) for r in rows] == [(1440 + 480, 1440 + 550, 1)]
    assert query.answer(table, query.Query(ids["S1"], ids["S4"], 3 * 1440)).count() == 0
    foot = {(r.a, r.b): r.dur for r in t["footpath"].collect()}
    assert foot[ids["S2"], ids["S3"]] == 10 and (ids["S3"], ids["S2"]) not in foot and foot[ids["S1"], ids["S1"]] == 5


def test_feed_files(spark, tmp_path):
    from tramline.sources import files, gtfs

    none = feed(tmp_path / "a", calendar=None, routes=None)
    assert gtfs.missing_files(spark, none) == ["routes.txt"]
    bare = feed(tmp_path / "b", calendar=None, calendar_dates=None)
    assert gtfs.missing_files(spark, bare) == ["calendar.txt", "calendar_dates.txt"] and not gtfs.applicable(spark, bare)
    with pytest.raises(FileNotFoundError, match="calendar"):
        gtfs.load(spark, bare, strict=True)
    only = feed(tmp_path / "c", calendar=None)
    assert {(r.service_id, str(r.day)) for r in gtfs.load(spark, only)["service_day"].collect()} == {("X", "2024-01-02"), ("X", "2027-01-02")}
    days = gtfs.service_days(gtfs.read(spark, none, "calendar_dates").limit(0).selectExpr("service_id", *[f"1 AS {d}" for d in gtfs.WEEKDAYS], "date AS start_date", "date AS end_date"), gtfs.read(spark, none, "calendar_dates"), "2024-01-01")
    assert [(r.service_id, str(r.day)) for r in days.collect()] == [("X", "2024-01-02")]  # the other lies beyond 512 days
    bad = feed(tmp_path / "d", trips="route_id,service_id,trip_id,trip_headsign\nZ,WD,T1,Two\n")
    with pytest.raises(ValueError, match="route_id: Z"):
        gtfs.load(spark, bad, strict=True)
    made = []

    def parse():
        made.append(1)
        return gtfs.load(spark, feed(tmp_path / "e"))

    first = files.cached(spark, str(tmp_path / "cache"), parse)
    again = files.cached(spark, str(tmp_path / "cache"), parse)
    assert len(made) == 1 and set(again) == set(first) and again["trip_stop"].count() == 5
    kinds = spark.createDataFrame([(t,) for t in (2, 102, 109, 400, 1501, 1700, 99)], "t int").select(gtfs.route_category(F.col("t")).alias("n"), gtfs.route_class(F.col("t")).alias("c"))
    assert [tuple(r) for r in kinds.collect()] == [("Rail", 4), ("Long Distance", 1), ("Suburban", 5), ("Urban", 6), ("Shared Taxi", 9), ("Other", 9), ("Other", 9)]


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode("latin-1"))
    return str(path)


def test_master_data(spark, tmp_path):
    fw = fixed_width
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    through = put(tmp_path / "d", "00101 80____ 1000003 00202 81____ 000007\n")
    assert rows(fw.through_rules(spark, through)) == [(1000003, 101, "80____", 202, "81____", 7)]
    atts = put(tmp_path / "a", "BR 0 560 10 Bordrestaurant#\nFR                   Fahrradmitnahme#\n# x\n")
    assert rows(fw.attributes(spark, atts)) == [("BR", "Bordrestaurant"), ("FR", "Fahrradmitnahme")]
    assert rows(fw.directions(spark, put(tmp_path / "r", "R000001 Ring West\n"))) == [("R000001", "Ring West")]
    provs = put(tmp_path / "u", "00001 K 'DB' L 'DB AG' V 'Deutsche Bahn AG'\n00001 : 80____ 81____\n00002 K KVB L \"Kölner VB\" V Koeln\n00002 : KVB___\n")
    assert rows(fw.providers(spark, provs)) == [("80____", "DB", "DB AG", "Deutsche Bahn AG"), ("81____", "DB", "DB AG", "Deutsche Bahn AG"), ("KVB___", "KVB", "Kölner VB", "Koeln")]
    tracks = fw.track_rules(spark, put(tmp_path / "g", "1000001 00101 80____ 7        0805 000003\n1000001 00101 80____ 8                   \n1000002 00101 80____ 9a           000000\n"))
    assert rows(tracks.select("eva", "track", "bitfield")) == [(1000001, "7", 3), (1000001, "8", 0), (1000002, "9a", 0)]
    stops = spark.createDataFrame([(1000001, 101, "80____", 1440 + 485), (1000001, 101, "80____", 500), (1000009, 101, "80____", 1)], "eva long, train_nr long, admin string, at long")
    assert {(r.eva, r.at, r.track) for r in fw.tracks_of(stops, tracks).collect()} == {(1000001, 1925, "7"), (1000001, 1925, "8"), (1000001, 500, "8"), (1000001, 500, None), (1000009, 1, None)}
    assert rows(fw.infotexts(spark, put(tmp_path / "i", "xx:yy:zz:1000001:AAA,BBB:rest of a longer line\nshort\n"))) == [("AAA", 1000001), ("BBB", 1000001)]
    first, last, name = fw.basic_data(spark, put(tmp_path / "e", "24.11.2015\r\n12.12.2015\r\nFahrplan 15\r\n"))
    assert (first, last, name) == (dt.date(2015, 11, 24), dt.date(2015, 12, 12), "Fahrplan 15")


def test_timezones(spark, tmp_path):
    # offset one hour; summer time of two hours from day 2, 02:00 to day 5, 03:00
    line = "0000000 +0100 +0200 26112015 0200 29112015 0300"
    zones = fixed_width.timezones(spark, put(tmp_path / "z", f"{line}\n1000000 +0000                                  \n2000000 0000000\n"), "2015-11-24")
    got = {r.eva: (r.utc_offset, r.season_offset, r.season_first, r.season_last) for r in zones.collect()}
    assert got == {0: (60, 120, 2, 5), 1000000: (0, None, None, None), 2000000: (60, 120, 2, 5)}
    rows = spark.createDataFrame([(5, 0, 600), (5, 2, 119), (5, 2, 130), (5, 2, 200), (5, 5, 100), (5, 5, 181), (1500000, 3, 600), (2000001, 3, 600)], "eva long, day long, local long")
    rows = fixed_width.with_timezone(rows, zones)
    utc = rows.withColumn("utc", fixed_width.to_utc(F.col("day"), F.col("local"))).withColumn("strict", fixed_width.to_utc(F.col("day"), F.col("local"), adjust=False))
    found = {(r.eva, r.day, r.local): (r.utc - r.day * 1440, None if r.strict is None else r.strict - r.day * 1440) for r in utc.collect()}
    assert found == {(5, 0, 600): (540, 540), (5, 2, 119): (59, 59), (5, 2, 130): (70, None), (5, 2, 200): (80, 80), (5, 5, 100): (-20, -20), (5, 5, 181): (121, 121), (1500000, 3, 600): (600, 600), (2000001, 3, 600): (480, 480)}
    back = utc.filter("strict IS NOT NULL").withColumn("l", fixed_width.to_local(F.col("strict")) - F.col("day") * 1440)
    assert back.filter("l <> local").count() == 0


def test_detection_and_service_days(spark, tmp_path):
    for n in ("eckdaten.101", "attributd_int.101", "bahnhof.101"):
        put(tmp_path / "s" / "stamm" / n, "x\n")
    dialect, found, gone = fixed_width.detect(spark, str(tmp_path / "s"))
    assert dialect == "5.00.8" and found["attributes"].endswith("attributd_int.101") and "fahrten" in gone and "zugart_int.101" in gone and "bahnhof.101" not in gone
    assert fixed_width.detect(spark, str(tmp_path))[2] == ["eckdaten.*"]
    put(tmp_path / "s.101", SERVICES)
    services = fixed_width.services(spark, str(tmp_path / "s.101")).withColumn("service", F.col("number"))
    days = spark.createDataFrame([(7, 1), (7, 2)], "bitfield long, day long")
    got = {(r.service, r.section, r.day) for r in fixed_width.service_days(services, days, 3).collect()}
    assert got == {(101, s, d) for s in (0, 1) for d in (1, 2)} | {(200, 0, d) for d in range(4)}
    zones = fixed_width.timezones(spark, put(tmp_path / "z", "0000000 +0100 +0200 26112015 0200 29112015 0300\n"), "2015-11-24")
    stops = services.select("service", F.explode("stops").alias("s")).select("service", "s.seq", "s.eva", "s.arr_min", "s.dep_min").filter("service = 101")
    utc = fixed_width.utc_services(stops, fixed_width.service_days(services, days, 3).select("service", "day"), zones)
    by = {}
    for r in utc.filter("seq = 0").collect():
        by.setdefault(r.variant, []).append((r.day, r.dep - r.day * 1440))
    assert sorted(by.values()) == [[(1, 425)], [(2, 365)]]  # before and in summer time
