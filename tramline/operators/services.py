"""Service-level operators: repetition, day sets, routes without overtaking, footpath checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import WALK_SPEED

#: Fixed value: footpaths longer than this many minutes are dropped.
LONGEST_WALK = 15


def repeat(stops: DataFrame, times: Column, every: Column) -> DataFrame:
    """Each trip ``times`` more times, ``every`` minutes apart; ``run`` counts from 0."""
    rows = stops.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), times.cast("long")))).withColumn("_by", F.col("run") * every)
    return rows.withColumn("arr_min", F.col("arr_min") + F.col("_by")).withColumn("dep_min", F.col("dep_min") + F.col("_by")).drop("_by")


def day_set_runs(sections: DataFrame, days: str = "days") -> DataFrame:
    """(trip_id, days, first, last): longest runs of consecutive sections with equal day sets."""
    w = Window.partitionBy("trip_id", days).orderBy("seq")
    rows = sections.withColumn("_run", F.col("seq") - F.row_number().over(w))
    return rows.groupBy("trip_id", days, "_run").agg(F.min("seq").alias("first"), F.max("seq").alias("last")).drop("_run")


def adjusted_footpath(duration: Column, transfer_a: Column, transfer_b: Column, meters: Column) -> Column:
    """Minutes of a footpath: at least both transfer times, null if the distance can't be walked in
    twice that or it takes over ``LONGEST_WALK``; re-timed where the distance takes longer."""
    d = F.greatest(duration, transfer_a, transfer_b)
    reach = d * 60 * WALK_SPEED
    timed = F.when(meters > reach, F.round(meters / (60 * WALK_SPEED)).cast("long")).otherwise(d)
    return F.when((meters <= 2 * reach) & (timed <= LONGEST_WALK), timed)


def routes(stops: DataFrame) -> DataFrame:
    """(trip_id, route): trips of one station sequence that never overtake each other share a route.

    A trip joins the first route in which each of its times lies strictly between its neighbours'.
    Routes are told apart by sequence and number; sequences are dealt by their hash.
    """
    one = stops.groupBy("trip_id").agg(F.sort_array(F.collect_list(F.struct("seq", "station_id", "arr_min", "dep_min"))).alias("s"))
    seqs = one.select("trip_id", F.xxhash64(F.to_json("s.station_id")).alias("sequence"), F.flatten(F.transform("s", lambda x: F.array(x["arr_min"], x["dep_min"]))).alias("times"))

    def color(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[list] = []
        out = []
        order = rows.assign(first=[t[0] for t in rows["times"]]).sort_values(["first", "trip_id"])
        for trip, times in zip(order["trip_id"], order["times"], strict=True):
            # trips come by first time, so only the last trip of a route can be met
            k = next((k for k, last in enumerate(kept) if all(a < b for a, b in zip(last, times, strict=True))), len(kept))
            if k == len(kept):
                kept.append(times)
            else:
                kept[k] = times
            out.append((trip, k))
        return pd.DataFrame({"trip_id": [o[0] for o in out], "sequence": rows["sequence"].iloc[0], "route": [o[1] for o in out]})

    return seqs.groupBy("sequence").applyInPandas(color, "trip_id long, sequence long, route long")


# --- day sets -----------------------------------------------------------------------------------


def days_in_both(one: DataFrame, other: DataFrame) -> DataFrame:
    """(service_id, day) of both calendars, each once."""
    return one.select("service_id", "day").intersect(other.select("service_id", "day"))


def days_only_in(one: DataFrame, other: DataFrame) -> DataFrame:
    """(service_id, day) of the first calendar that the second lacks, each once."""
    return one.select("service_id", "day").subtract(other.select("service_id", "day"))


def days_in_one(one: DataFrame, other: DataFrame) -> DataFrame:
    """(service_id, day, side): days of one calendar only; side tells which."""
    return days_only_in(one, other).withColumn("side", F.lit(1)).unionByName(days_only_in(other, one).withColumn("side", F.lit(2)))


def day_groups(runs: DataFrame, same: list[str]) -> DataFrame:
    """``same`` and ``days``: the days (0 to 62) on which rows (``same``, day) are alike, as bits."""
    days = runs.select(*same, "day").distinct()
    return days.groupBy(*same).agg(F.sum(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("day").cast("int"))).alias("days"))


def continuations(ends: DataFrame, begins: DataFrame, slot: int = 10) -> DataFrame:
    """(trip_id, next_trip, days): trips that end where another begins, no later and in the same slot of minutes, on common days.

    Both sides have (trip_id, station_id, at, days as bits).
    """
    a = ends.select("trip_id", "station_id", F.floor(F.col("at") / slot).alias("_slot"), F.col("at").alias("_came"), F.col("days").alias("_days"))
    b = begins.select(F.col("trip_id").alias("next_trip"), "station_id", F.floor(F.col("at") / slot).alias("_slot"), "at", "days")
    common = F.col("_days").bitwiseAND(F.col("days"))
    return a.join(b, ["station_id", "_slot"]).filter((F.col("_came") <= F.col("at")) & (common != 0) & (F.col("trip_id") != F.col("next_trip"))).select("trip_id", "next_trip", common.alias("days"))


# --- rule services ------------------------------------------------------------------------------


def through_pairs(services: DataFrame, days: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, service_1, service_2, eva, day): service 1 ends at the rule's station with its number and admin, service 2 has a
    section from there with the other's, and both and the rule run on the day.

    ``services`` (service, seq, eva, train_nr, admin, last) per stop, ``days`` (service, day), ``rules`` (rule, eva,
    number_1, admin_1, number_2, admin_2, day).
    """
    first = services.filter("last").select(F.col("service").alias("service_1"), "eva", F.col("train_nr").alias("number_1"), F.col("admin").alias("admin_1"))
    second = services.filter("NOT last").select(F.col("service").alias("service_2"), "eva", F.col("train_nr").alias("number_2"), F.col("admin").alias("admin_2")).distinct()
    rows = rules.join(first, ["eva", "number_1", "admin_1"]).join(second, ["eva", "number_2", "admin_2"])
    on = lambda s: days.select(F.col("service").alias(s), "day")
    return rows.join(on("service_1"), ["service_1", "day"]).join(on("service_2"), ["service_2", "day"]).select("rule", "service_1", "service_2", "eva", "day").filter("service_1 <> service_2").distinct()


def merge_split_pairs(services: DataFrame, days: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, service_1, service_2, eva_begin, eva_end, day): two services that call at both stations in order, with the
    rule's numbers and admins there and equal times between, on a day that all share."""
    at = lambda n, e, end: services.select(F.col("service").alias(f"service_{n}"), F.col("eva").alias(e), F.col("seq").alias(f"_{end}{n}"), F.col("train_nr").alias(f"number_{n}"), F.col("admin").alias(f"admin_{n}"), F.col("dep_min" if end == "b" else "arr_min").alias(f"_t{end}{n}"))
    rows = rules
    for n in (1, 2):
        rows = rows.join(at(n, "eva_begin", "b"), ["eva_begin", f"number_{n}", f"admin_{n}"])
        ends = at(n, "eva_end", "e").drop(f"number_{n}", f"admin_{n}")
        rows = rows.join(ends, ["eva_end", f"service_{n}"]).filter(F.col(f"_b{n}") < F.col(f"_e{n}"))
    rows = rows.filter((F.col("_tb1") == F.col("_tb2")) & (F.col("_te1") == F.col("_te2")) & (F.col("service_1") < F.col("service_2")))
    on = lambda s: days.select(F.col("service").alias(s), "day")
    return rows.join(on("service_1"), ["service_1", "day"]).join(on("service_2"), ["service_2", "day"]).select("rule", "service_1", "service_2", "eva_begin", "eva_end", "day").distinct()


def rule_services(pairs: DataFrame, days: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((group, services, rules, days), (service, day) left): services that run as one on the same days, and the rest.

    On each day the services that rules connect are one component; days whose components have the
    same services and rules form one group.  Those days are taken from the services.
    """
    from .relational import connected

    c = connected(pairs.select("day", F.col("service_1").alias("a"), F.col("service_2").alias("b")), ["day"])
    rules = pairs.join(c.select("day", F.col("node").alias("service_1"), "component"), ["day", "service_1"]).groupBy("day", "component").agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    members = c.groupBy("day", "component").agg(F.array_sort(F.collect_set("node")).alias("services"))
    groups = members.join(rules, ["day", "component"]).groupBy("services", "rules").agg(F.array_sort(F.collect_set("day")).alias("days"))
    groups = groups.select(F.xxhash64("services", "rules").alias("group"), "services", "rules", "days")
    taken = c.select(F.col("node").alias("service"), "day").distinct()
    return groups, days.join(taken, ["service", "day"], "left_anti")


def trip_links(pairs: DataFrame, trips: DataFrame) -> DataFrame:
    """(trip_id, day, next_trip): through pairs as links of trips (service, trip_id), for the search to stay seated."""
    t = lambda s, out: trips.select(F.col("service").alias(s), F.col("trip_id").alias(out))
    return pairs.join(t("service_1", "trip_id"), "service_1").join(t("service_2", "next_trip"), "service_2").select("trip_id", "day", "next_trip").distinct()


def ranges(stops: DataFrame, asked: DataFrame) -> DataFrame:
    """(service, key, first, last): section ranges given by index, station, nth station or time.

    ``asked`` has (service, key, from_eva, from_index, from_time, to_eva, to_index, to_time): an index counts stops
    (nth of the station where one is named); a time picks the stop of the station that departs (arrives) then; without any
    the range is open to the service's end.
    """
    w = Window.partitionBy("service", "eva").orderBy("seq")
    s = stops.withColumn("_nth", F.row_number().over(w))
    n = stops.groupBy("service").agg(F.max("seq").alias("_n"))

    def end(rows: DataFrame, side: str, time: str, out: str) -> DataFrame:
        eva, index, at = (F.col(f"{side}_{x}") for x in ("eva", "index", "time"))
        mine = s.select(F.col("service").alias("_s"), F.col("eva").alias("_e"), F.col("seq").alias("_q"), "_nth", F.col(time).alias("_t"))
        hit = (F.col("service") == F.col("_s")) & (eva == F.col("_e")) & F.when(at.isNotNull(), F.col("_t") == at).otherwise(F.col("_nth") == F.coalesce(index, F.lit(1)))
        rows = rows.join(mine, hit, "left").withColumn(out, F.when(eva.isNull(), index).otherwise(F.col("_q")))
        return rows.drop("_s", "_e", "_q", "_nth", "_t")

    rows = end(end(asked, "from", "dep_min", "first"), "to", "arr_min", "last").join(n, "service")
    return rows.select("service", "key", F.coalesce("first", F.when(F.col("from_eva").isNull(), F.lit(0))).alias("first"), F.coalesce("last", F.when(F.col("to_eva").isNull(), F.col("_n"))).alias("last")).filter("first IS NOT NULL AND last IS NOT NULL AND first < last")
