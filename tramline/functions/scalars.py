"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Walking and cycling speed (m/s) and the detour factor of straight lines.
WALK_SPEED, BIKE_SPEED, DETOUR = 1.5, 3.5, 1.5
#: The earth's radius used for fares, in kilometres.
FARE_EARTH_KM = 6367.0


def minute_of_day(t: Column) -> Column:
    return F.pmod(t, F.lit(1440))


def day_of(t: Column) -> Column:
    return F.floor(t / F.lit(1440)).cast("long")


def hhmm_to_minutes(x: Column) -> Column:
    """hhmm as a number to minutes after midnight."""
    return F.floor(x / 100) * 60 + x % 100


def hms_to_minutes(text: Column) -> Column:
    """'[H]H:MM:SS' to minutes; seconds are dropped; empty text is null."""
    return F.when(F.trim(text) != "", F.split(text, ":")[0].cast("long") * 60 + F.split(text, ":")[1].cast("long"))


def overlap_per_day(a: Column, b: Column, lo: int, hi: int) -> Column:
    """Minutes of [a, b) that lie in the daily window [lo, hi); a window over midnight (lo > hi) is [lo, 24:00) and [0:00, hi)."""
    if lo > hi:
        return overlap_per_day(a, b, lo, 1440) + overlap_per_day(a, b, 0, hi)
    upto = lambda t: F.floor(t / 1440) * (hi - lo) + F.least(F.greatest(F.pmod(t, F.lit(1440)) - lo, F.lit(0)), F.lit(hi - lo))
    return (upto(b) - upto(a)).cast("long")


def periodic_wait(begin: Column, end: Column, t: Column) -> Column:
    """Minutes from t until the daily window begin..end (which may pass midnight) is open."""
    m = minute_of_day(t)
    inside = F.when(begin <= end, (m >= begin) & (m <= end)).otherwise((m >= begin) | (m <= end))
    return F.when(inside, F.lit(0)).otherwise(F.pmod(begin - m, F.lit(1440)))


def hotel_stay(arrive: Column, checkout: int = 420, least: int = 360) -> Column:
    """Minutes from arrival until the first checkout after a least stay."""
    gap = F.pmod(F.lit(checkout) - minute_of_day(arrive), F.lit(1440))
    gap = F.when(gap == 0, F.lit(1440)).otherwise(gap)
    return F.when(gap < least, F.lit(least)).otherwise(gap)


def capped_fare(regional: Column, other: Column, cap: int = 4200) -> Column:
    return F.least(regional, F.lit(cap)) + other


#: Taxi fare, speeds and its city part; highest train fare, cents per kilometre and factors by class.
TAXI_BASE, TAXI_PER_KM, TAXI_MINUTES, TAXI_CITY_KMH, TAXI_FAR_KMH, CITY_KM, STREETS = 250, 200, 10, 40, 100, 5.0, 1.5
MOST_FARE, FARE_PER_KM, FARE_FACTORS = 12300, 30.0, {4: 1.5, 3: 1.2, 2: 1.1}


def taxi_minutes(km: Column) -> Column:
    """Duration of a taxi ride over a straight distance: city streets for the first kilometres, then faster ones."""
    city, far = F.least(km, F.lit(CITY_KM)) * STREETS, F.greatest(km - CITY_KM, F.lit(0.0)) * STREETS
    return F.floor(TAXI_MINUTES + (city / TAXI_CITY_KMH + far / TAXI_FAR_KMH) * 60).cast("long")


def taxi_cents(km: Column) -> Column:
    return F.floor(TAXI_BASE + km * STREETS * TAXI_PER_KM).cast("long")


def train_cents(km: Column, highest_class: Column) -> Column:
    """Estimated fare of a journey by the straight distance of its ends and its highest class."""
    factor = F.lit(1.0)
    for k, f in FARE_FACTORS.items():
        factor = F.when(highest_class == k, F.lit(f)).otherwise(factor)
    return F.least(F.floor(km * factor * FARE_PER_KM), F.lit(MOST_FARE)).cast("long")


def taxi_city(station_id: Column) -> Column:
    """Whether late journeys may end in a taxi from there: stations of larger places, numbered 80..."""
    return station_id.cast("string").startswith("80")


def local_time(ts: Column, zone: str = "Europe/Berlin") -> Column:
    return F.from_utc_timestamp(ts, zone)


def floor_to(x: Column, step: int) -> Column:
    return F.floor(x / step) * step


def ceil_to(x: Column, step: int) -> Column:
    return F.ceil(x / step) * step


def padded_eva(x: Column) -> Column:
    """A station number as seven digits."""
    return F.lpad(x.cast("string"), 7, "0")


def bits_of(days: Column) -> Column:
    """A day set (array of day numbers) as text of 0 and 1, the first day first."""
    last = F.array_max(days)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.coalesce(last, F.lit(0)).cast("int")), lambda d: F.when(F.array_contains(days, d.cast("long")), "1").otherwise("0")), "")


def shifted_days(days: Column, by: Column) -> Column:
    """A day set ``by`` days later; days before the first fall away."""
    return F.filter(F.transform(days, lambda d: d + by), lambda d: d >= 0)


def compensation(price: Column, delay: Column) -> Column:
    """A quarter of the price from 60 minutes of delay, half of it from 120."""
    return F.when(delay >= 120, F.floor(price / 2)).when(delay >= 60, F.floor(price / 4)).otherwise(F.lit(0)).cast("long")


def service_name(category: Column, line: Column, number: Column, rule: Column) -> Column:
    """Display name by output-rule bits: 1 = category, 2 = line, 4 = train number."""
    part = lambda bit, c: F.when(rule.bitwiseAND(F.lit(bit)) > 0, c.cast("string"))
    return F.trim(F.concat_ws(" ", part(1, category), part(2, line), part(4, number)))
