"""Column expressions for measurements, calendar, quality, geometry and labels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide results and must not drift.
PEAK_HOURS = (7, 8, 9, 17, 18, 19)
WEEKEND_DAYS = (5, 6)
TRAVEL_TIME_MIN, TRAVEL_TIME_MAX = 0.0, 500.0
HIGH_DELAY_OVER_MIN = 20.0
STALE_AFTER_MIN = 90
EARTH_RADIUS_M = 6371000.0


def finite(x: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def parse_instant(text: Column) -> Column:
    """Text with 'T' or space between date and time, to a timestamp; unreadable text gives NULL."""
    return F.try_to_timestamp(text)


def parse_number(text: Column) -> Column:
    return text.try_cast("double")


def traffic_delay(travel: Column, free: Column) -> Column:
    """Minutes above the free-flow time, never negative; unknown free-flow time keeps the delay unknown."""
    return F.when(travel.isNotNull() & free.isNotNull(), F.greatest(travel - free, F.lit(0.0)))


def congestion_level(delay: Column) -> Column:
    return (
        F.when(delay.isNull(), "unknown")
        .when(delay <= 1, "free_flow")
        .when(delay <= 4, "moderate")
        .otherwise("heavy")
    )


def mobility_level(travel: Column) -> Column:
    return F.when(travel > HIGH_DELAY_OVER_MIN, "Alta demora").otherwise("Movilidad normal")


def weekday0(ts: Column) -> Column:
    """0 = Monday."""
    return F.weekday(ts)


def is_peak(hour: Column) -> Column:
    return hour.isin(*PEAK_HOURS).cast("int")


def is_weekend(day: Column) -> Column:
    return day.isin(*WEEKEND_DAYS).cast("int")


def cyclic_hour(hour: Column) -> tuple[Column, Column]:
    angle = hour * F.lit(2 * math.pi / 24)
    return F.sin(angle), F.cos(angle)


def iso_year_week(ts: Column) -> Column:
    return F.concat_ws("-", F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def quality_score(present: dict[str, Column], optional: dict[str, Column], travel: Column) -> Column:
    """0..100: each missing required field costs 10, a travel time outside (0, 500) 20, each missing optional field 2."""
    score = F.lit(100.0)
    for value in present.values():
        score = score - F.when(value.isNull(), 10.0).otherwise(0.0)
    in_range = (travel > TRAVEL_TIME_MIN) & (travel < TRAVEL_TIME_MAX)
    score = score - F.when(F.coalesce(in_range, F.lit(False)), 0.0).otherwise(20.0)
    for value in optional.values():
        score = score - F.when(value.isNull(), 2.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


# Provider descriptions and the group they belong to.
WEATHER_GROUPS = {
    "clear sky": "despejado",
    "few clouds": "parcialmente_nublado",
    "scattered clouds": "parcialmente_nublado",
    "broken clouds": "nublado",
    "overcast clouds": "nublado",
}


def weather_group(text: Column) -> Column:
    """Groups provider descriptions; a text outside the list counts as rain, NULL stays NULL."""
    table = F.create_map(*[F.lit(x) for pair in WEATHER_GROUPS.items() for x in pair])
    return F.when(text.isNotNull(), F.coalesce(F.try_element_at(table, text), F.lit("lluvia")))


def delay_label(delay: Column) -> Column:
    """Traffic state by delay in minutes."""
    return F.when(delay <= 1, "Free Flow").when(delay <= 4, "Moderate").when(delay.isNotNull(), "Heavy")


def status_label(delay: Column, age_min: Column, stale_after: int = STALE_AFTER_MIN) -> Column:
    """State of a route from its last reading with traffic: none, too old, or by delay."""
    return (
        F.when(age_min.isNull(), "Sin dato de tráfico")
        .when(age_min > stale_after, "Lectura desactualizada")
        .otherwise(delay_label(delay))
    )


def age_text(age_min: Column) -> Column:
    return (
        F.when(age_min.isNull(), "nunca")
        .when(age_min < 90, F.format_string("hace %.0f min", F.greatest(age_min, F.lit(0.0))))
        .when(age_min < 60 * 48, F.format_string("hace %.1f h", age_min / 60))
        .otherwise(F.format_string("hace %.1f días", age_min / 1440))
    )


def duration_text(hours: Column) -> Column:
    """Hours up to two days, days from there."""
    return F.when(hours >= 48, F.format_string("%.1f d", hours / 24)).otherwise(F.format_string("%.1f h", hours))


def consistency_score(rows: Column, low: Column, high: Column, mean: Column) -> Column:
    """100 / 85 / 70 / 50 / 25 by spread as a percentage of the mean; fewer than five rows give 0."""
    spread = (high - low) / F.nullif(mean, F.lit(0.0)) * 100
    return (
        F.when(rows < 5, 0)
        .when(mean.isNull() | (mean == 0), 0)
        .when(spread < 10, 100)
        .when(spread < 20, 85)
        .when(spread < 30, 70)
        .when(spread < 50, 50)
        .otherwise(25)
    )


def evidence_text(p: Column) -> Column:
    return (
        F.when(p < 0.001, "Very strong evidence")
        .when(p < 0.01, "Strong evidence")
        .when(p < 0.05, "Moderate evidence")
        .otherwise("Weak evidence")
    )


def cohens_d_text(d: Column) -> Column:
    return F.when(d < 0.2, "negligible").when(d < 0.5, "small").when(d < 0.8, "medium").otherwise("large")


def route_label(origin: Column, destination: Column) -> Column:
    return F.concat_ws(" → ", origin, destination)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    rad = math.pi / 180
    half_lat = F.sin((lat2 - lat1) * F.lit(rad) / 2)
    half_lon = F.sin((lon2 - lon1) * F.lit(rad) / 2)
    a = half_lat * half_lat + F.cos(lat1 * F.lit(rad)) * F.cos(lat2 * F.lit(rad)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def poisson_deviance(y: Column, mu: Column, floor: float = 1e-3) -> Column:
    m = F.greatest(mu, F.lit(floor))
    return F.when(y > 0, 2 * (y * F.log(y / m) - (y - m))).otherwise(2 * m)


def relative_gap(expected: Column, observed: Column) -> Column:
    return (expected - observed) / F.sqrt(expected + 1)


def shown(x: Column, digits: int = 6) -> Column:
    """Rounded value for a published table. The tiny shift keeps exact halves from depending on summation order."""
    return F.round(x + F.lit(1.3e-8), digits)
