"""Hourly figures of trips kept as a table of mergeable states, renewed only where rows came late.

A state is one row per hour and route with counts and sums, never means, so states of disjoint rows add up. On-time rows
are merged into the stored states without reading older trips; rows that were changed or removed name a range of hours
that is computed again. Hours after the stored ones are read live.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.schemas import ROUTE

#: Measure of the trip table and the name of its hourly mean.
MEASURES = {
    "duration_min": "avg_duration_min", "distance_km": "avg_distance_km", "temperature": "avg_temperature",
    "humidity": "avg_humidity", "traffic_delay_min": "avg_traffic_delay_min",
}
HIGH = "Alta demora"
CELL = ("hour", *ROUTE)
_SUMS = ["n", "high", *[f"{kind}_{m}" for m in MEASURES for kind in ("n", "sum")]]


def hourly_states(trips: DataFrame) -> DataFrame:
    """State of every hour and route of `trips` (datetime, origin, destination, mobility_level and the measures). Trips
    without a time belong to no hour; a null measure or an unknown level counts for `n` only."""
    rows = trips.filter(F.col("datetime").isNotNull()).withColumn("hour", F.date_trunc("hour", "datetime"))
    sums = [F.count("*").alias("n"), F.count_if(F.coalesce(F.col("mobility_level") == HIGH, F.lit(False))).alias("high")]
    for m in MEASURES:
        sums += [F.count(m).alias(f"n_{m}"), F.sum(F.col(m).cast("double")).alias(f"sum_{m}")]
    return rows.groupBy(*CELL).agg(*sums)


def merged(*states: DataFrame) -> DataFrame:
    """One state per hour and route from states of disjoint rows."""
    every = reduce(DataFrame.unionByName, [s.select(*CELL, *_SUMS) for s in states])
    return every.groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in _SUMS])


def figures(states: DataFrame) -> DataFrame:
    """Hourly figures of the states: trips, means, and the share of high-delay trips in percent with one digit."""
    means = [(F.col(f"sum_{m}") / F.nullif(F.col(f"n_{m}"), F.lit(0))).alias(name) for m, name in MEASURES.items()]
    return states.filter("n > 0").select(
        *CELL, F.col("n").alias("num_trips"), *means, F.round(100.0 * F.col("high") / F.col("n"), 1).alias("pct_alta_demora")
    )


def touched_hours(changed: DataFrame) -> DataFrame:
    """First and last hour (`low`, `high`) that the rows of `changed` lie in: one row, nulls where there are none."""
    hour = F.date_trunc("hour", "datetime")
    return changed.agg(F.min(hour).alias("low"), F.max(hour).alias("high"))


def _instant(moment: datetime) -> Column:
    """A moment without a zone is in the zone of the session, as the hours are."""
    return F.lit(moment) if moment.tzinfo else F.lit(moment.isoformat(sep=" ")).cast("timestamp")


def _within(column: str, low: datetime, high: datetime) -> Column:
    first, last = F.date_trunc("hour", _instant(low)), F.date_trunc("hour", _instant(high))
    return (F.col(column) >= first) & (F.col(column) < last + F.expr("INTERVAL 1 HOUR"))


def recomputed(states: DataFrame, trips: DataFrame, low: datetime, high: datetime) -> DataFrame:
    """The states with the hours from `low` to `high` (whole hours, both included) taken from `trips` again. The range is a
    filter on `datetime` alone, so that it reaches the scan of `trips`."""
    fresh = hourly_states(trips.filter(_within("datetime", low, high)))
    return states.filter(~_within("hour", low, high)).select(*CELL, *_SUMS).unionByName(fresh)


def live(states: DataFrame, trips: DataFrame, until: datetime) -> DataFrame:
    """Figures of the stored hours before `until` and, from the trips themselves, of the hours from `until` on."""
    edge = F.date_trunc("hour", _instant(until))
    return figures(states.filter(F.col("hour") < edge).select(*CELL, *_SUMS).unionByName(hourly_states(trips.filter(F.col("datetime") >= edge))))


# --- stored table ----------------------------------------------------------------------------------------------------
def _replace_days(states: DataFrame, days: DataFrame, path: str) -> None:
    """Write the days of `days` (column `day`) and no others. A marker row without trips stands in each, so that a day that
    lost all its trips is replaced as well."""
    marker = days.select(F.col("day").cast("timestamp").alias("hour"), *[F.lit(None).cast("string").alias(c) for c in ROUTE],
                         *[F.lit(0).cast("double" if c.startswith("sum_") else "long").alias(c) for c in _SUMS])
    rows = states.select(*CELL, *_SUMS).unionByName(marker).withColumn("day", F.to_date("hour"))
    rows.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def refresh(spark: SparkSession, trips: DataFrame, path: str, low: datetime, high: datetime) -> None:
    """Compute the days of the range from `low` to `high` again and replace them in the table at `path`, which need not exist.

    Only these days of `trips` are read and only these partitions are written, so that a second attempt gives the same."""
    first, last = F.to_date(_instant(low)), F.to_date(_instant(high))
    days = spark.range(1).select(F.explode(F.sequence(first, last)).alias("day"))
    part = trips.filter((F.col("datetime") >= first.cast("timestamp")) & (F.col("datetime") < F.date_add(last, 1).cast("timestamp")))
    _replace_days(hourly_states(part), days, path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The states of the table at `path`, markers left out."""
    return spark.read.parquet(path).filter("n > 0").select(*CELL, *_SUMS)
