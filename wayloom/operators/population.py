"""Population series: diagnosis, latest observations and projection to one common year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.operators.chunks import with_one_row


def years_by_zone(history: DataFrame) -> DataFrame:
    return history.groupBy("zone").agg(
        F.count("*").alias("observations"),
        F.count_distinct("year").alias("years"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
    )


def common_years(history: DataFrame, zones: DataFrame) -> DataFrame:
    """Years observed in every zone; a zone without data leaves none."""
    wanted = zones.select("zone").distinct()
    total = wanted.agg(F.count("*").alias("zones"))
    known = history.join(wanted, "zone", "left_semi").filter(F.col("year").isNotNull())
    per_year = known.groupBy("year").agg(F.count_distinct("zone").alias("zones"))
    return per_year.join(total, "zones").select("year")


def national_range(national: DataFrame) -> DataFrame:
    return national.agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_distinct("year").alias("years"),
        F.min("population").alias("min_population"), F.max("population").alias("max_population"),
    )


def latest_observation(history: DataFrame) -> DataFrame:
    """The observation with the highest year of each zone, the later date on a tie."""
    rest = F.struct("date", "year", "population", "source")
    order = F.struct(F.col("year").isNotNull(), F.coalesce("year", F.lit(-1)), "date", "source")
    return history.groupBy("zone").agg(F.max_by(rest, order).alias("r")).select("zone", "r.*")


def reconcile(history: DataFrame, national: DataFrame, target_year: int | None = None) -> DataFrame:
    """Latest observation of each zone at one common year, projected with the national growth between the two years.

    `national` has one row per year. Zones without a year, and years without a national figure, give no row."""
    national = national.filter(F.col("year").isNotNull())
    figures = national.groupBy("year").agg(F.max_by("population", "date").alias("population"))
    target = (
        figures.agg(F.max("year").alias("target"))
        if target_year is None
        else figures.agg(F.lit(target_year).alias("target"))
    )
    zones = latest_observation(history).filter(F.col("year").isNotNull())
    joined = (
        with_one_row(zones, target)
        .join(figures.select(F.col("year"), F.col("population").alias("_then")), "year", "left")
        .join(figures.select(F.col("year").alias("target"), F.col("population").alias("_at_target")), "target", "left")
    )
    observed = F.col("year") >= F.col("target")
    projected = F.when(observed, F.col("population")).otherwise(
        F.bround(F.col("population") * (F.col("_at_target") / F.col("_then"))).cast("bigint")
    )
    return joined.withColumn("_p", projected).filter(F.col("_p").isNotNull()).select(
        "zone",
        F.col("_p").alias("population"),
        F.col("target").cast("string").alias("observation_date"),
        "source",
        F.col("year").alias("basis_year"),
        F.col("population").alias("basis_population"),
        F.when(observed, "observed").otherwise("national_growth_adjustment").alias("method"),
    )
