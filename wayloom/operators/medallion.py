"""Bronze, silver and gold tables of route measurements."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions import scalars as S
from wayloom.operators.chunks import exact_percentiles
from wayloom.schemas import BRONZE, MEASUREMENT_KEY, ROUTE, SILVER, conform, require_columns

RELIABILITY_PER_STD = 2.0
OPTIONAL_FIELDS = ["origin_temperature", "origin_humidity", "destination_temperature", "destination_humidity"]


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in ingest order. The rank filter is applied before the exchange as well, so a key with
    very many copies sends one row per task."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rn", rank).filter(F.col("_rn") == 1).drop("_rn")


def insert_absent(new: DataFrame, existing: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows of `new` whose key is not in `existing` yet."""
    return new.join(existing.select(*key), list(key), "left_anti")


def _parsed(raw: DataFrame) -> DataFrame:
    text = dict(raw.dtypes)
    instant = F.col("timestamp")
    if text["timestamp"] == "string":
        instant = S.parse_instant(instant).cast("timestamp_ntz")
    travel = F.col("travel_time_min")
    if text["travel_time_min"] == "string":
        travel = S.parse_number(travel)
    return raw.withColumns({"timestamp": instant, "travel_time_min": S.finite(travel)})


def _row_quality() -> Column:
    present = {c: F.col(c) for c in [*MEASUREMENT_KEY, "travel_time_min"]}
    return S.quality_score(present, {c: F.col(c) for c in OPTIONAL_FIELDS}, F.col("travel_time_min"))


def bronze_audit(raw: DataFrame, order: Sequence[str]) -> DataFrame:
    """Every raw row with the reason it is left out of bronze (NULL = accepted) and its quality score.

    The first row of a key comes from an aggregate, so a key with very many rows (one without an instant, say) is folded
    before the exchange; `order` tells the rows of a key apart."""
    require_columns(raw, [*MEASUREMENT_KEY, "travel_time_min"])
    place = F.struct(*order)
    first = raw.groupBy(*[F.col(c).alias(f"_k_{c}") for c in MEASUREMENT_KEY]).agg(F.min(place).alias("_first"))
    same_key = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in MEASUREMENT_KEY])
    placed = raw.join(first, same_key).withColumn("_copy", ~place.eqNullSafe(F.col("_first")))
    rows = _parsed(placed.drop("_first", *[f"_k_{c}" for c in MEASUREMENT_KEY]))
    for c in OPTIONAL_FIELDS:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("double"))
    missing = F.lit(False)
    for c in [*MEASUREMENT_KEY, "travel_time_min"]:
        missing = missing | F.col(c).isNull()
    reason = (
        F.when(F.col("_copy"), "duplicate")
        .when(missing, "missing")
        .when(~F.col("travel_time_min").between(S.TRAVEL_TIME_MIN, S.TRAVEL_TIME_MAX), "out_of_bounds")
    )
    return rows.withColumns({"reason": reason, "data_quality_score": _row_quality()}).drop("_copy")


def bronze(raw: DataFrame, order: Sequence[str], ingested_at: str | None = None) -> DataFrame:
    """Validated rows: first copy of each key, parsed, complete in the key columns, within bounds, scored."""
    require_columns(raw, [*MEASUREMENT_KEY, "travel_time_min"])
    rows = _parsed(keep_first(raw, MEASUREMENT_KEY, order)).na.drop(subset=[*MEASUREMENT_KEY, "travel_time_min"])
    rows = rows.filter(F.col("travel_time_min").between(S.TRAVEL_TIME_MIN, S.TRAVEL_TIME_MAX))
    for c in OPTIONAL_FIELDS:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("double"))
    rows = rows.withColumns(
        {
            "data_quality_score": _row_quality(),
            "ingestion_timestamp": F.lit(ingested_at).cast("timestamp"),
            "validation_status": F.lit("validated"),
        }
    ).withColumnRenamed("timestamp", "raw_timestamp")
    return conform(rows, BRONZE)


def bronze_summary(audit: DataFrame) -> DataFrame:
    """Counts of accepted and rejected rows and the mean score of the accepted ones, in one pass."""
    accepted = F.col("reason").isNull()
    return audit.agg(
        F.count("*").alias("original_records"),
        F.count_if(accepted).alias("inserted_records"),
        F.count_if(~accepted).alias("removed_records"),
        F.count_if(F.col("reason") == "duplicate").alias("duplicates"),
        F.count_if(F.col("reason") == "missing").alias("missing_critical"),
        F.count_if(F.col("reason") == "out_of_bounds").alias("outliers"),
        F.coalesce(F.avg(F.when(accepted, F.col("data_quality_score"))), F.lit(0.0)).alias("quality_score"),
    )


def silver(bronze_rows: DataFrame, transformed_at: str | None = None) -> DataFrame:
    """Delay, congestion and calendar columns. Without a no-traffic column the delay is 0; a NULL in it stays NULL."""
    rows = bronze_rows.withColumnRenamed("raw_timestamp", "timestamp")
    travel = F.col("travel_time_min")
    delay = (
        S.traffic_delay(travel, F.col("no_traffic_time_min"))
        if "no_traffic_time_min" in rows.columns
        else F.when(travel.isNotNull(), F.lit(0.0))
    )
    ts = F.col("timestamp")
    rows = rows.withColumns(
        {
            "traffic_delay_min": delay,
            "hour": F.hour(ts),
            "day_of_week": S.weekday0(ts),
            "day_of_month": F.dayofmonth(ts),
            "month": F.month(ts),
            "transformation_timestamp": F.lit(transformed_at).cast("timestamp"),
        }
    ).withColumns(
        {
            "congestion_level": S.congestion_level(F.col("traffic_delay_min")),
            "is_peak_hour": S.is_peak(F.col("hour")),
            "is_weekend": S.is_weekend(F.col("day_of_week")),
        }
    )
    return conform(rows, SILVER)


def route_hourly(silver_rows: DataFrame) -> DataFrame:
    """Per hour and route: mean, median, sample deviation, range, count and mean speed."""
    rows = silver_rows.select(
        F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("hour_start"), *ROUTE, "travel_time_min", "average_speed_kmh"
    )
    key = ["hour_start", *ROUTE]
    stats = rows.groupBy(*key).agg(
        F.avg("travel_time_min").alias("avg_travel_time"),
        F.stddev_samp("travel_time_min").alias("std_travel_time"),
        F.min("travel_time_min").alias("min_travel_time"),
        F.max("travel_time_min").alias("max_travel_time"),
        F.count("travel_time_min").alias("sample_count"),
        F.avg("average_speed_kmh").alias("avg_speed"),
    )
    medians = exact_percentiles(rows, key, "travel_time_min", {"median_travel_time": 0.5}, parts=8)
    return stats.join(medians, key, "left")


def daily_kpis(silver_rows: DataFrame) -> DataFrame:
    """Daily route KPIs: mean, median, linear p95, mean delay, reliability, peak hour and its mean, count."""
    rows = silver_rows.select(
        F.to_date("timestamp").alias("date"), *ROUTE, "travel_time_min", "traffic_delay_min", "hour"
    )
    key = ["date", *ROUTE]
    std = F.stddev_samp("travel_time_min")
    stats = rows.groupBy(*key).agg(
        F.avg("travel_time_min").alias("avg_travel_time"),
        F.avg("traffic_delay_min").alias("avg_delay"),
        F.when(std.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 100 - std * RELIABILITY_PER_STD)).alias("reliability_score"),
        F.count("*").alias("sample_count"),
    )
    peaks = (
        rows.groupBy(*key, "hour")
        .agg(F.avg("travel_time_min").alias("_mean"))
        .groupBy(*key)
        .agg(
            F.lpad(F.max_by("hour", F.struct("_mean", -F.col("hour"))).cast("string"), 2, "0").alias("peak_hour"),
            F.max("_mean").alias("peak_travel_time"),
        )
    )
    tails = exact_percentiles(
        rows, key, "travel_time_min", {"median_travel_time": 0.5, "p95_travel_time": 0.95}, parts=16
    )
    return stats.join(peaks, key).join(tails, key)


def rankings(kpis: DataFrame, metric: str = "reliability_score") -> DataFrame:
    """Routes ranked 1..n inside each day, best first."""
    if metric not in ("reliability_score", "avg_travel_time"):
        metric = "reliability_score"
    best = F.col(metric).desc() if metric == "reliability_score" else F.col(metric).asc()
    rank = F.row_number().over(Window.partitionBy("date").orderBy(best, *ROUTE))
    return kpis.select("date", rank.alias("rank"), *ROUTE, "avg_travel_time", "reliability_score")


def period_metrics(kpis: DataFrame, start: str, end: str) -> DataFrame:
    """System means over the half-open range [start, end)."""
    return kpis.filter((F.col("date") >= F.lit(start).cast("date")) & (F.col("date") < F.lit(end).cast("date"))).agg(
        F.avg("avg_travel_time").alias("avg_travel_time"),
        F.avg("reliability_score").alias("reliability"),
        F.count("*").alias("rows"),
    )


def _last_days(kpis: DataFrame, as_of: str, days: int) -> DataFrame:
    return kpis.filter(F.col("date") > F.date_sub(F.lit(as_of).cast("date"), days))


def executive_summary(kpis: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """System means, distinct routes and samples of the last `days` days; the boundary day itself is outside."""
    return _last_days(kpis, as_of, days).agg(
        F.coalesce(F.avg("avg_travel_time"), F.lit(0.0)).alias("system_avg_travel_time"),
        F.coalesce(F.avg("reliability_score"), F.lit(0.0)).alias("system_reliability"),
        F.count_distinct(F.struct(*ROUTE)).alias("total_routes"),
        F.coalesce(F.sum("sample_count"), F.lit(0)).alias("total_measurements"),
    )


def route_reliability(kpis: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return _last_days(kpis, as_of, days).groupBy(*ROUTE).agg(
        F.avg("avg_travel_time").alias("avg_time"), F.avg("reliability_score").alias("avg_reliability")
    )


def best_and_worst(kpis: DataFrame, as_of: str, days: int = 30, n: int = 3) -> DataFrame:
    """The n most and the n least reliable routes, each with its label and place."""
    per_route = route_reliability(kpis, as_of, days).withColumn("route", S.route_label(*[F.col(c) for c in ROUTE]))
    best = per_route.orderBy(F.desc("avg_reliability"), *ROUTE).limit(n).withColumn("side", F.lit("best"))
    worst = per_route.orderBy("avg_reliability", *[F.desc(c) for c in ROUTE]).limit(n).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def period_comparison(kpis: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Current period against the one before it, in one pass; a delta is NULL when either side has no rows."""
    end = F.lit(as_of).cast("date")
    middle, start = F.date_sub(end, days), F.date_sub(end, 2 * days)
    now = (F.col("date") >= middle) & (F.col("date") < end)
    before = (F.col("date") >= start) & (F.col("date") < middle)
    out = kpis.filter(now | before).agg(
        F.avg(F.when(now, F.col("avg_travel_time"))).alias("avg_travel_time"),
        F.avg(F.when(before, F.col("avg_travel_time"))).alias("previous_travel_time"),
        F.avg(F.when(now, F.col("reliability_score"))).alias("reliability"),
        F.avg(F.when(before, F.col("reliability_score"))).alias("previous_reliability"),
    )
    return out.withColumns(
        {
            "delta_travel_time": F.col("avg_travel_time") - F.col("previous_travel_time"),
            "delta_reliability": F.col("reliability") - F.col("previous_reliability"),
        }
    )


def time_summaries(silver_rows: DataFrame) -> DataFrame:
    """System values per date and hour; congestion is the share of rows classed heavy."""
    return silver_rows.groupBy(F.to_date("timestamp").alias("date"), "hour").agg(
        F.count("*").alias("total_measurements"),
        F.avg("travel_time_min").alias("avg_travel_time"),
        F.stddev_samp("travel_time_min").alias("std_travel_time"),
        (F.avg(F.when(F.col("congestion_level") == "heavy", 1.0).otherwise(0.0)) * 100).alias("congestion_percentage"),
    )


def weather_impact(silver_rows: DataFrame) -> DataFrame:
    """Mean travel time per date and origin weather, and its ratio to the mean of the day."""
    cells = silver_rows.groupBy(F.to_date("timestamp").alias("date"), F.col("origin_weather").alias("weather_condition")).agg(
        F.sum("travel_time_min").alias("_sum"), F.count("travel_time_min").alias("sample_count")
    )
    day = Window.partitionBy("date")
    day_mean = F.sum("_sum").over(day) / F.sum("sample_count").over(day)
    mean = F.col("_sum") / F.col("sample_count")
    return cells.select(
        "date", "weather_condition", mean.alias("avg_travel_time"), (mean / day_mean).alias("impact_factor"), "sample_count"
    )


def data_quality_metrics(audit: DataFrame) -> DataFrame:
    """Daily quality of the raw rows: total, valid, missing, out of bounds and mean score."""
    return audit.groupBy(F.to_date("timestamp").alias("date")).agg(
        F.count("*").alias("total_records"),
        F.count_if(F.col("reason").isNull()).alias("valid_records"),
        F.count_if(F.col("reason") == "missing").alias("missing_records"),
        F.count_if(F.col("reason") == "duplicate").alias("duplicate_records"),
        F.count_if(F.col("reason") == "out_of_bounds").alias("outlier_records"),
        F.avg("data_quality_score").alias("quality_score"),
    )


def quality_statistics(bronze_rows: DataFrame, date: str | None = None) -> DataFrame:
    """Row count and mean score of bronze, of one ingest day when given."""
    rows = bronze_rows
    if date is not None:
        rows = rows.filter(F.to_date("ingestion_timestamp") == F.lit(date).cast("date"))
    return rows.agg(
        F.count("*").alias("total_records"),
        F.coalesce(F.avg("data_quality_score"), F.lit(0.0)).alias("avg_quality_score"),
    )


def run_medallion(raw: DataFrame, path: str, order: Sequence[str], at: str) -> None:
    """Bronze, silver and gold under `path`. Running it again adds only new keys and rewrites the touched days."""
    spark = raw.sparkSession
    dated = bronze(raw, order, at).withColumn("date", F.to_date("raw_timestamp"))
    _append_absent(dated, f"{path}/bronze", ["raw_timestamp", *ROUTE])
    bronze_now = spark.read.parquet(f"{path}/bronze").drop("date")
    silver_rows = silver(bronze_now, at).withColumn("date", F.to_date("timestamp"))
    _append_absent(silver_rows, f"{path}/silver", MEASUREMENT_KEY)
    write_gold(spark.read.parquet(f"{path}/silver"), path)


def _append_absent(rows: DataFrame, path: str, key: Sequence[str]) -> None:
    if path_exists(rows.sparkSession, path):
        rows = insert_absent(rows, rows.sparkSession.read.parquet(path), key)
    rows.write.mode("append").partitionBy("date").parquet(path)


def write_gold(silver_rows: DataFrame, path: str) -> None:
    """All days of `silver_rows` in one grouped pass; the same days are replaced, other days stay."""
    kpis = daily_kpis(silver_rows)
    for name, table in (
        ("gold_route_kpis", kpis),
        ("gold_route_rankings", rankings(kpis)),
        ("gold_time_summaries", time_summaries(silver_rows)),
        ("gold_weather_impact", weather_impact(silver_rows)),
    ):
        (
            table.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("date")
            .parquet(f"{path}/{name}")
        )


def path_exists(spark, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
