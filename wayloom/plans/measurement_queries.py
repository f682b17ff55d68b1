"""Queries over route measurements: medallion tables, statistics, windows and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.functions import scalars as S
from wayloom.operators import medallion as M
from wayloom.operators import routes as R
from wayloom.plans.common import MEASUREMENTS, measurements, r6, shown, with_tables
from wayloom.schemas import ROUTE

AS_OF = "2024-01-30 23:00:00"
AS_OF_DAY = "2024-01-31"
QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

ACCEPTED = """accepted AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY timestamp, origin, destination ORDER BY id) AS copy FROM measurements)
  WHERE copy = 1 AND travel_time_min IS NOT NULL AND travel_time_min BETWEEN 0 AND 500)"""
SILVER = """silver AS (
  SELECT id, timestamp, origin, destination, travel_time_min, no_traffic_time_min,
    CASE WHEN no_traffic_time_min IS NOT NULL THEN greatest(travel_time_min - no_traffic_time_min, 0) END AS traffic_delay_min,
    average_speed_kmh, origin_temperature, origin_humidity, origin_weather,
    destination_temperature, destination_humidity, destination_weather,
    hour(timestamp) AS hour, isodow(timestamp) - 1 AS day_of_week, day(timestamp) AS day_of_month, month(timestamp) AS month
  FROM accepted),
congested AS (SELECT *, CASE WHEN traffic_delay_min IS NULL THEN 'unknown' WHEN traffic_delay_min <= 1 THEN 'free_flow'
    WHEN traffic_delay_min <= 4 THEN 'moderate' ELSE 'heavy' END AS congestion_level FROM silver)"""
KPIS = """stats AS (
  SELECT CAST(timestamp AS DATE) AS date, origin, destination, avg(travel_time_min) AS avg_travel_time,
    median(travel_time_min) AS median_travel_time, quantile_cont(travel_time_min, 0.95) AS p95_travel_time,
    avg(traffic_delay_min) AS avg_delay, coalesce(greatest(0, 100 - 2 * stddev_samp(travel_time_min)), 0) AS reliability_score,
    count(*) AS sample_count FROM silver GROUP BY ALL),
hourly AS (SELECT CAST(timestamp AS DATE) AS date, origin, destination, hour, avg(travel_time_min) AS m FROM silver GROUP BY ALL),
peaks AS (SELECT date, origin, destination, lpad(CAST(hour AS VARCHAR), 2, '0') AS peak_hour, m AS peak_travel_time
  FROM (SELECT *, row_number() OVER (PARTITION BY date, origin, destination ORDER BY m DESC, hour) AS rn FROM hourly) WHERE rn = 1),
kpis AS (SELECT * FROM stats JOIN peaks USING (date, origin, destination))"""
GOLD = with_tables(MEASUREMENTS, ACCEPTED, SILVER, KPIS)
SILVER_ONLY = with_tables(MEASUREMENTS, ACCEPTED, SILVER)
MEAS = with_tables(MEASUREMENTS)


def register(name: str, build: Callable, oracle: str | None = None) -> None:
    QUERIES[name] = build
    if oracle is not None:
        ORACLE[name] = oracle


def on_measurements(fn: Callable[[DataFrame], DataFrame]) -> Callable:
    return lambda spark, sf: fn(measurements(spark, sf))


def on_silver(fn: Callable[[DataFrame], DataFrame]) -> Callable:
    return lambda spark, sf: fn(M.silver(M.bronze(measurements(spark, sf), ["id"])))


def on_kpis(fn: Callable[[DataFrame], DataFrame]) -> Callable:
    return on_silver(lambda silver: fn(M.daily_kpis(silver)))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: shown(F.col(c)) for c in columns})


def r_sql(*columns: str) -> str:
    return ", ".join(f"{r6(c)} AS {c}" for c in columns)


KPI_NUMBERS = ["avg_travel_time", "median_travel_time", "p95_travel_time", "avg_delay", "reliability_score", "peak_travel_time"]

# --- medallion -------------------------------------------------------------------------------------------------------
register(
    "bronze_rows",
    lambda spark, sf: M.bronze(measurements(spark, sf), ["id"]).select(
        "raw_timestamp", *ROUTE, "travel_time_min", "data_quality_score", "validation_status"
    ),
    with_tables(MEASUREMENTS, ACCEPTED)
    + """SELECT timestamp AS raw_timestamp, origin, destination, travel_time_min,
    100 - CASE WHEN travel_time_min > 0 AND travel_time_min < 500 THEN 0 ELSE 20 END
      - 2 * ((origin_temperature IS NULL)::INT + (origin_humidity IS NULL)::INT + (destination_temperature IS NULL)::INT
      + (destination_humidity IS NULL)::INT)::DOUBLE AS data_quality_score, 'validated' AS validation_status FROM accepted""",
)
AUDIT = """audit AS (
  SELECT *, CASE WHEN copy > 1 THEN 'duplicate' WHEN travel_time_min IS NULL THEN 'missing'
    WHEN travel_time_min NOT BETWEEN 0 AND 500 THEN 'out_of_bounds' END AS reason,
    greatest(0, 100 - CASE WHEN travel_time_min IS NULL THEN 30 WHEN travel_time_min > 0 AND travel_time_min < 500 THEN 0 ELSE 20 END
      - 2 * ((origin_temperature IS NULL)::INT + (origin_humidity IS NULL)::INT + (destination_temperature IS NULL)::INT
      + (destination_humidity IS NULL)::INT))::DOUBLE AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY timestamp, origin, destination ORDER BY id) AS copy FROM measurements))"""
register(
    "bronze_summary",
    on_measurements(lambda m: rounded(M.bronze_summary(M.bronze_audit(m, ["id"])), "quality_score")),
    with_tables(MEASUREMENTS, AUDIT)
    + f"""SELECT count(*) AS original_records, count(*) FILTER (reason IS NULL) AS inserted_records,
    count(*) FILTER (reason IS NOT NULL) AS removed_records, count(*) FILTER (reason = 'duplicate') AS duplicates,
    count(*) FILTER (reason = 'missing') AS missing_critical, count(*) FILTER (reason = 'out_of_bounds') AS outliers,
    {r6("coalesce(avg(score) FILTER (reason IS NULL), 0)")} AS quality_score FROM audit""",
)
register(
    "data_quality_daily",
    on_measurements(lambda m: rounded(M.data_quality_metrics(M.bronze_audit(m, ["id"])), "quality_score")),
    with_tables(MEASUREMENTS, AUDIT)
    + f"""SELECT CAST(timestamp AS DATE) AS date, count(*) AS total_records, count(*) FILTER (reason IS NULL) AS valid_records,
    count(*) FILTER (reason = 'missing') AS missing_records, count(*) FILTER (reason = 'duplicate') AS duplicate_records,
    count(*) FILTER (reason = 'out_of_bounds') AS outlier_records, {r6("avg(score)")} AS quality_score FROM audit GROUP BY 1""",
)
register(
    "bronze_quality_statistics",
    lambda spark, sf: rounded(M.quality_statistics(M.bronze(measurements(spark, sf), ["id"])), "avg_quality_score"),
    with_tables(MEASUREMENTS, AUDIT)
    + f"SELECT count(*) AS total_records, {r6('avg(score)')} AS avg_quality_score FROM audit WHERE reason IS NULL",
)
register(
    "silver_rows",
    on_silver(lambda s: s.select(
        "timestamp", *ROUTE, "travel_time_min", shown(F.col("traffic_delay_min")).alias("traffic_delay_min"),
        "congestion_level", "hour", "day_of_week", "day_of_month", "month", "is_peak_hour", "is_weekend")),
    SILVER_ONLY
    + f"""SELECT timestamp, origin, destination, travel_time_min, {r6("traffic_delay_min")} AS traffic_delay_min, congestion_level,
    hour::INT AS hour, day_of_week::INT AS day_of_week, day_of_month::INT AS day_of_month, month::INT AS month,
    (hour IN (7, 8, 9, 17, 18, 19))::INT AS is_peak_hour, (day_of_week IN (5, 6))::INT AS is_weekend FROM congested""",
)
register(
    "silver_summary",
    on_silver(lambda s: s.agg(F.count("*").alias("records_transformed"),
                              shown(F.avg("travel_time_min")).alias("mean_travel_time"),
                              shown(F.avg("traffic_delay_min")).alias("mean_delay"))),
    SILVER_ONLY + f"SELECT count(*) AS records_transformed, {r6('avg(travel_time_min)')} AS mean_travel_time, {r6('avg(traffic_delay_min)')} AS mean_delay FROM silver",
)
HOURLY_NUMBERS = ["avg_travel_time", "std_travel_time", "median_travel_time", "avg_speed"]
register(
    "route_hourly",
    on_silver(lambda s: rounded(M.route_hourly(s), *HOURLY_NUMBERS)),
    SILVER_ONLY
    + f"""SELECT date_trunc('hour', timestamp)::TIMESTAMP AS hour_start, origin, destination, {r6("avg(travel_time_min)")} AS avg_travel_time,
    {r6("stddev_samp(travel_time_min)")} AS std_travel_time, min(travel_time_min) AS min_travel_time,
    max(travel_time_min) AS max_travel_time, count(travel_time_min) AS sample_count, {r6("avg(average_speed_kmh)")} AS avg_speed,
    {r6("median(travel_time_min)")} AS median_travel_time FROM silver GROUP BY 1, 2, 3""",
)
register("route_daily_kpis", on_kpis(lambda k: rounded(k, *KPI_NUMBERS)),
         GOLD + f"SELECT date, origin, destination, sample_count, peak_hour, {r_sql(*KPI_NUMBERS)} FROM kpis")
for metric, order in (("reliability_score", "reliability_score DESC"), ("avg_travel_time", "avg_travel_time")):
    register(
        f"route_rankings_{metric}",
        on_kpis(lambda k, metric=metric: rounded(M.rankings(rounded(k, "avg_travel_time", "reliability_score"), metric), "avg_travel_time", "reliability_score")),
        GOLD
        + f"""SELECT date, (row_number() OVER (PARTITION BY date ORDER BY {order}, origin, destination))::INT AS rank, origin, destination,
        {r_sql("avg_travel_time", "reliability_score")}
        FROM (SELECT date, origin, destination, {r_sql("avg_travel_time", "reliability_score")} FROM kpis)""",
    )
register(
    "period_metrics",
    on_kpis(lambda k: rounded(M.period_metrics(k, "2024-01-10", "2024-01-20"), "avg_travel_time", "reliability")),
    GOLD + f"""SELECT {r6("avg(avg_travel_time)")} AS avg_travel_time, {r6("avg(reliability_score)")} AS reliability, count(*) AS rows
    FROM kpis WHERE date >= DATE '2024-01-10' AND date < DATE '2024-01-20'""",
)
register(
    "executive_summary",
    on_kpis(lambda k: rounded(M.executive_summary(k, AS_OF_DAY, 30), "system_avg_travel_time", "system_reliability")),
    GOLD + f"""SELECT {r6("coalesce(avg(avg_travel_time), 0)")} AS system_avg_travel_time,
    {r6("coalesce(avg(reliability_score), 0)")} AS system_reliability, count(DISTINCT origin || '-' || destination) AS total_routes,
    coalesce(sum(sample_count), 0)::BIGINT AS total_measurements FROM kpis WHERE date > DATE '{AS_OF_DAY}' - INTERVAL 30 DAY""",
)
register(
    "system_alerts",
    on_kpis(lambda k: rounded(R.system_alerts(M.executive_summary(k, AS_OF_DAY, 30)), "system_avg_travel_time", "system_reliability")),
    GOLD + f"""SELECT {r6("a")} AS system_avg_travel_time, {r6("r")} AS system_reliability,
    concat_ws(',', CASE WHEN a > 30 THEN 'slow_system' END, CASE WHEN r < 50 THEN 'low_reliability' END) AS alerts
    FROM (SELECT avg(avg_travel_time) AS a, avg(reliability_score) AS r FROM kpis WHERE date > DATE '{AS_OF_DAY}' - INTERVAL 30 DAY)""",
)
register(
    "best_and_worst_routes",
    on_kpis(lambda k: rounded(M.best_and_worst(k, AS_OF_DAY, 30), "avg_time", "avg_reliability")),
    GOLD + f""", per AS (SELECT origin, destination, avg(avg_travel_time) AS avg_time, avg(reliability_score) AS avg_reliability,
      origin || ' → ' || destination AS route FROM kpis WHERE date > DATE '{AS_OF_DAY}' - INTERVAL 30 DAY GROUP BY 1, 2)
    SELECT origin, destination, {r_sql("avg_time", "avg_reliability")}, route, 'best' AS side FROM
      (SELECT * FROM per ORDER BY avg_reliability DESC, origin, destination LIMIT 3)
    UNION ALL SELECT origin, destination, {r_sql("avg_time", "avg_reliability")}, route, 'worst' AS side FROM
      (SELECT * FROM per ORDER BY avg_reliability, origin DESC, destination DESC LIMIT 3)""",
)
register(
    "kpi_cards",
    on_kpis(lambda k: rounded(M.period_comparison(k, AS_OF_DAY, 14), "avg_travel_time", "previous_travel_time", "reliability",
                              "previous_reliability", "delta_travel_time", "delta_reliability")),
    GOLD + f""", p AS (SELECT avg(avg_travel_time) FILTER (date >= DATE '{AS_OF_DAY}' - INTERVAL 14 DAY) AS a,
      avg(avg_travel_time) FILTER (date < DATE '{AS_OF_DAY}' - INTERVAL 14 DAY) AS pa,
      avg(reliability_score) FILTER (date >= DATE '{AS_OF_DAY}' - INTERVAL 14 DAY) AS r,
      avg(reliability_score) FILTER (date < DATE '{AS_OF_DAY}' - INTERVAL 14 DAY) AS pr
      FROM kpis WHERE date >= DATE '{AS_OF_DAY}' - INTERVAL 28 DAY AND date < DATE '{AS_OF_DAY}')
    SELECT {r6("a")} AS avg_travel_time, {r6("pa")} AS previous_travel_time, {r6("r")} AS reliability, {r6("pr")} AS previous_reliability,
      {r6("a - pa")} AS delta_travel_time, {r6("r - pr")} AS delta_reliability FROM p""",
)
register(
    "gold_time_summaries",
    on_silver(lambda s: rounded(M.time_summaries(s), "avg_travel_time", "std_travel_time", "congestion_percentage")),
    SILVER_ONLY + f"""SELECT CAST(timestamp AS DATE) AS date, hour::INT AS hour, count(*) AS total_measurements,
    {r6("avg(travel_time_min)")} AS avg_travel_time, {r6("stddev_samp(travel_time_min)")} AS std_travel_time,
    {r6("100.0 * avg((congestion_level = 'heavy')::INT)")} AS congestion_percentage FROM congested GROUP BY 1, 2""",
)
register(
    "gold_weather_impact",
    on_silver(lambda s: rounded(M.weather_impact(s), "avg_travel_time", "impact_factor")),
    SILVER_ONLY + f""", d AS (SELECT CAST(timestamp AS DATE) AS date, avg(travel_time_min) AS m FROM silver GROUP BY 1)
    SELECT date, origin_weather AS weather_condition, {r6("avg(travel_time_min)")} AS avg_travel_time,
    {r6("avg(travel_time_min) / any_value(m)")} AS impact_factor, count(travel_time_min) AS sample_count
    FROM silver JOIN d ON CAST(timestamp AS DATE) = date GROUP BY 1, 2""",
)
register(
    "route_profile",
    on_silver(lambda s: rounded(R.route_profile(s, AS_OF, 30), "avg_time", "std_time")),
    SILVER_ONLY + f"""SELECT origin, destination, hour::INT AS hour, day_of_week::INT AS day_of_week, {r6("avg(travel_time_min)")} AS avg_time,
    {r6("stddev_samp(travel_time_min)")} AS std_time, count(travel_time_min) AS count FROM silver
    WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 720 HOUR GROUP BY 1, 2, 3, 4""",
)

# --- scans and statistics --------------------------------------------------------------------------------------------
register(
    "measurement_scan",
    on_measurements(lambda m: R.scan(m, origin="Z3", start="2024-01-05 00:00:00", end="2024-01-20 00:00:00").select(
        "id", "timestamp", *ROUTE, "data_source", "travel_time_min")),
    MEAS + """SELECT id, timestamp, origin, destination, data_source, travel_time_min FROM measurements
    WHERE origin = 'Z3' AND timestamp >= TIMESTAMP '2024-01-05' AND timestamp <= TIMESTAMP '2024-01-20'""",
)
register(
    "newest_rows",
    on_measurements(lambda m: R.scan(m, limit=100).select("id", "timestamp", *ROUTE, "travel_time_min")),
    MEAS + "SELECT id, timestamp, origin, destination, travel_time_min FROM measurements ORDER BY timestamp DESC, id DESC LIMIT 100",
)
register(
    "column_window_scan",
    on_measurements(lambda m: R.scan_columns(m, ["timestamp", "origin", "travel_time_min"], AS_OF, 7)),
    MEAS + f"SELECT timestamp, origin, travel_time_min FROM measurements WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 168 HOUR",
)
register(
    "complete_cases",
    on_measurements(lambda m: R.complete_cases(m, ["travel_time_min", "origin_temperature", "destination_temperature", "origin_weather"]).groupBy(*ROUTE).agg(F.count("*").alias("n"))),
    MEAS + """SELECT origin, destination, count(*) AS n FROM measurements WHERE travel_time_min IS NOT NULL AND origin_temperature IS NOT NULL
    AND destination_temperature IS NOT NULL AND origin_weather IS NOT NULL GROUP BY 1, 2""",
)
register(
    "route_time_series",
    on_measurements(lambda m: R.time_series(m, "average_speed_kmh", AS_OF, 48).withColumn("value", shown(F.col("value")))),
    MEAS + f"""SELECT origin, destination, timestamp, {r6("average_speed_kmh")} AS value FROM measurements
    WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR AND average_speed_kmh IS NOT NULL""",
)


def z2(expr: str) -> str:
    return f"nullif(round({expr}, 2), 0)"


register(
    "route_stats",
    on_measurements(lambda m: R.route_statistics(m, AS_OF, 720)),
    MEAS + f"""SELECT origin, destination, count(*) AS count, {z2("avg(travel_time_min)")} AS avg_travel_time,
    {z2("min(travel_time_min)")} AS min_travel_time, {z2("max(travel_time_min)")} AS max_travel_time,
    {z2("avg(traffic_delay_min)")} AS avg_delay, {z2("avg(origin_temperature)")} AS avg_temperature FROM measurements
    WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 720 HOUR GROUP BY 1, 2""",
)
register(
    "all_routes_statistics",
    on_measurements(lambda m: rounded(R.all_routes_statistics(m, AS_OF, 240), "avg_travel_time", "avg_delay", "avg_speed")),
    MEAS + f"""SELECT origin, destination, count(*) AS measurements, {r6("avg(travel_time_min)")} AS avg_travel_time,
    min(travel_time_min) AS min_travel_time, max(travel_time_min) AS max_travel_time, {r6("avg(traffic_delay_min)")} AS avg_delay,
    {r6("avg(average_speed_kmh)")} AS avg_speed, max(timestamp) AS last_timestamp FROM measurements
    WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 240 HOUR GROUP BY 1, 2""",
)
register(
    "hour_statistics",
    on_measurements(lambda m: rounded(R.hourly_statistics(m, AS_OF, 7), "avg_travel_time", "avg_delay", "avg_speed")),
    MEAS + f"""SELECT origin, destination, hour(timestamp)::INT AS hour, count(*) AS count, {r6("avg(travel_time_min)")} AS avg_travel_time,
    {r6("avg(traffic_delay_min)")} AS avg_delay, {r6("avg(average_speed_kmh)")} AS avg_speed FROM measurements
    WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 168 HOUR GROUP BY 1, 2, 3""",
)
register(
    "daily_average",
    on_measurements(lambda m: rounded(R.daily_average(m, AS_OF, 30), "avg_travel_time")),
    MEAS + f"""SELECT CAST(timestamp AS DATE) AS date, {r6("avg(travel_time_min)")} AS avg_travel_time, count(travel_time_min) AS count
    FROM measurements WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 720 HOUR GROUP BY 1""",
)
register(
    "route_hour_average",
    on_measurements(lambda m: rounded(R.route_hour_average(m, AS_OF, 30), "avg_travel_time")),
    MEAS + f"""SELECT origin, destination, hour(timestamp)::INT AS hour, {r6("avg(travel_time_min)")} AS avg_travel_time
    FROM measurements WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 720 HOUR GROUP BY 1, 2, 3""",
)
register(
    "route_hour_heatmap",
    on_measurements(lambda m: rounded(R.route_hour_heatmap(m, AS_OF, 30), *[f"h{h:02d}" for h in range(24)])),
    MEAS + "SELECT origin || ' → ' || destination AS route, "
    + ", ".join(r6(f"avg(travel_time_min) FILTER (hour(timestamp) = {h})") + f" AS h{h:02d}" for h in range(24))
    + f" FROM measurements WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 720 HOUR GROUP BY 1",
)
register(
    "database_summary",
    on_measurements(R.database_summary),
    MEAS + """SELECT count(*) AS total_rows, count(DISTINCT origin || '|' || destination) AS routes, count(DISTINCT origin) AS origins,
    min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp FROM measurements""",
)
COLS = ["timestamp", "origin", "destination", "data_source", "travel_time_min", "no_traffic_time_min", "traffic_delay_min", "distance_km",
        "average_speed_kmh", "origin_temperature", "origin_humidity", "origin_weather", "destination_temperature",
        "destination_humidity", "destination_weather"]
PROFILE = f"""nulled AS (SELECT origin, destination, count(*) AS rows, min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp,
  count(*) - count(DISTINCT (timestamp, data_source)) AS duplicates, {", ".join(f"count(*) FILTER ({c} IS NULL) AS nulls_{c}" for c in COLS)}
  FROM measurements GROUP BY 1, 2),
profile AS (SELECT *, {" + ".join(f"nulls_{c}" for c in COLS)} AS nulls FROM nulled)"""
register(
    "data_profile",
    on_measurements(R.data_profile),
    with_tables(MEASUREMENTS, PROFILE) + f"SELECT *, round(100 * (1 - nulls / (rows * {len(COLS)})), 1) AS completeness_pct FROM profile",
)
register(
    "data_profile_totals",
    on_measurements(lambda m: R.profile_totals(R.data_profile(m))),
    with_tables(MEASUREMENTS, PROFILE) + f"""SELECT sum(rows)::BIGINT AS total_rows, min(first_timestamp) AS first_timestamp,
    max(last_timestamp) AS last_timestamp, count(*) AS n_routes, count(DISTINCT origin) AS n_origins, sum(duplicates)::BIGINT AS duplicates,
    round(100 * sum(nulls) / (sum(rows) * {len(COLS)}), 1) AS missing_pct, {", ".join(f"sum(nulls_{c})::BIGINT AS nulls_{c}" for c in COLS)} FROM profile""",
)
register(
    "route_completeness",
    on_measurements(lambda m: R.completeness(R.data_profile(m))),
    with_tables(MEASUREMENTS, PROFILE) + f"""SELECT origin || ' → ' || destination AS route, rows, nulls,
    round(100 * (1 - nulls / (rows * {len(COLS)})), 1) AS completeness_pct FROM profile""",
)
register(
    "quality_report",
    on_measurements(R.quality_report),
    with_tables(MEASUREMENTS, PROFILE) + f"""SELECT total_rows, n_routes, missing_pct, duplicates, date_diff('day', f::DATE, l::DATE)::INT AS span_days,
    round(100 - missing_pct, 1) AS completeness_pct FROM (SELECT sum(rows)::BIGINT AS total_rows, count(*) AS n_routes,
    round(100 * sum(nulls) / (sum(rows) * {len(COLS)}), 1) AS missing_pct, sum(duplicates)::BIGINT AS duplicates,
    min(first_timestamp) AS f, max(last_timestamp) AS l FROM profile)""",
)
register(
    "temperature_bands",
    on_measurements(R.temperature_bands),
    MEAS + "SELECT origin, destination, " + ", ".join(
        f"round(avg(travel_time_min) FILTER ({c}), 2) AS {n}_avg, count(*) FILTER ({c}) AS {n}_count"
        for n, c in (("cold", "origin_temperature < 15"), ("mild", "origin_temperature >= 15 AND origin_temperature < 25"), ("warm", "origin_temperature >= 25"))
    ) + " FROM measurements GROUP BY 1, 2",
)
register(
    "weekday_patterns",
    on_measurements(lambda m: rounded(R.weekday_patterns(m), "mean", "std", "median")),
    MEAS + f"""SELECT origin, destination, (isodow(timestamp) - 1)::INT AS day_of_week, {r6("avg(travel_time_min)")} AS mean,
    {r6("stddev_samp(travel_time_min)")} AS std, min(travel_time_min) AS min, max(travel_time_min) AS max, count(travel_time_min) AS count,
    {r6("median(travel_time_min)")} AS median FROM measurements GROUP BY 1, 2, 3""",
)
register(
    "weekday_weekend_means",
    on_measurements(lambda m: rounded(R.weekend_means(m), "weekday_mean", "weekend_mean")),
    MEAS + f"""SELECT origin, destination, {r6("avg(travel_time_min) FILTER (isodow(timestamp) < 6)")} AS weekday_mean,
    {r6("avg(travel_time_min) FILTER (isodow(timestamp) >= 6)")} AS weekend_mean FROM measurements GROUP BY 1, 2""",
)
register(
    "hour_patterns",
    on_measurements(lambda m: rounded(R.hour_patterns(m), "peak_mean", "off_peak_mean")),
    MEAS + f""", h AS (SELECT origin, destination, hour(timestamp)::INT AS hour, avg(travel_time_min) AS m FROM measurements GROUP BY 1, 2, 3 HAVING m IS NOT NULL)
    SELECT origin, destination, arg_max(hour, m::DECIMAL(30,12) * 1000 - hour::DECIMAL(30,12) / 1000000000) AS peak_hour, {r6("max(m)")} AS peak_mean,
    arg_min(hour, m::DECIMAL(30,12) * 1000 + hour::DECIMAL(30,12) / 1000000000) AS off_peak_hour, {r6("min(m)")} AS off_peak_mean FROM h GROUP BY 1, 2""",
)
register(
    "corridor_profile",
    on_measurements(lambda m: rounded(R.corridor_profile(m), "distance", "duration", "speed", "high_delay_share")),
    MEAS + f"""SELECT origin, destination, {r6("avg(distance_km)")} AS distance, {r6("avg(travel_time_min)")} AS duration,
    {r6("avg(average_speed_kmh)")} AS speed, {r6("avg((travel_time_min > 20)::INT)")} AS high_delay_share, count(*) AS n FROM measurements GROUP BY 1, 2""",
)
register(
    "share_by_source_weather",
    on_measurements(lambda m: rounded(R.share_by(m, ["data_source", "origin_weather"]), "pct")),
    MEAS + f"""SELECT data_source, origin_weather, count(*) AS n, {r6("100.0::DOUBLE * count(*) / sum(count(*)) OVER ()")} AS pct
    FROM measurements GROUP BY 1, 2""",
)
register(
    "nulls_by_source",
    on_measurements(lambda m: R.nulls_by_source(m, "no_traffic_time_min")),
    MEAS + "SELECT data_source, count(*) FILTER (no_traffic_time_min IS NULL) AS nulls, count(*) AS rows FROM measurements GROUP BY 1",
)
register(
    "high_delay_by_hour",
    on_measurements(lambda m: rounded(R.high_delay_share(m, [F.hour("timestamp").alias("hour")]), "share")),
    MEAS + f"""SELECT hour(timestamp)::INT AS hour, {r6("avg((travel_time_min > 20)::INT)")} AS share, min(travel_time_min) AS low,
    max(travel_time_min) AS high, count(*) AS n FROM measurements WHERE travel_time_min IS NOT NULL GROUP BY 1""",
)
register(
    "high_delay_by_route",
    on_measurements(lambda m: rounded(R.high_delay_share(m, ROUTE), "share")),
    MEAS + f"""SELECT origin, destination, {r6("avg((travel_time_min > 20)::INT)")} AS share, min(travel_time_min) AS low,
    max(travel_time_min) AS high, count(*) AS n FROM measurements WHERE travel_time_min IS NOT NULL GROUP BY 1, 2""",
)
register(
    "travel_time_by_class",
    on_measurements(lambda m: rounded(R.high_delay_share(m, [S.mobility_level(F.col("travel_time_min")).alias("mobility_level")]), "share")),
    MEAS + f"""SELECT CASE WHEN travel_time_min > 20 THEN 'Alta demora' ELSE 'Movilidad normal' END AS mobility_level,
    {r6("avg((travel_time_min > 20)::INT)")} AS share, min(travel_time_min) AS low, max(travel_time_min) AS high, count(*) AS n
    FROM measurements WHERE travel_time_min IS NOT NULL GROUP BY 1""",
)
register(
    "travel_time_histogram",
    on_measurements(lambda m: rounded(R.histogram(m, "travel_time_min"), "mean", "median")),
    MEAS + f""", e AS (SELECT min(travel_time_min) AS lo, max(travel_time_min) AS hi, avg(travel_time_min) AS mean, median(travel_time_min) AS median FROM measurements)
    SELECT least(floor((travel_time_min - lo) / (hi - lo) * 50), 49)::INT AS bin, lo, hi, {r6("mean")} AS mean, {r6("median")} AS median, count(*) AS n
    FROM measurements, e WHERE travel_time_min IS NOT NULL GROUP BY ALL""",
)
register(
    "consistency_score",
    on_measurements(lambda m: R.consistency(m, AS_OF, 24)),
    MEAS + f""", s AS (SELECT origin, destination, count(*) AS count, {z2("avg(travel_time_min)")} AS a, {z2("min(travel_time_min)")} AS lo, {z2("max(travel_time_min)")} AS hi
      FROM measurements WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR GROUP BY 1, 2)
    SELECT origin, destination, count, (CASE WHEN count < 5 OR a IS NULL THEN 0 WHEN (hi - lo) / a < 0.1 THEN 100 WHEN (hi - lo) / a < 0.2 THEN 85
      WHEN (hi - lo) / a < 0.3 THEN 70 WHEN (hi - lo) / a < 0.5 THEN 50 ELSE 25 END)::INT AS consistency FROM s""",
)

# --- windows ---------------------------------------------------------------------------------------------------------
LATEST = "row_number() OVER (PARTITION BY origin, destination ORDER BY timestamp DESC, id DESC) = 1"
register(
    "latest_per_route",
    on_measurements(lambda m: R.latest_per_route(m).select("id", *ROUTE, "timestamp", "travel_time_min", "data_source")),
    MEAS + f"SELECT id, origin, destination, timestamp, travel_time_min, data_source FROM measurements QUALIFY {LATEST}",
)
register(
    "latest_traffic_per_route",
    on_measurements(lambda m: rounded(R.latest_per_route(m, "traffic_delay_min").select("id", *ROUTE, "timestamp", "traffic_delay_min"), "traffic_delay_min")),
    MEAS + f"""SELECT id, origin, destination, timestamp, {r6("traffic_delay_min")} AS traffic_delay_min FROM measurements
    WHERE traffic_delay_min IS NOT NULL QUALIFY {LATEST}""",
)
register(
    "route_status_grid",
    on_measurements(lambda m: rounded(R.route_status(m, "2024-01-31 00:00:00").drop("age", "traffic_age"), "average_speed_kmh", "traffic_delay_min")),
    MEAS + f""", l AS (SELECT * FROM measurements QUALIFY {LATEST}), t AS (SELECT * FROM measurements WHERE traffic_delay_min IS NOT NULL QUALIFY {LATEST})
    SELECT l.origin || ' → ' || l.destination AS route, CASE WHEN t.timestamp IS NULL THEN 'Sin dato de tráfico'
      WHEN epoch_us(TIMESTAMP '2024-01-31' - t.timestamp) / 60e6 > 90 THEN 'Lectura desactualizada' WHEN t.traffic_delay_min <= 1 THEN 'Free Flow'
      WHEN t.traffic_delay_min <= 4 THEN 'Moderate' ELSE 'Heavy' END AS status, l.travel_time_min, {r6("l.average_speed_kmh")} AS average_speed_kmh,
      {r6("t.traffic_delay_min")} AS traffic_delay_min, l.timestamp, t.timestamp AS traffic_timestamp FROM l LEFT JOIN t USING (origin, destination)""",
)
register(
    "route_table_last_hour",
    on_measurements(lambda m: rounded(R.route_table(R.available_routes(m), m, AS_OF, 1), "avg_travel_time", "avg_delay", "avg_speed")),
    MEAS + f""", s AS (SELECT origin, destination, count(*) AS measurements, {r6("avg(travel_time_min)")} AS avg_travel_time,
      min(travel_time_min) AS min_travel_time, max(travel_time_min) AS max_travel_time, {r6("avg(traffic_delay_min)")} AS avg_delay,
      {r6("avg(average_speed_kmh)")} AS avg_speed, max(timestamp) AS last_timestamp FROM measurements
      WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR GROUP BY 1, 2)
    SELECT * FROM (SELECT DISTINCT origin, destination FROM measurements) LEFT JOIN s USING (origin, destination)""",
)
BY_ROUTE = "PARTITION BY origin, destination ORDER BY timestamp, id"
register(
    "lag5_mean",
    on_measurements(lambda m: R.lag_means(m).select("id", shown(F.col("recent_avg")).alias("recent_avg"))),
    MEAS + f"""SELECT id, {r6("coalesce(avg(travel_time_min) OVER (" + BY_ROUTE + " ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), no_traffic_time_min)")} AS recent_avg FROM measurements""",
)
register(
    "persistence",
    on_measurements(lambda m: R.persistence(m).select("id", "travel_time_min", "previous")),
    MEAS + "SELECT id, travel_time_min, lag(travel_time_min) OVER (PARTITION BY origin, destination, data_source ORDER BY timestamp, id) AS previous FROM measurements",
)
register(
    "leaky_mean_control",
    on_measurements(lambda m: R.leaky_means(m).select("id", shown(F.col("leaky_avg")).alias("leaky_avg"))),
    MEAS + f"""SELECT id, {r6("avg(travel_time_min) OVER (PARTITION BY origin, destination ORDER BY timestamp DESC, id DESC ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")} AS leaky_avg FROM measurements""",
)
GAPS = """gaps AS (SELECT data_source, previous AS gap_start, timestamp AS gap_end, epoch_us(timestamp - previous) / 3.6e9 AS hours
  FROM (SELECT *, lag(timestamp) OVER (PARTITION BY data_source ORDER BY timestamp) AS previous
    FROM (SELECT DISTINCT data_source, timestamp FROM measurements)) WHERE epoch_us(timestamp - previous) / 3.6e9 > 0.25)"""
register(
    "collection_gaps",
    on_measurements(lambda m: rounded(R.collection_gaps(m, 0.25).drop("length"), "hours")),
    with_tables(MEASUREMENTS, GAPS) + f"SELECT data_source, gap_start, gap_end, {r6('hours')} AS hours FROM gaps",
)
register(
    "collection_gap_report",
    on_measurements(lambda m: rounded(R.gap_report(m, 0.25), "window_hours", "gap_hours", "gap_pct")),
    with_tables(MEASUREMENTS, GAPS) + f""", s AS (SELECT data_source, count(DISTINCT timestamp) AS cycles, max(timestamp) AS last_timestamp,
      epoch_us(max(timestamp) - min(timestamp)) / 3.6e9 AS window_hours FROM measurements GROUP BY 1),
    g AS (SELECT data_source, count(*) AS gaps, sum(hours) AS gap_hours FROM gaps GROUP BY 1)
    SELECT data_source, cycles, last_timestamp, {r6("window_hours")} AS window_hours, coalesce(gaps, 0) AS gaps,
      {r6("coalesce(gap_hours, 0)")} AS gap_hours, {r6("100 * coalesce(gap_hours, 0) / window_hours")} AS gap_pct FROM s LEFT JOIN g USING (data_source)""",
)
BLOCKS = """blocks AS (SELECT *, sum(starts) OVER (PARTITION BY data_source ORDER BY timestamp, id) AS block FROM (
  SELECT *, CASE WHEN epoch_us(timestamp - lag(timestamp) OVER (PARTITION BY data_source ORDER BY timestamp, id)) > 0.25 * 3.6e9 THEN 1 ELSE 0 END AS starts FROM measurements))"""
register(
    "collection_blocks",
    on_measurements(lambda m: R.with_blocks(m, ["data_source"], 0.25, ["timestamp", "id"]).select("id", "data_source", "block")),
    with_tables(MEASUREMENTS, BLOCKS) + "SELECT id, data_source, block::BIGINT AS block FROM blocks",
)
register(
    "last_collection_block",
    on_measurements(lambda m: R.last_block(m, ["data_source"], 0.25, ["timestamp", "id"]).select("id", "data_source", "block")),
    with_tables(MEASUREMENTS, BLOCKS) + "SELECT id, data_source, block::BIGINT AS block FROM blocks QUALIFY block = max(block) OVER (PARTITION BY data_source)",
)
register(
    "longest_observed_run",
    on_measurements(lambda m: R.longest_run(m.select(*ROUTE, F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("hour")), ROUTE)),
    MEAS + """, h AS (SELECT DISTINCT origin, destination, date_trunc('hour', timestamp)::TIMESTAMP AS hour FROM measurements),
    i AS (SELECT *, hour - INTERVAL 1 HOUR * (row_number() OVER (PARTITION BY origin, destination ORDER BY hour))::INT AS island FROM h),
    r AS (SELECT origin, destination, min(hour) AS run_start, max(hour) AS run_end, count(*) AS hours FROM i GROUP BY origin, destination, island)
    SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY origin, destination ORDER BY hours DESC, run_start) = 1""",
)
register(
    "route_trend",
    on_measurements(lambda m: R.route_trend(m, AS_OF, 720)),
    MEAS + f""", p AS (SELECT *, row_number() OVER ({BY_ROUTE}) AS pos, count(*) OVER (PARTITION BY origin, destination) AS n FROM measurements
      WHERE travel_time_min IS NOT NULL AND timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 720 HOUR),
    m AS (SELECT origin, destination, avg(travel_time_min) FILTER (pos <= floor(n / 3)) AS f, avg(travel_time_min) FILTER (pos > n - ceil(n / 3)) AS l,
      avg(travel_time_min) FILTER (pos > n - 10) AS c, avg(travel_time_min) AS h FROM p GROUP BY 1, 2)
    SELECT origin, destination, CASE WHEN l > f * 1.1::DOUBLE THEN 'increasing' WHEN l < f * 0.9::DOUBLE THEN 'decreasing' ELSE 'stable' END AS trend,
      round(CASE WHEN l > f * 1.1::DOUBLE THEN 100 * (l - f) / f WHEN l < f * 0.9::DOUBLE THEN -100 * (l - f) / f ELSE 0 END, 1) AS change_percent,
      round(c, 2) AS current_avg, round(h, 2) AS historical_avg FROM m""",
)
register(
    "daily_trend_line",
    on_measurements(lambda m: rounded(R.daily_trend_line(
        m.groupBy(*ROUTE, F.to_date("timestamp").alias("date")).agg(F.avg("travel_time_min").alias("avg_time")), ROUTE, "date", "avg_time"),
        "avg_time", "slope", "intercept", "fitted")),
    MEAS + f""", d AS (SELECT origin, destination, CAST(timestamp AS DATE) AS date, avg(travel_time_min) AS avg_time FROM measurements GROUP BY 1, 2, 3),
    x AS (SELECT *, row_number() OVER (PARTITION BY origin, destination ORDER BY date) - 1 AS x FROM d WHERE avg_time IS NOT NULL),
    f AS (SELECT origin, destination, regr_slope(avg_time, x) AS slope, regr_intercept(avg_time, x) AS intercept FROM x GROUP BY 1, 2)
    SELECT origin, destination, date, {r6("avg_time")} AS avg_time, {r6("slope")} AS slope, {r6("intercept")} AS intercept, {r6("intercept + slope * x")} AS fitted
    FROM x JOIN f USING (origin, destination)""",
)
register(
    "chronological_split",
    on_measurements(lambda m: R.chronological_split(m, ROUTE).select("id", "part")),
    MEAS + f""", p AS (SELECT *, row_number() OVER ({BY_ROUTE}) AS pos, count(*) OVER (PARTITION BY origin, destination) AS n FROM measurements),
    c AS (SELECT origin, destination, timestamp AS cut FROM p WHERE pos = floor(n * 0.8::DOUBLE) + 1)
    SELECT id, CASE WHEN timestamp < cut THEN 'train' ELSE 'test' END AS part FROM p JOIN c USING (origin, destination)""",
)
register(
    "positional_split",
    on_measurements(lambda m: R.positional_split(m, ROUTE).select("id", "part")),
    MEAS + f"""SELECT id, CASE WHEN row_number() OVER ({BY_ROUTE}) <= floor(0.8::DOUBLE * count(*) OVER (PARTITION BY origin, destination)) THEN 'train' ELSE 'test' END AS part FROM measurements""",
)
register(
    "same_hour_yesterday",
    on_measurements(lambda m: rounded(R.same_hour_yesterday(
        m.groupBy(*ROUTE, F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("hour")).agg(F.avg("travel_time_min").alias("value")),
        ROUTE, "hour", "value"), "value", "yesterday")),
    MEAS + f""", h AS (SELECT origin, destination, date_trunc('hour', timestamp)::TIMESTAMP AS hour, avg(travel_time_min) AS value FROM measurements GROUP BY 1, 2, 3)
    SELECT a.origin, a.destination, a.hour, {r6("a.value")} AS value, {r6("b.value")} AS yesterday FROM h a LEFT JOIN h b
    ON a.origin = b.origin AND a.destination = b.destination AND a.hour = b.hour + INTERVAL 24 HOUR""",
)

# --- reports ---------------------------------------------------------------------------------------------------------
register("available_routes", on_measurements(R.available_routes), MEAS + "SELECT DISTINCT origin, destination FROM measurements")
register(
    "route_alerts",
    on_measurements(lambda m: rounded(R.route_alerts(m, AS_OF, 240), "avg_travel_time")),
    MEAS + f"""SELECT origin || ' → ' || destination AS route, CASE WHEN avg(travel_time_min) > 45 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
    {r6("avg(travel_time_min)")} AS avg_travel_time FROM measurements WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 240 HOUR
    GROUP BY origin, destination HAVING avg(travel_time_min) > 30""",
)
register(
    "collection_age",
    on_measurements(lambda m: rounded(R.collection_age(m, "2024-01-31 00:00:00"), "age_min")),
    MEAS + f"""SELECT max(timestamp) AS last_timestamp, {r6("epoch_us(TIMESTAMP '2024-01-31' - max(timestamp)) / 60e6")} AS age_min,
    epoch_us(TIMESTAMP '2024-01-31' - max(timestamp)) / 60e6 > 60 AS stalled FROM measurements""",
)
Z = """z AS (SELECT id, timestamp, origin, destination, travel_time_min, (travel_time_min - avg(travel_time_min) OVER (PARTITION BY origin, destination))
  / nullif(stddev_samp(travel_time_min) OVER (PARTITION BY origin, destination), 0) AS z_score FROM measurements)"""
register(
    "z_anomalies",
    on_measurements(lambda m: rounded(R.anomalies(m), "z_score")),
    with_tables(MEASUREMENTS, Z) + f"""SELECT id, timestamp, origin, destination, travel_time_min, {r6("z_score")} AS z_score,
    CASE WHEN z_score > 0 THEN 'High' ELSE 'Low' END AS deviation FROM z WHERE abs(z_score) > 2.5""",
)
register(
    "z_anomaly_share",
    on_measurements(lambda m: rounded(R.anomaly_share(m), "percentage")),
    with_tables(MEASUREMENTS, Z) + f"""SELECT origin, destination, count(*) FILTER (abs(z_score) > 2.5) AS total_anomalies,
    {r6("100.0::DOUBLE * count(*) FILTER (abs(z_score) > 2.5) / count(*)")} AS percentage FROM z GROUP BY 1, 2""",
)
register(
    "calendar_features",
    on_measurements(lambda m: m.select(
        "id", S.iso_year_week(F.col("timestamp")).alias("iso_week"), (S.weekday0(F.col("timestamp")) + 1).alias("weekday"),
        shown(S.cyclic_hour(F.hour("timestamp"))[0]).alias("hour_sin"), shown(S.cyclic_hour(F.hour("timestamp"))[1]).alias("hour_cos"),
        S.weather_group(F.col("origin_weather")).alias("weather_group"))),
    MEAS + f"""SELECT id, strftime(timestamp, '%G-%V') AS iso_week, isodow(timestamp)::INT AS weekday, {r6("sin(2 * pi() * hour(timestamp) / 24)")} AS hour_sin,
    {r6("cos(2 * pi() * hour(timestamp) / 24)")} AS hour_cos, CASE origin_weather WHEN 'clear sky' THEN 'despejado' WHEN 'broken clouds' THEN 'nublado'
    WHEN 'light rain' THEN 'lluvia' END AS weather_group FROM measurements""",
)
