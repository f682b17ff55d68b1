"""Scans, statistics, windows and reports over route measurements.

Every function answers for all routes at once; the moment a report is made for is the argument `as_of`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions import scalars as S
from wayloom.operators.chunks import (
    beside,
    with_one_row,
    day_chunk,
    exact_percentiles,
    with_position,
    with_previous_rows,
    with_running_totals,
)
from wayloom.schemas import ROUTE, numeric_columns

TIME_SERIES_METRICS = (
    "travel_time_min", "average_speed_kmh", "traffic_delay_min", "distance_km", "origin_temperature", "origin_humidity",
)
MEASURED_EXCEPT = ("id", "polyline", "created_at")


# --- scans -----------------------------------------------------------------------------------------------------------
def since(df: DataFrame, as_of: str, hours: float, ts: str = "timestamp") -> DataFrame:
    """Rows of the `hours` before `as_of`, boundary included."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(int(hours)))
    return df.filter(F.col(ts) >= cutoff)


def scan(
    df: DataFrame,
    origin: str | None = None,
    destination: str | None = None,
    start: str | None = None,
    end: str | None = None,
    limit: int | None = None,
    include_polyline: bool = False,
) -> DataFrame:
    """Measurements by optional route and time bounds, newest first; the geometry column is not read by default."""
    if origin is not None:
        df = df.filter(F.col("origin") == origin)
    if destination is not None:
        df = df.filter(F.col("destination") == destination)
    if start is not None:
        df = df.filter(F.col("timestamp") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.filter(F.col("timestamp") <= F.lit(end).cast("timestamp_ntz"))
    if not include_polyline:
        df = df.drop("polyline", "created_at")
    df = df.orderBy(F.desc("timestamp"), F.desc("id"))
    return df.limit(limit) if limit is not None else df


def scan_columns(df: DataFrame, columns: Sequence[str], as_of: str, days: float) -> DataFrame:
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"Unknown columns: {unknown}")
    return since(df, as_of, days * 24).select(*columns)


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def time_series(df: DataFrame, metric: str, as_of: str, hours: float) -> DataFrame:
    """Instants and values of one allowed metric, per route."""
    if metric not in TIME_SERIES_METRICS:
        raise ValueError(f"Metric not allowed: {metric}")
    rows = since(df, as_of, hours).filter(F.col(metric).isNotNull())
    return rows.select(*ROUTE, "timestamp", F.col(metric).alias("value"))


def read_only_query(spark, text: str) -> DataFrame:
    """Runs a user's SQL when it is a query; anything else is refused."""
    words = text.strip().split(None, 1)
    if not words or words[0].upper() not in ("SELECT", "WITH") or ";" in text.strip().rstrip(";"):
        raise ValueError("Only SELECT or WITH queries are allowed")
    return spark.sql(text.strip().rstrip(";"))


# --- grouped statistics ----------------------------------------------------------------------------------------------
def _nonzero(value: Column) -> Column:
    """Two decimals; a zero is reported as unknown."""
    return F.nullif(F.round(value, 2), F.lit(0.0))


def route_statistics(df: DataFrame, as_of: str, hours: float) -> DataFrame:
    return since(df, as_of, hours).groupBy(*ROUTE).agg(
        F.count("*").alias("count"),
        _nonzero(F.avg("travel_time_min")).alias("avg_travel_time"),
        _nonzero(F.min("travel_time_min")).alias("min_travel_time"),
        _nonzero(F.max("travel_time_min")).alias("max_travel_time"),
        _nonzero(F.avg("traffic_delay_min")).alias("avg_delay"),
        _nonzero(F.avg("origin_temperature")).alias("avg_temperature"),
    )


def all_routes_statistics(df: DataFrame, as_of: str, hours: float) -> DataFrame:
    return since(df, as_of, hours).groupBy(*ROUTE).agg(
        F.count("*").alias("measurements"),
        F.avg("travel_time_min").alias("avg_travel_time"),
        F.min("travel_time_min").alias("min_travel_time"),
        F.max("travel_time_min").alias("max_travel_time"),
        F.avg("traffic_delay_min").alias("avg_delay"),
        F.avg("average_speed_kmh").alias("avg_speed"),
        F.max("timestamp").alias("last_timestamp"),
    )


def hourly_statistics(df: DataFrame, as_of: str, days: float) -> DataFrame:
    return since(df, as_of, days * 24).groupBy(*ROUTE, F.hour("timestamp").alias("hour")).agg(
        F.count("*").alias("count"),
        F.avg("travel_time_min").alias("avg_travel_time"),
        F.avg("traffic_delay_min").alias("avg_delay"),
        F.avg("average_speed_kmh").alias("avg_speed"),
    )


def daily_average(df: DataFrame, as_of: str, days: float) -> DataFrame:
    return since(df, as_of, days * 24).groupBy(F.to_date("timestamp").alias("date")).agg(
        F.avg("travel_time_min").alias("avg_travel_time"), F.count("travel_time_min").alias("count")
    )


def route_hour_average(df: DataFrame, as_of: str, days: float) -> DataFrame:
    return since(df, as_of, days * 24).groupBy(*ROUTE, F.hour("timestamp").alias("hour")).agg(
        F.avg("travel_time_min").alias("avg_travel_time")
    )


def route_hour_heatmap(df: DataFrame, as_of: str, days: float) -> DataFrame:
    """One row per route and one column per hour of the day, all 24 present."""
    rows = since(df, as_of, days * 24).select(
        S.route_label(F.col("origin"), F.col("destination")).alias("route"),
        F.format_string("h%02d", F.hour("timestamp")).alias("hour"),
        "travel_time_min",
    )
    return rows.groupBy("route").pivot("hour", [f"h{h:02d}" for h in range(24)]).agg(F.avg("travel_time_min"))


def database_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("total_rows"),
        F.count_distinct(F.struct(*ROUTE)).alias("routes"),
        F.count_distinct("origin").alias("origins"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
    )


def measured_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in MEASURED_EXCEPT]


def data_profile(df: DataFrame) -> DataFrame:
    """Per route in one pass: rows, first and last instant, duplicates, NULLs of every column, completeness."""
    cols = measured_columns(df)
    per_route = df.groupBy(*ROUTE).agg(
        F.count("*").alias("rows"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
        (F.count("*") - F.count_distinct(F.struct("timestamp", "data_source"))).alias("duplicates"),
        *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in cols],
    )
    nulls = sum((F.col(f"nulls_{c}") for c in cols), F.lit(0))
    return per_route.withColumn("nulls", nulls).withColumn(
        "completeness_pct", F.round(100 * (1 - F.col("nulls") / (F.col("rows") * len(cols))), 1)
    )


def profile_totals(profile: DataFrame) -> DataFrame:
    cols = [c for c in profile.columns if c.startswith("nulls_")]
    return profile.agg(
        F.sum("rows").alias("total_rows"),
        F.min("first_timestamp").alias("first_timestamp"),
        F.max("last_timestamp").alias("last_timestamp"),
        F.count("*").alias("n_routes"),
        F.count_distinct("origin").alias("n_origins"),
        F.sum("duplicates").alias("duplicates"),
        F.round(100 * F.sum("nulls") / (F.sum("rows") * len(cols)), 1).alias("missing_pct"),
        *[F.sum(c).alias(c) for c in cols],
    )


def completeness(profile: DataFrame) -> DataFrame:
    return profile.select(S.route_label(*[F.col(c) for c in ROUTE]).alias("route"), "rows", "nulls", "completeness_pct")


def quality_report(df: DataFrame) -> DataFrame:
    """Totals with the span in days."""
    totals = profile_totals(data_profile(df))
    return totals.select(
        "total_rows", "n_routes", "missing_pct", "duplicates",
        F.datediff("last_timestamp", "first_timestamp").alias("span_days"),
        F.round(100 - F.col("missing_pct"), 1).alias("completeness_pct"),
    )


def route_profile(silver_rows: DataFrame, as_of: str, days: float) -> DataFrame:
    return since(silver_rows, as_of, days * 24).groupBy(*ROUTE, "hour", "day_of_week").agg(
        F.avg("travel_time_min").alias("avg_time"),
        F.stddev_samp("travel_time_min").alias("std_time"),
        F.count("travel_time_min").alias("count"),
    )


def trips_hourly(trips: DataFrame, ts: str = "datetime") -> DataFrame:
    """Hourly rollup per route with the share of high-delay trips."""
    high = F.when(F.col("mobility_level") == "Alta demora", 1).otherwise(0)
    return trips.groupBy(F.window(ts, "1 hour").alias("w"), *ROUTE).agg(
        F.count("*").alias("num_trips"),
        F.avg("duration_min").alias("avg_duration_min"),
        F.avg("distance_km").alias("avg_distance_km"),
        F.avg("temperature").alias("avg_temperature"),
        F.avg("humidity").alias("avg_humidity"),
        F.avg("traffic_delay_min").alias("avg_traffic_delay_min"),
        F.round(100.0 * F.sum(high) / F.count("*"), 1).alias("pct_alta_demora"),
    ).select(F.col("w.start").alias("hour"), *ROUTE, "num_trips", "avg_duration_min", "avg_distance_km",
             "avg_temperature", "avg_humidity", "avg_traffic_delay_min", "pct_alta_demora")


def temperature_bands(df: DataFrame) -> DataFrame:
    """Mean travel time and row count below 15, 15 to 25 and from 25 degrees, per route."""
    t = F.col("origin_temperature")
    bands = {"cold": t < 15, "mild": (t >= 15) & (t < 25), "warm": t >= 25}
    out = []
    for name, inside in bands.items():
        out.append(F.round(F.avg(F.when(inside, F.col("travel_time_min"))), 2).alias(f"{name}_avg"))
        out.append(F.count_if(inside).alias(f"{name}_count"))
    return df.groupBy(*ROUTE).agg(*out)


def newest_per_route(df: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*ROUTE).orderBy(F.desc("timestamp"), F.desc("id")))
    return df.withColumn("_rn", rank).filter(F.col("_rn") <= n).drop("_rn")


def weekday_patterns(df: DataFrame) -> DataFrame:
    """Per route and weekday: mean, median, sample deviation, range and count."""
    rows = df.select(*ROUTE, S.weekday0(F.col("timestamp")).alias("day_of_week"), "travel_time_min")
    key = [*ROUTE, "day_of_week"]
    stats = rows.groupBy(*key).agg(
        F.avg("travel_time_min").alias("mean"),
        F.stddev_samp("travel_time_min").alias("std"),
        F.min("travel_time_min").alias("min"),
        F.max("travel_time_min").alias("max"),
        F.count("travel_time_min").alias("count"),
    )
    return stats.join(exact_percentiles(rows, key, "travel_time_min", {"median": 0.5}), key, "left")


def weekend_means(df: DataFrame) -> DataFrame:
    weekend = S.weekday0(F.col("timestamp")).isin(*S.WEEKEND_DAYS)
    return df.groupBy(*ROUTE).agg(
        F.avg(F.when(~weekend, F.col("travel_time_min"))).alias("weekday_mean"),
        F.avg(F.when(weekend, F.col("travel_time_min"))).alias("weekend_mean"),
    )


def hour_patterns(df: DataFrame) -> DataFrame:
    """Per route: the hours with the highest and lowest mean travel time (first hour on ties) and their means."""
    hours = df.groupBy(*ROUTE, F.hour("timestamp").alias("hour")).agg(F.avg("travel_time_min").alias("mean"))
    hours = hours.filter(F.col("mean").isNotNull())
    return hours.groupBy(*ROUTE).agg(
        F.max_by("hour", F.struct("mean", -F.col("hour"))).alias("peak_hour"),
        F.max("mean").alias("peak_mean"),
        F.min_by("hour", F.struct("mean", "hour")).alias("off_peak_hour"),
        F.min("mean").alias("off_peak_mean"),
    )


def corridor_profile(df: DataFrame) -> DataFrame:
    return df.groupBy(*ROUTE).agg(
        F.avg("distance_km").alias("distance"),
        F.avg("travel_time_min").alias("duration"),
        F.avg("average_speed_kmh").alias("speed"),
        F.avg((F.col("travel_time_min") > S.HIGH_DELAY_OVER_MIN).cast("double")).alias("high_delay_share"),
        F.count("*").alias("n"),
    )


def share_by(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count of each combination and its percentage of all rows."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("n"))
    joined = with_one_row(counts, counts.agg(F.sum("n").alias("_total")))
    return joined.withColumn("pct", 100.0 * F.col("n") / F.col("_total")).drop("_total")


def nulls_by_source(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy("data_source").agg(F.count_if(F.col(column).isNull()).alias("nulls"), F.count("*").alias("rows"))


def high_delay_share(df: DataFrame, by: Sequence[Column | str]) -> DataFrame:
    high = (F.col("travel_time_min") > S.HIGH_DELAY_OVER_MIN).cast("double")
    return df.filter(F.col("travel_time_min").isNotNull()).groupBy(*by).agg(
        F.avg(high).alias("share"), F.min("travel_time_min").alias("low"), F.max("travel_time_min").alias("high"),
        F.count("*").alias("n"),
    )


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between minimum and maximum, with the mean and the exact median beside each bin."""
    rows = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    ends = with_one_row(rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean")), exact_percentiles(rows, [], "v", {"median": 0.5}))
    place = F.least(F.floor((F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    return (
        with_one_row(rows, ends)
        .groupBy(F.coalesce(place, F.lit(0)).cast("int").alias("bin"), "lo", "hi", "mean", "median")
        .agg(F.count("*").alias("n"))
    )


def consistency(df: DataFrame, as_of: str, hours: float) -> DataFrame:
    stats = route_statistics(df, as_of, hours)
    score = S.consistency_score(F.col("count"), F.col("min_travel_time"), F.col("max_travel_time"), F.col("avg_travel_time"))
    return stats.select(*ROUTE, "count", score.alias("consistency"))


# --- windows ---------------------------------------------------------------------------------------------------------
def latest_per_route(df: DataFrame, require: str | None = None) -> DataFrame:
    """The newest row of each route (highest id on equal instants), optionally among rows where a column is known."""
    if require is not None:
        df = df.filter(F.col(require).isNotNull())
    rest = [c for c in df.columns if c not in ROUTE]
    newest = F.max_by(F.struct(*rest), F.struct("timestamp", "id"))
    return df.groupBy(*ROUTE).agg(newest.alias("_row")).select(*ROUTE, "_row.*").select(*df.columns)


def route_status(df: DataFrame, as_of: str) -> DataFrame:
    """Latest measurement of each route beside its latest reading with traffic, with ages and a state."""
    def age(ts):
        micros = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
        return micros / 60e6

    latest = latest_per_route(df).select(*ROUTE, "timestamp", "data_source", "travel_time_min", "average_speed_kmh")
    traffic = latest_per_route(df, "traffic_delay_min").select(
        *ROUTE,
        F.col("timestamp").alias("traffic_timestamp"),
        F.col("data_source").alias("traffic_source"),
        F.col("traffic_delay_min"),
    )
    return latest.join(traffic, ROUTE, "left").select(
        S.route_label(F.col("origin"), F.col("destination")).alias("route"),
        S.status_label(F.col("traffic_delay_min"), age("traffic_timestamp")).alias("status"),
        "travel_time_min", "average_speed_kmh", "traffic_delay_min", "timestamp", "traffic_timestamp",
        S.age_text(age("timestamp")).alias("age"),
        S.age_text(age("traffic_timestamp")).alias("traffic_age"),
    )


def route_table(routes: DataFrame, df: DataFrame, as_of: str, hours: float = 1) -> DataFrame:
    """The route list with the statistics of the last `hours`, NULL where nothing was measured."""
    return routes.join(all_routes_statistics(df, as_of, hours), ROUTE, "left")


def lag_means(df: DataFrame, rows: int = 5, fallback: str = "no_traffic_time_min") -> DataFrame:
    """Mean of up to `rows` earlier travel times of the route; the first row uses the no-traffic time."""
    def add(w):
        mean = F.avg("travel_time_min").over(w.rowsBetween(-rows, -1))
        return {"recent_avg": F.coalesce(mean, F.col(fallback))}

    return with_previous_rows(df, ROUTE, ["timestamp", "id"], rows, ["travel_time_min"], add, day_chunk("timestamp"))


def persistence(df: DataFrame, value: str = "travel_time_min") -> DataFrame:
    """The previous value of the same route and source."""
    def add(w):
        return {"previous": F.lag(value, 1).over(w)}

    key = [*ROUTE, "data_source"]
    return with_previous_rows(df, key, ["timestamp", "id"], 1, [value], add, day_chunk("timestamp"))


def leaky_means(df: DataFrame, rows: int = 5) -> DataFrame:
    """Mean over the current and the four NEWER rows (order newest first). It leaks the target: a negative control."""
    def add(w):
        return {"leaky_avg": F.avg("travel_time_min").over(w.rowsBetween(-(rows - 1), 0))}

    flipped = df.withColumns({"_t": -F.unix_micros(F.col("timestamp").cast("timestamp")), "_i": -F.col("id")})
    chunk = -F.datediff(F.to_date("timestamp"), F.lit("1970-01-01").cast("date"))
    out = with_previous_rows(flipped, ROUTE, ["_t", "_i"], rows - 1, ["travel_time_min"], add, chunk)
    return out.drop("_t", "_i")


def collection_gaps(df: DataFrame, over_hours: float = 2.0, keys: Sequence[str] = ("data_source",)) -> DataFrame:
    """Silences longer than `over_hours` between neighbouring distinct instants of a source."""
    keys = list(keys)
    instants = df.filter(F.col("timestamp").isNotNull()).select(*keys, "timestamp").distinct()

    def add(w):
        return {"gap_start": F.lag("timestamp", 1).over(w)}

    pairs = with_previous_rows(instants, keys, ["timestamp"], 1, ["timestamp"], add, day_chunk("timestamp"))
    micros = F.unix_micros(F.col("timestamp").cast("timestamp")) - F.unix_micros(F.col("gap_start").cast("timestamp"))
    return (
        pairs.withColumn("hours", micros / 3.6e9)
        .filter(F.col("hours") > over_hours)
        .select(*keys, "gap_start", F.col("timestamp").alias("gap_end"), "hours", S.duration_text(F.col("hours")).alias("length"))
    )


def gap_report(df: DataFrame, over_hours: float = 2.0) -> DataFrame:
    """Per source: instants, window, last instant, number of gaps and their share of the window."""
    gaps = collection_gaps(df, over_hours).groupBy("data_source").agg(
        F.count("*").alias("gaps"), F.sum("hours").alias("gap_hours")
    )
    spans = df.groupBy("data_source").agg(
        F.count_distinct("timestamp").alias("cycles"),
        F.max("timestamp").alias("last_timestamp"),
        ((F.unix_micros(F.max("timestamp").cast("timestamp")) - F.unix_micros(F.min("timestamp").cast("timestamp"))) / 3.6e9).alias("window_hours"),
    )
    return spans.join(gaps, "data_source", "left").select(
        "data_source", "cycles", "last_timestamp", "window_hours",
        F.coalesce("gaps", F.lit(0)).alias("gaps"),
        F.coalesce("gap_hours", F.lit(0.0)).alias("gap_hours"),
        (100 * F.coalesce("gap_hours", F.lit(0.0)) / F.nullif(F.col("window_hours"), F.lit(0.0))).alias("gap_pct"),
    )


def with_blocks(df: DataFrame, keys: Sequence[str], over_hours: float, order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """Numbers the stretches of each key that are separated by pauses longer than `over_hours`."""
    keys, order = list(keys), list(order)

    def add(w):
        before = F.lag(F.unix_micros(F.col("timestamp").cast("timestamp")), 1).over(w)
        now = F.unix_micros(F.col("timestamp").cast("timestamp"))
        return {"_starts": F.when(now - before > over_hours * 3.6e9, 1).otherwise(0)}

    flagged = with_previous_rows(df, keys, order, 1, ["timestamp"], add, day_chunk("timestamp"))
    return with_running_totals(flagged, keys, order, {"block": F.col("_starts")}, day_chunk("timestamp")).drop("_starts")


def last_block(df: DataFrame, keys: Sequence[str], over_hours: float, order: Sequence[str] = ("timestamp",)) -> DataFrame:
    blocks = with_blocks(df, keys, over_hours, order)
    newest = blocks.groupBy(*keys).agg(F.max("block").alias("block"))
    return blocks.join(newest, [*keys, "block"])


def longest_run(hours: DataFrame, keys: Sequence[str], hour: str = "hour") -> DataFrame:
    """The longest unbroken stretch of observed hours per key; the earliest on equal length."""
    keys = list(keys)
    rows = hours.select(*keys, F.col(hour).alias("timestamp")).distinct()
    runs = (
        with_blocks(rows, keys, 1.5)
        .groupBy(*keys, "block")
        .agg(F.min("timestamp").alias("run_start"), F.max("timestamp").alias("run_end"), F.count("*").alias("hours"))
    )
    best = F.max_by(F.struct("run_start", "run_end", "hours"), F.struct("hours", -F.col("block")))
    return runs.groupBy(*keys).agg(best.alias("r")).select(*keys, "r.*")


def route_trend(df: DataFrame, as_of: str, hours: float) -> DataFrame:
    """First third against last third of each route's series: direction, size in percent, last-ten mean, overall mean."""
    rows = since(df, as_of, hours).filter(F.col("travel_time_min").isNotNull())
    placed = with_position(rows, ROUTE, ["timestamp", "id"], day_chunk("timestamp"), "pos", "n")
    v = F.col("travel_time_min")
    means = placed.groupBy(*ROUTE).agg(
        F.avg(F.when(F.col("pos") <= F.floor(F.col("n") / 3), v)).alias("first"),
        F.avg(F.when(F.col("pos") > F.col("n") - F.ceil(F.col("n") / 3), v)).alias("last"),
        F.avg(F.when(F.col("pos") > F.col("n") - 10, v)).alias("recent"),
        F.avg(v).alias("overall"),
    )
    up = F.col("last") > F.col("first") * 1.1
    down = F.col("last") < F.col("first") * 0.9
    change = 100 * (F.col("last") - F.col("first")) / F.col("first")
    return means.select(
        *ROUTE,
        F.when(up, "increasing").when(down, "decreasing").otherwise("stable").alias("trend"),
        F.round(F.when(up, change).when(down, -change).otherwise(0.0), 1).alias("change_percent"),
        F.round("recent", 2).alias("current_avg"),
        F.round("overall", 2).alias("historical_avg"),
    )


def daily_trend_line(daily: DataFrame, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """Straight line through the ordered days (position 0, 1, ...) of each key, with the fitted value of each day.

    The input has one row per key and day, so one key's days fit one task."""
    keys = list(keys)
    rows = daily.filter(F.col(value).isNotNull()).withColumn(
        "x", (F.row_number().over(Window.partitionBy(*keys).orderBy(day)) - 1).cast("double")
    )
    fit = rows.groupBy(*keys).agg(
        F.regr_slope(value, "x").alias("slope"), F.regr_intercept(value, "x").alias("intercept")
    )
    return rows.join(fit, keys).withColumn("fitted", F.col("intercept") + F.col("slope") * F.col("x")).drop("x")


def chronological_split(df: DataFrame, keys: Sequence[str], share: float = 0.8) -> DataFrame:
    """Adds `part`: train before the instant found at position floor(share · n), test from it on. Rows of one instant
    always stay together."""
    keys = list(keys)
    placed = with_position(df, keys, ["timestamp", "id"], day_chunk("timestamp"), "_pos", "_n")
    cut = placed.filter(F.col("_pos") == F.floor(F.col("_n") * share) + 1).groupBy(*keys).agg(F.min("timestamp").alias("_cut"))
    return beside(df, cut, keys).withColumn("part", F.when(F.col("timestamp") < F.col("_cut"), "train").otherwise("test")).drop("_cut")


def positional_split(df: DataFrame, keys: Sequence[str], share: float = 0.8, part: str = "part") -> DataFrame:
    """Adds `part` by row position in time: the first floor(share · n) rows of each key train."""
    placed = with_position(df, list(keys), ["timestamp", "id"], day_chunk("timestamp"), "_pos", "_n")
    return placed.withColumn(
        part, F.when(F.col("_pos") <= F.floor(F.col("_n") * share), "train").otherwise("test")
    ).drop("_pos", "_n")


def same_hour_yesterday(hourly: DataFrame, keys: Sequence[str], hour: str, value: str) -> DataFrame:
    keys = list(keys)
    shifted = hourly.select(*keys, (F.col(hour) + F.make_dt_interval(hours=F.lit(24))).alias(hour), F.col(value).alias("yesterday"))
    return hourly.join(shifted, [*keys, hour], "left")


# --- reports ---------------------------------------------------------------------------------------------------------
def available_routes(df: DataFrame) -> DataFrame:
    return df.select(*ROUTE).distinct().orderBy(*ROUTE)


def route_alerts(df: DataFrame, as_of: str, hours: float = 24) -> DataFrame:
    """Routes whose mean passes 30 minutes; above 45 the severity is HIGH."""
    stats = all_routes_statistics(df, as_of, hours).filter(F.col("avg_travel_time") > 30)
    return stats.select(
        S.route_label(F.col("origin"), F.col("destination")).alias("route"),
        F.when(F.col("avg_travel_time") > 45, "HIGH").otherwise("MEDIUM").alias("severity"),
        "avg_travel_time",
    )


def system_alerts(summary: DataFrame) -> DataFrame:
    slow = F.when(F.col("system_avg_travel_time") > 30, F.lit("slow_system"))
    shaky = F.when(F.col("system_reliability") < 50, F.lit("low_reliability"))
    return summary.select(
        "system_avg_travel_time", "system_reliability",
        F.concat_ws(",", F.filter(F.array(slow, shaky), lambda a: a.isNotNull())).alias("alerts"),
    )


def collection_age(df: DataFrame, as_of: str, stale_after_min: int = 60) -> DataFrame:
    """Minutes since the newest row, and whether that counts as stalled."""
    minutes = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.max("timestamp").cast("timestamp"))) / 60e6
    return df.agg(F.max("timestamp").alias("last_timestamp"), minutes.alias("age_min")).withColumn(
        "stalled", F.col("age_min") > stale_after_min
    )


def numeric_profile_columns(df: DataFrame) -> list[str]:
    return numeric_columns(df)


def anomalies(df: DataFrame, threshold: float = 2.5) -> DataFrame:
    """Rows whose travel time is more than `threshold` sample deviations from the mean of their route."""
    moments = df.groupBy(*ROUTE).agg(F.avg("travel_time_min").alias("mean"), F.stddev_samp("travel_time_min").alias("std"))
    z = (F.col("travel_time_min") - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0))
    return (
        df.join(moments, ROUTE)
        .withColumn("z_score", z)
        .filter(F.abs("z_score") > threshold)
        .select("id", "timestamp", *ROUTE, "travel_time_min", "z_score", F.when(F.col("z_score") > 0, "High").otherwise("Low").alias("deviation"))
    )


def anomaly_share(df: DataFrame, threshold: float = 2.5) -> DataFrame:
    found = anomalies(df, threshold).groupBy(*ROUTE).agg(F.count("*").alias("total_anomalies"))
    rows = df.groupBy(*ROUTE).agg(F.count("*").alias("n"))
    total = F.coalesce("total_anomalies", F.lit(0))
    return rows.join(found, ROUTE, "left").select(*ROUTE, total.alias("total_anomalies"), (100.0 * total / F.col("n")).alias("percentage"))
