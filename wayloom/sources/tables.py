"""Readers, writers, migrations and exports of the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions import scalars as S
from wayloom.operators.medallion import path_exists
from wayloom.schemas import LEGACY, MEASUREMENTS, ROUTE, TRIPS, conform, require_columns

MIGRATED_NUMBERS = (
    "distance_km", "travel_time_min", "no_traffic_time_min", "traffic_delay_min", "traffic_length_km",
    "average_speed_kmh", "origin_temperature", "origin_feels_like", "origin_humidity", "destination_temperature",
    "destination_feels_like", "destination_humidity",
)
MIGRATED_TEXTS = (
    "data_source", "departure_time", "arrival_time", "origin_weather", "destination_weather", "mobility_level", "polyline",
)
UNIFIED = ("timestamp", *ROUTE, *MIGRATED_NUMBERS, *MIGRATED_TEXTS)
PHRASES = "tipo string, categoria string, frase string, ciego string"


# --- measurements ----------------------------------------------------------------------------------------------------
def append_history(df: DataFrame, path: str) -> None:
    """Appends rows to a CSV history; every part file carries the header."""
    df.write.mode("append").option("header", True).csv(path)


def read_history(spark: SparkSession, path: str, schema: str = MEASUREMENTS) -> DataFrame:
    """CSV history; lines that do not fit the schema are skipped."""
    return spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED").csv(path)


def read_text_history(spark: SparkSession, path: str) -> DataFrame:
    """CSV history with every field as text, for migration; the header decides the columns."""
    return spark.read.option("header", True).option("mode", "DROPMALFORMED").csv(path)


def migrate(texts: DataFrame) -> DataFrame:
    """Text rows to the unified layout: unreadable numbers become NULL, the source defaults to 'unknown', rows without
    a key are dropped."""
    require_columns(texts, ["timestamp", *ROUTE])
    have = set(texts.columns)

    def field(name: str, kind: str) -> Column:
        if name not in have:
            return F.lit(None).cast(kind).alias(name)
        return F.col(name).try_cast(kind).alias(name)

    rows = texts.select(
        *[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("timestamp", *ROUTE)],
        *[field(c, "double") for c in MIGRATED_NUMBERS],
        *[field(c, "string") for c in MIGRATED_TEXTS],
    )
    source = F.coalesce(F.nullif(F.col("data_source"), F.lit("")), F.lit("unknown"))
    return rows.withColumn("data_source", source).na.drop(subset=["timestamp", *ROUTE])


def migration_preview(migrated: DataFrame) -> DataFrame:
    """What a migration would write: number of rows and range of instants."""
    return migrated.agg(
        F.count("*").alias("records"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")
    )


def to_trips(measurements: DataFrame) -> DataFrame:
    """Wide measurement rows to the narrow trip table; NaN becomes NULL."""
    have = set(measurements.columns)

    def number(name):
        return S.finite(F.col(name).cast("double")) if name in have else F.lit(None).cast("double")

    def text(name):
        return F.col(name) if name in have else F.lit(None).cast("string")

    rows = measurements.select(
        F.col("timestamp").cast("timestamp").alias("datetime"),
        *ROUTE,
        number("distance_km").alias("distance_km"),
        number("travel_time_min").alias("duration_min"),
        number("origin_temperature").alias("temperature"),
        number("origin_humidity").alias("humidity"),
        text("origin_weather").alias("weather_description"),
        text("mobility_level").alias("mobility_level"),
        number("traffic_delay_min").alias("traffic_delay_min"),
        F.coalesce(text("data_source"), F.lit("unknown")).alias("data_source"),
    )
    return conform(rows, TRIPS)


def write_trips(trips: DataFrame, path: str) -> None:
    trips.withColumn("date", F.to_date("datetime")).write.mode("append").partitionBy("date").parquet(path)


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEGACY).option("header", True).csv(path)


def unify_plain_legacy(legacy: DataFrame) -> DataFrame:
    """The older layout (one weather, no traffic fields) to the unified one; speed is derived."""
    speed = F.round(F.col("distance_km") / F.nullif(F.col("duration_min") / 60, F.lit(0.0)), 2)
    stamp = F.date_format(S.parse_instant(F.col("datetime")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    rows = legacy.select(
        stamp.alias("timestamp"),
        *ROUTE,
        F.lit("ors").alias("data_source"),
        "distance_km",
        F.col("duration_min").alias("travel_time_min"),
        speed.alias("average_speed_kmh"),
        *[F.col("temperature").alias(f"{side}_temperature") for side in ROUTE],
        *[F.col("humidity").alias(f"{side}_humidity") for side in ROUTE],
        *[F.col("weather_description").alias(f"{side}_weather") for side in ROUTE],
        "mobility_level",
    )
    return _unified(rows)


def unify_traffic_legacy(rows: DataFrame) -> DataFrame:
    """The traffic layout to the unified one; the mobility level is derived and the geometry dropped."""
    return _unified(
        rows.withColumns(
            {
                "data_source": F.lit("tomtom"),
                "mobility_level": S.mobility_level(F.col("travel_time_min")),
                "polyline": F.lit(None).cast("string"),
            }
        )
    )


def _unified(rows: DataFrame) -> DataFrame:
    have = set(rows.columns)
    kinds = {c: "double" for c in MIGRATED_NUMBERS}
    return rows.select(
        *[(F.col(c) if c in have else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in UNIFIED]
    )


def merge_legacy(plain: DataFrame, traffic: DataFrame) -> DataFrame:
    return unify_plain_legacy(plain).unionByName(unify_traffic_legacy(traffic)).orderBy("timestamp", *ROUTE)


def evaluation_rows(measurements: DataFrame, start: str | None = None) -> DataFrame:
    """Measurements with a readable instant from `start` on, without the geometry."""
    instant = F.col("timestamp")
    if dict(measurements.dtypes)["timestamp"] == "string":
        instant = S.parse_instant(instant).cast("timestamp_ntz")
    rows = measurements.drop("polyline", "created_at").withColumn("timestamp", instant)
    rows = rows.filter(F.col("timestamp").isNotNull())
    return rows if start is None else rows.filter(F.col("timestamp") >= F.lit(start).cast("timestamp_ntz"))


# --- exports ---------------------------------------------------------------------------------------------------------
def export_csv(df: DataFrame, path: str, geometry: bool = False, since: str | None = None) -> None:
    if not geometry:
        df = df.drop("polyline")
    if since is not None:
        df = df.filter(F.col("timestamp") >= F.lit(since).cast("timestamp_ntz"))
    df.write.mode("overwrite").option("header", True).csv(path)


def export_route(df: DataFrame, origin: str, destination: str, path: str) -> None:
    rows = df.filter((F.col("origin") == origin) & (F.col("destination") == destination))
    export_csv(rows.orderBy("timestamp"), path, geometry=True)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def significant(x: Column, digits: int = 6) -> Column:
    """Text of a number with that many significant digits, without trailing zeros."""
    return F.when(x.isNotNull(), F.regexp_replace(F.format_string(f"%.{digits}g", x), r"(\.\d*?)0+($|e)", "$1$2"))


def export_view(df: DataFrame, path: str) -> None:
    """CSV with a byte-order mark: coordinates at six decimals, other numbers at six significant digits."""
    columns = []
    for name, kind in df.dtypes:
        if name in ("lat", "lon", "latitude", "longitude"):
            columns.append(F.format_string("%.6f", F.col(name)).alias(name))
        elif kind in ("double", "float"):
            columns.append(significant(F.col(name)).alias(name))
        else:
            columns.append(F.col(name))
    marked = df.select(*columns).toDF(*["﻿" + c if i == 0 else c for i, c in enumerate(df.columns)])
    marked.write.mode("overwrite").option("header", True).csv(path)


# --- reference tables ------------------------------------------------------------------------------------------------
def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-separated phrases; every field is text and an empty field stays an empty string."""
    return (
        spark.read.schema(PHRASES).option("header", True).option("sep", "|").option("quote", "").option("nullValue", "\u0000")
        .option("emptyValue", "").csv(path).na.fill("")
    )


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one of the same shape when it was never written."""
    if path_exists(spark, path):
        return conform(spark.read.parquet(path), schema)
    return spark.createDataFrame([], schema)


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Element documents, one JSON file each, with their file; unreadable files give an unparsed body."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("body"), F.col("_metadata.file_name").alias("file"))


def pois_of(df: DataFrame, categories: list[str] | None = None) -> DataFrame:
    return df if not categories else df.filter(F.col("category").isin(*categories))


def ordered_population(df: DataFrame) -> DataFrame:
    return df.orderBy("zone", "date")


def export_bundle(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Five reduced tables for training under one folder, and their manifest. Existing folders are not overwritten."""
    from wayloom.operators.quality import manifest

    keep = ["category", "subcategory", "name", "latitude", "longitude"]
    reduced = {
        "pois": tables["pois"].select(*keep),
        "pois_second_source": tables["pois_second_source"].select(*keep),
        "zone_demographics": tables["zone_demographics"].select("zone", "population"),
        "route_measurements": route_means(tables["measurements"]),
        "osm_context": tables["context"].select("category", "subcategory", "latitude", "longitude"),
    }
    for name, df in reduced.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    written = {name: spark.read.parquet(f"{path}/{name}") for name in reduced}
    listing = manifest(written)
    listing.write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.schema(listing.schema).json(f"{path}/manifest")


def route_means(measurements: DataFrame) -> DataFrame:
    return measurements.groupBy(*ROUTE).agg(
        F.avg("travel_time_min").alias("travel_time_min"), F.count("*").alias("n_mediciones")
    )
