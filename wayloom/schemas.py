"""Table schemas, schema alignment and required-column contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

MEASUREMENT_KEY = ["timestamp", "origin", "destination"]
ROUTE = ["origin", "destination"]
WEATHER = [
    "origin_temperature", "origin_humidity", "origin_weather",
    "destination_temperature", "destination_humidity", "destination_weather",
]

BRONZE = """raw_timestamp timestamp_ntz, origin string, destination string, travel_time_min double, no_traffic_time_min double,
    average_speed_kmh double, origin_temperature double, origin_humidity double, origin_weather string,
    destination_temperature double, destination_humidity double, destination_weather string,
    ingestion_timestamp timestamp, data_quality_score double, validation_status string"""
SILVER = """timestamp timestamp_ntz, origin string, destination string, travel_time_min double, no_traffic_time_min double,
    traffic_delay_min double, average_speed_kmh double, congestion_level string, origin_temperature double,
    origin_humidity double, origin_weather string, destination_temperature double, destination_humidity double,
    destination_weather string, hour int, day_of_week int, day_of_month int, month int, is_peak_hour int,
    is_weekend int, transformation_timestamp timestamp"""
MEASUREMENTS = """timestamp string, origin string, destination string, data_source string, travel_time_min double,
    no_traffic_time_min double, historic_travel_time_min double, live_travel_time_min double, traffic_delay_min double,
    distance_km double, average_speed_kmh double, origin_temperature double, origin_feels_like double,
    origin_humidity double, origin_weather string, destination_temperature double, destination_feels_like double,
    destination_humidity double, destination_weather string, mobility_level string, polyline string"""
TRIPS = """datetime timestamp, origin string, destination string, distance_km double, duration_min double,
    temperature double, humidity double, weather_description string, mobility_level string, traffic_delay_min double,
    data_source string"""
POIS = "osm_type string, osm_id bigint, category string, subcategory string, name string, latitude double, longitude double"
SECOND_SOURCE_POIS = "fsq_place_id string, category string, subcategory string, name string, latitude double, longitude double"
POPULATION = "zone string, date string, year int, population bigint, source string"
LEGACY = """datetime string, origin string, destination string, distance_km double, duration_min double, temperature double,
    humidity double, weather_description string, mobility_level string"""


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Columns of `schema` in order: missing ones as typed NULL, others dropped."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in StructType.fromDDL(schema).fields
        ]
    )


def require_columns(df: DataFrame, required: Sequence[str]) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
