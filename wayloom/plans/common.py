"""Shared by the registered queries: tables as DataFrames, and the same derived tables as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions.scalars import shown

__all__ = ["shown", "r6", "table", "measurements", "MEASUREMENTS", "with_tables"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(expr: str, digits: int = 6) -> str:
    """SQL twin of `shown`."""
    return f"round(({expr}) + 1.3e-8, {digits})"


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route measurements derived from the event table; every event is one measurement."""
    k = F.get_json_object("props", "$.k").cast("int")
    eid = F.col("event_id")
    travel = F.when(eid % 50 == 7, None).otherwise(F.col("value"))
    traffic = eid % 3 == 0
    distance = (F.col("user_id") % 10 + 5).cast("double")
    return table(spark, sf_dir, "events").select(
        eid.alias("id"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("Z"), (F.col("user_id") % 7).cast("string")).alias("origin"),
        F.col("event_type").alias("destination"),
        F.when(traffic, "traffic").otherwise("base").alias("data_source"),
        travel.alias("travel_time_min"),
        F.when(traffic, F.col("value") * 0.8).alias("no_traffic_time_min"),
        F.when(traffic, travel - F.col("value") * 0.8).alias("traffic_delay_min"),
        distance.alias("distance_km"),
        (distance * 60 / F.nullif(F.col("value"), F.lit(0.0))).alias("average_speed_kmh"),
        F.when(eid % 11 == 0, None).otherwise(k * 0.3 + 5).alias("origin_temperature"),
        (k % 50 + 40).cast("double").alias("origin_humidity"),
        F.when(k % 4 == 0, "clear sky").when(k % 4 == 1, "broken clouds").when(k % 4 == 2, "light rain").alias("origin_weather"),
        F.when(eid % 13 == 0, None).otherwise(k * 0.25 + 6).alias("destination_temperature"),
        (k % 40 + 45).cast("double").alias("destination_humidity"),
        F.when(k % 3 == 0, "clear sky").when(k % 3 == 1, "mist").otherwise("broken clouds").alias("destination_weather"),
    )


MEASUREMENTS = """measurements AS (
  SELECT event_id AS id, ts AS timestamp, 'Z' || (user_id % 7) AS origin, event_type AS destination,
    CASE WHEN event_id % 3 = 0 THEN 'traffic' ELSE 'base' END AS data_source,
    CASE WHEN event_id % 50 <> 7 THEN value END AS travel_time_min,
    CASE WHEN event_id % 3 = 0 THEN value * 0.8::DOUBLE END AS no_traffic_time_min,
    CASE WHEN event_id % 3 = 0 AND event_id % 50 <> 7 THEN value - value * 0.8::DOUBLE END AS traffic_delay_min,
    (user_id % 10 + 5)::DOUBLE AS distance_km,
    (user_id % 10 + 5)::DOUBLE * 60 / nullif(value, 0) AS average_speed_kmh,
    CASE WHEN event_id % 11 <> 0 THEN k * 0.3::DOUBLE + 5 END AS origin_temperature,
    (k % 50 + 40)::DOUBLE AS origin_humidity,
    CASE k % 4 WHEN 0 THEN 'clear sky' WHEN 1 THEN 'broken clouds' WHEN 2 THEN 'light rain' END AS origin_weather,
    CASE WHEN event_id % 13 <> 0 THEN k * 0.25::DOUBLE + 6 END AS destination_temperature,
    (k % 40 + 45)::DOUBLE AS destination_humidity,
    CASE k % 3 WHEN 0 THEN 'clear sky' WHEN 1 THEN 'mist' ELSE 'broken clouds' END AS destination_weather
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events))"""


def with_tables(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# --- places derived from the customer, supplier and nation tables ----------------------------------------------------
SEGMENT_CATEGORY = {
    "BUILDING": (["edificio"] * 5, ["house", "apartments", "residential", "warehouse", "yes"]),
    "FURNITURE": (
        ["business"] * 25,
        ["wholesale", "trade", "butcher", "seafood", "greengrocer", "bakery", "beverages", "alcohol", "supermarket",
         "convenience", "hardware", "stationery", "sports", "chemist", "car_parts", "cosmetics", "laundry", "company",
         "lawyer", "insurance", "clothes", "shoes", "deli", "optician", "car"],
    ),
    "HOUSEHOLD": (["food_drink"] * 5, ["restaurant", "cafe", "bar", "pub", "fast_food"]),
    "MACHINERY": (
        ["school", "hospital", "leisure", "sport", "alojamiento"], ["school", "pharmacy", "museum", "fitness_centre", "hotel"],
    ),
    "AUTOMOBILE": (
        ["taller", "belleza", "mall", "taller", "leisure"], ["car_repair", "hairdresser", "mall", "tyres", "nightclub"],
    ),
}
PLACE_NAMES = [
    "Café Central", "Cafe Central Malta", "La Marina", "Marina Bar", "Farmacia Nueva", "Ottica Rossi", "Óptica Rossi",
    "Garage Vella", "Vella & Sons", "Peluquería Ana", "Ana", "Palace Hotel",
]


def _lookup(side: int, quote_list, index) -> str:
    cases = " ".join(
        f"WHEN '{segment}' THEN {quote_list(parts[side], index('c_nationkey', len(parts[side])))}"
        for segment, parts in SEGMENT_CATEGORY.items()
    )
    return f"CASE c_mktsegment {cases} END"


def _items(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _spark_list(values, place) -> str:
    return f"element_at(array({_items(values)}), {place})"


def _duck_list(values, place) -> str:
    return f"([{_items(values)}])[{place}]"


def _place(key, size) -> str:
    return f"CAST({key} % {size} AS INT) + 1"


def lat_of(key: str) -> str:
    return f"35.84e0 + (({key} * 7919) % 9973) / 9973e0 * 0.1e0"


def lon_of(key: str) -> str:
    return f"14.44e0 + (({key} * 104729) % 9967) / 9967e0 * 0.14e0"


def _pois_sql(pick, source: str) -> str:
    return f"""SELECT CASE WHEN c_nationkey < 13 THEN 'node' ELSE 'way' END AS osm_type, c_custkey AS osm_id,
    {_lookup(0, pick, _place)} AS category, {_lookup(1, pick, _place)} AS subcategory,
    {pick(PLACE_NAMES, _place("c_custkey", len(PLACE_NAMES)))} AS name,
    {lat_of("c_custkey")} AS latitude, {lon_of("c_custkey")} AS longitude, c_acctbal, c_nationkey FROM {source}"""


def _second_sql(pick, source: str) -> str:
    return f"""SELECT s_suppkey AS place_id, {pick(["restaurant", "retail", "services"], _place("s_nationkey", 3))} AS category,
    {pick(PLACE_NAMES, _place("s_suppkey", len(PLACE_NAMES)))} AS name,
    {lat_of("(s_suppkey * 15 + 7)")} + 0.0002e0 AS latitude, {lon_of("(s_suppkey * 15 + 7)")} AS longitude FROM {source}"""


def _zones_sql(source: str) -> str:
    return f"""SELECT n_name AS zone, n_nationkey AS zone_order, 35.845e0 + ((n_nationkey * 37) % 25) / 25e0 * 0.09e0 AS zone_lat,
    14.45e0 + ((n_nationkey * 53) % 23) / 23e0 * 0.12e0 AS zone_lon FROM {source}"""


POIS = f"pois AS ({_pois_sql(_duck_list, 'customer')})"
SECOND = f"second AS ({_second_sql(_duck_list, 'supplier')})"
ZONES = f"zones AS ({_zones_sql('nation')})"


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One POI per customer."""
    return spark.sql(_pois_sql(_spark_list, "{src}"), src=table(spark, sf_dir, "customer"))


def second_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One place of the second source per supplier."""
    return spark.sql(_second_sql(_spark_list, "{src}"), src=table(spark, sf_dir, "supplier"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One zone per nation."""
    return spark.sql(_zones_sql("{src}"), src=table(spark, sf_dir, "nation"))


POPULATION = """population AS (
  SELECT n_name AS zone, CAST(year(o_orderdate) AS VARCHAR) AS date, year(o_orderdate)::INT AS year, count(*) AS population, o_orderpriority AS source
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE year(o_orderdate) < 1998 + n_nationkey % 5 GROUP BY ALL),
national AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS date, year(o_orderdate)::INT AS year, count(*) AS population FROM orders GROUP BY ALL)"""


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per nation, year and priority as a population history; each nation's series stops at its own year."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    year = F.year("o_orderdate")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .filter(year < F.col("n_nationkey") % 5 + 1998)
        .groupBy(F.col("n_name").alias("zone"), year.cast("string").alias("date"), year.alias("year"), F.col("o_orderpriority").alias("source"))
        .agg(F.count("*").alias("population"))
    )


def national_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("o_orderdate")
    return table(spark, sf_dir, "orders").groupBy(year.cast("string").alias("date"), year.alias("year")).agg(F.count("*").alias("population"))
