"""Landed provider documents (JSON text, one per row) to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions.taxonomy import CATEGORY_TAGS, classify, second_source_bucket, theme_category

TRAFFIC_SCHEMA = """routes array<struct<
  summary: struct<lengthInMeters: double, travelTimeInSeconds: double, trafficDelayInSeconds: double,
    noTrafficTravelTimeInSeconds: double, trafficLengthInMeters: double, departureTime: string, arrivalTime: string>,
  legs: array<struct<points: array<struct<latitude: double, longitude: double>>>>>>"""
PLAIN_SCHEMA = "routes array<struct<summary: struct<distance: double, duration: double>, geometry: string>>"
WEATHER_SCHEMA = """main struct<temp: double, feels_like: double, humidity: double>,
  weather array<struct<description: string>>"""
ELEMENT = """struct<type: string, id: bigint, lat: double, lon: double, center: struct<lat: double, lon: double>,
  tags: map<string,string>, timestamp: string>"""
ELEMENTS_SCHEMA = f"remark string, elements array<{ELEMENT}>"
PLACES_SCHEMA = """results array<struct<fsq_place_id: string, fsq_id: string, name: string, latitude: double,
  longitude: double, geocodes: struct<main: struct<latitude: double, longitude: double>>,
  categories: array<struct<name: string>>>>"""


def _speed(distance_km: Column, minutes: Column) -> Column:
    return F.when(minutes > 0, distance_km / (minutes / 60)).otherwise(0.0)


def traffic_routes(docs: DataFrame, body: str = "body") -> DataFrame:
    """First route of a traffic provider's answer; documents without a route give no row."""
    other = [c for c in docs.columns if c != body]
    route = F.try_element_at(F.from_json(body, TRAFFIC_SCHEMA)["routes"], F.lit(1))
    rows = docs.select(*other, route.alias("_r")).filter(F.col("_r").isNotNull())
    s = F.col("_r.summary")
    delay = F.coalesce(s["trafficDelayInSeconds"], F.lit(0.0))
    free = F.coalesce(s["noTrafficTravelTimeInSeconds"], F.greatest(F.lit(0.0), s["travelTimeInSeconds"] - delay))
    km, minutes = s["lengthInMeters"] / 1000, s["travelTimeInSeconds"] / 60
    points = F.try_element_at(F.col("_r.legs"), F.lit(1))["points"]
    return rows.select(
        *other,
        F.round(km, 2).alias("distance_km"),
        F.round(minutes, 2).alias("travel_time_min"),
        F.round(free / 60, 2).alias("no_traffic_time_min"),
        F.round(delay / 60, 2).alias("traffic_delay_min"),
        F.round(F.coalesce(s["trafficLengthInMeters"], F.lit(0.0)) / 1000, 2).alias("traffic_length_km"),
        F.round(_speed(km, minutes), 2).alias("average_speed_kmh"),
        s["departureTime"].alias("departure_time"),
        s["arrivalTime"].alias("arrival_time"),
        F.to_json(points).alias("polyline"),
    )


def plain_routes(docs: DataFrame, body: str = "body") -> DataFrame:
    """First route of a provider without traffic; the traffic fields are NULL."""
    other = [c for c in docs.columns if c != body]
    route = F.try_element_at(F.from_json(body, PLAIN_SCHEMA)["routes"], F.lit(1))
    rows = docs.select(*other, route.alias("_r")).filter(F.col("_r").isNotNull())
    km, minutes = F.col("_r.summary.distance") / 1000, F.col("_r.summary.duration") / 60
    unknown = F.lit(None)
    return rows.select(
        *other,
        F.round(km, 2).alias("distance_km"),
        F.round(minutes, 2).alias("travel_time_min"),
        unknown.cast("double").alias("no_traffic_time_min"),
        unknown.cast("double").alias("traffic_delay_min"),
        unknown.cast("double").alias("traffic_length_km"),
        F.round(_speed(km, minutes), 2).alias("average_speed_kmh"),
        unknown.cast("string").alias("departure_time"),
        unknown.cast("string").alias("arrival_time"),
        F.col("_r.geometry").alias("polyline"),
    )


def weather(docs: DataFrame, body: str = "body") -> DataFrame:
    other = [c for c in docs.columns if c != body]
    rows = docs.select(*other, F.from_json(body, WEATHER_SCHEMA).alias("_w"))
    first = F.try_element_at(F.col("_w.weather"), F.lit(1))["description"]
    return rows.select(
        *other,
        F.col("_w.main.temp").alias("temperature"),
        F.col("_w.main.feels_like").alias("feels_like"),
        F.col("_w.main.humidity").alias("humidity"),
        F.coalesce(first, F.lit("Unknown")).alias("weather"),
    )


def attach_weather(cycle_rows: DataFrame, zone_weather: DataFrame, cycle: str = "cycle") -> DataFrame:
    """Weather of the origin and of the destination of each route in its collection cycle; missing weather is NULL."""
    def side(name):
        return zone_weather.select(
            F.col(cycle),
            F.col("zone").alias(name),
            F.col("temperature").alias(f"{name}_temperature"),
            F.col("feels_like").alias(f"{name}_feels_like"),
            F.col("humidity").alias(f"{name}_humidity"),
            F.col("weather").alias(f"{name}_weather"),
        )

    joined = cycle_rows.join(side("origin"), [cycle, "origin"], "left")
    return joined.join(side("destination"), [cycle, "destination"], "left")


# --- map elements and places -----------------------------------------------------------------------------------------
def valid_documents(docs: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Documents with an element list and no remark, and the rejected ones with the reason."""
    parsed = docs.withColumn("_d", F.from_json(body, ELEMENTS_SCHEMA))
    reason = (
        F.when(F.col("_d").isNull(), "not a JSON object")
        .when(F.coalesce(F.col("_d.remark"), F.lit("")) != "", "remark")
        .when(F.col("_d.elements").isNull(), "no elements")
        .when(F.exists("_d.elements", lambda e: e.isNull()), "element is not an object")
    )
    marked = parsed.withColumn("reason", reason)
    good = marked.filter(F.col("reason").isNull()).drop("reason", body).withColumnRenamed("_d", "document")
    return good, marked.filter(F.col("reason").isNotNull()).drop("_d")


def elements(docs: DataFrame, body: str = "body") -> DataFrame:
    """One row per element of the valid documents, reduced to the allowed fields."""
    good, _ = valid_documents(docs, body)
    other = [c for c in good.columns if c != "document"]
    return good.select(*other, F.explode("document.elements").alias("_e")).select(*other, "_e.*")


def position(df: DataFrame) -> DataFrame:
    """Adds latitude and longitude: those of a node, the centre of anything else."""
    node = F.col("type") == "node"
    return df.withColumns(
        {
            "latitude": F.when(node, F.col("lat")).otherwise(F.col("center.lat")),
            "longitude": F.when(node, F.col("lon")).otherwise(F.col("center.lon")),
        }
    )


def unnamed(category: Column) -> Column:
    words = F.lower(F.replace(category, F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)), F.lit(" (sin nombre)"))


def element_pois(elements_df: DataFrame, rules=CATEGORY_TAGS) -> DataFrame:
    """POIs of the elements that fall in a category and have a position."""
    rows = position(elements_df).withColumn("_c", classify(F.col("tags"), rules))
    rows = rows.filter(F.col("_c").isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    name = F.nullif(F.try_element_at("tags", F.lit("name")), F.lit(""))
    return rows.select(
        F.col("type").alias("osm_type"),
        F.col("id").alias("osm_id"),
        F.col("_c.category").alias("category"),
        F.col("_c.subcategory").alias("subcategory"),
        F.coalesce(name, unnamed(F.col("_c.category"))).alias("name"),
        "latitude",
        "longitude",
    )


def context_pois(elements_df: DataFrame, theme: str = "theme") -> DataFrame:
    """Context elements by theme; those without a position or a used kind are dropped."""
    tags = F.coalesce("tags", F.create_map().cast("map<string,string>"))
    rows = position(elements_df).withColumn("_c", theme_category(F.col(theme), tags))
    return rows.filter(F.col("_c").isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        "_c.category", "_c.subcategory", "latitude", "longitude"
    )


def places(docs: DataFrame, body: str = "body") -> DataFrame:
    """Places of the second source, in either of its two layouts; places without id or position are dropped."""
    other = [c for c in docs.columns if c != body]
    rows = docs.select(*other, F.explode(F.from_json(body, PLACES_SCHEMA)["results"]).alias("p"))
    names = F.filter(F.transform(F.coalesce("p.categories", F.array()), lambda c: c["name"]), lambda n: n.isNotNull() & (n != ""))
    bucket = second_source_bucket(F.array_join(names, " "))
    rows = rows.select(
        *other,
        F.coalesce(F.nullif(F.col("p.fsq_place_id"), F.lit("")), F.nullif(F.col("p.fsq_id"), F.lit(""))).alias("fsq_place_id"),
        bucket.alias("category"),
        F.try_element_at(names, F.lit(1)).alias("subcategory"),
        F.nullif(F.col("p.name"), F.lit("")).alias("name"),
        _either("latitude").alias("latitude"),
        _either("longitude").alias("longitude"),
    )
    rows = rows.na.drop(subset=["fsq_place_id", "latitude", "longitude"])
    return rows.withColumn("name", F.coalesce("name", F.concat(F.initcap("category"), F.lit(" (sin nombre)"))))


def _either(side: str) -> Column:
    flat = F.col("p.latitude").isNotNull() & F.col("p.longitude").isNotNull()
    return F.when(flat, F.col(f"p.{side}")).otherwise(F.col(f"p.geocodes.main.{side}"))


# --- population ------------------------------------------------------------------------------------------------------
def population_history(rows: DataFrame, zones: DataFrame) -> DataFrame:
    """Observations of the known entities, once per zone, date and source. `zones` maps entity to zone."""
    source = F.coalesce(F.nullif(F.trim("importName"), F.lit("")), F.nullif(F.trim("facetId"), F.lit("")), F.lit(""))
    year = F.when(F.col("date").rlike("^[0-9]{4}"), F.substring("date", 1, 4).try_cast("int"))
    known = rows.join(zones, "entity").filter(
        F.col("date").isNotNull() & (F.trim("date") != "") & F.col("value").isNotNull() & ~F.isnan("value")
    )
    shaped = known.select("zone", F.trim("date").alias("date"), year.alias("year"), F.col("value").cast("bigint").alias("population"), source.alias("source"), "row_no")
    first = F.min_by(F.struct("year", "population"), "row_no")
    return shaped.groupBy("zone", "date", "source").agg(first.alias("f")).select("zone", "date", "f.year", "f.population", "source")


def latest_population(rows: DataFrame, zones: DataFrame) -> DataFrame:
    return rows.join(zones, "entity").na.drop(subset=["value"]).select(
        "zone", F.col("value").cast("bigint").alias("population"), F.coalesce(F.col("date"), F.lit("")).alias("date"),
        F.coalesce(F.col("entity_name"), F.lit("")).alias("matched_name"),
    )


def empty_table(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
