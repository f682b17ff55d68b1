"""Queries over payloads, migrations, upserts, integrity checks, rules tables and population series."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import functions as F

from wayloom.functions import scalars as S
from wayloom.functions import taxonomy as T
from wayloom.functions import text as X
from wayloom.operators import medallion as M
from wayloom.operators import population as P
from wayloom.operators import quality as Q
from wayloom.operators import rollups as R
from wayloom.operators import upserts as U
from wayloom.plans import common as C
from wayloom.plans.common import MEASUREMENTS, measurements, r6, shown, table, with_tables
from wayloom.schemas import ROUTE
from wayloom.sources import payloads as L
from wayloom.sources import tables as D

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
MEAS = with_tables(MEASUREMENTS)


def register(name: str, build: Callable, oracle: str | None = None) -> None:
    QUERIES[name] = build
    if oracle is not None:
        ORACLE[name] = oracle


# --- payloads: documents written from the tables, then parsed --------------------------------------------------------
def traffic_documents(spark, sf):
    meters, seconds = F.col("l_extendedprice"), F.col("l_quantity") * 60
    summary = F.struct(
        meters.alias("lengthInMeters"),
        seconds.alias("travelTimeInSeconds"),
        F.when(F.col("l_returnflag") != "N", seconds * F.col("l_discount")).alias("trafficDelayInSeconds"),
        F.when(F.col("l_returnflag") == "A", seconds * 0.5).alias("noTrafficTravelTimeInSeconds"),
    )
    body = F.to_json(F.struct(F.array(F.struct(summary.alias("summary"))).alias("routes")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", body.alias("body"))


register(
    "traffic_payload_rows",
    lambda spark, sf: L.traffic_routes(traffic_documents(spark, sf)).groupBy("l_orderkey", "l_linenumber").agg(
        F.count("*").alias("n"), *[shown(F.sum(c), 3).alias(c) for c in ("distance_km", "travel_time_min", "no_traffic_time_min", "traffic_delay_min", "traffic_length_km")]),
    """WITH d AS (SELECT *, CASE WHEN l_returnflag <> 'N' THEN l_quantity * 60 * l_discount ELSE 0 END AS delay FROM lineitem),
    r AS (SELECT l_orderkey, l_linenumber, round(l_extendedprice::DECIMAL(18,2) * 0.001::DECIMAL(5,4), 2)::DOUBLE AS distance_km, round(l_quantity, 2) AS travel_time_min,
      round(CASE WHEN l_returnflag = 'A' THEN l_quantity * 0.5::DOUBLE ELSE greatest(0, l_quantity * 60 - delay) / 60 END, 2) AS no_traffic_time_min,
      round(delay / 60, 2) AS traffic_delay_min FROM d)
    SELECT l_orderkey, l_linenumber, count(*) AS n, """
    + ", ".join(f"{r6(f'sum({c})', 3)} AS {c}" for c in ("distance_km", "travel_time_min", "no_traffic_time_min", "traffic_delay_min"))
    + ", 0::DOUBLE AS traffic_length_km FROM r GROUP BY 1, 2",
)


def plain_documents(spark, sf):
    summary = F.struct(F.col("o_totalprice").alias("distance"), (F.year("o_orderdate") * 1.0).alias("duration"))
    body = F.to_json(F.struct(F.array(F.struct(summary.alias("summary"))).alias("routes")))
    return table(spark, sf, "orders").select("o_orderkey", body.alias("body"))


register(
    "plain_payload_rows",
    lambda spark, sf: L.plain_routes(plain_documents(spark, sf)).select("o_orderkey", "distance_km", "travel_time_min", "traffic_delay_min"),
    """SELECT o_orderkey, round(o_totalprice::DECIMAL(18,2) * 0.001::DECIMAL(5,4), 2)::DOUBLE AS distance_km, round(year(o_orderdate) / 60, 2) AS travel_time_min,
    NULL::DOUBLE AS traffic_delay_min FROM orders""",
)


def weather_documents(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    main = F.struct((k * 0.5).alias("temp"), F.when(k % 2 == 0, k * 0.25).alias("feels_like"), (k * 1.0).alias("humidity"))
    items = F.when(k % 5 == 0, F.array().cast("array<struct<description:string>>")).otherwise(F.array(F.struct(F.col("event_type").alias("description"))))
    return table(spark, sf, "events").select("event_id", F.to_json(F.struct(main.alias("main"), items.alias("weather"))).alias("body"))


register(
    "weather_payload_rows",
    lambda spark, sf: L.weather(weather_documents(spark, sf)),
    """SELECT event_id, k * 0.5::DOUBLE AS temperature, CASE WHEN k % 2 = 0 THEN k * 0.25::DOUBLE END AS feels_like, k::DOUBLE AS humidity,
    CASE WHEN k % 5 = 0 THEN 'Unknown' ELSE event_type END AS weather FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)""",
)


def cycle_weather(spark, sf):
    m = measurements(spark, sf).withColumn("cycle", F.to_date("timestamp"))
    zone_weather = m.groupBy("cycle", F.col("origin").alias("zone")).agg(
        F.avg("origin_temperature").alias("temperature"), F.avg("destination_temperature").alias("feels_like"),
        F.avg("origin_humidity").alias("humidity"), F.max("origin_weather").alias("weather"),
    )
    routes = m.select("cycle", *ROUTE).distinct()
    return L.attach_weather(routes, zone_weather).select(
        "cycle", *ROUTE, shown(F.col("origin_temperature")).alias("origin_temperature"), "origin_weather", "destination_weather"
    )


register(
    "weather_at_both_ends",
    cycle_weather,
    MEAS + f""", w AS (SELECT CAST(timestamp AS DATE) AS cycle, origin AS zone, avg(origin_temperature) AS t, max(origin_weather) AS w FROM measurements GROUP BY 1, 2),
    r AS (SELECT DISTINCT CAST(timestamp AS DATE) AS cycle, origin, destination FROM measurements)
    SELECT r.cycle, origin, destination, {r6("a.t")} AS origin_temperature, a.w AS origin_weather, b.w AS destination_weather FROM r
    LEFT JOIN w a ON r.cycle = a.cycle AND origin = a.zone LEFT JOIN w b ON r.cycle = b.cycle AND destination = b.zone""",
)

TAG_KEY = {"edificio": "building", "business": "shop", "food_drink": "amenity", "school": "amenity", "hospital": "amenity",
           "leisure": "tourism", "sport": "leisure", "alojamiento": "tourism", "taller": "shop", "belleza": "shop", "mall": "shop"}


def element_documents(spark, sf):
    """Map documents: the POIs of each nation as one JSON document of nodes and ways with tags."""
    p = C.pois(spark, sf)
    keys = F.create_map(*[F.lit(x) for pair in TAG_KEY.items() for x in pair])
    key = F.when(F.col("subcategory") == "nightclub", "amenity").otherwise(F.try_element_at(keys, F.col("category")))
    tags = F.map_concat(F.create_map(key, F.col("subcategory")), F.create_map(F.lit("name"), F.when(F.col("c_acctbal") >= 0, F.col("name"))))
    node = F.col("osm_type") == "node"
    element = F.struct(
        F.col("osm_type").alias("type"), F.col("osm_id").alias("id"),
        F.when(node, F.col("latitude")).alias("lat"), F.when(node, F.col("longitude")).alias("lon"),
        F.when(~node, F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))).alias("center"), tags.alias("tags"),
    )
    return p.select("osm_id", F.to_json(F.struct(F.array(element).alias("elements"))).alias("body"))


register(
    "element_pois",
    lambda spark, sf: L.element_pois(L.elements(element_documents(spark, sf))).select(
        "osm_type", "osm_id", "category", "subcategory", "name", shown(F.col("latitude"), 9).alias("latitude")),
    with_tables(C.POIS) + f"""SELECT osm_type, osm_id, category, subcategory,
    CASE WHEN c_acctbal >= 0 THEN name ELSE upper(substr(category, 1, 1)) || replace(substr(category, 2), '_', ' ') || ' (sin nombre)' END AS name,
    {r6("latitude", 9)} AS latitude FROM pois WHERE category <> 'edificio'""",
)
register(
    "study_categories",
    lambda spark, sf: L.element_pois(L.elements(element_documents(spark, sf)), T.STUDY_TAGS).groupBy("category", "subcategory").agg(F.count("*").alias("n")),
    with_tables(C.POIS) + """SELECT CASE WHEN category IN ('taller', 'belleza') THEN 'business' ELSE category END AS category, subcategory, count(*) AS n
    FROM pois WHERE category NOT IN ('edificio', 'alojamiento') GROUP BY 1, 2""",
)
register(
    "context_pois",
    lambda spark, sf: L.context_pois(
        L.elements(element_documents(spark, sf)).withColumn("theme", F.when(F.map_contains_key("tags", "building"), "edificios").otherwise("alojamiento"))
        .filter(F.map_contains_key("tags", "building") | F.map_contains_key("tags", "tourism"))
    ).groupBy("category", "subcategory").agg(F.count("*").alias("n")),
    with_tables(C.POIS) + """SELECT CASE WHEN category = 'edificio' THEN 'edificio' ELSE 'alojamiento' END AS category, subcategory, count(*) AS n FROM pois
    WHERE category IN ('edificio', 'alojamiento') OR subcategory = 'museum' GROUP BY 1, 2""",
)


def place_documents(spark, sf):
    s = C.second_source(spark, sf)
    flat = F.col("place_id") % 2 == 0
    categories = F.array(F.struct(F.concat(F.initcap("category"), F.when(F.col("category") == "services", " Bank").otherwise("")).alias("name")))
    place = F.struct(
        F.when(flat, F.concat(F.lit("p"), F.col("place_id"))).alias("fsq_place_id"), F.when(~flat, F.concat(F.lit("p"), F.col("place_id"))).alias("fsq_id"),
        F.col("name"), F.when(flat, F.col("latitude")).alias("latitude"), F.when(flat, F.col("longitude")).alias("longitude"),
        F.when(~flat, F.struct(F.struct("latitude", "longitude").alias("main"))).alias("geocodes"), categories.alias("categories"),
    )
    return s.select(F.col("place_id").alias("search_order"), F.to_json(F.struct(F.array(place).alias("results"))).alias("body"))


register(
    "second_source_places",
    lambda spark, sf: U.last_wins(L.places(place_documents(spark, sf)), ["fsq_place_id"], F.col("search_order")).select(
        "fsq_place_id", "category", "name", shown(F.col("latitude"), 9).alias("latitude")),
    with_tables(C.SECOND) + f"SELECT 'p' || place_id AS fsq_place_id, category, name, {r6('latitude', 9)} AS latitude FROM second",
)

# --- migrations ------------------------------------------------------------------------------------------------------
def text_rows(spark, sf):
    m = measurements(spark, sf)
    return m.select(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "origin", F.when(F.col("id") % 97 != 0, F.col("destination")).alias("destination"),
        F.when(F.col("data_source") == "base", F.col("data_source")).alias("data_source"),
        F.when(F.col("origin_weather").isNull(), "n/a").otherwise(F.col("travel_time_min").cast("string")).alias("travel_time_min"),
    )


register(
    "migrated_rows",
    lambda spark, sf: D.migrate(text_rows(spark, sf)).groupBy(*ROUTE, "data_source").agg(
        F.count("*").alias("n"), F.count("travel_time_min").alias("known"), shown(F.sum("travel_time_min")).alias("total"), F.count("distance_km").alias("distances")),
    MEAS + f"""SELECT origin, destination, CASE WHEN data_source = 'base' THEN 'base' ELSE 'unknown' END AS data_source, count(*) AS n,
    count(travel_time_min) FILTER (origin_weather IS NOT NULL) AS known, {r6("sum(travel_time_min) FILTER (origin_weather IS NOT NULL)")} AS total, 0::BIGINT AS distances
    FROM measurements WHERE id % 97 <> 0 GROUP BY 1, 2, 3""",
)
register(
    "migration_preview",
    lambda spark, sf: D.migration_preview(D.migrate(text_rows(spark, sf))),
    MEAS + """SELECT count(*) AS records, strftime(min(timestamp), '%Y-%m-%dT%H:%M:%S.%f') AS first, strftime(max(timestamp), '%Y-%m-%dT%H:%M:%S.%f') AS last
    FROM measurements WHERE id % 97 <> 0""",
)
register(
    "trip_rows",
    lambda spark, sf: D.to_trips(measurements(spark, sf).withColumn("mobility_level", S.mobility_level(F.col("travel_time_min")))).select(
        F.col("datetime").cast("timestamp_ntz").alias("datetime"), *ROUTE, "duration_min", "temperature", "weather_description", "mobility_level", "data_source"),
    MEAS + """SELECT timestamp AS datetime, origin, destination, travel_time_min AS duration_min, origin_temperature AS temperature,
    origin_weather AS weather_description, CASE WHEN travel_time_min > 20 THEN 'Alta demora' ELSE 'Movilidad normal' END AS mobility_level, data_source FROM measurements""",
)


def trips(spark, sf):
    return D.to_trips(measurements(spark, sf).withColumn("mobility_level", S.mobility_level(F.col("travel_time_min"))))


def shown_hours(df):
    return df.withColumn("hour", F.col("hour").cast("timestamp_ntz")).withColumns({c: shown(F.col(c)) for c in R.MEASURES.values()})


def late_rows(spark, sf):
    """States of the trips of all sources but one, into which the trips of that one are merged when they arrive."""
    rows = trips(spark, sf)
    here = F.col("data_source") == "base"
    return shown_hours(R.figures(R.merged(R.hourly_states(rows.filter(here)), R.hourly_states(rows.filter(~here)))))


def corrected_rows(spark, sf):
    """States of trips whose durations were wrong in one week; the hours of that week are computed again."""
    rows = trips(spark, sf)
    low, high = datetime(2024, 1, 8), datetime(2024, 1, 14, 23)
    wrong = F.col("datetime").between(F.lit(low), F.lit(datetime(2024, 1, 14, 23, 59, 59)))
    stale = R.hourly_states(rows.withColumn("duration_min", F.when(wrong, F.col("duration_min") + 5).otherwise(F.col("duration_min"))))
    return shown_hours(R.figures(R.recomputed(stale, rows, low, high)))


def live_rows(spark, sf):
    rows = trips(spark, sf)
    until = datetime(2024, 1, 20, 6)
    return shown_hours(R.live(R.hourly_states(rows), rows, until))


TRIPS_HOURLY = MEAS + f"""SELECT date_trunc('hour', timestamp)::TIMESTAMP AS hour, origin, destination, count(*) AS num_trips, {r6("avg(travel_time_min)")} AS avg_duration_min,
    {r6("avg(distance_km)")} AS avg_distance_km, {r6("avg(origin_temperature)")} AS avg_temperature, {r6("avg(origin_humidity)")} AS avg_humidity,
    {r6("avg(traffic_delay_min)")} AS avg_traffic_delay_min, round(100e0 * count(*) FILTER (travel_time_min > 20) / count(*), 1) AS pct_alta_demora FROM measurements GROUP BY 1, 2, 3"""
register("trips_hourly", lambda spark, sf: shown_hours(R.figures(R.hourly_states(trips(spark, sf)))), TRIPS_HOURLY)
register("trips_hourly_late_rows", late_rows, TRIPS_HOURLY)
register("trips_hourly_corrected", corrected_rows, TRIPS_HOURLY)
register("trips_hourly_live", live_rows, TRIPS_HOURLY)


def legacy_merge(spark, sf):
    m = measurements(spark, sf)
    plain = m.filter(F.col("data_source") == "base").select(
        F.col("timestamp").cast("string").alias("datetime"), *ROUTE, "distance_km", F.col("travel_time_min").alias("duration_min"),
        F.col("origin_temperature").alias("temperature"), F.col("origin_humidity").alias("humidity"),
        F.col("origin_weather").alias("weather_description"), S.mobility_level(F.col("travel_time_min")).alias("mobility_level"),
    )
    traffic = m.filter(F.col("data_source") == "traffic").withColumn("timestamp", F.col("timestamp").cast("string"))
    return D.merge_legacy(plain, traffic).groupBy(*ROUTE, "data_source", "mobility_level").agg(
        F.count("*").alias("n"), shown(F.sum("average_speed_kmh"), 3).alias("speed"), F.count("destination_temperature").alias("temperatures"))


register(
    "legacy_merge",
    legacy_merge,
    MEAS + f"""SELECT origin, destination, CASE WHEN data_source = 'base' THEN 'ors' ELSE 'tomtom' END AS data_source,
    CASE WHEN travel_time_min > 20 THEN 'Alta demora' ELSE 'Movilidad normal' END AS mobility_level, count(*) AS n,
    {r6("sum(CASE WHEN data_source = 'base' THEN round(distance_km / nullif(travel_time_min / 60, 0), 2) ELSE average_speed_kmh END)", 3)} AS speed,
    count(CASE WHEN data_source = 'base' THEN origin_temperature ELSE destination_temperature END) AS temperatures FROM measurements GROUP BY 1, 2, 3, 4""",
)
register(
    "evaluation_rows",
    lambda spark, sf: D.evaluation_rows(measurements(spark, sf), "2024-01-15 00:00:00").groupBy("data_source").agg(F.count("*").alias("n"), F.min("timestamp").alias("first")),
    MEAS + "SELECT data_source, count(*) AS n, min(timestamp) AS first FROM measurements WHERE timestamp >= TIMESTAMP '2024-01-15' GROUP BY 1",
)
register(
    "bundle_route_means",
    lambda spark, sf: D.route_means(measurements(spark, sf)).withColumn("travel_time_min", shown(F.col("travel_time_min"))),
    MEAS + f"SELECT origin, destination, {r6('avg(travel_time_min)')} AS travel_time_min, count(*) AS n_mediciones FROM measurements GROUP BY 1, 2",
)

# --- upserts ---------------------------------------------------------------------------------------------------------
register(
    "insert_absent",
    lambda spark, sf: M.insert_absent(measurements(spark, sf), measurements(spark, sf).filter(F.col("data_source") == "base"), ["timestamp", *ROUTE]).select("id", "timestamp", *ROUTE),
    MEAS + """SELECT id, timestamp, origin, destination FROM measurements m WHERE NOT EXISTS (SELECT 1 FROM measurements b WHERE b.data_source = 'base'
    AND b.timestamp = m.timestamp AND b.origin = m.origin AND b.destination = m.destination)""",
)
register(
    "poi_upsert",
    lambda spark, sf: U.upsert(
        C.pois(spark, sf).select("osm_type", "osm_id", "category", "name", F.lit(1).alias("updated_at")),
        C.pois(spark, sf).filter(F.col("c_acctbal") > 5000).select("osm_type", "osm_id", F.lit("renewed").alias("category"), "name", F.lit(2).alias("updated_at"))
        .unionByName(C.pois(spark, sf).filter(F.col("c_acctbal") < 0).select(F.lit("relation").alias("osm_type"), "osm_id", "category", "name", F.lit(2).alias("updated_at"))),
        ["osm_type", "osm_id"], "updated_at"),
    with_tables(C.POIS) + """SELECT osm_type, osm_id, CASE WHEN c_acctbal > 5000 THEN 'renewed' ELSE category END AS category, name,
    CASE WHEN c_acctbal > 5000 THEN 2 ELSE 1 END AS updated_at FROM pois
    UNION ALL SELECT 'relation', osm_id, category, name, 2 FROM pois WHERE c_acctbal < 0""",
)
register(
    "demographics_upsert",
    lambda spark, sf: U.coalescing_upsert(
        table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("population"), F.col("c_mktsegment").alias("source")),
        table(spark, sf, "customer").select((F.col("c_custkey") + 100).alias("c_custkey"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("population"),
                                            F.when(F.col("c_nationkey") > 9, F.lit("new")).alias("source")), ["c_custkey"]),
    """SELECT c_custkey, coalesce(n.population, o.population) AS population, coalesce(n.source, o.source) AS source FROM
    (SELECT c_custkey, c_acctbal AS population, c_mktsegment AS source FROM customer) o FULL OUTER JOIN
    (SELECT c_custkey + 100 AS c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS population, CASE WHEN c_nationkey > 9 THEN 'new' END AS source FROM customer) n USING (c_custkey)""",
)
register(
    "population_history_upsert",
    lambda spark, sf: U.upsert(C.population(spark, sf).withColumn("v", F.lit(1)),
                               C.population(spark, sf).filter(F.col("year") >= 1997).withColumns({"population": F.col("population") * 2, "v": F.lit(2)}),
                               ["zone", "date", "source"], "v").drop("v"),
    with_tables(C.POPULATION) + "SELECT zone, date, year, CASE WHEN year >= 1997 THEN population * 2 ELSE population END AS population, source FROM population",
)


def split_context(spark, sf):
    p = C.pois(spark, sf).select("category", "subcategory", "latitude", "longitude")
    context = p.filter(F.col("category").isin("edificio", "alojamiento")).unionByName(p.filter(F.col("category") == "school").withColumn("category", F.lit("industria")))
    return p.filter(~F.col("category").isin("edificio", "taller")), context


register(
    "pois_with_context",
    lambda spark, sf: U.merge_context(*split_context(spark, sf)).groupBy("category", "subcategory").agg(F.count("*").alias("n")),
    with_tables(C.POIS) + """SELECT category, subcategory, count(*) AS n FROM (SELECT category, subcategory FROM pois WHERE category <> 'taller'
    UNION ALL SELECT 'industria', subcategory FROM pois WHERE category = 'school') GROUP BY 1, 2""",
)
register(
    "duplicated_context_categories",
    lambda spark, sf: U.duplicated_categories(*split_context(spark, sf)),
    "SELECT 'alojamiento' AS category WHERE EXISTS (SELECT 1 FROM customer)",
)
register(
    "unique_elements",
    lambda spark, sf: U.unique_elements(
        (lambda e: e.unionByName(e))(L.elements(element_documents(spark, sf)).select("type", "id", "lat", "lon", "tags")), ["lat", "lon", "tags"]
    ).select("type", "id", shown(F.col("lat"), 9).alias("lat")),
    with_tables(C.POIS) + f"SELECT osm_type AS type, osm_id AS id, CASE WHEN osm_type = 'node' THEN {r6('latitude', 9)} END AS lat FROM pois",
)
register(
    "reclassified_pois",
    lambda spark, sf: U.reclassify(C.pois(spark, sf).withColumn("category", F.when(F.col("category").isin("taller", "belleza", "mall"), "business").otherwise(F.col("category")))).select("osm_id", "category", "subcategory"),
    with_tables(C.POIS) + "SELECT osm_id, category, subcategory FROM pois",
)


def bronze_texts(spark, sf):
    m = measurements(spark, sf).filter(F.col("travel_time_min").isNotNull())
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    legacy = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS'+00:00'")
    first = m.select("id", F.when(F.col("data_source") == "base", iso).otherwise(legacy).alias("raw_timestamp"), *ROUTE)
    again = m.filter(F.col("travel_time_min") > 20).select((F.col("id") + 10000000).alias("id"), legacy.alias("raw_timestamp"), *ROUTE)
    return first.unionByName(again)


BRONZE_TEXTS = """texts AS (SELECT id, CASE WHEN data_source = 'base' THEN strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f+00:00') ELSE strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f+00:00') END AS raw_timestamp, origin, destination
  FROM measurements WHERE travel_time_min IS NOT NULL
  UNION ALL SELECT id + 10000000, strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f+00:00'), origin, destination FROM measurements WHERE travel_time_min > 20),
keyed AS (SELECT *, replace(raw_timestamp, ' ', 'T') AS k, raw_timestamp LIKE '____-__-__ %' AS old FROM texts),
planned AS (SELECT *, CASE WHEN NOT old THEN 'keep' WHEN bool_or(NOT old) OVER (PARTITION BY k, origin, destination) THEN 'delete_twin'
  WHEN row_number() OVER (PARTITION BY k, origin, destination, old ORDER BY id) > 1 THEN 'delete_dup' ELSE 'rename' END AS action FROM keyed)"""
register("timestamp_repair_plan", lambda spark, sf: U.repair_plan(bronze_texts(spark, sf)).select("id", "raw_timestamp", "action"),
         with_tables(MEASUREMENTS, BRONZE_TEXTS) + "SELECT id, raw_timestamp, action FROM planned")
register("timestamp_repair_checks", lambda spark, sf: U.repair_checks(U.repair_plan(bronze_texts(spark, sf))),
         with_tables(MEASUREMENTS, BRONZE_TEXTS) + "SELECT 0::BIGINT AS legacy_left, count(*) AS rows, 0::BIGINT AS duplicate_groups, count(*) AS expected_rows FROM planned WHERE action IN ('keep', 'rename')")
register("timestamp_repaired", lambda spark, sf: U.repaired(U.repair_plan(bronze_texts(spark, sf))),
         with_tables(MEASUREMENTS, BRONZE_TEXTS) + "SELECT id, k AS raw_timestamp, origin, destination FROM planned WHERE action IN ('keep', 'rename')")
register(
    "table_diff",
    lambda spark, sf: U.table_diff(
        table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_name"),
        table(spark, sf, "customer").filter(F.col("c_acctbal") > -500).select("c_custkey", "c_mktsegment", F.when(F.col("c_nationkey") == 3, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal") + 1e-12).alias("c_acctbal"), "c_nationkey"),
        ["c_custkey", "c_mktsegment"], "c_mktsegment"),
    """SELECT c_mktsegment, count(*) FILTER (c_acctbal <= -500) AS rows_lost, 0::BIGINT AS rows_added, count(*) FILTER (c_acctbal > -500 AND c_nationkey = 3) AS rows_changed,
    'c_name' AS columns_lost, 'c_nationkey' AS columns_added FROM customer GROUP BY 1""",
)
register(
    "cleared_columns",
    lambda spark, sf: U.clear_columns(table(spark, sf, "customer"), ["c_acctbal"]),
    "SELECT c_custkey, c_name, c_nationkey, NULL::DOUBLE AS c_acctbal, c_mktsegment FROM customer",
)
register(
    "phrase_set_checks",
    lambda spark, sf: U.phrase_checks(
        table(spark, sf, "documents").filter(F.col("lang") != "es").select("text", "source"),
        table(spark, sf, "documents").filter(F.col("lang") != "fr").select("text", "source"), "text", "source", ["src0", "src1", "src2"]
    ).groupBy("problem").agg(F.count("*").alias("n"), F.count_distinct("phrase").alias("phrases")),
    """WITH c AS (SELECT text, count(*) FILTER (lang <> 'es') AS t, count(*) FILTER (lang <> 'fr') AS e FROM documents GROUP BY 1),
    u AS (SELECT text FROM documents WHERE lang <> 'es' AND source NOT IN ('src0', 'src1', 'src2') UNION ALL SELECT text FROM documents WHERE lang <> 'fr' AND source NOT IN ('src0', 'src1', 'src2')),
    b AS (SELECT text FROM documents WHERE lang <> 'es' AND trim(text) = '' UNION ALL SELECT text FROM documents WHERE lang <> 'fr' AND trim(text) = '')
    SELECT 'leak' AS problem, count(*) AS n, count(DISTINCT text) AS phrases FROM c WHERE t > 0 AND e > 0 HAVING count(*) > 0
    UNION ALL SELECT 'repeated', count(*), count(DISTINCT text) FROM c WHERE t > 1 OR e > 1 HAVING count(*) > 0
    UNION ALL SELECT 'unknown_class', count(*), count(DISTINCT text) FROM u HAVING count(*) > 0
    UNION ALL SELECT 'blank', count(*), count(DISTINCT text) FROM b HAVING count(*) > 0""",
)
register(
    "label_disagreement",
    lambda spark, sf: U.agreement(table(spark, sf, "labels"), "quality", "toxic", False).select("doc_id", "quality", "toxic"),
    "SELECT doc_id, quality, toxic FROM labels WHERE quality IS DISTINCT FROM toxic",
)

# --- integrity -------------------------------------------------------------------------------------------------------
register("duplicate_key_check", lambda spark, sf: Q.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]),
         """SELECT sum(n)::BIGINT AS rows, count(*) AS keys, sum(n - 1)::BIGINT AS surplus, count(*) FILTER (n > 1) AS duplicate_groups
         FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)""")
NULLABLE = ["travel_time_min", "no_traffic_time_min", "origin_temperature", "origin_weather"]
register("null_counts", lambda spark, sf: Q.null_counts(measurements(spark, sf).select(*NULLABLE)),
         MEAS + " UNION ALL ".join(f"SELECT '{c}' AS column, count(*) FILTER ({c} IS NULL) AS nulls, count(*) AS rows, round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 1) AS missing_pct FROM measurements" for c in NULLABLE))
register("table_hash", lambda spark, sf: Q.table_hash(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")),
         """SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(concat_ws(chr(31), c_custkey, c_mktsegment, c_name, c_nationkey)), 1, 15) AS BIGINT)) AS VARCHAR) AS digest FROM customer""")
register("table_manifest", lambda spark, sf: Q.manifest({t: table(spark, sf, t) for t in ("customer", "supplier", "nation")}, purpose="training").select("table", "rows", "columns", "purpose"),
         """SELECT 'customer' AS table, count(*) AS rows, 'c_acctbal,c_custkey,c_mktsegment,c_name,c_nationkey' AS columns, 'training' AS purpose FROM customer
         UNION ALL SELECT 'supplier', count(*), 's_acctbal,s_name,s_nationkey,s_suppkey', 'training' FROM supplier
         UNION ALL SELECT 'nation', count(*), 'n_name,n_nationkey,n_regionkey', 'training' FROM nation""")


def verified(spark, sf):
    published = Q.manifest({t: table(spark, sf, t) for t in ("customer", "supplier", "part")})
    current = {"customer": table(spark, sf, "customer").repartition(5), "supplier": table(spark, sf, "supplier").withColumn("s_acctbal", F.col("s_acctbal") + 1), "nation": table(spark, sf, "nation")}
    return Q.verify_manifest(current, published).select("table", "state")


register("manifest_verification", verified,
         "SELECT * FROM (VALUES ('customer', 'ok'), ('supplier', 'altered'), ('part', 'missing'), ('nation', 'not in manifest')) v(\"table\", state) WHERE (SELECT count(*) FROM customer) > 0")
register("input_fingerprint", lambda spark, sf: Q.fingerprint(table(spark, sf, "supplier"), ["s_suppkey", "s_name"], ["s_nationkey"]).select("s_nationkey", "rows", "digest"),
         """SELECT s_nationkey, count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(concat_ws(chr(31), s_name, s_suppkey)), 1, 15) AS BIGINT)) AS VARCHAR) AS digest FROM supplier GROUP BY 1""")


def landed(spark, sf):
    files = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("file"))
    declared = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("file"), F.col("o_orderpriority")).agg(F.count("*").alias("e")).groupBy("file").agg(
        (F.sum("e") + F.when(F.col("file").endswith("-03"), 2).otherwise(0)).alias("expected"), (F.col("file") == "1999-03").alias("is_current"))
    return Q.completeness(files, declared)


register("landed_completeness", landed,
         """SELECT file, n + CASE WHEN file LIKE '%-03' THEN 2 ELSE 0 END AS expected, n AS found, CASE WHEN file NOT LIKE '%-03' THEN 'complete'
         WHEN file = '1999-03' AND 2 <= (n + 2) * 0.02::DOUBLE THEN 'complete' ELSE 'incomplete' END AS state
         FROM (SELECT strftime(o_orderdate, '%Y-%m') AS file, count(*) AS n FROM orders GROUP BY 1)""")
register("snapshot_date_check",
         lambda spark, sf: Q.snapshot_date_check(table(spark, sf, "orders").select(
             F.col("o_orderpriority").alias("snapshot"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
             F.when(F.col("o_orderpriority") == "1-URGENT", "1997-01-01T00:00:00Z").when(F.col("o_orderpriority") == "2-HIGH", "2020-01-01T00:00:00Z").otherwise("2002-06-01T00:00:00Z").alias("date")),
             "snapshot", "date").select("snapshot", "elements", "newer", "state"),
         """WITH e AS (SELECT o_orderpriority AS snapshot, o_orderdate AS t, CASE o_orderpriority WHEN '1-URGENT' THEN TIMESTAMP '1997-01-01' WHEN '2-HIGH' THEN TIMESTAMP '2020-01-01' ELSE TIMESTAMP '2002-06-01' END AS d FROM orders)
         SELECT snapshot, count(*) AS elements, count(*) FILTER (t > d) AS newer, CASE WHEN count(*) FILTER (t > d) > 0 THEN 'date ignored' WHEN max(t) < any_value(d) - INTERVAL 730 DAY THEN 'behind' ELSE 'ok' END AS state FROM e GROUP BY 1""")
register("snapshot_file_check",
         lambda spark, sf: Q.snapshot_plan_check(table(spark, sf, "customer").select(F.concat("c_mktsegment", F.lit(".json")).alias("file")),
                                                 table(spark, sf, "supplier").select(F.when(F.col("s_nationkey") > 12, "BUILDING.json").otherwise("TODAY.json").alias("file"), F.lit("2022").alias("instant")).distinct()),
         """SELECT coalesce(p.file, f.file) AS file, instant, CASE WHEN instant IS NULL THEN 'unexpected' WHEN f.file IS NULL THEN 'missing' ELSE 'verified' END AS state
         FROM (SELECT DISTINCT CASE WHEN s_nationkey > 12 THEN 'BUILDING.json' ELSE 'TODAY.json' END AS file, '2022' AS instant FROM supplier) p FULL OUTER JOIN (SELECT DISTINCT c_mktsegment || '.json' AS file FROM customer) f ON p.file = f.file""")
register("rejected_documents",
         lambda spark, sf: L.valid_documents(element_documents(spark, sf).withColumn("body", F.when(F.col("osm_id") % 10 == 0, F.lit('{"remark": "timed out", "elements": []}'))
             .when(F.col("osm_id") % 10 == 1, F.lit('{"x": 1}')).otherwise(F.col("body"))))[1].groupBy("reason").agg(F.count("*").alias("n")),
         """SELECT CASE c_custkey % 10 WHEN 0 THEN 'remark' ELSE 'no elements' END AS reason, count(*) AS n FROM customer WHERE c_custkey % 10 < 2 GROUP BY 1""")

# --- rules and text --------------------------------------------------------------------------------------------------
GOODS = {"joyeria": ["ring", "gold ring"], "ferreteria": ["bolt", "gear", "widget"], "menaje": ["small", "red"]}
OUTSIDE = {"fundicion": ("secundario", ["steel", "steel bolt"]), "cantera": ("primario", ["brass"])}


def interpreted(spark, sf):
    words = X.business_text(F.concat_ws(" ", "p_name", "p_type"))
    p = table(spark, sf, "part").select("p_partkey", words.alias("t"))
    category, spot = X.keyword_category(F.col("t"), GOODS)
    hit = X.out_of_scope(F.col("t"), OUTSIDE)
    return p.select("p_partkey", category.alias("category"), spot.cast("int").alias("position"), hit["activity"].alias("activity"), hit["position"].cast("int").alias("activity_position"))


def _first(word: str) -> str:
    return f"nullif(strpos(' ' || t || ' ', ' {word} '), 0) - 1"


register(
    "keyword_category",
    interpreted,
    f"""WITH p AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS t FROM part),
    w AS (SELECT p_partkey, t, {", ".join(f"least({', '.join(_first(x + s) for x in ws for s in ('', 's', 'es'))}) AS {c}" for c, ws in GOODS.items())},
      {", ".join(f"least({', '.join(_first(x + s) for x in ws[1][:1] for s in ('', 's', 'es'))}) AS o_{c}" for c, ws in OUTSIDE.items())} FROM p)
    SELECT p_partkey, CASE WHEN joyeria IS NOT NULL THEN 'joyeria' WHEN ferreteria IS NOT NULL THEN 'ferreteria' WHEN menaje IS NOT NULL THEN 'menaje' END AS category,
    least(joyeria, ferreteria, menaje)::INT AS position, CASE WHEN least(o_fundicion, o_cantera) IS NULL THEN NULL WHEN o_cantera IS NULL OR o_fundicion < o_cantera THEN 'fundicion' ELSE 'cantera' END AS activity,
    least(o_fundicion, o_cantera)::INT AS activity_position FROM w""",
)
register(
    "interpreted_texts",
    lambda spark, sf: X.interpret(table(spark, sf, "part").select("p_partkey", X.business_text(F.col("p_name")).alias("t")), "t", GOODS).select(
        "p_partkey", "category", "source", X.sector_name(X.sector(F.col("category"), F.col("activity"))).alias("sector")),
    f"""WITH p AS (SELECT p_partkey, lower(p_name) AS t FROM part),
    w AS (SELECT p_partkey, {", ".join(f"least({', '.join(_first(x + s) for x in ws for s in ('', 's', 'es'))}) AS {c}" for c, ws in GOODS.items())} FROM p)
    SELECT p_partkey, CASE WHEN joyeria IS NOT NULL THEN 'joyeria' WHEN ferreteria IS NOT NULL THEN 'ferreteria' WHEN menaje IS NOT NULL THEN 'menaje' END AS category,
    CASE WHEN coalesce(joyeria, ferreteria, menaje) IS NOT NULL THEN 'palabras_clave' END AS source,
    CASE WHEN coalesce(joyeria, ferreteria, menaje) IS NOT NULL THEN 'Sector terciario' ELSE '' END AS sector FROM w""",
)
register(
    "normalised_names",
    lambda spark, sf: C.pois(spark, sf).select("osm_id", X.place_name(F.col("name")).alias("place"), X.match_name(F.col("name")).alias("matching"), X.model_text(F.col("name")).alias("model")),
    with_tables(C.POIS) + """SELECT osm_id, lower(strip_accents(replace(replace(name, ' & ', ' '), '&', ''))) AS place, lower(strip_accents(replace(name, ' & ', ' '))) AS matching,
    lower(strip_accents(name)) AS model FROM pois""",
)
register(
    "profile_rule_elements",
    lambda spark, sf: (lambda counts: T.expand_rules(T.profile_rules(spark)).join(counts, ["category", "subcategory"]).select("profile", "lens", "element", "category", "subcategory", "n"))(
        C.pois(spark, sf).groupBy("category", "subcategory").agg(F.count("*").alias("n"))),
)
register(
    "available_pairs",
    lambda spark, sf: T.available_pairs(C.pois(spark, sf)),
    with_tables(C.POIS) + "SELECT DISTINCT category, subcategory FROM pois WHERE category NOT IN ('edificio', 'alojamiento', 'transporte', 'industria')",
)

# --- population ------------------------------------------------------------------------------------------------------
register("population_years", lambda spark, sf: P.years_by_zone(C.population(spark, sf)),
         with_tables(C.POPULATION) + "SELECT zone, count(*) AS observations, count(DISTINCT year) AS years, min(year) AS first_year, max(year) AS last_year FROM population GROUP BY 1")
register("population_common_years", lambda spark, sf: P.common_years(C.population(spark, sf), C.zones(spark, sf)),
         with_tables(C.POPULATION) + "SELECT year FROM population GROUP BY 1 HAVING count(DISTINCT zone) = (SELECT count(*) FROM nation)")
register("population_national_range", lambda spark, sf: P.national_range(C.national_series(spark, sf)),
         with_tables(C.POPULATION) + "SELECT min(year) AS first_year, max(year) AS last_year, count(DISTINCT year) AS years, min(population) AS min_population, max(population) AS max_population FROM national")
LATEST_POP = """latest AS (SELECT * FROM population QUALIFY row_number() OVER (PARTITION BY zone ORDER BY year DESC, date DESC, source DESC) = 1)"""
register("population_latest", lambda spark, sf: P.latest_observation(C.population(spark, sf)), with_tables(C.POPULATION, LATEST_POP) + "SELECT * FROM latest")
register(
    "population_reconciled",
    lambda spark, sf: P.reconcile(C.population(spark, sf), C.national_series(spark, sf), 2000),
    with_tables(C.POPULATION, LATEST_POP) + """SELECT l.zone, CASE WHEN l.year >= 2000 THEN l.population ELSE round_even(l.population * (t.population / n.population), 0)::BIGINT END AS population,
    '2000' AS observation_date, l.source, l.year AS basis_year, l.population AS basis_population, CASE WHEN l.year >= 2000 THEN 'observed' ELSE 'national_growth_adjustment' END AS method
    FROM latest l JOIN national n ON n.year = l.year JOIN national t ON t.year = 2000""",
)


def observations(spark, sf):
    p = C.population(spark, sf)
    rows = p.select(F.concat(F.lit("dc/"), "zone").alias("entity"), "date", F.col("population").cast("double").alias("value"), F.col("source").alias("importName"), F.lit(None).cast("string").alias("facetId"), F.col("population").alias("row_no"))
    return rows.unionByName(rows.withColumns({"row_no": F.col("row_no") + 10**9, "value": F.col("value") + 1}))


register("population_observations", lambda spark, sf: L.population_history(observations(spark, sf), C.zones(spark, sf).select(F.concat(F.lit("dc/"), "zone").alias("entity"), "zone")),
         with_tables(C.POPULATION) + "SELECT zone, date, year, population, source FROM population")
