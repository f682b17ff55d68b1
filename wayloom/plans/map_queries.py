"""Queries over place matching, boundaries, streets and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from wayloom.operators import boundaries as B
from wayloom.operators import geo as G
from wayloom.operators import matching as H
from wayloom.operators import medallion as M
from wayloom.plans import common as C
from wayloom.plans.common import MEASUREMENTS, measurements, r6, shown, table, with_tables
from wayloom.plans.measurement_queries import GOLD, KPI_NUMBERS, r_sql
from wayloom.plans.place_queries import hav
from wayloom.schemas import ROUTE
from wayloom.streaming import jobs as J

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, build: Callable, oracle: str | None = None) -> None:
    QUERIES[name] = build
    if oracle is not None:
        ORACLE[name] = oracle


# --- matching --------------------------------------------------------------------------------------------------------
def sides(spark, sf):
    left = C.second_source(spark, sf).select(F.col("place_id").alias("id"), "name", "category", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    right = C.pois(spark, sf).select(F.col("osm_id").alias("id"), "name", "category", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return left, right


register("place_match_candidates", lambda spark, sf: H.candidate_pairs(*sides(spark, sf)).withColumns({"sim": shown(F.col("sim")), "dist_m": shown(F.col("dist_m"), 3)}))
register("equal_name_candidates", lambda spark, sf: H.candidate_pairs(*sides(spark, sf)).filter("sim = 1").select("left_id", "right_id", shown(F.col("dist_m"), 3).alias("dist_m"), "level"),
         with_tables(C.POIS, C.SECOND) + f"""SELECT place_id AS left_id, osm_id AS right_id, {r6(hav('s.latitude', 's.longitude', 'p.latitude', 'p.longitude'), 3)} AS dist_m, 'fuerte' AS level FROM second s, pois p
         WHERE s.name = p.name AND abs(s.latitude - p.latitude) < 0.001e0 AND {hav('s.latitude', 's.longitude', 'p.latitude', 'p.longitude')} <= 100""")
register("greedy_place_matching", lambda spark, sf: H.greedy_matching(H.candidate_pairs(*sides(spark, sf))).select("left_id", "right_id", "level"))


def log_lines(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("line_no"), F.concat(F.lit("INFO ["), F.lit("NATION_"), F.col("user_id") % 20, F.lit("] Foursquare devolvió "), F.get_json_object("props", "$.k"), F.lit(" resultados crudos, con 3 nombres")).alias("value"))


LOG = "log AS (SELECT 'NATION_' || (user_id % 20) AS point_key, arg_max(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT), event_id) AS results FROM events GROUP BY 1)"
register("search_log", lambda spark, sf: H.search_log(log_lines(spark, sf)), with_tables(LOG) + "SELECT * FROM log")


def zone_circles(spark, sf):
    points = C.zones(spark, sf).select(F.col("zone").alias("point"), F.col("zone_lat").alias("lat"), F.col("zone_lon").alias("lon"))
    return H.circles(points, H.search_log(log_lines(spark, sf)))


register("complete_circles", lambda spark, sf: zone_circles(spark, sf).select("point", "results", "state"),
         with_tables(C.ZONES, LOG) + "SELECT zone AS point, results, CASE WHEN results IS NULL THEN 'unknown' WHEN results < 50 THEN 'complete' ELSE 'cut' END AS state FROM zones LEFT JOIN log ON zone = point_key")


def coverage(spark, sf):
    left, right = sides(spark, sf)
    strong = H.candidate_pairs(left, right).filter("sim = 1").groupBy("left_id").agg(F.min("right_id").alias("right_id")).withColumn("level", F.lit("fuerte"))
    report = H.coverage_report(left.drop("name"), right.drop("name"), strong.groupBy("right_id").agg(F.min("left_id").alias("left_id")).withColumn("level", F.lit("fuerte")), zone_circles(spark, sf).filter("state = 'complete'"))
    return report.withColumns({"strong": shown(F.col("strong")), "any": shown(F.col("any"))})


register("coverage_report", coverage,
         with_tables(C.POIS, C.SECOND, C.ZONES, LOG) + f""", m AS (SELECT right_id, min(left_id) AS left_id FROM (SELECT place_id AS left_id, min(osm_id) AS right_id FROM second s, pois p WHERE s.name = p.name AND abs(s.latitude - p.latitude) < 0.001e0
           AND {hav('s.latitude', 's.longitude', 'p.latitude', 'p.longitude')} <= 100 GROUP BY 1) GROUP BY 1),
         k AS (SELECT zone_lat, zone_lon FROM zones JOIN log ON zone = point_key WHERE results < 50),
         l AS (SELECT place_id AS id, category, EXISTS (SELECT 1 FROM k WHERE {hav('zone_lat', 'zone_lon', 'latitude', 'longitude')} <= 1500) AS inside, place_id IN (SELECT left_id FROM m) AS hit FROM second),
         r AS (SELECT osm_id AS id, category, EXISTS (SELECT 1 FROM k WHERE {hav('zone_lat', 'zone_lon', 'latitude', 'longitude')} <= 1500) AS inside, osm_id IN (SELECT right_id FROM m) AS hit FROM pois),
         a AS (SELECT 'left_complete' AS block, * FROM l WHERE inside UNION ALL SELECT 'left_all', * FROM l UNION ALL SELECT 'right_complete', * FROM r WHERE inside)
         SELECT block, category, count(*) AS n, {r6("avg(hit::INT)")} AS strong, {r6("avg(hit::INT)")} AS "any" FROM a GROUP BY 1, 2""")


# --- boundaries and streets ------------------------------------------------------------------------------------------
def relations(spark, sf):
    """A square with a square hole around each zone, its sides cut into unordered pieces of either direction."""
    def corner(dy, dx):
        return F.struct((F.col("zone_lat") + dy).alias("lat"), (F.col("zone_lon") + dx).alias("lon"))

    def way(role, *points):
        return F.struct(F.lit("way").alias("type"), F.lit(role).alias("role"), F.array(*points).alias("geometry"))

    a, b = 0.006, 0.002
    members = F.array(
        way("outer", corner(a, -a), corner(a, a), corner(-a, a)),
        way("inner", corner(b, b), corner(b, -b), corner(-b, -b)),
        way("outer", corner(a, -a), corner(-a, -a), corner(-a, a)),
        way("inner", corner(-b, -b), corner(-b, b), corner(b, b)),
    )
    tags = F.map_from_arrays(F.array(F.lit("admin_level"), F.lit("name"), F.lit("name:en")), F.array(F.lit("8"), F.col("zone"), F.concat(F.lit("Town "), "zone_order")))
    return C.zones(spark, sf).select(F.lit("relation").alias("type"), F.col("zone_order").cast("long").alias("id"), tags.alias("tags"), members.alias("members"))


def points(spark, sf):
    return C.pois(spark, sf).select("osm_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))


register("boundary_rings", lambda spark, sf: B.localities(relations(spark, sf)).select("id", "name", F.size("outer").alias("outer"), F.size("inner").alias("inner"), F.size(F.get("outer", F.lit(0))).alias("corners"), "dropped"),
         with_tables(C.ZONES) + "SELECT zone_order::BIGINT AS id, 'Town ' || zone_order AS name, 1 AS outer, 1 AS inner, 5 AS corners, 0 AS dropped FROM zones")
INSIDE = "abs(p.latitude - zone_lat) < 0.006e0 AND abs(p.longitude - zone_lon) < 0.006e0 AND NOT (abs(p.latitude - zone_lat) < 0.002e0 AND abs(p.longitude - zone_lon) < 0.002e0)"
register("containing_localities", lambda spark, sf: points(spark, sf).join(B.containing_localities(points(spark, sf).select("lat", "lon").distinct(), B.boundary_edges(B.localities(relations(spark, sf)))), ["lat", "lon"]).select("osm_id", "id"),
         with_tables(C.POIS, C.ZONES) + f"SELECT osm_id, zone_order::BIGINT AS id FROM pois p, zones WHERE {INSIDE}")
register("locality_by_point", lambda spark, sf: B.assign_localities(points(spark, sf), B.localities(relations(spark, sf))).filter("criterio <> 'cercana'").select("osm_id", "localidad", "criterio").groupBy("localidad", "criterio").agg(F.count("*").alias("n")).filter("criterio = 'dentro'"),
         with_tables(C.POIS, C.ZONES) + f"SELECT 'Town ' || z AS localidad, 'dentro' AS criterio, count(*) AS n FROM (SELECT osm_id, min(zone_order) AS z FROM pois p, zones WHERE {INSIDE} GROUP BY 1) GROUP BY 1")
FREE = f"free AS (SELECT osm_id, latitude, longitude, cos(radians(avg(latitude) OVER ())) * 111320 AS kx FROM pois p WHERE NOT EXISTS (SELECT 1 FROM zones WHERE {INSIDE}))"


def side(half: str) -> str:
    """Metres from a point to the nearest side of the square of this half width around a zone."""
    x, y = f"(abs(longitude - zone_lon) - {half}) * kx", f"(abs(latitude - zone_lat) - {half}) * 111320e0"
    return f"CASE WHEN {x} <= 0 AND {y} <= 0 THEN -greatest({x}, {y}) ELSE sqrt(pow(greatest({x}, 0e0), 2) + pow(greatest({y}, 0e0), 2)) END"


register("localities_by_criterion", lambda spark, sf: B.assign_localities(points(spark, sf), B.localities(relations(spark, sf))).groupBy("localidad", "criterio").agg(F.count("*").alias("n")),
         with_tables(C.POIS, C.ZONES, FREE) + f""", dist AS (SELECT osm_id, zone_order, least({side("0.006e0")}, {side("0.002e0")}) AS m FROM free, zones),
         near AS (SELECT osm_id, arg_min(zone_order, m) AS z FROM dist WHERE m <= {B.TOLERANCE_M!r} GROUP BY 1),
         found AS (SELECT osm_id, min(zone_order) AS z, 'dentro' AS criterio FROM pois p, zones WHERE {INSIDE} GROUP BY 1 UNION ALL SELECT osm_id, z, 'cercana' FROM near)
         SELECT coalesce('Town ' || z, '') AS localidad, coalesce(criterio, '') AS criterio, count(*) AS n FROM pois LEFT JOIN found USING (osm_id) GROUP BY 1, 2""")
register("nearby_localities", lambda spark, sf: B.assign_localities(points(spark, sf), B.localities(relations(spark, sf))).groupBy("criterio").agg(F.count("*").alias("n")))


def streets(spark, sf):
    """A street of two sides through each place of the second source."""
    s = C.second_source(spark, sf)
    def at(dy, dx):
        return F.struct((F.col("latitude") + dy).alias("lat"), (F.col("longitude") + dx).alias("lon"))
    tags = F.map_from_arrays(F.array(F.lit("highway"), F.lit("name")), F.array(F.lit("residential"), F.concat(F.lit("Triq "), "place_id")))
    return s.select(F.lit("way").alias("type"), F.col("place_id").alias("id"), tags.alias("tags"), F.array(at(-0.002, 0.0), at(0.0, 0.0), at(0.0, 0.003)).alias("geometry"))




def seg(y1, x1, y2, x2):
    import math

    kl = repr(111320.0 * math.cos(math.radians((G.SOUTH + G.NORTH) / 2)))
    t = f"greatest(0e0, least(1e0, ((p.longitude - {x1}) * {kl} * ({x2} - {x1}) * {kl} + (p.latitude - {y1}) * 111320e0 * ({y2} - {y1}) * 111320e0) / (pow(({x2} - {x1}) * {kl}, 2) + pow(({y2} - {y1}) * 111320e0, 2))))"
    return f"sqrt(pow((p.longitude - {x1}) * {kl} - {t} * ({x2} - {x1}) * {kl}, 2) + pow((p.latitude - {y1}) * 111320e0 - {t} * ({y2} - {y1}) * 111320e0, 2))"


D1 = seg("(s.latitude - 0.002e0)", "s.longitude", "s.latitude", "s.longitude")
D2 = seg("s.latitude", "s.longitude", "s.latitude", "(s.longitude + 0.003e0)")
register("nearest_street", lambda spark, sf: B.nearest_street(points(spark, sf), streets(spark, sf)).select("osm_id", "calle", shown(F.col("calle_m"), 3).alias("calle_m")),
         with_tables(C.POIS, C.SECOND) + f""", d AS (SELECT osm_id, place_id, least({D1}, {D2}) AS m FROM pois p, second s WHERE abs(p.latitude - s.latitude) < 0.006e0),
         n AS (SELECT * FROM d WHERE m <= 150 QUALIFY row_number() OVER (PARTITION BY osm_id ORDER BY m, place_id) = 1)
         SELECT p.osm_id, coalesce('Triq ' || place_id, '') AS calle, {r6("m", 3)} AS calle_m FROM pois p LEFT JOIN n USING (osm_id)""")
register("cell_places", lambda spark, sf: B.cell_places(G.cells(spark), B.localities(relations(spark, sf)), streets(spark, sf)))


# --- streams ---------------------------------------------------------------------------------------------------------
def stream(spark, sf):
    """The event table read as a stream, shaped like measurements."""
    raw = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    traffic = F.col("event_id") % 3 == 0
    travel = F.when(F.col("event_id") % 50 != 7, F.col("value"))
    return raw.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("timestamp"), F.concat(F.lit("Z"), F.col("user_id") % 7).alias("origin"), F.col("event_type").alias("destination"),
        F.when(traffic, "traffic").otherwise("base").alias("data_source"), travel.alias("travel_time_min"), F.when(traffic, F.col("value") * 0.8).alias("no_traffic_time_min"),
        F.when(traffic, travel - F.col("value") * 0.8).alias("traffic_delay_min"), (F.col("user_id") % 10 + 5).cast("double").alias("distance_km"),
    )


NTZ = "timestamp_ntz"
register("stream_hourly_rollup",
         lambda spark, sf: (lambda r: r.select(F.col("hour").cast(NTZ).alias("hour"), *ROUTE, "num_trips", *[shown(F.col(c)).alias(c) for c in ("avg_duration_min", "avg_distance_km", "pct_alta_demora")]))(J.run_available(J.hourly_rollup(stream(spark, sf)), spark)),
         with_tables(MEASUREMENTS) + f"""SELECT date_trunc('hour', timestamp)::TIMESTAMP AS hour, origin, destination, count(*) AS num_trips, {r6("avg(travel_time_min)")} AS avg_duration_min, {r6("avg(distance_km)")} AS avg_distance_km,
         {r6("100 * avg(coalesce(travel_time_min > 20, false)::INT)")} AS pct_alta_demora FROM measurements GROUP BY 1, 2, 3 HAVING hour + INTERVAL 1 HOUR <= (SELECT max(timestamp) FROM measurements) - INTERVAL 3 HOUR""")
register("stream_sliding_statistics",
         lambda spark, sf: (lambda r: r.select(F.col("until").cast(NTZ).alias("until"), *ROUTE, "n", shown(F.col("avg_travel_time")).alias("avg_travel_time")))(J.run_available(J.sliding_statistics(stream(spark, sf), slide="5 minutes"), spark)),
         with_tables(MEASUREMENTS) + f""", s AS (SELECT *, unnest(range(0, 12))::INT AS k, time_bucket(INTERVAL 5 MINUTE, timestamp) AS b FROM measurements)
         SELECT b + INTERVAL 5 MINUTE * (k + 1) AS until, origin, destination, count(*) AS n, {r6("avg(travel_time_min)")} AS avg_travel_time FROM s GROUP BY 1, 2, 3 HAVING until <= (SELECT max(timestamp) FROM measurements) - INTERVAL 3 HOUR""")
register("stream_sessions",
         lambda spark, sf: (lambda r: r.select("data_source", F.col("first_seen").cast(NTZ).alias("first_seen"), F.col("last_seen").cast(NTZ).alias("last_seen"), "n"))(J.run_available(J.sessions(stream(spark, sf), "15 minutes"), spark)),
         with_tables(MEASUREMENTS) + """, g AS (SELECT *, CASE WHEN epoch_us(timestamp - lag(timestamp) OVER w) >= 15 * 60e6 THEN 1 ELSE 0 END AS s FROM measurements WINDOW w AS (PARTITION BY data_source ORDER BY timestamp, id)),
         b AS (SELECT *, sum(s) OVER (PARTITION BY data_source ORDER BY timestamp, id) AS block FROM g)
         SELECT data_source, min(timestamp) AS first_seen, max(timestamp) AS last_seen, count(*) AS n FROM b GROUP BY data_source, block HAVING max(timestamp) + INTERVAL 15 MINUTE <= (SELECT max(timestamp) FROM measurements) - INTERVAL 3 HOUR""")
register("stream_once_per_key",
         lambda spark, sf: J.run_available(J.once_per_key(J.both_sources(stream(spark, sf), stream(spark, sf))), spark).groupBy("data_source").agg(F.count("*").alias("n")),
         with_tables(MEASUREMENTS) + "SELECT data_source, count(DISTINCT (timestamp, origin, destination)) AS n FROM measurements GROUP BY 1")


def stream_state(spark, sf):
    state = J.with_staleness(J.run_complete(J.latest_state(stream(spark, sf)), spark), "2024-01-30 23:00:00")
    return state.select(*ROUTE, F.col("latest.id").alias("latest_id"), F.col("traffic.id").alias("traffic_id"), "stale")


register("stream_latest_state", stream_state,
         with_tables(MEASUREMENTS) + """SELECT origin, destination, arg_max(id, timestamp) AS latest_id, arg_max(id, timestamp) FILTER (traffic_delay_min IS NOT NULL) AS traffic_id,
         max(timestamp) FILTER (traffic_delay_min IS NOT NULL) < TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 90 MINUTE AS stale FROM measurements GROUP BY 1, 2""")


def stream_live(spark, sf):
    live = J.run_update(J.live_state(stream(spark, sf), 480), spark, ROUTE)
    at = [F.timestamp_micros(F.col(f"{c}_us")).cast(NTZ).alias(f"{c}_at") for c in ("latest", "traffic")]
    return live.select(*ROUTE, *at, "latest_id", "traffic_id", shown(F.col("traffic_delay_min")).alias("traffic_delay_min"), "stale")


register("stream_route_staleness", stream_live,
         with_tables(MEASUREMENTS) + f""", l AS (SELECT *, row_number() OVER (PARTITION BY origin, destination ORDER BY timestamp DESC, id DESC) AS i FROM measurements),
         t AS (SELECT *, row_number() OVER (PARTITION BY origin, destination ORDER BY timestamp DESC, id DESC) AS i FROM measurements WHERE traffic_delay_min IS NOT NULL),
         now AS (SELECT epoch_ms(max(timestamp)) - 600000 AS ms FROM measurements)
         SELECT l.origin, l.destination, l.timestamp AS latest_at, t.timestamp AS traffic_at, l.id AS latest_id, t.id AS traffic_id, {r6("t.traffic_delay_min")} AS traffic_delay_min,
         t.id IS NULL OR epoch_ms(t.timestamp) + 28800000 < (SELECT ms FROM now) AS stale FROM l LEFT JOIN t ON t.origin = l.origin AND t.destination = l.destination AND t.i = 1 WHERE l.i = 1""")


def stream_gold(spark, sf):
    folder = J.scratch(spark)
    shaped = stream(spark, sf).withColumn("timestamp", F.col("timestamp").cast(NTZ))
    J.medallion_stream(shaped, folder, f"{folder}/state", "2024-02-01 00:00:00").awaitTermination()
    k = spark.read.parquet(f"{folder}/gold_route_kpis")
    return k.select("date", *ROUTE, "sample_count", "peak_hour", *[shown(F.col(c)).alias(c) for c in KPI_NUMBERS])


register("stream_medallion_kpis", stream_gold, GOLD + f"SELECT date, origin, destination, sample_count, peak_hour, {r_sql(*KPI_NUMBERS)} FROM kpis")


def batch_gold(spark, sf):
    folder = J.scratch(spark)
    for _ in range(2):
        M.run_medallion(measurements(spark, sf), folder, ["id"], "2024-02-01 00:00:00")
    return spark.read.parquet(f"{folder}/gold_route_rankings").select("date", "rank", *ROUTE)


register("medallion_run", batch_gold, GOLD + "SELECT date, (row_number() OVER (PARTITION BY date ORDER BY reliability_score DESC, origin, destination))::INT AS rank, origin, destination FROM kpis")
