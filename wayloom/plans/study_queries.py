"""Queries over adjusted associations and closure labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from wayloom.operators import causal as A
from wayloom.operators import closures as K
from wayloom.operators.geo import GRID
from wayloom.plans import common as C
from wayloom.plans.common import MEASUREMENTS, measurements, r6, shown, with_tables
from wayloom.plans.place_queries import d, hav
from wayloom.plans.table_queries import TAG_KEY
from wayloom.schemas import ROUTE

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, build: Callable, oracle: str | None = None) -> None:
    QUERIES[name] = build
    if oracle is not None:
        ORACLE[name] = oracle


def rounded(df, *columns, digits=6):
    return df.withColumns({c: shown(F.col(c), digits) for c in columns})


def treated_rows(spark, sf, treatment="above_typical"):
    return A.assign_treatment(A.analysis_rows(measurements(spark, sf), "origin_temperature"), treatment)


ROWS = """base AS (SELECT id, origin, destination, data_source, origin_temperature AS w, travel_time_min AS y, hour(timestamp) AS hour, strftime(timestamp, '%G-%V') AS week,
  CAST(timestamp AS DATE) AS day FROM measurements WHERE origin_temperature IS NOT NULL AND travel_time_min IS NOT NULL),
rows AS (SELECT *, w > median(w) OVER (PARTITION BY hour, week) AS treated FROM base)"""
register("treatment_assignment", lambda spark, sf: treated_rows(spark, sf).select("id", "treated", "week"), with_tables(MEASUREMENTS, ROWS) + "SELECT id, treated, week FROM rows")
register("treatment_above_median", lambda spark, sf: treated_rows(spark, sf, "above_median").groupBy("treated").agg(F.count("*").alias("n")),
         with_tables(MEASUREMENTS, ROWS) + "SELECT w > (SELECT median(w) FROM base) AS treated, count(*) AS n FROM base GROUP BY 1")


def att_sql(name: str, strata) -> str:
    key = ", ".join(strata)
    return f"""(WITH c AS (SELECT {key}, avg(y) AS mu FROM rows WHERE NOT treated GROUP BY ALL), d AS (SELECT r.*, y - mu AS diff FROM rows r JOIN c USING ({key}) WHERE treated),
    s AS (SELECT day, sum(diff) AS s, count(*) AS n, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS k FROM d GROUP BY 1),
    b AS (SELECT rep, CAST('0x' || substr(md5('0:' || rep || ':' || i), 1, 8) AS BIGINT) % k AS i FROM s, range(0, {A.REPLICATES}) t(rep)),
    m AS (SELECT rep, sum(s) / sum(n) AS m FROM b JOIN s USING (i) GROUP BY 1),
    q AS (SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m),
    e AS (SELECT avg(diff) AS att, count(*) AS n_used, count(DISTINCT ({key})) AS ns FROM d),
    t AS (SELECT count(*) FILTER (treated) AS nt, avg(y) FILTER (treated) - avg(y) FILTER (NOT treated) AS naive FROM rows)
    SELECT '{name}' AS specification, {r6("att")} AS att, n_used, ns AS n_strata_used, nt AS n_treated, {r6("naive")} AS naive_difference, {r6("lo")} AS ci_low, {r6("hi")} AS ci_high,
    {r6("n_used / nt")} AS share_used, lo > 0 OR hi < 0 AS ci_excludes_zero FROM e, t, q)"""


NUMBERS = ["att", "naive_difference", "ci_low", "ci_high", "share_used"]
register("stratified_att", lambda spark, sf: rounded(A.stratified_adjusted(treated_rows(spark, sf)), *NUMBERS),
         with_tables(MEASUREMENTS, ROWS) + "SELECT * FROM " + att_sql("strata", A.STRATA))
register("specification_table", lambda spark, sf: rounded(A.specification_table(treated_rows(spark, sf)), *NUMBERS),
         with_tables(MEASUREMENTS, ROWS) + " UNION ALL ".join("SELECT * FROM " + att_sql(n, s) for n, s in A.SPECIFICATIONS.items()))
register("cluster_bootstrap", lambda spark, sf: rounded(A.cluster_interval(treated_rows(spark, sf).select("data_source", "day", F.col("y").alias("diff")), ["data_source"], "day"), "ci_low", "ci_high"),
         with_tables(MEASUREMENTS, ROWS) + f""", s AS (SELECT data_source, day, sum(y) AS s, count(*) AS n, row_number() OVER (PARTITION BY data_source ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY data_source) AS k FROM rows GROUP BY 1, 2),
         b AS (SELECT data_source, rep, CAST('0x' || substr(md5('0:' || rep || ':' || i), 1, 8) AS BIGINT) % k AS i FROM s, range(0, {A.REPLICATES}) t(rep)),
         m AS (SELECT data_source, rep, sum(s) / sum(n) AS m FROM b JOIN s USING (data_source, i) GROUP BY 1, 2)
         SELECT data_source, {r6("quantile_cont(m, 0.025)")} AS ci_low, {r6("quantile_cont(m, 0.975)")} AS ci_high FROM m GROUP BY 1""")
# The names under which the full number of replicates stood first.
for _name in ("stratified_att", "specification_table", "cluster_bootstrap"):
    register(f"{_name}_all_replicates", QUERIES[_name], ORACLE[_name])


def humidity_scored(spark, sf):
    return treated_rows(spark, sf).withColumn("logit", F.round(F.col("weather") * 0.1 + F.col("hour") * 0.01, 6))


register("nearest_controls", lambda spark, sf: A.nearest_controls(humidity_scored(spark, sf), A.EXACT).select("id", shown(F.col("gap"), 5).alias("gap")),
         with_tables(MEASUREMENTS, ROWS) + f""", l AS (SELECT *, round(w * 0.1e0 + hour * 0.01e0, 6) AS logit FROM rows)
         SELECT t.id, {r6("min(abs(c.logit - t.logit))", 5)} AS gap FROM l t JOIN l c USING (origin, destination, data_source) WHERE t.treated AND NOT c.treated GROUP BY 1""")
register("matched_effect", lambda spark, sf: A.score_matching(treated_rows(spark, sf)))
register("covariate_balance", lambda spark, sf: rounded(A.matched_balance(humidity_scored(spark, sf), covariates=["hour", "data_source"]).select("covariate", "level", "before"), "before"),
         with_tables(MEASUREMENTS, ROWS) + f""", l AS (SELECT treated, unnest(['hour', 'data_source']) AS covariate, unnest([hour::VARCHAR, data_source]) AS level FROM rows),
         p AS (SELECT covariate, level, count(*) FILTER (treated) / (SELECT count(*) FROM rows WHERE treated) AS a, count(*) FILTER (NOT treated) / (SELECT count(*) FROM rows WHERE NOT treated) AS b FROM l GROUP BY 1, 2)
         SELECT covariate, level, {r6("coalesce((a - b) / nullif(sqrt((a * (1 - a) + b * (1 - b)) / 2), 0), 0)")} AS before FROM p""")
register("worst_balanced_covariates", lambda spark, sf: A.worst_balanced(A.matched_balance(humidity_scored(spark, sf))))
register("weather_split_test", lambda spark, sf: rounded(A.weather_split_test(treated_rows(spark, sf)).drop("p_value", "evidence"), "correlation", "difference", "t"),
         with_tables(MEASUREMENTS, ROWS) + f""", m AS (SELECT corr(w, y) AS c, count(*) FILTER (treated) AS n1, avg(y) FILTER (treated) AS m1, var_samp(y) FILTER (treated) AS v1,
           count(*) FILTER (NOT treated) AS n2, avg(y) FILTER (NOT treated) AS m2, var_samp(y) FILTER (NOT treated) AS v2 FROM rows)
         SELECT {r6("c")} AS correlation, {r6("m1 - m2")} AS difference, {r6("(m1 - m2) / (sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) * sqrt(1e0 / n1 + 1e0 / n2))")} AS t, n1 + n2 - 2 AS df FROM m""")
register("weather_what_if", lambda spark, sf: rounded(A.what_if(measurements(spark, sf), "origin_temperature", keys=ROUTE), "slope", "predicted", "change"),
         with_tables(MEASUREMENTS) + f""", f AS (SELECT origin, destination, regr_slope(travel_time_min, origin_temperature) AS s, regr_intercept(travel_time_min, origin_temperature) AS i, regr_avgx(travel_time_min, origin_temperature) AS x FROM measurements GROUP BY 1, 2)
         SELECT origin, destination, delta, {r6("s")} AS slope, {r6("i + s * (x + delta)")} AS predicted, {r6("s * delta")} AS change FROM f, (SELECT unnest([-5e0, -2.5e0, 0e0, 2.5e0, 5e0]) AS delta)""")
register("before_after_effect", lambda spark, sf: rounded(A.before_after(measurements(spark, sf), ROUTE).drop("p_value"), "before_mean", "after_mean", "effect", "t", "cohens_d"),
         with_tables(MEASUREMENTS) + f""", p AS (SELECT *, row_number() OVER w <= floor(count(*) OVER (PARTITION BY origin, destination) * 0.75e0) AS early FROM measurements WINDOW w AS (PARTITION BY origin, destination ORDER BY timestamp, id)),
         m AS (SELECT origin, destination, count(*) FILTER (early) AS before, count(*) FILTER (NOT early) AS after, count(travel_time_min) FILTER (NOT early) AS n1, avg(travel_time_min) FILTER (NOT early) AS m1, var_samp(travel_time_min) FILTER (NOT early) AS v1,
           count(travel_time_min) FILTER (early) AS n2, avg(travel_time_min) FILTER (early) AS m2, var_samp(travel_time_min) FILTER (early) AS v2 FROM p GROUP BY 1, 2),
         s AS (SELECT *, sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS sd FROM m WHERE before >= 10 AND after >= 10)
         SELECT origin, destination, before, after, {r6("m2")} AS before_mean, {r6("m1")} AS after_mean, {r6("m1 - m2")} AS effect, {r6("(m1 - m2) / (sd * sqrt(1e0 / n1 + 1e0 / n2))")} AS t, n1 + n2 - 2 AS df, {r6("(m1 - m2) / sd")} AS cohens_d,
         CASE WHEN m1 < m2 THEN 'improvement' ELSE 'degradation' END AS direction, CASE WHEN abs((m1 - m2) / sd) < 0.2 THEN 'negligible' WHEN abs((m1 - m2) / sd) < 0.5 THEN 'small' WHEN abs((m1 - m2) / sd) < 0.8 THEN 'medium' ELSE 'large' END AS magnitude FROM s""")
register("confounder_screen", lambda spark, sf: rounded(A.confounders(measurements(spark, sf)), "treatment", "outcome"),
         with_tables(MEASUREMENTS) + f""", h AS (SELECT corr(hour(timestamp), origin_temperature) AS t, corr(hour(timestamp), travel_time_min) AS o FROM measurements),
         d AS (SELECT stddev_samp(m) AS sd, avg(m) AS mean FROM (SELECT avg(travel_time_min) AS m FROM measurements GROUP BY isodow(timestamp)))
         SELECT 'hour' AS variable, {r6("t")} AS treatment, {r6("o")} AS outcome, abs(t) > 0.3 AND abs(o) > 0.3 AS identified, CASE WHEN abs(t) > 0.5 THEN 'high' ELSE 'moderate' END AS severity FROM h
         UNION ALL SELECT 'day_of_week', NULL, {r6("sd / mean")}, sd > mean * 0.2::DOUBLE, 'moderate' FROM d""")


# --- closure labels --------------------------------------------------------------------------------------------------
def snapshots(spark, sf):
    """Past, present and life-cycle elements of the customers; balances decide who is gone, vacant or marked."""
    p = C.pois(spark, sf)
    keys = F.create_map(*[F.lit(x) for pair in TAG_KEY.items() for x in pair])
    key = F.when(F.col("subcategory") == "nightclub", "amenity").otherwise(F.try_element_at(keys, F.col("category")))
    bal = F.col("c_acctbal")
    place = ["latitude", "longitude"]

    def tags(name, *more):
        pairs = [F.struct(key.alias("k"), F.col("subcategory").alias("v")), F.struct(F.lit("name").alias("k"), name.alias("v")), *more]
        return F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["k"].isNotNull() & e["v"].isNotNull()))

    def extra(when, k, v):
        return F.struct(F.when(when, F.lit(k)).alias("k"), F.lit(v).alias("v"))

    own = F.when(F.col("c_nationkey") != 24, F.col("name"))
    ident = [F.col("osm_type").alias("type"), F.col("osm_id").alias("id")]
    past = p.select(*ident, *place, tags(own, extra(bal > 9800, "vacant", "yes")).alias("tags"))
    renamed = F.when(F.col("c_nationkey").isin(1, 2), "Renamed").otherwise(own)
    stay = p.filter(bal >= 0).select(*ident, *place, tags(renamed, extra((bal > 9000) & (bal <= 9800), "vacant", "yes")).alias("tags"))
    moved = p.filter((bal < 0) & (F.col("c_nationkey") < 5)).select(
        F.col("osm_type").alias("type"), (F.col("osm_id") + 10000000).alias("id"), (F.col("latitude") + 0.0003).alias("latitude"), "longitude", tags(own).alias("tags"))
    cycle = p.filter(bal < -500).select(*ident, *place, F.map_from_arrays(F.array(F.concat(F.lit("disused:"), F.lit("shop"))), F.array(F.col("subcategory"))).alias("tags"))
    return past, stay.unionByName(moved), cycle


CLOSURES = f"""places AS (SELECT *, CASE WHEN category IN ('taller', 'belleza') THEN 'business' WHEN category IN ('edificio', 'alojamiento') THEN NULL ELSE category END AS cat7,
  CASE WHEN c_nationkey <> 24 THEN name END AS own FROM pois),
reasons AS (SELECT *, CASE WHEN cat7 IS NULL THEN 'sin_categoria' WHEN own IS NULL THEN 'sin_nombre' WHEN least((latitude - 35.84e0) * 111320, (35.94e0 - latitude) * 111320,
  (longitude - 14.44e0) * 111320 * cos(radians(latitude)), (14.58e0 - longitude) * 111320 * cos(radians(latitude))) <= 500 THEN 'borde_o_fuera' WHEN c_acctbal > 9800 THEN 'local_vacio' END AS reason FROM places),
cand AS (SELECT CASE WHEN c_nationkey IN (1, 2) THEN 'Renamed' ELSE own END AS cname, latitude AS clat, longitude AS clon FROM places WHERE c_acctbal >= 0 AND NOT (c_acctbal > 9000 AND c_acctbal <= 9800) AND cat7 IS NOT NULL AND (own IS NOT NULL OR c_nationkey IN (1, 2))
  UNION ALL SELECT own, latitude + 0.0003e0, longitude FROM places WHERE c_acctbal < 0 AND c_nationkey < 5 AND cat7 IS NOT NULL),
labelled AS (SELECT osm_type AS type, osm_id AS id, latitude AS lat, longitude AS lon, cat7 AS category, own AS name, c_acctbal, CASE WHEN c_acctbal > 9000 AND c_acctbal <= 9800 THEN 'fuerte' WHEN c_acctbal < -500 THEN 'fuerte' WHEN c_acctbal >= 0 AND c_nationkey IN (1, 2) THEN 'dudoso' WHEN c_acctbal >= 0 THEN 'superviviente'
  WHEN EXISTS (SELECT 1 FROM cand WHERE cname = own AND abs(clat - latitude) < 0.001e0 AND {hav('latitude', 'longitude', 'clat', 'clon')} <= 60) THEN 'dudoso' ELSE 'probable' END AS level FROM reasons WHERE reason IS NULL),
closed AS (SELECT *, CASE WHEN level IN ('fuerte', 'probable') THEN 1e0 WHEN level = 'superviviente' THEN 0e0 END AS closed, CASE WHEN level = 'fuerte' THEN 1e0 WHEN level = 'superviviente' THEN 0e0 END AS closed_strong FROM labelled)"""
CL = with_tables(C.POIS, CLOSURES)
register("study_drop_reasons", lambda spark, sf: K.with_drop_reason(snapshots(spark, sf)[0]).groupBy("reason").agg(F.count("*").alias("n")), CL + "SELECT reason, count(*) AS n FROM reasons GROUP BY 1")
register("closure_levels", lambda spark, sf: K.label(*snapshots(spark, sf)).select("type", "id", "category", "level", "closed", "closed_strong"), CL + "SELECT type, id, category, level, closed, closed_strong FROM closed")
register("closure_rates", lambda spark, sf: rounded(K.closure_rates(K.label(*snapshots(spark, sf))), "rate"), CL + f"SELECT category, count(*) AS n, {r6('avg(closed)')} AS rate FROM closed WHERE closed IS NOT NULL GROUP BY 1")
register("closure_gate", lambda spark, sf: K.gate(K.label(*snapshots(spark, sf))),
         CL + """, g AS (SELECT count(*) AS population, count(*) FILTER (level = 'fuerte') AS fuerte, count(*) FILTER (level = 'superviviente') AS superviviente, count(*) FILTER (level = 'dudoso') AS dudoso, count(*) FILTER (level = 'probable') AS probable,
         count(*) FILTER (closed = 1) AS closures, count(DISTINCT """ + f"CASE WHEN closed = 1 THEN (floor((lat - 35.84e0) / {d(GRID.dlat)})::INT // 4) * 1000 + floor((lon - 14.44e0) / {d(GRID.dlon)})::INT // 4 END" + """) AS blocks FROM closed)
         SELECT *, closures >= 60 AND blocks >= 30 AS passes FROM g""")


def circles(spark, sf):
    return C.zones(spark, sf).select(F.col("zone_lat").alias("c_lat"), F.col("zone_lon").alias("c_lon"))


register("closure_second_source", lambda spark, sf: K.second_source_sensitivity(K.label(*snapshots(spark, sf)), C.second_source(spark, sf), circles(spark, sf)).select("type", "id", "level", "closed"),
         with_tables(C.POIS, C.SECOND, C.ZONES, CLOSURES) + f""", s AS (SELECT *, level = 'probable' AND EXISTS (SELECT 1 FROM second f WHERE f.name = c.name AND {hav('c.lat', 'c.lon', 'f.latitude', 'f.longitude')} <= 150) AS alive FROM closed c
         WHERE EXISTS (SELECT 1 FROM zones WHERE {hav('zone_lat', 'zone_lon', 'c.lat', 'c.lon')} <= 1500))
         SELECT type, id, CASE WHEN alive THEN 'dudoso' ELSE level END AS level, CASE WHEN NOT alive THEN closed END AS closed FROM s""")
register("closure_features", lambda spark, sf: K.modelling_frame(K.label(*snapshots(spark, sf)), snapshots(spark, sf)[0]).select("type", "id", "y", "cat_food_drink", "n_same_250", "n_total_250", "n_same_500", "n_total_500", shown(F.col("dist_m"), 3).alias("dist_m"), "chain"),
         CL + f""", u AS (SELECT osm_id AS uid, cat7, own AS uname, latitude AS ulat, longitude AS ulon FROM places WHERE cat7 IS NOT NULL AND c_acctbal <= 9800),
         d AS (SELECT c.id, c.type, c.closed, c.category, c.name, uid, cat7, {hav('lat', 'lon', 'ulat', 'ulon')} AS m FROM closed c, u WHERE closed IS NOT NULL),
         r AS (SELECT uname, count(*) AS k FROM u WHERE uname IS NOT NULL GROUP BY 1)
         SELECT type, id, closed AS y, (category = 'food_drink')::DOUBLE AS cat_food_drink, count(*) FILTER (uid <> id AND cat7 = category AND m <= 250)::DOUBLE AS n_same_250, count(*) FILTER (uid <> id AND m <= 250)::DOUBLE AS n_total_250,
         count(*) FILTER (uid <> id AND cat7 = category AND m <= 500)::DOUBLE AS n_same_500, count(*) FILTER (uid <> id AND m <= 500)::DOUBLE AS n_total_500,
         {r6("least(1000e0, coalesce(min(m) FILTER (uid <> id AND cat7 = category), 1000e0))", 3)} AS dist_m, coalesce(any_value(k) >= 3, false)::DOUBLE AS chain
         FROM d LEFT JOIN r ON uname = name GROUP BY ALL""")
