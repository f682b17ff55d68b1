"""Queries over grid cells, distance joins, lenses, the panorama and zone scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from wayloom.functions import taxonomy as T
from wayloom.operators import geo as G
from wayloom.operators import lenses as N
from wayloom.operators import scoring as Z
from wayloom.plans import common as C
from wayloom.plans.common import MEASUREMENTS, measurements, r6, shown, table, with_tables
from wayloom.plans.table_queries import GOODS, _first
from wayloom.functions import text as X
from wayloom.schemas import ROUTE

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, build: Callable, oracle: str | None = None) -> None:
    QUERIES[name] = build
    if oracle is not None:
        ORACLE[name] = oracle


def d(x: float) -> str:
    return f"{x!r}e0" if "e" not in repr(x) else repr(x)


GR = G.GRID
HAV = """2 * 6371000e0 * asin(sqrt(least(1e0, pow(sin(({b} - {a}) * {rad} / 2), 2) + cos({a} * {rad}) * cos({b} * {rad}) * pow(sin(({y} - {x}) * {rad} / 2), 2))))"""


def hav(a: str, x: str, b: str, y: str) -> str:
    return HAV.format(a=a, x=x, b=b, y=y, rad=d(0.017453292519943295))


CELL_OF = f"floor((latitude - {d(GR.south)}) / {d(GR.dlat)})::INT AS fila, floor((longitude - {d(GR.west)}) / {d(GR.dlon)})::INT AS col"
COUNTS = f"""counts AS (SELECT fila, col, category, subcategory, count(*) AS n FROM (SELECT {CELL_OF}, category, subcategory FROM pois)
  WHERE fila BETWEEN 0 AND {GR.rows - 1} AND col BETWEEN 0 AND {GR.cols - 1} GROUP BY ALL)"""
CELLS = f"""cells AS (SELECT (i // {GR.cols})::INT AS fila, (i % {GR.cols})::INT AS col, (i // {GR.cols} + 0.5e0) * {d(GR.dlat)} + {d(GR.south)} AS lat,
  (i % {GR.cols} + 0.5e0) * {d(GR.dlon)} + {d(GR.west)} AS lon FROM range({GR.rows * GR.cols}) t(i))"""
OFFSETS = """offs AS (SELECT a.i AS dr, b.i AS dc, greatest(abs(a.i), abs(b.i)) AS ring FROM range(-2, 3) a(i), range(-2, 3) b(i))"""
BUSINESS = "category NOT IN ('edificio', 'alojamiento', 'transporte', 'industria')"
ACTIVE = f"""active AS (SELECT fila + dr AS fila, col + dc AS col, sum(n)::DOUBLE AS pois_vecindad FROM counts, offs WHERE ring <= 1 AND {BUSINESS}
  AND fila + dr BETWEEN 0 AND {GR.rows - 1} AND col + dc BETWEEN 0 AND {GR.cols - 1} GROUP BY 1, 2)"""
BASE = with_tables(C.POIS, COUNTS, CELLS, OFFSETS, ACTIVE)


def ring_sql(where: str, weight: str) -> str:
    return f"""SELECT fila + dr AS fila, col + dc AS col, sum(n * {weight})::DOUBLE AS v FROM counts, offs WHERE {where}
    AND fila + dr BETWEEN 0 AND {GR.rows - 1} AND col + dc BETWEEN 0 AND {GR.cols - 1} GROUP BY 1, 2"""


WEIGHT = "CASE ring WHEN 0 THEN 1.0e0 WHEN 1 THEN 0.5e0 ELSE 0.25e0 END"


def counts(spark, sf):
    return G.cell_counts(C.pois(spark, sf))


register("cell_counts", counts, BASE + "SELECT * FROM counts")
register("cell_outside_audit", lambda spark, sf: G.outside_count(C.pois(spark, sf).withColumn("longitude", F.col("longitude") + 0.01)),
         with_tables(C.POIS) + f"""SELECT count(*) AS total, count(*) FILTER (floor((longitude + 0.01e0 - {d(GR.west)}) / {d(GR.dlon)}) NOT BETWEEN 0 AND {GR.cols - 1}
         OR floor((latitude - {d(GR.south)}) / {d(GR.dlat)}) NOT BETWEEN 0 AND {GR.rows - 1}) AS outside FROM pois""")
register("cell_totals", lambda spark, sf: G.cells(spark).join(counts(spark, sf).groupBy("fila", "col").agg(F.sum("n").alias("n")), ["fila", "col"], "left")
         .select("cell_id", shown(F.col("lat"), 9).alias("lat"), shown(F.col("lon"), 9).alias("lon"), F.coalesce("n", F.lit(0)).alias("n")),
         BASE + f"""SELECT 'r' || lpad(c.fila::VARCHAR, 2, '0') || 'c' || lpad(c.col::VARCHAR, 2, '0') AS cell_id, {r6("lat", 9)} AS lat, {r6("lon", 9)} AS lon, coalesce(sum(n), 0)::BIGINT AS n
         FROM cells c LEFT JOIN counts k USING (fila, col) GROUP BY ALL""")
for ring in (0, 1, 2):
    register(f"ring_sum_{ring}", lambda spark, sf, ring=ring: G.scatter(counts(spark, sf).filter(F.col("category") == "food_drink"), [], "n", G.ring_weights(ring)),
             BASE + ring_sql(f"category = 'food_drink' AND ring = {ring}", "1"))
register("neighborhood_sum", lambda spark, sf: G.scatter(counts(spark, sf), ["category"], "n", G.RING_WEIGHTS),
         BASE + f"""SELECT category, fila + dr AS fila, col + dc AS col, sum(n * {WEIGHT})::DOUBLE AS v FROM counts, offs
         WHERE fila + dr BETWEEN 0 AND {GR.rows - 1} AND col + dc BETWEEN 0 AND {GR.cols - 1} GROUP BY 1, 2, 3""")
register("active_cells", lambda spark, sf: G.active_cells(counts(spark, sf)), BASE + "SELECT * FROM active")
PAIRS = ["food_drink|bar", "food_drink|cafe", "business|bakery", "school|school"]
register("wide_cell_counts", lambda spark, sf: G.wide_counts(counts(spark, sf), PAIRS).toDF("fila", "col", *[p.replace("|", "_") for p in PAIRS]),
         BASE + "SELECT fila, col, " + ", ".join(f"coalesce(sum(n) FILTER (category || '|' || subcategory = '{p}'), 0)::BIGINT AS {p.replace('|', '_')}" for p in PAIRS) + " FROM counts GROUP BY 1, 2")
register("long_cell_counts", lambda spark, sf: G.long_counts(G.wide_counts(counts(spark, sf), PAIRS)),
         BASE + f"SELECT fila, col, category, subcategory, n FROM counts WHERE category || '|' || subcategory IN ({', '.join(repr(p) for p in PAIRS)})")


def all_pairs(spark, sf):
    """Every category|subcategory of the table."""
    pairs = counts(spark, sf).select(F.concat_ws("|", "category", "subcategory").alias("p")).distinct().collect()
    return sorted(r["p"] for r in pairs)


register("wide_cell_counts_all_pairs", lambda spark, sf: G.wide_counts(counts(spark, sf), all_pairs(spark, sf)),
         BASE + "PIVOT (SELECT fila, col, category || '|' || subcategory AS pair, n FROM counts) ON pair USING coalesce(sum(n), 0)::BIGINT GROUP BY fila, col")
register("long_cell_counts_all_pairs", lambda spark, sf: G.long_counts(G.wide_counts(counts(spark, sf), all_pairs(spark, sf))), BASE + "SELECT fila, col, category, subcategory, n FROM counts")
for ring in (0, 1, 2):
    register(f"ring_sum_{ring}_by_category", lambda spark, sf, ring=ring: G.scatter(counts(spark, sf), ["category"], "n", G.ring_weights(ring)),
             BASE + f"""SELECT category, fila + dr AS fila, col + dc AS col, sum(n)::DOUBLE AS v FROM counts, offs
             WHERE ring = {ring} AND fila + dr BETWEEN 0 AND {GR.rows - 1} AND col + dc BETWEEN 0 AND {GR.cols - 1} GROUP BY 1, 2, 3""")
ZC = f"zc AS (SELECT zone, zone_order, fila, col, lat, lon, {hav('zone_lat', 'zone_lon', 'lat', 'lon')} AS dist FROM zones, cells)"
NEAREST = "nearest AS (SELECT fila, col, zone AS zona_cercana, dist AS dist_zona_m FROM zc QUALIFY row_number() OVER (PARTITION BY fila, col ORDER BY dist, zone_order) = 1)"
register("nearest_zone", lambda spark, sf: G.nearest_zone(C.zones(spark, sf)).withColumn("dist_zona_m", shown(F.col("dist_zona_m"), 3)),
         with_tables(C.ZONES, CELLS, ZC, NEAREST) + f"SELECT fila, col, zona_cercana, {r6('dist_zona_m', 3)} AS dist_zona_m FROM nearest")
register("zone_cells", lambda spark, sf: G.zone_cells(C.zones(spark, sf)).withColumn("dist_m", shown(F.col("dist_m"), 3)),
         with_tables(C.ZONES, CELLS, ZC) + f"SELECT zone, fila, col, {r6('dist', 3)} AS dist_m FROM zc WHERE dist <= 1500")
register("kernel_smoothing",
         lambda spark, sf: G.kernel_smoothing(C.zones(spark, sf).join(table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("zone_order")).agg(F.avg("s_acctbal").alias("wealth")), "zone_order", "left"), ["wealth"]).withColumn("wealth", shown(F.col("wealth"), 3)),
         with_tables(C.ZONES, CELLS, ZC, "w AS (SELECT s_nationkey AS zone_order, avg(s_acctbal) AS wealth FROM supplier GROUP BY 1)",
                     f"k AS (SELECT *, exp(-(dist * dist) / {d(2 * 1500.0 * 1500.0)}) AS g FROM zc JOIN w USING (zone_order))")
         + f"SELECT fila, col, {r6('sum(g * wealth) / sum(g)', 3)} AS wealth FROM k GROUP BY 1, 2")
register("industrial_cells",
         lambda spark, sf: N.attach_industrial(G.active_cells(counts(spark, sf)).withColumn("profile", F.lit("x")), counts(spark, sf)).select("fila", "col", "naves_vecindad", shown(F.col("pct_naves_vecindad")).alias("pct_naves_vecindad")),
         BASE + f""", s AS ({ring_sql("category = 'edificio' AND subcategory IN ('warehouse', 'industrial') AND ring <= 1", "1")}),
         a AS (SELECT fila, col, coalesce(v, 0) AS v FROM active LEFT JOIN s USING (fila, col))
         SELECT fila, col, v AS naves_vecindad, {r6("(rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0e0) / count(*) OVER ()")} AS pct_naves_vecindad FROM a""")

# --- distance joins --------------------------------------------------------------------------------------------------
ZONE_POIS = f"zp AS (SELECT zone, category, count(*) AS n FROM zones, pois WHERE {hav('zone_lat', 'zone_lon', 'latitude', 'longitude')} <= 1500 GROUP BY 1, 2)"
register("zone_category_counts", lambda spark, sf: G.zone_category_counts(C.pois(spark, sf), C.zones(spark, sf)), with_tables(C.POIS, C.ZONES, ZONE_POIS) + "SELECT * FROM zp")


def universe(spark, sf):
    return C.pois(spark, sf).filter(F.col("category") != "edificio").select(F.col("osm_id").alias("id"), "category", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))


UNIVERSE = "u AS (SELECT osm_id AS id, category, latitude AS lat, longitude AS lon FROM pois WHERE category <> 'edificio')"
for radius in (250, 500):
    register(f"neighbour_counts_{radius}", lambda spark, sf, radius=radius: G.neighbour_counts(universe(spark, sf), float(radius)),
             with_tables(C.POIS, UNIVERSE) + f"""SELECT a.id, count(*) - 1 AS n_total, count(*) FILTER (a.category = b.category) - 1 AS n_same FROM u a, u b
             WHERE abs(a.lat - b.lat) < 0.006e0 AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= {radius} GROUP BY 1""")
register("nearest_same_category", lambda spark, sf: G.nearest_same_category(universe(spark, sf), 1000.0).withColumn("dist_m", shown(F.col("dist_m"), 3)),
         with_tables(C.POIS, UNIVERSE) + f"""SELECT a.id, {r6("least(1000e0, coalesce(min(" + hav('a.lat', 'a.lon', 'b.lat', 'b.lon') + "), 1000e0))", 3)} AS dist_m FROM u a
         LEFT JOIN u b ON a.category = b.category AND a.id <> b.id AND abs(a.lat - b.lat) < 0.0095e0 GROUP BY 1""")


def named(spark, sf):
    return C.pois(spark, sf).select("osm_id", "name", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))


register("same_name_within_150m",
         lambda spark, sf: G.same_key_within(named(spark, sf), C.second_source(spark, sf).select("name", F.col("latitude").alias("lat"), F.col("longitude").alias("lon")), "name", 150.0).select("osm_id", "name"),
         with_tables(C.POIS, C.SECOND) + f"SELECT osm_id, name FROM pois p WHERE EXISTS (SELECT 1 FROM second s WHERE s.name = p.name AND {hav('p.latitude', 'p.longitude', 's.latitude', 's.longitude')} <= 150)")
register("inside_any_circle",
         lambda spark, sf: G.in_any_circle(C.pois(spark, sf).select(F.col("osm_id").alias("p_id"), F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lon")),
                                           C.zones(spark, sf).select(F.col("zone_lat").alias("c_lat"), F.col("zone_lon").alias("c_lon")), 900.0).select(F.col("p_id").alias("osm_id")),
         with_tables(C.POIS, C.ZONES) + f"SELECT osm_id FROM pois WHERE EXISTS (SELECT 1 FROM zones WHERE {hav('zone_lat', 'zone_lon', 'latitude', 'longitude')} <= 900)")


def zone_routes(spark, sf):
    z = C.zones(spark, sf)
    return z.select(F.col("zone").alias("origin"), F.concat(F.lit("NATION_"), (F.col("zone_order") * 7 + 3) % 25).alias("destination"), F.col("zone_order").alias("route_order"))


register("search_points",
         lambda spark, sf: (lambda p: p.select("point", shown(F.col("lat"), 8).alias("lat"), shown(F.col("lon"), 8).alias("lon")))(G.search_points(C.zones(spark, sf), zone_routes(spark, sf))),
         with_tables(C.ZONES, "r AS (SELECT zone AS origin, 'NATION_' || ((zone_order * 7 + 3) % 25) AS destination, zone_order AS o FROM zones)",
                     "k AS (SELECT * FROM r WHERE origin <> destination QUALIFY row_number() OVER (PARTITION BY least(origin, destination), greatest(origin, destination) ORDER BY o) = 1)",
                     "e AS (SELECT k.*, a.zone_lat AS alat, a.zone_lon AS alon, b.zone_lat AS blat, b.zone_lon AS blon FROM k JOIN zones a ON a.zone = origin JOIN zones b ON b.zone = destination)",
                     "n AS (SELECT *, greatest(0, ceil(sqrt(pow(alat - blat, 2) + pow(alon - blon, 2)) * 111 / 1.5e0) - 1)::INT AS n FROM e)")
         + f"""SELECT zone AS point, {r6("zone_lat", 8)} AS lat, {r6("zone_lon", 8)} AS lon FROM zones UNION ALL
         SELECT origin || '↔' || destination || ' km' || i, {r6("alat + (blat - alat) * (i::DOUBLE / (n + 1))", 8)}, {r6("alon + (blon - alon) * (i::DOUBLE / (n + 1))", 8)} FROM n, range(1, 100) t(i) WHERE i <= n""")

# --- lenses ----------------------------------------------------------------------------------------------------------
def _sql_list(values) -> str:
    return "NULL" if not values else "[" + ", ".join(f"'{v}'" for v in values) + "]"


def rules_sql() -> str:
    rows = []
    for profile, parts in T.PROFILES.items():
        for side in ("directa", "indirecta"):
            rows += [(profile, "competencia", side, *s) for s in parts[side]]
        for lens, source in (("mercado", T.SEGMENTS), ("proveedores", T.SUPPLIERS)):
            for element in parts[lens]:
                rows += [(profile, lens, element, *s) for s in (source[element] or ((None, None, ()),))]
    values = ", ".join(
        f"('{p}', '{lens}', '{e}', {'NULL' if c is None else repr(c)}, {_sql_list(s)}::VARCHAR[], {_sql_list(x)}::VARCHAR[])" for p, lens, e, c, s, x in rows
    )
    return f"rules(profile, lens, element, category, subs, without) AS (VALUES {values})"


MEMBERS = """hits AS (SELECT DISTINCT profile, lens, element, p.category, p.subcategory, p.total FROM rules r
  JOIN (SELECT category, subcategory, sum(n) AS total FROM counts GROUP BY 1, 2) p ON r.category = p.category
  WHERE (subs IS NULL OR list_contains(subs, subcategory)) AND (without IS NULL OR NOT list_contains(without, subcategory))),
members AS (SELECT * FROM hits h WHERE lens = 'competencia' OR NOT EXISTS (SELECT 1 FROM hits k WHERE k.lens = 'competencia' AND k.profile = h.profile
  AND k.category = h.category AND k.subcategory = h.subcategory))"""
VALUES = f"""vals AS (SELECT profile, lens, element, fila + dr AS fila, col + dc AS col, sum(n * {WEIGHT})::DOUBLE AS v
  FROM members JOIN counts USING (category, subcategory), offs
  WHERE fila + dr BETWEEN 0 AND {GR.rows - 1} AND col + dc BETWEEN 0 AND {GR.cols - 1} GROUP BY 1, 2, 3, 4, 5),
support AS (SELECT profile, lens, fila + dr AS fila, col + dc AS col, sum(n)::DOUBLE AS s FROM (SELECT DISTINCT profile, lens, category, subcategory FROM members)
  JOIN counts USING (category, subcategory), offs WHERE ring <= 1 AND fila + dr BETWEEN 0 AND {GR.rows - 1} AND col + dc BETWEEN 0 AND {GR.cols - 1} GROUP BY 1, 2, 3, 4),
tops AS (SELECT profile, element, max(v) AS top FROM vals WHERE lens = 'mercado' GROUP BY 1, 2),
has AS (SELECT DISTINCT profile, lens, element FROM members),
per_profile AS (SELECT profile, count(DISTINCT (lens, element)) FILTER (lens = 'competencia') AS n_rivals, count(DISTINCT element) FILTER (lens = 'proveedores') AS n_types,
  count(DISTINCT element) FILTER (lens = 'mercado' AND (profile, lens, element) IN (SELECT (profile, lens, element) FROM has)) AS n_market,
  count(DISTINCT element) FILTER (lens = 'proveedores' AND (profile, lens, element) IN (SELECT (profile, lens, element) FROM has)) AS n_suppliers FROM rules GROUP BY 1),
lens AS (SELECT p.profile, a.fila, a.col, a.pois_vecindad,
  coalesce((SELECT sum(v) FROM vals x WHERE x.profile = p.profile AND x.fila = a.fila AND x.col = a.col AND lens = 'competencia' AND element = 'directa'), 0) AS competencia_directa,
  coalesce((SELECT sum(v) FROM vals x WHERE x.profile = p.profile AND x.fila = a.fila AND x.col = a.col AND lens = 'competencia' AND element = 'indirecta'), 0) AS competencia_indirecta,
  CASE WHEN EXISTS (SELECT 1 FROM has h WHERE h.profile = p.profile AND h.lens = 'mercado' AND h.element = 'turistas') THEN
    coalesce((SELECT sum(v) FROM vals x WHERE x.profile = p.profile AND x.fila = a.fila AND x.col = a.col AND lens = 'mercado' AND element = 'turistas'), 0) END AS mercado_turistas,
  CASE WHEN n_market > 0 THEN coalesce((SELECT sum(v / top) FROM vals x JOIN tops t ON t.profile = x.profile AND t.element = x.element
    WHERE x.profile = p.profile AND x.fila = a.fila AND x.col = a.col AND x.lens = 'mercado'), 0) / n_market END AS mercado_total,
  CASE WHEN n_suppliers > 0 THEN coalesce((SELECT sum(v) FROM vals x WHERE x.profile = p.profile AND x.fila = a.fila AND x.col = a.col AND lens = 'proveedores'), 0) END AS proveedores_total,
  CASE WHEN n_suppliers > 0 THEN coalesce((SELECT count(*) FROM vals x WHERE x.profile = p.profile AND x.fila = a.fila AND x.col = a.col AND lens = 'proveedores' AND v > 0), 0)::DOUBLE / n_types END AS proveedores_diversidad,
  coalesce((SELECT sum(s) FROM support x WHERE x.profile = p.profile AND x.fila = a.fila AND x.col = a.col AND lens = 'mercado'), 0) AS apoyo_mercado,
  coalesce((SELECT sum(s) FROM support x WHERE x.profile = p.profile AND x.fila = a.fila AND x.col = a.col AND lens = 'proveedores'), 0) AS apoyo_proveedores,
  n_rivals > 0 AS datos_competencia, n_market > 0 AS datos_mercado, n_suppliers > 0 AS datos_proveedores FROM per_profile p, active a)"""
LENSES = with_tables(C.POIS, COUNTS, CELLS, OFFSETS, ACTIVE, rules_sql(), MEMBERS, VALUES)
LENS_SHOWN = ["competencia_directa", "competencia_indirecta", "mercado_turistas", "mercado_total", "proveedores_total", "proveedores_diversidad"]


def lenses(spark, sf):
    return N.compute_lenses(counts(spark, sf), T.profile_rules(spark))


def panorama(spark, sf):
    return N.build_panorama(counts(spark, sf), T.profile_rules(spark), C.zones(spark, sf))


register("lens_coverage", lambda spark, sf: N.lens_coverage(counts(spark, sf), T.profile_rules(spark)),
         LENSES + """SELECT r.profile, r.lens, r.element, coalesce(sum(total), 0)::BIGINT AS pois FROM (SELECT DISTINCT profile, lens, element FROM rules) r
         LEFT JOIN members m ON m.profile = r.profile AND m.lens = r.lens AND m.element = r.element GROUP BY 1, 2, 3""")
register("lenses",
         lambda spark, sf: lenses(spark, sf).select("profile", "fila", "col", "pois_vecindad", *[shown(F.col(c)).alias(c) for c in LENS_SHOWN], "apoyo_mercado", "apoyo_proveedores", "datos_competencia", "datos_mercado", "datos_proveedores"),
         LENSES + "SELECT profile, fila, col, pois_vecindad, " + ", ".join(f"{r6(c)} AS {c}" for c in LENS_SHOWN) + ", apoyo_mercado, apoyo_proveedores, datos_competencia, datos_mercado, datos_proveedores FROM lens")


def pct_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY profile ORDER BY {c} NULLS LAST) + (count({c}) OVER (PARTITION BY profile, {c}) - 1) / 2.0e0) / count({c}) OVER (PARTITION BY profile) END"


ROUNDED_LENS = f"rl AS (SELECT * REPLACE ({', '.join(f'round({c}, 9) AS {c}' for c in N.RANKED)}) FROM lens)"
PANORAMA = with_tables(
    C.POIS, COUNTS, CELLS, OFFSETS, ACTIVE, rules_sql(), MEMBERS, VALUES, C.ZONES, ZC, NEAREST, ROUNDED_LENS,
    f"""pano AS (SELECT rl.*, lat, lon, 'r' || lpad(fila::VARCHAR, 2, '0') || 'c' || lpad(col::VARCHAR, 2, '0') AS cell_id, zona_cercana, dist_zona_m,
    {", ".join(f"{pct_sql(c)} AS pct_{c}" for c in N.RANKED)},
    (CASE WHEN datos_competencia THEN least(pois_vecindad / 5, 1) ELSE 0 END + CASE WHEN datos_mercado THEN least(apoyo_mercado / 5, 1) ELSE 0 END
     + CASE WHEN datos_proveedores THEN least(apoyo_proveedores / 5, 1) ELSE 0 END) / 3 AS confianza FROM rl JOIN nearest USING (fila, col) JOIN cells USING (fila, col)),
    view AS (SELECT *, CASE WHEN confianza >= 2e0 / 3 - 1e-12 THEN 'alta' WHEN confianza >= 1e0 / 3 - 1e-12 THEN 'media' ELSE 'baja' END AS confianza_nivel FROM pano),
    starred AS (SELECT *, coalesce(pct_mercado_total >= 0.75 AND pct_competencia_directa <= 0.25 AND confianza_nivel <> 'baja', false) AS star FROM view)""",
)
PCTS = [f"pct_{c}" for c in N.RANKED]


def stable_panorama(spark, sf):
    """Lens values rounded before they are ranked, so that equal sums tie whatever their summation order."""
    rounded = lenses(spark, sf).withColumns({c: F.round(c, 9) for c in N.RANKED})
    lat, lon = G.cell_center(F.col("fila"), F.col("col"))
    placed = rounded.join(G.nearest_zone(C.zones(spark, sf)), ["fila", "col"]).withColumns({"cell_id": G.cell_id(F.col("fila"), F.col("col")), "lat": lat, "lon": lon})
    return placed.withColumns({f"pct_{c}": N.percentile_rank(c, ["profile"]) for c in N.RANKED}).withColumns(N.confidence())


register("panorama",
         lambda spark, sf: stable_panorama(spark, sf).select("profile", "cell_id", "zona_cercana", *[shown(F.col(c)).alias(c) for c in PCTS], shown(F.col("confianza")).alias("confianza"), "confianza_nivel", N.opportunity().alias("oportunidad")),
         PANORAMA + "SELECT profile, cell_id, zona_cercana, " + ", ".join(f"{r6(c)} AS {c}" for c in PCTS) + f", {r6('confianza')} AS confianza, confianza_nivel, star AS oportunidad FROM starred")


def gap_rows(spark, sf):
    c = counts(spark, sf).filter(F.col("category") == "food_drink").groupBy("fila", "col").agg(F.sum("n").alias("n"))
    return c.select(F.lit("food_drink").alias("profile"), G.cell_id(F.col("fila"), F.col("col")).alias("cell_id"), (F.col("n") * 1.5).alias("esperado"), (F.col("n") * 0.5).alias("brecha_relativa"),
                    F.lit(0.0).alias("brecha_p10"), F.lit(1.0).alias("brecha_p90"), F.lit("boosting").alias("modelo_brecha"), F.lit(True).alias("brecha_validada"))


register("panorama_with_gap",
         lambda spark, sf: N.build_panorama(counts(spark, sf), T.profile_rules(spark), C.zones(spark, sf), gap_rows(spark, sf)).select("profile", "cell_id", "esperado", "brecha_relativa", "modelo_brecha", "brecha_validada"),
         LENSES + """SELECT profile, 'r' || lpad(l.fila::VARCHAR, 2, '0') || 'c' || lpad(l.col::VARCHAR, 2, '0') AS cell_id, n * 1.5e0 AS esperado, n * 0.5e0 AS brecha_relativa,
         CASE WHEN n IS NOT NULL THEN 'boosting' ELSE '' END AS modelo_brecha, n IS NOT NULL AS brecha_validada FROM (SELECT profile, fila, col FROM per_profile, active) l
         LEFT JOIN (SELECT fila, col, sum(n) AS n FROM counts WHERE category = 'food_drink' GROUP BY 1, 2) k ON l.fila = k.fila AND l.col = k.col AND profile = 'food_drink'""")


def cell_labels(spark, sf):
    return C.second_source(spark, sf).select(*[c.alias(n) for c, n in zip(G.cell_index(F.col("latitude"), F.col("longitude")), ("fila", "col"))], "name").groupBy(
        G.cell_id(F.col("fila"), F.col("col")).alias("cell_id")).agg(F.max("name").alias("calle"), F.lit("").alias("localidad"))


register("candidate_cells",
         lambda spark, sf: N.candidates_table(N.attach_places(stable_panorama(spark, sf), cell_labels(spark, sf))).select("profile", "puesto", "cell_id", "oportunidad", "lugar", "mapa"),
         PANORAMA + f""", labels2 AS (SELECT 'r' || lpad(fila::VARCHAR, 2, '0') || 'c' || lpad(col::VARCHAR, 2, '0') AS cell_id, max(name) AS calle FROM (SELECT {CELL_OF}, name FROM second) GROUP BY 1)
         SELECT profile, (row_number() OVER (PARTITION BY profile ORDER BY star DESC, mercado_total DESC NULLS LAST, cell_id))::INT AS puesto, cell_id, star AS oportunidad,
         coalesce(calle, 'cerca de ' || zona_cercana) AS lugar, 'https://www.openstreetmap.org/?mlat=' || printf('%.5f', lat) || '&mlon=' || printf('%.5f', lon) || '#map=18/' || printf('%.5f', lat) || '/' || printf('%.5f', lon) AS mapa
         FROM starred LEFT JOIN labels2 USING (cell_id) WHERE confianza_nivel <> 'baja' QUALIFY puesto <= 15""".replace("WITH ", "WITH ", 1))
ORACLE["candidate_cells"] = ORACLE["candidate_cells"].replace("WITH pois AS", f"WITH {C.SECOND},\npois AS", 1)
SUMMARY = ["competencia_mediana", "mercado_mediana", "proveedores_mediana", "diversidad_mediana", "confianza_media"]
register("zone_summary",
         lambda spark, sf: N.zone_summary(stable_panorama(spark, sf), C.zones(spark, sf)).withColumns({c: shown(F.col(c)) for c in SUMMARY}),
         PANORAMA + f"""SELECT profile, zone, count(*) AS celdas_activas, count(*) FILTER (star) AS celdas_oportunidad, {r6("median(competencia_directa)")} AS competencia_mediana,
         {r6("median(mercado_total)")} AS mercado_mediana, {r6("median(proveedores_total)")} AS proveedores_mediana, {r6("median(proveedores_diversidad)")} AS diversidad_mediana,
         {r6("avg(confianza)")} AS confianza_media FROM starred JOIN (SELECT zone, fila, col FROM zc WHERE dist <= 1500) USING (fila, col) GROUP BY 1, 2""")
register("lens_dispersion",
         lambda spark, sf: (lambda df: df.withColumns({c: shown(F.col(c)) for c in ("ceros", "media", "desviacion", "maximo", "cv", "iqr")}))(N.describe_lens(lenses(spark, sf).withColumn("mercado_total", F.round("mercado_total", 9)), "mercado_total")),
         LENSES + f""", v AS (SELECT profile, round(mercado_total, 9) AS m FROM lens)
         SELECT profile, count(m) AS n, count(*) FILTER (m IS NULL) AS sin_datos, {r6("avg((m = 0)::INT)")} AS ceros, {r6("avg(m)")} AS media, {r6("stddev_pop(m)")} AS desviacion, {r6("max(m)")} AS maximo,
         {r6("stddev_pop(m) / nullif(avg(m), 0)")} AS cv, {r6("quantile_cont(m, 0.75) - quantile_cont(m, 0.25)")} AS iqr FROM v GROUP BY 1""")
register("lens_correlations",
         lambda spark, sf: (lambda df: N.lens_correlations(df, ["competencia_directa", "mercado_total", "proveedores_total"]).withColumn("rho", shown(F.col("rho"), 5)))(lenses(spark, sf).withColumns({c: F.round(c, 9) for c in N.RANKED})),
         LENSES + ", " + ROUNDED_LENS + " " + " UNION ALL ".join(
             f"""SELECT profile, {r6("corr(ra, rb)", 5)} AS rho, '{a}~{b}' AS pair FROM (SELECT profile, rank() OVER (PARTITION BY profile ORDER BY {a}) + (count(*) OVER (PARTITION BY profile, {a}) - 1) / 2e0 AS ra,
             rank() OVER (PARTITION BY profile ORDER BY {b}) + (count(*) OVER (PARTITION BY profile, {b}) - 1) / 2e0 AS rb FROM rl WHERE {a} IS NOT NULL AND {b} IS NOT NULL) GROUP BY 1"""
             for a, b in (("competencia_directa", "mercado_total"), ("competencia_directa", "proveedores_total"), ("mercado_total", "proveedores_total"))))
register("opportunity_share",
         lambda spark, sf: N.opportunity_share(lenses(spark, sf).withColumns({c: F.round(c, 9) for c in N.RANKED})).withColumn("share", shown(F.col("share"))),
         LENSES + ", " + ROUNDED_LENS + f""", md AS (SELECT profile, median(mercado_total) AS m, median(competencia_directa) AS r FROM rl GROUP BY 1)
         SELECT profile, {r6("avg(coalesce(mercado_total > m AND competencia_directa < r, false)::INT)")} AS share FROM rl JOIN md USING (profile) GROUP BY 1""")
register("available_layers", lambda spark, sf: N.available_layers(lenses(spark, sf), list(N.RANKED)),
         LENSES + " UNION ALL ".join(f"SELECT profile, '{c}' AS layer, count({c}) AS cells FROM lens GROUP BY 1 HAVING count({c}) > 0" for c in N.RANKED))
register("lens_export",
         lambda spark, sf: N.export_frame(stable_panorama(spark, sf), "food_drink", C.second_source(spark, sf).select(G.cell_id(*G.cell_index(F.col("latitude"), F.col("longitude"))).alias("cell_id"))).select("cell_id", shown(F.col("mercado_total")).alias("mercado_total"), "confianza_nivel"),
         PANORAMA.replace("WITH pois AS", f"WITH {C.SECOND},\npois AS", 1) + f"""SELECT cell_id, {r6("mercado_total")} AS mercado_total, confianza_nivel FROM starred WHERE profile = 'food_drink' AND (fila, col) IN (SELECT (fila, col) FROM (SELECT {CELL_OF} FROM second))""")


def nation_wishes(spark, sf):
    """Every nation as a user who competes with the food places and shops that it has itself."""
    food = C.pois(spark, sf).filter(F.col("category").isin("food_drink", "business") & (F.col("c_acctbal") > 0)).select(
        F.concat(F.lit("business:"), F.col("c_nationkey").cast("string")).alias("profile"), F.lit("directa").alias("part"), F.lit(None).cast("string").alias("element"), "category", "subcategory"
    ).distinct()
    return food.groupBy("profile", "part", "element", "category").agg(F.array_sort(F.collect_set("subcategory")).alias("subs")).withColumn("without", F.lit(None).cast("array<string>"))


def nation_rules(spark, sf):
    """The business profile with a list of named direct competitors, once for each nation."""
    base = T.profile_rules(spark, {"business": T.PROFILES["business"] | {"directa": (T.only("business", "clothes", "shoes", "deli", "butcher", "bakery"), T.only("food_drink", "bar", "cafe"))}})
    users = table(spark, sf, "nation").select(F.concat(F.lit("business:"), F.col("n_nationkey").cast("string")).alias("user"))
    return users.join(base, F.col("user").startswith(F.col("profile"))).withColumn("profile", F.col("user")).drop("user")


WISHED = """base(category, item) AS (VALUES ('business', 'clothes'), ('business', 'shoes'), ('business', 'deli'), ('business', 'butcher'), ('business', 'bakery'), ('food_drink', 'bar'), ('food_drink', 'cafe'),
  ('mall', ''), ('belleza', ''), ('taller', '')),
mine AS (SELECT DISTINCT c_nationkey AS k, category, subcategory FROM pois WHERE category IN ('food_drink', 'business') AND c_acctbal > 0),
dv AS (SELECT n_nationkey AS k, count(*) FILTER (EXISTS (SELECT 1 FROM mine WHERE mine.k = n_nationkey) AND item <> ''
  AND NOT EXISTS (SELECT 1 FROM mine WHERE mine.k = n_nationkey AND mine.category = base.category AND mine.subcategory = item)) / 10e0 AS d FROM nation, base GROUP BY 1)"""
register("profile_deviation",
         lambda spark, sf: (lambda rules, wishes, known: T.deviation(T.custom_profiles(rules, wishes, known), rules))(nation_rules(spark, sf), nation_wishes(spark, sf), T.element_rules(spark)).withColumn("deviation", shown(F.col("deviation"))),
         with_tables(C.POIS, WISHED) + f"SELECT 'business:' || k AS profile, {r6('d')} AS deviation FROM dv")
register("profile_warnings",
         lambda spark, sf: T.wish_warnings(nation_rules(spark, sf), nation_wishes(spark, sf).unionByName(nation_extras(spark, sf)), T.element_rules(spark)).withColumn("share", shown(F.col("share"))),
         with_tables(C.POIS, WISHED) + f"""SELECT 'business:' || k AS profile, 'competition mostly removed' AS warning, NULL::VARCHAR AS part, NULL::VARCHAR AS element, {r6('d')} AS share FROM dv WHERE d > 0.5e0
         UNION ALL SELECT 'business:' || n_nationkey, 'unknown element', 'mercado', lower(n_name), NULL FROM nation WHERE n_nationkey % 3 = 0
         UNION ALL SELECT 'business:' || n_nationkey, 'default kept', 'mercado', NULL, NULL FROM nation WHERE n_nationkey % 3 = 0
         UNION ALL SELECT 'business:' || n_nationkey, 'default kept', 'proveedores', NULL, NULL FROM nation WHERE n_nationkey % 4 = 0""")


def nation_extras(spark, sf):
    """Wishes for a market nobody knows, and for no suppliers at all."""
    n = table(spark, sf, "nation")
    none = [F.lit(None).cast("string").alias("category"), *[F.lit(None).cast("array<string>").alias(c) for c in ("subs", "without")]]
    user = F.concat(F.lit("business:"), F.col("n_nationkey").cast("string")).alias("profile")
    market = n.filter("n_nationkey % 3 = 0").select(user, F.lit("mercado").alias("part"), F.lower("n_name").alias("element"), *none)
    return market.unionByName(n.filter("n_nationkey % 4 = 0").select(user, F.lit("proveedores").alias("part"), F.lit(None).cast("string").alias("element"), *none))


# --- zone scores -----------------------------------------------------------------------------------------------------
CATEGORIES = [c for c in T.CATEGORY_TAGS]


def zone_scores(spark, sf):
    z = C.zones(spark, sf)
    orders = C.population(spark, sf).groupBy("zone").agg(F.sum("population").alias("population"))
    trips = measurements(spark, sf).select(
        F.concat(F.lit("NATION_"), F.substring("origin", 2, 1)).alias("origin"),
        F.concat(F.lit("NATION_"), F.length("destination") + 5).alias("destination"), "travel_time_min")
    return z, Z.zone_demand(z, orders), Z.zone_competition(C.pois(spark, sf), z, CATEGORIES), Z.zone_accessibility(z, trips)


SCORES = with_tables(
    C.POIS, C.ZONES, MEASUREMENTS, C.POPULATION, ZONE_POIS,
    "demand AS (SELECT zone, sum(population)::DOUBLE AS demanda FROM population GROUP BY 1)",
    "trips AS (SELECT 'NATION_' || substr(origin, 2, 1) AS origin, 'NATION_' || (length(destination) + 5) AS destination, avg(travel_time_min) AS t FROM measurements GROUP BY 1, 2)",
    "touch AS (SELECT DISTINCT zone, origin, destination, t FROM (SELECT origin AS zone, * FROM trips UNION ALL SELECT destination AS zone, * FROM trips))",
    "access AS (SELECT zone, avg(t) AS tiempo_viaje_prom FROM touch GROUP BY 1)",
    f"""feats AS (SELECT z.zone, c.category, CASE WHEN c.category = 'food_drink' THEN coalesce(n, 0) / 0.611e0 ELSE coalesce(n, 0)::DOUBLE END AS competencia, coalesce(n, 0) AS competencia_cruda,
      CASE WHEN c.category = 'food_drink' THEN 'corregido_por_cobertura' ELSE 'observado' END AS metodo_competencia, demanda, tiempo_viaje_prom
      FROM zones z CROSS JOIN (SELECT unnest({_sql_list(CATEGORIES)}) AS category) c LEFT JOIN zp ON zp.zone = z.zone AND zp.category = c.category LEFT JOIN demand dm ON dm.zone = z.zone LEFT JOIN access a ON a.zone = z.zone)""",
    "norms AS (SELECT *, " + ", ".join(
        f"{inv}CASE WHEN {c} IS NOT NULL THEN coalesce(({c} - min({c}) OVER w) / nullif(max({c}) OVER w - min({c}) OVER w, 0), 0.5) END AS {k}_norm"
        for k, c, inv in (("demanda", "demanda", ""), ("competencia", "competencia", "1 - "), ("accesibilidad", "tiempo_viaje_prom", "1 - "))) + " FROM feats WINDOW w AS (PARTITION BY category))",
    "scored AS (SELECT *, " + ", ".join(f"coalesce({k}_norm, 0.5) * {d(w / 0.75)} AS aporte_{k}" for k, w in (("demanda", 0.30), ("competencia", 0.25), ("accesibilidad", 0.20))) + " FROM norms)",
)
register("zone_demand", lambda spark, sf: zone_scores(spark, sf)[1], SCORES + "SELECT z.zone, demanda FROM zones z LEFT JOIN demand USING (zone)")
register("zone_competition", lambda spark, sf: zone_scores(spark, sf)[2].withColumn("competencia", shown(F.col("competencia"))),
         SCORES + f"SELECT zone, category, {r6('competencia')} AS competencia, competencia_cruda, metodo_competencia FROM feats")
register("zone_accessibility", lambda spark, sf: zone_scores(spark, sf)[3].withColumn("tiempo_viaje_prom", shown(F.col("tiempo_viaje_prom"))),
         SCORES + f"SELECT z.zone, {r6('tiempo_viaje_prom')} AS tiempo_viaje_prom FROM zones z LEFT JOIN access USING (zone)")


def scored(spark, sf):
    _, demand, competition, access = zone_scores(spark, sf)
    return Z.score_zones(Z.zone_features(demand, competition, access))


SCORE = "aporte_demanda + aporte_competencia + aporte_accesibilidad"
register("zone_score", lambda spark, sf: Z.rank_zones(scored(spark, sf).withColumn("score", shown(F.col("score")))).select("category", "zone", "score", "puesto", "dimensiones_con_dato", "criterios_puntuados"),
         SCORES + f"""SELECT category, zone, {r6(SCORE)} AS score, (row_number() OVER (PARTITION BY category ORDER BY {r6(SCORE)} DESC, zone))::INT AS puesto,
         ((demanda IS NOT NULL)::INT + (competencia IS NOT NULL)::INT + (tiempo_viaje_prom IS NOT NULL)::INT)::INT AS dimensiones_con_dato, 3 AS criterios_puntuados FROM scored""")
register("zone_score_filtered", lambda spark, sf: Z.filter_zones(scored(spark, sf), ["NATION_3", "NATION_7"]).select("category", "zone", shown(F.col("score")).alias("score")),
         SCORES + f"SELECT category, zone, {r6(SCORE)} AS score FROM scored WHERE zone IN ('NATION_3', 'NATION_7')")
register("zone_score_contributions", lambda spark, sf: Z.contributions(scored(spark, sf)).select("category", "zone", "criterio", shown(F.col("aporte")).alias("aporte"), shown(F.col("parte")).alias("parte")),
         SCORES + " UNION ALL ".join(f"SELECT category, zone, '{k}' AS criterio, {r6(f'aporte_{k}')} AS aporte, {r6(f'aporte_{k} / nullif({SCORE}, 0)')} AS parte FROM scored" for k in ("demanda", "competencia", "accesibilidad")))


def zone_score_with_lenses(spark, sf):
    z, demand, competition, access = zone_scores(spark, sf)
    medians = N.zone_summary(stable_panorama(spark, sf), z).select("zone", F.col("profile").alias("category"), "mercado_mediana", "proveedores_mediana", "diversidad_mediana")
    return Z.rank_zones(Z.score_zones(Z.zone_features(demand, competition, access, medians))).select("category", "zone", shown(F.col("score")).alias("score"), "dimensiones_con_dato", "criterios_puntuados")


register("zone_score_with_lenses", zone_score_with_lenses)


def recommended(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", X.business_text(F.col("p_name")).alias("t"))
    asked = X.interpret(p, "t", {"food_drink": GOODS["joyeria"], "business": GOODS["ferreteria"]})
    best = Z.rank_zones(scored(spark, sf).withColumn("score", shown(F.col("score")))).filter(F.col("puesto") == 1)
    return Z.recommend(asked, best).select("p_partkey", "category", "zone", "score", "motivo")


register("recommended_zones", recommended,
         SCORES + f""", best AS (SELECT category, zone, {r6(SCORE)} AS score FROM scored QUALIFY row_number() OVER (PARTITION BY category ORDER BY {r6(SCORE)} DESC, zone) = 1),
         p AS (SELECT p_partkey, lower(p_name) AS t FROM part), w AS (SELECT p_partkey, {", ".join(f"least({', '.join(_first(x + s) for x in GOODS[g] for s in ('', 's', 'es'))}) AS {g}" for g in ('joyeria', 'ferreteria'))} FROM p),
         k AS (SELECT p_partkey, CASE WHEN joyeria IS NOT NULL THEN 'food_drink' WHEN ferreteria IS NOT NULL THEN 'business' END AS category FROM w)
         SELECT p_partkey, k.category, zone, score, CASE WHEN k.category IS NULL THEN 'tipo de negocio no identificado' END AS motivo FROM k LEFT JOIN best b ON b.category = k.category""")
