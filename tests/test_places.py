"""Grid, distances, lenses, scores, matching, boundaries and closure labels on small fixtures, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayloom.functions import taxonomy as T
from wayloom.functions import text as X
from wayloom.operators import boundaries as B
from wayloom.operators import closures as K
from wayloom.operators import geo as G
from wayloom.operators import lenses as N
from wayloom.operators import matching as H
from wayloom.operators import scoring as Z
from wayloom.operators import upserts as U

PER_LAT = 111_194.92664455874


def hav(a, b, c, d):
    p = math.pi / 180
    h = math.sin((c - a) * p / 2) ** 2 + math.cos(a * p) * math.cos(c * p) * math.sin((d - b) * p / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


def cloud(n, seed=1, clump=0.0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        if r.random() < clump:
            lat, lon = 35.9, 14.5
        else:
            lat, lon = 35.89 + r.random() * 0.02, 14.49 + r.random() * 0.02
        out.append((i, r.choice("ab"), lat, lon))
    return out


@pytest.mark.parametrize("clump", [0.0, 0.4])
def test_neighbour_counts_against_brute_force(spark, clump):
    pts = cloud(150, clump=clump)
    df = spark.createDataFrame(pts, "id int, category string, lat double, lon double")
    got = {r["id"]: (r["n_total"], r["n_same"]) for r in G.neighbour_counts(df, 250.0).collect()}
    for i, c, la, lo in pts:
        near = [q for q in pts if q[0] != i and hav(la, lo, q[2], q[3]) <= 250]
        assert got[i] == (len(near), sum(q[1] == c for q in near))


def test_nearest_same_category_against_brute_force(spark):
    pts = cloud(60, 3, 0.1) + [(1000, "z", 35.9, 14.5)]
    df = spark.createDataFrame(pts, "id int, category string, lat double, lon double")
    got = {r["id"]: r["dist_m"] for r in G.nearest_same_category(df, 1000.0).collect()}
    for i, c, la, lo in pts:
        best = min([hav(la, lo, q[2], q[3]) for q in pts if q[0] != i and q[1] == c] + [1000.0])
        assert got[i] == pytest.approx(best, abs=1e-6)


def test_radius_is_inclusive_and_keys_must_match(spark):
    step = 60 / PER_LAT
    left = spark.createDataFrame([(1, "x", 35.9, 14.5), (2, "y", 35.9, 14.5)], "id int, name string, lat double, lon double")
    right = spark.createDataFrame([("x", 35.9 + step * 0.9999999, 14.5), ("y", 35.9 + step * 1.001, 14.5)], "name string, lat double, lon double")
    assert [r["id"] for r in G.same_key_within(left, right, "name", 60.0).collect()] == [1]


def test_ring_sums_against_brute_force(spark):
    r = random.Random(2)
    cells = {(r.randrange(G.GRID.rows), r.randrange(G.GRID.cols)): r.randrange(1, 9) for _ in range(40)}
    cells[(0, 0)] = 5
    cells[(G.GRID.rows - 1, G.GRID.cols - 1)] = 7
    df = spark.createDataFrame([(a, b, n) for (a, b), n in cells.items()], "fila int, col int, n int")
    got = {(x["fila"], x["col"]): x["v"] for x in G.scatter(df, [], "n", G.RING_WEIGHTS).collect()}
    for a in range(G.GRID.rows):
        for b in range(G.GRID.cols):
            want = sum(n * G.RING_WEIGHTS[max(abs(a - i), abs(b - j))] for (i, j), n in cells.items() if max(abs(a - i), abs(b - j)) <= 2)
            assert got.get((a, b), 0.0) == pytest.approx(want)


def test_wide_and_long_counts_are_inverse(spark):
    long = spark.createDataFrame([(1, 2, "a", "x|y", 3), (4, 5, "b", "", 1)], "fila int, col int, category string, subcategory string, n long")
    back = G.long_counts(G.wide_counts(long, ["a|x|y", "b|"]))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, long.collect()))


def counts_at(spark, *rows):
    return spark.createDataFrame(list(rows), "fila int, col int, category string, subcategory string, n long")


def test_competitors_are_not_suppliers_and_unknown_is_not_zero(spark):
    c = counts_at(spark, (10, 10, "food_drink", "bar", 2), (10, 11, "business", "butcher", 1), (10, 10, "business", "company", 3))
    rows = {r["profile"]: r for r in N.compute_lenses(c, T.profile_rules(spark)).filter("fila = 10 AND col = 10").collect()}
    food = rows["food_drink"]
    assert food["competencia_directa"] == 2.0
    assert food["mercado_vida_nocturna"] is None and food["mercado_residentes"] is None
    assert food["mercado_oficinistas"] == 3.0 and food["mercado_total"] == 1.0
    assert food["proveedores_carnicerias"] == 0.5
    assert food["proveedores_diversidad"] == pytest.approx(1 / 7)
    assert rows["leisure"]["mercado_vida_nocturna"] is None  # bars compete with leisure
    assert rows["hospital"]["proveedores_total"] is None and not rows["hospital"]["datos_proveedores"]


def test_percentile_rank_ties(spark):
    df = spark.createDataFrame([("p", v) for v in (1.0, 2.0, 2.0, None, 5.0)], "profile string, v double")
    got = sorted((r["v"], r["pct"]) for r in df.withColumn("pct", N.percentile_rank("v", ["profile"])).collect() if r["v"] is not None)
    assert got == [(1.0, 0.25), (2.0, 0.625), (2.0, 0.625), (5.0, 1.0)]


def test_scores(spark):
    f = spark.createDataFrame(
        [("c", "a", 100.0, 5.0, None), ("c", "b", 50.0, 5.0, 10.0), ("c", "d", None, 5.0, 20.0)],
        "category string, zone string, demanda double, competencia double, tiempo_viaje_prom double",
    )
    got = {r["zone"]: r for r in Z.score_zones(f).collect()}
    w = {"d": 0.30 / 0.75, "c": 0.25 / 0.75, "a": 0.20 / 0.75}
    assert got["a"]["score"] == pytest.approx(w["d"] + 0.5 * w["c"] + 0.5 * w["a"])
    assert got["b"]["score"] == pytest.approx(0.5 * w["c"] + w["a"])
    assert got["d"]["demanda_norm"] is None and got["d"]["dimensiones_con_dato"] == 2
    with pytest.raises(ValueError):
        Z.score_zones(f, {"demanda": 0.5})
    only = Z.score_zones(f.drop("tiempo_viaje_prom"), {"demanda": 0.5, "accesibilidad": 0.5}).first()
    assert only["criterios_puntuados"] == 1


def test_greedy_matching_equals_a_plain_loop(spark):
    r = random.Random(5)
    edges = list({(r.randrange(25), r.randrange(25)): (r.randrange(5, 11) / 10, r.randrange(100) * 1.0) for _ in range(200)}.items())
    rows = [(i, j, s, d, "fuerte") for (i, j), (s, d) in edges]
    got = {(x["left_id"], x["right_id"]) for x in H.greedy_matching(spark.createDataFrame(rows, "left_id int, right_id int, sim double, dist_m double, level string")).collect()}
    used_l, used_r, want = set(), set(), set()
    for i, j, s, d, _ in sorted(rows, key=lambda e: (-e[2], e[3], e[0], e[1])):
        if i not in used_l and j not in used_r:
            used_l.add(i)
            used_r.add(j)
            want.add((i, j))
    assert got == want


def test_name_similarity(spark):
    df = spark.createDataFrame([("Café Central", "CENTRAL cafe"), ("Vella & Sons", "Vella and Sons Ltd"), ("x (sin nombre)", "x"), ("Ana", "Ana")], "a string, b string")
    n = df.select(X.match_name(F.col("a")).alias("a"), X.match_name(F.col("b")).alias("b"))
    got = [r[0] for r in n.select(X.name_similarity(F.col("a"), F.col("b"), H.STOP_WORDS)).collect()]
    assert got[0] >= 0.9 and got[1] >= 0.9 and got[2] == 0.0 and got[3] == 1.0


def test_hole_belongs_to_the_ring_around_it(spark):
    def ring(y0, x0, y1, x1):
        return [(y0, x0), (y0, x1), (y1, x1), (y1, x0), (y0, x0)]

    rows = [(1, "A", [ring(0.0, 0.0, 10.0, 10.0), ring(20.0, 0.0, 30.0, 10.0)], [ring(4.0, 4.0, 6.0, 6.0)], 0), (2, "B", [ring(0.0, 8.0, 10.0, 18.0)], [], 0)]
    places = spark.createDataFrame(rows, "id long, name string, outer array<array<struct<lat:double,lon:double>>>, inner array<array<struct<lat:double,lon:double>>>, dropped int")
    pts = spark.createDataFrame([(5.0, 5.0), (2.0, 2.0), (25.0, 5.0), (5.0, 9.0), (50.0, 5.0)], "lat double, lon double")
    # a coarse grid keeps this fixture of whole degrees small
    old, B.TILE_DEG = B.TILE_DEG, 5.0
    try:
        got = sorted((r["lat"], r["lon"], r["id"]) for r in B.containing_localities(pts, B.boundary_edges(places)).collect())
    finally:
        B.TILE_DEG = old
    assert got == [(2.0, 2.0, 1), (5.0, 9.0, 1), (5.0, 9.0, 2), (25.0, 5.0, 1)]


def test_open_boundaries_are_counted():
    assert B._close([[(0, 0), (0, 1)], [(1, 1), (0, 1)], [(1, 1), (0, 0)]])[1] == 0
    rings, open_chains = B._close([[(0, 0), (0, 1)], [(5, 5), (6, 6)]])
    assert (rings, open_chains) == ([], 2)


def element(i, tags, dlat=0.0, lat=35.890, lon=14.510):
    return ("node", i, lat + dlat / PER_LAT, lon, tags)


def test_closure_levels(spark):
    schema = "type string, id long, latitude double, longitude double, tags map<string,string>"
    cafe = {"amenity": "cafe"}
    past = spark.createDataFrame([element(i, {**cafe, "name": f"Bar {i}"}, i * 200) for i in range(1, 9)], schema)
    now = spark.createDataFrame(
        [
            element(1, {**cafe, "name": "BAR 1"}, 200),
            element(2, {"shop": "vacant", "name": "Bar 2"}, 400),
            element(3, {**cafe, "name": "Other"}, 600),
            element(50, {**cafe, "name": "Bar 4"}, 4 * 200 + 59),
            element(51, {**cafe, "name": "Bar 5"}, 5 * 200 + 61),
            element(7, {**cafe, "disused:shop": "yes", "name": "Bar 7"}, 1400),
        ],
        schema,
    )
    cycle = spark.createDataFrame([element(6, {"disused:amenity": "cafe"}, 1200)], schema)
    got = {r["id"]: r["level"] for r in K.label(past, now, cycle).collect()}
    assert got == {1: "superviviente", 2: "fuerte", 3: "dudoso", 4: "dudoso", 5: "probable", 6: "fuerte", 7: "dudoso", 8: "probable"}


def test_keyword_positions(spark):
    rules = {"hospital": ["farmacia"], "food_drink": ["restaurante"], "business": ["oficina"]}
    texts = ["una oficina de farmacias", "un restaurante con fábrica y farmacia", "una fábrica de restaurantes", "un criadero de peces", "nada"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("n", X.business_text(F.col("t")))
    got = [(r["category"], r["activity"], r["source"]) for r in X.interpret(df, "n", rules).orderBy("i").collect()]
    assert got == [
        ("hospital", None, "palabras_clave"), ("hospital", None, "palabras_clave"), (None, "manufactura", "fuera_de_alcance"),
        (None, "pesca", "fuera_de_alcance"), (None, None, None),
    ]


def test_ngrams_of_short_words(spark):
    got = spark.createDataFrame([("ab  c",)], "t string").select(X.word_ngrams(F.col("t"), 2, 5)).first()[0]
    assert got == [" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c "]


def test_wishes(spark):
    rules, known = T.profile_rules(spark), T.element_rules(spark)
    wishes = spark.createDataFrame(
        [("food_drink", "directa", None, None, None, None), ("food_drink", "mercado", "turistas", None, None, None), ("food_drink", "mercado", "nadie", None, None, None),
         ("food_drink", "indirecta", None, None, None, None), ("business", "directa", None, "business", ["deli"], None)], T.WISH_SCHEMA)
    custom = T.custom_profiles(rules, wishes, known)

    def part(df, profile, lens, element=None):
        rows = df.filter((F.col("profile") == profile) & (F.col("lens") == lens)).collect()
        return sorted((r["element"], r["category"]) for r in rows if element is None or r["element"] == element)

    assert part(custom, "food_drink", "competencia") == part(rules, "food_drink", "competencia", "directa")
    assert {e for e, _ in part(custom, "food_drink", "mercado")} == {"turistas"}
    assert part(custom, "food_drink", "proveedores") == part(rules, "food_drink", "proveedores")
    got = {(r["profile"], r["warning"], r["part"], r["element"]) for r in T.wish_warnings(rules, wishes, known).collect()}
    assert got == {("food_drink", "unknown element", "mercado", "nadie"), ("food_drink", "default kept", "directa", None), ("food_drink", "competition mostly removed", None, None)}
    assert {r["profile"] for r in T.changed_profiles(rules, custom).filter("custom").collect()} == {"food_drink", "business"}
    shares = {r["profile"]: r["deviation"] for r in T.deviation(custom, rules).collect()}
    assert shares["food_drink"] == 0.75 and shares["business"] == 0.25 and shares["school"] == 0


def test_equal_maps_in_another_order(spark):
    df = spark.createDataFrame([("n", 1, {"a": "1", "b": "2"}), ("n", 1, {"b": "2", "a": "1"})], "type string, id long, tags map<string,string>")
    assert U.unique_elements(df, ["tags"]).count() == 1


def test_model_text_decomposes_every_letter(spark):
    got = spark.createDataFrame([("Ċirku Ġnien Żejtun Ñu Ħal Ệ й",)], "t string").select(X.model_text(F.col("t"))).first()[0]
    assert got == "cirku gnien zejtun nu ħal e и"


def test_second_source_buckets(spark):
    df = spark.createDataFrame([("Barbershop",), ("Coffee Shop",), ("Food and Beverage Retail",), ("Department Store",), ("Church",), ("Café",)], "n string")
    assert [r[0] for r in df.select(T.second_source_bucket(F.col("n"))).collect()] == ["services", "restaurant", "retail", "mall", "other", "restaurant"]


@pytest.fixture
def stored_cloud(spark, tmp_path):
    """A small file, read with the planner's usual limit for broadcasts."""
    spark.createDataFrame(cloud(60, 3, 0.1), "id int, category string, lat double, lon double").write.parquet(f"{tmp_path}/cloud")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    yield spark.read.parquet(f"{tmp_path}/cloud")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_distance_work_collects_no_side_on_the_driver(stored_cloud):
    """Small files under an `explode` made the planner broadcast rows by the million."""
    df = stored_cloud
    centers, spots = df.select(F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon")), df.select(F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    same = df.withColumn("name", F.col("category"))
    for out in (
        G.neighbour_counts(df, 250.0), G.nearest_same_category(df, 1000.0), G.within_distance(centers, spots, 100.0),
        G.in_any_circle(spots, centers, 100.0), G.same_key_within(same, same, "name", 60.0),
    ):
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_tiles_are_paired_in_blocks(spark):
    """A tile is sent to the blocks it reaches, not to each of the hundreds of tiles around it."""
    df = spark.createDataFrame([(i, "a", 35.9 + i / 1000, 14.5) for i in range(20)], "id int, category string, lat double, lon double")
    tiles = df.select(*[c.alias(n) for c, n in zip(G.tile_of(F.col("lat"), F.col("lon"), 31.25), ("ti", "tj"))])
    pairs = G.tile_pairs(tiles, tiles, 250.0, 31.25)
    assert {"bi", "bj"} <= set(pairs.columns)
    got = {(r["a_ti"], r["ti"]) for r in pairs.collect()}
    step = 31.25 / PER_LAT
    rows = [r["ti"] for r in tiles.collect()]
    assert got >= {(a, b) for a in rows for b in rows if hav((a + 0.5) * step, 14.5, (b + 0.5) * step, 14.5) <= 250}


def test_nearest_same_category_from_dense_to_lonely_places(spark):
    r = random.Random(5)
    pts = [(i, "a", 35.9 + r.random() * 1e-4, 14.5 + r.random() * 1e-4) for i in range(40)] + [(100 + i, "a", 35.85 + r.random() * 0.08, 14.45 + r.random() * 0.12) for i in range(40)]
    df = spark.createDataFrame(pts, "id int, category string, lat double, lon double")
    got = {x["id"]: x["dist_m"] for x in G.nearest_same_category(df, 1000.0).collect()}
    for i, _, la, lo in pts:
        assert got[i] == pytest.approx(min([hav(la, lo, q[2], q[3]) for q in pts if q[0] != i] + [1000.0]), abs=1e-6)


def test_closure_features_collect_no_side_on_the_driver(stored_cloud):
    tags = F.create_map(F.lit("amenity"), F.lit("bar"), F.lit("name"), F.concat(F.lit("Bar "), "category"))
    elements = stored_cloud.select(F.lit("node").alias("type"), F.col("id").cast("long").alias("id"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), tags.alias("tags"))
    labels = K.label(elements, elements.filter("id % 3 > 0"), elements.limit(0))
    for out in (labels, K.modelling_frame(labels, elements)):
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    rows = K.modelling_frame(labels, elements).collect()
    assert rows and all(r["n_total_500"] >= r["n_total_250"] >= r["n_same_250"] for r in rows)


def test_nearest_street_is_exchanged_and_right(stored_cloud):
    """Streets by the million are no file of few bytes to be broadcast, and tiles are no wider than the reach."""
    points = stored_cloud.select("id", "lat", "lon")
    corner = F.struct("lat", "lon")
    end = F.struct((F.col("lat") + 0.002).alias("lat"), (F.col("lon") + 0.001).alias("lon"))
    name = F.create_map(F.lit("highway"), F.lit("residential"), F.lit("name"), F.concat(F.lit("Triq "), F.col("id").cast("string")))
    ways = stored_cloud.filter("id % 9 = 0").select(F.lit("way").alias("type"), "id", name.alias("tags"), F.array(corner, end).alias("geometry"))
    out = B.nearest_street(points, ways)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    kx = G.M_PER_DEG_LAT * math.cos(math.radians((G.SOUTH + G.NORTH) / 2))
    sides = [(w["id"], w["geometry"][0], w["geometry"][1]) for w in ways.collect()]

    def gap(la, lo, a, b):
        px, py, dx, dy = (lo - a["lon"]) * kx, (la - a["lat"]) * G.M_PER_DEG_LAT, (b["lon"] - a["lon"]) * kx, (b["lat"] - a["lat"]) * G.M_PER_DEG_LAT
        t = max(0.0, min(1.0, (px * dx + py * dy) / (dx * dx + dy * dy)))
        return math.hypot(px - t * dx, py - t * dy)

    rows = out.collect()
    assert len(rows) == points.count() and any(r["calle"] for r in rows)
    for r in rows:
        best = min((gap(r["lat"], r["lon"], a, b), i) for i, a, b in sides)
        assert (r["calle"] == "") if best[0] > B.STREET_M else r["calle_m"] == pytest.approx(best[0], abs=1e-6)


def test_pairs_of_points_and_streets_are_not_sorted_for_the_nearest(stored_cloud):
    """The least distance is kept by position: an aggregate by sorting would write all pairs to disk. Equally near streets: the lowest id."""
    points = stored_cloud.select("id", "lat", "lon")
    end = F.struct((F.col("lat") + 0.002).alias("lat"), (F.col("lon") + 0.001).alias("lon"))
    name = F.create_map(F.lit("name"), F.concat(F.lit("Triq "), F.col("way").cast("string")))
    twice = stored_cloud.filter("id % 9 = 0").withColumn("way", F.explode(F.array(F.col("id") + 100_000, F.col("id"))))
    ways = twice.select(F.lit("way").alias("type"), F.col("way").alias("id"), name.alias("tags"), F.array(F.struct("lat", "lon"), end).alias("geometry"))
    out = B.nearest_street(points, ways)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "SortAggregate" in line and "dist_m" in line]
    rows = out.collect()
    assert len(rows) == points.count() and any(r["calle"] for r in rows)
    assert all(not r["calle"] or int(r["calle"].split()[1]) < 100_000 for r in rows)
