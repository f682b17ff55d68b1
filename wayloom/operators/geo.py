"""Grid cells, ring sums and distance joins.

The grid has a fixed number of cells, so a table with one row per cell is small whatever the number of points. Distance
work between point tables goes through tiles: equal tiles are joined by key, never every point with every point.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions.scalars import haversine_m
from wayloom.functions.taxonomy import CONTEXT_CATEGORIES

# Extent and cell size of the published grid, and the weight of each ring of neighbours.
CELL_SIZE_M = 250.0
SOUTH, NORTH, WEST, EAST = 35.840, 35.940, 14.440, 14.580
M_PER_DEG_LAT = 111_320.0
RING_WEIGHTS = (1.0, 0.5, 0.25)
KERNEL_SIGMA_M = 1500.0


@dataclass(frozen=True)
class Grid:
    south: float
    west: float
    dlat: float
    dlon: float
    rows: int
    cols: int


def make_grid(south=SOUTH, north=NORTH, west=WEST, east=EAST, cell_m=CELL_SIZE_M) -> Grid:
    dlat = cell_m / M_PER_DEG_LAT
    dlon = cell_m / (M_PER_DEG_LAT * math.cos(math.radians((south + north) / 2)))
    return Grid(south, west, dlat, dlon, math.ceil((north - south) / dlat), math.ceil((east - west) / dlon))


GRID = make_grid()


# --- cells -----------------------------------------------------------------------------------------------------------
def cell_index(lat: Column, lon: Column, grid: Grid = GRID) -> tuple[Column, Column]:
    """(row, column) of a point; (-1, -1) outside the grid or without coordinates."""
    row = F.floor((lat - grid.south) / grid.dlat)
    col = F.floor((lon - grid.west) / grid.dlon)
    inside = row.between(0, grid.rows - 1) & col.between(0, grid.cols - 1)
    return F.when(inside, row).otherwise(-1).cast("int"), F.when(inside, col).otherwise(-1).cast("int")


def cell_id(row: Column, col: Column) -> Column:
    return F.format_string("r%02dc%02d", row, col)


def parse_cell_id(text: Column) -> tuple[Column, Column]:
    return tuple(F.regexp_extract(text, r"^r(\d+)c(\d+)$", i).try_cast("int") for i in (1, 2))


def cell_center(row: Column, col: Column, grid: Grid = GRID) -> tuple[Column, Column]:
    return (row + 0.5) * grid.dlat + grid.south, (col + 0.5) * grid.dlon + grid.west


def cell_bounds(row: Column, col: Column, grid: Grid = GRID) -> tuple[Column, Column, Column, Column]:
    """South, west, north and east side."""
    south, west = row * grid.dlat + grid.south, col * grid.dlon + grid.west
    return south, west, south + grid.dlat, west + grid.dlon


def cells(spark: SparkSession, grid: Grid = GRID) -> DataFrame:
    """Every cell with its id and centre."""
    ids = spark.range(grid.rows * grid.cols)
    rows = ids.select(F.floor(F.col("id") / grid.cols).cast("int").alias("fila"), (F.col("id") % grid.cols).cast("int").alias("col"))
    lat, lon = cell_center(F.col("fila"), F.col("col"), grid)
    return rows.select(cell_id(F.col("fila"), F.col("col")).alias("cell_id"), "fila", "col", lat.alias("lat"), lon.alias("lon"))


def cell_counts(pois: DataFrame, grid: Grid = GRID) -> DataFrame:
    """Points per cell, category and subcategory; points outside the grid are left out (see `outside_count`)."""
    row, col = cell_index(F.col("latitude"), F.col("longitude"), grid)
    placed = pois.filter(F.col("category").isNotNull()).select(
        row.alias("fila"), col.alias("col"), "category", F.coalesce("subcategory", F.lit("")).alias("subcategory")
    )
    return placed.filter(F.col("fila") >= 0).groupBy("fila", "col", "category", "subcategory").agg(F.count("*").alias("n"))


def outside_count(pois: DataFrame, grid: Grid = GRID) -> DataFrame:
    row, _ = cell_index(F.col("latitude"), F.col("longitude"), grid)
    return pois.filter(F.col("category").isNotNull()).agg(F.count("*").alias("total"), F.count_if(row < 0).alias("outside"))


def offsets(weights: Sequence[float]) -> Column:
    """Array of (row step, column step, weight) of the rings 0, 1, ... that carry a weight."""
    reach = len(weights) - 1
    steps = [
        F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(float(weights[max(abs(dr), abs(dc))])).alias("w"))
        for dr in range(-reach, reach + 1)
        for dc in range(-reach, reach + 1)
        if weights[max(abs(dr), abs(dc))]
    ]
    return F.array(*steps)


def scatter(df: DataFrame, keys: Sequence[str], value: str, weights: Sequence[float], grid: Grid = GRID, out: str = "v") -> DataFrame:
    """Weighted sum over the rings around every cell: each non-empty cell sends its value to the cells that see it.
    Cells outside the grid do not exist, so borders count as zero and nothing wraps."""
    sent = df.select(*keys, "fila", "col", F.col(value).alias("_v"), F.explode(offsets(weights)).alias("_o")).select(
        *keys, (F.col("fila") + F.col("_o.dr")).alias("fila"), (F.col("col") + F.col("_o.dc")).alias("col"), (F.col("_v") * F.col("_o.w")).alias("_v")
    )
    inside = F.col("fila").between(0, grid.rows - 1) & F.col("col").between(0, grid.cols - 1)
    return sent.filter(inside).groupBy(*keys, "fila", "col").agg(F.sum("_v").alias(out))


def ring_weights(ring: int) -> list[float]:
    return [0.0] * ring + [1.0]


def businesses_only(counts: DataFrame) -> DataFrame:
    return counts.filter(~F.col("category").isin(*CONTEXT_CATEGORIES))


def active_cells(counts: DataFrame, grid: Grid = GRID) -> DataFrame:
    """Cells with a business in them or in one of the eight around."""
    return scatter(businesses_only(counts), [], "n", (1.0, 1.0), grid, "pois_vecindad")


def wide_counts(counts: DataFrame, pairs: Sequence[str]) -> DataFrame:
    """One row per cell, one column per `category|subcategory` pair."""
    pair = F.concat_ws("|", "category", "subcategory")
    return counts.withColumn("_pair", pair).groupBy("fila", "col").pivot("_pair", list(pairs)).agg(F.sum("n")).na.fill(0)


def long_counts(wide: DataFrame) -> DataFrame:
    """Inverse of `wide_counts`: one row per cell and pair with a count."""
    pairs = [c for c in wide.columns if c not in ("fila", "col")]
    long = wide.unpivot(["fila", "col"], [F.col(f"`{p}`") for p in pairs], "_pair", "n").filter(F.col("n") > 0)
    parts = F.split("_pair", r"\|", 2)
    return long.select("fila", "col", parts[0].alias("category"), parts[1].alias("subcategory"), "n")


# --- zones and cells -------------------------------------------------------------------------------------------------
def zone_cell_distances(zones: DataFrame, keep: Sequence[str], grid: Grid = GRID) -> DataFrame:
    """Distance from every zone to every cell centre. Zones (zone, zone_lat, zone_lon) expand over the fixed cell list;
    whoever aggregates by cell combines before the exchange, down to one row per cell and task."""
    ids = F.explode(F.sequence(F.lit(0), F.lit(grid.rows * grid.cols - 1))).alias("_id")
    rows = zones.select(*keep, "zone_lat", "zone_lon", ids)
    rows = rows.withColumns({"fila": F.floor(F.col("_id") / grid.cols).cast("int"), "col": (F.col("_id") % grid.cols).cast("int")})
    lat, lon = cell_center(F.col("fila"), F.col("col"), grid)
    return rows.withColumn("dist_m", haversine_m(F.col("zone_lat"), F.col("zone_lon"), lat, lon)).drop("_id", "zone_lat", "zone_lon")


def nearest_zone(zones: DataFrame, grid: Grid = GRID) -> DataFrame:
    """Nearest zone of each cell; the first zone in order wins a tie."""
    far = zone_cell_distances(zones, ["zone", "zone_order"], grid)
    return far.groupBy("fila", "col").agg(
        F.min_by("zone", F.struct("dist_m", "zone_order")).alias("zona_cercana"), F.min("dist_m").alias("dist_zona_m")
    )


def zone_cells(zones: DataFrame, radius_m: float = 1500.0, grid: Grid = GRID) -> DataFrame:
    """Cells whose centre is within the radius of each zone; a cell may belong to several zones."""
    return zone_cell_distances(zones, ["zone"], grid).filter(F.col("dist_m") <= radius_m)


def kernel_smoothing(zones: DataFrame, values: Sequence[str], sigma_m: float = KERNEL_SIGMA_M, grid: Grid = GRID) -> DataFrame:
    """Gaussian-weighted mean of zone values at each cell; zones without a value are left out and the weights rescaled."""
    far = zone_cell_distances(zones, ["zone", *values], grid)
    w = F.exp(-(F.col("dist_m") * F.col("dist_m")) / (2 * sigma_m * sigma_m))
    means = []
    for v in values:
        known = F.col(v).isNotNull()
        total = F.sum(F.when(known, w))
        means.append((F.sum(F.when(known, w * F.col(v))) / F.nullif(total, F.lit(0.0))).alias(v))
    return far.groupBy("fila", "col").agg(*means)


# --- distance joins --------------------------------------------------------------------------------------------------
def tile_of(lat: Column, lon: Column, size_m: float) -> tuple[Column, Column]:
    step = size_m / M_PER_DEG_LAT
    return F.floor(lat / step), F.floor(lon / step)


def reachable_tiles(lat: Column, lon: Column, radius_m: float, size_m: float) -> Column:
    """Tiles that can hold a point within the radius: the bounding box of the circle at its own latitude."""
    step = size_m / M_PER_DEG_LAT
    dlat = F.lit(radius_m / 110_000.0)
    dlon = dlat / F.cos(F.radians(F.abs(lat) + dlat))
    rows = F.sequence(F.floor((lat - dlat) / step), F.floor((lat + dlat) / step))
    cols = F.sequence(F.floor((lon - dlon) / step), F.floor((lon + dlon) / step))
    return F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: F.struct(r.alias("ti"), c.alias("tj")))))


def sorted_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join by sorted exchange. The planner takes a side for as large as the files under it, however many rows an `explode` made
    of them since, and would collect it on the driver to broadcast it."""
    return left.join(right.hint("merge"), on, how)


def within_distance(centers: DataFrame, points: DataFrame, radius_m: float, salts: int = 8, how: str = "inner") -> DataFrame:
    """Pairs of a center (c_lat, c_lon) and a point (p_lat, p_lon) within the radius, with `dist_m`.

    Points sit in one tile each and centers visit the tiles they reach; a crowded tile is spread over `salts` parts, each
    of which every visiting center sees once."""
    ti, tj = tile_of(F.col("p_lat"), F.col("p_lon"), radius_m)
    salt = F.pmod(F.xxhash64("p_lat", "p_lon", *[c for c in points.columns if c.startswith("p_") and c not in ("p_lat", "p_lon")]), F.lit(salts))
    tiled = points.withColumns({"ti": ti, "tj": tj, "_salt": salt.cast("int")})
    visiting = (
        centers.withColumn("_t", F.explode(reachable_tiles(F.col("c_lat"), F.col("c_lon"), radius_m, radius_m)))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        .withColumns({"ti": F.col("_t.ti"), "tj": F.col("_t.tj")})
        .drop("_t")
    )
    dist = haversine_m(F.col("c_lat"), F.col("c_lon"), F.col("p_lat"), F.col("p_lon"))
    if how == "points_semi":
        return _semi(tiled, visiting, dist, radius_m).drop("ti", "tj", "_salt")
    joined = sorted_join(visiting, tiled, ["ti", "tj", "_salt"]).withColumn("dist_m", dist)
    return joined.filter(F.col("dist_m") <= radius_m).drop("ti", "tj", "_salt")


def _semi(tiled: DataFrame, visiting: DataFrame, dist: Column, radius_m: float) -> DataFrame:
    a, b = tiled.alias("p"), visiting.alias("c")
    same = (F.col("p.ti") == F.col("c.ti")) & (F.col("p.tj") == F.col("c.tj")) & (F.col("p._salt") == F.col("c._salt"))
    return sorted_join(a, b, same & (dist <= radius_m), "left_semi")


def in_any_circle(points: DataFrame, circles: DataFrame, radius_m: float) -> DataFrame:
    """Points (p_lat, p_lon) inside at least one circle (c_lat, c_lon)."""
    return within_distance(circles.select("c_lat", "c_lon").distinct(), points, radius_m, how="points_semi")


def zone_category_counts(pois: DataFrame, zones: DataFrame, radius_m: float = 1500.0) -> DataFrame:
    """POIs of each category within the radius of each zone. POIs at one position are counted before the join."""
    spots = pois.groupBy("category", F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lon")).agg(F.count("*").alias("p_n"))
    centers = zones.select("zone", F.col("zone_lat").alias("c_lat"), F.col("zone_lon").alias("c_lon"))
    pairs = within_distance(centers, spots, radius_m)
    return pairs.groupBy("zone", "category").agg(F.sum("p_n").alias("n"))


def _half_diagonal(ti: Column, size_m: float) -> Column:
    """Upper bound of the distance from a tile's centre to any point of it."""
    step = size_m / M_PER_DEG_LAT
    widest = F.cos(F.least(F.abs(ti * step), F.abs((ti + 1) * step)) * F.lit(math.pi / 180))
    return F.sqrt(widest * widest + 1) * F.lit(step / 2 * 111_320.0 * 1.001)


def tile_pairs(tiles: DataFrame, others: DataFrame, reach_m: float, size_m: float) -> DataFrame:
    """Pairs of occupied tiles that may hold points within `reach_m`, with bounds `near_m` <= distance <= `far_m`.

    `tiles` has (ti, tj); `others` has (ti, tj) and further columns. Distances obey the triangle inequality, so the
    centre distance and the two half diagonals bound every point pair. Tiles meet in blocks (bi, bj) about as wide as the reach:
    a tile of `others` goes to the few blocks that it reaches instead of every tile to hundreds of tiles."""
    step = size_m / M_PER_DEG_LAT
    wide = max(1, math.ceil(reach_m / size_m))

    def mid(ti, tj):
        return (ti + 0.5) * step, (tj + 0.5) * step

    lat, lon = mid(F.col("ti"), F.col("tj"))
    own = tiles.select(*[F.col(c).alias(f"a_{c}") for c in tiles.columns], F.floor(F.col("ti") / wide).alias("bi"), F.floor(F.col("tj") / wide).alias("bj"))
    sent = others.withColumn("_b", F.explode(reachable_tiles(lat, lon, reach_m + 3 * size_m, size_m * wide)))
    sent = sent.select(*others.columns, F.col("_b.ti").alias("bi"), F.col("_b.tj").alias("bj"))
    alat, alon = mid(F.col("a_ti"), F.col("a_tj"))
    centre = haversine_m(alat, alon, lat, lon)
    slack = _half_diagonal(F.col("a_ti"), size_m) + _half_diagonal(F.col("ti"), size_m)
    found = sorted_join(own, sent, ["bi", "bj"])
    return found.withColumns({"near_m": centre - slack, "far_m": centre + slack}).filter(F.col("near_m") <= reach_m)


def neighbour_counts(points: DataFrame, radius_m: float, tiles_per_radius: int = 8) -> DataFrame:
    """Per point (id, category, lat, lon): points within the radius, itself left out, in total and of its category.

    Tiles wholly within reach of a tile are added up as tiles, so a spot that holds very many points costs one row.
    Only points in tiles that straddle the circle are measured one by one, positions with copies once. They travel to the tile
    that asks, where its positions are met and summed up without another exchange."""
    size = radius_m / tiles_per_radius
    ti, tj = tile_of(F.col("lat"), F.col("lon"), size)
    placed = points.withColumns({"ti": ti, "tj": tj})
    spots = placed.groupBy("ti", "tj", "lat", "lon", "category").agg(F.count("*").alias("n"))
    per_tile = spots.groupBy("ti", "tj", "category").agg(F.sum("n").alias("n"))
    tiles = per_tile.groupBy("ti", "tj").agg(F.collect_list(F.struct("category", "n")).alias("_by"))
    occupied = spots.select("ti", "tj").distinct()

    whole = tile_pairs(occupied, tiles, radius_m, size).filter(F.col("far_m") <= radius_m)
    whole = whole.select("bi", "bj", "a_ti", "a_tj", F.inline("_by").alias("p_category", "n"))
    whole = whole.groupBy("bi", "bj", "a_ti", "a_tj", "p_category").agg(F.sum("n").alias("n"))
    sums = whole.groupBy("bi", "bj", "a_ti", "a_tj").agg(
        F.sum("n").alias("_total"), F.map_from_entries(F.collect_list(F.struct("p_category", "n"))).alias("_by")
    ).drop("bi", "bj")
    edge = tile_pairs(occupied, occupied, radius_m, size).filter(F.col("far_m") > radius_m).select("a_ti", "a_tj", "ti", "tj")
    probes = spots.select(F.col("ti").alias("a_ti"), F.col("tj").alias("a_tj"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon")).distinct()
    measured = (
        sorted_join(edge, spots, ["ti", "tj"])
        .select("a_ti", "a_tj", "lat", "lon", F.col("category").alias("p_category"), "n")
        .join(probes.hint("shuffle_hash"), ["a_ti", "a_tj"])
        .filter(haversine_m(F.col("a_lat"), F.col("a_lon"), F.col("lat"), F.col("lon")) <= radius_m)
        .groupBy("a_ti", "a_tj", "a_lat", "a_lon", "p_category")
        .agg(F.sum("n").alias("n"))
        .groupBy("a_ti", "a_tj", "a_lat", "a_lon")
        .agg(F.sum("n").alias("_e_total"), F.map_from_entries(F.collect_list(F.struct("p_category", "n"))).alias("_e_by"))
        .drop("a_ti", "a_tj")
    )

    def of_category(by):
        return F.coalesce(F.try_element_at(F.col(by), F.col("category")), F.lit(0))

    near = sorted_join(placed, sums, (F.col("ti") == F.col("a_ti")) & (F.col("tj") == F.col("a_tj")), "left").drop("a_ti", "a_tj")
    near = sorted_join(near, measured, (F.col("lat") == F.col("a_lat")) & (F.col("lon") == F.col("a_lon")), "left")
    return near.select(
        "id",
        (F.coalesce("_total", F.lit(0)) + F.coalesce("_e_total", F.lit(0)) - 1).alias("n_total"),
        (of_category("_by") + of_category("_e_by") - 1).alias("n_same"),
    )


def nearest_same_category(points: DataFrame, max_m: float, finest_m: float = 1.0) -> DataFrame:
    """Per point: distance to the nearest other point of its category, or `max_m` when there is none that close.

    Tiles come in sizes that halve from `max_m` to about `finest_m`. The smallest tile that a position shares with another one of
    its category bounds the distance by its diagonal, so only the few tiles of that size within the bound are measured: dense
    places look around closely, lonely ones far."""
    sizes = [max_m / 2**k for k in range(max(1, math.ceil(math.log2(max_m / finest_m)) + 1))]
    place, tile = ["category", "lat", "lon"], ["category", "size", "ti", "tj"]
    spots = points.groupBy(*place).agg(F.count("*").alias("n"))
    sized = spots.select(*place, F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size"))
    ti, tj = tile_of(F.col("lat"), F.col("lon"), F.col("size"))
    tiled = sized.withColumns({"ti": ti, "tj": tj})
    shared = tiled.groupBy(*tile).agg(F.count("*").alias("_spots")).filter("_spots > 1").select(*tile)
    smallest = sorted_join(tiled, shared, tile, "left_semi").groupBy(*place).agg(F.min(F.struct("size", "ti")).alias("_s"))
    reach = F.least(F.coalesce(2 * _half_diagonal(F.col("_s.ti"), F.col("_s.size")), F.lit(max_m)), F.lit(max_m))
    asking = sorted_join(spots.drop("n"), smallest, place, "left").select(
        "category", F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), reach.alias("_reach"), F.coalesce("_s.size", F.lit(max_m)).alias("size")
    )
    asking = asking.withColumn("_t", F.explode(reachable_tiles(F.col("a_lat"), F.col("a_lon"), F.col("_reach"), F.col("size"))))
    asking = asking.select("category", "a_lat", "a_lon", "size", F.col("_t.ti").alias("ti"), F.col("_t.tj").alias("tj"))
    measured = (
        sorted_join(asking, tiled, tile)
        .filter((F.col("a_lat") != F.col("lat")) | (F.col("a_lon") != F.col("lon")))
        .groupBy("category", "a_lat", "a_lon")
        .agg(F.min(haversine_m(F.col("a_lat"), F.col("a_lon"), F.col("lat"), F.col("lon"))).alias("_d"))
        .toDF(*place, "_d")
    )
    nearest = sorted_join(spots, measured, place, "left").select(
        *place, F.when(F.col("n") > 1, 0.0).otherwise(F.least(F.coalesce("_d", F.lit(max_m)), F.lit(max_m))).alias("dist_m")
    )
    return sorted_join(points, nearest, place).select("id", "dist_m")


def same_key_within(left: DataFrame, right: DataFrame, key: str, radius_m: float) -> DataFrame:
    """Rows of `left` (key, lat, lon) that have a row of `right` with the same key within the radius.

    Rows that share a tile no wider than the radius match without measuring; only the rest is measured, against distinct
    positions of the neighbouring tiles."""
    size = radius_m / 2
    ti, tj = tile_of(F.col("lat"), F.col("lon"), size)
    spots = right.select(key, "lat", "lon").distinct().withColumns({"ti": ti, "tj": tj})
    placed = left.withColumns({"ti": ti, "tj": tj})
    sure = spots.select(key, "ti", "tj").distinct()
    here = sorted_join(placed, sure, [key, "ti", "tj"], "left_semi")
    open_rows = sorted_join(placed, sure, [key, "ti", "tj"], "left_anti")
    around = spots.select(
        F.col(key).alias("_k"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"),
        F.explode(reachable_tiles(F.col("lat"), F.col("lon"), radius_m, size)).alias("_t"),
    )
    near = (
        (F.col(key) == F.col("_k")) & (F.col("ti") == F.col("_t.ti")) & (F.col("tj") == F.col("_t.tj"))
        & (haversine_m(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")) <= radius_m)
    )
    return here.unionByName(sorted_join(open_rows, around, near, "left_semi")).drop("ti", "tj")


def search_points(zones: DataFrame, routes: DataFrame, spacing_km: float = 1.5) -> DataFrame:
    """Zones plus points along each corridor between them; a corridor and its reverse are one."""
    z = zones.select("zone", "zone_lat", "zone_lon")
    corridors = (
        routes.filter(F.col("origin") != F.col("destination"))
        .withColumn("_pair", F.array_sort(F.array("origin", "destination")))
        .groupBy("_pair")
        .agg(F.min_by(F.struct("origin", "destination"), "route_order").alias("r"))
        .select("r.origin", "r.destination")
    )
    o = z.toDF("origin", "o_lat", "o_lon")
    d = z.toDF("destination", "d_lat", "d_lon")
    ends = corridors.join(o, "origin").join(d, "destination")
    dist_km = F.sqrt(F.pow(F.col("o_lat") - F.col("d_lat"), 2) + F.pow(F.col("o_lon") - F.col("d_lon"), 2)) * 111
    n = F.greatest(F.lit(0), F.ceil(dist_km / spacing_km) - 1).cast("int")
    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    t = F.col("i") / (F.col("n") + 1)
    between = ends.withColumns({"n": n, "i": F.explode(steps)}).select(
        F.format_string("%s↔%s km%d", "origin", "destination", "i").alias("point"),
        (F.col("o_lat") + (F.col("d_lat") - F.col("o_lat")) * t).alias("lat"),
        (F.col("o_lon") + (F.col("d_lon") - F.col("o_lon")) * t).alias("lon"),
    )
    return z.toDF("point", "lat", "lon").unionByName(between)
