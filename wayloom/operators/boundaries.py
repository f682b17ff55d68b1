"""Localities from boundary pieces, points in polygons, nearest boundary and nearest named street."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from wayloom.operators.chunks import with_one_row
from wayloom.functions.text import preferred_name, useful_street_name
from wayloom.operators.geo import M_PER_DEG_LAT, NORTH, SOUTH, sorted_join

LOCALITY_LEVEL = 8
TOLERANCE_M, STREET_M = 250.0, 150.0
TILE_DEG = 0.01
RING = ArrayType(StructType().add("lat", DoubleType()).add("lon", DoubleType()))
RINGS = StructType().add("outer", ArrayType(RING)).add("inner", ArrayType(RING)).add("dropped", IntegerType())


# --- rings -----------------------------------------------------------------------------------------------------------
def _close(pieces: list[list[tuple]]) -> tuple[list[list[tuple]], int]:
    """Rings that the pieces form end to end, and how many chains stay open."""
    ends: dict[tuple, set[int]] = {}
    for i, piece in enumerate(pieces):
        for end in (piece[0], piece[-1]):
            ends.setdefault(end, set()).add(i)
    unused, rings, open_chains = set(range(len(pieces))), [], 0
    while unused:
        i = unused.pop()
        chain = list(pieces[i])
        while chain[0] != chain[-1]:
            follow = ends[chain[-1]] & unused
            if not follow and ends[chain[0]] & unused:
                chain.reverse()
                follow = ends[chain[-1]] & unused
            if not follow:
                break
            j = min(follow)
            unused.discard(j)
            step = pieces[j] if pieces[j][0] == chain[-1] else pieces[j][::-1]
            chain.extend(step[1:])
        if len(chain) >= 4 and chain[0] == chain[-1]:
            rings.append(chain)
        else:
            open_chains += 1
    return rings, open_chains


@F.pandas_udf(RINGS)
def stitched(members: pd.Series) -> pd.DataFrame:
    """Outer and inner rings of one relation from its member ways, in whatever order and direction they come."""
    def one(rows):
        pieces, dropped = {"outer": [], "inner": []}, 0
        for m in rows if rows is not None else []:
            geometry = m["geometry"]
            if m["type"] != "way" or geometry is None or len(geometry) == 0:
                continue
            role = m["role"] or "outer"
            if role not in pieces:
                dropped += 1
            elif len(geometry) >= 2:
                pieces[role].append([(p["lat"], p["lon"]) for p in geometry])
        out = {}
        for role, parts in pieces.items():
            rings, left_over = _close(parts)
            out[role] = [[{"lat": a, "lon": b} for a, b in ring] for ring in rings]
            dropped += left_over
        return out["outer"], out["inner"], dropped

    return pd.DataFrame([one(m) for m in members], columns=["outer", "inner", "dropped"])


def localities(relations: DataFrame, level: int = LOCALITY_LEVEL) -> DataFrame:
    """Named relations of one administrative level with their rings; an unclosed boundary is kept and counted.

    `relations` has (type, id, tags, members); one relation is one row, so the work spreads by relation."""
    wanted = relations.filter(
        (F.col("type") == "relation") & (F.try_element_at("tags", F.lit("admin_level")) == str(level))
    ).withColumn("name", preferred_name(F.col("tags"))).filter(F.col("name") != "")
    rings = wanted.withColumn("_r", stitched("members"))
    return rings.select("id", "name", "_r.outer", "_r.inner", "_r.dropped").filter((F.size("outer") > 0) | (F.col("dropped") > 0))


def boundary_edges(places: DataFrame) -> DataFrame:
    """One row per ring side: locality, ring, role and the two ends."""
    outer = F.transform("outer", lambda r, i: F.struct(F.lit("outer").alias("role"), i.alias("ring"), r.alias("points")))
    inner = F.transform("inner", lambda r, i: F.struct(F.lit("inner").alias("role"), i.alias("ring"), r.alias("points")))
    rings = places.select("id", "name", F.explode(F.concat(outer, inner)).alias("_r"))
    sides = F.transform(
        F.sequence(F.lit(1), F.size("_r.points") - 1),
        lambda i: F.struct(F.get("_r.points", i - 1).alias("a"), F.get("_r.points", i).alias("b")),
    )
    bounds = [F.array_min(F.transform("_r.points", lambda p: p["lon"])).alias("ring_west")]
    flat = rings.select("id", "name", "_r.role", "_r.ring", F.get("_r.points", F.lit(0)).alias("first"), *bounds, F.explode(sides).alias("_s"))
    return flat.select(
        "id", "name", "role", "ring", "ring_west", F.col("first.lat").alias("first_lat"), F.col("first.lon").alias("first_lon"),
        F.col("_s.a.lat").alias("y1"), F.col("_s.a.lon").alias("x1"), F.col("_s.b.lat").alias("y2"), F.col("_s.b.lon").alias("x2"),
    )


# --- point in polygon ------------------------------------------------------------------------------------------------
def _tiles(low_y: Column, high_y: Column, low_x: Column, high_x: Column, step: float | None = None) -> Column:
    step = step or TILE_DEG
    rows = F.sequence(F.floor(low_y / step), F.floor(high_y / step))
    cols = F.sequence(F.floor(low_x / step), F.floor(high_x / step))
    return F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: F.struct(r.alias("ti"), c.alias("tj")))))


def rings_around(positions: DataFrame, edges: DataFrame) -> DataFrame:
    """(lat, lon, id, role, ring) for every ring that a position lies inside, by counting the sides a ray to the east
    crosses. A side is looked at from the tiles between the west end of its ring and its own east end."""
    sides = edges.filter(F.col("y1") != F.col("y2")).withColumn(
        "_t", F.explode(_tiles(F.least("y1", "y2"), F.greatest("y1", "y2"), F.col("ring_west"), F.greatest("x1", "x2")))
    )
    sides = sides.withColumns({"ti": F.col("_t.ti"), "tj": F.col("_t.tj")}).drop("_t")
    tiled = positions.withColumns({"ti": F.floor(F.col("lat") / TILE_DEG), "tj": F.floor(F.col("lon") / TILE_DEG)})
    crosses = (F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))
    cut = F.col("x1") + (F.col("lat") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    hits = tiled.join(sides, ["ti", "tj"]).filter(crosses & (F.col("lon") < cut))
    odd = hits.groupBy("lat", "lon", "id", "role", "ring").agg((F.count("*") % 2).alias("_odd"))
    return odd.filter(F.col("_odd") == 1).drop("_odd")


def containing_localities(positions: DataFrame, edges: DataFrame) -> DataFrame:
    """(lat, lon, id) of the localities around each position: inside an outer ring and in none of the holes of that ring.
    A hole belongs to the outer rings that its first corner lies in."""
    inside = rings_around(positions, edges)
    holes = edges.filter(F.col("role") == "inner").select("id", "ring", F.col("first_lat").alias("lat"), F.col("first_lon").alias("lon")).distinct()
    owners = rings_around(holes.select("lat", "lon").distinct(), edges.filter(F.col("role") == "outer"))
    owned = holes.join(owners.select("lat", "lon", "id", F.col("ring").alias("outer_ring")), ["lat", "lon", "id"]).select("id", F.col("ring"), "outer_ring")
    in_hole = inside.filter(F.col("role") == "inner").join(owned, ["id", "ring"]).select("lat", "lon", "id", F.col("outer_ring").alias("ring"))
    solid = inside.filter(F.col("role") == "outer").join(in_hole, ["lat", "lon", "id", "ring"], "left_anti")
    return solid.select("lat", "lon", "id").distinct()


# --- nearest side ----------------------------------------------------------------------------------------------------
def segment_distance_m(lat: Column, lon: Column, lon_scale: Column) -> Column:
    """Flat distance to the side (y1, x1)-(y2, x2); `lon_scale` is metres per degree of longitude."""
    py, px = lat * M_PER_DEG_LAT, lon * lon_scale
    ay, ax = F.col("y1") * M_PER_DEG_LAT, F.col("x1") * lon_scale
    dy, dx = (F.col("y2") - F.col("y1")) * M_PER_DEG_LAT, (F.col("x2") - F.col("x1")) * lon_scale
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length2))).otherwise(0.0)
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def _tiled(positions: DataFrame, sides: DataFrame, max_m: float) -> tuple[DataFrame, DataFrame]:
    """Positions in their tile, which is as wide as the reach, and sides in every tile they may be near to."""
    step = max_m / M_PER_DEG_LAT
    margin_y = max_m / 110_000.0
    margin_x = F.lit(margin_y * 1.1) / F.cos(F.radians(F.greatest(F.abs("y1"), F.abs("y2"))))
    tiles = _tiles(
        F.least("y1", "y2") - margin_y, F.greatest("y1", "y2") + margin_y, F.least("x1", "x2") - margin_x, F.greatest("x1", "x2") + margin_x, step
    )
    spread = sides.withColumn("_t", F.explode(tiles)).withColumns({"ti": F.col("_t.ti"), "tj": F.col("_t.tj")}).drop("_t")
    return positions.withColumns({"ti": F.floor(F.col("lat") / step), "tj": F.floor(F.col("lon") / step)}), spread


def sides_within(positions: DataFrame, sides: DataFrame, max_m: float, lon_scale: Column) -> DataFrame:
    """Sides no further than `max_m` from each position, joined by tiles as wide as that. Both are exchanged: the planner would
    collect sides by the million for the size of their file, and meet them in as few tasks as the positions' file has parts."""
    near = sorted_join(*_tiled(positions, sides, max_m), ["ti", "tj"]).drop("ti", "tj")
    return near.withColumn("dist_m", segment_distance_m(F.col("lat"), F.col("lon"), lon_scale)).filter(F.col("dist_m") <= max_m)


def assign_localities(points: DataFrame, places: DataFrame, tolerance_m: float = TOLERANCE_M) -> DataFrame:
    """Adds localidad, osm_relacion and criterio: the lowest id around the point, else the nearest boundary within the
    tolerance, else empty. Equal positions are worked out once."""
    edges = boundary_edges(places)
    positions = points.select("lat", "lon").distinct()
    inside = containing_localities(positions, edges).groupBy("lat", "lon").agg(F.min("id").alias("id"))
    free = points.join(inside, ["lat", "lon"], "left_anti").select("lat", "lon")
    open_positions = with_one_row(free.distinct(), free.agg((F.cos(F.radians(F.avg("lat"))) * M_PER_DEG_LAT).alias("_scale")))
    near = sides_within(open_positions, edges, tolerance_m, F.col("_scale"))
    nearest = near.groupBy("lat", "lon").agg(F.min_by("id", F.struct("dist_m", "id")).alias("id"))
    found = inside.withColumn("criterio", F.lit("dentro")).unionByName(nearest.withColumn("criterio", F.lit("cercana")))
    named = found.join(places.select("id", F.col("name").alias("localidad")), "id").select(
        "lat", "lon", "localidad", F.col("id").cast("string").alias("osm_relacion"), "criterio"
    )
    return points.join(named, ["lat", "lon"], "left").na.fill("", ["localidad", "osm_relacion", "criterio"])


# --- streets ---------------------------------------------------------------------------------------------------------
def street_sides(ways: DataFrame) -> DataFrame:
    """Sides of the ways that carry a useful name. `ways` has (type, id, tags, geometry)."""
    named = ways.filter(F.col("type") == "way").withColumn("street", preferred_name(F.col("tags")))
    named = named.filter((F.col("street") != "") & useful_street_name(F.col("street")) & (F.size("geometry") >= 2))
    sides = F.transform(
        F.sequence(F.lit(1), F.size("geometry") - 1), lambda i: F.struct(F.get("geometry", i - 1).alias("a"), F.get("geometry", i).alias("b"))
    )
    flat = named.select("id", "street", F.explode(sides).alias("_s"))
    return flat.select("id", "street", F.col("_s.a.lat").alias("y1"), F.col("_s.a.lon").alias("x1"), F.col("_s.b.lat").alias("y2"), F.col("_s.b.lon").alias("x2"))


def nearest_street(points: DataFrame, ways: DataFrame, max_m: float = STREET_M, ref_lat: float = (SOUTH + NORTH) / 2) -> DataFrame:
    """Adds calle and calle_m: the named street nearest to each point, empty when none is within reach; the lowest id of equally
    near ones. Pairs of positions and sides are gone through twice, for the least distance and for what lies at it: the first is
    a number, which is kept by position, while a least pair of distance and name would have all pairs sorted on disk."""
    scale = F.lit(M_PER_DEG_LAT * math.cos(math.radians(ref_lat)))
    tiled, spread = _tiled(points.select("lat", "lon").distinct(), street_sides(ways), max_m)
    place, gap = ["ti", "tj", "lat", "lon"], segment_distance_m(F.col("lat"), F.col("lon"), scale)
    near = sorted_join(tiled, spread, ["ti", "tj"]).withColumn("dist_m", gap).filter(F.col("dist_m") <= max_m)
    least = near.groupBy(*place).agg(F.min("dist_m").alias("calle_m"))
    hits = sorted_join(least, spread, ["ti", "tj"]).filter(gap == F.col("calle_m"))
    best = hits.groupBy(*place, "calle_m").agg(F.min_by("street", "id").alias("calle")).select("lat", "lon", "calle", "calle_m")
    return sorted_join(points, best, ["lat", "lon"], "left").na.fill("", ["calle"])


def cell_places(cells: DataFrame, places: DataFrame, ways: DataFrame) -> DataFrame:
    """Locality and street of each cell centre."""
    spots = cells.select("cell_id", "lat", "lon")
    streets = nearest_street(spots, ways).select("cell_id", "calle", "calle_m")
    return assign_localities(spots, places).join(streets, "cell_id").select(
        "cell_id", "localidad", "osm_relacion", "criterio", "calle", "calle_m"
    )
