"""Closure labels from two map snapshots, and the features used to study them.

Elements are rows (type, id, latitude, longitude, tags)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.functions.taxonomy import STUDY_CATEGORIES, STUDY_TAGS, classify, has_life_cycle_mark, is_vacant
from wayloom.functions.text import is_unnamed, place_name
from wayloom.operators.chunks import spread
from wayloom.operators.geo import (
    EAST, M_PER_DEG_LAT, NORTH, SOUTH, WEST, cell_index, in_any_circle, nearest_same_category, neighbour_counts, same_key_within, sorted_join,
)
from wayloom.session import checkpointed

# Fixed values of the study.
EDGE_MARGIN_M = 500.0
SAME_NAME_M = 60.0
SECOND_SOURCE_M = 150.0
COVERAGE_M = 1500.0
MIN_CLOSURES, MIN_BLOCKS = 60, 30
LEVELS = ("fuerte", "superviviente", "dudoso", "probable")
MIN_REPEATS = 3
MAX_DISTANCE_M = 1000.0
KEY = ["type", "id"]


def block_label(row: Column, col: Column, size: int = 4, row_shift: int = 0, col_shift: int = 0) -> Column:
    return F.floor((row + row_shift) / size) * 1000 + F.floor((col + col_shift) / size)


def edge_distance_m(lat: Column, lon: Column) -> Column:
    """Metres to the nearest side of the grid, negative outside."""
    per_lon = F.cos(F.radians(lat)) * M_PER_DEG_LAT
    return F.least(
        (lat - SOUTH) * M_PER_DEG_LAT, (F.lit(NORTH) - lat) * M_PER_DEG_LAT, (lon - WEST) * per_lon, (F.lit(EAST) - lon) * per_lon
    )


def study_category(tags: Column) -> Column:
    return classify(tags, STUDY_TAGS)["category"]


def _described(elements: DataFrame) -> DataFrame:
    """Valid identity, category, normalised name and finite position of each element, written once. Rules and names cost much per
    row: rows of a file that is read as one part are dealt over the cores first, and filters above would be pushed below that."""
    finite = F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & ~F.isnan("latitude") & ~F.isnan("longitude")
    return checkpointed(spread(elements.filter(F.col("type").isNotNull() & F.col("id").isNotNull())).select(
        *KEY, F.when(finite, F.col("latitude")).alias("lat"), F.when(finite, F.col("longitude")).alias("lon"), "tags",
        study_category(F.col("tags")).alias("category"), place_name(F.try_element_at("tags", F.lit("name"))).alias("name"),
    ))


def with_drop_reason(elements: DataFrame) -> DataFrame:
    """Elements with the first reason that keeps them out of the study population, NULL for its members."""
    reason = (
        F.when(F.col("category").isNull(), "sin_categoria")
        .when(F.col("name") == "", "sin_nombre")
        .when(F.col("lat").isNull(), "sin_coordenadas")
        .when(edge_distance_m(F.col("lat"), F.col("lon")) <= EDGE_MARGIN_M, "borde_o_fuera")
        .when(is_vacant(F.col("tags")), "local_vacio")
    )
    return _described(elements).withColumn("reason", reason)


def population(elements: DataFrame) -> DataFrame:
    return with_drop_reason(elements).filter(F.col("reason").isNull()).drop("reason", "tags")


def universe(elements: DataFrame) -> DataFrame:
    """Everything that counts as competition or density: a category, a position, not vacant; named or not."""
    rows = _described(elements)
    return rows.filter(F.col("category").isNotNull() & F.col("lat").isNotNull() & ~is_vacant(F.col("tags"))).drop("tags")


def today(now: DataFrame, cycle: DataFrame) -> DataFrame:
    """Elements of today and their life-cycle marks by (type, id); today's tags win, and its position when it exists."""
    empty = F.create_map().cast("map<string,string>")
    a = now.select(*KEY, F.struct("latitude", "longitude", F.coalesce("tags", empty).alias("tags")).alias("_now"))
    b = cycle.select(*KEY, F.struct("latitude", "longitude", F.coalesce("tags", empty).alias("tags")).alias("_cycle"))
    here = F.coalesce("_now", "_cycle")
    tags = F.map_zip_with(
        F.coalesce("_cycle.tags", empty), F.coalesce("_now.tags", empty), lambda k, old, new: F.coalesce(new, old)
    )
    return sorted_join(a, b, KEY, "full_outer").select(*KEY, here["latitude"].alias("latitude"), here["longitude"].alias("longitude"), tags.alias("tags"))


def label(past: DataFrame, now: DataFrame, cycle: DataFrame) -> DataFrame:
    """Level of each member of the past population; the first rule that holds decides."""
    people = population(past)
    seen = _described(today(now, cycle)).withColumns(
        {"vacant": is_vacant(F.col("tags")), "marked": has_life_cycle_mark(F.col("tags"))}
    )
    current = seen.select(
        *KEY, F.col("category").alias("now_category"), F.col("name").alias("now_name"), "vacant", "marked", F.lit(True).alias("here")
    )
    candidates = seen.filter(F.col("category").isNotNull() & (F.col("name") != "") & F.col("lat").isNotNull() & ~F.col("vacant"))
    remapped = same_key_within(people, candidates, "name", SAME_NAME_M).select(*KEY, F.lit(True).alias("near"))
    rows = sorted_join(sorted_join(people, current, KEY, "left"), remapped, KEY, "left")
    active = F.col("now_category").isNotNull()
    same = ~F.col("marked") & (F.col("now_category") == F.col("category")) & (F.col("now_name") == F.col("name"))
    level = (
        F.when(F.coalesce("here", F.lit(False)) & (F.col("vacant") | (F.col("marked") & ~active)), "fuerte")
        .when(F.coalesce("here", F.lit(False)) & active & same, "superviviente")
        .when(F.coalesce("here", F.lit(False)) & active, "dudoso")
        .when(F.coalesce("near", F.lit(False)), "dudoso")
        .otherwise("probable")
    )
    return with_closures(rows.withColumn("level", level).select(*people.columns, "level"))


def with_closures(rows: DataFrame) -> DataFrame:
    """1 closed, 0 open, NULL not known: the main label, and the one that counts strong evidence only."""
    level = F.col("level")
    return rows.withColumns(
        {
            "closed": F.when(level.isin("fuerte", "probable"), 1.0).when(level == "superviviente", 0.0),
            "closed_strong": F.when(level == "fuerte", 1.0).when(level == "superviviente", 0.0),
        }
    )


def second_source_sensitivity(labels: DataFrame, places: DataFrame, circles: DataFrame) -> DataFrame:
    """Labels inside the coverage of the second source; a probable closure with a namesake there becomes doubtful."""
    points = labels.select(*[F.col(c).alias(f"p_{c}") for c in labels.columns])
    covered = in_any_circle(points, circles, COVERAGE_M).toDF(*labels.columns)
    named = places.select(place_name(F.col("name")).alias("name"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    named = named.filter((F.col("name") != "") & ~is_unnamed(F.col("name")))
    alive = same_key_within(covered.filter(F.col("level") == "probable"), named, "name", SECOND_SOURCE_M).select(*KEY, F.lit(True).alias("_alive"))
    moved = sorted_join(covered, alive, KEY, "left").withColumn("level", F.when(F.col("_alive"), "dudoso").otherwise(F.col("level"))).drop("_alive")
    return with_closures(moved.drop("closed", "closed_strong"))


def gate(labels: DataFrame) -> DataFrame:
    """Whether there are enough closures, in enough blocks, to train at all."""
    row, col = cell_index(F.col("lat"), F.col("lon"))
    closed = F.col("closed") == 1.0
    out = labels.agg(
        F.count("*").alias("population"),
        *[F.count_if(F.col("level") == n).alias(n) for n in LEVELS],
        F.count_if(closed).alias("closures"),
        F.count_distinct(F.when(closed, block_label(row, col))).alias("blocks"),
    )
    passes = (F.col("closures") >= MIN_CLOSURES) & (F.col("blocks") >= MIN_BLOCKS)
    return out.withColumn("passes", passes)


def features(people: DataFrame, everyone: DataFrame) -> DataFrame:
    """Per member: category indicators, neighbours within 250 and 500 m, nearest of its category, chain flag. The points are
    written once: three distance operators read them a dozen times."""
    ident = F.concat_ws(":", "type", F.col("id").cast("string"))
    points = checkpointed(everyone.select(ident.alias("id"), "category", "lat", "lon"))
    repeats = everyone.filter(F.col("name") != "").groupBy("name").agg((F.count("*") >= MIN_REPEATS).cast("double").alias("chain"))
    rows = sorted_join(people.withColumn("_pid", ident), repeats, "name", "left")
    for radius in (250, 500):
        near = neighbour_counts(points, float(radius)).select(
            F.col("id").alias("_pid"), F.col("n_same").cast("double").alias(f"n_same_{radius}"), F.col("n_total").cast("double").alias(f"n_total_{radius}")
        )
        rows = sorted_join(rows, near, "_pid")
    nearest = nearest_same_category(points, MAX_DISTANCE_M).select(F.col("id").alias("_pid"), "dist_m")
    row, col = cell_index(F.col("lat"), F.col("lon"))
    return sorted_join(rows, nearest, "_pid").select(
        *people.columns,
        *[(F.col("category") == c).cast("double").alias(f"cat_{c}") for c in STUDY_CATEGORIES],
        "n_same_250", "n_total_250", "n_same_500", "n_total_500", "dist_m", F.coalesce("chain", F.lit(0.0)).alias("chain"),
        row.alias("fila"), col.alias("col"),
    )


def modelling_frame(labels: DataFrame, past: DataFrame, target: str = "closed") -> DataFrame:
    """Features of the members whose label is known."""
    known = labels.filter(F.col(target).isNotNull()).withColumn("y", F.col(target))
    return features(known, universe(past))


def closure_rates(labels: DataFrame) -> DataFrame:
    return labels.filter(F.col("closed").isNotNull()).groupBy("category").agg(F.count("*").alias("n"), F.avg("closed").alias("rate"))
