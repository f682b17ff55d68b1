"""One-to-one matching of places between two sources, and the coverage report built on it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.functions.text import counted_characters, match_name, name_similarity, name_tokens
from wayloom.operators.geo import in_any_circle, sorted_join, within_distance
from wayloom.operators.graphs import component_roots
from wayloom.session import checkpointed

# Radius and result limit of a search, distances and similarities of a match, words that tell nothing apart.
RADIUS_M, RESULT_LIMIT = 1500.0, 50
STRONG_M, PROBABLE_M = 100.0, 60.0
STRONG, PROBABLE = 0.75, 0.50
STOP_WORDS = (
    "the", "and", "restaurant", "ristorante", "bar", "cafe", "caffe", "coffee", "pub", "pizzeria", "grill", "bistro",
    "kitchen", "shop", "store", "food", "take", "away", "takeaway", "malta", "ltd", "co", "of", "de", "la", "el", "il",
    "snack", "house",
)
LOG_PATTERN = r"\[([^\]]+)\] Foursquare devolvi\S* ([0-9]+) resultados crudos"


def candidate_pairs(left: DataFrame, right: DataFrame, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """Pairs (left_id, right_id, sim, dist_m, level) near enough and alike enough to be one place.

    Both inputs hold (id, name, lat, lon). Places meet once; names are compared only where their characters allow the similarity
    that the distance asks for, as matching stretches never hold more characters than both names have in common, copies counted,
    or where they share a word that counts. Characters and words are taken apart before the places meet."""

    def side(df: DataFrame, ident: str, place: str, name: str) -> DataFrame:
        named = df.select(F.col("id").alias(ident), match_name(F.col("name")).alias(name), F.col("lat").alias(f"{place}_lat"), F.col("lon").alias(f"{place}_lon"))
        words = F.transform(name_tokens(F.col(name), stop), lambda w: F.xxhash64(w))
        return named.filter(F.col(name) != "").withColumns({f"{name}_characters": counted_characters(F.col(name)), f"{name}_words": words})

    near = within_distance(side(left, "left_id", "c", "left_name"), side(right, "p_id", "p", "right_name"), STRONG_M)
    la, lb = F.length("left_name"), F.length("right_name")
    asked = F.when(F.col("dist_m") <= PROBABLE_M, PROBABLE).otherwise(STRONG) * (la + lb)
    possible = (2 * F.least(la, lb) >= asked) & (2 * F.size(F.array_intersect("left_name_characters", "right_name_characters")) >= asked)
    worth = near.filter(possible | F.arrays_overlap("left_name_words", "right_name_words"))
    scored = worth.select("left_id", "p_id", "dist_m", name_similarity(F.col("left_name"), F.col("right_name"), stop).alias("sim"))
    level = F.when(F.col("sim") >= STRONG, "fuerte").when((F.col("sim") >= PROBABLE) & (F.col("dist_m") <= PROBABLE_M), "probable")
    return scored.withColumn("level", level).filter(F.col("level").isNotNull()).select(
        "left_id", F.col("p_id").alias("right_id"), "sim", "dist_m", "level"
    )


def greedy_matching(pairs: DataFrame) -> DataFrame:
    """The one-to-one matching that takes pairs (left_id, right_id, sim, dist_m, ...) by similarity, then distance, then ids.

    A pair that comes first for both of its places is taken in any order, so rounds take all such pairs at once and drop what
    shares a place with them. While a round leaves at most half of the pairs another one follows; what is left by a round that
    leaves more is a matter of chains, in which each pair waits for the next better one, and is matched part by part."""
    rest, taken = checkpointed(pairs), []
    n = rest.count()
    while n:
        before = n
        first = checkpointed(_first_for_both(rest))
        taken.append(first)
        for side in ("left_id", "right_id"):
            rest = sorted_join(rest, first.select(side), side, "left_anti")
        rest = checkpointed(rest.select(*pairs.columns))
        n = rest.count()
        if 2 * n > before:
            taken.append(_matched_by_part(rest))
            break
    return reduce(DataFrame.unionByName, taken, rest.limit(0))


def _first_for_both(pairs: DataFrame) -> DataFrame:
    """Pairs that come first in the order of the matching among all pairs of their left and among all pairs of their right place."""
    order = F.struct(-F.col("sim"), "dist_m", "left_id", "right_id")
    of_left = pairs.groupBy("left_id").agg(F.min_by(F.struct(*pairs.columns), order).alias("pair")).select("left_id", "pair.right_id", "pair")
    of_right = pairs.groupBy("right_id").agg(F.min_by("left_id", order).alias("left_id"))
    return sorted_join(of_left, of_right, ["left_id", "right_id"]).select("pair.*")


def _matched_by_part(pairs: DataFrame) -> DataFrame:
    """Pairs without a common place do not touch each other, so each connected part of the pairs is matched on its own: its rows
    come to one task in their order, which keeps only the places taken so far. Parts are as long as chains of places that are
    near and alike; however long a chain, there are no rounds over it."""
    ends = {side: F.concat(F.lit(f"{side}:"), F.col(f"{side}_id").cast("string")) for side in ("left", "right")}
    roots = component_roots(pairs.select(ends["left"].alias("a"), ends["right"].alias("b")))
    keyed = sorted_join(pairs.withColumn("node", ends["left"]), roots, "node").withColumn("_order", -F.col("sim"))
    dealt = keyed.repartition("root").sortWithinPartitions("root", "_order", "dist_m", "left_id", "right_id").select(*pairs.columns, "root")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, left, right = None, set(), set()
        for batch in batches:
            keep = []
            for root, a, b in zip(*(batch.column(c).to_pylist() for c in ("root", "left_id", "right_id")), strict=True):
                if root != part:
                    part, left, right = root, set(), set()
                free = a not in left and b not in right
                if free:
                    left.add(a)
                    right.add(b)
                keep.append(free)
            yield batch.select(pairs_columns).filter(pa.array(keep, pa.bool_()))

    pairs_columns = pairs.columns
    return dealt.mapInArrow(take, pairs.schema)


def point_key(name: Column) -> Column:
    """Name with every stretch outside ASCII as '?', so that logs in any encoding compare."""
    return F.trim(F.regexp_replace(name, r"[^\x00-\x7f]+", "?"))


def search_log(lines: DataFrame) -> DataFrame:
    """Last result count of each search point. `lines` has (line_no, value)."""
    parsed = lines.select(
        "line_no", point_key(F.regexp_extract("value", LOG_PATTERN, 1)).alias("point_key"),
        F.regexp_extract("value", LOG_PATTERN, 2).try_cast("int").alias("results"),
    ).filter(F.col("results").isNotNull())
    return parsed.groupBy("point_key").agg(F.max_by("results", "line_no").alias("results"))


def circles(points: DataFrame, log: DataFrame, limit: int = RESULT_LIMIT) -> DataFrame:
    """Search points with their state: complete below the limit, cut at it, unknown without a log line."""
    joined = points.withColumn("point_key", point_key(F.col("point"))).join(log, "point_key", "left").drop("point_key")
    state = F.when(F.col("results").isNull(), "unknown").when(F.col("results") < limit, "complete").otherwise("cut")
    return joined.withColumn("state", state)


def coverage_report(left: DataFrame, right: DataFrame, matches: DataFrame, complete: DataFrame) -> DataFrame:
    """Share of each category with a counterpart in the other source: the left inside complete circles, the left
    everywhere, and the right inside complete circles. Inputs hold (id, category, lat, lon)."""
    spots = complete.select(F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))

    def covered(df):
        points = df.select(*[F.col(c).alias(f"p_{c}") for c in df.columns])
        return in_any_circle(points, spots, RADIUS_M).toDF(*df.columns)

    def block(name, df, side):
        found = matches.select(F.col(f"{side}_id").alias("id"), "level")
        rows = df.join(found, "id", "left")
        return rows.groupBy("category").agg(
            F.count("*").alias("n"), F.avg((F.coalesce("level", F.lit("")) == "fuerte").cast("double")).alias("strong"),
            F.avg(F.col("level").isNotNull().cast("double")).alias("any"),
        ).select(F.lit(name).alias("block"), "category", "n", "strong", "any")

    return (
        block("left_complete", covered(left), "left")
        .unionByName(block("left_all", left, "left"))
        .unionByName(block("right_complete", covered(right), "right"))
    )
