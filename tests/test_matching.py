"""Candidate pairs, greedy matching and connected parts against plain versions."""

import difflib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wayloom.functions import text
from wayloom.functions.text import common_characters, match_name, name_similarity
from wayloom.operators import graphs, matching
from wayloom.operators.geo import haversine_m
from wayloom.operators.graphs import component_roots
from wayloom.operators.matching import STOP_WORDS, candidate_pairs, greedy_matching
from wayloom.session import checkpointed

SCHEMA = "left_id long, right_id long, sim double, dist_m double, level string"


def plain(pairs):
    left, right, out = set(), set(), []
    for p in sorted(pairs, key=lambda p: (-p[2], p[3], p[0], p[1])):
        if p[0] not in left and p[1] not in right:
            left.add(p[0])
            right.add(p[1])
            out.append(p)
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_random_pairs_with_ties(spark, seed):
    rng = random.Random(seed)
    pairs = list({(a, b): (a, b, rng.randrange(4) / 4, float(rng.randrange(3)), "x") for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(150))}.values())
    got = greedy_matching(spark.createDataFrame(pairs, SCHEMA).repartition(4))
    assert got.columns == ["left_id", "right_id", "sim", "dist_m", "level"]
    assert sorted(tuple(r) for r in got.collect()) == plain(pairs)


def test_a_chain_of_ten_thousand_links(spark):
    """Each pair shares a place with the next better one: rounds that take the locally best pair would need thousands."""
    pairs = [(i, i, 1 - 2 * i / 30_000, 1.0, "x") for i in range(5000)] + [(i + 1, i, 1 - (2 * i + 1) / 30_000, 1.0, "x") for i in range(5000)]
    got = greedy_matching(spark.createDataFrame(pairs, SCHEMA).repartition(4))
    assert sorted(tuple(r) for r in got.collect()) == plain(pairs)


def test_pairs_without_chains_need_no_parts(spark, monkeypatch):
    """All pairs were linked into parts, a dozen rounds over all places, and a part was matched in one task."""
    rng = random.Random(9)
    pairs = [(a, b, rng.random(), rng.random(), "x") for a in range(300) for b in rng.sample(range(400), 5)]
    monkeypatch.setattr(matching, "component_roots", None)
    got = greedy_matching(spark.createDataFrame(pairs, SCHEMA).repartition(4))
    assert sorted(tuple(r) for r in got.collect()) == plain(pairs)


def test_a_pair_that_comes_twice_is_taken_once(spark):
    pairs = [(1, 1, 0.9, 2.0, "a"), (1, 1, 0.9, 1.0, "b"), (1, 2, 0.8, 1.0, "c"), (2, 1, 0.8, 1.0, "d"), (2, 2, 0.7, 1.0, "e"), (2, 2, 0.7, 1.0, "e")]
    assert sorted(tuple(r) for r in greedy_matching(spark.createDataFrame(pairs, SCHEMA)).collect()) == [pairs[1], pairs[4]]


def test_matching_collects_no_side_on_the_driver(spark, monkeypatch):
    """Each round over the places broadcast its small sides, which stayed on the driver."""
    def watched(df):
        out = checkpointed(df)
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        return out

    for module in (matching, graphs):
        monkeypatch.setattr(module, "checkpointed", watched)
    pairs = [(i, i, 1 - 2 * i / 300, 1.0, "x") for i in range(50)] + [(i + 1, i, 1 - (2 * i + 1) / 300, 1.0, "x") for i in range(50)]
    assert sorted(tuple(r) for r in greedy_matching(spark.createDataFrame(pairs, SCHEMA).repartition(4)).collect()) == plain(pairs)


def test_no_pairs(spark):
    assert greedy_matching(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 500])
def test_components(spark, n):
    rng = random.Random(n)
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range(int(n * 0.6) + 1)] + [(10_000 + i, 10_001 + i) for i in range(300)]
    rng.shuffle(links)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in component_roots(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for pair in links for x in pair}


def test_candidates_against_all_pairs(spark):
    rng = random.Random(11)
    words = ["luzzu", "marina", "sliema", "corner", "old", "harbour", "valletta", "cafe", "bakery", "st", "julians", "aaa", "aab"]

    def places(n, prefix):
        names = [" ".join(rng.choices(words, k=rng.randrange(1, 4))) for _ in range(n)]
        noisy = [("".join(c for c in x if rng.random() > 0.15) if rng.random() < 0.5 else x) for x in names]
        return [(prefix + i, x, 35.9 + rng.random() * 0.0012, 14.5 + rng.random() * 0.0012) for i, x in enumerate([*noisy, "", None, "x"])]

    left, right = places(60, 0), places(60, 1000)
    a, b = (spark.createDataFrame(rows, "id long, name string, lat double, lon double") for rows in (left, right))
    got = {(r["left_id"], r["right_id"]): (round(r["sim"], 9), r["level"]) for r in candidate_pairs(a, b).collect()}
    sides = [df.select(F.col("id").alias(f"{p}_id"), match_name(F.col("name")).alias(f"{p}_name"), F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon")) for df, p in ((a, "a"), (b, "b"))]
    every = sides[0].filter("a_name <> ''").crossJoin(sides[1].filter("b_name <> ''")).withColumns({
        "sim": name_similarity(F.col("a_name"), F.col("b_name"), STOP_WORDS), "dist": haversine_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")),
    }).collect()
    want = {(r["a_id"], r["b_id"]): (round(r["sim"], 9), "fuerte" if r["sim"] >= 0.75 else "probable") for r in every
            if r["dist"] <= 100 and (r["sim"] >= 0.75 or r["sim"] >= 0.5 and r["dist"] <= 60)}
    assert got == want and len(want) > 50 and {level for _, level in want.values()} == {"fuerte", "probable"}


def test_places_meet_once_and_nothing_is_collected(spark, tmp_path):
    """The distance join ran once for the pairs and once for their names, and small sides were sent through the driver."""
    rows = [(i, f"bar {i % 7}", 35.9 + i / 1e6, 14.5) for i in range(200)]
    spark.createDataFrame(rows, "id long, name string, lat double, lon double").write.parquet(f"{tmp_path}/places")
    a, b = spark.read.parquet(f"{tmp_path}/places"), spark.read.parquet(f"{tmp_path}/places")
    equal = candidate_pairs(a, b).filter("sim = 1")
    assert equal.count() > 200
    plan = equal._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("sequence_ratio") == 1
    assert "Broadcast" not in equal._jdf.queryExecution().executedPlan().toString()


def test_ratios_are_kept_only_up_to_a_limit(spark, monkeypatch):
    names = ["luzzu", "luz", "marina", "mara", "old harbour"]
    pairs = [(x, y) for _ in range(3) for x in names for y in names]
    df = spark.createDataFrame(pairs, "a string, b string").coalesce(1)
    monkeypatch.setattr(text, "RATIOS_KEPT", 2)
    got = [r["r"] for r in df.select(text.sequence_ratio(F.col("a"), F.col("b")).alias("r")).collect()]
    assert got == [difflib.SequenceMatcher(None, x, y).ratio() for x, y in pairs]


def test_common_characters_count_copies(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choices("ab c.", k=rng.randrange(9))), "".join(rng.choices("ab c.", k=rng.randrange(9)))) for _ in range(200)]
    got = [r["n"] for r in spark.createDataFrame(rows, "a string, b string").select(common_characters(F.col("a"), F.col("b")).alias("n")).collect()]
    assert got == [sum((Counter(a) & Counter(b)).values()) for a, b in rows]
