"""The closure study: what its rows are described by, and pairs of blocks."""

import random

import pytest
from pyspark.sql import functions as F

from wayloom.operators import closures as K
from wayloom.operators import evaluation as E


def test_elements_of_one_file_are_described_on_all_cores(spark, tmp_path):
    """Rules and names cost much per row; a filter above must not take them back to the one part that a file is read as."""
    tags = F.create_map(F.lit("amenity"), F.lit("bar"), F.lit("name"), F.concat(F.lit("Bár "), F.col("id").cast("string")))
    spark.range(400).select(F.lit("node").alias("type"), "id", (35.88 + F.col("id") * 1e-5).alias("latitude"), F.lit(14.5).alias("longitude"), tags.alias("tags")).coalesce(1).write.parquet(str(tmp_path / "e"))
    elements = spark.read.parquet(str(tmp_path / "e"))
    for out in (K.population(elements), K.universe(elements)):
        assert "EvalPython" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.rdd.getNumPartitions() >= 2 and out.count() == 400 and out.filter("name = 'bar 7'").count() == 1


def test_pairs_of_blocks_are_counted_whole_without_a_row_for_every_block(spark, monkeypatch):
    """Against every pair, with ties, over several ranges and steps; no positive is repeated for each block."""
    monkeypatch.setattr(E, "RANGE_ROWS", 30)
    monkeypatch.setattr(E, "STEP_VALUES", 4)
    rng = random.Random(4)
    rows = [(m, r, i, float(rng.random() < 0.4), round(rng.random(), 1 if m == "t" else 3), rng.choice([3, 5, 8, 1001])) for m in "ts" for r in range(2) for i in range(150)]
    oof = spark.createDataFrame(rows, "model string, repetition int, row_id long, y double, prediction double, block long")
    found = E.concordance(oof)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    want = {}
    for m in "ts":
        for r in range(2):
            own = [x for x in rows if x[0] == m and x[1] == r]
            for p in (x for x in own if x[3] == 1):
                for q in (x for x in own if x[3] == 0):
                    key = m, p[5], q[5]
                    want[key] = want.get(key, 0.0) + ((p[4] > q[4]) + 0.5 * (p[4] == q[4])) / 2
    got = {(x["model"], x["a"], x["b"]): x["pairs"] for x in found.collect()}
    assert got == pytest.approx(want)
