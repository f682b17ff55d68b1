"""Model inputs: full-rank indicators, any number of routes, no key made up for a join."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wayloom.operators import models as M
from wayloom.operators.chunks import PART_ROWS, average_rank, dealt, exact_percentiles
from wayloom.operators.indicators import indicators
from wayloom.plans.common import measurements
from wayloom.plans.model_queries import by_cycle


def test_indicators_have_full_rank_and_take_unseen_levels(spark):
    train = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("a", "y"), ("b", "y")], "p string, q string")
    test = spark.createDataFrame([("a", "x"), ("new", "y"), ("c", None)], "p string, q string")
    fitted = Pipeline(stages=indicators(["p", "q"], train)).fit(train)

    def matrix(df):
        rows = fitted.transform(df).select(vector_to_array("_o_p").alias("p"), vector_to_array("_o_q").alias("q")).collect()
        return np.array([[1.0, *r["p"], *r["q"]] for r in rows])

    assert np.linalg.matrix_rank(matrix(train)) == matrix(train).shape[1] == 4
    assert matrix(test).tolist() == [[1, 0, 0, 0], [1, 0, 0, 1], [1, 1, 0, 0]]


def test_forest_takes_two_thousand_routes(spark):
    rows = spark.range(4000).select(
        *[(F.col("id") % k).cast("double").alias(c) for k, c in enumerate(M.TRAVEL_FEATURES, 3)],
        F.concat(F.lit("r"), F.col("id") % 2000).alias("route"), ((F.col("id") % 2000) / 10.0).alias("travel_time_min"),
    )
    model = M.fit_travel_time(rows, 3, 6)
    assert model.transform(rows.limit(50).withColumn("route", F.lit("unseen"))).count() == 50
    scored = model.transform(rows).select(F.corr("prediction", "travel_time_min")).first()[0]
    assert scored > 0.9


def test_whole_table_percentiles_and_ranks(spark):
    df = spark.createDataFrame([(float(v),) for v in [5, 1, 4, 4, 2, 9]], "v double")
    got = exact_percentiles(df, [], "v", {"median": 0.5, "high": 0.9}).collect()
    assert [tuple(r) for r in got] == [(4.0, float(np.percentile([5, 1, 4, 4, 2, 9], 90)))]
    assert sorted((r["v"], r["rank"], r["n"]) for r in average_rank(df, [], "v").collect()) == [(1, 1, 6), (2, 2, 6), (4, 3.5, 6), (4, 3.5, 6), (5, 5, 6), (9, 6, 6)]


@pytest.mark.parametrize("name", ["travel_time_histogram", "treatment_above_median", "share_by_source_weather", "gap_artifact_share", "chosen_threshold", "timestamp_repair_checks"])
def test_no_product_of_two_tables(spark, name):
    """One-row totals come as scalar subqueries, even where no table is small enough to broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
    try:
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "CartesianProduct" not in plan


def test_texts_are_cut_on_all_cores(spark):
    """A small file is one part; its texts and the fit's passes would stay on one core."""
    one = spark.createDataFrame([(i, "red ring" if i % 2 else "steel bolt", "ab"[i % 2]) for i in range(40)], "id int, t string, c string").coalesce(1)
    model = M.fit_phrases(one, "t", "c", slots=1 << 10)
    out = M.classify_phrases(model, one, "t")
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert all(r["category"] == r["c"] for r in out.collect())


def test_rows_of_a_fit_are_dealt_over_the_cores(spark):
    """Rows that come as one part are dealt, the same way in whatever order they come; few rows stay together."""
    rows = spark.range(3 * PART_ROWS).select("id", (F.col("id") % 7).alias("v"))
    first, second = dealt(rows.coalesce(1)), dealt(rows.orderBy(F.desc("v")).coalesce(2))
    parts = [df.rdd.map(lambda r: r["id"]).glom().collect() for df in (first, second)]
    assert 2 <= len(parts[0]) <= spark.sparkContext.defaultParallelism
    assert parts[0] == parts[1] and all(p == sorted(p) for p in parts[0])
    assert max(map(len, parts[0])) < 1.1 * min(map(len, parts[0]))
    assert dealt(rows.limit(100).repartition(9)).rdd.getNumPartitions() == 1


def test_regression_fits_read_dealt_rows(spark, monkeypatch):
    """The boosted rounds of a one-file table ran in a single task."""
    seen = []
    fit = M.GBTRegressor.fit
    monkeypatch.setattr(M.GBTRegressor, "fit", lambda self, df, *a: seen.append(df.rdd.getNumPartitions()) or fit(self, df, *a))
    monkeypatch.setattr("wayloom.operators.chunks.PART_ROWS", 2000)
    out = M.evaluate_regression(measurements(spark, "/root/testdata/sf0.01"), by_cycle, rounds=1).collect()
    assert len(out) == 2 and 2 <= seen[0] <= spark.sparkContext.defaultParallelism
