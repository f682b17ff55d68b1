"""Chunked windows, ranks and percentiles against pandas, whatever the partitioning."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayloom.operators.chunks import average_rank, exact_percentiles, with_position, with_previous_rows, with_running_totals

VALUES = st.lists(st.integers(-5, 5).map(lambda v: v / 2), min_size=1, max_size=40)
QUICK = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, values, keys=None):
    keys = keys or ["a"] * len(values)
    return spark.createDataFrame([(k, i, float(v)) for i, (k, v) in enumerate(zip(keys, values))], "k string, i int, v double")


@QUICK
@given(VALUES)
def test_percentiles_match_numpy(spark, values):
    got = exact_percentiles(frame(spark, values), ["k"], "v", {"p50": 0.5, "p95": 0.95}, parts=4).first()
    assert got["p50"] == pytest.approx(np.quantile(values, 0.5))
    assert got["p95"] == pytest.approx(np.quantile(values, 0.95))


@QUICK
@given(VALUES)
def test_ranks_match_pandas(spark, values):
    got = average_rank(frame(spark, values), ["k"], "v").orderBy("i").toPandas()
    assert got["rank"].tolist() == pd.Series(values).rank(method="average").tolist()
    assert (got["n"] == len(values)).all()


def test_one_value_that_fills_the_key(spark):
    values = [7.0] * 30 + [1.0, 9.0]
    df = frame(spark, values)
    assert exact_percentiles(df, ["k"], "v", {"m": 0.5}).first()["m"] == 7.0
    ranks = {r["v"]: r["rank"] for r in average_rank(df, ["k"], "v").collect()}
    assert ranks == {1.0: 1.0, 7.0: 16.5, 9.0: 32.0}


@pytest.mark.parametrize("parts", [1, 17])
def test_previous_rows_cross_chunk_borders(spark, parts):
    n = 40
    df = frame(spark, range(n)).repartition(parts)

    def add(w):
        return {"before": F.sum("v").over(w.rowsBetween(-3, -1)), "around": F.avg("v").over(w.rowsBetween(-2, 2))}

    got = with_previous_rows(df, ["k"], ["i"], 3, ["v"], add, F.floor(F.col("i") / 2), 2).orderBy("i").toPandas()
    s = pd.Series(range(n), dtype=float)
    assert got["before"].fillna(-1).tolist() == s.shift(1).rolling(3, min_periods=1).sum().fillna(-1).tolist()
    assert got["around"].tolist() == s.rolling(5, center=True, min_periods=1).mean().tolist()


@pytest.mark.parametrize("parts", [1, 17])
def test_running_totals_and_positions(spark, parts):
    df = frame(spark, [1] * 25, ["a"] * 10 + ["b"] * 15).repartition(parts)
    totals = with_running_totals(df, ["k"], ["i"], {"t": F.col("v")}, F.floor(F.col("i") / 4)).orderBy("i").toPandas()
    assert totals["t"].tolist() == [*range(1, 11), *range(1, 16)]
    placed = with_position(df, ["k"], ["i"], F.floor(F.col("i") / 4), "pos", "n").orderBy("i").toPandas()
    assert placed["pos"].tolist() == [*range(1, 11), *range(1, 16)]
    assert placed["n"].tolist() == [10] * 10 + [15] * 15
