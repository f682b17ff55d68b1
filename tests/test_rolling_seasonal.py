"""The seasonal model at every midnight against a forecast made from the history of that midnight alone."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wayloom.operators import timeseries as TS

START = dt.datetime(2024, 1, 1, 5)


def hours(key, n, gaps, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        at = START + dt.timedelta(hours=i)
        value = 0.4 + 0.2 * (at.hour in (7, 8, 17)) + 0.1 * rng.random()
        out.append((key, at, None if any(a <= i < b for a, b in gaps) else value))
    return out


#: Gaps over a midnight, of a single hour, longer than a day, at the start and at the end.
ROWS = (hours("plain", 160, [], 1) + hours("midnight", 160, [(17, 21), (42, 44), (66, 68), (90, 99)], 2) + hours("long", 200, [(60, 95), (96, 99)], 3)
        + hours("ends", 140, [(0, 4), (112, 140)], 4) + hours("short", 20, [], 5) + hours("empty", 80, [(0, 80)], 6))


@pytest.fixture(scope="module")
def series(spark):
    return spark.createDataFrame(ROWS, "k string, hour timestamp_ntz, share double").repartition(3).cache()


def test_every_midnight_sees_its_own_past_only(series):
    got = {(r["k"], r["hour"]): r["estacional"] for r in TS.seasonal_by_cut(series, ["k"]).collect()}
    assert len(got) == len(ROWS)
    compared = 0
    for cut in (dt.datetime(2024, 1, d) for d in range(2, 9)):
        past = series.filter(F.col("hour") < F.lit(cut).cast("timestamp_ntz"))
        for r in TS.seasonal_forecast(past, ["k"]).collect():
            # A series that ended before this midnight has no hours left to compare.
            if (r["k"], r["hour"]) in got and r["hour"].date() == cut.date():
                mine = got[r["k"], r["hour"]]
                assert (mine is None) == (r["forecast"] is None), (r, mine)
                if mine is not None:
                    assert mine == pytest.approx(r["forecast"], abs=1e-9), r
                    compared += 1
    assert compared > 300


def test_evaluation_has_the_seasonal_model_beside_the_baselines(series):
    plain = {(r["k"], r["cut"], r["model"]): r["mae"] for r in TS.rolling_evaluation(series, ["k"], 6, 48).collect()}
    both = {(r["k"], r["cut"], r["model"]): r["mae"] for r in TS.rolling_evaluation(series, ["k"], 6, 48, seasonal=True).collect()}
    assert {k: v for k, v in both.items() if k[2] != TS.SEASONAL} == pytest.approx(plain)
    assert {k[:2] for k in both if k[2] == TS.SEASONAL} == {k[:2] for k in plain}


def test_no_rows(spark):
    empty = spark.createDataFrame([], "k string, hour timestamp_ntz, share double")
    assert TS.seasonal_by_cut(empty, ["k"]).collect() == []
