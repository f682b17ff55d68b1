"""Unit-root statistics of several numbers of lags against least squares on the same rows."""

import datetime as dt

import numpy as np
import pytest

from wayloom.operators import timeseries as TS

SCHEMA = "k string, id long, timestamp timestamp_ntz, v double"


def series():
    rng = np.random.default_rng(5)
    out = {"walk": np.cumsum(rng.normal(size=160)) + 20, "noise": rng.normal(size=120) + 5, "short": rng.normal(size=7), "two": np.array([1.0, 2.5]), "one": np.array([4.0])}
    ar = [0.0, 0.0]
    for e in rng.normal(size=140):
        ar.append(0.5 * ar[-1] - 0.3 * ar[-2] + e)
    return out | {"ar": np.array(ar)}


def plain(v, lags):
    d = np.diff(v)
    y, cols = d[lags:], [v[lags:-1], np.ones(len(d) - lags)] + [d[lags - k : len(d) - k] for k in range(1, lags + 1)]
    if len(y) <= lags + 2:
        return len(y), None
    x = np.column_stack(cols)
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    s2 = ((y - x @ b) ** 2).sum() / (len(y) - lags - 2)
    return len(y), b[0] / np.sqrt(s2 * np.linalg.inv(x.T @ x)[0, 0])


@pytest.fixture(scope="module")
def frame(spark):
    start = dt.datetime(2024, 5, 1)
    rows = [(k, i, start + dt.timedelta(hours=i), float(x)) for k, v in series().items() for i, x in enumerate(v)]
    rows += [("walk", 10_000 + i, start + dt.timedelta(hours=i, minutes=30), None) for i in range(5)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


def test_every_number_of_lags(frame):
    got = {(r["k"], r["lags"]): (r["n"], r["statistic"]) for r in TS.unit_root_by_lags(frame, ["k"], "v", 4).collect()}
    want = {(k, p): plain(v, p) for k, v in series().items() for p in range(5) if len(v) > p + 1}
    assert got.keys() == want.keys()
    for key, (n, statistic) in want.items():
        assert got[key][0] == n
        assert got[key][1] is None if statistic is None else got[key][1] == pytest.approx(statistic, rel=1e-6), key


def test_same_as_one_number_of_lags_alone(frame):
    alone = {r["k"]: r["statistic"] for r in TS.unit_root(frame.filter("k IN ('walk', 'noise', 'ar')"), ["k"], "v", 2).collect()}
    every = {r["k"]: r["statistic"] for r in TS.unit_root_by_lags(frame, ["k"], "v", 3).filter("lags = 2").collect()}
    assert {k: every[k] for k in alone} == pytest.approx(alone)


def test_no_rows(spark):
    assert TS.unit_root_by_lags(spark.createDataFrame([], SCHEMA), ["k"], "v", 2).collect() == []
