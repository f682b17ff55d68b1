"""The forecast summary on short, unknown and no values."""

from datetime import datetime, timedelta

from wayloom.operators import timeseries as TS

SCHEMA = "id long, timestamp timestamp_ntz, origin string, destination string, travel_time_min double"
KEYS = ["origin", "destination"]
MONDAY = datetime(2024, 1, 1)


def summary(spark, rows):
    got = TS.forecast_summary(spark.createDataFrame(rows, SCHEMA), KEYS, "travel_time_min", lags=1)
    return {(r["origin"], r["part"], r["item"]): r["value"] for r in got.collect()}


def test_parts(spark):
    rows = [(i, MONDAY + timedelta(hours=i), "a", "b", float(i % 5 + i % 3)) for i in range(48)]
    rows += [(100, MONDAY, "c", "d", None), (101, MONDAY + timedelta(days=6, hours=5), "c", "d", 7.0), (101, MONDAY + timedelta(days=6, hours=5), "c", "d", 8.0)]
    got = summary(spark, rows)
    assert got["a", "records", "rows"] == got["a", "records", "values"] == 48
    assert got["a", "range", "end"] - got["a", "range", "start"] == 47 * 3600
    for hour in range(24):
        assert got["a", "hour", str(hour)] == (rows[hour][4] + rows[hour + 24][4]) / 2
    assert abs(got["a", "weekday", "0"] - sum(r[4] for r in rows[:24]) / 24) < 1e-9
    assert got["a", "level_stationarity", "stationary"] == 1 and {k[2] for k in got if k[:2] == ("a", "unit_root")} == {"statistic", "stationary"}
    assert (got["c", "records", "rows"], got["c", "records", "values"]) == (3, 2)
    assert (got["c", "hour", "0"], got["c", "hour", "5"], got["c", "weekday", "0"], got["c", "weekday", "6"]) == (None, 7.5, None, 7.5)


def test_no_rows(spark):
    assert summary(spark, []) == {}
