"""Bronze, silver and gold on hand-made rows."""

from wayloom.functions import scalars as S
from wayloom.operators import medallion as M
from pyspark.sql import functions as F
import pytest

RAW = "id int, timestamp string, origin string, destination string, travel_time_min double, no_traffic_time_min double, origin_temperature double, origin_humidity double, destination_temperature double, destination_humidity double"


def raw(spark, times, **extra):
    rows = [(i, f"2026-01-05T{8 + i:02d}:00:00", "Msida", "Sliema", float(t), 9.0, 20.0, 50.0, 20.0, 50.0) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, RAW)


def test_bronze_keeps_first_and_bounds(spark):
    df = raw(spark, [10, 0, 500, 501, -1])
    again = df.filter("id = 0").withColumns({"id": F.lit(99), "travel_time_min": F.lit(77.0)})
    space = df.filter("id = 1").withColumns({"id": F.lit(98), "timestamp": F.lit("2026-01-06 01:00:00")})
    got = {r["raw_timestamp"].isoformat(): r for r in M.bronze(df.union(again).union(space), ["id"]).collect()}
    assert got["2026-01-05T08:00:00"]["travel_time_min"] == 10.0
    assert len(got) == 4
    assert got["2026-01-05T09:00:00"]["data_quality_score"] == 80.0
    assert got["2026-01-05T10:00:00"]["data_quality_score"] == 80.0
    assert "2026-01-06T01:00:00" in got


def test_missing_column_is_refused(spark):
    with pytest.raises(ValueError):
        M.bronze(raw(spark, [1]).drop("travel_time_min"), ["id"])


def test_unreadable_rows_are_counted(spark):
    df = raw(spark, [10, 20]).withColumn("timestamp", F.when(F.col("id") == 1, "not a date").otherwise(F.col("timestamp")))
    row = M.bronze_summary(M.bronze_audit(df, ["id"])).first()
    assert (row["original_records"], row["inserted_records"], row["missing_critical"]) == (2, 1, 1)


def test_daily_kpis(spark):
    k = M.daily_kpis(M.silver(M.bronze(raw(spark, [10, 12, 11, 15, 9, 13]), ["id"]))).first()
    assert k["avg_travel_time"] == pytest.approx(70 / 6)
    assert k["median_travel_time"] == 11.5
    assert k["p95_travel_time"] == pytest.approx(14.5)
    assert (k["peak_hour"], k["peak_travel_time"], k["sample_count"]) == ("11", 15.0, 6)
    assert k["reliability_score"] == pytest.approx(100 - 2 * 2.1602469)


def test_one_sample_has_no_reliability(spark):
    assert M.daily_kpis(M.silver(M.bronze(raw(spark, [10]), ["id"]))).first()["reliability_score"] == 0.0


def test_delay_rules(spark):
    rows = spark.createDataFrame([(10.0, 12.0), (10.0, None), (10.0, 8.0), (10.0, 5.0)], "t double, f double")
    d = S.traffic_delay(F.col("t"), F.col("f"))
    got = [tuple(r) for r in rows.select(d, S.congestion_level(d)).collect()]
    assert got == [(0.0, "free_flow"), (None, "unknown"), (2.0, "moderate"), (5.0, "heavy")]
    without = M.bronze(raw(spark, [10]), ["id"]).drop("no_traffic_time_min")
    assert M.silver(without).first()["traffic_delay_min"] == 0.0


def test_running_twice_adds_nothing(spark, tmp_path):
    for _ in range(2):
        M.run_medallion(raw(spark, [10, 12, 11]), str(tmp_path), ["id"], "2026-01-06 00:00:00")
    assert spark.read.parquet(f"{tmp_path}/bronze").count() == 3
    assert spark.read.parquet(f"{tmp_path}/silver").count() == 3
    assert spark.read.parquet(f"{tmp_path}/gold_route_kpis").count() == 1


def test_interpolation_fills_the_start_of_a_gap(spark):
    from wayloom.operators.timeseries import interpolate

    values = [None, 0.0, None, None, None, None, 5.0, None, None, None, None]
    rows = [("a", f"2026-01-01 {h:02d}:00:00", v) for h, v in enumerate(values)]
    s = spark.createDataFrame(rows, "k string, hour string, share double").withColumn("hour", F.col("hour").cast("timestamp_ntz"))
    got = [r["filled"] for r in interpolate(s, ["k"], 3).orderBy("hour").collect()]
    assert got == [None, 0.0, 1.0, 2.0, 3.0, None, 5.0, 5.0, 5.0, 5.0, None]
