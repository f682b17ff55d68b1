"""Hourly states: merging, computing again and the stored table against a plain rollup of all trips."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wayloom.operators import rollups as R
from wayloom.operators.routes import trips_hourly

SCHEMA = "trip long, datetime timestamp, origin string, destination string, mobility_level string, duration_min double, distance_km double, temperature double, humidity double, traffic_delay_min double"
START = dt.datetime(2024, 3, 1)


def some_trips(n, seed):
    rng = random.Random(seed)

    def number():
        return None if rng.random() < 0.2 else rng.randrange(400) / 8

    out = [(i, START + dt.timedelta(minutes=rng.randrange(4 * 24 * 60)), rng.choice("ab"), rng.choice("xy"), rng.choice(["Alta demora", "Movilidad normal", None]), *[number() for _ in range(5)]) for i in range(n)]
    return out + [(n, None, "a", "x", None, 1.0, 1.0, 1.0, 1.0, 1.0), (n + 1, START, None, None, "Alta demora", *[None] * 5)]


@pytest.fixture(scope="module")
def trips(spark):
    return spark.createDataFrame(some_trips(900, 7), SCHEMA).repartition(3).cache()


def table(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def plain(trips):
    return table(trips_hourly(trips.filter("datetime IS NOT NULL")))


def test_figures_are_those_of_the_plain_rollup(trips):
    assert table(R.figures(R.hourly_states(trips))) == plain(trips)


def test_states_of_disjoint_rows_merge_in_any_order(trips):
    parts = [R.hourly_states(trips.filter(F.pmod("trip", F.lit(3)) == k)) for k in range(3)]
    assert table(R.figures(R.merged(*parts))) == table(R.figures(R.merged(R.merged(parts[2], parts[0]), parts[1]))) == plain(trips)


def test_changed_and_removed_rows_are_seen_inside_their_range_only(trips):
    low, high = START + dt.timedelta(hours=30, minutes=20), START + dt.timedelta(hours=41)
    inside = F.col("datetime").between(F.lit(low), F.lit(high))
    after = trips.withColumn("duration_min", F.when(inside, 1.0).otherwise(F.col("duration_min"))).filter(~(inside & (F.col("trip") % 2 == 0)) | F.col("datetime").isNull())
    bounds = R.touched_hours(trips.filter(inside)).first()
    assert bounds["low"].minute == bounds["high"].minute == 0 and bounds["low"] <= low + dt.timedelta(hours=1)
    renewed = R.recomputed(R.hourly_states(trips), after, bounds["low"], bounds["high"])
    assert table(R.figures(renewed)) == plain(after) != plain(trips)


def test_hours_after_the_stored_ones_come_from_the_trips(trips):
    until = START + dt.timedelta(hours=50)
    old = R.hourly_states(trips.filter(F.col("datetime") < F.lit(until)))
    assert table(R.live(old, trips, until)) == table(R.live(R.hourly_states(trips), trips, until)) == plain(trips)


def test_stored_days_are_replaced_and_the_others_left(spark, trips, tmp_path):
    path = str(tmp_path / "hourly")
    R.refresh(spark, trips, path, START, START + dt.timedelta(days=3, hours=23))
    assert table(R.figures(R.stored(spark, path))) == plain(trips)
    second = F.to_date("datetime") == F.lit("2024-03-02").cast("date")
    without = trips.filter(~second | F.col("datetime").isNull())
    for _ in range(2):
        R.refresh(spark, without, path, START + dt.timedelta(days=1, hours=5), START + dt.timedelta(days=1, hours=6))
        assert table(R.figures(R.stored(spark, path))) == plain(without)
    R.refresh(spark, trips.filter("false"), path, START, START)
    first = F.to_date("datetime") == F.lit("2024-03-01").cast("date")
    assert table(R.figures(R.stored(spark, path))) == plain(without.filter(~first))


def test_no_trips(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert R.figures(R.hourly_states(none)).collect() == []
    assert tuple(R.touched_hours(none).first()) == (None, None)
