"""Planted effects, statistics with known answers, streams that run twice, sources and checks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayloom.functions.stats import incomplete_beta, two_sided_p
from wayloom.operators import causal as A
from wayloom.operators import evaluation as E
from wayloom.operators import quality as Q
from wayloom.operators import routes as R
from wayloom.operators import timeseries as TS
from wayloom.operators import upserts as U
from wayloom.sources import payloads as L
from wayloom.sources import tables as D
from wayloom.streaming import jobs as J


def planted(spark, effect, days=14):
    """Every hour has one warm and one cold row, so the warmer half of an hour and week is the warm rows."""
    r = random.Random(0)
    rows = []
    for i in range(days * 48):
        day, hour, warm = i // 48, i // 2 % 24, i % 2 == 1
        t = 20 + hour / 10 + (4 if warm else 0) + r.random()
        stamp = f"2026-01-{5 + day:02d} {hour:02d}:{30 * (i % 2):02d}:00"
        rows.append((i, stamp, "a", "b", "s", t, 10 + 0.2 * hour + (effect if warm else 0) + r.gauss(0, 0.3)))
    df = spark.createDataFrame(rows, "id int, timestamp string, origin string, destination string, data_source string, origin_temperature double, travel_time_min double")
    return df.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@pytest.mark.parametrize("effect", [0.0, 2.0])
def test_strata_recover_the_planted_effect(spark, effect):
    rows = A.assign_treatment(A.analysis_rows(planted(spark, effect), "origin_temperature"))
    got = A.stratified_adjusted(rows, ["hour", "week"], "s", 200).first()
    assert got["att"] == pytest.approx(effect, abs=0.1)
    assert got["ci_low"] <= got["att"] <= got["ci_high"]


def test_score_matching_recovers_the_planted_effect(spark):
    rows = A.assign_treatment(A.analysis_rows(planted(spark, 2.0), "origin_temperature"))
    got = A.score_matching(rows, ["hour"], ["hour", "day_of_week"], 50).first()
    assert got["att"] == pytest.approx(2.0, abs=0.2)
    assert got["share_matched"] > 0.3


def test_nearest_control_prefers_the_lower_on_a_tie(spark):
    rows = [(1, True, 0.5, 1.0), (2, False, 0.0, 10.0), (3, False, 1.0, 20.0), (4, True, 2.0, 0.0), (5, True, -9.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, treated boolean, logit double, y double").withColumn("g", F.lit("g"))
    got = {r["id"]: r["control_id"] for r in A.nearest_controls(df, ["g"]).collect()}
    assert got == {1: 2, 4: 3, 5: 2}


def test_unknown_treatment_and_stratum(spark):
    rows = A.analysis_rows(planted(spark, 0.0, 2), "origin_temperature")
    with pytest.raises(ValueError):
        A.assign_treatment(rows, "hot")
    with pytest.raises(ValueError):
        A.stratum(["nope"], rows)


def test_p_values():
    assert incomplete_beta(2.0, 3.0, 0.5) == pytest.approx(0.6875)
    assert two_sided_p(2.228138852, 10) == pytest.approx(0.05, abs=1e-6)
    assert two_sided_p(0.0, 5) == pytest.approx(1.0)


def test_auc_and_resampled_interval(spark):
    df = spark.createDataFrame([("g", 1, 0.9), ("g", 1, 0.5), ("g", 0, 0.5), ("g", 0, 0.1)], "g string, y int, s double")
    assert E.rank_auc(df, ["g"], "y", "s").first()["auc"] == pytest.approx(0.875)
    one_class = df.filter("y = 1")
    assert E.rank_auc(one_class, ["g"], "y", "s").first()["auc"] is None
    flags = spark.createDataFrame([(1.0, 0.0)] * 30 + [(0.0, 0.0)] * 70, "a double, b double")
    got = E.paired_interval(flags, "a", "b", 2000).first()
    assert got["difference"] == pytest.approx(0.3)
    assert got["ci_low"] == pytest.approx(0.21, abs=0.03) and got["ci_high"] == pytest.approx(0.39, abs=0.03)


def test_block_folds_keep_blocks_together(spark):
    df = spark.range(100).withColumn("b", F.col("id") % 9)
    dealt = E.assign_folds(df, "b", 4).groupBy("b").agg(F.count_distinct("fold").alias("k")).collect()
    assert all(r["k"] == 1 for r in dealt)


def test_white_noise_is_level_and_a_walk_is_not(spark):
    r = np.random.default_rng(3)
    noise, walk = r.normal(size=500), np.cumsum(r.normal(size=500))
    rows = [(k, i, f"2026-01-{1 + i // 24:02d} {i % 24:02d}:00:00", float(v)) for k, s in (("noise", noise), ("walk", walk)) for i, v in enumerate(s)]
    df = spark.createDataFrame(rows, "k string, id int, timestamp string, v double").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    level = {r["k"]: r["stationary"] for r in TS.level_stationarity(df, ["k"], "v", 8).collect()}
    root = {r["k"]: r["stationary"] for r in TS.unit_root(df, ["k"], "v", 1).collect()}
    assert level == {"noise": True, "walk": False} and root == {"noise": True, "walk": False}
    acf = {(r["k"], r["lag"]): r["acf"] for r in TS.autocorrelation(df, ["k"], "v", 5).collect()}
    x = noise - noise.mean()
    assert acf[("noise", 2)] == pytest.approx((x[2:] @ x[:-2]) / (x @ x))


def test_only_queries_are_run(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert R.read_only_query(spark, "SELECT count(*) AS n FROM three").first()["n"] == 3
    for text in ("DROP VIEW three", "SELECT 1; DROP VIEW three", ""):
        with pytest.raises(ValueError):
            R.read_only_query(spark, text)
    with pytest.raises(ValueError):
        R.scan_columns(spark.range(1).withColumn("timestamp", F.lit(None)), ["id; drop"], "2026-01-01", 1)


def test_hash_ignores_order_and_sees_changes(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 1.5), (2, "b", 1.5)], "i int, s string, d double")
    one = Q.table_hash(df).first()["digest"]
    assert Q.table_hash(df.repartition(7).orderBy(F.desc("i"))).first()["digest"] == one
    assert Q.table_hash(df.distinct()).first()["digest"] != one


def test_conflicting_copies_fail(spark):
    same = spark.createDataFrame([("node", 1, 1.0), ("node", 1, 1.0)], "type string, id long, lat double")
    assert U.unique_elements(same, ["lat"]).count() == 1
    other = same.union(spark.createDataFrame([("node", 1, 2.0)], same.schema))
    with pytest.raises(Exception, match="conflicting copies"):
        U.unique_elements(other, ["lat"]).collect()


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "p.psv").write_text("tipo|categoria|frase|ciego\nx|food|una \"casa\"|\ny|none|null|1\n", encoding="utf-8")
    got = [tuple(r) for r in D.read_phrases(spark, str(tmp_path / "p.psv")).collect()]
    assert got == [("x", "food", 'una "casa"', ""), ("y", "none", "null", "1")]
    df = spark.createDataFrame([("2026-01-01T00:00:00", "a", "b", "s", 1.5)], "timestamp string, origin string, destination string, data_source string, travel_time_min double")
    D.append_history(df, f"{tmp_path}/h")
    D.append_history(df, f"{tmp_path}/h")
    assert D.read_text_history(spark, f"{tmp_path}/h").count() == 2
    assert D.migrate(D.read_text_history(spark, f"{tmp_path}/h")).first()["travel_time_min"] == 1.5
    assert D.read_or_empty(spark, f"{tmp_path}/none", "a int, b string").count() == 0
    D.export_view(spark.createDataFrame([(35.123456789, 0.000012345678, "x")], "lat double, v double, s string"), f"{tmp_path}/v")
    texts = [p.read_text(encoding="utf-8") for p in (tmp_path / "v").glob("*.csv")]
    assert all(t.startswith("﻿") for t in texts) and any("35.123457" in t for t in texts)


def test_bundle_and_manifest(spark, tmp_path):
    pois = spark.createDataFrame([("c", "s", "n", 1.0, 2.0)], "category string, subcategory string, name string, latitude double, longitude double")
    zones = spark.createDataFrame([("z", 5)], "zone string, population long")
    m = spark.createDataFrame([("a", "b", 1.0)], "origin string, destination string, travel_time_min double")
    tables = {"pois": pois, "pois_second_source": pois, "zone_demographics": zones, "measurements": m, "context": pois}
    listing = D.export_bundle(spark, tables, str(tmp_path / "b"))
    names = [r["table"] for r in listing.collect()]
    written = {n: spark.read.parquet(f"{tmp_path}/b/{n}") for n in names}
    assert {r["state"] for r in Q.verify_manifest(written, listing).collect()} == {"ok"}


def test_payload_details(spark):
    body = '{"routes":[{"summary":{"lengthInMeters":1500,"travelTimeInSeconds":120,"trafficDelayInSeconds":300},"legs":[{"points":[{"latitude":1.0,"longitude":2.0}]}]}]}'
    docs = spark.createDataFrame([(1, body), (2, '{"routes":[]}')], "i int, body string")
    rows = L.traffic_routes(docs).collect()
    assert len(rows) == 1
    assert (rows[0]["no_traffic_time_min"], rows[0]["traffic_delay_min"], rows[0]["average_speed_kmh"]) == (0.0, 5.0, 45.0)
    assert rows[0]["polyline"] == '[{"latitude":1.0,"longitude":2.0}]'


def test_incremental_batches_equal_one_run(spark, tmp_path):
    schema = "id int, timestamp timestamp_ntz, origin string, destination string, travel_time_min double, no_traffic_time_min double"
    rows = spark.sql(
        "SELECT CAST(id AS INT) AS id, TIMESTAMP_NTZ '2026-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT) * 5) AS timestamp, 'a' AS origin, "
        "CAST(id % 2 AS STRING) AS destination, CAST(id % 7 + 5 AS DOUBLE) AS travel_time_min, 4.0D AS no_traffic_time_min FROM range(30)"
    )
    write = J.ingest_batch(str(tmp_path / "inc"), "2026-02-01 00:00:00")
    for i, part in enumerate(("id < 12", "id >= 10 AND id < 20", "id >= 10 AND id < 20", "id >= 20")):
        write(rows.filter(part), i)
    from wayloom.operators import medallion as M

    M.run_medallion(rows, str(tmp_path / "all"), ["id"], "2026-02-01 00:00:00")
    for t in ("bronze", "silver", "gold_route_kpis", "gold_route_rankings"):
        a, b = (spark.read.parquet(f"{tmp_path}/{d}/{t}") for d in ("inc", "all"))
        assert a.count() == b.count()
        assert a.drop("ingestion_timestamp").exceptAll(b.select(*a.columns).drop("ingestion_timestamp")).count() == 0
