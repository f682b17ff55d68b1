"""Plans: what ordered work and studies read and multiply, with broadcasts switched off."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wayloom.operators import causal as A
from wayloom.operators.chunks import ordered_pass

SF = "/root/testdata/sf0.001"
#: Most reads of stored data, files or checkpoints, in the plan of a query.
READS = {"change_points": 3, "specification_table": 4, "stratified_att": 4, "lag5_mean": 2, "collection_gap_report": 9}


@pytest.fixture
def plain_plans(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", READS)
def test_reads_and_products(spark, plain_plans, name):
    plan = plan_of(spark, name)
    assert len(re.findall(r"FileScan|Scan ExistingRDD", plan)) <= READS[name]
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def rows_of(rng, n):
    return [(rng.choice("ab"), rng.randrange(60), i, None if rng.random() < 0.2 else float(rng.randrange(9))) for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_one_pass_gives_totals_and_neighbours(spark, seed):
    """Against pandas: running and grand totals, and a frame that reaches over several thin chunks."""
    rng = random.Random(seed)
    data = pd.DataFrame(rows_of(rng, 80), columns=["k", "t", "i", "v"]).sort_values(["k", "t", "i"])
    df = spark.createDataFrame([tuple(None if x != x else x for x in r) for r in data.astype(object).itertuples(index=False)], "k string, t int, i int, v double").repartition(5)

    def add(w):
        return {"back": F.lag("i", 3).over(w), "on": F.lead("i", 2).over(w), "near": F.count("v").over(w.rowsBetween(-3, 2))}

    known = F.col("v").isNotNull().cast("long")
    out = ordered_pass(df, ["k"], ["t", "i"], F.floor(F.col("t") / rng.choice([1, 2, 7])), 3, 2, ["v"], add, {"pos": F.lit(1), "known": known}, {"known": "all_known"})
    assert out.columns == ["k", "t", "i", "v", "pos", "known", "all_known", "back", "on", "near"]
    got = out.toPandas().sort_values(["k", "t", "i"]).reset_index(drop=True)
    data = data.reset_index(drop=True)
    groups = data.groupby("k")
    assert got["pos"].tolist() == (groups.cumcount() + 1).tolist()
    assert got["known"].tolist() == data["v"].notna().groupby(data["k"]).cumsum().tolist()
    assert got["all_known"].tolist() == groups["v"].transform("count").tolist()
    for column, shift in (("back", 3), ("on", -2)):
        assert got[column].fillna(-1).tolist() == groups["i"].shift(shift).fillna(-1).tolist()
    wide = [groups["v"].shift(s).notna() & (groups["i"].shift(s).notna()) for s in range(-2, 4)]
    assert got["near"].tolist() == sum(x.astype(int) for x in wide).tolist()


def test_specifications_in_one_pass_are_the_single_ones(spark):
    """Each row of the table, with its strata worked out row by row; strata without controls are left out."""
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randrange(3), rng.randrange(5), rng.random() < 0.4, rng.randrange(100) / 4) for _ in range(300)]
    rows += [("lone", 9, 1, True, 5.0), ("mute", 8, 1, False, 2.0)]
    df = spark.createDataFrame(rows, "route string, hour int, day int, treated boolean, y double")
    specs = {"route": ["route"], "both": ["route", "hour"], "all": []}
    got = {r["specification"]: r for r in A.specification_table(df, specs, 50).collect()}
    frame = pd.DataFrame(rows, columns=["route", "hour", "day", "treated", "y"])
    for name, columns in specs.items():
        frame["key"] = frame[columns].astype(str).agg("|".join, axis=1) if columns else ""
        mu = frame[~frame.treated].groupby("key").y.mean()
        used = frame[frame.treated & frame.key.isin(mu.index)]
        diff = used.y - used.key.map(mu)
        r = got[name]
        assert r["att"] == pytest.approx(diff.mean()) and r["n_used"] == len(used) and r["n_strata_used"] == used.key.nunique()
        assert r["n_treated"] == frame.treated.sum() and r["share_used"] == pytest.approx(len(used) / frame.treated.sum())
        assert r["naive_difference"] == pytest.approx(frame[frame.treated].y.mean() - frame[~frame.treated].y.mean())
        one = df.withColumn("stratum", A.stratum(columns, df)).join(spark.createDataFrame(mu.reset_index().values.tolist(), "stratum string, mu double"), "stratum").filter("treated")
        ci = A.cluster_interval(one.withColumn("diff", F.col("y") - F.col("mu")), [], "day", 50).first()
        assert (r["ci_low"], r["ci_high"]) == pytest.approx((ci["ci_low"], ci["ci_high"]))


@pytest.mark.parametrize("name", ["covariate_balance", "worst_balanced_covariates"])
def test_balance_reads_written_scores(spark, name):
    """Six parts of the balance read scores and pairs: they are written once, not worked out again from the files by each."""
    assert "FileScan" not in plan_of(spark, name)


def test_balance_is_the_one_of_its_parts(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("ab"), rng.choice("xy"), rng.random() < 0.4, rng.randrange(50) / 10, rng.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, g string, c string, treated boolean, logit double, y double")
    got, want = (sorted(map(tuple, t.collect())) for t in (A.matched_balance(df, ["g"], ["c"]), A.balance(df, A.matched_pairs(df, ["g"]), ["c"])))
    assert got == want and len(got) == 2


def test_nearest_controls_go_through_each_range_twice_only(spark):
    """A frame that ends with the range is gone through from every row on; and the pairs are those of all comparisons."""
    rng = random.Random(9)
    rows = [(i, rng.choice("ab"), rng.random() < 0.5, rng.randrange(40) / 8, float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, g string, treated boolean, logit double, y double")
    out = A.nearest_controls(df, ["g"])
    assert "currentrow$(), unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString()
    for r in out.collect():
        gaps = {(abs(s - r["logit"]), s, i) for i, g, t, s, _ in rows if g == r["g"] and not t}
        low = min(gaps)
        assert r["gap"] == low[0] and (r["gap"], rows[r["control_id"]][3]) == low[:2]
