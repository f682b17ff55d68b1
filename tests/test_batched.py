"""Batched fits against one fit at a time."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayloom.operators import batched as B
from wayloom.operators import evaluation as E
from wayloom.operators import models as M
from wayloom.operators.closures import block_label

REPEATS, FOLDS = 2, 3


@pytest.fixture(scope="module")
def cells(spark):
    rng = random.Random(6)
    rows = []
    for i in range(240):
        a, b, c = rng.gauss(0, 1), rng.random() * 1000, float(rng.random() < 0.3)
        lam = math.exp(0.3 + 0.5 * a - 0.001 * b)
        rows.append((str(i), i // 20, i % 20, float(np.random.default_rng(i).poisson(lam)), float(rng.random() < 1 / (1 + math.exp(-a))), a, None if i % 17 == 0 else b, c, rng.choice("uv")))
    df = spark.createDataFrame(rows, "row_id string, fila int, col int, y double, z double, a double, b double, c double, kind string")
    return B.dealt_folds(df.withColumn("block", block_label(F.col("fila"), F.col("col"))), REPEATS, FOLDS).cache()


def test_folds_are_those_of_one_repetition(cells):
    for r in range(REPEATS):
        one = E.assign_folds(cells.withColumn("_b", block_label(F.col("fila"), F.col("col"), 4, r % 4, r // 4 % 4)), "_b", FOLDS, r)
        assert one.filter(F.col("folds")[r] != F.col("fold")).isEmpty()


def table(cells):
    return cells.toPandas().sort_values("row_id").reset_index(drop=True)


@pytest.mark.parametrize("family", ["poisson", "logistic"])
def test_linear_models_reach_their_optimum(cells, family):
    """At the end the gradient of each fit's own penalised loss is zero, on its training rows alone."""
    target = "y" if family == "poisson" else "z"
    spec = B.Linear(["a", "b"], ["c"], family, 1e-3 if family == "poisson" else 1.0, family == "poisson")
    rows = B.filled(cells.withColumn("y", F.col(target)), ["a", "b"])
    betas = B.fit_linear(rows, {"m": spec}, REPEATS, FOLDS)["m"]
    data = table(rows)
    for r in range(REPEATS):
        for f in range(FOLDS):
            train = data[data.folds.map(lambda x: x[r] != f)]
            x = train[["a", "b", "c"]].to_numpy()
            mean, sd = np.r_[x[:, :2].mean(axis=0), 0], np.r_[x[:, :2].std(axis=0), 1]
            beta = betas[r * FOLDS + f]
            scaled = beta[1:] * sd
            eta = beta[0] + x @ beta[1:]
            mu = np.exp(eta) if family == "poisson" else 1 / (1 + np.exp(-eta))
            z = np.c_[np.ones(len(x)), (x - mean) / sd]
            weight = spec.penalty * (len(x) if spec.on_mean else 1)
            gradient = z.T @ (train.y.to_numpy() - mu) - weight * np.r_[0, scaled]
            assert np.abs(gradient).max() < 1e-5
    scored = B.scored_linear(rows, {"m": spec}, REPEATS, FOLDS).toPandas()
    assert len(scored) == len(data) * REPEATS
    one = scored[(scored.row_id == "7") & (scored.repetition == 1)].prediction.item()
    row = data[data.row_id == "7"].iloc[0]
    eta = betas[FOLDS + row.folds[1]] @ np.r_[1, row.a, row.b, row.c]
    assert one == pytest.approx(math.exp(eta) if family == "poisson" else 1 / (1 + math.exp(-eta)))


def test_means_of_the_other_folds(cells):
    data = table(cells)
    for keys in ([], ["kind"]):
        got = B.scored_means(cells, "mean", keys).toPandas()
        assert len(got) == len(data) * REPEATS
        for row_id, r, p in got[["row_id", "repetition", "prediction"]].sample(20, random_state=1).itertuples(index=False):
            own = data[data.row_id == row_id].iloc[0]
            train = data[data.folds.map(lambda x: x[r] != own.folds[r])]
            assert p == pytest.approx((train[train.kind == own.kind] if keys else train).y.mean())


def plain_split(codes, g, h, leaf, ridge):
    """The best split by trying every one."""
    best = (1e-12, None)
    for j in range(codes.shape[1]):
        for cut in range(B.BINS + 1):
            left = codes[:, j] <= cut
            if min(left.sum(), (~left).sum()) < leaf:
                continue
            gain = sum(g[s].sum() ** 2 / (h[s].sum() + ridge) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + ridge)
            if gain > best[0] * (1 + 1e-9):
                best = gain, (j, cut)
    return best[1]


def test_a_tree_splits_where_trying_every_split_does():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 12, (150, 3)).astype(np.uint8)
    y = rng.poisson(np.exp(codes[:, 1] / 6 - (codes[:, 0] > 5))).astype(float)
    spec = B.Boosting(["p", "q", "r"], rounds=1, depth=2, leaf=10)
    start, columns, lasts, values = B.grown(codes, y, spec, 0)
    g, h = np.exp(start) - y, np.full(len(y), np.exp(start))
    root = plain_split(codes, g, h, 10, 1.0)
    assert (columns[0, 0], lasts[0, 0]) == root
    left = codes[:, root[0]] <= root[1]
    for side, node in ((left, 1), (~left, 2)):
        assert (columns[0, node], lasts[0, node]) == plain_split(codes[side], g[side], h[side], 10, 1.0)
        low = codes[:, columns[0, node]] <= lasts[0, node]
        for part, leaf in ((side & low, 2 * node - 2), (side & ~low, 2 * node - 1)):
            assert values[0, leaf] == pytest.approx(-0.05 * g[part].sum() / (h[part].sum() + 1.0))
    scores = B.tree_scores(codes, (start, columns, lasts, values))
    assert len(set(scores.round(12))) <= 4


def test_trees_with_too_few_rows_do_not_split():
    codes = np.arange(12, dtype=np.uint8)[:, None]
    start, columns, lasts, values = B.grown(codes, np.arange(12.0), B.Boosting(["p"], rounds=2, leaf=20), 0)
    assert (lasts == B.BINS).all() and np.allclose(B.tree_scores(codes, (start, columns, lasts, values)), np.log(5.5))


def test_boosting_predicts_every_row_from_other_folds(cells):
    spec = B.Boosting(["a", "b", "c"], rounds=60, leaf=8)
    got = B.scored_boosting(cells, "boosting", spec, REPEATS, FOLDS).toPandas()
    again = B.scored_boosting(cells.repartition(7), "boosting", spec, REPEATS, FOLDS).toPandas()
    key = ["row_id", "repetition"]
    assert len(got) == 240 * REPEATS and got.sort_values(key).prediction.tolist() == again.sort_values(key).prediction.tolist()
    mean = B.scored_means(cells, "media").toPandas()

    def deviance(t):
        y, p = t.y.to_numpy(), t.prediction.to_numpy()
        return 2 * (np.where(y > 0, y * np.log(np.maximum(y, 1e-9) / p), 0) - y + p).mean()

    assert deviance(got) < deviance(mean)
    few = B.scored_boosting(cells, "boosting", spec, REPEATS, FOLDS, most_rows=120).toPandas()
    assert len(few) == len(got) and few.prediction.notna().all()


def test_a_closed_gate_trains_nothing(spark):
    gate = spark.createDataFrame([(False,)], "passes boolean")
    out = M.closure_study(gate, gate)
    assert out.count() == 0 and out.columns[0] == "model"


@pytest.mark.parametrize("operator, want", [("cross_validate_counts", {"repeats": 10, "folds": 5, "rounds": 200}), ("cross_validate_closures", {"repeats": 10, "folds": 5, "rounds": 150})])
def test_settings_are_whole(operator, want):
    import inspect

    defaults = {k: v.default for k, v in inspect.signature(getattr(M, operator)).parameters.items()}
    assert {k: defaults[k] for k in want} == want


@pytest.mark.parametrize("family, share", [("logistic", 0.8), ("poisson", 1.0)])
def test_boosting_learns_from_every_row_of_tables_over_the_bound(cells, monkeypatch, family, share):
    """Growing in passes gives the trees of all rows: no row is left out for being one too many."""
    monkeypatch.setattr(B, "KEPT_TREES", 3)
    spec = B.Boosting(["a", "b", "c"], family, rounds=8, depth=2, rate=0.2, leaf=8, subsample=share)
    rows = cells.withColumn("y", F.col("z" if family == "logistic" else "y"))
    key = ["row_id", "repetition"]
    whole = B.scored_boosting(rows, "boosting", spec, REPEATS, FOLDS).toPandas().sort_values(key)
    passes = B.scored_boosting(rows, "boosting", spec, REPEATS, FOLDS, most_rows=120).toPandas().sort_values(key)
    assert whole[key].values.tolist() == passes[key].values.tolist()
    assert passes.prediction.to_numpy() == pytest.approx(whole.prediction.to_numpy(), rel=1e-9)


def test_draws_of_a_tree_keep_their_share_and_differ_by_tree_and_fit():
    ids = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 50_000)
    first = B._drawn(ids, 1000, 0, 0.8)
    assert abs(first.mean() - 0.8) < 0.01
    for other in (B._drawn(ids, 1000, 1, 0.8), B._drawn(ids, 1001, 0, 0.8)):
        assert abs((first & other).mean() - 0.64) < 0.01
