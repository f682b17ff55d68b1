"""Metrics, spatial folds, clustered intervals and decisions over long tables of out-of-sample predictions.

A prediction table has (model, repetition, row_id, y, prediction) and, for clustered intervals, `block`."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from wayloom.functions.scalars import poisson_deviance, relative_gap
from wayloom.functions.stats import replicate_draw
from wayloom.operators.causal import cluster_interval
from wayloom.operators.chunks import average_rank, value_chunks, with_one_row

RUN = ["model", "repetition"]
#: Rows of a range of predictions, about, and distinct values that are looked at together: what a task holds of the pairs.
RANGE_ROWS, STEP_VALUES = 100_000, 2048
CHUNK_PAIRS = pa.schema([("model", pa.string()), ("repetition", pa.int32()), ("chunk", pa.int32()), *((c, pa.binary()) for c in ("blocks", "pos", "neg", "pairs"))])


# --- folds -----------------------------------------------------------------------------------------------------------
def assign_folds(df: DataFrame, block: str, folds: int, seed: int = 0) -> DataFrame:
    """Adds `fold`: all rows of a block in one fold, blocks dealt evenly in hash order. Blocks are few: one row each."""
    blocks = df.select(block).distinct()
    order = Window.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(block).cast("string"))), block)
    dealt = blocks.withColumn("fold", (F.row_number().over(order) - 1) % folds)
    return df.join(dealt, block)


def stratified_folds(df: DataFrame, label: str, ident: str, folds: int, seed: int = 0) -> DataFrame:
    """Adds `fold` by hash of the row id, shifted per class so that each class spreads over all folds."""
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), label, F.col(ident).cast("string"))), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("fold", F.pmod(digest, F.lit(folds)).cast("int"))


# --- metrics ---------------------------------------------------------------------------------------------------------
def precision_at_k(oof: DataFrame, k: int) -> DataFrame:
    """Share of the k rows predicted highest that are among the k truly highest; row id breaks ties."""
    by_y = F.row_number().over(Window.partitionBy(*RUN).orderBy(F.desc("y"), "row_id"))
    by_p = F.row_number().over(Window.partitionBy(*RUN).orderBy(F.desc("prediction"), "row_id"))
    sizes = oof.groupBy(*RUN).agg(F.least(F.count("*"), F.lit(k)).alias("_k"))
    true_top = oof.withColumn("_r", by_y).filter(F.col("_r") <= k).select(*RUN, "row_id")
    seen_top = oof.withColumn("_r", by_p).filter(F.col("_r") <= k).select(*RUN, "row_id")
    hits = true_top.join(seen_top, [*RUN, "row_id"]).groupBy(*RUN).agg(F.count("*").alias("_h"))
    return sizes.join(hits, RUN, "left").select(*RUN, (F.coalesce("_h", F.lit(0)) / F.col("_k")).alias("precision_k"))


def spearman(oof: DataFrame) -> DataFrame:
    ranked = average_rank(average_rank(oof, RUN, "y", "_ry", "_n1"), RUN, "prediction", "_rp", "_n2")
    return ranked.groupBy(*RUN).agg(F.corr("_ry", "_rp").alias("spearman"))


def count_metrics(oof: DataFrame, k: int = 50) -> DataFrame:
    """Mean Poisson deviance, Spearman correlation and precision at k of every model and repetition."""
    deviance = oof.groupBy(*RUN).agg(F.avg(poisson_deviance(F.col("y"), F.col("prediction"))).alias("deviance"))
    return deviance.join(spearman(oof), RUN).join(precision_at_k(oof, k), RUN)


def summarize_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("model").agg(
        F.avg("deviance").alias("deviance"), F.stddev_samp("deviance").alias("deviance_sd"),
        F.avg("spearman").alias("spearman"), F.avg("precision_k").alias("precision_k"),
    )


def rank_auc(df: DataFrame, keys: Sequence[str], y: str, score: str) -> DataFrame:
    """Area under the ROC curve by mean-tie ranks; NULL when a key has one class only."""
    keys = list(keys)
    ranked = average_rank(df, keys, score, "_r", "_n")
    sums = ranked.groupBy(*keys).agg(
        F.sum(F.when(F.col(y) == 1, F.col("_r"))).alias("_s"), F.count_if(F.col(y) == 1).alias("_p"), F.count_if(F.col(y) == 0).alias("_q")
    )
    auc = (F.col("_s") - F.col("_p") * (F.col("_p") + 1) / 2) / F.nullif(F.col("_p") * F.col("_q"), F.lit(0))
    return sums.select(*keys, auc.alias("auc"))


def confusion(df: DataFrame, keys: Sequence[str], y: str, score: str, cut: float = 0.5) -> DataFrame:
    """Counts at a cut, accuracy and balanced accuracy."""
    said, real = F.col(score) >= cut, F.col(y) == 1
    out = df.groupBy(*keys).agg(
        F.count_if(said & real).alias("tp"), F.count_if(said & ~real).alias("fp"), F.count_if(~said & real).alias("fn"), F.count_if(~said & ~real).alias("tn")
    )
    tpr = F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    tnr = F.col("tn") / F.nullif(F.col("tn") + F.col("fp"), F.lit(0))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return out.withColumns({"accuracy": (F.col("tp") + F.col("tn")) / n, "balanced_accuracy": (tpr + tnr) / 2})


def error_metrics(df: DataFrame, keys: Sequence[str], y: str, prediction: str) -> DataFrame:
    e = F.col(prediction) - F.col(y)
    total = F.var_pop(y) * F.count(y)
    return df.filter(F.col(prediction).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / F.nullif(total, F.lit(0.0))).alias("r2")
    )


# --- comparisons of count models -------------------------------------------------------------------------------------
def deviance_per_row(oof: DataFrame) -> DataFrame:
    """Deviance of each row in each repetition, averaged afterwards: predictions are never averaged first."""
    d = poisson_deviance(F.col("y"), F.col("prediction"))
    return oof.withColumn("_d", d).groupBy("model", "row_id", "block").agg(F.avg("_d").alias("deviance"))


def verdict(low: Column, high: Column) -> Column:
    return F.when(high < 0, "mejora").when(low > 0, "peor").otherwise("indistinguible")


def compare_with(oof: DataFrame, reference: str, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """Every model against one: mean difference of deviance per row, block interval and verdict (negative is better)."""
    rows = deviance_per_row(oof)
    base = rows.filter(F.col("model") == reference).select("row_id", F.col("deviance").alias("_base"))
    diffs = rows.filter(F.col("model") != reference).join(base, "row_id").withColumn("diff", F.col("deviance") - F.col("_base"))
    means = diffs.groupBy("model").agg(F.avg("diff").alias("difference"))
    out = means.join(cluster_interval(diffs, ["model"], "block", replicates, seed), "model")
    return out.withColumn("verdict", verdict(F.col("ci_low"), F.col("ci_high")))


def best_of(oof: DataFrame, models: Sequence[str]) -> str:
    """The model with the lowest mean deviance among some; one name reaches the driver."""
    means = deviance_per_row(oof).filter(F.col("model").isin(*models)).groupBy("model").agg(F.avg("deviance").alias("d"))
    return means.orderBy("d", "model").first()["model"]


def decide(oof: DataFrame, candidates: Sequence[str], baselines: Sequence[str], replicates: int = 2000) -> DataFrame:
    """Candidates against the best baseline; `winner` marks the best of those that improve on it, if any."""
    reference = best_of(oof, baselines)
    wanted = oof.filter(F.col("model").isin(*candidates, reference))
    table = compare_with(wanted, reference, replicates).withColumn("reference", F.lit(reference))
    place = F.row_number().over(Window.partitionBy("reference").orderBy(F.when(F.col("verdict") == "mejora", 0).otherwise(1), "difference", "model"))
    return table.withColumn("winner", (F.col("verdict") == "mejora") & (place == 1))


def supply_gap(oof: DataFrame, model: str) -> DataFrame:
    """Expected supply, relative gap and its 10th and 90th percentile over the repetitions, per row. The repetitions of
    one row are few."""
    g = relative_gap(F.col("prediction"), F.col("y"))
    per_row = oof.filter(F.col("model") == model).withColumn("_g", g).groupBy("row_id").agg(
        F.avg("prediction").alias("esperado"), F.first("y").alias("observado"),
        F.percentile("_g", F.array(F.lit(0.1), F.lit(0.9))).alias("_q"),
    )
    return per_row.select(
        "row_id", "esperado", "observado", relative_gap(F.col("esperado"), F.col("observado")).alias("brecha_relativa"),
        F.col("_q")[0].alias("brecha_p10"), F.col("_q")[1].alias("brecha_p90"),
    )


def gap_artifact_share(rows: DataFrame, k: int) -> DataFrame:
    """Of the k rows with the largest gap, the share where the second source counts more than the map, and the same
    share among all rows with any count. `rows` has (row_id, gap, osm, fsq)."""
    more = (F.col("fsq") > F.col("osm")).cast("double")
    top = rows.orderBy(F.desc("gap"), "row_id").limit(k).agg(F.avg(more).alias("top_k"))
    return with_one_row(top, rows.filter((F.col("osm") > 0) | (F.col("fsq") > 0)).agg(F.avg(more).alias("reference")))


# --- clustered AUC ---------------------------------------------------------------------------------------------------
def _chunk_pairs(key: tuple, table: pa.Table) -> pa.Table:
    """Of a range of predictions: pairs (positive block, negative block) inside it, and positives and negatives of its blocks."""
    blocks, own = np.unique(table["block"].to_numpy(), return_inverse=True)
    values, at = np.unique(table["prediction"].to_numpy(), return_inverse=True)
    pos, neg = table["pos"].to_numpy(), table["neg"].to_numpy()
    order = np.lexsort((own, at // STEP_VALUES))
    own, at, pos, neg = own[order], at[order], pos[order], neg[order]
    pairs, upto, n = np.zeros((len(blocks), len(blocks))), np.zeros(len(blocks)), len(blocks)
    for low in range(0, len(values), STEP_VALUES):
        part = slice(*np.searchsorted(at // STEP_VALUES, (low // STEP_VALUES, low // STEP_VALUES + 1)))
        a, v, count = own[part], at[part] - low, min(STEP_VALUES, len(values) - low)
        here = np.bincount(v * n + a, neg[part], count * n).reshape(count, n)
        below = upto + here.cumsum(axis=0) - here / 2
        asked = np.flatnonzero(pos[part])
        if len(asked):
            starts = np.flatnonzero(np.r_[True, np.diff(a[asked]) > 0])
            pairs[a[asked][starts]] += np.add.reduceat(below[v[asked]] * pos[part][asked][:, None], starts, axis=0)
        upto = upto + here.sum(axis=0)
    sums = [np.bincount(own, w, n) for w in (pos, neg)]
    row = {"model": key[0], "repetition": key[1], "chunk": key[2], "blocks": blocks.astype(np.int64).tobytes(), "pos": sums[0].tobytes(), "neg": sums[1].tobytes(), "pairs": pairs.tobytes()}
    return pa.table({k: [v.as_py() if isinstance(v, pa.Scalar) else v] for k, v in row.items()}, schema=CHUNK_PAIRS)


def _run_pairs(key: tuple, table: pa.Table) -> pa.Table:
    """Pairs of a run: those inside its ranges, and each range's positives with the negatives of all ranges below."""
    rows = table.sort_by("chunk").to_pylist()
    parts = [[np.frombuffer(r[c], t) for c, t in (("blocks", np.int64), ("pos", np.float64), ("neg", np.float64), ("pairs", np.float64))] for r in rows]
    blocks = np.unique(np.concatenate([x[0] for x in parts]))
    pairs, pos, upto = np.zeros((len(blocks), len(blocks))), np.zeros(len(blocks)), np.zeros(len(blocks))
    for own, p, n, inside in parts:
        at = np.searchsorted(blocks, own)
        pairs[np.ix_(at, at)] += inside.reshape(len(own), -1)
        pairs[at] += p[:, None] * upto
        pos[at] += p
        upto[at] += n
    a, b = np.nonzero((pos > 0)[:, None] & (upto > 0))
    names = pa.array([key[0].as_py()] * len(a), pa.string())
    return pa.table([names, blocks[a], blocks[b], pairs[a, b]], names=["model", "a", "b", "_c"])


def concordance(oof: DataFrame) -> DataFrame:
    """Concordant pairs between blocks: per model, positive block a and negative block b, the number of (positive,
    negative) pairs in the right order, ties counting half, averaged over the repetitions.

    Any resampling of blocks is then a weighted sum of this table. The predictions of a run are cut into ranges, a task counts the
    pairs inside a range, and sums by block are all that ranges need of each other: no positive is repeated for every block."""
    longest = oof.groupBy(*RUN).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    ranged = value_chunks(oof, RUN, "prediction", longest // RANGE_ROWS + 2)
    values = ranged.groupBy(*RUN, "_chunk", F.col("block").cast("bigint").alias("block"), F.col("prediction").cast("double").alias("prediction")).agg(
        F.sum(F.col("y").cast("double")).alias("pos"), F.sum(1 - F.col("y").cast("double")).alias("neg")
    )
    inside = values.groupBy(*RUN, "_chunk").applyInArrow(_chunk_pairs, "model string, repetition int, chunk int, blocks binary, pos binary, neg binary, pairs binary")
    per_run = inside.groupBy(*RUN).applyInArrow(_run_pairs, "model string, a bigint, b bigint, _c double")
    runs = oof.groupBy("model").agg(F.count_distinct("repetition").alias("_runs"))
    return per_run.groupBy("model", "a", "b").agg(F.sum("_c").alias("_c")).join(runs, "model").select(
        "model", "a", "b", (F.col("_c") / F.col("_runs")).alias("pairs")
    )


def _resampled_pairs(pairs: pa.Table, draws: pa.Table) -> pa.Table:
    """Weighted sums of the pairs of each model in every replicate; a replicate weighs block a and block b."""
    blocks = np.unique(np.concatenate([pairs["a"].to_numpy(), pairs["b"].to_numpy(), draws["block"].to_numpy()]))
    replicates, row = np.unique(draws["replicate"].to_numpy(), return_inverse=True)
    weight = np.zeros((len(replicates), len(blocks)))
    weight[row, np.searchsorted(blocks, draws["block"].to_numpy())] = draws["m"].to_numpy()
    names, own = np.unique(pairs["model"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    out = []
    for i, name in enumerate(names):
        mine, table = own == i, np.zeros((len(blocks), len(blocks)))
        table[np.searchsorted(blocks, pairs["a"].to_numpy()[mine]), np.searchsorted(blocks, pairs["b"].to_numpy()[mine])] = pairs["pairs"].to_numpy()[mine]
        out.append(pa.table([pa.array([str(name)] * len(replicates)), pa.array(replicates.astype(np.int32)), ((weight @ table) * weight).sum(axis=1)], names=["model", "replicate", "_c"]))
    return pa.concat_tables(out) if out else pa.table({"model": pa.array([], pa.string()), "replicate": pa.array([], pa.int32()), "_c": pa.array([], pa.float64())})


def clustered_auc(oof: DataFrame, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """AUC of every model (replicate -1) and in every replicate of resampled blocks; replicates with one class only are
    left out."""
    rows = oof.groupBy("block").agg((F.sum("y") / F.count_distinct(*RUN)).alias("n1"), (F.sum(1 - F.col("y")) / F.count_distinct(*RUN)).alias("n0"))
    numbered = rows.withColumns({"_i": F.row_number().over(Window.orderBy("block")) - 1, "_d": F.count("*").over(Window.partitionBy())})
    draws = numbered.select("_d", F.col("_i").alias("_draw"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    draws = draws.withColumn("_i", replicate_draw(seed, F.col("replicate"), F.col("_draw"), F.col("_d"))).groupBy("replicate", "_i").agg(F.count("*").alias("m"))
    used = draws.join(numbered.select("_i", "block", "n1", "n0"), "_i").select("replicate", "block", "m", "n1", "n0")
    used = used.unionByName(rows.select(F.lit(-1).alias("replicate"), "block", F.lit(1).cast("bigint").alias("m"), "n1", "n0"))
    sizes = used.groupBy("replicate").agg(F.sum(F.col("m") * F.col("n1")).alias("_p"), F.sum(F.col("m") * F.col("n0")).alias("_q"))
    # Blocks are few, and a replicate is a weight for each: one task multiplies them with the pairs instead of joining every pair with every replicate.
    pairs, drawn = concordance(oof).withColumn("_g", F.lit(0)), used.select(F.lit(0).alias("_g"), "replicate", F.col("block").cast("bigint").alias("block"), "m")
    total = pairs.groupBy("_g").cogroup(drawn.groupBy("_g")).applyInArrow(_resampled_pairs, "model string, replicate int, _c double")
    return total.join(sizes, "replicate").filter(F.col("_p") * F.col("_q") > 0).select("model", "replicate", (F.col("_c") / (F.col("_p") * F.col("_q"))).alias("auc"))


def auc_decision(aucs: DataFrame, candidates: Sequence[str], baselines: Sequence[str], level: float = 0.975) -> DataFrame:
    """AUC with interval per model, difference from the best baseline, and whether a candidate passes: its AUC surely
    above one half and its difference surely above zero. The first baseline wins a tie."""
    rank = F.when(F.lit(False), 0)
    for i, b in enumerate(baselines):
        rank = rank.when(F.col("model") == b, i)
    best = aucs.filter((F.col("replicate") == -1) & F.col("model").isin(*baselines)).orderBy(F.desc("auc"), rank).limit(1).select(F.col("model").alias("reference"))
    base = aucs.join(best, F.col("model") == F.col("reference")).select("replicate", "reference", F.col("auc").alias("_base"))
    both = aucs.join(base, "replicate").withColumn("_d", F.col("auc") - F.col("_base"))
    tails = F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))
    drawn = F.col("replicate") >= 0
    out = both.groupBy("model", "reference").agg(
        F.max(F.when(~drawn, F.col("auc"))).alias("auc"), F.percentile(F.when(drawn, F.col("auc")), tails).alias("_q"),
        F.max(F.when(~drawn, F.col("_d"))).alias("difference"), F.percentile(F.when(drawn, F.col("_d")), tails).alias("_e"),
    )
    candidate = F.col("model").isin(*candidates)
    return out.select(
        "model", "reference", "auc", F.col("_q")[0].alias("auc_low"), F.col("_q")[1].alias("auc_high"), "difference",
        F.col("_e")[0].alias("difference_low"), F.col("_e")[1].alias("difference_high"),
        F.when(candidate, (F.col("_q")[0] > 0.5) & (F.col("_e")[0] > 0)).alias("passes"),
    )


# --- answers to phrases ----------------------------------------------------------------------------------------------
NONE = "ninguna"
TOLERANCE = 0.02
THRESHOLDS = tuple(round(0.30 + 0.05 * i, 2) for i in range(14))


def hybrid(keyword: Column, learned: Column) -> Column:
    return F.coalesce(keyword, learned)


def learned_answer(category: Column, probability: Column, threshold: Column | float) -> Column:
    """The predicted category, or no answer below the threshold or when the class says 'none'."""
    return F.when((category != NONE) & (probability >= threshold), category)


def answer_flags(answer: Column, truth: Column) -> dict[str, Column]:
    right = F.when(truth == NONE, answer.isNull()).otherwise(F.coalesce(answer == truth, F.lit(False)))
    wrong = answer.isNotNull() & (answer != truth)
    missed = answer.isNull() & (truth != NONE)
    return {"right": right.cast("double"), "wrong": wrong.cast("double"), "missed": missed.cast("double")}


def answer_summary(df: DataFrame, answer: str, truth: str, keys: Sequence[str] = ()) -> DataFrame:
    flags = answer_flags(F.col(answer), F.col(truth))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(n) for n, c in flags.items()])


def threshold_table(df: DataFrame, truth: str, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Rates of the hybrid at every threshold. `df` has (keyword, category, probability) and the truth."""
    rows = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    answer = hybrid(F.col("keyword"), learned_answer(F.col("category"), F.col("probability"), F.col("threshold")))
    return answer_summary(rows.withColumn("_answer", answer), "_answer", truth, ["threshold"])


def choose_threshold(df: DataFrame, truth: str, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """The lowest threshold whose wrong answers stay within the tolerance of the keywords alone, else the highest."""
    table = threshold_table(df, truth, thresholds)
    alone = df.agg(F.avg(answer_flags(F.col("keyword"), F.col(truth))["wrong"]).alias("_alone"))
    fits = F.when(F.col("wrong") <= F.col("_alone") + TOLERANCE, F.col("threshold"))
    return with_one_row(table, alone).agg(F.coalesce(F.min(fits), F.max("threshold")).alias("threshold"))


@F.pandas_udf(ArrayType(DoubleType()))
def resampled_means(values: pd.Series, counts: pd.Series, replicates: pd.Series, seed: pd.Series) -> pd.Series:
    """Means of bootstrap samples of a variable with few distinct values: drawing n rows again is drawing how often each
    value occurs."""
    def one(v, c, r, s):
        v, c = np.asarray(v, dtype=float), np.asarray(c, dtype=float)
        n = int(c.sum())
        return (np.random.default_rng(int(s)).multinomial(n, c / n, size=int(r)) @ v / n).tolist()

    return pd.Series([one(*x) for x in zip(values, counts, replicates, seed)])


def paired_interval(df: DataFrame, a: str, b: str, replicates: int = 5000, seed: int = 0) -> DataFrame:
    """Mean of a - b with its 95 % bootstrap interval. Both are 0/1 flags, so three counts carry everything."""
    counts = df.groupBy((F.col(a) - F.col(b)).alias("d")).agg(F.count("*").alias("c"))
    packed = counts.agg(F.sort_array(F.collect_list(F.struct("d", "c"))).alias("_p"))
    means = packed.withColumn("_m", resampled_means("_p.d", "_p.c", F.lit(replicates), F.lit(seed)))
    total = F.aggregate("_p", F.lit(0.0), lambda acc, x: acc + x["d"] * x["c"])
    n = F.aggregate("_p", F.lit(0.0), lambda acc, x: acc + x["c"])
    sorted_means = F.sort_array("_m")

    def at(p):
        place = (replicates - 1) * p
        lo, hi = int(np.floor(place)), int(np.ceil(place))
        return F.get(sorted_means, F.lit(lo)) + (F.get(sorted_means, F.lit(hi)) - F.get(sorted_means, F.lit(lo))) * (place - lo)

    return means.select((total / n).alias("difference"), at(0.025).alias("ci_low"), at(0.975).alias("ci_high"))


def adoption(df: DataFrame, truth: str, keyword: str, candidate: str, replicates: int = 5000) -> DataFrame:
    """Whether a candidate replaces the keywords: surely more right answers, and wrong ones within the tolerance."""
    k, c = answer_flags(F.col(keyword), F.col(truth)), answer_flags(F.col(candidate), F.col(truth))
    rows = df.select(k["right"].alias("_kr"), c["right"].alias("_cr"), k["wrong"].alias("_kw"), c["wrong"].alias("_cw"))
    rates = rows.agg(F.avg("_kw").alias("keyword_wrong"), F.avg("_cw").alias("candidate_wrong"))
    return with_one_row(paired_interval(rows, "_cr", "_kr", replicates), rates).withColumn(
        "adopt", (F.col("ci_low") > 0) & (F.col("candidate_wrong") <= F.col("keyword_wrong") + TOLERANCE)
    )
