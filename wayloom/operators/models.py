"""Model fits with Spark ML: travel time, high delay, corridors, cell counts, closures and phrases.

Every fit is one distributed job over all rows; loops run over repetitions and folds only."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import (
    IDF, PCA, Imputer, Normalizer, SQLTransformer, StandardScaler, StringIndexer, TargetEncoder, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from wayloom.functions import scalars as S
from wayloom.functions.taxonomy import STUDY_CATEGORIES
from wayloom.functions.text import WORDS_KEPT, gram_places, model_text
from wayloom.operators import batched as B
from wayloom.operators import evaluation as E
from wayloom.operators.chunks import dealt, spread, with_one_row
from wayloom.operators.closures import block_label
from wayloom.operators.geo import GRID, Grid, active_cells, kernel_smoothing, nearest_zone, ring_weights, scatter
from wayloom.operators.indicators import indicators
from wayloom.operators.routes import lag_means, persistence, positional_split
from wayloom.schemas import ROUTE
from wayloom.session import checkpointed

TRAVEL_FEATURES = ["hour_of_day", "day_of_week", "temperature", "humidity", "no_traffic_time_min", "travel_time_min_lag"]
MIN_EXPECTED = 1e-3
ENSEMBLE_WEIGHTS = {"random_forest": 0.5, "gradient_boosting": 0.5}
CELL = ["fila", "col"]
FITS_AT_ONCE = 8
SPARSE = 0
SLOTS = 1 << 18
SPACES = re.compile(r"[ \t\n\x0b\f\r]+")
RINGS = ("celda", "anillo1", "anillo2")


def route_stages(label: str) -> list:
    """Stages that give each route the mean of `label` over its rows of the fit data, so any number of routes will do; an
    unseen route gets the overall mean."""
    return [
        StringIndexer(inputCol="route", outputCol="_route", handleInvalid="keep"),
        TargetEncoder(inputCols=["_route"], outputCols=["_route_mean"], labelCol=label, targetType="continuous", handleInvalid="keep"),
        SQLTransformer(statement="SELECT *, _route_mean + 0D AS _route_value FROM __THIS__"),  # a plain number, no category
        VectorAssembler(inputCols=[*TRAVEL_FEATURES, "_route_value"], outputCol="features"),
    ]


# --- travel time -----------------------------------------------------------------------------------------------------
def travel_features(df: DataFrame) -> DataFrame:
    """Features known before the measurement: calendar, weather, no-traffic time and the mean of the rows before."""
    rows = lag_means(df)
    zero = F.lit(0.0)
    return rows.filter(F.col("travel_time_min").isNotNull()).select(
        "id", "timestamp", *ROUTE, "data_source", "travel_time_min",
        F.hour("timestamp").cast("double").alias("hour_of_day"), S.weekday0(F.col("timestamp")).cast("double").alias("day_of_week"),
        F.coalesce("origin_temperature", zero).alias("temperature"), F.coalesce("origin_humidity", zero).alias("humidity"),
        F.coalesce("no_traffic_time_min", zero).alias("no_traffic_time_min"), F.coalesce("recent_avg", zero).alias("travel_time_min_lag"),
        S.route_label(F.col("origin"), F.col("destination")).alias("route"),
    )


def fit_travel_time(features: DataFrame, trees: int = 50, depth: int = 10) -> PipelineModel:
    """One forest for all routes, the route being a feature."""
    forest = RandomForestRegressor(labelCol="travel_time_min", numTrees=trees, maxDepth=depth, seed=42)
    return Pipeline(stages=[*route_stages("travel_time_min"), forest]).fit(features)


def predict_travel_time(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Prediction and confidence min(100, 50 + 50 · no-traffic / prediction)."""
    p = F.col("prediction")
    confidence = F.least(F.lit(100.0), 50 + F.col("no_traffic_time_min") / F.nullif(p, F.lit(0.0)) * 50)
    out = model.transform(features)
    return out.select("id", "timestamp", *ROUTE, "travel_time_min", F.round(p, 2).alias("prediction"), F.round(confidence, 1).alias("confidence"))


def route_model_status(features: DataFrame, min_samples: int = 50) -> DataFrame:
    """Routes with enough rows to be trained on, and the others."""
    return features.groupBy(*ROUTE).agg(F.count("*").alias("samples")).withColumn("trained", F.col("samples") >= min_samples)


def trainable(features: DataFrame, min_samples: int = 50) -> DataFrame:
    return features.join(route_model_status(features, min_samples).filter("trained").select(*ROUTE), ROUTE, "left_semi")


def importances(model: PipelineModel, spark) -> DataFrame:
    """Importance of each feature: one short vector that the fitted model holds."""
    values = [float(v) for v in model.stages[-1].featureImportances.toArray()]
    return spark.createDataFrame(list(zip([*TRAVEL_FEATURES, "route"], values)), "feature string, importance double")


def evaluate_travel_time(df: DataFrame, trees: int = 50, depth: int = 10) -> DataFrame:
    """Per route, on the newest 20 %: mean absolute error of the forest, of the training mean, of the last value of the
    same source and of the no-traffic time; and whether the forest beats the last value."""
    known = df.filter(F.col("travel_time_min").isNotNull())
    features = checkpointed(positional_split(travel_features(df), ROUTE).join(
        persistence(known).select("id", "previous"), "id").join(known.select("id", F.col("no_traffic_time_min").alias("free")), "id"))
    train, test = features.filter("part = 'train'"), features.filter("part = 'test'")
    means = train.groupBy(*ROUTE).agg(F.avg("travel_time_min").alias("_mean"))
    scored = fit_travel_time(train, trees, depth).transform(test).join(means, ROUTE)
    y = F.col("travel_time_min")

    def mae(column):
        return F.avg(F.abs(F.col(column) - y))

    out = scored.groupBy(*ROUTE).agg(
        F.count("*").alias("n"), mae("prediction").alias("model"), mae("_mean").alias("train_mean"), mae("previous").alias("last_same_source"), mae("free").alias("no_traffic")
    )
    return out.withColumn("beats_last", F.col("model") < F.col("last_same_source"))


def travel_time_verdict(evaluation: DataFrame) -> DataFrame:
    """Unweighted means over the routes and on how many of them the model wins."""
    columns = ("model", "train_mean", "last_same_source", "no_traffic")
    return evaluation.agg(*[F.avg(c).alias(c) for c in columns], F.count_if("beats_last").alias("wins"), F.count("*").alias("routes")).withColumn(
        "improves", F.col("model") < F.col("last_same_source")
    )


# --- ensemble --------------------------------------------------------------------------------------------------------
def fit_ensemble(features: DataFrame, trees: int = 100, rounds: int = 100) -> dict[str, PipelineModel]:
    front = route_stages("travel_time_min")
    models = {
        "random_forest": RandomForestRegressor(labelCol="travel_time_min", numTrees=trees, maxDepth=12, seed=42),
        "gradient_boosting": GBTRegressor(labelCol="travel_time_min", maxIter=rounds, maxDepth=5, stepSize=0.1, seed=42),
    }
    return {name: Pipeline(stages=[*front, stage]).fit(features) for name, stage in models.items()}


def ensemble_predictions(models: dict[str, PipelineModel], features: DataFrame) -> DataFrame:
    """Weighted prediction with 80 % and 95 % bands from the spread of the models; weights rescale over those present."""
    out = features
    for name, model in models.items():
        scored = model.transform(out)
        out = scored.select(*out.columns, F.col("prediction").alias(f"p_{name}"))
    total = sum(ENSEMBLE_WEIGHTS[n] for n in models)
    mean = reduce(lambda a, b: a + b, [F.col(f"p_{n}") * (ENSEMBLE_WEIGHTS[n] / total) for n in models])
    values = F.array(*[F.col(f"p_{n}") for n in models])
    centre = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / len(models)
    spread = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - centre) * (x - centre)) / len(models))
    out = out.withColumns({"ensemble": mean, "spread": spread})
    bands = {f"{side}_{level}": F.col("ensemble") + sign * z * F.col("spread") for level, z in ((80, 1.28), (95, 1.96)) for side, sign in (("lower", -1), ("upper", 1))}
    return out.withColumns(bands)


def evaluate_ensemble(df: DataFrame, trees: int = 100, rounds: int = 100) -> DataFrame:
    """MAE and R² of each model, the ensemble and two references on the newest 20 % that have an earlier value of their
    source."""
    known = df.filter(F.col("travel_time_min").isNotNull())
    features = checkpointed(positional_split(travel_features(df), ROUTE).join(persistence(known).select("id", "previous"), "id"))
    train = features.filter("part = 'train'")
    test = features.filter("part = 'test' AND previous IS NOT NULL")
    mean = train.groupBy(*ROUTE).agg(F.avg("travel_time_min").alias("train_mean"))
    scored = ensemble_predictions(fit_ensemble(train, trees, rounds), test).join(mean, ROUTE)
    names = ["p_random_forest", "p_gradient_boosting", "ensemble", "train_mean", "previous"]
    long = scored.unpivot(["id", "travel_time_min"], names, "model", "prediction")
    return E.error_metrics(long, ["model"], "travel_time_min", "prediction")


# --- high delay, regression, corridors -------------------------------------------------------------------------------
NUMBERS = ["distance_km", "origin_temperature", "origin_humidity", "destination_temperature", "destination_humidity"]
GROUPS = [*ROUTE, "data_source", "origin_weather_grp", "destination_weather_grp"]
CALENDAR = ["hora_sin", "hora_cos", "dia_semana", "es_finde"]


def modelling_frame(df: DataFrame) -> DataFrame:
    """Complete rows with calendar, weather groups and the two targets."""
    hour = F.hour("timestamp")
    sin, cos = S.cyclic_hour(hour)
    day = S.weekday0(F.col("timestamp"))
    rows = df.select(
        "id", "timestamp", *ROUTE, "data_source", *NUMBERS, "travel_time_min",
        S.weather_group(F.col("origin_weather")).alias("origin_weather_grp"), S.weather_group(F.col("destination_weather")).alias("destination_weather_grp"),
        sin.alias("hora_sin"), cos.alias("hora_cos"), (day + 1).cast("double").alias("dia_semana"), S.is_weekend(day).cast("double").alias("es_finde"),
        (F.col("travel_time_min") > S.HIGH_DELAY_OVER_MIN).cast("double").alias("high"),
    )
    return rows.na.drop(subset=[*NUMBERS, "origin_weather_grp", "destination_weather_grp", "travel_time_min"])


def design_stages(train: DataFrame) -> list:
    return [
        *indicators(GROUPS, train),
        VectorAssembler(inputCols=NUMBERS, outputCol="_numbers"),
        StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True),
        VectorAssembler(inputCols=["_scaled", *[f"_o_{c}" for c in GROUPS], *CALENDAR], outputCol="features"),
    ]


def fit_high_delay(train: DataFrame, trees: int = 100, subsets: Sequence[str] = ("sqrt", "log2", "0.3", "0.5"), folds: int = 5) -> tuple[PipelineModel, PipelineModel, str]:
    """Logistic model and the forest whose feature share does best on later rows: time-ordered folds train on the past
    and validate on what follows."""
    logistic = Pipeline(stages=[*design_stages(train), LogisticRegression(labelCol="high", maxIter=100)]).fit(train)
    cuts = train.select(F.percentile_approx(F.unix_micros(F.col("timestamp").cast("timestamp")), [i / (folds + 1) for i in range(1, folds + 1)], 10000).alias("c")).first()["c"]
    stamped = train.withColumn("_us", F.unix_micros(F.col("timestamp").cast("timestamp")))

    def forest(subset, data):
        return RandomForestClassifier(labelCol="high", numTrees=trees, featureSubsetStrategy=subset, maxDepth=10, seed=42, maxMemoryInMB=1024).fit(data)

    def prepared(i):
        """Training rows before a cut and the rows up to the next one, with the features the four subsets share."""
        upper = cuts[i + 1] if i + 1 < len(cuts) else None
        past = stamped.filter(F.col("_us") < cuts[i])
        later = stamped.filter(F.col("_us") >= cuts[i]) if upper is None else stamped.filter((F.col("_us") >= cuts[i]) & (F.col("_us") < upper))
        design = Pipeline(stages=design_stages(past)).fit(past)
        return [checkpointed(design.transform(part).select("features", "high")) for part in (past, later)]

    def score(task):
        subset, (past, later) = task
        return E.rank_auc(probability(forest(subset, past).transform(later)), [], "high", "p").first()["auc"] or 0.0

    def chosen():
        # The fits of the grid are separate jobs: several at a time fill the cluster where one leaves cores idle between passes.
        with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
            parts = list(pool.map(inheritable_thread_target(train.sparkSession)(prepared), range(len(cuts))))
            tasks = [(subset, part) for subset in subsets for part in parts]
            found = list(pool.map(inheritable_thread_target(train.sparkSession)(score), tasks))
        totals = {subset: sum(auc for (own, _), auc in zip(tasks, found, strict=True) if own == subset) for subset in subsets}
        return max(subsets, key=totals.get)

    best = subsets[0] if len(subsets) == 1 else chosen()
    design = Pipeline(stages=design_stages(train)).fit(train)
    return logistic, PipelineModel(stages=[*design.stages, forest(best, design.transform(train))]), best


def probability(scored: DataFrame) -> DataFrame:
    return scored.withColumn("p", vector_to_array("probability")[1])


def evaluate_high_delay(df: DataFrame, split: Callable[[DataFrame], DataFrame], trees: int = 100, subsets: Sequence[str] = ("sqrt", "log2", "0.3", "0.5")) -> DataFrame:
    """AUC, accuracy and confusion counts of both classifiers on the later rows."""
    rows = dealt(split(modelling_frame(df)))
    logistic, forest, _ = fit_high_delay(rows.filter("part = 'train'"), trees, subsets)
    test = rows.filter("part = 'test'")
    both = None
    for name, model in (("logistic", logistic), ("forest", forest)):
        scored = probability(model.transform(test)).select(F.lit(name).alias("model"), "id", "high", "p")
        both = scored if both is None else both.unionByName(scored)
    return E.rank_auc(both, ["model"], "high", "p").join(E.confusion(both, ["model"], "high", "p"), "model")


def evaluate_regression(df: DataFrame, split: Callable[[DataFrame], DataFrame], rounds: int = 250) -> DataFrame:
    """RMSE, MAE and R² of a linear model and of boosted trees on the later rows."""
    rows = dealt(split(modelling_frame(df)))
    train, test = rows.filter("part = 'train'"), rows.filter("part = 'test'")
    design = Pipeline(stages=design_stages(train)).fit(train)
    train, test = (design.transform(part).select("travel_time_min", "features") for part in (train, test))
    both = None
    for name, stage in (
        ("linear", LinearRegression(labelCol="travel_time_min", regParam=1e-6)),
        ("boosting", GBTRegressor(labelCol="travel_time_min", maxIter=rounds, maxDepth=4, seed=42)),
    ):
        scored = stage.fit(train).transform(test).select(F.lit(name).alias("model"), "travel_time_min", "prediction")
        both = scored if both is None else both.unionByName(scored)
    return E.error_metrics(both, ["model"], "travel_time_min", "prediction")


def corridor_clusters(corridors: DataFrame, k: int = 4, elbow_to: int = 0) -> tuple[DataFrame, list[tuple[int, float]]]:
    """Cluster and two main coordinates of each corridor, and the cost for each number of clusters up to `elbow_to`."""
    columns = ["distance", "duration", "speed", "high_delay_share"]
    front = Pipeline(stages=[
        VectorAssembler(inputCols=columns, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True),
        PCA(k=2, inputCol="features", outputCol="_pc"),
    ]).fit(corridors.na.drop(subset=columns))
    scaled = front.transform(corridors.na.drop(subset=columns))
    parts = vector_to_array("features")
    single = scaled.agg(F.count("*").alias("n"), *[F.var_pop(parts[i]).alias(f"v{i}") for i in range(len(columns))]).first() if elbow_to else None
    costs = [(1, single["n"] * sum(single[f"v{i}"] or 0.0 for i in range(len(columns))))] if elbow_to else []
    costs += [(n, KMeans(k=n, seed=42).fit(scaled).summary.trainingCost) for n in range(2, elbow_to + 1)]
    labelled = KMeans(k=k, seed=42).fit(scaled).transform(scaled)
    pc = vector_to_array("_pc")
    return labelled.select(*ROUTE, *columns, "n", F.col("prediction").alias("cluster"), pc[0].alias("pc1"), pc[1].alias("pc2")), costs


# --- cell counts -----------------------------------------------------------------------------------------------------
def cell_features(counts: DataFrame, target: str, zones: DataFrame, categories: Sequence[str] = STUDY_CATEGORIES, grid: Grid = GRID) -> DataFrame:
    """Per active cell: counts of every category in the cell and its two rings without the target, distance to the
    nearest zone, smoothed zone values (columns of `zones` beyond its position), and the target count `y`."""
    kept = counts.filter(F.col("category").isin(*categories) & (F.col("category") != target))
    per_category = kept.groupBy("category", *CELL).agg(F.sum("n").alias("n"))
    rings = None
    for i, name in enumerate(RINGS):
        one = scatter(per_category, ["category"], "n", ring_weights(i), grid).withColumn("_f", F.concat_ws("_", "category", F.lit(name)))
        rings = one if rings is None else rings.unionByName(one)
    names = [f"{c}_{r}" for c in categories for r in RINGS]
    wide = rings.groupBy(*CELL).pivot("_f", names).agg(F.sum("v"))
    values = [c for c in zones.columns if c not in ("zone", "zone_order", "zone_lat", "zone_lon")]
    y = counts.filter(F.col("category") == target).groupBy(*CELL).agg(F.sum("n").cast("double").alias("y"))
    out = active_cells(counts, grid).select(*CELL).join(wide, CELL, "left").join(nearest_zone(zones, grid).select(*CELL, F.col("dist_zona_m").alias("dist_centro_m")), CELL)
    if values:
        out = out.join(kernel_smoothing(zones, values, grid=grid), CELL, "left")
    return out.join(y, CELL, "left").na.fill(0.0, [*names, "y"]).withColumn("row_id", F.col("fila") * 1000 + F.col("col"))


def density_columns(features: DataFrame) -> dict[str, Column]:
    """log(1 + POIs) of the cell and of each ring."""
    return {
        f"densidad_{r}": F.log1p(reduce(lambda a, b: a + b, [F.col(c) for c in features.columns if c.endswith(f"_{r}")])) for r in RINGS
    }


def fit_counts(name: str, train: DataFrame, test: DataFrame, seed: int = 0, rounds: int = 200) -> DataFrame:
    """Expected count of each test cell by one model: mean, density, distance, population or boosting."""
    inputs = {
        "solo_distancia": ["dist_centro_m"],
        "solo_poblacion": [c for c in train.columns if c.startswith("pob")],
        "solo_densidad": [f"densidad_{r}" for r in RINGS],
        "boosting": [c for c in train.columns if c.endswith(tuple(f"_{r}" for r in RINGS)) and not c.startswith("densidad")] + ["dist_centro_m"] + [c for c in train.columns if c.endswith("_suavizada") or c.endswith("_suavizado")],
    }
    if name == "media":
        scored = with_one_row(test, train.agg(F.avg("y").alias("prediction")))
    elif name == "boosting":
        stages = [Imputer(strategy="median", inputCols=inputs[name], outputCols=[f"_m_{c}" for c in inputs[name]]),
                  VectorAssembler(inputCols=[f"_m_{c}" for c in inputs[name]], outputCol="features"),
                  GBTRegressor(labelCol="_log", maxIter=rounds, maxDepth=3, stepSize=0.05, minInstancesPerNode=20, seed=seed)]
        model = Pipeline(stages=stages).fit(train.withColumn("_log", F.log1p("y")))
        scored = model.transform(test).withColumn("prediction", F.expm1("prediction"))
    else:
        stages = [Imputer(strategy="median", inputCols=inputs[name], outputCols=[f"_m_{c}" for c in inputs[name]]),
                  VectorAssembler(inputCols=[f"_m_{c}" for c in inputs[name]], outputCol="_raw"),
                  StandardScaler(inputCol="_raw", outputCol="features", withMean=True),
                  GeneralizedLinearRegression(labelCol="y", family="poisson", link="log", regParam=1e-3, maxIter=50)]
        scored = Pipeline(stages=stages).fit(train).transform(test)
    return scored.select("row_id", "y", "block", F.greatest("prediction", F.lit(MIN_EXPECTED)).alias("prediction"))


COUNT_BASELINES = ("media", "solo_distancia", "solo_poblacion", "solo_densidad")
COUNT_ROUNDS = 200


def count_columns(features: DataFrame) -> list[str]:
    """Columns of the boosted model: every category in the cell and its rings, the distance, smoothed zone values."""
    own = [c for c in features.columns if c.endswith(tuple(f"_{r}" for r in RINGS)) and not c.startswith("densidad")]
    return [*own, "dist_centro_m", *[c for c in features.columns if c.endswith(("_suavizada", "_suavizado"))]]


def cross_validate_counts(features: DataFrame, models: Sequence[str], repeats: int = 10, folds: int = 5, seed: int = 0, rounds: int = COUNT_ROUNDS) -> DataFrame:
    """Out-of-sample predictions of every model in every repetition of spatial block folds, all folds in shared passes: the
    mean, Poisson regressions on distance, population or density, and Poisson boosting. A model whose columns are not there
    predicts the mean."""
    rows = features.withColumns(density_columns(features)).withColumn("block", block_label(F.col("fila"), F.col("col"))).withColumn("row_id", F.col("row_id").cast("string"))
    boosted = count_columns(features)
    inputs = {"solo_distancia": ["dist_centro_m"], "solo_poblacion": [c for c in features.columns if c.startswith("pob")], "solo_densidad": [f"densidad_{r}" for r in RINGS]}
    linear = {m: B.Linear(inputs[m]) for m in models if inputs.get(m)}
    rows = checkpointed(B.dealt_folds(rows, repeats, folds, seed))
    used = sorted({c for spec in linear.values() for c in spec.columns})
    parts = [B.scored_means(rows, m) for m in models if m != "boosting" and m not in linear]
    if linear:
        parts.append(B.scored_linear(checkpointed(B.filled(rows.select("row_id", "y", "block", "folds", *used), used)), linear, repeats, folds))
    if "boosting" in models:
        parts.append(B.scored_boosting(rows, "boosting", B.Boosting(boosted, rounds=rounds), repeats, folds, seed))
    return reduce(DataFrame.unionByName, parts).withColumns({"row_id": F.col("row_id").cast("long"), "prediction": F.greatest("prediction", F.lit(MIN_EXPECTED))})


def bootstrap_ensemble(features: DataFrame, name: str, times: int = 10, seed: int = 0) -> DataFrame:
    """Mean, deviation and 10th / 90th percentile of the predictions of models fitted on resampled rows."""
    rows = checkpointed(features.withColumns(density_columns(features)).withColumn("block", block_label(F.col("fila"), F.col("col"))))
    runs = [
        fit_counts(name, rows.sample(withReplacement=True, fraction=1.0, seed=seed + i), rows, seed + i).withColumn("run", F.lit(i)) for i in range(times)
    ]
    long = reduce(DataFrame.unionByName, runs)
    q = F.percentile("prediction", F.array(F.lit(0.1), F.lit(0.9)))
    return long.groupBy("row_id").agg(F.avg("prediction").alias("esperado"), F.stddev_samp("prediction").alias("desv"), q.alias("_q")).select(
        "row_id", "esperado", "desv", F.col("_q")[0].alias("p10"), F.col("_q")[1].alias("p90")
    )


def target_study(features: DataFrame, candidates: Sequence[str], baselines: Sequence[str], repeats: int = 10, folds: int = 5, replicates: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Decision table of a target, and the supply gap by its winner (by the best candidate when none wins)."""
    oof = checkpointed(cross_validate_counts(features, [*baselines, *candidates], repeats, folds))
    table = E.decide(oof, candidates, baselines, replicates)
    return table, E.supply_gap(oof, E.best_of(oof, candidates))


# --- closures --------------------------------------------------------------------------------------------------------
CLOSURE_MODELS = ("logistica", "boosting", "solo_categoria", "solo_densidad")
DENSITIES = ["n_same_250", "n_total_250", "n_same_500", "n_total_500"]
ONE_HOT = [f"cat_{c}" for c in STUDY_CATEGORIES]


def cross_validate_closures(frame: DataFrame, models: Sequence[str] = CLOSURE_MODELS, repeats: int = 10, folds: int = 5, seed: int = 0, rounds: int = 150) -> DataFrame:
    """Out-of-sample closure probabilities over spatial block folds, all folds in shared passes: logistic regressions on all
    columns and on densities, boosting, and the closure rate of the category."""
    rows = frame.withColumn("block", block_label(F.col("fila"), F.col("col"))).withColumn("row_id", F.concat_ws(":", "type", F.col("id").cast("string")))
    logs = {f"log_{c}": F.log1p(c) for c in DENSITIES}
    rows = checkpointed(B.dealt_folds(rows.withColumns(logs).withColumn("y", F.col("y").cast("double")), repeats, folds, seed))
    every = {
        "logistica": B.Linear([*DENSITIES, "dist_m"], [*ONE_HOT, "chain"], "logistic", 1.0, False),
        "solo_densidad": B.Linear(list(logs), [], "logistic", 1.0, False),
    }
    linear = {m: every[m] for m in models if m in every}
    parts = [B.scored_means(rows, m, ["category"]) for m in models if m == "solo_categoria"]
    if linear:
        parts.append(B.scored_linear(rows, linear, repeats, folds))
    if "boosting" in models:
        settings = B.Boosting([*ONE_HOT, *DENSITIES, "dist_m", "chain"], "logistic", rounds, depth=2, rate=0.05, leaf=10, ridge=0.0, subsample=0.8)
        parts.append(B.scored_boosting(rows, "boosting", settings, repeats, folds, seed))
    return reduce(DataFrame.unionByName, parts)


STUDY = "model string, reference string, auc double, auc_low double, auc_high double, difference double, difference_low double, difference_high double, passes boolean"


def closure_study(frame: DataFrame, gate: DataFrame, repeats: int = 10, folds: int = 5, replicates: int = 1000) -> DataFrame:
    """The decision table of a label; no rows when the sample gate is closed: then nothing is trained."""
    if not gate.first()["passes"]:
        return frame.sparkSession.createDataFrame([], STUDY)
    oof = checkpointed(cross_validate_closures(frame, repeats=repeats, folds=folds))
    return E.auc_decision(E.clustered_auc(oof, replicates), ["logistica", "boosting"], ["solo_categoria", "solo_densidad"])



# --- phrases ---------------------------------------------------------------------------------------------------------
def counted(phrases: DataFrame, text: str, low: int = 2, high: int = 5, slots: int = SLOTS) -> DataFrame:
    """Damped counts (1 + log) of character n-grams inside words, as sparse vectors. Every n-gram counts: it is hashed to one of
    `slots` places, so no vocabulary is kept and none is left out. Words repeat within texts and among them: a task hashes the
    n-grams of a word once while it keeps it, and a text adds up the places of its words."""
    rows = spread(phrases).withColumn("_text", model_text(F.col(text)))
    schema = StructType([*phrases.schema.fields, StructField("_ltf", VectorUDT())])
    kept = phrases.columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            texts = [SPACES.split(x or "") for x in batch.column("_text").to_pylist()]
            new = list({w for words in texts for w in words if w and w not in known})
            if len(known) + len(new) > WORDS_KEPT:
                known = {}
                new = list({w for words in texts for w in words if w})
            known.update(zip(new, gram_places(new, low, high, slots)) if new else ())
            found = [np.unique(np.concatenate([known[w] for w in words if w] or [np.zeros(0, np.int32)]), return_counts=True) for words in texts]
            ends = pa.array(np.r_[0, np.cumsum([len(i) for i, _ in found])].astype(np.int32))
            vectors = pa.StructArray.from_arrays([
                pa.array(np.full(len(texts), SPARSE, np.int8)), pa.array(np.full(len(texts), slots, np.int32)),
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate([i for i, _ in found]).astype(np.int32))),
                pa.ListArray.from_arrays(ends, pa.array(1.0 + np.log(np.concatenate([c for _, c in found])))),
            ], ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), vectors], [*kept, "_ltf"])

    return rows.mapInArrow(add, schema)


def vectorise(fitted, df: DataFrame, text: str, low: int = 2, high: int = 5) -> DataFrame:
    slots, idf, places = fitted
    return used_only(weighted(idf, counted(df, text, low, high, slots)).select(*df.columns, "features"), places, slots)


def weighted(idf, damped: DataFrame) -> DataFrame:
    return Normalizer(inputCol="_tfidf", outputCol="features", p=2.0).transform(idf.transform(damped))


def used_only(df: DataFrame, places: np.ndarray, slots: int) -> DataFrame:
    """Features at the places that the fit has seen, numbered anew. Elsewhere its coefficients are zero, and an iteration would send and
    add up all of those for every part of the rows."""
    number = np.full(slots, -1, np.int32)
    number[places] = np.arange(len(places), dtype=np.int32)
    names = df.columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column("features")
            indices, values = f.field("indices"), f.field("values")
            at = number[indices.flatten().to_numpy()]
            known = at >= 0
            row = np.repeat(np.arange(len(f)), indices.value_lengths().to_numpy())
            ends = pa.array(np.r_[0, np.cumsum(np.bincount(row[known], minlength=len(f)))].astype(np.int32))
            kept = pa.StructArray.from_arrays([
                pa.array(np.full(len(f), SPARSE, np.int8)), pa.array(np.full(len(f), len(places), np.int32)),
                pa.ListArray.from_arrays(ends, pa.array(at[known])), pa.ListArray.from_arrays(ends, pa.array(values.flatten().to_numpy()[known])),
            ], ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([kept if c == "features" else batch.column(c) for c in names], names)

    return df.mapInArrow(add, df.schema)


def fit_phrases(train: DataFrame, text: str, label: str, c: float = 10.0, low: int = 2, high: int = 5, slots: int = SLOTS):
    """Multinomial logistic model with balanced class weights on the weighted n-grams. Texts are cut once, on all cores; the
    weighting and the iterations read the written counts."""
    damped = checkpointed(counted(train.select(label, text), text, low, high, slots))
    idf = IDF(inputCol="_ltf", outputCol="_tfidf").fit(damped)
    sizes = train.groupBy(label).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_total"), F.count("*").alias("_k"))
    weight = F.when(F.col(label).isNotNull(), F.struct(label, F.col("_total") / (F.col("_k") * F.col("_n"))))
    weights = with_one_row(sizes, total).select(F.map_from_entries(F.collect_list(weight)).alias("_weights"))
    places = np.flatnonzero(np.asarray(idf.docFreq))
    rows = used_only(weighted(idf, damped).select(label, "features"), places, slots)
    # No join: labels are few, and rows exchanged by label would meet in as few parts, which every iteration goes through.
    rows = with_one_row(rows.filter(F.col(label).isNotNull()), weights).withColumn("_w", F.col("_weights")[F.col(label)]).drop("_weights")
    n = train.count()
    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(rows)
    model = LogisticRegression(labelCol="_label", weightCol="_w", family="multinomial", regParam=1.0 / (c * max(n, 1)), standardization=False, maxIter=100).fit(index.transform(rows))
    return (slots, idf, places), index.labels, model


def classify_phrases(model, df: DataFrame, text: str, low: int = 2, high: int = 5) -> DataFrame:
    """Adds the most probable category and its probability; an empty text gets no category."""
    fitted, labels, logistic = model
    scored = logistic.transform(vectorise(fitted, df, text, low, high))
    p = vector_to_array("probability")
    best = F.array_max(p)
    label = F.get(F.array(*[F.lit(x) for x in labels]), F.array_position(p, best).cast("int") - 1)
    empty = F.trim(text) == ""
    return scored.select(*df.columns, F.when(~empty, label).alias("category"), F.when(empty, 0.0).otherwise(best).alias("probability"))


def out_of_fold_phrases(df: DataFrame, text: str, label: str, ident: str, folds: int = 5, **fit) -> DataFrame:
    """Category and probability of each phrase by a model that has not seen it."""
    dealt = checkpointed(E.stratified_folds(df, label, ident, folds))
    parts = []
    for f in range(folds):
        model = fit_phrases(dealt.filter(F.col("fold") != f), text, label, **fit)
        grams = {k: v for k, v in fit.items() if k in ("low", "high")}
        parts.append(classify_phrases(model, dealt.filter(F.col("fold") == f), text, **grams))
    return reduce(DataFrame.unionByName, parts)
