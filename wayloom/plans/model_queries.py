"""Queries over model fits, out-of-sample evaluation and phrase classification."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from wayloom.functions import scalars as S
from wayloom.functions import text as X
from wayloom.operators import closures as K
from wayloom.operators import evaluation as E
from wayloom.operators import geo as G
from wayloom.operators import models as O
from wayloom.operators import routes as R
from wayloom.plans import common as C
from wayloom.plans.common import MEASUREMENTS, measurements, r6, shown, table, with_tables
from wayloom.plans.place_queries import counts
from wayloom.plans.study_queries import CL, snapshots
from wayloom.plans.table_queries import GOODS
from wayloom.schemas import ROUTE
from wayloom.session import checkpointed

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, build: Callable, oracle: str | None = None) -> None:
    QUERIES[name] = build
    if oracle is not None:
        ORACLE[name] = oracle


def rounded(df, *columns, digits=6):
    return df.withColumns({c: shown(F.col(c), digits) for c in columns})


# --- out-of-sample tables --------------------------------------------------------------------------------------------
def order_predictions(spark, sf):
    """Orders per customer against two guesses, in two repetitions; the nation is the block."""
    c = table(spark, sf, "customer")
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").cast("double").alias("y"))
    rows = c.join(n, "c_custkey", "left").na.fill(0.0, ["y"])
    both = rows.withColumn("m", F.explode(F.array(
        F.struct(F.lit("wealth").alias("model"), (F.abs("c_acctbal") / 500 + 1).alias("prediction")),
        F.struct(F.lit("size").alias("model"), (F.length("c_mktsegment") * 1.0).alias("prediction"))))).withColumn("repetition", F.explode(F.array(F.lit(0), F.lit(1))))
    return both.select("m.model", "repetition", F.col("c_custkey").alias("row_id"), "y", F.round(F.col("m.prediction") + F.col("repetition") * 0.5, 6).alias("prediction"), F.col("c_nationkey").cast("bigint").alias("block"))


OOF = """oof AS (SELECT model, repetition, c_custkey AS row_id, coalesce(n, 0)::DOUBLE AS y, round(CASE model WHEN 'wealth' THEN abs(c_acctbal) / 500 + 1 ELSE length(c_mktsegment)::DOUBLE END + repetition * 0.5e0, 6) AS prediction,
  c_nationkey::BIGINT AS block FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey,
  (SELECT unnest(['wealth', 'size']) AS model), (SELECT unnest([0, 1]) AS repetition)),
dev AS (SELECT *, CASE WHEN y > 0 THEN 2 * (y * ln(y / prediction) - (y - prediction)) ELSE 2 * prediction END AS d FROM oof)"""
register("count_model_metrics", lambda spark, sf: rounded(E.count_metrics(order_predictions(spark, sf), 50), "deviance", "spearman", "precision_k"),
         with_tables(OOF) + f""", r AS (SELECT *, rank() OVER (w ORDER BY y) + (count(*) OVER (PARTITION BY model, repetition, y) - 1) / 2e0 AS ry, rank() OVER (w ORDER BY prediction) + (count(*) OVER (PARTITION BY model, repetition, prediction) - 1) / 2e0 AS rp,
           row_number() OVER (w ORDER BY y DESC, row_id) AS ty, row_number() OVER (w ORDER BY prediction DESC, row_id) AS tp FROM dev WINDOW w AS (PARTITION BY model, repetition))
         SELECT model, repetition, {r6("avg(d)")} AS deviance, {r6("corr(ry, rp)")} AS spearman, {r6("count(*) FILTER (ty <= 50 AND tp <= 50) / 50e0")} AS precision_k FROM r GROUP BY 1, 2""")
register("count_model_summary", lambda spark, sf: rounded(E.summarize_metrics(E.count_metrics(order_predictions(spark, sf), 50)).select("model", "deviance", "deviance_sd"), "deviance", "deviance_sd"),
         with_tables(OOF) + f"SELECT model, {r6('avg(d)')} AS deviance, {r6('stddev_samp(d)')} AS deviance_sd FROM (SELECT model, repetition, avg(d) AS d FROM dev GROUP BY 1, 2) GROUP BY 1")
register("count_model_comparison", lambda spark, sf: rounded(E.compare_with(order_predictions(spark, sf), "size", 2000), "difference", "ci_low", "ci_high"),
         with_tables(OOF) + f""", p AS (SELECT model, row_id, block, avg(d) AS d FROM dev GROUP BY ALL), f AS (SELECT a.row_id, a.block, a.d - b.d AS diff FROM p a JOIN p b USING (row_id) WHERE a.model = 'wealth' AND b.model = 'size'),
         s AS (SELECT block, sum(diff) AS s, count(*) AS n, row_number() OVER (ORDER BY block) - 1 AS i, count(*) OVER () AS k FROM f GROUP BY 1),
         b AS (SELECT rep, CAST('0x' || substr(md5('0:' || rep || ':' || i), 1, 8) AS BIGINT) % k AS i FROM s, range(0, 2000) t(rep)), m AS (SELECT rep, sum(s) / sum(n) AS m FROM b JOIN s USING (i) GROUP BY 1),
         q AS (SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m)
         SELECT 'wealth' AS model, {r6("(SELECT avg(diff) FROM f)")} AS difference, {r6("lo")} AS ci_low, {r6("hi")} AS ci_high, CASE WHEN hi < 0 THEN 'mejora' WHEN lo > 0 THEN 'peor' ELSE 'indistinguible' END AS verdict FROM q""")
register("count_model_decision", lambda spark, sf: E.decide(order_predictions(spark, sf), ["size"], ["wealth"], 2000))
register("supply_gap", lambda spark, sf: rounded(E.supply_gap(order_predictions(spark, sf), "wealth"), "esperado", "brecha_relativa", "brecha_p10", "brecha_p90"),
         with_tables(OOF) + f"""SELECT row_id, {r6("avg(prediction)")} AS esperado, any_value(y) AS observado, {r6("(avg(prediction) - any_value(y)) / sqrt(avg(prediction) + 1)")} AS brecha_relativa,
         {r6("quantile_cont((prediction - y) / sqrt(prediction + 1), 0.1)")} AS brecha_p10, {r6("quantile_cont((prediction - y) / sqrt(prediction + 1), 0.9)")} AS brecha_p90 FROM oof WHERE model = 'wealth' GROUP BY 1""")
register("gap_artifact_share", lambda spark, sf: rounded(E.gap_artifact_share(table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_retailprice").alias("gap"), (F.col("p_size") % 7).alias("osm"), (F.col("p_size") % 5).alias("fsq")), 100), "top_k", "reference"),
         f"""WITH r AS (SELECT p_partkey, p_retailprice AS gap, p_size % 7 AS osm, p_size % 5 AS fsq FROM part)
         SELECT {r6("(SELECT avg((fsq > osm)::INT) FROM (SELECT * FROM r ORDER BY gap DESC, p_partkey LIMIT 100))")} AS top_k, {r6("(SELECT avg((fsq > osm)::INT) FROM r WHERE osm > 0 OR fsq > 0)")} AS reference""")


def label_scores(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select("doc_id", "lang", "quality", "toxic", (F.col("n_chars") % 100).alias("score"), F.col("source"))


LABELS = "ls AS (SELECT doc_id, lang, quality, toxic, n_chars % 100 AS score, source FROM labels JOIN documents USING (doc_id))"
register("presence_auc", lambda spark, sf: rounded(E.rank_auc(label_scores(spark, sf), ["lang"], "quality", "score"), "auc"),
         with_tables(LABELS) + f""", r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2e0 AS r FROM ls),
         a AS (SELECT lang, sum(r) FILTER (quality = 1) AS s, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS q FROM r GROUP BY 1)
         SELECT lang, {r6("(s - p * (p + 1) / 2) / nullif(p * q, 0)")} AS auc FROM a""")
register("label_confusion", lambda spark, sf: rounded(E.confusion(label_scores(spark, sf), ["lang"], "quality", "score", 50), "accuracy", "balanced_accuracy"),
         with_tables(LABELS) + f""", c AS (SELECT lang, count(*) FILTER (score >= 50 AND quality = 1) AS tp, count(*) FILTER (score >= 50 AND quality <> 1) AS fp, count(*) FILTER (score < 50 AND quality = 1) AS fn, count(*) FILTER (score < 50 AND quality <> 1) AS tn FROM ls GROUP BY 1)
         SELECT *, {r6("(tp + tn) / (tp + fp + fn + tn)")} AS accuracy, {r6("(tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2")} AS balanced_accuracy FROM c""")


def closure_predictions(spark, sf):
    c = table(spark, sf, "customer")
    y = (F.col("c_acctbal") < 0).cast("double")
    both = c.withColumn("m", F.explode(F.array(
        F.struct(F.lit("logistica").alias("model"), (F.col("c_custkey") * 37 % 101 - F.col("c_acctbal") / 100).alias("p")),
        F.struct(F.lit("boosting").alias("model"), (F.col("c_custkey") * 53 % 89 - F.col("c_acctbal") / 300).alias("p")),
        F.struct(F.lit("solo_categoria").alias("model"), F.length("c_mktsegment").cast("double").alias("p")))))
    return both.select("m.model", F.lit(0).alias("repetition"), F.col("c_custkey").alias("row_id"), y.alias("y"), F.round("m.p", 4).alias("prediction"), F.col("c_nationkey").cast("bigint").alias("block"))


CLOSURE_OOF = """oof AS (SELECT model, c_custkey, (c_acctbal < 0)::DOUBLE AS y, round(CASE model WHEN 'logistica' THEN c_custkey * 37 % 101 - c_acctbal / 100 WHEN 'boosting' THEN c_custkey * 53 % 89 - c_acctbal / 300 ELSE length(c_mktsegment)::DOUBLE END, 4) AS p,
  c_nationkey AS block FROM customer, (SELECT unnest(['logistica', 'boosting', 'solo_categoria']) AS model))"""
register("clustered_auc", lambda spark, sf: rounded(E.clustered_auc(closure_predictions(spark, sf), 30), "auc"),
         with_tables(CLOSURE_OOF) + f""", bl AS (SELECT block, row_number() OVER (ORDER BY block) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT block FROM oof)),
         dr AS (SELECT rep::INT AS rep, CAST('0x' || substr(md5('0:' || rep || ':' || i), 1, 8) AS BIGINT) % k AS i FROM bl, range(0, 30) t(rep)), w AS (SELECT rep, block, count(*) AS m FROM dr JOIN bl USING (i) GROUP BY 1, 2 UNION ALL SELECT -1, block, 1 FROM bl),
         v AS (SELECT rep, model, p, sum(m * y) AS pos, sum(m * (1 - y)) AS neg FROM oof JOIN w USING (block) GROUP BY 1, 2, 3),
         c AS (SELECT *, sum(neg) OVER (PARTITION BY rep, model ORDER BY p) - neg / 2 AS below FROM v)
         SELECT model, rep AS replicate, {r6("sum(pos * below) / (sum(pos) * sum(neg))")} AS auc FROM c GROUP BY 1, 2 HAVING sum(pos) * sum(neg) > 0""")
register("clustered_auc_all_replicates", lambda spark, sf: rounded(E.clustered_auc(closure_predictions(spark, sf)), "auc"), ORACLE["clustered_auc"].replace("range(0, 30)", "range(0, 1000)"))
register("auc_decision", lambda spark, sf: E.auc_decision(E.clustered_auc(closure_predictions(spark, sf)), ["logistica", "boosting"], ["solo_categoria"]))
register("block_folds", lambda spark, sf: E.assign_folds(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 5).select("c_custkey", "fold"),
         """WITH b AS (SELECT c_nationkey, (row_number() OVER (ORDER BY md5('0:' || c_nationkey), c_nationkey) - 1) % 5 AS fold FROM (SELECT DISTINCT c_nationkey FROM customer))
         SELECT c_custkey, fold::INT AS fold FROM customer JOIN b USING (c_nationkey)""")


# --- phrases ---------------------------------------------------------------------------------------------------------
def answered(spark, sf):
    """Parts as phrases: the noun decides the truth, keyword rules and a stand-in model answer."""
    truth = F.when(F.col("p_name").endswith("ring"), "joyeria").when(F.col("p_name").endswith("bolt") | F.col("p_name").endswith("gear"), "ferreteria").otherwise(E.NONE)
    keyword, _ = X.keyword_category(X.business_text(F.col("p_name")), {"joyeria": ["ring"], "ferreteria": ["gear", "small"]})
    model = F.when(F.col("p_name").endswith("bolt"), "ferreteria").when(F.col("p_size") > 25, "joyeria").otherwise(E.NONE)
    return table(spark, sf, "part").select("p_partkey", truth.alias("truth"), keyword.alias("keyword"), model.alias("category"), ((F.col("p_size") % 50) / 50.0).alias("probability"), F.col("p_type").alias("tipo"))


ANSWERED = """a AS (SELECT p_partkey, CASE WHEN p_name LIKE '%ring' THEN 'joyeria' WHEN p_name LIKE '%bolt' OR p_name LIKE '%gear' THEN 'ferreteria' ELSE 'ninguna' END AS truth,
  CASE WHEN p_name LIKE '%ring' THEN 'joyeria' WHEN p_name LIKE '%gear' OR p_name LIKE 'small%' THEN 'ferreteria' END AS keyword,
  CASE WHEN p_name LIKE '%bolt' THEN 'ferreteria' WHEN p_size > 25 THEN 'joyeria' ELSE 'ninguna' END AS category, (p_size % 50) / 50e0 AS probability, p_type AS tipo FROM part)"""


def rates_sql(answer: str) -> str:
    return f"""count(*) AS n, {r6(f"avg((CASE WHEN truth = 'ninguna' THEN {answer} IS NULL ELSE coalesce({answer} = truth, false) END)::INT)")} AS right,
    {r6(f"avg(coalesce({answer} <> truth, false)::INT)")} AS wrong, {r6(f"avg(({answer} IS NULL AND truth <> 'ninguna')::INT)")} AS missed"""


RATES = ["right", "wrong", "missed"]
register("answer_summary", lambda spark, sf: rounded(E.answer_summary(answered(spark, sf), "keyword", "truth"), *RATES), with_tables(ANSWERED) + f"SELECT {rates_sql('keyword')} FROM a".replace(" AS right", ' AS "right"'))
register("answer_summary_by_type", lambda spark, sf: rounded(E.answer_summary(answered(spark, sf), "keyword", "truth", ["tipo"]), *RATES), with_tables(ANSWERED) + f"SELECT tipo, {rates_sql('keyword')} FROM a GROUP BY 1".replace(" AS right", ' AS "right"'))
HYBRID = "coalesce(keyword, CASE WHEN category <> 'ninguna' AND probability >= threshold THEN category END)"
GRID = "t AS (SELECT *, unnest([" + ", ".join(f"{t!r}e0" for t in E.THRESHOLDS) + "]) AS threshold FROM a), h AS (SELECT *, " + HYBRID + " AS answer FROM t)"
register("threshold_table", lambda spark, sf: rounded(E.threshold_table(answered(spark, sf), "truth"), *RATES), with_tables(ANSWERED, GRID) + f"SELECT threshold, {rates_sql('answer')} FROM h GROUP BY 1".replace(" AS right", ' AS "right"'))
register("chosen_threshold", lambda spark, sf: E.choose_threshold(answered(spark, sf), "truth"),
         with_tables(ANSWERED, GRID) + """, w AS (SELECT threshold, avg(coalesce(answer <> truth, false)::INT) AS w FROM h GROUP BY 1), k AS (SELECT avg(coalesce(keyword <> truth, false)::INT) AS w FROM a)
         SELECT coalesce(min(threshold) FILTER (w.w <= k.w + 0.02e0), max(threshold)) AS threshold FROM w, k""")
register("hybrid_adoption", lambda spark, sf: E.adoption(answered(spark, sf).withColumn("answer", E.hybrid(F.col("keyword"), E.learned_answer(F.col("category"), F.col("probability"), 0.5))), "truth", "keyword", "answer", 5000))


def phrases(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "lang")


register("phrase_language_model", lambda spark, sf: (lambda m: O.classify_phrases(m, phrases(spark, sf), "text").groupBy("lang", "category").agg(F.count("*").alias("n")))(O.fit_phrases(phrases(spark, sf), "text", "lang")))
register("phrase_out_of_fold", lambda spark, sf: E.answer_summary(O.out_of_fold_phrases(table(spark, sf, "part").select("p_partkey", "p_name", F.col("p_type").alias("truth")), "p_name", "truth", "p_partkey"), "category", "truth"))
register("word_ngrams", lambda spark, sf: table(spark, sf, "part").select(F.explode(X.word_ngrams(X.model_text(F.col("p_name")), 2, 5)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")),
         """WITH w AS (SELECT ' ' || unnest(string_split(lower(p_name), ' ')) || ' ' AS w FROM part), g AS (SELECT substr(w, i::INT, n::INT) AS gram FROM w, range(2, 6) a(n), range(1, 60) b(i)
         WHERE (n <= length(w) AND i + n - 1 <= length(w)) OR (n = length(w) + 1 AND FALSE)) SELECT gram, count(*) AS n FROM g GROUP BY 1""")


# --- fits ------------------------------------------------------------------------------------------------------------
def by_cycle(rows):
    return R.chronological_split(rows, [])


register("travel_time_features", lambda spark, sf: rounded(O.travel_features(measurements(spark, sf)).select("id", *O.TRAVEL_FEATURES), "temperature", "no_traffic_time_min", "travel_time_min_lag"),
         with_tables(MEASUREMENTS) + f""", l AS (SELECT *, coalesce(avg(travel_time_min) OVER (PARTITION BY origin, destination ORDER BY timestamp, id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), no_traffic_time_min) AS lagged FROM measurements)
         SELECT id, hour(timestamp)::DOUBLE AS hour_of_day, (isodow(timestamp) - 1)::DOUBLE AS day_of_week, {r6("coalesce(origin_temperature, 0)")} AS temperature, coalesce(origin_humidity, 0) AS humidity, {r6("coalesce(no_traffic_time_min, 0)")} AS no_traffic_time_min,
         {r6("coalesce(lagged, 0)")} AS travel_time_min_lag FROM l WHERE travel_time_min IS NOT NULL""")
register("route_model_status", lambda spark, sf: O.route_model_status(O.travel_features(measurements(spark, sf)), 200),
         with_tables(MEASUREMENTS) + "SELECT origin, destination, count(*) AS samples, count(*) >= 200 AS trained FROM measurements WHERE travel_time_min IS NOT NULL GROUP BY 1, 2")
register("travel_time_predictions", lambda spark, sf: (lambda f: O.predict_travel_time(O.fit_travel_time(f), f))(O.travel_features(measurements(spark, sf))))
register("travel_time_importances", lambda spark, sf: O.importances(O.fit_travel_time(O.trainable(O.travel_features(measurements(spark, sf)))), spark))
register("travel_time_evaluation", lambda spark, sf: O.evaluate_travel_time(measurements(spark, sf)))
register("travel_time_verdict", lambda spark, sf: O.travel_time_verdict(O.evaluate_travel_time(measurements(spark, sf))))
register("ensemble_evaluation", lambda spark, sf: O.evaluate_ensemble(measurements(spark, sf)))


def newest_predictions(spark, sf):
    f = O.travel_features(measurements(spark, sf))
    return O.ensemble_predictions(O.fit_ensemble(f), R.latest_per_route(f)).select("id", *ROUTE, "ensemble", "lower_80", "upper_80", "lower_95", "upper_95")


register("route_predictions", newest_predictions)
register("high_delay_classifiers", lambda spark, sf: O.evaluate_high_delay(measurements(spark, sf), by_cycle))
register("travel_time_regression", lambda spark, sf: O.evaluate_regression(measurements(spark, sf), by_cycle))
register("corridor_clusters", lambda spark, sf: O.corridor_clusters(R.corridor_profile(measurements(spark, sf)), 4, 8)[0])


def zone_values(spark, sf):
    wealth = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("zone_order")).agg(F.avg("s_acctbal").alias("pob_suavizada"))
    return C.zones(spark, sf).join(wealth, "zone_order", "left")


def features(spark, sf):
    return O.cell_features(counts(spark, sf), "food_drink", zone_values(spark, sf))


CF = with_tables(C.POIS, f"k AS (SELECT floor((latitude - {G.GRID.south!r}) / {G.GRID.dlat!r}e0)::INT AS fila, floor((longitude - {G.GRID.west!r}) / {G.GRID.dlon!r}e0)::INT AS col, category FROM pois)")
register("cell_features", lambda spark, sf: features(spark, sf).select("fila", "col", "y", "business_celda", "business_anillo1", "school_anillo2", "food_drink_celda"),
         CF + f""", act AS (SELECT DISTINCT fila + a.i AS fila, col + b.i AS col FROM k, range(-1, 2) a(i), range(-1, 2) b(i) WHERE category NOT IN ('edificio', 'alojamiento', 'transporte', 'industria')
           AND fila + a.i BETWEEN 0 AND {G.GRID.rows - 1} AND col + b.i BETWEEN 0 AND {G.GRID.cols - 1})
         SELECT a.fila::INT AS fila, a.col::INT AS col, count(*) FILTER (k.fila = a.fila AND k.col = a.col AND category = 'food_drink')::DOUBLE AS y,
         count(*) FILTER (k.fila = a.fila AND k.col = a.col AND category = 'business')::DOUBLE AS business_celda,
         count(*) FILTER (greatest(abs(k.fila - a.fila), abs(k.col - a.col)) = 1 AND category = 'business')::DOUBLE AS business_anillo1,
         count(*) FILTER (greatest(abs(k.fila - a.fila), abs(k.col - a.col)) = 2 AND category = 'school')::DOUBLE AS school_anillo2, 0::DOUBLE AS food_drink_celda
         FROM act a, k WHERE abs(k.fila - a.fila) <= 2 AND abs(k.col - a.col) <= 2 GROUP BY 1, 2""")
STUDIED = [*O.COUNT_BASELINES, "boosting"]
DEALT = """shifts AS (SELECT r, (r % 4)::INT AS dr, (r // 4 % 4)::INT AS dc FROM range(0, 10) t(r)),
blocked AS (SELECT cells.*, r, (floor((fila + dr) / 4)::BIGINT * 1000 + floor((col + dc) / 4)::BIGINT) AS b FROM cells, shifts),
dealt AS (SELECT r, b, (row_number() OVER (PARTITION BY r ORDER BY md5(r || ':' || b), b) - 1) % 5 AS fold FROM (SELECT DISTINCT r, b FROM blocked)),
tested AS (SELECT * FROM blocked JOIN dealt USING (r, b))"""


def left_out(keys: str = "") -> str:
    """Mean of y over the other folds of a repetition, of rows with equal keys."""
    def over(more: str) -> str:
        return f"OVER (PARTITION BY r{keys}{more})"

    return f"(sum(y) {over('')} - sum(y) {over(', fold')}) / nullif(count(*) {over('')} - count(*) {over(', fold')}, 0)"


register("count_model_validation", lambda spark, sf: E.count_metrics(O.cross_validate_counts(features(spark, sf), STUDIED)))
register("count_model_means", lambda spark, sf: rounded(O.cross_validate_counts(features(spark, sf), ["media"]), "prediction").select("row_id", "y", "repetition", "prediction"),
         CF + f""", act AS (SELECT DISTINCT fila + a.i AS fila, col + b.i AS col FROM k, range(-1, 2) a(i), range(-1, 2) b(i) WHERE category NOT IN ('edificio', 'alojamiento', 'transporte', 'industria')
           AND fila + a.i BETWEEN 0 AND {G.GRID.rows - 1} AND col + b.i BETWEEN 0 AND {G.GRID.cols - 1}),
         cells AS (SELECT act.fila, act.col, count(k.fila)::DOUBLE AS y FROM act LEFT JOIN k ON k.fila = act.fila AND k.col = act.col AND category = 'food_drink' GROUP BY 1, 2),
         {DEALT} SELECT (fila * 1000 + col)::BIGINT AS row_id, y, r::INT AS repetition, {r6(f"greatest({left_out()}, {O.MIN_EXPECTED}::DOUBLE)")} AS prediction FROM tested""")
register("count_model_study", lambda spark, sf: O.target_study(features(spark, sf), ["boosting"], O.COUNT_BASELINES)[0])
register("count_model_ensemble", lambda spark, sf: O.bootstrap_ensemble(features(spark, sf), "solo_densidad"))


def closure_labels(spark, sf):
    """Labels written once: the gate and the features read them."""
    return checkpointed(K.label(*snapshots(spark, sf)))


def closure_frame(spark, sf, labels=None):
    return K.modelling_frame(closure_labels(spark, sf) if labels is None else labels, snapshots(spark, sf)[0])


register("closure_model_validation", lambda spark, sf: E.rank_auc(O.cross_validate_closures(closure_frame(spark, sf)), ["model", "repetition"], "y", "prediction"))
register("closure_category_rates", lambda spark, sf: rounded(O.cross_validate_closures(closure_frame(spark, sf), ["solo_categoria"]), "prediction").select("row_id", "y", "repetition", "prediction"),
         CL + f""", cells AS (SELECT type || ':' || id AS row_id, category, closed AS y, floor((lat - {G.GRID.south!r}) / {G.GRID.dlat!r}e0)::INT AS fila, floor((lon - {G.GRID.west!r}) / {G.GRID.dlon!r}e0)::INT AS col FROM closed WHERE closed IS NOT NULL),
         {DEALT} SELECT row_id, y, r::INT AS repetition, {r6(f"coalesce({left_out(', category')}, {left_out()})")} AS prediction FROM tested""")
register("closure_study", lambda spark, sf: (lambda labels: O.closure_study(closure_frame(spark, sf, labels), K.gate(labels)))(closure_labels(spark, sf)))
