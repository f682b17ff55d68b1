"""Adjusted associations: exact strata, score matching, day-clustered intervals, before/after and what-if."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions import scalars as S
from wayloom.functions.stats import pooled_t, replicate_draw, t_p_value
from wayloom.operators.chunks import beside, day_chunk, dealt, exact_percentiles, value_chunks, with_one_row, with_position
from wayloom.operators.geo import sorted_join
from wayloom.operators.indicators import indicators
from wayloom.schemas import ROUTE
from wayloom.session import checkpointed

STRATA = [*ROUTE, "data_source", "hour", "week"]
EXACT = [*ROUTE, "data_source"]
COVARIATES = ["hour", "day_of_week", "week", *ROUTE, "data_source"]
REPLICATES = 300
CALIPER_SD = 0.2
BALANCE_GOOD, BALANCE_ACCEPTABLE = 0.1, 0.25
OUTCOME = "travel_time_min"
# The strata compared by the specification table.
SPECIFICATIONS = {
    "route": [*ROUTE, "data_source"],
    "route_hour": [*ROUTE, "data_source", "hour"],
    "route_week": [*ROUTE, "data_source", "week"],
    "route_hour_week": STRATA,
    "hour_week": ["hour", "week"],
}


def analysis_rows(df: DataFrame, weather: str, outcome: str = OUTCOME) -> DataFrame:
    """Rows with weather and outcome known, with hour, weekday, ISO week and day."""
    ts = F.col("timestamp")
    return df.filter(F.col(weather).isNotNull() & F.col(outcome).isNotNull()).select(
        "id", "timestamp", *ROUTE, "data_source", F.col(weather).alias("weather"), F.col(outcome).alias("y"),
        F.hour(ts).alias("hour"), S.weekday0(ts).alias("day_of_week"), S.iso_year_week(ts).alias("week"), F.to_date(ts).alias("day"),
    )


def assign_treatment(rows: DataFrame, treatment: str = "above_typical") -> DataFrame:
    """Adds `treated`: warmer than the median of the own hour and week, or than the overall median."""
    if treatment not in ("above_typical", "above_median"):
        raise ValueError(f"Unknown treatment {treatment!r}")
    keys = ["hour", "week"] if treatment == "above_typical" else []
    medians = checkpointed(exact_percentiles(rows, keys, "weather", {"_typical": 0.5}, parts=16))
    return beside(rows, medians, keys).withColumn("treated", F.col("weather") > F.col("_typical")).drop("_typical")


def stratum(columns: Sequence[str], df: DataFrame) -> Column:
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"Unknown stratification columns: {unknown}")
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns]) if columns else F.lit("")


def sums_interval(sums: DataFrame, by: Sequence[str], cluster: str, replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """95 % interval of Σ `s` / Σ `n` when whole clusters (days, blocks) are drawn again. One row per cluster comes in; each
    replicate draws as many clusters as there are, by hash."""
    by = list(by)
    numbered = sums.select(*by, cluster, "s", "n").withColumns(
        {"_i": F.row_number().over(Window.partitionBy(*by).orderBy(cluster)) - 1, "_d": F.count("*").over(Window.partitionBy(*by))}
    )
    draws = numbered.select(*by, "_d", F.col("_i").alias("_draw"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    draws = draws.withColumn("_i", replicate_draw(seed, F.col("replicate"), F.col("_draw"), F.col("_d"))).drop("_d", "_draw")
    means = draws.join(numbered.select(*by, "_i", "s", "n"), [*by, "_i"]).groupBy(*by, "replicate").agg((F.sum("s") / F.sum("n")).alias("_m"))
    ends = F.percentile("_m", F.array(F.lit(0.025), F.lit(0.975)))
    return means.groupBy(*by).agg(ends.alias("_q")).select(*by, F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"))


def cluster_interval(diffs: DataFrame, by: Sequence[str], cluster: str, replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """The same for the mean of `diff`; the rows of a cluster are summed first, and the sums are written once."""
    sums = diffs.groupBy(*by, cluster).agg(F.sum("diff").alias("s"), F.count("diff").alias("n"))
    return sums_interval(checkpointed(sums), by, cluster, replicates, seed)


def stratum_days(rows: DataFrame, specifications: dict[str, Sequence[str]]) -> DataFrame:
    """Sufficient statistics of all specifications, one row per (specification, day).

    Rows are summed by day and by every column that a specification uses, treated rows and controls apart; a row of that table
    goes once to each specification, into its stratum. There the controls' mean is Σy / Σn over all days, and the treated rows
    of a day differ from it by Σy - n * mean: `s`, over `n` rows, where a stratum has both. `strata` counts such strata, each
    on its first day; nt, st, nc and sc are the counts and sums of all treated and control rows.
    """
    used = sorted({c for columns in specifications.values() for c in columns})
    strata = [F.struct(F.lit(name).alias("specification"), stratum(columns, rows).alias("stratum")) for name, columns in specifications.items()]
    t, c = F.when(F.col("treated"), F.col("y")), F.when(~F.col("treated"), F.col("y"))
    sums = {"nt": F.count(t), "st": F.sum(t), "nc": F.count(c), "sc": F.sum(c)}
    cells = rows.groupBy(*dict.fromkeys([*used, "day"])).agg(*[v.alias(k) for k, v in sums.items()])
    spread = cells.select("day", *sums, F.explode(F.array(*strata)).alias("_s")).select("_s.*", "day", *sums)
    daily = spread.groupBy("specification", "stratum", "day").agg(*[F.sum(k).alias(k) for k in sums])
    own = Window.partitionBy("specification", "stratum")
    daily = daily.withColumns({"_mu": F.sum("sc").over(own) / F.sum("nc").over(own), "_nt": F.sum("nt").over(own), "_day": F.min("day").over(own)})
    both = F.col("_mu").isNotNull() & (F.col("nt") > 0)
    first = F.col("_mu").isNotNull() & (F.col("_nt") > 0) & (F.col("day") == F.col("_day"))
    diff = F.coalesce("st", F.lit(0.0)) - F.col("nt") * F.col("_mu")
    return daily.groupBy("specification", "day").agg(
        F.sum(F.when(both, diff)).alias("s"), F.sum(F.when(both, F.col("nt")).otherwise(0)).alias("n"), F.count_if(first).alias("strata"),
        *[F.sum(k).alias(k) for k in sums],
    )


def specification_table(rows: DataFrame, specifications: dict[str, Sequence[str]] = SPECIFICATIONS, replicates: int = REPLICATES) -> DataFrame:
    """For each specification (name and the columns of its strata): the difference of treated rows from the controls of their
    own stratum, its day-clustered interval, what it used, and the unadjusted difference.

    All specifications share one pass over the rows; their table of days is written once and small. Treated rows without
    controls in their stratum are not used; a specification that uses none has no row."""
    days = checkpointed(stratum_days(rows, specifications))
    totals = days.groupBy("specification").agg(
        (F.sum("s") / F.sum("n")).alias("att"), F.sum("n").alias("n_used"), F.sum("strata").alias("n_strata_used"), F.sum("nt").alias("n_treated"),
        (F.sum("st") / F.sum("nt") - F.sum("sc") / F.sum("nc")).alias("naive_difference"),
    )
    return totals.join(sums_interval(days.filter("n > 0"), ["specification"], "day", replicates), "specification").withColumns(
        {"share_used": F.col("n_used") / F.col("n_treated"), "ci_excludes_zero": (F.col("ci_low") > 0) | (F.col("ci_high") < 0)}
    )


def stratified_adjusted(rows: DataFrame, strata: Sequence[str] = STRATA, name: str = "strata", replicates: int = REPLICATES) -> DataFrame:
    """One row of the specification table."""
    return specification_table(rows, {name: strata}, replicates)


# --- score matching --------------------------------------------------------------------------------------------------
def with_propensity(rows: DataFrame, covariates: Sequence[str] = COVARIATES, regularisation: float | None = None) -> DataFrame:
    """Adds `logit` of the probability of treatment given the covariates as indicators. `rows` has an `id`, by which it is dealt.

    A penalty of 1/n matches a unit penalty on the summed loss."""
    rows = dealt(rows)
    n = rows.count() if regularisation is None else None
    penalty = regularisation if regularisation is not None else 1.0 / max(n, 1)
    text = rows.select("*", *[F.col(c).cast("string").alias(f"_t_{c}") for c in covariates], F.col("treated").cast("double").alias("label"))
    stages = [
        *indicators([f"_t_{c}" for c in covariates], text),
        VectorAssembler(inputCols=[f"_o__t_{c}" for c in covariates], outputCol="features"),
        LogisticRegression(regParam=penalty, maxIter=100, standardization=False),
    ]
    scored = Pipeline(stages=stages).fit(text).transform(text)
    p = F.greatest(F.least(vector_to_array("probability")[1], F.lit(1 - 1e-6)), F.lit(1e-6))
    return scored.select(*rows.columns, F.log(p / (1 - p)).alias("logit"))


def nearest_controls(rows: DataFrame, exact: Sequence[str], score: str = "logit") -> DataFrame:
    """Each treated row with the closest control of its exact group, with replacement; of two equally close ones the
    lower. Groups are cut into ranges of the score; only the outermost controls of a range are passed on."""
    keyed = rows.withColumn("_g", stratum(exact, rows))
    chunked = value_chunks(keyed, ["_g"], score)
    control = F.when(~F.col("treated"), F.struct(F.col(score).alias("s"), F.col("id").alias("id"), F.col("y").alias("y")))
    chunked = chunked.withColumn("_c", control)
    edges = chunked.groupBy("_g", "_chunk").agg(F.max("_c").alias("_last"), F.min("_c").alias("_first"))
    by_chunk = Window.partitionBy("_g").orderBy("_chunk")
    carried = edges.select(
        "_g", "_chunk",
        F.last("_last", True).over(by_chunk.rowsBetween(Window.unboundedPreceding, -1)).alias("_below"),
        F.first("_first", True).over(by_chunk.rowsBetween(1, Window.unboundedFollowing)).alias("_above"),
    )
    # The next control is the last one seen in the opposite order: a frame up to the end would be gone through again for each row.
    local = Window.partitionBy("_g", "_chunk")
    onward, back = local.orderBy(F.col(score), F.col("treated").desc(), "id"), local.orderBy(F.col(score).desc(), "treated", F.col("id").desc())
    seen = chunked.withColumns(
        {name: F.last("_c", True).over(order.rowsBetween(Window.unboundedPreceding, 0)) for name, order in (("_l", onward), ("_r", back))}
    )
    pairs = seen.filter("treated").join(carried, ["_g", "_chunk"]).withColumns(
        {"_l": F.coalesce("_l", "_below"), "_r": F.coalesce("_r", "_above")}
    )
    left, right = F.abs(F.col("_l.s") - F.col(score)), F.abs(F.col("_r.s") - F.col(score))
    best = F.when(F.col("_l").isNull() | (right < left), F.col("_r")).otherwise(F.col("_l"))
    return pairs.withColumn("_m", best).filter(F.col("_m").isNotNull()).select(
        *rows.columns, F.col("_m.id").alias("control_id"), F.col("_m.y").alias("control_y"), F.abs(F.col("_m.s") - F.col(score)).alias("gap")
    )


def matched_pairs(scored: DataFrame, exact: Sequence[str] = EXACT, caliper_sd: float = CALIPER_SD) -> DataFrame:
    """Nearest controls inside the caliper, a share of the population deviation of the score."""
    pairs = with_one_row(nearest_controls(scored, exact), scored.agg((F.stddev_pop("logit") * caliper_sd).alias("caliper")))
    return pairs.filter(F.col("gap") <= F.col("caliper")).withColumn("diff", F.col("y") - F.col("control_y"))


def level_balance(treated: DataFrame, control: DataFrame, covariates: Sequence[str]) -> DataFrame:
    """Standardised mean difference of every covariate level. Both sides carry a weight `w`; an indicator with mean p
    has variance p(1 - p)."""
    def shares(df, name):
        levels = df.select("w", F.explode(F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("string").alias("level")) for c in covariates])).alias("l"))
        sums = levels.groupBy("l.covariate", "l.level").agg(F.sum("w").alias("_w"))
        return with_one_row(sums, df.agg(F.sum("w").alias("_total"))).select("covariate", "level", (F.col("_w") / F.col("_total")).alias(name))

    both = shares(treated, "pt").join(shares(control, "pc"), ["covariate", "level"], "full_outer").na.fill(0.0, ["pt", "pc"])
    spread = F.sqrt((F.col("pt") * (1 - F.col("pt")) + F.col("pc") * (1 - F.col("pc"))) / 2)
    return both.select("covariate", "level", F.when(spread > 0, (F.col("pt") - F.col("pc")) / spread).otherwise(0.0).alias("smd"))


def balance(scored: DataFrame, pairs: DataFrame, covariates: Sequence[str] = COVARIATES) -> DataFrame:
    """Differences before and after matching; a control counts as often as it was used."""
    one = scored.withColumn("w", F.lit(1.0))
    before = level_balance(one.filter("treated"), one.filter(~F.col("treated")), covariates).withColumnRenamed("smd", "before")
    uses = pairs.groupBy(F.col("control_id").alias("id")).agg(F.count("*").cast("double").alias("w"))
    used = sorted_join(scored, uses, ["id"])
    after = level_balance(pairs.withColumn("w", F.lit(1.0)), used, covariates).withColumnRenamed("smd", "after")
    return before.join(after, ["covariate", "level"], "left").na.fill(0.0, ["after"])


def matched_balance(rows: DataFrame, exact: Sequence[str] = EXACT, covariates: Sequence[str] = COVARIATES) -> DataFrame:
    """Balance before and after matching on the scores that `rows` carry. Rows and pairs are written once: six parts read them."""
    scored = checkpointed(rows)
    return balance(scored, checkpointed(matched_pairs(scored, exact)), covariates)


def balance_summary(table: DataFrame) -> DataFrame:
    worst = F.max(F.abs("after"))
    quality = F.when(worst < BALANCE_GOOD, "good").when(worst < BALANCE_ACCEPTABLE, "acceptable").otherwise("poor")
    return table.agg(
        F.max(F.abs("before")).alias("max_abs_smd_before"), worst.alias("max_abs_smd_after"),
        F.avg(F.abs("before")).alias("mean_abs_smd_before"), F.avg(F.abs("after")).alias("mean_abs_smd_after"), quality.alias("quality"),
    )


def worst_balanced(table: DataFrame, n: int = 5) -> DataFrame:
    return table.orderBy(F.desc(F.abs("after")), "covariate", "level").limit(n)


def score_matching(rows: DataFrame, exact: Sequence[str] = EXACT, covariates: Sequence[str] = COVARIATES, replicates: int = REPLICATES) -> DataFrame:
    """Effect over the matched pairs, its interval, the share matched and the balance reached. The scores are written
    once: several parts read them, and a lost executor must not start the fit again."""
    scored = checkpointed(with_propensity(rows, covariates))
    pairs = checkpointed(matched_pairs(scored, exact))
    effect = pairs.agg(F.avg("diff").alias("att"), F.count("*").alias("n_matched"), F.first("caliper").alias("caliper"))
    counts = scored.agg(
        F.count_if("treated").alias("n_treated"),
        (F.avg(F.when(F.col("treated"), F.col("y"))) - F.avg(F.when(~F.col("treated"), F.col("y")))).alias("naive_difference"),
    )
    out = effect
    for part in (counts, cluster_interval(pairs, [], "day", replicates), balance_summary(balance(scored, pairs, covariates))):
        out = with_one_row(out, part)
    return out.withColumn("share_matched", F.col("n_matched") / F.col("n_treated"))


# --- simpler comparisons ---------------------------------------------------------------------------------------------
def weather_split_test(rows: DataFrame) -> DataFrame:
    """Correlation of weather and outcome, and the unadjusted test of treated against control rows."""
    t, c = F.when(F.col("treated"), F.col("y")), F.when(~F.col("treated"), F.col("y"))
    m = rows.agg(
        F.corr("weather", "y").alias("correlation"), F.count(t).alias("n1"), F.avg(t).alias("m1"), F.var_samp(t).alias("v1"),
        F.count(c).alias("n2"), F.avg(c).alias("m2"), F.var_samp(c).alias("v2"),
    )
    stat, dof, _ = pooled_t(*[F.col(x) for x in ("n1", "m1", "v1", "n2", "m2", "v2")])
    out = m.select("correlation", (F.col("m1") - F.col("m2")).alias("difference"), stat.alias("t"), dof.alias("df"))
    return out.withColumn("p_value", t_p_value(F.col("t"), F.col("df").cast("double"))).withColumn("evidence", S.evidence_text(F.col("p_value")))


def what_if(df: DataFrame, weather: str, deltas: Sequence[float] = (-5.0, -2.5, 0.0, 2.5, 5.0), keys: Sequence[str] = ()) -> DataFrame:
    """Predicted mean outcome when the weather moves by each delta, on the straight line through the data."""
    fit = df.groupBy(*keys).agg(
        F.regr_slope(OUTCOME, weather).alias("slope"), F.regr_intercept(OUTCOME, weather).alias("intercept"),
        F.regr_avgx(OUTCOME, weather).alias("mean_weather"),
    )
    moved = fit.withColumn("delta", F.explode(F.array(*[F.lit(float(d)) for d in deltas])))
    predicted = F.col("intercept") + F.col("slope") * (F.col("mean_weather") + F.col("delta"))
    return moved.select(*keys, "delta", "slope", predicted.alias("predicted"), (F.col("slope") * F.col("delta")).alias("change"))


def before_after(df: DataFrame, keys: Sequence[str], share: float = 0.75) -> DataFrame:
    """First 75 % of the rows of each key against the rest: effect, pooled t-test and Cohen's d. Keys with fewer than ten
    rows on a side are left out. No control group: whatever changed over time is in the effect."""
    keys = list(keys)
    placed = with_position(df, keys, ["timestamp", "id"], day_chunk("timestamp"), "_pos", "_n")
    early = F.col("_pos") <= F.floor(F.col("_n") * share)
    b, a = F.when(early, F.col(OUTCOME)), F.when(~early, F.col(OUTCOME))
    m = placed.groupBy(*keys).agg(
        F.count_if(early).alias("before"), F.count_if(~early).alias("after"),
        F.count(a).alias("n1"), F.avg(a).alias("after_mean"), F.var_samp(a).alias("v1"), F.count(b).alias("n2"), F.avg(b).alias("before_mean"), F.var_samp(b).alias("v2"),
    ).filter((F.col("before") >= 10) & (F.col("after") >= 10))
    t, dof, sd = pooled_t(*[F.col(c) for c in ("n1", "after_mean", "v1", "n2", "before_mean", "v2")])
    effect = F.col("after_mean") - F.col("before_mean")
    d = F.coalesce(effect / F.nullif(sd, F.lit(0.0)), F.lit(0.0))
    out = m.select(*keys, "before", "after", "before_mean", "after_mean", effect.alias("effect"), t.alias("t"), dof.alias("df"), d.alias("cohens_d"))
    return out.withColumns(
        {
            "p_value": t_p_value(F.col("t"), F.col("df").cast("double")),
            "direction": F.when(F.col("effect") < 0, "improvement").otherwise("degradation"),
            "magnitude": S.cohens_d_text(F.abs("cohens_d")),
        }
    )


def confounders(df: DataFrame, weather: str = "origin_temperature") -> DataFrame:
    """Hour, when it goes with weather and outcome; weekday, when its means spread by more than a fifth of their mean."""
    h = F.hour("timestamp")
    rows = df.select(h.alias("h"), S.weekday0(F.col("timestamp")).alias("d"), F.col(weather).alias("w"), F.col(OUTCOME).alias("y"))
    hour = rows.agg(F.corr("h", "w").alias("treatment"), F.corr("h", "y").alias("outcome"))
    hour = hour.select(
        F.lit("hour").alias("variable"), F.col("treatment"), F.col("outcome"),
        ((F.abs("treatment") > 0.3) & (F.abs("outcome") > 0.3)).alias("identified"),
        F.when(F.abs("treatment") > 0.5, "high").otherwise("moderate").alias("severity"),
    )
    days = rows.groupBy("d").agg(F.avg("y").alias("m"))
    day = days.agg(F.stddev_samp("m").alias("sd"), F.avg("m").alias("mean")).select(
        F.lit("day_of_week").alias("variable"), F.lit(None).cast("double").alias("treatment"), (F.col("sd") / F.nullif(F.col("mean"), F.lit(0.0))).alias("outcome"),
        (F.col("sd") > F.col("mean") * 0.2).alias("identified"), F.lit("moderate").alias("severity"),
    )
    return hour.unionByName(day)
