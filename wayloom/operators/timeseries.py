"""Decomposition, stationarity, correlation, change points, baselines and rolling-origin evaluation.

Functions over raw measurements cut each key into chunks. Functions over an hourly series have one row per key and
hour, so a key is as long as its time span, however many measurements lie behind it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions import scalars as S
from wayloom.functions.stats import partial_autocorrelation, pooled_t, regression_term, t_p_value
from wayloom.operators.chunks import average_rank, day_chunk, ordered_pass, with_position, with_previous_rows, with_running_totals
from wayloom.session import checkpointed

ORDER = ["timestamp", "id"]
HOUR = F.make_dt_interval
# Critical points of the level-stationarity statistic and their p-values; unit-root critical surfaces.
KPSS_POINTS = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))
UNIT_ROOT_CRITICAL = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}
NORMAL_80 = 1.2815515655446004


def known(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).select(*keys, *ORDER, F.col(value).alias("value"))


# --- raw series ------------------------------------------------------------------------------------------------------
def decompose(df: DataFrame, keys: Sequence[str], value: str, period: int = 12) -> DataFrame:
    """Additive trend, seasonal and residual parts. The trend is a centred moving average; at both ends it continues on
    the straight line through the nearest `period` trend values. Keys shorter than two periods are left out."""
    keys = list(keys)
    half = period // 2
    chunk = day_chunk("timestamp")
    rows = with_position(known(df, keys, value), keys, ORDER, chunk, "pos", "n").filter(F.col("n") >= 2 * period)

    def add(w):
        inner = F.sum("value").over(w.rowsBetween(-(half - 1), half - 1) if period % 2 == 0 else w.rowsBetween(-half, half))
        if period % 2 == 0:
            ends = F.lag("value", half).over(w) + F.lead("value", half).over(w)
            return {"_t": (inner + ends / 2) / period}
        return {"_t": inner / period}

    smooth = with_previous_rows(rows, keys, ORDER, half, ["value"], add, chunk, half)
    valid = F.col("pos").between(half + 1, F.col("n") - half)
    smooth = smooth.withColumn("_t", F.when(valid, F.col("_t")))
    x = F.col("pos").cast("double")
    head, tail = F.col("pos") < half + 1 + period, F.col("pos") > F.col("n") - half - period

    def fit(side: Column, name: str) -> list[Column]:
        y, z = F.when(side, F.col("_t")), F.when(side & F.col("_t").isNotNull(), x)
        return [F.regr_slope(y, z).alias(f"_{name}_s"), F.regr_intercept(y, z).alias(f"_{name}_i")]

    lines = smooth.groupBy(*keys).agg(*fit(head, "h"), *fit(tail, "e"))
    full = smooth.join(lines, keys).withColumn(
        "trend",
        F.when(F.col("_t").isNotNull(), F.col("_t"))
        .when(F.col("pos") <= half, F.col("_h_i") + F.col("_h_s") * x)
        .otherwise(F.col("_e_i") + F.col("_e_s") * x),
    ).withColumn("_phase", (F.col("pos") - 1) % period)
    phases = full.groupBy(*keys, "_phase").agg(F.avg(F.col("value") - F.col("trend")).alias("_m"))
    phases = phases.withColumn("seasonal", F.col("_m") - F.avg("_m").over(Window.partitionBy(*keys))).drop("_m")
    out = full.join(phases, [*keys, "_phase"])
    return out.select(*keys, *ORDER, "value", "trend", "seasonal", (F.col("value") - F.col("trend") - F.col("seasonal")).alias("residual"))


def lagged_products(df: DataFrame, keys: Sequence[str], value: str, max_lag: int) -> DataFrame:
    """Per key and lag 0..max_lag: sum over t of (x(t) - mean)(x(t - lag) - mean), with the series length."""
    keys = list(keys)
    means = df.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    rows = known(df, keys, value).join(means, keys).withColumn("dev", F.col("value") - F.col("_mean"))

    def add(w):
        return {f"_x{k}": F.col("dev") * F.lag("dev", k).over(w) for k in range(max_lag + 1)}

    seen = with_previous_rows(rows, keys, ORDER, max_lag, ["dev"], add, day_chunk("timestamp"))
    sums = seen.groupBy(*keys).agg(F.array(*[F.sum(f"_x{k}") for k in range(max_lag + 1)]).alias("_s"), F.count("*").alias("n"))
    return sums.select(*keys, F.posexplode("_s").alias("lag", "product"), "n").filter(F.col("product").isNotNull())


def autocorrelation(df: DataFrame, keys: Sequence[str], value: str, nlags: int = 20) -> DataFrame:
    """Autocorrelations and partial autocorrelations of lags 0..nlags with the 1.96/sqrt(n) band."""
    keys = list(keys)
    products = lagged_products(df, keys, value, nlags).filter(F.col("n") > nlags)
    arrays = products.groupBy(*keys, "n").agg(F.sort_array(F.collect_list(F.struct("lag", "product"))).alias("_p"))
    acf = F.transform("_p", lambda s: s["product"] / F.col("_p")[0]["product"])
    with_acf = arrays.withColumn("_acf", acf)
    both = with_acf.withColumn("_pacf", partial_autocorrelation(F.col("_acf"))).select(
        *keys, "n", F.posexplode(F.arrays_zip(F.col("_acf").alias("acf"), F.col("_pacf").alias("pacf"))).alias("lag", "_v")
    )
    band = 1.96 / F.sqrt("n")
    out = both.select(*keys, "lag", F.col("_v.acf").alias("acf"), F.col("_v.pacf").alias("pacf"), band.alias("band"))
    return out.withColumns({"acf_significant": F.abs("acf") > F.col("band"), "pacf_significant": F.abs("pacf") > F.col("band")})


def level_stationarity(df: DataFrame, keys: Sequence[str], value: str, lags: int) -> DataFrame:
    """Level-stationarity statistic with `lags` weighted autocovariances, its tabled p-value and the reading of it."""
    keys = list(keys)
    products = lagged_products(df, keys, value, lags)
    weight = F.when(F.col("lag") == 0, 1.0).otherwise(2.0 * (1 - F.col("lag") / (lags + 1.0)))
    variance = products.groupBy(*keys, "n").agg((F.sum(F.col("product") * weight) / F.col("n")).alias("_s2"))
    means = df.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    rows = known(df, keys, value).join(means, keys).withColumn("_dev", F.col("value") - F.col("_mean"))
    walk = with_running_totals(rows, keys, ORDER, {"_sum": F.col("_dev")}, day_chunk("timestamp"))
    squares = walk.groupBy(*keys).agg(F.sum(F.col("_sum") * F.col("_sum")).alias("_ss"))
    stat = F.col("_ss") / (F.col("n") * F.col("n")) / F.col("_s2")
    out = squares.join(variance, keys).select(*keys, "n", stat.alias("statistic"))
    p = F.when(F.col("statistic") <= KPSS_POINTS[0][0], KPSS_POINTS[0][1])
    for (x0, p0), (x1, p1) in zip(KPSS_POINTS, KPSS_POINTS[1:]):
        p = p.when(F.col("statistic") <= x1, F.lit(p0) + (F.col("statistic") - x0) * ((p1 - p0) / (x1 - x0)))
    out = out.withColumn("p_value", p.otherwise(KPSS_POINTS[-1][1]))
    return out.withColumn("stationary", F.col("p_value") > 0.05)


def _judged(statistics: DataFrame) -> DataFrame:
    """Critical values for `n` rows, and whether `statistic` is below the one of 5 %."""
    n = F.col("n")
    critical = {f"critical_{k[:-1]}": F.lit(b[0]) + b[1] / n + b[2] / (n * n) + b[3] / F.pow(n, F.lit(3)) for k, b in UNIT_ROOT_CRITICAL.items()}
    return statistics.withColumns(critical).withColumn("stationary", F.col("statistic") < F.col("critical_5"))


def unit_root(df: DataFrame, keys: Sequence[str], value: str, lags: int = 1) -> DataFrame:
    """Unit-root statistic of the regression of the change on the previous level and `lags` earlier changes. The sums of
    products are aggregated by Spark; each key then solves one small system."""
    keys = list(keys)

    def add(w):
        v = F.col("value")
        columns = {"_d": v - F.lag(v, 1).over(w), "_y1": F.lag(v, 1).over(w)}
        for k in range(1, lags + 1):
            columns[f"_d{k}"] = F.lag(v, k).over(w) - F.lag(v, k + 1).over(w)
        return columns

    rows = with_previous_rows(known(df, keys, value), keys, ORDER, lags + 1, ["value"], add, day_chunk("timestamp"))
    names = ["_y1", *[f"_d{k}" for k in range(1, lags + 1)], "_one"]
    rows = rows.withColumn("_one", F.lit(1.0)).na.drop(subset=["_d", *names])
    gram = [F.sum(F.col(a) * F.col(b)) for a in names for b in names]
    sums = rows.groupBy(*keys).agg(
        F.array(*gram).alias("_g"), F.array(*[F.sum(F.col(a) * F.col("_d")) for a in names]).alias("_c"),
        F.sum(F.col("_d") * F.col("_d")).alias("_yy"), F.count("*").alias("n"),
    )
    term = regression_term("_g", "_c", "_yy", F.col("n").cast("double"), F.lit(0))
    out = sums.withColumn("_r", term).select(*keys, "n", (F.col("_r.coefficient") / F.nullif(F.col("_r.std_error"), F.lit(0.0))).alias("statistic"))
    return _judged(out)


def unit_root_by_lags(df: DataFrame, keys: Sequence[str], value: str, most: int = 4) -> DataFrame:
    """`unit_root` for 0 to `most` earlier changes, all from one table of products.

    A row lacks earlier changes only at the start of its key. Products are summed by the number of changes a row has, so
    that the sums of a number of lags are those of the rows with as many changes or more, and one read serves all of them.
    A number of lags that leaves no row to spare has a null statistic, and one that leaves no row is absent."""
    keys = list(keys)
    lagged = [f"_d{k}" for k in range(1, most + 1)]

    def add(w):
        v = F.col("value")
        steps = {name: F.lag(v, k).over(w) - F.lag(v, k + 1).over(w) for k, name in enumerate(lagged, 1)}
        return {"_d": v - F.lag(v, 1).over(w), "_y1": F.lag(v, 1).over(w), **steps}

    rows = with_previous_rows(known(df, keys, value), keys, ORDER, most + 1, ["value"], add, day_chunk("timestamp")).filter("_d IS NOT NULL")
    has = sum((F.col(c).isNotNull().cast("int") for c in lagged), F.lit(0))
    rows = rows.withColumns({"_has": has, "_one": F.lit(1.0), **{c: F.coalesce(c, F.lit(0.0)) for c in lagged}})
    names = ["_y1", "_one", *lagged]
    pairs = {(a, b): f"_s{a}{b}" for i, a in enumerate(names) for b in [*names[i:], "_d"]} | {("_d", "_d"): "_s_d_d"}
    sums = rows.groupBy(*keys, "_has").agg(F.count("*").alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(c) for (a, b), c in pairs.items()])
    each = sums.withColumn("lags", F.explode(F.sequence(F.lit(0), F.col("_has"))))
    each = each.groupBy(*keys, "lags").agg(*[F.sum(c).alias(c) for c in ("n", *pairs.values())])

    def product(a: str, b: str) -> Column:
        return F.col(pairs.get((a, b)) or pairs[b, a])

    gram = crossed = F.lit(None).cast("array<double>")
    for lags in range(most, -1, -1):
        used, here = names[: lags + 2], F.col("lags") == lags
        gram = F.when(here, F.array(*[product(a, b) for a in used for b in used])).otherwise(gram)
        crossed = F.when(here, F.array(*[product(a, "_d") for a in used])).otherwise(crossed)
    solved = each.withColumns({"_g": gram, "_c": crossed})
    enough = F.col("n") > F.col("lags") + 2
    term = F.when(enough, regression_term("_g", "_c", "_s_d_d", F.col("n").cast("double"), F.lit(0)))
    statistic = (F.col("_r.coefficient") / F.nullif(F.col("_r.std_error"), F.lit(0.0))).alias("statistic")
    return _judged(solved.withColumn("_r", term).select(*keys, "lags", "n", statistic))


def forecast_summary(df: DataFrame, keys: Sequence[str], value: str, lags: int = 8, change_lags: int = 1) -> DataFrame:
    """What a forecaster looks at first, per key: rows (part, item, value).

    Parts: `records` (rows, values), `range` (first and last moment in seconds since 1970), `hour` (0 to 23) and `weekday` (0 is
    Monday) with their mean values, `level_stationarity` and `unit_root` with their statistics and readings (1 is stationary). The
    first four come from one pass that keeps 168 cells a key. A mean of no known value is NULL; a key too short for a test lacks its rows.
    """
    keys = list(keys)
    second = F.unix_seconds(F.col("timestamp").cast("timestamp"))
    cells = df.groupBy(*keys, F.hour("timestamp").alias("_h"), S.weekday0(F.col("timestamp")).alias("_d")).agg(
        F.count("*").alias("_n"), F.count(value).alias("_k"), F.sum(value).alias("_s"), F.min(second).alias("_a"), F.max(second).alias("_b")
    )

    def places(*pairs) -> Column:
        return F.explode(F.array(*[F.struct(F.lit(part).alias("part"), item.cast("string").alias("item")) for part, item in pairs]))

    sums = cells.withColumn("_p", places(("", F.lit("")), ("hour", F.col("_h")), ("weekday", F.col("_d")))).groupBy(*keys, "_p.part", "_p.item").agg(
        F.sum("_n").alias("_n"), F.sum("_k").alias("_k"), (F.sum("_s") / F.nullif(F.sum("_k"), F.lit(0))).alias("_m"), F.min("_a").alias("_a"), F.max("_b").alias("_b")
    )

    def told(part: str, **items: Column) -> Column:
        return F.array(*[F.struct(F.lit(part).alias("part"), F.lit(k).alias("item"), v.cast("double").alias("value")) for k, v in items.items()])

    whole = F.concat(told("records", rows=F.col("_n"), values=F.col("_k")), told("range", start=F.col("_a"), end=F.col("_b")))
    pattern = F.array(F.struct("part", "item", F.col("_m").cast("double").alias("value")))
    tests = {
        "level_stationarity": level_stationarity(df, keys, value, lags),
        "unit_root": unit_root(df, keys, value, change_lags),
    }
    out = sums.select(*keys, F.explode(F.when(F.col("part") == "", whole).otherwise(pattern)).alias("_e"))
    for part, test in tests.items():
        items = {c: F.col(c) for c in ("statistic", "p_value", "stationary") if c in test.columns}
        out = out.unionByName(test.select(*keys, F.explode(told(part, **items)).alias("_e")))
    return out.select(*keys, "_e.part", "_e.item", "_e.value")


def change_points(df: DataFrame, keys: Sequence[str], value: str, threshold: float = 2.0) -> DataFrame:
    """Positions where the step of the centred mean exceeds `threshold` population deviations of all steps.

    The mean is over five values, over n // 3 where a key has fewer than 15, and keys with fewer than 10 known values are left
    out. A mean over four looks two back and one ahead. The instant reported is the one at the same position among all rows
    of the key, those without a value included; `value` is the value at that position among the known ones."""
    keys = list(keys)
    chunk = day_chunk("timestamp")
    counted = F.col("value").isNotNull().cast("long")
    placed = ordered_pass(
        df.select(*keys, *ORDER, F.col(value).alias("value")), keys, ORDER, chunk, totals={"place": F.lit(1).cast("long"), "pos": counted}, grand={"pos": "n"}
    )
    placed = checkpointed(placed.filter(F.col("n") >= 10))

    def add(w):
        step = F.lit(0.0)
        for size, back, ahead in ((3, 1, 1), (4, 2, 1), (5, 2, 2)):
            now = F.avg("value").over(w.rowsBetween(-back, ahead))
            following = F.avg("value").over(w.rowsBetween(1 - back, ahead + 1))
            inside = F.col("pos").between(back + 1, F.col("n") - ahead - 1) & (F.least(F.lit(5), F.floor(F.col("n") / 3)) == size)
            step = F.when(inside, following - now).otherwise(step)
        return {"step": step}

    steps = ordered_pass(placed.filter("value is not null"), keys, ORDER, chunk, 2, 3, ["value"], add).filter(F.col("pos") < F.col("n"))
    steps = checkpointed(steps.select(*keys, "pos", "value", "step"))
    spread = steps.groupBy(*keys).agg((F.stddev_pop("step") * threshold).alias("limit"))
    found = steps.join(spread, keys).filter(F.abs("step") > F.col("limit"))
    places = placed.select(*keys, F.col("place").alias("pos"), F.col("timestamp").alias("at"))
    return found.join(places, [*keys, "pos"]).select(
        *keys, (F.col("pos") - 1).alias("index"), F.col("at").alias("timestamp"), "value", F.col("step").alias("change"), F.col("limit").alias("threshold")
    )


def weekend_test(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Pooled t-test of weekday against weekend values per key."""
    weekend = S.weekday0(F.col("timestamp")).isin(*S.WEEKEND_DAYS)
    a, b = F.when(~weekend, F.col(value)), F.when(weekend, F.col(value))
    m = df.groupBy(*keys).agg(
        F.count(a).alias("n1"), F.avg(a).alias("m1"), F.var_samp(a).alias("v1"), F.count(b).alias("n2"), F.avg(b).alias("m2"), F.var_samp(b).alias("v2")
    )
    t, dof, _ = pooled_t(*[F.col(c) for c in ("n1", "m1", "v1", "n2", "m2", "v2")])
    out = m.select(*keys, F.col("m1").alias("weekday_mean"), F.col("m2").alias("weekend_mean"), t.alias("t"), dof.alias("df"))
    return out.withColumn("p_value", t_p_value(F.col("t"), F.col("df").cast("double")))


def correlation_tests(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Pearson and Spearman correlation with p-values, over the rows where both values are known."""
    keys = list(keys)
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, F.col(a).alias("a"), F.col(b).alias("b"))
    ranked = average_rank(average_rank(rows, keys, "a", "ra", "_n1"), keys, "b", "rb", "_n2")
    sums = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("a", "b").alias("pearson"), F.corr("ra", "rb").alias("spearman"))
    for name in ("pearson", "spearman"):
        r = F.col(name)
        t = r * F.sqrt((F.col("n") - 2) / F.nullif(1 - r * r, F.lit(0.0)))
        sums = sums.withColumn(f"{name}_p", t_p_value(t, (F.col("n") - 2).cast("double")))
    return sums


def correlation_matrix(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Correlation of each pair of columns, each over the rows where both are known, from one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.groupBy(*keys).agg(*[F.corr(a, b).alias(f"{a}~{b}") for a, b in pairs])
    names = [f"{a}~{b}" for a, b in pairs]
    long = wide.unpivot(list(keys), names, "_pair", "correlation")
    parts = F.split("_pair", "~")
    return long.select(*keys, parts[0].alias("a"), parts[1].alias("b"), "correlation")


# --- hourly series ---------------------------------------------------------------------------------------------------
def hourly_series(df: DataFrame, keys: Sequence[str], flag: Column) -> DataFrame:
    """Mean of a flag per key and hour on an unbroken run of hours; an hour without data is NULL."""
    keys = list(keys)
    hour = F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("hour")
    seen = df.select(*keys, hour, flag.cast("double").alias("_f")).groupBy(*keys, "hour").agg(F.avg("_f").alias("share"))
    spans = seen.groupBy(*keys).agg(F.min("hour").alias("_a"), F.max("hour").alias("_b"))
    spine = spans.select(*keys, F.explode(F.sequence("_a", "_b", HOUR(hours=F.lit(1)))).alias("hour"))
    return spine.join(seen, [*keys, "hour"], "left")


def high_delay_series(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return hourly_series(df, keys, F.coalesce(F.col("travel_time_min") > S.HIGH_DELAY_OVER_MIN, F.lit(False)))


def hour_profile(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    return series.filter(F.col("share").isNotNull()).groupBy(*keys, F.hour("hour").alias("hour_of_day")).agg(F.avg("share").alias("profile"))


def interpolate(series: DataFrame, keys: Sequence[str], limit: int = 3) -> DataFrame:
    """Fills at most `limit` hours at the start of every gap on the line to the next known value; at the end of the
    series the last value is repeated. Hours before the first value stay unknown."""
    order = Window.partitionBy(*keys).orderBy("hour")
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    marked = series.withColumn("_i", F.row_number().over(order))
    at = F.when(F.col("share").isNotNull(), F.struct(F.col("_i").alias("i"), F.col("share").alias("v")))
    marked = marked.withColumns({"_p": F.last(at, True).over(before), "_n": F.first(at, True).over(after)})
    since = F.col("_i") - F.col("_p.i")
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * since / F.nullif(F.col("_n.i") - F.col("_p.i"), F.lit(0))
    filled = F.coalesce("share", F.when((since <= limit) & F.col("_p").isNotNull(), F.coalesce(line, F.col("_p.v"))))
    return marked.withColumn("filled", filled).drop("_i", "_p", "_n")


def profile_forecast(series: DataFrame, keys: Sequence[str], horizon: int = 24) -> DataFrame:
    """The next `horizon` hours by the profile of their hour of day; the overall mean where an hour was never seen."""
    keys = list(keys)
    ends = series.groupBy(*keys).agg(F.max("hour").alias("_last"), F.avg("share").alias("_mean"))
    ahead = ends.select(*keys, "_mean", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), "_last")
    ahead = ahead.withColumn("hour", F.col("_last") + HOUR(hours=F.col("step"))).withColumn("hour_of_day", F.hour("hour"))
    return ahead.join(hour_profile(series, keys), [*keys, "hour_of_day"], "left").select(
        *keys, "hour", "step", F.coalesce("profile", "_mean").alias("forecast")
    )


def week_ahead(series: DataFrame, keys: Sequence[str], horizon: int = 168) -> DataFrame:
    """Hour-by-weekday profile for the next week with 1.96 residual deviations on both sides."""
    keys = list(keys)
    cell = [F.hour("hour").alias("_h"), F.weekday("hour").alias("_d")]
    seen = series.filter(F.col("share").isNotNull()).select(*keys, "hour", "share", *cell)
    means = seen.groupBy(*keys, "_h", "_d").agg(F.avg("share").alias("_m"))
    spread = seen.join(means, [*keys, "_h", "_d"]).groupBy(*keys).agg(F.stddev_samp(F.col("share") - F.col("_m")).alias("_sd"))
    ends = series.groupBy(*keys).agg(F.max("hour").alias("_last"), F.avg("share").alias("_mean"))
    ahead = ends.join(spread, keys, "left").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    ahead = ahead.withColumn("hour", F.col("_last") + HOUR(hours=F.col("step"))).withColumns({"_h": F.hour("hour"), "_d": F.weekday("hour")})
    value = F.coalesce("_m", "_mean")
    return ahead.join(means, [*keys, "_h", "_d"], "left").select(
        *keys, "hour", value.alias("forecast"), (value - 1.96 * F.col("_sd")).alias("lower"), (value + 1.96 * F.col("_sd")).alias("upper")
    )


def seasonal_forecast(series: DataFrame, keys: Sequence[str], limit: int = 3) -> DataFrame:
    """The next 24 hours: yesterday's value plus a first-order autoregression of the day-on-day change, with an 80 %
    band from its residuals. Gaps of up to `limit` hours are interpolated first. The change decays from the last hour
    that has one, which may lie before the end of the series; an hour whose value a day before is unknown has no forecast."""
    keys = list(keys)
    filled = interpolate(series, keys, limit)
    shifted = filled.select(*keys, (F.col("hour") + HOUR(hours=F.lit(24))).alias("hour"), F.col("filled").alias("_y24"))
    diff = filled.join(shifted, [*keys, "hour"], "left").withColumn("_z", F.col("filled") - F.col("_y24"))
    order = Window.partitionBy(*keys).orderBy("hour")
    pairs = diff.withColumn("_z1", F.lag("_z", 1).over(order))
    fit = pairs.groupBy(*keys).agg(
        F.regr_slope("_z", "_z1").alias("b"), F.regr_intercept("_z", "_z1").alias("a"),
        F.sqrt(F.regr_syy("_z", "_z1") * (1 - F.regr_r2("_z", "_z1")) / F.nullif(F.regr_count("_z", "_z1") - 2, F.lit(0))).alias("sd"),
        F.max("hour").alias("_last"), F.max_by("_z", F.when(F.col("_z").isNotNull(), F.col("hour"))).alias("_zt"),
        F.max(F.when(F.col("_z").isNotNull(), F.col("hour"))).alias("_from"),
    ).withColumn("_late", (F.unix_seconds(F.col("_last").cast("timestamp")) - F.unix_seconds(F.col("_from").cast("timestamp"))) / 3600)
    ahead = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(24)))).withColumns(
        {"hour": F.col("_last") + HOUR(hours=F.col("step")), "_back": F.col("_last") + HOUR(hours=F.col("step") - 24)}
    )
    known_day = filled.select(*keys, F.col("hour").alias("_back"), F.col("filled").alias("_y"))
    ahead_of = F.col("step") + F.col("_late")
    power = F.pow("b", ahead_of)
    change = F.when(F.abs(1 - F.col("b")) < 1e-12, F.col("a") * ahead_of).otherwise(F.col("a") * (1 - power) / (1 - F.col("b"))) + power * F.col("_zt")
    growth = F.when(F.abs(1 - F.col("b") * F.col("b")) < 1e-12, ahead_of).otherwise((1 - power * power) / (1 - F.col("b") * F.col("b")))
    half = NORMAL_80 * F.col("sd") * F.sqrt(growth)
    value = F.col("_y") + change
    return ahead.join(known_day, [*keys, "_back"], "left").select(
        *keys, "hour", "step", value.alias("forecast"), (value - half).alias("lower"), (value + half).alias("upper")
    )


# --- rolling origin --------------------------------------------------------------------------------------------------
def with_baselines(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each hour with the predictions made at the midnight before it, all from earlier hours: profile, yesterday, mean
    and last value; and the counts that decide whether that midnight is eligible."""
    keys = list(keys)
    day = F.to_date("hour")
    rows = series.withColumns({"cut": day, "_h": F.hour("hour")})
    earlier = Window.partitionBy(*keys, "_h").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_profile": F.avg("share").over(earlier), "_ayer": F.lag("share", 1).over(Window.partitionBy(*keys, "_h").orderBy("hour"))})
    per_day = rows.groupBy(*keys, "cut").agg(
        F.sum("share").alias("_s"), F.count("share").alias("future_obs"), F.max_by("share", F.when(F.col("share").isNotNull(), F.col("hour"))).alias("_l"),
        F.count("*").alias("_hours"),
    )
    days = Window.partitionBy(*keys).orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    per_day = per_day.select(
        *keys, "cut", "future_obs", "_hours", F.sum("future_obs").over(days).alias("past_obs"),
        (F.sum("_s").over(days) / F.nullif(F.sum("future_obs").over(days), F.lit(0))).alias("_mean"),
        F.last("_l", True).over(days).alias("_last"),
    )
    joined = rows.join(per_day, [*keys, "cut"])
    profile = F.coalesce("_profile", "_mean")
    return joined.select(
        *keys, "cut", "hour", "share", "future_obs", "past_obs", "_hours",
        profile.alias("perfil"), F.coalesce("_ayer", profile).alias("ayer"), F.col("_mean").alias("media"), F.col("_last").alias("ultimo"),
    )


def eligible(min_future: int = 12, min_past: int = 168) -> Column:
    """A midnight with a whole day of hours behind it, enough of them observed, and enough observed hours before."""
    return (F.col("_hours") == 24) & (F.col("future_obs") >= min_future) & (F.coalesce("past_obs", F.lit(0)) >= min_past)


def eligible_cutoffs(series: DataFrame, keys: Sequence[str], min_future: int = 12, min_past: int = 168) -> DataFrame:
    return with_baselines(series, keys).filter(eligible(min_future, min_past)).select(*keys, "cut", "future_obs", "past_obs").distinct()


MODELS = ("perfil", "ayer", "media", "ultimo")
SEASONAL = "estacional"
_MOMENTS = ("_c", "_sx", "_sy", "_sxx", "_sxy", "_syy")


def _moments() -> list[Column]:
    """Sums of the regression of `y` on `x` over the rows that have both."""
    x, y = F.col("x"), F.col("y")
    terms = zip(_MOMENTS, (F.lit(1.0), x, y, x * x, x * y, y * y))
    return [F.sum(F.when(x.isNotNull() & y.isNotNull(), term)).alias(name) for name, term in terms]


def seasonal_by_cut(series: DataFrame, keys: Sequence[str], limit: int = 3) -> DataFrame:
    """What `seasonal_forecast` says at every midnight for the hours of that day, from the hours before it only.

    No model is fitted twice. A pair of day-on-day changes counts from the day on which its values are known, an interpolated
    one from the next observed hour, so that the fit of a midnight is a running sum of regression sums over days. An open gap
    holds its last value until it closes: its rows, at most `limit` a midnight, are added to the midnights that see it open.
    `series` has one row for every hour of a key, as `hourly_series` gives it; a key without two changes has no forecast."""
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy("hour")
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    observed = F.when(F.col("share").isNotNull(), F.col("hour"))
    rows = interpolate(series, keys, limit).withColumns({
        "_known": F.coalesce(F.first(observed, True).over(after), F.max("hour").over(Window.partitionBy(*keys)) + HOUR(hours=F.lit(1))),
        "_held": F.last("share", True).over(before),
    })
    rows = rows.withColumns({f"{c}24": F.lag(c, 24).over(order) for c in ("filled", "_known", "_held")})
    open_gap = F.col("share").isNull() & F.col("filled").isNotNull()
    rows = rows.withColumns({"_z": F.col("filled") - F.col("filled24"), "_zh": F.when(open_gap, F.col("_held") - F.col("filled24"))})
    rows = rows.withColumn("_kz", F.when(F.col("_z").isNotNull(), F.greatest("_known", "_known24")))
    rows = rows.withColumns({
        "_z1": F.lag("_z", 1).over(order), "_kz1": F.lag("_kz", 1).over(order),
        "_zh1": F.when(F.lag("share", 1).over(order).isNull(), F.lag("_zh", 1).over(order)).otherwise(F.lag("_z", 1).over(order)),
    })
    nothing = F.lit(None).cast("double")

    def entry(moment: Column, x: Column, y: Column, at: Column) -> Column:
        return F.struct(F.to_date(moment).alias("cut"), x.alias("x"), y.alias("y"), at.alias("at"))

    change = F.struct("hour", F.col("_z").alias("z"))
    nowhere = F.when(F.lit(False), change)
    entries = F.array(
        entry(F.when(F.col("_z1").isNotNull(), F.greatest("_kz", "_kz1")), F.col("_z1"), F.col("_z"), nowhere),
        entry(F.col("_kz"), nothing, nothing, F.when(F.col("_z").isNotNull(), change)),
        entry(F.col("hour"), nothing, nothing, nowhere),
    )
    daily = rows.select(*keys, F.inline(entries)).filter("cut IS NOT NULL").groupBy(*keys, "cut").agg(*_moments(), F.max("at").alias("_at"))
    past = Window.partitionBy(*keys).orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    fits = daily.select(*keys, "cut", *[F.sum(c).over(past).alias(c) for c in _MOMENTS], F.max("_at").over(past).alias("_at"))

    last_cut, first_cut = F.to_date("_known"), F.date_add(F.to_date("hour"), 1)
    held = rows.filter(open_gap & (first_cut <= last_cut)).select(
        *keys, F.explode(F.sequence(first_cut, last_cut)).alias("cut"), F.col("_zh1").alias("x"), F.col("_zh").alias("y"),
        F.when(F.col("_zh").isNotNull(), F.struct("hour", F.col("_zh").alias("z"))).alias("at"),
    ).groupBy(*keys, "cut").agg(*_moments(), F.max("at").alias("_at"))
    held = held.select(*keys, "cut", *[F.col(c).alias(f"{c}_held") for c in (*_MOMENTS, "_at")])
    fits = fits.join(held, [*keys, "cut"], "left").withColumns({
        **{c: F.coalesce(c, F.lit(0.0)) + F.coalesce(f"{c}_held", F.lit(0.0)) for c in _MOMENTS}, "_at": F.greatest("_at", "_at_held"),
    })
    n = F.nullif(F.col("_c"), F.lit(0.0))
    slope = (F.col("_sxy") - F.col("_sx") * F.col("_sy") / n) / F.nullif(F.col("_sxx") - F.col("_sx") * F.col("_sx") / n, F.lit(0.0))
    fits = fits.withColumn("_b", slope).select(
        *keys, "cut", "_b", ((F.col("_sy") - F.col("_b") * F.col("_sx")) / n).alias("_a"), F.col("_at.z").alias("_zt"),
        ((F.unix_seconds(F.col("cut").cast("timestamp")) - F.unix_seconds(F.col("_at.hour").cast("timestamp"))) / 3600 - 1).alias("_late"),
    )
    joined = rows.withColumn("cut", F.to_date("hour")).join(fits, [*keys, "cut"])
    yesterday = F.when(F.col("_known24") < F.col("cut").cast("timestamp_ntz"), F.col("filled24")).when(F.col("filled24").isNotNull(), F.col("_held24"))
    ahead = F.hour("hour") + 1 + F.col("_late")
    power = F.pow("_b", ahead)
    drift = F.when(F.abs(1 - F.col("_b")) < 1e-12, F.col("_a") * ahead).otherwise(F.col("_a") * (1 - power) / F.nullif(1 - F.col("_b"), F.lit(0.0)))
    return joined.select(*keys, "cut", "hour", (yesterday + drift + power * F.col("_zt")).alias(SEASONAL))


def rolling_evaluation(series: DataFrame, keys: Sequence[str], min_future: int = 12, min_past: int = 168, seasonal: bool = False) -> DataFrame:
    """MAE and RMSE of every baseline at every eligible midnight, from one plan; with `seasonal` of the seasonal model too.
    `n` counts the hours of that day, whether or not a model has a forecast for each."""
    rows = with_baselines(series, keys).filter(eligible(min_future, min_past) & F.col("share").isNotNull())
    models = list(MODELS)
    if seasonal:
        rows = rows.join(seasonal_by_cut(series, keys), [*keys, "cut", "hour"], "left")
        models.append(SEASONAL)
    long = rows.unpivot([*keys, "cut", "share"], models, "model", "prediction")
    error = F.col("prediction") - F.col("share")
    return long.groupBy(*keys, "cut", "model").agg(
        F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse")
    )


def summarize_evaluation(results: DataFrame, keys: Sequence[str], reference: str = "perfil") -> DataFrame:
    """Mean errors per model and the paired difference from the reference with its 95 % interval and verdict."""
    keys = list(keys)
    base = results.filter(F.col("model") == reference).select(*keys, "cut", F.col("mae").alias("_base"))
    diff = F.when(F.col("model") != reference, F.col("mae") - F.col("_base"))
    out = results.join(base, [*keys, "cut"], "left").groupBy(*keys, "model").agg(
        F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.avg(diff).alias("difference"),
        (F.stddev_samp(diff) / F.sqrt(F.count(diff)) * 1.96).alias("ci95"), F.count_if(diff < 0).alias("wins"), F.count(diff).alias("cuts"),
    )
    verdict = (
        F.when(F.col("model") == reference, None)
        .when(F.col("ci95").isNull(), "sin datos suficientes")
        .when(F.abs("difference") <= F.col("ci95"), "indistinguible del perfil")
        .when(F.col("difference") > 0, "PEOR que el perfil")
        .otherwise("MEJOR que el perfil")
    )
    return out.withColumn("verdict", verdict)
