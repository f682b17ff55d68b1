"""Queries over time series: decomposition, tests, correlations, change points, forecasts and their evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayloom.operators import timeseries as TS
from wayloom.plans.common import MEASUREMENTS, measurements, r6, shown, with_tables
from wayloom.schemas import ROUTE

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
MEAS = with_tables(MEASUREMENTS)
V = "travel_time_min"


def register(name: str, build: Callable, oracle: str | None = None) -> None:
    QUERIES[name] = build
    if oracle is not None:
        ORACLE[name] = oracle


def rounded(df, *columns, digits=6):
    return df.withColumns({c: shown(F.col(c), digits) for c in columns})


def on_measurements(fn):
    return lambda spark, sf: fn(measurements(spark, sf))


def on_series(fn):
    return lambda spark, sf: fn(TS.high_delay_series(measurements(spark, sf), ["data_source"]))


PLACED = """x AS (SELECT origin, destination, id, timestamp, travel_time_min AS v, row_number() OVER (PARTITION BY origin, destination ORDER BY timestamp, id) AS pos,
  count(*) OVER (PARTITION BY origin, destination) AS n, avg(travel_time_min) OVER (PARTITION BY origin, destination) AS mean FROM measurements WHERE travel_time_min IS NOT NULL)"""
PART = "PARTITION BY origin, destination"
register(
    "seasonal_decomposition",
    on_measurements(lambda m: rounded(TS.decompose(m, ROUTE, V, 12).select("id", "trend", "seasonal", "residual"), "trend", "seasonal", "residual", digits=5)),
    with_tables(MEASUREMENTS, PLACED) + f""", t AS (SELECT *, CASE WHEN pos BETWEEN 7 AND n - 6 THEN (sum(v) OVER (w ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
      + (lag(v, 6) OVER w + lead(v, 6) OVER w) / 2) / 12 END AS t0 FROM x WHERE n >= 24 WINDOW w AS ({PART} ORDER BY pos)),
    f AS (SELECT origin, destination, regr_slope(t0, pos) FILTER (pos < 19) AS hs, regr_intercept(t0, pos) FILTER (pos < 19) AS hi,
      regr_slope(t0, pos) FILTER (pos > n - 18) AS es, regr_intercept(t0, pos) FILTER (pos > n - 18) AS ei FROM t GROUP BY 1, 2),
    u AS (SELECT t.*, coalesce(t0, CASE WHEN pos <= 6 THEN hi + hs * pos ELSE ei + es * pos END) AS trend FROM t JOIN f USING (origin, destination)),
    p AS (SELECT origin, destination, (pos - 1) % 12 AS ph, avg(v - trend) AS m FROM u GROUP BY 1, 2, 3),
    s AS (SELECT *, m - avg(m) OVER ({PART}) AS seasonal FROM p)
    SELECT id, {r6("trend", 5)} AS trend, {r6("seasonal", 5)} AS seasonal, {r6("v - trend - seasonal", 5)} AS residual FROM u JOIN s ON u.origin = s.origin AND u.destination = s.destination AND (pos - 1) % 12 = ph""",
)
ACF = """p AS (SELECT a.origin, a.destination, k.lag, any_value(a.n) AS n, sum((a.v - a.mean) * (b.v - b.mean)) AS product FROM x a, range(0, 21) k(lag), x b
  WHERE a.origin = b.origin AND a.destination = b.destination AND b.pos = a.pos - k.lag GROUP BY 1, 2, 3),
r AS (SELECT origin, destination, lag::INT AS lag, product / max(product) FILTER (lag = 0) OVER (PARTITION BY origin, destination) AS acf, 1.96e0 / sqrt(n) AS band FROM p WHERE n > 20)"""
register("autocorrelation", on_measurements(lambda m: rounded(TS.autocorrelation(m, ROUTE, V, 20).select(*ROUTE, "lag", "acf", "band", "acf_significant"), "acf", "band")),
         with_tables(MEASUREMENTS, PLACED, ACF) + f"SELECT origin, destination, lag, {r6('acf')} AS acf, {r6('band')} AS band, abs(acf) > band AS acf_significant FROM r")
register("partial_autocorrelation", on_measurements(lambda m: rounded(TS.autocorrelation(m, ROUTE, V, 2).filter(F.col("lag") == 2).select(*ROUTE, "pacf"), "pacf")),
         with_tables(MEASUREMENTS, PLACED, ACF) + f"""SELECT origin, destination, {r6("(r2 - r1 * r1) / (1 - r1 * r1)")} AS pacf FROM (SELECT origin, destination, max(acf) FILTER (lag = 1) AS r1, max(acf) FILTER (lag = 2) AS r2 FROM
         (SELECT origin, destination, lag, product / max(product) FILTER (lag = 0) OVER (PARTITION BY origin, destination) AS acf FROM p WHERE n > 2) GROUP BY 1, 2)""")
register(
    "level_stationarity",
    on_measurements(lambda m: rounded(TS.level_stationarity(m, ROUTE, V, 8), "statistic", "p_value")),
    with_tables(MEASUREMENTS, PLACED, ACF) + f""", c AS (SELECT origin, destination, sum(power(s, 2)) AS ss FROM (SELECT origin, destination, sum(v - mean) OVER ({PART} ORDER BY pos) AS s FROM x) GROUP BY 1, 2),
    q AS (SELECT origin, destination, any_value(n) AS n, sum(product * CASE WHEN lag = 0 THEN 1 ELSE 2 * (1 - lag / 9e0) END) / any_value(n) AS s2 FROM p WHERE lag <= 8 GROUP BY 1, 2),
    k AS (SELECT origin, destination, n, ss / (n * n) / s2 AS st FROM c JOIN q USING (origin, destination)),
    z AS (SELECT *, CASE WHEN st <= 0.347 THEN 0.1 WHEN st <= 0.463 THEN 0.1 - (st - 0.347) * 0.05 / 0.116 WHEN st <= 0.574 THEN 0.05 - (st - 0.463) * 0.025 / 0.111 WHEN st <= 0.739 THEN 0.025 - (st - 0.574) * 0.015 / 0.165 ELSE 0.01 END AS pv FROM k)
    SELECT origin, destination, n, {r6("st")} AS statistic, {r6("pv")} AS p_value, pv > 0.05 AS stationary FROM z""",
)
register("unit_root", on_measurements(lambda m: rounded(TS.unit_root(m, ROUTE, V, 0).select(*ROUTE, "n", "statistic", "stationary"), "statistic", digits=4)),
         with_tables(MEASUREMENTS, PLACED) + f""", d AS (SELECT origin, destination, v - lag(v) OVER w AS dv, lag(v) OVER w AS y1 FROM x WINDOW w AS ({PART} ORDER BY pos)),
         s AS (SELECT origin, destination, count(dv) AS n, regr_slope(dv, y1) AS b, sqrt(regr_syy(dv, y1) * (1 - regr_r2(dv, y1)) / (regr_count(dv, y1) - 2) / regr_sxx(dv, y1)) AS se FROM d GROUP BY 1, 2)
         SELECT origin, destination, n, {r6("b / se", 4)} AS statistic, b / se < -2.86154 - 2.8903 / n - 4.234 / (n * n) - 40.04 / (n * n * n) AS stationary FROM s""")


def lag_set_sql(lags: int) -> str:
    """The unit-root statistic with a number of lags: the regressors are made orthogonal one after the other, the level last."""
    part = "OVER (PARTITION BY origin, destination)"
    names = [*(f"d{k}" for k in range(1, lags + 1)), "y1", "dv"]
    steps = "".join(f", lag(v, {k}) OVER w - lag(v, {k + 1}) OVER w AS d{k}" for k in range(1, lags + 1))
    inner = f"SELECT * FROM (SELECT origin, destination, v - lag(v) OVER w AS dv, lag(v) OVER w AS y1{steps} FROM x WINDOW w AS ({PART} ORDER BY pos)) WHERE {names[max(lags - 1, 0)]} IS NOT NULL"
    inner = "SELECT origin, destination, " + ", ".join(f"{c} - avg({c}) {part} AS {c}" for c in names) + f" FROM ({inner})"
    for i in range(lags):
        base = names[i]
        rest = ", ".join(f"{c} - {base} * sum({c} * {base}) {part} / sum({base} * {base}) {part} AS {c}" for c in names[i + 1 :])
        inner = f"SELECT origin, destination, {rest} FROM ({inner})"
    fit = f"SELECT origin, destination, count(*) AS n, sum(y1 * dv) / sum(y1 * y1) AS b, sum(y1 * y1) AS yy, sum(dv * dv) AS dd FROM ({inner}) GROUP BY 1, 2"
    tested = f"SELECT *, b / sqrt((dd - b * b * yy) / (n - {lags + 2}) / yy) AS st FROM ({fit})"
    return f"SELECT origin, destination, {lags} AS lags, n, {r6('st', 4)} AS statistic, st < -2.86154 - 2.8903 / n - 4.234 / (n * n) - 40.04 / (n * n * n) AS stationary FROM ({tested})"


register("unit_root_lag_sets", on_measurements(lambda m: rounded(TS.unit_root_by_lags(m, ROUTE, V, 4).select(*ROUTE, "lags", "n", "statistic", "stationary"), "statistic", digits=4)),
         with_tables(MEASUREMENTS, PLACED) + " UNION ALL ".join(lag_set_sql(k) for k in range(5)))


def summary(m):
    out = TS.forecast_summary(m, ROUTE, V, 8, 0)
    return out.withColumn("value", F.when(F.col("part") == "unit_root", shown(F.col("value"), 4)).otherwise(shown(F.col("value"), 6)))


register(
    "forecast_summary",
    on_measurements(summary),
    MEAS + f""", parts AS (SELECT origin, destination, 'records' AS part, 'rows' AS item, count(*)::DOUBLE AS value FROM measurements GROUP BY 1, 2
    UNION ALL SELECT origin, destination, 'records', 'values', count(travel_time_min) FROM measurements GROUP BY 1, 2
    UNION ALL SELECT origin, destination, 'range', 'start', epoch(date_trunc('second', min(timestamp))) FROM measurements GROUP BY 1, 2
    UNION ALL SELECT origin, destination, 'range', 'end', epoch(date_trunc('second', max(timestamp))) FROM measurements GROUP BY 1, 2
    UNION ALL SELECT origin, destination, 'hour', hour(timestamp)::VARCHAR, {r6("avg(travel_time_min)")} FROM measurements GROUP BY 1, 2, 4
    UNION ALL SELECT origin, destination, 'weekday', (isodow(timestamp) - 1)::VARCHAR, {r6("avg(travel_time_min)")} FROM measurements GROUP BY 1, 2, 4
    UNION ALL SELECT origin, destination, 'level_stationarity', unnest(['statistic', 'p_value', 'stationary']), unnest([statistic, p_value, stationary::INT::DOUBLE]) FROM ({ORACLE["level_stationarity"]}) k
    UNION ALL SELECT origin, destination, 'unit_root', unnest(['statistic', 'stationary']), unnest([statistic, stationary::INT::DOUBLE]) FROM ({ORACLE["unit_root"]}) u)
    SELECT origin, destination, part, item, value FROM parts""",
)
CHANGES = with_tables(MEASUREMENTS, PLACED) + f""", s AS (SELECT *, CASE WHEN n < 12 AND pos BETWEEN 2 AND n - 2 THEN avg(v) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) - avg(v) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)
      WHEN n BETWEEN 12 AND 14 AND pos BETWEEN 3 AND n - 2 THEN avg(v) OVER (w ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) - avg(v) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)
      WHEN n >= 15 AND pos BETWEEN 3 AND n - 3 THEN avg(v) OVER (w ROWS BETWEEN 1 PRECEDING AND 3 FOLLOWING) - avg(v) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) ELSE 0 END AS step
      FROM x WHERE n >= 10 WINDOW w AS ({PART} ORDER BY pos)),
    k AS (SELECT *, 2 * stddev_pop(step) OVER ({PART}) AS lim FROM s WHERE pos < n),
    a AS (SELECT origin, destination, timestamp AS moment, row_number() OVER ({PART} ORDER BY timestamp, id) AS pos FROM measurements)
    SELECT origin, destination, k.pos - 1 AS index, moment AS timestamp, v AS value, {r6("step")} AS change, {r6("lim")} AS threshold FROM k JOIN a USING (origin, destination, pos) WHERE abs(step) > lim"""
register(
    "change_points",
    on_measurements(lambda m: rounded(TS.change_points(m, ROUTE, V, 2.0), "change", "threshold")),
    CHANGES,
)
register(
    "change_points_short_series",
    on_measurements(lambda m: rounded(TS.change_points(m.withColumn("origin", F.concat("origin", F.lit(":"), F.dayofmonth("timestamp").cast("string"), F.lit(":"), (F.col("id") % 7).cast("string"))), ROUTE, V, 2.0), "change", "threshold")),
    CHANGES.replace("x AS (SELECT", "short AS (SELECT * REPLACE (origin || ':' || day(timestamp) || ':' || id % 7 AS origin) FROM measurements),\nx AS (SELECT", 1).replace("FROM measurements WHERE", "FROM short WHERE").replace("AS pos FROM measurements)", "AS pos FROM short)"),
)
TT = """m AS (SELECT origin, destination, count(a) AS n1, avg(a) AS m1, var_samp(a) AS v1, count(b) AS n2, avg(b) AS m2, var_samp(b) AS v2 FROM
  (SELECT origin, destination, CASE WHEN isodow(timestamp) < 6 THEN travel_time_min END AS a, CASE WHEN isodow(timestamp) >= 6 THEN travel_time_min END AS b FROM measurements) GROUP BY 1, 2)"""
register("weekend_t_test", on_measurements(lambda m: rounded(TS.weekend_test(m, ROUTE, V).drop("p_value"), "weekday_mean", "weekend_mean", "t")),
         with_tables(MEASUREMENTS, TT) + f"""SELECT origin, destination, {r6("m1")} AS weekday_mean, {r6("m2")} AS weekend_mean,
         {r6("(m1 - m2) / (sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) * sqrt(1e0 / n1 + 1e0 / n2))")} AS t, n1 + n2 - 2 AS df FROM m""")
register("correlation_tests", on_measurements(lambda m: rounded(TS.correlation_tests(m, ROUTE, "origin_temperature", V).select(*ROUTE, "n", "pearson", "spearman"), "pearson", "spearman")),
         MEAS + f""", q AS (SELECT origin, destination, origin_temperature AS a, travel_time_min AS b FROM measurements WHERE origin_temperature IS NOT NULL AND travel_time_min IS NOT NULL),
         r AS (SELECT *, rank() OVER ({PART} ORDER BY a) + (count(*) OVER ({PART}, a) - 1) / 2e0 AS ra, rank() OVER ({PART} ORDER BY b) + (count(*) OVER ({PART}, b) - 1) / 2e0 AS rb FROM q)
         SELECT origin, destination, count(*) AS n, {r6("corr(a, b)")} AS pearson, {r6("corr(ra, rb)")} AS spearman FROM r GROUP BY 1, 2""")
MATRIX = ["travel_time_min", "traffic_delay_min", "average_speed_kmh", "origin_temperature"]
register("correlation_matrix", on_measurements(lambda m: rounded(TS.correlation_matrix(m, MATRIX), "correlation")),
         MEAS + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r6(f'corr({a}, {b})')} AS correlation FROM measurements" for i, a in enumerate(MATRIX) for b in MATRIX[i:]))

SERIES = """h AS (SELECT data_source, date_trunc('hour', timestamp)::TIMESTAMP AS hour, avg(coalesce(travel_time_min > 20, false)::INT) AS share FROM measurements GROUP BY 1, 2),
spine AS (SELECT data_source, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS hour FROM (SELECT data_source, min(hour) AS a, max(hour) AS b FROM h GROUP BY 1)),
series AS (SELECT s.data_source, s.hour, share FROM spine s LEFT JOIN h USING (data_source, hour))"""
S_SQL = with_tables(MEASUREMENTS, SERIES)
register("hourly_high_delay_share", on_series(lambda s: rounded(s, "share")), S_SQL + f"SELECT data_source, hour, {r6('share')} AS share FROM series")
register("hour_profile", on_series(lambda s: rounded(TS.hour_profile(s, ["data_source"]), "profile")),
         S_SQL + f"SELECT data_source, hour(hour)::INT AS hour_of_day, {r6('avg(share)')} AS profile FROM series WHERE share IS NOT NULL GROUP BY 1, 2")


def route_series(spark, sf):
    return TS.high_delay_series(measurements(spark, sf), ROUTE)


R_SERIES = SERIES.replace("data_source", "origin, destination").replace("s.origin, destination", "s.origin, s.destination").replace("FROM measurements GROUP BY 1, 2", "FROM measurements GROUP BY 1, 2, 3").replace("FROM h GROUP BY 1)", "FROM h GROUP BY 1, 2)")
register(
    "interpolated_gaps",
    lambda spark, sf: rounded(TS.interpolate(route_series(spark, sf), ROUTE, 3), "share", "filled"),
    with_tables(MEASUREMENTS, R_SERIES) + f""", g AS (SELECT *, row_number() OVER ({PART} ORDER BY hour) AS i FROM series),
    n AS (SELECT *, last_value(CASE WHEN share IS NOT NULL THEN i END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS pi, last_value(share IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS pv,
      first_value(CASE WHEN share IS NOT NULL THEN i END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni,
      first_value(share IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv FROM g WINDOW w AS ({PART} ORDER BY hour))
    SELECT origin, destination, hour, {r6("share")} AS share, {r6("coalesce(share, CASE WHEN i - pi <= 3 THEN coalesce(pv + (nv - pv) * (i - pi) / nullif(ni - pi, 0), pv) END)")} AS filled FROM n""",
)
register("profile_forecast", on_series(lambda s: rounded(TS.profile_forecast(s, ["data_source"]), "forecast")),
         S_SQL + f""", e AS (SELECT data_source, max(hour) AS l, avg(share) AS mean FROM series GROUP BY 1), p AS (SELECT data_source, hour(hour) AS hd, avg(share) AS pr FROM series WHERE share IS NOT NULL GROUP BY 1, 2)
         SELECT e.data_source, l + INTERVAL 1 HOUR * k::INT AS hour, k::INT AS step, {r6("coalesce(pr, mean)")} AS forecast FROM e CROSS JOIN range(1, 25) t(k) LEFT JOIN p ON p.data_source = e.data_source AND hd = hour(l + INTERVAL 1 HOUR * k::INT)""")
register("week_ahead_forecast", on_series(lambda s: rounded(TS.week_ahead(s, ["data_source"]), "forecast", "lower", "upper")),
         S_SQL + f""", e AS (SELECT data_source, max(hour) AS l, avg(share) AS mean FROM series GROUP BY 1),
         p AS (SELECT data_source, hour(hour) AS hd, isodow(hour) AS wd, avg(share) AS m FROM series WHERE share IS NOT NULL GROUP BY 1, 2, 3),
         sd AS (SELECT s.data_source, stddev_samp(share - m) AS sd FROM series s JOIN p ON p.data_source = s.data_source AND hd = hour(s.hour) AND wd = isodow(s.hour) WHERE share IS NOT NULL GROUP BY 1),
         a AS (SELECT e.data_source, l + INTERVAL 1 HOUR * k::INT AS hour, mean, sd FROM e JOIN sd USING (data_source) CROSS JOIN range(1, 169) t(k))
         SELECT a.data_source, a.hour, {r6("coalesce(m, mean)")} AS forecast, {r6("coalesce(m, mean) - 1.96e0 * sd")} AS lower, {r6("coalesce(m, mean) + 1.96e0 * sd")} AS upper FROM a LEFT JOIN p ON p.data_source = a.data_source AND hd = hour(a.hour) AND wd = isodow(a.hour)""")
def gapped_series(spark, sf):
    """The series without 11 to 15 o'clock of every third day, the last four hours, and two hours of every fifth day."""
    h, d = F.hour("hour"), F.dayofmonth("hour")
    gone = (h.between(11, 15) & (d % 3 == 0)) | (h.between(3, 4) & (d % 5 == 0)) | (F.col("hour") > F.max("hour").over(Window.partitionBy("data_source")) - F.expr("INTERVAL 4 HOURS"))
    return TS.high_delay_series(measurements(spark, sf), ["data_source"]).withColumn("share", F.when(~gone, F.col("share")))


register("seasonal_forecast", lambda spark, sf: rounded(TS.seasonal_forecast(gapped_series(spark, sf), ["data_source"]), "forecast", "lower", "upper"),
         S_SQL + f""", gs AS (SELECT data_source, hour, CASE WHEN NOT (hour(hour) BETWEEN 11 AND 15 AND day(hour) % 3 = 0 OR hour(hour) BETWEEN 3 AND 4 AND day(hour) % 5 = 0 OR hour > max(hour) OVER (PARTITION BY data_source) - INTERVAL 4 HOUR) THEN share END AS share FROM series),
         gi AS (SELECT *, row_number() OVER (PARTITION BY data_source ORDER BY hour) AS i FROM gs),
         gn AS (SELECT *, last_value(CASE WHEN share IS NOT NULL THEN i END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS pi, last_value(share IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS pv,
           first_value(CASE WHEN share IS NOT NULL THEN i END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni,
           first_value(share IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv FROM gi WINDOW w AS (PARTITION BY data_source ORDER BY hour)),
         fl AS (SELECT data_source, hour, coalesce(share, CASE WHEN i - pi <= 3 THEN coalesce(pv + (nv - pv) * (i - pi) / nullif(ni - pi, 0), pv) END) AS share FROM gn),
         z AS (SELECT a.data_source, a.hour, a.share AS y, a.share - b.share AS z FROM fl a LEFT JOIN fl b ON a.data_source = b.data_source AND a.hour = b.hour + INTERVAL 24 HOUR),
         q AS (SELECT *, lag(z) OVER (PARTITION BY data_source ORDER BY hour) AS z1 FROM z),
         f AS (SELECT data_source, regr_slope(z, z1) AS b, regr_intercept(z, z1) AS a, sqrt(regr_syy(z, z1) * (1 - regr_r2(z, z1)) / (regr_count(z, z1) - 2)) AS sd, max(hour) AS l, arg_max(z, hour) FILTER (z IS NOT NULL) AS zt, date_diff('hour', max(hour) FILTER (z IS NOT NULL), max(hour)) AS late FROM q GROUP BY 1),
         k AS (SELECT f.*, s::INT AS step, l + INTERVAL 1 HOUR * s::INT AS hour FROM f, range(1, 25) t(s)),
         v AS (SELECT k.*, y + a * (1 - pow(b, step + late)) / (1 - b) + pow(b, step + late) * zt AS fc, {TS.NORMAL_80!r} * sd * sqrt((1 - pow(b, 2 * (step + late))) / (1 - b * b)) AS hf FROM k JOIN z ON z.data_source = k.data_source AND z.hour = k.hour - INTERVAL 24 HOUR)
         SELECT data_source, hour, step, {r6("fc")} AS forecast, {r6("fc - hf")} AS lower, {r6("fc + hf")} AS upper FROM v""")
register("seasonal_forecast_whole_series", on_series(lambda s: rounded(TS.seasonal_forecast(s, ["data_source"]), "forecast", "lower", "upper")),
         S_SQL + ", gs AS (SELECT data_source, hour, share FROM series),\n         gi AS" + ORACLE["seasonal_forecast"].split("gi AS", 1)[1])
BASELINES = """days AS (SELECT data_source, CAST(hour AS DATE) AS cut, count(*) AS hours, count(share) AS future_obs FROM series GROUP BY 1, 2),
elig AS (SELECT d.data_source, d.cut, d.future_obs, (SELECT count(share) FROM series s WHERE s.data_source = d.data_source AND s.hour < d.cut) AS past_obs FROM days d WHERE hours = 24),
ok AS (SELECT * FROM elig WHERE future_obs >= 12 AND past_obs >= 168),
pr AS (SELECT s.data_source, o.cut, s.hour, s.share, coalesce(pf.m, g.m) AS perfil, y.share AS y, g.m AS media, g.l AS ultimo FROM series s
  JOIN ok o ON o.data_source = s.data_source AND CAST(s.hour AS DATE) = o.cut
  JOIN (SELECT o.data_source, o.cut, avg(p.share) AS m, arg_max(p.share, p.hour) FILTER (p.share IS NOT NULL) AS l FROM ok o JOIN series p ON p.data_source = o.data_source AND p.hour < o.cut GROUP BY 1, 2) g ON g.data_source = o.data_source AND g.cut = o.cut
  LEFT JOIN (SELECT o.data_source, o.cut, hour(p.hour) AS h, avg(p.share) AS m FROM ok o JOIN series p ON p.data_source = o.data_source AND p.hour < o.cut GROUP BY 1, 2, 3) pf ON pf.data_source = o.data_source AND pf.cut = o.cut AND pf.h = hour(s.hour)
  LEFT JOIN series y ON y.data_source = s.data_source AND y.hour = s.hour - INTERVAL 24 HOUR WHERE s.share IS NOT NULL),
long AS (SELECT data_source, cut, share, unnest(['perfil', 'ayer', 'media', 'ultimo']) AS model, unnest([perfil, coalesce(y, perfil), media, ultimo]) AS p FROM pr),
res AS (SELECT data_source, cut, model, count(*) AS n, avg(abs(p - share)) AS mae, sqrt(avg(pow(p - share, 2))) AS rmse FROM long GROUP BY 1, 2, 3)"""
EVAL = with_tables(MEASUREMENTS, SERIES, BASELINES)
register("eligible_cutoffs", on_series(lambda s: TS.eligible_cutoffs(s, ["data_source"])), EVAL + "SELECT data_source, cut, future_obs, past_obs FROM ok")
register("rolling_origin_errors", on_series(lambda s: rounded(TS.rolling_evaluation(s, ["data_source"]), "mae", "rmse")), EVAL + f"SELECT data_source, cut, model, n, {r6('mae')} AS mae, {r6('rmse')} AS rmse FROM res")
SEASONAL_CUTS = """hist AS (SELECT o.data_source, o.cut, s.hour, s.share, row_number() OVER (PARTITION BY o.data_source, o.cut ORDER BY s.hour) AS i FROM ok o JOIN series s ON s.data_source = o.data_source AND s.hour < o.cut),
nb AS (SELECT *, last_value(CASE WHEN share IS NOT NULL THEN i END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS pi, last_value(share IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS pv,
  first_value(CASE WHEN share IS NOT NULL THEN i END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni,
  first_value(share IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv FROM hist WINDOW w AS (PARTITION BY data_source, cut ORDER BY hour)),
fl AS (SELECT data_source, cut, hour, coalesce(share, CASE WHEN i - pi <= 3 THEN coalesce(pv + (nv - pv) * (i - pi) / nullif(ni - pi, 0), pv) END) AS y FROM nb),
zs AS (SELECT *, y - lag(y, 24) OVER (PARTITION BY data_source, cut ORDER BY hour) AS z FROM fl),
zl AS (SELECT *, lag(z) OVER (PARTITION BY data_source, cut ORDER BY hour) AS z1 FROM zs),
ft AS (SELECT data_source, cut, regr_slope(z, z1) AS b, regr_intercept(z, z1) AS a, arg_max(z, hour) FILTER (z IS NOT NULL) AS zt, date_diff('hour', max(hour) FILTER (z IS NOT NULL), max(hour)) AS late FROM zl GROUP BY 1, 2),
sea AS (SELECT f.data_source, f.cut, l.hour + INTERVAL 24 HOUR AS hour, l.y + a * (1 - pow(b, hour(l.hour) + 1 + late)) / (1 - b) + pow(b, hour(l.hour) + 1 + late) * zt AS p FROM ft f JOIN fl l ON l.data_source = f.data_source AND l.cut = f.cut AND l.hour >= f.cut - INTERVAL 24 HOUR)"""
SEASONAL_RES = SEASONAL_CUTS + """,
res5 AS (SELECT * FROM res UNION ALL SELECT o.data_source, o.cut, 'estacional', count(*), avg(abs(p - share)), sqrt(avg(pow(p - share, 2))) FROM ok o JOIN series s ON s.data_source = o.data_source AND CAST(s.hour AS DATE) = o.cut
  LEFT JOIN sea q ON q.data_source = s.data_source AND q.cut = o.cut AND q.hour = s.hour WHERE share IS NOT NULL GROUP BY 1, 2)"""


def seasonal_cuts(series):
    cuts = TS.eligible_cutoffs(series, ["data_source"]).select("data_source", "cut")
    return rounded(TS.seasonal_by_cut(series, ["data_source"]).join(cuts, ["data_source", "cut"], "left_semi"), TS.SEASONAL)


register("seasonal_forecast_by_cut", on_series(seasonal_cuts),
         with_tables(MEASUREMENTS, SERIES, BASELINES, SEASONAL_CUTS) + f"SELECT data_source, cut, hour, {r6('p')} AS estacional FROM sea")
register("rolling_origin_errors_all_models", on_series(lambda s: rounded(TS.rolling_evaluation(s, ["data_source"], seasonal=True), "mae", "rmse")),
         with_tables(MEASUREMENTS, SERIES, BASELINES, SEASONAL_RES) + f"SELECT data_source, cut, model, n, {r6('mae')} AS mae, {r6('rmse')} AS rmse FROM res5")
register("rolling_origin_summary", on_series(lambda s: rounded(TS.summarize_evaluation(TS.rolling_evaluation(s, ["data_source"]), ["data_source"]), "mae", "rmse", "difference", "ci95")),
         EVAL + f""", j AS (SELECT r.*, CASE WHEN r.model <> 'perfil' THEN r.mae - b.mae END AS d FROM res r JOIN res b ON b.data_source = r.data_source AND b.cut = r.cut AND b.model = 'perfil'),
         a AS (SELECT data_source, model, avg(mae) AS mae, avg(rmse) AS rmse, avg(d) AS difference, 1.96e0 * stddev_samp(d) / sqrt(count(d)) AS ci95, count(*) FILTER (d < 0) AS wins, count(d) AS cuts FROM j GROUP BY 1, 2)
         SELECT data_source, model, {r6("mae")} AS mae, {r6("rmse")} AS rmse, {r6("difference")} AS difference, {r6("ci95")} AS ci95, wins, cuts, CASE WHEN model = 'perfil' THEN NULL WHEN ci95 IS NULL THEN 'sin datos suficientes'
         WHEN abs(difference) <= ci95 THEN 'indistinguible del perfil' WHEN difference > 0 THEN 'PEOR que el perfil' ELSE 'MEJOR que el perfil' END AS verdict FROM a""")
