"""URL filter: host and path rules, and for the rest a likelihood ratio of two character language models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from wayloom.llm.shared import LOWER, UPPER, sorted_side, stored

#: Rules as host and path, and their verdict.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
ORDER = 4
UNIT = 1_000_000_000
GRAIN = 100
FOLDS = 5
_START, _END = "\u0001", "\u0002"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (rule, verdict) that fits: its host or a subdomain of it, and a path that starts with the rule's."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(urls: DataFrame, order: int) -> DataFrame:
    """One row for each character of a URL with the `order` characters before it, digits being all alike."""
    n = order + 1
    split = urls.withColumn("_each", F.expr("regexp_extract_all(chars, '(?s).', 0)"))  # once: a substring counts from the start
    return split.select(*urls.columns, F.explode(F.expr(f"transform(sequence(1, size(_each) - {order}), i -> array_join(slice(_each, i, {n}), ''))")).alias("gram"))


def characters(host: Column, path: Column, order: int) -> Column:
    return F.concat(F.lit(_START * order), F.regexp_replace(F.concat(host, path), "[0-9]", "0"), F.lit(_END))


def language_models(labelled: DataFrame, grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, ratio): log P(accepted) - log P(rejected) of a gram's last character after the others, in units of 1e-9.

    Variable-order Markov models: the chance of a character after a context is mixed with that after the next shorter one,
    down to one in 256, each context weighing as it has been seen (Witten-Bell): P = (count + kinds * shorter) / (total +
    kinds). Contexts never seen leave the shorter one's chance. Counts are over all labelled URLs.
    """
    n = order + 1
    counted = _grams(labelled, order).groupBy("gram").agg(F.sum(F.when(F.col("verdict") == "allow", 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("b"))
    levels = F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k")
    tails = counted.select(levels, "gram", "a", "b").groupBy("k", F.expr(f"substring(gram, {n} - k + 1, k)").alias("tail")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    tails = stored(tails, "url-counts")
    contexts = tails.groupBy("k", F.expr("substring(tail, 1, k - 1)").alias("context")).agg(
        F.sum("a").alias("na"), F.sum("b").alias("nb"), F.sum(F.signum("a")).cast("long").alias("ta"), F.sum(F.signum("b")).cast("long").alias("tb")
    )
    asked = grams.select("gram").distinct().select("gram", levels).select("gram", "k", F.expr(f"substring(gram, {n} - k + 1, k)").alias("tail"), F.expr(f"substring(gram, {n} - k + 1, k - 1)").alias("context"))
    joined = asked.join(sorted_side(tails), ["k", "tail"], "left").join(sorted_side(contexts), ["k", "context"], "left").na.fill(0)
    steps = joined.groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("k", "a", "b", "na", "nb", "ta", "tb"))).alias("s"))
    chance = "aggregate(s, 0.00390625D, (p, x) -> if(x.n{c} = 0, p, (x.{c} + x.t{c} * p) / (x.n{c} + x.t{c})))"
    return steps.select("gram", F.round((F.log(F.expr(chance.format(c="a"))) - F.log(F.expr(chance.format(c="b")))) * UNIT).cast("long").alias("ratio"))


def scored(urls: DataFrame, models: DataFrame, order: int = ORDER) -> DataFrame:
    """urls with score: the mean ratio of their characters. The sums are whole numbers, so they do not depend on order."""
    sums = _grams(urls, order).join(sorted_side(models), "gram").groupBy("host", "path").agg(F.sum("ratio").alias("total"), F.count("*").alias("n"))
    return urls.join(sorted_side(sums), ["host", "path"]).withColumn("score", F.col("total") / F.col("n") / UNIT)


def calibrated(held: DataFrame) -> float:
    """The cut between score bins at which held-out labelled URLs are told apart best (mean of both rates; smallest cut of ties).

    Reads counts of score bins 1/100 wide; scores are log ratios of a character and so within about +-25.
    """
    bins = held.groupBy(F.floor(F.col("score") * GRAIN).alias("bin")).agg(F.sum(F.when(F.col("verdict") == "allow", 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("b"))
    below, whole = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rates = bins.select(
        "bin", F.coalesce(F.sum("b").over(below), F.lit(0)).alias("b_below"), F.coalesce(F.sum("a").over(below), F.lit(0)).alias("a_below"), F.sum("a").over(whole).alias("na"), F.sum("b").over(whole).alias("nb")
    ).filter("na > 0 and nb > 0").select("bin", (F.col("b_below") * F.col("na") + (F.col("na") - F.col("a_below")) * F.col("nb")).alias("good"))
    best = rates.orderBy(F.desc("good"), "bin").first()
    return best["bin"] / GRAIN if best else 0.0


def url_filter(pages: DataFrame, rules=RULES, order: int = ORDER) -> DataFrame:
    """Every row of pages (page_id, url): page_id, host, path, rule, verdict, score (null where a rule decides).

    The longest fitting rule decides. URLs that a rule decides are the accepted and rejected examples: four fifths of the
    distinct ones teach the two models, a fifth, chosen by a hash, calibrates the cut. Another URL is allowed when its score
    reaches the cut. An empty one (null, no `://`) is one end mark to the models, judged like any other. If no
    rule accepts or none rejects anything, there is nothing to compare and all other URLs are allowed. Repeated rows and ids
    each give their row.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = rows.select("host", "path").distinct().withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    urls = stored(urls.select("host", "path", characters(F.col("host"), F.col("path"), order).alias("chars"), "r.rule", "r.verdict"), "url-distinct")
    fold = F.conv(F.substring(F.md5(F.concat("host", "path")), 1, 8), 16, 10).cast("long") % FOLDS
    taught, held = urls.filter(F.col("verdict").isNotNull() & (fold > 0)), urls.filter(F.col("verdict").isNotNull() & (fold == 0))
    judged = urls.filter(F.col("verdict").isNull() | (fold == 0))
    classes = taught.agg(F.count_distinct("verdict")).first()[0]
    if classes == 2:
        models = language_models(taught, _grams(judged, order), order)
        results = stored(scored(judged, models, order).select("host", "path", "verdict", "score"), "url-scores")
        cut = calibrated(results.filter(F.col("verdict").isNotNull()))
        open_urls = results.filter(F.col("verdict").isNull()).select("host", "path", "score", F.when(F.col("score") >= cut, "allow").otherwise("block").alias("guess"))
    else:
        open_urls = urls.filter(F.col("verdict").isNull()).select("host", "path", F.lit(None).cast("double").alias("score"), F.lit("allow").alias("guess"))
    ruled = rows.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    return ruled.join(sorted_side(open_urls), ["host", "path"], "left").select("page_id", "host", "path", "r.rule", F.coalesce("r.verdict", "guess").alias("verdict"), "score")


def url_sql(rules=RULES, order: int = ORDER) -> str:
    """The same verdicts in DuckDB SQL."""
    n = order + 1
    values = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in rules)
    steps = ["p0 AS (SELECT gram, 0.00390625::DOUBLE AS pa, 0.00390625::DOUBLE AS pb FROM asked)"]
    for k in range(1, n + 1):
        mixed = ", ".join(f"CASE WHEN coalesce(n{c}, 0) = 0 THEN p{c} ELSE (coalesce(t.{c}, 0) + t{c} * p{c}) / (n{c} + t{c}) END AS p{c}" for c in "ab")
        steps.append(f"p{k} AS (SELECT p.gram, {mixed} FROM p{k - 1} p LEFT JOIN tails t ON t.k = {k} AND t.tail = right(p.gram, {k}) LEFT JOIN contexts c ON c.k = {k} AND c.context = left(right(p.gram, {k}), {k - 1}))")
    return f"""
WITH rules(rule, h, p, v) AS (VALUES {values}),
r AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
d AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM r) LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1, 2),
u AS (SELECT *, repeat(chr(1), {order}) || regexp_replace(host || path, '[0-9]', '0', 'g') || chr(2) AS chars, ('0x' || substr(md5(host || path), 1, 8))::BIGINT % {FOLDS} AS fold FROM d),
g AS (SELECT host, path, verdict, fold, substr(chars, i, {n}) AS gram FROM (SELECT *, unnest(range(1, length(chars) - {order} + 1)) AS i FROM u)),
counted AS (SELECT gram, count(*) FILTER (verdict = 'allow') AS a, count(*) FILTER (verdict = 'block') AS b FROM g WHERE verdict IS NOT NULL AND fold > 0 GROUP BY 1),
tails AS (SELECT k, right(gram, k::INT) AS tail, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM counted, range(1, {n + 1}) t(k) GROUP BY 1, 2),
contexts AS (SELECT k, left(tail, k::INT - 1) AS context, sum(a)::BIGINT AS na, sum(b)::BIGINT AS nb, count(*) FILTER (a > 0) AS ta, count(*) FILTER (b > 0) AS tb FROM tails GROUP BY 1, 2),
judged AS (SELECT * FROM g WHERE verdict IS NULL OR fold = 0), asked AS (SELECT DISTINCT gram FROM judged),
{", ".join(steps)},
scores AS (SELECT host, path, any_value(verdict) AS verdict, sum(round((ln(pa) - ln(pb)) * {UNIT}))::DOUBLE / count(*) / {UNIT} AS score FROM judged JOIN p{n} USING (gram) GROUP BY 1, 2),
bins AS (SELECT floor(score * {GRAIN}) AS bin, count(*) FILTER (verdict = 'allow') AS a, count(*) FILTER (verdict = 'block') AS b FROM scores WHERE verdict IS NOT NULL GROUP BY 1),
rates AS (SELECT bin, coalesce(sum(b) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * sum(a) OVER ()
  + (sum(a) OVER () - coalesce(sum(a) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * sum(b) OVER () AS good, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM bins),
cut AS (SELECT coalesce((SELECT bin FROM rates WHERE na > 0 AND nb > 0 ORDER BY good DESC, bin LIMIT 1), 0) / {GRAIN} AS c)
SELECT page_id, host, path, d.rule, coalesce(d.verdict, CASE WHEN score >= c THEN 'allow' ELSE 'block' END) AS verdict, CASE WHEN d.verdict IS NULL THEN round(score + 1.3e-8, 6) END AS score
FROM r JOIN d USING (host, path) LEFT JOIN scores USING (host, path), cut"""
