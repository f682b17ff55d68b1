"""Integrity of published tables: keys, contents, manifests, landed files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows, distinct keys, surplus rows and key groups with more than one row."""
    groups = df.groupBy(*key).agg(F.count("*").alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count("*").alias("keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"),
        F.count_if(F.col("n") > 1).alias("duplicate_groups"),
    )


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column: NULLs and their share, from one pass."""
    wide = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return wide.unpivot("_rows", df.columns, "column", "nulls").select(
        "column", "nulls", F.col("_rows").alias("rows"), F.round(100 * F.col("nulls") / F.nullif(F.col("_rows"), F.lit(0)), 1).alias("missing_pct")
    )


def row_text(df: DataFrame) -> Column:
    """Text of a whole row with its NULLs visible, columns in name order."""
    return F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in sorted(df.columns)])


def content_sum(text: Column) -> Column:
    """Order-independent sum of 60-bit row digests; equal rows count as often as they occur."""
    return F.sum(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")


def table_hash(df: DataFrame) -> DataFrame:
    """Row count and digest of the content, whatever the row order or the partitioning."""
    return df.agg(F.count("*").alias("rows"), F.coalesce(content_sum(row_text(df)).cast("string"), F.lit("0")).alias("digest"))


def manifest(tables: dict[str, DataFrame], **provenance: str) -> DataFrame:
    """Rows, columns and digest of each table, with the given provenance."""
    parts = [
        table_hash(df).select(
            F.lit(name).alias("table"), F.lit(",".join(sorted(df.columns))).alias("columns"), "rows", "digest",
            *[F.lit(v).alias(k) for k, v in provenance.items()],
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def verify_manifest(tables: dict[str, DataFrame], published: DataFrame) -> DataFrame:
    """Each table against its manifest line: ok, altered, missing from the manifest or missing on disk."""
    now = manifest(tables).select("table", F.col("rows").alias("rows_now"), F.col("digest").alias("digest_now"), F.col("columns").alias("columns_now"))
    state = (
        F.when(F.col("digest").isNull(), "not in manifest")
        .when(F.col("digest_now").isNull(), "missing")
        .when(
            (F.col("digest") == F.col("digest_now")) & (F.col("rows") == F.col("rows_now")) & (F.col("columns") == F.col("columns_now")),
            "ok",
        )
        .otherwise("altered")
    )
    return published.join(now, "table", "full_outer").select("table", "rows", "rows_now", state.alias("state"))


def snapshot_plan_check(files: DataFrame, plan: DataFrame) -> DataFrame:
    """Landed against planned files: (file, instant, state), state one of verified, missing, unexpected."""
    both = plan.select("file", "instant").join(files.select("file").distinct().withColumn("_here", F.lit(True)), "file", "full_outer")
    state = F.when(F.col("instant").isNull(), "unexpected").when(F.col("_here").isNull(), "missing").otherwise("verified")
    return both.select("file", "instant", state.alias("state"))


def snapshot_date_check(elements: DataFrame, snapshot: str, date: str, min_elements: int = 1, window_days: int = 730) -> DataFrame:
    """Per snapshot: whether nothing is newer than its date and something is from the two years before it."""
    valid = F.col("timestamp").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$")
    limit = F.col(date)
    since = F.date_format(F.try_to_timestamp(limit) - F.make_dt_interval(days=F.lit(window_days)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    grouped = elements.groupBy(snapshot, date).agg(
        F.count("*").alias("elements"),
        F.count_if(~F.coalesce(valid, F.lit(False))).alias("without_stamp"),
        F.max("timestamp").alias("newest"),
        F.count_if(F.col("timestamp") > limit).alias("newer"),
    )
    state = (
        F.when(F.col("elements") < min_elements, "too few elements")
        .when(F.col("without_stamp") > 0, "elements without a valid stamp")
        .when(F.col("newer") > 0, "date ignored")
        .when(F.col("newest") < since, "behind")
        .otherwise("ok")
    )
    return grouped.withColumn("state", state)




def completeness(rows: DataFrame, declared: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Rows found per file against the declared count; the current snapshot may deviate by `tolerance`.

    `declared` has file, expected, is_current; `rows` has one row per element with its file."""
    found = rows.groupBy("file").agg(F.count("*").alias("found"))
    both = declared.join(found, "file", "full_outer")
    n, e = F.coalesce("found", F.lit(0)), F.col("expected")
    close = F.abs(n - e) <= F.when(F.col("is_current"), e * tolerance).otherwise(0)
    state = (
        F.when(e.isNull(), "undeclared").when(F.col("found").isNull() & (e > 0), "missing").when(close, "complete").otherwise("incomplete")
    )
    return both.select("file", "expected", n.alias("found"), state.alias("state"))


def fingerprint(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Digest of the rows actually used, per group when asked."""
    subset = df.select(*by, *columns)
    text = row_text(subset.select(*columns))
    grouped = subset.groupBy(*by) if by else subset
    return grouped.agg(F.count("*").alias("rows"), content_sum(text).cast("string").alias("digest"))
