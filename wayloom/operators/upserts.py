"""Key upserts, ordered dedupes, timestamp repair and table comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from wayloom.operators.chunks import with_one_row
from wayloom.functions.taxonomy import catch_all, reclassification
from wayloom.schemas import ROUTE


def upsert(existing: DataFrame, new: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """New rows replace old ones of the same key; of several, the highest version stays, new before old on a tie."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return last_wins(both, key, F.struct(version, "_new")).drop("_new")


def last_wins(df: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """One row per key: the one that comes last. Copies are folded before the exchange."""
    key = list(key)
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*key, "_row.*").select(*df.columns)


def coalescing_upsert(existing: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """A new NULL keeps the old value. Both sides hold one row per key."""
    key = list(key)
    rest = [c for c in existing.columns if c not in key]
    old = existing.select(*key, *[F.col(c).alias(f"_old_{c}") for c in rest])
    return new.join(old, key, "full_outer").select(*key, *[F.coalesce(F.col(c), F.col(f"_old_{c}")).alias(c) for c in rest])


def merge_context(pois: DataFrame, context: DataFrame) -> DataFrame:
    """POIs and context together; a context category that the POIs already bring is left out whole."""
    present = pois.select("category").distinct()
    return pois.unionByName(context.join(present, "category", "left_anti"), allowMissingColumns=True)


def duplicated_categories(pois: DataFrame, context: DataFrame) -> DataFrame:
    return context.select("category").distinct().join(pois.select("category").distinct(), "category", "left_semi")


def ordered(value: Column, kind: DataType) -> Column:
    """The value with every map, at any depth, as a list of entries sorted by key: equal maps then look the same."""
    if isinstance(kind, MapType):
        return F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"], ordered(e["value"], kind.valueType).alias("value"))))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda e: ordered(e, kind.elementType))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[ordered(value[f.name], f.dataType).alias(f.name) for f in kind]))
    return value


def unique_elements(elements: DataFrame, content: Sequence[str]) -> DataFrame:
    """One row per (type, id). Copies that differ are an error."""
    digest = F.xxhash64(*[F.to_json(F.struct(ordered(F.col(f.name), f.dataType))) for f in elements.schema if f.name in content])
    rest = [c for c in elements.columns if c not in ("type", "id")]
    grouped = elements.withColumn("_h", digest).groupBy("type", "id").agg(
        F.first(F.struct(*rest)).alias("_row"), F.min("_h").alias("_lo"), F.max("_h").alias("_hi")
    )
    same = F.when(F.col("_lo") != F.col("_hi"), F.raise_error(F.concat(F.lit("conflicting copies of "), "type", F.lit(" "), F.col("id").cast("string"))))
    checked = grouped.withColumn("_row", F.when(same.isNull(), F.col("_row")))
    return checked.select("type", "id", "_row.*")


def reclassify(pois: DataFrame) -> DataFrame:
    """Moves rows of a catch-all category to the specific category that claims their subcategory today."""
    claims = F.create_map(*[F.lit(x) for pair in reclassification().items() for x in pair])
    moved = F.when(F.col("category").isin(*catch_all()), F.try_element_at(claims, F.col("subcategory")))
    return pois.withColumn("category", F.coalesce(moved, F.col("category")))


def moved_counts(counts: DataFrame) -> DataFrame:
    """Cell counts with the pairs of a catch-all category under the category that claims them today. A table that holds
    both the old and the new pair is half-moved, and an error."""
    moved = reclassify(counts.withColumn("_from", F.col("category")))
    pair = moved.groupBy("category", "subcategory").agg(F.count_distinct("_from").alias("_froms"))
    broken = F.when(F.col("_froms") > 1, F.raise_error(F.lit("a pair exists under two categories")))
    checked = pair.select("category", "subcategory", broken.alias("_broken"))
    return moved.join(checked, ["category", "subcategory"]).filter(F.col("_broken").isNull()).drop("_from", "_broken")


# --- timestamp repair ------------------------------------------------------------------------------------------------
def is_legacy(raw: Column) -> Column:
    return raw.rlike(r"^\d{4}-\d{2}-\d{2} ")


def normalized(raw: Column) -> Column:
    """The first space, between date and time, becomes 'T'."""
    return F.when(is_legacy(raw), F.overlay(raw, F.lit("T"), F.lit(11), F.lit(1))).otherwise(raw)


def repair_plan(rows: DataFrame) -> DataFrame:
    """What to do with each row: keep, delete_twin (its ISO form exists), delete_dup (repeated old form) or rename."""
    key = ["_key", *ROUTE]
    marked = rows.withColumns({"_old": is_legacy(F.col("raw_timestamp")), "_key": normalized(F.col("raw_timestamp"))})
    groups = marked.groupBy(*key).agg(
        F.bool_or(~F.col("_old")).alias("_iso"), F.min(F.when(F.col("_old"), F.col("id"))).alias("_first")
    )
    action = (
        F.when(~F.col("_old"), "keep")
        .when(F.col("_iso"), "delete_twin")
        .when(F.col("id") > F.col("_first"), "delete_dup")
        .otherwise("rename")
    )
    return marked.join(groups, key).withColumn("action", action).withColumnRenamed("_key", "iso_timestamp").drop("_old", "_iso", "_first")


def repaired(plan: DataFrame) -> DataFrame:
    """The table after the plan."""
    kept = plan.filter(F.col("action").isin("keep", "rename"))
    stamp = F.when(F.col("action") == "rename", F.col("iso_timestamp")).otherwise(F.col("raw_timestamp"))
    return kept.withColumn("raw_timestamp", stamp).drop("action", "iso_timestamp")


def repair_checks(plan: DataFrame) -> DataFrame:
    """Post-conditions: old stamps left, rows against the expected number, duplicate key groups."""
    after = repaired(plan)
    groups = after.groupBy("raw_timestamp", *ROUTE).agg(F.count("*").alias("n"))
    counts = groups.agg(
        F.coalesce(F.sum(F.when(is_legacy(F.col("raw_timestamp")), F.col("n"))), F.lit(0)).alias("legacy_left"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count_if(F.col("n") > 1).alias("duplicate_groups"),
    )
    return with_one_row(counts, plan.agg(F.count_if(F.col("action").isin("keep", "rename")).alias("expected_rows")))


def apply_repair(rows: DataFrame, path: str) -> None:
    """Writes the repaired table as a new version next to the old one, once its checks hold."""
    plan = repair_plan(rows)
    checks = repair_checks(plan).first()
    if checks["legacy_left"] or checks["duplicate_groups"] or checks["rows"] != checks["expected_rows"]:
        raise RuntimeError(f"repair rejected: {checks.asDict()}")
    repaired(plan).write.mode("errorifexists").parquet(path)


# --- comparison ------------------------------------------------------------------------------------------------------
def table_diff(old: DataFrame, new: DataFrame, key: Sequence[str], group: str, tolerance: float = 1e-9) -> DataFrame:
    """Per group: rows only in one version, rows with a changed value, and the columns only one version has."""
    key = list(key)
    shared = [c for c in old.columns if c in new.columns and c not in key]
    numbers = {c for c, t in old.dtypes if t in ("double", "float", "int", "bigint")}
    a = old.select(*key, *[F.col(c).alias(f"_a_{c}") for c in shared], F.lit(True).alias("_in_old"))
    b = new.select(*key, *[F.col(c).alias(f"_b_{c}") for c in shared], F.lit(True).alias("_in_new"))
    both = a.join(b, key, "full_outer")
    changed = F.lit(False)
    for c in shared:
        x, y = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        differs = ~x.eqNullSafe(y)
        if c in numbers:
            differs = (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > tolerance, F.lit(False))
        changed = changed | differs
    matched = F.col("_in_old").isNotNull() & F.col("_in_new").isNotNull()
    missing = sorted(set(old.columns) - set(new.columns))
    extra = sorted(set(new.columns) - set(old.columns))
    return both.groupBy(group).agg(
        F.count_if(F.col("_in_new").isNull()).alias("rows_lost"),
        F.count_if(F.col("_in_old").isNull()).alias("rows_added"),
        F.count_if(matched & changed).alias("rows_changed"),
        F.lit(",".join(missing)).alias("columns_lost"),
        F.lit(",".join(extra)).alias("columns_added"),
    )


def clear_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same table with some columns emptied; doing it twice changes nothing more."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.lit(None).cast(kinds[c]) for c in columns})


# --- phrase sets -----------------------------------------------------------------------------------------------------
def phrase_checks(train: DataFrame, evaluation: DataFrame, text: str, label: str, classes: Sequence[str]) -> DataFrame:
    """Problems of two phrase sets as rows (problem, phrase): leaks, repeats, blanks, unknown classes."""
    sets = train.select(text, label, F.lit("train").alias("_set")).unionByName(
        evaluation.select(text, label, F.lit("evaluation").alias("_set"))
    )
    counts = sets.groupBy(text).agg(
        F.count_if(F.col("_set") == "train").alias("t"), F.count_if(F.col("_set") == "evaluation").alias("e")
    )
    def problem(name, rows):
        return rows.select(F.lit(name).alias("problem"), F.col(text).alias("phrase"))

    return (
        problem("leak", counts.filter((F.col("t") > 0) & (F.col("e") > 0)))
        .unionByName(problem("repeated", counts.filter((F.col("t") > 1) | (F.col("e") > 1))))
        .unionByName(problem("blank", sets.filter(F.trim(text) == "")))
        .unionByName(problem("unknown_class", sets.filter(~F.col(label).isin(*classes))))
    )


def agreement(df: DataFrame, a: str, b: str, agree: bool) -> DataFrame:
    same = F.col(a).eqNullSafe(F.col(b))
    return df.filter(same if agree else ~same)
