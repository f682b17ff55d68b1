"""Table of the locality and street of each cell as CSV with a manifest, read back only where both agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.operators.quality import manifest, verify_manifest
from wayloom.sources.tables import path_exists

# Columns of the table in their order, its format and how far away a street may be to be named.
COLUMNS = ("cell_id", "localidad", "osm_relacion", "criterio", "calle", "calle_m")
FORMAT, STREET_WITHIN_M = 2, 150.0
NAME = "cell_places"


def _text(places: DataFrame) -> DataFrame:
    """All columns as the text that the file holds: nothing is an empty field, distances have one digit."""
    shown = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in COLUMNS}
    shown["calle_m"] = F.when(F.col("calle_m").isNull(), "").otherwise(F.format_string("%.1f", F.col("calle_m").cast("double")))
    return places.select(*[shown[c].alias(c) for c in COLUMNS])


def _read(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{c} string" for c in COLUMNS)
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(f"{path}/{NAME}").na.fill("")


def write_cell_places(spark: SparkSession, places: DataFrame, path: str, **provenance: str) -> DataFrame:
    """Write the table and then its manifest under `path`; returns the manifest, one row with the counts of cells without a
    locality, with one by nearness and without a street. The counts and the digest are those of the file as it reads."""
    _text(places).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/{NAME}")
    written = _read(spark, path)
    counts = written.agg(
        F.count_if(F.col("localidad") == "").alias("sin_localidad"), F.count_if(F.col("criterio") == "cercana").alias("por_cercania"),
        F.count_if(F.col("calle") == "").alias("sin_calle"),
    ).first()
    listing = manifest({NAME: written}, **provenance).withColumns(
        {**{c: F.lit(counts[c]) for c in counts.asDict()}, "formato": F.lit(FORMAT), "calle_max_m": F.lit(STREET_WITHIN_M)}
    )
    listing.write.mode("overwrite").json(f"{path}/manifest")
    return listing


def verify_cell_places(spark: SparkSession, path: str) -> list[str]:
    """What is wrong with the table under `path`: no manifest, no table, another format, or other rows than written."""
    missing = [part for part in ("manifest", NAME) if not path_exists(spark, f"{path}/{part}")]
    if missing:
        return [f"{part} is missing" for part in missing]
    listing = spark.read.json(f"{path}/manifest")
    if "formato" not in listing.columns or listing.filter(F.col("formato") == FORMAT).isEmpty():
        return [f"not of format {FORMAT}"]
    states = verify_manifest({NAME: _read(spark, path)}, listing).filter("state <> 'ok'")
    return [f"{r['table']}: {r['state']}" for r in states.collect()]


def read_cell_places(spark: SparkSession, path: str) -> DataFrame | None:
    """(cell_id, localidad, calle), empty text where unknown; None where the table is missing or not as its manifest says."""
    if verify_cell_places(spark, path):
        return None
    return _read(spark, path).select("cell_id", "localidad", "calle")
