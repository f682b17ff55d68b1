"""Cell places written, verified and read back."""

import pytest
from pyspark.sql import functions as F

from wayloom.sources.cells import read_cell_places, verify_cell_places, write_cell_places

SCHEMA = "cell_id string, localidad string, osm_relacion long, criterio string, calle string, calle_m double"
ROWS = [("1_1", "Sliema", 12, "dentro", 'Triq "il-Kbira", 3', 12.345), ("1_2", "", None, "", "", None), ("2_1", "Msida", 7, "cercana", "Triq\nNova", 149.96), ("2_2", None, None, None, "Ħamrun", 0.04)]


@pytest.fixture
def written(spark, tmp_path):
    path = str(tmp_path / "places")
    return path, write_cell_places(spark, spark.createDataFrame(ROWS, SCHEMA).repartition(2), path, origen="test").first()


def test_round_trip(spark, written):
    path, listing = written
    assert (listing["rows"], listing["sin_localidad"], listing["por_cercania"], listing["sin_calle"], listing["origen"]) == (4, 2, 1, 1, "test")
    assert verify_cell_places(spark, path) == []
    got = {r["cell_id"]: (r["localidad"], r["calle"]) for r in read_cell_places(spark, path).collect()}
    assert got == {r[0]: (r[1] or "", r[4] or "") for r in ROWS}


def test_altered_or_missing_tables_are_not_read(spark, written, tmp_path):
    path, _ = written
    assert read_cell_places(spark, str(tmp_path / "nothing")) is None
    spark.createDataFrame(ROWS, SCHEMA).limit(1).withColumn("osm_relacion", F.lit("x")).write.mode("append").option("header", True).csv(f"{path}/cell_places")
    assert verify_cell_places(spark, path) == ["cell_places: altered"] and read_cell_places(spark, path) is None


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    write_cell_places(spark, spark.createDataFrame([], SCHEMA), path)
    assert read_cell_places(spark, path).collect() == []
