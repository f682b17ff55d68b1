"""Queries that read the whole of their tables, beside those that read part."""

import __spark_entry__ as entry
from wayloom.plans import common as C

SF = "/root/testdata/sf0.001"


def test_cell_counts_and_ring_sums_have_every_category(spark):
    queries = entry.queries()
    want = {(r["category"], r["subcategory"]) for r in queries["cell_counts"](spark, SF).collect()}
    assert len(want) > 4
    assert {(r["category"], r["subcategory"]) for r in queries["long_cell_counts_all_pairs"](spark, SF).collect()} == want
    assert set(queries["wide_cell_counts_all_pairs"](spark, SF).columns) == {"fila", "col"} | {"|".join(p) for p in want}
    for ring in (0, 1, 2):
        assert {r["category"] for r in queries[f"ring_sum_{ring}_by_category"](spark, SF).collect()} == {c for c, _ in want}


def test_every_point_has_a_locality_or_none(spark):
    rows = entry.queries()["localities_by_criterion"](spark, SF).collect()
    assert {"dentro", "cercana"} <= {r["criterio"] for r in rows}
    assert sum(r["n"] for r in rows) == C.pois(spark, SF).count()
