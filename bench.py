"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from wayloom.plans import registry  # noqa: E402
from wayloom.session import build_session  # noqa: E402

HEADLINE = [
    "route_daily_kpis", "route_rankings_reliability_score", "data_profile", "all_routes_statistics", "latest_per_route",
    "lag5_mean", "collection_gap_report", "route_hour_heatmap", "stratified_att", "change_points", "rolling_origin_summary",
    "cell_counts", "neighborhood_sum", "panorama", "zone_score", "zone_category_counts", "neighbour_counts_250",
    "closure_levels", "poi_upsert", "population_reconciled", "keyword_category",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
           "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR"},
    )
    queries = registry.queries()
    queries["database_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
