"""Live state of routes: timers, late rows, batches that run again."""

import datetime as dt

from wayloom.schemas import ROUTE
from wayloom.streaming import jobs as J

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "origin string, destination string, timestamp timestamp, id long, data_source string, travel_time_min double, traffic_delay_min double"


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def run(spark, folder, batches):
    """Each batch is a file; the stream stops after each and goes on from its checkpoint."""
    state = None
    for i, rows in enumerate(batches):
        data = [(o, "x", at(m), n, "traffic", 5.0 + n, delay) for o, m, n, delay in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{i}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        state = J.run_update(J.live_state(stream), spark, ROUTE, f"{folder}/job")
    return {r["origin"]: r for r in state.collect()}


def test_a_silent_route_turns_stale_without_a_row(spark, tmp_path):
    first = [("a", 0, 1, 2.0), ("b", 0, 2, 3.0), ("c", 0, 3, None)]
    got = run(spark, str(tmp_path / "one"), [first])
    assert {k: r["stale"] for k, r in got.items()} == {"a": False, "b": False, "c": True}
    got = run(spark, str(tmp_path / "two"), [first, [("b", 95, 4, 1.0)], [("b", 120, 5, None)]])
    assert {k: r["stale"] for k, r in got.items()} == {"a": True, "b": False, "c": True}
    assert (got["a"]["latest_id"], got["a"]["traffic_delay_min"]) == (1, 2.0)
    assert (got["b"]["latest_id"], got["b"]["traffic_id"], got["b"]["traffic_delay_min"]) == (5, 4, 1.0)


def test_only_changes_are_written_and_a_stale_route_comes_back(spark, tmp_path):
    folder = str(tmp_path / "job")
    got = run(spark, folder, [[("a", 0, 1, 2.0), ("b", 0, 2, 3.0)], [("b", 200, 3, 1.0)], [("b", 230, 4, 1.0)], [("a", 231, 5, 4.0), ("b", 225, 6, 9.0)]])
    assert not got["a"]["stale"] and got["a"]["traffic_delay_min"] == 4.0
    assert got["b"]["latest_id"] == 4  # the older row does not take its place
    written = spark.read.parquet(f"{folder}/job/out").groupBy("batch").count().collect()
    assert sum(r["count"] for r in written) < 2 * len(written)
