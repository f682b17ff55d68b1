"""Streaming form of the collection cycle, the hourly rollup, the latest state and the gap watch."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayloom.operators import medallion as M
from wayloom.schemas import MEASUREMENT_KEY, ROUTE

LATE = "3 hours"
STALE_MINUTES = 90
_STATE = "latest_us long, latest_id long, data_source string, travel_time_min double, traffic_us long, traffic_id long, traffic_delay_min double, stale boolean"


def event_time(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Watermarks need an instant with time zone."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def hourly_rollup(stream: DataFrame, ts: str = "timestamp", late: str = LATE) -> DataFrame:
    """Tumbling hourly figures per route; rows later than the watermark are not in them."""
    high = F.when(F.col("travel_time_min") > 20, 1.0).otherwise(0.0)
    return (
        stream.withWatermark(ts, late)
        .groupBy(F.window(ts, "1 hour").alias("w"), *ROUTE)
        .agg(F.count("*").alias("num_trips"), F.avg("travel_time_min").alias("avg_duration_min"), F.avg("distance_km").alias("avg_distance_km"),
             (F.avg(high) * 100).alias("pct_alta_demora"))
        .select(F.col("w.start").alias("hour"), *ROUTE, "num_trips", "avg_duration_min", "avg_distance_km", "pct_alta_demora")
    )


def sliding_statistics(stream: DataFrame, ts: str = "timestamp", width: str = "1 hour", slide: str = "5 minutes", late: str = LATE) -> DataFrame:
    """Rolling figures per route over the last `width`, renewed every `slide`."""
    return (
        stream.withWatermark(ts, late)
        .groupBy(F.window(ts, width, slide).alias("w"), *ROUTE)
        .agg(F.count("*").alias("n"), F.avg("travel_time_min").alias("avg_travel_time"))
        .select(F.col("w.end").alias("until"), *ROUTE, "n", "avg_travel_time")
    )


def once_per_key(stream: DataFrame, ts: str = "timestamp", late: str = LATE) -> DataFrame:
    """One row per instant, route and source within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([*MEASUREMENT_KEY, "data_source"])


def both_sources(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two sources on their own clocks as one stream."""
    return first.unionByName(second, allowMissingColumns=True)


def latest_state(stream: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Per route the newest row and the newest row with traffic, for update or complete mode. The state is one row per
    route. Whether a state is stale is a question of reading time: see `with_staleness`."""
    row = F.struct(ts, "id", "data_source", "travel_time_min")
    seen = F.when(F.col("traffic_delay_min").isNotNull(), F.struct(ts, "id", "traffic_delay_min"))
    return stream.groupBy(*ROUTE).agg(F.max(row).alias("latest"), F.max(seen).alias("traffic"))


def with_staleness(state: DataFrame, as_of: str, minutes: int = 90, ts: str = "timestamp") -> DataFrame:
    limit = F.lit(as_of).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes))
    at = F.col(f"traffic.{ts}")
    return state.withColumn("stale", at.isNull() | (at < limit))


def _fold_state(minutes: int) -> Callable:
    """One micro-batch of a route: its new rows, or its timer."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _STATE.split(", ")]
        own = dict(zip(names, state.get, strict=True)) if state.exists else dict.fromkeys(names)
        if state.hasTimedOut:
            own["stale"] = True
        else:
            for rows in frames:
                newest = rows.sort_values(["us", "id"], kind="stable")
                last = newest.iloc[-1]
                if own["latest_us"] is None or (last["us"], last["id"]) >= (own["latest_us"], own["latest_id"]):
                    travel = last["travel_time_min"]
                    own |= {"latest_us": int(last["us"]), "latest_id": int(last["id"]), "data_source": last["data_source"], "travel_time_min": None if pd.isna(travel) else float(travel)}
                seen = newest[newest["traffic_delay_min"].notna()]
                if len(seen):
                    last = seen.iloc[-1]
                    if own["traffic_us"] is None or (last["us"], last["id"]) >= (own["traffic_us"], own["traffic_id"]):
                        own |= {"traffic_us": int(last["us"]), "traffic_id": int(last["id"]), "traffic_delay_min": float(last["traffic_delay_min"])}
            due = None if own["traffic_us"] is None else own["traffic_us"] // 1000 + minutes * 60_000
            own["stale"] = due is None or due < state.getCurrentWatermarkMs()
            if not own["stale"]:
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        state.update(tuple(own.values()))
        yield pd.DataFrame([[*key, *own.values()]], columns=[*ROUTE, *names])

    return fold


def live_state(stream: DataFrame, minutes: int = STALE_MINUTES, ts: str = "timestamp", late: str = "10 minutes") -> DataFrame:
    """Per route the newest row, the newest reading with traffic and whether that is stale, for update mode.

    The state is one row per route with a timer `minutes` behind its newest traffic reading. A micro-batch gives the routes it
    has rows for, and those whose timer the watermark has passed: a route that goes silent turns stale by the progress of the
    others, without a row of its own. Rows later than the watermark are not seen; a route without any traffic reading is stale."""
    columns = ["id", "data_source", "travel_time_min", "traffic_delay_min"]
    rows = stream.withWatermark(ts, late).select(*ROUTE, ts, F.unix_micros(ts).alias("us"), *columns)
    schema = ", ".join([*(f"{c} string" for c in ROUTE), _STATE])
    return rows.groupBy(*ROUTE).applyInPandasWithState(_fold_state(minutes), schema, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def sessions(stream: DataFrame, gap: str = "2 hours", ts: str = "timestamp", late: str = LATE) -> DataFrame:
    """Stretches of each source without a silence of `gap`; the space between two of them is a gap."""
    return (
        stream.withWatermark(ts, late)
        .groupBy(F.session_window(ts, gap).alias("s"), "data_source")
        .agg(F.count("*").alias("n"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))
        .select("data_source", "first_seen", "last_seen", "n")
    )


# --- incremental medallion -------------------------------------------------------------------------------------------
def ingest_batch(path: str, at: str):
    """Sink of one micro-batch: new bronze keys, their silver rows, and gold again for the days the batch touches.

    Every step starts from what is stored, so running a batch twice, or after a stop between two steps, ends the same."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = M.bronze(batch, ["id"], at).withColumn("date", F.to_date("raw_timestamp")).persist()
        days = rows.select("date").distinct()
        _append(rows, f"{path}/bronze", ["raw_timestamp", *ROUTE], days)
        touched = spark.read.parquet(f"{path}/bronze").join(days, "date", "left_semi").drop("date")
        _append(M.silver(touched, at).withColumn("date", F.to_date("timestamp")), f"{path}/silver", MEASUREMENT_KEY, days)
        M.write_gold(spark.read.parquet(f"{path}/silver").join(days, "date", "left_semi").drop("date"), path)
        rows.unpersist()

    return write


def _append(rows: DataFrame, path: str, key: list[str], days: DataFrame) -> None:
    """Adds the rows whose key is not stored yet, looking only at the stored days that matter."""
    spark = rows.sparkSession
    if M.path_exists(spark, path):
        stored = spark.read.parquet(path).join(days, "date", "left_semi")
        rows = M.insert_absent(rows, stored, key)
    rows.write.mode("append").partitionBy("date").parquet(path)


def medallion_stream(stream: DataFrame, path: str, checkpoint: str, at: str):
    return stream.writeStream.foreachBatch(ingest_batch(path, at)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- running to the end ----------------------------------------------------------------------------------------------
def scratch(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder; a local one only where the session runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="wayloom-stream-")
    return f"{base}/{uuid.uuid4().hex}"


def run_complete(result: DataFrame, spark: SparkSession) -> DataFrame:
    """Processes everything available in complete mode; each micro-batch replaces the written state, the last one is read."""
    folder = scratch(spark)

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    query = result.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/out")


def run_update(result: DataFrame, spark: SparkSession, keys: list[str], folder: str | None = None) -> DataFrame:
    """Processes everything available in update mode and reads the newest row of each key. A micro-batch writes its changes to a
    folder of its own, so one that runs again replaces what it wrote; what has not changed is not written again."""
    folder = folder or scratch(spark)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    query = result.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rest = [c for c in result.columns if c not in keys]
    changes = spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*").select(result.columns)


def run_available(result: DataFrame, spark: SparkSession) -> DataFrame:
    """Processes everything available in append mode and reads the written result."""
    folder = scratch(spark)
    query = (
        result.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/out")
