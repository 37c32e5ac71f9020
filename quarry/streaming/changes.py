"""Change logs and events as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.sources.store import Store, apply_changes


def change_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 10) -> DataFrame:
    """A change folder as a stream; the offset lives in the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def follow(changes: DataFrame, store: Store, table: str, keys: list[str], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Applies each micro-batch to the table: at least once, and applying again alters nothing."""

    def apply(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.change(table, batch.select(*keys), lambda rows: apply_changes(rows, batch, keys))

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def with_event_time(events: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Event time as a zoned timestamp under a watermark; a stream refuses times without a zone."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def windowed_counts(events: DataFrame, window: str, slide: str | None = None, by: str = "event_type", ts: str = "ts") -> DataFrame:
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return events.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")


def session_counts(events: DataFrame, gap: str, by: str = "user_id", ts: str = "ts") -> DataFrame:
    return events.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start_time"), F.col("w.end").alias("end_time"), "n")


def deduplicated(events: DataFrame, key: str = "event_id") -> DataFrame:
    return events.dropDuplicatesWithinWatermark([key])


def refresh(spark: SparkSession, source: DataFrame, rebuild: Callable[[DataFrame], None], checkpoint: str, seconds: int = 3600) -> StreamingQuery:
    """Rebuilds something from each micro-batch that isn't empty."""

    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            rebuild(batch)

    return source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def keep_batches(stream: DataFrame, path: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch from the tasks to a folder under `path`, until the source is read up; nothing passes through the driver. In mode
    complete a batch replaces the one before it. A batch that runs again overwrites its own folder."""
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{path}/batch-none")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch-{0 if mode == 'complete' else number}")

    return stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: States of a replica, and the state after each event.
TRANSITIONS = {
    ("disconnected", "connect"): "connecting", ("connecting", "connected"): "syncing", ("syncing", "caught_up"): "synced", ("synced", "behind"): "syncing",
    ("connecting", "failed"): "error", ("syncing", "failed"): "error", ("synced", "failed"): "error", ("error", "retry"): "connecting",
}


class ReplicaState:
    """Where a replica stands; a retry is refused after max_retries failures in a row."""

    def __init__(self, max_retries: int = 10):
        self.state, self.failures, self.max_retries = "disconnected", 0, max_retries

    def on(self, event: str) -> str:
        if event == "retry" and self.failures >= self.max_retries:
            return self.state
        self.state = TRANSITIONS.get((self.state, event), "disconnected" if event == "disconnect" else self.state)
        self.failures = 0 if self.state == "synced" else self.failures + (event == "failed")
        return self.state


def join_streams(left: DataFrame, right: DataFrame, key: str, within: str, ts: str = "ts") -> DataFrame:
    """Rows of two streams (each with a watermark on ts) with the same key, the right one at most `within` after the left one; Spark
    drops what can't meet any more. Columns of the right stream get the prefix right_."""
    r = right.select(*[F.col(c).alias(f"right_{c}") for c in right.columns])
    close = (F.col(f"right_{ts}") >= F.col(ts)) & (F.col(f"right_{ts}") <= F.col(ts) + F.expr(f"INTERVAL {within}"))
    return left.join(r, (F.col(key) == F.col(f"right_{key}")) & close)


def running_totals(events: DataFrame, by: str = "user_id", value: str = "value") -> DataFrame:
    """A stateful operator: for each key that a micro-batch has, its number of events and total since the stream began."""
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = events.schema[by].dataType.simpleString()

    def add(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for rows in batches:
            n, total = n + len(rows), total + float(rows[value].sum())
        state.update((n, total))
        yield pd.DataFrame({by: [key[0]], "n": [n], "total": [total]})

    grouped = events.select(by, value).groupBy(by)
    return grouped.applyInPandasWithState(add, f"{by} {kind}, n bigint, total double", "n bigint, total double", "update", GroupStateTimeout.NoTimeout)
