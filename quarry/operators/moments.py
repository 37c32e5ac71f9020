"""Time ranges, sessions of activity and sliding counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_range(rows: DataFrame, ts: str, start, end) -> DataFrame:
    """Rows with start <= ts <= end, in order of time."""
    return rows.where(F.col(ts).between(F.lit(start), F.lit(end))).orderBy(ts)


def overlapping(moments: DataFrame, start, end) -> DataFrame:
    """Moments that share time with the range."""
    return moments.where((F.col("start_time") < F.lit(end)) & (F.col("end_time") > F.lit(start)))


def sessionize(events: DataFrame, gap_seconds: int, key: str = "user_id", ts: str = "ts", order: str = "event_id", min_seconds: int = 0) -> DataFrame:
    """key, start_time, end_time, n_events: a gap of more than gap_seconds starts a new session."""
    w = Window.partitionBy(key).orderBy(ts, order)
    t = F.col(ts).cast("timestamp").cast("double")
    new = events.withColumn("_new", F.coalesce((t - F.lag(t).over(w) > gap_seconds).cast("int"), F.lit(1)))
    numbered = new.withColumn("_s", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy(key, "_s").agg(F.min(ts).alias("start_time"), F.max(ts).alias("end_time"), F.count("*").alias("n_events")).drop("_s")
    return out.where(F.col("end_time").cast("timestamp").cast("double") - F.col("start_time").cast("timestamp").cast("double") >= min_seconds)


def session_windows(events: DataFrame, gap: str, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """The same by Spark's session window, which also runs on a stream; a gap of exactly the limit splits."""
    timed = events.withColumn("_t", F.col(ts).cast("timestamp"))
    return timed.groupBy(key, F.session_window("_t", gap).alias("w")).agg(F.count("*").alias("n_events"), F.min("_t").alias("start_time"), F.max("_t").alias("end_time")).drop("w")


def active_keys(events: DataFrame, window: str = "5 minutes", slide: str = "5 minutes", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """window_start, active: distinct keys seen in each window."""
    timed = events.select(key, F.col(ts).cast("timestamp").alias("_t"))
    return timed.groupBy(F.window("_t", window, slide).alias("w")).agg(F.countDistinct(key).alias("active")).select(F.col("w.start").alias("window_start"), "active")


def moment_edges(moments: DataFrame) -> DataFrame:
    """src, dst, rel_type: a moment contains its resources and is captured in its sessions."""
    a = moments.select(F.col("name").alias("src"), F.explode("resource_ids").alias("dst"), F.lit("contains").alias("rel_type"))
    return a.unionByName(moments.select(F.col("name").alias("src"), F.explode("session_ids").alias("dst"), F.lit("captured_in").alias("rel_type")))
