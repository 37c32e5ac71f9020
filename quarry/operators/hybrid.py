"""Fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reciprocal_rank(lists: list[DataFrame], k: int = 60, id_col: str = "id") -> DataFrame:
    """id, score: the sum of 1 / (k + rank) over ranked lists (id, rank from 0)."""
    parts = [d.select(F.col(id_col).alias("id"), (1.0 / (k + F.col("rank"))).alias("part")) for d in lists]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("part").alias("score"))


def ranked(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first `limit` rows with rank from 0: a bounded sort, then numbers on what is left."""
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def weighted(vector: DataFrame, text: DataFrame, alpha: float = 0.7, beta: float = 0.3) -> DataFrame:
    """id, score: weighted sum of both lists' scores (id, score), each scaled to 0..1; a missing one counts as 0."""

    def scaled(d: DataFrame, name: str) -> DataFrame:
        ends = d.agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
        x = F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise((F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
        return d.join(F.broadcast(ends)).select("id", x.alias(name))  # ends is one row

    both = scaled(vector, "v").join(scaled(text, "t"), "id", "full")
    return both.select("id", (alpha * F.coalesce("v", F.lit(0.0)) + beta * F.coalesce("t", F.lit(0.0))).alias("score"))


def two_stage(first: DataFrame, rows: DataFrame, rescore: Column, fetch: int, k: int, id_col: str = "id") -> DataFrame:
    """The `fetch` best of first (id, score), scored again on rows and cut to the k best."""
    few = first.orderBy(F.desc("score"), "id").limit(fetch).select(F.col("id").alias("_id"))
    return rows.join(few, F.col(id_col) == F.col("_id")).select(F.col(id_col).alias("id"), rescore.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def recency_boost(rows: DataFrame, age_days: Column, half_life: float = 30.0) -> DataFrame:
    """score times a factor that halves every half_life days."""
    return rows.withColumn("score", F.col("score") * F.pow(F.lit(0.5), age_days / half_life))
