"""Upkeep: tombstones, orphans, verification, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def vacuum(entities: DataFrame, before=None) -> DataFrame:
    """Rows without tombstones, or without those older than `before`."""
    old = F.col("deleted_at").isNotNull() if before is None else F.col("deleted_at") < F.lit(before)
    return entities.where(~F.coalesce(old, F.lit(False)))


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose key has no parent."""
    return rows.join(parents.select(F.col(parent_key).alias("_p")), F.col(key) == F.col("_p"), "left_anti")


def orphan_edges(edges: DataFrame, nodes: DataFrame, id_col: str = "id") -> DataFrame:
    """Edges of which an end is missing."""
    ids = nodes.select(F.col(id_col).alias("_id")).distinct()
    return edges.join(ids, F.col("src") == F.col("_id"), "left_anti").unionByName(edges.join(ids, F.col("src") == F.col("_id"), "left_semi").join(ids, F.col("dst") == F.col("_id"), "left_anti"))


def verify_embeddings(rows: DataFrame, dimension: int, vector_col: str = "embedding") -> DataFrame:
    """rows, missing, wrong_dimension, zero_norm."""
    n = F.size(vector_col)
    zero = F.aggregate(vector_col, F.lit(0.0), lambda s, x: s + F.abs(x)) == 0
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return rows.agg(F.count("*").alias("rows"), count(F.col(vector_col).isNull()).alias("missing"), count((n != dimension) & (n >= 0)).alias("wrong_dimension"), count(zero & (n == dimension)).alias("zero_norm"))


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Rewrites a table folder; the rebalance hint makes files of the session's advisory partition size."""
    spark.read.parquet(path).hint("rebalance").write.mode("errorifexists").parquet(target)
