"""Exact nearest neighbours, thresholds, tiers, medoid and diversity pruning.

All searches are exact: distances come from one pass over the rows and the top k from a bounded sort in
each task, so no index has to be built or kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.vectors import METRICS, as_vector
from quarry.session import cut


def with_distance(rows: DataFrame, query: list[float], metric: str = "cosine", vector_col: str = "embedding") -> DataFrame:
    """Rows whose vector has the query's dimension, with distance."""
    sized = rows.where(F.size(vector_col) == len(query))
    return sized.withColumn("distance", METRICS[metric](F.col(vector_col), as_vector(query)))


def top_k(rows: DataFrame, query: list[float], k: int, metric: str = "cosine", id_col: str = "id", vector_col: str = "embedding", where: Column | None = None, min_score: float | None = None, mode: str = "pre") -> DataFrame:
    """The k nearest rows by (distance, id), with distance and score (1 - distance).

    mode "pre" filters first; "post" fetches 2k, filters, and takes k of what is left.
    """
    if where is not None and mode == "pre":
        rows = rows.where(where)
    found = with_distance(rows, query, metric, vector_col).withColumn("score", 1 - F.col("distance"))
    if where is not None and mode == "post":
        found = found.orderBy("distance", id_col).limit(2 * k).where(where)
    if min_score is not None:
        found = found.where(F.col("score") >= min_score)
    return found.orderBy("distance", id_col).limit(k)


def query_vector(rows: DataFrame, value, id_col: str = "id", vector_col: str = "embedding") -> list[float]:
    """The vector of one row."""
    row = rows.where(F.col(id_col) == F.lit(value)).select(vector_col).first()
    if row is None:
        raise KeyError(value)
    return [float(x) for x in row[0]]


def merge_ranked(a: DataFrame, b: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """The k nearest of two ranked lists."""
    return a.unionByName(b).orderBy("distance", id_col).limit(k)


def with_tier(rows: DataFrame, created: Column, as_of: Column, hot_days: int = 30) -> DataFrame:
    """tier: hot if created in the last hot_days before as_of."""
    return rows.withColumn("tier", F.when(created >= as_of - F.expr(f"INTERVAL {hot_days} DAYS"), "hot").otherwise("cold"))


def tiered_top_k(rows: DataFrame, query: list[float], k: int, id_col: str = "id", metric: str = "cosine") -> DataFrame:
    """Top k of each tier by one metric, merged."""
    hot = top_k(rows.where("tier = 'hot'"), query, k, metric, id_col)
    return merge_ranked(hot, top_k(rows.where("tier = 'cold'"), query, k, metric, id_col), k, id_col)


def quantised_top_k(rows: DataFrame, query: list[float], k: int, id_col: str = "id", vector_col: str = "embedding", factor: int = 10) -> DataFrame:
    """Fetches factor * k by 8-bit codes of the unit range found in the data, then ranks those exactly."""
    low, high = rows.select(F.min(F.array_min(vector_col)), F.max(F.array_max(vector_col))).first()
    step = (high - low) / 255 or 1.0
    code = F.transform(vector_col, lambda x: F.round((x - F.lit(low)) / F.lit(step)))
    wanted = [round((x - low) / step) for x in query]
    rough = rows.withColumn("_rough", METRICS["squared_l2"](code, as_vector(wanted))).orderBy("_rough", id_col).limit(factor * k).drop("_rough")
    return top_k(rough, query, k, "cosine", id_col, vector_col)


def distance_sums(rows: DataFrame, references: DataFrame, id_col: str = "id", vector_col: str = "embedding", metric: str = "l2", block: int = 1000) -> DataFrame:
    """id, total: each row's sum of distances to a reference set; rows without a vector have no sum and add to none.

    Equal vectors count once, with their number. Both sides are dealt into blocks of about `block` vectors, every block of
    rows meets every block of references, and a task holds one pair of blocks at a time.
    """
    import numpy as np
    import pyarrow as pa

    one = F.col(vector_col).cast("array<double>").alias("_v")
    vectors = cut(rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), one), "vectors")
    left = vectors.select("_v").distinct()
    right = references.where(F.col(vector_col).isNotNull()).select(one).groupBy("_v").agg(F.count("*").cast("double").alias("_w"))
    left, right = (cut(x.withColumn("_h", F.xxhash64("_v")), "distinct-vectors") for x in (left, right))
    parts = [max(1, -(-x.count() // block)) for x in (left, right)]
    tasks = min(parts[0], 4 * rows.sparkSession.sparkContext.defaultParallelism)
    left, right = (x.withColumn("_b", F.pmod("_h", F.lit(n))) for x, n in zip((left, right), parts))
    left = left.repartition(tasks, "_b").groupBy("_b").agg(F.collect_list("_h").alias("_h"), F.collect_list("_v").alias("_rows"))
    right = right.groupBy("_b").agg(F.collect_list("_w").alias("_w"), F.collect_list("_v").alias("_refs")).select("_w", "_refs")

    def matrix(column, i: int):
        lists = column[i].values
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        if len(flat) % len(lists) or len(set(lists.value_lengths().to_pylist())) > 1:
            raise ValueError("vectors differ in dimension")
        return flat.reshape(len(lists), -1)

    def sums(batches):
        at, held, total = None, None, None
        for batch in batches:
            for i, b in enumerate(batch.column("_b").to_pylist()):
                if b != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([held[0], pa.array(total)], names=["_h", "total"])
                    at, held = b, (batch.column("_h")[i].values, matrix(batch.column("_rows"), i))
                    total = np.zeros(len(held[1]))
                total += pair_distances(held[1], matrix(batch.column("_refs"), i), metric) @ batch.column("_w")[i].values.to_numpy(zero_copy_only=False)
        if at is not None:
            yield pa.RecordBatch.from_arrays([held[0], pa.array(total)], names=["_h", "total"])

    partial = left.crossJoin(right).select("_b", "_h", "_rows", "_w", "_refs").mapInArrow(sums, "_h bigint, total double")
    totals = partial.groupBy("_h").agg(F.sum("total").alias("total"))
    return vectors.select("id", F.xxhash64("_v").alias("_h")).join(totals, "_h").groupBy("id").agg(F.sum("total").alias("total"))


def pair_distances(a, b, metric: str = "l2"):
    """Distances of all rows of one matrix to all of another. Close pairs, whose terms nearly cancel, are taken from their differences."""
    import numpy as np

    na, nb = (a * a).sum(1), (b * b).sum(1)
    dots = a @ b.T
    if metric == "cosine":
        n = np.sqrt(na)[:, None] * np.sqrt(nb)
        return np.where(n == 0, 1.0, 1 - dots / np.where(n == 0, 1.0, n))
    both = na[:, None] + nb
    dots *= -2
    dots += both
    i, j = np.nonzero(dots <= 1e-6 * both)
    for k in range(0, len(i), 20_000):
        x, y = i[k : k + 20_000], j[k : k + 20_000]
        dots[x, y] = ((a[x] - b[y]) ** 2).sum(1)
    if metric == "squared_l2":
        return dots
    if metric != "l2":
        raise KeyError(metric)
    return np.sqrt(dots, out=dots)


def medoid(rows: DataFrame, id_col: str = "id", vector_col: str = "embedding", sample: int | None = None, digits: int | None = None) -> DataFrame:
    """The row with the least sum of L2 distances to all rows; to the `sample` rows of least hash only if that is given.
    With `digits`, sums are rounded first, and the least id of the equal ones is taken."""
    reference = rows if sample is None else rows.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    sums = distance_sums(rows, reference, id_col, vector_col)
    return (sums if digits is None else sums.withColumn("total", F.round("total", digits))).orderBy("total", "id").limit(1)


def robust_prune(candidates: DataFrame, query_col: str = "query_id", id_col: str = "id", vector_col: str = "embedding", alpha: float = 1.2, degree: int = 64, fetch: int = 256) -> DataFrame:
    """Per query, nearest first: a candidate stays if its distance to the query is less than alpha times that to each
    one that stayed, until `degree` have. candidates: query_id, id, distance, embedding.

    A round looks at the next `fetch` candidates of each query together with those that stayed, which is all that a
    task holds of a query. What is left and may still stay goes to the next round, until nothing is.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql import Window

    cols = [query_col, id_col, "distance", vector_col]
    schema = ", ".join(f"{c} {candidates.schema[c].dataType.simpleString()}" for c in cols)
    w = Window.partitionBy(query_col).orderBy("distance", id_col)

    def prune(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["distance", id_col])
        vectors = np.stack(rows[vector_col].to_numpy()).astype("float64")
        chosen = list(np.flatnonzero(rows["_kept"].to_numpy()))
        for i in np.flatnonzero(~rows["_kept"].to_numpy()):  # all farther than those that stayed before
            if len(chosen) < degree and (not chosen or rows["distance"].iloc[i] < alpha * np.linalg.norm(vectors[chosen] - vectors[i], axis=1).min()):
                chosen.append(i)
        return rows.iloc[chosen][cols]

    left, kept = candidates.select(*cols), candidates.select(*cols).limit(0)
    while True:
        numbered = left.withColumn("_n", F.row_number().over(w))
        block = cut(numbered.where(F.col("_n") <= fetch).drop("_n").withColumn("_kept", F.lit(False)), "prune-block")
        if block.isEmpty():
            return kept.drop(vector_col)
        old = kept.join(block.select(query_col).distinct(), query_col, "left_semi").withColumn("_kept", F.lit(True)).select(*cols, "_kept")
        done = kept.join(block.select(query_col).distinct(), query_col, "left_anti")
        kept = cut(done.unionByName(block.unionByName(old).groupBy(query_col).applyInPandas(prune, schema)), "prune-kept")
        last = block.groupBy(query_col).agg(F.max(F.struct("distance", id_col)).alias("_last"))
        full = kept.groupBy(query_col).agg(F.count("*").alias("_have"), F.collect_list(vector_col).alias("_own"))  # degree vectors at most
        after = left.join(last, query_col).where(F.struct("distance", id_col) > F.col("_last")).join(full, query_col).where(F.col("_have") < degree)
        may_stay = F.forall("_own", lambda v: F.col("distance") < alpha * METRICS["l2"](F.col(vector_col), v))
        left = cut(after.where(may_stay).select(*cols), "prune-left")
