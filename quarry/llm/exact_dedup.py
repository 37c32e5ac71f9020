"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Each step is one narrow aggregation, and only rows whose group has two or more members go on to
the next; full texts are read again only for the survivors. Copies are found by aggregation with
map-side combine, so a group that holds a third of all rows is never collected; where rows go back
to their groups, the most frequent groups are broadcast (a fixed number of them) and don't meet in one task.

Defined cases: a null text counts as empty; two texts are equal when they are the same after
deleting spaces, tabs, line feeds, vertical tabs, form feeds and carriage returns; of equal texts
the row with the most code points stays, then the smallest doc_id (null counts as the smallest); of
rows that are the same in both, one stays. An empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import join_frequent, stored

#: Up to so many surviving ids are broadcast (8 bytes each); beyond it they are joined by shuffle.
BROADCAST_IDS = 500_000


def normalised(text: Column) -> Column:
    for ch in " \t\n\x0b\f\r":
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64) -> DataFrame:
    """The groups of two or more equal texts: text_sha256 (binary), keep_id, keep_len, group_size."""
    texts = _texts(docs, id_col, text_col)
    norm = normalised(F.col("t"))
    narrow = stored(texts.select("d", F.length(norm).cast("long").alias("l"), F.xxhash64(F.length(norm), F.substring(norm, 1, prefix)).alias("p")), "exact-narrow")
    by_length = narrow.groupBy("l").agg(F.count("*").alias("n")).where("n > 1")
    rest = join_frequent(narrow, by_length, "l", "n", ["d"], "inner").select("d", "p")
    by_prefix = rest.groupBy("p").agg(F.count("*").alias("n")).where("n > 1")
    ids = stored(join_frequent(rest, by_prefix, "p", "n", ["d"], "inner").select(F.col("d").alias("s")).distinct(), "exact-survivors")
    survivors = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, F.col("d").eqNullSafe(F.col("s")), "left_semi")
    full = survivors.select("d", F.length("t").alias("n"), F.unhex(F.sha2(norm, 256)).alias("h"))
    return (
        full.groupBy("h")
        .agg(F.count("*").alias("group_size"), F.min(F.struct((-F.col("n")).alias("n"), "d")).alias("best"))
        .where("group_size > 1")
        .select(F.col("h").alias("text_sha256"), F.col("best.d").alias("keep_id"), (-F.col("best.n")).alias("keep_len"), "group_size")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256 (lowercase hex).

    The label of every row carries its full hash; the groups come from copy_groups().
    """
    groups = stored(copy_groups(docs, id_col, text_col, prefix).withColumnRenamed("text_sha256", "h"), "exact-groups")
    rows = (
        _texts(docs, id_col, text_col)
        .select("d", F.length("t").alias("n"), F.unhex(F.sha2(normalised(F.col("t")), 256)).alias("h"))
        .groupBy("d", "n", "h")
        .agg(F.count("*").alias("m"))
    )
    rows = join_frequent(rows, groups, "h", "group_size", ["d", "n"])
    alone = F.col("group_size").isNull()
    best = alone | (F.col("d").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_len")))
    return rows.select("*", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("i")).select(
        F.col("d").alias("doc_id"),
        F.when(alone, F.col("d")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (best & (F.col("i") == 1)).alias("kept"),
        F.lower(F.hex("h")).alias("text_sha256"),
    )
