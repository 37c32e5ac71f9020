"""Point reads, key lookup and the exact -> prefix -> fuzzy cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.scalar import is_uuid, key_value
from quarry.operators.text import bm25


def live(entities: DataFrame, include_deleted: bool = False) -> DataFrame:
    return entities if include_deleted or "deleted_at" not in entities.columns else entities.where("deleted_at IS NULL")


def scan(entities: DataFrame, include_deleted: bool = False, limit: int | None = None, order: str = "id") -> DataFrame:
    """Live rows in the order of their ids."""
    out = live(entities, include_deleted).orderBy(order)
    return out if limit is None else out.limit(limit)


def get(entities: DataFrame, value, id_col: str = "id") -> DataFrame:
    """A row by id, deleted or not."""
    return entities.where(F.col(id_col) == F.lit(value))


def get_batch(entities: DataFrame, wanted: DataFrame, id_col: str = "id") -> DataFrame:
    """wanted (pos, id) with the entity's columns, null where there is none; repeated ids repeat."""
    other = entities.withColumnRenamed(id_col, "_id")
    return wanted.join(other, F.col("id") == F.col("_id"), "left").drop("_id")


def exists(entities: DataFrame, wanted: DataFrame, id_col: str = "id") -> DataFrame:
    """wanted (id) with found."""
    have = entities.select(F.col(id_col).alias("_id")).distinct()
    return wanted.join(have, F.col("id") == F.col("_id"), "left").select("id", F.col("_id").isNotNull().alias("found"))


def key_index(entities: DataFrame, entity_type: str, id_col: str = "id", key_field: str | None = None) -> DataFrame:
    """key_value, id, entity_type: derived from the rows, so it can't go stale."""
    return entities.select(key_value(entities.columns, key_field).alias("key_value"), F.col(id_col).cast("string").alias("id"), F.lit(entity_type).alias("entity_type")).where("key_value IS NOT NULL")


def lookup(index: DataFrame, keys: list[str], entity_type: str | None = None) -> DataFrame:
    """Index rows with one of the keys, in any table or one."""
    out = index.where(F.col("key_value").isin(keys))
    return out if entity_type is None else out.where(F.col("entity_type") == entity_type)


def first_by_key(index: DataFrame, keys: list[str]) -> DataFrame:
    """One row per table and key: that of the least id."""
    return lookup(index, keys).groupBy("entity_type", "key_value").agg(F.min("id").alias("id"))


def lookup_batch(index: DataFrame, keys: DataFrame, separator: str | None = None) -> DataFrame:
    """keys (pos, key) with the ids found for each, sorted; an empty list for none. With a separator, the ids as one text.

    A key's ids are gathered once, however many positions ask for it; positions that hold a key twice find its ids twice.
    """
    asked = keys.groupBy("pos", "key").agg(F.count("*").cast("int").alias("_times"))
    wanted = asked.select(F.col("key").alias("key_value"), "_times").distinct()
    lists = index.join(wanted.select("key_value").distinct(), "key_value", "left_semi").groupBy("key_value").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    own = wanted.join(lists, "key_value").withColumn("ids", F.when(F.col("_times") == 1, F.col("ids")).otherwise(F.flatten(F.transform("ids", lambda x: F.array_repeat(x, F.col("_times"))))))
    found = F.col("ids") if separator is None else F.array_join("ids", separator)
    none = F.array().cast(T.ArrayType(index.schema["id"].dataType)) if separator is None else F.lit("")
    # grouped again, so that the lists are made before the join and not for every position
    own = own.groupBy("key_value", "_times").agg(F.first(found).alias("ids")).withColumnRenamed("_times", "_n")
    both = asked.join(own, (F.col("key") == F.col("key_value")) & (F.col("_times") == F.col("_n")), "left")
    return both.select("pos", "key", F.coalesce("ids", none).alias("ids"))


def split_reference(c: str = "ref") -> list:
    """type and key of "type:key", split at the first colon."""
    return [F.substring_index(c, ":", 1).alias("entity_type"), F.expr(f"substring({c}, instr({c}, ':') + 1)").alias("key_value")]


def prefix(index: DataFrame, text: str, limit: int) -> DataFrame:
    return index.where(F.col("key_value").startswith(text)).orderBy("key_value", "id").limit(limit)


def fuzzy_cascade(index: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """key_value, id, score and stage: exact (1.0), else prefix (0.8), else BM25 over the keys' tokens.

    Only the first stage that finds anything answers, and later ones aren't run; an empty query finds nothing.
    """
    out = ("key_value", "id")
    if not query.strip():
        return index.select(*out, F.lit(0.0).alias("score"), F.lit(0).alias("stage")).limit(0)
    exact = index.where(F.col("key_value") == query).select(*out, F.lit(1.0).alias("score"), F.lit(1).alias("stage"))
    if not exact.isEmpty():
        return exact.orderBy("key_value", "id").limit(limit)
    start = prefix(index, query, limit).select(*out, F.lit(0.8).alias("score"), F.lit(2).alias("stage"))
    if not start.isEmpty():
        return start.orderBy("key_value", "id")
    scored = bm25(index.select("id", F.col("key_value").alias("text"), "key_value"), query, keep=["key_value"])
    return scored.orderBy(F.desc("score"), "key_value", "id").limit(limit).select(*out, "score", F.lit(3).alias("stage"))


def edit_search(index: DataFrame, query: str, threshold: float = 0.7, limit: int = 10) -> DataFrame:
    """Keys that share a trigram with the query, ranked by edit similarity of at least the threshold."""
    q = query.lower()
    grams = [q[i : i + 3] for i in range(max(1, len(q) - 2))]
    key = F.lower("key_value")
    shares = F.arrays_overlap(F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - 2, F.lit(1))), lambda i: F.substring(key, i, F.lit(3))), F.array(*[F.lit(g) for g in grams]))
    similarity = 1 - F.levenshtein(key, F.lit(q)) / F.greatest(F.length(key), F.lit(len(q)))
    return index.where(shares).withColumn("similarity", similarity).where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "key_value", "id").limit(limit)


def resolve(entities: DataFrame, references: DataFrame, key: str, ref_col: str = "ref") -> DataFrame:
    """references with found and the entity's id: "type:key" by key (the least id), a UUID by id, anything else not at all.
    entities: id, entity_type and the key column."""
    ref, by_id = F.col(ref_col), F.concat(F.lit("#"), F.lower(F.col(ref_col)))
    aim = F.when(is_uuid(ref_col), by_id).when(ref.contains(":"), ref)
    named = entities.select(F.concat_ws(":", "entity_type", F.col(key).cast("string")).alias("_aim"), F.col("id").cast("string").alias("entity_id"))
    named = named.unionByName(entities.select(F.concat(F.lit("#"), F.lower(F.col("id").cast("string"))).alias("_aim"), F.col("id").cast("string").alias("entity_id")))
    first = named.groupBy("_aim").agg(F.min("entity_id").alias("entity_id"))
    return references.withColumn("_ref", aim).join(first, F.col("_ref") == F.col("_aim"), "left").drop("_ref", "_aim").withColumn("found", F.col("entity_id").isNotNull())


def first_per_key(index: DataFrame) -> DataFrame:
    """Every key's first row."""
    w = Window.partitionBy("entity_type", "key_value").orderBy("id")
    return index.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
