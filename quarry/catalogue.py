"""Registered queries over the driver tables, and the SQL that each is held against."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import scalar as S
from quarry.functions.vectors import METRICS, as_vector
from quarry.operators import admin, aggregates, chunk, graph, hybrid, lookup, moments, sessions, text, vector
from quarry.operators import predicates as P
from quarry.sources import sinks, store
from quarry.sources.readers import transcript

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(c, n: int = 6):
    """Rounded, without a negative zero."""
    return F.round(c, n) + F.lit(0.0)


# --- scans, predicates, sort and limit ---


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 40 AND p_retailprice < 1500")
def scan_filter_project(spark, sf):
    return t(spark, sf, "part").where((F.col("p_size") > 40) & (F.col("p_retailprice") < 1500)).select("p_partkey", "p_name", "p_size")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = lower('building')")
def eq_ci(spark, sf):
    return t(spark, sf, "customer").where(P.eq("c_mktsegment", "building")).select("c_custkey", "c_mktsegment")


_SEG = "nullif(c_mktsegment, 'MACHINERY')"


def _segments(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("seg"))


@query(f"SELECT c_custkey, {_SEG} AS seg FROM customer WHERE {_SEG} IS NOT NULL AND lower({_SEG}) <> 'building'")
def ne_missing(spark, sf):
    return _segments(spark, sf).where(P.ne("seg", "Building"))


@query(f"SELECT c_custkey, {_SEG} AS seg FROM customer WHERE lower({_SEG}) IN ('building', 'household')")
def in_list(spark, sf):
    return _segments(spark, sf).where(P.is_in("seg", ["building", "HouseHold"]))


@query(f"SELECT c_custkey, {_SEG} AS seg FROM customer WHERE {_SEG} IS NULL OR lower({_SEG}) NOT IN ('building', 'household')")
def not_in_list(spark, sf):
    return _segments(spark, sf).where(P.not_in("seg", ["building", "HouseHold"]))


@query("SELECT o_orderkey, o_orderpriority LIKE '%-URG%' AS urgent, coalesce(NOT nullif(o_orderpriority, '1-URGENT') LIKE '_-HIGH', true) AS not_high FROM orders")
def like_not_like(spark, sf):
    o = t(spark, sf, "orders").withColumn("x", F.nullif("o_orderpriority", F.lit("1-URGENT")))
    return o.select("o_orderkey", P.like("o_orderpriority", "%-URG%").alias("urgent"), P.not_like("x", "_-HIGH").alias("not_high"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity >= 45 AND (l_returnflag = 'R' OR l_discount < 0.02)) OR (l_shipdate < TIMESTAMP '1993-01-01' AND NOT l_linestatus = 'O')")
def and_or_nested(spark, sf):
    ship = F.col("l_shipdate") < F.lit("1993-01-01").cast("timestamp_ntz")
    test = P.any_of(P.all_of(P.ge("l_quantity", 45), P.any_of(P.eq("l_returnflag", "R"), P.lt("l_discount", 0.02))), P.all_of(ship, P.negate(P.eq("l_linestatus", "O"))))
    return t(spark, sf, "lineitem").where(test).select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey FROM customer WHERE c_acctbal >= 1000 AND c_acctbal <= 2000 AND c_name > 'Customer#000000100'")
def ordered_predicates(spark, sf):
    return t(spark, sf, "customer").where(P.all_of(P.ge("c_acctbal", 1000), P.le("c_acctbal", 2000), P.gt("c_name", "Customer#000000100"))).select("c_custkey")


@query("SELECT p_partkey, contains(p_name, 'a') AS has_a, starts_with(p_type, 'S') AS starts_s, ends_with(p_brand, '3') AS ends_3, regexp_matches(p_brand, '#[12]') AS early FROM part")
def string_predicates(spark, sf):
    return t(spark, sf, "part").select("p_partkey", P.contains("p_name", "a").alias("has_a"), P.starts_with("p_type", "S").alias("starts_s"), P.ends_with("p_brand", "3").alias("ends_3"), P.matches("p_brand", "#[12]").alias("early"))


@query(f"SELECT seg IS NOT NULL AS has, count(*) AS n FROM (SELECT {_SEG} AS seg FROM customer) GROUP BY 1")
def exists_predicate(spark, sf):
    return _segments(spark, sf).groupBy(P.exists("seg").alias("has")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status FROM orders ORDER BY status ASC NULLS FIRST, o_orderkey OFFSET 7 LIMIT 25")
def order_limit_offset(spark, sf):
    o = t(spark, sf, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("F")))
    return P.Query(o).order_by("status").order_by("o_orderkey").offset(7).limit(25).select("o_orderkey", "status").run()


@query("SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status FROM orders ORDER BY status DESC NULLS LAST, o_orderkey DESC LIMIT 25")
def order_descending(spark, sf):
    o = t(spark, sf, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("F")))
    return P.Query(o).order_by("status", True).order_by("o_orderkey", True).limit(25).select("o_orderkey", "status").run()


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0 ORDER BY c_custkey LIMIT 20")
def scan_live(spark, sf):
    c = t(spark, sf, "customer").withColumn("deleted_at", F.when(F.col("c_custkey") % 3 == 0, F.lit("2024-01-01").cast("timestamp")))
    return lookup.scan(c, limit=20, order="c_custkey").select("c_custkey", "c_name")


# --- aggregates ---


@query("SELECT l_returnflag, count(*) AS count, round(sum(l_quantity), 4) AS sum, round(avg(l_extendedprice), 4) AS avg, min(l_discount) AS min, max(l_tax) AS max FROM lineitem GROUP BY l_returnflag")
def agg_count_sum_avg_min_max(spark, sf):
    a = aggregates
    return t(spark, sf, "lineitem").groupBy("l_returnflag").agg(a.count_rows(), r(a.total("l_quantity"), 4).alias("sum"), r(a.mean("l_extendedprice"), 4).alias("avg"), a.least("l_discount").alias("min"), a.greatest("l_tax").alias("max"))


@query("SELECT count(*) AS count, coalesce(sum(l_quantity), 0.0) AS sum, coalesce(avg(l_quantity), 0.0) AS avg, min(l_quantity) AS min FROM lineitem WHERE l_quantity > 1e9")
def agg_empty(spark, sf):
    a = aggregates
    return t(spark, sf, "lineitem").where("l_quantity > 1e9").agg(a.count_rows(), a.total("l_quantity").alias("sum"), a.mean("l_quantity").alias("avg"), a.least("l_quantity").alias("min"))


@query("SELECT o_orderstatus, coalesce(year(o_orderdate), 0) AS y, grouping(o_orderstatus) AS g, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus, year(o_orderdate)), (o_orderstatus), ())")
def grouping_sets(spark, sf):
    o = t(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    return o.rollup("o_orderstatus", "y").agg(F.grouping("o_orderstatus").cast("long").alias("g"), F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total")).withColumn("y", F.coalesce("y", F.lit(0)))


@query("SELECT p_brand, count(DISTINCT p_type) AS types FROM part GROUP BY p_brand HAVING count(*) > 5")
def group_having_distinct(spark, sf):
    return t(spark, sf, "part").groupBy("p_brand").agg(F.countDistinct("p_type").alias("types"), F.count("*").alias("n")).where("n > 5").drop("n")


@query("SELECT conv_id, CAST(sum(length(text) // 4) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) // 4 ELSE 0 END) AS BIGINT) AS output_tokens, round(sum((length(text) // 4) * 0.000002), 8) AS estimated_cost_usd, count(*) AS chunks FROM conversations GROUP BY conv_id")
def token_usage(spark, sf):
    n = S.estimate_tokens("text")
    c = t(spark, sf, "conversations").select("conv_id", n.alias("input_tokens"), F.when(F.col("role") == "assistant", n).otherwise(0).alias("output_tokens"), (n * 0.000002).alias("estimated_cost_usd"))
    return aggregates.token_usage(c, ["conv_id"]).withColumn("estimated_cost_usd", r(F.col("estimated_cost_usd"), 8))


@query("SELECT source, count(*) AS rows, avg(CASE WHEN labels.doc_id IS NULL THEN 0.0 ELSE 1.0 END) AS coverage FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def coverage_stats(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "source").join(t(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return aggregates.coverage(d, "source", F.col("quality")).drop("avg_bytes")


@query("SELECT o_orderstatus AS doc, round(avg(greatest(c - CASE WHEN q > 10 THEN 0.15 ELSE 0 END - CASE WHEN d < 0.8 THEN 0.2 ELSE 0 END, 0.0)), 6) AS quality FROM (SELECT o_orderstatus, (o_orderkey % 100) / 100.0 AS c, o_custkey % 20 AS q, (o_custkey % 10) / 10.0 AS d FROM orders) GROUP BY 1")
def document_quality(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderstatus").alias("doc"), (F.col("o_orderkey") % 100 / 100.0).alias("confidence"), (F.col("o_custkey") % 20).alias("n_columns"), (F.col("o_custkey") % 10 / 10.0).alias("ocr_confidence"))
    return aggregates.document_quality(o, "doc").select("doc", r(F.col("quality")).alias("quality"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def merge_concat(spark, sf):
    return aggregates.merge_chunks(t(spark, sf, "conversations"), ["conv_id"], "turn", "text", "concat")


@query("SELECT conv_id, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def merge_first_last(spark, sf):
    c = t(spark, sf, "conversations")
    a = aggregates.merge_chunks(c, ["conv_id"], "turn", "role", "first").withColumnRenamed("role", "first_role")
    return a.join(aggregates.merge_chunks(c, ["conv_id"], "turn", "role", "last").withColumnRenamed("role", "last_role"), "conv_id")


# --- keys ---


def _keys(spark, sf) -> DataFrame:
    n = t(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    g = t(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return lookup.key_index(n, "nation").unionByName(lookup.key_index(g, "region"))


_KEYS = "(SELECT n_name AS key_value, CAST(n_nationkey AS VARCHAR) AS id, 'nation' AS entity_type FROM nation UNION ALL SELECT r_name, CAST(r_regionkey AS VARCHAR), 'region' FROM region)"


@query(f"WITH k AS {_KEYS} SELECT k.* FROM k WHERE key_value IN (SELECT max(key_value) FROM k UNION ALL SELECT r_name FROM region WHERE r_regionkey < 2)")
def lookup_keys(spark, sf):
    k = _keys(spark, sf)
    names = [k.agg(F.max("key_value")).first()[0], *[x[0] for x in t(spark, sf, "region").where("r_regionkey < 2").select("r_name").collect()]]
    return lookup.lookup(k, names)


@query("SELECT p_partkey AS pos, n_name AS key, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY CAST(s_suppkey AS VARCHAR)) AS ids FROM part JOIN nation ON n_nationkey = p_size JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def lookup_batch_ids(spark, sf):
    """A key with many rows: the suppliers of a nation under its name."""
    n, s = t(spark, sf, "nation"), t(spark, sf, "supplier")
    index = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("key_value"), F.col("s_suppkey").cast("string").alias("id"), F.lit("supplier").alias("entity_type"))
    keys = t(spark, sf, "part").join(n, F.col("p_size") == F.col("n_nationkey")).select(F.col("p_partkey").alias("pos"), F.col("n_name").alias("key"))
    return lookup.lookup_batch(index, keys, ",").where(F.col("ids") != "")


@query("SELECT pos, key, coalesce(array_to_string(list_sort(list(CAST(s_suppkey AS VARCHAR)) FILTER (s_suppkey IS NOT NULL)), ','), '') AS ids FROM (SELECT p_partkey AS pos, (SELECT min(s_name) FROM supplier WHERE s_suppkey = p_partkey % 150) AS key FROM part) LEFT JOIN supplier ON s_name = key GROUP BY pos, key")
def lookup_batch(spark, sf):
    s = t(spark, sf, "supplier")
    keys = t(spark, sf, "part").select(F.col("p_partkey").alias("pos"), (F.col("p_partkey") % 150).alias("k")).join(s.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("key")), "k", "left").select("pos", "key")
    return lookup.lookup_batch(lookup.key_index(s, "supplier", "s_suppkey", "s_name"), keys, ",")


@query("SELECT p_partkey AS pos, p_size AS id, n_name FROM part LEFT JOIN nation ON n_nationkey = p_size")
def get_batch(spark, sf):
    wanted = t(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.col("p_size").alias("id"))
    return lookup.get_batch(t(spark, sf, "nation").select("n_nationkey", "n_name"), wanted, "n_nationkey")


@query("SELECT DISTINCT p_size AS id, p_size IN (SELECT n_nationkey FROM nation) AS found FROM part")
def exists_batch(spark, sf):
    return lookup.exists(t(spark, sf, "nation"), t(spark, sf, "part").select(F.col("p_size").alias("id")).distinct(), "n_nationkey")


def _suppliers(spark, sf):
    return lookup.key_index(t(spark, sf, "supplier"), "supplier", "s_suppkey", "s_name")


@query("SELECT s_name AS key_value, CAST(s_suppkey AS VARCHAR) AS id FROM supplier WHERE starts_with(s_name, 'Supplier#00000000') ORDER BY s_name LIMIT 5")
def prefix_lookup(spark, sf):
    return lookup.prefix(_suppliers(spark, sf), "Supplier#00000000", 5).select("key_value", "id")


@query("""WITH e AS (SELECT s_name AS key_value, CAST(s_suppkey AS VARCHAR) AS id, 1.0::DOUBLE AS score, 1 AS stage FROM supplier WHERE s_name = 'Supplier#0000000'),
p AS (SELECT s_name, CAST(s_suppkey AS VARCHAR), 0.8::DOUBLE, 2 FROM supplier WHERE starts_with(s_name, 'Supplier#0000000') ORDER BY s_name LIMIT 10)
SELECT * FROM e UNION ALL SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM e)""")
def fuzzy_cascade(spark, sf):
    return lookup.fuzzy_cascade(_suppliers(spark, sf), "Supplier#0000000", 10)


@query("SELECT s_name AS key_value, CAST(s_suppkey AS VARCHAR) AS id, round(1 - levenshtein(lower(s_name), 'supplier#000000012') / greatest(length(s_name), 18)::DOUBLE, 6) AS similarity FROM supplier WHERE 1 - levenshtein(lower(s_name), 'supplier#000000012') / greatest(length(s_name), 18)::DOUBLE >= 0.7 ORDER BY similarity DESC, key_value LIMIT 10")
def trigram_levenshtein(spark, sf):
    return lookup.edit_search(_suppliers(spark, sf), "Supplier#000000012").select("key_value", "id", r(F.col("similarity")).alias("similarity"))


# --- text ---

_TOK = r"(SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 2)) AS term FROM documents)"


@query(f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM {_TOK} GROUP BY ALL) GROUP BY term")
def term_document_frequencies(spark, sf):
    return text.document_frequencies(text.term_frequencies(t(spark, sf, "documents"), "doc_id"))


@query(r"SELECT count(*) AS n_docs, round(avg(n), 6) AS avg_length, CAST(sum(n) AS BIGINT) AS n_tokens FROM (SELECT len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 2)) AS n FROM documents)")
def corpus_stats(spark, sf):
    return text.corpus_stats(t(spark, sf, "documents")).withColumn("avg_length", r(F.col("avg_length")))


@query(f"SELECT count(DISTINCT doc_id) AS n_docs, count(DISTINCT term) AS n_terms, count(*) AS n_postings FROM (SELECT DISTINCT doc_id, term FROM {_TOK})")
def index_stats(spark, sf):
    return text.index_stats(t(spark, sf, "documents"), "doc_id")


def _bm25_sql(idf: str, order: str) -> str:
    return rf"""WITH tok AS {_TOK}, q AS (SELECT DISTINCT unnest(['that', 'with', 'of', 'aulich']) AS term),
n AS (SELECT count(*) AS n, avg(len(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: length(x) >= 2))) AS a FROM documents),
dl AS (SELECT doc_id, count(*) AS dl FROM tok GROUP BY 1), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok JOIN q USING (term) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
SELECT doc_id AS id, round(sum({idf} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) + 0.0 AS score FROM tf JOIN df USING (term) JOIN dl USING (doc_id), n GROUP BY 1 {order}"""


@query(_bm25_sql("ln((n - df + 0.5) / (df + 0.5))", ""))
def bm25_scores(spark, sf):
    return text.bm25(t(spark, sf, "documents"), "that with of aulich", "doc_id").withColumn("score", r(F.col("score")))


@query(_bm25_sql("ln((n - df + 0.5) / (df + 0.5) + 1)", "ORDER BY score DESC, id LIMIT 10"))
def bm25_search(spark, sf):
    found = text.bm25(t(spark, sf, "documents"), "that with of aulich", "doc_id", idf="plus1").withColumn("score", r(F.col("score")))
    return found.orderBy(F.desc("score"), "id").limit(10)


@query(rf"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: length(x) >= 2) AS a FROM documents) SELECT doc_id AS id, count(*) AS hits FROM (SELECT doc_id, a, unnest(range(1, len(a))) AS i FROM w) WHERE a[i] = 'of' AND a[i + 1] = 'the' GROUP BY 1")
def phrase_search(spark, sf):
    return text.phrase_matches(t(spark, sf, "documents"), "of the", "doc_id")


# --- vectors ---

_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_COS = f"round(list_cosine_distance(embedding::DOUBLE[], {_Q}), 4) + 0.0"
_L2 = f"round(list_distance(embedding::DOUBLE[], {_Q}), 4) + 0.0"


def _vectors(spark, sf):
    e = t(spark, sf, "embeddings")
    return e, vector.query_vector(e, 0, "vec_id")


def _distances(df, *more):
    return df.select("vec_id", r(F.col("distance"), 4).alias("distance"), *more)


@query(f"SELECT vec_id, {_COS} AS distance FROM embeddings ORDER BY list_cosine_distance(embedding::DOUBLE[], {_Q}), vec_id LIMIT 10")
def vector_topk_cosine(spark, sf):
    e, q = _vectors(spark, sf)
    return _distances(vector.top_k(e, q, 10, "cosine", "vec_id"))


@query(f"SELECT vec_id, {_L2} AS distance FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_Q}), vec_id LIMIT 10")
def vector_topk_l2(spark, sf):
    e, q = _vectors(spark, sf)
    return _distances(vector.top_k(e, q, 10, "l2", "vec_id"))


@query(f"SELECT vec_id, {_COS} AS distance, label FROM embeddings WHERE label = 3 ORDER BY list_cosine_distance(embedding::DOUBLE[], {_Q}), vec_id LIMIT 10")
def vector_filtered(spark, sf):
    e, q = _vectors(spark, sf)
    return _distances(vector.top_k(e, q, 10, "cosine", "vec_id", where=F.col("label") == 3), "label")


@query(f"SELECT vec_id, distance, label FROM (SELECT vec_id, {_COS} AS distance, label, list_cosine_distance(embedding::DOUBLE[], {_Q}) AS d FROM embeddings ORDER BY d, vec_id LIMIT 20) WHERE label < 5 ORDER BY d, vec_id LIMIT 10")
def vector_post_filtered(spark, sf):
    e, q = _vectors(spark, sf)
    return _distances(vector.top_k(e, q, 10, "cosine", "vec_id", where=F.col("label") < 5, mode="post"), "label")


@query(f"SELECT vec_id, {_COS} AS distance FROM embeddings WHERE 1 - list_cosine_distance(embedding::DOUBLE[], {_Q}) >= 0.2 ORDER BY list_cosine_distance(embedding::DOUBLE[], {_Q}), vec_id LIMIT 50")
def vector_min_score(spark, sf):
    e, q = _vectors(spark, sf)
    return _distances(vector.top_k(e, q, 50, "cosine", "vec_id", min_score=0.2))


@query(f"SELECT vec_id, {_COS} AS distance, CASE WHEN vec_id % 60 <= 30 THEN 'hot' ELSE 'cold' END AS tier FROM embeddings ORDER BY list_cosine_distance(embedding::DOUBLE[], {_Q}), vec_id LIMIT 10")
def vector_tiered(spark, sf):
    e, q = _vectors(spark, sf)
    as_of = F.lit("2024-06-01").cast("timestamp")
    aged = vector.with_tier(e, F.timestamp_add("DAY", -(F.col("vec_id") % 60).cast("int"), as_of), as_of)
    return _distances(vector.tiered_top_k(aged, q, 10, "vec_id"), "tier")


@query("SELECT CASE WHEN vec_id % 60 <= 30 THEN 'hot' ELSE 'cold' END AS tier, count(*) AS n FROM embeddings GROUP BY 1")
def tier_sizes(spark, sf):
    as_of = F.lit("2024-06-01").cast("timestamp")
    return vector.with_tier(t(spark, sf, "embeddings"), F.timestamp_add("DAY", -(F.col("vec_id") % 60).cast("int"), as_of), as_of).groupBy("tier").agg(F.count("*").alias("n"))


@query("SELECT a.vec_id AS id, round(sum(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 4) AS total FROM embeddings a, embeddings b GROUP BY 1 ORDER BY total, id LIMIT 1")
def vector_medoid(spark, sf):
    return vector.medoid(t(spark, sf, "embeddings"), "vec_id", digits=4).withColumn("total", r(F.col("total"), 4))


@query(f"SELECT vec_id, {_COS} AS distance FROM embeddings ORDER BY list_cosine_distance(embedding::DOUBLE[], {_Q}), vec_id LIMIT 5")
def vector_quantised(spark, sf):
    e, q = _vectors(spark, sf)
    return _distances(vector.quantised_top_k(e, q, 5, "vec_id"))


@query(f"""WITH c AS (SELECT vec_id AS id, list_distance(embedding::DOUBLE[], {_Q}) AS d, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id > 0),
k AS (SELECT list_reduce(list([{{'id': id, 'd': d, 'v': v}}] ORDER BY d, id), lambda a, x: CASE WHEN len(a) < 64 AND len(list_filter(a, lambda s: x[1].d >= 1.2::DOUBLE * list_distance(x[1].v, s.v))) = 0 THEN list_concat(a, x) ELSE a END) AS l FROM c)
SELECT 0::BIGINT AS query_id, x.id, round(x.d, 4) AS distance FROM (SELECT unnest(l) AS x FROM k)""")
def vector_prune(spark, sf):
    e, q = _vectors(spark, sf)
    near = vector.with_distance(e, q, "l2").where("vec_id > 0").select(F.lit(0).cast("long").alias("query_id"), F.col("vec_id").alias("id"), "distance", "embedding")
    return vector.robust_prune(near).withColumn("distance", r(F.col("distance"), 4))


@query("SELECT count(*) AS rows, 0::BIGINT AS missing, 0::BIGINT AS wrong_dimension, 0::BIGINT AS zero_norm FROM embeddings")
def verify_embeddings(spark, sf):
    return admin.verify_embeddings(t(spark, sf, "embeddings"), 64)


@query(f"""WITH v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY list_cosine_distance(embedding::DOUBLE[], {_Q}), vec_id) - 1 AS rank FROM embeddings QUALIFY rank < 50),
x AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents QUALIFY rank < 50)
SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM (SELECT * FROM v UNION ALL SELECT * FROM x) GROUP BY id""")
def rrf_fusion(spark, sf):
    e, q = _vectors(spark, sf)
    v = hybrid.ranked(vector.with_distance(e, q).select(F.col("vec_id").alias("id"), "distance"), [F.col("distance"), F.col("id")], 50)
    x = hybrid.ranked(t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars"), [F.desc("n_chars"), F.col("id")], 50)
    return hybrid.reciprocal_rank([v, x]).withColumn("score", r(F.col("score"), 8))


@query(f"""WITH v AS (SELECT vec_id AS id, 1 - list_cosine_distance(embedding::DOUBLE[], {_Q}) AS s FROM embeddings), x AS (SELECT doc_id AS id, n_chars::DOUBLE AS s FROM documents),
a AS (SELECT id, (s - (SELECT min(s) FROM v)) / (SELECT max(s) - min(s) FROM v) AS s FROM v), b AS (SELECT id, (s - (SELECT min(s) FROM x)) / (SELECT max(s) - min(s) FROM x) AS s FROM x)
SELECT id, round(0.7 * coalesce(a.s, 0) + 0.3 * coalesce(b.s, 0), 4) + 0.0 AS score FROM a FULL JOIN b USING (id)""")
def weighted_fusion(spark, sf):
    e, q = _vectors(spark, sf)
    v = vector.with_distance(e, q).select(F.col("vec_id").alias("id"), (1 - F.col("distance")).alias("score"))
    x = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"))
    return hybrid.weighted(v, x).withColumn("score", r(F.col("score"), 4))


@query(f"SELECT vec_id AS id, round(1 - list_cosine_distance(embedding::DOUBLE[], {_Q}), 4) + 0.0 AS score FROM (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100) JOIN embeddings ON vec_id = doc_id ORDER BY list_cosine_distance(embedding::DOUBLE[], {_Q}), id LIMIT 10")
def two_stage(spark, sf):
    e, q = _vectors(spark, sf)
    first = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("score"))
    return hybrid.two_stage(first, e, 1 - METRICS["cosine"](F.col("embedding"), as_vector(q)), 100, 10, "vec_id").withColumn("score", r(F.col("score"), 4))


# --- graph ---


def _edges(spark, sf):
    s = t(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"), F.lit("located_in").alias("rel_type"))
    n = t(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.lit("part_of"))
    return s.union(n).unionByName(t(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("src"), F.lit("n0").alias("dst"), F.lit("lists").alias("rel_type")))


_EDGES = "(SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst, 'located_in' AS rel_type FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'part_of' FROM nation UNION ALL SELECT 'r' || r_regionkey, 'n0', 'lists' FROM region)"


def _bfs_sql(start: str, depth: int, direction: str, rel: str = "") -> str:
    ways = {"out": ["src AS a, dst AS b"], "in": ["dst AS a, src AS b"], "both": ["src AS a, dst AS b", "dst AS a, src AS b"]}[direction]
    steps = " UNION ".join(f"SELECT {w} FROM e {rel}" for w in ways)
    return f"WITH RECURSIVE e AS {_EDGES}, st AS ({steps}), w AS (SELECT '{start}' AS node, 0 AS depth UNION SELECT b, depth + 1 FROM w JOIN st ON a = node WHERE depth < {depth}) SELECT node, min(depth) AS depth FROM w GROUP BY node"


@query(_bfs_sql("s1", 4, "out"))
def bfs_out(spark, sf):
    return graph.bfs(_edges(spark, sf), ["s1"], 4)


@query(_bfs_sql("r2", 2, "in"))
def bfs_in(spark, sf):
    return graph.bfs(_edges(spark, sf), ["r2"], 2, "in")


@query(_bfs_sql("s1", 3, "both"))
def bfs_both(spark, sf):
    return graph.bfs(_edges(spark, sf), ["s1"], 3, "both")


@query(_bfs_sql("r1", 3, "in", "WHERE rel_type = 'part_of'"))
def bfs_typed(spark, sf):
    return graph.bfs(_edges(spark, sf), ["r1"], 3, "in", "part_of")


@query(f"""WITH RECURSIVE e AS {_EDGES}, st AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
w AS (SELECT ['s1'] AS p, 's1' AS node UNION ALL SELECT list_append(p, b), b FROM w JOIN st ON a = node WHERE len(p) < 6 AND NOT list_contains(p, b) AND node <> 's4'),
best AS (SELECT p FROM w WHERE node = 's4' ORDER BY len(p), p LIMIT 1) SELECT unnest(range(0, len(p)))::INT AS pos, unnest(p) AS node FROM best""")
def shortest_path(spark, sf):
    return graph.shortest_path(_edges(spark, sf), "s1", "s4", 5, "both")


@query(f"""WITH RECURSIVE e AS {_EDGES}, st AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), adj AS (SELECT a, list(b ORDER BY b) AS nb FROM st GROUP BY a),
w AS (SELECT 0 AS i, [{{'n': 's1', 'd': 0}}] AS stack, CAST([] AS VARCHAR[]) AS seen UNION ALL
SELECT i + 1, CASE WHEN list_contains(seen, stack[1].n) OR stack[1].d >= 3 THEN stack[2:] ELSE list_concat(list_transform(list_filter(nb, lambda x: NOT list_contains(seen, x) AND x <> stack[1].n), lambda x: {{'n': x, 'd': stack[1].d + 1}}), stack[2:]) END,
CASE WHEN list_contains(seen, stack[1].n) THEN seen ELSE list_append(seen, stack[1].n) END FROM w LEFT JOIN adj ON a = stack[1].n WHERE len(stack) > 0)
SELECT CAST(unnest(range(0, len(seen))) AS BIGINT) AS pos, unnest(seen) AS node FROM w WHERE len(stack) = 0""")
def dfs_order(spark, sf):
    nodes = graph.dfs(_edges(spark, sf), "s1", 3, "both")
    return spark.createDataFrame(list(enumerate(nodes)), "pos int, node string")


@query(f"WITH e AS {_EDGES} SELECT dst AS neighbour, rel_type, 'out' AS way FROM e WHERE src = 'n0' UNION ALL SELECT src, rel_type, 'in' FROM e WHERE dst = 'n0'")
def neighbours(spark, sf):
    return graph.neighbours(_edges(spark, sf), "n0")


@query(f"SELECT count(*) AS nodes, CAST(sum(c) AS BIGINT) AS edges, round(avg(c), 6) AS avg_degree, max(c) AS max_degree FROM (SELECT src, count(*) AS c FROM {_EDGES} GROUP BY src)")
def degree_stats(spark, sf):
    return aggregates.degree_stats(_edges(spark, sf)).withColumn("avg_degree", r(F.col("avg_degree")))


@query(f"SELECT src, array_to_string(n, ',') AS neighbours, CAST(coalesce(sum(len(n)) OVER (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM (SELECT dst AS src, list(src ORDER BY src) AS n FROM {_EDGES} GROUP BY dst)")
def adjacency_offsets(spark, sf):
    e = _edges(spark, sf).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.adjacency(e).select("src", F.array_join("neighbours", ",").alias("neighbours"), "offset")


@query(f"SELECT count(*) AS edges, count(DISTINCT rel_type) AS rel_types, round(avg(length(src) / 10.0), 6) AS avg_confidence FROM {_EDGES}")
def edge_summary(spark, sf):
    e = _edges(spark, sf).withColumn("confidence", F.length("src") / 10.0)
    return aggregates.edge_summary(e).withColumn("avg_confidence", r(F.col("avg_confidence")))


@query("SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS note FROM customer")
def edge_merge(spark, sf):
    c = t(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"), F.lit("lives_in").alias("rel_type"), "c_custkey")
    old, new = c.withColumn("note", F.lit("old")), c.where("c_custkey % 2 = 0").withColumn("note", F.lit("new"))
    return graph.merge_edges(old.drop("c_custkey"), new.drop("c_custkey")).select("src", "dst", "note")


@query("SELECT DISTINCT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer WHERE c_nationkey >= 5 AND c_nationkey IN (SELECT n_nationkey FROM nation)")
def edge_remove(spark, sf):
    e = t(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"), F.lit("lives_in").alias("rel_type"))
    return graph.remove_edges(e, e.where(F.regexp_extract("dst", r"\d+", 0).cast("int") < 5)).select("src", "dst")


@query(_bfs_sql("n3", 2, "both").replace("depth FROM w GROUP", "hops FROM w GROUP").replace("min(depth) AS depth", "min(depth) AS hops"))
def iterated_expand(spark, sf):
    return graph.expand(spark.createDataFrame([("n3",)], "node string"), _edges(spark, sf))


# --- chunks and formats ---


@query("SELECT doc_id AS id, CAST(i AS INT) AS ordinal, CAST(i * 450 AS INT) AS start, substring(text, CAST(i * 450 + 1 AS BIGINT), 500) AS content, CAST(length(substring(text, CAST(i * 450 + 1 AS BIGINT), 500)) // 4 AS BIGINT) AS tokens FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(length(text) - 51, 0) // 450 + 1 AS BIGINT))) AS i FROM documents)")
def fixed_char_chunks(spark, sf):
    return chunk.fixed_chunks(t(spark, sf, "documents"), 500, 50, "doc_id")


@query("SELECT doc_id AS id, count(*) AS pieces, CAST(sum(length(p)) AS BIGINT) AS chars, md5(string_agg(p, chr(10) ORDER BY o)) AS digest FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS p, unnest(range(0, len(string_split(text, chr(10))))) AS o FROM documents) WHERE p <> '' GROUP BY 1")
def paragraph_pieces(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), chunk.paragraphs(F.col("text"), "\n").alias("p"))
    return d.select("id", F.size("p").cast("long").alias("pieces"), F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("chars"), F.md5(F.array_join("p", "\n")).alias("digest"))


@query("""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents),
c AS (SELECT doc_id, list_reduce(list_transform(p, lambda x: [x]), lambda a, x: CASE WHEN strlen(a[-1]) + strlen(x[1]) + 1 <= 400 THEN list_append(a[:-2], a[-1] || chr(10) || x[1]) ELSE list_concat(a, x) END) AS c FROM p)
SELECT doc_id AS id, CAST(unnest(range(0, len(c))) AS INT) AS ordinal, unnest(c) AS content FROM c""")
def chunk_paragraphs(spark, sf):
    return chunk.paragraph_chunks(t(spark, sf, "documents"), 400, "\n", "doc_id")


@query("""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS s FROM documents),
p AS (SELECT doc_id, flatten(list_transform(s, lambda x: CASE WHEN length(x) / 4 > 200 THEN list_transform(range(0, length(x), 720), lambda i: substring(x, i + 1, 720)) ELSE [x] END)) AS p FROM s),
c AS (SELECT doc_id, list_reduce(list_transform(p, lambda x: [x]), lambda a, x: CASE WHEN length(a[-1]) + length(x[1]) + 1 <= 800 THEN list_append(a[:-2], a[-1] || ' ' || x[1]) ELSE list_concat(a, x) END) AS c FROM p)
SELECT doc_id AS id, CAST(o AS INT) AS ordinal, content, length(content) // 4 AS tokens FROM (SELECT doc_id, unnest(range(0, len(c))) AS o, unnest(c) AS content FROM c)""")
def chunk_tokens(spark, sf):
    return chunk.token_chunks(t(spark, sf, "documents"), 200, "doc_id")


@query("SELECT doc_id, length(text) // 4 AS tokens, CAST(100000 - 2000 - floor(100000 * 0.2) AS BIGINT) AS budget FROM documents")
def token_estimate(spark, sf):
    return t(spark, sf, "documents").select("doc_id", S.estimate_tokens("text").alias("tokens"), S.chunk_budget(F.lit(100000)).alias("budget"))


@query("SELECT conv_id, CAST((n - 1) // 3 AS INT) AS ordinal, count(*) AS n_records, CAST(to_json(list({'conv_id': conv_id, 'turn': turn, 'role': role, 'text': text} ORDER BY turn)) AS VARCHAR) AS content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id, (n - 1) // 3")
def record_chunks(spark, sf):
    return chunk.record_chunks(t(spark, sf, "conversations"), "conv_id", "turn", 3)


@query("SELECT page_id, '| ' || CAST(page_id AS VARCHAR) || ' | ' || replace(replace(url, '|', '\\|'), chr(10), ' ') || ' | ' || replace(replace(html, '|', '\\|'), chr(10), ' ') || ' |' AS row FROM pages")
def html_markdown_cells(spark, sf):
    return t(spark, sf, "pages").select("page_id", S.markdown_row("page_id", "url", "html").alias("row"))


@query("SELECT user_id, string_agg('[' || printf('%02d:%02d', CAST(s // 60 AS BIGINT), CAST(s % 60 AS BIGINT)) || ' → ' || printf('%02d:%02d', CAST((s + 5) // 60 AS BIGINT), CAST((s + 5) % 60 AS BIGINT)) || '] ' || event_type, chr(10) ORDER BY s, event_type) AS text FROM (SELECT user_id, event_type, event_id AS s FROM events) GROUP BY user_id")
def transcript_lines(spark, sf):
    e = t(spark, sf, "events").select("user_id", F.col("event_id").alias("start_s"), (F.col("event_id") + 5).alias("end_s"), F.col("event_type").alias("text"))
    return transcript(e, "user_id")


@query("SELECT n_nationkey, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || substring('89ab', CAST((strpos('0123456789abcdef', substring(h, 17, 1)) - 1) % 4 + 1 AS BIGINT), 1) || substring(h, 18, 3) || '-' || substring(h, 21, 12) AS id FROM (SELECT n_nationkey, md5('nation:' || n_name) AS h FROM nation)")
def det_uuid(spark, sf):
    return t(spark, sf, "nation").select("n_nationkey", S.entity_uuid(F.lit("nation"), "n_name").alias("id"))


@query(r"SELECT o_orderkey, regexp_matches(trim(p), '^[\p{L}\p{N}][\p{L}\p{N}_-]*$') AS is_lookup FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'two words' END AS p FROM orders)")
def entity_lookup_rule(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", S.is_entity_lookup(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("two words")).alias("is_lookup"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return t(spark, sf, "events").select("event_id", S.json_field("props", "k", "bigint").alias("k"))


@query("SELECT event_id, least(60.0, pow(2.0, greatest(event_id % 9 - 1, 0))) AS wait FROM events")
def backoff(spark, sf):
    return t(spark, sf, "events").select("event_id", S.backoff_seconds(F.col("event_id") % 9).alias("wait"))


# --- time and sessions ---

_TS = "epoch(ts)"


@query(f"""WITH e AS (SELECT *, coalesce(CAST({_TS} - lag({_TS}) OVER w > 86400 AS INT), 1) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(ts) AS start_time, max(ts) AS end_time, count(*) AS n_events FROM s GROUP BY user_id, s""")
def moments_sessionize(spark, sf):
    return moments.sessionize(t(spark, sf, "events"), 86400)


@query("SELECT event_id, event_type FROM events WHERE ts BETWEEN (SELECT min(ts) FROM events) + INTERVAL 1 DAY AND (SELECT min(ts) FROM events) + INTERVAL 3 DAY")
def time_range(spark, sf):
    e = t(spark, sf, "events")
    first = e.agg(F.min("ts")).first()[0]
    from datetime import timedelta

    return moments.in_range(e, "ts", first + timedelta(days=1), first + timedelta(days=3)).select("event_id", "event_type")


@query("SELECT CAST(to_timestamp(floor(epoch(ts) / 300) * 300) AS TIMESTAMP) AS window_start, count(DISTINCT user_id) AS active FROM events GROUP BY 1")
def active_users_5m(spark, sf):
    return moments.active_keys(t(spark, sf, "events")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "active")


@query("SELECT conv_id AS session_id, count(*) AS message_count, min(turn) AS created_at, max(turn) AS updated_at FROM conversations GROUP BY 1")
def session_fold(spark, sf):
    return sessions.fold(t(spark, sf, "conversations").withColumnsRenamed({"conv_id": "session_id", "turn": "timestamp"}))


@query("SELECT turn, role, text FROM conversations WHERE conv_id = 1 ORDER BY turn LIMIT 100")
def conversation_messages(spark, sf):
    return sessions.messages_of(t(spark, sf, "conversations"), 1, 100, "conv_id", "turn").select("turn", "role", "text")


# --- writes and change log ---

_OPS = "(SELECT user_id, event_id AS seq, value, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 'delete' ELSE 'update' END AS op FROM events)"


def _log(spark, sf):
    e = t(spark, sf, "events")
    low = e.agg(F.min("event_type")).first()[0]
    return e.select("user_id", F.col("event_id").alias("seq"), "value", F.when(F.col("event_type") == low, "delete").otherwise("update").alias("op"))


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def upsert_latest(spark, sf):
    return store.latest(t(spark, sf, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")


@query(f"SELECT user_id, arg_max(value, seq) AS value FROM {_OPS} GROUP BY user_id HAVING arg_max(op, seq) <> 'delete'")
def wal_apply(spark, sf):
    state = spark.createDataFrame([], "user_id bigint, value double")
    return store.apply_changes(state, _log(spark, sf), ["user_id"])


@query(f"SELECT seq, user_id FROM {_OPS} WHERE seq > 100 ORDER BY seq LIMIT 50")
def wal_tail(spark, sf):
    return store.tail(_log(spark, sf), 100, 50).select("seq", "user_id")


@query("SELECT count(*) AS entries, max(event_id) AS primary_seq, 100::BIGINT AS replica_seq, max(event_id) - 100 AS lag FROM events")
def wal_status(spark, sf):
    return store.log_status(_log(spark, sf), 100)


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) + 999 AS seq FROM events")
def wal_numbers(spark, sf):
    return store.numbered_changes(t(spark, sf, "events").select("event_id", "ts"), 1000, ["ts", "event_id"]).select("event_id", "seq")


@query("SELECT c_custkey, c_custkey % 4 = 0 AS deleted FROM customer")
def soft_delete_view(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", F.lit(None).cast("timestamp").alias("deleted_at"))
    gone = c.where("c_custkey % 4 = 0")
    return store.soft_delete(c, gone, ["c_custkey"], F.lit("2024-01-01").cast("timestamp")).select("c_custkey", F.col("deleted_at").isNotNull().alias("deleted"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'patched' ELSE c_name END AS c_name, c_acctbal FROM customer")
def patch_merge(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.where("c_custkey % 5 = 0").select("c_custkey", F.lit("patched").alias("c_name"), F.lit(None).cast("double").alias("c_acctbal"))
    return store.patch(c, new, ["c_custkey"], F.lit(None))


@query("SELECT coalesce(n.k, c.c_custkey) AS c_custkey, coalesce(n.name, c_name) AS c_name, CASE WHEN c.c_custkey IS NULL THEN 'new' ELSE 'old' END AS created_at FROM customer c FULL JOIN (SELECT c_custkey + 10 AS k, 'n' || c_custkey AS name FROM customer) n ON n.k = c.c_custkey")
def upsert_merge(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", "c_name", F.lit("old").alias("created_at"))
    new = c.select((F.col("c_custkey") + 10).alias("c_custkey"), F.concat(F.lit("n"), "c_custkey").alias("c_name"))
    return store.upsert(c, new, ["c_custkey"], "new")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 7 <> 0")
def hard_delete(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", "c_name")
    return store.hard_delete(c, c.where("c_custkey % 7 = 0"), ["c_custkey"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphans(spark, sf):
    return admin.orphans(t(spark, sf, "documents").select("doc_id"), t(spark, sf, "labels"), "doc_id", "doc_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0")
def vacuum(spark, sf):
    c = t(spark, sf, "customer").withColumn("deleted_at", F.when(F.col("c_custkey") % 3 == 0, F.lit("2024-01-01").cast("timestamp")))
    return admin.vacuum(c).select("c_custkey")


@query("SELECT CAST(label AS VARCHAR) AS label, CAST(vec_id AS VARCHAR) AS vec_id FROM embeddings")
def export_parquet(spark, sf):
    return sinks.parquet_frame(t(spark, sf, "embeddings"))


@query("SELECT 'nation' AS entity_type, n_name, NULL AS r_name FROM nation UNION ALL SELECT 'region', NULL, r_name FROM region")
def export_all(spark, sf):
    return sinks.all_tables({"nation": t(spark, sf, "nation").select("n_name"), "region": t(spark, sf, "region").select("r_name")})


# --- extensions: what Spark brings itself ---


@query("SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_group(spark, sf):
    c = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("n_name").agg(F.count("*").alias("customers"), r(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders QUALIFY rn <= 3")
def window_top3(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t(spark, sf, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("rn")).where("rn <= 3")


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0 EXCEPT SELECT 3")
def set_operations(spark, sf):
    a = t(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
    b = t(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).where("k != 3")


@query("SELECT e.event_id, max(o.o_orderdate) AS last_order FROM events e LEFT JOIN orders o ON o.o_custkey = e.user_id AND o.o_orderdate <= e.ts GROUP BY e.event_id")
def as_of_join(spark, sf):
    """The last order of each event's user: both tables in one stream by (user, time), and the last order carried on."""
    e = t(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("at"), "event_id", F.lit(None).cast("timestamp_ntz").alias("od"))
    o = t(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"), F.lit(None).cast("long").alias("event_id"), F.col("o_orderdate").alias("od"))
    w = Window.partitionBy("k").orderBy("at", F.col("event_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return e.union(o).withColumn("last_order", F.last("od", True).over(w)).where("event_id IS NOT NULL").select("event_id", "last_order")


@query("SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY 1")
def pivot_priorities(spark, sf):
    p = t(spark, sf, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).count()
    return p.select("o_orderstatus", F.coalesce("1-URGENT", F.lit(0)).cast("long").alias("urgent"), F.coalesce("5-LOW", F.lit(0)).cast("long").alias("low"))


@query("SELECT * FROM (VALUES ('lookup', '[\"a\", \"b\"]'), ('traverse', '[\"s1\"]'), ('key query', '[\"c\"]'), ('valid', '[true, false, true]'), ('table', '[\"a.t\", \"u\"]')) v(kind, keys)")
def verb_plans(spark, sf):
    from quarry.plans import verbs

    a, b = verbs.parse("LOOKUP 'a', 'b'"), verbs.parse("TRAVERSE FROM s1 DEPTH 2 DIRECTION out")
    c = verbs.parse("SELECT * FROM kv WHERE key = 'c'")
    valid = [verbs.validate_sql(spark, q) for q in ("SELECT a FROM t", "SELECT (a FROM t", "WITH x AS (SELECT 1) SELECT * FROM x")]
    names = [verbs.table_of(spark, q) for q in ("SELECT a, count(*) FROM a.t WHERE b > 2 GROUP BY a ORDER BY 1 LIMIT 3", "SELECT * FROM u JOIN v USING (id)")]
    rows = [("lookup", list(a.keys)), ("traverse", [b.start]), ("key query", list(c.keys)), ("valid", valid), ("table", names)]
    return spark.createDataFrame([(k, json.dumps(x)) for k, x in rows], "kind string, keys string")


from quarry import catalogue_store  # noqa: E402, F401  registers the queries of the store
