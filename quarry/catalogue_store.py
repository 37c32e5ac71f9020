"""More registered queries: the engine and its store, sources and sinks, streams, plans, and what is built on them."""

from __future__ import annotations

import io
import json
import zipfile
from dataclasses import make_dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.catalogue import query, r, t
from quarry.functions import scalar as S
from quarry.operators import admin, aggregates, graph, hybrid, lookup, moments, sessions, text, vector
from quarry.operators import predicates as P
from quarry.plans import query_plan
from quarry.plans.embed import embed_column
from quarry.plans.engine import Engine
from quarry.session import shared_dir
from quarry.sources import readers, sinks, store
from quarry.streaming import changes

_LETTERS = "aeinorst"


def letter_embedder(texts: list[str]) -> np.ndarray:
    """How often each of eight letters stands in a text: a provider whose vectors SQL can compute."""
    return np.array([[(x or "").lower().count(c) for c in _LETTERS] for x in texts], "float32").reshape(len(texts), len(_LETTERS))


def _letters_sql(c: str) -> str:
    return "[" + ", ".join(f"CAST(length({c}) - length(replace(lower({c}), '{x}', '')) AS DOUBLE)" for x in _LETTERS) + "]"


def _schema(name: str, columns: dict[str, str], **extra) -> dict:
    fields = {c: {"type": k, "description": c} for c, k in columns.items()}
    return {"title": name, "short_name": name, "description": f"Rows of {name}", "version": "1.0.0", "properties": fields, **extra}


def _engine(spark: SparkSession) -> Engine:
    return Engine(spark, shared_dir(spark, "engine"), provider=letter_embedder)


def _customers(spark, sf, **extra) -> Engine:
    e = _engine(spark)
    e.register_schema(_schema("customer", {"c_custkey": "integer", "c_name": "string", "c_nationkey": "integer", "c_acctbal": "number", "c_mktsegment": "string"}, key_field="c_custkey", **extra))
    e.insert("customer", t(spark, sf, "customer"))
    return e


def _nations(spark, sf, **extra) -> Engine:
    e = _engine(spark)
    e.register_schema(_schema("nation", {"n_nationkey": "integer", "n_name": "string", "n_regionkey": "integer"}, key_field="n_name", embedding_fields=["n_name"], **extra))
    e.insert("nation", t(spark, sf, "nation"))
    return e


_UUID = "substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || substring('89ab', CAST((strpos('0123456789abcdef', substring(h, 17, 1)) - 1) % 4 + 1 AS BIGINT), 1) || substring(h, 18, 3) || '-' || substring(h, 21, 12)"

# --- scans and keys ---


@query("SELECT count(*) AS live, (SELECT count(*) FROM customer) AS whole FROM customer WHERE c_custkey % 3 <> 0")
def count_live(spark, sf):
    c = t(spark, sf, "customer").withColumn("deleted_at", F.when(F.col("c_custkey") % 3 == 0, F.lit("2024-01-01").cast("timestamp")))
    return lookup.live(c).agg(F.count("*").alias("live")).join(lookup.live(c, True).agg(F.count("*").alias("whole")))  # one row each


@query("SELECT c_custkey, c_name, c_custkey % 3 = 0 AS deleted FROM customer WHERE c_custkey = 9")
def point_get(spark, sf):
    c = t(spark, sf, "customer").withColumn("deleted_at", F.when(F.col("c_custkey") % 3 == 0, F.lit("2024-01-01").cast("timestamp")))
    return lookup.get(c, 9, "c_custkey").select("c_custkey", "c_name", F.col("deleted_at").isNotNull().alias("deleted"))


def _priorities(spark, sf):
    return lookup.key_index(t(spark, sf, "orders"), "order", "o_orderkey", "o_orderpriority")


@query("SELECT 'order' AS entity_type, o_orderpriority AS key_value, min(CAST(o_orderkey AS VARCHAR)) AS id FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 2")
def key_get(spark, sf):
    return lookup.first_by_key(_priorities(spark, sf), ["1-URGENT", "5-LOW", "no such key"])


@query("SELECT 'order' AS entity_type, o_orderpriority AS key_value, min(CAST(o_orderkey AS VARCHAR)) AS id FROM orders GROUP BY 2")
def first_row_per_key(spark, sf):
    return lookup.first_per_key(_priorities(spark, sf))


@query(f"""WITH n AS (SELECT n_nationkey, n_name, {_UUID} AS id FROM (SELECT *, md5('nation:' || n_name) AS h FROM nation)),
refs AS (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'nation:' || n_name WHEN 1 THEN upper(id) WHEN 2 THEN 'nation:none' ELSE n_name END AS ref FROM n)
SELECT n_nationkey, ref, CASE WHEN n_nationkey % 4 < 2 THEN id END AS entity_id, n_nationkey % 4 < 2 AS found FROM refs JOIN n USING (n_nationkey)""")
def entity_resolve(spark, sf):
    n = t(spark, sf, "nation").select("n_nationkey", "n_name", S.entity_uuid(F.lit("nation"), "n_name").alias("id"), F.lit("nation").alias("entity_type"))
    k = F.col("n_nationkey") % 4
    ref = F.when(k == 0, F.concat(F.lit("nation:"), "n_name")).when(k == 1, F.upper("id")).when(k == 2, "nation:none").otherwise(F.col("n_name"))
    return lookup.resolve(n.select("id", "entity_type", "n_name"), n.select("n_nationkey", ref.alias("ref")), "n_name")


@query("SELECT s_name AS key_value, CAST(s_suppkey AS VARCHAR) AS id, 1.0::DOUBLE AS score, 1 AS stage FROM supplier WHERE s_name = 'Supplier#000000003'")
def fuzzy_exact(spark, sf):
    s = lookup.key_index(t(spark, sf, "supplier"), "supplier", "s_suppkey", "s_name")
    return lookup.fuzzy_cascade(s, "Supplier#000000003")


@query("""WITH k AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ' ' || lower(p_type) AS key_value FROM part),
tok AS (SELECT id, key_value, unnest(list_filter(regexp_split_to_array(lower(key_value), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 2)) AS term FROM k),
n AS (SELECT (SELECT count(*) FROM k) AS n, count(*)::DOUBLE / (SELECT count(*) FROM k) AS a FROM tok), dl AS (SELECT id, count(*) AS dl FROM tok GROUP BY 1),
tf AS (SELECT id, key_value, term, count(*) AS tf FROM tok WHERE term IN ('brass', 'tin', 'nothing') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
SELECT key_value, id, round(sum(ln((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score, 3 AS stage FROM tf JOIN df USING (term) JOIN dl USING (id), n GROUP BY key_value, id ORDER BY score DESC, key_value, id LIMIT 20""")
def fuzzy_bm25(spark, sf):
    """No key equals the query or begins with it, so tokens decide."""
    p = t(spark, sf, "part").select(F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("key"), "p_partkey")
    return lookup.fuzzy_cascade(lookup.key_index(p, "part", "p_partkey", "key"), "tin brass nothing", 20).withColumn("score", r(F.col("score")))


@query("SELECT entity_type, key_value, id FROM (SELECT 'nation' AS entity_type, n_name AS key_value, " + _UUID + " AS id FROM (SELECT *, md5('nation:' || n_name) AS h FROM nation)) WHERE key_value IN (SELECT n_name FROM nation WHERE n_nationkey IN (2, 7))")
def kv_select(spark, sf):
    e = _nations(spark, sf)
    a, b = (x[0] for x in t(spark, sf, "nation").where("n_nationkey IN (2, 7)").select("n_name").collect())
    return e.query(f"SELECT * FROM kv WHERE key IN ('{a}', '{b}', 'no such key')")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def indexed_find(spark, sf):
    return _customers(spark, sf, indexed_fields=["c_mktsegment"]).find("customer", "c_mktsegment", "BUILDING").select("c_custkey", "c_name")


# --- the store ---


@query("SELECT r_regionkey, r_name FROM region")
def snapshot_read(spark, sf):
    s = store.Store(spark, shared_dir(spark, "store"), 4)
    g = t(spark, sf, "region")
    s.commit("region", g, ["r_regionkey"])
    s.change("region", g.select("r_regionkey"), lambda old: old.withColumn("r_name", F.lit("changed")))
    return s.read("region", 1)


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'second' ELSE c_name END AS c_name, c_custkey % 10 = 0 AS changed, true AS stamped FROM customer UNION ALL SELECT 1000000000, 'new', false, true")
def engine_upsert(spark, sf):
    """Batches validated as a whole; of rows with one identity the last one counts; times as RFC 3339."""
    e = _customers(spark, sf)
    again = t(spark, sf, "customer").where("c_custkey % 10 = 0")
    new = again.withColumn("c_name", F.lit("first")).unionByName(again.withColumn("c_name", F.lit("second")))
    e.insert("customer", new.unionByName(again.limit(1).withColumns({"c_custkey": F.lit(10**9), "c_name": F.lit("new")})).coalesce(1))
    stamp = F.date_format("modified_at", "yyyy-MM-dd'T'HH:mm:ssXXX").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(Z|[+-]\d\d:\d\d)$")
    return e.list("customer").select("c_custkey", "c_name", (F.col("created_at") != F.col("modified_at")).alias("changed"), stamp.alias("stamped"))


@query("SELECT n_name AS name, 'nation' AS entity_type FROM nation UNION ALL SELECT r_name, 'region' FROM region")
def mixed_upsert(spark, sf):
    e = _engine(spark)
    out = None
    models = []
    for name, col in (("nation", "n_name"), ("region", "r_name")):
        e.register_schema(_schema(name, {"name": "string"}))
        kind = make_dataclass(name.title(), [("name", str)])
        models += [kind(x[0]) for x in t(spark, sf, name).select(col).collect()]  # objects that a caller holds
    e.upsert(models)
    for name in ("nation", "region"):
        rows = e.list(name).select("name", "entity_type")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN 'user' ELSE 'public' END AS category, '1.' || r_regionkey || '.0' AS version, r_regionkey + 1 AS n_versions FROM region WHERE r_regionkey <> 3")
def schema_reload(spark, sf):
    """Schemas that one engine registered, in several versions, as another one over the same folder finds them."""
    path = shared_dir(spark, "engine")
    a = Engine(spark, path)
    rows = t(spark, sf, "region").collect()  # names of a few schemas
    for x in rows:
        for v in range(x["r_regionkey"] + 1):
            a.register_schema(_schema(x["r_name"], {"name": "string"}) | {"version": f"1.{v}.0", "category": "user" if x["r_regionkey"] % 2 == 0 else "public"})
    b = Engine(spark, path)
    b.registry.remove(next(x["r_name"] for x in rows if x["r_regionkey"] == 3))
    counts = [(n, len(b.registry.versions(n))) for n in b.registry.names()]
    return b.registry.table(spark).where("category != 'system'").join(spark.createDataFrame(counts, "name string, n_versions int"), "name").select("name", "category", "version", "n_versions")


@query("SELECT * FROM (VALUES ('nation', 2, 25), ('nation', 3, 5), ('region', 1, 5)) v(table_name, version, rows)")
def backups(spark, sf):
    """Three backups of one table, of which the first is deleted again, and one of another."""
    s, far = (store.Store(spark, shared_dir(spark, "store"), 4) for _ in range(2))
    n = t(spark, sf, "nation")
    s.commit("nation", n, ["n_nationkey"])
    s.backup("nation", far.path)
    s.backup("nation", far.path)
    s.commit("nation", n.where("n_nationkey < 5"), ["n_nationkey"])
    s.backup("nation", far.path)
    s.commit("region", t(spark, sf, "region"), ["r_regionkey"])
    s.backup("region", far.path)
    far.forget("nation", 1)
    kept = far.backups()
    counts = [(x["table_name"], x["version"], far.read(x["table_name"], x["version"]).count()) for x in kept.collect()]  # a row a backup
    return spark.createDataFrame(counts, "table_name string, version int, rows int")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'n' || c_nationkey || ':lives_in:0 x:likes:1 y:knows:1' ELSE 'n' || c_nationkey || ':lives_in:0 x:likes:0' END AS edges FROM customer")
def inline_edges_merge(spark, sf):
    edge = lambda dst, rel, by: F.struct(dst.alias("dst"), F.lit(rel).alias("rel_type"), F.lit(by).alias("by"))
    c = t(spark, sf, "customer")
    old = F.array(edge(F.concat(F.lit("n"), "c_nationkey"), "lives_in", "0"), edge(F.lit("x"), "likes", "0"))
    new = F.when(F.col("c_custkey") % 2 == 0, F.array(edge(F.lit("y"), "knows", "1"), edge(F.lit("x"), "likes", "1")))
    merged = c.select("c_custkey", old.alias("o"), new.alias("n")).select("c_custkey", store.merge_inline_edges(F.col("o"), F.col("n")).alias("m"))
    return merged.select("c_custkey", F.array_join(F.transform("m", lambda e: F.concat_ws(":", e["dst"], e["rel_type"], e["by"])), " ").alias("edges"))


@query("SELECT c_custkey, 'x:likes' AS likes, 'n' || c_nationkey || ':lives_in' AS without_likes FROM customer")
def inline_edges_of_type(spark, sf):
    edge = lambda dst, rel: F.struct(dst.alias("dst"), F.lit(rel).alias("rel_type"))
    c = t(spark, sf, "customer").select("c_custkey", F.array(edge(F.concat(F.lit("n"), "c_nationkey"), "lives_in"), edge(F.lit("x"), "likes")).alias("e"))
    show = lambda a: F.array_join(F.transform(a, lambda e: F.concat_ws(":", e["dst"], e["rel_type"])), " ")
    return c.select("c_custkey", show(graph.inline_of_type("e", "likes")).alias("likes"), show(graph.without_inline("e", "x", "likes")).alias("without_likes"))


@query("SELECT CAST(count(*) FILTER (event_id >= 500) AS BIGINT) AS kept, CAST(count(*) FILTER (event_id < 500) AS BIGINT) AS gone, min(event_id) FILTER (event_id >= 500) AS least FROM events")
def wal_compact(spark, sf):
    left, gone = store.compact_log(t(spark, sf, "events").select(F.col("event_id").alias("seq")), 500)
    return left.agg(F.count("*").alias("kept"), F.lit(gone).cast("long").alias("gone"), F.min("seq").alias("least"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
def vacuum_before(spark, sf):
    day = F.when(F.col("c_custkey") % 2 == 0, "2024-06-01").otherwise("2023-06-01").cast("timestamp")
    c = t(spark, sf, "customer").withColumn("deleted_at", F.when(F.col("c_custkey") % 3 == 0, day))
    return admin.vacuum(c, pd.Timestamp("2024-01-01").to_pydatetime()).select("c_custkey")


@query("SELECT count(*) AS rows, count(*) FILTER (vec_id % 7 = 0) AS missing, count(*) FILTER (vec_id % 7 = 1) AS wrong_dimension, count(*) FILTER (vec_id % 7 = 2) AS zero_norm FROM embeddings")
def verify_broken_embeddings(spark, sf):
    k, v = F.col("vec_id") % 7, F.col("embedding")
    broken = F.when(k == 0, None).when(k == 1, F.slice(v, 1, 9)).when(k == 2, F.transform(v, lambda x: F.lit(0.0).cast("float"))).otherwise(v)
    return admin.verify_embeddings(t(spark, sf, "embeddings").select(broken.alias("embedding")), 64)


@query("""SELECT c_custkey, concat_ws('; ', CASE WHEN c_acctbal < 0 THEN 'c_acctbal is out of range: minimum 0' END, CASE WHEN c_custkey % 5 = 0 THEN 'c_mktsegment is required' END,
CASE WHEN c_custkey % 5 <> 0 AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'c_mktsegment is not one of its values' END, CASE WHEN NOT regexp_matches(c_name, '[0-4]$') THEN 'c_name breaks pattern [0-4]$' END) AS problems FROM customer""")
def schema_violations(spark, sf):
    e = _engine(spark)
    s = _schema("customer", {"c_custkey": "integer", "c_acctbal": "number", "c_mktsegment": "string", "c_name": "string"}, required=["c_mktsegment", "c_custkey"])
    s["properties"]["c_acctbal"]["minimum"] = 0
    s["properties"]["c_mktsegment"]["enum"] = ["BUILDING", "MACHINERY"]
    s["properties"]["c_name"] |= {"pattern": "[0-4]$", "maxLength": 100}
    e.register_schema(s)
    rows = t(spark, sf, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")))
    order = F.array_sort("problems")
    return e.registry.violations("customer", rows).select("c_custkey", F.concat_ws("; ", order).alias("problems"))


# --- SQL over stored tables ---


@query("""SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND NOT c_name LIKE '%9' AND c_custkey > c_nationkey AND 20 < c_custkey
AND c_mktsegment IS NOT NULL AND c_name ILIKE 'CUSTOMER%' AND length(c_mktsegment) > 8""")
def engine_predicates(spark, sf):
    """Predicates in Spark's own meaning: BETWEEN, NOT, ILIKE, functions, columns on both sides, qualified names, system columns."""
    return _customers(spark, sf).query("""SELECT c.c_custkey FROM customer c WHERE c.c_acctbal BETWEEN 0 AND 5000 AND NOT c.c_name LIKE '%9' AND c.c_custkey > c.c_nationkey AND 20 < c.c_custkey
        AND c.c_mktsegment IS NOT NULL AND c.c_name ILIKE 'CUSTOMER%' AND length(c.c_mktsegment) > 8 AND c.created_at > '2000-01-01' AND c.deleted_at IS NULL""")


@query("SELECT c_nationkey, count(*) AS n, round(stddev_samp(c_acctbal), 4) AS spread, round(median(c_acctbal), 4) AS middle, bool_or(c_acctbal < 0) AS some_owe FROM customer GROUP BY c_nationkey ORDER BY n DESC, c_nationkey LIMIT 7")
def engine_aggregates(spark, sf):
    """Aggregates with aliases, an order and a limit, and functions beyond the five."""
    return _customers(spark, sf).query("SELECT c_nationkey, count(*) AS n, round(stddev_samp(c_acctbal), 4) AS spread, round(median(c_acctbal), 4) AS middle, bool_or(c_acctbal < 0) AS some_owe FROM customer GROUP BY c_nationkey ORDER BY n DESC, c_nationkey LIMIT 7")


@query("SELECT c_custkey FROM customer WHERE c_acctbal >= 1000 AND lower(c_mktsegment) IN ('building', 'household') AND c_nationkey < 12 AND c_name <> ''")
def filter_builder(spark, sf):
    tests = query_plan.conditions({"c_acctbal": ">= 1000", "c_mktsegment": ["BUILDING", "household"], "c_nationkey": "<12"})
    return t(spark, sf, "customer").where(P.all_of(*tests)).select("c_custkey")


@query("SELECT c_custkey % 5 AS k, count(*) AS n FROM customer GROUP BY 1")
def sql_function(spark, sf):
    """A Python function registered for SQL, in Arrow batches."""

    @F.pandas_udf("bigint")
    def rest(x: pd.Series) -> pd.Series:
        return x % 5

    spark.udf.register("rest_of_five", rest)
    t(spark, sf, "customer").createOrReplaceTempView("customer_for_udf")
    return spark.sql("SELECT rest_of_five(c_custkey) AS k, count(*) AS n FROM customer_for_udf GROUP BY 1")


@query("SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 2")
def ask_staged(spark, sf):
    """A question's plan, fenced as models like to answer: the first stage finds nothing, the second one answers."""
    e = _nations(spark, sf)
    made = {"kind": "sql", "query": "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 99", "confidence": 0.5, "explanation": "no region is named", "fallbacks": [{"kind": "sql", "query": "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 2"}]}
    return e.ask("Which nations are there?", lambda question: f"```json\n{json.dumps(made)}\n```")


# --- search over stored embeddings ---

_ASIA = _letters_sql("'nations in asia'")


@query(f"SELECT n_name, round(1 - list_cosine_distance(v, {_ASIA}), 4) AS score FROM (SELECT n_name, {_letters_sql('n_name')} AS v FROM nation) ORDER BY list_cosine_distance(v, {_ASIA}), md5('nation:' || n_name) LIMIT 5")
def search_stored(spark, sf):
    """Embeddings are made when rows are written; a changed row is embedded again, which a second write of the same rows undoes."""
    e = _nations(spark, sf)
    e.insert("nation", t(spark, sf, "nation"))
    return e.search("nation", "nations in Asia", 5).select("n_name", r(F.col("score"), 4).alias("score"))


@query(f"SELECT n_name, round(1 - list_cosine_distance(v, {_ASIA}), 4) AS score FROM (SELECT n_name, {_letters_sql('n_name')} AS v FROM nation WHERE n_regionkey > 1) ORDER BY list_cosine_distance(v, {_ASIA}), md5('nation:' || n_name) LIMIT 4")
def search_verb(spark, sf):
    return _nations(spark, sf).query("SEARCH 'nations in Asia' IN nation WHERE n_regionkey > 1 LIMIT 4").select("n_name", r(F.col("score"), 4).alias("score"))


@query(f"SELECT 3::BIGINT AS total, string_agg(n_name, ',' ORDER BY d, h) AS names FROM (SELECT n_name, md5('nation:' || n_name) AS h, list_cosine_distance({_letters_sql('n_name')}, {_ASIA}) AS d FROM nation ORDER BY d, h LIMIT 3)")
def search_tool(spark, sf):
    found = _nations(spark, sf).search_result("nation", "nations in Asia", 3)
    return spark.createDataFrame([(found["total"], ",".join(x["entity"]["n_name"] for x in found["results"]))], "total bigint, names string")


@query(f"SELECT n_name, array_to_string(list_transform({_letters_sql('n_name')}, lambda x: CAST(x AS INT)), ',') AS vector FROM nation")
def embed_batches(spark, sf):
    n = t(spark, sf, "nation").withColumn("v", embed_column(F.col("n_name"), letter_embedder))
    return n.select("n_name", F.array_join(F.transform("v", lambda x: x.cast("int")), ",").alias("vector"))


_WANTED = _letters_sql("'america'")


@query(f"SELECT r_name AS name, round(1 - list_cosine_distance({_letters_sql(chr(40) + 'r_name || ' + chr(39) + ' Rows of ' + chr(39) + ' || r_name' + chr(41))}, {_WANTED}), 4) AS score FROM region")
def schema_search(spark, sf):
    e = _engine(spark)
    names = [x[0] for x in t(spark, sf, "region").select("r_name").collect()]  # names of a few schemas
    for n in names:
        e.register_schema(_schema(n, {"name": "string"}))
    return e.similar_schemas("america", 100).where(F.col("name").isin(names)).select("name", r(F.col("score"), 4).alias("score"))


_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"


@query(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_Q}) ** 2, 4) + 0.0 AS distance FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_Q}), vec_id LIMIT 10")
def vector_squared_l2(spark, sf):
    e = t(spark, sf, "embeddings")
    return vector.top_k(e, vector.query_vector(e, 0, "vec_id"), 10, "squared_l2", "vec_id").select("vec_id", r(F.col("distance"), 4).alias("distance"))


@query("SELECT doc_id, round(n_chars * pow(0.5, (doc_id % 90) / 30.0), 6) AS score FROM documents")
def recency_boost(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return hybrid.recency_boost(d, F.col("doc_id") % 90).withColumn("score", r(F.col("score")))


def _field_sql(c: str) -> str:
    tok = f"(SELECT p_partkey, unnest(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 2)) AS term FROM part)"
    return f"""SELECT p_partkey AS id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS s FROM (SELECT p_partkey, term, count(*) AS tf FROM {tok} WHERE term IN ('brass', 'small', 'part') GROUP BY ALL)
JOIN (SELECT term, count(DISTINCT p_partkey) AS df FROM {tok} GROUP BY 1) USING (term) JOIN (SELECT p_partkey, count(*) AS dl FROM {tok} GROUP BY 1) USING (p_partkey),
(SELECT (SELECT count(*) FROM part) AS n, count(*)::DOUBLE / (SELECT count(*) FROM part) AS a FROM {tok}) GROUP BY 1"""


@query(f"SELECT id, round(sum(s), 6) AS score FROM (SELECT id, 2 * s AS s FROM ({_field_sql('p_name')}) UNION ALL SELECT id, s FROM ({_field_sql('p_type')})) GROUP BY id ORDER BY score DESC, id LIMIT 50")
def bm25_boosts(spark, sf):
    found = text.bm25_fields(t(spark, sf, "part"), "brass small part", {"p_name": 2.0, "p_type": 1.0}, "p_partkey")
    return found.withColumn("score", r(F.col("score"))).orderBy(F.desc("score"), "id").limit(50)


@query(r"""WITH w AS (SELECT page_id, list_filter(regexp_split_to_array(lower(url), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 2) AS a FROM pages)
SELECT id, term, string_agg(i - 1, ',' ORDER BY i) AS places FROM (SELECT page_id AS id, unnest(a) AS term, unnest(range(1, len(a) + 1)) AS i FROM w) GROUP BY id, term""")
def token_positions(spark, sf):
    return text.positions(t(spark, sf, "pages"), "page_id", "url").withColumn("places", F.array_join("places", ","))


# --- sources and sinks ---


@query("SELECT n_nationkey, n_name, (SELECT count(*) FROM region) AS bad FROM nation")
def jsonl_source(spark, sf):
    """Good lines, and how many lines were none; blank lines don't count."""
    path = shared_dir(spark, "jsonl")
    n = t(spark, sf, "nation").select(F.to_json(F.struct("n_nationkey", "n_name")).alias("value"))
    broken = t(spark, sf, "region").select(F.concat(F.lit('{"n_nationkey": '), "r_name").alias("value"))
    n.union(broken).union(broken.select(F.lit("  "))).write.text(path)
    good, bad = readers.read_jsonl(spark, path, t(spark, sf, "nation").select("n_nationkey", "n_name").schema)
    return good.join(bad.agg(F.count("*").alias("bad")))  # one row


@query("SELECT n_nationkey, n_name FROM nation")
def json_array_source(spark, sf):
    path = shared_dir(spark, "json-array")
    n = t(spark, sf, "nation").select("n_nationkey", "n_name")
    n.agg(F.to_json(F.collect_list(F.struct(*n.columns)))).coalesce(1).write.text(path)  # a file of one array, as others write it
    return readers.read_json_array(spark, path, n.schema)


_LONG = "trim(repeat(n_name || ' ', 300))"


@query(f"""SELECT n_nationkey, 0 AS chunk_ordinal, CASE WHEN strlen({_LONG}) + strlen(n_name) + 2 <= 2000 THEN n_name || chr(10) || chr(10) || {_LONG} ELSE n_name END AS content FROM nation
UNION ALL SELECT n_nationkey, 1, {_LONG} FROM nation WHERE strlen({_LONG}) + strlen(n_name) + 2 > 2000""")
def text_source(spark, sf):
    path = shared_dir(spark, "texts")
    n = t(spark, sf, "nation").select("n_nationkey", F.concat("n_name", F.lit("\n\n"), F.trim(F.repeat(F.concat("n_name", F.lit(" ")), 300))).alias("value"))
    n.write.partitionBy("n_nationkey").text(path)
    return readers.read_texts(spark, f"{path}/*").select(F.regexp_extract("uri", r"n_nationkey=(\d+)", 1).cast("int").alias("n_nationkey"), "chunk_ordinal", "content")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS text, CASE WHEN n_nationkey % 2 = 0 THEN 1.0::DOUBLE END AS quality, CASE WHEN n_nationkey % 2 = 1 THEN 'no parser for application/octet-stream' END AS error FROM nation")
def parsed_files(spark, sf):
    """Files by the parser of their type; one without a parser is a row with an error."""
    path = shared_dir(spark, "files")
    n = t(spark, sf, "nation").withColumn("kind", F.when(F.col("n_nationkey") % 2 == 0, "txt").otherwise("bin"))
    n.select(F.col("n_name").alias("value"), "kind", "n_nationkey").write.partitionBy("kind", "n_nationkey").option("lineSep", "\u0001").text(path)
    # Spark names its files itself, so the ending comes from the folder
    files = spark.read.format("binaryFile").load(f"{path}/*/*/part-*")
    return readers.parse_files(files, F.regexp_extract("path", r"kind=(\w+)", 1)).select(F.regexp_extract("uri", r"n_nationkey=(\d+)", 1).cast("int").alias("n_nationkey"), F.regexp_replace("text", "\u0001", "").alias("text"), "quality", "error")


def _workbook(sheets: dict[str, list[list]]) -> bytes:
    """A small workbook with inline texts."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            cell = lambda x, at: f'<c r="{at}"><v>{x}</v></c>' if isinstance(x, int) else f'<c r="{at}" t="inlineStr"><is><t>{x}</t></is></c>'
            body = "".join(f'<row r="{k}">' + "".join(cell(x, f"{chr(65 + j)}{k}") for j, x in enumerate(row)) + "</row>" for k, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


@query("""SELECT '## nation' || chr(10) || chr(10) || '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || (SELECT string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) FROM nation)
|| chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## region' || chr(10) || chr(10) || '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || (SELECT string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) FROM region) AS text, 1.0::DOUBLE AS quality""")
def workbook_sheets(spark, sf):
    sheets = {}
    for name, k in (("nation", "n"), ("region", "r")):
        rows = t(spark, sf, name).select(f"{k}_{name}key", f"{k}_name").orderBy(f"{k}_{name}key").collect()  # a workbook made on the spot
        sheets[name] = [["key", "name"], *[list(x) for x in rows]]
    files = spark.createDataFrame([("book.xlsx", bytearray(_workbook(sheets)))], "path string, content binary")
    return readers.parse_files(files, F.lit("xlsx")).select("text", "quality")


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'say \"' || c_name || '\", twice' END AS note, '[' || c_nationkey || ']' AS tags FROM customer")
def csv_round_trip(spark, sf):
    """Header, quotes, nested columns as JSON and empty nulls, written and read again with another delimiter."""
    path = shared_dir(spark, "tsv")
    c = t(spark, sf, "customer")
    note = F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit('say "'), "c_name", F.lit('", twice')))
    sinks.write_csv(c.select("c_custkey", note.alias("note"), F.array("c_nationkey").alias("tags")), path, "\t")
    return spark.read.option("header", True).option("sep", "\t").option("escape", '"').csv(path)


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS name, c_acctbal FROM customer")
def jsonl_round_trip(spark, sf):
    path = shared_dir(spark, "jsonl-out")
    c = t(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("name"), "c_acctbal")
    sinks.write_jsonl(c, path)
    return spark.read.schema(c.schema).json(path)


@query("SELECT CAST(vec_id AS VARCHAR) AS vec_id, CAST(label AS VARCHAR) AS label FROM embeddings")
def parquet_round_trip(spark, sf):
    path = shared_dir(spark, "parquet-out")
    sinks.write_parquet(t(spark, sf, "embeddings"), path)
    return spark.read.parquet(path)


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def partitioned_layout(spark, sf):
    """A folder per value; a filter on it reads the others' folders only."""
    path = shared_dir(spark, "layout")
    sinks.write_by(t(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")), path, "status")
    return spark.read.parquet(path).where("status != 'P'").groupBy("status").agg(F.count("*").alias("n"))


# --- edges from rows and texts ---


@query("SELECT CAST(s_suppkey AS VARCHAR) AS src, '00000000-0000-0000-0000-' || lpad(CAST(s_nationkey AS VARCHAR), 12, '0') AS dst, 'located_in' AS rel_type, CASE WHEN s_suppkey % 2 = 0 THEN 'w=1' ELSE '' END AS properties FROM supplier")
def edges_from_json(spark, sf):
    """Of three edges in each list one has a valid end and a type."""
    dst = F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.col("s_nationkey").cast("string"), 12, "0"))
    props = F.when(F.col("s_suppkey") % 2 == 0, F.lit(', "properties": {"w": "1"}')).otherwise("")
    j = F.concat(F.lit('[{"dst": "'), dst, F.lit('", "rel_type": "located_in"'), props, F.lit('}, {"dst": "n1", "rel_type": "bad"}, {"dst": "'), dst, F.lit('"}]'))
    e = graph.extract_edges(t(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), j.alias("j")), "j")
    return e.withColumn("properties", F.array_join(F.transform(F.map_entries("properties"), lambda x: F.concat_ws("=", x["key"], x["value"])), ","))


@query(r"SELECT CAST(page_id AS VARCHAR) AS src, regexp_extract(url, '://([^/?#]*)', 1) AS dst, 'on_host' AS rel_type FROM pages WHERE regexp_extract(url, '://([^/?#]*)', 1) <> ''")
def edges_from_texts(spark, sf):
    import re

    def provider(content: str) -> list[tuple[str, str]]:
        m = re.search(r"://([^/?#]*)", content)
        return [(m[1], "on_host")] if m and m[1] else []

    return graph.edges_from_texts(t(spark, sf, "pages").select(F.col("page_id").cast("string").alias("id"), F.col("url").alias("content")), provider)


@query("SELECT CAST(conv_id AS VARCHAR) AS src, 'turn' || turn AS dst, 'contains' AS rel_type FROM conversations UNION ALL SELECT DISTINCT CAST(conv_id AS VARCHAR), 's' || conv_id % 3, 'captured_in' FROM conversations")
def moment_edges(spark, sf):
    m = t(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.concat(F.lit("turn"), "turn")).alias("resource_ids"))
    return moments.moment_edges(m.select(F.col("conv_id").cast("string").alias("name"), "resource_ids", F.array(F.concat(F.lit("s"), F.col("conv_id") % 3)).alias("session_ids")))


# --- formats ---


@query("SELECT c_custkey, '[\"' || c_name || '\",\"' || c_mktsegment || '\"]' AS list, '{\"name\":\"' || c_name || '\",\"key\":' || c_nationkey || '}' AS struct, CAST(c_nationkey AS VARCHAR) AS number FROM customer")
def values_as_text(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", F.array("c_name", "c_mktsegment").alias("list"), F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("key")).alias("struct"), F.col("c_nationkey").alias("number"))
    return c.select("c_custkey", *[S.value_to_string(n, c.schema[n].dataType).alias(n) for n in ("list", "struct", "number")])


@query("SELECT doc_id, len(string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS n FROM documents")
def sentence_counts(spark, sf):
    from quarry.operators import chunk

    return t(spark, sf, "documents").select("doc_id", F.size(chunk.sentences(F.col("text"))).cast("long").alias("n"))


@query("SELECT event_id, event_id % 3 = 0 AS is_list, '[Processing part ' || event_id || '/9]' || chr(10) || chr(10) || props AS marked FROM events")
def list_content_and_marker(spark, sf):
    k = F.col("event_id") % 3
    e = t(spark, sf, "events").withColumn("c", F.when(k == 0, F.concat(F.lit("["), "props", F.lit("]"))).when(k == 1, F.col("props")).otherwise("[1, 2"))
    return e.select("event_id", S.is_list_json("c").alias("is_list"), S.chunk_marker("event_id", F.lit(9), "props").alias("marked"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size * 100 + p_partkey % 10 < 2503 THEN -1 WHEN p_size * 100 + p_partkey % 10 > 2503 THEN 1 ELSE 0 END AS c FROM part")
def version_compare(spark, sf):
    v = F.when(F.col("p_size") % 5 == 0, "one.two").otherwise(F.concat_ws(".", F.lit("1"), "p_size", F.col("p_partkey") % 10))
    return t(spark, sf, "part").select("p_partkey", S.semver_compare(v, F.lit("1.25.3")).alias("c"))


@query("SELECT c_custkey, concat_ws(chr(10), c_name, nullif(c_mktsegment, 'MACHINERY'), CAST(c_nationkey AS VARCHAR)) AS text FROM customer")
def embedding_texts(spark, sf):
    c = t(spark, sf, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("MACHINERY")))
    return c.select("c_custkey", S.embedding_text(["c_name", "c_mktsegment", "c_nationkey"]).alias("text"))


@query("SELECT o_orderkey, o_totalprice + o_custkey AS a, o_totalprice - o_custkey AS b, o_totalprice * o_custkey AS c, o_totalprice / o_custkey AS d FROM orders WHERE o_custkey <> 0")
def arithmetic(spark, sf):
    o, x = t(spark, sf, "orders").where("o_custkey != 0"), ("o_totalprice", "o_custkey")
    return o.select("o_orderkey", *[S.calculate(f, *x).alias(a) for a, f in (("a", "add"), ("b", "subtract"), ("c", "multiply"), ("d", "divide"))])


@query("SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS text FROM conversations GROUP BY conv_id")
def merge_custom(spark, sf):
    return aggregates.merge_custom(t(spark, sf, "conversations"), ["conv_id"], "turn", lambda texts: str(sum(map(len, texts))), "text").select("conv_id", F.col("text").cast("long").alias("text"))


# --- sessions ---


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, 't' || conv_id % 2 AS tenant_id FROM conversations WHERE conv_id = 2 GROUP BY conv_id")
def session_get(spark, sf):
    s = t(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.concat(F.lit("t"), F.col("conv_id") % 2).alias("tenant_id")).distinct()
    return sessions.get_session(s, "2", "t0").unionByName(sessions.get_session(s, "2", "t1"))


@query("SELECT conv_id || '-' || turn AS message_id, CASE WHEN turn % 2 = 0 THEN 2 ELSE 0 END AS n_feedback, CASE WHEN turn % 2 = 0 THEN (turn % 5) / 5.0 * 0.5 + 0.25 END AS avg_score FROM conversations")
def feedback_scores(spark, sf):
    """Feedback saved through the engine, which refuses scores out of range, and counted for each message."""
    e = _engine(spark)
    c = t(spark, sf, "conversations").withColumn("message_id", F.concat_ws("-", "conv_id", "turn"))
    when, fields = F.lit("2024-01-01").cast("timestamp"), ("feedback_id", "session_id", "message_id", "tenant_id", "score", "timestamp")
    half = c.where("turn % 2 = 0")
    rows = [half.select(F.concat("message_id", F.lit(f"/{i}")).alias("feedback_id"), F.col("conv_id").cast("string").alias("session_id"), "message_id", F.lit("default").alias("tenant_id"), s.alias("score"), when.alias("timestamp")) for i, s in enumerate((F.col("turn") % 5 / 5.0, F.lit(0.5)))]
    e.save_feedback(rows[0].unionByName(rows[1]).select(*fields))
    return sessions.with_feedback(c.select("message_id"), e.list("feedback").select("message_id", "score")).select("message_id", F.col("n_feedback").cast("int").alias("n_feedback"), "avg_score")


# --- streams ---


def _stream(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """A table as a stream of files."""
    path = shared_dir(spark, name)
    df.repartition(3).write.parquet(path)
    return changes.change_stream(spark, path, df.schema, 2)


def _result(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives until its source is read up: its micro-batches, of which a complete one replaces those before it."""
    path, checkpoint = shared_dir(spark, "stream"), shared_dir(spark, "checkpoint")
    changes.keep_batches(stream, path, mode, checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/*")


_OPS = "(SELECT user_id, event_id AS seq, value, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 'delete' ELSE 'update' END AS op FROM events)"


@query(f"SELECT user_id, arg_max(value, seq) AS value FROM {_OPS} GROUP BY user_id HAVING arg_max(op, seq) <> 'delete'")
def wal_follow(spark, sf):
    """A replica follows a change log in micro-batches, each applied to the buckets that it touches."""
    s = store.Store(spark, shared_dir(spark, "replica"), 4)
    s.commit("state", spark.createDataFrame([], "user_id bigint, value double"), ["user_id"])
    e = t(spark, sf, "events")
    low = e.agg(F.min("event_type")).first()[0]
    log = e.select("user_id", F.col("event_id").alias("seq"), "value", F.when(F.col("event_type") == low, "delete").otherwise("update").alias("op"))
    path = shared_dir(spark, "log")
    log.repartitionByRange(3, "seq").sortWithinPartitions("seq").write.parquet(path)
    changes.follow(changes.change_stream(spark, path, log.schema, 10), s, "state", ["user_id"], shared_dir(spark, "checkpoint")).awaitTermination()
    return s.read("state")


@query("SELECT * FROM (VALUES ('connect', 'connecting', 0), ('failed', 'error', 1), ('retry', 'connecting', 1), ('connected', 'syncing', 1), ('caught_up', 'synced', 0), ('behind', 'syncing', 0), ('disconnect', 'disconnected', 0)) v(event, state, failures)")
def replica_states(spark, sf):
    rep, rows = changes.ReplicaState(), []
    for event in ("connect", "failed", "retry", "connected", "caught_up", "behind", "disconnect"):
        rows.append((event, rep.on(event), rep.failures))
    return spark.createDataFrame(rows, "event string, state string, failures int")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, sf):
    e = _stream(spark, t(spark, sf, "events"), "events-w")
    found = _result(spark, changes.windowed_counts(changes.with_event_time(e), "1 day"), "complete")
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", r(F.col("total"), 4).alias("total"))


@query("""WITH e AS (SELECT *, coalesce(CAST(epoch(ts) - lag(epoch(ts)) OVER w >= 86400 AS INT), 1) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, min(ts) AS start_time, max(ts) + INTERVAL 1 DAY AS end_time, count(*) AS n FROM s GROUP BY user_id, s""")
def stream_sessions(spark, sf):
    e = _stream(spark, t(spark, sf, "events"), "events-s")
    found = _result(spark, changes.session_counts(changes.with_event_time(e), "1 day"), "complete")
    return found.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start_time", "end_time")], "n")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_deduplicated(spark, sf):
    """Every event twice in the stream, within a watermark that spans them all."""
    e = t(spark, sf, "events")
    s = changes.with_event_time(_stream(spark, e.union(e), "events-d"), delay="10000 days")
    return _result(spark, changes.deduplicated(s).select("event_id", "event_type"), "append").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT a.event_id, b.event_id AS right_event_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOURS WHERE a.event_type = (SELECT min(event_type) FROM events) AND b.event_type = (SELECT max(event_type) FROM events)")
def stream_join(spark, sf):
    e = t(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    low, high = e.agg(F.min("event_type"), F.max("event_type")).first()
    a, b = (changes.with_event_time(_stream(spark, e.where(F.col("event_type") == x), "events-j"), delay="10000 days") for x in (low, high))
    return _result(spark, changes.join_streams(a, b, "user_id", "2 HOURS").select("event_id", "right_event_id"), "append")


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def stream_totals(spark, sf):
    """State kept for each key over micro-batches: its last row holds all of them."""
    found = _result(spark, changes.running_totals(_stream(spark, t(spark, sf, "events"), "events-t")), "update")
    return found.groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total")).withColumn("total", r(F.col("total"), 4))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def hot_refresh(spark, sf):
    """A hot copy rebuilt from each micro-batch of a source; empty ones are skipped."""
    s = store.Store(spark, shared_dir(spark, "hot"), 4)
    s.commit("hot", spark.createDataFrame([], "event_id bigint, event_type string"), ["event_id"])
    e = t(spark, sf, "events").select("event_id", "event_type")
    keep = lambda batch: s.change("hot", batch.select("event_id"), lambda old: old.unionByName(batch))
    q = changes.refresh(spark, _stream(spark, e, "events-h"), keep, shared_dir(spark, "checkpoint"), 1)
    q.processAllAvailable()
    q.stop()
    return s.read("hot").groupBy("event_type").agg(F.count("*").alias("n"))
