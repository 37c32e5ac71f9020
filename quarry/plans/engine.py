"""Engine: tables of a folder, with the verbs of the document store."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import asdict, is_dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.errors import QuarryError, QueryError
from quarry.functions.scalar import embedding_text, entity_uuid, key_value
from quarry.operators import graph
from quarry.operators import lookup as lk
from quarry.operators import vector
from quarry.plans import query_plan, verbs
from quarry.plans.embed import Provider, embed_column, hash_embedder
from quarry.registry import Registry
from quarry.session import cut, scope
from quarry.sources import sinks
from quarry.sources.store import Store, hard_delete, latest, patch, soft_delete, upsert


class Engine:
    """Registered tables in a folder. Rows have tenant_id, id, entity_type, times, and the fields of their schema; tables with
    embedding_fields also hold the embedding of each row, made when the row is written."""

    def __init__(self, spark: SparkSession, path: str, tenant: str = "default", provider: Provider | None = None):
        self.spark, self.tenant = spark, tenant
        self.registry, self.store = Registry(), Store(spark, path)
        self.provider = provider or hash_embedder()
        self._schemas = f"{path.rstrip('/')}/schemas"
        self.registry.load(spark, self._schemas)

    def register_schema(self, schema: dict) -> str:
        """Registers a schema and keeps it in the folder, where a later Engine finds it."""
        name = self.registry.register(schema)
        self.registry.save(self.spark, self._schemas, name)
        return name

    def _table(self, name: str, include_deleted: bool = False) -> DataFrame:
        self.registry.get(name)
        return lk.live(self.store.read(name).where(F.col("tenant_id") == self.tenant), include_deleted)

    def _embedded(self, name: str, rows: DataFrame) -> DataFrame:
        fields = self.registry.embedding_fields(name)
        return rows.withColumn("embedding", embed_column(embedding_text(fields), self.provider)) if fields else rows

    def insert(self, name: str, rows: DataFrame, ordinal: str | None = None) -> int:
        """Upsert by identity (uri and ordinal, else the key field, key or name); of rows with the same identity the last one of the
        input counts, and rows without a key get an id of their own. Refuses all rows if one breaks the schema."""
        bad = self.registry.violations(name, rows).where(F.size("problems") > 0)
        if (first := bad.select("problems").first()) is not None:
            raise QueryError(f"{name}: {'; '.join(first[0])}")
        ordinal = ordinal or ("chunk_ordinal" if "chunk_ordinal" in rows.columns else None)
        key = key_value(rows.columns, self.registry.key_field(name))
        fields = [f for f in self.registry.struct(name).fields]
        cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
        now = self.spark.range(1).select(F.current_timestamp()).first()[0]
        system = [F.lit(self.tenant).alias("tenant_id"), F.coalesce(entity_uuid(F.lit(name), key, ordinal), F.uuid()).alias("id"), F.lit(name).alias("entity_type")]
        names = {"tenant_id", "id", "entity_type", "created_at", "modified_at", "deleted_at", "embedding"}
        keys = ["tenant_id", "id"]
        numbered = rows.select(*system, *[c for c, f in zip(cols, fields) if f.name not in names], F.monotonically_increasing_id().alias("_order"))
        with scope(self.spark):
            new = cut(self._embedded(name, latest(cut(numbered), keys, "_order").drop("_order")), "inserted")  # written once: ids don't change any more
            if self.store.version(name) == 0:
                stamped = new.withColumns({"created_at": F.lit(now), "modified_at": F.lit(now), "deleted_at": F.lit(None).cast("timestamp")})
                return self.store.commit(name, stamped, keys, self.registry.indexed_fields(name))
            return self.store.change(name, new.select(*keys), lambda old: upsert(old, new, keys, now))

    def upsert(self, models: Iterable[Any]) -> dict[str, list[str]]:
        """Inserts objects of several kinds: each goes to the table of its class's name in lower case ("dict" for plain dicts, unless
        they name a table in entity_type). Returns the ids by table."""
        by: dict[str, list[dict]] = {}
        for m in models:
            row = dict(m) if isinstance(m, dict) else m.model_dump() if hasattr(m, "model_dump") else asdict(m) if is_dataclass(m) else dict(vars(m))
            by.setdefault(row.pop("entity_type", None) or type(m).__name__.lower(), []).append(row)
        out = {}
        for name, rows in by.items():
            names = list(dict.fromkeys(k for r in rows for k in r))
            kinds = {f.name: f.dataType for f in self.registry.struct(name).fields}
            schema = T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])
            df = self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)
            self.insert(name, df)
            ordinal = "chunk_ordinal" if "chunk_ordinal" in names else None
            ids = df.select(entity_uuid(F.lit(name), key_value(names, self.registry.key_field(name)), ordinal).alias("id")).collect()  # of objects that the caller holds
            out[name] = [r["id"] for r in ids]
        return out

    def update(self, name: str, changes: DataFrame) -> int:
        """changes: id and the fields to replace; rows whose embedding fields may have changed are embedded again."""
        keys, now = ["tenant_id", "id"], F.current_timestamp()
        new = changes.withColumn("tenant_id", F.lit(self.tenant))
        again = bool(set(self.registry.embedding_fields(name)) & set(changes.columns))

        def make(old: DataFrame) -> DataFrame:
            patched = patch(old, new, keys, now)
            if not again:
                return patched
            hit = patched.join(new.select(*keys).distinct(), keys, "left_semi").drop("embedding")
            return patched.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(self._embedded(name, hit))

        return self.store.change(name, new.select(*keys), make)

    def delete(self, name: str, ids: DataFrame, hard: bool = False) -> int:
        keys = ids.select("id").withColumn("tenant_id", F.lit(self.tenant))
        return self.store.change(name, keys, lambda old: hard_delete(old, keys, ["tenant_id", "id"]) if hard else soft_delete(old, keys, ["tenant_id", "id"], F.current_timestamp()))

    def list(self, name: str, include_deleted: bool = False, limit: int | None = None) -> DataFrame:
        return lk.scan(self._table(name, include_deleted), True, limit)

    def count(self, name: str, include_deleted: bool = False) -> int:
        return self._table(name, include_deleted).count()

    def get(self, name: str, value: str) -> DataFrame:
        return lk.get(self._table(name, True), value)

    def key_index(self, name: str | None = None) -> DataFrame:
        """Keys of one table or of all that have rows."""
        names = [name] if name else [n for n in self.registry.names() if self.store.version(n)]
        parts = [lk.key_index(self._table(n, True), n, key_field=self.registry.key_field(n)) for n in names]
        if not parts:
            return self.spark.createDataFrame([], "key_value string, id string, entity_type string")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def lookup(self, *keys: str, table: str | None = None) -> DataFrame:
        return lk.first_by_key(self.key_index(table), list(keys))

    def search(self, name: str, text: str, limit: int = 10, where: str | None = None) -> DataFrame:
        """Live rows whose stored embedding is nearest to the text's; a condition is applied first. Rows with none, or with one of
        another length, don't take part."""
        if not self.registry.embedding_fields(name):
            raise QueryError(f"{name} has no embedding_fields")
        rows = self._table(name)
        rows = rows.where(where) if where else rows
        return vector.top_k(rows, [float(x) for x in self.provider([text])[0]], limit).drop("embedding")

    def search_result(self, name: str, text: str, limit: int = 10) -> dict:
        """What a search tool answers: query, tenant_id, schema, results (entity and score) and total; an error makes them empty."""
        out = {"query": text, "tenant_id": self.tenant, "schema": name, "results": [], "total": 0}
        try:
            rows = self.search(name, text, limit).select("score", F.to_json(F.struct("*")).alias("entity")).collect()  # limit rows
        except (QuarryError, FileNotFoundError) as e:
            return out | {"error": str(e)}
        results = [{"entity": {k: v for k, v in json.loads(r["entity"]).items() if k not in ("score", "distance")}, "score": r["score"]} for r in rows]
        return out | {"results": results, "total": len(results)}

    def find(self, name: str, field: str, value: Any) -> DataFrame:
        """Live rows by one of the schema's indexed fields: files are sorted by those, so a scan skips most row groups."""
        if field not in self.registry.indexed_fields(name):
            raise QueryError(f"{field} is not an indexed field of {name}")
        return self._table(name).where(F.col(field) == F.lit(value))

    def save_feedback(self, rows: DataFrame) -> int:
        """Feedback rows; refuses all where a score is not from 0 to 1."""
        if "score" in rows.columns and not rows.where("score IS NOT NULL AND NOT score BETWEEN 0 AND 1").isEmpty():
            raise QueryError("a score must be 0 to 1")
        return self.insert("feedback", rows)

    def add_edges(self, edges: DataFrame) -> int:
        """Puts edges (src, dst, rel_type, properties) into the table edges; one with the same ends and type is replaced."""
        kinds = {"src": "string", "dst": "string", "rel_type": "string", "properties": "map<string,string>"}
        new = edges.select(*[F.col(c).cast(k).alias(c) if c in edges.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()])
        keys = ["src", "dst", "rel_type"]
        if self.store.version("edges") == 0:
            return self.store.commit("edges", graph.merge_edges(new.limit(0), new), keys)
        return self.store.change("edges", new.select(*keys), lambda old: graph.merge_edges(old, new))

    def edges_of(self, node: str, direction: str = "both") -> DataFrame:
        return graph.neighbours(self.store.read("edges"), node, direction)

    def delete_edges(self, edges: DataFrame) -> int:
        """edges: src, dst, rel_type."""
        return self.store.change("edges", edges, lambda old: graph.remove_edges(old, edges))

    def traverse(self, start: str, depth: int, direction: str = "out", rel_type: str | None = None, edges: DataFrame | None = None) -> DataFrame:
        return graph.bfs(self.store.read("edges") if edges is None else edges, [start], depth, direction, rel_type)

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the live rows of the registered tables."""
        for n in self.registry.names():
            if self.store.version(n):
                self._table(n).createOrReplaceTempView(n)
        return self.spark.sql(text)

    def query(self, text: str) -> DataFrame:
        q = verbs.parse(text)
        if isinstance(q, verbs.Lookup):
            return self.lookup(*q.keys)
        if isinstance(q, verbs.Traverse):
            return self.traverse(q.start, q.depth, q.direction, q.rel_type)
        if isinstance(q, verbs.Search):
            return self.search(q.table, q.text, q.limit, q.where)
        return self.sql(q.text)

    def similar_schemas(self, text: str, limit: int = 3) -> DataFrame:
        """Registered schemas by the similarity of their descriptions to a text."""
        rows = self.registry.table(self.spark).withColumn("embedding", embed_column(F.concat_ws(" ", "name", "description"), self.provider))
        return vector.top_k(rows, [float(x) for x in self.provider([text])[0]], limit, id_col="name").select("name", "score")

    def discover(self, text: str, hint: str | None = None, few: int = 10, limit: int = 3) -> list[str]:
        """Tables to look in for a question: the hinted one, all of the user's if there are few, else the most similar ones."""
        if hint and self.registry.has(hint):
            return [hint]
        own = [n for n in self.registry.names() if self.registry.category(self.registry.get(n)) != "system"]
        return sorted(own) if len(own) <= few else [r["name"] for r in self.similar_schemas(text, limit).collect()]

    def export(self, name: str, path: str, kind: str = "parquet") -> None:
        write = {"parquet": sinks.write_parquet, "csv": sinks.write_csv, "jsonl": sinks.write_jsonl, "tsv": lambda df, p: sinks.write_csv(df, p, "\t")}[kind]
        write(self.list(name), path)

    def ask(self, question: str, planner: Callable[[str], str] | None = None) -> DataFrame:
        return query_plan.run_staged(query_plan.plan(question, planner), self.query)[0]
