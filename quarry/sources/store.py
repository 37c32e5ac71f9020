"""Entity tables as immutable versions, with upserts, tombstones and a change log.

merge functions take and return DataFrames; Store keeps the versions of tables. A reader keeps the version that it opened.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.errors import QuarryError
from quarry.sources import files


def latest(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last change of each key, by aggregation with map-side combine."""
    rest = [c for c in changes.columns if c not in keys]
    best = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return best.select(*keys, "_r.*").select(*changes.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], now, order: str | None = None) -> DataFrame:
    """old with the rows of new put in: created_at and edges of the old row are kept (new edges win by (dst, rel_type)),
    other fields are replaced and a tombstone is lifted."""
    fresh = latest(new, keys, order).drop(order) if order else new
    o, n = old.alias("o"), fresh.alias("n")
    both = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full")
    isnew, was = F.col(f"n.{keys[0]}").isNotNull(), F.col(f"o.{keys[0]}").isNotNull()
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
        elif c == "created_at":
            out.append(F.when(was, F.col("o.created_at")).otherwise(F.lit(now)).alias(c))
        elif c == "modified_at":
            out.append(F.when(isnew, F.lit(now)).otherwise(F.col("o.modified_at")).alias(c))
        elif c == "deleted_at":
            out.append(F.when(~isnew, F.col("o.deleted_at")).alias(c))
        elif c == "edges" and c in fresh.columns:
            out.append(F.when(isnew & was, merge_inline_edges(F.col("o.edges"), F.col("n.edges"))).when(isnew, F.col("n.edges")).otherwise(F.col("o.edges")).alias(c))
        elif c in fresh.columns:
            out.append(F.when(isnew, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.when(~isnew, F.col(f"o.{c}")).alias(c))
    return both.select(*out)


def patch(old: DataFrame, changes: DataFrame, keys: list[str], now) -> DataFrame:
    """Fields of a change that aren't null replace those of its row; rows that don't exist aren't made."""
    other = changes.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in changes.columns if c not in keys], F.lit(True).alias("_hit"))
    both = old.join(other, keys, "left")
    cols = [F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c) if f"_n_{c}" in other.columns else (F.when(F.col("_hit"), F.lit(now)).otherwise(F.col(c)).alias(c) if c == "modified_at" else F.col(c)) for c in old.columns]
    return both.select(*cols)


def soft_delete(old: DataFrame, gone: DataFrame, keys: list[str], now) -> DataFrame:
    """Sets deleted_at and modified_at of the given keys."""
    both = old.join(gone.select(*keys).distinct().withColumn("_gone", F.lit(True)), keys, "left")
    stamp = lambda c: F.when(F.col("_gone"), F.lit(now)).otherwise(F.col(c)).alias(c)
    return both.select(*[stamp(c) if c in ("deleted_at", "modified_at") else F.col(c) for c in old.columns])


def hard_delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone, keys, "left_anti")


def merge_inline_edges(old, new):
    """Edge arrays by (dst, rel_type): old order, replaced by new ones; the rest of the new ones follow."""
    same = lambda a, b: (a["dst"] == b["dst"]) & (a["rel_type"] == b["rel_type"])
    o, n = F.coalesce(old, F.array()), F.coalesce(new, F.array())
    replaced = F.transform(o, lambda e: F.when(F.exists(n, lambda x: same(x, e)), F.get(F.filter(n, lambda x: same(x, e)), F.lit(0))).otherwise(e))
    added = F.filter(n, lambda e: ~F.exists(o, lambda x: same(x, e)))
    return F.concat(replaced, added)


def apply_changes(state: DataFrame, changes: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """state after a change log (op insert, update or delete): the last change of a key counts, deletes remove it.
    Applying the same changes again alters nothing."""
    last = latest(changes, keys, order)
    kept = state.join(last, keys, "left_anti")
    put = last.where("op != 'delete'").select(*[F.col(c) if c in last.columns else F.lit(None).cast(state.schema[c].dataType).alias(c) for c in state.columns])
    return kept.unionByName(put)


def tail(log: DataFrame, after: int, limit: int | None = None) -> DataFrame:
    out = log.where(F.col("seq") > after).orderBy("seq")
    return out if limit is None else out.limit(limit)


def compact_log(log: DataFrame, before: int) -> tuple[DataFrame, int]:
    """(entries from `before` on, how many went)."""
    return log.where(F.col("seq") >= before), log.where(F.col("seq") < before).count()


def log_status(log: DataFrame, replica_seq: int) -> DataFrame:
    """entries, primary_seq, replica_seq, lag."""
    return log.agg(F.count("*").alias("entries"), F.coalesce(F.max("seq"), F.lit(0)).alias("primary_seq")).withColumn("replica_seq", F.lit(replica_seq).cast("long")).withColumn("lag", F.col("primary_seq") - F.col("replica_seq"))


def numbered_changes(changes: DataFrame, start: int, order: list[str]) -> DataFrame:
    """changes with seq from start on, in the given order: numbers inside ranges plus prefix sums of their counts."""
    from quarry.session import cut

    rows = cut(changes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "changes")
    base, bases = start, []
    for r in rows.groupBy("_p").count().orderBy("_p").collect():  # one row a range
        bases.append((r["_p"], base))
        base += r["count"]
    n = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return rows.join(F.broadcast(changes.sparkSession.createDataFrame(bases, "_p int, _b bigint")), "_p").withColumn("seq", F.col("_b") + n).drop("_p", "_b")


class CommitConflict(QuarryError):
    """Another writer has committed in between."""

    recoverable = True


class Store:
    """Tables in a folder. A version is a manifest: for each bucket of keys, the folder that holds its rows.

    A change rewrites the buckets that it touches and points to the others. A manifest is created
    exclusively, so of two writers of one version one wins and the other one starts again from what it finds.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _where(self, table: str, version: int) -> str:
        return f"{self.path}/commits/{table}/{version:012d}.json"

    def versions(self, table: str) -> list[int]:
        return [int(n[:-5]) for n in files.names(self.spark, f"{self.path}/commits/{table}") if n.endswith(".json")]

    def version(self, table: str) -> int:
        return max(self.versions(table), default=0)

    def manifest(self, table: str, version: int | None = None) -> dict:
        version = version or self.version(table)
        if not version:
            raise FileNotFoundError(table)
        return json.loads(files.read(self.spark, self._where(table, version)))

    def _rows(self, m: dict, only: list[int] | None = None) -> DataFrame:
        paths = [p for b, p in m["buckets"].items() if only is None or int(b) in only]
        schema = T.StructType.fromJson(m["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The current rows, or those of an earlier version."""
        return self._rows(self.manifest(table, version))

    def _write(self, table: str, version: int, rows: DataFrame, keys: list[str], n: int, sort: list[str]) -> dict[str, str]:
        """Writes rows by bucket; the folders of the buckets that have any. Files are sorted by `sort`, so a scan can skip most
        of their row groups, and have Bloom filters of it."""
        folder = f"{self.path}/data/{table}/{version:08d}-{uuid.uuid4().hex[:8]}"
        dealt = rows.withColumn("_bucket", _bucket(keys, n) if keys else F.lit(0)).repartition("_bucket", *keys)
        out = dealt.sortWithinPartitions("_bucket", *sort).write.partitionBy("_bucket")
        for c in sort:
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
        out.parquet(folder)
        return {x.split("=")[1]: f"{folder}/{x}" for x in files.names(self.spark, folder) if x.startswith("_bucket=")}

    def commit(self, table: str, rows: DataFrame, keys: Sequence[str] = ("tenant_id", "id"), sort: Sequence[str] = ()) -> int:
        """Makes rows the table's next version, whole."""
        v = self.version(table) + 1
        own = [k for k in keys if k in rows.columns]
        n = self.buckets if own else 1
        m = {"keys": own, "n": n, "sort": list(sort), "schema": rows.schema.jsonValue(), "buckets": self._write(table, v, rows, own, n, list(sort))}
        if not files.claim(self.spark, self._where(table, v), json.dumps(m)):
            raise CommitConflict(f"version {v} of {table} is taken")
        return v

    def change(self, table: str, touched: DataFrame, make: Callable[[DataFrame], DataFrame], tries: int = 10) -> int:
        """Commits make(rows) for the buckets of the keys in `touched`; the others stay as they are. Where another writer was
        faster, it is made again from that one's rows."""
        for _ in range(tries):
            v = self.version(table)
            m = self.manifest(table, v)
            if not m["keys"]:
                only = [0]
            else:
                only = [r[0] for r in touched.select(_bucket(m["keys"], m["n"]).alias("b")).distinct().collect()]  # n numbers at most
            new = make(self._rows(m, only))
            made = self._write(table, v + 1, new, m["keys"], m["n"], m["sort"])
            m["buckets"] = {b: p for b, p in m["buckets"].items() if int(b) not in only} | made
            m["schema"] = new.schema.jsonValue()
            if files.claim(self.spark, self._where(table, v + 1), json.dumps(m)):
                return v + 1
        raise CommitConflict(f"{table} was changed by others {tries} times")

    def restore(self, table: str, version: int) -> int:
        """Makes an earlier version the current one; its files are used again."""
        v = self.version(table) + 1
        if not files.claim(self.spark, self._where(table, v), json.dumps(self.manifest(table, version))):
            raise CommitConflict(f"version {v} of {table} is taken")
        return v

    def backup(self, table: str, target: str) -> int:
        """Commits the current rows to a store in another folder; returns the version there."""
        m = self.manifest(table)
        return Store(self.spark, target, self.buckets).commit(table, self.read(table), m["keys"], m["sort"])

    def tables(self) -> list[str]:
        return files.names(self.spark, f"{self.path}/commits")

    def backups(self) -> DataFrame:
        """table_name, version of what this folder holds."""
        rows = [(t, v) for t in self.tables() for v in self.versions(t)]
        return self.spark.createDataFrame(rows, "table_name string, version int")

    def forget(self, table: str, version: int) -> bool:
        """Deletes a version that isn't the current one, and the bucket folders that no other version uses."""
        if version == self.version(table):
            raise QuarryError(f"version {version} of {table} is the current one")
        gone = set(self.manifest(table, version)["buckets"].values())
        files.delete(self.spark, self._where(table, version))
        used = {p for v in self.versions(table) for p in self.manifest(table, v)["buckets"].values()}
        return all([files.delete(self.spark, p) for p in gone - used])


def _bucket(keys: list[str], n: int):
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(n)).cast("int")
