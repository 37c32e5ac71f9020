"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task turns into Python objects at once. Spark bounds the Arrow batch itself by bytes.
SLICE_ROWS = 256
#: Keys with the most rows that join_frequent() sends to every task.
FREQUENT_KEYS = 1000

_base: dict[str, str] = {}  # by application, where spark.checkpoint.dir is unset


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where the setting is missing, a temporary folder takes its place in a local session; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _base.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="quarry-"))
    return f"{base.rstrip('/')}/quarry/{name}-{uuid.uuid4().hex}"


_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


@contextmanager
def keeping(paths: list[str]) -> Iterator[list[str]]:
    """Notes in `paths` the folders that stored() writes inside and nobody drops."""
    before = _scope.set(paths)
    try:
        yield paths
    finally:
        _scope.reset(before)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end what stored() wrote inside: for a caller that writes its results there and then."""
    with keeping([]) as paths:
        yield paths
    for path in paths:
        delete(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    if (paths := _scope.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def drop_stored(*frames: DataFrame) -> None:
    """Deletes what stored() wrote for these frames; call it when nothing reads them any more."""
    for df in frames:
        delete(df.sparkSession, df.stored_path)
        if df.stored_path in (_scope.get() or ()):
            _scope.get().remove(df.stored_path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows, so that few texts are Python objects at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def join_frequent(rows: DataFrame, small: DataFrame, key: str, size: str, spread: Sequence[str], how: str = "left", frequent: int = FREQUENT_KEYS) -> DataFrame:
    """rows joined with small, which has one row a key and says in `size` how many rows have it.

    The `frequent` keys with the most rows are broadcast, so none of them lands in one task. Each other key has at most
    1 / `frequent` of all rows and is joined by shuffle; rows that have found theirs, or have no key, are
    dealt out by the columns `spread`. how: left or inner.
    """
    cols = [c for c in small.columns if c != key]
    top = small.orderBy(F.desc(size), key).limit(frequent).select(F.col(key).alias("_top"), *[F.col(c).alias(f"_top_{c}") for c in cols])
    rest = small.select(F.col(key).alias("_rest"), *[F.col(c).alias(f"_rest_{c}") for c in cols])
    kind = small.schema[key].dataType.simpleString()
    away = F.xxhash64(*spread) if kind == "bigint" else F.unhex(F.hex(F.xxhash64(*spread))).cast(kind)
    open_ = F.col("_top").isNull() & F.col(key).isNotNull()
    met = rows.join(F.broadcast(top), F.col(key) == F.col("_top"), "left").withColumn("_aim", F.coalesce(F.when(open_, F.col(key)), away))
    both = met.join(rest, F.col("_aim") == F.col("_rest"), "left")
    found = F.col("_top").isNotNull() | (F.col(key).isNotNull() & F.col("_rest").isNotNull())
    both = both.where(found) if how == "inner" else both
    taken = [F.when(F.col("_top").isNotNull(), F.col(f"_top_{c}")).when(F.col(key).isNotNull(), F.col(f"_rest_{c}")).alias(c) for c in cols]
    return both.select(*rows.columns, *taken)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
