"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from quarry.sources import files

_base: dict[str, str] = {}  # by application, where spark.checkpoint.dir is unset
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def session(app: str = "quarry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; give other settings with _ for dots."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    return (b.master(master) if master else b).getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a temporary one stands in for a local session;
    on a cluster that is an error, as executors wouldn't see it."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _base.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="quarry-"))
    return f"{base.rstrip('/')}/quarry-core/{name}-{uuid.uuid4().hex}"


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what cut() wrote inside: for a caller that writes its results there and then."""
    paths: list[str] = []
    before = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(before)
    for path in paths:
        files.delete(spark, path)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df without its lineage: written to the shared folder, where a lost executor doesn't take it along."""
    path = shared_dir(df.sparkSession, name)
    if (paths := _scope.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
