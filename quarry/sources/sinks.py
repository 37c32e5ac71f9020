"""Exports: Parquet, CSV and TSV, JSON lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.errors import ExportError


def _flat(df: DataFrame, null: str | None = None) -> DataFrame:
    """Columns in the order of their names, nested ones as JSON, all as strings."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    cols = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        c = F.to_json(f.name) if isinstance(f.dataType, nested) else F.col(f.name).cast("string")
        cols.append((F.coalesce(c, F.lit(null)) if null is not None else c).alias(f.name))
    return df.select(*cols)


def _refuse_empty(df: DataFrame) -> None:
    if df.isEmpty():
        raise ExportError("nothing to export")


def parquet_frame(df: DataFrame) -> DataFrame:
    """What write_parquet() writes: strings, without embeddings."""
    return _flat(df.drop(*[c for c in df.columns if c.startswith("embedding")]))


def write_parquet(df: DataFrame, path: str) -> None:
    _refuse_empty(df)
    parquet_frame(df).write.option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """With a header; nulls are empty. sep="\\t" makes TSV."""
    _refuse_empty(df)
    _flat(df, "").write.option("header", True).option("sep", sep).option("escape", '"').option("emptyValue", "").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """A record a line; an empty table makes no lines."""
    df.write.option("ignoreNullFields", False).json(path)


def write_by(df: DataFrame, path: str, *columns: str) -> None:
    """A folder per value, e.g. of tenant_id or date."""
    df.write.partitionBy(*columns).parquet(path)


def all_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """One frame of several tables, with entity_type; fields that a table lacks are null."""
    parts = [df.withColumn("entity_type", F.lit(n)) for n, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
