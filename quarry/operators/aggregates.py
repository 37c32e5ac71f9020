"""Aggregates with the document store's rules, and summaries."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_rows() -> Column:
    """Rows, nulls too."""
    return F.count(F.lit(1)).alias("count")


def _number(field: str) -> Column:
    return F.col(field).try_cast("double")


def total(field: str) -> Column:
    """Zero for no numbers at all."""
    return F.coalesce(F.sum(_number(field)), F.lit(0.0))


def mean(field: str) -> Column:
    return F.coalesce(F.avg(_number(field)), F.lit(0.0))


def least(field: str) -> Column:
    """Of numbers only; null for none."""
    return F.min(_number(field))


def greatest(field: str) -> Column:
    return F.max(_number(field))


def token_usage(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Sums of input_tokens, output_tokens and estimated_cost_usd, and the number of chunks."""
    return chunks.groupBy(*by).agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("estimated_cost_usd").alias("estimated_cost_usd"), F.count("*").alias("chunks")
    )


def edge_summary(edges: DataFrame) -> DataFrame:
    """Edges, relation types and mean confidence."""
    return edges.agg(F.count("*").alias("edges"), F.countDistinct("rel_type").alias("rel_types"), F.avg("confidence").alias("avg_confidence"))


def degree_stats(edges: DataFrame) -> DataFrame:
    """nodes with edges, edges, mean and largest out-degree."""
    d = edges.groupBy("src").count()
    return d.agg(F.count("*").alias("nodes"), F.sum("count").alias("edges"), F.avg("count").alias("avg_degree"), F.max("count").alias("max_degree"))


def coverage(rows: DataFrame, by: str, field: Column) -> DataFrame:
    """Rows, mean JSON size and share with the field, by group."""
    return rows.groupBy(by).agg(F.count("*").alias("rows"), F.avg(F.length(F.to_json(F.struct("*")))).alias("avg_bytes"), F.avg(field.isNotNull().cast("double")).alias("coverage"))


def document_quality(tables: DataFrame, by: str) -> DataFrame:
    """Mean table confidence: less 0.15 for over ten columns, less 0.2 for OCR confidence under 0.8, never negative."""
    c = F.col("confidence") - F.when(F.col("n_columns") > 10, 0.15).otherwise(0.0) - F.when(F.col("ocr_confidence") < 0.8, 0.2).otherwise(0.0)
    return tables.groupBy(by).agg(F.avg(F.greatest(c, F.lit(0.0))).alias("quality"))


def merge_chunks(parts: DataFrame, by: list[str], order: str, field: str, how: str) -> DataFrame:
    """Joins results of chunks: concat (strings), extend (lists), first or last."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, field))), lambda s: s[field])
    out = {
        "concat": lambda: F.array_join(ordered, "\n"),
        "extend": lambda: F.flatten(ordered),
        "first": lambda: F.min_by(field, order),
        "last": lambda: F.max_by(field, order),
    }[how]()
    return parts.groupBy(*by).agg(out.alias(field))


def merge_custom(parts: DataFrame, by: list[str], order: str, merge: Callable[[list], str], field: str) -> DataFrame:
    """Joins the chunks of a group by a function of their values in order; a group's chunks have to fit one task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = rows.iloc[:1][by].copy()
        out[field] = merge(rows.sort_values(order)[field].tolist())
        return out

    kinds = ", ".join(f"{c} {parts.schema[c].dataType.simpleString()}" for c in by)
    return parts.groupBy(*by).applyInPandas(run, f"{kinds}, {field} string")


def merge_values(values: list):
    """Lists are joined, dictionaries merged key by key, of anything else the first stays."""
    if all(isinstance(v, list) for v in values):
        return [x for v in values for x in v]
    if all(isinstance(v, dict) for v in values):
        return {k: merge_values([v[k] for v in values if k in v]) for k in dict.fromkeys(k for v in values for k in v)}
    return values[0]
