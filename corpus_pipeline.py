"""Corpus pipeline: five stages over documents, from raw texts to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which its caller writes as Parquet and reads
again as the next one's docs, as run() does. All but the last return the columns of documents. A stage
begins by deleting what the stage before it over the same sf_dir kept in the shared folder, and nothing else: its result is
written by then. So one run over an sf_dir at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, line_dedup, ngram_join, packing, quality
from quarry.llm.common import delete, keeping, shared_dir, table

#: Folders that the last stage over an sf_dir keeps.
_kept: dict[str, list[str]] = {}


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for path in _kept.pop(sf_dir, ()):
            delete(spark, path)
        with keeping(_kept.setdefault(sf_dir, [])):
            return f(spark, docs, sf_dir)

    return stage


@_stage
def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.7 or more."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@_stage
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line equals or nearly equals; those of which nothing is left go."""
    return line_dedup.drop_lines(docs)


@_stage
def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return ngram_join.near_copies(docs)


@_stage
def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly benchmark go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 ids."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), kept_words=700_000)  # the workers hold what earlier stages left as well


STAGES = [("quality_classifier", filter_quality), ("line_dedup", dedup_lines), ("ngram_jaccard_join", dedup_near), ("benchmark_decontamination", remove_benchmark), ("best_fit_packing", pack)]

#: SQL can't express the trained classifier, the near-copy classes or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
