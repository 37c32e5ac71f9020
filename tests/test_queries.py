"""Every registered query against its SQL; those without SQL run and return rows."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import SF
from oracle import same
from pyspark.sql import functions as F

from quarry.catalogue import ORACLE, QUERIES
from quarry.functions.vectors import METRICS
from quarry.operators import vector


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    same(spark, SF, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_medoid_sums_over_all_rows(spark):
    x = np.random.default_rng(2).normal(size=(1500, 2))
    sums = np.linalg.norm(x[:, None] - x[None], axis=2).sum(1)
    best = vector.medoid(spark.createDataFrame(list(enumerate(x.tolist())), "id int, embedding array<double>")).first()
    assert best["id"] == sums.argmin() and abs(best["total"] - sums.min()) < 1e-6


def test_medoid_of_many_rows_with_copies_and_a_missing_vector(spark):
    x = np.random.default_rng(3).normal(size=(3000, 16)).round(2)
    x[2000:2900] = x[5]
    x[2900:] = x[5] + 1e-9
    sums = sum(np.sqrt(((x - y) ** 2).sum(1)) for y in x).round(4)
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(9999, None)]
    got = vector.medoid(spark.createDataFrame(rows, "id int, embedding array<double>"), digits=4).first()
    assert got["id"] == sums.argmin() and abs(got["total"] - sums.min()) < 1e-3


@pytest.mark.parametrize("metric", ["cosine", "l2", "squared_l2"])
def test_distance_sums_against_all_pairs(spark, metric):
    x = np.random.default_rng(4).normal(size=(60, 3))
    x[7] = 0
    df = spark.createDataFrame(list(enumerate(x.tolist())), "id int, embedding array<double>")
    pairs = df.crossJoin(df.where("id < 25").select(F.col("embedding").alias("other"))).groupBy("id").agg(F.sum(METRICS[metric](F.col("embedding"), F.col("other"))).alias("total"))
    want = {r["id"]: r["total"] for r in pairs.collect()}
    got = {r["id"]: r["total"] for r in vector.distance_sums(df, df.where("id < 25"), metric=metric, block=10).collect()}
    assert got == pytest.approx(want)


def test_entry_without_llm(spark, monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setattr(e, "llm_queries", None)
    assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(ORACLE)
    assert e.entry(spark).count() == 10
