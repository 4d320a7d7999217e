"""Cases in which rows used to be lost: invalid predictions, vectors without a distance, crowded strata, clashing keys."""

import math

import pytest
from pyspark.sql import functions as F

from cadastre.operators import joins, metrics, neighbors
from cadastre.operators.knn import Limits, knn_join
from cadastre.operators.neighbors import SearchSpace
from cadastre.plans.recipes import base


def test_bad_predictions_count_except_in_rmsle(spark):
    rows = [(100.0, 90.0), (50.0, -5.0), (10.0, 12.0), (7.0, None), (7.0, math.nan), (7.0, math.inf)]
    got = metrics.evaluate(spark.createDataFrame(rows, "truth double, prediction double"), "truth", "prediction").first()
    assert (got["n_rows"], got["n_dropped"]) == (3, 3)
    assert got["rmse"] == pytest.approx(math.sqrt((100 + 55**2 + 4) / 3))
    logs = [math.log1p(100) - math.log1p(90), math.log1p(10) - math.log1p(12)]
    assert got["rmsle"] == pytest.approx(math.sqrt(sum(x * x for x in logs) / 2))
    floor = spark.createDataFrame([(1.0, -3.0), (1.0, 1.0)], "t double, p double").agg(metrics.rmsle("t", "p", pred_floor=-1.0)).first()[0]
    assert floor == math.inf


def test_vectors_without_a_distance_leave_the_others_alone(spark):
    rows = [(i, [float(i), 0.0]) for i in range(50)] + [(50, [None, 1.0]), (51, None), (52, [math.nan, 1.0]), (53, [math.inf, 0.0])]
    df = spark.createDataFrame(rows, "row_id long, features array<double>")
    edges = knn_join(df, df, 3).collect()
    assert len(edges) == 150 and {r["query_id"] for r in edges} == set(range(50))


def test_a_column_without_training_values_leaves_the_space(spark):
    df = spark.createDataFrame([(i, float(i % 7), None if i < 20 else 1.0, "train" if i < 20 else "test") for i in range(30)], "row_id long, x double, empty double, split string")
    assert neighbors.neighbor_edges(df, 2, SearchSpace(["x", "empty"])).count() == 60


def test_few_candidates_and_many_queries_in_one_stratum(spark):
    limits = Limits(cell_rows=8, max_pivots=16, pivot_from=2, block_rows=32, query_rows=16)
    rows = [(i, [float(i % 13), float(i % 5)], "big" if i < 200 else "small", i < 203) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, features array<double>, s string, candidate boolean")
    got = knn_join(df, df.filter("candidate"), 4, by="s", limits=limits)
    plain = knn_join(df, df.filter("candidate"), 4, by="s")
    order = ["query_id", "rank", "neighbor_id", "distance"]
    assert got.select(order).exceptAll(plain.select(order)).isEmpty() and plain.select(order).exceptAll(got.select(order)).isEmpty()


def test_rows_that_share_a_hash_keep_apart(spark):
    df = spark.range(300).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"))
    keyed = base.hash_keyed(df, bits=5)
    assert keyed.count() == 300 and keyed.select("row_id").distinct().count() == 300
    again = base.hash_keyed(df.repartition(5), bits=5)
    assert again.exceptAll(keyed).isEmpty()


def test_long_texts_count_when_a_table_is_to_be_broadcast(spark, monkeypatch):
    table = spark.range(100).select("id", F.repeat(F.lit("x"), 5_000).alias("text"))
    assert joins.fits_broadcast(table)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 200_000)
    assert not joins.fits_broadcast(table)
