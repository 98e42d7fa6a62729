import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.operators import quantiles as qu

QS = {"a": 0.0, "b": 0.02, "c": 0.5, "d": 0.975, "e": 1.0}


def expected(values):
    return [float(np.quantile(values, q)) for q in QS.values()]


def check(spark, groups, **kw):
    data = [(k, float(v)) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    for way in (qu.grouped_quantiles, lambda *a: qu.zoned_quantiles(a[0], a[1], F.col(a[2]), a[3])):
        got = {r[0]: list(r)[1:] for r in way(df, ["k"], "v", QS).collect()}
        assert set(got) == set(groups)
        for key, values in groups.items():
            assert got[key] == pytest.approx(expected(values)), key


def test_hot_group_ties_and_single_rows(spark):
    rng = np.random.default_rng(3)
    check(spark, {
        "hot": rng.normal(size=3000), "ties": [0.0] * 500 + [1.0] * 7, "one": [4.5], "two": [1.0, 2.0],
        "skew": np.concatenate([np.zeros(900), rng.exponential(size=50)]),
    })


def test_global_and_weighted(spark):
    values, weights = [5.0, 1.0, 3.0, 0.0], [2, 10, 1, 40]
    df = spark.createDataFrame(list(zip(values, weights, strict=True)), "v double, w bigint")
    want = expected(np.repeat(values, weights))
    for way in (qu._buffered_quantiles, qu.zoned_quantiles):
        assert list(way(df, [], F.col("v"), QS, F.col("w")).first()) == pytest.approx(want)


def test_sketch_only_affects_speed(spark, monkeypatch):
    monkeypatch.setattr(qu, "ACCURACY", 2)
    rng = np.random.default_rng(5)
    values = rng.integers(0, 400, 2000)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert list(qu.zoned_quantiles(df, [], F.col("v"), QS).first()) == pytest.approx(expected(values))


def test_missing_and_nan_are_ignored_and_empty_groups_absent(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("b", None)], "k string, v double")
    got = qu.grouped_quantiles(df, ["k"], "v", {"m": 0.5}).collect()
    assert [(r.k, r.m) for r in got] == [("a", 1.0)]


def test_scalar(spark):
    df = spark.range(11).select(F.col("id").cast("double").alias("v"))
    assert df.where(F.col("v") > qu.quantile_scalar(df, "v", 0.5)).count() == 5
