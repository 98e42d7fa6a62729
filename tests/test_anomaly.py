import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from eventlens.operators import anomaly as an
from eventlens.operators import features as ft
from eventlens.operators.viz import score_by_trailing_z
from eventlens.operators.iforest import expected_path, forest_scores, sample_rows


@pytest.mark.parametrize("value", [F.lit, lambda _: F.col("amount") - 40, lambda _: F.when(F.col("event_id") % 5 == 0, 1).otherwise(0)])
@pytest.mark.parametrize("bucket", ["1h", "6h", "1d"])
def test_sparse_scores_equal_the_dense_series(skewed, value, bucket):
    df = ft.known(skewed, "user_id")
    sparse = an.sparse_robust_z(df, value(1), bucket)
    dense = ft.dense_robust_z(df, value(1), bucket)
    columns = [F.round(c, 8).alias(c) for c in ("x", "mu", "mad", "z", "score")]
    both = sparse.select("user_id", "bucket").join(dense, ["user_id", "bucket"])
    assert rows(sparse.select("user_id", "bucket", *columns)) == rows(both.select("user_id", "bucket", *columns))


def test_short_series_has_no_spread_and_no_anomaly(spark):
    df = spark.sql("SELECT 1L AS event_id, 'u' AS user_id, TIMESTAMP '2024-01-01 00:00:00' AS ts, 'login' AS event_type")
    row = an.mark_anomalies(df, "count", 3.0, "1h").first()
    assert row.anomaly is False and row.anom_score == 0.0 and row.reasons == [] and row.explain == ""


def test_burst_is_marked(spark):
    quiet = spark.range(24 * 6).select("id", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 3600).alias("ts"))
    burst = spark.range(1000, 1040).select("id", F.timestamp_seconds(F.lit(1_704_067_200 + 100 * 3600) + F.col("id") - 1000).alias("ts"))
    df = quiet.unionByName(burst).select(F.col("id").alias("event_id"), "ts", F.lit("u").alias("user_id"), F.lit("login").alias("event_type"))
    out = an.mark_anomalies(df, "count", 3.0, "1h").where("anomaly")
    # The burst, the regular event of its hour, and nothing before it.
    assert out.where("event_id >= 1000").count() == 40
    assert out.agg(F.min("event_id")).first()[0] == 100
    first = out.where("event_id >= 1000").first()
    assert first.reasons[0].code == "ROBUST_Z" and first.explain.startswith("Robust z-score")


def test_forest_ranks_planted_outliers_first(spark):
    rng = np.random.default_rng(1)
    points = [(i, *map(float, rng.normal(size=3))) for i in range(2000)]
    points += [(9000 + i, 9.0 + i, -9.0, 9.0) for i in range(5)]
    df = spark.createDataFrame(points, "event_id bigint, a double, b double, c double").repartition(6)
    scores = forest_scores(df, ["a", "b", "c"], trees=60, sample=128)
    top = {r.event_id for r in scores.orderBy(F.desc("raw")).limit(5).collect()}
    assert top == {9000, 9001, 9002, 9003, 9004}
    again = forest_scores(df.repartition(3), ["a", "b", "c"], trees=60, sample=128)
    assert rows(scores) == rows(again)


def test_trees_draw_alike_at_every_size(spark):
    df = spark.range(4000).select(F.col("id").alias("event_id"), F.rand(3).alias("a"))
    drawn = sample_rows(df, 20, 32, 7)
    per_tree = [n for _, n in drawn.groupBy("tree").count().collect()]
    assert len(per_tree) == 20 and 20 < min(per_tree) and max(per_tree) < 90
    assert drawn.groupBy("event_id").count().where("count > 1").count() > 0


def test_sample_above_the_rows_changes_nothing(spark):
    df = spark.range(20).select(F.col("id").alias("event_id"), F.rand(3).alias("a"))
    scores = forest_scores(df, ["a"], trees=30, sample=256)
    assert rows(scores) == rows(forest_scores(df, ["a"], trees=30, sample=20))
    assert 0.4 < scores.agg(F.avg("raw")).first()[0] < 0.6
    assert [r.raw for r in forest_scores(df.limit(1), ["a"], trees=3).collect()] == [0.5]


def test_expected_path():
    assert expected_path(1) == 0 and expected_path(2) == 1
    assert expected_path(256) == pytest.approx(10.244, abs=1e-3)


def test_fewer_than_ten_rows_score_zero(events):
    out = an.advanced_anomalies(events.orderBy("event_id").limit(6), trees=10).collect()
    assert len(out) == 6 and all(r.anom_score == 0.0 and r.anomaly is False for r in out)


def test_advanced_run_flags_about_the_contamination(events):
    out = an.advanced_anomalies(events, contamination=0.05, trees=40)
    stats = an.run_stats(out.select("anomaly", "anom_score")).first()
    assert stats.row_count == 1000 and 30 <= stats.anomalies <= 50
    assert stats.score_min == 0.0 and stats.score_max == 1.0
    assert out.where("anomaly AND reasons[0].code <> 'IF_OUTLIER'").count() == 0


def test_trailing_score_keeps_events_without_user(skewed):
    out = score_by_trailing_z(skewed, "1d")
    assert out.count() == skewed.count()
    lost = out.where("user_id IS NULL")
    assert lost.count() > 0 and rows(lost.select("zscore", "anom_score", "anomaly").distinct()) == [(None, 0.5, False)]
