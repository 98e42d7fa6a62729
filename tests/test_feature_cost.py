"""What the features and the forest sort, write and send to Python, and that the cheaper ways give what the plain ones give."""

import glob
import random
import re

import numpy as np
import pandas as pd
from conftest import rows
from eventlens.operators import anomaly as an
from eventlens.operators import features as ft
from eventlens.operators.iforest import flattened, forest_scores, grow, mean_depths
from eventlens.operators.quantiles import column_medians
from eventlens.operators.rolling import rolling_series, row_series
from eventlens.operators.windows import with_previous, with_rolling_count
from eventlens.session import scratch_folder
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rolling_count_needs_no_sort_after_an_ordered_window(events):
    out = with_rolling_count(with_previous(events, "user_id", {"before": "ts"}), "user_id", 300, "n")
    assert len(re.findall(r"Sort \[", plan(out))) == 1


def test_series_walked_in_one_shuffle_equal_the_chunked_ones(spark):
    rng = random.Random(3)
    data = [(f"u{u}", 60 * (3 * i + rng.randrange(3)), float(rng.choice([0, 0, 0, 1, 1, 2, 5])), rng.randrange(1, 4)) for u, k in enumerate([1, 2, 29, 30, 31, 200, 900]) for i in range(k)]
    sparse = spark.createDataFrame(data, "user_id string, bucket long, x double, rows long").repartition(5)
    position = spark.createDataFrame(
        [(*r, i + 1) for u in sorted({r[0] for r in data}) for i, r in enumerate(sorted(r for r in data if r[0] == u))], "user_id string, bucket long, x double, rows long, b long")
    for window, least in ((1440, 30), (50, 7)):
        got = row_series(sparse, "bucket", window, least, 0.2)
        want = rolling_series(position.select("user_id", "b", "x", "rows"), window, least, 0.2).withColumnRenamed("p", "b").drop("x", "rows")
        want = want.join(position, ["user_id", "b"])
        columns = ("user_id", "bucket", "x", "rows", "mad_raw", "mu")
        for g, w in zip(rows(got, *columns), rows(want, *columns), strict=True):
            assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-12


def test_failure_spikes_are_the_same_either_way(events, monkeypatch):
    columns = ("user_id", "bucket", "x", "rows", "mad", F.round("z_fail", 9).alias("z"))
    plain = rows(ft.failure_spikes(ft.known(events, "user_id")).select(*columns))
    monkeypatch.setattr(ft, "SERIES_ROWS", 0)
    assert rows(ft.failure_spikes(ft.known(events, "user_id")).select(*columns)) == plain


def test_features_of_narrow_rows_are_the_same(events):
    columns = ["event_id", *ft.FEATURES]
    assert rows(ft.behaviour_features(events, keep=()), *columns) == rows(ft.behaviour_features(events), *columns)
    kept = ft.behaviour_features(events, keep=("amount",)).columns
    assert "amount" in kept and not {"legs", "home_lat", "ts"} & set(kept)


def test_forest_walk_equals_a_plain_one():
    rng = np.random.default_rng(5)
    trees = [grow(rng.normal(size=(n, 3)).round(1), np.random.default_rng(t), 6) for t, n in enumerate((60, 60, 2))]
    forest = [flattened(pd.DataFrame(sorted((*node, n) for node in tree), columns=["node", "feature", "cut", "left", "right", "depth", "rows"]))
              for tree, n in zip(trees, (60, 60, 2), strict=True)]
    points = rng.normal(size=(300, 3)).round(1)
    points[:4, 0] = [np.nan, np.inf, -np.inf, 0.0]

    def depth(tree, point):
        nodes = {node[0]: node[1:] for node in tree}
        feature, cut, left, right, leaf_depth = nodes[0]
        while feature >= 0:
            feature, cut, left, right, leaf_depth = nodes[left if point[feature] <= cut else right]
        return leaf_depth

    norms = [forest[i][4] for i in range(3)]
    want = [np.mean([depth(tree, p) * norm[-1] / sorted(tree)[-1][5] for tree, norm in zip(trees, norms, strict=True)]) for p in points]
    assert np.allclose(mean_depths(points, forest), want, rtol=1e-12)
    assert mean_depths(points[:0], forest).shape == (0,) and (mean_depths(points, []) == 1).all()


def test_forest_sends_features_only_to_python(spark, events):
    out = forest_scores(events.select("event_id", "meta", F.col("geo_lat").alias("a"), F.map_from_arrays(F.array("event_id"), F.array("ip")).alias("m")).na.drop(subset=["a"]), ["a"], trees=5)
    assert "MapInArrow" not in plan(out) and re.search(r"ArrowEvalPython", plan(out))
    assert out.columns == ["event_id", "meta", "a", "m", "raw"] and out.where("raw > 0 AND meta IS NOT NULL").count() == out.count()


def test_advanced_anomalies_write_narrow_rows(spark, events):
    folder = scratch_folder(spark).removeprefix("file://").removeprefix("file:")
    before = set(glob.glob(f"{folder}/forest-*"))
    narrow = an.advanced_anomalies(events, trees=10, keep=())
    (path,) = set(glob.glob(f"{folder}/forest-*")) - before
    assert "legs" not in spark.read.parquet(path).columns
    columns = ("event_id", "anom_score", "anomaly", "explain")
    assert rows(narrow, *columns) == rows(an.advanced_anomalies(events, trees=10), *columns)


def test_medians_between_two_large_ties_end(spark):
    """No zone around the middle has fewer rows than both ties together."""
    df = spark.createDataFrame([(float(i % 2), float(i % 7 > 3), float(i)) for i in range(400)], "a double, b double, c double")
    assert column_medians(df, ["a", "b", "c"], zone_rows=10) == {"a": 0.5, "b": 0.0, "c": 199.5}
