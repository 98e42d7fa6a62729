"""Run-length rolling medians and exponential means against a plain loop over every position."""

import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventlens.operators import features as ft
from eventlens.operators import rolling
from eventlens.operators.rolling import runs


def plain(values, window, least, alpha):
    """(position, x, mean, median) of a gap-filled series given as {position: x}."""
    lo, hi = min(values), max(values)
    dense = [values.get(p, 0.0) for p in range(lo, hi + 1)]
    center, mean, out = statistics.median(dense), None, []
    for i, x in enumerate(dense):
        mean = x if mean is None else (1 - alpha) * mean + alpha * x
        tail = [abs(v - center) for v in dense[max(0, i - window + 1) : i + 1]]
        out.append((lo + i, x, mean, statistics.median(tail) if len(tail) >= least else None))
    return center, out


def spelt(found, alpha):
    return [(p + i, (x or 0.0) if i == 0 else 0.0, mean * (1 - alpha) ** i, median) for p, x, _, mean, median, n in found for i in range(n)]


SERIES = st.dictionaries(st.integers(-20, 120), st.sampled_from([0.0, 1.0, 1.0, 2.0, 5.0, -3.0]), min_size=1, max_size=60)


@settings(max_examples=300, deadline=None)
@given(SERIES, st.integers(3, 40), st.integers(1, 5), st.sampled_from([0.2, 0.5]))
def test_runs_equal_every_position(values, window, least, alpha):
    center, want = plain(values, window, least, alpha)
    rows = [(p, x, 1) for p, x in sorted(values.items())]
    found = list(runs(rows, center, rows[0][0], rows[0][0], rows[-1][0] + 1, window, least, alpha))
    got = spelt(found, alpha)
    assert [(p, x, m) for p, x, _, m in got] == [(p, x, m) for p, x, _, m in want]
    assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, want, strict=True))
    assert len(found) <= 3 * len(rows) + 2


@settings(max_examples=100, deadline=None)
@given(SERIES, st.integers(3, 20), st.integers(20, 60))
def test_a_chunk_needs_only_its_context(values, window, cut):
    center, want = plain(values, window, 2, 0.9)
    rows = [(p, x, 1) for p, x in sorted(values.items())]
    lo, hi = rows[0][0], rows[-1][0]
    if not lo < cut <= hi:
        return
    context = max(window - 1, rolling.ewma_reach(0.9))
    parts = [list(runs([r for r in rows if r[0] < cut], center, lo, lo, cut, window, 2, 0.9)),
             list(runs([r for r in rows if r[0] >= cut - context], center, lo, cut, hi + 1, window, 2, 0.9))]
    got = [row for part in parts for row in spelt(part, 0.9)]
    assert [(p, x, m) for p, x, _, m in got] == [(p, x, m) for p, x, _, m in want]
    assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("factor", [1, 32])
def test_users_split_over_chunks(spark, monkeypatch, factor):
    """Long gaps, a user in many chunks, one bucket only, NULL user; NaN and NULL add nothing."""
    monkeypatch.setattr(rolling, "CHUNK_FACTOR", factor)
    series = {"a": {i * 7 % 900: float(i % 4) for i in range(400)}, "b": {0: 1.0, 5000: 2.0, 5003: 4.0}, "c": {77: 3.0}, None: {0: 1.0, 1: 2.0, 9: 1.0}}
    rows = [(u, p * 3600, x) for u, s in series.items() for p, x in s.items()] + [("a", 0, float("nan")), ("a", 0, None), ("b", None, 9.0)]
    df = spark.createDataFrame(rows, "user_id string, at long, v double").withColumn("ts", F.timestamp_seconds("at"))
    dense = ft.dense_robust_z(df, F.col("v"), "1h")
    got = {(r.user_id, r.bucket // 3600): r for r in dense.collect()}
    want = {(u, p): (x, mean, median) for u, s in series.items() for p, x, mean, median in plain(s, 24, 3, 0.2)[1]}
    assert got.keys() == want.keys()
    for key, (x, mean, median) in want.items():
        assert got[key].x == x and abs(got[key].mu - mean) < 1e-9 and got[key].mad_raw == median


def test_few_points_and_no_wide_frame(spark, events):
    base = ft.known(events, "user_id")
    series = ft.robust_runs(base, F.lit(1), "1m")
    with_events = series.where("rows IS NOT NULL").count()
    assert series.count() <= 3 * with_events
    sparse = series.where("rows IS NOT NULL").select("user_id", F.col("p").alias("b"), "x", "rows")
    plan = rolling.rolling_series(sparse, 1440, 30, 0.2)._jdf.queryExecution().executedPlan().toString()
    assert "Frame, -1439" not in plan
