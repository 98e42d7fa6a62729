"""Grid clustering against a plain quadratic implementation."""

from collections import deque

import numpy as np
import pandas as pd
import pytest

from eventlens.operators import clustering as cl


def brute(points, eps, min_samples):
    scaled = (points - points.mean(axis=0)) / np.where(points.std(axis=0) == 0, 1, points.std(axis=0))
    near = ((scaled[:, None, :] - scaled[None, :, :]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= min_samples
    labels, number = np.full(len(points), -1), 0
    for start in range(len(points)):
        if labels[start] != -1 or not core[start]:
            continue
        labels[start], queue = number, deque([start])
        while queue:
            at = queue.popleft()
            if not core[at]:
                continue
            for other in np.flatnonzero(near[at] & (labels == -1)):
                labels[other] = number
                queue.append(other)
        number += 1
    return labels


def frame(spark, points):
    pdf = pd.DataFrame(points, columns=["geo_lat", "geo_lon", "minutes"])
    pdf["event_id"] = np.arange(len(pdf))
    pdf["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.round(pdf.minutes * 60e6).astype("int64"), unit="us")
    return spark.createDataFrame(pdf.drop(columns="minutes"))


def labels_of(spark, points, eps, min_samples):
    got = cl.geo_dbscan(frame(spark, points), eps, min_samples).select("event_id", "cluster").collect()
    return np.array([r.cluster for r in sorted(got, key=lambda r: r.event_id)])


def blobs(seed, sizes, spread, rest):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(loc=(10 * i, -7 * i, 300 * i), scale=(spread, spread, 30 * spread), size=(n, 3)) for i, n in enumerate(sizes)]
    parts.append(rng.uniform((-10, -20, -100), (30, 20, 900), size=(rest, 3)))
    points = np.concatenate(parts)
    order = np.argsort(points[:, 2], kind="stable")
    points = points[order]
    points[:, 2] = np.round((points[:, 2] - points[:, 2].min()) * 60e6) / 60e6
    return points


@pytest.mark.parametrize("seed,sizes,spread,rest,eps,minimum", [
    (1, (120, 80, 60), 1.0, 40, 0.25, 8), (2, (200,), 3.0, 60, 0.35, 15), (3, (60, 60), 2.5, 120, 0.5, 5), (4, (5,), 1.0, 3, 0.7, 15),
])
def test_equals_brute_force(spark, seed, sizes, spread, rest, eps, minimum):
    points = blobs(seed, sizes, spread, rest)
    assert labels_of(spark, points, eps, minimum).tolist() == brute(points, eps, minimum).tolist()


def test_split_boxes_give_the_same(spark, monkeypatch):
    """Force the halving of boxes down to very few points each."""
    monkeypatch.setattr(cl, "SMALL", 4)
    points = blobs(7, (90, 70), 2.0, 60)
    assert labels_of(spark, points, 0.4, 6).tolist() == brute(points, 0.4, 6).tolist()


def test_missing_place_is_noise(spark, events):
    out = cl.geo_dbscan(events)
    assert out.count() == events.count()
    assert out.where("geo_lat IS NULL AND cluster <> -1").count() == 0


def test_two_cities_summary(spark):
    rng = np.random.default_rng(42)
    a = np.column_stack([rng.normal(48.85, 0.01, 30), rng.normal(2.35, 0.01, 30), np.arange(30)])
    b = np.column_stack([rng.normal(52.52, 0.01, 30), rng.normal(13.40, 0.01, 30), 30 + np.arange(30)])
    out = cl.cluster_summary(cl.geo_dbscan(frame(spark, np.concatenate([a, b])), 0.5, 5)).orderBy("cluster").collect()
    assert [r.cluster for r in out] == [0, 1] and out[0].size + out[1].size + out[0].noise_count == 60
    assert out[0].centroid_lat == pytest.approx(48.85, abs=0.05)
