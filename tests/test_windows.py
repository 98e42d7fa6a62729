"""Chunked computations of heavy keys equal the plain windows."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from eventlens.operators import features as ft
from eventlens.operators.windows import (
    Heavy,
    with_first_seen,
    with_previous,
    with_recent_repeat,
    with_rolling_count,
    with_row_number,
)


@pytest.fixture(scope="module")
def ways(skewed):
    """All keys plain, and nearly all keys chunked."""
    plain, chunked = Heavy(skewed, "user_id"), Heavy(skewed, "user_id", limit=20)
    assert plain.values is None and chunked.values.count() > 1
    return plain, chunked


def same(ways, make, *columns):
    a, b = (rows(make(h), "event_id", *columns) for h in ways)
    assert a == b and len(a) > 0


def test_previous(ways, skewed):
    same(ways, lambda h: with_previous(skewed, "user_id", {"p": "event_id", "lat": "geo_lat"}, h), "p", "lat")


def test_row_number(ways, skewed):
    same(ways, lambda h: with_row_number(skewed, "user_id", "rn", h), "rn")


@pytest.mark.parametrize("seconds", [300, 7200, 86400])
def test_rolling_count(ways, skewed, seconds):
    same(ways, lambda h: with_rolling_count(skewed, "user_id", seconds, "n", h), "n")


def test_first_seen(ways, skewed):
    same(ways, lambda h: with_first_seen(skewed, "user_id", {"f": F.coalesce("device_id", F.lit("?"))}, h), "f")


@pytest.mark.parametrize("window,block", [(3, 4), (30, 64)])
def test_recent_repeat(ways, skewed, window, block):
    numbered = with_row_number(skewed, "user_id", "rn")
    same(ways, lambda h: with_recent_repeat(numbered, "user_id", "rn", {"new": F.col("ip")}, window, h, block), "new")


def test_rolling_count_treats_equal_times_together(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, 'u', TIMESTAMP '2024-01-01 00:00:00'), (2, 'u', TIMESTAMP '2024-01-01 00:00:00'),
        (3, 'u', TIMESTAMP '2024-01-01 00:05:00'), (4, 'u', TIMESTAMP '2024-01-01 00:04:59.999999') AS t(event_id, user_id, ts)""")
    out = dict(rows(with_rolling_count(df, "user_id", 300, "n"), "event_id", "n"))
    # (t - 5 min, t]: an event exactly five minutes old is out.
    assert out == {1: 2, 2: 2, 4: 3, 3: 2}


@pytest.mark.parametrize("make,columns", [
    (ft.add_home, ["home_lat", "home_lon"]),
    (ft.add_hour_rarity, ["hour_prob"]),
    (lambda df, h: ft.add_velocity_z(ft.add_event_velocity(df, h), h), ["event_velocity_z"]),
])
def test_user_statistics_do_not_depend_on_the_way(ways, skewed, make, columns):
    known = ft.known(skewed, "user_id")
    a, b = (
        rows(make(known, Heavy(known, "user_id", limit)).select("event_id", *[F.round(c, 9).alias(c) for c in columns]))
        for limit in (None, 20)
    )
    assert a == b


def test_zero_time_gives_no_speed(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, 'u', TIMESTAMP '2024-01-01 00:00:00', 0D, 0D), (2, 'u', TIMESTAMP '2024-01-01 00:00:00', 1D, 1D),
        (3, 'u', TIMESTAMP '2024-01-01 01:00:00', 1D, NULL) AS t(event_id, user_id, ts, geo_lat, geo_lon)""")
    out = {r.event_id: r for r in ft.add_travel(ft.add_previous_position(df)).collect()}
    assert out[1].dist_prev_km is None
    assert out[2].dist_prev_km == pytest.approx(157.25, abs=0.1) and out[2].speed_kmh is None
    assert out[3].dist_prev_km is None and out[3].speed_kmh is None
