import pytest
from conftest import rows
from pyspark.sql import functions as F

from eventlens.operators import joins as jo

L = [(1, "a", 10), (2, "b", 20), (3, None, 30), (4, "a", 40)]
R = [("a", 1.0, 7), (None, 2.0, 8), ("z", 3.0, 9)]


@pytest.fixture(scope="module")
def sides(spark):
    return spark.createDataFrame(L, "id int, k string, v int"), spark.createDataFrame(R, "k string, w double, v int")


def test_null_keys_match_and_names_are_prefixed(sides):
    out = jo.equi_join(*sides, ["k"], "inner", "other")
    assert out.columns == ["id", "k", "v", "w", "other_v"]
    assert rows(out) == [(1, "a", 10, 1.0, 7), (3, None, 30, 2.0, 8), (4, "a", 40, 1.0, 7)]


def test_left_right_full(sides):
    left = rows(jo.equi_join(*sides, ["k"], "left", "o"), "id", "k", "w")
    assert left == [(1, "a", 1.0), (2, "b", None), (3, None, 2.0), (4, "a", 1.0)]
    right = rows(jo.equi_join(*sides, ["k"], "right", "o"), "id", "k", "w")
    assert right == [(1, "a", 1.0), (3, None, 2.0), (4, "a", 1.0), (None, "z", 3.0)]
    full = rows(jo.equi_join(*sides, ["k"], "full", "o"), "id", "k", "w")
    assert full == sorted(left + [(None, "z", 3.0)], key=lambda t: tuple(map(repr, t)))


def test_missing_right_side_leaves_left(sides):
    assert rows(jo.equi_join(sides[0], None, ["k"])) == rows(sides[0])
    assert rows(jo.equi_join(sides[0], sides[1], [])) == rows(sides[0])


def brute(a, b, lo, hi, keyed):
    return sorted(
        (x["event_id"], y["event_id"]) for x in a for y in b
        if (not keyed or x["user_id"] == y["user_id"]) and lo <= (y["ts"] - x["ts"]).total_seconds() <= hi
    )


@pytest.mark.parametrize("direction,lo,hi", [("after", 0, 1), ("before", -1, 0), ("around", -1, 1)])
@pytest.mark.parametrize("keyed", [True, False])
def test_window_join_equals_brute_force(skewed, direction, lo, hi, keyed):
    a = skewed.where("event_type = 'auth_failure'").select("event_id", "ts", "user_id")
    b = skewed.where("event_type = 'payment'").select("event_id", "ts", "user_id")
    span = 36 * 3600 if keyed else 900
    out = jo.window_join(a, b, ["user_id"] if keyed else [], direction, span, "seconds", "inner", right_name="r")
    want = brute(a.collect(), b.collect(), lo * span, hi * span, keyed)
    assert rows(out, "event_id", "r_event_id") == sorted(want, key=lambda t: tuple(map(repr, t))) and want


def test_left_window_join_outside_the_window(spark):
    a = spark.sql("SELECT * FROM VALUES (1, 'u', TIMESTAMP '2024-01-01 00:00:00'), (2, 'w', TIMESTAMP '2024-01-01 00:00:00') AS t(id, k, ts)")
    b = spark.sql("SELECT * FROM VALUES (9, 'u', TIMESTAMP '2024-01-03 00:00:00') AS t(id, k, ts)")
    plain = jo.window_join(a, b, ["k"], "after", 1, "hours", "left", right_name="r")
    assert rows(plain, "id", "r_id") == [(1, None), (2, None)]
    post = jo.window_join(a, b, ["k"], "after", 1, "hours", "left", right_name="r", post_filter=True)
    assert rows(post, "id", "r_id") == [(2, None)]


def test_salted_statistics_equal_the_plain_join(skewed, monkeypatch):
    stats = skewed.where("user_id IS NOT NULL").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    plain = skewed.join(stats, "user_id", "left")
    for limit in (10, 100, 10_000):
        monkeypatch.setattr(jo, "HOT_ROWS", limit)
        salted = jo.attach_stats(skewed, stats, ["user_id"], F.col("event_id"), rows="n")
        assert rows(salted, "event_id", "n", "last") == rows(plain, "event_id", "n", "last")


def test_hot_key_is_spread(skewed, monkeypatch):
    monkeypatch.setattr(jo, "HOT_ROWS", 100)
    stats = skewed.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    skewed.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = jo.attach_stats(skewed, stats, ["user_id"], F.col("event_id"), rows="n")._jdf.queryExecution().toString()
    finally:
        skewed.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(user_id" in plan and "__salt" in plan


def test_time_joins_never_cross(events):
    out = jo.window_join(events, events.select("event_id", "ts"), [], "after", 1, "minutes", right_name="r")
    plan = out._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
