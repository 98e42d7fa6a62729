"""Rows without a key or a time give one result, whatever way their number takes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from eventlens.operators import joins as jo
from eventlens.operators import quantiles as qu
from eventlens.operators import windows as wi
from eventlens.plans.views import select_sql
from eventlens.functions.predicates import step_condition
from eventlens.functions.rules import rule_condition
from eventlens.operators import steps
from eventlens.session import materialize
from eventlens.sources import formats, store

from conftest import rows


@pytest.fixture(scope="module")
def gaps(events):
    """No user on each 17th row, no time on each 13th, one user on a third of the rows."""
    user = F.when(F.col("event_id") % 17 == 1, F.lit(None)).when(F.col("event_id") % 3 == 0, "hot").otherwise(F.col("user_id"))
    ts = F.when(F.col("event_id") % 13 != 2, F.col("ts"))
    return materialize(events.select("event_id", user.alias("user_id"), ts.alias("ts"), "device_id"), "gaps")


@pytest.mark.parametrize("work", [
    lambda df, h: wi.with_previous(df, "user_id", {"before": "event_id"}, h),
    lambda df, h: wi.with_row_number(df, "user_id", "rn", h),
    lambda df, h: wi.with_rolling_count(df, "user_id", 300, "n", h),
    lambda df, h: wi.with_recent_repeat(wi.with_row_number(df, "user_id", "rn", h), "user_id", "rn", {"new": F.col("device_id")}, 30, h, block=16),
    lambda df, h: wi.with_first_seen(df, "user_id", {"new": F.col("device_id")}, h),
])
def test_heavy_way_equals_plain_way(gaps, work):
    plain, chunked = work(gaps, wi.Heavy(gaps, "user_id", 10**9)), work(gaps, wi.Heavy(gaps, "user_id", 20))
    assert rows(plain) == rows(chunked, *plain.columns) and plain.count() == gaps.count()


@pytest.mark.parametrize("hot", [10**9, 20])
def test_statistics_of_rows_without_key(gaps, monkeypatch, hot):
    monkeypatch.setattr(jo, "HOT_ROWS", hot)
    stats = gaps.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    out = jo.attach_stats(gaps, stats, ["user_id"], F.col("event_id"), rows="n")
    assert out.count() == gaps.count() and out.where("n IS NULL").count() == 0


def test_quantiles_of_rows_without_key(gaps):
    wanted = {"a": 0.5, "b": 0.37}
    both = [
        rows(qu._buffered_quantiles(gaps, ["user_id"], F.col("event_id") / 7, wanted, None)),
        rows(qu.zoned_quantiles(gaps, ["user_id"], F.col("event_id") / 7, wanted)),
    ]
    assert both[0] == both[1] and any(r[0] is None for r in both[0])


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_window_join_kinds(spark, how):
    a = spark.sql("SELECT k, timestamp_seconds(t) AS ts, x FROM VALUES (1, 0, 'a'), (1, 100, 'b'), (2, 0, 'c'), (NULL, 7, 'd') AS v(k, t, x)")
    b = spark.sql("SELECT k, timestamp_seconds(t) AS ts, y FROM VALUES (1, 5, 'p'), (1, 300, 'q'), (3, 0, 'r'), (NULL, 9, 's') AS v(k, t, y)")
    got = {(r.k, r.x, r.y) for r in jo.window_join(a, b, ["k"], "after", 10, "seconds", how).collect()}
    pairs = {(1, "a", "p"), (None, "d", "s")}
    left, right = {(1, "b", None), (2, "c", None)}, {(1, None, "q"), (3, None, "r")}
    assert got == pairs | (left if how in ("left", "full") else set()) | (right if how in ("right", "full") else set())


def test_unknown_window_join(events):
    with pytest.raises(ValueError, match="unknown join"):
        jo.window_join(events, events, ["user_id"], "after", 1, how="outer-ish")


def test_conditions_of_another_type(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'x', 5), (2, '5', 6), (3, NULL, NULL) AS t(id, s, n)")

    def ids(cond):
        return [r.id for r in df.where(cond).orderBy("id").collect()]

    assert ids(step_condition(F.col("s"), "eq", 5)) == [2] and ids(step_condition(F.col("s"), "ne", 5)) == [1, 3]
    assert ids(step_condition(F.col("n"), "eq", "5")) == [1] and ids(step_condition(F.col("n"), "eq", "abc")) == []
    assert ids(step_condition(F.col("s"), "gt", 4)) == [2] and ids(step_condition(F.col("n"), "lt", "six")) == []
    assert ids(step_condition(F.col("s"), "in", [5, "x"])) == [1, 2] and ids(step_condition(F.col("n"), "nin", ["x", 6])) == [1, 3]
    assert ids(rule_condition(df, {"field": "s", "op": "eq", "value": 5})) == [2]
    assert ids(rule_condition(df, {"field": "n", "op": "ne", "value": "abc"})) == [1, 2]
    assert ids(rule_condition(df, {"field": "n", "op": "in", "value": ["abc", 6]})) == [2]


def test_first_and_distinct_without_times(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 3), (1, 1), (2, 2) AS t(k, v)")
    assert rows(steps.distinct_rows(df, ["k"])) == [(1, 1), (2, 2)]
    out = steps.aggregate(df, ["k"], [{"func": "first", "field": "v", "alias": "a"}, {"func": "last", "field": "v", "alias": "b"}])
    assert rows(out) == [(1, 1, 3), (2, 2, 2)]


def test_only_queries_pass(spark, tmp_path):
    assert select_sql(spark, "SELECT ';' AS a, ')' AS b -- end").first().a == ";"
    for text in (f"WITH a AS (SELECT 1 AS x) INSERT OVERWRITE DIRECTORY '{tmp_path}/out' USING parquet SELECT * FROM a", "SELECT 1; DROP TABLE t", "DROP TABLE t"):
        with pytest.raises(ValueError, match="single SELECT"):
            select_sql(spark, text)
    assert not (tmp_path / "out").exists()


def test_delete_by_any_name(spark, events, tmp_path):
    path = str(tmp_path / "store")
    names = F.when(F.col("event_id") % 3 == 0, "load:a b").when(F.col("event_id") % 3 == 1, "2024").otherwise("plain")
    df = events.select("event_id", "ts", names.alias("source"))
    store.append_events(df, path)
    size = {r.source: r.n for r in df.groupBy("source").agg(F.count("*").alias("n")).collect()}
    for name in ("load:a b", "2024"):
        assert store.delete_source(spark, path, name) == size[name] and store.delete_source(spark, path, name) == 0
    left = store.read_events(spark, path)
    assert {r.source for r in left.select("source").distinct().collect()} == {"plain"} and left.count() == size["plain"]
    assert store.delete_all(spark, path) == size["plain"]


def test_batch_of_formats_and_encodings(spark, tmp_path):
    (tmp_path / "with blank.csv").write_text("a,b\n1,Zoë\n", encoding="utf-8")
    (tmp_path / "latin+.csv").write_text("a,b\n2,Zoë\n", encoding="latin-1")
    (tmp_path / "lines.json").write_text('{"a":"3","b":"Zoë"}\n', encoding="utf-8")
    paths = [str(tmp_path / n) for n in ("with blank.csv", "latin+.csv", "lines.json")]
    assert rows(formats.read_batch(spark, paths, "load"), "a", "b", "source") == [
        ("1", "Zoë", "load:with blank"), ("2", "Zoë", "load:latin+"), ("3", "Zoë", "load:lines")]
