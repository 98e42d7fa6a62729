"""Queries over rows without key or time, values of other types, and the remaining kinds of window joins."""

from pyspark.sql import functions as F

from eventlens.catalog.common import load_events, table, with_ev
from eventlens.catalog.filters import cond
from eventlens.catalog.io import _stored
from eventlens.functions.predicates import filter_rows, filter_view, step_condition
from eventlens.functions.rules import rule_tree
from eventlens.operators import quantiles, steps, windows
from eventlens.operators.joins import window_join
from eventlens.registry import query
from eventlens.sources import store

GAPS_SQL = """gaps AS (SELECT event_id, device_id, amount, CASE WHEN event_id % 17 <> 1 THEN user_id END AS user_id,
  CASE WHEN event_id % 13 <> 2 THEN us END AS us FROM ev)"""


def _gaps(spark, sf):
    """Events of which some have no user and some no time."""
    events = load_events(spark, sf)
    return events.withColumn("user_id", F.when(F.col("event_id") % 17 != 1, F.col("user_id"))).withColumn(
        "ts", F.when(F.col("event_id") % 13 != 2, F.col("ts")))


def _heavy(df, limit):
    return windows.Heavy(df, "user_id", limit)


PREVIOUS_SQL = with_ev("""SELECT event_id, lag(event_id) OVER w AS before, row_number() OVER w AS rn FROM gaps
WINDOW w AS (PARTITION BY user_id ORDER BY us NULLS FIRST, event_id)""", GAPS_SQL)


def _previous(spark, sf, limit):
    df = _gaps(spark, sf)
    out = windows.with_previous(df, "user_id", {"before": "event_id"}, _heavy(df, limit))
    return windows.with_row_number(out, "user_id", "rn", _heavy(df, limit)).select("event_id", "before", "rn")


@query("previous_with_gaps", PREVIOUS_SQL)
def previous_with_gaps(spark, sf):
    return _previous(spark, sf, None)


@query("previous_with_gaps_heavy", PREVIOUS_SQL)
def previous_with_gaps_heavy(spark, sf):
    """The same with every user of over ten rows cut into chunks."""
    return _previous(spark, sf, 10)


VELOCITY_SQL = with_ev("""SELECT event_id, CASE WHEN us IS NULL THEN count(*) FILTER (us IS NULL) OVER (PARTITION BY user_id)
  ELSE count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) END AS n FROM gaps""", GAPS_SQL)


@query("velocity_with_gaps", VELOCITY_SQL)
def velocity_with_gaps(spark, sf):
    df = _gaps(spark, sf)
    return windows.with_rolling_count(df, "user_id", 300, "n", _heavy(df, None)).select("event_id", "n")


@query("velocity_with_gaps_heavy", VELOCITY_SQL)
def velocity_with_gaps_heavy(spark, sf):
    df = _gaps(spark, sf)
    return windows.with_rolling_count(df, "user_id", 300, "n", _heavy(df, 10)).select("event_id", "n")


MEDIAN_SQL = with_ev("SELECT user_id, round(quantile_cont(amount, 0.5), 9) AS median FROM gaps WHERE amount IS NOT NULL GROUP BY user_id", GAPS_SQL)


@query("median_with_gaps", MEDIAN_SQL)
def median_with_gaps(spark, sf):
    out = quantiles.grouped_quantiles(_gaps(spark, sf), ["user_id"], "amount", {"median": 0.5})
    return out.select("user_id", F.round("median", 9).alias("median"))


@query("median_with_gaps_zoned", MEDIAN_SQL)
def median_with_gaps_zoned(spark, sf):
    out = quantiles.zoned_quantiles(_gaps(spark, sf), ["user_id"], F.col("amount"), {"median": 0.5})
    return out.select("user_id", F.round("median", 9).alias("median"))


JOIN_SQL = """SELECT a.event_id, b.event_id AS pay_event_id FROM (SELECT * FROM ev WHERE event_type = 'auth_failure') a
{how} JOIN (SELECT * FROM ev WHERE event_type = 'payment') b ON a.user_id = b.user_id AND b.us BETWEEN a.us AND a.us + 43200000000"""


def _window(spark, sf, how):
    events = load_events(spark, sf).select("event_id", "ts", "user_id", "event_type")
    left, right = (events.where(F.col("event_type") == t).drop("event_type") for t in ("auth_failure", "payment"))
    return window_join(left, right, ["user_id"], "after", 12, "hours", how, right_name="pay").select("event_id", "pay_event_id")


@query("join_window_right", with_ev(JOIN_SQL.format(how="RIGHT")))
def join_window_right(spark, sf):
    return _window(spark, sf, "right")


@query("join_window_full", with_ev(JOIN_SQL.format(how="FULL")))
def join_window_full(spark, sf):
    return _window(spark, sf, "full")


@query("filter_mixed_types", with_ev("""
SELECT event_id FROM ev WHERE amount > 20 AND event_id NOT IN (7, 8) AND coalesce(TRY_CAST(device_id AS DOUBLE) = 5, false) = false"""))
def filter_mixed_types(spark, sf):
    conds = [cond("amount", "gt", "20"), cond("event_id", "nin", ["7", 8, "x"]), cond("device_id", "ne", 5)]
    return filter_rows(load_events(spark, sf), conds).select("event_id")


@query("rules_mixed_types", with_ev("""
SELECT event_id, coalesce(event_id = 12, false) AS same, coalesce(TRY_CAST(device_id AS DOUBLE) = 3, false) AS device,
  amount IS NOT NULL AS other, event_id IN (3, 4) AS listed FROM ev"""))
def rules_mixed_types(spark, sf):
    events = load_events(spark, sf)
    rules = {"same": ("event_id", "eq", "12"), "device": ("device_id", "eq", 3), "other": ("amount", "ne", "abc"), "listed": ("event_id", "in", ["3", 4, "no"])}
    return events.select("event_id", *[rule_tree(events, cond(*c)).alias(name) for name, c in rules.items()])


# Conditions of every type mix: name -> (field, operator, value, SQL).
MIXED = {
    "text_true": ("event_type", "eq", True, "false"), "text_not_true": ("event_type", "ne", True, "true"), "number_true": ("event_id", "eq", True, "event_id = 1"),
    "number_not_false": ("event_id", "ne", False, "event_id <> 0"), "time_true": ("ts", "eq", True, "false"),
    "time_after_text": ("ts", "gt", "2024-01-03 06:00:00", "ts > TIMESTAMP '2024-01-03 06:00:00'"), "time_after_word": ("ts", "gt", "soon", "false"),
    "time_not_word": ("ts", "ne", "soon", "true"), "time_number": ("ts", "gte", 5, "false"), "text_number": ("device_id", "lt", 5, "coalesce(TRY_CAST(device_id AS DOUBLE) < 5, false)"),
    "between_text": ("event_id", "between", ["3", "7"], "event_id BETWEEN 3 AND 7"), "between_words": ("event_id", "between", ["a", "z"], "false"),
    "text_between": ("device_id", "between", [2, 4.5], "coalesce(TRY_CAST(device_id AS DOUBLE) BETWEEN 2 AND 4.5, false)"),
    "text_between_text": ("country", "between", ["C1", "C3"], "coalesce(country BETWEEN 'C1' AND 'C3', false)"),
    "time_between": ("ts", "between", ["2024-01-03", "2024-01-04 12:00:00"], "ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-04 12:00:00'"),
    "listed": ("event_id", "in", ["3", 4, True, "x"], "event_id IN (1, 3, 4)"), "text_listed": ("device_id", "in", [3, "4", True], "coalesce(TRY_CAST(device_id AS DOUBLE) = 3 OR device_id = '4', false)"),
}


@query("conditions_mixed", with_ev("SELECT event_id, " + ", ".join(f"{sql} AS {name}" for name, (*_, sql) in MIXED.items()) + " FROM ev"))
def conditions_mixed(spark, sf):
    events = load_events(spark, sf)
    return events.select("event_id", *[step_condition(F.col(c), op, v).alias(name) for name, (c, op, v, _) in MIXED.items()])


@query("where_viz_mixed", with_ev("""
SELECT event_id FROM ev WHERE coalesce(amount >= 10, false) AND event_id BETWEEN 5 AND 5000 AND coalesce(TRY_CAST(device_id AS DOUBLE) <> 3, true)"""))
def where_viz_mixed(spark, sf):
    """Unknown operators and fields don't filter; a condition without an operator tests equality."""
    conds = [cond("amount", "gte", "10"), cond("event_id", "between", ["5", 5000]), cond("device_id", "ne", 3), cond("amount", "like", "x"), cond("none", "eq", 1)]
    return filter_view(load_events(spark, sf), conds).select("event_id")


@query("delete_all_counts", with_ev("SELECT count(*) AS removed, 0::BIGINT AS again FROM ev"))
def delete_all_counts(spark, sf):
    path = _stored(spark, sf)
    removed = store.delete_all(spark, path)
    left = spark.read.schema("event_id long").parquet(path)
    return left.agg(F.lit(removed).cast("bigint").alias("removed"), F.count("*").alias("again"))


@query("first_last_of_orders", """SELECT o_custkey, min(o_orderkey) AS first_order, max(o_orderkey) AS last_order FROM orders GROUP BY o_custkey""")
def first_last_of_orders(spark, sf):
    """A table without the event order: rows go by all columns."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return steps.aggregate(orders, ["o_custkey"], [
        {"func": "first", "field": "o_orderkey", "alias": "first_order"}, {"func": "last", "field": "o_orderkey", "alias": "last_order"}])


@query("distinct_of_orders", "SELECT min(o_orderkey) AS o_orderkey, o_custkey FROM orders GROUP BY o_custkey")
def distinct_of_orders(spark, sf):
    return steps.distinct_rows(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"])
