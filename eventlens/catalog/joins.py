"""Join queries."""

from pyspark.sql import functions as F

from eventlens.catalog.common import load_events, r, scored_events, table, with_ev, with_scored
from eventlens.operators import viz
from eventlens.operators.joins import equi_join, window_join
from eventlens.plans.views import Views
from eventlens.registry import query

PROFILE = "prof AS (SELECT user_id, country, count(*) AS n, min(event_id) AS event_id FROM ev WHERE source = 'auth_events' AND event_id % 3 = 0 GROUP BY ALL)"


def _tickets_and_profile(spark, sf):
    events = load_events(spark, sf)
    left = events.where("source = 'ticket_events'").select("event_id", "user_id", "country", "amount")
    right = events.where("source = 'auth_events' AND event_id % 3 = 0").groupBy("user_id", "country").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("event_id"))
    return left, right


@query("join_inner", with_ev("""
SELECT e.event_id, e.user_id, e.country, e.amount, p.n, p.event_id AS prof_event_id FROM ev e
JOIN prof p ON e.user_id = p.user_id AND e.country = p.country WHERE e.source = 'ticket_events'""", PROFILE))
def join_inner(spark, sf):
    left, right = _tickets_and_profile(spark, sf)
    return equi_join(left, right, ["user_id", "country"], "inner", "prof")


@query("join_left", "SELECT c_custkey, c_mktsegment, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def join_left(spark, sf):
    left, right = table(spark, sf, "customer"), table(spark, sf, "orders")
    out = equi_join(equi_join(left, None, []), right, [("c_custkey", "o_custkey")], "left", "orders")
    return out.select("c_custkey", "c_mktsegment", "o_orderkey", "o_totalprice")


@query("join_right", "SELECT o_orderkey, p_partkey, p_brand FROM (SELECT * FROM orders WHERE o_orderstatus = 'F') RIGHT JOIN part ON o_orderkey = p_partkey")
def join_right(spark, sf):
    left, right = table(spark, sf, "orders").where("o_orderstatus = 'F'"), table(spark, sf, "part")
    keyed = right.withColumn("key", F.col("p_partkey"))
    return equi_join(left, keyed, [("o_orderkey", "key")], "right", "part").select("o_orderkey", "p_partkey", "p_brand")


@query("join_full", with_ev("""
SELECT coalesce(a.device_id, b.device_id) AS device_id, a.fails, b.pays FROM
(SELECT device_id, count(*) AS fails FROM ev WHERE event_type = 'auth_failure' GROUP BY device_id) a FULL JOIN
(SELECT device_id, count(*) AS pays FROM ev WHERE event_type = 'payment' GROUP BY device_id) b ON a.device_id IS NOT DISTINCT FROM b.device_id"""))
def join_full(spark, sf):
    events = load_events(spark, sf)
    fails = events.where("event_type = 'auth_failure'").groupBy("device_id").agg(F.count(F.lit(1)).alias("fails"))
    pays = events.where("event_type = 'payment'").groupBy("device_id").agg(F.count(F.lit(1)).alias("pays"))
    return equi_join(fails, pays, ["device_id"], "full", "pays")


WINDOW_SQL = """SELECT a.event_id, b.event_id AS pay_event_id FROM (SELECT * FROM ev WHERE event_type = 'auth_failure') a
{how} JOIN (SELECT * FROM ev WHERE event_type = 'payment') b ON a.user_id = b.user_id AND b.us BETWEEN a.us + {lo} AND a.us + {hi}"""


def _window(spark, sf, direction, value, unit, how):
    events = load_events(spark, sf).select("event_id", "ts", "user_id", "event_type")
    left = events.where("event_type = 'auth_failure'").drop("event_type")
    right = events.where("event_type = 'payment'").drop("event_type")
    keys = ["user_id"] if how else []
    out = window_join(left, right, keys, direction, value, unit, how or "inner", right_name="pay")
    return out.select("event_id", "pay_event_id")


@query("join_window_after", with_ev(WINDOW_SQL.format(how="LEFT", lo=0, hi=12 * 3600 * 10**6)))
def join_window_after(spark, sf):
    return _window(spark, sf, "after", 12, "hours", "left")


@query("join_window_before", with_ev(WINDOW_SQL.format(how="INNER", lo=-2 * 86400 * 10**6, hi=0)))
def join_window_before(spark, sf):
    return _window(spark, sf, "before", 2, "days", "inner")


@query("join_window_around", with_ev(WINDOW_SQL.format(how="LEFT", lo=-600 * 60 * 10**6, hi=600 * 60 * 10**6)))
def join_window_around(spark, sf):
    return _window(spark, sf, "around", 600, "minutes", "left")


@query("join_time_only", with_ev("""
SELECT a.event_id, b.event_id AS pay_event_id FROM (SELECT * FROM ev WHERE event_type = 'auth_failure') a
JOIN (SELECT * FROM ev WHERE event_type = 'payment') b ON b.us BETWEEN a.us AND a.us + 60000000"""))
def join_time_only(spark, sf):
    return _window(spark, sf, "after", 1, "minutes", None)


@query("join_view", with_ev("""
SELECT e.event_id, e.user_id, v.fails FROM (SELECT * FROM ev WHERE event_type = 'payment') e
LEFT JOIN (SELECT user_id, count(*) AS fails FROM ev WHERE event_type = 'auth_failure' AND country <> 'C1' GROUP BY user_id) v USING (user_id)"""))
def join_view(spark, sf):
    views = Views(spark, {"events": load_events(spark, sf)})
    views.create("user_failures", [
        {"type": "source", "config": {"table": "events"}},
        {"type": "filter", "config": {"conditions": [
            {"field": "event_type", "op": "eq", "value": "auth_failure"}, {"field": "country", "op": "ne", "value": "C1"}]}},
        {"type": "aggregate", "config": {"group_by": ["user_id"], "aggregations": [{"func": "count", "field": "*", "alias": "fails"}]}},
    ])
    out = views.create("joined", [
        {"type": "source", "config": {"table": "events"}},
        {"type": "filter", "config": {"field": "event_type", "op": "eq", "value": "payment"}},
        {"type": "join", "config": {"table": "user_failures", "keys": ["user_id"], "how": "left"}},
    ])
    return out.select("event_id", "user_id", "fails")


@query("route_geo_join", with_scored("""
SELECT r.origin, r.dest, r.events, round(r.avg_score, 6) AS avg_score, a.lat AS o_lat, a.lon AS o_lon, b.lat AS d_lat, b.lon AS d_lon
FROM (SELECT origin, dest, count(*) AS events, avg(anom_score) AS avg_score FROM scored GROUP BY ALL) r
JOIN places a ON r.origin = a.code JOIN places b ON r.dest = b.code""",
    "places AS (SELECT 'N' || n_nationkey AS code, CAST(n_nationkey * 7 % 120 - 60 AS DOUBLE) AS lat, CAST(n_nationkey * 13 % 300 - 150 AS DOUBLE) AS lon FROM nation WHERE n_regionkey <> 4)"))
def route_geo_join(spark, sf):
    key = F.col("n_nationkey")
    places = table(spark, sf, "nation").where("n_regionkey <> 4").select(
        F.concat(F.lit("N"), key.cast("string")).alias("code"),
        (key * 7 % 120 - 60).cast("double").alias("lat"), (key * 13 % 300 - 150).cast("double").alias("lon"))
    routes = viz.route_aggregate(scored_events(spark, sf))
    out = viz.route_positions(routes, places)
    return out.select("origin", "dest", "events", r("avg_score").alias("avg_score"), "o_lat", "o_lon", "d_lat", "d_lon")
