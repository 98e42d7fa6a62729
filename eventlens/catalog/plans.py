"""Saved step lists, SQL and views."""

from pyspark.sql import functions as F

from eventlens.catalog.common import load_events, r, table, with_ev
from eventlens.plans.steps import run_steps
from eventlens.plans.views import Views, register_sources, select_sql
from eventlens.registry import query

FLAGSHIP = [
    {"type": "source", "config": {"table": "events"}},
    {"type": "filter", "config": {"conditions": [
        {"field": "event_type", "op": "contains", "value": "FAIL"}, {"field": "country", "op": "nin", "value": ["C0"]}]}},
    {"type": "transform", "config": {"columns": [{"name": "hr", "fn": "hour", "args": ["ts"]}, {"name": "double_amount", "op": "*", "args": ["amount", 2]}]}},
    {"type": "join", "config": {"table": "homes", "keys": ["user_id"], "how": "left"}},
    {"type": "aggregate", "config": {"group_by": ["user_id", "hr", "homes_country"], "aggregations": [
        {"func": "count", "field": "*", "alias": "fails"}, {"func": "sum", "field": "double_amount", "alias": "amount"}]}},
    {"type": "rename", "config": {"mapping": {"homes_country": "home", "nothing": "x"}}},
    {"type": "sort", "config": {"keys": [{"field": "fails", "direction": "desc"}, {"field": "user_id"}, {"field": "hr"}]}},
    {"type": "limit", "config": {"count": 20}},
]


@query("steps_e2e", with_ev("""
SELECT e.user_id, hour(ts)::INT AS hr, h.country AS home, count(*) AS fails, round(coalesce(sum(amount * 2), 0), 4) AS amount FROM ev e
LEFT JOIN (SELECT user_id, arg_min(country, us) AS country FROM ev GROUP BY user_id) h ON e.user_id = h.user_id
WHERE e.event_type = 'auth_failure' AND e.country <> 'C0' GROUP BY ALL ORDER BY fails DESC, e.user_id, hr LIMIT 20"""))
def steps_e2e(spark, sf):
    events = load_events(spark, sf)
    homes = events.groupBy("user_id").agg(F.min_by("country", F.struct("ts", "event_id")).alias("country"))
    out = run_steps(FLAGSHIP, {"events": events, "homes": homes})
    return out.withColumn("amount", r("amount", 4))


@query("sql_select", """
SELECT c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus = 'F' AND o_totalprice > 1000 GROUP BY c_mktsegment ORDER BY total DESC LIMIT 3""")
def sql_select(spark, sf):
    register_sources({"orders": table(spark, sf, "orders"), "customer": table(spark, sf, "customer")})
    return select_sql(spark, """
        SELECT c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
        WHERE o_orderstatus = :status AND o_totalprice > :floor GROUP BY c_mktsegment ORDER BY total DESC LIMIT 3""", {"status": "F", "floor": 1000})


@query("view_materialize", with_ev("""
SELECT user_id, payments, round(total, 4) AS total, 'events' AS lineage FROM (
SELECT user_id, count(*) AS payments, coalesce(sum(amount), 0) AS total FROM ev WHERE event_type = 'payment' GROUP BY user_id) WHERE payments >= 10"""))
def view_materialize(spark, sf):
    views = Views(spark, {"events": load_events(spark, sf)})
    views.create("payers", [
        {"type": "source", "config": {"table": "events"}},
        {"type": "filter", "config": {"field": "event_type", "op": "eq", "value": "payment"}},
        {"type": "aggregate", "config": {"group_by": ["user_id"], "aggregations": [
            {"func": "count", "field": "*", "alias": "payments"}, {"func": "sum", "field": "amount", "alias": "total"}]}},
    ], materialized=True)
    out = views.create("big_payers", [
        {"type": "source", "config": {"table": "payers"}}, {"type": "filter", "config": {"field": "payments", "op": "gte", "value": 10}}])
    return out.withColumn("total", r("total", 4)).withColumn("lineage", F.lit(",".join(views.lineage("big_payers"))))
