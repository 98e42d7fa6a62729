"""Aggregation, profiling, ordering and set queries."""

from pyspark.sql import functions as F

from eventlens.catalog.common import load_events, r, table, with_ev
from eventlens.operators import profile, steps
from eventlens.operators.quantiles import grouped_quantiles
from eventlens.registry import query


def agg(func, field="*", alias=None):
    return {"func": func, "field": field, "alias": alias}


@query("agg_count", with_ev("SELECT device_id, count(*) AS n FROM ev WHERE device_id IS NOT NULL GROUP BY device_id"))
def agg_count(spark, sf):
    return steps.aggregate(load_events(spark, sf), ["device_id"], [agg("count", "*", "n")])


@query("agg_count_field", with_ev("SELECT event_type, count(amount) AS n, count(device_id) AS d FROM ev GROUP BY event_type"))
def agg_count_field(spark, sf):
    return steps.aggregate(load_events(spark, sf), ["event_type"], [agg("count", "amount", "n"), agg("count", "device_id", "d")])


@query("agg_sum", with_ev("""
SELECT card_hash, round(coalesce(sum(CASE WHEN amount > 100 THEN amount END), 0), 4) AS big FROM ev WHERE card_hash IS NOT NULL GROUP BY card_hash"""))
def agg_sum(spark, sf):
    df = load_events(spark, sf).withColumn("large", F.when(F.col("amount") > 100, F.col("amount")))
    return steps.aggregate(df, ["card_hash"], [agg("sum", "large", "big")]).select("card_hash", r("big", 4).alias("big"))


@query("agg_avg_min_max", """
SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS mean_price, min(l_quantity) AS lo, max(l_discount) AS hi
FROM lineitem GROUP BY ALL""")
def agg_avg_min_max(spark, sf):
    out = steps.aggregate(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], [
        agg("avg", "l_extendedprice", "mean_price"), agg("min", "l_quantity", "lo"), agg("max", "l_discount", "hi")])
    return out.withColumn("mean_price", r("mean_price", 4))


@query("agg_first_last", with_ev("""
SELECT user_id, arg_min(device_id, us) FILTER (device_id IS NOT NULL) AS first_device, arg_max(amount, us) FILTER (amount IS NOT NULL) AS last_amount
FROM ev GROUP BY user_id"""))
def agg_first_last(spark, sf):
    return steps.aggregate(load_events(spark, sf), ["user_id"], [agg("first", "device_id", "first_device"), agg("last", "amount", "last_amount")])


@query("agg_std_var", with_ev("SELECT user_id, round(stddev_samp(amount), 6) AS sd, round(var_samp(amount), 6) AS va FROM ev WHERE event_type = 'payment' GROUP BY user_id"))
def agg_std_var(spark, sf):
    out = steps.aggregate(load_events(spark, sf).where("event_type = 'payment'"), ["user_id"], [agg("std", "amount", "sd"), agg("var", "amount", "va")])
    return out.select("user_id", r("sd").alias("sd"), r("va").alias("va"))


@query("agg_median", with_ev("SELECT country, round(quantile_cont(amount, 0.5), 6) AS middle, count(*) AS n FROM ev GROUP BY country"))
def agg_median(spark, sf):
    out = steps.aggregate(load_events(spark, sf), ["country"], [agg("median", "amount", "middle"), agg("count", "*", "n")])
    return out.withColumn("middle", r("middle"))


@query("agg_quantiles", "SELECT round(quantile_cont(l_extendedprice, 0.02), 4) AS q2, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.98), 4) AS q98 FROM lineitem")
def agg_quantiles(spark, sf):
    out = grouped_quantiles(table(spark, sf, "lineitem"), [], "l_extendedprice", {"q2": 0.02, "q50": 0.5, "q98": 0.98})
    return out.select(*[r(c, 4).alias(c) for c in out.columns])


@query("agg_count_distinct", with_ev("SELECT country, count(DISTINCT device_id) AS devices, count(DISTINCT ip) AS ips FROM ev GROUP BY country"))
def agg_count_distinct(spark, sf):
    return steps.aggregate(load_events(spark, sf), ["country"], [agg("count_distinct", "device_id", "devices"), agg("nunique", "ip", "ips")])


@query("agg_group_only", with_ev("SELECT event_type, country, count(*) AS count FROM ev GROUP BY ALL"))
def agg_group_only(spark, sf):
    return steps.aggregate(load_events(spark, sf), ["event_type", "country"])


@query("agg_global", with_ev("SELECT count(*) AS n, round(sum(amount), 4) AS total, round(avg(amount), 6) AS mean, count(DISTINCT user_id) AS users FROM ev"))
def agg_global(spark, sf):
    out = steps.aggregate(load_events(spark, sf), [], [
        agg("count", "amount", "n"), agg("sum", "amount", "total"), agg("mean", "amount", "mean"), agg("count_distinct", "user_id", "users")])
    return out.select("n", r("total", 4).alias("total"), r("mean").alias("mean"), "users")


PROFILED = ["event_id", "event_type", "user_id", "device_id", "ip", "country", "amount", "geo_lat"]


def _profile_sql():
    kinds = {"event_id": "number", "amount": "number", "geo_lat": "number"}
    parts = [
        f"""SELECT '{c}' AS "column", '{kinds.get(c, 'string')}' AS detected_type, count(*) FILTER ({c} IS NULL) AS nulls,
        round(count(*) FILTER ({c} IS NULL) / count(*) * 100, 2) AS null_percent, count(DISTINCT {c}) AS uniques,
        (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM ev WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)) AS samples FROM ev"""
        for c in PROFILED
    ]
    return with_ev(" UNION ALL ".join(parts))


@query("profile_columns", _profile_sql())
def profile_columns(spark, sf):
    return profile.profile_columns(load_events(spark, sf).select(*PROFILED))


def _stats_sql():
    numbers = ("event_id", "amount", "geo_lat")
    parts = []
    for c in PROFILED:
        x = f"CAST({c} AS DOUBLE)" if c in numbers else "CAST(NULL AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS uniques,
        min({x}) AS min_value, max({x}) AS max_value, round(avg({x}), 6) AS mean_value FROM ev""")
    return with_ev(" UNION ALL ".join(parts))


@query("column_stats", _stats_sql())
def column_stats(spark, sf):
    return profile.column_stats(load_events(spark, sf).select(*PROFILED)).withColumn("mean_value", r("mean_value"))


@query("page_total", with_ev("""
SELECT event_id, amount, (SELECT count(*) FROM ev WHERE event_type = 'payment') AS total_rows FROM ev WHERE event_type = 'payment'
ORDER BY amount DESC NULLS LAST, ts, event_id LIMIT 25 OFFSET 50"""))
def page_total(spark, sf):
    df = load_events(spark, sf).where("event_type = 'payment'")
    return steps.page_with_total(df, [{"field": "amount", "direction": "desc"}], 25, 50).select("event_id", "amount", "total_rows")


@query("sort_multi", with_ev("SELECT event_id, country, amount FROM ev"))
def sort_multi(spark, sf):
    keys = [{"field": "country", "direction": "asc"}, {"field": "amount", "direction": "desc"}, {"field": "missing"}]
    return steps.sort_rows(load_events(spark, sf), keys).select("event_id", "country", "amount")


@query("sort_ci", "SELECT c_custkey, c_mktsegment, c_name FROM customer")
def sort_ci(spark, sf):
    keys = [{"field": "c_mktsegment", "ci": True}, {"field": "c_name", "ci": True, "direction": "desc"}]
    return steps.sort_rows(table(spark, sf, "customer"), keys, ["c_custkey"]).select("c_custkey", "c_mktsegment", "c_name")


@query("limit_offset", with_ev("SELECT event_id, amount FROM ev ORDER BY amount ASC NULLS LAST, ts, event_id LIMIT 30 OFFSET 15"))
def limit_offset(spark, sf):
    df = steps.sort_rows(load_events(spark, sf), [{"field": "amount"}])
    return steps.limit_rows(df, 30, 15).select("event_id", "amount")


@query("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100")
def topk(spark, sf):
    df = steps.sort_rows(table(spark, sf, "lineitem"), [{"field": "l_extendedprice", "direction": "desc"}], ["l_orderkey", "l_linenumber", "l_partkey"])
    return steps.limit_rows(df, 100).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("union_all", with_ev("""
SELECT event_id, user_id, amount, CAST(NULL AS VARCHAR) AS ip FROM ev WHERE source = 'ticket_events'
UNION ALL SELECT event_id, user_id, NULL, ip FROM ev WHERE source = 'auth_events'
UNION ALL SELECT event_id, user_id, NULL, ip FROM ev WHERE event_type IN ('auth_failure', 'view')"""))
def union_all(spark, sf):
    ev = load_events(spark, sf)
    return steps.union_all([
        ev.where("source = 'ticket_events'").select("event_id", "user_id", "amount"),
        ev.where("source = 'auth_events'").select("event_id", "user_id", "ip"),
        ev.where("event_type IN ('auth_failure', 'view')").select("event_id", "ip", "user_id"),
    ])


@query("distinct_rows", with_ev("SELECT DISTINCT user_id, device_id, ip FROM ev"))
def distinct_rows(spark, sf):
    return steps.distinct_rows(load_events(spark, sf).select("user_id", "device_id", "ip"))


@query("distinct_subset", with_ev("""
SELECT event_id, user_id, device_id, event_type FROM ev
QUALIFY row_number() OVER (PARTITION BY user_id, device_id ORDER BY ts, event_id) = 1"""))
def distinct_subset(spark, sf):
    df = load_events(spark, sf).select("event_id", "ts", "user_id", "device_id", "event_type")
    return steps.distinct_rows(df, ["user_id", "device_id"]).drop("ts")

