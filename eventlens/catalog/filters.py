"""Projection, filter and predicate queries."""

from pyspark.sql import functions as F

from eventlens.catalog.common import SEVERITY_SQL, load_events, scored_events, with_ev, with_scored
from eventlens.functions.predicates import filter_rows, filter_view
from eventlens.functions.scales import severity
from eventlens.operators import steps, viz
from eventlens.registry import query
from eventlens.sources import store


def _filtered(spark, sf, conds, *columns):
    return filter_rows(load_events(spark, sf), conds).select("event_id", *columns)


def cond(field, op, value=None):
    return {"field": field, "op": op, "value": value}


@query("filter_eq_ne", with_ev("SELECT event_id, device_id FROM ev WHERE event_type = 'payment' AND device_id IS DISTINCT FROM 'd7'"))
def filter_eq_ne(spark, sf):
    return _filtered(spark, sf, [cond("event_type", "eq", "payment"), cond("device_id", "ne", "d7")], "device_id")


@query("filter_cmp", with_ev("SELECT event_id, amount FROM ev WHERE amount > 20 AND amount <= 200.5 AND geo_lat >= -10 AND geo_lat < 45"))
def filter_cmp(spark, sf):
    conds = [cond("amount", "gt", 20), cond("amount", "lte", 200.5), cond("geo_lat", "gte", -10), cond("geo_lat", "lt", 45)]
    return _filtered(spark, sf, conds, "amount")


@query("filter_in_nin", with_ev(
    "SELECT event_id FROM ev WHERE country IN ('C1', 'C2', 'C7') AND (card_hash IS NULL OR card_hash NOT IN ('c1', 'c2')) AND event_type IN ('payment', 'view')"))
def filter_in_nin(spark, sf):
    conds = [cond("country", "in", ["C1", "C2", "C7"]), cond("card_hash", "nin", ["c1", "c2"]), cond("event_type", "in", ["payment", "view"])]
    return _filtered(spark, sf, conds)


@query("filter_string", with_ev(
    "SELECT event_id, ip FROM ev WHERE regexp_matches(event_type, 'AUTH.F', 'i') AND starts_with(ip, '10.0.1') AND ends_with(device_id, '5')"))
def filter_string(spark, sf):
    conds = [cond("event_type", "contains", "AUTH.F"), cond("ip", "startswith", "10.0.1"), cond("device_id", "endswith", "5")]
    return _filtered(spark, sf, conds, "ip")


@query("filter_nulls", with_ev("SELECT event_id FROM ev WHERE card_hash IS NULL AND amount IS NOT NULL AND geo_lat IS NOT NULL"))
def filter_nulls(spark, sf):
    return _filtered(spark, sf, [cond("card_hash", "isnull"), cond("amount", "notnull"), cond("geo_lat", "notnull")])


@query("filter_regex", with_ev("SELECT event_id, ip FROM ev WHERE regexp_matches(ip, '^(?:10\\.0\\.1[0-9]\\.[0-5]$)')"))
def filter_regex(spark, sf):
    return _filtered(spark, sf, [cond("ip", "regex", r"10\.0\.1[0-9]\.[0-5]$")], "ip")


@query("filter_between", with_ev("SELECT event_id, amount FROM ev WHERE amount BETWEEN 10 AND 50"))
def filter_between(spark, sf):
    return _filtered(spark, sf, [cond("amount", "between", [10, 50])], "amount")


@query("filter_conjunction", with_ev("SELECT event_id FROM ev WHERE event_type = 'click' AND country = 'C3'"))
def filter_conjunction(spark, sf):
    conds = {"conditions": [cond("event_type", "eq", "click"), cond("no_such_field", "eq", 1), cond("country", "eq", "C3"), cond("", "eq", 1)]}
    return filter_rows(_filtered(spark, sf, conds, "event_type"), cond("event_type", "eq", "click")).select("event_id")


@query("where_viz", with_ev("""
SELECT event_id, event_type FROM ev WHERE regexp_matches(event_type, 'FAIL|pay', 'i') AND contains(ip, '.1')
  AND json_extract_string(meta, '$.k') IN ('3', '33', '42') AND ts >= TIMESTAMP '2024-01-03 06:00:00'"""))
def where_viz(spark, sf):
    conds = [
        cond("event_type", "icontains", "FAIL|pay"), cond("ip", "contains", r"\.1"), cond("meta.k", "in", ["3", "33", "42"]),
        cond("ts", "gte", "2024-01-03 06:00:00"), cond("nowhere", "eq", "x"),
    ]
    return filter_view(load_events(spark, sf), conds).select("event_id", "event_type")


@query("query_advanced", with_ev("""
SELECT event_id, user_id, amount FROM ev WHERE event_type = 'payment' AND amount > 5
ORDER BY amount DESC NULLS LAST, user_id, ts, event_id LIMIT 40 OFFSET 10"""))
def query_advanced(spark, sf):
    return store.advanced_query(
        load_events(spark, sf), [cond("event_type", "eq", "payment"), cond("amount", "gt", 5)],
        ["event_id", "user_id", "amount", "missing"], [("amount", "desc"), ("user_id", "asc")], 10, 40)


@query("select_alias", with_ev("SELECT event_id, user_id AS who, event_type AS what FROM ev"))
def select_alias(spark, sf):
    wanted = ["event_id", {"field": "user_id", "alias": "who"}, {"field": "event_type", "alias": "what"}, "missing"]
    return steps.select_columns(load_events(spark, sf), wanted)


@query("rename_cols", with_ev("SELECT event_id AS id, user_id AS actor, country FROM ev"))
def rename_cols(spark, sf):
    df = load_events(spark, sf).select("event_id", "user_id", "country")
    return steps.rename_columns(df, {"event_id": "id", "user_id": "actor", "missing": "x"})


@query("drop_cols", with_ev("SELECT event_id, user_id FROM ev"))
def drop_cols(spark, sf):
    df = load_events(spark, sf).select("event_id", "user_id", "ip", "legs")
    return steps.drop_columns(df, ["ip", "legs", "missing"])


@query("transform_chain", with_ev("""
SELECT event_id, round(amount * 2, 6) AS twice, round(amount * 2 + 1, 6) AS more, upper(event_type) AS kind,
  round((amount * 2) - 7 * floor((amount * 2) / 7), 6) AS rest, CAST(NULL AS DOUBLE) AS broken, hour(ts)::INT AS hr FROM ev"""))
def transform_chain(spark, sf):
    out = steps.transform(load_events(spark, sf), [
        {"name": "twice", "op": "*", "args": ["amount", 2]},
        {"name": "more", "op": "+", "args": ["twice", 1]},
        {"name": "kind", "fn": "upper", "args": ["event_type"]},
        {"name": "rest", "op": "%", "args": ["twice", 7]},
        {"name": "broken", "op": "/", "args": ["amount", 0]},
        {"name": "hr", "fn": "hour", "args": ["ts"]},
        {"name": "twice", "expr": "round(twice, 6)"},
        {"name": "more", "expr": "round(more, 6)"},
        {"name": "rest", "expr": "round(rest, 6)"},
    ])
    return out.select("event_id", "twice", "more", "kind", "rest", "broken", "hr")


@query("severity_bin", with_scored(f"SELECT event_id, anom_score, {SEVERITY_SQL.format(c='anom_score')} AS severity FROM scored"))
def severity_bin(spark, sf):
    return scored_events(spark, sf).select("event_id", "anom_score", severity(F.col("anom_score")).alias("severity"))


@query("severity_filter", with_scored(f"""
SELECT event_id, anom_score, sev AS severity FROM (SELECT *, {SEVERITY_SQL.format(c='anom_score')} AS sev FROM scored)
WHERE sev IN ('critical', 'high') AND anom_score >= 0.6 AND contains(upper(carrier), 'X1') AND country = 'C4'"""))
def severity_filter(spark, sf):
    out = viz.severity_filter(scored_events(spark, sf), ["critical", "high"], 0.6, "x1", ("country", "C4"))
    return out.select("event_id", "anom_score", "severity")


@query("drill_down", with_scored("""
SELECT event_id, anom_score, array_to_string(list_sort(list_distinct(codes)), ',') AS codes FROM scored
WHERE country = 'C4' AND event_type = 'view' AND anom_score >= 0.25 ORDER BY anom_score DESC, ts, event_id LIMIT 50"""))
def drill_down(spark, sf):
    out = viz.drill_down(scored_events(spark, sf), [("country", "C4"), ("event_type", "view")], 0.25, 50)
    return out.select("event_id", "anom_score", "codes")
