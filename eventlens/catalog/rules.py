"""Rule engine queries."""

from pyspark.sql import functions as F

from eventlens.catalog.common import load_events, with_ev
from eventlens.catalog.features import DIST, FAIL, HOME, HOME_KM, HOURS, LAGGED, SPARSE_AS_SERIES, SPEED, VELOCITY, robust_sql, series_sql
from eventlens.functions import rules as ru
from eventlens.operators.features import behaviour_features
from eventlens.registry import query
from eventlens.sources.store import scan_range
from eventlens.functions.predicates import filter_view

# operator -> (field, value, value2, SQL twin)
OPERATORS = {
    "eq": ("event_type", "view", None, "event_type = 'view'"),
    "ne": ("device_id", "d7", None, "coalesce(device_id <> 'd7', false)"),
    "gt": ("amount", 100, None, "coalesce(amount > 100, false)"),
    "gte": ("amount", "50", None, "coalesce(amount >= 50, false)"),
    "lt": ("geo_lat", 0, None, "coalesce(geo_lat < 0, false)"),
    "lte": ("country", "C2", None, "country <= 'C2'"),
    "contains": ("event_type", "FAIL", None, "contains(lower(event_type), 'fail')"),
    "not_contains": ("card_hash", "C1", None, "coalesce(NOT contains(card_hash, 'c1'), false)"),
    "startswith": ("ip", "10.0.1", None, "starts_with(ip, '10.0.1')"),
    "endswith": ("device_id", "5", None, "coalesce(ends_with(device_id, '5'), false)"),
    "matches": ("event_type", "^AUTH_s", None, "regexp_matches(event_type, '^AUTH_s', 'i')"),
    "in": ("carrier", ["X1", "X3"], None, "carrier IN ('X1', 'X3')"),
    "not_in": ("card_hash", ["c1", "c2"], None, "coalesce(card_hash NOT IN ('c1', 'c2'), false)"),
    "is_null": ("amount", None, None, "amount IS NULL"),
    "is_not_null": ("card_hash", None, None, "card_hash IS NOT NULL"),
    "between": ("amount", 10, 20, "coalesce(amount BETWEEN 10 AND 20, false)"),
    "not_between": ("amount", 5, 300, "coalesce(amount NOT BETWEEN 5 AND 300, false)"),
}


def leaf(field, op, value=None, value2=None):
    return {"field": field, "op": op, "value": value, "value2": value2}


def make(rid, conditions, severity="medium", tags=(), score=0.1, **extra):
    return {"id": rid, "name": rid.title(), "conditions": conditions, "severity": severity, "tags": list(tags), "score_contribution": score, **extra}


def ids_sql(tests):
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {sql} THEN '{n}' END" for n, sql in tests.items()) + ")"


def _ids(df):
    return df.select("event_id", F.array_join("rule_ids", ",").alias("rule_ids"))


@query("rules_operators", with_ev(f"SELECT event_id, {ids_sql({n: v[3] for n, v in OPERATORS.items()})} AS rule_ids FROM ev"))
def rules_operators(spark, sf):
    rules = [make(op, leaf(field, op, value, value2)) for op, (field, value, value2, _) in OPERATORS.items()]
    return _ids(ru.evaluate_rules(load_events(spark, sf), rules))


@query("rules_nested_field", with_ev("""
SELECT event_id, concat_ws(',', CASE WHEN CAST(json_extract_string(meta, '$.k') AS DOUBLE) > 50 THEN 'json' END, CASE WHEN geo_lat < 0 THEN 'struct' END, 'absent') AS rule_ids FROM ev"""))
def rules_nested_field(spark, sf):
    df = load_events(spark, sf).withColumn("geo", F.struct(F.col("geo_lat").alias("lat")))
    rules = [make("json", leaf("meta.k", "gt", 50)), make("struct", leaf("geo.lat", "lt", 0)), make("absent", leaf("no.where", "is_null")), make("never", leaf("no.where", "eq", 1))]
    return _ids(ru.evaluate_rules(df, rules))


GROUPS = {
    "both": ({"operator": "AND", "rules": [leaf("event_type", "eq", "view"), leaf("amount", "gt", 20)]}, "event_type = 'view' AND coalesce(amount > 20, false)"),
    "either": ({"operator": "OR", "rules": [leaf("country", "eq", "C1"), {"operator": "AND", "rules": [leaf("country", "eq", "C2"), leaf("carrier", "eq", "X2")]}]},
               "country = 'C1' OR (country = 'C2' AND carrier = 'X2')"),
    "negated": ({"operator": "NOT", "rules": [leaf("amount", "gt", 20), leaf("country", "eq", "C1")]}, "NOT coalesce(amount > 20, false)"),
    "empty": ({"operator": "AND", "rules": []}, "true"),
    "deep": ({"operator": "NOT", "rules": [{"operator": "OR", "rules": [leaf("device_id", "is_null"), {"operator": "NOT", "rules": [leaf("ip", "endswith", "7")]}]}]},
             "NOT (device_id IS NULL OR NOT ends_with(ip, '7'))"),
}


@query("rules_groups", with_ev(f"SELECT event_id, {ids_sql({n: f'({sql})' for n, (_, sql) in GROUPS.items()})} AS rule_ids FROM ev"))
def rules_groups(spark, sf):
    rules = [make(n, tree) for n, (tree, _) in GROUPS.items()] + [make("off", leaf("event_id", "is_not_null"), enabled=False)]
    return _ids(ru.evaluate_rules(load_events(spark, sf), rules))


SCORING = [
    make("fail", leaf("event_type", "contains", "fail"), "high", ["auth", "ato"], 0.25),
    make("big", leaf("amount", "gt", 100), "critical", ["amount"], 0.5),
    make("mixed", {"operator": "AND", "rules": [leaf("card_country", "ne", "${country}"), leaf("card_country", "is_not_null")]}, "medium", ["geo", "ato"], 0.125),
    make("ip", leaf("ip", "startswith", "10.0.1."), "low", ["ip"], 0.0625),
]
# id -> (SQL, severity rank, score, tags)
SCORING_SQL = {
    "fail": ("contains(event_type, 'fail')", 3, 0.25, ["auth", "ato"]), "big": ("coalesce(amount > 100, false)", 4, 0.5, ["amount"]),
    "mixed": ("card_country <> country", 2, 0.125, ["geo", "ato"]), "ip": ("starts_with(ip, '10.0.1.')", 1, 0.0625, ["ip"]),
}
HIT_SQL = "hit AS (" + " UNION ALL ".join(
    f"SELECT event_id, user_id, ts, source, '{n}' AS rule_id, {rank} AS sev, {score}::DOUBLE AS score, {tags!r} AS tags FROM ev WHERE {sql}"
    for n, (sql, rank, score, tags) in SCORING_SQL.items()) + ")"
SEV_NAME = "CASE {c} WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' END"


@query("rules_evaluate", with_ev(f"""
SELECT e.event_id, count(h.rule_id) AS matches, {SEV_NAME.format(c='max(h.sev)')} AS rule_severity, coalesce(sum(h.score), 0) AS rule_score,
  coalesce(array_to_string(list_sort(list_distinct(flatten(list(h.tags)))), ','), '') AS rule_tags FROM ev e LEFT JOIN hit h ON e.event_id = h.event_id GROUP BY e.event_id""", HIT_SQL))
def rules_evaluate(spark, sf):
    out = ru.evaluate_rules(load_events(spark, sf), SCORING)
    return out.select(
        "event_id", F.size("rule_matches").cast("bigint").alias("matches"), "rule_severity", "rule_score", F.array_join("rule_tags", ",").alias("rule_tags"))


@query("rules_match_rate", with_ev("SELECT rule_id, count(*) AS matches, count(*) / (SELECT count(*) FROM ev) AS match_rate FROM hit GROUP BY rule_id", HIT_SQL))
def rules_match_rate(spark, sf):
    return ru.match_rates(load_events(spark, sf), SCORING)


@query("rule_match_audit", with_ev(f"SELECT event_id, user_id, rule_id, {SEV_NAME.format(c='sev')} AS severity, score AS score_contribution FROM hit", HIT_SQL))
def rule_match_audit(spark, sf):
    audit = ru.match_audit(ru.evaluate_rules(load_events(spark, sf), SCORING))
    return audit.select("event_id", "user_id", "rule_id", "severity", "score_contribution")


@query("rules_by_range", with_ev("""
SELECT event_id, string_agg(rule_id, ',' ORDER BY rule_id) AS rule_ids FROM hit WHERE rule_id IN ('fail', 'ip') AND source = 'auth_events'
  AND ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00' GROUP BY event_id""", HIT_SQL))
def rules_by_range(spark, sf):
    rows = scan_range(load_events(spark, sf), "2024-01-10 00:00:00", "2024-01-15 00:00:00")
    rows = filter_view(rows, [{"field": "source", "op": "eq", "value": "auth_events"}])
    out = ru.evaluate_rules(rows, SCORING, ["fail", "ip"])
    return out.where(F.size("rule_ids") > 0).select("event_id", F.array_join(F.array_sort("rule_ids"), ",").alias("rule_ids"))


@query("rules_summary", with_ev(f"""
SELECT {SEV_NAME.format(c='sev')} AS severity, tag, count(*) AS matches, sum(score) AS score FROM (SELECT sev, score, unnest(tags) AS tag FROM hit) GROUP BY sev, tag""", HIT_SQL))
def rules_summary(spark, sf):
    return ru.rules_summary(ru.evaluate_rules(load_events(spark, sf), SCORING))


# --- built-in rules over behaviour features -----------------------------------------

SPIKE_SQL = series_sql(FAIL, 60).split("grid AS")[0] + SPARSE_AS_SERIES + ", " + robust_sql(1440, 30, 1)
FLAGS_SQL = """flags AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, coalesce(device_id, 'unknown') ORDER BY ts, event_id) = 1 AS nd,
  row_number() OVER (PARTITION BY user_id, ip ORDER BY ts, event_id) = 1 AS ni,
  NOT coalesce(list_contains(list(coalesce(device_id, 'unknown')) OVER w, coalesce(device_id, 'unknown')), false) AS ndr,
  NOT coalesce(list_contains(list(ip) OVER w, ip), false) AS nir,
  -ln((count(*) OVER (PARTITION BY coalesce(device_id, 'unknown')) + 1) / (count(*) OVER () + 1)) AS dr, -ln((count(*) OVER (PARTITION BY ip) + 1) / (count(*) OVER () + 1)) AS ir
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))"""
FEATURES_SQL = ", ".join([LAGGED, DIST, SPEED, HOME, HOME_KM, HOURS, VELOCITY, SPIKE_SQL, FLAGS_SQL]) + """,
vstat AS (SELECT user_id, avg(v) AS vm, coalesce(nullif(stddev_samp(v), 0), 1) AS vs FROM vel GROUP BY user_id),
feat AS (SELECT s.event_id, s.user_id, s.event_type, s.amount, s.country, s.card_country, s.dist_prev_km, s.speed_kmh, hd.dist_home_km,
  vel.v AS event_velocity, vm, vs, (vel.v - vm) / (vs + 1e-6) AS event_velocity_z, nd::INT AS is_new_device, ni::INT AS is_new_ip, ndr::INT AS is_new_device_rolling, nir::INT AS is_new_ip_rolling,
  dr AS device_rarity_global, ir AS ip_rarity_global, -ln(greatest(hour_prob, 1e-6)) AS hour_rarity,
  sin(2 * pi() * hour(s.ts) / 24) AS h_sin, cos(2 * pi() * hour(s.ts) / 24) AS h_cos, coalesce(rz.z, 0) AS z_fail
  FROM speed s JOIN hd ON s.event_id = hd.event_id JOIN vel ON s.event_id = vel.event_id JOIN vstat ON s.user_id = vstat.user_id JOIN flags ON s.event_id = flags.event_id
  JOIN hours ON s.user_id = hours.user_id AND hour(s.ts) = hours.h LEFT JOIN rz ON s.user_id = rz.user_id AND s.us // 60000000 * 60 = rz.bucket)"""

BUILTIN_SQL = {
    "impossible_travel": "speed_kmh > 900 AND dist_prev_km > 100", "new_device_high_value": "is_new_device = 1 AND amount > 1000",
    "rapid_failures": "contains(event_type, 'fail') AND z_fail > 2.5", "far_from_home": "dist_home_km > 2000",
    "new_ip_new_device": "is_new_ip = 1 AND is_new_device = 1", "unusual_hour": "hour_rarity > 3.0", "country_mismatch": "card_country <> country",
}


@query("rules_builtin", with_ev(f"SELECT event_id, {ids_sql(BUILTIN_SQL)} AS rule_ids FROM feat", FEATURES_SQL))
def rules_builtin(spark, sf):
    return _ids(ru.evaluate_rules(behaviour_features(load_events(spark, sf)), ru.BUILTIN_RULES))
