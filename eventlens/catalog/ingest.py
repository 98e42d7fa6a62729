"""Mapping and validation queries."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.catalog.common import epoch, load_events, r, with_ev
from eventlens.catalog.scalars import MESSY_SQL, NUM, PRESENT, messy
from eventlens.functions import validation as va
from eventlens.operators import mapping as mp
from eventlens.registry import query

# Raw uploads: the field names each source uses for canonical columns.
RAW_NAMES = {
    "auth_events": {"timestamp": "us", "etype": "event_type", "username": "user_id", "src_ip": "ip", "device": "device_id", "lat": "geo_lat", "lon": "geo_lon"},
    "ticket_events": {"event_time": "us", "type": "event_type", "customer_id": "user_id", "total_amount": "amount", "card_token": "card_hash", "orig": "origin", "destination": "dest"},
    "web_events": {"when": "us", "action": "event_type", "account": "account_id", "device": "device_id", "client_ip": "ip", "country_code": "country"},
}


def payloads(spark, sf):
    """(source, raw): every event as the JSON record its source would send."""
    df = load_events(spark, sf).withColumn("us", epoch("ts"))
    raw = F.lit(None).cast("string")
    for source, names in RAW_NAMES.items():
        record = F.to_json(F.struct(*[F.col(c).alias(n) for n, c in names.items()]))
        raw = F.when(F.col("source") == source, record).otherwise(raw)
    return df.select("event_id", "source", raw.alias("raw"))


CATALOG_SQL = "cat AS (SELECT dataset, f.col AS col, f.place AS place FROM (SELECT DISTINCT source AS dataset, unnest(CASE source " + " ".join(
    f"WHEN '{s}' THEN [{', '.join(f'{{col: {n!r}, place: {i}}}' for i, n in enumerate(names))}]" for s, names in RAW_NAMES.items()) + " END) AS f FROM ev))"
PATTERN_SQL = "pat(target, pattern, pos) AS (VALUES " + ", ".join(
    f"('{t}', '{p}', {i})" for i, (t, p) in enumerate(mp.SYNONYMS.items())) + ")"
HITS_SQL = """hits AS (SELECT dataset, col, place, target, length(regexp_extract(lower(col), pattern, 0)) / length(col) AS score
  FROM cat, pat WHERE regexp_matches(lower(col), pattern))"""


@query("mapping_scores", with_ev("""
SELECT dataset, target, col AS "column", round(score, 3) AS score, row_number() OVER (PARTITION BY dataset, target ORDER BY score DESC, col)::INT AS rank
FROM hits WHERE score > 0.1 QUALIFY rank <= 5""", CATALOG_SQL, PATTERN_SQL, HITS_SQL))
def mapping_scores(spark, sf):
    return mp.mapping_scores(mp.catalog_of(payloads(spark, sf), "source", "raw"))


_EXPR_SQL = " ".join(f"WHEN '{t}' THEN '{e}'" for t, e in mp.SUGGESTED_EXPRESSION.items())


@query("suggest_mapping", with_ev(f"""
SELECT dataset, target, arg_min(col, place) AS "column", CASE target {_EXPR_SQL} END AS expression FROM hits WHERE target NOT IN ('ts', 'event_type') GROUP BY dataset, target
UNION ALL SELECT c.dataset, 'ts', coalesce(arg_min(h.col, h.place), arg_min(c.col, c.place)), NULL FROM cat c LEFT JOIN hits h ON h.dataset = c.dataset AND h.target = 'ts' GROUP BY c.dataset
UNION ALL SELECT c.dataset, 'event_type', coalesce(arg_min(h.col, h.place), 'event'), NULL FROM cat c LEFT JOIN hits h ON h.dataset = c.dataset AND h.target = 'event_type' GROUP BY c.dataset
UNION ALL SELECT DISTINCT dataset, 'source_value', 'csv_upload', NULL FROM cat
UNION ALL SELECT dataset, 'user_id', NULL, 'concat:-:' || arg_min(col, place) FILTER (target = 'account_id') || ',' || arg_min(col, place) FILTER (target = 'device_id') FROM hits
  GROUP BY dataset HAVING count(*) FILTER (target = 'user_id') = 0""", CATALOG_SQL, PATTERN_SQL, HITS_SQL))
def suggest_mapping(spark, sf):
    return mp.suggest_mapping(mp.catalog_of(payloads(spark, sf), "source", "raw"))


TEMPLATES = [
    ("logins", ["timestamp", "etype", "username", "session"], ["timestamp", "etype", "src_ip", "device"]),
    ("tickets", ["event_time", "type", "pnr", "office"], ["event_time", "customer_id", "total_amount", "carrier"]),
    ("clicks", ["when", "action", "browser"], ["when", "action", "client_ip"]),
    ("other", ["a", "b"], ["c"]),
]
TEMPLATE_SQL = "tpl(template, sample, sources) AS (VALUES " + ", ".join(f"('{n}', {a!r}, {b!r})" for n, a, b in TEMPLATES) + ")"


@query("template_match", with_ev("""
SELECT dataset, template, round(s, 3) AS score, array_to_string(list_sort(shared), ',') AS matched,
  array_to_string(list_sort(list_filter(expected, lambda x: NOT list_contains(cols, x))), ',') AS missing FROM (
  SELECT *, list_intersect(cols, expected) AS shared, len(list_intersect(cols, expected)) / len(list_distinct(list_concat(cols, expected))) * 0.4
    + len(list_intersect(cols, sources)) / len(sources) * 0.6 AS s
  FROM (SELECT dataset, list(col) AS cols FROM cat GROUP BY dataset), (SELECT *, list_distinct(list_concat(sample, sources)) AS expected FROM tpl)) WHERE s >= 0.3""",
    CATALOG_SQL, TEMPLATE_SQL))
def template_match(spark, sf):
    catalog = mp.catalog_of(payloads(spark, sf), "source", "raw")
    files = catalog.groupBy("dataset").agg(F.array_sort(F.collect_set(F.lower("column"))).alias("columns"))
    templates = spark.createDataFrame(TEMPLATES, "template string, sample_columns array<string>, mapping_sources array<string>")
    return mp.template_match(files, templates)


MAPPING = {"who": "user_id", "price": "num", "tag": "label", "where_from": "country", "kind": "event_type", "gone": "no_such_column"}
EXPRESSIONS = {
    "price": {"op": "try_float", "col": "num"}, "tag": "trim", "key": "${user_id}#${country}",
    "kind": {"op": "map", "col": "event_type", "mapping": {"view": "V"}},
}
MAPPED_SQL = f"""SELECT event_id, user_id AS who, {NUM} AS price, CASE WHEN {PRESENT} THEN trim(label) ELSE 'no tag' END AS tag, country AS where_from,
  CASE WHEN event_type = 'view' THEN 'V' ELSE event_type END AS kind, concat(user_id, '#', country) AS key FROM mess"""


def _mapped(df):
    return mp.apply_mapping(df, MAPPING, EXPRESSIONS, {"tag": "no tag"}, keep=["event_id"])


@query("map_table", with_ev(MAPPED_SQL, MESSY_SQL))
def map_table(spark, sf):
    return _mapped(messy(spark, sf))


@query("ingest_flow", with_ev("""
SELECT event_id, epoch_us(coalesce(try_strptime(day, '%Y-%m-%d %H:%M:%S'), try_strptime(day, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(day, '%Y-%m-%d'),
  try_strptime(day, '%d/%m/%Y %H:%M:%S'), try_strptime(day, '%d/%m/%Y'), try_strptime(day, '%m/%d/%Y'))) AS ts, upper(event_type) AS event_type, user_id, 'upload' AS source FROM mess""", MESSY_SQL))
def ingest_flow(spark, sf):
    raw = messy(spark, sf).select("event_id", F.col("day").alias("when"), F.col("event_type").alias("etype"), F.col("user_id").alias("login"))
    mapping = {"ts": "when", "event_type": "etype", "user_id": "login", "city": "not_there"}
    out = mp.ingest(raw, mapping, "upload", {"event_type": "upper"}, keep=["event_id"])
    return out.withColumn("ts", epoch("ts"))


@query("pack_unmapped", with_ev("""
SELECT event_id, user_id, country AS packed_country, carrier AS packed_carrier, CAST(NULL AS VARCHAR) AS packed_user FROM ev"""))
def pack_unmapped(spark, sf):
    df = load_events(spark, sf).select("event_id", "user_id", "country", "carrier", "amount")
    out = mp.pack_unmapped(df, ["user_id", "amount"], ["event_id"])
    return out.select(
        "event_id", "user_id", F.get_json_object("meta", "$.country").alias("packed_country"),
        F.get_json_object("meta", "$.carrier").alias("packed_carrier"), F.get_json_object("meta", "$.user_id").alias("packed_user"))


@query("remap_source", with_ev(f"SELECT * FROM ({MAPPED_SQL} WHERE source = 'ticket_events')", MESSY_SQL))
def remap_source(spark, sf):
    return _mapped(messy(spark, sf).where("source = 'ticket_events'"))


def rule(field, kind, action="warn", default=None, severity="warning", **config):
    return {"name": f"{field} {kind}", "target_field": field, "rule_type": kind, "on_failure": action, "default_value": default, "severity": severity, "config": config}


PREVIEW_RULES = [rule("price", "range", "reject", min=0, max=120), rule("tag", "length", "warn", min=3, max=8)]


@query("mapping_preview", with_ev(f"""
SELECT count(*) AS total_rows, count(*) FILTER (NOT bad) AS valid_rows, count(*) FILTER (bad) AS rejected_rows, count(*) FILTER (warn AND NOT bad) AS warning_rows FROM (
  SELECT coalesce(price < 0 OR price > 120, false) AS bad, length(tag) < 3 OR length(tag) > 8 AS warn FROM ({MAPPED_SQL} ORDER BY event_id LIMIT 200))""", MESSY_SQL))
def mapping_preview(spark, sf):
    sample = messy(spark, sf).orderBy("event_id").limit(200)
    return va.check_counts(va.run_checks(_mapped(sample), PREVIEW_RULES))


def _checked(spark, sf, rules, *columns):
    return va.run_checks(messy(spark, sf), rules).select("event_id", *columns, "rejected", "warned")


@query("val_required", with_ev("SELECT event_id, amount IS NULL AS rejected, amount IS NOT NULL AS warned FROM ev"))
def val_required(spark, sf):
    return _checked(spark, sf, [rule("amount", "required", "reject"), rule("currency", "not_null", "warn"), rule("currency", "length", "warn", min=3)])


@query("val_not_empty", with_ev(f"SELECT event_id, CASE WHEN {PRESENT} THEN label ELSE 'unknown' END AS label, false AS rejected, NOT coalesce({PRESENT}, false) AS warned FROM mess", MESSY_SQL))
def val_not_empty(spark, sf):
    return _checked(spark, sf, [rule("label", "not_empty", "default", "unknown")], "label")


NUM2 = "CASE event_id % 4 WHEN 0 THEN concat(CAST(event_id % 50 AS {s}), ',5') WHEN 1 THEN '7' WHEN 2 THEN 'many' ELSE NULL END"


@query("val_type", with_ev(f"""
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN replace(n2, ',', '.') ELSE n2 END AS n2, false AS rejected, event_id % 4 IN (0, 2) AS warned FROM (SELECT event_id, {NUM2.format(s='VARCHAR')} AS n2 FROM ev)"""))
def val_type(spark, sf):
    df = load_events(spark, sf).select("event_id", F.expr(NUM2.format(s="STRING")).alias("n2"))
    return va.run_checks(df, [rule("n2", "type_check", "fix", type="number")]).select("event_id", "n2", "rejected", "warned")


@query("val_range", with_ev("SELECT event_id, greatest(5::DOUBLE, least(100::DOUBLE, amount)) * (amount / amount) AS amount, false AS rejected, coalesce(amount < 5 OR amount > 100, false) AS warned FROM ev"))
def val_range(spark, sf):
    return _checked(spark, sf, [rule("amount", "range", "fix", min=5, max=100)], "amount")


@query("val_regex", with_ev("SELECT event_id, ip, NOT regexp_matches(ip, '^10\\.0\\.[0-9]\\.') AS rejected, false AS warned FROM ev"))
def val_regex(spark, sf):
    return _checked(spark, sf, [rule("ip", "regex", "reject", pattern=r"10\.0\.[0-9]\.")], "ip")


@query("val_enum", with_ev("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'other' END AS event_type, false AS rejected, event_type NOT IN ('view', 'click') AS warned FROM ev"))
def val_enum(spark, sf):
    return _checked(spark, sf, [rule("event_type", "enum", "default", "other", values=["view", "click"])], "event_type")


@query("val_length", with_ev("SELECT event_id, substr(label, 1, 9) AS label, false AS rejected, coalesce(length(label) > 9 OR length(label) < 4, false) AS warned FROM mess", MESSY_SQL))
def val_length(spark, sf):
    return _checked(spark, sf, [rule("label", "length", "fix", min=4, max=9)], "label")


@query("val_date_format", with_ev("SELECT event_id, try_strptime(day, '%d/%m/%Y') IS NULL AS rejected, false AS warned FROM mess", MESSY_SQL))
def val_date_format(spark, sf):
    return _checked(spark, sf, [rule("day", "date_format", "reject", format="%d/%m/%Y")])


@query("val_unique", with_ev("SELECT event_id, amount, amount IS NOT NULL AND count(*) OVER (PARTITION BY amount) > 1 AS duplicate FROM ev"))
def val_unique(spark, sf):
    return va.flag_duplicates(load_events(spark, sf).select("event_id", "amount"), "amount", F.col("event_id"))


# The rule counts what the fix before it left; the one after it sees its default.
UNIQUE = [
    rule("amount", "range", "fix", min=50), rule("amount", "unique", "warn"), rule("amount", "range", "reject", max=80),
]
ACTIONS = {"reject": None, "warn": None, "fix": None, "default": "81", "skip_field": None}


@query("val_unique_in_list", with_ev("""
SELECT event_id, action, CASE WHEN twice AND action = 'default' THEN 81 WHEN twice AND action = 'skip_field' THEN NULL ELSE x END AS amount,
  (twice AND action = 'reject') OR coalesce(CASE WHEN twice AND action = 'default' THEN 81 WHEN twice AND action = 'skip_field' THEN NULL ELSE x END > 80, false) AS rejected,
  x IS DISTINCT FROM amount AS fixed FROM
(SELECT event_id, amount, greatest(amount, CASE WHEN amount IS NOT NULL THEN 50 END) AS x,
  amount IS NOT NULL AND count(*) OVER (PARTITION BY greatest(amount, CASE WHEN amount IS NOT NULL THEN 50 END)) > 1 AS twice FROM ev),
(SELECT unnest(['reject', 'warn', 'fix', 'default', 'skip_field']) AS action)"""))
def val_unique_in_list(spark, sf):
    """A ``unique`` rule between other rules, once with each action."""
    events = load_events(spark, sf).select("event_id", "amount")
    parts = []
    for action, default in ACTIONS.items():
        rules = [{**r, "on_failure": action, "default_value": default} if r["rule_type"] == "unique" else r for r in UNIQUE]
        out = va.run_checks(events, rules)
        fixed = F.exists("issues", lambda i: (i["action"] == "fix") & (i["rule_type"] == "range"))
        parts.append(out.select("event_id", F.lit(action).alias("action"), "amount", "rejected", fixed.alias("fixed")))
    return reduce(DataFrame.unionByName, parts)


# The second range rule sees what the first one fixed; skip_field clears, reject drops.
FOLD = [
    rule("amount", "required", "reject"),
    rule("amount", "range", "fix", min=5),
    rule("amount", "range", "warn", min=5, max=90),
    rule("label", "not_empty", "default", "blank"),
    rule("label", "regex", "skip_field", pattern=r"\s*Ab-[0-4]|blank"),
    rule("event_type", "enum", "reject", values=["view", "click", "payment", "auth_failure"], severity="error"),
]
FOLD_SQL = f"""fold AS (SELECT event_id, amount, event_type, label, amount IS NULL AS i0, coalesce(amount < 5, false) AS i1, coalesce(greatest(amount, 5) > 90, false) AS i2,
  NOT coalesce({PRESENT}, false) AS i3, coalesce({PRESENT}, false) AND NOT regexp_matches(label, '^(\\s*Ab-[0-4]|blank)') AS i4,
  event_type NOT IN ('view', 'click', 'payment', 'auth_failure') AS i5 FROM mess)"""


@query("validate_apply", with_ev("""
SELECT event_id, CASE WHEN i1 THEN 5 ELSE amount END AS amount, CASE WHEN i3 THEN 'blank' WHEN i4 THEN NULL ELSE label END AS label,
  i1 OR i2 OR i3 OR i4 AS warned FROM fold WHERE NOT i0 AND NOT i5""", MESSY_SQL, FOLD_SQL))
def validate_apply(spark, sf):
    checked = va.run_checks(messy(spark, sf), FOLD)
    return checked.where("NOT rejected").select("event_id", "amount", "label", "warned")


@query("validation_issues", with_ev("""
SELECT event_id, 'amount' AS field, 'amount required' AS rule, 'required' AS rule_type, 'warning' AS severity, NULL AS original, NULL AS fixed, 'reject' AS action FROM fold WHERE i0
UNION ALL SELECT event_id, 'amount', 'amount range', 'range', 'warning', CAST(amount AS VARCHAR), '5', 'fix' FROM fold WHERE i1
UNION ALL SELECT event_id, 'amount', 'amount range', 'range', 'warning', CAST(amount AS VARCHAR), NULL, 'warn' FROM fold WHERE i2
UNION ALL SELECT event_id, 'label', 'label not_empty', 'not_empty', 'warning', label, 'blank', 'default' FROM fold WHERE i3
UNION ALL SELECT event_id, 'label', 'label regex', 'regex', 'warning', label, NULL, 'skip_field' FROM fold WHERE i4
UNION ALL SELECT event_id, 'event_type', 'event_type enum', 'enum', 'error', event_type, NULL, 'reject' FROM fold WHERE i5""", MESSY_SQL, FOLD_SQL))
def validation_issues(spark, sf):
    return va.issue_rows(va.run_checks(messy(spark, sf), FOLD)).drop("message")


@query("validate_builtin", with_ev("""
SELECT count(*) AS total_rows, count(*) AS valid_rows, 0 AS rejected_rows, count(*) FILTER (NOT regexp_full_match(origin, '[A-Z]{3}')
  OR NOT regexp_full_match(dest, '[A-Z]{3}') OR NOT (length(country) BETWEEN 2 AND 3) OR coalesce(amount < 0, false)
  OR coalesce(abs(geo_lat) > 90 OR abs(geo_lon) > 180, false)) AS warning_rows FROM ev"""))
def validate_builtin(spark, sf):
    return va.check_counts(va.run_checks(load_events(spark, sf), va.BUILTIN_CHECKS))


@query("upload_expressions", with_ev(f"SELECT event_id, round({NUM}, 6) AS num FROM mess", MESSY_SQL))
def upload_expressions(spark, sf):
    out = mp.apply_mapping(messy(spark, sf), {"num": "num"}, {"num": "try_float"}, keep=["event_id"])
    return out.withColumn("num", r("num"))
