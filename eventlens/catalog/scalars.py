"""Scalar functions of transform steps and mapping expressions."""

from pyspark.sql import functions as F

from eventlens.catalog.common import epoch, load_events, r, with_ev
from eventlens.functions import expressions as ex
from eventlens.operators.steps import transform
from eventlens.registry import query


def _steps(spark, sf, columns, *keep):
    out = transform(load_events(spark, sf), columns)
    return out.select("event_id", *[c["name"] for c in columns], *keep)


def fn(name, func, *args):
    return {"name": name, "fn": func, "args": list(args)}


@query("fn_string", with_ev("SELECT event_id, upper(device_id) AS up, lower(country) AS low, trim(event_type) AS tr, length(ip)::INT AS len FROM ev"))
def fn_string(spark, sf):
    return _steps(spark, sf, [fn("up", "upper", "device_id"), fn("low", "lower", "country"), fn("tr", "trim", "event_type"), fn("len", "length", "ip")])


@query("fn_concat", with_ev("SELECT event_id, concat(user_id, '-', coalesce(device_id, ''), '/', country) AS tag FROM ev"))
def fn_concat(spark, sf):
    return _steps(spark, sf, [fn("tag", "concat", "user_id", "'-'", "device_id", "/", "country")])


@query("fn_coalesce", with_ev("SELECT event_id, coalesce(card_hash, device_id, 'none') AS pick FROM ev"))
def fn_coalesce(spark, sf):
    return _steps(spark, sf, [fn("pick", "coalesce", "card_hash", "device_id", "'none'")])


@query("fn_date", with_ev("""
SELECT event_id, hour(ts)::INT AS h, strftime(ts, '%Y-%m-%d') AS d, ((dayofweek(ts) + 6) % 7)::INT AS dow, year(ts)::INT AS y, month(ts)::INT AS m, day(ts)::INT AS dd FROM ev"""))
def fn_date(spark, sf):
    out = _steps(spark, sf, [fn("h", "hour", "ts"), fn("d", "date", "ts"), fn("dow", "dayofweek", "ts"), fn("y", "year", "ts"), fn("m", "month", "ts"), fn("dd", "day", "ts")])
    return out.withColumn("d", F.col("d").cast("string"))


@query("fn_math", with_ev("""
SELECT event_id, round_even(amount, 1) AS r1, abs(geo_lat) AS a, floor(geo_lon) AS f, ceil(geo_lon) AS c FROM ev"""))
def fn_math(spark, sf):
    return _steps(spark, sf, [fn("r1", "round", "amount", 1), fn("a", "abs", "geo_lat"), fn("f", "floor", "geo_lon"), fn("c", "ceil", "geo_lon")])


@query("fn_null", with_ev("SELECT event_id, device_id IS NULL AS no_device, amount IS NOT NULL AS paid, coalesce(card_hash, 'x') AS card FROM ev"))
def fn_null(spark, sf):
    return _steps(spark, sf, [fn("no_device", "isnull", "device_id"), fn("paid", "notnull", "amount"), fn("card", "ifnull", "card_hash", "'x'")])


@query("fn_arith", with_ev("""
SELECT event_id, round(amount + geo_lat, 6) AS s, round(amount - 3, 6) AS d, round(amount * geo_lon, 6) AS p,
  round(amount / nullif(event_id % 4, 0), 6) AS q, round(geo_lat - 7 * floor(geo_lat / 7), 6) AS m FROM ev"""))
def fn_arith(spark, sf):
    df = load_events(spark, sf).withColumn("four", F.col("event_id") % 4)
    specs = [("s", "+", "amount", "geo_lat"), ("d", "-", "amount", 3), ("p", "*", "amount", "geo_lon"), ("q", "/", "amount", "four"), ("m", "%", "geo_lat", 7)]
    out = transform(df, [{"name": n, "op": op, "args": [a, b]} for n, op, a, b in specs])
    return out.select("event_id", *[r(n).alias(n) for n, *_ in specs])


# Text columns with the mess real uploads have; one text for both engines.
K = {"spark": "CAST(get_json_object(meta, '$.k') AS BIGINT)", "duck": "CAST(json_extract_string(meta, '$.k') AS BIGINT)"}
MESSY = {
    "num": "CASE {k} % 7 WHEN 0 THEN concat('€ ', CAST({k} AS {s}), ',5') WHEN 1 THEN concat('1.', CAST(100 + {k} AS {s}), ',25') WHEN 2 THEN concat('1,', CAST(100 + {k} AS {s}), '.75') "
           "WHEN 3 THEN concat(' -', CAST({k} AS {s}), ' ') WHEN 4 THEN '' WHEN 5 THEN 'n/a' ELSE '12-3' END",
    "word": "CASE {k} % 8 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'off' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0' WHEN 4 THEN 'maybe' WHEN 5 THEN '   ' WHEN 6 THEN 'N' ELSE NULL END",
    "day": "CASE {k} % 7 WHEN 0 THEN '2024-02-03 04:05:06' WHEN 1 THEN '05/02/2024' WHEN 2 THEN '02/28/2024' WHEN 3 THEN '2024-03-04T05:06:07Z' WHEN 4 THEN 'soon' WHEN 5 THEN '13/01/2024 10:00:00' ELSE '2024-12-31' END",
    "label": "CASE WHEN {k} % 9 = 0 THEN '  ' WHEN {k} % 11 = 0 THEN NULL ELSE concat('  Ab-', CAST({k} AS {s}), ';x;', country, ' ') END",
}
MESSY_SQL = "mess AS (SELECT ev.*, " + ", ".join(f"{e.format(k=K['duck'], s='VARCHAR')} AS {n}" for n, e in MESSY.items()) + " FROM ev)"


def messy(spark, sf):
    df = load_events(spark, sf)
    return df.withColumns({n: F.expr(e.format(k=K["spark"], s="STRING")) for n, e in MESSY.items()})


def mapped(spark, sf, specs, own="label"):
    """``name: spec`` compiled against the messy rows."""
    df = messy(spark, sf)
    lookup = {c: F.col(c) for c in df.columns}
    return df.select("event_id", *[ex.map_expression(spec, F.col(own), lookup).alias(n) for n, spec in specs.items()])


NUM = """TRY_CAST(nullif(regexp_replace(CASE WHEN contains(trim(num), ',') AND contains(trim(num), '.') THEN
  CASE WHEN instr(reverse(num), ',') < instr(reverse(num), '.') THEN replace(replace(num, '.', ''), ',', '.') ELSE replace(num, ',', '') END
  ELSE replace(num, ',', '.') END, '[^0-9.+eE-]', '', 'g'), '') AS DOUBLE)"""


@query("expr_try_float", with_ev(f"SELECT event_id, {NUM} AS a, amount AS b FROM mess", MESSY_SQL))
def expr_try_float(spark, sf):
    return mapped(spark, sf, {"a": {"op": "try_float", "col": "num"}, "b": {"op": "try_float", "col": "amount"}})


@query("expr_try_int", with_ev(f"SELECT event_id, CAST(trunc({NUM}) AS BIGINT) AS a FROM mess", MESSY_SQL))
def expr_try_int(spark, sf):
    return mapped(spark, sf, {"a": {"op": "try_int", "col": "num"}})


@query("expr_bool", with_ev("""
SELECT event_id, CASE WHEN lower(trim(word)) IN ('true', '1', 'yes', 'y', 'on', 't') THEN true WHEN lower(trim(word)) IN ('false', '0', 'no', 'n', 'off', 'f') THEN false END AS a FROM mess""", MESSY_SQL))
def expr_bool(spark, sf):
    return mapped(spark, sf, {"a": {"op": "bool", "col": "word"}})


@query("expr_parse_date", with_ev("""
SELECT event_id, epoch_us(coalesce(try_strptime(day, '%Y-%m-%d %H:%M:%S'), try_strptime(day, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(day, '%Y-%m-%d'),
  try_strptime(day, '%d/%m/%Y %H:%M:%S'), try_strptime(day, '%d/%m/%Y'), try_strptime(day, '%m/%d/%Y'))) AS a, epoch_us(try_strptime(day, '%d/%m/%Y')) AS b FROM mess""", MESSY_SQL))
def expr_parse_date(spark, sf):
    out = mapped(spark, sf, {"a": {"op": "parse_date", "col": "day"}, "b": {"op": "parse_date", "col": "day", "format": "%d/%m/%Y"}})
    return out.select("event_id", epoch("a").alias("a"), epoch("b").alias("b"))


PRESENT = "label IS NOT NULL AND trim(label) <> ''"


@query("expr_case", with_ev(f"""
SELECT event_id, CASE WHEN {PRESENT} THEN lower(label) END AS lo, CASE WHEN {PRESENT} THEN upper(label) END AS up, CASE WHEN {PRESENT} THEN trim(label) END AS tr,
  CASE WHEN {PRESENT} THEN label ELSE '' END AS st FROM mess""", MESSY_SQL))
def expr_case(spark, sf):
    return mapped(spark, sf, {"lo": "lower", "up": {"op": "upper", "col": "label"}, "tr": "strip", "st": "str"})


@query("expr_affix", with_ev(f"""
SELECT event_id, CASE WHEN {PRESENT} THEN label ELSE 'none' END AS d, CASE WHEN {PRESENT} THEN label ELSE ' gap' END AS c,
  CASE WHEN {PRESENT} THEN 'p-' || label END AS p, CASE WHEN {PRESENT} THEN label || '-s' END AS s FROM mess""", MESSY_SQL))
def expr_affix(spark, sf):
    return mapped(spark, sf, {"d": "default:none", "c": "coalesce: gap", "p": "prefix:p-", "s": "suffix:-s"})


@query("expr_template", with_ev(f"SELECT event_id, concat('u', user_id, ':', CASE WHEN {PRESENT} THEN label ELSE '' END, '-', '$', country) AS t FROM mess", MESSY_SQL))
def expr_template(spark, sf):
    return mapped(spark, sf, {"t": "u${user_id}:${label}-${missing}$${country}"})


@query("expr_concat", with_ev(f"SELECT event_id, concat(user_id, '|', CASE WHEN {PRESENT} THEN label ELSE '' END, '|', coalesce(device_id, '')) AS t FROM mess", MESSY_SQL))
def expr_concat(spark, sf):
    return mapped(spark, sf, {"t": {"op": "concat", "sep": "|", "cols": ["user_id", "label", "device_id"]}})


@query("expr_coalesce", with_ev(f"SELECT event_id, CASE WHEN {PRESENT} THEN label ELSE coalesce(card_hash, 'dflt') END AS t FROM mess", MESSY_SQL))
def expr_coalesce(spark, sf):
    return mapped(spark, sf, {"t": {"op": "coalesce", "cols": ["label", "card_hash"], "default": "dflt"}})


@query("expr_substring", with_ev("SELECT event_id, substr(ip, 4, 3) AS a, substr(ip, 2, 3) AS b, substr(ip, 3) AS c FROM mess", MESSY_SQL))
def expr_substring(spark, sf):
    return mapped(spark, sf, {
        "a": {"op": "substring", "col": "ip", "start": 3, "length": 3}, "b": {"op": "substring", "col": "ip", "start": 1, "end": 4},
        "c": {"op": "substring", "col": "ip", "start": 2}})


@query("expr_replace", with_ev("SELECT event_id, replace(ip, '.', '-') AS a, regexp_replace(ip, '[0-9]+', 'N', 'g') AS b FROM mess", MESSY_SQL))
def expr_replace(spark, sf):
    return mapped(spark, sf, {
        "a": {"op": "replace", "col": "ip", "pattern": ".", "replacement": "-"},
        "b": {"op": "regex_replace", "col": "ip", "pattern": "[0-9]+", "replacement": "N"}})


@query("expr_regex_extract", with_ev(f"""
SELECT event_id, CASE WHEN {PRESENT} AND regexp_matches(label, 'Ab-([0-9]5)') THEN regexp_extract(label, 'Ab-([0-9]5)', 1) END AS a FROM mess""", MESSY_SQL))
def expr_regex_extract(spark, sf):
    return mapped(spark, sf, {"a": {"op": "regex_extract", "col": "label", "pattern": "Ab-([0-9]5)", "group": 1}})


@query("expr_split", with_ev(f"""
SELECT event_id, CASE WHEN {PRESENT} THEN trim(split(label, ';')[3]) END AS a, CAST(NULL AS VARCHAR) AS b FROM mess""", MESSY_SQL))
def expr_split(spark, sf):
    return mapped(spark, sf, {"a": {"op": "split", "col": "label", "sep": ";", "index": 2}, "b": {"op": "split", "col": "label", "sep": ";", "index": 9}})


IF_CASES = {
    "eq": ("country", "C3", "country = 'C3'"), "ne": ("device_id", "d7", "device_id IS DISTINCT FROM 'd7'"),
    "contains": ("ip", ".1", "contains(ip, '.1')"), "startswith": ("event_type", "auth", "starts_with(event_type, 'auth')"),
    "endswith": ("event_type", "e", "ends_with(event_type, 'e')"), "is_null": ("label", None, f"NOT ({PRESENT})"),
    "is_not_null": ("label", None, PRESENT), "gt": ("amount", 50, "coalesce(amount > 50, false)"),
    "gte": ("amount", "50", "coalesce(amount >= 50, false)"), "lt": ("user_id", 20, "CAST(user_id AS DOUBLE) < 20"),
    "lte": ("num", 5, "coalesce(TRY_CAST(num AS DOUBLE) <= 5, false)"), "in": ("carrier", ["X1", "X2"], "carrier IN ('X1', 'X2')"),
    "regex": ("ip", r"\.1[0-9]$", "regexp_matches(ip, '\\.1[0-9]$')"),
}


@query("expr_if_else", with_ev("SELECT event_id, " + ", ".join(f"CASE WHEN {sql} THEN 'T' ELSE 'F' END AS c_{n}" for n, (_, _, sql) in IF_CASES.items()) + " FROM mess", MESSY_SQL))
def expr_if_else(spark, sf):
    return mapped(spark, sf, {
        f"c_{n}": {"op": "if_else", "col": col, "condition": n, "value": value, "then": "T", "else": "F"}
        for n, (col, value, _) in IF_CASES.items()})


@query("expr_add_mul", with_ev(f"SELECT event_id, round(1.5 + coalesce(amount, 0) + coalesce({NUM}, 0), 6) AS s, round(2 * coalesce(amount, 1) * coalesce({NUM}, 1), 6) AS p FROM mess", MESSY_SQL))
def expr_add_mul(spark, sf):
    out = mapped(spark, sf, {"s": {"op": "add", "cols": ["amount", "num"], "constant": 1.5}, "p": {"op": "multiply", "cols": ["amount", "num"], "constant": 2}})
    return out.select("event_id", r("s").alias("s"), r("p").alias("p"))


@query("expr_divide", with_ev(f"SELECT event_id, round(amount / nullif({NUM}, 0), 6) AS q FROM mess", MESSY_SQL))
def expr_divide(spark, sf):
    return mapped(spark, sf, {"q": {"op": "divide", "numerator": "amount", "denominator": "num"}}).withColumn("q", r("q"))


@query("expr_round_abs", with_ev(f"SELECT event_id, round_even({NUM}, 1) AS r1, abs({NUM}) AS a FROM mess", MESSY_SQL))
def expr_round_abs(spark, sf):
    return mapped(spark, sf, {"r1": {"op": "round", "col": "num", "decimals": 1}, "a": {"op": "abs", "col": "num"}})


@query("expr_map", with_ev("SELECT event_id, CASE event_type WHEN 'view' THEN 'V' WHEN 'payment' THEN 'P' ELSE 'other' END AS code, CASE WHEN device_id IS NULL THEN 'none' WHEN device_id = 'd7' THEN 'seven' ELSE 'none' END AS dev FROM ev"))
def expr_map(spark, sf):
    return mapped(spark, sf, {
        "code": {"op": "map", "col": "event_type", "mapping": {"view": "V", "payment": "P"}, "default": "other"},
        "dev": {"op": "lookup", "col": "device_id", "mapping": {"d7": "seven"}, "default": "none"}})
