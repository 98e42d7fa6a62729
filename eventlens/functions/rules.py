"""Nested AND/OR/NOT rules compiled to Columns; the same code serves streams."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.predicates import equals, in_list, is_nullish, not_in_list, settled
from eventlens.functions.scales import SEVERITY_RANK

MATCH = (
    "struct<rule_id:string,rule_name:string,severity:string,description:string,"
    "tags:array<string>,actions:array<string>,score_contribution:double>"
)

# The built-in rule set. ``${country}`` names a column.
BUILTIN_RULES = [
    {"id": "impossible_travel", "name": "Impossible Travel", "severity": "high",
     "description": "Travel speed exceeds physically possible limits (>900 km/h)",
     "conditions": {"operator": "AND", "rules": [
         {"field": "speed_kmh", "op": "gt", "value": 900},
         {"field": "dist_prev_km", "op": "gt", "value": 100}]},
     "tags": ["velocity", "geo", "ato"], "score_contribution": 0.3},
    {"id": "new_device_high_value", "name": "New Device High Value Transaction", "severity": "high",
     "description": "First-time device used for high-value transaction",
     "conditions": {"operator": "AND", "rules": [
         {"field": "is_new_device", "op": "eq", "value": 1},
         {"field": "amount", "op": "gt", "value": 1000}]},
     "tags": ["device", "amount", "ato"], "score_contribution": 0.25},
    {"id": "rapid_failures", "name": "Rapid Authentication Failures", "severity": "medium",
     "description": "Multiple failed authentication attempts detected",
     "conditions": {"operator": "AND", "rules": [
         {"field": "event_type", "op": "contains", "value": "fail"},
         {"field": "z_fail", "op": "gt", "value": 2.5}]},
     "tags": ["auth", "brute_force"], "score_contribution": 0.2},
    {"id": "far_from_home", "name": "Far From Home Location", "severity": "medium",
     "description": "Activity from location far from user's typical location",
     "conditions": {"operator": "AND", "rules": [
         {"field": "dist_home_km", "op": "gt", "value": 2000}]},
     "tags": ["geo", "location"], "score_contribution": 0.15},
    {"id": "new_ip_new_device", "name": "New IP and New Device Combination", "severity": "high",
     "description": "Both IP and device are new for this user",
     "conditions": {"operator": "AND", "rules": [
         {"field": "is_new_ip", "op": "eq", "value": 1},
         {"field": "is_new_device", "op": "eq", "value": 1}]},
     "tags": ["device", "ip", "ato"], "score_contribution": 0.25},
    {"id": "unusual_hour", "name": "Unusual Activity Hour", "severity": "low",
     "description": "Activity during rare hours for this user",
     "conditions": {"operator": "AND", "rules": [
         {"field": "hour_rarity", "op": "gt", "value": 3.0}]},
     "tags": ["temporal", "behavior"], "score_contribution": 0.1},
    {"id": "high_anomaly_score", "name": "High ML Anomaly Score", "severity": "medium",
     "description": "Machine learning model flagged as highly anomalous",
     "conditions": {"operator": "AND", "rules": [
         {"field": "anom_score", "op": "gte", "value": 0.8}]},
     "tags": ["ml", "anomaly"], "score_contribution": 0.2},
    {"id": "country_mismatch", "name": "Country Mismatch", "severity": "medium",
     "description": "Card country differs from transaction country",
     "conditions": {"operator": "AND", "rules": [
         {"field": "card_country", "op": "is_not_null", "value": None},
         {"field": "country", "op": "is_not_null", "value": None},
         {"field": "card_country", "op": "ne", "value": "${country}"}]},
     "tags": ["geo", "card", "payment"], "score_contribution": 0.15},
]

_COMPARE = {
    "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b,
}


def rule_field(df: DataFrame, name: str) -> Column | None:
    """A column, a struct path, or a path into a JSON text column."""
    if name in df.columns:
        return F.col(name)
    head, _, path = name.partition(".")
    if path and head in df.columns:
        if dict(df.dtypes)[head].startswith("struct"):
            return F.col(name)
        return F.get_json_object(head, f"$.{path}")
    return None


def operand(df: DataFrame, value: Any) -> Column:
    """A literal, or another column written ``${name}``."""
    if isinstance(value, str):
        ref = re.fullmatch(r"\$\{([A-Za-z0-9_.]+)\}", value)
        if ref:
            col = rule_field(df, ref.group(1))
            return col if col is not None else F.lit(None).cast("string")
    return F.lit(value)


def _value(df: DataFrame, value: Any) -> Any:
    """A plain value stays one, so that a value of another type than the column's can be told."""
    return operand(df, value) if isinstance(value, str) and value.startswith("${") else value


def ordered(col: Column, op: str, other: Column) -> Column:
    """Numbers where both sides are numbers, else text."""
    a, b = col.cast("string").try_cast("double"), other.cast("string").try_cast("double")
    return F.when(
        a.isNotNull() & b.isNotNull(), ~F.isnan(a) & ~F.isnan(b) & _COMPARE[op](a, b)
    ).otherwise(_COMPARE[op](col.cast("string"), other.cast("string")))


def rule_condition(df: DataFrame, cond: Mapping) -> Column:
    """One leaf; a missing field counts as NULL, NULL fails all but null checks."""
    op = cond["op"]
    col = rule_field(df, cond["field"])
    if col is None:
        return F.lit(op == "is_null")
    null = is_nullish(col)
    if op == "is_null":
        return null
    if op == "is_not_null":
        return ~null
    value = cond.get("value")
    low = F.lower(col.cast("string"))
    needle = str(value).lower()
    if op == "eq":
        test = equals(col, _value(df, value))
    elif op == "ne":
        test = ~settled(equals(col, _value(df, value)))
    elif op in _COMPARE:
        test = ordered(col, op, operand(df, value))
    elif op == "contains":
        test = low.contains(needle)
    elif op == "not_contains":
        test = ~low.contains(needle)
    elif op == "startswith":
        test = low.startswith(needle)
    elif op == "endswith":
        test = low.endswith(needle)
    elif op == "matches":
        test = col.cast("string").rlike(f"(?i){value}")
    elif op == "in":
        test = in_list(col, value)
    elif op == "not_in":
        test = not_in_list(col, value)
    elif op in ("between", "not_between"):
        test = ordered(col, "gte", operand(df, value)) & ordered(col, "lte", operand(df, cond.get("value2")))
        test = test if op == "between" else ~test
    else:
        raise ValueError(f"unknown rule operator {op!r}")
    return settled(~null & test)


def rule_tree(df: DataFrame, node: Mapping) -> Column:
    """Groups nest freely; NOT negates its first child; an empty group holds."""
    if "rules" not in node and "conditions" not in node:
        return rule_condition(df, node) if node else F.lit(True)
    children = [rule_tree(df, c) for c in (node.get("rules") or node.get("conditions") or [])]
    if not children:
        return F.lit(True)
    kind = node.get("operator", "AND").upper()
    if kind == "NOT":
        return ~children[0]
    return reduce((lambda a, b: a & b) if kind == "AND" else (lambda a, b: a | b), children)


def _match(rule: Mapping) -> Column:
    def texts(values: Sequence[str]) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    return F.struct(
        F.lit(rule["id"]).alias("rule_id"), F.lit(rule["name"]).alias("rule_name"),
        F.lit(rule.get("severity", "medium").lower()).alias("severity"),
        F.lit(rule.get("description", "")).alias("description"),
        texts(rule.get("tags", [])).alias("tags"), texts(rule.get("actions", ["flag"])).alias("actions"),
        F.lit(float(rule.get("score_contribution", 0.0))).alias("score_contribution"),
    ).cast(MATCH)


def enabled(rules: Sequence[Mapping], ids: Sequence[str] | None = None) -> list[Mapping]:
    return [r for r in rules if r.get("enabled", True) and (ids is None or r["id"] in ids)]


def evaluate_rules(df: DataFrame, rules: Sequence[Mapping], ids: Sequence[str] | None = None) -> DataFrame:
    """Adds rule_matches, rule_ids, rule_severity, rule_score, rule_tags in one projection."""
    active = enabled(rules, ids)
    if not active:
        matches = F.array().cast(f"array<{MATCH}>")
    else:
        matches = F.array_compact(F.array(*[F.when(rule_tree(df, r["conditions"]), _match(r)) for r in active]))
    out = df.withColumn("rule_matches", matches)
    m = F.col("rule_matches")
    level = F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])
    names = F.create_map(*[F.lit(x) for k, v in SEVERITY_RANK.items() for x in (v, k)])
    return out.withColumns({
        "rule_ids": F.transform(m, lambda r: r["rule_id"]),
        # A severity outside the known ones ranks lowest.
        "rule_severity": F.when(F.size(m) > 0, F.coalesce(
            names[F.array_max(F.transform(m, lambda r: level[r["severity"]]))], F.get(m, 0)["severity"])),
        "rule_score": F.aggregate(m, F.lit(0.0), lambda acc, r: acc + r["score_contribution"]),
        "rule_tags": F.array_sort(F.array_distinct(F.flatten(F.transform(m, lambda r: r["tags"])))),
    })


def match_rates(df: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """(rule_id, matches, match_rate): all rules counted in one aggregate."""
    active = enabled(rules)
    counted = df.agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(rule_tree(df, r["conditions"])).alias(f"m{i}") for i, r in enumerate(active)
    ])
    rows = F.array(*[F.struct(F.lit(r["id"]).alias("rule_id"), F.col(f"m{i}").alias("matches")) for i, r in enumerate(active)])
    return counted.select("n", F.explode(rows).alias("r")).select(
        "r.rule_id", "r.matches", F.try_divide(F.col("r.matches").cast("double"), F.col("n")).alias("match_rate")
    )


def match_audit(evaluated: DataFrame) -> DataFrame:
    """One fact row per (event, matched rule)."""
    # An outer explode: a plain one would add a filter that evaluates all rules twice.
    rows = evaluated.select("event_id", "user_id", "ts", F.explode_outer("rule_matches").alias("m"))
    return rows.where(F.col("m.rule_id").isNotNull()).select(
        "event_id", "user_id", "ts", "m.rule_id", "m.rule_name", "m.severity", "m.score_contribution", "m.tags"
    )


def rules_summary(evaluated: DataFrame) -> DataFrame:
    """Matches by severity and tag."""
    audit = match_audit(evaluated)
    return audit.select("severity", F.explode("tags").alias("tag"), "score_contribution").groupBy("severity", "tag").agg(
        F.count(F.lit(1)).alias("matches"), F.sum("score_contribution").alias("score")
    )
