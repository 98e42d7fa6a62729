"""Ingest mapping: apply, preview, remap, suggest, score, match templates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.expressions import map_expression, to_datetime
from eventlens.functions.predicates import is_nullish

# Name patterns per target field, in target order.
SYNONYMS = {
    "ts": r"\b(ts|timestamp|time|datetime|event[_]?time|@timestamp|created[_]?at|occurred[_]?at|date)\b",
    "event_type": r"\b(event[_]?type|etype|type|action|event[_]?name|operation|activity)\b",
    "user_id": r"\b(user[_]?id|userid|uid|username|login|user|principal|actor|lss[_]?user|sign[_]?user|customer[_]?id)\b",
    "account_id": r"\b(account[_]?id|acct[_]?id|account|customer|cust[_]?id|client[_]?id)\b",
    "device_id": r"\b(device[_]? id|did|device|device[_]?fingerprint|fingerprint|dfp|dev[_]?id|hardware[_]?id)\b",
    "session_id": r"\b(session[_]?id|sid|session|sess[_]?id|visit[_]?id)\b",
    "request_id": r"\b(request[_]? id|rid|req[_]?id|trace[_]?id|correlation[_]?id|transaction[_]?id)\b",
    "ip": r"\b(ip|ip[_]?addr(ess)?|client[_]?ip|source[_]?ip|src[_]?ip|remote[_]?ip|user[_]?ip)\b",
    "user_agent": r"\b(user[_]?agent|ua|agent|http[_]?user[_]?agent|browser)\b",
    "pnr": r"\b(pnr|booking[_]?id|reservation[_]?id|recloc|reclocator|confirmation[_]?number|booking[_]?ref)\b",
    "tkt_number": r"\b(tkt[_]?number|ticket[_]?number|eticket[_]?number|document[_]?number|ticket[_]?no)\b",
    "carrier": r"\b(carrier|airline[_]?code|marketing[_]?carrier|operating[_]?carrier|airline)\b",
    "origin": r"\b(origin|orig|from|departure[_]?airport|dep[_]?airport|departure[_]?city|dep[_]?city)\b",
    "dest": r"\b(dest|destination|to|arrival[_]? airport|arr[_]?airport|arrival[_]?city|arr[_]?city)\b",
    "dep_time": r"\b(dep[_]?time|departure[_]?time|depart[_]?time|flight[_]?departure|std|scheduled[_]?departure)\b",
    "arr_time": r"\b(arr[_]?time|arrival[_]? time|flight[_]?arrival|sta|scheduled[_]?arrival)\b",
    "legs": r"\b(legs|segments|itinerary|flight[_]?legs|routing|flight[_]?segments)\b",
    "office_id": r"\b(office[_]? id|office|issuing[_]?office|agent[_]?office|oid|pos[_]?id|agency[_]?id)\b",
    "user_sign": r"\b(user[_]?sign|agent[_]?sign|sign|agent[_]?code|sine|agent[_]?id)\b",
    "organization": r"\b(organization|agency|company|org|iata[_]?number|agency[_]?name|org[_]?name)\b",
    "amount": r"\b(amount|value|price|fare|total[_]?amount|amt|transaction[_]?amount|sum|total)\b",
    "currency": r"\b(currency|ccy|cur|iso[_]?currency|currency[_]?code)\b",
    "payment_method": r"\b(payment[_]? method|pay[_]?method|fop|form[_]?of[_]?payment|payment[_]? type)\b",
    "card_hash": r"\b(card[_]? hash|pan[_]?hash|cc[_]?hash|card[_]?fingerprint|pan|card[_]?token)\b",
    "fop_type": r"\b(fop[_]?type|fop[_]?code|payment[_]?type[_]?code)\b",
    "fop_name": r"\b(fop[_]?name|payment[_]?type[_]?name)\b",
    "fop_subtype": r"\b(fop[_]?subtype|card[_]?type|card[_]?brand)\b",
    "card_last4": r"\b(card[_]?last[_]?4|last[_]?4|card[_]?suffix)\b",
    "card_bin": r"\b(card[_]? bin|bin|card[_]?prefix|issuer[_]?id)\b",
    "geo_lat": r"\b(geo[_]? lat|lat|latitude|y[_]?coord)\b",
    "geo_lon": r"\b(geo[_]? lon|lng|lon|longitude|x[_]?coord)\b",
    "country": r"\b(country|country[_]?code|country[_]?iso2|ctry|nation)\b",
    "city": r"\b(city|locality|town|municipality)\b",
    "region": r"\b(region|state|province|county|district)\b",
    "pos_country": r"\b(pos[_]?country|pos[_]?ctry|pos[_]?country[_]?code|point[_]?of[_]?sale[_]?country)\b",
    "issue_country": r"\b(issue[_]?country|issue[_]?ctry|issue[_]?country[_]?code|issuing[_]?country)\b",
    "card_country": r"\b(card[_]?country|card[_]?ctry|card[_]?country[_]?code|bin[_]?country|issuer[_]?country)\b",
    "advance_hours": r"\b(advance[_]?hours|advance|lead[_]?time|hours[_]?to[_]?departure|booking[_]?lead|advance[_]?purchase)\b",
    "stay_nights": r"\b(stay[_]?nights|nights|stay|length[_]?of[_]?stay|los|duration[_]?nights)\b",
    "order_id": r"\b(order[_]?id|order|order[_]?number|purchase[_]?id)\b",
    "refund_id": r"\b(refund[_]?id|refund|refund[_]?number|reversal[_]?id)\b",
    "status": r"\b(status|result|outcome|state|response[_]?code|event[_]?status)\b",
    "failure_reason": r"\b(failure[_]? reason|fail[_]?reason|error[_]?reason|reject[_]?reason|decline[_]?reason|error[_]?message)\b",
    "is_unusual": r"\b(is[_]?unusual|unusual|anomaly|anomalies|flag|suspicious)\b",
    "is_vpn": r"\b(is[_]?vpn|vpn|vpn[_]?detected|proxy|tor|vpn[_]?flag)\b",
    "is_fraud_indicator": r"\b(is[_]?fraud[_]? indicator|fraud[_]?indicator|fraud[_]?flag|is[_]?fraud|fraud[_]?score|risk[_]?flag)\b",
}

# Expression suggested for a mapped target.
SUGGESTED_EXPRESSION = {
    **dict.fromkeys(["amount", "geo_lat", "geo_lon", "advance_hours", "stay_nights"], "try_float"),
    **dict.fromkeys(
        ["country", "currency", "carrier", "origin", "dest", "pos_country", "card_country", "issue_country"], "upper"
    ),
    **dict.fromkeys(["is_unusual", "is_vpn", "is_fraud_indicator"], "bool"),
}


def apply_mapping(
    df: DataFrame, mapping: Mapping[str, str], expressions: Mapping[str, Any] | None = None,
    defaults: Mapping[str, Any] | None = None, keep: Sequence[str] = (),
) -> DataFrame:
    """One projection: target <- source column, then its expression, then its default.

    Sources that do not exist are skipped. An expression that gives NULL keeps
    the mapped value. Names in expressions resolve to source columns first and
    to mapped targets second.
    """
    expressions, defaults = expressions or {}, defaults or {}
    mapped = {t: F.col(s) for t, s in mapping.items() if s in df.columns}
    lookup = {**mapped, **{c: F.col(c) for c in df.columns}}
    targets = list(dict.fromkeys([*mapped, *expressions, *defaults]))
    columns = []
    for target in targets:
        own = mapped.get(target)
        value = own if own is not None else F.lit(None).cast("string")
        if target in expressions:
            made = map_expression(expressions[target], own, lookup)
            if isinstance(expressions[target], Mapping) and own is not None:
                made_type = df.select(made.alias("c")).schema["c"].dataType
                made = F.coalesce(made, own.try_cast(made_type))
            value = made
        if target in defaults:
            value = F.when(is_nullish(value), F.lit(str(defaults[target]))).otherwise(value.cast("string"))
        columns.append(value.alias(target))
    return df.select(*[F.col(c) for c in keep], *columns)


def pack_unmapped(df: DataFrame, used: Sequence[str], keep: Sequence[str], name: str = "meta") -> DataFrame:
    """Columns no mapping uses, packed as one JSON text."""
    rest = [c for c in df.columns if c not in used and c not in keep]
    return df.select(*keep, *[c for c in used if c not in keep], F.to_json(F.struct(*rest)).alias(name))


def ingest(
    df: DataFrame, mapping: Mapping[str, str], source: str, expressions: Mapping[str, Any] | None = None,
    known: Sequence[str] | None = None, keep: Sequence[str] = (),
) -> DataFrame:
    """Map an upload: ts and event_type are required, ts is parsed, source stamped."""
    usable = {t: s for t, s in mapping.items() if s in df.columns}
    missing = [t for t in ("ts", "event_type") if t not in usable]
    if missing:
        raise ValueError(f"mapping lacks required targets: {missing}")
    out = apply_mapping(df, usable, expressions, keep=keep)
    if not dict(out.dtypes)["ts"].startswith("timestamp"):
        out = out.withColumn("ts", to_datetime(F.col("ts")))
    out = out.withColumn("source", F.lit(source))
    return out.select(*keep, *[c for c in out.columns if c not in keep and (known is None or c in known)])


def catalog_of(payloads: DataFrame, dataset: str, payload: str) -> DataFrame:
    """(dataset, column, place): the distinct field names found in JSON records, and their order in the fullest record."""
    names = payloads.select(F.col(dataset).alias("dataset"), F.posexplode(F.json_object_keys(payload)).alias("pos", "column"))
    return names.groupBy("dataset", "column").agg(F.max("pos").alias("place"))


def _placed(catalog: DataFrame) -> DataFrame:
    """A catalog without places is in the order of names."""
    return catalog if "place" in catalog.columns else catalog.withColumn("place", F.lit(0))


def name_matches(catalog: DataFrame) -> DataFrame:
    """(dataset, column, target, score): every pattern tried on every column name.

    The 46 fixed patterns travel inside the expression, so nothing is joined.
    """
    tried = F.array(*[
        F.struct(
            F.lit(target).alias("target"), F.lit(i).alias("target_order"),
            F.regexp_extract(F.lower(F.trim("column")), pattern, 0).alias("hit"),
        )
        for i, (target, pattern) in enumerate(SYNONYMS.items())
    ])
    rows = _placed(catalog).select("dataset", "column", "place", F.explode(tried).alias("t")).where(F.col("t.hit") != "")
    share = F.length("t.hit") / F.length(F.trim("column"))
    return rows.select("dataset", "column", "place", "t.target", "t.target_order", share.alias("score"))


def mapping_scores(catalog: DataFrame, floor: float = 0.1, n: int = 5) -> DataFrame:
    """The n best columns per target; ties by name."""
    good = name_matches(catalog).where(F.col("score") > floor)
    rank = F.row_number().over(Window.partitionBy("dataset", "target").orderBy(F.desc("score"), "column"))
    return good.withColumn("rank", rank).where(F.col("rank") <= n).select(
        "dataset", "target", "column", F.round("score", 3).alias("score"), "rank"
    )


def suggest_mapping(catalog: DataFrame) -> DataFrame:
    """(dataset, target, column, expression): first matching column per target, in the order of the file.

    ``ts`` falls back to the first column and ``event_type`` to ``event``. A
    missing user is built from account and device, or taken from the agent sign.
    """
    first = name_matches(catalog).groupBy("dataset", "target").agg(F.min_by("column", F.struct("place", "column")).alias("column"))
    found = first.groupBy("dataset").agg(
        F.map_from_entries(F.collect_list(F.struct("target", "column"))).alias("m")  # at most one entry per target
    )
    datasets = _placed(catalog).groupBy("dataset").agg(F.min_by("column", F.struct("place", "column")).alias("__first"))
    joined = datasets.join(found, "dataset", "left")
    m = F.coalesce("m", F.create_map().cast("map<string,string>"))

    def entry(target: str, column: Column, expression: Column) -> Column:
        return F.struct(F.lit(target).alias("target"), column.alias("column"), expression.alias("expression"))

    none = F.lit(None).cast("string")
    entries = [
        entry("ts", F.coalesce(m["ts"], F.col("__first")), none),
        entry("event_type", F.coalesce(m["event_type"], F.lit("event")), none),
        entry("source_value", F.lit("csv_upload"), none),
    ]
    for target in SYNONYMS:
        if target in ("ts", "event_type", "user_id"):
            continue
        entries.append(F.when(m[target].isNotNull(), entry(target, m[target], F.lit(SUGGESTED_EXPRESSION.get(target)).cast("string"))))
    both = m["account_id"].isNotNull() & m["device_id"].isNotNull()
    entries.append(
        F.when(m["user_id"].isNotNull(), entry("user_id", m["user_id"], none))
        .when(both, entry("user_id", none, F.concat(F.lit("concat:-:"), m["account_id"], F.lit(","), m["device_id"])))
        .when(m["user_sign"].isNotNull(), entry("user_id", m["user_sign"], none))
    )
    return joined.select("dataset", F.explode(F.array_compact(F.array(*entries))).alias("e")).select("dataset", "e.*")


def template_match(files: DataFrame, templates: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(dataset, template, score, matched, missing).

    ``files`` is (dataset, columns), ``templates`` is (template, sample_columns,
    mapping_sources), arrays of lower-case names. Only pairs that share a name
    are formed: without one the score is zero.
    """
    t = templates.withColumn("expected", F.array_union("sample_columns", "mapping_sources"))
    shared = (
        files.select("dataset", F.explode("columns").alias("name"))
        .join(t.select("template", F.explode("expected").alias("name")), "name")
        .select("dataset", "template").distinct()
    )
    pairs = shared.join(files, "dataset").join(t, "template")
    both, either = F.array_intersect("columns", "expected"), F.array_union("columns", "expected")
    covered = F.size(F.array_intersect("columns", "mapping_sources"))
    coverage = F.coalesce(F.try_divide(covered.cast("double"), F.size("mapping_sources").cast("double")), F.lit(0.0))
    score = F.size(both) / F.size(either) * 0.4 + coverage * 0.6
    return pairs.withColumn("raw", score).where(F.col("raw") >= threshold).select(
        "dataset", "template", F.round("raw", 3).alias("score"),
        F.array_join(F.array_sort(both), ",").alias("matched"),
        F.array_join(F.array_sort(F.array_except("expected", "columns")), ",").alias("missing"),
    )
