"""Sources, sinks and catalog."""

from pyspark.sql import functions as F

from eventlens.catalog.common import epoch, load_events, table, with_ev
from eventlens.functions.validation import BUILTIN_CHECKS, run_checks
from eventlens.registry import query
from eventlens.session import materialize, scratch_path
from eventlens.sources import formats, store

FROM, TO = "2024-01-05 00:00:00", "2024-01-12 00:00:00"


@query("scan_time_range", with_ev(
    f"SELECT event_id, user_id, event_type, us FROM ev WHERE ts BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}' AND source = 'auth_events'"))
def scan_time_range(spark, sf):
    rows = store.scan_range(load_events(spark, sf), FROM, TO, "auth_events")
    return rows.orderBy("ts", "event_id").select("event_id", "user_id", "event_type", epoch("ts").alias("us"))


@query("query_events", with_ev(
    f"SELECT event_id, user_id, event_type, ip FROM ev WHERE user_id = '8' AND source = 'web_events' AND ts >= TIMESTAMP '{FROM}' ORDER BY ts, event_id LIMIT 50"))
def query_events(spark, sf):
    rows = store.query_events(load_events(spark, sf), {"user_id": "8", "source": "web_events", "device_id": None}, FROM, None, 50)
    return rows.select("event_id", "user_id", "event_type", "ip")


PLAIN = ["event_id", "user_id", "event_type", "device_id", "ip", "amount", "meta"]
PLAIN_SCHEMA = "event_id bigint, user_id string, event_type string, device_id string, ip string, amount double, meta string"


def _round_trip(spark, sf, fmt):
    path = scratch_path(spark, fmt) + f".{'json' if fmt == 'json' else 'csv'}"
    formats.write_result(load_events(spark, sf).select(*PLAIN), path, fmt)
    return formats.read_any(spark, path, None, PLAIN_SCHEMA)


@query("read_csv_events", with_ev("SELECT event_id, user_id, event_type, device_id, ip, amount, meta FROM ev"))
def read_csv_events(spark, sf):
    return _round_trip(spark, sf, "csv")


@query("read_json_events", with_ev("SELECT event_id, user_id, event_type, device_id, ip, amount, meta FROM ev"))
def read_json_events(spark, sf):
    return _round_trip(spark, sf, "json")


@query("read_json_array", with_ev("SELECT event_id, user_id, event_type, device_id, ip, amount, meta FROM ev"))
def read_json_array(spark, sf):
    """One array in one file, read by byte ranges."""
    events = load_events(spark, sf).select(*PLAIN)
    record = F.to_json(F.struct(*PLAIN), {"ignoreNullFields": "false"})
    ends = events.agg(F.min("event_id"), F.max("event_id")).first()
    opened = F.when(F.col("event_id") == ends[0], "[").otherwise("")
    closed = F.when(F.col("event_id") == ends[1], "]").otherwise(",")
    path = scratch_path(spark, "array") + ".json"
    events.select("event_id", F.concat(opened, record, closed).alias("value")).coalesce(1).sortWithinPartitions("event_id").select("value").write.text(path)
    return formats.read_any(spark, path, None, PLAIN_SCHEMA)


@query("read_csv_encodings", with_ev("SELECT event_id, 'Zoë ' || event_type AS name FROM ev"))
def read_csv_encodings(spark, sf):
    """Half of the files in Latin-1, half in UTF-8."""
    events = load_events(spark, sf).select("event_id", F.concat(F.lit("Zoë "), "event_type").alias("name"))
    paths = []
    for part, encoding in enumerate(("UTF-8", "ISO-8859-1")):
        paths.append(scratch_path(spark, "names"))
        events.where(F.col("event_id") % 2 == part).write.option("header", True).option("encoding", encoding).csv(paths[-1])
    return formats.read_csv(spark, paths, "event_id bigint, name string")


@query("batch_load_sources", """
SELECT 'load:' || f AS source, count(*) AS rows_loaded, sum(length(text))::BIGINT AS chars FROM (
  SELECT 'documents' AS f, text FROM documents UNION ALL SELECT 'benchmark', text FROM benchmark
  UNION ALL SELECT 'conversations', text FROM conversations) GROUP BY f""")
def batch_load_sources(spark, sf):
    paths = [f"{sf}/{n}.parquet" for n in ("documents", "benchmark", "conversations")]
    rows = formats.read_batch(spark, paths, "load", "text string")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows_loaded"), F.sum(F.length("text")).alias("chars"))


@query("preview_dataset", "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id LIMIT 25")
def preview_dataset(spark, sf):
    df = formats.read_any(spark, f"{sf}/events.parquet")
    return formats.preview(df, 25, ["event_id"]).select("event_id", "user_id", "event_type", "value")


@query("load_travel_rows", with_ev("""
SELECT event_id, CAST(us // 1000000 AS VARCHAR) AS "timestamp", event_type AS etype, user_id, account_id,
  coalesce(device_id, '') AS device_id, ip, geo_lat, geo_lon, country, coalesce(amount, 0.0::DOUBLE) AS amount,
  origin AS m_origin, '' AS m_pnr, CAST(event_id % 400 AS BIGINT) AS m_advance, json_extract_string(legs, '$[1].dest') AS m_last_dest FROM ev"""))
def load_travel_rows(spark, sf):
    raw = load_events(spark, sf).select(
        "event_id", F.unix_seconds("ts").cast("string").alias("date"), F.col("event_type").alias("type"),
        F.col("user_id").alias("user"), F.col("account_id").alias("account"), F.col("device_id").alias("device"),
        F.col("ip").alias("ip_addr"), F.col("geo_lat").cast("string").alias("lat"), F.col("geo_lon").cast("string").alias("lon"),
        "country", F.col("amount").cast("string").alias("amount"), "origin", "dest", "carrier", "legs",
        F.concat((F.col("event_id") % 400).cast("string"), F.lit(".9")).alias("advance_hours"),
    )
    out = store.load_travel_rows(raw, ["event_id"])
    return out.select(
        "event_id", "timestamp", "etype", "user_id", "account_id", "device_id", "ip", "geo_lat", "geo_lon", "country", "amount",
        F.get_json_object("meta", "$.origin").alias("m_origin"), F.get_json_object("meta", "$.pnr").alias("m_pnr"),
        F.get_json_object("meta", "$.advance_hours").cast("bigint").alias("m_advance"),
        F.get_json_object("meta", "$.legs[1].dest").alias("m_last_dest"),
    )


@query("explode_legs", with_ev("""
SELECT event_id, 0 AS leg_no, json_extract_string(legs, '$[0].origin') AS leg_origin, json_extract_string(legs, '$[0].dest') AS leg_dest FROM ev
UNION ALL SELECT event_id, 1, json_extract_string(legs, '$[1].origin'), json_extract_string(legs, '$[1].dest') FROM ev"""))
def explode_legs(spark, sf):
    return store.explode_legs(load_events(spark, sf)).drop("leg")


def _stored(spark, sf):
    """The events appended source by source into a partitioned table."""
    path = scratch_path(spark, "store")
    events = load_events(spark, sf)
    columns = ["event_id", "ts", "source", "user_id", "event_type", "amount"]
    auth = store.conform(events.where("source = 'auth_events'").withColumn("extra", F.lit(1)), columns, "auth_events")
    store.append_events(auth, path)
    store.append_events(store.conform(events.where("source <> 'auth_events'"), columns), path)
    return path


@query("append_events", with_ev("SELECT event_id, source, user_id, event_type, amount FROM ev"))
def append_events(spark, sf):
    rows = store.read_events(spark, _stored(spark, sf))
    return rows.select("event_id", "source", "user_id", "event_type", "amount")


@query("delete_source_counts", with_ev("""
SELECT source, count(*) AS rows_before, CASE WHEN source = 'web_events' THEN 0 ELSE count(*) END AS rows_after FROM ev GROUP BY source"""))
def delete_source_counts(spark, sf):
    path = _stored(spark, sf)
    before = materialize(store.source_counts(store.read_events(spark, path)), "before")
    store.delete_source(spark, path, "web_events")
    after = store.source_counts(store.read_events(spark, path))
    joined = before.withColumnRenamed("rows_removed", "rows_before").join(after, "source", "left")
    return joined.select("source", "rows_before", F.coalesce("rows_removed", F.lit(0).cast("bigint")).alias("rows_after"))


@query("export_roundtrip", with_ev("SELECT event_id, user_id, carrier, amount FROM ev WHERE source = 'ticket_events'"))
def export_roundtrip(spark, sf):
    out = load_events(spark, sf).where("source = 'ticket_events'").select("event_id", "user_id", "carrier", "amount")
    path = scratch_path(spark, "export") + ".parquet"
    formats.write_result(out, path, "parquet")
    return formats.read_any(spark, path)


@query("entity_upsert", with_ev("""
SELECT type, key, props FROM (
  SELECT 'USER' AS type, user_id AS key, arg_max(meta, event_id) AS props FROM ev WHERE source = 'ticket_events' GROUP BY user_id
  UNION ALL SELECT 'DEVICE', device_id, arg_max(meta, event_id) FROM ev WHERE source = 'ticket_events' AND device_id IS NOT NULL GROUP BY device_id)
UNION ALL
SELECT DISTINCT 'DEVICE', device_id, 'old' FROM ev WHERE source = 'auth_events' AND device_id IS NOT NULL
  AND device_id NOT IN (SELECT device_id FROM ev WHERE source = 'ticket_events' AND device_id IS NOT NULL)"""))
def entity_upsert(spark, sf):
    events = load_events(spark, sf)
    existing = events.where("source = 'auth_events' AND device_id IS NOT NULL").select(
        F.lit("DEVICE").alias("type"), F.col("device_id").alias("key"), F.lit("old").alias("props")).distinct()
    cells = F.array(*[F.struct(F.lit(t).alias("type"), F.col(c).alias("key")) for t, c in (("USER", "user_id"), ("DEVICE", "device_id"))])
    incoming = events.where("source = 'ticket_events'").select(
        F.explode(cells).alias("e"), F.col("meta").alias("props"), F.col("event_id").alias("seq"))
    incoming = incoming.select("e.type", "e.key", "props", "seq").where("key IS NOT NULL")
    return store.upsert_entities(existing, incoming)


@query("link_resolve", with_ev("""
SELECT s.id AS src_id, t.id AS dst_id, 'uses' AS relation FROM (SELECT user_id AS src_key, device_id AS dst_key FROM ev) l
JOIN (SELECT key, arg_min(id, p) AS id FROM ent GROUP BY key) s ON l.src_key = s.key
JOIN (SELECT key, arg_min(id, p) AS id FROM ent GROUP BY key) t ON l.dst_key = t.key""",
    """ent AS (SELECT DISTINCT 'USER:' || user_id AS id, user_id AS key, 1 AS p FROM ev WHERE CAST(user_id AS BIGINT) % 3 = 0
  UNION ALL SELECT DISTINCT 'ACCOUNT:' || substr(account_id, 2), substr(account_id, 2), 2 FROM ev
  UNION ALL SELECT DISTINCT 'DEVICE:' || device_id, device_id, 3 FROM ev WHERE device_id IS NOT NULL)"""))
def link_resolve(spark, sf):
    events = load_events(spark, sf)

    def entity(kind, key, rows):
        return rows.select(F.concat(F.lit(f"{kind}:"), key).alias("id"), F.lit(kind).alias("type"), key.alias("key")).distinct()

    entities = (
        entity("USER", F.col("user_id"), events.where(F.col("user_id").cast("bigint") % 3 == 0))
        .unionByName(entity("ACCOUNT", F.substring("account_id", 2, 100), events))
        .unionByName(entity("DEVICE", F.col("device_id"), events.where("device_id IS NOT NULL")))
    )
    links = events.select(F.col("user_id").alias("src_key"), F.col("device_id").alias("dst_key"), F.lit("uses").alias("relation"))
    return store.resolve_links(links, entities)


@query("source_catalog", with_ev("SELECT source, count(*) AS row_count, min(us) AS min_us, max(us) AS max_us FROM ev GROUP BY source"))
def source_catalog(spark, sf):
    return store.source_catalog(load_events(spark, sf)).select(
        "source", "row_count", epoch("min_ts").alias("min_us"), epoch("max_ts").alias("max_us"))


@query("flatten_meta", with_ev("SELECT event_id, source, json_extract_string(meta, '$.k') AS k, CAST(NULL AS VARCHAR) AS absent FROM ev"))
def flatten_meta(spark, sf):
    return store.flatten_meta(load_events(spark, sf), ["k", "source", "absent"]).select("event_id", "source", "k", "absent")


@query("flatten_meta_all", with_ev("""
SELECT event_id, source, json_extract_string(meta, '$.k') AS k, CASE WHEN event_id % 3 = 0 THEN event_type END AS "x.0", CASE WHEN event_id % 3 = 1 THEN event_type END AS "x.1",
  CASE WHEN event_id % 3 = 2 THEN event_type END AS "x.2", CASE WHEN event_id % 3 = 1 THEN '{"d":' || event_id || '}' END AS nested FROM ev"""))
def flatten_meta_all(spark, sf):
    """Keys found in the rows; a dot in a key and nested values stay as they are."""
    events = load_events(spark, sf).select("event_id", "source", "event_type", "meta")
    more = F.concat(
        F.lit('{"source":"other","k":'), F.get_json_object("meta", "$.k"), F.lit(',"x.'), (F.col("event_id") % 3).cast("string"), F.lit('":"'), F.col("event_type"),
        F.when(F.col("event_id") % 3 == 1, F.concat(F.lit('","nested":{"d":'), F.col("event_id").cast("string"), F.lit("}}"))).otherwise('"}'))
    out = store.flatten_meta(events.withColumn("meta", more))
    return out.drop("event_type", "meta")


LOG_CTE = """chk AS (SELECT source, us, (ts IS NULL) AS rejected,
  (NOT regexp_full_match(origin, '[A-Z]{3}') OR NOT regexp_full_match(dest, '[A-Z]{3}')
   OR NOT (length(country) BETWEEN 2 AND 3) OR NOT regexp_full_match(carrier, '[A-Z0-9]{2,3}')
   OR coalesce(geo_lat < -90 OR geo_lat > 90 OR geo_lon < -180 OR geo_lon > 180, false) OR coalesce(amount < 0, false)) AS warned FROM ev)"""


@query("ingest_log", with_ev("""
SELECT source, count(*) AS total_rows, count(*) FILTER (NOT rejected) AS ingested_rows, count(*) FILTER (rejected) AS rejected_rows,
  count(*) FILTER (warned AND NOT rejected) AS warning_rows FROM chk GROUP BY source""", LOG_CTE))
def ingest_log(spark, sf):
    checked = run_checks(load_events(spark, sf), BUILTIN_CHECKS)
    return store.append_logged(checked, scratch_path(spark, "logged"), ["auth_events", "ticket_events", "web_events"])


@query("ingest_history", with_ev("""
SELECT source, sum(n)::BIGINT AS total_ingested, arg_max('map-' || d, d) AS latest_mapping FROM (
  SELECT source, strftime(ts, '%Y-%m-%d') AS d, count(*) AS n FROM ev GROUP BY ALL) GROUP BY source"""))
def ingest_history(spark, sf):
    checked = run_checks(load_events(spark, sf), BUILTIN_CHECKS).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    log = store.ingest_log(checked, ["source", "day"])
    log = log.withColumn("mapping", F.concat(F.lit("map-"), F.col("day"))).withColumn("started_at", F.col("day"))
    return store.ingest_history(log)


@query("scan_parquet", "SELECT l_returnflag, l_linestatus, count(*) AS rows_read, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ALL")
def scan_parquet(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return rows.agg(F.count(F.lit(1)).alias("rows_read"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
