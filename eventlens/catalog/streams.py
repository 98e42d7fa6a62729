"""Streaming queries: each drains the event table as a file stream."""

from pyspark.sql import functions as F

from eventlens.catalog.common import r, table, with_ev
from eventlens.catalog.rules import HIT_SQL, SCORING, SEV_NAME
from eventlens.functions import rules as ru
from eventlens.functions import validation as va
from eventlens.operators import mapping as mp
from eventlens.registry import query
from eventlens.session import scratch_path
from eventlens.sources.canonical import canonical
from eventlens.streaming import jobs


def stream(spark, sf):
    return canonical(jobs.open_stream(spark, sf, "events.parquet", table(spark, sf, "events").schema))


MAPPING = {"ts": "ts", "event_type": "event_type", "user_id": "user_id", "amount": "amount", "city": "missing"}
CHECKS = [
    {"name": "amount", "target_field": "amount", "rule_type": "required", "on_failure": "reject"},
    {"name": "floor", "target_field": "amount", "rule_type": "range", "on_failure": "fix", "config": {"min": 5}},
]


@query("stream_ingest", with_ev("SELECT event_id, upper(event_type) AS event_type, user_id, greatest(amount, 5) AS amount, 'live' AS source, amount < 5 AS warned FROM ev WHERE amount IS NOT NULL"))
def stream_ingest(spark, sf):
    mapped = mp.ingest(stream(spark, sf), MAPPING, "live", {"event_type": "upper"}, keep=["event_id"])
    checked = va.run_checks(mapped, CHECKS).where("NOT rejected")
    out = jobs.run_to_table(checked.drop("issues", "rejected"), "ingest")
    return out.select("event_id", "event_type", "user_id", "amount", "source", "warned")


@query("stream_rules", with_ev(f"SELECT event_id, user_id, rule_id, {SEV_NAME.format(c='sev')} AS severity, score AS score_contribution FROM hit", HIT_SQL))
def stream_rules(spark, sf):
    scored = ru.evaluate_rules(stream(spark, sf), SCORING)
    out = jobs.run_to_table(scored, "rules", also=ru.match_audit)
    return out.select("event_id", "user_id", "rule_id", "severity", "score_contribution")


@query("stream_tumbling", with_ev("SELECT us // 3600000000 * 3600 AS bucket, user_id, count(*) AS rows FROM ev GROUP BY ALL"))
def stream_tumbling(spark, sf):
    return jobs.latest(jobs.run_to_table(jobs.tumbling_counts(stream(spark, sf)), "tumbling", "update"), ["bucket", "user_id"])


@query("stream_sliding", with_ev("""
SELECT w AS window_end, user_id, count(*) / 5.0::DOUBLE AS velocity FROM (
  SELECT user_id, unnest(generate_series(us // 60000000 * 60 + 60, us // 60000000 * 60 + 300, 60)) AS w FROM ev) GROUP BY ALL"""))
def stream_sliding(spark, sf):
    return jobs.latest(jobs.run_to_table(jobs.sliding_velocity(stream(spark, sf)), "sliding", "update"), ["window_end", "user_id"])


@query("stream_first_seen", with_ev("""
SELECT user_id, coalesce(device_id, 'unknown') AS value, arg_min(event_id, us) AS event_id FROM ev GROUP BY ALL"""))
def stream_first_seen(spark, sf):
    out = jobs.run_to_table(jobs.first_seen(stream(spark, sf), "device_id"), "first", "update")
    return jobs.latest(out, ["user_id", "value"]).select("user_id", "value", "event_id")


@query("stream_ewma", with_ev("""
SELECT user_id, bucket, rows, round(mu, 9) AS mu, round(spread, 9) AS spread, round((rows - mu) / (1.4826 * (spread + 1e-6)), 6) AS z FROM (
  SELECT *, list_reduce(list(abs(x - mu)) OVER (PARTITION BY user_id ORDER BY bucket ROWS BETWEEN 162 PRECEDING AND CURRENT ROW),
    lambda a, b: 0.8::DOUBLE * a + 0.2::DOUBLE * b) AS spread FROM (
    SELECT user_id, bucket, x, x::BIGINT AS rows, list_reduce(list(x) OVER (PARTITION BY user_id ORDER BY bucket ROWS BETWEEN 162 PRECEDING AND CURRENT ROW),
      lambda a, b: 0.8::DOUBLE * a + 0.2::DOUBLE * b) AS mu FROM ser)) WHERE rows > 0""",
    """spb AS (SELECT user_id, us // 3600000000 * 3600 AS bucket, count(*)::DOUBLE AS x FROM ev GROUP BY ALL),
    grid AS (SELECT user_id, unnest(generate_series(min(bucket), max(bucket), 3600)) AS bucket FROM spb GROUP BY user_id),
    ser AS (SELECT g.user_id, g.bucket, coalesce(x, 0::DOUBLE) AS x FROM grid g LEFT JOIN spb s ON g.user_id = s.user_id AND g.bucket = s.bucket)"""))
def stream_ewma(spark, sf):
    out = jobs.latest(jobs.run_to_table(jobs.online_ewma(stream(spark, sf)), "ewma", "update"), ["user_id", "bucket"])
    return out.select("user_id", "bucket", "rows", r("mu", 9).alias("mu"), r("spread", 9).alias("spread"), r("z").alias("z"))


@query("stream_late_counts", with_ev("""
SELECT part AS batch_id, count(*) AS input_rows, count(*) FILTER ((us // 3600000000 + 1) * 3600000000 <= mark) AS late_rows FROM (
  SELECT event_id, us, event_id % 4 AS part FROM ev) JOIN (
  SELECT p.part AS part, max(us) // 1000 * 1000 - 600000000 AS mark FROM (SELECT unnest(range(4)) AS part) p LEFT JOIN ev ON ev.event_id % 4 < p.part - 1 GROUP BY p.part) USING (part)
GROUP BY part"""))
def stream_late_counts(spark, sf):
    """All events, arriving in four files one after the other."""
    events = canonical(table(spark, sf, "events")).select("event_id", "ts", "user_id")
    folder = scratch_path(spark, "arrivals")
    for part in range(4):
        events.where(F.col("event_id") % 4 == part).coalesce(1).write.mode("append").parquet(f"{folder}/p")
    return jobs.late_counts(jobs.open_stream(spark, folder, "p", events.schema, files_per_batch=1))


@query("stream_join_window", with_ev("""
SELECT a.user_id AS key, a.event_id AS l_id, b.event_id AS r_id FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.us BETWEEN a.us AND a.us + 7200000000
WHERE a.event_type = 'auth_failure' AND b.event_type = 'payment'"""))
def stream_join_window(spark, sf):
    left = stream(spark, sf).where(F.col("event_type") == "auth_failure")
    right = stream(spark, sf).where(F.col("event_type") == "payment")
    return jobs.run_to_table(jobs.correlated(left, right, "user_id", 120), "correlated").drop("batch_id")
