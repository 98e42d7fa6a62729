"""Inputs shared by the registered queries, each with its SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.operators.viz import score_by_trailing_z
from eventlens.operators.windows import with_first_seen
from eventlens.sources.canonical import EV_SQL, load_events, table

__all__ = ["EV_SQL", "load_events", "table", "with_ev", "scored_events", "SCORED_SQL", "with_scored", "r", "epoch"]


def with_ev(body: str, *ctes: str) -> str:
    return f"WITH {', '.join([EV_SQL, *ctes])} {body}"


def r(col: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


def epoch(col: Column | str) -> Column:
    return F.unix_micros(col)


SCORE_Z = 2.0


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a daily trailing-z score and reasons (spike, new device, new IP)."""
    df = score_by_trailing_z(load_events(spark, sf_dir), "1d", 20, SCORE_Z)
    df = with_first_seen(df, "user_id", {
        "new_device": F.coalesce("device_id", F.lit("unknown")), "new_ip": F.coalesce("ip", F.lit("unknown")),
    })

    def reason(code: str, desc: str) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(desc).alias("desc"))

    found = F.array_compact(F.array(
        F.when(F.col("anomaly"), reason("SPIKE", "Unusual number of events")),
        F.when(F.col("new_device") == 1, reason("NEW_DEVICE", "New device")),
        F.when(F.col("new_ip") == 1, reason("NEW_IP", "New address")),
    ))
    return (
        df.withColumn("anom_score", r("anom_score", 9)).withColumn("reasons", found)
        .withColumn("explain", F.array_join(F.col("reasons.desc"), "; ")).drop("new_device", "new_ip")
    )


# DuckDB text of the same; codes is a list, explain a text.
SCORED_SQL = f"""
day_counts AS (SELECT user_id, us // 86400000000 * 86400 AS bucket, count(*) AS x FROM ev GROUP BY ALL),
day_stats AS (SELECT user_id, bucket, x, avg(x) OVER w AS m, stddev_samp(x) OVER w AS s FROM day_counts
  WINDOW w AS (PARTITION BY user_id ORDER BY bucket ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
day_z AS (SELECT user_id, bucket, coalesce(CASE WHEN s > 0 THEN (x - m) / s ELSE 0.0::DOUBLE END, 0.0::DOUBLE) AS z FROM day_stats),
flagged AS (SELECT e.*, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-z)), 9) AS anom_score, z > {SCORE_Z} AS anomaly,
  row_number() OVER (PARTITION BY e.user_id, coalesce(device_id, 'unknown') ORDER BY ts, event_id) = 1 AS new_device,
  row_number() OVER (PARTITION BY e.user_id, coalesce(ip, 'unknown') ORDER BY ts, event_id) = 1 AS new_ip
  FROM ev e JOIN day_z d ON e.user_id = d.user_id AND e.us // 86400000000 * 86400 = d.bucket),
scored AS (SELECT *,
  list_filter([CASE WHEN anomaly THEN 'SPIKE' END, CASE WHEN new_device THEN 'NEW_DEVICE' END, CASE WHEN new_ip THEN 'NEW_IP' END], lambda c: c IS NOT NULL) AS codes,
  concat_ws('; ', CASE WHEN anomaly THEN 'Unusual number of events' END, CASE WHEN new_device THEN 'New device' END, CASE WHEN new_ip THEN 'New address' END) AS explain
  FROM flagged)
"""


def with_scored(body: str, *ctes: str) -> str:
    return with_ev(body, SCORED_SQL, *ctes)


# CASE text of the severity scale.
SEVERITY_SQL = (
    "CASE WHEN {c} >= 0.9 THEN 'critical' WHEN {c} >= 0.75 THEN 'high' "
    "WHEN {c} >= 0.5 THEN 'medium' WHEN {c} >= 0.25 THEN 'low' ELSE 'normal' END"
)
