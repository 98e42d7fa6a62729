"""The canonical event view.

The driver's ``events`` table lacks identity, geo, route and amount columns.
They are derived by integer arithmetic so that Spark and an outside SQL engine
agree on every row; one text serves both, with three dialect switches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# (column, expression); u = user_id, e = event_id, k = props.k, et = event_type.
_COLUMNS = [
    ("event_id", "e"),
    ("ts", "ts"),
    ("source", "CASE WHEN et IN ('error', 'signup') THEN 'auth_events' WHEN et = 'purchase' THEN 'ticket_events' ELSE 'web_events' END"),
    ("event_type", "CASE et WHEN 'error' THEN 'auth_failure' WHEN 'signup' THEN 'auth_success' WHEN 'purchase' THEN 'payment' ELSE et END"),
    ("user_id", "CAST(u AS {string})"),
    ("account_id", "concat('a', CAST(u % 40 AS {string}))"),
    ("device_id", "CASE WHEN e % 97 = 0 THEN NULL ELSE concat('d', CAST((u * 7 + CASE WHEN k < 90 THEN 0 ELSE k END) % 500 AS {string})) END"),
    ("ip", "concat('10.0.', CAST(u % 20 AS {string}), '.', CAST(k % 16 AS {string}))"),
    ("card_hash", "CASE WHEN et = 'purchase' THEN concat('c', CAST(u % 60 AS {string})) END"),
    ("geo_lat", "CASE WHEN e % 50 = 0 THEN NULL WHEN e % 211 = 0 THEN -(CAST((u * 37) % 100 - 50 AS DOUBLE) + CAST(k % 10 AS DOUBLE) / 100) ELSE CAST((u * 37) % 100 - 50 AS DOUBLE) + CAST(k % 10 AS DOUBLE) / 100 END"),
    ("geo_lon", "CASE WHEN e % 50 = 0 THEN NULL WHEN e % 211 = 0 THEN (CAST((u * 53) % 300 - 150 AS DOUBLE) + CAST(k % 10 AS DOUBLE) / 100) / 2 ELSE CAST((u * 53) % 300 - 150 AS DOUBLE) + CAST(k % 10 AS DOUBLE) / 100 END"),
    ("country", "concat('C', CAST(u % 25 AS {string}))"),
    ("pos_country", "concat('C', CAST(k % 25 AS {string}))"),
    ("card_country", "concat('C', CAST((u + CASE WHEN k < 5 THEN 1 ELSE 0 END) % 25 AS {string}))"),
    ("origin", "concat('N', CAST(u % 25 AS {string}))"),
    ("dest", "concat('N', CAST(k % 25 AS {string}))"),
    ("carrier", "concat('X', CAST(k % 5 AS {string}))"),
    ("amount", "CASE WHEN k % 10 = 0 THEN NULL ELSE value END"),
    ("legs", "concat('[{{\"origin\":\"N', CAST(u % 25 AS {string}), '\",\"dest\":\"N', CAST((u + k) % 25 AS {string}), '\"}},{{\"origin\":\"N', CAST((u + k) % 25 AS {string}), '\",\"dest\":\"N', CAST(k % 25 AS {string}), '\"}}]')"),
    ("meta", "props"),
]

_SPARK = {"string": "STRING"}
_DUCK = {"string": "VARCHAR"}

# CTE text for outside engines: ``WITH <EV_SQL> SELECT ... FROM ev``.
EV_SQL = (
    "raw_ev AS (SELECT event_id AS e, ts, user_id AS u, event_type AS et, value, props, "
    "CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), "
    "ev AS (SELECT "
    + ", ".join(f"{expr.format(**_DUCK)} AS {name}" for name, expr in _COLUMNS)
    + ", epoch_us(ts) AS us FROM raw_ev)"
)

EVENT_COLUMNS = [name for name, _ in _COLUMNS]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def canonical(raw: DataFrame) -> DataFrame:
    """Driver ``events`` rows (batch or stream) -> canonical event rows."""
    keyed = raw.select(
        F.col("event_id").alias("e"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("u"),
        F.col("event_type").alias("et"),
        "value",
        "props",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    return keyed.selectExpr(*[f"{expr.format(**_SPARK)} AS {name}" for name, expr in _COLUMNS])


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(table(spark, sf_dir, "events"))
