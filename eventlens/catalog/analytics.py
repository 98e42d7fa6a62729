"""Anomaly and clustering queries."""

from pyspark.sql import functions as F

from eventlens.catalog.common import epoch, load_events, r, with_ev
from eventlens.catalog.features import FAIL, robust_sql, series_sql
from eventlens.catalog.rules import FEATURES_SQL
from eventlens.operators import anomaly as an
from eventlens.operators import features as ft
from eventlens.operators.clustering import cluster_summary, geo_dbscan
from eventlens.registry import query


def marked_sql(select, value, seconds=3600, window=(24, 3)):
    return with_ev(
        f"SELECT {select} FROM ev e LEFT JOIN rz ON e.user_id = rz.user_id AND e.us // {seconds * 10**6} * {seconds} = rz.bucket",
        series_sql(value, seconds), robust_sql(*window))


FLAG = "coalesce(abs(z) >= 3, false)"
MARKED = (f"event_id, round(z, 6) AS zrobust, {FLAG} AS anomaly, round(coalesce(score, 0), 9) AS anom_score, "
          f"CASE WHEN {FLAG} THEN printf('Robust z-score %.2f exceeds threshold 3.0', z) ELSE '' END AS explain")


def _marked(spark, sf, feature, bucket="1h"):
    out = an.mark_anomalies(load_events(spark, sf), feature, 3.0, bucket)
    return out.select("event_id", r("zrobust").alias("zrobust"), "anomaly", r("anom_score", 9).alias("anom_score"), "explain")


@query("anomaly_simple", marked_sql(MARKED, "1"))
def anomaly_simple(spark, sf):
    return _marked(spark, sf, "count")


@query("anomaly_simple_fail", marked_sql(MARKED, FAIL))
def anomaly_simple_fail(spark, sf):
    return _marked(spark, sf, "is_fail")


@query("anomaly_simple_value", marked_sql(MARKED, "amount"))
def anomaly_simple_value(spark, sf):
    return _marked(spark, sf, "amount")


# The dense series of minutes; the mean is summed over the buckets with events whose weight a double can hold.
MINUTE_SQL = (
    """mus AS (SELECT s.user_id, s.bucket, any_value(s.x) AS x, sum(e.x * 0.8 ** ((s.bucket - e.bucket) / 60) * CASE WHEN e.bucket = e.lo THEN 1 ELSE 0.2 END) AS mu
  FROM spb s JOIN (SELECT *, min(bucket) OVER (PARTITION BY user_id) AS lo FROM spb) e
    ON s.user_id = e.user_id AND e.bucket BETWEEN s.bucket - 20000 AND s.bucket GROUP BY s.user_id, s.bucket)""",
    """devs AS (SELECT user_id, bucket, abs(x - quantile_cont(x, 0.5) OVER (PARTITION BY user_id)) AS dev FROM ser)""",
    """mads AS (SELECT user_id, bucket, CASE WHEN count(*) OVER w >= 30 THEN quantile_cont(dev, 0.5) OVER w END AS mad_raw FROM devs
  WINDOW w AS (PARTITION BY user_id ORDER BY bucket ROWS BETWEEN 1439 PRECEDING AND CURRENT ROW))""",
    "fb AS (SELECT coalesce(quantile_cont(mad_raw, 0.5), 1.0::DOUBLE) AS fb FROM mads WHERE mad_raw > 0)",
    """zs AS (SELECT user_id, bucket, (x - mu) / (1.4826 * (CASE WHEN mad_raw = 0 THEN fb ELSE mad_raw END + 1e-6)) AS z FROM mus JOIN mads USING (user_id, bucket), fb)""",
    "rz AS (SELECT *, 1.0::DOUBLE / (1 + exp(-abs(z))) AS score FROM zs)")


@query("anomaly_simple_1m", with_ev(
    f"SELECT {MARKED} FROM ev e LEFT JOIN rz ON e.user_id = rz.user_id AND e.us // 60000000 * 60 = rz.bucket", series_sql("1", 60), *MINUTE_SQL))
def anomaly_simple_1m(spark, sf):
    """The default bucket."""
    return _marked(spark, sf, "count", "1m")


@query("anomaly_presets", marked_sql(
    "event_id, coalesce(abs(z) >= 2, false) AS anomaly_high, coalesce(abs(z) >= 3, false) AS anomaly_balanced, coalesce(abs(z) >= 5, false) AS anomaly_low", "1"))
def anomaly_presets(spark, sf):
    return an.preset_flags(load_events(spark, sf)).select("event_id", "anomaly_high", "anomaly_balanced", "anomaly_low")


@query("anomaly_stats", marked_sql(
    f"count(*) AS row_count, count(*) FILTER ({FLAG}) AS anomalies, round(avg(({FLAG})::INT), 9) AS anomaly_rate, round(avg(coalesce(score, 0)), 6) AS score_mean, "
    "round(max(coalesce(score, 0)), 6) AS score_max, round(min(coalesce(score, 0)), 6) AS score_min, round(quantile_cont(coalesce(score, 0), 0.95), 6) AS score_p95", "1"))
def anomaly_stats(spark, sf):
    out = an.run_stats(an.mark_anomalies(load_events(spark, sf), "count", 3.0, "1h").select("anomaly", "anom_score"))
    digits = {"anomaly_rate": 9, "score_mean": 6, "score_max": 6, "score_min": 6, "score_p95": 6}
    return out.select("row_count", "anomalies", *[r(c, d).alias(c) for c, d in digits.items()])


DIGITS = {"dist_prev_km": 3, "dist_home_km": 3, "speed_kmh": 2, "event_velocity_z": 4}


@query("advanced_features", with_ev("SELECT event_id, " + ", ".join(
    f"round(coalesce({c}, quantile_cont({c}, 0.5) OVER (), 0)::DOUBLE, {DIGITS.get(c, 6)}) AS {c}" for c in ft.FEATURES) + " FROM feat", FEATURES_SQL))
def advanced_features(spark, sf):
    matrix = ft.feature_matrix(ft.behaviour_features(load_events(spark, sf), keep=()))
    return matrix.select("event_id", *[r(c, DIGITS.get(c, 6)).alias(c) for c in ft.FEATURES])


REASONS = {
    "FAR_FROM_HOME": ("dist_home_km > 2000", "printf('Distance from home %.0fkm exceeds 2000.0km', dist_home_km)"),
    "GEO_JUMP": ("speed_kmh IS NOT NULL AND (dist_prev_km > 2000 OR speed_kmh > 900)", "printf('Geographic jump %.0fkm at %.0fkm/h', dist_prev_km, speed_kmh)"),
    "HIGH_EVENT_VELOCITY": ("event_velocity_z > 3", "printf('Event rate %.1f events/min abnormally high (typical: %.1f)', event_velocity, vm)"),
    "NEW_DEVICE": ("is_new_device = 1 OR is_new_device_rolling = 1", "'First or rarely seen device for this user'"),
    "NEW_IP": ("is_new_ip = 1 OR is_new_ip_rolling = 1", "'First or rarely seen IP for this user'"),
}


@query("anomaly_reasons", with_ev("SELECT event_id, concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, (c, _) in REASONS.items()) + ") AS codes, concat_ws('; ', "
       + ", ".join(f"CASE WHEN {c} THEN {d} END" for c, d in REASONS.values()) + ") AS explain FROM feat", FEATURES_SQL))
def anomaly_reasons(spark, sf):
    out = an.add_reasons(ft.behaviour_features(load_events(spark, sf)), with_forest=False)
    return out.select("event_id", F.array_join(F.col("reasons.code"), ",").alias("codes"), "explain")


@query("anomaly_advanced")
def anomaly_advanced(spark, sf):
    out = an.advanced_anomalies(load_events(spark, sf), keep=())
    return out.select("event_id", r("anom_score").alias("anom_score"), "anomaly", F.array_join(F.col("reasons.code"), ",").alias("codes"))


# What any seeded forest must give: every event once, scores from 0 to 1 with both ends reached, at most the contamination flagged, and flags above all other scores.
@query("forest_check", with_ev("""
SELECT count(*) AS events, count(DISTINCT event_id) AS distinct_events, 0::BIGINT AS outside, true AS reaches_both_ends, true AS flags_few, true AS flags_some,
  true AS flags_are_highest, count(DISTINCT user_id) AS users FROM ev"""))
def forest_check(spark, sf):
    out = an.advanced_anomalies(load_events(spark, sf), contamination=0.05, keep=("user_id",))
    rows = F.count(F.lit(1))
    return out.agg(
        rows.alias("events"), F.countDistinct("event_id").alias("distinct_events"), F.count_if(~F.col("anom_score").between(0, 1)).alias("outside"),
        ((F.min("anom_score") == 0) & (F.max("anom_score") == 1)).alias("reaches_both_ends"), (F.count_if("anomaly") <= 0.05 * rows).alias("flags_few"),
        (F.count_if("anomaly") >= 0.04 * rows).alias("flags_some"),
        (F.min(F.when(F.col("anomaly"), F.col("anom_score"))) >= F.max(F.when(~F.col("anomaly"), F.col("anom_score")))).alias("flags_are_highest"),
        F.countDistinct("user_id").alias("users"))


# All pairs within eps, counted; core points meet through their cells, whose components are closed by recursion.
DBSCAN_SQL = (
    """raw_points AS (SELECT event_id, us, geo_lat, geo_lon, (us - min(us) OVER ()) / 60e6 AS minutes FROM ev
  WHERE geo_lat IS NOT NULL AND geo_lon IS NOT NULL AND us IS NOT NULL)""",
    """scale AS (SELECT avg(geo_lat) AS mx, avg(geo_lon) AS my, avg(minutes) AS mz, coalesce(nullif(stddev_pop(geo_lat), 0), 1) AS sx,
  coalesce(nullif(stddev_pop(geo_lon), 0), 1) AS sy, coalesce(nullif(stddev_pop(minutes), 0), 1) AS sz FROM raw_points)""",
    """points AS MATERIALIZED (SELECT event_id, us, (geo_lat - mx) / sx AS x, (geo_lon - my) / sy AS y, (minutes - mz) / sz AS z FROM raw_points, scale)""",
    """near AS MATERIALIZED (SELECT a.event_id AS a, b.event_id AS b FROM points a JOIN points b ON b.x BETWEEN a.x - 0.71 AND a.x + 0.71
  AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.7 * 0.7)""",
    "dense AS (SELECT a AS event_id FROM near GROUP BY a HAVING count(*) >= 15)",
    """core AS MATERIALIZED (SELECT event_id, us, dense_rank() OVER (ORDER BY floor(x / (0.7 / sqrt(3))), floor(y / (0.7 / sqrt(3))), floor(z / (0.7 / sqrt(3)))) AS cell
  FROM points JOIN dense USING (event_id))""",
    """cell_links AS MATERIALIZED (SELECT DISTINCT p.cell AS a, q.cell AS b FROM near JOIN core p ON near.a = p.event_id JOIN core q ON near.b = q.event_id)""",
    "reach(a, b) AS (SELECT a, b FROM cell_links UNION SELECT reach.a, cell_links.b FROM reach JOIN cell_links ON reach.b = cell_links.a)",
    "comp AS (SELECT a AS cell, min(b) AS comp FROM reach GROUP BY a)",
    """numbered AS (SELECT comp, row_number() OVER (ORDER BY min(struct_pack(us := us, id := event_id))) - 1 AS cluster FROM core JOIN comp USING (cell) GROUP BY comp)""",
    "labelled AS MATERIALIZED (SELECT event_id, cluster FROM core JOIN comp USING (cell) JOIN numbered USING (comp))",
    """border AS (SELECT near.a AS event_id, min(cluster) AS cluster FROM near JOIN labelled ON near.b = labelled.event_id
  WHERE near.a NOT IN (SELECT event_id FROM core) GROUP BY near.a)""",
    """clustered AS MATERIALIZED (SELECT ev.event_id, us, geo_lat, geo_lon, coalesce(l.cluster, b.cluster, -1) AS cluster
  FROM ev LEFT JOIN labelled l USING (event_id) LEFT JOIN border b USING (event_id))""",
)


def clustered_sql(body):
    return with_ev(body, *DBSCAN_SQL).replace("WITH ", "WITH RECURSIVE ", 1)


@query("geo_dbscan", clustered_sql("SELECT event_id, cluster FROM clustered"))
def dbscan(spark, sf):
    return geo_dbscan(load_events(spark, sf)).select("event_id", "cluster")


@query("cluster_summary", clustered_sql("""
SELECT cluster, count(*) AS size, round(avg(geo_lat), 4) AS centroid_lat, round(avg(geo_lon), 4) AS centroid_lon, min(us) AS time_start,
  max(us) AS time_end, (SELECT count(*) FROM clustered WHERE cluster = -1) AS noise_count FROM clustered WHERE cluster >= 0 GROUP BY cluster"""))
def summary(spark, sf):
    out = cluster_summary(geo_dbscan(load_events(spark, sf)))
    return out.withColumns({"time_start": epoch("time_start"), "time_end": epoch("time_end")})
