"""Window and per-user feature queries."""

from pyspark.sql import functions as F

from eventlens.catalog.common import epoch, load_events, r, with_ev
from eventlens.operators import features as ft
from eventlens.registry import query

LAGGED = """lagged AS (SELECT *, lag(geo_lat) OVER w AS lat_prev, lag(geo_lon) OVER w AS lon_prev, lag(us) OVER w AS us_prev
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))"""
CHORD = ("power(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * power(sin(radians({d} - {c}) / 2), 2)")


def km(a, c, b, d):
    """Haversine text from (a, c) to (b, d)."""
    chord = CHORD.format(a=a, b=b, c=c, d=d)
    return f"CASE WHEN {a} + {b} + {c} + {d} IS NOT NULL THEN 2 * 6371.0088::DOUBLE * asin(sqrt(greatest(0::DOUBLE, least(1::DOUBLE, {chord})))) END"


@query("lag_prev", with_ev("SELECT event_id, lat_prev, lon_prev, us_prev FROM lagged", LAGGED))
def lag_prev(spark, sf):
    out = ft.add_previous_position(load_events(spark, sf))
    return out.select("event_id", "lat_prev", "lon_prev", epoch("ts_prev").alias("us_prev"))


DIST = f"dist AS (SELECT *, {km('geo_lat', 'geo_lon', 'lat_prev', 'lon_prev')} AS dist_prev_km FROM lagged)"
SPEED = "speed AS (SELECT *, dist_prev_km / nullif((us - us_prev) / 3.6e9, 0) AS speed_kmh FROM dist)"


@query("haversine_prev", with_ev("SELECT event_id, round(dist_prev_km, 3) AS dist_prev_km FROM dist", LAGGED, DIST))
def haversine_prev(spark, sf):
    out = ft.add_travel(ft.add_previous_position(load_events(spark, sf)))
    return out.select("event_id", r("dist_prev_km", 3).alias("dist_prev_km"))


@query("travel_speed", with_ev("SELECT event_id, round(speed_kmh, 2) AS speed_kmh FROM speed", LAGGED, DIST, SPEED))
def travel_speed(spark, sf):
    out = ft.add_travel(ft.add_previous_position(load_events(spark, sf)))
    return out.select("event_id", r("speed_kmh", 2).alias("speed_kmh"))


HOME = "home AS (SELECT user_id, quantile_cont(geo_lat, 0.5) AS home_lat, quantile_cont(geo_lon, 0.5) AS home_lon FROM ev GROUP BY user_id)"
HOME_KM = f"hd AS (SELECT e.*, home_lat, home_lon, {km('geo_lat', 'geo_lon', 'home_lat', 'home_lon')} AS dist_home_km FROM ev e JOIN home USING (user_id))"


@query("home_distance", with_ev("SELECT event_id, round(home_lat, 6) AS home_lat, round(home_lon, 6) AS home_lon, round(dist_home_km, 3) AS dist_home_km FROM hd", HOME, HOME_KM))
def home_distance(spark, sf):
    out = ft.add_home(load_events(spark, sf))
    return out.select("event_id", r("home_lat").alias("home_lat"), r("home_lon").alias("home_lon"), r("dist_home_km", 3).alias("dist_home_km"))


HOURS = """hours AS (SELECT user_id, hour(ts) AS h, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS hour_prob FROM ev GROUP BY user_id, hour(ts))"""


@query("hour_rarity", with_ev("""
SELECT event_id, round(hour_prob, 9) AS hour_prob, round(-ln(greatest(hour_prob, 1e-6)), 6) AS hour_rarity
FROM ev JOIN hours ON ev.user_id = hours.user_id AND hour(ev.ts) = hours.h""", HOURS))
def hour_rarity(spark, sf):
    return ft.add_hour_rarity(load_events(spark, sf)).select("event_id", r("hour_prob", 9).alias("hour_prob"), r("hour_rarity").alias("hour_rarity"))


@query("hour_cyclical", with_ev("SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 9) AS h_sin, round(cos(2 * pi() * hour(ts) / 24), 9) AS h_cos FROM ev"))
def hour_cyclical(spark, sf):
    return ft.add_hour_circle(load_events(spark, sf)).select("event_id", r("h_sin", 9).alias("h_sin"), r("h_cos", 9).alias("h_cos"))


VELOCITY = """vel AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) / 5.0::DOUBLE AS v FROM ev)"""


@query("event_velocity", with_ev("SELECT event_id, v AS event_velocity FROM vel", VELOCITY))
def event_velocity(spark, sf):
    return ft.add_event_velocity(load_events(spark, sf)).select("event_id", "event_velocity")


@query("velocity_z", with_ev("""
SELECT event_id, round((v - m) / (s + 1e-6), 4) AS event_velocity_z FROM vel JOIN
(SELECT user_id, avg(v) AS m, coalesce(nullif(stddev_samp(v), 0), 1) AS s FROM vel GROUP BY user_id) USING (user_id)""", VELOCITY))
def velocity_z(spark, sf):
    out = ft.add_velocity_z(ft.add_event_velocity(load_events(spark, sf)))
    return out.select("event_id", r("event_velocity_z", 4).alias("event_velocity_z"))


@query("first_seen_flags", with_ev("""
SELECT event_id, (row_number() OVER (PARTITION BY user_id, coalesce(device_id, 'unknown') ORDER BY ts, event_id) = 1)::INT AS is_new_device,
  (row_number() OVER (PARTITION BY user_id, ip ORDER BY ts, event_id) = 1)::INT AS is_new_ip FROM ev"""))
def first_seen_flags(spark, sf):
    base = ft.known(load_events(spark, sf), "user_id", "device_id", "ip")
    return ft.add_first_seen(base).select("event_id", "is_new_device", "is_new_ip")


@query("rolling_novelty", with_ev("""
SELECT event_id, (NOT coalesce(list_contains(list(coalesce(device_id, 'unknown')) OVER w, coalesce(device_id, 'unknown')), false))::INT AS is_new_device_rolling,
  (NOT coalesce(list_contains(list(ip) OVER w, ip), false))::INT AS is_new_ip_rolling
FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"""))
def rolling_novelty(spark, sf):
    base = ft.known(load_events(spark, sf), "user_id", "device_id", "ip")
    return ft.add_rolling_novelty(base).select("event_id", "is_new_device_rolling", "is_new_ip_rolling")


@query("global_rarity", with_ev("""
SELECT event_id, round(-ln((count(*) OVER (PARTITION BY coalesce(device_id, 'unknown')) + 1) / (count(*) OVER () + 1)), 6) AS device_rarity_global,
  round(-ln((count(*) OVER (PARTITION BY ip) + 1) / (count(*) OVER () + 1)), 6) AS ip_rarity_global FROM ev"""))
def global_rarity(spark, sf):
    base = ft.known(load_events(spark, sf), "device_id", "ip")
    out = ft.add_global_rarity(base, {"device_rarity_global": "device_id", "ip_rarity_global": "ip"})
    return out.select("event_id", r("device_rarity_global").alias("device_rarity_global"), r("ip_rarity_global").alias("ip_rarity_global"))


def series_sql(value, seconds=3600):
    """Dense per-user series: sums per bucket, zero where nothing happened."""
    us = seconds * 10**6
    return f"""spb AS (SELECT user_id, us // {us} * {seconds} AS bucket, sum(coalesce({value}, 0))::DOUBLE AS x, count(*) AS rows FROM ev GROUP BY ALL),
grid AS (SELECT user_id, unnest(generate_series(min(bucket), max(bucket), {seconds})) AS bucket FROM spb GROUP BY user_id),
ser AS (SELECT g.user_id, g.bucket, coalesce(x, 0::DOUBLE) AS x FROM grid g LEFT JOIN spb s ON g.user_id = s.user_id AND g.bucket = s.bucket)"""


SPARSE_AS_SERIES = "ser AS (SELECT user_id, bucket, x FROM spb)"


def robust_sql(window, min_periods, missing=None, alpha=0.2):
    """mu, mad, z, score over ``ser``."""
    mad = "CASE WHEN mad_raw = 0 THEN fb ELSE mad_raw END"
    if missing is not None:
        mad = f"coalesce({mad}, {missing}::DOUBLE)"
    return f"""mus AS (SELECT *, list_reduce(list(x) OVER (PARTITION BY user_id ORDER BY bucket ROWS BETWEEN 162 PRECEDING AND CURRENT ROW),
    lambda a, b: {1 - alpha}::DOUBLE * a + {alpha}::DOUBLE * b) AS mu, abs(x - quantile_cont(x, 0.5) OVER (PARTITION BY user_id)) AS dev FROM ser),
mads AS (SELECT *, CASE WHEN count(*) OVER w >= {min_periods} THEN quantile_cont(dev, 0.5) OVER w END AS mad_raw FROM mus
    WINDOW w AS (PARTITION BY user_id ORDER BY bucket ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)),
fb AS (SELECT coalesce(quantile_cont(mad_raw, 0.5), 1.0::DOUBLE) AS fb FROM mads WHERE mad_raw > 0),
filled AS (SELECT mads.*, {mad} AS mad FROM mads, fb),
rz AS (SELECT *, (x - mu) / (1.4826 * (mad + 1e-6)) AS z, 1.0::DOUBLE / (1 + exp(-abs((x - mu) / (1.4826 * (mad + 1e-6))))) AS score FROM filled)"""


FAIL = "contains(event_type, 'fail')::INT"


def _series(spark, sf):
    return ft.bucket_grid(ft.bucket_values(load_events(spark, sf), F.lit(1), 3600), 3600)


@query("bucket_grid", with_ev("SELECT user_id, bucket, x FROM ser", series_sql("1")))
def bucket_grid(spark, sf):
    return _series(spark, sf)


@query("ewma_baseline", with_ev("SELECT user_id, bucket, round(mu, 9) AS mu FROM rz", series_sql("1"), robust_sql(24, 3)))
def ewma_baseline(spark, sf):
    return ft.add_ewma(_series(spark, sf)).select("user_id", "bucket", r("mu", 9).alias("mu"))


@query("rolling_mad", with_ev("SELECT user_id, bucket, mad_raw AS mad FROM rz", series_sql("1"), robust_sql(24, 3)))
def rolling_mad(spark, sf):
    out = ft.dense_robust_z(load_events(spark, sf), F.lit(1), "1h")
    return out.select("user_id", "bucket", F.col("mad_raw").alias("mad"))


@query("robust_z", with_ev("SELECT user_id, bucket, round(z, 6) AS z, round(score, 9) AS score FROM rz", series_sql("1"), robust_sql(24, 3)))
def robust_z(spark, sf):
    out = ft.dense_robust_z(load_events(spark, sf), F.lit(1), "1h")
    return out.select("user_id", "bucket", r("z").alias("z"), r("score", 9).alias("score"))


@query("fail_bucket_z", with_ev("""
SELECT user_id, bucket, x AS fails, round(mu, 9) AS mu, mad, round(z, 6) AS z, round(score, 9) AS score FROM rz""", series_sql(FAIL), robust_sql(24, 3, 1)))
def fail_bucket_z(spark, sf):
    out = ft.dense_robust_z(load_events(spark, sf), ft.is_failure(F.col("event_type")), "1h", missing=1.0)
    return out.select("user_id", "bucket", F.col("x").alias("fails"), r("mu", 9).alias("mu"), "mad", r("z").alias("z"), r("score", 9).alias("score"))


@query("fail_spike_z", with_ev("SELECT user_id, bucket, x AS fails, round(z, 6) AS z_fail FROM rz",
       series_sql(FAIL, 60).split("grid AS")[0] + SPARSE_AS_SERIES, robust_sql(1440, 30, 1)))
def fail_spike_z(spark, sf):
    out = ft.failure_spikes(load_events(spark, sf))
    return out.select("user_id", "bucket", F.col("x").alias("fails"), r("z_fail").alias("z_fail"))


@query("trailing_z", with_ev("""
SELECT user_id, bucket, x, round(coalesce(CASE WHEN s > 0 THEN (x - m) / s ELSE 0 END, 0), 6) AS z,
  round(1.0::DOUBLE / (1 + exp(-coalesce(CASE WHEN s > 0 THEN (x - m) / s ELSE 0 END, 0))), 9) AS score,
  coalesce(s > 0 AND (x - m) / s > 3, false) AS anomaly FROM
(SELECT *, avg(x) OVER w AS m, stddev_samp(x) OVER w AS s FROM spb WINDOW w AS (PARTITION BY user_id ORDER BY bucket ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))""",
    series_sql("1", 86400).split(",\ngrid AS")[0]))
def trailing_z(spark, sf):
    out = ft.trailing_z(ft.bucket_values(load_events(spark, sf), F.lit(1), 86400))
    return out.select("user_id", "bucket", "x", r("z").alias("z"), r("score", 9).alias("score"), "anomaly")
