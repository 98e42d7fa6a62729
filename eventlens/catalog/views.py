"""Timeline, grid, ranking, route, flow and map queries."""

from pyspark.sql import functions as F

from eventlens.catalog.common import SEVERITY_SQL, epoch, load_events, r, scored_events, with_ev, with_scored
from eventlens.operators import viz
from eventlens.registry import query

TOP = 5


def cells_sql(group, bucket=86400, value="count(*)::DOUBLE", source="scored"):
    return f"cells AS (SELECT us // {bucket * 10**6} * {bucket} AS bucket, {group} AS grp, {value} AS value, max(anom_score) AS score FROM {source} GROUP BY ALL HAVING grp IS NOT NULL)"


TOP_SQL = f"top AS (SELECT grp FROM cells GROUP BY grp ORDER BY sum(value) DESC, grp LIMIT {TOP})"
TIMELINE_SQL = """folded AS (SELECT bucket, CASE WHEN grp IN (SELECT grp FROM top) THEN grp ELSE 'Others' END AS series, sum(value) AS value FROM cells GROUP BY ALL),
tl AS (SELECT b.bucket, s.series, coalesce(f.value, 0)::DOUBLE AS value FROM (SELECT DISTINCT bucket FROM cells) b
  CROSS JOIN (SELECT grp AS series FROM top UNION ALL SELECT 'Others') s LEFT JOIN folded f ON f.bucket = b.bucket AND f.series = s.series)"""
CELLS_USER = cells_sql("concat(country, ' | ', coalesce(device_id, 'None'))")
TIMELINE = [CELLS_USER, TOP_SQL, TIMELINE_SQL]


def _cells(spark, sf, bucket="1d"):
    return viz.bucket_groups(scored_events(spark, sf), bucket, ["country", "device_id"])


def _timeline(spark, sf):
    return viz.timeline_topn(_cells(spark, sf), TOP)


@query("timeline_topn", with_scored("SELECT bucket, series, value FROM tl", *TIMELINE))
def timeline_topn(spark, sf):
    return _timeline(spark, sf)


@query("timeline_value", with_ev("SELECT bucket, series, round(value, 4) AS value FROM tl",
       f"cells AS (SELECT us // 21600000000 * 21600 AS bucket, json_extract_string(meta, '$.k') AS grp, avg(amount) AS value FROM ev GROUP BY ALL)",
       TOP_SQL, TIMELINE_SQL))
def timeline_value(spark, sf):
    cells = viz.bucket_groups(load_events(spark, sf), "6h", ["meta.k"], "avg", "amount")
    return viz.timeline_topn(cells, TOP).withColumn("value", r("value", 4))


@query("timeline_normalized", with_scored("""
SELECT bucket, series, round(value / coalesce(nullif(sum(value) OVER (PARTITION BY bucket), 0), 1) * 100, 6) AS value FROM tl""", *TIMELINE))
def timeline_normalized(spark, sf):
    return viz.timeline_normalized(_timeline(spark, sf)).withColumn("value", r("value"))


@query("timeline_smooth", with_scored("""
SELECT bucket, series, round(avg(value) OVER (PARTITION BY series ORDER BY bucket ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS value FROM tl""", *TIMELINE))
def timeline_smooth(spark, sf):
    return viz.timeline_smoothed(_timeline(spark, sf), 3).withColumn("value", r("value"))


@query("series_summary", with_scored("""
SELECT sum(value) AS total, max(value) AS max_value, min(value) FILTER (value > 0) AS min_positive, count(DISTINCT bucket) AS buckets, count(DISTINCT grp) AS groups FROM cells""", CELLS_USER))
def series_summary(spark, sf):
    return viz.series_summary(_cells(spark, sf))


OVERLAY_SQL = """hits AS (SELECT *, us // 3600000000 * 3600 AS bucket FROM scored WHERE anomaly),
code_rank AS (SELECT bucket, code, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, code) AS rk FROM (SELECT bucket, code, count(*) AS n FROM (SELECT bucket, unnest(codes) AS code FROM hits) GROUP BY ALL)),
text_rank AS (SELECT bucket, explain, row_number() OVER (PARTITION BY bucket ORDER BY explain) AS rk FROM (SELECT DISTINCT bucket, explain FROM hits WHERE explain <> '')),
ev_rank AS (SELECT bucket, event_id, row_number() OVER (PARTITION BY bucket ORDER BY ts, event_id) AS rk FROM hits),
ov AS (SELECT p.*, (SELECT string_agg(code, ',' ORDER BY rk) FROM code_rank c WHERE c.bucket = p.bucket AND rk <= 3) AS codes,
  (SELECT string_agg(explain, '; ' ORDER BY rk) FROM text_rank c WHERE c.bucket = p.bucket AND rk <= 3) AS explains,
  (SELECT string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FROM ev_rank c WHERE c.bucket = p.bucket AND rk <= 20) AS event_ids
  FROM (SELECT bucket, max(anom_score) AS max_score, count(*) AS anomalies FROM hits GROUP BY bucket) p)"""


@query("timeline_overlay", with_scored("SELECT bucket, max_score, anomalies, codes, explains, event_ids FROM ov", OVERLAY_SQL))
def timeline_overlay(spark, sf):
    return viz.timeline_overlay(scored_events(spark, sf), "1h")


@query("timeline_markers", with_scored(f"""
SELECT ov.bucket, y, max_score, round(14 + 18 * max_score, 6) AS size, {SEVERITY_SQL.format(c='max_score')} AS severity FROM ov
JOIN (SELECT bucket, sum(value) AS y FROM cells GROUP BY bucket) c ON c.bucket = ov.bucket WHERE max_score >= 0.9""", OVERLAY_SQL, cells_sql("event_type", 3600)))
def timeline_markers(spark, sf):
    scored = scored_events(spark, sf)
    cells = viz.bucket_groups(scored, "1h", ["event_type"])
    out = viz.timeline_markers(cells, viz.timeline_overlay(scored, "1h"), True, 0.9)
    return out.withColumn("size", r("size"))


@query("minute_chart", with_scored("""
SELECT bucket, CASE WHEN grp IN (SELECT grp FROM top) THEN grp ELSE 'Others' END AS series, sum(value) AS value, coalesce(max(score), 0) AS max_score FROM cells GROUP BY ALL""",
    cells_sql("user_id", 60).replace("max(anom_score)", "max(CASE WHEN anomaly THEN anom_score END)"), TOP_SQL))
def minute_chart(spark, sf):
    return viz.minute_chart(scored_events(spark, sf), TOP)


GRID_SQL = "grid AS (SELECT country, us // 86400000000 * 86400 AS bucket, max(amount) AS value, max(anom_score) AS anom_score FROM scored GROUP BY ALL)"


def _grid(spark, sf):
    return viz.grid_aggregate(scored_events(spark, sf), ["country", "bucket", "missing"], "max", "amount", "1d")


@query("grid_aggregate", with_scored("SELECT * FROM grid", GRID_SQL))
def grid_aggregate(spark, sf):
    return _grid(spark, sf)


@query("grid_anomaly_flag", with_scored("SELECT *, anom_score >= (SELECT quantile_cont(anom_score, 0.95) FROM grid) AS anomaly FROM grid", GRID_SQL))
def grid_anomaly_flag(spark, sf):
    return viz.grid_anomaly_flag(_grid(spark, sf), 0.05)


@query("grid_top_reason", with_scored("""
SELECT g.country, g.bucket, g.value, t.code AS top_reason FROM (SELECT country, us // 86400000000 * 86400 AS bucket, count(*) AS value FROM scored GROUP BY ALL) g
LEFT JOIN (SELECT country, bucket, code FROM (SELECT country, bucket, code, count(*) AS n FROM (SELECT country, us // 86400000000 * 86400 AS bucket, unnest(codes) AS code FROM scored) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY country, bucket ORDER BY n DESC, code) = 1) t ON g.country = t.country AND g.bucket = t.bucket"""))
def grid_top_reason(spark, sf):
    return viz.grid_top_reason(scored_events(spark, sf), ["country", "bucket"], "1d")


@query("grid_rows", with_ev("""
SELECT event_id, epoch_us(timezone('Asia/Kolkata', to_timestamp(floor(epoch(timezone('Asia/Kolkata', ts AT TIME ZONE 'UTC')) / 10800) * 10800) AT TIME ZONE 'UTC')) AS us
FROM ev ORDER BY ts, event_id LIMIT 200 OFFSET 20"""))
def grid_rows(spark, sf):
    rows = load_events(spark, sf).withColumn("exact", F.col("ts"))
    out = viz.grid_rows(rows, "3h", "Asia/Kolkata").orderBy("exact", "event_id").offset(20).limit(200)
    return out.select("event_id", epoch("ts").alias("us"))


@query("top_groups", with_ev("""
SELECT concat(user_id, ' | ', coalesce(device_id, 'None')) AS value, count(*) AS rows,
  (SELECT count(DISTINCT concat(user_id, ' | ', coalesce(device_id, 'None'))) FROM ev) AS total_unique FROM ev GROUP BY value ORDER BY rows DESC, value LIMIT 50"""))
def top_groups(spark, sf):
    return viz.top_values(load_events(spark, sf), ["user_id", "device_id"], 50)


@query("distinct_by_freq", with_ev("SELECT device_id AS value, count(*) AS rows FROM ev WHERE device_id IS NOT NULL GROUP BY device_id"))
def distinct_by_freq(spark, sf):
    return viz.value_frequencies(load_events(spark, sf), "device_id")


@query("topn_others", with_scored(f"""
SELECT grp, round(value, 4) AS value, events, max_score, round(value / sum(value) OVER () * 100, 6) AS percent, {SEVERITY_SQL.format(c='max_score')} AS severity FROM (
  SELECT CASE WHEN rk <= 8 THEN device_id ELSE 'Others' END AS grp, sum(value) AS value, sum(events)::BIGINT AS events, max(max_score) AS max_score FROM (
    SELECT device_id, coalesce(sum(amount), 0) AS value, count(*) AS events, max(anom_score) AS max_score, row_number() OVER (ORDER BY coalesce(sum(amount), 0) DESC, device_id) AS rk
    FROM scored WHERE device_id IS NOT NULL GROUP BY device_id) GROUP BY 1)"""))
def topn_others(spark, sf):
    out = viz.topn_others(scored_events(spark, sf), ["device_id"], 8, "sum", "amount")
    return out.withColumns({"value": r("value", 4), "percent": r("percent")})


@query("severity_stats", with_scored("""
SELECT count(*) FILTER (anom_score >= 0.9) AS critical, count(*) FILTER (anom_score >= 0.75 AND anom_score < 0.9) AS high, count(*) FILTER (anom_score >= 0.5 AND anom_score < 0.75) AS medium,
  count(*) FILTER (anom_score >= 0.25 AND anom_score < 0.5) AS low, count(*) FILTER (anom_score >= 0.25) AS total FROM scored"""))
def severity_stats(spark, sf):
    return viz.severity_stats(scored_events(spark, sf))


@query("route_agg", with_scored("""
SELECT origin, dest, count(*) AS events, max(anom_score) AS max_score, round(sum(anom_score), 6) AS sum_score, round(avg(anom_score), 6) AS avg_score
FROM scored WHERE carrier = 'X2' GROUP BY ALL"""))
def route_agg(spark, sf):
    out = viz.route_aggregate(scored_events(spark, sf), "X2")
    return out.withColumns({"sum_score": r("sum_score"), "avg_score": r("avg_score")})


@query("route_agg_users", with_scored("""
SELECT origin, dest, count(*) AS events, round(avg(anom_score), 6) AS avg_score, count(DISTINCT user_id) AS users FROM scored WHERE origin <> dest GROUP BY ALL"""))
def route_agg_users(spark, sf):
    return viz.route_aggregate_users(scored_events(spark, sf)).withColumn("avg_score", r("avg_score"))


LEVELS = ["country", "event_type", "carrier", "device_id"]
FLOW_SQL = "lk AS (" + " UNION ALL ".join(
    f"SELECT {i} AS step, {a} AS a, {b} AS b, count(*)::DOUBLE AS value, max(anom_score) AS max_score FROM scored WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b}"
    for i, (a, b) in enumerate(zip(LEVELS, LEVELS[1:], strict=False))) + """),
ends AS (SELECT level, v, row_number() OVER (PARTITION BY level ORDER BY sum(value) DESC, v) AS rk FROM
  (SELECT step AS level, a AS v, value FROM lk UNION ALL SELECT step + 1, b, value FROM lk) GROUP BY level, v),
kept AS (SELECT * FROM ends WHERE rk <= 10)"""


@query("flow_sankey", with_scored("""
SELECT step, a, b, value, max_score, round(value / sum(value) OVER (PARTITION BY step, b), 6) AS share FROM lk
WHERE value >= 3 AND (step, a) IN (SELECT level, v FROM kept) AND (step + 1, b) IN (SELECT level, v FROM kept)""", FLOW_SQL))
def flow_sankey(spark, sf):
    out = viz.flow_links(scored_events(spark, sf), LEVELS, top_per_level=10, min_link=3)
    return out.select("step", "a", "b", "value", "max_score", r("share").alias("share"))


@query("scatter_regression", with_ev("""
SELECT count(*) AS points, round(regr_slope(amount, h), 6) AS slope, round(regr_intercept(amount, h), 6) AS intercept, min(h) AS x_min, max(h) AS x_max
FROM (SELECT amount, hour(ts)::DOUBLE AS h FROM ev WHERE amount IS NOT NULL)"""))
def scatter_regression(spark, sf):
    out = viz.regression_line(load_events(spark, sf), F.hour("ts"), F.col("amount"))
    return out.withColumns({"slope": r("slope"), "intercept": r("intercept")})


@query("scatter_points", with_scored("SELECT event_id, amount, anom_score FROM scored ORDER BY anom_score DESC, ts, event_id LIMIT 500"))
def scatter_points(spark, sf):
    return viz.scatter_points(scored_events(spark, sf), 500).select("event_id", "amount", "anom_score")


HEX_SQL = """hx AS (SELECT anom_score, carrier, event_type, (geo_lon * 111.32::DOUBLE * (sqrt(3::DOUBLE) / 3) - geo_lat * 111.32::DOUBLE / 3) / 400 AS q, geo_lat * 111.32::DOUBLE * (2::DOUBLE / 3) / 400 AS rr
  FROM scored WHERE geo_lat IS NOT NULL),
hy AS (SELECT *, floor(q + 0.5) AS rq, floor(rr + 0.5) AS r2, floor(-q - rr + 0.5) AS rs FROM hx),
hz AS (SELECT *, abs(rq - q) AS dq, abs(r2 - rr) AS dr, abs(rs - (-q - rr)) AS ds FROM hy),
hexed AS (SELECT *, CAST(CASE WHEN dq > dr AND dq > ds THEN -r2 - rs ELSE rq END AS BIGINT) AS cq, CAST(CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE r2 END AS BIGINT) AS cr,
  concat(carrier, ' · ', event_type) AS key FROM hz)"""


@query("hex_bins", with_scored("""
SELECT cq AS q, cr AS r, CASE WHEN key IN (SELECT key FROM hexed GROUP BY key ORDER BY count(*) DESC, key LIMIT 4) THEN key ELSE 'Others' END AS category,
  count(*) AS events, round(avg(anom_score), 6) AS mean_score FROM hexed GROUP BY ALL""", HEX_SQL))
def hex_bins(spark, sf):
    out = viz.hex_bins(scored_events(spark, sf), 400.0, ["carrier", "event_type"], 4)
    return out.withColumn("mean_score", r("mean_score"))


@query("geo_grid_clusters", with_scored("""
SELECT CAST(floor(geo_lat / (300 / 111.32::DOUBLE)) AS BIGINT) AS cell_y, CAST(floor(geo_lon / (300 / 111.32::DOUBLE)) AS BIGINT) AS cell_x, round(avg(geo_lat), 9) AS lat, round(avg(geo_lon), 9) AS lon,
  round(avg(anom_score), 6) AS mean_score, count(*) AS size FROM scored WHERE geo_lat IS NOT NULL GROUP BY ALL"""))
def geo_grid_clusters(spark, sf):
    out = viz.geo_grid_clusters(scored_events(spark, sf), 300.0)
    return out.withColumns({"lat": r("lat", 9), "lon": r("lon", 9), "mean_score": r("mean_score")})


@query("globe_events", with_scored("""
SELECT event_id, geo_lat, geo_lon, epoch_us(timezone('America/New_York', to_timestamp(floor(epoch(timezone('America/New_York', ts AT TIME ZONE 'UTC')) / 3600) * 3600) AT TIME ZONE 'UTC')) // 1000000 AS bucket,
  anom_score, anom_score >= (SELECT quantile_cont(anom_score, 0.95) FROM scored WHERE geo_lat IS NOT NULL) AS high FROM scored WHERE geo_lat IS NOT NULL"""))
def globe_events(spark, sf):
    out = viz.globe_events(scored_events(spark, sf), "1h", "America/New_York", 0.05)
    return out.select("event_id", "geo_lat", "geo_lon", "bucket", "anom_score", "high")
