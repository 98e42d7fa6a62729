"""Summaries behind the analyst views: timelines, grids, top-N, routes, flows, bins.

All take events scored beforehand (``anom_score``, ``anomaly``, ``reasons``,
``explain``) and aggregate map-side. Lists that are ranked are cut to a fixed
top-N; everything else keeps all groups.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.predicates import field_column
from eventlens.functions.scales import SEVERITY_FLOOR, bucket_epoch, bucket_seconds, severity
from eventlens.operators.features import bucket_values, trailing_z
from eventlens.operators.joins import attach_stats
from eventlens.operators.quantiles import quantile_scalar
from eventlens.session import materialize

KM_PER_DEGREE = 111.32
OTHERS = "Others"


def score_by_trailing_z(df: DataFrame, bucket: str = "1h", rows: int = 20, z_thr: float = 3.0) -> DataFrame:
    """Events with zscore, anomaly and anom_score from the trailing window score.

    Events without a user keep a NULL zscore and the neutral score.
    """
    seconds = bucket_seconds(bucket)
    counts = bucket_values(df.where(F.col("user_id").isNotNull()), F.lit(1), seconds)
    scores = trailing_z(counts, rows, z_thr).select(
        "user_id", "bucket", "rows", F.col("z").alias("zscore"), F.col("score").alias("anom_score"), "anomaly"
    )
    keyed = df.withColumn("bucket", bucket_epoch(F.col("ts"), seconds))
    out = attach_stats(keyed, scores, ["user_id", "bucket"], F.col("event_id"), rows="rows").drop("rows", "bucket")
    return out.withColumns({
        "anom_score": F.coalesce("anom_score", F.lit(0.5)), "anomaly": F.coalesce("anomaly", F.lit(False)),
    })


def composite_key(df: DataFrame, fields: Sequence[str], sep: str = " | ") -> Column:
    """One field as it is; several joined, a missing part written ``None``."""
    cols = [c for c in (field_column(df, f) for f in fields) if c is not None]
    if len(cols) == 1:
        return cols[0].cast("string")
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("None")) for c in cols])


def metric_column(metric: str, value: str | None) -> Column:
    if metric == "count" or value is None:
        return F.count(F.lit(1)).cast("double")
    return {"avg": F.avg, "max": F.max, "min": F.min, "sum": F.sum}.get(metric, F.avg)(value)


def usable_value(df: DataFrame, value: str | None) -> str | None:
    """A non-numeric value field falls back to counting."""
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")
    return value if value and dict(df.dtypes).get(value, "").startswith(numeric) else None


# --- timeline -------------------------------------------------------------------

def bucket_groups(df: DataFrame, bucket: str, fields: Sequence[str], metric: str = "count", value: str | None = None) -> DataFrame:
    """(bucket, grp, value, score) with one pass over the events."""
    extra = [F.max("anom_score").alias("score")] if "anom_score" in df.columns else []
    rows = df.withColumn("grp", composite_key(df, fields)).where(F.col("grp").isNotNull())
    return rows.groupBy(bucket_epoch(F.col("ts"), bucket_seconds(bucket)).alias("bucket"), "grp").agg(
        metric_column(metric, usable_value(df, value)).alias("value"), *extra
    )


def top_groups_of(cells: DataFrame, n: int) -> DataFrame:
    """The n groups with the largest total; ties by name."""
    totals = cells.groupBy("grp").agg(F.sum("value").alias("total"))
    return totals.orderBy(F.desc("total"), "grp").limit(n)


def timeline_topn(cells: DataFrame, n: int) -> DataFrame:
    """(bucket, series, value): top n groups and the rest, zero where nothing happened."""
    cells = materialize(cells, "cells")
    top = top_groups_of(cells, n).select("grp")
    # At most n + 1 names; a mark in front tells the rest from a group of that name.
    names = top.agg(F.sort_array(F.collect_list(F.concat(F.lit("="), "grp"))).alias("names")).scalar()
    marked = F.concat(F.lit("="), F.col("grp"))
    series = F.when(F.array_contains(names, marked), marked).otherwise("+" + OTHERS)
    sums = cells.groupBy("bucket", series.alias("series")).agg(F.sum("value").alias("value"))
    filled = (
        sums.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("series", "value"))).alias("seen"))
        .select("bucket", "seen", F.explode(F.concat(names, F.array(F.lit("+" + OTHERS)))).alias("series"))
    )
    return filled.select(
        "bucket", F.substring("series", 2, 1 << 30).alias("series"), F.coalesce(F.col("seen")[F.col("series")], F.lit(0.0)).alias("value"))


def timeline_normalized(timeline: DataFrame) -> DataFrame:
    """Percent of the bucket's total; an empty bucket gives zeros."""
    total = F.sum("value").over(Window.partitionBy("bucket"))
    return timeline.withColumn("value", F.col("value") / F.when(total == 0, 1.0).otherwise(total) * 100)


def timeline_smoothed(timeline: DataFrame, width: int) -> DataFrame:
    """Mean over the last ``width`` observed buckets of each series."""
    frame = Window.partitionBy("series").orderBy("bucket").rowsBetween(-(width - 1), 0)
    return timeline.withColumn("value", F.avg("value").over(frame))


def series_summary(cells: DataFrame) -> DataFrame:
    return cells.agg(
        F.sum("value").alias("total"), F.max("value").alias("max_value"),
        F.min(F.when(F.col("value") > 0, F.col("value"))).alias("min_positive"),
        F.count_distinct("bucket").alias("buckets"), F.count_distinct("grp").alias("groups"),
    )


def top_codes(events: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """(keys, code, uses, rank): the n most frequent reason codes; ties by code."""
    counts = events.select(*keys, F.explode("reasons.code").alias("code")).groupBy(*keys, "code").agg(
        F.count(F.lit(1)).alias("uses")
    )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("uses"), "code"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def timeline_overlay(scored: DataFrame, bucket: str, events_per_bucket: int = 20) -> DataFrame:
    """Per bucket with anomalies: max score, 3 codes, 3 explanations, first events.

    Each list is ranked and cut before it is gathered.
    """
    hits = scored.where("anomaly").select(
        bucket_epoch(F.col("ts"), bucket_seconds(bucket)).alias("bucket"), "ts", "event_id", "anom_score", "reasons", "explain"
    )
    hits = materialize(hits, "hits")  # the anomalous share of the events, read four times
    peak = hits.groupBy("bucket").agg(F.max("anom_score").alias("max_score"), F.count(F.lit(1)).alias("anomalies"))
    codes = top_codes(hits, ["bucket"], 3).groupBy("bucket").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "code"))), lambda c: c["code"]), ",").alias("codes")
    )
    texts = hits.where(F.col("explain") != "").select("bucket", "explain").distinct()
    texts = texts.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("explain"))).where("r <= 3")
    texts = texts.groupBy("bucket").agg(F.array_join(F.sort_array(F.collect_list("explain")), "; ").alias("explains"))
    first = hits.select("bucket", "ts", "event_id").withColumn(
        "r", F.row_number().over(Window.partitionBy("bucket").orderBy("ts", "event_id"))
    ).where(F.col("r") <= events_per_bucket)
    first = first.groupBy("bucket").agg(F.array_join(F.sort_array(F.collect_list("event_id")).cast("array<string>"), ",").alias("event_ids"))
    return peak.join(codes, "bucket", "left").join(texts, "bucket", "left").join(first, "bucket", "left")


def timeline_markers(cells: DataFrame, overlay: DataFrame, stacked: bool = True, floor: float = 0.0) -> DataFrame:
    """Marker per anomalous bucket: height from the series, size from the score."""
    height = F.sum("value") if stacked else F.max("value")
    heights = cells.groupBy("bucket").agg(height.alias("y"))
    marks = overlay.where(F.col("max_score") >= floor)
    return marks.join(heights, "bucket").select(
        "bucket", "y", "max_score", (F.lit(14.0) + F.lit(18.0) * F.col("max_score")).alias("size"),
        severity(F.col("max_score")).alias("severity"),
    )


def minute_chart(scored: DataFrame, n: int) -> DataFrame:
    """Per minute: top users and the rest, with the highest anomalous score."""
    rows = scored.withColumn("anom_score", F.when(F.col("anomaly"), F.col("anom_score")))
    cells = materialize(bucket_groups(rows, "1m", ["user_id"]), "cells")
    names = top_groups_of(cells, n).agg(F.collect_list("grp").alias("names")).scalar()
    own = F.array_contains(names, F.col("grp"))
    return cells.groupBy("bucket", own.alias("own"), F.when(own, F.col("grp")).otherwise(OTHERS).alias("series")).agg(
        F.sum("value").alias("value"), F.coalesce(F.max("score"), F.lit(0.0)).alias("max_score")
    ).drop("own")


# --- grids and rankings -----------------------------------------------------------

def grid_keys(df: DataFrame, group_by: Sequence[str], bucket: str | None) -> tuple[DataFrame, list[str]]:
    if bucket:
        df = df.withColumn("bucket", bucket_epoch(F.col("ts"), bucket_seconds(bucket)))
    keys = [g for g in group_by if g in df.columns]
    keys = keys or (["bucket"] if bucket else [])
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df, keys


def grid_aggregate(df: DataFrame, group_by: Sequence[str], metric: str = "count", value: str | None = None, bucket: str | None = None) -> DataFrame:
    """One value per group, and the highest score where events are scored."""
    rows, keys = grid_keys(df, group_by, bucket)
    extra = [F.max("anom_score").alias("anom_score")] if "anom_score" in df.columns else []
    return rows.groupBy(*keys).agg(metric_column(metric, usable_value(df, value)).alias("value"), *extra)


def grid_anomaly_flag(grid: DataFrame, contamination: float = 0.05) -> DataFrame:
    """Groups whose highest score reaches the (1 - contamination) quantile over groups."""
    score = F.coalesce(F.col("anom_score"), F.lit(0.0))
    grid = materialize(grid, "grid")  # read twice; one row per group
    return grid.withColumn("anomaly", score >= quantile_scalar(grid, score, 1 - contamination))


def grid_top_reason(df: DataFrame, group_by: Sequence[str], bucket: str | None = None) -> DataFrame:
    rows, keys = grid_keys(df, group_by, bucket)
    best = top_codes(rows, keys, 1).select(*keys, F.col("code").alias("top_reason"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("value")).join(best, keys, "left")


def grid_rows(df: DataFrame, bucket: str, tz: str | None = None) -> DataFrame:
    """Raw rows with ``ts`` floored to the bucket, in a time zone when given."""
    return df.withColumn("ts", F.timestamp_seconds(bucket_epoch(F.col("ts"), bucket_seconds(bucket), tz)))


def top_values(df: DataFrame, fields: Sequence[str], n: int) -> DataFrame:
    """Most frequent (composite) values, their counts, and how many there are."""
    counts = df.groupBy(composite_key(df, fields).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    counts = counts.where(F.col("value").isNotNull())
    unique = counts.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.orderBy(F.desc("rows"), "value").limit(n).withColumn("total_unique", unique)


def value_frequencies(df: DataFrame, field: str) -> DataFrame:
    counts = df.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("value"))
    return counts.agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "value")


def topn_others(df: DataFrame, fields: Sequence[str], n: int, metric: str = "sum", value: str | None = None) -> DataFrame:
    """Top n groups and ``Others``: value, share, events, highest score, severity."""
    rows = df.withColumn("grp", composite_key(df, fields)).where(F.col("grp").isNotNull())
    totals = rows.groupBy("grp").agg(
        F.coalesce(metric_column(metric, usable_value(df, value)), F.lit(0.0)).alias("value"),
        F.count(F.lit(1)).alias("events"), F.max("anom_score").alias("max_score"),
    )
    totals = materialize(totals, "totals")
    names = totals.orderBy(F.desc("value"), "grp").limit(n).agg(F.collect_list("grp").alias("names")).scalar()
    own = F.array_contains(names, F.col("grp"))
    out = totals.groupBy(own.alias("own"), F.when(own, F.col("grp")).otherwise(OTHERS).alias("grp")).agg(
        F.sum("value").alias("value"), F.sum("events").alias("events"), F.max("max_score").alias("max_score")
    ).drop("own")
    # At most n + 1 rows from here on.
    total = F.sum("value").over(Window.partitionBy(F.lit(1)))
    return out.withColumn("percent", F.when(total != 0, F.col("value") / total * 100).otherwise(0.0)).withColumn(
        "severity", severity(F.col("max_score"))
    )


def severity_stats(scored: DataFrame) -> DataFrame:
    label = severity(F.col("anom_score"))
    counts = [F.count_if(label == name).alias(name) for name, _ in SEVERITY_FLOOR]
    return scored.agg(*counts, F.count_if(F.col("anom_score") >= SEVERITY_FLOOR[-1][1]).alias("total"))


def severity_filter(
    scored: DataFrame, severities: Sequence[str], min_score: float = 0.0, carrier: str | None = None,
    group: tuple[str, str] | None = None,
) -> DataFrame:
    """Events of the wanted severities; unscored ones below ``min_score`` are dropped."""
    out = scored.withColumn("severity", severity(F.col("anom_score")))
    out = out.where((F.col("anom_score") >= min_score) & F.col("severity").isin(list(severities)))
    if carrier:
        out = out.where(F.upper("carrier").contains(carrier.upper()))
    if group:
        out = out.where(F.col(group[0]).cast("string") == group[1])
    return out


def drill_down(scored: DataFrame, path: Sequence[tuple[str, str]], floor: float = 0.25, n: int = 50) -> DataFrame:
    """Best-scored events below a stack of group values, with their reason codes."""
    conds = [F.col(field).cast("string") == F.lit(value) for field, value in path]
    rows = scored.where(reduce(lambda a, b: a & b, conds, F.col("anom_score") >= floor))
    best = rows.orderBy(F.desc("anom_score"), "ts", "event_id").limit(n)
    return best.withColumn("codes", F.array_join(F.array_sort(F.array_distinct("reasons.code")), ","))


# --- routes and flows ---------------------------------------------------------------

def route_aggregate(scored: DataFrame, carrier: str | None = None) -> DataFrame:
    rows = scored.where(F.col("origin").isNotNull() & F.col("dest").isNotNull())
    if carrier:
        rows = rows.where(F.col("carrier") == carrier)
    return rows.groupBy("origin", "dest").agg(
        F.count(F.lit(1)).alias("events"), F.max("anom_score").alias("max_score"),
        F.sum("anom_score").alias("sum_score"), F.avg("anom_score").alias("avg_score"),
    )


def route_aggregate_users(scored: DataFrame) -> DataFrame:
    rows = scored.where(F.col("origin") != F.col("dest"))
    return rows.groupBy("origin", "dest").agg(
        F.count(F.lit(1)).alias("events"), F.avg("anom_score").alias("avg_score"),
        F.count_distinct("user_id").alias("users"),
    )


def route_positions(routes: DataFrame, places: DataFrame) -> DataFrame:
    """Coordinates of both ends; routes with an unknown end are dropped.

    ``places`` (code, lat, lon) is left to the optimizer, which broadcasts it
    when its size allows.
    """
    start = places.select(F.col("code").alias("origin"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"))
    end = places.select(F.col("code").alias("dest"), F.col("lat").alias("d_lat"), F.col("lon").alias("d_lon"))
    return routes.join(start, "origin").join(end, "dest")


def flow_links(
    scored: DataFrame, levels: Sequence[str], metric: str = "count", value: str | None = None,
    top_per_level: int = 10, min_link: float = 1.0,
) -> DataFrame:
    """Links between consecutive levels among each level's top values.

    One exploded pass feeds all level pairs. A value's weight is the sum over
    every pair that touches its level, so inner levels count twice.
    """
    pairs = list(zip(levels, levels[1:], strict=False))
    cells = F.array(*[
        F.struct(F.lit(i).alias("step"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
        for i, (a, b) in enumerate(pairs)
    ])
    kept = usable_value(scored, value)
    columns = ["anom_score"] + ([kept] if kept else [])
    exploded = scored.select(F.explode(cells).alias("c"), *columns).select("c.*", *columns)
    exploded = exploded.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    links = exploded.groupBy("step", "a", "b").agg(
        metric_column(metric, kept).alias("value"), F.max("anom_score").alias("max_score")
    )
    links = materialize(links, "flow")
    ends = links.select(
        F.explode(F.array(F.struct(F.col("step").alias("level"), F.col("a").alias("v")),
                          F.struct((F.col("step") + 1).alias("level"), F.col("b").alias("v")))).alias("e"), "value"
    ).groupBy("e.level", "e.v").agg(F.sum("value").alias("weight"))
    ranked = ends.withColumn("r", F.row_number().over(Window.partitionBy("level").orderBy(F.desc("weight"), "v")))
    top = ranked.where(F.col("r") <= top_per_level).select("level", "v")
    out = links.where(F.col("value") >= min_link)
    out = out.join(top.select(F.col("level").alias("step"), F.col("v").alias("a")), ["step", "a"], "left_semi")
    out = out.join(top.select((F.col("level") - 1).alias("step"), F.col("v").alias("b")), ["step", "b"], "left_semi")
    # Per pair at most top_per_level squared links are left.
    into = F.sum("value").over(Window.partitionBy("step", "b"))
    return out.withColumn("share", F.when(into != 0, F.col("value") / into).otherwise(0.0))


# --- scatter, bins -------------------------------------------------------------------

def regression_line(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """Slope, intercept and x range; NULL line with two points or fewer."""
    pts = df.select(x.cast("double").alias("x"), y.cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    n = F.count(F.lit(1))
    return pts.agg(
        n.alias("points"), F.when(n > 2, F.regr_slope("y", "x")).alias("slope"),
        F.when(n > 2, F.regr_intercept("y", "x")).alias("intercept"), F.min("x").alias("x_min"), F.max("x").alias("x_max"),
    )


def scatter_points(scored: DataFrame, n: int) -> DataFrame:
    return scored.orderBy(F.desc("anom_score"), "ts", "event_id").limit(n)


def nearest_whole(x: Column) -> Column:
    return F.floor(x + 0.5).cast("double")


def hex_cell(lat: Column, lon: Column, radius_km: float) -> tuple[Column, Column]:
    """Axial (q, r) of the pointy-top hexagon on a plane of kilometres."""
    x, y = lon * KM_PER_DEGREE, lat * KM_PER_DEGREE
    q = (x * (math.sqrt(3) / 3) - y / 3) / radius_km
    r = y * (2.0 / 3.0) / radius_km
    s = -q - r
    rq, rr, rs = nearest_whole(q), nearest_whole(r), nearest_whole(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    q_worst = (dq > dr) & (dq > ds)
    cell_q = F.when(q_worst, -rr - rs).otherwise(rq)
    cell_r = F.when(~q_worst & (dr > ds), -rq - rs).otherwise(rr)
    return cell_q.cast("bigint"), cell_r.cast("bigint")


def hex_bins(scored: DataFrame, radius_km: float, color_by: Sequence[str] = (), top_k: int = 5) -> DataFrame:
    """Events and mean score per hexagon, split by the top_k composite categories."""
    rows = scored.where(F.col("geo_lat").isNotNull() & F.col("geo_lon").isNotNull())
    q, r = hex_cell(F.col("geo_lat"), F.col("geo_lon"), radius_km)
    sums = [F.count(F.lit(1)).alias("events"), F.sum("anom_score").alias("total"), F.count("anom_score").alias("scored")]
    if color_by:
        key = F.concat_ws(" · ", *[F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in color_by])
        cells = materialize(rows.groupBy(q.alias("q"), r.alias("r"), key.alias("key")).agg(*sums), "hexes")
        top = cells.groupBy("key").agg(F.sum("events").alias("n")).orderBy(F.desc("n"), "key").limit(top_k)
        names = top.agg(F.collect_list("key").alias("names")).scalar()
        own = F.array_contains(names, F.col("key"))
        cells = cells.groupBy("q", "r", own.alias("own"), F.when(own, F.col("key")).otherwise(OTHERS).alias("category")).agg(
            *[F.sum(c).alias(c) for c in ("events", "total", "scored")])
    else:
        cells = rows.groupBy(q.alias("q"), r.alias("r"), F.lit("all").alias("category")).agg(*sums)
    mean = F.when(F.col("scored") > 0, F.col("total") / F.col("scored"))
    return cells.select("q", "r", "category", "events", mean.alias("mean_score"))


def geo_grid_clusters(scored: DataFrame, radius_km: float) -> DataFrame:
    """Square cells of the radius: centroid, mean score and size."""
    side = radius_km / KM_PER_DEGREE
    rows = scored.where(F.col("geo_lat").isNotNull() & F.col("geo_lon").isNotNull())
    return rows.groupBy(
        F.floor(F.col("geo_lat") / side).alias("cell_y"), F.floor(F.col("geo_lon") / side).alias("cell_x")
    ).agg(
        F.avg("geo_lat").alias("lat"), F.avg("geo_lon").alias("lon"),
        F.avg("anom_score").alias("mean_score"), F.count(F.lit(1)).alias("size"),
    )


def globe_events(scored: DataFrame, bucket: str, tz: str | None, contamination: float) -> DataFrame:
    """Located events with floored time, flagged from the score quantile upward."""
    rows = materialize(scored.where(F.col("geo_lat").isNotNull() & F.col("geo_lon").isNotNull()), "located")
    cut = quantile_scalar(rows, "anom_score", 1 - contamination)
    out = rows.withColumn("bucket", bucket_epoch(F.col("ts"), bucket_seconds(bucket), tz))
    return out.withColumn("high", F.col("anom_score") >= cut)

