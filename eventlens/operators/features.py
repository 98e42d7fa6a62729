"""Per-user behaviour features of events (geo, time, novelty, velocity, failures)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.scales import bucket_epoch, bucket_seconds, haversine_km, sigmoid
from eventlens.operators.joins import attach_stats, null_safe_join
from eventlens.operators.quantiles import column_medians, grouped_quantiles, largest_group, quantile_scalar
from eventlens.operators.rolling import every_position, ewma_reach, rolling_series, row_series
from eventlens.operators.windows import (
    Heavy,
    with_first_seen,
    with_previous,
    with_recent_repeat,
    with_rolling_count,
    with_row_number,
)
from eventlens.session import materialize

MAD_SCALE = 1.4826
EPSILON = 1e-6
NOVELTY_WINDOW = 30
VELOCITY_SECONDS = 300
# Minutes of a user up to which one task walks the whole series.
SERIES_ROWS = 100_000
UNKNOWN = "unknown"


def known(df: DataFrame, *columns: str) -> DataFrame:
    """Missing identities become one named value, as the features expect."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) for c in columns})


def is_failure(event_type: Column) -> Column:
    return F.coalesce(F.lower(event_type).contains("fail"), F.lit(False)).cast("int")


# --- geography ----------------------------------------------------------------

def add_previous_position(df: DataFrame, heavy: Heavy | None = None) -> DataFrame:
    return with_previous(df, "user_id", {"lat_prev": "geo_lat", "lon_prev": "geo_lon", "ts_prev": "ts"}, heavy)


def add_travel(df: DataFrame) -> DataFrame:
    """``dist_prev_km`` and ``speed_kmh``; no speed where no time passed."""
    hours = (F.unix_micros("ts") - F.unix_micros("ts_prev")) / F.lit(3.6e9)
    return df.withColumn(
        "dist_prev_km",
        haversine_km(F.col("geo_lat"), F.col("geo_lon"), F.col("lat_prev"), F.col("lon_prev")),
    ).withColumn("speed_kmh", F.col("dist_prev_km") / F.when(hours != 0, hours))


def user_homes(df: DataFrame) -> DataFrame:
    """Median position per user; both axes in one quantile job."""
    axes = F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).alias("v")) for c in ("geo_lat", "geo_lon")])
    long = df.select("user_id", F.explode(axes).alias("a")).select("user_id", "a.axis", "a.v")
    middle = grouped_quantiles(long, ["user_id", "axis"], "v", {"middle": 0.5})

    def of(axis: str) -> Column:
        return F.max(F.when(F.col("axis") == axis, F.col("middle")))

    return middle.groupBy("user_id").agg(of("geo_lat").alias("home_lat"), of("geo_lon").alias("home_lon"))


def user_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id").agg(F.count(F.lit(1)).alias("user_rows"))


def add_home(df: DataFrame, heavy: Heavy | None = None) -> DataFrame:
    """Home position and distance from it.

    Users of ordinary size get their median within the user's partition; heavy
    users get it from the zoned quantiles, attached with salt.
    """
    heavy = heavy or Heavy(df, "user_id")

    def plain(rows: DataFrame) -> DataFrame:
        whole = Window.partitionBy("user_id")
        return rows.withColumns({
            f"home_{a}": F.percentile(f"geo_{a}", F.lit(0.5)).over(whole) for a in ("lat", "lon")
        })

    def salted(rows: DataFrame) -> DataFrame:
        stats = user_totals(rows).join(user_homes(rows), "user_id", "left")
        return attach_stats(rows, stats, ["user_id"], F.col("event_id"), rows="user_rows").drop("user_rows")

    return heavy.split(df, plain, salted).withColumn(
        "dist_home_km",
        haversine_km(F.col("geo_lat"), F.col("geo_lon"), F.col("home_lat"), F.col("home_lon")),
    )


# --- time of day --------------------------------------------------------------

def hour_profile(df: DataFrame) -> DataFrame:
    """(user, hour): rows, share of the user's rows, -ln of the share."""
    counts = df.groupBy("user_id", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("hour_rows"))
    # At most 24 rows per user.
    total = F.sum("hour_rows").over(Window.partitionBy("user_id"))
    return counts.withColumn("hour_prob", F.col("hour_rows") / total).withColumn(
        "hour_rarity", rarity(F.col("hour_prob"))
    )


def add_hour_rarity(df: DataFrame, heavy: Heavy | None = None) -> DataFrame:
    heavy = heavy or Heavy(df, "user_id")

    def plain(rows: DataFrame) -> DataFrame:
        mine = Window.partitionBy("user_id")
        # Over the whole hour; ordered, so that rows come out in the order of time.
        at_hour = Window.partitionBy("user_id", "hour").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumn("hour_prob", F.count(F.lit(1)).over(at_hour) / F.count(F.lit(1)).over(mine))
        return rows.withColumn("hour_rarity", rarity(F.col("hour_prob")))

    def salted(rows: DataFrame) -> DataFrame:
        return attach_stats(rows, hour_profile(rows), ["user_id", "hour"], F.col("event_id"), rows="hour_rows").drop("hour_rows")

    return heavy.split(df.withColumn("hour", F.hour("ts")), plain, salted)


def rarity(prob: Column) -> Column:
    return -F.log(F.greatest(prob, F.lit(1e-6)))


def add_hour_circle(df: DataFrame) -> DataFrame:
    angle = F.lit(2 * math.pi) * (F.hour("ts") / F.lit(24.0))
    return df.withColumns({"h_sin": F.sin(angle), "h_cos": F.cos(angle)})


# --- velocity -----------------------------------------------------------------

def add_event_velocity(df: DataFrame, heavy: Heavy | None = None) -> DataFrame:
    """Events per minute over the last five minutes, this event included."""
    counted = with_rolling_count(df, "user_id", VELOCITY_SECONDS, "__recent", heavy)
    return counted.withColumn("event_velocity", F.col("__recent") / F.lit(VELOCITY_SECONDS / 60.0)).drop("__recent")


def add_velocity_z(df: DataFrame, heavy: Heavy | None = None) -> DataFrame:
    """How unusual the velocity is for the user; needs ``event_velocity``."""
    heavy = heavy or Heavy(df, "user_id")

    def floor_one(std: Column) -> Column:
        return F.coalesce(F.when(std != 0, std), F.lit(1.0))

    def plain(rows: DataFrame) -> DataFrame:
        mine = Window.partitionBy("user_id")
        return rows.withColumns({
            "event_velocity_mean": F.avg("event_velocity").over(mine),
            "event_velocity_std": floor_one(F.stddev_samp("event_velocity").over(mine)),
        })

    def salted(rows: DataFrame) -> DataFrame:
        stats = rows.groupBy("user_id").agg(
            F.count(F.lit(1)).alias("user_rows"), F.avg("event_velocity").alias("event_velocity_mean"),
            floor_one(F.stddev_samp("event_velocity")).alias("event_velocity_std"),
        )
        return attach_stats(rows, stats, ["user_id"], F.col("event_id"), rows="user_rows").drop("user_rows")

    return heavy.split(df, plain, salted).withColumn(
        "event_velocity_z",
        (F.col("event_velocity") - F.col("event_velocity_mean")) / (F.col("event_velocity_std") + EPSILON),
    )


# --- novelty ------------------------------------------------------------------

def add_first_seen(df: DataFrame, heavy: Heavy | None = None) -> DataFrame:
    return with_first_seen(df, "user_id", {"is_new_device": F.col("device_id"), "is_new_ip": F.col("ip")}, heavy)


def add_rolling_novelty(df: DataFrame, heavy: Heavy | None = None, window: int = NOVELTY_WINDOW) -> DataFrame:
    heavy = heavy or Heavy(df, "user_id")
    numbered = with_row_number(df, "user_id", "__rn", heavy)
    values = {"is_new_device_rolling": F.col("device_id"), "is_new_ip_rolling": F.col("ip")}
    return with_recent_repeat(numbered, "user_id", "__rn", values, window, heavy).drop("__rn")


def add_novelty(df: DataFrame, heavy: Heavy) -> DataFrame:
    """``add_first_seen`` and ``add_rolling_novelty`` for rows that have their number ``__rn``, which is dropped.

    Both flags of a value are read off one order of its rows.
    """
    order = ("__rn",) if heavy.values is None else ("ts", "event_id")
    for name, column in (("device", "device_id"), ("ip", "ip")):
        df = with_first_seen(df, "user_id", {f"is_new_{name}": F.col(column)}, heavy, order)
        df = with_recent_repeat(df, "user_id", "__rn", {f"is_new_{name}_rolling": F.col(column)}, NOVELTY_WINDOW, heavy)
    return df.drop("__rn")


def add_global_rarity(df: DataFrame, columns: Mapping[str, str], source: DataFrame | None = None) -> DataFrame:
    """``new name: column``: -ln((rows with the value + 1) / (rows + 1))."""
    source = source or df
    total = source.agg(F.count(F.lit(1)).alias("n")).scalar()
    for name, column in columns.items():
        counts = source.groupBy(column).agg(F.count(F.lit(1)).alias("__rows"))
        stats = counts.withColumn(name, -F.log((F.col("__rows") + 1) / (total + F.lit(1))))
        df = attach_stats(df, stats, [column], F.col("event_id"), rows="__rows").drop("__rows")
    return df


# --- bucket series ------------------------------------------------------------

def bucket_values(df: DataFrame, value: Column, seconds: int) -> DataFrame:
    """Sparse (user, bucket) sums, combined map-side; ``rows`` counts events. NULL, NaN and infinities add nothing."""
    number = value.cast("double")
    finite = ~F.isnan(number) & (F.abs(number) != float("inf"))
    return df.groupBy("user_id", bucket_epoch(F.col("ts"), seconds).alias("bucket")).agg(
        F.sum(F.when(finite, number).otherwise(0.0)).alias("x"), F.count(F.lit(1)).alias("rows")
    )


def bucket_grid(sparse: DataFrame, seconds: int) -> DataFrame:
    """Every bucket between a user's first and last, zero where nothing happened."""
    spans = sparse.groupBy("user_id").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    grid = spans.select("user_id", F.explode(F.sequence("lo", "hi", F.lit(seconds).cast("bigint"))).alias("bucket"))
    joined = grid.join(sparse.select("user_id", "bucket", "x"), ["user_id", "bucket"], "left")
    return joined.withColumn("x", F.coalesce(F.col("x"), F.lit(0.0)))


def add_ewma(series: DataFrame, alpha: float = 0.2, index: Column | None = None) -> DataFrame:
    """``mu``: exponential mean seeded with the first value, per user by bucket.

    ``index`` counts buckets from the user's first one and may skip buckets
    without a value; by default rows follow each other. Linear in the rows: a
    running sum of values scaled up by the decay, then scaled down again,
    restarted every few hundred buckets so that the scale stays within a double.
    A restart needs the block before it only, since what lies further back
    weighs less than 1e-60.
    """
    block, keep = 4 * ewma_reach(alpha), 1 - alpha
    by_user = Window.partitionBy("user_id")
    position = F.row_number().over(by_user.orderBy("bucket")) - 1 if index is None else index
    numbered = series.withColumn("__i", position.cast("bigint"))
    numbered = numbered.withColumn("__block", F.floor(F.col("__i") / F.lit(block)).cast("bigint"))
    numbered = numbered.withColumn("__at", (F.col("__i") % F.lit(block)).cast("double"))
    term = F.coalesce("x", F.lit(0.0)) * F.when(F.col("__i") == 0, 1.0).otherwise(alpha)
    running = Window.partitionBy("user_id", "__block").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.sum(term * F.pow(F.lit(keep), -F.col("__at"))).over(running) * F.pow(F.lit(keep), F.col("__at"))
    last_block = by_user.orderBy("__block").rangeBetween(-1, -1)
    ending = F.sum(term * F.pow(F.lit(keep), F.lit(block - 1.0) - F.col("__at"))).over(last_block)
    carried = F.coalesce(ending, F.lit(0.0)) * F.pow(F.lit(keep), F.col("__at") + 1)
    return numbered.withColumn("mu", inside + carried).drop("__i", "__block", "__at")


def mad_window(seconds: int) -> tuple[int, int]:
    """(window, min periods): about one day of buckets."""
    window = max(3, int(1440 / (seconds / 60)))
    return window, max(3, window // 48)


def robust_runs(df: DataFrame, value: Column, bucket: str, alpha: float = 0.2) -> DataFrame:
    """The gap-filled bucket series as runs of equal rolling MAD (``rolling.rolling_series``), ``p`` counting buckets.

    ``mad_raw`` is the rolling median of |x - the user's median|, NULL while too short.
    """
    seconds = bucket_seconds(bucket)
    sparse = bucket_values(df, value, seconds).where("bucket IS NOT NULL")
    sparse = sparse.select("user_id", F.floor(F.col("bucket") / F.lit(seconds)).alias("b"), "x", "rows")
    return materialize(rolling_series(materialize(sparse, "buckets"), *mad_window(seconds), alpha), "runs")


def positive_mad_median(series: DataFrame, weight: Column | None = None) -> Column:
    """Median of the positive MADs over all users, 1.0 when there is none."""
    middle = quantile_scalar(series.where(F.col("mad_raw") > 0), "mad_raw", 0.5, weight)
    return F.coalesce(middle, F.lit(1.0))


def fill_mad(series: DataFrame, fallback: Column, missing: float | None) -> DataFrame:
    mad = F.when(F.col("mad_raw") == 0, fallback).otherwise(F.col("mad_raw"))
    return series.withColumn("mad", mad if missing is None else F.coalesce(mad, F.lit(missing)))


def add_robust_z(series: DataFrame) -> DataFrame:
    z = (F.col("x") - F.col("mu")) / (F.lit(MAD_SCALE) * (F.col("mad") + EPSILON))
    return series.withColumn("z", z).withColumn("score", sigmoid(F.abs("z")))


def dense_robust_z(df: DataFrame, value: Column, bucket: str, alpha: float = 0.2, missing: float | None = None) -> DataFrame:
    """The gap-filled series with mu, mad_raw, mad, z and score on every bucket."""
    series = robust_runs(df, value, bucket, alpha)
    fallback = positive_mad_median(series, F.col("run"))
    every = every_position(series, alpha).withColumn("bucket", F.col("p") * bucket_seconds(bucket)).drop("p")
    return add_robust_z(fill_mad(every, fallback, missing))


def failure_spikes(df: DataFrame) -> DataFrame:
    """Robust z of failures per (user, minute with events); the series stays sparse, windows count its rows."""
    per_minute = materialize(bucket_values(df, is_failure(F.col("event_type")), 60).where("bucket IS NOT NULL"), "minutes")
    if largest_group(per_minute, ["user_id"]) <= SERIES_ROWS:
        scaled = row_series(per_minute, "bucket", 1440, 30, 0.2)
    else:
        ordered = per_minute.withColumn("at", F.timestamp_seconds("bucket"))
        numbered = with_row_number(ordered, "user_id", "b", order=("at",)).drop("at")
        numbered = materialize(numbered, "numbered")
        series = rolling_series(numbered.select("user_id", "b", "x", "rows"), 1440, 30, 0.2)
        scaled = null_safe_join(series.withColumnRenamed("p", "b").drop("x", "rows"), numbered, ["user_id", "b"]).drop("b", "run")
    scaled = materialize(scaled, "spike")
    return add_robust_z(fill_mad(scaled, positive_mad_median(scaled), 1.0)).withColumnRenamed("z", "z_fail")


def add_failure_spikes(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    spikes = failure_spikes(source or df).select("user_id", F.col("bucket").alias("__minute"), "z_fail", "rows")
    out = df.withColumn("__minute", bucket_epoch(F.col("ts"), 60))
    out = attach_stats(out, spikes, ["user_id", "__minute"], F.col("event_id"), rows="rows").drop("rows", "__minute")
    return out.withColumn("z_fail", F.coalesce(F.col("z_fail"), F.lit(0.0)))


def trailing_z(series: DataFrame, rows: int = 20, z_thr: float = 3.0) -> DataFrame:
    """One-sided z against the preceding ``rows`` rows of the series."""
    frame = Window.partitionBy("user_id").orderBy("bucket").rowsBetween(-rows, -1)
    mean, std = F.avg("x").over(frame), F.stddev_samp("x").over(frame)
    scored = series.withColumn("z", F.when(std > 0, (F.col("x") - mean) / std).otherwise(F.lit(0.0)))
    return scored.withColumn("z", F.coalesce(F.col("z"), F.lit(0.0))).withColumn(
        "score", sigmoid(F.col("z"))
    ).withColumn("anomaly", F.col("z") > z_thr)


# --- the whole matrix ---------------------------------------------------------

FEATURES = [
    "dist_prev_km", "dist_home_km", "speed_kmh", "event_velocity", "event_velocity_z",
    "is_new_device", "is_new_ip", "is_new_device_rolling", "is_new_ip_rolling",
    "device_rarity_global", "ip_rarity_global", "hour_rarity", "h_sin", "h_cos", "z_fail",
]


#: Columns that the features are made of.
NEEDED = ["event_id", "ts", "event_type", "user_id", "device_id", "ip", "geo_lat", "geo_lon"]


def behaviour_features(df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """All features side by side, with all columns of ``df`` and what the features are made of; given ``keep``, only event_id, what
    scores and reasons read, and these columns of ``df``.

    For users of ordinary size the whole per-user part runs in one shuffle by user. Statistics of other keys are attached before, while
    rows are narrow. They read the input, so only the result is written; with ``keep`` the narrow input is written, too, as it is read many times.
    """
    base = known(df, "user_id", "device_id", "ip")
    if keep is not None:
        base = materialize(base.select(*dict.fromkeys([*NEEDED, *keep])), "events")
    heavy = Heavy(base, "user_id")

    def per_user(rows: DataFrame, size: Heavy) -> DataFrame:
        rows = add_travel(add_previous_position(rows, size))
        rows = add_event_velocity(with_row_number(rows, "user_id", "__rn", size), size)
        if size.values is None:
            # What is ordered by time comes first, so that rows are sorted once for all of it.
            return add_hour_circle(add_hour_rarity(add_novelty(add_home(add_velocity_z(rows, size), size), size), size))
        rows = materialize(add_novelty(rows, size), "ordered")  # the salted statistics read it twice
        return add_hour_circle(add_hour_rarity(add_velocity_z(add_home(rows, size), size), size))

    out = add_global_rarity(base, {"device_rarity_global": "device_id", "ip_rarity_global": "ip"}, base)
    out = per_user(add_failure_spikes(out, base), heavy)
    if keep is not None:
        out = out.select(*dict.fromkeys(["event_id", *FEATURES, "event_velocity_mean", "event_velocity_std", *keep]))
    return materialize(out, "features")


def finite(name: str) -> Column:
    c = F.col(name).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def imputed(features: DataFrame, names: list[str] = FEATURES) -> dict[str, Column]:
    """The matrix columns: infinities and gaps replaced by the column's median, else 0."""
    clean = features.select(*[finite(n).alias(n) for n in names])
    medians = column_medians(clean, names)
    return {n: F.coalesce(finite(n), F.lit(medians[n]), F.lit(0.0)) for n in names}


def feature_matrix(features: DataFrame, names: list[str] = FEATURES) -> DataFrame:
    """(event_id, features) without gaps."""
    return features.select("event_id", *[c.alias(n) for n, c in imputed(features, names).items()])
