"""Anomaly marking: per-user robust z on bucket series, and the forest-based mode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.scales import SENSITIVITY, bucket_epoch, bucket_seconds
from eventlens.operators import features as ft
from eventlens.operators.iforest import forest_scores
from eventlens.operators.joins import attach_stats
from eventlens.operators.quantiles import grouped_quantiles, quantile_scalar
from eventlens.session import materialize

REASON = "struct<code:string,value:double,thr:double,desc:string>"


def feature_value(df: DataFrame, feature: str) -> Column:
    """``count``, ``is_fail`` or a numeric column; anything else counts events."""
    if feature == "is_fail" and "event_type" in df.columns:
        return ft.is_failure(F.col("event_type"))
    if feature != "count" and feature in df.columns:
        return F.coalesce(F.col(feature).try_cast("double"), F.lit(0.0))
    return F.lit(1)


def sparse_robust_z(df: DataFrame, value: Column, bucket: str, alpha: float = 0.2) -> DataFrame:
    """mu, mad, z and score on the buckets that hold events, equal to the dense series'.

    The gap-filled series has users x buckets rows; almost all are zeros. Here they enter by their number: the
    exponential mean decays over a gap, the rolling median counts them, and the overall median of MADs weighs each
    run of equal MADs by its length.
    """
    series = ft.robust_runs(df, value, bucket, alpha)
    scored = ft.fill_mad(series.where(F.col("rows").isNotNull()), ft.positive_mad_median(series, F.col("run")), None)
    scored = ft.add_robust_z(scored)
    return scored.select("user_id", (F.col("p") * bucket_seconds(bucket)).alias("bucket"), "x", "rows", "mu", "mad", "z", "score")


def mark_anomalies(
    df: DataFrame, feature: str = "count", z_thr: float = 3.0, bucket: str = "1m", alpha: float = 0.2,
) -> DataFrame:
    """Events with anomaly, anom_score, reasons and explain (and ``zrobust``)."""
    base = ft.known(df, "user_id")
    scored = sparse_robust_z(base, feature_value(base, feature), bucket, alpha)
    out = base.withColumn("bucket", bucket_epoch(F.col("ts"), bucket_seconds(bucket)))
    out = attach_stats(
        out, scored.select("user_id", "bucket", "rows", F.col("z").alias("zrobust"), F.col("score").alias("anom_score")),
        ["user_id", "bucket"], F.col("event_id"), rows="rows",
    ).drop("rows", "bucket")
    flag = F.coalesce(F.abs("zrobust") >= z_thr, F.lit(False))
    desc = F.format_string(f"Robust z-score %.2f exceeds threshold {float(z_thr)}", F.col("zrobust"))
    reason = F.struct(
        F.lit("ROBUST_Z").alias("code"), F.col("zrobust").alias("value"), F.lit(float(z_thr)).alias("thr"), desc.alias("desc")
    ).cast(REASON)
    return (
        out.withColumn("anomaly", flag)
        .withColumn("anom_score", F.coalesce(F.col("anom_score"), F.lit(0.0)))
        .withColumn("reasons", F.when(flag, F.array(reason)).otherwise(F.array().cast(f"array<{REASON}>")))
        .withColumn("explain", F.when(flag, desc).otherwise(""))
    )


def preset_flags(df: DataFrame, feature: str = "count", bucket: str = "1h") -> DataFrame:
    """One flag per sensitivity preset, from a single scoring pass."""
    marked = mark_anomalies(df, feature, 3.0, bucket)
    flags = {
        f"anomaly_{name.lower()}": F.coalesce(F.abs("zrobust") >= z, F.lit(False)) for name, (z, _) in SENSITIVITY.items()
    }
    return marked.withColumns(flags)


# --- explanations of the feature mode -------------------------------------------

def _reason(code: str, value: Column | None, thr: Column | None, desc: Column) -> Column:
    empty = F.lit(None).cast("double")
    return F.struct(
        F.lit(code).alias("code"),
        (empty if value is None else value.cast("double")).alias("value"),
        (empty if thr is None else thr.cast("double")).alias("thr"),
        desc.alias("desc"),
    )


def add_reasons(
    features: DataFrame, speed_kmh_thr: float = 900.0, dist_km_thr: float = 2000.0,
    contamination: float = 0.05, with_forest: bool = True,
) -> DataFrame:
    c = F.col
    rules = []
    if with_forest:
        rules.append((c("anomaly"), _reason("IF_OUTLIER", c("anom_score"), F.lit(contamination), F.lit("IsolationForest outlier"))))
    # Codes and texts of the reasons, as viewers show them.
    far_text = F.format_string(f"Distance from home %.0fkm exceeds {dist_km_thr}km", c("dist_home_km"))
    jump_text = F.format_string("Geographic jump %.0fkm at %.0fkm/h", c("dist_prev_km"), c("speed_kmh"))
    rate_text = F.format_string(
        "Event rate %.1f events/min abnormally high (typical: %.1f)", c("event_velocity"), c("event_velocity_mean")
    )
    usual_top = c("event_velocity_mean") + 3 * c("event_velocity_std")
    rules += [
        (c("dist_home_km") > dist_km_thr, _reason("FAR_FROM_HOME", c("dist_home_km"), F.lit(dist_km_thr), far_text)),
        (
            c("speed_kmh").isNotNull() & ((c("dist_prev_km") > dist_km_thr) | (c("speed_kmh") > speed_kmh_thr)),
            _reason("GEO_JUMP", c("dist_prev_km"), F.lit(dist_km_thr), jump_text),
        ),
        (c("event_velocity_z") > 3.0, _reason("HIGH_EVENT_VELOCITY", c("event_velocity"), usual_top, rate_text)),
        (
            (c("is_new_device") == 1) | (c("is_new_device_rolling") == 1),
            _reason("NEW_DEVICE", None, None, F.lit("First or rarely seen device for this user")),
        ),
        (
            (c("is_new_ip") == 1) | (c("is_new_ip_rolling") == 1),
            _reason("NEW_IP", None, None, F.lit("First or rarely seen IP for this user")),
        ),
    ]
    found = F.array_compact(F.array(*[F.when(cond, reason) for cond, reason in rules]))
    return features.withColumn("reasons", found).withColumn(
        "explain", F.array_join(F.transform("reasons", lambda r: r["desc"]), "; ")
    )


def advanced_anomalies(
    df: DataFrame, contamination: float = 0.05, speed_kmh_thr: float = 900.0, dist_km_thr: float = 2000.0,
    trees: int = 200, sample: int = 256, seed: int = 42, keep: Sequence[str] | None = None,
) -> DataFrame:
    """Events with features, forest score in 0..1, flag and reasons; ``keep`` as in ``behaviour_features``."""
    features = ft.behaviour_features(df, keep)
    raw = materialize(forest_scores(features, ft.imputed(features), trees, sample, seed), "forest")
    cuts = materialize(
        grouped_quantiles(raw, [], "raw", {"p2": 0.02, "p98": 0.98, "cut": 1.0 - contamination}), "cuts"
    )
    cut = {name: cuts.select(name).scalar() for name in cuts.columns}
    spread = cut["p98"] - cut["p2"]
    extent = raw.agg((F.max("raw") - F.min("raw") + 1e-9).alias("e")).scalar()
    rows = raw.agg(F.count(F.lit(1)).alias("n")).scalar()
    enough = rows >= 10
    scaled = (F.col("raw") - cut["p2"]) / F.when(spread > 1e-9, spread).otherwise(extent)
    scored = raw.withColumns({
        "anom_score": F.when(enough, F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))).otherwise(0.0),
        "anomaly": enough & (F.col("raw") > cut["cut"]),
    }).drop("raw")
    return add_reasons(scored, speed_kmh_thr, dist_km_thr, contamination)


def run_stats(scored: DataFrame) -> DataFrame:
    """Rows, anomalies, rate and score summary of one run."""
    p95 = quantile_scalar(scored, "anom_score", 0.95)
    return scored.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if("anomaly").alias("anomalies"),
        F.avg(F.col("anomaly").cast("double")).alias("anomaly_rate"),
        F.avg("anom_score").alias("score_mean"),
        F.max("anom_score").alias("score_max"),
        F.min("anom_score").alias("score_min"),
    ).withColumn("score_p95", p95)
