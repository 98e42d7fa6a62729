"""Small shared column formulas: buckets, severity, distance, sigmoid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket labels in seconds.
BUCKET_SECONDS = {
    "30s": 30, "1m": 60, "2m": 120, "5m": 300, "10m": 600, "15m": 900,
    "30m": 1800, "1h": 3600, "3h": 10800, "6h": 21600, "12h": 43200, "1d": 86400,
}

# Severity thresholds, highest first.
SEVERITY_FLOOR = [("critical", 0.9), ("high", 0.75), ("medium", 0.5), ("low", 0.25)]
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "normal": 0}

# Sensitivity presets as (z threshold, contamination).
SENSITIVITY = {"High": (2.0, 0.10), "Balanced": (3.0, 0.05), "Low": (5.0, 0.02)}

EARTH_RADIUS_KM = 6371.0088


def bucket_seconds(label: str) -> int:
    return BUCKET_SECONDS.get(label, 60)


def bucket_epoch(ts: Column, seconds: int, tz: str | None = None) -> Column:
    """Epoch second of the bucket start; with ``tz`` buckets follow local time."""
    if tz:
        local = F.unix_seconds(F.from_utc_timestamp(ts, tz))
        floored = F.timestamp_seconds(local - F.pmod(local, F.lit(seconds)))
        return F.unix_seconds(F.to_utc_timestamp(floored, tz))
    epoch = F.unix_seconds(ts)
    return epoch - F.pmod(epoch, F.lit(seconds))


def severity(score: Column) -> Column:
    label = F.lit("normal")
    for name, floor in reversed(SEVERITY_FLOOR):
        label = F.when(score >= floor, name).otherwise(label)
    return label


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat = F.radians(lat2 - lat1) / 2
    dlon = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    # greatest/least skip NULL, so a missing coordinate must be kept missing.
    clipped = F.when(chord.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), chord)))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(clipped))
