"""Density clustering of events in space and time (DBSCAN) on a grid.

Cells have side eps / sqrt(3), so points of one cell are always within eps of
each other. Three facts follow and carry the whole job:

* a cell with ``min_samples`` points has only core points, nothing is compared;
* all core points of a cell share a cluster, so clusters are connected
  components of *cells*, not of points;
* whether two cells touch can mostly be told from their tight bounding boxes.
  Undecided pairs are split into halved boxes again and again, and points meet
  points only between boxes that hold a handful each.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.operators.graph import connected_components
from eventlens.operators.windows import range_numbered
from eventlens.session import materialize

AXES = ("x", "y", "z")
CELL = ["cx", "cy", "cz"]
# Boxes with at most this many point pairs are compared point by point.
SMALL = 4096
MAX_LEVEL = 60


def standardized(df: DataFrame) -> DataFrame:
    """(event_id, ts, x, y, z): latitude, longitude and minutes, mean 0 and deviation 1."""
    rows = df.where(F.col("geo_lat").isNotNull() & F.col("geo_lon").isNotNull() & F.col("ts").isNotNull())
    start = rows.agg(F.min(F.unix_micros("ts")).alias("t")).scalar()
    rows = rows.select(
        "event_id", "ts", F.col("geo_lat").alias("x"), F.col("geo_lon").alias("y"),
        ((F.unix_micros("ts") - start) / F.lit(60e6)).alias("z"),
    )
    stats = materialize(
        rows.agg(*[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("m", F.avg), ("s", F.stddev_pop))]), "scale"
    )
    scaled = {}
    for a in AXES:
        std = stats.select(f"s_{a}").scalar()
        scaled[a] = (F.col(a) - stats.select(f"m_{a}").scalar()) / F.when(std == 0, 1.0).otherwise(std)
    return rows.withColumns(scaled)


def cell_columns(side: float, level: int, names: list[str]) -> list[Column]:
    """Halving the side doubles the index exactly, so levels nest."""
    return [F.floor(F.col(a) / F.lit(side / 2**level)).alias(n) for a, n in zip(AXES, names, strict=True)]


def boxes(points: DataFrame, keys: list[str]) -> DataFrame:
    """Tight bounding box and number of points per cell."""
    aggs = [f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))]
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *aggs)


def _tag(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def box_distance(a: str, b: str) -> tuple[Column, Column]:
    """(smallest, largest) squared distance between two boxes."""
    near, far = F.lit(0.0), F.lit(0.0)
    for axis in AXES:
        alo, ahi, blo, bhi = (F.col(f"{p}{e}_{axis}") for p in (a, b) for e in ("lo", "hi"))
        gap = F.greatest(F.lit(0.0), blo - ahi, alo - bhi)
        reach = F.greatest(F.abs(bhi - alo), F.abs(ahi - blo))
        near, far = near + gap * gap, far + reach * reach
    return near, far


def point_box_distance(b: str) -> tuple[Column, Column]:
    near, far = F.lit(0.0), F.lit(0.0)
    for axis in AXES:
        lo, hi, v = F.col(f"{b}lo_{axis}"), F.col(f"{b}hi_{axis}"), F.col(axis)
        gap = F.greatest(F.lit(0.0), lo - v, v - hi)
        reach = F.greatest(F.abs(hi - v), F.abs(v - lo))
        near, far = near + gap * gap, far + reach * reach
    return near, far


def point_distance(a: str, b: str) -> Column:
    out = F.lit(0.0)
    for axis in AXES:
        gap = F.col(f"{a}{axis}") - F.col(f"{b}{axis}")
        out = out + gap * gap
    return out


def neighbour_cells(cells: DataFrame, half: bool = False) -> DataFrame:
    """Each cell with the keys (nx, ny, nz) of the cells that eps may reach."""
    steps = [d for d in product(range(-2, 3), repeat=3) if d > (0, 0, 0)] if half else list(product(range(-2, 3), repeat=3))
    offsets = F.array(*[F.struct(*[F.lit(v).alias(k) for v, k in zip(d, "xyz", strict=True)]) for d in steps])
    out = cells.withColumn("__o", F.explode(offsets))
    return out.withColumns({f"n{a}": F.col(f"c{a}") + F.col(f"__o.{a}") for a in AXES}).drop("__o")


def near_boxes(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Points with every box that eps may reach, as ``b_*`` columns."""
    others = _tag(cells, "b_")
    keys = neighbour_cells(points.select(*CELL).distinct())
    pairs = keys.join(others, [keys[f"n{a}"] == others[f"b_c{a}"] for a in AXES]).drop("nx", "ny", "nz")
    return points.join(pairs, CELL)


def core_points(points: DataFrame, cells: DataFrame, eps2: float, min_samples: int) -> DataFrame:
    """event ids of core points in thin cells; points there number below min_samples per cell."""
    thin = points.join(cells.where(F.col("n") < min_samples).select(*CELL), CELL)
    near, far = point_box_distance("b_")
    reached = near_boxes(thin, cells).withColumn("near", near).withColumn("far", far).where(F.col("near") <= eps2)
    # Boxes wholly inside eps count without looking at their points.
    sure = reached.groupBy("event_id").agg(F.sum(F.when(F.col("far") <= eps2, F.col("b_n")).otherwise(0)).alias("sure"))
    sure = materialize(sure, "sure")
    open_ids = sure.where(F.col("sure") < min_samples)
    doubtful = reached.where(F.col("far") > eps2).join(open_ids, "event_id", "left_semi")
    doubtful = doubtful.select("event_id", *AXES, *[f"b_{c}" for c in CELL])
    other = points.select(*[F.col(a).alias(f"q_{a}") for a in AXES], *[F.col(c).alias(f"b_{c}") for c in CELL])
    close = doubtful.join(other, [f"b_{c}" for c in CELL]).where(point_distance("", "q_") <= eps2)
    extra = close.groupBy("event_id").agg(F.count(F.lit(1)).alias("extra"))
    total = sure.join(extra, "event_id", "left")
    return total.where(F.col("sure") + F.coalesce("extra", F.lit(0)) >= min_samples).select("event_id")


def unconnected(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of cells that the sure links do not join already: only they matter."""
    joined = materialize(connected_components(links), "joined")
    a = joined.select(F.col("id").alias("source"), F.col("component").alias("ca"))
    b = joined.select(F.col("id").alias("target"), F.col("component").alias("cb"))
    labelled = pairs.join(a, "source", "left").join(b, "target", "left")
    apart = F.coalesce("ca", "source") != F.coalesce("cb", "target")
    return materialize(labelled.where(apart).drop("ca", "cb"), "apart")


def touching_cells(core: DataFrame, side: float, eps2: float) -> DataFrame:
    """(source, target): pairs of cells with core points within eps of each other.

    Pairs that other pairs connect anyway may be left out.
    """
    summary = boxes(core, CELL)
    keyed, right = _tag(neighbour_cells(summary, half=True), "a_"), _tag(summary, "b_")
    joined = keyed.join(right, [keyed[f"a_n{a}"] == right[f"b_c{a}"] for a in AXES])
    near, far = box_distance("a_", "b_")
    judged = joined.withColumn("near", near).withColumn("far", far).where(F.col("near") <= eps2)
    root = [F.concat_ws("_", *[F.col(f"{p}{c}") for c in CELL]).alias(n) for p, n in (("a_", "source"), ("b_", "target"))]
    judged = materialize(judged.select(
        *root, *[F.col(f"{p}{c}").alias(f"{p}{k}") for p in ("a_", "b_") for c, k in zip(CELL, ("kx", "ky", "kz"), strict=True)],
        "a_n", "b_n", "far",
    ), "touch0")
    found = judged.where(F.col("far") <= eps2).select("source", "target")
    open_pairs = judged.where(F.col("far") > eps2).drop("far")

    for level in range(1, MAX_LEVEL):
        names = ["kx", "ky", "kz"]
        # Few point pairs: compare the points themselves.
        at = core.select(*AXES, *cell_columns(side, level - 1, names))
        small = open_pairs.where(F.col("a_n") * F.col("b_n") <= SMALL)
        close = (
            small.join(_tag(at, "a_"), [f"a_{k}" for k in names]).join(_tag(at, "b_"), [f"b_{k}" for k in names])
            .where(point_distance("a_", "b_") <= eps2).select("source", "target").distinct()
        )
        found = found.unionByName(close)
        big = open_pairs.where(F.col("a_n") * F.col("b_n") > SMALL)
        if big.limit(1).count() == 0:
            break
        # Many: halve both boxes and judge the children.
        fine = core.select(*AXES, *cell_columns(side, level, names))
        kids = boxes(fine, names).withColumns({f"p{k}": F.floor(F.col(k) / 2) for k in names})
        a, b = _tag(kids, "a_"), _tag(kids, "b_")
        parents = big.select("source", "target", *[F.col(f"{p}{k}").alias(f"{p}p{k}") for p in ("a_", "b_") for k in names])
        split = parents.join(a, [f"a_p{k}" for k in names]).join(b, [f"b_p{k}" for k in names])
        near, far = box_distance("a_", "b_")
        split = split.withColumn("near", near).withColumn("far", far).where(F.col("near") <= eps2)
        split = materialize(split.select("source", "target", *[f"{p}{k}" for p in ("a_", "b_") for k in [*names, "n"]], "far"), f"touch{level}")
        sure = split.where(F.col("far") <= eps2).select("source", "target").distinct()
        found = materialize(found.unionByName(sure).distinct(), f"found{level}")
        # Half boxes of dense neighbours touch for sure, so most pairs end here.
        open_pairs = unconnected(split.where(F.col("far") > eps2).drop("far"), found)
    else:
        raise RuntimeError(f"boxes still open after {MAX_LEVEL} halvings")
    return found.distinct()


def geo_dbscan(df: DataFrame, eps: float = 0.7, min_samples: int = 15) -> DataFrame:
    """``cluster`` per event: -1 for noise and for events without place or time.

    Clusters are numbered by their first core event in (ts, event_id) order; a
    border event takes the smallest number within reach.
    """
    side, eps2 = eps / math.sqrt(3), eps * eps
    scaled = standardized(df)
    points = materialize(scaled.select("event_id", "ts", *AXES, *cell_columns(side, 0, CELL)), "points")
    cells = materialize(boxes(points, CELL), "cells")
    thick = points.join(cells.where(F.col("n") >= min_samples).select(*CELL), CELL, "left_semi")
    thin_core = points.join(core_points(points, cells, eps2, min_samples), "event_id", "left_semi")
    core = materialize(thick.unionByName(thin_core), "core")

    links = materialize(touching_cells(core.select(*AXES, *CELL), side, eps2), "links")
    linked = connected_components(links)
    key = F.concat_ws("_", *CELL)
    first = core.groupBy(*CELL).agg(F.min(F.struct("ts", "event_id")).alias("first")).withColumn("id", key)
    members = first.join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))
    starts = members.groupBy("component").agg(F.min("first").alias("first"))
    numbered = range_numbered(starts, ["first"], "cluster")
    cell_cluster = materialize(members.join(numbered.select("component", "cluster"), "component").select(*CELL, "cluster"), "cellcluster")

    core_labels = core.join(cell_cluster, CELL).select("event_id", "cluster")
    rest = points.join(cells.where(F.col("n") < min_samples).select(*CELL), CELL, "left_semi").join(
        core.select("event_id"), "event_id", "left_anti"
    )
    core_boxes = boxes(core, CELL).join(cell_cluster, CELL)
    near, _ = point_box_distance("b_")
    reach = near_boxes(rest, core_boxes).where(near <= eps2).select(
        "event_id", *AXES, *[f"b_{c}" for c in CELL], F.col("b_cluster").alias("cluster")
    )
    other = core.select(*[F.col(a).alias(f"q_{a}") for a in AXES], *[F.col(c).alias(f"b_{c}") for c in CELL])
    border = reach.join(other, [f"b_{c}" for c in CELL]).where(point_distance("", "q_") <= eps2)
    border = border.groupBy("event_id").agg(F.min("cluster").alias("cluster"))
    labels = materialize(core_labels.unionByName(border), "labels")
    total = points.agg(F.count(F.lit(1)).alias("n")).scalar()
    joined = df.join(labels, "event_id", "left")
    return joined.withColumn(
        "cluster", F.when(total >= min_samples, F.coalesce(F.col("cluster"), F.lit(-1))).otherwise(-1).cast("bigint")
    )


def cluster_summary(clustered: DataFrame) -> DataFrame:
    """Per cluster: size, centre, time span, and the number of noise events."""
    noise = clustered.agg(F.count_if(F.col("cluster") == -1).alias("n")).scalar()
    return clustered.where(F.col("cluster") >= 0).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), F.round(F.avg("geo_lat"), 4).alias("centroid_lat"),
        F.round(F.avg("geo_lon"), 4).alias("centroid_lon"), F.min("ts").alias("time_start"), F.max("ts").alias("time_end"),
    ).withColumn("noise_count", noise)
