"""Isolation forest (Liu, Ting and Zhou, 2008) with training and scoring on Spark.

Training needs ``trees x sample`` rows however large the input: each tree gets a
sample chosen by its own hash and is grown in its own task. The grown forest is
bounded by the same two parameters, so it can be shipped to every task, where rows
are scored in Arrow batches. Depths are normed by the rows that a tree has.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

EULER_GAMMA = 0.5772156649015329
NODE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, depth double, rows int"


def expected_path(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` keys."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER_GAMMA) - 2.0 * (n - 1) / n


def grow(points: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes as (id, feature, cut, left, right, depth); leaves have feature -1."""
    nodes: list[tuple] = []
    pending = [(0, np.arange(len(points)), 0)]
    next_id = 1
    while pending:
        node, members, depth = pending.pop()
        part = points[members]
        open_features = np.flatnonzero(np.ptp(part, axis=0) > 0) if len(members) > 1 else ()
        if depth >= limit or len(open_features) == 0:
            nodes.append((node, -1, 0.0, -1, -1, depth + expected_path(len(members))))
            continue
        feature = int(rng.choice(open_features))
        cut = float(rng.uniform(part[:, feature].min(), part[:, feature].max()))
        goes_left = part[:, feature] <= cut
        left, right = next_id, next_id + 1
        next_id += 2
        nodes.append((node, feature, cut, left, right, 0.0))
        pending.append((left, members[goes_left], depth + 1))
        pending.append((right, members[~goes_left], depth + 1))
    return nodes


def sample_rows(matrix: DataFrame, trees: int, sample: int, seed: int) -> DataFrame:
    """Rows with their ``tree``: about ``trees x sample`` in all, chosen by hash.

    Every task decides by itself which of its rows are in, and for which trees; each tree has its own draw, so trees may
    share rows. A single hash says how many trees pass over a row before the first that takes it (a geometric skip); rows
    that all pass over go before anything is repeated.
    """
    # Half as many again, since hashing deals unevenly; a tree drops its surplus.
    share = min(1.5 * sample / max(matrix.count(), 1), 1.0)
    steps = 1 << 53

    def uniform(*what: Column) -> Column:
        return (F.pmod(F.xxhash64("event_id", *what, F.lit(seed)), F.lit(steps)) + 1) / F.lit(float(steps))

    first = F.lit(0) if share >= 1.0 else F.floor(F.log(uniform()) / F.lit(math.log1p(-share)))
    drawn = matrix.withColumn("__first", first.cast("int")).where(F.col("__first") < trees)
    later = F.filter(F.sequence(F.col("__first"), F.lit(trees - 1)), lambda t: (t == F.col("__first")) | (uniform(t) <= share))
    return drawn.withColumn("tree", F.explode(later)).drop("__first")


def train_forest(matrix: DataFrame, columns: list[str], trees: int, sample: int, seed: int) -> DataFrame:
    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        rng = np.random.default_rng([seed, tree])
        rows = rows.sort_values("event_id")
        points = rows[columns].to_numpy(dtype=float)
        if len(points) > sample:
            points = points[rng.choice(len(points), sample, replace=False)]
        limit = math.ceil(math.log2(max(len(points), 2)))
        nodes = [(tree, *node, len(points)) for node in grow(points, rng, limit)]
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "left", "right", "depth", "rows"])

    return sample_rows(matrix, trees, sample, seed).groupBy("tree").applyInPandas(build, NODE_SCHEMA)


#: A tree as arrays over its nodes: feature, cut, left child (the right one follows), levels, normed depth.
Flat = tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]


def flattened(nodes: pd.DataFrame) -> Flat:
    """One tree in the order of its node numbers; leaves lead to themselves, so that all rows may take the same number of steps."""
    feature, left = nodes["feature"].to_numpy(np.intp), nodes["left"].to_numpy(np.intp)
    leaf, own = feature < 0, np.arange(len(nodes))
    level = np.zeros(len(nodes), int)
    for i in own[~leaf]:  # children have higher numbers
        level[left[i]] = level[left[i] + 1] = level[i] + 1
    depth = nodes["depth"].to_numpy() / expected_path(int(nodes["rows"].iloc[0]))
    return np.where(leaf, 0, feature), np.where(leaf, np.inf, nodes["cut"].to_numpy()), np.where(leaf, own, left), int(level.max()), depth


def mean_depths(points: np.ndarray, forest: list[Flat]) -> np.ndarray:
    """Mean over the trees of each row's normed depth, 1 without a tree. NaN goes to the right like a value above all cuts."""
    n, width = points.shape
    if not forest or not n:
        return np.ones(n)
    values, row = np.where(np.isnan(points), np.inf, points).ravel(), np.arange(n) * width
    at, step, x, c, right = np.empty(n, np.intp), np.empty(n, np.intp), np.empty(n), np.empty(n), np.empty(n, bool)
    depth = np.zeros(n)
    for feature, cut, left, levels, leaf_depth in forest:
        at[:] = 0
        for _ in range(levels):
            # With mode "clip" numpy writes into ``out`` at once; no index is out of bounds.
            np.take(feature, at, out=step, mode="clip")
            step += row
            np.take(values, step, out=x, mode="clip")
            np.take(cut, at, out=c, mode="clip")
            np.greater(x, c, out=right)
            np.take(left, at, out=step, mode="clip")
            np.add(step, right, out=at)
        np.take(leaf_depth, at, out=x, mode="clip")
        depth += x
    return depth / len(forest)


def forest_scores(
    df: DataFrame, columns: Mapping[str, Column] | Sequence[str], trees: int = 200, sample: int = 256, seed: int = 42,
) -> DataFrame:
    """``df`` with ``raw``: 2 ** -(mean over trees of depth / expected depth), higher is more unusual.

    ``columns`` are the features' names, or names with the Columns to compute them.
    Trees of a single row can't tell rows apart and are passed over; without any other tree all rows get 0.5.
    """
    features = columns if isinstance(columns, Mapping) else {n: F.col(n) for n in columns}
    columns = list(features)
    matrix = df.select("event_id", *[c.cast("double").alias(n) for n, c in features.items()])
    spark = df.sparkSession
    # At most trees x (2 x sample) small rows.
    model = train_forest(matrix, columns, trees, sample, seed).toPandas()
    packed = [flattened(part) for _, part in model[model["rows"] > 1].sort_values(["tree", "node"]).groupby("tree")]
    shipped = spark.sparkContext.broadcast(packed)

    def score(*values: pa.Array) -> pa.Array:
        return pa.array(2.0 ** -mean_depths(np.column_stack([x.to_numpy(zero_copy_only=False) for x in values]), shipped.value))

    # Only the features go to Python. Not to be evaluated again where a plan moves or repeats the column.
    scorer = F.arrow_udf(score, DoubleType()).asNondeterministic()
    return df.withColumn("raw", scorer(*[c.cast("double") for c in features.values()]))
