"""Entity link graph: edges, nodes, communities, components, neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.scales import severity
from eventlens.operators.viz import metric_column, usable_value
from eventlens.operators.windows import range_numbered
from eventlens.session import materialize

#: Rounds of label propagation in which all nodes may move.
TOGETHER = 50
ENTITY_COLUMNS = ["user_id", "account_id", "device_id", "ip", "card_hash"]


def node_id(kind: Column, label: Column) -> Column:
    return F.concat(kind, F.lit(":"), label)


def link_cells(df: DataFrame, edges: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """(etype, a, b): all edge types from one pass; pairs with a missing end dropped."""
    cells = []
    for etype in edges:
        a, b = etype.split("-", 1)
        if a in df.columns and b in df.columns:
            cells.append(F.struct(
                F.lit(etype).alias("etype"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")
            ))
    rows = df.select(F.explode(F.array(*cells)).alias("c"), *extra).select("c.*", *extra)
    return rows.where(F.col("a").isNotNull() & F.col("b").isNotNull())


def graph_edges(
    df: DataFrame, edges: Sequence[str], metric: str = "count", value: str | None = None,
    min_link: float = 1.0, max_links: int | None = None,
) -> DataFrame:
    """Weighted links; with ``max_links`` the heaviest of each type."""
    kept = usable_value(df, value)
    links = link_cells(df, edges, [kept] if kept else []).groupBy("etype", "a", "b").agg(
        metric_column(metric, kept).alias("value")
    ).where(F.col("value") >= min_link)
    if max_links is not None:
        rank = F.row_number().over(Window.partitionBy("etype").orderBy(F.desc("value"), "a", "b"))
        links = links.withColumn("r", rank).where(F.col("r") <= max_links).drop("r")
    kinds = F.split("etype", "-", 2)
    return links.select(
        node_id(kinds[0], F.col("a")).alias("source"), node_id(kinds[1], F.col("b")).alias("target"), "etype", "value"
    )


def node_weights(links: DataFrame) -> DataFrame:
    ends = links.select(F.explode(F.array("source", "target")).alias("id"), "value")
    return ends.groupBy("id").agg(F.sum("value").alias("value"))


def graph_nodes(links: DataFrame, max_nodes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes with degree, and the links among them; with ``max_nodes`` the heaviest nodes only."""
    links = materialize(links, "links")
    top = node_weights(links)
    top = top if max_nodes is None else top.orderBy(F.desc("value"), "id").limit(max_nodes)
    kept = links if max_nodes is None else links_among(links, top)
    degrees = kept.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(
        F.count(F.lit(1)).alias("degree")
    )
    nodes = top.join(degrees, "id", "left").select(
        "id", F.substring_index("id", ":", 1).alias("type"), "value",
        F.coalesce(F.col("degree"), F.lit(0).cast("bigint")).alias("degree"),
    )
    return nodes, kept


def links_among(links: DataFrame, nodes: DataFrame) -> DataFrame:
    sources = nodes.select(F.col("id").alias("source"))
    targets = nodes.select(F.col("id").alias("target"))
    return links.join(sources, "source", "left_semi").join(targets, "target", "left_semi")


def entity_anomaly(scored: DataFrame, columns: Sequence[str] = ENTITY_COLUMNS) -> DataFrame:
    """(id, anom_max, reasons_top): the best-scored event of every entity."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("label")) for c in columns if c in scored.columns
    ])
    # Reasons shrink to three codes before the shuffle; earliest event wins a tie.
    codes = F.slice(F.transform("reasons", lambda r: r["code"]), 1, 3)
    rows = scored.select(
        F.explode(cells).alias("c"), "anom_score", codes.alias("codes"), F.unix_micros("ts").alias("us"), "event_id"
    ).where(F.col("c.label").isNotNull())
    best = F.max_by(F.struct("anom_score", "codes"), F.struct("anom_score", -F.col("us"), -F.col("event_id")))
    out = rows.groupBy(node_id(F.col("c.kind"), F.col("c.label")).alias("id")).agg(best.alias("best"))
    positive = F.col("best.anom_score") > 0
    return out.select(
        "id", F.when(positive, F.col("best.anom_score")).otherwise(0.0).alias("anom_max"),
        F.when(positive, F.array_join("best.codes", ",")).otherwise("").alias("reasons_top"),
    )


def severity_subgraph(
    nodes: DataFrame, links: DataFrame, anomalies: DataFrame, severities: Sequence[str], floor: float = 0.25, n: int = 50,
) -> tuple[DataFrame, DataFrame]:
    """The most anomalous nodes of the wanted severities, and the links among them."""
    scored = nodes.join(anomalies, "id", "left").withColumn("anom_max", F.coalesce("anom_max", F.lit(0.0)))
    scored = scored.withColumn("severity", severity(F.col("anom_max")))
    wanted = scored.where((F.col("anom_max") >= floor) & F.col("severity").isin(list(severities)))
    top = wanted.orderBy(F.desc("anom_max"), "id").limit(n)
    return top, links_among(links, top)


def both_ways(links: DataFrame) -> DataFrame:
    """Undirected adjacency (src, dst, weight) without loops."""
    forward = links.select(F.col("source").alias("src"), F.col("target").alias("dst"), "value")
    backward = links.select(F.col("target").alias("src"), F.col("source").alias("dst"), "value")
    pairs = forward.unionByName(backward).where("src <> dst")
    return pairs.groupBy("src", "dst").agg(F.sum("value").alias("weight"))


def neighbors(links: DataFrame) -> DataFrame:
    """(node, neighbor): distinct pairs as rows, since a hub's list has no bound."""
    return both_ways(links).select(F.col("src").alias("node"), F.col("dst").alias("neighbor"))


def label_propagation(links: DataFrame, rounds: int = 200) -> DataFrame:
    """(id, label, converged): every node takes its neighbours' heaviest label each round, until no label moves.

    After ``rounds`` rounds the labels are taken as they are, with ``converged`` false.

    A node's own label votes with the weight of its heaviest link, which keeps
    most two-sided graphs from swapping labels; ties go to the smallest label.
    When a round gives the labels of two rounds ago, or after ``TOGETHER``
    rounds, only half of the nodes, by a hash that changes with the round, take
    their new label in each further round, so that none swap for ever.
    """
    pairs = both_ways(links)
    own = pairs.groupBy("src").agg(F.max("weight").alias("weight"))
    votes = materialize(pairs.unionByName(own.select("src", F.col("src").alias("dst"), "weight")), "votes")
    labels = votes.select(F.col("src").alias("id"), F.col("src").alias("label")).distinct()
    before, halves = None, False
    for turn in range(1, rounds + 1):
        weighed = (
            votes.join(labels, votes["dst"] == labels["id"]).groupBy("src", "label").agg(F.sum("weight").alias("w"))
        )
        # Largest weight, then smallest label: a map-side combined minimum.
        best = weighed.groupBy("src").agg(F.min(F.struct((-F.col("w")).alias("nw"), "label")).alias("b"))
        fresh = materialize(best.select(F.col("src").alias("id"), F.col("b.label").alias("label")), f"labels{turn}")
        if not _differ(fresh, labels):
            return fresh.withColumn("converged", F.lit(True))
        halves = halves or turn >= TOGETHER or (before is not None and not _differ(fresh, before))
        if halves:
            moves = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0
            mixed = fresh.join(labels.withColumnRenamed("label", "old"), "id")
            fresh = materialize(mixed.select("id", F.when(moves, F.col("label")).otherwise(F.col("old")).alias("label")), f"labels{turn}")
        before, labels = labels, fresh
    return labels.withColumn("converged", F.lit(False))


def _differ(some: DataFrame, others: DataFrame) -> bool:
    return some.join(others, ["id", "label"], "left_anti").limit(1).count() > 0


def communities(labels: DataFrame) -> DataFrame:
    """(id, label, community, size): numbered by size, ties by label."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    numbered = range_numbered(sizes, [F.desc("size"), "label"], "community")
    return labels.join(numbered, "label").select("id", "label", "community", "size")


def modularity(links: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: modularity of a labelling."""
    pairs = both_ways(links)
    a = labels.select(F.col("id").alias("src"), F.col("label").alias("la"))
    b = labels.select(F.col("id").alias("dst"), F.col("label").alias("lb"))
    total = pairs.agg(F.sum("weight").alias("t")).scalar()
    inside = pairs.join(a, "src").join(b, "dst").groupBy("la").agg(
        F.sum("weight").alias("degree"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("weight")).otherwise(0.0)).alias("within")
    )
    share = F.col("within") / F.col("t") - F.pow(F.col("degree") / F.col("t"), 2)
    return inside.withColumn("t", total).agg(F.sum(share).alias("modularity"))


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component): smallest node id reachable.

    Each round every component hooks onto its smallest smaller neighbour, the
    chains of hooks are halved until all point at a root, and the links are
    rewritten between roots. Links shrink quickly, so long paths and large hubs
    both take a number of rounds that grows with the logarithm of the graph.
    """
    ends = links.select(F.greatest("source", "target").alias("a"), F.least("source", "target").alias("b"))
    edges = materialize(ends.where("a <> b").distinct(), "cc-edges")
    ids = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    labels = ids.withColumn("component", F.col("id"))
    while edges.limit(1).count():
        hooks = materialize(edges.groupBy("a").agg(F.min("b").alias("b")), "cc-hooks")
        while True:
            above = hooks.select(F.col("a").alias("b"), F.col("b").alias("root"))
            if not hooks.join(above, "b", "left_semi").limit(1).count():
                break
            halved = hooks.join(above, "b", "left").select("a", F.coalesce("root", "b").alias("b"))
            hooks = materialize(halved, "cc-hooks")
        labels = _to_roots(labels, hooks, "component")
        moved = _to_roots(_to_roots(edges, hooks, "a"), hooks, "b")
        moved = moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        edges = materialize(moved.where("a <> b").distinct(), "cc-edges")
    return labels.select("id", "component")


def _to_roots(df: DataFrame, hooks: DataFrame, column: str) -> DataFrame:
    roots = hooks.select(F.col("a").alias(column), F.col("b").alias("__root"))
    return df.join(roots, column, "left").withColumn(column, F.coalesce("__root", column)).drop("__root")
