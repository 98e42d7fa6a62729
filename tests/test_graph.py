import pytest
from conftest import rows
from pyspark.sql import functions as F

from eventlens.operators import graph as gr


def links(spark, pairs):
    return spark.createDataFrame([(a, b, "t", float(w)) for a, b, *r in pairs for w in (r or [1.0])], "source string, target string, etype string, value double")


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, *_ in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return sorted((x, find(x)) for x in parent)


@pytest.mark.parametrize("pairs", [
    [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)],  # a long path
    [("hub", f"leaf{i:03d}") for i in range(200)] + [("x", "y")],  # a star, and a pair
    [(f"a{i}", f"a{(i * 7) % 40}") for i in range(1, 40)] + [("b1", "b2"), ("b2", "b3"), ("b3", "b1")],
])
def test_components(spark, pairs):
    got = rows(gr.connected_components(links(spark, pairs)))
    want = [p for p in union_find(pairs) if any(p[0] in (a, b) and a != b for a, b, *_ in pairs)]
    assert got == want


def test_two_cliques_are_two_communities(spark):
    cliques = [(f"{c}{i}", f"{c}{j}") for c in "pq" for i in range(5) for j in range(i)] + [("p0", "q0", 0.5)]
    out = gr.communities(gr.label_propagation(links(spark, cliques)))
    groups = {}
    for r in out.collect():
        groups.setdefault(r.community, set()).add(r.id[0])
    assert sorted(map(sorted, groups.values())) == [["p"], ["q"]]
    labels = out.select("id", "label")
    assert gr.modularity(links(spark, cliques), labels).first()[0] > 0.4


def test_star_settles(spark):
    out = gr.label_propagation(links(spark, [("hub", f"leaf{i}") for i in range(30)]))
    assert out.select("label").distinct().count() == 1


def test_labels_spread_to_the_end_of_a_path(spark):
    out = gr.label_propagation(links(spark, [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(14)]))
    assert rows(out.select("label").distinct()) == [("n00",)]


def test_labels_that_swap_settle(spark):
    # All nodes moving at once swap labels for ever on these links.
    pairs = [(4, 5, 2), (2, 4, 1), (2, 1, 3), (1, 0, 3), (1, 3, 2), (4, 3, 1), (1, 5, 3)]
    label = dict(rows(gr.label_propagation(links(spark, [(f"n{a}", f"n{b}", w) for a, b, w in pairs])), "id", "label"))
    for node in label:
        ties = [(f"n{b if node == f'n{a}' else a}", w) for a, b, w in pairs if node in (f"n{a}", f"n{b}")]
        votes = {label[node]: max(w for _, w in ties)}
        for other, w in ties:
            votes[label[other]] = votes.get(label[other], 0) + w
        assert label[node] == min(votes, key=lambda x: (-votes[x], x))


def test_communities_are_numbered_by_size_and_label(spark):
    labels = spark.range(3000).selectExpr("CAST(id AS STRING) AS id", "CONCAT('g', CAST(SQRT(id) * 7 AS INT)) AS label")
    out = gr.communities(labels)
    sizes = rows(out.select("community", "label", "size").distinct(), "community", "label", "size")
    want = sorted(rows(labels.groupBy("label").count()), key=lambda r: (-r[1], r[0]))
    assert [r[1:] for r in sorted(sizes)] == want and sorted(r[0] for r in sizes) == list(range(len(want)))
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


def test_nodes_links_and_degree(spark):
    edges = links(spark, [("user_id:1", "ip:a", 5), ("user_id:1", "ip:b", 3), ("user_id:2", "ip:b", 1)])
    nodes, kept = gr.graph_nodes(edges, 3)
    assert rows(nodes, "id", "type", "value", "degree") == [("ip:a", "ip", 5.0, 1), ("ip:b", "ip", 4.0, 1), ("user_id:1", "user_id", 8.0, 2)]
    assert kept.count() == 2


def test_missing_ends_and_columns_are_skipped(events):
    out = gr.graph_edges(events, ["user_id-device_id", "nope-ip"], max_links=10)
    assert out.count() == 10 and out.where(F.col("target").isNull()).count() == 0
