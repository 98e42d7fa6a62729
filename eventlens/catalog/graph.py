"""Entity graph queries."""

from pyspark.sql import functions as F

from eventlens.catalog.common import SEVERITY_SQL, load_events, r, scored_events, with_ev, with_scored
from eventlens.operators import graph as gr
from eventlens.registry import query

EDGES = ["user_id-device_id", "user_id-ip", "account_id-card_hash"]
MAX_LINKS, MAX_NODES = 400, 300


def edges_sql(source="ev", min_link=2, max_links=MAX_LINKS, edges=EDGES, name="links"):
    parts = []
    for e in edges:
        a, b = e.split("-")
        parts.append(
            f"(SELECT '{a}:' || {a} AS source, '{b}:' || {b} AS target, '{e}' AS etype, count(*)::DOUBLE AS value FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL "
            f"GROUP BY {a}, {b} HAVING count(*) >= {min_link} ORDER BY value DESC, {a}, {b} LIMIT {max_links})")
    return f"{name} AS (" + " UNION ALL ".join(parts) + ")"


NODES_SQL = f"""top AS (SELECT id, sum(value) AS value FROM (SELECT source AS id, value FROM links UNION ALL SELECT target, value FROM links) GROUP BY id ORDER BY value DESC, id LIMIT {MAX_NODES}),
kept AS (SELECT * FROM links WHERE source IN (SELECT id FROM top) AND target IN (SELECT id FROM top)),
nodes AS (SELECT t.id, split_part(t.id, ':', 1) AS type, t.value, count(k.source) AS degree FROM top t LEFT JOIN kept k ON t.id = k.source OR t.id = k.target GROUP BY t.id, t.value)"""


def _edges(df, min_link=2):
    return gr.graph_edges(df, EDGES, min_link=min_link, max_links=MAX_LINKS)


@query("graph_edges", with_ev("SELECT * FROM links", edges_sql()))
def graph_edges(spark, sf):
    return _edges(load_events(spark, sf))


@query("graph_edges_value", with_ev("""
SELECT 'user_id:' || user_id AS source, 'country:' || country AS target, 'user_id-country' AS etype, round(max(amount), 6) AS value FROM ev GROUP BY user_id, country HAVING max(amount) >= 50"""))
def graph_edges_value(spark, sf):
    out = gr.graph_edges(load_events(spark, sf), ["user_id-country", "missing-ip"], "max", "amount", 50.0)
    return out.withColumn("value", r("value"))


@query("graph_nodes", with_ev("SELECT id, type, value, degree FROM nodes", edges_sql(), NODES_SQL))
def graph_nodes(spark, sf):
    return gr.graph_nodes(_edges(load_events(spark, sf)), MAX_NODES)[0]


ANOM_SQL = "ents AS (" + " UNION ALL ".join(
    f"SELECT '{c}:' || {c} AS id, anom_score, codes, us, event_id FROM scored WHERE {c} IS NOT NULL" for c in gr.ENTITY_COLUMNS) + """),
enta AS (SELECT id, anom_score AS anom_max, array_to_string(codes[1:3], ',') AS reasons_top FROM ents QUALIFY row_number() OVER (PARTITION BY id ORDER BY anom_score DESC, us, event_id) = 1)"""


@query("graph_entity_anomaly", with_scored("SELECT * FROM enta", ANOM_SQL))
def graph_entity_anomaly(spark, sf):
    return gr.entity_anomaly(scored_events(spark, sf))


@query("graph_severity_filter", with_scored(f"""
SELECT 'node' AS kind, id AS a, '' AS b, anom_max AS value FROM sevtop UNION ALL
SELECT 'link', source, target, value FROM kept WHERE source IN (SELECT id FROM sevtop) AND target IN (SELECT id FROM sevtop)""",
    edges_sql("scored"), NODES_SQL, ANOM_SQL, f"""sevtop AS (SELECT n.id, coalesce(anom_max, 0) AS anom_max FROM nodes n LEFT JOIN enta USING (id)
    WHERE {SEVERITY_SQL.format(c='coalesce(anom_max, 0)')} IN ('critical', 'high') ORDER BY anom_max DESC, id LIMIT 50)"""))
def graph_severity_filter(spark, sf):
    scored = scored_events(spark, sf)
    nodes, links = gr.graph_nodes(_edges(scored), MAX_NODES)
    top, kept = gr.severity_subgraph(nodes, links, gr.entity_anomaly(scored), ["critical", "high"], 0.25, 50)
    rows = top.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b"), F.col("anom_max").alias("value"))
    return rows.unionByName(kept.select(F.lit("link").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), "value"))


WIDE = ["user_id-device_id", "account_id-card_hash"]


def _wide(spark, sf):
    """All links: no cut of weak ones, nothing left out."""
    return gr.graph_edges(load_events(spark, sf), WIDE, min_link=1, max_links=None)


WIDE_SQL = edges_sql("ev", 1, 2**31 - 1, WIDE)
BOTH_SQL = "adj AS (SELECT source AS src, target AS dst, value FROM links UNION ALL SELECT target, source, value FROM links), pairs AS (SELECT src, dst, sum(value) AS w FROM adj WHERE src <> dst GROUP BY src, dst)"


@query("graph_neighbors", with_ev("SELECT src AS node, dst AS neighbor FROM pairs", WIDE_SQL, BOTH_SQL))
def graph_neighbors(spark, sf):
    return gr.neighbors(_wide(spark, sf))


@query("graph_components", with_ev("SELECT id, min(root) AS component FROM reach GROUP BY id", WIDE_SQL, BOTH_SQL,
       "reach AS (SELECT src AS id, src AS root FROM pairs UNION SELECT p.dst, r.root FROM reach r JOIN pairs p ON r.id = p.src)").replace("WITH ", "WITH RECURSIVE ", 1))
def graph_components(spark, sf):
    return gr.connected_components(_wide(spark, sf))


VOTES_SQL = "votes AS (SELECT src, dst, w FROM pairs UNION ALL SELECT src, src, max(w) FROM pairs GROUP BY src), l0 AS (SELECT DISTINCT src AS id, src AS label FROM pairs)"
ROUND_SQL = "l{n} AS (SELECT src AS id, label FROM (SELECT v.src, l.label, sum(v.w) AS s FROM votes v JOIN l{m} l ON v.dst = l.id GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY src ORDER BY s DESC, label) = 1)"


def lpa_sql(tail):
    rounds = [ROUND_SQL.format(n=i, m=i - 1) for i in (1, 2, 3)]
    return with_ev(tail, WIDE_SQL, BOTH_SQL, VOTES_SQL, *rounds)


@query("graph_communities", lpa_sql("""
SELECT l.id, l.label, c.community, c.size FROM l3 l JOIN (SELECT label, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS community FROM l3 GROUP BY label) c ON l.label = c.label"""))
def graph_communities(spark, sf):
    return gr.communities(gr.label_propagation(_wide(spark, sf)))


@query("graph_modularity", lpa_sql("""
SELECT round(sum(inside / t - power(deg / t, 2)), 6) AS modularity FROM (SELECT a.label, sum(w) AS deg, sum(CASE WHEN a.label = b.label THEN w ELSE 0 END) AS inside, (SELECT sum(w) FROM pairs) AS t
  FROM pairs JOIN l3 a ON a.id = src JOIN l3 b ON b.id = dst GROUP BY a.label)"""))
def graph_modularity(spark, sf):
    links = _wide(spark, sf)
    return gr.modularity(links, gr.label_propagation(links)).select(r("modularity").alias("modularity"))
