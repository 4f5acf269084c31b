"""Relations between records."""

from pyspark.sql import functions as F

from newsgauge.operators import graph as G
from newsgauge.plans.registry import query


@query("edges_latest", "edge", "SELECT * FROM edge")
def edges_latest(t):
    return t.edge


@query("edges_by_type", "edge", "SELECT source_id, target_id, strength FROM edge WHERE rel_type = 'supports'")
def edges_by_type(t):
    return t.edge.where(F.col("rel_type") == "supports").select("source_id", "target_id", "strength")


@query("edges_by_strength", "edge", "SELECT source_id, target_id, rel_type FROM edge WHERE strength = 'critical'")
def edges_by_strength(t):
    return t.edge.where(F.col("strength") == "critical").select("source_id", "target_id", "rel_type")


@query("neighbors", "edge", "SELECT source_id, target_id, rel_type, strength, impact_score FROM edge WHERE source_id IN (SELECT s_suppkey FROM supplier)")
def neighbors(t):
    return G.neighbors(t.edge, t.supplier.select(F.col("s_suppkey").alias("id")))


@query("impact", "edge", """
SELECT source_id AS id, count(*) AS total_relationships, CAST(sum(impact_score) AS BIGINT) AS total_impact, sum(impact_score) / count(*) AS average_impact,
  count(*) FILTER (impact_score >= 70) AS high_items, count(*) FILTER (impact_score >= 30 AND impact_score < 70) AS moderate_items, count(*) FILTER (impact_score < 30) AS low_items
FROM edge GROUP BY source_id""")
def impact(t):
    return G.impact(t.edge)


@query("impact_bands", "edge", "SELECT source_id, target_id, CASE WHEN impact_score >= 70 THEN 'high' WHEN impact_score >= 30 THEN 'moderate' ELSE 'low' END AS band FROM edge")
def impact_bands(t):
    return G.impact_bands(t.edge).select("source_id", "target_id", "band")


_PATHS = """WITH RECURSIVE paths AS (
  SELECT source_id, target_id AS end_id, [source_id, target_id] AS path, 1 AS depth, CAST(impact_score AS HUGEINT) AS product FROM edge WHERE source_id IN (SELECT r_regionkey FROM region)
  UNION ALL SELECT p.source_id, e.target_id, list_append(p.path, e.target_id), depth + 1, product * impact_score
  FROM paths p JOIN edge e ON e.source_id = p.end_id WHERE depth < 3 AND NOT list_contains(p.path, e.target_id)) """
_DECAY = "CASE depth " + " ".join(f"WHEN {d} THEN {G.decay(d)!r}::DOUBLE" for d in (1, 2, 3)) + " END"


def seeds(t):
    """The nodes asked about: the keys of ``region`` stand for the watch list of a user."""
    return t.region.select(F.col("r_regionkey").cast("bigint").alias("id"))


@query("propagation_paths", "edge", _PATHS + f"""
SELECT source_id, end_id, depth, array_to_string(path, '>') AS path, CAST(product AS DOUBLE) * {_DECAY} AS impact FROM paths""")
def propagation_paths(t):
    return G.propagation_paths(t.edge, seeds(t)).select(
        "source_id", "end_id", "depth", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "impact")


@query("propagation_total", "edge", _PATHS + f""",
d AS (SELECT source_id, depth, count(*) AS n, CAST(sum(product) AS DOUBLE) * {_DECAY} AS s FROM paths GROUP BY source_id, depth),
e AS (SELECT source_id, count(DISTINCT end_id) AS nodes_affected FROM paths GROUP BY source_id)
SELECT source_id, any_value(nodes_affected) AS nodes_affected, CAST(sum(n) AS BIGINT) AS paths,
  coalesce(max(s) FILTER (depth = 1), 0) + coalesce(max(s) FILTER (depth = 2), 0) + coalesce(max(s) FILTER (depth = 3), 0) AS total_impact
FROM d JOIN e USING (source_id) GROUP BY source_id""")
def propagation_total(t):
    return G.propagation_total(t.edge, seeds(t))


_REACH = """WITH h0 AS (SELECT CAST(r_regionkey AS BIGINT) AS center, CAST(r_regionkey AS BIGINT) AS node FROM region),
h1 AS (SELECT DISTINCT center, target_id AS node FROM h0 JOIN edge ON source_id = node),
h2 AS (SELECT DISTINCT center, target_id AS node FROM h1 JOIN edge ON source_id = node),
reach AS (SELECT center, node, min(depth) AS depth FROM (SELECT *, 0 AS depth FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY ALL),
ego AS (SELECT center, least(node, target_id) AS a, greatest(node, target_id) AS b, arg_max(rel_type, (updated_at, rel_type)) AS rel_type
  FROM reach JOIN edge ON source_id = node GROUP BY ALL),
deg AS (SELECT center, node, count(*) AS degree FROM (SELECT center, a AS node FROM ego UNION ALL SELECT center, b FROM ego) GROUP BY ALL) """


@query("ego_network", "edge", _REACH + "SELECT center, node, CAST(depth AS INTEGER) AS depth FROM reach")
def ego_network(t):
    return G.reach(t.edge, seeds(t), 2)


@query("ego_edges", "edge", _REACH + "SELECT center, a, b, rel_type FROM ego")
def ego_edges(t):
    return G.ego_edges(t.edge, seeds(t), 2)


@query("network_stats", "edge", _REACH + """
SELECT center, count(*) AS num_nodes, CAST(sum(degree) / 2 AS BIGINT) AS num_edges, max(degree) AS max_degree, arg_min(node, (-degree, node)) AS node_with_max_degree,
  2.0::DOUBLE * CAST(sum(degree) / 2 AS BIGINT) / count(*) AS avg_degree, 2.0::DOUBLE * CAST(sum(degree) / 2 AS BIGINT) / (count(*) * (count(*) - 1)) AS density FROM deg GROUP BY center""")
def network_stats(t):
    return G.network_stats(G.ego_edges(t.edge, seeds(t), 2))


@query("ego_relation_counts", "edge", _REACH + "SELECT center, rel_type, count(*) AS n FROM ego GROUP BY ALL")
def ego_relation_counts(t):
    return G.ego_edges(t.edge, seeds(t), 2).groupBy("center", "rel_type").agg(F.count("*").alias("n"))


def _central_sql():
    """Betweenness by levels: up to four hops in networks of depth 1, credits handed back from the farthest level."""
    out = ["""h0 AS (SELECT CAST(r_regionkey AS BIGINT) AS center, CAST(r_regionkey AS BIGINT) AS node FROM region)""",
           """h1 AS (SELECT center, node FROM h0 UNION SELECT center, target_id FROM h0 JOIN edge ON source_id = node)""",
           """ego AS (SELECT DISTINCT center, least(node, target_id) AS a, greatest(node, target_id) AS b FROM h1 JOIN edge ON source_id = node)""",
           """g AS (SELECT center, a AS u, b AS v FROM ego UNION ALL SELECT center, b, a FROM ego)""",
           """l0 AS (SELECT DISTINCT center, u AS start, u AS node, 1.0::DOUBLE AS paths FROM g)"""]
    for i in range(1, 5):
        seen = " ".join(f"AND NOT EXISTS (SELECT 1 FROM l{j} s WHERE s.center = x.center AND s.start = x.start AND s.node = x.node)" for j in (i - 1, i - 2) if j >= 0)
        out.append(f"""l{i} AS (SELECT * FROM (SELECT l.center, l.start, g.v AS node, sum(l.paths) AS paths FROM l{i - 1} l JOIN g ON g.center = l.center AND g.u = l.node GROUP BY ALL) x
  WHERE true {seen})""")
    out.append("c4 AS (SELECT *, 0.0::DOUBLE AS credit FROM l4)")
    for i in (3, 2, 1):
        out.append(f"""c{i} AS (SELECT l.center, l.start, l.node, l.paths, coalesce(l.paths * sum((1 + c.credit) / c.paths), 0) AS credit FROM l{i} l
  LEFT JOIN (c{i + 1} c JOIN g ON g.center = c.center AND g.u = c.node) ON c.center = l.center AND c.start = l.start AND g.v = l.node GROUP BY l.center, l.start, l.node, l.paths)""")
    parts = " UNION ALL ".join(f"SELECT center, node, credit FROM c{i}" for i in (1, 2, 3, 4)) + " UNION ALL SELECT center, node, 0 FROM l0"
    out.append(f"b AS (SELECT center, node, round(sum(credit) / 2, 9) AS betweenness FROM ({parts}) GROUP BY ALL)")
    return "WITH " + ",\n".join(out) + "\nSELECT center, arg_min(node, (-betweenness, node)) AS most_central_node, max(betweenness) AS betweenness FROM b GROUP BY center"


@query("ego_central", "edge", _central_sql())
def ego_central(t):
    return G.most_central(G.betweenness(G.ego_edges(t.edge, seeds(t), 1), 1))


@query("relation_distribution", "edge", """
SELECT rel_type, n, CAST(floor(n / max(n) OVER () * 40) AS BIGINT) AS bar FROM (SELECT rel_type, count(*) AS n FROM edge GROUP BY rel_type)""")
def relation_distribution(t):
    return G.relation_distribution(t.edge)


@query("node_types", "item", """
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN starts_with(value, 'EPIC-') THEN 'epic' WHEN starts_with(value, 'TASK-') THEN 'task' ELSE 'evidence' END AS kind
  FROM (SELECT id AS value FROM item UNION ALL SELECT epic_id FROM item UNION ALL SELECT task_id FROM item)) GROUP BY kind""")
def node_types(t):
    nodes = t.item.select(F.explode(F.array("id", "epic_id", "task_id")).alias("node"))
    return nodes.groupBy(G.node_type(F.col("node")).alias("kind")).agg(F.count("*").alias("n"))
