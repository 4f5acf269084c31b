"""Relations between records, as an edge table ``(source_id, target_id, rel_type, strength, impact_score, updated_at)``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgauge.functions import vocab
from newsgauge.functions.rules import violations
from newsgauge.session import staged


def latest_edges(log: DataFrame, tie: str | None = None) -> DataFrame:
    """One edge per pair: the last write wins."""
    order = [F.col("updated_at").desc()] + ([F.col(tie).desc()] if tie else [])
    pair = Window.partitionBy("source_id", "target_id").orderBy(*order)
    return log.withColumn("_rn", F.row_number().over(pair)).where("_rn = 1").drop("_rn")


def edge_errors() -> Column:
    # The messages are fixed values: callers compare them.
    return violations([
        ("Cannot create a relationship with self", F.col("source_id") == F.col("target_id")),
        ("Invalid relationship type", F.col("rel_type").isNotNull() & ~F.col("rel_type").isin(vocab.RELATION_TYPES)),
        ("Invalid relationship strength", F.col("strength").isNotNull() & ~F.col("strength").isin(vocab.STRENGTHS)),
    ])


def neighbors(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Outgoing neighbours of every seed (column ``id``)."""
    return (edges.join(seeds.select(F.col("id").alias("source_id")), "source_id", "left_semi")
            .select("source_id", "target_id", "rel_type", "strength", "impact_score"))


def impact(edges: DataFrame) -> DataFrame:
    """Direct impact per source: total, mean, and how many targets are hit hard, moderately or lightly.

    The targets themselves are the rows of :func:`impact_bands`; they are not gathered into one cell.
    """
    score = F.col("impact_score")
    return edges.groupBy(F.col("source_id").alias("id")).agg(
        F.count("*").alias("total_relationships"), F.sum(score).cast("long").alias("total_impact"),
        (F.sum(score).cast("double") / F.count("*")).alias("average_impact"),
        F.count_if(score >= 70).alias("high_items"),
        F.count_if(score.between(30, 69)).alias("moderate_items"),
        F.count_if(score < 30).alias("low_items"))


def impact_bands(edges: DataFrame) -> DataFrame:
    score = F.col("impact_score")
    return edges.withColumn("band", F.when(score >= 70, "high").when(score >= 30, "moderate").otherwise("low"))


def decay(depth: int) -> float:
    """What the product of ``depth`` edge scores (0..100) is worth: 100 / 100**depth, and 0.7**i for the i-th edge."""
    return 100.0 * 0.7 ** (depth * (depth - 1) // 2) / 100.0 ** depth


#: Holds products of up to nine scores, and their sums, without rounding.
_NUMBER = "decimal(38,0)"


def _hops(edges: DataFrame, max_depth: int) -> DataFrame:
    return edges.select(F.col("source_id").alias("_from"), F.col("target_id").alias("_to"),
                        F.col("impact_score").cast(_NUMBER).alias("_w"))


def _simple_paths(hop: DataFrame, seeds: DataFrame, max_depth: int, min_impact: float = 0.0) -> list[DataFrame]:
    """Simple paths from the seeds, one table per depth: (source_id, end_id, path, product of edge scores).

    One equi-join per hop; where many paths meet in a hub, its partition is split by the adaptive skew join.
    Levels grow many-fold per hop, so working a shorter level out again costs little next to the longest one.
    """
    paths = (hop.join(seeds.select(F.col("id").alias("_from")).distinct(), "_from", "left_semi")
             .select(F.col("_from").alias("source_id"), F.col("_to").alias("end_id"),
                     F.array("_from", "_to").alias("path"), F.col("_w").alias("product"))
             .where(F.col("source_id") != F.col("end_id")))
    levels = [paths]
    for depth in range(2, max_depth + 1):
        if min_impact > 0:
            paths = paths.where(F.col("product") * decay(depth - 1) >= min_impact)
        paths = (paths.join(hop, F.col("end_id") == F.col("_from"))
                 .where(~F.array_contains("path", F.col("_to")))
                 .select("source_id", F.col("_to").alias("end_id"), F.concat("path", F.array("_to")).alias("path"),
                         (F.col("product") * F.col("_w")).cast(_NUMBER).alias("product")))
        levels.append(paths)
    return levels


def propagation_paths(edges: DataFrame, seeds: DataFrame, max_depth: int = 3, min_impact: float = 0.0) -> DataFrame:
    """All simple paths of at most ``max_depth`` edges from every seed (column ``id``) and their impact.

    The impact of a path is 100 times the product of its edge scores / 100, the i-th edge (from 0) weighted by
    0.7**i. It only shrinks with length, so pruning by ``min_impact`` loses no path at or above it.
    """
    levels = _simple_paths(staged(_hops(edges, max_depth)), seeds, max_depth, min_impact)
    out = None
    for depth, paths in enumerate(levels, 1):
        rows = paths.select("source_id", "end_id", "path", F.lit(depth).alias("depth"),
                            (F.col("product").cast("double") * F.lit(decay(depth))).alias("impact"))
        out = rows if out is None else out.unionByName(rows)
    return out.where(F.col("impact") >= min_impact) if min_impact > 0 else out


def propagation_total(edges: DataFrame, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """Affected nodes, paths and total propagated impact per seed, without listing the longest paths.

    The last hop, by far the largest, is summed in closed form: what leaves a path's end in all, less the edges
    that would return to the path. Products are summed as integers, so the total does not depend on order.
    """
    hop = staged(_hops(edges, max_depth))
    levels = _simple_paths(hop, seeds, max_depth - 1) if max_depth > 1 else []
    exact = _NUMBER
    if levels:
        levels[-1] = staged(levels[-1])
    sums = []
    for depth, paths in enumerate(levels, 1):
        sums.append(paths.groupBy("source_id").agg(F.sum("product").cast(exact).alias("_s"), F.count("*").alias("_n"))
                    .withColumn("_depth", F.lit(depth)))
    if levels:
        last = levels[-1]
        leaving = hop.groupBy("_from").agg(F.sum("_w").cast(exact).alias("_w"), F.count("*").alias("_n"))
        ahead = last.join(leaving, F.col("end_id") == F.col("_from")).select(
            "source_id", (F.col("product") * F.col("_w")).cast(exact).alias("_s"), "_n")
        back = (last.select("source_id", F.col("end_id").alias("_from"), F.explode("path").alias("_to"), "product")
                .join(hop, ["_from", "_to"])
                .select("source_id", (-F.col("product") * F.col("_w")).cast(exact).alias("_s"), F.lit(-1).cast("long").alias("_n")))
        sums.append(ahead.unionByName(back).groupBy("source_id").agg(F.sum("_s").cast(exact).alias("_s"), F.sum("_n").alias("_n"))
                    .withColumn("_depth", F.lit(max_depth)))
    else:
        first = _simple_paths(hop, seeds, 1)[0]
        sums.append(first.groupBy("source_id").agg(F.sum("product").cast(exact).alias("_s"), F.count("*").alias("_n"))
                    .withColumn("_depth", F.lit(1)))
    per_depth = sums[0]
    for s in sums[1:]:
        per_depth = per_depth.unionByName(s)
    parts = [F.coalesce(F.max(F.when(F.col("_depth") == d, F.col("_s"))).cast("double"), F.lit(0.0)) * F.lit(decay(d))
             for d in range(1, max_depth + 1)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    totals = per_depth.groupBy("source_id").agg(F.sum("_n").cast("long").alias("paths"), total.alias("total_impact"))
    near = _reach(hop, seeds, max_depth).where(F.col("depth") > 0)
    return totals.join(near.groupBy(F.col("center").alias("source_id")).agg(F.count("*").alias("nodes_affected")), "source_id")


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(center, node, depth): every node within ``max_depth`` hops, at its smallest distance."""
    return _reach(staged(_hops(edges, 1)), seeds, max_depth)


def _reach(hop: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """Each hop joins only the newest frontier and keeps nodes not seen before."""
    frontier = seeds.select(F.col("id").alias("center"), F.col("id").alias("node")).distinct().withColumn("depth", F.lit(0))
    seen = frontier
    for d in range(1, max_depth + 1):
        fresh = (frontier.join(hop, F.col("node") == F.col("_from"))
                 .select("center", F.col("_to").alias("node")).distinct()
                 .join(seen.select("center", "node"), ["center", "node"], "left_anti")
                 .withColumn("depth", F.lit(d)))
        frontier = staged(fresh) if 1 < d < max_depth else fresh
        seen = seen.unionByName(frontier)
    return seen


def _levels(ego: DataFrame, max_level: int) -> list[DataFrame]:
    """Breadth-first levels from every node of every ego network: (center, start, node, paths), one table per level.

    ``paths`` counts the shortest paths from ``start``. A neighbour of a level lies in it or in one beside it, so a
    fresh node needs to be told only from the last two levels.
    """
    both = ego.select("center", F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                                                  F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("center", "e.u", "e.v")
    both = staged(both)
    start = both.select("center", F.col("u").alias("start")).distinct().withColumns({"node": F.col("start"), "paths": F.lit(1.0)})
    levels = [staged(start)]
    key = ["center", "start", "node"]
    for _ in range(max_level):
        last = levels[-1]
        fresh = (last.join(both, (last["center"] == both["center"]) & (last["node"] == both["u"]))
                 .groupBy(last["center"], "start", F.col("v").alias("node")).agg(F.sum("paths").alias("paths")))
        for seen in levels[-2:]:
            fresh = fresh.join(seen.select(*key), key, "left_anti")
        levels.append(staged(fresh))
    return [both, *levels]


def betweenness(ego: DataFrame, max_depth: int, most_edges: int = 2_000_000, starts: int = 128) -> DataFrame:
    """Unnormalised betweenness of every node within every ego network (rows of :func:`ego_edges`).

    A network of at most ``most_edges`` edges goes to tasks as a whole, each with some ``starts`` of its nodes, from which the
    shortest paths are counted at once; a larger one is worked on by joins, level by level. Both give the same.
    """
    ego = staged(ego.select("center", "a", "b"))
    sizes = ego.groupBy("center").agg(F.count("*").alias("_edges"))
    large = sizes.where(F.col("_edges") > most_edges).select("center")
    small = ego.join(large, "center", "left_anti")
    nodes = small.select("center", F.explode(F.array("a", "b")).alias("start")).distinct()
    block = F.floor((F.row_number().over(Window.partitionBy("center").orderBy("start")) - 1) / starts)
    dealt = staged(nodes.withColumn("block", block))
    blocks = dealt.groupBy("center").agg(F.max("block").alias("last"))
    edges = small.join(blocks, "center").select("center", "a", "b", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("part"))
    kind = dict(ego.dtypes)
    credit = (edges.groupBy("center", "part").cogroup(dealt.select(F.col("center").alias("of"), "start", "block").groupBy("of", "block"))
              .applyInArrow(_credits, f"center {kind['center']}, node {kind['a']}, credit double"))
    out = credit.groupBy("center", "node").agg((F.sum("credit") / 2).alias("betweenness"))
    if large.limit(1).count():
        out = out.unionByName(_betweenness_by_joins(ego.join(large, "center", "left_semi"), max_depth))
    return out


def _credits(edges: pa.Table, wanted: pa.Table) -> pa.Table:
    """What the nodes of one network earn from the shortest paths that begin in ``wanted``: paths are counted outwards level by
    level for many starts at once, and credits handed back from the farthest level."""
    ends = pa.concat_arrays([edges.column(c).combine_chunks() for c in ("a", "b")]).dictionary_encode()
    nodes, places = ends.dictionary, ends.indices.to_numpy().astype(np.int64)
    n, m = len(nodes), edges.num_rows
    u, v = places, np.concatenate([places[m:], places[:m]])
    order = np.argsort(v, kind="stable")
    u, v = u[order], v[order]
    first = np.searchsorted(v, np.arange(n))  # every node is an end of some edge
    starts = pc.index_in(wanted.column("start"), value_set=nodes).to_numpy()
    total = np.zeros(n)
    at_once = max(1, 4_000_000 // (2 * m))
    for low in range(0, len(starts), at_once):
        s = starts[low:low + at_once]
        row = np.arange(len(s))
        distance, paths = np.full((len(s), n), -1, np.int32), np.zeros((len(s), n))
        distance[row, s], paths[row, s] = 0, 1.0
        depth = 0
        while True:
            reached = np.add.reduceat(np.where(distance == depth, paths, 0.0)[:, u], first, axis=1)
            new = (distance < 0) & (reached > 0)
            if not new.any():
                break
            depth += 1
            distance[new], paths[new] = depth, reached[new]
        credit = np.zeros((len(s), n))
        for d in range(depth, 0, -1):
            share = np.divide(1 + credit, paths, out=np.zeros_like(paths), where=distance == d)
            credit += np.where(distance == d - 1, paths * np.add.reduceat(share[:, u], first, axis=1), 0.0)
        credit[row, s] = 0.0
        total += credit.sum(0)
    center = pa.array([edges.column("center")[0].as_py()] * n, edges.schema.field("center").type)
    return pa.table({"center": center, "node": nodes, "credit": total})


def _betweenness_by_joins(ego: DataFrame, max_depth: int) -> DataFrame:
    """:func:`betweenness` without any network in one task.

    Shortest paths are counted from all nodes of all networks at once and credits handed back level by level.
    Work is spread by (network, start), so a large network is shared by many tasks. Two nodes of an ego network
    are at most 2 * (max_depth + 1) hops apart.
    """
    both, *levels = _levels(ego, 2 * (max_depth + 1))
    credit = levels[-1].withColumn("credit", F.lit(0.0))
    total = None
    for above in reversed(levels[1:-1]):
        part = credit.groupBy("center", "node").agg(F.sum("credit").alias("credit"))
        total = part if total is None else total.unionByName(part)
        c = credit.select("center", "start", F.col("node").alias("_w"), ((1 + F.col("credit")) / F.col("paths")).alias("_share"))
        back = (c.join(both, (c["center"] == both["center"]) & (c["_w"] == both["u"]))
                .select(c["center"], "start", F.col("v").alias("node"), "_share"))
        given = back.join(above, ["center", "start", "node"]).groupBy("center", "start", "node").agg(
            (F.max("paths") * F.sum("_share")).alias("credit"))
        credit = staged(above.join(given, ["center", "start", "node"], "left")
                             .withColumn("credit", F.coalesce("credit", F.lit(0.0))))
    total = total.unionByName(credit.groupBy("center", "node").agg(F.sum("credit").alias("credit")))
    nodes = levels[0].select("center", F.col("node")).distinct().withColumn("credit", F.lit(0.0))
    return total.unionByName(nodes).groupBy("center", "node").agg((F.sum("credit") / 2).alias("betweenness"))


def most_central(scores: DataFrame) -> DataFrame:
    """The node of highest betweenness per network, lowest id on a tie (scores equal to nine digits)."""
    rounded = F.round("betweenness", 9)
    return scores.groupBy("center").agg(
        F.min_by("node", F.struct(-rounded, F.col("node"))).alias("most_central_node"), F.max(rounded).alias("betweenness"))


def ego_edges(edges: DataFrame, seeds: DataFrame, max_depth: int = 2) -> DataFrame:
    """Undirected edges of every ego network: all edges that leave a node within ``max_depth`` hops.

    The far ends may lie one hop beyond ``max_depth``. Where both directions exist, the type is that of the
    edge written last.
    """
    inside = reach(edges, seeds, max_depth)
    out = edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("_to"), "rel_type", "updated_at")
    last = F.struct("updated_at", "rel_type")
    return (inside.join(out, "node")
            .groupBy("center", F.least("node", "_to").alias("a"), F.greatest("node", "_to").alias("b"))
            .agg(F.max_by("rel_type", last).alias("rel_type")))


def node_type(node: Column) -> Column:
    """Kind of a node by its id prefix."""
    return F.when(node.startswith("EPIC-"), "epic").when(node.startswith("TASK-"), "task").otherwise("evidence")


def network_stats(ego: DataFrame) -> DataFrame:
    """Size, degrees, density and the best-connected node of every ego network (rows of :func:`ego_edges`)."""
    ends = ego.select("center", F.explode(F.array("a", "b")).alias("node"))
    degrees = ends.groupBy("center", "node").agg(F.count("*").alias("degree"))
    n, e = F.col("num_nodes"), F.col("num_edges")
    return (degrees.groupBy("center").agg(
                F.count("*").alias("num_nodes"), (F.sum("degree") / 2).cast("long").alias("num_edges"),
                F.max("degree").alias("max_degree"),
                F.min_by("node", F.struct(-F.col("degree"), F.col("node"))).alias("node_with_max_degree"))
            .withColumn("avg_degree", 2.0 * e / n)
            .withColumn("density", F.when(n > 1, 2.0 * e / (n * (n - 1))).otherwise(F.lit(0.0))))


def relation_distribution(edges: DataFrame, width: int = 40) -> DataFrame:
    """Edges per relation type and the length of its bar, scaled to the largest."""
    counts = edges.groupBy("rel_type").agg(F.count("*").alias("n"))
    top = counts.agg(F.max("n")).scalar()
    return counts.withColumn("bar", F.floor(F.col("n") / top * width).cast("long")).orderBy(F.col("n").desc(), "rel_type")
