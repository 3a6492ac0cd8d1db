"""Graph operators over ``edges(parent, child)`` and ``nodes(node)`` DataFrames.

Iterations are semi-naive: only what the last round added is joined again, and each round is
checkpointed. Every round shuffles its frontier, not the whole closure.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cut import cut


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent").alias("node")).union(edges.select(F.col("child").alias("node"))).distinct()


def roots(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    nodes = nodes_of(edges) if nodes is None else nodes.select("node").distinct()
    return nodes.join(edges.select(F.col("child").alias("node")).distinct(), "node", "left_anti")


def leaves(edges: DataFrame) -> DataFrame:
    """Nodes with a parent and without a child."""
    return (
        edges.select(F.col("child").alias("node")).distinct()
        .join(edges.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")
    )


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, reverse: bool = False) -> DataFrame:
    """Smallest depth of every node within reach of the seeds: (node, depth), seeds at 0."""
    step = edges.select(F.col("child" if reverse else "parent").alias("node"), F.col("parent" if reverse else "child").alias("next")).distinct()
    found = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = found, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        frontier = cut(
            frontier.join(step, "node").select(F.col("next").alias("node")).distinct()
            .join(found, "node", "left_anti").withColumn("depth", F.lit(depth))
        )
        if frontier.isEmpty():
            break
        found = found.union(frontier)
    return found


def closure(edges: DataFrame) -> DataFrame:
    """(ancestor, node, depth): every reachable pair with its smallest depth, each node itself at 0."""
    step = edges.select(F.col("parent").alias("node"), F.col("child").alias("next")).distinct()
    everyone = nodes_of(edges)
    found = everyone.select(F.col("node").alias("ancestor"), "node", F.lit(0).alias("depth"))
    frontier, depth = found, 0
    while True:
        depth += 1
        frontier = cut(
            frontier.select("ancestor", "node").join(step, "node").select("ancestor", F.col("next").alias("node")).distinct()
            .join(found.select("ancestor", "node"), ["ancestor", "node"], "left_anti").withColumn("depth", F.lit(depth))
        )
        if frontier.isEmpty():
            return found
        found = found.union(frontier)


def ancestors(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes that reach any of ``ids`` (node), themselves included."""
    return bfs(edges, ids, reverse=True).select("node")


def descendant_count(edges: DataFrame) -> DataFrame:
    """(node, descendants), the node itself not counted."""
    return closure(edges).groupBy(F.col("ancestor").alias("node")).agg((F.count("*") - 1).alias("descendants"))


def has_descendant_in(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes with a proper descendant among ``ids``."""
    return closure(edges).filter("depth > 0").join(ids.select("node").distinct(), "node", "left_semi").select(F.col("ancestor").alias("node")).distinct()


def lowest_common_ancestors(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Common ancestors of all ``ids`` without a common ancestor below them; the ids if there is none."""
    wanted = ids.select("node").distinct()
    reach = closure(edges)
    n = wanted.count()
    common = cut(
        reach.join(wanted, "node", "left_semi").groupBy(F.col("ancestor").alias("node")).agg(F.count_distinct("node").alias("n"))
        .filter(F.col("n") == n).select("node")
    )
    if common.isEmpty():
        return wanted
    higher = reach.filter("depth > 0").join(common, "node", "left_semi").select(F.col("ancestor").alias("node")).distinct()
    return common.join(higher, "node", "left_anti")


def between(edges: DataFrame, tops: DataFrame, bottoms: DataFrame) -> DataFrame:
    """Nodes on paths from ``tops`` to ``bottoms``; a bottom that no top reaches is an error."""
    down = bfs(edges, tops).select("node")
    lost = bottoms.select("node").join(down, "node", "left_anti").limit(5).collect()
    if lost:
        raise ValueError(f"not reachable from the roots: {[r['node'] for r in lost]}")
    return down.join(bfs(edges, bottoms, reverse=True).select("node"), "node", "left_semi")


def neighborhood(
    edges: DataFrame, seeds: DataFrame, up: int = 1, down: int = 1, siblings: bool = True, max_nodes: int = 60
) -> DataFrame | None:
    """(node, depth, kind) around the seeds: ``core``, ``up``, ``down``, ``sibling`` (depth 2).

    Siblings are other children of the core's parents inside the neighbourhood. None if it would
    hold more than ``max_nodes`` nodes.
    """
    core = cut(seeds.select("node").distinct())
    parts = [
        core.select("node", F.lit(0).alias("depth"), F.lit("core").alias("kind"), F.lit(0).alias("order")),
        bfs(edges, core, up, reverse=True).filter("depth > 0").select("node", "depth", F.lit("up").alias("kind"), F.lit(1).alias("order")),
        bfs(edges, core, down).filter("depth > 0").select("node", "depth", F.lit("down").alias("kind"), F.lit(2).alias("order")),
    ]
    if siblings:
        inside = parts[1].select(F.col("node").alias("parent"))
        of_core = edges.join(core.select(F.col("node").alias("child")), "child", "left_semi").select("parent").distinct().join(inside, "parent", "left_semi")
        parts.append(edges.join(of_core, "parent", "left_semi").select(F.col("child").alias("node"), F.lit(2).alias("depth"), F.lit("sibling").alias("kind"), F.lit(3).alias("order")))
    first = Window.partitionBy("node").orderBy("order", "depth")
    out = reduce(DataFrame.union, parts).withColumn("k", F.row_number().over(first)).filter("k = 1").select("node", "depth", "kind")
    out = cut(out)
    return None if out.count() > max_nodes else out


def external_children(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """(node, has_external_children): consumed both inside and outside of the node set."""
    i = inside.select("node").distinct()
    marked = edges.join(i.select(F.col("node").alias("child"), F.lit(1).alias("own")), "child", "left")
    flags = marked.groupBy(F.col("parent").alias("node")).agg(
        F.max(F.coalesce("own", F.lit(0))).alias("inner"), F.max(1 - F.coalesce("own", F.lit(0))).alias("outer")
    )
    return i.join(flags, "node", "left").select("node", (F.coalesce(F.col("inner") * F.col("outer"), F.lit(0)) == 1).alias("has_external_children"))


def audit_kinds(edges: DataFrame, inside: DataFrame, core: DataFrame) -> DataFrame:
    """(node, leaf, immutable) of a node set: leaves are core nodes without a core child; what outsiders consume may not change."""
    i, c = inside.select("node").distinct(), core.select("node").distinct()
    feeding = edges.join(c.withColumnRenamed("node", "child"), "child", "left_semi").select(F.col("parent").alias("node")).distinct()
    leaf = c.join(feeding, "node", "left_anti").withColumn("leaf", F.lit(True))
    fixed = external_children(edges, i).withColumnRenamed("has_external_children", "immutable")
    return i.join(leaf, "node", "left").join(fixed, "node", "left").select("node", F.coalesce("leaf", F.lit(False)).alias("leaf"), "immutable")


def group_neighborhoods(edges: DataFrame, groups: DataFrame, **limits) -> dict[str, DataFrame]:
    """Neighbourhoods of ranked groups (group, node), seeds left out; groups whose neighbourhood is too large have none."""
    out = {}
    for g in [r["group"] for r in groups.select("group").distinct().orderBy("group").collect()]:
        found = neighborhood(edges, groups.filter(F.col("group") == g).select("node"), **limits)
        if found is not None:
            out[g] = found.filter(~F.col("node").startswith("seed."))
    return out


def overlap(a: DataFrame, b: DataFrame) -> bool:
    return not a.select("node").join(b.select("node"), "node", "left_semi").isEmpty()


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): length of the longest path from a root; a cycle is an error."""
    n = nodes_of(edges).count()
    frontier = cut(roots(edges).withColumn("level", F.lit(0)))
    found, level = frontier, 0
    step = edges.select(F.col("parent").alias("node"), F.col("child").alias("next")).distinct()
    while not frontier.isEmpty():
        level += 1
        if level > n:
            raise ValueError("the graph has a cycle")
        frontier = cut(frontier.join(step, "node").select(F.col("next").alias("node")).distinct().withColumn("level", F.lit(level)))
        found = found.union(frontier)
    return found.groupBy("node").agg(F.max("level").alias("level"))


def components(pairs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest node reachable over undirected ``pairs(a, b)``.

    Each round takes the neighbours' smallest label and jumps to the label of that label.
    """
    sym = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    sym = cut(sym)
    label = sym.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    if nodes is not None:
        label = label.select("node").union(nodes.select("node")).distinct().withColumn("component", F.col("node"))
    label = cut(label)
    while True:
        near = sym.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        low = label.join(near, F.col("node") == F.col("a"), "left").select(
            "node", F.col("component").alias("before"), F.least("component", F.coalesce("m", "component")).alias("component")
        )
        jump = low.select(F.col("node").alias("l"), F.col("component").alias("up"))
        nxt = cut(low.join(jump, F.col("component") == F.col("l")).select("node", "before", F.col("up").alias("component")))
        changed = not nxt.filter("before <> component").isEmpty()
        label = nxt.select("node", "component")
        if not changed:
            return label


def k_core(pairs: DataFrame, k: int) -> DataFrame:
    """Nodes of the k-core of undirected ``pairs``."""
    e = cut(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while True:
        ends = e.select(F.col("a").alias("node")).union(e.select(F.col("b").alias("node")))
        weak = ends.groupBy("node").count().filter(F.col("count") < k).select("node")
        weak = cut(weak)
        if weak.isEmpty():
            return ends.distinct()
        e = cut(e.join(weak.withColumnRenamed("node", "a"), "a", "left_anti").join(weak.withColumnRenamed("node", "b"), "b", "left_anti"))


def induced_edge_count(pairs: DataFrame, nodes: DataFrame) -> int:
    n = nodes.select("node").distinct()
    return (
        pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        .join(n.withColumnRenamed("node", "a"), "a", "left_semi").join(n.withColumnRenamed("node", "b"), "b", "left_semi").count()
    )


def component_sizes(pairs: DataFrame, top: int) -> DataFrame:
    """Sizes of the components of the ``top`` pairs of largest ``score`` (ties by a, b)."""
    best = pairs.orderBy(F.desc("score"), "a", "b").limit(top)
    return components(best).groupBy("component").agg(F.count("*").alias("size"))
