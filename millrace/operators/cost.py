"""Cost of a pipeline under an assignment of tables and views.

``edges(parent, child, weight)``, ``assignment(node, t)`` with t = 1 for stored, 0 for inlined.
A view's features flow into its consumers, times the number of references; a table stops the flow.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cut import cut
from .graph import levels

#: Largest cost of a node: expm1(20) milliseconds (fixed value).
CLAMP = math.expm1(20)


def included_nodes(nodes: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Nodes that take part in costs: no tests, operations, incremental models, seeds or monitoring models."""
    return nodes.filter(
        ~F.col("resource_type").isin("test", "seed", "operation") & (F.coalesce("materialized", F.lit("")) != "incremental")
        & ~F.col("unique_id").startswith("operation.") & ~F.col("unique_id").startswith("model.elementary.") & ~F.col("unique_id").isin(*excluded)
    )


def expand_views(edges: DataFrame, assignment: DataFrame, features: DataFrame) -> DataFrame:
    """(node, feature, value): own features plus those of all views upstream, along every path."""
    views = assignment.filter("t = 0").select(F.col("node").alias("parent"))
    step = cut(edges.join(views, "parent", "left_semi").groupBy("parent", "child").agg(F.sum("weight").alias("weight")))
    frontier = features.select("node", "feature", F.col("value").cast("double").alias("value"))
    found = frontier
    while True:
        frontier = cut(
            frontier.join(step, F.col("node") == F.col("parent")).groupBy(F.col("child").alias("node"), "feature")
            .agg(F.sum(F.col("value") * F.col("weight")).alias("value"))
        )
        if frontier.isEmpty():
            return found.groupBy("node", "feature").agg(F.sum("value").alias("value"))
        found = found.union(frontier)


def propagate_cardinality(edges: DataFrame, assignment: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, input_rows, log_rows): rows that reach a node; tables and sources pass their own rows, views what reaches them."""
    known = assignment.filter("t = 0").select("node")
    own = rows.join(known, "node", "left_anti").select("node", F.col("rows").cast("double").alias("rows"))
    every = edges.select(F.col("child").alias("node")).distinct()
    spread = expand_paths(edges, assignment, own)
    return every.join(spread, "node", "left").select("node", F.coalesce("rows", F.lit(0.0)).alias("input_rows")).withColumn("log_rows", F.log1p("input_rows"))


def expand_paths(edges: DataFrame, assignment: DataFrame, own: DataFrame) -> DataFrame:
    """(node, rows): sum over paths from stored nodes through views of rows times reference counts."""
    views = assignment.filter("t = 0").select("node")
    step = cut(edges.groupBy("parent", "child").agg(F.sum("weight").alias("weight")))
    frontier = cut(own.join(step, F.col("node") == F.col("parent")).groupBy(F.col("child").alias("node")).agg(F.sum(F.col("rows") * F.col("weight")).alias("rows")))
    found = frontier
    while True:
        frontier = cut(
            frontier.join(views, "node", "left_semi").join(step, F.col("node") == F.col("parent")).groupBy(F.col("child").alias("node"))
            .agg(F.sum(F.col("rows") * F.col("weight")).alias("rows"))
        )
        if frontier.isEmpty():
            return found.groupBy("node").agg(F.sum("rows").alias("rows"))
        found = found.union(frontier)


def clamp(c, low: float = 0.0):
    return F.greatest(F.lit(low), F.least(F.lit(CLAMP), c))


def objective(node_cost: DataFrame, edge_cost: DataFrame, assignment: DataFrame, flips: int = 0, penalty: float = 1.0) -> DataFrame:
    """One row ``cost``: sum of t_j B_j, of U_ij (1 - t_i) t_j, and the penalty of the flips."""
    t = assignment.select(F.col("node").alias("n"), "t")
    b = node_cost.join(t, F.col("node") == F.col("n")).agg(F.coalesce(F.sum(F.col("t") * F.col("b")), F.lit(0.0)).alias("b"))
    ti = assignment.select(F.col("node").alias("parent"), F.col("t").alias("ti"))
    tj = assignment.select(F.col("node").alias("child"), F.col("t").alias("tj"))
    u = edge_cost.join(ti, "parent").join(tj, "child").agg(F.coalesce(F.sum(F.col("u") * (1 - F.col("ti")) * F.col("tj")), F.lit(0.0)).alias("u"))
    return b.crossJoin(u).select((F.col("b") + F.col("u") + F.lit(float(penalty * flips))).alias("cost"))  # one row each


def per_child_cost(node_cost: DataFrame, edge_cost: DataFrame, assignment: DataFrame) -> DataFrame:
    """(node, cost) of every stored node: B and the U of its view parents."""
    ti = assignment.select(F.col("node").alias("parent"), F.col("t").alias("ti"))
    extra = edge_cost.join(ti, "parent").filter("ti = 0").groupBy(F.col("child").alias("node")).agg(F.sum("u").alias("extra"))
    return (
        node_cost.join(assignment.filter("t = 1"), "node").join(extra, "node", "left")
        .select("node", (F.col("b") + F.coalesce("extra", F.lit(0.0))).alias("cost"))
    )


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(node, t0, t1) where two assignments differ."""
    return before.select("node", F.col("t").alias("t0")).join(after.select("node", F.col("t").alias("t1")), "node").filter("t0 <> t1")


def node_levels(edges: DataFrame) -> DataFrame:
    return levels(edges)


# Flip search ------------------------------------------------------------------


def flip_gains(node_cost: DataFrame, edge_cost: DataFrame, assignment: DataFrame) -> DataFrame:
    """(node, s, d): change of the objective when one node alone flips; s is 1 for a view, -1 for a table."""
    t = assignment.select(F.col("node").alias("n"), F.col("t").alias("tn"))
    up = edge_cost.join(t, F.col("parent") == F.col("n")).groupBy(F.col("child").alias("node")).agg(F.sum(F.col("u") * (1 - F.col("tn"))).alias("from_views"))
    down = edge_cost.join(t, F.col("child") == F.col("n")).groupBy(F.col("parent").alias("node")).agg(F.sum(F.col("u") * F.col("tn")).alias("into_tables"))
    zero = F.lit(0.0)
    return (
        assignment.join(node_cost, "node", "left").join(up, "node", "left").join(down, "node", "left")
        .select("node", (1 - 2 * F.col("t")).alias("s"), "b", "from_views", "into_tables")
        .select("node", "s", (F.col("s") * (F.coalesce("b", zero) + F.coalesce("from_views", zero) - F.coalesce("into_tables", zero))).alias("d"))
    )


def best_flips(node_cost: DataFrame, edge_cost: DataFrame, assignment: DataFrame, free: DataFrame, most: int = 3, penalty: float = 1.0) -> DataFrame:
    """One row (nodes, change): the exact best set of at most ``most`` (3) flips among the ``free`` nodes.

    The change of a set is the sum of its single changes less s_i s_j U_ij for its edges, so sets are
    enumerated as: singles; pairs and triples joined by edges; and unconnected unions of the best.
    Ties: fewer flips, then names. An empty set (change 0) is allowed.
    """
    g = cut(flip_gains(node_cost, edge_cost, assignment).join(free.select("node"), "node", "left_semi").select("node", "s", (F.col("d") + penalty).alias("d")))
    x = edge_cost.groupBy(F.least("parent", "child").alias("a"), F.greatest("parent", "child").alias("b")).agg(F.sum("u").alias("u"))
    a = g.select(F.col("node").alias("a"), F.col("s").alias("sa"), F.col("d").alias("da"))
    b = g.select(F.col("node").alias("b"), F.col("s").alias("sb"), F.col("d").alias("db"))
    linked = cut(x.join(a, "a").join(b, "b").select("a", "b", (-F.col("sa") * F.col("sb") * F.col("u")).alias("w")))
    # A set that helps holds a single of negative change or an edge of negative weight; all others
    # in it are among the best few by change, or neighbours of it. The frontier is one project's nodes.
    rows, pairs = {r["node"]: r["d"] for r in g.collect()}, {(r["a"], r["b"]): r["w"] for r in linked.collect()}
    near: dict[str, set[str]] = {}
    for p, q in pairs:
        near.setdefault(p, set()).add(q)
        near.setdefault(q, set()).add(p)

    def change(nodes: tuple[str, ...]) -> float:
        return sum(rows[n] for n in nodes) + sum(pairs.get((p, q), 0.0) for i, p in enumerate(nodes) for q in nodes[i + 1 :])

    connected: set[tuple[str, ...]] = {(n,) for n in rows}
    grown = connected
    for _ in range(most - 1):
        grown = {tuple(sorted({*s, m})) for s in grown for n in s for m in near.get(n, ()) if m not in s}
        connected |= grown
    valued = {s: change(s) for s in connected}
    helpful = sorted((s for s in valued if valued[s] < 0), key=lambda s: (valued[s], len(s), s))
    best = ((), 0.0)

    def walk(k: int, chosen: tuple[str, ...], total: float) -> None:
        nonlocal best
        if (round(total, 9), len(chosen), chosen) < (round(best[1], 9), len(best[0]), best[0]):
            best = (chosen, total)
        room = most - len(chosen)
        for j in range(k, len(helpful)):
            s = helpful[j]
            if total + room * valued[s] >= best[1] - 1e-9:
                break  # even the best remaining value for every free place does not improve
            if len(s) <= room and not set(s) & set(chosen) and not any(near.get(n, set()) & set(chosen) for n in s):
                walk(j + 1, tuple(sorted(chosen + s)), total + valued[s])

    walk(0, (), 0.0)
    return node_cost.sparkSession.createDataFrame([(list(best[0]), float(best[1]))], "nodes array<string>, change double")


def tune(
    edges: DataFrame, assignment: DataFrame, costs, targets: set[str] | None = None, most: int = 3, penalty: float = 1.0, rounds: int = 30, fan_out: int = 20,
) -> tuple[DataFrame, list[dict]]:
    """Iterative local search: rebuild B and U by ``costs(assignment)``, flip the best few nodes, repeat.

    Targets (leaves, nodes of more than ``fan_out`` children, and those given) are stored first and
    never flipped. Stops without an improving flip, at a repeated assignment, or after ``rounds``.
    """
    spark = edges.sparkSession
    out_degree = edges.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n"))
    from .graph import leaves

    forced = {r["node"] for r in leaves(edges).union(out_degree.filter(F.col("n") > fan_out).select("node")).collect()} | (targets or set())
    t = {r["node"]: (1 if r["node"] in forced else r["t"]) for r in assignment.collect()}
    seen, history = {tuple(sorted(t.items()))}, []
    for k in range(rounds):
        now = spark.createDataFrame(sorted(t.items()), "node string, t int")
        b, u = costs(now)
        free = spark.createDataFrame([(n,) for n in t if n not in forced], "node string")
        row = best_flips(b, u, now, free, most, penalty).first()
        cost = objective(b, u, now).first()["cost"]
        history.append({"iteration": k, "cost": cost, "flips": list(row["nodes"]), "change": row["change"]})
        if not row["nodes"]:
            break
        t = {n: 1 - v if n in row["nodes"] else v for n, v in t.items()}
        state = tuple(sorted(t.items()))
        if state in seen:
            break
        seen.add(state)
    return spark.createDataFrame(sorted(t.items()), "node string, t int"), history
