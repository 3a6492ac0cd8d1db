"""Refresh frequencies: how often inputs change, how often outputs are used, and what follows.

Levels are 1 weekly, 2 daily, 3 hourly; 0 is never. Multipliers count refreshes a week.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cut import cut
from .graph import descendant_count, leaves, roots

#: Refreshes a week by level (fixed values).
MULTIPLIERS = {1: 1, 2: 7, 3: 168}
#: Scenario presets: shares of (weekly, daily, hourly) for roots of wide and narrow reach, and for leaves (fixed values).
SCENARIOS = {
    "batch_heavy": {"high_root_ratios": (0.10, 0.85, 0.05), "low_root_ratios": (0.00, 0.30, 0.70), "leaf_ratios": (0.05, 0.15, 0.80)},
    "moderate_mismatch": {"high_root_ratios": (0.25, 0.70, 0.05), "low_root_ratios": (0.00, 0.15, 0.85), "leaf_ratios": (0.05, 0.20, 0.75)},
    "mixed_cadence": {"high_root_ratios": (0.40, 0.55, 0.05), "low_root_ratios": (0.00, 0.00, 1.00), "leaf_ratios": (0.10, 0.25, 0.65)},
}


def multiplier(level: Column) -> Column:
    out = F.lit(0)
    for k, v in MULTIPLIERS.items():
        out = F.when(level == k, v).otherwise(out)
    return out


def listed_roots(edges: DataFrame) -> DataFrame:
    return roots(edges).filter(~F.col("node").startswith("model.elementary.") & ~F.col("node").startswith("test."))


def listed_leaves(edges: DataFrame) -> DataFrame:
    return leaves(edges).filter(~F.col("node").startswith("model.elementary.") & ~F.col("node").startswith("test."))


def _spread(edges: DataFrame, start: DataFrame, near: str, far: str) -> DataFrame:
    """(node, level): the largest level that reaches a node along the edges, one step a round, only where it grows."""
    step = edges.select(F.col(near).alias("node"), F.col(far).alias("next")).distinct()
    found = cut(start.groupBy("node").agg(F.max("level").alias("level")))
    grown = found
    while True:
        reached = grown.join(step, "node").groupBy(F.col("next").alias("node")).agg(F.max("level").alias("level"))
        known = found.select("node", F.col("level").alias("before"))
        grown = cut(reached.join(known, "node", "left").filter("before is null or level > before").select("node", "level"))
        if grown.isEmpty():
            return found
        found = cut(found.union(grown).groupBy("node").agg(F.max("level").alias("level")))


def change_frequency(edges: DataFrame, root_levels: DataFrame) -> DataFrame:
    """(node, change): the largest level among a node's roots, which flows downstream."""
    return _spread(edges, root_levels.select("node", "level"), "parent", "child").withColumnRenamed("level", "change")


def use_frequency(edges: DataFrame, leaf_levels: DataFrame) -> DataFrame:
    """(node, use): the largest level among a node's consumers, which flows upstream."""
    return _spread(edges, leaf_levels.select("node", "level"), "child", "parent").withColumnRenamed("level", "use")


def real_frequency(change: DataFrame, use: DataFrame) -> DataFrame:
    """(node, real, multiplier): the smaller of both; nodes that never change or are never used are left out."""
    both = change.join(use, "node", "full").select("node", F.least(F.coalesce("change", F.lit(0)), F.coalesce("use", F.lit(0))).alias("real"))
    return both.filter("real > 0").withColumn("multiplier", multiplier(F.col("real")))


def savings(costs: DataFrame, use: DataFrame, real: DataFrame) -> DataFrame:
    """One row: cost a week when scheduled by use, by real need, and the ratio saved."""
    c = costs.select("node", "slot_ms").join(use, "node", "left").join(real.select("node", "real"), "node", "left")
    s = c.agg(
        F.sum(F.col("slot_ms") * multiplier(F.coalesce("use", F.lit(0)))).alias("scheduled"),
        F.sum(F.col("slot_ms") * multiplier(F.coalesce("real", F.lit(0)))).alias("needed"),
    )
    return s.withColumn("saved", F.col("scheduled") - F.col("needed")).withColumn("ratio", F.when(F.col("scheduled") > 0, F.col("saved") / F.col("scheduled")).otherwise(0.0))


def split_candidates(edges: DataFrame, change: DataFrame, real: DataFrame) -> DataFrame:
    """Nodes with two parents and more, of which some change more slowly than the node is refreshed and some do not."""
    e = edges.join(change.select(F.col("node").alias("parent"), "change"), "parent").join(real.select(F.col("node").alias("child"), "real"), "child")
    slow = F.sum(F.when(F.col("change") < F.col("real"), 1).otherwise(0))
    return (
        e.groupBy(F.col("child").alias("node")).agg(F.count("*").alias("parents"), slow.alias("slower"))
        .filter("parents >= 2 and slower >= 1 and slower < parents")
    )


def assign_levels(nodes: DataFrame, ratios: tuple[float, float, float], seed: int, remainder: str = "largest") -> DataFrame:
    """(node, level): nodes dealt to levels by ratio in a seeded order.

    What rounding leaves goes to the ``largest`` ratio's level, or to the ``last`` one.
    """
    order = Window.orderBy(F.xxhash64(F.lit(seed), "node"), "node")  # one project's nodes
    ranked = nodes.select("node").withColumn("k", F.row_number().over(order))
    n = nodes.count()
    counts = [int(n * r) for r in ratios]
    counts[2 if remainder == "last" else max(range(3), key=lambda i: (ratios[i], -i))] += n - sum(counts)
    return ranked.select("node", F.when(F.col("k") <= counts[0], 1).when(F.col("k") <= counts[0] + counts[1], 2).otherwise(3).alias("level"))


def frequency_profile(edges: DataFrame, scenario: str = "mixed_cadence", seed: int = 42, high_reach: int = 50, settings: dict | None = None) -> dict[str, DataFrame]:
    """Root and leaf levels and the node frequencies that follow from them.

    Roots that reach ``high_reach`` nodes and more use their own ratios; the root of widest reach is never hourly.
    """
    s = (settings or SCENARIOS)[scenario]
    reach = listed_roots(edges).join(descendant_count(edges), "node", "left").select("node", F.coalesce("descendants", F.lit(0)).alias("descendants"))
    top = reach.orderBy(F.desc("descendants"), "node").limit(1).select("node", F.lit(1).alias("top"))
    wide = assign_levels(reach.filter(F.col("descendants") >= high_reach), s["high_root_ratios"], seed)
    narrow = assign_levels(reach.filter(F.col("descendants") < high_reach), s["low_root_ratios"], seed)
    root_levels = wide.union(narrow).join(top, "node", "left").select("node", F.when(F.col("top").isNotNull() & (F.col("level") == 3), 2).otherwise(F.col("level")).alias("level"))
    leaf_levels = assign_levels(listed_leaves(edges), s["leaf_ratios"], seed)
    change, use = change_frequency(edges, root_levels), use_frequency(edges, leaf_levels)
    return {"root_levels": root_levels, "leaf_levels": leaf_levels, "change": change, "use": use, "real": real_frequency(change, use)}


def weigh_costs(node_cost: DataFrame, edge_cost: DataFrame, real: DataFrame) -> tuple[DataFrame, DataFrame]:
    """B and U times the multiplier of the node, or of the edge's child; 1 where none is known."""
    m = real.select(F.col("node").alias("n"), F.col("multiplier").alias("m"))
    b = node_cost.join(m, F.col("node") == F.col("n"), "left").select("node", (F.col("b") * F.coalesce("m", F.lit(1))).alias("b"))
    u = edge_cost.join(m, F.col("child") == F.col("n"), "left").select("parent", "child", (F.col("u") * F.coalesce("m", F.lit(1))).alias("u"))
    return b, u
