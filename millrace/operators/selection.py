"""Choosing among rewrites: deltas, conflicts, selection, and consensus on materializations."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_of(candidate: str = "candidate"):
    """Group number in a candidate's name (``cc_3`` or ``group_3``); null without one."""
    found = F.regexp_extract(candidate, r"(?:cc|group)_(\d+)", 1)
    return F.when(found != "", F.concat(F.lit("group_"), found))


def deltas(original_cost: float, candidates: DataFrame) -> DataFrame:
    """(candidate, group, cost, delta): what each candidate (candidate, cost) saves."""
    return candidates.select("candidate", group_of().alias("group"), "cost", (F.lit(float(original_cost)) - F.col("cost")).alias("delta"))


def changed_uids(candidate_models: DataFrame) -> DataFrame:
    """(group, uid) of models that a group rewrites, adds or removes."""
    return candidate_models.filter("rewritten or is_new or removed").select("group", "uid").distinct()


def conflicts(changed: DataFrame) -> DataFrame:
    """(g1, g2, overlapping): groups that change the same models."""
    a = changed.select(F.col("group").alias("g1"), "uid")
    b = changed.select(F.col("group").alias("g2"), "uid")
    return a.join(b, "uid").filter("g1 < g2").groupBy("g1", "g2").agg(F.array_sort(F.collect_set("uid")).alias("overlapping"))


def best_variants(found: DataFrame) -> DataFrame:
    """The best candidate of each group, if it saves anything; ties by name."""
    w = Window.partitionBy("group").orderBy(F.desc("delta"), "candidate")
    return found.filter("group is not null and delta > 0").withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def heaviest_independent(weight: dict[str, float], pairs: set[tuple[str, str]]) -> list[str]:
    """Heaviest set of groups without a conflict, by branch and bound in each conflict component."""
    near: dict[str, set[str]] = defaultdict(set)
    for a, b in pairs:
        if a in weight and b in weight:
            near[a].add(b)
            near[b].add(a)
    left, out = set(weight), []
    while left:
        part, todo = set(), [min(left)]
        while todo:
            x = todo.pop()
            if x not in part:
                part.add(x)
                todo += near[x] - part
        left -= part
        order = sorted(part, key=lambda g: (-weight[g], g))
        best: tuple[float, list[str]] = (-1.0, [])
        stack: list[tuple[int, list[str], set[str], float, float]] = [(0, [], set(), 0.0, sum(weight[g] for g in part))]
        while stack:
            k, chosen, banned, total, rest = stack.pop()
            if total > best[0] + 1e-12:
                best = (total, chosen)
            if k == len(order) or total + rest <= best[0] + 1e-12:
                continue
            g = order[k]
            stack.append((k + 1, chosen, banned, total, rest - weight[g]))
            if g not in banned:  # looked at first
                stack.append((k + 1, [*chosen, g], banned | near[g], total + weight[g], rest - weight[g]))
        out += best[1]
    return sorted(out)


def select(found: DataFrame, pairs: DataFrame | None) -> dict[str, DataFrame]:
    """The conflict-free set of largest total delta, and what was left out and why.

    Candidates and their conflicts are one project's, so the search runs on the driver.
    """
    spark = found.sparkSession
    best = best_variants(found)
    rows = {r["group"]: r for r in best.collect()}
    clash = {(r["g1"], r["g2"]) for r in pairs.select("g1", "g2").collect()} if pairs is not None else set()
    chosen = heaviest_independent({g: r["delta"] for g, r in rows.items()}, clash)
    taken = spark.createDataFrame([(g,) for g in chosen], "group string")
    selected = best.join(taken, "group", "left_semi")
    excluded = [g for g in rows if g not in chosen and any((min(g, c), max(g, c)) in clash for c in chosen)]
    return {
        "selected": selected,
        "total": selected.agg(F.coalesce(F.sum("delta"), F.lit(0.0)).alias("total_benefit"), F.count("*").alias("n")),
        "excluded_by_conflict": best.join(spark.createDataFrame([(g,) for g in excluded], "group string"), "group", "left_semi"),
        "not_selected": found.join(selected.select("candidate"), "candidate", "left_anti"),
    }


def collisions(changed: DataFrame, selected_groups: DataFrame) -> DataFrame:
    """Models that two selected groups change; must be empty before a selection is applied."""
    return changed.join(selected_groups.select("group"), "group", "left_semi").groupBy("uid").agg(F.count_distinct("group").alias("groups")).filter("groups > 1")


def consensus(original: DataFrame, votes: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Materialization by vote: (uid, original, value, votes, outcome).

    ``votes``: (group, position, uid, value), ``position`` giving the order of the groups. The most
    frequent value wins (ties: first seen) if it has ``max(1, int(groups * threshold))`` votes,
    counted over all groups; otherwise the original stays.
    """
    groups = votes.select("group").distinct().agg(F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(threshold) + F.lit(1e-9))).alias("least"))
    counted = votes.groupBy("uid", "value").agg(F.count("*").alias("votes"), F.min("position").alias("seen"))
    w = Window.partitionBy("uid").orderBy(F.desc("votes"), "seen", "value")
    top = counted.withColumn("k", F.row_number().over(w)).filter("k = 1").select("uid", F.col("value").alias("voted"), "votes")
    out = original.select("uid", F.col("value").alias("original")).join(top, "uid", "left").crossJoin(F.broadcast(groups))  # one row
    enough = F.coalesce(F.col("votes") >= F.col("least"), F.lit(False))
    outcome = (
        F.when(F.col("votes").isNull(), "no votes").when(~enough, "kept, no majority")
        .when(F.col("voted") == F.col("original"), "confirmed").otherwise("changed")
    )
    return out.select("uid", "original", F.when(enough, F.col("voted")).otherwise(F.col("original")).alias("value"), F.coalesce("votes", F.lit(0)).alias("votes"), outcome.alias("outcome"))


def consensus_with_fallback(original: DataFrame, weighted: DataFrame, plain: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Votes of the frequency-weighted runs, or of the plain run for groups that have none."""
    missing = plain.join(weighted.select("group").distinct(), "group", "left_anti")
    return consensus(original, weighted.union(missing.select(weighted.columns)), threshold)
