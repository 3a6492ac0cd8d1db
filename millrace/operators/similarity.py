"""Set and multiset similarity over ``tokens(owner, token, weight)`` DataFrames.

Scored pairs come from blocks of owners that are compared with each other (:mod:`.blocks`) after weights are summed for each
owner and token; no table of co-occurrences is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cut import stored
from .blocks import bag_pairs


def bags(tokens: DataFrame) -> DataFrame:
    """One row for each owner and token."""
    return tokens.groupBy("owner", "token").agg(F.sum("weight").alias("weight"))


def idf(tokens: DataFrame) -> DataFrame:
    """(token, idf): ln((N + 1) / (df + 1)) + 1 over owners."""
    return _idf(tokens.select("owner", "token").distinct())


def _idf(bag: DataFrame) -> DataFrame:
    n = bag.select("owner").distinct().agg(F.count("*").alias("n"))
    df = bag.groupBy("token").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).select("token", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def jaccard_pairs(tokens: DataFrame, at_least: float = 0.0, best: int | None = None) -> DataFrame:
    """(a, b, shared, score): sum of minima over sum of maxima; pairs without a common token are left out.

    With ``best``, pairs that are not among the so many best by score, a, b may be left out too.
    """
    return bag_pairs(bags(tokens), at_least, best)


def idf_jaccard_pairs(tokens: DataFrame, at_least: float = 0.0) -> DataFrame:
    """Jaccard with weights multiplied by the token's idf; ``shared`` is the shared weight."""
    bag = stored(bags(tokens), "bags")
    return bag_pairs(bag.join(_idf(bag), "token").select("owner", "token", (F.col("weight") * F.col("idf")).alias("weight")), at_least)


def anchored_pairs(tokens: DataFrame, least_anchor: float = 0.0, top: int = 2000) -> DataFrame:
    """Pairs sharing an anchor token (``join:`` or ``gk:``), scored on all tokens; the best ``top``."""
    anchors = tokens.filter(F.col("token").startswith("join:") | F.col("token").startswith("gk:"))
    near = jaccard_pairs(anchors, least_anchor).select("a", "b")
    return jaccard_pairs(tokens).join(near, ["a", "b"], "left_semi").orderBy(F.desc("score"), "a", "b").limit(top)


def top_pairs(pairs: DataFrame, k: int) -> DataFrame:
    return pairs.orderBy(F.desc("score"), "a", "b").limit(k)


def model_edges(scope_pairs: DataFrame, owner_model: DataFrame, at_least: float = 0.6) -> DataFrame:
    """Scope pairs to model pairs (a, b, score) by their maximum; pairs within a model are left out."""
    ma = owner_model.select(F.col("owner").alias("a"), F.col("model").alias("ma"))
    mb = owner_model.select(F.col("owner").alias("b"), F.col("model").alias("mb"))
    return (
        scope_pairs.join(ma, "a").join(mb, "b").filter("ma <> mb")
        .groupBy(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).agg(F.max("score").alias("score"))
        .filter(F.col("score") >= at_least)
    )


def common_backbones(tokens: DataFrame, scope: str = "owner") -> DataFrame:
    """(a, b, common, mass): the multiset that two owners share, as a sorted array of (token, n)."""
    bag = bags(tokens.withColumn("weight", F.col("weight").cast("long")))
    shared = bag.join(bag.groupBy("token").count().filter("count > 1").select("token"), "token", "left_semi")
    x = shared.select(F.col("owner").alias("a"), "token", F.col("weight").alias("wa"))
    y = shared.select(F.col("owner").alias("b"), "token", F.col("weight").alias("wb"))
    return x.join(y, "token").filter("a < b").groupBy("a", "b").agg(
        F.array_sort(F.collect_list(F.struct("token", F.least("wa", "wb").alias("n")))).alias("common"), F.sum(F.least("wa", "wb")).alias("mass")
    )


def backbone_groups(tokens: DataFrame, top: int = 30) -> DataFrame:
    """Shared patterns with the owners that hold them, scored mass x owners, the best ``top``.

    A pattern's owners are those whose bag contains it as a multiset, so support needs no order of
    propagation; owners that share nothing form patterns of their own.
    """
    bag = bags(tokens.withColumn("weight", F.col("weight").cast("long")))
    pairs = common_backbones(tokens)
    patterns = pairs.select(F.to_json("common").alias("pattern"), "common", "mass").dropDuplicates(["pattern"])
    items = patterns.select("pattern", F.size("common").alias("k"), "mass", F.explode("common").alias("i")).select("pattern", "k", "mass", "i.token", "i.n")
    support = (
        items.join(bag, "token").filter(F.col("weight") >= F.col("n")).groupBy("pattern", "k", "mass", "owner").count()
        .filter(F.col("count") == F.col("k"))
        .groupBy("pattern", "mass").agg(F.array_sort(F.collect_set("owner")).alias("owners"))
    )
    lone = bag.join(support.select(F.explode("owners").alias("owner")).distinct(), "owner", "left_anti")
    own = lone.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("token", F.col("weight").alias("n")))).alias("c"), F.sum("weight").alias("mass"))
    every = support.union(own.select(F.to_json("c"), "mass", F.array("owner")))
    return (
        every.withColumn("n_owners", F.size("owners").cast("long")).withColumn("score", F.col("mass") * F.col("n_owners"))
        .orderBy(F.desc("score"), F.desc("n_owners"), "pattern").limit(top)
    )


# Plain values ----------------------------------------------------------------


def jaccard(a: dict, b: dict, weight: dict | None = None) -> float:
    """Sum of minima over sum of maxima; 0 if either is empty."""
    if not a or not b:
        return 0.0
    w = weight or {}
    low = sum(min(a.get(t, 0), b.get(t, 0)) * w.get(t, 1) for t in a)
    high = sum(max(a.get(t, 0), b.get(t, 0)) * w.get(t, 1) for t in a.keys() | b.keys())
    return low / high if high else 0.0


def shared_weight(a: dict, b: dict, weight: dict) -> float:
    return sum(weight.get(t, 0.0) for t in a.keys() & b.keys())


def anchor_distance(a: set, b: set) -> int:
    return max(len(a), len(b)) - len(a & b)


def substitution_distance(a: set, b: set) -> int:
    """Substitutions that turn one set into the other of the same size."""
    if len(a) != len(b):
        raise ValueError("sets of different sizes")
    return len(a ^ b) // 2


def add_scaled(into: dict, source: dict, scale: float = 1.0) -> dict:
    for k, v in source.items():
        into[k] = into.get(k, 0) + scale * v
    return into
