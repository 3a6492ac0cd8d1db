"""B and U of the flip search from a learned time model, and cardinalities of new tables.

``model.predict(df, out)`` adds a cost column to a frame with one column for each of ``names``
(``log_rows`` among them), as :class:`millrace.functions.regression.HuberModel` does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cut import cut
from ..functions.regression import wide
from .cost import CLAMP, clamp, expand_views, objective
from .graph import levels


def _predicted(long: DataFrame, rows: DataFrame, model, names: list[str], key: list[str], out: str) -> DataFrame:
    """Costs of (key, feature, value) rows with ``rows`` (key, rows) as the log_rows feature."""
    node = F.concat_ws("\x01", *key)
    plain = [n for n in names if n != "log_rows"]
    f = wide(long.select(node.alias("node"), "feature", "value"), plain).withColumnRenamed("node", "__id")
    r = rows.select(node.alias("__id"), *key, F.log1p(F.greatest(F.lit(0.0), "rows")).alias("log_rows"))
    full = r.join(f, "__id", "left").na.fill(0.0, plain)
    return model.predict(full, out).select(*key, F.col(out).cast("double").alias(out))


def input_rows(edges: DataFrame, cards: DataFrame) -> DataFrame:
    """(node, rows): unweighted sum of the parents' rows; every node of the graph."""
    every = edges.select(F.col("child").alias("node")).union(edges.select(F.col("parent").alias("node"))).distinct()
    pairs = edges.select("parent", "child").distinct()
    fed = pairs.join(cards.select(F.col("node").alias("parent"), "rows"), "parent").groupBy(F.col("child").alias("node")).agg(F.sum("rows").alias("rows"))
    return every.join(fed, "node", "left").select("node", F.coalesce("rows", F.lit(0.0)).alias("rows"))


def baseline_costs(edges: DataFrame, features: DataFrame, cards: DataFrame, model, names: list[str]) -> DataFrame:
    """(node, b): cost of each node when all its parents are stored."""
    got = _predicted(features, input_rows(edges, cards), model, names, ["node"], "b")
    return got.withColumn("b", clamp(F.col("b")))


def view_costs(edges: DataFrame, assignment: DataFrame, features: DataFrame, cards: DataFrame, base: DataFrame, model, names: list[str]) -> DataFrame:
    """(parent, child, u): what a child costs more when this parent is inlined.

    The parent's features, with those of the views above it, are added times the references, and
    the rows that reach the parent stand in for the parent's own.
    """
    own = features.select(F.col("node").alias("child"), "feature", "value")
    full = expand_views(edges, assignment, features).select(F.col("node").alias("parent"), "feature", F.col("value").alias("more"))
    added = edges.join(full, "parent").select("parent", "child", "feature", (F.col("more") * F.col("weight")).alias("value"))
    long = edges.select("parent", "child").join(own, "child").select("parent", "child", "feature", "value").union(added).groupBy("parent", "child", "feature").agg(F.sum("value").alias("value"))
    into = input_rows(edges, cards)
    rows = (
        edges.select("parent", "child").distinct()
        .join(into.select(F.col("node").alias("child"), F.col("rows").alias("all")), "child")
        .join(into.select(F.col("node").alias("parent"), F.col("rows").alias("above")), "parent")
        .join(cards.select(F.col("node").alias("parent"), F.col("rows").alias("own")), "parent", "left")
        .select("parent", "child", (F.col("all") - F.coalesce("own", F.lit(0.0)) + F.col("above")).alias("rows"))
    )
    got = _predicted(long, rows, model, names, ["parent", "child"], "with_view")
    return got.join(base.select(F.col("node").alias("child"), "b"), "child").select("parent", "child", clamp(F.col("with_view") - F.col("b"), -CLAMP).alias("u"))


def fill_cardinalities(edges: DataFrame, features: DataFrame, known: DataFrame, model, names: list[str]) -> DataFrame:
    """(node, rows, predicted): known rows, and predictions for other nodes level by level, from their inputs."""
    at = cut(levels(edges))
    cards = known.select("node", F.col("rows").cast("double").alias("rows"), F.lit(False).alias("predicted"))
    for k in range(1, (at.agg(F.max("level")).first()[0] or 0) + 1):
        new = at.filter(F.col("level") == k).select("node").join(cards.select("node"), "node", "left_anti")
        rows = input_rows(edges, cards.select("node", "rows")).join(new, "node", "left_semi")
        got = _predicted(features.join(new, "node", "left_semi"), rows, model, names, ["node"], "rows_predicted")
        cards = cut(cards.union(got.select("node", F.col("rows_predicted"), F.lit(True))))
    return cards


def pipeline_cost(edges: DataFrame, assignment: DataFrame, features: DataFrame, cards: DataFrame, model, names: list[str]) -> DataFrame:
    """One row ``cost`` of a whole DAG under an assignment."""
    base = cut(baseline_costs(edges, features, cards, model, names))
    return objective(base, view_costs(edges, assignment, features, cards, base, model, names), assignment)
