"""Learned costs end to end: run a project, fit the time of its models, and tune what is stored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.cut import cut
from .functions.regression import HuberModel, fit_huber, wide
from .operators import cost, costmodel
from .plans.catalyst import FOR_TIME
from .plans.lineage import Lineage
from .plans.project import Project
from .runner import run


@dataclass
class LinearTime:
    """A time model with given coefficients: expm1 of a sum over ``names``, clamped like a fitted one."""

    coefficients: dict[str, float]
    intercept: float = 0.0

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        total: Column = F.lit(self.intercept)
        for name, c in self.coefficients.items():
            total = total + F.lit(c) * F.col(name)
        return df.withColumn(out, F.greatest(F.lit(0.0), F.expm1(F.least(F.lit(20.0), total))))


def feature_table(spark: SparkSession, lineage: Lineage) -> DataFrame:
    """(node, feature, value) of every model's statement."""
    rows = [(f"model.{m}", f, float(v)) for m, f, v in lineage.feature_rows()]
    return spark.createDataFrame(rows, "node string, feature string, value double")


def measure(spark: SparkSession, project: Project, sf_dir: str) -> DataFrame:
    """(node, slot_ms, rows) of all models, each stored and timed, and of the source tables (no time)."""
    got = run(spark, project.with_assignment({n.unique_id: "table" for n in project.models()}), sf_dir, workers=1)
    stats = [(u, ms, float(rows)) for u, _, ms, rows in got.stats]
    got.drop(spark)
    sources = [(n.unique_id, None, float(spark.read.parquet(f"{sf_dir}/{n.name}.parquet").count())) for n in project.nodes.values() if n.resource_type == "source"]
    return spark.createDataFrame(stats + sources, "node string, slot_ms double, rows double")


def fit_time(edges: DataFrame, features: DataFrame, measured: DataFrame, names: tuple[str, ...] = FOR_TIME) -> tuple[HuberModel, list[str]]:
    """Huber regression of the measured times on the statements' features and the rows that go in."""
    into = costmodel.input_rows(edges, measured.select("node", "rows"))
    rows = (
        wide(features, list(names)).join(into.select("node", F.log1p("rows").alias("log_rows")), "node")
        .join(measured.filter("slot_ms is not null").select("node", "slot_ms"), "node")
    )
    used = [*names, "log_rows"]
    return fit_huber(cut(rows), used, "slot_ms"), used


def tune_project(spark: SparkSession, project: Project, sf_dir: str, lineage: Lineage, model=None, names: list[str] | None = None) -> tuple[Project, DataFrame]:
    """The project with its tuned assignment, and one row (before, after) of predicted costs.

    Without a model one is fitted on a run with everything stored. The search starts there.
    """
    edges, features = project.edges_df(spark), cut(feature_table(spark, lineage))
    measured = cut(measure(spark, project, sf_dir))
    cards = measured.select("node", "rows")
    if model is None:
        model, names = fit_time(edges, features, measured)
    between = cut(edges.filter("parent like 'model.%'"))
    base = cut(costmodel.baseline_costs(edges, features, cards, model, names).filter("node like 'model.%'"))

    def costs(assignment: DataFrame) -> tuple[DataFrame, DataFrame]:
        # Rows that go in come from all parents; only models can be inlined.
        return base, cut(costmodel.view_costs(edges, assignment, features, cards, base, model, names).filter("parent like 'model.%'"))

    start = spark.createDataFrame([(n.unique_id, 1) for n in project.models()], "node string, t int")
    # Leaves that only read sources are no end of an edge between models.
    tuned, history = cost.tune(between, start, costs, targets={u for u in project.leaves() if project.nodes[u].resource_type == "model"})
    kept = {r["node"]: "table" if r["t"] else "view" for r in tuned.collect()}
    return project.with_assignment(kept), spark.createDataFrame([(history[0]["cost"], history[-1]["cost"])], "before double, after double")
