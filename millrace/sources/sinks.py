"""Writers: JSON reports, project folders, materialization tables."""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterable

from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession

from ..functions.regression import HuberModel
from ..plans.project import Project


def write_json(value, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, sort_keys=True, default=str)


def subgraph_json(project: Project, group: str, nodes: set[str], core: set[str], params: dict, meta: dict | None = None) -> dict:
    """A subgraph with its models, as a value for :func:`write_json`."""
    return {
        "group_id": group, "group_metadata": meta or {}, "extraction_params": params,
        "subgraph": {
            "all_nodes": sorted(nodes), "component_nodes": sorted(core), "context_nodes": sorted(nodes - core),
            "roots": sorted(u for u in nodes if not project.parents[u] & nodes),
            "edges": {u: sorted(project.children[u] & nodes) for u in sorted(nodes)},
            "has_external_children": {u: bool(project.children[u] - nodes) and bool(project.children[u] & nodes) for u in sorted(nodes)},
        },
        "models": {u: {"name": n.name, "raw_code": n.sql, "materialized": n.materialized} for u in sorted(nodes) if (n := project.nodes[u]).resource_type == "model"},
    }


def whole_project_json(project: Project, group: str = "group_0") -> dict:
    nodes = {n.unique_id for n in project.models()}
    return subgraph_json(project, group, nodes, nodes, {"whole": True})


def skeletons(bags: dict[str, Counter]) -> dict[str, dict[str, int]]:
    return {m: dict(sorted(b.items())) for m, b in sorted(bags.items())}


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_features(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def new_model_folder(paths: dict[str, str], name: str, consumers: Iterable[str]) -> str:
    """Folder of a new model: the deepest that holds all its consumers, else of the model with the longest common name start, else ``models``."""
    folders = {os.path.dirname(paths[c]) for c in consumers if c in paths}
    if folders:
        return os.path.commonpath(folders)
    best = max(paths, key=lambda m: (len(os.path.commonprefix([m, name])), m), default="")
    return os.path.dirname(paths[best]) if best and len(os.path.commonprefix([best, name])) > 2 else "models"


def save_time_model(model: HuberModel, path: str) -> None:
    """A fitted model and what it needs to be applied."""
    model.model.write().overwrite().save(f"{path}/model")
    spark = model.model.summary.predictions.sparkSession if model.model.hasSummary else SparkSession.active()
    spark.createDataFrame([(model.names, [float(x) for x in model.scale])], "names array<string>, scale array<double>").write.mode("overwrite").parquet(f"{path}/inputs")


def load_time_model(spark: SparkSession, path: str) -> HuberModel:
    row = spark.read.parquet(f"{path}/inputs").first()
    return HuberModel(list(row["names"]), list(row["scale"]), LinearRegressionModel.load(f"{path}/model"))


def write_project(project: Project, folder: str) -> None:
    """SQL files of all models and one YAML with their materializations."""
    import yaml

    paths = {n.name: n.path or f"models/{n.name}.sql" for n in project.models()}
    for n in project.models():
        at = os.path.join(folder, paths[n.name])
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "w", encoding="utf-8") as f:
            f.write(n.sql.strip() + "\n")
    listed = [{"name": n.name, "config": {"materialized": n.materialized}} for n in sorted(project.models(), key=lambda n: n.name)]
    with open(os.path.join(folder, "models", "schema.yml"), "w", encoding="utf-8") as f:
        yaml.safe_dump({"version": 2, "models": listed}, f, sort_keys=False)


def read_yaml_materializations(folder: str) -> dict[str, str]:
    """Materializations in all YAML files below ``models``."""
    import glob

    import yaml

    out = {}
    for path in sorted(glob.glob(os.path.join(folder, "models", "**", "*.y*ml"), recursive=True)):
        with open(path, encoding="utf-8") as f:
            for m in (yaml.safe_load(f) or {}).get("models", []):
                kind = (m.get("config") or {}).get("materialized")
                if kind:
                    out[m["name"]] = kind
    return out
