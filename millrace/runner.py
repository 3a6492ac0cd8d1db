"""Running a project: views stay inlined plans, tables are written once and read back."""

from __future__ import annotations

import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .functions.cut import remove, shared_root
from .plans.catalyst import rewrite_qualify
from .plans.project import Project, render


@dataclass
class Run:
    """Result of a run: a DataFrame and measurements for every model."""

    frames: dict[str, DataFrame]
    stats: list[tuple[str, str, float, int]] = field(default_factory=list)
    prefix: str = ""
    base: str = ""
    views: list[str] = field(default_factory=list)

    def stats_df(self, spark: SparkSession) -> DataFrame:
        """unique_id, code, slot_ms, rows of each stored model, as run results."""
        return spark.createDataFrame(self.stats, "unique_id string, code string, slot_ms double, rows_affected long")

    def __getitem__(self, name: str) -> DataFrame:
        return self.frames[name]

    def drop(self, spark: SparkSession) -> None:
        """Remove the stored models and the views; frames of this run cannot be read any more."""
        for name in self.views:
            spark.catalog.dropTempView(name)
        remove(spark, self.base)


def bind_tables(spark: SparkSession, sf_dir: str, tables, prefix: str) -> dict[str, str]:
    """Temporary views over the source tables; returns their names by table."""
    known = {}
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"{prefix}{t}")
        known[t] = f"{prefix}{t}"
    return known


def run(spark: SparkSession, project: Project, sf_dir: str, targets: list[str] | None = None, store: str | None = None, workers: int = 4) -> Run:
    """Run the models that ``targets`` (names; all leaves by default) need, level by level.

    Models of one level run side by side. Stored models are written below ``store``, the folder that
    executors share by default, so a later stage can be retried on any executor.
    """
    prefix = f"r{uuid.uuid4().hex[:8]}_"
    wanted = [project.by_name[t] for t in targets] if targets else project.leaves()
    keep = project.upstream(wanted)
    sources = [n.name for u in keep if (n := project.nodes[u]).resource_type != "model"]
    known = bind_tables(spark, sf_dir, sources, prefix)
    known |= {project.nodes[u].name: prefix + project.nodes[u].name for u in keep if project.nodes[u].resource_type == "model"}
    base = f"{store or shared_root(spark)}/{prefix}run"
    out = Run({}, prefix=prefix, base=base, views=list(known.values()))
    level: dict[str, int] = {}
    for u in project.order():
        level[u] = max((level[p] + 1 for p in project.parents[u]), default=0)
    levels: dict[int, list[str]] = {}
    for u in sorted(keep):
        if project.nodes[u].resource_type == "model":
            levels.setdefault(level[u], []).append(u)

    def one(uid: str) -> None:
        node = project.nodes[uid]
        sql, missing = render(node.sql, known)
        if missing:
            raise ValueError(f"{node.name}: unresolved references {missing}")
        df = spark.sql(rewrite_qualify(sql))
        if node.materialized == "table":
            began = time.time()
            path = f"{base}/{node.name}"
            df.write.mode("overwrite").parquet(path)
            df = spark.read.schema(df.schema).parquet(path)
            out.stats.append((uid, "CREATE TABLE", (time.time() - began) * 1000, df.count()))
        df.createOrReplaceTempView(known[node.name])
        out.frames[node.name] = df

    with ThreadPoolExecutor(workers) as pool:
        for k in sorted(levels):
            list(pool.map(one, levels[k]))
    return out
