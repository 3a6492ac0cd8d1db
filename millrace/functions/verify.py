"""Checks that a rewrite keeps results: zero-row diagnostics and direct comparison."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.project import render


@dataclass
class Diagnostic:
    """Outcome of one diagnostic query that must return no rows."""

    status: str
    sql: str
    bytes_scanned: int = -1
    violations: int = 0
    sample: list[dict] = field(default_factory=list)
    error: str = ""
    unresolved: list[str] = field(default_factory=list)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of what a query's leaves read."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def check(
    spark: SparkSession, sql: str, known: dict[str, str], max_bytes: int = 10 << 30, timeout_s: float = 120, sample: int = 5
) -> Diagnostic:
    """Run one diagnostic: empty, unresolved, skipped_cost, passed, failed or errored.

    At most ``sample`` violating rows are fetched; the job group is cancelled after ``timeout_s``.
    """
    if not sql or not sql.strip():
        return Diagnostic("empty", sql)
    text, missing = render(sql, known)
    if missing:
        return Diagnostic("unresolved", text, unresolved=missing)
    group = f"diagnostic-{uuid.uuid4().hex}"
    timer = None
    try:
        df = spark.sql(text)
        size = plan_bytes(df)
        if size > max_bytes:
            return Diagnostic("skipped_cost", text, size)
        spark.sparkContext.setJobGroup(group, "diagnostic", True)
        timer = threading.Timer(timeout_s, spark.sparkContext.cancelJobGroup, [group])
        timer.start()
        rows = [{k: v if v is None or isinstance(v, (int, float, bool, str)) else str(v) for k, v in r.asDict().items()} for r in df.limit(sample).collect()]
        return Diagnostic("failed" if rows else "passed", text, size, len(rows), rows)
    except Exception as e:
        return Diagnostic("errored", text, error=str(e)[:500])
    finally:
        if timer:
            timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def accepted(found: list[Diagnostic], strict_cost: bool = False) -> bool:
    """Passed and empty diagnostics are fine, skipped ones unless strict; anything else rejects."""
    fine = {"passed", "empty"} | (set() if strict_cost else {"skipped_cost"})
    return all(d.status in fine for d in found)


def unique_key_sql(target: str, keys: list[str]) -> str:
    listed = ", ".join(keys)
    return f"SELECT {listed}, count(*) AS n FROM {target} WHERE {' AND '.join(f'{k} IS NOT NULL' for k in keys)} GROUP BY {listed} HAVING count(*) > 1"


def coverage_sql(child: str, child_keys: list[str], parent: str, parent_keys: list[str]) -> str:
    """Rows of ``child`` whose key is null or missing in ``parent``."""
    on = " AND ".join(f"c.{a} = p.{b}" for a, b in zip(child_keys, parent_keys))
    return f"SELECT c.* FROM {child} AS c LEFT ANTI JOIN {parent} AS p ON {on}"


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def uncovered(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias("__k")).distinct(), F.col(child_key) == F.col("__k"), "left_anti")


def _balance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Different rows of both sides with how many more of them ``a`` has; each side is evaluated once. Columns by name."""
    names = a.columns
    sides = a.withColumn("__n", F.lit(1)).union(b.select(*names).withColumn("__n", F.lit(-1)))
    return sides.groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.sum("__n").alias("__n"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (only_a, only_b): rows of each side that the other lacks, repeats counted. Columns by name."""
    n, none = F.col("__n"), F.lit(0).cast("long")
    return _balance(a, b).agg(F.coalesce(F.sum(F.greatest(n, none)), none).alias("only_a"), F.coalesce(F.sum(F.greatest(-n, none)), none).alias("only_b"))


def same(a: DataFrame, b: DataFrame) -> bool:
    if sorted(a.columns) != sorted(b.columns):
        return False
    return _balance(a, b).filter("__n <> 0").isEmpty()
