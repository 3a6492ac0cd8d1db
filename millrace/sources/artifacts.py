"""Readers of pipeline artifacts: manifests, catalogs, run results, CSV with a schema, statistics."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.project import Model, Project

RESOURCES = ("model", "seed", "snapshot", "source")


def load_manifest(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def project_from_manifest(manifest: dict) -> Project:
    """Typed nodes of a manifest; sources use their name, other nodes their alias where they have one."""
    nodes = {}
    for uid, n in {**manifest.get("nodes", {}), **manifest.get("sources", {})}.items():
        kind = n.get("resource_type")
        if kind not in RESOURCES:
            continue
        table = n["name"] if kind == "source" else n.get("alias") or n["name"]
        relation = ".".join(x for x in (n.get("database"), n.get("schema"), table) if x)
        nodes[uid] = Model(
            uid, n["name"], n.get("raw_code") or n.get("compiled_code") or "", kind, relation, (n.get("config") or {}).get("materialized", "undefined"),
            tuple((n.get("depends_on") or {}).get("nodes", ())), n.get("original_file_path", ""),
        )
    return Project(nodes)


def catalog_columns(catalog: dict) -> dict[str, dict[str, str]]:
    """Column types by relation (lower case), with and without the database part."""
    out: dict[str, dict[str, str]] = {}
    for n in {**catalog.get("nodes", {}), **catalog.get("sources", {})}.values():
        meta = n.get("metadata", {})
        full = ".".join(x for x in (meta.get("database"), meta.get("schema"), meta.get("name")) if x).lower()
        columns = {c.lower(): v.get("type", "") for c, v in n.get("columns", {}).items()}
        out[full] = columns
        out.setdefault(".".join(full.split(".")[1:]) or full, columns)
    return out


def relation_stats(catalog: dict) -> dict[str, dict[str, object]]:
    """Statistics of relations (rows, bytes and what else a catalog has), by relation as in ``catalog_columns``."""
    out: dict[str, dict[str, object]] = {}
    for n in {**catalog.get("nodes", {}), **catalog.get("sources", {})}.values():
        meta = n.get("metadata", {})
        full = clean_relation(".".join(x for x in (meta.get("database"), meta.get("schema"), meta.get("name")) if x)).lower()
        out[full] = {k: v.get("value") for k, v in n.get("stats", {}).items() if v.get("include", True)}
        out.setdefault(".".join(full.split(".")[1:]) or full, out[full])
    return out


def clean_relation(name: str | None) -> str:
    """A relation's name without quotes, brackets and empty parts."""
    return ".".join(p for p in re.sub(r"[`\[\]\"]", "", name or "").split(".") if p)


def names_like(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose unique id holds a text, in any case."""
    return nodes.filter(F.lower("unique_id").contains(text.lower()))


def names_equal(nodes: DataFrame, name: str) -> DataFrame:
    """Nodes whose unique id ends in a name, in any case."""
    return nodes.filter(F.element_at(F.split(F.lower("unique_id"), r"\."), -1) == name.lower())


def run_results(spark: SparkSession, results: dict) -> DataFrame:
    """unique_id, code, slot_ms, rows_affected, bytes_processed of a run."""
    rows = []
    for r in results.get("results", []):
        a = r.get("adapter_response") or {}
        num = lambda k, a=a: None if a.get(k) is None else float(a[k])
        rows.append((r["unique_id"], a.get("code"), num("slot_ms"), num("rows_affected"), num("bytes_processed")))
    return spark.createDataFrame(rows, "unique_id string, code string, slot_ms double, rows_affected double, bytes_processed double")


def table_stats(runs: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Only runs that stored a table."""
    return runs.filter((F.col("code") == "CREATE TABLE") & ~F.col("unique_id").isin(*excluded))


def total_slot_seconds(runs: DataFrame) -> DataFrame:
    return runs.agg((F.sum("slot_ms") / 1000).alias("slot_seconds"))


def merge_baseline(measured: DataFrame, baseline: DataFrame) -> DataFrame:
    """(unique_id, rows): measured rows, but the baseline's where it has a node."""
    b = baseline.select("unique_id", F.col("rows").alias("known"))
    return measured.select("unique_id", F.col("rows").alias("seen")).join(b, "unique_id", "full").select("unique_id", F.coalesce("known", "seen").alias("rows"))


def materializations(nodes: DataFrame) -> DataFrame:
    """(unique_id, materialized) of models."""
    return nodes.filter(F.col("unique_id").startswith("model.")).select("unique_id", F.coalesce("materialized", F.lit("undefined")).alias("materialized"))


def row_counts(spark: SparkSession, names: list[str]) -> DataFrame:
    """(name, rows): one count for each relation, null where it does not exist. One row for each name."""
    out = None
    for n in names:
        known = spark.catalog.tableExists(n)
        one = (spark.table(n).agg(F.count("*").alias("rows")) if known else spark.range(1).select(F.lit(None).cast("long").alias("rows"))).select(F.lit(n).alias("name"), "rows")
        out = one if out is None else out.union(one)
    return out if out is not None else spark.createDataFrame([], "name string, rows long")


def csv_with_schema(spark: SparkSession, path: str, fields: list[dict]) -> DataFrame:
    """A CSV in the order of a JSON schema ([{name, type}]); missing columns are null, text as it stands."""
    present = spark.read.option("header", True).csv(path).columns
    raw = spark.read.schema(", ".join(f"`{c}` string" for c in present)).option("header", True).option("nullValue", "").csv(path)
    kinds = {"INTEGER": "bigint", "INT64": "bigint", "FLOAT": "double", "FLOAT64": "double", "NUMERIC": "decimal(38,9)", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp"}
    return raw.select(
        *(F.expr(f"try_cast(`{f['name']}` as {kinds.get(f['type'].upper(), 'string')})").alias(f["name"]) if f["name"] in present else F.lit(None).cast(kinds.get(f["type"].upper(), "string")).alias(f["name"]) for f in fields)
    )


def short_names(nodes: DataFrame) -> DataFrame:
    """(name, relation) of models; the smallest relation where names repeat."""
    return nodes.filter("resource_type = 'model'").groupBy("name").agg(F.min("relation").alias("relation"))


def candidate_files(names: list[str], prefix: str, stamp: str | None = None, groups: set[str] | None = None) -> list[tuple[str, str]]:
    """(file, group) of candidate files ``prefix..._group_N[_stamp]...``."""
    out = []
    for n in sorted(names):
        m = re.search(r"(?:cc|group)_(\d+)", n)
        if n.startswith(prefix) and m and (stamp is None or stamp in n) and (groups is None or f"group_{m[1]}" in groups):
            out.append((n, f"group_{m[1]}"))
    return out


def complete(candidates: DataFrame, artifacts: DataFrame, required: tuple[str, ...] = ("features", "graph", "materialization")) -> DataFrame:
    """Candidates that have all required artifacts (candidate, kind)."""
    have = artifacts.filter(F.col("kind").isin(*required)).groupBy("candidate").agg(F.count_distinct("kind").alias("n")).filter(F.col("n") == len(required))
    return candidates.join(have.select("candidate"), "candidate", "left_semi")


def repair_json(text: str) -> dict:
    """JSON inside a reply: code fences and text around the outermost braces are dropped."""
    text = re.sub(r"^\s*```[a-z]*\s*|\s*```\s*$", "", text.strip())
    return json.loads(text[text.index("{") : text.rindex("}") + 1])
