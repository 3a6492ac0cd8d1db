"""A pipeline of SQL models: nodes, references, edges, and their text renderings."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_REF = re.compile(r"\{\{\s*ref\(\s*['\"]([^'\"]+)['\"]\s*\)\s*\}\}")
_SOURCE = re.compile(r"\{\{\s*source\(\s*['\"]([^'\"]+)['\"]\s*(?:,\s*['\"]([^'\"]+)['\"]\s*)?\)\s*\}\}")

NODE_SCHEMA = (
    "unique_id string, name string, resource_type string, relation string, sql string, depends_on array<string>, materialized string"
)


@dataclass(frozen=True)
class Model:
    """One node: ``resource_type`` is model, seed, snapshot or source."""

    unique_id: str
    name: str
    sql: str = ""
    resource_type: str = "model"
    relation: str = ""
    materialized: str = "view"
    depends_on: tuple[str, ...] = ()
    path: str = ""


def refs(sql: str) -> list[str]:
    """Names in ``ref(...)``, in order, repeats kept; blanks inside the braces are allowed."""
    return _REF.findall(sql or "")


def count_refs(sql: str, name: str) -> int:
    return sum(r == name for r in refs(sql))


def render(sql: str, known: dict[str, str]) -> tuple[str, list[str]]:
    """Replace references by relation names; also returns the names that are not known."""
    missing: list[str] = []

    def one(name: str) -> str:
        if name not in known:
            missing.append(name)
            return name
        return known[name]

    out = _REF.sub(lambda m: one(m[1]), sql)
    return _SOURCE.sub(lambda m: one(m[2] or m[1]), out), sorted(set(missing))


@dataclass
class Project:
    """Models by unique id. Edges follow the references in the SQL, or ``depends_on`` where given."""

    nodes: dict[str, Model]
    parents: dict[str, set[str]] = field(default_factory=dict)
    children: dict[str, set[str]] = field(default_factory=dict)

    def __post_init__(self):
        by_name = {}
        for n in self.nodes.values():
            by_name.setdefault(n.name, n.unique_id)
        self.by_name = by_name
        self.parents = {u: set() for u in self.nodes}
        self.children = {u: set() for u in self.nodes}
        for u, n in self.nodes.items():
            named = set(n.depends_on) or {by_name[r] for r in self.mentions(n.sql) if r in by_name}
            for p in named & set(self.nodes):
                self.parents[u].add(p)
                self.children[p].add(u)

    @staticmethod
    def mentions(sql: str) -> list[str]:
        return refs(sql) + [b or a for a, b in _SOURCE.findall(sql or "")]

    @classmethod
    def from_sql(cls, models: dict[str, str], tables: tuple[str, ...] = (), materialized: dict[str, str] | None = None) -> Project:
        """From model SQL by name; ``tables`` are sources."""
        mat = materialized or {}
        nodes = {f"source.{t}": Model(f"source.{t}", t, resource_type="source", relation=t, materialized="source") for t in tables}
        for name, sql in models.items():
            nodes[f"model.{name}"] = Model(f"model.{name}", name, sql, relation=name, materialized=mat.get(name, "view"))
        return cls(nodes)

    def models(self) -> list[Model]:
        return [n for n in self.nodes.values() if n.resource_type == "model"]

    def with_assignment(self, assignment: dict[str, str]) -> Project:
        """The same project with other materializations, by unique id or short name."""
        return Project(
            {u: replace(n, materialized=assignment.get(u, assignment.get(n.name, n.materialized))) if n.resource_type == "model" else n for u, n in self.nodes.items()}
        )

    def with_models(self, changed: dict[str, str | None], new: dict[str, str] | None = None) -> Project:
        """Replace SQL of models by name, drop those set to None, add new ones."""
        nodes = {}
        for u, n in self.nodes.items():
            if n.resource_type == "model" and n.name in changed:
                if changed[n.name] is None:
                    continue
                n = replace(n, sql=changed[n.name], depends_on=())
            nodes[u] = n
        for name, sql in (new or {}).items():
            nodes[f"model.{name}"] = Model(f"model.{name}", name, sql, relation=name, materialized="table")
        return Project(nodes)

    def order(self) -> list[str]:
        """Topological order, by level and then id; a cycle is an error."""
        level: dict[str, int] = {}
        waiting = {u: len(p) for u, p in self.parents.items()}
        ready = sorted(u for u, k in waiting.items() if not k)
        out: list[str] = []
        while ready:
            nxt = []
            for u in ready:
                out.append(u)
                level[u] = max((level[p] + 1 for p in self.parents[u]), default=0)
                for c in self.children[u]:
                    waiting[c] -= 1
                    if not waiting[c]:
                        nxt.append(c)
            ready = sorted(nxt)
        if len(out) < len(self.nodes):
            raise ValueError(f"cycle among {sorted(set(self.nodes) - set(out))}")
        return sorted(out, key=lambda u: (level[u], u))

    def roots(self) -> list[str]:
        return sorted(u for u in self.nodes if not self.parents[u])

    def leaves(self) -> list[str]:
        """Nodes without children that have a parent."""
        return sorted(u for u in self.nodes if not self.children[u] and self.parents[u])

    def upstream(self, ids) -> set[str]:
        seen, todo = set(), list(ids)
        while todo:
            u = todo.pop()
            if u not in seen:
                seen.add(u)
                todo += self.parents[u]
        return seen

    def weights(self) -> dict[tuple[str, str], int]:
        """Edges (parent, child) with the number of references, at least 1."""
        return {
            (p, c): max(1, Project.mentions(self.nodes[c].sql).count(self.nodes[p].name)) for c in self.nodes for p in self.parents[c]
        }

    def inline(self, name: str, tables_as: dict[str, str] | None = None) -> str:
        """One self-contained statement for a model: its upstream models as CTEs."""
        uid = self.by_name[name]
        keep = self.upstream([uid])
        known = {n.name: n.name for n in self.nodes.values()}
        known.update(tables_as or {})
        ctes = [(n.name, render(n.sql, known)[0]) for u in self.order() if u in keep and u != uid and (n := self.nodes[u]).resource_type == "model"]
        body = render(self.nodes[uid].sql, known)[0]
        if not ctes:
            return body
        return "WITH " + ",\n".join(f"{n} AS (\n{s}\n)" for n, s in ctes) + f"\nSELECT * FROM (\n{body}\n) AS final_model"

    # DataFrames -------------------------------------------------------------

    def nodes_df(self, spark: SparkSession) -> DataFrame:
        rows = [
            (n.unique_id, n.name, n.resource_type, n.relation, n.sql, sorted(self.parents[u]), n.materialized) for u, n in self.nodes.items()
        ]
        return spark.createDataFrame(rows, NODE_SCHEMA)

    def edges_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p, c, w) for (p, c), w in sorted(self.weights().items())], "parent string, child string, weight int")

    # Text --------------------------------------------------------------------

    def describe(self, keep: set[str] | None = None) -> str:
        """A readable summary: one line for each node with its parents."""
        lines = []
        for u in self.order():
            if keep is None or u in keep:
                n = self.nodes[u]
                from_ = ", ".join(sorted(self.nodes[p].name for p in self.parents[u] if keep is None or p in keep)) or "-"
                lines.append(f"{n.name} [{n.resource_type}, {n.materialized}] <- {from_}")
        return "\n".join(lines)

    def dot(self, keep: set[str] | None = None) -> str:
        """Graphviz text: roots bold, nodes consumed outside ``keep`` dashed."""
        keep = set(self.nodes) if keep is None else keep
        lines = ["digraph pipeline {", "  node [shape=box];"]
        for u in sorted(keep):
            style = "bold" if not self.parents[u] & keep else "dashed" if self.children[u] - keep else "solid"
            lines.append(f'  "{self.nodes[u].name}" [style={style}];')
        lines += [f'  "{self.nodes[p].name}" -> "{self.nodes[c].name}";' for p, c in sorted(self.weights()) if p in keep and c in keep]
        return "\n".join([*lines, "}"])


def edges_from_nodes(nodes: DataFrame) -> DataFrame:
    """Edges (parent, child, weight) of a ``nodes`` table: weight counts the references, at least 1."""
    n = nodes.select("unique_id", "name", "sql", F.explode("depends_on").alias("parent"))
    names = nodes.select(F.col("unique_id").alias("parent"), F.col("name").alias("parent_name"))
    found = F.regexp_extract_all("sql", F.lit(r"(?:ref|source)\(\s*['\"]([^'\"]+)['\"]\s*\)"), F.lit(1))
    return n.join(names, "parent").select(
        "parent", F.col("unique_id").alias("child"),
        F.greatest(F.lit(1), F.size(F.filter(found, lambda x: x == F.col("parent_name")))).alias("weight"),
    )
