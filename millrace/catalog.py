"""Registry of the engine's own queries and their DuckDB oracles.

Each query's docstring or comment names the inventory rows that it covers.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tuning
from .functions import verify
from .functions.cut import cut
from .operators import cost, costmodel, frequency, graph, selection, similarity
from .plans import rewrite
from .plans.demo import MODELS, TABLES, demo_project
from .plans.expressions import fingerprint
from .plans.lineage import Lineage
from .runner import run

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Running the demo project: R1-R19, E1-E18 ------------------------------------------


def _run_model(name: str):
    def go(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(spark, demo_project(), sf_dir, [name])[name]

    go.__doc__ = f"Model {name} of the demo project, run with its stored intermediates."
    return go


for _name in MODELS:
    if not _name.startswith("stg_"):
        QUERIES[f"run_{_name}"] = _run_model(_name)
        ORACLE_SQL[f"run_{_name}"] = demo_project().inline(_name)

def entry(spark: SparkSession) -> DataFrame:
    """Optimize the demo project (find the shared join, prove and apply the rewrites) and return a mart."""
    return optimized_mart(spark, "/root/testdata/sf0.001")


def _columns(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    return {t: table(spark, sf_dir, t).columns for t in TABLES}


def _lineage(spark: SparkSession, sf_dir: str) -> Lineage:
    return Lineage(spark, demo_project(), _columns(spark, sf_dir))


_MART = "mart_priority_inline"


@query(demo_project().inline(_MART))
def optimized_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mart's join is extracted as a shared model, proved equal, and the new project run."""
    project = demo_project()
    lineage = Lineage(spark, project, _columns(spark, sf_dir))
    shared = [r for r in rewrite.candidates(lineage, [rewrite.propose_shared_joins]) if _MART in r.changed]
    for r in shared:
        if rewrite.prove(spark, project, r, sf_dir):
            project = rewrite.apply(project, [r])
    return run(spark, project.with_assignment({n: "view" for n in ("int_order_revenue",)}), sf_dir, [_MART])[_MART]


@query("SELECT * FROM (VALUES ('drop_join', 'mart_inner_fk', 'verified'), ('drop_join', 'mart_left_fanout', 'rejected'), ('drop_join', 'mart_left_unused', 'verified')) AS t(kind, models, status)")
def rewrite_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joins proposed for removal, and what the data said about them."""
    _, done = rewrite.rewrite_project(spark, demo_project(), sf_dir, _lineage(spark, sf_dir), [rewrite.propose_dropped_joins])
    return spark.createDataFrame([(r.kind, ",".join(sorted(r.changed)), r.status) for r in done], "kind string, models string, status string")


@query("SELECT 0::BIGINT AS only_a, 0::BIGINT AS only_b")
def shared_model_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: rows by which the original and the rewritten mart differ."""
    return verify.difference(run(spark, demo_project(), sf_dir, [_MART])[_MART], optimized_mart(spark, sf_dir))


# Diagnostics: V1-V3 -------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def diag_unique_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def diag_fk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    return verify.uncovered(table(spark, sf_dir, "orders"), "o_custkey", rich, "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT o.o_orderkey, count(*)::BIGINT AS n FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY 1 HAVING count(*) > 1")
def diag_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(lines.filter("n > 1"), "o_orderkey")


@query("SELECT * FROM (VALUES ('passed', 0), ('failed', 5), ('unresolved', 0), ('empty', 0), ('errored', 0), ('skipped_cost', 0)) AS t(status, violations)")
def diagnostic_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: one diagnostic of each outcome."""
    from .runner import bind_tables

    known = bind_tables(spark, sf_dir, ["orders", "lineitem"], "diag_")
    tried = [
        verify.check(spark, verify.unique_key_sql("{{ ref('orders') }}", ["o_orderkey"]), known),
        verify.check(spark, verify.unique_key_sql("{{ ref('lineitem') }}", ["l_orderkey", "l_linenumber"]), known),
        verify.check(spark, "SELECT * FROM {{ ref('nowhere') }}", known),
        verify.check(spark, " ", known),
        verify.check(spark, "SELECT no_such_column FROM {{ ref('orders') }}", known),
        verify.check(spark, "SELECT * FROM {{ ref('lineitem') }}", known, max_bytes=1),
    ]
    return spark.createDataFrame([(d.status, d.violations) for d in tried], "status string, violations int")


# Similarity: G2-G14, A4-A6 ----------------------------------------------------------------

_TOKENS_SQL = "tok AS (SELECT l_suppkey AS owner, p_brand AS token, count(*)::DOUBLE AS w FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
_PAIRS_SQL = """sz AS (SELECT owner, sum(w) AS s FROM tok GROUP BY owner),
sh AS (SELECT x.owner AS a, y.owner AS b, sum(least(x.w, y.w)) AS shared FROM tok x JOIN tok y ON x.token = y.token AND x.owner < y.owner GROUP BY ALL),
pr AS (SELECT a, b, shared, shared / (p.s + q.s - shared) AS score FROM sh JOIN sz p ON p.owner = a JOIN sz q ON q.owner = b)"""


def supplier_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as a supplier's tokens, lines as weights."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part")
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("owner"), F.col("p_brand").alias("token"))
        .agg(F.count("*").cast("double").alias("weight"))
    )


def _rounded(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.round(n, digits))
    return df


def _rounded_pairs(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    """Half up, for values that are not negative; on every pair, ``F.round`` by decimals would cost more than the comparison."""
    scale = float(10**digits)
    for n in names:
        df = df.withColumn(n, F.floor(F.col(n) * scale + 0.5) / scale)
    return df


@query(f"WITH {_TOKENS_SQL}, {_PAIRS_SQL} SELECT a, b, shared, round(score, 9) AS score FROM pr WHERE score >= 0.5")
def weighted_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2, G6, G9, G10."""
    return _rounded_pairs(similarity.jaccard_pairs(supplier_tokens(spark, sf_dir), 0.5), "score")


_IDF_SQL = f"""WITH raw AS (SELECT l_suppkey AS owner, p_type AS token, count(*)::DOUBLE AS w FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
idf AS (SELECT token, ln(((SELECT count(DISTINCT owner) FROM raw) + 1) / (count(DISTINCT owner) + 1)) + 1 AS idf FROM raw GROUP BY token),
tok AS (SELECT owner, token, w * idf AS w FROM raw JOIN idf USING (token)), {_PAIRS_SQL}
SELECT a, b, round(shared, 6) AS shared, round(score, 6) AS score FROM pr"""


@query(_IDF_SQL)
def idf_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with inverse-frequency weights and their shared weight."""
    lines = table(spark, sf_dir, "lineitem")
    tokens = (
        lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("owner"), F.col("p_type").alias("token"))
        .agg(F.count("*").cast("double").alias("weight"))
    )
    return _rounded_pairs(similarity.idf_jaccard_pairs(tokens), "shared", "score", digits=6)


@query(f"WITH {_TOKENS_SQL}, {_PAIRS_SQL} SELECT a, b, round(score, 9) AS score FROM pr ORDER BY score DESC, a, b LIMIT 40")
def top_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best pairs, ties by name."""
    return _rounded_pairs(similarity.top_pairs(similarity.jaccard_pairs(supplier_tokens(spark, sf_dir), best=40), 40).select("a", "b", "score"), "score")


_SEG_SQL = "tok AS (SELECT c_mktsegment || '/' || c_nationkey AS owner, o_orderpriority AS token, count(*)::BIGINT AS w FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL)"


@query(f"""WITH {_SEG_SQL} SELECT x.owner AS a, y.owner AS b, sum(least(x.w, y.w))::BIGINT AS mass, count(*)::BIGINT AS tokens
FROM tok x JOIN tok y ON x.token = y.token AND x.owner < y.owner GROUP BY ALL""")
def common_backbones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: multiset intersections of all pairs."""
    return similarity.common_backbones(_segment_tokens(spark, sf_dir)).select("a", "b", "mass", F.size("common").cast("long").alias("tokens"))


def _segment_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return (
        c.join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
        .groupBy(F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("owner"), F.col("o_orderpriority").alias("token"))
        .agg(F.count("*").alias("weight"))
    )


@query(f"""WITH {_SEG_SQL}, pat AS (
    SELECT list(struct_pack(t := x.token, n := least(x.w, y.w)) ORDER BY x.token) AS common, sum(least(x.w, y.w)) AS mass
    FROM tok x JOIN tok y ON x.token = y.token AND x.owner < y.owner GROUP BY x.owner, y.owner
), u AS (SELECT DISTINCT common, mass FROM pat), it AS (SELECT common, mass, len(common) AS k, unnest(common) AS i FROM u),
sup AS (SELECT common, mass, k, owner FROM it JOIN tok ON tok.token = i.t AND tok.w >= i.n GROUP BY ALL HAVING count(*) = k),
g AS (SELECT common, mass, count(*) AS n FROM sup GROUP BY common, mass),
lone AS (SELECT owner, sum(w) AS mass FROM tok WHERE owner NOT IN (SELECT owner FROM sup) GROUP BY owner),
e AS (SELECT mass, n FROM g UNION ALL SELECT mass, 1 FROM lone)
SELECT mass::BIGINT AS mass, n::BIGINT AS n_owners, (mass * n)::BIGINT AS score FROM e ORDER BY score DESC, n_owners DESC LIMIT 30""")
def backbone_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared patterns with all owners that contain them, ranked by mass x owners."""
    return similarity.backbone_groups(_segment_tokens(spark, sf_dir)).select("mass", "n_owners", "score")


_EDGES_PAIR_SQL = f"{_SEG_SQL}, {_PAIRS_SQL}, pp AS (SELECT a, b FROM pr WHERE score >= 0.89)"


def similar_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of customer segments by nation whose order priorities are nearly alike."""
    return similarity.jaccard_pairs(_segment_tokens(spark, sf_dir), 0.89).select("a", "b")


@query(f"""WITH RECURSIVE {_EDGES_PAIR_SQL}, e AS (SELECT a, b FROM pp UNION SELECT b, a FROM pp),
r(node, reach) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
SELECT node, min(reach) AS component FROM r GROUP BY node""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4."""
    return graph.components(similar_segments(spark, sf_dir))


@query(f"""WITH RECURSIVE {_EDGES_PAIR_SQL}, e AS (SELECT a, b FROM pp UNION SELECT b, a FROM pp),
r(node, reach) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
SELECT component, count(*)::BIGINT AS size FROM (SELECT node, min(reach) AS component FROM r GROUP BY node) GROUP BY component""")
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of components of scored pairs."""
    return graph.component_sizes(similar_segments(spark, sf_dir).withColumn("score", F.lit(1.0)), 1_000_000)


def _peeled(rounds: int) -> str:
    """Edges after so many rounds, each keeping those between nodes of two neighbours and more."""
    out = "p0 AS (SELECT a, b FROM e)"
    for k in range(rounds):
        d = f"(SELECT a FROM p{k} GROUP BY a HAVING count(*) >= 2)"
        out += f", p{k + 1} AS MATERIALIZED (SELECT a, b FROM p{k} WHERE a IN {d} AND b IN {d})"
    return out + f" SELECT DISTINCT a AS node FROM p{rounds}"


@query(f"WITH {_EDGES_PAIR_SQL}, e AS (SELECT a, b FROM pp UNION SELECT b, a FROM pp), {_peeled(25)}")
def k_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2-core of the similar segments, peeled to a fixed point; the oracle peels 25 times."""
    return graph.k_core(similar_segments(spark, sf_dir), 2)


# Graphs: D1-D14 -------------------------------------------------------------------------------


def _values(rows, names: str) -> str:
    shown = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else "NULL" if x is None else str(x) for x in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {shown}) AS t({names}))"


_WEIGHTS = sorted((p, c, w) for (p, c), w in demo_project().weights().items())
_E = f"e AS {_values(_WEIGHTS, 'parent, child, weight')}"
_CLOSURE = f"""WITH RECURSIVE {_E}, n AS (SELECT parent AS node FROM e UNION SELECT child FROM e),
paths(ancestor, node, depth) AS (SELECT node, node, 0 FROM n UNION SELECT p.ancestor, e.child, p.depth + 1 FROM paths p JOIN e ON e.parent = p.node),
r AS (SELECT ancestor, node, min(depth) AS depth FROM paths GROUP BY ancestor, node)"""


def demo_edges(spark: SparkSession) -> DataFrame:
    return demo_project().edges_df(spark)


def _nodes(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "node string")


@query(f"WITH {_E} SELECT parent, child, weight::BIGINT AS weight FROM e")
def project_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with reference counts, from the nodes' SQL by Spark."""
    from .plans.project import edges_from_nodes

    return edges_from_nodes(demo_project().nodes_df(spark)).withColumn("weight", F.col("weight").cast("long"))


@query(f"{_CLOSURE} SELECT ancestor, node, depth::BIGINT AS depth FROM r")
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2, D3, L2."""
    return graph.closure(demo_edges(spark)).withColumn("depth", F.col("depth").cast("long"))


@query(f"{_CLOSURE} SELECT DISTINCT ancestor AS node FROM r WHERE node IN ('model.mart_segment_revenue', 'model.mart_left_unused')")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ancestors(demo_edges(spark), _nodes(spark, "model.mart_segment_revenue", "model.mart_left_unused"))


@query(f"{_CLOSURE} SELECT ancestor AS node, (count(*) - 1)::BIGINT AS descendants FROM r GROUP BY ancestor")
def descendant_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D14."""
    return graph.descendant_count(demo_edges(spark))


@query(f"{_CLOSURE} SELECT node, min(depth)::BIGINT AS depth FROM r WHERE ancestor IN ('source.orders', 'source.part') AND depth <= 2 GROUP BY node")
def bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6."""
    return graph.bfs(demo_edges(spark), _nodes(spark, "source.orders", "source.part"), 2).withColumn("depth", F.col("depth").cast("long"))


@query(f"""{_CLOSURE}, c AS (SELECT ancestor AS node FROM r WHERE node IN ('model.mart_segment_revenue', 'model.mart_top_orders', 'model.mart_priority_inline') GROUP BY ancestor HAVING count(DISTINCT node) = 3)
SELECT node FROM c WHERE node NOT IN (SELECT r.ancestor FROM r JOIN c ON c.node = r.node WHERE r.depth > 0)""")
def lowest_common_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4."""
    return graph.lowest_common_ancestors(demo_edges(spark), _nodes(spark, "model.mart_segment_revenue", "model.mart_top_orders", "model.mart_priority_inline"))


@query(f"{_CLOSURE} SELECT d.node FROM r d JOIN r u ON u.ancestor = d.node AND u.node = 'model.mart_segment_revenue' WHERE d.ancestor = 'source.customer'")
def paths_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5."""
    return graph.between(demo_edges(spark), _nodes(spark, "source.customer"), _nodes(spark, "model.mart_segment_revenue"))


@query(f"""{_CLOSURE}, core AS (SELECT 'model.int_order_revenue' AS node), up AS (SELECT DISTINCT ancestor AS node FROM r WHERE node IN (FROM core) AND depth = 1),
down AS (SELECT node FROM r WHERE ancestor IN (FROM core) AND depth = 1), sib AS (SELECT DISTINCT child AS node FROM e WHERE parent IN (FROM up)),
al AS (SELECT node, 0 AS o, 'core' AS kind, 0 AS depth FROM core UNION ALL SELECT node, 1, 'up', 1 FROM up UNION ALL SELECT node, 2, 'down', 1 FROM down UNION ALL SELECT node, 3, 'sibling', 2 FROM sib)
SELECT node, arg_min(kind, o) AS kind, arg_min(depth, o)::BIGINT AS depth FROM al GROUP BY node""")
def neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7, D9."""
    return graph.neighborhood(demo_edges(spark), _nodes(spark, "model.int_order_revenue")).withColumn("depth", F.col("depth").cast("long"))


@query(f"""{_CLOSURE}, i AS (SELECT 'model.stg_orders' AS node UNION ALL SELECT 'model.int_order_revenue' UNION ALL SELECT 'model.mart_top_orders')
SELECT node, coalesce((SELECT bool_or(e.child IN (FROM i)) AND bool_or(e.child NOT IN (FROM i)) FROM e WHERE e.parent = i.node), false) AS has_external_children FROM i""")
def external_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.external_children(demo_edges(spark), _nodes(spark, "model.stg_orders", "model.int_order_revenue", "model.mart_top_orders"))


@query(f"{_CLOSURE} SELECT node, max(depth)::BIGINT AS level FROM paths GROUP BY node")
def topological_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D11."""
    return graph.levels(demo_edges(spark)).withColumn("level", F.col("level").cast("long"))


@query(f"WITH {_E} SELECT DISTINCT child AS node FROM e WHERE child NOT IN (SELECT parent FROM e)")
def leaf_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D12, L12, Q2."""
    return graph.leaves(demo_edges(spark))


# Frequency: Q1-Q11 -------------------------------------------------------------------------------

_ROOT_SQL = "rl AS (SELECT node, 1 + (length(node) % 3)::INT AS level FROM n WHERE node NOT IN (SELECT child FROM e))"
_LEAF_SQL = "ll AS (SELECT node, 1 + (length(node) % 3)::INT AS level FROM n WHERE node NOT IN (SELECT parent FROM e))"
_FREQ = f"""{_CLOSURE}, {_ROOT_SQL}, {_LEAF_SQL},
ch AS (SELECT r.node, max(level) AS change FROM r JOIN rl ON rl.node = r.ancestor GROUP BY r.node),
us AS (SELECT r.ancestor AS node, max(level) AS use FROM r JOIN ll ON ll.node = r.node GROUP BY r.ancestor),
re AS (SELECT coalesce(ch.node, us.node) AS node, least(coalesce(change, 0), coalesce(use, 0)) AS real FROM ch FULL JOIN us ON ch.node = us.node),
mu AS (SELECT * FROM (VALUES (0, 0), (1, 1), (2, 7), (3, 168)) AS m(level, m))"""


def _levels(df: DataFrame) -> DataFrame:
    return df.select("node", (1 + F.length("node") % 3).alias("level"))


def _frequencies(spark: SparkSession):
    e = demo_edges(spark)
    change = frequency.change_frequency(e, _levels(graph.roots(e)))
    use = frequency.use_frequency(e, _levels(graph.leaves(e)))
    return e, change, use, frequency.real_frequency(change, use)


@query(f"{_FREQ} SELECT node, change FROM ch")
def freq_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5."""
    return _frequencies(spark)[1]


@query(f"{_FREQ} SELECT node, use FROM us")
def freq_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6."""
    return _frequencies(spark)[2]


@query(f"{_FREQ} SELECT node, real, m AS multiplier FROM re JOIN mu ON mu.level = real WHERE real > 0")
def freq_real(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1, Q7."""
    return _frequencies(spark)[3]


_COST_ROWS = sorted((n.unique_id, float(100 + 37 * len(n.sql) % 1000)) for n in demo_project().models())
_COST = f"co AS {_values(_COST_ROWS, 'node, b')}"


def _node_cost(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_COST_ROWS, "node string, b double")


@query(f"""{_FREQ}, {_COST}, s AS (SELECT sum(b * mu1.m)::DOUBLE AS scheduled, sum(b * mu2.m)::DOUBLE AS needed FROM co LEFT JOIN us ON us.node = co.node LEFT JOIN re ON re.node = co.node
    JOIN mu AS mu1 ON mu1.level = coalesce(use, 0) JOIN mu AS mu2 ON mu2.level = coalesce(real, 0))
SELECT scheduled, needed, scheduled - needed AS saved, round((scheduled - needed) / scheduled, 9) AS ratio FROM s""")
def freq_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8."""
    _, _, use, real = _frequencies(spark)
    return _rounded(frequency.savings(_node_cost(spark).withColumnRenamed("b", "slot_ms"), use, real), "ratio")


@query(f"""{_FREQ} SELECT e.child AS node, count(*)::BIGINT AS parents, sum((ch.change < re.real)::INT)::BIGINT AS slower FROM e JOIN ch ON ch.node = e.parent
JOIN re ON re.node = e.child AND re.real > 0 GROUP BY e.child HAVING count(*) >= 2 AND slower >= 1 AND slower < count(*)""")
def split_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9."""
    e, change, _, real = _frequencies(spark)
    return frequency.split_candidates(e, change, real)


def _dealt_levels(nodes: list[str], ratios: tuple[float, ...], seed: int) -> list[tuple[str, int]]:
    """Nodes by Spark's 64-bit hash of (seed, node), dealt to levels 1 to 3 by ratio."""
    import xxhash

    def place(node: str) -> tuple[int, str]:
        first = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
        h = xxhash.xxh64_intdigest(node.encode(), first)
        return h - (1 << 64) if h >> 63 else h, node

    counts = [int(len(nodes) * share) for share in ratios]
    counts[max(range(3), key=lambda i: (ratios[i], -i))] += len(nodes) - sum(counts)
    levels = [k + 1 for k, n in enumerate(counts) for _ in range(n)]
    return list(zip(sorted(nodes, key=place), levels))


def _profile_sql(scenario: str, seed: int) -> str:
    s, project = frequency.SCENARIOS[scenario], demo_project()
    roots = sorted({p for p, _, _ in _WEIGHTS} - {c for _, c, _ in _WEIGHTS})
    ends = sorted({c for _, c, _ in _WEIGHTS} - {p for p, _, _ in _WEIGHTS})

    def below(u: str) -> set[str]:
        return set(project.children[u]).union(*(below(c) for c in project.children[u]))

    reach = {u: len(below(u)) for u in roots}
    top = min(roots, key=lambda u: (-reach[u], u))
    wide, narrow = [u for u in roots if reach[u] >= 50], [u for u in roots if reach[u] < 50]
    rl = [(u, 2 if u == top and k == 3 else k) for u, k in _dealt_levels(wide, s["high_root_ratios"], seed) + _dealt_levels(narrow, s["low_root_ratios"], seed)]
    return f"""{_CLOSURE}, rl AS {_values(sorted(rl), 'node, level')}, ll AS {_values(sorted(_dealt_levels(ends, s["leaf_ratios"], seed)), 'node, level')},
ch AS (SELECT r.node, max(level) AS change FROM r JOIN rl ON rl.node = r.ancestor GROUP BY r.node),
us AS (SELECT r.ancestor AS node, max(level) AS use FROM r JOIN ll ON ll.node = r.node GROUP BY r.ancestor),
mu AS (SELECT * FROM (VALUES (1, 1), (2, 7), (3, 168)) AS m(level, m))
SELECT ch.node, least(change, use) AS real, m AS multiplier FROM ch JOIN us ON ch.node = us.node JOIN mu ON mu.level = least(change, use)"""


@query(_profile_sql("mixed_cadence", 42))
def frequency_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3, Q4, Q10, K9: seeded scenario levels and the node frequencies they give."""
    return frequency.frequency_profile(demo_edges(spark), "mixed_cadence", seed=42)["real"]


@query(f"""{_FREQ}, {_COST} SELECT co.node, (b * coalesce(m, 1))::DOUBLE AS b FROM co LEFT JOIN re ON re.node = co.node AND re.real > 0 LEFT JOIN mu ON mu.level = re.real""")
def freq_weighted_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q11."""
    real = _frequencies(spark)[3]
    empty = spark.createDataFrame([], "parent string, child string, u double")
    return frequency.weigh_costs(_node_cost(spark), empty, real)[0]


# Cost: C7-C9, C20-C24, O1, O2 -----------------------------------------------------------------------

_T_ROWS = sorted((u, 1 if u.startswith("source.") or u.endswith("revenue") or u in demo_project().leaves() else 0) for u in demo_project().nodes)
_T = f"a AS {_values(_T_ROWS, 'node, t')}"
_U_ROWS = sorted((p, c, float(len(p) * 11 % 97 - 20 + w)) for p, c, w in _WEIGHTS if p.startswith("model."))
_U = f"u AS {_values(_U_ROWS, 'parent, child, u')}"


def _assignment(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_T_ROWS, "node string, t int")


def _edge_cost(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_U_ROWS, "parent string, child string, u double")


_F_ROWS = sorted((u, "scans", 1.0 + i % 3) for i, u in enumerate(sorted(demo_project().nodes)))


@query(f"""WITH RECURSIVE {_E}, {_T}, f AS {_values(_F_ROWS, 'node, feature, value')},
p(node, feature, value) AS (SELECT node, feature, value::DOUBLE FROM f UNION ALL SELECT e.child, p.feature, p.value * e.weight FROM p JOIN e ON e.parent = p.node JOIN a ON a.node = p.node AND a.t = 0)
SELECT node, feature, sum(value)::DOUBLE AS value FROM p GROUP BY ALL""")
def view_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8."""
    return cost.expand_views(demo_edges(spark), _assignment(spark), spark.createDataFrame(_F_ROWS, "node string, feature string, value double"))


_ROWS_SQL = "rw AS (" + " UNION ALL ".join(f"SELECT 'source.{t}' AS node, count(*)::DOUBLE AS rows FROM {t}" for t in TABLES) + " UNION ALL SELECT 'model.int_order_revenue', count(*)::DOUBLE FROM orders)"


@query(f"""WITH RECURSIVE {_E}, {_T}, {_ROWS_SQL},
p(node, rows) AS (SELECT e.child, rw.rows * e.weight FROM rw JOIN e ON e.parent = rw.node UNION ALL SELECT e.child, p.rows * e.weight FROM p JOIN a ON a.node = p.node AND a.t = 0 JOIN e ON e.parent = p.node)
SELECT node, sum(rows)::DOUBLE AS input_rows, round(ln(1 + sum(rows)), 9) AS log_rows FROM (SELECT * FROM p UNION ALL SELECT DISTINCT child, 0 FROM e) GROUP BY node""")
def cardinality_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of tables flow through views."""
    rows = None
    for t in TABLES:
        one = table(spark, sf_dir, t).agg(F.count("*").cast("double").alias("rows")).select(F.lit(f"source.{t}").alias("node"), "rows")
        rows = one if rows is None else rows.union(one)
    stored = table(spark, sf_dir, "orders").agg(F.count("*").cast("double").alias("rows")).select(F.lit("model.int_order_revenue").alias("node"), "rows")
    return _rounded(cost.propagate_cardinality(demo_edges(spark), _assignment(spark), rows.union(stored)), "log_rows")


@query(f"""WITH {_T}, {_COST}, {_U} SELECT ((SELECT sum(t * b) FROM co JOIN a USING (node)) + (SELECT sum(u * (1 - p.t) * c.t) FROM u JOIN a p ON p.node = parent JOIN a c ON c.node = child) + 2)::DOUBLE AS cost""")
def objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C22."""
    return cost.objective(_node_cost(spark), _edge_cost(spark), _assignment(spark), flips=2)


@query(f"""WITH {_T}, {_COST}, {_U} SELECT co.node, (b + coalesce((SELECT sum(u) FROM u JOIN a ON a.node = parent AND a.t = 0 WHERE child = co.node), 0))::DOUBLE AS cost FROM co JOIN a ON a.node = co.node AND t = 1""")
def per_child_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C23."""
    return cost.per_child_cost(_node_cost(spark), _edge_cost(spark), _assignment(spark))


_OBJ = "((SELECT sum(x.t * b) FROM co JOIN {0} x USING (node)) + coalesce((SELECT sum(u * (1 - p.t) * c.t) FROM u JOIN {0} p ON p.node = parent JOIN {0} c ON c.node = child), 0))"


@query(f"""WITH {_T}, {_COST}, {_U}, f AS (SELECT x.node AS flip, y.node, CASE WHEN x.node = y.node THEN 1 - y.t ELSE y.t END AS t FROM a x JOIN a y ON true),
v AS (SELECT flip, sum(f.t * coalesce(b, 0)) AS bs FROM f LEFT JOIN co ON co.node = f.node GROUP BY flip),
w AS (SELECT p.flip, sum(u * (1 - p.t) * c.t) AS us FROM u JOIN f p ON p.node = parent JOIN f c ON c.node = child AND c.flip = p.flip GROUP BY p.flip)
SELECT v.flip AS node, round(bs + us - {_OBJ.format('a')}, 6)::DOUBLE AS d FROM v JOIN w USING (flip)""")
def flip_delta_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: change of the objective by each single flip; the oracle evaluates every flipped assignment whole."""
    return _rounded(cost.flip_gains(_node_cost(spark), _edge_cost(spark), _assignment(spark)).select("node", "d"), "d", digits=6)


@query(f"""WITH {_T}, {_COST}, {_U}, s AS (SELECT node, 1 - 2 * t AS s FROM a WHERE node LIKE 'model.%'),
d AS (SELECT s.node, s.s, s.s * (coalesce(b, 0) + coalesce((SELECT sum(u * (1 - t)) FROM u JOIN a ON a.node = parent WHERE child = s.node), 0)
    - coalesce((SELECT sum(u * t) FROM u JOIN a ON a.node = child WHERE parent = s.node), 0)) + 1 AS d FROM s LEFT JOIN co ON co.node = s.node),
x AS (SELECT least(parent, child) AS p, greatest(parent, child) AS q, -sum(u * i.s * j.s) AS w FROM u JOIN s i ON i.node = parent JOIN s j ON j.node = child GROUP BY ALL),
z AS (SELECT 0.0 AS change UNION ALL SELECT d FROM d
    UNION ALL SELECT i.d + j.d + coalesce((SELECT w FROM x WHERE p = i.node AND q = j.node), 0) FROM d i JOIN d j ON i.node < j.node
    UNION ALL SELECT i.d + j.d + k.d + coalesce(x1.w, 0) + coalesce(x2.w, 0) + coalesce(x3.w, 0) FROM d i JOIN d j ON i.node < j.node JOIN d k ON j.node < k.node
        LEFT JOIN x x1 ON x1.p = i.node AND x1.q = j.node LEFT JOIN x x2 ON x2.p = i.node AND x2.q = k.node LEFT JOIN x x3 ON x3.p = j.node AND x3.q = k.node)
SELECT round(min(change), 6)::DOUBLE AS change FROM z""")
def best_flip_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: the best at most three flips; the oracle enumerates all sets."""
    free = _assignment(spark).filter("node like 'model.%'").select("node")
    return _rounded(cost.best_flips(_node_cost(spark), _edge_cost(spark), _assignment(spark), free).select("change"), "change", digits=6)


@query()
def tuned_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: repeated search from the project's assignment with fixed costs (tested: never worse, targets stored)."""
    out, _ = cost.tune(demo_edges(spark).filter("parent like 'model.%'"), _assignment(spark).filter("node like 'model.%'"), lambda a: (_node_cost(spark), _edge_cost(spark)))
    return out


# Learned costs with given coefficients: C2, C20, C21, C24 ---------------------------------------------

_TIME = tuning.LinearTime({"joins_count": 0.5, "group_by_count": 0.25, "log_rows": 0.8}, 0.3)
_SHAPE = sorted((n.unique_id, len(re.findall(r"\bjoin\b", n.sql, re.I)), len(re.findall(r"\bgroup by\b", n.sql, re.I))) for n in demo_project().models())
_CARDS = "cards AS (" + " UNION ALL ".join(
    [f"SELECT 'source.{t}' AS node, count(*)::DOUBLE AS rows FROM {t}" for t in TABLES]
    + [f"SELECT 'model.{m}', count(*)::DOUBLE FROM ({demo_project().inline(m)})" for m in MODELS]
) + ")"
_LEARNED = f"""WITH RECURSIVE {_E}, {_T}, {_CARDS}, f AS {_values(_SHAPE, 'node, j, g')},
x(node, j, g) AS (SELECT node, j::DOUBLE, g::DOUBLE FROM f UNION ALL SELECT e.child, x.j * e.weight, x.g * e.weight FROM x JOIN e ON e.parent = x.node JOIN a ON a.node = x.node AND a.t = 0),
fx AS (SELECT node, sum(j) AS j, sum(g) AS g FROM x GROUP BY node),
i AS (SELECT f.node, coalesce(sum(rows), 0) AS rows FROM f LEFT JOIN (SELECT DISTINCT parent, child FROM e) d ON d.child = f.node LEFT JOIN cards ON cards.node = d.parent GROUP BY f.node),
b AS (SELECT f.node, i.rows, j, g, exp(least(20, 0.3 + 0.5 * j + 0.25 * g + 0.8 * ln(1 + i.rows))) - 1 AS b FROM f JOIN i USING (node)),
u AS (SELECT e.parent, e.child, exp(least(20, 0.3 + 0.5 * (c.j + e.weight * fx.j) + 0.25 * (c.g + e.weight * fx.g) + 0.8 * ln(1 + c.rows - cards.rows + p.rows))) - 1 - c.b AS u
    FROM e JOIN b c ON c.node = e.child JOIN b p ON p.node = e.parent JOIN fx ON fx.node = e.parent JOIN cards ON cards.node = e.parent)"""


def _learned(spark: SparkSession, sf_dir: str):
    """Edges between models and all edges, features, rows of all tables and models, and B."""
    project = demo_project()
    features = cut(tuning.feature_table(spark, _lineage(spark, sf_dir)))
    cards = cut(tuning.measure(spark, project, sf_dir).select("node", "rows"))
    edges = project.edges_df(spark)
    names = list(_TIME.coefficients)
    base = cut(costmodel.baseline_costs(edges, features, cards, _TIME, names).filter("node like 'model.%'"))
    return edges, features, cards, names, base


@query(f"{_LEARNED} SELECT node, round(b, 4) AS b FROM b")
def learned_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of every model with its parents stored, from its statement and the rows that go in."""
    return _rounded(_learned(spark, sf_dir)[-1], "b", digits=4)


@query(f"{_LEARNED} SELECT parent, child, round(u, 4) AS u FROM u")
def learned_view_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model costs more when a parent is inlined, under the assignment of the objective."""
    edges, features, cards, names, base = _learned(spark, sf_dir)
    u = costmodel.view_costs(edges, _assignment(spark), features, cards, base, _TIME, names).filter("parent like 'model.%'")
    return _rounded(u, "u", digits=4)


@query(f"""{_LEARNED} SELECT round((SELECT sum(t * b) FROM b JOIN a USING (node)) + (SELECT sum(u * (1 - p.t) * c.t) FROM u JOIN a p ON p.node = parent JOIN a c ON c.node = child), 4) AS cost""")
def learned_pipeline_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole project under an assignment."""
    edges, features, cards, names, base = _learned(spark, sf_dir)
    u = costmodel.view_costs(edges, _assignment(spark), features, cards, base, _TIME, names).filter("parent like 'model.%'")
    return _rounded(cost.objective(base, u, _assignment(spark)), "cost", digits=4)


@query()
def learned_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run, fit the times measured, tune; predicted cost before and after (times differ from run to run)."""
    return tuning.tune_project(spark, demo_project(), sf_dir, _lineage(spark, sf_dir))[1]


# Selection and consensus: O3-O9 ---------------------------------------------------------------------

_CAND = [("q_group_1_a", 90.0), ("q_group_1_b", 70.0), ("q_group_2", 75.0), ("q_group_3", 60.0), ("q_group_4", 120.0), ("q_cc_5", 97.5), ("q_group_6", 88.0)]
_CHANGED = [("group_1", "m1"), ("group_1", "m2"), ("group_2", "m2"), ("group_2", "m3"), ("group_3", "m3"), ("group_3", "m4"), ("group_4", "m4"), ("group_5", "m5"), ("group_6", "m1"), ("group_6", "m5")]
_CAND_SQL = f"c AS {_values(_CAND, 'candidate, cost')}, dl AS (SELECT candidate, 'group_' || regexp_extract(candidate, '(?:cc|group)_(\\d+)', 1) AS grp, cost::DOUBLE AS cost, (100.0 - cost)::DOUBLE AS delta FROM c)"
_CHG_SQL = f"ch AS {_values(_CHANGED, 'grp, uid')}, cf AS (SELECT DISTINCT x.grp AS g1, y.grp AS g2 FROM ch x JOIN ch y ON x.uid = y.uid AND x.grp < y.grp)"


def _deltas(spark: SparkSession) -> DataFrame:
    return selection.deltas(100.0, spark.createDataFrame(_CAND, "candidate string, cost double"))


def _changed(spark: SparkSession) -> DataFrame:
    return selection.changed_uids(spark.createDataFrame([(*r, True, False, False) for r in _CHANGED], "group string, uid string, rewritten boolean, is_new boolean, removed boolean"))


@query(f'WITH {_CAND_SQL} SELECT candidate, grp AS "group", cost, delta FROM dl')
def candidate_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3, O5, S14."""
    return _deltas(spark)


@query(f"WITH {_CHG_SQL} SELECT x.grp AS g1, y.grp AS g2, string_agg(DISTINCT x.uid, ',' ORDER BY x.uid) AS overlapping FROM ch x JOIN ch y ON x.uid = y.uid AND x.grp < y.grp GROUP BY ALL")
def conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O4."""
    return selection.conflicts(_changed(spark)).withColumn("overlapping", F.array_join("overlapping", ","))


@query(f"""WITH RECURSIVE {_CAND_SQL}, {_CHG_SQL}, b AS (SELECT grp, max(delta) AS delta FROM dl WHERE delta > 0 GROUP BY grp),
s(last, groups, total) AS (SELECT '', []::VARCHAR[], 0.0::DOUBLE UNION ALL SELECT b.grp, list_append(s.groups, b.grp), s.total + b.delta FROM s JOIN b ON b.grp > s.last
    AND NOT EXISTS (SELECT 1 FROM cf WHERE (g1 = b.grp AND list_contains(s.groups, g2)) OR (g2 = b.grp AND list_contains(s.groups, g1))))
SELECT unnest(groups) AS "group", total AS total_benefit FROM (SELECT * FROM s ORDER BY total DESC LIMIT 1)""")
def selected_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oracle enumerates all conflict-free sets."""
    got = selection.select(_deltas(spark), selection.conflicts(_changed(spark)))
    return got["selected"].select("group").crossJoin(got["total"].select("total_benefit"))  # one row of totals


_VOTES = [(f"group_{g}", g, f"m{m}", "table" if (g * m) % 3 else "view") for g in range(1, 6) for m in range(1, 7) if (g + m) % 6]
_ORIGINAL = [(f"m{m}", "view" if m % 2 else "table") for m in range(1, 9)]


@query(f"""WITH v AS {_values(_VOTES, 'grp, pos, uid, value')}, o AS {_values(_ORIGINAL, 'uid, value')},
k AS (SELECT uid, value, count(*) AS votes, min(pos) AS seen FROM v GROUP BY ALL),
t AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY uid ORDER BY votes DESC, seen, value) = 1), m AS (SELECT greatest(1, floor(count(DISTINCT grp) * 0.8 + 1e-9)) AS least FROM v)
SELECT o.uid, o.value AS original, CASE WHEN votes >= least THEN t.value ELSE o.value END AS value, coalesce(votes, 0)::BIGINT AS votes,
    CASE WHEN votes IS NULL THEN 'no votes' WHEN votes < least THEN 'kept, no majority' WHEN t.value = o.value THEN 'confirmed' ELSE 'changed' END AS outcome
FROM o LEFT JOIN t ON t.uid = o.uid JOIN m ON true""")
def consensus_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O8."""
    votes = spark.createDataFrame(_VOTES, "group string, position int, uid string, value string")
    return selection.consensus(spark.createDataFrame(_ORIGINAL, "uid string, value string"), votes)


# The SQL front end: L*, F*, P*, C1-C5 -----------------------------------------------------------------


@query("""SELECT * FROM (VALUES ('stg_customer', 'c_name'), ('stg_lineitem', 'l_extendedprice'), ('stg_lineitem', 'l_linenumber'), ('stg_lineitem', 'l_linestatus'),
('stg_lineitem', 'l_note'), ('stg_lineitem', 'l_tax')) AS t(model, "column")""")
def unused_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1-P4, P9."""
    return spark.createDataFrame([(m, c) for m, s, c in _lineage(spark, sf_dir).unused_columns() if m == s], "model string, column string")


@query("SELECT * FROM (VALUES ('mart_inner_fk', 'p', 'INNER', 'needs_verification'), ('mart_left_fanout', 'l', 'LEFT', 'likely_safe'), ('mart_left_unused', 'c', 'LEFT', 'likely_safe')) AS t(model, alias, kind, confidence)")
def prunable_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5-P8, P10; a join that another join's ON needs is not among them."""
    return spark.createDataFrame([(p.model, p.alias, p.kind, p.confidence) for p in _lineage(spark, sf_dir).prunable_joins()], "model string, alias string, kind string, confidence string")


@query("SELECT * FROM (VALUES ('int_order_revenue', 2, 1, 1, 1, 2, 0), ('mart_active_union', 3, 0, 0, 0, 0, 2), ('mart_chain_on', 3, 2, 2, 0, 0, 0), ('mart_full_outer', 2, 1, 1, 2, 2, 0), ('mart_top_orders', 1, 0, 0, 0, 0, 0)) AS t(model, table_scans, joins_count, join_keys, group_by_count, aggs_total, unions)")
def sql_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1-C5."""
    shown = ["table_scans", "joins_count", "join_keys", "group_by_count", "aggs_total", "unions"]
    rows = spark.createDataFrame(_lineage(spark, sf_dir).feature_rows(), "model string, feature string, value int").filter(F.col("feature").isin(*shown))
    wide = rows.groupBy("model").pivot("feature", shown).agg(F.sum("value").cast("int"))
    return wide.filter(F.col("model").isin("int_order_revenue", "mart_active_union", "mart_chain_on", "mart_full_outer", "mart_top_orders"))


@query("SELECT * FROM (VALUES ('and_order', true), ('in_order', true), ('alias', true), ('parentheses', true), ('long_literals', false), ('distinct', false), ('filter', false)) AS t(pair, same)")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pairs of statements have equal column fingerprints."""
    from .plans.project import Project

    t = "{{ source('orders') }}"
    pairs = {
        "and_order": (f"SELECT o_orderkey = 1 AND o_custkey > 2 AS c FROM {t}", f"SELECT o_custkey > 2 AND o_orderkey = 1 AS c FROM {t}"),
        "in_order": (f"SELECT o_orderkey IN (1, 2, 3) AS c FROM {t}", f"SELECT o_orderkey IN (3, 1, 2) AS c FROM {t}"),
        "alias": (f"SELECT a.o_totalprice + 1 AS c FROM {t} AS a", f"SELECT 1 + b.o_totalprice AS c FROM {t} AS b"),
        "parentheses": (f"SELECT (o_totalprice * 2) * 3 AS c FROM {t}", f"SELECT o_totalprice * (2 * 3) AS c FROM {t}"),
        "long_literals": (f"SELECT o_orderstatus = 'abcdefghijklmnopqrstuvwxyz' AS c FROM {t}", f"SELECT o_orderstatus = 'abcdefghijklmnopqrstuvwxyZ' AS c FROM {t}"),
        "distinct": (f"SELECT count(DISTINCT o_custkey) AS c FROM {t}", f"SELECT count(o_custkey) AS c FROM {t}"),
        "filter": (f"SELECT sum(o_totalprice) FILTER (WHERE o_custkey > 1) AS c FROM {t}", f"SELECT sum(o_totalprice) AS c FROM {t}"),
    }
    models = {f"{k}_{i}": sql for k, p in pairs.items() for i, sql in enumerate(p)}
    lin = Lineage(spark, Project.from_sql(models, ("orders",)), {"orders": table(spark, sf_dir, "orders").columns})
    seen = {m: fingerprint(lin.column_exprs(m)["c"]) for m in models}
    return spark.createDataFrame([(k, seen[f"{k}_0"] == seen[f"{k}_1"]) for k in pairs], "pair string, same boolean")


@query("SELECT * FROM (VALUES ('int_order_revenue,mart_priority_inline')) AS t(models)")
def shared_join_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models whose backbones share a join of base models, from scope tokens by self-join."""
    tokens = _lineage(spark, sf_dir).backbone_tokens().filter(F.col("token").startswith("join:"))
    pairs = similarity.jaccard_pairs(tokens, 0.3)
    groups = graph.components(pairs.select("a", "b")).groupBy("component").agg(F.array_join(F.array_sort(F.collect_set("node")), ",").alias("models"))
    return groups.filter(F.col("models").contains("int_order_revenue")).select("models")


@query("SELECT sum(slot_ms) / 1000 AS slot_seconds FROM (VALUES (1500.0::DOUBLE, 'CREATE TABLE'), (250.5, 'CREATE TABLE'), (9.0, 'CREATE VIEW')) AS t(slot_ms, code) WHERE code = 'CREATE TABLE'")
def run_stats_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4-S6."""
    from .sources import artifacts

    results = {"results": [{"unique_id": f"model.m{i}", "adapter_response": {"code": c, "slot_ms": s}} for i, (s, c) in enumerate([(1500.0, "CREATE TABLE"), (250.5, "CREATE TABLE"), (9.0, "CREATE VIEW")])]}
    return artifacts.total_slot_seconds(artifacts.table_stats(artifacts.run_results(spark, results)))
