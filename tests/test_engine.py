"""Engine operators against hand-computed values and plain versions."""

import itertools
import random

import numpy as np
import pytest

from millrace import catalog
from millrace.functions import regression, verify
from millrace.operators import cost, frequency, graph, selection, similarity
from millrace.plans import catalyst, rewrite
from millrace.plans.demo import demo_project
from millrace.plans.expressions import HashConfig, Literal, Ref, Transform, canonical, fingerprint, is_expensive, op_counts, split_and, structurally_equal
from millrace.plans.lineage import Lineage
from millrace.plans.project import Project, count_refs, render
from millrace.sources import artifacts, sinks
from millrace.streaming import triggers

SF = "/root/testdata/sf0.001"


def edges(spark, rows):
    return spark.createDataFrame([(a, b, 1) for a, b in rows], "parent string, child string, weight int")


def names(spark, *n):
    return spark.createDataFrame([(x,) for x in n], "node string")


def listed(df, column="node"):
    return sorted(r[column] for r in df.collect())


def test_project_references_and_order():
    p = Project.from_sql({"a": "SELECT * FROM {{ source('t') }}", "b": "SELECT * FROM {{ref(\"a\")}} JOIN {{ ref('a') }} USING (x)"}, ("t",))
    assert p.order() == ["source.t", "model.a", "model.b"] and p.weights()["model.a", "model.b"] == 2
    assert count_refs(p.nodes["model.b"].sql, "a") == 2
    assert render("{{ ref('a') }} {{ ref('zz') }}", {"a": "x.a"}) == ("x.a zz", ["zz"])
    with pytest.raises(ValueError):
        Project.from_sql({"a": "SELECT * FROM {{ ref('b') }}", "b": "SELECT * FROM {{ ref('a') }}"}).order()
    assert "model" in p.describe() and '"a" -> "b"' in p.dot()


def test_fingerprints():
    a, b, c = Ref("x", "t"), Ref("y", "t"), Literal(3, "INT")
    assert fingerprint(Transform("and", (a, Transform("and", (b, c))))) == fingerprint(Transform("and", (c, b, a)))
    assert fingerprint(Transform("sub", (a, b))) != fingerprint(Transform("sub", (b, a)))
    assert fingerprint(Transform("in", (a, c, Literal(1)))) == fingerprint(Transform("in", (a, Literal(1), c)))
    long = "abcdefghijklmnopqrst"
    assert fingerprint(Literal(long + "1")) != fingerprint(Literal(long + "2"))
    assert structurally_equal(Literal("aaa"), Literal("bbb"), HashConfig(anonymize_literals=True))
    agg = Transform("agg", (a,), (("func", "sum"), ("group_keys", (a, b))))
    assert canonical(agg) == canonical(Transform("agg", (a,), (("func", "sum"), ("group_keys", (b, a)))))
    assert is_expensive(Transform("add", (agg, c))) and not is_expensive(a)
    assert op_counts(Transform("add", (agg, c)))["agg"] == 1 and len(split_and(Transform("and", (a, Transform("and", (b, c)))))) == 3
    rng = random.Random(0)
    for _ in range(50):
        items = [Ref(x, "t") for x in "abcde"]
        rng.shuffle(items)
        assert fingerprint(Transform("or", tuple(items))) == fingerprint(Transform("or", tuple(Ref(x, "t") for x in "abcde")))


def test_front_end(spark):
    def scope(sql):
        return catalyst.ScopeBuilder("m").build(catalyst.parse(spark, sql))

    s = scope("WITH q AS (SELECT a FROM t) SELECT x.a, count(*) n FROM q x LEFT JOIN u ON x.a = u.k WHERE u.z > 1 GROUP BY x.a HAVING count(*) > 2 ORDER BY n LIMIT 3")
    assert s.sources["x"][0] == "scope" and s.sources["u"] == ("table", "u") and s.joins[0].kind == "LEFT"
    assert [t for t, _ in s.filters] == ["HAVING", "WHERE"] and s.order == ["a", "n"] and s.limit is not None and len(s.sort) == 1
    u = scope("SELECT a FROM t UNION SELECT b FROM u UNION ALL SELECT c FROM v")
    assert u.set_op == "UNION" and not u.set_distinct and u.set_children[0].set_distinct
    assert scope("SELECT * FROM t SEMI JOIN u ON t.a = u.a").joins[0].kind == "SEMI"
    assert scope("SELECT a FROM t JOIN u USING (k)").joins[0].using == ("k",)
    assert scope("SELECT a FROM t GROUP BY ROLLUP (a)").grouping == "rollup"
    f = catalyst.features(catalyst.parse(spark, "WITH q AS (SELECT a FROM t WHERE b IN (1, 2)) SELECT p.a FROM q p JOIN q r ON p.a = r.a AND p.a < r.a WHERE p.a LIKE 'x%' AND p.b IS NULL"))
    assert (f["table_scans"], f["joins_count"], f["join_keys"], f["non_equi_join_count"], f["pred_in"], f["pred_range"], f["pred_eq"]) == (2, 1, 1, 1, 2, 1, 1)


def test_from_clauses_beyond_tables_and_joins(spark):
    """Each parses to scopes, keeps its sources' columns in demand, and runs."""
    models = {
        "base": "SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS p, o_orderpriority AS w, 'x' AS spare FROM {{ source('orders') }}",
        "from_values": "SELECT b.k, v.n FROM {{ ref('base') }} AS b JOIN (VALUES (1, 'a'), (2, 'b')) AS v(c, n) ON b.c = v.c",
        "from_range": "SELECT b.k, r.id FROM {{ ref('base') }} AS b JOIN range(10) AS r ON b.c = r.id",
        "from_view": "SELECT b.k, x.part FROM {{ ref('base') }} AS b LATERAL VIEW explode(split(b.w, '-')) x AS part",
        "from_sample": "SELECT b.k FROM {{ ref('base') }} TABLESAMPLE (100 PERCENT) AS b",
        "from_hint": "SELECT /*+ BROADCAST(b) */ b.k FROM {{ ref('base') }} AS b",
        "from_pivot": "SELECT * FROM (SELECT w, p FROM {{ ref('base') }}) PIVOT (count(p) FOR w IN ('1-URGENT' AS urgent, '5-LOW' AS low))",
        "from_lateral": "SELECT b.k, l.d FROM {{ ref('base') }} AS b, LATERAL (SELECT b.p * 2 AS d) AS l",
        "top_each": "SELECT c, k FROM {{ ref('base') }} QUALIFY row_number() OVER (PARTITION BY c ORDER BY p DESC, k) = 1",
    }
    p = Project.from_sql(models, ("orders",))
    lin = Lineage(spark, p, {"orders": spark.read.parquet(f"{SF}/orders.parquet").columns})
    assert not lin.errors
    assert ("base", "base", "spare") in lin.unused_columns() and not {("base", "base", c) for c in "kcpw"} & set(lin.unused_columns())
    assert lin.scopes["from_values"].sources["v"] == ("made", ["c", "n"])
    from millrace.runner import run

    out = run(spark, p, SF)
    assert all(out[m].count() > 0 for m in models if m not in ("base", "from_values"))
    assert out["top_each"].groupBy("c").count().filter("count > 1").isEmpty()


def test_a_model_that_does_not_parse_keeps_its_parents_whole(spark):
    p = Project.from_sql({"base": "SELECT o_orderkey AS k, o_custkey AS c FROM {{ source('orders') }}", "good": "SELECT k FROM {{ ref('base') }}", "bad": "SELEC FROM {{ ref('base') }} WHERE ((("}, ("orders",))
    lin = Lineage(spark, p, {"orders": ["o_orderkey", "o_custkey"]})
    assert list(lin.errors) == ["bad"] and not lin.unused_columns()


def test_long_chains_are_traced(spark):
    models = {"m0": "SELECT o_orderkey AS k, o_custkey AS c FROM {{ source('orders') }}"}
    models |= {f"m{i}": f"SELECT k, c FROM {{{{ ref('m{i - 1}') }}}}" for i in range(1, 260)}
    lin = Lineage(spark, Project.from_sql(models, ("orders",)), {"orders": ["o_orderkey", "o_custkey"]})
    assert lin.column_exprs("m259")["k"] == Ref("o_orderkey", "orders")


def test_conditions_by_what_they_compare(spark):
    f = catalyst.features(catalyst.parse(spark, """SELECT a.x, sum(a.y) OVER (PARTITION BY a.x ORDER BY a.t) AS s FROM a JOIN b ON lower(a.x) = lower(b.x) AND date(a.t) = date(b.t)
        WHERE a.y <> b.y AND a.z <> 3 AND a.x IS NOT NULL AND (a.x = 1 OR a.x = 2) AND a.y BETWEEN 1 AND 2 ORDER BY s"""))
    assert (f["join_keys"], f["non_equi_join_count"], f["pred_eq"], f["pred_range"], f["predicates_count"]) == (2, 1, 0, 2, 2)
    assert (f["window_funcs"], f["aggs_total"], f["order_by_count"]) == (1, 1, 2)
    assert "predicates_count" not in {*catalyst.FOR_BYTES, *catalyst.FOR_CARDINALITY, *catalyst.FOR_TIME} and "non_equi_join_count" in catalyst.FOR_TIME


def test_qualify_in_its_places(spark):
    spark.createDataFrame([(1, 2), (1, 3), (2, 5), (2, 5)], "a int, b int").createOrReplaceTempView("qualified")
    rn = "row_number() OVER (PARTITION BY a ORDER BY b DESC)"
    for sql, rows in {
        f"SELECT DISTINCT a, b FROM qualified QUALIFY rank() OVER (PARTITION BY a ORDER BY b DESC) = 1": [(1, 3), (2, 5)],
        f"WITH q AS (SELECT a, b FROM qualified QUALIFY {rn} = 1) SELECT a, b FROM q WHERE b > 4": [(2, 5)],
        f"SELECT a, b FROM (SELECT a, b FROM qualified QUALIFY {rn} = 1) AS z ORDER BY a": [(1, 3), (2, 5)],
        f"SELECT a, b, {rn} AS n FROM qualified QUALIFY n = 2 ORDER BY a LIMIT 1": [(1, 2, 2)],
        f"SELECT a, 'qualify (' AS b FROM qualified QUALIFY {rn} = 1 UNION ALL SELECT 9, 'z'": [(1, "qualify ("), (2, "qualify ("), (9, "z")],
        f"SELECT a, sum(b) AS s FROM qualified GROUP BY a QUALIFY rank() OVER (ORDER BY sum(b) DESC) = 1": [(2, 10)],
    }.items():
        assert sorted(tuple(r) for r in spark.sql(catalyst.rewrite_qualify(sql)).collect()) == rows, sql


def test_qualify_is_rewritten(spark):
    spark.createDataFrame([(1, 2), (1, 3), (2, 5)], "a int, b int").createOrReplaceTempView("qualified")
    sql = catalyst.rewrite_qualify("SELECT a, b FROM qualified QUALIFY row_number() OVER (PARTITION BY a ORDER BY b DESC) = 1")
    assert sorted(tuple(r) for r in spark.sql(sql).collect()) == [(1, 3), (2, 5)]


def lineage(spark):
    return Lineage(spark, demo_project(), {t: spark.read.parquet(f"{SF}/{t}.parquet").columns for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")})


def test_lineage_and_pruning(spark):
    lin = lineage(spark)
    assert not lin.errors
    assert lin.column_exprs("mart_segment_revenue")["c_mktsegment"] == Ref("c_mktsegment", "customer")
    assert {(p.model, p.alias) for p in lin.prunable_joins()} == {("mart_inner_fk", "p"), ("mart_left_fanout", "l"), ("mart_left_unused", "c")}
    assert ("stg_lineitem", "stg_lineitem", "l_note") in lin.unused_columns()
    assert any(t.startswith("join:") and t in lin.backbones()["mart_priority_inline"] for t in lin.backbones()["int_order_revenue"])
    assert sum(map(len, lin.same_dataflow())) == len(lin.scopes) and lin.near_dataflow()
    assert lin.scope_signatures()


def test_rewrite_text():
    sql = "SELECT o.a FROM {{ ref('x') }} AS o LEFT JOIN {{ ref('y') }} AS c ON o.k = c.k WHERE o.a > 1"
    assert " ".join(rewrite.drop_join(sql, "c").split()) == "SELECT o.a FROM {{ ref('x') }} AS o WHERE o.a > 1"
    assert rewrite.drop_join(sql, "zz") is None
    with pytest.raises(ValueError):
        rewrite.apply(demo_project(), [rewrite.Rewrite("g", "k", {"stg_part": "SELECT 1"}), rewrite.Rewrite("h", "k", {"stg_part": "SELECT 2"})])


def test_wrong_rewrites_are_rejected(spark):
    bad = rewrite.Rewrite("g", "wrong", {"mart_top_parts": "SELECT p_partkey, p_name, p_retailprice FROM {{ ref('stg_part') }} ORDER BY p_retailprice, p_partkey LIMIT 25"})
    assert not rewrite.prove(spark, demo_project(), bad, SF) and bad.status == "rejected"


def test_graph_corner_cases(spark):
    diamond = edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "y")])
    assert listed(graph.roots(diamond)) == ["a", "x"] and listed(graph.leaves(diamond)) == ["d", "y"]
    assert {r["node"]: r["level"] for r in graph.levels(diamond).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "x": 0, "y": 1}
    assert listed(graph.lowest_common_ancestors(diamond, names(spark, "b", "c"))) == ["a"]
    assert listed(graph.lowest_common_ancestors(diamond, names(spark, "b", "y"))) == ["b", "y"]
    assert listed(graph.between(diamond, names(spark, "a"), names(spark, "d"))) == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        graph.between(diamond, names(spark, "a"), names(spark, "y"))
    with pytest.raises(ValueError):
        graph.levels(edges(spark, [("r", "a"), ("a", "b"), ("b", "a")]))
    star = edges(spark, [("hub", f"n{i}") for i in range(70)])
    assert graph.neighborhood(star, names(spark, "hub")) is None
    assert graph.neighborhood(star, names(spark, "n1"), max_nodes=80).count() == 71


def test_components_and_core_against_plain(spark):
    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(35)}
    df = spark.createDataFrame(sorted(pairs), "a int, b int")
    root = {n: n for p in pairs for n in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert {r["node"]: r["component"] for r in graph.components(df).collect()} == root
    left = set(pairs)
    while True:
        degree = {n: sum(n in p for p in left) for p in left for n in p}
        nxt = {p for p in left if degree[p[0]] >= 2 and degree[p[1]] >= 2}
        if nxt == left:
            break
        left = nxt
    assert listed(graph.k_core(df, 2)) == sorted({n for p in left for n in p})


def test_plain_similarities():
    assert similarity.jaccard({"a": 2, "b": 1}, {"a": 1, "c": 1}) == 1 / 4 and similarity.jaccard({}, {"a": 1}) == 0
    assert similarity.anchor_distance({1, 2}, {2, 3, 4}) == 2 and similarity.substitution_distance({1, 2}, {2, 3}) == 1
    with pytest.raises(ValueError):
        similarity.substitution_distance({1}, {1, 2})
    assert similarity.add_scaled({"a": 1}, {"a": 1, "b": 2}, 2) == {"a": 3, "b": 4}


def test_flips_against_enumeration(spark):
    rng = random.Random(9)
    nodes = [f"n{i}" for i in range(7)]
    for _ in range(4):
        links = [(a, b, rng.uniform(-30, 60)) for a, b in itertools.combinations(nodes, 2) if rng.random() < 0.4]
        b = {n: rng.uniform(1, 50) for n in nodes}
        t = {n: rng.randint(0, 1) for n in nodes}

        def value(t):
            return sum(t[n] * b[n] for n in nodes) + sum(u * (1 - t[p]) * t[c] for p, c, u in links)

        best = min(value({n: 1 - v if n in s else v for n, v in t.items()}) + len(s) for k in range(4) for s in itertools.combinations(nodes, k)) - value(t)
        got = cost.best_flips(
            spark.createDataFrame(list(b.items()), "node string, b double"), spark.createDataFrame(links, "parent string, child string, u double"),
            spark.createDataFrame(list(t.items()), "node string, t int"), names(spark, *nodes),
        ).first()
        assert got["change"] == pytest.approx(best, abs=1e-6)


def test_selection_against_enumeration():
    rng = random.Random(5)
    for _ in range(20):
        weight = {f"g{i}": rng.uniform(0.1, 10) for i in range(9)}
        pairs = {p for p in itertools.combinations(sorted(weight), 2) if rng.random() < 0.3}
        got = selection.heaviest_independent(weight, pairs)
        assert not any(p in pairs for p in itertools.combinations(got, 2))
        best = max(sum(weight[g] for g in s) for k in range(10) for s in itertools.combinations(weight, k) if not any(p in pairs for p in itertools.combinations(sorted(s), 2)))
        assert sum(weight[g] for g in got) == pytest.approx(best)


def test_tuning_never_gets_worse(spark):
    e = catalog.demo_edges(spark).filter("parent like 'model.%'")
    out, history = cost.tune(e, catalog._assignment(spark).filter("node like 'model.%'"), lambda a: (catalog._node_cost(spark), catalog._edge_cost(spark)))
    costs = [h["cost"] for h in history]
    assert all(b <= a + 1e-9 for a, b in zip(costs, costs[1:]))
    t = {r["node"]: r["t"] for r in out.collect()}
    assert all(t[n] == 1 for n in listed(graph.leaves(e)))


def test_frequency_profile_rules(spark):
    e = edges(spark, [("r1", f"m{i}") for i in range(60)] + [(f"m{i}", f"leaf{i}") for i in range(60)] + [("r2", "m0")])
    p = frequency.frequency_profile(e, "mixed_cadence", seed=1)
    assert {r["node"]: r["level"] for r in p["root_levels"].collect()}["r1"] != 3
    levels = [r["level"] for r in p["leaf_levels"].collect()]
    assert len(levels) == 60 and levels.count(1) == 6 and levels.count(2) == 15 and levels.count(3) == 39
    assert listed(frequency.assign_levels(names(spark, "a", "b", "c"), (0.34, 0.33, 0.33), 1, "last")) == ["a", "b", "c"]
    assert triggers.trigger_for(3) == {"processingTime": "1 hour"}


def test_regressions(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 5, (60, 2))
    y = np.expm1(np.clip(0.8 * x[:, 0] + 0.3 * x[:, 1] + 1, 0, 15))
    rows = [(f"n{i}", float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "node string, f1 double, f2 double, y double")
    got = regression.fit_huber(df, ["f1", "f2"], "y").predict(df).toPandas()
    assert (abs(got["prediction"] - got["y"]) / got["y"]).median() < 0.05
    with pytest.raises(ValueError):
        regression.fit_huber(df.limit(3), ["f1", "f2"], "y")
    w, c = regression.fit_constrained_huber(x, x @ [2.0, -1.0] + 3, np.array([0.0, 0.0]), np.array([np.inf, np.inf]))
    assert w[0] > 1.5 and w[1] == 0.0
    anchors = spark.createDataFrame([("n", f"a{i}", 1.0 - i / 10, float(10 * (i + 1)), 0.0) for i in range(6)], "node string, anchor string, score double, rows double, ratio double")
    assert regression.predict_by_siblings(anchors).first()["rows"] == pytest.approx(30)


def test_artifacts(spark, tmp_path):
    manifest = {
        "nodes": {
            "model.p.a": {"resource_type": "model", "name": "a", "alias": "A1", "database": "d", "schema": "s", "raw_code": "select 1", "depends_on": {"nodes": ["source.p.t"]}, "config": {"materialized": "table"}},
            "test.p.x": {"resource_type": "test", "name": "x"},
        },
        "sources": {"source.p.t": {"resource_type": "source", "name": "t", "database": "d", "schema": "raw"}},
    }
    p = artifacts.project_from_manifest(manifest)
    assert p.nodes["model.p.a"].relation == "d.s.A1" and p.parents["model.p.a"] == {"source.p.t"} and "test.p.x" not in p.nodes
    assert artifacts.catalog_columns({"nodes": {"m": {"metadata": {"database": "D", "schema": "S", "name": "T"}, "columns": {"C": {"type": "INT"}}}}}) == {"d.s.t": {"c": "INT"}, "s.t": {"c": "INT"}}
    (tmp_path / "x.csv").write_text("b,a\n007,1\n,2\n")
    got = artifacts.csv_with_schema(spark, str(tmp_path / "x.csv"), [{"name": "a", "type": "INTEGER"}, {"name": "b", "type": "STRING"}, {"name": "c", "type": "FLOAT"}])
    assert [tuple(r) for r in got.orderBy("a").collect()] == [(1, "007", None), (2, None, None)]
    assert artifacts.candidate_files(["run_group_3_x.json", "other", "run_cc_4.json"], "run") == [("run_cc_4.json", "group_4"), ("run_group_3_x.json", "group_3")]
    assert artifacts.repair_json('```json\nhere {"a": 1} end\n```') == {"a": 1}
    sinks.write_project(demo_project(), str(tmp_path / "out"))
    assert sinks.read_yaml_materializations(str(tmp_path / "out"))["int_order_revenue"] == "table"
    sub = sinks.subgraph_json(demo_project(), "group_1", {"model.stg_part", "model.mart_inner_fk"}, {"model.mart_inner_fk"}, {})
    assert sub["subgraph"]["has_external_children"]["model.stg_part"] and sub["subgraph"]["roots"] == ["model.stg_part"]
    assert sinks.new_model_folder({"stg_a": "models/staging/stg_a.sql", "m": "models/marts/m.sql"}, "stg_b", []) == "models/staging"


def test_verify(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "a int, b string")
    assert verify.same(a, a.select("b", "a")) and not verify.same(a, a.distinct())
    row = verify.difference(a, a.distinct()).first()
    assert (row["only_a"], row["only_b"]) == (1, 0)
    assert verify.accepted([verify.Diagnostic("skipped_cost", "")]) and not verify.accepted([verify.Diagnostic("skipped_cost", "")], strict_cost=True)
