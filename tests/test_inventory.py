"""Rows of the inventory that no query reaches, each on a small case worked by hand."""

import json
import math

import pytest
from pyspark.sql import functions as F

from millrace import tuning
from millrace.functions import regression
from millrace.operators import cost, frequency, graph, selection, similarity
from millrace.plans import catalyst
from millrace.plans.demo import demo_project
from millrace.plans.expressions import HashConfig, Literal, Ref, Transform, fingerprint, op_counts
from millrace.plans.lineage import Lineage
from millrace.plans.project import Project
from millrace.sources import artifacts, sinks

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], "parent string, child string, weight int")


def named(spark, *nodes):
    return spark.createDataFrame([(n,) for n in nodes], "node string")


def test_manifest_nodes_and_names(spark, tmp_path):
    node = lambda kind, name, **more: {"resource_type": kind, "name": name, "raw_code": "SELECT 1", "database": "d", "schema": "s", **more}
    manifest = {"nodes": {"model.p.b": node("model", "b", config={"materialized": "table"}, depends_on={"nodes": ["source.p.t"]}), "test.p.x": node("test", "x"), "model.p.a": node("model", "a", alias="aa")}, "sources": {"source.p.t": node("source", "t")}}
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps(manifest))
    project = artifacts.project_from_manifest(artifacts.load_manifest(str(path)))
    assert sorted(project.nodes) == ["model.p.a", "model.p.b", "source.p.t"] and project.nodes["model.p.a"].relation == "d.s.aa"
    nodes = project.nodes_df(spark)
    assert rows(artifacts.materializations(nodes)) == [("model.p.a", "undefined"), ("model.p.b", "table")]
    assert rows(artifacts.short_names(nodes)) == [("a", "d.s.aa"), ("b", "d.s.b")]
    assert rows(artifacts.names_like(nodes, "P.A").select("unique_id")) == [("model.p.a",)] and rows(artifacts.names_equal(nodes, "T").select("unique_id")) == [("source.p.t",)]
    assert artifacts.clean_relation('`d`."s"..[t]') == "d.s.t" and artifacts.clean_relation(None) == ""
    catalog = {"nodes": {"model.p.a": {"metadata": {"database": "D", "schema": "S", "name": "A"}, "columns": {"X": {"type": "int"}}, "stats": {"num_rows": {"value": 7}, "has_stats": {"value": True, "include": False}}}}}
    assert artifacts.relation_stats(catalog)["s.a"] == {"num_rows": 7} and artifacts.catalog_columns(catalog)["d.s.a"] == {"x": "int"}


def test_run_artifacts(spark):
    seen = spark.createDataFrame([("m1", 5.0), ("m2", 6.0)], "unique_id string, rows double")
    base = spark.createDataFrame([("m2", 60.0), ("m3", 70.0)], "unique_id string, rows double")
    assert rows(artifacts.merge_baseline(seen, base)) == [("m1", 5.0), ("m2", 60.0), ("m3", 70.0)]
    spark.range(3).createOrReplaceTempView("three_rows")
    assert {r["name"]: r["rows"] for r in artifacts.row_counts(spark, ["three_rows", "no_such_relation"]).collect()} == {"three_rows": 3, "no_such_relation": None}
    have = spark.createDataFrame([("a", "features"), ("a", "graph"), ("a", "materialization"), ("b", "graph"), ("b", "graph"), ("b", "x")], "candidate string, kind string")
    assert rows(artifacts.complete(spark.createDataFrame([("a",), ("b",)], "candidate string"), have)) == [("a",)]


def test_writers(spark, tmp_path):
    project = demo_project()
    whole = sinks.whole_project_json(project)["subgraph"]
    assert len(whole["all_nodes"]) == len(project.models()) == len(whole["component_nodes"]) and not whole["context_nodes"]
    df = spark.createDataFrame([("m", "joins", 1)], "model string, feature string, value int")
    sinks.write_csv(df, str(tmp_path / "csv"))
    sinks.write_features(df, str(tmp_path / "features"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["feature"] == "joins" and rows(spark.read.parquet(str(tmp_path / "features"))) == rows(df)
    paths = {"a": "models/x/one/a.sql", "b": "models/x/two/b.sql", "shared_c": "models/s/shared_c.sql"}
    assert sinks.new_model_folder(paths, "n", ["a", "b"]) == "models/x" and sinks.new_model_folder(paths, "shared_d", []) == "models/s" and sinks.new_model_folder({}, "n", []) == "models"
    lin = Lineage(spark, Project.from_sql({"u": "SELECT a.x FROM {{ source('t') }} a JOIN {{ source('s') }} b ON a.x = b.x", "v": "SELECT 1 AS x UNION ALL SELECT a.x FROM {{ source('t') }} a JOIN {{ source('s') }} b ON a.x = b.x"}, ("t", "s")))
    shown = sinks.skeletons(lin.backbones(True))
    assert len(shown["u"]) == 1 and shown["v"] == {}


def test_statements(spark):
    plan = catalyst.parse(spark, "SELECT a.x, sum(t.b.y) FROM t GROUP BY a.x")
    assert catalyst.column_names(plan) == {"a.x", "t.b.y"} and catalyst.basic_counts(plan) == {"joins": 0, "group_bys": 1, "windows": 0}
    f = catalyst.features(catalyst.parse(spark, "WITH q AS (SELECT a FROM t JOIN u ON t.a = u.a), r AS (SELECT a FROM q) SELECT * FROM r x JOIN r y ON x.a = y.a"))
    assert (f["table_scans"], f["joins_count"], f["join_keys"]) == (4, 3, 3)
    anonymous = HashConfig(anonymize_literals=True)
    assert fingerprint(Literal(3, "INT"), anonymous) == fingerprint(Literal(1234567, "INT"), anonymous) != fingerprint(Literal(3.0, "FLOAT"), anonymous)
    assert fingerprint(Literal("ab"), anonymous) != fingerprint(Literal("abcdef"), anonymous)
    assert op_counts(Transform("add", (Ref("x", "t"), Transform("mul", (Ref("y", "t"), Literal(2)))))) == {"add": 1, "mul": 1}
    window = "SELECT sum(x) OVER (PARTITION BY {p} ORDER BY {o}) AS c FROM {{{{ source('t') }}}}"
    lin = Lineage(spark, Project.from_sql({"a": window.format(p="p", o="o"), "b": window.format(p="p", o="o").replace("x)", "x )"), "c": window.format(p="o", o="p")}, ("t",)), {"t": ["x", "p", "o"]})
    prints = {m: fingerprint(lin.column_exprs(m)["c"]) for m in "abc"}
    assert prints["a"] == prints["b"] != prints["c"] and lin.op_histogram("a")["window"] == 1


def test_anchored_scope_pairs_to_models(spark):
    tokens = spark.createDataFrame([("s1", "join:j", 3.0), ("s1", "pred:p", 1.0), ("s2", "join:j", 3.0), ("s2", "pred:p", 1.0), ("s3", "join:j", 3.0), ("s3", "pred:q", 1.0), ("s4", "pred:p", 1.0)], "owner string, token string, weight double")
    pairs = similarity.anchored_pairs(tokens)
    assert {(a, b): round(s, 6) for a, b, _, s in pairs.select("a", "b", "shared", "score").collect()} == {("s1", "s2"): 1.0, ("s1", "s3"): 0.6, ("s2", "s3"): 0.6}
    owner = spark.createDataFrame([("s1", "m1"), ("s2", "m1"), ("s3", "m2"), ("s4", "m3")], "owner string, model string")
    assert rows(similarity.model_edges(pairs, owner)) == [("m1", "m2", 0.6)] and rows(similarity.model_edges(pairs, owner, 0.7)) == []
    assert rows(graph.components(similarity.model_edges(pairs, owner).select("a", "b"))) == [("m1", "m1"), ("m2", "m1")]
    assert similarity.shared_weight({"a": 1, "b": 1}, {"b": 2, "c": 1}, {"b": 4.0}) == 4.0


def test_graph_rows(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("b", "d"), ("x", "d"), ("seed.s", "b"))
    assert rows(graph.has_descendant_in(e, named(spark, "c"))) == [("a",), ("b",), ("seed.s",)]
    assert graph.induced_edge_count(spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "c")], "a string, b string"), named(spark, "a", "b", "c")) == 2
    assert graph.overlap(named(spark, "a", "b"), named(spark, "b")) and not graph.overlap(named(spark, "a"), named(spark, "b"))
    assert rows(graph.audit_kinds(e, named(spark, "a", "b", "c"), named(spark, "b", "c"))) == [("a", False, False), ("b", False, True), ("c", True, False)]
    groups = spark.createDataFrame([("g1", "b"), ("g2", "x")], "group string, node string")
    got = graph.group_neighborhoods(e, groups)
    assert listed(got["g1"]) == ["a", "b", "c", "d"] and listed(got["g2"]) == ["d", "x"]


def listed(df):
    return sorted(r["node"] for r in df.collect())


def test_choices(spark):
    nodes = spark.createDataFrame([("model.a", "model", "table"), ("model.b", "model", "incremental"), ("seed.s", "seed", "seed"), ("model.elementary.x", "model", "view"), ("source.t", "source", None)], "unique_id string, resource_type string, materialized string")
    assert rows(cost.included_nodes(nodes).select("unique_id")) == [("model.a",), ("source.t",)]
    changed = spark.createDataFrame([("g1", "m1"), ("g2", "m1"), ("g3", "m1"), ("g2", "m2")], "group string, uid string")
    assert rows(selection.collisions(changed, spark.createDataFrame([("g1",), ("g2",)], "group string"))) == [("m1", 2)]
    weighted = spark.createDataFrame([("g1", 1, "m1", "table")], "group string, position int, uid string, value string")
    plain = spark.createDataFrame([("g1", 1, "m1", "view"), ("g2", 2, "m1", "table")], "group string, position int, uid string, value string")
    original = spark.createDataFrame([("m1", "view")], "uid string, value string")
    assert selection.consensus_with_fallback(original, weighted, plain).first()["value"] == "table" and selection.consensus(original, plain, 1.0).first()["value"] == "view"
    weight = {f"g{i:04}": 1.0 + i % 7 for i in range(2500)}
    path = {(f"g{i:04}", f"g{i + 1:04}") for i in range(0, 2498, 2)}
    chosen = selection.heaviest_independent(weight, path)
    assert sum(weight[g] for g in chosen) == sum(max(weight[f"g{i:04}"], weight[f"g{i + 1:04}"]) for i in range(0, 2498, 2)) + weight["g2498"] + weight["g2499"]
    star = selection.heaviest_independent({"hub": 5.0, **{f"n{i}": 0.001 for i in range(1500)}}, {(f"n{i}", "hub") for i in range(1500)})
    assert star == ["hub"]
    real = spark.createDataFrame([("c", 2, 7)], "node string, real int, multiplier int")
    b, u = frequency.weigh_costs(spark.createDataFrame([("c", 2.0), ("d", 3.0)], "node string, b double"), spark.createDataFrame([("p", "c", 4.0), ("p", "d", 5.0)], "parent string, child string, u double"), real)
    assert rows(b) == [("c", 14.0), ("d", 3.0)] and rows(u) == [("p", "c", 28.0), ("p", "d", 5.0)]


def test_sibling_models(spark):
    n = 12
    feats = [(f"m{i}", f, float(v)) for i in range(n) for f, v in (("joins", i % 4), ("keys", i % 3))]
    features = spark.createDataFrame(feats, "node string, feature string, value double")
    counts = spark.createDataFrame([(f"m{i}", math.expm1(2.0 * (i % 4) - 1.0 * (i % 3) + 3.0)) for i in range(n)], "node string, rows double")
    similar = spark.createDataFrame([(f"m{i}", f"m{j}", 0.5 + i / 100) for i in range(n) for j in range(i + 1, n)], "a string, b string, score double")
    pairs = regression.sibling_pairs(similar, counts, most=4)
    assert pairs.groupBy("a").count().agg(F.max("count")).first()[0] <= 4
    d = {(r["a"], r["b"], r["feature"]): r["value"] for r in regression.pair_differences(spark.createDataFrame([("m1", "m2")], "a string, b string"), features).collect()}
    assert d == {("m1", "m2", "joins"): -1.0, ("m1", "m2", "keys"): -1.0}
    model = regression.fit_sibling_difference(pairs, features, ["joins", "keys"])
    got = model.line(spark.createDataFrame([(1.0, 0.0), (0.0, 1.0)], "joins double, keys double"), "ratio").orderBy(F.desc("joins")).collect()
    assert abs(got[0]["ratio"] - 2.0) < 0.05 and abs(got[1]["ratio"] + 1.0) < 0.05


def test_learned_outputs(spark, tmp_path):
    data = spark.createDataFrame([("a" if i % 2 else "b", float(i), float(10 * (i % 2) + 1), i % 2) for i in range(40)], "kind string, x double, y double, empty int")
    fitted = regression.fit_elastic_net(data, ["kind"], "y", cells=1 << 8)
    got = {r["kind"]: r["prediction"] for r in regression.predict_elastic_net(data, fitted).collect()}
    assert abs(got["a"] - 11) < 1 and abs(got["b"] - 1) < 0.3
    *_, f1 = regression.fit_empty_classifier(data, ["kind"], "empty", cells=1 << 8)
    assert f1 == 1.0
    known = spark.createDataFrame([("a", 1.0)], "node string, predicted double")
    assert rows(regression.align(known, spark.createDataFrame([("a", 2.0)], "node string, measured double"))) == [("a", 1.0, 2.0)]
    with pytest.raises(ValueError):
        regression.align(known, spark.createDataFrame([("z", 2.0)], "node string, measured double"))
    model = regression.fit_huber(data, ["x"], "y")
    sinks.save_time_model(model, str(tmp_path / "bundle"))
    again = sinks.load_time_model(spark, str(tmp_path / "bundle"))
    assert rows(again.predict(data).select("x", "prediction")) == rows(model.predict(data).select("x", "prediction"))


def test_tuning_end_to_end(spark):
    project = demo_project()
    lin = Lineage(spark, project, {t: spark.read.parquet(f"{SF}/{t}.parquet").columns for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")})
    model = tuning.LinearTime({"joins_count": 0.5, "group_by_count": 0.25, "log_rows": 0.8}, 0.3)
    tuned, row = tuning.tune_project(spark, project, SF, lin, model, list(model.coefficients))
    got = row.first()
    assert got["after"] <= got["before"]
    assert all(tuned.nodes[u].materialized == "table" for u in tuned.leaves()) and {n.materialized for n in tuned.models()} == {"table", "view"}
