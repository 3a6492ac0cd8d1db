"""B, U and cardinalities with a model that can be worked out by hand: cost = scans + 10 * log_rows."""

import math

import pytest
from pyspark.sql import functions as F

from millrace.operators import costmodel


class Linear:
    def predict(self, df, out):
        return df.withColumn(out, F.col("scans") + 10 * F.col("log_rows"))


NAMES = ["scans", "log_rows"]


def test_costs_by_hand(spark):
    edges = spark.createDataFrame([("t", "v", 1), ("v", "m", 2), ("t", "m", 1)], "parent string, child string, weight int")
    features = spark.createDataFrame([("v", "scans", 3.0), ("m", "scans", 5.0)], "node string, feature string, value double")
    cards = spark.createDataFrame([("t", 100.0), ("v", 20.0)], "node string, rows double")
    t = spark.createDataFrame([("t", 1), ("v", 0), ("m", 1)], "node string, t int")
    base = costmodel.baseline_costs(edges, features, cards, Linear(), NAMES)
    b = {r["node"]: r["b"] for r in base.collect()}
    assert b["v"] == pytest.approx(3 + 10 * math.log1p(100)) and b["m"] == pytest.approx(5 + 10 * math.log1p(120)) and b["t"] == 0
    u = {(r["parent"], r["child"]): r["u"] for r in costmodel.view_costs(edges, t, features, cards, base, Linear(), NAMES).collect()}
    # v inlined into m: 5 + 2 * 3 scans, and v's 20 rows replaced by the 100 that reach it.
    assert u["v", "m"] == pytest.approx(11 + 10 * math.log1p(200) - b["m"])
    got = costmodel.pipeline_cost(edges, t, features, cards, Linear(), NAMES).first()["cost"]
    assert got == pytest.approx(b["t"] + b["m"] + u["v", "m"])


def test_cardinalities_level_by_level(spark):
    edges = spark.createDataFrame([("t", "a", 1), ("a", "b", 1)], "parent string, child string, weight int")
    features = spark.createDataFrame([("a", "scans", 1.0), ("b", "scans", 2.0)], "node string, feature string, value double")
    known = spark.createDataFrame([("t", 10.0)], "node string, rows double")
    got = {r["node"]: (r["rows"], r["predicted"]) for r in costmodel.fill_cardinalities(edges, features, known, Linear(), NAMES).collect()}
    a = 1 + 10 * math.log1p(10)
    assert got["t"] == (10.0, False) and got["a"][0] == pytest.approx(a) and got["b"][0] == pytest.approx(2 + 10 * math.log1p(a)) and got["b"][1]
