"""Pairs compared by blocks against the plain self-join."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import blocks, similarity


def plain(tokens, at_least=0.0):
    """(a, b, shared, score) by a self-join of bags, in Python."""
    bag, size = {}, {}
    for o, t, w in tokens:
        if o is not None:
            bag.setdefault(o, {})
            size[o] = size.get(o, 0) + (w or 0)
            if t is not None and w is not None:
                bag[o][t] = bag[o].get(t, 0) + w
    out, owners = [], sorted(bag)
    for i, a in enumerate(owners):
        for b in owners[i + 1 :]:
            common = bag[a].keys() & bag[b].keys()
            shared = sum(min(bag[a][t], bag[b][t]) for t in common)
            union = size[a] + size[b] - shared
            if common and union and shared / union >= at_least:
                out.append((a, b, shared, shared / union))
    return out


def bags(kind: str):
    rng = np.random.default_rng(3)
    rows = []
    for o in range(90):
        for t in rng.choice(60, int(rng.integers(1, 9)), replace=False).tolist() + [100, 101][: o % 3]:
            rows.append((f"o{o}é" if kind == "text" else o * 7 - 200, f"t{t}", int(rng.integers(1, 5)) * (0.25 if kind == "parts" else 1)))
    if kind == "zeros":
        rows = [(o, t, w - 2) for o, t, w in rows]
    if kind == "large":
        rows = [(o, t, w * 40000) for o, t, w in rows]
    return rows + [(None, "t1", rows[0][2]), (rows[0][0], None, rows[0][2])]


@pytest.mark.parametrize("kind", ["text", "whole", "parts", "zeros", "large"])
def test_blocks_equal_self_join(spark, monkeypatch, kind):
    monkeypatch.setattr(blocks, "OWNERS", 7)
    rows = bags(kind)
    types = f"owner {'string' if kind == 'text' else 'long'}, token string, weight {'double' if kind == 'parts' else 'long'}"
    df = spark.createDataFrame(rows, types).repartition(5)
    for least in (0.0, 0.3):
        got = similarity.jaccard_pairs(df, least)
        assert dict(got.dtypes)["shared"] == ("double" if kind == "parts" else "bigint")
        got, want = sorted(map(tuple, got.collect())), plain(rows, least)
        assert [g[:2] for g in got] == [w[:2] for w in want] and want
        assert np.allclose([g[2:] for g in got], [w[2:] for w in want], rtol=1e-12)
    best = similarity.top_pairs(similarity.jaccard_pairs(df, best=11), 11).collect()
    if kind != "parts":
        assert [tuple(r) for r in best] == sorted(plain(rows), key=lambda r: (-r[3], r[0], r[1]))[:11]


def test_no_owners(spark):
    none = spark.createDataFrame([], "owner long, token string, weight long")
    assert similarity.jaccard_pairs(none).collect() == [] and similarity.idf_jaccard_pairs(none).collect() == []


def test_pairs_do_not_move_by_token(spark):
    """A token of every owner made a row for each pair, which was shuffled; now only blocks are."""
    df = spark.range(3000).select(F.col("id").alias("owner"), F.explode(F.array(F.lit("x"), F.lit("y"))).alias("token"), F.lit(1.0).alias("weight"))
    pairs = similarity.jaccard_pairs(df)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("MapInArrow")[0] and "Aggregate" not in plan.split("MapInArrow")[0]
    assert pairs.agg(F.count("*"), F.min("score")).first() == (3000 * 2999 // 2, 1.0)


def test_idf_reads_its_tokens_once(spark):
    """Bags, owners and document frequencies each read the tokens anew, with the joins below them."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.createDataFrame([("p", "x", 2.0), ("q", "x", 1.0), ("q", "y", 1.0)], "owner string, token string, weight double")
    got = similarity.idf_jaccard_pairs(df.mapInArrow(count, df.schema)).collect()
    assert read.value == 3
    y = np.log(3 / 2) + 1
    assert [(r["a"], r["b"], r["shared"]) for r in got] == [("p", "q", 1.0)] and got[0]["score"] == pytest.approx(1 / (2 + 1 + y - 1))
