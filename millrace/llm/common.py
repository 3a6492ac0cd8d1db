"""Shared pieces: work folders, null-safe columns, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.cut import remove, shared_root


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back, which cuts the lineage."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, *written_frames: DataFrame) -> None:
    """Remove the files behind tables made by :func:`written` that no plan needs any more."""
    for df in written_frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(spark, path)


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id for every node of an undirected edge list.

    ``edges`` has columns ``a`` and ``b`` (long). Alternating large-star and small-star
    rounds; every round is a partial aggregation and a join that Spark may split when a
    hub is skewed; they end when a round changes nothing. Self edges and null ends are ignored. Returns ``id``, ``component_id``
    for nodes that have at least one edge to another node.
    """
    spark = edges.sparkSession
    e = (
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    e = written(e, "cc")
    before = None
    while True:
        sym = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            sym.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low2, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("p"))
            .select("p.a", "p.b")
            .filter("a <> b")
            .distinct()
        )
        after = written(small, "cc")
        state = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.max("a")).first())
        drop_written(spark, e)
        e = after
        if state == before:
            break
        before = state
    own = e.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(own)
