"""Near-duplicate embeddings by a forest of random-projection trees.

Each tree splits the vectors of a label at the median of a random projection, again and again;
vectors close to a split go to both sides (spill). Vectors are compared within leaves only, in
double precision, and links are joined to components.

The trees are fitted on a bounded sample (``sample`` vectors, those of smallest id hash), but
every vector is put into its leaves. Equal vectors are compared once and weighted. A leaf larger
than ``block`` vectors is compared exactly all the same, as pairs of blocks in separate tasks.
A pair that shares several leaves counts in the first of them only, which each leaf can tell from
the leaf numbers its vectors carry, so no pair leaves a task: it emits one row for each vector.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and
vectors without a label, link with nothing; so do vectors of different lengths. Repeated ids
are repeated rows of one vector each and count as separate vectors. Null ids are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, written

LINK = 0.93


class Tree:
    """One tree: flat arrays of directions, cuts and children; leaves are negative numbers."""

    def __init__(self, vectors: np.ndarray, expected: float, leaf: int, spill: float, seed):
        self._rng = np.random.default_rng(seed)
        self.direction, self.low, self.high, self.left, self.right = [], [], [], [], []
        self.leaves = 0
        self.root = self._grow(vectors, expected, leaf, spill)
        self.direction = np.array(self.direction)

    def _grow(self, v: np.ndarray, expected: float, leaf: int, spill: float) -> int:
        if expected <= leaf or len(v) < 8:
            self.leaves += 1
            return -self.leaves
        d = self._rng.standard_normal(v.shape[1])
        x = v @ d
        low, cut, high = np.quantile(x, [0.5 - spill, 0.5, 0.5 + spill])
        if not x.min() < cut < x.max():
            self.leaves += 1
            return -self.leaves
        at = len(self.direction)
        for a, value in ((self.direction, d), (self.low, low), (self.high, high), (self.left, 0), (self.right, 0)):
            a.append(value)
        self.left[at] = self._grow(v[x <= high], expected * (0.5 + spill), leaf, spill)
        self.right[at] = self._grow(v[x >= low], expected * (0.5 + spill), leaf, spill)
        return at

    def place(self, v: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """(rows, leaf) for every leaf that gets rows."""
        out, todo = [], [(self.root, np.arange(len(v)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                out.append((rows, -node))
                continue
            x = v[rows] @ self.direction[node]
            todo += [(self.left[node], rows[x <= self.high[node]]), (self.right[node], rows[x >= self.low[node]])]
        return out


def unit(raw: list[bytes], dim: int) -> np.ndarray:
    """Vectors of ``dim`` numbers, stored as they came (floats or doubles), as unit vectors in double precision."""
    v = np.frombuffer(b"".join(raw), dtype="<f4" if len(raw[0]) == 4 * dim else "<f8").reshape(len(raw), -1).astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def build_forest(sample: pd.DataFrame, sizes: dict, trees: int, leaf: int, spill: float, seed: int) -> dict:
    """Trees for each (label, length) of the sample."""
    forest = {}
    for k, (key, some) in enumerate(sorted(sample.groupby(["label", "dim"], sort=True), key=lambda x: str(x[0]))):
        v = unit(list(some["vector"]), key[1])
        forest[key] = [Tree(v, sizes.get(key, len(v)), leaf, spill, [seed, k, t]) for t in range(trees)]
    return forest


def _pack(rows: DataFrame) -> DataFrame:
    """Vectors as little-endian floats if they are floats, else as doubles."""
    kind = rows.schema["embedding"].dataType.elementType.simpleString()
    code, element = ("<f4", "float") if kind == "float" else ("<f8", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(code)
            raw = [flat[i:j].tobytes() for i, j in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(raw, pa.binary()), b.column(4)], names=["label", "dim", "rep", "vector", "copies"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("label", "dim", "rep", F.col("embedding").cast(f"array<{element}>").alias("embedding"), "copies").mapInArrow(
        run, f"label {kind}, dim int, rep bigint, vector binary, copies bigint"
    )


def link_table(reps: DataFrame, threshold: float, trees: int, leaf: int, spill: float, sample: int, block: int, seed: int) -> DataFrame:
    """For each representative with a link: ``id``, ``links`` (copies weighted) and ``root`` of its local component."""
    spark = reps.sparkSession
    packed = written(_pack(reps), "vectors")
    picked = packed.orderBy(F.xxhash64("rep"), "rep").limit(sample).toPandas()
    # Sizes of the groups that the sample holds: no more of them than vectors in it.
    seen = spark.createDataFrame(picked[["label", "dim"]].drop_duplicates(), packed.select("label", "dim").schema)
    counted = packed.join(F.broadcast(seen), ["label", "dim"]).groupBy("label", "dim").agg(F.count("*").alias("n")).collect() if len(picked) else []
    sizes = {(r["label"], r["dim"]): r["n"] for r in counted}
    forest = spark.sparkContext.broadcast(build_forest(picked, sizes, trees, leaf, spill, seed) if len(picked) else {})
    kind = packed.schema["label"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.to_pandas()
            out = []
            for key, some in d.groupby(["label", "dim"]):
                v = unit(list(some["vector"]), key[1])
                grown = forest.value.get(key)
                hits = [t.place(v) for t in grown] if grown else [[(np.arange(len(v)), 1)]] + [[] for _ in range(trees - 1)]
                codes: list[list[tuple[int, int]]] = [[] for _ in range(len(v))]
                for t, parts in enumerate(hits):
                    for rows, number in parts:
                        for i in rows.tolist():
                            codes[i].append((t, number))
                for i, (rep, vector, copies) in enumerate(zip(some["rep"], some["vector"], some["copies"])):
                    mine = sorted(codes[i])
                    raw = np.array([t << 24 | n for t, n in mine], dtype="<i8").tobytes()
                    out += [(*key, t << 24 | n, rep, vector, copies, raw) for t, n in mine]
            cols = list(zip(*out)) or [()] * 7
            kinds = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["label", "dim", "leaf", "rep", "vector", "copies", "codes"])

    placed = written(packed.mapInArrow(place, f"label {kind}, dim int, leaf bigint, rep bigint, vector binary, copies bigint, codes binary"), "leaves")
    keys = ["label", "dim", "leaf"]
    large = placed.groupBy(*keys).count().filter(F.col("count") > block).select(*keys, F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = (
        placed.join(large, keys, "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("own", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other"))
        .select(*keys, "a", "b", "own", "rep", "vector", "copies", "codes")
    )

    def compare(key, d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("rep")
        number, a, b = key[2], key[3], key[4]
        v, rep, copies = unit(list(d["vector"]), key[1]), d["rep"].to_numpy(), d["copies"].to_numpy()
        codes = [np.frombuffer(c, dtype="<i8") for c in d["codes"]]
        own = d["own"].to_numpy()
        width = max(map(len, codes))
        table = np.full((len(codes), width), -1, dtype=np.int64)
        for i, c in enumerate(codes):
            table[i, : len(c)] = c
        links, root = np.zeros(len(rep), dtype=np.int64), list(range(len(rep)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for k in range(0, len(rep), 512):
            i, j = np.nonzero(v[k : k + 512] @ v.T >= threshold)
            i = i + k
            keep = (i < j) & ((own[i] != own[j]) if a != b else True)
            i, j = i[keep], j[keep]
            for s in range(0, len(i), 20_000):
                x, y = i[s : s + 20_000], j[s : s + 20_000]
                first = np.full(len(x), np.iinfo(np.int64).max)
                for c in range(width):  # the first leaf that both have
                    code = table[x, c]
                    both = (code >= 0) & (table[y] == code[:, None]).any(axis=1)
                    first = np.where(both, np.minimum(first, code), first)
                here = first == number
                np.add.at(links, x[here], copies[y[here]])
                np.add.at(links, y[here], copies[x[here]])
                for p, q in zip(x[here].tolist(), y[here].tolist()):
                    p, q = find(p), find(q)
                    if p != q:
                        root[max(p, q)] = min(p, q)
        at = np.flatnonzero(links)
        return pd.DataFrame({"id": rep[at], "links": links[at], "root": rep[[find(x) for x in at.tolist()]] if len(at) else rep[at]})

    return dealt.groupBy(*keys, "a", "b").applyInPandas(compare, "id bigint, links bigint, root bigint")


def near_duplicates(
    vectors: DataFrame, threshold: float = LINK, trees: int = 10, leaf: int = 400, spill: float = 0.05,
    sample: int = 20_000, block: int = 2_000, seed: int = 11,
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row of (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label").filter("vec_id is not null")
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("label").isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0)
    keyed = rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("same", F.sha2(F.col("embedding").cast("string"), 256))
    valid = keyed.filter("good")
    reps = valid.groupBy("label", "same").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min("embedding").alias("embedding")
    ).withColumn("dim", F.size("embedding"))
    reps = written(reps, "reps")
    found = written(link_table(reps, threshold, trees, leaf, spill, sample, block, seed), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    per_rep = (
        reps.select("label", "same", "rep", "copies")
        .join(links, F.col("rep") == F.col("id"), "left").drop("id")
        .join(groups, F.col("rep") == F.col("id"), "left").drop("id")
        .select("label", "same", F.coalesce("component_id", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    return (
        keyed.select("vec_id", "same", F.when(F.col("good"), F.col("label")).alias("label"))
        .join(per_rep, ["label", "same"], "left")
        .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )
