"""Similarity of all pairs of bags, compared block by block.

Bags are packed into blocks of at most ``OWNERS`` owners, compressed by columns. Every two blocks meet in one
task, which adds up minima over the tokens both hold: tokens that most owners hold as whole rows of
a matrix, the others over the owners that hold them. No pair moves before its score is known, so what is shuffled is the
blocks, once for each block they meet. An owner's bag is held in one task.

Rows without owner are in no pair; rows without token or weight count for nothing but the owner's size.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cut import cut

#: Most owners of a block, and entries from which it is closed.
OWNERS, ENTRIES = 2048, 1_000_000
#: Owners of one block that are compared with a whole other block at once, and pairs of tasks.
ROWS, TASK_PAIRS = 32, 2_000_000
#: Co-occurrences of rare tokens that are added up at once.
SOME = 4_000_000


class Block(NamedTuple):
    """Owners in ascending order; entries (owner number, weight) by token, those of token ``i`` from ``starts[i]`` on."""

    owners: pa.Array
    size: np.ndarray
    tokens: pa.Array
    starts: np.ndarray
    owner: np.ndarray
    weight: np.ndarray


def packed(owner: pa.Array, token: pa.Array, weight: pa.Array) -> bytes:
    """A block of rows sorted by owner."""
    owner, token = owner.dictionary_encode(), token.dictionary_encode()
    o = owner.indices.to_numpy()
    w = weight.cast(pa.float64(), safe=False)
    size = np.bincount(o, weights=pc.fill_null(w, 0.0).to_numpy(), minlength=len(owner.dictionary))
    keep = pc.and_(pc.is_valid(token), pc.is_valid(w)).to_numpy(zero_copy_only=False)
    t = pc.fill_null(token.indices, 0).to_numpy()[keep]
    o, w = o[keep], pc.fill_null(w, 0.0).to_numpy()[keep]
    order = np.argsort(t, kind="stable")
    starts = np.r_[0, np.cumsum(np.bincount(t, minlength=len(token.dictionary)))]
    raw = pickle.dumps(Block(owner.dictionary, size, token.dictionary, starts, o[order].astype(np.uint16 if len(size) <= 1 << 16 else np.int32), w[order]))
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> Block:
    return pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True))


def _pack(batches: Iterator[pa.RecordBatch], most: int, entries: int) -> Iterator[pa.RecordBatch]:
    """(part, owner, token, weight), sorted by owner, to blocks (part, number in it, owners, blob)."""
    held, part, made = None, 0, 0

    def close(rows: pa.Table) -> pa.RecordBatch:
        columns = [rows.column(k).combine_chunks() for k in range(3)]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        m = len(pc.unique(columns[0]))
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([made], pa.int32()), pa.array([m], pa.int32()), pa.array([packed(*columns)], pa.binary())],
            names=["part", "k", "m", "blob"],
        )

    for batch in batches:
        part = batch.column(0)[0].as_py() if batch.num_rows else part
        more = pa.Table.from_batches([batch.select([1, 2, 3])])
        held = more if held is None else pa.concat_tables([held, more])
        while held.num_rows > 1:
            o = held.column(0)
            first = np.r_[0, 1 + np.flatnonzero(pc.not_equal(o.slice(1), o.slice(0, len(o) - 1)).to_numpy())]
            # The last owner's rows may go on in the next batch.
            at = first[most] if len(first) > most else first[-1] if held.num_rows >= entries and len(first) > 1 else 0
            if not at:
                break
            yield close(held.slice(0, at))
            made += 1
            held = held.slice(at)
    if held is not None and held.num_rows:
        yield close(held)


def _rare(x: Block, y: Block, pairs: np.ndarray, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of minima, and numbers, of the tokens (number in x, number in y) of ``pairs``."""
    total, times = np.zeros(shape[0] * shape[1]), np.zeros(shape[0] * shape[1], np.int64)
    if len(pairs):
        tx, ty = pairs.T
        n = x.starts[tx + 1] - x.starts[tx]
        mine = np.repeat(x.starts[tx] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())  # entries of x, token by token
        m = np.repeat(y.starts[ty + 1] - y.starts[ty], n)
        from_ = np.repeat(y.starts[ty], n)
        ends = np.cumsum(m)
        at = 0
        while at < len(mine):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SOME, "right")))
            k = m[at:to]
            theirs = np.repeat(from_[at:to] - np.r_[0, np.cumsum(k)[:-1]], k) + np.arange(k.sum())
            cell = np.repeat(x.owner[mine[at:to]].astype(np.int64) * shape[1], k) + y.owner[theirs]
            total += np.bincount(cell, weights=np.minimum(np.repeat(x.weight[mine[at:to]], k), y.weight[theirs]), minlength=len(total))
            times += np.bincount(cell, minlength=len(total))
            at = to
    return total.reshape(shape), times.reshape(shape)


def compare(x: Block, y: Block | None, at_least: float, best: int | None) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    """(a, b, shared, score) of the pairs between two blocks, or inside one (``y`` None), with a < b and a common token.

    With ``best``, only as many pairs, those first by descending score, a, b.
    """
    same = y is None
    y = x if same else y
    shape = (len(x.owners), len(y.owners))
    both = pc.index_in(x.tokens, y.tokens)
    tx = np.flatnonzero(both.is_valid())
    tokens = np.c_[tx, both.drop_null().to_numpy().astype(np.int64)]
    plain = all(len(b.weight) == 0 or b.weight.min() > 0 for b in (x, y))
    n = np.diff(x.starts)[tokens[:, 0]] * np.diff(y.starts)[tokens[:, 1]]
    common = (4 * n >= shape[0] * shape[1]) & plain
    whole = plain and all((b.weight == np.floor(b.weight)).all() for b in (x, y))
    largest = max(x.size.max(), y.size.max())
    kind = np.uint16 if whole and largest < 1 << 16 else np.float64
    mats = []
    for b, t in ((x, tokens[common, 0]), (y, tokens[common, 1])):
        mats.append(np.zeros((len(t), len(b.owners)), kind))
        for i, k in enumerate(t.tolist()):
            mats[-1][i, b.owner[b.starts[k] : b.starts[k + 1]]] = b.weight[b.starts[k] : b.starts[k + 1]]
    rare = None if common.all() and len(common) else _rare(x, y, tokens[~common], shape)
    # Owners of both blocks in their order; before[r]: how many of y come before the r-th of x.
    owners = x.owners if same else pa.concat_arrays([x.owners, y.owners])
    rank = np.empty(len(owners), np.int64)
    rank[pc.sort_indices(owners).to_numpy()] = np.arange(len(owners))
    before = np.arange(1, shape[0] + 1) if same else np.searchsorted(rank[shape[0] :], rank[: shape[0]])
    off = 0 if same else shape[0]
    held = None
    columns = np.arange(shape[1])
    low = np.empty((ROWS, shape[1]), kind)
    for r in range(0, shape[0], ROWS):
        rows = min(ROWS, shape[0] - r)
        acc, part = np.zeros((rows, shape[1]), kind), low[:rows]
        for a, b in zip(*mats):
            np.minimum(a[r : r + rows, None], b, out=part)
            acc += part
        shared = acc.astype(np.float64)
        if rare is not None:
            shared += rare[0][r : r + rows]
        seen = shared > 0 if plain else rare[1][r : r + rows] > 0
        if same:
            seen &= columns >= before[r : r + rows, None]
        union = x.size[r : r + rows, None] + y.size - shared
        seen &= union != 0
        with np.errstate(divide="ignore", invalid="ignore"):
            score = shared / union
        seen &= score >= at_least
        if held is not None and len(held[0]) == best:
            seen &= score >= held[3][-1]
        at = np.flatnonzero(seen)
        i, j = at // shape[1] + r, at % shape[1]
        turned = (j < before[i]) & (not same)
        a, b = np.where(turned, j + off, i), np.where(turned, i, j + off)
        found = (a, b, shared.ravel()[at], score.ravel()[at])
        if best is not None:
            found = found if held is None else tuple(np.concatenate(c) for c in zip(held, found))
            first = np.lexsort((rank[found[1]], rank[found[0]], -found[3]))[:best]
            held = tuple(c[first] for c in found)
        elif len(at):
            yield owners.take(pa.array(a)), owners.take(pa.array(b)), *found[2:]
    if held is not None and len(held[0]):
        yield owners.take(pa.array(held[0])), owners.take(pa.array(held[1])), *held[2:]


def _meet(batches: Iterator[pa.RecordBatch], at_least: float, best: int | None, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows (x, y, id, blob), those of two blocks that meet next to each other, to pairs."""
    first = None
    for batch in batches:
        for k in range(batch.num_rows):
            x, y, blob = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), unpacked(batch.column(3)[k].as_py())
            if x != y and first is None:
                first = blob
                continue
            one, other, first = (blob, None, None) if x == y else (first, blob, None)
            for a, b, shared, score in compare(one, other, at_least, best):
                yield pa.RecordBatch.from_arrays([a, b, pa.array(shared).cast(kind, safe=False), pa.array(score)], names=["a", "b", "shared", "score"])


def bag_pairs(bag: DataFrame, at_least: float = 0.0, best: int | None = None) -> DataFrame:
    """(a, b, shared, score) of the owners of ``bag`` (owner, token, weight; one row for each owner and token), a < b.

    With ``best``, a superset of the so many best pairs by score, a, b: those of each two blocks.
    """
    spark = bag.sparkSession
    whole = isinstance(bag.schema["weight"].dataType, T.IntegralType)
    owner = bag.schema["owner"].dataType.simpleString()
    rows = bag.filter("owner is not null").select("owner", "token", "weight").repartition("owner").sortWithinPartitions("owner")
    most, entries = OWNERS, ENTRIES
    blocks = rows.select(F.spark_partition_id().alias("part"), "owner", "token", F.col("weight").cast("double").alias("weight"))
    blocks = cut(blocks.mapInArrow(lambda it: _pack(it, most, entries), "part int, k int, m int, blob binary"))
    # One number for each block; their pairs are the work to do.
    ids = [(r["part"], r["k"], i, r["m"]) for i, r in enumerate(blocks.select("part", "k", "m").collect())]
    total, n = sum(i[-1] for i in ids), len(ids)
    named = blocks.join(F.broadcast(spark.createDataFrame([i[:3] for i in ids], "part int, k int, id int")), ["part", "k"]).select("id", "blob")
    each = named.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1)))))
    keyed = each.select(F.least("id", "other").alias("x"), F.greatest("id", "other").alias("y"), "id", "blob")
    tasks = max(1, min(n * (n + 1) // 2, total * total // 2 // TASK_PAIRS + 1))
    met = keyed.repartition(tasks, "x", "y").sortWithinPartitions("x", "y", "id")
    kind = pa.int64() if whole else pa.float64()
    return met.mapInArrow(lambda it: _meet(it, at_least, best, kind), f"a {owner}, b {owner}, shared {'bigint' if whole else 'double'}, score double")
