"""Document fingerprints by Order MinHash.

Every k-mer of a text is numbered by its occurrence, the pair is hashed, and each of ``m``
slots selects the ``ell`` smallest of its pairs; these are put back into text order and their
k-mers hashed as a tuple. Two texts agree in a slot only when they share the same k-mers in the
same order, so the share of equal slots follows edit distance rather than set overlap.

One 64-bit hash deals the pairs to slots (one-permutation scheme), so a text costs one pass
whatever ``m`` is. Slot ``j`` ranks pairs by the hash of (k-mer, occurrence) xor-mixed within
the slot; a slot with fewer than ``ell`` pairs borrows whole rotated neighbours, as one-permutation
hashing does, in an order fixed by the slot alone.

Defined results: null is the empty text; a text shorter than k is one k-mer of its own length;
the empty text's slots all hold one fixed value, so it is like itself only. Texts are taken as
Unicode code points, whole. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, ELL, SLOTS = 8, 2, 32
#: Ranges of ids when documents are compared with the next one.
MOST_RANGES = 20_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: a bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def kmer_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """A 64-bit hash of each window of ``k`` code points: a polynomial by doubling windows, then mixed."""
    n = len(points)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    k = min(k, n)
    with np.errstate(over="ignore"):
        h, width, out, done, factor = points.astype(np.uint64), 1, None, 0, int(_M1)
        while True:
            if k & width:
                piece = h[done : done + n - k + 1]
                out = piece if out is None else out * np.uint64(factor) + piece
                done += width
            if width * 2 > k:
                break
            h = h[: len(h) - width] * np.uint64(factor) + h[width:]
            width, factor = width * 2, factor * factor % 2**64
        return mix(out + np.uint64(k) * _M2)


#: Bits of a packed k-mer that hold its position; longer texts are sorted by two keys.
POSITION_BITS = 22


def numbered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """K-mer value (42 bits), position and occurrence number, sorted by value, then position."""
    n, bits = len(h), np.uint64(POSITION_BITS)
    if n < 1 << POSITION_BITS:
        packed = np.sort((h >> bits << bits) | np.arange(n, dtype=np.uint64))
        value = packed >> bits
        position = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    else:
        value = h >> bits
        position = np.argsort(value, kind="stable")
        value = value[position]
    at = np.arange(n)
    first = np.zeros(n, dtype=np.int64)
    np.multiply(at[1:], value[1:] != value[:-1], out=first[1:])
    return value, position, at - np.maximum.accumulate(first)


def sketch(text: str | None, k: int = K, ell: int = ELL, slots: int = SLOTS) -> np.ndarray:
    """``slots`` 32-bit values; slot-wise equality estimates likeness.

    A first occurrence ranks by its k-mer's own hash, a later one by a hash of k-mer and number.
    """
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    h = kmer_hashes(points, k)
    n = len(h)
    if n == 0:
        return np.zeros(slots, dtype=np.uint32)
    with np.errstate(over="ignore"):
        value, position, occurrence = numbered(h)
        pair = value
        again = np.flatnonzero(occurrence)
        if len(again):
            pair = value.copy()
            pair[again] = mix(value[again] ^ mix(occurrence[again].astype(np.uint64) * _M1)) >> np.uint64(POSITION_BITS)
        # Only the smallest can be selected; the cut is raised until every slot has ell, so nothing is lost.
        share = 4 * ell * slots
        while True:
            some = np.flatnonzero(pair < np.uint64(int(2.0 ** (64 - POSITION_BITS) * share / n))) if n > 2 * share else np.arange(n)
            slot = (pair[some] % np.uint64(slots)).astype(np.int64)
            if len(some) == n or np.bincount(slot, minlength=slots).min() >= ell:
                break
            share *= 2
        some = some[np.lexsort((pair[some], slot))]
        slot.sort()
        starts = np.searchsorted(slot, np.arange(slots + 1))
        counts = np.diff(starts)
        taken = np.minimum(starts[:-1, None] + np.arange(ell), len(some) - 1)
        poor = np.flatnonzero(counts < ell)
        chosen = some[taken]
        where = position[chosen].argsort(axis=1)
        chosen = np.take_along_axis(chosen, where, axis=1)
        out = np.arange(1, slots + 1, dtype=np.uint64)
        for c in range(ell):
            out = mix(out * _M1 + value[chosen[:, c]])
        for j in poor:  # few pairs: whole neighbours are borrowed in turn
            mine = some[starts[j] : starts[j + 1]]
            for step in range(1, slots):
                if len(mine) >= ell:
                    break
                o = (j + step) % slots
                mine = np.concatenate([mine, some[starts[o] : min(starts[o + 1], starts[o] + ell - len(mine))]])
            mine = mine[position[mine].argsort()]
            v = np.array([j + 1], dtype=np.uint64)
            for x in value[mine]:
                v = mix(v * _M1 + x)
            out[j] = v[0]
    return np.maximum((out >> np.uint64(32)).astype(np.uint32), np.uint32(1))


def as_text(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal slots, 0 to 1."""
    return float((a == b).mean())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_chars`` and ``fingerprint`` (hex, 8 digits a slot) of every row; no shuffle."""
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([as_text(sketch(t)) for t in texts], pa.string())],
                names=["doc_id", "n_chars", "fingerprint"],
            )

    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_chars bigint, fingerprint string")


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first code points of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame, rows_per_range: int = 4000) -> DataFrame:
    """Fingerprints of each text, of its edited text, and likenesses to that and to the next text.

    The next document is the one that follows in descending ``doc_id`` (ties by text), the
    first one for the last. Ids are cut into ranges of about ``rows_per_range`` rows; each range
    also gets the first document of the range below it, so one shuffle of the texts suffices.
    Only one id for each range is kept on the driver; beyond ``MOST_RANGES`` ranges grow instead. Null ids sort last.
    """
    spark = docs.sparkSession
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double"
    )
    total = d.count()
    if not total:
        return spark.createDataFrame([], schema)
    n = min(MOST_RANGES, max(1, -(-total // rows_per_range)))
    low = -(2**63)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(low))
    cuts = d.select(key.cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    cuts = sorted({int(c) for c in cuts})
    # A range's number is the count of cuts at or below its ids: a broadcast of n sorted numbers.
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    d = d.withColumn("range", F.size(F.filter(bounds, lambda c: c <= key)) if len(cuts) <= 64 else _range_of(spark, key, cuts))
    firsts = d.groupBy("range").agg(F.max(key).alias("top"), F.count("*").alias("rows")).collect()
    firsts.sort(key=lambda r: -r["range"])
    tops = [(int(r["top"]), int(firsts[i - 1]["range"])) for i, r in enumerate(firsts)]
    heads = spark.createDataFrame(tops, "top long, to int")
    head_texts = (
        d.join(F.broadcast(heads), key == F.col("top"))
        .groupBy("top", "to").agg(F.min("text").alias("text"))
        .select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("to").alias("range"), F.lit(1).alias("last"))
    )
    rows = d.withColumn("last", F.lit(0)).union(head_texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def result(a, b):
            e = edited(a[1], b[1])
            s = sketch(e)
            return (
                a[0], len(a[1]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), as_text(a[2]), as_text(s),
                likeness(a[2], s), likeness(a[2], b[2]),
            )

        for batch in batches:
            out = []
            for doc_id, text, rng, last in zip(*(c.to_pylist() for c in batch.columns)):
                now = (doc_id, text, sketch(text), rng, last)
                if held is not None and held[3] == rng and not held[4]:
                    out.append(result(held, now))
                held = now
            cols = list(zip(*out)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds)],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return (
        rows.repartitionById(len(cuts) + 1, "range")
        .sortWithinPartitions("range", "last", F.col("doc_id").desc_nulls_last(), "text")
        .mapInArrow(run, schema)
    )


def _range_of(spark, key, cuts: list[int]):
    """Number of cuts at or below the key, by bisection over a literal array."""
    array = F.array(*[F.lit(c).cast("long") for c in cuts])
    steps = len(cuts).bit_length()
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def step(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        up = F.coalesce(F.get(array, mid) <= key, F.lit(False)) & (acc["lo"] < acc["hi"])
        return F.struct(
            F.when(up, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(up, acc["hi"]).otherwise(F.least(mid, acc["hi"])).alias("hi")
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps + 1)), start, step)["lo"]
