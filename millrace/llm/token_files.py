"""Token-id files: Parquet list columns in ascending document order.

Layout below one path: ``tokens/`` holds one row for each document (``doc_id``, ``part``,
``row_start``, ``n_tokens``, ``ids`` and any metadata columns), range-partitioned and sorted
by ``doc_id`` so that row-group and page statistics select documents; ``parts/`` holds one
row for each file with the token offset at which it begins. Ids are dictionary-encoded
(a vocabulary fits one dictionary page), ``doc_id`` and ``row_start`` are delta-encoded.

Defined results: a null text is the empty text; every document gets the end id, so an empty
one is that id alone; null ids sort first; rows of one id are ordered by text; an empty table
gives empty files. Columns other than those named are not read.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .words import slices, sole

#: Chunks that a worker's memo keeps (under 150 MB), and their greatest length. A full memo forgets all but its first third.
MEMO_CHUNKS, MEMO_CHARS = 700_000, 64
#: A stop or comma behind a Latin letter that normalizers keep a single letter (not the dotted capital I), before a blank.
_STOP = r"([A-Za-z\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{012F}\x{0131}-\x{017F}])([.,])(\s|$)"
#: Parquet settings: 32 MB row groups, pages of at most 256 KB or 2,000 rows, page indexes.
FILE_OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#row_start": "false",
    "parquet.column.index.access": "true",
}


class ChunkEncoder:
    """The tokenizers library behind a memo of blank-separated chunks.

    Valid for tokenizers that drop white space and split at it (``chunkable``): the ids of
    a text are then the ids of its chunks in turn. Other tokenizers get whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self._lib = Tokenizer.from_file(path)
        self._lib.no_truncation()
        self._lib.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        self.chunkable = self._drops_blanks(spec)
        # Letters are lower-cased, mapped to themselves and merged: a word of ASCII letters may be lower-cased and merged alone.
        steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = [p.get("type") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.lowers = self.chunkable and steps == ["NFC", "Replace", "Lowercase"] and split == ["Split", "ByteLevel"] and spec["model"].get("type") == "BPE"
        self._memo: dict[str, bytes] = {}

    @staticmethod
    def _drops_blanks(spec: dict) -> bool:
        if any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] or "\n" in t["content"] for t in spec.get("added_tokens", [])):
            return False
        first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        pattern = (first.get("pattern") or {}).get("Regex", "")
        return first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def forget(self) -> None:
        self._memo = {}

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of different chunks: the library's merges for words of ASCII letters, which are one pre-token each, all of it for others."""
        memo, tokenize = self._memo, self._lib.model.tokenize
        if len(memo) + len(chunks) > MEMO_CHUNKS and len(memo) > MEMO_CHUNKS // 3:
            memo = self._memo = dict(islice(memo.items(), MEMO_CHUNKS // 3))  # the first, which are the common ones
        memo[""] = b""
        out: dict[str, bytes] = {}
        rest = []
        for c in chunks:
            if self.lowers and c.isascii() and c.isalpha():
                out[c] = array("i", [t.id for t in tokenize(c)]).tobytes()
            elif c:
                rest.append(c)
        for k in range(0, len(rest), 8000):
            part = rest[k : k + 8000]
            found = self._lib.encode("\n".join(part), add_special_tokens=False)
            raw = np.array(found.ids, dtype="<i4").tobytes()
            begins = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
            starts = np.cumsum([0, *map(len, part)]) + np.arange(len(part) + 1)
            at = (4 * np.searchsorted(begins, starts)).tolist()
            out.update((c, raw[i:j]) for c, i, j in zip(part, at, at[1:]))
        memo.update((c, ids) for c, ids in out.items() if len(c) <= MEMO_CHARS)
        out[""] = b""
        return list(map(out.__getitem__, chunks))

    def _chunk_ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of different chunks."""
        found = list(map(self._memo.get, chunks))
        if None in found:
            new = iter(self._learn([c for c, f in zip(chunks, found) if f is None]))
            found = [next(new) if f is None else f for f in found]
        return found

    def encode_array(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, with ``end`` behind each, and all ids (int32) in turn."""
        texts = pc.fill_null(texts, "")
        if not self.chunkable:
            found = self._lib.encode_batch(texts.to_pylist(), add_special_tokens=False)
            each = [np.array(e.ids, dtype="<i4").tobytes() + end for e in found]
            return np.array([len(x) // 4 for x in each], np.int64), np.frombuffer(b"".join(each), "<i4")
        if not len(texts):
            return np.empty(0, np.int64), np.empty(0, "<i4")
        # A stop or comma between such a letter and a blank is a pre-token of its own.
        texts = pc.replace_substring_regex(texts, _STOP, r"\1 \2\3")
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
        flat = lists.flatten()
        if self.lowers:
            flat = pc.if_else(pc.ascii_is_alpha(flat), pc.ascii_lower(flat), flat)
        coded = flat.dictionary_encode()
        raw = self._chunk_ids(coded.dictionary.to_pylist())
        order = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends, len(raw))
        taken = pa.array([*raw, end], pa.large_binary()).take(pa.array(order))
        at = np.frombuffer(taken.buffers()[1], np.int64)[: len(order) + 1]
        data = taken.buffers()[2]
        ids = np.frombuffer(data, "<i4", count=int(at[-1]) // 4) if data is not None and at[-1] else np.empty(0, "<i4")
        return np.diff(np.r_[0, at[ends + np.arange(1, len(ends) + 1)]]) // 4, ids

    def encode_batch(self, texts: Sequence[str | None], end: bytes = b"") -> list[bytes]:
        """Little-endian int32 ids of each text, followed by ``end``."""
        n, ids = self.encode_array(pa.array(texts, pa.string()), end)
        return [x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])] if len(n) else []


_LOADED: dict[str, ChunkEncoder] = {}


def load(path: str) -> ChunkEncoder:
    if path not in _LOADED:
        _LOADED[path] = ChunkEncoder(path)
    return _LOADED[path]


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    metadata: Sequence[str] = (),
) -> None:
    """Encode every text and write the files. One shuffle, of the texts by ranges of ids."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"meta_{c}") for c in metadata)
    )
    names = [f"meta_{c}" for c in metadata]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    end = np.array([end_id], dtype="<i4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(tokenizer_path)
        sole(encoder)
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in slices(batch, 1, 4 << 20):  # bounds what Python holds at once
                n, ids = encoder.encode_array(some.column(1), end)
                offsets = np.concatenate([[0], np.cumsum(n)])
                starts, at = at + offsets[:-1], at + int(offsets[-1])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(starts), pa.array(n), lists, *some.columns[2:]],
                    names=["doc_id", "part", "row_start", "n_tokens", "ids", *names],
                )

    schema = ", ".join(
        [f"doc_id {kinds['doc_id']}, part int, row_start bigint, n_tokens bigint, ids array<int>", *(f"`{n}` {kinds[n]}" for n in names)]
    )
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, schema).write.options(
        **FILE_OPTIONS
    ).parquet(f"{path}/tokens")
    parts = (
        spark.read.schema(schema).parquet(f"{path}/tokens")
        .groupBy("part")
        .agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    parts.withColumn("offset", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long"))).coalesce(1).write.parquet(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str, columns: Sequence[str] = ("doc_id", "start", "n_tokens", "ids")) -> DataFrame:
    """The named columns, ``start`` being the number of ids of all documents before a row.

    Only these columns are scanned, and filters on ``doc_id`` reach the page indexes. The
    table of parts has one row for each file; it is broadcast while that is under 200,000.
    """
    tokens = spark.read.parquet(f"{path}/tokens")
    if "start" in columns:
        parts = spark.read.parquet(f"{path}/parts")
        offsets = parts.select(F.col("part").alias("__part"), "offset")
        if parts.count() < 200_000:
            offsets = F.broadcast(offsets)
        tokens = tokens.join(offsets, F.col("part") == F.col("__part")).withColumn("start", F.col("offset") + F.col("row_start"))
    return tokens.select(*columns)


def crc32_of_ids(tokens: DataFrame) -> DataFrame:
    """Replace ``ids`` by ``ids_crc32``: crc32 of the ids as little-endian unsigned 32-bit integers."""
    kept = [c for c in tokens.columns if c != "ids"]
    rows = tokens.select(*kept, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(kept))
            at = lists.offsets.to_numpy()
            flat = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4")).tobytes())
            sums = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(at.tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(sums, pa.int64())], names=[*kept, "ids_crc32"])

    kinds = ", ".join(f"{c} {t}" for c, t in tokens.select(*kept).dtypes)
    return rows.mapInArrow(run, f"{kinds}, ids_crc32 bigint")
