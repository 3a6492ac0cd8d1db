"""BPE encoding and decoding with forced-boundary splitting.

A byte-level BPE never merges across a pair of neighbouring bytes that occurs inside no
vocabulary token: every intermediate merge result is itself a token, so the pair can never
become interior to one. Such pairs are certain cuts. A text is split into the tokenizer's
pre-tokens, each pre-token is cut at its certain cuts, the fragments are encoded on their
own and the ids are concatenated.

Defined results: a null text is the empty text, which has no ids; a special token's string
in a text is one id, as the library does by default; decoding gives the bytes of the ids as
UTF-8, ill-formed parts as U+FFFD. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import warnings
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import MEMO_KEPT, MEMO_WORDS, slices, sole

#: GPT-2 style pre-token pattern of byte-level BPE files (fixed value).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of every byte in a byte-level vocabulary file."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (b for b in range(256) if b not in shown)
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + k) for k, b in enumerate(hidden)}}


class ForcedBoundaryBPE:
    """Encoder and decoder for one byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._expect(spec)
        as_byte = {c: b for b, c in byte_alphabet().items()}
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.token_bytes: list[bytes] = [b""] * size
        inside = bytearray(65536)
        for token, i in vocab.items():
            if token not in self.special:
                raw = self.token_bytes[i] = bytes(as_byte[c] for c in token)
                for a, b in zip(raw, raw[1:]):
                    inside[a << 8 | b] = 1
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.joinable = bytes(inside)
        self.byte_ids = [vocab[c] for _, c in sorted((b, c) for c, b in as_byte.items())]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self._single = self._rank_core(path)
        self.id_text = [str(i) for i in range(size)]
        self.marks = np.array(sorted(self.special.values()), dtype=np.int32)
        self._split_special = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
            if self.special
            else None
        )
        self._pre = regex.compile(PRE_TOKEN)
        self._gap = re.compile(r"\s\s|^\s|\s\Z")
        self.forget()

    @staticmethod
    def _expect(spec: dict) -> None:
        """Other files would give other ids: byte-level pre-tokens by the pattern above, plain merges, no normalizer."""
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer") or odd or model.get("type", "BPE") != "BPE":
            raise ValueError(f"not a byte-level BPE file that this encoder can follow: pre-tokenizer {pre}, normalizer {spec.get('normalizer')}, {odd}")

    def forget(self) -> None:
        """Empty the memos of fragments and chunks; results do not depend on them."""
        self._fragments: dict[bytes, bytes] = {}
        self._spaced: dict[str, bytes] = {}

    def _rank_core(self, path: str):
        """A compiled merger of single fragments, where ids stand in the order of the merges."""
        made = [new for _, new in self.merges.values()]
        if made != sorted(set(made)) or (made and made[0] < max(self.byte_ids)):
            return self.merge
        import tiktoken

        ranks = {self.token_bytes[i]: i for i in [*self.byte_ids, *made]}
        core = tiktoken.Encoding(path, pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        if not hasattr(core, "_encode_single_piece"):
            warnings.warn("this tiktoken has no merger of single pieces; fragments are merged in Python, which is slower")
            return self.merge
        return core._encode_single_piece

    def fragments(self, raw: bytes) -> list[bytes]:
        """``raw`` cut at every pair of bytes that no token holds."""
        table, out, start = self.joinable, [], 0
        for k in range(1, len(raw)):
            if not table[raw[k - 1] << 8 | raw[k]]:
                out.append(raw[start:k])
                start = k
        out.append(raw[start:])
        return out

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one fragment: the pair of lowest rank is joined until none is left."""
        ids = [self.byte_ids[b] for b in raw]
        if len(ids) > 96:
            return self._merge_long(ids)
        ranks = self.merges
        while len(ids) > 1:
            best = min((ranks[p] for p in zip(ids, ids[1:]) if p in ranks), default=None)
            if best is None:
                break
            out, k, last = [], 0, len(ids) - 1
            while k <= last:
                if k < last and ranks.get((ids[k], ids[k + 1])) == best:
                    out.append(best[1])
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs, in n log n steps."""
        ranks, n = self.merges, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*ranks[p], k, p) for k, p in enumerate(zip(ids, ids[1:])) if p in ranks]
        heap = [(rank, k, new, p) for rank, new, k, p in heap]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, k, new, pair = heapq.heappop(heap)
            right = after[k]
            if not alive[k] or right >= n or (ids[k], ids[right]) != pair:
                continue
            ids[k], alive[right], after[k] = new, False, after[right]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < n:
                    p = (ids[left], ids[after[left]])
                    if p in ranks:
                        heapq.heappush(heap, (ranks[p][0], left, ranks[p][1], p))
        return [i for i, keep in zip(ids, alive) if keep]

    def _fragment_ids(self, raw: bytes) -> bytes:
        found = self._fragments.get(raw)
        if found is None:
            found = array("i", self._single(raw)).tobytes()
            if len(raw) <= 64:
                if len(self._fragments) >= MEMO_WORDS:
                    self._fragments = dict(islice(self._fragments.items(), MEMO_KEPT))
                self._fragments[raw] = found
        return found

    def _piece_ids(self, piece: str) -> bytes:
        cut = self.fragments(piece.encode("utf-8", "surrogatepass"))
        return self._fragment_ids(cut[0]) if len(cut) == 1 else b"".join(map(self._fragment_ids, cut))

    def _chunk_ids(self, chunk: str) -> bytes:
        return b"".join(map(self._piece_ids, self._pre.findall(chunk)))

    def _spaced_ids(self, chunk: str) -> bytes:
        found = self._chunk_ids(" " + chunk)
        if len(chunk) <= 64:
            if len(self._spaced) >= MEMO_WORDS:
                self._spaced = dict(islice(self._spaced.items(), MEMO_KEPT))
            self._spaced[chunk] = found
        return found

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if self._gap.search(text):
            # White space runs span chunks: pre-tokens are found in the whole text.
            return self._chunk_ids(text)
        # Every blank stands between two other characters and belongs to what follows it.
        first, *rest = text.split(" ")
        found = list(map(self._spaced.get, rest))
        if None in found:
            found = [self._spaced_ids(c) if f is None else f for f, c in zip(found, rest)]
        return self._chunk_ids(first) + b"".join(found)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text, as int32."""
        text = text or ""
        if self._split_special is not None and self._split_special.search(text):
            parts = [
                array("i", [self.special[p]]).tobytes() if p in self.special else self._plain(p)
                for p in self._split_special.split(text)
            ]
            return np.frombuffer(b"".join(parts), dtype="<i4")
        return np.frombuffer(self._plain(text), dtype="<i4")

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, special tokens included; ill-formed bytes become U+FFFD."""
        out, start = [], 0
        if len(self.marks):
            for k in np.flatnonzero(np.isin(ids, self.marks)).tolist():
                out += [self._run(ids[start:k]), self.token_bytes[ids[k]].decode()]
                start = k + 1
        return "".join(out) + self._run(ids[start:])

    def _run(self, ids: np.ndarray) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


_LOADED: dict[str, ForcedBoundaryBPE] = {}


def load(path: str) -> ForcedBoundaryBPE:
    """The tokenizer of a file, once for each worker."""
    if path not in _LOADED:
        _LOADED[path] = ForcedBoundaryBPE(path)
    return _LOADED[path]


def encode_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", digests_only: bool = False
) -> DataFrame:
    """Encode and decode every text; one row for each row of ``docs``.

    Returns ``doc_id`` (as given), ``ids`` (array<int>), ``decoded`` (string) and
    ``n_tokens``; with ``digests_only`` the two large columns are left out and
    ``ids_sha256`` and ``decoded_sha256`` are returned instead. Other columns of ``docs``
    are not read. No shuffle: each task streams its own batches.
    """
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = kept.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        sole(bpe)
        for batch in (some for whole in batches for some in slices(whole, 1)):
            n, digests, decoded, values = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = bpe.encode(text)
                n.append(len(ids))
                back = bpe.decode(ids)
                if digests_only:
                    listed = ",".join(map(bpe.id_text.__getitem__, ids.tolist()))
                    digests.append(hashlib.sha256(listed.encode()).hexdigest())
                    decoded.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                else:
                    values.append(ids)
                    decoded.append(back)
            counts = pa.array(n, pa.int64())
            if digests_only:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), counts, pa.array(digests, pa.string()), pa.array(decoded, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
            else:
                at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                flat = np.concatenate([*values, np.empty(0, np.int32)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), counts, lists, pa.array(decoded, pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    if digests_only:
        return kept.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return kept.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids array<int>, decoded string")
