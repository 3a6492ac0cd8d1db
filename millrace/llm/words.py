"""Words of Arrow text batches: hashes without Python strings, and memos that see each different word once."""

from __future__ import annotations

import ctypes
import gc
import weakref
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Different words that a worker's memo holds (under 100 MB). A full memo forgets all but the first of them, which
#: are the common ones; results do not depend on it.
MEMO_WORDS, MEMO_KEPT = 300_000, 60_000
#: Bytes of text, and rows, that Python works on at once.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 8000

_M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, text_at: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``size`` bytes of text and at most ``SLICE_ROWS`` rows, one row at least."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    k = 0
    while k < batch.num_rows:
        to = int(np.searchsorted(total, (total[k - 1] if k else 0) + size, "right"))
        to = min(max(k + 1, to), k + SLICE_ROWS)
        yield batch.slice(k, to - k)
        k = to


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array without nulls, and where each text begins and the last ends."""
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All white-space words of the texts, and where each text's begin and the last's end; nulls have none."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    at = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    filled = pc.greater(pc.binary_length(flat), 0)  # blanks at an end leave an empty string
    before = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
    return flat.filter(filled), before[at]


class Powers:
    """Powers of an odd base and of its inverse, modulo 2**64, as many as were asked for."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15):
        self.base = base
        self.up = self.down = np.ones(1, np.uint64)

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        out, k = np.ones(n, np.uint64), 1
        while k < n:
            m = min(k, n - k)
            out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
            k += m
        return out

    def reach(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 1 << 18)
            self.up, self.down = self._table(self.base, n), self._table(pow(self.base, -1, 1 << 64), n)

    def hashes(self, codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """64-bit hashes of the runs ``codes[a:b]`` (uint64, none of them 0), from one running sum."""
        n = len(codes)
        self.reach(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * self.up[:n], out=total[1:])
        return mix((total[b] - total[a]) * self.down[a] + (b - a).astype(np.uint64))


POWERS = Powers()


def release() -> None:
    """Give memory that is free in this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


_IN_USE: list[weakref.ref] = []


def sole(owner) -> None:
    """Let only ``owner`` keep a memo in this process: the one used before it forgets. Call it once a task."""
    last = _IN_USE[0]() if _IN_USE else None
    if last is owner:
        return
    _IN_USE[:] = [weakref.ref(owner)]
    if last is not None:
        last.forget()
    release()


class WordMemo:
    """Rows of numbers for words, learned at first sight."""

    def __init__(self, width: int, learn: Callable[[list[str]], np.ndarray]):
        self.width, self._learn = width, learn
        self.forget()

    def forget(self) -> None:
        self._row: dict[str, int] = {}
        self._table = np.zeros((1024, self.width))

    def __getstate__(self):
        return {"width": self.width, "_learn": self._learn}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def known(self, words: list[str]) -> np.ndarray:
        """The rows of different words."""
        found = list(map(self._row.get, words))
        if None in found:
            if len(self._row) + found.count(None) > MEMO_WORDS and len(self._row) > MEMO_KEPT:
                self._row = dict(islice(self._row.items(), MEMO_KEPT))
                found = list(map(self._row.get, words))
            new = [w for w, f in zip(words, found) if f is None]
            at = len(self._row)
            if at + len(new) > len(self._table):
                grown = np.zeros((at + len(new) + min(at + len(new), MEMO_WORDS), self.width))
                grown[:at] = self._table[:at]
                self._table = grown
            self._table[at : at + len(new)] = np.asarray(self._learn(new)).reshape(len(new), self.width)
            self._row.update(zip(new, range(at, at + len(new))))
            found = list(map(self._row.__getitem__, words))
        return self._table[found] if found else np.zeros((0, self.width))

    def rows(self, words: pa.Array) -> np.ndarray:
        """A row for each word of an array; Python sees each different one once."""
        if not len(words):
            return np.zeros((0, self.width))
        coded = words.dictionary_encode()
        return self.known(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
