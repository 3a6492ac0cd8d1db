"""N-gram Jaccard join by set-relation skipping.

A document's set is its distinct word shingles, as 64-bit hashes. All sets are put in one global order:
tokens that few sets hold first (by hash), then frequent ones by how many sets hold them. A set's first
tokens in that order (its prefix: the tokens that a linked set may lack, one more, and a twentieth)
go to inverted lists. Two sets that link share tokens there, and the lists are skipped twice:

* by position (index level). Of a token that two linked sets share, the tokens before and after it
  must be about as many in both: ``|i - j| + |(n - i) - (m - j)| <= symmetric difference allowed``. A list is
  ordered by position, and from the first entry out of reach on the rest of it is skipped as a block. What is
  left is counted: a pair goes on only if it shares as many prefix tokens as a linked pair must.
* lists of frequent tokens. A list longer than ``LONG`` gives no pairs. Its tokens are only counted for each set, and a pair
  needs that many fewer shared tokens of short lists. Sets of so many such tokens that a link could rest on
  them alone (near copies in large families, texts of common passages) are chained along those lists, by size.
* by answers (set level). Pairs that go on make components; inside a component a set's intersections with all
  others are derived from those of the set before it, a highly similar one, by taking away the lists of
  the tokens it lacks and adding those of its new ones. Sets that are already in one class are not compared again
  in a large component.

A token that many sets of one batch hold is known to be frequent there, and chains are made in the batch before they are
made in the token's task, so that no task gets all sets of a hot token. No link is lost; links come only from whole sets.

What moves: 8 bytes for each prefix token, the texts once (to fetch those of the sets in components),
and the sets of components, 8 bytes a token. Equal sets of a batch move once.

Defined results: nulls, empty texts and texts without words have the empty set and link with
nothing; a text of fewer words than a shingle is one shingle; equal sets link; repeated ids are
rows of one class each; a null id is no smallest id: the class has the smallest other id, or null.
Columns other than id and text are not read. Sets are told apart by 63 bits of a digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, drop_written, written
from .words import POWERS, buffer_of, mix, slices

#: Tokens that a worker holds at once, and most sets among them.
BATCH_TOKENS, BATCH_SETS = 1_000_000, 40_000
#: Bytes of text hashed at once; longer texts are hashed in pieces that end at a blank.
PIECE = 1 << 18
#: Most tokens whose frequency is broadcast (16 bytes each): a token counts as frequent when more than the
#: ``FREQUENT``-th part of all tokens, and at least 32, sets hold it, so there are no more of them. Counted are
#: those that ``SHARED`` sets of one batch hold; which ones are found changes the order, not the links.
FREQUENT, SHARED = 500_000, 2
#: Lists of more entries give no pairs; tokens that more sets of one batch hold are not even sent to their list.
LONG, RUN = 16, 16
#: Sets that share so many tokens of one bucket are joined there by a tree of links instead of all their pairs.
STRONG = 3
#: Two linked sets share at least ``n // SPARE`` tokens of their prefixes, and one at least.
SPARE = 20
#: Prefix entries of a list task, and tokens of a block of sets that is compared in one task.
LIST_ENTRIES, BLOCK_TOKENS = 1_000_000, 1_000_000


class Limits(NamedTuple):
    """The limits that tasks need, as they stand on the driver."""

    batch_tokens: int
    batch_sets: int
    piece: int
    shared: int
    long: int
    run: int
    strong: int

    @classmethod
    def now(cls) -> Limits:
        return cls(BATCH_TOKENS, BATCH_SETS, PIECE, SHARED, LONG, RUN, STRONG)



_B = 0x9E3779B97F4A7C15
_BLANK = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[ord("A") : ord("Z") + 1] += np.uint64(32)


def _word_hashes(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of ``data``; a border also ends a word."""
    letter = ~_BLANK[data]
    start, end = letter.copy(), letter.copy()
    start[1:] &= ~letter[:-1]
    end[:-1] &= ~letter[1:]
    inner = borders[(borders > 0) & (borders < len(data))]
    start[inner] |= letter[inner]
    end[inner - 1] |= letter[inner - 1]
    a = np.flatnonzero(start)
    return POWERS.hashes(_LOWER[data], a, np.flatnonzero(end) + 1), a


def _long_text(data: np.ndarray, piece: int) -> np.ndarray:
    """Hashes of the words of one text of any length."""
    out, at = [np.empty(0, np.uint64)], 0
    while at < len(data):
        to = min(len(data), at + piece)
        while to < len(data):  # back to a blank, or on to one if a word is longer than a piece
            blanks = np.flatnonzero(_BLANK[data[at:to]])
            if len(blanks):
                to = at + int(blanks[-1]) + 1
                break
            to = min(len(data), to + piece)
        out.append(_word_hashes(data[at:to], np.empty(0, np.int64))[0])
        at = to
    return np.concatenate(out)


def _rolled(h: np.ndarray, words: int) -> np.ndarray:
    """Hashes of all runs of ``words`` neighbours."""
    out = h[: max(0, len(h) - words + 1)].copy()
    for j in range(1, words):
        out = out * np.uint64(_B) + h[j : len(h) - words + 1 + j]
    return mix(out + np.uint64(0xBF58476D1CE4E5B9) * np.array([words], np.uint64))


def shingle_sets(texts: pa.Array, words: int = 5, piece: int = PIECE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text (A-Z lower-cased, words split at ASCII blanks)."""
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return []
    data, offsets = buffer_of(texts)
    out: list[np.ndarray] = []
    k = 0
    while k < len(texts):
        to = max(k + 1, int(np.searchsorted(offsets, offsets[k] + piece, "right")) - 1)
        part, borders = data[offsets[k] : offsets[to]], offsets[k : to + 1] - offsets[k]
        if to == k + 1 and len(part) > piece:
            h = _long_text(part, piece)
            edges = np.array([0, len(h)])
        else:
            h, a = _word_hashes(part, borders)
            edges = np.searchsorted(a, borders)
        rolled = _rolled(h, words)
        for x, y in zip(edges.tolist(), edges[1:].tolist()):
            if y - x >= words:
                out.append(np.unique(rolled[x : y - words + 1]))
            else:
                out.append(_rolled(h[x:y], y - x) if y > x else np.empty(0, np.uint64))
        k = to
    return out


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    return shingle_sets(pa.array([text], pa.string()), words)[0]


def set_id(s: np.ndarray) -> int | None:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest()) >> 1 if len(s) else None


def prefix(n, num: int, den: int):
    """Tokens of a set of ``n`` that go to the lists: as many as a linked set may lack, one more, and ``n // SPARE``."""
    return np.minimum(n, n - -(-num * n // den) + 1 + n // SPARE)


def _batches(batches: Iterator[pa.RecordBatch], words: int, lim: Limits) -> Iterator[dict[int, np.ndarray]]:
    """Different sets by their ids, as many as a worker holds at once."""
    held, total = {}, 0
    for batch in batches:
        for some in slices(batch, 0):
            for s in shingle_sets(some.column(0), words, lim.piece):
                i = set_id(s)
                if i is not None and i not in held:
                    held[i] = s
                    total += len(s)
            if total >= lim.batch_tokens or len(held) >= lim.batch_sets:
                yield held
                held, total = {}, 0
    if held:
        yield held


_DESCRIBED = "doc_id bigint, text_id bigint, n int, sid bigint, t array<bigint>, c array<int>"


def _describe(batches: Iterator[pa.RecordBatch], words: int, lim: Limits) -> Iterator[pa.RecordBatch]:
    """A row for each document, and for each lot of sets the tokens that several of them hold."""

    def counted(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        t, n = np.unique(np.concatenate(list(held.values())), return_counts=True)
        t, n = t[n >= lim.shared].view(np.int64), n[n >= lim.shared].astype(np.int32)
        none = pa.nulls(1, pa.int64())
        return pa.RecordBatch.from_arrays(
            [none, none, pa.nulls(1, pa.int32()), none, pa.array([t], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int32()))],
            names=["doc_id", "text_id", "n", "sid", "t", "c"],
        )

    held, total = {}, 0
    for batch in batches:
        for some in slices(batch, 2):
            sets = shingle_sets(some.column(2), words, lim.piece)
            ids = [set_id(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    some.column(0), some.column(1), pa.array([len(s) for s in sets], pa.int32()), pa.array(ids, pa.int64()),
                    pa.nulls(len(ids), pa.list_(pa.int64())), pa.nulls(len(ids), pa.list_(pa.int32())),
                ],
                names=["doc_id", "text_id", "n", "sid", "t", "c"],
            )
            for i, s in zip(ids, sets):
                if i is not None and i not in held:
                    held[i] = s
                    total += len(s)
            if total >= lim.batch_tokens:
                yield counted(held)
                held, total = {}, 0
    if held:
        yield counted(held)


_HEAD = np.dtype([("sid", "<i8"), ("n", "<i4")])
_ENTRY = np.dtype([("t", "<u4"), ("s", "<u2"), ("p", "<u2")])
#: Position of an entry that only says that the token is frequent, and of one too far behind to be told.
_IS_MARK, _FAR = 65535, 65534
_POSTED = "bucket int, head binary, entries binary, t array<bigint>, sid array<bigint>, n array<int>"


def _post(batches: Iterator[pa.RecordBatch], words: int, num: int, den: int, buckets: int, lim: Limits, hot: np.ndarray, df: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Prefix entries for the list buckets; those of tokens that are frequent in their lot go on as (t, sid, n)."""
    for held in _batches(batches, words, lim):
        sid = np.array(list(held), np.int64)
        n = np.array([len(s) for s in held.values()], np.int64)
        k = prefix(n, num, den)
        flat = np.concatenate(list(held.values()))
        owner = np.repeat(np.arange(len(n)), n)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, flat), len(hot) - 1)
            weight = np.where(hot[at] == flat, df[at], 0)
            if weight.any():
                flat = flat[np.lexsort((weight, owner))]  # stable: tokens of equal weight keep the order of the hash
        held.clear()
        position = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        keep = position < k[owner]
        t, o, p = flat[keep], owner[keep], np.minimum(position[keep], _FAR)
        del flat, owner, position, keep
        order = np.argsort(t, kind="stable")
        t, o, p = t[order], o[order], p[order]
        bucket = ((t >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        low = (t & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        length = np.diff(np.r_[first, len(t)])
        often = np.repeat(length > lim.run, length)
        out = []
        if often.any():
            out.append((int(sid[0] % buckets), None, None, bucket[often] << 32 | low[often], sid[o[often]], n[o[often]].astype(np.int32)))
            mark = first[length > lim.run]
            p[mark] = _IS_MARK
            often[mark] = False
            bucket, low, o, p = bucket[~often], low[~often], o[~often], p[~often]
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for g in np.flatnonzero(np.diff(edges)).tolist():
            rows = order[edges[g] : edges[g + 1]]
            used, inverse = np.unique(o[rows], return_inverse=True)
            head, e = np.empty(len(used), _HEAD), np.empty(len(rows), _ENTRY)
            head["sid"], head["n"] = sid[used], n[used]
            e["t"], e["s"], e["p"] = low[rows], inverse, p[rows]
            out.append((g, head.tobytes(), e.tobytes(), None, None, None))
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=["bucket", "head", "entries", "t", "sid", "n"])


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest connected index of every one of ``n`` nodes."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return np.array([find(x) for x in range(n)], dtype=np.int64)


def list_pairs(t: np.ndarray, s: np.ndarray, p: np.ndarray, n: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, shared prefix tokens) of sets that share a list, without those out of reach by position.

    Entries (token, set, position) of short lists; ``n`` are the sizes of sets. Lists are ordered by position,
    and an entry stops at the first one that no set of the list's largest size could reach.
    """
    order = np.lexsort((p, t))
    t, s, p = t[order], s[order].astype(np.int64), p[order].astype(np.int64)
    first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.empty(0, np.int64)
    length = np.diff(np.r_[first, len(t)])
    blind = np.maximum.reduceat(p, first) >= _FAR if len(t) else np.empty(0, bool)
    p = np.where(np.repeat(blind, length), 0, p)
    largest = np.repeat(np.maximum.reduceat(n[s], first), length) if len(t) else p
    end = np.repeat(first + length, length)
    x, m, k = np.arange(len(t)), len(n), 0
    pair, count, found, waiting = np.empty(0, np.int64), np.empty(0, np.int64), [], 0
    while len(x):
        k += 1
        x = x[x + k < end[x]]
        gap = p[x + k] - p[x]
        reach = (den + num) * gap <= (den - num) * (n[s[x]] + largest[x])
        x, gap = x[reach], gap[reach]  # the rest of these lists is skipped as a block
        a, b = s[x], s[x + k]
        apart = gap + np.abs((n[a] - p[x]) - (n[b] - p[x + k]))
        ok = (den + num) * apart <= (den - num) * (n[a] + n[b])
        found.append(np.minimum(a, b)[ok] * m + np.maximum(a, b)[ok])
        waiting += len(found[-1])
        if waiting > 4_000_000 or not len(x):
            some, times = np.unique(np.concatenate(found), return_counts=True)
            pair, at = np.unique(np.r_[pair, some], return_inverse=True)
            count = np.bincount(at, weights=np.r_[count, times], minlength=len(pair)).astype(np.int64)
            found, waiting = [], 0
    return pair // m, pair % m, count


def _lists(batches: Iterator[pa.RecordBatch], num: int, den: int, lim: Limits) -> Iterator[pa.RecordBatch]:
    """Buckets of lists to pairs (a, b, sizes, shared tokens), and long lists to entries (token, set, size, null, null).

    Sets that share many tokens of the bucket make trees: their links (a, b, null, 0, null) stand for all pairs inside a tree,
    which its component will be compared for anyway, so that a group of copies gives as many rows as it has sets.
    """

    def rows(a, b, na, nb, shared) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(na, pa.int32()), pa.array(nb, pa.int32()), pa.array(shared, pa.int64())],
            names=["a", "b", "na", "nb", "shared"],
        )

    def close(bucket: int, got: list[tuple]) -> Iterator[pa.RecordBatch]:
        heads, entries, base = [], [], 0
        for h, e in got:
            heads.append(np.frombuffer(h, _HEAD))
            e = np.frombuffer(e, _ENTRY)
            entries.append((e["t"], e["s"].astype(np.int64) + base, e["p"]))
            base += len(heads[-1])
        head = np.concatenate(heads)
        t, s, p = (np.concatenate(c) for c in zip(*entries))
        names, own = np.unique(head["sid"], return_inverse=True)
        n = np.zeros(len(names), np.int64)
        n[own] = head["n"]
        x = own[s]
        order = np.lexsort((p, x, t))
        t, p, x = t[order], p[order], x[order]
        mark = p == _IS_MARK
        new = np.r_[True, (t[1:] != t[:-1]) | (x[1:] != x[:-1])] | mark  # a set that several lots sent counts once
        t, p, x, mark = t[new], p[new], x[new], mark[new]
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        length = np.diff(np.r_[first, len(t)])
        long = np.repeat((length > lim.long) | np.logical_or.reduceat(mark, first), length)
        short = ~long & np.repeat(length > 1, length)
        a, b, shared = list_pairs(t[short], x[short], p[short], n, num, den)
        much = shared >= lim.strong
        root = _forest(a[much], b[much], len(names))
        far = np.flatnonzero(root != np.arange(len(root)))
        yield rows(names[far], names[root[far]], pa.nulls(len(far), pa.int32()), np.zeros(len(far), np.int32), pa.nulls(len(far), pa.int64()))
        open_ = root[a] != root[b]
        a, b, shared = a[open_], b[open_], shared[open_]
        yield rows(names[a], names[b], n[a], n[b], shared)
        x, t = x[long & ~mark], t[long & ~mark].astype(np.int64)
        yield rows(bucket << 32 | t, names[x], n[x], pa.nulls(len(x), pa.int32()), pa.nulls(len(x), pa.int64()))

    held, now = [], None
    for batch in batches:  # sorted by bucket
        for bucket, head, entries, t, sid, n in zip(*(c.to_pylist() for c in batch.columns)):
            if head is None:  # what is known to be frequent goes through
                yield rows(t, sid, n, pa.nulls(len(t), pa.int32()), pa.nulls(len(t), pa.int64()))
                continue
            if held and bucket != now:
                yield from close(now, held)
                held = []
            now = bucket
            held.append((head, entries))
    if held:
        yield from close(now, held)


_RUN = np.dtype([("t", "<i8"), ("sid", "<i8"), ("lo", "<i4"), ("hi", "<i4")])


def _runs(batches: Iterator[pa.RecordBatch], num: int, den: int, most: int) -> Iterator[pa.RecordBatch]:
    """Entries (t, sid, n) of long lists to chains (t null, a, b) of a lot, and a run (t, first set, lo, hi) for each chain."""

    def close(rows: list[np.ndarray]) -> pa.RecordBatch:
        t, sid, n = (np.concatenate(c) for c in zip(*rows))
        order = np.lexsort((sid, n, t))
        t, sid, n = t[order], sid[order], n[order].astype(np.int64)
        linked = (t[1:] == t[:-1]) & (den * n[:-1] >= num * n[1:])
        start = np.flatnonzero(np.r_[True, ~linked])
        end = np.r_[start[1:], len(t)] - 1
        a, b = sid[:-1][linked], sid[1:][linked]
        names, both = np.unique(np.r_[a, b], return_inverse=True)
        root = _forest(both[: len(a)], both[len(a) :], len(names))
        far = np.flatnonzero(root != np.arange(len(root)))
        m = len(far)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.r_[np.zeros(m, np.int64), t[start]], mask=np.r_[np.ones(m, bool), np.zeros(len(start), bool)]),
                pa.array(np.r_[names[far], sid[start]]), pa.array(np.r_[names[root[far]], n[start]]), pa.array(np.r_[np.zeros(m, np.int64), n[end]]),
            ],
            names=["t", "a", "b", "hi"],
        )

    held, size = [], 0
    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
        size += batch.num_rows
        if size >= most:
            yield close(held)
            held, size = [], 0
    if size:
        yield close(held)


def _chain(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Runs (t, set, lo, hi), sorted by token and lo, to links (a, b) between runs within reach of each other."""
    token, before, most = None, 0, 0
    for batch in batches:
        out = []
        for t, sid, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
            if t == token and num * lo <= den * most:
                if sid != before:
                    out.append((sid, before))
                before, most = sid, max(most, hi)
            else:
                token, before, most = t, sid, hi
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])


def link_block(sizes: np.ndarray, tokens: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Smallest linked index of each set of a block, over all links among them."""
    m = len(sizes)
    known, flat = np.unique(np.concatenate(tokens), return_inverse=True)
    ends = np.cumsum([len(t) for t in tokens])
    flat = flat.astype(np.int32)
    mine = np.split(flat, ends[:-1])
    by = np.argsort(flat, kind="stable")
    lists = np.repeat(np.arange(m, dtype=np.int32), [len(t) for t in tokens])[by]
    starts = np.r_[0, np.cumsum(np.bincount(flat, minlength=len(known)))]
    del by

    def add(counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        if not len(ids):
            return counts
        return counts + np.bincount(np.concatenate([lists[starts[i] : starts[i + 1]] for i in ids.tolist()]), minlength=m)

    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    left = np.ones(m, dtype=bool)
    inside = np.zeros(len(known), dtype=bool)
    k, before, counts = 0, None, np.zeros(m, np.int64)
    for _ in range(m):
        left[k] = False
        if before is not None:
            inside[:] = False
            inside[mine[before]] = True
            new = mine[k][~inside[mine[k]]]
            inside[mine[k]] = False
            gone = mine[before][inside[mine[before]]]
        if before is not None and len(new) + len(gone) < len(mine[k]):
            counts = add(counts, new) - add(np.zeros(m, np.int64), gone)  # derived from the set before
        else:
            counts = add(np.zeros(m, np.int64), mine[k])
        hit = np.flatnonzero(counts * (num + den) >= num * (sizes[k] + sizes))
        hit = hit[hit != k]
        a.append(np.full(len(hit), k))
        b.append(hit)
        before = k
        rest = hit[left[hit]]
        # Next the unseen set that shares most with this one, else any other.
        k = int(rest[np.argmax(counts[rest])]) if len(rest) else int(np.argmax(left))
    a, b = np.concatenate(a), np.concatenate(b)
    return _forest(a[a < b], b[a < b], m)


def _compare(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, sid, n, tokens) of each block to (a, b): a set and the first set of its class there."""

    def close(rows: dict[int, tuple]) -> pa.RecordBatch:
        listed = sorted((n, i) for i, (n, _) in rows.items())
        sid = np.array([i for _, i in listed], np.int64)
        if len(listed) < 2:
            at, root = np.empty(0, np.int64), np.arange(len(sid))
        else:
            root = link_block(np.array([n for n, _ in listed], np.int64), [np.frombuffer(rows[i][1], "<u8") for _, i in listed], num, den)
            at = np.flatnonzero(root != np.arange(len(sid)))
        return pa.RecordBatch.from_arrays([pa.array(sid[at], pa.int64()), pa.array(sid[root[at]], pa.int64())], names=["a", "b"])

    held, now = {}, None
    for batch in batches:  # sorted by key
        for key, i, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
            if held and key != now:
                yield close(held)
                held = {}
            now = key
            held[i] = (n, raw)  # a repeated row comes more than once
    if held:
        yield close(held)


def _compared(keys: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) inside the blocks that ``keys`` (sid, key) name."""
    blocks = keys.join(sets.select("sid", "n", "tokens"), "sid").select("key", "sid", "n", "tokens")
    return blocks.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _compare(it, num, den), "a bigint, b bigint")


def _linked(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(id, component_id) of sets (sid, component, n, tokens) over their exact links.

    A small component is one block. A large one is compared in three rounds: its chunks each on their own; then
    the first sets of the chunks' classes with each other; then, all pairs inside its largest class being settled,
    the sets outside it with all. In the last two, sets are dealt to classes of size, a class spanning the
    ratio that still can link, and by hash to chunks of ``BLOCK_TOKENS``; chunks of one class or of neighbouring classes
    are paired, all others are out of reach.
    """
    lean = sets.select("sid", "component", "n", (F.octet_length("tokens") / 8).alias("w"))
    total = lean.groupBy("component").agg(F.sum("w").alias("all"), F.count("*").alias("m")).filter("m > 1")
    lean = written(lean.join(total, "component"), "sizes")
    small = lean.filter(F.col("all") <= BLOCK_TOKENS).select("sid", F.col("component").cast("string").alias("key"))
    large = lean.filter(F.col("all") > BLOCK_TOKENS)
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num))).cast("int")
    if large.isEmpty():
        return written(connected_components(_compared(small, sets, num, den)), "classes")
    chunk = F.pmod(F.xxhash64("sid"), F.ceil(F.col("all") / BLOCK_TOKENS).cast("int"))
    own = large.select("sid", F.concat_ws(":", "component", chunk).alias("key"))
    links = written(_compared(small.union(own), sets, num, den), "links")

    def across(some: DataFrame, others: DataFrame) -> DataFrame:
        """Keys of blocks in which every set of ``some`` meets every set of ``others`` that it can link with."""

        def dealt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
            rows = rows.withColumn("c", size_class)
            chunks = rows.groupBy("component", "c").agg(F.ceil(F.sum("w") / BLOCK_TOKENS).cast("int").alias("k"))
            return rows.join(chunks, ["component", "c"]).withColumn("i", F.pmod(F.xxhash64("sid"), F.col("k")).cast("int")), chunks

        def meet(rows: DataFrame, chunks: DataFrame, name) -> DataFrame:
            steps = rows.withColumn("d", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)))
            there = chunks.select("component", F.col("c").alias("d"), F.col("k").alias("other"))
            paired = steps.join(there, ["component", "d"]).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("other") - 1)))
            return paired.select("sid", name(F.col("component"), F.struct("c", "i"), F.struct("d", "j")).alias("key"))

        def named(component: Column, x: Column, y: Column) -> Column:
            return F.concat_ws(":", component, x[x_names[0]], x[x_names[1]], y[y_names[0]], y[y_names[1]])

        x_names, y_names = ("c", "i"), ("d", "j")
        mine, my_chunks = dealt(some)
        theirs, their_chunks = dealt(others)
        left = meet(mine, their_chunks, named)
        right = meet(theirs, my_chunks, lambda component, x, y: F.concat_ws(":", component, y["d"], y["j"], x["c"], x["i"]))
        return left.union(right).distinct()

    def classes(edges: DataFrame) -> DataFrame:
        found = connected_components(edges)
        return written(large.join(found, F.col("sid") == F.col("id"), "left").withColumn("family", F.coalesce("component_id", "sid")), "classes").drop("id", "component_id")

    now = classes(links)
    # A first set is no later one of its chunk's class.
    firsts = now.select(*large.columns).join(links.select(F.col("a").alias("sid")).distinct(), "sid", "left_anti")
    links = written(links.union(_compared(across(firsts, firsts), sets, num, den)), "links")
    now = classes(links)
    held = now.groupBy("component", "family").agg(F.count("*").alias("members"))
    most = held.groupBy("component").agg(F.max(F.struct("members", "family")).alias("most")).select("component", F.col("most.family").alias("largest"))
    outside = now.join(most, "component").filter("family <> largest").select(*large.columns)
    if not outside.isEmpty():
        links = links.union(_compared(across(outside, large), sets, num, den))
    return written(connected_components(links), "classes")


def _frequent(described: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    least = max(32, total // FREQUENT)
    each = described.filter("t is not null").select(F.explode(F.arrays_zip("t", "c")).alias("x")).select("x.t", "x.c")
    hot = each.groupBy("t").agg(F.sum("c").alias("df")).filter(F.col("df") > least).toArrow()  # no objects for rows
    t, df = (hot.column(k).to_numpy().astype(np.int64) for k in ("t", "df"))
    t = t.view(np.uint64)
    order = np.argsort(t)
    return t[order], df[order]


def _candidates(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], total: int, words: int, num: int, den: int) -> DataFrame:
    """(id, component_id) of the sets that counted pairs and chains connect."""
    spark = docs.sparkSession
    buckets = max(4, int(total * (1 - num / den + 0.05)) // LIST_ENTRIES + 1)
    frequent, lim = spark.sparkContext.broadcast(hot), Limits.now()
    posted = docs.select("text").mapInArrow(lambda it: _post(it, words, num, den, buckets, lim, *frequent.value), _POSTED)
    lists = posted.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    pairs = written(lists.mapInArrow(lambda it: _lists(it, num, den, lim), "a bigint, b bigint, na int, nb int, shared bigint"), "pairs")

    # How many tokens of long lists a set's prefix has, and the sets whose links could rest on them alone.
    trees = pairs.filter("na is null").select("a", "b")
    long = pairs.filter("shared is null and na is not null").select(F.col("a").alias("t"), F.col("b").alias("sid"), F.col("na").alias("n"))
    often = written(long.groupBy("sid").agg(F.max("n").alias("n"), F.count("*").alias("often")), "often")
    alone = often.filter(F.col("often") >= F.greatest(F.lit(1), F.floor(F.col("n") / F.lit(SPARE)))).select("sid")
    runs = written(long.join(alone, "sid", "left_semi").select("t", "sid", "n").mapInArrow(lambda it: _runs(it, num, den, lim.batch_tokens), "t bigint, a bigint, b bigint, hi bigint"), "runs")
    chained = (
        runs.filter("t is not null").repartition("t").sortWithinPartitions("t", "b").mapInArrow(lambda it: _chain(it, num, den), "a bigint, b bigint")
        .union(runs.filter("t is null").select("a", "b"))
    )

    def rest(n: Column) -> Column:
        return n - F.least(n, n - F.ceil(num * n / F.lit(den)) + 1 + F.floor(n / F.lit(SPARE)))

    na, nb = F.col("na").cast("long"), F.col("nb").cast("long")
    least = F.ceil(num * (na + nb) / F.lit(num + den)) - F.greatest(rest(na), rest(nb))
    counted = pairs.filter("shared is not null").groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared")).withColumn("least", least)
    sure, open_ = counted.filter("shared >= least"), counted.filter("shared < least")
    # A pair that shares too few tokens of short lists may share others.
    for end in ("a", "b"):
        more = often.select(F.col("sid").alias(end), F.col("often").alias(f"often_{end}"))
        open_ = open_.join(more, end)
    open_ = open_.filter("shared + least(often_a, often_b) >= least")
    found = written(connected_components(sure.select("a", "b").union(open_.select("a", "b")).union(chained).union(trees)), "candidates")
    drop_written(spark, runs)
    drop_written(spark, often)
    drop_written(spark, pairs)
    return found


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(sid, component, text) to (sid, component, n, tokens); a repeated row counts once in a task."""
    seen: set[int] = set()
    for batch in batches:
        for some in slices(batch, 2):
            at = [k for k, i in enumerate(some.column(0).to_pylist()) if i not in seen and not seen.add(i)]
            if at:
                some = some.take(pa.array(at))
                sets = shingle_sets(some.column(2), words)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["sid", "component", "n", "tokens"],
                )


def jaccard_components(
    docs: DataFrame, words: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row.

    Two documents link when ``den * |a & b| >= num * |a | b|``.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_id"), text.alias("text"))
    lim = Limits.now()
    described = written(d.mapInArrow(lambda it: _describe(it, words, lim), _DESCRIBED), "described")
    every = described.filter("t is null").select("doc_id", "text_id", "n", "sid")
    total = every.agg(F.sum("n")).first()[0] or 0
    near = _candidates(d, _frequent(described, total), total, words, num, den)
    # One row holds the text of a set: that of the smallest id, or of none. Rows of a set are taken together before they move.
    row = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_id")).alias("row")
    each = written(every.filter("sid is not null").groupBy("sid").agg(row).select("sid", F.col("row.doc_id").alias("first"), F.col("row.text_id").alias("text_id")), "each")
    holders = each.join(near.select(F.col("id").alias("sid"), F.col("component_id").alias("component")), "sid")
    fetched = d.join(holders, (d["text_id"] == holders["text_id"]) & d["doc_id"].eqNullSafe(holders["first"])).select("sid", "component", "text")
    sets = written(fetched.mapInArrow(lambda it: _sets(it, words), "sid bigint, component bigint, n bigint, tokens binary"), "sets")
    roots = _linked(sets, num, den)
    drop_written(spark, sets)
    # Equal sets join through their first document.
    of_set = each.join(roots, F.col("sid") == F.col("id"), "left").select("sid", "first", F.coalesce("component_id", "sid").alias("root"))
    lowest = of_set.groupBy("root").agg(F.min("first").alias("component"))
    by_set = of_set.join(lowest, "root").select("sid", "component")
    return every.join(by_set, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))
