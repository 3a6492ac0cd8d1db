"""Toxicity by a subsequence string kernel SVM with Nystroem landmarks.

The instance is a sentence, seen through its words: a sentence is as toxic as its most toxic
word, and a document as its sentences. Words (with marks at both ends; inner punctuation removed;
runs of single spaced letters joined) are compared by the gap-weighted subsequence kernel, so
that ``idiot``, ``id-iot`` and ``idxiot`` share subsequences. Landmark words span the Nystroem
feature space in which a linear SVM (squared hinge) is trained; every word is scored by it. It sees words, not
sentences: of a toxic document the words whose character n-grams (stems) mark toxic documents off from clean ones
are positive, whole and ``insertions`` times with a letter put in; negative are the ``frequent_words`` commonest words of clean
documents, their words most like a stem and, for ``rounds`` rounds, all their words that the fit takes for insults
or nearly. Stems, and landmarks with them, are added until every toxic row that holds a marking n-gram is covered. A logistic
function of a document's strongest words gives the score; it is fitted on values of SVMs that have
not seen the row (folds; with few rows of the same SVM), on toxic rows both as they are and with inserted letters.

Bounds: training reads at most ``max_docs`` labelled rows of each class (those with the smallest
hash of their id); stems are chosen among the ``candidates`` surest marking n-grams that two toxic
rows hold; words of 3 to 20 characters train. Scoring reads every whole text and has no limit; a long word is scored in
overlapping windows. Defined results: null and empty texts have no words and get the score of no
evidence; without both classes in the labels the score is 0 for all; labels of unknown ids and
null labels are ignored; an id labelled twice is toxic if one label says so. Repeated rows repeat.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import WordMemo, release, slices, sole, split_words

ORDER, DECAY, WINDOW = 3, 0.6, 20
SIZES = (4, 5, 6, 7, 8)  # of the marking n-grams, word marks included
#: Decision value of a word without evidence, and the value beyond which more is no more evidence.
NONE, SURE = -2.0, 2.0
_INNER = re.compile(r"[\W_]+")
_SPACED = re.compile(r"(?<!\S)(?:\w\W{0,2}\s+){3,}\w(?!\w)")


def fold(i: Column, m: int) -> Column:
    """crc32 of an id as text, modulo ``m``."""
    return F.crc32(i.cast("string").cast("binary")) % m


def canonical(token: str) -> str:
    return _INNER.sub("", token.lower())


def tokens_of(text: str) -> list[str]:
    """White-space tokens of a text, and joined runs of single letters."""
    return [*text.split(), *joined_letters(text)]


def joined_letters(text: str) -> list[str]:
    """Runs of single spaced letters, as words."""
    return [_INNER.sub("", m.group()) for m in _SPACED.finditer(text)]


def encode_words(words: list[str], width: int, pad: int) -> np.ndarray:
    """Code points, one column for each word, marks at both ends."""
    marked = [f"^{w}$"[:width] for w in words]
    n = np.array([len(m) for m in marked], dtype=np.int64)
    out = np.full((width, len(words)), pad, dtype=np.int32)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[at, np.repeat(np.arange(len(words)), n)] = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<i4")
    return out


def kernel(s: np.ndarray, t: np.ndarray, p: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernel of length ``p``; ``s``: (n, B, 1), ``t``: (m, 1 or B, M)."""
    n, m = s.shape[0], t.shape[0]
    shape = np.broadcast_shapes(s.shape[1:], t.shape[1:])
    below = [np.ones((m, *shape), np.float32)] + [np.zeros((m, *shape), np.float32) for _ in range(p - 1)]
    # below[i][k]: weight of common subsequences of length i, taken before column k of t.
    total = np.zeros(shape, np.float32)
    d, dd = np.float32(decay), np.float32(decay * decay)
    for j in range(n):
        hit = (s[j] == t) * dd
        total += np.einsum("kbm,kbm->bm", hit, below[p - 1])
        for i in range(p - 1, 0, -1):
            add = hit * below[i - 1]
            below[i] *= d
            run = np.zeros(shape, np.float32)
            for k in range(m - 1):
                run *= d
                run += add[k]
                below[i][k + 1] += run
    return total


class WordSVM:
    """Decision values of words.

    The kernel is a product of explicit features: a word has, for every three letters in order, the decayed
    weights of the places where it holds them. The landmarks' features stand in a table over their letters, so a word's
    kernel with all of them, or with their weighted sum, is a sum of table entries over its own triples.
    """

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        marked = [f"^{w}$" for w in landmarks]
        self.letters = np.unique(np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<i4"))
        self.norm = np.sqrt(np.maximum(self._self(landmarks), 1e-9))
        a = len(self.letters) + 1
        self.table = np.zeros((a**3, len(landmarks)), np.float32)
        for m, w in enumerate(marked):
            c = self._codes(encode_words([landmarks[m]], len(w), 0))[:, 0]
            for i in range(len(c)):
                for j in range(i + 1, len(c)):
                    for k in range(j + 1, len(c)):
                        self.table[(c[i] * a + c[j]) * a + c[k], m] += DECAY ** (k - i + 1) / self.norm[m]
        gram = self.similarity(landmarks)
        value, vector = np.linalg.eigh(gram.astype(np.float64) + 1e-3 * np.eye(len(landmarks)))
        self.root = (vector / np.sqrt(value)) @ vector.T
        self.weight, self.bias = np.zeros(len(landmarks)), 0.0
        self.line = np.zeros(a**3)

    def _codes(self, points: np.ndarray) -> np.ndarray:
        """Numbers of the landmarks' letters, 0 for any other."""
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        return np.where(self.letters[at] == points, at + 1, 0)

    @staticmethod
    def _self(words: list[str]) -> np.ndarray:
        s = encode_words(words, max(map(len, words)) + 2, 0)
        return kernel(s[:, :, None], np.where(s == 0, -1, s)[:, :, None])[:, 0]

    def _over_triples(self, words: list[str], table: np.ndarray, some: int) -> np.ndarray:
        """Sums of table rows over the triples of words (of at most the window's length), divided by the words' norms."""
        out = np.zeros((len(words), *table.shape[1:]), table.dtype)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        a = len(self.letters) + 1
        for x in range(0, len(order), some):
            at = order[x : x + some]
            part = [words[i] for i in at]
            c = self._codes(encode_words(part, len(part[-1]) + 2, 0))
            total = np.zeros((len(part), *table.shape[1:]), table.dtype)
            for i in range(len(c) - 2):
                for j in range(i + 1, len(c) - 1):
                    pair = (c[i] * a + c[j]) * a
                    if pair.any():
                        for k in range(j + 1, len(c)):
                            total += table.dtype.type(DECAY ** (k - i + 1)) * table[pair + c[k]]
            norm = np.sqrt(np.maximum(self._self(part), 1e-9))
            out[at] = total / norm.reshape(-1, *[1] * (table.ndim - 1))
        return out

    def similarity(self, words: list[str]) -> np.ndarray:
        """Normalised kernel of words (of at most the window's length) to the landmarks."""
        return self._over_triples(words, self.table, 1024)

    def fit(self, features: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 400, ridge: float = 1e-4) -> None:
        """Squared hinge with ridge, by accelerated gradient steps."""
        x = np.hstack([features @ self.root, np.ones((len(y), 1))])
        cost = cost / cost.sum()
        step = 1.0 / (2 * np.linalg.norm((x * cost[:, None]).T @ x, 2) + ridge)
        w = v = np.zeros(x.shape[1])
        t = 1.0
        for _ in range(rounds):
            slack = np.maximum(0, 1 - y * (x @ v))
            g = -2 * ((cost * slack * y) @ x) + ridge * np.append(v[:-1], 0)
            new, t2 = v - step * g, (1 + np.sqrt(1 + 4 * t * t)) / 2
            v, w, t = new + (t - 1) / t2 * (new - w), new, t2
        self.weight, self.bias = self.root @ w[:-1], float(w[-1])
        self.line = self.table @ self.weight

    def decide(self, words: list[str]) -> np.ndarray:
        """Decision values; a word longer than the window gets the largest of its windows."""
        parts, owner = [], []
        for i, w in enumerate(words):
            if len(w) <= WINDOW:
                parts.append(w)
                owner.append(i)
            else:
                for k in range(0, len(w) - WINDOW // 2, WINDOW // 2):
                    parts.append(w[k : k + WINDOW])
                    owner.append(i)
        out = np.full(len(words), -np.inf)
        if parts:
            np.maximum.at(out, np.asarray(owner), self._over_triples(parts, self.line, 8192) + self.bias)
        return out


class ToxicityModel:
    """Word SVM and the logistic function of a document's strongest words."""

    def __init__(self, svm: WordSVM | None, link: np.ndarray | None = None):
        self.svm, self.link = svm, link
        self.memo = WordMemo(1, self._values)

    def __getstate__(self):
        return {"svm": self.svm, "link": self.link}

    def __setstate__(self, state):
        self.__init__(**state)

    def _values(self, tokens: list[str]) -> np.ndarray:
        plain = [canonical(t) for t in tokens]
        # A word of fewer letters than the kernel's order shares no marked insult.
        different = list(dict.fromkeys(w for w in plain if len(w) >= ORDER))
        value = dict(zip(different, np.clip(self.svm.decide(different), NONE, SURE).tolist()))
        return np.array([value.get(w, NONE) for w in plain])

    def values(self, tokens: list[str]) -> np.ndarray:
        """Decision values of tokens, those without evidence at the least value."""
        return self.memo.known(tokens)[:, 0]

    def evidence(self, texts: pa.Array | list[str | None]) -> np.ndarray:
        """For each text: its largest and second largest decision value, and the logarithm of how many are positive."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        flat, at = split_words(texts)
        f, n = self.memo.rows(flat)[:, 0], np.diff(at)
        joined = [(i, w) for i, t in enumerate(texts.to_pylist()) if t for w in joined_letters(t)]
        if joined:
            owner = np.r_[np.repeat(np.arange(len(n)), n), [i for i, _ in joined]]
            f = np.r_[f, self.values([w for _, w in joined])][np.argsort(owner, kind="stable")]
            n = np.bincount(owner, minlength=len(n))
        some = np.flatnonzero(n)
        out = np.tile([NONE, NONE, 0.0], (len(n), 1))
        if len(some):
            start = (np.cumsum(n) - n)[some]
            out[some, 0] = top = np.maximum.reduceat(f, start)
            best = np.flatnonzero(f == np.repeat(top, n[some]))
            _, first = np.unique(np.repeat(some, n[some])[best], return_index=True)
            rest = f.copy()
            rest[best[first]] = NONE
            out[some, 1] = np.maximum.reduceat(rest, start)
            out[some, 2] = np.log1p(np.add.reduceat((f > 0).astype(float), start))
        return out

    def scores(self, texts: pa.Array | list[str | None]) -> np.ndarray:
        if self.svm is None:
            return np.zeros(len(texts))
        z = np.hstack([self.evidence(texts), np.ones((len(texts), 1))]) @ self.link
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def gram_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, word number, start, size) of every marking n-gram of words of the kernel's order and longer."""
    at = [i for i, w in enumerate(words) if ORDER <= len(w) <= WINDOW]
    none = np.empty(0, np.int64)
    if not at:
        return np.empty(0, np.uint64), none, none, none
    c = encode_words([words[i] for i in at], max(len(words[i]) for i in at) + 2, 0).astype(np.uint64)
    h, out = np.zeros_like(c), []
    with np.errstate(over="ignore"):
        for n in range(1, SIZES[-1] + 1):
            if n > len(c):
                break
            h = h[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] + np.uint64(n)
            if n in SIZES:
                start, word = np.nonzero(c[n - 1 :])
                mixed = h[start, word]
                mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                out.append((mixed, np.array(at)[word], start, np.full(len(start), n)))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.uint64), none, none, none)


def gapped(w: str, rng: np.random.Generator) -> str:
    """A word with a letter or digit put in."""
    at = 1 + int(rng.integers(len(w) - 1))
    return w[:at] + "abcdefghijklmnopqrstuvwxyz0123456789"[int(rng.integers(36))] + w[at:]


class Rows:
    """Labelled rows for training: words of every row, and for every row the n-grams that two toxic rows at least hold."""

    def __init__(self, rows: list[tuple[str | None, int]]):
        number: dict[str, int] = {}
        plain: dict[str, str] = {}
        self.texts = [t or "" for t, _ in rows]
        self.toxic = np.array([int(y) for _, y in rows], dtype=bool)
        self.words_of: list[np.ndarray] = []
        for text in self.texts:
            words = set()
            for t in set(tokens_of(text)):
                w = plain.get(t)
                if w is None:
                    w = plain[t] = canonical(t)
                if w:
                    words.add(w)
            self.words_of.append(np.array(sorted(number.setdefault(w, len(number)) for w in words), dtype=np.int64))
        self.words = list(number)
        # Only n-grams that two toxic rows hold can mark. They are found first, so that those of all other words are never held.
        seen = np.zeros(len(self.words), bool)
        for words, y in zip(self.words_of, self.toxic):
            if y:
                seen[words] = True
        hashed, word = (np.concatenate(c) for c in zip(*((h, w) for h, w, _, _ in self._hashed(np.flatnonzero(seen)))))
        wanted, self.gram = np.unique(hashed, return_inverse=True)
        del hashed
        order = np.argsort(word, kind="stable")
        self.gram, self._ends = self.gram[order].astype(np.int32), np.searchsorted(word[order], np.arange(len(self.words) + 1))
        del order, word
        held = np.zeros(len(wanted), np.int32)
        for words, y in zip(self.words_of, self.toxic):
            if y:
                held[self._grams(words)] += 1
        wanted = wanted[held >= 2]
        parts = []
        for h, w, start, size in self._hashed(np.arange(len(self.words))):
            at = np.searchsorted(wanted, h)
            keep = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == h) if len(wanted) else at[:0]
            parts.append((at[keep].astype(np.int32), w[keep], start[keep].astype(np.int16), size[keep].astype(np.int16)))
        self.gram, self.word, start, size = (np.concatenate(c) for c in zip(*parts))
        del parts
        order = np.argsort(self.word, kind="stable")
        self.gram, self.word, start, size = self.gram[order], self.word[order], start[order], size[order]
        self._ends = np.searchsorted(self.word, np.arange(len(self.words) + 1))
        first = np.zeros(len(wanted), np.int64)
        first[self.gram[::-1]] = np.arange(len(self.gram))[::-1]
        self._place = (self.word[first], start[first], size[first])
        self.grams_of = [self._grams(words).astype(np.int32) for words in self.words_of]

    def _hashed(self, words: np.ndarray, some: int = 5000) -> Iterator[tuple[np.ndarray, ...]]:
        """(hash, word, start, size) of the marking n-grams of words by their numbers, a lot at a time."""
        for k in range(0, max(1, len(words)), some):
            lot = words[k : k + some]
            h, w, start, size = gram_hashes([self.words[i] for i in lot.tolist()])
            yield h, lot[w].astype(np.int32), start, size

    def _grams(self, words: np.ndarray) -> np.ndarray:
        found = [self.gram[self._ends[w] : self._ends[w + 1]] for w in words.tolist()]
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)

    def text_of(self, gram: int) -> str:
        word, start, size = (int(x[gram]) for x in self._place)
        return f"^{self.words[word]}$"[start : start + size]

    @property
    def grams(self) -> int:
        return len(self._place[0])


def cover(holds: np.ndarray, weight: np.ndarray, texts: list[str], often: int) -> list[int]:
    """N-grams (rows of ``holds``) that cover every toxic row (columns) that any of them covers, the surest first.

    The first ``often`` cover rows that are not covered twice yet, the others those that are not covered at all.
    """
    left = np.full(holds.shape[1], 2)
    stems: list[int] = []
    active = np.ones(len(holds), bool)
    while True:
        gain = np.where(active, (holds @ (left > 0).astype(np.float32)) * weight, 0)
        if not (gain > 0).any():
            return stems
        best = gain.max()
        top = max(np.flatnonzero(gain >= best).tolist(), key=lambda i: (len(texts[i]), texts[i]))
        stems.append(top)
        left[holds[top] > 0] -= 1
        if len(stems) == often:
            left = np.minimum(left, 1)  # from here on once is enough
        active &= np.array([t not in texts[top] for t in texts])


def word_svm(
    rows: Rows, some: np.ndarray, landmarks: int, rng: np.random.Generator, candidates: int = 4000, frequent_words: int = 1500, insertions: int = 6, rounds: int = 3
) -> WordSVM | None:
    """The SVM of the rows at ``some``; None without both classes or a marking n-gram."""
    sides = [[i for i in some.tolist() if rows.toxic[i] == y] for y in (False, True)]
    if not sides[0] or not sides[1]:
        return None
    held = [np.bincount(np.concatenate([rows.words_of[i] for i in side]), minlength=len(rows.words)) for side in sides]
    clean_by, held_by = (np.bincount(np.concatenate([rows.grams_of[i] for i in side]), minlength=rows.grams) for side in sides)
    with np.errstate(divide="ignore", invalid="ignore"):
        odds = np.log((held_by - 0.9) / len(sides[1])) - np.log((clean_by + 0.5) / (len(sides[0]) + 1))
    odds = np.where(held_by >= 2, odds, -np.inf)
    marking = np.flatnonzero(odds > 1.0)
    best = marking[np.argsort(-odds[marking] * held_by[marking], kind="stable")[:candidates]]
    place = np.full(rows.grams + 1, -1)
    place[best] = np.arange(len(best))
    holds = np.zeros((len(best), len(sides[1])), np.float32)
    for k, i in enumerate(sides[1]):
        at = place[rows.grams_of[i]]
        holds[at[at >= 0], k] = 1
    texts = [rows.text_of(g) for g in best.tolist()]
    chosen = cover(holds, odds[best], texts, 2 * landmarks // 3)
    stems = [texts[i] for i in chosen]
    # The surest stem of each word.
    value = np.full(rows.grams, -9.0)
    value[best[chosen]] = odds[best[chosen]]
    mark = np.full(len(rows.words), -9.0)
    np.maximum.at(mark, rows.word, value[rows.gram])
    fits = np.array([ORDER <= len(w) <= WINDOW for w in rows.words], bool)
    often = held[0] * len(sides[1]) <= 0.2 * held[1] * len(sides[0])
    positive = np.flatnonzero(fits & (held[1] > 0) & (mark > 0) & often)
    clean_words = np.flatnonzero(fits & (held[0] > 0))
    if not len(positive) or not len(clean_words):
        return None
    positive = [rows.words[i] for i in sorted(positive.tolist(), key=lambda i: (-held[1][i] * mark[i], rows.words[i]))]
    support = dict(zip(rows.words, held[1].tolist()))
    clean = [rows.words[i] for i in sorted(clean_words.tolist(), key=lambda i: (-held[0][i], rows.words[i]))]
    watched = list(dict.fromkeys(g.strip("^$") if len(g.strip("^$")) >= ORDER else g for g in stems))
    frequent = clean[:frequent_words]
    room = max(landmarks - len(watched), landmarks // 3)
    # Landmarks: the stems, the commonest clean words, and clean words that are most like the stems.
    like = WordSVM(watched).similarity(clean).max(axis=1)
    closest = [clean[i] for i in np.argsort(-like, kind="stable")[: 4 * room]]
    svm = WordSVM(list(dict.fromkeys(watched + frequent[: room // 2] + [closest[i] for i in rng.permutation(len(closest))[: room - room // 2]])))
    inserted = [(gapped(w, rng), w) for w in positive if len(w) < WINDOW for _ in range(insertions)]
    weight = np.array([support[w] for w in positive] + [support[w] / insertions for _, w in inserted], float)
    positives = svm.similarity(positive + [g for g, _ in inserted]).astype(np.float64)
    negative = list(dict.fromkeys(frequent + closest))
    negatives = svm.similarity(negative).astype(np.float64)
    # All clean words are tried after each fit; those taken for insults, or nearly, join the negatives.
    for _ in range(rounds):
        features = np.vstack([positives, negatives])
        y = np.r_[np.ones(len(positives)), -np.ones(len(negative))]
        cost = np.r_[weight / weight.sum(), np.full(len(negative), 1.0 / len(negative))]
        svm.fit(features, y, cost)
        hard = (y < 0) & (features @ svm.weight + svm.bias > -0.7)
        if hard.any():  # as heavy as all other negatives
            cost[hard] += 1.0 / max(hard.sum(), len(negative) // 4)
            svm.fit(features, y, cost)
        known = set(negative)
        more = [w for w, v in zip(clean, svm.decide(clean).tolist()) if v > -0.7 and w not in known]
        if not more:
            break
        negative += more
        negatives = np.vstack([negatives, svm.similarity(more)])
    return svm


def train(rows: list[tuple[str | None, int]], landmarks: int = 36, seed: int = 7, folds: int = 3, least: int = 60) -> ToxicityModel:
    """Fit on (text, toxic) rows: the SVM on all of them, the link on values of SVMs that have not seen the row.

    With fewer than ``least`` rows of a class, folds leave an SVM too little, and the link takes the SVM of all rows.
    """
    data = Rows(rows)
    release()
    every = np.arange(len(rows))
    svm = word_svm(data, every, landmarks, np.random.default_rng(seed))
    if svm is None:
        return ToxicityModel(None)
    number = Counter()
    same: dict[tuple, int] = {}
    fold = []
    for words, y in zip(data.words_of, data.toxic.tolist()):  # equal rows go to one fold
        fold.append(same.setdefault((words.tobytes(), y), number[y] % folds))
        number[y] += 1
    fold = np.array(fold)
    rng = np.random.default_rng(seed)
    evidence, target = [], []
    for j in range(folds):
        mine = np.flatnonzero(fold == j)
        if not len(mine):
            continue
        others = word_svm(data, every[fold != j], landmarks, np.random.default_rng(seed)) if min(number.values()) >= least else None
        unseen = ToxicityModel(others or svm)
        evidence.append(unseen.evidence([data.texts[i] for i in mine]))
        target += data.toxic[mine].astype(int).tolist()
        # Toxic rows once more, with a letter put into what the SVM takes for insults.
        broken = []
        for i in mine[data.toxic[mine]].tolist():
            tokens = tokens_of(data.texts[i])
            hit = dict(zip(tokens, (unseen.values(tokens) > 0).tolist()))
            broken.append(" ".join(gapped(canonical(t), rng) if hit[t] and len(canonical(t)) >= ORDER else t for t in tokens))
        if broken:
            evidence.append(unseen.evidence(broken))
            target += [1] * len(broken)
        del others, unseen, broken
        release()
    x = np.vstack(evidence)
    x, target = np.hstack([x, np.ones((len(x), 1))]), np.array(target, float)
    link = np.zeros(4)
    for _ in range(60):  # Newton steps, ridge on all but the constant
        p = 1 / (1 + np.exp(-np.clip(x @ link, -30, 30)))
        ridge = np.diag([0.05, 0.05, 0.05, 1e-6])
        link = link + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (target - p) - ridge @ link)
    return ToxicityModel(svm, link)


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 1500) -> ToxicityModel:
    """Fit on labelled rows of ``docs`` (doc_id, text), at most ``max_docs`` for each class."""
    y = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = docs.select("doc_id").join(y, "doc_id")
    part = F.xxhash64("doc_id")
    picked = None
    for side in (0, 1):
        some = ids.filter(F.col("toxic") == side).orderBy(part, "doc_id").limit(max_docs)
        picked = some if picked is None else picked.union(some)
    spark = docs.sparkSession
    chosen = spark.createDataFrame(picked.distinct().collect(), "doc_id bigint, toxic int")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id")
    model = train([(r["text"], r["toxic"]) for r in rows.collect()])
    release()
    return model


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` of every row, from the text alone; no shuffle."""
    kept = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks and weights: a few hundred KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole(shared.value.memo)
        for batch in batches:
            for some in slices(batch, 1):
                s = shared.value.scores(some.column(1))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"]
                )

    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def keep(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole(shared.value.memo)
        for batch in batches:
            for some in slices(batch, at):
                yield some.filter(pa.array(shared.value.scores(some.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)
