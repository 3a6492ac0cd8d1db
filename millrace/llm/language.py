"""Language identification by mixtures of languages.

Character n-gram counts of labelled texts give each language's probability of a word (trigrams
backed off to bigrams and single letters). A document's words are drawn from a mixture of
languages; expectation-maximisation estimates the proportions, and the set of languages is grown
while the likelihood gains more than a penalty that rises with the number of words.

Bounds: at most ``per_language`` labelled texts of each language are counted (those with the
smallest hash of their id), in 65,536 hashed cells for each order. Every text is predicted whole.
Defined results: ``und`` with score 0 for null texts and texts without a letter, or when no label
was learned; ties go to the language first in order of name; repeated rows repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import WordMemo, slices, sole

CELLS = 1 << 16
_WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def cells(words: list[str]) -> tuple[np.ndarray, ...]:
    """For every letter of every word (blank-bounded): word number, cells of its 1-, 2- and 3-gram, of the letter and of the two letters
    before it (-1 at a word's beginning). Nothing depends on the words around a word."""
    joined = " " + "".join(w + " " for w in words)
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    one = c * 2654435761 % 4294967291
    two = (np.r_[0, c[:-1]] * 1000003 + c) * 2654435761 % 4294967291
    previous = np.r_[32, c[:-1]]
    lead = np.where(previous == 32, 32, np.r_[32, 32, c[:-2]][: len(c)])  # nothing reaches over a blank
    three = ((lead * 1000003 + previous) * 1000003 + c) * 2654435761 % 4294967291
    before = (lead * 1000003 + previous) * 2654435761 % 4294967291 % CELLS
    before = np.where(previous == 32, -1, before)
    single = previous * 2654435761 % 4294967291 % CELLS
    number = np.cumsum(c == 32) - 1
    number = np.where(c == 32, number - 1, number)  # a closing blank belongs to its word
    keep = np.arange(len(c)) > 0
    return number[keep], one[keep] % CELLS, two[keep] % CELLS, three[keep] % CELLS, single[keep], before[keep]


class LanguageModel:
    """Word probabilities under each language, from n-gram counts (language, order, cell)."""

    def __init__(self, languages: list[str], counts: np.ndarray, penalty: float = 4.0):
        self.languages, self.penalty = languages, penalty
        if languages:
            one = (counts[:, 0] + 0.05) / (counts[:, 0].sum(1, keepdims=True) + 0.05 * 400)
            self.counts, self.one = counts.astype(np.float32), one.astype(np.float32)
        self.memo = WordMemo(max(1, len(languages)), self.log_probabilities)

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        # Contexts: the bigram's first letter, the trigram's first two; at a word's beginning the blank alone.
        number, a, b, c, a0, b0 = cells(words)
        out = np.zeros((len(words), len(self.languages)))
        for k in range(len(self.languages)):
            n1, n2, n3 = self.counts[k]
            p1 = self.one[k][a]
            p2 = (n2[b] + 5 * p1) / (n1[a0] + 5)
            p3 = (n3[c] + 5 * p2) / (np.maximum(np.where(b0 < 0, n1[a0], n2[b0]), n3[c]) + 5)
            out[:, k] = np.bincount(number, weights=np.log(np.minimum(p3, 1.0)), minlength=len(words))[: len(words)]
        return out

    @staticmethod
    def _mixture(lp: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, float]:
        """Proportions of the columns by EM, and the log likelihood."""
        top = lp.max(axis=1)
        p = np.exp(lp - top[:, None])
        share = np.full(lp.shape[1], 1 / lp.shape[1])
        last = -np.inf
        for _ in range(rounds):
            mixed = p @ share
            fit = float(np.log(mixed).sum())
            share = share * (p / mixed[:, None]).sum(axis=0) / len(p)
            if fit - last < 1e-3 * max(1.0, abs(fit) * 1e-3):
                break
            last = fit
        return share, fit + float(top.sum())

    def predict(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        """Language of the largest proportion, a score, and the proportions of the chosen set."""
        return self.predict_all([text])[0]

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float, dict[str, float]]]:
        listed = [words_of(t) if self.languages else [] for t in texts]
        rows = self.memo.rows(pa.array([w for words in listed for w in words], pa.string()))
        ends = np.cumsum([len(words) for words in listed])
        return [self._mixed(lp) for lp in np.split(rows, ends[:-1])] if listed else []

    def _mixed(self, lp: np.ndarray) -> tuple[str, float, dict[str, float]]:
        """The result of a text's words' log probabilities."""
        if not len(lp):
            return UNKNOWN, 0.0, {}
        alone = lp.sum(axis=0)
        chosen = [int(np.argmax(alone))]
        share, fit = np.ones(1), float(alone[chosen[0]])
        cost = self.penalty * np.log(len(lp) + 1.0)
        while len(chosen) < len(self.languages):
            base = lp[:, chosen].max(axis=1)
            best = None
            for k in range(len(self.languages)):
                # A mixture gains at most what the better of both gives every word.
                if k in chosen or np.maximum(lp[:, k] - base, 0).sum() + 1e-9 < cost:
                    continue
                got = self._mixture(lp[:, [*chosen, k]])
                if got[1] - fit > cost and (best is None or got[1] > best[1][1]):
                    best = (k, got)
            if best is None:
                break
            chosen.append(best[0])
            share, fit = best[1]
        k = min(range(len(chosen)), key=lambda i: (-share[i], chosen[i]))
        rivals = [alone[j] for j in range(len(self.languages)) if j not in chosen]
        margin = float(alone[chosen].max() - max(rivals)) if rivals else 30.0
        sure = 1 / (1 + np.exp(-min(30.0, margin)))
        return self.languages[chosen[k]], float(share[k] * sure), {self.languages[c]: float(s) for c, s in zip(chosen, share)}


def fit(labelled: DataFrame, per_language: int = 2000) -> LanguageModel:
    """Count n-grams of (doc_id, text, lang) rows; counts are summed in the cluster."""
    spark = labelled.sparkSession
    ids = labelled.filter("lang is not null and doc_id is not null").select("doc_id", "lang")
    names = [r["lang"] for r in ids.select("lang").distinct().orderBy("lang").collect()]
    if not names:
        return LanguageModel([], np.zeros((0, 3, CELLS)))
    picked = None
    for name in names:
        some = ids.filter(F.col("lang") == name).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_language)
        picked = some if picked is None else picked.union(some)
    chosen = spark.createDataFrame(picked.distinct().collect(), "doc_id bigint, lang string")
    rows = labelled.select("doc_id", "lang", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), ["doc_id", "lang"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                if words:
                    mine = sums.setdefault(lang, np.zeros(3 * CELLS, dtype=np.int64))
                    grams = cells(words)[1:4]
                    for order, g in enumerate(grams):
                        mine += np.bincount(g + order * CELLS, minlength=3 * CELLS)
        for lang, mine in sums.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(mine[at])], names=["lang", "cell", "n"]
            )

    summed = rows.select("text", "lang").mapInArrow(run, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(names), 3 * CELLS))
    got = summed.toPandas()  # at most languages x 3 x 65,536 rows
    place = {n: i for i, n in enumerate(names)}
    counts[got["lang"].map(place).to_numpy(dtype=int), got["cell"].to_numpy()] = got["n"].to_numpy()
    return LanguageModel(names, counts.reshape(len(names), 3, CELLS))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``proportions`` (map) of every row; no shuffle."""
    kept = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x 786 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole(shared.value.memo)
        for batch in (some for whole in batches for some in slices(whole, 1)):
            got = shared.value.predict_all(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                    pa.array([list(g[2].items()) for g in got], pa.map_(pa.string(), pa.float64())),
                ],
                names=["doc_id", "lang_pred", "score", "proportions"],
            )

    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, proportions map<string,double>")


def keep(docs: DataFrame, model: LanguageModel, least: float) -> DataFrame:
    """Rows of ``docs`` in a learned language with a score of at least ``least``; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole(shared.value.memo)
        for batch in (some for whole in batches for some in slices(whole, at)):
            got = shared.value.predict_all(batch.column(at).to_pylist())
            yield batch.filter(pa.array([g[0] != UNKNOWN and g[1] >= least for g in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
