"""Soft-membership mixing of documents to target domain weights.

A softmax classifier, fitted on a labelled table, gives every document its posterior over domains.
Nonnegative document rates are then fitted so that the expected tokens of each domain
(``sum of rate * tokens * posterior``) match the targets: projected-gradient least squares, starting
at rate 1. A rate depends on its document and on the steps taken alone, so a round is one aggregation
of K + K*K numbers for each length that is tried, over the written posteriors, and nothing else moves.
Steps are implicit (the gradient is the one at the rates they lead to), so that they can be long and
few and still never raise the residual.

Bounds: the classifier reads at most ``per_domain`` labelled documents of each domain (those with
the smallest hash of their id). All documents are classified whole and get a rate.
Defined results: null and empty texts have no tokens and the prior's posterior; without labels the
result is one domain ``all``; labels of unknown ids and null labels are ignored, an id labelled twice
counts once for each domain; targets of domains that no label names, negative ones, or only zeros are an error, missing ones are 0;
a target whose labelled documents are all absent from ``docs`` is left out with a warning; if the
targets can't be met, the rates are the least-squares fit. Repeated rows each get their rate.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .words import POWERS, WordMemo, buffer_of, mix, release, slices, sole, split_words

CELLS = 4096
#: Class of a byte for a word's shape: small letters (and all beyond ASCII), capitals, digits, else itself.
_SHAPE = np.arange(4, 260, dtype=np.uint64)
_SHAPE[128:], _SHAPE[ord("a") : ord("z") + 1], _SHAPE[ord("A") : ord("Z") + 1], _SHAPE[ord("0") : ord("9") + 1] = 1, 1, 2, 3


def feature_cells(words: list[str]) -> np.ndarray:
    """Hashed cells (word, 3) of a word itself, its last four bytes and its shape (neighbours of one class once); 0 is the prior's cell."""
    if not words:
        return np.zeros((0, 3), np.int64)
    named = pa.array(words, pa.large_string())
    low, at = buffer_of(pc.utf8_lower(named))
    codes = low.astype(np.uint64) + np.uint64(1)
    whole = POWERS.hashes(codes, at[:-1], at[1:])
    ending = POWERS.hashes(codes, np.maximum(at[:-1], at[1:] - 4), at[1:])
    data, at = buffer_of(named)
    kind = _SHAPE[data]
    new = np.r_[True, kind[1:] != kind[:-1]][: len(kind)]
    new[at[:-1][at[:-1] < len(kind)]] = True
    at = np.r_[0, np.cumsum(new)][at]
    shape = POWERS.hashes(kind[new], at[:-1], at[1:])
    salted = np.stack([whole, mix(ending + np.uint64(1)), mix(shape + np.uint64(2))], axis=1)
    return 1 + (salted % np.uint64(CELLS - 1)).astype(np.int64)


class DomainModel:
    """Posteriors from the mean of word weights."""

    def __init__(self, domains: list[str], weight: np.ndarray):
        self.domains, self.weight = domains, weight
        self.memo = WordMemo(len(domains), self._values)

    def __getstate__(self):
        return {"domains": self.domains, "weight": self.weight}

    def __setstate__(self, state):
        self.__init__(**state)

    def _values(self, words: list[str]) -> np.ndarray:
        return self.weight[feature_cells(words)].sum(axis=1)

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of tokens (white-space words) and posteriors over domains."""
        flat, at = split_words(texts)
        n = np.diff(at)
        z = np.tile(self.weight[0].astype(float), (len(n), 1))
        some = n > 0
        if some.any():
            z[some] += np.add.reduceat(self.memo.rows(flat), at[:-1][some], axis=0) / n[some, None]
        p = np.exp(z - z.max(axis=1, keepdims=True)) if len(n) else z
        return n, p / p.sum(axis=1, keepdims=True)

    def posterior(self, text: str | None) -> tuple[int, np.ndarray]:
        n, p = self.posteriors(pa.array([text], pa.string()))
        return int(n[0]), p[0]


def train(rows: list[tuple[str | None, str]], domains: list[str], rounds: int = 150) -> DomainModel:
    """Softmax regression on mean word features; classes weigh as they occur."""
    x = np.zeros((len(rows), CELLS), np.float32)
    for k in range(0, len(rows), 100):
        flat, at = split_words(pa.array([t for t, _ in rows[k : k + 100]], pa.string()))
        n = np.diff(at)
        if len(flat):
            coded = flat.dictionary_encode()
            cells = feature_cells(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
            owner = np.repeat(np.arange(len(n)), n)
            counts = np.bincount((owner[:, None] * CELLS + cells).ravel(), minlength=len(n) * CELLS).reshape(len(n), CELLS)
            x[k : k + 100] = counts / np.maximum(n, 1)[:, None]
    x[:, 0] = 1
    y = np.array([domains.index(d) for _, d in rows])
    hot = np.eye(len(domains), dtype=np.float32)[y]
    # Rare cells get larger steps: columns are scaled by their spread.
    scale = 1 / np.sqrt((x * x).mean(axis=0) + 1e-5)
    scale[0] = 1
    x *= scale
    step = len(rows) / (0.5 * float(np.linalg.norm(x @ (x.T @ np.ones(len(rows), np.float32))) / np.sqrt(len(rows))) + 1e-6)
    w = v = np.zeros((CELLS, len(domains)), np.float32)
    t = 1.0
    for _ in range(rounds):
        z = x @ v
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = x.T @ (p - hot) / len(rows) + 1e-5 * v
        new, t2 = v - step * g, (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return DomainModel(domains, w * scale[:, None])


def fit_domains(docs: DataFrame, labelled: DataFrame, per_domain: int = 1500) -> DomainModel:
    """Classifier from ``labelled`` (doc_id, domain) and the texts of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    ids = labelled.filter("doc_id is not null and domain is not null").select("doc_id", "domain").distinct().join(docs.select("doc_id").distinct(), "doc_id")
    ids = written(ids, "domain-ids")
    domains = [r["domain"] for r in ids.select("domain").distinct().orderBy("domain").collect()]
    if not domains:
        return DomainModel(["all"], np.zeros((CELLS, 1)))
    picked = None
    for d in domains:  # a top-k of the narrow table each, which tasks cut before anything moves
        some = ids.filter(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_domain)
        picked = some if picked is None else picked.union(some)
    counts = {r["domain"]: r["count"] for r in ids.groupBy("domain").count().collect()}
    chosen = spark.createDataFrame(picked.collect(), "doc_id bigint, domain string")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "domain"]).orderBy("doc_id", "domain").collect()
    model = train([(r["text"], r["domain"]) for r in rows], domains)
    # The sample is drawn by domain; the prior's cell takes the domains' true shares.
    seen = np.array([sum(r["domain"] == d for r in rows) for d in domains], float)
    model.weight[0] += np.log(np.array([counts[d] for d in domains]) / seen)
    del rows
    release()
    return model


@dataclass
class Mixture:
    """A fitted mixture: the classifier and the steps from which every rate follows."""

    model: DomainModel
    steps: list[np.ndarray]
    residual: np.ndarray

    def rates(self, posteriors: np.ndarray) -> np.ndarray:
        r = np.ones(len(posteriors))
        for v in self.steps:
            r = np.maximum(0.0, r - posteriors @ v)
        return r


def _posteriors(docs: DataFrame, model: DomainModel) -> DataFrame:
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # cells x domains: 32 KB a domain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole(shared.value.memo)
        for batch in batches:
            for some in slices(batch, 1):
                n, p = shared.value.posteriors(some.column(1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), lists], names=["doc_id", "n_tokens", "posterior"])

    return kept.mapInArrow(run, "doc_id bigint, n_tokens bigint, posterior array<double>")


def batch_sums(n: np.ndarray, p: np.ndarray, steps: list[np.ndarray], v: np.ndarray, d: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums over documents of ``n`` tokens and posteriors ``p``: their tokens, then for each length t the numbers of step v + t*d.

    Those are the change of the step's objective against step v, the squared change of rates, the
    squared rates, the domains' tokens, and the second moments of the documents with a rate.
    """
    before = Mixture(None, steps, None).rates(p)
    a, b = before - p @ v, p @ d
    old, out = np.maximum(0.0, a), [np.array([n.sum()])]
    for t in lengths:
        r = np.maximum(0.0, a - t * b)
        out.append(np.array([n @ ((r - old) * (r + old)) / 2, n @ (r - before) ** 2, n @ (r * r)]))
        out += [(r * n) @ p, ((p * (n * (r > 0))[:, None]).T @ p).ravel()]
    return np.concatenate(out)


def solve(sums, goal: np.ndarray, rounds: int, tolerance: float) -> tuple[list[np.ndarray], np.ndarray]:
    """Steps of projected gradient to the least-squares rates, and what is left of the targets.

    A step is implicit: ``v`` is the gradient at the rates it leads to, times its length 1/eps, so the
    residual never rises however long it is. ``v`` minimises a convex function of K numbers,
    ``eps/2 |v|^2 + goal.v + 1/2 sum of share * max(0, rate - posterior.v)^2``: Newton with a line search,
    one pass for all its lengths. The steps end when the bound that the projected gradient sets on what
    could still be gained is below tolerance.
    """
    k, lengths = len(goal), 0.5 ** np.arange(10)

    def numbers(steps: list[np.ndarray], v: np.ndarray, d: np.ndarray, lengths: np.ndarray) -> tuple[float, np.ndarray]:
        flat = sums(steps, v, d, lengths)
        return float(flat[0]), flat[1:].reshape(len(lengths), -1) / max(flat[0], 1e-300)

    zero = np.zeros(k)
    total, first = numbers([], zero, zero, np.zeros(1))
    if total <= 0:
        return [], zero
    have, moment = first[0, 3 : 3 + k], first[0, 3 + k :].reshape(k, k)
    steps: list[np.ndarray] = []
    eps, passes = 1e-6, 1
    while (error := float((have - goal) @ (have - goal))) > tolerance**2:
        v, moved, size = zero, 0.0, 1.0
        start = have, moment
        while passes < rounds:
            gradient = eps * v + goal - have
            if gradient @ gradient <= max(1e-6 * error * float(len(steps) > 0 or v.any()), (tolerance / 10) ** 2):
                break
            d = -np.linalg.solve(eps * np.eye(k) + moment, gradient)
            _, got = numbers(steps, v, d, lengths)
            passes += 1
            change = got[:, 0] + eps * (lengths * (v @ d) + lengths**2 / 2 * (d @ d)) + lengths * (goal @ d)
            t = int(np.argmin(change))
            if change[t] >= 0:
                break  # down to rounding
            v = v + lengths[t] * d
            moved, size, have, moment = float(got[t, 1]), float(got[t, 2]), got[t, 3 : 3 + k], got[t, 3 + k :].reshape(k, k)
        after = float((have - goal) @ (have - goal))
        if after >= error:
            have, moment = start
            break
        steps.append(v)
        if eps * np.sqrt(moved * max(size, 1.0)) <= 1e-4 * after + tolerance**2 or (eps <= 1e-12 and after > error / 2):
            break  # the second: the longest step in double precision gains little
        if passes >= rounds:
            warnings.warn(f"the rates had not settled after {rounds} passes; squared residual {after:.3g}")
            break
        eps = max(eps / 10, 1e-12)
    return steps, have - goal


def fit(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], rounds: int = 100, tolerance: float = 1e-7) -> tuple[Mixture, DataFrame]:
    """Fit the rates; returns the mixture and the written table of (doc_id, n_tokens, posterior).

    ``targets`` are weights of domains; they are scaled to sum to 1 and asked of the total of all tokens.
    """
    if not targets or any(not share >= 0 for share in targets.values()) or not 0 < sum(targets.values()) < float("inf"):
        raise ValueError("targets must be nonnegative, and not all of them 0")
    named = {r["domain"] for r in labelled.filter("doc_id is not null and domain is not null").select("domain").distinct().collect()}
    if named and set(targets) - named:
        raise ValueError(f"targets of unknown domains: {sorted(set(targets) - named)}; labelled are {sorted(named)}")
    model = fit_domains(docs, labelled)
    k = len(model.domains)
    if model.domains != ["all"] and set(targets) - set(model.domains):
        if not set(targets) & set(model.domains):
            raise ValueError(f"no target is a known domain: {model.domains}")
        warnings.warn(f"no labelled document of {sorted(set(targets) - set(model.domains))} is left; the other targets are scaled to sum to 1")
    goal = np.array([targets.get(d, 1.0 if model.domains == ["all"] else 0.0) for d in model.domains])
    if not goal.sum():
        raise ValueError(f"the targets of all known domains are 0: {model.domains}")
    goal = goal / goal.sum()
    table = written(_posteriors(docs, model), "posteriors")
    mixture = Mixture(model, [], np.zeros(k))

    def sums(steps: list[np.ndarray], v: np.ndarray, d: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        width = len(batch_sums(np.empty(0), np.empty((0, k)), steps, v, d, lengths))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(width)
            for b in batches:
                n = b.column(0).to_numpy(zero_copy_only=False).astype(float)
                out += batch_sums(n, b.column(1).values.to_numpy(zero_copy_only=False).reshape(-1, k), steps, v, d, lengths)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], names=["i", "v"])

        got = table.select("n_tokens", "posterior").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros(width)
        for row in got:
            flat[row["i"]] = row["v"]
        return flat

    mixture.steps, mixture.residual = solve(sums, goal, rounds, tolerance)
    return mixture, table


def copies(rate, doc_id: int | None) -> int:
    """A rate as a number of copies: its floor, and one more for a share of ids fixed by their hash."""
    u = zlib.crc32(str(doc_id).encode()) / 2**32
    return int(np.floor(rate + u))


def rates(table: DataFrame, mixture: Mixture) -> DataFrame:
    """doc_id, n_tokens, posterior, rate, copies."""
    shared = table.sparkSession.sparkContext.broadcast(mixture)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column(2).values.to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            r = shared.value.rates(p)
            n = [copies(x, i) for x, i in zip(r.tolist(), b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r), pa.array(n, pa.int64())], names=["doc_id", "n_tokens", "posterior", "rate", "copies"])

    return table.mapInArrow(run, "doc_id bigint, n_tokens bigint, posterior array<double>, rate double, copies bigint")


def resample(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """``docs`` with every row as many times as its rate says; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(mixture)
    names = docs.columns
    id_at, text_at = names.index("doc_id"), names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole(shared.value.model.memo)
        for batch in batches:
            for b in slices(batch, text_at):
                _, p = shared.value.model.posteriors(b.column(text_at))
                n = [copies(x, i) for x, i in zip(shared.value.rates(p).tolist(), b.column(id_at).to_pylist())]
                yield b.take(pa.array(np.repeat(np.arange(b.num_rows), n)))

    return docs.mapInArrow(run, docs.schema)
