"""Learned operators against plain versions of what they compute, and rows and columns that could upset them."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, embedding_dedup, language, mixing, order_minhash, toxicity, words
from millrace.llm.queries import tokenizer_file


def plain_kernel(s: str, t: str, p: int = toxicity.ORDER, decay: float = toxicity.DECAY) -> float:
    """All pairs of places where both words hold the same letters in order."""

    def places(w):
        out = {}
        for at in itertools.combinations(range(len(w)), p):
            key = tuple(w[i] for i in at)
            out[key] = out.get(key, 0.0) + decay ** (at[-1] - at[0] + 1)
        return out

    a, b = places(f"^{s}$"), places(f"^{t}$")
    return sum(v * b.get(k, 0.0) for k, v in a.items())


def test_svm_features_equal_the_plain_kernel():
    landmarks, some = ["idiot", "moron", "éclair", "the"], ["idiot", "idxiot", "i", "mo", "the", "thé", "moroon", "ecla", "x" * 18]
    svm = toxicity.WordSVM(landmarks)
    want = [[plain_kernel(w, m) / max(1e-9, plain_kernel(w, w) * plain_kernel(m, m)) ** 0.5 for m in landmarks] for w in some]
    assert np.allclose(svm.similarity(some), want, atol=1e-5)
    features = svm.similarity(some).astype(float)
    svm.fit(features, np.array([1, 1, -1, -1, -1, -1, 1, -1, -1.0]), np.ones(9))
    assert np.allclose(svm.decide(some), features @ svm.weight + svm.bias, atol=1e-5)
    long = "q" * 30 + "idiot" + "q" * 30
    windows = [long[k : k + toxicity.WINDOW] for k in range(0, len(long) - toxicity.WINDOW // 2, toxicity.WINDOW // 2)]
    assert abs(svm.decide([long])[0] - svm.decide(windows).max()) < 1e-9


def test_svm_fit_is_the_minimum():
    rng = np.random.default_rng(2)
    pool = ["idiot", "moron", "stupid", "table", "window", "garden", "paper", "river", "idea", "morning"]
    svm = toxicity.WordSVM(pool)
    some = [toxicity.gapped(w, rng) for w in pool for _ in range(6)]
    y, cost = np.array([1.0 if w[:2] in ("id", "mo", "st") else -1.0 for w in some]), rng.uniform(0.5, 2, len(some))
    x = svm.similarity(some).astype(float)
    svm.fit(x, y, cost, rounds=20_000)
    full = np.hstack([x @ svm.root, np.ones((len(y), 1))])
    w = np.append(np.linalg.solve(svm.root, svm.weight), svm.bias)
    value = lambda v: (cost / cost.sum()) @ np.maximum(0, 1 - y * (full @ v)) ** 2 + 0.5e-4 * v[:-1] @ v[:-1]
    assert all(value(w) <= value(w + step * rng.standard_normal(len(w))) + 1e-9 for step in (1e-4, 1e-3, 1e-2, 0.1, 1) for _ in range(200))


def test_evidence_equals_words_one_by_one():
    rng = np.random.default_rng(0)
    plain = [f"{a}{b}{c}" for a in "bdgklm" for b in "aeio" for c in "nrst"]
    rows = [(" ".join(rng.choice(plain, 30)), 0) for _ in range(40)] + [(" ".join([*rng.choice(plain, 20), "wretchling", "scumbert"]), 1) for _ in range(40)]
    model = toxicity.train(rows)
    texts = [rows[0][0], rows[-1][0], "", None, "ban wretchling, x s c u m b e r t z", "   ban\x1fwretchling\n"]
    for text, got in zip(texts, model.evidence(texts)):
        f = sorted(np.clip(model.svm.decide([w]), toxicity.NONE, toxicity.SURE)[0] if len(w) >= toxicity.ORDER else toxicity.NONE for w in map(toxicity.canonical, toxicity.tokens_of(text or "")))
        want = [*(f[::-1] + [toxicity.NONE] * 2)[:2], np.log1p(sum(v > 0 for v in f))]
        assert np.allclose(got, want, atol=1e-6), text


def plain_mixture(model, text):
    """Growing the set by trying every language at every step, with EM written out."""
    lp = np.array([model.log_probabilities([w])[0] for w in language.words_of(text)])

    def em(cols):
        best = lp[:, cols].max(axis=1)  # of each word, taken out of the likelihood that the stop rule looks at
        p, share, last = np.exp(lp[:, cols] - best[:, None]), np.full(len(cols), 1 / len(cols)), -np.inf
        for _ in range(25):
            r = share * p
            fit = np.log(r.sum(axis=1)).sum()
            share = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
            if fit - last < 1e-3 * max(1.0, abs(fit) * 1e-3):
                break
            last = fit
        return share, fit + best.sum()

    chosen, cost = [int(np.argmax(lp.sum(axis=0)))], model.penalty * np.log(len(lp) + 1.0)
    share, fit = np.ones(1), lp[:, chosen].sum()
    while len(chosen) < lp.shape[1]:
        tried = {k: em([*chosen, k]) for k in range(lp.shape[1]) if k not in chosen}
        k = max(tried, key=lambda k: (tried[k][1], -k))
        if tried[k][1] - fit <= cost:
            break
        chosen.append(k)
        share, fit = tried[k]
    return {model.languages[c]: s for c, s in zip(chosen, share)}


def test_words_do_not_depend_on_their_neighbours(spark):
    model = language.fit(spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr")], "doc_id long, text string, lang string"))
    some = ["cat", "chien", "a", "et", "zzz", "dog"]
    together = model.log_probabilities(some)
    assert all(np.array_equal(model.log_probabilities([w])[0], row) for w, row in zip(some, together))
    assert np.array_equal(model.log_probabilities(some[::-1])[::-1], together)


def test_mixtures_equal_plain_em(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.select("doc_id", "text", "lang"), per_language=60)
    each = [[r["text"] for r in docs.filter(F.col("lang") == x).filter("length(text) between 300 and 900").orderBy("doc_id").limit(3).collect()] for x in model.languages]
    texts = [t for ts in each for t in ts] + [a[0] + " " + b[1] for a, b in itertools.combinations(each, 2)]
    for text, got in zip(texts, model.predict_all(texts)):
        want = plain_mixture(model, text)
        assert got[2].keys() == want.keys() and all(abs(got[2][k] - want[k]) < 1e-6 for k in want)
    assert any(len(g[2]) > 1 for g in model.predict_all(texts))


def test_targets_that_ask_for_nothing_are_errors(spark):
    docs = spark.createDataFrame([(i, "a b c" if i % 2 else "x y") for i in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "odd" if i % 2 else "even") for i in range(6)], "doc_id long, domain string")
    for targets in ({}, {"odd": 0.0, "even": 0.0}, {"odd": 0.5, "other": 0.5}, {"odd": -0.1, "even": 1.1}, {"odd": float("nan")}, {"odd": float("inf")}):
        with pytest.raises(ValueError):
            mixing.fit(docs, labels, targets)


def test_posteriors_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    model = mixing.DomainModel(["a", "b"], rng.standard_normal((mixing.CELLS, 2)))
    texts = [" ".join(rng.choice(["Alpha", "beta", "g4mma", "Délta!!", "x" * 30], rng.integers(0, 9))) for _ in range(60)] + [None, ""]
    n, p = model.posteriors(pa.array(texts, pa.string()))
    for t, k, q in zip(texts, n, p):
        cells = [mixing.feature_cells([w])[0] for w in (t or "").split()]
        z = model.weight[0] + (np.mean([model.weight[c].sum(axis=0) for c in cells], axis=0) if cells else 0)
        assert k == len(cells) and np.allclose(q, np.exp(z - z.max()) / np.exp(z - z.max()).sum())
        assert model.posterior(t)[1].tolist() == q.tolist()


def test_a_full_memo_changes_nothing(monkeypatch):
    monkeypatch.setattr(words, "MEMO_WORDS", 20)
    monkeypatch.setattr(words, "MEMO_KEPT", 5)
    memo = words.WordMemo(1, lambda ws: np.array([[len(w) + ord(w[0])] for w in ws], float))
    rng = np.random.default_rng(0)
    for _ in range(40):
        some = ["".join(rng.choice(list("abcdef"), rng.integers(1, 4))) for _ in range(rng.integers(0, 30))]
        assert memo.rows(pa.array(some, pa.string()))[:, 0].tolist() == [len(w) + ord(w[0]) for w in some]
        assert len(memo._row) <= 60
    other = words.WordMemo(1, lambda ws: np.zeros((len(ws), 1)))
    words.sole(memo)
    words.sole(other)
    assert not memo._row and memo.rows(pa.array(["abc"]))[0, 0] == 100


NAMES = {"score": 0.5, "predicted": 9, "held_out": True, "lang_pred": "q", "proportions": "q", "ids": "q", "n_tokens": 3, "posterior": 1.0, "rate": 2.0, "copies": 5, "range": 1, "last": 1, "sid": 1, "t": "q", "n": 4, "ids_sha256": "q"}


def test_repeated_rows_and_clashing_names(spark):
    rows = [(1, "the cat sat on the mat"), (1, "the cat sat on the mat"), (1, "other words, for one id"), (None, "no id here"), (None, None), (2, "")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in NAMES.items():
        docs = docs.withColumn(name, F.lit(value))
    plain = docs.select("doc_id", "text")
    tox = toxicity.train([("good day", 0), ("you wretchling", 1), ("fine day", 0), ("old wretchling", 1)])
    lang = language.fit(spark.createDataFrame([(1, "the cat and dog", "en"), (2, "le chat et chien", "fr")], "doc_id long, text string, lang string"))
    labels = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, domain string")
    mixture, table = mixing.fit(docs, labels, {"a": 0.5, "b": 0.5})
    codec = tokenizer_file("byte_bpe_50k.json")
    shown = lambda df: sorted(map(str, df.collect()))
    for run in (
        lambda d: toxicity.score(d, tox), lambda d: language.predict(d, lang), lambda d: bpe.encode_documents(d, codec, digests_only=True),
        lambda d: order_minhash.compare_with_next(d), lambda d: order_minhash.fingerprints(d), lambda d: mixing._posteriors(d, mixture.model),
    ):
        assert run(docs).count() == len(rows) and shown(run(docs)) == shown(run(plain))
    got = {}
    for r in toxicity.score(docs, tox).collect():
        got.setdefault(r["doc_id"], []).append(r["score"])
    assert {k: len(v) for k, v in got.items()} == {1: 6, 2: 2, None: 4}
    assert mixing.rates(table, mixture).count() == len(rows)
    assert toxicity.keep(docs, tox).columns == docs.columns == language.keep(docs, lang, 0.0).columns == mixing.resample(docs, mixture).columns


def test_repeated_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (1, v, 1), (2, v, 1), (2, [3.0, 2.0, 1.0], 1), (3, [3.0, 2.0, 1.0], 2)]
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (2, 2, 1, False), (3, 0, 3, True)]
