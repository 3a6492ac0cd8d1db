import zlib

import numpy as np
import pytest

from millrace.llm import language, mixing, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    got = {r["doc_id"]: r for r in queries.op7_language_mixture(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    held = [(got[r["doc_id"]]["lang_pred"], r["lang"]) for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in docs)
    assert np.mean([a == b for a, b in held]) >= 0.97


def test_language_mixture_and_odd_rows(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs)
    by = {}
    for r in docs.orderBy("doc_id").collect():
        if len(r["text"].split()) >= 200:
            by.setdefault(r["lang"], r["text"])
    both = " ".join(by["en"].split()[:200] + by["fr"].split()[:200])
    _, score, shares = model.predict(both)
    assert {"en", "fr"} <= set(shares) and 0.3 < shares["en"] < 0.7 and 0 < score < 0.8
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(odd_docs, model).collect()}
    assert got[5] == got[6] == got[12] == "und" and got[13] != "und"
    assert language.predict(no_docs, model).count() == 0
    assert language.fit(no_docs).predict("some text") == ("und", 0.0, {})
    assert language.keep(odd_docs, model, 0.0).columns == odd_docs.columns


def brute_kernel(s, t, p, d):
    from itertools import combinations

    total = 0.0
    for i in combinations(range(len(s)), p):
        for j in combinations(range(len(t)), p):
            if all(s[a] == t[b] for a, b in zip(i, j)):
                total += d ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


@pytest.mark.parametrize("s,t", [("idiot", "idxiot"), ("aab", "abab"), ("cat", "dog"), ("moron", "moron")])
def test_kernel_equals_definition(s, t):
    a = toxicity.encode_words([s, "zz"], 9, 0)[:, :, None]
    b = toxicity.encode_words([t, "qq"], 9, -1)[:, None, :]
    got = toxicity.kernel(a, b, 3, 0.6)
    assert got[0, 0] == pytest.approx(brute_kernel(f"^{s}$", f"^{t}$", 3, 0.6), rel=1e-4)


def test_toxicity_held_out_and_gaps(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels.filter(toxicity.fold(labels["doc_id"], 3) != 1))
    rows = docs.join(labels, "doc_id").filter(toxicity.fold(docs["doc_id"], 3) == 1).select("text", "toxic").collect()
    p = model.scores([r["text"] for r in rows]) >= 0.7
    y = np.array([r["toxic"] for r in rows]) == 1
    assert (p & ~y).sum() <= 0.02 * (~y).sum()
    assert (p & y).sum() >= 0.6 * y.sum()
    plain, gapped, clean = model.scores(["of the idiot and the idiot on", "of the i-d-i-o-t and the id*iot on", "of the and the on"])
    assert plain >= 0.7 and gapped >= 0.7 and clean < 0.3


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(odd_docs, none)
    got = toxicity.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(r["score"] == 0 for r in got)
    model = toxicity.train([("you idiot moron idiot", 1), ("idiot of moron here", 1), ("moron idiot again", 1), ("fine day today", 0), ("calm words only", 0), ("quiet river bank", 0)])
    assert all(0 <= s <= 1 for s in model.scores(["", None, "x" * 5000, "idiot"]))
    assert toxicity.score(no_docs, model).count() == 0
    assert toxicity.keep(odd_docs, model).columns == odd_docs.columns


def test_mixing_meets_targets(spark):
    rows = queries.op10_soft_mixing(spark, SF).toPandas()
    total = rows["n_tokens"].sum()
    assert (rows["rate"] >= 0).all()
    for d, share in queries.MIX_TARGETS.items():
        assert abs((rows["rate"] * rows["n_tokens"] * rows[f"p_{d}"]).sum() / total - share) < 1e-4
    assert abs(rows[["p_good", "p_poor", "p_toxic"]].sum(axis=1) - 1).max() < 1e-9


def test_mixing_equals_plain_projected_gradient(spark):
    """Against a plain fit on one machine: the same residual, here with targets that need rates of zero."""
    docs = spark.createDataFrame([(i, ("good stuff " if i % 2 else "bad thing ") * (i + 1)) for i in range(20)], "doc_id long, text string")
    labelled = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(20)], "doc_id long, domain string")
    mixture, table = mixing.fit(docs, labelled, {"a": 1.0})
    got = mixing.rates(table, mixture).toPandas()
    p, n = np.stack(got["posterior"]), got["n_tokens"].to_numpy(float)
    r = np.ones(20)
    goal = np.array([1.0, 0.0])
    for _ in range(20000):
        r = np.maximum(0, r - 0.5 * p @ ((r * n) @ p / n.sum() - goal))
    mine = np.linalg.norm((got["rate"].to_numpy() * n) @ p / n.sum() - goal)
    assert mine <= np.linalg.norm((r * n) @ p / n.sum() - goal) + 5e-3


def test_mixing_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, domain string")
    mixture, table = mixing.fit(odd_docs, none, {"good": 1.0})
    assert mixing.rates(table, mixture).count() == odd_docs.count()
    labelled = spark.createDataFrame([(7, "good"), (8, "good"), (12, "poor"), (99, "poor"), (11, None)], "doc_id long, domain string")
    mixture, _ = mixing.fit(odd_docs, labelled, {"good": 0.9, "poor": 0.1})
    out = mixing.resample(odd_docs, mixture)
    assert out.columns == odd_docs.columns
    mixture, table = mixing.fit(no_docs, none, {"good": 1.0})
    assert mixing.rates(table, mixture).count() == 0


def test_training_rows_hold_no_grams_of_clean_words():
    """N-grams that two toxic rows at least hold, as by plain counting, in room that does not grow with the clean rows' words."""
    import tracemalloc

    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(60_000)]
    toxic = [" ".join(words[k : k + 6]) + " idiot moron" for k in range(0, 60, 3)]
    rows = [(t, 1) for t in toxic] + [(" ".join(words[k : k + 600]), 0) for k in range(60, 60_000, 600)]
    tracemalloc.start()
    made = toxicity.Rows(rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()

    def plain(text):
        return {f"^{w}$"[i : i + n] for w in text.split() for n in toxicity.SIZES for i in range(len(w) + 3 - n)}

    held = [plain(t) for t in toxic]
    want = {g for x in held for g in x if sum(g in y for y in held) >= 2}
    assert {made.text_of(g) for g in range(made.grams)} == want and made.grams == len(want)
    assert [{made.text_of(g) for g in x} for x in made.grams_of] == [plain(t) & want for t, _ in rows]
    assert most < 36e6
