import numpy as np

from millrace.llm import toxicity


def words(rng, n):
    return ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 8)) for _ in range(n)]


def test_every_insult_of_the_training_rows_is_learned():
    """Forty unlike insults, more than a fixed number of stems would hold."""
    rng = np.random.default_rng(1)
    plain, insults = words(rng, 300), words(rng, 40)
    rows = [(" ".join(rng.choice(plain, 30)), 0) for _ in range(200)]
    rows += [(" ".join([*rng.choice(plain, 30), w, w]), 1) for w in insults for _ in range(5)]
    model = toxicity.train(rows)
    assert (model.svm.decide(insults) > 0).all()


def test_inserted_letters_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels.filter(toxicity.fold(labels["doc_id"], 3) != 1))
    rows = docs.join(labels.filter("toxic = 1"), "doc_id").filter(toxicity.fold(docs["doc_id"], 3) == 1).orderBy("doc_id").select("text").collect()
    rng = np.random.default_rng(0)
    texts = []
    for r in rows:
        take = [v > 0 and len(w) > 3 for w, v in zip(r["text"].split(), model.values(r["text"].split()))]
        at = [1 + int(rng.integers(max(1, len(w) - 1))) for w in r["text"].split()]
        put = rng.choice(list("abcdefghijklmnopqrstuvwxyz"), len(at))
        texts.append(" ".join(w[:i] + c + w[i:] if t else w for w, t, i, c in zip(r["text"].split(), take, at, put)))
    assert (model.scores(texts) >= 0.7).mean() >= 0.55
    clean = docs.join(labels.filter("toxic = 0"), "doc_id").filter(toxicity.fold(docs["doc_id"], 3) == 1).select("text").collect()
    assert (model.scores([r["text"] for r in clean]) >= 0.7).mean() <= 0.02
    assert (model.scores([r["text"] for r in rows]) >= 0.7).mean() >= 0.88


def test_few_toxic_rows_are_still_caught(spark):
    """Eleven toxic rows: folds of them would leave nothing to learn from."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels.filter("toxic = 1"), "doc_id").select("text").collect()
    assert (toxicity.fit(docs, labels).scores([r["text"] for r in rows]) >= 0.7).sum() >= len(rows) - 1
