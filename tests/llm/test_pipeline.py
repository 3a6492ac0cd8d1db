import hashlib
from collections import Counter

import corpus_pipeline
from millrace.llm import bpe, language, mixing, queries, set_join, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.orderBy("doc_id").collect()]
    model = language.fit(docs)
    rows = [r for r in rows if (p := model.predict(r["text"]))[0] != "und" and p[1] >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    df = spark.createDataFrame(rows, docs.schema)
    tox = toxicity.fit(df, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = tox.scores([r["text"] for r in rows])
    rows = [r for r, s in zip(rows, scores) if s < corpus_pipeline.TOXIC_SCORE]
    kept, sets = [], {}
    first = {r["doc_id"]: r["doc_id"] for r in rows}
    for r in rows:
        sets[r["doc_id"]] = frozenset(set_join.shingles(r["text"]).tolist())
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = first[i], first[j]
                first = {k: min(a, b) if v in (a, b) else v for k, v in first.items()}
    kept = [r for r in rows if first[r["doc_id"]] == r["doc_id"]]
    df = spark.createDataFrame(kept, docs.schema)
    mixture, _ = mixing.fit(df, queries.labelled_domains(spark.read.parquet(f"{SF}/labels.parquet")), queries.MIX_TARGETS)
    rates = mixture.rates(__import__("numpy").array([mixture.model.posterior(r["text"])[1] for r in kept]))
    codec = bpe.load(queries.tokenizer_file("byte_bpe_50k.json"))
    expected = Counter()
    for r, x in zip(kept, rates):
        text = r["text"]
        ids = ",".join(map(str, codec.encode(text).tolist()))
        expected[r["doc_id"], hashlib.sha256(ids.encode()).hexdigest()] += mixing.copies(x, r["doc_id"])
    got = Counter((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert +expected == got


def test_stages_keep_columns_and_take_odd_rows(spark, odd_docs, no_docs):
    odd = odd_docs.withColumnRenamed("n", "n_chars")
    for docs in (odd, no_docs.withColumnRenamed("n", "n_chars")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == docs.columns
            stage(spark, docs, SF).count()
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language id" and len(corpus_pipeline.STAGES) == 5
