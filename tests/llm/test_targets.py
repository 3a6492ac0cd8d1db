import pytest

import corpus_pipeline
from millrace.llm import mixing


def test_pipeline_asks_for_no_toxic_tokens(spark, tmp_path):
    """Toxic documents that the toxicity stage missed are not copied to a share of their own."""
    text = {"good": "calm river stone", "poor": "click offer now", "toxic": "vile slur rant"}
    domains = ["toxic"] + ["good"] * 70 + ["poor"] * 29
    docs = spark.createDataFrame([(i, f"{text[d]} " * 10) for i, d in enumerate(domains)], "doc_id long, text string")
    flags = [(i, int(d == "good"), int(d == "toxic")) for i, d in enumerate(domains)]
    spark.createDataFrame(flags, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = [domains[r["doc_id"]] for r in corpus_pipeline.mix_to_targets(spark, docs, str(tmp_path)).collect()]
    assert got.count("toxic") <= 2 and got.count("good") > 70 and 0 < got.count("poor") < 29


def test_every_unknown_target_is_an_error(spark):
    docs = spark.createDataFrame([(1, "good stuff"), (2, "bad thing")], "doc_id long, text string")
    labelled = spark.createDataFrame([(1, "a"), (2, "b"), (3, "gone")], "doc_id long, domain string")
    with pytest.raises(ValueError, match="typo"):
        mixing.fit(docs, labelled, {"a": 0.9, "typo": 0.1})
    with pytest.warns(UserWarning, match="gone"):
        mixing.fit(docs, labelled, {"a": 0.9, "gone": 0.1})
