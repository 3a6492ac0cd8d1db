from collections import Counter

import corpus_pipeline

A = "the cat sat on the mat and then the dog sat on the log near the old mill"
B = "a quite different text about rivers and stones and the slow boats that go down to the sea"
C = "one more of them on bread and salt and on the long roads over the hills in winter"


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect())


def test_repeated_rows_null_ids_and_ids_with_two_texts(spark):
    assert kept(spark, [(1, B, "en"), (2, A, "en"), (2, B, "en")]) == Counter([(1, B), (2, A)])
    rows = [(4, A, "en")] * 5 + [(7, A, "fr")] + [(None, A, "en"), (None, B, "en"), (None, B, "en"), (None, C, None)]
    rows += [(9, None, "en"), (9, None, "en"), (10, None, "en"), (11, "", "en")]
    assert kept(spark, rows) == Counter([(4, A), (None, B), (None, C), (9, None), (10, None), (11, "")])


def test_frequent_tokens_come_without_rows(spark):
    """The driver gets 100,000 frequent tokens as columns; as rows they took 20 MB and more of its Python."""
    import tracemalloc

    import numpy as np
    from pyspark.sql import functions as F

    from millrace.llm import set_join

    d = spark.range(100_000).select(F.array(F.xxhash64("id")).alias("t"), F.array(F.lit(50)).alias("c"))
    tracemalloc.start()
    t, df = set_join._frequent(d, 0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert t.dtype == np.uint64 and len(t) == 100_000 and (t[1:] > t[:-1]).all() and (df == 50).all()
    assert most < 12e6
