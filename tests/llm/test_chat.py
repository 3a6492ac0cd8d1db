from pyspark.sql import functions as F

from millrace.llm import chat, queries

SCHEMA = "tree long, node long, parent long, role string, text string, score double, leaf int"


def messages(spark):
    return spark.createDataFrame(
        [
            (1, 1, None, "user", "q", 0.0, 9), (1, 2, 1, "assistant", "a1", 5.0, 9), (1, 3, 1, "assistant", "a2", 1.0, 9), (1, 4, 3, "user", "more", 9.0, 9),
            (1, 5, 4, "assistant", None, 1.0, 9), (2, 1, None, "system", "<s>[INST] \\[/INST]</s>", None, 9), (2, 2, 1, None, "x", 1.0, 9),
            (3, 1, 2, "user", "cycle", 1.0, 9), (3, 2, 1, "user", "cycle", 1.0, 9), (4, 7, 99, "user", "orphan", 1.0, 9), (None, 1, None, "user", "null tree", 1.0, 9),
            (5, 1, None, "user", "tie", 1.0, 9), (5, 1, None, "user", "tie", 1.0, 9), (5, 3, 1, "b", "t", 1.0, 9), (5, 2, 1, "a", "t", 1.0, 9),
        ],
        SCHEMA,
    )


def test_best_branches(spark):
    got = {(r["tree"], r["leaf"]): r for r in chat.format_chats(messages(spark), top_k=1).collect()}
    assert set(got) == {(1, 5), (2, 2), (4, 7), (None, 1), (5, 2)}
    assert got[1, 5]["n_turns"] == 4 and got[1, 5]["branch_score"] == 11.0
    two = {(r["tree"], r["leaf"], r["rank"]) for r in chat.format_chats(messages(spark), top_k=2).collect()}
    assert {(1, 5, 1), (1, 2, 2), (5, 2, 1), (5, 3, 2)} <= two


def test_round_trip_and_loss(spark):
    rows = chat.format_chats(messages(spark), top_k=2).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.trained_text(F.col("formatted"), F.col("loss_spans"))).collect()
    got = {(r["tree"], r["leaf"]): r for r in rows}
    assert [tuple(t) for t in got[2, 2]["turns"]] == [("system", "<s>[INST] \\[/INST]</s>"), ("", "x")]
    assert got[1, 2]["loss"] == "a1" and [tuple(t) for t in got[1, 2]["turns"]] == [("user", "q"), ("assistant", "a1")]
    assert got[1, 5]["loss"] == "a2"


def test_escape_is_reversible(spark):
    texts = ["</s>", "<\\/s>", "<\\\\/s>", "[INST]", "[\\/INST]", "<<s>>", "\\", "<s", "", "[INST][/INST]</s><s>", "[ [/INST]", "😀</s>é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t"))).withColumn("u", chat.unescape(F.col("e")))
    for r in df.collect():
        assert r["u"] == r["t"]
        assert all(c not in r["e"] for c in ("</s>", "<s>", "[INST]", "[/INST]"))


def test_long_chains_and_empty_tables(spark):
    long = spark.createDataFrame([(1, i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", str(i), 1.0, 0) for i in range(70)], SCHEMA)
    r = chat.format_chats(long).withColumn("loss", chat.trained_text(F.col("formatted"), F.col("loss_spans"))).first()
    assert r["n_turns"] == 70 and r["loss"] == "".join(str(i) for i in range(1, 70, 2))
    assert chat.format_chats(messages(spark).limit(0)).count() == 0


def test_query_uses_no_python(spark):
    df = queries.op2_chat_format(spark, "/root/testdata/sf0.001")
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
    seven = df.filter("conv_id = -7").first()
    assert seven["n_turns"] == 2 and seven["loss_chars"] == len("</s>[INST] ok [/INST]")
