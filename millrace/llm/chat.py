"""Chat formatting over reply trees, with DataFrame functions only.

Messages form trees. Pointer-doubling self-joins carry every message to its root in
``log2(depth)`` rounds, adding up scores; leaves are ranked within their tree by the score of
the whole branch (ties: longer branch, then smaller leaf), and the chosen branches are expanded
by the same pointers and formatted.

Template: ``<s>[INST] role [/INST]text</s>`` for each turn. A control string inside a role or
a text gets a backslash after its first character (one more if some stand there already), which
is taken off again when reading, so every text comes back unchanged.

Defined results: null role or text is empty; a message whose parent is not in its tree is a
root; messages on a cycle belong to no branch; a null tree id is one tree; a repeated node id in
a tree keeps the row that is smallest by (parent, role, text, score); an empty table gives no
rows. Columns other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, written

OPEN, MID, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
_CONTROL = r"(/?s>|/?INST\])"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])\\(\\*)" + _CONTROL, "$1$2$3")


def branches(messages: DataFrame, top_k: int = 1) -> DataFrame:
    """Rows of the best ``top_k`` branches of every tree, root first.

    ``messages``: tree, node, parent, role, text, score. Returns tree, leaf, rank,
    branch_score, pos (0 at the root), role, text.
    """
    m = messages.select(
        "tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    ).filter("node is not null")
    m = m.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("tree", "node", "m.*")
    m = written(m, "messages")
    known = m.select(F.col("tree").alias("t2"), F.col("node").alias("n2"))
    links = (
        m.join(known, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("parent") == F.col("n2")), "left")
        .select("tree", "node", F.col("n2").alias("up"), "score", F.when(F.col("n2").isNull(), 0).otherwise(1).cast("long").alias("steps"))
    )
    first = written(links, "chat-up")
    nodes_most = first.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    # ``rounds`` keeps the messages whose pointer has not passed their root; the others are done.
    tables = [first]
    rounds, done = [first.filter("up is not null")], [first.filter("up is null")]
    while 2 ** (len(rounds) - 1) <= nodes_most and rounds[-1].limit(1).count():
        s, ended = rounds[-1], done[0]
        for more in done[1:]:
            ended = ended.union(more)
        ahead = s.union(ended).select(F.col("tree").alias("t2"), F.col("node").alias("n2"), F.col("up").alias("up2"), F.col("score").alias("s2"), F.col("steps").alias("k2"))
        nxt = written(
            s.join(ahead, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("up") == F.col("n2"))).select(
                "tree", "node", F.col("up2").alias("up"), (F.col("score") + F.col("s2")).alias("score"), (F.col("steps") + F.col("k2")).alias("steps")
            ),
            "chat-up",
        )
        tables.append(nxt)
        rounds.append(nxt.filter("up is not null"))
        done.append(nxt.filter("up is null"))
    whole = done[0]
    for more in done[1:]:
        whole = whole.union(more)
    parents = rounds[0].select(F.col("tree").alias("t2"), F.col("up").alias("n2")).distinct()
    leaves = whole.join(
        parents, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2")), "left_anti"
    )
    best = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("steps"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_k)
    path = chosen.select("tree", F.col("node").alias("leaf"), "rank", F.col("score").alias("branch_score"), F.col("steps").alias("pos"), "node")
    path = written(path, "chat-path")
    for k, s in enumerate(rounds[:-1]):  # each round writes what it adds: the plan would double
        up = s.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), "up")
        higher = path.join(up, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2"))).select(
            "tree", "leaf", "rank", "branch_score", (F.col("pos") - 2**k).alias("pos"), F.col("up").alias("node")
        )
        path = path.union(written(higher, "chat-path"))
    drop_written(m.sparkSession, *tables)
    body = m.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), "role", "text")
    return path.join(body, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2"))).select(
        "tree", "leaf", "rank", "branch_score", "pos", "role", "text"
    )


def format_chats(messages: DataFrame, top_k: int = 1, trained_role: str = "assistant") -> DataFrame:
    """One conversation for each chosen branch.

    Returns tree, leaf, rank, branch_score, n_turns, formatted, and loss_spans: where the
    trained role's texts stand in ``formatted`` (code points from 0, still escaped).
    """
    role, text = escape(F.col("role")), escape(F.col("text"))
    rows = branches(messages, top_k).withColumn("head", F.concat(F.lit(OPEN), role, F.lit(MID))).withColumn("body", text)
    rows = rows.withColumn("piece_len", F.length("head") + F.length("body") + len(CLOSE))
    turn = Window.partitionBy("tree", "leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("piece_len").over(turn), F.lit(0).cast("long")))
    entry = F.struct(
        "pos", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), (F.col("role") == trained_role).alias("trained"),
        (F.col("at") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"),
    )
    grouped = rows.groupBy("tree", "leaf", "rank", "branch_score").agg(F.sort_array(F.collect_list(entry)).alias("turns"))
    return grouped.select(
        "tree", "leaf", "rank", "branch_score", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    pieces = F.split(formatted, CLOSE)
    head = r"(?s)\A<s>\[INST\] (.*?) \[/INST\]"
    return F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda p: F.struct(unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_replace(p, head, "")).alias("text")),
    )


def trained_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(loss_spans, lambda s: unescape(F.substring(formatted, s["start"] + F.lit(1), s["length"]))), ""
    )
