"""One query for each operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, chat, embedding_dedup, language, mixing, order_minhash, set_join, token_files, toxicity, url_filter
from .common import work_dir, written

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of every text with end id 1, written in id order and read back."""
    path = work_dir(spark, "token-files")
    token_files.write_tokens(
        table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"), end_id=1, metadata=("source", "lang")
    )
    return token_files.crc32_of_ids(token_files.read_tokens(spark, path))


@query
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a reply chain, formatted, written, and read back."""
    texts = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    nodes = texts.union(extra).withColumn("node", F.row_number().over(by_turn))
    messages = nodes.select(
        F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text",
        F.length("text").alias("score"),
    )
    out = written(chat.format_chats(messages), "chats")
    turns = out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn(
        "loss", chat.trained_text(F.col("formatted"), F.col("loss_spans"))
    )
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL["op2_chat_format"] = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum(length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g'))
        + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) + 22)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


@query
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-word shingle sets of every text, linked at a Jaccard similarity of 0.75."""
    return set_join.jaccard_components(table(spark, sf_dir, "documents"))


ORACLE_SQL["op3_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (
    SELECT row_number() OVER () AS r, doc_id,
        list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
    FROM documents
), s AS (
    SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS g
    FROM w
), t AS (SELECT r, unnest(g) AS g FROM s),
hot AS (SELECT g FROM t GROUP BY g HAVING count(*) > 1), h AS (SELECT t.r, t.g FROM t JOIN hot ON hot.g = t.g),
c AS (SELECT x.r AS a, y.r AS b, count(*) AS n FROM h x JOIN h y ON x.g = y.g AND x.r <> y.r GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN s x ON x.r = a JOIN s y ON y.r = b WHERE 100 * n >= 75 * (len(x.g) + len(y.g) - n)),
p(r, q) AS (SELECT r, r FROM s UNION SELECT p.r, e.b FROM p JOIN e ON e.a = p.q)
SELECT s.doc_id, len(s.g)::INT AS n_shingles, min(o.doc_id) AS component_id FROM s JOIN p ON p.r = s.r JOIN s o ON o.r = p.q GROUP BY s.r, s.doc_id, len(s.g)
"""


def dated_list(pages: DataFrame) -> DataFrame:
    """A dated blocklist over the hosts of the pages: additions, removals, returns, by host, domain and section."""
    hosts = (
        pages.select(url_filter.host_of(F.col("url")).alias("host"), "page_id").filter("host is not null")
        .groupBy("host").agg(F.min("page_id").alias("m"), F.count("*").alias("c"))
    )
    hosts = written(hosts, "hosts")  # read five times below
    kind = F.element_at(F.array(F.lit("spam"), F.lit("adult"), F.lit("malware")), (F.col("m") % 3 + 1).cast("int"))

    def rows(where: str, key, category, day, action: str) -> DataFrame:
        return hosts.filter(where).select(key.alias("key"), category.alias("category"), day.cast("int").alias("day"), F.lit(action).alias("action"))

    host, day = F.col("host"), F.col("m") % 60
    section, part = F.concat("host", F.lit("/fr")), F.lit("section")
    entries = (
        rows("m % 2 = 0", host, kind, day, "add")
        .union(rows("m % 2 = 0", host, kind, day + 10 + F.col("c") % 20, "remove"))
        .union(rows("m % 2 = 0 and c % 2 = 1", host, kind, day + 40, "add"))
        .union(rows("m % 3 = 0", section, part, F.lit(5), "add"))
        .union(rows("m % 3 = 0", section, part, F.lit(70), "remove"))
    )
    domains = pages.sparkSession.createDataFrame(
        [("example.org", "tracker", 20, "add"), ("example.org", "tracker", 50, "remove"), ("example.net", "ads", 0, "add"),
         ("example.net", "ads", 15, "remove"), ("example.net", "ads", 75, "add")],
        "key string, category string, day int, action string",
    )
    return entries.union(domains).select("key", "category", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(day)").alias("at"), "action")


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the list entries active when it was fetched."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(page_id % 90 as int), 0, 0, cast(page_id * 7919 % 86400 as decimal(18,6)))")
    captures = pages.select(F.col("page_id").alias("id"), "url", fetched.alias("fetched_at"))
    return url_filter.evaluate(captures, dated_list(pages)).select(
        F.col("id").alias("page_id"), "host", "blocked", "n_rules", F.array_join("categories", ",").alias("categories"),
        F.col("active_since").cast("string").alias("active_since"),
    )


ORACLE_SQL["op4_url_filter"] = r"""
WITH p AS (
    SELECT page_id, nullif(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '\.$', ''), '') AS host,
        lower(regexp_replace(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/?([^?#]*)', 1), '^/+|/+$', '', 'g')) AS path,
        TIMESTAMP '2024-01-01' + to_days((page_id % 90)::INT) + to_seconds((page_id * 7919 % 86400)::BIGINT) AS fetched
    FROM pages
), h AS (SELECT host, min(page_id) AS m, count(*) AS c FROM p WHERE host IS NOT NULL GROUP BY host),
e AS (
    SELECT host AS key, ['spam', 'adult', 'malware'][m % 3 + 1] AS category, m % 60 AS d, 'add' AS action FROM h WHERE m % 2 = 0
    UNION ALL SELECT host, ['spam', 'adult', 'malware'][m % 3 + 1], m % 60 + 10 + c % 20, 'remove' FROM h WHERE m % 2 = 0
    UNION ALL SELECT host, ['spam', 'adult', 'malware'][m % 3 + 1], m % 60 + 40, 'add' FROM h WHERE m % 2 = 0 AND c % 2 = 1
    UNION ALL SELECT host || '/fr', 'section', 5, 'add' FROM h WHERE m % 3 = 0
    UNION ALL SELECT host || '/fr', 'section', 70, 'remove' FROM h WHERE m % 3 = 0
    UNION ALL VALUES ('example.org', 'tracker', 20, 'add'), ('example.org', 'tracker', 50, 'remove'), ('example.net', 'ads', 0, 'add'),
        ('example.net', 'ads', 15, 'remove'), ('example.net', 'ads', 75, 'add')
), u AS (
    SELECT key, category, TIMESTAMP '2024-01-01' + to_days(d::INT) AS f, max(action) AS action FROM e GROUP BY ALL
), i AS (
    SELECT * FROM (SELECT *, lead(f) OVER (PARTITION BY key, category ORDER BY f) AS t FROM u) WHERE action = 'add'
)
SELECT p.page_id, p.host, count(i.key) > 0 AS blocked, count(i.key)::BIGINT AS n_rules,
    coalesce(string_agg(DISTINCT i.category, ',' ORDER BY i.category), '') AS categories, max(i.f)::VARCHAR AS active_since
FROM p LEFT JOIN i ON p.fetched >= i.f AND (i.t IS NULL OR p.fetched < i.t)
    AND (p.host = i.key OR ends_with(p.host, '.' || i.key) OR p.host || '/' || p.path = i.key OR starts_with(p.host || '/' || p.path, i.key || '/') AND contains(i.key, '/'))
GROUP BY p.page_id, p.host
"""


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from labels of rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(toxicity.fold(F.col("doc_id"), 3) != 1)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", F.coalesce(toxicity.fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its half-edited text, with their likenesses."""
    return order_minhash.compare_with_next(table(spark, sf_dir, "documents"))


@query
def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from labelled rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.filter(toxicity.fold(F.col("doc_id"), 4) != 2))
    return language.predict(docs, model).select(
        "doc_id", F.coalesce(toxicity.fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


@query
def op8_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors within each label, by a random-projection forest."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


#: All pairs of a label; the forest finds all of these links on the small tables.
ORACLE_SQL["op8_embedding_neardup"] = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
g AS (
    SELECT r, label, e, sqrt(list_dot_product(e, e)) AS size FROM v
    WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
),
l AS (SELECT x.r AS a, y.r AS b FROM g x JOIN g y ON x.label = y.label AND len(x.e) = len(y.e) AND x.r <> y.r AND list_dot_product(x.e, y.e) / (x.size * y.size) >= 0.93),
p(r, q) AS (SELECT r, r FROM v UNION SELECT p.r, l.b FROM p JOIN l ON l.a = p.q),
c AS (SELECT p.r, min(v.vec_id) AS component_id FROM p JOIN v ON v.r = p.q GROUP BY p.r),
n AS (SELECT a AS r, count(*)::BIGINT AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c USING (r) LEFT JOIN n USING (r)
"""


@query
def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forced-boundary BPE of every text: counts and digests of ids and of the decoded text."""
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, tokenizer_file("byte_bpe_50k.json"), digests_only=True)


#: Shares of all tokens asked of the labelled domains.
MIX_TARGETS = {"good": 0.88, "poor": 0.08, "toxic": 0.04}


def labelled_domains(labels: DataFrame) -> DataFrame:
    """The labelled table as (doc_id, domain)."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain"))


@query
def op10_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents that bring expected domain tokens to their targets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    mixture, posteriors = mixing.fit(docs, labelled_domains(table(spark, sf_dir, "labels")), MIX_TARGETS)
    found = mixing.rates(posteriors, mixture)
    each = [F.get("posterior", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(mixture.model.domains)]
    return found.select("doc_id", "n_tokens", *each, "rate", "copies")
