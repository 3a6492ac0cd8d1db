"""The training-text pipeline: language, toxicity, near-duplicates, mixing, encoding.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; all but
the last return the columns of ``documents``. ``run`` writes each stage's rows as Parquet to the
shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, language, mixing, set_join, toxicity
from millrace.llm.common import work_dir, written
from millrace.llm.queries import MIX_TARGETS, labelled_domains, table, tokenizer_file

#: A language prediction below this score is rejected.
LEAST_LANGUAGE_SCORE = 0.2
#: A toxicity score from here on is rejected.
TOXIC_SCORE = 0.7
#: Shares of all tokens asked of the domains that the toxicity stage leaves.
TARGETS = {d: share for d, share in MIX_TARGETS.items() if d != "toxic"}


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of the learned ones; texts without letters go.

    Languages are only weighed against each other, so a text in an unlearned language, or of random
    letters, gets one of them and stays; a score below the threshold takes three near-equal languages.
    """
    model = language.fit(docs.select("doc_id", "text", "lang"))
    if not model.languages:
        return docs
    return language.keep(docs, model, LEAST_LANGUAGE_SCORE)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labels, scores below the threshold."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.keep(docs, model, TOXIC_SCORE)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of every class of near duplicates.

    A document is an id with a text: repeated rows are one document, of which the smallest row stays;
    an id on two texts is two documents. Null ids are grouped like others and come last in their class.
    Texts without words are near nothing.
    """
    key = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)
    keyed = docs.withColumn("_key", key)
    groups = written(set_join.jaccard_components(keyed.select("_key", "text"), id_col="_key"), "groups")
    rows = groups.groupBy(F.col("doc_id").alias("_key"), "component_id").agg(F.count("*").alias("n"))
    named = rows.join(keyed.select("_key", "doc_id").distinct(), "_key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_key"))
    stay = named.groupBy("component_id").agg(first.alias("first")).select(F.col("first._key").alias("_key")).distinct()
    # What does not just stay: keys to drop, and keys of repeated rows.
    fate = rows.groupBy("_key").agg(F.sum("n").alias("n")).join(stay.withColumn("stays", F.lit(True)), "_key", "left")
    fate = written(fate.select("_key", F.coalesce("stays", F.lit(False)).alias("stays"), "n").filter("not stays or n > 1"), "fates")
    single = keyed.join(fate.select("_key"), "_key", "left_anti").select(*docs.columns)
    again = fate.filter("stays")
    if again.isEmpty():
        return single
    # Equal rows are taken together before they move.
    repeated = keyed.join(again.select("_key"), "_key", "left_semi").groupBy("_key").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return single.union(repeated.select("row.*"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as its fitted rate says; toxic ones that were missed are no domain here.

    A target of 0 for them would leave only the few documents of the least toxic posterior.
    """
    labelled = labelled_domains(table(spark, sf_dir, "labels")).filter(F.col("domain").isin(list(TARGETS)))
    mixture, _ = mixing.fit(docs.select("doc_id", "text"), labelled, TARGETS)
    return mixing.resample(docs, mixture)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every kept document."""
    return bpe.encode_documents(docs, tokenizer_file("byte_bpe_50k.json"), digests_only=True)


STAGES = [
    ("language id", keep_known_language),
    ("toxicity", drop_toxic),
    ("n-gram jaccard join", one_of_each_group),
    ("mixing to target weights", mix_to_targets),
    ("bpe encoding", encode),
]
#: No SQL can express the learned stages; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_dir(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
