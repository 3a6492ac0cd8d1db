"""URL filters with dated list entries, with DataFrame functions only.

List entries (key, category, at, action) become validity intervals: an ``add`` holds from its
time until the next entry of the same key and category. An as-of join evaluates every capture
against the entries that were active when it was fetched. A key is a host or one of its parent
domains (``example.com``), or a host with leading path segments (``a.example.com/x``).

Captures of one host may be a third of all rows, so rules are looked up once for each distinct
host, collected there into one array of intervals, and joined back on the host; Spark splits
that join where a host is skewed, or broadcasts the small side when it measures it small.

Defined results: a null or unparsable URL, or a null time, matches nothing; entries with a null
key, time or action are ignored; of entries at one time ``remove`` wins; an entry holds from its
own instant on and up to, not including, the next one; repeated captures repeat; repeated entries
count once; an empty list blocks nothing. Extra columns of the captures are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

_AUTHORITY = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port, trailing dot; null if there is none."""
    host = F.regexp_replace(F.regexp_extract(F.lower(F.trim(url)), _AUTHORITY, 1), r"\.$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """Path without query and fragment, no slash at either end."""
    path = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/?([^?#]*)", 1)
    return F.regexp_replace(path, r"^/+|/+$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """key, category, valid_from, valid_to (null: still active) of dated entries."""
    e = (
        entries.filter("key is not null and at is not null and action in ('add', 'remove')")
        .groupBy(F.lower("key").alias("key"), "category", "at")
        .agg(F.max("action").alias("action"))
    )
    later = Window.partitionBy("key", "category").orderBy("at")
    return (
        e.withColumn("valid_to", F.lead("at").over(later))
        .filter(F.col("action") == "add")
        .select("key", F.coalesce("category", F.lit("")).alias("category"), F.col("at").alias("valid_from"), "valid_to")
    )


def _dealt(rules: DataFrame, span: Column, first: Column, last: Column) -> DataFrame:
    """Rules once for each stretch of time in which they hold, between the first and the last capture."""
    start = F.greatest(span(F.col("valid_from")), first)
    end = F.least(span(F.coalesce(F.col("valid_to"), F.col("latest"))), last)
    return rules.withColumn("stretch", F.explode(F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<bigint>"))))


def evaluate(captures: DataFrame, entries: DataFrame, stretch_days: int = 30) -> DataFrame:
    """Every capture (id, url, fetched_at) against the entries active at its time.

    Returns id, host, blocked, n_rules, categories (array, sorted) and active_since (the latest
    start among the matching intervals).

    The captures are read once, to a narrow table. Rules meet the distinct hosts and paths first; then captures meet
    their hosts' and paths' intervals by stretches of ``stretch_days``, so that a hot host is dealt by time and the
    join can split what is left.
    """
    url = F.col("url")
    c = captures.select(F.monotonically_increasing_id().alias("row"), "id", "fetched_at", host_of(url).alias("host"), path_of(url).alias("path"))
    c = written(c, "captures")
    at = F.col("fetched_at")

    def span(x: Column) -> Column:
        return F.floor(F.unix_timestamp(x.cast("timestamp")) / F.lit(86400 * stretch_days)).cast("long")

    c = c.withColumn("stretch", span(at))
    rules = intervals(entries)
    range_ = c.agg(F.min("stretch").alias("low"), F.max("stretch").alias("high"), F.max("fetched_at").alias("latest"))  # one row
    rules = rules.join(F.broadcast(range_))
    rules = written(_dealt(rules, span, F.col("low"), F.col("high")).select("key", "category", "valid_from", "valid_to", "stretch"), "rules")
    hosts = c.select("host").filter("host is not null").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")
    )
    by_host = hosts.select("host", F.explode(suffixes).alias("key")).join(rules.filter(~F.col("key").contains("/")), "key")
    paths = rules.filter(F.col("key").contains("/"))
    path_hosts = paths.select(F.substring_index("key", "/", 1).alias("host")).distinct()
    segments = F.split("path", "/+")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.concat("host", F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")))
    targets = c.select("host", "path").filter("host is not null and path <> ''").distinct().join(path_hosts, "host", "left_semi")
    by_path = targets.select("host", "path", F.explode(prefixes).alias("key")).withColumn("key", F.lower("key")).join(paths, "key")
    active = (at >= F.col("valid_from")) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))
    found = c.join(by_host, ["host", "stretch"]).filter(active).select("row", "category", "valid_from").union(
        c.join(by_path, ["host", "path", "stretch"]).filter(active).select("row", "category", "valid_from")
    )
    each = found.groupBy("row").agg(F.count("*").alias("n"), F.collect_set("category").alias("categories"), F.max("valid_from").alias("active_since"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return c.join(each, "row", "left").select(
        "id", "host", (n > 0).alias("blocked"), n.alias("n_rules"), F.array_sort(F.coalesce("categories", F.array().cast("array<string>"))).alias("categories"), "active_since"
    )
