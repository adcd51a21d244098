"""URL filters: host-suffix and path-prefix expressions of each URL, joined with the rules by short hash prefixes.

Every URL is expanded into the pairs (host suffix, path prefix) that some rule could have: suffixes with as many labels
as some rule's host, prefixes as long as some rule's path. Each pair is hashed (SHA-256); the join is on the first eight
hex digits alone, then the full digests confirm what it found, and the longest rule that fits decides (of equally long
ones the one with the longer host).

Nulls and URLs without ``://`` have an empty host and path, fit no rule and get the default verdict. Very long URLs are
expanded like others: the pairs of one are bounded by the rules' label counts and path lengths, not by its own length.
Repeated rows are judged one by one. An empty table gives an empty result. Other columns, whatever their names, are not
read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of rules, with what a row takes besides its texts, up to which they are broadcast; more are joined by a shuffle.
MOST_BROADCAST, ROW_BYTES = 16 << 20, 160

#: (verdict, host, path)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path).cast("binary"), 256)


def expressions(host: Column, path: Column, labels: Sequence[int], lengths: Sequence[int]) -> Column:
    """The digests of all pairs of a host suffix with so many labels and a path prefix of such a length."""
    suffixes = F.array_distinct(F.transform(F.array(*map(F.lit, labels)), lambda n: F.call_function("substring_index", host, F.lit("."), -n)))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: F.length(path) >= n), lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: _digest(s, p))))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, *, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """``key``, host, path, rule (host and path of the rule that decides, else null) and verdict of each row."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    rules = rules.select("verdict", "host", "path").distinct()
    size = F.sum(2 * (F.octet_length("host") + F.octet_length("path")) + ROW_BYTES)
    n, size, labels, lengths = rules.agg(F.count("*"), size, F.collect_set(F.size(F.split("host", r"\."))), F.collect_set(F.length("path"))).first()
    rows = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.monotonically_increasing_id().alias("row"))
    made = expressions(F.col("host"), F.col("path"), sorted(labels), sorted(lengths)) if n else F.array().cast("array<string>")
    keys = rows.select("*", F.explode_outer(made).alias("digest")).withColumn("short", F.substring("digest", 1, 8))
    known = rules.select(_digest(F.col("host"), F.col("path")).alias("r_digest"), F.struct(
        (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("hosts"), F.col("verdict"), F.concat("host", "path").alias("rule")).alias("fit"))
    known = known.withColumn("r_short", F.substring("r_digest", 1, 8))
    known = F.broadcast(known) if (size or 0) <= MOST_BROADCAST else known
    hits = keys.join(known, F.col("short") == F.col("r_short"), "left")
    hits = hits.withColumn("fit", F.when(F.col("digest") == F.col("r_digest"), F.col("fit")))  # another rule of the same prefix is none
    best = hits.groupBy("row", "key", "host", "path").agg(F.max("fit").alias("fit"))
    return best.select(F.col("key").alias(key), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.lit(default)).alias("verdict"))
