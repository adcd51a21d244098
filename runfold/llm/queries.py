"""One query for each operator over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runfold.llm import bpe, forest, gru_lm, langid, mixing, ngram_join, secrets, sharding, simhash, urls
from runfold.llm._common import Tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component under links of Jaccard 0.9 or more between sets of three-word shingles."""
    return ngram_join.join(table(spark, sf_dir, "documents"), width=3, percent=90)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, texts included, shuffled uniformly into 16 shards of exact sizes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.digest(sharding.shuffle(docs, 16))


def op3_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log-likelihood under the recurrent model and under add-one counts."""
    return gru_lm.score(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cell, its probability under raked weights, and whether it was drawn."""
    docs = table(spark, sf_dir, "documents")
    measured = Tables(spark, "mixing").keep(mixing.measure(docs), "measured")
    mixture = mixing.plan(measured)
    drawn = mixing.draw(measured, mixture)
    return drawn.select("doc_id", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.col("_p").alias("probability"), F.col("_kept").alias("kept"), F.lit(not mixture.unmet).alias("targets_met"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's BPE ids, by tree concatenation where the text has no cut, and what they decode to."""
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict under the fixed rules; without a rule that fits, allow."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by rank-order profiles learned from the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents").withColumn("_held", langid.held_out())
    profiles = langid.train(docs.where("NOT _held"))
    out = langid.predict(docs, profiles, keep=("doc_id", "_held"))
    return out.withColumnRenamed("_held", "held_out")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash, its edited text's, and how near they and the next document's are."""
    return simhash.edited(table(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of each hundredth vector, by a hash-prefix forest."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return forest.search(rows, rows.where("vec_id % 100 = 0"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: the base patterns, and what the Markov models take for random strings."""
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.scan(docs, secrets.train(docs)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_sharding": op2_sharding,
    "op3_gru_lm": op3_gru_lm,
    "op4_mixing": op4_mixing,
    "op5_bpe": op5_bpe,
    "op6_url_filter": op6_url_filter,
    "op7_language_id": op7_language_id,
    "op8_simhash": op8_simhash,
    "op9_neighbours": op9_neighbours,
    "op10_secrets": op10_secrets,
}

SQL: dict[str, str] = {
    "op6_url_filter": r"""
WITH cut AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fitted AS (
  SELECT *, host = 'org' OR host LIKE '%.org' AS org, host = 'com' OR host LIKE '%.com' AS com,
    host = 'example.org' OR host LIKE '%.example.org' AS example
  FROM cut),
ruled AS (
  SELECT page_id, host, path, CASE
    WHEN example AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN example AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN com AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN com AND path LIKE '/de/%' THEN 'com/de/'
    WHEN org AND path LIKE '/%' THEN 'org/' END AS rule
  FROM fitted)
SELECT *, CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
""",
}
