"""From raw documents to token ids: language ID, near-duplicate removal, secret scan, mixing and BPE encoding.

Every stage works on all that its predecessor kept; between stages the documents are written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runfold.llm import bpe, langid, mixing, ngram_join, secrets
from runfold.llm._common import Tables

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MARK = "[SECRET]"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language: those that are null or without any letter go. A null ``lang`` becomes the predicted
    one. If no document has a label, nothing can be predicted, and only texts without letters go."""
    profiles = langid.train(docs)
    if not profiles:
        return docs.select(*COLUMNS).where(F.col("text").rlike(r"\p{L}"))
    out = langid.predict(docs, profiles, text="text", keep=tuple(COLUMNS))
    return out.where("lang_pred <> 'und'").select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, by five-word shingles and Jaccard 0.8: that of the smallest id. Rows are
    told apart by all their columns, so two texts with one id are two rows, and rows without an id take part and give way
    to those with one. Rows that are equal in all columns leave one."""
    own = docs.select(*COLUMNS)
    # what is null is named, as the hash passes over nulls
    own = own.withColumn("_row", F.xxhash64(*COLUMNS, *(F.col(c).isNull() for c in COLUMNS)))
    groups = ngram_join.join(own, width=5, percent=80, key="_row").select(F.col("doc_id").alias("_row"), "component_id").distinct()
    ids = own.select("_row", "doc_id").distinct().join(groups, "_row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    kept = ids.groupBy("component_id").agg(first.alias("first")).select("first._row")
    return own.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret."""
    ratio = secrets.train(docs)
    keep = tuple(c for c in COLUMNS if c != "text")
    out = secrets.scan(docs, ratio, keep=keep, redact=MARK)
    changed = F.size("spans") > 0
    return out.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.when(changed, F.length("redacted").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens are spread over sources, languages and topics as the targets say."""
    mixture = mixing.plan(mixing.measure(docs, keep=("source", "lang")))
    return mixing.draw(mixing.measure(docs, keep=tuple(COLUMNS)), mixture).where("_kept").select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's BPE ids."""
    out = bpe.encode(docs, keep=("doc_id", "lang", "source"))
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixture", mixture),
    ("token_ids", token_ids),
]

#: No SQL trains language profiles or Markov models, or merges byte pairs; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = tables.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
