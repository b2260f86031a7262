"""A corpus in five stages: quality rules, near duplicates, personal data, mixing, tokens.

Every stage works on all rows that the one before kept. All but the last return the columns of
``documents``. ``run`` applies them to the whole table, and each stage reads what the one before
has written to the shared folder.

Null texts and ids pass through every stage as its operator says; an empty table passes as one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paramlens.llm import bpe, minmax, mixing, pii, quality
from paramlens.llm.common import Written

#: Shingles of five words and a similarity of 0.8; 32 bands of 5 miss such a pair with probability 3e-6.
NEAR = minmax.Params(words=5, num=80, den=100, bands=32, rows=5)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that a rule rejects."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, that of the least id; ids that are null come last.

    Texts are grouped, not ids, so rows that share an id or have none stay unless their text is
    like that of a row that stays. Texts without words are like no other; of equal rows one stays.
    """
    key = F.xxhash64("text")
    labels = minmax.groups(docs.select(key.alias("doc_id"), "text"), NEAR).distinct()
    named = docs.select("doc_id", key.alias("_key")).distinct().join(labels.withColumnRenamed("doc_id", "_key"), "_key")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")
    least = named.where(F.col("n_shingles") > 0).groupBy("component_id").agg(F.min(order).alias("_least")).select("_least.doc_id", "_least._key")
    kept = least.unionByName(named.where(F.col("n_shingles") == 0).select("doc_id", "_key"))
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("_key").alias("_text"))
    rows = docs.withColumn("_key", key).join(kept, (F.col("_key") == F.col("_text")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    same = W.partitionBy("doc_id", "_key").orderBy("text")
    return rows.withColumn("_row", F.row_number().over(same)).where(F.col("_row") == 1).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and terms that give it away."""
    return pii.sanitise(docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents of each source to its target weight, some more than once."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids), one row for each document taken."""
    encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing_weights", mixing_weights),
    ("tokens", tokens),
]
#: Span search and merges of byte pairs have no SQL; the tests hold brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = Written(stage(spark, docs, sf_dir)).df
    return STAGES[-1][1](spark, docs, sf_dir)
