"""From raw documents to token ids: each stage works on what the one before it kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.llm import byte_bpe, mixing, near_dup, quality_rules, secret_scan
from reviewmill.session import shared_dir

CACHE_SHARE = 0.2
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    (rules,) = quality_rules.fresh(docs, "rules")
    judged = quality_rules.judge(docs, rules)
    return judged.where(judged[rules]["kept"]).select(*[judged[f"`{c}`"] for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dup.drop_near_duplicates(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are replaced by a marker."""
    return secret_scan.mask_secrets(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document comes as often as its source's target has it taken, or not at all."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and whether they decode to its text."""
    columns = docs.select("doc_id", "source", "text")
    # The earlier stages have left the executors large: the codec's caches keep to a fifth of their bounds.
    rows = byte_bpe.encoded_and_decoded(columns, out="codec", share=CACHE_SHARE)
    same = F.col("codec.decoded") == F.coalesce("text", F.lit(""))
    return rows.select(
        "doc_id", "source", F.size("codec.ids").cast("long").alias("n_tokens"),
        F.col("codec.ids").alias("ids"), same.alias("round_trip"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good),
    ("near_duplicates", one_of_each),
    ("secrets", without_secrets),
    ("mix", mixed),
    ("tokens", encoded),
]

#: The robust estimate, the similarity components and the byte-pair merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
    return docs
