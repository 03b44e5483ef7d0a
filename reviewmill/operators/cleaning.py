"""Row filters and text cleaning of raw reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import MIN_WORDS, TOP_STAR_FRACTION, TOP_STAR_SEED
from ..functions import text as tx
from .sampling import fraction_size, mark_sample


def newest_reviews(
    df: DataFrame, n: int, score: int | None = None, at: str = "reviewed_at", id_col: str = "review_id"
) -> DataFrame:
    """The ``n`` newest rows, optionally of one score; ties go to the lower id."""
    if score is not None:
        df = df.where(F.col("score") == score)
    return df.orderBy(F.col(at).desc(), F.col(id_col)).limit(n)


def score_filter(
    df: DataFrame,
    fraction: float = TOP_STAR_FRACTION,
    seed: int = TOP_STAR_SEED,
    id_col: str = "review_id",
) -> DataFrame:
    """All rows of 1-3 stars and a ``fraction`` of the pooled rows of 4-5 stars."""
    low = df.where(F.col("score").between(1, 3))
    top = df.where(F.col("score").between(4, 5))
    taken = mark_sample(top, [], fraction_size(fraction), seed, id_col).where("taken").drop("taken")
    return low.unionByName(taken)


def length_filter(df: DataFrame, min_words: int = MIN_WORDS, column: str = "content") -> DataFrame:
    """Rows of at least ``min_words`` whitespace-separated words; null text is dropped."""
    return df.where(tx.has_min_words(column, min_words))


def normalize_reviews(
    df: DataFrame, column: str = "content", elongation: str = "drop"
) -> DataFrame:
    return df.withColumn(column, tx.normalize_text(column, elongation))


def exact_dedup(df: DataFrame, column: str = "content", id_col: str = "review_id") -> DataFrame:
    """Keep the lowest id of every distinct text; null texts count as one text.

    Only 32-byte digests and ids are grouped, combined before the shuffle, so a text
    that makes up a third of the table costs one row per task. The texts themselves move
    once, by the unique id.
    """
    keep = (
        df.select(F.unhex(F.sha2(F.col(column), 256)).alias("digest"), id_col)
        .groupBy("digest")
        .agg(F.min(id_col).alias(id_col))
        .select(id_col)
    )
    return df.join(keep, id_col, "left_semi")
