"""Frequency tables and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CATEGORIES


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Non-null values by falling frequency."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), column)


def composition(df: DataFrame, column: str) -> DataFrame:
    """Share of each non-null value in all rows, nulls included in the total."""
    total = df.count()
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.lit(total))


def label_distribution(
    df: DataFrame, categories: list[str] = CATEGORIES, by: list[str] | None = None
) -> DataFrame:
    """(category, label, n) over all categories in one pass; null labels are not counted."""
    by = by or []
    long = df.unpivot(by, categories, "category", "label")
    return (
        long.where(F.col("label").isNotNull())
        .groupBy(*by, "category", "label")
        .agg(F.count("*").alias("n"))
    )


def head(df: DataFrame, n: int = 2, id_col: str = "review_id") -> DataFrame:
    return df.orderBy(id_col).limit(n)
