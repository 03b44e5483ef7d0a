"""Checks that split a table into good rows and quarantined rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CATEGORIES
from ..functions import labels as lb


def _split(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, failing rows with the names of the failed checks)."""
    failed = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items()])
    )
    marked = df.withColumn("failed_checks", failed)
    good = marked.where(F.size("failed_checks") == 0).drop("failed_checks")
    return good, marked.where(F.size("failed_checks") > 0)


def validate_labels(
    df: DataFrame, columns: list[str] = CATEGORIES
) -> tuple[DataFrame, DataFrame]:
    """Every label column must be NEG or ABSENT."""
    return _split(df, {c: lb.is_label(c) for c in columns})


def validate_requests(
    df: DataFrame, content: str = "content", threshold: str | None = "threshold"
) -> tuple[DataFrame, DataFrame]:
    """Text must be non-empty; a threshold, where given, must lie in [0, 1]."""
    checks = {content: F.length(content) >= 1}
    if threshold is not None and threshold in df.columns:
        checks[threshold] = F.col(threshold).isNull() | lb.in_unit_interval(threshold)
    return _split(df, checks)


def validate_probabilities(
    df: DataFrame, columns: list[str]
) -> tuple[DataFrame, DataFrame]:
    return _split(df, {c: lb.in_unit_interval(c) for c in columns})


def encode_labels(
    df: DataFrame, categories: list[str] = CATEGORIES, on_error: str = "quarantine"
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Label columns as 0/1 integers.

    ``fail`` raises on the first value that is no label; ``quarantine`` returns
    (encoded rows, rows left out with their reasons).
    """
    if on_error == "fail":
        return df.withColumns({c: lb.encode_label(c, "fail") for c in categories})
    if on_error != "quarantine":
        raise ValueError(f"unknown on_error {on_error!r}")
    good, bad = _split(df, {c: lb.encode_label(c).isNotNull() for c in categories})
    return good.withColumns({c: lb.encode_label(c) for c in categories}), bad


def decode_labels(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: lb.decode_label(c) for c in columns})
