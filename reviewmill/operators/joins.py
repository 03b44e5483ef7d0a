"""Equi-join of rows to a per-key table when a few keys may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

MAX_HOT_KEYS = 1024


def lookup_join(
    rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner"
) -> DataFrame:
    """Join ``rows`` to ``table``, which has one row, or a bounded few, per key.

    ``weight`` is a column of ``table``: how many of the ``total`` rows carry the key.
    Keys above ``total / MAX_HOT_KEYS`` rows number fewer than ``MAX_HOT_KEYS``, so that
    part of the table is broadcast and its rows are never shuffled by the hot key. All
    other keys take an ordinary shuffled join, in which no key is hot. The plan is the same
    at every size. ``table`` holds keys, ids and numbers, never texts: a broadcast row is small.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unknown join type {how!r}")
    limit = total // MAX_HOT_KEYS
    table = cut_lineage(table)
    hot = table.where(F.col(weight) > limit)
    cold = table.where(F.col(weight) <= limit)
    hot_rows = rows.join(F.broadcast(hot), keys)
    cold_rows = rows.join(F.broadcast(hot.select(keys).distinct()), keys, "left_anti")
    return hot_rows.unionByName(cold_rows.join(cold, keys, how))
