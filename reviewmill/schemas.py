"""Table schemas. Nothing in the library infers a schema from data."""

from __future__ import annotations

from pyspark.sql import types as T

from .constants import CATEGORIES

REVIEWS = T.StructType(
    [
        T.StructField("review_id", T.LongType()),
        T.StructField("user_name", T.StringType()),
        T.StructField("score", T.IntegerType()),
        T.StructField("reviewed_at", T.TimestampType()),
        T.StructField("content", T.StringType()),
    ]
)

# Reviews of repeated landings; files are partitioned by ``landing``.
LANDED = T.StructType(
    [
        *REVIEWS.fields,
        T.StructField("row_digest", T.StringType()),
        T.StructField("landing", T.LongType()),
    ]
)

# Raw review files as scraped: no id; some have an unnamed index column in front.
RAW = T.StructType(
    [
        T.StructField("userName", T.StringType()),
        T.StructField("score", T.IntegerType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("content", T.StringType()),
    ]
)
RAW_INDEXED = T.StructType([T.StructField("_c0", T.LongType()), *RAW.fields])
RAW_NAMES = {"userName": "user_name", "at": "reviewed_at"}

# One line of a labelling answer, for from_json; the inner content is JSON once more.
RESPONSE_LINE = (
    "custom_id string, response struct<status_code:int, "
    "body:struct<choices:array<struct<message:struct<content:string>>>>>"
)


def golden(categories=CATEGORIES) -> T.StructType:
    """Reviews plus one string label per category."""
    labels = [T.StructField(c, T.StringType()) for c in categories]
    return T.StructType([*REVIEWS.fields, *labels])


def checkpoint(categories=CATEGORIES) -> T.StructType:
    """Label checkpoint: one row per labelled review and attempt."""
    keys = [T.StructField("review_id", T.LongType()), T.StructField("attempt", T.LongType())]
    labels = [T.StructField(f"{c}_pred", T.StringType()) for c in categories]
    return T.StructType([*keys, *labels])


def answers(categories=CATEGORIES) -> T.StructType:
    """Answers of a labelling service: one row per text, named by its digest."""
    labels = [T.StructField(f"{c}_pred", T.StringType()) for c in categories]
    return T.StructType([T.StructField("text_digest", T.StringType()), *labels])


def predictions(categories=CATEGORIES) -> T.StructType:
    """Labels of many runs; files are partitioned by the run's input, prompt and model."""
    labels = [T.StructField(f"{c}_pred", T.StringType()) for c in categories]
    run = [T.StructField(c, T.StringType()) for c in ("input", "prompt", "model")]
    return T.StructType([T.StructField("review_id", T.LongType()), *labels, *run])


def split(categories=CATEGORIES) -> T.StructType:
    """Text and 0/1 labels; files are partitioned by ``split``."""
    labels = [T.StructField(c, T.LongType()) for c in categories]
    return T.StructType(
        [T.StructField("content", T.StringType()), *labels, T.StructField("split", T.StringType())]
    )
