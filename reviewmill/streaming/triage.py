"""Triage of arriving reviews with Structured Streaming.

Scoring keeps no state, so the stream runs the same transform as the batch job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..constants import CATEGORIES, SCORE_BATCH, THRESHOLD
from ..operators.scoring import triage_reviews


def read_review_stream(
    spark: SparkSession,
    path: str,
    schema: StructType,
    fmt: str = "parquet",
    pattern: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Files of reviews as they arrive in ``path``."""
    reader = spark.readStream.schema(schema).format(fmt)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def triage_stream(
    reviews: DataFrame,
    load_model,
    categories=CATEGORIES,
    threshold: float = THRESHOLD,
    batch_size: int = SCORE_BATCH,
    content: str = "content",
) -> DataFrame:
    """Streaming twin of ``triage_reviews``."""
    return triage_reviews(reviews, load_model, categories, threshold, batch_size, content)


def start_triage(
    results: DataFrame,
    out_path: str,
    checkpoint_path: str,
    available_now: bool = True,
    interval: str = "30 seconds",
) -> StreamingQuery:
    """Write results as Parquet, exactly once per input file.

    ``checkpoint_path`` must be in storage that outlives the driver.
    """
    writer = (
        results.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint_path)
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()
