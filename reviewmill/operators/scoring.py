"""Batched scoring with a pluggable model, and per-row external classification."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CATEGORIES, ERROR, SCORE_BATCH, THRESHOLD
from ..functions import labels as lb
from ..functions import text as tx


def score_reviews(
    df: DataFrame,
    load_model: Callable[[], Callable[[list[str]], object]],
    categories=CATEGORIES,
    batch_size: int = SCORE_BATCH,
    content: str = "content",
) -> DataFrame:
    """Add ``{category}_logit`` columns.

    ``load_model`` runs once per task and returns a function from a list of texts to one
    row of logits per text. Rows stay where they are; works on batches and streams.
    """

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for batch in batches:
            texts, rows = batch.tolist(), []
            for start in range(0, len(texts), batch_size):
                rows.extend([float(x) for x in r] for r in model(texts[start : start + batch_size]))
            yield pd.Series(rows, dtype=object)

    # Only the text goes through Python; the other columns stay in the JVM.
    run = F.pandas_udf(score, T.ArrayType(T.DoubleType()))
    scored = df.withColumn("_logits", run(tx.null_to_empty(content)))
    return scored.select(*df.columns, *[F.col("_logits")[i].alias(f"{c}_logit") for i, c in enumerate(categories)])


def triage(
    scored: DataFrame,
    categories=CATEGORIES,
    threshold: float = THRESHOLD,
    content: str = "content",
) -> DataFrame:
    """Logit columns -> text, map of label and probability, and the active complaints."""
    probs = {c: F.col(f"{c}_prob") for c in categories}
    rest = [c for c in scored.columns if c not in {f"{k}_logit" for k in categories}]
    with_probs = scored.withColumns(
        {f"{c}_prob": lb.sigmoid(f"{c}_logit") for c in categories}
    )
    return with_probs.select(
        *[tx.null_to_empty(c).alias(c) if c == content else F.col(c) for c in rest],
        lb.category_map(probs, threshold).alias("categories"),
        lb.active_complaints(probs, threshold).alias("active_complaints"),
    )


def triage_reviews(
    df: DataFrame,
    load_model,
    categories=CATEGORIES,
    threshold: float = THRESHOLD,
    batch_size: int = SCORE_BATCH,
    content: str = "content",
) -> DataFrame:
    scored = score_reviews(df, load_model, categories, batch_size, content)
    return triage(scored, categories, threshold, content)


class RateLimited(Exception):
    """Raised by a classifier that wants to be called again later."""


def _call(classify, text: str, attempts: int, wait: Callable[[float], None]) -> dict | None:
    """Answer of ``classify``, retried on rate limits only; None for any other failure."""
    for attempt in range(attempts):
        try:
            return classify(text)
        except RateLimited:
            if attempt + 1 == attempts:
                raise
            wait(min(max(2.0**attempt, 1.0), 60.0))
        except Exception:
            return None
    return None


def classify_external(
    df: DataFrame,
    load_classifier: Callable[[], Callable[[str], dict]],
    categories=CATEGORIES,
    attempts: int = 5,
    wait: Callable[[float], None] = time.sleep,
    content: str = "content",
) -> DataFrame:
    """Add ``{category}_pred`` from a service called once per row.

    Rate limits are retried after 1, 2, 4, ... at most 60 seconds and fail the task when
    the attempts run out; any other failure makes the whole row ERROR. Null text is asked
    about as empty text. A rerun of a task calls the service again; ``plans.labelling.label_once`` does not.
    """

    def label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        classify = load_classifier()
        for batch in batches:
            answers = [_call(classify, t, attempts, wait) for t in batch]
            rows = [[ERROR if a is None else a.get(c, ERROR) for c in categories] for a in answers]
            yield pd.Series(rows, dtype=object)

    # A service must be asked once per row, whatever later reads of its columns the plan holds.
    run = F.pandas_udf(label, T.ArrayType(T.StringType())).asNondeterministic()
    labelled = df.withColumn("_labels", run(tx.null_to_empty(content)))
    return labelled.select(*df.columns, *[F.col("_labels")[i].alias(lb.pred(c)) for i, c in enumerate(categories)])
