"""Score a split, report on it and save the predictions."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from ..constants import CATEGORIES, THRESHOLD
from ..functions import labels as lb
from ..operators.features import baseline_logits
from ..operators.metrics import confusion_matrix, eval_output, metrics_long, with_predictions
from ..operators.scoring import score_reviews
from ..session import cut_lineage
from ..sources.tables import read_split, write_csv


def evaluate(
    split_rows: DataFrame,
    load_model,
    categories=CATEGORIES,
    threshold: float = THRESHOLD,
) -> tuple[DataFrame, DataFrame]:
    """(metrics in long form, text with true label, predicted label and probability).

    ``split_rows`` holds 0/1 labels, as the split files do. ``load_model`` is a loader as in
    ``score_reviews``, or a fitted baseline. Rows are scored once: the scored table is written
    down and both results read it. The matrix of a few rows per category is written as well.
    """
    named = split_rows.withColumns({c: lb.decode_label(c) for c in categories})
    if isinstance(load_model, PipelineModel):
        logits = baseline_logits(load_model, named, categories)
    else:
        logits = score_reviews(named, load_model, categories)
    scored = cut_lineage(with_predictions(logits, categories, "logit", threshold))
    matrix = cut_lineage(confusion_matrix(scored, categories))
    return metrics_long(matrix), eval_output(scored, categories)


def evaluate_split(
    spark: SparkSession,
    splits_path: str,
    split: str,
    load_model,
    output_path: str | None = None,
    categories=CATEGORIES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Metrics of one split read from its files; predictions are saved when a path is given."""
    rows = read_split(spark, splits_path, split, categories)
    report, output = evaluate(rows, load_model, categories, threshold)
    if output_path:
        write_csv(output, output_path)
    return report
