"""Multi-label evaluation: confusion counts, F1, recall, exact match, loss, best epoch.

One pass over the rows produces a table of (category, truth, prediction, n). It holds a
handful of rows per model, and every metric is arithmetic on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ABSENT, CATEGORIES, ERROR, NEG, THRESHOLD
from ..functions import labels as lb

_ALL = "(all)"


def mismatches(
    gold: DataFrame, predictions: DataFrame, categories=CATEGORIES, id_col: str = "review_id"
) -> DataFrame:
    """Paired rows in which some category differs, nulls compared as values."""
    paired = gold.join(predictions.select(id_col, *lb.pred_columns(categories)), id_col)
    same = F.lit(True)
    for c in categories:
        same = same & F.col(c).eqNullSafe(F.col(lb.pred(c)))
    return paired.where(~same)


def pair(
    gold: DataFrame, predictions: DataFrame, categories=CATEGORIES, id_col: str = "review_id",
    keep: list[str] | None = None,
) -> DataFrame:
    """Truth and prediction side by side, matched by id."""
    keep = keep or []
    return gold.select(id_col, *categories).join(
        predictions.select(id_col, *keep, *lb.pred_columns(categories)), id_col
    )


def with_predictions(
    df: DataFrame,
    categories=CATEGORIES,
    kind: str = "logit",
    threshold: float = THRESHOLD,
    suffix: str = "_logit",
) -> DataFrame:
    """Add ``{category}_prob`` and ``{category}_pred`` from model outputs.

    ``kind`` says what the outputs are: ``logit``, ``prob``, ``label`` (the integers 0 and 1, which
    are labels already and have themselves as probability), or ``auto``, which takes integer
    columns for labels and others for logits when any of them lies outside [0, 1].
    """
    columns = [f"{c}{suffix}" for c in categories]
    if kind == "auto":
        kind = detect_score_kind(df, columns)
    if kind not in ("logit", "prob", "label"):
        raise ValueError(f"unknown kind {kind!r}")
    for c, source in zip(categories, columns):
        prob = lb.sigmoid(source) if kind == "logit" else F.col(source).cast("double")
        df = df.withColumn(f"{c}_prob", prob)
    if kind == "label":
        names = {0: ABSENT, 1: NEG}
        picked = {}
        for c, source in zip(categories, columns):
            label = F.when(F.col(source) == 0, F.lit(names[0])).when(F.col(source) == 1, F.lit(names[1]))
            picked[lb.pred(c)] = label
        return df.withColumns(picked)
    return df.withColumns(
        {lb.pred(c): lb.threshold_label(f"{c}_prob", threshold) for c in categories}
    )


def detect_score_kind(df: DataFrame, columns: list[str]) -> str:
    """``label`` for integer columns, else ``logit`` or ``prob`` by the range of the values."""
    if all(df.schema[c].dataType.typeName() in ("byte", "short", "integer", "long") for c in columns):
        return "label"
    outside = F.lit(False)
    for c in columns:
        outside = outside | F.coalesce(~F.col(c).between(0.0, 1.0), F.lit(False))
    found = df.agg(F.coalesce(F.bool_or(outside), F.lit(False))).first()[0]
    return "logit" if found else "prob"


def confusion_matrix(
    df: DataFrame, categories=CATEGORIES, by: list[str] | None = None
) -> DataFrame:
    """(by, category, truth, prediction, n), with the pseudo-category ``(all)`` counting
    whole rows as match or miss. A null prediction counts as ERROR.
    """
    by = by or []

    def entry(category: str, truth: Column, prediction: Column) -> Column:
        return F.struct(
            F.lit(category).alias("category"),
            truth.alias("truth"),
            F.coalesce(prediction, F.lit(ERROR)).alias("prediction"),
        )

    whole = F.lit(True)
    entries = []
    for c in categories:
        truth, prediction = F.col(c).cast("string"), F.col(lb.pred(c)).cast("string")
        whole = whole & truth.eqNullSafe(prediction)
        entries.append(entry(c, truth, prediction))
    entries.append(
        entry(_ALL, F.lit("match"), F.when(whole, F.lit("match")).otherwise(F.lit("miss")))
    )
    return (
        df.select(*by, F.explode(F.array(*entries)).alias("e"))
        .groupBy(*by, "e.category", "e.truth", "e.prediction")
        .agg(F.count("*").alias("n"))
    )


def confusion_counts(
    matrix: DataFrame, by: list[str] | None = None, positive: str = NEG, negative: str = ABSENT
) -> DataFrame:
    """(by, category, tp, fp, fn, tn) with NEG as the positive class."""
    by = by or []

    def cell(truth: str, prediction: str) -> Column:
        hit = (F.col("truth") == truth) & (F.col("prediction") == prediction)
        return F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0))

    return (
        matrix.where(F.col("category") != _ALL)
        .groupBy(*by, "category")
        .agg(
            cell(positive, positive).alias("tp"),
            cell(negative, positive).alias("fp"),
            cell(positive, negative).alias("fn"),
            cell(negative, negative).alias("tn"),
        )
    )


def category_metrics(
    matrix: DataFrame, by: list[str] | None = None, positive: str = NEG, negative: str = ABSENT
) -> DataFrame:
    """(by, category, macro_f1, absent_recall, neg_recall).

    F1 is averaged over the labels that occur in truth or prediction, so a column that is
    ABSENT throughout and predicted so scores 1. Undefined recalls are 0.
    """
    by = by or []
    matrix = matrix.where(F.col("category") != _ALL)
    sides = matrix.select(
        *by,
        "category",
        F.explode(
            F.array(
                F.struct(
                    F.col("truth").alias("label"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("bigint").alias("predicted"),
                    F.when(F.col("truth") == F.col("prediction"), F.col("n"))
                    .otherwise(F.lit(0)).alias("hit"),
                ),
                F.struct(
                    F.col("prediction").alias("label"),
                    F.lit(0).cast("bigint").alias("support"),
                    F.col("n").alias("predicted"),
                    F.lit(0).cast("bigint").alias("hit"),
                ),
            )
        ).alias("s"),
    )
    per_label = sides.groupBy(*by, "category", F.col("s.label").alias("label")).agg(
        F.sum("s.support").alias("support"),
        F.sum("s.predicted").alias("predicted"),
        F.sum("s.hit").alias("hit"),
    )

    def recall(label: str) -> Column:
        value = F.try_divide("hit", "support")
        return F.coalesce(F.max(F.when(F.col("label") == label, value)), F.lit(0.0))

    f1 = 2 * F.col("hit") / (F.col("support") + F.col("predicted"))
    return per_label.groupBy(*by, "category").agg(
        F.avg(f1).alias("macro_f1"),
        recall(negative).alias("absent_recall"),
        recall(positive).alias("neg_recall"),
    )


def exact_match(matrix: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, rows, exact_match_ratio): share of rows with every category right."""
    by = by or []
    rows = matrix.where(F.col("category") == _ALL)
    right = F.coalesce(F.sum(F.when(F.col("prediction") == "match", F.col("n"))), F.lit(0))
    return rows.groupBy(*by).agg(
        F.sum("n").alias("rows"), F.try_divide(right, F.sum("n")).alias("exact_match_ratio")
    )


def metrics_long(
    matrix: DataFrame, by: list[str] | None = None, positive: str = NEG, negative: str = ABSENT
) -> DataFrame:
    """(by, section, metric, value): the whole report in long form."""
    by = by or []
    per_category = category_metrics(matrix, by, positive, negative)
    named = per_category.select(
        *by,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(section).alias("section"),
                        F.concat("category", F.lit(f"_{name}")).alias("metric"),
                        F.col(name).alias("value"),
                    )
                    for section, name in (
                        ("PRIMARY", "macro_f1"),
                        ("DIAGNOSTIC", "absent_recall"),
                        ("DIAGNOSTIC", "neg_recall"),
                    )
                ]
            )
        ).alias("m"),
    ).select(*by, "m.*")

    def single(df: DataFrame, section: str, metric: str, value: str) -> DataFrame:
        return df.select(
            *by, F.lit(section).alias("section"), F.lit(metric).alias("metric"),
            F.col(value).alias("value"),
        )

    mean = per_category.groupBy(*by).agg(F.avg("macro_f1").alias("v"))
    match = exact_match(matrix, by)
    return named.unionByName(single(mean, "PRIMARY", "macro_f1_mean", "v")).unionByName(
        single(match, "SECONDARY", "exact_match_ratio", "exact_match_ratio")
    )


def report_text(
    matrix: DataFrame, categories=CATEGORIES, positive: str = NEG, negative: str = ABSENT
) -> DataFrame:
    """One row ``report``: the text report with four decimals, from the few metric rows."""
    rule = "--------------------------"
    lines: list[tuple[str, str | None]] = [(rule, None), ("PRIMARY METRIC", None), (rule, None)]
    lines += [(f"{c} Macro F1-score", f"{c}_macro_f1") for c in categories]
    lines += [("Mean Macro F1-score", "macro_f1_mean")]
    lines += [(rule, None), ("SECONDARY METRIC (Exact Match)", None), (rule, None)]
    lines += [("Exact Match Ratio", "exact_match_ratio")]
    lines += [(rule, None), ("DIAGNOSTIC METRIC (Recall)", None), (rule, None)]
    for c in categories:
        lines += [
            (f"{c} ABSENT Recall", f"{c}_absent_recall"),
            (f"{c} NEG Recall", f"{c}_neg_recall"),
        ]

    def value(metric: str) -> Column:
        shown = F.max(F.when(F.col("metric") == metric, F.col("value")))
        return F.coalesce(F.format_string("%.4f", shown), F.lit("nan"))

    text = [
        F.lit(head) if metric is None else F.concat(F.lit(f"{head}: "), value(metric))
        for head, metric in lines
    ]
    return metrics_long(matrix, positive=positive, negative=negative).agg(
        F.concat_ws("\n", *text).alias("report")
    )


def batch_loss(
    df: DataFrame, categories=CATEGORIES, suffix: str = "_logit"
) -> DataFrame:
    """One row ``loss``: mean binary cross-entropy over all rows and categories.

    Targets are 0/1 columns named like the categories.
    """
    total = F.lit(0.0)
    for c in categories:
        total = total + lb.bce_with_logits(f"{c}{suffix}", F.col(c))
    return df.agg((F.avg(total) / F.lit(len(categories))).alias("loss"))


def best_epoch(
    log: DataFrame,
    metric: str,
    greater_is_better: bool = True,
    by: list[str] | None = None,
    epoch: str = "epoch",
) -> DataFrame:
    """The metrics row of the best epoch of each run; the earliest wins a tie.

    A metric may be named with or without its ``val_`` prefix. NaN never wins.
    """
    by = by if by is not None else ["run"]
    name = next((m for m in (metric, f"val_{metric}") if m in log.columns), None)
    if name is None:
        raise KeyError(f"metric {metric!r} not found in {log.columns}")
    score = F.col(name) if greater_is_better else -F.col(name)
    rank = F.struct(score.alias("score"), (-F.col(epoch)).alias("early"))
    usable = log.where(F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double")))
    best = usable.groupBy(*by).agg(F.max_by(F.struct(*log.columns), rank).alias("best"))
    return best.select("best.*")


def eval_output(
    df: DataFrame, categories=CATEGORIES, content: str = "content"
) -> DataFrame:
    """Text, then true label, predicted label and rounded probability per category."""
    columns = [F.col(content)]
    for c in categories:
        columns += [
            lb.decode_label(c).alias(c),
            lb.decode_label(lb.pred(c)).alias(lb.pred(c)),
            lb.round_probability(f"{c}_prob").alias(f"{c}_prob"),
        ]
    return df.select(*columns)
