"""Probability and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ABSENT, CATEGORIES, LABELS, NEG, THRESHOLD


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sigmoid(c) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(c)))


def is_neg(prob, threshold: float = THRESHOLD) -> Column:
    """Inclusive: a probability equal to the threshold is a complaint."""
    return _col(prob) >= F.lit(float(threshold))


def threshold_label(prob, threshold: float = THRESHOLD) -> Column:
    return F.when(is_neg(prob, threshold), F.lit(NEG)).otherwise(F.lit(ABSENT))


def round_probability(prob, digits: int = 4) -> Column:
    """Display value only; labels are decided on the unrounded probability."""
    return F.bround(_col(prob), digits)


def category_map(probs: dict[str, Column], threshold: float = THRESHOLD) -> Column:
    """``map<category, struct<label, probability>>`` in category order."""
    pairs = []
    for name, prob in probs.items():
        pairs += [
            F.lit(name),
            F.struct(
                threshold_label(prob, threshold).alias("label"),
                round_probability(prob).alias("probability"),
            ),
        ]
    return F.create_map(*pairs)


def active_complaints(probs: dict[str, Column], threshold: float = THRESHOLD) -> Column:
    """Names of the categories labelled NEG, in category order."""
    flags = [F.when(is_neg(prob, threshold), F.lit(name)) for name, prob in probs.items()]
    return F.array_compact(F.array(*flags))


def encode_label(c, on_error: str = "null") -> Column:
    """ABSENT or 0 -> 0, NEG or 1 -> 1; anything else is null or a failure."""
    c = _col(c)
    text = c.cast("string")
    code = F.when(text.isin(ABSENT, "0"), F.lit(0)).when(text.isin(NEG, "1"), F.lit(1)).cast("bigint")
    if on_error == "fail":
        text = F.concat(F.lit("not a label: "), F.coalesce(c.cast("string"), F.lit("null")))
        return F.coalesce(code, F.raise_error(text).cast("bigint"))
    if on_error != "null":
        raise ValueError(f"unknown on_error {on_error!r}")
    return code


def decode_label(c) -> Column:
    """0 -> ABSENT, 1 -> NEG, other values kept as text."""
    text = _col(c).cast("string")
    return F.when(text == "0", F.lit(ABSENT)).when(text == "1", F.lit(NEG)).otherwise(text)


def is_label(c) -> Column:
    return F.coalesce(_col(c).isin(LABELS), F.lit(False))


def in_unit_interval(c) -> Column:
    return F.coalesce(_col(c).between(0.0, 1.0), F.lit(False))


def bce_with_logits(logit, target) -> Column:
    """Binary cross-entropy on a logit, stable for large magnitudes."""
    x, y = _col(logit), _col(target)
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def pred(name: str) -> str:
    return f"{name}_pred"


def pred_columns(categories=CATEGORIES) -> list[str]:
    return [pred(c) for c in categories]
