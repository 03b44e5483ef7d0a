"""Text expressions. All of them are built-in Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import MIN_WORDS, N_GRAM, STOP_WORDS

# Whitespace as Python's str.split sees it: Unicode White_Space plus U+001C..U+001F.
_SPACE = r"\s\x1c-\x1f"
_TOKEN = rf"(?U)[^{_SPACE}]+"
_URL = rf"(?U)http[^{_SPACE}]+|www\.[^{_SPACE}]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lower_text(c) -> Column:
    return F.lower(_col(c).cast("string"))


def strip_urls(c) -> Column:
    return F.regexp_replace(_col(c), _URL, "")


def collapse_elongation(c, mode: str = "drop") -> Column:
    """Runs of three or more of one character: removed (``drop``) or cut to one (``collapse``)."""
    if mode not in ("drop", "collapse"):
        raise ValueError(f"unknown elongation mode {mode!r}")
    return F.regexp_replace(_col(c), r"(.)\1{2,}", " " if mode == "drop" else "$1")


def keep_alphanumeric(c) -> Column:
    return F.regexp_replace(_col(c), rf"(?U)[^a-z0-9{_SPACE}]", " ")


def squeeze_spaces(c) -> Column:
    return F.trim(F.regexp_replace(_col(c), rf"(?U)[{_SPACE}]+", " "))


def normalize_text(c, elongation: str = "drop") -> Column:
    """Lower-case, strip URLs, treat elongation, keep ``[a-z0-9]``, squeeze spaces.

    Every character outside ``[a-z0-9]`` ends up as a space, so runs of such characters
    need no elongation step, and the last three steps share two passes over the text.
    """
    text = strip_urls(lower_text(c))
    if elongation == "drop":
        text = F.regexp_replace(text, r"([a-z0-9])\1{2,}|[^a-z0-9]+", " ")
        text = F.regexp_replace(text, " {2,}", " ")
    elif elongation == "collapse":
        text = F.regexp_replace(text, r"([a-z0-9])\1{2,}", "$1")
        text = F.regexp_replace(text, "[^a-z0-9]+", " ")
    else:
        raise ValueError(f"unknown elongation mode {elongation!r}")
    return F.trim(text)


def word_count(c) -> Column:
    return F.regexp_count(_col(c), F.lit(_TOKEN))


def has_min_words(c, min_words: int = MIN_WORDS) -> Column:
    """``word_count(c) >= min_words``, decided without reading past the last word needed."""
    if min_words <= 0:
        return _col(c).isNotNull()
    more = rf"(?:[^{_SPACE}]++[{_SPACE}]++){{{min_words - 1}}}" if min_words > 1 else ""
    return _col(c).rlike(rf"(?U)\A[{_SPACE}]*+{more}[^{_SPACE}]")


def null_to_empty(c) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def char_shingles(c, n: int = N_GRAM) -> Column:
    """All character n-grams, in order; empty for texts shorter than ``n``."""
    # Each match consumes one code point and looks ahead over n, so grams overlap.
    return F.regexp_extract_all(_col(c), F.lit(rf"(?s)(?=(.{{{n}}}))."), F.lit(1))


def distinct_shingles(c, n: int = N_GRAM) -> Column:
    return F.array_distinct(char_shingles(c, n))


def jaccard(a, b) -> Column:
    """Exact Jaccard similarity of two arrays without repeats; two empty arrays give 1."""
    a, b = _col(a), _col(b)
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared, F.size(a) + F.size(b) - shared), F.lit(1.0))


def word_tokens(c) -> Column:
    """Lower-case words of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))


def remove_stop_words(tokens, stop_words=STOP_WORDS) -> Column:
    words = list(stop_words)
    if not words:
        return _col(tokens)
    return F.filter(_col(tokens), lambda t: ~t.isin(words))


def word_ngrams(tokens, low: int = 2, high: int = 3) -> Column:
    """Space-joined n-grams of ``low`` to ``high`` words, shorter ones first."""
    tokens = _col(tokens)

    def grams(n: int) -> Column:
        starts = F.when(
            F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)
        ).otherwise(F.array().cast("array<int>"))
        return F.transform(
            starts, lambda i: F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)])
        )

    return reduce(F.concat, [grams(n) for n in range(low, high + 1)])


def sanitise_review(c) -> Column:
    """Trim and escape double quotes, for text quoted inside a prompt."""
    stripped = F.regexp_replace(
        _col(c).cast("string"), rf"(?U)\A[{_SPACE}]+|[{_SPACE}]+\z", ""
    )
    return F.replace(stripped, F.lit('"'), F.lit('\\"'))
