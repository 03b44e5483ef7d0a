"""Small awkward tables for the operators of this folder."""

import pytest

CLASHES = [
    "stats", "rules", "spans", "ids", "text_hash", "_text_hash", "size", "rank", "block", "node", "key", "low",
    "label", "copies", "_id", "_hash", "_doc", "u", "shard", "score", "cell", "host", "row", "page", "blocks",
    "digest", "component", "decoded", "codec", "licenses", "pii", "kinds", "body", "_body", "own", "text_2",
]

LONG = "In thaner of whist, erning onther and nd. " * 1500

ODD_TEXTS = [
    None, "", " \n\t ", "a", "a b c d", "The same few words here again.", "The same few words here again.",
    "x" * 5000, LONG, LONG + "end", "naïve Ünïcode 日本語 🙂 password = \"hunter2222\" done", "tie", "tie",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing columns."""
    rows = []
    for i, t in enumerate(ODD_TEXTS):
        rows.append((None if i == 3 else i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", None, "x"))
    rows += [rows[5], rows[5], (4, "another text under a used id", "en", "s1", 7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string")
    return df.select("doc_id", "text", "lang", "source", "n_chars", *[df["extra"].alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def none(odd):
    """The same columns, no rows."""
    return odd.limit(0)


def texts_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]
