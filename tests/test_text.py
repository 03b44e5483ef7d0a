import re
import string

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewmill.functions import text as tx


def values(spark, expr, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    return [r[1] for r in df.select("i", expr).orderBy("i").collect()]


def expected_normal_form(text, mode):
    """The five steps one by one, in plain Python."""
    text = re.sub(r"http\S+|www\.\S+", "", str(text).lower())
    text = re.sub(r"(.)\1{2,}", "\x01" if mode == "drop" else r"\1", text)
    text = re.sub(r"[^a-z0-9\s]", " ", text)
    return re.sub(r"\s+", " ", text).strip()


TRICKY = [
    "paraaaaah", "rp 5000", "a@b.com", "", "   ", "see HTTPS://x.y/z?q=1 now", "www.a.b c",
    "a b c\x1cd", "é" * 5 + "abc", "!!!aaa!!!bbb", "a\n\n\nb", "hhhttpx y", "İstanbul",
    "x" * 50_000, "!" * 50_000 + "ok", "http" , "httpa\x1fb", "aa  bb", "😀😀😀 fine",
]


def test_unit_rows(spark):
    assert values(spark, tx.normalize_text("content"), ["paraaaaah", "rp 5000", "a@b.com"]) == [
        "par h", "rp 5", "a b com"]
    assert values(spark, tx.normalize_text("content", "collapse"), ["paraaaaah"]) == ["parah"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.sampled_from("aab1 .!é\n\t \x1cHTTPhtpw:/") , max_size=40), min_size=80, max_size=120))
def test_normalize_matches_plain_steps(spark, texts):
    texts = [*texts, *TRICKY]
    for mode in ("drop", "collapse"):
        got = values(spark, tx.normalize_text("content", mode), texts)
        assert got == [expected_normal_form(t, mode) for t in texts]
    normal = values(spark, tx.normalize_text("content"), texts)
    assert values(spark, tx.normalize_text("content"), normal) == normal


def test_single_steps_compose_to_normal_form(spark):
    for mode in ("drop", "collapse"):
        steps = tx.squeeze_spaces(
            tx.keep_alphanumeric(
                tx.collapse_elongation(tx.strip_urls(tx.lower_text("content")), mode)
            )
        )
        assert values(spark, steps, TRICKY) == values(spark, tx.normalize_text("content", mode), TRICKY)


def test_word_counts(spark):
    texts = [*TRICKY, "a b c d e", "a b c d e f", " a  b c\td\ne f ", "a\x1cb"]
    assert values(spark, tx.word_count("content"), texts) == [len(t.split()) for t in texts]
    assert values(spark, tx.has_min_words("content", 6), texts) == [len(t.split()) >= 6 for t in texts]
    assert values(spark, tx.has_min_words("content", 1), texts) == [len(t.split()) >= 1 for t in texts]


def test_shingles(spark):
    texts = ["", "ab", "abc", "abcd", "aé😀b\nc", "aaaaaa"]
    grams = [[t[i:i + 3] for i in range(len(t) - 2)] for t in texts]
    assert values(spark, tx.char_shingles("content"), texts) == grams
    assert values(spark, F.array_sort(tx.distinct_shingles("content")), texts) == [
        sorted(set(g)) for g in grams]


def test_tokens_stop_words_and_ngrams(spark):
    texts = ["Driver yang ramah, a b1 x_y naïve 10", "", "satu", "satu dua"]
    tokens = [re.findall(r"(?u)\b\w\w+\b", t.lower()) for t in texts]
    assert values(spark, tx.word_tokens("content"), texts) == tokens
    kept = [[t for t in ts if t != "yang"] for ts in tokens]
    assert values(spark, tx.remove_stop_words(tx.word_tokens("content")), texts) == kept
    grams = [
        [" ".join(ts[i:i + n]) for n in (2, 3) for i in range(len(ts) - n + 1)] for ts in tokens]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string").select(
        "i", tx.word_tokens("content").alias("t"))
    assert [r[0] for r in df.orderBy("i").select(tx.word_ngrams("t")).collect()] == grams


def test_sanitise(spark):
    texts = ['  say "hi" \n', "plain", string.whitespace]
    assert values(spark, tx.sanitise_review("content"), texts) == [
        t.strip().replace('"', '\\"') for t in texts]
