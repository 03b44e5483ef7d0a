"""Secret scan: trigram queries, verification, masking, and the SQL twin."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from checks.compare import compare, connect
from reviewmill.llm import secret_scan as ss
from reviewmill.llm.common import REGISTRY, SQL

SF = "/root/testdata/sf0.001"
SAMPLES = [
    "x password = \"abcdef\" y", "Api_Key: 'ABCDEFGHIJ'", "secret:token = abcdefgh", "pAsSwD=short", "AKIA" + "Z" * 16, "AKIAabc",
    "0" * 24, "f" * 23, "deadbeef" * 5, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20, "xoxb-1234567890-abc",
    "AIza" + "x" * 35, "sk_live_" + "9" * 20, "https://user:pass@host/x", "Bearer " + "t" * 30, "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9,
    "npm_" + "A" * 36, "hf_" + "q" * 31, "token==abcdef tokens: abcdef", "password=abcdefpassword=ghijkl",
]


def brute(text, rules=ss.RULES):
    out = []
    for rank, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or "", re.ASCII):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), rank, m.end(), r.kind))
    return sorted(out)


def test_twin_on_documents(spark):
    assert compare(REGISTRY["op5_secret_scan"](spark, SF), connect(SF), SQL["op5_secret_scan"]) is None


def test_spans_equal_brute_force(spark):
    texts = [*SAMPLES, "\n".join(SAMPLES), "日本 🙂 " + " ".join(SAMPLES), None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in ss.scan(df).collect():
        assert [tuple(s) for s in r["spans"]] == brute(r["text"]), r["text"]


@pytest.mark.parametrize("rule", [r for r in ss.RULES if r.kind != "hex"], ids=lambda r: r.kind)
def test_every_rule_but_one_has_a_query(rule):
    assert ss.trigram_query(rule.pattern)


def test_no_trigram_is_mandatory_in_hex():
    assert ss.trigram_query("[0-9a-f]{24,}") == [] == ss.trigram_query("a*bc?") == ss.trigram_query("(ab|x.*)")


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_a_match_fulfils_its_query(data):
    """Whatever a pattern matches holds all trigrams that its query asks for."""
    rule = data.draw(st.sampled_from(ss.RULES))
    text = data.draw(st.from_regex(rule.pattern.replace(r"\s", " "), fullmatch=True))
    low = text.lower()
    for clause in ss.trigram_query(rule.pattern):
        assert any(all(t in low for t in option) for option in clause)


def test_odd_rows(odd, none):
    out = ss.scan(odd, out="found").collect()
    assert len(out) == odd.count()
    assert all([tuple(s) for s in r["found"]] == brute(r["text"]) for r in out)
    assert ss.scan(none, out="found").collect() == []


def test_masking(odd, none):
    out = ss.mask_secrets(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    texts = {r["text"] for r in out.collect()}
    assert "naïve Ünïcode 日本語 🙂 [SECRET]\" done" in texts
    assert all(not brute(t) for t in texts)
    assert ss.mask_secrets(none).collect() == []


def test_overlapping_spans_are_masked_once(spark):
    text = "secret = " + "a" * 30 + " end"
    df = spark.createDataFrame([(1, text, 5)], "doc_id long, text string, n_chars long")
    row = ss.mask_secrets(df).first()
    assert (row["text"], row["n_chars"]) == ("[SECRET] end", 12)


def test_long_logins_are_found_whole(spark):
    text = f"see ftp://user:{'p' * 5000}@host and SG.{'a' * 90}.{'b' * 90} too"
    found = [tuple(s)[:] for s in ss.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), out="found").first()["found"]]
    assert found == brute(text) and {"url_login", "mail_key"} <= {part for s in found for part in s if isinstance(part, str)}
