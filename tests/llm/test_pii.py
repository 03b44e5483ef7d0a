"""Personal data: base rules against plain patterns, tagger gradients and held-out spans."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reviewmill.llm import char_tagger as ct
from reviewmill.llm import pii

from .conftest import ODD_TEXTS


def brute(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0])):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


PIECES = st.sampled_from(list("a.@+- ()0123456789\n") + ["a@b.cd", "1.2.3.4", "4111 1111 1111 1111", "+1 (234) 555-0100", "é", "x@y", "..", "256.1.1.1"])


@settings(max_examples=500, deadline=None)
@given(st.lists(PIECES, max_size=30).map("".join))
def test_base_spans_equal_the_plain_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_base_rules_take_linear_time():
    for text in ("a" * 200_000, "a." * 100_000 + "@", "1" * 200_000, "1." * 100_000, "+1 " + "(" * 200_000, "@" * 100_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def tagger():
    return ct.Tagger().fit(*pii.training_windows([], 2400), pii.EPOCHS)


def test_held_out_spans(tagger):
    x, y = pii.training_windows([], 300, seed=123)
    right = wrong = missed = 0
    for a, b in zip(tagger.decode(x), y):
        got, want = set(ct.tagged_spans(a)), set(ct.tagged_spans(b))
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert 2 * right / (2 * right + wrong + missed) > 0.8


def test_spans_that_no_base_rule_finds(tagger):
    text = "Call ened the ther at (415) 555-0100 now and then, thonand erin of it."
    (base, tagged), = pii.find_all([text], tagger)
    assert base == [] and [text[s:e] for s, _, e in tagged] in (["(415) 555-0100"], [])


def test_gradients():
    t = ct.Tagger()
    t.w = {k: v.astype(np.float64) for k, v in t.w.items()}
    x, y = pii.training_windows([], 3, seed=4)
    x, y = x[:, :20], y[:, :20]
    y[:, 0] = 0
    e, _ = t.emissions(x)
    loss, d_e, d_next = t._loss(e.astype(np.float64), y)
    for at in [(0, 3, 0), (1, 10, 1), (2, 19, 4)]:
        moved = e.astype(np.float64).copy()
        moved[at] += 1e-5
        assert (t._loss(moved, y)[0] - loss) / 1e-5 == pytest.approx(d_e[at], abs=1e-3)
    before = t.w["next"].copy()
    t.w["next"] = before.copy()
    t.w["next"][0, 1] += 1e-5
    assert (t._loss(e.astype(np.float64), y)[0] - loss) / 1e-5 == pytest.approx(d_next[0, 1], abs=1e-3)


def test_a_span_cut_by_a_window_gives_way():
    text = "x" * 86 + "+49 170 555 0100" + "y" * 120
    found = [(86, 96, 3, 0), (86, 102, 3, 48)]  # the first window ends at 96
    assert pii.reconcile(text, found, []) == [(86, 3, 102)]
    assert pii.reconcile(text, found, [(90, 1, 92)]) == []


def test_windows_cover_every_hint():
    for n in (0, 1, 95, 96, 97, 300, 500):
        for at in range(0, n, 7):
            text = "a" * at + "1" + "a" * (n - at - 1)
            starts = pii.window_starts(text)
            assert starts and all(s <= at < s + pii.WINDOW for s in starts)
            assert at < pii.STRIDE or len(starts) == 2 or at >= n - pii.WINDOW
    assert pii.window_starts("no hint" * 100) == []


def test_odd_rows(odd, none, tagger):
    out = pii.scan(odd, tagger, "found")
    assert out.columns == [*odd.columns, "found"]
    for r in out.collect():
        assert [(s["start"], s["rank"], s["end"]) for s in r["found"]["base"]] == brute(r["text"] or "")
    assert pii.scan(none, tagger, "found").collect() == []
    assert isinstance(pii.fit(none, windows=64), ct.Tagger)


def test_query(spark, tmp_path):
    rows = list(enumerate([*ODD_TEXTS, "mail a.b@c.example.com, 10.0.0.1 or +1 (234) 555-0100; 4111111111111111"]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    r = {x["doc_id"]: x for x in pii.op6_pii_tagger(spark, str(tmp_path)).collect()}[len(rows) - 1]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    assert r["spans"] == "email:5:22,ip:24:32,phone:36:53,card:55:71"


def test_a_badly_cut_span_does_not_silence_the_whole_one():
    text, kind = "host 10.20.30.40 is up", 1
    s, e = text.index("10."), text.index(" is")
    assert pii.reconcile(text, [(s, e - 3, kind, 0), (s, e, kind, 0)], []) == [(s, kind, e)]
