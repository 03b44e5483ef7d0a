"""Quality rules: statistics and the robust estimate against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from reviewmill.llm import quality_rules as qr

from .conftest import ODD_TEXTS


def brute_statistics(text):
    words = [w for w in text.encode().split()]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in often for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@pytest.mark.parametrize("text", [t or "" for t in ODD_TEXTS] + [
    "a b c a b c", "a b c d a b c e a b c", "x\nx\n\n \nx\ny", "#*$ %&| <>", "a b\x1cc\x85d  ", "r r r r r"])
def test_statistics(text):
    s = dict(zip(qr._names(qr.STATS), qr.text_statistics(text)))
    got = tuple(s[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    assert got == brute_statistics(text)


def prose(rng, n, junk=False):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]
    return " ".join(w + "###" for w in words) if junk else " ".join(words)


@pytest.fixture(scope="module")
def corpus(spark):
    rng, rows = random.Random(2), []
    for i in range(700):
        junk = i % 10 == 0
        rows.append((i, prose(rng, rng.randint(55, 200), junk), "en", "s1" if i % 3 else "s2"))
    rows += [(1000 + i, prose(rng, 60, i == 0), "de", f"t{i}") for i in range(8)]  # too few to judge
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def plain_distances(rows):
    """The same estimate with numpy, one pool after the other."""
    stats = {d: dict(zip(qr._names(qr.STATS), qr.text_statistics(t))) for d, t, _, _ in rows}
    count = Counter((lang, s) for _, _, lang, s in rows)
    rest = Counter()
    for (lang, _), n in count.items():
        rest[lang] += n if n < qr.MIN_GROUP else 0
    pools = {}
    for d, _, lang, s in rows:
        pool = (lang, s) if count[lang, s] >= qr.MIN_GROUP else lang if rest[lang] >= qr.MIN_GROUP else "all"
        pools.setdefault(pool, []).append(d)

    def vector(s):
        raw = [
            math.log(max(s["word_chars"], 1) / max(s["n_words"], 1)), *[math.sqrt(s[a] / max(s[b], 1)) for a, b in (
                ("n_symbols", "n_words"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"),
                ("n_upper", "word_chars"), ("n_marks", "n_words"))]]
        return [math.floor(x * 4096 + 0.5) / 4096 for x in raw]

    out = {}
    for ids in pools.values():
        if len(ids) < qr.MIN_GROUP:
            continue
        x = np.array([vector(stats[d]) for d in ids])
        n, floor = len(x), np.array(qr.FLOORS)
        binned = np.sort(np.floor(x * qr.BINS), axis=0)
        q = [(binned[[math.ceil(n * k / 4) - 1 for _ in range(1)][0]] + 0.5) / qr.BINS for k in (1, 2, 3)]
        mean, inverse = q[1], np.diag(1 / np.maximum((q[2] - q[0]) / 1.349, floor) ** 2)
        for _ in range(qr.STEPS):
            d2 = np.round(np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean), 6)
            bins = np.floor(np.log(np.maximum(d2, 1e-3)) * qr.BINS)
            edge = np.sort(bins)[math.ceil(qr.SUPPORT * n) - 1]
            kept = x[bins <= edge]
            mean = kept.mean(0)
            cov = kept.T @ kept / len(kept) - np.outer(mean, mean)
            cov = cov * max(1.0, math.exp((edge + 1) / qr.BINS) / qr._chi2(qr.SUPPORT)) + np.diag(floor**2)
            inverse = np.linalg.inv(cov)
        for d, row in zip(ids, x):
            out[d] = float((row - mean) @ inverse @ (row - mean))
    return out


def test_distances_equal_a_plain_version(corpus):
    rows, df = corpus
    want = plain_distances(rows)
    got = {r["doc_id"]: r["rules"] for r in qr.judge(df).collect()}
    assert len(got) == len(rows)
    for d, r in got.items():
        if d in want:
            assert r["distance"] == pytest.approx(want[d], rel=1e-4, abs=1e-4)
        else:
            assert r["distance"] is None and r["kept"]


def test_planted_outliers_are_rejected_and_others_kept(corpus):
    _, df = corpus
    kept = {r["doc_id"]: r["rules"]["kept"] for r in qr.judge(df).collect()}
    assert all(kept[i] == (i % 10 != 0) for i in range(700))


def test_odd_rows(odd, none):
    out = qr.judge(odd, "verdict")
    assert out.columns == [*odd.columns, "verdict"] and out.count() == odd.count()
    for r in out.collect():
        n, *_, repeated = brute_statistics(r["text"] or "")
        assert r["verdict"]["base_failed"] == (n < 50 or 100 * repeated > 50 * n)
        assert r["verdict"]["kept"] == (not r["verdict"]["base_failed"])
    assert qr.judge(none, "verdict").collect() == []


@pytest.mark.parametrize("copies", [True, False])
def test_a_third_of_odd_texts_does_not_pull_the_estimate(spark, copies):
    rng = random.Random(3)
    odd = prose(rng, 80, True)
    rows = [(i, prose(rng, rng.randint(55, 200)), "en", "s") for i in range(600)]
    rows += [(1000 + i, odd if copies else prose(rng, 80, True), "en", "s") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["rules"]["kept"] for r in qr.judge(df).collect()}
    assert all(kept[d] == (d < 1000) for d in kept)
    distance = {r["doc_id"]: r["rules"]["distance"] for r in qr.judge(df).collect()}
    # The others are judged as without the odd texts, where those are copies of one.
    if copies:
        alone = qr.judge(df.where("doc_id < 1000")).collect()
        assert all(distance[r["doc_id"]] == pytest.approx(r["rules"]["distance"], rel=0.2, abs=0.1) for r in alone)
