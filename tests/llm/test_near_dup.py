"""Near-duplicates against brute force, and the guarantees of the index."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewmill.llm import near_dup as nd

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Component and size per (id, text): union of all pairs that share enough."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                parent[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best.setdefault(find(i), []).append(d)
    low = {k: min((d for d in v if d is not None), default=None) for k, v in best.items()}
    return Counter(
        (d, len(s), d if not s else low[find(i)], not s or d == low[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))
    )


def got(df):
    return Counter(tuple(r) for r in nd.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect())


def family(rng, words, copies, edits):
    base = [f"w{rng.randrange(900)}" for _ in range(words)]
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"e{rng.randrange(12)}"
        yield " ".join(w)


@pytest.fixture(scope="module")
def families():
    rng = random.Random(3)
    texts = [t for words, copies, edits in [(150, 60, 7), (40, 25, 1), (300, 20, 9), (6, 12, 1)] for t in family(rng, words, copies, edits)]
    texts += ["same text for many"] * 30 + [" ".join(f"u{i}_{j}" for j in range(50)) for i in range(20)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_equals_brute_force_on_families(spark, families):
    assert got(spark.createDataFrame(families, "doc_id long, text string")) == brute(families)


def test_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert got(docs) == brute([tuple(r) for r in docs.collect()])


def test_odd_rows(spark, odd):
    assert got(odd) == brute([tuple(r) for r in odd.select("doc_id", "text").collect()])


def test_empty_table(none):
    assert nd.near_duplicates(none).collect() == []
    assert nd.drop_near_duplicates(none).collect() == []


def test_dropping_keeps_one_row_of_each_group(odd):
    out = nd.drop_near_duplicates(odd)
    assert out.columns == odd.columns
    kept = Counter((r["doc_id"], r["text"]) for r in out.collect())
    texts = [r["text"] for r in odd.select("text").collect()]
    # All texts here are equal or far apart, but for the one with a longer end.
    groups = {frozenset(shingles(t)) for t in texts if shingles(t)}
    assert sum(n for (_, t), n in kept.items() if shingles(t)) == len(groups) - 1
    assert sum(n for (_, t), n in kept.items() if not shingles(t)) == sum(not shingles(t) for t in texts)


def test_index_meets_all_signatures_within_the_distance(spark):
    """Pigeonhole: two signatures at MAX_DISTANCE differing symbols share a key."""
    rng = np.random.default_rng(1)
    k, rows = nd.CHUNKS * nd.SYMBOLS, []
    shifts = np.arange(nd.SYMBOLS) * nd.BITS

    def pack(symbols):
        return [int(sum(int(s) << int(b) for s, b in zip(c, shifts))) for c in symbols.reshape(nd.CHUNKS, nd.SYMBOLS)]

    for i in range(40):
        a = rng.integers(0, 1 << nd.BITS, k)
        b = a.copy()
        at = rng.choice(k, nd.MAX_DISTANCE, replace=False)
        b[at] = (b[at] + 1) % (1 << nd.BITS)
        rows.append((i, pack(a), pack(b)))
    df = spark.createDataFrame(rows, "i long, a array<long>, b array<long>")
    out = df.select(
        F.arrays_overlap(nd.index_keys(F.col("a")), nd.index_keys(F.col("b"))).alias("meet"),
        nd.signature_distance(F.col("a"), F.col("b")).alias("d"),
    ).collect()
    assert all(r["meet"] and r["d"] == nd.MAX_DISTANCE for r in out)


def test_chance_of_a_similar_pair_beyond_the_distance():
    k, p = nd.CHUNKS * nd.SYMBOLS, 1 - nd.NUM / nd.DEN
    beyond = sum(math.comb(k, i) * p**i * (1 - p) ** (k - i) for i in range(nd.MAX_DISTANCE + 1, k + 1))
    assert beyond < 1e-5


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 103), (103, 101), (200, 200)]
    out = dict(map(tuple, nd.components(spark.createDataFrame(edges, "low long, node long")).collect()))
    assert out == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100}


def test_words_of_very_long_texts(monkeypatch):
    words = nd.WordHasher()
    text = (" ".join(f"word{i}" for i in range(3000)) + "\n" + "z" * 700).encode()
    whole = words.words(text)
    monkeypatch.setattr(nd.WordHasher, "LIMIT", 500)
    with np.errstate(over="ignore"):
        assert (nd.WordHasher().words(text) == whole).all()
    assert len(set(whole.tolist())) == 3001
