import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewmill.operators import cleaning, counts, joins, sampling


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "review_id bigint, score int, content string").repartition(parts)


def rows(n=400):
    """One score holds more than a third of the rows; ids have gaps."""
    return [(3 * i + 7, 5 if i % 5 < 2 else i % 4 + 1, f"text {i}") for i in range(n)]


def lowest(ids, seed, n):
    order = sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))
    return sorted(order[:n])


def ids(df):
    return sorted(r.review_id for r in df.select("review_id").collect())


def expected_sample(data, n, seed):
    groups = {}
    for i, s, _ in data:
        if s is not None:
            groups.setdefault(s, []).append(i)
    taken = []
    for members in groups.values():
        taken += lowest(members, seed, round(n / len(data) * len(members)))
    return sorted(taken)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_stratified_sample_is_exact_and_partition_free(spark, parts):
    data = rows()
    got = sampling.stratified_sample(frame(spark, data, parts), n=50.2)
    assert ids(got) == expected_sample(data, 50.2, 12)


def test_hot_strata_take_the_split_join(spark, monkeypatch):
    monkeypatch.setattr(joins, "MAX_HOT_KEYS", 4)
    data = [*rows(), (1, None, "no score")]
    assert ids(sampling.stratified_sample(frame(spark, data), n=80)) == expected_sample(data, 80, 12)


def test_cut_inside_a_bin_is_exact(spark, monkeypatch):
    """With one bin per stratum every sampled row comes from the ranked edge."""
    monkeypatch.setattr(sampling, "_HEX_DIGITS", 1)
    data = rows(300)
    assert ids(sampling.stratified_sample(frame(spark, data), n=40)) == expected_sample(data, 40, 12)


def test_sizes_round_half_to_even(spark):
    size = sampling.fraction_size(0.25)
    df = spark.createDataFrame([(2,), (6,), (10,), (14,)], "n bigint")
    assert [r[0] for r in df.select(size(F.col("n"))).collect()] == [0, 2, 2, 4]


def test_score_filter(spark):
    data = rows()
    top = [i for i, s, _ in data if s >= 4]
    want = sorted([i for i, s, _ in data if s <= 3] + lowest(top, 32, round(0.1 * len(top))))
    assert ids(cleaning.score_filter(frame(spark, data))) == want


def test_newest_reviews(spark):
    data = [(1, "2024-01-01", 5), (2, "2024-03-01", 1), (3, "2024-03-01", 5), (4, "2024-02-01", 1)]
    df = spark.createDataFrame(data, "review_id bigint, reviewed_at string, score int")
    assert [r.review_id for r in cleaning.newest_reviews(df, 3).collect()] == [2, 3, 4]
    assert [r.review_id for r in cleaning.newest_reviews(df, 5, score=1).collect()] == [2, 4]


def test_samples_are_disjoint_and_complete(spark):
    df = frame(spark, rows())
    golden, shots, pool = sampling.curate_samples(df)
    parts = [ids(golden), ids(shots), ids(pool)]
    assert sorted(sum(parts, [])) == ids(df)
    assert len(parts[0]) + len(parts[1]) + len(parts[2]) == 400


def test_multilabel_split_keeps_rates(spark):
    data = [(i, "NEG" if i % 3 == 0 else "ABSENT", "NEG" if i % 7 == 0 else "ABSENT") for i in range(500)]
    df = spark.createDataFrame(data, "review_id bigint, A string, B string")
    split = sampling.multilabel_split(df, ["A", "B"]).collect()
    total, valid = Counter((r.A, r.B) for r in split), Counter((r.A, r.B) for r in split if r.split == "valid")
    assert len(split) == 500
    for combination, n in total.items():
        assert abs(valid[combination] - 0.2 * n) <= 0.5


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_dense_ids_and_chunks(spark, parts):
    data = rows(257)
    got = sampling.assign_chunks(frame(spark, data, parts), 50).orderBy("review_id").collect()
    assert [r.row_id for r in got] == list(range(257))
    assert [r.chunk_id for r in got] == [i // 50 for i in range(257)]


def test_leak_check(spark):
    train = frame(spark, [(1, 1, "Good RIDE!!"), (2, 1, "bad")])
    test = frame(spark, [(3, 1, "good ride"), (4, 1, "other")])
    assert ids(sampling.leaked_rows(test, train)) == [3]


def test_counts_ignore_nulls(spark):
    df = frame(spark, [(1, 5, "a"), (2, 5, "b"), (3, None, "c"), (4, 1, "d")])
    assert [tuple(r) for r in counts.value_counts(df, "score").collect()] == [(5, 2), (1, 1)]
    shares = {r.score: r.share for r in counts.composition(df, "score").collect()}
    assert shares == {5: 0.5, 1: 0.25}


def label_rows(n, k, seed, rates=None):
    rng = random.Random(seed)
    rates = rates or [0.02 + 0.05 * i for i in range(k)]
    return [(3 * i + 1, *[int(rng.random() < r) for r in rates]) for i in range(n)]


@pytest.mark.parametrize("n, k, seed", [(60, 3, 1), (400, 10, 2), (1500, 10, 3), (97, 6, 4), (30, 10, 5)])
def test_iterative_sizes_keep_every_rate(n, k, seed):
    rows = label_rows(n, k, seed)
    histogram = Counter(sum(v << i for i, v in enumerate(r[1:])) for r in rows)
    sizes = sampling.iterative_sizes(dict(histogram), k, 0.2)
    assert set(sizes) == set(histogram) and all(0 <= sizes[c] <= histogram[c] for c in sizes)
    for i in range(k):
        positive = sum(m for c, m in histogram.items() if c >> i & 1)
        assert abs(sum(v for c, v in sizes.items() if c >> i & 1) - 0.2 * positive) <= 1


def test_iterative_split_takes_the_planned_rows(spark):
    k, data = 10, label_rows(500, 10, 8)
    names = [f"c{i}" for i in range(k)]
    df = spark.createDataFrame(data, ["review_id", *names]).repartition(5)
    with_null = df.union(df.limit(1).withColumn("c3", F.lit(None).cast("long")).withColumn("review_id", F.lit(-5)))
    rows = sampling.iterative_multilabel_split(with_null, names).collect()
    assert sorted(r.review_id for r in rows) == sorted(r[0] for r in data)
    again = sampling.iterative_multilabel_split(df.repartition(2), names).collect()
    assert {r.review_id: r.split for r in rows} == {r.review_id: r.split for r in again}
    for c in names:
        positive = [r for r in rows if r[c]]
        assert abs(sum(r.split == "valid" for r in positive) - 0.2 * len(positive)) <= 1
    groups = {}
    for r in rows:
        groups.setdefault(tuple(r[c] for c in names), []).append(r)
    for members in groups.values():
        valid = sorted(r.review_id for r in members if r.split == "valid")
        assert valid == lowest([r.review_id for r in members], 12, len(valid))


def test_split_by_combination_misses_rates_that_the_iterative_one_keeps(spark):
    names = [f"c{i}" for i in range(10)]
    df = spark.createDataFrame(label_rows(300, 10, 9, [0.5] * 10), ["review_id", *names])
    by_combination = sampling.multilabel_split(df, names).where("split = 'valid'").count()
    iterative = sampling.iterative_multilabel_split(df, names).where("split = 'valid'").count()
    # The labels' rates are kept, not the number of rows: a row may hold five labels or none.
    assert by_combination < 10 and 48 <= iterative <= 72


def test_iterative_split_of_odd_tables(spark):
    df = spark.createDataFrame([], "review_id long, a string, b string")
    assert sampling.iterative_multilabel_split(df, ["a", "b"]).count() == 0
    with pytest.raises(ValueError):
        sampling.iterative_multilabel_split(df, ["a"] * 17)
    none = spark.createDataFrame([(i, "ABSENT") for i in range(10)], "review_id long, a string")
    assert sampling.iterative_multilabel_split(none, ["a"]).where("split = 'valid'").count() == 2


def audit_plainly(rows, names, categories):
    by = {n: [r for r in rows if r["split"] == n] for n in names}
    texts = {n: {r["content"].lower() for r in by[n]} for n in names}
    out = {}
    for i, n in enumerate(names):
        out["rows", n, None, None], out["texts", n, None, None] = len(by[n]), len(texts[n])
        for c in categories:
            known = [r[c] for r in by[n] if r[c] is not None]
            out["rate", n, None, c] = sum(v in ("NEG", 1) for v in known) / len(known) if known else None
        for j, o in enumerate(names):
            if i < j:
                out["shared_texts", n, o, None] = len(texts[n] & texts[o])
            if i != j:
                out["shared_rows", n, o, None] = sum(r["content"].lower() in texts[o] for r in by[n])
    return out


@pytest.mark.parametrize("names", [("train", "valid", "test"), ("train", "test"), ("a", "b", "c", "d")])
def test_audit_equals_a_plain_count(spark, names):
    rows = [
        {"split": names[i % len(names)] if i % 5 else names[0], "content": ["same", "Same", f"t {i % 11}", f"u {i}"][i % 4 if i % 3 else 0],
         "A": ["NEG", "ABSENT", None][i % 3], "B": "NEG" if i % 7 == 0 else "ABSENT"}
        for i in range(120)
    ]
    df = spark.createDataFrame(rows, "split string, content string, A string, B string").repartition(7)
    got = sampling.audit_splits(df, ["A", "B"], names).collect()
    want = audit_plainly(rows, names, ["A", "B"])
    assert len(got) == len(want)
    assert {(r.metric, r.split, r.other, r.category): r.value for r in got} == pytest.approx(want)


def test_audit_of_no_rows_and_of_strays(spark):
    empty = spark.createDataFrame([], "split string, content string, A int")
    assert {r.value for r in sampling.audit_splits(empty, ["A"]).collect()} == {0.0, None}
    nulls = spark.createDataFrame([("train", None, 1), ("test", "", 0)], "split string, content string, A int")
    got = {(r.metric, r.split, r.other): r.value for r in sampling.audit_splits(nulls, ["A"]).collect()}
    assert got["shared_texts", "train", "test"] == 1 and got["rate", "train", None] == 1
    for stray in ("other", None):
        bad = spark.createDataFrame([(stray, "x", 1)], "split string, content string, A int")
        with pytest.raises(Exception, match="unknown split"):
            sampling.audit_splits(bad, ["A"]).collect()
