"""Packed products against plain ones; the mined rows against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reviewmill.llm import hard_negatives as hn


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 70), st.integers(1, 8), st.sampled_from([1, 5, 130, 2**20, 2**28]), st.randoms())
def test_packed_scores_are_exact(m, n, dim, most, random):
    def rows(k):
        return np.array([[random.randint(-most, most) for _ in range(dim)] for _ in range(k)], np.int64)

    a, c = rows(m), rows(n)
    assert hn.PackedRows(c).scores(a).tolist() == [[sum(x * y for x, y in zip(p, q)) for q in c.tolist()] for p in a.tolist()]


def test_both_carriers_are_used_and_overflow_is_an_error():
    packed = hn.PackedRows(np.full((3, 4), 100))
    assert packed.scores(np.full((1, 4), -7)).tolist() == [[-2800] * 3]
    assert hn.PackedRows(np.array([[2**40, -3]])).scores(np.array([[2**20, 1]])).tolist() == [[2**60 - 3]]
    with pytest.raises(OverflowError):
        hn.PackedRows(np.array([[2**40]])).scores(np.array([[2**40]]))
    assert hn.PackedRows(np.zeros((0, 4), np.int64)).scores(np.ones((2, 4), np.int64)).shape == (2, 0)


def test_unequal_lengths_are_filled_with_zeros():
    lists = pa.chunked_array([[[1, 2], [], [3]]], pa.list_(pa.int64()))
    assert hn._matrix(lists, 3).tolist() == [[1, 2, 0], [0, 0, 0], [3, 0, 0]]


def plainly(rows, every=50):
    """(anchor, positive, rank, negative, positive score, negative score) of (id, label, vector) rows."""
    out = []
    for a, label, v in rows:
        if a % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in rows if i != a))
        for p, i, other in [s for s in scored if s[2] == label][:5]:
            band = [(n, j) for n, j, other in scored if other != label and 50 * -p <= 100 * -n <= 95 * -p][:3]
            out += [(a, i, k + 1, j, -p, -n) for k, (n, j) in enumerate(band)]
    return sorted(out)


def test_rows_equal_brute_force_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(hn, "ROWS", 40)
    monkeypatch.setattr(hn, "ANCHORS", 4)
    rng = np.random.default_rng(3)
    rows = [(int(i), int(rng.integers(0, 3)), [int(x) for x in rng.integers(-3, 9, 6)]) for i in range(-40, 260)]
    rows += [(1000 + i, 1, [4, 4, 4, 4, 4, 4]) for i in range(30)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, label long, vector array<long>")
    got = sorted(tuple(r) for r in hn.hard_negatives(df, 10).collect())
    assert got == plainly(rows, 10) and len(got) > 100


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 1, "x"), (50, [1.0, 2.0], 1, "x"), (1, [1.0, 1.0], 2, "x"), (2, [0.9, 1.9], 2, "x"),
        (3, None, 1, "x"), (4, [nan, 1.0], 1, "x"), (5, [None, 1.0], 1, "x"), (6, [inf, 1.0], 1, "x"),
        (None, [1.0, 2.0], 1, "x"), (8, [1.0, 2.0], None, "x"), (9, [1.0], 1, "x"), (10, [], 2, "x"),
        (2, [0.9, 1.9], 2, "x"), (2, [9.0, 9.0], 3, "x"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score string")
    df = df.withColumns({"g": df.score, "j": df.score, "rank": df.score})
    whole = hn.integer_rows(df)
    kept = sorted((r.vec_id, r.label, tuple(r.vector)) for r in whole.collect())
    assert kept == [(0, 1, (256, 512)), (1, 2, (256, 256)), (2, 2, (230, 486)), (9, 1, (256,)), (10, 2, ()), (50, 1, (256, 512))]
    got = sorted(tuple(r) for r in hn.hard_negatives(whole).collect())
    assert got == plainly([(i, l, list(v) + [0] * (2 - len(v))) for i, l, v in kept])
    assert hn.hard_negatives(hn.integer_rows(df.limit(0))).count() == 0


def test_query_equals_sql_shape(spark):
    df = hn.op13_hard_negatives(spark, "/root/testdata/sf0.001")
    assert dict(df.dtypes)["rank"] == "int" and dict(df.dtypes)["negative_score"] == "bigint"
