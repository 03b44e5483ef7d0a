"""Attention model: gradients, vectors and held-out accuracy."""

import numpy as np
import pytest

from reviewmill.llm import quality_model as qm

from .conftest import ODD_TEXTS

SF = "/root/testdata/sf0.01"


def test_gradients():
    rng = np.random.default_rng(0)
    model = qm.AttentionModel()
    starts, labels = np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])
    x = rng.normal(size=(9, qm.WIDTH))

    def loss():
        y = model.forward(x, starts)["y"]
        return -np.mean(labels * np.log(y) + (1 - labels) * np.log(1 - y))

    grads = model.gradient(model.forward(x, starts), labels, starts)
    for k, g in grads.items():
        for at in [tuple(rng.integers(0, s) for s in model.w[k].shape) for _ in range(4)]:
            old, step = model.w[k][at], 1e-6
            model.w[k][at] = old + step
            up = loss()
            model.w[k][at] = old - step
            down = loss()
            model.w[k][at] = old
            assert (up - down) / (2 * step) == pytest.approx(g[at], abs=1e-6)


def test_vectors_of_whole_texts():
    words = qm.WordHasher()
    for t in ODD_TEXTS:
        v = qm.passage_vectors(t or "", words)
        n = len((t or "").split())
        assert v.shape == (max(1, (n + qm.PASSAGE // 2) // qm.PASSAGE), qm.WIDTH) and np.isfinite(v).all()


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in qm.op9_attention_quality(spark, SF).collect() if r["held_out"] and r["doc_id"] in labels]
    assert len(rows) > 50
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in rows) / len(rows) > 0.95
    good = [r["score"] for r in rows if labels[r["doc_id"]]]
    bad = [r["score"] for r in rows if not labels[r["doc_id"]]]
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (6, 1), (8, 0), (8, 1), (9, None), (None, 0)], "doc_id long, quality int")
    model = qm.fit(odd, labels)
    out = qm.score(odd, model, "good")
    assert out.columns == [*odd.columns, "good"]
    scores = [r["good"] for r in out.collect()]
    assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
    assert qm.score(none, model, "good").collect() == []
    assert qm.fit(none, labels) is None and qm.fit(odd, labels.limit(0)) is None
    assert {r["good"] for r in qm.score(odd, None, "good").collect()} == {0.5}
