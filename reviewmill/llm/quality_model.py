"""Quality classifier: attention-based multiple-instance learning.

A text is a bag of passages of about ``PASSAGE`` words. Each passage is described by its character
classes, word lengths and repetitions and encoded by a small layer. A gated attention weighs
the passages of a text, their weighted mean represents it, and a logistic unit scores that.
Only the label of the whole text is known in training; the weights are learned through it.

Training reads a bounded sample: the ``train_docs`` labelled documents lowest in a hash order, as
passage vectors. Scoring is one pass over whole texts.

Defined results: null and empty texts are a bag of one empty passage and get a score. A label that
is null is none; several labels of one id count as their lowest. Without labels of
both classes there is nothing to learn and every score is 0.5. Ids are used for the split only; a
null id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHasher, fresh, hash40, query, table, whole_text

PASSAGE = 64  # words
TRAIN_DOCS = 6_000
HIDDEN, ATTENTION = 16, 8
EPOCHS, RATE, DECAY = 200, 0.02, 1e-4
CUT = 0.7

_CLASSES = [
    b" ", b"\n", b"\t\r\v\f", b"aeiou", b"bcdfghjklmnpqrstvwxyz", bytes(range(65, 91)), b"0123456789", b".", b",;:",
    b"!?", b"#*$%&", b"|<>", b"\"'()[]{}`", b"-_/\\~^@=+", bytes(range(0x80, 0xC0)), bytes(range(0xC0, 0x100)),
]
KINDS = len(_CLASSES) + 1
_CLASS_OF = np.full(256, KINDS - 1, np.int64)
for _i, _bytes in enumerate(_CLASSES):
    _CLASS_OF[list(_bytes)] = _i
WIDTH = KINDS + 5


def passage_vectors(text: str, hasher: WordHasher) -> np.ndarray:
    """One row per passage of a whole text; one row of zeros for a text without words."""
    b = text.encode("utf-8")
    starts, ends, words = hasher.places(b)
    n = len(words)
    if n == 0:
        return np.zeros((1, WIDTH), np.float32)
    count = max(1, (n + PASSAGE // 2) // PASSAGE)
    of_word = np.minimum(np.arange(n) // PASSAGE, count - 1)
    firsts = np.arange(count) * PASSAGE
    edges = np.append(starts[firsts], len(b))
    edges[0] = 0
    of_byte = np.repeat(np.arange(count), np.diff(edges))
    kinds = np.bincount(of_byte * KINDS + _CLASS_OF[np.frombuffer(b, np.uint8)], minlength=count * KINDS)
    size = np.bincount(of_word, minlength=count).astype(np.float64)
    long = (ends - starts).astype(np.float64)
    mean = np.add.reduceat(long, firsts) / size
    spread = np.sqrt(np.maximum(np.add.reduceat(long * long, firsts) / size - mean**2, 0))
    again = np.zeros(n)
    again[1:] = words[1:] == words[:-1]
    order = np.lexsort((words, of_word))
    new = np.ones(n)
    new[1:] = (words[order][1:] != words[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
    return np.column_stack([
        np.sqrt(kinds.reshape(count, KINDS) / np.diff(edges)[:, None]),
        np.log1p(mean), np.log1p(spread), np.add.reduceat(again, firsts) / size,
        np.bincount(of_word[order], new, count) / size, np.log1p(size) / 4,
    ]).astype(np.float32)


class AttentionModel:
    """Passage encoder, gated attention and document score, trained by Adam."""

    def __init__(self, seed: int = 17):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.shift, self.scale = np.zeros(WIDTH), np.ones(WIDTH)
        self.w = {
            "enc": draw(WIDTH, HIDDEN), "enc0": np.zeros(HIDDEN), "tan": draw(HIDDEN, ATTENTION),
            "gate": draw(HIDDEN, ATTENTION), "att": draw(ATTENTION, 1)[:, 0],
            "out": draw(HIDDEN, 1)[:, 0], "out0": np.zeros(1),
        }

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """``x``: passages of all bags, bag after bag; ``starts``: where each bag begins."""
        w = self.w
        sizes = np.diff(np.append(starts, len(x)))
        x = (x - self.shift) / self.scale
        h = np.tanh(x @ w["enc"] + w["enc0"])
        t, g = np.tanh(h @ w["tan"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        e = (t * g) @ w["att"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(h * a[:, None], starts)
        y = 1 / (1 + np.exp(-(z @ w["out"] + w["out0"])))
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "y": y, "sizes": sizes}

    def gradient(self, f: dict[str, np.ndarray], labels: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        w, of = self.w, lambda v: np.repeat(v, f["sizes"], axis=0)
        d = (f["y"] - labels) / len(labels)
        dz = of(d[:, None] * w["out"])
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - of(np.add.reduceat(f["a"] * da, starts)))
        du = de[:, None] * w["att"]
        dt, dg = du * f["g"] * (1 - f["t"] ** 2), du * f["t"] * f["g"] * (1 - f["g"])
        dh = f["a"][:, None] * dz + dt @ w["tan"].T + dg @ w["gate"].T
        dp = dh * (1 - f["h"] ** 2)
        return {
            "enc": f["x"].T @ dp, "enc0": dp.sum(0), "tan": f["h"].T @ dt, "gate": f["h"].T @ dg,
            "att": (f["t"] * f["g"]).T @ de, "out": f["z"].T @ d, "out0": np.array([d.sum()]),
        }

    def fit(self, bags: list[np.ndarray], labels: np.ndarray) -> AttentionModel:
        x = np.concatenate(bags).astype(np.float64)
        starts = np.cumsum([0, *map(len, bags)])[:-1]
        self.shift, self.scale = x.mean(0), x.std(0) + 0.05
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        for i in range(1, EPOCHS + 1):
            grads = self.gradient(self.forward(x, starts), labels, starts)
            rate = RATE * (1 - (i - 1) / EPOCHS)
            for k, grad in grads.items():
                grad = grad + DECAY * self.w[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                s[k] = 0.999 * s[k] + 0.001 * grad**2
                self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.999**i)) + 1e-8)
        return self

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        starts = np.cumsum([0, *map(len, bags)])[:-1]
        return self.forward(np.concatenate(bags).astype(np.float64), starts)["y"]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    hasher = WordHasher()
    with np.errstate(over="ignore"):
        for texts in batches:
            yield pd.Series([passage_vectors(t, hasher).ravel() for t in texts], dtype=object)


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> AttentionModel | None:
    """Model from at most ``train_docs`` documents (doc_id, text) with a label (doc_id, quality)
    that are not held out; None if the sample has one class only."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.min("quality").alias("quality")
    )
    sample = known.orderBy(hash40(F.lit("train"), F.col("doc_id")), "doc_id").limit(train_docs)
    # At most train_docs ids: small enough to broadcast whatever the tables hold.
    texts = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(sample), "doc_id")
    # Of several texts of an id the least, so that reruns learn the same.
    texts = texts.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text"))
    rows = texts.select("doc_id", "quality", F.pandas_udf(_vectors, "array<float>")("text").alias("v"))
    rows = rows.orderBy("doc_id").toPandas()
    if rows["quality"].nunique() < 2:
        return None
    bags = [np.asarray(v, np.float32).reshape(-1, WIDTH) for v in rows["v"]]
    return AttentionModel().fit(bags, rows["quality"].to_numpy(np.float64))


def score(docs: DataFrame, model: AttentionModel | None, out: str = "score") -> DataFrame:
    """``docs`` with ``out``: how likely the whole text is good."""
    if model is None:
        return docs.withColumn(out, F.lit(0.5))

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = WordHasher()
        with np.errstate(over="ignore"):
            for texts in batches:
                got = []
                for at in range(0, len(texts), 256):
                    got.append(model.scores([passage_vectors(t, hasher) for t in texts.iloc[at : at + 256]]))
                yield pd.Series(np.concatenate(got) if got else np.empty(0))

    return docs.withColumn(out, F.pandas_udf(scores, "double")(whole_text()))


@query()
def op9_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    (out,) = fresh(docs, "score")
    scored = score(docs, model, out)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), out, (F.col(out) >= CUT).cast("int").alias("predicted")
    )
