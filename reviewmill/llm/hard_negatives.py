"""Hard negatives of anchor vectors by Kronecker-packed products.

**Product.** Components are integers. Those of several candidates are biased to be non-negative and laid
side by side in fields of one wide integer, wide enough that no sum of products leaves its field. One
multiplication per anchor component then serves all of them, and the fields of the sum are unpacked and
freed of the biases, which gives exact scores. While two fields or more fit into the 53 bits that a double
holds exactly, doubles carry the integers and a matrix product does the multiplying; wider ones are Python
integers, which know no limit.

**Work.** Every anchor meets every row, in cells: rows and anchors are dealt out by a hash of their id into
as many blocks as their counts ask for, and a task holds one block of each. A cell hands on the few best of
each anchor, so what is merged per anchor is small. The first pass finds the positives, the second the
negatives below them.

Defined results: a row with a null id, label or vector, or with a null or non-finite component takes no
part. Of rows that repeat an id, the one with the least label, then the least vector, stands for the id.
Vectors of unequal length are compared as if the shorter one went on with zeros. Ties go to the smaller id.
An anchor without positives, or a positive without a negative in its band, has no rows. Other columns are
ignored. Scores are 64-bit integers; one beyond that is an error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import query, table

EXACT_BITS = 53  # of a double
WIDE_FIELDS = 64  # candidates in one Python integer
ANCHORS, ROWS = 2048, 2048  # of a cell, on average
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # per cent of the positive's score


class PackedRows:
    """Integer vectors, one a row, packed for products with many anchors."""

    def __init__(self, rows: np.ndarray):
        self.n, self.dim = rows.shape
        self.low = int(rows.min()) if rows.size else 0
        self.biased = rows.astype(object) - self.low if _spread(rows) >= 2**62 else rows - self.low
        self.top = int(self.biased.max()) if rows.size else 0
        self.sums = self.biased.sum(axis=1)

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products, anchors by rows, as 64-bit integers."""
        if not (self.n and self.dim and len(anchors)):
            return np.zeros((len(anchors), self.n), np.int64)
        low = int(anchors.min())
        biased = anchors.astype(object) - low if _spread(anchors) >= 2**62 else anchors - low
        width = max(1, (self.dim * self.top * int(biased.max())).bit_length())
        fields = EXACT_BITS // width
        raw = self._in_doubles(biased, width, fields) if fields > 1 else self._in_integers(biased, width)
        small = raw.dtype != object
        if small:  # all parts of the sum stay below 2**62, or Python integers take over
            limit = self.dim * (self.top + abs(self.low)) * (int(biased.max()) + abs(low))
            small = limit < 2**62
        if not small:
            raw = raw.astype(object)
        kind = np.int64 if small else object
        total = raw + self.low * anchors.sum(axis=1, dtype=kind)[:, None] + low * self.sums.astype(kind)[None, :]
        return total if small else np.array(total.tolist(), dtype=np.int64)

    def _in_doubles(self, biased: np.ndarray, width: int, fields: int) -> np.ndarray:
        step = -(-self.n // fields)
        wide = np.zeros((step, self.dim))
        for f in range(fields):
            part = self.biased[f * step : (f + 1) * step]
            wide[: len(part)] += part.astype(np.float64) * 2.0 ** (width * f)
        sums = (biased.astype(np.float64) @ wide.T).astype(np.int64)
        mask = (1 << width) - 1
        return np.concatenate([(sums >> (width * f)) & mask for f in range(fields)], axis=1)[:, : self.n]

    def _in_integers(self, biased: np.ndarray, width: int) -> np.ndarray:
        mask, out = (1 << width) - 1, np.empty((len(biased), self.n), object)
        own, anchors = self.biased.tolist(), biased.tolist()
        for at in range(0, self.n, WIDE_FIELDS):
            part = own[at : at + WIDE_FIELDS]
            wide = [sum(row[d] << (width * f) for f, row in enumerate(part)) for d in range(self.dim)]
            for i, anchor in enumerate(anchors):
                total = sum(x * y for x, y in zip(anchor, wide))
                out[i, at : at + len(part)] = [(total >> (width * f)) & mask for f in range(len(part))]
        return out


def _spread(rows: np.ndarray) -> int:
    return int(rows.max()) - int(rows.min()) if rows.size else 0


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Lists of integers as rows of ``dim`` columns, filled up with zeros."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], column.type)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), dim), np.int64)
    out[np.arange(dim)[None, :] < lengths[:, None]] = values
    return out


class Cell:
    """One block of anchors against one block of rows; ``ids`` ascend, so ties fall to the smaller one."""

    def __init__(self, anchors: pa.Table, rows: pa.Table):
        rows, anchors = rows.sort_by("vec_id"), anchors.sort_by("vec_id")
        dim = max(int(t["vector"].combine_chunks().value_lengths().to_numpy().max()) for t in (anchors, rows))
        self.ids, self.labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        self.anchor_ids, self.anchor_labels = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
        self.scores = PackedRows(_matrix(rows["vector"], dim)).scores(_matrix(anchors["vector"], dim))

    def positives(self, count: int):
        """(anchor, id, score) of the best rows with an anchor's label."""
        for i, anchor in enumerate(self.anchor_ids):
            at = np.flatnonzero((self.labels == self.anchor_labels[i]) & (self.ids != anchor))
            for j in at[np.argsort(-self.scores[i, at], kind="stable")[:count]]:
                yield anchor, self.ids[j], self.scores[i, j]

    def negatives(self, positives: list[list[dict]], count: int):
        """(anchor, place of the positive, id, score) of the best rows of other labels in each positive's band."""
        for i, anchor in enumerate(self.anchor_ids):
            at = np.flatnonzero(self.labels != self.anchor_labels[i])
            at = at[np.argsort(-self.scores[i, at], kind="stable")]
            falling = -self.scores[i, at]
            for p in positives[i]:
                most, least = HIGH * p["score"] // 100, -(-LOW * p["score"] // 100)
                first = int(np.searchsorted(falling, -most, "left"))
                for j in at[first : first + count]:
                    if self.scores[i, j] >= least:
                        yield anchor, p["place"], self.ids[j], self.scores[i, j]


def _as_table(found, fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = list(zip(*found)) or [()] * len(fields)
    return pa.table([pa.array([int(x) for x in c], kind) for c, (_, kind) in zip(columns, fields)],
                    names=[name for name, _ in fields])


def _find_positives(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    found = Cell(anchors, rows).positives(POSITIVES) if len(anchors) and len(rows) else []
    return _as_table(found, [("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("score", pa.int64())])


def _find_negatives(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    found = []
    if len(anchors) and len(rows):
        anchors = anchors.sort_by("vec_id")
        found = Cell(anchors, rows).negatives(anchors["positives"].to_pylist(), NEGATIVES)
    return _as_table(found, [
        ("anchor_id", pa.int64()), ("place", pa.int32()), ("negative_id", pa.int64()), ("score", pa.int64()),
    ])


def integer_rows(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, vector of integers) of the rows that take part, one per id."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))

    def whole(v):
        scaled = F.floor(scale * v.cast("double"))
        return F.when(F.abs(v) < 2.0**62 / scale, scaled).otherwise(F.raise_error(F.lit("a component is too large")))

    usable = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & finite)
    return (
        usable.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.transform(x, whole).alias("vector"))
        .groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row"))
        .select("vec_id", "row.label", "row.vector")
    )


def _dealt(rows: DataFrame, own: str, blocks: int, other: str, copies: int) -> DataFrame:
    """Each row in one block ``own`` by its id, copied to every block ``other``."""
    return rows.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    )


def hard_negatives(rows: DataFrame, every: int = 50) -> DataFrame:
    """For each anchor (``vec_id`` divisible by ``every``) and each of its positives, the hard negatives.

    ``rows`` has vec_id, label and vector (integers), one row per id. Returns anchor_id, positive_id, rank,
    negative_id, positive_score and negative_score.
    """
    rows = cut_lineage(rows.select("vec_id", "label", "vector"))
    is_anchor = F.col("vec_id") % every == 0
    n, n_anchors = rows.agg(F.count("*"), F.count(F.when(is_anchor, 1))).first()
    row_blocks, anchor_blocks = max(1, math.ceil(n / ROWS)), max(1, math.ceil(n_anchors / ANCHORS))
    cells = _dealt(rows, "g", row_blocks, "j", anchor_blocks).groupBy("g", "j")
    anchors = cut_lineage(rows.where(is_anchor))

    def met(side: DataFrame, work, schema: str) -> DataFrame:
        return _dealt(side, "j", anchor_blocks, "g", row_blocks).groupBy("g", "j").cogroup(cells).applyInArrow(work, schema)

    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    positives = cut_lineage(
        met(anchors, _find_positives, "anchor_id long, positive_id long, score long")
        .withColumn("place", F.row_number().over(best)).where(F.col("place") <= POSITIVES)
    )
    of_anchor = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.collect_list(F.struct("place", "score")).alias("positives")
    )
    hardest = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "negative_id")
    negatives = (
        met(anchors.join(of_anchor, "vec_id"), _find_negatives,
            "anchor_id long, place int, negative_id long, score long")
        .withColumn("rank", F.row_number().over(hardest)).where(F.col("rank") <= NEGATIVES)
        .withColumnRenamed("score", "negative_score")
    )
    return negatives.join(positives.withColumnRenamed("score", "positive_score"), ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def relabelled(rows: DataFrame) -> DataFrame:
    """The query's own labels: every seventh id has the next label, modulo ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.withColumn("label", moved)


@query(sql="""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 3""")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return hard_negatives(integer_rows(relabelled(rows)))
