"""Quality rules: robust multivariate outliers of text statistics.

Every text gets a vector of transformed statistics. Per language and source the minimum
covariance determinant (MCD) estimates where the bulk of the vectors lies; vectors at a large
Mahalanobis distance from it are rejected, as are texts that fail two fixed rules.

The estimate covers all rows. Concentration steps run in Spark: distances are computed in the
scan, rows are summed up per group and distance bin, and the bins that hold the nearest
``SUPPORT`` of a group give the next centre and covariance. A group's rows never meet in one task;
only its bins do. Equal texts of a group weigh once in the estimate, so that copies of an odd text
do not pull it to themselves; of different texts, fewer than half can be odd. There is one start and a
fixed number of steps: no determinants are compared.

Defined results: null or empty text has no words and fails the base rule. Null language or
source is a value of its own. Groups of fewer than ``MIN_GROUP`` different texts are pooled by
language, then over all; a pool that is still too small judges nobody. Repeated rows are
judged each, and count once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import fresh, query, table, whole_text

MIN_WORDS = 50
MAX_REPEAT_SHARE = 50  # percent of the words
SUPPORT = 0.5  # share of a group's different texts that the estimate rests on
MIN_GROUP = 200
STEPS = 3
CUTOFF = 60.0  # squared Mahalanobis distance; 0.9999 quantile of chi-square(6) is 27.9
BINS = 64  # distance bins per factor of e, and value bins per unit

#: Smallest standard deviation per statistic: most texts have no symbol or repeat at all, and
#: without a floor any text that has one would lie infinitely far away.
FLOORS = [0.04, 0.08, 0.10, 0.10, 0.04, 0.10]
DIMS = len(FLOORS)
X = [f"x{i}" for i in range(DIMS)]
PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]

STATS = (
    "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, "
    "n_repeat_words long, n_upper long, n_marks long"
)
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_MARKS = b"!?"


def _repeated(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    total, end = 0, 0
    for i, w in enumerate(windows):
        if w in often:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def text_statistics(text: str) -> tuple[int, ...]:
    b = text.encode("utf-8")
    words = b.split()  # on the six ASCII white-space bytes
    spaces = len(b) - len(b.translate(None, b" \t\n\v\f\r"))
    lines = [x for x in b.split(b"\n") if x.strip()]
    return (
        len(words), len(text) - spaces, len(b) - len(b.translate(None, _SYMBOLS)), len(lines),
        len(lines) - len(set(lines)), _repeated(words), len(b) - len(b.translate(None, _UPPER)),
        len(b) - len(b.translate(None, _MARKS)),
    )


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def _statistics(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([text_statistics(t) for t in texts], columns=_names(STATS), dtype="int64")


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_SHARE * s["n_words"])


def _vector(s: Column) -> list[Column]:
    """Transformed statistics: a log mean and square roots of rates, on a grid of 1/4096 so that
    sums do not depend on the order of the rows."""
    words, chars = F.greatest(s["n_words"], F.lit(1)), F.greatest(s["word_chars"], F.lit(1))
    raw = [
        F.log(chars / words),
        F.sqrt(s["n_symbols"] / words),
        F.sqrt(s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1))),
        F.sqrt(s["n_repeat_words"] / words),
        F.sqrt(s["n_upper"] / chars),
        F.sqrt(s["n_marks"] / words),
    ]
    return [(F.round(x * 4096) / 4096).alias(name) for x, name in zip(raw, X)]


def _distance() -> Column:
    """Squared Mahalanobis distance, rounded so that equal vectors give equal numbers."""
    diff = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(X)]
    terms = [diff[i] * diff[j] * F.col(f"p{i}_{j}") * (1 if i == j else 2) for i, j in PAIRS]
    return F.round(reduce(lambda a, b: a + b, terms), 6)


_PARAMS = "cell string, " + ", ".join(
    [f"m{i} double" for i in range(DIMS)] + [f"p{i}_{j} double" for i, j in PAIRS]
)


def _chi2(share: float) -> float:
    """Quantile of chi-square with DIMS degrees of freedom (Wilson-Hilferty)."""
    z = NormalDist().inv_cdf(share)
    return DIMS * (1 - 2 / (9 * DIMS) + z * (2 / (9 * DIMS)) ** 0.5) ** 3


def _start(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Medians and quartile ranges of a group become a diagonal first estimate."""
    for f in frames:
        out = {"cell": f["cell"]}
        for i in range(DIMS):
            out[f"m{i}"] = f[f"q2_{i}"]
        for i, j in PAIRS:
            sd = np.maximum((f[f"q3_{i}"] - f[f"q1_{i}"]) / 1.349, FLOORS[i])
            out[f"p{i}_{j}"] = 1 / sd**2 if i == j else 0.0 * sd
        yield pd.DataFrame(out)


def _concentrate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Centre and inverse covariance of each group from its sums; one row per group."""
    floor = np.array(FLOORS) ** 2
    for f in frames:
        rows = []
        for r in f.to_dict("records"):
            n = r["n"]
            mean = np.array([r[f"s{i}"] for i in range(DIMS)]) / n
            cov = np.empty((DIMS, DIMS))
            for i, j in PAIRS:
                cov[i, j] = cov[j, i] = r[f"s{i}_{j}"] / n - mean[i] * mean[j]
            # The kept rows are the inner ones, so their spread is scaled up; never down.
            cov *= max(1.0, r["edge"] / _chi2(SUPPORT))
            cov[np.diag_indices(DIMS)] += floor
            inverse = np.linalg.inv(cov)
            rows.append([r["cell"], *mean, *[inverse[i, j] for i, j in PAIRS]])
        yield pd.DataFrame(rows, columns=_names(_PARAMS))


def _cells(stats: DataFrame) -> DataFrame:
    """(lang, source) -> the pool it is judged in. One row per pair; counted over different texts."""
    key = lambda *c: F.to_json(F.struct(*c))  # noqa: E731  a null field is left out
    n = stats.groupBy("lang", "source").agg(F.count("*").alias("n"))
    n = n.withColumns({"own": key("lang", "source"), "shared": key("lang")})
    small = F.col("n") < MIN_GROUP
    rest = F.sum(F.when(small, F.col("n")).otherwise(0)).over(W.partitionBy("shared"))
    n = n.withColumn("rest", rest)
    cell = F.when(~small, F.col("own")).when(F.col("rest") >= MIN_GROUP, F.concat(F.lit("lang "), "shared"))
    return n.select("lang", "source", F.coalesce(cell, F.lit("all")).alias("cell"))


def _quartiles(rows: DataFrame) -> DataFrame:
    """Per cell and statistic the three quartiles, from counts in value bins."""
    long = rows.select("cell", F.posexplode(F.array(*X)).alias("i", "x"))
    bins = long.groupBy("cell", "i", F.floor(F.col("x") * BINS).alias("bin")).agg(F.count("*").alias("n"))
    of = W.partitionBy("cell", "i")
    bins = bins.withColumns({
        "upto": F.sum("n").over(of.orderBy("bin")), "all": F.sum("n").over(of),
    })
    aggs = []
    for i in range(DIMS):
        for q in (1, 2, 3):
            inside = (F.col("i") == i) & (F.col("upto") * 4 >= F.col("all") * q)
            aggs.append((F.min(F.when(inside, (F.col("bin") + 0.5) / BINS))).alias(f"q{q}_{i}"))
    return bins.groupBy("cell").agg(*aggs)


def _nearest(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Sums over each cell's nearest rows: whole distance bins until SUPPORT is reached."""
    near = rows.join(params, "cell").withColumn("d2", _distance())
    sums = [F.count("*").alias("n")]
    sums += [F.sum(x).alias(f"s{i}") for i, x in enumerate(X)]
    sums += [F.sum(F.col(X[i]) * F.col(X[j])).alias(f"s{i}_{j}") for i, j in PAIRS]
    bin_ = F.floor(F.log(F.greatest(F.col("d2"), F.lit(1e-3))) * BINS).alias("bin")
    bins = near.groupBy("cell", bin_).agg(*sums)
    of = W.partitionBy("cell")
    bins = bins.withColumns({
        "before": F.sum("n").over(of.orderBy("bin")) - F.col("n"), "all": F.sum("n").over(of),
    }).where(F.col("before") < SUPPORT * F.col("all"))
    kept = [c for c in bins.columns if c not in ("cell", "bin", "before", "all")]
    return bins.groupBy("cell").agg(
        *[F.sum(c).alias(c) for c in kept], F.exp((F.max("bin") + 1) / BINS).alias("edge")
    )


def fit_bulk(stats: DataFrame) -> DataFrame:
    """MCD centre and inverse covariance per (lang, source).

    ``stats`` has lang, source, text_hash and the struct ``stats``; rows that fail the base rules do
    not count. One row per pair of language and source that can be judged.
    """
    s = F.col("stats")
    judged = stats.where(~base_failed(s)).select("lang", "source", "text_hash", *_vector(s))
    judged = cut_lineage(judged.distinct())
    cells = cut_lineage(_cells(judged))
    same = lambda a, b: a["lang"].eqNullSafe(b["lang"]) & a["source"].eqNullSafe(b["source"])
    # Pools of several sources hold a text once, too.
    rows = cut_lineage(judged.join(cells, same(judged, cells)).select("cell", "text_hash", *X).distinct())
    size = rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_GROUP)
    start = _quartiles(rows).join(size.select("cell"), "cell")
    params = cut_lineage(start.mapInPandas(_start, _PARAMS))
    for _ in range(STEPS):
        params = cut_lineage(_nearest(rows, params).mapInPandas(_concentrate, _PARAMS))
    return cells.join(params, "cell").drop("cell")


def measure(docs: DataFrame, out: str, text: str = "text") -> DataFrame:
    return docs.withColumn(out, F.pandas_udf(_statistics, STATS)(whole_text(text)))


def judge(docs: DataFrame, out: str = "rules") -> DataFrame:
    """``docs`` (lang, source, text and any others) with a struct column ``out``: the statistics,
    base_failed, distance (null where not judged) and kept."""
    stats, digest = fresh(docs, "stats", "text_hash")
    measured = cut_lineage(measure(docs, stats).withColumn(digest, F.xxhash64(whole_text())))
    return _judged(measured, stats, digest, out)


def _judged(measured: DataFrame, stats: str, digest: str, out: str) -> DataFrame:
    bulk = fit_bulk(measured.select("lang", "source", F.col(digest).alias("text_hash"), F.col(stats).alias("stats")))
    names = [c for c in bulk.columns if c not in ("lang", "source")]
    lang, source, fitted = fresh(measured, "_lang", "_source", "_bulk")
    bulk = bulk.select(F.col("lang").alias(lang), F.col("source").alias(source), F.struct(*names).alias(fitted))
    same = F.col("lang").eqNullSafe(F.col(lang)) & F.col("source").eqNullSafe(F.col(source))
    joined = measured.join(bulk, same, "left")
    s = F.col(stats)
    xs = _vector(s)
    diff = [x - F.col(f"{fitted}.m{i}") for i, x in enumerate(xs)]
    d2 = F.round(reduce(lambda a, b: a + b, [
        diff[i] * diff[j] * F.col(f"{fitted}.p{i}_{j}") * (1 if i == j else 2) for i, j in PAIRS
    ]), 6)
    failed = base_failed(s)
    d2 = F.when(~failed, d2)
    verdict = F.struct(
        *[s[c].alias(c) for c in _names(STATS)],
        failed.alias("base_failed"),
        d2.alias("distance"),
        (~failed & (F.coalesce(d2, F.lit(0.0)) <= CUTOFF)).alias("kept"),
    )
    return joined.select(*[F.col(f"`{c}`") for c in measured.columns if c not in (stats, digest)], verdict.alias(out))


@query()
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    measured = measure(docs, "stats").withColumn("text_hash", F.xxhash64(whole_text()))
    r = _judged(cut_lineage(measured.drop("text")), "stats", "text_hash", "rules")
    return r.select(
        "doc_id", "rules.n_words", "rules.word_chars", "rules.n_symbols", "rules.n_dup_lines",
        "rules.n_repeat_words", "rules.base_failed", "rules.kept", "rules.distance",
    )
