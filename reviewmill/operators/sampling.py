"""Exact-size stratified samples, splits, row numbers and chunks.

A sample takes, per stratum, the rows with the lowest ``md5(seed:id)``. Sorting a whole
stratum in one task would not survive a stratum that holds a third of the table, so the
cut is found on a histogram of the hash and only rows in the cut's own bin are ranked.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CHUNK_SIZE, FEW_SHOT_COUNT, GOLDEN_COUNT, NEG, SAMPLE_SEED, SPLITS, VALID_SIZE
from ..functions.text import normalize_text, null_to_empty
from ..session import cut_lineage
from .joins import lookup_join

_HEX_DIGITS = 4  # 16 ** 4 histogram bins per stratum
MAX_LABELS = 16  # of an iterative split


def sample_order(seed: int, id_col: str = "review_id") -> Column:
    """Hash that orders rows for sampling; the same for a seed and id on every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def fraction_size(fraction: float) -> Callable[[Column], Column]:
    """Stratum size -> sample size, rounded half to even."""
    return lambda count: F.bround(F.lit(float(fraction)) * count).cast("bigint")


def half_up_size(fraction: float) -> Callable[[Column], Column]:
    return lambda count: F.floor(F.lit(float(fraction)) * count + F.lit(0.5)).cast("bigint")


def mark_sample(
    df: DataFrame,
    strata: list[str],
    size: Callable[[Column], Column] | DataFrame,
    seed: int,
    id_col: str = "review_id",
) -> DataFrame:
    """``df`` with a boolean ``taken``: exactly ``size(count)`` rows of each stratum.

    ``size`` may also be a small table of the strata and their ``_size``. Rows with a null stratum belong to
    no stratum and are dropped.
    """
    for s in strata:
        df = df.where(F.col(s).isNotNull())
    hashed = df.withColumn("_hash", sample_order(seed, id_col)).withColumn(
        "_bin", F.conv(F.substring("_hash", 1, _HEX_DIGITS), 16, 10).cast("int")
    )
    strata_cols = strata or ["_all"]
    if not strata:
        hashed = hashed.withColumn("_all", F.lit(0))

    stratum = Window.partitionBy(*strata_cols)
    bins = hashed.groupBy(*strata_cols, "_bin").agg(F.count("*").alias("_n"))
    if isinstance(size, DataFrame):
        bins, planned = bins.join(F.broadcast(size), strata_cols), F.col("_size")
    else:
        planned = size(F.col("_total"))
    cuts = cut_lineage(
        bins
        .withColumn("_total", F.sum("_n").over(stratum))
        .withColumn("_upto", F.sum("_n").over(stratum.orderBy("_bin")))
        .withColumn("_size", planned)
        .withColumn("_need", F.col("_size") - (F.col("_upto") - F.col("_n")))
        .where((F.col("_need") > 0) & (F.col("_need") <= F.col("_n")))
        .select(*strata_cols, F.col("_bin").alias("_cut"), "_need", "_total")
    )  # one row per stratum
    total = cuts.agg(F.coalesce(F.sum("_total"), F.lit(0))).first()[0]
    placed = lookup_join(hashed, cuts, strata_cols, "_total", total, "left")
    clear = placed.where(F.col("_cut").isNull() | (F.col("_bin") != F.col("_cut"))).withColumn(
        "taken", F.coalesce(F.col("_bin") < F.col("_cut"), F.lit(False))
    )
    rank = F.row_number().over(Window.partitionBy(*strata_cols).orderBy("_hash", id_col))
    edge = placed.where(F.col("_bin") == F.col("_cut")).withColumn("taken", rank <= F.col("_need"))
    return clear.unionByName(edge).select(*[c for c in df.columns], "taken")


def stratified_sample(
    df: DataFrame,
    by: str = "score",
    n: float = GOLDEN_COUNT,
    seed: int = SAMPLE_SEED,
    id_col: str = "review_id",
) -> DataFrame:
    """About ``n`` rows, spread over the strata in proportion to their size.

    Ids are drawn from the id and stratum columns alone and written down; their file size
    then lets Spark decide whether to broadcast them, and full rows are read once.
    """
    rows = df.count()
    fraction = n / rows if rows else 0.0
    marked = mark_sample(df.select(id_col, by), [by], fraction_size(fraction), seed, id_col)
    ids = cut_lineage(marked.where("taken").select(id_col))
    return df.join(ids, id_col, "left_semi")


def holdout(df: DataFrame, *removed: DataFrame, id_col: str = "review_id") -> DataFrame:
    """``df`` without the ids of the given tables."""
    for r in removed:
        df = df.join(r.select(id_col), id_col, "left_anti")
    return df


def curate_samples(
    df: DataFrame,
    by: str = "score",
    golden: float = GOLDEN_COUNT,
    few_shot: float = FEW_SHOT_COUNT,
    seed: int = SAMPLE_SEED,
    id_col: str = "review_id",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(golden set, few-shot set, remaining pool), pairwise disjoint.

    The samples are small, so writing them down costs little and keeps the later steps
    from drawing them again.
    """
    first = cut_lineage(stratified_sample(df, by, golden, seed, id_col))
    rest = holdout(df, first, id_col=id_col)
    second = cut_lineage(stratified_sample(rest, by, few_shot, seed, id_col))
    return first, second, holdout(rest, second, id_col=id_col)


def multilabel_split(
    df: DataFrame,
    categories: list[str],
    valid_size: float = VALID_SIZE,
    seed: int = SAMPLE_SEED,
    id_col: str = "review_id",
) -> DataFrame:
    """``df`` with ``split`` = train or valid, stratified by label combination.

    Within each combination the valid share is exact to half a row, so each label's
    positive rate differs between the splits by at most one row per combination.
    """
    marked = mark_sample(df, categories, half_up_size(valid_size), seed, id_col)
    return marked.withColumn(
        "split", F.when(F.col("taken"), F.lit("valid")).otherwise(F.lit("train"))
    ).drop("taken")


def iterative_sizes(histogram: dict[int, int], n_labels: int, fraction: float) -> dict[int, int]:
    """How many rows of each label combination to take so that every label's share is ``fraction``.

    A combination is a number whose bit i tells whether label i is positive. The label with the fewest rows
    left goes first: what it still lacks is shared out among its open combinations in proportion to their
    rows, left-over rows going to the largest remainders, ties to the lower combination. Its combinations
    are closed then, so later, more frequent labels cannot spoil it and make up for it with rows of their own.
    """

    def wanted(rows: int) -> int:
        return math.floor(fraction * rows + 0.5)

    def share_out(combinations: list[int], need: int) -> None:
        rows = sum(histogram[c] for c in combinations)
        need = max(0, min(rows, need))
        for c in combinations:
            taken[c] = need * histogram[c] // rows
        by_remainder = sorted(combinations, key=lambda c: (-(need * histogram[c] % rows), c))
        for c in by_remainder[: need - sum(taken[c] for c in combinations)]:
            taken[c] += 1

    taken: dict[int, int] = {}
    with_label = [[c for c in histogram if c >> i & 1] for i in range(n_labels)]
    want = [wanted(sum(histogram[c] for c in held)) for held in with_label]
    while True:
        open_rows = [(sum(histogram[c] for c in held if c not in taken), i) for i, held in enumerate(with_label)]
        left = [x for x in open_rows if x[0]]
        if not left:
            break
        _, label = min(left)
        got = sum(taken.get(c, 0) for c in with_label[label])
        share_out([c for c in with_label[label] if c not in taken], want[label] - got)
    if histogram.get(0):
        share_out([0], wanted(sum(histogram.values())) - sum(taken.values()))
    return taken


def iterative_multilabel_split(
    df: DataFrame,
    categories: list[str],
    valid_size: float = VALID_SIZE,
    seed: int = SAMPLE_SEED,
    id_col: str = "review_id",
) -> DataFrame:
    """``df`` with ``split`` = train or valid, every label's positive share as near to ``valid_size`` as rows allow.

    Rows of a combination are interchangeable, so the greedy, iterative part works on the histogram of
    combinations alone, rarest label first; the rows themselves are cut exactly per combination, by a hash of
    their id. Unlike ``multilabel_split`` this holds with many categories too, where most combinations have a
    row or two. The histogram is read by the driver: at most 2 ** ``MAX_LABELS`` numbers.

    Positive is ``NEG`` or 1; rows with a null label are dropped. Labels' rates are kept, the number of rows
    only follows from them.
    """
    if len(categories) > MAX_LABELS:
        raise ValueError(f"{len(categories)} categories exceed {MAX_LABELS}")
    bits = [F.when(F.col(c).cast("string").isin(NEG, "1"), 1 << i).otherwise(0) for i, c in enumerate(categories)]
    known = df
    for c in categories:
        known = known.where(F.col(c).isNotNull())
    combined = known.withColumn("_labels", sum(bits, F.lit(0)))
    histogram = {r["_labels"]: r["count"] for r in combined.groupBy("_labels").count().collect()}
    sizes = iterative_sizes(histogram, len(categories), valid_size)
    planned = df.sparkSession.createDataFrame(list(sizes.items()), "_labels int, _size long")
    marked = mark_sample(combined, ["_labels"], planned, seed, id_col)
    return marked.withColumn("split", F.when(F.col("taken"), "valid").otherwise("train")).drop("taken", "_labels")


def with_test_set(split_df: DataFrame, test: DataFrame) -> DataFrame:
    """Add a fixed external table as split ``test``."""
    return split_df.unionByName(test.withColumn("split", F.lit("test")))


def leaked_rows(test: DataFrame, train: DataFrame, column: str = "content") -> DataFrame:
    """Test rows whose normalized text occurs in the training rows; empty when clean."""
    digest = F.sha2(normalize_text(column), 256).alias("_digest")
    marked = test.select("*", digest)
    seen = train.select(digest).distinct()
    copies = marked.groupBy("_digest").agg(F.count("*").alias("_rows"))
    shared = copies.join(seen, "_digest", "left_semi")
    return lookup_join(marked, shared, ["_digest"], "_rows", test.count()).select(*test.columns)


def audit_splits(
    rows: DataFrame, categories: list[str], names=SPLITS, split: str = "split", content: str = "content"
) -> DataFrame:
    """What has to be known of a split before training on it: (metric, split, other, category, value).

    ``rows`` and ``texts`` (different normalized texts) per split; ``rate``, the share of positive rows per
    split and category (positive is ``NEG`` or 1; rows with a null label are left out); and for every two
    splits ``shared_texts``, normalized texts that both hold, and ``shared_rows``, rows of ``split`` whose
    text is in ``other``. Null text is read as empty. Splits without rows have zeros and a null rate;
    rows of other splits than ``names`` are an error.

    One pass: rows are added up per text digest before and in the only large shuffle, so a text that
    a third of the rows repeat is one row of it; everything else is one row.
    """
    stray = F.raise_error(F.concat(F.lit("unknown split "), F.coalesce(split, F.lit("null"))))
    known = F.when(F.col(split).isin(*names), F.col(split)).otherwise(stray)
    cols = {f"_v{j}": F.col(c).cast("string").isin(NEG, "1").cast("long") for j, c in enumerate(categories)}
    marked = rows.select(
        F.sha2(normalize_text(null_to_empty(content)), 256).alias("_digest"), known.alias("_split"),
        *[v.alias(k) for k, v in cols.items()],
    )
    sums = []
    for i, name in enumerate(names):
        here = F.col("_split") == name
        sums.append(F.count_if(here).alias(f"_n{i}"))
        for v in cols:
            sums.append(F.coalesce(F.sum(F.when(here, F.col(v))), F.lit(0)).alias(f"_pos{i}{v}"))
            sums.append(F.count(F.when(here, F.col(v))).alias(f"_all{i}{v}"))
    per_text = marked.groupBy("_digest").agg(*sums)

    def line(metric, name, other, category, value):
        return F.struct(
            F.lit(metric).alias("metric"), F.lit(name).alias("split"), F.lit(other).cast("string").alias("other"),
            F.lit(category).cast("string").alias("category"), value.cast("double").alias("value"),
        )

    report = []
    for i, name in enumerate(names):
        n = F.col(f"_n{i}")
        report += [line("rows", name, None, None, F.coalesce(F.sum(n), F.lit(0)))]
        report += [line("texts", name, None, None, F.count_if(n > 0))]
        for v, c in zip(cols, categories):
            rate = F.try_divide(F.sum(f"_pos{i}{v}"), F.sum(f"_all{i}{v}"))
            report += [line("rate", name, None, c, rate)]
        for j, other in enumerate(names):
            both = (n > 0) & (F.col(f"_n{j}") > 0)
            if i < j:
                report += [line("shared_texts", name, other, None, F.count_if(both))]
            if i != j:
                report += [line("shared_rows", name, other, None, F.coalesce(F.sum(F.when(both, n)), F.lit(0)))]
    return per_text.agg(F.array(*report).alias("_lines")).select(F.inline("_lines"))


def dense_row_ids(
    df: DataFrame, order_by: str = "review_id", out: str = "row_id"
) -> DataFrame:
    """Number the rows 0, 1, 2, ... in the order of the unique key ``order_by``.

    Only the key column is range-partitioned and sorted. It is cut from its lineage
    because a second evaluation could choose other range bounds; the offsets are one row
    per partition.
    """
    placed = cut_lineage(
        df.select(order_by)
        .repartitionByRange(order_by)
        .sortWithinPartitions(order_by)
        .withColumn("_place", F.monotonically_increasing_id())
    ).select(
        order_by,
        F.shiftright("_place", 33).alias("_part"),
        F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos"),
    )
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    offsets = counts.select("_part", before.alias("_before"))
    numbered = placed.join(F.broadcast(offsets), "_part").select(
        order_by, (F.col("_before") + F.col("_pos")).alias(out)
    )
    return df.join(numbered, order_by)


def assign_chunks(
    df: DataFrame, size: int = CHUNK_SIZE, order_by: str = "review_id"
) -> DataFrame:
    """Contiguous blocks of ``size`` rows: adds ``row_id`` and ``chunk_id``."""
    return dense_row_ids(df, order_by).withColumn(
        "chunk_id", F.floor(F.col("row_id") / F.lit(size)).cast("bigint")
    )
