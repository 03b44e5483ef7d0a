"""From raw reviews to a cleaned, sampled and split corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import (
    CATEGORIES,
    DEDUP_THRESHOLD,
    FEW_SHOT_COUNT,
    GOLDEN_COUNT,
    MIN_WORDS,
    SAMPLE_SEED,
    VALID_SIZE,
)
from ..operators.cleaning import exact_dedup, length_filter, normalize_reviews
from ..operators.dedup import drop_duplicate_reviews
from ..operators.labeling import (
    few_shot_blocks,
    few_shot_lines,
    project_labels,
    promote_pseudo_labels,
)
from ..operators.sampling import (
    curate_samples,
    dense_row_ids,
    leaked_rows,
    multilabel_split,
    with_test_set,
)
from ..operators.validation import encode_labels
from ..session import cut_lineage
from ..sources.tables import (
    export_template,
    import_template,
    land_reviews,
    read_reviews,
    write_ordered_text,
)


def clean_exact(
    df: DataFrame, min_words: int = MIN_WORDS, elongation: str = "drop", id_col: str = "review_id"
) -> DataFrame:
    """Length filter on the raw text, normalization, exact dedup."""
    return (
        df.transform(length_filter, min_words)
        .transform(normalize_reviews, elongation=elongation)
        .transform(exact_dedup, id_col=id_col)
    )


def clean_reviews(
    df: DataFrame,
    min_words: int = MIN_WORDS,
    elongation: str = "drop",
    threshold: float = DEDUP_THRESHOLD,
    verify: bool = False,
    id_col: str = "review_id",
) -> DataFrame:
    """Length filter on the raw text, normalization, exact and near-duplicate removal."""
    return (
        df.transform(length_filter, min_words)
        .transform(normalize_reviews, elongation=elongation)
        .transform(drop_duplicate_reviews, id_col=id_col, threshold=threshold, verify=verify)
    )


def build_splits(
    labelled: DataFrame,
    golden: DataFrame,
    categories=CATEGORIES,
    valid_size: float = VALID_SIZE,
    seed: int = SAMPLE_SEED,
    id_col: str = "review_id",
) -> tuple[DataFrame, DataFrame]:
    """(train, valid and test rows with column ``split``, rows left out with ``failed_checks``).

    Predictions of the pool become its labels; the golden set is the test split. Rows without
    usable labels are left out, and so are pool rows whose normalized text is one of the golden
    set's (check ``leak``): the test must not be trained on.
    """
    promoted = promote_pseudo_labels(labelled, categories)
    pool, bad = encode_labels(promoted, categories, "quarantine")
    test, bad_test = encode_labels(golden, categories, "quarantine")
    leaks = cut_lineage(leaked_rows(pool, test).select(id_col))
    pool = pool.join(leaks, id_col, "left_anti")
    split = multilabel_split(pool, list(categories), valid_size, seed, id_col)
    columns = [id_col, "content", *categories]
    rows = with_test_set(split.select(*columns, "split"), test.select(*columns))
    rejected = [id_col, "failed_checks"]
    leaked = leaks.withColumn("failed_checks", F.array(F.lit("leak")))
    return rows, bad.select(rejected).unionByName(bad_test.select(rejected)).unionByName(leaked)


def labelled_rows(split_rows: DataFrame, categories=CATEGORIES) -> DataFrame:
    """Text and label columns only, as the trainer reads them."""
    return project_labels(split_rows, categories)


def write_clean(
    spark: SparkSession, source: str, target: str, fmt: str = "csv", min_words: int = MIN_WORDS
) -> DataFrame:
    """Raw review files -> reviews with ids, landed at ``{target}-landed`` -> cleaned reviews.

    The raw files are read once; cleaning works on the landed, splittable table.
    """
    landed = land_reviews(spark, source, f"{target.rstrip('/')}-landed", fmt)
    clean_reviews(landed, min_words).write.mode("overwrite").parquet(target)
    return read_reviews(spark, target)


def prepare_annotation(
    clean: DataFrame,
    root: str,
    categories=CATEGORIES,
    golden: float = GOLDEN_COUNT,
    few_shot: float = FEW_SHOT_COUNT,
    seed: int = SAMPLE_SEED,
    force: bool = False,
) -> None:
    """Templates ``golden`` and ``few_shot`` to be filled in by hand, and the ``pool`` of
    all other reviews. Existing files stay unless forced."""
    first, second, pool = curate_samples(clean, golden=golden, few_shot=few_shot, seed=seed)
    export_template(first, f"{root}/golden", categories, force)
    export_template(second, f"{root}/few_shot", categories, force)
    pool.write.mode("overwrite" if force else "ignore").parquet(f"{root}/pool")


def write_few_shot(
    spark: SparkSession, annotated: str, target: str, categories=CATEGORIES
) -> DataFrame:
    """Filled-in few-shot template -> Markdown section; returns rows that lack valid labels."""
    good, todo = import_template(spark, annotated, categories)
    blocks = few_shot_blocks(dense_row_ids(good), categories)
    write_ordered_text(few_shot_lines(blocks), target)
    return todo
