"""Fixed-length token rows and a linear multi-label baseline on Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CATEGORIES, MAX_TOKENS_LEN
from ..functions import text as tx

# Ids of padding and of words outside the vocabulary.
PAD_ID = 0
UNKNOWN_ID = 1
FIRST_WORD_ID = 2
MAX_VOCABULARY = 200_000


def build_vocabulary(
    df: DataFrame, column: str = "content", size: int = 30_000
) -> DataFrame:
    """(token, token_id) of the ``size`` most frequent words; ties by word.

    ``size`` is the model's vocabulary size; it also bounds what is broadcast later.
    """
    words = df.select(F.explode(tx.word_tokens(tx.null_to_empty(column))).alias("token"))
    top = (
        words.groupBy("token")
        .agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), "token")
        .limit(size)
    )
    # At most ``size`` rows remain, so one task may number them.
    rank = F.row_number().over(Window.orderBy(F.col("n").desc(), "token"))
    return top.select("token", (rank - 1 + FIRST_WORD_ID).alias("token_id"))


def fixed_length_rows(
    df: DataFrame,
    vocabulary: DataFrame,
    categories=CATEGORIES,
    length: int = MAX_TOKENS_LEN,
    column: str = "content",
    id_col: str = "review_id",
) -> DataFrame:
    """(id, input_ids, attention_mask, labels): arrays of ``length``, cut or padded.

    ``vocabulary`` (token, token_id) has a bounded size, at most ``MAX_VOCABULARY`` words, so it is broadcast.
    The first ``length`` words of a row, no more, are looked up one by one and put together again by place;
    texts do not move. The id must be unique.
    """
    words = vocabulary.count()
    if words > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary of {words} words exceeds {MAX_VOCABULARY}")
    tokens = F.slice(tx.word_tokens(tx.null_to_empty(column)), 1, length)
    labels = F.array(*[F.col(c).cast("float") for c in categories])
    # The words are a column of their own before they are exploded, so that they are extracted once.
    cut = df.select(id_col, labels.alias("labels"), tokens.alias("_tokens"))
    words_ = cut.select(id_col, "labels", F.posexplode_outer("_tokens").alias("_place", "token"))
    placed = words_.join(F.broadcast(vocabulary.select("token", "token_id")), "token", "left")
    known = F.when(F.col("token").isNotNull(), F.coalesce("token_id", F.lit(UNKNOWN_ID)).cast("int"))
    entry = F.when(known.isNotNull(), F.struct("_place", known.alias("i")))
    grouped = placed.groupBy(id_col).agg(F.first("labels").alias("labels"), F.sort_array(F.collect_list(entry)).alias("_ids"))
    rows = grouped.select(id_col, "labels", F.col("_ids.i").alias("ids"))
    missing = F.lit(length) - F.size("ids")
    return rows.select(
        id_col,
        F.concat("ids", F.array_repeat(F.lit(PAD_ID), missing)).alias("input_ids"),
        F.concat(
            F.array_repeat(F.lit(1), F.size("ids")), F.array_repeat(F.lit(0), missing)
        ).alias("attention_mask"),
        "labels",
    )


def _tokens(df: DataFrame, column: str) -> DataFrame:
    # The words are a column of their own: inside an n-gram expression they would be
    # extracted again for every element.
    words = df.withColumn("_single", tx.word_tokens(tx.null_to_empty(column)))
    return words.withColumn("_words", F.concat("_single", tx.word_ngrams("_single", 2, 2))).drop(
        "_single"
    )


def fit_baseline(
    train: DataFrame,
    categories=CATEGORIES,
    column: str = "content",
    features: int = 1 << 14,
    max_iter: int = 20,
    reg: float = 0.01,
) -> PipelineModel:
    """Hashed words and word pairs -> TF-IDF -> one logistic regression per category.

    Targets are 0/1 columns. The featurized training rows are cached for the iterations.
    """
    rows = _tokens(train, column)
    featurizer = Pipeline(
        stages=[
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
            IDF(inputCol="_tf", outputCol="_features"),
        ]
    ).fit(rows)
    ready = featurizer.transform(rows).select("_features", *categories).cache()
    heads = [
        LogisticRegression(
            featuresCol="_features", labelCol=c, maxIter=max_iter, regParam=reg,
            rawPredictionCol=f"{c}_raw", probabilityCol=f"{c}_probability",
            predictionCol=f"{c}_prediction",
        ).fit(ready)
        for c in categories
    ]
    ready.unpersist()
    return PipelineModel([*featurizer.stages, *heads])


def baseline_logits(
    model: PipelineModel, df: DataFrame, categories=CATEGORIES, column: str = "content"
) -> DataFrame:
    """``df`` with ``{category}_logit`` from a fitted baseline."""
    scored = model.transform(_tokens(df, column))
    return scored.select(
        *df.columns,
        *[vector_to_array(f"{c}_raw").getItem(1).alias(f"{c}_logit") for c in categories],
    )
