"""Weak labelling: requests, responses, checkpoint and resume.

Predictions live in an append-only table keyed by review id. The labelling service itself
is outside: requests go out as JSON lines and responses come back as JSON lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    ABSENT,
    ALIASES,
    CATEGORIES,
    CHUNK_SIZE,
    ERROR,
    MAX_COMPLETION_TOKENS,
    NEG,
)
from ..functions import text as tx
from ..functions.labels import pred, pred_columns
from ..schemas import RESPONSE_LINE


# --- label columns -----------------------------------------------------------------

def project_labels(df: DataFrame, categories=CATEGORIES, content: str = "content") -> DataFrame:
    return df.select(content, *categories)


def rename_predictions(df: DataFrame, categories=CATEGORIES) -> DataFrame:
    return df.withColumnsRenamed({c: pred(c) for c in categories})


def promote_pseudo_labels(df: DataFrame, categories=CATEGORIES) -> DataFrame:
    """Predicted labels become the labels."""
    kept = [c for c in df.columns if c not in categories and c not in pred_columns(categories)]
    return df.select(*kept, *[F.col(pred(c)).alias(c) for c in categories])


def add_label_columns(df: DataFrame, categories=CATEGORIES) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast("string") for c in categories})


def drop_label_columns(df: DataFrame, categories=CATEGORIES) -> DataFrame:
    return df.drop(*categories)


# --- requests ----------------------------------------------------------------------

def encode_request_id(id_col: str = "review_id") -> Column:
    return F.concat(F.lit("row_"), F.col(id_col).cast("string"))


def decode_request_id(c="custom_id") -> Column:
    """Row id of a request id; null when it does not hold a number."""
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(c, F.lit("row_"), F.lit("")).try_cast("bigint")


def request_body(
    prompt: str, model: str, categories=CATEGORIES, content: str = "content"
) -> Column:
    """One chat request with a strict answer schema: every category NEG or ABSENT."""

    def message(role: str, text: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), text.alias("content"))

    domain = F.struct(
        F.lit("string").alias("type"), F.array(F.lit(NEG), F.lit(ABSENT)).alias("enum")
    )
    answer = F.struct(
        F.lit("object").alias("type"),
        F.struct(*[domain.alias(c) for c in categories]).alias("properties"),
        F.array(*[F.lit(c) for c in categories]).alias("required"),
        F.lit(False).alias("additionalProperties"),
    )
    review = F.concat(F.lit('Review: "'), tx.null_to_empty(content), F.lit('"'))
    return F.struct(
        F.lit(model).alias("model"),
        F.lit(0.0).alias("temperature"),
        F.lit(MAX_COMPLETION_TOKENS).alias("max_completion_tokens"),
        F.array(message("system", F.lit(prompt)), message("user", review)).alias("messages"),
        F.struct(
            F.lit("json_schema").alias("type"),
            F.struct(
                F.lit("defect_schema").alias("name"),
                F.lit(True).alias("strict"),
                answer.alias("schema"),
            ).alias("json_schema"),
        ).alias("response_format"),
    )


def label_requests(
    df: DataFrame,
    prompt: str,
    model: str,
    categories=CATEGORIES,
    id_col: str = "review_id",
    content: str = "content",
) -> DataFrame:
    """``df`` with ``line``, the JSON request of each row."""
    line = F.to_json(
        F.struct(
            encode_request_id(id_col).alias("custom_id"),
            F.lit("POST").alias("method"),
            F.lit("/v1/chat/completions").alias("url"),
            request_body(prompt, model, categories, content).alias("body"),
        )
    )
    return df.withColumn("line", line)


# --- responses ---------------------------------------------------------------------

def parse_responses(
    lines: DataFrame,
    categories=CATEGORIES,
    aliases: dict[str, str] = ALIASES,
    column: str = "line",
) -> DataFrame:
    """(review_id, {category}_pred ...) from response lines; blank lines are skipped.

    A category is ERROR unless the status is 200, the answer is a JSON object and holds
    the category, or its alias when the category itself is missing. A line without a
    usable id keeps a null id.
    """
    answered = (
        lines.where(F.trim(F.regexp_replace(column, r"\s+", " ")) != "")
        .select(F.from_json(column, RESPONSE_LINE).alias("r"))
        .select(
            decode_request_id("r.custom_id").alias("review_id"),
            F.when(
                F.col("r.response.status_code") == 200,
                F.from_json(
                    F.get(F.col("r.response.body.choices"), 0)["message"]["content"],
                    "map<string,string>",
                ),
            ).alias("answer"),
        )
    )

    def label(category: str) -> Column:
        answer = F.col("answer")
        found = F.when(
            F.map_contains_key(answer, category), F.try_element_at(answer, F.lit(category))
        )
        for alias in [a for a, c in aliases.items() if c == category]:
            found = found.when(
                F.map_contains_key(answer, alias), F.try_element_at(answer, F.lit(alias))
            )
        return found.otherwise(F.lit(ERROR))

    return answered.select("review_id", *[label(c).alias(pred(c)) for c in categories])


# --- checkpoint and resume ---------------------------------------------------------

def latest_predictions(
    attempts: DataFrame, categories=CATEGORIES, id_col: str = "review_id"
) -> DataFrame:
    """The last attempt of every review, from the checkpoint.

    Of several answers of one attempt a label beats ERROR in every category, then the order of
    the labels decides, so the result does not depend on the order of the rows.
    """
    usable = [(F.coalesce(F.col(c), F.lit(ERROR)) != ERROR).cast("int") for c in pred_columns(categories)]
    rank = F.struct(F.col("attempt"), sum(usable[1:], usable[0]).alias("usable"), *pred_columns(categories))
    best = attempts.groupBy(id_col).agg(F.max(rank).alias("p"))
    return best.select(id_col, "p.attempt", *[f"p.{c}" for c in pred_columns(categories)])


def attach_predictions(
    df: DataFrame, predictions: DataFrame, categories=CATEGORIES, id_col: str = "review_id"
) -> DataFrame:
    """All rows of ``df``; those without a prediction get nulls."""
    return df.join(predictions.select(id_col, *pred_columns(categories)), id_col, "left")


def pending_chunks(
    chunks: DataFrame, predictions: DataFrame, id_col: str = "review_id"
) -> DataFrame:
    """Rows of every chunk that has an unlabelled row; such a chunk is sent again whole.

    A row labelled ERROR counts as done.
    """
    todo = chunks.join(predictions.select(id_col), id_col, "left_anti")
    return chunks.join(todo.select("chunk_id").distinct(), "chunk_id", "left_semi")


def chunk_progress(
    chunks: DataFrame, predictions: DataFrame, id_col: str = "review_id"
) -> DataFrame:
    """(chunk_id, total_rows, done_rows) per chunk."""
    done = predictions.select(id_col, F.lit(1).alias("_done"))
    return (
        chunks.join(done, id_col, "left")
        .groupBy("chunk_id")
        .agg(F.count("*").alias("total_rows"), F.count("_done").alias("done_rows"))
    )


def progress(
    df: DataFrame, predictions: DataFrame, size: int = CHUNK_SIZE, id_col: str = "review_id"
) -> DataFrame:
    """One row: classified_rows, total_rows, total_chunks."""
    done = predictions.select(id_col, F.lit(1).alias("_done"))
    return df.select(id_col).join(done, id_col, "left").agg(
        F.count("_done").alias("classified_rows"),
        F.count("*").alias("total_rows"),
        F.ceil(F.count("*") / F.lit(size)).alias("total_chunks"),
    )


# --- few-shot examples -------------------------------------------------------------

FEW_SHOT_HEADER = "## 4. Few-Shot Demonstrations\n"


def _label_cell(categories) -> Column:
    """Labels as a JSON object with two-space indent, in category order."""
    entries = [
        F.concat(F.lit(f'  "{c}": "'), F.upper(F.trim(F.col(c).cast("string"))), F.lit('"'))
        for c in categories
    ]
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *entries), F.lit("\n}"))


def few_shot_blocks(
    numbered: DataFrame, categories=CATEGORIES, number: str = "row_id", content: str = "content"
) -> DataFrame:
    """(example, block): one Markdown block per row, numbered from 1 by a dense row id."""
    example = (F.col(number) + 1).cast("bigint")
    block = F.concat(
        F.lit("### Example "), example.cast("string"),
        F.lit('\n**Review:**\n"'), tx.sanitise_review(content),
        F.lit('"\n\n**Output:**\n```json\n'), _label_cell(categories), F.lit("\n```\n"),
    )
    return numbered.select(example.alias("example"), block.alias("block"))


def few_shot_lines(blocks: DataFrame) -> DataFrame:
    """(position, text): the header at 0 and every block at its example number, each ending as
    it does in the file. Joined in order by line breaks they are the Markdown section."""
    header = blocks.sparkSession.createDataFrame([(0, FEW_SHOT_HEADER)], "position long, text string")
    return header.unionByName(blocks.select(F.col("example").alias("position"), F.col("block").alias("text")))
