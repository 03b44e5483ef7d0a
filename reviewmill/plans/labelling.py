"""One step of the resumable labelling run.

A run is: number and chunk the input, write requests for chunks that are not finished,
hand them to the service, read its answers, append them to the checkpoint, attach the
latest predictions to the input. A lost run starts again at the first step.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CATEGORIES, CHUNK_SIZE, ERROR
from ..functions import text as tx
from ..functions.labels import pred_columns
from ..operators.joins import lookup_join
from ..operators.labeling import (
    attach_predictions,
    label_requests,
    latest_predictions,
    pending_chunks,
)
from ..operators.sampling import assign_chunks
from ..operators.scoring import RateLimited, _call
from ..session import cut_lineage
from ..sources import answers as store_of
from ..sources.tables import append_checkpoint, read_checkpoint, read_responses, write_requests


def prepare_requests(
    spark: SparkSession,
    reviews: DataFrame,
    checkpoint_path: str,
    request_path: str,
    prompt: str,
    model: str,
    categories=CATEGORIES,
    chunk_size: int = CHUNK_SIZE,
) -> DataFrame:
    """Write request files for all unfinished chunks; returns the rows they cover."""
    chunks = assign_chunks(reviews, chunk_size)
    done = latest_predictions(read_checkpoint(spark, checkpoint_path, categories), categories)
    pending = pending_chunks(chunks, done)
    write_requests(label_requests(pending, prompt, model, categories), request_path)
    return pending


def collect_responses(
    spark: SparkSession,
    reviews: DataFrame,
    checkpoint_path: str,
    response_path: str,
    attempt: int,
    categories=CATEGORIES,
) -> DataFrame:
    """Append the answers of an attempt and return the input with its latest predictions."""
    append_checkpoint(
        read_responses(spark, response_path, categories), checkpoint_path, attempt, categories
    )
    latest = latest_predictions(read_checkpoint(spark, checkpoint_path, categories), categories)
    return attach_predictions(reviews, latest, categories)


COMMIT_EVERY = 20


def ask_chunk(
    texts: dict[str, str], folder: str, classify: Callable[[str], dict], categories=CATEGORIES,
    commit_every: int = COMMIT_EVERY, attempts: int = 5, wait: Callable[[float], None] = time.sleep,
) -> tuple[int, int]:
    """Ask about the texts of a chunk (by digest) that have no answer in ``folder`` yet; (asked, left).

    Answers are committed every ``commit_every`` texts and also when the service or the task gives up,
    so another attempt goes on where this one ended. A service that stays rate-limited ends the
    chunk: the rest is left for the next run.
    """
    have = store_of.committed(folder)
    todo = [digest for digest in sorted(texts) if digest not in have]
    fresh: dict[str, list[str]] = {}
    asked = 0
    try:
        for digest in todo:
            answer = _call(classify, texts[digest], attempts, wait)
            fresh[digest] = [ERROR if answer is None else answer.get(c, ERROR) for c in categories]
            asked += 1
            if len(fresh) >= commit_every:
                store_of.commit(folder, fresh, categories)
                fresh = {}
    except RateLimited:
        pass
    finally:
        store_of.commit(folder, fresh, categories)
    return asked, len(todo) - asked


def _chunks(batches: Iterator[pd.DataFrame], size: int) -> Iterator[dict[str, str]]:
    """Texts by digest, ``size`` at a time, of rows that come in the order of digests; each text once."""
    chunk, last = {}, None
    for rows in batches:
        for digest, text in zip(rows["text_digest"], rows["text"]):
            if digest == last:
                continue
            if len(chunk) >= size:
                yield chunk
                chunk = {}
            chunk[digest], last = text, digest
    if chunk:
        yield chunk


def label_once(
    reviews: DataFrame,
    load_classifier: Callable[[], Callable[[str], dict]],
    store: str,
    categories=CATEGORIES,
    chunk_size: int = CHUNK_SIZE,
    commit_every: int = COMMIT_EVERY,
    attempts: int = 5,
    wait: Callable[[float], None] = time.sleep,
    content: str = "content",
    id_col: str = "review_id",
    digest: str | None = None,
) -> DataFrame:
    """Add ``{category}_pred`` from a service that is asked once per text, over tasks and runs.

    Rows with the same text share one answer, and null text is asked about as empty text. Texts that the store has an
    answer for are not asked again, whatever run or task attempt that was. What a task has answered
    is committed every ``commit_every`` texts; only a machine that is lost between two commits, or a second
    copy of a task that is still alive (speculation), asks up to that many texts again.
    Failures of a text are its answer, ERROR in every category. Rows whose text has no answer because the
    service stayed rate-limited have null labels: call again with the same store.

    Tasks go through their texts in the order of digests, a chunk at a time, so a task that is tried again finds what
    it has committed, and a text that a third of the rows repeat is one text of one chunk. Texts are shuffled once, to
    meet the list of those that are wanted.

    ``digest`` names a column that holds the text's SHA-256 in hex (null: of the empty text) already. Where the result
    is used without its texts, these then take no part in the joins that add the labels.
    """
    spark = reviews.sparkSession
    names = pred_columns(categories)
    marked = reviews.withColumn("text_digest", F.col(digest) if digest else F.sha2(tx.null_to_empty(content), 256))
    texts = cut_lineage(
        marked.groupBy("text_digest").agg(F.count("*").alias("_rows"), F.min(id_col).alias(id_col))
    )
    known = store_of.read_answers(spark, store, categories)
    wanted = texts.join(known, "text_digest", "left_anti")
    place = F.xxhash64(id_col).alias("_place")  # a number for a null id, too
    wanted = cut_lineage(wanted.select("text_digest", place))
    if not wanted.isEmpty():
        run = uuid.uuid4().hex
        home = f"{store.rstrip('/')}/open/run={run}"

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            task = TaskContext.get().partitionId()
            for k, chunk in enumerate(_chunks(batches, chunk_size)):
                folder = f"{home}/chunk={task}_{k}"
                counts = ask_chunk(chunk, folder, load_classifier(), categories, commit_every, attempts, wait)
                yield pd.DataFrame([counts], columns=["asked", "left"])

        # Never broadcast nor split: rows that repeat an id and a text must meet in one task.
        whole = marked.select("text_digest", place, tx.null_to_empty(content).alias("text"))
        dealt = whole.repartition("text_digest", "_place").join(wanted.hint("merge"), ["text_digest", "_place"])
        dealt = dealt.select("text_digest", "text").sortWithinPartitions("text_digest")
        cut_lineage(dealt.mapInPandas(ask, "asked long, left long"))
        store_of.close_run(spark, store, run, categories)
        known = store_of.read_answers(spark, store, categories)
    answered = texts.select("text_digest", "_rows").join(known, "text_digest", "left")
    total = texts.agg(F.sum("_rows")).first()[0] or 0
    labelled = lookup_join(marked, answered, ["text_digest"], "_rows", total)
    return labelled.select(*reviews.columns, *names)
