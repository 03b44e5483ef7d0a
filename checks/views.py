"""Input views over the shared test tables, for Spark and as SQL text.

``documents`` stand in for reviews and ``labels`` for the golden set, with two categories.
Model outputs, responses and the metrics log are derived from them by arithmetic.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.operators.scoring import RateLimited
from reviewmill.session import spread
from reviewmill.sources import answers

CATEGORIES = ["LOW_QUALITY", "TOXIC"]
ALIASES = {"QUALITY_LOW": "LOW_QUALITY"}

# Valid in Spark SQL and in DuckDB.
SQL = {
    "reviews": """
SELECT doc_id AS review_id, source AS user_name, CAST(doc_id % 5 + 1 AS INT) AS score,
       text AS content FROM documents""",
    "gold": """
SELECT doc_id AS review_id,
       CASE WHEN quality = 0 THEN 'NEG' ELSE 'ABSENT' END AS LOW_QUALITY,
       CASE WHEN toxic = 1 THEN 'NEG' ELSE 'ABSENT' END AS TOXIC FROM labels""",
    "gold_reviews": """
SELECT r.review_id, r.score, r.content, g.LOW_QUALITY, g.TOXIC
FROM gold g JOIN reviews r ON g.review_id = r.review_id""",
    "scores": """
SELECT review_id,
  (CASE WHEN LOW_QUALITY = 'NEG' THEN 1 ELSE -1 END) * (CASE WHEN review_id % 7 = 0 THEN -1 ELSE 1 END)
    * (0.25E0 + CAST(review_id % 13 AS DOUBLE) / 4) AS LOW_QUALITY_logit,
  (CASE WHEN TOXIC = 'NEG' THEN 1 ELSE -1 END) * (CASE WHEN review_id % 11 = 0 THEN -1 ELSE 1 END)
    * (0.25E0 + CAST(review_id % 17 AS DOUBLE) / 4) AS TOXIC_logit FROM gold""",
    "responses": """
SELECT review_id, CASE WHEN review_id % 29 = 0 THEN '' ELSE concat(
  '{"custom_id":"row_', CAST(review_id AS VARCHAR(20)), '","response":{"status_code":',
  CASE WHEN review_id % 17 = 0 THEN '500' ELSE '200' END,
  ',"body":{"choices":[{"message":{"content":"',
  CASE WHEN review_id % 19 = 0 THEN 'not json'
       ELSE replace(concat('{"',
              CASE WHEN review_id % 23 = 0 THEN 'QUALITY_LOW' ELSE 'LOW_QUALITY' END,
              '":"', LOW_QUALITY, '"',
              CASE WHEN review_id % 13 = 0 THEN '' ELSE concat(',"TOXIC":"', TOXIC, '"') END,
              '}'), '"', concat(chr(92), '"')) END,
  '"}}]}}}') END AS line FROM gold""",
    "epochs": """
SELECT CAST(lang AS VARCHAR(8)) AS run, CAST(doc_id % 6 AS INT) AS epoch,
       round(avg(CAST(n_chars % 97 AS DOUBLE)), 1) AS val_macro_f1_mean
FROM documents GROUP BY lang, doc_id % 6""",
}

_NEEDS = {
    "gold_reviews": ["gold", "reviews"],
    "scores": ["gold"],
    "responses": ["gold"],
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; nothing is registered in the session's catalog."""
    frames = {
        t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")
    }
    defined = [*_NEEDS.get(name, []), name]
    sql = "WITH documents AS (SELECT * FROM {documents}), labels AS (SELECT * FROM {labels}), "
    sql += ", ".join(f"{d} AS ({SQL[d].replace('{', '{{').replace('}', '}}')})" for d in defined)
    return spark.sql(f"{sql} SELECT * FROM {name}", **frames)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with enough tasks for text work when the file has few row groups."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spread(
        docs.select(
            F.col("doc_id").alias("review_id"),
            F.col("source").alias("user_name"),
            (F.col("doc_id") % 5 + 1).cast("int").alias("score"),
            F.col("text").alias("content"),
        )
    )


# Eight more categories: by arithmetic on the id, from every 40th row to every second one.
_FLAGS = {f"FLAG_{i}": (7 * i + 3, 2 + 5 * i) for i in range(8)}
TEN_LABELS = [*CATEGORIES, *_FLAGS]


def flag_sql(name: str) -> str:
    factor, rate = _FLAGS[name]
    return f"(review_id * {factor} + review_id // 7) % 97 < {rate}"


def ten_labels(gold: DataFrame) -> DataFrame:
    flags = {
        c: F.when(F.expr(flag_sql(c).replace("//", "div")), F.lit("NEG")).otherwise(F.lit("ABSENT")) for c in _FLAGS
    }
    return gold.withColumns(flags)


# --- deterministic stand-ins for a neural model and a labelling service --------------

def load_length_model():
    """Scorer whose logits depend on the length of the whole text."""

    def score(texts):
        return [[(len(t) % 23 - 11) / 4, (len(t) % 29 - 14) / 4] for t in texts]

    return score


def load_flaky_classifier():
    """Classifier that is rate-limited on first calls, fails on some texts and now and then
    leaves a category out."""
    state = {"calls": 0}

    def classify(text):
        n = len(text)
        state["calls"] += 1
        if state["calls"] <= n % 3:
            raise RateLimited()
        state["calls"] = 0
        if n % 19 == 0:
            raise ValueError("no answer")
        answer = {"LOW_QUALITY": "NEG" if n % 2 else "ABSENT"}
        if n % 13:
            answer["TOXIC"] = "NEG" if n % 5 == 0 else "ABSENT"
        return answer

    return classify


class CountedClassifier:
    """Service that writes down every text it answers, in a file of its own, and may break down.

    ``breaks``: texts of some lengths find it rate-limited for good, and it answers nothing after that.
    """

    def __init__(self, log: str, breaks: bool):
        self.log, self.breaks = log, breaks

    def __call__(self):
        fs, folder = answers.file_system(self.log)
        fs.create_dir(folder, recursive=True)
        lines = fs.open_output_stream(f"{folder}/{uuid.uuid4().hex}.txt")

        def classify(text):
            n = len(text)
            if self.breaks and n % 7 == 3:
                raise RateLimited()
            lines.write((hashlib.sha256(text.encode()).hexdigest() + "\n").encode())
            lines.flush()
            if n % 19 == 0:
                raise ValueError("no answer")
            return {"LOW_QUALITY": "NEG" if n % 2 else "ABSENT", "TOXIC": "NEG" if n % 5 == 0 else "ABSENT"}

        return classify


def no_wait(seconds: float) -> None:
    return None
