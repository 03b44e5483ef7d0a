"""Readers and writers. Schemas are declared, never inferred."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..constants import CATEGORIES, SPLITS
from ..operators.labeling import latest_predictions, parse_responses
from ..operators.sampling import dense_row_ids
from ..operators.validation import validate_labels
from ..session import cut_lineage
from . import versions

# Quotes are doubled inside quoted fields, and texts may hold line breaks.
# The null marker cannot occur in text, so a quoted empty field stays an empty text.
_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "nullValue": "\u0000"}


# --- CSV and Parquet ---------------------------------------------------------------

def read_csv(
    spark: SparkSession, path: str, schema: StructType, timestamp_format: str | None = None
) -> DataFrame:
    """CSV whose header must be the schema's columns in their order.

    Another order or name is an error, not a shift of values. A multi-line file cannot be split,
    so land it as Parquet once (``land_reviews``).
    """
    reader = spark.read.schema(schema).options(**_CSV).option("mode", "FAILFAST")
    reader = reader.option("enforceSchema", "false")
    if timestamp_format:
        reader = reader.option("timestampFormat", timestamp_format)
    return reader.csv(path)


def write_csv(
    df: DataFrame, path: str, id_col: str | None = None, mode: str = "overwrite"
) -> None:
    """CSV with a header and all columns of ``df``; ``id_col`` goes first. To leave a column out,
    drop it before."""
    kept = [*([id_col] if id_col else []), *[c for c in df.columns if c != id_col]]
    # An unquoted empty field reads back as null, so empty texts are written quoted.
    df.select(*kept).write.mode(mode).options(
        header=True, quote='"', escape='"', emptyValue='""', timestampFormat="yyyy-MM-dd HH:mm:ss"
    ).csv(path)


def read_reviews(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType = schemas.REVIEWS
) -> DataFrame:
    """The review record from CSV, JSON lines, ORC or Parquet."""
    if fmt == "csv":
        return read_csv(spark, path, schema, "yyyy-MM-dd HH:mm:ss")
    if fmt not in ("parquet", "json", "orc"):
        raise ValueError(f"unknown format {fmt!r}")
    return spark.read.schema(schema).format(fmt).load(path).select(*schema.names)


def _raw_reviews(spark: SparkSession, source: str, fmt: str, index: bool) -> DataFrame:
    """Raw review files with the columns' names of the review record, without an id."""
    if index:
        # An unnamed header field reads as _c0, so names are checked here and types cast.
        rows = spark.read.options(**_CSV).csv(source)
        if rows.columns != schemas.RAW_INDEXED.names:
            raise ValueError(f"header {rows.columns} is not {schemas.RAW_INDEXED.names}")
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.RAW.fields])
    else:
        rows = read_reviews(spark, source, fmt, schemas.RAW)
    return rows.withColumnsRenamed(schemas.RAW_NAMES)


def land_reviews(
    spark: SparkSession, source: str, target: str, fmt: str = "csv", index: bool = False
) -> DataFrame:
    """Raw review files (user, score, time, text, without an id) -> the review record as Parquet.

    ``index`` says that the files have an unnamed index column in front. Ids are given once,
    while the rows are written: file by file, by the place of the row in it. They are unique and
    stay; they are not dense.
    """
    named = _raw_reviews(spark, source, fmt, index)
    columns = [c for c in schemas.REVIEWS.names if c != "review_id"]
    numbered = named.select(F.monotonically_increasing_id().alias("review_id"), *columns)
    numbered.write.mode("overwrite").parquet(target)
    return read_reviews(spark, target)


def _landed_parts(spark: SparkSession, target: str) -> tuple[int, int]:
    """(landings, ids given) of a table of repeated landings; (0, 0) when there is none."""
    found = versions.current(spark, f"{target.rstrip('/')}/_manifest")
    return (found[0], found[1]["ids"]) if found else (0, 0)


def read_landings(spark: SparkSession, target: str) -> DataFrame:
    """The review record of all finished landings, with the number of its ``landing``."""
    last, _ = _landed_parts(spark, target)
    if not last:
        return spark.createDataFrame([], schemas.LANDED).drop("row_digest")
    rows = spark.read.schema(schemas.LANDED).parquet(target).drop("row_digest")
    return rows.where(F.col("landing") <= last)


def land_more(
    spark: SparkSession, source: str, target: str, fmt: str = "csv", index: bool = False
) -> DataFrame:
    """Land those raw reviews that no earlier landing holds; all landings, as ``read_landings``.

    Later files may overlap with earlier ones: a review is known by its user, score, time and text
    together, and lands once, however often it comes. Ids go on where the landing before ended, without
    gaps, and never change. The manifest of a landing is written last: one that broke off is not
    read, gives no ids away and is replaced by the next. One writer at a time.

    Digests alone are compared; texts are shuffled once, by the place of their row, which no two rows share.
    """
    last, ids = _landed_parts(spark, target)
    named = _raw_reviews(spark, source, fmt, index)
    fields = ["user_name", "score", F.unix_micros("reviewed_at").alias("at"), "content"]
    staged = cut_lineage(named.select(
        "*", F.sha2(F.to_json(F.struct(*fields)), 256).alias("row_digest"),
        F.monotonically_increasing_id().alias("_row"),
    ))
    new = staged.groupBy("row_digest").agg(F.min("_row").alias("_row"))
    if last:
        landed = spark.read.schema(schemas.LANDED).parquet(target).where(F.col("landing") <= last)
        new = new.join(landed.select("row_digest"), "row_digest", "left_anti")
    numbered = cut_lineage(dense_row_ids(cut_lineage(new.select("_row")), "_row", "_nth"))
    count = numbered.count()
    if count:
        rows = staged.join(numbered, "_row").withColumn("review_id", F.col("_nth") + F.lit(ids))
        stored = rows.select(*[c for c in schemas.LANDED.names if c != "landing"])
        stored.write.mode("overwrite").parquet(f"{target.rstrip('/')}/landing={last + 1}")
        versions.publish(spark, f"{target.rstrip('/')}/_manifest", last + 1, {"ids": ids + count})
    return read_landings(spark, target)


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Parquet, reading only the named columns."""
    return spark.read.parquet(path).select(*columns)


def write_splits(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy("split").parquet(path)


def read_split(
    spark: SparkSession, path: str, split: str, categories=CATEGORIES
) -> DataFrame:
    """One of train, valid, test: only that partition is listed and read."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}, expected one of {SPLITS}")
    rows = spark.read.schema(schemas.split(categories)).parquet(path)
    return rows.where(F.col("split") == split).drop("split")


def predictions_path(root: str, input_name: str, prompt: str, model: str) -> str:
    """Folder of one labelling run, spelled as partition columns.

    ``input_name`` is the full table name, so two inputs of the same file stem do not
    share a folder.
    """
    clean = [re.sub(r"[^\w.-]+", "-", p).strip("-") for p in (input_name, prompt, model)]
    return "{}/input={}/prompt={}/model={}".format(root.rstrip("/"), *clean)


def _run_folder(root: str, **run: str) -> str:
    """Partition folder of a run; signs that a folder name may not hold are escaped as Spark reads
    them, so that two runs never share one and their names come back unchanged."""
    if not all(run.values()):
        raise ValueError("an input, prompt or model needs a name")

    def spelled(value: str) -> str:
        return re.sub(r"[\x00-\x7f]", lambda m: m[0] if re.match(r"[\w.-]", m[0]) else f"%{ord(m[0]):02X}", value)

    return "/".join([root.rstrip("/"), *[f"{column}={spelled(value)}" for column, value in run.items()]])


def write_predictions(
    predictions: DataFrame, root: str, input_name: str, prompt: str, model: str, categories=CATEGORIES
) -> None:
    """Write one run's labels; an earlier result of the same run goes, even when the new one is empty."""
    path = _run_folder(root, input=input_name, prompt=prompt, model=model)
    names = [f.name for f in schemas.predictions(categories).fields][:-3]
    predictions.select(*names).write.mode("overwrite").parquet(path)


def read_predictions(
    spark: SparkSession, root: str, categories=CATEGORIES,
    input_name: str | None = None, prompt: str | None = None, model: str | None = None,
) -> DataFrame:
    """Labels of all runs, or of those with the given input, prompt and model: only their folders are read."""
    rows = spark.read.schema(schemas.predictions(categories)).parquet(root)
    for column, value in (("input", input_name), ("prompt", prompt), ("model", model)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


# --- prompts, requests, responses ---------------------------------------------------

def read_prompt(spark: SparkSession, path: str) -> str:
    """A prompt file as one string; a folder's files are joined in the order of their names."""
    files = spark.read.text(path, wholetext=True).select("_metadata.file_name", "value")
    rows = files.orderBy("file_name").collect()
    if not rows:
        raise FileNotFoundError(path)
    return "".join(r["value"] for r in rows)


def write_ordered_text(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """(position, text) as text files that read in order by file name, whatever their number."""
    ordered = rows.repartitionByRange("position").sortWithinPartitions("position")
    ordered.select("text").write.mode(mode).text(path)


CHUNKS_PER_GROUP = 1000


def write_requests(
    requests: DataFrame, path: str, mode: str = "overwrite", chunks_per_group: int = CHUNKS_PER_GROUP
) -> None:
    """JSON lines by chunk: one folder per ``chunks_per_group`` chunks, its lines in chunk order.

    A billion reviews in chunks of 500 are two thousand folders, not two million.
    """
    group = F.floor(F.col("chunk_id") / chunks_per_group).cast("int")
    (
        requests.select(group.alias("chunk_group"), "chunk_id", F.col("line").alias("value"))
        .repartition("chunk_group")
        .sortWithinPartitions("chunk_group", "chunk_id")
        .drop("chunk_id")
        .write.mode(mode)
        .partitionBy("chunk_group")
        .text(path)
    )


def read_responses(
    spark: SparkSession, path: str, categories=CATEGORIES, aliases: dict[str, str] | None = None
) -> DataFrame:
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    extra = {} if aliases is None else {"aliases": aliases}
    return parse_responses(lines, categories, **extra)


# --- label checkpoint ---------------------------------------------------------------

IDS_PER_RANGE = 10_000_000


def _attempts(spark: SparkSession, path: str, categories, after: int | None) -> DataFrame:
    rows = spark.read.schema(schemas.checkpoint(categories)).parquet(path)
    return rows if after is None else rows.where(F.col("attempt") > after)


def _snapshot(spark: SparkSession, path: str, categories, ranges: dict[str, int]) -> DataFrame:
    """Rows of the named id ranges, each from the version that holds it."""
    schema = schemas.checkpoint(categories)
    if not ranges:
        return spark.createDataFrame([], schema)
    home = f"{path.rstrip('/')}/_snapshot"
    folders = [f"{home}/version={v}/id_range={r}" for r, v in ranges.items()]
    return spark.read.schema(schema).parquet(*folders)


def read_checkpoint(spark: SparkSession, path: str, categories=CATEGORIES) -> DataFrame:
    """All attempts that still count: the snapshot, if there is one, and every later attempt.

    A missing table is empty. An unreadable file is an error: skipping it would bring older labels
    back. To start over after damage, begin a new table.
    """
    if not versions.exists(spark, path):
        return spark.createDataFrame([], schemas.checkpoint(categories))
    found = versions.current(spark, f"{path.rstrip('/')}/_manifest")
    if found is None:
        return _attempts(spark, path, categories, None)
    state = found[1]
    merged = _snapshot(spark, path, categories, state["ranges"])
    return merged.unionByName(_attempts(spark, path, categories, state["attempt"]))


def compact_checkpoint(
    spark: SparkSession, path: str, categories=CATEGORIES, ids_per_range: int = IDS_PER_RANGE
) -> int:
    """Merge all attempts into the snapshot, one row per review; returns the snapshot's version.

    Only id ranges with later attempts are written anew; the manifest names the version of each
    range and is written last, so a merge that breaks off changes nothing and is repeated whole. The
    manifest has one entry per range of ``ids_per_range`` ids, which the first merge fixes. Merged
    attempts stay on disk until ``prune_checkpoint``.
    """
    home = path.rstrip("/")
    found = versions.current(spark, f"{home}/_manifest")
    version, state = found or (0, {"attempt": None, "ids_per_range": ids_per_range, "ranges": {}})
    id_range = F.floor(F.col("review_id") / F.lit(state["ids_per_range"])).cast("bigint").alias("id_range")
    newer = _attempts(spark, path, categories, state["attempt"])
    touched = newer.groupBy(id_range).agg(F.max("attempt").alias("attempt")).collect()  # a row per range
    if not touched:
        return version
    names = [str(r["id_range"]) for r in touched]
    old = _snapshot(spark, path, categories, {n: state["ranges"][n] for n in names if n in state["ranges"]})
    latest = latest_predictions(old.unionByName(newer), categories).withColumn("id_range", id_range)
    (
        latest.select(*schemas.checkpoint(categories).names, "id_range")
        .repartitionByRange("id_range", "review_id")
        .sortWithinPartitions("id_range", "review_id")
        .write.mode("overwrite").partitionBy("id_range").parquet(f"{home}/_snapshot/version={version + 1}")
    )
    versions.publish(spark, f"{home}/_manifest", version + 1, {
        "attempt": max(r["attempt"] for r in touched), "ids_per_range": state["ids_per_range"],
        "ranges": {**state["ranges"], **dict.fromkeys(names, version + 1)},
    })
    return version + 1


def prune_checkpoint(spark: SparkSession, path: str) -> None:
    """Delete what the current manifest no longer needs: merged attempts and replaced ranges.

    Run it when nobody reads by an older manifest.
    """
    home = path.rstrip("/")
    found = versions.current(spark, f"{home}/_manifest")
    if found is None:
        return
    last, state = found
    for name in versions.children(spark, home):
        if name.startswith("attempt=") and int(name[8:]) <= state["attempt"]:
            versions.delete(spark, f"{home}/{name}")
    for folder in versions.children(spark, f"{home}/_snapshot"):
        version = int(folder.removeprefix("version="))
        for name in versions.children(spark, f"{home}/_snapshot/{folder}") if version <= last else []:
            if name.startswith("id_range=") and state["ranges"].get(name[9:]) != version:
                versions.delete(spark, f"{home}/_snapshot/{folder}/{name}")


def append_checkpoint(
    predictions: DataFrame, path: str, attempt: int, categories=CATEGORIES
) -> None:
    """Write one attempt; other attempts stay, and the highest wins on reading.

    Each attempt is a partition of its own, so that writing one again replaces it. Answers
    whose id could not be read go to ``_unidentified`` beside the attempts, one folder each. An
    attempt that a snapshot has merged cannot be written again.
    """
    found = versions.current(predictions.sparkSession, f"{path.rstrip('/')}/_manifest")
    if found is not None and attempt <= found[1]["attempt"]:
        raise ValueError(f"attempt {attempt} is merged already; go on with {found[1]['attempt'] + 1}")
    rows = predictions.withColumn("attempt", F.lit(attempt).cast("bigint")).select(
        *schemas.checkpoint(categories).names
    )
    named = rows.where(F.col("review_id").isNotNull())
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("attempt").parquet(path)
    lost = rows.where(F.col("review_id").isNull()).drop("review_id", "attempt")
    lost.write.mode("overwrite").parquet(f"{path.rstrip('/')}/_unidentified/attempt={attempt}")


def read_unidentified(spark: SparkSession, path: str, attempt: int, categories=CATEGORIES) -> DataFrame:
    """Answers of an attempt without a usable id."""
    named = schemas.checkpoint(categories)
    schema = StructType([f for f in named.fields if f.name not in ("review_id", "attempt")])
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/_unidentified/attempt={attempt}")


# --- hand annotation ----------------------------------------------------------------

def export_template(
    df: DataFrame, path: str, categories=CATEGORIES, force: bool = False
) -> None:
    """Sampled rows with empty label columns; an existing template stays unless forced."""
    empty = df.withColumns({c: F.lit(None).cast("string") for c in categories})
    empty.write.mode("overwrite" if force else "ignore").options(
        header=True, quote='"', escape='"', timestampFormat="yyyy-MM-dd HH:mm:ss"
    ).csv(path)


def import_template(
    spark: SparkSession, path: str, categories=CATEGORIES
) -> tuple[DataFrame, DataFrame]:
    """(rows with valid labels, rows to be annotated again)."""
    df = read_csv(spark, path, schemas.golden(categories), "yyyy-MM-dd HH:mm:ss")
    return validate_labels(df, list(categories))


# --- metrics log and files ----------------------------------------------------------

def append_metrics(row: DataFrame, path: str) -> None:
    row.write.mode("append").parquet(path)

