"""Versions of a stored table or model: a small file, written last, says which one is current."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the JVM for a path on any store that Spark can reach."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = file_system(spark, path)
    return fs.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    fs, target = file_system(spark, path)
    fs.delete(target, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; a missing folder has none."""
    fs, target = file_system(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(target)) if fs.exists(target) else []


def publish(spark: SparkSession, folder: str, version: int, content: dict) -> None:
    """Make ``version`` the current one of ``folder``.

    The file is written under another name and renamed, so that a reader finds it whole or not at
    all, and no published file is overwritten. A version that is there already is an error: another
    writer was faster.
    """
    fs, target = file_system(spark, f"{folder}/{version:09d}.json")
    _, draft = file_system(spark, f"{folder}/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise FileExistsError(f"{folder}: version {version}")


def current(spark: SparkSession, folder: str) -> tuple[int, dict] | None:
    """(version, content) published last, or None."""
    names = [n for n in children(spark, folder) if n.endswith(".json") and n[:-5].isdigit()]
    if not names:
        return None
    line = spark.read.text(f"{folder}/{names[-1]}", wholetext=True).first()["value"]
    return int(names[-1][:-5]), json.loads(line)
