"""Sinks: partitioned splits, checksums, JSON documents and append-only logs."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Keeps part files far below the 2 GB a single binary value can hold.
MAX_RECORDS_PER_FILE = 100_000


def write_json_document(spark: SparkSession, path: str, payload: Mapping[str, Any]) -> str:
    """Write one small JSON document as a one-part text folder on any Hadoop file system."""
    body = json.dumps(payload, ensure_ascii=False, indent=2, sort_keys=True)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def append_metrics(spark: SparkSession, path: str, payload: Mapping[str, Any]) -> str:
    """Append one metrics payload as one JSON line; the folder can be tailed as a stream."""
    line = json.dumps(payload, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(path)
    return path


def sorted_json(df: DataFrame, column: str = "value") -> DataFrame:
    """One JSON text column with keys in sorted order, from typed columns."""
    names = sorted(df.columns)
    return df.select(F.to_json(F.struct(*[F.col(f"`{n}`") for n in names])).alias(column))


def write_splits(lines: DataFrame, path: str) -> None:
    """Write ``(split, value)`` as JSON lines, one folder per split, without a shuffle."""
    (
        lines.select("split", "value")
        .write.mode("overwrite")
        .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        .partitionBy("split")
        .text(path)
    )


def file_digests(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SHA-256 per part file, hashed where the file is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return reader.load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def folder_digest(digests: DataFrame, *keys: str) -> DataFrame:
    """One digest per key: SHA-256 over the sorted digests of its part files."""
    return digests.groupBy(*keys).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ""), 256).alias("sha256"),
        F.count(F.lit(1)).alias("files"),
    )


def path_digests(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, str]:
    """Name to digest for a handful of named paths (file or folder each)."""
    result = {}
    for name, path in paths.items():
        row = folder_digest(file_digests(spark, path)).first()
        result[name] = row["sha256"] if row and row["files"] else ""
    return result
