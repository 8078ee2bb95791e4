"""Readers: strict and lenient JSON lines, Parquet, token sequences, manifest-driven splits."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusops.contracts import DatasetError, MalformedLineError
from corpusops.functions.records import VariantRecord
from corpusops.functions.text import NOT_SPACE
from corpusops.sources.positions import scan_position, with_row_numbers

JSONL = "JSONL"
PARQUET = "PARQUET"
PAYLOAD_FIELDS = ("text", "src", "tgt")


def normalise_format(name: str) -> str:
    candidate = name.strip().upper()
    if candidate not in (JSONL, PARQUET):
        raise DatasetError(f"unsupported format '{name}', expected one of {[JSONL, PARQUET]}")
    return candidate


def not_blank(line: Column) -> Column:
    """Whether a line has any visible character; the search stops at the first one."""
    return line.rlike(NOT_SPACE)


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Add ``v`` (VARIANT, null when malformed) and drop blank lines."""
    return lines.filter(not_blank(F.col(column))).withColumn("v", F.try_parse_json(column))


def is_object(line: str = "value") -> Column:
    """Whether a parsed line is a JSON object, told from its first character."""
    return F.col("v").isNotNull() & F.col(line).rlike(r"^\s*\{")


def line_problem() -> Column:
    """Why a line is no record; only meant for lines that hold no object."""
    return F.when(F.col("v").isNull(), "malformed JSON").otherwise("not a JSON object")


def bad_lines(parsed: DataFrame) -> DataFrame:
    """Rows a strict reader refuses, with the reason."""
    return parsed.filter(~is_object()).withColumn("problem", line_problem())


def scan_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Non-blank lines with their scan position, parsed but not judged."""
    lines = spark.read.text(path).select("value", "_metadata")
    return (
        lines.filter(not_blank(F.col("value")))
        .select("value", scan_position())
        .withColumn("v", F.try_parse_json("value"))
    )


def read_jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Strict reader: refuses the dataset at its first malformed or non-object line.

    One pass decides; only if something is wrong does a second one find the line number, for
    which blank lines count.
    """
    scanned = scan_lines(spark, path)
    if not bad_lines(scanned).limit(1).isEmpty():
        every_line = spark.read.text(path).select("value", "_metadata").select("value", scan_position())
        numbered = with_row_numbers(every_line, "line_no")
        first = bad_lines(parse_lines(numbered)).orderBy("line_no").select("line_no", "problem").first()
        raise MalformedLineError(f"{first['problem']} on line {first['line_no']}")
    return scanned


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Typed reader; carries the scan position so that rows can be numbered."""
    scan = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return scan.select("*", scan_position())


def read_dataset(spark: SparkSession, path: str | list[str], fmt: str) -> DataFrame:
    return read_jsonl(spark, path) if normalise_format(fmt) == JSONL else read_parquet(spark, path)


def payloads(df: DataFrame, fields: Iterable[Column], keep: Iterable[str] = ()) -> DataFrame:
    """One row per text payload, in field order, nulls dropped: a single scan, no union."""
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("pos"), F.lit(name).alias("field"), column.alias("payload"))
            for i, (name, column) in enumerate(zip(PAYLOAD_FIELDS, fields))
        ]
    )
    return df.select(*keep, F.inline(F.filter(entries, lambda e: e["payload"].isNotNull())))


def text_payloads(parsed: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Lenient text scan over parsed lines: anything that is not an object is skipped."""
    record = VariantRecord("v")
    return payloads(parsed.filter(is_object()), [record.shown(f) for f in PAYLOAD_FIELDS], keep)


def task_samples(parsed: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Lenient text scan with the task of each payload (``unknown`` when there is none).

    A mapping counts by its type, so tasks stay few however many records there are.
    """
    record = VariantRecord("v")
    name = F.when(record.is_mapping("task"), record.shown("task", "type")).otherwise(record.shown("task"))
    tagged = parsed.withColumn("task", F.coalesce(name, F.lit("unknown")))
    return text_payloads(tagged, [*keep, "task"])


def read_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return text_payloads(parse_lines(spark.read.text(path)))


def default_mask(ids: Column, mask: Column) -> Column:
    return F.coalesce(mask, F.transform(ids, lambda _: F.lit(1)))


def read_sequences(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Token sequences; a missing attention mask means every token counts."""
    raw = spark.read.schema("input_ids ARRAY<INT>, attention_mask ARRAY<INT>").json(path)
    return raw.withColumn("attention_mask", default_mask(F.col("input_ids"), F.col("attention_mask")))


def read_json_document(spark: SparkSession, path: str) -> dict:
    """A small JSON document (manifest, report) from any Hadoop path, file or one-part folder."""
    rows = spark.read.text(path, wholetext=True).take(1)
    if not rows:
        raise DatasetError(f"empty document: {path}")
    return json.loads(rows[0][0])


def split_paths(manifest: Mapping, split: str) -> list[str]:
    """Paths of one split; an entry is an object or a list of objects. Empty if absent."""
    entry = (manifest.get("splits") or {}).get(split)
    if not entry:
        return []
    if isinstance(entry, Mapping):
        entry = [entry]
    if not isinstance(entry, list):
        raise DatasetError(f"split '{split}' must be an object or a list")
    return [item["path"] for item in entry if item.get("path")]


def training_paths(manifest: Mapping) -> list[str]:
    paths = split_paths(manifest, "train")
    if not paths:
        raise DatasetError("the dataset manifest must contain a train split")
    return paths


def read_splits(spark: SparkSession, manifest: Mapping, splits: Iterable[str] | None = None) -> DataFrame:
    """Lines of the requested splits, tagged with the split's name.

    Unknown or missing splits are skipped. Each path is read once; the union adds no shuffle.
    """
    names = list(manifest.get("splits", {})) if splits is None else list(splits)
    scans = None
    for name in names:
        paths = [p for p in split_paths(manifest, name) if _exists(spark, p)]
        if paths:
            scan = spark.read.text(paths).select(F.lit(name).alias("split"), "value")
            scans = scan if scans is None else scans.unionAll(scan)
    if scans is None:
        return spark.createDataFrame([], "split string, value string")
    return scans


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)
