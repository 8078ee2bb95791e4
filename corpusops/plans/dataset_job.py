"""Whole jobs over one dataset: validate it, and process it into splits with a manifest."""

from __future__ import annotations

import time
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusops.contracts import Contract, DatasetError, InvalidDatasetError
from corpusops.operators.profile import profile, profile_view
from corpusops.operators.ranking import OrderKey, below, cut_points
from corpusops.operators.splits import allocate, normalise_ratios
from corpusops.operators.validation import check, error_rows, record_of, summary
from corpusops.plans.run_tables import RunLog
from corpusops.session import WrittenTable
from corpusops.sources.positions import POSITION, block_offsets, number_rows
from corpusops.sources.readers import JSONL, is_object, normalise_format, read_jsonl, read_parquet, scan_lines
from corpusops.sources.writers import append_metrics, file_digests, folder_digest, write_json_document, write_splits


def utc_now() -> str:
    return datetime.now(timezone.utc).isoformat().replace("+00:00", "Z")


def stem(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]


def _scan(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    return scan_lines(spark, path) if fmt == JSONL else read_parquet(spark, path)


def _refuse_bad_lines(spark: SparkSession, path: str, bad: int) -> None:
    if bad:
        read_jsonl(spark, path)


def validate_dataset(
    spark: SparkSession,
    path: str,
    contract: Contract,
    fmt: str = JSONL,
    out: str | None = None,
    metrics_path: str | None = None,
    run: RunLog | None = None,
) -> dict[str, Any]:
    """Validation report of a dataset. One pass counts; rows are numbered only if any is wrong.

    With ``out`` the errors, which can be as many as the rows, are written as a Parquet table
    beside the summary document. ``metrics_path`` and ``run`` also get the figures.
    """
    fmt = normalise_format(fmt)
    started = time.perf_counter()
    checked = check(_scan(spark, path, fmt), contract)
    bad = F.count_if(~is_object()) if fmt == JSONL else F.lit(0).cast("long")
    counts = checked.agg(
        bad.alias("bad"), F.count(F.lit(1)).alias("total"), F.count_if(F.size("errors") == 0).alias("valid")
    ).first()
    _refuse_bad_lines(spark, path, counts["bad"])
    report = {
        "rows_total": counts["total"],
        "rows_valid": counts["valid"],
        "rows_invalid": counts["total"] - counts["valid"],
        "duration_sec": round(time.perf_counter() - started, 6),
    }
    if out is not None:
        if report["rows_invalid"]:
            errors_of(checked).write.mode("overwrite").parquet(f"{out}/errors")
        write_json_document(spark, f"{out}/report_validation.json", report)
    if metrics_path is not None:
        append_metrics(spark, metrics_path, report)
    if run is not None:
        run.log_job({"dataset": path, "format": fmt}, report, {"report_validation.json": report})
    return report


def errors_of(checked: DataFrame) -> DataFrame:
    """Numbered errors ``(row, ord, message)`` of a checked scan. Only the wrong rows are joined."""
    return number_rows(error_rows(checked, POSITION), block_offsets(checked)).select("row", "ord", "message")


@dataclass(frozen=True)
class ProcessResult:
    manifest: dict[str, Any]
    stats: dict[str, Any]
    validation: dict[str, int]
    duration_sec: float

    def metrics(self) -> dict[str, Any]:
        total = self.validation["rows_total"]
        return {
            "rows_total": total,
            "valid_ratio": self.validation["rows_valid"] / total if total else 0.0,
            "task_distribution": self.stats["task_distribution"],
            "noise_rate": self.stats["noise_rate"],
            "rows_per_split": {name: s["rows"] for name, s in self.manifest["splits"].items()},
            "duration_sec": self.duration_sec,
        }


def _order_key(seed: int) -> OrderKey:
    return OrderKey(
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("id", F.lit("")))),
        F.col("body_md5"),
        F.lpad(F.lower(F.hex("place")), 16, "0"),
    )


def process_dataset(
    spark: SparkSession,
    path: str,
    contract: Contract,
    fmt: str,
    ratios: Mapping[str, float],
    seed: int,
    out: str,
    schema_path: str | None = None,
    metrics_path: str | None = None,
    run: RunLog | None = None,
) -> ProcessResult:
    """Gate, profile and split a dataset, and write splits, checksums, statistics and manifest.

    Raw records are parsed twice: once into a narrow table, from which the gate, the statistics
    and the cut points are read, and once more when the splits are written. Nothing is shuffled
    but counts and ids.
    """
    fmt = normalise_format(fmt)
    ratios = normalise_ratios(ratios)
    scan = check(_scan(spark, path, fmt), contract)
    record = record_of(scan)
    if fmt == JSONL:
        body = F.col("value")
        line = F.to_json("v")
        problem = ~is_object()
    else:
        names = sorted(c for c in scan.columns if c not in (POSITION, "errors"))
        body = line = F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]), {"ignoreNullFields": "false"})
        problem = F.lit(False)
    scan = scan.select(
        "*",
        record.shown("id").alias("_id"),
        F.md5(body).alias("body_md5"),
        line.alias("line"),
        problem.alias("bad"),
        F.col(f"{POSITION}.seq").alias("place"),
    )
    wanted = profile_view(scan, contract).columns
    with WrittenTable(spark, "profile") as table:
        view = table.write(
            profile_view(scan, contract, keep=("body_md5", "place", "bad", "errors", POSITION))
        )
        gate = view.agg(F.count_if("bad").alias("bad")).first()
        _refuse_bad_lines(spark, path, gate["bad"])
        counted = summary(view).first().asDict()
        if counted["rows_invalid"]:
            raise InvalidDatasetError(f"{counted['rows_invalid']} rows break the contract")

        stats = profile(view.select(*wanted), contract).first().asDict(recursive=True)
        place = F.struct(f"{POSITION}.file", f"{POSITION}.start", f"{POSITION}.seq")
        revision = view.agg(
            F.min_by("grammar_rev", F.when(F.col("grammar_rev").isNotNull(), place)).alias("rev")
        ).first()["rev"]

        started = time.perf_counter()
        rows = _write(spark, scan, view, ratios, seed, out)
    digests = _split_digests(spark, out)
    duration = time.perf_counter() - started
    manifest = {
        "dataset_id": stem(path),
        "grammar_rev": revision,
        "seed": seed,
        "splits": {
            name: {"path": f"{out}/splits/split={name}", "rows": n, "sha256": digests.get(name, "")}
            for name, n in rows.items()
        },
        "format": fmt,
        "created_at": utc_now(),
        "schema_path": schema_path,
    }
    write_json_document(spark, f"{out}/dataset.manifest.json", manifest)
    write_json_document(spark, f"{out}/dataset_stats.json", stats)
    result = ProcessResult(manifest, stats, counted, duration)
    if metrics_path is not None:
        append_metrics(spark, metrics_path, result.metrics())
    if run is not None:
        settings = {"dataset": path, "format": fmt, "seed": seed, "splits": dict(ratios)}
        run.log_job(settings, result.metrics(), {"dataset.manifest.json": manifest, "dataset_stats.json": stats})
    return result


def _write(
    spark: SparkSession, scan: DataFrame, view: DataFrame, ratios: Mapping[str, float], seed: int, out: str
) -> dict[str, int]:
    counts: dict[str, int] = {}

    def targets(total: int) -> list[int]:
        counts.update(allocate(total, ratios))
        sizes = list(counts.values())
        return [sum(sizes[: i + 1]) for i in range(len(sizes) - 1)]

    _, cuts = cut_points(view, _order_key(seed), targets)
    names = list(counts)
    key = _order_key(seed)
    split = F.lit(names[-1])
    for name, cut in reversed(list(zip(names, cuts))):
        split = F.when(below(key, cut), F.lit(name)).otherwise(split)
    lines = scan.select(F.col("_id").alias("id"), "body_md5", "place", F.col("line").alias("value"))
    seen = Observation("rows per split")
    assigned = lines.select(split.alias("split"), "value").observe(
        seen, *[F.count_if(F.col("split") == n).alias(n) for n in names]
    )
    write_splits(assigned, f"{out}/splits")
    written = {n: seen.get.get(n, 0) for n in names}
    if written != counts:
        raise DatasetError(f"the input changed while it was split: expected {counts}, wrote {written}")
    return counts


def _split_digests(spark: SparkSession, out: str) -> dict[str, str]:
    files = file_digests(spark, f"{out}/splits").withColumn("split", F.regexp_extract("path", "split=([^/]*)/", 1))
    return {r["split"]: r["sha256"] for r in folder_digest(files.filter(F.col("split") != ""), "split").collect()}

