"""Tokenisation report: unknown rate, lengths and coverage at four grains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token_samples(encoded: DataFrame, unk_id: int, ids: str = "input_ids", keep: tuple[str, ...] = ("split", "task")) -> DataFrame:
    """Tokens and unknown tokens of each sample."""
    return encoded.select(
        *keep,
        F.size(ids).cast("long").alias("n_tokens"),
        (F.size(ids) - F.size(F.array_remove(ids, unk_id))).cast("long").alias("n_unk"),
    )


def length_histogram(samples: DataFrame, keys: tuple[str, ...] = ("split", "task")) -> DataFrame:
    """Samples per length. All report figures follow from it, at any grain, so the corpus is
    aggregated once and the grouping sets expand this small table instead of the samples."""
    return samples.groupBy(*keys, "n_tokens").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("n_unk").alias("n_unk")
    )


def _metrics() -> list[Column]:
    tokens = F.sum(F.col("n_tokens") * F.col("samples"))
    samples = F.sum("samples")
    zero = F.lit(0.0)
    quantile = [
        F.coalesce(F.percentile("n_tokens", q, F.col("samples")), zero).alias(name)
        for q, name in ((0.5, "tokens_len_p50"), (0.95, "tokens_len_p95"))
    ]
    return [
        F.coalesce(samples, F.lit(0)).alias("num_samples"),
        F.coalesce(tokens, F.lit(0)).alias("num_tokens"),
        F.coalesce(F.try_divide(F.sum("n_unk"), tokens), zero).alias("oov_rate"),
        F.coalesce(F.try_divide(tokens, samples), zero).alias("avg_tokens_per_sample"),
        *quantile,
        F.coalesce(1 - F.try_divide(F.sum("n_unk"), tokens), zero).alias("coverage"),
    ]


def token_metrics(histogram: DataFrame, *keys: str) -> DataFrame:
    grouped = histogram.groupBy(*keys) if keys else histogram.groupBy()
    return grouped.agg(*_metrics())


def token_report(histogram: DataFrame) -> DataFrame:
    """Metrics per split, per split and task, per task, and over all."""
    split, task = F.col("split"), F.col("task")
    grain = (
        F.when((F.grouping("split") == 0) & (F.grouping("task") == 0), "split_task")
        .when(F.grouping("split") == 0, "split")
        .when(F.grouping("task") == 0, "task")
        .otherwise("all")
    )
    return histogram.groupingSets([[split], [split, task], [task], []], split, task).agg(
        grain.alias("grain"), *_metrics()
    )


def macro_coverage(histogram: DataFrame) -> DataFrame:
    """Unweighted mean of the coverage over tasks."""
    return token_metrics(histogram, "task").agg(F.avg("coverage").alias("macro_coverage"))


def report_document(report: DataFrame, train_time_sec: float | None = None) -> dict:
    """The report as one JSON document: a few rows per split and task name."""
    rows = [r.asDict() for r in report.collect()]
    fields = ("oov_rate", "avg_tokens_per_sample", "tokens_len_p50", "tokens_len_p95", "num_samples", "num_tokens")

    def block(row: dict | None, per_task: list[dict]) -> dict:
        body = {f: row[f] if row else 0 for f in fields}
        return body | {"coverage_per_task": {r["task"]: r["coverage"] for r in per_task}}

    overall = next((r for r in rows if r["grain"] == "all"), None)
    summary = block(overall, [r for r in rows if r["grain"] == "task"])
    if train_time_sec is not None:
        summary["train_time_sec"] = float(train_time_sec)
    return {
        "summary": summary,
        "per_split": {
            r["split"]: block(r, [t for t in rows if t["grain"] == "split_task" and t["split"] == r["split"]])
            for r in rows
            if r["grain"] == "split"
        },
    }
