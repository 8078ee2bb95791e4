"""Run logs: parameters, metrics, runs, the tokenizer registry, and figures read from logs."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Steps per block of the two-level running minimum: a block is what one task holds.
BLOCK_STEPS = 1_000_000
MAX_EXPONENT = 20.0


def flatten(values: Mapping[str, Any], prefix: str = "") -> dict[str, Any]:
    """Nested mapping to dotted keys, in reading order; empty mappings leave nothing."""
    return {".".join(path): leaf for path, leaf in _entries(values, (prefix,) if prefix else ())}


def _entries(node: Any, path: tuple[str, ...]) -> Iterator[tuple[tuple[str, ...], Any]]:
    if not isinstance(node, Mapping):
        yield path, node
        return
    for key in node:
        yield from _entries(node[key], (*path, str(key)))


def _leaves(schema: T.StructType, path: tuple[str, ...] = ()) -> Iterator[tuple[str, ...]]:
    for field in schema.fields:
        here = (*path, field.name)
        if isinstance(field.dataType, T.StructType):
            yield from _leaves(field.dataType, here)
        else:
            yield here


def flatten_columns(df: DataFrame) -> DataFrame:
    """Nested structs to columns with dotted names."""
    return df.select(
        *[F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)) for path in _leaves(df.schema)]
    )


def params_long(df: DataFrame, *keys: str) -> DataFrame:
    """Parameters as rows: dotted name and text value. One narrow pass."""
    flat = flatten_columns(df)
    entries = [
        F.struct(F.lit(n).alias("param"), F.col(f"`{n}`").cast("string").alias("value"))
        for n in flat.columns
        if n not in keys
    ]
    return flat.select(*[f"`{k}`" for k in keys], F.inline(F.array(*entries)))


def metrics_long(df: DataFrame, metrics: list[str], *keys: str) -> DataFrame:
    """Metrics as rows: name and numeric value."""
    entries = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    return df.select(*keys, F.inline(F.array(*entries)))


def children(runs: DataFrame) -> DataFrame:
    """Nested runs beside their parents. Parents are unique, so a parent with very many children
    makes one side of the join skewed, which AQE splits."""
    parents = runs.select(F.col("run_id").alias("parent_run_id"), F.col("start_time").alias("parent_start_time"))
    nested = runs.filter(F.col("parent_run_id").isNotNull())
    return nested.join(parents, "parent_run_id").select("run_id", "parent_run_id", "start_time", "parent_start_time")


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("start_time"), F.desc("run_id")).limit(1)


def upsert(registry: DataFrame, entries: DataFrame, key: str = "tokenizer_id") -> DataFrame:
    """Replace registry entries by key and append new ones."""
    return registry.join(entries.select(key), key, "left_anti").unionByName(entries)


def newest_first(registry: DataFrame) -> DataFrame:
    return registry.orderBy(F.desc_nulls_last("created_at"))


def eval_summary(log: DataFrame, *keys: str) -> DataFrame:
    """Token-weighted mean loss, and its perplexity with a capped exponent."""
    grouped = log.groupBy(*keys) if keys else log.groupBy()
    loss = F.coalesce(F.sum(F.col("loss") * F.col("n_tokens")), F.lit(0.0)) / F.greatest(
        F.lit(1), F.coalesce(F.sum("n_tokens"), F.lit(0))
    )
    return grouped.agg(loss.alias("loss")).withColumn("ppl", F.exp(F.least(F.lit(MAX_EXPONENT), F.col("loss"))))


def throughput(log: DataFrame, interval: int, *keys: str) -> DataFrame:
    """Tokens per second and milliseconds per step of each tumbling interval of steps.

    ``complete`` marks the intervals whose closing step has been logged.
    """
    seconds = F.sum("elapsed")
    return (
        log.groupBy(*keys, F.ceil(F.col("step") / interval).cast("long").alias("interval"))
        .agg(
            F.sum("n_tokens").alias("tokens"),
            F.try_divide(F.sum("n_tokens").cast("double"), seconds).alias("tokens_per_s"),
            (seconds / interval * 1000.0).alias("step_ms"),
            F.bool_or(F.col("step") % interval == 0).alias("complete"),
        )
    )


def best_so_far(log: DataFrame, run: str = "run", step: str = "step", loss: str = "loss", block_steps: int = BLOCK_STEPS) -> DataFrame:
    """Running minimum of the loss of each run.

    A run can be most of the log, so its steps are cut into blocks: minima per block are carried
    forward over the small block table, and the window runs within blocks only.
    """
    blocked = log.withColumn("_block", F.floor(F.col(step) / block_steps))
    before = W.partitionBy(run).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        blocked.groupBy(run, "_block")
        .agg(F.min(loss).alias("_low"))
        .select(run, "_block", F.min("_low").over(before).alias("_carried"))
    )
    within = W.partitionBy(run, "_block").orderBy(step).rowsBetween(W.unboundedPreceding, 0)
    return (
        blocked.withColumn("_best", F.min(loss).over(within))
        .join(carried, [run, "_block"])
        .withColumn("best", F.least("_best", "_carried"))
        .drop("_block", "_best", "_carried")
    )

