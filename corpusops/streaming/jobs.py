"""Structured Streaming forms of the row-wise and running operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusops.contracts import Contract
from corpusops.operators.validation import check_lines, split_valid
from corpusops.session import ensure_checkpoint_dir
from corpusops.sources.readers import _exists, parse_lines


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for the state and output of one stream, in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def metric_totals(metrics: DataFrame) -> DataFrame:
    """Running totals per metric. The log has no event time, so there is no watermark; the state
    is one row per metric name."""
    return metrics.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high")
    )


def tail_totals(metrics: DataFrame, out: str) -> DataFrame:
    """Drain a metrics stream into its totals. Each batch replaces the table of totals."""
    spark = metrics.sparkSession

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/totals")

    totals = metric_totals(metrics)
    (
        totals.writeStream.outputMode("complete")
        .option("checkpointLocation", f"{out}/state")
        .trigger(availableNow=True)
        .foreachBatch(replace)
        .start()
        .awaitTermination()
    )
    return _written(spark, f"{out}/totals", totals.schema)


def read_metrics_stream(spark: SparkSession, path: str) -> DataFrame:
    """Tail an append-only metrics log: one JSON object of numbers per line."""
    lines = spark.readStream.text(path)
    numbers = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    return lines.select(F.explode(numbers).alias("metric", "value")).select(
        "metric", F.expr("try_cast(value AS DOUBLE)").alias("value")
    ).filter(F.col("value").isNotNull())


def validate_stream(lines: DataFrame, contract: Contract, out: str, keep: tuple[str, ...] = ("value",)) -> tuple[DataFrame, DataFrame]:
    """Drain a stream of raw lines into valid rows and quarantined rows with their messages.

    Lines that are no JSON object are quarantined as well; only blank lines are dropped.

    A batch writes into folders of its own number, so a batch that is run again after a failure
    replaces its earlier output instead of adding to it.
    """
    spark = lines.sparkSession
    checked = check_lines(parse_lines(lines), contract).select(*keep, "errors")

    def sort_out(batch: DataFrame, number: int) -> None:
        batch.persist()
        valid, quarantine = split_valid(batch)
        valid.write.mode("overwrite").parquet(f"{out}/valid/batch={number}")
        quarantine.write.mode("overwrite").parquet(f"{out}/quarantine/batch={number}")
        batch.unpersist()

    (
        checked.writeStream.option("checkpointLocation", f"{out}/state")
        .trigger(availableNow=True)
        .foreachBatch(sort_out)
        .start()
        .awaitTermination()
    )
    schema = checked.schema
    return (
        _written(spark, f"{out}/valid", T.StructType([f for f in schema if f.name != "errors"])),
        _written(spark, f"{out}/quarantine", schema),
    )


def _written(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What the batches of a stream wrote; a stream without any file has no batch and no folder."""
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)
