"""Run tracking as append-only tables: runs, parameters, metrics and artifacts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusops.operators.runlog import flatten
from corpusops.sources.writers import file_digests

METRICS_PER_WRITE = 10_000

SCHEMAS = {
    "runs": "run_id string, parent_run_id string, experiment string, run_name string, start_time timestamp, tags map<string,string>",
    "params": "run_id string, param string, value string",
    "metrics": "run_id string, metric string, value double, step long",
    "artifacts": "run_id string, path string, length long, sha256 string, content string",
}


class RunLog:
    """One run. With ``enabled=False`` every call does nothing. Metrics are written by ``flush`` or at the
    end of a ``with`` block."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        experiment: str,
        run_name: str,
        enabled: bool = True,
        parent_run_id: str | None = None,
        tags: Mapping[str, str] | None = None,
    ):
        self.spark, self.path, self.enabled = spark, path, enabled
        self.run_id = uuid.uuid4().hex if enabled else None
        self.waiting: list[tuple] = []
        if enabled:
            row = spark.createDataFrame(
                [(self.run_id, parent_run_id, experiment, run_name, dict(tags or {}))],
                "run_id string, parent_run_id string, experiment string, run_name string, tags map<string,string>",
            )
            self._append("runs", row.withColumn("start_time", F.current_timestamp()))

    def _append(self, table: str, rows: DataFrame) -> None:
        if self.enabled:
            names = [part.split(" ")[0] for part in SCHEMAS[table].replace("map<string,string>", "map").split(", ")]
            rows.select(*names).coalesce(1).write.mode("append").parquet(f"{self.path}/{table}")

    def _rows(self, table: str, rows: list[tuple]) -> None:
        if self.enabled and rows:
            self._append(table, self.spark.createDataFrame(rows, SCHEMAS[table]))

    def log_params(self, params: Mapping[str, Any]) -> None:
        self._rows("params", [(self.run_id, k, str(v)) for k, v in flatten(params).items()])

    def log_metrics(self, metrics: Mapping[str, float], step: int | None = None) -> None:
        """Keep metrics until ``flush``, so that a step does not cost a job and a file."""
        if self.enabled:
            self.waiting += [(self.run_id, k, float(v), step) for k, v in metrics.items()]
            if len(self.waiting) >= METRICS_PER_WRITE:
                self.flush()

    def flush(self) -> None:
        rows, self.waiting = self.waiting, []
        self._rows("metrics", rows)

    def __enter__(self) -> RunLog:
        return self

    def __exit__(self, *_: object) -> None:
        self.flush()

    def log_artifact(self, path: str) -> None:
        """List the files under a path with their digests, hashed where they are read."""
        if self.enabled:
            listed = file_digests(self.spark, path)
            self._append(
                "artifacts",
                listed.withColumn("run_id", F.lit(self.run_id)).withColumn("content", F.lit(None).cast("string")),
            )

    def log_job(self, params: Mapping[str, Any], metrics: Mapping[str, Any], artifacts: Mapping[str, Mapping[str, Any]]) -> None:
        """What a whole job leaves: parameters, its numeric metrics by dotted name, small documents."""
        self.log_params(params)
        numbers = {k: v for k, v in flatten(metrics).items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
        self.log_metrics(numbers)
        for name, document in artifacts.items():
            self.log_json(document, name)
        self.flush()

    def log_json(self, document: Mapping[str, Any], name: str) -> None:
        body = json.dumps(document, sort_keys=True)
        self._rows("artifacts", [(self.run_id, name, len(body), None, body)])


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(f"{path}/{table}")
