"""Session settings and the few helpers that need the session itself."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusops.contracts import DatasetError

# A side is broadcast only when its counted rows stay under this many bytes. Unless a caller knows
# better, a row counts as 200 bytes.
BROADCAST_BYTES = 40_000_000
ROW_BYTES = 200


def build_session(app: str = "corpusops", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators assume; cluster settings win where present."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints: the one the cluster names.

    Only a ``local`` master, where driver and executors are one process, may fall back to a local folder.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise DatasetError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpusops-ckpt-"))
    return spark.sparkContext.getCheckpointDir()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of a job's own on any Hadoop file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder, so lost executors cannot replay its past."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def bounded_batches(spark: SparkSession, rows: int, size: int) -> Iterator[None]:
    """Arrow batches of at most so many rows, and of little more than ``size`` bytes, unless the session asks for less."""
    before = {}
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        before[key] = spark.conf.get(key)
        digits = before[key].lower().removesuffix("b")
        if not digits.isdigit() or not 0 < int(digits) <= most:
            spark.conf.set(key, str(most))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


class WrittenTable:
    """A table of an iterative job, written anew into one of two alternating folders.

    Each version is read back from files in the shared folder, so no lineage piles up, losing an
    executor costs nothing, and at most two versions take up space. Used with ``with``, it is deleted however
    the job ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.turn = 0

    def write(self, df: DataFrame, **options: str) -> DataFrame:
        path = f"{self.base}/{'ab'[self.turn % 2]}"
        self.turn += 1
        df.write.mode("overwrite").options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> WrittenTable:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop()

    def drop(self) -> None:
        remove_folder(self.spark, self.base)


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", row_bytes: int = ROW_BYTES) -> DataFrame:
    """Join with an already materialised ``small`` side, broadcasting it only if it is small.

    ``row_bytes`` bounds a row of ``small``. Beyond the bound the join is left to a shuffle join, where AQE
    splits skewed partitions.
    """
    most = BROADCAST_BYTES // row_bytes
    if small.limit(most + 1).count() <= most:
        small = F.broadcast(small)
    return big.join(small, keys, how)


def spread(scan: DataFrame) -> DataFrame:
    """Give a scan with fewer partitions than cores one partition per core.

    Only meant for plain scans. A corpus of many files already has more partitions than
    cores and passes through untouched, so nothing is shuffled at scale.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() < cores:
        return scan.repartition(cores)
    return scan
