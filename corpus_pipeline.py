"""A corpus pipeline of five operators: language, near duplicates, benchmark, mixture, shards.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it works on all rows its
predecessor kept and returns the columns it was given, the last one the placement of every row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusops.llm import decontamination, language, mixture, near_duplicates, sharding
from corpusops.llm.common import table
from corpusops.session import ensure_checkpoint_dir

N_SHARDS = 16
ROWS_PER_TASK = 20_000

# Trained language scores cannot be computed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the language model rejects go: no letters, or a score below nearly all right ones."""
    model = language.fit(docs)
    judged = language.predict(docs, F.col("text"), model, result="_language")
    return judged.filter(~F.col("_language.rejected")).select(*_columns(docs))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that with the smallest id; texts that share an id are told apart."""
    return near_duplicates.single_rows(docs).select(*_columns(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"), result="_found")
    return found.filter(~decontamination.contaminated("_found")).select(*_columns(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each pass that takes a document, dealt to output shards and shuffled there."""
    mixed = mixture.mix_sources(docs, n_shards=N_SHARDS, keep=True)
    parts = max(1, docs.count() // (N_SHARDS * ROWS_PER_TASK))
    drawn = mixed.select("row", F.explode("draws").alias("draw"))
    part = F.pmod(F.col("draw.spot"), F.lit(parts))
    spread = drawn.repartition("draw.shard", part).sortWithinPartitions("draw.shard", part, "draw.spot")
    return spread.select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot; each shard holds every source in proportion."""
    return sharding.stratified_shards(docs, N_SHARDS)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicate),
    ("decontamination", decontaminate),
    ("mixture", mix),
    ("sharding", shard),
]


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written and read again in the shared folder."""
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{base}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
