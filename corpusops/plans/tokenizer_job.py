"""Whole jobs over a dataset manifest: train or import a tokenizer, and report on it."""

from __future__ import annotations

import time
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusops.contracts import DatasetError
from corpusops.functions.arrays import template
from corpusops.functions.records import VariantRecord
from corpusops.functions.text import ALGORITHMS, SPECIAL_TOKENS
from corpusops.operators import bpe, unigram, vocab
from corpusops.operators.report import length_histogram, macro_coverage, report_document, token_report, token_samples
from corpusops.operators.runlog import newest_first, upsert
from corpusops.operators.tokenizer import TokenizerConfig, TokenizerModel, byte_characters, encode
from corpusops.plans.dataset_job import utc_now
from corpusops.plans.run_tables import RunLog
from corpusops.session import cut_lineage
from corpusops.sources.readers import (
    _exists,
    is_object,
    parse_lines,
    read_json_document,
    read_splits,
    read_texts,
    task_samples,
    training_paths,
)
from corpusops.sources.writers import path_digests, write_json_document

REGISTRY_SCHEMA = "tokenizer_id string, manifest_path string, algo string, vocab_size long, created_at string"


def training_words(texts: DataFrame, config: TokenizerConfig, text: str) -> DataFrame:
    """Pre-tokens of the training text and their counts."""
    raw = F.col(text)
    apart = config.latin_apart(raw)
    if apart is None:
        return vocab.word_counts(texts, config.training_text(raw))
    return vocab.word_counts(texts, config.training_text(apart), raw=raw, lower=config.lower)


def training_bytes(texts: DataFrame, config: TokenizerConfig, text: str) -> DataFrame:
    """The byte-level vocabulary of the training text."""
    raw = F.col(text)
    apart = config.latin_apart(raw)
    if apart is None:
        return vocab.char_vocabulary(texts, config.training_text(raw), config.vocab_size)
    return vocab.char_vocabulary(texts, config.training_text(apart), config.vocab_size, raw, config.lower)


def learn(
    texts: DataFrame, config: TokenizerConfig, text: str = "payload", seed_size: int = unigram.DEFAULT_SEED_SIZE
) -> TokenizerModel:
    """Learn a vocabulary from raw texts. ``seed_size`` bounds the first pieces of unigram."""
    if config.algo not in ALGORITHMS:
        raise DatasetError(f"'{config.algo}' vocabularies are imported, not learnt")
    zeros = [0.0] * len(SPECIAL_TOKENS)
    if config.algo == "char":
        rows = training_bytes(texts, config, text).orderBy("id").collect()
        shown = byte_characters()
        tokens = [shown[int(r["token"], 16)] for r in rows]
        return TokenizerModel(config, [*SPECIAL_TOKENS, *tokens], zeros + [r["score"] for r in rows], byte_level=True)
    words = training_words(texts, config, text)
    if config.algo == "bpe":
        learned = bpe.learn_bpe(words, config.vocab_size)
        return TokenizerModel(config, learned.tokens, [], learned.merges)
    pieces = unigram.learn_unigram(words, config.vocab_size, seed_size=seed_size)
    return TokenizerModel(config, [*SPECIAL_TOKENS, *pieces.pieces], zeros + pieces.scores)


def report_on(
    spark: SparkSession,
    model: TokenizerModel,
    manifest: Mapping[str, Any],
    splits: Iterable[str] | None = None,
    train_time_sec: float | None = None,
) -> dict[str, Any]:
    """Token metrics of the manifest's splits. The splits are encoded once, without a shuffle; all
    figures come from the length histogram."""
    samples = task_samples(parse_lines(read_splits(spark, manifest, splits)), ["split"])
    counted = token_samples(encode(samples, model), model.unk_id)
    histogram = cut_lineage(length_histogram(counted))
    document = report_document(token_report(histogram), train_time_sec)
    document["summary"]["macro_coverage"] = macro_coverage(histogram).first()["macro_coverage"]
    document["summary"]["generated_at"] = utc_now()
    return document


def train_tokenizer(
    spark: SparkSession,
    manifest_path: str,
    config: TokenizerConfig,
    out: str,
    registry: str | None = None,
    external: str | None = None,
    source_revision: str = "unknown",
    run: RunLog | None = None,
) -> dict[str, Any]:
    """Train (or import) a tokenizer, save it, report on all splits, and register it."""
    dataset = read_json_document(spark, manifest_path)
    paths = training_paths(dataset)
    started = time.perf_counter()
    if external is not None:
        model, seconds = TokenizerModel.from_json(read_json_document(spark, external), config.seed), 0.0
    else:
        model = learn(read_texts(spark, paths), config)
        seconds = time.perf_counter() - started
    tokenizer_path = write_json_document(spark, f"{out}/tokenizer.json", model.to_json())
    manifest = config.manifest_fragment() | {
        "tokenizer_id": config.tokenizer_id,
        "created_at": utc_now(),
        "tokenizer_json_path": tokenizer_path,
        "tokenizer_json_sha256": path_digests(spark, {"tokenizer": tokenizer_path})["tokenizer"],
        "train_time_sec": seconds,
        "source_dataset_id": dataset.get("dataset_id", "unknown"),
        "source_manifest_path": manifest_path,
        "train_split_path": paths[0],
        "input_paths_sha256": path_digests(spark, {p.rstrip("/").rsplit("/", 1)[-1]: p for p in paths}),
        "source_revision": source_revision,
    }
    own_path = write_json_document(spark, f"{out}/tokenizer.manifest.json", manifest)
    report = report_on(spark, model, dataset, train_time_sec=seconds)
    write_json_document(spark, f"{out}/tokenizer.report.json", report)
    if registry is not None:
        register(spark, registry, manifest, own_path)
    if run is not None:
        run.log_job(config.manifest_fragment() | {"manifest": manifest_path}, report["summary"], {"tokenizer.report.json": report})
    return {"tokenizer_path": tokenizer_path, "manifest_path": own_path, "manifest": manifest, "report": report}


def load_tokenizer(spark: SparkSession, path: str) -> TokenizerModel:
    return TokenizerModel.from_json(read_json_document(spark, path))


def encode_sequences(spark: SparkSession, tokenizer_path: str, manifest_path: str, out: str) -> dict[str, str]:
    """Encode all splits into token sequences as ``read_sequences`` takes them: a folder per split.

    A text becomes ``<bos> A <eos>``, a source with its target ``<bos> A <sep> B <eos>``; every token counts
    in the mask. Nothing is shuffled.
    """
    model = load_tokenizer(spark, tokenizer_path)
    manifest = read_json_document(spark, manifest_path)
    special = model.special_ids()
    record = VariantRecord("v")
    parsed = parse_lines(read_splits(spark, manifest)).filter(is_object())
    texts = parsed.select("split", record.shown("text").alias("text"), record.shown("src").alias("src"), record.shown("tgt").alias("tgt"))
    single = F.coalesce("text", "src", "tgt")
    pair = F.col("text").isNull() & F.col("src").isNotNull() & F.col("tgt").isNotNull()
    texts = texts.filter(single.isNotNull()).select("split", single.alias("first"), F.when(pair, F.col("tgt")).alias("second"))
    coded = encode(encode(texts, model, "first", "a"), model, "second", "b")
    marks = (special["<bos>"], special["<eos>"], special["<sep>"])
    ids = F.when(F.col("second").isNull(), template(F.col("a"), *marks)).otherwise(template(F.col("a"), *marks, F.col("b")))
    rows = coded.select("split", ids.alias("input_ids"))
    rows = rows.withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1)))
    rows.write.mode("overwrite").partitionBy("split").json(out)
    return {name: f"{out}/split={name}" for name in manifest["splits"]}


def inspect_tokenizer(spark: SparkSession, tokenizer_path: str, manifest_path: str, out: str) -> dict[str, Any]:
    """Report of an existing tokenizer on a dataset."""
    model = load_tokenizer(spark, tokenizer_path)
    report = report_on(spark, model, read_json_document(spark, manifest_path))
    write_json_document(spark, f"{out}/tokenizer.report.json", report)
    return report


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    if _exists(spark, path):
        return spark.read.schema(REGISTRY_SCHEMA).json(path)
    return spark.createDataFrame([], REGISTRY_SCHEMA)


def register(spark: SparkSession, path: str, manifest: Mapping[str, Any], manifest_path: str) -> None:
    """Put a tokenizer into the registry, replacing an entry of the same id."""
    entry = spark.createDataFrame(
        [(manifest["tokenizer_id"], manifest_path, manifest["algo"], manifest["vocab_size"], manifest["created_at"])],
        REGISTRY_SCHEMA,
    )
    merged = cut_lineage(newest_first(upsert(read_registry(spark, path), entry)))
    merged.coalesce(1).write.mode("overwrite").json(path)
