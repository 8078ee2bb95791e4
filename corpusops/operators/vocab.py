"""Word counts and vocabularies taken straight from counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusops.functions import latin
from corpusops.functions.text import SPECIAL_TOKENS, pretokenize
from corpusops.session import BROADCAST_BYTES, ROW_BYTES, join_small


def word_counts(texts: DataFrame, text: Column, pieces=pretokenize, raw: Column | None = None, lower: bool = True) -> DataFrame:
    """Occurrences of each pre-token. The only corpus-sized shuffle of training, and it moves
    one partial count per word and task, never one row per occurrence.

    Where ``text`` is null, ``raw`` is cut and counted, a batch at once.
    """
    if raw is None:
        return texts.select(F.explode(pieces(text)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            simple = batch.column(1).filter(batch.column(0).is_null()).drop_null()
            for found in (batch.column(0).cast(pa.list_(pa.string())).flatten(), latin.words(simple, lower)[0]):
                counted = pc.value_counts(found)
                yield pa.RecordBatch.from_arrays([counted.field("values").cast(pa.string()), counted.field("counts")], ["word", "n"])

    parts = texts.select(pieces(text).alias("words"), raw.alias("raw")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def top_words(counts: DataFrame, vocab_size: int) -> DataFrame:
    """The most frequent words that fit beside the special tokens, with their ids."""
    kept = counts.orderBy(F.desc("n"), "word").limit(max(vocab_size - len(SPECIAL_TOKENS), 0))
    return with_ids(kept.withColumnRenamed("word", "token"), [F.desc("n"), F.col("token")])


def byte_counts(texts: DataFrame, text: Column, raw: Column | None = None, lower: bool = True) -> DataFrame:
    """Occurrences of each UTF-8 byte: pieces leave out none, so nothing is cut into them.

    A task counts its texts batch by batch and hands on at most 256 rows. Where ``text`` is null, ``raw`` is
    normalised and counted.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(256, dtype=np.int64)
        for batch in batches:
            n += np.bincount(latin.flat_bytes(batch.column(0).drop_null())[1], minlength=256)
            if batch.num_columns > 1:
                simple = batch.column(1).filter(batch.column(0).is_null()).drop_null()
                n += np.bincount(latin.normal_bytes(simple, lower)[1], minlength=256)
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([f"{b:02X}" for b in found], pa.string()), pa.array(n[found])], ["token", "n"])

    columns = [text.alias("text"), *([] if raw is None else [raw.alias("raw")])]
    return texts.select(*columns).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def char_vocabulary(
    texts: DataFrame, text: Column, vocab_size: int, raw: Column | None = None, lower: bool = True
) -> DataFrame:
    """Byte-level vocabulary by frequency, ties by byte; ``score`` is the log of its share.

    At most 256 rows, so the unpartitioned windows here are over a constant-sized table.
    """
    counts = byte_counts(texts, text, raw, lower)
    total = F.sum("n").over(W.partitionBy())
    scored = counts.withColumn("score", F.log(F.col("n") / total))
    kept = scored.orderBy(F.desc("n"), "token").limit(max(vocab_size - len(SPECIAL_TOKENS), 0))
    return with_ids(kept, [F.desc("n"), F.col("token")])


def with_ids(tokens: DataFrame, order: list[Column]) -> DataFrame:
    """Number a vocabulary after the special tokens. Vocabulary-sized by construction."""
    ranked = F.row_number().over(W.orderBy(*order))
    return tokens.withColumn("id", (ranked + (len(SPECIAL_TOKENS) - 1)).cast("long"))


def special_tokens(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SPECIAL_TOKENS)), "id long, token string")


def missing_specials(vocabulary: DataFrame) -> DataFrame:
    """Special tokens a vocabulary lacks."""
    return special_tokens(vocabulary.sparkSession).select("token").join(vocabulary, "token", "left_anti")


def add_missing_specials(vocabulary: list[str]) -> list[str]:
    """Append the special tokens an imported vocabulary lacks."""
    present = set(vocabulary)
    return vocabulary + [t for t in SPECIAL_TOKENS if t not in present]


def lookup_ids(words: DataFrame, vocabulary: DataFrame, vocab_size: int, unk_id: int, word: str = "word") -> DataFrame:
    """Id of each word, ``unk_id`` outside the vocabulary.

    ``vocab_size`` is what the caller expects; the table is counted before it is broadcast, and a vocabulary
    beyond the bound is joined by shuffle.
    """
    table = vocabulary.select(F.col("token").alias(word), F.col("id"))
    if vocab_size * ROW_BYTES <= BROADCAST_BYTES:
        joined = join_small(words, table, [word], "left")
    else:
        joined = words.join(table, word, "left")
    return joined.withColumn("id", F.coalesce("id", F.lit(unk_id).cast("long")))
