"""Helpers the operators share: tables, batch bounds, words and 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows of one Arrow batch are bounded by bytes as well, so that long texts cannot pile up in a worker.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2_000
WORDS_CACHED = 200_000
BITMAP_BITS = 1 << 24

# ASCII upper case to lower case; every byte below 0x80 that is no digit or letter becomes a space.
ALNUM_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session unless it already asks for smaller ones."""
    for key, most in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        digits = spark.conf.get(key).lower().removesuffix("b")
        if not digits.isdigit() or not 0 < int(digits) <= most:
            spark.conf.set(key, str(most))


def bitmap(values: DataFrame, column: str) -> np.ndarray:
    """The low bits of a column of longs as a bitmap, of 2 MB whatever the number of values.

    Used to leave out rows of a scan before a shuffle whose join decides exactly. With very many values
    the bitmap fills up and leaves out less; results never depend on it.
    """
    place = F.pmod(F.col(column), F.lit(BITMAP_BITS)) + 1
    parts = values.groupBy(F.bitmap_bucket_number(place).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    found = np.zeros(BITMAP_BITS // 8, np.uint8)
    for row in parts.collect():
        bits = np.frombuffer(row["bits"], np.uint8)
        found[(row["n"] - 1) * len(bits) : row["n"] * len(bits)] = bits
    return found


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    low = values & (BITMAP_BITS - 1)
    return (bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1


def may_be_among(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``df`` without most rows whose ``key`` is not in ``keys``, for a join that decides exactly."""
    hashed = keys.select(F.xxhash64(key).alias("h"))
    shared = df.sparkSession.sparkContext.broadcast(bitmap(hashed, "h"))

    @F.arrow_udf(T.BooleanType())
    def among(values: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(shared.value, values.to_numpy(zero_copy_only=False)))

    return df.filter(among(F.xxhash64(key)))


def as_bytes(texts: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a column of strings."""
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return texts.cast(kind).to_pylist()


def space_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII whitespace, A-Z lower-cased; other characters stay as they are."""
    return text.lower().split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII digits, letters (lower-cased) and all non-ASCII characters."""
    return text.translate(ALNUM_TABLE).split() if text else []


class WordHashes(dict):
    """64-bit hash of a word, remembered for the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_CACHED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value (wraps around by design)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
