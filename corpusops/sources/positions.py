"""Row ordinals in file order without sorting or shuffling the corpus.

Every row of a file scan is described by the block it came from and its place in the task that
read it. One narrow pass counts rows per block; the running total over that small table gives
each block its offset, and the ordinal of a row is that offset plus its distance from the
block's first row. The block key includes the task number and the block length, so a changed
scan geometry cannot be mistaken for the old one: it is reported as an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusops.session import cut_lineage, join_small

POSITION = "scan_pos"
_BLOCK = ["file", "start", "length", "part"]


def scan_position() -> Column:
    """Where a scanned row came from. Select it after the filters that must not be counted."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_block_length").alias("length"),
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("seq"),
    ).alias(POSITION)


def _block_key() -> Column:
    """One number for a block; 64 bits tell even ten million blocks apart."""
    return F.xxhash64(*[F.col(f"{POSITION}.{c}") for c in _BLOCK])


def block_offsets(positioned: DataFrame) -> DataFrame:
    """``block, first_seq, offset``: one row of three numbers per scanned block.

    ``offset`` is the block's first ordinal minus one and ``first_seq`` the seq of its first row. 100 TB in
    128 MB blocks make 800 thousand rows, about 20 MB, so the ordered window over them is small. The
    table is checkpointed: both users see the same one.
    """
    blocks = positioned.groupBy(_block_key().alias("block")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(f"{POSITION}.seq").alias("first_seq"),
        F.min(F.struct(f"{POSITION}.file", f"{POSITION}.start")).alias("place"),
    )
    before = W.orderBy("place", "block").rowsBetween(W.unboundedPreceding, -1)
    return cut_lineage(blocks.select("block", "first_seq", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset")))


def number_rows(df: DataFrame, offsets: DataFrame, name: str = "row") -> DataFrame:
    """Turn the position column into the 1-based ordinal. ``df`` may be any subset of the scan.

    The block table is broadcast up to ``BROADCAST_BYTES``, 1.6 million blocks or some 200 TB, so rows stay
    where they were read.
    """
    keyed = df.withColumn("_block", _block_key()).withColumn("_seq", F.col(f"{POSITION}.seq")).drop(POSITION)
    table = offsets.select(F.col("block").alias("_block"), "first_seq", "offset")
    joined = join_small(keyed, table, ["_block"], "left", row_bytes=3 * 8)
    ordinal = F.when(
        F.col("offset").isNull(),
        F.raise_error(F.lit("scan geometry changed between two passes; pin spark.sql.files.minPartitionNum")),
    ).otherwise(F.col("offset") + F.col("_seq") - F.col("first_seq") + 1)
    return joined.withColumn(name, ordinal.cast("long")).drop("_block", "_seq", "first_seq", "offset")


def with_row_numbers(positioned: DataFrame, name: str = "row") -> DataFrame:
    return number_rows(positioned, block_offsets(positioned), name)
