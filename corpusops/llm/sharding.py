"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows of a source are ranked in a seeded hash order; the rank divided by the size of the source is the
row's fractional rank, so any stretch of fractional ranks holds the same share of every source. Rows
are ordered by it over all sources and cut into shards of equal length: the mixture of each shard is
that of the whole, and row counts differ by one at most.

Neither order is a global sort. Rows are counted per bucket of the order, the counts give each
bucket's offset, and rows are numbered only within buckets. Hash buckets are even by nature, and
fractional ranks are uniform by construction, so a source with a third of all rows is spread over
as many buckets as any rows are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 4_000
SEED = 17
DIGITS = 6  # hex digits of the hash that buckets are taken from


def _hash_number(text: Column) -> Column:
    """The first digits of the MD5 as a number below 16 ** DIGITS."""
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def _offsets(counts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows before each bucket of its group; the table holds one row a bucket, not a row."""
    window = W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    if keys:
        window = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(window), F.lit(0)))


def stratified_shards(
    docs: DataFrame,
    n_shards: int,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    seed: int = SEED,
) -> DataFrame:
    """One row per document: ``doc_id, source, size, text_crc32, shard, slot``.

    ``size`` is the number of UTF-8 bytes of the text plus 1, ``text_crc32`` the CRC of those bytes; a
    null text counts as empty for both. ``slot`` counts the rows of a shard from 0 in interleaved
    order. A null source is a source of its own; the empty name is another. Rows are ordered by the
    MD5 of seed and id, then id, text and size; rows that agree in all of these are interchangeable.
    An empty table gives no rows, and shards stay empty if there are fewer rows than shards. Other
    columns are not read.
    """
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    name = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit("-"))
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{source}`").alias("source"),
        name.alias("_source"),
        (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
    )
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = rows.withColumn("_hash", F.md5(key))
    sizes = rows.groupBy("_source").agg(F.count("*").alias("_rows"))
    total = rows.count()
    buckets = max(1, -(-total // ROWS_PER_BUCKET))

    # Rank within the source. Buckets follow the hash, so their order is that of the rows.
    bucket = F.floor(_hash_number(key) * buckets / 16**DIGITS).cast("long")
    rows = rows.withColumn("_bucket", bucket)
    counts = rows.groupBy("_source", "_bucket").agg(F.count("*").alias("_n"))
    offsets = _offsets(counts, ["_source"], "_bucket").select("_source", "_bucket", "_before").join(sizes, "_source")
    inside = W.partitionBy("_source", "_bucket").orderBy("_hash", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("_rank", F.row_number().over(inside)).join(offsets, ["_source", "_bucket"])
    # The seeded shift keeps small sources from meeting at the same fraction.
    shift = _hash_number(F.concat(F.lit(f"{seed}/"), F.col("_source"))) / 16**DIGITS
    fraction = (F.col("_before") + F.col("_rank") - 1 + shift) / F.col("_rows")
    ranked = ranked.select(
        "doc_id", "source", "_source", "size", "text_crc32", (F.col("_before") + F.col("_rank")).alias("_place"),
        fraction.alias("_fraction"),
    )

    # Place in the order of fractions over all sources, and the cut.
    ranked = ranked.withColumn("_part", F.least(F.floor(F.col("_fraction") * buckets), F.lit(buckets - 1)).cast("long"))
    parts = _offsets(ranked.groupBy("_part").agg(F.count("*").alias("_n")), [], "_part").select("_part", "_before")
    inside = W.partitionBy("_part").orderBy("_fraction", "_source", "_place")
    placed = ranked.withColumn("_row", F.row_number().over(inside)).join(parts, "_part")
    position = F.col("_before") + F.col("_row") - 1
    # Shard s holds the positions from ceil(s * total / n) on.
    placed = placed.withColumn("_position", position).withColumn(
        "shard", F.expr(f"(_position * {n_shards}L) div {max(total, 1)}L").cast("int")
    )
    first = F.expr(f"(shard * {total}L + {n_shards - 1}L) div {n_shards}L")
    return placed.select(
        "doc_id", "source", "size", "text_crc32", "shard", (F.col("_position") - first).cast("long").alias("slot")
    )
