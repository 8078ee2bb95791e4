"""Token sequences as training input: limits, padding, context pairs, running means."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusops.contracts import DatasetError
from corpusops.functions.arrays import pad


def over_length(sequences: DataFrame, limit: int, ids: str = "input_ids") -> DataFrame:
    """Sequences longer than the model takes."""
    return sequences.filter(F.size(ids) > limit)


def require_max_length(sequences: DataFrame, limit: int, ids: str = "input_ids") -> DataFrame:
    """Fail, where the row is read, on the first sequence longer than the limit."""
    message = F.concat(F.lit("sequence length "), F.size(ids).cast("string"), F.lit(f" exceeds {limit}"))
    guarded = F.when(F.size(ids) > limit, F.raise_error(message)).otherwise(F.col(ids))
    return sequences.withColumn(ids, guarded)


def pad_batches(sequences: DataFrame, batch_size: int, pad_id: int = 0, row: str = "row") -> DataFrame:
    """Cut numbered rows into batches and pad each to its longest row: one shuffle, groups of
    exactly ``batch_size`` rows."""
    batch = F.floor((F.col(row) - 1) / batch_size).cast("long")
    longest = F.max(F.size("input_ids")).over(W.partitionBy("batch"))
    return (
        sequences.withColumn("batch", batch)
        .withColumn("_size", longest)
        .withColumn("input_ids", pad(F.col("input_ids"), F.col("_size"), pad_id))
        .withColumn("attention_mask", pad(F.col("attention_mask"), F.col("_size"), 0))
        .drop("_size")
    )


def _check_window(window: int) -> None:
    if window < 0:
        raise DatasetError("window must not be negative")


def _local_pairs(ids: Column, distance: Column) -> Column:
    """All pairs whose query lies ``distance`` after (or, if negative, before) its key."""
    gap = F.abs(distance)
    size = F.greatest(F.size(ids) - gap, F.lit(0))
    later, earlier = F.slice(ids, gap + 1, size), F.slice(ids, F.lit(1), size)
    query = F.when(distance >= 0, later).otherwise(earlier)
    key = F.when(distance >= 0, earlier).otherwise(later)
    return F.zip_with(query, key, lambda q, k: F.struct(q.alias("query"), k.alias("key")))


def _global_pairs(ids: Column, place: Column, window: int, n_global: int, causal: bool) -> Column:
    """Pairs of one leading position with all others that the window does not cover already.

    The position sees and is seen by every other. A pair of two leading positions is listed from
    the query's side only.
    """
    token = F.get(ids, place)

    def covered(query: Column, key: Column) -> Column:
        near = F.abs(query - key) <= window
        return near & (key <= query) if causal else near

    sees = F.transform(
        ids, lambda k, i: F.when(~covered(place, i), F.struct(token.alias("query"), k.alias("key")))
    )
    seen = F.transform(
        ids,
        lambda q, i: F.when((i >= n_global) & ~covered(i, place), F.struct(q.alias("query"), token.alias("key"))),
    )
    both = F.filter(F.concat(sees, seen), lambda p: p.isNotNull())
    return F.when(F.size(ids) > place, both)


def context_pairs(sequences: DataFrame, window: int, causal: bool, n_global: int = 0) -> DataFrame:
    """How often each token (query) has another (key) in its context.

    Context is the sliding window, plus the first ``n_global`` positions, which see and are seen by
    all regardless of order. A sequence is paired with shifted copies of itself where it is read,
    one distance at a time: work and output grow with length times window, no row is joined with
    another, and pairs are partly counted before they are shuffled.
    """
    _check_window(window)
    ids = F.col("input_ids")
    steps = F.transform(
        F.sequence(F.lit(0 if causal else -window), F.lit(window)),
        lambda d: F.struct(F.lit(False).alias("lead"), d.alias("at")),
    )
    pairs = _local_pairs(ids, F.col("step.at"))
    if n_global > 0:
        leads = F.transform(
            F.sequence(F.lit(0), F.lit(n_global - 1)), lambda g: F.struct(F.lit(True).alias("lead"), g.alias("at"))
        )
        steps = F.concat(steps, leads)
        pairs = F.when(
            F.col("step.lead"), _global_pairs(ids, F.col("step.at"), window, n_global, causal)
        ).otherwise(pairs)
    return (
        sequences.select("input_ids", F.explode(steps).alias("step"))
        .select(F.inline(pairs))
        .groupBy("query", "key")
        .agg(F.count(F.lit(1)).alias("pairs"))
    )


def prefix_mean(sequences: DataFrame, causal: bool = True, name: str = "mean") -> DataFrame:
    """Add the running mean of the unmasked ids of each sequence, or its overall mean, at every position."""
    return sequences.withColumn(name, _means(0, None if causal else -1))


def sliding_mean(sequences: DataFrame, window: int, causal: bool = True, name: str = "mean") -> DataFrame:
    """Add the mean over the sliding window that ends at, or surrounds, each position."""
    _check_window(window)
    return sequences.withColumn(name, _means(window + 1, 0 if causal else window))


def _means(reach: int, ahead: int | None) -> Column:
    """Means of a window of each position, from running sums of the row's own arrays.

    ``reach`` is how many positions the window spans up to and with its own (0: from the start), ``ahead``
    how many follow (None: none, -1: to the end). A position whose window has no unmasked id
    gets 0. A sequence lies in one row, so nothing is shuffled.
    """

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def means(ids: pa.Array, masks: pa.Array) -> pa.Array:
        sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        # The only array as long as the batch besides its input; rows are worked on one by one.
        offsets = np.append(0, np.cumsum(sizes))
        flat = np.empty(offsets[-1])
        for i, n in enumerate(sizes):
            if not n:
                continue
            row = ids[i].values
            kept = row.is_valid().to_numpy(zero_copy_only=False)
            if masks[i].is_valid:
                mask = masks[i].values.fill_null(0).to_numpy(zero_copy_only=False) != 0
                kept &= np.append(mask, np.zeros(max(0, n - len(mask)), bool))[:n]
            value = np.where(kept, row.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), 0)
            total, count = np.append(0, np.cumsum(value)), np.append(0, np.cumsum(kept))
            at = np.arange(n)
            low = np.maximum(at - reach + 1, 0) if reach else np.zeros(n, np.int64)
            high = np.full(n, n) if ahead == -1 else np.minimum(at + (ahead or 0) + 1, n)
            sums, counts = total[high] - total[low], count[high] - count[low]
            flat[offsets[i] : offsets[i + 1]] = np.where(counts > 0, sums / np.maximum(counts, 1), 0.0)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat), mask=ids.is_null())

    return means(F.col("input_ids"), F.col("attention_mask"))
