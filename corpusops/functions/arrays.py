"""Functions on token arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

IGNORED_LABEL = -100


def shift_labels(ids: Column, mask: Column) -> Column:
    """Next-token labels: one to the left, positions whose token is masked are ignored."""
    rest = F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0)))
    rest_mask = F.slice(mask, F.lit(2), F.greatest(F.size(mask) - 1, F.lit(0)))
    return mask_labels(rest, rest_mask)


def mask_labels(labels: Column, mask: Column) -> Column:
    """Given labels, with masked positions ignored; without a mask they stay as they are."""
    masked = F.zip_with(labels, mask, lambda x, m: F.when(m == 0, F.lit(IGNORED_LABEL)).otherwise(x))
    return F.coalesce(masked, labels)


def template(first: Column, bos: int, eos: int, sep: int, second: Column | None = None) -> Column:
    """``<bos> A <eos>``, or ``<bos> A <sep> B <eos>`` for a pair."""
    def one(token: int) -> Column:
        return F.array(F.lit(token))

    if second is None:
        return F.concat(one(bos), first, one(eos))
    return F.concat(one(bos), first, one(sep), second, one(eos))


def batch_tokens(ids: Column, mask: Column) -> Column:
    """Tokens that count: the sum of the mask, else the number of ids."""
    return F.coalesce(F.aggregate(mask, F.lit(0), lambda a, x: a + x), F.size(ids)).cast("long")


def pad(values: Column, size: Column, value: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(value), (size - F.size(values)).cast("int")))


def parse_tags(pairs: Column) -> Column:
    """``key=value`` strings to a map: split at the first ``=``, trimmed; others are skipped; the
    last value of a repeated key wins."""
    parts = F.transform(
        F.filter(pairs, lambda p: p.contains("=")),
        lambda p: F.struct(
            F.trim(F.substring_index(p, "=", 1)).alias("key"),
            F.trim(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("value"),
        ),
    )
    keys = F.array_distinct(F.transform(parts, lambda e: e["key"]))
    return F.map_from_arrays(
        keys,
        F.transform(keys, lambda k: F.element_at(F.filter(parts, lambda e: e["key"] == k), -1)["value"]),
    )


@F.arrow_udf(T.StringType())
def _joined(lists: pa.Array) -> pa.Array:
    flat = lists.flatten()
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.append(0, np.cumsum(lengths, dtype=np.int64))
    if flat.null_count:
        ends = np.append(0, np.cumsum(flat.is_valid().to_numpy(zero_copy_only=False), dtype=np.int64))[ends]
        flat = flat.drop_null()
    # Few distinct ids are spelled once each.
    coded = flat.dictionary_encode()
    words = coded.dictionary.cast(pa.string()).take(coded.indices)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words, mask=lists.is_null()), " ")


def joined_ids(ids: Column) -> Column:
    """Ids in decimal with a space between them, as ``array_join`` gives them, written a batch at once."""
    return _joined(ids)
