"""Decoding of byte-level ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decode_bytes(input_ids: Column, ids: dict[str, int]) -> Column:
    """Text of byte ids; ids outside the byte vocabulary (specials, unknown) are left out.

    The vocabulary has at most 256 bytes, so it travels with the function, and a batch is looked up at once.
    """
    table = np.full(max(ids.values(), default=0) + 1, -1, dtype=np.int16)
    for value, number in ids.items():
        table[number] = int(value, 16)

    @F.arrow_udf(T.BinaryType())
    def decoded(lists: pa.Array) -> pa.Array:
        lists = lists.cast(pa.list_(pa.int64()))
        found = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        found = np.where((found >= 0) & (found < len(table)), found, len(table))
        raw = np.append(table, np.int16(-1))[found]
        rows = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64))
        ends = np.append(0, np.cumsum(raw >= 0))[rows]
        raw = raw[raw >= 0].astype(np.uint8)
        null = pa.array(np.zeros(len(lists), bool)) if not lists.null_count else lists.is_null()
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)])
        return pc.if_else(null, pa.scalar(None, pa.large_binary()), texts).cast(pa.binary())

    return F.make_valid_utf8(decoded(input_ids).cast("string"))
