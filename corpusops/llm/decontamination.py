"""Benchmark decontamination: a prefix-filtered set join of item windows and documents.

An item is cut into windows of ``window`` consecutive words (one shorter window if it has fewer
words). A window is the set of its positioned shingles; a document contains it only if it holds
*all* of them, so by the prefix principle it is enough to join on a single shingle, and the one that
is rarest over all documents gives the fewest candidates. A candidate must leave room for the whole
window inside the document (length and positional bounds) and is then verified word by word, so
matches are exact.

The items are walked in blocks of at most ``block_windows`` distinct windows. Only the index of one
block is broadcast at a time; its size is bounded by that parameter, however many items there are,
and every block is matched against all documents. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusops.llm.common import alnum_words, as_bytes, bound_batches
from corpusops.session import cut_lineage

WINDOW = 10
SHINGLE = 3
BLOCK_WINDOWS = 200_000
BITS = 21

MATCHES = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


@dataclass
class Block:
    """Distinct windows of some items: their words as ids, the items that hold them, the index."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    windows: dict[tuple[int, ...], set[str]] = field(default_factory=dict)

    def add(self, words: tuple[bytes, ...], item: str | None) -> None:
        known = self.vocabulary
        ids = tuple(known.setdefault(w, len(known) + 1) for w in words)
        items = self.windows.setdefault(ids, set())
        if item is not None:
            items.add(item)

    def shingles(self) -> dict[int, np.ndarray]:
        """Distinct shingle keys by shingle length."""
        found: dict[int, set[int]] = {}
        for ids in self.windows:
            size = min(SHINGLE, len(ids))
            found.setdefault(size, set()).update(shingle_keys(np.array(ids, np.int64), size).tolist())
        return {size: np.array(sorted(keys), np.int64) for size, keys in sorted(found.items())}


@dataclass
class Index:
    """Windows grouped by length, and for each shingle length the windows by their rarest shingle."""

    vocabulary: dict[bytes, int]
    prefixes: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    words: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]


def shingle_keys(ids: np.ndarray, size: int) -> np.ndarray:
    """Key of the shingle at each position; 0 where it holds a word that no window has."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key, known = ids[:n].copy(), ids[:n] > 0
    for j in range(1, size):
        part = ids[j : j + n]
        key = (key << BITS) | part
        known &= part > 0
    key[~known] = 0
    return key


def lookup(keys: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose key is among ``sorted_keys``, and its place there."""
    at = np.flatnonzero(keys)
    place = np.searchsorted(sorted_keys, keys[at])
    place[place == len(sorted_keys)] = 0
    same = sorted_keys[place] == keys[at]
    return at[same], place[same]


def batch_ids(texts: pa.Array, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of all texts in a row, an unknown word between any two; and where each text starts."""
    parts, starts, at = [], [0], 0
    gap = np.zeros(1, np.int64)
    for text in as_bytes(texts):
        words = alnum_words(text)
        parts += [np.fromiter(map(vocabulary.get, words, repeat(0)), np.int64, len(words)), gap]
        at += len(words) + 1
        starts.append(at)
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array(starts, np.int64)


def blocks(benchmark: DataFrame, text: str, item: str, window: int, block_windows: int) -> Iterator[Block]:
    """Blocks of distinct windows; items stream through the driver one partition at a time."""
    block = Block()
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    for row in rows.toLocalIterator():
        words = alnum_words(row["text"].encode()) if row["text"] is not None else []
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            block.add(tuple(words[i : i + size]), row["item"])
            if len(block.windows) >= block_windows:
                yield block
                block = Block()
    if block.windows:
        yield block


def shingle_frequency(docs: DataFrame, text: str, block: Block) -> dict[int, np.ndarray]:
    """How often each shingle of the block occurs in all documents."""
    shingles = block.shingles()
    shared = docs.sparkSession.sparkContext.broadcast((block.vocabulary, shingles))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, by_size = shared.value
        totals = {size: np.zeros(len(keys), np.int64) for size, keys in by_size.items()}
        for batch in batches:
            ids, _ = batch_ids(batch.column(0), vocabulary)
            for size, keys in by_size.items():
                totals[size] += np.bincount(lookup(shingle_keys(ids, size), keys)[1], minlength=len(keys))
        for size, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), size, np.int32)), pa.array(at), pa.array(n[at])], ["size", "place", "n"]
            )

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "size int, place long, n long")
    result = {size: np.zeros(len(keys), np.int64) for size, keys in shingles.items()}
    for row in counted.groupBy("size", "place").agg(F.sum("n").alias("n")).collect():
        result[row["size"]][row["place"]] = row["n"]
    shared.unpersist()
    return result


def build_index(block: Block, frequency: dict[int, np.ndarray]) -> Index:
    shingles = block.shingles()
    windows = sorted(block.windows)
    width = max(map(len, windows))
    words = np.zeros((len(windows), width), np.int64)
    lengths = np.array([len(w) for w in windows], np.int64)
    rows: dict[int, list[tuple[int, int, int]]] = {}
    for number, ids in enumerate(windows):
        words[number, : len(ids)] = ids
        size = min(SHINGLE, len(ids))
        keys = shingle_keys(np.array(ids, np.int64), size)
        place = np.searchsorted(shingles[size], keys)
        rarest = int(np.lexsort((keys, frequency[size][place]))[0])
        rows.setdefault(size, []).append((int(keys[rarest]), rarest, number))
    prefixes = []
    for size, found in sorted(rows.items()):
        keys, offsets, numbers = (np.array(x, np.int64) for x in zip(*sorted(found)))
        distinct, first = np.unique(keys, return_index=True)
        prefixes.append((size, distinct, np.append(first, len(keys)), offsets, numbers))
    return Index(block.vocabulary, prefixes, words, lengths, [sorted(block.windows[w]) for w in windows])


def candidates(ids: np.ndarray, starts: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Verified occurrences: start position in ``ids`` and number of the window."""
    all_starts, all_windows = [], []
    for size, keys, first, offsets, numbers in index.prefixes:
        at, place = lookup(shingle_keys(ids, size), keys)
        if not len(at):
            continue
        many = first[place + 1] - first[place]
        entry = np.repeat(first[place], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        start, window = np.repeat(at, many) - offsets[entry], numbers[entry]
        length = index.lengths[window]
        doc = np.searchsorted(starts, np.repeat(at, many), "right") - 1
        fits = (start >= starts[doc]) & (start + length <= starts[doc + 1] - 1)
        start, window, length = start[fits], window[fits], length[fits]
        for n in np.unique(length):
            pick = length == n
            s, w = start[pick], window[pick]
            same = np.ones(len(s), bool)
            for j in range(n):
                same &= ids[s + j] == index.words[w, j]
            all_starts.append(s[same])
            all_windows.append(w[same])
    if not all_starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(all_starts), np.concatenate(all_windows)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Union of half-open intervals; touching ones are joined."""
    if not len(starts):
        return [], []
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)
    return starts[new].tolist(), ends[last].tolist()


def matcher(shared, text: Column, before: Column) -> Column:
    """What the text holds of one block, added to what ``before`` holds of earlier ones."""

    @F.arrow_udf(MATCHES)
    def match(texts: pa.Array, earlier: pa.Array) -> pa.Array:
        index: Index = shared.value
        ids, starts = batch_ids(texts, index.vocabulary)
        at, window = candidates(ids, starts, index)
        doc = np.searchsorted(starts, at, "right") - 1
        order = np.argsort(doc, kind="stable")
        at, window, doc = at[order], window[order], doc[order]
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        out = []
        for i, old in enumerate(earlier.to_pylist()):
            lo, hi = bounds[i], bounds[i + 1]
            n = int(starts[i + 1] - starts[i] - 1)
            if lo == hi:
                out.append(old | {"n_words": n} if old else {"n_words": n, "starts": [], "ends": [], "items": []})
                continue
            s = at[lo:hi] - starts[i]
            e = s + index.lengths[window[lo:hi]]
            items = {x for w in np.unique(window[lo:hi]) for x in index.items[w]}
            if old:
                s, e = np.append(s, old["starts"]).astype(np.int64), np.append(e, old["ends"]).astype(np.int64)
                items |= set(old["items"])
            first, last = merged(s, e)
            out.append({"n_words": n, "starts": first, "ends": last, "items": sorted(items)})
        return pa.array(out, match_type)

    match_type = pa.struct(
        [
            ("n_words", pa.int64()),
            ("starts", pa.list_(pa.int64())),
            ("ends", pa.list_(pa.int64())),
            ("items", pa.list_(pa.string())),
        ]
    )
    return match.asNondeterministic()(text, before)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_text: str = "text",
    item_id: str = "item_id",
    window: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
    result: str = "contamination",
) -> DataFrame:
    """``docs`` with one more column ``result``: number of words, hit word ranges and item ids.

    Ranges are half-open, merged and in order. Null and empty texts have no words and no hits. Items
    without words have no window; an item whose id is null still marks words but is not listed. With
    no items nothing is hit. Repeated documents are judged row by row, repeated items once. Other
    columns of ``docs`` pass through untouched; one already named ``result`` is replaced.
    """
    if block_windows * window >= 1 << BITS:
        raise ValueError("block_windows * window must stay below 2^21")
    bound_batches(docs.sparkSession)
    none = F.lit(None).cast(MATCHES)
    found = docs
    earlier = none
    passes = 0
    for block in blocks(benchmark, item_text, item_id, window, block_windows):
        frequency = shingle_frequency(docs, text, block)
        shared = docs.sparkSession.sparkContext.broadcast(build_index(block, frequency))
        if passes:
            # One block at a time: earlier results are written before the next index is sent.
            found = cut_lineage(found)
            earlier = F.col(f"`{result}`")
        found = found.withColumn(result, matcher(shared, F.col(f"`{text}`"), earlier))
        passes += 1
    if not passes:
        shared = docs.sparkSession.sparkContext.broadcast(Index({}, [], np.zeros((0, 1), np.int64), np.zeros(0, np.int64), []))
        found = docs.withColumn(result, matcher(shared, F.col(f"`{text}`"), none))
    return found


def hit_words(result: str = "contamination") -> Column:
    """Number of words in the hit ranges."""
    pairs = F.arrays_zip(F.col(f"{result}.starts").alias("starts"), F.col(f"{result}.ends").alias("ends"))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda total, x: total + x["ends"] - x["starts"])


def contaminated(result: str = "contamination") -> Column:
    return F.size(F.col(f"{result}.starts")) > 0
