"""Exact repeated passages with a logarithmic family of suffix arrays.

A byte goes if it is covered by a string of ``length`` bytes that starts anywhere else as well. Not
every suffix has to be indexed for that. In each window of ``length`` bytes the gram (``GRAM`` bytes)
with the smallest hash is its anchor, the leftmost of equal ones; both copies of a repeated string
choose the same anchor, so only windows with the same anchor can be equal. Consecutive windows with one
anchor form a block, a stretch of text of at most ``2 * length - GRAM`` bytes.

1. Every text is cut into blocks, and anchors are counted. Blocks whose anchor occurs once hold no
   repeat; most of a corpus ends here, having moved a few bytes per block. The texts are cut again
   for the blocks that go on, and once more for the bytes of step 3, which is cheaper than to keep
   or move them.
2. Equal blocks are counted by digest. What occurs twice is repeated as a whole, so a group of
   copies of any size becomes one row with a count.
3. The bytes of one block of each kind are read from its text. Anchors with several kinds are dealt to shards of bounded size. Windows whose rolling
   hash occurs once in the shard are passed over. A shard takes its blocks in batches: each batch gets
   a suffix array of its windows, is merge-scanned against the existing levels, where equal neighbours are repeats, and levels of equal size are merged, so each
   suffix is merged a logarithmic number of times.
4. The marked windows are carried to all occurrences of their block, united per text and cut out.

An anchor with very many different blocks (a common line in ever new surroundings) would fill one
shard. Its windows are counted by digest in a plain distributed aggregation instead.

Texts are identified by MD5, so copies share one result. Only texts that lose a part of themselves
are moved, in step 4; everything else is narrow.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusops.llm.common import bitmap, bound_batches, in_bitmap, may_be_among, mix
from corpusops.session import cut_lineage

LENGTH = 200
GRAM = 40
CHUNK = 1 << 19  # windows looked at together; a block may be cut there, which step 3 makes good
POSITION_BITS = 20
KEY_BYTES = 7
BATCH_SUFFIXES = 50_000
SHARD_SUFFIXES = 150_000
MOST_BLOCKS = 4_000  # different blocks of one anchor in a shard

BASE = 0x9E3779B97F4A7C15 | 1
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


class Anchors:
    """Cuts texts into blocks. Holds the powers that rolling hashes need."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram, self.width = length, gram, length - gram + 1
        size = CHUNK + length
        ups, downs = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        ups[0] = downs[0] = 1
        self.up, self.down = np.multiply.accumulate(ups), np.multiply.accumulate(downs)
        self.byte = mix(np.arange(1, 257, dtype=np.uint64))

    def hashes(self, raw: np.ndarray, width: int) -> np.ndarray:
        """Rolling hash of every ``width`` bytes, the same wherever they lie."""
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.byte[raw] * self.up[: len(raw)], out=total[1:])
        n = len(raw) - width + 1
        return mix((total[width:] - total[:n]) * self.down[:n])

    def candidates(self, blocks: list[bytes]) -> np.ndarray:
        """For all bytes of the blocks end to end: whether a window begins there whose hash occurs twice."""
        text = b"".join(blocks)
        found = [
            self.hashes(np.frombuffer(text, np.uint8, min(CHUNK + self.length - 1, len(text) - at), at), self.length)
            for at in range(0, len(text) - self.length + 1, CHUNK)
        ]
        size = np.array([len(b) for b in blocks])
        place = np.arange(len(text)) + self.length <= np.repeat(np.cumsum(size), size)
        at = np.flatnonzero(place)
        hashes = np.concatenate(found)[at]
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        place[at[order[~(np.append(False, same) | np.append(same, False))]]] = False
        return place

    def smallest(self, keys: np.ndarray) -> np.ndarray:
        """Minimum of every run of ``width`` keys, from running minima of fixed pieces."""
        width, n = self.width, len(keys)
        padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
        padded[:n] = keys
        pieces = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(pieces, axis=1).ravel()
        behind = np.minimum.accumulate(pieces[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])

    def blocks(self, text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Anchor hash, first window and number of windows of each block, chunk by chunk."""
        windows = len(text) - self.length + 1
        low = np.uint64((1 << POSITION_BITS) - 1)
        for begin in range(0, windows, CHUNK):
            raw = np.frombuffer(text, np.uint8, min(CHUNK, windows - begin) + self.length - 1, begin)
            hashes = self.hashes(raw, self.gram)
            keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
            anchor = (self.smallest(keys) & low).astype(np.int64)
            first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
            yield hashes[anchor[first]], first + begin, np.diff(np.append(first, len(anchor)))


class SuffixLevels:
    """Windows of blocks in suffix arrays of geometrically growing size.

    A window is named by its place in the text of all blocks added so far; ``repeated`` marks the places
    whose window occurs more than once.
    """

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.text = b""
        self.repeated = bytearray()
        self.levels: list[list[int]] = []

    def suffix(self, place: int) -> bytes:
        return self.text[place : place + self.length]

    def add(self, blocks: list[bytes], begins: np.ndarray) -> None:
        """Index a batch of blocks; ``begins`` says for each of its bytes whether a window begins there."""
        places = (np.flatnonzero(begins) + len(self.text)).tolist()
        self.text = b"".join([self.text, *blocks])
        self.repeated += bytes(len(begins))
        array = self.scan(places)
        while self.levels and len(self.levels[-1]) < 2 * len(array):
            array = self.scan(self.levels.pop() + array)
        for level in self.levels:
            self.scan(level + array)
        self.levels.append(array)

    def scan(self, places: list[int]) -> list[int]:
        """Sort by suffix, which merges runs already in order, and mark equal neighbours."""
        keyed = sorted((self.suffix(p), p) for p in places)
        before, last = None, -1
        for key, place in keyed:
            if key == before:
                self.repeated[place] = self.repeated[last] = 1
            before, last = key, place
        return [place for _, place in keyed]


def _anchors_only(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Anchors(length)
        for batch in batches:
            found = [anchor for text in batch.column(0).to_pylist() for anchor, _, _ in cutter.blocks(text)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["anchor"])

    return rows


def _blocks_of(batch: pa.RecordBatch, cutter: Anchors, bits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row, anchors, digests, first windows and sizes of the blocks whose anchor may be shared."""
    for i, text in enumerate(batch.column(1).to_pylist()):
        for anchor, first, count in cutter.blocks(text):
            kept = in_bitmap(bits, anchor.view(np.int64))
            anchor, first, count = anchor[kept].view(np.int64), first[kept], count[kept]
            ends = (first + count + cutter.length - 1).tolist()
            digest = [xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(first.tolist(), ends)]
            if digest:
                yield i, anchor, np.array(digest, np.uint64).view(np.int64), first, count


def _block_rows(length: int, shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Anchors(length)
        for batch in batches:
            found = list(_blocks_of(batch, cutter, shared.value))
            if not found:
                continue
            row, anchor, digest, first, count = zip(*found)
            at = np.repeat(row, [len(a) for a in anchor])
            sizes = np.array([len(t) for t in batch.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)),
                    pa.array(sizes[at]),
                    pa.array(np.concatenate(anchor)),
                    pa.array(np.concatenate(digest)),
                    pa.array(np.concatenate(first).astype(np.int64)),
                    pa.array(np.concatenate(count).astype(np.int32)),
                ],
                ["key", "n_bytes", "anchor", "digest", "first", "windows"],
            )

    return rows


def _stretch_rows(length: int, shared, chosen):
    """Bytes of the blocks that may have been chosen to stand for their equals."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Anchors(length)
        for batch in batches:
            texts, keys = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            anchors, digests, stretches = [], [], []
            for i, anchor, digest, first, count in _blocks_of(batch, cutter, shared.value):
                place = anchor ^ digest ^ first ^ int.from_bytes(keys[i][:KEY_BYTES], "big")
                for j in np.flatnonzero(in_bitmap(chosen.value, place)):
                    anchors.append(anchor[j])
                    digests.append(digest[j])
                    stretches.append(texts[i][first[j] : first[j] + count[j] + length - 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors, pa.int64()), pa.array(digests, pa.int64()), pa.array(stretches, pa.binary())], ["anchor", "digest", "block"]
            )

    return rows


STRETCH_ROWS = "anchor long, digest long, block binary"
BLOCK_ROWS = "key binary, n_bytes long, anchor long, digest long, first long, windows int"


def _runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last index of each run of ones."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags, [0]]).astype(np.int8)))
    return edges[::2].tolist(), (edges[1::2] - 1).tolist()


def _index_shards(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [pa.Table.from_batches([b]) for b in batches]
        shard = pa.concat_tables(rows) if rows else None
        if not shard:
            return
        blocks = shard.column("block").to_pylist()
        begins = Anchors(length).candidates(blocks)
        ends = np.cumsum([len(b) for b in blocks])
        index = SuffixLevels(length)
        first, done = 0, 0
        # Batches of about as many windows each.
        windows = np.cumsum(begins)[ends - 1]
        while first < len(blocks):
            last = max(first + 1, int(np.searchsorted(windows, windows[first - 1] * (first > 0) + BATCH_SUFFIXES, "right")))
            index.add(blocks[first:last], begins[done : ends[last - 1]])
            first, done = last, int(ends[last - 1])
        flags = np.frombuffer(bytes(index.repeated), np.uint8)
        anchors, digests, lows, highs = [], [], [], []
        for anchor, digest, n, end, block in zip(*(shard.column(c).to_pylist() for c in ("anchor", "digest", "n")), ends, blocks):
            low, high = _runs(flags[end - len(block) : end])
            if low and n == 1:
                anchors.append(anchor)
                digests.append(digest)
                lows.append(low)
                highs.append(high)
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchors, pa.int64()), pa.array(digests, pa.int64()), pa.array(lows, pa.list_(pa.int32())), pa.array(highs, pa.list_(pa.int32()))],
            ["anchor", "digest", "low", "high"],
        )

    return run


RUN_ROWS = "anchor long, digest long, low array<int>, high array<int>"


def _window_rows(length: int):
    """Each window of a block by its digest: for anchors with too many different blocks for one shard."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, digest, block, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                count = len(block) - length + 1
                windows = [xxhash.xxh3_128_digest(block[i : i + length]) for i in range(count)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(count, anchor, np.int64)),
                        pa.array(np.full(count, digest, np.int64)),
                        pa.array(np.full(count, n, np.int64)),
                        pa.array(np.arange(count, dtype=np.int32)),
                        pa.array(windows, pa.binary()),
                    ],
                    ["anchor", "digest", "n", "at", "window"],
                )

    return rows


SPANS = T.StructType(
    [
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("n_removed", T.LongType()),
    ]
)


def united(low: Column, high: Column) -> Column:
    """Union of half-open byte ranges, touching ones joined: the maximal removed runs."""

    @F.arrow_udf(SPANS)
    def unite(lows: pa.Array, highs: pa.Array) -> pa.Array:
        out = []
        for low, high in zip(lows.to_pylist(), highs.to_pylist()):
            a, b = np.array(low, np.int64), np.array(high, np.int64)
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            new = np.append(True, a[1:] > b[:-1])
            starts, ends = a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]
            out.append({"starts": starts.tolist(), "ends": ends.tolist(), "n_removed": int((ends - starts).sum())})
        kind = pa.struct([("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("n_removed", pa.int64())])
        return pa.array(out, kind)

    return unite.asNondeterministic()(low, high)


def kept_sha256(body: Column, starts: Column, ends: Column) -> Column:
    """SHA-256 of the bytes outside the ranges."""

    @F.arrow_udf(T.StringType())
    def digest(bodies: pa.Array, all_starts: pa.Array, all_ends: pa.Array) -> pa.Array:
        out = []
        for text, starts, ends in zip(bodies.to_pylist(), all_starts.to_pylist(), all_ends.to_pylist()):
            kept, at = hashlib.sha256(), 0
            for a, b in zip(starts, ends):
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            out.append(kept.hexdigest())
        return pa.array(out, pa.string())

    return digest.asNondeterministic()(body, starts, ends)


def find_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends``, one row per row of ``docs``.

    ``starts`` and ``ends`` are the removed byte ranges of the text's UTF-8 form, half-open and in order.
    Matches never cross texts and are judged on the input. Null texts count as empty; texts shorter
    than ``length`` keep all. Repeated rows are copies of each other, whatever their ids, so all of them
    go from ``length`` bytes on. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    key = F.unhex(F.md5(body))
    bodies = docs.select(key.alias("key"), body.alias("body"))

    # 1: anchors of all texts; only blocks whose anchor occurs twice go on.
    long_enough = bodies.filter(F.length("body") >= length)
    anchors = long_enough.select("body").mapInArrow(_anchors_only(length), "anchor long")
    shared = cut_lineage(anchors.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"))
    bits = spark.sparkContext.broadcast(bitmap(shared, "anchor"))
    found = long_enough.mapInArrow(_block_rows(length, bits), BLOCK_ROWS)
    blocks = cut_lineage(found.join(shared, "anchor", "left_semi"))

    # 2: equal blocks become one row.
    place = F.min(F.struct("key", "first", "windows")).alias("place")
    equal = cut_lineage(blocks.groupBy("anchor", "digest").agg(F.count("*").alias("n"), place))
    kinds = equal.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("place.windows").alias("suffixes"))
    several = cut_lineage(
        equal.join(kinds.filter("kinds > 1"), "anchor").select("anchor", "digest", "n", "place.*", (F.col("kinds") > MOST_BLOCKS).alias("many"))
    )
    whole = equal.filter("n > 1").select(
        "anchor", "digest", F.array(F.lit(0)).alias("low"), F.array(F.col("place.windows") - 1).alias("high")
    )

    # 3: bytes of the different blocks, then suffix arrays.
    sizes = {r["many"]: r["s"] for r in several.groupBy("many").agg(F.sum("windows").alias("s")).collect()}
    place = F.col("anchor").bitwiseXOR(F.col("digest")).bitwiseXOR(F.col("first"))
    place = place.bitwiseXOR(F.conv(F.hex(F.substring("key", 1, KEY_BYTES)), 16, 10).cast("long"))
    chosen = spark.sparkContext.broadcast(bitmap(several.select(place.alias("place")), "place"))
    stretches = long_enough.mapInArrow(_stretch_rows(length, bits, chosen), STRETCH_ROWS).dropDuplicates(["anchor", "digest"])
    stretches = stretches.join(several.select("anchor", "digest", "n", "many"), ["anchor", "digest"])
    marked = whole
    if sizes.get(False):
        shards = 1 + sizes[False] // SHARD_SUFFIXES
        few = stretches.filter(~F.col("many")).select("anchor", "digest", "block", "n").repartition(shards, "anchor")
        marked = marked.unionByName(few.mapInArrow(_index_shards(length), RUN_ROWS))
    if sizes.get(True):
        rows = stretches.filter("many").select("anchor", "digest", "block", "n").mapInArrow(
            _window_rows(length), "anchor long, digest long, n long, at int, window binary"
        )
        rows = cut_lineage(rows)
        twice = rows.groupBy("window").agg(F.sum("n").alias("_n")).filter("_n > 1").select("window")
        at = F.sort_array(F.collect_list("at"))
        hit = rows.filter("n = 1").join(twice, "window", "left_semi").groupBy("anchor", "digest").agg(at.alias("low"))
        marked = marked.unionByName(hit.withColumn("high", F.col("low")))

    # 4: ranges of every occurrence, united per text.
    marked = cut_lineage(marked)
    runs = blocks.join(marked, ["anchor", "digest"]).select(
        "key", "n_bytes", "first", F.explode(F.arrays_zip("low", "high")).alias("run")
    )
    ranges = runs.select(
        "key", "n_bytes", (F.col("first") + F.col("run.low")).alias("low"), (F.col("first") + F.col("run.high") + length).alias("high")
    ).distinct()
    spans = (
        ranges.groupBy("key", "n_bytes")
        .agg(F.collect_list(F.struct("low", "high")).alias("r"))
        .select("key", "n_bytes", united(F.col("r.low"), F.col("r.high")).alias("s"))
        .select("key", "n_bytes", "s.*")
    )
    spans = cut_lineage(spans)
    partly = spans.filter("n_removed < n_bytes").select("key", "starts", "ends")
    # A text that loses a part of itself only has no copy, so it meets one body.
    cuts = partly.join(may_be_among(bodies, "key", partly), "key").select("key", kept_sha256(F.col("body"), F.col("starts"), F.col("ends")).alias("sha"))
    removed = spans.join(cuts, "key", "left").select("key", "n_removed", "starts", "ends", F.coalesce("sha", F.lit(EMPTY_SHA)).alias("sha"))
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), key.alias("key"), F.length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("full")
    )
    none = F.array().cast("array<bigint>")
    return rows.join(removed, "key", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.size("starts"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("sha", "full").alias("kept_sha256"),
        F.coalesce("starts", none).alias("starts"),
        F.coalesce("ends", none).alias("ends"),
    )
