"""Near-duplicate documents by SuperMinHash.

1. Each text becomes the set of its distinct word shingles, as 64-bit hashes, and the set a
   SuperMinHash signature: every element visits the registers in a random permutation of its own, in
   step ``j`` with a value in ``[j, j + 1)``. A register's minimum is thus drawn without replacement,
   which lowers the variance, and the walk stops as soon as ``j`` exceeds every register: one step
   for texts with many shingles, a few for short ones.
2. Each distinct pair of id and text is a node. Equal sets are one class, represented by one of its
   nodes, so copies never meet in pairs.
3. Signatures are cut into bands. All members of a bucket (equal band) are compared on the full sets with its
   smallest member and with its hub, the one with most mates in all buckets: two comparisons a member.
4. A bucket whose members are all linked with its leaders is settled: no further link could change anything.
   In open buckets of up to 32 members, members of different leaders are compared unless their
   distances to the smallest member rule a link out (Jaccard distance obeys the triangle inequality). Larger
   ones are compared in pairs of bounded blocks, which return links only, never their pairs; sets with too many
   shingles that nothing else has are left out before.
5. Links become components by contracting the graph, a distributed union-find.

So no link between bucket mates is lost and no bucket is capped. A pair at the threshold shares no
bucket with probability ``(1 - t ** rows) ** bands``, 5e-6 with the defaults.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusops.llm.common import WordHashes, as_bytes, bound_batches, may_be_among, mix, space_words
from corpusops.session import ensure_checkpoint_dir, join_small, remove_folder

SHINGLE = 5
BANDS = 40
ROWS = 6
PERCENT = 80
# Up to so many members the pairs of an open bucket are compared one by one, beyond it in blocks of sets.
LARGE_BUCKET = 32
BLOCK_SETS = 256
BLOCK_SHINGLES = 1 << 17
# Classes of sets by the share of shingles that no other set has.
CLASSES = 16
SLICE = 1 << 13

PROFILE = T.StructType(
    [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType(), False)),
    ]
)
PROFILE_ARROW = pa.struct([("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])
STEP = np.uint64(0x9E3779B97F4A7C15)


# Folders of tables written on the way to a result, deleted once it no longer rests on them.
_folders: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: no lineage, few partitions if it is small, and a known size."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/near-{uuid.uuid4().hex}"
    _folders.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*kept: DataFrame) -> None:
    """Delete the written tables but those that ``kept`` reads; these stay for the caller's result."""
    files = {f.rsplit("/", 1)[0] for df in kept for f in df.inputFiles()}
    for path in _folders:
        if not any(f.endswith(path.rsplit("/", 1)[1]) for f in files):
            remove_folder(kept[0].sparkSession, path)
    _folders.clear()


def shingle_set(text: bytes | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words than ``size`` form one shingle."""
    words = hashes.of(space_words(text))
    if not len(words):
        return words
    width = min(size, len(words))
    n = len(words) - width + 1
    value = np.full(n, width, np.uint64)
    for j in range(width):
        value = mix(value * STEP + words[j : j + n])
    value.sort()
    return value[np.append(True, value[1:] != value[:-1])]


def super_minhash(elements: np.ndarray, m: int) -> np.ndarray:
    """Signature of ``m`` registers: step number in the upper 16 bits, random value below it."""
    registers = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    if not len(elements):
        return registers
    order = None
    rows = np.arange(len(elements))
    seeds = STEP * np.arange(1, m + 1, dtype=np.uint64)
    for j in range(m):
        if int(registers.max()) >> 48 < j:
            break
        draw = mix(elements + seeds[j])
        value = (draw >> np.uint64(16)) | np.uint64(j << 48)
        pick = j + (((draw & np.uint64(0xFFFF)) * np.uint64(m - j)) >> np.uint64(16)).astype(np.int64)
        if order is None:
            first = pick
            np.minimum.at(registers, pick, value)
            if int(registers.max()) >> 48 == 0:
                break
            # Short of registers: from here on each element needs its permutation.
            order = np.empty((len(elements), m), np.int16)
            order[:] = np.arange(m, dtype=np.int16)
            order[rows, first] = 0
            order[:, 0] = first
            continue
        register = order[rows, pick].copy()
        order[rows, pick] = order[:, j]
        order[:, j] = register
        np.minimum.at(registers, register, value)
    return registers


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One key a band; the number of the band is part of it."""
    parts = signature.reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(parts.shape[1]):
        key = mix(key * STEP + parts[:, j])
    return key.view(np.int64)


def profile(text: Column, size: int, bands: int, rows: int) -> Column:
    @F.arrow_udf(PROFILE)
    def profiled(texts: pa.Array) -> pa.Array:
        hashes = WordHashes()
        out = []
        for text in as_bytes(texts):
            elements = shingle_set(text, size, hashes)
            if len(elements):
                keys = band_keys(super_minhash(elements, bands * rows), bands)
                out.append((len(elements), xxhash.xxh3_128_digest(elements.tobytes()), keys))
            else:
                out.append((0, None, np.zeros(0, np.int64)))
        return pa.StructArray.from_arrays(
            [
                pa.array([x[0] for x in out], pa.int64()),
                pa.array([x[1] for x in out], pa.binary()),
                pa.ListArray.from_arrays(
                    np.cumsum([0, *(len(x[2]) for x in out)]).astype(np.int32),
                    np.concatenate([x[2] for x in out]) if out else np.zeros(0, np.int64),
                ),
            ],
            fields=list(PROFILE_ARROW),
        )

    return profiled.asNondeterministic()(text)


OVERLAP = T.StructType([T.StructField("common", T.LongType()), T.StructField("total", T.LongType())])


def overlap(left: Column, right: Column, size: int) -> Column:
    """Sizes of the intersection and the union of the full shingle sets of two texts."""

    @F.arrow_udf(OVERLAP)
    def measured(lefts: pa.Array, rights: pa.Array) -> pa.Array:
        hashes = WordHashes()
        known: tuple[bytes | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        common, total = [], []
        for a, b in zip(as_bytes(lefts), as_bytes(rights)):
            if known[0] != a:
                known = (a, shingle_set(a, size, hashes))
            both = np.concatenate([known[1], shingle_set(b, size, hashes)])
            both.sort()
            common.append(int((both[1:] == both[:-1]).sum()))
            total.append(len(both) - common[-1])
        return pa.StructArray.from_arrays([pa.array(common, pa.int64()), pa.array(total, pa.int64())], ["common", "total"])

    return measured.asNondeterministic()(left, right)


def verify(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """``a, b, common, total`` of each pair of ids, measured on the full sets.

    Most texts that occur in no pair are left out before the joins. A document that is in very many
    pairs is a skewed key of a join between two tables, which adaptive execution splits.
    """
    pairs = written(pairs)
    needed = may_be_among(texts, "doc_id", pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id"))))
    left = needed.select(F.col("doc_id").alias("a"), F.col("_text").alias("_a"))
    right = needed.select(F.col("doc_id").alias("b"), F.col("_text").alias("_b"))
    both = pairs.join(right, "b").join(left, "a")
    counted = both.select("a", "b", overlap(F.col("_a"), F.col("_b"), size).alias("o"))
    # Rows that share an id are measured one by one; the best pair speaks for the id.
    return written(
        counted.groupBy("a", "b").agg(F.max_by("o", F.col("o.common") / F.col("o.total")).alias("o")).select("a", "b", "o.*")
    )


def link_candidates(reps: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Verified links ``a, b`` that span the components of all links between bucket mates."""
    banded = reps.select("doc_id", F.explode("bands").alias("key"))
    sizes = banded.groupBy("key").agg(F.min("doc_id").alias("_x"), F.max("doc_id").alias("_y"), F.count("*").alias("n")).filter("_x != _y")
    members = written(banded.join(sizes.select("key", "n"), "key"))
    linked = F.col("common") * 100 >= F.col("total") * percent

    # The smallest member of each bucket and its hub, the one with most mates in all buckets, against the others.
    mates = members.groupBy("doc_id").agg(F.sum("n").alias("mates"))
    hub = F.max_by("doc_id", F.struct("mates", F.xxhash64("doc_id")))
    chosen = written(members.join(mates, "doc_id").groupBy("key").agg(F.min("doc_id").alias("first"), F.array_distinct(F.array(F.min("doc_id"), hub)).alias("l")))
    pairs = members.join(chosen.select("key", F.explode("l").alias("l")), "key").filter("doc_id != l")
    tested = verify(pairs.select(F.least("doc_id", "l").alias("a"), F.greatest("doc_id", "l").alias("b")).distinct(), texts, size)
    links = tested.filter(linked).select("a", "b")

    # A member is labelled by the leader it is linked with, the hub first; a bucket with one label is settled.
    known = links.withColumn("linked", F.lit(True))
    least, greatest = F.least("doc_id", "l"), F.greatest("doc_id", "l")
    judged = members.join(chosen, "key").select("key", "n", "doc_id", "first", F.explode("l").alias("l"))
    judged = judged.withColumns({"a": least, "b": greatest}).join(known, ["a", "b"], "left")
    mine = F.coalesce("linked", F.lit(False)) | (F.col("doc_id") == F.col("l"))
    leader = F.min(F.when(mine, F.struct(F.col("l") == F.col("first"), "l")))["l"]
    placed = written(judged.groupBy("key", "n", "doc_id").agg(F.coalesce(leader, "doc_id").alias("component")))
    spread = placed.groupBy("key").agg(F.min("component").alias("_x"), F.max("component").alias("_y")).filter("_x != _y").select("key")
    placed = written(placed.join(spread, "key", "left_semi"))
    links = links.union(links_in_small_buckets(placed.filter(F.col("n") <= LARGE_BUCKET), chosen, tested, texts, size, percent))
    large = placed.filter(F.col("n") > LARGE_BUCKET)
    if large.limit(1).count():
        links = links.union(links_in_large_buckets(large, texts, size, percent))
    return links


def links_in_small_buckets(placed: DataFrame, chosen: DataFrame, tested: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between mates of different components: at most ``LARGE_BUCKET / 2`` pairs a member.

    Left out are pairs that the distances to the bucket's smallest member rule out, as Jaccard distance obeys the
    triangle inequality.
    """
    distance = tested.select(F.col("a").alias("first"), F.col("b").alias("doc_id"), (1 - F.col("common") / F.col("total")).alias("d"))
    left = placed.join(chosen.select("key", "first"), "key").join(distance, ["first", "doc_id"]).select("key", "doc_id", "component", "d")
    left = written(left)
    right = left.select("key", F.col("doc_id").alias("b"), F.col("component").alias("_component"), F.col("d").alias("_d"))
    near = F.abs(F.col("d") - F.col("_d")) <= 1 - percent / 100 + 1e-9
    rest = (
        left.join(right, "key")
        .filter((F.col("doc_id") < F.col("b")) & (F.col("component") != F.col("_component")) & near)
        .select(F.col("doc_id").alias("a"), "b")
        .distinct()
        .join(tested.select("a", "b"), ["a", "b"], "left_anti")
    )
    measured = verify(rest, texts, size)
    return measured.filter(F.col("common") * 100 >= F.col("total") * percent).select("a", "b")


def links_in_large_buckets(placed: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between components of large open buckets, found block by block; pairs are never rows.

    A shingle that no other set here has can be in no intersection. With ``r`` such shingles for each other one, two
    sets are at most ``1 / (1 + r + r')`` alike, so sets and pairs of blocks beyond the threshold are left out. What
    stays is compared in pairs of blocks of bounded size, by products of their incidence matrices; each gives
    at most as many links as it has sets.
    """
    other = F.min(F.when(F.col("component") != F.col("doc_id"), F.col("component")))
    nodes = written(placed.groupBy("doc_id").agg(F.coalesce(other, "doc_id").alias("component")))
    star = placed.groupBy("key").agg(F.min("doc_id").alias("a")).join(placed.select("key", F.col("doc_id").alias("b")), "key")
    cluster = components(star.filter("a != b").select("a", "b")).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
    needed = may_be_among(texts, "doc_id", nodes.select("doc_id"))
    elements = needed.join(nodes, "doc_id").select("doc_id", "component", shingle_sets(F.col("_text"), size).alias("elements"))
    sets = written(elements.join(cluster, "doc_id").withColumn("n", F.size("elements")))
    lone = sets.select("doc_id", F.explode("elements").alias("e")).groupBy("e").agg(F.count("*").alias("c"), F.first("doc_id").alias("doc_id"))
    lone = lone.filter("c = 1").groupBy("doc_id").agg(F.count("*").alias("lone"))
    ratio = F.coalesce(F.col("lone") / (F.col("n") - F.col("lone")), F.lit(0.0))
    most = 100 / percent - 1
    able = sets.join(lone, "doc_id", "left").withColumn("r", ratio).filter(F.col("r") <= most + 1e-9)
    able = written(able.withColumn("class", F.floor(F.col("r") / (most / CLASSES) + 1e-9).cast("int")).drop("lone", "r"))
    # Sets of one large component need no comparison with each other; those of small ones are dealt together.
    counts = able.groupBy("cluster", "component").agg(F.count("*").alias("k"))
    whole = counts.select("cluster", "component", F.when(F.col("k") >= BLOCK_SETS, F.col("component")).alias("whole"))
    able = able.join(whole, ["cluster", "component"])
    cell = ["cluster", "whole", "class"]
    room = able.groupBy(cell).agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    same = [F.col(f"_r.{c}").eqNullSafe(F.col(f"_l.{c}")) for c in cell]
    dealt = able.alias("_l").join(room.alias("_r"), same).select("_l.*", "_r.parts")
    dealt = dealt.withColumn("block", F.xxhash64(*cell, F.col("whole").isNull(), F.pmod(F.xxhash64("doc_id", F.lit(7)), "parts")))
    block = F.collect_list(F.struct("doc_id", "component", "elements")).alias("sets")
    blocks = written(dealt.groupBy("block", *cell).agg(block))
    heads = blocks.select("cluster", "block", "whole", "class")
    other = heads.select("cluster", F.col("block").alias("_block"), F.col("whole").alias("_whole"), F.col("class").alias("_class"))
    met = heads.join(other, "cluster").filter((F.col("block") <= F.col("_block")) & (F.col("class") + F.col("_class") <= CLASSES))
    met = written(met.filter(F.coalesce(F.col("whole") != F.col("_whole"), F.lit(True))).select("block", "_block"))
    right = blocks.select(F.col("block").alias("_block"), F.col("sets").alias("_sets"))
    spread = met.repartition("block", "_block").join(blocks.select("block", "sets"), "block").join(right, "_block")
    return written(spread.select("sets", "_sets", F.lit(percent).alias("percent")).mapInArrow(block_links, "a long, b long"))


def block_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the components of two blocks of sets, a spanning forest of them."""
    for batch in batches:
        links: list[tuple[int, int]] = []
        for row in range(batch.num_rows):
            one, two = (batch.column(c)[row].values for c in range(2))
            links += spanning_links(*(_block(x) for x in (one, two)), batch.column(2)[row].as_py())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in range(2)], ["a", "b"])


def _block(sets: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, components_, elements = (sets.field(k) for k in range(3))
    sizes = np.diff(elements.offsets.to_numpy())
    return ids.to_numpy(), components_.to_numpy(), elements.flatten().to_numpy(), sizes


def spanning_links(one: tuple, two: tuple, percent: int) -> list[tuple[int, int]]:
    (ids, labels, values, sizes), (_ids, _labels, _values, _sizes) = one, two
    kinds, column = np.unique(np.concatenate([values, _values]), return_inverse=True)
    row, _row = np.repeat(np.arange(len(ids)), sizes), np.repeat(np.arange(len(_ids)), _sizes)
    column, _column = column[: len(values)], column[len(values) :]
    both = np.zeros(len(kinds), bool)
    both[np.intersect1d(column, _column)] = True
    # Only shingles of both blocks matter; they are numbered anew and taken in slices.
    number = np.cumsum(both) - 1
    row, column = row[both[column]], number[column[both[column]]]
    _row, _column = _row[both[_column]], number[_column[both[_column]]]
    common = np.zeros((len(ids), len(_ids)), np.float32)
    for start in range(0, int(both.sum()), SLICE):
        left, right = np.zeros((len(ids), SLICE), np.float32), np.zeros((len(_ids), SLICE), np.float32)
        for matrix, r, c in ((left, row, column), (right, _row, _column)):
            here = (c >= start) & (c < start + SLICE)
            matrix[r[here], c[here] - start] = 1
        common += left @ right.T
    near = 100 * common >= percent * (sizes[:, None] + _sizes[None, :] - common)
    near &= labels[:, None] != _labels[None, :]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []
    for i, j in np.argwhere(near).tolist():
        x, y = root(int(labels[i])), root(int(_labels[j]))
        if x != y:
            parent[x] = y
            links.append((int(ids[i]), int(_ids[j])))
    return links


def shingle_sets(text: Column, size: int) -> Column:
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def sets(texts: pa.Array) -> pa.Array:
        hashes = WordHashes()
        found = [shingle_set(t, size, hashes).view(np.int64) for t in as_bytes(texts)]
        offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        return pa.ListArray.from_arrays(offsets, np.concatenate(found) if found else np.zeros(0, np.int64))

    return sets.asNondeterministic()(text)


def components(links: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable over ``links(a, b)``.

    In each round every node joins its first neighbour, or stays if it comes first itself, and the graph
    is contracted to the nodes joined. The first round goes by id, which settles stars around their
    smallest node at once; later ones by a hash, which halves long chains. Ends when no edge is left.
    """
    edges = _edges(links.select("a", "b"))
    joins: list[DataFrame] = []
    while edges.limit(1).count():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = (lambda c: F.col(c)) if not joins else (lambda c: F.xxhash64(c, F.lit(len(joins))))
        first = F.min(F.struct(rank("b").alias("r"), F.col("b").alias("id"))).alias("n")
        near = both.groupBy(F.col("a").alias("node")).agg(first)
        own = F.struct(rank("node").alias("r"), F.col("node").alias("id"))
        step = written(near.select("node", F.least(own, F.col("n"))["id"].alias("to")))
        joins.append(step)
        of_a, of_b = (step.select(F.col("node").alias(c), F.col("to").alias(f"_{c}")) for c in "ab")
        edges = _edges(edges.join(of_a, "a").join(of_b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    if not joins:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    found = joins[-1]
    for step in reversed(joins[:-1]):
        later = found.select(F.col("node").alias("to"), F.col("to").alias("_to"))
        found = step.join(later, "to", "left").select("node", F.coalesce("_to", "to").alias("to"))
    if len(joins) == 1:
        return found.select("node", F.col("to").alias("component"))
    found = written(found)
    lowest = written(found.groupBy("to").agg(F.min("node").alias("component")))
    return written(found.join(lowest, "to").select("node", "component"))


def merged_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: components of the graph whose nodes are the components so far."""
    of_a = labels.select(F.col("node").alias("a"), F.col("component").alias("_a"))
    of_b = labels.select(F.col("node").alias("b"), F.col("component").alias("_b"))
    between = links.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    joined = components(between.filter("a != b").distinct()).select(F.col("node").alias("component"), F.col("component").alias("_low"))
    known = labels.join(joined, "component", "left").select("node", F.coalesce("_low", "component").alias("component"))
    fresh = joined.select(F.col("component").alias("node"), F.col("_low").alias("component")).join(labels.select("node"), "node", "left_anti")
    return written(known.unionByName(fresh))


def _edges(links: DataFrame) -> DataFrame:
    """Distinct links between different nodes, the smaller first."""
    return written(links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def node_key(doc_id: str, text: str, seed: int) -> Column:
    """The node of a row in the graph: rows of the same id and text are one."""
    return F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`").isNull(), F.col(f"`{doc_id}`"), F.col(f"`{text}`").isNull(), F.col(f"`{text}`"))


def profiled_nodes(docs: DataFrame, text: str, doc_id: str, size: int, bands: int, rows: int) -> tuple[DataFrame, int]:
    """``doc_id, node, n_shingles, digest, bands`` of each row, and the seed with which no two nodes share a key."""
    bound_batches(docs.sparkSession)
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("_text"))
    seed = 0
    while True:
        keyed = named.withColumn("node", node_key("doc_id", "_text", seed))
        profiles = written(keyed.withColumn("p", profile(F.col("_text"), size, bands, rows)).select("doc_id", "node", "p.*"))
        content = F.xxhash64(F.lit(-1), "digest", "doc_id", F.col("doc_id").isNull())
        if not profiles.groupBy("node").agg(F.min(content).alias("x"), F.max(content).alias("y")).filter("x != y").limit(1).count():
            return profiles, seed
        seed += 1


def node_links(profiles: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links ``a, b`` between nodes of ``profiles``; ``texts`` are ``node, _text`` of all rows."""
    full = profiles.filter("n_shingles > 0")
    # One representative a set; equal sets need no comparison.
    nodes = written(full.groupBy("node").agg(F.first("digest").alias("digest"), (F.count("*") > 1).alias("again")))
    classes = nodes.groupBy("digest").agg(F.min_by(F.struct("node", "again"), F.struct("again", "node")).alias("r"))
    classes = written(classes.select("digest", F.col("r.node").alias("rep"), "r.again"))
    copies = nodes.join(classes, "digest").filter("node != rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    reps = full.select(F.col("node").alias("doc_id"), "bands").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    texts = texts.select(F.col("node").alias("doc_id"), "_text")
    again = classes.filter("again").select(F.col("rep").alias("doc_id"))
    if again.limit(1).count():
        # Rows of one node hold one text, which is compared once.
        reps = reps.groupBy("doc_id").agg(F.first("bands").alias("bands"))
        once = may_be_among(texts, "doc_id", again).join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.first("_text").alias("_text"))
        once = written(once.select("doc_id", "_text"))
        texts = join_small(texts, again, ["doc_id"], "left_anti", row_bytes=32).unionByName(once)
    return link_candidates(reps, texts, size, percent).union(copies)


def single_rows(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    size: int = SHINGLE,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row of each group of near copies, with the columns of ``docs``.

    Every distinct pair of id and text is a document of its own, so unrelated texts under one id all stay.
    The row with the smallest id stays, null being the largest; of equal ids and texts the row that comes
    first by a hash of all its columns. Rows with a null id go only as copies: if a row that stays has the same
    shingle set. Rows without words stay, once a non-null id and text.
    """
    profiles, seed = profiled_nodes(docs, text, doc_id, size, bands, rows)
    keyed = docs.withColumn("_node", node_key(doc_id, text, seed))
    texts = keyed.select(F.col("_node").alias("node"), F.col(f"`{text}`").alias("_text"))
    links = node_links(profiles.filter(F.col("doc_id").isNotNull()), texts, size, percent)
    full = profiles.filter("n_shingles > 0")
    lead = full.groupBy("digest").agg(F.min_by("node", F.struct(F.col("doc_id").isNull(), "node")).alias("a"))
    unnamed = full.filter(F.col("doc_id").isNull()).select("digest", F.col("node").alias("b")).distinct()
    found = components(links.union(lead.join(unnamed, "digest").filter("a != b").select("a", "b")))
    ids = profiles.select("node", "doc_id").distinct().join(found, "node")
    first = ids.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("f"))
    gone = ids.join(first, "component").filter("node != f.node").select(F.col("node").alias("_node"))
    same = profiles.filter((F.col("n_shingles") > 0) | F.col("doc_id").isNotNull())
    repeated = written(same.groupBy("node").count().filter("count > 1").select(F.col("node").alias("_node")))
    apart = written(gone.unionAll(repeated).distinct())
    gone = written(gone)
    forget(apart, gone, repeated)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = keyed.join(apart, "_node", "left_anti").select(*columns)
    if repeated.limit(1).count():
        again = may_be_among(keyed, "_node", repeated).join(repeated, "_node", "left_semi").join(gone, "_node", "left_anti")
        row = F.struct(*columns)
        one = again.groupBy("_node").agg(F.min_by(row, F.struct(F.xxhash64(F.to_json(row)), F.to_json(row))).alias("_row"))
        kept = kept.unionByName(one.select("_row.*"))
    return kept


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    size: int = SHINGLE,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per row of ``docs``.

    Documents are linked if they share at least ``percent`` per cent of the union of their shingle
    sets (``size`` words, A-Z lower-cased; fewer words form one shingle). ``component_id`` is the
    smallest id reachable over links, and the row with that id is kept. Texts that are null or
    without words have no shingle and are linked with nothing. Rows that share an id are one
    document in the graph: what is linked to one is linked to all. A row with a null id cannot be a
    node: its component is null and it is kept. Other columns are not read. An empty table
    gives no rows.
    """
    profiles, seed = profiled_nodes(docs, text, doc_id, size, bands, rows)
    texts = docs.select(node_key(doc_id, text, seed).alias("node"), F.col(f"`{text}`").alias("_text"))
    named = profiles.filter(F.col("doc_id").isNotNull())
    links = node_links(named, texts, size, percent)
    nodes = named.select("doc_id", "node").distinct()
    shared = nodes.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("_last")).filter("a != _last")
    links = links.union(shared.join(nodes, "doc_id").filter("a != node").select("a", F.col("node").alias("b")))
    found = written(nodes.join(components(links), "node"))
    lowest = written(found.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    of_node = written(found.join(lowest, "component").select("node", "component_id"))
    forget(profiles, of_node)
    keyed = profiles.select("doc_id", "n_shingles", "node").join(of_node, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("component_id"), F.col("doc_id")))
    return keyed.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
