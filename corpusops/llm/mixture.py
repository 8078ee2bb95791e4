"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is cut into blocks of documents by a seeded hash, and its blocks are put in a seeded
permuted order, anew for each pass over the source. A target above the size of a source means
whole passes and then a last, partial one. The blocks a source owes (its exact quota) are dealt to the
output shards by a binary tree: at each node the quota vector over sources is split between the two
halves of the shards by one multivariate hypergeometric draw, so every shard gets its exact number of
blocks and the split between sources is that of a draw without replacement. Each shard then takes the
next disjoint run of every source's permuted blocks and shuffles its documents locally.

Documents are whole: the last block of a partial pass is cut at the document that brings the words
taken nearest to the target. Only tables with one row per source or per block are aggregated; words
are summed per block first and rows are ordered only within blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusops.contracts import DatasetError
from corpusops.session import cut_lineage

SEED = 29
ROWS_PER_BLOCK = 256
MOST_BLOCKS = 65_536  # of one source; beyond it blocks grow instead
MOST_SOURCES = 100_000
DIGITS = 8
WEIGHTS = (3, 1, 2)


@dataclass(frozen=True)
class Target:
    """Words of a source and what the mix shall take of it: ``numerator / denominator`` words."""

    words: int
    numerator: int
    denominator: int

    @property
    def value(self) -> float:
        return self.numerator / self.denominator


def water_fill(sizes: list[int], weights: list[int], numerator: int, denominator: int, most: int) -> list[Target]:
    """Share ``numerator / denominator`` of all words by weight, no source above ``most`` times its size.

    What a full source cannot take is shared by weight among the others until none is above its bound.
    All sums stay whole numbers, so the result does not depend on the order of additions.
    """
    budget = numerator * sum(sizes)
    full: set[int] = set()
    while True:
        left = budget - denominator * most * sum(sizes[i] for i in full)
        weight = sum(w for i, w in enumerate(weights) if i not in full)
        over = {i for i, w in enumerate(weights) if i not in full and w * left > denominator * weight * most * sizes[i]}
        if not over:
            break
        full |= over
    return [
        Target(size, most * size, 1) if i in full else Target(size, weights[i] * left, denominator * weight)
        for i, size in enumerate(sizes)
    ]


def split_quota(quota: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source for each shard (rows: shards); columns add up to the quota."""
    if shards == 1:
        return quota[None, :]
    left = shards // 2
    total = int(quota.sum())
    draws = total * left // shards
    taken = rng.multivariate_hypergeometric(quota, draws, method="marginals") if total else np.zeros_like(quota)
    return np.concatenate([split_quota(taken, left, rng), split_quota(quota - taken, shards - left, rng)])


def word_count(text: Column) -> Column:
    """Number of runs of other characters than ASCII whitespace; null: 0."""
    marked = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def source_targets(rows: DataFrame, share: tuple[int, int], most: int) -> list[tuple[str | None, int, Target]]:
    """Name, number of rows and target of each source, by code point with null last."""
    found = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    listed = found.limit(MOST_SOURCES + 1).collect()
    if len(listed) > MOST_SOURCES:
        raise DatasetError(f"a mixture has at most {MOST_SOURCES} sources")
    listed.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(listed))]
    targets = water_fill([r["words"] for r in listed], weights, *share, most)
    return [(r["source"], r["rows"], t) for r, t in zip(listed, targets)]


def further_copies(rows: DataFrame) -> DataFrame:
    """``_at, _copy``: a hash of its own for each further row of equal source, id and text.

    Copies are counted per part of the scan, and the counts give each part's offset, so rows are numbered
    within parts only and a third of all rows may be copies of one. The hashes of a class of copies
    follow from their number alone.
    """
    part = F.shiftright("_at", 33)
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-"))
    placed = rows.select("_at", "_hash", name.alias("_name"), part.alias("_part"))
    counts = placed.groupBy("_hash", "_name", "_part").agg(F.count("*").alias("_n"))
    same = W.partitionBy("_hash", "_name")
    before = F.sum("_n").over(same.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = (
        counts.withColumn("_before", F.coalesce(before, F.lit(0)))
        .withColumn("_all", F.sum("_n").over(same))
        .filter("_all > 1")
        .drop("_n", "_all")
    )
    inside = W.partitionBy("_hash", "_name", "_part").orderBy("_at")
    numbered = placed.join(offsets, ["_hash", "_name", "_part"]).withColumn("_number", F.col("_before") + F.row_number().over(inside) - 1)
    copy = F.md5(F.concat_ws("+", "_hash", F.col("_number").cast("string")))
    return numbered.filter("_number > 0").select("_at", copy.alias("_copy"))


def mix_sources(
    docs: DataFrame,
    share: tuple[int, int] = (3, 2),
    most: int = 2,
    n_shards: int = 16,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    seed: int = SEED,
    keep: bool = False,
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, draws``; with ``keep`` also ``row``.

    ``draws`` lists the passes that take the document, in order, as ``(pass, shard, spot)``: ``shard`` is the
    output shard and ``spot`` a seeded number by which a shard orders its rows. ``row`` is a struct of
    all input columns. ``size`` counts the words of the text (null: 0). All sources share ``share`` (a
    fraction) of all words by their weights, each at most ``most`` times its own size.

    A null source is one of its own and comes last. Documents without words cost nothing and are
    taken with their block. Rows equal in source, id and text are numbered, and the number enters their
    hash, so they are drawn one by one like any others; which of them is which is open. A table
    without rows gives none; one without words has targets of 0. Reruns agree: every choice follows
    from ids, texts and ``seed``.
    """
    spark = docs.sparkSession
    content = F.col(f"`{text}`")
    digest = F.md5(F.coalesce(content, F.lit("")))
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), digest)
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{source}`").cast("string").alias("source"),
        word_count(content).alias("size"),
        F.md5(key).alias("_hash"),
        F.monotonically_increasing_id().alias("_at"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep else []),
    )
    narrow = cut_lineage(rows.drop("row"))
    copies = cut_lineage(further_copies(narrow))
    if not copies.isEmpty():
        hashed = F.coalesce(F.col("_copy"), F.col("_hash"))
        narrow = cut_lineage(narrow.join(copies, "_at", "left").withColumn("_hash", hashed).drop("_copy"))
        # The table may not be read in the same order twice, so the rows themselves are numbered once.
        rows = cut_lineage(rows) if keep else narrow
        if keep:
            renamed = cut_lineage(further_copies(rows.drop("row")))
            rows = rows.join(renamed, "_at", "left").withColumn("_hash", hashed).drop("_copy")
    sources = source_targets(narrow, share, most)
    plan = []
    for number, (name, n_rows, t) in enumerate(sources):
        passes = t.numerator // (t.denominator * t.words) if t.words else 0
        rest = (t.numerator - passes * t.denominator * t.words) / t.denominator
        blocks = min(MOST_BLOCKS, max(1, n_rows // ROWS_PER_BLOCK))
        plan.append((name, number, blocks, t.words, t.value, passes, rest))
    schema = "source string, number int, blocks long, source_size long, target double, passes int, rest double"
    # One row a source, at most MOST_SOURCES of about 100 bytes.
    per_source = F.broadcast(spark.createDataFrame(plan, schema).withColumnRenamed("source", "_name"))

    def placed(some: DataFrame) -> DataFrame:
        digits = F.conv(F.substring("_hash", 1, DIGITS), 16, 10).cast("long")
        joined = some.join(per_source, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
        return joined.withColumn("block", F.pmod(digits, F.col("blocks")))

    # Every pass permutes the blocks anew. All passes but the last are whole.
    by_block = placed(narrow).groupBy("number", "block", "passes", "rest").agg(F.sum("size").alias("words"))
    turns = W.partitionBy("number", "pass").orderBy("_order", "block")
    units = (
        by_block.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes"))))
        .withColumn("_order", F.md5(F.concat_ws("/", F.lit(seed), "number", "pass", "block")))
        .withColumn("turn", F.row_number().over(turns))
        .withColumn("before", F.sum("words").over(turns.rowsBetween(W.unboundedPreceding, 0)) - F.col("words"))
        .withColumn("partial", F.col("pass") == F.col("passes"))
        .filter(~F.col("partial") | (F.col("before") < F.col("rest")))
        .withColumn("crossing", F.col("partial") & (F.col("before") + F.col("words") > F.col("rest")))
        .select("number", "block", "pass", "turn", "before", "crossing")
    )
    units = cut_lineage(units)

    # Exact quotas of every source and pass, the splitting tree, and each shard's run of turns.
    owed = units.groupBy("number", "pass").agg(F.count("*").alias("n")).collect()
    keys = sorted((r["number"], r["pass"]) for r in owed)
    quota = {(r["number"], r["pass"]): r["n"] for r in owed}
    tree = split_quota(np.array([quota[k] for k in keys], np.int64), n_shards, np.random.default_rng(seed))
    ends = np.cumsum(tree, axis=0)
    runs = [(*k, [int(x) for x in ends[:, i]]) for i, k in enumerate(keys)]
    # One row a source and pass.
    shard_runs = F.broadcast(spark.createDataFrame(runs, "number int, pass int, ends array<long>"))
    shard = F.size(F.filter("ends", lambda end: end < F.col("turn")))
    units = units.join(shard_runs, ["number", "pass"]).withColumn("shard", shard)

    # A partial pass ends inside one block: its last document is the one that ends nearest to the target.
    ending = units.filter("crossing").select("number", "block", "before")
    inside = W.partitionBy("number").orderBy("_hash").rangeBetween(W.unboundedPreceding, 0)
    middle = F.col("before") + F.sum("size").over(inside) - F.col("size") / 2
    last = (
        placed(narrow)
        .join(F.broadcast(ending), ["number", "block"])
        .withColumn("_in", middle <= F.col("rest"))
        .filter("_in")
        .groupBy("number")
        .agg(F.max("_hash").alias("last"))
    )
    units = units.join(F.broadcast(last), "number", "left")
    until = F.when(F.col("crossing"), F.coalesce(F.col("last"), F.lit("")))
    per_block = units.groupBy("number", "block").agg(
        F.array_sort(F.collect_list(F.struct("pass", "shard", until.alias("until")))).alias("units")
    )

    drawn = placed(rows).join(per_block, ["number", "block"], "left")
    valid = F.filter(
        F.coalesce(F.col("units"), F.array()), lambda u: u["until"].isNull() | (F.col("_hash") <= u["until"])
    )
    spot = lambda u: F.conv(
        F.substring(F.md5(F.concat_ws("|", u["shard"], u["pass"], F.col("_hash"))), 1, DIGITS), 16, 10
    ).cast("long")
    draws = F.transform(valid, lambda u: F.struct(u["pass"].alias("pass"), u["shard"].alias("shard"), spot(u).alias("spot")))
    return drawn.select(
        "doc_id", "source", "size", "source_size", "target", draws.alias("draws"), *(["row"] if keep else [])
    )
