"""Exact cut points and exact ordinals of a seeded random order, without a global sort.

Rows are ordered by a fixed-width hex key: the hash of seed and id, then the hash of the row's
content (repeated ids), then the row's place in its scan (identical copies, which are
interchangeable). Keys spread evenly over their first hex digits, so counting rows per prefix
says where any rank lies. Prefixes are lengthened only where that is not exact yet (cut points)
or where a prefix still holds too many rows (ordinals), so even one id owning a third of the
rows, or a third of the rows being copies, ends in small groups.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusops.sources.positions import POSITION

# A level adds at most 16 bits, so at most 65,536 counts per open prefix reach the driver.
# The jumps to 32 and 64 follow 32 fixed bits, below which only a handful of hashes remain.
LEVELS = (4, 8, 32, 36, 40, 64, 68, 72, 76, 80)
LEAF_ROWS = 2_000_000
PLACE = "_place"


@dataclass(frozen=True)
class OrderKey:
    """The parts of the key: 32 + 32 + 16 hex digits."""

    by_id: Column
    by_content: Column
    by_place: Column

    def prefix(self, length: int) -> Column:
        if length <= 32:
            return F.substring(self.by_id, 1, length)
        if length <= 64:
            return F.concat(self.by_id, F.substring(self.by_content, 1, length - 32))
        return F.concat(self.by_id, self.by_content, F.substring(self.by_place, 1, length - 64))


def seeded_key(df: DataFrame, seed: int | str, id_column: str = "id", content: list[str] | None = None) -> OrderKey:
    """Key of the seeded order. ``content`` names the columns that tell repeated ids apart."""
    names = sorted(content if content is not None else [c for c in df.columns if c not in (PLACE, POSITION)])
    body = F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]))
    return OrderKey(
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))),
        F.md5(body),
        F.lpad(F.lower(F.hex(F.col(PLACE))), 16, "0"),
    )


def with_place(df: DataFrame) -> DataFrame:
    return df.withColumn(PLACE, F.monotonically_increasing_id())


def _count_children(df: DataFrame, key: OrderKey, parent: int, parents: list[str], level: int) -> dict[str, int]:
    open_rows = df.filter(key.prefix(parent).isin(parents)) if parents else df
    rows = open_rows.groupBy(key.prefix(level).alias("p")).count().collect()
    return dict(sorted((r["p"], r["count"]) for r in rows))


def cut_points(df: DataFrame, key: OrderKey, targets: Callable[[int], list[int]]) -> tuple[int, list[str | None]]:
    """Total rows, and for each target ``t`` the prefix up to which exactly ``t`` rows lie.

    A target of 0 gives ``None``. Costs one narrow scan per level; with unique ids two levels
    decide nearly always.
    """
    total = 0
    cuts: list[str | None] = []
    pending: dict[int, tuple[int, str]] = {}
    parent = 0
    for level in LEVELS:
        counts = _count_children(df, key, parent, sorted({p for _, p in pending.values()}), level)
        if parent == 0:
            total = sum(counts.values())
            wanted = targets(total)
            cuts = [None] * len(wanted)
            pending = {i: (t, "") for i, t in enumerate(wanted) if t > 0}
        still: dict[int, tuple[int, str]] = {}
        for i, (rest, prefix) in pending.items():
            for child, n in counts.items():
                if not child.startswith(prefix):
                    continue
                if n == rest:
                    cuts[i] = child
                elif n > rest:
                    still[i] = (rest, child)
                else:
                    rest -= n
                    continue
                break
        pending, parent = still, level
        if not pending:
            return total, cuts
    raise ValueError("rows could not be told apart by their place in the scan")


def below(key: OrderKey, cut: str | None) -> Column:
    """Whether a row lies at or before a cut point."""
    return F.lit(False) if cut is None else key.prefix(len(cut)) <= F.lit(cut)


def ordinals(df: DataFrame, key: OrderKey, name: str = "ordinal", leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Exact 1-based rank of every row in key order: one shuffle, groups of bounded size."""
    leaves: dict[str, int] = {}
    crowded: list[tuple[int, list[str]]] = []
    parent, parents = 0, []
    for level in LEVELS:
        counts = _count_children(df, key, parent, parents, level)
        if parent == 0:
            leaf_rows = max(leaf_rows, 4 * sum(counts.values()) // 65_536)
        full = [p for p, n in counts.items() if n > leaf_rows]
        leaves |= {p: n for p, n in counts.items() if n <= leaf_rows}
        if not full:
            break
        crowded.append((level, full))
        parent, parents = level, full
    leaf = key.prefix(LEVELS[len(crowded)])
    for level, full in reversed(crowded):
        leaf = F.when(key.prefix(level).isin(full), leaf).otherwise(key.prefix(level))
    offsets, before = [], 0
    for prefix in sorted(leaves):
        offsets.append((prefix, before))
        before += leaves[prefix]
    # One row per leaf: 65,536 plus the few crowded prefixes, so broadcasting it is bounded.
    table = df.sparkSession.createDataFrame(offsets, "_leaf string, _offset long")
    deep = len(crowded) > 0
    order = [key.by_id, key.by_content, key.by_place] if deep else [key.by_id, key.by_content]
    return (
        df.withColumn("_leaf", leaf)
        .join(F.broadcast(table), "_leaf")
        .withColumn(name, F.col("_offset") + F.row_number().over(W.partitionBy("_leaf").orderBy(*order)))
        .drop("_leaf", "_offset")
    )
