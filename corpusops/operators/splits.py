"""Seeded splits with exact counts."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusops.contracts import DatasetError
from corpusops.operators.ranking import PLACE, below, cut_points, seeded_key, with_place


def parse_ratios(text: str) -> dict[str, float]:
    """``train=0.8,dev=0.2`` to a mapping; a name given twice keeps its last ratio."""
    if not text:
        raise DatasetError("at least one split ratio is needed")
    return dict(map(_ratio, text.split(",")))


def _ratio(entry: str) -> tuple[str, float]:
    match = re.fullmatch(r"([^=]+)=(.+)", entry)
    if match is None:
        raise DatasetError(f"split '{entry}' must look like name=ratio")
    name, number = match.group(1).strip(), match.group(2)
    try:
        return name, float(number)
    except ValueError:
        raise DatasetError(f"split '{name}' has no numeric ratio: {number}") from None


def normalise_ratios(ratios: Mapping[str, float]) -> dict[str, float]:
    """Ratios scaled to a sum of one."""
    total = math.fsum(ratios.values())
    below_zero = sorted(name for name in ratios if ratios[name] < 0)
    for wrong, message in (
        (not ratios, "at least one split is needed"),
        (below_zero, f"split ratios must not be negative: {below_zero}"),
        (not total > 0, "split ratios must have a positive sum"),
    ):
        if wrong:
            raise DatasetError(message)
    return {name: ratios[name] / total for name in ratios}


def allocate(total: int, ratios: Mapping[str, float]) -> dict[str, int]:
    """Largest remainder; ties go to the later name, leftovers go round."""
    shares = {name: ratio * total for name, ratio in normalise_ratios(ratios).items()}
    counts = {name: math.floor(share) for name, share in shares.items()}
    by_remainder = sorted(shares, key=lambda n: (shares[n] - counts[n], n), reverse=True)
    for i in range(total - sum(counts.values())):
        counts[by_remainder[i % len(by_remainder)]] += 1
    return counts


def allocation(totals: DataFrame, ratios: Mapping[str, float], total: str = "total") -> DataFrame:
    """The same rule for many totals at once: one row per input row and split, without a shuffle."""
    # By name from the last: array positions then order ties as the rule wants them.
    names = sorted(normalise_ratios(ratios).items(), reverse=True)
    share = [F.col(total) * F.lit(ratio) for _, ratio in names]
    base = [F.floor(s).cast("long") for s in share]
    left = F.col(total) - sum(base[1:], base[0])
    best = F.array_sort(F.array(*[F.struct((b - s).alias("less"), F.lit(i).alias("at")) for i, (s, b) in enumerate(zip(share, base))]))
    order = F.transform(best, lambda x: x["at"])
    rows = [
        F.struct(
            F.lit(name).alias("split"),
            (b + F.when(F.array_position(order, i) <= left, 1).otherwise(0)).cast("long").alias("rows"),
        )
        for i, ((name, _), b) in enumerate(zip(names, base))
    ]
    return totals.select("*", F.inline(F.array(*rows)))


def assign_splits(
    df: DataFrame,
    ratios: Mapping[str, float],
    seed: int,
    id_column: str = "id",
    content: list[str] | None = None,
) -> tuple[DataFrame, dict[str, int]]:
    """Add ``split``; counts are exact and the same seed gives the same split.

    The corpus is not shuffled: its cut points are found by counting key prefixes, and each row
    is then placed by comparing its key with them.
    """
    counts: dict[str, int] = {}

    def targets(total: int) -> list[int]:
        counts.update(allocate(total, ratios))
        upto, result = 0, []
        for n in list(counts.values())[:-1]:
            upto += n
            result.append(upto)
        return result

    placed = with_place(df)
    key = seeded_key(df, seed, id_column, content)
    _, cuts = cut_points(placed, key, targets)
    names = list(counts)
    split: Column = F.lit(names[-1])
    for name, cut in reversed(list(zip(names, cuts))):
        split = F.when(below(key, cut), F.lit(name)).otherwise(split)
    return placed.withColumn("split", split).drop(PLACE), counts
